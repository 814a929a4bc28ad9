"""Passes over spells sorted by (fit, stratum, day), for any number of days and strata.

Rows are laid out once: range partitions of bounded size, sorted, packed as blocks of
doubles.  A task holds its own partition.  Risk sets reach over partitions, but what a partition
needs of the others is little: the hazard sums of the rows behind its last stratum, and the
exposure its first stratum has gathered before it.  So every pass returns a few numbers a
partition (its first and last (stratum, day) cell, the sums of its first stratum), the
driver carries them along the partitions, and the next pass starts from the carried values.
No per-day table comes to the driver.

Several fits share a pass.  They are keyed (each row belongs to one fit) or side by side (every
row has a count for each fit, and one covariate may differ from fit to fit).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.errors import IdentificationError
from tidemark.operators.gram import FAN_IN
from tidemark.session import settle

PART_BYTES = 64 << 20   # of packed rows a partition
LEAST_ROWS = 2_000      # a partition is not cut smaller than this
DIRECT = 4_000_000      # numbers of all partitions' matrices that come back without folding
TIES_AT_ONCE = 1_000_000
MAX_STEPS = 50
TOLERANCE = 1e-12
LEAD = 4                # fit, stratum, day, event


def tie_sums(risk, tied, events) -> np.ndarray:
    """Efron sums of cells: over ``l = 0..events-1`` with ``phi = risk - l / events * tied``.

    Per cell the sums of ``1/phi, s/phi, 1/phi^2, s/phi^2, s^2/phi^2, log phi`` with
    ``s = l / events``, formed in pieces of at most ``TIES_AT_ONCE`` events.
    """
    risk, tied = np.atleast_1d(np.asarray(risk, float)), np.atleast_1d(np.asarray(tied, float))
    events = np.atleast_1d(np.asarray(events)).astype(np.int64)
    out = np.zeros((len(events), 6))
    ends = np.cumsum(events)
    total = int(ends[-1]) if len(ends) else 0
    for start in range(0, total, TIES_AT_ONCE):
        place = np.arange(start, min(start + TIES_AT_ONCE, total))
        cell = np.searchsorted(ends, place, side="right")
        share = (place - (ends[cell] - events[cell])) / events[cell]
        phi = risk[cell] - share * tied[cell]
        terms = np.stack([1 / phi, share / phi, 1 / phi**2, share / phi**2, share**2 / phi**2, np.log(phi)], axis=1)
        begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        out[cell[begins]] += np.add.reduceat(terms, begins, axis=0)
    return out


@dataclass
class Recipe:
    """How a fit reads the raw columns: which of them, centred and scaled by what."""

    columns: np.ndarray
    means: np.ndarray
    scale: np.ndarray

    @property
    def p(self) -> int:
        return len(self.columns)


@dataclass
class Layout:
    """Packed rows: fit, stratum, day, event, raw covariates, counts, own values of ``own``."""

    blocks: DataFrame
    p: int
    fits: int = 0             # side by side; 0 when rows are keyed
    own: int | None = None    # covariate that differs from fit to fit
    parts: int = 1

    @property
    def width(self) -> int:
        return LEAD + self.p + self.fits * (1 if self.own is None else 2)


def lay_out(rows: DataFrame, covariates: list[str], n: int, fits: int = 0, own: int | None = None, finish=None) -> Layout:
    """Sort and pack ``rows`` (``fit``, ``stratum``, ``t``, ``e``, covariates, and what follows).

    For fits side by side an array of counts follows.  ``finish`` turns the doubles of a batch
    into the packed columns; without it they are packed as they come.  A day that is very common is split by a salt of the covariates.
    """
    spark = rows.sparkSession
    width = LEAD + len(covariates) + fits * (1 if own is None else 2)
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-n * width * 8 // PART_BYTES), min(cores, -(-n // LEAST_ROWS)), 1)
    extra = [F.col(f"`{c}`") for c in rows.columns if c not in ("fit", "stratum", "t", "e", *covariates)]
    chosen = rows.select("fit", "stratum", "t", "e", *[F.col(f"`{c}`") for c in covariates], *extra)
    salt = F.xxhash64(*[F.col(f"`{c}`") for c in covariates])
    ordered = chosen.repartitionByRange(int(parts), "fit", "stratum", "t", salt).sortWithinPartitions("fit", "stratum", "t")

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = []
            for c in batch.columns:
                if pa.types.is_list(c.type):
                    columns.append(c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype("float64"))
                else:
                    columns.append(c.to_numpy(zero_copy_only=False).astype("float64")[:, None])
            values = np.hstack(columns)
            values = np.ascontiguousarray(values if finish is None else finish(values))
            yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], names=["m"])

    packed = settle(ordered.mapInArrow(pack, "m binary"))
    return Layout(packed, len(covariates), fits, own, int(parts))


@dataclass
class Cells:
    """The (stratum, day) cells of a fit in one partition, with the rows they are made of."""

    stratum: np.ndarray
    day: np.ndarray
    sums: np.ndarray      # events, s0, d0, s1, d1, covariates of events
    first: np.ndarray     # cells of the partition's first stratum
    last: np.ndarray
    x: np.ndarray
    weight: np.ndarray    # hazard of each row
    event: np.ndarray
    cell: np.ndarray      # of each row
    scalars: np.ndarray   # rows, events, log hazard of events


def _cells(block: np.ndarray, x: np.ndarray, count: np.ndarray, beta: np.ndarray) -> Cells:
    stratum, day, event = block[:, 1], block[:, 2], block[:, 3]
    p = x.shape[1]
    eta = x @ beta
    weight = count * np.exp(eta)
    fresh = np.ones(len(block), bool)
    fresh[1:] = (stratum[1:] != stratum[:-1]) | (day[1:] != day[:-1])
    begins = np.flatnonzero(fresh)
    table = np.empty((len(block), 3 + 3 * p))
    table[:, 0], table[:, 1], table[:, 2] = count * event, weight, weight * event
    table[:, 3 : 3 + p] = weight[:, None] * x
    table[:, 3 + p : 3 + 2 * p] = table[:, 2][:, None] * x
    table[:, 3 + 2 * p :] = table[:, 0][:, None] * x
    sums = np.add.reduceat(table, begins, axis=0)
    s = stratum[begins]
    scalars = np.array([count.sum(), (count * event).sum(), (count * event * eta).sum()])
    return Cells(s, day[begins], sums, s == s[0], s == s[-1], x, weight, event, np.cumsum(fresh) - 1, scalars)


def _fits_of(values: np.ndarray, layout_p: int, fits: int, own: int | None, recipes: dict, betas: dict):
    """(fit, rows, covariates, counts) of every wanted fit that has rows in a partition."""
    for f, beta in betas.items():
        recipe = recipes[f]
        if fits:
            count = values[:, LEAD + layout_p + f]
            block, count = values[count > 0], count[count > 0]
        else:
            block = values[values[:, 0] == f]
            count = np.ones(len(block))
        if not len(block):
            continue
        raw = block[:, LEAD : LEAD + layout_p]
        if own is not None:
            raw = raw.copy()
            raw[:, own] = block[:, LEAD + layout_p + fits + f]
        yield f, block, (raw[:, recipe.columns] - recipe.means) / recipe.scale, count, beta


def _after(c: Cells, carry: np.ndarray, p: int) -> np.ndarray:
    """Hazard sums (s0, s1) of every cell's risk set; ``carry`` lies behind the partition."""
    own = np.concatenate([c.sums[:, 1:2], c.sums[:, 3 : 3 + p]], axis=1)
    total = np.cumsum(own[::-1], axis=0)[::-1]
    ends = np.flatnonzero(np.concatenate([c.stratum[1:] != c.stratum[:-1], [True]]))
    behind = np.vstack([total, np.zeros((1, 1 + p))])[ends + 1]
    which = np.searchsorted(ends, np.arange(len(c.day)))
    risk = total - behind[which]
    risk[c.last] += carry
    return risk


def _interior(c: Cells) -> np.ndarray:
    """Cells with events that lie in this partition alone."""
    inside = c.sums[:, 0] > 0
    inside[0] = inside[-1] = False
    return np.flatnonzero(inside)


def _running(values: np.ndarray, stratum: np.ndarray) -> np.ndarray:
    """Cumulative sums that start again with every stratum."""
    total = np.cumsum(values)
    begins = np.flatnonzero(np.concatenate([[True], stratum[1:] != stratum[:-1]]))
    before = np.concatenate([[0.0], total])[begins]
    return total - before[np.searchsorted(begins, np.arange(len(values)), side="right") - 1]


@dataclass
class Edge:
    """A cell that touches a partition's border, put together over partitions."""

    stratum: float
    day: float
    sums: np.ndarray
    risk: np.ndarray | None = None
    ties: np.ndarray | None = None
    upto: float = 0.0     # events up to this cell, its own included

    @property
    def inverse(self) -> float:
        return float(self.ties[0])

    @property
    def hazard(self) -> float:
        return float(self.sums[0] / self.risk[0]) if self.sums[0] > 0 else 0.0


@dataclass
class Seat:
    """What a partition of a fit is told: sums behind it, exposure before it, its border cells."""

    part: int
    head: Edge
    tail: Edge
    single: bool          # one stratum
    total: np.ndarray     # s0, s1 of the first stratum
    ending: np.ndarray    # s0, s1 of the tail cell's rows here
    fresh: bool           # the head cell begins here
    carry: np.ndarray | None = None
    base: float = 0.0     # exposure up to the head cell, that included
    hazard_base: float = 0.0
    events_base: float = 0.0


@dataclass
class Point:
    """Log likelihood and its first derivative at ``beta``, and the seats to go on from."""

    beta: np.ndarray
    value: float
    gradient: np.ndarray
    rows: float
    events: float
    seats: list[Seat] = field(default_factory=list)


class Passes:
    """The passes over one layout; ``recipes`` has a fit's columns by its number."""

    def __init__(self, layout: Layout, recipes: dict[int, Recipe]) -> None:
        self.layout, self.recipes = layout, recipes

    def _run(self, betas: dict[int, np.ndarray], schema: str, work):
        layout, recipes = self.layout, {f: self.recipes[f] for f in betas}
        width, p, fits, own = layout.width, layout.p, layout.fits, layout.own

        def task(batches):
            blocks = [np.frombuffer(m, dtype="float64").reshape(-1, width) for b in batches for m in b.column(0).to_pylist()]
            if not blocks:
                return
            values = np.vstack(blocks)
            part = TaskContext.get().partitionId()
            for f, block, x, count, beta in _fits_of(values, p, fits, own, recipes, betas):
                yield from work(part, f, _cells(block, x, count, beta))

        return layout.blocks.mapInArrow(task, schema)

    def _numbers(self, betas, work):
        """Rows (part, fit, numbers) of a pass, in the order of the partitions."""

        def emit(part, f, cells):
            found = work(part, f, cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([f], pa.int32()), pa.array([found.tolist()], pa.list_(pa.float64()))], names=["part", "fit", "m"]
            )

        rows = self._run(betas, "part int, fit int, m array<double>", emit).collect()
        return sorted(((r["part"], r["fit"], np.asarray(r["m"])) for r in rows), key=lambda r: r[:2])

    def evaluate(self, betas: dict[int, np.ndarray]) -> dict[int, Point]:
        """Value and gradient of every fit at its ``beta``: two passes, whatever their number."""

        def borders(part, f, c):
            p = c.x.shape[1]
            total = np.concatenate([[c.sums[c.first, 1].sum()], c.sums[c.first, 3 : 3 + p].sum(axis=0)])
            return np.concatenate(
                [[c.stratum[0], c.day[0], c.stratum[-1], c.day[-1]], c.sums[0], c.sums[-1], total, c.scalars, c.sums[:, 3 + 2 * p :].sum(axis=0)]
            )

        points: dict[int, Point] = {}
        for part, f, m in self._numbers(betas, borders):
            p = self.recipes[f].p
            wide = 3 + 3 * p
            head, tail = m[4 : 4 + wide], m[4 + wide : 4 + 2 * wide]
            total, rest = m[4 + 2 * wide : 5 + 2 * wide + p], m[5 + 2 * wide + p :]
            point = points.setdefault(f, Point(betas[f], 0.0, np.zeros(p), 0.0, 0.0))
            point.rows, point.events = point.rows + rest[0], point.events + rest[1]
            point.value, point.gradient = point.value + rest[2], point.gradient + rest[3:]
            before = point.seats[-1].tail if point.seats else None
            if before is not None and (before.stratum, before.day) == (m[0], m[1]):
                first, fresh = before, False
                first.sums = first.sums + head
            else:
                first, fresh = Edge(m[0], m[1], head.copy()), True
            final = first if (m[0], m[1]) == (m[2], m[3]) else Edge(m[2], m[3], tail.copy())
            ending = np.concatenate([tail[1:2], tail[3 : 3 + p]])
            point.seats.append(Seat(part, first, final, m[0] == m[2], total, ending, fresh))
        for f, point in points.items():
            self._carry(point, self.recipes[f].p)
        told = {f: {s.part: s.carry for s in point.seats} for f, point in points.items()}

        def inside(part, f, c):
            p = c.x.shape[1]
            risk, at = _after(c, told[f][part], p), _interior(c)
            ties = tie_sums(risk[at, 0], c.sums[at, 2], np.rint(c.sums[at, 0]))
            gradient = -ties[:, 0] @ risk[at, 1:] + ties[:, 1] @ c.sums[at, 3 + p : 3 + 2 * p]
            hazard = c.sums[at, 0] / risk[at, 0]
            shares = [ties[c.first[at], 0].sum(), ties[c.last[at], 0].sum(), hazard[c.first[at]].sum(), hazard[c.last[at]].sum(), c.sums[at, 0].sum()]
            return np.concatenate([[-ties[:, 5].sum()], gradient, shares])

        found: dict[int, dict[int, np.ndarray]] = {}
        for part, f, m in self._numbers(betas, inside):
            p = self.recipes[f].p
            points[f].value += m[0]
            points[f].gradient = points[f].gradient + m[1 : 1 + p]
            found.setdefault(f, {})[part] = m[1 + p :]
        for f, point in points.items():
            self._expose(point, found[f])
        return points

    @staticmethod
    def _carry(point: Point, p: int) -> None:
        """Sums behind every partition, and the risk sets and ties of the border cells."""
        behind, stratum = np.zeros(1 + p), math.nan
        for seat in reversed(point.seats):
            seat.carry = behind if stratum == seat.tail.stratum else np.zeros(1 + p)
            if seat.tail is not seat.head:
                seat.tail.risk = seat.ending + seat.carry
            if seat.fresh:
                seat.head.risk = seat.total + (seat.carry if seat.single else 0.0)
            if seat.single and stratum == seat.head.stratum:
                behind = behind + seat.total
            else:
                behind, stratum = seat.total, seat.head.stratum
        edges = _edges(point)
        ties = tie_sums([e.risk[0] for e in edges], [e.sums[2] for e in edges], [np.rint(e.sums[0]) for e in edges])
        for edge, own in zip(edges, ties):
            edge.ties = own
            point.value -= own[5]
            point.gradient = point.gradient - own[0] * edge.risk[1:] + own[1] * edge.sums[3 + p : 3 + 2 * p]

    @staticmethod
    def _expose(point: Point, found: dict[int, np.ndarray]) -> None:
        """Exposure, baseline hazard and events that lie before every partition."""
        total, hazard, events, stratum = 0.0, 0.0, 0.0, math.nan
        for seat in point.seats:
            if seat.fresh:
                if seat.head.stratum != stratum:
                    total = hazard = 0.0
                total, hazard, events = total + seat.head.inverse, hazard + seat.head.hazard, events + seat.head.sums[0]
                seat.head.upto = events
            seat.base, seat.hazard_base, seat.events_base = total, hazard, events
            first, last, hazard_first, hazard_last, inner = found[seat.part]
            if seat.tail is not seat.head:
                total = (total + first if seat.single else last) + seat.tail.inverse
                hazard = (hazard + hazard_first if seat.single else hazard_last) + seat.tail.hazard
                events += inner + seat.tail.sums[0]
                seat.tail.upto = events
            stratum = seat.tail.stratum

    def information(self, points: dict[int, Point]) -> dict[int, np.ndarray]:
        """Second derivative (negative) of every fit: one pass, folded before it comes back."""
        told = {f: {s.part: s for s in point.seats} for f, point in points.items()}
        uppers = {f: np.triu_indices(self.recipes[f].p) for f in points}

        def task(part, f, c):
            p, seat = c.x.shape[1], told[f][part]
            risk, at = _after(c, seat.carry, p), _interior(c)
            ties = tie_sums(risk[at, 0], c.sums[at, 2], np.rint(c.sums[at, 0]))
            inverse, shared = np.zeros(len(c.day)), np.zeros(len(c.day))
            inverse[at], shared[at] = ties[:, 0], ties[:, 1]
            inverse[-1], shared[-1] = seat.tail.inverse, seat.tail.ties[1]
            inverse[0], shared[0] = seat.base, seat.head.ties[1]
            exposure = _running(inverse, c.stratum)
            found = (c.x.T * (c.weight * (exposure[c.cell] - c.event * shared[c.cell]))) @ c.x
            found -= _outer(risk[at, 1:], c.sums[at, 3 + p : 3 + 2 * p], ties)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([f], pa.int32()), pa.array([found[uppers[f]].tolist()], pa.list_(pa.float64()))],
                names=["part", "fit", "m"],
            )

        rows = self._run({f: p.beta for f, p in points.items()}, "part int, fit int, m array<double>", task)
        if self.layout.parts * sum(len(u[0]) for u in uppers.values()) > DIRECT:
            rows = rows.groupBy("fit", (F.col("part") % FAN_IN).alias("part")).applyInPandas(
                lambda pdf: pdf.iloc[:1].assign(m=[np.sum(np.stack(pdf["m"].to_numpy()), axis=0)]), "fit int, part int, m array<double>"
            )
        result = {}
        for f, point in points.items():
            p = self.recipes[f].p
            edges = _edges(point)
            ties = np.array([e.ties for e in edges])
            result[f] = -_outer(np.array([e.risk[1:] for e in edges]), np.array([e.sums[3 + p : 3 + 2 * p] for e in edges]), ties)
        for r in rows.collect():
            p, upper = self.recipes[r["fit"]].p, uppers[r["fit"]]
            part = np.zeros((p, p))
            part[upper] = r["m"]
            part.T[upper] = r["m"]
            result[r["fit"]] = result[r["fit"]] + part
        return result

    def cells(self, points: dict[int, Point]) -> DataFrame:
        """Rows (fit, stratum, t, events, risk, hazard, cumulative): Breslow's baseline by cell."""
        told = {f: {s.part: s for s in point.seats} for f, point in points.items()}
        names = ["fit", "stratum", "t", "events", "risk", "hazard", "cumulative"]

        def task(part, f, c):
            p, seat = c.x.shape[1], told[f][part]
            risk, events = _after(c, seat.carry, p)[:, 0], c.sums[:, 0].copy()
            for i, edge in ((-1, seat.tail), (0, seat.head)):
                risk[i], events[i] = edge.risk[0], edge.sums[0]
            hazard = np.where(events > 0, events / risk, 0.0)
            steps = hazard.copy()
            steps[0] = seat.hazard_base
            columns = [np.full(len(risk), f, np.int32), c.stratum, c.day, events, risk, hazard, _running(steps, c.stratum)]
            begin = 0 if seat.fresh else 1
            yield pa.RecordBatch.from_arrays([pa.array(v[begin:]) for v in columns], names=names)

        return self._run({f: p.beta for f, p in points.items()}, "fit int, " + ", ".join(f"{n} double" for n in names[1:]), task)

    def residual_sums(self, points: dict[int, Point]) -> dict[int, dict[str, np.ndarray]]:
        """Of the event cells: sums of ranked time and of what the covariates of the events leave over.

        A cell's residual is its events' covariates less their mean in the risk set; its rank is
        the middle rank of its tied events.  For fits of one stratum.
        """
        told = {f: {s.part: s for s in point.seats} for f, point in points.items()}

        def sums(events, rank, covariates, risk):
            left = covariates - events[:, None] * risk[:, 1:] / risk[:, :1]
            return np.concatenate([[events.sum(), events @ rank, events @ rank**2], left.sum(axis=0), rank @ left])

        def task(part, f, c):
            p, seat = c.x.shape[1], told[f][part]
            risk, at = _after(c, seat.carry, p), _interior(c)
            events = c.sums[at, 0]
            rank = seat.events_base + np.cumsum(events) - (events - 1) / 2
            return sums(events, rank, c.sums[at, 3 + 2 * p :], risk[at])

        result = {}
        for part, f, m in self._numbers({f: p.beta for f, p in points.items()}, task):
            result[f] = result.get(f, 0.0) + m
        for f, point in points.items():
            p = self.recipes[f].p
            edges = [e for e in _edges(point) if e.sums[0] > 0]
            if edges:
                events = np.array([e.sums[0] for e in edges])
                rank = np.array([e.upto for e in edges]) - (events - 1) / 2
                result[f] = result[f] + sums(events, rank, np.array([e.sums[3 + 2 * p :] for e in edges]), np.array([e.risk for e in edges]))
            m = result[f]
            result[f] = {"events": m[0], "rank": m[1], "rank2": m[2], "left": m[3 : 3 + p], "ranked": m[3 + p :]}
        return result


def _edges(point: Point) -> list[Edge]:
    """The border cells of a fit, each once."""
    return list({id(e): e for seat in point.seats for e in (seat.head, seat.tail)}.values())


def _outer(s1: np.ndarray, d1: np.ndarray, ties: np.ndarray) -> np.ndarray:
    cross = (s1.T * ties[:, 3]) @ d1
    return (s1.T * ties[:, 2]) @ s1 - cross - cross.T + (d1.T * ties[:, 4]) @ d1


@dataclass
class Optimum:
    """Where a fit ended: its point and information, or the error that stopped it."""

    point: Point | None = None
    information: np.ndarray | None = None
    notes: list[str] = field(default_factory=list)
    error: str | None = None

    def checked(self) -> Optimum:
        if self.error:
            raise IdentificationError(self.error)
        return self


def maximise(passes: Passes, ridge: float = 0.0) -> dict[int, Optimum]:
    """Maximise the partial likelihood of all fits of a layout, step by step together.

    A step is three passes for all fits that have not converged; fits that need a shorter step
    try again together.
    """
    active = passes.evaluate({f: np.zeros(r.p) for f, r in passes.recipes.items()})
    done = {f: Optimum(error="no usable rows") for f in passes.recipes if f not in active}

    def objective(at: Point) -> float:
        return at.value - 0.5 * at.rows * ridge * float(at.beta @ at.beta)

    for f in [f for f, p in active.items() if p.events < 2]:
        done[f] = Optimum(error=f"the hazard fit needs two events, found {int(active.pop(f).events)}")
    for _ in range(MAX_STEPS):
        if not active:
            break
        moves, information = {}, passes.information(active)
        for f, point in list(active.items()):
            information[f] = information[f] + point.rows * ridge * np.eye(len(point.beta))
            gradient = point.gradient - point.rows * ridge * point.beta
            try:
                move = np.linalg.solve(information[f], gradient)
            except np.linalg.LinAlgError:
                done[f] = Optimum(error="singular information matrix")
                del active[f]
                continue
            gain = float(gradient @ move) / 2
            if not math.isfinite(gain):
                done[f] = Optimum(error="the partial likelihood did not converge")
                del active[f]
            elif gain < TOLERANCE:
                done[f] = Optimum(active.pop(f), information[f])
            else:
                moves[f] = (move, 1.0)
        while moves:
            trials = passes.evaluate({f: active[f].beta + size * move for f, (move, size) in moves.items()})
            for f, (move, size) in list(moves.items()):
                point, trial = active[f], trials[f]
                if objective(trial) >= objective(point) - 1e-12 * abs(objective(point)):
                    del moves[f]
                    active[f] = trial
                    if np.max(np.abs(trial.beta)) > 50:
                        done[f] = Optimum(active.pop(f), information[f], ["CONVERGENCE: a scaled coefficient exceeds 50; separation is likely"])
                elif size / 2 < 1e-6:
                    del moves[f]
                    done[f] = Optimum(active.pop(f), information[f], ["CONVERGENCE: step halving reached its limit"])
                else:
                    moves[f] = (move, size / 2)
    for f, point in active.items():
        done[f] = Optimum(point, information[f], ["CONVERGENCE: the step limit was reached"])
    return done
