"""Exact concordance counts without comparing all pairs.

A pair counts when the event of one spell comes before the end of the other.  Scores are
numbered in their order and the numbers written in digits.  On each level, spells whose higher
digits agree form a group; within a group, sorted by day, an event meets the later spells by
their next digit: a smaller one is concordant, a larger one discordant, an equal one is left to
the next level.  So every pair is counted on the level where its scores part, and pairs of
equal scores on the last.

Groups are sorted by range, and a task counts the pairs of its own rows.  Pairs that reach over
tasks follow from two histograms of digits a task (events of its last group, spells of
its first), so neither groups nor days are bounded, and only these come to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.common import col
from tidemark.session import settle

BASE = 256              # values of a digit
CELLS_AT_ONCE = 8_192   # (group, day, event) cells whose histograms are held
LEAST_ROWS = 20_000     # a task is not given fewer rows than this
MOST_ROWS = 2_000_000   # nor many more than this, whatever the shuffle width

BORDERS = "part int, first_score double, last_score double, many long"
FOUND = (
    "part int, first_stratum string, first_node long, last_stratum string, last_node long, "
    "concordant double, discordant double, tied double, spells array<double>, events array<double>"
)


def parts_for(df: DataFrame, rows: int) -> int:
    """Tasks for a sorted pass: the session's shuffle width, fewer for small tables, more for large ones."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(width, -(-rows // LEAST_ROWS)), -(-rows // MOST_ROWS))


def numbered_scores(merged: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Add ``rank``: the number of a row's score among the distinct ones; and how many there are.

    Rows of one score may lie in several tasks; a task that goes on with the score of the one
    before it does not count it again.
    """
    ordered = settle(merged.repartitionByRange(parts_for(merged, rows), "score", "day", "event").sortWithinPartitions("score"))

    def borders(batches):
        first = last = None
        many = 0
        for batch in batches:
            if len(batch):
                score = batch["score"].to_numpy()
                first = score[0] if first is None else first
                many += int((np.diff(score) != 0).sum()) + (last is None or score[0] != last)
                last = score[-1]
        if first is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "first_score": [first], "last_score": [last], "many": [many]})

    before, total, last = {}, 0, None
    for r in sorted(ordered.select("score").mapInPandas(borders, BORDERS).collect(), key=lambda r: r["part"]):
        total -= r["first_score"] == last
        before[r["part"]] = total
        total, last = total + r["many"], r["last_score"]

    def number(batches):
        rank, last = before.get(TaskContext.get().partitionId(), 0) - 1, None
        for batch in batches:
            if len(batch):
                score = batch["score"].to_numpy()
                fresh = np.concatenate([[last is None or score[0] != last], np.diff(score) != 0])
                ranks = rank + np.cumsum(fresh)
                rank, last = int(ranks[-1]), score[-1]
                yield batch.assign(rank=ranks)

    return ordered.mapInPandas(number, ordered.withColumn("rank", F.lit(0).cast("long")).schema), total


def count_pairs(group: np.ndarray, cell: np.ndarray, digit: np.ndarray, event: np.ndarray, count: np.ndarray, base: int, at_once: int):
    """Pairs among rows sorted by (group, cell): events of a cell against the cells behind it.

    Returns concordant, discordant and equal pairs, and the histograms of the first group's
    spells and of the last group's events.
    """
    found = np.zeros(3)
    spells, events = np.zeros(base), np.zeros(base)
    first, last = group == group[0], group == group[-1]
    np.add.at(spells, digit[first], count[first])
    np.add.at(events, digit[last & (event == 1)], count[last & (event == 1)])
    behind, stratum = np.zeros(base), group[-1]
    end = len(cell)
    while end > 0:
        start = int(np.searchsorted(cell, max(cell[end - 1] - at_once + 1, 0)))
        own = slice(start, end)
        at = cell[own] - cell[start]
        table = np.zeros((int(at[-1]) + 1, base))
        np.add.at(table, (at, digit[own]), count[own])
        begins = np.flatnonzero(np.diff(at, prepend=-1))
        groups, dies = group[own][begins], event[own][begins] == 1
        if stratum != groups[-1]:
            behind = np.zeros(base)
        later = np.cumsum(table[::-1], axis=0)[::-1]
        ends = np.flatnonzero(np.concatenate([groups[1:] != groups[:-1], [True]]))
        after = np.vstack([later, np.zeros((1, base))])[ends + 1][np.searchsorted(ends, np.arange(len(groups)))]
        carried = later[0] - after[0] + (behind if len(ends) == 1 else 0.0)
        later = later - after - table
        later[groups == groups[-1]] += behind
        own_events, outlast = table[dies], later[dies]
        below = np.cumsum(outlast, axis=1) - outlast
        found += [
            (own_events * below).sum(), (own_events * (outlast.sum(axis=1, keepdims=True) - below - outlast)).sum(), (own_events * outlast).sum(),
        ]
        behind, stratum, end = carried, groups[0], start
    return found, spells, events


def _task(base: int, at_once: int):
    def run(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        changes = lambda names: np.cumsum(np.any([rows[n].ne(rows[n].shift()).to_numpy() for n in names], axis=0)) - 1
        group, cell = changes(["stratum", "node"]), changes(["stratum", "node", "day", "event"])
        found, spells, events = count_pairs(group, cell, rows["digit"].to_numpy(), rows["event"].to_numpy(), rows["count"].to_numpy(dtype="float64"), base, at_once)
        ends = rows.iloc[[0, -1]]
        yield pd.DataFrame(
            {
                "part": [TaskContext.get().partitionId()],
                "first_stratum": ends["stratum"].iloc[:1].to_list(), "first_node": ends["node"].iloc[:1].to_list(),
                "last_stratum": ends["stratum"].iloc[1:].to_list(), "last_node": ends["node"].iloc[1:].to_list(),
                "concordant": [found[0]], "discordant": [found[1]], "tied": [found[2]], "spells": [spells.tolist()], "events": [events.tolist()],
            }
        )

    return run


def level_pairs(ranked: DataFrame, above: int, rows: int) -> np.ndarray:
    """Concordant, discordant and equal pairs of one level; ``above`` is BASE to its place."""
    digits = ranked.select(
        "stratum", F.expr(f"rank div {above * BASE}L").alias("node"), F.expr(f"cast(rank div {above}L % {BASE} as int)").alias("digit"),
        "day", "event", "count",
    )
    cells = digits.groupBy("stratum", "node", "day", "event", "digit").agg(F.sum("count").alias("count"))
    order = ["stratum", "node", "day", F.desc("event")]
    sorted_ = cells.repartitionByRange(parts_for(ranked, rows), *order).sortWithinPartitions(*order)
    total, behind, group = np.zeros(3), np.zeros(BASE), None
    for r in sorted(sorted_.mapInPandas(_task(BASE, CELLS_AT_ONCE), FOUND).collect(), key=lambda r: -r["part"]):
        first, last = (r["first_stratum"], r["first_node"]), (r["last_stratum"], r["last_node"])
        total += [r["concordant"], r["discordant"], r["tied"]]
        events = np.array(r["events"])
        if last != group:
            behind = np.zeros(BASE)
        below = np.cumsum(behind) - behind
        total += [events @ below, events @ (behind.sum() - below - behind), events @ behind]
        behind, group = np.array(r["spells"]) + (behind if first == last else 0.0), first
    return total


def concordance(df: DataFrame, score: str | Column, duration: str, event: str, strata: str | None = None) -> dict[str, float]:
    """Counts of comparable pairs and their concordant share, ties counted half.

    A higher score means a shorter expected spell.  With ``strata`` only spells of one level
    are compared; a null level is a level.
    """
    rows = df.select(
        (F.lit("") if strata is None else F.coalesce(F.col(strata).cast("string"), F.lit("\x00"))).alias("stratum"),
        (col(score).cast("double") + F.lit(0.0)).alias("score"),
        col(duration).cast("double").alias("day"),
        col(event).cast("int").alias("event"),
    ).where(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("day") > 0) & F.col("event").isin(0, 1))
    merged = settle(rows.groupBy("stratum", "score", "day", "event").agg(F.count("*").alias("count")))
    many = merged.count()
    ranked, scores = numbered_scores(merged, many)
    levels = max(1, math.ceil(math.log(max(scores, 2)) / math.log(BASE) - 1e-12))
    found = np.zeros(2)
    for level in range(levels):
        *parted, equal = level_pairs(ranked, BASE ** (levels - 1 - level), many)
        found += parted
    (c, d), t = found.tolist(), float(equal)
    pairs = c + d + t
    share = (c + 0.5 * t) / pairs if pairs else float("nan")
    return {"concordant": c, "discordant": d, "tied": t, "pairs": pairs, "concordance": share}
