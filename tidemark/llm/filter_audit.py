"""Interaction of filters: what every order of them removes, from one Gray-code walk.

A document is a mask of the filters it fails; documents of one part and mask are one cell.  The
subsets of filters are walked in Gray code, so one filter is toggled at a time: every cell
whose mask holds it counts one active failure more or less, and the running survivors change by
the cells whose counter leaves or reaches zero.  The survivors of all subsets (32 states of five
filters) are kept, and a step of an order is the difference of two of them.

Documents meet only as rows of (id, part, digest, mask); texts are judged where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import WORD, text_or_empty

PARTS = 256  # parts whose orders are written out at once
REPEAT = "E"


def text_filters(text_col: str = "text") -> dict[str, Column]:
    """Failure conditions on a text: few words, few distinct words, capitals, odd marks."""
    text = text_or_empty(text_col)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    # The words stand in an array of one, so they are found once for both conditions.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": counts["all"] < 50,
        "B": counts["distinct"] * 100 < counts["all"] * 65,
        "C": capitals * 100 > F.char_length(text) * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def gray_walk(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters; ``cells`` and the result are (part, mask, measure)."""
    many = cells.shape[1]
    masks = np.arange(many)
    failures = np.zeros(many, np.int64)
    running = cells.sum(axis=1)
    states = np.empty_like(cells)
    states[:, 0] = running
    for step in range(1, many):
        toggled = step & -step
        subset = step ^ (step >> 1)
        hit = (masks & toggled) > 0
        if subset & toggled:
            gone = hit & (failures == 0)
            failures[hit] += 1
            running = running - cells[:, gone].sum(axis=1)
        else:
            failures[hit] -= 1
            back = hit & (failures == 0)
            running = running + cells[:, back].sum(axis=1)
        states[:, subset] = running
    return states


def _orders(names: list[str]):
    """Every order of the filters, its steps, the subset before each step and the step's filter."""
    bits = {name: 1 << i for i, name in enumerate(names)}
    order, step, before, own = [], [], [], []
    for found in permutations(names):
        subset = 0
        for i, name in enumerate(found):
            order.append("".join(found))
            step.append(i + 1)
            before.append(subset)
            own.append(bits[name])
            subset |= bits[name]
    return order, np.array(step, np.int32), np.array(before), np.array(own)


def _differences(names: list[str]):
    """Rows (part, cells) to a row per part, order and step."""
    order, step, before, own = _orders(names)
    full = (1 << len(names)) - 1
    kind = np.log2(own).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PARTS):
                some = batch.slice(lo, PARTS)
                cells = np.zeros((some.num_rows, full + 1, 3), np.int64)
                for i, found in enumerate(some.column(1).to_pylist()):
                    for c in found:
                        cells[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                states = gray_walk(cells)
                lost = states[:, before] - states[:, before | own]
                removed = lost[..., 0]
                shapley = np.zeros((some.num_rows, len(names)), np.int64)
                np.add.at(shapley, (slice(None), kind), removed)
                columns = [
                    states[:, before | own, 0], removed, states[:, [0], 0] - states[:, own, 0] - removed,
                    states[:, full & ~own, 0] - states[:, [full], 0], lost[..., 1], lost[..., 2], shapley[:, kind],
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), len(order)))),
                        pa.array(order * some.num_rows, pa.string()), pa.array(np.tile(step, some.num_rows), pa.int32()),
                        *[pa.array(np.ascontiguousarray(c).ravel(), pa.int64()) for c in columns],
                    ],
                    names=RESULT,
                )

    return run


RESULT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in RESULT[3:])


def mask_cells(
    df: DataFrame, labels: DataFrame, filters: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents by the filters they fail, repeats as the last bit."""
    mask = F.lit(0)
    for i, condition in enumerate(filters.values()):
        mask = mask + F.when(condition, F.lit(1 << i)).otherwise(F.lit(0))
    judged = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)).alias("digest"), mask.alias("mask"),
    ).withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    flags = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id"), F.lit(0).cast("long").alias("__salt")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    # The salt spreads rows without an id, which meet no label.
    joined = judged.join(flags, (judged["doc_id"] == flags["__id"]) & (judged["salt"] == flags["__salt"]), "left")
    counts = ["n", "good", "toxic"]
    # Rows of one id and text are added up where the join leaves them.
    once = joined.groupBy("doc_id", "salt", "digest", "part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    has_id = F.col("doc_id").isNotNull()
    texts = once.groupBy("digest", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in counts],
        *[F.sum(F.when(~has_id, F.col(c)).otherwise(0)).alias(f"{c}_null") for c in counts],
        F.min(F.when(has_id, F.struct("doc_id", *counts))).alias("head"),
    ).withColumn("least", F.min("head.doc_id").over(Window.partitionBy("digest")))
    # Of a text's rows those of its least id, and those without one, do not repeat it.
    first = F.col("head.doc_id") == F.col("least")
    fresh = {c: F.col(f"{c}_null") + F.when(first, F.col(f"head.{c}")).otherwise(0) for c in counts}
    again = (F.col("mask") + F.lit(1 << len(filters))).alias("mask")
    split = texts.select("part", "mask", *[v.alias(c) for c, v in fresh.items()]).union(
        texts.select("part", again, *[(F.col(c) - v).alias(c) for c, v in fresh.items()])
    )
    return split.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in counts]).filter("n > 0")


def filter_audit(
    df: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, repeat: str = REPEAT,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """What each step of every order of the filters removes, per part.

    ``filters`` maps one-letter names to failure conditions on a row of ``df`` (null: does not
    fail); ``repeat`` names one more, which a row fails whose text equals that of any row of a
    smaller id.  Returns a row per value of ``source_col``, order and step: ``part``,
    ``filter_order``, ``step``, ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost``, ``toxic_lost``, ``shapley`` (removed by the filter over all orders).

    A null text counts as empty, a null source as the part ''.  Rows with a null id repeat
    nothing, are repeated by nothing and have no labels.  Every repeated row is a document of
    its own; rows of the least id do not repeat each other.  Of several labels of one id any
    1 counts.  An empty table gives an empty result.  Other columns are not read.
    """
    filters = text_filters(text_col) if filters is None else filters
    names = [*filters, repeat]
    cells = mask_cells(df, labels, filters, id_col, text_col, source_col)
    # A part has a cell per subset of filters at most.
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(_differences(names), SCHEMA)


SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flags AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN words.doc_id > min(words.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM words LEFT JOIN flags ON flags.doc_id = words.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
  JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
found AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (fails = '' OR translate(fails, before || f, '') = fails), 0) AS kept,
    coalesce(sum(n) FILTER (contains(fails, f) AND translate(fails, before, '') = fails), 0) AS removed,
    coalesce(sum(n) FILTER (contains(fails, f) AND translate(fails, before, '') <> fails), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (contains(fails, f) AND translate(fails, before, '') = fails), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (contains(fails, f) AND translate(fails, before, '') = fails), 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM found
"""
