import re
from collections import Counter, defaultdict

import odd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, weights=(1, 2, 3), most=3):
    """Targets by handing the excess out again until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = float(sum(sizes.values())), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        level = rest / sum(weight[s] for s in free) if free else 0.0
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 900, "b": 5, "c": 1, None: 40}, {"a": 0, "b": 7}, {"é": 50, "z": 1, "Z": 0, None: 3}])
def test_targets(spark, sizes):
    sized = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
    want = shares(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation_is_a_bijection(spark, n):
    rows = spark.range(n).select("id", mixing.permuted("id", f"{n}L", "5").alias("p")).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    assert n < 1000 or sum(r["p"] == r["id"] for r in rows) < 20


def sample():
    rows = odd.rows(6, 60) + [(1000 + i, " ".join(f"w{i}_{j}" for j in range(200 + i)), f"s{i % 3}") for i in range(60)]
    return rows


def test_mix(spark):
    rows = sample()
    frame = odd.frame(spark, rows)
    got = mixing.mix(frame).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len(WORD.findall(t or ""))) for d, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = shares(sizes), defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[(r["source_size"], round(r["target"], 6))] += r["taken"]
    for s, target in want.items():
        assert abs(taken[(sizes[s], round(target, 6))] - target) <= 3 * mixing.BLOCK
    again = mixing.mix(frame.repartition(7, F.rand(3))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_shards_draw_every_quota(spark):
    sized = spark.createDataFrame([(i, f"s{i % 3}", 5000) for i in range(9)], "doc_id long, source string, size long")
    sources = mixing.targets(sized)
    slots = mixing.slots(sources, True, 3, shard=50)
    counts = {r["sid"]: r["n"] for r in slots.groupBy("sid").agg(F.count("*").alias("n")).collect()}
    assert counts == {r["sid"]: r["quota"] for r in sources.collect()}
    per = slots.groupBy("shard", "sid").count().groupBy("sid").agg(F.stddev("count").alias("s")).collect()
    assert all(1 < r["s"] < 8 for r in per)  # drawn, not dealt in turn
    used = slots.groupBy("sid", "block").count().groupBy("sid").agg(F.max("count") - F.min("count")).collect()
    assert all(r[1] <= 1 for r in used)


def test_documents_of_the_mix(spark):
    rows = [r for r in sample() if r[0] is not None]
    seen, unique = set(), []
    for r in rows:
        if r[0] not in seen:
            seen.add(r[0])
            unique.append(r)
    frame = odd.frame(spark, unique)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(frame).collect()}
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    found = defaultdict(int)
    texts = {d: WORD.findall(t or "") for d, t, _ in unique}
    for r in mixed.collect():
        words = WORD.findall(r["text"])
        found[r["doc_id"]] += len(words)
        assert set(words) <= set(texts[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    assert dict(found) == {d: n for d, n in taken.items() if n}


def test_empty_tables(spark):
    assert mixing.mix(odd.empty(spark)).count() == 0
    assert mixing.mixed_documents(odd.empty(spark)).count() == 0
    blank = odd.frame(spark, [(1, None, None), (2, "  ", "a")])
    assert [(r["doc_id"], r["taken"], r["target"]) for r in mixing.mix(blank).orderBy("doc_id").collect()] == [(1, 0, 0.0), (2, 0, 0.0)]
