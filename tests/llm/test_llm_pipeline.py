import hashlib
import re
from collections import Counter

import corpus_pipeline
import odd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

from test_llm_dedup import normal
from test_llm_ngram import plain
from test_llm_text import labelled

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = labelled(spark, 200)
    rows = [(d, t, "en", f"s{d % 3}", len(t)) for d, t, _ in docs]
    rows += [(d + 2000, t, None, s, 0) for d, t, s in odd.rows(8, 60, null_id=False)[:-2]]
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages_take_effect_one_after_another(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns

    def ids(frame):
        return {r["doc_id"] for r in frame.select("doc_id").collect()}

    before, after = seen["toxicity"]
    bad = {d for d in range(200) if d % 4 == 0}
    gone = ids(before) - ids(after)
    assert gone <= bad and len(gone) >= len(bad) - 2
    before, after = seen["exact dedup"]
    least = {}
    for r in before.collect():
        least[normal(r["text"])] = min(r["doc_id"], least.get(normal(r["text"]), r["doc_id"]))
    assert ids(after) == set(least.values()) and after.count() == len(least)
    before, after = seen["n-gram Jaccard join"]
    groups = plain([(r["doc_id"], r["text"], None) for r in before.collect()])
    assert ids(after) == {d for d, _, c in groups if d == c}
    before, after = seen["mixing sources to target weights"]
    words = lambda f: f.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(words(before) - words(after)) <= 64 * 12
    before, after = seen["SentencePiece encoding and decoding"]
    want = sorted((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in before.collect())
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in after.collect()) == want
    assert after.filter("not lossless").count() == 0
    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, run.collect())) == sorted(map(str, after.collect()))


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0


def odd_documents():
    """Null ids, several texts under one id, repeated rows, null and blank texts, copies and near copies."""
    rows = [(i, t, s) for i, t, s in odd.rows(9, 30)]
    base = " ".join(f"w{i}" for i in range(60))
    rows += [(500, "one text of an id", "s1"), (500, "another text of that id, quite different", "s1"), (500, "one text of an id", "s1")]
    rows += [(None, base, "s2"), (None, base + " more", None), (None, "nothing like the others at all", "s2"), (501, base + " end", "s2"), (502, base, None)]
    rows += [(None, None, None), (503, None, "s1"), (503, "", "s1"), (503, "  ", "s1")]
    return rows


def key(r):
    return (r["doc_id"], r["text"], r["source"])


def test_every_stage_with_odd_rows(spark, folder):
    frame = odd.frame(spark, odd_documents())
    rows = [key(r) for r in frame.collect()]
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, frame, folder)
    assert clean.columns == frame.columns and sorted(map(str, map(key, clean.collect()))) == sorted(map(str, rows))

    once = stages["exact dedup"](spark, frame, folder)
    least = {}
    for d, t, _ in rows:
        best = least.get(normal(t), (True, None))
        least[normal(t)] = min(best, (d is None, d), key=lambda b: (b[0], b[1] or 0)) if normal(t) in least else (d is None, d)
    kept = [key(r) for r in once.collect()]
    assert once.columns == frame.columns
    assert {(d, normal(t)) for d, t, _ in kept} == {(d, t) for t, (_, d) in least.items()}
    assert len(kept) == len({(d, t) for d, t, _ in kept if t is not None}) + sum(t is None for _, t, _ in kept)

    near = stages["n-gram Jaccard join"](spark, frame, folder)
    groups = plain([(i, t, s) for i, (_, t, s) in enumerate(rows)])
    want = {}
    for i, _, c in groups:
        want.setdefault(c, []).append(rows[i])
    least = sorted(str(min(((d is None, d or 0) for d, _, _ in g))) for g in want.values())
    assert near.columns == frame.columns
    assert sorted(str((r["doc_id"] is None, r["doc_id"] or 0)) for r in near.collect()) == least

    mixed = stages["mixing sources to target weights"](spark, frame, folder)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    found, taken = Counter(), Counter()
    for r in mixed.collect():
        found[r["doc_id"]] += words(r["text"])
    for r in mixing.mix(frame).collect():
        taken[r["doc_id"]] += r["taken"]
    assert mixed.columns == frame.columns and {d: n for d, n in taken.items() if n} == dict(found)

    last = stages["SentencePiece encoding and decoding"](spark, frame, folder)
    want = Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in rows)
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in last.collect()) == want


def test_names():
    assert re.fullmatch(r"\w[\w -]+", corpus_pipeline.STAGES[0][0]) and len(corpus_pipeline.STAGES) == 5
