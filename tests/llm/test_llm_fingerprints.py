import hashlib
import random
from collections import Counter

import odd

from tidemark.llm import fingerprints


def test_likeness_and_edits(spark):
    rows = odd.rows(3, 80)
    got = fingerprints.fingerprints(odd.frame(spark, rows)).collect()
    order = sorted((d, t or "") for d, t, _ in rows if d is not None)
    edits = []
    for i, (d, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edits.append((d, text, text[: len(text) - half] + after[:half], after))
    want = Counter((d, len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, e, _ in edits)
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    # What peeling recovers is the plain overlap of the digests.
    frame = spark.createDataFrame(edits, "doc_id long, text string, edited string, after string")
    for column in ("text", "edited", "after"):
        frame = fingerprints.digests(frame, column, f"{column}_d")
    near = {}
    for r in frame.collect():
        sets = [set(r[f"{c}_d"]) for c in ("text", "edited", "after")]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        near[(r["doc_id"], hashlib.sha256(r["edited"].encode()).hexdigest())] = (like(sets[0], sets[1]), like(sets[0], sets[2]))
    for r in got:
        e, n = near[(r["doc_id"], r["edited_sha256"])]
        assert abs(r["near_edited"] - e) < 1e-9 and abs(r["near_next"] - n) < 1e-9
    prints = {}
    for r in got:
        prints.setdefault(r["doc_id"], r["fingerprint"])
    texts = {}
    for d, t in order:
        texts.setdefault(t, set()).add(prints[d])
    assert all(len(p) == 1 for p in texts.values())


def test_larger_sketches_peel_what_small_ones_cannot(spark):
    keys = spark.range(300).selectExpr("id % 3 as g", "id & 1099511627775L | shiftleft(xxhash64(id & 1099511627775L), 40) as k")
    sets = {r["g"]: r["k"] for r in keys.groupBy("g").agg({"k": "collect_list"}).toDF("g", "k").collect()}
    pairs = spark.createDataFrame([(1, sets[0], sets[1]), (2, sets[0], sets[0]), (3, sets[0][:50], sets[0]), (4, [], sets[2]), (5, [], [])], "seat int, one array<long>, other array<long>")
    got = {r["seat"]: r["likeness"] for r in fingerprints.compared(pairs, 8).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 0.5, 4: 0.0, 5: 1.0}


def test_edges(spark):
    assert fingerprints.fingerprints(odd.empty(spark)).count() == 0
    one = fingerprints.fingerprints(odd.frame(spark, [(4, "only one text here", "s")])).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 18
    wide = odd.frame(spark, [(-(2**62), "a b c", "s"), (2**62, "d e f", "s"), (0, "g", "s")])
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprints(wide).collect()}
    assert got[-(2**62)] == hashlib.sha256(b"a bg").hexdigest()
    assert got[2**62] == hashlib.sha256(b"d ea ").hexdigest()


def test_no_python_on_the_path(spark):
    plan = fingerprints.fingerprints(odd.frame(spark, odd.rows(1, 20)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_few_words_and_texts_without_blanks_keep_their_first_half(spark):
    rng = random.Random(5)
    texts = [
        "word " * 3_000, "\n".join(["la"] * 2_000), "\t".join(f"w{i}" for i in range(900)), "a b " * 60,
        "".join(chr(0x4E00 + rng.randrange(2_000)) for _ in range(3_000)), "x" * 5_000, "ab" * 150,
        " ".join("".join(rng.choice("acgt") for _ in range(17)) for _ in range(200)),
    ]
    rows = [(2 * i, t, "s") for i, t in enumerate(texts)] + [
        (2 * i + 1, " ".join(f"other{i}_{j}" for j in range(3_000)), "s") for i in range(len(texts))
    ]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(odd.frame(spark, rows)).collect()}
    assert all(0 < got[2 * i]["near_edited"] < 1 for i in range(len(texts)))
    # In a text without blanks an insertion at its start leaves most paragraphs as they were.
    frame = spark.createDataFrame([(texts[4], "新しい" + texts[4])], "a string, b string")
    pair = fingerprints.digests(fingerprints.digests(frame, "a", "x"), "b", "y").first()
    assert 2 * len(set(pair["x"]) & set(pair["y"])) > len(set(pair["x"]) | set(pair["y"]))


def test_buckets_are_even_whatever_the_ids(spark):
    for ids in ([2**62 + i for i in range(1_000)] + [-(2**62)], [i * i * i for i in range(1_000)]):
        docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
        rows = fingerprints._with_next(docs).collect()
        after = dict(zip(sorted(ids), sorted(ids)[1:] + [min(ids)]))
        assert {r["doc_id"]: r["next_text"] for r in rows} == {i: f"text {after[i]}" for i in ids}
        assert max(Counter(r["bucket"] for r in rows).values()) < 300
