import hashlib
import random
import re
from collections import Counter, defaultdict

import odd
import pytest

from tidemark.llm import exact_dedup, suffix_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_equals_grouping(spark):
    rows = odd.rows(3, 80) + [(300 + i, "often  seen\ttext", "s") for i in range(60)]
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[normal(t)].append(d)
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    for most in (2, 1024):  # with few counters most digests take the shuffled way
        got = exact_dedup.exact_dedup(odd.frame(spark, rows), most=most).collect()
        assert Counter(tuple(r) for r in got) == want


def test_keep_first_leaves_one_row_of_each_text(spark):
    rows = odd.rows(3, 60, null_id=False)
    frame = odd.frame(spark, rows)
    kept = exact_dedup.keep_first(frame)
    assert kept.columns == frame.columns
    found = [(r["doc_id"], normal(r["text"])) for r in kept.collect()]
    assert len({t for _, t in found}) == len(found) == len({normal(t) for _, t, _ in rows})
    first = {}
    for d, t, _ in rows:
        first[normal(t)] = min(d, first.get(normal(t), d))
    assert {t: d for d, t in found} == first


def test_keep_first_tells_texts_of_one_id_apart(spark):
    rows = [(None, "no id a", "s"), (None, "no id b", "s"), (None, "no id b", "s"), (7, "first", "s"), (7, "second", "s"), (8, "twice", "s"), (8, "twice", "s"), (9, "first", "s")]
    got = exact_dedup.keep_first(odd.frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(None, "no id a"), (None, "no id b"), (7, "first"), (7, "second"), (8, "twice")])


def test_frequent_values_are_found():
    values = ["a"] * 400 + [str(i) for i in range(500)] + ["b"] * 200
    counters = {}
    exact_dedup.misra_gries(values, counters, 9)
    assert {"a", "b"} <= set(counters) and len(counters) <= 9
    assert 400 - len(values) / 10 <= counters["a"] <= 400


def brute(rows, length=50):
    own = [(d, (t or "").encode()) for d, t, _ in rows if d is not None]
    first = {}
    for d, b in own:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(d, first.get(s, d))
    out = Counter()
    for d, b in own:
        lost = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                lost[i : i + length] = b"\1" * length
        kept = bytes(x for x, gone in zip(b, lost) if not gone)
        spans = sum(1 for i, x in enumerate(lost) if x and (i == 0 or not lost[i - 1]))
        out[(d, len(b), sum(lost), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_equals_brute_force(spark, seed):
    rows = odd.rows(seed, 60) + [(400 + i, "lead " * i + "a passage of more than fifty bytes that several documents share" + "!" * i, "s") for i in range(6)]
    rows += [(500, "ab" * 100, "s"), (501, "ba" * 100, "s"), (502, "a" * 49, "s"), (503, "a" * 50, "s"), (504, "a" * 400, "s")]
    got = suffix_dedup.suffix_dedup(odd.frame(spark, rows)).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute(rows)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


def test_a_hash_that_lies_is_replaced(monkeypatch):
    """With an even base prefix hashes see the last bytes only; the bytes decide."""
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "BASE", 1 << 32)
    texts = np.frombuffer(b"x" * 40 + b"0123456789" + b"y" * 40 + b"0123456789", np.uint8).reshape(2, 50)
    got = suffix_dedup.least_documents(texts, np.array([1, 1]), np.array([0, 0]), np.array([0, 0]), np.array([3, 8]), 50)
    assert got.tolist() == [3, 8]


def test_empty_tables(spark):
    assert exact_dedup.exact_dedup(odd.empty(spark)).count() == 0
    assert exact_dedup.keep_first(odd.empty(spark)).count() == 0
    assert suffix_dedup.suffix_dedup(odd.empty(spark)).count() == 0


def test_a_passage_at_every_border_of_a_long_text(spark):
    """A repetitive passage has many equal anchors; which one counts must not depend on its place."""
    rng = random.Random(5)
    passage = "ab ab ab ab ab " * 4
    text = "".join(rng.choice("cdefghijklmnop ") for _ in range(3 << 20))
    places = [p + shift for p in (1 << 16, 1 << 18, 1 << 19, 1 << 20, 3 << 19, 1 << 21, 5 << 19) for shift in (-59, -31, -1)][::2]
    for p in places:
        text = text[:p] + passage + text[p + len(passage) :]
    rows = [(1, f"first {passage}", "s"), (2, text, "s"), (3, "x" * 80 + passage, "s")]
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(odd.frame(spark, rows)).collect()}
    earlier = {rows[0][1][i : i + 50] for i in range(len(rows[0][1]) - 49)}
    for doc, body, _ in rows[1:]:
        lost = set()
        for i in range(len(body) - 49):
            if body[i : i + 50] in earlier:
                lost.update(range(i, i + 50))
        if doc == 2:
            earlier |= {body[i : i + 50] for i in range(len(body) - 49)}
        assert got[doc]["n_removed"] == len(lost), doc
    assert got[2]["n_removed"] > 600 and got[1]["n_removed"] == 0


def test_one_passage_in_very_many_documents(spark):
    """Copies in a batch are settled there; only the least one of a batch travels."""
    passage = "a passage of well over fifty bytes that very many documents share, word for word"
    rng = random.Random(2)
    rows = [(i, f"{i % 977} own words {i} " + (passage if i % 3 else f"{i} nothing {i * 7919} shared") + f" tail {rng.randrange(10**6)}", "s") for i in range(30_000)]
    got = suffix_dedup.suffix_dedup(odd.frame(spark, rows), with_kept=False)
    found = got.groupBy("n_spans").agg({"n_removed": "min", "doc_id": "count"}).collect()
    by = {r["n_spans"]: r for r in found}
    assert by[0]["count(doc_id)"] == 10_001 and by[1]["count(doc_id)"] == 19_999
    assert by[1]["min(n_removed)"] >= len(passage)
