import random
import re

import numpy as np
import odd
import pyarrow as pa
import pytest

from tidemark.llm import ngram_join
from tidemark.llm.common import mix64, seeded, utf8
from tidemark.llm.components import components
from tidemark.llm.shingles import Sets, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < width else frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def plain(rows):
    sets = {d: shingles(t) for d, t, _ in rows if d is not None}
    head = {d: d for d in sets}

    def find(d):
        while head[d] != d:
            d = head[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    return {(d, len(s), find(d)) for d, s in sets.items()}


def test_join_equals_all_pairs(spark):
    rows = odd.rows(2, 100)
    got = ngram_join.ngram_join(odd.frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert {tuple(r) for r in got} == plain(rows) and len(got) == len(plain(rows))


def test_family_beyond_the_first_stars(spark):
    """A chain of copies: each linked to the next, the ends far apart, and groups with outsiders."""
    rng = random.Random(4)
    words, rows = [f"w{i}" for i in range(60)], []
    for i in range(60):
        rows.append((i * 3, " ".join(words), "s"))
        words[rng.randrange(60)] = f"n{i}"
    rows += [(1000 + i, " ".join(words[:30] + [f"z{i}_{j}" for j in range(30)]), "s") for i in range(20)]
    rng.shuffle(rows)
    got = ngram_join.ngram_join(odd.frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert {tuple(r) for r in got} == plain(rows)


def test_every_link_is_counted(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = odd.rows(2, 60)
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(200)] = f"n{i}"
        rows += [(1000 + 3 * i, " ".join(words), "s")] + [(1001 + 3 * i, " ".join(words), "s")] * (i % 3)
    rng.shuffle(rows)
    sets = {d: shingles(t) for d, t, _ in rows if d is not None}
    want = dict.fromkeys(sets, 0)
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            want[a] += a != b and both > 0 and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.ngram_join(odd.frame(spark, rows)).collect()}
    assert got == want


def test_empty_table(spark):
    assert ngram_join.ngram_join(odd.empty(spark)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 4, 6, 9, 15, 24, 40, 90, 200, 700])
def test_linked_sets_share_a_signature(size):
    rng = np.random.default_rng(size)
    common = rng.random(ngram_join.SLOTS) < 0.3
    for _ in range(60):
        pool = np.unique(mix64(rng.integers(0, 2**62, 3 * size + 8).astype(np.uint64)))
        rng.shuffle(pool)
        a = pool[:size]
        for drop in range(size + 1):
            add = int(rng.integers(0, size // 3 + 2))
            b = np.concatenate([a[drop:], pool[size : size + add]])
            both = size - drop
            if not len(b) or 100 * both < 75 * (size + add):
                break
            sets = Sets(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, size, size + len(b)]))
            sig, row = ngram_join.signatures(sets, 75, 100, None, common)
            assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())


def test_parity_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for size in (1, 5, 60, 400):
        a = np.unique(rng.integers(0, 2**62, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], rng.integers(0, 2**62, size).astype(np.uint64)]))
        x, y = (np.frombuffer(ngram_join._parity(s), np.uint8) for s in (a, b))
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_shingles_by_hash_count_like_shingles_by_text():
    texts = [t for _, t, _ in odd.rows(5, 60)]
    data, offsets = utf8(pa.array(texts, pa.string()))
    assert shingle_sets(data, offsets).sizes.tolist() == [len(shingles(t)) for t in texts]


def test_components_of_a_long_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, 5), (9, 3), (3, 9), (3, 1)]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = {i: 100 for i in range(100, 141)} | {9: 1, 3: 1, 1: 1}
    assert {r["node"]: r["component"] for r in got} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_seeded_words_differ():
    assert len(set(seeded(256, 1).tolist())) == 256
