import hashlib
import random
import zlib
from collections import Counter

import odd
import pytest

from tidemark.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root of a list of digests, and per node the siblings (before, after) level by level."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for p, i in zip(paths, at):
            run = runs[i // 16]
            p.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        at = [i // 16 for i in at]
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], paths


def plain(rows):
    first = lambda v: (v is not None, v)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    subs, lower = [], {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (first(r[0]), leaf(r)))
        sub, paths = climb([leaf(r) for r in own])
        subs.append(sub)
        lower[s] = (own, paths)
    root, above = climb(subs)
    out = Counter()
    for s, sub, high in zip(sources, subs, above):
        for r, low in zip(*lower[s]):
            sides = low + high
            tampered = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                tampered = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            folded = leaf(tampered)
            for before, after in sides:
                folded = sha(before + folded + after)
            out[r[0], leaf(r), sub, root, sha("".join(b + a for b, a in sides)), folded, folded == root] += 1
    return out


def table(spark, rows):
    shape = "doc_id long, source string, lang string, n_chars long, text string, tree int, place string, level long, run int, leaf string, sub int"
    return spark.createDataFrame([(*r, 1, "p", 2, 3, "l", 4) for r in rows], shape)


@pytest.mark.parametrize("hot, sources", [(700, 40), (17, 1), (16, 16), (1, 1), (257, 2)])
def test_proofs_by_hand(spark, hot, sources):
    rng = random.Random(hot)
    rows = [(i, "hot", rng.choice(["en", None]), i % 7 or None, f"Text {i}") for i in range(0, 2 * hot, 2)]
    for s in range(sources - 1):
        rows += [(10_000 + 50 * s + i, f"s{s}é", "fr", 3, rng.choice(["", "ABC", None, "ç Ü"])) for i in range(rng.choice([1, 2, 16, 17]))]
    if sources > 16:
        rows += [(i, None, None, None, t) for i, t in enumerate(["a", None, "", "B"] * 5)] + [(None, "", "en", 1, "X"), (None, "hot", None, None, None)]
        rows += [rows[0], rows[0], (rows[0][0], "hot", "en", 1, "Other"), (5, "long", "en", 1, "Word " * 50_000)]
    got = merkle.manifest(table(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == plain(rows)
    assert all(r["verified"] or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)


def test_empty(spark):
    assert merkle.manifest(odd.empty(spark)).count() == 0
