import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import odd
from pyspark.sql import functions as F

from tidemark.llm import filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    """Every order, applied row by row."""
    good, toxic = ({d for d, q, t in labels if (q, t)[i] == 1} for i in range(2))
    docs = []
    for doc, text, source in rows:
        text = text or ""
        words = WORDS.findall(text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": re.search("[#$%&*|]", text) is not None,
            "E": doc is not None and any((t or "") == text and d is not None and d < doc for d, t, _ in rows),
        }
        docs.append((source or "", frozenset(f for f in fails if fails[f]), doc in good and doc is not None, doc in toxic and doc is not None))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for i, f in enumerate(order):
                lost = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(lost)
                out[(part, "".join(order), i + 1)] = [
                    len(left), len(lost), sum(f in d[1] for d in own) - len(lost), sum(d[1] == {f} for d in own),
                    sum(d[2] for d in lost), sum(d[3] for d in lost),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def odd_rows():
    rng = random.Random(4)
    rows = odd.rows(6, 60)
    for i in range(60):
        words = [rng.choice(["alpha", "Beta", "GAMMA", "x#", "delta", "50%"]) + str(rng.randrange(40)) for _ in range(rng.choice([5, 49, 50, 80]))]
        rows += [(300 + i, " ".join(words), rng.choice(["s1", None, ""]))]
    rows += [(400 + i, rows[-1][1], "s1") for i in range(5)] + [(None, rows[-1][1], "s2"), (None, None, None), rows[-1]]
    return rows


def test_against_every_order_by_hand(spark):
    rows = odd_rows()
    labels = [(d, i % 3 and 1, i % 5 == 0 and 1 or 0) for i, (d, _, _) in enumerate(rows) if i % 2] + [(205, None, 1), (205, 1, None), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {
        (r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.RESULT[3:]]
        for r in filter_audit.filter_audit(odd.frame(spark, rows), table).collect()
    }
    assert got == plain(rows, labels)


def test_walk_is_the_count_of_every_subset():
    cells = np.random.default_rng(2).integers(0, 9, (3, 32, 3))
    states = filter_audit.gray_walk(cells)
    for subset in range(32):
        assert (states[:, subset] == cells[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()


def test_own_filters_and_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(odd.empty(spark), labels).count() == 0
    frame = odd.frame(spark, [(1, "a", "s"), (2, "a", "s"), (3, None, "s")])
    rows = filter_audit.filter_audit(frame, labels, {"N": F.col("text").isNull(), "L": F.length("text") > 9}, "R").collect()
    assert len(rows) == 18
    last = {(r["filter_order"], r["step"]): (r["kept"], r["removed"]) for r in rows}
    assert last["NLR", 3] == (1, 1) and last["RNL", 2] == (1, 1)
