import hashlib
import random
import re
from collections import Counter

import odd
import pytest

from tidemark.llm import decontaminate

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def plain(rows, items):
    windows = {}
    for item, text in items:
        words = WORDS.findall(lowered(text))
        for i in range(max(len(words) - 10, 0) + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + 10]), set()).add("" if item is None else str(item))
    out = Counter()
    for doc, text, _ in rows:
        words = WORDS.findall(lowered(text))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                own = windows.get(tuple(words[i : i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    found |= own
        out[doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


def tables(seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(30)] + ["The", "été", "梦9"]
    say = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 5, 9, 10, 11, 14, 30]))) for i in range(25)]
    # Texts of few words, shared by items, repeated inside one, blank, null, and without an id.
    items += [(30, items[4][1] + " " + say(12)), (31, "a a a a a a a a a a a a a"), (32, None), (33, " -- "), (34, ""), (None, say(12)), (3, say(15)), (35, items[4][1])]
    rows = odd.rows(seed, 40)
    for i in range(60):
        item = rng.choice(items)[1] or ""
        cut = item.split(" ")
        take = rng.choice([item, item.upper(), ", ".join(cut), " ".join(cut[1:]), " ".join(cut[:-1]), " ".join(cut[:5] + ["no"] + cut[5:])])
        rows.append((500 + i, f"{say(rng.randrange(6))} {take} {say(rng.randrange(6))}" + rng.choice(["", f" {take}"]), "s"))
    rows += [(700, "a " * 40, "s"), (701, items[30 - 5][1], "s"), (None, items[0][1], "s"), (None, items[0][1], "s"), rows[-1], rows[-1]]
    return rows, items


@pytest.mark.parametrize("broadcast", [True, False])
def test_windows_found_by_hand(spark, broadcast):
    rows, items = tables(3)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, w string, doc_id long")
    most = {} if broadcast else {"max_rows": 0}
    got = decontaminate.decontaminate(odd.frame(spark, rows), frame, **most).collect()
    want = plain(rows, items)
    assert Counter(tuple(r) for r in got) == want
    assert sum(n for row, n in want.items() if row[-1]) > 30


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    assert decontaminate.decontaminate(odd.empty(spark), items).count() == 0
    got = decontaminate.decontaminate(odd.frame(spark, [(1, "some words of an item", "s")]), items.limit(0)).first()
    assert (got["n_words"], got["n_hit"], got["n_items"], got["contaminated"]) == (5, 0, 0, False)
    assert got["items_sha256"] == hashlib.sha256(b"").hexdigest()
