"""Rows that operators must not trip over: nulls, blanks, long texts, repeats, clashing names."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, size string, packed binary, seat int, u string, __x string"


def texts(seed=1, n=40):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "the", "of", "x", "epsilon", "zeta9", "梦", "eta", "theta"]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 6, 12, 40, 90]))) for _ in range(max(3, n // 5))]
    out = []
    for _ in range(n):
        tokens = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            tokens[rng.randrange(len(tokens))] = rng.choice(words) + str(rng.randrange(50))
        out.append(rng.choice([" ", " ", "\n", "\t "]).join(tokens))
    return out


def rows(seed=1, n=40, null_id=True):
    """(doc_id, text, source) of odd documents."""
    found = [(7 * i % 101, t, f"s{i % 4}") for i, t in enumerate(texts(seed, n))]
    found += [
        (200, None, "s1"), (201, "", None), (202, " \n\t ", "s2"), (203, "one", "s1"), (204, "one two", None),
        (205, "word " * 9_000 + "end", "s3"), (206, "word " * 9_000 + "end", "s3"), (207, "y" * 30_000, "s0"),
        (208, "tab\tand\x0bmore ▁   🎉 <|endoftext|>  two  spaces", "s0"), (209, "", "s0"),
    ]
    found += [found[0], found[3]]
    return found + ([(None, "no id here at all", "s1")] if null_id else [])


def frame(spark, found):
    return spark.createDataFrame(
        [(i, t, None, s, None, 5, "big", b"z", 1, "u", "x") for i, t, s in found], COLUMNS
    )


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
