"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches.

Text is folded first: lower case, letters that look alike made one, digits and signs that
stand for letters turned into them, everything else between words a space.  Lexicon entries are
folded words (`` word ``) and word beginnings (`` begin``), learned from labelled documents;
exception phrases, learned or given, take back the weight of the entries inside them.  The sum
of weights and its rate per word give the score through a two-feature logistic fit.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import text_or_empty
from tidemark.session import settle

# Letters of other scripts that look like Latin ones, and signs written for letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ԁ": "d", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
WRITTEN_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "!": "i", "|": "i"}
UNSEEN = "​‌‍⁠﻿­"

PREFIXES = range(3, 9)   # lengths of word beginnings that may become entries
SAMPLE = 40_000          # labelled documents a fit reads at most, chosen by hash of the id
FOLDS = 5                # one of so many labelled documents is never learned from
SHARED = 0.03            # share of the toxic documents without an entry that a new entry must hold
ROUNDS = 8

_TABLE = {i: " " for i in range(128) if not chr(i).isalnum()}
_TABLE |= {ord("!"): " ", ord("|"): " "}
_TABLE |= {ord(k): v for k, v in LOOK_ALIKE.items()}
_TABLE |= {ord(k): v for k, v in WRITTEN_FOR.items() if k not in "!|"}
_TABLE |= {ord(c): None for c in UNSEEN}
_TABLE |= {0xFF01 + i - 0x21: chr(i) for i in range(0x21, 0x7F) if chr(i).isalpha()}
_TABLE |= {ord(c): " " for c in "   　«»“”„‘’…–—·¿¡"}


def fold(text: str) -> str:
    """Folded words, one space between and around them.

    ``!`` and ``|`` stand for i only between letters of a word, else they end it.
    """
    low = text.lower()
    if "!" in low or "|" in low:
        chars = list(low)
        for at in range(1, len(chars) - 1):
            if chars[at] in "!|" and chars[at - 1].isalnum() and chars[at + 1].isalnum():
                chars[at] = WRITTEN_FOR[chars[at]]
        low = "".join(chars)
    return f" {' '.join(low.translate(_TABLE).split())} "


@dataclass(frozen=True)
class Model:
    """Entries and exceptions with their weights, and the logistic coefficients."""

    weights: tuple[tuple[str, float], ...]
    bias: float = -3.0
    by_sum: float = 1.0
    by_rate: float = 1.0
    exceptions: tuple[tuple[str, float], ...] = field(default=())

    def score(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        x = self.bias + self.by_sum * np.log1p(total) + self.by_rate * np.log1p(1000.0 * total / np.maximum(words, 1))
        return 1.0 / (1.0 + np.exp(-x))


@lru_cache(maxsize=4)
def _automaton(model: Model):
    import ahocorasick

    found = ahocorasick.Automaton()
    for entry, weight in model.weights + model.exceptions:
        found.add_word(entry, weight)
    if len(found):
        found.make_automaton()
    return found


def weigh(texts, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sum of matched weights (not below 0) and number of words of each text."""
    found = _automaton(model)
    total, words = np.zeros(len(texts)), np.zeros(len(texts))
    for i, text in enumerate(texts):
        if text:
            folded = fold(text)
            words[i] = folded.count(" ") - 1
            if len(found):
                total[i] = max(0.0, sum(w for _, w in found.iter(folded)))
    return total, words


def scorer(model: Model):
    """A column function: text to score between 0 and 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(*weigh(texts.tolist(), model)))

    return score


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0


def labelled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most about ``most`` labelled documents outside the held-out fold.

    The sample is by hash of the id, and the table of its ids is bounded by ``most``.
    """
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic"))
    own = own.filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = own.count()
    if n > most:
        own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int((1 << 32) * 0.98 * most / n))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).join(F.broadcast(own), "doc_id").select("text", "toxic")


def entries_of(text: str) -> set[str]:
    """Words and word beginnings of a text, as lexicon entries."""
    found: set[str] = set()
    for word in set(fold(text).split()):
        if not word.isdigit() and len(word) >= 3:
            found.add(f" {word} ")
            found.update(f" {word[:n]}" for n in PREFIXES if n <= len(word))
    return found


def _count(wanted: frozenset | None, toxic: bool, covered: frozenset = frozenset()):
    """Documents per entry, of those with the given label that hold no ``covered`` entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if label == toxic:
                    found = entries_of(text)
                    if found.isdisjoint(covered):
                        counts[""] += 1
                        counts.update(found if wanted is None else found & wanted)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["entry", "n"]
        )

    return run


def _count_near(lexicon: frozenset):
    """Words of the other documents that begin like an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not label:
                    words = set(fold(text).split())
                    counts.update(f" {w} " for w in words if any(f" {w[:n]}" in lexicon for n in PREFIXES))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["entry", "n"]
        )

    return run


def _totals(rows: DataFrame, wanted, toxic: bool, least: int, covered: frozenset = frozenset()) -> dict[str, int]:
    counted = rows.mapInArrow(_count(wanted, toxic, covered), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    return {r["entry"]: r["n"] for r in counted.filter((F.col("n") >= least) | (F.col("entry") == "")).collect()}


def choose(bad: dict[str, int], good: dict[str, int], pure: float = 0.9) -> dict[str, float]:
    """Entries from document counts of toxic and other documents.

    Of a word beginning that is ``pure`` toxic and all that continue it, the entry is the one
    with most toxic documents when others count ten times against it.
    """
    n_bad, n_good = bad.get("", 0), good.get("", 0)

    def purity(entry: str) -> float:
        a, b = bad.get(entry, 0) / max(n_bad, 1), good.get(entry, 0) / max(n_good, 1)
        return a / (a + b) if a + b else 0.0

    def weight(entry: str) -> float:
        return math.log((bad.get(entry, 0) + 0.5) / (n_bad + 1)) - math.log((good.get(entry, 0) + 0.5) / (n_good + 1))

    def real(entry: str) -> bool:
        # Pure, and more toxic documents than chance would give: 4 standard deviations.
        a, share = bad.get(entry, 0), n_bad / max(n_bad + n_good, 1)
        n = a + good.get(entry, 0)
        return purity(entry) >= pure and a - n * share >= 4 * math.sqrt(n * share * (1 - share))

    def gain(entry: str) -> float:
        return bad.get(entry, 0) - 10.0 * good.get(entry, 0) * n_bad / max(n_good, 1)

    heads = sorted((e for e in bad if e and real(e)), key=lambda e: (len(e.rstrip()), e.endswith(" "), e))
    lexicon: dict[str, float] = {}
    for e in heads:
        if not any(e[:n] in lexicon for n in range(3, len(e) + 1)):
            best = max((x for x in heads if x.startswith(e)), key=lambda x: (gain(x), len(x)))
            lexicon[best] = weight(best)
    return lexicon


def spare(lexicon: dict[str, float], bad: dict[str, int], near: dict[str, int]) -> dict[str, float]:
    """Exceptions: words that begin like an entry but mostly stand in other documents."""
    spared = {}
    for word, n in near.items():
        inside = [word[:k] for k in range(2, len(word)) if word[:k] in lexicon]
        if inside and word not in lexicon and n >= 2 and n > bad.get(word, 0):
            spared[word] = -sum(lexicon[x] for x in inside)
    return spared


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Coefficients of a ridge logistic fit by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = p * (1 - p) + 1e-9
        step = np.linalg.solve((x.T * w) @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _measure(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, words = weigh(batch.column(0).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(words), batch.column(1)], names=["total", "words", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> Model:
    """A model from labelled documents outside the held-out fold, ``most`` of them at most.

    ``exceptions`` are phrases that take back the weight of the entries inside them.  Without
    labels of both kinds the lexicon is empty and every text scores the prior.
    """
    rows = settle(labelled(docs, labels, most))
    size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0))).first()
    # Entries that many toxic documents share come first; then what the documents without one
    # share, so that words of a few copied documents are not taken for the reason.
    lexicon: dict[str, float] = {}
    bad: dict[str, int] = {}
    for _ in range(ROUNDS):
        counts = _totals(rows, None, True, 5, frozenset(lexicon))
        many = counts.get("", 0)
        if many < max(5, size[1] * 0.005):
            break
        counts = {e: n for e, n in counts.items() if n >= SHARED * many}
        good = _totals(rows, frozenset(counts), False, 1)
        more = choose(counts, good)
        if not more:
            break
        lexicon |= more
        bad = {e: max(n, bad.get(e, 0)) for e, n in counts.items()} | {e: n for e, n in bad.items() if e not in counts}
    # Words of other documents under an entry are counted on their own: entries are rare there.
    near = rows.mapInArrow(_count_near(frozenset(lexicon)), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    spared = spare(lexicon, bad, {r["entry"]: r["n"] for r in near.filter("n >= 2").collect()})
    for phrase in exceptions:
        folded = fold(phrase)
        spared[folded] = -sum(w * folded.count(e) for e, w in lexicon.items())
    model = Model(tuple(sorted(lexicon.items())), exceptions=tuple(sorted(spared.items())))
    if not size[0] or not 0 < size[1] < size[0]:
        return Model((), bias=-3.0)
    # Three numbers for each of at most ``most`` documents.
    seen = rows.mapInArrow(_measure(model), "total double, words double, toxic boolean").toPandas()
    total, words = seen["total"].to_numpy(), np.maximum(seen["words"].to_numpy(), 1)
    x = np.column_stack([np.ones(len(seen)), np.log1p(total), np.log1p(1000.0 * total / words)])
    beta = logistic(x, seen["toxic"].to_numpy().astype(float))
    return Model(model.weights, *(float(b) for b in beta), exceptions=model.exceptions)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """Score every document: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (score >= 0.5).

    ``documents`` need doc_id and text, ``labels`` doc_id and toxic; nothing but the text enters
    a score.  A null or empty text scores what a text without matches scores.  Null labels are
    skipped; a document labelled twice is toxic if one label says so.  A null id is scored and
    counts as not held out.  Repeated rows score alike; empty tables give an empty result.
    """
    model = fit(docs, labels, most, exceptions)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        scorer(model)(text_or_empty("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, in one pass."""
    model = fit(docs, labels, most)
    return docs.filter(scorer(model)(text_or_empty("text")) < 0.5)
