"""SentencePiece encoding by sampled segmentation, and decoding.

A text's segmentations into vocabulary pieces are the paths of a lattice over its bytes.
Forward filtering sums the weights of all paths up to each place; backward sampling then
walks from the end and picks each last piece in proportion to the paths behind it, which
draws a whole segmentation with its exact probability.  The random numbers are hashes of
(seed, row key, place), so a row gives the same pieces in any run and any batch.

Pieces do not cross the start of a run of spaces or a line break, so the lattice of a text
falls apart into units.  The filter runs once per distinct unit of a batch, all units of
about one length side by side; the walk runs for all occurrences side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import U64, chunks, mix64, powers, seeded, text_or_empty, utf8

BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
WIDTHS = (6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 128, 1024)
CELLS = 1 << 21   # lattice cells held at once
BYTES = 1 << 21   # text of a batch
WORDS = seeded(256, 3)


class Vocabulary:
    """Pieces as byte strings (a word mark is a space), their weights, and a hash lookup.

    A byte-pair model has no piece probabilities, only the order of its merges; the weight of
    the piece of rank r is taken as (r + 1) ** -alpha, Zipf's law for alpha = 1.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.bytes: list[bytes] = [b""] * n
        for i in plain:
            self.bytes[i] = model.id_to_piece(i).replace("▁", " ").encode()
        self.of_byte = np.zeros(256, dtype=np.int32)
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.bytes[i] = bytes([value])
                self.of_byte[value] = i
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.weight = np.ones(n)
        self.weight[order] = (np.arange(len(order)) + 1.0) ** -alpha
        self.longest = max(len(self.bytes[i]) for i in plain)
        self.size = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.single = {self.bytes[i] for i in plain if len(self.bytes[i].decode()) == 1}
        self.one = np.zeros(128, dtype=bool)
        for b in self.single:
            if len(b) == 1:
                self.one[b[0]] = True
        hashes = np.array([self._hash(self.bytes[i]) for i in plain], dtype=U64)
        left, self.tables = np.array(plain, dtype=np.int32), []
        while len(left):
            shift = U64(44 - 7 * len(self.tables))
            slot = ((hashes >> shift) & U64((1 << 20) - 1)).astype(np.int64)
            table, key = np.full(1 << 20, -1, np.int32), np.zeros(1 << 20, U64)
            table[slot], key[slot] = left, hashes
            self.tables.append((shift, table, key))
            lost = table[slot] != left
            left, hashes = left[lost], hashes[lost]

    @staticmethod
    def _hash(piece: bytes) -> int:
        value = 0
        for b in piece:
            value = (value * BASE + int(WORDS[b])) & (1 << 64) - 1
        return int(mix64(np.array([value], dtype=U64))[0])

    def find(self, value: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for none."""
        value = mix64(value)
        found = np.full(value.shape, -1, np.int32)
        for shift, table, key in self.tables:
            slot = ((value >> shift) & U64((1 << 20) - 1)).astype(np.int64)
            found = np.where((key[slot] == value) & (table[slot] >= 0), table[slot], found)
        return found


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


def lattice(vocab: Vocabulary, table: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward filter of units that are rows of ``table``.

    Returns, per unit and end place, the running sum over piece lengths of the weight of all
    paths whose last piece has that length, and the id of that piece.
    """
    n, width = table.shape
    most = min(vocab.longest, width)
    hashes = np.zeros((n, width + 1), dtype=U64)
    for c in range(width):
        hashes[:, c + 1] = hashes[:, c] * U64(BASE) + WORDS[table[:, c]]
    power = powers(BASE, most + 1)
    piece = np.full((n, width + 1, most), -1, np.int32)
    for size in range(1, most + 1):
        value = hashes[:, size:] - hashes[:, : width + 1 - size] * power[size]
        piece[:, size:, size - 1] = vocab.find(value)
    # A character that is no piece goes byte by byte; only its bytes' own nodes need them.
    lead = (table & 0xC0) != 0x80
    plain = np.zeros((n, width), dtype=bool)
    for size in range(1, min(4, most) + 1):
        if width >= size:
            hit = piece[:, size:, size - 1] >= 0
            there = lead[:, : width + 1 - size].copy()
            there[:, : width - size] &= lead[:, size:] | (np.arange(size, width)[None, :] >= long[:, None])
            hit = hit & there
            for j in range(size):
                plain[:, j : width + 1 - size + j] |= hit
    bare = ~plain
    piece[:, 1:, 0] = np.where(bare, vocab.of_byte[table], piece[:, 1:, 0])
    gain = np.where(piece >= 0, vocab.weight[piece], 0.0)
    total = np.zeros((n, width + 1))
    total[:, 0] = 1.0
    sums = np.zeros((n, width + 1, most))
    for j in range(1, width + 1):
        back = min(j, most)
        part = np.zeros((n, most))
        part[:, :back] = total[:, j - back : j][:, ::-1] * gain[:, j, :back]
        sums[:, j] = np.cumsum(part, axis=1)
        total[:, j] = sums[:, j, -1]
        if j % 16 == 0:  # only ratios inside the window matter from here on
            scale = total[:, max(0, j - most) : j + 1].max(axis=1, keepdims=True)
            total[:, max(0, j - most) : j + 1] /= np.where(scale > 0, scale, 1.0)
    return sums, piece


def _units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the units: at each text, run of spaces, line break and what follows one."""
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    first = first[:n]
    space, line = data == 32, data == 10
    first |= line
    first[1:] |= (space[1:] & ~space[:-1]) | line[:-1]
    return np.flatnonzero(first)


def encode_texts(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and their offsets.  Each non-empty text has one
    space before it, as the model expects."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    lead = (sizes > 0).astype(np.int64)
    moved = np.concatenate([[0], np.cumsum(sizes + lead)])
    text = np.full(int(moved[-1]), 32, dtype=np.uint8)
    text[np.arange(len(data)) + np.repeat(np.cumsum(lead), sizes)] = data
    starts = _units(text, moved)
    if len(starts) == 0:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    ends = np.concatenate([starts[1:], [len(text)]])
    long = ends - starts
    sums = np.zeros(len(text) + 1, dtype=U64)
    np.cumsum(WORDS[text] * powers(BASE, len(text)), out=sums[1:])
    name = mix64((sums[ends] - sums[starts]) * powers(INVERSE, len(text))[starts] + long.astype(U64))
    _, first, unit = np.unique(name, return_index=True, return_inverse=True)
    doc = np.searchsorted(moved, starts, side="right") - 1
    row = mix64(keys.astype(np.int64).view(U64) + mix64(np.array([seed], dtype=np.int64).view(U64)))
    stream = mix64(row[doc] + (starts - moved[doc]).astype(U64))
    by_unit = np.argsort(unit, kind="stable")
    bound = np.searchsorted(unit[by_unit], np.arange(len(first) + 1))
    width = np.searchsorted(np.array(WIDTHS), long[first])
    counts = np.zeros(len(starts), dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    for w in np.unique(width).tolist():
        of = np.flatnonzero(width == w)
        across = WIDTHS[w] if w < len(WIDTHS) else int(long[first[of]].max())
        step = max(1, CELLS // (across * min(across, vocab.longest)))
        if w == len(WIDTHS):
            step = 1
        for at in range(0, len(of), step):
            some = of[at : at + step]
            if w == len(WIDTHS):
                across = int(long[first[some]].max())
            size = long[first[some]]
            place = starts[first[some]][:, None] + np.arange(across)[None, :]
            inside = np.arange(across)[None, :] < size[:, None]
            table = np.where(inside, text[np.minimum(place, len(text) - 1)], 0).astype(np.uint8)
            cum, piece = lattice(vocab, table, size)
            times = bound[some + 1] - bound[some]
            seat = np.repeat(np.arange(len(some)), times)
            ends_ = np.cumsum(times)
            who = by_unit[np.arange(int(ends_[-1])) + np.repeat(bound[some] - (ends_ - times), times)]
            at_ = size[seat].copy()
            back = 0
            live = np.arange(len(who))
            while len(live):
                sums_ = cum[seat[live], at_[live]]
                draw = (mix64(stream[who[live]] + at_[live].astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(11)).astype(np.float64) * 2.0**-53
                pick = (sums_ <= (draw * sums_[:, -1])[:, None]).sum(axis=1)
                pick = np.minimum(pick, sums_.shape[1] - 1)
                found.append((who[live], piece[seat[live], at_[live], pick], back))
                counts[who[live]] += 1
                at_[live] -= pick + 1
                live = live[at_[live] > 0]
                back += 1
    base = np.cumsum(counts) - counts
    ids = np.empty(int(counts.sum()), dtype=np.int32)
    for who, piece, back in found:
        ids[base[who] + counts[who] - 1 - back] = piece
    out = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.bincount(doc, weights=counts, minlength=n).astype(np.int64), out=out[1:])
    return ids, out


def decode_ids(vocab: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; the space before each text is taken off."""
    long = vocab.size[ids]
    ends = np.cumsum(long)
    data = vocab.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(vocab.start[ids] - (ends - long), long)]
    ends = np.concatenate([[0], ends])[offsets]
    keep = np.ones(len(data), dtype=bool)
    keep[ends[:-1][np.diff(ends) > 0]] = False
    return data[keep], ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])


def _encode(path: str, alpha: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, alpha)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            for lo, hi in chunks(offsets, BYTES):
                part, places = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                ids, ends = encode_texts(vocab, part, places, keys[lo:hi], seed)
                back, bounds = decode_ids(vocab, ids, ends)
                digests, same = [], []
                for a, b, x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), places[:-1].tolist(), places[1:].tolist()):
                    digests.append(hashlib.sha256(back[a:b]).hexdigest())
                    same.append(b - a == y - x and np.array_equal(back[a:b], part[x:y]))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), lists, pa.array(digests, pa.string()), pa.array(same, pa.bool_())],
                    names=["key", "ids", "decoded_sha256", "lossless"],
                )

    return run


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0, seed: int = 29) -> DataFrame:
    """Sampled piece ids of every row's text.

    One row per input row: ``doc_id``, ``n_tokens``, ``ids``, ``decoded_sha256`` (of the text
    the ids decode to) and ``lossless`` (whether that is the text, byte for byte).  ``model``
    is the model file's place on every executor; larger ``alpha`` makes samples less varied.

    A null or empty text has no ids.  A character without a piece, and a literal word mark,
    become byte pieces.  Rows with the same id and text get the same pieces; a null id counts
    as 0.  An empty table gives an empty result.  Other columns are not read.
    """
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("key"), text_or_empty(text_col).alias("text"), F.col(id_col).isNull().alias("none"))
    nulls = rows.filter("none").select("key", "text")
    whole = rows.filter("not none").select("key", "text")
    schema = "key long, ids array<int>, decoded_sha256 string, lossless boolean"
    run = _encode(model, alpha, seed)

    def shaped(frame: DataFrame, key) -> DataFrame:
        return frame.mapInArrow(run, schema).select(
            key.alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256", "lossless"
        )

    out = shaped(whole, F.col("key"))
    return out if not df.schema[id_col].nullable else out.union(shaped(nulls, F.lit(None).cast("long")))


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, 1.0)
        for batch in batches:
            lists = batch.column(1)
            sizes = np.array([0 if x is None else len(x) for x in lists.to_pylist()], dtype=np.int64)
            data, ends = decode_ids(vocab, lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
            texts = [data[a:b].tobytes().decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of encoded rows, as (doc_id, text); no ids, or null, give the empty text."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(
        _decode(model), "doc_id long, text string"
    )
