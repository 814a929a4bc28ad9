"""Token ids as files: canonical length-limited Huffman codes in independent blocks.

The file format is a parquet folder with a row per block.  A block holds whole documents in
ascending id order: their ids and token counts, the code bits of all their tokens, and the bit
offset of every ``LANE``-th token, so a reader can start at each of these checkpoints.  Code
lengths come from the counts of all ids over all documents and are at most 16, so a table of
2 ** 16 entries gives id and length of the next code in one look; the canonical codes follow
from the lengths alone, which are stored once beside the blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import IS_SPACE, U64, chunks, mix64, powers, seeded, shuffle_width, text_or_empty, utf8
from tidemark.session import land

LIMIT = 16
LANE = 256            # tokens between two checkpoints
BLOCK_TOKENS = 1 << 18
PIECES = 16           # parts in which counts are added up
END = 0               # id that closes every document
BYTES = 1 << 22       # text encoded at once
REMEMBERED = 1 << 20  # distinct stretches of text whose ids a worker remembers
BASE = 0xA24BAED4963EE407
INVERSE = pow(BASE, -1, 1 << 64)
WORDS = seeded(256, 21)
LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
MARK = np.array([b in b",.;:!?#%&*$" for b in range(256)])


class Encoder:
    """Ids by the tokenizer library, which is asked once per distinct stretch of text.

    The tokenizer splits a text before it merges bytes, and never joins what stands before a
    lone space or line break, or between a letter and a mark, with what follows; so a text may
    be cut there without changing an id.  Ids of distinct stretches are remembered, up to a bound.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._clear()

    def _clear(self) -> None:
        self.name, self.at, self.long = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint16 if self.size <= 65536 else np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and their offsets."""
        n = len(offsets) - 1
        starts = cuts(data, offsets)
        if not len(starts):
            return self.pool[:0], np.zeros(n + 1, np.int64)
        ends = np.append(starts[1:], len(data))
        sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(WORDS[data] * powers(BASE, len(data)), out=sums[1:])
        name = mix64((sums[ends] - sums[starts]) * powers(INVERSE, len(data))[starts] + (ends - starts).astype(U64))
        order = np.argsort(name)
        ranked = name[order]
        fresh = np.ones(len(ranked), dtype=bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        distinct, first, which = ranked[fresh], order[fresh], np.empty(len(name), dtype=np.int64)
        which[order] = np.cumsum(fresh) - 1
        if len(self.name) > REMEMBERED:
            self._clear()
        place = np.searchsorted(self.name, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = place < len(self.name)
        known[inside] = self.name[place[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            texts = [data[a:b].tobytes().decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            long = np.fromiter(map(len, ids), np.int64, len(ids))
            at = len(self.pool) + np.cumsum(long) - long
            self.pool = np.concatenate([self.pool, np.fromiter((i for x in ids for i in x), self.pool.dtype, int(long.sum()))])
            spot = place[new]  # both are sorted, so the new ones have their places already
            self.at, self.long = np.insert(self.at, spot, at), np.insert(self.long, spot, long)
            self.name = np.insert(self.name, spot, distinct[new])
            place = np.searchsorted(self.name, distinct)
        at, long = self.at[place][which], self.long[place][which]
        stop = np.cumsum(long)
        out = self.pool[np.arange(int(stop[-1])) + np.repeat(at - (stop - long), long)]
        return out, np.concatenate([[0], stop])[np.searchsorted(starts, offsets)]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the stretches: texts, where a lone space or line break stands, and where one of
    a few marks follows a letter (none of them is part of a contraction or a special token)."""
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    first = first[:n]
    if n < 3:
        return np.flatnonzero(first)
    blank = IS_SPACE[data] | ((data >= 0x1C) & (data <= 0x1F))
    # White space beyond ASCII takes part in runs too: it starts with one of these bytes.
    wide = (data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)
    before = blank | wide
    before[1:] |= data[:-1] == 0xC2
    before[2:] |= (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)
    lone = np.zeros(n, dtype=bool)
    lone[1:-1] = ((data[1:-1] == 32) | (data[1:-1] == 10)) & ~before[:-2] & ~(blank | wide)[2:]
    lone &= ~first
    lone[:-1] &= ~first[1:]  # a text that ends in white space is left whole
    first |= lone
    first[1:] |= lone[:-1] & (data[:-1] == 10)
    first[1:] |= LETTER[data[:-1]] & MARK[data[1:]]
    return np.flatnonzero(first)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with none over ``limit``, by package-merge; 0: unused."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.int64)
    from_leaf, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        from_leaf.append(rank < len(leaves))
        merged = both[rank]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), dtype=np.int64)
    for leaf in reversed(from_leaf):
        of_leaves = int(leaf[:take].sum())
        depth[:of_leaves] += 1
        take = 2 * (take - of_leaves)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    step = np.uint64(1) << (U64(LIMIT) - lengths[order].astype(U64))
    start = np.concatenate([[U64(0)], np.cumsum(step)[:-1]])
    codes[order] = (start >> (U64(LIMIT) - lengths[order].astype(U64))).astype(np.uint32)
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The tokens' code bits, highest first, and the bit offset of every LANE-th token."""
    long = lengths[ids].astype(np.int64)
    ends = np.cumsum(long)
    begin = ends - long
    word, room = begin >> 6, 64 - (begin & 63) - long
    code = codes[ids].astype(U64)
    here = np.where(room >= 0, code << np.maximum(room, 0).astype(U64), code >> np.maximum(-room, 0).astype(U64))
    out = np.zeros(int(ends[-1] + 63 >> 6) + 1 if len(ids) else 1, dtype=U64)
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(ids) else np.zeros(0, np.int64)
    if len(ids):
        out[word[heads]] = np.bitwise_or.reduceat(here, heads)
    over = np.flatnonzero(room < 0)
    out[word[over] + 1] |= code[over] << (64 + room[over]).astype(U64)
    return out.astype(">u8").tobytes(), begin[::LANE]


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next LIMIT bits: the id they begin with, and its code's length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = 1 << (LIMIT - lengths[order].astype(np.int64))
    ids, long = np.repeat(order, span), np.repeat(lengths[order], span)
    pad = (1 << LIMIT) - len(ids)
    return np.pad(ids, (0, pad)).astype(np.int32), np.pad(long, (0, pad), constant_values=1)


def unpack_bits(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of a block; from every checkpoint one lane of tokens, all lanes side by side."""
    symbols, long = table
    raw = np.frombuffer(bits + bytes(8), dtype=np.uint8).astype(np.uint32)
    wide = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.zeros((len(checkpoints), LANE), dtype=np.int32)
    at = checkpoints.astype(np.int64).copy()
    for j in range(min(LANE, n)):
        live = len(checkpoints) if n - (len(checkpoints) - 1) * LANE > j else len(checkpoints) - 1
        bit = at[:live]
        value = (wide[bit >> 3] >> (16 - (bit & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[:live, j] = symbols[value]
        at[:live] += long[value]
    return out.ravel()[:n]


def _tokenize(path: str, size: int):
    """Rows (part, block, …): the ids of whole documents in order, packed; at a task's end its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, total = encoder(path), np.zeros(size, np.int64)
        pack, none = zstandard.ZstdCompressor(level=3), pa.array([None], pa.binary())
        held, count, number, part = [], 0, 0, 0

        def block():
            ids = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            total[:] += np.bincount(ids, minlength=size)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()),
                    pa.array([np.concatenate([h[0] for h in held]).tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()),
                    pa.array([pack.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())], pa.binary()),
                    pa.array([None], pa.int32()), none,
                ],
                names=["part", "block", "n_tokens", "doc_ids", "doc_tokens", "ids", "piece", "counts"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy(zero_copy_only=False)
            part = batch.column(2)[0].as_py()
            data, offsets = utf8(batch.column(1))
            for lo, hi in chunks(offsets, BYTES):
                ids, ends = tool.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                at = lo
                while at < hi:  # whole documents until the block is full
                    room = ends[at - lo] + max(1, BLOCK_TOKENS - count)
                    to = min(hi, max(at + 1, lo + int(np.searchsorted(ends, room, side="right")) - 1))
                    some = ids[ends[at - lo] : ends[to - lo]].astype(np.int32)
                    closed = np.insert(some, ends[at - lo + 1 : to - lo + 1] - ends[at - lo], END)
                    held.append((own[at:to], closed, np.diff(ends[at - lo : to - lo + 1]) + 1))
                    count += len(closed)
                    at = to
                    if count >= BLOCK_TOKENS:
                        yield block()
                        held, count, number = [], 0, number + 1
        if held:
            yield block()
        if total.any():
            empty, ints = pa.array([None] * PIECES, pa.binary()), pa.array([None] * PIECES, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    ints, ints, pa.array([None] * PIECES, pa.int64()), empty, empty, empty, pa.array(range(PIECES), pa.int32()),
                    pa.array([zlib.compress(p.tobytes(), 1) for p in np.array_split(total, PIECES)], pa.binary()),
                ],
                names=["part", "block", "n_tokens", "doc_ids", "doc_tokens", "ids", "piece", "counts"],
            )

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in pdf["counts"])
    return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "counts": [total.tobytes()]})


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents; a vector as long as the vocabulary."""
    rows = (
        tokens.filter("piece is not null").select("piece", "counts")
        .groupBy("piece").applyInPandas(_added, "piece int, counts binary").collect()
    )
    parts = np.array_split(np.zeros(size, np.int64), PIECES)
    for r in rows:
        parts[r["piece"]] = np.frombuffer(r["counts"], np.int64)
    return np.concatenate(parts)


def _code(lengths: bytes):
    """Packed ids of a block to its code bits and checkpoints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = np.frombuffer(lengths, np.uint8)
        codes, unpack = canonical(long), zstandard.ZstdDecompressor()
        for batch in batches:
            bits, marks = [], []
            for packed in batch.column(5).to_pylist():
                raw = np.frombuffer(unpack.decompress(packed), np.uint8)
                ids = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int32)
                some, at = pack_bits(ids, codes, long)
                bits.append(some)
                marks.append(np.diff(at, prepend=0).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(marks, pa.binary()), pa.array(bits, pa.binary())],
                names=["part", "block", "n_tokens", "doc_ids", "doc_tokens", "checkpoints", "bits"],
            )

    return run


TOKENS = "part int, block int, n_tokens long, doc_ids binary, doc_tokens binary, ids binary, piece int, counts binary"
BLOCKS = "part int, block int, n_tokens long, doc_ids binary, doc_tokens binary, checkpoints binary, bits binary"


def write_ids(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bytes]:
    """Encode all texts and write their ids; the blocks as written, and the code lengths.

    Documents are dealt by id range and sorted, so part, block and place in the block are
    ascending in id.  They are encoded once; the packed ids wait in the checkpoint folder for
    the global counts.  A document is never divided; blocks are closed at BLOCK_TOKENS tokens.
    """
    docs = df.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")
    )
    ordered = docs.repartitionByRange(2 * shuffle_width(df.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    size = encoder(tokenizer).size
    tokens = land(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_tokenize(tokenizer, size), TOKENS), "tokens")
    lengths = code_lengths(id_counts(tokens, size)).tobytes()
    blocks = tokens.filter("piece is null").select("part", "block", "n_tokens", "doc_ids", "doc_tokens", "ids")
    return land(blocks.mapInArrow(_code(lengths), BLOCKS), "token-ids"), lengths


def _read(lengths: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for part, block, n, doc_ids, sizes, marks, bits in zip(*(batch.column(i).to_pylist() for i in range(7))):
                own, sizes = np.frombuffer(doc_ids, np.int64), np.frombuffer(sizes, np.int64)
                ids = unpack_bits(bits, np.cumsum(np.frombuffer(marks, np.uint32).astype(np.int64)), n, table)
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4")
                sums = [zlib.crc32(raw[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist())]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(own), pa.int32()), pa.array([block] * len(own), pa.int32()), pa.array(own),
                        pa.array(ends - sizes), pa.array(sizes), pa.array(sums, pa.int64()), lists,
                    ],
                    names=["part", "block", "doc_id", "place", "n_tokens", "ids_crc32", "ids"],
                )

    return run


ROWS = "part int, block int, doc_id long, place long, n_tokens long, ids_crc32 long, ids array<int>"


def read_ids(blocks: DataFrame, lengths: bytes) -> DataFrame:
    """Documents of written blocks: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` with the end id, ``ids_crc32`` of the ids as unsigned 32-bit little-endian
    integers, and ``ids``."""
    # A part's blocks and the parts are few rows: block counts, summed in order.
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(order) - F.col("n")).alias("base"))
    bases = blocks.select("part", "block", "n_tokens").withColumn("before", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(
        parts, "part"
    ).select("part", "block", (F.col("before") + F.col("base")).alias("base"))
    rows = blocks.mapInArrow(_read(lengths), ROWS)
    return rows.join(bases, ["part", "block"]).select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )


def token_files(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write and read back: one row per document as ``read_ids`` gives it.

    A null or empty text has the end id alone.  Rows that share an id are all written, in
    order of their texts.  Rows with a null id are left out.  An empty table writes no block
    and gives an empty result.  Other columns are not read.
    """
    blocks, lengths = write_ids(df, tokenizer, id_col, text_col)
    return read_ids(blocks, lengths)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of an earlier ``write_ids``, from where they were written."""
    return spark.read.schema(BLOCKS).parquet(folder)
