"""N-gram Jaccard self-join by PartEnum signatures.

The shingle domain is cut into partitions by hash.  Sets whose sizes fall into one band are
compared under one partitioning: two sets of similarity ``at_least / per`` or more differ in
at most k shingles, so at most k partitions look different.  Signatures enumerate subsets of
partitions: pairs of them for small sets, single ones for larger sets.  Enough subsets must
agree that, in any order common to all sets, the first few of two linked sets share one.  The
order puts subsets with many uncommon shingles first (a fixed-size table of counts over all
documents tells), so shared passages and empty partitions seldom decide.  A pair shares a
signature whenever it links.

Signatures travel packed, one row per (batch, bucket); a bucket returns each document that
shares a signature with smaller ones beside the smallest of them.  These stars are verified and
components are formed.  Two documents that share a signature have a pivot in common, so what is
left are pairs of different components that met one pivot: a few of each group are held
against the rest, and then all that is outside a group's largest component, where sizes and
parity sketches are compared in blocks and only pairs they leave open become rows.  Every link
is decided on the shingle sets of the whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import U64, chunks, even_labels, mix64, shuffle_width, tasks_for, text_or_empty, utf8
from tidemark.llm.components import components
from tidemark.llm.shingles import Sets, shingle_sets
from tidemark.session import land, settle

PAIRED = 7          # up to PAIRED - 2 differences, pairs of partitions are enumerated
FLUSH = 1 << 20     # signatures packed per batch
SLOTS = 1 << 20     # counters of hashed shingles
BLOCKS = 16         # pieces in which they are added up
COMMON = 3          # a slot this many times fuller than the mean holds a common shingle
PIVOTS = 4          # members of a group that are held against the rest in the first round
PART = 1024         # members of a group held at once
STAR = 64           # members verified beside one copy of a pivot
FILTER_WORDS = 1 << 16   # 64-bit words of the candidate filter: 512 KB at any size


def size_bands(most: int, at_least: int, per: int) -> np.ndarray:
    """First sizes of the bands; a partner of a set is in its own or a neighbouring band."""
    first = [1]
    while first[-1] <= most:
        reach = first[-1] * per // at_least
        first.append(max(reach * per // at_least, first[-1]) + 1)
    return np.array(first, dtype=np.int64)


def _partition(sets: Sets, rows: np.ndarray, parts: np.ndarray, salt: np.ndarray, common: np.ndarray | None = None):
    """Content hash of every partition of ``rows``, parts[i] of them for rows[i], and its
    weight: first by how many of its shingles are not ``common``, then by how many it has."""
    sizes = sets.sizes[rows]
    base = np.concatenate([[0], np.cumsum(parts)])
    cells = int(base[-1])
    place = np.repeat(np.arange(len(rows)), sizes)
    index = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(sets.starts[:-1][rows], sizes)
    hashes = sets.hashes[index]
    part = ((hashes >> U64(32)) * parts[place].astype(U64)) >> U64(32)
    cell = base[:-1][place] + part.astype(np.int64)
    content, weight = np.zeros(cells, dtype=U64), np.zeros(cells, dtype=np.int64)
    if len(cell):
        begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        content[cell[begins]] = np.add.reduceat(mix64(hashes ^ U64(0x5851F42D4C957F2D)), begins)
        rare = np.ones(len(cell), np.int64) if common is None else (~common[(hashes & U64(SLOTS - 1)).astype(np.int64)]).astype(np.int64)
        rare, full = np.add.reduceat(rare, begins), np.diff(np.concatenate([begins, [len(cell)]]))
        weight[cell[begins]] = np.minimum(rare, 15) * 16 + np.minimum(full, 15)
    number = np.arange(cells) - np.repeat(base[:-1], parts)
    owner = np.repeat(np.arange(len(rows)), parts)
    content = mix64(content + mix64(number.astype(U64) * U64(0x9E3779B97F4A7C15) + salt[owner]))
    return content, weight, owner, base


def _enumerate(sets: Sets, rows, tag, limit, widest, parts_of, common) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of ``rows`` under a size band: differences up to limit[i] (band: widest[i])."""
    out_sig, out_row = [], []
    salt = mix64(tag.astype(U64) + U64(77))
    small = widest + 2 <= PAIRED
    for k in np.unique(widest[small]).tolist():
        of = np.flatnonzero(small & (widest == k))
        n = k + 4 if k else 2
        i, j = np.triu_indices(n, 1)
        content, weight, _, _ = _partition(sets, rows[of], np.full(len(of), n), salt[of], common)
        content, weight = content.reshape(-1, n), weight.reshape(-1, n)
        both = mix64(content[:, i] * U64(3) + content[:, j])
        key = ((U64(511) - (weight[:, i] + weight[:, j]).astype(U64)) << U64(55)) | (both >> U64(9))
        best = np.take_along_axis(both, np.argsort(key, axis=1), axis=1)
        # Of the pairs at least C(n - k, 2) look the same, so this many first ones must meet.
        need = len(i) - (n - limit[of]) * (n - limit[of] - 1) // 2 + 1
        out_sig.append(best[np.arange(len(i))[None, :] < need[:, None]])
        out_row.append(np.repeat(rows[of], need))
    of = np.flatnonzero(~small)
    if len(of):
        content, weight, owner, base = _partition(sets, rows[of], parts_of[of], salt[of], common)
        key = ((U64(255) - weight.astype(U64)) << U64(56)) | (content >> U64(8))
        order = np.argsort(key)
        kind = np.uint16 if len(of) < 65536 else np.int64
        order = order[np.argsort(owner[order].astype(kind), kind="stable")]
        rank = np.arange(len(order)) - base[:-1][owner[order]]
        order = order[rank <= limit[of][owner[order]]]
        out_sig.append(content[order])
        out_row.append(rows[of][owner[order]])
    if not out_sig:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_row)


def signatures(sets: Sets, at_least: int, per: int, rows: np.ndarray | None = None, common: np.ndarray | None = None):
    """(signature, row) of every non-empty set; linked sets share at least one signature."""
    sizes = sets.sizes
    rows = np.flatnonzero(sizes > 0) if rows is None else rows
    if len(rows) == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    size = sizes[rows]
    first = size_bands(int(size.max()) * per // at_least + 1, at_least, per)
    band = np.searchsorted(first, size, side="right") - 1

    def apart(a, b):
        return (a + b) * (per - at_least) // (per + at_least)

    reach = size * per // at_least
    last = first[band + 1] - 1
    parts = np.maximum(apart(last, last) + 1, (last * 2 + 4) // 5)
    own = _enumerate(sets, rows, band, apart(size, np.minimum(last, reach)), apart(last, last), parts, common)
    up = np.flatnonzero(reach > last)
    following = first[band[up] + 2] - 1 if len(up) else last[:0]
    # Under the next band the smaller set is from this one; that band's partitioning holds.
    parts = np.maximum(apart(following, following) + 1, (following * 2 + 4) // 5)
    cross = _enumerate(
        sets, rows[up], band[up] + 1, apart(size[up], reach[up]), apart(following, following), parts, common
    )
    return np.concatenate([own[0], cross[0]]), np.concatenate([own[1], cross[1]])


def _tally(width: int):
    """Per task: how many documents' shingles fall into each slot, in blocks of slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in chunks(offsets):
                sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                counts += np.bincount((sets.hashes & U64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        if counts.any():
            blobs = [zlib.compress(c.astype(np.uint32).tobytes(), 1) for c in counts.reshape(BLOCKS, -1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "counts"]
            )

    return run


def _fuller(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64) for c in pdf["counts"])
    marks = np.packbits(total > COMMON * total.mean() + 4).tobytes()
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "marks": [marks]})


def common_slots(docs: DataFrame, width: int) -> np.ndarray:
    """Slots of shingles that far more documents share than others; SLOTS bits at any size."""
    rows = (
        docs.select("text").mapInArrow(_tally(width), "block int, counts binary")
        .groupBy("block").applyInPandas(_fuller, "block int, marks binary").collect()
    )
    marks = np.zeros((BLOCKS, SLOTS // BLOCKS), dtype=bool)
    for r in rows:
        marks[r["block"]] = np.unpackbits(np.frombuffer(r["marks"], np.uint8)).astype(bool)
    return marks.ravel()


def _parity(own: np.ndarray) -> bytes:
    """Parity of the set in each of 1 to 2 bits a shingle: two sketches differ in no more bits
    than their sets do in shingles, and in about half of all bits when the sets have little in
    common."""
    bits = max(64, 1 << int(len(own) - 1).bit_length())
    odd = np.bincount(((own >> U64(7)) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sketch(labels: np.ndarray, width: int, at_least: int, per: int, marks: bytes):
    """Rows (bucket, kind, packed): kind 0 holds signatures of the first of equal sets of a
    batch, kind 1 documents with their set's size, 128-bit mark, parity sketch and first equal
    document."""

    buckets = len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(np.frombuffer(marks, np.uint8)).astype(bool)
        seen: dict[tuple[int, int, int], int] = {}
        held, count = [], 0

        def rows(found, kind, blobs):
            return pa.RecordBatch.from_arrays(
                [pa.array(labels[found].tolist(), pa.int32()), pa.array([kind] * len(found), pa.int32()), pa.array(blobs, pa.binary())],
                names=["bucket", "kind", "packed"],
            )

        def packed():
            sig = np.concatenate([s for s, _ in held])
            doc = np.concatenate([d for _, d in held])
            bucket = (sig % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sig, doc = (sig // U64(buckets))[order], doc[order]
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full, blobs = np.flatnonzero(np.diff(cut)), []
            for b in full:
                ids, place = np.unique(doc[cut[b] : cut[b + 1]], return_inverse=True)
                kind = np.uint16 if len(ids) < 65536 else np.uint32
                blobs.append(
                    np.array([len(ids), len(place)], np.int64).tobytes() + ids.tobytes()
                    + sig[cut[b] : cut[b + 1]].view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
                    + place.astype(kind).tobytes()
                )
            return rows(full.tolist(), 0, blobs)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            for lo, hi in chunks(offsets):
                sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                sizes = sets.sizes
                one, two = np.zeros(hi - lo, dtype=U64), np.zeros(hi - lo, dtype=U64)
                full = np.flatnonzero(sizes)
                if len(full):
                    one[full] = np.add.reduceat(sets.hashes, sets.starts[:-1][full])
                    two[full] = np.add.reduceat(mix64(sets.hashes + U64(1)), sets.starts[:-1][full])
                same, fresh, sketches = np.zeros(hi - lo, np.int64), [], [b""] * (hi - lo)
                for i, (n, a, b) in enumerate(zip(sizes.tolist(), one.tolist(), two.tolist())):
                    doc = int(ids[lo + i])
                    same[i] = seen.setdefault((n, a, b), doc) if n else doc
                    if n and same[i] == doc:
                        fresh.append(i)
                        sketches[i] = _parity(sets.of(i))
                sig, row = signatures(sets, at_least, per, np.array(fresh, dtype=np.int64), common)
                held.append((sig, ids[lo:hi][row]))
                count += len(sig)
                body = np.int64(hi - lo).tobytes() + ids[lo:hi].tobytes() + sizes.tobytes() + same.tobytes()
                body += np.stack([one, two], axis=1).tobytes()
                body += np.array([len(x) for x in sketches], np.int32).tobytes() + b"".join(sketches)
                yield rows([zlib.crc32(body) % buckets], 1, [body])
                if count >= FLUSH:
                    yield packed()
                    held, count = [], 0
        if count:
            yield packed()

    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(blob, np.int64, 2)
    ids = np.frombuffer(blob, np.int64, n, 16)
    raw = np.zeros((m, 8), np.uint8)
    raw[:, :7] = np.frombuffer(blob, np.uint8, 7 * m, 16 + 8 * n).reshape(-1, 7)
    place = np.frombuffer(blob, np.uint16 if n < 65536 else np.uint32, m, 16 + 8 * n + 7 * m)
    return raw.view(U64).ravel(), ids[place]


FOUND = "pivot long, doc long, n_shingles long, same_as long, mark binary, sketch binary"


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: each document that shares a signature with smaller ones, beside the smallest
    (``pivot``); and the documents that were packed into it, without a pivot."""
    kept = pdf["kind"] == 0
    pivot = other = np.zeros(0, np.int64)
    parts = [_unpack(b) for b in pdf.loc[kept, "packed"]]
    if parts:
        sig, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        del parts
        order = np.argsort(sig)
        sig, doc = sig[order], doc[order]
        begins = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        long = np.diff(np.append(begins, len(sig)))
        pivot = np.repeat(np.minimum.reduceat(doc, begins), long)
        apart = pivot != doc
        edges = np.unique(np.stack([pivot[apart], doc[apart]], axis=1), axis=0)
        pivot, other = edges[:, 0], edges[:, 1]
    docs = []
    for body in pdf.loc[~kept, "packed"]:
        n = int(np.frombuffer(body, np.int64, 1)[0])
        long = np.frombuffer(body, np.int32, n, 8 + 40 * n)
        ends = 8 + 44 * n + np.cumsum(long)
        columns = (np.frombuffer(body, np.int64, n, 8 + 8 * n * j).tolist() for j in range(3))
        marks = (body[8 + 24 * n + 16 * i : 24 + 24 * n + 16 * i] for i in range(n))
        docs += [(*x, body[e - l : e]) for *x, l, e in zip(*columns, marks, long.tolist(), ends.tolist())]
    none = [None] * len(pivot)
    return pd.DataFrame(
        {
            "pivot": pd.array(pivot.tolist() + [None] * len(docs), dtype="Int64"),
            "doc": pd.array(other.tolist() + [d[0] for d in docs], dtype="Int64"),
            "n_shingles": pd.array(none + [d[1] for d in docs], dtype="Int64"),
            "same_as": pd.array(none + [d[2] for d in docs], dtype="Int64"),
            "mark": pd.Series(none + [d[3] for d in docs], dtype=object),
            "sketch": pd.Series(none + [d[4] for d in docs], dtype=object),
        }
    )


def _near(at_least: int, per: int):
    """Rows (pivot, doc, sizes and sketches of both): whether these leave the link open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 6)]
            keep = []
            for n, m, a, b in zip(*columns):
                if per * min(n, m) < at_least * max(n, m):
                    keep.append(False)
                    continue
                while len(a) > len(b):
                    a = (int.from_bytes(a[: len(a) // 2], "little") ^ int.from_bytes(a[len(a) // 2 :], "little")).to_bytes(len(a) // 2, "little")
                while len(b) > len(a):
                    b = (int.from_bytes(b[: len(b) // 2], "little") ^ int.from_bytes(b[len(b) // 2 :], "little")).to_bytes(len(b) // 2, "little")
                apart = (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()
                keep.append(apart <= (n + m) * (per - at_least) // (per + at_least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], names=["pivot", "doc", "open"])

    return run


def judged(pairs: DataFrame, own: DataFrame, at_least: int, per: int) -> DataFrame:
    """The pairs (pivot, doc) as pairs of those that stand for their sets, and whether sizes and
    sketches leave the link ``open``; pairs of equal sets are gone.

    ``own`` has per document the size, the sketch and the smallest document of its set (``rep``).
    """
    sides = own.select("doc_id", "rep", "n_shingles", "sketch")
    both = pairs.join(sides.toDF("pivot", "p", "n", "a"), "pivot").join(sides.toDF("doc", "d", "m", "b"), "doc").filter("p != d")
    return both.select(F.col("p").alias("pivot"), F.col("d").alias("doc"), "n", "m", "a", "b").mapInArrow(
        _near(at_least, per), "pivot long, doc long, open boolean"
    )


def _verify(width: int, at_least: int, per: int):
    """Rows (pivot, part, role, doc, text), each pivot before its members: the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot = None, np.zeros(0, U64)
        for batch in batches:
            pivots, parts, roles, docs = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            data, offsets = utf8(batch.column(4))
            us, vs = [], []
            for lo, hi in chunks(offsets):
                sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                for i in range(lo, hi):
                    own = sets.of(i - lo)
                    if roles[i] == 0:
                        key, pivot = (pivots[i], parts[i]), own
                    elif key == (pivots[i], parts[i]) and docs[i] != pivots[i]:
                        short, long = (own, pivot) if len(own) < len(pivot) else (pivot, own)
                        if per * len(short) >= at_least * len(long) and len(short):
                            at = np.minimum(np.searchsorted(long, short), len(long) - 1)
                            both = int((long[at] == short).sum())
                            if per * both >= at_least * (len(own) + len(pivot) - both):
                                us.append(pivots[i])
                                vs.append(docs[i])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts that may be of the given documents: those that a hashed bit filter lets through, so the
    others do not enter the shuffle of the join behind.

    No semi-join follows here: the optimizer would put it before the filter.  The filter has
    ``FILTER_WORDS`` words at any size, so what is broadcast is bounded; when it fills up it only
    lets more rows through to the join behind it.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_WORDS * 64))
    marked = ids.select(F.col("doc").alias("doc_id"))
    words = marked.select((slot / 64).cast("int").alias("word"), (slot % 64).cast("int").alias("bit")).groupBy("word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")
    )
    return (
        docs.withColumns({"word": (slot / 64).cast("int"), "bit": (slot % 64).cast("int")})
        .join(F.broadcast(words), "word").filter(F.getbit("bits", F.col("bit")) == 1).select("doc_id", "text")
    )


def verify(docs: DataFrame, pairs: DataFrame, width: int, at_least: int, per: int, tasks: int) -> DataFrame:
    """Of the pairs (pivot, doc), those whose shingle sets are similar enough, as (u, v).

    ``tasks`` is how many the seats, rows of a few numbers, are written by.
    """
    degree = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    members = pairs.join(degree, "pivot").select(
        "pivot", F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / STAR)).cast("int").alias("part"), F.lit(1).alias("role"), "doc"
    )
    heads = members.select("pivot", "part", F.lit(0).alias("role"), F.col("pivot").alias("doc")).distinct()
    seats = settle(members.union(heads).coalesce(tasks))
    texts = _texts_of(docs, seats.select("doc").distinct())
    rows = seats.join(texts, seats["doc"] == texts["doc_id"]).select("pivot", "part", "role", "doc", "text")
    rows = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "role", "doc")
    return rows.mapInArrow(_verify(width, at_least, per), "u long, v long")


def open_seats(edges: DataFrame, fresh: DataFrame, joined: DataFrame, tasks: int) -> DataFrame:
    """A pivot and what met it are a group; the members of groups that lie in several components.

    ``rest`` holds for members outside the group's largest component.  Only counts per group and
    component are gathered.
    """
    nodes = fresh.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n")).join(
        joined.withColumnRenamed("node", "doc"), "doc", "left"
    ).withColumn("component", F.coalesce("component", "doc"))
    members = edges.select(F.col("gid"), "doc").union(edges.select("gid", "gid")).distinct()
    seats = settle(members.join(nodes, "doc").select("gid", "doc", "n", "component").coalesce(4 * tasks))
    parts = seats.groupBy("gid", "component").agg(F.count(F.lit(1)).alias("many"))
    groups = parts.groupBy("gid").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("many", -F.col("component"))).alias("largest"))
    return settle(seats.join(groups.filter("parts > 1").select("gid", "largest"), "gid").withColumn("rest", F.col("component") != F.col("largest")).drop("largest").coalesce(tasks))


def few_heads(seats: DataFrame) -> DataFrame:
    """Up to ``PIVOTS`` members of each group from outside its largest component, by least hashes."""
    rest = seats.filter("rest")
    one = F.struct("doc", "component", "n")
    picked = rest.groupBy("gid").agg(*[F.min_by(one, F.xxhash64("doc", F.lit(i))).alias(f"h{i}") for i in range(PIVOTS)])
    heads = picked.select("gid", F.explode(F.array_distinct(F.array(*[f"h{i}" for i in range(PIVOTS)]))).alias("h"))
    return heads.select("gid", F.col("h.doc").alias("head"), F.col("h.component").alias("c"), F.col("h.n").alias("m"))


def _hold(at_least: int, per: int):
    """Rows (gid, part, role, component, doc, n, sketch), members (role 0) before heads (role 1)
    of a part: the pairs of different components that sizes and sketches leave open."""

    def folded(table: np.ndarray, words: int) -> np.ndarray:
        while table.shape[1] > words:
            half = table.shape[1] // 2
            table = table[:, :half] ^ table[:, half:]
        return table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, tables = None, [], None
        for batch in batches:
            us, vs = [], []
            for gid, part, role, component, doc, n, sketch in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if key != (gid, part):
                    key, members, tables = (gid, part), [], None
                if role == 0:
                    members.append((component, doc, n, sketch))
                    continue
                if tables is None:
                    by: dict[int, list] = {}
                    for m in members:
                        by.setdefault(len(m[3]), []).append(m)
                    tables = [
                        (*(np.array([m[j] for m in v]) for j in range(3)), np.frombuffer(b"".join(m[3] for m in v), U64).reshape(len(v), -1))
                        for v in by.values()
                    ]
                for components_, ids, sizes, table in tables:
                    fits = (per * np.minimum(sizes, n) >= at_least * np.maximum(sizes, n)) & (components_ != component)
                    if fits.any():
                        words = min(table.shape[1], len(sketch) // 8)
                        own = folded(np.frombuffer(sketch, U64)[None, :], words)
                        off = np.bitwise_count(folded(table[fits], words) ^ own).sum(axis=1)
                        near = ids[fits][off <= (sizes[fits] + n) * (per - at_least) // (per + at_least)]
                        us += np.minimum(near, doc).tolist()
                        vs += np.maximum(near, doc).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["pivot", "doc"])

    return run


def apart(seats: DataFrame, fresh: DataFrame, at_least: int, per: int) -> DataFrame:
    """Pairs of a group that may link two of its components.

    A group's members are held in parts of ``PART``, and those outside its largest component
    pass by each part; only pairs that stay open become rows.
    """
    size = seats.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    own = seats.join(size, "gid").join(fresh.select(F.col("doc_id").alias("doc"), "sketch"), "doc")
    held = own.select("gid", F.pmod(F.xxhash64("doc"), F.col("parts")).alias("part"), F.lit(0).alias("role"), "component", "doc", "n", "sketch")
    heads = own.filter("rest").select(
        "gid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), "component", "doc", "n", "sketch"
    )
    rows = held.union(heads).repartition("gid", "part").sortWithinPartitions("gid", "part", "role", "doc")
    return rows.mapInArrow(_hold(at_least, per), "pivot long, doc long").distinct()


def all_links(docs: DataFrame, edges: DataFrame, fresh: DataFrame, width: int, at_least: int, per: int, tasks: int) -> DataFrame:
    """Every link (u, v) of two sets in ``fresh``.

    Linked sets share a signature, so both are in the group of its pivot: all members of a group
    are held against each other, in whatever component they are.
    """
    members = edges.select("gid", "doc").union(edges.select("gid", "gid")).distinct()
    own = members.join(fresh.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n")), "doc")
    seats = settle(own.select("gid", "doc", "n", F.col("doc").alias("component"), F.lit(True).alias("rest")))
    return verify(docs, settle(apart(seats, fresh, at_least, per)), width, at_least, per, tasks).distinct()


def link_counts(sizes: DataFrame, links: DataFrame) -> DataFrame:
    """Links of every document of ``sizes``: with the copies of its own set, and of the sets linked to it."""
    copies = settle(sizes.groupBy("same_as").agg(F.count(F.lit(1)).alias("copies")))
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    beside = both.join(copies, both["v"] == copies["same_as"]).groupBy("u").agg(F.sum("copies").alias("beside"))
    of_set = copies.join(beside, copies["same_as"] == beside["u"], "left").select(
        "same_as", (F.col("copies") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links")
    )
    return sizes.join(of_set, "same_as").select(F.col("doc_id").alias("u"), "n_links")


def ngram_join(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, at_least: int = 75, per: int = 100,
    with_links: bool = True,
) -> DataFrame:
    """Link documents of Jaccard similarity >= at_least / per on ``width``-word shingles.

    Returns one row per distinct id: ``doc_id``, ``n_shingles``, ``component_id`` (smallest
    id reachable by links, itself included), ``n_links`` (all documents it links with, copies
    included).  Components need only some of the links; without ``with_links`` the others are
    not looked for and the column is left out.  A to Z are lower-cased; words are runs of
    anything but the six ASCII white-space characters.

    Null or blank texts have an empty set and are alone.  Fewer words than ``width`` make one
    shingle.  Rows with a null id are left out; ids are keys, so rows that repeat an id repeat
    its text, and count once.  Similarity exactly at the bound links.  An empty table gives an empty
    result.  Other columns of ``df`` are not read, so their names cannot clash.
    """
    spark = df.sparkSession
    docs = df.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")
    )
    labels = even_labels(spark, 2 * shuffle_width(spark))
    marks = np.packbits(common_slots(docs, width)).tobytes()
    sketch = land(
        docs.mapInArrow(_sketch(labels, width, at_least, per, marks), "bucket int, kind int, packed binary")
        .groupBy("bucket").applyInPandas(_meet, FOUND),
        "ngram-meetings",
    )
    known = sketch.filter("pivot is null").withColumnRenamed("doc", "doc_id")
    # Tables of small rows take tasks by the number of documents, not by the width of the shuffle.
    few = tasks_for(known.count())
    # A repeated id keeps one row.  Equal sets are known by size and mark, in whatever task they
    # were met; the smallest document stands for them all.
    first = known.filter("n_shingles > 0 and same_as = doc_id").groupBy("doc_id").agg(
        F.max("n_shingles").alias("n_shingles"), F.max_by("mark", "n_shingles").alias("mark"), F.max_by("sketch", "n_shingles").alias("sketch")
    )
    reps = known.filter("n_shingles > 0").groupBy("n_shingles", "mark").agg(F.min("doc_id").alias("rep"))
    own = settle(first.join(reps, ["n_shingles", "mark"]).select("doc_id", "n_shingles", "sketch", "rep").coalesce(few))
    fresh = own.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles"), F.max_by("sketch", "n_shingles").alias("sketch")).withColumn("doc_id", F.col("rep"))
    sizes = known.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("same_as").alias("__first")).join(
        own.select(F.col("doc_id").alias("__first"), "rep"), "__first", "left"
    ).select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("same_as"))
    met = settle(judged(sketch.filter("pivot is not null").select("pivot", "doc").distinct(), own, at_least, per).distinct().coalesce(4 * few))
    # Sets that share a signature have its pivot's set in common: that is their group.
    edges = met.select(F.col("pivot").alias("gid"), "doc")
    links = settle(verify(docs, met.filter("open").select("pivot", "doc"), width, at_least, per, few).distinct().coalesce(few))
    # A few more pivots join most of what belongs together; then the rest is held apart.
    seats = open_seats(edges, fresh, components(links), few)
    heads = few_heads(seats)
    alike = (F.col("n") * per >= F.col("m") * at_least) & (F.col("m") * per >= F.col("n") * at_least)
    pairs = seats.join(heads, "gid").filter((F.col("c") != F.col("component")) & alike).select(F.col("head").alias("pivot"), "doc").distinct()
    pairs = judged(pairs, fresh, at_least, per).filter("open").select("pivot", "doc").distinct()
    links = settle(links.union(verify(docs, pairs, width, at_least, per, few)).distinct().coalesce(few))
    seats = open_seats(seats.select("gid", "doc"), fresh, components(links), few)
    pairs = settle(apart(seats, fresh, at_least, per).coalesce(few))
    links = settle(links.union(verify(docs, pairs, width, at_least, per, few)).distinct().coalesce(few))
    joined = components(links)
    found = sizes.join(joined, sizes["same_as"] == joined["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "same_as").alias("component_id")
    )
    if not with_links:
        return found
    counts = link_counts(sizes, settle(all_links(docs, edges, fresh, width, at_least, per, few)))
    return found.join(counts, found["doc_id"] == counts["u"], "left").select(
        "doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of every group of linked rows the one with
    the smallest id.

    Where ids repeat or are null, rows are joined by their place in a written copy instead of by id,
    so texts of one id are sets of their own and every row is judged; a null id counts as the
    largest, and of rows tied on the id one stays.
    """
    odd = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull())
    if odd.isEmpty():
        gone = ngram_join(df, id_col, text_col, with_links=False, **settings).filter("doc_id != component_id").select(F.col("doc_id").alias("__gone"))
        return df.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    rows = land(df.withColumn("__row", F.monotonically_increasing_id()), "numbered-rows")
    joined = ngram_join(rows, "__row", text_col, with_links=False, **settings).select(F.col("doc_id").alias("__row"), "component_id")
    ids = rows.select("__row", F.col(id_col).cast("long").alias("__id")).join(joined, "__row")
    stay = ids.groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__row")).alias("best")).select(F.col("best.__row").alias("__row"))
    return rows.join(stay, "__row", "left_semi").drop("__row")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
  WHERE 100 * common >= 75 * (len(a.s) + len(b.s) - common)),
near AS (SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links),
reach(u, v) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT reach.u, near.v FROM reach JOIN near ON reach.v = near.u),
least AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least.c AS component_id
FROM sets s JOIN least ON least.u = s.doc_id
"""
