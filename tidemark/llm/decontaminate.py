"""Benchmark passages in documents, by a prefix-filtered set join.  Built-in functions only.

Every item is cut into windows of ``length`` words, and a window into shingles of a few words.
Shingles are ordered by how rare they are in all documents.  A document that holds a window holds
all of its shingles, so the prefix it must share is one shingle: the rarest.  Windows with a
shingle no document holds are gone.  Documents meet windows by that one shingle; its place in
the window gives the place of the window, which has to lie inside the document (length and
positional bounds), and the words from there on are compared one by one.

While windows are a table of checked size, they are broadcast, and a text is cut, matched and
verified in one pass without being shuffled; only hits leave it.  Larger sets of windows meet the
documents' shingles in a shuffle, behind a bit filter of fixed size, and the texts once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import text_or_empty
from tidemark.session import BROADCAST_BYTES, BROADCAST_ROWS, attach, settle

LENGTH = 10
SHINGLE = 4
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTER_WORDS = 1 << 18  # 64-bit words of the bit filter: 2 MB at any size


def words_of(text_col: str) -> Column:
    return F.regexp_extract_all(F.translate(text_or_empty(text_col), CAPITALS, CAPITALS.lower()), F.lit(WORDS), F.lit(0))


def token(width: int | Column, words: str, at: Column, most: int) -> Column:
    """Hash of the shingle of ``width`` words at ``at``; places behind the end do not enter it."""
    many = most if isinstance(width, Column) else width
    return F.xxhash64(F.lit(width).cast("int"), *[F.get(words, at + j) for j in range(many)])


def item_windows(items: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, words, n, gid), and the items (gid, item) that hold a window.

    Windows held by the same items share a ``gid``.
    """
    cut = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(text_col).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - length, F.lit(0))
    rows = cut.select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("i")).select("item", F.slice("w", F.col("i") + 1, length).alias("words"))
    rows = settle(rows.distinct())
    # Items of a window are known by their number and two sums of hashes; no list is gathered.
    windows = rows.groupBy("words").agg(
        F.count(F.lit(1)).alias("many"), F.bit_xor(F.xxhash64("item")).alias("one"),
        F.sum(F.xxhash64("item", F.lit(1)).cast("decimal(38,0)")).alias("two"), F.min("item").alias("least"),
    ).withColumn("gid", F.concat_ws(":", "many", "one", "two", "least"))
    windows = settle(windows.select(F.monotonically_increasing_id().alias("wid"), "words", F.size("words").alias("n"), "gid"))
    heads = windows.groupBy("gid").agg(F.min("wid").alias("wid")).join(windows.drop("gid"), "wid")
    return windows, settle(rows.join(heads, "words").select("gid", "item"))


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """Rows (wid, offset, width, token): every shingle of every window."""
    width = F.least(F.col("n"), F.lit(shingle))
    rows = windows.select("wid", "words", width.alias("width"), F.explode(F.sequence(F.lit(0), F.col("n") - width)).alias("offset"))
    return rows.select("wid", "offset", "width", token(F.col("width"), "words", F.col("offset"), shingle).alias("token"))


def positions(docs: DataFrame, widths: list[int]) -> DataFrame:
    """A row per document and word place with the shingles that begin there, and one behind the
    last word of each document (``place`` = ``n``) whose shingle is never held.

    The words stay in the row: they are compared in the stage that makes it, and left behind there.
    """
    rows = docs.select(
        "doc_id", "key", "w", F.size("w").alias("n"),
        F.posexplode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("place", "__word"),
    ).drop("__word")
    found = [F.struct(F.lit(k).alias("width"), token(k, "w", F.col("place"), k).alias("token")) for k in widths]
    if len(found) == 1:
        return rows.withColumns({"width": F.lit(widths[0]), "token": token(widths[0], "w", F.col("place"), widths[0])})
    return rows.withColumn("__t", F.explode(F.array(*found))).select("doc_id", "key", "w", "n", "place", "__t.width", "__t.token").filter(
        (F.col("place") < F.col("n")) | (F.col("width") == widths[0])
    )


def _fits(table: DataFrame, max_rows: int) -> bool:
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in table.columns), F.lit(0))
    n, many = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= max_rows and many <= BROADCAST_BYTES


def _maybe(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows whose token a bit filter of fixed size does not exclude; it is broadcast."""
    slot = F.pmod(F.col("token"), F.lit(FILTER_WORDS * 64))
    bits = tokens.select((slot / 64).cast("int").alias("__word"), (slot % 64).cast("int").alias("bit")).groupBy("__word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("__bits")
    )
    rows = rows.withColumn("__word", (slot / 64).cast("int")).join(F.broadcast(bits), "__word")
    return rows.filter(F.getbit("__bits", (slot % 64).cast("int")) == 1).drop("__word", "__bits")


def token_counts(docs: DataFrame, tokens: DataFrame, widths: list[int], max_rows: int) -> DataFrame:
    """How often each of ``tokens`` occurs in all documents."""
    rows = positions(docs, widths).filter(F.col("place") + F.col("width") <= F.col("n")).select("token")
    if _fits(tokens, max_rows):
        rows = rows.join(F.broadcast(tokens), "token")
    else:
        rows = _maybe(rows, tokens).join(tokens, "token")
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("many"))


def prefixes(windows: DataFrame, shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows with the token and offset of their rarest shingle; those that cannot occur are gone."""
    best = shingles.join(counts, "token", "left").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "token", "offset", "width")).alias("best")
    ).filter("best.many > 0")
    return best.join(windows, "wid").select(
        "wid", "gid", F.col("best.token").alias("token"), F.col("best.offset").alias("offset"), F.col("words").alias("__words"), F.col("n").alias("long")
    )


def occurrences(docs: DataFrame, prefix: DataFrame, widths: list[int], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows (doc_id, key, n, start, end, gid) of every window found, and one without a window per document."""
    rows = positions(docs, widths)
    start = F.col("place") - F.col("offset")
    inside = (F.col("place") + F.col("width") <= F.col("n")) & (start >= 0) & (start + F.col("long") <= F.col("n"))
    shape = ["doc_id", "key", "n", start.alias("start"), (start + F.col("long")).alias("end"), "gid"]
    if _fits(prefix, max_rows):
        own = prefix.withColumnRenamed("token", "__token")
        same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("long")) == F.col("__words")
        held = rows.join(F.broadcast(own), (rows["token"] == own["__token"]) & inside & same, "left")
        return held.filter(F.col("gid").isNotNull() | (F.col("place") == F.col("n"))).select(shape)
    met = _maybe(rows.drop("w"), prefix.select("token")).join(prefix, "token").filter(inside)
    open_ = met.groupBy("doc_id", "key").agg(F.collect_set(F.struct(start.alias("start"), "long", "__words", "gid")).alias("open"))
    other = open_.toDF("__id", "__key", "open")
    checked = docs.dropDuplicates(["doc_id", "key"]).join(other, docs["doc_id"].eqNullSafe(other["__id"]) & (docs["key"] == other["__key"]))
    found = checked.select(
        "doc_id", "key", F.size("w").alias("n"),
        F.explode(F.filter("open", lambda c: F.slice(F.col("w"), c["start"] + 1, c["long"]) == c["__words"])).alias("c"),
    ).select("doc_id", "key", "n", "c.start", (F.col("c.start") + F.col("c.long")).alias("end"), "c.gid")
    nothing = F.lit(None)
    alone = docs.select("doc_id", "key", F.size("w").alias("n"), nothing.cast("int").alias("start"), nothing.cast("int").alias("end"), nothing.cast("string").alias("gid"))
    return found.union(alone)


def decontaminate(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    length: int = LENGTH, shingle: int = SHINGLE, max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Which words of each document lie in a window of a benchmark item.

    A to Z are lower-cased; words are runs of digits, letters and anything beyond ASCII.  A window
    is ``length`` consecutive words of an item; an item of fewer, but not none, is one window.
    Returns a row per row of ``df``: ``doc_id``, ``n_words``, ``n_hit`` (words inside any
    occurrence of a window), ``n_items`` (items with occurring windows), ``items_sha256`` (of
    their ids, sorted as strings, joined by commas), ``contaminated``.

    Null texts have no words.  Rows that repeat id and text, and rows with a null id, are rows of
    their own.  Several texts of one item id are one item; a null item id is the item ''.  Without
    items nothing is hit, without documents the result is empty.  Other columns are not read.
    """
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("key"), words_of(text_col).alias("w")
    )
    windows, held = item_windows(items, item_col, item_text, length)
    shingles = settle(window_shingles(windows, shingle))
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect()) or [shingle]  # ``shingle`` of them at most
    tokens = settle(shingles.select("token").distinct())
    prefix = settle(prefixes(windows, shingles, token_counts(docs, tokens, widths, max_rows)))
    spans = F.collect_set(F.when(F.col("gid").isNotNull(), F.struct("start", "end")))
    covered = (
        "aggregate(array_sort(spans), named_struct('upto', 0, 'n', 0L), (a, s) -> named_struct('upto', greatest(a.upto, s.end), "
        "'n', a.n + cast(greatest(0, s.end - greatest(a.upto, s.start)) as bigint)), a -> a.n)"
    )
    found = settle(
        occurrences(docs, prefix, widths, max_rows).groupBy("doc_id", "key", "n").agg(
            F.count(F.when(F.col("gid").isNull(), 1)).alias("copies"), spans.alias("spans"), F.collect_set("gid").alias("gids")
        ).select("doc_id", "key", "n", "copies", "gids", F.expr(covered).alias("n_hit"))
    )
    hit = attach(found.filter("n_hit > 0").select("doc_id", "key", F.explode("gids").alias("gid")).distinct(), held, ["gid"], "inner")
    listed = hit.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    full = found.join(listed, found["doc_id"].eqNullSafe(listed["__id"]) & (found["key"] == listed["__key"]), "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return full.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), "n_hit", F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy"),
    ).drop("__copy")


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS s, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT r, i, places.n, item FROM places JOIN windows USING (s, n)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
listed AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""
