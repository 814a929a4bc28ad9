"""Document fingerprints that subtract: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs by its own words: a word ends a paragraph when the hash of it and
the two before it is a multiple of a step that follows the text's length, so texts of any length
have about as many paragraphs, and an insertion moves only the cuts beside it.  Where no word
does so for twice the step, a cut is made there, so a text of few different words has paragraphs
too; these cuts are in step again behind the next one that the words make.  Words have at most
8 code points: longer ones count as several, runs without white space far beyond that as single
code points.  Paragraphs of the step and of twice the step are both kept, so texts whose lengths
differ by up to twice share a level.

Each digest goes into one cell of each of three tables; a cell holds a count and the exclusive
or of its digests, which carry a checksum.  Two sketches subtract cell by cell: what the texts
share vanishes, and peeling (a cell with count 1 or -1 and a valid checksum gives a digest,
which leaves its other cells) recovers what differs.  A pair that does not peel is sketched
larger and tried again until it does.  DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import shuffle_width
from tidemark.session import land, settle

# Words of up to 24 code points in pieces of 8; of longer ones all but the last 24 one by one.
UNITS = r"[^\x20\x09-\x0D]{1,8}(?=[^\x20\x09-\x0D]{0,16}+(?![^\x20\x09-\x0D]))[\x20\x09-\x0D]?|[^\x20\x09-\x0D]|[\x20\x09-\x0D]"
BLANKS = "\t\n\x0b\x0c\r"
LONGEST = 2        # steps without a cut before one is made
PARAGRAPHS = 48    # code points of the text per word of a paragraph: about 8 to 16 paragraphs
CELLS = 20         # cells of one of the three tables, at first
STEPS = 30         # peeling steps, a table each
SAMPLED = 32       # ids a bucket that are looked at for even buckets

STATE = "struct<x:array<struct<c:int,k:bigint>>,y:array<struct<c:int,k:bigint>>,z:array<struct<c:int,k:bigint>>,left:int,right:int>"


def step_of(chars: Column) -> Column:
    """Words of a paragraph, a power of two that grows with the text."""
    return F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(chars / PARAGRAPHS, F.lit(1.0))))).cast("long")


def digests(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the distinct paragraph digests of column ``text``: 40 hashed bits under 24 of checksum."""
    units = F.regexp_extract_all(F.translate(F.col(text), BLANKS, " " * len(BLANKS)), F.lit(UNITS), F.lit(0))
    units = F.when(F.char_length(text) == 0, F.array(F.lit(""))).otherwise(units)
    df = df.withColumns({"__h": F.transform(units, lambda w: F.xxhash64(w)), "__s": step_of(F.char_length(text))})
    # Low bits, which decide, come from all three words.
    met = "element_at(__h, i) ^ shiftrightunsigned(coalesce(get(__h, i - 2), 0L), 21) ^ shiftrightunsigned(coalesce(get(__h, i - 3), 0L), 42)"
    df = df.withColumn(
        "__marks", F.expr(f"filter(transform(sequence(1, size(__h)), i -> struct(i as i, {met} as m)), c -> pmod(c.m, __s) = 0 or c.i = size(__h))")
    )
    df = df.withColumn("__ends", F.expr("transform(__marks, c -> c.i)"))
    df = df.withColumn("__wide", F.expr("transform(filter(__marks, c -> pmod(c.m, 2 * __s) = 0 or c.i = size(__h)), c -> c.i)"))
    made = (
        "flatten(zip_with({e}, concat(array(0), slice({e}, 1, size({e}) - 1)), (e, p) -> if(e - p <= {most}, array(e), "
        "concat(sequence(p + {most}, e - 1, {most}), array(e)))))"
    )
    df = df.withColumn("__ends", F.expr(made.format(e="__ends", most=f"cast({LONGEST} * __s as int)")))
    df = df.withColumn("__wide", F.expr(made.format(e="__wide", most=f"cast({LONGEST} * 2 * __s as int)")))
    cut = "zip_with({e}, concat(array(0), slice({e}, 1, size({e}) - 1)), (e, p) -> xxhash64(slice(__h, p + 1, e - p), {s}) & 1099511627775L)"
    df = df.withColumn("__low", F.expr(f"array_distinct(concat({cut.format(e='__ends', s='__s')}, {cut.format(e='__wide', s='2L * __s')}))"))
    checked = F.expr("transform(__low, d -> d | shiftleft(xxhash64(d), 40))")
    return df.withColumn(name, F.when(F.char_length(text) == 0, F.array().cast("array<long>")).otherwise(checked)).drop(
        "__h", "__s", "__marks", "__ends", "__wide", "__low"
    )


def _valid(key: str) -> str:
    return f"{key} != 0 and shiftleft(xxhash64({key} & 1099511627775L), 40) | ({key} & 1099511627775L) = {key}"


def sketch(keys: str, cells: int) -> Column:
    """The three tables of the digests in column ``keys``."""
    tables = []
    for t in range(3):
        seats = f"transform({keys}, k -> struct(k as k, cast(pmod(xxhash64(k, {t}), {cells}) as int) as i))"
        tables.append(
            f"transform(array({seats}), s -> transform(sequence(0, {cells - 1}), i -> aggregate(filter(s, p -> p.i = i), "
            f"named_struct('c', 0, 'k', 0L), (a, p) -> named_struct('c', a.c + 1, 'k', a.k ^ p.k))))[0]"
        )
    return F.expr(f"array({', '.join(tables)})")


def written(cells: str) -> Column:
    """A sketch as text: count and digests of each cell in hexadecimal, tables one after another."""
    return F.expr(
        f"array_join(transform({cells}, t -> array_join(transform(t, c -> if(c.c = 0 and c.k = 0, '', concat(hex(c.c), ':', hex(c.k)))), ',')), ';')"
    )


def peel(one: str, other: str, cells: int) -> Column:
    """(left, right): digests only in ``one`` and only in ``other``; null when peeling stops early.

    A step empties the pure cells of table x; each of their digests lies in one cell of y and
    one of z.  Then the tables change places, so the next step looks at the next table.
    """
    less = "zip_with({a}[{t}], {b}[{t}], (a, b) -> named_struct('c', a.c - b.c, 'k', a.k ^ b.k))"
    x, y, z = (less.format(a=one, b=other, t=t) for t in range(3))
    start = f"cast(named_struct('x', {x}, 'y', {y}, 'z', {z}, 'left', 0, 'right', 0) as {STATE})"
    pure = f"filter(s.x, c -> abs(c.c) = 1 and {_valid('c.k')})"
    seats = (
        f"transform({pure}, c -> struct(c.c as c, c.k as k, cast(pmod(xxhash64(c.k, (r + 1) % 3), {cells}) as int) as y, "
        f"cast(pmod(xxhash64(c.k, (r + 2) % 3), {cells}) as int) as z))"
    )

    def without(table: str) -> str:
        return (
            f"transform(s.{table}, (c, i) -> aggregate(filter(q, p -> p.{table} = i), c, "
            f"(a, p) -> named_struct('c', a.c - p.c, 'k', a.k ^ p.k)))"
        )

    gone = f"transform(s.x, c -> if(abs(c.c) = 1 and {_valid('c.k')}, named_struct('c', 0, 'k', 0L), c))"
    moved = (
        f"transform(array({seats}), q -> if(size(q) = 0, named_struct('x', s.y, 'y', s.z, 'z', s.x, 'left', s.left, 'right', s.right), "
        f"named_struct('x', {without('y')}, 'y', {without('z')}, 'z', {gone}, "
        f"'left', s.left + size(filter(q, p -> p.c > 0)), 'right', s.right + size(filter(q, p -> p.c < 0)))))[0]"
    )
    empty = "forall(s.{t}, c -> c.c = 0 and c.k = 0)"
    done = " and ".join(empty.format(t=t) for t in "xyz")
    return F.expr(
        f"aggregate(sequence(0, {STEPS - 1}), {start}, (s, r) -> cast({moved} as {STATE}), "
        f"s -> if({done}, named_struct('left', s.left, 'right', s.right), null))"
    )


def likeness(own: str, other: str, found: str) -> Column:
    """Shared digests over all digests of the two, from their numbers and what peeling found."""
    apart = F.col(f"{found}.left") + F.col(f"{found}.right")
    both = (F.size(own) + F.size(other) - apart) / 2
    return F.when(both + apart == 0, F.lit(1.0)).otherwise(both / (both + apart))


def compared(pairs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Rows (seat, one, other) of digests, with their likeness by sketches; whatever does not
    peel is tried again with twice the cells."""
    out, shape = None, ["seat", "likeness"]
    while True:
        tried = pairs.withColumn("__one", sketch("one", cells)).withColumn("__other", sketch("other", cells))
        tried = settle(tried.withColumn("found", peel("__one", "__other", cells)).drop("__one", "__other"))
        good = tried.filter("found is not null").withColumn("likeness", likeness("one", "other", "found")).select(shape)
        out = good if out is None else out.union(good)
        pairs = tried.filter("found is null").drop("found")
        if pairs.isEmpty():
            return out
        cells *= 2


def _with_next(docs: DataFrame) -> DataFrame:
    """Every document with the text of the next one in id order; the first follows the last.

    Bounds of buckets of like size are taken from distinct ids that their hash picks, about
    ``SAMPLED`` a bucket; a bucket's rows are ordered in one task, with the first row of the next
    bucket behind them.
    """
    width = 2 * shuffle_width(docs.sparkSession)
    n = docs.count()
    if not n:
        return docs.withColumn("next_text", F.lit(None).cast("string"))
    every = max(1, n // (SAMPLED * width))
    picked = sorted(r[0] for r in docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("doc_id").distinct().collect())
    bounds = sorted({picked[len(picked) * i // width] for i in range(1, width)}) if picked else []
    within = F.array(*map(F.lit, bounds)).cast("array<long>")
    rows = docs.withColumn("bucket", F.size(F.filter(within, lambda b: b <= F.col("doc_id")))).withColumn("last", F.lit(0))
    heads = rows.groupBy("bucket").agg(F.min("doc_id").alias("doc_id"))
    order = Window.orderBy("bucket")
    heads = heads.withColumn("to", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())))
    first = docs.join(F.broadcast(heads.select("doc_id", "to")), "doc_id").groupBy("doc_id", "to").agg(F.min("text").alias("text"))
    rows = rows.select("bucket", "last", "doc_id", "text").union(first.select("to", F.lit(1), "doc_id", "text"))
    seats = Window.partitionBy("bucket").orderBy("last", "doc_id", "text")
    return rows.withColumns(
        {"next_text": F.lead("text").over(seats), "seat": F.row_number().over(seats)}
    ).filter("last = 0").drop("last")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next one are.

    The edited text has the last floor(n / 2) of n code points replaced by the first as many
    (or all) of the next document in ascending id, the first following the last.  Returns per
    row: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next`` (shared paragraph digests over all of both, 0 to 1).

    A null text counts as empty; an empty text has an empty sketch, alike (1) to an empty one.
    Rows that share an id follow each other by text.  A single row is its own next document.
    Rows with a null id are left out.  An empty table gives an empty result.  Other columns
    are not read.
    """
    docs = df.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    if docs.isEmpty():
        return df.sparkSession.createDataFrame(
            [], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
        )
    rows = _with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = digests(digests(rows, "text", "own"), "edited", "changed")
    marked = land(
        rows.select(
            "bucket", "seat", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "changed"
        ),
        "fingerprint-digests",
    )
    heads = marked.filter("seat = 1").select("bucket", "own")
    order = Window.orderBy("bucket")
    heads = heads.withColumn("to", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())))
    follows = marked.select("bucket", "seat", "doc_id", "own", "changed", "n_chars", "edited_sha256").withColumn(
        "following", F.lead("own").over(Window.partitionBy("bucket").orderBy("seat"))
    ).join(F.broadcast(heads.select(F.col("to").alias("bucket"), F.col("own").alias("head"))), "bucket")
    follows = follows.withColumn("following", F.coalesce("following", "head")).drop("head")
    tried = follows.withColumns({"a": sketch("own", CELLS), "b": sketch("changed", CELLS), "c": sketch("following", CELLS)})
    tried = tried.withColumns({"fingerprint": written("a"), "edited_fingerprint": written("b"), "found_edited": peel("a", "b", CELLS), "found_next": peel("a", "c", CELLS)})
    tried = land(tried.drop("a", "b", "c"), "fingerprint-sketches")
    left = []
    for kind, other in (("edited", "changed"), ("next", "following")):
        left.append(
            tried.filter(f"found_{kind} is null").select(F.struct("bucket", "seat", F.lit(kind).alias("kind")).alias("seat"), F.col("own").alias("one"), F.col(other).alias("other"))
        )
    again = left[0].union(left[1])
    tried = tried.withColumns({"near_edited": likeness("own", "changed", "found_edited"), "near_next": likeness("own", "following", "found_next")})
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    if again.isEmpty():
        return tried.select(columns)
    more = compared(again, 2 * CELLS).groupBy(F.col("seat.bucket").alias("bucket"), F.col("seat.seat").alias("seat")).agg(
        F.max(F.when(F.col("seat.kind") == "edited", F.col("likeness"))).alias("e"), F.max(F.when(F.col("seat.kind") == "next", F.col("likeness"))).alias("n")
    )
    return tried.join(more, ["bucket", "seat"], "left").withColumns(
        {"near_edited": F.coalesce("near_edited", "e"), "near_next": F.coalesce("near_next", "n")}
    ).select(columns)
