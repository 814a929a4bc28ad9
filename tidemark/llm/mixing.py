"""Mixing sources to target weights, block by block, with DataFrame functions only.

Each source's documents stand one behind the other and are cut into blocks of ``block``
words.  The output is a row of slots, a fixed number to a shard.  Every shard draws its
source counts from the multinomial of the targets; the draws are conditioned on the whole
mix holding each source's quota, which makes them a pseudorandom deal of the quotas over all
slots.  The k-th slot of a source takes the block that the source's pseudorandom index
permutation of that pass puts at k, so a block is used once more than another at most.
Slots and documents meet by (source, block index).

Both permutations are swap-or-not shuffles: in each round a number x and its mirror
(key - x) mod n trade places or not by a hash of the larger one, which is a bijection of
0 … n - 1 for any n and needs no table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import WORD, shuffle_width, text_or_empty
from tidemark.session import land, settle

BLOCK = 64
SHARD = 4096         # slots of an output shard
WEIGHTS = (1, 2, 3)
MOST = 3             # times a source may be repeated
ROUNDS = 20
CHUNK_ROWS = 20_000  # rows whose running sum one task forms
SMALL = 100_000      # sources up to which their table is broadcast
DIALS = 1024         # equal pieces of the slots' range through which a slot finds its source


def permuted(x: str, n: str, seed: str) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0 … n - 1; all three are SQL."""
    return F.expr(
        f"aggregate(sequence(0, {ROUNDS - 1}), cast({x} as bigint), (x, r) -> "
        f"transform(array(pmod(pmod(xxhash64({seed}, r), {n}) - x, {n})), m -> if(xxhash64({seed}, r, greatest(x, m)) % 2 = 0, m, x))[0])"
    )


def word_count(text: str) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """A row per source: number, size, target words and quota of slots.

    Sources by code point, null last, take the weights in turn.  Sorted by the level at which
    each reaches ``most`` times its size, sources are full while their own level is at or
    below what the rest would get per unit of weight; the first that is not sets the level.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    table = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns(
        {
            "sid": F.row_number().over(ordered) - 1,
            "total": F.sum("source_size").over(Window.partitionBy()),
        }
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    table = table.withColumns({"weight": weight, "cap": F.col("source_size") * float(most)})
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    table = table.withColumns(
        {
            "before": F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = (F.col("total") - F.col("before")) / F.col("open")
    free = F.col("cap") / F.col("weight") > level
    # The level of a row behind the first free one is not used.
    table = table.withColumn("level", F.first(F.when(free, level), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level")))
    table = table.withColumns({"target": target, "blocks": F.ceil(F.col("source_size") / block)})
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.col("blocks") * most)).otherwise(F.lit(0).cast("long"))
    table = table.withColumn("quota", quota)
    first = F.sum("quota").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("quota")
    return table.withColumn("first_slot", first).select("source", "sid", "source_size", "target", "blocks", "quota", "first_slot")


def placed(sized: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """Every document with its source's number and its first word's place in the source.

    A source's documents are dealt to chunks by hash; a chunk's running sum and the sums of
    the chunks before it give the place, so no task sees a whole source.
    """
    rows = sized.count()
    many = max(1, -(-rows // CHUNK_ROWS))
    table = sources.select(F.col("source").alias("__source"), "sid", "source_size", "target")
    joined = sized.join(F.broadcast(table) if small else table, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "source")
    joined = joined.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(many)))
    inside = Window.partitionBy("sid", "chunk").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = joined.groupBy("sid", "chunk").agg(F.sum("size").alias("words")).withColumn("base", F.sum("words").over(before) - F.col("words"))
    return (
        joined.withColumn("running", F.sum("size").over(inside))
        .join(sums.select("sid", "chunk", "base"), ["sid", "chunk"])
        .withColumn("start", F.col("base") + F.col("running") - F.col("size"))
        .drop("chunk", "running", "base")
    )


def slots(sources: DataFrame, small: bool, seed: int, shard: int = SHARD) -> DataFrame:
    """The mix: one row per slot with its shard, place, source and block index."""
    spark = sources.sparkSession
    total = int(sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0])
    dial = max(1, -(-total // DIALS))
    ranges = sources.filter("quota > 0").select(
        "sid", "blocks", "quota", "first_slot",
        F.explode(F.sequence(F.floor(F.col("first_slot") / dial), F.floor((F.col("first_slot") + F.col("quota") - 1) / dial))).alias("dial"),
    )
    deck = spark.range(0, total, 1, shuffle_width(spark)).withColumnRenamed("id", "slot")
    deck = deck.withColumn("dealt", permuted("slot", f"{total}L", str(seed)))
    deck = deck.withColumn("dial", F.floor(F.col("dealt") / dial)).join(F.broadcast(ranges) if small else ranges, "dial").filter(
        (F.col("dealt") >= F.col("first_slot")) & (F.col("dealt") < F.col("first_slot") + F.col("quota"))
    )
    k = F.col("dealt") - F.col("first_slot")
    deck = deck.withColumns({"pass": F.floor(k / F.col("blocks")), "k": F.pmod(k, F.col("blocks"))})
    deck = deck.withColumn("key", F.xxhash64(F.lit(seed), "sid", "pass")).withColumn("block", permuted("k", "blocks", "key"))
    return deck.select(
        F.floor(F.col("slot") / shard).alias("shard"), F.pmod("slot", F.lit(shard)).alias("place"), "sid", "pass", "block"
    )


def pieces(
    df: DataFrame, id_col="doc_id", text_col="text", source_col="source", block: int = BLOCK, seed: int = 17, weights=WEIGHTS, most: int = MOST,
    row: Column | None = None,
):
    """Documents with their place, and their pieces with the number of times the mix uses them.

    ``row`` tells rows of equal id and size apart; without it they stand for each other.
    """
    sized = settle(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"),
            (F.lit(0) if row is None else row).cast("long").alias("row"),
        )
    )
    sources = settle(targets(sized, weights, most, block))
    small = sources.count() <= SMALL
    docs = placed(sized, sources, small)
    uses = slots(sources, small, seed).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses"))
    end = F.col("start") + F.col("size")
    cut = docs.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    cut = cut.withColumns(
        {
            "from_word": F.greatest(F.col("start"), F.col("block") * block) - F.col("start"),
            "words": F.least(end, (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block),
        }
    ).join(uses, ["sid", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0).cast("long")))
    return docs, cut


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 17, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """What a mix to the targets takes of every document.

    One row per input row: ``doc_id``, ``size`` (words), ``source_size``, ``target`` (both of
    its source), ``taken`` (words the mix takes, repeats counted).  A source's taken words are
    within about a block of its target, a document is taken ``most`` times at the utmost, and
    the same rows always give the same mix, in whatever order they are read.

    A null or blank text has size 0 and is taken 0 times.  A null source is a source of its
    own, the last.  Null ids and repeated rows are ordinary rows.  Without any words all
    targets are 0; an empty table gives an empty result.  Other columns are not read.
    """
    docs, cut = pieces(df, id_col, text_col, source_col, block, seed, weights, most)
    keys = ["doc_id", "size", "source_size", "target"]
    taken = cut.groupBy("sid", "start", *keys).agg(F.sum(F.col("words") * F.col("uses")).alias("taken")).select(*keys, "taken")
    return taken.union(docs.filter("size = 0").select(*keys, F.lit(0).cast("long").alias("taken")))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **settings) -> DataFrame:
    """The mix as documents with the columns of ``df``: a row per document and repeat.

    The c-th row of a document holds the words of its pieces that are used c times or more,
    with the document's own text where that is all of it, else the words joined by one space;
    ``chars_col``, where there is one, is counted anew.  Documents the mix does not use are
    absent.  Where ids repeat or are null, rows are told apart by their place in a written copy, so each
    row gives the words that :func:`mix` says, also of several texts under one id.  Null and
    blank texts give nothing; an empty table gives an empty result.
    """
    columns = df.columns
    odd = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull())
    if odd.isEmpty():
        key = F.col(id_col).cast("long")
    else:
        df = land(df.withColumn("__row", F.monotonically_increasing_id()), "numbered-rows")
        key = F.col("__row")
    _, cut = pieces(df, id_col, text_col, source_col, row=key, **settings)
    used = cut.groupBy("row", "size").agg(
        F.sort_array(F.collect_list(F.struct("from_word", "words", "uses"))).alias("__cut"), F.max("uses").alias("__most")
    ).filter(F.col("__most") > 0).select(F.col("row").alias("__id"), "__cut", "__most", F.col("size").alias("__size"))
    rows = df.join(used, key == used["__id"]).withColumn(
        "__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__most")))
    )
    rows = rows.withColumn("__taken", F.filter("__cut", lambda p: p["uses"] >= F.col("__copy")))
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
    # The words stand in an array of one, so they are found once and not for every piece.
    some = F.transform(
        F.array(words),
        lambda w: F.array_join(F.flatten(F.transform("__taken", lambda p: F.slice(w, (p["from_word"] + 1).cast("int"), p["words"].cast("int")))), " "),
    )[0]
    whole = F.size("__taken") == F.size("__cut")
    rows = rows.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(some))
    if chars_col in df.columns:
        rows = rows.withColumn(chars_col, F.char_length(text_col).cast(df.schema[chars_col].dataType))
    return rows.select(*columns)
