"""A Merkle manifest of a dataset, and proofs of all rows by pointer jumping.

Leaves are hashed where their rows lie and numbered by a range-partitioned sort.  A tree is built
level by level: the digests of a run of ``RUN`` consecutive nodes make the node above.  The
subroots of all sources are the leaves of one more tree.

For the proofs every inner node holds the ancestor it has reached and the siblings on the way
there.  Each round joins the nodes with themselves: a node appends the segment of its ancestor
and takes over that ancestor's pointer, so the distance doubles, and after log2(depth) rounds all
have reached the root.  The siblings beside a leaf are those of its run, which the node above
holds once, so leaves take their one step last, and no proof is written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import shuffle_width, tasks_for
from tidemark.session import attach, land, settle

RUN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5  # crc32 of the id modulo this is 0
TOP = -1      # number of the tree over the subroots
NODE = ["tree", "level", "place"]
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """Byte count, colon, value; '-' for null."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaves(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows (doc_id, source, leaf, changed): ``changed`` is the leaf of a tampered row."""
    own = [F.col(names[f]) for f in FIELDS]
    lowered = F.translate(own[-1].cast("string"), CAPITALS, CAPITALS.lower())
    chosen = F.crc32(own[0].cast("string").cast("binary")) % TAMPERED == 0
    return df.select(
        own[0].cast("long").alias("doc_id"), own[1].cast("string").alias("source"),
        F.unhex(sha(F.concat(*[field(c) for c in own]))).alias("leaf"),
        F.when(chosen, F.unhex(sha(F.concat(*[field(c) for c in own[:-1]], field(lowered))))).alias("changed"),
    )


def numbered(df: DataFrame, keys: list[str], name: str, many: int) -> DataFrame:
    """Add ``name``: the place, 0, 1, …, of each of ``many`` rows in the order of ``keys``, nulls first.

    Rows are dealt by ranges of the keys and sorted within; a range's rows count on from the sum
    of the ranges before it, a table of as many rows as there are ranges.  The written copy
    fixes the ranges.  Rows of one key are spread by their place in the input, so many of
    them are not one task.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    df = df.withColumn("__at", F.monotonically_increasing_id())
    sorted_ = df.repartitionByRange(max(min(shuffle_width(df.sparkSession), tasks_for(many * 10)), tasks_for(many // 100)), *order, F.col("__at")).sortWithinPartitions(*order, "__at")
    rows = land(sorted_.drop("__at").withColumn("__seat", F.monotonically_increasing_id()), name)
    part, inside = F.shiftright("__seat", 33), F.col("__seat").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).collect()  # a row per range
    before, starts = 0, []
    for r in sorted(counts, key=lambda r: r["__part"]):
        starts.append((r["__part"], before))
        before += r["__n"]
    table = F.broadcast(df.sparkSession.createDataFrame(starts, "__part long, __start long"))
    return rows.withColumns({"__part": part, "__inside": inside}).join(table, "__part").withColumn(
        name, F.col("__start") + F.col("__inside")
    ).drop("__part", "__inside", "__start", "__seat")


def inner_nodes(base: DataFrame, most: int, leaves: int, many: int) -> list[DataFrame]:
    """The levels above ``base`` (tree, place, digest, left), ``left`` nodes in the row's tree and level.

    A node has the digests of its run one behind the other, and a tree ends where one node is
    left, so a tree of one leaf has no inner node.  ``most`` is the size of the largest tree;
    from the number of ``leaves`` and of trees (``many``) follows how many nodes a level has at
    most, and so its tasks.
    """
    levels, current = [], base
    while most > 1:
        runs = current.filter("left > 1").groupBy("tree", F.floor(F.col("place") / RUN).cast("long").alias("place")).agg(
            F.array_sort(F.collect_list(F.struct(F.pmod("place", F.lit(RUN)).alias("seat"), F.hex("digest").alias("hex")))).alias("members"),
            F.ceil(F.max("left") / RUN).cast("long").alias("left"),
        ).withColumn("run", F.unhex(F.array_join("members.hex", "")))
        leaves = leaves // RUN + many
        levels.append(
            settle(runs.coalesce(tasks_for(leaves)).select("tree", F.lit(len(levels) + 1).alias("level"), "place", "left", "run", F.unhex(sha(F.lower(F.hex("run")))).alias("digest")))
        )
        current, most = levels[-1], -(-most // RUN)
    return levels


def _union(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = empty
    for f in frames:
        out = out.unionByName(f)
    return out


def beside(run: str, seat: str) -> Column:
    """Siblings left and right of a seat in a run of digests."""
    return F.expr(f"named_struct('before', substring({run}, 1, 32 * {seat}), 'after', substring({run}, 32 * {seat} + 33))")


def parent_of(single: Column, sources: int) -> dict[str, Column]:
    """Key of the node above and the seat below it; of what is a subroot (``single``) in the top tree."""
    lone = single & (F.col("tree") != TOP)
    above = F.when(lone, F.col("sub") if sources > 1 else F.lit(None)).when(~single, F.col("place")).cast("long")
    return {
        "seat": F.pmod(above, F.lit(RUN)).cast("int"),
        "up_tree": F.when(lone, F.lit(TOP)).otherwise(F.col("tree")).cast("long"),
        "up_level": F.when(lone, F.lit(1)).otherwise(F.col("level") + 1),
        "up_place": F.floor(above / RUN).cast("long"),
    }


def proofs(nodes: DataFrame, depth: int, sources: int, tasks: int) -> DataFrame:
    """Rows (tree, level, place, run, sides): the sibling segments from every inner node to the root.

    ``nodes`` are inner nodes with ``sub``, the place of their tree's subroot in the top tree.
    """
    up = ["up_tree", "up_level", "up_place"]
    pointed = nodes.withColumns(parent_of(F.col("left") == 1, sources))
    above = nodes.select(*[F.col(k).alias(u) for k, u in zip(NODE, up)], F.col("run").alias("__run"), ((F.col("left") == 1) & ((F.col("tree") == TOP) | F.lit(sources == 1))).alias("__last"))
    state = attach(pointed, above, up).withColumn("sides", F.when(F.col("seat").isNull(), F.array()).otherwise(F.array(beside("__run", "seat"))))
    still = [F.when(~F.col("__last"), F.col(u)).alias(u) for u in up]
    state = settle(state.select(*NODE, "run", "sides", *still))
    reach = 1
    while reach < depth:
        # Behind this many steps lie nodes of a higher level, or the top tree.
        far = state.filter((F.col("level") > reach) | (F.col("tree") == TOP)).select(
            *[F.col(k).alias(u) for k, u in zip(NODE, up)], F.col("sides").alias("__sides"), *[F.col(u).alias(f"__{u}") for u in up]
        )
        open_ = attach(state.filter("up_place is not null"), far, up, "inner")
        moved = open_.select(*NODE, "run", F.concat("sides", "__sides").alias("sides"), *[F.col(f"__{u}").alias(u) for u in up])
        state = settle(moved.union(state.filter("up_place is null").select(moved.columns)).coalesce(tasks))
        reach *= 2
    return state.select(*NODE, "run", "sides")


def folded(leaf: str) -> Column:
    return F.expr(
        f"aggregate(sides, lower(hex({leaf})), (d, s) -> sha2(cast(concat(lower(hex(s.before)), d, lower(hex(s.after))) as binary), 256))"
    )


def manifest(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", text_col: str = "text",
) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and whether a tampered copy still verifies.

    Returns a row per row of ``df``: ``doc_id``, ``leaf``, ``subroot`` (of its source), ``root``,
    ``proof_sha256`` (of the siblings from the leaf to the root), ``folded_root`` (from the leaf of
    the tampered row, else the own one, and the original siblings), ``verified``.  Tampered are
    rows whose crc32(id) is divisible by 5: A to Z of the text are lower-cased.

    Null fields enter the leaf as '-', so null and '' differ; a null source is a source of its
    own, the first.  In a source, null ids come first and rows of one id are ordered by
    their leaf; rows repeated in full are leaves of their own.  Rows with a null id or text are not
    changed by tampering.  An empty table gives an empty result.  Other columns are not read.
    """
    names = dict(zip(FIELDS, (id_col, source_col, lang_col, chars_col, text_col)))
    hashed = land(leaves(df, names), "leaves")
    n = hashed.count()
    rows = numbered(hashed, ["source", "doc_id", "leaf"], "rank", n)
    sources = settle(rows.groupBy("source").agg(F.min("rank").alias("tree"), F.count(F.lit(1)).alias("left")))
    many, most = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("left"), F.lit(0))).first()
    base = attach(rows, sources, ["source"]).withColumn("place", F.col("rank") - F.col("tree"))
    shape = ["tree", "place", "left", "digest"]
    inner = inner_nodes(base.select("tree", "place", "left", F.col("leaf").alias("digest")), most, n, many)
    singles = base.filter("left = 1").select(*shape[:3], F.col("leaf").alias("digest"))
    subroots = _union([level.filter("left = 1").select(shape) for level in inner], singles).select("tree", "digest")
    subroots = settle(numbered(subroots, ["tree"], "sub", many).select("tree", "sub", F.col("digest").alias("subroot")).coalesce(tasks_for(many)))
    top = inner_nodes(
        subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("sub").alias("place"), F.lit(many).cast("long").alias("left"), F.col("subroot").alias("digest")), many, many, 1
    )
    last = (top[-1] if top else subroots.withColumnRenamed("subroot", "digest")).select("digest").first()
    root = last["digest"].hex() if last is not None else None
    whole = ["tree", "level", "place", "left", "run"]
    if inner or top:
        empty = (inner + top)[0].filter("false").select(whole)
        nodes = attach(_union([level.select(whole) for level in inner + top], empty), subroots.select("tree", "sub"), ["tree"])
        tasks = tasks_for(n // (RUN - 1) + 20 * many)
        paths = proofs(nodes.coalesce(tasks), len(inner) + len(top), many, tasks)
    else:
        paths = rows.sparkSession.createDataFrame([], "tree long, level int, place long, run binary, sides array<struct<before:binary,after:binary>>")
    held = attach(base.withColumn("level", F.lit(0)), subroots, ["tree"]).withColumns(parent_of(F.col("left") == 1, many))
    held = held.select("doc_id", "leaf", "changed", "subroot", "seat", *[F.col(f"up_{k}").alias(k) for k in NODE])
    proved = attach(held, paths, NODE).withColumn(
        "sides", F.when(F.col("seat").isNull(), F.array()).otherwise(F.concat(F.array(beside("run", "seat")), "sides"))
    )
    text = F.expr("array_join(transform(sides, s -> concat(lower(hex(s.before)), lower(hex(s.after)))), '')")
    proved = proved.withColumn("folded_root", F.when(F.col("changed").isNull(), folded("leaf")).otherwise(folded("changed")))
    return proved.select(
        "doc_id", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), F.lit(root).cast("string").alias("root"),
        sha(text).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"),
    )


def _levels(name: str, base: str, key: str, deepest: int) -> str:
    """SQL of the levels above ``base`` (key, place, digest), as ``name``1, ``name``2, …; a
    level of one node is passed on."""
    out = []
    for i in range(1, deepest + 1):
        below = f"{name}{i - 1}" if i > 1 else base
        out.append(
            f"""{name}{i} AS (
  SELECT {key}, place // {RUN} AS place, count(*) OVER (PARTITION BY {key}) AS nodes,
    CASE WHEN any_value(nodes) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest
  FROM {below} GROUP BY {key}, place // {RUN})"""
        )
    return ",\n".join(out)


def _proof(name: str, base: str, key: str, deepest: int) -> str:
    """SQL of the siblings beside every node of ``base`` on each level: (key, place, level, before, after)."""
    out = []
    for i in range(deepest):
        at = f"{name}{i}" if i else base
        out.append(
            f"""SELECT b.{key}, b.place, {i} AS level, coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < b.place // {RUN**i}), '') AS before,
    coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > b.place // {RUN**i}), '') AS after
  FROM {base} b JOIN {at} s ON s.{key} = b.{key} AND s.place // {RUN} = b.place // {RUN ** (i + 1)} AND s.nodes > 1 GROUP BY ALL"""
        )
    return "\n  UNION ALL ".join(out)


DEEP = 6  # levels the SQL writes out: 16 ** 6 rows a source


def _sql() -> str:
    parts = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS)
    lowered = parts.replace("CAST(text AS VARCHAR)", f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')")
    crc = (
        "list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), "
        "lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"
    )
    return f"""
WITH hashed AS (
  SELECT doc_id, source, sha256({parts}) AS leaf, CASE WHEN xor({crc}, 4294967295) % {TAMPERED} = 0 THEN sha256({lowered}) END AS changed
  FROM documents),
numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS nodes
  FROM hashed),
base AS (SELECT sid, place, nodes, leaf AS digest FROM numbered),
{_levels("n", "base", "sid", DEEP)},
subs AS (SELECT 0 AS one, sid AS place, count(*) OVER () AS nodes, digest FROM n{DEEP}),
{_levels("t", "subs", "one", DEEP)},
low AS ({_proof("n", "base", "sid", DEEP)}),
high AS ({_proof("t", "subs", "one", DEEP)}),
sides AS (
  SELECT numbered.sid, numbered.place, list(struct_pack(before := before, after := after) ORDER BY level) AS sides FROM numbered JOIN (
    SELECT sid, place, level, before, after FROM low
    UNION ALL SELECT base.sid, base.place, {DEEP} + level, before, after FROM high JOIN base ON base.sid = high.place) USING (sid, place)
  GROUP BY ALL),
folded AS (
  SELECT doc_id, leaf, subs.digest AS subroot, t{DEEP}.digest AS root,
    sha256(coalesce(list_aggregate(list_transform(sides, lambda s: s.before || s.after), 'string_agg', ''), '')) AS proof_sha256,
    coalesce(changed, leaf) AS start, coalesce(sides, []) AS sides
  FROM numbered JOIN subs ON subs.place = numbered.sid CROSS JOIN t{DEEP} LEFT JOIN sides ON sides.sid = numbered.sid AND sides.place = numbered.place)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM (
  SELECT *, list_reduce(list_prepend(struct_pack(before := start, after := ''), sides),
    lambda a, s: struct_pack(before := sha256(s.before || a.before || s.after), after := '')).before AS folded_root FROM folded)
"""


SQL = _sql()
