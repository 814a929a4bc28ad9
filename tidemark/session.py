"""Session settings, and the two helpers that decide how small tables travel."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"

# A table is broadcast only after its rows and their bytes were counted against these bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20

# The JVM interprets methods of more bytecode than this; Spark's own limit is 65,535.
METHOD_LIMIT_KEY = "spark.sql.codegen.hugeMethodLimit"
METHOD_LIMIT = 8_000


def build_session(cores: str = "*", app: str = "tidemark", **conf: str) -> SparkSession:
    """A local session with the settings the jobs are tuned for.

    On a cluster the session comes from spark-submit; nothing here is required.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Settled tables go with the frames that read them.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def short_methods(spark: SparkSession) -> None:
    """Keep stages of very many expressions out of one method that the JVM only interprets.

    Sets Spark's limit for generated methods in the session, unless it was chosen already.
    """
    if int(spark.conf.get(METHOD_LIMIT_KEY)) > METHOD_LIMIT:
        spark.conf.set(METHOD_LIMIT_KEY, str(METHOD_LIMIT))


def own_folder() -> str:
    """A temporary folder for a local session, removed at its end."""
    folder = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Where none is set, a local session gets a folder of its own, removed at its end; on a
    cluster that is an error, since executors do not see each other's disks.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = context.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        folder = own_folder()
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy.

    Used for per-group tables and for matrices that are scanned repeatedly: a
    lost executor costs a re-read, not a recomputation of the whole lineage.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def land(df: DataFrame, name: str) -> DataFrame:
    """Write a wide table once as parquet beside the checkpoints and read it back.

    Text is parsed once, later steps prune columns and push filters down.
    """
    folder = checkpoint_folder(df.sparkSession)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def attach(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a per-group table back to rows, broadcasting it when it is small.

    A null key is a group like any other.  The table is settled, and its rows and
    bytes counted first.  Beyond either bound the join is a plain shuffle join,
    whose hot keys adaptive execution splits.
    """
    table = settle(table)
    bytes_ = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in table.columns), F.lit(0))
    n, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(bytes_), F.lit(0))).first()
    others = [c for c in table.columns if c not in keys]
    renamed = table.select(*[F.col(f"`{k}`").alias(f"__key_{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in others])
    if n <= max_rows and size <= BROADCAST_BYTES:
        renamed = F.broadcast(renamed)
    same = [rows[f"`{k}`"].eqNullSafe(renamed[f"__key_{i}"]) for i, k in enumerate(keys)]
    kept = [c for c in rows.columns if c not in keys]
    return rows.join(renamed, same, how).select(*[F.col(f"`{c}`") for c in [*keys, *kept, *others]])


def beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Add the values of a one-row table as literal columns."""
    row = other.first()
    values = row.asDict() if row is not None else {}
    return one.withColumns(
        {f.name: F.lit(values.get(f.name)).cast(f.dataType) for f in other.schema.fields}
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table that one file holds over the cores.

    Tables with enough splits, as on a cluster, pass through unchanged.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)
