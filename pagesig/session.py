"""Spark session and lineage helpers.

Everything in the package runs on whatever session the caller provides; this module only
builds one for tests, the bench and the driver entry, and offers `cut_lineage` for the few
places where a long chain of joins should be made restartable without recomputation.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "pagesig",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests / bench; a cluster session is used as it comes."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # whole pages and long elements travel through Arrow: keep Python batches small
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; only set a scratch one where none is named."""
    current = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that every executor shares "
                         "(a machine-local scratch folder is only used in local mode)")
    local = tempfile.mkdtemp(prefix="pagesig-ckpt-", dir="/tmp")
    spark.conf.set(CHECKPOINT_CONF, local)
    spark.sparkContext.setCheckpointDir(local)
    return local


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside deletes its own shuffle files as soon as it is done, and not when the driver
    happens to collect its garbage. For tables that are read back from where they were written."""
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_CONF, before)


def cut_lineage(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Write `df` as a table in the session's checkpoint folder (never a local checkpoint) and read it back.

    It is computed once, without a cache, and lies there compressed; the shuffle files behind it go. Downstream
    plans start from the stored data: lineage and plan size stay constant across iterated levels, and
    a lost executor costs one level, not the chain."""
    return stored(df, "cut") if enabled else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder named by spark.checkpoint.dir and read it back:
    cuts the lineage, survives lost executors, is compressed and columnar. The shuffle files behind it go."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` gave and nothing reads any more, so that the shared folder holds
    only what the steps to come need."""
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def reuse(df: DataFrame) -> DataFrame:
    """Mark an intermediate that several branches of one plan read: cached on first use
    (memory, spilling to disk), so the shared subtree is computed and planned once. A lost
    block is recomputed from lineage. `release` drops what was cached."""
    _reused.append(df.persist())
    return _reused[-1]


_reused: list[DataFrame] = []


def release() -> None:
    """Drop the cached intermediates of earlier plans (a plan that still uses one recomputes it)."""
    while _reused:
        df = _reused.pop()
        if df.sparkSession.sparkContext._jsc is not None:  # not of a stopped application
            df.unpersist()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors (once per Spark application), so that Python functions
    import there from whatever folder the application was started in."""
    sc = spark.sparkContext
    if getattr(sc, "_pagesig_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="pagesig-code-"), "pagesig.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._pagesig_shipped = True
