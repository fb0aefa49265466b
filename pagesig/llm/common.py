"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesig import session
from pagesig.session import discard, ship_code  # noqa: F401 (operators take `discard` from here)

DOC_TYPES = {"doc_id": "bigint", "text": "string", "source": "string"}
MAX_ARROW_ROWS = 1000
# ASCII white space: space and U+0009..U+000D, the separators of every contract
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, in their canonical types: whatever else a table carries, under
    whatever name, cannot clash with an operator's own columns."""
    small_batches(docs.sparkSession)
    return docs.select(*[F.col(n).cast(DOC_TYPES[n]).alias(n) for n in names])


def whole_rows(docs: DataFrame, **more: Column) -> DataFrame:
    """Every row as one struct `row`, its `id`, and more columns: joined and filtered so, a table's
    own columns cannot clash with an operator's, whatever they are called."""
    small_batches(docs.sparkSession)
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
                       *[c.alias(n) for n, c in more.items()])


def small_batches(spark: SparkSession) -> None:
    """Whole texts cross into Python: keep Arrow batches small (a runtime SQL setting), and make
    sure that the executors have this package."""
    ship_code(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > MAX_ARROW_ROWS:
        spark.conf.set(key, str(MAX_ARROW_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    return session.stored(df, f"llm-{name}")


def fold_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], parts: int = 32) -> DataFrame:
    """Distributed running totals: adds, for each (name, column) of `sums`, the total of the
    column over all rows that come before this one in `order`.

    Rows are range-partitioned and stored; totals run within a range, and the ranges' own totals
    (one row per range) supply the offsets. No task holds more than one range."""
    ranged = df.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()])
    ranged = stored(ranged.repartitionByRange(parts, *order)
                    .withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    offsets = offsets.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}")
                                         for n in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), "_range")  # at most `parts` rows
    for n in sums:
        out = out.withColumn(n, F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) + F.col(f"_o_{n}"))
    return out.drop("_range", *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])
