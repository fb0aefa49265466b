"""Sinks: ingest into the relational store, reconcile induced signatures, publish verdicts.

The store is a set of DataFrames (parquet tables in practice):
  owners(id, name)                       observations(id, time, notifier_id, url, mirrorsrc)
  elements(id, type, element, hash, resource)     bridge(defaces_id, elements_defaces_id)
  signatures(id, notifier_id, detection, timestamp)   sig_bridge(sig_id, element)
Uniqueness that the original enforced row by row (select, then insert) is enforced set-wise
with left-anti joins on natural keys. New surrogate ids continue after the current maximum and
follow the sorted natural keys: distributed (no single-task numbering) and reproducible when a
lost partition is recomputed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesig.functions.similarity import fuzzy_hash
from pagesig.session import cut_lineage


def assign_ids(df: DataFrame, order_cols: list[str], start: int, id_col: str = "id") -> DataFrame:
    """Dense ids start, start+1, ... in the order of order_cols. Rows are range-partitioned and
    checkpointed; ids are numbered within a range and shifted by the sizes of the ranges before
    it (one row per range), so no task holds more than one range and no row leaves the JVM."""
    ranged = cut_lineage(df.repartitionByRange(*order_cols).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order_cols))
    return ranged.join(sizes, "_range").select(
        (number + F.col("_before") + F.lit(start - 1)).cast("long").alias(id_col), *df.columns)


def _next_id(table: DataFrame) -> int:
    m = table.agg(F.max("id")).first()[0]
    return 1 if m is None else int(m) + 1


def snk_ingest(observations: DataFrame, occurrences: DataFrame, store: dict) -> dict:
    """The store with a batch's new rows appended (see `new_rows`)."""
    new = new_rows(observations, occurrences, store)
    return {name: store[name].unionByName(new[name]) for name in store}


def new_rows(observations: DataFrame, occurrences: DataFrame, store: dict) -> dict:
    """observations (obs_key, owner, time, url, mirrorsrc); occurrences (obs_key, type, element,
    resource). Get-or-create owners by name and elements by (type, bytes); every observation
    is a new row; one bridge row per occurrence. Returns the rows to append, by table."""
    owners, obs_t, elems = store["owners"], store["observations"], store["elements"]

    new_names = observations.select(F.col("owner").alias("name")).distinct() \
        .join(owners.select("name"), "name", "left_anti")
    new_owners = assign_ids(new_names, ["name"], _next_id(owners))
    owners2 = owners.unionByName(new_owners)

    # occurrences are read for the new elements and for the bridge: the pages behind them are parsed once
    occ = occurrences.select("obs_key", "type", "element", "resource", F.sha2("element", 256).alias("ekey")).persist()
    known = elems.select("type", F.sha2("element", 256).alias("ekey"))
    # equal rows are counted out by a hash aggregate first: only distinct ones are sorted
    new_el = occ.select("type", "ekey", "element", "resource").distinct().dropDuplicates(["type", "ekey"]) \
        .join(known, ["type", "ekey"], "left_anti")
    # hashed once, after the ids: numbering samples its input, which runs it twice
    new_el = assign_ids(new_el, ["type", "ekey"], _next_id(elems)).withColumn("hash", fuzzy_hash(F.col("element")))
    new_el = cut_lineage(new_el.select("id", "type", "element", "hash", "resource"))
    elems2 = elems.unionByName(new_el)

    new_obs = observations.join(owners2.select(F.col("id").alias("notifier_id"), F.col("name").alias("owner")),
                                "owner")
    new_obs = assign_ids(new_obs.select("obs_key", "time", "notifier_id", "url", "mirrorsrc"),
                         ["obs_key"], _next_id(obs_t))

    el_ids = elems2.select(F.col("id").alias("elements_defaces_id"), "type",
                           F.sha2("element", 256).alias("ekey"))
    b = occ.join(new_obs.select(F.col("id").alias("defaces_id"), "obs_key"), "obs_key") \
        .join(el_ids, ["type", "ekey"]).select("defaces_id", "elements_defaces_id")
    b = cut_lineage(b)
    occ.unpersist()
    return {"owners": new_owners, "observations": new_obs.select("id", "time", "notifier_id", "url", "mirrorsrc"),
            "elements": new_el, "bridge": b}


MANIFEST = "batch long, version long, folder string, base boolean, name string, value string"


def save_batch(rows: dict, cursors: dict, path: str, batch: int, base: bool = False) -> None:
    """Add a batch's rows to a stored set of tables. Every run of a batch writes new folders, one per
    table, and then publishes them all, with its cursors (names and values as text), by one manifest
    file: what readers see changes at once or not at all, and a batch that is run again replaces what
    it published before. `base` says that the rows are the whole store: earlier batches no longer
    count (compaction, expiry)."""
    spark = next(iter(rows.values())).sparkSession
    before = _published(spark, path)
    if not base and any(r["base"] and r["batch"] >= batch for r in before):
        raise ValueError(f"batch {batch} is part of a base and cannot be replaced by itself")
    version = 1 + max((r["version"] for r in before), default=0)
    folder = f"batch={batch}-{version}-{uuid.uuid4().hex}"
    for name, df in rows.items():
        df.write.parquet(f"{path}/{name}/{folder}")
    marks = [(batch, version, folder, base, k, str(v)) for k, v in cursors.items()] or [(batch, version, folder, base, None, None)]
    spark.createDataFrame(marks, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _published(spark, path: str) -> list:
    """The manifest's rows: one per run of a batch and cursor."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return []
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()


def load_store(spark, path: str, tables: list[str]) -> tuple[dict, dict, int]:
    """(tables, cursors, number of the last batch) of a store written by `save_batch`: the newest
    published run of each batch since the newest base."""
    marks = _published(spark, path)
    since = max((r["version"] for r in marks if r["base"]), default=0)
    counted: dict = {}
    for r in sorted(marks, key=lambda r: r["version"]):
        if r["version"] >= since:
            counted[r["batch"]] = r
    last = max(counted)
    cursors = {r["name"]: r["value"] for r in marks if r["folder"] == counted[last]["folder"] and r["name"]}
    # the folders of published runs are listed: others (of runs that stopped or were replaced) are not read
    store = {name: spark.read.parquet(*[f"{path}/{name}/{counted[b]['folder']}" for b in sorted(counted)]) for name in tables}
    return store, cursors, int(last)


def empty_store(spark) -> dict:
    return {
        "owners": spark.createDataFrame([], "id long, name string"),
        "observations": spark.createDataFrame([], "id long, time timestamp_ntz, notifier_id long, url string, "
                                                  "mirrorsrc string"),
        "elements": spark.createDataFrame([], "id long, type string, element binary, hash string, resource string"),
        "bridge": spark.createDataFrame([], "defaces_id long, elements_defaces_id long"),
    }


def _digit(element: Column) -> Column:
    return F.xxhash64(element).cast("decimal(38,0)")


def jn_signature_equal(induced: DataFrame, signatures: DataFrame, sig_bridge: DataFrame) -> DataFrame:
    """Induced (owner, signature) joined to stored signatures of the same owner with an equal
    multiset; the first (lowest id) stored match per induced signature.

    Stored signatures are summed up by an order-free hash (the sum of their elements' hashes, with
    map-side combine) and met by owner, size and sum; only the pairs found are compared element by
    element, as counts. No stored signature is ever one array."""
    sums = sig_bridge.groupBy("sig_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum(_digit(F.col("element"))).alias("total"))
    stored = sums.join(signatures.select(F.col("id").alias("sig_id"), F.col("notifier_id").alias("owner")), "sig_id")
    total = F.aggregate("signature", F.lit(0).cast("decimal(38,0)"), lambda acc, e: (acc + _digit(e)).cast("decimal(38,0)"))
    pairs = induced.select("owner", "signature", F.size("signature").alias("n"), total.alias("total")).join(
        stored, ["owner", "n", "total"]).select("owner", "signature", "sig_id")
    want = pairs.withColumn("element", F.explode("signature")).groupBy("owner", "signature", "sig_id", "element").agg(
        F.count(F.lit(1)).alias("want"))
    have = sig_bridge.join(pairs.select("sig_id").distinct(), "sig_id", "left_semi").groupBy("sig_id", "element").agg(
        F.count(F.lit(1)).alias("have"))
    other = want.join(have, ["sig_id", "element"], "left").where(~F.col("want").eqNullSafe(F.col("have")))
    equal = pairs.join(other.select("owner", "signature", "sig_id").distinct(), ["owner", "signature", "sig_id"], "left_anti")
    return equal.groupBy("owner", "signature").agg(F.min("sig_id").alias("sig_id"))


def snk_signatures(induced: DataFrame, signatures: DataFrame, sig_bridge: DataFrame, as_of) -> dict:
    """Refresh the timestamp of the first equal stored signature, insert the others with
    detection 0. Returns {'refreshed', 'inserted', 'signatures', 'sig_bridge'}."""
    matched = jn_signature_equal(induced, signatures, sig_bridge)
    refreshed_ids = matched.select(F.col("sig_id").alias("id")).distinct()
    ts = F.lit(as_of).cast("timestamp_ntz")
    sigs2 = signatures.join(refreshed_ids.withColumn("_r", F.lit(True)), "id", "left").select(
        "id", "notifier_id", "detection",
        F.when(F.col("_r"), ts).otherwise(F.col("timestamp")).alias("timestamp"))
    new = induced.select("owner", "signature").join(matched.select("owner", "signature"),
                                                    ["owner", "signature"], "left_anti")
    new = new.withColumn("skey", F.array_join(F.array_sort("signature"), "\u0001"))
    new = assign_ids(new, ["owner", "skey"], _next_id(signatures))
    inserted = new.select("id", F.col("owner").alias("notifier_id"), F.lit(0).alias("detection"),
                          ts.alias("timestamp"))
    nb = new.select(F.col("id").alias("sig_id"), F.explode("signature").alias("element"))
    return {"refreshed": matched, "inserted": new.select("id", "owner", "signature"),
            "signatures": sigs2.unionByName(inserted), "sig_bridge": sig_bridge.unionByName(nb)}


def empty_signature_store(spark) -> dict:
    return {
        "signatures": spark.createDataFrame([], "id long, notifier_id long, detection int, timestamp timestamp_ntz"),
        "sig_bridge": spark.createDataFrame([], "sig_id long, element_id long"),
        "sig_elements": spark.createDataFrame([], "id long, ekey string, type string, element binary, hash string, resource string"),
    }


def merge_signatures(induced: DataFrame, store: dict, dictionary: DataFrame, as_of) -> dict:
    """The signature store after an induction: timestamps of signatures found again are refreshed,
    the others are added, with bridge rows and, for elements not stored yet, dictionary rows that
    carry hash and resource. `dictionary` (ekey, type, element, resource) knows all elements."""
    known = store["sig_elements"]
    spelled = store["sig_bridge"].join(known.select(F.col("id").alias("element_id"), F.col("ekey").alias("element")), "element_id")
    merged = snk_signatures(induced, store["signatures"], spelled.select("sig_id", "element"), as_of)
    used = merged["inserted"].select("id", F.explode("signature").alias("ekey"))
    new = used.select("ekey").distinct().join(known.select("ekey"), "ekey", "left_anti").join(dictionary, "ekey")
    new = assign_ids(new.withColumn("hash", fuzzy_hash(F.col("element"))), ["type", "ekey"], _next_id(known))
    elements = known.unionByName(new.select("id", "ekey", "type", "element", "hash", "resource"))
    bridge = used.withColumnRenamed("id", "sig_id").join(elements.select(F.col("id").alias("element_id"), "ekey"), "ekey")
    return {"signatures": merged["signatures"], "sig_elements": elements,
            "sig_bridge": store["sig_bridge"].unionByName(bridge.select("sig_id", "element_id"))}


def snk_verdicts(verdicts: DataFrame, path: str, scan_date: str) -> DataFrame:
    """Write the verdict rows under scan_date=<date>; a rerun of a date replaces its rows."""
    verdicts.write.mode("overwrite").parquet(f"{path}/scan_date={scan_date}")
    return verdicts.sparkSession.read.parquet(path).where(F.col("scan_date") == scan_date)
