"""Sources: landed files of the collection / enrichment steps, parsed with built-in functions.

Every parser takes a DataFrame (lines with a `value` column and, where order matters, a
`line_no`), so the same code serves files (`read_*` below) and data derived inside Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesig.functions import ipaddr as IP
from pagesig.params import NO_AS_NUMBER
from pagesig.session import cut_lineage


def _lines(spark: SparkSession, path: str) -> DataFrame:
    # file order: file, offset of the split, number within the split (its own lines are in order)
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    within = F.monotonically_increasing_id()
    return lines.select("value", F.struct("file_path", "file_block_start", within.alias("n")).alias("line_no"))


# ---------------------------------------------------------------- observations

def src_observations(owners: DataFrame, observations: DataFrame, bridge: DataFrame,
                     elements: DataFrame) -> DataFrame:
    """(owner, obs_id, time, url, type, element): observations with their element occurrences."""
    o = observations.join(owners.select(F.col("id").alias("notifier_id"), F.col("name").alias("owner")),
                          "notifier_id")
    b = bridge.select(F.col("defaces_id").alias("obs_id"), F.col("elements_defaces_id").alias("element_id"))
    e = elements.select(F.col("id").alias("element_id"), "type", "element")
    return o.select("owner", F.col("id").alias("obs_id"), "time", "url").join(b, "obs_id").join(e, "element_id") \
        .drop("element_id")


# ---------------------------------------------------------------- enrichment files

def src_asn_worklist(docs: DataFrame) -> DataFrame:
    """JSON objects {asn: [domain, ...]} (one per line or one per file) -> (asn, domain, pos)."""
    m = F.from_json(F.col("value"), "map<string, array<string>>")
    per_asn = docs.select(F.explode(m).alias("asn", "domains"))
    return per_asn.select("asn", F.posexplode("domains").alias("pos", "domain"))


_STRING = r'"((?:[^"\\]|\\.)*)"'
NOT_A_STRING, NO_KEY = "not a string", "no key before it"


def split_worklist(chunks: DataFrame) -> DataFrame:
    """(asn, domain, pos, reason, value) from the pieces of worklist files cut at every comma, in file
    order: a file of any size is read by as many tasks as it has ranges, and a key and its count of
    domains are carried from range to range (one row each). What is no key and no string comes out
    with a reason, never lost."""
    lines = chunks.select("file", "start", "at", F.posexplode(F.split("value", "\n")).alias("line", "value"))
    bare = F.regexp_replace("value", r"^[\s{]+|[\s}]+$", "")
    key = F.when(bare.rlike(rf"^{_STRING}\s*:\s*\["), F.regexp_extract(bare, rf"^{_STRING}", 1))
    rest = F.regexp_replace(bare, rf"^{_STRING}\s*:\s*\[\s*", "")
    token = F.when(rest.rlike(rf"^{_STRING}\s*\]?$"), F.regexp_extract(rest, rf"^{_STRING}", 1))
    empty = rest.rlike(r"^\s*\]?$")
    # stored: ids, keys and ranges are read again
    rows = cut_lineage(lines.select("file", "start", "at", "line", "value",
                                    key.alias("key"), token.alias("token"), empty.alias("empty"))
                       .where(F.col("key").isNotNull() | ~F.col("empty")))
    inside = Window.partitionBy("file", "start").orderBy("at", "line")  # one file range
    rows = rows.withColumn("run", F.count("key").over(inside)).withColumn("key", F.last("key", ignorenulls=True).over(inside))
    counted = F.col("token").isNotNull().cast("long")
    rows = rows.withColumn("n", F.sum(counted).over(Window.partitionBy("file", "start", "run").orderBy("at", "line")) - 1)
    ends = rows.groupBy("file", "start").agg(F.max_by("key", F.struct("at", "line")).alias("key"), F.max("run").alias("runs"),
                                             F.max_by(F.col("n") + 1, F.struct("at", "line")).alias("tail"))
    order = Window.partitionBy("file").orderBy("start")  # one row per file range
    ends = ends.withColumn("block", F.sum(F.when(F.col("runs") > 0, 1).otherwise(0)).over(order))
    ends = ends.withColumn("carried", F.last("key", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    since = Window.partitionBy("file", "block").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("through", F.sum("tail").over(since))  # since the last range that has a key of its own
    ends = ends.select("file", "start", "carried", F.coalesce(F.lag("through").over(order), F.lit(0)).alias("skip"))
    filled = rows.join(ends, ["file", "start"])
    first = F.col("run") == 0
    asn = F.when(first, F.col("carried")).otherwise(F.col("key"))
    reason = F.when(F.col("empty"), None).when(F.col("token").isNull(), NOT_A_STRING).when(asn.isNull(), NO_KEY)
    decoded = F.get(F.from_json(F.concat(F.lit('["'), F.col("token"), F.lit('"]')), "array<string>"), 0)
    return filled.where(~F.col("empty")).select(
        asn.alias("asn"), decoded.alias("domain"), (F.col("n") + F.when(first, F.col("skip")).otherwise(0)).cast("int").alias("pos"),
        reason.alias("reason"), "value")


def worklist_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start, at): the pieces between commas, with file range and place in it."""
    pieces = spark.read.option("lineSep", ",").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return pieces.select("value", F.col("file_path").alias("file"), F.col("file_block_start").alias("start"),
                         F.monotonically_increasing_id().alias("at"))


def read_asn_worklist(spark: SparkSession, path: str) -> DataFrame:
    """(asn, pos, domain) of worklist files of any size; see `split_worklist` for what is left out."""
    return split_worklist(worklist_chunks(spark, path)).where(F.col("reason").isNull()).select("asn", "pos", "domain")


def src_domain_registry(docs: DataFrame) -> DataFrame:
    """JSON array of objects with a domain_name field (or one object per line) -> domain_name."""
    arr = F.from_json(F.col("value"), "array<struct<domain_name: string>>")
    one = F.from_json(F.col("value"), "struct<domain_name: string>")
    items = F.coalesce(arr, F.array(one))
    return docs.select(F.explode(items).alias("d")).select(F.col("d.domain_name").alias("domain_name")) \
        .where(F.col("domain_name").isNotNull())


def split_registry(chunks: DataFrame) -> DataFrame:
    """(domain_name, reason, value) from the pieces of registry files cut after every object: objects
    without a domain name, or that are not JSON, come out with a reason."""
    body = F.regexp_replace("value", r"^[\s,\[\]]+|\s+$", "")
    rows = chunks.select("value", body.alias("body")).where("body <> ''")
    one = F.from_json(F.concat(F.col("body"), F.lit("}")), "struct<domain_name: string>")
    rows = rows.withColumn("domain_name", one["domain_name"])
    return rows.select("domain_name", F.when(F.col("domain_name").isNull(), "no object with a domain name").alias("reason"), "value")


def read_domain_registry(spark: SparkSession, path: str) -> DataFrame:
    """domain_name of registry files of any size."""
    return split_registry(spark.read.option("lineSep", "}").text(path)).where(F.col("reason").isNull()).select("domain_name")


def src_delegated_ranges(lines: DataFrame, cc: str | None = None) -> DataFrame:
    """RIR delegated statistics (registry|cc|type|start|count|date|status) -> (cc, start_ip,
    end_ip) of ipv4 rows; count addresses from start inclusive (end = start + count - 1)."""
    f = F.split(F.col("value"), r"\|")
    rows = lines.where(~F.col("value").startswith("#")).select(
        F.get(f, 1).alias("cc"), F.get(f, 2).alias("type"), F.get(f, 3).alias("start"),
        F.get(f, 4).try_cast("long").alias("count"))
    rows = rows.where((F.col("type") == "ipv4") & IP.valid_ip(F.col("start")) & F.col("count").isNotNull())
    if cc is not None:
        rows = rows.where(F.upper("cc") == F.upper(F.lit(cc)))
    start = IP.ip_to_long(F.col("start"))
    return rows.select("cc", start.alias("start_ip"), (start + F.col("count") - 1).alias("end_ip"))


def read_delegated_ranges(spark: SparkSession, path: str, cc: str | None = None) -> DataFrame:
    return src_delegated_ranges(spark.read.text(path), cc)


def src_ip_asn_reply(lines: DataFrame) -> DataFrame:
    """'asn | ip | cc' lines -> (ip, asn, cc); lines without '|' dropped, fields trimmed,
    the last line of a repeated ip wins."""
    f = F.split(F.col("value"), r"\|")
    rows = lines.where(F.instr("value", "|") > 0).select(
        "line_no", F.trim(F.get(f, 0)).alias("asn"), F.trim(F.get(f, 1)).alias("ip"),
        F.trim(F.get(f, 2)).alias("cc"))
    last = rows.groupBy("ip").agg(F.max_by(F.struct("asn", "cc"), "line_no").alias("v"))
    return last.select("ip", F.col("v.asn").alias("asn"), F.col("v.cc").alias("cc"))


def read_ip_asn_reply(spark: SparkSession, path: str) -> DataFrame:
    return src_ip_asn_reply(_lines(spark, path))


def src_whois_origin(replies: DataFrame) -> DataFrame:
    """(reply_id, value = whole reply text) -> (reply_id, asn, reason).

    Blank and '%' lines are dropped; exactly one line with exactly two tab-separated fields
    must remain; AS 3303 reads as ''. Invalid replies give asn null and a reason."""
    lines = F.filter(F.split(F.col("value"), "\n"), lambda x: (x != "") & ~x.startswith("%"))
    r = replies.select("reply_id", lines.alias("lines"))
    fields = F.split(F.get(F.col("lines"), 0), "\t")
    ok_lines = F.size("lines") == 1
    ok_fields = F.size(fields) == 2
    asn = F.get(fields, 0)
    return r.select(
        "reply_id",
        F.when(ok_lines & ok_fields, F.when(asn == NO_AS_NUMBER, F.lit("")).otherwise(asn)).alias("asn"),
        F.when(~ok_lines, F.lit("lines")).when(~ok_fields, F.lit("fields")).alias("reason"))


# ---------------------------------------------------------------- incremental cursors

def src_feed_delta(feed: DataFrame, cursor: DataFrame) -> DataFrame:
    """feed (ordinal, time, notifier, mirror), newest first by ordinal; cursor (time, notifier,
    mirror) = last row seen. -> rows listed before the cursor's first occurrence, oldest
    first; every row when the cursor is not in the listing."""
    stop = feed.join(cursor.select("time", "notifier", "mirror"), ["time", "notifier", "mirror"], "left_semi") \
        .agg(F.min("ordinal")).first()[0]  # one scalar: where the cursor sits in the listing
    out = feed if stop is None else feed.where(F.col("ordinal") < F.lit(stop))
    return out.orderBy(F.col("ordinal").desc())


def src_id_range(obs: DataFrame, id_start) -> tuple[DataFrame, int | None]:
    """New observations id_start < id <= id_end with id_end = max(id); returns (rows, id_end).

    The mark is saved by the caller after the work succeeded (not before)."""
    id_end = obs.agg(F.max("obs_id")).first()[0]
    rows = obs.where((F.col("obs_id") > F.lit(id_start)) & (F.col("obs_id") <= F.lit(id_end)))
    return rows, id_end
