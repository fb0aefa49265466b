"""Element extraction: pages (page_id, url, html) -> typed elements.

The HTML pass is the only Python step (mapInArrow, one row per element out; batches are bounded
by bytes on both sides, so a worker's memory does not grow with the table). Everything after it -- validity, media identity, the resource join, size class, the
element dictionary -- is built-in expressions and joins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesig.functions import urls
from pagesig.functions.htmlscan import scan_page
from pagesig.params import MIN_ELEMENT_CHARS, SIZE_CLASS_BYTES

RAW_SCHEMA = "page_id long, kind string, pos int, value string, tag string"


OUT_ROWS = 5_000  # rows per output batch, and characters: memory stays bounded whatever a page holds
OUT_CHARS = 1 << 20
IN_ROWS = 1_000  # pages per input batch, and bytes (a larger page is a batch of its own)
IN_BYTES = 4 << 20

_RAW_ARROW = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("pos", pa.int32()), ("value", pa.string()),
                        ("tag", pa.string())])


def _scan_batches(keep_comments: bool):
    def run(batches):
        rows, chars = [], 0
        for batch in batches:
            for pid, url, html in zip(*batch.columns):  # a page at a time becomes Python strings
                pid = pid.as_py()
                for kind, pos, value, tag in scan_page(url.as_py(), html.as_py(), keep_comments):
                    rows.append((pid, kind, pos, value, tag))
                    chars += len(value)
                    if len(rows) >= OUT_ROWS or chars >= OUT_CHARS:
                        yield _record_batch(rows)
                        rows, chars = [], 0
        if rows:
            yield _record_batch(rows)
    return run


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RAW_ARROW)], schema=_RAW_ARROW)


def _page_batches(spark: SparkSession) -> None:
    """Whole pages cross into Python: bound what an Arrow batch holds (runtime SQL settings)."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", IN_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", IN_BYTES)):
        now = int(spark.conf.get(key).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def ext_raw_elements(pages: DataFrame, keep_comments: bool = False) -> DataFrame:
    """All kinds from one parse of each page: (page_id, kind, pos, value, tag)."""
    _page_batches(pages.sparkSession)
    src = pages.select(F.col("page_id").cast("long"), "url", "html")
    return src.mapInArrow(_scan_batches(keep_comments), RAW_SCHEMA)


def _kind(raw: DataFrame, kind: str) -> DataFrame:
    return raw.where(F.col("kind") == kind).select("page_id", "pos", "value")


def ext_texts(raw: DataFrame) -> DataFrame:
    return _kind(raw, "texts")


def ext_images(raw: DataFrame) -> DataFrame:
    return _kind(raw, "images")


def ext_backgrounds(raw: DataFrame) -> DataFrame:
    return _kind(raw, "backgroundImages")


def ext_alerts(raw: DataFrame) -> DataFrame:
    return _kind(raw, "alerts")


def ext_media(raw: DataFrame) -> DataFrame:
    return _kind(raw, "music")


def ext_valid(df: DataFrame, col: str = "value") -> DataFrame:
    """Drop null and values shorter than three characters."""
    return df.where(F.col(col).isNotNull() & (F.char_length(col) >= MIN_ELEMENT_CHARS))


def ext_media_identity(media: DataFrame, is_media: Column | None = None) -> DataFrame:
    """element = URL before the first '?', resource = full URL; re-validated after the cut. Where
    `is_media` says that a row is none, element = value and there is no resource (one pass over all
    kinds; their column `kind` is kept)."""
    if is_media is None:
        out = media.select("page_id", "pos", urls.media_identity(F.col("value")).alias("element_text"),
                           F.col("value").alias("resource"))
    else:
        identity = F.when(is_media, urls.media_identity(F.col("value"))).otherwise(F.col("value"))
        out = media.select("page_id", "kind", "pos", identity.alias("element_text"), F.when(is_media, F.col("value")).alias("resource"))
    return ext_valid(out, "element_text")


def size_class(element_bytes) -> F.Column:
    return F.when(F.octet_length(element_bytes) <= SIZE_CLASS_BYTES, F.lit("L")).otherwise(F.lit("H"))


def ext_size_class(df: DataFrame, kind_col: str = "kind", element_col: str = "element") -> DataFrame:
    """type = L/H + kind, by the element's byte length."""
    return df.withColumn("type", F.concat(size_class(F.col(element_col)), F.col(kind_col)))


def ext_resource_join(refs: DataFrame, resources: DataFrame) -> DataFrame:
    """Image / background URLs -> downloaded bytes. Missing downloads drop the element; each
    URL's content is looked up once (distinct URLs) and joined back to every occurrence. Of a URL
    fetched more than once the newest content counts (column `fetched`, where there is one), then
    the largest digest."""
    newest = F.col("fetched").cast("string") if "fetched" in resources.columns else F.lit("")
    res = (resources.where(F.col("content").isNotNull()).groupBy(F.col("url").alias("resource"))
           .agg(F.max_by("content", F.struct(F.coalesce(newest, F.lit("")), F.sha2("content", 256))).alias("element")))
    return refs.withColumnRenamed("value", "resource").join(res, "resource")


def ext_page_elements(pages: DataFrame, resources: DataFrame | None = None,
                      keep_comments: bool = False) -> DataFrame:
    """Whole chain -> (page_id, type, element binary, resource, kind, pos)."""
    raw = ext_valid(ext_raw_elements(pages, keep_comments))
    # texts, alerts and media from one parse of the pages
    own = ext_media_identity(raw.where(F.col("kind").isin("texts", "alerts", "music")), F.col("kind") == "music")
    out = own.select("page_id", "kind", "pos", F.encode("element_text", "UTF-8").alias("element"), "resource")
    if resources is not None:
        refs = raw.where(F.col("kind").isin("images", "backgroundImages"))
        out = out.unionByName(ext_resource_join(refs, resources).select("page_id", "kind", "pos", "element", "resource"))
    return ext_size_class(out).select("page_id", "type", "element", "resource", "kind", "pos")


def ext_dictionary(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (type, bytes) keyed by sha2 of the bytes -> (dictionary, occurrences by key).

    The key is content-derived, so assigning it needs no global ordering, no single-task
    numbering and gives the same id on recomputation after an executor loss.
    """
    keyed = elements.withColumn("element_id", F.concat_ws(":", F.col("type"), F.sha2(F.col("element"), 256)))
    dictionary = keyed.select("element_id", "type", "element").dropDuplicates(["element_id"])
    occurrences = keyed.select("page_id", "element_id", "pos")
    return dictionary, occurrences
