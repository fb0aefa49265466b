"""Collect plan: new listing rows + fetched mirror pages -> elements -> relational store.

src_feed_delta -> (pages of the new reports) -> ext_page_elements -> snk_ingest
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesig.functions import urls
from pagesig.operators import extract, sinks
from pagesig.sources import readers


def collect(feed: DataFrame, cursor: DataFrame, mirror_pages: DataFrame, store: dict,
            ingested_at, resources: DataFrame | None = None) -> dict:
    """feed (ordinal, time 'HH:MM', notifier, mirror) newest first; cursor = last row seen;
    mirror_pages (mirror, url, html) = the fetched mirror of each report.
    Returns the store with the new observations, elements and occurrences appended."""
    new = readers.src_feed_delta(feed, cursor)
    obs = new.join(mirror_pages, "mirror").select(
        F.col("ordinal").alias("obs_key"), F.col("notifier").alias("owner"),
        urls.obs_time(F.col("time"), F.lit(ingested_at)).alias("time"), "url",
        F.col("mirror").alias("mirrorsrc"))
    pages = new.join(mirror_pages, "mirror").select(F.col("ordinal").alias("page_id"), "url", "html")
    occ = extract.ext_page_elements(pages, resources).select(
        F.col("page_id").alias("obs_key"), "type", "element", "resource")
    return sinks.snk_ingest(obs, occ, store)
