"""Induce plan: one plan for all owners.

observations -> wn_history -> wn_latest_per_host -> wn_last_k_hosts -> jn_obs_elements
-> sg_induce (-> snk_signatures)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesig.operators import induce, joins, select
from pagesig.params import HISTORY_DAYS
from pagesig.sources import corpora

ORDERS_HISTORY_DAYS = 3650


def orders_occurrences_selected(spark: SparkSession, sf_dir: str, days: int = ORDERS_HISTORY_DAYS) -> DataFrame:
    selected = select.select_pages(corpora.orders_observations(spark, sf_dir), days)
    return joins.jn_obs_bridge_elements(selected, corpora.orders_bridge(spark, sf_dir),
                                        corpora.orders_elements(spark, sf_dir))


def induce_orders(spark: SparkSession, sf_dir: str, days: int = ORDERS_HISTORY_DAYS) -> DataFrame:
    return induce.sg_induce(orders_occurrences_selected(spark, sf_dir, days))


def induce_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second corpus: observation = (user, day); the occurrence key is (owner, obs_id)."""
    sel = select.select_pages(corpora.events_observations(spark, sf_dir), HISTORY_DAYS)
    ev = corpora.events_occurrences(spark, sf_dir)
    occ = sel.select("owner", "obs_id").join(
        ev.select("owner", "obs_id", joins.element_key().alias("element")), ["owner", "obs_id"])
    return induce.sg_induce(occ.select("owner", F.col("obs_id").alias("page"), "element"))


def as_rows(induced: DataFrame) -> DataFrame:
    """Flat, hash-friendly form: signature and pages as joined strings."""
    return induced.select(
        F.col("owner").cast("long").alias("owner"),
        F.array_join("signature", "|").alias("signature"),
        F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"),
        F.size("pages").cast("long").alias("n_pages"),
        F.size("signature").cast("long").alias("n_elements"),
    )
