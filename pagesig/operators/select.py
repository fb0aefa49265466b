"""Selection of the pages an owner's signatures are learned from.

The per-owner loop of the original (newest observation first, keep the history window, first
observation of each host, stop at k hosts) becomes three set-based steps over all owners.

Scale notes: the anchor and the per-host maximum are plain aggregations (map-side partial
aggregation, so a hot owner or host never lands whole in one task). The top-k per owner runs
on one row per (owner, host) and is planned with a partial WindowGroupLimit before the shuffle,
so at most k rows per owner and map partition cross the network.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesig.params import HISTORY_DAYS, MAX_PAGES, PAGES_PER_OWNER


def wn_history(obs: DataFrame, days: int = HISTORY_DAYS) -> DataFrame:
    """Keep observations with time >= anchor - days, anchor = time of the owner's highest id."""
    anchor = obs.groupBy("owner").agg(F.max_by("time", "obs_id").alias("anchor"))
    kept = obs.join(anchor, "owner").where(
        F.col("time") >= F.col("anchor") - F.make_dt_interval(F.lit(days)))
    return kept.drop("anchor")


def wn_latest_per_host(obs: DataFrame, host_col: str = "host") -> DataFrame:
    """Highest-id observation per (owner, host)."""
    return obs.groupBy("owner", host_col).agg(F.max("obs_id").alias("obs_id"))


def wn_last_k_hosts(latest: DataFrame, k: int = PAGES_PER_OWNER, host_col: str = "host") -> DataFrame:
    """The k hosts whose latest observation is newest; owners with fewer than k are skipped.
    Induction encodes an owner's pages as bits of a long, hence k <= MAX_PAGES."""
    if k > MAX_PAGES:
        raise ValueError(f"k = {k}: induction takes at most {MAX_PAGES} pages per owner")
    w = Window.partitionBy("owner").orderBy(F.col("obs_id").desc(), F.col(host_col))
    top = latest.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # same partitioning as the ranking window: the gate adds no exchange
    n = F.max("rank").over(Window.partitionBy("owner"))
    return top.withColumn("_n", n).where(F.col("_n") == k).drop("_n")


def select_pages(obs: DataFrame, days: int = HISTORY_DAYS, k: int = PAGES_PER_OWNER,
                 host_col: str = "host") -> DataFrame:
    """history -> latest per host -> last k hosts; returns (owner, host, obs_id, rank)."""
    return wn_last_k_hosts(wn_latest_per_host(wn_history(obs, days), host_col), k, host_col)


def wn_best(scored: DataFrame, part_cols: list[str], score_col: str, tie_cols: list[str]) -> DataFrame:
    """Argmax per partition; ties go to the smallest tie columns (first wins)."""
    w = Window.partitionBy(*part_cols).orderBy(F.col(score_col).desc(), *[F.col(c) for c in tie_cols])
    return scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
