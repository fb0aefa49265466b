"""Relational joins of the pipeline (observations, elements, owners)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def element_key(type_col: str = "type", element_col: str = "element"):
    """Identity of an element = (type, bytes); one string key for grouping. Bytes that are not
    UTF-8 (images) are spelled out in hexadecimal behind a control character, so that no two
    elements share a key and no byte is lost."""
    text = F.col(element_col).cast("string")
    return F.concat_ws(":", F.col(type_col), F.when(F.is_valid_utf8(text), text).otherwise(
        F.concat(F.lit("\u0001"), F.hex(F.col(element_col).cast("binary")))))


def jn_active_owners(obs: DataFrame, id_start, id_end) -> DataFrame:
    """Owners having an observation with id_start < id <= id_end (DISTINCT join as a semi-join)."""
    recent = obs.where((F.col("obs_id") > F.lit(id_start)) & (F.col("obs_id") <= F.lit(id_end)))
    return recent.where(F.col("owner").isNotNull()).select("owner").distinct()


def jn_obs_elements(selected: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Selected observations joined to their element occurrences -> (owner, page, element).

    Observations without elements disappear (the inner join), as in the original; the
    selection (<= k rows per owner) is the small side and drives a semi-join-like equi-join.
    """
    occ = occurrences.select("obs_id", element_key().alias("element"))
    return selected.select("owner", "obs_id").join(occ, "obs_id") \
        .select("owner", F.col("obs_id").alias("page"), "element")


def jn_new_keys(batch: DataFrame, dictionary: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct key values of the batch that are not yet in the dictionary."""
    return batch.select(*keys).distinct().join(dictionary.select(*keys), keys, "left_anti")


def jn_obs_bridge_elements(selected: DataFrame, bridge: DataFrame, elements: DataFrame) -> DataFrame:
    """Same result as jn_obs_elements over a normalised store, joined in the selective order:
    the selection (<= k rows per owner) first cuts the bridge -- the largest table -- and only
    the surviving occurrences meet the element dictionary."""
    occ = selected.select("owner", "obs_id").join(bridge.select("obs_id", "element_id"), "obs_id")
    el = elements.select("element_id", element_key().alias("element"))
    return occ.join(el, "element_id").select("owner", F.col("obs_id").alias("page"), "element")
