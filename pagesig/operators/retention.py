"""Retention: expire old observations / signatures and everything left unreferenced.

Set-based form of the row-at-a-time deletes: filter the expired rows, then keep only the
dependent rows that the survivors still reference (left semi-joins). Idempotent.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesig.operators.sinks import load_store, save_batch


def _cutoff(as_of, months: int):
    """as_of - months as a wall-clock timestamp (a datetime or 'yyyy-MM-dd HH:mm:ss' text);
    independent of the session time zone."""
    text = as_of.isoformat(sep=" ") if hasattr(as_of, "isoformat") else str(as_of)
    return F.lit(text).cast("timestamp_ntz") - F.make_ym_interval(F.lit(0), F.lit(months))


def rt_expire_observations(store: dict, as_of, months: int = 6) -> dict:
    """Drop observations with time <= as_of - months and their bridge rows, then elements no
    bridge row refers to, then owners neither observations nor signatures refer to."""
    obs = store["observations"].where(F.col("time") > _cutoff(as_of, months))
    bridge = store["bridge"].join(obs.select(F.col("id").alias("defaces_id")), "defaces_id", "left_semi")
    elems = store["elements"].join(bridge.select(F.col("elements_defaces_id").alias("id")), "id", "left_semi")
    referenced = obs.select(F.col("notifier_id").alias("id"))
    if "signatures" in store:
        referenced = referenced.unionByName(store["signatures"].select(F.col("notifier_id").alias("id")))
    owners = store["owners"].join(referenced, "id", "left_semi")
    out = dict(store)
    out.update(observations=obs, bridge=bridge, elements=elems, owners=owners)
    return out


def rt_expire_signatures(store: dict, as_of, months: int = 6) -> dict:
    """Same for signatures by their timestamp: signature rows, their element links, elements
    of the signature dictionary left unlinked, owners left unreferenced."""
    sigs = store["signatures"].where(F.col("timestamp") > _cutoff(as_of, months))
    sb = store["sig_bridge"].join(sigs.select(F.col("id").alias("sig_id")), "sig_id", "left_semi")
    sel = store["sig_elements"].join(sb.select(F.col("element_id").alias("id")), "id", "left_semi")
    referenced = sigs.select(F.col("notifier_id").alias("id"))
    if "observations" in store:
        referenced = referenced.unionByName(store["observations"].select(F.col("notifier_id").alias("id")))
    owners = store["owners"].join(referenced, "id", "left_semi")
    out = dict(store)
    out.update(signatures=sigs, sig_bridge=sb, sig_elements=sel, owners=owners)
    return out


def expire_stored(spark, path: str, tables: list[str], expire) -> None:
    """Expiry on a store of `save_batch`: what `expire` (store -> store) keeps is published as the new
    base of all batches, in one step; run again, it keeps the same rows."""
    store, cursors, last = load_store(spark, path, tables)
    kept = expire(store)
    save_batch({name: kept[name] for name in tables}, cursors, path, last, base=True)
