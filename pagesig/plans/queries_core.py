"""Registered queries: selection windows and induction."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesig.operators import induce, select
from pagesig.plans import induction
from pagesig.plans import oracle_induction as oi
from pagesig.plans.registry import register
from pagesig.sources import corpora

_ORD = "WITH " + oi.orders_obs_cte() + "," + oi.selection_ctes(3650)


@register("sg_induce", oi.sg_induce_orders())
def q_sg_induce(spark, sf_dir):
    return induction.as_rows(induction.induce_orders(spark, sf_dir))


@register("wn_history", "WITH " + oi.orders_obs_cte() + "," + oi.selection_ctes(180) + """
SELECT CAST(owner AS BIGINT) AS owner, CAST(obs_id AS BIGINT) AS obs_id, host FROM hist""")
def q_wn_history(spark, sf_dir):
    obs = corpora.orders_observations(spark, sf_dir)
    return select.wn_history(obs, 180).select("owner", "obs_id", "host")


@register("wn_latest_per_host", _ORD + """
SELECT CAST(owner AS BIGINT) AS owner, host, CAST(obs_id AS BIGINT) AS obs_id FROM latest""")
def q_wn_latest_per_host(spark, sf_dir):
    obs = corpora.orders_observations(spark, sf_dir)
    return select.wn_latest_per_host(select.wn_history(obs, 3650)).select("owner", "host", "obs_id")


@register("wn_last_k_hosts", _ORD + """
SELECT CAST(owner AS BIGINT) AS owner, host, CAST(obs_id AS BIGINT) AS obs_id, CAST(rnk AS INT) AS rank
FROM sel""")
def q_wn_last_k_hosts(spark, sf_dir):
    obs = corpora.orders_observations(spark, sf_dir)
    return select.select_pages(obs, 3650).select("owner", "host", "obs_id",
                                                 F.col("rank").cast("int").alias("rank"))


# ---------------------------------------------------------------- induction steps

def _parts(spark, sf_dir):
    return induce.induction_parts(induction.orders_occurrences_selected(spark, sf_dir))


def _pages_str(col):
    return F.array_join(F.transform(col, lambda p: p.cast("string")), ",")


def _profile_str(col):
    return F.array_join(F.transform(col, lambda s: F.concat(s["element"], F.lit("*"),
                                                            s["cnt"].cast("string"))), ",")


_IND = ("WITH " + oi.orders_obs_cte() + "," + oi.selection_ctes(3650) + "," + oi.orders_occ_cte() + ","
        + oi.induction_ctes())
_PROFILE_SQL = "array_to_string(list_transform(profile, lambda s: s.element || '*' || s.cnt::VARCHAR), ',')"
_PAGES_SQL = "array_to_string(list_transform(pages, lambda p: p::VARCHAR), ',')"


@register("sg_lines", _IND + """
SELECT CAST(owner AS BIGINT) AS owner, element, CAST(page AS BIGINT) AS page, CAST(cnt AS BIGINT) AS cnt
FROM lines""")
def q_sg_lines(spark, sf_dir):
    return _parts(spark, sf_dir)["lines"].select(
        "owner", "element", "page", F.col("cnt").cast("long").alias("cnt"))


@register("sg_classes", _IND + """
SELECT CAST(owner AS BIGINT) AS owner, element, CAST(spread AS BIGINT) AS spread,
       CASE WHEN spread > 3 THEN 'DX' WHEN spread >= 2 THEN 'NX' ELSE 'UN' END AS cls,
       array_to_string(list_transform(counts, lambda c: c::VARCHAR), ',') AS counts
FROM shapes""")
def q_sg_classes(spark, sf_dir):
    return _parts(spark, sf_dir)["shapes"].select(
        "owner", "element", F.col("spread").cast("long").alias("spread"), "cls",
        F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"))


@register("sg_only_nx", _IND + """
SELECT CAST(owner AS BIGINT) AS owner, CAST(page AS BIGINT) AS page FROM grouped WHERE only_nx""")
def q_sg_only_nx(spark, sf_dir):
    return induce.sg_only_nx(_parts(spark, sf_dir)["grouped"])


@register("sg_dx_groups", _IND + f"""
SELECT CAST(owner AS BIGINT) AS owner, {_PROFILE_SQL} AS profile, {_PAGES_SQL} AS pages
FROM (SELECT owner, gid, any_value(profile) AS profile, list(page ORDER BY page) AS pages
      FROM grouped GROUP BY owner, gid)""")
def q_sg_dx_groups(spark, sf_dir):
    g = _parts(spark, sf_dir)["grouped"].groupBy("owner", "gid").agg(
        F.first("profile").alias("profile"), F.sort_array(F.collect_list("page")).alias("pages"))
    return g.select("owner", _profile_str(F.col("profile")).alias("profile"),
                    _pages_str(F.col("pages")).alias("pages"))


@register("sg_candidates", _IND + f"""
SELECT CAST(g.owner AS BIGINT) AS owner, CAST(o.n0 AS BIGINT) AS n0, {_PROFILE_SQL} AS profile,
       {_PAGES_SQL} AS pages
FROM groups g JOIN owners o USING (owner)""")
def q_sg_candidates(spark, sf_dir):
    p = _parts(spark, sf_dir)
    g = p["groups"].join(p["owners"].select("owner", "n0"), "owner")
    return g.select("owner", F.col("n0").cast("long").alias("n0"),
                    _profile_str(F.col("profile")).alias("profile"), _pages_str(F.col("pages")).alias("pages"))


@register("sg_eliminate", _IND + f"""
SELECT CAST(g.owner AS BIGINT) AS owner, {_PAGES_SQL} AS pages
FROM groups g SEMI JOIN eliminated e USING (owner, gid)""")
def q_sg_eliminate(spark, sf_dir):
    p = _parts(spark, sf_dir)
    g = p["groups"].join(p["eliminated"], ["owner", "gid"], "left_semi")
    return g.select("owner", _pages_str(F.col("pages")).alias("pages"))


@register("sg_refine", _IND + """
,
refined AS (
  SELECT g.owner, s.element, string_agg(g.pidx::VARCHAR, ',' ORDER BY g.pidx) AS block
  FROM grouped g JOIN shapes s ON s.owner = g.owner AND s.spread BETWEEN 2 AND 3
  GROUP BY g.owner, s.element, g.gid, s.counts[g.pidx + 1])
SELECT CAST(owner AS BIGINT) AS owner, element, string_agg(block, '|' ORDER BY block) AS blocks
FROM refined GROUP BY owner, element""")
def q_sg_refine(spark, sf_dir):
    p = _parts(spark, sf_dir)
    text = F.transform("blocks", lambda b: F.array_join(b.cast("array<string>"), ","))
    return induce.sg_refine(p["grouped"], p["shapes"]).select(
        "owner", "element", F.array_join(F.sort_array(text), "|").alias("blocks"))


@register("sg_noise", _IND + f""",
sizes AS (SELECT owner, page, count(*) AS n FROM occ GROUP BY owner, page),
sig AS (SELECT owner, signature, pages, unnest(pages) AS page FROM induced WHERE len(signature) > 0)
SELECT CAST(sig.owner AS BIGINT) AS owner, array_to_string(signature, '|') AS signature,
       {_PAGES_SQL} AS pages, CAST(sum(n) - len(signature) * len(pages) AS BIGINT) AS noise
FROM sig JOIN sizes USING (owner, page) GROUP BY sig.owner, signature, pages""")
def q_sg_noise(spark, sf_dir):
    p = _parts(spark, sf_dir)
    n = induce.sg_noise(p["induced"], p["occ"])
    return n.select("owner", F.array_join("signature", "|").alias("signature"),
                    _pages_str(F.col("pages")).alias("pages"), F.col("noise").cast("long").alias("noise"))


@register("sg_induce_events", oi.sg_induce_events())
def q_sg_induce_events(spark, sf_dir):
    """Second corpus (observation = user and day) at the default 180-day history."""
    return induction.as_rows(induction.induce_events(spark, sf_dir))


# ---------------------------------------------------------------- aggregations / multisets

from pagesig.functions import multiset as MS  # noqa: E402
from pagesig.operators import aggregate  # noqa: E402

_ORDER_OCC_SQL = """
WITH occ AS (SELECT l.l_orderkey AS obs_id, 'Ltexts:' || p.p_brand AS element
             FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey)"""


def _orders_occ(spark, sf_dir):
    from pagesig.operators.joins import element_key
    occ = corpora.orders_occurrences(spark, sf_dir)
    return occ.select("obs_id", element_key().alias("element"))


@register("ag_elements_per_obs", _ORDER_OCC_SQL + """
SELECT CAST(obs_id AS BIGINT) AS obs_id, array_to_string(list(element ORDER BY element), '|') AS elements,
       CAST(count(*) AS BIGINT) AS n
FROM occ GROUP BY obs_id""")
def q_ag_elements_per_obs(spark, sf_dir):
    a = aggregate.ag_elements_per_obs(_orders_occ(spark, sf_dir))
    return a.select("obs_id", F.array_join("elements", "|").alias("elements"),
                    F.size("elements").cast("long").alias("n"))


@register("ag_multiset", _ORDER_OCC_SQL + """
SELECT CAST(obs_id AS BIGINT) AS obs_id, element, CAST(count(*) AS BIGINT) AS cnt FROM occ GROUP BY ALL""")
def q_ag_multiset(spark, sf_dir):
    return aggregate.ag_multiset(_orders_occ(spark, sf_dir), ["obs_id"], "element") \
        .select("obs_id", "element", F.col("cnt").cast("long").alias("cnt"))


@register("ag_multiset_expand", _ORDER_OCC_SQL + """,
ms AS (SELECT obs_id, element, count(*) AS cnt FROM occ GROUP BY ALL)
SELECT CAST(obs_id AS BIGINT) AS obs_id,
       array_to_string(flatten(list(list_transform(range(cnt), lambda i: element) ORDER BY element)), '|')
         AS expanded
FROM ms GROUP BY obs_id""")
def q_ag_multiset_expand(spark, sf_dir):
    ms = aggregate.ag_multiset_column(_orders_occ(spark, sf_dir), ["obs_id"], "element")
    return ms.select("obs_id", F.array_join(MS.expand(F.col("ms")), "|").alias("expanded"))


@register("ag_serialize", _ORDER_OCC_SQL + """,
ms AS (SELECT obs_id, element, count(*) AS cnt FROM occ GROUP BY ALL)
SELECT CAST(obs_id AS BIGINT) AS obs_id, string_agg(repeat(element, cnt::BIGINT), '' ORDER BY element) AS serialized
FROM ms GROUP BY obs_id""")
def q_ag_serialize(spark, sf_dir):
    ms = aggregate.ag_multiset_column(_orders_occ(spark, sf_dir), ["obs_id"], "element")
    return ms.select("obs_id", MS.serialize(F.col("ms")).alias("serialized"))


@register("ag_flatset", _IND + """
SELECT DISTINCT CAST(owner AS BIGINT) AS owner, element FROM occ""")
def q_ag_flatset(spark, sf_dir):
    occ = induction.orders_occurrences_selected(spark, sf_dir)
    return aggregate.ag_flatset(occ, ["owner"])


@register("ag_owner_ids_distinct", """
WITH old AS (SELECT o_custkey AS owner, o_orderkey AS obs_id FROM orders
             WHERE o_orderdate <= TIMESTAMP '2000-01-01 00:00:00')
SELECT DISTINCT CAST(owner AS BIGINT) AS owner, 'observation' AS kind, CAST(obs_id AS BIGINT) AS id FROM old
UNION ALL
SELECT DISTINCT CAST(old.owner AS BIGINT), 'element', CAST(l.l_partkey AS BIGINT) FROM lineitem l JOIN old ON l.l_orderkey = old.obs_id""")
def q_ag_owner_ids_distinct(spark, sf_dir):
    """The ids that expiry would delete, per owner, unpacked from their bitmaps."""
    obs = corpora.orders_observations(spark, sf_dir)
    bridge = corpora.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("obs_id"), F.col("l_partkey").alias("element_id"))
    packed = aggregate.ag_owner_ids_distinct(obs, bridge, "2000-01-01 00:00:00")
    return aggregate.bitmap_ids(packed, "id").select(F.col("owner").cast("long"), "kind", "id")
