"""Registered queries: store round trips (ingest, reconcile, retention) and streaming forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pagesig.operators import extract as X
from pagesig.operators import induce, select
from pagesig.operators import joins as J
from pagesig.operators import match as M
from pagesig.operators import retention as RT
from pagesig.operators import sinks as SK
from pagesig.plans import induction
from pagesig.plans import oracle_induction as oi
from pagesig.plans.queries_extract import TEXTS_CTE
from pagesig.plans.queries_match import _VERDICTS, fuzzy_hash_sql, learned_scan
from pagesig.plans.queries_net import host_sql
from pagesig.plans.registry import register
from pagesig.plans.scan import learned_library, learned_store, library_from_store
from pagesig.session import reuse
from pagesig.sources import corpora
from pagesig.sources import readers as R
from pagesig.streaming import incremental as ST

# ---------------------------------------------------------------- ingest

def _page_batch(spark, sf_dir):
    obs = corpora.pages_observations(spark, sf_dir).select(
        F.col("obs_id").alias("obs_key"), "owner", "time", "url", F.lit("mirror-1").alias("mirrorsrc"))
    occ = X.ext_page_elements(corpora.table(spark, sf_dir, "pages")).select(
        F.col("page_id").alias("obs_key"), "type", "element", "resource")
    return obs, occ


@register("snk_ingest", TEXTS_CTE + f""",
el AS (SELECT page_id, CASE WHEN octet_length(encode(value)) <= 1000 THEN 'L' ELSE 'H' END || 'texts' AS type, value
       FROM texts WHERE length(value) >= 3)
SELECT 'owners' AS tbl, CAST(count(DISTINCT split_part({host_sql('url')}, '.', -1)) AS BIGINT) AS n_rows,
       CAST(count(DISTINCT split_part({host_sql('url')}, '.', -1)) AS BIGINT) AS n_keys FROM pages
UNION ALL SELECT 'observations', 2 * count(*), 2 * count(*) FROM pages
UNION ALL SELECT 'elements', count(DISTINCT (type, value)), count(DISTINCT (type, value)) FROM el
UNION ALL SELECT 'bridge', 2 * count(*), 2 * count(DISTINCT (page_id, type, value)) FROM el""")
def q_snk_ingest(spark, sf_dir):
    """The pages batch ingested twice into an empty store: owners and elements are created
    once, observations and occurrence rows twice."""
    obs, occ = _page_batch(spark, sf_dir)
    store = SK.snk_ingest(obs, occ, SK.empty_store(spark))
    store = SK.snk_ingest(obs.withColumn("obs_key", F.col("obs_key") + 1_000_000_000),
                          occ.withColumn("obs_key", F.col("obs_key") + 1_000_000_000), store)
    parts = []
    for name in ("owners", "observations", "elements"):
        t = store[name]
        parts.append(t.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_keys"))
                     .select(F.lit(name).alias("tbl"), "n_rows", "n_keys"))
    b = store["bridge"]
    parts.append(b.agg(F.count(F.lit(1)).alias("n_rows"),
                       F.count_distinct("defaces_id", "elements_defaces_id").alias("n_keys"))
                 .select(F.lit("bridge").alias("tbl"), "n_rows", "n_keys"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("tbl", F.col("n_rows").cast("long"), F.col("n_keys").cast("long"))


# ---------------------------------------------------------------- reconcile signatures

def _stored_and_induced(spark, sf_dir):
    stored_ind = induction.induce_orders(spark, sf_dir, 1000)
    induced = induction.induce_orders(spark, sf_dir, 3650)
    st = stored_ind.select("owner", "signature", F.array_join(F.array_sort("signature"), "\u0001").alias("skey"))
    st = SK.assign_ids(st, ["owner", "skey"], 1)
    signatures = st.select("id", F.col("owner").alias("notifier_id"), F.lit(0).alias("detection"),
                           F.lit("2001-01-01 00:00:00").cast("timestamp_ntz").alias("timestamp"))
    sig_bridge = st.select(F.col("id").alias("sig_id"), F.explode("signature").alias("element"))
    return induced, signatures, sig_bridge


def _two_inductions_sql() -> str:
    return f"""
WITH a AS ({oi.sg_induce_orders(3650)}),
b0 AS ({oi.sg_induce_orders(1000)}),
b AS (SELECT *, row_number() OVER (ORDER BY owner, replace(signature, '|', chr(1))) AS sig_id FROM b0)"""


@register("jn_signature_equal", _two_inductions_sql() + """
SELECT a.owner, a.signature, CAST(min(b.sig_id) AS BIGINT) AS sig_id
FROM a JOIN b ON a.owner = b.owner AND a.signature = b.signature GROUP BY a.owner, a.signature""")
def q_jn_signature_equal(spark, sf_dir):
    induced, signatures, sig_bridge = _stored_and_induced(spark, sf_dir)
    m = SK.jn_signature_equal(induced, signatures, sig_bridge)
    return m.select(F.col("owner").cast("long"), F.array_join("signature", "|").alias("signature"),
                    F.col("sig_id").cast("long"))


@register("snk_signatures", _two_inductions_sql() + """,
was AS (SELECT b.sig_id, b.owner, b.signature, a.owner IS NOT NULL AS again FROM b LEFT JOIN a ON a.owner = b.owner AND a.signature = b.signature),
fresh AS (SELECT a.owner, a.signature, (SELECT count(*) FROM b) + row_number() OVER (ORDER BY a.owner, replace(a.signature, '|', chr(1))) AS sig_id
          FROM a ANTI JOIN b ON a.owner = b.owner AND a.signature = b.signature),
sigs AS (SELECT sig_id, owner, signature, CASE WHEN again THEN TIMESTAMP '2001-09-01' ELSE TIMESTAMP '2001-01-01' END AS ts FROM was
         UNION ALL SELECT sig_id, owner, signature, TIMESTAMP '2001-09-01' FROM fresh),
used AS (SELECT sig_id, owner, ts, unnest(string_split(signature, '|')) AS ekey FROM sigs),
firsts AS (SELECT ekey, min(sig_id) <= (SELECT count(*) FROM b) AS old FROM used GROUP BY ekey),
el AS (SELECT row_number() OVER (ORDER BY old DESC, ekey) AS element_id, ekey, split_part(ekey, ':', 1) AS type,
              split_part(ekey, ':', 2) AS element FROM firsts),""" + fuzzy_hash_sql("el", "element_id", "element") + """
SELECT CAST(u.sig_id AS BIGINT) AS sig_id, CAST(u.owner AS BIGINT) AS notifier_id, 0 AS detection, u.ts AS timestamp,
       CAST(e.element_id AS BIGINT) AS element_id, e.type, e.element, h.hash, 'mirror/' || e.element || '.html' AS resource
FROM used u JOIN el e USING (ekey) JOIN hashes h ON h.code = e.element_id""")
def q_snk_signatures(spark, sf_dir):
    """Signatures of two inductions merged into a store on disk, the second run refreshing what the
    first one stored: all rows of the three tables, joined."""
    path, tables = ST.scratch_path(spark, "signatures"), ["signatures", "sig_bridge", "sig_elements"]
    known = corpora.orders_elements(spark, sf_dir).select("type", "element").distinct().select(
        F.concat_ws(":", "type", "element").alias("ekey"), "type", F.encode("element", "UTF-8").alias("element"),
        F.concat(F.lit("mirror/"), "element", F.lit(".html")).alias("resource"))
    store = SK.empty_signature_store(spark)
    for run, (days, as_of) in enumerate(((1000, "2001-01-01 00:00:00"), (3650, "2001-09-01 00:00:00"))):
        merged = SK.merge_signatures(induction.induce_orders(spark, sf_dir, days), store, known, as_of)
        SK.save_batch(merged, {"as_of": as_of}, path, run, base=True)
        store, _, _ = SK.load_store(spark, path, tables)
    el = store["sig_elements"].withColumnRenamed("id", "element_id").withColumn("element", F.decode("element", "UTF-8"))
    return store["signatures"].withColumnRenamed("id", "sig_id").join(store["sig_bridge"], "sig_id").join(el, "element_id").select(
        "sig_id", F.col("notifier_id").cast("long"), "detection", "timestamp", "element_id", "type", "element", "hash", "resource")


@register("jn_new_keys", TEXTS_CTE + f""",
hosts AS (SELECT page_id, {host_sql('url')} AS host FROM pages),
newest AS (SELECT max(page_id) AS page_id FROM hosts GROUP BY host),
pe AS (SELECT page_id, CASE WHEN octet_length(encode(value)) <= 1000 THEN 'L' ELSE 'H' END || 'texts' AS type, value
       FROM texts WHERE length(value) >= 3),
lib AS (SELECT type, value FROM pe WHERE page_id IN (SELECT page_id FROM newest))
SELECT DISTINCT type, sha256(value) AS element_sha FROM pe
WHERE (type, value) NOT IN (SELECT (type, value) FROM lib)""")
def q_jn_new_keys(spark, sf_dir):
    """Page elements not yet in the element dictionary of the newest pages' signatures."""
    pages = X.ext_page_elements(corpora.table(spark, sf_dir, "pages"))
    lib, _ = M.page_library(pages, corpora.pages_observations(spark, sf_dir))
    pe = pages.select("type", F.sha2("element", 256).alias("element_sha"))
    dic = lib.select("type", F.sha2("element", 256).alias("element_sha"))
    return J.jn_new_keys(pe, dic, ["type", "element_sha"])


@register("jn_obs_elements", "WITH " + oi.orders_obs_cte() + "," + oi.selection_ctes(3650) + "," + oi.orders_occ_cte()
          + "\nSELECT CAST(owner AS BIGINT) AS owner, CAST(page AS BIGINT) AS page, element FROM occ")
def q_jn_obs_elements(spark, sf_dir):
    return induction.orders_occurrences_selected(spark, sf_dir)


def _orders_store(spark, sf_dir):
    c = corpora.table(spark, sf_dir, "customer")
    o = corpora.table(spark, sf_dir, "orders")
    li = corpora.table(spark, sf_dir, "lineitem")
    p = corpora.table(spark, sf_dir, "part")
    return {
        "owners": c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        "observations": o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("time"),
                                 F.col("o_custkey").alias("notifier_id"),
                                 F.concat(F.lit("http://h"), (F.col("o_orderkey") % 13).cast("string"),
                                          F.lit(".example.com/")).alias("url"),
                                 F.lit("mirror-1").alias("mirrorsrc")),
        "bridge": li.select(F.col("l_orderkey").alias("defaces_id"), F.col("l_partkey").alias("elements_defaces_id")),
        "elements": p.select(F.col("p_partkey").alias("id"), F.lit("Ltexts").alias("type"),
                             F.encode("p_brand", "UTF-8").alias("element"), F.lit(None).cast("string").alias("hash"),
                             F.lit(None).cast("string").alias("resource")),
    }


@register("src_observations", """
SELECT c.c_name AS owner, o.o_orderkey AS obs_id, o.o_orderdate AS time,
       'http://h' || (o.o_orderkey % 13)::VARCHAR || '.example.com/' AS url, 'Ltexts' AS type, p.p_brand AS element
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
JOIN part p ON p.p_partkey = l.l_partkey""")
def q_src_observations(spark, sf_dir):
    s = _orders_store(spark, sf_dir)
    r = R.src_observations(s["owners"], s["observations"], s["bridge"], s["elements"])
    return r.select("owner", "obs_id", "time", "url", "type", F.decode("element", "UTF-8").alias("element"))


# ---------------------------------------------------------------- retention

@register("rt_expire_observations", """
WITH cutoff AS (SELECT max(o_orderdate) - INTERVAL 6 MONTH AS cut FROM orders),
obs AS (SELECT o_orderkey, o_custkey FROM orders, cutoff WHERE o_orderdate > cut),
br AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM obs)),
el AS (SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM br)),
ow AS (SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM obs))
SELECT 'observations' AS tbl, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS ref FROM obs
UNION ALL SELECT 'bridge', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR) FROM br
UNION ALL SELECT 'elements', CAST(p_partkey AS VARCHAR), NULL FROM el
UNION ALL SELECT 'owners', CAST(c_custkey AS VARCHAR), NULL FROM ow""")
def q_rt_expire_observations(spark, sf_dir):
    """All rows that a stored set of tables keeps after expiry; a second run changes nothing."""
    path, tables = ST.scratch_path(spark, "observations"), ["observations", "bridge", "elements", "owners"]
    as_of = corpora.table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).first()[0]
    SK.save_batch(_orders_store(spark, sf_dir), {}, path, 0)
    for _ in range(2):
        RT.expire_stored(spark, path, tables, lambda s: RT.rt_expire_observations(s, as_of, 6))
    s, _, _ = SK.load_store(spark, path, tables)
    return _all_rows(s, {"observations": ("id", "notifier_id"), "bridge": ("defaces_id", "elements_defaces_id"),
                         "elements": ("id", None), "owners": ("id", None)})


def _all_rows(store, columns):
    parts = [store[t].select(F.lit(t).alias("tbl"), F.col(a).cast("string").alias("id"), (F.col(b) if b else F.lit(None)).cast("string").alias("ref"))
             for t, (a, b) in columns.items()]
    return reduce(lambda x, y: x.unionByName(y), parts)


@register("rt_expire_signatures", f"""
WITH sig0 AS ({oi.sg_induce_orders(3650)}),
sig AS (SELECT row_number() OVER (ORDER BY owner, replace(signature, '|', chr(1))) AS id, owner, signature, pages FROM sig0),
st AS (SELECT s.id, any_value(s.owner) AS owner, max(o.o_orderdate) AS ts
       FROM sig s, unnest(string_split(s.pages, ',')) AS u(pg) JOIN orders o ON o.o_orderkey = CAST(u.pg AS BIGINT)
       GROUP BY s.id),
cutoff AS (SELECT max(o_orderdate) - INTERVAL 6 MONTH AS cut FROM orders),
keep AS (SELECT st.* FROM st, cutoff WHERE ts > cut),
sb AS (SELECT s.id AS sig_id, unnest(string_split(s.signature, '|')) AS element FROM sig s WHERE s.id IN (SELECT id FROM keep)),
ow AS (SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT owner FROM keep))
SELECT 'signatures' AS tbl, CAST(id AS VARCHAR) AS id, CAST(owner AS VARCHAR) AS ref FROM keep
UNION ALL SELECT 'sig_bridge', CAST(sig_id AS VARCHAR), element FROM sb
UNION ALL SELECT DISTINCT 'sig_elements', element, NULL FROM sb
UNION ALL SELECT 'owners', CAST(c_custkey AS VARCHAR), NULL FROM ow""")
def q_rt_expire_signatures(spark, sf_dir):
    """All rows that the stored signatures keep after expiry; a second run changes nothing."""
    path, tables = ST.scratch_path(spark, "signatures"), ["signatures", "sig_bridge", "sig_elements", "owners"]
    as_of = corpora.table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).first()[0]
    SK.save_batch(learned_store(spark, sf_dir), {}, path, 0)
    for _ in range(2):
        RT.expire_stored(spark, path, tables, lambda s: RT.rt_expire_signatures(s, as_of, 6))
    s, _, _ = SK.load_store(spark, path, tables)
    return _all_rows(s, {"signatures": ("id", "notifier_id"), "sig_bridge": ("sig_id", "element_id"),
                         "sig_elements": ("id", None), "owners": ("id", None)})


@register("src_signature_store", f"""
WITH sig0 AS ({oi.sg_induce_orders(3650)}),
sig AS (SELECT row_number() OVER (ORDER BY owner, replace(signature, '|', chr(1))) AS id, owner, signature, pages FROM sig0),
st AS (SELECT s.id, any_value(s.owner) AS owner, max(o.o_orderdate) AS ts
       FROM sig s, unnest(string_split(s.pages, ',')) AS u(pg) JOIN orders o ON o.o_orderkey = CAST(u.pg AS BIGINT)
       GROUP BY s.id),
el AS (SELECT id, unnest(string_split(signature, '|')) AS e FROM sig)
SELECT CAST(el.id AS BIGINT) AS sig_id, c.c_name AS owner, st.ts AS detected_on,
       split_part(el.e, ':', 1) AS type, split_part(el.e, ':', 2) AS element
FROM el JOIN st USING (id) JOIN customer c ON c.c_custkey = st.owner""")
def q_src_signature_store(spark, sf_dir):
    """The library a scan would load: signatures induced from the orders, stored (signatures, bridge,
    element dictionary, owners) and joined back, one row per element of each signature."""
    s = learned_store(spark, sf_dir)
    elements = s["sig_bridge"].select("element_id").distinct().select(
        F.col("element_id").alias("id"), F.substring_index("element_id", ":", 1).alias("type"),
        F.encode(F.expr("substring(element_id, instr(element_id, ':') + 1)"), "UTF-8").alias("element"))
    rows, meta = library_from_store(s["signatures"], s["sig_bridge"], elements, s["owners"])
    return rows.join(meta, "sig_id").select("sig_id", "owner", "detected_on", "type", F.decode("element", "UTF-8").alias("element"))


# ---------------------------------------------------------------- verdict sink and streams

@register("snk_verdicts", _VERDICTS)
def q_snk_verdicts(spark, sf_dir):
    """Verdicts of all orders, written under their scan date and read back; the second run replaces
    the first."""
    pages, scan, meta = learned_scan(spark, sf_dir)
    verdicts, path = M.mt_verdict(pages, scan, meta), ST.scratch_path(spark, "verdicts")
    SK.snk_verdicts(verdicts.where(F.col("found")), path, "2024-01-31")
    return SK.snk_verdicts(verdicts, path, "2024-01-31").drop("scan_date")


def _stream_table(spark, sf_dir, name):
    return ST.stream_parquet(spark, f"{sf_dir}/{name}.parque[t]", base_path=sf_dir)


@register("st_ingest", """
SELECT DISTINCT ts AS time, user_id AS owner, 'http://mirror.example/' || event_id::VARCHAR AS url,
       'mirror-1' AS mirrorsrc FROM events""")
def q_st_ingest(spark, sf_dir):
    """Every report arrives twice (two reads of the source); the stream keeps one of each."""
    s = _stream_table(spark, sf_dir, "events")
    obs = s.select(F.col("ts").alias("time"), F.col("user_id").alias("owner"),
                   F.concat(F.lit("http://mirror.example/"), F.col("event_id").cast("string")).alias("url"),
                   F.lit("mirror-1").alias("mirrorsrc"))
    return ST.st_ingest(obs.unionByName(obs), ["time", "owner", "url", "mirrorsrc"], "time",
                        ST.scratch_path(spark, "ingest"))


@register("st_reinduce", oi.sg_induce_orders())
def q_st_reinduce(spark, sf_dir):
    """Orders arriving as a stream; each micro-batch re-induces the owners it touched."""
    obs_all = corpora.orders_observations(spark, sf_dir)
    bridge, elements = corpora.orders_bridge(spark, sf_dir), corpora.orders_elements(spark, sf_dir)

    def induce_for(touched):
        sel = select.select_pages(obs_all.join(touched, "owner", "left_semi"), induction.ORDERS_HISTORY_DAYS)
        return induction.as_rows(induce.sg_induce(J.jn_obs_bridge_elements(sel, bridge, elements)))

    s = _stream_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"))
    return ST.st_reinduce(s, induce_for, ST.scratch_path(spark, "reinduce"))


@register("st_scan", _VERDICTS)
def q_st_scan(spark, sf_dir):
    """Orders arriving as a stream of pages, scored per micro-batch against the learned library."""
    rows, meta = learned_library(spark, sf_dir)
    library, elements = M.Library(rows), corpora.orders_shown(spark, sf_dir)

    def score(batch):
        pages = reuse(batch)
        return M.mt_verdict(pages, M.Scan(library, elements.join(pages, "page_id", "left_semi")), meta)

    stream = _stream_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"))
    return ST.st_scan(stream, score, ST.scratch_path(spark, "scan"))
