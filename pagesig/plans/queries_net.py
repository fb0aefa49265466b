"""Registered queries: URL and IP scalar functions (and, below, the network joins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesig.functions import ipaddr as IP
from pagesig.functions import urls as U
from pagesig.params import DNS_NO_RECORD, DNS_NOT_IPV4
from pagesig.plans.registry import register
from pagesig.sources import corpora

# ---------------------------------------------------------------- URL functions
# Inputs derived from pages.url: as given, without scheme, and with userinfo / upper case / port.

_URL_FORMS_SQL = """
WITH u AS (
  SELECT page_id, url,
         regexp_replace(url, '^[a-z]+://', '') AS bare,
         'HTTP://User@' || upper(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || ':8080/x?a' AS full_form
  FROM pages)"""

_HOST_SQL = """nullif(lower(regexp_extract(regexp_extract(regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1), '([^@]*)$', 1), '^([^:]*)', 1)), '')"""
_HOST2_SQL = """nullif(lower(regexp_extract(regexp_extract(regexp_extract({x}, '^([^/?#]*)', 1), '([^@]*)$', 1), '^([^:]*)', 1)), '')"""


def host_sql(x: str) -> str:
    return f"coalesce({_HOST_SQL.format(x=x)}, {_HOST2_SQL.format(x=x)})"


def _url_forms(spark, sf_dir):
    p = corpora.table(spark, sf_dir, "pages").select("page_id", "url")
    netloc = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    return p.select("page_id", "url",
                    F.regexp_replace("url", r"^[a-z]+://", "").alias("bare"),
                    F.concat(F.lit("HTTP://User@"), F.upper(netloc), F.lit(":8080/x?a")).alias("full_form"))


@register("sc_url_host", _URL_FORMS_SQL + f"""
SELECT page_id, {host_sql('url')} AS host, {host_sql('bare')} AS host_bare, {host_sql('full_form')} AS host_full
FROM u""")
def q_sc_url_host(spark, sf_dir):
    u = _url_forms(spark, sf_dir)
    return u.select("page_id", U.url_host(F.col("url")).alias("host"),
                    U.url_host(F.col("bare")).alias("host_bare"),
                    U.url_host(F.col("full_form")).alias("host_full"))


@register("sc_url_tld", _URL_FORMS_SQL + f"""
SELECT page_id, CASE WHEN instr(h, '.') > 0 THEN split_part(h, '.', -1) END AS tld
FROM (SELECT page_id, {host_sql('full_form')} AS h FROM u)""")
def q_sc_url_tld(spark, sf_dir):
    u = _url_forms(spark, sf_dir)
    return u.select("page_id", U.url_tld(F.col("full_form")).alias("tld"))


@register("sc_last_two_labels", _URL_FORMS_SQL + f"""
SELECT page_id, CASE WHEN instr(h, '.') > 0
                     THEN array_to_string(string_split(h, '.')[-2:], '.') END AS domain
FROM (SELECT page_id, {host_sql('url')} AS h FROM u)""")
def q_sc_last_two_labels(spark, sf_dir):
    u = _url_forms(spark, sf_dir)
    return u.select("page_id", U.last_two_labels(F.col("url")).alias("domain"))


@register("sc_ensure_scheme", _URL_FORMS_SQL + """
SELECT page_id,
       CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url ELSE 'http://' || url END AS u1,
       CASE WHEN starts_with(bare, 'http://') OR starts_with(bare, 'https://') THEN bare ELSE 'http://' || bare END AS u2,
       CASE WHEN starts_with(full_form, 'http://') OR starts_with(full_form, 'https://') THEN full_form
            ELSE 'http://' || full_form END AS u3
FROM u""")
def q_sc_ensure_scheme(spark, sf_dir):
    u = _url_forms(spark, sf_dir)
    return u.select("page_id", U.ensure_scheme(F.col("url")).alias("u1"),
                    U.ensure_scheme(F.col("bare")).alias("u2"), U.ensure_scheme(F.col("full_form")).alias("u3"))


@register("ext_media_identity", """
SELECT page_id, split_part(value, '?', 1) AS element, value AS resource
FROM (SELECT page_id, url AS value FROM pages UNION ALL SELECT page_id, 'x?' || url FROM pages)
WHERE length(split_part(value, '?', 1)) >= 3""")
def q_ext_media_identity(spark, sf_dir):
    """Every page's URL as a media source, whole and behind a stem that the cut leaves too short."""
    p = corpora.table(spark, sf_dir, "pages").select("page_id", F.lit(0).alias("pos"), F.col("url").alias("value"))
    media = X.ext_media_identity(p.unionByName(p.withColumn("value", F.concat(F.lit("x?"), F.col("value")))))
    return media.select("page_id", F.col("element_text").alias("element"), "resource")


@register("sc_obs_time", """
SELECT event_id,
       CASE WHEN t > ing THEN t - INTERVAL 1 DAY ELSE t END AS obs_time
FROM (SELECT event_id, ts + INTERVAL 3 HOUR AS ing,
             strptime(strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') || ' ' || strftime(ts, '%H:%M'),
                      '%Y-%m-%d %H:%M') AS t
      FROM events)""")
def q_sc_obs_time(spark, sf_dir):
    e = corpora.table(spark, sf_dir, "events").select("event_id", "ts")
    ing = F.col("ts") + F.expr("INTERVAL 3 HOURS")
    t = U.obs_time(F.date_format("ts", "HH:mm"), ing)
    return e.select("event_id", t.cast("timestamp_ntz").alias("obs_time"))


# ---------------------------------------------------------------- IP functions
# Addresses from the ip corpus: ip = (event_id * 2654435761) % 2^32, in several textual forms.

_IP_SQL = """
WITH e AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS ip FROM events),
f AS (
  SELECT event_id, ip,
         ((ip >> 24) & 255)::VARCHAR || '.' || ((ip >> 16) & 255)::VARCHAR || '.' ||
         ((ip >> 8) & 255)::VARCHAR || '.' || (ip & 255)::VARCHAR AS quad,
         ((ip >> 24) & 255)::VARCHAR || '.' || ((ip & 255) + 100)::VARCHAR AS two,
         ((ip >> 24) & 255)::VARCHAR AS one,
         ((ip >> 24) & 255)::VARCHAR || '.' || ((ip >> 16) & 255)::VARCHAR || '.' || (ip & 255)::VARCHAR AS three,
         event_id % 40 AS mask
  FROM e)"""


def _valid_sql(x: str) -> str:
    return (f"coalesce(regexp_full_match({x}, '([0-9]{{1,3}}\\.){{0,3}}[0-9]{{1,3}}') AND "
            f"list_bool_and(list_transform(string_split({x}, '.'), lambda q: TRY_CAST(q AS INTEGER) <= 255)), false)")


def _fold_sql(lst: str) -> str:
    return f"list_reduce(list_prepend(0::BIGINT, list_transform({lst}, lambda q: TRY_CAST(q AS BIGINT))), lambda a, q: (a << 8) | q)"


def _ip2long_sql(x: str) -> str:
    q = f"string_split({x}, '.')"
    padded = (f"CASE len({q}) WHEN 1 THEN list_concat({q}, ['0','0','0']) "
              f"WHEN 2 THEN [{q}[1], '0', '0', {q}[2]] WHEN 3 THEN [{q}[1], {q}[2], '0', {q}[3]] ELSE {q} END")
    return f"CASE WHEN {_valid_sql(x)} THEN {_fold_sql(padded)} END"


def _long2ip_sql(v: str) -> str:
    return (f"CASE WHEN {v} BETWEEN 0 AND 4294967295 THEN ((({v}) >> 24) & 255)::VARCHAR || '.' || "
            f"((({v}) >> 16) & 255)::VARCHAR || '.' || ((({v}) >> 8) & 255)::VARCHAR || '.' || "
            f"(({v}) & 255)::VARCHAR END")


def _ip_forms(spark, sf_dir):
    e = corpora.event_ips(spark, sf_dir)
    ip = F.col("ip_long")
    o = lambda s: F.shiftright(ip, s).bitwiseAND(F.lit(255)).cast("string")
    return e.select(
        "event_id", ip.alias("ip"),
        F.concat_ws(".", o(24), o(16), o(8), o(0)).alias("quad"),
        F.concat_ws(".", o(24), (ip.bitwiseAND(F.lit(255)) + 100).cast("string")).alias("two"),
        o(24).alias("one"),
        F.concat_ws(".", o(24), o(16), o(0)).alias("three"),
        (F.col("event_id") % 40).alias("mask"))


@register("sc_valid_ip", _IP_SQL + f"""
SELECT event_id, {_valid_sql('quad')} AS v_quad, {_valid_sql('two')} AS v_two,
       {_valid_sql("quad || '.1'")} AS v_five, {_valid_sql("'x' || one")} AS v_alpha
FROM f""")
def q_sc_valid_ip(spark, sf_dir):
    f = _ip_forms(spark, sf_dir)
    return f.select("event_id", IP.valid_ip(F.col("quad")).alias("v_quad"),
                    IP.valid_ip(F.col("two")).alias("v_two"),
                    IP.valid_ip(F.concat(F.col("quad"), F.lit(".1"))).alias("v_five"),
                    IP.valid_ip(F.concat(F.lit("x"), F.col("one"))).alias("v_alpha"))


@register("sc_ip_to_long", _IP_SQL + f"""
SELECT event_id, {_ip2long_sql('quad')} AS l_quad, {_ip2long_sql('two')} AS l_two,
       {_ip2long_sql('one')} AS l_one, {_ip2long_sql('three')} AS l_three
FROM f""")
def q_sc_ip_to_long(spark, sf_dir):
    f = _ip_forms(spark, sf_dir)
    return f.select("event_id", IP.ip_to_long(F.col("quad")).alias("l_quad"),
                    IP.ip_to_long(F.col("two")).alias("l_two"), IP.ip_to_long(F.col("one")).alias("l_one"),
                    IP.ip_to_long(F.col("three")).alias("l_three"))


@register("sc_long_to_ip", _IP_SQL + f"""
SELECT event_id, {_long2ip_sql('ip')} AS ip_text, {_long2ip_sql('ip * 2')} AS ip_text2,
       {_long2ip_sql('ip - 2147483648')} AS ip_text3
FROM f""")
def q_sc_long_to_ip(spark, sf_dir):
    f = _ip_forms(spark, sf_dir)
    return f.select("event_id", IP.long_to_ip(F.col("ip")).alias("ip_text"),
                    IP.long_to_ip(F.col("ip") * 2).alias("ip_text2"),
                    IP.long_to_ip(F.col("ip") - F.lit(2147483648)).alias("ip_text3"))


def _valid_cidr_sql(x: str) -> str:
    ip = f"split_part({x}, '/', 1)"
    return (f"coalesce(regexp_full_match({x}, '([0-9]{{1,3}}\\.){{0,3}}[0-9]{{1,3}}/[0-9]{{1,2}}') AND "
            f"{_valid_sql(ip)} AND TRY_CAST(split_part({x}, '/', 2) AS INTEGER) <= 32, false)")


def _cidr_start_sql(x: str) -> str:
    ip = f"split_part({x}, '/', 1)"
    q = f"string_split({ip}, '.')"
    padded = f"list_concat({q}, list_transform(range(4 - len({q})), lambda i: '0'))"
    shift = f"(32 - TRY_CAST(split_part({x}, '/', 2) AS INTEGER))"
    return f"CASE WHEN {_valid_cidr_sql(x)} THEN ({_fold_sql(padded)} >> {shift}) << {shift} END"


def _cidr_end_sql(x: str) -> str:
    shift = f"(32 - TRY_CAST(split_part({x}, '/', 2) AS INTEGER))"
    return f"CASE WHEN {_valid_cidr_sql(x)} THEN {_cidr_start_sql(x)} | ((1::BIGINT << {shift}) - 1) END"


@register("sc_valid_cidr", _IP_SQL + f"""
SELECT event_id, {_valid_cidr_sql("quad || '/' || mask::VARCHAR")} AS v_full,
       {_valid_cidr_sql("two || '/' || mask::VARCHAR")} AS v_two
FROM f""")
def q_sc_valid_cidr(spark, sf_dir):
    f = _ip_forms(spark, sf_dir)
    c1 = F.concat_ws("/", "quad", F.col("mask").cast("string"))
    c2 = F.concat_ws("/", "two", F.col("mask").cast("string"))
    return f.select("event_id", IP.valid_cidr(c1).alias("v_full"), IP.valid_cidr(c2).alias("v_two"))


@register("sc_cidr_block", _IP_SQL + f""",
c AS (SELECT event_id, quad || '/' || mask::VARCHAR AS c1, two || '/' || mask::VARCHAR AS c2 FROM f)
SELECT event_id, {_long2ip_sql(_cidr_start_sql('c1'))} AS first_ip, {_long2ip_sql(_cidr_end_sql('c1'))} AS last_ip,
       {_long2ip_sql(_cidr_start_sql('c2'))} AS first_ip2, {_long2ip_sql(_cidr_end_sql('c2'))} AS last_ip2
FROM c""")
def q_sc_cidr_block(spark, sf_dir):
    f = _ip_forms(spark, sf_dir)
    c1 = F.concat_ws("/", "quad", F.col("mask").cast("string"))
    c2 = F.concat_ws("/", "two", F.col("mask").cast("string"))
    return f.select("event_id",
                    IP.long_to_ip(IP.cidr_start(c1)).alias("first_ip"), IP.long_to_ip(IP.cidr_end(c1)).alias("last_ip"),
                    IP.long_to_ip(IP.cidr_start(c2)).alias("first_ip2"), IP.long_to_ip(IP.cidr_end(c2)).alias("last_ip2"))


@register("sc_ip_range", _IP_SQL + f""",
r AS (SELECT event_id, quad, three, quad || '/' || mask::VARCHAR AS c1 FROM f),
v AS (SELECT event_id,
             {_ip2long_sql('quad')} AS a, {_ip2long_sql('three')} AS b,
             CASE WHEN {_valid_cidr_sql('c1')} THEN {_cidr_start_sql('c1')} ELSE {_ip2long_sql('c1')} END AS cs,
             CASE WHEN {_valid_cidr_sql('c1')} THEN {_cidr_end_sql('c1')} ELSE {_ip2long_sql('c1')} END AS ce
      FROM r)
SELECT event_id, least(a, b) AS pair_lo, greatest(a, b) AS pair_hi,
       CASE WHEN cs IS NOT NULL AND ce IS NOT NULL THEN least(cs, ce) END AS cidr_lo,
       CASE WHEN cs IS NOT NULL AND ce IS NOT NULL THEN greatest(cs, ce) END AS cidr_hi,
       a AS single_lo, a AS single_hi
FROM v""")
def q_sc_ip_range(spark, sf_dir):
    f = _ip_forms(spark, sf_dir)
    c1 = F.concat_ws("/", "quad", F.col("mask").cast("string"))
    plo, phi = IP.ip_range(F.col("quad"), F.col("three"))
    clo, chi = IP.ip_range(c1)
    slo, shi = IP.ip_range(F.col("quad"))
    return f.select("event_id", plo.alias("pair_lo"), phi.alias("pair_hi"), clo.alias("cidr_lo"),
                    chi.alias("cidr_hi"), slo.alias("single_lo"), shi.alias("single_hi"))


# ---------------------------------------------------------------- derived inputs in SQL

from pagesig.operators import aggregate as AG  # noqa: E402
from pagesig.operators import extract as X  # noqa: E402
from pagesig.operators import joins as J  # noqa: E402
from pagesig.operators import netspace as N  # noqa: E402
from pagesig.sources import readers as R  # noqa: E402

_IPK = _long2ip_sql("(k * 2654435761) % 4294967296")

_DNS_CTES = f"""
page_hosts AS (SELECT {host_sql('url')} AS domain, min(page_id) AS k FROM pages GROUP BY 1),
dns AS (
  SELECT domain AS name, 'A' AS rtype, {_IPK} AS value, 1 AS seq FROM page_hosts WHERE k % 4 = 0
  UNION ALL SELECT domain, 'A', 'cname-' || k::VARCHAR, 0 FROM page_hosts WHERE k % 8 = 4
  UNION ALL SELECT 'www.' || domain, 'A', {_IPK}, 1 FROM page_hosts WHERE k % 4 = 1
  UNION ALL SELECT domain, 'AAAA', '2001:db8::' || upper(to_hex(k)), 1 FROM page_hosts WHERE k % 4 = 2),
firsts AS (SELECT name, rtype, arg_min(value, seq) AS value FROM dns GROUP BY name, rtype),
resolved AS (
  SELECT d.domain,
         CASE WHEN a.value IS NULL AND w.value IS NOT NULL THEN 'www.' || d.domain ELSE d.domain END AS key,
         CASE WHEN a.value IS NOT NULL THEN CASE WHEN {_valid_sql('a.value')} THEN a.value ELSE '{DNS_NOT_IPV4}' END
              WHEN w.value IS NOT NULL THEN CASE WHEN {_valid_sql('w.value')} THEN w.value ELSE '{DNS_NOT_IPV4}' END
              WHEN v6.value IS NOT NULL THEN v6.value
              ELSE '{DNS_NO_RECORD}' END AS value
  FROM page_hosts d
  LEFT JOIN firsts a ON a.name = d.domain AND a.rtype = 'A'
  LEFT JOIN firsts w ON w.name = 'www.' || d.domain AND w.rtype = 'A'
  LEFT JOIN firsts v6 ON v6.name = d.domain AND v6.rtype = 'AAAA'),
reply_lines AS (
  SELECT concat_ws(' | ', (h.k % 17)::VARCHAR, d.value, cc) AS value, h.k * 2 + 1 AS line_no, h.k
  FROM (SELECT *, CASE WHEN (coalesce({_ip2long_sql('value')}, 0) >> 24) < 25
                       THEN 'NATION_' || (coalesce({_ip2long_sql('value')}, 0) >> 24)::VARCHAR ELSE '' END AS cc
        FROM dns WHERE rtype = 'A') d
  JOIN page_hosts h ON regexp_replace(d.name, '^www\\.', '') = h.domain
  UNION ALL
  SELECT concat_ws(' | ', '64512', d.value, cc), h.k * 2, h.k
  FROM (SELECT *, CASE WHEN (coalesce({_ip2long_sql('value')}, 0) >> 24) < 25
                       THEN 'NATION_' || (coalesce({_ip2long_sql('value')}, 0) >> 24)::VARCHAR ELSE '' END AS cc
        FROM dns WHERE rtype = 'A') d
  JOIN page_hosts h ON regexp_replace(d.name, '^www\\.', '') = h.domain WHERE h.k % 3 = 0
  UNION ALL SELECT 'Bulk mode; one IP per line', -1, NULL),
reply AS (
  SELECT ip, v.asn AS asn, v.cc AS cc FROM (
    SELECT trim(split_part(value, '|', 2)) AS ip,
           arg_max({{'asn': trim(split_part(value, '|', 1)), 'cc': trim(split_part(value, '|', 3))}}, line_no) AS v
    FROM reply_lines WHERE instr(value, '|') > 0 GROUP BY 1)),
ip_asn AS (
  SELECT r.key, r.value AS ip, p.asn, p.cc FROM resolved r JOIN reply p ON p.ip = r.value
  WHERE {_valid_sql('r.value')})"""


def _resolved(spark, sf_dir):
    hosts = corpora.page_hosts(spark, sf_dir)
    return N.jn_dns_fallback(hosts.select("domain"), corpora.dns_snapshot(spark, sf_dir))


def _ip_asn(spark, sf_dir):
    reply = R.src_ip_asn_reply(corpora.ip_asn_lines(spark, sf_dir))
    return N.jn_ip_asn(_resolved(spark, sf_dir), reply)


@register("jn_dns_fallback", "WITH " + _DNS_CTES + "\nSELECT domain, key, value FROM resolved")
def q_jn_dns_fallback(spark, sf_dir):
    return _resolved(spark, sf_dir)


@register("src_ip_asn_reply", "WITH " + _DNS_CTES + "\nSELECT ip, asn, cc FROM reply")
def q_src_ip_asn_reply(spark, sf_dir):
    return R.src_ip_asn_reply(corpora.ip_asn_lines(spark, sf_dir))


@register("jn_ip_asn", "WITH " + _DNS_CTES + "\nSELECT key, ip, asn, cc FROM ip_asn")
def q_jn_ip_asn(spark, sf_dir):
    return _ip_asn(spark, sf_dir).select("key", "ip", "asn", "cc")


@register("ag_domains_per_asn", "WITH " + _DNS_CTES + "\nSELECT DISTINCT asn, key AS domain FROM ip_asn")
def q_ag_domains_per_asn(spark, sf_dir):
    return AG.ag_domains_per_asn(_ip_asn(spark, sf_dir).select("asn", F.col("key").alias("domain")))


@register("ag_asn_workload", "WITH " + _DNS_CTES + """
SELECT asn, CAST(count(DISTINCT key) AS BIGINT) AS n_domains FROM ip_asn GROUP BY asn""")
def q_ag_asn_workload(spark, sf_dir):
    a = AG.ag_asn_workload(_ip_asn(spark, sf_dir).select("asn", F.col("key").alias("domain")))
    return a.select("asn", F.col("n_domains").cast("long"))


@register("src_asn_worklist", f"""
SELECT CAST(page_id % 17 AS VARCHAR) AS asn, {host_sql('url')} AS domain, 0 AS pos FROM pages""")
def q_src_asn_worklist(spark, sf_dir):
    return R.src_asn_worklist(corpora.worklist_docs(spark, sf_dir))


@register("src_domain_registry", f"""
SELECT {host_sql('url')} AS domain_name FROM pages WHERE {host_sql('url')} IS NOT NULL""")
def q_src_domain_registry(spark, sf_dir):
    return R.src_domain_registry(corpora.registry_docs(spark, sf_dir))


_RANGES_SQL = """
SELECT n_name AS cc, CAST(n_nationkey AS BIGINT) * 16777216 AS start_ip,
       CAST(n_nationkey AS BIGINT) * 16777216 + 16777215 AS end_ip FROM nation"""


@register("src_delegated_ranges", _RANGES_SQL)
def q_src_delegated_ranges(spark, sf_dir):
    return R.src_delegated_ranges(corpora.delegated_lines(spark, sf_dir))


@register("src_whois_origin", """
WITH t AS (
  SELECT event_id AS reply_id,
         '% RIS whois' || chr(10) || chr(10) ||
         ((event_id % 17 + 3295)::VARCHAR || chr(9) || ((event_id * 7) % 223 + 1)::VARCHAR || '.0.0.0/8' ||
          CASE WHEN event_id % 13 = 0 THEN chr(9) || 'extra' ELSE '' END) || chr(10) ||
         CASE WHEN event_id % 9 = 0 THEN '64500' || chr(9) || '10.0.0.0/8' || chr(10) ELSE '' END AS value
  FROM events),
l AS (SELECT reply_id, list_filter(string_split(value, chr(10)), lambda x: x <> '' AND NOT starts_with(x, '%')) AS lines
      FROM t),
f AS (SELECT reply_id, lines, string_split(lines[1], chr(9)) AS fields FROM l)
SELECT reply_id,
       CASE WHEN len(lines) = 1 AND len(fields) = 2 THEN CASE WHEN fields[1] = '3303' THEN '' ELSE fields[1] END END AS asn,
       CASE WHEN len(lines) <> 1 THEN 'lines' WHEN len(fields) <> 2 THEN 'fields' END AS reason
FROM f""")
def q_src_whois_origin(spark, sf_dir):
    return R.src_whois_origin(corpora.whois_replies(spark, sf_dir))


@register("src_feed_delta", """
WITH feed AS (
  SELECT epoch_us(TIMESTAMP '2100-01-01 00:00:00') - epoch_us(ts) AS ordinal, strftime(ts, '%H:%M') AS time,
         'user' || user_id::VARCHAR AS notifier, 'http://mirror.example/' || event_id::VARCHAR AS mirror
  FROM events),
cur AS (
  SELECT strftime(c.ts, '%H:%M') AS time, 'user' || c.user_id::VARCHAR AS notifier,
         'http://mirror.example/' || c.event_id::VARCHAR AS mirror
  FROM (SELECT arg_max({'ts': ts, 'user_id': user_id, 'event_id': event_id}, ts) AS c
        FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00')),
stop AS (SELECT min(ordinal) AS stop FROM feed SEMI JOIN cur USING (time, notifier, mirror))
SELECT f.ordinal, f.time, f.notifier, f.mirror FROM feed f, stop WHERE stop.stop IS NULL OR f.ordinal < stop.stop""")
def q_src_feed_delta(spark, sf_dir):
    feed, cur = corpora.event_feed(spark, sf_dir)
    return R.src_feed_delta(feed, cur)


_ID_RANGE_SQL = """
WITH m AS (SELECT max(o_orderkey) - count(*) // 10 AS id_start FROM orders),
e AS (SELECT max(o_orderkey) AS id_end FROM orders),
r AS (SELECT o_orderkey AS obs_id, o_custkey AS owner FROM orders, m, e WHERE o_orderkey > id_start AND o_orderkey <= id_end)"""


def _id_start(spark, sf_dir):
    """The mark a previous run saved: every id but the newest tenth had been processed."""
    o = corpora.table(spark, sf_dir, "orders")
    r = o.agg(F.max("o_orderkey").alias("m"), F.count(F.lit(1)).alias("n")).first()
    return r["m"] - r["n"] // 10


@register("src_id_range", _ID_RANGE_SQL + "\nSELECT obs_id, owner, (SELECT id_end FROM e) AS id_end FROM r")
def q_src_id_range(spark, sf_dir):
    obs = corpora.orders_observations(spark, sf_dir)
    rows, id_end = R.src_id_range(obs, _id_start(spark, sf_dir))
    return rows.select("obs_id", "owner", F.lit(id_end).cast("long").alias("id_end"))


@register("jn_active_owners", _ID_RANGE_SQL + "\nSELECT DISTINCT owner FROM r")
def q_jn_active_owners(spark, sf_dir):
    obs = corpora.orders_observations(spark, sf_dir)
    o = corpora.table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return J.jn_active_owners(obs, _id_start(spark, sf_dir), o)


# ---------------------------------------------------------------- IP range joins

_EV_IP_SQL = "SELECT event_id, (event_id * 2654435761) % 4294967296 AS ip FROM events"


@register("jn_ip_in_ranges", f"""
WITH e AS ({_EV_IP_SQL}), r AS ({_RANGES_SQL})
SELECT e.event_id, e.ip, r.cc FROM e JOIN r ON e.ip BETWEEN r.start_ip AND r.end_ip""")
def q_jn_ip_in_ranges(spark, sf_dir):
    ips = corpora.event_ips(spark, sf_dir).select("event_id", F.col("ip_long").alias("ip"))
    ranges = R.src_delegated_ranges(corpora.delegated_lines(spark, sf_dir))
    return N.jn_ip_in_ranges(ips, ranges, "ip").select("event_id", "ip", "cc")


def _countries(spark, sf_dir):
    nat = corpora.nation_ranges(spark, sf_dir).select("cc", (F.col("ordinal") + 10).alias("ordinal"),
                                                      "start_ip", "end_ip")
    reg = corpora.table(spark, sf_dir, "region").select(
        F.col("r_name").alias("cc"), F.col("r_regionkey").cast("long").alias("ordinal"),
        (F.col("r_regionkey").cast("long") * 5 * 16777216).alias("start_ip"),
        (F.col("r_regionkey").cast("long") * 5 * 16777216 + 5 * 16777216 - 1).alias("end_ip"))
    return nat.unionByName(reg)


_COUNTRIES_SQL = """
SELECT n_name AS cc, n_nationkey + 10 AS ordinal, CAST(n_nationkey AS BIGINT) * 16777216 AS start_ip,
       CAST(n_nationkey AS BIGINT) * 16777216 + 16777215 AS end_ip FROM nation
UNION ALL
SELECT r_name, r_regionkey, CAST(r_regionkey AS BIGINT) * 83886080, CAST(r_regionkey AS BIGINT) * 83886080 + 83886079
FROM region"""


@register("jn_first_country", f"""
WITH e AS ({_EV_IP_SQL}), c AS ({_COUNTRIES_SQL}),
h AS (SELECT e.event_id, arg_min(c.cc, c.ordinal) AS cc FROM e JOIN c ON e.ip BETWEEN c.start_ip AND c.end_ip
      GROUP BY e.event_id)
SELECT e.event_id, upper(h.cc) AS country FROM e LEFT JOIN h USING (event_id)""")
def q_jn_first_country(spark, sf_dir):
    ips = corpora.event_ips(spark, sf_dir).select("event_id", F.col("ip_long").alias("ip"))
    return N.jn_first_country(ips, _countries(spark, sf_dir), "event_id")


@register("jn_address_space", f"""
WITH {_DNS_CTES.strip()},
items AS (
  SELECT url AS item FROM pages
  UNION SELECT {_long2ip_sql('(event_id * 2654435761) % 4294967296')} FROM events),
cc AS (SELECT unnest(['NATION_7', 'org']) AS cc),
rng AS (SELECT n_name AS cc, CAST(n_nationkey AS BIGINT) * 16777216 AS start_ip,
               CAST(n_nationkey AS BIGINT) * 16777216 + 16777215 AS end_ip FROM nation),
ia AS (SELECT name, arg_min(value, seq) AS a FROM dns WHERE rtype = 'A' GROUP BY name),
x AS (
  SELECT i.item, cc.cc, {_valid_sql('i.item')} AS is_ip,
         CASE WHEN {_valid_sql('i.item')} THEN {_ip2long_sql('i.item')} ELSE {_ip2long_sql('ia.a')} END AS ip,
         {host_sql('i.item')} AS host
  FROM items i CROSS JOIN cc LEFT JOIN ia ON ia.name = {host_sql('i.item')})
SELECT item, cc,
       coalesce(EXISTS (SELECT 1 FROM rng r WHERE upper(r.cc) = upper(x.cc) AND x.ip BETWEEN r.start_ip AND r.end_ip), false)
       OR coalesce(NOT is_ip AND upper(CASE WHEN instr(host, '.') > 0 THEN split_part(host, '.', -1) END) = upper(cc), false)
         AS inside
FROM x""")
def q_jn_address_space(spark, sf_dir):
    items = corpora.table(spark, sf_dir, "pages").select(F.col("url").alias("item")).unionByName(
        corpora.event_ips(spark, sf_dir).select(IP.long_to_ip(F.col("ip_long")).alias("item")))
    ranges = corpora.nation_ranges(spark, sf_dir)
    dns = corpora.dns_snapshot(spark, sf_dir)
    return N.jn_address_space(items, ranges, dns, ["NATION_7", "org"])


@register("jn_first_country_of_items", f"""
WITH {_DNS_CTES.strip()},
items AS (
  SELECT url AS item FROM pages
  UNION SELECT {_long2ip_sql('(event_id * 2654435761) % 4294967296')} FROM events),
co AS (SELECT cc, ordinal, start_ip, end_ip FROM ({_COUNTRIES_SQL}) UNION ALL SELECT 'Org', 7, 1, 0),
ia AS (SELECT name, arg_min(value, seq) AS a FROM dns WHERE rtype = 'A' GROUP BY name),
x AS (
  SELECT i.item, {_valid_sql('i.item')} AS is_ip, {host_sql('i.item')} AS host,
         CASE WHEN {_valid_sql('i.item')} THEN {_ip2long_sql('i.item')} ELSE {_ip2long_sql('ia.a')} END AS ip
  FROM items i LEFT JOIN ia ON ia.name = {host_sql('i.item')}),
hits AS (
  SELECT x.item, co.cc, co.ordinal FROM x JOIN co ON x.ip BETWEEN co.start_ip AND co.end_ip
  UNION ALL
  SELECT x.item, co.cc, co.ordinal FROM x JOIN co
    ON NOT x.is_ip AND lower(co.cc) = lower(CASE WHEN instr(host, '.') > 0 THEN split_part(host, '.', -1) END)),
f AS (SELECT item, arg_min(cc, ordinal) AS cc FROM hits GROUP BY item)
SELECT x.item, upper(f.cc) AS country FROM x LEFT JOIN f USING (item)""")
def q_jn_first_country_of_items(spark, sf_dir):
    """First country of every page URL (by TLD or resolved address) and of every event address."""
    items = corpora.table(spark, sf_dir, "pages").select(F.col("url").alias("item")).unionByName(
        corpora.event_ips(spark, sf_dir).select(IP.long_to_ip(F.col("ip_long")).alias("item")))
    org = spark.createDataFrame([("Org", 7, 1, 0)], "cc string, ordinal int, start_ip long, end_ip long")
    countries = _countries(spark, sf_dir).select("cc", F.col("ordinal").cast("int").alias("ordinal"), "start_ip", "end_ip")
    return N.jn_first_country_of_items(items, countries.unionByName(org), corpora.dns_snapshot(spark, sf_dir))


@register("jn_blocklist", f"""
WITH bl AS (SELECT DISTINCT url FROM pages WHERE {host_sql('url')} LIKE '%spam%' OR {host_sql('url')} LIKE '%pills%')
SELECT page_id, url, url IN (SELECT url FROM bl) AS blocked FROM pages""")
def q_jn_blocklist(spark, sf_dir):
    pages = corpora.table(spark, sf_dir, "pages").select("page_id", "url")
    host = U.url_host(F.col("url"))
    bl = pages.where(host.contains("spam") | host.contains("pills")).select("url")
    return N.jn_blocklist(pages, bl).select("page_id", "url", "blocked")


@register("rg_expand", f"""
WITH e AS ({_EV_IP_SQL}),
r AS (SELECT event_id, (ip >> 2) << 2 AS start_ip, ((ip >> 2) << 2) + 3 AS end_ip FROM e)
SELECT event_id, v AS ip, {_long2ip_sql('v')} AS ip_text FROM (SELECT event_id, unnest(range(start_ip, end_ip + 1)) AS v FROM r)""")
def q_rg_expand(spark, sf_dir):
    e = corpora.event_ips(spark, sf_dir)
    start = F.shiftleft(F.shiftright(F.col("ip_long"), 2), 2)
    ranges = e.select("event_id", start.alias("start_ip"), (start + 3).alias("end_ip"))
    return N.rg_expand(ranges).select("event_id", "ip", "ip_text")
