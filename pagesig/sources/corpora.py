"""Adapters from the test tables to the pipeline's shapes (observations and occurrences).

Each corpus yields
  observations (owner, obs_id, time, url, host)
  occurrences  (obs_id, type, element)   -- one row per occurrence (a multiset)
All are plain projections / joins so Catalyst prunes columns and pushes filters to the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesig.functions import urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- orders (induction corpus)

def orders_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    hostkey = F.col("o_orderkey") % 13
    url = F.concat(F.lit("http://u@H"), hostkey.cast("string"), F.lit(".Example.com:8080/p?q"))
    return o.select(
        F.col("o_custkey").alias("owner"),
        F.col("o_orderkey").alias("obs_id"),
        F.col("o_orderdate").alias("time"),
        url.alias("url"),
    ).withColumn("host", urls.url_host(F.col("url")))


def orders_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, element_id): one row per lineitem (an occurrence of its part's element)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("obs_id"), F.col("l_partkey").alias("element_id"))


def orders_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(element_id, type, element): the element dictionary, one row per part (its brand)."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("element_id"), F.lit("Ltexts").alias("type"),
                       F.col("p_brand").alias("element"))


def orders_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One occurrence per lineitem row: the brand of its part (bridge joined to elements)."""
    return orders_bridge(spark, sf_dir).join(orders_elements(spark, sf_dir), "element_id").drop("element_id")


def shown_element(brand) -> tuple:
    """(type, element text) of the element that a page shows for a brand, for scans: a label and its
    digest (labels alone are all alike); even brands as alerts, the others as texts, every fifth one
    long, so that it is compared by its fuzzy hash."""
    number = F.substring_index(brand, "#", -1).cast("int")
    label = F.concat(brand, F.lit(" "), F.sha2(brand, 256))
    digests = F.concat(*[F.sha2(F.concat(brand, F.lit(f":{i}")), 256) for i in range(18)])
    kind = F.when(number % 5 == 0, "Htexts").when(number % 2 == 0, "Lalerts").otherwise("Ltexts")
    return kind, F.when(number % 5 == 0, F.concat(label, digests)).otherwise(label)


def orders_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, type, element): every order as a fetched page, one element per lineitem."""
    kind, text = shown_element(F.col("element"))
    shown = orders_elements(spark, sf_dir).select("element_id", kind.alias("type"), F.encode(text, "UTF-8").alias("element"))
    return orders_bridge(spark, sf_dir).withColumnRenamed("obs_id", "page_id").join(shown, "element_id").drop("element_id")


# ---------------------------------------------------------------- events (second corpus)

def _event_day(ts):
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))


def events_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    obs = e.select(
        F.col("user_id").alias("owner"),
        _event_day(F.col("ts")).cast("long").alias("obs_id"),
        F.to_date("ts").alias("day"),
    ).distinct()
    hostkey = F.dayofmonth("day") % 11
    url = F.concat(F.lit("http://u@D"), hostkey.cast("string"), F.lit(".Example.com:8080/p?q"))
    return obs.select(
        "owner", "obs_id", F.col("day").cast("timestamp_ntz").alias("time"), url.alias("url"),
    ).withColumn("host", urls.url_host(F.col("url")))


def events_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation = (user, day); one occurrence per event: type and value bucket."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("owner"),
        _event_day(F.col("ts")).cast("long").alias("obs_id"),
        F.lit("Ltexts").alias("type"),
        F.concat(F.col("event_type"), F.lit("/"),
                 F.floor(F.col("value") / 20).cast("long").cast("string")).alias("element"),
    )


# ---------------------------------------------------------------- pages

def pages_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    host = urls.url_host(F.col("url"))
    return p.select(
        urls.url_tld(F.col("url")).alias("owner"),
        F.col("page_id").alias("obs_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(page_id AS INT), 0, 0)")
        .alias("time"),
        F.col("url"),
        host.alias("host"),
    )


# ---------------------------------------------------------------- ip / asn

def event_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    return e.select("event_id", ((F.col("event_id") * F.lit(2654435761)) % F.lit(4294967296)).alias("ip_long"))


def nation_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    start = F.col("n_nationkey").cast("long") * F.lit(16777216)
    return n.select(
        F.col("n_name").alias("cc"),
        F.col("n_nationkey").cast("long").alias("ordinal"),
        start.alias("start_ip"),
        (start + F.lit(16777215)).alias("end_ip"),
    )


def page_asns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", urls.url_host(F.col("url")).alias("domain"),
                    (F.col("page_id") % 17).alias("asn"))


# ---------------------------------------------------------------- derived landed inputs
# Snapshots the original obtained from live services (DNS, whois, registries), derived here
# deterministically from the test tables so that they grow with them.

def _ip_text(v):
    from pagesig.functions.ipaddr import long_to_ip
    return long_to_ip(v)


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, k): every host of the pages table with its smallest page id."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select(urls.url_host(F.col("url")).alias("domain"), "page_id") \
        .groupBy("domain").agg(F.min("page_id").alias("k"))


def dns_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, rtype, value, seq): A for k%4=0, A of www.host for k%4=1, AAAA for k%4=2,
    nothing for k%4=3; a non-IPv4 A answer first for k%8=4."""
    h = page_hosts(spark, sf_dir)
    ip = _ip_text((F.col("k") * F.lit(2654435761)) % F.lit(4294967296))
    kind = F.col("k") % 4
    a = h.where(kind == 0).select(F.col("domain").alias("name"), F.lit("A").alias("rtype"), ip.alias("value"),
                                  F.lit(1).alias("seq"))
    bad = h.where(F.col("k") % 8 == 4).select(F.col("domain").alias("name"), F.lit("A").alias("rtype"),
                                              F.concat(F.lit("cname-"), F.col("k").cast("string")).alias("value"),
                                              F.lit(0).alias("seq"))
    www = h.where(kind == 1).select(F.concat(F.lit("www."), F.col("domain")).alias("name"), F.lit("A").alias("rtype"),
                                    ip.alias("value"), F.lit(1).alias("seq"))
    v6 = h.where(kind == 2).select(F.col("domain").alias("name"), F.lit("AAAA").alias("rtype"),
                                   F.concat(F.lit("2001:db8::"), F.hex(F.col("k"))).alias("value"),
                                   F.lit(1).alias("seq"))
    return a.unionByName(bad).unionByName(www).unionByName(v6)


def ip_asn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'asn | ip | cc' reply lines for every A answer of the DNS snapshot (value, line_no);
    a header line without '|' and, for every third host, an earlier superseded line."""
    from pagesig.functions.ipaddr import ip_to_long
    d = dns_snapshot(spark, sf_dir).where(F.col("rtype") == "A")
    h = page_hosts(spark, sf_dir)
    d = d.join(h.select(F.col("domain").alias("name0"), "k"),
               F.regexp_replace("name", "^www\\.", "") == F.col("name0")).drop("name0")
    n = F.shiftright(F.coalesce(ip_to_long(F.col("value")), F.lit(0).cast("long")), 24)
    cc = F.when(n < 25, F.concat(F.lit("NATION_"), n.cast("string"))).otherwise(F.lit(""))
    line = F.concat_ws(" | ", (F.col("k") % 17).cast("string"), F.col("value"), cc)
    old = F.concat_ws(" | ", F.lit("64512"), F.col("value"), cc)
    cur = d.select(line.alias("value"), (F.col("k") * 2 + 1).alias("line_no"))
    prev = d.where(F.col("k") % 3 == 0).select(old.alias("value"), (F.col("k") * 2).alias("line_no"))
    header = h.groupBy().agg(F.min("k").alias("k")).select(
        F.lit("Bulk mode; one IP per line").alias("value"), F.lit(-1).cast("long").alias("line_no"))
    return cur.unionByName(prev).unionByName(header)


def delegated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RIR delegated-statistics lines for the nations: one ipv4 block (2^24 addresses at
    nationkey * 2^24) and one ipv6 block each, plus comment and summary lines."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    start = _ip_text(F.col("n_nationkey").cast("long") * F.lit(16777216))
    v4 = n.select(F.concat_ws("|", F.lit("ripencc"), "n_name", F.lit("ipv4"), start, F.lit("16777216"),
                              F.lit("20240101"), F.lit("allocated")).alias("value"))
    v6 = n.select(F.concat_ws("|", F.lit("ripencc"), "n_name", F.lit("ipv6"), F.lit("2001:db8::"), F.lit("32"),
                              F.lit("20240101"), F.lit("allocated")).alias("value"))
    extra = n.groupBy().agg(F.count(F.lit(1)).alias("c")).select(
        F.explode(F.array(F.lit("# delegated statistics"),
                          F.concat_ws("|", F.lit("ripencc"), F.lit("*"), F.lit("ipv4"), F.lit("*"),
                                      F.col("c").cast("string"), F.lit("summary")))).alias("value"))
    return v4.unionByName(v6).unionByName(extra)


def whois_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reply_id, value): one reply text per event; some carry two data lines or three fields."""
    e = table(spark, sf_dir, "events").select("event_id")
    asn = (F.col("event_id") % 17 + 3295).cast("string")
    pfx = F.concat(((F.col("event_id") * 7) % 223 + 1).cast("string"), F.lit(".0.0.0/8"))
    data = F.concat(asn, F.lit("\t"), pfx)
    data = F.when(F.col("event_id") % 13 == 0, F.concat(data, F.lit("\textra"))).otherwise(data)
    body = F.concat(F.lit("% RIS whois\n\n"), data, F.lit("\n"))
    body = F.when(F.col("event_id") % 9 == 0, F.concat(body, F.lit("64500\t10.0.0.0/8\n"))).otherwise(body)
    return e.select(F.col("event_id").alias("reply_id"), body.alias("value"))


def event_feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(feed, cursor): events as a newest-first listing (ordinal ascending = newest first) and
    the cursor = the newest row listed before 2024-01-20 (the last one a previous run saw)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    feed = e.select(
        F.expr("timestampdiff(MICROSECOND, ts, TIMESTAMP_NTZ'2100-01-01 00:00:00')").alias("ordinal"),
        F.date_format("ts", "HH:mm").alias("time"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("notifier"),
        F.concat(F.lit("http://mirror.example/"), F.col("event_id").cast("string")).alias("mirror"))
    old = e.where(F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    cur = old.agg(F.max_by(F.struct("ts", "user_id", "event_id"), "ts").alias("c")).select(
        F.date_format("c.ts", "HH:mm").alias("time"),
        F.concat(F.lit("user"), F.col("c.user_id").cast("string")).alias("notifier"),
        F.concat(F.lit("http://mirror.example/"), F.col("c.event_id").cast("string")).alias("mirror"))
    return feed, cur


def worklist_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines {asn: [domain]} per page (the worklist format, one object per line)."""
    a = page_asns(spark, sf_dir)
    return a.select(F.to_json(F.create_map(F.col("asn").cast("string"), F.array("domain"))).alias("value"))


def registry_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays [{"domain_name": host}] per page (the registry format)."""
    p = table(spark, sf_dir, "pages").select("url")
    return p.select(F.to_json(F.array(F.struct(urls.url_host(F.col("url")).alias("domain_name")))).alias("value"))


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table with every element kind present, derived by rewriting each page: an
    image after each navigation link (root-relative), an inline background on the ad block,
    an alert() in the page script, an embed (relative, with query) and an iframe in the footer."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    h = F.col("html")
    h = F.regexp_replace(h, r'<a href="(/[^"]*)">', '<a href="$1"><img src="/img$1.png">')
    h = F.regexp_replace(h, r'<div class="ad">',
                         "<div class=\"ad\" style=\"background-image: url('http://cdn.example.net/bg/ad.png')\">")
    h = F.regexp_replace(h, r'track\(([0-9]+)\);', 'alert("pwned $1");track($1);')
    h = F.regexp_replace(h, r'<footer>',
                         '<footer><embed src="/m/player.swf?v=1"><iframe src="https://video.example.org/e/1"></iframe>')
    return p.select("page_id", "url", h.alias("html"))


def document_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id = doc_id, pos, kind, element): every line of every whole document text with at
    least 3 characters, as a text element (documents repeat lines across and within texts)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = d.select(F.col("doc_id").alias("page_id"),
                     F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line"))
    return lines.where(F.char_length("line") >= 3).select(
        "page_id", "pos", F.lit("texts").alias("kind"), F.encode("line", "UTF-8").alias("element"))
