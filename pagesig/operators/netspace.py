"""IP ranges, countries, DNS and ASN as joins over landed snapshots.

Range containment is an equi-join on dyadic blocks: each range is cut into at most 62 aligned
blocks of a power of two, however wide it is, and an address meets its own block of every size
that occurs among the ranges (at most 33). That replaces the nested-loop join a plain BETWEEN
condition plans as, needs no residual filter, and keeps the join keyed so that AQE can split hot
blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesig.functions import ipaddr as IP
from pagesig.functions import urls as U
from pagesig.params import DNS_NO_RECORD, DNS_NOT_IPV4

ADDRESS_BITS = 32


def _shift(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def dyadic_blocks(ranges: DataFrame) -> DataFrame:
    """Adds (level, block): the aligned blocks [block << level, (block + 1) << level) that make up
    start_ip .. end_ip. Going up the levels, what is left of a range loses the block at its left
    end if that one is odd, and the one at its right end if that one is even."""
    lo, end = F.col("start_ip").cast("long"), F.col("end_ip").cast("long") + 1

    def at(k):
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        a, b = _shift(lo + size - 1, k), _shift(end, k)  # blocks a .. b - 1 lie in the range
        left = F.when((a < b) & (a % 2 == 1), F.struct(k.alias("level"), a.alias("block")))
        right = F.when((a + a % 2 < b) & (b % 2 == 1), F.struct(k.alias("level"), (b - 1).alias("block")))
        return F.array(left, right)

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(ADDRESS_BITS)), at))
    own = ranges.where(F.col("start_ip") <= F.col("end_ip")).withColumn("_b", F.explode(F.filter(every, lambda x: x.isNotNull())))
    return own.select(*ranges.columns, F.col("_b.level").alias("level"), F.col("_b.block").alias("block"))


def jn_ip_in_ranges(ips: DataFrame, ranges: DataFrame, ip_col: str = "ip", how: str = "inner") -> DataFrame:
    """Rows of `ips` joined to every range (start_ip <= ip <= end_ip) containing them.

    how='left_semi' gives "in any range"."""
    blocks = dyadic_blocks(ranges)
    levels = sorted(r["level"] for r in blocks.select("level").distinct().collect())  # at most 33 rows
    asked = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(F.col(ip_col).cast("long"), k).alias("block")) for k in levels]) \
        if levels else F.array().cast("array<struct<level:int,block:bigint>>")
    if how == "left_semi":
        asked_ips = ips.select(ip_col).distinct().withColumn("_b", F.explode(asked)).select(ip_col, "_b.*")
        hit = asked_ips.join(blocks.select("level", "block").distinct(), ["level", "block"]).select(ip_col).distinct()
        return ips.join(hit, ip_col, "left_semi")
    spread = ips.withColumn("_b", F.explode(asked)).select(*ips.columns, "_b.*")
    return spread.join(blocks, ["level", "block"]).drop("level", "block")


def jn_first_country(ips: DataFrame, countries: DataFrame, key: str, ip_col: str = "ip") -> DataFrame:
    """First country (lowest ordinal) whose ranges contain the item; upper-cased; null if none.

    countries: (cc, ordinal, start_ip, end_ip)."""
    hits = jn_ip_in_ranges(ips.select(key, ip_col), countries, ip_col)
    first = hits.groupBy(key).agg(F.min_by("cc", "ordinal").alias("cc"))
    return ips.select(key).distinct().join(first, key, "left") \
        .select(key, F.upper("cc").alias("country"))


def jn_first_country_of_items(items: DataFrame, countries: DataFrame, dns: DataFrame,
                              item_col: str = "item") -> DataFrame:
    """First country (lowest ordinal) that holds the item, an IP text or a URL; upper-cased, null
    if none. An IP belongs by the country's ranges; a URL by its TLD (the country's code, in any
    case) or by the ranges that hold the first A record of its host.

    countries: (cc, ordinal, start_ip, end_ip)."""
    base = items.select(item_col).distinct().withColumn("is_ip", IP.valid_ip(F.col(item_col)))
    a = dns.where(F.col("rtype") == "A").groupBy("name").agg(F.min_by("value", "seq").alias("a"))
    named = base.withColumn("host", U.url_host(F.col(item_col))).join(a, F.col("host") == a["name"], "left")
    ip = F.when(F.col("is_ip"), IP.ip_to_long(F.col(item_col))).otherwise(IP.ip_to_long(F.col("a")))
    by_range = jn_ip_in_ranges(named.select(item_col, ip.alias("ip")).where(F.col("ip").isNotNull()), countries, "ip")
    tld = named.where(~F.col("is_ip")).select(item_col, F.lower(U.url_tld(F.col(item_col))).alias("tld"))
    codes = countries.select("cc", "ordinal").distinct()
    by_tld = tld.join(codes, F.col("tld") == F.lower("cc"))
    hits = by_range.select(item_col, "cc", "ordinal").unionByName(by_tld.select(item_col, "cc", "ordinal"))
    first = hits.groupBy(item_col).agg(F.min_by("cc", "ordinal").alias("cc"))
    return base.join(first, item_col, "left").select(item_col, F.upper("cc").alias("country"))


def jn_dns_fallback(domains: DataFrame, dns: DataFrame) -> DataFrame:
    """domain -> (key, value): A(domain), else A(www.domain) [key becomes www.domain], else
    AAAA(domain), else 'No IPv4 nor IPv6 record'. A non-IPv4 A answer gives 'Not valid IPv4'.

    dns: (name, rtype, value, seq); the first answer is the one with the lowest seq."""
    first = dns.groupBy("name", "rtype").agg(F.min_by("value", "seq").alias("value"))
    a = first.where(F.col("rtype") == "A").select(F.col("name").alias("d_a"), F.col("value").alias("a"))
    aaaa = first.where(F.col("rtype") == "AAAA").select(F.col("name").alias("d_6"), F.col("value").alias("aaaa"))
    www = a.select(F.col("d_a").alias("d_w"), F.col("a").alias("w"))
    d = domains.select("domain").distinct()
    j = (d.join(a, d["domain"] == a["d_a"], "left")
         .join(www, F.concat(F.lit("www."), d["domain"]) == www["d_w"], "left")
         .join(aaaa, d["domain"] == aaaa["d_6"], "left"))
    checked = lambda v: F.when(IP.valid_ip(v), v).otherwise(F.lit(DNS_NOT_IPV4))
    key = F.when(F.col("a").isNull() & F.col("w").isNotNull(), F.concat(F.lit("www."), F.col("domain"))) \
        .otherwise(F.col("domain"))
    value = (F.when(F.col("a").isNotNull(), checked(F.col("a")))
             .when(F.col("w").isNotNull(), checked(F.col("w")))
             .when(F.col("aaaa").isNotNull(), F.col("aaaa"))
             .otherwise(F.lit(DNS_NO_RECORD)))
    return j.select("domain", key.alias("key"), value.alias("value"))


def jn_ip_asn(resolved: DataFrame, ip_asn: DataFrame) -> DataFrame:
    """(key, ip) of resolved domains with a valid IPv4 -> (domain key, ip, asn, cc)."""
    ok = resolved.where(IP.valid_ip(F.col("value"))).select("key", F.col("value").alias("ip"))
    return ok.join(ip_asn.select("ip", "asn", "cc"), "ip")


def jn_address_spaces(items: DataFrame, countries: DataFrame, dns: DataFrame, item_col: str = "item") -> DataFrame:
    """(item, country) of every country, upper-cased, that an item (IP text or URL) belongs to, for all
    countries in one plan: a valid IP must fall in the country's ranges; a URL's TLD is the country's
    code, in any case, or its resolved A address falls in the ranges."""
    base = items.select(item_col).distinct().withColumn("is_ip", IP.valid_ip(F.col(item_col)))
    a = dns.where(F.col("rtype") == "A").groupBy("name").agg(F.min_by("value", "seq").alias("a"))
    with_ip = base.withColumn("host", U.url_host(F.col(item_col))).join(a, F.col("host") == a["name"], "left") \
        .withColumn("ip", F.when(F.col("is_ip"), IP.ip_to_long(F.col(item_col))).otherwise(IP.ip_to_long(F.col("a"))))
    ranges = countries.select(F.upper("cc").alias("country"), "start_ip", "end_ip")
    by_range = jn_ip_in_ranges(with_ip.where(F.col("ip").isNotNull()).select(item_col, "ip"), ranges, "ip")
    by_tld = base.where(~F.col("is_ip")).select(item_col, F.upper(U.url_tld(F.col(item_col))).alias("country"))
    return by_range.select(item_col, "country").unionByName(by_tld.where(F.col("country").isNotNull())).distinct()


def jn_address_space(items: DataFrame, countries: DataFrame, dns: DataFrame, cc: str | list[str],
                     item_col: str = "item") -> DataFrame:
    """(item, cc, inside) for the named countries, all in one plan."""
    wanted = F.explode(F.array(*[F.lit(c) for c in ([cc] if isinstance(cc, str) else cc)]))
    asked = items.select(item_col).distinct().withColumn("cc", wanted)
    held = jn_address_spaces(items, countries, dns, item_col).withColumnRenamed(item_col, "_item")
    out = asked.join(held, (asked[item_col] == held["_item"]) & (F.upper("cc") == held["country"]), "left")
    return out.select(item_col, "cc", F.col("_item").isNotNull().alias("inside"))


def jn_blocklist(urls: DataFrame, blocklist: DataFrame, url_col: str = "url") -> DataFrame:
    bl = blocklist.select(F.col("url").alias("_bl")).distinct()
    return urls.join(bl, urls[url_col] == bl["_bl"], "left") \
        .withColumn("blocked", F.col("_bl").isNotNull()).drop("_bl")


def rg_expand(ranges: DataFrame, block: int = 1 << 12) -> DataFrame:
    """Every address of every range, as text. A range is first split into blocks, which are dealt
    over the tasks and expanded there: no row is wider than a block, whatever the range."""
    starts = F.sequence(F.col("start_ip"), F.col("end_ip"), F.lit(block).cast("long"))
    blocks = ranges.where(F.col("start_ip") <= F.col("end_ip")).withColumn("_from", F.explode(starts)).repartition("_from")
    ips = F.sequence(F.col("_from"), F.least(F.col("_from") + F.lit(block - 1), F.col("end_ip")))
    return blocks.withColumn("ip", F.explode(ips)).drop("_from").withColumn("ip_text", IP.long_to_ip(F.col("ip")))
