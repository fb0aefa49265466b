"""Hand-pinned cases for the DNS / country / ASN / blocklist joins."""

import random

from pyspark.sql import functions as F

from pagesig.operators import netspace as N
from pagesig.params import DNS_NO_RECORD, DNS_NOT_IPV4


def test_dns_fallback_order(spark):
    dns = spark.createDataFrame([
        ("a.hr", "A", "1.2.3.4", 1), ("a.hr", "A", "9.9.9.9", 2),      # first answer wins
        ("b.hr", "A", "cname-x", 0), ("b.hr", "A", "5.6.7.8", 1),      # first answer is not IPv4
        ("www.c.hr", "A", "2.2.2.2", 1),                               # only the www name answers
        ("d.hr", "AAAA", "2001:db8::1", 1),                            # only IPv6
        ("a.hr", "AAAA", "2001:db8::2", 1),
    ], "name string, rtype string, value string, seq int")
    domains = spark.createDataFrame([("a.hr",), ("b.hr",), ("c.hr",), ("d.hr",), ("e.hr",)], "domain string")
    out = {r.domain: (r.key, r.value) for r in N.jn_dns_fallback(domains, dns).collect()}
    assert out == {"a.hr": ("a.hr", "1.2.3.4"), "b.hr": ("b.hr", DNS_NOT_IPV4),
                   "c.hr": ("www.c.hr", "2.2.2.2"), "d.hr": ("d.hr", "2001:db8::1"),
                   "e.hr": ("e.hr", DNS_NO_RECORD)}
    reply = spark.createDataFrame([("1.2.3.4", "64500", "HR"), ("2.2.2.2", "64501", "SI")], "ip string, asn string, cc string")
    asn = {r.key: r.asn for r in N.jn_ip_asn(N.jn_dns_fallback(domains, dns), reply).collect()}
    assert asn == {"a.hr": "64500", "www.c.hr": "64501"}


def test_first_country_uses_the_given_order(spark):
    countries = spark.createDataFrame([("hr", 2, 0, 1000), ("si", 1, 500, 1500), ("de", 3, 0, 5000)],
                                      "cc string, ordinal long, start_ip long, end_ip long")
    ips = spark.createDataFrame([(1, 100), (2, 700), (3, 4000), (4, 9000)], "k long, ip long")
    out = {r.k: r.country for r in N.jn_first_country(ips, countries, "k").collect()}
    assert out == {1: "HR", 2: "SI", 3: "DE", 4: None}


def test_address_space_rules(spark):
    countries = spark.createDataFrame([("HR", 0, 16909056, 16909311)], "cc string, ordinal long, start_ip long, end_ip long")
    dns = spark.createDataFrame([("x.example.com", "A", "1.2.3.9", 1)], "name string, rtype string, value string, seq int")
    items = spark.createDataFrame([("1.2.3.4",), ("1.2.4.4",), ("http://www.foo.HR/",), ("http://x.example.com/p",),
                                   ("http://y.example.com/",)], "item string")
    out = {r.item: r.inside for r in N.jn_address_space(items, countries, dns, "hr").collect()}
    assert out == {"1.2.3.4": True, "1.2.4.4": False, "http://www.foo.HR/": True,
                   "http://x.example.com/p": True, "http://y.example.com/": False}


def test_blocklist_and_expand(spark):
    urls = spark.createDataFrame([(1, "http://a/"), (2, "http://b/")], "id long, url string")
    bl = spark.createDataFrame([("http://b/",), ("http://b/",)], "url string")
    assert {r.id: r.blocked for r in N.jn_blocklist(urls, bl).collect()} == {1: False, 2: True}
    ranges = spark.createDataFrame([(16909060, 16909062)], "start_ip long, end_ip long")
    assert [r.ip_text for r in N.rg_expand(ranges).orderBy("ip").collect()] == ["1.2.3.4", "1.2.3.5", "1.2.3.6"]
    big = spark.createDataFrame([(10, 9), (0, 3 << 19)], "start_ip long, end_ip long")
    assert N.rg_expand(big).select("ip").distinct().count() == (3 << 19) + 1
    assert F is not None


def test_dyadic_blocks_are_few_and_exact(spark):
    rng = random.Random(5)
    top = 2 ** 32 - 1
    cuts = [(0, top), (0, 0), (top, top), (1, top - 1), (0, top - 1), (5, 5), (7, 8), (0, 255), (1, 256), (9, 3)]
    cuts += [tuple(sorted((rng.randrange(2 ** 32), rng.randrange(2 ** 32)))) for _ in range(60)]
    cuts += [(a, a + rng.randrange(1000)) for a in (rng.randrange(2 ** 31) for _ in range(60))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cuts)], "k long, start_ip long, end_ip long")
    got = {}
    for r in N.dyadic_blocks(df).collect():
        got.setdefault(r.k, []).append((r.block << r.level, (r.block + 1) << r.level))
    assert len(got[0]) == 1 and max(map(len, got.values())) <= 62 and 9 not in got
    for k, (a, b) in enumerate(cuts):
        edge = a
        for lo, hi in sorted(got.get(k, [])):
            assert lo == edge
            edge = hi
        assert edge == b + 1 or a > b


def test_ip_in_ranges_of_any_width(spark):
    rng = random.Random(6)
    ranges = [("all", 0, 2 ** 32 - 1), ("one", 77, 77), ("odd", 3, 1_000_001), ("none", 9, 2)] + [
        (f"r{i}", a, a + rng.randrange(2 ** rng.randrange(1, 30))) for i, a in enumerate(rng.randrange(2 ** 31) for _ in range(30))]
    ips = [(i, rng.choice([77, 3, 1_000_001, 1_000_002, rng.randrange(2 ** 32), ranges[5][1], ranges[5][2]])) for i in range(200)]
    r = spark.createDataFrame(ranges, "cc string, start_ip long, end_ip long")
    p = spark.createDataFrame(ips, "k long, ip long")
    got = sorted((x.k, x.cc) for x in N.jn_ip_in_ranges(p, r).collect())
    assert got == sorted((k, cc) for k, ip in ips for cc, a, b in ranges if a <= ip <= b)
    some = r.where("cc <> 'all'")
    semi = sorted(x.k for x in N.jn_ip_in_ranges(p, some, how="left_semi").collect())
    assert semi == sorted(k for k, ip in ips if any(a <= ip <= b for cc, a, b in ranges if cc != "all"))
    assert N.jn_ip_in_ranges(p, r.limit(0)).count() == 0
