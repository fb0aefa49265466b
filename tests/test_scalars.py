"""Pinned scalar cases (FIXTURES.md section 3) and properties of the column functions."""

import random

import pytest
from pyspark.sql import functions as F

from pagesig.functions import ipaddr as IP
from pagesig.functions import multiset as MS
from pagesig.functions import urls as U
from pagesig.functions.similarity import fuzzy_hash_py, lcs_length, lcs_ratio_py
from pagesig.operators import extract as X
from pagesig.operators import match as M
from pagesig.sources import readers as R


def _one(spark, expr, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"x {typ}")
    return df.select(expr(F.col("x")).alias("r")).first()["r"]


def test_lcs_ratio_pins():
    assert lcs_ratio_py(b"abcbdab", b"bdcaba") == pytest.approx(2 * 4 / 13)
    assert lcs_ratio_py(b"aggtab", b"gxtxayb") == pytest.approx(2 * 4 / 13)
    assert lcs_ratio_py(b"xyz", b"xyz") == 1.0


def _dp(a, b):
    c = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            c[i][j] = c[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(c[i][j - 1], c[i - 1][j])
    return c[-1][-1]


def test_lcs_properties():
    rng = random.Random(3)
    for _ in range(300):
        a = bytes(rng.choice(b"abcde\xc3\xa9") for _ in range(rng.randint(1, 70)))
        b = bytes(rng.choice(b"abcde\xc3\xa9") for _ in range(rng.randint(1, 70)))
        assert lcs_length(a, b) == _dp(a, b)
        r = lcs_ratio_py(a, b)
        assert 0.0 <= r <= 1.0
        assert r == lcs_ratio_py(b, a)
        assert (r == 1.0) == (a == b)


def test_lcs_udf_matches_python(spark):
    rows = [(b"abcbdab", b"bdcaba"), (b"xyz", b"xyz"), ("é€".encode(), "€é".encode())]
    df = spark.createDataFrame(rows, "a binary, b binary")
    from pagesig.functions.similarity import lcs_ratio
    got = [r.r for r in df.select(lcs_ratio("a", "b").alias("r")).collect()]
    assert got == [pytest.approx(lcs_ratio_py(a, b)) for a, b in rows]


def _cells(matrix):
    return sorted((r, -v, c) for r, row in enumerate(matrix) for c, v in enumerate(row))


def test_greedy_pins(spark):
    import random

    from bruteforce import simindex
    rng = random.Random(2)
    matrices = [[[0.9, 0.8], [0.95, 0.1]], [[0.6], [0.9]], [[0.0, 0.0], [0.5, 0.0], [0.2, 0.3]]]
    matrices += [[[rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(w)] for _ in range(h)] for w in (1, 2, 4) for h in (1, 3, 5)]
    df = spark.createDataFrame([(i, _cells(m), len(m)) for i, m in enumerate(matrices)],
                               "i int, cells array<struct<row:int,less:double,col:int>>, n int")
    got = {r.i: r.g for r in df.select("i", M.mt_greedy_expr(F.col("cells"), F.col("n")).alias("g")).collect()}
    assert got[0] == pytest.approx(0.5) and got[1] == pytest.approx(0.3)
    for i, m in enumerate(matrices):
        table = {(r, c): v for r, row in enumerate(m) for c, v in enumerate(row)}
        assert got[i] == pytest.approx(simindex(list(range(len(m))), list(range(len(m[0]))), lambda s, w: table[s, w])), m


def test_type_mean_absent_type_counts_zero(spark):
    typed = spark.createDataFrame([(1, 9, "Ltexts", 1.0)], "content long, sig_class long, type string, tscore double")
    rows = spark.createDataFrame([(9, "Ltexts"), (9, "Limages")], "sig_class long, type string")
    assert M.mt_type_mean(typed, rows).first().score == pytest.approx(0.5)


def test_size_class(spark):
    df = spark.createDataFrame([(b"a" * 1000,), (b"a" * 1001,), ("é€".encode(),)], "element binary")
    out = [(r.n, r.c) for r in df.select(F.octet_length("element").alias("n"),
                                         X.size_class(F.col("element")).alias("c")).collect()]
    assert out == [(1000, "L"), (1001, "H"), (5, "L")]


@pytest.mark.parametrize("ip,expected", [("1.2.3.4", 16909060), ("127.1", 2130706433), ("10", 167772160),
                                         ("256.1.1.1", None), ("1.2.3.x", None), ("", None)])
def test_ip_to_long(spark, ip, expected):
    assert _one(spark, IP.ip_to_long, ip) == expected


@pytest.mark.parametrize("cidr,first,last", [("192.168.1.1/24", "192.168.1.0", "192.168.1.255"),
                                             ("127.1/16", "127.1.0.0", "127.1.255.255"),
                                             ("1.2.3.4/33", None, None), ("0.0.0.0/0", "0.0.0.0", "255.255.255.255")])
def test_cidr_block(spark, cidr, first, last):
    assert _one(spark, lambda c: IP.long_to_ip(IP.cidr_start(c)), cidr) == first
    assert _one(spark, lambda c: IP.long_to_ip(IP.cidr_end(c)), cidr) == last


def test_long_to_ip_roundtrip(spark):
    rng = random.Random(5)
    vals = [rng.randrange(0, 2 ** 32) for _ in range(200)] + [0, 2 ** 32 - 1]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    back = df.select("v", IP.ip_to_long(IP.long_to_ip(F.col("v"))).alias("w")).collect()
    assert all(r.v == r.w for r in back)
    assert _one(spark, IP.long_to_ip, 2 ** 32, "long") is None
    assert _one(spark, IP.long_to_ip, -1, "long") is None


@pytest.mark.parametrize("url,host", [("http://User@WWW.Exa_mple.com:80/x?a", "www.exa_mple.com"),
                                      ("foo.example.hr/p", "foo.example.hr"), ("", None),
                                      ("https://a.b.example.org#frag", "a.b.example.org"),
                                      ("//cdn.example.net/x", "cdn.example.net")])
def test_url_host(spark, url, host):
    assert _one(spark, U.url_host, url) == host


def test_url_tld_and_labels(spark):
    assert _one(spark, U.url_tld, "http://a.b.example.hr/x") == "hr"
    assert _one(spark, U.url_tld, "http://localhost/x") is None
    assert _one(spark, U.last_two_labels, "http://a.b.example.hr/x") == "example.hr"
    assert _one(spark, U.ensure_scheme, "example.hr") == "http://example.hr"
    assert _one(spark, U.ensure_scheme, "https://example.hr") == "https://example.hr"


def test_media_identity(spark):
    assert _one(spark, U.media_identity, "http://a/v.swf?x=1") == "http://a/v.swf"


def test_obs_time_rolls_back_past_midnight(spark):
    df = spark.createDataFrame([("23:50", "2024-01-02 00:10:00"), ("00:05", "2024-01-02 00:10:00")],
                               "hhmm string, ing string")
    out = [str(r.t) for r in df.select(U.obs_time(F.col("hhmm"), F.col("ing").cast("timestamp")).alias("t"))
           .collect()]
    assert out == ["2024-01-01 23:50:00", "2024-01-02 00:05:00"]


def test_multiset_expand_collapse_identity(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "c")], "k long, v string")
    from pagesig.operators import aggregate as AG
    ms = AG.ag_multiset_column(df, ["k"], "v")
    out = {r.k: (r.e, r.s) for r in ms.select("k", MS.expand(F.col("ms")).alias("e"),
                                              MS.serialize(F.col("ms")).alias("s")).collect()}
    assert out == {1: (["a", "b", "b"], "abb"), 2: (["c"], "c")}


def test_fuzzy_hash_properties():
    rng = random.Random(1)
    base = bytes(rng.randrange(32, 127) for _ in range(4000))
    h = fuzzy_hash_py(base)
    assert h == fuzzy_hash_py(bytes(base))
    edited = base[:2000] + b"#" + base[2001:]
    h2 = fuzzy_hash_py(edited)
    bs, s1, _ = h.split(":")
    bs2, t1, _ = h2.split(":")
    assert bs == bs2
    # a one-byte edit changes a few pieces only
    assert lcs_ratio_py(s1.encode(), t1.encode()) > 0.8
    assert fuzzy_hash_py(b"") == "3::"


def test_feed_delta(spark):
    feed = spark.createDataFrame([(0, "t5", "n", "r5"), (1, "t4", "n", "r4"), (2, "t3", "n", "r3"),
                                  (3, "t2", "n", "r2")], "ordinal long, time string, notifier string, mirror string")
    cur = spark.createDataFrame([("t3", "n", "r3")], "time string, notifier string, mirror string")
    unknown = spark.createDataFrame([("t9", "n", "r9")], "time string, notifier string, mirror string")
    assert [r.mirror for r in R.src_feed_delta(feed, cur).collect()] == ["r4", "r5"]
    assert [r.mirror for r in R.src_feed_delta(feed, unknown).collect()] == ["r2", "r3", "r4", "r5"]


def test_whois_origin(spark):
    rows = [(1, "% c\n\n3303\t1.0.0.0/8\n"), (2, "64500\t1.0.0.0/8\n"), (3, "1\t2\n3\t4\n"), (4, "1\t2\t3\n")]
    df = spark.createDataFrame(rows, "reply_id long, value string")
    out = {r.reply_id: (r.asn, r.reason) for r in R.src_whois_origin(df).collect()}
    assert out == {1: ("", None), 2: ("64500", None), 3: (None, "lines"), 4: (None, "fields")}


def test_file_readers(spark, tmp_path):
    reply = tmp_path / "reply.txt"
    reply.write_text("Bulk mode; whois\n 10 | 1.2.3.4 | HR \n 11 | 5.6.7.8 | DE\n 12 | 1.2.3.4 | SI\n")
    out = {r.ip: (r.asn, r.cc) for r in R.read_ip_asn_reply(spark, str(reply)).collect()}
    assert out == {"1.2.3.4": ("12", "SI"), "5.6.7.8": ("11", "DE")}
    deleg = tmp_path / "delegated.txt"
    deleg.write_text("# header\n2|ripencc|1|2|3|4|5\nripencc|*|ipv4|*|2|summary\n"
                     "ripencc|HR|ipv4|31.45.0.0|65536|20110101|allocated\n"
                     "ripencc|HR|ipv6|2001:b68::|32|20040101|allocated\n"
                     "ripencc|SI|ipv4|31.15.0.0|256|20110101|allocated\n")
    out = [(r.cc, r.start_ip, r.end_ip) for r in R.read_delegated_ranges(spark, str(deleg), "hr").collect()]
    assert out == [("HR", 523042816, 523042816 + 65535)]
    wl = tmp_path / "worklist.json"
    wl.write_text('{"64500": ["a.hr", "b.hr"], "64501": ["c.hr"]}')
    out = sorted((r.asn, r.pos, r.domain) for r in R.read_asn_worklist(spark, str(wl)).collect())
    assert out == [("64500", 0, "a.hr"), ("64500", 1, "b.hr"), ("64501", 0, "c.hr")]
    reg = tmp_path / "registry.json"
    reg.write_text('[{"domain_name": "a.hr"}, {"domain_name": "b.hr", "x": 1}]')
    assert sorted(r.domain_name for r in R.read_domain_registry(spark, str(reg)).collect()) == ["a.hr", "b.hr"]


def test_fast_fuzzy_hash_equals_reference_loop():
    from pagesig.functions.similarity import fuzzy_hash_batch
    rng = random.Random(8)
    cases = [b"", b"a", b"abcdefg", b"x" * 8] + [
        bytes(rng.choice(b"abcdefghij ") for _ in range(rng.randint(1, n))) for n in (10, 100, 2000, 9000) * 10]
    assert fuzzy_hash_batch(cases + [None]) == [fuzzy_hash_py(c) for c in cases] + [None]


def test_id_bitmaps_keep_every_id(spark):
    from pagesig.operators import aggregate
    ids = [0, 1, 2, -1, -2, 32767, 32768, 32769, -32767, -32768, -32769, 65536, 65537, 10 ** 12, -(10 ** 12), 7, 7, None]
    df = spark.createDataFrame([(o, i) for o in ("a", "b") for i in ids[o == "b":]] + [("c", 5)], "owner string, id long").repartition(3)
    packed = aggregate.id_bitmaps(df, ["owner"], "id")
    got = sorted((r.owner, r.id) for r in aggregate.bitmap_ids(packed, "id").collect())
    assert got == sorted({(r.owner, r.id) for r in df.collect() if r.id is not None})


def test_scattered_ids_cost_a_number_each(spark):
    from pagesig.operators import aggregate
    ids = [i * 40_000 + i % 7 for i in range(300)]
    packed = aggregate.id_bitmaps(spark.createDataFrame([("a", i) for i in ids], "owner string, id long"), ["owner"], "id")
    assert dict(packed.dtypes)["bits"] == "bigint" and packed.count() == len(ids)
    assert sorted(r.id for r in aggregate.bitmap_ids(packed, "id").collect()) == ids
