"""Extraction page, exhaustive vs pruned scan, store round trips, streams, plan shapes, entry."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bruteforce import exhaustive_scores, match as bf_match
from paths import SF0001
from pagesig.functions.similarity import fuzzy_hash_py, lcs_ratio_py
from pagesig.operators import extract as X
from pagesig.operators import match as M
from pagesig.operators import netspace as N
from pagesig.operators import retention as RT
from pagesig.operators import sinks as SK
from pagesig.sources import corpora

PAGE = """<html><head><title>T1x</title><style>body{background-image:url("b.png")}</style></head>
<body background="c.png"><!-- note -->Hacked <b>by X</b><img src="/i.png"><embed src="m.swf?a=1">
<iframe src="http://h/v"></iframe><script>alert("pwned one");</script></body></html>"""
URL = "http://site.hr/d/index.html"


def _page_df(spark):
    return spark.createDataFrame([(1, URL, PAGE)], "page_id long, url string, html string")


def test_extraction_page(spark):
    raw = X.ext_raw_elements(_page_df(spark)).collect()
    got = {}
    for r in raw:
        got.setdefault(r.kind, []).append(r.value)
    assert got == {
        "texts": ["T1x", "Hacked ", "by X"],
        "images": ["http://site.hr/i.png"],
        "backgroundImages": ["http://site.hr/d/b.png", "http://site.hr/d/c.png"],
        "alerts": ["pwned one"],
        "music": ["http://site.hr/d/m.swf?a=1", "http://h/v"],
    }
    with_comments = [r.value for r in X.ext_raw_elements(_page_df(spark), keep_comments=True).collect()
                     if r.kind == "texts"]
    assert with_comments == ["T1x", " note ", "Hacked ", "by X"]


def test_page_elements_chain(spark):
    res = spark.createDataFrame([("http://site.hr/i.png", b"\x89PNG" + b"x" * 2000),
                                 ("http://site.hr/d/b.png", b"GIF89a")], "url string, content binary")
    els = X.ext_page_elements(_page_df(spark), res).collect()
    got = sorted((r.type, bytes(r.element)[:12], r.resource) for r in els)
    assert got == sorted([
        ("Ltexts", b"T1x", None), ("Ltexts", b"Hacked ", None), ("Ltexts", b"by X", None),
        ("Lalerts", b"pwned one", None),
        ("Lmusic", b"http://site.", "http://site.hr/d/m.swf?a=1"), ("Lmusic", b"http://h/v", "http://h/v"),
        ("Himages", b"\x89PNG" + b"x" * 8, "http://site.hr/i.png"),
        ("LbackgroundImages", b"GIF89a", "http://site.hr/d/b.png"),
    ])
    media = [bytes(r.element) for r in els if r.type == "Lmusic"]
    assert b"http://site.hr/d/m.swf" in media


def _class_scores(scan):
    """{(page, class): score} of all pairs, below the threshold too."""
    return {(r.content, r.sig_class): r.score for r in M.mt_type_mean(scan.type_scores, scan.library.rows).collect()}


def test_pruned_scan_equals_exhaustive_and_brute_force(spark):
    pages = corpora.table(spark, SF0001, "pages")
    pe = X.ext_page_elements(pages).cache()
    lib, meta = M.page_library(pe, corpora.pages_observations(spark, SF0001))
    lib, meta = lib.cache(), meta.cache()
    scan, full = M.Scan(M.Library(lib), pe), exhaustive_scores(lib, pe)
    pruned = M.mt_verdict(pages, scan, meta).collect()
    assert {tuple(r) for r in pruned} == {tuple(r) for r in M.mt_verdict(pages, full, meta).collect()}
    got = {(r.content, r.sig_class): r.score for r in scan.scores.collect()}
    every = _class_scores(full)
    assert got == pytest.approx({k: v for k, v in every.items() if v >= 0.75})

    sigs, web = {}, {}
    for r in lib.collect():
        sigs.setdefault(r.sig_id, {}).setdefault(r.type, []).append(bytes(r.element))
    for r in pe.collect():
        web.setdefault(r.page_id, {}).setdefault(r.type, []).append(bytes(r.element))
    assert any(t.startswith("H") for s in sigs.values() for t in s)
    classes = {r.sig_class for r in scan.library.classes.collect()}
    contents = {r.content for r in scan.pages.collect()}

    def ratio_for(t):
        if t.startswith("H"):
            return lambda a, b: lcs_ratio_py(fuzzy_hash_py(a).encode(), fuzzy_hash_py(b).encode())
        return lcs_ratio_py

    for pid in sorted(contents)[:6]:
        for sid in classes:
            s = sigs[sid]
            exp = sum(bf_match({t: rows}, web[pid], ratio_for(t)) for t, rows in s.items()) / len(s)
            assert every.get((pid, sid), 0.0) == pytest.approx(exp, abs=1e-9), (pid, sid)
    own = {r.page_id: r for r in pruned}
    for sid in sigs:
        assert own[sid].found and own[sid].score_pct == pytest.approx(100.0)


def test_shared_elements_ties_and_near_matches(spark):
    """Boilerplate on every page, several equal signatures, near texts: pruned = exhaustive, and the
    boilerplate row makes no candidates of its own."""
    import random
    rng = random.Random(11)

    def text(n=60, letters="abcdefghijklmnopqrstuvwxyz0123456789"):
        return "".join(rng.choice(letters) for _ in range(n)).encode()

    common, rows, elements = b"the same footer on every page", [], []
    own = [text() for _ in range(12)]
    for sid in range(1, 11):
        parts = [common, own[sid % 6], own[sid % 6 + 1]] if sid < 9 else [common, own[sid], text(70)]
        rows += [(sid, "Ltexts", x) for x in parts] + [(sid, "Lalerts", own[sid])]
    for pid in range(100, 160):
        texts = [common, own[pid % 9], text()] + ([own[pid % 6], own[pid % 6 + 1]] if pid % 4 == 0 else [])
        if pid % 7 == 0:
            texts += [own[1][:50] + b"0123456789", own[2][:55] + b"abcde"]
        elements += [(pid, "Ltexts", x) for x in texts] + [(pid, "Lalerts", own[pid % 12])]
    lib = spark.createDataFrame(rows, "sig_id long, type string, element binary")
    pe = spark.createDataFrame(elements, "page_id long, type string, element binary")
    scan, full = M.Scan(M.Library(lib), pe), exhaustive_scores(lib, pe)
    pages = spark.range(95, 160).withColumnRenamed("id", "page_id")
    meta = spark.createDataFrame([(i, "x", None) for i in range(1, 11)], "sig_id long, owner string, detected_on timestamp")
    assert {tuple(r) for r in M.mt_verdict(pages, scan, meta).collect()} == {tuple(r) for r in M.mt_verdict(pages, full, meta).collect()}
    every = _class_scores(full)
    assert {(r.content, r.sig_class): r.score for r in scan.scores.collect()} == pytest.approx({k: v for k, v in every.items() if v >= 0.75})
    code = scan.dictionary.where(F.col("cmp") == F.lit(common)).first()["code"]
    assert scan.prefix_rows.where(F.col("scode") == code).count() == 0
    assert scan.candidates.count() < 60 * 10 / 2
    best = {r.content: r.sig_id for r in scan.winners.collect()}
    for content in best:
        top = max(v for (c, _), v in every.items() if c == content)
        assert best[content] == min(s for (c, s), v in every.items() if c == content and v >= top - 1e-12)


def test_ingest_twice_creates_keys_once(spark):
    obs = spark.createDataFrame([(1, "hr", "2024-01-01 00:00:00", "http://a.hr", "z"),
                                 (2, "si", "2024-01-02 00:00:00", "http://b.si", "z")],
                                "obs_key long, owner string, time string, url string, mirrorsrc string") \
        .withColumn("time", F.col("time").cast("timestamp_ntz"))
    occ = spark.createDataFrame([(1, "Ltexts", b"hello", None), (1, "Ltexts", b"hello", None),
                                 (2, "Ltexts", b"hello", None), (2, "Ltexts", b"world", None)],
                                "obs_key long, type string, element binary, resource string")
    s1 = SK.snk_ingest(obs, occ, SK.empty_store(spark))
    s2 = SK.snk_ingest(obs.withColumn("obs_key", F.col("obs_key") + 10),
                       occ.withColumn("obs_key", F.col("obs_key") + 10), s1)
    assert s2["owners"].count() == 2 and s2["elements"].count() == 2
    assert s2["observations"].count() == 4 and s2["bridge"].count() == 8
    ids = [r.id for r in s2["observations"].collect()]
    assert sorted(ids) == [1, 2, 3, 4]
    assert all(r.hash for r in s2["elements"].collect())


def test_reconcile_refreshes_and_is_idempotent(spark):
    induced = spark.createDataFrame([(7, ["a", "b"]), (7, ["c"]), (8, ["a"])], "owner long, signature array<string>")
    sigs = spark.createDataFrame([(1, 7, 0, "2020-01-01 00:00:00"), (2, 7, 0, "2020-01-01 00:00:00")],
                                 "id long, notifier_id long, detection int, timestamp string") \
        .withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    sb = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a")], "sig_id long, element string")
    r = SK.snk_signatures(induced, sigs, sb, "2024-05-05 00:00:00")
    assert [(x.owner, x.sig_id) for x in r["refreshed"].collect()] == [(7, 1)]
    assert sorted((x.owner, tuple(x.signature)) for x in r["inserted"].collect()) == [(7, ("c",)), (8, ("a",))]
    again = SK.snk_signatures(induced, r["signatures"], r["sig_bridge"], "2024-06-06 00:00:00")
    assert again["inserted"].count() == 0 and again["refreshed"].count() == 3


def test_retention_leaves_no_orphans_and_is_idempotent(spark):
    store = {
        "owners": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string"),
        "observations": spark.createDataFrame([(10, "2023-01-01 00:00:00", 1), (11, "2024-05-01 00:00:00", 2)],
                                              "id long, time string, notifier_id long")
        .withColumn("time", F.col("time").cast("timestamp_ntz")),
        "bridge": spark.createDataFrame([(10, 100), (11, 101), (11, 100)], "defaces_id long, elements_defaces_id long"),
        "elements": spark.createDataFrame([(100, "x"), (101, "y"), (102, "z")], "id long, type string"),
        "signatures": spark.createDataFrame([(5, 3)], "id long, notifier_id long"),
    }
    out = RT.rt_expire_observations(store, "2024-06-01 00:00:00", 6)
    assert sorted(r.id for r in out["observations"].collect()) == [11]
    assert sorted(r.id for r in out["elements"].collect()) == [100, 101]
    assert sorted(r.id for r in out["owners"].collect()) == [2, 3]
    twice = RT.rt_expire_observations(out, "2024-06-01 00:00:00", 6)
    for k in ("observations", "elements", "owners", "bridge"):
        assert sorted(map(tuple, twice[k].collect())) == sorted(map(tuple, out[k].collect()))


def test_range_join_plans_without_nested_loop(spark):
    ips = corpora.event_ips(spark, SF0001).select("event_id", F.col("ip_long").alias("ip"))
    ranges = corpora.nation_ranges(spark, SF0001)
    j = N.jn_ip_in_ranges(ips, ranges, "ip")
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    plain = ips.join(ranges, (ips.ip >= ranges.start_ip) & (ips.ip <= ranges.end_ip))
    assert j.count() == plain.count()


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    a = {tuple(r) for r in q["st_reinduce"](spark, SF0001).collect()}
    b = {tuple(r) for r in q["sg_induce"](spark, SF0001).collect()}
    assert a == b and len(a) == 18
    ing = q["st_ingest"](spark, SF0001)
    assert ing.count() == corpora.table(spark, SF0001, "events").count()


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["owner", "signature", "pages", "n_pages", "n_elements"]
    assert df.count() == 18


def test_large_elements_compare_by_fuzzy_hash(spark):
    """H-size signature elements are scored on the fuzzy hashes, exhaustively and pruned."""
    import random
    rng = random.Random(4)
    words = [bytes(rng.choice(b"abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]

    def text(n):
        return b" ".join(rng.choice(words) for _ in range(n))

    base = text(400)
    assert len(base) > 1000
    near = base[:600] + b"XYZ" + base[603:]
    lib = spark.createDataFrame([(1, "Htexts", base), (1, "Ltexts", b"short heading"), (2, "Htexts", text(400))],
                                "sig_id long, type string, element binary")
    pe = spark.createDataFrame([(10, "Htexts", near), (10, "Ltexts", b"short heading!"), (11, "Htexts", text(380)),
                                (12, "Ltexts", b"short heading")],
                               "page_id long, type string, element binary")
    exhaustive_scan = exhaustive_scores(lib, pe)
    full = _class_scores(exhaustive_scan)
    hratio = lambda a, b: lcs_ratio_py(fuzzy_hash_py(a).encode(), fuzzy_hash_py(b).encode())
    sigs = {1: {"Htexts": [base], "Ltexts": [b"short heading"]}, 2: {"Htexts": [lib.collect()[2].element]}}
    web = {10: {"Htexts": [near], "Ltexts": [b"short heading!"]}, 11: {"Htexts": [pe.collect()[2].element]},
           12: {"Ltexts": [b"short heading"]}}
    for pid, w in web.items():
        for sid, s in sigs.items():
            exp = sum(bf_match({t: [bytes(x) for x in rows]}, {k: [bytes(x) for x in v] for k, v in w.items()},
                               hratio if t.startswith("H") else lcs_ratio_py) for t, rows in s.items()) / len(s)
            assert full.get((pid, sid), 0.0) == pytest.approx(exp, abs=1e-9)
    pages = spark.createDataFrame([(10,), (11,), (12,)], "page_id long")
    meta = spark.createDataFrame([(1, "hr", None), (2, "si", None)], "sig_id long, owner string, detected_on timestamp")
    pruned = {tuple(r) for r in M.mt_verdict(pages, M.Scan(M.Library(lib), pe), meta).collect()}
    exhaustive = {tuple(r) for r in M.mt_verdict(pages, exhaustive_scan, meta).collect()}
    assert pruned == exhaustive
    assert full[(10, 1)] > 0.75


def test_collect_then_scan_flows(spark):
    from pagesig.plans import collect, scan
    feed = spark.createDataFrame([(0, "10:05", "crew", "m3"), (1, "09:40", "crew", "m2"), (2, "08:00", "solo", "m1")],
                                 "ordinal long, time string, notifier string, mirror string")
    cursor = spark.createDataFrame([("08:00", "solo", "m1")], "time string, notifier string, mirror string")
    other = PAGE.replace("Hacked", "Owned").replace("T1x", "T2y")
    mirrors = spark.createDataFrame([("m1", "http://a.hr/", PAGE), ("m2", "http://b.hr/x", PAGE),
                                     ("m3", "http://c.hr/", other)], "mirror string, url string, html string")
    store = collect.collect(feed, cursor, mirrors, SK.empty_store(spark), "2024-03-01 12:00:00")
    assert store["observations"].count() == 2 and store["owners"].count() == 1
    assert sorted(r.mirrorsrc for r in store["observations"].collect()) == ["m2", "m3"]
    # a one-signature library from the stored elements of m2 (all its texts), scanned on both pages
    obs_m2 = store["observations"].where(F.col("mirrorsrc") == "m2").select(F.col("id").alias("defaces_id"))
    els = store["bridge"].join(obs_m2, "defaces_id").select(F.col("elements_defaces_id").alias("element_id"))
    sig_elements = store["elements"].join(els.select(F.col("element_id").alias("id")).distinct(), "id")
    sig_elements = sig_elements.where(F.col("type") == "Ltexts")
    sig_bridge = sig_elements.select(F.lit(1).cast("long").alias("sig_id"), F.col("id").alias("element_id"))
    signatures = spark.createDataFrame([(1, 1, 0, None)], "id long, notifier_id long, detection int, timestamp timestamp_ntz")
    rows, meta = scan.library_from_store(signatures, sig_bridge, sig_elements, store["owners"])
    pages = mirrors.select(F.monotonically_increasing_id().alias("page_id"), "url", "html", "mirror")
    v = {r.page_id: r for r in scan.scan_pages(pages.drop("mirror"), rows, meta).collect()}
    ids = {r.mirror: r.page_id for r in pages.collect()}
    assert v[ids["m1"]].found and v[ids["m2"]].found and v[ids["m1"]].owner == "crew"
    assert not v[ids["m3"]].found


def test_scans_move_bytes_once_per_distinct_element(spark):
    """Occurrences are counted by a hash aggregate (no sort of their bytes), contents hold numbers only."""
    page = [(p, "Htexts" if e % 2 else "Ltexts", bytearray(b"x" * 50 + bytes([e]))) for p in range(40) for e in (p % 5, p % 3, 7)]
    df = spark.createDataFrame(page, "page_id long, type string, element binary")
    plan = M.dictionary(M.coded(df, "page_id"))._jdf.queryExecution().sparkPlan().toString()
    lowest = [line for line in plan.splitlines() if "Aggregate(" in line][-1]
    assert "HashAggregate(keys=[type" in lowest and "SortAggregate" not in lowest
    scan = M.Scan(M.Library(df.where("page_id = 0").withColumnRenamed("page_id", "sig_id")), df)
    assert scan.distinct.count() == len({(t, bytes(e)) for _, t, e in page})
    assert scan.pages.columns == ["page_id", "content"]
    want = {}
    for p, t, e in page:
        want.setdefault(p, []).append((t, bytes(e)))
    first = {}
    for p in sorted(want):
        first.setdefault(tuple(sorted(want[p])), p)
    assert {r.page_id: r.content for r in scan.pages.collect()} == {p: first[tuple(sorted(x))] for p, x in want.items()}
    code = {r.code: (r.type, bytes(r.element)) for r in scan.distinct.collect()}
    got = {}
    for r in scan.columns.collect():
        got.setdefault((r.content, r.type), {})[r.col] = code[r.pcode][1]
    for p in first.values():
        for t in {t for t, _ in want[p]}:
            own = sorted(e for u, e in want[p] if u == t)
            assert got[p, t] == dict(enumerate(own))


def test_extraction_batches_are_bounded_whatever_the_input_batch_holds(spark):
    page = "<p>" + "</p><p>".join(f"line {i} " + "x" * 500 for i in range(200)) + "</p><embed src='m.swf'>"
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(300)), "url": [URL] * 300, "html": [page] * 300})
    sizes, media = [], 0
    for batch in X._scan_batches(False)(iter([pages])):
        sizes.append((batch.num_rows, batch.nbytes))
        media += sum(k == "music" for k in batch.column(1).to_pylist())
    assert sum(n for n, _ in sizes) == 300 * 201 and media == 300
    assert max(n for n, _ in sizes) <= X.OUT_ROWS and max(b for _, b in sizes) < 2 * X.OUT_CHARS
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(2**31 - 1))
    X.ext_raw_elements(_page_df(spark))
    assert int(spark.conf.get(key)) <= X.IN_BYTES
    spark.conf.set(key, before)


def test_ingest_reads_the_pages_once(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.hr/", PAGE.replace("one", f"no {i}")) for i in range(20)],
                                  "page_id long, url string, html string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    occ = X.ext_page_elements(pages.coalesce(1).mapInArrow(counted, pages.schema)).select(
        F.col("page_id").alias("obs_key"), "type", "element", "resource")
    obs = pages.select(F.col("page_id").alias("obs_key"), F.lit("hr").alias("owner"),
                       F.lit("2024-01-01").cast("timestamp_ntz").alias("time"), "url", F.lit("z").alias("mirrorsrc"))
    new = SK.new_rows(obs, occ, SK.empty_store(spark))
    rows = {name: table.collect() for name, table in new.items()}
    assert seen.value == 20
    kinds = 6  # title, two texts, an alert, two media; an alert and a medium are of their page alone
    assert len(rows["bridge"]) == 20 * kinds and len(rows["elements"]) == 4 + 2 * 20
    assert all(r.hash == fuzzy_hash_py(r.element) for r in rows["elements"])
    assert {r.defaces_id for r in rows["bridge"]} == {r.id for r in rows["observations"]}
