"""Streams over several files, stores with bytes that are not text, limits that are gone."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagesig.functions.htmlscan import scan_page
from pagesig.operators import extract as X
from pagesig.operators import induce, match, retention, sinks
from pagesig.operators.joins import element_key, jn_active_owners
from pagesig.sources.readers import read_ip_asn_reply
from pagesig.streaming import incremental as ST


def _files(spark, path, frames):
    for k, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(path)
    return ST.stream_parquet(spark, path, max_files=1)


def test_ingest_keeps_late_reports_and_one_of_each(spark):
    path = ST.scratch_path(spark, "in")
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [[(day(20), "a", "u1", "m")], [(day(10), "a", "u2", "m"), (day(20), "a", "u1", "m")], [(day(19), "b", None, "m")],
            [(day(19), "b", None, "m"), (day(1), "c", "u3", "m")]]
    stream = _files(spark, path, [spark.createDataFrame(r, "time timestamp, owner string, url string, mirrorsrc string") for r in rows])
    got = ST.st_ingest(stream, ["time", "owner", "url", "mirrorsrc"], "time", ST.scratch_path(spark, "out")).collect()
    assert sorted((r["time"].day, r["owner"], r["url"]) for r in got) == sorted({(r[0].day, r[1], r[2]) for f in rows for r in f}, key=str) or \
        {(r["time"].day, r["owner"], r["url"]) for r in got} == {(r[0].day, r[1], r[2]) for f in rows for r in f} and len(got) == 4


def test_ingest_by_a_shorter_key_keeps_the_earliest(spark):
    path = ST.scratch_path(spark, "in")
    stream = _files(spark, path, [spark.createDataFrame(r, "time long, url string") for r in ([(5, "x"), (3, "x")], [(1, "x"), (2, "y")])])
    got = ST.st_ingest(stream, ["url"], "time", ST.scratch_path(spark, "out")).collect()
    assert sorted(map(tuple, got)) == [(2, "y"), (3, "x")]


def test_ingest_goes_on_where_it_stopped(spark):
    path, out = ST.scratch_path(spark, "in"), ST.scratch_path(spark, "out")
    for rows, want in (([("u1", 1), ("u2", 2)], 2), ([("u1", 1), (None, 3), (None, 3)], 3), ([("u2", 2), ("u4", 4)], 4)):
        stream = _files(spark, path, [spark.createDataFrame(rows, "url string, time int")])
        assert ST.st_ingest(stream, ["url", "time"], "time", out).count() == want


def test_replayed_batch_replaces_its_rows(spark):
    out = ST.scratch_path(spark, "replay")
    for _ in range(2):
        ST.write_batch(spark.range(3), out, 0)
    ST.write_batch(spark.range(2), out, 1)
    assert spark.read.parquet(out).count() == 5


def test_reinduction_drops_an_owner_that_lost_its_signature(spark):
    path = ST.scratch_path(spark, "in")
    stream = _files(spark, path, [spark.createDataFrame([(o,)], "owner string") for o in ("k", "j", "k")])
    answers = {"k": ["A", None], "j": ["B"]}

    def induce_for(touched):
        owners = [r["owner"] for r in touched.collect()]
        rows = [(o, a) for o in owners for a in [answers[o].pop(0)] if a]
        return spark.createDataFrame(rows, "owner string, signature string")

    got = ST.st_reinduce(stream, induce_for, ST.scratch_path(spark, "out")).collect()
    assert [tuple(r) for r in got] == [("j", "B")]


def test_verdicts_of_a_day_are_replaced(spark):
    path = ST.scratch_path(spark, "verdicts")
    for n in (3, 2):
        sinks.snk_verdicts(spark.range(n), path, "2024-01-31")
    sinks.snk_verdicts(spark.range(4), path, "2024-02-01")
    assert spark.read.parquet(path).groupBy("scan_date").count().orderBy("scan_date").toPandas()["count"].tolist() == [2, 4]


def test_bytes_that_are_not_text_survive_and_refresh(spark):
    rows = [("Limages", bytearray(b)) for b in (b"\xff\xfe\x01", b"\xff\xfe\x02", b"plain")]
    keys = [r["k"] for r in spark.createDataFrame(rows, "type string, element binary").select(element_key().alias("k")).collect()]
    assert len(set(keys)) == 3 and keys[2] == "Limages:plain" and "FFFE01" in keys[0]
    induced = spark.createDataFrame([(7, keys[:2]), (7, keys[2:])], "owner long, signature array<string>")
    empty_sig = spark.createDataFrame([], "id long, notifier_id long, detection int, timestamp timestamp_ntz")
    empty_bridge = spark.createDataFrame([], "sig_id long, element string")
    first = sinks.snk_signatures(induced, empty_sig, empty_bridge, "2024-01-01 00:00:00")
    assert first["inserted"].count() == 2 and {r["element"] for r in first["sig_bridge"].collect()} == set(keys)
    second = sinks.snk_signatures(induced, first["signatures"], first["sig_bridge"], "2024-02-01 00:00:00")
    assert second["inserted"].count() == 0 and second["signatures"].count() == 2


def test_ids_are_dense_in_key_order(spark):
    df = spark.createDataFrame([(f"n{i % 50:03d}", bytearray([i % 256, 255])) for i in range(50)], "name string, b binary")
    got = sinks.assign_ids(df, ["name"], 11).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(11, 61)) and [r["name"] for r in got] == sorted(r["name"] for r in got)
    assert {bytes(r["b"]) for r in got} == {bytes([i, 255]) for i in range(50)}


def test_scan_keeps_every_alert_and_reads_handlers_and_data_urls():
    html = """<body onload="alert('hi')" style="background:url(data:image/png;base64,AA;BB==) no-repeat; color:red">
<script>alert('don\\'t\\nX'); """ + "alert(\"k\");" * 15 + """</script></body>"""
    got = scan_page("http://a/b", html)
    alerts = [v for k, _, v, _ in got if k == "alerts"]
    assert alerts == ["hi", "don't\nX"] + ["k"] * 15
    assert [v for k, _, v, _ in got if k == "backgroundImages"] == ["data:image/png;base64,AA;BB=="]
    assert sum(k == "alerts" for k, *_ in scan_page("http://a/b", html, max_alerts=11)) == 11


def test_newest_download_of_a_url_counts(spark):
    refs = spark.createDataFrame([(1, 0, "u")], "page_id long, pos int, value string")
    res = spark.createDataFrame([("u", bytearray(b"old"), 1), ("u", bytearray(b"new"), 2), ("u", None, 3)], "url string, content binary, fetched long")
    assert bytes(X.ext_resource_join(refs, res).first()["element"]) == b"new"
    assert X.ext_resource_join(refs, res.drop("fetched")).count() == 1


def test_last_reply_line_wins_over_several_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 | 9.9.9.9 | AA\n" + "7 | 8.8.8.8 | XX\n" * 2000)
    (tmp_path / "b.txt").write_text("2 | 9.9.9.9 | BB\n")
    got = {r["ip"]: r["asn"] for r in read_ip_asn_reply(spark, str(tmp_path)).collect()}
    assert got == {"9.9.9.9": "2", "8.8.8.8": "7"}


def test_pair_thresholds_at_the_edges(spark):
    texts = {"a": b"x" * 243, "b": b"x" * 729, "c": b"same"}

    def side(names, mark=None):
        df = spark.createDataFrame([(1, "Ltexts", bytearray(texts[n])) for n in names], "page_id long, type string, element binary")
        return match.dictionary(match.coded(df, "page_id")).withColumn("mark", F.lit(mark))

    assert [r["ratio"] for r in match.mt_pair_scores(side("a", 0.5), side("b").drop("mark")).collect()] == [0.5]
    assert [r["ratio"] for r in match.mt_pair_scores(side("ac", 0.75), side("bc").drop("mark")).collect()] == [1.0]


def test_active_owners(spark):
    obs = spark.createDataFrame([(1, "a"), (5, "b"), (6, "b"), (9, "c"), (7, None)], "obs_id long, owner string")
    assert sorted(r["owner"] for r in jn_active_owners(obs, 1, 8).collect()) == ["b"]


def test_parts_are_built_on_demand(spark):
    occ = spark.createDataFrame([(1, 1, "x"), (1, 2, "x")], "owner long, page long, element string")
    parts = induce.induction_parts(occ)
    assert parts["lines"].count() == 2 and "eliminated" not in vars(parts)
    assert F is not None


def store_batch(spark, keys):
    t0 = dt.datetime(2024, 1, 1)
    obs = spark.createDataFrame([(k, f"o{k % 2}", t0, f"http://h{k}/", "m") for k in keys],
                                "obs_key long, owner string, time timestamp_ntz, url string, mirrorsrc string")
    occ = spark.createDataFrame([(k, "Limages", bytearray([255, k % 3]), None) for k in keys],
                                "obs_key long, type string, element binary, resource string")
    return obs, occ


TABLES = ["owners", "observations", "elements", "bridge"]


def counts(store):
    return {t: store[t].count() for t in TABLES}


def test_stored_batches_count_once_they_are_published(spark):
    path = ST.scratch_path(spark, "store")
    sinks.save_batch(sinks.new_rows(*store_batch(spark, [1, 2, 3]), sinks.empty_store(spark)), {"mark": 3}, path, 0)
    store, cursors, last = sinks.load_store(spark, path, TABLES)
    assert (cursors, last) == ({"mark": "3"}, 0)
    new = sinks.new_rows(*store_batch(spark, [4, 5]), store)
    for name, df in new.items():  # a run that stops before it is published
        df.write.parquet(f"{path}/{name}/batch=1-9-stopped")
    store, cursors, last = sinks.load_store(spark, path, TABLES)
    assert last == 0 and store["observations"].count() == 3
    sinks.save_batch(sinks.new_rows(*store_batch(spark, [4, 5]), store), {"mark": 5}, path, 1)
    store, cursors, last = sinks.load_store(spark, path, TABLES)
    assert (cursors, last) == ({"mark": "5"}, 1) and store["observations"].count() == 5


def test_a_rerun_that_stops_between_tables_changes_nothing(spark):
    path = ST.scratch_path(spark, "store")
    for n, keys in enumerate(([1, 2, 3], [4, 5, 6])):
        before = sinks.load_store(spark, path, TABLES)[0] if n else sinks.empty_store(spark)
        sinks.save_batch(sinks.new_rows(*store_batch(spark, keys), before), {"mark": n}, path, n)
    whole = counts(sinks.load_store(spark, path, TABLES)[0])
    rows = sinks.new_rows(*store_batch(spark, [7, 8]), sinks.load_store(spark, path, TABLES)[0])
    dying = {"owners": rows["owners"], "observations": rows["observations"].withColumn("id", F.raise_error(F.lit("lost")).cast("long"))}
    with pytest.raises(Exception):
        sinks.save_batch(dying, {"mark": 9}, path, 1)
    store, cursors, last = sinks.load_store(spark, path, TABLES)
    assert counts(store) == whole and cursors == {"mark": "1"} and last == 1
    sinks.save_batch(rows, {"mark": 2}, path, 1)  # the rerun replaces the batch
    store, cursors, last = sinks.load_store(spark, path, TABLES)
    assert sorted(r.url for r in store["observations"].collect()) == ["http://h1/", "http://h2/", "http://h3/", "http://h7/", "http://h8/"]


def test_expiry_of_a_stored_table(spark):
    path = ST.scratch_path(spark, "store")
    sinks.save_batch(sinks.new_rows(*store_batch(spark, [1, 2, 3]), sinks.empty_store(spark)), {"mark": 3}, path, 0)
    for as_of, left in (("2024-03-01 00:00:00", 3), ("2024-03-01 00:00:00", 3), ("2025-01-01 00:00:00", 0)):
        retention.expire_stored(spark, path, TABLES, lambda s: retention.rt_expire_observations(s, as_of, 6))
        store, cursors, _ = sinks.load_store(spark, path, TABLES)
        assert store["observations"].count() == left and cursors == {"mark": "3"}
        assert store["owners"].count() == (2 if left else 0) and store["elements"].count() == (3 if left else 0)
    sinks.save_batch(sinks.new_rows(*store_batch(spark, [4]), store), {"mark": 4}, path, 1)
    assert sinks.load_store(spark, path, TABLES)[0]["observations"].count() == 1
    with pytest.raises(ValueError):  # batch 0 is part of the base now
        sinks.save_batch(sinks.new_rows(*store_batch(spark, [4]), store), {}, path, 0)


def test_worklists_are_read_by_many_tasks(spark, tmp_path):
    import json
    import random

    from pagesig.sources import readers
    rng = random.Random(9)
    work = {str(a): [f"host{rng.randrange(10 ** 6)}.example{a}.org" for _ in range(rng.choice([0, 1, 3, 2500]))] for a in range(40)}
    work["64500"] = ['quo\\"te.example', "ünï.example"]
    want = sorted((a, i, d) for a, own in work.items() for i, d in enumerate(own))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for indent in (None, 1):
            path = str(tmp_path / f"work{indent}.json")
            with open(path, "w") as f:
                json.dump(work, f, indent=indent)
            chunks = readers.worklist_chunks(spark, path)
            assert chunks.rdd.getNumPartitions() > 20
            assert sorted(map(tuple, readers.read_asn_worklist(spark, path).collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_malformed_worklists_give_reasons(spark, tmp_path):
    from pagesig.sources import readers
    (tmp_path / "a.json").write_text('{"1": ["a.hr", 7, "b.hr"], "2": [nul, "c.hr"]}\n{"3": ["d.hr"]}')
    rows = readers.split_worklist(readers.worklist_chunks(spark, str(tmp_path / "a.json"))).collect()
    good = sorted((r.asn, r.domain) for r in rows if r.reason is None)
    assert good == [("1", "a.hr"), ("1", "b.hr"), ("2", "c.hr"), ("3", "d.hr")]
    assert sorted(r.value.strip() for r in rows if r.reason == readers.NOT_A_STRING) == ['"2": [nul', "7"]
    (tmp_path / "b.json").write_text('"x.hr", "y.hr"')
    assert {r.reason for r in readers.split_worklist(readers.worklist_chunks(spark, str(tmp_path / "b.json"))).collect()} == {readers.NO_KEY}
    (tmp_path / "r.json").write_text('[{"domain_name": "a.hr", "n": 1}, {"name": "b"},\n {"domain_name": "c.hr"}, {broken}]')
    path = str(tmp_path / "r.json")
    assert sorted(r.domain_name for r in readers.read_domain_registry(spark, path).collect()) == ["a.hr", "c.hr"]
    left = readers.split_registry(spark.read.option("lineSep", "}").text(path)).where("reason is not null").collect()
    assert len(left) == 2
