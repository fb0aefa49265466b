import corpus_pipeline
import __spark_entry__ as entry
from pagesig.llm import mixing, simhash, toxicity
from pagesig.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "mixing", "best_fit_packing"]
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_each_stage_does_its_work(spark, docs, labels):
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, kept, SF), f"test-{name}")
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        if name == "toxicity":
            model = toxicity.fit(docs, labels)
            assert {r["doc_id"] for r in out.collect()} == {i for i, t in before.items() if model.score(t) < toxicity.THRESHOLD}
        elif name == "simhash_near_dedup":
            fps = {i: simhash.fingerprint(t, 4) for i, t in before.items()}
            first = {}
            for i in sorted(fps):
                near = [j for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4]
                first[i] = min(near)
            roots = {i for i in fps if first[i] == i}
            assert {r["doc_id"] for r in out.collect()} <= roots
            assert len(set(fps)) - len({fps[r["doc_id"]] for r in out.collect()}) >= 0
        elif name == "substring_dedup":
            assert {r["doc_id"] for r in out.collect()} == set(before)
            seen = set()
            for r in sorted(out.collect(), key=lambda r: r["doc_id"]):
                own = r["text"].lower().split()
                runs = {tuple(own[k:k + 60]) for k in range(len(own) - 59)}
                assert not runs & seen
                seen |= runs
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mixture(kept).collect()}
            got = {}
            for r in out.collect():
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
                assert r["text"] == before[r["doc_id"]]
            assert got == {i: n for i, n in copies.items() if n}
        else:
            pieces = out.collect()
            assert sum(r["piece"] == 0 for r in pieces) == kept.count()
        kept = out


def test_odd_tables(spark, odd, empty):
    for table in (odd, empty):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            kept = stored(stage(spark, kept, SF), f"odd-{name}")
            assert name == "best_fit_packing" or kept.columns == table.columns
