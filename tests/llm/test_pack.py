import zlib

import numpy as np
import pytest

from pagesig.llm import pack


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(tokenizer, text):
    ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
    first = len(ids) % 1024 or 1024
    edges = [0, *range(first, len(ids) + 1, 1024)]
    return [(p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(edges, edges[1:]))]


def check_places(rows):
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(seqs)


def test_pieces_match_the_tokenizers_library(docs, odd, tokenizer):
    for table in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        want = sorted((-1 if r["doc_id"] is None else r["doc_id"], *p) for r in table.collect() for p in expected(tokenizer, r["text"]))
        rows = pack.pack_documents(table).collect()
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
        assert got == want
        total = sum(r["length"] for r in rows)
        sequences = check_places(rows)
        assert -(-total // 1024) <= sequences <= -(-total // 1024) * 1.05 + 2


def test_ids_survive_the_round_trip(docs, tokenizer):
    rows = pack.pieces(docs.limit(20), with_ids=True).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.limit(20).collect()}
    for i, text in texts.items():
        ids = [x for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"]) for x in r["ids"]]
        assert ids[-1] == 2 and tokenizer.decode(ids[:-1], skip_special_tokens=False) == text


def first_fit(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            best = min(fits)
            gaps[gaps.index(best)] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_sweep_packs_as_well_as_piecewise_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 300)).tolist()
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = pack.sweep(counts, 100)
        fill = {}
        for length, _, number, seq, offset in sorted(plan, key=lambda p: p[4]):
            for s in range(seq, seq + number):
                assert fill.get(s, 0) == offset
                fill[s] = offset + length
        assert max(fill.values()) <= 100 and sum(fill.values()) == sum(lengths)
        assert len(fill) <= first_fit(lengths, 100)


def test_wide_spaces_are_encoded_as_one_text(spark, tokenizer):
    texts = ["a \n b", "a 　 b ", "a  b \n\n c\u0085 d", "tail  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids_crc32"] for r in pack.pieces(df).collect()}
    assert got == {i: expected(tokenizer, t)[0][3] for i, t in enumerate(texts)}


def test_empty(empty):
    assert pack.pack_documents(empty).collect() == []


def test_added_tokens_are_honoured(spark, tokenizer):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> <|endoftext|><|endoftext|>\ny", "<|endoftext|", "<|<|endoftext|>endoftext|>",
             "é　<|endoftext|> 　 z", "<|ENDOFTEXT|>", "word " * 900 + "<|endoftext|>" * 300, "clean"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pack.pieces(df).collect())
    assert got == sorted((i, *p) for i, t in enumerate(texts) for p in expected(tokenizer, t))
    assert pack.pieces(df.limit(1), with_ids=True).first()["ids"] == [64, 50256, 65, 2]
    assert 50256 not in pack.pieces(df.limit(1), with_ids=True, added={}).first()["ids"]


def test_equal_and_missing_ids_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(pack, "BLOCK_ROWS", 16)
    df = spark.createDataFrame([(None, "same text")] * 400 + [(5, "same text")] * 300 + [(6, "other")] * 5, "doc_id long, text string").repartition(6)
    rows = pack.pack_documents(df).collect()
    assert len(rows) == 705 and "_row" not in pack.pack_documents(df).columns
    assert check_places(rows) <= -(-sum(r["length"] for r in rows) // 1024) + 1


def test_a_worker_keeps_little_of_the_words_it_encoded(tokenizer):
    import tracemalloc

    import pyarrow as pa

    from pagesig.llm import textbytes as tb
    enc = pack.WordEncoder(pack.vocabulary(), pack.added_tokens())
    texts = [" ".join(f"w{i * 7919 + k:x}" for k in range(2000)) for i in range(80)] + ["long " + "ab" * 500 + " tail  end"]

    def ids(text):
        [(_, _, raw, off)] = tb.text_slices(pa.array([text]))
        return enc.slice_ids(raw, off)[0].tolist()

    first = [ids(t) for t in texts[-3:]]
    tracemalloc.start()
    for text in texts:
        ids(text)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 10_000_000  # 160,000 words
    enc.forget()
    assert first == [ids(t) for t in texts[-3:]] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[-3:]]
