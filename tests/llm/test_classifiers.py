import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagesig.llm import quality, toxicity
from pagesig.llm import textbytes as tb

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def medium(spark):
    return spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")


def test_quality_on_held_out_rows(medium):
    docs, labels = medium
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.scored(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    good = [r["score"] for r in held if marks[r["doc_id"]] == 1]
    bad = [r["score"] for r in held if marks[r["doc_id"]] == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in held) / len(held) > 0.9


def test_toxicity_on_held_out_rows(medium):
    docs, labels = medium
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs, model).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    found = [marks[r["doc_id"]] for r in held if r["predicted"]]
    assert sum(found) / len(found) > 0.7 and sum(found) / sum(marks[r["doc_id"]] for r in held) > 0.7
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)


def test_folding():
    assert toxicity.folded("You 1D10T, іdiot! ST​UP­ID！") == " you idiot idiot stupid "
    assert toxicity.folded(None) == " " and toxicity.folded("wow!! cash$$$ a@b") == " wow cash aab "


def test_exception_phrases_and_longest_entries():
    model = toxicity.Lexicon({"tra": 1.0, "trash": 3.0, "clown": 2.0}, ["trash can", "class clown"], 0.05)
    assert sum(model.hits(toxicity.folded("Trash! the trash can, a class clown")).values()) == 3.0
    assert model.score("") == 0.0 and model.score(None) == 0.0
    assert model.score("you trash clown") > 0.7 > model.score("trash " + "word " * 500)


def test_stems_chosen_by_gain():
    stats = [("low", 40, 30), ("lowe", 40, 0), ("lowei", 40, 0), ("loweis", 20, 0), ("the", 500, 5000), ("rare", 1, 0)]
    chosen = toxicity.choose(stats, {1: 10_000, 0: 100_000})
    assert set(chosen) == {"lowei"}


def test_every_stem_with_gain_is_chosen():
    stats = [(f"{a}{b}{c}x", 40, 0) for a in "abcdefghij" for b in "abcdefghij" for c in "abcdef"]
    assert set(toxicity.choose(stats, {1: 60_000, 0: 100_000})) == {s for s, _, _ in stats}


def test_lexicon_of_many_stems(spark):
    codes = [f"q{a}{b}z" for a in "abcdefghijklmnopqrstuvwxy" for b in "abcdefghijklmnopqrstuvwxy"]
    rows = [(i, " ".join(codes[(5 * i + k) % len(codes)] for k in range(10)) + f" w{i}") for i in range(3000)]
    rows += [(5000 + i, f"plain words number here and there w{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "int(doc_id < 5000) toxic"))
    assert all(any(code.startswith(e) for e in model.entries) for code in codes)


def test_odd_rows(odd, empty, labels, medium):
    none = labels.limit(0)
    for model, module in ((toxicity.fit(odd, none), toxicity), (quality.fit(odd, none), quality)):
        rows = module.scored(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 7}) == 1
        assert module.scored(empty, model).collect() == []
    model = quality.fit(*medium)
    assert all(0 <= r["score"] <= 1 for r in quality.scored(odd, model).collect())


def naive_hits(model, text):
    """Weights by position, by looking for every entry and phrase at every place."""
    best = {}
    for stem in sorted(model.entries, key=len):
        for at in range(len(text)):
            if text.startswith(f" {stem}", at):
                best[at] = model.entries[stem]
    for phrase in model.phrases:
        for at in range(len(text)):
            if text.startswith(f" {phrase} ", at):
                best = {p: w for p, w in best.items() if not at <= p < at + len(phrase) + 1}
    return best


def test_lexicon_hits_match_a_naive_search(docs, labels):
    model = toxicity.fit(docs, labels)
    texts = [r["text"][:1500] for r in docs.limit(40).collect()]
    texts += ["trash can trash cans TRASH trash", "a m0r0n and a clown fish, cl0wn", "tras​h", "", "idiotidiot idiots!!", "sore loser loser"]
    found = 0
    for text in texts:
        plain = toxicity.folded(text)
        assert model.hits(plain) == naive_hits(model, plain)
        found += len(model.hits(plain))
    assert found >= 5


def plain_features(text):
    """{feature: value} of one text, token by token."""
    runs = re.findall(r"[!-/:-@\[-`{-~]+|[^\t-\r !-/:-@\[-`{-~]+", text)
    def code(s):
        raw = np.frombuffer(s.encode(), np.uint8)
        return int(tb.run_hashes(raw, np.array([0]), np.array([len(raw)]))[0])
    def mixed(x):
        return int(tb.mix(np.array([x % 2 ** 64], np.uint64))[0]) >> (64 - quality.BITS)
    lower = [r.translate({c: c + 32 for c in range(65, 91)}) for r in runs]
    codes, same = [], []
    for k, token in enumerate(lower):
        same.append(k > 0 and lower[k - 1] == token)
        codes.append(int(quality._REPEAT) if same[-1] else code(token))
    times = Counter(mixed(c) for c in codes)
    times.update(mixed(a * int(quality._MULT) + b) for a, b in zip(codes, codes[1:]))
    size = math.sqrt(sum(times.values()))
    out = {k: math.sqrt(n) / size for k, n in times.items()}
    words = [not re.match(r"[!-/:-@\[-`{-~]", r) for r in runs]
    marks = (same, [w and sum("A" <= c <= "Z" for c in r) > 1 for r, w in zip(runs, words)], [not w for w in words])
    extra = []
    for n, mark in enumerate(marks):
        if sum(mark):
            step = int(np.round(np.log2(sum(mark) / len(runs)) * 2))
            extra.append(mixed(((n + 1) << 32) + step + 1000))
    return sorted(out.items()), sorted(extra)


def test_features_match_plain_loops(docs):
    texts = [r["text"][:800] for r in docs.limit(20).collect()] + ["", "  ", "a a a A!! !! B-C", "ÜBER über ##", "X"]
    raw, off = tb.buffers(pa.array(texts))
    at, key, value = quality.features(raw, off)
    for i, text in enumerate(texts):
        mine, (want, extra) = [(int(k), float(v)) for k, v in zip(key[at == i], value[at == i])], plain_features(text)
        tail = len(mine) - len(extra)
        assert [k for k, _ in mine[:tail]] == [k for k, _ in want]
        assert np.allclose([v for _, v in mine[:tail]], [v for _, v in want])
        assert sorted(k for k, _ in mine[tail:]) == extra and all(v == 0.5 for _, v in mine[tail:])


def test_training_matches_updates_one_coordinate_at_a_time():
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(60):
        keys = np.sort(rng.choice(64, rng.integers(0, 9), replace=False)).astype(np.int32)
        rows.append((int(rng.integers(0, 2)), keys, rng.random(len(keys)).astype(np.float32)))
    weights, bias = quality.train(rows, bits=6)
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for label, keys, values in rows:
            x = {**{int(k): float(v) for k, v in zip(keys, values)}, 64: 1.0}
            w = {i: weight(i) for i in x}
            slope = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x))) - label
            for i in x:
                g = slope * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    assert np.allclose(weights, [weight(i) for i in range(64)], atol=1e-6) and abs(bias - weight(64)) < 1e-6
