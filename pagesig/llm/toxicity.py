"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding: compatibility forms, look-alike letters of other alphabets, zero-width characters and
digit or sign substitutions go to the plain lower-case letters they stand for; everything that
is not a letter becomes one space. Lexicon entries are word beginnings (a space and a stem), so
one entry covers a word's inflections; a longer entry wins over a shorter one in the same word.
Hits inside an exception phrase do not count. A text's rate is the weight of its hits over its
number of words (plus a constant, so that one hit in a tiny text is weak evidence), and its score
is a monotone function of the rate that reaches the decision threshold at the rate which
separates the labelled rows best.

Learning (all of it from labelled rows outside the held-out fold): stems and weights come from
how often words begin with them in toxic and in clean rows; exception phrases are word pairs
around hits that clean rows repeat and toxic rows never have. The fit uses at most
`FIT_ROWS` labelled rows per class, in hash order; nothing but the fit is sampled. Labels, lang,
source and ids are no inputs of a score.

Defined cases: null and empty texts score 0; with no labelled rows the built-in seed lexicon is
used with its default weight; repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesig.llm.common import doc_columns, fold_of, small_batches, stored

FIT_ROWS = 6000
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
STEM = (3, 12)  # shortest and longest stem, in letters
LEAST_DOCS = 4
LEAST_WEIGHT = 2.0  # log of the occurrence ratio, toxic over clean
LEAST_GAIN = 15.0  # log-likelihood ratio statistic
EXTRA_WORDS = 15.0
SEED_WEIGHT = 3.0

# Seed lexicon (stems) and exception phrases of everyday English
SEED = ["idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "clown"]
PHRASES = ["trash can", "trash cans", "trash bin", "trash bag", "trash collection", "clown fish", "sore loser"]

# Characters that stand for a Latin letter
LOOKALIKES = {
    "а": "a", "ɑ": "a", "α": "a", "в": "b", "β": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "є": "e", "ε": "e",
    "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ι": "i", "ı": "i", "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "м": "m",
    "п": "n", "о": "o", "ο": "o", "σ": "o", "р": "p", "ρ": "p", "ԛ": "q", "ѕ": "s", "т": "t", "τ": "t", "υ": "u",
    "ц": "u", "ν": "v", "ѵ": "v", "ш": "w", "ѡ": "w", "ω": "w", "х": "x", "χ": "x", "у": "y", "γ": "y",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
}
ZERO_WIDTH = "".join(map(chr, [0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]))

_FOLD = str.maketrans(LOOKALIKES | dict.fromkeys(ZERO_WIDTH, ""))
_LETTERS = re.compile(r"[\W\d_]+")
# signs and digits after a word's last letter are punctuation, not letters
_TAIL = re.compile(r"(?<=\w)[@$!]+(?!\w)")


def folded(text: str | None) -> str:
    """Lower-case folded words, each between single spaces."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "!" in text or "$" in text or "@" in text:
        text = _TAIL.sub(" ", text)
    return f" {_LETTERS.sub(' ', text.translate(_FOLD)).strip()} "


@dataclass
class Lexicon:
    """Entries (stem -> weight), exception phrases and the separating rate."""
    entries: dict[str, float]
    phrases: list[str] = field(default_factory=list)
    rate: float = 0.05
    _matcher: object = None

    def __getstate__(self):
        return {"entries": self.entries, "phrases": self.phrases, "rate": self.rate, "_matcher": None}

    def matcher(self):
        if self._matcher is None:
            import ahocorasick
            found = ahocorasick.Automaton()
            for stem, weight in self.entries.items():
                found.add_word(f" {stem}", (len(stem) + 1, weight))
            for phrase in self.phrases:
                found.add_word(f" {phrase} ", (len(phrase) + 2, None))
            if len(found):
                found.make_automaton()
            self._matcher = found
        return self._matcher

    def hits(self, text: str) -> dict[int, float]:
        """Weight by position of every entry that counts in a folded text."""
        found, excused, best = self.matcher(), [], {}
        if not len(found):
            return best
        for end, (size, weight) in found.iter(text):
            start = end - size + 1
            if weight is None:
                excused.append((start, end))
            else:
                best[start] = weight  # of one start, the longest entry comes last
        for start, end in excused:
            for at in [p for p in best if start <= p < end]:
                del best[at]
        return best

    def text_rate(self, text: str | None) -> float:
        text = folded(text)
        return sum(self.hits(text).values()) / (max(0, text.count(" ") - 1) + EXTRA_WORDS)

    def score(self, text: str | None) -> float:
        rate = self.text_rate(text)
        return rate / (rate + self.rate * (1 - THRESHOLD) / THRESHOLD) if rate > 0 else 0.0


def gain(a: float, b: float, total_a: float, total_b: float) -> float:
    """Log-likelihood ratio statistic of counts a of total_a against b of total_b."""
    both = (a + b) / (total_a + total_b)
    g = 0.0
    for k, n in ((a, total_a), (b, total_b)):
        if k > 0:
            g += k * math.log(k / (n * both))
        if n > k:
            g += (n - k) * math.log((n - k) / (n * (1 - both)))
    return 2 * g


def choose(stats: list[tuple[str, int, int]], words: dict[int, int]) -> dict[str, float]:
    """Entries from (stem, occurrences in toxic, in clean): best gain first, of equal gain the
    longer; nothing below an entry already chosen, and a shorter stem only for what the chosen
    entries below it leave."""
    toxic, clean = max(1, words.get(1, 0)), max(1, words.get(0, 0))

    def weight(t: float, c: float) -> float:
        return math.log(((t + 0.5) / toxic) / ((c + 0.5) / clean))

    own = {s: (t, c) for s, t, c in stats}
    ranked = sorted(((gain(t, c, toxic, clean), len(s), s) for s, t, c in stats if weight(t, c) >= LEAST_WEIGHT),
                    reverse=True)
    chosen: dict[str, float] = {}
    taken: dict[str, tuple[int, int]] = {}  # by beginning: occurrences of the chosen entries below it
    for g, _, stem in ranked:
        if g < LEAST_GAIN:
            break
        if any(stem[:size] in chosen for size in range(1, len(stem) + 1)):
            continue
        below = taken.get(stem)
        t, c = (n - x for n, x in zip(own[stem], below or (0, 0)))
        if not below or (t > 0 and weight(t, max(c, 0)) >= LEAST_WEIGHT and gain(t, max(c, 0), toxic, clean) >= LEAST_GAIN):
            chosen[stem] = weight(t, max(c, 0))
            for size in range(1, len(stem) + 1):
                before = taken.get(stem[:size], (0, 0))
                taken[stem[:size]] = (before[0] + own[stem][0], before[1] + own[stem][1])
    return chosen


def fit_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """(label, text): at most `rows` labelled documents per class outside the held-out fold, in
    hash order, different texts only; stored. The labels' side is bounded, so texts do not move."""
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label"))
    own = own.filter((fold_of(F.col("_id"), folds) != held_out) & F.col("_id").isNotNull()).distinct()
    picked = [own.filter(F.col("label") == k).orderBy(F.xxhash64("_id"), "_id").limit(rows) for k in (0, 1)]
    texts = doc_columns(docs, "doc_id", "text")
    found = texts.join(F.broadcast(picked[0].union(picked[1])), F.col("doc_id") == F.col("_id"))
    return stored(found.select("label", "text").dropDuplicates(), "fit")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Lexicon:
    rows = fit_rows(docs, labels, label, FOLDS, HELD_OUT, FIT_ROWS)
    low, high = STEM

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        occurs, holds, total = Counter(), Counter(), Counter()
        for batch in batches:
            for k, text in zip(batch["label"], batch["text"]):
                words = Counter(folded(text).split())
                total[k] += sum(words.values())
                own = Counter()
                for word, n in words.items():
                    for size in range(low, min(high, len(word)) + 1):
                        own[word[:size]] += n
                for stem, n in own.items():
                    occurs[stem, k] += n
                    holds[stem, k] += 1
        yield pd.DataFrame([(s, int(k), n, holds[s, k]) for (s, k), n in occurs.items()]
                           + [("", int(k), n, 0) for k, n in total.items()],
                           columns=["stem", "label", "occurs", "docs"])

    counted = rows.mapInPandas(count, "stem string, label int, occurs long, docs long")
    toxic = F.col("label") == 1
    stats = counted.groupBy("stem").agg(
        F.sum(F.when(toxic, F.col("occurs")).otherwise(0)).alias("t"),
        F.sum(F.when(toxic, F.lit(0)).otherwise(F.col("occurs"))).alias("c"),
        F.sum(F.when(toxic, F.col("docs")).otherwise(0)).alias("docs"))
    stats = stored(stats.filter(F.col("stem").isin("", *SEED) | (F.col("docs") >= LEAST_DOCS)), "stems")
    total = stats.filter("stem = ''").first()
    words = {1: total["t"], 0: total["c"]} if total else {}
    ratio = F.log((F.col("t") + 0.5) / (F.col("c") + 0.5)) - math.log(max(1, words.get(1, 0)) / max(1, words.get(0, 0)))
    # bounded by the fit rows; a little below the least weight, `choose` decides
    best = stats.filter("stem <> ''").filter(F.col("stem").isin(SEED) | (ratio >= LEAST_WEIGHT - 0.01)).collect()
    entries = choose([(r["stem"], r["t"], r["c"]) for r in best], words)
    seen = {r["stem"] for r in best}
    for stem in SEED:
        if stem not in seen and not any(stem.startswith(e) for e in entries):
            entries[stem] = SEED_WEIGHT
    model = Lexicon(entries, list(PHRASES))

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = Counter()
        for batch in batches:
            for k, text in zip(batch["label"], batch["text"]):
                text, own = folded(text), set()
                for at in model.hits(text):
                    end = text.index(" ", at + 1)
                    word, after = text[at + 1:end], text[end + 1:].partition(" ")[0]
                    before = text[:at].rpartition(" ")[2]
                    own |= {f"{before} {word}"} if before else set()
                    own |= {f"{word} {after}"} if after else set()
                pairs.update((p, int(k)) for p in own)
        yield pd.DataFrame([(p, k, n) for (p, k), n in pairs.items()], columns=["phrase", "label", "docs"])

    clean = rows.mapInPandas(around, "phrase string, label int, docs long").groupBy("phrase").agg(
        F.sum(F.when(F.col("label") == 0, F.col("docs")).otherwise(0)).alias("c"),
        F.sum(F.when(F.col("label") == 1, F.col("docs")).otherwise(0)).alias("t"))
    clean = clean.filter(f"c >= {LEAST_DOCS} and t = 0").collect()  # bounded by the fit rows
    model = Lexicon(entries, sorted({*PHRASES, *(r["phrase"] for r in clean)}))

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series([model.text_rate(t) for t in texts], dtype=float)

    rates = rows.select("label", rate("text").alias("rate")).toPandas()  # bounded by the fit rows
    model.rate = separating([r for r, k in zip(rates["rate"], rates["label"]) if k == 1],
                            [r for r, k in zip(rates["rate"], rates["label"]) if k == 0], model.rate)
    return model


def separating(toxic: list[float], clean: list[float], default: float) -> float:
    """The rate with the best F1 (clean rows weighted to be nine times as many), in the middle of
    the gap it lies in."""
    if not toxic or not clean:
        return default
    levels = np.unique([r for r in toxic if r > 0])
    if not len(levels):
        return default
    t, c = np.sort(toxic), np.sort(clean)
    found = len(t) - np.searchsorted(t, levels)
    false = (len(c) - np.searchsorted(c, levels)) * (9 * len(t) / len(c))
    f1 = 2 * found / (len(t) + found + false)
    at = levels[int(np.argmax(f1))]
    below = max([r for r in toxic + clean if r < at], default=0.0)
    return float(math.sqrt(at * max(below, at / 4)))


def score(text: Column, model: Lexicon) -> Column:
    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return toxicity(text.cast("string"))


def scored(docs: DataFrame, model: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document."""
    out = doc_columns(docs, "doc_id", "text").select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, model: Lexicon) -> DataFrame:
    """The rows of `docs`, all columns, that are not predicted toxic."""
    small_batches(docs.sparkSession)
    return docs.filter(score(F.col("text"), model) < THRESHOLD)
