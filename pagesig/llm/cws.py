"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Terms are a text's words (lower case), weighted by how often they occur. For sample k each term
draws, from a hash of (term, k), r and c from Gamma(2, 1) and b from the uniform distribution;
with t = floor(ln(weight) / r + b) the term's value is ln c - r (t - b) - r, and the sample is
the smallest value of all terms. Two texts have the same sample with a probability equal to the
generalised Jaccard similarity of their weights, as a value depends on (term, k, t) alone; the
fingerprint keeps 16 bits of a hash of each smallest value, and the likeness of two fingerprints
is the share of equal samples.

Plan. Documents are dealt by ranges of doc_id into buckets of a few thousand rows (cut points
from approximate quantiles; their number is bounded), and the first row of each bucket is also
sent to the bucket before it. That one exchange of texts serves everything: the next document
is `lead` within the bucket, and the aggregates are keyed by the bucket and more columns, so they
need no further exchange. A document's words are counted within its row (sorted hashes, run
lengths), so no task holds the terms of more than one document at a time.

Defined cases: a null text is an empty one; a text without words has the all-zero fingerprint
(likeness 1 to another one, 0 to the rest); repeated rows are each other's next document, in
the order of their texts; a null doc_id sorts first; the only document is its own next; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesig.llm.common import doc_columns

SAMPLES = 48
GROUP = 8
BUCKET_ROWS = 2000
MAX_BUCKETS = 20_000
SPACES = r"[\x20\x09-\x0D]+"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row, however often lambdas refer to it (a
    generated column is not inlined into later expressions)."""
    return df.withColumn(name, F.explode(F.array(value)))


def term_weights(df: DataFrame, text: str) -> DataFrame:
    """One row per distinct term of each row's text: adds `term` (a hash) and `weight`; a row
    without terms stays, with nulls."""
    words = F.filter(F.split(F.lower(F.col(text)), SPACES), lambda w: w != "")
    df = once(df, "_s", F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))).drop(text)
    size = F.size("_s")
    counts = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    df = once(df, "_e", F.filter(counts, lambda i: (i == size) | (F.get("_s", i) != F.get("_s", i - 1))))
    runs = F.transform("_e", lambda e, j: F.struct(
        F.get("_s", e - 1).alias("term"), (e - F.coalesce(F.get("_e", j - 1), F.lit(0))).alias("weight")))
    df = df.withColumn("_r", F.explode_outer(runs)).drop("_s", "_e")
    return df.withColumns({"term": F.col("_r.term"), "weight": F.col("_r.weight")}).drop("_r")


def draw(k: int) -> Column:
    """The value of a row's term in sample k of the row's group."""
    h = F.xxhash64("term", "group", F.lit(k))

    def u(i: int) -> Column:
        return (F.shiftrightunsigned(h, 12 * i).bitwiseAND(F.lit(4095)) + 0.5) / 4096.0

    r = -F.log(u(0) * u(1))
    b = F.shiftrightunsigned(h, 48) / 65536.0
    t = F.floor(F.col("ln_weight") / r + b)
    return F.log(-F.log(u(2) * u(3))) - r * (t - b) - r


def signatures(df: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """(keys, sig): the fingerprint, as an array of 16-bit numbers, of each row's text.

    Samples are drawn `GROUP` at a time (one row per term and group), so that the generated
    aggregation code stays small enough to be compiled."""
    terms = term_weights(df.select(*keys, text), text).withColumn("ln_weight", F.log("weight"))
    grouped = terms.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(samples // GROUP - 1))))
    least = grouped.groupBy(*keys, "group").agg(*[F.min(draw(k)).alias(f"m{k}") for k in range(GROUP)])
    bits = F.array(*[F.coalesce(F.xxhash64(F.col(f"m{k}")).bitwiseAND(F.lit(0xFFFF)) * F.col(f"m{k}").isNotNull().cast("long"),
                                F.lit(0)).cast("int") for k in range(GROUP)])
    parts = least.select(*keys, F.struct("group", bits.alias("bits")).alias("part"))
    whole = parts.groupBy(*keys).agg(F.sort_array(F.collect_list("part")).alias("parts"))  # samples / GROUP parts
    return whole.select(*keys, F.flatten(F.transform("parts", lambda p: p["bits"])).alias("sig"))


def likeness(a: str, b: str) -> Column:
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.size(a).cast("double")


def as_text(sig: str) -> Column:
    return F.lower(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x.cast("long")), 4, "0")), ""))


def range_bucket(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cut points lie below a value, by a search in two levels."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    top = F.size(F.filter(F.lit([g[-1] for g in groups]), lambda c: c < value))
    fine = F.get(F.array(*[F.lit(g) for g in groups]), F.least(top, F.lit(len(groups) - 1)))
    return F.when(top >= len(groups), len(cuts)).otherwise(
        top * step + F.size(F.filter(fine, lambda c: c < value)))


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(bucket, rank, guest, doc_id, text, next): documents in doc_id order with the next one's
    text; guests are the first rows of the following buckets."""
    rows = doc_columns(docs, "doc_id", "text").select(
        F.coalesce("doc_id", F.lit(-1 << 63)).alias("order"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    buckets = min(MAX_BUCKETS, -(-docs.count() // bucket_rows))
    cuts: list[int] = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        cuts = sorted(set(rows.agg(F.percentile_approx("order", shares, 20 * buckets)).first()[0]))
    rows = rows.withColumn("bucket", range_bucket(F.col("order"), cuts).cast("int"))
    firsts = rows.groupBy("bucket").agg(F.min("order").alias("order"))  # at most MAX_BUCKETS rows
    every = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(every), F.max("bucket").over(Window.partitionBy()))
    firsts = F.broadcast(firsts.withColumn("to", before))
    guests = rows.join(firsts, ["bucket", "order"]).groupBy("to", "order", "doc_id").agg(F.min("text").alias("text"))
    both = rows.select("bucket", "order", "doc_id", "text", F.lit(False).alias("guest")).unionByName(
        guests.select(F.col("to").alias("bucket"), "order", "doc_id", "text", F.lit(True).alias("guest")))
    inside = Window.partitionBy("bucket").orderBy("guest", "order", "text")
    return both.select("bucket", F.row_number().over(inside).alias("rank"), "guest", "doc_id", "text",
                       F.lead("text").over(inside).alias("next"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next):
    every document, the text edited by its next document, and their likenesses."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half),
                      F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = once(rows, "edited", edited).withColumn("edited_sha256", F.unhex(F.sha2("edited", 256)))
    keys = ["bucket", "rank", "which", "guest", "doc_id", "n_chars", "edited_sha256"]
    texts = rows.select("*", F.posexplode(F.array("text", "edited")).alias("which", "each"))
    sigs = signatures(texts, keys, "each", samples)
    order = Window.partitionBy("bucket").orderBy("rank", "which")
    sigs = sigs.select(*keys, "sig", F.lead("sig", 1).over(order).alias("edited_sig"), F.lead("sig", 2).over(order).alias("next_sig"))
    return sigs.filter("which = 0 and not guest").select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), as_text("sig").alias("fingerprint"),
        as_text("edited_sig").alias("edited_fingerprint"), likeness("sig", "edited_sig").alias("near_edited"),
        likeness("sig", "next_sig").alias("near_next"))
