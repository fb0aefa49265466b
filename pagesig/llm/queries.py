"""Queries of the numbered operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesig.llm.common import documents

# CRC-32 in SQL: the table of its 256 steps, and the fold of a text's UTF-8 bytes over it
CRC_STEPS = """steps AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                              lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes, beside the table `steps`."""
    digit = f"strpos('0123456789ABCDEF', substr(hex(encode({text})), 2 * k + {{}}, 1)) - 1"
    code = f"16 * ({digit.format(1)}) + {digit.format(2)}"
    return (f"xor(list_reduce([4294967295] || list_transform(range(strlen({text})), lambda k: ({code})::BIGINT), "
            f"lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagesig.llm.pack import pack_documents
    return pack_documents(documents(spark, sf_dir)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagesig.llm.simhash import near_duplicates
    return near_duplicates(documents(spark, sf_dir))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagesig.llm.toxicity import fit, scored
    docs = documents(spark, sf_dir)
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op1_mix_sources")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagesig.llm.mixing import mixture
    return mixture(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op3_lm_scoring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagesig.llm.lm import score
    return score(documents(spark, sf_dir))


@query("op6_cws_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagesig.llm.cws import fingerprints
    return fingerprints(documents(spark, sf_dir))


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagesig.llm.quality import fit, scored
    docs = documents(spark, sf_dir)
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op10_one_bit_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagesig.llm.ann import search
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagesig.llm.passages import passages
    return passages(documents(spark, sf_dir))


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagesig.llm.licenses import scan
    return scan(documents(spark, sf_dir))


@query("op11_importance_resampling", rf"""
WITH {CRC_STEPS}, asked AS (
    SELECT 0 AS side, doc_id AS id, row_number() OVER () AS rn, text FROM documents
    UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark),
tokens AS (
    SELECT side, rn, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
    FROM asked),
counts AS (SELECT side, rn, w, count(*) AS n FROM tokens GROUP BY ALL),
hashed AS (SELECT w, {crc_sql("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM counts), steps),
held AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t
    FROM counts JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM held),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (ss + 10000)) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM held, sums),
weighed AS (
    SELECT rn, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
    FROM counts JOIN hashed USING (w) JOIN gain USING (bucket) WHERE side = 0 GROUP BY rn),
scored AS (
    SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT
                                                       + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM asked LEFT JOIN weighed USING (rn) WHERE side = 0),
ranked AS (
    SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (
        PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN place END AS rank
FROM ranked""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagesig.llm.resampling import resample
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_pii")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagesig.llm.pii import report
    return report(documents(spark, sf_dir))


@query("op12_conversation_repair", rf"""
WITH RECURSIVE {CRC_STEPS}, raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
names AS (SELECT name, {crc_sql("name")} % 20 AS damage FROM (SELECT DISTINCT name FROM raw), steps),
damaged AS (
    SELECT conv_id, turn, role0, text0, CASE damage WHEN 4 THEN 'user' ELSE role0 END AS role,
           CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text,
           unnest(range(CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM raw JOIN names USING (name)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, text0) AS pos FROM damaged)),
turns AS (
    SELECT conv_id, turn, pos, role, text, left(role, 1) AS initial, CASE
        WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'fine' END AS fault FROM placed),
-- states: 0 nothing yet, 1 system, 2 user, 3 assistant; steps of one row, and of insertions before it
moves(state, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
inserted(state, letters, after, cost, lines) AS (
    VALUES (0, '', 0, 0, ''), (1, '', 1, 0, ''), (2, '', 2, 0, ''), (3, '', 3, 0, ''),
           (0, 'I', 2, 5, chr(10) || 'user:'), (1, 'I', 2, 5, chr(10) || 'user:'), (3, 'I', 2, 5, chr(10) || 'user:'),
           (2, 'I', 3, 5, chr(10) || 'assistant:'), (0, 'II', 3, 10, chr(10) || 'user:' || chr(10) || 'assistant:'),
           (1, 'II', 3, 10, chr(10) || 'user:' || chr(10) || 'assistant:'), (3, 'II', 3, 10, chr(10) || 'user:' || chr(10) || 'assistant:'),
           (2, 'II', 2, 10, chr(10) || 'assistant:' || chr(10) || 'user:')),
edits AS (
    SELECT conv_id, pos, state, 'D' AS letter, state AS after, 2 AS cost, '' AS line FROM turns, range(4) s(state)
    UNION ALL
    SELECT conv_id, pos, m.state, 'K', m.after, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, chr(10) || role || ':' || text
    FROM turns t JOIN moves m ON t.initial = m.initial WHERE fault IN ('truncated', 'fine')
    UNION ALL
    SELECT conv_id, pos, m.state, 'R', m.after, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END,
           chr(10) || CASE m.initial WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text
    FROM turns t JOIN moves m ON m.initial <> 's' WHERE fault IN ('truncated', 'fine')),
best AS (
    SELECT conv_id, 0::BIGINT AS pos, 0 AS state, '000000000' AS ranked, '' AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT b.conv_id, e.pos, e.after, min(lpad((left(ranked, 9)::INT + i.cost + e.cost)::VARCHAR, 9, '0') || substr(ranked, 10) || letters || letter),
           arg_min(b.lines || i.lines || e.line,
                   lpad((left(ranked, 9)::INT + i.cost + e.cost)::VARCHAR, 9, '0') || substr(ranked, 10) || letters || letter)
    FROM best b JOIN inserted i ON i.state = b.state
         JOIN edits e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.pos = b.pos + 1 AND e.state = i.after
    GROUP BY b.conv_id, e.pos, e.after),
ends AS (
    SELECT b.conv_id, min(lpad((left(ranked, 9)::INT + i.cost)::VARCHAR, 9, '0') || substr(ranked, 10) || letters) AS ranked,
           arg_min(b.lines || i.lines, lpad((left(ranked, 9)::INT + i.cost)::VARCHAR, 9, '0') || substr(ranked, 10) || letters) AS lines
    FROM best b JOIN inserted i ON i.state = b.state
    WHERE i.after IN (0, 3) AND b.pos = (SELECT count(*) FROM turns t WHERE t.conv_id IS NOT DISTINCT FROM b.conv_id)
    GROUP BY b.conv_id),
pairs AS (SELECT conv_id, initial, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before, turn, fault FROM turns),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM pairs GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, left(ranked, 9)::BIGINT AS cost,
       substr(ranked, 10) AS audit, sha256(substr(lines, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagesig.llm.conversations import repair
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
