"""Registered queries: learned signature library, similarity, greedy scoring, verdicts.

The scan family runs over all orders with the library that induction learns from them; its oracles
score every content against every signature class. LCS over the paragraphs of whole web pages
has no practical DuckDB form, so `mt_verdict_pages` is checked against exhaustive Python scoring
in tests.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagesig.functions import similarity as S
from pagesig.operators import extract as X
from pagesig.operators import match as M
from pagesig.plans import oracle_induction as oi
from pagesig.plans.queries_extract import TEXTS_CTE, _DECODE
from pagesig.plans.registry import register
from pagesig.plans.scan import learned_library
from pagesig.session import reuse
from pagesig.sources import corpora


def fuzzy_hash_sql(table: str, code: str, value: str, where: str = "true") -> str:
    """CTEs ending in hashes (code, hash): the piecewise hash of a column's UTF-8 bytes. The rolling
    value after each byte comes from the last seven bytes, the block size is the largest one of the
    halving chain with 32 pieces (or 3), and a piece is folded byte by byte (six bits matter)."""
    digit = "strpos('0123456789ABCDEF', substr(hx, 2 * k + {}, 1)) - 1"
    back = "CASE WHEN i > {0} THEN c[i - {0}] ELSE 0 END"
    b64 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/'"

    def pieces(cuts: str, most: int) -> str:
        ends = f"{cuts}[1:{most}]"
        return (f"array_to_string(list_transform(range(1, len({ends}) + 1), lambda q: substr({b64}, list_reduce("
                f"c[coalesce({ends}[q - 1], 0) + 1:{ends}[q]], lambda x, y: xor((x * 19) % 64, y % 64), 39) + 1, 1)), '') "
                f"|| CASE WHEN n > 0 AND rolls[n] <> 0 THEN substr({b64}, list_reduce(c[coalesce({ends}[len({ends})], 0) + 1:n], "
                f"lambda x, y: xor((x * 19) % 64, y % 64), 39) + 1, 1) ELSE '' END")

    return f"""
fz0 AS (SELECT {code} AS code, hex(encode({value})) AS hx FROM {table} WHERE {where}),
fz1 AS (SELECT code, list_transform(range(len(hx) // 2), lambda k: (16 * ({digit.format(1)}) + {digit.format(2)})::BIGINT) AS c FROM fz0),
fz2 AS (SELECT code, c, len(c) AS n, list_transform(range(1, len(c) + 1), lambda i: (
    {' + '.join(f"{8 - j} * ({back.format(j)})" for j in range(7))}
    + {"xor(" * 6}(c[i]){"".join(f", (({back.format(j)}) << {5 * j}) & 4294967295)" for j in range(1, 7))}) & 4294967295) AS rolls FROM fz1),
fz3 AS (SELECT *, list_max(list_filter(list_transform(range(0, 40), lambda e: 3 * (1::BIGINT << e)),
             lambda bs: (bs = 3 OR bs // 2 * 64 < n) AND (bs = 3 OR len(list_filter(rolls, lambda r: r % bs = bs - 1)) >= 32))) AS bs FROM fz2),
fz4 AS (SELECT *, list_filter(range(1, n + 1), lambda i: rolls[i] % bs = bs - 1) AS cuts,
             list_filter(range(1, n + 1), lambda i: rolls[i] % (2 * bs) = 2 * bs - 1) AS halves FROM fz3),
hashes AS (SELECT code, bs || ':' || {pieces("cuts", 63)} || ':' || {pieces("halves", 31)} AS hash FROM fz4)"""


TAGGED_CTES = f"""
tc AS (
  SELECT page_id,
         regexp_replace(regexp_replace(regexp_replace(html,
           '(?s)<script[^>]*>.*?</script\\s*>', '<x>', 'g'),
           '(?s)<style[^>]*>.*?</style\\s*>', '<x>', 'g'),
           '(?s)<!--.*?-->', '<x>', 'g') AS h
  FROM pages),
tp AS (SELECT page_id, string_split(h, '<') AS arr FROM tc),
tn AS (SELECT page_id, unnest(arr) AS piece, unnest(range(len(arr))) AS i FROM tp),
tt AS (
  SELECT page_id, i,
         CASE WHEN i = 0 THEN NULL ELSE nullif(lower(regexp_extract(piece, '^([A-Za-z][A-Za-z0-9]*)', 1)), '') END AS tag,
         CASE WHEN i = 0 THEN piece ELSE regexp_extract(piece, '(?s)^[^>]*>(.*)$', 1) END AS raw0
  FROM tn),
tdec AS (SELECT page_id, i, tag, regexp_replace({_DECODE.replace('raw', 'raw0', 1)}, '&amp;?', '&', 'g') AS value
         FROM tt),
tagged AS (
  SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos, tag, value
  FROM tdec WHERE NOT regexp_full_match(value, '\\s*'))"""


# ---------------------------------------------------------------- all orders against the learned library
# The oracle scores every content against every class, without any bound: signatures from the
# induction's own oracle, LCS as a row-by-row table, greedy as a fold over the full matrix.

_LABEL = "brand || ' ' || sha256(brand)"
_LCS_FOLD = """list_reduce(string_split(x.cmp, ''), lambda row, ch: list_transform(range(len(yb) + 1), lambda j:
             CASE WHEN j = 0 THEN 0 ELSE greatest(row[j + 1], coalesce(row[list_max(list_filter(range(1, j + 1),
                  lambda k: yb[k] = ch))] + 1, 0)) END), list_transform(range(len(yb) + 1), lambda j: 0))[len(yb) + 1]"""

LEARNED_CTES = f"""
sig0 AS ({oi.sg_induce_orders(3650)}),
sig AS (SELECT row_number() OVER (ORDER BY owner, replace(signature, '|', chr(1))) AS sig_id, owner, signature, pages FROM sig0),
detected AS (SELECT s.sig_id, max(o.o_orderdate) AS detected_on
             FROM sig s, unnest(string_split(s.pages, ',')) AS u(pg) JOIN orders o ON o.o_orderkey = CAST(u.pg AS BIGINT)
             GROUP BY s.sig_id),
meta AS (SELECT s.sig_id, c.c_name AS owner, d.detected_on FROM sig s JOIN detected d USING (sig_id) JOIN customer c ON c.c_custkey = s.owner),
brands AS (SELECT DISTINCT p_brand AS brand, split_part(p_brand, '#', -1)::INT AS n FROM part),
shown AS (
  SELECT brand, CASE WHEN n % 5 = 0 THEN 'Htexts' WHEN n % 2 = 0 THEN 'Lalerts' ELSE 'Ltexts' END AS type,
         CASE WHEN n % 5 = 0 THEN {_LABEL} || array_to_string(list_transform(range(18), lambda i: sha256(brand || ':' || i)), '')
              ELSE {_LABEL} END AS value FROM brands),
coded AS (SELECT *, row_number() OVER (ORDER BY value) AS code FROM shown),
lib AS (SELECT sig_id, type, code, value FROM (SELECT sig_id, split_part(unnest(string_split(signature, '|')), ':', 2) AS brand FROM sig)
        JOIN coded USING (brand))"""

SCAN_CTES = LEARNED_CTES + "," + fuzzy_hash_sql("coded", "code", "value", "type LIKE 'H%'") + f""",
compared AS (SELECT c.code, c.type, coalesce(h.hash, c.value) AS cmp FROM coded c LEFT JOIN hashes h USING (code)),
ratios AS (
  SELECT x.code AS a, y.code AS b, CASE WHEN x.type <> y.type THEN 0.0 ELSE 2.0 * lcs / (length(x.cmp) + length(y.cmp)) END AS ratio
  FROM (SELECT x, y, CASE WHEN x.type = y.type THEN {_LCS_FOLD} ELSE 0 END AS lcs
        FROM (SELECT x, y, string_split(y.cmp, '') AS yb FROM compared x, compared y))),
matrix AS (SELECT list(r ORDER BY a) AS m FROM (SELECT a, list(ratio::DOUBLE ORDER BY b) AS r FROM ratios GROUP BY a)),
occ2 AS (SELECT l_orderkey AS page_id, type, code FROM lineitem JOIN part ON p_partkey = l_partkey JOIN coded ON brand = p_brand),
pcontent AS (SELECT page_id, string_agg(code::VARCHAR, ',' ORDER BY code) AS content FROM occ2 GROUP BY page_id),
prep AS (SELECT content, min(page_id) AS page_rep FROM pcontent GROUP BY content),
pcol AS (SELECT page_id AS page_rep, type, list(code ORDER BY code) AS cl FROM occ2
         WHERE page_id IN (SELECT page_rep FROM prep) GROUP BY page_id, type),
scontent AS (SELECT sig_id, string_agg(code::VARCHAR, ',' ORDER BY code) AS content FROM lib GROUP BY sig_id),
sclass AS (SELECT content, min(sig_id) AS sig_class FROM scontent GROUP BY content),
srow AS (SELECT sig_id AS sig_class, type, list(code ORDER BY code) AS rl FROM lib
         WHERE sig_id IN (SELECT sig_class FROM sclass) GROUP BY sig_id, type),
ntypes AS (SELECT sig_class, count(*) AS nt FROM srow GROUP BY sig_class),
mat AS (SELECT c.page_rep, r.sig_class, r.type, rl, cl,
               list_transform(rl, lambda a: list_concat(list_transform(cl, lambda b: m[a][b]),
                                                        list_transform(range(greatest(len(rl) - len(cl), 0)), lambda z: 0.0::DOUBLE))) AS rws
        FROM srow r JOIN pcol c USING (type), matrix),
typed0 AS (
  SELECT page_rep, sig_class, type, rl, cl,
         list_reduce(rws, lambda acc, r: {{
           'total': acc.total + list_max(list_transform(r, lambda x, j: CASE WHEN list_contains(acc.used, j) THEN -1.0 ELSE x END)),
           'used': list_append(acc.used, list_position(
                     list_transform(r, lambda x, j: CASE WHEN list_contains(acc.used, j) THEN -1.0 ELSE x END),
                     list_max(list_transform(r, lambda x, j: CASE WHEN list_contains(acc.used, j) THEN -1.0 ELSE x END))))}},
           {{'total': 0.0::DOUBLE, 'used': []::INTEGER[]}}).total / len(rws) AS tscore
  FROM mat),
scores AS (SELECT page_rep, sig_class, sum(tscore) / any_value(nt) AS score FROM typed0 JOIN ntypes USING (sig_class)
           GROUP BY page_rep, sig_class HAVING sum(tscore) / any_value(nt) >= 0.75 - 1e-9),
typed AS (SELECT t.* FROM typed0 t SEMI JOIN scores s USING (page_rep, sig_class)),
best AS (SELECT page_rep, sig_class, score FROM (
           SELECT *, row_number() OVER (PARTITION BY page_rep ORDER BY round(score, 12) DESC, sig_class) AS rn FROM scores) WHERE rn = 1)"""

_VERDICTS = "WITH " + SCAN_CTES + """
SELECT o.o_orderkey AS page_id, b.sig_class IS NOT NULL AS found, m.owner, b.sig_class AS sig_id, m.detected_on,
       round(b.score * 100, 6) AS score_pct
FROM orders o LEFT JOIN (pcontent JOIN prep USING (content) JOIN best b USING (page_rep) JOIN meta m ON m.sig_id = b.sig_class)
     ON pcontent.page_id = o.o_orderkey"""


def learned_scan(spark, sf_dir):
    """(all orders, scan of them with the learned library, meta)."""
    library, meta = learned_library(spark, sf_dir)
    pages = corpora.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"))
    return pages, M.Scan(M.Library(library), corpora.orders_shown(spark, sf_dir)), meta


def _named(rows):
    """Contents by their smallest page, classes by their smallest signature."""
    return rows.withColumnRenamed("content", "page_id").withColumnRenamed("sig_class", "sig_id")


@register("src_signature_library", "WITH " + LEARNED_CTES + """
SELECT m.sig_id, m.owner, m.detected_on, CAST(count(*) AS BIGINT) AS n_elements,
       string_agg(l.type || ':' || sha256(l.value), ',' ORDER BY l.type || ':' || sha256(l.value)) AS elements
FROM meta m JOIN lib l USING (sig_id) GROUP BY m.sig_id, m.owner, m.detected_on""")
def q_src_signature_library(spark, sf_dir):
    """The whole learned library: one row per signature with its elements."""
    rows, meta = learned_library(spark, sf_dir)
    keyed = rows.select("sig_id", F.concat_ws(":", "type", F.sha2("element", 256)).alias("k"))
    agg = keyed.groupBy("sig_id").agg(F.count(F.lit(1)).cast("long").alias("n_elements"),
                                      F.array_join(F.sort_array(F.collect_list("k")), ",").alias("elements"))
    return meta.join(agg, "sig_id").select("sig_id", "owner", "detected_on", "n_elements", "elements")


@register("mt_pair_table", "WITH " + SCAN_CTES + """
SELECT DISTINCT t.type, sha256(x.value) AS skey, sha256(y.value) AS pkey, round(m[a][b], 6) AS ratio
FROM (SELECT type, a, unnest(cl) AS b FROM (SELECT type, cl, unnest(rl) AS a FROM typed)) t
     JOIN coded x ON x.code = t.a JOIN coded y ON y.code = t.b, matrix""")
def q_mt_pair_table(spark, sf_dir):
    """Ratios of the distinct element pairs of all pages and signatures that match."""
    _, scan, _ = learned_scan(spark, sf_dir)
    met = scan.bounded.join(scan.scores, ["content", "sig_class"], "left_semi").select("type", "scode", "pcode").distinct()

    def digests(elements, code, key):
        return elements.select(F.col("code").alias(code), F.sha2("element", 256).alias(key))

    return (met.join(scan.pair_scores, ["scode", "pcode"]).join(digests(scan.library.distinct, "scode", "skey"), "scode")
            .join(digests(scan.distinct, "pcode", "pkey"), "pcode").select("type", "skey", "pkey", F.round("ratio", 6).alias("ratio")))


@register("mt_greedy", "WITH " + SCAN_CTES + """
SELECT page_rep AS page_id, sig_class AS sig_id, type, round(tscore, 6) AS greedy FROM typed""")
def q_mt_greedy(spark, sf_dir):
    """Greedy score per type of every content and signature class that match."""
    _, scan, _ = learned_scan(spark, sf_dir)
    typed = scan.type_scores.join(scan.scores.select("content", "sig_class"), ["content", "sig_class"])
    return _named(typed).select("page_id", "sig_id", "type", F.round("tscore", 6).alias("greedy"))


@register("mt_type_mean", "WITH " + SCAN_CTES + """
SELECT page_rep AS page_id, sig_class AS sig_id, round(score, 6) AS score FROM scores""")
def q_mt_type_mean(spark, sf_dir):
    _, scan, _ = learned_scan(spark, sf_dir)
    return _named(scan.scores).select("page_id", "sig_id", F.round("score", 6).alias("score"))


@register("wn_best_signature", "WITH " + SCAN_CTES + """
SELECT page_rep AS page_id, sig_class AS sig_id, round(score, 6) AS score FROM best""")
def q_wn_best_signature(spark, sf_dir):
    """Of several matching signatures the best, of equally good ones the first."""
    _, scan, _ = learned_scan(spark, sf_dir)
    # contents that hold a whole signature are settled by equi-joins, only the others are scored
    return _named(scan.winners).select("page_id", "sig_id", F.round("score", 6).alias("score"))


@register("jn_page_signature", "WITH " + SCAN_CTES + """
SELECT p.page_id, s.sig_class AS sig_id, round(s.score, 6) AS score
FROM pcontent p JOIN prep USING (content) JOIN scores s USING (page_rep)""")
def q_jn_page_signature(spark, sf_dir):
    """Every order with every signature class that it matches."""
    _, scan, _ = learned_scan(spark, sf_dir)
    return scan.pages.select("page_id", "content").join(scan.scores, "content").select(
        "page_id", F.col("sig_class").alias("sig_id"), F.round("score", 6).alias("score"))


@register("mt_verdict", _VERDICTS)
def q_mt_verdict(spark, sf_dir):
    """Verdict on every order."""
    pages, scan, meta = learned_scan(spark, sf_dir)
    return M.mt_verdict(pages, scan, meta)


@register("mt_verdict_pages")
def q_mt_verdict_pages(spark, sf_dir):
    """Verdict on every web page, long elements by their fuzzy hashes; the library holds all elements
    of the newest page of every host (checked against exhaustive scoring in tests)."""
    pages = corpora.table(spark, sf_dir, "pages")
    elements = reuse(X.ext_page_elements(pages))
    library, meta = M.page_library(elements, corpora.pages_observations(spark, sf_dir))
    return M.mt_verdict(pages, M.Scan(M.Library(library), elements), meta)


# ---------------------------------------------------------------- LCS ratio on short texts

_LCS_SQL = "WITH RECURSIVE " + TAGGED_CTES + """,
tt1 AS (SELECT page_id, value FROM (SELECT page_id, value, row_number() OVER (PARTITION BY page_id ORDER BY pos) rn
                                    FROM tagged WHERE tag = 'title') WHERE rn = 1),
th1 AS (SELECT page_id, value FROM (SELECT page_id, value, row_number() OVER (PARTITION BY page_id ORDER BY pos) rn
                                    FROM tagged WHERE tag = 'h1') WHERE rn = 1),
pr AS (
  SELECT a.page_id, a.value AS ta, b.value AS tb, hex(encode(a.value)) AS ha, hex(encode(b.value)) AS hb,
         octet_length(encode(a.value)) AS m, octet_length(encode(b.value)) AS n
  FROM tt1 a JOIN th1 b USING (page_id)),
bl AS (SELECT page_id, m, n, ha,
              list_transform(range(n), lambda k: substr(hb, 2 * k + 1, 2)) AS bb FROM pr),
dp(page_id, i, row) AS (
  SELECT page_id, 0, list_transform(range(n + 1), lambda j: 0) FROM bl
  UNION ALL
  SELECT d.page_id, d.i + 1,
         list_transform(range(b.n + 1), lambda j:
           CASE WHEN j = 0 THEN 0 ELSE greatest(d.row[j + 1], coalesce(d.row[list_max(list_filter(range(1, j + 1),
                lambda k: b.bb[k] = substr(b.ha, 2 * d.i + 1, 2)))] + 1, 0)) END)
  FROM dp d JOIN bl b USING (page_id)
  WHERE d.i < b.m)
SELECT b.page_id, CAST(b.m AS BIGINT) AS len_title, CAST(b.n AS BIGINT) AS len_h1,
       CAST(d.row[b.n + 1] AS BIGINT) AS lcs,
       round(CASE WHEN b.m + b.n > 0 THEN 2.0 * d.row[b.n + 1] / (b.m + b.n) END, 6) AS ratio
FROM bl b JOIN dp d ON d.page_id = b.page_id AND d.i = b.m"""


def _first_tagged(raw, tag):
    w = Window.partitionBy("page_id").orderBy("pos")
    return raw.where((F.col("kind") == "texts") & (F.col("tag") == tag)) \
        .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1) \
        .select("page_id", F.encode("value", "UTF-8").alias(tag))


@register("sc_lcs_ratio", _LCS_SQL)
def q_sc_lcs_ratio(spark, sf_dir):
    """LCS ratio between every page's title text and its heading text (whole texts)."""
    raw = X.ext_raw_elements(corpora.table(spark, sf_dir, "pages"))
    pr = _first_tagged(raw, "title").join(_first_tagged(raw, "h1"), "page_id")
    ratio = S.lcs_ratio(F.col("title"), F.col("h1"))
    return pr.select("page_id", F.octet_length("title").cast("long").alias("len_title"),
                     F.octet_length("h1").cast("long").alias("len_h1"),
                     F.round(ratio * (F.octet_length("title") + F.octet_length("h1")) / 2.0)
                     .cast("long").alias("lcs"),
                     F.round(ratio, 6).alias("ratio"))


@register("ext_fuzzy_hash", TEXTS_CTE + """,
el AS (SELECT DISTINCT CASE WHEN octet_length(encode(value)) <= 1000 THEN 'L' ELSE 'H' END || 'texts' AS type, value
       FROM texts WHERE length(value) >= 3),""" + fuzzy_hash_sql("el", "value", "value") + """
SELECT type, sha256(value) AS element_sha, hash FROM el JOIN hashes ON code = value""")
def q_ext_fuzzy_hash(spark, sf_dir):
    """Piecewise hash of every distinct page element."""
    e = X.ext_page_elements(corpora.table(spark, sf_dir, "pages"))
    d = e.select("type", "element").dropDuplicates(["type", "element"])
    return d.select("type", F.sha2("element", 256).alias("element_sha"),
                    S.fuzzy_hash(F.col("element")).alias("hash"))
