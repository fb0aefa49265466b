"""DuckDB SQL for the selection windows and the induction (the driver's oracle).

Written independently of the Spark code: plain CTEs, 1-based lists, same definitions.
"""

from __future__ import annotations


def orders_obs_cte() -> str:
    return """
obs AS (
  SELECT o_custkey AS owner, o_orderkey AS obs_id, o_orderdate AS time,
         'h' || CAST(o_orderkey % 13 AS VARCHAR) || '.example.com' AS host
  FROM orders)"""


def selection_ctes(days: int, k: int = 7) -> str:
    return f"""
anchor AS (SELECT owner, arg_max(time, obs_id) AS anchor FROM obs GROUP BY owner),
hist AS (SELECT obs.* FROM obs JOIN anchor USING (owner) WHERE time >= anchor - INTERVAL {days} DAY),
latest AS (SELECT owner, host, max(obs_id) AS obs_id FROM hist GROUP BY owner, host),
ranked AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY obs_id DESC, host) AS rnk FROM latest),
topk AS (SELECT * FROM ranked WHERE rnk <= {k}),
sel AS (SELECT * FROM topk WHERE owner IN (SELECT owner FROM topk GROUP BY owner HAVING max(rnk) = {k}))"""


def orders_occ_cte() -> str:
    return """
occ AS (
  SELECT sel.owner, sel.obs_id AS page, 'Ltexts:' || p.p_brand AS element
  FROM sel JOIN lineitem l ON l.l_orderkey = sel.obs_id JOIN part p ON p.p_partkey = l.l_partkey)"""


def induction_ctes(aa: int = 3, bb: int = 3) -> str:
    levels = []
    prev = "s0"
    for lvl in range(1, aa + 1):
        cur = f"s{lvl}"
        levels.append(f"""
{cur}j AS (
  SELECT s.owner, s.gid, s.onlynx, s.rest, n.counts,
         list_transform(range(len(s.keys)), lambda i: s.keys[i + 1] || '/' || n.counts[i + 1]::VARCHAR) AS k2
  FROM {prev} s JOIN nx n USING (owner)
  WHERE len(list_filter(s.rest, lambda p: n.counts[p + 1] > 0)) > 0),
{cur} AS (
  SELECT DISTINCT owner, gid, onlynx,
         list_transform(k2, lambda q: list_position(k2, q)::VARCHAR) AS keys,
         list_filter(rest, lambda p: counts[p + 1] = 0) AS rest,
         len(list_distinct(k2)) AS b
  FROM {cur}j
  WHERE len(list_distinct(k2)) <= {aa})""")
        prev = cur
    test = (f"(len(rest) = 0 OR (len(list_filter(rest, lambda p: onlynx[p + 1])) = 0 "
            f"AND len(rest) + b - 1 <= {aa}))")
    hits = " UNION ".join(f"SELECT owner, gid FROM s{i} WHERE {test}" for i in range(aa + 1))
    return f"""
lines AS (SELECT owner, element, page, count(*)::INT AS cnt FROM occ GROUP BY owner, element, page),
pages AS (
  SELECT owner, page, (row_number() OVER (PARTITION BY owner ORDER BY page) - 1)::INT AS pidx,
         (count(*) OVER (PARTITION BY owner))::INT AS x
  FROM (SELECT DISTINCT owner, page FROM lines)),
lr AS (SELECT l.owner, l.element, p.pidx, l.cnt, p.x FROM lines l JOIN pages p USING (owner, page)),
shapes0 AS (
  SELECT owner, element, count(*) AS spread, max(x) AS x, list({{'pidx': pidx, 'cnt': cnt}}) AS entries
  FROM lr GROUP BY owner, element),
shapes AS (
  SELECT owner, element, spread,
         list_transform(range(x), lambda i: coalesce(list_sum(list_transform(
             list_filter(entries, lambda e: e.pidx = i), lambda e: e.cnt)), 0)) AS counts
  FROM shapes0),
pp AS (
  SELECT lr.owner, lr.pidx,
         coalesce(list({{'element': lr.element, 'cnt': lr.cnt}} ORDER BY lr.element)
                  FILTER (WHERE s.spread > {bb}), []) AS profile,
         NOT bool_or(s.spread = 1) AS only_nx
  FROM lr JOIN shapes s USING (owner, element) GROUP BY lr.owner, lr.pidx),
grouped AS (
  SELECT pp.*, p.page, min(pp.pidx) OVER (PARTITION BY pp.owner, pp.profile) AS gid
  FROM pp JOIN pages p USING (owner, pidx)),
owners AS (
  SELECT owner, list(gid::VARCHAR ORDER BY pidx) AS gkeys, list(only_nx ORDER BY pidx) AS onlynx,
         count(DISTINCT gid) AS n0
  FROM grouped GROUP BY owner HAVING count(DISTINCT gid) <= {aa}),
groups AS (
  SELECT owner, gid, any_value(profile) AS profile, list(page ORDER BY page) AS pages
  FROM grouped WHERE owner IN (SELECT owner FROM owners) GROUP BY owner, gid),
members AS (
  SELECT owner, gid, list(pidx ORDER BY pidx) AS members FROM grouped GROUP BY owner, gid),
nx AS (SELECT DISTINCT owner, counts FROM shapes WHERE spread BETWEEN 2 AND {bb}),
s0 AS (
  SELECT g.owner, g.gid, o.onlynx, o.gkeys AS keys, m.members AS rest, o.n0 AS b
  FROM groups g JOIN owners o USING (owner) JOIN members m USING (owner, gid)),
{",".join(x.strip() for x in levels)},
eliminated AS ({hits}),
induced AS (
  SELECT g.owner,
         flatten(list_transform(g.profile, lambda s: list_transform(range(s.cnt), lambda i: s.element)))
           AS signature,
         g.pages
  FROM groups g ANTI JOIN eliminated e USING (owner, gid))"""


def induced_rows_select() -> str:
    return """
SELECT CAST(owner AS BIGINT) AS owner, array_to_string(signature, '|') AS signature,
       array_to_string(list_transform(pages, lambda p: p::VARCHAR), ',') AS pages,
       CAST(len(pages) AS BIGINT) AS n_pages, CAST(len(signature) AS BIGINT) AS n_elements
FROM induced WHERE len(signature) > 0"""


def sg_induce_orders(days: int = 3650) -> str:
    return ("WITH " + orders_obs_cte() + "," + selection_ctes(days) + "," + orders_occ_cte() + ","
            + induction_ctes() + induced_rows_select())


def events_obs_cte() -> str:
    return """
obs AS (
  SELECT DISTINCT user_id AS owner, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS obs_id,
         CAST(CAST(ts AS DATE) AS TIMESTAMP) AS time,
         'd' || CAST(day(CAST(ts AS DATE)) % 11 AS VARCHAR) || '.example.com' AS host
  FROM events)"""


def events_occ_cte() -> str:
    return """
occ AS (
  SELECT sel.owner, sel.obs_id AS page,
         'Ltexts:' || e.event_type || '/' || CAST(CAST(floor(e.value / 20) AS BIGINT) AS VARCHAR) AS element
  FROM sel JOIN events e ON e.user_id = sel.owner
   AND date_diff('day', DATE '1970-01-01', CAST(e.ts AS DATE)) = sel.obs_id)"""


def sg_induce_events(days: int = 180) -> str:
    return ("WITH " + events_obs_cte() + "," + selection_ctes(days) + "," + events_occ_cte() + ","
            + induction_ctes() + induced_rows_select())
