"""SQL for an independent database, put together from named table expressions."""

from __future__ import annotations

import re

from .scenarios import SCENARIOS, min_length

SEED, K, TOPK_SIM, NEIGHBOURS = 0, 500, 200, 50
#: Shares of all lists that are held out, and that one scenario may take: cases grow with the tables.
TEST_SHARE, QUOTA_SHARE = 5, 50

CTE: dict[str, str] = {}

CTE["inter"] = """SELECT o_custkey AS pid, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_shipdate) - 1 AS BIGINT) AS pos, l_partkey AS track
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
CTE["titles"] = "SELECT c_custkey AS pid, lower(c_mktsegment || ' ' || n_name) AS title FROM customer JOIN nation ON c_nationkey = n_nationkey"
CTE["tracks"] = "SELECT p_partkey AS track, p_brand AS artist FROM part"
CTE["testp"] = f"SELECT pid FROM (SELECT DISTINCT pid FROM inter) ORDER BY md5('{SEED}:' || pid), pid LIMIT (SELECT count(DISTINCT pid) // {TEST_SHARE} FROM inter)"
CTE["train"] = "SELECT * FROM inter WHERE pid NOT IN (SELECT pid FROM testp)"
CTE["test"] = "SELECT * FROM inter WHERE pid IN (SELECT pid FROM testp)"
CTE["pop"] = "SELECT track, coalesce(c, 0) AS pop FROM tracks LEFT JOIN (SELECT track, count(*) AS c FROM train GROUP BY track) USING (track)"
CTE["poprank"] = "SELECT track, pop, row_number() OVER (ORDER BY pop DESC, track) AS pop_rank FROM pop"
CTE["allpop"] = "SELECT track, coalesce(c, 0) AS pop FROM tracks LEFT JOIN (SELECT track, count(*) AS c FROM inter GROUP BY track) USING (track)"
CTE["spec"] = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {n}, {str(t).lower()}, {str(r).lower()})" for s, n, t, r in SCENARIOS) + ") AS v(scenario, n_seed, use_title, random)"


def scenario_tables(prefix: str, lists: str, quota: str) -> None:
    """The assignment and the cut of the lists (pid, pos, track) of a table."""
    CTE[f"{prefix}lens"] = f"SELECT pid, count(*) AS n FROM {lists} GROUP BY pid"
    used: list[str] = []
    for n in sorted({s[1] for s in SCENARIOS}, reverse=True):
        names = [s[0] for s in SCENARIOS if s[1] == n]
        skip = "".join(f" AND pid NOT IN (SELECT pid FROM {u})" for u in used)
        choice = "[" + ", ".join(f"'{x}'" for x in names) + "]"
        CTE[f"{prefix}g{n}"] = f"SELECT pid, ({choice})[CAST(r % {len(names)} AS BIGINT) + 1] AS scenario FROM (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS r FROM {prefix}lens WHERE n >= {min_length(n)}{skip}) WHERE r < {len(names)} * {quota}"
        used.append(f"{prefix}g{n}")
    CTE[f"{prefix}assigned"] = " UNION ALL ".join(f"SELECT * FROM {u}" for u in used)
    CTE[f"{prefix}items"] = f"""SELECT pid AS case_id, pos, track, CASE WHEN random THEN luck <= n_seed ELSE pos < n_seed END AS is_seed FROM (
    SELECT pid, pos, track, n_seed, random, row_number() OVER (PARTITION BY pid ORDER BY md5('{SEED}:' || pid || ':' || pos), pos) AS luck FROM {lists} JOIN {prefix}assigned USING (pid) JOIN spec USING (scenario))"""
    for name, which in (("seeds", "is_seed"), ("holdout", "NOT is_seed")):
        CTE[f"{prefix}{name}"] = f"SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY pos) - 1 AS ord, track FROM {prefix}items WHERE {which}"


scenario_tables("", "test", f"(SELECT greatest(1, count(DISTINCT pid) // {QUOTA_SHARE}) FROM inter)")
CTE["cases"] = "SELECT pid AS case_id, scenario, CASE WHEN use_title THEN coalesce(title, '') END AS title FROM assigned JOIN spec USING (scenario) LEFT JOIN titles USING (pid)"
#: Suppliers as lists: long enough for 100 seeds.
LONG_QUOTA = 3
CTE["longinter"] = "SELECT l_suppkey AS pid, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate) - 1 AS BIGINT) AS pos, l_partkey AS track FROM lineitem"
scenario_tables("long", "longinter", str(LONG_QUOTA))
CTE["cnt"] = "SELECT pid, track, count(*) AS cnt FROM train GROUP BY pid, track"
CTE["co"] = "SELECT a.track AS i, b.track AS j, CAST(sum(a.cnt * b.cnt) AS BIGINT) AS v FROM cnt a JOIN cnt b ON a.pid = b.pid AND a.track <> b.track GROUP BY i, j"
CTE["sim"] = "SELECT i, j, v / (sqrt(CAST(p.pop AS DOUBLE) * q.pop) + 10.0) AS sim FROM co JOIN pop p ON p.track = i JOIN pop q ON q.track = j"
CTE["near"] = f"SELECT * FROM (SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM sim) WHERE rank <= {TOPK_SIM}"


def cf_scores(near: str) -> str:
    return f"""SELECT case_id, track, score FROM (SELECT case_id, j AS track, round(sum(sim), 6) AS score FROM seeds JOIN {near} ON track = i GROUP BY case_id, j)
  WHERE score > 0 AND (case_id, track) NOT IN (SELECT case_id, track FROM seeds)"""


CTE["cfscore"] = cf_scores("near")


def ranked(scored: str, k: int = K) -> str:
    """Scored rows (case_id, track, score), then popularity, as the engine ranks them."""
    return f"""SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY tier, score DESC, pop DESC, track) AS BIGINT) AS rank, track, score FROM (
      SELECT case_id, track, 0 AS tier, score, pop FROM {scored} JOIN pop USING (track)
      UNION ALL SELECT case_id, p.track, 1, 0.0, pop FROM cases, pop p WHERE (case_id, p.track) NOT IN (SELECT case_id, track FROM {scored}) AND (case_id, p.track) NOT IN (SELECT case_id, track FROM seeds))
    QUALIFY rank <= {k}"""


CTE["none"] = "SELECT case_id, track, 0.0 AS score FROM seeds WHERE false"
CTE["poprecs"] = ranked("none")
CTE["cfrecs"] = ranked("cfscore")
#: The sweep over the number of neighbours.
SWEEP = (20, 50, 200)
for _n in SWEEP:
    CTE[f"near{_n}"] = f"SELECT * FROM near WHERE rank <= {_n}"
    CTE[f"cf{_n}score"] = cf_scores(f"near{_n}")
    CTE[f"cf{_n}recs"] = ranked(f"cf{_n}score")

# ---- titles
CTE["tlists"] = "SELECT pid, title AS t FROM titles WHERE pid IN (SELECT pid FROM train)"
_grams = """SELECT t, times, gram, count(*) AS tf FROM (
    SELECT t, times, unnest(flatten([[w[s:s + n - 1] FOR s IN range(1, length(w) - n + 2)] FOR n IN range(2, 6)])) AS gram
    FROM (SELECT t, times, ' ' || unnest(string_split_regex(t, '\\s+')) || ' ' AS w FROM {src})) GROUP BY t, times, gram"""
CTE["ttf"] = _grams.format(src="(SELECT t, count(*) AS times FROM tlists GROUP BY t)")
CTE["tidf"] = "SELECT gram, ln((1.0 + (SELECT count(*) FROM tlists)) / (1 + sum(times))) + 1 AS idf FROM ttf GROUP BY gram HAVING sum(times) >= 2"
CTE["tindex"] = "SELECT t, gram, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS w FROM (SELECT t, gram, tf * idf AS w FROM ttf JOIN tidf USING (gram))"
CTE["qtf"] = _grams.format(src="(SELECT DISTINCT title AS t, 1 AS times FROM cases WHERE title <> '')")
CTE["qindex"] = "SELECT t, gram, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS w FROM (SELECT t, gram, tf * idf AS w FROM qtf JOIN tidf USING (gram))"
CTE["talike"] = "SELECT q.t, x.t AS u, round(sum(q.w * x.w), 6) AS w FROM qindex q JOIN tindex x USING (gram) GROUP BY q.t, u HAVING round(sum(q.w * x.w), 6) > 0"
CTE["tnear"] = f"SELECT case_id, pid, w FROM cases c JOIN (SELECT a.t, l.pid, w FROM talike a JOIN tlists l ON l.t = a.u QUALIFY row_number() OVER (PARTITION BY a.t ORDER BY w DESC, l.pid) <= {NEIGHBOURS + 1}) n ON n.t = c.title"
CTE["tscore"] = """SELECT case_id, track, score FROM (SELECT case_id, track, round(sum(w) * (ln(((SELECT count(*) FROM tlists) + 1.0) / (any_value(pop) + 1)) + 1), 6) AS score
    FROM tnear JOIN train USING (pid) JOIN pop USING (track) GROUP BY case_id, track) WHERE score > 0 AND (case_id, track) NOT IN (SELECT case_id, track FROM seeds)"""
CTE["trecs"] = ranked("tscore")

# ---- metrics


def metrics(recs: str) -> str:
    return f"""SELECT c.case_id, c.scenario, round(coalesce(least(1.0, (coalesce(hits, 0) + coalesce(soft, 0)) / R), 0), 12) AS r_precision,
      round(coalesce(coalesce(dcg, 0) / list_sum([1 / log2(i + 1.0) FOR i IN range(1, d + 1)]), 0), 12) AS ndcg, CAST(coalesce(floor(first / 10), 51) AS DOUBLE) AS clicks
    FROM cases c LEFT JOIN (SELECT case_id, CAST(count(*) AS DOUBLE) AS R, count(DISTINCT track) AS d FROM holdout GROUP BY case_id) s USING (case_id)
    LEFT JOIN (SELECT case_id, sum(CASE WHEN rank <= n THEN 1.0 ELSE 0 END) AS hits, sum(1 / log2(rank + 1.0)) AS dcg, min(rank) - 1 AS first
      FROM {recs} r JOIN (SELECT DISTINCT case_id, track FROM holdout) USING (case_id, track) JOIN (SELECT case_id, count(*) AS n FROM holdout GROUP BY case_id) USING (case_id) GROUP BY case_id) h USING (case_id)
    LEFT JOIN (SELECT case_id, 0.25 * sum(least(supply, demand)) AS soft FROM
      (SELECT case_id, artist, count(*) AS supply FROM {recs} r JOIN (SELECT case_id, count(*) AS n FROM holdout GROUP BY case_id) USING (case_id) JOIN tracks USING (track)
        WHERE rank <= n AND (case_id, track) NOT IN (SELECT case_id, track FROM holdout) GROUP BY case_id, artist)
      JOIN (SELECT h.case_id, artist, count(*) AS demand FROM holdout h JOIN tracks USING (track) JOIN (SELECT case_id, count(*) AS n FROM holdout GROUP BY case_id) s ON s.case_id = h.case_id
        WHERE NOT EXISTS (SELECT 1 FROM {recs} r WHERE r.case_id = h.case_id AND r.track = h.track AND r.rank <= n) GROUP BY h.case_id, artist) USING (case_id, artist) GROUP BY case_id) a USING (case_id)"""


CTE["popm"], CTE["cfm"], CTE["tm"] = metrics("poprecs"), metrics("cfrecs"), metrics("trecs")
for _n in SWEEP:
    CTE[f"cf{_n}m"] = metrics(f"cf{_n}recs")
CTE["allm"] = "SELECT 'popularity' AS model, * FROM popm UNION ALL SELECT 'item_cf', * FROM cfm UNION ALL SELECT 'title', * FROM tm"
CTE["summary"] = """SELECT model, CASE WHEN grouping(scenario) = 1 THEN 'OVERALL' ELSE scenario END AS scenario, count(*) AS n, round(avg(r_precision), 9) AS r_precision, round(avg(ndcg), 9) AS ndcg, round(avg(clicks), 9) AS clicks
  FROM allm GROUP BY GROUPING SETS ((model, scenario), (model))"""

# ---- features
CTE["rawf"] = """SELECT p_partkey AS track, p_type, CAST(p_size AS DOUBLE) AS tempo, p_retailprice AS energy, valence, acousticness, lyrical_depth FROM part LEFT JOIN
  (SELECT l_partkey AS track, round(avg(l_discount), 9) AS valence, round(avg(l_quantity), 9) AS acousticness, round(avg(l_tax), 9) AS lyrical_depth FROM lineitem GROUP BY l_partkey) ON track = p_partkey"""
CTE["types"] = "SELECT p_type, row_number() OVER (ORDER BY p_type) AS g FROM (SELECT DISTINCT p_type FROM part)"
_scaled = ", ".join(f"round(coalesce(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 0.5), 6)" for c in ("tempo", "energy", "valence", "acousticness", "lyrical_depth"))
CTE["feats"] = f"SELECT track, [{_scaled}, " + ", ".join(f"CASE WHEN g = {i + 1} THEN 1.0 ELSE 0.0 END" for i in range(10)) + "]::DOUBLE[] AS axes FROM rawf JOIN types USING (p_type)"


def sql(body: str) -> str:
    """A query over the named table expressions, with those it needs in order."""
    need: list[str] = []
    begun: set[str] = set()

    def visit(text: str) -> None:
        for name in CTE:
            # A table's name, as it follows FROM or JOIN (columns may be called alike).
            if name not in begun and re.search(rf"\b(?:FROM|JOIN)\s+(?:\w+(?:\s\w)?,\s+)?{name}\b", text):
                begun.add(name)
                visit(CTE[name])
                need.append(name)

    visit(body)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in need) + "\n" if need else "") + body
