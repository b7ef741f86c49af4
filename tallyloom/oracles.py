"""DuckDB SQL for the rows of the queries, over the same tables."""

from __future__ import annotations

#: What most queries start from.
BASE = {
    "scores": """scores AS (
  SELECT p_type AS benchmark_id, l_suppkey AS model_id, count(*) AS n_lines,
    ((sum(round(l_extendedprice * 100)::BIGINT)::BIGINT // count(*)) // 10000)::DOUBLE / 10.0 AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)""",
    "elos": """elos AS (
  SELECT l_suppkey AS model_id, (sum(round(l_extendedprice * 100)::BIGINT)::BIGINT // 100000)::DOUBLE AS elo FROM lineitem GROUP BY ALL)""",
    "category_elos": """category_elos AS (
  SELECT l_suppkey AS model_id, r_name AS category, (sum(round(l_extendedprice * 100)::BIGINT)::BIGINT // 100000)::DOUBLE AS elo
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)""",
    "pairs": "pairs AS (SELECT * FROM scores JOIN elos USING (model_id))",
    "universe": "universe AS (SELECT model_id FROM elos WHERE elo >= 31000)",
    "ranks": """ranks AS (
  SELECT benchmark_id, score, elo,
    rank() OVER (PARTITION BY benchmark_id ORDER BY score) + (count(*) OVER (PARTITION BY benchmark_id, score) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY benchmark_id ORDER BY elo) + (count(*) OVER (PARTITION BY benchmark_id, elo) - 1) / 2.0::DOUBLE AS ry FROM pairs)""",
    "tests": "tests AS (SELECT n_name AS test, ((n_nationkey * 37 + 11) % 97) / 2000.0::DOUBLE AS p FROM nation)",
    "holm": """steps AS (
  SELECT test, p, count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1 AS k FROM tests
), holm AS (
  SELECT test, p, round(least(1.0::DOUBLE, max(p * k) OVER o), 10) AS p_corrected, min((p <= 0.05::DOUBLE / k)::INT) OVER o = 1 AS is_significant
  FROM steps WINDOW o AS (ORDER BY p, test ROWS UNBOUNDED PRECEDING))""",
    "named": """named AS (
  SELECT p_partkey, p_name AS name, regexp_split_to_array(lower(p_name), '[\\s#]+') AS tokens, CASE WHEN p_size % 3 > 0 THEN p_size % 3 END AS version,
    CASE WHEN p_size % 2 = 0 THEN p_brand END AS parameters,
    CASE WHEN p_size % 5 > 0 THEN CASE WHEN p_size % 5 < 3 THEN '2025-0' ELSE '2024-0' END || p_size % 5 END AS date,
    CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN regexp_split_to_array(lower(p_name), '[\\s#]+')[1] ELSE array_to_string(regexp_split_to_array(lower(p_name), '[\\s#]+'), '-') END AS subfamily FROM part
), candidates AS (
  SELECT a.p_partkey AS key, b.p_partkey AS c_key, a.name, b.name AS candidate, a.version, a.parameters, b.parameters AS c_parameters, list_distinct(a.tokens) AS t, list_distinct(b.tokens) AS c_t, a.date, b.date AS c_date, a.subfamily, b.subfamily AS c_subfamily
  FROM named a JOIN named b ON a.p_partkey <> b.p_partkey AND a.tokens[1] IS NOT DISTINCT FROM b.tokens[1] AND a.version IS NOT DISTINCT FROM b.version
    AND (a.parameters IS NULL OR b.parameters IS NULL OR lower(a.parameters) = lower(b.parameters)))""",
}


def _with(parts: str, body: str) -> str:
    return "WITH " + ",\n".join(BASE[p] for p in parts.split()) + "\n" + body


SQL = {
    "scores_long": _with("scores", "SELECT * FROM scores"),
    "universe_threshold": _with("elos universe", "SELECT * FROM universe"),
    "universe_semi": _with("scores elos universe", "SELECT benchmark_id, model_id, score FROM scores SEMI JOIN universe USING (model_id)"),
    "common_subset_between": _with("elos", "SELECT * FROM elos WHERE elo BETWEEN 31000 AND 32500"),
    "filter_trim_equal": """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'FACTS' ELSE p_type END AS benchmark_id, count(*) AS n FROM part WHERE p_partkey % 6 <> 2 GROUP BY 1""",
    "filter_nonempty_score": "SELECT event_id, event_type, trim(json_extract_string(props, '$.k')) AS score_text FROM events WHERE lower(trim(json_extract_string(props, '$.k'))) NOT IN ('', '--', 'nan')",
    "filter_exclude_id": _with("scores", "SELECT benchmark_id, count(*) AS n FROM scores WHERE benchmark_id <> 'ECONOMY' GROUP BY 1"),
    "pairwise_complete": "SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y FROM part WHERE p_size > 10 AND p_retailprice > 950",
    "filter_finite": "SELECT s_suppkey, round(s_acctbal / s_nationkey, 6) AS ratio FROM supplier WHERE s_nationkey % 5 <> 0 AND s_acctbal IS NOT NULL",
    "range_check": "SELECT abs(min(l_discount)) AS least, max(l_discount) AS most, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0 AND 100",
    "overlap_having": _with("scores elos universe", "SELECT benchmark_id, count(*) AS n FROM scores SEMI JOIN universe USING (model_id) GROUP BY 1 HAVING count(*) >= 6"),
    "overlap_statistics": _with(
        "scores elos universe",
        """SELECT benchmark_id, count(*) AS n_models, count(u.model_id) AS n_overlap, round(count(u.model_id) * 100.0::DOUBLE / (SELECT count(*) FROM universe), 8) AS overlap_pct
FROM scores s LEFT JOIN universe u USING (model_id) GROUP BY 1""",
    ),
    "elo_outer_pivot": _with(
        "category_elos",
        "SELECT model_id, " + ", ".join(f"max(elo) FILTER (category = '{r}') AS elo_{r.lower().replace(' ', '_')}" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM category_elos GROUP BY 1",
    ),
    "left_benchmark_wide": _with(
        "scores elos universe",
        """, ranked AS (
  SELECT *, (rank() OVER (PARTITION BY benchmark_id ORDER BY score DESC))::INT AS rank FROM scores SEMI JOIN universe USING (model_id))
SELECT u.model_id, """.replace(", ranked", ",\nranked", 1)
        + ", ".join(f"max({k}) FILTER (benchmark_id = '{t}') AS {t.lower()}_{k}" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD") for k in ("score", "rank"))
        + " FROM universe u LEFT JOIN ranked USING (model_id) GROUP BY 1",
    ),
    "map_lookup_coalesce": _with("elos", "SELECT model_id, elo, coalesce(s_name, 'unknown') AS display_name FROM elos LEFT JOIN supplier ON model_id = s_suppkey AND s_acctbal > 0"),
    "inner_lookup_first": "SELECT c_custkey, c_name, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2",
    "intersection_keys": _with("scores", "SELECT model_id FROM scores WHERE benchmark_id = 'PROMO' INTERSECT SELECT model_id FROM scores WHERE benchmark_id = 'ECONOMY' AND score >= 53"),
    "merge_back": _with("tests holm", "SELECT test, t.p, p_corrected, is_significant FROM tests t JOIN holm USING (test)"),
    "difficulty": _with(
        "scores elos pairs",
        """, g AS (
  SELECT benchmark_id, count(*) FILTER (elo BETWEEN 31000 AND 32500) AS n_band, avg(score) FILTER (elo BETWEEN 31000 AND 32500) AS band, avg(score) AS every FROM pairs GROUP BY 1)
SELECT benchmark_id, n_band, round(CASE WHEN n_band >= 5 THEN band END, 8) AS subset_avg_score, round(100 - CASE WHEN n_band >= 5 THEN band ELSE every END, 8) AS difficulty,
  n_band < 5 AS is_estimated_difficulty FROM g""",
    ),
    "cv": _with("scores", "SELECT benchmark_id, round(stddev_samp(score) / nullif(avg(score), 0), 8) AS cv FROM scores GROUP BY 1"),
    "ref_difficulty": _with("scores", "SELECT benchmark_id, round(avg(score), 8) AS reference_avg_score, round(100 - avg(score), 8) AS reference_difficulty FROM scores WHERE model_id IN (1, 2, 3) GROUP BY 1 HAVING count(*) = 3"),
    "count_names": "SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS n_same_name FROM part",
    "count_distinct": _with("scores", "SELECT count(DISTINCT benchmark_id) AS n_benchmarks, count(DISTINCT model_id) AS n_models FROM scores"),
    "distinct_names": "SELECT p_name FROM part WHERE p_size > 5 UNION SELECT p_name FROM part WHERE p_retailprice > 950",
    "median_by_group": _with("scores", "SELECT benchmark_id, median(score) AS median_score FROM scores GROUP BY 1"),
    "min_max": _with("scores", "SELECT benchmark_id, min(score) AS min_score, max(score) AS max_score FROM scores GROUP BY 1"),
    "quantile_by_group": _with("scores", "SELECT benchmark_id, round(quantile_cont(score, 0.025), 8) AS lower, round(quantile_cont(score, 0.975), 8) AS upper FROM scores GROUP BY 1"),
    "fraction": _with("scores", "SELECT benchmark_id, round(avg((score <= 53)::INT), 8) AS low_fraction FROM scores GROUP BY 1"),
    "match_statistics": _with(
        "named",
        """, n AS (SELECT name, count(*) AS n FROM candidates GROUP BY 1)
SELECT 'parts' AS benchmark_id, count(*) FILTER (n > 0) AS matched, count(*) FILTER (n = 0) AS unmatched, count(*) FILTER (n > 1) AS several FROM n""",
    ),
    "summary": _with(
        "scores elos pairs ranks",
        """, g AS (SELECT benchmark_id, count(*) AS n, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rho FROM ranks GROUP BY 1)
SELECT round(avg(rho), 8) AS mean_rho, round(avg(n), 8) AS mean_n, count(rho) AS n_rho FROM g""",
    ),
    "competition_rank": _with("scores", "SELECT benchmark_id, model_id, score, (rank() OVER (PARTITION BY benchmark_id ORDER BY score DESC))::INT AS rank FROM scores"),
    "min_rank_in_universe": _with("scores elos universe", "SELECT benchmark_id, model_id, (rank() OVER (PARTITION BY benchmark_id ORDER BY score DESC))::INT AS rank FROM scores SEMI JOIN universe USING (model_id)"),
    "midrank": _with("scores", "SELECT benchmark_id, model_id, rank() OVER (PARTITION BY benchmark_id ORDER BY score DESC) + (count(*) OVER (PARTITION BY benchmark_id, score) - 1) / 2.0::DOUBLE AS rank FROM scores"),
    "dup_suffix": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) AS k FROM part)
SELECT p_partkey, p_type, CASE WHEN k > 1 THEN p_name || '(' || k || ')' ELSE p_name END AS name FROM n""",
    "position_tiebreak": _with(
        "scores elos pairs",
        """SELECT benchmark_id, model_id, (row_number() OVER (PARTITION BY benchmark_id ORDER BY score DESC, model_id))::INT AS by_score,
  (row_number() OVER (PARTITION BY benchmark_id ORDER BY elo DESC, model_id))::INT AS by_elo FROM pairs""",
    ),
    "first_per_key": "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1",
    "column_min_flag": _with("scores", "SELECT benchmark_id, model_id, score, score = min(score) OVER (PARTITION BY benchmark_id) AS is_minimum FROM scores"),
    "set_union": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_except": "SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "union_all": _with(
        "scores",
        """, g AS (SELECT benchmark_id, round(stddev_samp(score) / nullif(avg(score), 0), 8) AS value FROM scores GROUP BY 1)
SELECT * FROM g UNION ALL SELECT 'mean', round(avg(value), 6) FROM g""",
    ),
    "top_report": _with("scores elos pairs ranks", "SELECT benchmark_id, count(*) AS n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 8) AS rho FROM ranks GROUP BY 1 ORDER BY rho DESC, benchmark_id LIMIT 3"),
    "spearman": _with("scores elos pairs ranks", "SELECT benchmark_id, count(*) AS n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 8) AS rho FROM ranks GROUP BY 1"),
    "spearman_category": _with(
        "scores category_elos",
        """, r AS (
  SELECT benchmark_id, category,
    rank() OVER (PARTITION BY benchmark_id, category ORDER BY score) + (count(*) OVER (PARTITION BY benchmark_id, category, score) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY benchmark_id, category ORDER BY elo) + (count(*) OVER (PARTITION BY benchmark_id, category, elo) - 1) / 2.0::DOUBLE AS ry
  FROM scores JOIN category_elos USING (model_id))
SELECT benchmark_id, category, count(*) AS n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 8) AS rho FROM r GROUP BY 1, 2""",
    ),
    "pearson": _with("scores elos pairs", "SELECT benchmark_id, count(*) AS n, round(covar_pop(score, elo) / nullif(stddev_pop(score) * stddev_pop(elo), 0), 8) AS r FROM pairs GROUP BY 1"),
    "fisher_ci": _with(
        "scores elos pairs",
        """, g AS (SELECT benchmark_id, count(*) AS n, covar_pop(score, elo) / nullif(stddev_pop(score) * stddev_pop(elo), 0) AS r FROM pairs GROUP BY 1)
SELECT benchmark_id, CASE WHEN n > 3 AND abs(r) < 1 THEN round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 8) END AS ci_lower,
  CASE WHEN n > 3 AND abs(r) < 1 THEN round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 8) END AS ci_upper FROM g""",
    ),
    "kendall": _with(
        "scores elos pairs",
        """, g AS (
  SELECT a.benchmark_id, sum(sign(a.score - b.score) * sign(a.elo - b.elo)) AS s, sum(abs(sign(a.score - b.score))) AS ux, sum(abs(sign(a.elo - b.elo))) AS uy
  FROM pairs a JOIN pairs b ON a.benchmark_id = b.benchmark_id AND a.model_id < b.model_id GROUP BY 1
), tx AS (
  SELECT benchmark_id, sum(t * (t - 1)) AS t2, sum(t * (t - 1) * (2 * t + 5)) AS t5, sum(t * (t - 1) * (t - 2)) AS t3 FROM (SELECT benchmark_id, count(*)::DOUBLE AS t FROM pairs GROUP BY benchmark_id, score) GROUP BY 1
), ty AS (
  SELECT benchmark_id, sum(t * (t - 1)) AS t2, sum(t * (t - 1) * (2 * t + 5)) AS t5, sum(t * (t - 1) * (t - 2)) AS t3 FROM (SELECT benchmark_id, count(*)::DOUBLE AS t FROM pairs GROUP BY benchmark_id, elo) GROUP BY 1
), c AS (SELECT benchmark_id, count(*)::DOUBLE AS n FROM pairs GROUP BY 1)
SELECT benchmark_id, n::BIGINT AS n, round(s / nullif(sqrt(ux::DOUBLE * uy::DOUBLE), 0), 8) AS tau,
  round(s / sqrt((n * (n - 1) * (2 * n + 5) - tx.t5 - ty.t5) / 18 + tx.t2 * ty.t2 / (2 * n * (n - 1)) + tx.t3 * ty.t3 / (9 * n * (n - 1) * (n - 2))), 6) AS z
FROM g JOIN tx USING (benchmark_id) JOIN ty USING (benchmark_id) JOIN c USING (benchmark_id)""",
    ),
    "rbo": _with(
        "scores elos pairs",
        """, p AS (
  SELECT benchmark_id, row_number() OVER (PARTITION BY benchmark_id ORDER BY score DESC, model_id) AS a, row_number() OVER (PARTITION BY benchmark_id ORDER BY elo DESC, model_id) AS b FROM pairs
), o AS (
  SELECT x.benchmark_id, x.a AS d, count(*) FILTER (greatest(y.a, y.b) <= x.a) AS overlap FROM p x JOIN p y USING (benchmark_id) GROUP BY 1, 2)
SELECT benchmark_id, max(d)::INT AS k, round(least(1, greatest(0, sum((1 - 0.9::DOUBLE) * pow(0.9::DOUBLE, d - 1) * overlap / d) + pow(0.9::DOUBLE, max(d)))), 8) AS rbo FROM o GROUP BY 1""",
    ),
    "linregress": _with(
        "scores elos pairs",
        """, g AS (
  SELECT benchmark_id, count(*) AS n, regr_slope(score, elo) AS slope, regr_intercept(score, elo) AS intercept, covar_pop(score, elo) / nullif(stddev_pop(score) * stddev_pop(elo), 0) AS r, var_pop(elo) AS vx, var_pop(score) AS vy FROM pairs GROUP BY 1)
SELECT benchmark_id, n, round(slope, 9) AS slope, round(intercept, 6) AS intercept, round(r, 8) AS r, round(CASE WHEN n > 2 THEN sqrt((1 - r * r) * vy / nullif(vx * (n - 2), 0)) END, 9) AS stderr FROM g""",
    ),
    "kruskal": """WITH v AS (
  SELECT s_nationkey % 4 AS grp, floor(s_acctbal / 100) AS value FROM supplier
), r AS (
  SELECT grp, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY value)::DOUBLE AS t FROM v
), g AS (SELECT grp, count(*)::DOUBLE AS n, sum(r) AS s, sum(t * t - 1) AS c FROM r GROUP BY 1)
SELECT 'suppliers' AS "all", sum(n)::BIGINT AS n, count(*) AS k, round((12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / nullif(1 - sum(c) / (pow(sum(n), 3) - sum(n)), 0), 8) AS h FROM g""",
    "holm": _with("tests holm", "SELECT * FROM holm"),
    "correction_statistics": _with("tests holm", "SELECT count(*) FILTER (is_significant) AS n_significant, count(*) AS n_tests FROM holm"),
    "bootstrap_ci": _with(
        "scores",
        """, placed AS (
  SELECT benchmark_id, row_number() OVER (PARTITION BY benchmark_id ORDER BY model_id) - 1 AS place, count(*) OVER (PARTITION BY benchmark_id) AS n, score FROM scores
), asked AS (
  SELECT benchmark_id, draw, (((((((draw * 104729 + place * 7919 + 42) % 2147483648) * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648) // 64) % n AS place FROM placed, range(2000) t(draw)
), drawn AS (SELECT benchmark_id, draw, avg(score) AS s FROM asked JOIN placed USING (benchmark_id, place) GROUP BY 1, 2)
SELECT benchmark_id, round(quantile_cont(s, 0.025), 8) AS ci_lower, round(quantile_cont(s, 0.975), 8) AS ci_upper FROM drawn GROUP BY 1""",
    ),
    "binomial_se": _with("scores", "SELECT benchmark_id, model_id, round(sqrt(score / 100.0 * (1 - score / 100.0) / n_lines) * 100, 8) AS score_sd, round(score / 1.96::DOUBLE, 8) AS elo_sd FROM scores WHERE score <= 100"),
    "parse_score": """WITH t AS (
  SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN b || '%' WHEN 1 THEN b || ' ±6' WHEN 2 THEN '--' WHEN 3 THEN b || 'Preliminary' WHEN 4 THEN ' ' || b || '%±2.9%' WHEN 5 THEN '1_000' WHEN 6 THEN '' ELSE b END AS score_text
  FROM (SELECT c_custkey, c_acctbal::DECIMAL(12, 1)::VARCHAR AS b FROM customer)
), s AS (
  SELECT *, trim(replace(regexp_replace(trim(score_text), '±.*$', ''), '%', '')) AS a, trim(regexp_replace(replace(trim(score_text), 'Preliminary', ''), '±.*$', '')) AS b, regexp_replace(score_text, '[^0-9.]', '', 'g') AS c FROM t)
SELECT c_custkey, score_text, """
    + ", ".join(f"CASE WHEN regexp_full_match({c}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({c} AS DOUBLE) END AS {n}" for c, n in (("a", "score"), ("b", "preliminary_score"), ("c", "digits_score")))
    + " FROM s",
    "scale_score": _with("scores", "SELECT CASE benchmark_id WHEN 'PROMO' THEN 'GPQA' WHEN 'SMALL' THEN 'IFEval' ELSE benchmark_id END AS benchmark_id, model_id, CASE WHEN benchmark_id IN ('PROMO', 'SMALL') THEN score * 100 ELSE score END AS scaled FROM scores"),
    "strip_prefix": """SELECT p_partkey, regexp_replace(CASE p_partkey % 4 WHEN 0 THEN 'OpenAI/' WHEN 1 THEN 'google/' WHEN 2 THEN 'nobody/' ELSE '' END || p_name,
  '^(openai|google|anthropic|alibaba|fireworks|grok|kimi|minimax|mistralai|cohere|ai21labs|together|zai)/', '', 'i') AS name FROM part""",
    "strip_suffix": """SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  p_name || CASE p_partkey % 4 WHEN 0 THEN 'OpenAI' WHEN 1 THEN ' Mistral AI' WHEN 2 THEN 'GoogleNVIDIA' ELSE '' END, 'Mistral AI$', ''), 'NVIDIA$', ''), 'OpenAI$', ''), 'Google$', '')) AS name FROM part""",
    "sanitize_id": "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[^0-9A-Za-z_-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS id FROM pages",
    "path_id": "SELECT p_partkey, p_brand AS id FROM part",
    "date_ordinal": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN date_diff('day', DATE '2021-01-01', o_orderdate::DATE)::INT END AS day_number FROM orders",
    "log": "SELECT p_partkey, round(ln(p_size), 10) AS log_size FROM part",
    "json_field": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "null_safe_match": _with("named", "SELECT key, c_key, version, parameters, c_parameters FROM candidates"),
    "match_top1_similarity": _with(
        "named",
        """, s AS (
  SELECT key, c_key, round(least(1.0::DOUBLE, 0.5::DOUBLE * (len(list_intersect(t, c_t))::DOUBLE / len(list_distinct(list_concat(t, c_t))))
    + 0.2::DOUBLE * CASE WHEN date = c_date THEN 1.0 WHEN date IS NOT NULL AND c_date IS NOT NULL THEN CASE WHEN left(date, 4) = left(c_date, 4) THEN 0.5 ELSE 0.0 END WHEN date IS NOT NULL OR c_date IS NOT NULL THEN 0.2 ELSE 0.0 END::DOUBLE
    + 0.2::DOUBLE * CASE WHEN lower(parameters) = lower(c_parameters) THEN 1.0 WHEN parameters IS NOT NULL AND c_parameters IS NOT NULL THEN 0.0 WHEN parameters IS NOT NULL OR c_parameters IS NOT NULL THEN 0.3 ELSE 0.0 END::DOUBLE
    + 0.1::DOUBLE * CASE WHEN subfamily = c_subfamily THEN 1.0 WHEN subfamily IS NOT NULL AND c_subfamily IS NOT NULL THEN CASE WHEN contains(subfamily, c_subfamily) OR contains(c_subfamily, subfamily) THEN 0.5 ELSE 0.0 END
      WHEN subfamily IS NOT NULL OR c_subfamily IS NOT NULL THEN 0.2 ELSE 0.0 END::DOUBLE), 10) AS similarity FROM candidates
), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY similarity DESC, c_key) AS k, count(*) OVER (PARTITION BY key) AS n FROM s)
SELECT key, c_key, similarity FROM r WHERE k = 1 AND (n = 1 OR similarity >= 0.3)""",
    ),
    "report_format_p": _with(
        "tests",
        """SELECT test, CASE WHEN p > 0.04 THEN 'N/A' WHEN p / 7 < 0.001 THEN printf('%.2e', p / 7) ELSE printf('%.4f', p / 7) END AS p_text FROM tests""",
    ),
    "fig1_ranks": _with(
        "scores elos pairs",
        """SELECT model_id::VARCHAR AS model_id, coalesce(s_name, model_id::VARCHAR) AS display_name, rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS board_rank,
  rank() OVER (ORDER BY elo DESC) + (count(*) OVER (PARTITION BY elo) - 1) / 2.0::DOUBLE AS arena_rank FROM pairs LEFT JOIN supplier ON s_suppkey = model_id AND s_acctbal > 0 WHERE benchmark_id = 'PROMO'""",
    ),
}
SQL |= {
    "html_table": "SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS row_no, n_nationkey::VARCHAR AS key, n_name AS model FROM nation",
    "css_rows": "SELECT r_regionkey, 0 AS row_no, r_name AS model_key, r_regionkey || '% ±1%' AS score, r_regionkey || '%' AS score_value, '±1%' AS score_error FROM region",
    "embedded_json": "SELECT s_nationkey, s_name AS model_name, 'accuracy' AS metric, s_suppkey::VARCHAR AS value FROM supplier UNION ALL SELECT s_nationkey, s_name, 'plain', 'p' FROM supplier",
    "split_boards": "SELECT 'a' AS benchmark_id, s_suppkey AS row_no, s_name AS model_raw, s_nationkey::VARCHAR AS score_raw FROM supplier UNION ALL SELECT 'b', s_suppkey, s_name, NULL FROM supplier",
    "mapping_first_wins": "SELECT 'b' AS benchmark_id, arg_min(c_name, c_custkey) AS model_name, 'id' || c_nationkey AS model_id FROM customer WHERE c_custkey % 7 > 1 GROUP BY c_nationkey",
    "arena_last_row": "SELECT c_mktsegment AS category, 'm' || c_nationkey AS model_id, max(c_custkey)::DOUBLE AS elo, round(6 / 1.96::DOUBLE, 8) AS elo_sd FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1, 2",
    "clean_boards": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 9 <> 0)
SELECT p_type AS benchmark_id, CASE WHEN k > 1 THEN p_name || '(' || k || ')' ELSE p_name END AS model_name, p_size::DOUBLE AS score, (rank() OVER (PARTITION BY p_type ORDER BY p_size DESC))::INT AS rank, p_partkey AS row_no FROM r""",
    "model_list": "SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'openai/' ELSE '' END || p_name AS model_name FROM part WHERE p_partkey % 9 <> 0",
    "duplicate_review": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 9 <> 0
), n AS (SELECT *, CASE WHEN k > 1 THEN p_name || '(' || k || ')' ELSE p_name END AS name FROM r)
SELECT p_type AS benchmark_id, CASE WHEN p_partkey < 40 THEN 'new ' || name ELSE name END AS model_name, (rank() OVER (PARTITION BY p_type ORDER BY p_size DESC))::INT AS rank, p_partkey AS row_no
FROM n WHERE p_partkey >= 40 OR p_partkey % 2 = 1""",
}
SQL = {k: v.replace(")\n, ", "),\n").replace("\n, ", ",\n", 1) if v.startswith("WITH") else v for k, v in SQL.items()}


def _ctes(parts: str, body: str, **more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([BASE[p] for p in parts.split()] + [f"{n} AS ({c})" for n, c in more.items()]) + "\n" + body


#: The two-sided p of Student's t with nu degrees of freedom by its finite sums; th: the angle whose tangent is |t| / sqrt(nu).
_T_P = """(1 - CASE WHEN nu % 2 = 0 THEN sin(th) * list_sum(list_transform(range(nu // 2), lambda k: exp(lgamma(k + 0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE)) * pow(cos(th), 2 * k))) / sqrt(pi())
    ELSE 2 / pi() * (th + CASE WHEN nu > 1 THEN sin(th) * list_sum(list_transform(range((nu - 1) // 2), lambda k: exp(lgamma(k + 1.0::DOUBLE) - lgamma(k + 1.5::DOUBLE)) * pow(cos(th), 2 * k + 1))) * sqrt(pi()) / 2 ELSE 0 END) END)"""
#: The complementary error function of z >= 0, which is nothing in 15 decimals from 6 on.
_ERFC = "(1 - CASE WHEN z = 0 THEN 0 ELSE exp(-(least(z, 6) ** 2)) * list_sum(list_transform(range(150), lambda k: exp((2 * k + 1) * ln(least(z, 6)) - lgamma(k + 1.5::DOUBLE)))) END)"
_RHO = "SELECT benchmark_id, count(*) AS n, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS r FROM ranks GROUP BY 1"
_R = "SELECT benchmark_id, count(*) AS n, covar_pop(score, elo) / nullif(stddev_pop(score) * stddev_pop(elo), 0) AS r FROM pairs GROUP BY 1"
_OF_R = f"SELECT *, CASE WHEN abs(r) >= 1 THEN 0 ELSE {_T_P} END AS p FROM (SELECT *, asin(least(1, abs(r))) AS th, n - 2 AS nu FROM g WHERE n > 2) UNION ALL SELECT *, NULL, NULL, NULL FROM g WHERE n <= 2"
_KENDALL = SQL["kendall"].rpartition("SELECT benchmark_id, n::BIGINT AS n")[0] + SQL["kendall"].rpartition("SELECT benchmark_id, n::BIGINT AS n")[2].replace(", round(s / nullif(sqrt(ux::DOUBLE * uy::DOUBLE), 0), 8) AS tau", "SELECT benchmark_id, s / nullif(sqrt(ux::DOUBLE * uy::DOUBLE), 0) AS tau").replace("round(s / sqrt(", "s / sqrt(").replace(", 6) AS z", " AS z")
_BOARD_FILES = "SELECT r_name || ' board' AS benchmark_id, n_regionkey AS region, n_nationkey AS key, CASE WHEN n_regionkey = 0 THEN '模型 ' ELSE '' END || n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey"
_FIGURES = """SELECT CASE WHEN p_partkey % 50 = 0 THEN 'Creative Writing v3' ELSE p_partkey::VARCHAR END AS benchmark_id, p_size, ['Applying', 'Analyzing', 'Evaluating', 'Creating'][p_size % 4 + 1] AS complexity,
  CASE WHEN p_size % 7 > 0 THEN make_date(2025, 1, p_size % 28 + 1) END AS day, p_retailprice AS y, p_size * 2.0::DOUBLE AS difficulty, p_size / 64.0::DOUBLE AS cv FROM part"""
# the fit's state: one row a group with its values as lists, the coefficients and the last loss; t and the scale's divisor are fixed
_HUBER = """SELECT benchmark_id, xs, ys, n, b0, b1, NULL::DOUBLE AS before, 0 AS k, false AS done FROM (SELECT benchmark_id, list(elo) AS xs, list(score) AS ys, count(*) AS n, regr_intercept(score, elo) AS b0, regr_slope(score, elo) AS b1 FROM pairs GROUP BY 1)
  UNION ALL
  SELECT benchmark_id, xs, ys, n, CASE WHEN stop THEN b0 ELSE my - nb * mx END, CASE WHEN stop THEN b1 ELSE nb END, loss, k + 1, stop FROM (
    SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: w[i] * (xs[i] - mx) * (ys[i] - my))) / list_sum(list_transform(range(1, n + 1), lambda i: w[i] * (xs[i] - mx) ** 2)) AS nb FROM (
      SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: w[i] * xs[i])) / list_sum(w) AS mx, list_sum(list_transform(range(1, n + 1), lambda i: w[i] * ys[i])) / list_sum(w) AS my FROM (
        SELECT *, s = 0 OR coalesce(abs(before - loss) <= 1e-8, false) AS stop, list_transform(u, lambda v: least(1.0, 1.345::DOUBLE / greatest(v, 1e-300))) AS w FROM (
          SELECT *, list_sum(list_transform(u, lambda v: CASE WHEN v <= 1.345::DOUBLE THEN 0.5 * v * v ELSE 1.345::DOUBLE * v - 0.5 * 1.345::DOUBLE * 1.345::DOUBLE END)) AS loss FROM (
            SELECT *, list_transform(r, lambda v: v / nullif(s, 0)) AS u FROM (
              SELECT *, list_median(r) / 0.6744897501960817::DOUBLE AS s FROM (
                SELECT *, list_transform(range(1, n + 1), lambda i: abs(ys[i] - b0 - b1 * xs[i])) AS r FROM fit WHERE NOT done AND k < 50)))))))"""
_NUMBER = "CASE WHEN {0} IS NULL THEN 'N/A' ELSE printf('%.{1}f', {0}) END"


def _number(c: str, digits: int = 3) -> str:
    return _NUMBER.format(c, digits)


def _marked(how: str, text: str, when: str) -> str:
    return f"CASE WHEN {when} THEN '\\text{how}{{' || {text} || '}}' ELSE {text} END"


SQL |= {
    "spearman_pvalue": _ctes("scores elos pairs ranks", "SELECT benchmark_id, n, round(r, 8) AS rho, round(p, 8) AS pvalue FROM tested", g=_RHO, tested=_OF_R),
    "pearson_pvalue": _ctes("scores elos pairs", "SELECT benchmark_id, n, round(r, 8) AS r, round(p, 8) AS pvalue FROM tested", g=_R, tested=_OF_R),
    "linregress_pvalue": _ctes(
        "scores elos pairs",
        "SELECT benchmark_id, round(slope, 9) AS slope, round(p, 8) AS pvalue FROM tested JOIN slopes USING (benchmark_id)",
        g=_R,
        tested=_OF_R,
        slopes="SELECT benchmark_id, regr_slope(score, elo) AS slope FROM pairs GROUP BY 1",
    ),
    "kendall_pvalue": f"SELECT benchmark_id, round(tau, 8) AS tau, round({_ERFC}, 6) AS pvalue FROM (SELECT *, abs(z0) / sqrt(2) AS z FROM (SELECT benchmark_id, tau, z AS z0 FROM ({_KENDALL}) k) x) y",
    "kruskal_pvalue": f'SELECT "all", h, round({_ERFC} + sqrt(2 * h / pi()) * exp(-h / 2), 8) AS pvalue FROM (SELECT *, sqrt(h / 2) AS z FROM ({SQL["kruskal"]}) k WHERE k = 4) x',
    "huber": _ctes(
        "scores elos pairs",
        f"SELECT benchmark_id, term, round(coefficient, 6) AS coefficient, round({_ERFC}, 8) AS pvalue FROM terms",
        fit=_HUBER,
        last="SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY benchmark_id ORDER BY k DESC) = 1",
        scaled="SELECT *, list_transform(range(1, n + 1), lambda i: ys[i] - b0 - b1 * xs[i]) AS r FROM last",
        middled="SELECT *, list_median(list_transform(r, lambda v: abs(v))) / 0.6744897501960817::DOUBLE AS s, list_avg(xs) AS mx FROM scaled",
        sums="""SELECT *, list_avg(list_transform(r, lambda v: (abs(v / s) <= 1.345::DOUBLE)::INT::DOUBLE)) AS m, list_sum(list_transform(r, lambda v: greatest(-1.345::DOUBLE, least(1.345::DOUBLE, v / s)) ** 2)) AS psi,
    list_sum(list_transform(xs, lambda v: (v - mx) ** 2)) AS sxx FROM middled""",
        factors="SELECT *, (1 + 2.0 / n * (m * (1 - m)) / (m * m)) ** 2 * (psi / (n - 2)) * s * s / (m * m) AS f FROM sums",
        terms="""SELECT benchmark_id, 'intercept' AS term, b0 AS coefficient, abs(b0) / sqrt(f * (1.0 / n + mx * mx / sxx)) / sqrt(2) AS z FROM factors
  UNION ALL SELECT benchmark_id, 'elo', b1, abs(b1) / sqrt(f / sxx) / sqrt(2) FROM factors""",
    ),
    "parse_identity": """SELECT DISTINCT name, family, subfamily, version, date, parameters, other_info FROM (
  SELECT CASE k WHEN 0 THEN 'gpt-' || b || '-pro-2025-01-1' || c WHEN 1 THEN 'Qwen' || a || ['-Coder 70B', '-coder 80 B', ' Coder 7B'][c + 1] WHEN 2 THEN 'claude-opus-4-' || b || '-20250805-thinking'
      WHEN 3 THEN 'o' || o || '-mini-high' WHEN 4 THEN 'google/gemini-' || a || '.5-flash-lite non thinking' ELSE 'mystery thing ' || b END AS name,
    CASE k WHEN 0 THEN 'gpt' WHEN 1 THEN 'qwen' WHEN 2 THEN 'claude' WHEN 3 THEN 'gpt' WHEN 4 THEN 'gemini' END AS family,
    CASE k WHEN 0 THEN 'gpt-pro' WHEN 1 THEN 'qwen-coder' WHEN 2 THEN 'claude-opus' WHEN 3 THEN 'o' || o WHEN 4 THEN 'gemini-flash-lite' END AS subfamily,
    CASE k WHEN 0 THEN b || '.0' WHEN 1 THEN a || '.0' WHEN 2 THEN '4.' || b WHEN 3 THEN o || '.0' WHEN 4 THEN a || '.5' ELSE b || '.0' END AS version,
    CASE k WHEN 0 THEN '2025-01-1' || c WHEN 2 THEN '20250805' END AS date, CASE WHEN k = 1 THEN ['70B', '80 B', '7B'][c + 1] END AS parameters,
    CASE k WHEN 2 THEN 'thinking' WHEN 3 THEN 'mini high' WHEN 4 THEN 'google/gemini non-thinking' WHEN 5 THEN 'mystery thing' END AS other_info
  FROM (SELECT p_partkey % 6 AS k, p_size % 6 + 1 AS a, p_size % 9 + 1 AS b, p_size % 3 AS c, p_size % 5 + 1 AS o FROM part))""",
    # a version is the last digit of the size, none for a nought; "ring" is a family and longer than gpt; all else is equal
    "review_candidates": """WITH v AS (SELECT p_type, p_size, p_name, nullif(p_size % 10, 0) AS ver, contains(p_name, ' ring') AS ring FROM part), c AS (SELECT ver, ring, count(*) AS k FROM v GROUP BY 1, 2)
SELECT p_type AS benchmark_id, count(*) FILTER (k > 0) AS matched, 0::BIGINT AS unmatched, count(*) FILTER (k > 1) AS several FROM (SELECT DISTINCT * FROM v) n JOIN c ON n.ver IS NOT DISTINCT FROM c.ver AND n.ring = c.ring GROUP BY 1""",
    "norm_version": "SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN p_size || '.5' WHEN 3 THEN 'x' ELSE p_size || '.0' END AS version FROM part",
    "ordinal_map": "SELECT c_custkey, CASE WHEN c_custkey % 5 < 4 THEN (c_custkey % 5 + 1)::INT END AS level FROM customer",
    "category_to_elo": """SELECT c_custkey, ['elo_coding', 'elo_creative_writing', 'elo_expert', 'elo_hard_prompts', 'elo_instruction_following', 'elo_math'][c_custkey % 7 + 1] AS elo_column,
  ['Coding', 'CW', 'Expert', 'HP', 'IF', 'Math'][c_custkey % 7 + 1] AS short FROM customer""",
    "clean_model_name": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || 'Mistral AI' WHEN 1 THEN 'openai/' || p_name ELSE 'openai/' || p_name || 'Mistral AI' END AS name FROM part",
    "conclusions": _ctes(
        "tests holm",
        """SELECT test, CASE WHEN num % 7 < 5 THEN left(test, 2) || ' (' || ['Scale', 'Complexity', 'Recency', 'Variance', 'Difficulty'][num % 7 + 1] || ')' ELSE test END AS name,
  CASE WHEN num = 3 THEN 'Insufficient data for statistical testing.' ELSE CASE WHEN is_significant THEN 'Statistically' ELSE 'Not statistically' END || ' significant after correction' || printf(' (p_corrected = %.4f). ', p_corrected)
    || CASE WHEN num % 5 > 0 THEN printf('%s = %.3f.', ['Effect size (β)', 'Spearman correlation (ρ)', 'Pearson correlation (r)', 'Ordinal-regression effect size (R²)', 'Median difference', 'Effect size'][num % 6 + 1], num / 8.0::DOUBLE) ELSE '' END END AS conclusion FROM n""",
        m="SELECT *, regexp_extract(test, '([0-9]+)$', 1)::INT AS num FROM holm",
        n="SELECT 'H' || (num % 7 + 1) || '_' || num AS test, num, p_corrected, is_significant FROM m",
    ),
    "overall_correlations": _ctes(
        "scores elos pairs ranks",
        f"""SELECT benchmark_id, 'CW' AS category, {_marked("bf", _number("a"), "a < 0")} AS spearman_rho_overall, {_marked("bf", _number("b"), "b < 0")} AS kendall_tau_overall, 'N/A' AS rbo_overall FROM signed""",
        s=_RHO,
        q=_R,
        signed="SELECT benchmark_id, CASE WHEN benchmark_id = 'PROMO' THEN -s.r ELSE s.r END AS a, CASE WHEN benchmark_id = 'PROMO' THEN -q.r ELSE q.r END AS b FROM s JOIN q USING (benchmark_id)",
    ),
    "reference_report": f"""WITH c AS (SELECT benchmark_id, d.difficulty AS x, reference_difficulty AS y FROM ({SQL["ref_difficulty"]}) f LEFT JOIN ({SQL["difficulty"]}) d USING (benchmark_id)
), g AS (SELECT count(*) AS n, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS r FROM c WHERE x IS NOT NULL AND y IS NOT NULL
), tested AS ({_OF_R}
), told AS (SELECT *, CASE WHEN n > 3 AND abs(r) < 1 THEN '[' || printf('%.3f', tanh(atanh(r) - 1.96 / sqrt(n - 3))) || ', ' || printf('%.3f', tanh(atanh(r) + 1.96 / sqrt(n - 3))) || ']' ELSE '[null, null]' END AS ci FROM tested)
SELECT benchmark_id AS row, {_number("x", 1)} AS difficulty, {_number("y", 1)} AS reference_difficulty FROM c UNION ALL SELECT 'Pearson r', {_number("r")}, '' FROM told UNION ALL SELECT '95% CI', ci, '' FROM told
UNION ALL SELECT 'p', CASE WHEN p IS NULL THEN 'N/A' WHEN p < 0.001 THEN printf('%.2e', p) ELSE printf('%.4f', p) END, '' FROM told""",
    "report_summary": f"""WITH a AS ({_ctes("scores elos pairs ranks", "SELECT benchmark_id, n, r, p FROM tested", g=_RHO, tested=_OF_R)}
), b AS (SELECT benchmark_id, tau, {_ERFC} AS q FROM (SELECT benchmark_id, tau, abs(z0) / sqrt(2) AS z FROM (SELECT benchmark_id, tau, z AS z0 FROM ({_KENDALL}) k) x) y
), c AS ({SQL["rbo"]}
), j AS (SELECT *, min(r) OVER () AS r0, min(tau) OVER () AS t0, min(rbo) OVER () AS o0 FROM a JOIN b USING (benchmark_id) JOIN c USING (benchmark_id))
SELECT {_marked("it", "benchmark_id", "p > 0.05 AND q > 0.05")} AS benchmark, 'HP' AS category, n::VARCHAR AS n, {_marked("it", "(" + _marked("bf", _number("r"), "r = r0") + ")", "p > 0.05")} AS spearman,
  {_marked("it", "(" + _marked("bf", _number("tau"), "tau = t0") + ")", "q > 0.05")} AS kendall, {_marked("bf", _number("rbo"), "rbo = o0")} AS rbo FROM j""",
    "uncertainty_inputs": _ctes(
        "scores category_elos",
        """SELECT benchmark_id, model_id, score, round(sqrt(score / 100.0 * (1 - score / 100.0) / q) * 100, 8) AS score_sd, elo, elo / 20 AS elo_sd
FROM scores JOIN counts USING (benchmark_id) JOIN category_elos USING (model_id) WHERE category = 'ASIA' AND score <= 100""",
        counts="SELECT benchmark_id, count(*) AS q FROM scores GROUP BY 1",
    ),
    "figure_scale": f"SELECT benchmark_id, round(ln(p_size), 8) AS x, y FROM ({_FIGURES}) f",
    "figure_complexity": f"SELECT benchmark_id, complexity, (p_size % 4 + 1)::INT AS x, y, round(median(y) OVER (PARTITION BY complexity), 8) AS group_median FROM ({_FIGURES}) f",
    "figure_recency": f"SELECT benchmark_id, date_diff('day', DATE '2021-01-01', day)::INT AS x, y FROM ({_FIGURES}) f",
    "figure_difficulty": f"SELECT benchmark_id, difficulty AS x, y, cv, cv > median(cv) OVER () AS high_variation FROM ({_FIGURES}) f WHERE benchmark_id <> 'Creative Writing v3'",
    "csv_round_trip": "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS s_acctbal FROM supplier",
    "board_files": f"SELECT benchmark_id, name AS model_name, key + 0.5::DOUBLE AS score, (rank() OVER (PARTITION BY benchmark_id ORDER BY key DESC))::INT AS rank, row_number() OVER (PARTITION BY benchmark_id ORDER BY key) - 1 AS row_no FROM ({_BOARD_FILES}) b",
    "source_csv": f"""SELECT benchmark_id, (row_number() OVER (PARTITION BY benchmark_id ORDER BY key) - 1)::INT AS row_no, name AS model, key || '.5%' AS score_text FROM ({_BOARD_FILES}) b
UNION ALL SELECT benchmark_id, count(*)::INT, 'nobody', '--' FROM ({_BOARD_FILES}) b GROUP BY 1""",
    "source_best_table": "SELECT 'ARC-AGI-2' AS benchmark_id, (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS row_no, NULL::VARCHAR AS model, n_name AS team, n_nationkey::VARCHAR AS score_text FROM nation UNION ALL SELECT 'Other', 0, 'none', NULL, NULL",
    "source_combined": "WITH r AS (SELECT *, (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS row_no FROM nation) SELECT 'A' AS benchmark_id, row_no, n_name AS model_raw, n_regionkey::VARCHAR AS score_raw FROM r UNION ALL SELECT 'B (x)', row_no, n_name, n_nationkey || '%' FROM r",
    "json_mapping": "SELECT (row_number() OVER (ORDER BY n_nationkey DESC) - 1)::INT AS pos, n_name AS model_name, 'id ' || n_regionkey AS model_id FROM nation",
    "json_metadata": "SELECT n_name AS benchmark_id, n_nationkey::INT AS question_count, 'Math' AS category FROM nation WHERE n_nationkey % 4 <> 0",
    "json_document": "SELECT n_name AS test, n_nationkey / 4.0::DOUBLE AS p, CASE WHEN n_regionkey > 1 THEN n_regionkey::BIGINT END AS region FROM nation",
    "wide_csv": _with(
        "scores",
        "SELECT s_suppkey AS model_id, "
        + ", ".join(f"max(score) FILTER (benchmark_id = '{t}') AS {t.lower()}" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
        + " FROM supplier LEFT JOIN scores ON model_id = s_suppkey GROUP BY 1",
    ),
    "benchmark_scores": _with("scores elos universe", "SELECT model_id, score, 6 AS columns FROM scores SEMI JOIN universe USING (model_id) WHERE benchmark_id = 'PROMO'"),
    "model_list_csv": SQL["model_list"],
    "cleaned_csv": f"SELECT benchmark_id, model_name, score, rank FROM ({SQL['clean_boards']}) c",
    "missing_names": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000",
    "latex_table": _with(
        "tests",
        r"""SELECT '\begin{table}' || chr(10) || '\caption{Tests}' || chr(10) || '\label{tab:tests}' || chr(10) || '\begin{tabular}{ll}' || chr(10) || '\toprule' || chr(10) || 'Test & p \\' || chr(10) || '\midrule' || chr(10)
  || string_agg(test || ' & ' || CASE WHEN p > 0.01 THEN printf('%.4f', p) ELSE 'N/A' END || ' \\', chr(10) ORDER BY test) || chr(10) || '\bottomrule' || chr(10) || '\end{tabular}' || chr(10) || '\end{table}' AS text FROM tests""",
    ),
}


def _state(stream: int = 0) -> str:
    return f"(((((draw * 104729 + place * 7919 + {42 + stream * 15485863}) % 2147483648) * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648"


def _normal(stream: int) -> str:
    u, v = (f"((({_state(2 * stream + k)}) + 0.5::DOUBLE) / 2147483648.0::DOUBLE)" for k in (0, 1))
    return f"sqrt(-2.0 * ln({u})) * cos(2.0 * pi() * {v})"


def _midrank(value: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0::DOUBLE"


_PLACED = "SELECT *, row_number() OVER (PARTITION BY benchmark_id ORDER BY model_id) - 1 AS place, count(*) OVER (PARTITION BY benchmark_id) AS n FROM pairs"
_CORR = "covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0)"
SQL |= {
    "bootstrap_rho": _ctes(
        "scores elos pairs",
        "SELECT benchmark_id, round(quantile_cont(r, 0.025), 8) AS ci_lower, round(quantile_cont(r, 0.975), 8) AS ci_upper FROM rho GROUP BY 1",
        placed=_PLACED,
        asked=f"SELECT benchmark_id, draw, ({_state()}) // 64 % n AS place FROM placed, range(2000) t(draw)",
        drawn="SELECT benchmark_id, draw, score, elo FROM asked JOIN placed USING (benchmark_id, place)",
        ranked=f"SELECT benchmark_id, draw, {_midrank('score', 'benchmark_id, draw')} AS rx, {_midrank('elo', 'benchmark_id, draw')} AS ry FROM drawn",
        rho=f"SELECT benchmark_id, draw, {_CORR} AS r FROM ranked GROUP BY 1, 2",
    ),
    "permutation_rho": _ctes(
        "scores elos pairs",
        """SELECT benchmark_id, any_value(n) AS n, round(any_value(s.r), 8) AS rho, round(least(1.0::DOUBLE, 2.0 * (least(count(*) FILTER (d.r >= s.r - 1e-9), count(*) FILTER (d.r <= s.r + 1e-9)) + 1) / 2001.0::DOUBLE), 8) AS permutation_p
FROM null_ d JOIN seen s USING (benchmark_id) GROUP BY 1""",
        placed=_PLACED,
        ranked=f"SELECT benchmark_id, place, {_midrank('score', 'benchmark_id')} AS rx, {_midrank('elo', 'benchmark_id')} AS ry FROM placed",
        seen=f"SELECT benchmark_id, count(*) AS n, {_CORR} AS r FROM ranked GROUP BY 1",
        turned=f"SELECT benchmark_id, draw, rx, row_number() OVER (PARTITION BY benchmark_id, draw ORDER BY {_state()}, place) - 1 AS place FROM ranked, range(2000) t(draw)",
        null_=f"SELECT benchmark_id, draw, {_CORR} AS r FROM (SELECT t.benchmark_id, draw, t.rx, k.ry FROM turned t JOIN ranked k ON t.benchmark_id = k.benchmark_id AND t.place = k.place) x GROUP BY 1, 2",
    ),
    "monte_carlo_rho": _ctes(
        "scores elos pairs",
        """SELECT benchmark_id, max(n) AS n, round(avg(r), 8) AS simulated_rho, round(quantile_cont(r, 0.025), 8) AS ci_lower, round(quantile_cont(r, 0.975), 8) AS ci_upper, round(avg((r <= 0)::INT), 8) AS nonpositive_fraction,
  quantile_cont(r, 0.025) > 0 AS stable FROM rho GROUP BY 1""",
        placed=_PLACED.replace("*, row", "*, sqrt(score / 100.0 * (1 - score / 100.0) / n_lines) * 100 AS score_sd, elo / 20 / 1.96::DOUBLE AS elo_sd, row", 1),
        noisy=f"SELECT benchmark_id, draw, score + score_sd * ({_normal(1)}) AS x, elo + elo_sd * ({_normal(2)}) AS y FROM placed, range(10000) t(draw)",
        ranked=f"SELECT benchmark_id, draw, {_midrank('x', 'benchmark_id, draw')} AS rx, {_midrank('y', 'benchmark_id, draw')} AS ry FROM noisy",
        rho=f"SELECT benchmark_id, draw, count(*) AS n, {_CORR} AS r FROM ranked GROUP BY 1, 2",
    ),
}


def _word(c: int, n: int) -> str:
    return f"'x' || translate((p_partkey * {c} % {n})::VARCHAR, '0123456789', 'bcfhjvwzkq')"


def _six(third: str) -> str:
    return f"[{_word(1, 3)}, {_word(7, 40)}, {third}, {_word(11, 90)}, {_word(13, 700)}, {_word(17, 50)}]"


SQL["match_unparsed"] = f"""WITH w AS (SELECT p_partkey AS pos, {_six(_word(5, 9))} AS t, {_six(_word(5, 11))} AS o FROM part),
names AS (SELECT DISTINCT t FROM w),
pairs AS (
  SELECT t, o, pos, len(list_intersect(list_distinct(t), list_distinct(o)))::DOUBLE / len(list_distinct(list_concat(t, o))) AS j
  FROM names JOIN (SELECT pos, o FROM w) x ON list_has_any(t, o)
)
SELECT 'parts' AS benchmark_id, array_to_string(t, ' ') AS model_name, array_to_string(o, ' ') AS lmarena_model FROM pairs WHERE 0.5::DOUBLE * j >= 0.3::DOUBLE
QUALIFY row_number() OVER (PARTITION BY t ORDER BY j DESC, pos) = 1"""


_BOTH = (
    BASE["category_elos"]
    + """,
pairs AS (SELECT benchmark_id || '|overall' AS benchmark_id, model_id, score, elo FROM scores JOIN elos USING (model_id)
  UNION ALL SELECT benchmark_id || '|category', model_id, score, elo FROM scores JOIN category_elos USING (model_id) WHERE category = 'ASIA')"""
)
_SIZES = """SELECT lpad(p_size::VARCHAR, 3, '0') AS benchmark_id, p_size, count(*) AS q, sum(p_partkey * 37 % 101) AS k, sum(p_partkey * p_partkey % 89) AS l FROM part GROUP BY p_size"""
_METRICS = """SELECT 'spearman_rho' AS metric, *, k::DOUBLE / q / 101 AS y FROM sizes UNION ALL SELECT 'kendall_tau', *, l::DOUBLE / q / 89 FROM sizes UNION ALL SELECT 'rbo', *, (k * 7 % 97) / 97.0::DOUBLE FROM sizes"""
_LINES = "SELECT n_nationkey AS k, n_name AS name, n_regionkey % 2 AS b, (row_number() OVER (PARTITION BY n_regionkey % 2 ORDER BY n_nationkey) - 1)::INT AS row_no FROM nation"
SQL |= {
    "agreement_table": f"""WITH a AS ({_ctes("scores elos pairs ranks", "SELECT benchmark_id, n, r, p FROM tested", g=_RHO, tested=_OF_R)}
), b AS (SELECT benchmark_id, tau, {_ERFC} AS q FROM (SELECT benchmark_id, tau, abs(z0) / sqrt(2) AS z FROM (SELECT benchmark_id, tau, z AS z0 FROM ({_KENDALL}) k) x) y
), c AS ({SQL["rbo"]}
)
SELECT split_part(benchmark_id, '|', 1) AS benchmark_id, split_part(benchmark_id, '|', 2) AS target, n, round(r, 8) AS spearman_rho, CASE WHEN n >= 30 THEN round(p, 8) END AS spearman_pvalue,
  round(tau, 8) AS kendall_tau, CASE WHEN n >= 30 THEN round(q, 6) END AS kendall_pvalue, rbo FROM a JOIN b USING (benchmark_id) JOIN c USING (benchmark_id)""".replace(BASE["pairs"], _BOTH),
    "hypothesis_tests": _ctes(
        "",
        f"""SELECT 'H1_' || metric AS test, 'pearson' AS primary_test, round(r, 6) AS statistic, round(r, 6) AS effect_size, round(p, 6) AS p_raw, n::INT AS sample_size FROM h1
UNION ALL SELECT 'H3_' || metric, 'spearman', round(r, 6), round(r, 6), round(p, 6), n::INT FROM h3
UNION ALL SELECT 'H2_' || metric, 'kruskal', round(h, 6), round(r2, 6), round({_ERFC} + sqrt(2 * h / pi()) * exp(-h / 2), 6), n::INT FROM h2""",
        sizes=_SIZES,
        rows=_METRICS,
        days="SELECT *, ln(q) AS x, make_date(2025, (p_size % 12 + 1)::INT, (10 + p_size % 7)::INT) AS day FROM rows",
        ranked=f"SELECT *, {_midrank('day', 'metric')} AS rx, {_midrank('y', 'metric')} AS ry, count(*) OVER (PARTITION BY metric, y)::DOUBLE AS t FROM days",
        pearson="SELECT metric, count(*) AS n, corr(x, y) AS r FROM days GROUP BY 1",
        spearman="SELECT metric, count(*) AS n, corr(rx, ry) AS r FROM ranked GROUP BY 1",
        h1=_OF_R.replace("FROM g", "FROM pearson"),
        h3=_OF_R.replace("FROM g", "FROM spearman"),
        groups="SELECT metric, p_size % 4 AS level, count(*)::DOUBLE AS n, sum(ry) AS s, sum(t * t - 1) AS c FROM ranked GROUP BY 1, 2",
        kruskal="SELECT metric, sum(n) AS n, (12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - sum(c) / (pow(sum(n), 3) - sum(n))) AS h FROM groups GROUP BY 1",
        h2="SELECT metric, n, h, r2, sqrt(h / 2) AS z FROM kruskal JOIN (SELECT metric, corr(p_size % 4 + 1, y) ** 2 AS r2 FROM days GROUP BY 1) s USING (metric)",
    ).replace("WITH RECURSIVE ,", "WITH RECURSIVE"),
    "hypothesis_results": _ctes(
        "tests holm",
        f"""SELECT CASE code WHEN 'H1' THEN 'H1 (Scale)' WHEN 'H2' THEN 'H2 (Complexity)' WHEN 'H3' THEN 'H3 (Recency)' WHEN 'H4' THEN 'H4 (Variance)' WHEN 'H5' THEN 'H5 (Difficulty)' ELSE code || '_' || num END AS hypothesis,
  {_number("num / 8.0")} AS effect, CASE WHEN num % 3 > 0 THEN printf('[%.3f, %.3f]', num / 16.0, num / 4.0) ELSE '--' END AS interval, CASE WHEN p < 0.0001 THEN printf('%.2e', p) ELSE printf('%.4f', p) END AS p_raw,
  CASE WHEN p_corrected < 0.0001 THEN printf('%.2e', p_corrected) ELSE printf('%.4f', p_corrected) END AS p_corrected FROM coded WHERE num % 2 = 0""",
        coded="SELECT *, regexp_extract(test, '([0-9]+)$', 1)::INT AS num, 'H' || (regexp_extract(test, '([0-9]+)$', 1)::INT % 7 + 1) AS code FROM holm",
    ),
    "uncertainty_report": f"""WITH s AS ({SQL["monte_carlo_rho"]}
), r AS ({SQL["spearman"]}
), w AS (SELECT benchmark_id, round(rho, 6) AS rho, round(simulated_rho, 6) AS sim, round(ci_lower, 6) AS lo, round(ci_upper, 6) AS hi, nonpositive_fraction AS share FROM s JOIN r USING (benchmark_id))
SELECT benchmark_id, {_marked("bf", _number("rho"), "rho < 0")} AS spearman, {_marked("bf", _number("sim"), "sim < 0")} AS simulated, printf('[%.3f, %.3f]', lo, hi) AS interval,
  {_marked("it", _number("share", 4), "share > 0.05")} AS nonpositive, (row_number() OVER (ORDER BY rho DESC, benchmark_id))::INT AS place FROM w""",
    "too_few_models": _ctes(
        "scores elos pairs",
        "SELECT benchmark_id, n, 'a group has fewer than 5 models: ' || n AS error FROM few WHERE n < 5",
        few="SELECT benchmark_id || ' ' || (model_id % 2) AS benchmark_id, count(*) AS n FROM pairs WHERE model_id % 25 = length(benchmark_id) GROUP BY 1",
    ),
    "review_table": """WITH a AS (SELECT (p_size % 6 + 1) AS v, p_size % 2 = 0 AS sized, min(p_partkey) AS pos FROM part GROUP BY 1, 2
), arena AS (SELECT *, 'gpt-' || v || CASE WHEN sized THEN ' 7B' ELSE '' END AS name FROM a
), names AS (SELECT DISTINCT p_type, p_size % 7 AS v, p_size % 3 AS k FROM part
), c AS (SELECT p_type, n.v, k, arena.name, pos, sized FROM names n JOIN arena ON arena.v = n.v AND (k = 2 OR NOT sized OR k = 0)
), g AS (SELECT p_type, v, k, string_agg(name, '; ' ORDER BY pos) AS candidates, arg_min(name, (CASE WHEN sized THEN 0 ELSE 1 END) * 1000000000 + pos) AS best FROM c GROUP BY 1, 2, 3)
SELECT n.p_type AS benchmark_id, 'GPT-' || n.v || CASE n.k WHEN 0 THEN ' 7B' WHEN 1 THEN ' 9B' ELSE '' END AS model_name, coalesce(candidates, 'NO_MATCH_FOUND') AS candidates, 1 AS untrusted, coalesce(best, '0') AS selected
FROM names n LEFT JOIN g ON g.p_type = n.p_type AND g.v = n.v AND g.k = n.k""",
    "board_layouts": f"""WITH l AS ({_LINES}), s AS (SELECT unnest(['lmarena', 'vals_ai', 'frontiermath', 'artificial_analysis', 'elsewhere']) AS source)
SELECT source || ' ' || b AS benchmark_id, row_no, name AS model_raw, k || CASE WHEN source IN ('vals_ai', 'artificial_analysis') THEN '%' ELSE '' END AS score_raw FROM l, s""",
    "combined_table": _ctes("scores", "SELECT (row_number() OVER (ORDER BY 'm' || model_id))::INT AS position, 'm' || model_id AS Model, " + ", ".join(f"max(score) FILTER (benchmark_id = '{t}') AS {t}" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM scores GROUP BY model_id"),
}
