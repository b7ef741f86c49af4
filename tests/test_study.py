"""Sources and the steps of a study, on small hand-made boards."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.plans import clean, features, hypotheses, match, report, uncertainty
from tallyloom.sources import embedded_json, html, registry, sinks, tables
from tallyloom.streaming import live_board

PAGE = """<html><body><script>var x = "<table>";</script><table><tr><th rowspan=2>Model</th><th colspan=2>Score</th></tr><tr><th>easy</th><th>hard</th></tr>
<tr><td>A &amp; B</td><td>1</td><td>2</td></tr><tr><td rowspan=2>C</td><td>3</td><td>4</td></tr><tr><td>5</td><td>6</td></tr></table>
<table><tr><th>Team</th><th>Score</th></tr><tr><td>x</td><td>9</td></tr></table></body></html>"""
CSS = """<div class="table-row" data-model-key="m1"><div class="cell name-cell">Model <b>One</b></div><div class="cell chart-cell">no</div>
<div class="cell score-cell"><span class="score-value">18.8%</span><span class="score-error">±5.7%</span></div></div><div class="table-row"><div class="cell name-cell">Two</div></div>"""


def test_tables_of_a_page():
    first, second = html.parse_tables(PAGE)
    assert first[0] == ["Model", "Score easy", "Score hard"]
    assert first[1] == [["A & B", "1", "2"], ["C", "3", "4"], ["C", "5", "6"]]
    assert second == (["Team", "Score"], [["x", "9"]])
    assert html.best_table([first, second], ("Team", "Score"))[0] == ["Team", "Score"]
    assert html.best_table([first, second], ("Nothing",)) == first
    assert html.best_table([]) is None and html.parse_tables("no table") == []


def test_rows_marked_by_class():
    assert html.parse_css_rows(CSS) == [{"model_key": "m1", "name": "Model One", "score": "18.8% ±5.7%", "score_value": "18.8%", "score_error": "±5.7%"}, {"name": "Two"}]


def test_pages_as_frames(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "none"), (3, None)], "id int, body string")
    rows = html.wide(html.html_rows(pages, "id", "body"), ["Model", "Score hard", "absent"]).orderBy("row_no").collect()
    assert [(r.id, r.Model, r["Score hard"], r.absent) for r in rows] == [(1, "A & B", "2", None), (1, "C", "4", None), (1, "C", "6", None)]
    assert html.html_rows(pages, "id", "body", "best", ("Team",)).count() == 1
    with pytest.raises(ValueError):
        html.html_rows(pages, "id", "body", "worst")


def test_embedded_scores(spark):
    document = {"benchmarkView": [0, {"tasks": [0, {"overall": [0, {"org/m": [0, {"accuracy": [0, 71.5], "latency": 3}], "n": [0, {"accuracy": [0, 60]}]}]}]}]}
    raw = json.dumps(document).replace('"', "&quot;")
    pages = spark.createDataFrame([("a", f'<x props="{raw}">'), ("b", json.dumps(document)), ("c", "not json"), ("d", None)], "id string, body string")
    rows = embedded_json.metric_rows(pages, "id", "body")
    got = {(r.id, r.model_name, r.metric): r.value for r in rows.collect()}
    assert got == {(i, *k): v for i in "ab" for k, v in {("org/m", "accuracy"): "71.5", ("org/m", "latency"): "3", ("n", "accuracy"): "60"}.items()}
    assert embedded_json.metric_table(rows, "id", ["accuracy", "latency"]).where("model_name = 'n' and latency is null").count() == 2


def test_encodings_and_files(spark, tmp_path):
    assert tables.encoding_of("é".encode()) == "utf-8" and tables.encoding_of(b"\xff\xfe\x80") == "latin-1"
    for name, text in (("My Board", "Model,Score\nA,71%\nB,--\nA,60%\n"), ("other", "Rank,AI System,result\n1,X,0.5\n")):
        (tmp_path / "raw" / name).mkdir(parents=True)
        (tmp_path / "raw" / name / "data.csv").write_text(text, encoding="utf-8")
    raw = clean.read_boards(spark, f"{tmp_path}/raw", canonical={"other": "GPQA"})
    got = {(r.benchmark_id, r.model_name): (r.score, r["rank"]) for r in clean.clean(raw).collect()}
    assert got == {("My Board", "A"): (71.0, 1), ("My Board", "A(2)"): (60.0, 2), ("GPQA", "X"): (50.0, 1)}
    assert [r.model_name for r in clean.model_list(raw).collect()] == ["A", "X"]
    assert registry.read_source("csv", spark, f"{tmp_path}/raw").count() == 4
    decided = spark.createDataFrame([("My Board", "A(2)", "rename", "A low"), ("GPQA", "X", "drop", None)], "benchmark_id string, model_name string, action string, new_name string")
    assert {r.model_name for r in clean.review_duplicates(clean.clean(raw), decided).collect()} == {"A", "A low"}
    sinks.write_cleaned(clean.clean(raw), f"{tmp_path}/cleaned")
    assert spark.read.parquet(f"{tmp_path}/cleaned").count() == 3
    with pytest.raises(FileNotFoundError):
        clean.read_boards(spark, f"{tmp_path}/cleaned", "none.csv")


def test_columns_by_source():
    assert clean.model_column(["Rank", "name", "Model"]) == "Model" and clean.model_column(["x", "y"]) == "x" and clean.model_column([]) is None
    for columns, path, first, want in (
        (["Model", "Score"], "data/raw/lmarena/X/data.csv", None, "Score"),
        (["Model", "A", "B"], "data/raw/artificial_analysis/X/data.csv", {"A": "x", "B": "71%"}, "B"),
        (["score", "score_value"], "data/raw/frontiermath/T/data.csv", None, "score_value"),
        (["ARC-AGI-1", "ARC-AGI-2", "Score"], "data/raw/selenium/ARC-AGI-2/data.csv", None, "ARC-AGI-2"),
        (["Model", "Score"], "data/raw/selenium/humaneval/data.csv", None, "Score"),
        (["latency", "accuracy"], "data/raw/vals_ai/IOI/data.csv", None, "accuracy"),
        (["a", "Final Result"], "elsewhere/data.csv", None, "Final Result"),
        (["a"], "elsewhere/data.csv", None, None),
    ):
        assert clean.score_column(columns, path, first) == want


def test_json_sources_and_sinks(spark, tmp_path):
    (tmp_path / "meta.json").write_text(json.dumps([{"meta_info": {}}, {"benchmark_id": "b", "question_count": 5, "category": "Math"}, {"benchmark_id": "arena", "elo_column": "e"}]))
    assert [r.benchmark_id for r in tables.read_metadata(spark, f"{tmp_path}/meta.json").collect()] == ["b"]
    (tmp_path / "map.json").write_text(json.dumps({"z": "one", "a": "two"}, indent=2))
    assert [(r.pos, r.model_name, r.model_id) for r in tables.read_mapping(spark, f"{tmp_path}/map.json").orderBy("pos").collect()] == [(0, "z", "one"), (1, "a", "two")]
    entries = {"m1": {"selected_lmarena_model": "x"}, "m2": {"selected_lmarena_model": 0}, "m3": {"selected_lmarena_model": " "}, "m4": {"selected_lmarena_model": "x"}}
    (tmp_path / "review.json").write_text(json.dumps(entries))
    reviewed = tables.read_json_map(spark, f"{tmp_path}/review.json").select(F.lit("b").alias("benchmark_id"), "pos", F.col("key").alias("model_name"), match.selected_text().alias("selected"))
    assert [(r.model_name, r.model_id) for r in match.mapping(reviewed).collect()] == [("m1", "x")]
    sinks.write_json_document(spark.createDataFrame([("k", 1.5, None)], "key string, a double, b string"), "key", f"{tmp_path}/out.json")
    assert json.loads((tmp_path / "out.json").read_text()) == {"k": {"a": 1.5}}
    with pytest.raises(Exception, match="isn't finite"):
        sinks.write_json_document(spark.createDataFrame([("k", float("nan"))], "key string, a double"), "key", f"{tmp_path}/bad.json")
    sinks.write_csv(spark.createDataFrame([(2, None), (1, 0.5)], "a int, b double"), f"{tmp_path}/csv", ["a"])
    text = next((tmp_path / "csv").glob("part-*.csv")).read_bytes()
    assert text == b"a,b\n1,0.5\n2,NaN\n"
    assert tables.read_csv(spark, f"{tmp_path}/csv", "a int, b double").where("b is null").count() == 1
    with pytest.raises(ValueError):
        tables.require_columns(spark.range(1), ["score"])


def test_source_registry(spark, tmp_path):
    (tmp_path / "board").mkdir()
    (tmp_path / "board" / "input.txt").write_text(PAGE)
    assert registry.read_source("first_table", spark, str(tmp_path)).where("benchmark_id = 'board'").count() == 3
    with pytest.raises(KeyError):
        registry.read_source("nowhere", spark, str(tmp_path))
    assert registry.required_columns("ARC-AGI-2") == ("Team", "Score") and registry.required_columns("else") == ("Model",)
    assert set(registry.PATHS) == {"lmarena", "artificial_analysis", "vals_ai", "frontiermath", "pandas_read_html", "selenium"}
    combined = spark.createDataFrame([(0, "m", "1%")], "row_no int, Model string, `Col A` string")
    boards = registry.split_boards(combined, {"a": "Col A", "b": "Col B"}).orderBy("benchmark_id").collect()
    assert [(r.benchmark_id, r.score_raw) for r in boards] == [("a", "1%"), ("b", None)]
    assert registry.choose_columns(combined, ["Col A", "none", "Model"]).columns == ["Col A", "Model"]


def test_matching(spark):
    arena = spark.createDataFrame([(0, "Anthropicclaude-opus-4-1", "1450"), (1, "claude-opus-4-1-thinking-16k", "1460Preliminary"), (2, "gpt-5-high", "1440 ±5"), (3, "gpt-4-old", "1200")], "row_no int, model_raw string, score_raw string")
    known = match.arena_identities(arena)
    assert known.count() == 3
    names = spark.createDataFrame([("b", "Claude Opus 4.1"), ("b", "GPT-5"), ("b", "Nothing 9")], "benchmark_id string, model_name string")
    found = match.candidates(names, known).cache()
    rows = {r.model_name: r for r in match.review(found).collect()}
    assert [c.lmarena_model for c in rows["Claude Opus 4.1"].candidates] == ["Anthropicclaude-opus-4-1", "claude-opus-4-1-thinking-16k"]
    assert rows["GPT-5"].selected == "gpt-5-high" and rows["Nothing 9"].selected == "0" and rows["Nothing 9"].candidates[0].lmarena_model == match.NO_MATCH
    assert match.statistics(found).first().asDict() == {"benchmark_id": "b", "matched": 2, "unmatched": 1, "several": 1}


@pytest.fixture(scope="module")
def study(spark):
    """Thirty models on eight boards, the first of them a board scored by Elo."""
    draw = random.Random(8)
    models = [f"m{i:02d}" for i in range(30)]
    skill = {m: 1380 + 3 * i for i, m in enumerate(models)}
    ids = [features.ELO_SCORED, *[f"bench {k}" for k in range(7)]]
    levels, categories = ["Applying", "Analyzing", "Evaluating", "Creating"], ["Math", "Coding"]
    meta = [(b, 50 + 10 * k, categories[k % 2], f"2024-0{k + 1}-15", levels[k % 4]) for k, b in enumerate(ids)]
    metadata = spark.createDataFrame(meta, "benchmark_id string, question_count int, category string, release_date string, complexity string").cache()
    rows = [(b, m, float(round(min(99, max(1, (skill[m] - 1380) / 2 + 20 + draw.gauss(0, 4 + k)))))) for k, b in enumerate(ids) for m in models[: 12 + 2 * k]]
    scores = features.board_scores(spark.createDataFrame(rows, "benchmark_id string, model_name string, score double"), spark.createDataFrame([(b, m, m) for b in ids for m in models], "benchmark_id string, model_name string, model_id string"), spark.createDataFrame([(m,) for m in models], "model_id string")).cache()
    elo = spark.createDataFrame([(m, c, skill[m] + draw.gauss(0, 3)) for m in models for c in ("Overall", *categories)], "model_id string, category string, elo double").cache()
    return scores, elo, metadata, features.features(scores, elo, metadata, draws=60).cache()


def test_feature_table(study):
    scores, elo, metadata, table = study
    rows = {r.benchmark_id: r for r in table.collect()}
    assert len(rows) == 8 and rows["bench 6"].n == 26
    for r in rows.values():
        assert -1 <= r.spearman_ci_lower <= r.spearman_rho + 0.2 and r.spearman_rho > 0 and 0 < r.rbo <= 1 and r.spearman_pvalue is not None
        assert r.kendall_tau_overall is not None and r.cv > 0
    assert rows[features.ELO_SCORED].difficulty is None and rows["bench 0"].difficulty is not None
    report.check_features(table, 8)
    with pytest.raises(ValueError):
        report.check_features(table, 28)


def test_hypotheses_and_reports(spark, study):
    scores, elo, metadata, table = study
    tests = hypotheses.test_table(spark, table, draws=40)
    assert tests.count() == 15
    judged = hypotheses.corrected(tests).cache()
    rows = judged.collect()
    assert all(r.p_corrected >= r.p_raw - 1e-12 for r in rows) and all(r.conclusion.endswith(".") for r in rows)
    assert {r.test for r in rows} == {f"H{k}_{m}" for k in range(1, 6) for m in hypotheses.METRICS}
    assert report.hypothesis_results(judged).count() == 5
    assert report.correlation_summary(table).where(F.col("rbo").contains("textbf")).count() == 1
    assert report.overall_correlations(table).count() == 8
    compared = features.reference_comparison(scores, table, ["m00", "m05", "m11"])
    assert compared.count() == 8 and report.reference_difficulties(compared).count() == 11
    with pytest.raises(ValueError):
        features.reference_comparison(scores, table, ["m00", "stranger"])
    pairs = report.rank_pairs(scores, elo.where("category = 'Overall'"), "bench 3")
    assert report.check_rank_pairs(pairs).count() == 20
    with pytest.raises(ValueError):
        report.check_rank_pairs(pairs.withColumn("board_rank", F.col("board_rank") + 1))
    for figure in (report.figure_scale, report.figure_complexity, report.figure_recency):
        assert figure(table).count() == 8
    assert report.figure_difficulty(table).count() == 7
    assert r"\begin{tabular}" in sinks.latex_table(report.hypothesis_results(judged), {"hypothesis": "H", "effect": "Effect"}, "c", "l").first().text


def test_uncertainty(spark, study):
    scores, elo, metadata, table = study
    raw = elo.select("category", F.lit(1).alias("row_no"), F.col("model_id").alias("model_raw"), F.concat(F.format_string("%.1f", "elo"), F.lit("Preliminary")).alias("score_raw"), F.lit("±6").alias("ci_raw"))
    raw = raw.unionByName(raw.limit(1).withColumns({"row_no": F.lit(2), "score_raw": F.lit("1500")})).unionByName(raw.limit(1).withColumns({"row_no": F.lit(3), "ci_raw": F.lit("none")}))
    arena = uncertainty.arena_with_sd(raw).cache()
    assert arena.count() == elo.count() and arena.where("elo = 1500").count() == 1
    rows = uncertainty.inputs(scores, arena, metadata)
    own = uncertainty.simulate(rows, 200).collect()
    order = metadata.select("benchmark_id", F.dense_rank().over(__import__("pyspark").sql.Window.orderBy("benchmark_id")).alias("pos"))
    shared = {r.benchmark_id: r for r in uncertainty.simulate_in_order(rows, order, 200).collect()}
    for r in own:
        assert r.ci_lower <= r.simulated_rho <= r.ci_upper and abs(r.simulated_rho - shared[r.benchmark_id].simulated_rho) < 0.1
    assert report.uncertainties(spark.createDataFrame(own).join(table.select("benchmark_id", "spearman_rho"), "benchmark_id")).count() == 8
    with pytest.raises(Exception, match="fewer than 5 models"):
        uncertainty.simulate(rows.where("model_id < 'm04'"), 20).collect()
    with pytest.raises(Exception, match="outside 0 to 100"):
        uncertainty.inputs(scores.withColumn("score", F.lit(101.0)), arena, metadata).collect()


def test_live_board(spark, tmp_path):
    rows = [(f"2025-01-01 0{h}:{m:02d}:00", b, n, float(h * 10 + m)) for h in range(4) for m in (5, 40) for b in ("x", "y") for n in ("p", "q")]
    frame = spark.createDataFrame(rows, "t string, board string, model string, score double").withColumn("t", F.to_timestamp("t"))
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    board = live_board.windowed_board(live_board.read_events(spark, f"{tmp_path}/in", frame.schema), "t", "board", "model", "score")
    live_board.keep_ranked(board, ["window", "board"], f"{tmp_path}/state", lambda df, k: got.extend(df.collect()), once=True).awaitTermination(120)
    assert len({r.window.start for r in got}) == 3 and {r["rank"] for r in got} == {1} and all(r.n == 2 for r in got)


def test_every_query_agrees_with_its_sql(spark, small):
    import duckdb

    from tallyloom import oracles, queries

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    assert set(oracles.SQL) <= set(queries.QUERIES)
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    for name, f in queries.QUERIES.items():
        rows = f(spark, small)
        got = rows.collect()
        if name in oracles.SQL:
            cursor = con.execute(oracles.SQL[name])
            columns = [c[0] for c in cursor.description]
            assert sorted(columns) == sorted(rows.columns), name
            want = sorted(repr([plain(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)]) for r in cursor.fetchall())
            assert sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in got) == want, name


def test_matching_and_permutation_take_in_every_row(spark, small):
    import duckdb

    from tallyloom import queries

    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    rows = con.execute("SELECT p_partkey, p_name, p_size, p_brand, p_type FROM part").fetchall()
    split = {r[0]: set(re.split(r"[\s#]+", r[1].lower())) for r in rows}
    family = {r[0]: re.split(r"[\s#]+", r[1].lower())[0] for r in rows}
    brand = {r[0]: r[3].lower() if r[2] % 2 == 0 else None for r in rows}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and family[a[0]] == family[b[0]] and a[2] % 3 == b[2] % 3 and (brand[a[0]] is None or brand[b[0]] is None or brand[a[0]] == brand[b[0]])}
    found = queries.QUERIES["null_safe_match"](spark, small).collect()
    assert len(found) == len(want) and {(r.key, r.c_key) for r in found} == want
    size = {r[0]: r[2] for r in rows}
    date = {k: f"{2025 if n % 5 < 3 else 2024}-0{n % 5}" if n % 5 else None for k, n in size.items()}
    line = {r[0]: None if r[0] % 4 == 0 else family[r[0]] if r[0] % 3 == 0 else "-".join(re.split(r"[\s#]+", r[1].lower())) for r in rows}

    def like(a, b):
        either = lambda x, equal, less, one: equal if x[a] and x[a] == x[b] else less if x[a] and x[b] else one if x[a] or x[b] else 0.0
        near = 0.5 if date[a] and date[b] and date[a][:4] == date[b][:4] else 0.0
        inside = 0.5 if line[a] and line[b] and (line[a] in line[b] or line[b] in line[a]) else 0.0
        jaccard = len(split[a] & split[b]) / len(split[a] | split[b])
        return round(min(1.0, 0.5 * jaccard + 0.2 * either(date, 1.0, near, 0.2) + 0.2 * either(brand, 1.0, 0.0, 0.3) + 0.1 * either(line, 1.0, inside, 0.2)), 10)

    likest = {a: sorted((-like(a, b), b) for x, b in want if x == a) for a in {a for a, _ in want}}
    best = {a: found[0] for a, found in likest.items() if len(found) == 1 or found[0][0] <= -0.3}
    assert {r.key: (-r.similarity, r.c_key) for r in queries.QUERIES["match_top1_similarity"](spark, small).collect()} == best
    counts = {}
    for a, _ in want:
        name = next(r[1] for r in rows if r[0] == a)
        counts[name] = counts.get(name, 0) + 1
    assert queries.QUERIES["match_statistics"](spark, small).collect() == [("parts", len(counts), 0, sum(n > 1 for n in counts.values()))]
    names = dict(con.execute("SELECT p_type, count(DISTINCT (p_size, p_name)) FROM part GROUP BY 1").fetchall())
    assert {r.benchmark_id: r.matched + r.unmatched for r in queries.QUERIES["review_candidates"](spark, small).collect()} == names


def test_permutation_takes_in_every_model(spark, small):
    from tallyloom import queries

    d = small.replace("sf0.001", "sf0.01")
    groups = queries.QUERIES["permutation"](spark, d).collect()
    assert sum(r.n for r in groups if r.statistic == "spearman") == queries.scores_with_elo(spark, d).count()
    assert all(r.permutation_p is not None and 0 < r.permutation_p <= 1 for r in groups)


def test_registered_resamplers_take_every_draw_and_statistic(spark, small, monkeypatch):
    from tallyloom import queries
    from tallyloom.operators import resampling

    asked = {}
    for name, place, default in (("resampled_agreement", 5, ("spearman", "kendall")), ("uncertainty", 7, 10_000), ("bootstrap_quantiles", 4, None)):
        f = getattr(resampling, name)
        monkeypatch.setattr(resampling, name, lambda *a, f=f, name=name, place=place, default=default: asked.setdefault(name, []).append(a[place:] or default) or f(*a))
    agreement = queries.QUERIES["bootstrap_agreement"](spark, small).collect()
    permuted = queries.QUERIES["permutation"](spark, small).collect()
    queries.QUERIES["monte_carlo"](spark, small)
    queries.QUERIES["bootstrap_ci"](spark, small)
    assert asked == {"resampled_agreement": [("spearman", "kendall")] * 2, "uncertainty": [10_000], "bootstrap_quantiles": [(2000,)]}
    assert {r.statistic for r in agreement} == {r.statistic for r in permuted} == {"spearman", "kendall"}
    # p counts draws in steps of 2 / 2001
    assert all(abs(r.permutation_p * 2001 / 2 - round(r.permutation_p * 2001 / 2)) < 1e-4 or r.permutation_p == 1 for r in permuted if r.permutation_p is not None and r.permutation_p == r.permutation_p)


def test_tables_raise_above_their_bounds(spark, monkeypatch):
    with pytest.raises(Exception, match="too many rows"):
        sinks.latex_table(spark.range(1001), {"id": "n"}, "c", "l").collect()
    assert sinks.latex_table(spark.range(1000), {"id": "n"}, "c", "l").first().text.count(r" \\") == 1001
    monkeypatch.setattr(hypotheses, "MOST_ROWS", 3)
    text = spark.range(4).select(F.col("id").alias("benchmark_id"), F.lit(2.0).alias("question_count"), F.lit(None).cast("string").alias("complexity"), F.lit("2024-01-01").alias("release_date"), F.lit(1.0).alias("difficulty"), F.lit(1.0).alias("cv"), F.lit(1.0).alias("m"))
    with pytest.raises(ValueError, match="too many benchmarks"):
        hypotheses.test_table(spark, text, metrics=["m"])
