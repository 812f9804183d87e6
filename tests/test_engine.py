"""The analysis engine against pandas, numpy and small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import values as v
from sparkloom.operators import assoc, charts, clean, descent, gram, insights, logistic, metrics, network, outliers, profile, ranks, select, train
from sparkloom.plans import views
from sparkloom.plans.analyst import Analyst
from sparkloom.sources import ingest, records
from sparkloom.sources.catalog import Catalog, for_json
from sparkloom.streaming import cleaned as streamed

SF = "/root/testdata/sf0.001"


def write(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


class Canned:
    """A text model that gives its replies in turn, the last one for ever."""

    def __init__(self, *replies):
        self.replies = list(replies)

    def generate(self, prompt):
        reply = self.replies.pop(0) if len(self.replies) > 1 else self.replies[0]
        if isinstance(reply, Exception):
            raise reply
        return reply


# ingest ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sep", [",", "\t", ";", "|"])
def test_delimiters(spark, tmp_path, sep):
    df = ingest.read_delimited(spark, write(tmp_path, f"a{sep}b\n1{sep}x\n2{sep}y\n"))
    assert df.columns == ["__row_id", "a", "b"]
    assert [tuple(r) for r in df.orderBy("__row_id").collect()] == [(0, 1, "x"), (1, 2, "y")]


def test_other_dialects(spark, tmp_path):
    blank = ingest.read_delimited(spark, write(tmp_path, "a  b\n1   2\n3 4\n", "w.csv"))
    assert [tuple(r) for r in blank.orderBy("__row_id").collect()] == [(0, 1, 2), (1, 3, 4)]
    mark = ingest.read_delimited(spark, write(tmp_path, b"\xef\xbb\xbfa,b\n1,2\n", "b.csv"))
    assert mark.columns[1:] == ["a", "b"]
    rows = "\n".join(f"{i},{i * 2},{i % 3},1" for i in range(12))
    sized = ingest.read_delimited(spark, write(tmp_path, f"812,4,,\nRainfall,Windspeed,Humidity,Harvest\n{rows}\n", "d.csv"))
    assert sized.columns[1:] == ["Rainfall", "Windspeed", "Humidity", "Harvest"] and sized.count() == 12
    plain = ingest.read_delimited(spark, write(tmp_path, f"6,148,72,35\n{rows}\n", "p.csv"))
    assert plain.count() == 12


def test_null_tokens_and_types(spark, tmp_path):
    df = ingest.read_delimited(spark, write(tmp_path, "a,b,c\nNA,true,1.5\nnull,false,2\n-,true,n/a\n?,false,3\n"))
    assert [tuple(r)[1:] for r in df.orderBy("__row_id").collect()] == [(None, True, 1.5), (None, False, 2.0), ("-", True, None), ("?", False, 3.0)]


@pytest.mark.parametrize("content", [b"", b"a,b\n", b"\xff\xfe\x00a", b"PK\x03\x04rest"])
def test_rejected(spark, tmp_path, content):
    with pytest.raises(ValueError):
        ingest.read_delimited(spark, write(tmp_path, content))


def test_number_and_date_parsing(spark):
    texts = ["1d", "1,000", "+5", " 12 ", "inf", "-inf", "nan", "", "1e3", ".5", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(v.as_number(F.col("t"))).collect()
    assert [r[0] for r in got] == [None, None, 5.0, 12.0, math.inf, -math.inf, None, None, 1000.0, 0.5, None]
    days = ["2020-01-02", "01/02/2020", "Jan 5 2021", "20200103", "soon"]
    got = spark.createDataFrame([(t,) for t in days], "t string").select(v.as_date(F.col("t")).cast("string")).collect()
    assert [r[0] and r[0][:10] for r in got] == ["2020-01-02", "2020-01-02", "2021-01-05", "2020-01-03", None]


# cleaning --------------------------------------------------------------------------------------------


def test_pipeline(spark):
    cleaned, report = clean.clean(ingest.with_row_id(views.table(spark, SF, "dirty_lineitem")))
    r = report.as_dict()
    assert "sparse" in r["columns_dropped_high_null"] and "const_col" in r["single_value_categorical_columns_dropped"]
    assert r["binary_categorical_columns_encoded"] == ["linestatus"] and "qty" in r["numeric_columns_filled"]
    assert r["rows_end"] == cleaned.count() and r["columns_end"] == len(cleaned.columns) - 1
    assert cleaned.na.drop("any").count() == cleaned.count()
    again, second = clean.clean(cleaned)
    # filling blanks comes after the duplicates go, so filled rows may coincide; a second pass finds just those
    alike = cleaned.count() - cleaned.drop(ingest.ROW_ID).distinct().count()
    assert second.rows_removed_unresolved_nulls == 0 and second.duplicate_rows_removed == alike


def test_thresholds(spark):
    rows = [(str(i) if i < 85 else "x",) for i in range(100)]
    assert clean.fit_numeric_like(spark.createDataFrame(rows, "a string")) == ["a"]
    assert clean.fit_numeric_like(spark.createDataFrame([*rows[1:], ("y",)], "a string")) == []
    two = spark.createDataFrame([("1",), ("2",)], "a string")
    assert clean.fit_categories(two, ["a"]) == clean.Categories((), {})
    dates = spark.createDataFrame([(f"2020-01-{i % 28 + 1:02d} 00:{i:02d}:00",) for i in range(59)], "d string")
    assert clean.fit_dates(dates, []) == ["d"] and clean.fit_dates(dates, ["d"]) == []


def test_empty_after_filters(spark):
    df = spark.createDataFrame([(None, None)], "a double, b string")
    cleaned, report = clean.clean(df)
    assert report.columns_end == 0 and cleaned.columns == []


def test_first_of_duplicates_stays(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", 1)], "__row_id long, x string, y int")
    assert sorted(tuple(r) for r in clean.drop_duplicates(df).collect()) == [(1, "a", None), (2, "b", 1)]


def test_stream_of_fitted_steps(spark, tmp_path):
    df = views.table(spark, SF, "dirty_lineitem")
    path = str(tmp_path / "in")
    df.write.parquet(path)
    fitted = streamed.fit(df)
    stream = streamed.transform(spark.readStream.schema(df.schema).parquet(path), fitted)
    q = stream.writeStream.format("memory").queryName("cleaned_rows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert spark.table("cleaned_rows").count() == streamed.transform(df, fitted).count()


# association -----------------------------------------------------------------------------------------


def test_against_pandas(spark):
    df = views.table(spark, SF, "planted_lineitem").select("x1", "x2", "x3", "x4", "y")
    want = df.toPandas().corr()
    for r in assoc.correlation_matrix(df).collect():
        assert r["r"] == pytest.approx(want.loc[r["col_a"], r["col_b"]], abs=6e-4)
    assert assoc.correlation_pairs(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), ["a", "b"]).first()["r"] is None
    stored = assoc.correlation_matrix(df)
    assert assoc.pairs_from_matrix(stored).count() == 10
    for r in assoc.correlation_ratios(views.table(spark, SF, "planted_assoc"), "band", ["a1", "a4"]).collect():
        assert 0 <= r["eta"] <= 1
    same = spark.createDataFrame([("a", "x"), ("b", "y")] * 5, "p string, q string")
    assert assoc.cramers_v(same, "p", "q").first()["v"] == pytest.approx(1.0)
    assert assoc.cramers_v(same.withColumn("q", F.lit("z")), "p", "q").first()["v"] == 0.0


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "b"), (4.0, "a"), (None, None)], "x double, c string")
    r = profile.numeric_profile(df).first()
    assert (r["count"], r["null_count"], r["q1"], r["median"], r["std"]) == (4, 1, 1.75, 2.5, pytest.approx(np.std([1, 2, 3, 4], ddof=1)))
    r = profile.categorical_profile(df).first()
    assert (r["count"], r["top_value"]) == (5, "a")
    assert profile.table_summary(df).first()["missing_percent"] == 20.0
    assert profile.table_summary(df.where("false")).first()["missing_percent"] is None
    assert outliers.iqr_report(df, ["x"]).first()["outlier_count"] == 0


# networks and text -----------------------------------------------------------------------------------


def test_network():
    pairs = [("a", "b", 0.9), ("b", "c", -0.5), ("d", "e", 0.4), ("a", "d", 0.1)]
    of, sizes = network.components("abcdef", pairs)
    assert sorted(sizes.values()) == [1, 2, 3] and of["a"] == of["c"] != of["d"] and sum(sizes.values()) == 6
    assert network.most_important(pairs, list("abcdef")) == "b" and network.scatter_pair(pairs, list("abcdef")) == pairs[0]
    assert network.mentioned("unit_price of Price, x", ["price", "unit_price", "x"]) == ["unit_price", "price"]
    names = ["alpha", "beta", "gamma", "delta", "eps"]
    pairs = [("alpha", "beta", 0.9), ("beta", "gamma", 0.8), ("delta", "eps", 0.7)]
    assert network.filter_lines(["alpha with beta", "alpha with delta"], ["predict delta", "predict alpha"], names, pairs) == (["alpha with beta"], ["predict alpha"])
    notes = insights.template_notes(pairs, names)
    assert len(notes["correlated_pairs"]) == 3 and len(notes["prediction_ideas"]) == 2


def test_replies():
    assert insights.extract_json('say {"a": "}", "b": {"c": 1}} end') == {"a": "}", "b": {"c": 1}}
    assert insights.extract_json("{'a': None}") == {"a": None} and insights.extract_json("{oops") is None
    assert insights.parse_reply('```json\n{"summary": "s"}\n```') == {"summary": "s"} and insights.parse_reply("plain") == {"summary": "plain"}
    inner = '{"summary": "s", "key_findings": ["f"]}'
    assert insights.normal_insights({"summary": inner}) == {"summary": "s", "key_findings": ["f"], "recommendations": []}
    assert insights.normal_insights({"findings": '["x"]', "next_steps": [{"title": "t", "text": "u"}]})["recommendations"] == ["t: u"]
    assert insights.resolve_model("llama3", ["mistral:7b", "llama3:latest"]) == "llama3:latest" and insights.resolve_model("x", []) is None
    assert insights.ask_json(Canned(RuntimeError("down")), "p") is None
    assert insights.dataset_insights(None, [], {})["key_findings"] == []


def test_json_values():
    assert for_json({"a": math.nan, 1: [np.int64(3), math.inf], "d": pd.Timestamp("2020-01-01")}) == {"a": None, "1": [3, None], "d": "2020-01-01T00:00:00"}


# models ----------------------------------------------------------------------------------------------


def test_gram_equals_least_squares(spark):
    df = views.table(spark, SF, "planted_lineitem").select("x1", "x2", "x3", "y")
    g = gram.grams(df, ["x1", "x2", "x3"], "y", roles=F.array(F.when(F.col("x1") > 20, "train").otherwise("validate")))
    p = df.toPandas()
    a, b = p[p.x1 > 20], p[p.x1 <= 20]
    design = lambda q, c: np.column_stack([np.ones(len(q)), q[c]])
    for c in (["x1", "x2", "x3"], ["x2"], ["x3", "x1"]):
        beta = np.linalg.lstsq(design(a, c), a["y"], rcond=None)[0]
        error = b["y"] - design(b, c) @ beta
        assert g.r2(c, 0) == pytest.approx(1 - (error**2).sum() / ((b["y"] - b["y"].mean()) ** 2).sum(), rel=1e-6)
        intercept, slopes = g.coefficients(c)
        assert [intercept, *slopes.values()] == pytest.approx(list(beta), rel=1e-6)


def plain_fit(x, y, steps):
    """One model of full-batch descent, step by step."""
    x = np.column_stack([np.ones(len(x)), x])
    pos, neg = y.sum(), len(y) - y.sum()
    weight = np.where(y == 1, len(y) / (2 * max(pos, 1)), len(y) / (2 * max(neg, 1)))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.05 * (x.T @ (weight * (p - y)) / weight.sum() + np.r_[0.0, 1e-4 * w[1:]])
    return w


def plain_f1(true, said):
    found = []
    for label in sorted(set(true) | set(said)):
        hit = ((true == label) & (said == label)).sum()
        found.append(2 * hit / ((true == label).sum() + (said == label).sum()))
    return float(np.mean(found))


def plain_scores(x, y, x_held, y_held, steps):
    """(macro-F1, accuracy) on held-out rows of models of the training rows."""
    p_of = lambda x, w: 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ w, -30, 30)))
    labels = sorted(set(y))
    if len(labels) == 2:
        w = plain_fit(x, (y == labels[1]).astype(float), steps)
        best, at = (-1.0, -1.0), 0.5
        for t in metrics.THRESHOLDS:
            said = np.where(p_of(x, w) >= t, labels[1], labels[0])
            now = (plain_f1(y, said), float((y == said).mean()))
            if now[0] > best[0] + 1e-6 or (abs(now[0] - best[0]) <= 1e-6 and now[1] > best[1] + 1e-6):
                best, at = now, t
        said = np.where(p_of(x_held, w) >= at, labels[1], labels[0])
    else:
        p = np.stack([p_of(x_held, plain_fit(x, (y == k).astype(float), steps)) for k in labels], axis=1)
        said = np.array(labels)[p.argmax(axis=1)]
    return plain_f1(y_held, said), float((y_held == said).mean())


def test_logistic(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double").repartition(3)
    for cells in (0, descent.HERE_CELLS):
        models, labels, _ = logistic.fit(df, ["a", "b"], "y", steps=7, here_cells=cells)
        assert labels == ["0.0", "1.0"] and models["1.0"] == pytest.approx(plain_fit(x, y, 7), abs=1e-9)
    found = {r["candidate"]: r for r in logistic.candidate_scores(df, [["a"], ["b"]], "y").collect()}
    assert found[0]["f1_macro"] > 0.85 > found[1]["f1_macro"]
    result = train.train_logistic(df, "y", ["a", "b"])
    assert result["metrics"]["f1"] > 0.85 and result["predictions"].count() == 300


@pytest.mark.parametrize("cells", [0, descent.HERE_CELLS])
@pytest.mark.parametrize("labels", [2, 3])
def test_all_candidates_in_one_descent(spark, labels, cells):
    """Every subset and repeat equals models fitted one by one on the same rows; jobs don't grow with candidates."""
    rng = np.random.default_rng(labels)
    rows = [(*map(float, rng.normal(size=3)), int(rng.integers(labels)) * 5) for _ in range(150)]
    rows = [(a + y / 5, b, c - y / 9, y) for a, b, c, y in rows]
    df = spark.createDataFrame(rows, "x double, u double, z double, y int").repartition(3).cache()
    subsets = [["x"], ["u"], ["x", "u"], ["z", "x"], ["x", "u", "z"]]
    found = {r["candidate"]: (r["f1_macro"], r["accuracy"]) for r in logistic.candidate_scores(df, subsets, "y", repeats=3, steps=12, here_cells=cells).collect()}
    names = ["u", "x", "z"]
    bucket = [gram.fold_bucket(r, *names, F.col("y").cast("string")).alias(f"r{r}") for r in range(3)]
    pdf = df.select("*", *bucket).toPandas()
    for i, s in enumerate(subsets):
        each = []
        for r in range(3):
            tr, va = pdf[f"r{r}"] < 70, pdf[f"r{r}"].between(70, 84)
            each.append(plain_scores(pdf.loc[tr, s].to_numpy(), pdf.loc[tr, "y"].to_numpy(), pdf.loc[va, s].to_numpy(), pdf.loc[va, "y"].to_numpy(), 12))
        assert found[i] == pytest.approx(tuple(np.mean(each, axis=0)))
    if not cells:
        def jobs(subsets):
            spark.sparkContext.setJobGroup(f"descent{len(subsets)}", "")
            logistic.candidate_scores(df, subsets, "y", repeats=3, steps=12, here_cells=0).collect()
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"descent{len(subsets)}"))

        assert jobs(subsets) == jobs(subsets[:1])
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    df.unpersist()


def test_small_tables_and_ties(spark):
    few = spark.createDataFrame([(float(i), float(i % 2)) for i in range(39)], "a double, y double")
    assert logistic.candidate_scores(few, [["a"]], "y").count() == 0
    assert gram.grams(few, ["a"], "y").score(["a"]) is None
    value = {"a": (0.5, 0.1), "b": (0.5, 0.3), "c": (0.4, 0.9)}
    score = lambda s: max(value[f] for f in s)
    assert metrics.beats((0.5, 0.3), (0.5, 0.1), 1e-6) and not metrics.beats((0.5, 0.1), (0.5 + 1e-9, 0.1), 1e-6) and metrics.beats((0.6, 0.0), (0.5, 1.0), 1e-6)
    assert select.pair_champion(["a", "b", "c"], score, ["a"])[0] == ["a", "b"]
    assert select.exhaustive(["c", "a", "b"], score, 2, 1e-6)[1] == (0.5, 0.3)
    assert select.greedy(["c", "a", "b"], score, 2, 1e-6)[1] == (0.5, 0.3)
    tiny = train.with_split(spark.createDataFrame([(float(i), float(i)) for i in range(31)], "a double, y_true double"), ["a"])
    counts = {r["split"]: r["count"] for r in tiny.groupBy("split").count().collect()}
    assert counts["test"] >= 10 and counts["train"] + counts["test"] == 31


def test_classification_search_end_to_end(spark):
    """Pool beyond five columns, pair champion and subset search for classes."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 7)).round(1)  # few enough distinct values to be no ids
    y = (x[:, 5] + x[:, 6] + 0.5 * rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)], ", ".join(f"x{i} double" for i in range(7)) + ", y int").cache()
    result = train.train(df, target="y")
    assert {"x5", "x6"} <= set(result["feature_columns"]) and result["selection"]["search"] == "exhaustive" and result["metrics"]["f1"] > 0.8
    assert all("accuracy" in h for h in result["selection"]["history"])
    model = Canned('{"candidates": []}', '{"features": ["x0", "x1"], "reasoning": "guess"}')
    result = train.train(df, lambda p: insights.ask_json(model, p), target="y", agent=True)
    assert {"x5", "x6"} <= set(result["feature_columns"]) and "winner" in result["selection"]
    df.unpersist()


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    r = metrics.classification_scores(df, "y", "p").first()
    true, said = np.array(list("aabc")), np.array(list("abba"))
    assert r["accuracy"] == 0.5 and r["f1_macro"] == pytest.approx(plain_f1(true, said))
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "y double, p double")
    assert metrics.regression_scores(flat, "y", "p").first()["r2"] == 0.0
    assert charts.bin_count(10) == 10 and charts.bin_count(10_000) == 30


def test_selection_rules():
    assert select.leaks("pred_label", "y") and select.leaks("house_price_z", "house_price") and not select.leaks("rooms", "price")
    assert select.target_prior("price") == pytest.approx(0.40) and select.target_prior("zip_code") == pytest.approx(-0.24)
    assert select.parse_selection({"features": ["b", "z", "b", "a"], "reasoning": "r"}, ["a", "b"]) == (["b", "a"], "r")
    assert select.parse_selection(None, list("abcdefgh"))[0] == list("abcdef")
    value = {"a": 0.1, "b": 0.5, "c": 0.3, "d": 0.0}
    score = lambda s: sum(value[f] for f in s) - 0.05 * len(s)
    for found in (select.exhaustive(list("abcd"), score, 4, 1e-9), select.greedy(list("abcd"), score, 4, 1e-9)):
        assert sorted(found[0]) == ["a", "b", "c"]
    assert select.subsets(12, 8) == 3784
    assert select.best_subset(list("abcd"), score)[3] == "exhaustive"
    assert [d["feature"] for d in select.ablation(list("abc"), score)] == ["b", "c", "a"]
    assert select.pair_champion(list("abcd"), score, ["a"])[0] == ["b", "c"]
    assert select.grow(list("bcad"), score, 100)[0] == ["b", "c", "a"]
    assert select.prune_redundant(["x", "y"], {"x": 0.2, "y": 0.9}, {frozenset("xy"): 0.99}) == ["y"]


def test_train_paths(spark):
    df = views.table(spark, SF, "planted_lineitem").select("x1", "x2", "x3", "x4", "y")
    result = train.train(df)
    assert result["problem_type"] == "regression" and result["metrics"]["r2"] > 0.9
    # x2 has over 95 % distinct values here, so it counts as an id and is no feature; x1 and x3 explain a third of y
    model = Canned('{"target": "y", "features": ["x1", "x3"]}', '{"candidates": [{"operator": "multiply", "feature_a": "x1", "feature_b": "x2"}]}', '{"features": ["x3", "x2"], "reasoning": "try"}', "nonsense", '{"features": ["x1", "x2", "x3"]}')
    result = train.train(df, lambda p: insights.ask_json(model, p), agent=True)
    assert result["target_column"] == "y" and len(result["selection"]["iterations"]) == 5 and result["metrics"]["r2"] > 0.25
    assert "x2" not in result["feature_columns"]


def test_constant_validation_rows():
    """Rounding in a constant target's spread is not taken for variance."""
    spread = np.array([[10.0, 0.0, 5.0], [0.0, 10.0, 0.0], [5.0, 0.0, 2.5 + 1e-15]])
    assert gram.Grams(["x"], np.zeros(2), np.ones(2), {(0, "train"): np.eye(3) * 9, (0, "validate"): spread}).r2(["x"], 0) == 0.0


# service ---------------------------------------------------------------------------------------------


def test_analyst(spark, tmp_path):
    rows = "\n".join(f"{i % 40},{i % 40 * 2 + (i * 7) % 5},{(i * 37) % 11},{'xyz'[i % 3]},{'yes' if i % 2 else 'no'}" for i in range(120))
    path = write(tmp_path, f"size,price,noise,kind,flag\n{rows}\n")
    a = Analyst(spark, str(tmp_path / "store"))
    assert a.upload_preview(path)["rows_count"] == 120
    found = a.analyze(path)
    key = found["file_id"]
    assert found["summary"]["rows"] == found["cleaning_report"]["rows_end"] and found["correlations"]["pairs"][0]["strength"] == "strong"
    assert [f["file_id"] for f in a.list_files()] == [key] and a.health()["analyses"] == 1
    assert a.series(key).count() == found["summary"]["rows"] and a.preview(key, 3).count() == 3
    assert a.column(key, "price")["chart"]["chart"] == "histogram" and a.describe(key, "price")["description"]
    assert a.correlations(key)["scatter"] and a.outliers(key) is not None and a.charts(key) and a.insights(key, True)
    assert a.histogram(key, "price").agg(F.sum("n")).first()[0] == found["summary"]["rows"]
    a.export_csv(key, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == found["summary"]["rows"]
    assert a.train(key)["metrics"]["r2"] > 0.5
    a.chat(key, "how many rows?")
    assert a.catalog.messages(key).count() == 1
    assert a.delete(key) and not a.delete(key) and a.list_files() == []
    with pytest.raises(ValueError):
        Catalog(spark, str(tmp_path)).load_table("../x")
    with pytest.raises(KeyError):
        a.get_analysis(key)


def test_line_breaks_in_quotes(spark, tmp_path):
    df = ingest.read_delimited(spark, write(tmp_path, 'a,b\n"x\ny",1\n"he said ""no""",2\n'))
    assert [tuple(r) for r in df.orderBy("__row_id").collect()] == [(0, "x\ny", 1), (1, 'he said "no"', 2)]


def test_text_targets_rank_by_label_codes(spark):
    rows = [("abc"[i % 3], float(i % 3), float(i * 7 % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "y string, near double, far double")
    assert select.ranked(df, "y", ["far", "near"]) == ["near", "far"]
    assert {r["column"]: round(r["relevance"], 6) for r in select.relevance(df, "y", ["near"]).collect()} == {"near": 1.0}


def test_cleaning_leaves_nothing_cached(spark):
    df = spark.createDataFrame([(i, float(i % 9), "ab"[i % 2]) for i in range(40)], "__row_id long, x double, t string")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    out, _ = clean.clean(df)
    assert out.count() > 0 and spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_quantiles_by_rank(spark):
    rng = np.random.default_rng(5)
    whole = {"a": rng.integers(-20, 20, 501), "b": np.round(rng.normal(size=501), 3), "c": np.full(501, 7.0)}
    rows = [(int(a), float(b) if i % 7 else None, float(c), None) for i, (a, b, c) in enumerate(zip(*whole.values(), strict=True))]
    df = spark.createDataFrame(rows, "a long, b double, c double, nothing double").repartition(6)
    found = {r["column"]: r for r in ranks.quantiles(df, df.columns, {"low": 0.0, "q": 0.137, "mid": 0.5, "high": 1.0}).collect()}
    assert set(found) == {"a", "b", "c"}
    for i, name in enumerate(("a", "b", "c")):
        held = np.array([r[i] for r in rows if r[i] is not None], dtype=float)
        assert found[name]["n"] == len(held)
        assert np.allclose([found[name][k] for k in ("low", "q", "mid", "high")], np.quantile(held, [0, 0.137, 0.5, 1]))
    assert ranks.quantiles(df.limit(0), ["a"], {"mid": 0.5}).count() == 0
    assert ranks.distinct_counts(df, df.columns) == {"a": len(set(whole["a"].tolist())), "b": len({r[1] for r in rows} - {None}), "c": 1, "nothing": 0}


@pytest.mark.parametrize("few", [0, ranks.FEW])
def test_quantiles_by_brackets(spark, monkeypatch, few):
    """Heavy ties, long tails and infinities; brackets that miss are opened."""
    monkeypatch.setattr(ranks, "FEW", few)
    rng = np.random.default_rng(1)
    whole = np.column_stack([rng.normal(size=60_000), rng.integers(0, 3, 60_000), np.exp(rng.normal(size=60_000) * 9), np.r_[np.zeros(59_990), np.full(10, np.inf)]])
    df = spark.createDataFrame(pd.DataFrame(whole, columns=list("abcd"))).repartition(5)
    wanted = {"x": 0.0, "q": 0.25, "m": 0.5, "r": 0.9993, "z": 1.0}
    found = {r["column"]: r for r in ranks.quantiles(df, list("abcd"), wanted).collect()}
    for i, c in enumerate("abcd"):
        ordered = np.sort(whole[:, i])
        for name, p in wanted.items():
            place = p * (len(ordered) - 1)
            low, high, share = ordered[int(np.floor(place))], ordered[int(np.ceil(place))], place - np.floor(place)
            assert found[c][name] == (low if not share else pytest.approx((1 - share) * low + share * high)), (c, name)
    monkeypatch.setattr(ranks, "brackets", lambda found, wanted: [(1e300, 1e301)] * len(wanted))
    assert ranks.quantiles(df, ["a"], {"m": 0.5}).first()["m"] == found["a"]["m"]


def test_distinct_counts(spark):
    rows = [(2**60 + i % 2, "t" * (i % 9), float(i % 5), i % 2 == 0, None) for i in range(500)] + [(None, "", -0.0, None, None), (1, "é", 0.0, True, None)]
    df = spark.createDataFrame(rows, "a long, b string, c double, d boolean, e string").repartition(5)
    assert ranks.distinct_counts(df, df.columns) == {"a": 3, "b": 10, "c": 5, "d": 2, "e": 0}
    few = ranks.distinct_counts(df, df.columns, most=4)
    assert few["a"] == 3 and few["b"] >= 4 and few["c"] >= 4 and few["d"] == 2
    assert ranks.distinct_counts(df.limit(0), ["a"]) == {"a": 0} and ranks.distinct_counts(df, []) == {}
    assert "Expand" not in profile.column_metadata(df)._jdf.queryExecution().optimizedPlan().toString()


def plain_associations(pdf, texts, numbers):
    out = {}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            o = pd.crosstab(pdf[a], pdf[b]).to_numpy(float)
            if o.size:
                n, e = o.sum(), np.outer(o.sum(axis=1), o.sum(axis=0)) / o.sum()
                k = min(o.shape) - 1
                out[a, b] = float(np.sqrt(((o - e) ** 2 / e).sum() / (n * k))) if k > 0 else 0.0
        for c in numbers:
            both = pdf[[a, c]].dropna()
            if len(both):
                g = both.groupby(a)[c]
                between, total = (g.count() * (g.mean() - both[c].mean()) ** 2).sum(), ((both[c] - both[c].mean()) ** 2).sum()
                out[a, c] = float(np.sqrt(between / total)) if g.ngroups > 1 and both[c].nunique() > 1 else 0.0
    return out


@pytest.mark.parametrize("held", [5, 400_000])
def test_all_associations_from_one_table_of_cells(spark, monkeypatch, held):
    from sparkloom.operators import cube

    monkeypatch.setattr(cube, "HELD", held)
    rng = np.random.default_rng(6)
    n = 300
    pdf = pd.DataFrame({"k": rng.choice(list("abc"), n), "m": rng.choice(["x", "y", "é|;"], n), "one": "same", "id": [f"v{i}" for i in range(n)], "gone": None, "u": rng.normal(size=n) * 1e6 + 1e9, "v": rng.normal(size=n), "flat": 0.1})
    pdf["m"] = pdf["m"].where(rng.random(n) > 0.3, pdf["k"].map({"a": "x", "b": "y", "c": "x"}))
    pdf["v"] += pdf["k"].map({"a": 0, "b": 2, "c": 5})
    pdf = pdf.mask(rng.random(pdf.shape) < 0.1)
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "k string, m string, one string, id string, gone string, u double, v double, flat double").repartition(4)
    found = cube.associations(df, ["k", "m", "one", "id", "gone"], ["u", "v", "flat"])
    assert {(r["col_a"], r["col_b"]): r["value"] for r in found.collect()} == pytest.approx(plain_associations(pdf, ["k", "m", "one", "id", "gone"], ["u", "v", "flat"]), abs=1e-9)
    assert assoc.cramers_v(df, "gone", "k").first()["v"] == 0.0 and cube.associations(df.limit(0), ["k", "m"], ["u"]).count() == 0


def test_cleaning_leaves_nothing_in_the_shared_folder(spark, tmp_path):
    from sparkloom import store

    folder = f"{store.shared_dir(spark)}/left-{tmp_path.name}"
    token = store._FOLDER.set(folder)
    try:
        df = views.table(spark, SF, "dirty_lineitem")
        profile.numeric_profile(df).collect()
        outliers.iqr_report(df, ["qty"]).collect()
        path = folder.removeprefix("file:")
        import os

        assert not os.path.exists(path) or os.listdir(path) == []
        spark.sparkContext.setJobGroup(folder, "")
        with store.scratch(spark):
            cleaned, _ = clean.clean(df)
            assert cleaned.count() > 0 and len(os.listdir(path)) == 1
        assert os.listdir(path) == []
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(folder)) <= 45
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    finally:
        store._FOLDER.reset(token)


def test_top_values(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "a"), (None, "b")], "p string, q string")
    found = {r["column"]: (r["unique_count"], r["top_value"]) for r in ranks.top_values(df, ["p", "q"]).collect()}
    assert found == {"p": (2, "x"), "q": (2, "a")}


def line_by_line(text, sep=","):
    import csv
    import io

    return [tuple(r) for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]


def test_line_break_after_thousands_of_plain_rows(spark, tmp_path):
    path = write(tmp_path, "a,b\n" + "".join(f"x{i},{i}\n" for i in range(2500)) + '"p\nq",9999\n')
    df = ingest.read_delimited(spark, path)
    assert df.count() == 2501 and df.where("b = 9999").first()["a"] == "p\nq"


@pytest.mark.parametrize("seed", range(3))
def test_records_across_many_splits(spark, tmp_path, seed):
    """Splits of a few hundred bytes, cells longer than several splits, quotes that open nothing."""
    import random

    rng = random.Random(seed)
    cells = ['plain', '5" pipe', '"q,u"', '"a ""b"" c"', '"two\nlines"', '"\n\n"', '""', "", '"' + "long\n" * 300 + '"', '"x\n""y""\n,z"', "é漢"]
    rows = [[str(i), *rng.choices(cells, [9, 2, 3, 2, 2, 1, 1, 1, 0.3, 1, 2], k=2)] for i in range(400)]
    text = "id,a,b\n" + "".join(",".join(r) + rng.choice(["\n", "\n", "\n\n"]) for r in rows)
    path = write(tmp_path, text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        found = records.records(spark, path, ",")
        assert found.rdd.getNumPartitions() > 5 or found.select(F.spark_partition_id()).distinct().count() > 1
        got = sorted((r["__row_id"], r["value"]) for r in found.collect())
        assert [i for i, _ in got] == list(range(len(got)))
        assert [line_by_line(v)[0] for _, v in got] == line_by_line(text)
        df = ingest.read_delimited(spark, path)
        assert [r["id"] for r in df.orderBy("__row_id").collect()] == list(range(400))
        expected = {int(r[0]): tuple(x or None for x in r[1:]) for r in line_by_line(text)[1:]}
        assert {r["id"]: (r["a"], r["b"]) for r in df.collect()} == {k: tuple(None if x is None or not x.strip(" ") else x for x in v) for k, v in expected.items()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_states_of_lines_against_the_csv_module():
    import csv
    import random

    rng, quoting = random.Random(7), records.Quoting.by(",")
    for _ in range(3000):
        line = "".join(rng.choices(['"', ",", "a", " "], [3, 2, 3, 0], k=rng.randint(0, 9)))
        rows = list(csv.reader([line + "\n", "end\n"]))
        assert (quoting.after(line, records.START) == records.QUOTED) == (len(rows) == 1), line
        rows = list(csv.reader(['"open\n', line + "\n", "end\n"]))
        assert (quoting.after(line, records.QUOTED) == records.QUOTED) == (len(rows) == 1), line


def test_other_line_ends_and_headers(spark, tmp_path):
    df = ingest.read_delimited(spark, write(tmp_path, b'\xef\xbb\xbf"a",a,,A\r\n"x\r\ny",1,2,3\r\n\r\nz,4,5,6\r\n', "crlf.csv"))
    assert df.columns == ["__row_id", "a", "a.1", "Unnamed: 2", "A.2"]
    assert [tuple(r) for r in df.orderBy("__row_id").collect()] == [(0, "x\r\ny", 1, 2, 3), (1, "z", 4, 5, 6)]
    mac = ingest.read_delimited(spark, write(tmp_path, b'a,b\r"x\ry",1\rz,2\r', "mac.csv"))
    assert [tuple(r) for r in mac.orderBy("__row_id").collect()] == [(0, "x\ry", 1), (1, "z", 2)]
    open_ = ingest.read_delimited(spark, write(tmp_path, 'a,b\n1,2\n3,"never closed\n4,5\n', "open.csv"))
    assert open_.count() == 2


# correlation ---------------------------------------------------------------------------------------


def test_masked_correlations_against_pandas(spark):
    """Missing values, constants, pairs that share no row or a constant stretch, infinities, repeated columns' names apart."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(200, 6)) * [1, 1e-3, 1e6, 1, 1, 1] + [0, 5, 1e9, 0, 0, 0], columns=list("abcdef"))
    pdf["b"] += pdf["a"] * 1e-3
    pdf = pdf.mask(rng.random(pdf.shape) < 0.2)
    pdf["flat"], pdf["none"], pdf["third"] = 0.1, np.nan, 1 / 3
    pdf.loc[100:, "d"], pdf.loc[:99, "e"] = np.nan, np.nan
    pdf.loc[:, "step"] = np.where(pdf.index < 100, 7.1, pdf.index)  # constant where d is there
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)], ", ".join(f"{c} double" for c in pdf)).repartition(4)
    found = {(r["col_a"], r["col_b"]): r["r"] for r in assoc.correlation_pairs(df, list(pdf)).collect()}
    expected = pdf.corr()
    assert len(found) == 45
    for (a, b), r in found.items():
        common = pdf[[a, b]].dropna()
        if len(common) < 1 or common[a].nunique() < 2 or common[b].nunique() < 2:
            assert r is None, (a, b, r)
        else:
            assert r == pytest.approx(expected.loc[a, b], abs=1e-9), (a, b)
    matrix = assoc.correlation_matrix(df, ["a", "flat", "b"]).collect()
    assert len(matrix) == 9 and {(r["col_a"], r["col_b"]): r["r"] for r in matrix}[("a", "a")] == 1.0
    infinite = spark.createDataFrame([(1.0, 2.0, 1.0), (float("inf"), 3.0, 4.0), (2.0, 5.0, 3.0)], "a double, b double, c double")
    r = {(r["col_a"], r["col_b"]): r["r"] for r in assoc.correlation_pairs(infinite, ["a", "b", "c"]).collect()}
    assert math.isnan(r["a", "b"]) and r["b", "c"] == pytest.approx(np.corrcoef([2, 3, 5], [1, 4, 3])[0, 1])
    assert assoc.correlation_pairs(infinite.limit(0), ["a", "b"]).where("r is not null").count() == 0


def test_five_hundred_columns_in_one_scan(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 500))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").select(*[F.col("v")[i].alias(f"c{i}") for i in range(500)])
    pairs = assoc.correlation_pairs(df, df.columns)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    found = np.eye(500)
    for r in pairs.collect():
        found[r["i"], r["j"]] = found[r["j"], r["i"]] = r["r"]
    assert np.allclose(found, np.corrcoef(x.T))


# catalogue -----------------------------------------------------------------------------------------


def test_versions_switch_with_the_analysis(spark, tmp_path, monkeypatch):
    """A writer that dies between tables and switch loses nothing; raw rows are cleaned again with other settings."""
    rows = "\n".join(f"{i % 40},{i % 40 * 2 + (i * 7) % 5},{'xyz'[i % 3]}" for i in range(120)) + "\n5000,1,x\n"
    a = Analyst(spark, str(tmp_path / "store"))
    key = a.analyze(write(tmp_path, f"size,price,kind\n{rows}"))["file_id"]
    before, kept = a.get_analysis(key), a.cleaned(key).count()
    assert before["cleaning_report"]["iqr_outlier_rows_removed"] == 1 and a.catalog.load_table(key, "raw").count() == 121
    with monkeypatch.context() as m:
        m.setattr(Catalog, "store", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            a.reclean(key, clean.Settings(remove_outliers=False))
    assert a.get_analysis(key) == before and a.cleaned(key).count() == kept
    after = a.reclean(key, clean.Settings(remove_outliers=False))
    assert after["cleaning_report"]["iqr_outlier_rows_removed"] == 0 and a.cleaned(key).count() > kept
    assert not after["cleaning_settings"]["remove_outliers"] and len(a.list_files()) == 1
    versions = a.catalog.versions(key)
    assert a.catalog._names(f"{a.catalog.folder}/cleaned/file_id={key}") == [f"version={versions['cleaned']}"]
    a.catalog._remove(a.catalog._path(key, "cleaned", versions["cleaned"]))
    assert a.cleaned(key).count() > kept  # rebuilt from the raw rows, with the settings of the analysis
    assert a.delete(key) and a.list_files() == []


def test_messages_are_merged_and_read_newest_first(spark, tmp_path, monkeypatch):
    from sparkloom.sources import catalog as module

    monkeypatch.setattr(module, "MOST_FILES", 4)
    c = Catalog(spark, str(tmp_path))
    for i in range(11):
        c.add_message("f1", f"q{i}", f"a{i}")
    c.add_message("f2", "other", "x")
    bucket = f"{tmp_path}/chat/file_id=f1/" + c._names(f"{tmp_path}/chat/file_id=f1")[0]
    assert len(c._data_files(bucket)) <= 5
    assert [r["question"] for r in c.messages("f1").collect()] == [f"q{i}" for i in reversed(range(11))]
    assert [r["question"] for r in c.messages("f1", 3).collect()] == ["q10", "q9", "q8"]
    # a merge that died before the old files went: rows are there twice and count once
    old = c._data_files(bucket)
    monkeypatch.setattr(Catalog, "_remove", lambda *_: None)
    c.merge_messages(bucket)
    assert len(c._data_files(bucket)) == len(old) + 1 and c.messages("f1").count() == 11
    older = bucket.replace("bucket=", "bucket=1")[:-1]  # an earlier month
    spark.createDataFrame([("z", "old", "a", pd.Timestamp("2001-01-01").to_pydatetime())], "id string, question string, answer string, created_at timestamp").write.parquet(older)
    assert c.messages("f1").count() == 12 and c.messages("f1", 2).count() == 2
    read = [f for f in c.messages("f1", 2).inputFiles()]
    assert read and not any(older.rsplit("/", 1)[1] + "/" in f for f in read)
    assert c.messages("none").count() == 0


def test_balanced_objects_in_columns(spark):
    import random

    def plain(text):
        start, depth, quote, skip = text.find("{"), 0, None, False
        for i in range(start, len(text)) if start >= 0 else ():
            c = text[i]
            if skip:
                skip = False
            elif quote:
                skip, quote = c == "\\", None if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    return text[start : i + 1]
        return None

    rng = random.Random(5)
    texts = ["".join(rng.choices(["{", "}", '"', "'", "\\", "a", "é\n"], [3, 3, 2, 1, 2, 3, 1], k=rng.randint(0, 25))) for _ in range(800)]
    texts += ['say {"a": "}", "b": {"c": 1}} end', "no braces", "", '{"q": "\\"}"} x']
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", insights.json_object(F.col("t")).alias("o"))
    assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        assert r["o"] == (None if r["t"] is None else plain(r["t"])), r["t"]
        if r["t"] is not None:
            assert insights.balanced_object(r["t"]) == plain(r["t"])


def test_all_subsets_by_pivots_equal_least_squares():
    import itertools

    rng = np.random.default_rng(2)
    names = [f"f{i}" for i in range(8)]
    x = rng.normal(size=(400, 9))
    x[:, 3] = x[:, 1] + 0.01 * x[:, 3]  # nearly the same
    x[:, 8] = x[:, 1] - 2 * x[:, 5] + x[:, 8]
    whole = np.column_stack([np.ones(400), x])
    sums = {(r, role): (part := whole[rng.permutation(400)[: 280 if role == "train" else 60]]).T @ part for r in range(gram.REPEATS) for role in ("train", "validate")}
    g = gram.Grams(names, np.zeros(9), np.ones(9), sums, 400)
    found = g.subset_scores(names, 6)
    every = [s for k in range(1, 7) for s in itertools.combinations(names, k)]
    assert set(found) == set(every)
    assert max(abs(found[s] - g.score(list(s))) for s in every) < 1e-9
    whole[:, 2] = whole[:, 1] * 3  # dependent: left to least squares
    bad = {key: whole.T @ whole for key in sums}
    assert gram.Grams(names, np.zeros(9), np.ones(9), bad, 400).subset_scores(names, 6) == {}
    score = train.Scorer.__new__(train.Scorer)
    score.kind, score.grams, score.seen = "regression", g, {}
    best = select.exhaustive(names, score, 6, 0.001)
    plain = select.exhaustive(names, g.score, 6, 0.001)
    assert best[0] == plain[0] and best[1] == pytest.approx(plain[1])


def test_mentioned_columns_searches_each_text_once(spark):
    from sparkloom.plans.catalogue import NAMES, QUERIES

    plan = QUERIES["mentioned_columns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == sum(len(n) > 1 for n in NAMES)


def test_associations_count_their_cells_once(spark):
    """Pairs of texts and pairs with a number come from the same scan."""
    from sparkloom.operators import cube

    df = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0), ("a", "y", 4.0)], "s string, t string, n double")
    found = cube.associations(df, ["s", "t"], ["n"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(r["measure"] for r in found.collect()) == ["eta", "eta", "v"]
