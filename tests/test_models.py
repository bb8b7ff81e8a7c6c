"""Planted panels and brute force for the fits that SQL cannot express."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pressgauge.operators import clusters, regression
from pressgauge.operators import series as s


def panel(n=90, seed=3):
    rng = np.random.default_rng(seed)
    frames = []
    for region, lag, weight in (("A", 2, 1.5), ("B", 4, -2.0)):
        x, noise = rng.normal(size=(2, n))
        y = weight * np.roll(x, lag) + 0.2 * rng.normal(size=n)
        frames.append(pd.DataFrame({"region_key": region, "t": range(n), "signal": x, "noise": noise, "y": y}).iloc[lag:])
    return pd.concat(frames)


@pytest.fixture(scope="module")
def planted(spark):
    return spark.createDataFrame(panel()).persist()


def fits(planted, lags=(1, 2, 3, 4)):
    rows = regression.design_rows(planted, {"all": ["signal", "noise"]}, "y", ["region_key"], "t", list(lags))
    return rows, regression.lasso_fits(rows, ["region_key"], "t")


def test_planted_lag_is_found(planted):
    _, result = fits(planted)
    best = {r["region_key"]: (r["feature"], r["lag"]) for r in regression.winners_by_size(result, ["region_key"], 1).collect()}
    assert best == {"A": ("signal", 2), "B": ("signal", 4)}
    strong = result.filter("region_key = 'A' AND lag = 2 AND feature = 'signal'").first()
    assert strong["coef"] > 1.0 and strong["p_value"] < 1e-6
    noise = result.filter("region_key = 'A' AND lag = 2 AND feature = 'noise'").first()
    assert abs(noise["coef"]) < 0.1


def test_lasso_satisfies_its_optimality_conditions(planted):
    rows, result = fits(planted)
    data = rows.filter("region_key = 'A' AND lag = 2").toPandas()
    x, y = np.array(data["x"].tolist()), data["y"].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    fit = result.filter("region_key = 'A' AND lag = 2").toPandas().set_index("feature")
    w = fit.loc[list(data["features"][0]), "coef"].to_numpy()
    gradient = z.T @ (y - y.mean() - z @ w) / len(y)
    alpha = fit["alpha"].iloc[0]
    assert np.abs(gradient).max() <= alpha + 1e-6
    assert np.allclose(gradient[w != 0], alpha * np.sign(w[w != 0]), atol=1e-6)


def test_two_sided_p():
    assert regression._two_sided_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert regression._two_sided_p(1.0, 1) == pytest.approx(0.5, abs=1e-9)


def test_p_values_equal_plain_least_squares(planted):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows, result = fits(planted)
    one = rows.filter("region_key = 'B' AND lag = 4").select("y", *[F.col("x")[i].alias(f"x{i}") for i in range(3)])
    model = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(
        VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="f").transform(one))
    got = {r["feature"]: r["p_value"] for r in result.filter("region_key = 'B' AND lag = 4 AND coef != 0").collect()}
    if len(got) == 3:
        expected = dict(zip(["signal", "noise", regression.INERTIA], model.summary.pValues))
        assert all(got[k] == pytest.approx(expected[k], abs=1e-8) for k in got)
    else:
        assert "signal" in got


def test_hold_out_matches_brute_force(planted):
    rows = regression.design_rows(planted, {"all": ["signal", "noise"]}, "y", ["region_key"], "t", [2])
    got = regression.hold_out_errors(rows, ["region_key"], "t").filter("region_key = 'A'").first()
    data = rows.filter("region_key = 'A'").orderBy("t").toPandas()
    cut = int(len(data) * 0.75)
    past = np.array(data["x"].tolist())[:, -1]
    design = np.column_stack([np.ones(cut), past[:cut]])
    beta = np.linalg.lstsq(design, data["y"][:cut], rcond=None)[0]
    rest = data["y"][cut:] - beta[0] - beta[1] * past[cut:]
    assert got["rmse_naive"] == pytest.approx(float(np.sqrt((rest**2).mean())))
    assert got["rmse_full"] < got["rmse_naive"] / 2 and got["n_test"] == len(data) - cut


def test_certificates_tell_optimal_fits_from_others(planted):
    rows, result = fits(planted)
    proofs = regression.lasso_certificates(rows, result, ["region_key"]).toPandas()
    assert len(proofs) == 8 and (proofs["n_features"] == 3).all() and (proofs["breach"] < 1e-6).all()
    worse = result.withColumn("coef", F.when(F.col("feature") == "signal", F.col("coef") + 0.01).otherwise(F.col("coef")))
    breach = regression.lasso_certificates(rows, worse, ["region_key"]).toPandas()["breach"]
    assert (breach > 1e-4).all()


def test_rolling_ridge_matches_brute_force(planted):
    rows = regression.design_rows(planted, {"all": ["signal", "noise"]}, "y", ["region_key"], "t", [2]).filter("region_key = 'A'")
    got = regression.rolling_ridge(rows, 3, ["region_key"], "t", 48).toPandas()
    data = rows.orderBy("t").toPandas()
    assert got["t"].nunique() == len(data) - 48
    end = data.index[60]
    window = data.iloc[end - 47 : end + 1]
    x, y = np.array(window["x"].tolist()), window["y"].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    part = got[got["t"] == data["t"][end]].set_index("feature")["coef"]
    assert np.allclose(part.loc[["signal", "noise", regression.INERTIA]], w)


def test_partial_autocorrelation_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    y = np.zeros(120)
    for i in range(2, 120):
        y[i] = 0.6 * y[i - 1] - 0.3 * y[i - 2] + rng.normal()
    series = spark.createDataFrame(pd.DataFrame({"t": range(120), "y": y}))
    got = regression.partial_autocorrelation(series, "y", [], "t", 6).orderBy("lag").toPandas()["pacf"].to_numpy()
    for k in range(1, 7):
        design = np.column_stack([np.ones(120 - k)] + [y[k - 1 - j : 119 - j] for j in range(k)])
        assert got[k] == pytest.approx(np.linalg.lstsq(design, y[k:], rcond=None)[0][-1], abs=1e-8)


def test_hierarchical_selection(planted):
    wide = planted.withColumnsRenamed({"signal": "energy_coal", "noise": "energy_wind"}).withColumn(
        "energy", F.col("energy_coal")).withColumn("idle", F.col("energy_wind"))
    got = regression.hierarchical_selection(
        wide, ["energy", "idle"], {"energy": ["energy_coal", "energy_wind"]}, "y", ["region_key"], "t", [1, 2, 3, 4])
    best = {r["region_key"]: r["feature"] for r in got.filter("rank = 1").collect()}
    assert best == {"A": "energy_coal", "B": "energy_coal"}


def test_a_sparse_series_changes_only_its_own_models(planted):
    """Every other value of one series is missing: models without it keep all their rows, its own align alone."""
    sparse = planted.withColumn("rare", F.when(F.col("t") % 2 == 0, F.col("noise")))
    models = {"plain": ["signal", "noise"], "with": ["signal", "rare"]}
    key = ["region_key", "t", "model", "lag", "y", "x"]
    got = regression.design_rows(sparse, models, "y", ["region_key"], "t", [-1, 0, 2]).select(key)
    whole = regression.design_rows(planted, {"plain": models["plain"]}, "y", ["region_key"], "t", [-1, 0, 2]).select(key)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got.filter("model = 'plain'")) == rows(whole)
    data = planted.filter("region_key = 'A' and t % 2 = 0").orderBy("t").toPandas()
    mine = got.filter("model = 'with' and region_key = 'A' and lag = 2").orderBy("t").toPandas()
    assert mine["t"].tolist() == data["t"].tolist()[2:]
    want = np.column_stack([data["signal"], data["noise"], data["y"]])[:-2]
    assert np.allclose(np.array(mine["x"].tolist()), want)


def test_isolated_winners_lead_jointly(planted):
    """A noisy copy of the signal leads alone, but not beside the signal."""
    wide = planted.withColumn("copy", F.col("signal") + F.col("noise"))
    names, lags = ["signal", "copy"], [1, 2, 3, 4]
    alone = regression.lasso_fits(regression.design_rows(wide, {n: [n] for n in names}, "y", ["region_key"], "t", lags), ["region_key"], "t")
    without = {(r["region_key"], r["feature"]) for r in regression.winners_by_size(alone, ["region_key"], 2).collect()}
    joint = regression.lasso_fits(regression.design_rows(wide, {"all": names}, "y", ["region_key"], "t", lags), ["region_key"], "t")
    passed = {(r["region_key"], r["feature"]) for r in regression.significant(joint).collect()}
    got = {(r["region_key"], r["feature"]) for r in regression.isolated_winners(wide, names, "y", ["region_key"], "t", lags, 2).collect()}
    assert got == without & passed and got != without and {("A", "signal"), ("B", "signal")} <= got


def test_best_predictor(planted):
    tall = planted.select("region_key", "t", "y", F.inline(F.array(
        *[F.struct(F.lit(n).alias("series"), F.col(n).alias("x")) for n in ("signal", "noise")])))
    corr = s.lag_correlations(tall, "x", "y", ["region_key", "series"], "t", range(1, 7))
    best = {r["region_key"]: (r["series"], r["lag"]) for r in s.best_predictor(corr, ["region_key"], "series").collect()}
    assert best == {"A": ("signal", 2), "B": ("signal", 4)}


def test_planted_clusters_survive_scaling_and_projection(spark):
    rng = np.random.default_rng(0)
    centre = np.repeat([[0, 0], [10, 0], [0, 1000]], 40, axis=0)
    table = pd.DataFrame(centre + rng.normal(size=(120, 2)), columns=["a", "b"]).assign(true=np.repeat([0, 1, 2], 40))
    df = spark.createDataFrame(table)
    scale = clusters.standard_scale(df, ["a", "b"])
    scaled = clusters.scaled(df, scale)
    model = clusters.fit_kmeans(scaled, ["a", "b"], 3)
    pairs = clusters.assign(scaled, model).select("true", "cluster").distinct().count()
    assert pairs == 3
    scores = clusters.sweep(scaled, ["a", "b"], range(1, 5))
    assert clusters.best_k(scores) == 3 and scores.filter("k = 1").first()["pct_gain"] == 0.0
    back = clusters.scaled_centres(model, ["a", "b"], scale).filter("feature = 'b'").agg(F.max("original")).first()[0]
    assert back == pytest.approx(1000, abs=1)


def test_retention_reasons(spark):
    columns = ["cluster", "years_active", "inactive_days_rate", "cv_monthly", "log_articles_per_year", "h_norm_themes",
               "mean_themes_per_art", "ratio_eco", "h_norm_eco_themes"]
    rows = [(0, 5.0, 0.1, 0.5, 8.0, 0.9, 20.0, 0.2, 0.9), (1, 10.0, 0.1, 0.5, 8.0, 0.9, 20.0, 0.0, 0.0),
            (2, 10.0, 0.1, 0.5, 8.0, 0.1, 20.0, 0.2, 0.6), (3, 10.0, 0.1, 0.5, 8.0, 0.1, 20.0, 0.0, 0.6)]
    got = {r["cluster"]: r["reason"] for r in clusters.retention(spark.createDataFrame(rows, columns)).collect()}
    assert got == {0: clusters.IRREGULAR, 1: clusters.GENERALIST, 2: clusters.ECONOMIC, 3: clusters.POOR}
