"""Lagged regressions for many series at once.

Every model (a feature list) is fitted for every key and lag in one plan.
Spark turns the rows into sums of products per fold; a group that reaches
Python holds only those sums, whose number depends on the features and not
on the rows. Fold errors, lasso paths and p-values all follow from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.functions.columns import all_present, safe_ratio
from pressgauge.functions.labels import lag_name, significance_text
from pressgauge.operators.topk import first_per_group

# Fixed value: the row label of the autoregressive control.
INERTIA = "_PAST_MACRO_INERTIA_"
HOLD_OUT = -1
FOLDS = 5

Models = dict[str, list[str]]


# -- Design ------------------------------------------------------------------

def lagged_design(
    aligned: DataFrame, names: list[str], target: str, keys: list[str], time: str, lags: range
) -> DataFrame:
    """All lags of all features side by side, complete rows only."""
    window = Window.partitionBy(*keys).orderBy(time)
    columns = [F.lag(F.col(f"`{n}`"), lag).over(window).alias(f"{n}||{lag}") for n in names for lag in lags]
    wide = aligned.select(*keys, time, F.col(target), *columns)
    return wide.filter(all_present(wide.columns))


def design_rows(
    panel: DataFrame,
    models: Models,
    target: str,
    keys: list[str],
    time: str,
    lags: list[int],
    inertia: bool = True,
) -> DataFrame:
    """One row per (key, model, lag, period): ``x`` and ``y``.

    Each model is aligned alone: its rows are those in which the target and all
    its own features are present, and lags count such rows. A sparse series
    only changes the models that hold it. All models are one plan with one
    window, whatever their number. With ``inertia`` a model of a positive lag
    also gets the target's own past as its last feature.
    """
    sets = [
        F.struct(
            F.lit(model).alias("model"),
            F.array(*[F.lit(n) for n in features]).alias("_names"),
            F.array(*[F.col(f"`{n}`").cast("double") for n in features]).alias("_v"),
        )
        for model, features in models.items()
    ]
    rows = panel.select(*keys, time, F.col(target).alias("y"), F.inline(F.array(*sets)))
    rows = rows.filter(F.col("y").isNotNull() & F.forall("_v", lambda v: v.isNotNull()))
    window = Window.partitionBy(*keys, "model").orderBy(time)
    now = F.struct(F.col("_v").alias("v"), F.col("y").cast("double").alias("y"))
    rows = rows.select("*", *[F.lag(now, lag).over(window).alias(f"_{k}") for k, lag in enumerate(lags)])
    entries = []
    for k, lag in enumerate(lags):
        past = inertia and lag > 0
        entries.append(
            F.struct(
                F.lit(lag).alias("lag"),
                (F.concat("_names", F.array(F.lit(INERTIA))) if past else F.col("_names")).alias("features"),
                (F.concat(f"_{k}.v", F.array(f"_{k}.y")) if past else F.col(f"_{k}.v")).alias("x"),
            )
        )
    return rows.select(*keys, time, "model", "y", F.inline(F.array(*entries))).filter(F.col("x").isNotNull()).select(
        *keys, time, "y", "model", "lag", "features", "x"
    )


def with_folds(rows: DataFrame, group: list[str], time: str, test_ratio: float = 0.0, folds: int = FOLDS) -> DataFrame:
    """Contiguous folds in time order; the last ``test_ratio`` is held out."""
    ordered = Window.partitionBy(*group).orderBy(time)
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    numbered = rows.withColumn("_n", n).withColumn("_i", F.row_number().over(ordered) - 1)
    train = F.floor(F.col("_n") * (1 - test_ratio)).cast("int")
    size, extra = F.floor(train / folds).cast("int"), train % folds
    longer = extra * (size + 1)
    index = F.col("_i")
    fold = F.when(index >= train, HOLD_OUT).when(
        index < longer, F.floor(safe_ratio(index, size + 1))
    ).otherwise(extra + F.floor(safe_ratio(index - longer, size)))
    return numbered.withColumn("fold", fold.cast("int")).drop("_i")


def product_sums(rows: DataFrame, group: list[str]) -> DataFrame:
    """Sums of products of (1, x, y) per group and fold: (i, j, s), i <= j."""
    z = F.concat(F.array(F.lit(1.0)), F.col("x"), F.array(F.col("y").cast("double")))
    placed = rows.select(*group, "fold", F.posexplode(z).alias("i", "_a"), z.alias("_z"))
    pairs = placed.select(
        *group, "fold", "i", "_a", F.posexplode(F.slice("_z", F.col("i") + 1, F.size("_z"))).alias("_d", "_b")
    )
    return pairs.groupBy(*group, "fold", "i", (F.col("i") + F.col("_d")).alias("j")).agg(
        F.sum(F.col("_a") * F.col("_b")).alias("s")
    )


def _spread(sums: DataFrame, group: list[str]) -> DataFrame:
    """Few bytes, much arithmetic: one task per core, whatever the data size."""
    return sums.repartition(sums.sparkSession.sparkContext.defaultParallelism, *group).groupBy(*group)


# -- Small solvers on sums of products ---------------------------------------

def _grams(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
    """(folds, m, m) training sums and the held-out sums, if any."""
    m = int(pdf["j"].max()) + 1

    def full(part: pd.DataFrame) -> np.ndarray:
        g = np.zeros((m, m))
        g[part["i"], part["j"]] = part["s"]
        return np.triu(g) + np.triu(g, 1).T

    parts = {f: full(p) for f, p in pdf.groupby("fold")}
    held = parts.pop(HOLD_OUT, None)
    return np.stack([parts[f] for f in sorted(parts)]), held


def _centred(g: np.ndarray, mean: np.ndarray, spread: np.ndarray):
    """(n, own feature mean, target mean, X'X/n, X'y/n) on scaled features."""
    n = g[0, 0]
    x, y = (g[0, 1:-1] / n - mean) / spread, g[0, -1] / n
    own = g[0, 1:-1] / n
    xx = (g[1:-1, 1:-1] / n - np.outer(own, own)) / np.outer(spread, spread)
    xy = (g[1:-1, -1] / n - own * y) / spread
    return n, x, y, xx, xy


def _lasso_paths(xx: np.ndarray, xy: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Coordinate descent for all fits and penalties together: (fits, alphas, p).

    Sweeps go on until no weight moves by more than a hundred-millionth of the
    largest; the objective falls with every sweep, so they end.
    """
    fits, p = xy.shape
    w = np.zeros((fits, len(alphas), p))
    diagonal = np.einsum("fjj->fj", xx)
    while True:
        change = 0.0
        for j in range(p):
            rest = xy[:, j, None] - np.einsum("fap,fp->fa", w, xx[:, j]) + diagonal[:, j, None] * w[:, :, j]
            shrunk = np.sign(rest) * np.maximum(np.abs(rest) - alphas, 0.0)
            new = np.divide(shrunk, diagonal[:, j, None], out=np.zeros_like(shrunk), where=diagonal[:, j, None] > 1e-12)
            change = max(change, float(np.abs(new - w[:, :, j]).max()))
            w[:, :, j] = new
        if change <= 1e-8 * max(1.0, float(np.abs(w).max(initial=0.0))):
            return w


def _squared_error(g: np.ndarray, intercept: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean of (y - intercept - x w)^2 from the sums of raw products."""
    b = np.concatenate([-intercept[..., None], -weights, np.ones_like(intercept)[..., None]], axis=-1)
    return np.einsum("...i,ij,...j->...", b, g, b) / g[0, 0]


def _lasso_cv(parts: np.ndarray, steps: int = 100, reach: float = 1e-3):
    """(penalty, weights on scaled features, raw intercept, raw weights)."""
    whole = parts.sum(axis=0)
    n = whole[0, 0]
    mean = whole[0, 1:-1] / n
    spread = np.sqrt(np.maximum(np.diag(whole)[1:-1] / n - mean**2, 0.0))
    spread[spread < 1e-12] = 1.0
    stats = [_centred(whole - part, mean, spread) for part in parts] + [_centred(whole, mean, spread)]
    top = np.abs(stats[-1][4]).max()
    alphas = top * np.logspace(0, np.log10(reach), steps) if top > 0 else np.zeros(steps)
    w = _lasso_paths(np.stack([s[3] for s in stats]), np.stack([s[4] for s in stats]), alphas)
    errors = np.zeros(steps)
    for part, (_, x, y, _, _), weights in zip(parts, stats, w):
        raw = weights / spread
        errors += _squared_error(part, y - weights @ x - raw @ mean, raw) / len(parts)
    best = int(np.argmin(errors))
    weights = w[-1, best]
    raw = weights / spread
    return float(alphas[best]), weights, float(whole[0, -1] / n - raw @ mean), raw


def _two_sided_p(t: float, df: float) -> float:
    """Student's t tail by quadrature over the angle atan(t / sqrt(df))."""
    nodes, weights = np.polynomial.legendre.leggauss(200)

    def mass(low: float) -> float:
        half = (np.pi / 2 - low) / 2
        theta = low + half * (nodes + 1)
        return float(half * (weights * np.cos(theta) ** (df - 1)).sum())

    return mass(float(np.arctan(abs(t) / np.sqrt(df)))) / mass(0.0)


def _ols_p_values(whole: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Least-squares p-values of the chosen features, 1.0 elsewhere."""
    p_values = np.ones(whole.shape[0] - 2)
    keep = np.flatnonzero(chosen)
    df = whole[0, 0] - len(keep) - 1
    if not len(keep) or df <= 0:
        return p_values
    index = np.concatenate([[0], keep + 1])
    inverse = np.linalg.pinv(whole[np.ix_(index, index)])
    beta = inverse @ whole[index, -1]
    rss = max(float(whole[-1, -1] - beta @ whole[index, -1]), 0.0)
    deviation = np.sqrt(np.maximum(np.diag(inverse) * rss / df, 1e-300))
    for k, b, s in zip(keep, beta[1:], deviation[1:]):
        p_values[k] = _two_sided_p(b / s, df)
    return p_values


# -- Fits --------------------------------------------------------------------

def lasso_fits(rows: DataFrame, keys: list[str], time: str, min_rows: int = 20) -> DataFrame:
    """Cross-validated lasso per (key, model, lag), then p-values on survivors.

    Returns (keys, model, lag, feature, coef, p_value, n_rows, alpha).
    """
    group = [*keys, "model", "lag"]
    folded = with_folds(rows, group, time).filter(F.col("_n") >= min_rows)
    sums = product_sums(folded, [*group, "features"])

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts, _ = _grams(pdf)
        alpha, weights, _, _ = _lasso_cv(parts)
        whole = parts.sum(axis=0)
        names = list(key[-1])
        fixed = {k: v for k, v in zip(group, key)}
        return pd.DataFrame(
            {
                **{k: [v] * len(names) for k, v in fixed.items()},
                "feature": names,
                "coef": weights,
                "p_value": _ols_p_values(whole, weights != 0),
                "n_rows": int(whole[0, 0]),
                "alpha": alpha,
            }
        )

    types = dict(rows.dtypes)
    schema = ", ".join(
        [*[f"`{k}` {types[k]}" for k in group], "feature string, coef double, p_value double, n_rows long, alpha double"]
    )
    return _spread(sums, [*group, "features"]).applyInPandas(solve, schema)


def lasso_certificates(rows: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """How far each fit of ``lasso_fits`` is from the optimum of its penalty.

    Computed from the rows and the weights alone, without the sums and the
    solver. At the optimum the mean product g of a scaled feature and the
    residual equals the penalty, with the weight's sign, where the weight is
    not 0, and stays within the penalty elsewhere. ``breach`` is the largest
    excess over that, as a part of the largest g of the empty model. Returns
    (keys, model, lag, n_rows, n_features, n_active, alpha, breach).
    """
    group = [*keys, "model", "lag"]
    tall = rows.select(*group, "y", "features", F.posexplode("x").alias("j", "v"))
    moments = tall.groupBy(*group, "j", F.col("features")[F.col("j")].alias("feature")).agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.avg("y").alias("mean_y")
    )
    spread = F.when(F.col("s") < 1e-12, 1.0).otherwise(F.col("s")).alias("s")
    fitted = moments.join(fits.select(*group, "feature", "coef", "alpha"), [*group, "feature"])
    # One array per fit, as long as its feature list.
    solved = fitted.groupBy(*group, "alpha", "mean_y").agg(
        F.array_sort(F.collect_list(F.struct("j", "m", spread, F.col("coef").alias("w")))).alias("_fit")
    )
    z = F.zip_with("x", "_fit", lambda x, f: (x - f["m"]) / f["s"])
    joined = rows.join(solved, group).select(*group, "alpha", "_fit", (F.col("y") - F.col("mean_y")).alias("_y"), z.alias("_z"))
    explained = F.aggregate(F.zip_with("_z", "_fit", lambda z, f: z * f["w"]), F.lit(0.0), lambda a, b: a + b)
    products = joined.select(*group, "alpha", "_fit", "_y", "_z", (F.col("_y") - explained).alias("_r")).select(
        *group, "alpha", "_y", "_r", F.inline(F.arrays_zip(F.col("_fit.w").alias("w"), F.col("_fit.j").alias("j"), F.col("_z").alias("z")))
    )
    slopes = products.groupBy(*group, "alpha", "j", "w").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("z") * F.col("_r")).alias("g"), F.abs(F.avg(F.col("z") * F.col("_y"))).alias("top")
    )
    excess = F.when(F.col("w") == 0, F.greatest(F.abs("g") - F.col("alpha"), F.lit(0.0))).otherwise(
        F.abs(F.col("g") - F.col("alpha") * F.signum("w"))
    )
    return slopes.groupBy(*group, "alpha").agg(
        F.max("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(F.col("w") != 0).alias("n_active"),
        F.coalesce(safe_ratio(F.max(excess), F.max("top")), F.lit(0.0)).alias("breach"),
    )


def hold_out_errors(
    rows: DataFrame, keys: list[str], time: str, test_ratio: float = 0.25, min_rows: int = 20
) -> DataFrame:
    """Root-mean-square error on the last rows: own past alone vs full lasso.

    The scale is fitted on the training rows only. Returns (keys, model, lag,
    n_train, n_test, rmse_naive, rmse_full, gain_pct).
    """
    group = [*keys, "model", "lag"]
    split = with_folds(rows, group, time, test_ratio).filter(F.col("_n") >= min_rows)
    sums = product_sums(split, [*group, "features"])

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts, held = _grams(pdf)
        if held is None:
            return pd.DataFrame()
        whole = parts.sum(axis=0)
        past = [0, list(key[-1]).index(INERTIA) + 1]
        beta = np.linalg.pinv(whole[np.ix_(past, past)]) @ whole[past, -1]
        naive = np.zeros(whole.shape[0] - 2)
        naive[past[1] - 1] = beta[1]
        _, _, intercept, raw = _lasso_cv(parts)
        rmse = [
            float(np.sqrt(max(_squared_error(held, np.array(a), w), 0.0)))
            for a, w in ((float(beta[0]), naive), (intercept, raw))
        ]
        return pd.DataFrame(
            {
                **{k: [v] for k, v in zip(group, key)},
                "n_train": [int(whole[0, 0])],
                "n_test": [int(held[0, 0])],
                "rmse_naive": [rmse[0]],
                "rmse_full": [rmse[1]],
            }
        )

    types = dict(rows.dtypes)
    schema = ", ".join(
        [*[f"`{k}` {types[k]}" for k in group], "n_train long, n_test long, rmse_naive double, rmse_full double"]
    )
    gain = safe_ratio(F.col("rmse_naive") - F.col("rmse_full"), F.col("rmse_naive")) * 100
    return _spread(sums, [*group, "features"]).applyInPandas(solve, schema).withColumn("gain_pct", gain)


def rank_regions(errors: DataFrame) -> DataFrame:
    return errors.orderBy(F.desc("gain_pct"), "region_key")


def rolling_ridge(
    rows: DataFrame, n_features: int, keys: list[str], time: str, window: int = 48, alpha: float = 1.0
) -> DataFrame:
    """Ridge coefficients of every full window of ``window`` rows.

    Sums of products slide with the window, so a row is touched once and not
    once per window. The window that ends at the last row is left out. Returns
    (keys, model, lag, time, feature, coef).
    """
    group = [*keys, "model", "lag"]
    order = Window.partitionBy(*group).orderBy(time)
    frame = order.rowsBetween(1 - window, 0)
    m = n_features + 2
    z = [F.lit(1.0), *[F.col("x")[i] for i in range(n_features)], F.col("y").cast("double")]
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    sums = F.array(*[F.sum(z[i] * z[j]).over(frame) for i, j in pairs]).alias("sums")
    fits = F.assert_true(F.size("x") == n_features, F.lit(f"a row has another number of features than {n_features}"))
    full = rows.filter(fits.isNull()).select(
        *group, time, "features", sums, F.count(F.lit(1)).over(frame).alias("_n"), F.lead("y").over(order).alias("_next")
    )
    kept = full.filter((F.col("_n") == window) & F.col("_next").isNotNull()).select(*group, time, "features", "sums")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above, below = np.array(pairs).T
        for batch in batches:
            # All windows of a batch at once: (windows, m, m) sums of products.
            g = np.zeros((len(batch), m, m))
            g[:, above, below] = g[:, below, above] = np.array(batch["sums"].tolist()).reshape(len(batch), len(pairs))
            n, x, y = g[:, 0, 0, None], g[:, 0, 1:-1], g[:, 0, -1, None]
            spread = np.sqrt(np.maximum(np.einsum("bii->bi", g)[:, 1:-1] / n - (x / n) ** 2, 0.0))
            spread[spread < 1e-12] = 1.0
            xx = (g[:, 1:-1, 1:-1] - x[:, :, None] * x[:, None] / n[..., None]) / (spread[:, :, None] * spread[:, None])
            xy = (g[:, 1:-1, -1] - x * y / n) / spread
            out = np.linalg.solve(xx + alpha * np.eye(n_features), xy[..., None])[..., 0]
            yield batch.drop(columns="sums").assign(coef=list(out))

    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in group], f"`{time}` {types[time]}", "features array<string>, coef array<double>"])
    solved = kept.mapInPandas(solve, schema)
    return solved.select(
        *group, time, F.inline(F.arrays_zip(F.col("features").alias("feature"), F.col("coef").alias("coef")))
    )


def simple_fits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Slope, intercept and correlation of one-feature models, built in."""
    x = F.col("x")[0]
    return rows.groupBy(*keys, "model", "lag").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.regr_slope("y", x).alias("slope"),
        F.regr_intercept("y", x).alias("intercept"),
        F.regr_r2("y", x).alias("r2"),
    )


# -- Selection ---------------------------------------------------------------

def significant(fits: DataFrame, level: float = 0.05) -> DataFrame:
    """Leading fits (positive lag) of real features below the level."""
    return fits.filter(
        (F.col("lag") > 0) & (F.col("p_value") < level) & (F.col("coef") != 0) & (F.col("feature") != INERTIA)
    )


def coefficient_table(fits: DataFrame, keys: list[str], lags: list[int]) -> DataFrame:
    """Feature rows, one text column per lag, ``0.00`` where nothing fitted."""
    text = fits.select(*keys, "model", "feature", "lag", significance_text(F.col("coef"), F.col("p_value")).alias("t"))
    pivoted = text.groupBy(*keys, "model", "feature").pivot("lag", lags).agg(F.first("t"))
    names = [lag_name(x) for x in lags]
    return pivoted.select(
        *keys,
        "model",
        "feature",
        *[
            F.coalesce(F.col(f"`{x}`"), F.when(F.col("feature") == INERTIA, "N/A").otherwise("0.00")).alias(n)
            if x <= 0
            else F.coalesce(F.col(f"`{x}`"), F.lit("0.00")).alias(n)
            for x, n in zip(lags, names)
        ],
    )


def winners_by_size(fits: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` features with the largest significant leading coefficient."""
    size = F.abs("coef")
    best = significant(fits).groupBy(*keys, "model", "feature").agg(
        F.max(size).alias("abs_coef"), F.max_by("lag", size).alias("lag")
    )
    return first_per_group(best, keys, [F.desc("abs_coef"), F.col("model"), F.col("feature")], n)


def isolated_winners(
    aligned: DataFrame, names: list[str], target: str, keys: list[str], time: str, lags: list[int], n: int
) -> DataFrame:
    """The ``n`` largest leading series, each fitted alone, of those that lead in the joint fit."""
    joint = lasso_fits(design_rows(aligned, {"all": names}, target, keys, time, lags), keys, time)
    passed = significant(joint).select(*keys, F.col("feature").alias("model")).distinct()
    alone = design_rows(aligned, {x: [x] for x in names}, target, keys, time, lags)
    return winners_by_size(lasso_fits(alone.join(passed, [*keys, "model"], "left_semi"), keys, time), keys, n)


def hierarchical_selection(
    panel: DataFrame,
    sectors: list[str],
    children: Models,
    target: str,
    keys: list[str],
    time: str,
    lags: list[int],
    keep: int = 5,
) -> DataFrame:
    """Sectors that lead the target, then the best of their sub-categories.

    Sectors compete first. Those significant at a positive lag pass; their
    sub-categories are fitted among themselves and the largest significant
    leading one per sector is kept. A sector without sub-categories stands
    for itself. Each competing set is aligned alone. The result is the ``keep`` largest per key.
    """
    first = lasso_fits(design_rows(panel, {"sectors": sectors}, target, keys, time, lags), keys, time)
    passed = significant(first).groupBy(*keys, F.col("feature").alias("parent")).agg(F.max(F.abs("coef")).alias("abs_coef"))
    nested = {s: c for s, c in children.items() if c}
    own = passed.filter(~F.col("parent").isin(list(nested))).select(
        *keys, "parent", F.col("parent").alias("feature"), "abs_coef"
    )
    if not nested:
        found = own
    else:
        inner = design_rows(panel, nested, target, keys, time, lags)
        chosen = passed.select(*keys, F.col("parent").alias("model"))
        # Sectors and keys are configuration-sized; no hint is needed.
        fits = significant(lasso_fits(inner.join(chosen, [*keys, "model"], "left_semi"), keys, time))
        best = fits.groupBy(*keys, F.col("model").alias("parent")).agg(
            F.max_by("feature", F.abs("coef")).alias("feature"), F.max(F.abs("coef")).alias("abs_coef")
        )
        found = own.unionByName(best)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("abs_coef"), "parent"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= keep)


def partial_autocorrelation(
    series: DataFrame, value: str, keys: list[str], time: str, max_lag: int = 40
) -> DataFrame:
    """Last least-squares coefficient of each autoregression of order 1..max.

    Order k uses all rows from k on. Rows are summed by min(row number,
    max_lag), so at most max_lag + 1 sums of products per series reach the
    solver, however long the series. Returns (keys, lag, pacf).
    """
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(time)
    lagged = series.select(
        *keys,
        F.col(value).cast("double").alias("y"),
        (F.row_number().over(order) - 1).alias("_i"),
        F.array(*[F.coalesce(F.lag(value, k).over(order).cast("double"), F.lit(0.0)) for k in range(1, max_lag + 1)]).alias("x"),
    ).withColumn("fold", F.least("_i", F.lit(max_lag)))
    group = keys or ["_all"]
    placed = lagged if keys else lagged.withColumn("_all", F.lit(0))
    sums = product_sums(placed.select(*group, "fold", "x", "y"), group)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = max_lag + 2
        parts = np.zeros((max_lag + 1, m, m))
        parts[pdf["fold"], pdf["i"], pdf["j"]] = pdf["s"]
        upto = parts[::-1].cumsum(axis=0)[::-1]
        values = [1.0]
        for k in range(1, max_lag + 1):
            g = np.triu(upto[k]) + np.triu(upto[k], 1).T
            used = list(range(k + 1))
            values.append(float((np.linalg.pinv(g[np.ix_(used, used)], hermitian=True) @ g[used, -1])[-1]))
        rows = {k: [v] * len(values) for k, v in zip(group, key)}
        return pd.DataFrame({**rows, "lag": range(max_lag + 1), "pacf": values})

    types = dict(placed.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in group], "lag int, pacf double"])
    return _spread(sums, group).applyInPandas(solve, schema).select(*keys, "lag", "pacf")
