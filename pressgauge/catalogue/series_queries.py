"""Ordered series, calendars, correlations and market events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgauge.catalogue.indicator_queries import CATEGORIES, study, study_sector
from pressgauge.catalogue.registry import r6, register, rounded
from pressgauge.catalogue.sql import add, query
from pressgauge.catalogue.sql import r6 as sql6
from pressgauge.operators import indicators as ind
from pressgauge.operators import series as s

REGION = ["region_key"]
OVER_DAY = "OVER (ORDER BY day ROWS BETWEEN {0} PRECEDING AND {1})"


def full_sql(aggregate, value, rows, order):
    frame = f"OVER ({order} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({value}) {frame} = {rows} THEN {aggregate}({value}) {frame} END"


# Regional monthly attention beside the macro series.
MONTHLY_NAMES = ("colour", "goods", "scale")
add("geo_attention", ("geo_indicators",), "SELECT period, region_key, " + ", ".join(
    f"max(att) FILTER (sector = '{n}' AND granularity = '__sector__') AS {n}" for n in MONTHLY_NAMES
) + " FROM geo_indicators GROUP BY 1, 2")
add("monthly_attention", ("geo_attention",), """
    SELECT region_key, month AS period, colour, goods, scale FROM (
      SELECT region_key, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month
      FROM (SELECT region_key, min(date_trunc('month', period)) AS a, max(date_trunc('month', period)) AS b
            FROM geo_attention GROUP BY 1))
    LEFT JOIN (SELECT region_key, CAST(date_trunc('month', period) AS DATE) AS month, avg(colour) AS colour,
                      avg(goods) AS goods, avg(scale) AS scale FROM geo_attention GROUP BY 1, 2) USING (region_key, month)""")
BY_REGION = "PARTITION BY region_key ORDER BY period"


def zscore_sql(value, rows=12):
    return f"({value} - {full_sql('avg', value, rows, BY_REGION)}) / nullif({full_sql('stddev_samp', value, rows, BY_REGION)}, 0)"


add("zscores", ("monthly_attention",), "SELECT region_key, period, " + ", ".join(
    f"{zscore_sql(n)} AS {n}" for n in MONTHLY_NAMES) + " FROM monthly_attention")
add("macro_yoy", ("macro",), f"""
    SELECT region_key, period, (value / lag(value, 12) OVER ({BY_REGION}) - 1) * 100 AS macro_yoy FROM macro""")
add("panel", ("zscores", "macro_yoy"), """
    SELECT region_key, period, colour, goods, scale, macro_yoy FROM zscores JOIN macro_yoy USING (region_key, period)
    WHERE colour IS NOT NULL AND goods IS NOT NULL AND scale IS NOT NULL AND macro_yoy IS NOT NULL""")
add("tall_panel", ("panel",), " UNION ALL ".join(
    f"SELECT region_key, period, macro_yoy, '{n}' AS series, {n} AS x FROM panel" for n in MONTHLY_NAMES))


def monthly_attention(t):
    wide = ind.wide_geo_indicators(
        t.regional_indicators.filter(F.col("granularity") == ind.SECTOR_ROW), list(MONTHLY_NAMES), ("att",)
    )
    means = wide.groupBy("region_key", F.trunc("period", "MM").alias("period")).agg(
        *[F.avg(f"att_{n}").alias(n) for n in MONTHLY_NAMES]
    )
    return s.on_calendar(means, REGION, "period", "interval 1 month")


def panel(t):
    scores = monthly_attention(t).select(
        *REGION, "period", *[s.moving_zscore(F.col(n), REGION, "period").alias(n) for n in MONTHLY_NAMES]
    )
    change = t.macro.select(*REGION, "period", s.change_percent(F.col("value"), REGION, "period").alias("macro_yoy"))
    return s.align(scores, change, [*REGION, "period"])


def tall_panel(t):
    entries = [F.struct(F.lit(n).alias("series"), F.col(n).alias("x")) for n in MONTHLY_NAMES]
    return panel(t).select("region_key", "period", "macro_yoy", F.inline(F.array(*entries)))


# -- Windows -----------------------------------------------------------------


@register(
    "w04_moving_average",
    query(
        f"SELECT day, {sql6('avg(n_articles) ' + OVER_DAY.format(6, 'CURRENT ROW'))} AS ma7, "
        f"{sql6('avg(n_articles) ' + OVER_DAY.format(29, 'CURRENT ROW'))} AS ma30 FROM daily", "daily",
    ),
)
def moving_average(t):
    return t.daily.select(
        "day",
        r6(s.moving_average(F.col("n_articles"), [], "day", 7)).alias("ma7"),
        r6(s.moving_average(F.col("n_articles"), [], "day", 30)).alias("ma30"),
    )


@register(
    "w05_moving_zscore",
    query(f"SELECT region_key, period, {sql6(zscore_sql('value'))} AS z FROM macro", "macro"),
)
def moving_zscore(t):
    return t.macro.select(*REGION, "period", r6(s.moving_zscore(F.col("value"), REGION, "period")).alias("z"))


@register(
    "w06_shift",
    query(
        f"SELECT region_key, period, {sql6(f'lag(value, 3) OVER ({BY_REGION})')} AS earlier, "
        f"{sql6(f'lead(value, 2) OVER ({BY_REGION})')} AS later FROM macro", "macro",
    ),
)
def shift(t):
    return t.macro.select(
        *REGION, "period",
        r6(s.shifted(F.col("value"), REGION, "period", 3)).alias("earlier"),
        r6(s.shifted(F.col("value"), REGION, "period", -2)).alias("later"),
    )


@register("w07_yearly_change", query(f"SELECT region_key, period, {sql6('macro_yoy')} AS macro_yoy FROM macro_yoy", "macro_yoy"))
def yearly_change(t):
    return t.macro.select(*REGION, "period", r6(s.change_percent(F.col("value"), REGION, "period")).alias("macro_yoy"))


@register("w08_difference", query(f"SELECT day, {sql6('price - lag(price, 5) OVER (ORDER BY day)')} AS diff FROM market", "market"))
def difference(t):
    return t.market.select("day", r6(s.difference(F.col("price"), [], "day")).alias("diff"))


add("returns", ("market",), "SELECT day, price, price / lag(price) OVER (ORDER BY day) - 1 AS ret FROM market")
add("volatile", ("returns",), f"SELECT *, {full_sql('stddev_samp', 'ret', 22, 'ORDER BY day')} * sqrt(252.0) * 100 AS volatility FROM returns")


@register("w09_volatility", query(f"SELECT day, {sql6('ret')} AS ret, {sql6('volatility')} AS volatility FROM volatile", "volatile"))
def volatility(t):
    return rounded(s.with_volatility(t.market, "price", [], "day").select("day", "ret", "volatility"), "ret", "volatility")


@register(
    "w10_shock_zone",
    query(
        "SELECT day, coalesce(max(CASE WHEN n_articles > hi THEN 1 ELSE 0 END) "
        "OVER (ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) = 1, false) AS in_shock "
        "FROM daily, (SELECT quantile_cont(n_articles, 0.95) AS hi FROM daily)", "daily",
    ),
)
def shock_zone(t):
    flagged = s.with_extreme_flag(t.daily, "n_articles")
    return flagged.select("day", s.in_shock_zone(F.col("is_extreme"), [], "day").alias("in_shock"))


@register(
    "w11_base_index",
    query(
        f"""SELECT region_key, period, {sql6('smooth / ref * 100')} AS indexed FROM (
        SELECT *, avg(smooth) FILTER (r <= 12) OVER (PARTITION BY region_key) AS ref FROM (
          SELECT region_key, period, avg(value) OVER ({BY_REGION} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS smooth,
                 row_number() OVER ({BY_REGION}) AS r FROM macro)) WHERE ref > 0""", "macro",
    ),
)
def base_index(t):
    return rounded(s.base_index(t.macro, "value", REGION, "period", 12).select(*REGION, "period", "indexed"), "indexed")


CALENDAR = "SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM {0}"
add("filled", ("market",), f"""
    SELECT day, last_value(price IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price
    FROM ({CALENDAR.format('market')}) LEFT JOIN market USING (day)""")


@register("w12_forward_fill", query(f"SELECT day, {sql6('price')} AS price FROM filled", "filled"))
def forward_fill(t):
    dense = s.on_calendar(t.market, [], "day")
    return dense.select("day", r6(s.forward_fill(F.col("price"), [], "day")).alias("price"))


add("interpolated", ("macro",), """
    SELECT region_key, day AS period, coalesce(v0 + (v1 - v0) * coalesce(date_diff('day', t0, day)::DOUBLE / nullif(date_diff('day', t0, t1), 0), 0), v0) AS value
    FROM (SELECT region_key, day, last_value(value IGNORE NULLS) OVER b AS v0, last_value(known IGNORE NULLS) OVER b AS t0,
                 first_value(value IGNORE NULLS) OVER f AS v1, first_value(known IGNORE NULLS) OVER f AS t1
          FROM (SELECT c.region_key, c.day, value, CASE WHEN value IS NOT NULL THEN c.day END AS known
                FROM (SELECT region_key, CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS DATE) AS day FROM macro GROUP BY 1) c
                LEFT JOIN macro m ON m.region_key = c.region_key AND m.period = c.day)
          WINDOW b AS (PARTITION BY region_key ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 f AS (PARTITION BY region_key ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")


@register("w13_interpolation", query("SELECT region_key, period, round(value + 1e-9, 4) AS value FROM interpolated", "interpolated"))
def interpolation(t):
    daily = s.interpolated(t.macro, "value", REGION, "period")
    return daily.withColumn("value", F.round(F.col("value") + 1e-9, 4))


@register(
    "w14_monthly_means",
    query(
        f"""SELECT month AS day, {sql6('v')} AS price FROM (
        SELECT CAST(unnest(generate_series(date_trunc('month', min(day)), date_trunc('month', max(day)), INTERVAL 1 MONTH)) AS DATE) AS month FROM market)
        LEFT JOIN (SELECT CAST(date_trunc('month', day) AS DATE) AS month, avg(price) AS v FROM market GROUP BY 1) USING (month)""",
        "market",
    ),
)
def monthly_means(t):
    return rounded(s.monthly_means(t.market, "price", [], "day"), "price")


# -- Alignment ---------------------------------------------------------------


@register("jn15_macro_alignment", query("SELECT region_key, period, " + ", ".join(f"{sql6(n)} AS {n}" for n in (*MONTHLY_NAMES, "macro_yoy")) + " FROM panel", "panel"))
def macro_alignment(t):
    return rounded(panel(t), *MONTHLY_NAMES, "macro_yoy")


@register(
    "jn16_market_alignment",
    query(
        f"SELECT d.day, n_articles, {sql6('price')} AS price FROM daily d JOIN market m ON d.day = m.day", "daily", "market",
    ),
)
def market_alignment(t):
    return rounded(s.align(t.daily.select("day", "n_articles"), t.market, ["day"]), "price")


@register(
    "jn17_attached_macro",
    query(
        "SELECT d.day, d.n_articles, r.region_key, round(m.value + 1e-9, 4) AS value FROM daily d "
        "JOIN (SELECT DISTINCT region_key FROM interpolated) r ON true "
        "LEFT JOIN (SELECT period AS day, region_key, sum(value) AS value FROM interpolated GROUP BY 1, 2) m "
        "ON d.day = m.day AND r.region_key = m.region_key", "daily", "interpolated",
    ),
)
def attached_macro(t):
    # Every day of every region: the days are repeated by the regions of the macro table, inside the row.
    regions = F.array(*[F.lit(r["region_key"]) for r in t.macro.select("region_key").distinct().collect()])
    days = t.daily.select("day", "n_articles", F.explode(regions).alias("region_key"))
    macro = s.interpolated(t.macro, "value", REGION, "period").select(F.col("period").alias("day"), "region_key", "value")
    joined = s.attach(days, macro, ["day", "region_key"])
    return joined.withColumn("value", F.round(F.col("value") + 1e-9, 4))


# -- Correlations ------------------------------------------------------------

LAGS = range(-6, 7)
BY_SERIES = "PARTITION BY region_key, series ORDER BY period"


def lag_expression(value, lag, over):
    return f"{'lag' if lag >= 0 else 'lead'}({value}, {abs(lag)}) OVER ({over})"


add("lag_corr", ("tall_panel",), " UNION ALL ".join(
    f"""SELECT region_key, series, {lag} AS lag, corr(x, macro_yoy) AS corr
    FROM (SELECT region_key, series, macro_yoy, {lag_expression('x', lag, BY_SERIES)} AS x FROM tall_panel) GROUP BY 1, 2"""
    for lag in LAGS))


def lag_correlations_of(t):
    return s.lag_correlations(tall_panel(t), "x", "macro_yoy", ["region_key", "series"], "period", LAGS)


@register("ts01_lag_correlations", query(f"SELECT region_key, series, lag, {sql6('corr')} AS corr FROM lag_corr", "lag_corr"))
def lag_correlations(t):
    return rounded(lag_correlations_of(t), "corr")


LAG_NAMES = [f"T+{x}" if x > 0 else f"T{x}" if x else "T(0)" for x in LAGS]


@register(
    "ts01_lag_matrix",
    query("SELECT region_key, series, " + ", ".join(
        f'{sql6(f"max(corr) FILTER (lag = {x})")} AS "{n}"' for x, n in zip(LAGS, LAG_NAMES)) + " FROM lag_corr GROUP BY 1, 2", "lag_corr"),
)
def lag_matrix(t):
    matrix = s.lag_matrix(lag_correlations_of(t), ["region_key", "series"], LAGS)
    return matrix.select("region_key", "series", *[r6(F.col(f"`{n}`")).alias(n) for n in LAG_NAMES])


# Smoothed attention and sentiment against the price, as 5-row changes.
add("momentum", ("study_sector", "market"), """
    SELECT day, price - lag(price, 5) OVER (ORDER BY day) AS price, attention - lag(attention, 5) OVER (ORDER BY day) AS attention,
           sentiment - lag(sentiment, 5) OVER (ORDER BY day) AS sentiment
    FROM (SELECT m.day, price, attention, sentiment FROM market m JOIN (
            SELECT period AS day, avg(attention) OVER w AS attention, avg(sentiment) OVER w AS sentiment FROM study_sector
            WINDOW w AS (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) i ON m.day = i.day
          WHERE price IS NOT NULL AND attention IS NOT NULL AND sentiment IS NOT NULL)""")
add("moves", ("momentum",), "SELECT * FROM momentum WHERE price IS NOT NULL AND attention IS NOT NULL AND sentiment IS NOT NULL")
WIDE_LAGS = range(-30, 31)
add("cross_corr", ("moves",), " UNION ALL ".join(
    f"""SELECT series, {lag} AS lag, corr(x, price) AS corr FROM (
      SELECT 'attention' AS series, price, {lag_expression('attention', lag, 'ORDER BY day')} AS x FROM moves
      UNION ALL SELECT 'sentiment', price, {lag_expression('sentiment', lag, 'ORDER BY day')} FROM moves) GROUP BY 1"""
    for lag in WIDE_LAGS))


def smoothed(t, rows):
    return study_sector(t).select(
        F.col("period").alias("day"),
        *[s.moving_average(F.col(n), [], "period", rows).alias(n) for n in ("attention", "sentiment")],
    )


def moves(t):
    joined = s.align(t.market, smoothed(t, 7), ["day"])
    changes = [s.difference(F.col(n), [], "day").alias(n) for n in ("price", "attention", "sentiment")]
    tall = joined.select("day", *changes).na.drop()
    return tall.select(
        "day", "price",
        F.inline(F.array(*[F.struct(F.lit(n).alias("series"), F.col(n).alias("x")) for n in ("attention", "sentiment")])),
    )


@register("ts02_cross_correlation", query(f"SELECT series, lag, {sql6('corr')} AS corr FROM cross_corr", "cross_corr"))
def cross_correlation(t):
    return rounded(s.lag_correlations(moves(t), "x", "price", ["series"], "day", WIDE_LAGS), "corr")


@register(
    "ts02_best_lag",
    query(
        f"""SELECT series, lag, {sql6('corr')} AS corr FROM (SELECT *, row_number() OVER (PARTITION BY series
        ORDER BY abs(corr) DESC, lag) AS r FROM cross_corr WHERE corr IS NOT NULL) WHERE r = 1""", "cross_corr",
    ),
)
def best_lag(t):
    found = s.best_lag(s.lag_correlations(moves(t), "x", "price", ["series"], "day", WIDE_LAGS), ["series"])
    return rounded(found, "corr")


CATS = list(CATEGORIES)
CORR_PAIRS = [(a, b) for a in CATS for b in CATS]


@register(
    "ts03_correlation_matrix",
    query(" UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {sql6(f'corr(attention_s_{a}, attention_s_{b})')} AS corr FROM study" for a, b in CORR_PAIRS), "study"),
)
def correlation_matrix(t):
    wide = study(t).select(*[F.col(f"attention_s_{cat}").alias(cat) for cat in CATS])
    return rounded(s.correlation_matrix(wide, CATS), "corr")


@register(
    "ts04_best_predictor",
    query(
        f"""SELECT region_key, series, lag, {sql6('corr')} AS corr FROM (SELECT *, row_number() OVER (PARTITION BY region_key
        ORDER BY abs(corr) DESC, lag, series DESC) AS r FROM lag_corr WHERE lag BETWEEN 1 AND 6 AND corr IS NOT NULL) WHERE r = 1""",
        "lag_corr",
    ),
)
def best_predictor(t):
    leads = s.lag_correlations(tall_panel(t), "x", "macro_yoy", ["region_key", "series"], "period", range(1, 7))
    return rounded(s.best_predictor(leads, REGION, "series"), "corr")


add("filled_days", ("daily",), f"""
    SELECT day, last_value(n_articles IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS y
    FROM ({CALENDAR.format('daily')}) LEFT JOIN daily USING (day)""")


def filled_days(t):
    dense = s.on_calendar(t.daily.select("day", "n_articles"), [], "day")
    return dense.select("day", s.forward_fill(F.col("n_articles"), [], "day").cast("double").alias("y"))


@register(
    "ts05_autocorrelation",
    query(
        f"""SELECT k AS lag, {sql6('CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE sum(d1 * d0) / any_value(total) END')} AS acf,
        {sql6('1.96 / sqrt(any_value(n))')} AS band FROM (
          SELECT CAST(k AS INTEGER) AS k, a.d AS d1, b.d AS d0, total, a.n FROM range(0, 41) t(k), centred a
          JOIN centred b ON b.i = a.i - k, (SELECT sum(d * d) AS total FROM centred)) GROUP BY k""", "filled_days",
        centred="SELECT y - avg(y) OVER () AS d, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM filled_days",
    ),
)
def autocorrelation(t):
    return rounded(s.autocorrelation(filled_days(t), "y", [], "day"), "acf", "band")


@register(
    "ts07_shock_volatility",
    query(
        f"""SELECT CAST(sum(CASE WHEN ext THEN 1 ELSE 0 END) AS BIGINT) AS shocks, {sql6('avg(volatility) FILTER (NOT zone)')} AS vol_calm,
        {sql6('avg(volatility) FILTER (zone)')} AS vol_shock,
        {sql6('avg(volatility) FILTER (zone) - avg(volatility) FILTER (NOT zone)')} AS vol_gap
        FROM (SELECT *, coalesce(max(CASE WHEN ext THEN 1 ELSE 0 END) OVER (ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) = 1, false) AS zone
              FROM (SELECT day, {full_sql('stddev_samp', 'ret', 22, 'ORDER BY day')} * sqrt(252.0) * 100 AS volatility,
                           attention > (SELECT quantile_cont(attention, 0.95) FROM joined) AS ext
                    FROM (SELECT *, price / lag(price) OVER (ORDER BY day) - 1 AS ret FROM joined)))""",
        "study_sector", "market",
        joined="""SELECT m.day, price, round(attention + 1e-9, 9) AS attention FROM market m JOIN (SELECT period AS day,
                  avg(attention) OVER (ORDER BY period ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS attention FROM study_sector) i ON m.day = i.day""",
    ),
)
def shock_volatility(t):
    # Attention is rounded so that the quantile cuts the same rows in both engines.
    attention = smoothed(t, 30).select("day", F.round(F.col("attention") + 1e-9, 9).alias("attention"))
    joined = s.with_volatility(s.align(t.market, attention, ["day"]), "price", [], "day")
    flagged = s.with_extreme_flag(joined, "attention")
    zoned = flagged.withColumn("in_shock", s.in_shock_zone(F.col("is_extreme"), [], "day"))
    return rounded(s.shock_volatility(zoned), "vol_calm", "vol_shock", "vol_gap")
