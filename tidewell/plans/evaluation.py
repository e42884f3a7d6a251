"""Queries of the evaluation operators, with SQL twins.

Summaries that the driver's tables lack are made from parts, orders and line
items by expressions that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import panel as pn
from ..operators import selection as sl
from ..operators import signal as sg
from ..sources import events_panel, table
from .analytics import IC_SQL, MARKET_SQL, SIGNAL_SQL, TIME, _corr_sql, _out, _sigmoid_sql, long_signals, query, signals
from .language import PANEL_SQL, rounded_sql


def _rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{rounded_sql(n, digits)} AS {n}" for n in names)


def _rounded_as(named: dict[str, str]) -> str:
    return ", ".join(f"{rounded_sql(e)} AS {n}" for n, e in named.items())


def _daily(spark, sf_dir):
    return sg.daily_ic(long_signals(spark, sf_dir), "value", "label", ("factor", "datetime"))


@query(f"""WITH {IC_SQL}, o AS (SELECT factor, datetime, rank_ic AS v, row_number() OVER (PARTITION BY factor ORDER BY datetime) - 1 AS i, count(*) OVER (PARTITION BY factor) AS n FROM ic WHERE rank_ic IS NOT NULL),
e AS (SELECT *, greatest(1, CAST(floor(n * 0.6) AS BIGINT)) AS a FROM o), e2 AS (SELECT *, CASE WHEN n > 2 THEN greatest(a + 1, CAST(floor(n * 0.8) AS BIGINT)) ELSE n END AS b FROM e),
m AS (SELECT factor, coalesce(avg(CASE WHEN i < a THEN v END), 0) AS rank_ic_train, coalesce(avg(CASE WHEN i >= a AND i < b THEN v END), 0) AS rank_ic_valid, coalesce(avg(CASE WHEN i >= b OR (b >= n AND i = n - 1) THEN v END), 0) AS rank_ic_test, coalesce(avg(CASE WHEN i >= n - 10 THEN v END), 0) AS rank_ic_recent FROM e2 GROUP BY 1),
y AS (SELECT factor, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) AS positive_year_ratio, min(v) AS worst_year_rank_ic, stddev_pop(v) AS ic_std_by_year FROM (SELECT factor, year(datetime) AS y, avg(v) AS v FROM o GROUP BY 1, 2) GROUP BY 1)
SELECT factor, {_rounded('rank_ic_train', 'rank_ic_valid', 'rank_ic_test', 'rank_ic_recent', 'positive_year_ratio', 'worst_year_rank_ic', 'ic_std_by_year')}, {rounded_sql('rank_ic_test / (abs(rank_ic_train) + 1e-12)')} AS ic_decay FROM m JOIN y USING (factor)""")
def oos_rank_ic(spark, sf_dir):
    out = ev.out_of_sample(_daily(spark, sf_dir), recent=10)
    return _out(out, ["factor"], [c for c in out.columns if c != "factor"])


HORIZONS = (1, 2, 5)
HORIZON_SQL = f"""{PANEL_SQL}, s AS (SELECT datetime, instrument, close / nullif(lag(close) {TIME}, 0) - 1 AS mom, {', '.join(f'lead(close, {h}) {TIME} / nullif(close, 0) - 1 AS r{h}' for h in HORIZONS)} FROM p),
l AS (SELECT datetime, instrument, mom, unnest([{', '.join(map(str, HORIZONS))}]) AS horizon, unnest([{', '.join(f'r{h}' for h in HORIZONS)}]) AS r FROM s),
k AS (SELECT *, rank() OVER (PARTITION BY horizon, datetime ORDER BY mom) + (count(*) OVER (PARTITION BY horizon, datetime, mom) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY horizon, datetime ORDER BY r) + (count(*) OVER (PARTITION BY horizon, datetime, r) - 1) / 2.0 AS rb FROM l WHERE mom IS NOT NULL AND r IS NOT NULL),
h AS (SELECT CAST(horizon AS INTEGER) AS horizon, datetime, count(*) AS n, {_corr_sql('mom', 'r')} AS ic, {_corr_sql('ra', 'rb')} AS rank_ic FROM k GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _horizons(spark, sf_dir):
    from ..functions import columns as c

    p = events_panel(spark, sf_dir)
    returns = [(c.divide(c.delay("close", -h), "close") - 1).alias(f"return_t_plus_{h}") for h in HORIZONS]
    return ev.multi_horizon_ic(p.select(*pn.KEYS, c.ts_pctchange("close").alias("mom"), *returns), "mom", HORIZONS)


@query(f"WITH {HORIZON_SQL} SELECT horizon, datetime, n, {_rounded('ic', 'rank_ic')} FROM h")
def multi_horizon_ic(spark, sf_dir):
    return _out(_horizons(spark, sf_dir), ["horizon", "datetime", "n"], ["ic", "rank_ic"])


DECAY_SQL = """v AS (SELECT factor, horizon, abs(ic) AS v FROM prof WHERE ic IS NOT NULL),
t AS (SELECT *, max(v) OVER (PARTITION BY factor) AS top, lead(v) OVER (PARTITION BY factor ORDER BY horizon) AS nv, lead(horizon) OVER (PARTITION BY factor ORDER BY horizon) AS nh FROM v),
f AS (SELECT factor, min(CASE WHEN v = top THEN horizon END) AS optimal_horizon, arg_min(v, horizon) AS fv, max(top) AS top, arg_min(CASE WHEN v = nv THEN CAST(nh AS DOUBLE) ELSE horizon + (top / 2 - v) / (nv - v) * (nh - horizon) END, horizon) FILTER (WHERE v >= top / 2 AND top / 2 >= nv) AS fall FROM t GROUP BY 1),
hl AS (SELECT factor, optimal_horizon, CASE WHEN fv < top / 2 THEN 0.5 ELSE coalesce(fall, 30.0) END AS half_life_days FROM f)"""


@query(f"""WITH prof AS (SELECT p_brand AS factor, p_size AS horizon, avg(p_retailprice) - 1400 AS ic FROM part GROUP BY 1, 2), {DECAY_SQL}
SELECT factor, optimal_horizon, {_rounded('half_life_days')}, CASE WHEN half_life_days < 3 THEN 'fast' WHEN half_life_days <= 10 THEN 'medium' ELSE 'slow' END AS decay_speed FROM hl""")
def decay_profile(spark, sf_dir):
    profile = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("factor"), F.col("p_size").alias("horizon")).agg((F.avg("p_retailprice") - 1400).alias("ic"))
    return _out(ev.decay(profile), ["factor", "optimal_horizon", "decay_speed"], ["half_life_days"])


_YEAR_IR = "CASE WHEN stddev_samp({0}) > 1e-12 THEN avg({0}) / stddev_samp({0}) * sqrt(252.0) END"
REGIME_SQL = "rg AS (SELECT datetime AS date, CASE WHEN day(datetime) % 3 = 0 THEN 'bull' WHEN day(datetime) % 3 = 1 THEN 'bear' ELSE 'sideways' END AS regime FROM (SELECT DISTINCT datetime FROM p))"


@query(f"""WITH {IC_SQL}, {REGIME_SQL}, a AS (SELECT factor, regime, avg(ic) AS ic_mean, {_YEAR_IR.format('ic')} AS icir, count(*) AS n_days FROM ic JOIN rg ON rg.date = ic.datetime WHERE ic IS NOT NULL GROUP BY 1, 2)
SELECT factor, regime, n_days, {_rounded('ic_mean', 'icir')}, row_number() OVER (PARTITION BY factor ORDER BY ic_mean DESC, regime) = 1 AS is_best, row_number() OVER (PARTITION BY factor ORDER BY ic_mean, regime) = 1 AS is_worst FROM a""")
def regime_ic(spark, sf_dir):
    daily = _daily(spark, sf_dir).withColumnRenamed("datetime", "date")
    third = F.dayofmonth("date") % 3
    regimes = daily.select("date").distinct().withColumn("regime", F.when(third == 0, "bull").when(third == 1, "bear").otherwise("sideways"))
    return _out(ev.regime_ic(daily, regimes), ["factor", "regime", "n_days", "is_best", "is_worst"], ["ic_mean", "icir"])


@query(f"""WITH {IC_SQL}, b AS (SELECT factor, ic, row_number() OVER (PARTITION BY factor ORDER BY datetime DESC) AS b FROM ic WHERE ic IS NOT NULL),
a AS (SELECT factor, count(*) FILTER (WHERE b <= 16) AS n, avg(CASE WHEN b <= 8 THEN ic END) AS recent, avg(CASE WHEN b > 8 AND b <= 16 THEN ic END) AS "before" FROM b GROUP BY 1)
SELECT factor, {rounded_sql('"before"')} AS "before", {rounded_sql('recent')} AS recent, n >= 16 AND coalesce(("before" - recent) / nullif(abs("before"), 0) >= 0.2, false) AS declined FROM a""")
def ic_decline(spark, sf_dir):
    return _out(ev.significant_decline(_daily(spark, sf_dir).withColumnRenamed("datetime", "date"), 8), ["factor", "declined"], ["before", "recent"])


@query(f"""WITH {PANEL_SQL}, r AS (SELECT instrument AS factor, close AS v, row_number() OVER (PARTITION BY instrument ORDER BY datetime DESC) = 1 AS last FROM p WHERE close IS NOT NULL),
a AS (SELECT factor, max(CASE WHEN last THEN v END) AS v, avg(CASE WHEN NOT last THEN v END) AS m, stddev_pop(CASE WHEN NOT last THEN v END) AS s FROM r GROUP BY 1)
SELECT factor, {rounded_sql('CASE WHEN s > 0 THEN abs(v - m) / s END')} AS z, coalesce(CASE WHEN s > 0 THEN abs(v - m) / s END > 2, false) AS jumped FROM a""")
def single_day_jump(spark, sf_dir):
    p = events_panel(spark, sf_dir).select(F.col("instrument").alias("factor"), F.col("datetime").alias("date"), F.col("close").alias("value"))
    return _out(ev.last_value_jump(p, 2.0), ["factor", "jumped"], ["z"])


GATE_LIMITS = {"min_cross_section_count": 10, "missing_rate": 0.05, "extreme_value_ratio": 0.02}
_GATE = {"missing_rate": ("missing_rate <= 0.05", "reject"), "coverage_rate": ("coverage_rate >= 0.6", "watchlist"), "min_cross_section_count": ("min_cross_section_count >= 0.9", "reject"), "extreme_value_ratio": ("extreme_value_ratio <= 0.02", "re_winsorize"), "single_day_jump": ("single_day_jump = 0", "watchlist"), "future_function": ("future_function <= 0.5", "blacklist"), "suspension_ratio": ("suspension_ratio <= 0.3", "watchlist")}
_PLACE = {r: i for i, r in enumerate(ev.RESULT_ORDER)}
_WORST = "least(" + ", ".join(f"CASE WHEN {ok} THEN 4 ELSE {_PLACE[r]} END" for ok, r in _GATE.values()) + ")"
_WHY = "coalesce(" + ", ".join(f"CASE WHEN NOT ({ok}) AND worst = {_PLACE[r]} THEN '{c} failed' END" for c, (ok, r) in _GATE.items()) + ", 'all checks passed')"


@query(f"""WITH {IC_SQL}, w AS (SELECT l.*, p.volume <= 1 AS susp FROM l JOIN p USING (datetime, instrument)), md AS (SELECT factor, median(value) AS med FROM w GROUP BY 1), ad AS (SELECT factor, any_value(med) AS med, median(abs(value - med)) AS mad FROM w JOIN md USING (factor) GROUP BY 1),
a AS (SELECT factor, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate, avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage_rate, coalesce(avg(CASE WHEN value IS NOT NULL THEN CASE WHEN abs(value - med) > 5 * mad THEN 1.0 ELSE 0.0 END END), 0) AS extreme_value_ratio, avg(CASE WHEN susp THEN 1.0 ELSE 0.0 END) AS suspension_ratio FROM w JOIN ad USING (factor) GROUP BY 1),
dy AS (SELECT factor, datetime, count(*) AS n, avg(value) AS v FROM w WHERE value IS NOT NULL GROUP BY 1, 2), dc AS (SELECT factor, avg(CASE WHEN n >= 10 THEN 1.0 ELSE 0.0 END) AS min_cross_section_count FROM dy GROUP BY 1),
jr AS (SELECT factor, v, row_number() OVER (PARTITION BY factor ORDER BY datetime DESC) = 1 AS last FROM dy), ja AS (SELECT factor, max(CASE WHEN last THEN v END) AS v, avg(CASE WHEN NOT last THEN v END) AS m, stddev_pop(CASE WHEN NOT last THEN v END) AS s FROM jr GROUP BY 1),
jj AS (SELECT factor, CASE WHEN coalesce(CASE WHEN s > 0 THEN abs(v - m) / s END > 5, false) THEN 1.0 ELSE 0.0 END AS single_day_jump FROM ja), ff AS (SELECT factor, max(abs(rank_ic)) AS future_function FROM ic GROUP BY 1),
g AS (SELECT *, {_WORST} AS worst FROM a JOIN dc USING (factor) JOIN jj USING (factor) LEFT JOIN ff USING (factor))
SELECT factor, {_rounded('missing_rate', 'coverage_rate', 'extreme_value_ratio', 'suspension_ratio', 'min_cross_section_count', 'single_day_jump', 'future_function')}, {[*ev.RESULT_ORDER]}[worst + 1] AS gate_result, {_WHY} AS reason FROM g""")
def data_quality_gate(spark, sf_dir):
    volume = events_panel(spark, sf_dir).select(*pn.KEYS, (F.col("volume") <= 1).alias("is_suspended"))
    long = long_signals(spark, sf_dir).join(volume, pn.KEYS).withColumnRenamed("label", "return_t_plus_1")
    checks = ["missing_rate", "coverage_rate", "extreme_value_ratio", "suspension_ratio", "min_cross_section_count", "single_day_jump", "future_function"]
    return _out(ev.data_quality_gate(long, GATE_LIMITS), ["factor", "gate_result", "reason"], checks)


POOL_SQL = f"""{SIGNAL_SQL}, cand AS (SELECT datetime, instrument, unnest(['body', 'mom']) AS factor, unnest([body, mom]) AS x FROM s), pool AS (SELECT datetime, instrument, unnest(['p_close', 'p_range', 'p_vol']) AS pool_factor, unnest([close, high - low, volume]) AS y FROM p),
pk AS (SELECT factor, pool_factor, datetime, rank() OVER w1 + (count(*) OVER (PARTITION BY factor, pool_factor, datetime, x) - 1) / 2.0 AS a, rank() OVER w2 + (count(*) OVER (PARTITION BY factor, pool_factor, datetime, y) - 1) / 2.0 AS b FROM cand JOIN pool USING (datetime, instrument) WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w1 AS (PARTITION BY factor, pool_factor, datetime ORDER BY x), w2 AS (PARTITION BY factor, pool_factor, datetime ORDER BY y)),
pc AS (SELECT * FROM (SELECT factor, pool_factor, datetime, {_corr_sql('a', 'b')} AS correlation FROM pk GROUP BY 1, 2, 3 HAVING count(*) >= 2) WHERE correlation IS NOT NULL)"""


def _pool(spark, sf_dir):
    p = events_panel(spark, sf_dir)
    return p.select(*pn.KEYS, F.col("close").alias("p_close"), (F.col("high") - F.col("low")).alias("p_range"), F.col("volume").alias("p_vol")).unpivot(pn.KEYS, ["p_close", "p_range", "p_vol"], "factor", "value")


def _candidates(spark, sf_dir):
    return signals(spark, sf_dir).select(*pn.KEYS, "body", "mom").unpivot(pn.KEYS, ["body", "mom"], "factor", "value")


@query(f"WITH {POOL_SQL} SELECT factor, pool_factor, datetime, {_rounded('correlation')} FROM pc")
def pool_correlations(spark, sf_dir):
    return _out(ev.pool_correlations(_candidates(spark, sf_dir), _pool(spark, sf_dir)), ["factor", "pool_factor", "datetime"], ["correlation"])


@query(f"""WITH {POOL_SQL}, m AS (SELECT factor, max({{'c': abs(correlation), 'f': pool_factor}}) AS m FROM pc GROUP BY 1)
SELECT factor, {rounded_sql('m.c')} AS max_abs_corr, m.f AS nearest_factor_id, {rounded_sql("CASE factor WHEN 'body' THEN 0.9 ELSE 0.1 END")} AS expression_similarity, CASE WHEN factor = 'body' OR m.c >= 0.999999999 THEN 'blacklist' ELSE 'pass' END AS gate_result FROM m""")
def redundancy_gate(spark, sf_dir):
    c = ev.pool_correlations(_candidates(spark, sf_dir), _pool(spark, sf_dir))
    similarity = spark.sql("SELECT * FROM VALUES ('body', 0.9D), ('mom', 0.1D) AS t(factor, expression_similarity)")
    return _out(ev.redundancy_gate(c, similarity, most_correlated=0.999999999), ["factor", "nearest_factor_id", "gate_result"], ["max_abs_corr", "expression_similarity"])


@query(f"""WITH {POOL_SQL}, m AS (SELECT factor, pool_factor, avg(abs(correlation)) AS c, avg(correlation) AS d FROM pc GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY c DESC, d DESC, pool_factor) AS r FROM m)
SELECT factor, pool_factor AS nearest_factor_id, {rounded_sql('c')} AS mean_abs_corr, CASE WHEN c >= 0.3 THEN CASE pool_factor WHEN 'p_close' THEN 'prices' ELSE 'cluster_' || pool_factor END ELSE 'cluster_' || factor END AS cluster_id, CASE WHEN c >= 0.3 THEN 'join_existing_cluster' ELSE 'new_cluster' END AS action FROM b WHERE r = 1""")
def redundancy_clusters(spark, sf_dir):
    c = ev.pool_correlations(_candidates(spark, sf_dir), _pool(spark, sf_dir))
    clusters = spark.sql("SELECT 'p_close' AS pool_factor, 'prices' AS cluster_id")
    return _out(ev.redundancy_clusters(c, clusters, 0.3), ["factor", "nearest_factor_id", "cluster_id", "action"], ["mean_abs_corr"])


@query(f"""WITH {POOL_SQL}, m AS (SELECT factor, pool_factor, quantile_cont(abs(correlation), 0.5) AS a, quantile_cont(abs(correlation), 0.9) AS b FROM pc GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY a DESC, pool_factor) AS r FROM m)
SELECT factor, pool_factor, {rounded_sql('a')} AS similarity_median, {rounded_sql('b')} AS similarity_p90 FROM r WHERE r = 1""")
def behaviour_similarity(spark, sf_dir):
    c = ev.pool_correlations(_candidates(spark, sf_dir), _pool(spark, sf_dir))
    return _out(ev.behaviour_similarity(c), ["factor", "pool_factor"], ["similarity_median", "similarity_p90"])


@query(f"""WITH {POOL_SQL}, vc AS (SELECT factor, pool_factor, datetime, {_corr_sql('x', 'y')} AS c FROM cand JOIN pool USING (datetime, instrument) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2),
bad AS (SELECT DISTINCT factor FROM (SELECT factor, pool_factor, avg(abs(c)) AS c FROM vc WHERE c IS NOT NULL GROUP BY 1, 2) WHERE c >= 0.6)
SELECT factor, datetime, instrument, {rounded_sql('x')} AS value FROM cand WHERE factor NOT IN (SELECT factor FROM bad)""")
def dedup_vs_pool(spark, sf_dir):
    return _out(ev.without_duplicates(_candidates(spark, sf_dir), _pool(spark, sf_dir), 0.6), ["factor", *pn.KEYS], ["value"])


@query(f"""WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS factor, o_totalprice / 1e6 AS ret, (o_orderkey % 7) / 7.0 AS turnover FROM orders) SELECT factor, {rounded_sql(_YEAR_IR.format('(ret - 0.003 * turnover)'))} AS sharpe FROM o GROUP BY 1""")
def after_cost_sharpe(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("CAST(o_custkey AS STRING) AS factor", "o_totalprice / 1e6D AS ret", "(o_orderkey % 7) / 7.0D AS turnover")
    return _out(ev.after_cost_sharpe(o), ["factor"], ["sharpe"])


_HEALTH = {"ic": "p_size / 500.0e0 - 0.04e0", "icir": "p_retailprice / 1000.0e0 - 1", "oos_ic": "(p_partkey % 50) / 1000.0e0", "max_abs_corr": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey % 100) / 100.0e0 END", "sharpe_after_cost": "p_size / 25.0e0", "trend_slope": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size / 100.0e0 - 0.25e0 END", "half_life": "p_size / 2.0e0"}
_HEALTH_DIMS = dict(zip(ev.HEALTH_SIGMOIDS, ("abs(ic)", "icir", "abs(oos_ic)", "abs(max_abs_corr)", "sharpe_after_cost", "trend_slope", "half_life"), strict=True))
_HEALTH_SQL = f"h AS (SELECT p_partkey AS factor, {', '.join(f'{e} AS {n}' for n, e in _HEALTH.items())} FROM part), hs AS (SELECT *, ({' + '.join(f'coalesce({_sigmoid_sql(x, *ev.HEALTH_SIGMOIDS[d])}, 0) * {sg.HEALTH_WEIGHTS[d]}' for d, x in _HEALTH_DIMS.items())}) / 100.0 AS health_score, ({' + '.join(f'CASE WHEN {x} IS NULL THEN 0 ELSE {sg.HEALTH_WEIGHTS[d]} END' for d, x in _HEALTH_DIMS.items())}) / 100.0 AS health_confidence FROM h)"


def _health(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS factor", *(f"{e} AS {n}" for n, e in _HEALTH.items()))
    return sg.health(p, ev.health_dimensions({n: F.col(n) for n in _HEALTH}))


@query(f"WITH {_HEALTH_SQL} SELECT factor, {_rounded('health_score', 'health_confidence')} FROM hs")
def health_dimensions(spark, sf_dir):
    return _out(_health(spark, sf_dir), ["factor"], ["health_score", "health_confidence"])


_SURE = "health_confidence >= 0.9"
_TIER = f"""CASE WHEN health_score < 40 OR pit_failed OR after_cost_effective IS FALSE THEN 'D' WHEN health_score >= 80 AND {_SURE} THEN CASE WHEN oos_ic > 0.02 AND icir > 0.3 AND coalesce(max_abs_corr < 0.85, true) THEN 'A' ELSE 'B' END
WHEN health_score >= 60 AND {_SURE} AND marginal THEN 'B' ELSE 'C' END"""


@query(f"""WITH {_HEALTH_SQL}, t AS (SELECT *, factor % 11 = 0 AS pit_failed, CASE WHEN factor % 13 = 0 THEN false WHEN factor % 13 = 1 THEN NULL ELSE true END AS after_cost_effective, factor % 2 = 0 AS marginal FROM hs), u AS (SELECT *, {_TIER} AS tier FROM t)
SELECT factor, tier, CASE WHEN tier = 'D' THEN 'retired' WHEN tier = 'A' THEN 'core' WHEN tier = 'B' THEN 'satellite' WHEN health_score >= 60 AND {_SURE} THEN 'candidate' ELSE 'watchlist' END AS ops_status, {rounded_sql("CASE tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.5 ELSE 0.0 END")} AS weight_cap,
CASE WHEN tier = 'D' THEN array_to_string(list_filter([CASE WHEN health_score < 40 THEN 'health score below retired threshold' END, CASE WHEN pit_failed THEN 'pit failed' END, CASE WHEN after_cost_effective IS FALSE THEN 'after-cost ineffective' END], lambda r: r IS NOT NULL), '; ')
WHEN tier = 'A' THEN 'core rules passed' WHEN tier = 'B' AND health_score >= 80 THEN array_to_string(list_filter([CASE WHEN NOT (oos_ic > 0.02 AND icir > 0.3) THEN 'oos failed' END, CASE WHEN max_abs_corr >= 0.85 THEN 'correlation too high' END], lambda r: r IS NOT NULL), '; ')
WHEN tier = 'B' THEN 'satellite rules passed' WHEN health_score >= 60 AND {_SURE} THEN 'missing marginal contribution evidence' ELSE array_to_string(list_filter(['candidate score band', CASE WHEN NOT ({_SURE}) THEN 'confidence below threshold' END], lambda r: r IS NOT NULL), '; ') END AS reasons FROM u""")
def tier_classes(spark, sf_dir):
    flags = {"pit_failed": "factor % 11 = 0", "after_cost_effective": "CASE WHEN factor % 13 = 0 THEN false WHEN factor % 13 = 1 THEN NULL ELSE true END", "marginal_contribution": "factor % 2 = 0", "severe_data_issue": "false", "regime_effective": "false", "recent_decay": "CAST(NULL AS BOOLEAN)", "oos_icir": "icir"}
    out = ev.tiers(_health(spark, sf_dir).selectExpr("*", *(f"{e} AS {n}" for n, e in flags.items())), min_confidence=0.9)
    return _out(out, ["factor", "tier", "ops_status", "reasons"], ["weight_cap"])


_SOURCE = "CASE p_partkey % 4 WHEN 0 THEN 'Mined' WHEN 1 THEN 'manual' WHEN 2 THEN 'formula' ELSE 'dl-feature' END"


@query(f"""WITH r AS (SELECT p_brand, {_SOURCE} AS src, p_retailprice / 20 AS s, CASE WHEN p_size > 45 THEN NULL ELSE p_size / 50.0e0 END AS c FROM part)
SELECT p_brand, {rounded_sql("coalesce(sum(CASE WHEN src <> 'dl-feature' AND c > 0 THEN s * c END) / nullif(sum(CASE WHEN src <> 'dl-feature' AND c > 0 THEN c END), 0), 0)")} AS foundation_health_index, count(CASE WHEN src <> 'dl-feature' THEN 1 END) AS foundation_factor_count, count(CASE WHEN src = 'dl-feature' THEN 1 END) AS excluded_factor_count FROM r GROUP BY 1""")
def foundation_index(spark, sf_dir):
    r = table(spark, sf_dir, "part").selectExpr("p_brand", f"{_SOURCE} AS data_source_type", "p_retailprice / 20 AS health_score", "CASE WHEN p_size > 45 THEN NULL ELSE p_size / 50.0e0 END AS health_confidence")
    return _out(ev.foundation_index(r, ["p_brand"]), ["p_brand", "foundation_factor_count", "excluded_factor_count"], ["foundation_health_index"])


@query(f"""WITH {MARKET_SQL}, h AS (SELECT year(date) AS series, date, 50 + 20 * market_return AS v FROM mk), l AS (SELECT *, lag(v) OVER w - v AS d1, lag(v, 5) OVER w - v AS d5 FROM h WINDOW w AS (PARTITION BY series ORDER BY date))
SELECT CAST(series AS INTEGER) AS series, date, CASE WHEN d1 >= 10 THEN 'absolute_drop' WHEN d5 >= 15 THEN 'five_day_cumulative_drop' ELSE '' END AS reason, {rounded_sql('CASE WHEN d1 >= 10 THEN d1 WHEN d5 >= 15 THEN d5 ELSE 0 END')} AS "drop" FROM l""")
def index_drops(spark, sf_dir):
    h = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((50 + 20 * (F.avg("o_totalprice") / 1e5 - 1)).alias("index"))
    return _out(ev.index_drops(h.withColumn("series", F.year("date"))), ["series", "date", "reason"], ["drop"])


_RUN_KIND = "CASE WHEN p_partkey = 1 THEN 'baseline' WHEN p_partkey = 2 THEN 'full' WHEN p_partkey % 2 = 1 THEN 'candidate_added' ELSE 'drop_one' END"


@query(f"""WITH r AS (SELECT {_RUN_KIND} AS kind, CASE WHEN p_partkey > 2 THEN p_partkey // 2 END AS factor, p_retailprice / 1e5 AS ic, p_size / 100.0e0 AS icir FROM part), a AS (SELECT * FROM r WHERE kind = 'candidate_added'), d AS (SELECT * FROM r WHERE kind = 'drop_one'), b AS (SELECT * FROM r WHERE kind = 'baseline'), f AS (SELECT * FROM r WHERE kind = 'full')
SELECT coalesce(a.factor, d.factor) AS factor, {rounded_sql('a.ic - b.ic')} AS added_ic, {rounded_sql('a.icir - b.icir')} AS added_icir, {rounded_sql('f.ic - d.ic')} AS drop_one_ic, {rounded_sql('f.icir - d.icir')} AS drop_one_icir FROM a FULL OUTER JOIN d ON a.factor = d.factor CROSS JOIN b CROSS JOIN f""")
def model_contribution(spark, sf_dir):
    r = table(spark, sf_dir, "part").selectExpr(f"{_RUN_KIND} AS kind", "CASE WHEN p_partkey > 2 THEN p_partkey div 2 END AS factor", "p_retailprice / 1e5 AS ic", "p_size / 100.0e0 AS icir")
    return _out(ev.model_contribution(r, ["ic", "icir"]), ["factor"], ["added_ic", "added_icir", "drop_one_ic", "drop_one_icir"])


@query(f"""WITH r AS (SELECT p_partkey AS factor, {_SOURCE} AS src, p_size / 50.0e0 AS r, (p_partkey % 10) / 1000.0e0 AS c FROM part), x AS (SELECT factor, CASE WHEN src = 'dl-feature' AND r > 0.5 AND c < 0.003 THEN 'ts-gru contribution failed' WHEN src <> 'dl-feature' AND r > 0.8 AND c < 0.002 THEN 'low shap rank and drop-one IC below threshold' END AS reason FROM r)
SELECT factor, 'watchlist' AS new_status, reason FROM x WHERE reason IS NOT NULL""")
def downgrade_rules(spark, sf_dir):
    return ev.downgrades(table(spark, sf_dir, "part").selectExpr("p_partkey AS factor", f"{_SOURCE} AS data_source_type", "p_size / 50.0e0 AS shap_rank_pct", "(p_partkey % 10) / 1000.0e0 AS drop_one_ic_change"))


_PERIOD = {"factor": "o_custkey", "status": "CASE WHEN o_orderkey % 9 = 0 THEN 'failure' ELSE 'success' END", "ic": "o_totalprice / 5e6 - 0.03e0", "rank_ic": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 4e6 - 0.05e0 END", "annualized_return": "o_totalprice / 1e6 - 0.2e0", "information_ratio": "o_totalprice / 2e5", "max_drawdown": "-(o_orderkey % 17) / 50.0e0"}
_PERIOD_SQL = f"pr AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _PERIOD.items())} FROM orders)"
_OK = "CASE WHEN status = 'success' THEN {} END"


def _periods(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {n}" for n, e in _PERIOD.items()))


@query(f"""WITH {_PERIOD_SQL}, a AS (SELECT factor, count(*) AS period_count, count(CASE WHEN status = 'success' THEN 1 END) AS success_count, {', '.join(f'avg({_OK.format(m)}) AS {m}_mean, stddev_pop({_OK.format(m)}) AS {m}_std' for m in ('ic', 'rank_ic', 'information_ratio'))}, min({_OK.format('max_drawdown')}) AS max_drawdown_worst,
avg({_OK.format('(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END + CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0 END + CASE WHEN annualized_return > 0 THEN 1.0 ELSE 0 END) / (2 + CASE WHEN rank_ic IS NULL THEN 0 ELSE 1 END)')}) AS win_rate_mean FROM pr GROUP BY 1)
SELECT factor, period_count, success_count, {_rounded('ic_mean', 'ic_std', 'rank_ic_mean', 'rank_ic_std', 'max_drawdown_worst', 'win_rate_mean')},
{rounded_sql('round(CASE WHEN success_count = 0 THEN 0 ELSE greatest(least(0.35 * greatest(coalesce(ic_mean, 0), 0) + 0.35 * greatest(coalesce(rank_ic_mean, 0), 0) + 0.3 * least(greatest(coalesce(information_ratio_mean, 0), 0), 1.5) / 1.5 - least(1.5 * coalesce(ic_std, 0) + 1.5 * coalesce(rank_ic_std, 0), 0.6) - least((period_count - success_count) * 0.2, 0.8) + 0.5, 1.0), 0.0) END, 4)')} AS stability_score FROM a""")
def multi_period_summary(spark, sf_dir):
    out = ev.period_summary(_periods(spark, sf_dir), ["ic", "rank_ic"])
    return _out(out, ["factor", "period_count", "success_count"], ["ic_mean", "ic_std", "rank_ic_mean", "rank_ic_std", "max_drawdown_worst", "win_rate_mean", "stability_score"])


@query(f"""WITH {_PERIOD_SQL}, a AS (SELECT factor, count(CASE WHEN status = 'success' AND ic > 0 AND rank_ic > 0.01 THEN 1 END) AS passing, count(*) AS n FROM pr GROUP BY 1) SELECT factor, passing, n - passing AS failing, passing >= 3 AS overall_pass FROM a""")
def multi_period_judge(spark, sf_dir):
    return ev.judged_periods(_periods(spark, sf_dir), 0.0, 0.01, 3, all_must_pass=False)


_QUALITY = {"factor": "p_partkey", "rank_ic_test": "p_size / 800.0e0 - 0.005e0", "rank_icir": "p_retailprice / 2000.0e0", "monotonicity": "(p_partkey % 11) / 10.0e0", "similarity": "(p_partkey % 9) / 10.0e0", "stability": "(p_partkey % 5) / 4.0e0", "turnover": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE (p_partkey % 13) / 10.0e0 END", "symbol_length": "CAST(p_size AS DOUBLE) * 2", "lookahead_risk": "CASE WHEN p_partkey % 19 = 0 THEN 'critical' ELSE 'none' END"}
_CLIP = "greatest(0, least(1, ({} - {}) / ({} - {})))"
_QUALITY_SCORE = " + ".join(f"{w} * {_CLIP.format('(1 - similarity)' if n == 'novelty' else f'coalesce({n}, 0)', low, high, low)}" for n, (w, low, high) in ev.QUALITY_PARTS.items())


@query(f"""WITH q AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _QUALITY.items())} FROM part), s AS (SELECT *, greatest(0, least(1, ({_QUALITY_SCORE} - CASE WHEN lookahead_risk = 'critical' THEN 1 ELSE 0 END) / 3.6)) AS quality_score FROM q)
SELECT factor, {_rounded('quality_score')}, CASE WHEN lookahead_risk = 'critical' THEN 'quarantine' WHEN quality_score >= 0.7 AND rank_ic_test > 0.02 THEN 'active' WHEN quality_score >= 0.45 AND rank_ic_test > 0 THEN 'candidate' ELSE 'rejected' END AS lifecycle FROM s""")
def quality_scores(spark, sf_dir):
    q = table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in _QUALITY.items()))
    return _out(ev.quality_score(q), ["factor", "lifecycle"], ["quality_score"])


@query(f"""WITH q AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _QUALITY.items())}, CASE WHEN p_partkey % 3 = 0 THEN ['constant_signal', 'high_similarity'] WHEN p_partkey % 3 = 1 THEN ['slow'] END AS reasons FROM part),
p1 AS (SELECT *, CASE WHEN lookahead_risk = 'critical' THEN 'lookahead_risk' WHEN rank_ic_test <= 0 THEN 'weak_oos_ic' WHEN list_contains(reasons, 'too_many_nan') THEN 'too_many_nan' WHEN list_contains(reasons, 'constant_signal') THEN 'constant_signal' WHEN list_contains(reasons, 'high_similarity') THEN 'high_similarity' ELSE 'weak_ic' END AS primary_reason FROM q)
SELECT factor, primary_reason, CASE WHEN primary_reason = 'lookahead_risk' THEN 'quarantine' ELSE 'rejected' END AS decision, array_to_string(list_concat(CASE WHEN turnover > 0.8 THEN ['high_turnover'] ELSE [] END, list_filter(coalesce(reasons, []), lambda r: r <> primary_reason)), ',') AS secondary_reasons FROM p1""")
def failure_attribution(spark, sf_dir):
    reasons = "CASE WHEN p_partkey % 3 = 0 THEN array('constant_signal', 'high_similarity') WHEN p_partkey % 3 = 1 THEN array('slow') END AS reasons"
    q = table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in _QUALITY.items()), reasons)
    return ev.failure_attribution(q).select("factor", "primary_reason", "decision", "secondary_reasons")


@query("""WITH t AS (SELECT p_partkey AS factor, CASE WHEN p_partkey % 3 = 0 THEN 'weak_ic' ELSE 'too_many_nan' END AS a, p_size AS qa, CASE WHEN p_partkey % 4 = 0 THEN 'weak_ic' ELSE '' END AS b, p_retailprice / 40 AS qb, CASE WHEN p_partkey % 5 = 0 THEN 'active' ELSE 'rejected' END AS l FROM part)
SELECT factor, a <> b AS failure_resolved, qb > qa AS quality_improved, a <> b AND (qb > qa OR l = 'active') AS repair_success FROM t""")
def repair_check(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    before = p.selectExpr("p_partkey AS factor", "CASE WHEN p_partkey % 3 = 0 THEN 'weak_ic' ELSE 'too_many_nan' END AS primary_reason", "p_size AS quality_score", "'rejected' AS lifecycle")
    after = p.selectExpr("p_partkey AS factor", "CASE WHEN p_partkey % 4 = 0 THEN 'weak_ic' ELSE '' END AS primary_reason", "p_retailprice / 40 AS quality_score", "CASE WHEN p_partkey % 5 = 0 THEN 'active' ELSE 'rejected' END AS lifecycle")
    return ev.repaired(before, after)


@query(f"""SELECT p_brand AS family, count(*) AS n, count(CASE WHEN p_size < 10 THEN 1 END) AS active, count(CASE WHEN p_size >= 10 AND p_size < 30 THEN 1 END) AS candidate, count(CASE WHEN p_size >= 30 THEN 1 END) AS rejected, {rounded_sql('avg(CASE WHEN p_size < 30 THEN 1.0 ELSE 0.0 END)')} AS hit_rate FROM part GROUP BY 1""")
def family_inventory(spark, sf_dir):
    pool = table(spark, sf_dir, "part").selectExpr("p_brand AS family", "CASE WHEN p_size < 10 THEN 'active' WHEN p_size < 30 THEN 'candidate' ELSE 'rejected' END AS status")
    return _out(ev.family_inventory(pool, ["active", "candidate", "rejected"]), ["family", "n", "active", "candidate", "rejected"], ["hit_rate"])


@query(f"""WITH {PANEL_SQL}, c AS (SELECT corr(open, close) AS r1, corr(open, vwap) AS r2, corr(close, vwap) AS r3, corr(open, volume) AS r4, corr(close, volume) AS r5, corr(vwap, volume) AS r6 FROM p),
k AS (SELECT *, r1 <= 0.5 AS k_close FROM c), k2 AS (SELECT *, r2 <= 0.5 AND (NOT k_close OR r3 <= 0.5) AS k_vwap FROM k), k3 AS (SELECT *, r4 <= 0.5 AND (NOT k_close OR r5 <= 0.5) AND (NOT k_vwap OR r6 <= 0.5) AS k_volume FROM k2)
SELECT unnest(list_concat(['open'], list_concat(CASE WHEN k_close THEN ['close'] ELSE [] END, list_concat(CASE WHEN k_vwap THEN ['vwap'] ELSE [] END, CASE WHEN k_volume THEN ['volume'] ELSE [] END)))) AS factor FROM k3""")
def pruned_factors(spark, sf_dir):
    kept = ev.pruned(events_panel(spark, sf_dir), ["open", "close", "vwap", "volume"], 0.5)
    return spark.range(1).select(F.explode(F.array(*map(F.lit, kept))).alias("factor"))


@query(f"""WITH {IC_SQL}, a AS (SELECT factor, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS nan_ratio, avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) AS valid_ratio, count(DISTINCT value) AS n_unique FROM l GROUP BY 1)
SELECT factor, {_rounded('nan_ratio', 'valid_ratio')}, n_unique, nan_ratio <= 0.6 AND valid_ratio >= 0.4 AND n_unique >= 50 AS valid FROM a""")
def factor_validation(spark, sf_dir):
    return _out(ev.validated(long_signals(spark, sf_dir), least_distinct=50), ["factor", "n_unique", "valid"], ["nan_ratio", "valid_ratio"])


@query(f"""WITH {SIGNAL_SQL}, a AS (SELECT datetime, instrument, body AS x FROM s WHERE day(datetime) % 7 <> 0), b AS (SELECT datetime, instrument, CASE WHEN day(datetime) % 2 = 0 THEN body ELSE mom END AS y FROM s WHERE day(datetime) % 5 <> 0),
j AS (SELECT coalesce(a.datetime, b.datetime) AS datetime, a.instrument IS NOT NULL AS ia, b.instrument IS NOT NULL AS ib, x, y FROM a FULL OUTER JOIN b ON a.datetime = b.datetime AND a.instrument = b.instrument),
k AS (SELECT *, rank() OVER (PARTITION BY datetime ORDER BY x) + (count(*) OVER (PARTITION BY datetime, x) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY datetime ORDER BY y) + (count(*) OVER (PARTITION BY datetime, y) - 1) / 2.0 AS rb FROM j WHERE ia AND ib AND x IS NOT NULL AND y IS NOT NULL),
c AS (SELECT datetime, {_corr_sql('x', 'y')} AS ic, {_corr_sql('ra', 'rb')} AS rank_ic FROM k GROUP BY 1 HAVING count(*) >= 2)
SELECT count(CASE WHEN isinf(x) THEN 1 END) AS inf_count, {rounded_sql('CAST(count(CASE WHEN ia THEN 1 END) AS DOUBLE) / count(CASE WHEN ib THEN 1 END)')} AS row_ratio, {rounded_sql('CAST(count(CASE WHEN ia AND ib THEN 1 END) AS DOUBLE) / count(*)')} AS key_jaccard, count(CASE WHEN ia AND x IS NULL THEN 1 END) = count(CASE WHEN ib AND y IS NULL THEN 1 END) AS same_nulls,
{rounded_sql('avg(CASE WHEN ia AND ib THEN CASE WHEN (x IS NULL AND y IS NULL) OR abs(x - y) <= 1e-6 THEN 1.0 ELSE 0.0 END END)')} AS equal_ratio, (SELECT {rounded_sql('avg(ic)')} FROM c) AS mean_ic, (SELECT {rounded_sql('avg(rank_ic)')} FROM c) AS mean_rank_ic FROM j""")
def implementation_report(spark, sf_dir):
    s = signals(spark, sf_dir)
    made = s.where("day(datetime) % 7 <> 0").select(*pn.KEYS, F.col("body").alias("value"))
    truth = s.where("day(datetime) % 5 <> 0").select(*pn.KEYS, F.when(F.dayofmonth("datetime") % 2 == 0, F.col("body")).otherwise(F.col("mom")).alias("value"))
    return _out(ev.implementation_report(made, truth), ["inf_count", "same_nulls"], ["row_ratio", "key_jaccard", "equal_ratio", "mean_ic", "mean_rank_ic"])


@query(f"""SELECT p_brand AS category, p_type AS factor, count(*) AS n_runs, {rounded_sql('avg(CASE WHEN p_size > 5 THEN 1.0 ELSE 0.0 END)')} AS run_success_rate, {rounded_sql('avg(CASE WHEN p_size > 10 THEN 1.0 ELSE 0.0 END)')} AS format_success_rate, {rounded_sql('avg(p_retailprice / 2000)')} AS avg_corr, {rounded_sql('max(p_retailprice / 2000)')} AS max_corr FROM part GROUP BY ROLLUP (p_brand, p_type) HAVING p_brand IS NOT NULL""")
def benchmark_summary(spark, sf_dir):
    runs = table(spark, sf_dir, "part").selectExpr("p_brand AS category", "p_type AS factor", "p_size > 5 AS run_ok", "p_size > 10 AS format_ok", "p_retailprice / 2000 AS corr")
    return _out(ev.benchmark_summary(runs), ["category", "factor", "n_runs"], ["run_success_rate", "format_success_rate", "avg_corr", "max_corr"])


@query(f"""WITH {IC_SQL} SELECT datetime AS date, factor AS factor_id, {_rounded('ic', 'rank_ic')}, {rounded_sql('NULL')} AS turnover FROM ic WHERE factor IN ('body', 'mom') AND day(datetime) BETWEEN 5 AND 31""")
def daily_ic_export(spark, sf_dir):
    daily = _daily(spark, sf_dir).where("day(datetime) >= 5").withColumnsRenamed({"datetime": "date", "factor": "factor_id"})
    return _out(ev.ic_export(daily, ["turnover"], ["body", "mom"]), ["date", "factor_id"], ["ic", "rank_ic", "turnover"])


@query(f"""SELECT o_orderpriority AS metric, {rounded_sql('avg(o_totalprice)', 2)} AS value, CASE WHEN o_orderpriority LIKE '1-%' THEN 'signal' WHEN o_orderpriority LIKE '2-%' THEN 'risk' ELSE 'other' END AS namespace FROM orders GROUP BY 1""")
def metric_namespaces(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("metric")).agg(F.avg("o_totalprice").alias("value"))
    return _out(ev.namespaced(m, {"1-": "signal", "2-": "risk"}), ["metric", "namespace"], ["value"], 2)


_RATIO = "CASE WHEN stddev_samp({0}) > 1e-12 THEN avg({0}) / stddev_samp({0}) ELSE 0 END"


@query(f"""WITH {IC_SQL}, a AS (SELECT factor, avg(ic) AS ic, {_RATIO.format('ic')} AS icir, avg(rank_ic) AS rank_ic, {_RATIO.format('rank_ic')} AS rank_icir FROM ic GROUP BY 1), v AS (SELECT factor, avg(CASE WHEN value IS NOT NULL AND label IS NOT NULL THEN 1.0 ELSE 0.0 END) AS valid_ratio FROM l GROUP BY 1)
SELECT factor, {_rounded('ic', 'icir', 'rank_ic', 'rank_icir', 'valid_ratio')} FROM a JOIN v USING (factor)""")
def signal_report(spark, sf_dir):
    return _out(ev.signal_report(long_signals(spark, sf_dir), "value", "label", ["factor"]), ["factor"], ["ic", "icir", "rank_ic", "rank_icir", "valid_ratio"])


@query(f"""WITH {IC_SQL}, a AS (SELECT factor, avg(ic) AS ic, avg(rank_ic) AS rank_ic, count(*) AS active_days FROM ic GROUP BY 1) SELECT 'ic' AS metric, count(DISTINCT ic) AS n FROM a UNION ALL SELECT 'rank_ic', count(DISTINCT rank_ic) FROM a""")
def distinct_metrics(spark, sf_dir):
    return ev.distinct_metrics(ev.signal_report(long_signals(spark, sf_dir), "value", "label", ["factor"]), ["ic", "rank_ic"])


@query(f"""WITH {SIGNAL_SQL}, t AS (SELECT datetime, instrument, mom AS s, label AS l, count(*) OVER (PARTITION BY datetime) AS n, row_number() OVER (PARTITION BY datetime ORDER BY mom, instrument) - 1 AS up, row_number() OVER (PARTITION BY datetime ORDER BY mom DESC, instrument) AS dn FROM s WHERE mom IS NOT NULL AND label IS NOT NULL),
g AS (SELECT *, CAST(least(least(5, n) - 1, floor(CAST(up * least(5, n) AS DOUBLE) / n)) AS INTEGER) AS g, n >= 2 AND dn <= greatest(1, ceil(n / 5.0)) AS top FROM t), m AS (SELECT datetime, n, g, avg(l) AS m FROM g GROUP BY 1, 2, 3),
sp AS (SELECT datetime, arg_max(m, g) - arg_min(m, g) AS d, max(n) AS n FROM m WHERE n >= 2 GROUP BY 1), pf AS (SELECT g, avg(m) AS m FROM m WHERE n >= 5 GROUP BY 1), ri AS (SELECT coalesce(avg(CASE WHEN r > 0 THEN 1.0 WHEN r <= 0 THEN 0.0 END), 0) AS group_monotonicity_score FROM (SELECT m - lag(m) OVER (ORDER BY g) AS r FROM pf)),
st AS (SELECT datetime, coalesce(list(instrument) FILTER (WHERE top), []) AS a FROM g GROUP BY 1), sb AS (SELECT a, lag(a) OVER (ORDER BY datetime) AS b FROM st), tu AS (SELECT coalesce(avg(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE 1 - CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) END), 0) AS turnover FROM sb WHERE b IS NOT NULL),
su AS (SELECT coalesce(avg(d), 0) AS gross, stddev_samp(d) AS sd, coalesce(avg(CASE WHEN n >= 5 THEN d END), 0) AS long_short_spread FROM sp)
SELECT {_rounded('turnover')}, {rounded_sql('gross - 0.001 * turnover')} AS cost_adjusted_return, {rounded_sql('CASE WHEN sd > 1e-12 THEN (gross - 0.001 * turnover) / sd ELSE 0 END')} AS cost_adjusted_ir, {_rounded('group_monotonicity_score', 'long_short_spread')} FROM tu, su, ri""")
def tradability_metrics(spark, sf_dir):
    return _out(ev.tradability(signals(spark, sf_dir), "mom", "label"), [], ["turnover", "cost_adjusted_return", "cost_adjusted_ir", "group_monotonicity_score", "long_short_spread"])


@query(f"""WITH q AS (SELECT CASE WHEN p_size < 20 THEN 'active' ELSE 'candidate' END AS status, p_type AS tier, p_retailprice / 20 AS h, CASE WHEN p_size % 3 = 0 THEN 'pass' ELSE 'reject' END AS gate_result, p_brand AS reason FROM part)
SELECT 'status' AS section, status AS name, count(*) AS n, {rounded_sql('NULL')} AS value FROM q GROUP BY 2 UNION ALL SELECT 'tier', tier, count(*), NULL FROM q GROUP BY 2 UNION ALL SELECT 'gate_failure', reason, count(*), NULL FROM q WHERE gate_result <> 'pass' GROUP BY 2 UNION ALL SELECT 'health', 'mean', count(h), {rounded_sql('avg(h)')} FROM q""")
def pool_report(spark, sf_dir):
    q = table(spark, sf_dir, "part").selectExpr("CASE WHEN p_size < 20 THEN 'active' ELSE 'candidate' END AS status", "p_type AS tier", "p_retailprice / 20 AS health_score", "CASE WHEN p_size % 3 = 0 THEN 'pass' ELSE 'reject' END AS gate_result", "p_brand AS reason")
    return _out(ev.status_report(q, q), ["section", "name", "n"], ["value"])


@query(f"""WITH {PANEL_SQL}, a AS (SELECT datetime, instrument, close, vwap FROM p WHERE day(datetime) <> 3), b AS (SELECT datetime, instrument, close AS c2, CASE WHEN volume > 3 THEN vwap ELSE open END AS v2 FROM p WHERE day(datetime) <> 5),
j AS (SELECT a.datetime IS NOT NULL AS ia, b.datetime IS NOT NULL AS ib, close, vwap, c2, v2 FROM a FULL OUTER JOIN b ON a.datetime = b.datetime AND a.instrument = b.instrument), l AS (SELECT ia, ib, 'close' AS "column", close AS x, c2 AS y FROM j UNION ALL SELECT ia, ib, 'vwap', vwap, v2 FROM j)
SELECT "column", count(CASE WHEN NOT ib THEN 1 END) AS only_left, count(CASE WHEN NOT ia THEN 1 END) AS only_right, count(CASE WHEN ia AND ib THEN 1 END) AS "rows", {rounded_sql('max(CASE WHEN ia AND ib THEN abs(x - y) END)')} AS max_abs_diff, {rounded_sql('avg(CASE WHEN ia AND ib THEN abs(x - y) END)')} AS mean_abs_diff, bool_and(ia AND ib AND coalesce(abs(x - y) <= 1e-8 + 1e-6 * abs(y), false)) AS passed FROM l GROUP BY 1""")
def frame_parity(spark, sf_dir):
    p = events_panel(spark, sf_dir)
    b = p.where("day(datetime) <> 5").select(*pn.KEYS, "close", F.when(F.col("volume") > 3, F.col("vwap")).otherwise(F.col("open")).alias("vwap"))
    return _out(ev.parity(p.where("day(datetime) <> 3"), b, pn.KEYS, ["close", "vwap"]), ["column", "only_left", "only_right", "rows", "passed"], ["max_abs_diff", "mean_abs_diff"])


@query(f"""WITH {PANEL_SQL} SELECT datetime, instrument, {rounded_sql('(close - open) / nullif(open, 0)')} AS day_return, {rounded_sql(f'CASE WHEN count(volume) OVER w >= 5 THEN volume / nullif(avg(volume) OVER w, 0) END')} AS volume_ratio, {rounded_sql(f'(high - low) / nullif(lag(close) {TIME}, 0)')} AS amplitude, {rounded_sql(f'close / nullif(lag(close) {TIME}, 0) - 1')} AS momentum FROM p WINDOW w AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def factors_baseline(spark, sf_dir):
    from . import factors as fs

    return _out(fs.with_factors(events_panel(spark, sf_dir), fs.baseline(5)), pn.KEYS, ["day_return", "volume_ratio", "amplitude", "momentum"])


@query("""WITH o AS (SELECT o_custkey AS k, o_orderpriority AS alias, o_totalprice AS v, o_orderdate AS disclosed, o_orderkey AS rev FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30'), l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY k, alias ORDER BY disclosed DESC, rev DESC) = 1)
SELECT k, max(CASE WHEN alias = '1-URGENT' THEN v END) AS urgent, max(CASE WHEN alias = '2-HIGH' THEN v END) AS high FROM l GROUP BY 1""")
def point_in_time_panel(spark, sf_dir):
    """The latest disclosed value of each alias as of a date, an alias a column."""
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey AS k", "o_orderpriority AS alias", "o_totalprice AS v", "o_orderdate AS disclosed", "o_orderkey AS rev")
    latest = pn.point_in_time(o, "1996-06-30", ["k", "alias"], "disclosed", "rev")
    return pn.wide(latest, "k", "alias", "v", ["1-URGENT", "2-HIGH"]).withColumnsRenamed({"1-URGENT": "urgent", "2-HIGH": "high"})


@query("""SELECT l_returnflag, count(l_extendedprice) AS n, """ + _rounded_as({"low": "quantile_cont(l_extendedprice, 0.05)", "middle": "median(l_extendedprice)", "high": "quantile_cont(l_extendedprice, 0.999)"}) + " FROM lineitem GROUP BY 1")
def group_quantiles(spark, sf_dir):
    """Exact quantiles of a few groups that hold the whole table, by histograms of ordered bits."""
    q = sl.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.999])
    named = q.select("l_returnflag", "n", *(F.col("q")[i].alias(n) for i, n in enumerate(("low", "middle", "high"))))
    return _out(named, ["l_returnflag", "n"], ["low", "middle", "high"])


@query(f"""WITH {IC_SQL}, a AS (SELECT *, median(value) OVER (PARTITION BY factor) AS m FROM l),
b AS (SELECT *, median(abs(value - m)) OVER (PARTITION BY factor) AS d FROM a)
SELECT factor, datetime, instrument, {rounded_sql('CASE WHEN value IS NOT NULL THEN greatest(least(value, m + 3 * d), m - 3 * d) END')} AS value FROM b""")
def mad_winsorize_factor(spark, sf_dir):
    """Each factor's whole history held within three median distances."""
    return _out(sl.winsorized(long_signals(spark, sf_dir), "value", 3.0, ["factor"]), ["factor", *pn.KEYS], ["value"])


@query(f"""WITH {IC_SQL}, q AS (SELECT factor, quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS b FROM l GROUP BY 1)
SELECT factor, datetime, instrument, {rounded_sql('CASE WHEN value IS NOT NULL THEN greatest(least(value, b), a) END')} AS value FROM l JOIN q USING (factor)""")
def percentile_clip_factor(spark, sf_dir):
    """Each factor's whole history held within its 2nd and 98th percentile."""
    return _out(sl.clipped(long_signals(spark, sf_dir), "value", 0.02, 0.98, ["factor"]), ["factor", *pn.KEYS], ["value"])


def _decay_sql(daily: str, whole: int, late: int, end: int) -> str:
    """recent_decay of the table (factor, date, v)."""
    return f"""b AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY date DESC, v DESC) AS b FROM {daily}),
m AS (SELECT factor, count(*) AS n, avg(CASE WHEN b > {late} THEN v END) AS early, avg(CASE WHEN b <= {late} THEN v END) AS late, avg(CASE WHEN b <= {end} THEN v END) AS last,
count(CASE WHEN v IS NULL THEN 1 END) AS nulls FROM b WHERE b <= {whole} GROUP BY 1),
decay AS (SELECT factor, n = {whole} AND nulls = 0 AND early <> 0 AND (late / nullif(early, 0) <= 0.8 OR last <= 0) AS recent_decay FROM m)"""


@query(f"WITH {IC_SQL}, y AS (SELECT factor, datetime AS date, rank_ic AS v FROM ic WHERE rank_ic IS NOT NULL), {_decay_sql('y', 12, 6, 2)} SELECT factor, coalesce(recent_decay, false) AS recent_decay FROM decay")
def recent_decay(spark, sf_dir):
    daily = _daily(spark, sf_dir).where("rank_ic is not null").withColumnRenamed("datetime", "date")
    return ev.recent_decay(daily, value="rank_ic", days=(12, 6, 2))


_YIELD = "avg(l_discount) - 0.0431e0"


@query(f"""WITH y AS (SELECT l_suppkey AS factor, l_shipdate AS date, {_YIELD} AS v FROM lineitem GROUP BY 1, 2), {_decay_sql('y', 120, 60, 20)},
s AS (SELECT s_suppkey AS factor, 50 + s_acctbal / 200 AS h, coalesce(recent_decay, false) AS recent_decay FROM supplier LEFT JOIN decay ON factor = s_suppkey)
SELECT factor, recent_decay, CASE WHEN h >= 80 AND NOT recent_decay THEN 'A' WHEN h >= 80 THEN 'B' ELSE 'C' END AS tier,
CASE WHEN h >= 80 AND NOT recent_decay THEN 'core' WHEN h >= 80 THEN 'satellite' WHEN h >= 60 THEN 'candidate' ELSE 'watchlist' END AS ops_status,
CASE WHEN h >= 80 AND NOT recent_decay THEN 'core rules passed' WHEN h >= 80 THEN 'recent decay detected'
WHEN h >= 60 THEN 'missing marginal contribution evidence' ELSE 'candidate score band' END AS reasons FROM s""")
def tiers_of_histories(spark, sf_dir):
    """Tiers whose decay is read from 120 days of each factor's history."""
    daily = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("factor"), F.col("l_shipdate").alias("date")).agg(F.expr(_YIELD).alias("ic"))
    given = {"health_confidence": "0.9e0", "oos_ic": "0.03e0", "oos_icir": "0.4e0", "max_abs_corr": "0.5e0", "pit_failed": "false", "severe_data_issue": "false", "after_cost_effective": "true", "marginal_contribution": "false", "regime_effective": "false"}
    scores = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS factor", "50 + s_acctbal / 200 AS health_score", *(f"{e} AS {n}" for n, e in given.items()))
    scores = scores.join(ev.recent_decay(daily), "factor", "left").na.fill(False, ["recent_decay"])
    return ev.tiers(scores).select("factor", "recent_decay", "tier", "ops_status", "reasons")


_REASONS = "CASE p_partkey % 5 WHEN 0 THEN {0}'constant_signal', 'high_similarity'{1} WHEN 1 THEN {0}'slow'{1} WHEN 2 THEN {0}'low_active_days', 'extreme_values'{1} WHEN 3 THEN {0}'too_many_nan', 'high_similarity'{1} END AS reasons"
_MORE = {"failure_type": "CASE WHEN p_partkey % 17 = 0 THEN 'expression_anti_pattern' END", "group_monotonicity_score": "CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 11) / 10.0e0 END"}
_SAID = {
    "LOOKAHEAD_DETECTED": "lookahead_risk = 'critical'",
    "ANTI_PATTERN_DETECTED": "failure_type = 'expression_anti_pattern'",
    "LOW_COVERAGE": "list_contains(reasons, 'low_active_days')",
    "TOO_MANY_NAN": "list_contains(reasons, 'too_many_nan')",
    "CONSTANT_SIGNAL": "list_contains(reasons, 'constant_signal')",
    "EXTREME_VALUE_SIGNAL": "list_contains(reasons, 'extreme_values')",
    "HIGH_SIMILARITY": "list_contains(reasons, 'high_similarity')",
    "HIGH_TURNOVER": "turnover > 0.8",
    "WEAK_OOS_IC": "rank_ic_test <= 0",
    "POOR_MONOTONICITY": "group_monotonicity_score < 0.35",
}


def _named_sql(key: str, names: dict[str, str], otherwise: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE '{otherwise}' END"


@query(f"""WITH q AS (SELECT {', '.join(f'{e} AS {n}' for n, e in (_QUALITY | _MORE).items())}, {_REASONS.format('[', ']')} FROM part),
p AS (SELECT *, CASE WHEN lookahead_risk = 'critical' THEN 'lookahead_risk' WHEN rank_ic_test <= 0 THEN 'weak_oos_ic' WHEN list_contains(reasons, 'too_many_nan') THEN 'too_many_nan'
WHEN list_contains(reasons, 'constant_signal') THEN 'constant_signal' WHEN list_contains(reasons, 'high_similarity') THEN 'high_similarity' ELSE 'weak_ic' END AS primary_reason,
list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _SAID.items())}], lambda x: x IS NOT NULL) AS found FROM q),
c AS (SELECT *, CASE WHEN len(found) > 0 THEN found ELSE [{_named_sql('primary_reason', ev.REASON_CODES, 'UNKNOWN')}] END AS codes FROM p)
SELECT factor, primary_reason, array_to_string(codes, ',') AS reason_codes, codes[1] AS reason_code, {_named_sql('codes[1]', ev.CODE_GROUPS, 'unknown')} AS reason_group,
CASE WHEN codes[1] IN ({', '.join(f"'{c}'" for c in ev.HIGH_SEVERITY)}) THEN 'high' WHEN codes[1] IN ({', '.join(f"'{c}'" for c in ev.MEDIUM_SEVERITY)}) THEN 'medium' ELSE 'low' END AS reason_severity,
{_named_sql('primary_reason', ev.NEXT_ACTIONS, 'change_window')} AS action_type, {_named_sql('primary_reason', ev.INSTRUCTIONS, ev.OTHER_INSTRUCTION)} AS instruction FROM c""")
def failure_codes(spark, sf_dir):
    q = table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in (_QUALITY | _MORE).items()), _REASONS.format("array(", ")"))
    return ev.failure_codes(q).select("factor", "primary_reason", "reason_codes", "reason_code", "reason_group", "reason_severity", "action_type", "instruction")
