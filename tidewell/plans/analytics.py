"""Queries over panels, joins, signals, pools and logs, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as c
from ..operators import comoments as cm
from ..operators import graph as gr
from ..operators import panel as pn
from ..operators import portfolio as pf
from ..operators import signal as sg
from ..operators.windows import Windows
from ..sources import events_panel, first_by, parse_date, read_source, supply_panel, table
from . import factors as fs
from .language import PANEL_SQL, rounded, rounded_sql, rows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _out(frame: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return frame.select(*keys, *(rounded(F.col(v), digits).alias(v) for v in values))


TIME = "OVER (PARTITION BY instrument ORDER BY datetime)"
SIGNAL_SQL = f"""{PANEL_SQL}, s AS (SELECT datetime, instrument, close / nullif(lag(close) {TIME}, 0) - 1 AS mom, (close - open) / nullif(open, 0) AS body, volume AS vol,
lead(close, 2) {TIME} / nullif(lead(close) {TIME}, 0) - 1 AS label FROM p)"""


def _corr_sql(a: str, b: str, over: str = "") -> str:
    return f"covar_pop({a}, {b}) {over} / nullif(stddev_pop({a}) {over} * stddev_pop({b}) {over}, 0)"


IC_SQL = f"""{SIGNAL_SQL}, l AS (SELECT datetime, instrument, label, unnest(['body', 'mom', 'vol']) AS factor, unnest([body, mom, vol]) AS value FROM s),
k AS (SELECT *, rank() OVER (PARTITION BY factor, datetime ORDER BY value) + (count(*) OVER (PARTITION BY factor, datetime, value) - 1) / 2.0 AS ra,
rank() OVER (PARTITION BY factor, datetime ORDER BY label) + (count(*) OVER (PARTITION BY factor, datetime, label) - 1) / 2.0 AS rb FROM l WHERE value IS NOT NULL AND label IS NOT NULL),
ic AS (SELECT factor, datetime, count(*) AS n, {_corr_sql('value', 'label')} AS ic, {_corr_sql('ra', 'rb')} AS rank_ic FROM k GROUP BY 1, 2 HAVING count(*) >= 2)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = c.divide(c.delay("close", -2), c.delay("close", -1)) - 1
    return events_panel(spark, sf_dir).select("datetime", "instrument", c.ts_pctchange("close").alias("mom"), c.divide(F.col("close") - F.col("open"), "open").alias("body"), F.col("volume").alias("vol"), label.alias("label"))


def long_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).unpivot(["datetime", "instrument", "label"], ["body", "mom", "vol"], "factor", "value")


@query(f"WITH {PANEL_SQL} SELECT datetime, instrument, {', '.join(f'{rounded_sql(x)} AS {x}' for x in ('open', 'close', 'high', 'low', 'volume', 'vwap'))} FROM p")
def panel_events(spark, sf_dir):
    return _out(events_panel(spark, sf_dir), pn.KEYS, ["open", "close", "high", "low", "volume", "vwap"])


@query(f"""WITH x AS (SELECT *, l_extendedprice / l_quantity AS price, {{'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice, 'e': l_quantity}} AS o FROM lineitem)
SELECT CAST(l_suppkey AS VARCHAR) AS instrument, CAST(l_shipdate AS DATE) AS datetime, {rounded_sql('arg_min(price, o)')} AS open, {rounded_sql('arg_max(price, o)')} AS close, {rounded_sql('max(price)')} AS high, {rounded_sql('min(price)')} AS low,
{rounded_sql('sum(l_quantity)')} AS volume, {rounded_sql('sum(l_extendedprice) / sum(l_quantity)')} AS vwap FROM x GROUP BY 1, 2""")
def panel_supply(spark, sf_dir):
    return _out(supply_panel(spark, sf_dir), pn.KEYS, ["open", "close", "high", "low", "volume", "vwap"])


FILLED_SQL = f"""{PANEL_SQL}, g AS (SELECT d.datetime, i.instrument FROM (SELECT DISTINCT datetime FROM p) d CROSS JOIN (SELECT DISTINCT instrument FROM p) i),
f AS (SELECT g.datetime, g.instrument, open AS o, high AS h, low AS l, vwap AS w, volume AS v, last_value(close IGNORE NULLS) OVER (PARTITION BY g.instrument ORDER BY g.datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM g LEFT JOIN p USING (datetime, instrument)),
z AS (SELECT datetime, instrument, coalesce(o, close) AS open, coalesce(h, close) AS high, coalesce(l, close) AS low, close, coalesce(v, 0) AS volume, coalesce(w, close) AS vwap, v IS NULL AS is_suspended,
CASE WHEN v IS NULL THEN 0 ELSE coalesce(close / nullif(lag(close) OVER (PARTITION BY instrument ORDER BY datetime), 0) - 1, 0) END AS ret FROM f)"""


@query(f"WITH {FILLED_SQL} SELECT datetime, instrument, {', '.join(f'{rounded_sql(x)} AS {x}' for x in ('open', 'high', 'low', 'close', 'volume', 'vwap', 'ret'))}, is_suspended FROM z")
def panel_filled(spark, sf_dir):
    return _out(pn.filled(pn.completed(events_panel(spark, sf_dir))), [*pn.KEYS, "is_suspended"], ["open", "high", "low", "close", "volume", "vwap", "ret"])


@query(f"WITH {PANEL_SQL} SELECT d.datetime, i.instrument FROM (SELECT DISTINCT datetime FROM p) d CROSS JOIN (SELECT DISTINCT instrument FROM p) i EXCEPT SELECT datetime, instrument FROM p")
def missing_cells(spark, sf_dir):
    p = events_panel(spark, sf_dir)
    return pn.completed(p).select(*pn.KEYS).join(p, pn.KEYS, "left_anti")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS datetime FROM orders EXCEPT SELECT CAST(l_shipdate AS DATE) FROM lineitem")
def missing_dates(spark, sf_dir):
    dates = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("datetime")).distinct()
    return pn.missing_dates(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("datetime")), dates)


@query(f"WITH {PANEL_SQL} SELECT datetime, instrument, {rounded_sql('close')} AS close FROM p WHERE datetime IN (SELECT datetime FROM (SELECT DISTINCT datetime FROM p) ORDER BY datetime DESC LIMIT 5)")
def recent_dates(spark, sf_dir):
    return _out(pn.recent_dates(events_panel(spark, sf_dir), 5), pn.KEYS, ["close"])


@query("SELECT o_orderkey, o_orderdate, o_custkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31' AND o_totalprice >= 100000 AND o_orderstatus IN ('O', 'F')")
def source_read(spark, sf_dir):
    return read_source(table(spark, sf_dir, "orders"), "o_orderdate", ("1995-01-01", "1995-12-31"), ["o_orderkey", "o_orderdate", "o_custkey"], [("o_totalprice", ">=", 100000), ("o_orderstatus", "in", ["O", "F"])])


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y%m%d') AS compact, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders")
def date_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(parse_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.date_format("o_orderdate", "yyyyMMdd").alias("compact"), parse_date(F.date_format("o_orderdate", "yyyyMM")).alias("month_start")).distinct()


@query("SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_by_key(spark, sf_dir):
    return first_by(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")


LINES = "SELECT l_orderkey, l_linenumber, l_shipdate, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return li.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")


def _as_of_sql(op: str) -> str:
    return f"""WITH l AS ({LINES}), v AS (SELECT o_custkey, o_orderdate, max({{'a': o_totalprice, 'b': o_orderkey}}) AS m FROM orders GROUP BY 1, 2)
SELECT l.l_orderkey, l.l_linenumber, l.l_shipdate, v.m.a AS o_totalprice, v.m.b AS o_orderkey FROM l ASOF LEFT JOIN v ON l.o_custkey = v.o_custkey AND l.l_shipdate {op} v.o_orderdate"""


@query(_as_of_sql(">="))
def as_of_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return pn.as_of(_lines(spark, sf_dir), o, "o_custkey", "l_shipdate", "o_orderdate", ["o_totalprice", "o_orderkey"]).drop("o_custkey")


@query(_as_of_sql(">"))
def as_of_join_strict(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return pn.as_of(_lines(spark, sf_dir), o, "o_custkey", "l_shipdate", "o_orderdate", ["o_totalprice", "o_orderkey"], strict=True).drop("o_custkey")


EVENT_SQL = "SELECT CAST(user_id AS VARCHAR) AS instrument, CAST(ts AS DATE) AS h, CAST(ts AS DATE) + CAST(event_id % 3 AS INTEGER) AS vis, value FROM events WHERE event_type = 'purchase'"


@query(f"""WITH {PANEL_SQL}, e AS ({EVENT_SQL})
SELECT p.datetime, p.instrument, count(e.h) AS count_7d, {rounded_sql('coalesce(sum(e.value), 0)')} AS amount_7d, min(p.datetime - e.h) AS recency
FROM p LEFT JOIN e ON e.instrument = p.instrument AND e.h > p.datetime - 7 AND e.h <= p.datetime AND e.vis <= p.datetime GROUP BY 1, 2""")
def event_window_join(spark, sf_dir):
    day = F.to_date("ts")
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("instrument"), day.alias("h"), F.date_add(day, (F.col("event_id") % 3).cast("int")).alias("vis"), "value")
    out = pn.event_window(events_panel(spark, sf_dir).select(*pn.KEYS), e, 7, "h", "vis", "value")
    return out.select(*pn.KEYS, "count_7d", rounded(F.col("amount_7d")).alias("amount_7d"), F.col("recency").cast("long").alias("recency"))


@query(f"""WITH {PANEL_SQL}, m AS (SELECT CAST(ts AS DATE) AS datetime, avg(value) AS market, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
SELECT datetime, instrument, {rounded_sql('close - market')} AS excess, users FROM p LEFT JOIN m USING (datetime)""")
def context_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("datetime", F.to_date("ts"))
    out = pn.context_by_date(events_panel(spark, sf_dir), e, [F.avg("value").alias("market"), F.count_distinct("user_id").alias("users")])
    return out.select(*pn.KEYS, rounded(F.col("close") - F.col("market")).alias("excess"), "users")


@query(f"WITH {PANEL_SQL} SELECT datetime, instrument, CASE WHEN EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND CAST(e.user_id AS VARCHAR) = p.instrument AND CAST(e.ts AS DATE) = p.datetime) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS failed FROM p")
def flag_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.to_date("ts").alias("datetime"), F.col("user_id").cast("string").alias("instrument"))
    return pn.present_in(events_panel(spark, sf_dir).select(*pn.KEYS), e, "failed")


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def point_in_time(spark, sf_dir):
    return pn.point_in_time(table(spark, sf_dir, "orders"), "1996-06-30", ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(f"SELECT user_id, {', '.join(f'''{rounded_sql(f'sum(CASE WHEN event_type = {t!r} THEN value END)')} AS {t}''' for t in _TYPES)} FROM events GROUP BY 1")
def wide_pivot(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    return _out(pn.wide(e, "user_id", "event_type", "v", _TYPES), ["user_id"], _TYPES)


def _ratio_sql(x: str) -> str:
    return f"CASE WHEN stddev_samp({x}) > 1e-12 THEN avg({x}) / stddev_samp({x}) ELSE 0 END"


@query(f"WITH {IC_SQL} SELECT factor, datetime, n, {rounded_sql('ic')} AS ic, {rounded_sql('rank_ic')} AS rank_ic FROM ic")
def daily_ic(spark, sf_dir):
    return _out(sg.daily_ic(long_signals(spark, sf_dir), "value", "label", ("factor", "datetime")), ["factor", "datetime", "n"], ["ic", "rank_ic"])


@query(f"""WITH {IC_SQL} SELECT factor, {rounded_sql('avg(ic)')} AS ic, {rounded_sql(_ratio_sql('ic'))} AS icir, {rounded_sql('avg(rank_ic)')} AS rank_ic, {rounded_sql(_ratio_sql('rank_ic'))} AS rank_icir,
CAST(sum(n) AS BIGINT) AS aligned_rows, count(*) AS active_days, {rounded_sql('avg(n)')} AS mean_cross_section FROM ic GROUP BY 1""")
def signal_metrics(spark, sf_dir):
    daily = sg.daily_ic(long_signals(spark, sf_dir), "value", "label", ("factor", "datetime"))
    return _out(sg.ic_summary(daily, ["factor"]), ["factor", "aligned_rows", "active_days"], ["ic", "icir", "rank_ic", "rank_icir", "mean_cross_section"])


RISK_SQL = """c AS (SELECT g, date, excess, sum(excess) OVER (PARTITION BY g ORDER BY date ROWS UNBOUNDED PRECEDING) AS cs FROM x),
d AS (SELECT *, cs - greatest(max(cs) OVER (PARTITION BY g ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS dd FROM c),
m AS (SELECT g, avg(excess) AS m, stddev_samp(excess) AS s, least(min(dd), 0) AS md FROM d GROUP BY g)"""
RISK_COLUMNS = f"""{rounded_sql('m * 238.0')} AS annualized_return, {rounded_sql('CASE WHEN s > 1e-12 THEN m / s ELSE 0 END * sqrt(238.0)')} AS information_ratio, {rounded_sql('md')} AS max_drawdown, {rounded_sql('CASE WHEN abs(md) > 1e-12 THEN m * 238.0 / abs(md) ELSE 0 END')} AS calmar_ratio"""


@query(f"WITH {FILLED_SQL}, x AS (SELECT instrument AS g, datetime AS date, ret - 0.001 AS excess FROM z), {RISK_SQL} SELECT g AS instrument, {RISK_COLUMNS} FROM m")
def risk_metrics(spark, sf_dir):
    r = pn.filled(pn.completed(events_panel(spark, sf_dir))).select("instrument", F.col("datetime").alias("date"), (F.col("ret") - 0.001).alias("excess"))
    return _out(sg.risk(r, ["instrument"]), ["instrument"], ["annualized_return", "information_ratio", "max_drawdown", "calmar_ratio"])


@query(f"""WITH x AS (SELECT year(o_orderdate) AS g, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) / 1e7 - 0.02 AS excess FROM orders GROUP BY 1, 2), {RISK_SQL} SELECT CAST(g AS INTEGER) AS year, {RISK_COLUMNS} FROM m""")
def risk_metrics_by_year(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("date")).agg((F.sum("o_totalprice") / 1e7 - 0.02).alias("excess"))
    return _out(sg.risk(o, ["year"]), ["year"], ["annualized_return", "information_ratio", "max_drawdown", "calmar_ratio"])


LIMITS = {"min_valid_ratio": 0.97, "max_nan_ratio": 0.03, "min_n_unique": 20, "min_active_ratio": 0.98, "max_constant_ratio": 0.2, "min_coverage": 0.96, "max_extreme_ratio": 0.001}
_REASONS = ", ".join(f"CASE WHEN {k[4:]} {'<' if k.startswith('min_') else '>'} {v} THEN '{k[4:]}' END" for k, v in LIMITS.items())


@query(f"""WITH {IC_SQL}, zs AS (SELECT *, abs(value - avg(value) OVER (PARTITION BY factor)) / nullif(stddev_samp(value) OVER (PARTITION BY factor), 0) AS z FROM l),
dd AS (SELECT factor, datetime, count(value) AS dn, count(*) AS dr, coalesce(min(value) = max(value), true) AS same FROM zs GROUP BY 1, 2),
a AS (SELECT factor, avg(CASE WHEN dn > 0 THEN 1.0 ELSE 0.0 END) AS active_ratio, avg(CASE WHEN same THEN 1.0 ELSE 0.0 END) AS constant_ratio, avg(CAST(dn AS DOUBLE) / dr) AS coverage FROM dd GROUP BY 1),
b AS (SELECT factor, avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END) AS valid_ratio, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS nan_ratio, count(DISTINCT value) AS n_unique, avg(CASE WHEN z > 8 THEN 1.0 ELSE 0.0 END) AS extreme_ratio FROM zs GROUP BY 1)
SELECT factor, n_unique, {', '.join(f'{rounded_sql(x)} AS {x}' for x in ('valid_ratio', 'nan_ratio', 'extreme_ratio', 'active_ratio', 'constant_ratio', 'coverage'))}, array_to_string(list_filter([{_REASONS}], lambda r: r IS NOT NULL), ',') AS reasons FROM a JOIN b USING (factor)""")
def pre_backtest_screen(spark, sf_dir):
    out = sg.pre_backtest_screen(long_signals(spark, sf_dir), LIMITS)
    return _out(out, ["factor", "n_unique", "reasons"], ["valid_ratio", "nan_ratio", "extreme_ratio", "active_ratio", "constant_ratio", "coverage"])


@query(f"""WITH {IC_SQL}, x AS (SELECT a.factor AS f, b.factor AS g, a.datetime AS datetime, {_corr_sql('a.value', 'b.value')} AS r FROM l a JOIN l b ON a.datetime = b.datetime AND a.instrument = b.instrument AND a.factor < b.factor WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2, 3)
SELECT f, g, {rounded_sql('avg(r)')} AS mean_corr, {rounded_sql('avg(abs(r))')} AS mean_abs_corr, {rounded_sql('max(abs(r))')} AS max_abs_corr FROM x GROUP BY 1, 2""")
def factor_correlations(spark, sf_dir):
    return _out(cm.factor_correlations(long_signals(spark, sf_dir)), ["f", "g"], ["mean_corr", "mean_abs_corr", "max_abs_corr"])


BUCKET_SQL = f"""{PANEL_SQL}, b AS (SELECT datetime, instrument, close, least(4, CAST(floor((row_number() OVER (PARTITION BY datetime ORDER BY close, instrument) - 1) * 5 / CAST(count(*) OVER (PARTITION BY datetime) AS DOUBLE)) AS INTEGER)) AS bucket FROM p WHERE close IS NOT NULL)"""


@query(f"WITH {BUCKET_SQL} SELECT datetime, bucket, count(*) AS n, {rounded_sql('avg(close)')} AS mean FROM b GROUP BY 1, 2")
def quantile_buckets(spark, sf_dir):
    b = sg.quantile_buckets(events_panel(spark, sf_dir), "close", 5)
    return _out(b.groupBy("datetime", "bucket").agg(F.count("*").alias("n"), F.avg("close").alias("mean")), ["datetime", "bucket", "n"], ["mean"])


@query(f"""WITH {BUCKET_SQL}, t AS (SELECT datetime, list(instrument) AS s FROM b WHERE bucket = 4 GROUP BY 1), u AS (SELECT datetime, s, lag(s) OVER (ORDER BY datetime) AS o FROM t)
SELECT datetime, {rounded_sql('1 - CAST(len(list_intersect(s, o)) AS DOUBLE) / (len(s) + len(o) - len(list_intersect(s, o)))')} AS turnover FROM u WHERE o IS NOT NULL""")
def top_turnover(spark, sf_dir):
    return _out(sg.turnover(events_panel(spark, sf_dir), "close"), ["datetime"], ["turnover"])


MARKET_SQL = "mk AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 1e5 - 1 AS market_return FROM orders GROUP BY 1)"


@query(f"""WITH {MARKET_SQL}, w AS (SELECT date, CASE WHEN count(market_return) OVER v >= 20 THEN avg(market_return) OVER v END AS trend, CASE WHEN count(market_return) OVER v >= 20 THEN stddev_pop(market_return) OVER v END AS vol FROM mk WINDOW v AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
q AS (SELECT quantile_cont(trend, 0.3) AS a, quantile_cont(trend, 0.7) AS b, quantile_cont(vol, 0.7) AS v FROM w)
SELECT date, (CASE WHEN trend >= b THEN 'bull' WHEN trend <= a THEN 'bear' ELSE 'sideways' END) || '_' || (CASE WHEN vol >= v THEN 'high_vol' ELSE 'low_vol' END) AS regime FROM w, q WHERE trend IS NOT NULL""")
def regime_labels(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 1e5 - 1).alias("market_return"))
    return sg.regimes(m)


_S = [f"s{n}" for n in (5, 10)]


@query(f"""WITH {IC_SQL}, b AS (SELECT factor, ic, row_number() OVER (PARTITION BY factor ORDER BY datetime DESC) AS b FROM ic),
t AS (SELECT factor, regr_slope(CASE WHEN b <= 5 THEN ic END, -b) AS s5, regr_slope(CASE WHEN b <= 10 THEN ic END, -b) AS s10, count(CASE WHEN b <= 5 THEN ic END) AS n5, count(CASE WHEN b <= 10 THEN ic END) AS n10 FROM b GROUP BY 1)
SELECT factor, {rounded_sql('(CASE WHEN n5 >= 5 THEN s5 * 0.6 ELSE 0 END + CASE WHEN n10 >= 10 THEN s10 * 0.4 ELSE 0 END) / nullif(CASE WHEN n5 >= 5 THEN 0.6 ELSE 0 END + CASE WHEN n10 >= 10 THEN 0.4 ELSE 0 END, 0)')} AS trend FROM t""")
def ic_trend(spark, sf_dir):
    daily = sg.daily_ic(long_signals(spark, sf_dir), "value", "label", ("factor", "datetime")).withColumnRenamed("datetime", "date")
    return _out(sg.ic_trend(daily, {5: 0.6, 10: 0.4}), ["factor"], ["trend"])


@query(f"""WITH {PANEL_SQL}, a AS (SELECT *, median(close) OVER (PARTITION BY datetime) AS m FROM p), b AS (SELECT *, median(abs(close - m)) OVER (PARTITION BY datetime) AS d FROM a)
SELECT datetime, instrument, {rounded_sql('greatest(least(close, m + 1.5 * d), m - 1.5 * d)')} AS close FROM b""")
def mad_winsorize(spark, sf_dir):
    return _out(sg.winsorized(events_panel(spark, sf_dir), "close", 1.5), pn.KEYS, ["close"])


@query(f"WITH {PANEL_SQL} SELECT datetime, instrument, {rounded_sql('greatest(least(close, quantile_cont(close, 0.95) OVER (PARTITION BY datetime)), quantile_cont(close, 0.05) OVER (PARTITION BY datetime))')} AS close FROM p")
def percentile_clip(spark, sf_dir):
    return _out(sg.percentile_clipped(events_panel(spark, sf_dir), "close", 0.05, 0.95), pn.KEYS, ["close"])


def _sigmoid_sql(x: str, k: float, x0: float) -> str:
    return f"100 / (1 + exp(greatest(least(-({k}) * ({x} - {x0}), 700), -700)))"


@query(f"""WITH {IC_SQL}, m AS (SELECT factor, avg(ic) AS ic, {_ratio_sql('ic')} AS icir FROM ic GROUP BY 1)
SELECT factor, {rounded_sql(f"({_sigmoid_sql('abs(ic)', 50, 0.03)} * 25 + {_sigmoid_sql('icir', 10, 0.5)} * 20) / 100")} AS health_score, {rounded_sql('0.45')} AS health_confidence FROM m""")
def health_score(spark, sf_dir):
    s = sg.ic_summary(sg.daily_ic(long_signals(spark, sf_dir), "value", "label", ("factor", "datetime")), ["factor"])
    none = F.lit(None).cast("double")
    dims = dict.fromkeys(sg.HEALTH_WEIGHTS, none) | {"prediction_power": sg.sigmoid_score(F.abs("ic"), 50, 0.03), "stability": sg.sigmoid_score(F.col("icir"), 10, 0.5)}
    return _out(sg.health(s, dims), ["factor"], ["health_score", "health_confidence"])


@query("""WITH l AS (SELECT o_custkey AS k, o_orderkey AS seq, o_totalprice AS v, CASE WHEN o_orderstatus = 'P' THEN 'delete' ELSE 'upsert' END AS op FROM orders)
SELECT k, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM l) WHERE r = 1 AND op <> 'delete'""")
def event_log_effective(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("v"), F.when(F.col("o_orderstatus") == "P", "delete").otherwise("upsert").alias("op"))
    return sg.latest_events(log, "k", ["seq"]).select("k", "seq", "v")


@query("SELECT p_partkey, substr(sha256(p_name || '|' || p_type), 1, 16) AS expression_hash, md5(p_name) AS name_md5 FROM part")
def expression_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.substring(F.sha2(F.concat_ws("|", "p_name", "p_type"), 256), 1, 16).alias("expression_hash"), F.md5("p_name").alias("name_md5"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT p_brand, p_partkey, p_retailprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def cluster_quota(spark, sf_dir):
    return sg.top_per_group(table(spark, sf_dir, "part"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "p_retailprice", F.col("rank").cast("long").alias("rank"))


@query("SELECT DISTINCT p_type, regexp_replace(regexp_replace(lower(p_type), '\\s+', '', 'g'), '\\d+(\\.\\d+)?', 'N', 'g') AS skeleton FROM part")
def expression_skeleton(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type", sg.expression_skeleton(F.col("p_type")).alias("skeleton")).distinct()


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, 1000000 + l_partkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
h AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hop UNION SELECT u.b, hop + 1 FROM h JOIN u ON u.a = h.node WHERE hop < 3) SELECT node, min(hop) AS hop FROM h GROUP BY 1""")
def graph_hops(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b"))
    return gr.hops(e, spark.range(1, 2).withColumnRenamed("id", "node"), 3)


@query("SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, md5(substr(text, i * 900 + 1, 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, CAST((greatest(length(text), 1) - 1) / 900 AS BIGINT) + 1)) AS i FROM documents) WHERE i * 900 <= greatest(length(text) - 1, 0)")
def text_chunks(spark, sf_dir):
    return sg.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 1000, 100).select("doc_id", "chunk_no", F.md5("chunk").alias("digest"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def status_report(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query(f"""WITH {PANEL_SQL}, b AS (SELECT CAST(user_id AS VARCHAR) AS instrument, CAST(ts AS DATE) AS datetime, arg_max(value, ts) AS other FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT count(*) AS n_keys, count(CASE WHEN b.instrument IS NULL THEN 1 END) AS only_left, {rounded_sql('max(abs(p.close - b.other))')} AS max_diff, {rounded_sql('avg(abs(p.close - b.other))')} AS mean_diff FROM p FULL OUTER JOIN b ON p.instrument = b.instrument AND p.datetime = b.datetime""")
def parity_report(spark, sf_dir):
    """The panel's close against the day's last purchase, over the keys of both."""
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").cast("string").alias("instrument"), F.to_date("ts").alias("datetime")).agg(F.max_by("value", "ts").alias("other"))
    both = events_panel(spark, sf_dir).join(bought.withColumn("there", F.lit(1)), pn.KEYS, "full_outer")
    gap = F.abs(F.col("close") - F.col("other"))
    return both.agg(F.count("*").alias("n_keys"), F.count_if(F.col("there").isNull()).alias("only_left"), rounded(F.max(gap)).alias("max_diff"), rounded(F.avg(gap)).alias("mean_diff"))


#: Shadows over a tiny range are huge; the engines round such figures apart, so they are compared as they are.
UNROUNDED = ("SHADOW_RATIO", "BODY_RATIO")


def _factor_sql(names: dict[str, str]) -> str:
    return f"WITH {PANEL_SQL}, q AS (SELECT *, lag(close) {TIME} AS prev, close / nullif(lag(close) {TIME}, 0) - 1 AS r1 FROM p) SELECT datetime, instrument, {', '.join(f'{v if k in UNROUNDED else rounded_sql(v)} AS {k}' for k, v in names.items())} FROM q"


def _strict(n: int, x: str, of: str = "close") -> str:
    return f"CASE WHEN count({of}) {rows(n)} >= {n} THEN {x} {rows(n)} END"


_BASIC_SQL = {
    "ROC0": "(close - open) / nullif(open, 0)",
    **{f"ROC{k}": f"close / nullif(lag(close, {k}) {TIME}, 0) - 1" for k in (1, 5, 10, 20)},
    **{f"VRATIO{n}": f"volume / nullif({_strict(n, 'avg(volume)')}, 0)" for n in (5, 10)},
    "VSTD5_RATIO": f"({_strict(5, 'stddev_samp(volume)')}) / nullif({_strict(5, 'avg(volume)')}, 0)",
    "RANGE": "(high - low) / nullif(open, 0)",
    **{f"VOLATILITY{n}": f"({_strict(n, 'stddev_samp(close)')}) / nullif(close, 0)" for n in (5, 10)},
    "RET_VOL5": _strict(5, "stddev_samp(r1)", "r1"),
    **{f"RSV{n}": f"(close - ({_strict(n, 'min(low)')})) / ((({_strict(n, 'max(high)')})) - ({_strict(n, 'min(low)')}) + 1e-12)" for n in (5, 10)},
    "HIGH_RATIO5": f"close / nullif({_strict(5, 'max(high)')}, 0) - 1",
    "LOW_RATIO5": f"close / nullif({_strict(5, 'min(low)')}, 0) - 1",
    "MA_RATIO5_10": f"({_strict(5, 'avg(close)')}) / nullif({_strict(10, 'avg(close)')}, 0) - 1",
    "SHADOW_RATIO": "(high - close) / nullif(close - low + 1e-12, 0)",
    "BODY_RATIO": "(close - open) / nullif(high - low + 1e-12, 0)",
    "MA_RATIO10_20": f"({_strict(10, 'avg(close)')}) / nullif({_strict(20, 'avg(close)')}, 0) - 1",
}


@query(_factor_sql(_BASIC_SQL))
def factors_basic_20(spark, sf_dir):
    f = fs.with_factors(events_panel(spark, sf_dir), fs.basic_20())
    return _out(f, [*pn.KEYS, *UNROUNDED], [n for n in _BASIC_SQL if n not in UNROUNDED])


@query()
def factors_alpha_158(spark, sf_dir):
    w = Windows()
    f = fs.alpha_158(w)
    return _out(fs.with_factors(w.over(events_panel(spark, sf_dir)), f), pn.KEYS, list(f))


@query()
def factors_alpha_windows(spark, sf_dir):
    w = Windows()
    f = fs.alpha_windows(w)
    return _out(fs.with_factors(w.over(events_panel(spark, sf_dir)), f), pn.KEYS, list(f))


HELD_SQL = f"""{SIGNAL_SQL}, l AS (SELECT datetime, instrument, unnest(['body', 'mom', 'vol']) AS portfolio, unnest([body, mom, vol]) AS score FROM s),
h0 AS (SELECT l.*, CASE WHEN volume > 1 THEN open END AS o, CASE WHEN volume % 4 <> 3 THEN close END AS c FROM l JOIN p USING (datetime, instrument)),
h1 AS (SELECT *, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY portfolio, datetime ORDER BY score DESC NULLS LAST, instrument) END AS rk FROM h0),
h2 AS (SELECT *, CASE WHEN rk <= 10 THEN true WHEN rk IS NULL OR rk > 12 THEN false END AS mark FROM h1),
h3 AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY portfolio, instrument ORDER BY datetime
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS wanted FROM h2),
h4 AS (SELECT *, coalesce(last_value(CASE WHEN o > 0 THEN wanted END IGNORE NULLS) OVER t, false) AS held, last_value(CASE WHEN c > 0 THEN c END IGNORE NULLS) OVER t AS cf
    FROM h3 WINDOW t AS (PARTITION BY portfolio, instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h5 AS (SELECT *, CASE WHEN held THEN 0.95e0 / sum(CAST(held AS INT)) OVER (PARTITION BY portfolio, datetime) ELSE 0 END AS weight FROM h4),
h AS (SELECT *, coalesce(lag(weight) OVER t, 0) AS wb, coalesce(lag(held) OVER t, false) AS was, coalesce(cf / nullif(lag(cf) OVER t, 0) - 1, 0) AS dr
    FROM h5 WINDOW t AS (PARTITION BY portfolio, instrument ORDER BY datetime)),
b AS (SELECT datetime AS date, coalesce(avg(r), 0) AS bench FROM (SELECT datetime, close / nullif(lag(close) {TIME}, 0) - 1 AS r FROM p) GROUP BY 1),
d AS (SELECT portfolio, datetime AS date, sum(wb * dr) AS ret, sum(greatest(weight - wb, 0) * 0.0005e0 + greatest(wb - weight, 0) * 0.0015e0) AS cost, sum(abs(weight - wb)) AS turnover FROM h GROUP BY 1, 2),
rep AS (SELECT d.*, bench, ret - bench - cost AS ex, 1e6 * exp(sum(ln(1 + ret - cost)) OVER (PARTITION BY portfolio ORDER BY date)) AS equity FROM d LEFT JOIN b USING (date))"""


def _portfolios(spark, sf_dir):
    """A portfolio for each signal; days of one event have no open, days of 3, 7, 11... events no close."""
    p = events_panel(spark, sf_dir)
    long = long_signals(spark, sf_dir).select("datetime", "instrument", F.col("factor").alias("portfolio"), F.col("value").alias("score"))
    prices = p.select(*pn.KEYS, F.when(F.col("volume") > 1, F.col("open")).alias("open"), F.when(F.col("volume") % 4 != 3, F.col("close")).alias("close"))
    return pf.holdings(long.join(prices, pn.KEYS), topk=10, n_drop=2)


def _portfolio_reports(spark, sf_dir):
    p = events_panel(spark, sf_dir).select(*pn.KEYS, c.ts_pctchange("close").alias("ret"))
    return pf.reports(_portfolios(spark, sf_dir), pf.benchmark_returns(p), capital=1e6, open_cost=0.0005, close_cost=0.0015)


@query(
    f"""WITH {HELD_SQL} SELECT portfolio, date, {rounded_sql('ret')} AS "return", {rounded_sql('bench')} AS bench, {rounded_sql('cost')} AS cost,
{rounded_sql('turnover')} AS turnover, {rounded_sql('ln(equity / 1e6)')} AS log_growth, {rounded_sql('ex')} AS excess_return FROM rep"""
)
def topk_dropout(spark, sf_dir):
    out = _portfolio_reports(spark, sf_dir)
    return _out(out.withColumn("log_growth", F.log(F.col("equity") / 1e6)), ["portfolio", "date"], ["return", "bench", "cost", "turnover", "log_growth", "excess_return"])


@query(f"WITH {HELD_SQL} SELECT portfolio, datetime AS date, instrument, {rounded_sql('weight')} AS weight FROM h WHERE held")
def topk_positions(spark, sf_dir):
    return _out(pf.positions(_portfolios(spark, sf_dir)), ["portfolio", "date", "instrument"], ["weight"])


@query(
    f"""WITH {HELD_SQL}, x AS (SELECT portfolio, date, ex, sum(ex) OVER (PARTITION BY portfolio ORDER BY date) AS path FROM rep),
y AS (SELECT *, greatest(max(path) OVER (PARTITION BY portfolio ORDER BY date), 0) AS peak FROM x),
z AS (SELECT portfolio, avg(ex) AS m, stddev_samp(ex) AS s, least(min(path - peak), 0) AS dd FROM y GROUP BY 1)
SELECT portfolio, {rounded_sql('m * 238')} AS annualized_return, {rounded_sql('CASE WHEN s > 1e-12 THEN m / s ELSE 0 END * sqrt(238)')} AS information_ratio,
{rounded_sql('dd')} AS max_drawdown, {rounded_sql('CASE WHEN abs(dd) > 1e-12 THEN m * 238 / abs(dd) ELSE 0 END')} AS calmar_ratio FROM z"""
)
def portfolio_risk(spark, sf_dir):
    return _out(pf.portfolio_risk(_portfolio_reports(spark, sf_dir)), ["portfolio"], ["annualized_return", "information_ratio", "max_drawdown", "calmar_ratio"])


@query(
    f"""WITH {HELD_SQL}, m AS (
SELECT portfolio, datetime AS date, instrument, CASE WHEN wanted THEN 'skip_buy' ELSE 'skip_sell_keep_position' END AS reason FROM h WHERE o IS NULL AND wanted <> was
UNION ALL SELECT portfolio, datetime, instrument, 'carry_forward_last_close' FROM h WHERE c IS NULL AND held)
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY date, instrument, reason) <= 20"""
)
def missing_prices(spark, sf_dir):
    return pf.missing_prices(_portfolios(spark, sf_dir))[1]


@query(f"WITH {PANEL_SQL}, r AS (SELECT datetime, close / nullif(lag(close) {TIME}, 0) - 1 AS r FROM p) SELECT datetime AS date, {rounded_sql('coalesce(avg(r), 0)')} AS bench FROM r GROUP BY 1")
def benchmark_returns(spark, sf_dir):
    p = events_panel(spark, sf_dir).select(*pn.KEYS, c.ts_pctchange("close").alias("ret"))
    return _out(pf.benchmark_returns(p), ["date"], ["bench"])


_WEIGHT_SQL = """f AS (SELECT p_brand, p_partkey AS factor, p_retailprice / 20 AS health_score, p_size / 50.0e0 AS dw, CASE p_partkey % 3 WHEN 0 THEN 0.5e0 WHEN 1 THEN 0.01e0 END AS cap FROM part), s AS (SELECT *, exp(health_score / 10 - max(health_score / 10) OVER b) AS e FROM f WINDOW b AS (PARTITION BY p_brand)),
k AS (SELECT *, least(e / sum(e) OVER b * dw * greatest(0.25, 1 - least(1, greatest(p_partkey_r, 0.3e0))), coalesce(cap, 1)) AS v FROM (SELECT *, 0.4e0 AS p_partkey_r FROM s) WINDOW b AS (PARTITION BY p_brand)), fw AS (SELECT factor, CASE WHEN sum(v) OVER b = 0 THEN 0 ELSE v / sum(v) OVER b END AS weight FROM k WINDOW b AS (PARTITION BY p_brand))"""


@query(f"WITH {_WEIGHT_SQL} SELECT factor, {rounded_sql('weight')} AS weight FROM fw")
def factor_weights(spark, sf_dir):
    f = table(spark, sf_dir, "part").selectExpr("p_brand", "p_partkey AS factor", "p_retailprice / 20 AS health_score", "p_size / 50.0e0 AS dynamic_weight", "CASE p_partkey % 3 WHEN 0 THEN 0.5e0 WHEN 1 THEN 0.01e0 END AS tier_cap")
    return _out(pf.factor_weights(f, ["p_brand"], pf.regime_scale(F.lit(0.4), F.lit(0.3))), ["factor"], ["weight"])


@query(f"""WITH {SIGNAL_SQL}, sc AS (SELECT datetime, instrument, 0.5 * coalesce(body, 0) + 0.3 * coalesce(mom, 0) + 0.2 * coalesce(vol, 0) AS x FROM s), ce AS (SELECT *, x - avg(x) OVER d AS y FROM sc WINDOW d AS (PARTITION BY datetime)), w AS (SELECT *, coalesce(y * 0.05 / nullif(max(abs(y)) OVER d, 0), 0) AS v FROM ce WINDOW d AS (PARTITION BY datetime))
SELECT datetime, instrument, {rounded_sql('v - avg(v) OVER (PARTITION BY datetime)')} AS weight FROM w""")
def stock_weights(spark, sf_dir):
    weights = spark.sql("SELECT * FROM VALUES ('body', 0.5D), ('mom', 0.3D), ('vol', 0.2D) AS t(factor, weight)")
    return _out(pf.stock_weights(long_signals(spark, sf_dir), weights), pn.KEYS, ["weight"])


@query(f"""WITH f AS (SELECT p_partkey AS factor, p_brand AS cluster_id, p_retailprice / 25 AS h, p_size % 4 AS t FROM part WHERE p_size > 10), q AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY h DESC, factor) <= 2), d AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders)
SELECT factor, cluster_id, {', '.join(f"CASE WHEN t = {i} THEN 1.0e0 ELSE 0.0e0 END AS tier_{x}" for i, x in enumerate('abcd'))}, {rounded_sql('h / 100')} AS health, date FROM q CROSS JOIN d""")
def model_inputs(spark, sf_dir):
    f = table(spark, sf_dir, "part").selectExpr("p_partkey AS factor", "p_brand AS cluster_id", "p_retailprice / 25 AS health_score", "element_at(array('A', 'B', 'C', 'D'), p_size % 4 + 1) AS tier", "p_size > 10 AS model_eligible")
    months = table(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).distinct()
    return _out(pf.model_inputs(f, months, 2), ["factor", "cluster_id", "tier_a", "tier_b", "tier_c", "tier_d", "date"], ["health"])


@query(f"WITH {PANEL_SQL}, n AS (SELECT datetime, instrument, CAST(close AS DOUBLE) AS v FROM p) SELECT instrument, {rounded_sql('avg(v)')} AS mean, {rounded_sql('stddev_pop(v)')} AS sd, {rounded_sql('min(v)')} AS worst, {rounded_sql('avg(CASE WHEN v > 50 THEN 1.0 ELSE 0.0 END)')} AS win_rate, count(*) >= 25 AND min(v) > 0 AS passed FROM n GROUP BY 1")
def period_aggregation(spark, sf_dir):
    g = events_panel(spark, sf_dir).groupBy("instrument").agg(F.avg("close").alias("mean"), F.stddev_pop("close").alias("sd"), F.min("close").alias("worst"), F.avg((F.col("close") > 50).cast("double")).alias("win_rate"), ((F.count("*") >= 25) & (F.min("close") > 0)).alias("passed"))
    return _out(g, ["instrument", "passed"], ["mean", "sd", "worst", "win_rate"])
