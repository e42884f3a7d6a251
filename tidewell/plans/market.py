"""Queries of the market sources, sinks and panel joins, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as pn
from ..sources import events_panel, instruments_file, market, series, stacked, table
from ..storage import scratch
from .analytics import SIGNAL_SQL, TIME, _out, query, signals
from .language import PANEL_SQL, rounded_sql


def _rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{rounded_sql(n, digits)} AS {n}" for n in names)


@query(f"SELECT o_orderkey, o_custkey, {_rounded('o_totalprice', digits=2)} FROM orders")
def csv_scan(spark, sf_dir):
    path = f"{scratch(spark, 'orders')}.csv"
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").write.csv(path, header=True)
    return _out(market.read_file(spark, path, "o_orderkey long, o_custkey long, o_totalprice double"), ["o_orderkey", "o_custkey"], ["o_totalprice"], 2)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
def multi_file_scan(spark, sf_dir):
    root = scratch(spark, "canonical")
    o = table(spark, sf_dir, "orders")
    for k in range(3):
        o.where(F.col("o_orderkey") % 3 == k).write.parquet(f"{root}/part{k}")
    return market.scan(spark, [f"{root}/part{k}" for k in range(3)], ["o_orderkey", "o_orderdate"], [("o_totalprice", "between", (100000, 200000))])


_RAW = "CAST(user_id AS {0}) || '.' || CASE WHEN user_id % 3 = 0 THEN 'SH' WHEN user_id % 3 = 1 THEN 'SZ' ELSE 'BJ' END"
MARKET_SQL = f"""rw AS (SELECT {_RAW.format('VARCHAR')} AS ts_code, CAST(ts AS DATE) AS trade_date, min(value) AS low, max(value) AS high, avg(value) AS open, median(value) AS close, CAST(count(*) - 1 AS DOUBLE) AS vol, sum(value) AS amount FROM events GROUP BY 1, 2)"""


def _raw(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts_code", F.expr(_RAW.format("STRING")))
    day = e.groupBy("ts_code", F.to_date("ts").alias("trade_date"))
    return day.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("open"), F.median("value").alias("close"), (F.count("*") - 1).cast("double").alias("vol"), F.sum("value").alias("amount"))


@query(f"""WITH {MARKET_SQL} SELECT trade_date AS datetime, ts_code AS instrument, {_rounded('open', 'high', 'low', 'close')}, {rounded_sql('vol')} AS volume, {rounded_sql('CASE WHEN vol > 0 THEN amount * 10 / vol ELSE close END')} AS vwap, {rounded_sql('coalesce(close / nullif(lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date), 0) - 1, 0)')} AS ret FROM rw""")
def market_frame(spark, sf_dir):
    return _out(market.market_frame(_raw(spark, sf_dir), 10.0), pn.KEYS, ["open", "high", "low", "close", "volume", "vwap", "ret"])


@query(f"""WITH {MARKET_SQL} SELECT trade_date AS datetime, ts_code AS instrument, {rounded_sql('coalesce(CASE WHEN vol > 3 THEN vol / 10 END, open / 100, 0)')} AS ret FROM rw WHERE ts_code LIKE '%.SH' OR ts_code LIKE '%.SZ'""")
def return_precedence(spark, sf_dir):
    raw = _raw(spark, sf_dir).withColumns({"$return": F.when(F.col("vol") > 3, F.col("vol") / 10), "pct_chg": F.col("open")})
    return _out(market.in_markets(market.market_frame(raw), include=["SH", "SZ"]), pn.KEYS, ["ret"])


@query(f"""WITH {MARKET_SQL} SELECT trade_date, ts_code, {rounded_sql('open * 2')} AS open, {rounded_sql('close * 2')} AS close FROM rw""")
def adjusted_prices(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return _out(market.adjusted(raw.withColumns({f"{c}_hfq": F.col(c) * 2 for c in market.PRICES}), "hfq"), ["trade_date", "ts_code"], ["open", "close"])


@query("""WITH i AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 4 = 0 THEN '.BJ' ELSE '.SH' END AS instrument, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS name, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(c_custkey % 200 AS INTEGER) END AS list_date FROM customer)
SELECT instrument FROM i WHERE instrument NOT LIKE '%.BJ' AND NOT coalesce(contains(upper(name), 'ST'), false) AND coalesce(DATE '1995-06-01' - list_date >= 60, true)""")
def stock_filter(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 4 = 0 THEN '.BJ' ELSE '.SH' END AS instrument", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS name", "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE date_add(DATE '1995-01-01', CAST(c_custkey % 200 AS INT)) END AS list_date")
    return market.stock_filter(c, "1995-06-01", True, 60, ["BJ"]).select("instrument")


@query(f"""WITH {SIGNAL_SQL} SELECT s.datetime, s.instrument, {_rounded('body', 'mom', 'close')} FROM s JOIN p ON p.datetime = s.datetime AND p.instrument = s.instrument""")
def feature_join(spark, sf_dir):
    a = market.factor_frame(signals(spark, sf_dir), ["body"])
    b = market.factor_frame(signals(spark, sf_dir), ["mom"])
    c = market.factor_frame(events_panel(spark, sf_dir), ["close"])
    return _out(market.joined_features([a, b, c]), pn.KEYS, ["body", "mom", "close"])


@query("SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'valid' ELSE 'test' END AS segment FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1997-11-01'")
def segment_rows(spark, sf_dir):
    bounds = {"train": ("1995-03-01", "1995-12-31"), "valid": ("1996-01-01", "1996-12-31"), "test": ("1997-01-01", "1997-10-31")}
    return market.segments(table(spark, sf_dir, "orders"), bounds, "o_orderdate").select("o_orderkey", "segment")


@query(f"""WITH {SIGNAL_SQL} SELECT datetime, instrument, {rounded_sql('CASE WHEN mom IS NOT NULL THEN CASE WHEN count(mom) OVER d = 1 THEN 0 ELSE (rank() OVER (PARTITION BY datetime ORDER BY mom ASC NULLS LAST) + (count(*) OVER (PARTITION BY datetime, mom) - 1) / 2.0) / count(mom) OVER d - 0.5 END END')} AS r FROM s WINDOW d AS (PARTITION BY datetime)""")
def centred_rank(spark, sf_dir):
    return _out(signals(spark, sf_dir).select(*pn.KEYS, market.centred_rank(F.col("mom")).alias("r")), pn.KEYS, ["r"])


@query(f"WITH {PANEL_SQL} SELECT datetime, instrument, {_rounded('close', 'volume')}, 8 AS n_columns FROM p")
def cached_frame(spark, sf_dir):
    """The panel, written under the name of its specification, found again and read back."""
    root, spec = scratch(spark, "frames"), {"panel": "events", "version": 2}
    market.cached_frame(spark, root, spec, lambda: events_panel(spark, sf_dir))
    again = market.cached_frame(spark, root, spec, lambda: events_panel(spark, sf_dir).limit(0))
    names = market.frame_columns(spark, f"{root}/{market.identity(spec)}")
    return _out(again, pn.KEYS, ["close", "volume"]).withColumn("n_columns", F.lit(len(names)))


@query("""WITH c AS (SELECT table_name AS source, column_name AS field, data_type FROM information_schema.columns WHERE table_name IN ('orders', 'customer', 'part', 'events', 'lineitem'))
SELECT source, field, CASE WHEN regexp_matches(field, '(^|_)(key|id)$|key$') THEN 'key' WHEN regexp_matches(field, '(^|_)(date|ts|time)|date$') THEN 'date' WHEN regexp_matches(field, 'price|acctbal|amount') THEN 'price' WHEN regexp_matches(field, 'flag|status|is_') THEN 'flag' WHEN data_type IN ('INTEGER', 'BIGINT', 'DOUBLE', 'FLOAT') THEN 'measure' ELSE 'label' END AS role FROM c""")
def field_inventory(spark, sf_dir):
    names = ("orders", "customer", "part", "events", "lineitem")
    return market.field_inventory(spark, {n: table(spark, sf_dir, n) for n in names}).select("source", "field", "role")


@query("SELECT 'orders' AS source, CAST(min(o_orderdate) AS DATE) AS available_from FROM orders UNION ALL SELECT 'lineitem', CAST(min(l_shipdate) AS DATE) FROM lineitem UNION ALL SELECT 'events', CAST(min(ts) AS DATE) FROM events")
def available_from(spark, sf_dir):
    return market.available_from({n: (table(spark, sf_dir, n), d) for n, d in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))})


@query("""SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier', 'index_daily']) AS name, unnest(['new', 'new', 'new', 'new', 'new', 'known', 'new', 'new', 'new', 'known', 'new', 'new', 'new', 'new', 'gone']) AS status""")
def capabilities(spark, sf_dir):
    known = spark.sql("SELECT * FROM VALUES ('orders', 'a'), ('events', 'b'), ('index_daily', 'c') AS t(name, path)")
    return market.capabilities(spark, sf_dir, known).select("name", "status")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS datetime, o_custkey AS instrument FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus <> 'F' AND false)")
def resolved_universe(spark, sf_dir):
    u = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("trade_date"), F.col("o_custkey").alias("instrument"), F.when(F.col("o_orderstatus") == "F", True).alias("eligible"))
    return market.universe(u)


@query("SELECT p_partkey AS factor_id, p_name AS factor_expression, p_brand AS status FROM part")
def json_library(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    one = F.struct(F.col("p_name").alias("factor_expression"), F.col("p_brand").alias("status"))
    documents = p.select(F.to_json(F.struct(F.create_map(F.col("p_partkey").cast("string"), one).alias("factors"))).alias("value"))
    return market.library_rows(documents).select(F.col("factor_id").cast("long").alias("factor_id"), "factor_expression", "status")


@query(f"""WITH o AS (SELECT p_partkey AS factor_id, p_name || ' ' || p_size AS expression FROM part WHERE p_size < 5), c AS (SELECT p_partkey AS factor_id, p_name || ' ' || (p_size % 10) AS expression, p_retailprice AS q FROM part WHERE p_size >= 5),
b AS (SELECT * FROM c WHERE q >= 1000 AND expression NOT IN (SELECT expression FROM o) ORDER BY q DESC, factor_id LIMIT 40) SELECT factor_id, expression, 'official' AS origin FROM o UNION ALL SELECT factor_id, expression, 'custom' FROM b""")
def combined_factors(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    official = p.where("p_size < 5").selectExpr("p_partkey AS factor_id", "p_name || ' ' || p_size AS expression")
    custom = p.where("p_size >= 5").selectExpr("p_partkey AS factor_id", "p_name || ' ' || (p_size % 10) AS expression", "p_retailprice AS quality")
    return market.combined_factors(official, custom, 1000, 40)


@query(f"""WITH {SIGNAL_SQL}, l AS (SELECT strftime(datetime, '%Y%m%d') AS trade_date, instrument, unnest(['body', 'mom']) AS factor_id, unnest([body, mom]) AS v FROM s) SELECT trade_date, instrument, factor_id, {rounded_sql('v')} AS factor_value FROM l WHERE v IS NOT NULL""")
def published_factors(spark, sf_dir):
    s = signals(spark, sf_dir)
    twice = s.unionByName(s.where("mom > 0"))  # repeated rows count once
    return _out(market.publish(twice, ["body", "mom"], scratch(spark, "published")), ["trade_date", "instrument", "factor_id"], ["factor_value"])


@query(f"""WITH r AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 1e6 - avg(o_totalprice / 2) / 1e6 - 0.001 AS e FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, date, {rounded_sql('e')} AS daily_excess_return, {rounded_sql('sum(e) OVER (PARTITION BY o_orderpriority ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS cumulative_excess_return FROM r""")
def cumulative_excess(spark, sf_dir):
    r = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 1e6).alias("return"), (F.avg(F.col("o_totalprice") / 2) / 1e6).alias("bench"), F.lit(0.001).alias("cost"))
    return _out(market.cumulative_excess(r, ["o_orderpriority"]), ["o_orderpriority", "date"], ["daily_excess_return", "cumulative_excess_return"])


@query("""SELECT 1 AS line_no, '# Nations' AS line UNION ALL SELECT 2, '| n_nationkey | n_name |' UNION ALL SELECT 3, '|---|---|' UNION ALL SELECT CAST(row_number() OVER (ORDER BY n_nationkey) + 3 AS INTEGER), '| ' || n_nationkey || ' | ' || n_name || ' |' FROM nation""")
def markdown_report(spark, sf_dir):
    return market.markdown_lines(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "Nations", ["n_nationkey"])


@query(f"WITH {SIGNAL_SQL} SELECT datetime, instrument, {rounded_sql('body')} AS feature_body, {rounded_sql('mom')} AS feature_mom FROM s")
def feature_columns(spark, sf_dir):
    f = market.feature_columns(signals(spark, sf_dir).select(*pn.KEYS, "body", "mom"))
    return _out(f, pn.KEYS, ["feature_body", "feature_mom"])


@query(f"""WITH m AS (SELECT p_brand, avg(p_retailprice) AS mean, max(CAST(p_size AS DOUBLE)) AS top, NULL AS ratio FROM part GROUP BY 1) SELECT p_brand, metric, {_rounded('value')} FROM (SELECT p_brand, unnest(['mean', 'top', 'ratio']) AS metric, unnest([mean, top, ratio]) AS value FROM m)""")
def metric_rows(spark, sf_dir):
    m = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean"), F.max(F.col("p_size").cast("double")).alias("top"), F.lit(float("inf")).alias("ratio"))
    return _out(market.metric_rows(m, ["mean", "top", "ratio"], ["p_brand"]), ["p_brand", "metric"], ["value"])


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(lower(p_name), 'red|blue') THEN 'colour' END, CASE WHEN regexp_matches(lower(p_name), 'gear|bolt') THEN 'metal' END], lambda x: x IS NOT NULL), ',') AS tags, CASE WHEN p_type LIKE 'S%' THEN 'plain' WHEN p_type LIKE 'PROMO%' THEN 'sale' ELSE 'other' END AS bucket FROM part")
def tags_and_buckets(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(market.tags(F.col("p_name"), {"colour": "red|blue", "metal": "gear|bolt"}), ",").alias("tags"), market.bucket(F.col("p_type"), {"S": "plain", "PROMO": "sale"}).alias("bucket"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS datetime FROM orders WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5")
def trading_calendar(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select("o_orderdate", F.when(F.dayofweek("o_orderdate").between(2, 6), 1).otherwise(0).alias("is_open"))
    return pn.trading_calendar(days, "o_orderdate", "is_open")


@query(f"""WITH {PANEL_SQL}, b AS (SELECT CAST(user_id AS VARCHAR) AS instrument, CAST(ts AS DATE) AS datetime, sum(value) AS bought FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT p.datetime, p.instrument, {rounded_sql('coalesce(bought, 0)')} AS bought FROM p LEFT JOIN b USING (datetime, instrument)""")
def daily_batch(spark, sf_dir):
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").cast("string").alias("instrument"), F.to_date("ts").alias("datetime")).agg(F.sum("value").alias("bought"))
    return _out(pn.daily_batch(events_panel(spark, sf_dir), bought, ["bought"], "zero"), pn.KEYS, ["bought"])


@query(f"""WITH {PANEL_SQL}, b AS (SELECT CAST(user_id AS VARCHAR) AS instrument, CAST(ts AS DATE) AS d, sum(value) AS total, avg(value) AS mean, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT p.datetime, p.instrument, {_rounded('total', 'mean')}, n FROM p ASOF LEFT JOIN b ON p.instrument = b.instrument AND p.datetime >= b.d""")
def as_of_aggregate(spark, sf_dir):
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("instrument"), F.to_date("ts").alias("d"), "value")
    aggregates = {"total": F.sum("value"), "mean": F.avg("value"), "n": F.count("*")}
    return _out(pn.as_of_aggregate(events_panel(spark, sf_dir), bought, "instrument", "datetime", "d", aggregates), [*pn.KEYS, "n"], ["total", "mean"])


@query(f"""WITH {PANEL_SQL}, w AS (SELECT datetime, sum(close * volume) / sum(volume) AS weighted_close FROM p GROUP BY 1) SELECT datetime, instrument, {_rounded('weighted_close')} FROM p JOIN w USING (datetime)""")
def weighted_context(spark, sf_dir):
    p = events_panel(spark, sf_dir)
    out = pn.weighted_context(p.select(*pn.KEYS), p.select(*pn.KEYS, "close"), p.select(*pn.KEYS, F.col("volume").alias("weight")), ["close"])
    return _out(out, pn.KEYS, ["weighted_close"])


@query(f"""WITH {PANEL_SQL}, e AS (SELECT CAST(user_id AS VARCHAR) AS instrument, CAST(ts AS DATE) AS datetime, event_type AS t FROM events)
SELECT datetime, instrument, dayofweek(datetime) BETWEEN 1 AND 5 AND NOT EXISTS (SELECT 1 FROM e WHERE e.instrument = p.instrument AND e.datetime = p.datetime AND t = 'error') AND NOT EXISTS (SELECT 1 FROM e WHERE e.instrument = p.instrument AND e.datetime = p.datetime AND t = 'signup') AS is_tradable FROM p""")
def tradable_mask(spark, sf_dir):
    p, e = events_panel(spark, sf_dir), table(spark, sf_dir, "events")
    days = e.select(F.col("ts").alias("cal_date"), F.when(F.dayofweek("ts").between(2, 6), "1").otherwise("0").alias("is_open"))
    keys = [F.col("ts").alias("trade_date"), F.col("user_id").alias("ts_code")]
    out = pn.tradable(p.select(*pn.KEYS), days, e.where("event_type = 'error'").select(*keys), e.select(*keys, (F.col("event_type") == "signup").cast("int").alias("is_st")))
    return out.select(*pn.KEYS, "is_tradable")


INDEX_SQL = """iw AS (SELECT o_orderpriority AS index_code, CAST(o_custkey AS VARCHAR) || CASE WHEN o_custkey % 3 = 0 THEN '.BJ' ELSE '.SH' END AS con_code, date_trunc('month', o_orderdate) AS trade_date FROM orders),
im AS (SELECT DISTINCT index_code, con_code, trade_date FROM iw WHERE index_code IN ('1-URGENT', '2-HIGH') AND trade_date = (SELECT max(trade_date) FROM iw b WHERE b.index_code = iw.index_code AND b.trade_date <= TIMESTAMP '1996-06-15'))"""


def _weights(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderpriority AS index_code", "CAST(o_custkey AS STRING) || CASE WHEN o_custkey % 3 = 0 THEN '.BJ' ELSE '.SH' END AS con_code", "date_trunc('month', o_orderdate) AS trade_date")


@query(f"WITH {INDEX_SQL} SELECT * FROM im")
def index_members(spark, sf_dir):
    return pn.index_members(_weights(spark, sf_dir), "1996-06-15", ["1-URGENT", "2-HIGH"])


@query(f"WITH {INDEX_SQL} SELECT DISTINCT con_code AS instrument FROM im WHERE con_code NOT LIKE '%.BJ'")
def index_universe(spark, sf_dir):
    return pn.index_universe(_weights(spark, sf_dir), "1996-06-15", ["1-URGENT", "2-HIGH"], ["BJ"])


@query(f"""WITH {PANEL_SQL} SELECT datetime, instrument, {_rounded('close', 'vwap')} FROM p UNION ALL SELECT datetime, 'INDEX', {rounded_sql('avg(close)')}, NULL FROM p GROUP BY 1""")
def with_benchmark(spark, sf_dir):
    p = events_panel(spark, sf_dir)
    bench = p.groupBy("datetime").agg(F.lit("INDEX").alias("instrument"), F.avg("close").alias("close"))
    return _out(market.with_benchmark(p, bench), pn.KEYS, ["close", "vwap"])


@query("SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS instrument FROM supplier WHERE s_suppkey % 2 = 0")
def instruments_list(spark, sf_dir):
    path = scratch(spark, "instruments")
    lines = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("  "), F.col("s_suppkey").cast("string"), F.lit("\t1990-01-01"))).otherwise(F.concat(F.lit("# "), F.col("s_suppkey").cast("string")))
    table(spark, sf_dir, "supplier").select(lines.alias("value")).write.text(path)
    return instruments_file(spark, path)


@query("SELECT n_nationkey AS k, n_name AS name, CAST(NULL AS VARCHAR) AS region FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def stacked_frames(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return stacked([n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), r.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("region"))])


@query("""WITH f AS (SELECT o_orderkey % 50 AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS v FROM orders) SELECT count(*) AS untradable FROM f WHERE v IS NULL AND k > 0""")
def untradable_rows(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("volume"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey").cast("double")).alias("close"))
    return pn.untradable_prices(f, ["close"]).agg(F.count("*").alias("untradable"))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) > (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) - 90")
def last_days(spark, sf_dir):
    return pn.last_days(table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("datetime")), 90).select("o_orderkey")


@query(f"""WITH {PANEL_SQL} SELECT datetime, instrument, round(CAST(CAST(open AS FLOAT) AS DOUBLE), 4) AS open, round(CAST(CAST(close AS FLOAT) AS DOUBLE), 4) AS close, volume, 0.0 AS ret
FROM p WHERE datetime >= DATE '2024-01-10' AND datetime < DATE '2024-01-25'""")
def binary_series(spark, sf_dir):
    """The events panel written as a folder of binary series and read back, two weeks of it by their place in the files."""
    root = scratch(spark, "series")
    series.write_series(events_panel(spark, sf_dir), root)
    days = series.read_series(spark, root, start="2024-01-10", end="2024-01-24")
    return days.select("datetime", "instrument", F.round("open", 4).alias("open"), F.round("close", 4).alias("close"), "volume", "ret")
