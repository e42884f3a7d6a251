"""Queries of the similarity operators, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import sets as st
from ..operators import signal as sg
from ..operators import similarity as sm
from ..sources import table
from .analytics import _out, query
from .language import rounded, rounded_sql

_EXPR = "CASE p_partkey % 4 WHEN 0 THEN 'RANK(TS_MEAN($close, ' || CAST(p_size AS {0}) || ')) / $open' WHEN 1 THEN 'rank( ts_mean($close,' || CAST(p_size % 7 AS {0}) || ')) * DELAY($volume, 1)' WHEN 2 THEN 'DELAY($close, -' || CAST(p_size % 3 AS {0}) || ') / $close' ELSE 'ABS(ABS($' || replace(lower(p_name), ' ', '_') || ')) * STD($close, 1) / eps_ttm' END"
EXPR_SQL = f"ex AS (SELECT p_partkey AS id, {_EXPR.format('VARCHAR')} AS expression, p_type AS description FROM part)"
_NORM = "regexp_replace(lower({0}), '\\s+', '', 'g')"
_TOKENS = "list_distinct(regexp_extract_all(" + _NORM + ", '\\$[a-z_][a-z0-9_]*|[a-z_][a-z0-9_]*|[0-9]+(?:\\.[0-9]+)?'))"
_SKELETON = "regexp_replace(" + _NORM + ", '[0-9]+(?:\\.[0-9]+)?', 'N', 'g')"


def _expressions(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_EXPR.format('STRING')} AS expression", "p_type AS description")


def _jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CAST({both} AS DOUBLE) / nullif(len({a}) + len({b}) - {both}, 0)"


@query(f"""WITH {EXPR_SQL}, n AS (SELECT id, {_NORM.format('expression')} AS n, {_SKELETON.format('expression')} AS k, {_TOKENS.format('expression')} AS t FROM ex)
SELECT a.id AS a, b.id AS b, {rounded_sql(f"CASE WHEN a.n = b.n THEN 1 WHEN a.k = b.k THEN greatest({_jaccard_sql('a.t', 'b.t')}, 0.9) ELSE {_jaccard_sql('a.t', 'b.t')} END")} AS similarity FROM n a JOIN n b ON b.id IN (a.id + 1, a.id + 4, a.id + 28)""")
def expression_similarity(spark, sf_dir):
    e = _expressions(spark, sf_dir)
    a = e.select(F.col("id").alias("a"), F.col("expression").alias("x"), F.explode(F.array(F.col("id") + 1, F.col("id") + 4, F.col("id") + 28)).alias("b"))
    both = a.join(e.select(F.col("id").alias("b"), F.col("expression").alias("y")), "b")
    return both.select("a", "b", rounded(sm.expression_similarity(F.col("x"), F.col("y"))).alias("similarity"))


@query(f"""WITH {EXPR_SQL}, q AS (SELECT id, {_TOKENS.format('expression')} AS t FROM ex WHERE id % 50 = 0), p AS (SELECT id, {_TOKENS.format('expression')} AS t FROM ex)
SELECT q.id AS q, p.id AS p, {rounded_sql(_jaccard_sql('q.t', 'p.t'))} AS jaccard FROM q JOIN p ON q.id <> p.id AND len(list_intersect(q.t, p.t)) > 0""")
def shared_token_search(spark, sf_dir):
    e = _expressions(spark, sf_dir)
    return sm.shared_tokens(e.where("id % 50 = 0"), e, value=rounded)


@query(f"""WITH {EXPR_SQL}, n AS (SELECT id, {_NORM.format('expression')} AS n, {_SKELETON.format('expression')} AS k, {_TOKENS.format('expression')} AS t, {_TOKENS.format('description')} AS d FROM ex), q AS (SELECT * FROM n WHERE id % 50 = 0),
c AS (SELECT q.id AS q, p.id AS p, q.n = p.n AS same, q.k = p.k AS k, {_jaccard_sql('q.t', 'p.t')} AS j, {_jaccard_sql('q.d', 'p.d')} AS d FROM q JOIN n p ON q.id <> p.id AND len(list_intersect(q.t, p.t)) > 0 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY {_jaccard_sql('q.t', 'p.t')} DESC, p.id) <= 20),
s AS (SELECT q, p, 0.7 * (CASE WHEN same THEN 1 WHEN k THEN greatest(j, 0.9) ELSE j END) + 0.3 * coalesce(d, 0) AS s FROM c)
SELECT q, p AS nearest_id, {rounded_sql('s')} AS similarity, s >= 0.85 AS redundant FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, p) = 1""")
def library_check(spark, sf_dir):
    e = _expressions(spark, sf_dir)
    return _out(sm.library_check(e.where("id % 50 = 0"), e), ["q", "nearest_id", "redundant"], ["similarity"])


@query(f"""WITH s AS (SELECT p_partkey AS id, p_size / 50.0e0 AS a, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice / 2000.0e0 END AS b FROM part), t AS (SELECT id, a, b, (0.6 * a + 0.4 * coalesce(b, 0)) / (0.6 + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END) AS w FROM s)
SELECT id, {rounded_sql('w')} AS weighted, w >= 0.5 AS redundant, {rounded_sql('greatest(a, coalesce(b, a))')} AS vetoed, a >= 0.95 OR coalesce(b >= 0.9, false) AS veto FROM t""")
def ensemble_similarity(spark, sf_dir):
    s = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size / 50.0e0 AS a", "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice / 2000.0e0 END AS b")
    cols = {"a": F.col("a"), "b": F.col("b")}
    w, redundant = sm.ensemble(cols, {"a": 0.6, "b": 0.4}, 0.5)
    v, veto = sm.ensemble(cols, {}, 0.95, "veto", {"b": 0.9})
    return s.select("id", rounded(w).alias("weighted"), redundant.alias("redundant"), rounded(v).alias("vetoed"), veto.alias("veto"))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({0}[i] AS DOUBLE) * {1}[i]))"
_COSINE = f"{_DOT.format('embedding', 'q')} / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('q', 'q')}))"


@query(f"""WITH c AS (SELECT vec_id, {_COSINE} AS c FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) WHERE label % 2 = 1) SELECT vec_id, {rounded_sql('c')} AS cosine FROM c WHERE c >= 0.05 ORDER BY c DESC, vec_id LIMIT 10""")
def vector_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    vector = e.where("vec_id = 7").first().embedding  # the one vector that is asked for
    return _out(sm.vector_search(e, vector, 10, 0.05, F.col("label") % 2 == 1), ["vec_id"], ["cosine"])


_WORDS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> ''))"


@query(f"""WITH t AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS low, {_WORDS.format("p_name || ' ' || p_type")} AS w, ['small', 'red', 'gear'] AS q FROM part WHERE p_size > 5), s AS (SELECT id, round(CASE WHEN contains(low, 'small') OR contains(low, 'red') OR contains(low, 'gear') THEN greatest({_jaccard_sql('w', 'q')}, 0.3) ELSE {_jaccard_sql('w', 'q')} END, 4) AS score FROM t)
SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 40""")
def word_search(spark, sf_dir):
    pool = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name || ' ' || p_type AS text", "p_size")
    return sm.word_search(pool, "small red gear", 40, F.col("p_size") > 5)


@query(f"""WITH c AS (SELECT vec_id AS id, label, {_COSINE} AS c FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 3)) SELECT id, {rounded_sql('c')} AS score, label FROM c WHERE c >= 0 ORDER BY c DESC, id LIMIT 8""")
def few_shot_examples(spark, sf_dir):
    pool = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    vector = pool.where("id = 3").first().embedding
    return _out(sm.few_shot(pool, "", vector, 8, ["label"]), ["id", "label"], ["score"])


EDGE_SQL = "e AS (SELECT DISTINCT s_suppkey AS a, 1000000 + s_nationkey AS b FROM supplier UNION SELECT DISTINCT c_custkey + 2000000, 1000000 + c_nationkey FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


def _edges(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS a", "1000000L + s_nationkey AS b")
    return s.unionByName(table(spark, sf_dir, "customer").selectExpr("c_custkey + 2000000L AS a", "1000000L + c_nationkey AS b"))


@query(f"""WITH {EDGE_SQL}, n1 AS (SELECT DISTINCT y.b AS node FROM u x JOIN u y ON x.b = y.a WHERE x.a = 1 UNION SELECT b FROM u WHERE a = 1), n2 AS (SELECT DISTINCT y.b AS node FROM u x JOIN u y ON x.b = y.a WHERE x.a = (SELECT min(c_custkey) + 2000000 FROM customer WHERE c_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1)) UNION SELECT b FROM u WHERE a = (SELECT min(c_custkey) + 2000000 FROM customer WHERE c_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1)))
SELECT node FROM n1 INTERSECT SELECT node FROM n2 EXCEPT SELECT 1 EXCEPT SELECT min(c_custkey) + 2000000 FROM customer WHERE c_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1)""")
def graph_intersection(spark, sf_dir):
    nation = table(spark, sf_dir, "supplier").where("s_suppkey = 1").first().s_nationkey
    other = table(spark, sf_dir, "customer").where(F.col("c_nationkey") == nation).agg(F.min("c_custkey")).first()[0] + 2000000
    return gr.neighbourhoods(_edges(spark, sf_dir), [1, other], 2)


@query(f"""WITH RECURSIVE {EDGE_SQL}, l AS (SELECT a AS node, CASE WHEN a < 1000000 THEN 'supplier' ELSE 'customer' END AS label FROM e UNION SELECT b, CASE WHEN b % 2 = 0 THEN 'even' ELSE 'odd' END FROM e),
h AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hop, false AS stop UNION SELECT u.b, hop + 1, l.label = 'customer' FROM h JOIN u ON u.a = h.node AND NOT stop JOIN l ON l.node = u.b AND l.label IN ('supplier', 'even', 'odd', 'customer') WHERE hop < 3) SELECT node, min(hop) AS hop FROM h GROUP BY 1""")
def labelled_hops(spark, sf_dir):
    e = _edges(spark, sf_dir)
    nodes = e.selectExpr("a AS node", "CASE WHEN a < 1000000 THEN 'supplier' ELSE 'customer' END AS label").unionByName(e.selectExpr("b AS node", "CASE WHEN b % 2 = 0 THEN 'even' ELSE 'odd' END AS label")).distinct()
    return gr.labelled_hops(e, nodes, spark.range(1, 2).withColumnRenamed("id", "node"), 3, ["supplier", "even", "odd"], ["customer"])


def _held_sql(patterns: dict[str, str]) -> str:
    def quoted(p: str) -> str:
        return "(?i)" + p.replace("'", "''")

    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(expression, '{quoted(p)}') THEN '{n}' END" for n, p in patterns.items()) + "], lambda x: x IS NOT NULL), ',')"


@query(f"WITH {EXPR_SQL} SELECT id, {_held_sql(sm.LOOK_AHEAD)} AS look_ahead, {_held_sql(sm.UNTIMED_FIELDS)} AS untimed_fields, {_held_sql(sm.ANTI_PATTERNS)} AS anti_patterns FROM ex")
def expression_diagnostics(spark, sf_dir):
    return sm.diagnosed(_expressions(spark, sf_dir)).select("id", "look_ahead", "untimed_fields", "anti_patterns")


@query(f"""WITH {EXPR_SQL}, w AS (SELECT id, expression, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(expression, '\\b[A-Z][A-Z_]*\\s*\\([^)]*,\\s*([0-9]+)\\s*\\)', 1), lambda x: CAST(x AS INTEGER)), lambda x: x > 1))) AS "window" FROM ex),
v AS (SELECT id, expression, "window", unnest(list_distinct([greatest(2, CAST(round_even("window" * 0.75, 0) AS INTEGER)), "window", greatest(2, CAST(round_even("window" * 1.25, 0) AS INTEGER))])) AS variant FROM w)
SELECT id, "window", variant, regexp_replace(expression, ',\\s*' || "window" || '\\s*\\)', ', ' || variant || ')', 'g') AS rewritten FROM v""")
def window_variants(spark, sf_dir):
    return sm.window_variants(_expressions(spark, sf_dir))


@query(f"""WITH {EXPR_SQL}, a AS (SELECT id, CASE id % 4 WHEN 0 THEN [trim(split_part(expression, ' / ', 1)), expression] WHEN 1 THEN [trim(split_part(expression, ' * ', 1)), trim(split_part(expression, ' * ', 2)), expression] WHEN 2 THEN [trim(split_part(expression, ' / ', 1)), expression]
ELSE [trim(split_part(expression, ' * ', 1)), trim(split_part(split_part(expression, ' * ', 2), ' / ', 1)), trim(split_part(expression, ' / ', 1)), expression] END AS p FROM ex)
SELECT id, CAST(i - 1 AS INTEGER) AS ablation_no, p[i] AS ablation FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS i FROM a)""")
def ablations(spark, sf_dir):
    return sm.ablations(_expressions(spark, sf_dir))


@query(f"""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z_0-9]+')) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, {rounded_sql(_jaccard_sql('a.w', 'b.w'))} AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id AND len(list_intersect(a.w, b.w)) > 0""")
def token_jaccard(spark, sf_dir):
    """All pairs of items that share a word, by an inverted index."""
    t = table(spark, sf_dir, "benchmark").select("item_id", sg.expression_tokens(F.col("text")).alias("w"))
    rows = t.select("item_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    a, b = rows.select(F.col("item_id").alias("a"), F.col("n").alias("na"), "word"), rows.select(F.col("item_id").alias("b"), F.col("n").alias("nb"), "word")
    shared = a.join(b, "word").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("m"))
    return _out(shared.withColumn("jaccard", F.col("m") / (F.col("na") + F.col("nb") - F.col("m"))), ["a", "b"], ["jaccard"])


_EXPRESSION_SETS = f"SELECT id, {_TOKENS.format('expression')} AS w FROM ex"
_ITEM_SETS = "SELECT item_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z_0-9]+')) AS w FROM benchmark"


def _similar_sql(rows: str, threshold: float) -> str:
    """Pairs of unlike sets of the table expression (id, w), by comparing all with all."""
    return f"""c AS (SELECT min(id) AS id, w FROM (SELECT id, list_sort(w) AS w FROM ({rows}) WHERE len(w) > 0) GROUP BY w),
j AS (SELECT a.id AS a, b.id AS b, {_jaccard_sql('a.w', 'b.w')} AS jaccard FROM c a JOIN c b ON a.id < b.id)
SELECT a, b, {rounded_sql('jaccard')} AS jaccard FROM j WHERE jaccard >= {threshold} - 1e-9"""


@query(f"WITH {EXPR_SQL}, {_similar_sql(_EXPRESSION_SETS, 0.6)}")
def similar_expressions(spark, sf_dir):
    """Every pair of unlike token sets of expressions with a Jaccard of 0.6 or more."""
    e = _expressions(spark, sf_dir).select("id", sm.tokens(F.col("expression")).alias("w"))
    return _out(st.similar_sets(e, "id", "w", 0.6), ["a", "b"], ["jaccard"])


@query(f"""WITH {EXPR_SQL}, t AS (SELECT id, list_sort({_TOKENS.format('expression')}) AS w FROM ex)
SELECT id, min(id) OVER (PARTITION BY w) AS "class" FROM t WHERE len(w) > 0""")
def expression_classes(spark, sf_dir):
    """The expressions behind each token set that `similar_expressions` names."""
    e = _expressions(spark, sf_dir).select("id", sm.tokens(F.col("expression")).alias("w"))
    return st.classes(e, "id", "w")


@query(f"WITH {_similar_sql(_ITEM_SETS, 0.1)}")
def similar_items(spark, sf_dir):
    """Every pair of benchmark items whose word sets have a Jaccard of 0.1 or more."""
    t = table(spark, sf_dir, "benchmark").select("item_id", sg.expression_tokens(F.col("text")).alias("w"))
    return _out(st.similar_sets(t, "item_id", "w", 0.1), ["a", "b"], ["jaccard"])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, 1000000 + l_partkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
h AS (SELECT CAST(i AS BIGINT) AS start, CAST(i AS BIGINT) AS node, 0 AS hop FROM range(1, 71) r(i) UNION SELECT start, u.b, hop + 1 FROM h JOIN u ON u.a = h.node WHERE hop < 2)
SELECT start, node, min(hop) AS hop FROM h GROUP BY 1, 2""")
def graph_hops_of_each(spark, sf_dir):
    """Two steps from each of seventy suppliers, in one traversal."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b"))
    return gr.hops_of_each(e, range(1, 71), 2)
