"""One query per operator: (spark, sf_dir) -> DataFrame, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import tokenized

    return tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("shard", "block")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, labels, learn=~held_out)
    return _classified(toxicity.score(docs, model), held_out, "sentences")


def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import cross_entropy_difference

    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_block", "mix_slot", "mix_position")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, labels, learn=~held_out)
    return _classified(quality.score(docs, model), held_out)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_duplicates

    return simhash_duplicates(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import aligned_counts

    return aligned_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import compressed

    return compressed(table(spark, sf_dir, "embeddings"))


def _classified(scores: DataFrame, held_out: Column, *more: str) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), *more)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_toxicity": op2_toxicity,
    "op4_cross_entropy_difference": op4_cross_entropy_difference,
    "op5_license_scan": op5_license_scan,
    "op6_personal_data": op6_personal_data,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_decontamination": op10_decontamination,
    "op11_simhash": op11_simhash,
    "op12_alignment": op12_alignment,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {}
ORACLE_SQL["op10_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, list_slice(w, i, i + least(10, len(w)) - 1) AS win
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM p),
places AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
m AS (SELECT r, i, places.size AS size, item_id FROM places JOIN p ON p.size = places.size AND p.win = list_slice(w, i, i + places.size - 1)),
hit AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS x FROM m) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
ORACLE_SQL["op3_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id AS doc_id, coalesce(n, 0) AS n_shingles, c.component_id AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""


def _vector_codes_sql(rounds: int = 6) -> str:
    """Each round is an assignment (n) and the codebook after it (c); distance * 16 + entry orders by distance, then entry."""
    out = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, label, embedding AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, (i - 1) // (len(v) // 8) AS part, (i - 1) % (len(v) // 8) AS pos, CAST(floor(4096 * CAST(v[i] AS DOUBLE)) AS BIGINT) AS x
                   FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS i FROM e)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e QUALIFY row_number() OVER (ORDER BY vec_id) <= 16),
c0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM x JOIN first USING (r))"""
    for k in range(rounds + 1):
        out += f""",
n{k} AS MATERIALIZED (SELECT r, part, min(d * 16 + entry) % 16 AS entry, min(d * 16 + entry) // 16 AS d
    FROM (SELECT r, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{k} USING (part, pos) GROUP BY r, part, entry) GROUP BY r, part)"""
        if k < rounds:
            out += f""",
s{k} AS (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN n{k} USING (r, part) GROUP BY part, entry, pos),
c{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{k} LEFT JOIN s{k} USING (part, entry, pos))"""
    return out + f""",
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM e JOIN coded USING (r) CROSS JOIN books
"""


ORACLE_SQL["op13_vector_codes"] = _vector_codes_sql()
