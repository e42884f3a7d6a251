"""A training corpus in five stages; each one's rows are written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, mixing, neardup, tokens, toxicity
from tidewell.llm.shared import new_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from this stage's labelled rows, does not reject.

    Null and empty texts score 0 and stay; repeated rows stay or go together;
    without labels of both kinds, or without documents, nothing is rejected.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links, that of the smallest id.

    Documents without words are in no group and stay; repeated rows are one
    group; equal ids with unlike texts are different documents; rows without an
    id come last in their group.  An empty table stays empty.
    """
    return neardup.distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts stay; null and empty items hold no window; repeated
    rows stay or go together; an empty table stays empty.
    """
    return decontaminate.clean_of_benchmarks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mix: by file name, then by row.

    A null source is a source of its own; rows equal in every column may stand
    in either order; an empty table stays empty.
    """
    return mixing.in_mix_order(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the order of the mix; a row for each document, with the place of its ids.

    A null text is empty and has the end id only; null and repeated ids keep
    each their own ids; an empty table gives an empty one.
    """
    import public_tokenizers

    order = None
    if docs.inputFiles():  # rows as the stage before has laid them out
        order = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    return tokens.tokenized(docs, public_tokenizers.path("word_bpe_49k.json"), order=order)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_token_ids),
]
#: Models, hashes and token ids are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if stage is STAGES[-1][1]:
            return out
        path = new_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
