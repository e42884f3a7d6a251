"""Each stage of the pipeline on its own input, against what it is to keep."""

import random

import corpus_pipeline as cp
from tidewell.llm import decontaminate, neardup, toxicity

from .test_tokens import brute


def write_tables(spark, folder):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ba", "lo", "mi", "tu", "re") for b in ("na", "der", "st", "gol", "pi", "ke")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(12, 60))) + "." for _ in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(14))) for i in range(5)]
    for i in range(0, 300, 6):
        texts[i] = f"{texts[i]} {rng.choice(words)} vilesome {rng.choice(words)}."
    for i in range(1, 300, 30):
        texts[i] = f"{texts[i]} {rng.choice(items)[1]} {texts[i]}"
    texts[8] = texts[9] = texts[10] = texts[2]
    docs = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    sf_dir = str(tmp_path / "tables")
    rows = write_tables(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == names
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert ids == {r.doc_id for r in toxicity.score(before, model).where("score < 0.3").collect()}
            assert len({i for i in range(0, 300, 6)} & ids) <= 5 and len(ids) >= 240
        elif name == "ngram_jaccard_join":
            assert ids == {r.doc_id for r in neardup.near_duplicates(before).where("doc_id = component_id").collect()}
        elif name == "benchmark_decontamination":
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert ids == {r.doc_id for r in decontaminate.contamination(before, bench).where("not contaminated").collect()}
        kept[name] = ids
    assert {8, 9, 10} & kept["ngram_jaccard_join"] == set()
    assert kept["mixing"] == kept["benchmark_decontamination"] and {900, 901} <= kept["mixing"]
    tokens = cp.STAGES[-1][1](spark, docs, sf_dir).collect()
    text = {r[0]: r[1] for r in rows}
    want = {i: (n, crc) for i, _, n, crc in brute([(i, text[i]) for i in kept["mixing"]])}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokens} == want
    ordered = sorted(tokens, key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))


def test_run(spark, tmp_path):
    write_tables(spark, str(tmp_path))
    out = cp.run(spark, str(tmp_path))
    assert 150 < out.count() < 302 and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out.columns)


def test_stages_take_odd_tables(spark, tmp_path):
    sf_dir = str(tmp_path / "tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{i % 997}" for i in range(120_000))
    odd = [(5, "some plain words stand here now", None, None, None), (5, "quite other words stand there then", "en", "a", 1), (5, "quite other words stand there then", "en", "a", 1), (None, long, "en", "a", 1), (7, None, None, "b", None), (7, "", "en", "b", 0)]
    labels = spark.createDataFrame([(5, 0), (7, None)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    for k, rows in enumerate(([], odd)):
        folder = f"{sf_dir}{k}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        out = cp.run(spark, folder).collect()
        # of the two equal rows of id 5 one goes, everything else stays
        assert sorted((r.doc_id for r in out), key=str) == sorted(([] if not rows else [5, 5, None, 7, 7]), key=str)
        if rows:
            assert max(r.n_tokens for r in out) > 120_000
