import public_tokenizers
from pyspark.sql import functions as F
from test_models_and_files import plain_statistics, plain_walk, windows_of
from test_near_dup import brute_force

import corpus_pipeline
from cadence.llm import decontaminate, quality_model

SF = "/root/testdata/sf0.001"


def test_stages_on_their_own_inputs(spark):
    """Each stage's result on what it gets, against plain Python."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        seen[name] = before, docs
        if name != "tokens":
            assert docs.columns == list(corpus_pipeline.COLUMNS)

    before, after = seen["quality"]
    model = quality_model.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    x = [(r.doc_id, plain_walk(model, plain_statistics(r.text))) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, s in x if s >= 0.5)

    before, after = seen["near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted(int(d) for d, _, c in brute_force(rows) if d == c)

    before, after = seen["decontaminate"]
    tokens = lambda df, i: [(r[0], r[1]) for r in df.select(i, decontaminate.tokens_of(F.col("text"))).collect()]
    items = [w for _, w in tokens(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id")]
    shingles = {tuple(w[k : k + 3]) for w in items for k in range(len(w) - 2)}  # any window that fits has three tokens in a row
    near = lambda w: any(tuple(w[k : k + 3]) in shingles for k in range(len(w) - 2))
    want = [i for i, w in tokens(before, "doc_id") if not (near(w) and any(windows_of(w, item) for item in items))]
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)

    before, after = seen["mix"]
    counts = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 2 and set(counts) <= {r.doc_id for r in before.collect()}
    assert after.exceptAll(before.unionByName(before)).count() == 0

    before, after = seen["tokens"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    encoded = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch([t for _, t in rows], add_special_tokens=False)
    assert sorted((r.doc_id, r.n_tokens) for r in after.collect()) == sorted((i, len(e.ids) + 1) for (i, _), e in zip(rows, encoded, strict=True))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_dedup_judges_rows(spark):
    a, b, c = ("a b c d e f g h", "i j k l m n o p", "q r s t u v w x")
    rows = [(0, b), (1, a), (1, b), (5, c), (5, c), (6, None), (6, None), (7, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs.withColumn("row_key", F.lit(1)).withColumn("first", F.lit(1)), SF)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert rows_of(got) == sorted([(0, b), (1, a), (5, c), (6, None), (6, None), (7, ""), (None, a), (None, a)], key=str)


def test_stages_with_odd_rows(spark, odd_docs):
    """Nulls, empty and very long texts, repeated ids and further columns; each stage keeps whole rows of what it gets."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, SF)
        if name == "tokens":
            assert out.count() == odd_docs.count()
        else:
            assert out.columns == list(corpus_pipeline.COLUMNS)
            assert set(rows_of(out)) <= set(rows_of(odd_docs))


def test_stages_without_rows(spark, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0
