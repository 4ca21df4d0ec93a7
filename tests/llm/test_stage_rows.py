"""The pipeline's stages on repeated and null ids: the verdict is that of the row."""

from collections import Counter

from pyspark.sql import functions as F

from quillspark.llm import mixing, queries, stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_quality_of_each_row(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    good = {r["doc_id"] for r in queries.op3_additive_quality(spark, small).where("predicted = 1").collect()}
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fine = [t for i, t in texts if i in good][:3]
    bad = [t for i, t in texts if i not in good and t not in {t for i, t in texts if i in good}][:3]
    unknown = -5
    more = spark.createDataFrame([(i, t, "en", "x", 1) for i in (None, unknown) for t in fine + bad + fine], SCHEMA)
    got = stages.keep_quality(spark, docs.unionByName(more.select(*docs.columns)), small)
    assert rows_of(got.where(F.col("source") == "x")) == Counter({(i, t, "x"): 2 * c for i in (None, unknown) for t, c in Counter(fine).items()})


def test_one_row_of_each_group(spark, small):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (1, a), (2, a), (1, b), (7, b), (None, c), (None, c), (None, d), (4, d), (9, None), (9, None), (None, " "), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    want = [(1, a), (1, b), (None, c), (4, d), (9, None), (9, None), (None, " "), (None, "")]
    assert rows_of(stages.keep_one_of_each_group(spark, docs, small)) == Counter((i, t, "s") for i, t in want)


def test_mix_takes_each_row_as_often_as_it_says(spark, small):
    rows = [(i % 3 if i % 4 else None, f"w{i} " * (i % 7 + 1), s) for s in "pqr" for i in range(40)] + [(5, "same words here", "p")] * 9 + [(5, "same words here", "q")] * 2
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA)
    sizes = docs.select(F.col("doc_id").alias("id"), "source", mixing.word_count(F.col("text")).alias("size"), "text")
    want = Counter()
    for r in mixing.mix(sizes, queries.MIX_WEIGHTS, seed=17).collect():
        want[(r["id"], r["source"], r["size"])] += r["times"]
    got = Counter()
    for (i, t, s), n in rows_of(stages.mix_sources(spark, docs, small)).items():
        got[(i, s, len(t.split()))] += n
    assert got == +want
