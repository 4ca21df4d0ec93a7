"""What one task or the driver holds does not grow with the table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillspark.operators import intervals
from quillspark.plans import planning


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_side_with_exploded_rows_is_not_broadcast(spark):
    spans = spark.range(50).select((F.col("id") % 5).alias("k"), (F.col("id") * 3.0).alias("a"), (F.col("id") * 3.0 + 100).alias("b"))
    others = spans.select("k", (F.col("a") + 7).alias("c"), (F.col("b") - 60).alias("d"))
    met = intervals.overlaps(spans, others, ["k"], ("a", "b"), ("c", "d"), 30)
    assert "Broadcast" not in plan(met)
    pairs = [(x["k"], x["a"], y["c"], min(x["b"], y["d"]) - max(x["a"], y["c"])) for x in spans.collect() for y in others.collect() if x["k"] == y["k"] and min(x["b"], y["d"]) > max(x["a"], y["c"])]
    assert sorted(map(tuple, met.select("k", "a", "c", "overlap").collect())) == sorted(pairs)


def test_spoken_words_are_in_time_and_not_sorted(spark, tmp_path):
    long = " ".join(["word", "end.", "a"] * 150)
    rows = [(1, 1, "user", "Hello there.\nYou"), (1, 0, "user", long), (1, 1, "assistant", ""), (2, 0, "user", None), (2, 1, "user", "one")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    said, _ = planning.spoken(spark, str(tmp_path))
    want = []
    for conv in (1, 2):
        at = 0
        for _, _, _, text in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1:3]):
            for word in re.split("[ \n]+", text or ""):
                want.append((conv, at / 100, (at + 10 + 5 * len(word)) / 100, word))
                at += 10 + 5 * len(word) + (70 if word.endswith(".") else 2)
    assert sorted(map(tuple, said.collect())) == sorted(want)
    # Rows are sorted before they are exploded into words.
    shown = plan(said)
    assert "Sort [" in shown and "Sort [" not in shown[: shown.index("Window")] and "inline" in shown[: shown.index("Window")]


def test_spoken_shots_read_runs_of_words(spark, small):
    """No conversation is gathered in one row: ten thousand of them would be one batch, and each word an object of Python."""
    from quillspark.plans.registry import QUERIES

    shown = plan(QUERIES["split_spoken_shots"](spark, small))
    assert "MapInArrow" in shown and not re.search("collect_list|Generate inline", shown)
    # One shuffle, of the texts.
    assert len(re.findall(r"Exchange hashpartitioning", shown)) == 1


def test_words_are_counted_without_a_shuffle_or_a_sort(spark, tmp_path, monkeypatch):
    from quillspark.operators import search_index as X

    seen, write = [], X.WordIndex._write_postings

    def watched(self, post, made):
        seen.append(plan(post))
        write(self, post, made)

    monkeypatch.setattr(X.WordIndex, "_write_postings", watched)
    docs = spark.createDataFrame([(1, "the sea the"), (2, "of the sea"), (3, None)], "doc_id long, text string").repartition(2)
    docs.write.parquet(f"{tmp_path}/docs")
    index = X.WordIndex(spark, f"{tmp_path}/i")
    index.apply(spark.read.parquet(f"{tmp_path}/docs").withColumnRenamed("doc_id", "key"))
    assert len(seen) == 1 and not re.search("Exchange|Sort|Aggregate", seen[0])
    got = sorted((r["term"], r["key"], r["tf"], r["len"], r["places"]) for r in index.postings().collect())
    assert got == [("of", 2, 1, 3, [0]), ("sea", 1, 1, 3, [1]), ("sea", 2, 1, 3, [2]), ("the", 1, 2, 3, [0, 2]), ("the", 2, 1, 3, [1])]


def test_words_of_many_documents_leave_a_task_term_by_term():
    import pyarrow as pa

    from quillspark.operators import search_index as X

    docs = {7: "the sea the", 3: "of the sea", 9: None, 4: "", 5: "sea of the sea"}
    batch = pa.RecordBatch.from_pydict({"key": list(docs), "t": [d and d.split() for d in docs.values()]}, schema=pa.schema([("key", pa.int64()), ("t", pa.list_(pa.string()))]))
    rows = [r for b in X._postings([batch]) for r in b.to_pylist()]
    terms = [r["term"] for r in rows]
    # Rows of one term stand together, in the order of the documents.
    assert terms == sorted(terms, key=terms.index)
    got = [(r["term"], r["key"], r["tf"], r["len"], r["places"]) for r in rows]
    assert got == [("the", 7, 2, 3, [0, 2]), ("the", 3, 1, 3, [1]), ("the", 5, 1, 4, [2]), ("sea", 7, 1, 3, [1]), ("sea", 3, 1, 3, [2]), ("sea", 5, 2, 4, [0, 3]), ("of", 3, 1, 3, [0]), ("of", 5, 1, 4, [1])]


def test_postings_of_a_term_are_shuffled_and_stored_together(spark, tmp_path):
    from quillspark.operators import search_index as X

    docs = spark.range(0, 1000, 1, 2).select(F.col("id").alias("key"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("the sea the "), "id")).alias("text"))
    index = X.WordIndex(spark, f"{tmp_path}/i")
    state = index.apply(docs)
    stored = spark.read.parquet(f"{tmp_path}/i/segments/{state.segments[0].name}/postings")
    # Two tasks, 450 documents of a word in each, and 900 words of one document.
    assert stored.where("term in ('the', 'sea')").count() == 2 * 2 * -(-450 // X.PACK) and stored.count() == 8 + 900
    assert (state.docs, state.words) == (1000, 3600)
    want = sorted([("the", k, 2, 4, [0, 2]) for k in range(1000) if k % 10] + [("sea", k, 1, 4, [1]) for k in range(1000) if k % 10])
    assert sorted(map(tuple, index.postings(["the", "sea"]).collect())) == want
    assert sorted(map(tuple, index.postings(["the", "sea"], places=False).collect())) == [w[:4] for w in want]
    counts = lambda: {r["term"]: r["df"] for r in X.vocabulary(index).where("term in ('the', 'sea', '7')").collect()}
    assert counts() == {"the": 900, "sea": 900, "7": 1}
    # Single postings of a row die.
    state = index.apply(None, spark.createDataFrame([(7,), (8,)], "key long"))
    assert (state.docs, state.words) == (998, 3592) and counts() == {"the": 898, "sea": 898}
    for k in (2001, 2002, 2003):
        state = index.apply(spark.createDataFrame([(k, "the sea")], "key long, text string"))
    assert [s.level for s in state.segments] == [1] and not state.graves
    assert counts() == {"the": 901, "sea": 901} and index.postings(["7"]).count() == 0
    merged = spark.read.parquet(f"{tmp_path}/i/segments/{state.segments[0].name}/postings").where("term = 'the'")
    assert merged.count() < 30
