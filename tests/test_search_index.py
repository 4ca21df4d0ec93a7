"""The index that follows its documents, against one built anew and against plain counting."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import search_index as X

WORDS = ["the", "of", "thenda", "thendo", "sea", "ea", "été", "ete", "STRASSE", "straße", "foo_bar", "ﬁne"]


def frame(spark, docs: dict):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


def plain_words(text: str | None) -> list[str]:
    folded = (text or "").lower().replace("é", "e").replace("ß", "ss").replace("ﬁ", "fi")
    return re.findall(r"[^\W_]+", folded)


def plain_scores(docs: dict, units: list[tuple]) -> dict:
    split = {k: plain_words(t) for k, t in docs.items()}
    mean = sum(map(len, split.values())) / len(split)
    hit = lambda w, p: w.startswith(p[:-1]) if p.endswith("*") else w == p
    tf = {k: [sum(all(hit(w[i + j], p) for j, p in enumerate(u)) for i in range(len(w) - len(u) + 1)) for u in units] for k, w in split.items()}
    df = [sum(t[i] > 0 for t in tf.values()) for i in range(len(units))]
    out = {}
    for k, t in tf.items():
        if any(t):
            out[k] = sum(max(1e-6, math.log((len(docs) - df[i] + 0.5) / (df[i] + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(split[k]) / mean)) for i, f in enumerate(t))
    return out


def scores(index, query: str) -> dict:
    return {r["doc_id"]: round(r["score"], 9) for r in X.search(index, query, "doc_id").collect()}


def test_queries_equal_plain_counting(spark, tmp_path) -> None:
    rng = random.Random(1)
    docs = {i: " ".join(rng.choices(WORDS, k=rng.randint(0, 30))) for i in range(60)} | {60: None, 61: ""}
    index = X.WordIndex(spark, f"{tmp_path}/i")
    index.apply(frame(spark, docs).withColumnRenamed("doc_id", "key"))
    for query, units in [
        ('"of the" thend ea', [("of", "the"), ("thend*",), ("ea",)]),
        ("the", [("the",)]),
        ("Strasse foo_bar", [("strasse*",), ("foo", "bar*")]),
        ('"the the of"', [("the", "the", "of")]),
        ('"fine"', [("fine*",)]),
    ]:
        assert X.asked_units(spark, query) == units
        assert scores(index, query) == {k: round(v, 9) for k, v in plain_scores(docs, units).items()}, query
    assert scores(index, " ?! ") == {}


def test_edits_equal_a_rebuild(spark, tmp_path) -> None:
    rng = random.Random(2)
    text = lambda: " ".join(rng.choices(WORDS, k=rng.randint(1, 12)))
    docs = {i: text() for i in range(20)}
    index = X.WordIndex(spark, f"{tmp_path}/i", fanout=2)
    index.refresh(frame(spark, docs), "doc_id", "text")
    for step in range(5):
        for k in rng.sample(sorted(docs), 3):
            docs[k] = text()
        for k in rng.sample(sorted(docs), 2):
            del docs[k]
        docs[100 + step] = text()
        index.refresh(frame(spark, docs), "doc_id", "text")
        state = index.manifest()
        assert state.docs == len(docs) and state.words == sum(len(plain_words(t)) for t in docs.values())
    assert max(s.level for s in state.segments) >= 1 and len(state.segments) <= 4
    again = X.WordIndex(spark, f"{tmp_path}/again")
    again.refresh(frame(spark, docs), "doc_id", "text")
    order = lambda i: sorted(map(tuple, i.postings().collect()))
    assert order(index) == order(again)
    assert scores(index, '"of the" thend ea') == scores(again, '"of the" thend ea')
    index.vacuum()
    assert order(index) == order(again)


def test_one_edit_writes_one_small_segment(spark, tmp_path) -> None:
    docs = {i: f"the word{i} of sea" for i in range(50)}
    index = X.WordIndex(spark, f"{tmp_path}/i")
    index.refresh(frame(spark, docs), "doc_id", "text")
    before = index.manifest()
    assert index.refresh(frame(spark, docs), "doc_id", "text") == (0, 0) and index.manifest() == before
    docs[7] = "ea ea"
    assert index.refresh(frame(spark, docs), "doc_id", "text") == (1, 0)
    after = index.manifest()
    assert after.segments[:-1] == before.segments and len(after.segments) == len(before.segments) + 1
    assert spark.read.parquet(f"{tmp_path}/i/segments/{after.segments[-1].name}/docs").count() == 1
    assert list(scores(index, "ea")) == [7] and 7 not in scores(index, "word7")


def test_two_writers_and_all_removed(spark, tmp_path) -> None:
    one, two = (X.WordIndex(spark, f"{tmp_path}/i") for _ in range(2))
    one.refresh(frame(spark, {1: "sea"}), "doc_id", "text")
    state = two.manifest()
    one.refresh(frame(spark, {1: "sea", 2: "ea"}), "doc_id", "text")
    with pytest.raises(X.Conflict):
        two._publish(state)
    assert two.manifest().docs == 2
    one.apply(None, spark.createDataFrame([(1,), (2,)], "key long"))
    assert one.manifest().segments == () and scores(one, "sea") == {}
    one.refresh(frame(spark, {3: "sea"}), "doc_id", "text")
    assert list(scores(one, "sea")) == [3]


def test_a_term_of_all_documents_and_null_keys(spark, tmp_path) -> None:
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("the sea").alias("text")).unionByName(spark.createDataFrame([(None, "the")], "doc_id long, text string"))
    index = X.WordIndex(spark, f"{tmp_path}/i")
    assert index.refresh(df, "doc_id", "text") == (2000, 0)
    assert index.postings(["the"]).count() == 2000
