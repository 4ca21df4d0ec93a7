"""The question flow against plain loops."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import questions as Q
from quillspark.operators import search_index as X
from quillspark.plans import search
from quillspark.plans.registry import QUERIES, load


def test_context_equals_plain_choice(spark, small):
    rows = {r["number"]: r for r in QUERIES["question_context"](spark, small).collect()}
    index = X.ensure(load(spark, small, "documents"), "doc_id", "text", "search", X.index_words)
    scores = {r["doc_id"]: round(r["score"], 9) for r in X.search(index, search.QUESTION, "doc_id").collect()}
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in load(spark, small, "embeddings").collect()}
    like = {k: round(float(v @ vectors[7] / np.linalg.norm(v) / np.linalg.norm(vectors[7])), 9) for k, v in vectors.items()}
    lists = [sorted(scores, key=lambda k: (-scores[k], k))[:200], sorted((k for k in like if like[k] >= 0.3), key=lambda k: (-like[k], k))[:200]]
    fused: dict = {}
    for no, found in enumerate(lists):
        for rank, k in enumerate(found, 1):
            s, first = fused.get(k, (0.0, no))
            fused[k] = (s + 1 / (60 + rank), min(first, no))
    best = sorted(fused, key=lambda k: (-round(fused[k][0], 9), fused[k][1], k))[:40]
    docs = {r["doc_id"]: r for r in search.passages_of(spark, small).collect()}
    lines = {r["doc_id"]: r["line"] for r in search.passages_of(spark, small).select("doc_id", Q.line(*map(F.col, ("video", "kind", "a", "b", "text"))).alias("line")).collect()}
    best = [k for k in best if k in docs]
    taken, left, count, rest = [], 1500, {}, list(range(len(best)))
    while rest and len(taken) < 16:
        i = min(rest, key=lambda i: (i + 4 * count.get(docs[best[i]]["video"], 0), i))
        rest.remove(i)
        d, cost = docs[best[i]], -(-len(lines[best[i]]) // 4)
        near = [docs[best[j]] for j in taken if docs[best[j]]["video"] == d["video"]]
        if cost > left or any((x["a"] is None and d["a"] is None) or (x["a"] is not None and d["a"] is not None and 10 - abs(x["a"] - d["a"]) >= 5) for x in near):
            continue
        taken.append(i)
        left -= cost
        count[d["video"]] = count.get(d["video"], 0) + 1
    assert {r["doc_id"] for r in rows.values()} == {best[i] for i in taken} and len(rows) > 3
    assert sorted(rows) == list(range(1, len(rows) + 1))
    videos = [docs[rows[n]["doc_id"]]["video"] for n in sorted(rows)]
    assert len(set(videos)) == len([v for i, v in enumerate(videos) if i == 0 or videos[i - 1] != v])
    assert all(r["line"] == lines[r["doc_id"]] and "\n" not in r["line"] for r in rows.values())


def test_words_alone_without_vectors(spark, small):
    index = X.ensure(load(spark, small, "documents"), "doc_id", "text", "search", X.index_words)
    scores = {r["doc_id"]: round(r["score"], 9) for r in X.search(index, "ea thending", "doc_id").collect()}
    got = {r["rank"]: r["doc_id"] for r in Q.retrieved(index, "ea thending", "doc_id").collect()}
    assert [got[i] for i in range(len(got))] == sorted(scores, key=lambda k: (-scores[k], k))[:40]


def test_answers(spark):
    rows = [(1, "A cat [1] sits [2-3], [99]."), (2, "NO_ANSWER: nothing."), (3, "Just words."), (4, None), (5, "**no_answer** But see [2].")]
    got = {r["i"]: r for r in Q.read_answers(spark.createDataFrame(rows, "i int, text string"), "text", 5).collect()}
    assert (got[1]["text"], got[1]["cited"], got[1]["dropped"], got[1]["status"]) == ("A cat [1] sits [2][3],.", [1, 2, 3], 1, "answered")
    assert got[2]["text"] == "nothing." and [got[i]["status"] for i in (2, 3, 4, 5)] == ["no_answer", "uncited", "uncited", "answered"]


def test_every_turn_is_read(spark, small):
    rows = QUERIES["question_answers"](spark, small).collect()
    assert len(rows) == load(spark, small, "conversations").count()
    for r in rows:
        # A bracket that a text holds itself counts, too, so only turns without one are told beforehand.
        own = [n for n in [r["turn"] + 1, *range(r["conv_id"] % 30, r["conv_id"] % 30 + 3)] if 1 <= n <= 12]
        if r["turn"] % 4 < 2 and not re.search(r"\[", r["cited"]):
            assert r["cited"] == ",".join(map(str, dict.fromkeys(own))) and r["status"] == "answered"
        elif r["turn"] % 4 == 3 and not r["cited"]:
            assert r["status"] == "no_answer"
