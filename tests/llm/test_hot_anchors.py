"""Pieces of one anchor that many texts hold: no shard takes them all, and the spans are those of brute force."""

import random
from collections import Counter

from quillspark.llm import substrings

LENGTH, LIMIT = 100, 50


def test_hot_anchors_are_split(spark, monkeypatch):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage = word(330)
    texts = [word(150) + passage + word(150) for _ in range(70)]
    texts += [word(90) + t[:-40] for t in texts[:3]] + [texts[4]]
    windows = Counter(t[i : i + LENGTH] for t in texts for i in range(len(t) - LENGTH + 1))
    want = []
    for k, t in enumerate(texts):
        gone = [False] * len(t)
        for i in range(len(t) - LENGTH + 1):
            if windows[t[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = [True] * LENGTH
        want.append((k, "".join(c for c, g in zip(t, gone, strict=True) if not g)))
    kernel = substrings._sorted

    def limited(length):
        inner, most = kernel(length), LIMIT

        def run(key, table):
            if table.num_rows > most:
                raise ValueError(f"{table.num_rows} pieces in a shard")
            return inner(key, table)

        return run

    monkeypatch.setattr(substrings, "_sorted", limited)
    monkeypatch.setattr(substrings, "HOT", 8, raising=False)
    got = substrings.dedup_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), LENGTH).collect()
    assert sorted((x["doc_id"], bytes(x["kept"]).decode()) for x in got) == want
