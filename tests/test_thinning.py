"""Thinning by kept rows against brute force."""

import re
from collections import defaultdict, deque

from pyspark.sql import functions as F

from quillspark.operators import sequences as Q
from quillspark.plans.registry import QUERIES


def words(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_hamming_thin_reads_whole_texts(spark, tmp_path):
    start, tail = "the same opening of sixty four characters and some more of them ", " ".join(f"t{i}" for i in range(200))
    texts = [start + " ".join(f"{x}{i}" for i in range(60)) for x in "abc"] + [tail, tail + " end", None, "", tail]
    rows = [(1500 * i if i < 7 else None, t, "s") for i, t in enumerate(texts)] + [(999, tail, None), (1001, tail, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["source"]) for r in QUERIES["hamming_thin"](spark, str(tmp_path)).collect()}
    assert {(0, "s"), (1500, "s"), (3000, "s")} <= got and (6000, "s") not in got and (999, None) in got and (1001, None) not in got


def test_hamming_thin_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    every = sorted({w for r in docs.select("text").collect() for w in words(r["text"])})
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    kept, want = defaultdict(lambda: deque(maxlen=4)), set()
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        w = words(r["text"])
        code = sum(1 << b for b in range(64) if 2 * sum(hashes[x] >> b & 1 for x in w) > len(w))
        if all((code ^ x).bit_count() > 6 for x in kept[r["source"]]):
            kept[r["source"]].append(code)
            want.add(r["doc_id"])
    got = [r["doc_id"] for r in QUERIES["hamming_thin"](spark, small).collect()]
    print("KEPT", len(got), "of", docs.count())
    assert len(got) == len(want) and set(got) == want
    assert Q.simhash(spark.createDataFrame([], "k int, text string"), "text", "code").count() == 0
