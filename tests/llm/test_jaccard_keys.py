"""Keys of sets: what stands for two sets is told apart, and a flush holds no more sets than 16 bits number."""

from collections import Counter

import numpy as np
import pyarrow as pa

from quillspark.llm import jaccard


def test_keys_of_several_sets(spark):
    texts = pa.array(["a b c d e f", "a b c d e f", "b c d e f g", "x y", None, ""])
    none = np.zeros(0, np.uint64)
    _, n, key, check = jaccard.shingle_sets(texts, 5, none)
    assert n.tolist() == [2, 2, 2, 1, 0, 0] and key[0] == key[1] and len(set(key.tolist())) == 4
    _, _, other, same = jaccard.shingle_sets(texts, 5, key[:3])
    assert (same == check).all() and other[0] == other[1] != key[0] and other[2] not in (key[2], other[0]) and other[3] == key[3]
    sizes = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (2, 6), (-3, 1), (-3, 2)], "set long, check long")
    assert sorted(jaccard.keys_of_several(sizes).view(np.int64).tolist()) == [-3, 2]


def test_many_short_texts_in_one_batch(spark):
    pairs = 70_000
    docs = spark.range(2 * pairs).selectExpr("id AS doc_id", f"concat('w', id % {pairs}, ' v') AS text").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400000")
    try:
        got = Counter(r["component_id"] for r in jaccard.jaccard_components(docs).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == pairs and set(got.values()) == {2} and set(got) == set(range(pairs))
