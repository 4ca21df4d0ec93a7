"""The corpus pipeline: quality classifier, n-gram Jaccard join, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet to the shared folder and
reads it again as the next one's docs. What a stage wrote on its way is deleted once its result is written, and its result
once the next one is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import stages
from quillspark.llm.common import cut, delete, lent, load

STAGES = [
    ("quality_classifier", stages.keep_quality),
    ("ngram_jaccard_join", stages.keep_one_of_each_group),
    ("benchmark_decontamination", stages.drop_contaminated),
    ("mixing", stages.mix_sources),
    ("sharding", stages.assign_shards),
]

#: A learnt classifier decides which rows stay, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = load(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with lent(spark) as paths:
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
            before, own = own, [paths.pop()]
        delete(spark, before)
    return docs
