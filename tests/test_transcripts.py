"""Transcript and framing rules against plain Python and small cases."""

import textwrap

from pyspark.sql import functions as F

from quillspark.operators import transcripts as X
from quillspark.plans.registry import QUERIES


def test_wrapped(spark):
    texts = ["", None, "one two", "a" * 50 + " tail", "x" * 84, " ".join(["word"] * 40), "ab " + "y" * 45 + " z"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.wrapped(F.col("t")).alias("lines")).collect()
    got = {r["i"]: r["lines"] for r in rows}
    assert got[0] == [] and got[1] is None and got[2] == ["one two"]
    assert got[3] == ["a" * 42, "a" * 8 + " tail"] and got[4] == ["x" * 42, "x" * 42]
    assert got[5] == textwrap.wrap(texts[5], 42)
    assert got[6] == ["ab", "y" * 42, "yyy z"]


def test_crop_runs(spark, small):
    boxes = {}
    for r in spark.read.parquet(f"{small}/lineitem.parquet").collect():
        x, y = r["l_discount"] * 5, r["l_tax"] * 5
        boxes.setdefault(r["l_orderkey"], []).append((r["l_linenumber"], x, y, x + r["l_quantity"] / 100, y + r["l_quantity"] / 80))
    want = set()
    for key, rows in boxes.items():
        held = []
        for row in sorted(rows):
            more = [*held, row]
            wide = max(b[3] for b in more) - min(b[1] for b in more)
            tall = max(b[4] for b in more) - min(b[2] for b in more)
            if held and (wide > 0.6 + 1e-6 or tall > 0.7 + 1e-6):
                want.add((key, held[0][0], held[-1][0]))
                more = [row]
            held = more
        want.add((key, held[0][0], held[-1][0]))
    got = [tuple(r) for r in QUERIES["framing_runs"](spark, small).collect()]
    assert set(got) == want


def test_captions(spark, small):
    rows = QUERIES["caption_lines"](spark, small).collect()
    assert rows and all(len(line) <= 42 for r in rows for line in (r["lines"] or "").split("\n"))
