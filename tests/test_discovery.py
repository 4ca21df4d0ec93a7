"""New files found once, and how well a frame shows a subject."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quillspark.functions.space import subject_presence
from quillspark.streaming.discovery import discovered, new_roots
from quillspark.streaming.log import run_once


def test_each_file_is_found_once(spark, tmp_path) -> None:
    def put(*names: str) -> None:
        for name in names:
            at = tmp_path / "in" / name
            os.makedirs(at.parent, exist_ok=True)
            at.write_bytes(b"x" * (0 if "empty" in name else 3))

    seen = []

    def run() -> list[str]:
        run_once(discovered(spark, f"{tmp_path}/in", ["mp4", ".MOV"], ["/trash/"], files=2), lambda df, n: seen.append([r["path"].split("/in/")[1] for r in df.collect()]), f"{tmp_path}/checkpoint", "append")
        out = sorted(p for batch in seen for p in batch)
        seen.clear()
        return out

    put("a.mp4", "sub/b.MOV", "c.txt", "sub/.hidden/d.mp4", "trash/e.mp4", "empty.mp4")
    assert run() == ["a.mp4", "sub/b.MOV"]
    assert run() == []
    put("sub/deep/f.mp4")
    assert run() == ["sub/deep/f.mp4"]


def test_roots_of_new_files(spark) -> None:
    files = spark.createDataFrame([("/a/b/x",), ("/a/b/y",), ("/a/z",), ("/q/w",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/a/b",)], "root string")
    assert {tuple(r) for r in new_roots(files, roots).collect()} == {("/a/b", 2), ("/a", 1)}


def test_presence(spark) -> None:
    big, small, edge = (0.2, 0.2, 0.7, 0.7), (0.4, 0.4, 0.5, 0.5), (0.0, 0.4, 0.1, 0.5)
    rows = [(1, False, 3, [big]), (2, True, 0, []), (3, True, 1, None), (4, True, 3, []), (5, True, 0, [big]), (6, True, 0, [big, small, small]), (7, True, 0, [edge]), (8, True, 2, [edge]), (9, None, None, None)]
    df = spark.createDataFrame(rows, "i int, d boolean, n int, b array<struct<x1:double,y1:double,x2:double,y2:double>>")
    got = {r["i"]: round(r["s"], 6) for r in df.select("i", subject_presence(F.col("d"), F.col("n"), F.col("b")).alias("s")).collect()}
    assert got == {1: 0.5, 2: 0.35, 3: 0.55, 4: 0.85, 5: 0.7, 6: 1.0, 7: 0.35, 8: 0.7, 9: 0.5}
