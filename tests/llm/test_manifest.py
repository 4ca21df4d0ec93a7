"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import manifest
from quillspark.llm.queries import op12_recursive_merkle_climb

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v: object) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves: list[str]) -> tuple[str, list[list[str]]]:
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([h(*rows[-1][i : i + 8]) for i in range(0, len(rows[-1]), 8)])
    return rows[-1][0], rows


def plain(docs: list[tuple]) -> dict:
    """By doc_id of (doc_id, source, lang, n_chars, text)."""
    by: dict = {}
    for d in docs:
        by.setdefault(d[2], []).append(d)
    groups = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([h(*map(field, d)) for d in sorted(by[g], key=lambda d: d[0])]) for g in groups}
    root, top = tree([trees[g][0] for g in groups])
    out = {}
    for rank, g in enumerate(groups):
        for pos, d in enumerate(sorted(by[g], key=lambda d: d[0])):
            bad = zlib.crc32(str(d[0]).encode()) % 3 == 0
            fold = h(*map(field, (*d[:4], d[4] if d[4] is None or not bad else d[4].encode().translate(LOW).decode())))
            proof = ""
            for rows, at in ((trees[g][1], pos), (top, rank)):
                for level in rows[:-1]:
                    run, own = level[at // 8 * 8 : at // 8 * 8 + 8], at % 8
                    proof += "".join(run[:own] + run[own + 1 :])
                    fold = h(*run[:own], fold, *run[own + 1 :])
                    at //= 8
            out[d[0]] = (h(*map(field, d)), trees[g][0], root, h(proof), fold, fold == root)
    return out


def check(spark, docs: list[tuple], folder) -> None:
    spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{folder}/documents.parquet")
    rows = op12_recursive_merkle_climb(spark, str(folder)).collect()
    assert len(rows) == len(docs)
    assert {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in rows} == plain(docs)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9}, {"en": 64, "fr": 65, None: 3, "de": 1}, {f"l{i}": 1 for i in range(10)} | {"en": 8}])
def test_against_a_plain_tree(spark, tmp_path, monkeypatch, sizes) -> None:
    monkeypatch.setattr(manifest, "BLOCK", 16)
    monkeypatch.setattr(manifest, "RANGE_ROWS", 20)
    docs = [(i * 7 % 1009, None if i % 5 == 0 else f"Sé{i}", g, None if i % 3 else i, None if i % 11 == 1 else ("Word " * (i % 4) + "Été")) for i, g in enumerate(g for g, n in sizes.items() for _ in range(n))]
    check(spark, docs, tmp_path)


def test_repeated_rows_null_keys_and_empty(spark) -> None:
    rows = [(1, "a", b"1" * 32, None)] * 3 + [(None, "a", b"2" * 32, b"3" * 32), (None, "a", b"2" * 32, None)]
    df = spark.createDataFrame(rows, "key long, group string, hash binary, tampered binary")
    out = manifest.verified(df.withColumn("slot", F.lit(1))).collect()
    assert len(out) == 5 and sorted(r["verified"] for r in out) == [False, True, True, True, True]
    assert len({r["root"] for r in out}) == 1 and out[0]["root"] == h("32" * 32, "32" * 32, *["31" * 32] * 3)
    assert manifest.verified(df.where("false")).count() == 0


def test_every_leaf_notices_tampering(spark) -> None:
    df = spark.range(300).select(F.col("id").alias("key"), (F.col("id") % 3).cast("string").alias("group"), manifest.row_digest([F.col("id")]).alias("hash"), F.when(F.col("id") % 2 == 0, manifest.row_digest([F.col("id") + 1])).alias("tampered"))
    assert all(r["verified"] == (r["key"] % 2 == 1) for r in manifest.verified(df).collect())
