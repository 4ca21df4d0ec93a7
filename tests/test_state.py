"""Stateful streams: late and repeated events and a restart give the batch answer."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest

from quillspark.streaming import state as S
from quillspark.streaming.log import run_once

T0 = dt.datetime(2024, 5, 1, 12)


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    S.rocksdb_state(spark)
    yield spark
    spark.conf.set(name, before)


def test_coalesced_stream_equals_the_batch(store, tmp_path) -> None:
    rng = random.Random(4)
    rows = [(f"j{j}", seq, rng.choice(["progress"] * 6 + ["log", "done"]), float(seq), T0 + dt.timedelta(milliseconds=j * 17 + seq * rng.choice([70, 90]))) for j in range(3) for seq in range(60)]
    rows = [r for j in range(3) for r in sorted((r for r in rows if r[0] == f"j{j}"), key=lambda r: r[1])]
    # ts ascends with seq.
    fixed, last = [], {}
    for job, seq, kind, value, ts in rows:
        ts = max(ts, last.get(job, T0) + dt.timedelta(milliseconds=1))
        last[job] = ts
        fixed.append((job, seq, kind, value, ts))
    schema = "job string, seq long, kind string, value double, ts timestamp"
    sent = sorted(fixed, key=lambda r: r[4])
    # Some come late, within the watermark, and some twice.
    late = rng.sample(sent, 20)
    first = [r for r in sent if r[4] < T0 + dt.timedelta(seconds=3) and r not in late]
    second = [r for r in sent if r not in first] + rng.sample(first, 10)
    tick = lambda s: [("tick", s, "log", None, T0 + dt.timedelta(seconds=s))]
    for i, batch in enumerate([first, second, tick(60), tick(120), tick(180)]):
        store.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
        stream = store.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        # A new query each time: what was waiting comes from the checkpoint.
        run_once(S.coalesced(stream), lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/checkpoint", "append")
    got = sorted(map(tuple, store.read.parquet(f"{tmp_path}/out").where("job <> 'tick'").collect()))
    want = sorted(map(tuple, S.coalesced_batch(store.createDataFrame(fixed, schema)).collect()))
    assert got == want and 0 < len(want) < len(fixed)
    assert {r[:2] for r in got} >= {r[:2] for r in fixed if r[2] != "progress"}


def test_claims_keep_owners_and_exclusive_kinds_apart(store, tmp_path) -> None:
    rng = random.Random(9)
    schema = "queue string, job string, owner string, kind string, priority int, takes_ms long, ts timestamp"
    jobs = [(f"q{i % 2}", f"job{i:02d}", f"o{rng.randint(0, 3)}", rng.choice(["small", "small", "large"]), rng.randint(0, 2), rng.choice([500, 2500, 4000]), T0 + dt.timedelta(milliseconds=rng.randint(0, 8000))) for i in range(30)]
    ticks = [(q, f"tick{q}{s}", "none", "tick", -9, 1, T0 + dt.timedelta(seconds=s)) for q in ("q0", "q1") for s in (300, 600)]
    for i, batch in enumerate([jobs[::2], jobs[1::2] + jobs[:3], ticks[::2], ticks[1::2]]):
        store.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = store.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        run_once(S.claims(stream, "20 seconds", alone=("large",)), lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/checkpoint", "append")
    rows = [r for r in store.read.parquet(f"{tmp_path}/out").collect() if r["kind"] != "tick"]
    assert sorted(r["job"] for r in rows) == sorted(j[1] for j in jobs)
    takes = {j[1]: j[5] for j in jobs}
    runs = [(r["queue"], r["owner"], r["kind"], r["at"], r["at"] + dt.timedelta(milliseconds=takes[r["job"]])) for r in rows]
    for a, b in itertools.combinations(runs, 2):
        if a[0] == b[0] and a[3] < b[4] and b[3] < a[4]:
            assert a[1] != b[1] and "large" not in (a[2], b[2])
