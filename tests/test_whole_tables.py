"""Queries over whole tables against brute force: enrichment of every hit, and what a translation memory lacks."""

import hashlib
from collections import Counter

from quillspark.operators import relational as R
from quillspark.plans.registry import QUERIES


def test_every_hit_is_enriched(spark, small):
    of = lambda t: spark.read.parquet(f"{small}/{t}.parquet").collect()
    orders, customer, nation = ({r[k]: r for r in of(t)} for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("nation", "n_nationkey")))
    want = Counter()
    for r in of("lineitem"):
        o = orders.get(r["l_orderkey"])
        c = customer.get(o["o_custkey"]) if o else None
        n = nation.get(c["c_nationkey"]) if c else None
        want[(r["l_orderkey"], r["l_linenumber"], o and o["o_orderstatus"], c and c["c_name"], n and n["n_name"])] += 1
    assert Counter(map(tuple, QUERIES["left_enrich_hits"](spark, small).collect())) == want


def test_wanted(spark):
    sources = [("hi", None), ("hi", "de"), ("beige", "en"), ("chat", "fr"), ("mot", "fr"), ("mot", "fr"), ("", "en"), (None, "en"), ("seul", "fr")]
    known = [("beige", "fr", "beige"), ("chat", "en", "cat"), ("hi", "fr", "salut"), ("seul", "en", "seul"), ("seul", "fr", "seul")]
    got = R.wanted(spark.createDataFrame(sources, "text string, language string"), spark.createDataFrame(known, "text string, target string, answer string")).collect()
    want = {("hi", "en", 1), ("beige", "en", 2), ("mot", "en", 1), ("", "fr", 1)}
    assert len(got) == len(want) and {(r["text"], r["target"], r["pass"]) for r in got} == want


def test_short_texts_are_wanted(spark, small):
    asked = {r["text"] for r in spark.read.parquet(f"{small}/conversations.parquet").collect()} - {None}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    known = {(r["text"], r["lang"]) for r in docs}
    sources = {(t, None) for t in asked} | {(r["text"], r["lang"]) for r in docs if r["text"] is not None}
    want = set()
    for t, own in sources:
        for target in {"fr": ["en"], "en": ["fr"]}.get(own, ["fr", "en"]):
            if (t, target) not in known:
                want.add((hashlib.sha256(t.encode()).hexdigest(), target))
    got = [(r["key"], r["target"]) for r in QUERIES["translation_wanted"](spark, small).collect()]
    assert len(got) == len(set(got)) and set(got) == want
