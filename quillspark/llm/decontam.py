"""Benchmark decontamination over a distributed positional inverted index.

The index holds (term, document, position) for the rarest terms of the queries' windows (n consecutive item words). It
is written once to the shared folder. A window is looked up by its rarest terms: their posting lists, shifted by the
terms' offsets in the item, must meet at one alignment. What is left is compared word by word with the document (exact
phrase), so nothing false stays, and nothing is lost, since an occurrence of a window holds its rarest terms.

Documents are keyed by 128 bits of their text, so that copies share postings and verdicts, and rows with null or
repeated ids keep their own verdict. Only DataFrame functions are used.

Scale: postings are kept only for terms that windows are looked up by. The item side (vocabulary, anchors) is counted
and broadcast only up to BROADCAST_ROWS rows; beyond that the same joins run as shuffles. Terms frequent in the corpus
are rarely anchors; where an item has no other, its posting list is long, but joins the item side without being
gathered in one task. Texts move only if they may have candidates: rows are split by a table of at most CELLS hash
cells, which is broadcast whatever the size of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_ascii, seeded

#: About 100 bytes a row at most: 20 MB.
BROADCAST_ROWS = 200_000
#: 4 bytes each: 4 MB.
CELLS = 1 << 20
ANCHORS = 2


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of ASCII letters, digits and characters beyond ASCII; null has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def text_key(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [seeded(1, t).alias("k1"), seeded(2, t).alias("k2")]


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def postings(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The positional index of `terms` (term), written: (term, k1, k2, pos) for each place of docs (k1, k2, words)."""
    found = docs.select("k1", "k2", F.posexplode("words").alias("pos", "term")).join(small(terms, n_terms), "term")
    return cut(found.select("term", "k1", "k2", "pos").distinct(), "decontam-postings")


def item_windows(items: DataFrame, n: int) -> DataFrame:
    """(item_id, start, terms): every n consecutive words of an item, or all of a shorter one."""
    length = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(length - n, F.lit(0)))
    return items.where(length > 0).select("item_id", "words", F.explode(starts).alias("start")).select("item_id", "start", F.slice("words", F.col("start") + 1, F.least(F.lit(n), F.size("words"))).alias("terms"))


def anchors(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """(item_id, start, terms, at): the item positions of each window's rarest terms; windows with a term that no document has go."""
    each = windows.select("item_id", "start", F.posexplode("terms").alias("i", "term")).join(frequency, "term", "left")
    order = Window.partitionBy("item_id", "start").orderBy("n", "i")
    whole = Window.partitionBy("item_id", "start")
    rare = each.withColumn("rank", F.row_number().over(order)).withColumn("lost", F.max(F.col("n").isNull()).over(whole))
    rare = rare.where((F.col("rank") <= ANCHORS) & ~F.col("lost")).groupBy("item_id", "start").agg(F.array_sort(F.collect_list(F.col("start") + F.col("i"))).alias("at"))
    return windows.join(rare, ["item_id", "start"])


def find_windows(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Occurrences that survive the index: (k1, k2, item_id, first, terms), first being the place in the document.

    docs: (k1, k2, words); items: (item_id, words), item ids distinct.
    """
    windows = cut(item_windows(items, n), "decontam-windows")
    vocabulary = windows.select(F.explode("terms").alias("term")).distinct()
    n_terms = vocabulary.count()
    spread = docs.select(F.explode("words").alias("term"))
    if n_terms <= BROADCAST_ROWS:
        frequency = spread.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    else:
        frequency = spread.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "term")
    anchored = cut(anchors(windows, cut(frequency, "decontam-frequency")), "decontam-anchors")
    places = anchored.select("item_id", "terms", "start", F.explode("at").alias("at")).select("item_id", "at", F.get("terms", F.col("at") - F.col("start")).alias("term")).distinct()
    places = cut(places, "decontam-places")
    n_places = places.count()
    index = postings(docs, places.select("term").distinct(), min(n_places, n_terms))
    met = index.join(small(places, n_places), "term").select("k1", "k2", "item_id", (F.col("pos") - F.col("at")).alias("shift"), "at")
    met = met.groupBy("k1", "k2", "item_id", "shift").agg(F.collect_set("at").alias("met"))
    # A window is met at its first anchor, and needs the others at the same alignment.
    led = anchored.withColumn("lead", F.element_at("at", 1))
    found = met.withColumn("lead", F.explode("met")).join(small(led, anchored.count()), ["item_id", "lead"]).where(F.size(F.array_except("at", "met")) == 0)
    return found.select("k1", "k2", "item_id", (F.col("shift") + F.col("start")).alias("first"), "terms").where(F.col("first") >= 0)


def proximity_matches(docs: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """(doc_id, phrase_id, first): places where all terms of a phrase stand in order, at most `slop` words off their places.

    docs: (doc_id, text); phrases: (phrase_id, text) of at least one word. The stored index of the phrases' terms is read:
    the posting list of the rarest term is met with the others' by text and a cell of slop + 1 words, so lists are never
    crossed whole. Rows that share a text share its matches.
    """
    keyed = docs.select("doc_id", *text_key(F.col("text")), words(F.col("text")).alias("words"))
    asked = cut(phrases.select("phrase_id", F.posexplode(words(F.col("text"))).alias("i", "term")), "proximity-asked")
    terms = cut(asked.select("term").distinct(), "proximity-terms")
    n_asked = asked.count()
    index = postings(keyed.select("k1", "k2", "words"), terms, terms.count())
    counted = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counted, "term", "left").groupBy("phrase_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "i"))["i"].alias("rare"), F.count(F.lit(1)).alias("length"))
    places = cut(asked.join(rarest, "phrase_id"), "proximity-places")
    marked = index.join(small(places, n_asked), "term").withColumn("shift", F.col("pos") - F.col("i"))
    cell = F.floor(F.col("shift") / (slop + 1))
    lead = marked.where("i = rare").select("k1", "k2", "phrase_id", F.col("shift").alias("at"), F.explode(F.array(*[cell + d for d in (-1, 0, 1)])).alias("cell"))
    near = lead.join(marked.withColumn("cell", cell), ["k1", "k2", "phrase_id", "cell"]).where(F.abs(F.col("shift") - F.col("at")) <= slop)
    met = near.groupBy("k1", "k2", "phrase_id", "length", "at").agg(F.sort_array(F.collect_list(F.struct("pos", "i"))).alias("hits"))
    # In order: the least place of each term after the one before it.
    chain = lambda a, h: F.when(h["i"] == a["next"], F.struct((a["next"] + 1).alias("next"), F.coalesce(a["first"], h["pos"]).alias("first"))).otherwise(a)
    begin = F.struct(F.lit(0).alias("next"), F.lit(None).cast("int").alias("first"))
    found = met.withColumn("chain", F.aggregate("hits", begin, chain)).where(F.col("chain.next") == F.col("length")).select("k1", "k2", "phrase_id", F.col("chain.first").alias("first")).distinct()
    return keyed.select("doc_id", "k1", "k2").join(found, ["k1", "k2"]).select("doc_id", "phrase_id", "first").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 13, numerator: int = 1, denominator: int = 20) -> DataFrame:
    """Rows of docs with n_words, n_hit, hit_items (array<string>, sorted) and contaminated.

    A word is hit if it lies in an occurrence of an item's window; a document is contaminated if it has hits that make
    up numerator / denominator of its words. Items: (item_id, text); items without words are ignored, rows that
    repeat an item id count as one item with the windows of each. Rows of null item id are one item, whose windows
    hit like others; it is the null at the end of hit_items. Null and empty texts have no words and are clean.
    Repeated rows get the same verdict. Other columns pass through; those that carry the new names are replaced.
    An empty items table leaves all clean.
    """
    added = ["n_words", "n_hit", "hit_items", "contaminated"]
    docs = docs.drop(*added)
    own = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    row = docs.select(F.struct(*own).alias("__row"), *text_key(F.col("text")), F.col("text").alias("__text"))
    split = words(F.col("__text")).alias("words")
    bare = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
    # Rows of one item are told apart while windows are looked up.
    bare = bare.withColumn("item_id", F.struct("item_id", F.xxhash64("words").alias("row"))).distinct()
    found = find_windows(row.select("k1", "k2", split), bare, n)
    per_text = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "terms", F.col("item_id.item_id").alias("item_id"))).alias("found"))
    per_text = cut(per_text, "decontam-candidates")
    cell = F.pmod(F.col("k1"), F.lit(CELLS)).cast("int")
    cells = cut(per_text.select(cell.alias("__cell")).distinct(), "decontam-cells")
    row = row.withColumn("__cell", cell)
    clean = row.join(F.broadcast(cells), "__cell", "left_anti").select("__row", F.size(split).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("hit_items"))
    rows = row.join(F.broadcast(cells), "__cell", "left_semi").join(per_text, ["k1", "k2"], "left").select("__row", split, F.coalesce("found", F.array()).alias("found"))
    rows = rows.withColumn("true", F.filter("found", lambda f: F.slice("words", f["first"] + 1, F.size(f["terms"])) == f["terms"]))
    spans = F.array_sort(F.transform("true", lambda f: F.struct(f["first"].alias("a"), (f["first"] + F.size(f["terms"])).alias("b"))))
    union = F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n")), lambda s: s["n"].cast("long"))
    met = rows.select("__row", F.size("words").cast("long").alias("n_words"), union.alias("n_hit"), F.array_sort(F.array_distinct(F.transform("true", lambda f: f["item_id"]))).alias("hit_items"))
    out = clean.unionByName(met).select("__row.*", "n_words", "n_hit", "hit_items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * denominator >= F.col("n_words") * numerator))
