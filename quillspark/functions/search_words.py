"""Words of a search: folding, what a query asks for, marked words and snippets, as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = (
    "a", "au", "aux", "avec", "ce", "ces", "cet", "cette", "d", "dans", "de", "des", "du",
    "elle", "en", "et", "il", "ils", "j", "je", "l", "la", "le", "les", "leur", "lui", "m", "ma",
    "mais", "me", "mes", "mon", "n", "ne", "nous", "on", "ou", "par", "pas", "pour", "qu", "que",
    "qui", "s", "sa", "se", "ses", "son", "sur", "t", "ta", "te", "tes", "ton", "tu", "un", "une",
    "vos", "votre", "vous", "y", "est", "sont",
    "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "its",
    "of", "or", "that", "the", "their", "this", "to", "was", "were", "with",
)
MAX_TERMS = 12
MIN_PREFIX = 4
SNIPPET = 240

WORD = r"[\p{L}\p{N}_]+"
PHRASE = '"([^"]+)"'


@cache
def fold_table() -> tuple[str, str]:
    """Characters whose decomposition without marks, case folded, is one other character, and those characters."""
    source, target = [], []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if not 0xD800 <= code <= 0xDFFF and not unicodedata.combining(c):
            plain = _folded(c)
            if len(plain) == 1 and plain != c and code <= 0xFFFF and ord(plain) <= 0xFFFF and not 0xAC00 <= code <= 0xD7A3:
                source.append(c)
                target.append(plain)
    return "".join(source), "".join(target)


def _folded(text: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return unicodedata.normalize("NFC", bare).casefold()


def fold_all(c: Column) -> Column:
    """Without accents and case: compatibility forms decomposed, combining marks dropped, sharp s and ligatures spelled out."""
    source, target = fold_table()
    bare = F.regexp_replace(F.translate(F.lower(c), source, target), r"\p{M}+", "")
    for one, more in (("ß", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("…", "...")):
        bare = F.replace(bare, F.lit(one), F.lit(more))
    return bare


def words(c: Column) -> Column:
    """The folded words of a text, in order."""
    return F.regexp_extract_all(fold_all(c), F.lit(f"({WORD})"), 1)


def query_terms(query: Column) -> Column:
    """struct(terms, phrases): the loose words and the phrases in quotes of a query, each once and at most MAX_TERMS.

    Quoted single words are loose words. Common words go unless nothing else is asked for. Null asks for nothing.
    """
    query = F.coalesce(query, F.lit(""))
    quoted = F.transform(F.regexp_extract_all(query, F.lit(PHRASE), 1), words)
    phrases = F.array_distinct(F.filter(quoted, lambda p: F.size(p) > 1))
    single = F.flatten(F.filter(quoted, lambda p: F.size(p) == 1))
    loose = F.concat(words(F.regexp_replace(query, PHRASE, " ")), single)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    kept = F.filter(loose, lambda w: ~F.array_contains(stop, w))
    asked = F.when((F.size(kept) == 0) & (F.size(phrases) == 0), loose).otherwise(kept)
    return F.struct(F.slice(F.array_distinct(asked), 1, MAX_TERMS).alias("terms"), F.slice(phrases, 1, MAX_TERMS).alias("phrases"))


@dataclass(frozen=True)
class Asked:
    """A query parsed on the driver, by the same rules as query_terms()."""

    terms: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...] = ()

    def match(self, word: Column) -> Column:
        """Does a folded word match one of the terms: words of MIN_PREFIX letters or more as beginnings, others whole."""
        out = F.lit(False)
        for t in self.terms:
            out = out | (word.startswith(t) if len(t) >= MIN_PREFIX else word == t)
        return out


def marked_words(text: Column, asked: Asked) -> Column:
    """array<struct(a, z)>: the places [a, z) of the words of a text that are asked for, in code points. Null has none."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), 1)
    folded = F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), F.when(p.rlike(WORD), fold_all(p)).alias("w")))

    def hits(all_: Column) -> Column:
        """The parts with `ok`: words and what is between them take turns, so that the next word is two parts on."""

        def hit(x: Column, i: Column) -> Column:
            ok = asked.match(x["w"])
            for p in asked.phrases:
                for k in range(len(p)):
                    first = i - 2 * k
                    same = F.lit(True)
                    for j, w in enumerate(p):
                        same = same & F.coalesce(F.get(all_, first + 2 * j)["w"] == w, F.lit(False))
                    ok = ok | F.when(first >= 0, same).otherwise(F.lit(False))
            return F.struct(x["n"].alias("n"), (x["w"].isNotNull() & ok).alias("ok"))

        return F.transform(all_, hit)

    # One fold gives each hit its place; what is none only moves it on, and only hits are appended.
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,z:int>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        z = s["at"] + p["n"]
        return F.struct(z.alias("at"), F.when(p["ok"], F.array_append(s["out"], F.struct(s["at"].alias("a"), z.alias("z")))).otherwise(s["out"]).alias("out"))

    return F.aggregate(F.get(F.transform(F.array(folded), hits), F.lit(0)), begin, step, lambda s: s["out"])


def flat_lines(text: Column) -> Column:
    """Trimmed lines that are not empty, joined by a middle dot."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.trim(x)), lambda x: x != ""), " · ")


def snippet(flat: Column, ranges: Column, size: int = SNIPPET) -> Column:
    """At most `size` characters of a text around its densest group of marked words, cut between words, with ellipses.

    ranges: as marked_words() gives; without any the beginning is shown.
    """

    def made(b: Column) -> Column:
        text, marks = b["t"], b["r"]
        # Words are apart, so that those which begin with a mark and fit are among the next size / 2.
        ahead = lambda i: F.sequence(i, F.least(F.size(marks) - 1, i + size // 2 + 1))
        held = F.transform(marks, lambda x, i: F.struct(F.size(F.filter(ahead(i), lambda j: F.get(marks, j)["z"] <= x["a"] + size)).alias("n"), (-i).alias("i"), x["a"].alias("a")))
        lead = F.least(F.greatest(F.lit(0), F.array_max(held)["a"] - size // 4), F.length(text) - size)
        before = F.instr(F.reverse(F.substring(text, F.lit(1), lead)), " ")
        start = F.when(F.size(marks) == 0, 0).when(lead <= 0, 0).otherwise(F.when(before > 0, lead - before + 1).otherwise(0))
        return F.struct(text.alias("t"), start.alias("s"))

    def cut(b: Column) -> Column:
        text, start = b["t"], b["s"]
        end = F.least(F.length(text), start + size)
        half = F.substring(text, start + size // 2 + 1, end - start - size // 2)
        space = F.instr(F.reverse(half), " ")
        end = F.when((end < F.length(text)) & (space > 0), end - space).otherwise(end)
        shown = F.substring(text, start + 1, end - start)
        return F.concat(F.when(start > 0, "…").otherwise(""), shown, F.when(end < F.length(text), "…").otherwise(""))

    one = F.transform(F.transform(F.array(F.struct(flat.alias("t"), ranges.alias("r"))), made), cut)
    return F.when(F.length(flat) <= size, flat).otherwise(F.get(one, F.lit(0)))


def recognised_fold(c: Column) -> Column:
    """The search form of recognised text: folded, with ligatures spelled out."""
    out = fold_all(c)
    for one, more in (("œ", "oe"), ("æ", "ae")):
        out = F.replace(out, F.lit(one), F.lit(more))
    return out


def sentence_case(title: Column, proper: Column) -> Column:
    """A title in sentence case: capitalised words after the first are lowered unless they are names.

    proper: array of names of the inputs; they count in the singular and the plural, without accents. Words with capitals
    inside or only capitals stay. After an apostrophe the part that follows is judged. The first word with a letter or digit
    gets its capital if it has none.
    """
    names = F.transform(proper, fold_all)
    parts = F.split(title, r"(?<=\s)|(?=\s)")
    has = lambda p: p.rlike(r"[\p{L}\p{N}]")

    def judged(all_: Column) -> Column:
        first = F.array_min(F.filter(F.transform(all_, lambda p, i: F.when(has(p), i)), lambda i: i.isNotNull()))

        def word(p: Column, i: Column) -> Column:
            core = F.regexp_extract(p, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1)
            key = fold_all(core)
            name = F.exists(names, lambda n: (n == key) | (n == F.concat(key, F.lit("s"))) | (n == F.regexp_replace(key, "s$", "")))
            lower = core.rlike(r"^\p{Lu}[^\p{Lu}]*$") & core.rlike(r"\p{Ll}|^.$") & ~((F.length(core) == 1) & core.rlike(r"^\p{Lu}$")) & ~name
            lowered = F.concat(F.regexp_extract(p, r"^(.*?)[\p{L}\p{N}]+[^\p{L}\p{N}]*$", 1), F.lower(core), F.regexp_extract(p, r"[\p{L}\p{N}]([^\p{L}\p{N}]*)$", 1))
            lead = F.regexp_extract(p, r"^([^\p{L}\p{N}]*)", 1)
            begun = F.concat(lead, F.upper(F.substring(p, F.length(lead) + 1, F.lit(1))), F.substring(p, F.length(lead) + 2, F.length(p)))
            return F.when(~has(p), p).when(i == first, F.when(p.rlike(r"\p{Lu}"), p).otherwise(begun)).otherwise(F.when(lower, lowered).otherwise(p))

        return F.array_join(F.transform(all_, word), "")

    return F.get(F.transform(F.array(parts), judged), F.lit(0))
