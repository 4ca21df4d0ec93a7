"""Text columns: folding, tokens, cleaning, cutting, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and their plain forms, in pairs.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

#: Function words by language, fixed values.
FUNCTION_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "with", "for", "was"],
    "fr": ["le", "la", "les", "de", "et", "un", "une", "du", "des", "est"],
    "de": ["der", "die", "und", "das", "ist", "von", "mit", "ein", "eine", "den"],
    "es": ["el", "los", "las", "que", "con", "para", "una", "del", "por", "se"],
}


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.lower(F.translate(c, ACCENTED, PLAIN))


def tokens(c: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def clean_untrusted(c: Column) -> Column:
    """Without control and bidirectional-format characters and markup fences; white space collapsed."""
    bare = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]|[​-‏‪-‮⁦-⁩]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"</?[A-Za-z][^<>]*>", " "), r"[ \t\r\n]+", " "))


def cut_words(c: Column, limit: int) -> Column:
    """At most `limit` characters, cut between words, with an ellipsis where something went."""
    flat = F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))
    short = F.regexp_replace(F.substring(flat, 1, limit), r" [^ ]*$", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(short, F.lit("…")))


def token_estimate(c: Column) -> Column:
    """About four characters a token, at least one for a text that is not empty."""
    return F.ceil(F.length(c) / 4).cast("long")


def function_word_hits(c: Column, language: str) -> Column:
    words = F.array(*[F.lit(w) for w in FUNCTION_WORDS[language]])
    return F.size(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.array_contains(words, t)))


def language_of(c: Column, least: int = 3) -> Column:
    """The language with most function words; null below `least` hits. Ties go to the first by name."""
    best = F.array_max(F.array(*[F.struct(function_word_hits(c, x).alias("n"), F.lit(-i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(sorted(FUNCTION_WORDS))]))
    return F.when(best["n"] >= least, best["x"])


def csv_field(c: Column) -> Column:
    """A field that a spreadsheet neither splits nor runs as a formula (separator ;)."""
    safe = F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.when(safe.rlike('[;"\\r\\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def markdown_cell(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[\r\n]+", " "), r"([\\|*_`\[\]<>])", r"\\$1")


def clock(seconds: Column) -> Column:
    """HH:MM:SS.mmm of a number of seconds."""
    ms = F.floor(seconds * 1000 + 0.5).cast("long")
    two = lambda x, n=2: F.lpad(x.cast("string"), n, "0")
    return F.concat(two(F.floor(ms / 3600000)), F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit("."), two(ms % 1000, 3))


def timecode(frame: Column, fps: int) -> Column:
    """HH:MM:SS:FF, wrapped at 24 hours, without dropped frames."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    f = frame % (24 * 3600 * fps)
    return F.concat_ws(":", two(F.floor(f / (3600 * fps))), two(F.floor(f / (60 * fps)) % 60), two(F.floor(f / fps) % 60), two(f % fps))


def natural_key(c: Column) -> Column:
    """Sort key with digit runs padded, so that 10 comes after 9."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p)), "")


def content_key(*cols: Column) -> Column:
    """Hash of the parts, separated so that shifting text between them changes it."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]), 256)
