"""Text columns: cleaning, tokens, names, safe casts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bodies that stand for a removed text.
TOMBSTONES = ("[deleted]", "[removed]")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_live(c: Column | str) -> Column:
    """Neither null nor a tombstone."""
    return col(c).isNotNull() & ~col(c).isin(*TOMBSTONES)


def spaced(c: Column | str) -> Column:
    """Lower-cased text of a-z and 0-9 only, every other sign a space, a space at both ends."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", " "), F.lit(" "))


def words(c: Column | str, least: int = 1) -> Column:
    """The a-z0-9 words of a text of at least ``least`` signs, in order."""
    return F.filter(F.split(F.lower(col(c)), "[^a-z0-9]+"), lambda w: F.length(w) >= least)


def text_key(c: Column | str, n: int = 200) -> Column:
    """A key that ignores case, spaces and punctuation: the first ``n`` letters and digits."""
    return F.substring(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", ""), 1, n)


def any_of(terms: Sequence[str], case_sensitive: bool = False) -> str:
    """One pattern for whole terms, the longest first, so that the longest one wins."""
    escaped = ["".join(f"\\{ch}" if not ch.isalnum() and ch not in " _" else ch for ch in t) for t in sorted(set(terms), key=lambda t: (-len(t), t))]
    body = r"\b(" + "|".join(escaped) + r")\b" if escaped else "(?!)"
    return body if case_sensitive else "(?i)" + body


def sentences(c: Column | str) -> Column:
    """Pieces of a text after a full stop, question or exclamation mark."""
    return F.filter(F.split(col(c), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def whole_number(c: Column | str, default: int = 0) -> Column:
    """The integer a text spells, else ``default``."""
    return F.coalesce(col(c).try_cast("int"), F.lit(default))


def without_tags(c: Column | str) -> Column:
    """A text without markup tags."""
    return F.regexp_replace(col(c), "<.*?>", "")


def wiki_title(url: Column | str) -> Column:
    """The readable title of an encyclopedia address: last part of the path, decoded, spaces for underscores."""
    path = F.regexp_extract(F.split(col(url), "#")[0], r"/wiki/([^?]+)", 1)
    return F.when(path != "", F.translate(F.try_url_decode(path), "_", " "))


def person_name(c: Column | str, not_names: Sequence[str] = ("admin", "staff", "editor", "guest", "unknown", "anonymous")) -> Column:
    """A by-line's person: without "by", titles, mail addresses and affiliations; null if what is left is no name."""
    s = F.split(F.regexp_replace(col(c), r"(?i)^\s*(?:written |posted )?by[:\s]+", ""), r"\s*[|/(]")[0]
    s = F.regexp_replace(s, r"\S+@\S+", "")
    s = F.regexp_replace(s, r"(?i)^(?:dr|mr|mrs|ms|prof|sir|sen|rep|gov|hon)\.?\s+", "")
    s = F.regexp_replace(s, r"(?i)[,\s]+(?:ph\.?d|m\.?d|esq|jr|sr|ii|iii)\.?\s*$", "")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    bad = F.lower(s).isin(*not_names) | (F.length(s) < 3) | s.rlike(r"\d")
    return F.when(~bad, s)


def entity_key(c: Column | str) -> Column:
    """An entity's name without a leading article, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(col(c))), "^the ", ""), "[^a-z0-9]", "")


def token_overlap(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of two texts' words; 0 if neither has any."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def acronym(c: Column | str) -> Column:
    """The initials of a name's capitalised words."""
    return F.array_join(F.transform(F.filter(F.split(col(c), r"\s+"), lambda w: w.rlike("^[A-Z]")), lambda w: F.substring(w, 1, 1)), "")


def initials_only(c: Column | str) -> Column:
    """Whether all but the last word of a name are initials."""
    parts = F.split(F.trim(col(c)), r"\s+")
    front = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.forall(front, lambda w: w.rlike(r"^[A-Za-z]\.?$"))


def stars(p: Column | str) -> Column:
    """Significance marks of a p value."""
    p = col(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
