"""Mentions of entities in texts: spans, windows, contexts, attribution.

Patterns over places in a text have no column expression; they run over Arrow batches, behind a native filter that only lets
texts with a mention through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import any_of

_QUOTED = re.compile(r"^[ \t]*(?:>|&gt;).*$", re.M)
_LINK = re.compile(r"https?://\S+")
_TOKEN = re.compile(r"\b\w+\b")


def pattern_of(entities: Sequence[str]) -> re.Pattern[str]:
    """Whole entities in any letter case, the longest first."""
    body = "|".join(re.escape(e) for e in sorted(set(entities), key=lambda e: (-len(e), e)))
    return re.compile(rf"\b(?:{body})\b" if body else r"(?!)", re.I)


def own_spans(text: str, pattern: re.Pattern[str]) -> list[tuple[int, int]]:
    """Places of the mentions that do not lie inside a quoted line."""
    quoted = [m.span() for m in _QUOTED.finditer(text)]
    return [m.span() for m in pattern.finditer(text) if not any(a <= m.start() and m.end() <= b for a, b in quoted)]


def window_of(text: str, start: int, end: int, n: int = 15) -> str:
    """A mention with up to ``n`` words before and after it."""
    return " ".join([*text[:start].split()[-n:], text[start:end], *text[end:].split()[:n]])


def _rows(df: DataFrame, key: str, text: str, entities: Sequence[str]) -> DataFrame:
    return df.where(F.col(text).rlike(any_of(entities))).select(F.col(key).alias("key"), F.col(text).alias("text"))


def _mapped(df: DataFrame, schema: str, each: Callable[[object, str], Iterator[tuple[object, ...]]]) -> DataFrame:
    types = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.strip().split(" ") for x in schema.split(", ")]
    form = pa.schema([(name, types[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in each(k, t)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), form, strict=True)], schema=form)

    return df.mapInArrow(run, schema)


def mentions(df: DataFrame, key: str, text: str, entities: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(key, entity, n, first, window, is_list_dump)``: one row per text and entity it mentions outside quoted lines.

    ``window`` joins the words around all mentions; a window of two links or more is a dump of links, not a statement.
    """
    patterns = {e: pattern_of(forms) for e, forms in entities.items()}
    kind = df.schema[key].dataType.simpleString()

    def each(k: object, t: str) -> Iterator[tuple[object, ...]]:
        for e, p in patterns.items():
            if spans := own_spans(t, p):
                w = " ".join(window_of(t, a, b) for a, b in spans)
                yield k, e, len(spans), spans[0][0], w, len(_LINK.findall(w)) >= 2

    every = [f for forms in entities.values() for f in forms]
    return _mapped(_rows(df, key, text, every), f"key {kind}, entity string, n int, first int, window string, is_list_dump boolean", each)


def contexts(df: DataFrame, key: str, text: str, entities: Sequence[str], stop: Sequence[str] = (), n: int = 15) -> DataFrame:
    """``(key, word)``: words within ``n`` tokens of a mention, once per mention; stop words and numbers drop out.

    A mention is placed at the first occurrence of its tokens, so a repeated one gives the same context again.
    """
    pattern, stops = pattern_of(entities), frozenset(stop)
    kind = df.schema[key].dataType.simpleString()

    def each(k: object, t: str) -> Iterator[tuple[object, ...]]:
        tokens = _TOKEN.findall(t.lower())
        for m in pattern.finditer(t):
            own = _TOKEN.findall(m[0].lower())
            size = len(own)
            at = next((i for i in range(len(tokens) - size + 1) if tokens[i : i + size] == own), None)
            if at is not None:
                for w in tokens[max(0, at - n) : at] + tokens[at + size : at + size + n]:
                    if w not in stops and not w.isdigit():
                        yield k, w

    return _mapped(_rows(df, key, text, entities), f"key {kind}, word string", each)


def snippets(df: DataFrame, key: str, text: str, term: str, around: int = 100, most: int = 3) -> DataFrame:
    """``(key, nth, snippet)``: the text ``around`` each of the first ``most`` mentions, with ellipses where it is cut. Native expressions only.

    Mentions do not overlap; a null text and one without the term give no row.
    """
    low = F.lower(F.col(text))
    rows = df.where(F.contains(low, F.lit(term.lower()))).withColumn("__gaps", F.transform(F.split(low, re.escape(term.lower())), F.length))
    nth = F.explode(F.sequence(F.lit(1), F.least(F.size("__gaps") - 1, F.lit(most))))
    rows = rows.withColumn("nth", nth)
    # the texts before a mention and the mentions before it
    at = F.aggregate(F.slice("__gaps", 1, F.col("nth")), F.lit(0), lambda a, g: a + g) + (F.col("nth") - 1) * len(term) + 1
    start = F.greatest(at - around, F.lit(1))
    stop = F.least(at + len(term) + around, F.length(text) + 1)
    body = F.substr(F.col(text), start, stop - start)
    return rows.select(
        F.col(key), "nth", F.concat(F.when(start > 1, "...").otherwise(""), body, F.when(stop <= F.length(text), "...").otherwise("")).alias("snippet")
    )


_PAST = {"say": "said", "tell": "told", "write": "wrote", "make": "made", "build": "built", "hide": "hid", "lie": "lied", "cover up": "covered up", "set up": "set up"}


def told_forms(verb: str) -> tuple[str, str]:
    """How a verb tells of someone else: its third person and its past."""
    first, _, rest = verb.partition(" ")
    rest = rest and f" {rest}"
    y = first[-1] == "y" and first[-2] not in "aeiou"
    third = f"{first[:-1]}ies" if y else f"{first}es" if first.endswith(("sh", "ch", "ss", "x", "z")) else f"{first}s"
    past = f"{first[:-1]}ied" if y else f"{first}d" if first.endswith("e") else f"{first}ed"
    return third + rest, _PAST.get(verb, past + rest)


@dataclass(frozen=True)
class Language:
    """What a caller takes for the naming of a source, for an accusation and for a standing. Verbs are given in their plain form."""

    introducing: tuple[str, ...] = ("according to", "citing", "quoting", "per", "in the words of", "in an interview with", "as reported by", "as stated by", "sources within")
    reporting: tuple[str, ...] = ("say", "tell", "state", "report", "claim", "confirm", "warn", "write", "announce", "testify", "admit", "publish", "leak", "release", "reveal")
    accusing: tuple[str, ...] = ("make", "create", "build", "fund", "hide", "lie", "fake", "stage", "rig", "cover up", "set up")
    #: What may follow an accusing verb without accusing: who "made a point" made nothing up.
    harmless: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {"make": ("point", "sense", "statement", "decision", "mistake", "living", "career", "name", "claim", "choice", "difference")})
    standing: tuple[str, ...] = ("doctor", "dr.", "ph.d.", "professor", "scientist", "researcher", "expert", "historian", "journalist", "engineer", "author", "physician", "veteran", "insider", "whistleblower")
    #: Signs from a mention to what is said of it, and words up to which it is said with high and with medium confidence.
    reach: int = 120
    bands: tuple[tuple[int, str], ...] = ((3, "high"), (8, "medium"))

    def signs(self) -> re.Pattern[str]:
        """One pattern over all verbs and introductions; the group that matched is the kind of sign."""
        some = lambda xs: "|".join(re.escape(x) for x in sorted(xs, key=lambda x: (-len(x), x)))
        report = some([f for v in self.reporting for f in told_forms(v)])
        accuse = "|".join(
            rf"(?:{some(told_forms(v))})\b" + (rf"(?!\s+(?:an?\s+|the\s+)?(?:{some(self.harmless[v])})s?\b)" if v in self.harmless else "") for v in self.accusing
        )
        return re.compile(rf"\b(?:(?P<before>{some(self.introducing)})|(?P<after>{report})|(?P<accused>{accuse}))(?!\w)", re.I)

    def standings(self) -> re.Pattern[str]:
        nouns = "|".join(re.escape(x) for x in self.standing)
        return re.compile(rf"(?:,|\bis|\bwas)\s+(?:an?|the)\s+(?:[^\s,]+\s+){{0,5}}?(?:{nouns})(?!\w)", re.I)


_ORDINARY = Language()


@lru_cache(maxsize=64)
def _patterns(introducing: tuple[str, ...], reporting: tuple[str, ...], accusing: tuple[str, ...], harmless: tuple[tuple[str, tuple[str, ...]], ...], standing: tuple[str, ...]) -> tuple[re.Pattern[str], re.Pattern[str]]:
    language = Language(introducing, reporting, accusing, dict(harmless), standing)
    return language.signs(), language.standings()


def attribution(text: str, start: int, end: int, others: Sequence[str] = (), language: Language = _ORDINARY) -> tuple[str, str]:
    """``(form, confidence)`` that the entity at these places is cited as a source: high, medium, low or none.

    The sign next to the mention gives the form: an introduction ``before`` it, a verb of reporting ``after`` it, or a ``standing``
    that is claimed for it. Another entity in between, or an accusation nearer than the sign, leaves little of it; a standing
    claimed for one who is accused is no citation. Else the words in between decide.
    """
    signs, standings = _patterns(language.introducing, language.reporting, language.accusing, tuple(sorted(language.harmless.items())), language.standing)
    low, high = max(0, start - language.reach), min(len(text), end + language.reach)
    gaps: dict[str, str] = {}  # per kind of sign the words between it and the mention, the fewest signs of text first
    for m in signs.finditer(text, low, high):
        kind = m.lastgroup or ""
        if kind == "before" and m.end() <= start:
            gaps[kind] = text[m.end() : start]  # a later one lies nearer
        elif kind != "before" and m.start() >= end:
            gaps.setdefault(kind, text[end : m.start()])
    if m := standings.search(text, end, high):
        gaps["standing"] = text[end : m.start()]
    accused = gaps.pop("accused", None)
    if not gaps:
        return "none", "none"
    form = min(gaps, key=lambda k: (len(gaps[k]), k))
    between = gaps[form]
    if accused is not None and (form == "standing" or len(accused) < len(between)):
        return form, "none" if form == "standing" and len(accused) >= len(between) else "low"
    if others and pattern_of(others).search(between):
        return form, "low"
    words = len(between.split())
    return form, next((name for most, name in language.bands if words <= most), "low")


CONFIDENCE = ("none", "low", "medium", "high")


def attributed(df: DataFrame, key: str, text: str, entities: Mapping[str, Sequence[str]], language: Language = _ORDINARY) -> DataFrame:
    """``(key, entity, form, confidence)`` of every mention, sentence by sentence."""
    patterns = {e: pattern_of(f) for e, f in entities.items()}
    kind = df.schema[key].dataType.simpleString()

    def each(k: object, t: str) -> Iterator[tuple[object, ...]]:
        for s in re.split(r"(?<=[.!?])\s+", t):
            for e, p in patterns.items():
                others = [f for o, forms in entities.items() if o != e for f in forms]
                for m in p.finditer(s):
                    yield k, e, *attribution(s, m.start(), m.end(), others, language)

    every = [f for forms in entities.values() for f in forms]
    return _mapped(_rows(df, key, text, every), f"key {kind}, entity string, form string, confidence string", each)


def strongest_confidence(attributions: DataFrame) -> DataFrame:
    """``(key, confidence)``: the strongest of a row's mentions."""
    rank: Column = F.array_position(F.array(*(F.lit(c) for c in CONFIDENCE)), F.col("confidence"))
    return attributions.groupBy("key").agg(F.max_by("confidence", rank).alias("confidence"))


def credential_names(df: DataFrame, key: str, text: str, trigger: str = r"\b(?:professor|doctor|scientist|engineer|whistleblower|veteran)\b", reach: int = 60) -> DataFrame:
    """``(key, name)``: capitalised runs of one to three words within ``reach`` signs of a word of standing."""
    near, name = re.compile(trigger, re.I), re.compile(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+){0,2}\b")
    kind = df.schema[key].dataType.simpleString()

    def each(k: object, t: str) -> Iterator[tuple[object, ...]]:
        for m in near.finditer(t):
            for x in name.finditer(t[max(0, m.start() - reach) : m.end() + reach]):
                yield k, x[0]

    rows = df.where(F.col(text).rlike("(?i)" + trigger)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return _mapped(rows, f"key {kind}, name string", each)
