"""Personal data in free text: found item by item and replaced by typed placeholders.

Items with a form of their own (electronic and postal addresses, telephone and identity numbers, also in veiled spelling) are
recognised by that form. Names have none, so the corpus tells which terms disclose a person: for every term its co-occurrence
with frames that hold a named person (introductions, contact lines, the parts of mail addresses) is counted over all
rows, and its pointwise mutual information with such frames, log2 P(frame | term) / P(frame), estimates how much the term
reveals. Terms beyond the thresholds are protected, each with the place it takes in a name; a given name or initial next
to a family name is an item, however it is written and whether or not an introduction stands before it. Words that
only look like names (firms, places, streets) occur outside such frames far more often than inside and stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import cut_lineage

#: A protected term lies in frames at least twice, in this share of its occurrences at least, and has this many bits.
LEAST_IN_FRAMES, LEAST_SHARE, LEAST_BITS = 2, 0.08, 4.0
#: Share of a word's pairs that are known names, and bits, from which it introduces persons.
LEAST_INTRO, LEAST_INTRO_BITS = 0.4, 1.0
#: Protected terms up to which the list goes to every task; beyond it, rows are joined with the terms they hold.
TERMS_AT_HAND = 500_000

KINDS = ("email", "id_number", "phone", "address", "name")

# --- fixed values: forms of items ---------------------------------------------------------------------------------
# All forms are matched in the lower-cased text. A cheap sign of each form is looked for first, as most texts hold none.
_AT = r"(?:\s?[@＠]\s?|&#64;|\s*[(\[{<]\s*at\s*[)\]}>]\s*|\s+at\s+(?!(?:the|an?|this|that|it|its)\b))"
_DOT = r"(?:\.|\s\.\s|\s*[(\[{<]\s*dot\s*[)\]}>]\s*|\s+dot\s+)"
EMAIL = re.compile(rf"(?<![\w.+-])[a-z0-9](?:[a-z0-9_%+-]|\.(?=[a-z0-9])){{0,63}}{_AT}[a-z0-9][a-z0-9-]*(?:{_DOT}[a-z0-9][a-z0-9-]*)*?{_DOT}[a-z]{{2,24}}\b(?!{_DOT}[a-z0-9])")

_CUE = (
    r"(?:ssn|social[ -]security(?: (?:number|no\.?))?|soc\. ?sec\.?(?: no\.?)?|steuer-?id(?:nr\.?)?|steueridentifikationsnummer|steuernummer|"
    r"tax[ -]?(?:id|payer (?:id|number)|number|no\.?)|tin|itin|(?:national )?insurance (?:number|no\.?)|ni (?:no\.?|number)|nino|"
    r"passport|reisepass(?:-?nr\.?|nummer)?|passeport|pasaporte|(?:driver['’]?s?|driving)[ -]licen[cs]e|dl|führerschein(?:nummer)?|permis de conduire|"
    r"national[ -]id(?:entity)?(?: (?:number|no\.?|card))?|id[ -]card|personalausweis(?:nummer)?|dni|nie|nif|"
    r"num[ée]ro de s[ée]cu(?:rit[ée] sociale)?|sozialversicherungsnummer|seguridad social|codice fiscale|sv-?nummer|rentenversicherungsnummer|n(?:um[ée]ro)? insee|c[ée]dula(?: de identidad)?|carta d['’]identità|numéro fiscal)"
)
_NUMBER = r"[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d](?!\w)|(?=(?:[a-z]*\d){4})(?=\d*[a-z])[a-z0-9]{7,16}(?!\w)|(?:[a-z]{1,2}[ -]?)?\d(?:[ .-]?\d){5,15}(?:-?[a-z](?!\w))?"
ID_NUMBER = re.compile(
    rf"(?<![a-z]){_CUE}(?:\s*(?:no\.?|nr\.?|num(?:ber|éro)?|#|n°|is|:|=))*[\s#:]*(?P<n>{_NUMBER})(?![\w-]*\d)"
    r"|(?<![\w-])(?P<s>\d{3}-\d{2}-\d{4})(?![\w-])|(?<!\w)(?P<q>(?!bg|gb|nk|kn|tn|nt|zz)[a-z]{2}( ?)\d{2}\4\d{2}\4\d{2}\4[a-d]"
    r"|[a-z]{6}\d{2}[a-ehlmprst]\d{2}[a-z]\d{3}[a-z]|[12] \d{2} (?:0[1-9]|1[0-2]) \d{2} \d{3} \d{3}(?: \d{2})?)(?!\w)"
)
_MIXED = re.compile(r"(?<!\w)(?=\d*[a-z])(?:[a-z]*\d){4}")
_LONG_NUMBER = re.compile(r"\d(?:[ ./()-]{0,2}\d){5}")

_NAMED_DIGITS = ("zero", "oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_DIGIT = rf"(?:{'|'.join(_NAMED_DIGITS)}|\d)"
PHONE = re.compile(
    r"(?<![\w.,/:#+-])(?:"
    r"\+\d{1,3}(?:[ ./-]?(?:\(\d{1,5}\)|\d{1,5})){2,6}"
    r"|00[1-9]\d{0,2}(?:[ ./-]\d{1,5}){2,6}"
    r"|(?:1[ .-]?)?\([2-9]\d{2}\) ?\d{3}[ .-]?\d{4}|(?:1[ .-])?[2-9]\d{2}([ .-])\d{3}\1\d{4}|1?[2-9]\d{2}[2-9]\d{6}"
    r"|[2-9]\d{2}-\d{4}"
    r"|0\d{2,4}/\d{5,9}|0\d{4} ?\d{3} ?\d{3}|0\d(?:[ .]\d{2}){4}|0\d{3} \d{3} \d{4}|0\d{2} \d{4} \d{4}"
    r")(?:,? ?(?:ext|x|extension)\.? ?\d{1,5})?(?![\w-]|[.,/:]\d)"
)
SPELT_PHONE = re.compile(rf"(?<!\w)(?:{_DIGIT}(?:,? |-)){{6,14}}{_DIGIT}(?!\w)")
_SPELT = re.compile("|".join(_NAMED_DIGITS))

_TYPE = r"(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|place|pl|boulevard|blvd|mews|way|terrace|ter|square|sq|crescent|close|row|hill|parkway|pkwy)"
_WORD = r"[^\W\d_][\w'’-]*"
# Little words of the four languages, which are no part of a street's or town's name and end one.
_LITTLE = (
    r"(?:and|or|the|a|an|of|for|on|in|at|was|is|are|were|has|had|have|about|from|to|with|that|by|before|after|since|until|when|while|where|who|which|but|so|because|as|if|last|next|"
    r"yesterday|today|und|oder|ist|war|hat|hatte|vor|nach|seit|bei|mit|letzte[nrs]?|heute|gestern|et|ou|est|avait|avant|après|hier|y|o|es|fue|antes|desde|ayer|hoy)\b"
)
_NO = rf"(?!{_LITTLE}|(?:miles?|emails|pages|replies|times|days|years|minutes|hours|accounts|flights|percent|million|dollars|people|samples|votes|upvotes)\b)"
_UNIT = r"(?:,? ?(?:apt|unit|suite|ste|flat|apartment|no)\.? ?#?\w{1,5}\b|,? ?#\w{1,5})"
_PLACE = rf"(?!{_LITTLE})[^\W\d_][\w'’-]*"
_TOWN = (
    rf"(?P<town>, \d{{4,5}} {_PLACE}(?: {_PLACE}(?=[.,;|/)\n]))?|, {_PLACE}(?: {_PLACE})?(?:, [a-z]{{2}}(?: \d{{5}}\b|(?=[.;|/)\n]|$))| \d{{4,5}}\b)"
    rf"|, {_PLACE}(?: {_PLACE})?(?=[.,;|/)\n]| - | {_LITTLE}|$)| \d{{5}} {_PLACE}(?=[.,;|/)\n]| - | {_LITTLE}|$))?"
)
_STREETS = (
    # the first sign of each form, and the form; the places before a match are checked apart, so that a search can skip to digits
    (
        "",
        rf"\d{{1,5}}(?: ?[a-z])? (?:{_NO}{_WORD} ){{1,3}}?{_TYPE}\b(?!['’])\.?(?:{_UNIT})?{_TOWN}"
        rf"|\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|boulevard|place|chemin|quai|impasse|allée|route)\b(?: (?:de la|de l['’]|des|du|de|d['’]))?"
        rf"(?:(?: ?{_WORD}){{1,3}}?(?=[.,;|/)\n]| - | \d{{5}} | {_LITTLE}|$)|(?: ?{_WORD}){{1,2}}){_TOWN.replace('town', 'town2')}",
    ),
    ("calle ", rf"(?:calle) (?:(?:de la|de los|de las|del|de|las|los|la|el) )?(?:{_WORD},? ){{1,3}}?\d{{1,4}}[a-z]?\b{_TOWN}"),
    ("avenida ", rf"(?:avenida) (?:(?:de la|de los|de las|del|de|las|los|la|el) )?(?:{_WORD},? ){{1,3}}?\d{{1,4}}[a-z]?\b{_TOWN}"),
    ("plaza ", rf"(?:plaza) (?:(?:de la|de los|de las|del|de|las|los|la|el) )?(?:{_WORD},? ){{1,3}}?\d{{1,4}}[a-z]?\b{_TOWN}"),
    *(
        (f"{w} ", rf"(?:{w}) (?:(?:de la|de los|de las|del|della|delle|dei|degli|di|de|san|santa|las|los|la|el) )?(?:{_WORD},? ){{1,3}}?(?:n\.? ?)?\d{{1,4}}[a-z]?\b(?=,? \d{{5}}\b|,? [^\W\d_]|[.;|/)\n]|$){_TOWN}")
        for w in ("paseo", "camino", "carrer", "viale", "piazza", "corso", "via", "vicolo", "largo")
    ),
    ("am ", rf"am (?:{_WORD} ){{1,3}}?\d{{1,4}}[a-z]?\b(?=, | -|[.;|/)\n]|$){_TOWN}"),
    ("der ", rf"an der (?:{_WORD} ){{1,3}}?\d{{1,4}}[a-z]?\b(?=, | -|[.;|/)\n]|$){_TOWN}"),
    ("zu", rf"zu[mr] (?:{_WORD} ){{1,3}}?\d{{1,4}}[a-z]?\b(?=, | -|[.;|/)\n]|$){_TOWN}"),
    ("box", rf"(?:p\. ?o\. ?|po |post office )box \d{{1,6}}{_TOWN}"),
    ("postfach", rf"postfach \d{{1,7}}{_TOWN}"),
    ("", rf"(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig) \d{{1,4}} ?(?:[a-z]\b)?{_TOWN}"),
)
ADDRESS = tuple((sign, re.compile(form)) for sign, form in _STREETS)
_COMMON = ("paseo ", "camino ", "carrer ", "viale ", "piazza ", "corso ", "via ", "vicolo ", "largo ")
_CAPITAL = re.compile(r"[A-ZÀ-Þ][\w'’-]*,? (?:[nN]\.? ?)?\d")  # the word before the number
_FLAT_BEFORE = re.compile(r"(?:flat|apt\.?|unit|apartment) ?#?\w{1,5}, ?$")
_JOINED = re.compile(r"[^\W\d_][\w-]*$")

# Words that introduce a person, by any guide to style; others are learnt from the corpus.
_INTRO = (
    r"(?:called|named|name is|neighbou?r|landlord|landlady|colleague|(?:posted|written|signed|filed) by|[Aa]sk|[Tt]hanks to|contact|friend|boss|cousin|brother|sister|uncle|aunt|wife|husband|"
    r"Herr|Frau|Señora?|M\.|Mme|Mr\.?|Mrs\.?|Ms\.?|Dr\.?)"
)
_CAP = r"[A-ZÀ-Þ][a-zß-ÿ]+(?:[A-Z][a-z]+)?(?:['’-][A-ZÀ-Þ][a-zß-ÿ]+)*|[A-ZÀ-Þ]['’][A-ZÀ-Þ][a-zß-ÿ]+(?:-[A-ZÀ-Þ][a-zß-ÿ]+)*"
FRAME = re.compile(rf"\b{_INTRO} \(?((?:(?:{_CAP}|[A-ZÀ-Þ]\.) )+)((?:{_CAP}))(?=\W)")
CARD = re.compile(rf"((?:(?:{_CAP}|[A-ZÀ-Þ]\.) )+)((?:{_CAP}))(?=[;|/,]? ?[;|/,]? ?(?:\+?\(?\d|<?[\w.+-]+ ?[@(\[]|[Ff]ive|[Pp]\.O))")
_MAIL_NAME = re.compile(r"(?<![\w.+-])([a-z]{3,})[._]([a-z]{3,})(?:\+\w+)?(?:@| ?[(\[]at[)\]] ?| AT | at )", re.I)
_GATE1 = rf"[@＠]|[(\[]at[)\]]| AT |\b{_INTRO} \(?[A-ZÀ-Þ]|[a-z][;|/,] ?[+(\d<]"

#: Two capitalised words with a word before them: what may turn out to be an introduction.
PAIR = re.compile(rf"\b([^\W\d_]{{1,30}}) ({_CAP}) ({_CAP})(?=\W|$)")
_GATE2 = r"[\pL] [\p{Lu}][\pL'’-]+ [\p{Lu}]"

_PARTS = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def _parts(token: str) -> list[str]:
    return [x for x in _PARTS.findall(token.lower()) if len(x) > 1]


def _frames(text: str) -> Iterator[tuple[str, str]]:
    """Terms in frames that hold a person, with their place: ``given``, ``family``, or ``either``."""
    for found in (FRAME.finditer(text), CARD.finditer(text)):
        for m in found:
            for g in m[1].split():
                yield from ((p, "given") for p in _parts(g))
            yield from ((p, "family") for p in _parts(m[2]))
    for m in _MAIL_NAME.finditer(text):
        yield m[1].lower(), "either"
        yield m[2].lower(), "either"


_STATISTICS = "term string, intro string, family_name string, n long, given long, family long, either long"


def term_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Co-occurrence over all rows: ``(term, n, given, family, either)``, the occurrences of each term and those in each place of a
    frame; and ``(term, intro, family_name, n)``, how often two capitalised words stand together after a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _STATISTICS.split(", ")]
        kinds = [pa.string()] * 3 + [pa.int64()] * 4
        for b in batches:
            texts = b.column(0)
            counted = pc.value_counts(pc.list_flatten(pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}]+")))
            term, n = counted.field("values"), counted.field("counts")
            none, zero = pa.nulls(len(term), pa.string()), pa.array([0] * len(term), pa.int64())
            yield pa.RecordBatch.from_arrays([term.cast(pa.string()), none, none, n, zero, zero, zero], names=names)
            met: dict[tuple[str, str | None, str | None], list[int]] = {}
            for t in texts.filter(pc.match_substring_regex(texts, _GATE1)).to_pylist():
                for term_, place in _frames(t):
                    met.setdefault((term_, None, None), [0, 0, 0, 0])[_PLACES[place]] += 1
            for t in texts.filter(pc.match_substring_regex(texts, _GATE2)).to_pylist():
                for m in PAIR.finditer(t):
                    met.setdefault((m[2].lower(), m[1].lower(), m[3].lower()), [0, 0, 0, 0])[0] += 1
            rows = [[*k, *v] for k, v in met.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    sums = [F.sum(c).alias(c) for c in ("n", "given", "family", "either")]
    return rows.mapInArrow(run, _STATISTICS).where("length(term) > 1").groupBy("term", "intro", "family_name").agg(*sums)


_PLACES = {"given": 1, "family": 2, "either": 3}


def learnt_frames(statistics: DataFrame, known: DataFrame) -> DataFrame:
    """``statistics`` of terms with those frames added whose introduction the corpus teaches.

    A word before two capitalised ones introduces persons if these are ``known`` as given and family name in a fair share of its
    occurrences, ``LEAST_INTRO``, and its pointwise mutual information with such pairs is ``LEAST_INTRO_BITS`` at least.
    """
    terms = statistics.where("intro is null").select("term", "n", "given", "family", "either")
    pairs = statistics.where("intro is not null").select("term", "intro", "family_name", "n")
    given = known.where("given").select("term", F.lit(1).alias("g"))
    family = known.where("family").select(F.col("term").alias("family_name"), F.lit(1).alias("f"))
    j = pairs.join(given, "term", "left").join(family, "family_name", "left")
    of = j.groupBy("intro").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("g").isNotNull() & F.col("f").isNotNull(), F.col("n")).otherwise(0)).alias("hit"))
    of = cut_lineage(of)  # one line per word that stands before a pair
    base = of.agg((F.sum("hit") / F.sum("n")).alias("b")).scalar()
    share = F.col("hit") / F.col("n")
    intros = of.where((F.col("hit") >= 3) & (share >= LEAST_INTRO) & (F.log2(share / base) >= LEAST_INTRO_BITS)).select("intro")
    own = pairs.join(intros, "intro", "left_semi")
    zero = F.lit(0).cast("long")
    more = own.select("term", zero.alias("n"), F.col("n").alias("given"), zero.alias("family"), zero.alias("either")).unionByName(
        own.select(F.col("family_name").alias("term"), zero.alias("n"), zero.alias("given"), F.col("n").alias("family"), zero.alias("either"))
    )
    sums = [F.sum(c).alias(c) for c in ("n", "given", "family", "either")]
    return terms.unionByName(more).groupBy("term").agg(*sums)


def protected_terms(statistics: DataFrame) -> DataFrame:
    """``(term, given, family, bits)``: terms that disclose a person, and which places in a name they take."""
    inside = F.col("given") + F.col("family") + F.col("either")
    whole = statistics.agg(F.sum("n").alias("n_all"), F.sum(inside).alias("n_in"))
    base = whole.select(F.try_divide(F.col("n_in"), F.col("n_all")).alias("b")).scalar()
    share = F.least(inside / F.greatest("n", F.lit(1)), F.lit(1.0))
    s = statistics.where(inside >= LEAST_IN_FRAMES).withColumn("share", share)
    s = s.withColumn("bits", F.log2(F.col("share") / base))
    s = s.where((F.col("share") >= LEAST_SHARE) & (F.col("bits") >= LEAST_BITS))
    # a place counts if it is taken in a fair part of the frames that show a place; mail addresses show none
    known = F.col("given") + F.col("family")
    return s.select(
        "term",
        ((known == 0) | (F.col("given") >= 0.2 * known)).alias("given"),
        ((known == 0) | (F.col("family") >= 0.2 * known)).alias("family"),
        "bits",
    )


def corpus_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """The protected terms of a corpus: from the frames that are known, then again with those that these teach. The texts are read once."""
    statistics = cut_lineage(term_statistics(df, text))
    known = cut_lineage(protected_terms(statistics.where("intro is null").drop("intro", "family_name")))
    return cut_lineage(protected_terms(cut_lineage(learnt_frames(statistics, known))))


class Finder:
    """Items in a text. ``terms``: term to (may be given, may be family)."""

    def __init__(self, terms: dict[str, tuple[bool, bool]]) -> None:
        self.terms = terms
        self.automaton = ahocorasick.Automaton()
        for t, (_, family) in terms.items():
            if family:
                self.automaton.add_word(t, t)
        if len(self.automaton):
            self.automaton.make_automaton()

    def _structured(self, low: str, text: str) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []

        def add(start: int, end: int, kind: str) -> None:
            if not any(a < end and start < b for a, b, _ in out):
                out.append((start, end, kind))

        if "@" in low or "＠" in low or "&#64;" in low or ("dot" in low and "at" in low):
            for m in EMAIL.finditer(low):
                add(m.start(), m.end(), "email")
        long = _LONG_NUMBER.search(low)
        if long or _MIXED.search(low):
            for m in ID_NUMBER.finditer(low):
                k = next(k for k in ("n", "s", "q") if m[k])
                if sum(c.isdigit() for c in m[k]) >= 6 or any(c.isalpha() for c in m[k]):
                    add(m.start(k), m.end(k), "id_number")
        for sign, form in ADDRESS:
            if sign in low:
                for m in form.finditer(low):
                    start, end = m.start(), m.end()
                    before = low[max(0, start - 24) : start]
                    if low[start].isdigit():
                        if before[-1:] and (before[-1].isalnum() or before[-1] in "#/.,-_"):
                            continue
                        if flat := _FLAT_BEFORE.search(before):
                            start -= len(before) - flat.start()
                    elif not sign:  # a German street's name ends so and begins before
                        if not (word := _JOINED.search(low[max(0, start - 40) : start])):
                            continue
                        start -= len(word[0])
                    elif before[-1:].isalnum():
                        continue
                    elif sign in _COMMON and not _CAPITAL.search(text, start, m.end()):
                        continue  # a word of other use, and no name of a street after it
                    for group in ("town", "town2"):  # a person after an address is no town
                        if form.groupindex.get(group) and m[group] and any(self.terms.get(p, (0, 0))[1] for p in _parts(m[group])):
                            end = m.start(group)
                    add(start, end, "address")
        if long:
            for m in PHONE.finditer(low):
                if sum(c.isdigit() for c in m[0]) >= 7:
                    add(m.start(), m.end(), "phone")
        if sum(low.count(d) for d in _NAMED_DIGITS) >= 3:
            for m in SPELT_PHONE.finditer(low):
                if len(_SPELT.findall(m[0])) >= 3:
                    add(m.start(), m.end(), "phone")
        return out

    def _role(self, token: str) -> tuple[bool, bool]:
        """Whether a token may be a given and a family name; of a double name its parts decide together."""
        parts = _parts(token)
        if not parts:
            return False, False
        got = [self.terms.get(p, (False, False)) for p in parts]
        return any(g for g, _ in got), any(f for _, f in got)

    def _names(self, text: str, low: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
        if not len(self.automaton) or next(self.automaton.iter(low), None) is None:
            return
        blank = list(text)
        for a, b, _ in taken:
            blank[a:b] = "\x00" * (b - a)
        clean = "".join(blank)
        toks = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(clean)]
        roles = [self._role(t) for _, _, t in toks]

        def initial(i: int) -> bool:
            a, b, t = toks[i]
            return len(t) == 1 and clean[b : b + 1] == "."

        def gap(i: int) -> str:
            return clean[toks[i][1] : toks[i + 1][0]] if i + 1 < len(toks) else "\x00"

        def near(i: int) -> bool:
            """Tokens i and i+1 stand side by side, an initial's full stop aside."""
            g = gap(i)
            return g.strip(" \t") == "" and g != "" or (initial(i) and g[:1] == "." and g[1:].strip(" \t") == "")

        i = 0
        while i < len(toks) - 1:
            given = roles[i][0] or initial(i)
            if given and near(i):
                j = i + 1
                while j + 1 < len(toks) and (initial(j) or (roles[j][0] and len(_parts(toks[j][2])) >= 1 and roles[j + 1][1] and near(j))) and near(j):
                    j += 1
                if roles[j][1] and (roles[i][0] or initial(i)) and not initial(j):
                    yield toks[i][0], toks[j][1], "name"
                    i = j + 1
                    continue
            if roles[i][1] and not initial(i):
                g = gap(i)
                comma = g.startswith(",") and g[1:].strip(" \t") == "" and len(g) <= 3
                if (comma or near(i)) and (roles[i + 1][0] or (comma and initial(i + 1))):
                    end = toks[i + 1][1] + (1 if initial(i + 1) else 0)
                    yield toks[i][0], end, "name"
                    i += 2
                    continue
            i += 1

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """``(start, end, kind)`` in order; nothing inside another item."""
        low = text.lower()
        if len(low) != len(text):  # a few letters grow when lowered; places must stay
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        out = self._structured(low, text)
        out += list(self._names(text, low, out))
        return sorted(out)


def _replaced(text: str, items: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, k in items:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


_OUT = "key {kind}, clean string, kinds array<string>, starts array<int>, ends array<int>"


def _run(finder: Finder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        found = [finder.find(t) if t else [] for t in texts]
        clean = [_replaced(t, f) if f else t for t, f in zip(texts, found, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array(clean, pa.string()),
                pa.array([[k for _, _, k in f] for f in found], pa.list_(pa.string())),
                pa.array([[a for a, _, _ in f] for f in found], pa.list_(pa.int32())),
                pa.array([[e for _, e, _ in f] for f in found], pa.list_(pa.int32())),
            ],
            names=["key", "clean", "kinds", "starts", "ends"],
        )


def sanitised(df: DataFrame, key: str, text: str = "text", at_hand: int = TERMS_AT_HAND) -> DataFrame:
    """``(key, clean, kinds, starts, ends)``: every row's text with a typed placeholder for each item and otherwise unchanged.

    The arrays name the items in order with their places in the given text, counted in characters. A null text stays null, an
    empty one empty, both without items. Items inside another item are not counted. Repeated rows each come out. An empty
    table gives an empty result; other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()
    terms = corpus_terms(df, text)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    listed = terms.limit(at_hand + 1).collect()  # bounded by the parameter
    if len(listed) <= at_hand:
        table = {r["term"]: (r["given"], r["family"]) for r in listed}

        def at_hand_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _run(Finder(table), batches)

        return rows.mapInArrow(at_hand_run, _OUT.format(kind=kind))
    # Beyond the bound every row takes along the protected terms it holds; a row has no more of them than words.
    numbered = rows.withColumn("words", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")))
    held = numbered.select("key", F.explode("words").alias("term")).join(terms, "term")
    held = held.groupBy("key").agg(F.collect_list(F.struct("term", "given", "family")).alias("terms"))
    joined = rows.join(held, "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # all terms of a batch together: a row holds no other protected term than its own
            own = {x["term"]: (x["given"], x["family"]) for x in pc.list_flatten(b.column(2)).to_pylist()}
            yield from _run(Finder(own), iter([b.select([0, 1])]))

    return joined.select("key", "text", "terms").mapInArrow(run, _OUT.format(kind=kind))


def items(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, kind, nth)``: every item, counted per kind within its row from 1."""
    s = sanitised(df, key, text).where(F.size("kinds") > 0)
    times = lambda k: F.size(F.filter("kinds", lambda x: x == k))
    each = F.array(*(F.struct(F.lit(k).alias("kind"), times(k).alias("n")) for k in KINDS))
    e = s.select("key", F.explode(F.filter(each, lambda x: x["n"] > 0)).alias("e"))
    return e.select("key", F.col("e.kind").alias("kind"), F.explode(F.sequence(F.lit(1), F.col("e.n"))).alias("nth"))
