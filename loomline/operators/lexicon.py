"""Dictionary scores of texts, word baselines and keyness."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import spaced, words
from loomline.operators.relational import first_per_key


def lexicon_scores(df: DataFrame, text: str, lexicon: Mapping[str, Sequence[str]], underscores: bool = False) -> DataFrame:
    """``df`` with ``<category>_count`` per category: how many of its terms stand in the text.

    A term counts once however often it occurs, a term listed twice counts twice. Hyphens and apostrophes in a term are
    spaces; a term with an underscore never matches unless ``underscores`` makes them spaces too. All is one projection
    without a shuffle: the text's tokens are met with each category's single words as a set; only the few terms of several
    words are searched for one by one. Null texts score 0.
    """

    def form(term: str) -> str:
        t = term.lower().replace("-", " ").replace("'", " ")
        return t.replace("_", " ") if underscores else t

    terms = {c: Counter(form(t) for t in own) for c, own in lexicon.items()}
    out = df.withColumn("__clean", F.coalesce(spaced(text), F.lit(" ")))
    every = sorted({t for own in terms.values() for t in own if t.strip() and " " not in t})
    # the text's tokens are met once with all terms; categories then look among the few that were met
    met = F.array_intersect(F.array(*(F.lit(t) for t in every)), F.split("__clean", " ")) if every else F.array().cast("array<string>")
    out = out.withColumn("__tokens", met)
    for c, own in terms.items():
        total: Column = F.lit(0)
        for times in range(1, max(own.values(), default=0) + 1):
            layer = [t for t, k in own.items() if k >= times and t.strip()]
            single = [t for t in layer if " " not in t]
            if single:
                total = total + F.size(F.array_intersect(F.array(*(F.lit(t) for t in single)), F.col("__tokens")))
            for t in layer:
                if " " in t:  # a double space in the text parts a phrase, as it parts words
                    total = total + F.contains("__clean", F.lit(f" {t} ")).cast("int")
        out = out.withColumn(f"{c}_count", total.cast("int"))
    return out.drop("__clean", "__tokens")


def like_scores(df: DataFrame, text: str, patterns: Mapping[str, Sequence[str]]) -> DataFrame:
    """``df`` with ``<category>_count``: how many of a category's LIKE patterns the lower-cased text fits."""
    out = df.withColumn("__low", F.lower(text))
    for c, own in patterns.items():
        hits = [F.coalesce(F.col("__low").like(p).cast("int"), F.lit(0)) for p in own]
        out = out.withColumn(f"{c}_count", sum(hits[1:], hits[0]))
    return out.drop("__low")


def word_counts(df: DataFrame, text: str, least: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, ``word``, ``n``."""
    return df.select(*keys, F.explode(words(text, least)).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def keyness(a: DataFrame, b: DataFrame) -> DataFrame:
    """Signed log-likelihood of every word between two tables of ``(word, n)``: ``(word, n1, n2, g2)``.

    Positive where the word's relative frequency is higher in ``a``, else negative; 0 where they are equal.
    """
    n1, n2 = a.agg(F.sum("n")).scalar(), b.agg(F.sum("n")).scalar()
    j = a.select("word", F.col("n").alias("n1")).join(b.select("word", F.col("n").alias("n2")), "word", "full").fillna(0, ["n1", "n2"])
    j = j.withColumn("t1", n1.cast("double")).withColumn("t2", n2.cast("double"))
    whole = (F.col("n1") + F.col("n2")) / (F.col("t1") + F.col("t2"))

    def part(n: str, t: str) -> Column:
        return F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (F.col(t) * whole))).otherwise(0.0)

    more = F.col("n1") / F.col("t1") > F.col("n2") / F.col("t2")
    g2 = 2 * (part("n1", "t1") + part("n2", "t2"))
    return j.select("word", "n1", "n2", (F.when(more, g2).otherwise(-g2) + 0.0).alias("g2"))


def word_lift(df: DataFrame, text: str, positive: str, smooth: float = 0.01) -> DataFrame:
    """``(word, pos, neg, lift)``: in how many positive and other texts a word stands, and their smoothed ratio."""
    w = df.select(F.col(positive).cast("int").alias("__p"), F.explode(F.array_distinct(words(text))).alias("word"))
    g = w.groupBy("word").agg(F.sum("__p").alias("pos"), F.sum(1 - F.col("__p")).alias("neg"))
    return g.withColumn("lift", (F.col("pos") + smooth) / (F.col("neg") + smooth))


def cosine_to_baseline(counts: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, ``cosine``: of each key's word counts, over the baseline's words only, with the baseline's frequencies.

    The baseline is ``(word, freq)``. Keys without any of its words have null.
    """
    norm = baseline.agg(F.sqrt(F.sum(F.col("freq") * F.col("freq")))).scalar()
    j = counts.join(baseline.select("word", "freq"), "word")
    g = j.groupBy(*keys).agg(F.sum(F.col("n") * F.col("freq")).alias("dot"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("own"))
    return g.select(*keys, F.try_divide(F.col("dot"), F.col("own") * norm).alias("cosine"))


def signature_words(df: DataFrame, text: str, candidate: str, least: int = 3, ratio: float = 0.7, top: int = 40) -> DataFrame:
    """``(candidate, word)``: words met at least ``least`` times with a candidate and in that share of all their uses."""
    counts = df.select(candidate, F.explode(words(text, 3)).alias("word")).groupBy(candidate, "word").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("word").agg(F.sum("n").alias("n_all"))
    j = counts.where(F.col("n") >= least).join(totals, "word").where(F.col("n") / F.col("n_all") >= ratio)
    return first_per_key(j, [candidate], [F.desc("n"), F.col("word")], top).select(candidate, "word")


def disambiguated(df: DataFrame, key: str, text: str, signatures: DataFrame, candidate: str, margin: float = 1.5) -> DataFrame:
    """``(key, winner)``: the candidate whose signature words the text holds most; null unless it beats the next by ``margin``."""
    w = df.select(key, F.explode(F.array_distinct(words(text, 3))).alias("word"))
    score = w.join(signatures, "word").groupBy(key, candidate).agg(F.count(F.lit(1)).alias("s"))
    ranked = score.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("m"), F.col(candidate).alias("c")))).alias("r"))
    one, two = -F.col("r")[0]["m"], F.coalesce(-F.try_element_at("r", F.lit(2))["m"], F.lit(0))
    return ranked.select(key, F.when(one >= margin * two, F.col("r")[0]["c"]).alias("winner"))
