"""Near-duplicate texts: exact similarity classes by prefix filtering.

Texts are compared as sets of word shingles. Equal texts are one representative from the start. The shingles of a
representative are put in order of rarity; two sets can only reach the threshold if they share one of the first
``size - ceil(threshold * size) + 1`` of them. These prefixes are met by an equi join on rare shingles, candidates are verified
exactly, and verified links are closed to classes. No link between different texts is lost and no cap is set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.components import connected
from loomline.session import cut_lineage


def shingle_sets(df: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """``(key, shingles)``: the hashed distinct ``n``-word shingles of a text; a shorter text is one shingle of all its words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    d = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), words.alias("w")).where(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    return d.select("key", F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice("w", i, n)))).alias("shingles"))


def similar_pairs(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(a, b, similarity)`` with a < b: all pairs of distinct sets ``(key, shingles)`` at or above the Jaccard threshold."""
    df_ = sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    each = sets.select("key", F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
    # a shingle that only one set has can join nothing, but it takes its place in the order
    ranked = each.join(df_, "s").groupBy("key", "size").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("o"))
    length = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    prefix = ranked.select("key", "size", F.explode(F.slice("o", F.lit(1), length.cast("int"))).alias("x"))
    prefix = prefix.where("x.n > 1").select("key", "size", F.col("x.s").alias("s"))
    a, b = prefix.alias("a"), prefix.alias("b")
    fits = (F.col("a.key") < F.col("b.key")) & (F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * threshold - 1e-9)
    pairs = a.join(b, (F.col("a.s") == F.col("b.s")) & fits).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()
    j = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    similarity = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return j.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicates(df: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``(key, class_id, class_size, n_links)`` of every text with words.

    ``class_id`` is the least key of the class, ``n_links`` the number of different texts it is linked to at the threshold.
    Null and wordless texts have no row.
    """
    s = shingle_sets(df, key, text, n)
    sets = s.groupBy(F.sort_array("shingles").alias("shingles")).agg(F.min("key").alias("key"))
    member = cut_lineage(s.select(F.col("key").alias("member"), F.sort_array("shingles").alias("shingles")).join(sets, "shingles").select("member", "key"))
    sets = cut_lineage(sets.select("key", "shingles"))
    pairs = cut_lineage(similar_pairs(sets, threshold))
    roots = connected(pairs.select("a", "b"))
    both = pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    m = member.join(roots.withColumnRenamed("node", "key"), "key", "left").join(both, "key", "left")
    m = m.select("member", F.coalesce("root", "key").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    sizes = m.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return m.join(sizes, "class_id").select(F.col("member").alias(key), "class_id", "class_size", "n_links")
