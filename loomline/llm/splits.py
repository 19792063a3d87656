"""Train, validation and test splits that never part records of one author or one identifier.

Components. Rows with the same account or the same id belong together. Every id is reduced to its distinct accounts first;
only ids with several accounts link accounts, and on those links alone connected components are found by alternating
large-star and small-star steps, each cut from its lineage in reliable storage. All other rows have their component at hand:
their account, else their id's account, else their id, else themselves.

Allocation. Components of the same size and label profile are alike and form a bundle. Bundles are the sources of a flow,
splits its sinks with quotas; a unit is a component. The fractional optimum sends the given share of every bundle to every
split; its whole part is fixed. The few units left are sent by min-cost flow, one size at a time from the largest: all units
of a size weigh the same rows, so that the network profile -> split -> sink, whose arcs cost the convex deviation from the
quotas of rows per profile and of all rows, has an integral optimum, which successive shortest paths and the cancelling of
negative residual cycles reach. Components of several sizes together pose a partition problem that no flow solves; there
every size is solved again, and two components of different sizes exchanged, as long as that lowers the cost. Nothing
bounds the number of steps: each lowers the cost, so that they end. Which members of a bundle go where is decided by a
seeded hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.identifiers import account, full_name
from loomline.operators.relational import skew_join
from loomline.session import cut_lineage, forget


#: How much a split's deviation in rows counts against its deviation in rows of one profile.
WHOLE = 400.0


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (hi, lo): neighbours of each node are linked to the least of its neighbourhood."""
    both = edges.select("hi", "lo").unionAll(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))) if large else edges
    least = both.groupBy("hi").agg(F.least(F.col("hi"), F.min("lo")).alias("m"))
    j = both.join(least, "hi")
    if large:
        out = j.where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    else:
        out = j.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo").unionAll(least.select("hi", F.col("m").alias("lo")))
    return out.where("hi > lo").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of the undirected links ``(a, b)``; root is the least node of its component."""
    e = edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = cut_lineage(e)
    stamp = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")))
    before = None
    while True:
        now = e.agg(stamp.alias("s")).first()["s"]
        if now == before or now[0] == 0:
            break
        before, old = now, e
        e = cut_lineage(_stars(_stars(e, large=True), large=False))
        forget(old)
    nodes = e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def grouped(df: DataFrame, row: str, author: str, ident: str, kind: str = "t1") -> DataFrame:
    """``(row, root)``: the component of every row; rows have the same root iff they must share a split.

    A null or non-account author and a null or bare id link nothing; a row with neither is a component of its own. Rows that
    are repeated share whatever they share. An empty table gives an empty result; other columns are not read.
    """
    # spellings are resolved once; what is read again below is this narrow table
    rows = cut_lineage(df.select(F.col(row).alias("row"), account(author).alias("acct"), full_name(ident, kind).alias("key")))
    pairs = rows.where("acct is not null and key is not null").select("key", "acct").distinct()
    of_id = pairs.groupBy("key").agg(F.min("acct").alias("least"), F.max("acct").alias("most"))
    links = pairs.join(of_id.where("least < most").select("key", "least"), "key").select(F.col("least").alias("a"), F.col("acct").alias("b"))
    roots = components(links)
    nameless = rows.where("acct is null")
    # an id without any account links its own rows; the id stands for them
    by_id = nameless.where("key is not null").join(of_id.select("key", "least"), "key", "left").select("row", "key", F.col("least").alias("acct"))
    alone = nameless.where("key is null").select("row", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("acct"))
    known = rows.where("acct is not null").select("row", "key", "acct").unionByName(by_id).unionByName(alone)
    r = known.join(roots, known["acct"] == roots["node"], "left")
    root = F.coalesce(
        F.concat(F.lit("a:"), F.coalesce("root", "acct")), F.concat(F.lit("i:"), F.col("key")), F.concat(F.lit("r:"), F.col("row").cast("string"))
    )
    return r.select("row", root.alias("root"))


def together(df: DataFrame, row: str, author: str, ident: str, kind: str = "t1") -> DataFrame:
    """``(a, b)``: a is the lowest row of a component, b each other row of it."""
    g = cut_lineage(grouped(df, row, author, ident, kind))
    least = cut_lineage(g.groupBy("root").agg(F.min("row").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    pairs = skew_join(g, least.select("root", "a"), least, "root", "n")
    return pairs.where("row != a").select("a", F.col("row").alias("b"))


def deviation(size: np.ndarray, profile: np.ndarray, count: np.ndarray, ratios: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows too many per profile and split, and each bundle's line in that table."""
    classes, p = np.unique(profile, return_inverse=True)
    total = np.bincount(p, size * count, minlength=len(classes))
    off = -total[:, None] * (ratios / ratios.sum())
    for s in range(len(ratios)):
        off[:, s] += np.bincount(p, x[:, s] * size, minlength=len(classes))
    return off, p


def cost(off: np.ndarray) -> float:
    """What deviations cost: their squares per profile and split, and ``WHOLE`` times those of whole splits."""
    return float((off**2).sum() + WHOLE * (off.sum(0) ** 2).sum())


class _Flow:
    """The units of one size: a flow from profiles over splits to a sink with convex costs, on top of all others' deviations."""

    def __init__(self, x: np.ndarray, off: np.ndarray, lines: np.ndarray, size: float) -> None:
        self.x, self.off, self.lines, self.size = x, off, lines, size  # x: (profiles of this size, splits), off: all profiles
        self.p, self.k = x.shape

    def arcs(self) -> np.ndarray:
        """Costs of the residual arcs between profiles, splits and sink, in this order; infinite where there is none."""
        z, n = self.size, self.p + self.k + 1
        c = np.full((n, n), np.inf)
        cell, whole = self.off[self.lines], self.off.sum(0)
        c[: self.p, self.p : n - 1] = 2 * cell * z + z * z
        c[self.p : n - 1, : self.p] = np.where(self.x > 0, -2 * cell * z + z * z, np.inf).T
        c[self.p : n - 1, n - 1] = WHOLE * (2 * whole * z + z * z)
        c[n - 1, self.p : n - 1] = np.where(self.x.sum(0) > 0, WHOLE * (-2 * whole * z + z * z), np.inf)
        return c

    def push(self, path: list[int]) -> None:
        for a, b in zip(path, path[1:], strict=False):
            for here, there, sign in ((a, b, 1), (b, a, -1)):
                if here < self.p <= there < self.p + self.k:
                    self.x[here, there - self.p] += sign
                    self.off[self.lines[here], there - self.p] += sign * self.size

    @staticmethod
    def least(c: np.ndarray) -> float:
        """What a path's cost must fall by to count, against the rounding of costs of this magnitude."""
        return 1e-9 + 1e-12 * float(np.abs(c[np.isfinite(c)]).max())

    def relaxed(self, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, int]:
        """Predecessors on the shortest paths from distances ``d``, and a node that still fell after as many rounds as nodes, else -1."""
        before, fell, eps = np.full(len(d), -1), -1, self.least(c)
        for _ in range(len(d) + 1):
            step = d[:, None] + c
            low = step.min(0)
            lower = low < np.where(np.isfinite(d), d - eps, np.inf)
            if not lower.any():
                return before, -1
            before[lower] = step.argmin(0)[lower]
            d, fell = np.where(lower, low, d), int(np.flatnonzero(lower)[0])
        return before, fell

    def send(self, left: np.ndarray) -> None:
        """One unit of each profile in ``left`` after the other along the shortest residual path."""
        n = self.p + self.k + 1
        self.cancel()
        while left.any():
            before, _ = self.relaxed(self.arcs(), np.where(np.r_[left > 0, np.zeros(n - self.p, bool)], 0.0, np.inf))
            path = [n - 1]
            while before[path[0]] >= 0 and len(path) <= n:
                path.insert(0, int(before[path[0]]))
            if len(path) > n:
                raise ArithmeticError("a residual path without a beginning")
            left[path[0]] -= 1
            self.push(path)
        self.cancel()

    def cancel(self) -> bool:
        """Pushes a unit around negative cycles until there is none, which means that the flow costs least."""
        changed = False
        while True:
            c = self.arcs()
            before, fell = self.relaxed(c, np.zeros(len(c)))
            if fell < 0:
                return changed
            for _ in range(len(c)):
                fell = int(before[fell])
            cycle = [fell]
            while len(cycle) == 1 or cycle[0] != fell:
                cycle.insert(0, int(before[cycle[0]]))
            if sum(c[a, b] for a, b in zip(cycle, cycle[1:], strict=False)) >= -self.least(c):
                return changed
            self.push(cycle)
            changed = True


def _exchange(x: np.ndarray, off: np.ndarray, p: np.ndarray, size: np.ndarray) -> bool:
    """Swaps the two components of different bundles that lower the cost most; says whether there were any."""
    whole, chosen = off.sum(0), None
    best = -1e-9 - 1e-12 * WHOLE * float(size.max() * (size.max() + np.abs(whole).max()))  # more than rounding
    for i, j in ((i, j) for i in range(x.shape[1]) for j in range(x.shape[1]) if i != j):
        a, b = np.flatnonzero(x[:, i] > 0), np.flatnonzero(x[:, j] > 0)
        if not len(a) or not len(b):
            continue
        sa, sb = size[a], size[b]
        go = 2 * sa * (off[p[a], j] - off[p[a], i]) + 2 * sa**2  # profile costs of a: i -> j and b: j -> i
        come = 2 * sb * (off[p[b], i] - off[p[b], j]) + 2 * sb**2
        for at in range(0, len(a), 512):
            u = slice(at, at + 512)
            net = sa[u, None] - sb[None]
            gain = go[u, None] + come[None] - 4 * sa[u, None] * sb[None] * (p[a][u, None] == p[b][None])
            gain += WHOLE * (2 * net * (whole[j] - whole[i]) + 2 * net**2)
            low = np.unravel_index(int(gain.argmin()), gain.shape)
            if gain[low] < best:
                best, chosen = gain[low], (int(a[u][low[0]]), int(b[low[1]]), i, j)
    if chosen is None:
        return False
    one, two, i, j = chosen
    for b, s, t in ((one, i, j), (two, j, i)):
        x[b, s] -= 1
        x[b, t] += 1
        off[p[b], s] -= size[b]
        off[p[b], t] += size[b]
    return True


def allocate(size: np.ndarray, profile: np.ndarray, count: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Whole units of each bundle per split: integers of shape (bundles, splits) whose rows add up to ``count``."""
    size, count = size.astype(np.float64), count.astype(np.int64)
    x = np.floor(count[:, None] * (ratios / ratios.sum()) + 1e-9).astype(np.int64)
    if not len(size):
        return x
    off, p = deviation(size, profile, count, ratios, x)
    sizes = np.unique(size)[::-1]
    own = {s: np.flatnonzero(size == s) for s in sizes}

    def solve(s: float, left: np.ndarray | None) -> bool:
        f = _Flow(x[own[s]], off, p[own[s]], float(s))
        changed = f.cancel() if left is None else f.send(left) is None
        x[own[s]] = f.x
        return changed

    for s in sizes:
        solve(s, count[own[s]] - x[own[s]].sum(1))
    changed = True
    while changed:
        changed = any([solve(s, None) for s in sizes])
        while _exchange(x, off, p, size):
            changed = True
    return x


def split_rows(
    df: DataFrame, row: str, author: str, ident: str, label: str | None = None, ratios: dict[str, float] | None = None, seed: int = 0, kind: str = "t1"
) -> DataFrame:
    """``(row, split)``: rows spread over ``ratios`` (name to share of the rows), components kept whole.

    ``label`` names a 0/1 column; components are profiled by which third of 0..1 its mean falls in, or by having none, and
    every profile is spread by the ratios too. A component larger than a split's quota goes where it deviates least. The
    same seed gives the same splits. The driver holds one line per bundle: their number is at most four times the number of
    distinct component sizes, which for n rows is below the square root of 2n.
    """
    ratios = ratios or {"train": 0.8, "validation": 0.1, "test": 0.1}
    spark = df.sparkSession
    g = cut_lineage(grouped(df, row, author, ident, kind))
    value = F.lit(None).cast("double")
    members = g
    if label:
        marks = df.select(F.col(row).alias("row"), F.col(label).cast("double").alias("value"))
        members, value = g.join(marks, "row"), F.avg("value")
    comps = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), value.alias("value") if label else F.first(value).alias("value"))
    comps = cut_lineage(comps.select("root", "size", F.coalesce(F.least(F.floor(F.col("value") * 3), F.lit(2)), F.lit(-1)).cast("int").alias("profile")))
    bundles = comps.groupBy("size", "profile").agg(F.count(F.lit(1)).alias("n")).orderBy("size", "profile").toPandas()
    x = allocate(bundles["size"].to_numpy(), bundles["profile"].to_numpy(), bundles["n"].to_numpy(), np.array(list(ratios.values()), float))
    limits = [(int(s), int(p), [int(v) for v in np.cumsum(u)]) for s, p, u in zip(bundles["size"], bundles["profile"], x, strict=True)]
    limit = spark.createDataFrame(limits, "size long, profile int, upto array<long>")
    # Rank by hash within the bundle, in two steps, so that no task holds a whole bundle: hash buckets, then inside a bucket.
    h = comps.withColumn("h", F.xxhash64(F.lit(seed), "root")).withColumn("bucket", F.shiftright(F.col("h"), 48))
    sums = h.groupBy("size", "profile", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size", "profile").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("size", "profile", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("size", "profile", "bucket").orderBy("h", "root"))
    ranked = h.withColumn("rank", inside).join(sums, ["size", "profile", "bucket"]).join(F.broadcast(limit), ["size", "profile"])
    names = F.array(*(F.lit(n) for n in ratios))
    at = F.size(F.filter("upto", lambda u: u < F.col("before") + F.col("rank")))
    chosen = ranked.select("root", F.element_at(names, at + 1).alias("split"))
    return skew_join(g, chosen, comps, "root", "size").select("row", "split")


def shares(df: DataFrame, row: str, author: str, ident: str, label: str | None = None, ratios: dict[str, float] | None = None, seed: int = 0, kind: str = "t1") -> DataFrame:
    """``(split, target_share, n_rows, share, n_label)``: what :func:`split_rows` gave each split; a split without rows has 0."""
    ratios = ratios or {"train": 0.8, "validation": 0.1, "test": 0.1}
    wanted = df.sparkSession.createDataFrame([(k, v / sum(ratios.values())) for k, v in ratios.items()], "split string, target_share double")
    rows = split_rows(df, row, author, ident, label, ratios, seed, kind)
    value = F.col(label).cast("long") if label else F.lit(None).cast("long")
    marks = df.select(F.col(row).alias("row"), value.alias("value"))
    g = cut_lineage(rows.join(marks, "row").groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("value"), F.lit(0)).alias("n_label")))
    everything = g.agg(F.sum("n_rows")).scalar()
    n = F.coalesce("n_rows", F.lit(0))
    return wanted.join(F.broadcast(g), "split", "left").select(
        "split", "target_share", n.alias("n_rows"), F.coalesce(F.try_divide(n, everything), F.lit(0.0)).alias("share"), F.coalesce("n_label", F.lit(0)).alias("n_label")
    )
