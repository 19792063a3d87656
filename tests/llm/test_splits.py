import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm.splits import allocate, components, cost, deviation, grouped, shares, split_rows, together

SCHEMA = "delivery_no long, author string, id string, has_link int, row long, root string"


def brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a, i in rows:
        a = (a or "").strip().lower()
        a = a[3:] if a.startswith("/u/") else a[2:] if a.startswith("u/") else a
        i = (i or "").strip().lower()
        i = i[3:] if i[:3] in ("t1_", "t3_") else i
        find(("r", n))
        if a not in ("", "[deleted]", "[removed]", "automoderator"):
            parent[find(("a", a))] = find(("r", n))
        if i:
            parent[find(("i", i))] = find(("r", n))
    groups = {}
    for n, _, _ in rows:
        groups.setdefault(find(("r", n)), set()).add(n)
    return groups.values()


def frame(spark, rows):
    return spark.createDataFrame([(*r, r[0] % 2, 0, "clash") for r in rows], SCHEMA)


def test_groups_equal_union_find(spark):
    rnd = random.Random(2)
    names = [f"user{i}" for i in range(25)] + ["[deleted]", None, "AutoModerator", ""]
    spell = [lambda s: s, lambda s: f"u/{s}", lambda s: f" /u/{s.upper()} "]
    rows = []
    for n in range(260):
        a = rnd.choice(names)
        a = rnd.choice(spell)(a) if a and not a.startswith("[") else a
        i = rnd.choice([f"k{rnd.randrange(230)}", f"T1_K{rnd.randrange(230)}", None, "t1_"])
        rows.append((n, a, i))
    rows += [(1000 + n, "hot", f"h{n}") for n in range(150)]
    want = {(min(g), x) for g in brute([(n, a, None if i == "t1_" else i) for n, a, i in rows]) for x in g if x != min(g)}
    assert {tuple(r) for r in together(frame(spark, rows), "delivery_no", "author", "id").collect()} == want
    s = {r["row"]: r["split"] for r in split_rows(frame(spark, rows), "delivery_no", "author", "id", "has_link").collect()}
    assert len(s) == len(rows) and set(s.values()) == {"train", "validation", "test"}
    assert all(len({s[x] for x in g}) == 1 for g in brute([(n, a, None if i == "t1_" else i) for n, a, i in rows]))


def test_rows_without_identity_stay_alone(spark):
    df = frame(spark, [(1, None, None), (2, None, None), (3, "[removed]", "t1_"), (4, "", "")])
    assert len({r["root"] for r in grouped(df, "delivery_no", "author", "id").collect()}) == 4
    assert together(df, "delivery_no", "author", "id").count() == 0


def test_repeated_rows_keep_their_number(spark):
    df = frame(spark, [(1, "a", "x"), (1, "a", "x"), (2, "b", "y")])
    assert sorted(r["row"] for r in split_rows(df, "delivery_no", "author", "id").collect()) == [1, 1, 2]


def test_empty(spark):
    df = frame(spark, [])
    assert grouped(df, "delivery_no", "author", "id").count() == 0
    assert split_rows(df, "delivery_no", "author", "id", "has_link").count() == 0


def test_same_seed_same_split(spark):
    df = frame(spark, [(i, f"a{i // 3}", f"k{i}") for i in range(200)])
    one, two, other = ({tuple(r) for r in split_rows(df.repartition(p), "delivery_no", "author", "id", seed=s).collect()} for p, s in ((2, 1), (5, 1), (2, 2)))
    assert one == two != other
    share = sum(s == "train" for _, s in one) / 200
    assert abs(share - 0.8) < 0.02


def test_long_chain(spark):
    links = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(70)], "a string, b string")
    assert {r["root"] for r in components(links).collect()} == {"n000"}
    assert components(links.limit(0)).count() == 0


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(-1, 2), st.integers(1, 80)), min_size=1, max_size=25, unique_by=lambda x: x[:2]))
@settings(max_examples=60, deadline=None)
def test_allocation_is_whole_and_near_the_quotas(bundles):
    size, profile, count = (np.array(x) for x in zip(*bundles, strict=True))
    ratios = np.array([0.8, 0.1, 0.1])
    x = allocate(size, profile, count, ratios)
    assert (x >= 0).all() and (x.sum(1) == count).all()
    off = (x * size[:, None]).sum(0) - (size * count).sum() * ratios
    assert np.abs(off).max() <= size.max() + 1e-6


def test_ratios_are_parameters(spark):
    df = frame(spark, [(i, f"a{i}", f"k{i}") for i in range(90)])
    got = [r["split"] for r in split_rows(df, "delivery_no", "author", "id", ratios={"x": 2, "y": 1}).collect()]
    assert got.count("x") == pytest.approx(60, abs=1)


def parts(n, k):
    """All ways to spread n units over k splits."""
    return [x for x in itertools.product(range(n + 1), repeat=k) if sum(x) == n]


def least_cost(size, profile, count, ratios):
    ways = [parts(n, len(ratios)) for n in count]
    return min(cost(deviation(size, profile, count, ratios, np.array(x))[0]) for x in itertools.product(*ways))


@given(st.integers(1, 50), st.lists(st.tuples(st.integers(-1, 2), st.integers(1, 5)), min_size=1, max_size=3, unique_by=lambda x: x[0]), st.sampled_from([(0.8, 0.1, 0.1), (0.5, 0.5), (2, 1, 1)]))
@settings(max_examples=60, deadline=None)
def test_units_of_one_size_are_allocated_at_least_cost(size, bundles, ratios):
    profile, count = (np.array(x) for x in zip(*bundles, strict=True))
    size, ratios = np.full(len(bundles), float(size)), np.array(ratios, float)
    got = cost(deviation(size, profile, count, ratios, allocate(size, profile, count, ratios))[0])
    assert got == pytest.approx(least_cost(size, profile, count, ratios))


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 1), st.integers(1, 4)), min_size=2, max_size=4, unique_by=lambda x: x[:2]))
@settings(max_examples=60, deadline=None)
def test_several_sizes_leave_no_move_or_exchange_that_lowers_the_cost(bundles):
    size, profile, count = (np.array(x) for x in zip(*bundles, strict=True))
    ratios = np.array([0.6, 0.3, 0.1])
    x = allocate(size, profile, count, ratios)
    price = lambda y: cost(deviation(size, profile, count, ratios, y)[0])
    moves = [(b, i, j) for b in range(len(size)) for i in range(3) for j in range(3) if i != j]
    for steps in [*((m,) for m in moves), *itertools.combinations(moves, 2)]:
        if len(steps) == 2 and not (steps[0][1] == steps[1][2] and steps[0][2] == steps[1][1]):
            continue  # an exchange goes there and back
        y = x.copy()
        for b, i, j in steps:
            y[b, i] -= 1
            y[b, j] += 1
        if (y >= 0).all():
            assert price(y) >= price(x) - 1e-6


def test_single_rows_make_the_quotas_exact():
    size, profile, count = np.array([900, 77, 13, 1, 1]), np.array([0, 1, 0, 0, 1]), np.array([1, 3, 20, 3000, 2000])
    x = allocate(size, profile, count, np.array([0.8, 0.1, 0.1]))
    off, _ = deviation(size, profile, count, np.array([0.8, 0.1, 0.1]), x)
    assert np.abs(off.sum(0)).max() <= 1 and np.abs(off).max() <= 2


def test_shares(spark):
    df = frame(spark, [(i, f"a{i}", f"k{i}") for i in range(200)])
    got = {r["split"]: r for r in shares(df, "delivery_no", "author", "id", "has_link").collect()}
    assert {k: (r["n_rows"], r["n_label"]) for k, r in got.items()} == {"train": (160, 80), "validation": (20, 10), "test": (20, 10)}
    assert {r["n_rows"] for r in shares(df.limit(0), "delivery_no", "author", "id").collect()} == {0}


def test_a_hot_author_goes_whole(spark):
    df = frame(spark, [(i, "hot" if i % 3 == 0 else f"a{i}", f"k{i}") for i in range(3000)])
    got = {r["row"]: r["split"] for r in split_rows(df, "delivery_no", "author", "id").collect()}
    assert len(got) == 3000 and len({got[i] for i in range(0, 3000, 3)}) == 1
    assert {tuple(r) for r in together(df, "delivery_no", "author", "id").collect()} == {(0, i) for i in range(3, 3000, 3)}
