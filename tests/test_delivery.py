import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.operators.delivery import SeenRanges, deliver_once, repeated_deliveries

ROW = "delivery_no long, id string, pos string, number long, ok int"


def found(df):
    return sorted(r["pos"] for r in repeated_deliveries(df).collect())


@given(st.lists(st.lists(st.integers(0, 200), max_size=30), max_size=10), st.integers(1, 6))
@settings(max_examples=80, deadline=None)
def test_ranges_accept_each_number_once(batches, bits):
    ranges, seen = SeenRanges(bits), set()
    for batch in batches:
        ok = ranges.accept(np.array(batch, np.int64))
        for n, o in zip(batch, ok, strict=True):
            assert o == (n not in seen)
            seen.add(n)
        assert all(ranges.end[:-1] < ranges.start[1:])
        assert all(ranges.start >> bits == ranges.end >> bits)
        assert int((ranges.end - ranges.start + 1).sum()) == len(seen)


def test_spellings_nulls_malformed_and_clashing_columns(spark):
    rows = [
        (1, "15cj", "x", 1, 1),
        (2, " T1_15CJ\n", "x", 1, 1),
        (3, None, None, None, None),
        (4, None, None, None, None),
        (5, "t1_", "x", 1, 1),
        (6, "", "x", 1, 1),
        (7, "t1_", "x", 1, 1),
        (8, "015cj", "x", 1, 1),  # a leading zero is another text, not the same number
        (9, "a b/ü", "x", 1, 1),
        (10, "A B/Ü", "x", 1, 1),
        (11, "zzzzzzzzzzzzzzzzzz", "x", 1, 1),  # beyond 64 bits
        (12, "zzzzzzzzzzzzzzzzzz", "x", 1, 1),
        (13, "t3_15cj", "x", 1, 1),  # another kind is another thing
        (14, "15cj", "x", 1, 1),
    ]
    df = spark.createDataFrame(rows, ROW)
    assert found(df) == [2, 10, 12, 14]
    assert found(df.orderBy(df.delivery_no.desc()).repartition(3)) == [2, 10, 12, 14]
    once = deliver_once(df)
    assert once.columns == df.columns
    assert sorted(r[0] for r in once.collect()) == [1, 3, 4, 5, 6, 7, 8, 9, 11, 13]


def test_empty_and_single(spark):
    assert found(spark.createDataFrame([], ROW)) == []
    assert found(spark.createDataFrame([(1, "a", None, None, None)], ROW)) == []


def test_positions_missing_or_tied(spark):
    df = spark.createDataFrame([(None, "a", "", 0, 0), (5, "a", "", 0, 0), (5, "a", "", 0, 0), (6, "a", "", 0, 0)], ROW)
    assert found(df) == [5, 6]


def test_one_identifier_holds_a_third(spark):
    rng = np.random.default_rng(0)
    ids = [np.base_repr(int(n), 36).lower() if i % 3 else "hot" for i, n in enumerate(rng.integers(10**9, 10**9 + 3000, 6000))]
    rows = [(i, k, None, None, None) for i, k in enumerate(ids)]
    seen, want = set(), []
    for i, k in enumerate(ids):
        if k in seen:
            want.append(i)
        seen.add(k)
    df = spark.createDataFrame(rows, ROW).repartition(5)
    assert found(df) == want


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_producer_block_size_changes_nothing(spark, digits):
    df = spark.createDataFrame([(i, k, None, None, None) for i, k in enumerate(["aaa", "aab", "aaa", "zz", "ZZ", "aab"])], ROW)
    assert sorted(r["pos"] for r in repeated_deliveries(df, seq_digits=digits).collect()) == [2, 4, 5]
