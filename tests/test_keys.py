import random
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from itemloom.functions import keys as K

NUMBERS = st.builds(lambda s, d, e: f"{s}{d}e{e}", st.sampled_from(["", "-"]), st.integers(0, 10**12), st.integers(-60, 60))


@given(NUMBERS, NUMBERS)
def test_numbers_order_like_their_bytes(a, b):
    x, y = K.number_payload(a), K.number_payload(b)
    assert (x < y) == (Decimal(a) < Decimal(b))
    assert (x == y) == (Decimal(a) == Decimal(b))


@given(st.integers(-(10**12), 10**12), st.integers(-40, 40), st.integers(0, 20))
def test_equal_numbers_are_equal_bytes(digits, exponent, zeros):
    assert K.number_payload(f"{digits}e{exponent}") == K.number_payload(f"{digits}{'0' * zeros}E{exponent - zeros}")


@pytest.mark.parametrize("bad", ["1e126", "1e-131", "1" * 39, "NaN", "Infinity"])
def test_numbers_outside_the_domain(bad):
    with pytest.raises(ValueError):
        K.number_payload(bad)


def test_successor():
    assert K.successor(b"ab") == b"ac"
    assert K.successor(b"a\xff\xff") == b"b"
    assert K.successor(b"\xff") is None


@given(st.binary(max_size=4), st.binary(max_size=4), st.binary(max_size=4))
def test_spans(low, high, key):
    span = K.KeySpan(low, high)
    assert span.contains(key) == (low <= key < high)
    both = span.intersection(K.KeySpan(b"\x10", b"\xf0"))
    assert (both is not None and both.contains(key)) == (span.contains(key) and b"\x10" <= key < b"\xf0")
    left = K.KeySpan().resume(key)
    assert left.contains(key + b"\x00") and not left.contains(key)
    assert not K.KeySpan().resume(key, forward=False).contains(key)


def test_binary_keys_keep_their_order(spark):
    r = random.Random(3)
    values = sorted({bytes(r.choice((0, 1, 97, 254, 255)) for _ in range(r.randrange(5))) for _ in range(300)})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v binary")
    assert [r.i for r in df.select("i", K.binary_key(df.v).alias("k")).orderBy("k").collect()] == list(range(len(values)))


def test_number_keys_keep_their_order(spark):
    r = random.Random(4)
    values = sorted({Decimal(r.randrange(-999, 1000)).scaleb(r.randrange(-125, 120)) for _ in range(300)})
    df = spark.createDataFrame([(i, str(v)) for i, v in enumerate(values)], "i int, v string")
    assert [r.i for r in df.select("i", K.number_key(df.v).alias("k")).orderBy("k").collect()] == list(range(len(values)))


def test_segments_are_complete_and_disjoint(spark):
    found = spark.range(2000).select(K.segment(F.col("id"), 7).alias("s")).groupBy("s").count().collect()
    assert sum(r["count"] for r in found) == 2000 and {r.s for r in found} == set(range(7))
