import datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from remitta.functions import columns as C
from remitta.functions import values as V
from pyspark.sql import functions as F

TEXTS = ["", "0", "-1", "+1", "12.345", "12.3", ".5", "5.", ".", "-", " 1", "1e3", "99999999999999999999", "007", "20240229", "20230229", "991231", "000101", "00000101", "20241301", "1260", "2359", "235959", "2359599", "23595999", "240000", "1\n", "12.30", "-0.5", "1" * 38, "1" * 39]


def test_columns_agree_with_values(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "x string").select("x", C.parse_n(F.col("x")).alias("n"), C.parse_r(F.col("x"), 2).alias("r"), C.parse_dt(F.col("x")).alias("d"), C.parse_tm(F.col("x")).alias("t"), C.parse_unsigned(F.col("x")).alias("u")).collect()
    for r in rows:
        b = r.x.encode()
        assert (r.n, r.d, r.t) == (V.parse_n(b), V.parse_dt(b), V.parse_tm(b)), r
        assert r.r == V.parse_r(b, 2) or (r.r is None and len(b) > 36), r


@settings(max_examples=100, deadline=None)
@given(st.decimals(allow_nan=False, allow_infinity=False, places=2, min_value=-10**9, max_value=10**9))
def test_decimals_survive_their_text(d):
    assert V.parse_r(V.decimal_element(d), 2) == d


@given(st.dates(datetime.date(1950, 1, 1), datetime.date(2049, 12, 31)), st.integers(0, 86_399))
def test_dates_and_times_survive_their_text(d, s):
    assert V.parse_dt(V.date_element(d)) == V.parse_dt(V.date_element(d, 6)) == d
    assert V.parse_tm(V.time_element(s)) == s


def test_conversions():
    assert V.rescale(Decimal("1.50"), 1) == Decimal("1.5") and V.whole(3.0) == 3
    for bad in (lambda: V.rescale(Decimal("1.55"), 1), lambda: V.whole(1.5), lambda: V.whole(2**63), lambda: V.whole(float("nan")), lambda: V.date_of(datetime.datetime(2024, 1, 1, 1)), lambda: V.seconds_of(1500, 1000)):
        with pytest.raises(V.ConvertError):
            bad()
    for bad in (lambda: V.date_element(datetime.date(1900, 1, 1), 6), lambda: V.time_element(86_400), lambda: V.seconds_of(90_000), lambda: V.time_element(1, 4)):
        with pytest.raises(V.ElementTextError):
            bad()
    assert V.decimal_element(Decimal("100")) == b"100" and V.decimal_element(Decimal("0.00")) == b"0" and V.time_display(3661) == "01:01:01"
    assert V.quoted(b'a"\xff\n') == '"a\\"\\xFF\\n"'


def test_masks_agree(spark):
    key = b"0123456789abcdef"
    (r,) = spark.createDataFrame([("DOE", datetime.date(2024, 5, 6))], "x string, d date").select(
        C.token(key, "name", F.col("x")).alias("t"), C.shift_days(key, F.col("x")).alias("s"), C.masked_date(F.col("d"), "shift", key, F.col("x")).alias("m"), C.masked_date(F.col("d"), "year").alias("y")
    ).collect()
    assert r.t.encode() == V.token(key, "name", b"DOE") and r.s == V.shift_days(key, b"DOE")
    assert r.m == datetime.date(2024, 5, 6) + datetime.timedelta(days=r.s) and r.y == datetime.date(2024, 1, 1)


def test_errors_of_columns(spark):
    df = spark.createDataFrame([(Decimal("1.55"), datetime.datetime(2024, 1, 1, 2))], "x decimal(10,2), t timestamp")
    for c in (C.rescale(F.col("x"), 1), C.whole_days(F.col("t"))):
        with pytest.raises(Exception, match="has more than|not a whole day"):
            df.select(c).collect()


def test_scaled_amounts():
    """The checks add up whole units; they are those of the decimals."""
    from remitta.functions.values import parse_r, scaled_r

    texts = [b"", b"-", b".", b"-.", b"0", b"-0", b"-0.00", b"1.", b".5", b"-.05", b"0012.30", b"1.234", b"+1", b"1e5", b" 1", b"9" * 36, b"9" * 37, b"0" * 9 + b"9" * 36 + b".25", b"9" * 35 + b".999"]
    for scale in (0, 2, 3):
        for t in texts:
            d, n = parse_r(t, scale), scaled_r(t, scale)
            assert (d is None) == (n is None), t
            if d is not None:
                assert int(f"{d:f}".replace(".", "")) == n and d.as_tuple().exponent == -scale and d.is_signed() == t.startswith(b"-")
