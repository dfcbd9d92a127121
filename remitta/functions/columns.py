"""The value functions as column expressions, which stay in the JVM. Text columns hold one character per byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_n(x: Column) -> Column:
    """Digits with an optional minus that fit 64 bits, else null."""
    return F.when(x.rlike(r"^-?[0-9]+\z"), x.try_cast("bigint"))


def parse_unsigned(x: Column) -> Column:
    return F.when(x.rlike(r"^[0-9]+\z"), x.try_cast("bigint"))


def parse_r(x: Column, scale: int = 2) -> Column:
    """A decimal with at most so many digits after the point, else null; a plain cast would round."""
    shape = rf"^-?([0-9]+(\.[0-9]{{0,{scale}}})?{rf'|\.[0-9]{{1,{scale}}}' if scale else ''})\z"
    return F.when(x.rlike(shape), x.try_cast(f"decimal(38,{scale})"))


def parse_dt(x: Column) -> Column:
    """CCYYMMDD, or YYMMDD with years 00 to 49 in this century, else null."""
    whole = F.when(F.length(x) == 8, x).otherwise(F.concat(F.when(F.substring(x, 1, 2) < "50", "20").otherwise("19"), x))
    part = lambda at, n: F.substring(whole, at, n).cast("int")
    y, m, d = part(1, 4), part(5, 2), part(7, 2)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    ok = x.rlike(r"^([0-9]{8}|[0-9]{6})\z")
    return F.when(ok, F.when((y >= 1) & m.between(1, 12) & (d >= 1) & (d <= days), F.make_date(y, m, d)))


def parse_tm(x: Column) -> Column:
    """Seconds of HHMM or HHMMSS with up to two more digits, else null."""
    part = lambda at: F.substring(x, at, 2).cast("int")
    s = F.when(F.length(x) >= 6, part(5)).otherwise(0)
    return F.when(x.rlike(r"^[0-9]{4}([0-9]{2}[0-9]{0,2})?\z"), F.when((part(1) < 24) & (part(3) < 60) & (s < 60), part(1) * 3600 + part(3) * 60 + s))


def digits(x: Column) -> Column:
    """Length of a number as X12 counts it."""
    return F.length(F.regexp_replace(x, "[^0-9]", ""))


def rescale(x: Column, scale: int) -> Column:
    """The same decimal with so many places; an error if it has more."""
    # as text: comparing decimals of different scales would round one of them
    fits = x.cast("string").rlike(rf"^-?[0-9]+(\.[0-9]{{0,{scale}}}0*)?$")
    return F.when(fits, x.cast(f"decimal(38,{scale})")).when(x.isNotNull(), F.raise_error(F.concat(x.cast("string"), F.lit(f" has more than {scale} decimal places"))))


def whole_days(ts: Column) -> Column:
    """The date of a midnight; an error for any other time."""
    return F.when(ts == F.date_trunc("DAY", ts), F.to_date(ts)).when(ts.isNotNull(), F.raise_error(F.concat(ts.cast("string"), F.lit(" is not a whole day"))))


def whole(x: Column) -> Column:
    """A number without a fraction that fits 64 bits; an error for any other."""
    fits = (x == F.floor(x)) & (F.abs(x) < 9.2e18)
    return F.when(fits, x.cast("bigint")).when(x.isNotNull(), F.raise_error(F.concat(x.cast("string"), F.lit(" is not a whole number that fits"))))


def whole_seconds(x: Column, unit: int) -> Column:
    """Seconds of a count of units, so many to a second; an error if some are left over."""
    return F.when(x % unit == 0, (x / unit).cast("bigint")).when(x.isNotNull(), F.raise_error(F.concat(x.cast("string"), F.lit(" is not a whole number of seconds"))))


def decimal_element(x: Column) -> Column:
    """Without zeros at the end, and without a point if nothing follows it."""
    text = x.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def date_element(x: Column, longest: int = 8) -> Column:
    return F.date_format(x, "yyyyMMdd") if longest >= 8 else F.when(F.year(x).between(1950, 2049), F.date_format(x, "yyMMdd"))


def time_display(seconds: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws(":", two((seconds / 3600).cast("int")), two((seconds / 60).cast("int") % 60), two(seconds % 60))


def time_element(seconds: Column) -> Column:
    text = F.replace(time_display(seconds), F.lit(":"), F.lit(""))
    return F.when(seconds % 60 == 0, F.substring(text, 1, 4)).otherwise(text)


def year_start(x: Column) -> Column:
    return F.trunc(x, "YEAR")


def escape(x: Column, release: str, structural: str) -> Column:
    """The release character before every character that has a meaning."""
    chars = "".join("\\" + c for c in structural + release)
    return F.regexp_replace(x, f"([{chars}])", ("\\\\" if release in "\\$" else "") + release + "$1")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """As 64 hexadecimal digits. The pads of the key show in plans: for tests and keys that may be seen; a read masks in its task."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in block).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def token(key: bytes, kind: str, value: Column) -> Column:
    """Empty stays empty, null stays null."""
    return F.when(F.length(value) > 0, F.substring(hmac_sha256(key, F.concat(F.lit(kind + "\0"), value)), 1, 16)).otherwise(value)


def shift_days(key: bytes, seed: Column) -> Column:
    first = F.conv(F.substring(hmac_sha256(key, F.concat(F.lit("shift\0"), seed)), 1, 8), 16, 10).cast("bigint")
    return (first % 365 - 182).cast("int")


def masked_date(x: Column, dates: str, key: bytes | None = None, seed: Column | None = None) -> Column:
    if dates == "keep":
        return x
    if dates == "year" or seed is None:
        return year_start(x)
    return F.when(F.length(seed) > 0, F.date_add(x, shift_days(key, seed))).otherwise(year_start(x))


def csv_cell(x: Column) -> Column:
    """Quoted where needed; a sign that a spreadsheet would take for a formula gets an apostrophe."""
    safe = F.when(x.rlike(r"^[=+@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)
    return F.when(safe.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def any_cell_contains(columns: list[Column], text: str) -> Column:
    """Whether a row shows the text, whatever its case."""
    return F.lower(F.concat_ws("\n", *[c.cast("string") for c in columns])).contains(text.lower())
