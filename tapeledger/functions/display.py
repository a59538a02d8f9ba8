"""Numbers as text and text as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeledger.functions.binding import let


def whole_div(a: Column, b: int) -> Column:
    """Integer division rounding down, by a positive constant."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def _two(n: Column) -> Column:
    return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def _clock(total: Column) -> Column:
    return F.concat(whole_div(total, 60).cast("string"), F.lit(":"), _two(F.pmod(total, F.lit(60))))


def duration_precise(secs: Column) -> Column:
    """``m:ss.mmm``, rounded to the millisecond."""
    millis = F.round(secs * 1000.0).cast("long")
    rest = F.pmod(millis, F.lit(60_000))
    ms = F.pmod(rest, F.lit(1000))
    return F.concat(
        whole_div(millis, 60_000).cast("string"),
        F.lit(":"),
        _two(whole_div(rest, 1000)),
        F.lit("."),
        F.lpad(ms.cast("string"), 3, "0"),
    )


def duration_short(secs: Column) -> Column:
    """``m:ss``, rounded to the second; minutes run past sixty."""
    return _clock(F.round(secs).cast("long"))


def format_time(secs: Column) -> Column:
    """``m:ss``, or ``h:mm:ss`` past the hour; rounded down."""
    total = F.floor(F.greatest(secs, F.lit(0.0))).cast("long")
    hours = whole_div(total, 3600)
    minutes = F.pmod(whole_div(total, 60), F.lit(60))
    seconds = F.pmod(total, F.lit(60))
    return F.when(
        hours > 0,
        F.concat(hours.cast("string"), F.lit(":"), _two(minutes), F.lit(":"), _two(seconds)),
    ).when(secs.isNotNull(), _clock(total))


def parse_time(text: Column) -> Column:
    """Seconds from ``90``, ``1:30``, ``1:02:03`` or ``1:30.5``; null otherwise."""
    shape = text.rlike(r"^\s*(\+?\d+:){0,2}\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    return F.when(shape, let(F.split(F.trim(text), ":"), _clock_secs))


def _clock_secs(parts: Column) -> Column:
    n = F.size(parts)
    last = F.try_element_at(parts, F.lit(-1)).try_cast("double")
    # Every part but the last is a 32-bit whole number.
    whole = F.transform(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), lambda p: p.try_cast("long"))
    in_range = F.forall(whole, lambda v: v.isNotNull() & (v <= 4294967295))
    below_sixty = F.when(n == 1, True).otherwise(
        (last < 60) & F.when(n == 3, F.get(whole, F.lit(1)) < 60).otherwise(True)
    )
    secs = F.aggregate(whole, F.lit(0.0), lambda acc, v: acc * 60.0 + v.cast("double")) * F.when(
        n > 1, 60.0
    ).otherwise(1.0) + last
    return F.when(in_range & below_sixty & (last < F.lit(float("inf"))), secs)


# Unit suffixes and how many bytes each stands for.
SIZE_UNITS = {"": 1.0, "k": 1e3, "m": 1e6, "ki": 1024.0, "mi": 1048576.0}


def parse_size(text: Column) -> Column:
    """Bytes from ``1M``, ``900K``, ``1MiB`` or ``1000000``; null otherwise."""
    plain = F.regexp_replace(F.lower(F.trim(text)), "b$", "")
    number = F.regexp_extract(plain, r"^([0-9.]*)", 1).try_cast("double")
    unit = F.trim(F.regexp_extract(plain, r"^[0-9.]*(.*)$", 1))
    scale = None
    for name, value in SIZE_UNITS.items():
        scale = F.when(unit == name, F.lit(value)) if scale is None else scale.when(unit == name, F.lit(value))
    return F.when(number > 0, F.round(number * scale).cast("long"))


def one_decimal(value: Column) -> Column:
    """One decimal place, rounded from the exact binary value with ties to even.

    ``round`` and ``format_string`` both round the shortest decimal form instead, which turns
    1.25 into 1.3.
    """
    return F.call_function("format_number", value, F.lit("0.0"))


def format_size(n: Column) -> Column:
    """Decimal units: whole KB rounded up, MB with one decimal from ten million bytes."""
    return F.when(
        n >= 10_000_000, F.concat(one_decimal(n.cast("double") / 1e6), F.lit(" MB"))
    ).otherwise(F.concat(whole_div(n + 999, 1000).cast("string"), F.lit(" KB")))


def format_limit(n: Column) -> Column:
    return (
        F.when(F.pmod(n, F.lit(1_000_000)) == 0, F.concat(whole_div(n, 1_000_000).cast("string"), F.lit("M")))
        .when(F.pmod(n, F.lit(1000)) == 0, F.concat(whole_div(n, 1000).cast("string"), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def format_length(secs: Column) -> Column:
    return F.when(secs == F.floor(secs), F.floor(secs).cast("string")).otherwise(one_decimal(secs))


def bytes_text(n: Column) -> Column:
    """Binary units with one decimal, ties to even; plain bytes below one KiB."""
    value = n.cast("double")
    case = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB")):
        case = case.when(
            n < F.lit(1024 ** (power + 1)),
            F.concat(one_decimal(value / float(1024**power)), F.lit(f" {unit}")),
        )
    return case.otherwise(F.concat(one_decimal(value / float(1024**4)), F.lit(" TiB")))


def epoch_text(secs: Column) -> Column:
    """``YYYY-MM-DD hh:mm:ss UTC``, whatever the session's time zone."""
    days = whole_div(secs, 86_400)
    rest = F.pmod(secs, F.lit(86_400))
    day = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))
    return F.concat(
        F.regexp_replace(F.date_format(day, "yyyy-MM-dd"), r"^\+", ""),
        F.lit(" "),
        _two(whole_div(rest, 3600)),
        F.lit(":"),
        _two(F.pmod(whole_div(rest, 60), F.lit(60))),
        F.lit(":"),
        _two(F.pmod(rest, F.lit(60))),
        F.lit(" UTC"),
    )


def pieces_phrase(pieces: Column) -> Column:
    joined = F.array_join(F.transform(pieces, lambda p: p.cast("string")), ", ")
    return F.concat(F.when(F.size(pieces) == 1, "piece ").otherwise("pieces "), joined)
