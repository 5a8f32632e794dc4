"""Scalar expressions. Every function takes and returns Spark columns."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from stagecast.constants import (
    BULLETIN_MISSING,
    NULL_SENTINELS,
    RECONCILIATION_HOURS,
    SEASONS,
    SPLITS,
    ZONES,
)


def micros(ts: Column) -> Column:
    """Epoch microseconds; a time without a zone is read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def step_index(us: Column, step: int) -> Column:
    """Whole steps since the epoch, rounded down for any sign."""
    return ((us - F.pmod(us, F.lit(step))) / step).cast("bigint")


def floor_time(ts: Column, step: int) -> Column:
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(step)))


def sentinel_to_null(value: Column) -> Column:
    return F.when(~value.isin(*NULL_SENTINELS), value)


def strict_double(text: Column) -> Column:
    """A plain decimal number, or null; no type suffixes."""
    number = F.trim(text)
    return F.when(
        number.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
        number.try_cast("double"),
    )


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def zone_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(part) for pair in ZONES.items() for part in pair])
    return F.try_element_at(names, code)


def local_to_utc(local: Column, zone: Column) -> Column:
    """Wall-clock time in a named zone as an instant, daylight saving honoured."""
    return F.to_utc_timestamp(local.cast("timestamp"), zone)


def repair_two_digit_year(token: Column, anchor: Column) -> Column:
    """yymmdd in the anchor's century, a century earlier when over 180 days past the anchor."""
    century = F.date_format(anchor, "yyyy").substr(1, 2)
    candidate = F.try_to_date(F.concat(century, token), "yyyyMMdd")
    late = F.datediff(candidate, anchor.cast("date")) > 180
    return F.when(late, F.add_months(candidate, -1200)).otherwise(candidate)


def is_bulletin_missing(token: Column) -> Column:
    return token.isin(*BULLETIN_MISSING)


def stable_id(*parts: Column) -> Column:
    joined = F.concat_ws("|", *[part.cast("string") for part in parts])
    return F.substring(F.sha2(joined, 256), 1, 24)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def iso_utc(ts: Column) -> Column:
    """ISO 8601 text with a zero offset; microseconds only where there are some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction), F.lit("+00:00"))


def freshness(age_minutes: Column) -> Column:
    """supported to 90 minutes, degraded to 120, then suppressed; null for a negative age."""
    return (
        F.when(age_minutes < 0, F.lit(None).cast("string"))
        .when(age_minutes <= 90, "supported")
        .when(age_minutes <= 120, "degraded")
        .when(age_minutes > 120, "suppressed")
    )


def degradation_reasons(state: Column) -> Column:
    reason = F.when(state == "degraded", F.lit("observation age exceeds 90 minutes"))
    return F.array_compact(F.array(reason))


def season(month: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        label = F.when(month.isin(*months), name).otherwise(label)
    return label


def reconciliation_bounds(kind: str, now: Column) -> tuple[Column, Column]:
    width = F.make_dt_interval(hours=F.lit(RECONCILIATION_HOURS[kind]))
    return now - width, now


def split_of(day: Column, cutoff: date, splits=SPLITS, open_start: bool = False) -> Column:
    """Split holding a day, null outside. ``open_start`` drops the first split's lower bound."""
    label = F.lit(None).cast("string")
    for position, (name, first, last) in reversed(list(enumerate(splits))):
        inside = day <= F.lit(last or cutoff)
        if position or not open_start:
            inside = inside & (day >= F.lit(first))
        label = F.when(inside, name).otherwise(label)
    return label


def split_containing(start: Column, end: Column, cutoff: date, splits=SPLITS) -> Column:
    """Split that holds a whole interval; null when it touches a boundary."""
    label = F.lit(None).cast("string")
    for name, first, last in reversed(splits):
        after = F.lit((last or cutoff) + timedelta(days=1)).cast("timestamp_ntz")
        inside = (start >= F.lit(first).cast("timestamp_ntz")) & (end < after)
        label = F.when(inside, name).otherwise(label)
    return label


def expected_samples(month: Column, start: Column, end: Column, per_day: int = 96) -> Column:
    """Samples due in a month (its first day given) between two days, both included."""
    first = F.greatest(month, start)
    last = F.least(F.last_day(month), end)
    return F.greatest(F.lit(0), F.datediff(last, first) + 1).cast("bigint") * per_day


def month_count(start: date, end: date) -> int:
    return (end.year - start.year) * 12 + end.month - start.month + 1


def overlap_fraction(start: Column, end: Column, span_start: Column, span_end: Column) -> Column:
    """Share of a span that an interval covers; all four in epoch microseconds."""
    shared = F.least(end, span_end) - F.greatest(start, span_start)
    return F.greatest(F.lit(0.0), shared / (span_end - span_start))


def log1p_clamped(value: Column) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), value))


def strip_agency(identifier: Column) -> Column:
    return F.regexp_replace(identifier, "^USGS-", "")


def crossed(maximum: Column, valid: Column, expected: Column | int, threshold: Column) -> Column:
    """True once the maximum reaches the threshold, false only on full coverage, else null."""
    return F.when(maximum >= threshold, True).when(valid >= expected, False)


def decross(values: Column) -> Column:
    return F.array_sort(values)


def quantiles_ordered(quantiles: Column) -> Column:
    """Whether a map of quantile label to value rises with the label."""
    entries = F.array_sort(
        F.transform(
            F.map_entries(quantiles),
            lambda e: F.struct(e["key"].cast("double").alias("q"), e["value"].alias("v")),
        )
    )
    values = F.transform(entries, lambda e: e["v"])
    return values == F.array_sort(values)


def relative_history(history: Column) -> Column:
    last = F.element_at(history, -1)
    return F.transform(history, lambda v: v - last)
