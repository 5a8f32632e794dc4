"""Forecast bulletins: ``.E``/``.ER`` sequences with continuations, ``.A``/``.AR`` crests.

Lines are parsed as rows of their own, so that Spark compiles the parse; the lines of a bulletin stay
together and in order, and a pass over each batch of them hands every line the good header before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from stagecast.constants import ZONES
from stagecast.functions.columns import (
    is_bulletin_missing,
    local_to_utc,
    strict_double,
    zone_name,
)

_RARE = r"[\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029]"
_RARE_ENDS = rf"\r\n|{_RARE}"
_HEADER = ("station", "base", "zone", "parameter", "created_at", "step")


def _stripped(text: Column) -> Column:
    """Text of one line without the blanks around it; tabs are the only others a line can hold.

    To trim spaces alone is much cheaper than to trim a set of characters.
    """
    return F.when(F.contains(text, F.lit("\t")), F.trim(text, F.lit(" \t"))).otherwise(F.trim(text))


def _first_word(text: Column) -> Column:
    """What stands before the first blank; empty if the text begins with one."""
    return F.substring_index(text, " ", 1)


def _field(body: Column, code: str) -> Column:
    """What follows a code in the first slash-separated field that begins with it; null without one."""
    at = F.instr(body, F.lit(f"/{code}"))
    return F.when(at > 0, F.substring_index(F.substring(body, at + len(code) + 1, F.lit(64)), "/", 1))


def _digits(text: Column, start: int, size: int) -> Column:
    """A run of digits at a fixed place, or null."""
    part = F.substring(text, start, size)
    return F.when(part.rlike(f"^[0-9]{{{size}}}$"), part)


def _dashed(day: Column) -> Column:
    """A day of eight digits with dashes, which Spark casts faster than it reads it by a pattern."""
    return F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))


def _tokens(data: Column, header: bool) -> Column:
    """Numbers of slash-separated data, NaN for a missing value and null for what cannot be read.

    Data of nothing but numbers are cast at once, all others word by word; there are no tabs left.
    """
    even = F.replace(F.trim(data), F.lit(" / "), F.lit("/"))
    numbers = F.array_remove(F.split(even, "/"), "").try_cast("array<double>")
    pieces = F.filter(F.transform(F.split(data, "/"), lambda t: F.trim(t)), lambda t: t != "")
    if header:
        pieces = F.filter(pieces, lambda t: ~F.substring(t, 1, 2).isin("DC", "DH", "DI"))
    words = F.transform(pieces, lambda t: _number(_first_word(t), _first_word(t) if header else t))
    return F.when(even.rlike("^[0-9.+eE/-]*$"), numbers).otherwise(words)


def _number(word: Column, token: Column) -> Column:
    return F.when(is_bulletin_missing(token), float("nan")).otherwise(strict_double(word))


def _parsed(bulletins: DataFrame) -> DataFrame:
    """A row per record line with its parsed parts; ``bulletin`` tells bulletins of one id apart.

    Parts of a header are null on other lines. Each step of columns is worked out before the next.
    """
    kind, body = F.col("kind"), F.col("body")
    sequence, crest, continuation = kind == "sequence", kind == "crest", kind == "continuation"
    line = F.col("line")
    text = F.when(F.col("text").rlike(_RARE), F.regexp_replace("text", _RARE_ENDS, "\n")).otherwise(F.col("text"))
    raws = bulletins.select("bulletin_id", F.monotonically_increasing_id().alias("bulletin"), F.split(text, "\n").alias("raws"))
    rows = (
        raws.select("bulletin_id", "bulletin", F.posexplode("raws").alias("pos", "raw"))
        .withColumn("line", _stripped(F.col("raw")))
        .where(line.startswith("."))
        .withColumn(
            "kind",
            F.when(line.startswith(".E ") | line.startswith(".ER "), "sequence")
            .when(line.startswith(".E"), "continuation")
            .when(line.startswith(".A ") | line.startswith(".AR "), "crest")
            .otherwise("other"),
        )
        .withColumn("line", F.replace(line, F.lit("\t"), F.lit(" ")))
        .withColumn("line", F.when(F.contains(line, F.lit("  ")) & (sequence | crest), F.regexp_replace(line, "  +", " ")).otherwise(line))
        .withColumn("parts", F.when(sequence | crest, F.split(line, " ", 5)))
    )
    day, parts = F.col("day"), F.col("parts")
    # a field is a slash, a code of two or three letters and its value; a parameter is the first word of its field
    rows = rows.withColumns({
        "body": F.when(parts.isNotNull(), F.coalesce(F.get(parts, F.lit(4)), F.lit(""))),
        "station": F.get(parts, F.lit(1)),
        "zone": zone_name(F.get(parts, F.lit(3))),
        "day": F.get(parts, F.lit(2)),
    }).drop("parts")
    rows = rows.withColumn("highest", F.when(crest, F.regexp_extract(body, "/((HGIFF|HGIFFX|HGIFFZZ) [^/ ]+)", 1)))
    stage, highest = F.instr(body, F.lit("/HGIFF")), F.col("highest")
    rows = rows.withColumns({
        "day": F.when(day.rlike("^[0-9]{8}$"), _dashed(day).try_cast("date")),
        "observed": _field(body, "DH"),
        "creation": F.when(sequence, _field(body, "DC")),
        "interval": F.when(sequence, _first_word(_field(body, "DIH"))),
        "parameter": F.when(crest, F.nullif(_first_word(highest), F.lit(""))).when(
            stage > 0, _first_word(F.substring_index(F.substring(body, stage + 1, F.length(body)), "/", 1))
        ),
        "maximum": F.substring_index(highest, " ", -1),
    }).drop("highest")
    observed, creation, interval = F.col("observed"), F.col("creation"), F.col("interval")
    hour = _digits(observed, 1, 2).cast("int")
    rows = rows.withColumns({
        "hour": F.when(crest, F.coalesce(hour, F.lit(0))).otherwise(hour),
        "minute": F.coalesce(_digits(observed, 3, 2).cast("int"), F.lit(0)),
        "created_text": _digits(creation, 1, 12),
        "step": F.when(interval.rlike("^[0-9]+$"), interval.try_cast("int")),
        "data_from": F.instr(body, F.concat(F.lit("/"), F.col("parameter"))),
    }).drop("observed", "creation", "interval")
    rows = rows.withColumns({
        "created": F.concat(
            _dashed(F.col("created_text")), F.lit(" "), F.substring("created_text", 9, 2), F.lit(":"), F.substring("created_text", 11, 2)
        ).try_cast("timestamp"),
        "base": F.when(
            (F.col("hour") < 24) & (F.col("minute") < 60),
            day.cast("timestamp") + F.make_dt_interval(hours=F.col("hour"), mins=F.col("minute")),
        ),
    }).drop("hour", "minute", "day")
    dated = F.col("base").isNotNull() & F.col("zone").isNotNull() & F.col("parameter").isNotNull()
    whole_header = (
        dated
        & F.col("step").isNotNull()
        & (F.col("data_from") > 0)
        & (F.col("created_text").isNull() | F.col("created").isNotNull())
    )
    rows = rows.withColumn(
        "framed", F.when(sequence, whole_header).when(crest, dated).otherwise(continuation)
    )
    after = F.col("data_from") + F.length("parameter") + 1
    slash = F.instr(line, F.lit("/"))
    continued = F.when(slash > 0, F.substring(line, slash + 1, F.length(line))).otherwise(line)
    tokens = (
        F.when(sequence, _tokens(F.substring(body, after, F.length(body)), True))
        .when(continuation, _tokens(continued, False))
        .otherwise(F.array(_number(F.col("maximum"), F.col("maximum"))))
    )
    rows = rows.withColumn("read", F.when(F.col("framed"), tokens))
    # to look a value up says false only if nothing is null
    rows = rows.withColumn(
        "bad_at",
        F.when(~F.array_contains("read", F.lit(float("inf"))), F.lit(0)).otherwise(
            F.array_position(F.transform("read", lambda v: v.isNull()), True)
        ),
    )
    whole, bad_at = F.col("framed") & (F.col("bad_at") == 0), F.col("bad_at")
    rows = rows.withColumn("created_at", F.when(~crest, _utc(F.col("created"), F.col("zone"))))
    return rows.select(
        "bulletin_id", "bulletin", "pos", "raw", "kind", "framed", *_HEADER,
        whole.alias("whole"),
        F.when(bad_at > 0, F.slice("read", F.lit(1), (bad_at - 1).cast("int"))).otherwise(F.col("read")).alias("good"),
        F.when(whole & (sequence | continuation), F.size("read")).otherwise(0).alias("advance"),
    )


def _hand_on(header: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Give each continuation the good header before it in its bulletin and the number of values since.

    What a batch leaves to the next is its last good header, with the values counted up to there.
    """

    def run(batches):
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if left is None else pa.concat_batches([left, batch])
            column = {name: rows.column(name) for name in rows.schema.names}
            at = np.arange(rows.num_rows)
            tag, advance, is_header, wanted, continues = (column[n].to_numpy(zero_copy_only=False) for n in (*_PASSED, "continues"))
            last = np.maximum.accumulate(np.where(is_header, at, -1))
            known = (last >= 0) & (tag[last] == tag)
            counted = np.cumsum(advance, dtype=np.int64) - advance
            before = np.where(known, counted - counted[last], 0).astype(np.int32)
            chosen = pa.array(np.where(continues, last, at), mask=continues & ~known)
            found = {name: value.take(chosen) if name in header else value for name, value in column.items() if name not in _PASSED}
            found["before"] = pa.array(np.where(continues, before, np.int32(0)))
            found["headed"] = pa.array(known)
            done = pa.RecordBatch.from_arrays(list(found.values()), names=list(found))
            yield done.filter(pa.array(wanted & (at >= rows.num_rows - batch.num_rows)))
            left = None
            if known[-1]:
                field = rows.schema.get_field_index("advance")
                total = pa.array([before[-1] + advance[-1]], pa.int32())
                left = rows.slice(int(last[-1]), 1).set_column(field, rows.schema.field(field), total)

    return run


_PASSED = ("bulletin", "advance", "is_header", "wanted")


def _carried(lines: DataFrame, wanted: Column, columns: Sequence[Column | str], header: Sequence[str] = ()) -> DataFrame:
    """Columns of the wanted ones of parsed lines, with parts of a header: their own, but a continuation
    (``continues``) has those of the good header before it, if there is one (``headed``), and the
    number of values since (``before``).

    Each part goes to Python once and as a plain column, since structs cost most. Lines are left out
    there too: a filter before it would be pushed below the parse and repeat it.
    """
    is_header = (F.col("kind") == "sequence") & F.col("whole")
    rows = lines.select(
        *columns, *header, (F.col("kind") == "continuation").alias("continues"),
        "bulletin", "advance", F.coalesce(is_header, F.lit(False)).alias("is_header"),
        F.coalesce(wanted, F.lit(False)).alias("wanted"),
    )
    schema = StructType([f for f in rows.schema.fields if f.name not in _PASSED])
    schema = schema.add("before", IntegerType()).add("headed", BooleanType())
    return rows.mapInArrow(_hand_on(header), schema)


def bulletin_values(bulletins: DataFrame) -> DataFrame:
    """Values: station, parameter, valid time (UTC), value, creation time (UTC), crest flag.

    Nothing is shuffled, ids may repeat, and a null or empty text gives no lines.
    """
    is_crest = (F.col("kind") == "crest").alias("is_crest")
    lines = _carried(_parsed(bulletins), F.col("framed"), ("bulletin_id", "pos", is_crest, "good"), _HEADER)
    rows = lines.where(~F.col("continues") | F.col("headed")).select(
        "bulletin_id", "pos", *_HEADER, "before", "is_crest", F.posexplode("good").alias("i", "number")
    )
    hours = (F.col("before") + F.col("i")) * F.when(F.col("is_crest"), 0).otherwise(F.col("step"))
    local = F.col("base") + F.make_dt_interval(hours=hours.cast("int"))
    return rows.select(
        "bulletin_id",
        F.col("pos").alias("line"),
        "station",
        "parameter",
        _utc(local, F.col("zone")).alias("valid_at"),
        F.when(~F.isnan("number"), F.col("number")).alias("value"),
        "created_at",
        "is_crest",
    )


def _utc(local: Column, zone: Column) -> Column:
    """``local_to_utc`` for the zones of bulletins, each looked up once instead of for every row."""
    found = F.lit(None).cast("timestamp")
    for name in ZONES.values():
        found = F.when(zone == name, local_to_utc(local, F.lit(name))).otherwise(found)
    return found


def bulletin_errors(bulletins: DataFrame) -> DataFrame:
    """Lines that could not be read, whole or in part."""
    whole = F.coalesce(F.col("whole"), F.lit(False))
    text = F.when(~whole | (F.col("kind") == "continuation"), F.col("raw")).alias("text")
    columns = ("bulletin_id", F.col("pos").alias("line"), text, "kind", "framed", "whole")
    lines = _carried(_parsed(bulletins), ~whole | (F.col("kind") == "continuation"), columns)
    orphan = (F.col("kind") == "other") | (F.col("continues") & ~F.col("headed"))
    reason = (
        F.when(orphan, "unsupported construct")
        .when(~F.col("framed"), "missing or unreadable date, zone, interval or forecast-stage parameter")
        .when(~F.col("whole"), "unreadable value")
    )
    return (
        lines.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("bulletin_id", "line", "text", "reason")
    )
