"""ISO-8601 text normalisation; text that does not parse passes through unchanged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = (r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?)?"
        r"(Z|[+-]\d{2}:\d{2})?$")


def _parts(c: Column) -> tuple[Column, Column, Column]:
    day, minute = F.regexp_extract(c, _ISO, 1), F.regexp_extract(c, _ISO, 2)
    second, fraction = F.regexp_extract(c, _ISO, 3), F.regexp_extract(c, _ISO, 4)
    clock = F.concat(F.when(minute == "", F.lit("00:00")).otherwise(minute), F.lit(":"),
                     F.when(second == "", F.lit("00")).otherwise(second))
    micros = F.rpad(fraction, 6, "0")
    shown = F.concat(day, F.lit("T"), clock,
                     F.when(micros.rlike("[1-9]"), F.concat(F.lit("."), micros))
                     .otherwise(F.lit("")))
    zone = F.regexp_extract(c, _ISO, 5)
    valid = (day != "") & F.concat(day, F.lit(" "), clock).try_cast("timestamp").isNotNull()
    return shown, F.when(zone == "Z", F.lit("+00:00")).otherwise(zone), valid


def iso_keep_offset(c: Column) -> Column:
    """Canonical ISO text with its own offset."""
    shown, zone, valid = _parts(c)
    return F.when(valid, F.concat(shown, zone)).otherwise(c)


def iso_as_utc(c: Column) -> Column:
    """Canonical ISO text whose offset is replaced (not converted) by UTC."""
    shown, _, valid = _parts(c)
    return F.when(valid, F.concat(shown, F.lit("+00:00"))).otherwise(c)


def iso_seconds(c: Column) -> Column:
    """Timestamp as ISO text in UTC with seconds and ``Z``, whatever the session zone."""
    utc = F.convert_timezone(None, F.lit("UTC"), c)
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def utc_now() -> Column:
    """Moment of the running query; stamp it once at ingest and pass it on as a value."""
    return F.current_timestamp()
