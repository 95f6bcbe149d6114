"""Names, labels, JSON and path text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotflow.functions.numbers import round_half_up


def standard_name(value: Column) -> Column:
    return F.upper(F.trim(value))


def hour_label(hour: Column) -> Column:
    return F.format_string("%02d:00", hour)


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def stay_text(minutes: Column) -> Column:
    """``3h 5m`` from a number of minutes."""
    whole = round_half_up(F.coalesce(minutes, F.lit(0.0)))
    return F.concat(F.floor(whole / F.lit(60)).cast("string"), F.lit("h "), (whole % 60).cast("string"), F.lit("m"))


def pct_text(value: Column) -> Column:
    return F.concat(round_half_up(F.coalesce(value, F.lit(0.0))).cast("string"), F.lit("%"))


def zulu_to_offset(text: Column) -> Column:
    return F.replace(text, F.lit("Z"), F.lit("+00:00"))


def day_in_path(path: Column) -> Column:
    """The day folder of a file path, as ``2024-01-31`` or ``date=2024-01-31``."""
    return F.to_date(F.regexp_extract(path, r"/(?:date=)?(\d{4}-\d{2}-\d{2})/", 1))


def to_record(*fields: str) -> Column:
    return F.to_json(F.struct(*fields))


def encode_record(*fields: str) -> Column:
    return F.base64(F.encode(to_record(*fields), "UTF-8"))


def decode_record(data: Column, schema: T.StructType, corrupt: str = "_corrupt") -> Column:
    """Struct from base64 JSON; text that is no such record lands whole in ``corrupt``."""
    with_bad = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    text = F.coalesce(F.try_to_binary(data, F.lit("base64")).cast("string"), data)
    return F.from_json(text, with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})


def csv_row(*columns: Column) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in columns])
