"""Column functions: decoding fields, labels, lenient numbers and times. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes

TRUE_FREE = 0  # token_status of a free token


def table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def look_up(pairs: dict[str, str], key: Column) -> Column:
    """The value for a key; null where the table has none."""
    return F.try_element_at(table(pairs), key)


def block_type(code: Column) -> Column:
    """The label of a block's type code; unknown and missing codes give `unknown`."""
    return F.coalesce(look_up(codes.BLOCK_TYPES, code), F.lit("unknown"))


def transaction_name(code: Column) -> Column:
    """The name of a two-digit transaction code; null for others."""
    return look_up(codes.TRANSACTION_NAMES, code)


def burn_label(code: Column) -> Column:
    return F.coalesce(look_up(codes.BURN_LABELS, code), F.lit("Unknown"))


def block_type_number(label: Column) -> Column:
    """The numeric code of a block type label; 0 for others."""
    pairs = [F.lit(x) for kv in codes.BLOCK_NUMBERS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit(0)).cast("bigint")


def lenient_double(text: Column) -> Column:
    """The number at the start of a text, 0 where there is none; null for null."""
    lead = F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.when(text.isNotNull(), F.coalesce(lead.try_cast("double"), F.lit(0.0)))


def lenient_long(text: Column) -> Column:
    """The whole number at the start of a text (a fraction is cut off), 0 where there is none; null for null."""
    whole = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")
    power = F.regexp_extract(text, r"^\s*([+-]?[0-9]+\.?[0-9]*[eE][+-]?[0-9]+)", 1).try_cast("double")
    return F.when(text.isNotNull(), F.coalesce(power.try_cast("bigint"), whole, F.lit(0).cast("bigint")))


def block_time(text: Column, ingest: Column) -> Column:
    """Epoch seconds as digits, or an RFC 3339 text, else the ingest time."""
    return F.coalesce(F.timestamp_seconds(text.try_cast("bigint")), F.try_to_timestamp(text), ingest)


def contract_time(text: Column) -> Column:
    """A numeric epoch only; else null."""
    return F.timestamp_seconds(text.try_cast("bigint"))


def burn_epoch(comment: Column) -> Column:
    """Epoch seconds of the first `YYYY-MM-DD HH:MM:SS` in a comment, read as Asia/Kolkata; null where there is none or it is no date."""
    found = F.regexp_extract(comment, r"([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})", 1)
    return F.unix_timestamp(F.to_utc_timestamp(F.try_to_timestamp(found, F.lit("yyyy-MM-dd HH:mm:ss")), "Asia/Kolkata"))


def json_map(m: Column) -> Column:
    """A map as JSON text with sorted keys; the text `null` for a missing map."""
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))), F.lit("null"))


def first_key(m: Column) -> Column:
    """The smallest key of a map; null for empty and missing maps."""
    return F.try_element_at(F.array_sort(F.map_keys(m)), F.lit(1))


def round3(x: Column) -> Column:
    return F.round(x * 1000) / 1000


def milli(x: Column) -> Column:
    """A value in whole thousandths, so that sums are exact."""
    return F.round(x * 1000).cast("bigint")


def id_kind(x: Column) -> Column:
    return F.when(x.startswith("Qm"), "token").when(x.startswith("bafy"), "did").otherwise("transaction")
