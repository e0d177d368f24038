"""Column expressions for the text cells of measurement exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Local time zone of the exports' date and time cells.
ZONE = "Europe/Bratislava"
#: Plain decimal numbers with an optional exponent. Suffixes such as 1d, hexadecimal, inf and nan are no numbers here.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Spellings of yes and no in 5G columns (fixed values).
YES = ("yes", "true", "1", "y", "t", "a", "ano", "áno")
NO = ("no", "false", "0", "n", "f")


def header_token(name: Column) -> Column:
    """Column name reduced to its letters and digits, lower-cased."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]", "")


def parse_number(text: Column) -> Column:
    """Double of a cell that may use a decimal comma; null if it is no plain number."""
    dotted = F.replace(F.trim(text), F.lit(","), F.lit("."))
    return F.when(dotted.rlike(NUMBER), dotted.try_cast("double"))


def number_text(value: Column) -> Column:
    """A double as text, whole numbers without a fraction."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def int_like(text: Column) -> Column:
    """Numeric cells in short form (231.0 becomes 231); other cells unchanged."""
    return F.coalesce(number_text(parse_number(text)), text)


def operator_code(text: Column) -> Column:
    """MCC or MNC for comparisons: 01, 1 and 1.0 are the same code; a comma is a point in other codes, too."""
    trimmed = F.trim(F.replace(text, F.lit(","), F.lit(".")))
    fallback = F.when(trimmed.contains("."), F.regexp_replace(trimmed, r"\.?0*$", "")).otherwise(trimmed)
    return F.coalesce(number_text(parse_number(text)), fallback)


def nr_state(text: Column) -> Column:
    """``yes``, ``no`` or an empty string for anything else, null included."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(*YES), "yes").when(t.isin(*NO), "no").otherwise("")


def nr_score(state: Column) -> Column:
    return F.when(state == "yes", 2).when(state == "no", 1).otherwise(0)


def nr_of_score(score: Column) -> Column:
    return F.when(score == 2, "yes").when(score == 1, "no").otherwise("")


def epoch_ms(value: Column) -> Column:
    """Milliseconds of an epoch number; its size tells seconds, milli-, micro- and nanoseconds apart."""
    size = F.abs(value)
    ms = F.when(size >= 1e17, value / 1e6).when(size >= 1e14, value / 1e3).when(size >= 1e11, value).otherwise(value * 1e3)
    return F.round(ms).cast("bigint")


#: Date and time patterns; fractions of seconds may follow seconds in any of them.
PATTERNS = (
    "yyyy-MM-dd HH:mm[:ss][.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S]",
    "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S]",
    "d.M.yyyy H:mm[:ss][.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S]XXX",
)


def datetime_ms(text: Column, zone: str = ZONE) -> Column:
    """Epoch milliseconds of a date and time; local time of ``zone`` unless it names an offset.

    In the repeated hour of autumn the earlier instant is taken.
    """
    trimmed = F.trim(text)
    local = [F.try_to_timestamp(F.concat(trimmed, F.lit("")), F.lit(p)) for p in PATTERNS[:3]]
    # Parsed as if in the session's zone, then read as wall-clock time of `zone`.
    wall = F.coalesce(*local)
    shifted = F.unix_millis(F.to_utc_timestamp(F.from_utc_timestamp(wall, F.current_timezone()), zone))
    shifted = F.when(F.current_timezone() == "UTC", F.unix_millis(F.to_utc_timestamp(wall, zone))).otherwise(shifted)
    absolute = F.unix_millis(F.try_to_timestamp(trimmed, F.lit(PATTERNS[3])))
    return F.coalesce(absolute, shifted)


def row_time_ms(date: Column, time: Column, utc: Column, zone: str = ZONE) -> Column:
    """Time of a row: date with time if they parse, else the UTC cell as a number, else as text."""
    filled = (F.trim(date) != "") & (F.trim(time) != "")
    both = F.when(filled, datetime_ms(F.concat_ws(" ", F.trim(date), F.trim(time)), zone))
    return F.coalesce(both, epoch_ms(parse_number(utc)), datetime_ms(utc, zone))


def numeric_then_text(text: Column) -> list[Column]:
    """Sort keys: numbers first by value, then other cells, ties by text."""
    return [parse_number(text).asc_nulls_last(), text.asc()]
