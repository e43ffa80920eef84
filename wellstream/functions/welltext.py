"""Fields of text well logs: list split, mandatory values, numbers, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEET_TO_METRES = 0.3048

# Accepted number and time texts. A sign may stand on either side of a number, not on both;
# there is no exponent. A time needs its offset from UTC.
NUMBER = r"^([+-]?(\d+\.?\d*|\.\d+)|(\d+\.?\d*|\.\d+)[+-])$"
TIME_WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})$"


# The white space of Unicode.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Trim white space, that of Unicode included."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def split_list(text: Column) -> Column:
    """L4: comma-separated values, each trimmed, empty ones kept."""
    return F.transform(F.split(text, ",", -1), strip)


def last_position(names: Column, name: Column) -> Column:
    """One-based position of the last equal name, null if there is none (case-sensitive)."""
    from_end = F.array_position(F.reverse(names), name)
    return F.when(from_end > 0, F.size(names) - from_end + 1).cast("int")


def parse_number(text: Column) -> Column:
    """Invariant decimal number or null."""
    trailing_sign = F.endswith(text, F.lit("-")) | F.endswith(text, F.lit("+"))
    sign_first = F.concat(F.right(text, F.lit(1)), F.left(text, F.length(text) - 1))
    plain = F.when(trailing_sign, sign_first).otherwise(text)
    return F.when(text.rlike(NUMBER), plain.try_cast("double"))


def parse_time(text: Column) -> Column:
    """ISO 8601 with offset to a UTC instant, or null. Seconds may be left out."""
    whole = F.when(F.substring(text, 17, 1) == ":", text).otherwise(F.regexp_replace(text, r"^(.{16})(Z|[+-])", "$1:00$2"))
    return F.when(text.rlike(TIME_WITH_OFFSET), F.try_to_timestamp(whole))


def to_metres(depth: Column, unit: Column) -> Column:
    """L13."""
    return F.when(unit == "ft", depth * FEET_TO_METRES).otherwise(depth)
