"""Synthetic records for any layout, made from any table of numbers.

What a field holds follows from its width alone, its value from an MD5 of the record
number and the field, so every engine gives the same records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelayout.layout import Layout

# Characters that Big5 holds, and what may stand between text and number.
HAN = "日月水火木金土山川田人口手目耳心車舟雨雲"
SEPARATORS = (",", '"', " ", "-", "/")
LETTERS, CHARACTERS, DIGITS = 3, 6, 9
FIRST_DAY, DAYS = "1960-01-01", 25_000
FILLED_EVERY = 11
# Records made by one task. A number takes a few bytes and its record dozens of digests, so splits of a file are too few tasks.
ROWS_PER_TASK = 10_000
NOT_BIG5 = "😀"


def kind_of(width: int) -> str:
    """letters, number, date, text, or mixed (text, a separator that CSV may have to quote, a number)."""
    if width == 1:
        return "letters"
    if width == 8:
        return "date"
    if width < 8:
        return "number"
    return "text" if width < 2 * CHARACTERS + 1 + DIGITS else "mixed"


def draw(number: Column, field: int, turn: int) -> Column:
    digest = F.md5(F.concat(number.cast("string"), F.lit(f"/{field}/{turn}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def synthetic_field(number: Column, field: int, width: int) -> Column:
    kind = kind_of(width)
    if kind == "letters":
        return F.char(draw(number, field, 0) % 26 + 65)
    if kind == "date":
        day = F.date_add(F.lit(FIRST_DAY).cast("date"), (draw(number, field, 0) % DAYS).cast("int"))
        return F.date_format(day, "yyyyMMdd")
    digits = (draw(number, field, 0) % 10 ** min(width, DIGITS)).cast("string")
    if kind == "number":
        return digits
    longest = min(width // 2, CHARACTERS)
    characters = [F.substr(F.lit(HAN), (draw(number, field, at) % len(HAN) + 1).cast("int"), F.lit(1)) for at in range(1, longest + 1)]
    words = F.left(F.concat(*characters), draw(number, field, longest + 1) % longest + 1)
    if kind == "mixed":
        separator = F.element_at(F.array(*map(F.lit, SEPARATORS)), (draw(number, field, longest + 2) % len(SEPARATORS) + 1).cast("int"))
        words = F.concat(words, separator, digits)
    # Now and then a value takes up the whole width.
    filled = F.concat(F.repeat(F.substr(F.lit(HAN), (number % len(HAN) + 1).cast("int"), F.lit(1)), width // 2), F.lit("x" * (width % 2)))
    return F.when(number % FILLED_EVERY == 0, filled).otherwise(words)


def spread(ids: DataFrame, number: str) -> DataFrame:
    """The numbers, dealt into as many tasks as their records need; this counts them."""
    tasks = -(-ids.count() // ROWS_PER_TASK)
    return ids.repartition(tasks, number) if tasks > 1 else ids


def synthetic_rows(ids: DataFrame, number: str, layout: Layout, file_id: Column | None = None) -> DataFrame:
    """One valid record of `layout` for each value of `number` (1, 2, 3 ...)."""
    n = F.col(number).cast("bigint")
    return spread(ids, number).select(
        (F.lit("synthetic") if file_id is None else file_id).cast("string").alias("file_id"),
        n.alias("source_row"),
        F.array(*[synthetic_field(n, at, width) for at, width in enumerate(layout.widths, start=1)]).alias("fields"),
    )


def with_faults(rows: DataFrame, layout: Layout) -> DataFrame:
    """Each record with one fault: in turn, every field one byte too wide, and not encodable."""
    turn = F.pmod(F.col("source_row") - 1, F.lit(2 * len(layout.fields)))
    widths = F.array(*map(F.lit, layout.widths))
    fault = F.when(turn % 2 == 0, F.repeat(F.lit("W"), F.get(widths, (turn / 2).cast("int")) + 1)).otherwise(NOT_BIG5)
    return rows.withColumn(
        "fields", F.transform("fields", lambda value, at: F.when(at == F.floor(turn / 2), fault).otherwise(value))
    )
