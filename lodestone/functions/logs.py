"""Log line grammar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the level words.
LEVELS = "DEBUG|INFO|WARNING|ERROR|CRITICAL"
#: Importance of a level where a line states none, and of any other level.
DEFAULT_IMPORTANCE = {"DEBUG": 2, "INFO": 4, "WARNING": 6, "ERROR": 8, "CRITICAL": 10}
OTHER_IMPORTANCE = 4
#: Fixed value: the form of a timing.
TIMING = r"(?i)\[TIMING\]\s+(\S+)\s+duration=([0-9.]+)s"


def _stamp(part: Column) -> Column:
    """A part that is a whole date and time, else null."""
    whole = part.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}\s*$")
    return F.when(whole, F.trim(F.regexp_replace(part, r"\s+", " ")).try_cast("timestamp"))


def _trimmed(part: Column) -> Column:
    return F.regexp_replace(part, r"^\s+|\s+$", "")


def parse_line(line: Column) -> Column:
    """Struct (stamp, level, importance, message) of a line by the first form that fits; null for a blank line.

    The forms: ``stamp | level | importance | message`` (an importance that is no integer counts as
    none), ``stamp | level | message``, ``stamp - level - message``, each with a stamp that is a date
    and time; then a line that begins with a stamp (level: the first level word of the line, message:
    the whole line); then any line, of level UNKNOWN and without a stamp.
    """
    bars, dashes = F.split(line, r" \| ", 4), F.split(line, " - ", 3)
    part = lambda parts, i: _trimmed(F.element_at(parts, i))
    four = (F.size(bars) == 4) & _stamp(F.element_at(bars, 1)).isNotNull()
    three = (F.size(bars) == 3) & _stamp(F.element_at(bars, 1)).isNotNull()
    dash = (F.size(dashes) == 3) & _stamp(F.element_at(dashes, 1)).isNotNull()
    head = F.regexp_extract(line, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1).try_cast("timestamp")
    word = F.regexp_extract(line, rf"\b({LEVELS})\b", 1)
    usual = lambda level: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in DEFAULT_IMPORTANCE.items() for x in pair]), F.upper(level)), F.lit(OTHER_IMPORTANCE))

    def entry(stamp: Column, level: Column, message: Column, stated: Column | None = None) -> Column:
        importance = usual(level) if stated is None else F.coalesce(stated, usual(level))
        bounded = F.least(F.greatest(importance, F.lit(0)), F.lit(10)).cast("int")
        return F.struct(stamp.alias("stamp"), level.alias("level"), bounded.alias("importance"), message.alias("message"))

    stated = F.when(part(bars, 3).rlike(r"^[+-]?\d{1,9}$"), part(bars, 3).try_cast("int"))
    return (
        F.when(line.isNull() | line.rlike(r"^\s*$"), F.lit(None))
        .when(four, entry(_stamp(F.element_at(bars, 1)), part(bars, 2), part(bars, 4), stated))
        .when(three, entry(_stamp(F.element_at(bars, 1)), part(bars, 2), part(bars, 3)))
        .when(dash, entry(_stamp(F.element_at(dashes, 1)), part(dashes, 2), part(dashes, 3)))
        .when(head.isNotNull(), entry(head, F.when(word != "", word).otherwise("UNKNOWN"), line))
        .otherwise(entry(F.lit(None).cast("timestamp"), F.lit("UNKNOWN"), line))
    )


def timing(line: Column) -> Column:
    """Struct (operation, seconds) of a timing line, null otherwise; of a line in four parts the last one is looked at."""
    bars = F.split(line, r" \| ", 4)
    message = F.when(F.size(bars) == 4, F.element_at(bars, -1)).otherwise(line)
    seconds = F.regexp_extract(message, TIMING, 2).try_cast("double")
    found = F.struct(F.regexp_extract(message, TIMING, 1).alias("operation"), seconds.alias("seconds"))
    return F.when(line.contains("[TIMING]") & message.rlike(TIMING) & seconds.isNotNull(), found)
