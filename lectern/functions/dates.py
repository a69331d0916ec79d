"""Dates, periods and ages."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# English month names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def parse(text: Column) -> Column:
    """ISO text of a date written as ISO, d/m/y or m/d/y where only one reading is possible, ``4 March 2024`` or
    ``March 4, 2024`` (ordinals allowed); null for anything ambiguous or impossible."""
    t = F.regexp_replace(F.lower(F.trim(text)), r"(?<=[0-9])(st|nd|rd|th)\b", "")
    # Bound once as a lambda's argument: inlined, it would be worked out again at each use.
    return F.transform(F.array(t), _iso)[0]


def _iso(t: Column) -> Column:
    a, b, c = (F.get(F.split(t, "[-/., ]+"), i) for i in range(3))
    first, second = a.try_cast("int"), b.try_cast("int")
    names = "|".join(MONTHS)
    number = lambda name: F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("string")
    dated = lambda y, m, d: F.concat_ws("-", y, m, d).try_cast("date").cast("string")
    slashed = F.when((first > 12) | (first == second), dated(c, b, a)).when(second > 12, dated(c, a, b))
    return (F.when(t.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), dated(a, b, c)).when(t.rlike("^[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}$"), slashed)
            .when(t.rlike(f"^[0-9]{{1,2}} ({names}),? [0-9]{{4}}$"), dated(c, number(b), a)).when(t.rlike(f"^({names}) [0-9]{{1,2}},? [0-9]{{4}}$"), dated(c, number(a), b)))


def period(text: Column) -> Column:
    """struct<year,kind,number> of ``2024-Q3``, ``2024-H1`` or ``2024``."""
    year, letter, number = (F.regexp_extract(F.upper(F.trim(text)), r"^([0-9]{4})(?:-([QH])([1-4]))?$", i) for i in (1, 2, 3))
    good = (year != "") & ~((letter == "H") & (number > "2"))
    return F.when(good, F.struct(year.try_cast("int").alias("year"), F.when(letter == "Q", "quarter").when(letter == "H", "half").otherwise("year").alias("kind"), number.try_cast("int").alias("number")))


def staleness(seen: Column, now: Column, days: int = 7) -> Column:
    """future, stale (at least ``days`` old) or fresh; null without a time."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(seen.cast("timestamp"))
    return F.when(age < 0, "future").when(age >= days * 86_400_000_000, "stale").when(age.isNotNull(), "fresh")
