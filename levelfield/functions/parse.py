"""Lenient readers of source text, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Position aliases, fee markers in the order they are tried, units.
POSITION_ALIASES = {
    "GK": "GK",
    "DF": "DF",
    "MF": "MF",
    "FW": "FW",
    "D": "DF",
    "M": "MF",
    "F": "FW",
    "G": "GK",
    "DEF": "DF",
    "MID": "MF",
    "FWD": "FW",
}
FEE_MARKERS = {
    "free transfer": "libre",
    "loan transfer": "cesion",
    "loan fee": "cesion",
    "end of loan": "fin_cesion",
    "?": None,
    "-": None,
}
PAID = "traspaso"
UNITS = {"k": 1e3, "m": 1e6, "bn": 1e9}
DATE_FORMATS = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
}
#: White space, that of Unicode and the four separators below the blank.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SEASON_START_MONTH = 7
CENTURY_PIVOT = 50


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: str | Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(_column(value).cast("string"), f"^{SPACE}+|{SPACE}+$", "")


def squeeze(value: str | Column) -> Column:
    """``strip``, and one blank for each run of white space inside."""
    return strip(F.regexp_replace(_column(value).cast("string"), f"{SPACE}+", " "))


def _clean(value: str | Column) -> Column:
    return F.lower(strip(value))


def slugify(text: str | Column, separator: str = "_") -> Column:
    """Column-name form: lower case, ``%`` as ``pct``, other runs as a separator."""
    named = F.replace(_clean(text), F.lit("%"), F.lit(" pct"))
    joined = F.regexp_replace(named, "[^a-z0-9]+", separator)
    return F.btrim(joined, F.lit(separator))


def parse_age(text: str | Column) -> Column:
    """``27-104`` (years-days) → 27."""
    years = F.split_part(strip(text), F.lit("-"), F.lit(1))
    return years.try_cast("double").try_cast("int")


def parse_nation(text: str | Column) -> Column:
    """``es ESP`` → ``ESP``."""
    trimmed = squeeze(text)
    return F.when(trimmed != "", F.upper(F.element_at(F.split(trimmed, " "), -1)))


def split_positions(raw: str | Column) -> Column:
    """Position text → distinct groups in order; unknown tokens are dropped."""
    aliases = F.create_map(*[F.lit(x) for pair in POSITION_ALIASES.items() for x in pair])
    tokens = F.split(F.upper(_column(raw)), r"[/ ,]")
    known = F.transform(tokens, lambda t: F.try_element_at(aliases, strip(t)))
    groups = F.array_distinct(F.filter(known, lambda g: g.isNotNull()))
    return F.coalesce(groups, F.array().cast("array<string>"))


def primary_position(raw: str | Column) -> Column:
    return F.try_element_at(split_positions(raw), F.lit(1))


def is_hybrid(raw: str | Column) -> Column:
    return F.size(split_positions(raw)) > 1


def parse_amount(text: str | Column) -> Column:
    """``€12.00m`` → 12000000.0; text that is no amount → NULL."""
    cleaned = _clean(text)
    bare = strip(F.regexp_replace(cleaned, "[€,]", ""))
    # The unit is what follows the last digit or point.
    units = F.create_map(*[F.lit(x) for pair in {"": 1.0, **UNITS}.items() for x in pair])
    digits = F.regexp_replace(bare, "[^0-9.].*$", "")
    unit = strip(F.substr(bare, F.length(digits) + 1))
    figure, factor = digits.try_cast("double"), F.try_element_at(units, unit)
    # A number that arrived as JSON may be printed with an exponent.
    exponent = F.when(bare.rlike(r"^[0-9.]+e[0-9]+$"), bare.try_cast("double"))
    return F.coalesce(figure * factor, exponent)


def parse_date(text: str | Column) -> Column:
    """Date in one of the three accepted formats, else NULL.

    The shape of the text picks the format, as a failed parse is dear.
    """
    trimmed = squeeze(text)
    parsed = None
    for pattern, shape in DATE_FORMATS.items():
        here, value = trimmed.rlike(shape), F.try_to_date(trimmed, pattern)
        parsed = F.when(here, value) if parsed is None else parsed.when(here, value)
    return parsed


def classify_transfer(fee: str | Column) -> Column:
    """Kind of move: the first marker found inside the text decides."""
    cleaned = _clean(fee)
    kind = None
    for marker, name in FEE_MARKERS.items():
        found = cleaned.contains(marker)
        value = F.lit(name).cast("string")
        kind = F.when(found, value) if kind is None else kind.when(found, value)
    return kind.when(parse_amount(fee) != 0, F.lit(PAID))


def _two_digits(year: Column) -> Column:
    return F.lpad((year % 100).cast("string"), 2, "0")


def season_code(day: str | Column) -> Column:
    """Date → season code, e.g. 2026-09-08 → ``2627``."""
    date = _column(day)
    start = F.year(date) - (F.month(date) < SEASON_START_MONTH).cast("int")
    return F.concat(_two_digits(start), _two_digits(start + 1))


def season_label(code: str | Column) -> Column:
    """``2627`` → ``26/27``; anything else unchanged."""
    text = _column(code)
    label = F.concat_ws("/", F.substring(text, 1, 2), F.substring(text, 3, 2))
    return F.when(text.rlike("^[0-9]{4}$"), label).otherwise(text)


def season_span(code: str | Column) -> Column:
    """``2526`` → ``2025-2026``; NULL when it is no season code."""
    text = _column(code)

    def year(start: int) -> Column:
        short = F.substring(text, start, 2).try_cast("int")
        century = F.when(short >= CENTURY_PIVOT, F.lit(1900)).otherwise(F.lit(2000))
        return (century + short).cast("string")

    return F.when(text.rlike("^[0-9]{4}$"), F.concat_ws("-", year(1), year(3)))


def months_left(end: str | Column, today: str | Column) -> Column:
    """Calendar months until ``end``, never negative; NULL without a date."""
    last, now = _column(end), _column(today)
    months = (F.year(last) - F.year(now)) * 12 + F.month(last) - F.month(now)
    return F.when(last.isNotNull(), F.greatest(F.lit(0), months))


def format_amount(value: str | Column) -> Column:
    """Money in millions, as text; ``-`` when unknown."""
    millions = F.format_number(_column(value).cast("double") / F.lit(1e6), 1)
    text = F.concat(F.replace(millions, F.lit(","), F.lit(".")), F.lit(" M EUR"))
    return F.coalesce(text, F.lit("-"))


def to_percentile(value: str | Column) -> Column:
    """Whole percentile, half to even, clamped to 0..100."""
    whole = F.bround(_column(value), 0)
    return F.when(
        whole.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), whole))
    ).cast("int")
