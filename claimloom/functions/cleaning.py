"""Column expressions that turn landed text into typed, normalised values.

Every expression is null-tolerant and never raises on bad input, also under ANSI mode.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.model import MONEY

# Acronyms kept in capitals, and the spellings of true and false.
ACRONYMS = ("MD", "ENT", "OB/GYN", "RN", "PA", "DO", "NP")
TRUE_WORDS = ("1", "TRUE", "YES", "Y")
FALSE_WORDS = ("0", "FALSE", "NO", "N")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_to_null(value: Column | str) -> Column:
    return F.nullif(F.trim(_col(value).cast("string")), F.lit(""))


def code(value: Column | str) -> Column:
    return F.upper(trim_to_null(value))


# Words, and what lies between them; the one acronym with a mark inside is a word of its own.
_PARTS = "(?i)OB/GYN(?![A-Za-z])|[A-Za-z]+|[^A-Za-z]+"


def title(value: Column | str) -> Column:
    """Title case with the known acronyms in capitals wherever they stand as a word."""
    spelled = F.create_map(*(F.lit(x) for a in ACRONYMS for x in (a, a)))
    parts = F.regexp_extract_all(F.initcap(trim_to_null(value)), F.lit(_PARTS), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(spelled, F.upper(p)), p)), "")


severity = title


def decimal_or_null(value: Column | str, precision: int = MONEY.precision, scale: int = MONEY.scale) -> Column:
    return trim_to_null(value).try_cast(f"decimal({precision},{scale})")


def date_or_null(value: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(trim_to_null(value), fmt)


def bool_or_null(value: Column | str) -> Column:
    """One map lookup, so that the text is prepared once however many spellings there are."""
    words = {**dict.fromkeys(TRUE_WORDS, True), **dict.fromkeys(FALSE_WORDS, False)}
    known = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    return F.try_element_at(known, F.upper(F.trim(_col(value).cast("string"))))


def quality_flags(conditions: Mapping[str, Column]) -> Column:
    """The names of the true conditions, in name order."""
    named = [F.when(conditions[name], F.lit(name)) for name in sorted(conditions)]
    return F.array_compact(F.array(*named)).cast("array<string>")


def amount(value: Column | str) -> Column:
    """Money for summing: exact decimal, so that totals do not depend on row order."""
    return _col(value).try_cast(MONEY)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Double ratio, NULL unless the denominator is above zero."""
    return F.when(
        _col(denominator) > 0,
        _col(numerator).cast("double") / _col(denominator).cast("double"),
    )


def percent(numerator: Column, denominator: Column) -> Column:
    """Percentage with two decimals; NULL when the denominator is NULL or zero."""
    return F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")) * 100.0, 2)
