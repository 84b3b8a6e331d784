"""Date tokens and calendar normalisation as SQL expressions.

Every function takes the SQL text of a string expression (usually a column
name) and returns SQL text, so the same definition serves ``F.expr`` and the
SQL functions of ``functions.register``.
"""

from __future__ import annotations

from quillbook.functions.patterns import DATE, DATE_AT_START, MONTH_NAME, MONTHS

_SHORT_MONTH = "|".join(MONTHS)
_MONTH_STRIP = "".join(MONTHS)


def date_token(x: str) -> str:
    """First date-shaped token, '' when there is none."""
    return f"regexp_extract({x}, r'{DATE}', 1)"


def has_date(x: str) -> str:
    return f"({x} rlike r'{DATE}')"


def _day(year: str, month: str, day: str) -> str:
    return f"try_cast(concat(nullif({year}, '0000'), '-', {month}, '-', {day}) as date)"


def _century(x: str) -> str:
    """Two-digit years: 69-99 are 19xx, the rest 20xx."""
    return f"concat(if({x} >= '69', '19', '20'), {x})"


def _month_number(x: str) -> str:
    return f"cast((locate(lower(substr({x}, 1, 3)), '{_MONTH_STRIP}') + 2) div 3 as string)"


def full_date(x: str, parts: str) -> str:
    """DATE of a token that carries a year, null when it is no calendar day; ``parts`` is the token split at its marks."""
    first, second, third = (f"element_at({parts}, {n})" for n in (1, 2, 3))
    return rf"""CASE
      WHEN {x} rlike r'^\d{{1,2}}/\d{{1,2}}/\d{{4}}$'
        THEN coalesce({_day(third, second, first)}, {_day(third, first, second)})
      WHEN {x} rlike r'^\d{{1,2}}([-.])\d{{1,2}}\1\d{{4}}$' THEN {_day(third, second, first)}
      WHEN {x} rlike r'^\d{{1,2}}([-/])\d{{1,2}}\1\d{{2}}$' THEN {_day(_century(third), second, first)}
      WHEN {x} rlike r'^\d{{4}}-\d{{1,2}}-\d{{1,2}}$' THEN {_day(first, second, third)}
      WHEN {x} rlike r'(?i)^\d{{1,2}}([-/ ])(?:{_SHORT_MONTH})\1\d{{4}}$'
        THEN {_day(third, _month_number(second), first)}
      WHEN {x} rlike r'(?i)^\d{{1,2}}-(?:{_SHORT_MONTH})-\d{{2}}$'
        THEN {_day(_century(third), _month_number(second), first)}
      WHEN {x} rlike r'(?i)^\d{{1,2}} (?:{MONTH_NAME}) \d{{4}}$' AND NOT {x} rlike '(?i) sept '
        THEN {_day(third, _month_number(second), first)}
    END"""


def short_date(x: str, parts: str) -> str:
    """The token itself when it is a plausible date without a full year.

    Plausible means valid in 1900, a year without a leap day.
    """
    first, second = (f"element_at({parts}, {n})" for n in (1, 2))
    day_first = _day("'1900'", second, first)
    month_first = _day("'1900'", first, second)
    return rf"""CASE
      WHEN {x} rlike r'^\d{{1,2}}/\d{{1,2}}$' AND coalesce({day_first}, {month_first}) IS NOT NULL THEN {x}
      WHEN {x} rlike r'^\d{{1,2}}-\d{{1,2}}$' AND {day_first} IS NOT NULL THEN {x}
      WHEN {x} rlike r'(?i)^\d{{1,2}} (?:{_SHORT_MONTH})$'
        AND {_day("'1900'", _month_number(second), first)} IS NOT NULL THEN {x}
      WHEN {x} rlike r'^\d{{4}}-\d{{1,2}}$' AND {_day(first, second, "'1'")} IS NOT NULL THEN {x}
      WHEN {x} rlike r'^\d{{1,2}}/\d{{4}}$' AND {_day(second, first, "'1'")} IS NOT NULL THEN {x}
    END"""


def normalize_date(x: str) -> str:
    """ISO text of a full date, the token of a short one, else null.

    Worked out in lambdas: ``x`` is read and split once, and the many cases stay out of the
    generated code around them, which the JVM does not compile above 8,000 bytes.
    """
    found = f"coalesce(cast({full_date('_day', '_parts')} as string), {short_date('_day', '_parts')})"
    return f"get(transform(array({x}), _day -> get(transform(array(split(_day, '[-/. ]')), _parts -> {found}), 0)), 0)"


def is_iso_day(x: str) -> str:
    """Whether a text is a calendar day as ``normalize_date`` writes it: itself its ISO text. Cheap, no pattern is run."""
    return f"coalesce({x} like '____-__-__' AND {x} >= '0001' AND cast(try_cast({x} as date) as string) = {x}, false)"


def squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, r'\s+', ' '))"
