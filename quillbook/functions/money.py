"""Money tokens as SQL expressions (see ``functions.dates`` for the style).

``strict_parity`` reproduces the readings that lose or flip money: glued
currency words read as 0, and cells of nine or more digits, decimals counted,
read as 0. The default reads both, whatever their number of digits; only a plain
run of nine or more digits, without separators or decimals, is a reference code.
"""

from __future__ import annotations

from quillbook.functions.patterns import CLOCK_TIME, CREDIT_WORDS, CURRENCY_PREFIX, MONEY, MONEY_OF_ANY_SIZE

MONEY_TYPE = "decimal(18,2)"
ZERO = f"cast(0 as {MONEY_TYPE})"


def has_money(x: str) -> str:
    return f"({x} rlike r'{MONEY}')"


def is_clock(x: str) -> str:
    return f"({x} rlike r'^{CLOCK_TIME}$')"


def money_strength(x: str) -> str:
    """'strong' (decimals), 'weak' (1-8 plain digits) or '' (not money)."""
    bare = f"trim(regexp_replace(lower(trim({x})), r'{CURRENCY_PREFIX}', ''))"
    bare = f"trim(regexp_replace({bare}, r'(cr|dr)$', ''))"
    bare = f"replace(regexp_replace({bare}, r'^[()]+|[()]+$', ''), ',', '')"
    return rf"""CASE
      WHEN NOT {x} rlike r'\d' THEN ''
      WHEN {is_clock(f"trim({x})")} THEN ''
      WHEN {bare} rlike r'^\d+\.\d{{1,2}}$' THEN 'strong'
      WHEN {bare} rlike r'^\d{{1,8}}$' THEN 'weak'
      ELSE '' END"""


def to_amount(x: str, strict_parity: bool = False) -> str:
    """Decimal value of a money token; parentheses negate, unreadable is 0.

    In a lambda, like ``dates.normalize_date``: ``x`` is read once and the code around it stays small.
    """
    return f"get(transform(array({x}), _money -> {_amount('_money', strict_parity)}), 0)"


def _amount(x: str, strict_parity: bool) -> str:
    if strict_parity:
        bare = f"replace(replace(replace({x}, '₹', ''), 'Rs.', ''), 'Rs', '')"
    else:
        bare = rf"regexp_replace({x}, r'(?i)₹|rs\.?|inr', '')"
    bare = rf"trim(regexp_replace({bare}, r'(?i)\s*(?:CR|DR)\s*$', ''))"
    number = f"try_cast(trim(translate({bare}, ',()', '')) as {MONEY_TYPE})"
    return (
        f"coalesce(CASE WHEN {x} rlike r'^\\d+\\.\\d{{1,2}}$' THEN try_cast({x} as {MONEY_TYPE}) "
        f"WHEN {bare} rlike r'^\\(.*\\)$' THEN -abs({number}) ELSE {number} END, {ZERO})"
    )


def cell_amount(x: str, strict_parity: bool = False) -> str:
    """Value of the first money token of a table cell, 0 for reference codes."""
    token = f"regexp_extract({x}, r'{MONEY if strict_parity else MONEY_OF_ANY_SIZE}', 0)"
    if strict_parity:
        amount = rf"length(regexp_replace({token}, r'\D', '')) < 9"
    else:
        amount = rf"NOT {token} rlike r'^\D*\d{{9,}}\D*$'"
    return (
        f"CASE WHEN {x} rlike r'\\d' AND {amount} "
        f"THEN {to_amount(token, strict_parity)} ELSE {ZERO} END"
    )


def credit_words(x: str) -> str:
    return f"({x} rlike '(?iu){'|'.join(CREDIT_WORDS)}')"


def split_amounts(description: str, amounts: str, flag: str) -> str:
    """struct(debit, credit, balance) of one to three amounts.

    ``amounts`` is the SQL text of an array; ``flag`` the text that may carry
    a CR mark. CR or a credit word makes a credit, everything else a debit.
    """
    a, b = (f"get({amounts}, {i})" for i in range(2))
    first, last = f"abs({a})", f"element_at({amounts}, -1)"
    credit = f"({flag} like '%CR%' OR {credit_words(description)})"

    def row(debit: str, credit_: str, balance: str) -> str:
        return f"named_struct('debit_amount', {debit}, 'credit_amount', {credit_}, 'balance', {balance})"

    return f"""CASE
      WHEN size({amounts}) >= 3 THEN {row(first, f"abs({b})", last)}
      WHEN size({amounts}) = 2 AND {a} = 0 AND {b} <> 0 THEN {row(ZERO, f"abs({b})", ZERO)}
      WHEN size({amounts}) = 2 AND {b} = 0 AND {a} <> 0 THEN {row(first, ZERO, ZERO)}
      WHEN {credit} THEN {row(ZERO, first, f"coalesce({b}, {ZERO})")}
      ELSE {row(first, ZERO, f"coalesce({b}, {ZERO})")} END"""
