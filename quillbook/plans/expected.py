"""Expected results as ANSI SQL over the driver tables.

Statement queries are checked as a round trip: the SQL reads the orders a
statement was printed from and never parses text.
"""

from __future__ import annotations

from quillbook.functions import patterns as p
from quillbook.plans.queries import DATE_STYLES, PROMPT_BASE
from quillbook.sources.derived import CREDIT_WORDS, DEBIT_WORDS, DOCUMENT_SUFFIXES, FIRST_NAMES, LAST_NAMES, QUESTION_TAILS

EXPECTED: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(words, index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {quoted(w)}" for i, w in enumerate(words)) + " END"


def dbl(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)


MONEY = "DECIMAL(18,2)"
ORDERS = f"""orders_ AS (
  SELECT o_custkey AS account, o_orderkey, CAST(o_orderdate AS DATE) AS txn_date, o_orderstatus = 'P' AS is_credit,
    CASE WHEN o_orderstatus = 'P' THEN {pick(CREDIT_WORDS, 'o_orderkey % 4')}
         ELSE {pick(DEBIT_WORDS, 'o_orderkey % 16')} END AS description,
    CAST(CAST(round(o_totalprice) AS BIGINT) * CAST(0.01 AS DECIMAL(3,2)) AS {MONEY}) AS amount
  FROM orders)"""
TXNS = f"""{ORDERS}, txns AS (
  SELECT 'stmt_' || account || '.txt' AS file_name, account,
    CAST(row_number() OVER w AS BIGINT) AS seq, o_orderkey, txn_date, CAST(txn_date AS VARCHAR) AS date, description, amount,
    CAST(CASE WHEN is_credit THEN 0 ELSE amount END AS {MONEY}) AS debit_amount,
    CAST(CASE WHEN is_credit THEN amount ELSE 0 END AS {MONEY}) AS credit_amount,
    CAST(400000.00 + sum(CASE WHEN is_credit THEN amount ELSE -amount END) OVER w AS {MONEY}) AS balance
  FROM orders_ WINDOW w AS (PARTITION BY account ORDER BY txn_date, o_orderkey ROWS UNBOUNDED PRECEDING))"""
BAD = f"""{TXNS}, bad AS (
  SELECT file_name, seq * 2 + c AS pos,
    CASE WHEN o_orderkey % 97 = 0 THEN '00-00-00' ELSE date END AS date,
    CASE WHEN o_orderkey % 59 = 0 THEN '' ELSE description END AS description,
    CAST(CASE WHEN o_orderkey % 67 = 0 THEN 0 WHEN o_orderkey % 61 = 0 THEN amount ELSE debit_amount END AS {MONEY}) AS debit_amount,
    CAST(CASE WHEN o_orderkey % 67 = 0 THEN 0 WHEN o_orderkey % 61 = 0 THEN amount ELSE credit_amount END AS {MONEY}) AS credit_amount,
    CAST(balance + CASE WHEN o_orderkey % 73 = 0 THEN 25 ELSE 0 END AS {MONEY}) AS balance
  FROM txns, (VALUES (0), (1)) v(c) WHERE c = 0 OR o_orderkey % 53 = 0),
distinct_bad AS (
  SELECT * FROM bad QUALIFY row_number() OVER (
    PARTITION BY file_name, date, lower(description), debit_amount, credit_amount, balance ORDER BY pos) = 1),
issues AS (
  SELECT file_name, pos, unnest(list_filter([
    CASE WHEN date = '00-00-00' THEN 'invalid or incomplete date' END,
    CASE WHEN trim(description) = '' THEN 'missing description' END,
    CASE WHEN debit_amount = 0 AND credit_amount = 0 THEN 'zero amount' END,
    CASE WHEN debit_amount > 0 AND credit_amount > 0 THEN 'both debit and credit present' END], lambda x: x IS NOT NULL)) AS issue
  FROM bad)"""


def rule_sql(field: str) -> str:
    """The rule table as CASE; field is 'category' or 'confidence'."""
    cases = []
    for category, keywords in p.CATEGORY_KEYWORDS:
        hit = " OR ".join(f"contains(' ' || lower(description) || ' ', {quoted(k)})" for k in keywords)
        if category == "Salary":
            hit = f"({hit}) AND credit_amount > 0"
        value = quoted(category) if field == "category" else ("0.7" if category == "Transfer" else "0.93")
        cases.append(f"WHEN {hit} THEN {value}")
    low = {"category": ("'Income'", "'Other Expense'", "'Unknown'"), "confidence": ("0.4", "0.4", "0.2")}[field]
    chain = " ".join(cases)
    value = (
        f"CASE {chain} WHEN credit_amount > 0 AND debit_amount = 0 THEN {low[0]} "
        f"WHEN debit_amount > 0 THEN {low[1]} ELSE {low[2]} END"
    )
    return value if field == "category" else f"CAST({value} AS DOUBLE)"


# --- transactions ---------------------------------------------------------------
EXPECTED["spend_by_category"] = f"""WITH {TXNS}, ruled AS (SELECT *, {rule_sql('category')} AS category FROM txns)
SELECT category, CAST(sum(debit_amount) AS DOUBLE) AS total_debit, CAST(sum(credit_amount) AS DOUBLE) AS total_credit,
  CAST(sum(debit_amount) AS DOUBLE) / count(*) AS average_debit, count(*) AS n FROM ruled GROUP BY category"""
EXPECTED["classify_rules"] = f"""WITH {TXNS} SELECT file_name, seq, description, {rule_sql('category')} AS rule_category,
  {rule_sql('confidence')} AS rule_confidence FROM txns"""
EXPECTED["classify_rule_table"] = EXPECTED["classify_rules"]
EXPECTED["running_balance"] = f"""WITH {BAD}, seen AS (
  SELECT *, lag(balance) OVER (PARTITION BY file_name ORDER BY pos) AS previous_balance FROM bad)
SELECT file_name, pos, CAST(previous_balance AS DOUBLE) AS previous_balance,
  CAST(previous_balance - debit_amount + credit_amount AS DOUBLE) AS expected_balance,
  coalesce(abs(previous_balance - debit_amount + credit_amount - balance) > 1, false) AS breaks FROM seen"""
EXPECTED["txn_validate"] = f"""WITH {BAD}, listed AS (
  SELECT file_name, pos, string_agg(issue, '; ' ORDER BY CASE issue WHEN 'invalid or incomplete date' THEN 1
    WHEN 'missing description' THEN 2 WHEN 'zero amount' THEN 3 ELSE 4 END) AS issues FROM issues GROUP BY ALL)
SELECT bad.file_name, bad.pos, coalesce(issues, '') AS issues, issues IS NULL AS is_valid
FROM bad LEFT JOIN listed USING (file_name, pos)"""
EXPECTED["txn_dedupe"] = f"""WITH {BAD} SELECT file_name, pos, date, description,
  {dbl('debit_amount', 'credit_amount', 'balance')} FROM distinct_bad"""
EXPECTED["issue_counts"] = f"""WITH {BAD} SELECT file_name, issue, count(*) AS n FROM issues
  JOIN distinct_bad USING (file_name, pos) GROUP BY file_name, issue"""
EXPECTED["stmt_summary"] = f"""WITH {TXNS} SELECT file_name, count(*) AS transaction_count,
  CAST(sum(debit_amount) AS DOUBLE) AS total_debit, CAST(sum(credit_amount) AS DOUBLE) AS total_credit,
  CAST(arg_max(balance, seq) AS DOUBLE) AS last_balance, CAST(0 AS BIGINT) AS balance_mismatches FROM txns GROUP BY file_name"""

# --- scalars ----------------------------------------------------------------------
SPARK_TO_STRFTIME = {
    "dd/MM/yyyy": "%d/%m/%Y", "dd-MM-yyyy": "%d-%m-%Y", "dd/MM/yy": "%d/%m/%y", "dd-MM-yy": "%d-%m-%y",
    "MM/dd/yyyy": "%m/%d/%Y", "yyyy-MM-dd": "%Y-%m-%d", "dd.MM.yyyy": "%d.%m.%Y", "dd-MMM-yyyy": "%d-%b-%Y",
    "dd-MMM-yy": "%d-%b-%y", "dd MMM yyyy": "%d %b %Y", "dd MMMM yyyy": "%d %B %Y", "dd/MMM/yyyy": "%d/%b/%Y",
    "dd/MM": "%d/%m", "dd MMM": "%d %b", "yyyy-MM": "%Y-%m", "MM/yyyy": "%m/%Y",
}
DATED = """CASE o_orderkey % 5 WHEN 0 THEN strftime(txn_date, '%d/%m/%Y') WHEN 1 THEN strftime(txn_date, '%d-%m-%Y')
  WHEN 2 THEN strftime(txn_date, '%d-%b-%Y') WHEN 3 THEN strftime(txn_date, '%Y-%m-%d')
  ELSE strftime(txn_date, '%d.%m.%Y') END"""
EXPECTED["date_tokens"] = f"""WITH {ORDERS} SELECT o_orderkey,
  CASE WHEN o_orderkey % 97 = 0 THEN '00-00-00' ELSE {DATED} END AS token FROM orders_"""
_shown = "CASE o_orderkey % 16 " + " ".join(
    f"WHEN {i} THEN strftime(txn_date, '{SPARK_TO_STRFTIME[s]}')" for i, s in enumerate(DATE_STYLES)
) + " END"
EXPECTED["date_normalize"] = f"""WITH {ORDERS} SELECT o_orderkey, {_shown} AS shown,
  CASE WHEN o_orderkey % 16 IN (12, 13) AND strftime(txn_date, '%m-%d') = '02-29' THEN NULL
    WHEN o_orderkey % 16 >= 12 THEN {_shown}
    WHEN o_orderkey % 16 = 4 AND day(txn_date) <= 12
      THEN CAST(make_date(year(txn_date), day(txn_date), month(txn_date)) AS VARCHAR)
    ELSE CAST(txn_date AS VARCHAR) END AS normalized FROM orders_"""
EXPECTED["money_tokens"] = f"""WITH {ORDERS} SELECT o_orderkey,
  CASE WHEN o_orderkey % 7 = 6 THEN 'weak' ELSE 'strong' END AS strength,
  CAST(CASE o_orderkey % 7 WHEN 2 THEN -amount WHEN 6 THEN amount * 100 ELSE amount END AS DOUBLE) AS amount,
  CAST(CASE o_orderkey % 7 WHEN 2 THEN -amount WHEN 6 THEN amount * 100 ELSE amount END AS DOUBLE) AS cell FROM orders_"""

# --- text statements ------------------------------------------------------------------
PRINTED = f"""{TXNS}, rows_ AS (
  SELECT *, {DATED} AS shown_date,
    CASE WHEN credit_amount > 0 THEN 'deposits' WHEN description = 'CARD FEE' THEN 'fees'
         WHEN o_orderkey % 7 = 0 THEN 'checks' ELSE 'withdrawals' END AS section FROM txns),
faults AS (
  SELECT *, CASE WHEN section = 'checks' THEN 'CHECK ' || (o_orderkey + 1000) ELSE description END AS words,
    CASE WHEN o_orderkey % 97 = 0 THEN 'bad_date' WHEN o_orderkey % 53 = 0 THEN 'twice'
         WHEN o_orderkey % 71 = 0 THEN 'continued' WHEN o_orderkey % 89 = 0 THEN 'terminal'
         WHEN o_orderkey % 83 = 0 AND section <> 'checks' THEN 'misread' ELSE 'none' END AS fault FROM rows_),
printed AS (
  SELECT *, words || CASE WHEN fault = 'terminal' THEN ' TERMINAL 24349201' ELSE '' END AS printed_words,
    CASE WHEN fault = 'bad_date' THEN '00-00-00' ELSE shown_date END AS printed_date,
    CAST(debit_amount * CASE WHEN fault = 'misread' THEN 100 ELSE 1 END AS {MONEY}) AS printed_debit,
    CAST(credit_amount * CASE WHEN fault = 'misread' THEN 100 ELSE 1 END AS {MONEY}) AS printed_credit FROM faults),
check_rows AS (
  SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY txn_date, o_orderkey) - 1 AS nth
  FROM printed WHERE section = 'checks'),
accounts AS (
  SELECT file_name, account, arg_max(balance, seq) AS last_balance, bool_or(section = 'deposits') AS has_deposits,
    bool_or(section = 'withdrawals') AS has_withdrawals, bool_or(section = 'fees') AS has_fees,
    bool_or(section = 'checks') AS has_checks FROM printed GROUP BY ALL),
row_texts AS (
  SELECT file_name, seq, fault, printed_date || ' ' || printed_words || ' ' || printed_debit || ' ' || printed_credit || ' ' || balance AS main
  FROM printed),
stmt AS (
  SELECT file_name, 0 AS part, CAST(ord_no AS BIGINT) AS ord_no, kind, line AS text FROM (
    SELECT file_name, unnest([0, 1, 2, 3, 4, 5, 6]) AS ord_no,
      unnest(['head', 'head', 'head', 'head', 'head', 'opening', 'header']) AS kind,
      unnest(['FIRST NATIONAL BANK', 'Account Number: ' || (account + 1000000000),
        'Account Holder Name: ' || coalesce(replace(c_name, '#', ' '), 'Holder ' || account),
        'IFSC: FNBK0' || lpad(CAST(account AS VARCHAR), 6, '0'), 'Statement Period: 01 Jan 1995 to 31 Dec 2001',
        'Opening Balance: 400000.00', 'Date Description Debit Credit Balance']) AS line
    FROM accounts LEFT JOIN customer ON c_custkey = account)
  UNION ALL SELECT file_name, 1, seq * 2, 'row', main FROM row_texts
  UNION ALL SELECT file_name, 1, seq * 2 + 1, 'row', main FROM row_texts WHERE fault = 'twice'
  UNION ALL SELECT file_name, 1, seq * 2 + 1, 'more', 'late night order' FROM row_texts WHERE fault = 'continued'
  UNION ALL SELECT file_name, 2, 0, 'closing', 'Closing Balance: ' || last_balance FROM accounts
  UNION ALL SELECT file_name, 3, 0, 'title', 'Deposits and Other Credits' FROM accounts WHERE has_deposits
  UNION ALL SELECT file_name, 4, 0, 'title', 'Withdrawals and Other Debits' FROM accounts WHERE has_withdrawals
  UNION ALL SELECT file_name, 5, 0, 'title', 'Account Service Charges and Fees' FROM accounts WHERE has_fees
  UNION ALL SELECT file_name, 6, 0, 'title', 'Checks Paid' FROM accounts WHERE has_checks
  UNION ALL SELECT file_name, 6, 1, 'heading', 'Check # Date Amount Check # Date Amount Check # Date Amount' FROM accounts WHERE has_checks
  UNION ALL SELECT file_name, CASE section WHEN 'deposits' THEN 3 WHEN 'withdrawals' THEN 4 ELSE 5 END, seq + 1, 'detail',
    shown_date || ' ' || words || ' ' || amount FROM printed WHERE section <> 'checks'
  UNION ALL SELECT file_name, 6, nth // 3 + 2, 'checks', string_agg(
    (o_orderkey + 1000) || ' ' || strftime(txn_date, '%m/%d') || ' $' || debit_amount, ' ' ORDER BY nth)
    FROM check_rows GROUP BY file_name, nth // 3),
numbered AS (SELECT *, CAST(part AS BIGINT) * 1099511627776 + ord_no AS line_no FROM stmt)"""
READ = f"""{PRINTED}, primary_rows AS (
  SELECT file_name, seq, date, section, fault, printed_words || CASE WHEN fault = 'continued' THEN ' late night order' ELSE '' END AS description,
    printed_debit AS debit_amount, printed_credit AS credit_amount, balance FROM printed WHERE fault <> 'bad_date'),
details AS (
  SELECT file_name, seq, section AS part, date, words AS description, debit_amount, credit_amount FROM printed WHERE section <> 'checks'
  UNION ALL SELECT file_name, seq, section, strftime(txn_date, '%m/%d'), words, debit_amount, credit_amount
  FROM printed WHERE section = 'checks' AND strftime(txn_date, '%m/%d') <> '02/29')"""
FIXED = f"""{READ}, seen AS (
  SELECT *, lag(balance) OVER (PARTITION BY file_name ORDER BY seq) AS before FROM primary_rows),
broken AS (SELECT * FROM seen WHERE abs(before - debit_amount + credit_amount - balance) > 1),
offers AS (
  SELECT b.file_name, b.seq, d.debit_amount + d.credit_amount AS offer,
    row_number() OVER (PARTITION BY b.file_name, b.seq ORDER BY
      CASE d.part WHEN 'withdrawals' THEN 0 WHEN 'fees' THEN 1 WHEN 'checks' THEN 2 ELSE 3 END, d.seq) AS nth
  FROM broken b JOIN details d ON b.file_name = d.file_name AND b.date = d.date AND (b.debit_amount > 0) = (d.part <> 'deposits')
  WHERE d.debit_amount + d.credit_amount <> b.debit_amount + b.credit_amount
    AND abs(b.before + CASE WHEN b.debit_amount > 0 THEN -1 ELSE 1 END * (d.debit_amount + d.credit_amount) - b.balance) <= 1),
fixed AS (
  SELECT s.file_name, s.seq, s.date, s.description, s.balance, s.before,
    CAST(CASE WHEN offer IS NOT NULL AND s.debit_amount > 0 THEN offer ELSE s.debit_amount END AS {MONEY}) AS debit_amount,
    CAST(CASE WHEN offer IS NOT NULL AND s.credit_amount > 0 THEN offer ELSE s.credit_amount END AS {MONEY}) AS credit_amount,
    CASE WHEN offer IS NOT NULL THEN s.debit_amount + s.credit_amount END AS misread
  FROM seen s LEFT JOIN (SELECT * FROM offers WHERE nth = 1) o ON s.file_name = o.file_name AND s.seq = o.seq)"""
EXPECTED["stmt_lines"] = f"""WITH {PRINTED} SELECT file_name, line_no, text,
  kind IN ('row', 'detail', 'checks') OR text LIKE 'Statement Period%' AS has_date,
  kind IN ('opening', 'closing') AS is_noise, kind IN ('opening', 'closing') AS is_balance_label FROM numbered"""
EXPECTED["section_roles"] = f"""WITH {PRINTED} SELECT file_name, line_no,
  CASE WHEN part = 0 AND kind <> 'header' THEN 'none' WHEN part <= 2 THEN 'table' WHEN part = 3 THEN 'deposits'
    WHEN part = 4 THEN 'withdrawals' WHEN part = 5 THEN 'fees' ELSE 'checks' END AS region FROM numbered WHERE kind <> 'title'"""
EXPECTED["line_chunks"] = f"""WITH {PRINTED} SELECT file_name,
  main || CASE WHEN fault = 'continued' THEN ' late night order' ELSE '' END AS chunk FROM row_texts
UNION ALL SELECT file_name, main FROM row_texts WHERE fault = 'twice'"""
EXPECTED["date_windows"] = f"""WITH {PRINTED} SELECT file_name,
  CASE part WHEN 3 THEN 'deposits' WHEN 4 THEN 'withdrawals' ELSE 'fees' END AS part, text AS chunk FROM stmt WHERE kind = 'detail'"""
EXPECTED["bad_dates"] = f"""WITH {PRINTED} SELECT file_name, count(*) FILTER (WHERE fault = 'bad_date') AS bad_dates
FROM printed GROUP BY file_name"""
EXPECTED["txn_parse"] = f"""WITH {READ} SELECT file_name, 'primary' AS part, date, description,
  {dbl('debit_amount', 'credit_amount', 'balance')} FROM primary_rows
UNION ALL SELECT file_name, part, date, description, CAST(debit_amount AS DOUBLE), CAST(credit_amount AS DOUBLE), CAST(0 AS DOUBLE) FROM details"""
EXPECTED["check_ledger"] = f"""WITH {READ} SELECT file_name, date, description, CAST(debit_amount AS DOUBLE) AS debit_amount
FROM details WHERE part = 'checks'"""
EXPECTED["plain_parse"] = f"""WITH {TXNS} SELECT 'plain_' || account || '.txt' AS file_name, date,
  description || CASE WHEN o_orderkey % 71 = 0 THEN ' late night order' ELSE '' END AS description,
  {dbl('debit_amount', 'credit_amount')}, CAST(0 AS DOUBLE) AS balance FROM txns"""
EXPECTED["letterhead_fields"] = f"""SELECT 'letter_' || c_custkey || '.txt' AS file_name, 'UNION BANK' AS bank_name,
  {pick(FIRST_NAMES, 'c_custkey % 5')} || ' ' || {pick(LAST_NAMES, 'c_custkey % 3')} AS account_holder_name,
  CAST(c_custkey + 1000000000 AS VARCHAR) AS account_number,
  CASE WHEN c_custkey % 4 IN (0, 3) THEN 'UNBK0' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS ifsc_code,
  CASE WHEN c_custkey % 4 <> 2 THEN CAST(c_custkey * 1000 + 0.5 AS DOUBLE) END AS opening_balance, CAST(c_custkey * 3000 + 0.25 AS DOUBLE) AS closing_balance,
  CASE WHEN c_custkey % 4 = 1 THEN 'January 1, 2020 to January 31, 2020' ELSE '1 Jan 2020 to 31 Jan 2020' END AS statement_period FROM customer"""
EXPECTED["stmt_metadata"] = f"""WITH {PRINTED} SELECT file_name, 'FIRST NATIONAL BANK' AS bank_name,
  coalesce(replace(c_name, '#', ' '), 'Holder ' || account) AS account_holder_name,
  CAST(account + 1000000000 AS VARCHAR) AS account_number, 'FNBK0' || lpad(CAST(account AS VARCHAR), 6, '0') AS ifsc_code,
  CAST(400000 AS DOUBLE) AS opening_balance, CAST(last_balance AS DOUBLE) AS closing_balance,
  '01 Jan 1995 to 31 Dec 2001' AS statement_period FROM accounts LEFT JOIN customer ON c_custkey = account"""
EXPECTED["repair_amounts"] = f"""WITH {FIXED} SELECT file_name, date, description,
  {dbl('debit_amount', 'credit_amount', 'misread')} FROM fixed WHERE misread IS NOT NULL"""
EXPECTED["stmt_parse"] = f"""WITH {FIXED}, model AS (SELECT 1), {{nb}} , ruled AS (
  SELECT *, {rule_sql('category')} AS rule_category, {rule_sql('confidence')} AS rule_confidence FROM fixed)
SELECT file_name, date, ruled.description, {dbl('debit_amount', 'credit_amount', 'balance')},
  CASE WHEN rule_confidence < 0.72 AND nb_confidence >= 0.45 THEN nb_category ELSE rule_category END AS category
FROM ruled JOIN scored ON ruled.description = scored.description"""


def money_text(x: str) -> str:
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


_WORD = lambda w: f"regexp_matches(description, '(?i)\\b({w})\\b')"
TOTALS = """totals AS (
  SELECT file_name, count(*) AS transaction_count, sum(debit_amount) AS total_debit, sum(credit_amount) AS total_credit,
    count(*) FILTER (WHERE abs(before - debit_amount + credit_amount - balance) > 1) AS balance_mismatches,
    coalesce(sum(debit_amount) FILTER (WHERE {check}), 0) AS check_debits,
    coalesce(sum(debit_amount) FILTER (WHERE {cash}), 0) AS cash_debits,
    coalesce(sum(debit_amount) FILTER (WHERE NOT {fee}), 0) AS other_debits,
    coalesce(sum(debit_amount) FILTER (WHERE NOT {either}), 0) AS plain_debits,
    coalesce(sum(debit_amount) FILTER (WHERE {fee}), 0) AS fee_debits
  FROM {source} GROUP BY file_name),
sections AS (
  SELECT file_name, sum(debit_amount + credit_amount) FILTER (WHERE part = 'checks') AS checks_total,
    sum(credit_amount) FILTER (WHERE part = 'deposits') AS deposits_total,
    sum(debit_amount) FILTER (WHERE part = 'withdrawals') AS withdrawals_total,
    sum(debit_amount + credit_amount) FILTER (WHERE part = 'fees') AS fees_total FROM details GROUP BY file_name)"""


def totals_sql(source: str) -> str:
    return TOTALS.format(
        check=_WORD("check|chq|cheque"), cash=_WORD("atm|withdrawal"), fee=_WORD("fee|service charge|charges"),
        either=_WORD("check|chq|cheque|checque|fee|service charge|charges"), source=source,
    )


SECTION_WARNINGS = f"""
  CASE WHEN abs(check_debits - checks_total) > 1 THEN 'Checks Paid totals (' || {money_text('checks_total')} ||
    ') do not match check debits in the primary table (' || {money_text('check_debits')} || ').' END,
  CASE WHEN abs(total_credit - deposits_total) > 1 THEN 'Deposits and Other Credits totals (' || {money_text('deposits_total')} ||
    ') do not match credits in the primary table (' || {money_text('total_credit')} || ').' END,
  CASE WHEN abs(cash_debits - withdrawals_total) > 1 AND abs(other_debits - withdrawals_total) > 1 AND abs(plain_debits - withdrawals_total) > 1
    THEN 'Withdrawals and Other Debits totals (' || {money_text('withdrawals_total')} || ') do not match primary-table debits (' ||
    {money_text('cash_debits')} || ' cash withdrawals / ' || {money_text('plain_debits')} || ' non-check debits).' END,
  CASE WHEN abs(fee_debits - fees_total) > 1 THEN 'Account Service Charges totals (' || {money_text('fees_total')} ||
    ') do not match primary-table fee debits (' || {money_text('fee_debits')} || ').' END"""
EXPECTED["section_recon"] = f"""WITH {FIXED}, {totals_sql('seen')}
SELECT file_name, {dbl('checks_total', 'deposits_total', 'withdrawals_total', 'fees_total')},
  concat_ws(' | ', {SECTION_WARNINGS}) AS warnings FROM totals LEFT JOIN sections USING (file_name)"""
VALIDATED = f"""{FIXED}, {totals_sql('fixed')}, bad_rows AS (
  SELECT file_name, count(*) FILTER (WHERE fault = 'bad_date') AS bad_dates FROM printed GROUP BY file_name),
joined AS (
  SELECT file_name, last_balance, coalesce(transaction_count, 0) AS transaction_count,
    coalesce(total_debit, 0) AS total_debit, coalesce(total_credit, 0) AS total_credit,
    coalesce(balance_mismatches, 0) AS balance_mismatches, bad_dates, coalesce(check_debits, 0) AS check_debits,
    coalesce(cash_debits, 0) AS cash_debits, coalesce(other_debits, 0) AS other_debits,
    coalesce(plain_debits, 0) AS plain_debits, coalesce(fee_debits, 0) AS fee_debits,
    checks_total, deposits_total, withdrawals_total, fees_total,
    CAST(400000 + coalesce(total_credit, 0) - coalesce(total_debit, 0) AS {MONEY}) AS expected_closing_balance
  FROM accounts LEFT JOIN totals USING (file_name) LEFT JOIN sections USING (file_name) LEFT JOIN bad_rows USING (file_name)),
warned AS (
  SELECT *, concat_ws(' | ',
    CASE WHEN transaction_count = 0 THEN 'No transaction rows could be parsed from this document.' END,
    CASE WHEN bad_dates > 0 THEN bad_dates || ' row(s) with invalid or unreadable transaction dates were skipped.' END,
    CASE WHEN balance_mismatches > 0 THEN balance_mismatches ||
      ' transaction(s) do not follow running-balance arithmetic; OCR or layout gaps are likely.' END,
    CASE WHEN abs(expected_closing_balance - last_balance) > 1 THEN 'Reported closing balance ' || {money_text('last_balance')} ||
      ' differs from the reconciled balance ' || {money_text('expected_closing_balance')} || ' (opening 400,000.00 + credits ' ||
      {money_text('total_credit')} || ' - debits ' || {money_text('total_debit')} || ').' END,
    {SECTION_WARNINGS}) AS warnings FROM joined)"""
EXPECTED["stmt_validation"] = f"""WITH {VALIDATED} SELECT file_name, transaction_count,
  {dbl('total_debit', 'total_credit', 'expected_closing_balance')}, CAST(last_balance AS DOUBLE) AS reported_closing_balance,
  balance_mismatches, bad_dates, CASE WHEN transaction_count = 0 THEN 'error' WHEN warnings <> '' THEN 'warning' ELSE 'ok' END AS validation_status,
  warnings FROM warned"""
EXPECTED["validation_checks"] = f"""WITH {VALIDATED}
SELECT file_name, 'transaction_count' AS "check", '>= 1' AS expected, CAST(transaction_count AS VARCHAR) AS actual,
  CASE WHEN transaction_count > 0 THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN transaction_count > 0 THEN '' ELSE 'No validated transactions were extracted.' END AS message FROM warned
UNION ALL SELECT file_name, 'valid_dates', 'all rows', CAST(transaction_count AS VARCHAR), 'ok', '' FROM warned
UNION ALL SELECT file_name, 'no_duplicates', '0', '0', 'ok', '' FROM warned
UNION ALL SELECT file_name, 'running_balance', '0', CAST(balance_mismatches AS VARCHAR),
  CASE WHEN balance_mismatches > 0 THEN 'warning' ELSE 'ok' END,
  balance_mismatches || ' rows deviate from running-balance arithmetic.' FROM warned
UNION ALL SELECT file_name, 'closing_balance', CAST(expected_closing_balance AS VARCHAR), CAST(last_balance AS VARCHAR),
  CASE WHEN abs(expected_closing_balance - last_balance) > 1 THEN 'warning' ELSE 'ok' END, '' FROM warned"""

# --- tables and tokens -----------------------------------------------------------------
CELLS = f"""{TXNS}, tabled AS (
  SELECT *, 'rows_' || account || '.csv' AS table_name, {DATED} AS shown_date, o_orderkey % 71 = 0 AS continued,
    CASE WHEN account % 2 = 0 THEN 'wide' WHEN account % 4 = 3 THEN 'short' ELSE 'narrow' END AS layout FROM txns),
cells_ AS (
  SELECT DISTINCT table_name AS file_name, layout, CAST(0 AS BIGINT) AS row_no, CASE layout
    WHEN 'wide' THEN ['Txn Date', 'Narration', 'Withdrawal', 'Deposit', 'Balance']
    WHEN 'narrow' THEN ['Date', 'Description', 'Amount', 'Balance'] ELSE ['Date', 'Description', 'Amount'] END AS cells FROM tabled
  UNION ALL SELECT table_name, layout, seq * 2, CASE layout
    WHEN 'wide' THEN [shown_date, description, CAST(debit_amount AS VARCHAR), CAST(credit_amount AS VARCHAR), CAST(balance AS VARCHAR)]
    WHEN 'narrow' THEN [shown_date, description, CAST(amount AS VARCHAR), CAST(balance AS VARCHAR)]
    ELSE [shown_date, description, CAST(amount AS VARCHAR)] END FROM tabled
  UNION ALL SELECT table_name, layout, seq * 2 + 1, CASE layout WHEN 'wide' THEN ['', 'late night order', '', '', '']
    WHEN 'narrow' THEN ['', 'late night order', '', ''] ELSE ['', 'late night order', ''] END FROM tabled WHERE continued),
page_rows AS (
  SELECT file_name, CAST((row_no - 2) // 100 + 1 AS INTEGER) AS page_no, (row_no - 2) % 100 + 1 AS row, cells
  FROM cells_ WHERE row_no > 0),
pages_ AS (
  SELECT * FROM page_rows UNION ALL
  SELECT p.file_name, page_no, CAST(0 AS BIGINT), c.cells FROM (SELECT DISTINCT file_name, page_no FROM page_rows) p
  JOIN cells_ c ON c.file_name = p.file_name AND c.row_no = 0),
page_lines AS (
  SELECT file_name, page_no, row, cells, CAST(row_number() OVER (PARTITION BY file_name, page_no ORDER BY row) - 1 AS BIGINT) AS line_no,
    array_to_string(list_filter(cells, lambda c: c <> ''), ' ') AS text FROM pages_)"""
EXPECTED["header_map"] = f"""WITH {CELLS} SELECT DISTINCT file_name, CAST(0 AS BIGINT) AS date, CAST(1 AS BIGINT) AS description,
  CAST(CASE WHEN layout = 'wide' THEN 2 ELSE -1 END AS BIGINT) AS debit, CAST(CASE WHEN layout = 'wide' THEN 3 ELSE -1 END AS BIGINT) AS credit,
  CAST(CASE layout WHEN 'wide' THEN 4 WHEN 'narrow' THEN 3 ELSE -1 END AS BIGINT) AS balance,
  CAST(CASE WHEN layout = 'wide' THEN -1 ELSE 2 END AS BIGINT) AS amount FROM cells_"""
_described = "description || CASE WHEN continued THEN ' late night order' ELSE '' END AS description"
EXPECTED["tabular_parse"] = f"""WITH {CELLS} SELECT table_name AS file_name, seq * 2 AS pos, date, {_described},
  {dbl('debit_amount', 'credit_amount')}, CAST(CASE WHEN layout = 'short' THEN 0 ELSE balance END AS DOUBLE) AS balance FROM tabled"""
_parity = ("layout <> 'wide' AND (layout = 'short' OR NOT (contains(shown_date || ' ' || description, 'CR') "
           "OR regexp_matches(description, 'CREDIT|SALARY|INTEREST|REFUND')))")
EXPECTED["tabular_parse_parity"] = f"""WITH {CELLS} SELECT table_name AS file_name, seq * 2 AS pos, date, {_described},
  CAST(CASE WHEN layout = 'wide' THEN debit_amount WHEN {_parity} THEN amount ELSE 0 END AS DOUBLE) AS debit_amount,
  CAST(CASE WHEN layout = 'wide' THEN credit_amount WHEN {_parity} THEN 0 ELSE amount END AS DOUBLE) AS credit_amount,
  CAST(CASE WHEN layout = 'short' THEN 0 ELSE balance END AS DOUBLE) AS balance FROM tabled"""
EXPECTED["row_chunks"] = f"""WITH {CELLS} SELECT file_name, row_no, regexp_replace(array_to_string(cells, ' | '), '^\\s+|\\s+$', '', 'g') AS text,
  'CSV, row ' || row_no AS section, regexp_replace(array_to_string(cells, ' | '), '^\\s+|\\s+$', '', 'g')[1:300] AS excerpt FROM cells_"""
EXPECTED["word_lines"] = f"""WITH {CELLS} SELECT file_name, page_no, 25 + 5 * row AS line_no, text FROM page_lines"""
EXPECTED["token_lines"] = f"""WITH {CELLS} SELECT file_name, page_no, line_no, text FROM page_lines"""
EXPECTED["token_columns"] = f"""WITH {CELLS} SELECT file_name, page_no, line_no, array_to_string(cells, '|') AS cells FROM page_lines"""
EXPECTED["token_txns"] = f"""WITH {CELLS} SELECT table_name AS file_name, date, {_described},
  {dbl('debit_amount', 'credit_amount')}, CAST(CASE WHEN layout = 'short' THEN 0 ELSE balance END AS DOUBLE) AS balance FROM tabled"""
SCORES = f"""{BAD}, candidates AS (
  SELECT 'line_window' AS strategy, file_name, pos, date, description, debit_amount, credit_amount, balance FROM bad
  UNION ALL SELECT 'box_columns', file_name, seq, date, description, debit_amount, credit_amount, CAST(0 AS {MONEY}) FROM txns
  UNION ALL SELECT 'pdf_tables', file_name, seq, date, description, debit_amount, credit_amount, balance FROM txns),
raw AS (SELECT file_name, strategy, count(*) AS row_count FROM candidates GROUP BY ALL),
uniq AS (SELECT *, date <> '00-00-00' AND trim(description) <> '' AND (debit_amount = 0) <> (credit_amount = 0) AS ok
  FROM candidates QUALIFY row_number() OVER (
    PARTITION BY file_name, strategy, date, lower(description), debit_amount, credit_amount, balance ORDER BY pos) = 1),
good AS (SELECT *, lag(balance) OVER (PARTITION BY file_name, strategy ORDER BY pos) AS before FROM uniq WHERE ok),
quality AS (SELECT file_name, strategy, count(*) AS valid_count, count(*) FILTER (WHERE before <> 0 AND balance <> 0
  AND abs(before - debit_amount + credit_amount - balance) <= 1) AS balanced FROM good GROUP BY ALL),
counts AS (SELECT file_name, strategy, count(*) AS kept, count(*) FILTER (WHERE NOT ok) AS dropped FROM uniq GROUP BY ALL),
scores AS (
  SELECT file_name, strategy, row_count, coalesce(valid_count, 0) AS valid_count, dropped, row_count - kept AS duplicates,
    CASE WHEN valid_count IS NULL THEN CAST('-inf' AS DOUBLE) ELSE round(CAST(9.0 AS DOUBLE) + CAST(5.0 AS DOUBLE) * balanced / greatest(valid_count - 1, 1)
      - CAST(2.0 AS DOUBLE) * dropped - CAST(1.5 AS DOUBLE) * (row_count - kept), 6) END AS score
  FROM raw JOIN counts USING (file_name, strategy) LEFT JOIN quality USING (file_name, strategy))"""
EXPECTED["strategy_score"] = f"""WITH {SCORES} SELECT * FROM scores"""
EXPECTED["strategy_pick"] = f"""WITH {SCORES} SELECT file_name, strategy FROM scores QUALIFY row_number() OVER (
  PARTITION BY file_name ORDER BY score DESC, row_count DESC,
  CASE strategy WHEN 'line_window' THEN 0 WHEN 'box_columns' THEN 1 ELSE 2 END) = 1"""

# --- categories and exports ----------------------------------------------------------------
EXPECTED["nb_train"] = """WITH labelled AS (
  SELECT CAST(quality AS VARCHAR) AS label, text FROM labels JOIN documents USING (doc_id)),
tokens AS (SELECT label, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS token FROM labelled),
docs AS (SELECT label, count(*) AS docs FROM labelled GROUP BY label)
SELECT label, docs, coalesce(count(token), 0) AS token_total, count(DISTINCT token) AS distinct_tokens,
  (SELECT count(DISTINCT token) FROM tokens) AS vocabulary FROM docs LEFT JOIN tokens USING (label) GROUP BY label, docs"""
_training = ", ".join(
    f"({i}, {quoted(label)}, {quoted(t)})" for i, (label, texts) in enumerate(p.TRAINING_TEXTS) for t in texts
)
NB = f"""training(ord, label, text) AS (VALUES {_training}),
train_tokens AS (SELECT ord, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS token FROM training),
vocabulary AS (SELECT count(DISTINCT token) AS v FROM train_tokens),
classes AS (SELECT ord, label, count(*) AS docs FROM training GROUP BY ord, label),
class_tokens AS (SELECT ord, count(*) AS t FROM train_tokens GROUP BY ord),
class_words AS (SELECT ord, token, count(*) AS n FROM train_tokens GROUP BY ord, token),
texts AS (SELECT DISTINCT description FROM nb_source),
text_tokens AS (SELECT description, token, count(*) AS times FROM (
  SELECT description, unnest(regexp_extract_all(lower(description), '[a-z0-9]{{2,}}')) AS token FROM texts) GROUP BY ALL),
likelihood AS (
  SELECT description, c.ord, sum(times * ln((coalesce(n, 0) + 1.0) / (t + v))) AS ll
  FROM text_tokens CROSS JOIN classes c JOIN class_tokens USING (ord) CROSS JOIN vocabulary
  LEFT JOIN class_words w ON w.ord = c.ord AND w.token = text_tokens.token GROUP BY description, c.ord),
scores_ AS (
  SELECT d.description, c.ord, c.label, ln((docs + 1.0) / (49 + 17)) + coalesce(ll, 0) AS score
  FROM texts d CROSS JOIN classes c LEFT JOIN likelihood l ON l.description = d.description AND l.ord = c.ord),
shifted AS (SELECT *, exp(score - max(score) OVER (PARTITION BY description)) AS w FROM scores_),
scored AS (
  SELECT description, label AS nb_category, w / total AS nb_confidence FROM (
    SELECT *, sum(w) OVER (PARTITION BY description) AS total, row_number() OVER (PARTITION BY description ORDER BY w DESC, ord) AS nth FROM shifted)
  WHERE nth = 1)"""
assert sum(len(t) for _, t in p.TRAINING_TEXTS) == 49 and len(p.TRAINING_TEXTS) == 17
EXPECTED["stmt_parse"] = EXPECTED["stmt_parse"].replace(
    "model AS (SELECT 1), {nb} ", f"nb_source AS (SELECT description FROM fixed), {NB}"
)
EXPECTED["classify_nb"] = f"""WITH {TXNS}, nb_source AS (SELECT description FROM txns), {NB}
SELECT description, nb_category, round(nb_confidence, 6) AS nb_confidence FROM scored"""
EXPECTED["classify_hybrid"] = f"""WITH {TXNS}, nb_source AS (SELECT description FROM txns), {NB},
ruled AS (SELECT *, {rule_sql('category')} AS rule_category, {rule_sql('confidence')} AS rule_confidence FROM txns),
joined AS (SELECT ruled.*, nb_category, nb_confidence, rule_confidence < 0.72 AND nb_confidence >= 0.45 AS by_model
  FROM ruled JOIN scored ON ruled.description = scored.description)
SELECT file_name, seq, description, CASE WHEN by_model THEN nb_category ELSE rule_category END AS category,
  CASE WHEN by_model THEN 'machine_learning' ELSE 'heuristic' END AS classification_method,
  round(CASE WHEN by_model THEN nb_confidence ELSE rule_confidence END, 6) AS confidence FROM joined"""
VALID_BAD = "date <> '00-00-00' AND trim(description) <> '' AND (debit_amount = 0) <> (credit_amount = 0)"
EXPECTED["export_rows"] = f"""WITH {BAD} SELECT date, description, {dbl('debit_amount', 'credit_amount', 'balance')},
  {rule_sql('category')} AS category, {rule_sql('confidence')} AS confidence FROM bad WHERE {VALID_BAD}"""
EXPECTED["export_summary"] = f"""WITH {BAD} SELECT file_name, 'tabular' AS document_type, count(*) AS transaction_count,
  CAST(sum(debit_amount) AS DOUBLE) AS total_debit, CAST(sum(credit_amount) AS DOUBLE) AS total_credit,
  'pdf_tables' AS extraction_method FROM distinct_bad WHERE {VALID_BAD} GROUP BY file_name"""
EXPECTED["stmt_payload"] = f"""WITH {BAD} SELECT file_name, pos, date, description, {dbl('debit_amount', 'credit_amount', 'balance')},
  {rule_sql('category')} AS category, {rule_sql('confidence')} AS confidence FROM bad"""

# --- documents ---------------------------------------------------------------------------------
DOCS = f"""docs AS (
  SELECT doc_id AS document_id, 'doc_' || doc_id || '.' || {pick(DOCUMENT_SUFFIXES, 'doc_id % 8')} AS filename, text,
    CAST(strlen(text) AS BIGINT) AS size FROM documents),
named AS (SELECT *, lower(string_split(filename, '.')[-1]) AS extension FROM docs),
pieces AS (
  SELECT document_id, filename, CAST(ord_no AS BIGINT) AS element_no, trimmed AS text FROM (
    SELECT document_id, filename, unnest(range(len(lines))) AS ord_no,
      regexp_replace(unnest(lines), '^\\s+|\\s+$', '', 'g') AS trimmed
    FROM (SELECT document_id, filename, string_split(text, chr(10)) AS lines FROM docs)) WHERE trimmed <> ''),
fixed_chunks AS (
  SELECT document_id, filename, n AS chunk_no, body AS text FROM (
    SELECT document_id, filename, n, regexp_replace(substring(text, n * 5600 + 1, 6000), '^\\s+|\\s+$', '', 'g') AS body
    FROM docs, LATERAL (SELECT unnest(range(CAST(ceil(length(text) / 5600.0) AS BIGINT))) AS n)) WHERE body <> '')"""
EXPECTED["file_inventory"] = f"""WITH {DOCS} SELECT filename AS file_name, extension, size, sha256(text) AS content_hash,
  CASE WHEN extension = 'exe' THEN 'Unsupported file type: .exe' ELSE '' END AS error,
  extension IN ('pdf', 'txt', 'csv', 'png') OR contains(text[1:1024], '%PDF') AS looks_like_statement,
  CASE WHEN extension = 'pdf' THEN 'pdf' WHEN extension = 'csv' THEN 'tabular' WHEN extension = 'png' THEN 'image' ELSE 'text' END AS loader
FROM named"""
EXPECTED["upload_validate"] = f"""WITH {DOCS} SELECT document_id, filename,
  CASE WHEN size = 0 THEN 'Empty file' WHEN extension = 'exe' THEN 'Unsupported file type: .exe'
    WHEN size > 8192 THEN 'File exceeds size limit (0 MB)' ELSE 'ok' END AS error FROM named"""
EXPECTED["doc_route"] = f"""WITH {DOCS} SELECT document_id,
  CASE WHEN filename LIKE '%statement%' THEN 'bank_statement' WHEN extension = 'png' THEN 'image_ocr' WHEN extension = 'csv' THEN 'spreadsheet'
    WHEN extension IN ('pdf', 'docx') THEN 'document' WHEN extension IN ('txt', 'md') THEN 'text' ELSE 'unknown' END AS strategy,
  NOT (filename LIKE '%statement%' OR extension = 'exe') AS use_converter, filename LIKE '%statement%' AS use_specialized,
  CASE WHEN filename LIKE '%statement%' THEN 'Bank statement detected - using specialized processor' WHEN extension = 'png' THEN 'Image file'
    WHEN extension = 'csv' THEN 'Spreadsheet - can use Docling or direct parsers'
    WHEN extension IN ('pdf', 'docx') THEN 'Document suitable for Docling conversion'
    WHEN extension IN ('txt', 'md') THEN 'Text document' ELSE 'Unknown type' END AS reason FROM named"""
EXPECTED["text_useful"] = f"""WITH {DOCS}, pages_ AS (
  SELECT filename, string_agg(text, chr(10) ORDER BY element_no) AS body FROM pieces GROUP BY filename)
SELECT filename AS file_name, length(body) >= 40 AND regexp_matches(body, '[0-9]') AS useful,
  CASE WHEN length(body) >= 40 AND regexp_matches(body, '[0-9]') THEN 'text' ELSE 'image' END AS pdf_type FROM pages_"""
EXPECTED["chunk_fixed"] = f"""WITH {DOCS} SELECT document_id, chunk_no, text, text[1:300] AS excerpt FROM fixed_chunks"""
EXPECTED["chunk_counts"] = f"""WITH {DOCS} SELECT document_id, count(*) AS chunk_count FROM fixed_chunks GROUP BY document_id"""
_last = lambda mark: (
    f"CASE WHEN contains(piece, {mark}) THEN length(piece) - strpos(reverse(piece), reverse({mark})) - length({mark}) + 1 ELSE -1 END"
)
EXPECTED["chunk_structured"] = f"""WITH RECURSIVE {DOCS}, long_pieces AS (SELECT * FROM pieces WHERE length(text) > 1000),
steps AS (
  SELECT document_id, element_no, text, 0 AS n, 0 AS ord_no FROM long_pieces
  UNION ALL
  SELECT document_id, element_no, text, n + 1, ord_no + width - 200 FROM (
    SELECT *, CASE WHEN ord_no + 1000 >= length(text) THEN 1000 WHEN sentence > 500 THEN sentence + 2 WHEN word > 500 THEN word + 1 ELSE 1000 END AS width
    FROM (SELECT *, {_last("'. '")} AS sentence, {_last("' '")} AS word
      FROM (SELECT *, substring(text, ord_no + 1, 1000) AS piece FROM steps))) WHERE ord_no + width - 200 < length(text)),
windows AS (
  SELECT document_id, element_no, n, regexp_replace(substring(text, ord_no + 1, width), '^\\s+|\\s+$', '', 'g') AS text FROM (
    SELECT *, CASE WHEN ord_no + 1000 >= length(text) THEN 1000 WHEN sentence > 500 THEN sentence + 2 WHEN word > 500 THEN word + 1 ELSE 1000 END AS width
    FROM (SELECT *, {_last("'. '")} AS sentence, {_last("' '")} AS word
      FROM (SELECT *, substring(text, ord_no + 1, 1000) AS piece FROM steps)))),
all_chunks AS (
  SELECT document_id, element_no, 0 AS n, text FROM pieces WHERE length(text) <= 1000
  UNION ALL SELECT document_id, element_no, n, text FROM windows),
indexed AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY element_no, n) - 1 AS BIGINT) AS chunk_index FROM all_chunks)
SELECT sha256(document_id || '|' || chunk_index) AS chunk_id, document_id, filename, element_no, chunk_index, indexed.text
FROM indexed JOIN docs USING (document_id)"""
EXPECTED["content_cache"] = f"""WITH {DOCS}, hashed AS (SELECT document_id, filename, sha256(text) AS content_hash FROM docs),
work AS (SELECT document_id, count(*) AS element_count, CAST(sum(length(text)) AS BIGINT) AS element_chars FROM pieces GROUP BY document_id)
SELECT content_hash, document_id, filename, element_count, element_chars FROM hashed LEFT JOIN work USING (document_id)"""

# --- retrieval --------------------------------------------------------------------------------
VECTORS = """chunks_ AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
asked AS (SELECT CAST(chunk_id AS BIGINT) AS query_id, v AS q FROM chunks_ WHERE chunk_id % 20 = 0),
distances AS (SELECT query_id, chunk_id, round(1 - list_cosine_similarity(v, q), 12) + 0.0 AS raw,
  round(1 - list_cosine_similarity(v, q), 6) + 0.0 AS distance FROM chunks_, asked),"""
EXPECTED["vec_topk"] = f"""WITH {VECTORS} ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw, chunk_id) AS rank FROM distances)
SELECT query_id, chunk_id, distance, rank FROM ranked WHERE rank <= 5"""
EXPECTED["vec_topk_filtered"] = f"""WITH {VECTORS} kept AS (
  SELECT * FROM distances WHERE chunk_id IN (SELECT doc_id FROM labels WHERE quality = 1)), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw, chunk_id) AS rank FROM kept)
SELECT query_id, chunk_id, distance, rank FROM ranked WHERE rank <= 10 AND CASE WHEN distance <= 2 THEN 1 - distance ELSE 0 END >= 0.1"""
EXPECTED["vec_topk_lsh"] = """SELECT 'row' AS kind, vec_id AS query_id, CAST(10 AS BIGINT) AS n_hits, true AS recalled FROM embeddings WHERE vec_id % 20 = 0
UNION ALL SELECT DISTINCT 'label', CAST(label AS BIGINT), CAST(10 AS BIGINT), true FROM embeddings"""
TOP4 = f"""{DOCS}, asked AS (
  SELECT document_id, document_id * 2 AS query_id, string_split(text, chr(10))[1] AS question FROM docs
  UNION ALL SELECT document_id, document_id * 2 + 1, string_split(text, chr(10))[-1] FROM docs), terms AS (
  SELECT document_id, query_id, list_distinct(list_transform(list_filter(regexp_split_to_array(trim(question), '\\s+'),
    lambda w: length(w) > 2), lambda w: lower(w))) AS words FROM asked),
scored AS (SELECT f.*, query_id, CAST(len(list_filter(words, lambda w: contains(lower(f.text), w))) AS BIGINT) AS score
  FROM fixed_chunks f JOIN terms USING (document_id)),
top4 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_no) AS rank FROM scored QUALIFY rank <= 4)"""
EXPECTED["keyword_top4"] = f"""WITH {TOP4} SELECT query_id, document_id, chunk_no, score, rank FROM top4"""
EXPECTED["context_build"] = f"""WITH {TOP4}, whole AS (
  SELECT query_id, count(*) AS n_sources, string_agg('[Source: ' || filename || ', Page ' || (chunk_no + 1) || ', Section: body]' || chr(10) || text,
    chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS body FROM top4 GROUP BY query_id)
SELECT query_id, CASE WHEN length(body) > 12000 THEN substring(body, 1, 12000) || chr(10) || chr(10) || '[... context truncated ...]'
  ELSE body END AS context, n_sources FROM whole"""
HISTORY = """turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations),
histories AS (SELECT conv_id AS conversation_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY nth) AS history
  FROM turns WHERE nth <= 10 GROUP BY conv_id)"""
EXPECTED["agent_context"] = f"""WITH {TOP4}, {HISTORY}, parts AS (
  SELECT conversation_id AS query_id, 0 AS kind, 0 AS rank, 'Conversation history:' || chr(10) || history AS t FROM histories
  UNION ALL SELECT query_id, 1, rank, '[Doc] ' || text FROM top4
  UNION ALL SELECT page_id, 2, 1, '[Web] ' || url || ': ' || html FROM pages)
SELECT query_id, substring(string_agg(t, chr(10) || chr(10) ORDER BY kind, rank), 1, 15000) AS context FROM parts GROUP BY query_id"""
EXPECTED["section_context"] = f"""WITH {CELLS} SELECT file_name AS document_id, substring(string_agg('[CSV, row ' || row_no || ']' || chr(10) ||
  regexp_replace(array_to_string(cells, ' | '), '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY row_no), 1, 12000) AS context
FROM cells_ GROUP BY file_name"""
CONTEXTS = f"""{TXNS}, contexts AS (
  SELECT file_name, account, substring('Bank: FIRST NATIONAL BANK' || chr(10) || 'Holder: None' || chr(10) || 'Account: ' || account || chr(10) ||
    'IFSC: None' || chr(10) || 'PDF type: text' || chr(10) || 'Transactions: ' || count(*) || chr(10) ||
    string_agg(date || ' | ' || description || ' | Dr ' || debit_amount || ' Cr ' || credit_amount || ' | ' || {rule_sql('category')},
      chr(10) ORDER BY seq) FILTER (WHERE seq <= 80), 1, 12000) AS context FROM txns GROUP BY file_name, account)"""
QUESTIONS = f"""questions AS (
  SELECT conv_id, turn, text || ' ' || {pick(QUESTION_TAILS, 'conv_id % 6')} AS question FROM conversations WHERE role = 'user')"""
EXPECTED["stmt_context"] = f"WITH {CONTEXTS} SELECT file_name, context FROM contexts"
EXPECTED["prompt_build"] = f"""WITH {CONTEXTS}, {QUESTIONS}, {DOCS}, bodies AS (
  SELECT document_id, substring(string_agg('[body]' || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_no), 1, 12000) AS body
  FROM fixed_chunks GROUP BY document_id) SELECT conv_id, turn, {quoted(PROMPT_BASE)} || CASE
  WHEN coalesce(context, '') <> '' THEN chr(10) || chr(10) || 'BANK STATEMENT CONTEXT:' || chr(10) || context
  WHEN coalesce(body, '') <> '' THEN chr(10) || chr(10) || 'DOCUMENT CONTEXT:' || chr(10) || body ELSE '' END ||
  chr(10) || chr(10) || 'USER QUESTION:' || chr(10) || question AS prompt
FROM questions LEFT JOIN contexts ON account = conv_id LEFT JOIN bodies ON document_id = conv_id"""


def any_of(words) -> str:
    return "(" + " OR ".join(f"contains(q, {quoted(w)})" for w in words) + ")"


EXPECTED["question_route"] = f"""WITH {QUESTIONS}, flags AS (
  SELECT conv_id, turn, lower(question) AS q, conv_id % 4 <> 3 AS has_docs, conv_id % 5 = 0 AS has_stmt FROM questions),
tests AS (
  SELECT *, {any_of(p.FOLLOW_UP_WORDS)} AS follow, {any_of(p.CALCULATION_WORDS)} AS calc, {any_of(p.ROW_QUERY_WORDS)} AS row_query,
    {any_of(p.CURRENT_WORDS)} AS web, {any_of(p.WEB_WORDS)} AS web_words FROM flags),
routed AS (
  SELECT *, calc AND (has_stmt OR row_query) AS structured, calc AND NOT (has_stmt OR row_query) AND has_docs AS data_query FROM tests),
reasons AS (
  SELECT *, has_docs AND NOT web AND NOT structured AND NOT web_words AS fallback,
    CASE WHEN follow THEN 'Follow-up question detected. ' ELSE '' END ||
    CASE WHEN structured THEN 'Calculation/aggregation needed. ' WHEN data_query THEN 'Data query on documents. ' ELSE '' END ||
    CASE WHEN web THEN 'Current/external information needed. ' ELSE '' END AS why FROM routed)
SELECT conv_id, turn, data_query OR fallback AS needs_document_rag, structured AS needs_structured_analysis, web AS needs_web_search,
  follow AS needs_conversation_context, CASE WHEN fallback AND why = '' THEN 'Document question - using RAG' ELSE why END AS reason FROM reasons"""
_clean = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
EXPECTED["content_text"] = f"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN {_clean} || chr(10) || {_clean} ELSE {_clean} END AS text
FROM conversations"""
_missing = quoted(p.ANALYSIS_MISSING)
EXPECTED["analysis_json"] = f"""SELECT doc_id, doc_id % 5 <> 4 AS parsed, CASE WHEN doc_id % 5 <> 4 THEN source END AS document_type,
  CASE WHEN doc_id % 5 <> 4 THEN {_missing} END AS executive_summary, CASE WHEN doc_id % 5 <> 4 THEN text END AS detailed_summary,
  CASE WHEN doc_id % 5 <> 4 THEN lang || ',' || source END AS key_findings, CASE WHEN doc_id % 5 <> 4 THEN lang END AS classification,
  CAST(CASE WHEN doc_id % 5 <> 4 THEN 0 END AS BIGINT) AS n_risks FROM documents"""

# --- stores ---------------------------------------------------------------------------------------
REG = """log AS (
  SELECT user_id AS document_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'purchase' THEN 'indexed'
    WHEN 'error' THEN 'error' ELSE 'processing' END AS status,
    CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END AS chunk_count,
    CASE WHEN event_type = 'error' THEN 'failed on ' || event_id END AS error_message FROM events),
last_rows AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) = 1),
sums AS (SELECT document_id, coalesce(arg_max(chunk_count, ts) FILTER (WHERE chunk_count IS NOT NULL), 0) AS chunk_count,
  max(ts) FILTER (WHERE status = 'indexed') AS indexed_at, min(ts) AS created_at, max(ts) AS updated_at FROM log GROUP BY document_id)"""
_stamp = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}"
EXPECTED["registry_latest"] = f"""WITH {REG} SELECT document_id, status, sums.chunk_count, error_message,
  {_stamp('indexed_at')}, {_stamp('created_at')}, {_stamp('updated_at')} FROM last_rows JOIN sums USING (document_id)"""
EXPECTED["conv_messages"] = f"""WITH {HISTORY} SELECT conversation_id, history FROM histories"""
EXPECTED["conv_list"] = """WITH firsts AS (
  SELECT conv_id, max(turn) AS updated_at, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS first FROM conversations GROUP BY conv_id),
titled AS (SELECT *, regexp_replace(first[1:50], '^\\s+|\\s+$', '', 'g') || CASE WHEN length(first) > 50 THEN '...' ELSE '' END AS title FROM firsts),
named AS (SELECT *, trim(CASE WHEN title = '' THEN 'New Chat' ELSE title END) AS shown FROM titled)
SELECT conv_id AS conversation_id, updated_at, title, CASE WHEN length(shown) > 28 THEN shown[1:25] || '...' ELSE shown END AS label
FROM named ORDER BY updated_at DESC, conv_id LIMIT 50"""
EXPECTED["reroute_docs"] = f"""WITH {DOCS} SELECT filename AS file_name, length(regexp_replace(text, '[0-9]', '', 'g')) AS n_chars FROM docs"""
EXPECTED["index_log"] = f"""WITH {DOCS}, parts AS ({EXPECTED["chunk_structured"]}),
counts AS (SELECT document_id, count(*) AS n, bool_or(contains(text, '|')) AS barred FROM parts GROUP BY document_id)
SELECT document_id, CASE WHEN n IS NULL OR barred THEN 'error' ELSE 'indexed' END AS status,
  CASE WHEN n IS NULL OR barred THEN 0 ELSE n END AS chunk_count,
  CASE WHEN n IS NULL THEN 'The uploaded document is empty.' WHEN barred THEN 'no vector' END AS error_message
FROM named LEFT JOIN counts USING (document_id) WHERE extension <> 'exe' AND size > 0 AND filename NOT LIKE '%statement%'"""
EXPECTED["csv_read"] = f"""WITH {CELLS}, nth AS (SELECT file_name || '_' || (row_no // 500) AS file_name, cells,
  row_number() OVER (PARTITION BY file_name, row_no // 500 ORDER BY row_no) AS k FROM cells_)
SELECT file_name, k + (k - 1) // 10 AS row_no, array_to_string(list_transform(cells, lambda c, i: CASE
  WHEN i <> 2 THEN c WHEN k % 4 = 1 THEN '5" ' || c WHEN k % 4 = 2 THEN '"x" ' || c WHEN k % 4 = 3 THEN c || chr(10) || 'second, line' ELSE c END), '|') AS cells
FROM nth"""
EXPECTED["csv_scan"] = f"""WITH {CELLS} SELECT file_name, row_no, array_to_string(list_transform(cells, lambda c, i: CASE
  WHEN i <> 2 THEN c WHEN row_no % 4 = 1 THEN '5" ' || c WHEN row_no % 4 = 2 THEN '"x" ' || c WHEN row_no % 4 = 3 THEN c || chr(10) || 'second, line' ELSE c END), '|') AS cells
FROM cells_"""
EXPECTED["text_read"] = r"""WITH cut AS (SELECT 'doc_' || doc_id || '.txt' AS file_name, unnest(lines) AS raw, unnest(range(len(lines))) AS line_no
  FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\f\x0b\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS lines FROM documents)),
trimmed AS (SELECT file_name, line_no, regexp_replace(raw, '^[\s\x{a0}\x{3000}\x1f]+|[\s\x{a0}\x{3000}\x1f]+$', '', 'g') AS text FROM cut)
SELECT file_name, line_no, text, '' AS error FROM trimmed WHERE text <> '' UNION ALL
SELECT file_name, -1, '', 'The uploaded bank statement is empty.' FROM trimmed GROUP BY file_name HAVING max(text) = ''"""
EXPECTED["payload_round_trip"] = f"""WITH {TXNS}, heads AS (
  SELECT file_name, count(*) AS transaction_count, CAST(sum(debit_amount) AS DOUBLE) AS total_debit FROM txns GROUP BY file_name)
SELECT file_name, CAST(row_number() OVER (PARTITION BY file_name ORDER BY seq) - 1 AS INTEGER) AS row_no, date, description,
  {dbl('debit_amount', 'credit_amount', 'balance')}, {rule_sql('category')} AS category, transaction_count, total_debit,
  'read "' || file_name || '"' AS warnings FROM txns JOIN heads USING (file_name)"""
EXPECTED["payload_parts_round_trip"] = f"""WITH {TXNS}
SELECT file_name, row_number() OVER (PARTITION BY file_name ORDER BY seq) - 1 AS row_no, date, description,
  {dbl('debit_amount', 'credit_amount', 'balance')}, {rule_sql('category')} AS category FROM txns"""
EXPECTED["upload_titles"] = f"""WITH {DOCS} SELECT document_id, ('Chat about ' || repeat('long ', 8) || filename)[1:50] AS title FROM docs"""
EXPECTED["analysis_sources"] = f"""WITH {DOCS}, cut AS (
  SELECT document_id, filename, n, regexp_replace(substring(text, n * 560 + 1, 600), '^\\s+|\\s+$', '', 'g') AS body
  FROM docs, LATERAL (SELECT unnest(range(CAST(ceil(length(text) / 560.0) AS BIGINT))) AS n)),
firsts AS (SELECT * FROM cut WHERE body <> '' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n) <= 8)
SELECT document_id, string_agg(filename || ', part ' || (n + 1), '; ' ORDER BY n) AS sources FROM firsts GROUP BY document_id"""
EXPECTED["embed_texts"] = """SELECT doc_id, CASE WHEN NOT contains(text, '|') THEN CAST(length(text) AS DOUBLE) END AS n_chars,
  CASE WHEN NOT contains(text, '|') THEN CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) END AS n_blanks,
  CASE WHEN contains(text, '|') THEN 'no vector' ELSE '' END AS error FROM documents"""
EXPECTED["generate_answers"] = """SELECT doc_id, CASE WHEN NOT contains(text, '|') AND length(text) % 7 <> 0 THEN CAST(length(text) AS VARCHAR) END AS answer,
  CASE WHEN contains(text, '|') THEN 'no answer' WHEN length(text) % 7 = 0 THEN 'The model returned an empty response' END AS answer_error FROM documents"""
EXPECTED["retry_picked"] = """WITH counts AS (
  SELECT 'scan_' || o_custkey AS file_name, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS native, count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS ocr
  FROM orders GROUP BY o_custkey), picked AS (SELECT file_name, native < 2 AND ocr > native AS again FROM counts)
SELECT file_name, CASE WHEN again THEN 'ocr' ELSE 'native' END AS source, CASE WHEN again THEN 'image' ELSE 'text' END AS document_type,
  CASE WHEN again THEN 'Image-based PDF detected; text was recovered with OCR.' ELSE '' END AS warning FROM picked"""
EXPECTED["sql_functions"] = f"""WITH {PRINTED}, said AS (
  SELECT o_orderkey, CASE WHEN fault = 'bad_date' THEN '00-00-00' ELSE {DATED} END AS shown, txn_date, words, amount, fault FROM printed)
SELECT o_orderkey, shown AS token, CASE WHEN fault = 'bad_date' THEN NULL ELSE CAST(txn_date AS VARCHAR) END AS day, 'strong' AS strength,
  CAST(-amount AS DOUBLE) AS amount, words AS description,
  array_to_string(regexp_extract_all(lower(shown || ' ' || words), '[a-z0-9]{{2,}}'), ' ') AS words FROM said"""
EXPECTED["structured_filter"] = f"""WITH {TXNS} SELECT file_name, seq, description, CAST(debit_amount AS DOUBLE) AS debit_amount
  FROM txns WHERE contains(description, 'STORE') AND debit_amount >= 1000"""
EXPECTED["session_docs"] = """SELECT doc_id AS document_id, doc_id AS created_at FROM documents WHERE source = 'src1'"""
EXPECTED["doc_lookup"] = f"""WITH {REG} SELECT document_id, status, sums.chunk_count, error_message
  FROM last_rows JOIN sums USING (document_id) WHERE document_id = 7"""
EXPECTED["latest_events"] = """SELECT user_id, event_type, event_id FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""
EXPECTED["stored_events"] = """SELECT user_id, event_type, event_id FROM (SELECT DISTINCT * FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE user_id % 7 <> 0"""
EXPECTED["stored_lengths"] = """SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, length(coalesce(text, '')) AS n_chars FROM documents"""
EXPECTED["delete_convs"] = """SELECT conv_id AS conversation_id, count(*) AS n, count(*) AS kept FROM conversations
  WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id"""
EXPECTED["panel_upload"] = """SELECT doc_id AS document_id, CASE WHEN strlen(text) * 4096 > 20 * 1024 * 1024
  THEN 'Upload is missing or exceeds the 20 MB limit.' ELSE 'ok' END AS error FROM documents"""
EXPECTED["description_quality"] = f"""SELECT doc_id, trim(line) <> '' AND length(line) <= 300 AND NOT regexp_matches(line, {quoted(p.SECONDARY_TEXT)}) AS ok
  FROM (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents)"""
EXPECTED["delete_docs"] = f"""WITH {DOCS}, {REG} SELECT document_id, chunk_no, length(text) AS n_chars FROM fixed_chunks
WHERE document_id NOT IN (SELECT document_id FROM last_rows WHERE status = 'error')"""
EXPECTED["forgotten_docs"] = f"""WITH {DOCS}, {REG} SELECT document_id, chunk_no, length(text) AS n_chars FROM fixed_chunks
WHERE document_id % 14 = 0 OR (document_id % 7 <> 0 AND (document_id % 2 = 1 OR document_id NOT IN (SELECT document_id FROM last_rows WHERE status = 'error')))"""
EXPECTED["structured_group"] = f"""WITH {TXNS} SELECT description, CAST(sum(debit_amount) AS DOUBLE) AS spent, count(debit_amount) AS n,
  CAST(max(debit_amount) AS DOUBLE) AS most FROM txns WHERE debit_amount > 0 GROUP BY description"""
EXPECTED["structured_compare"] = f"""WITH {TXNS} SELECT description,
  CAST(sum(debit_amount) FILTER (WHERE year(txn_date) = 1996) AS DOUBLE) AS spent_1996, count(debit_amount) FILTER (WHERE year(txn_date) = 1996) AS n_1996,
  CAST(sum(debit_amount) FILTER (WHERE year(txn_date) = 1997) AS DOUBLE) AS spent_1997, count(debit_amount) FILTER (WHERE year(txn_date) = 1997) AS n_1997
FROM txns WHERE year(txn_date) IN (1996, 1997) GROUP BY description"""
