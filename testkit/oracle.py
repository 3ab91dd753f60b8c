"""The expected result of every registered query as DuckDB SQL.

Written from the definitions, not from the library: other functions, other order of
evaluation, no shared expressions. Only the raw input SQL is the same.
"""

from __future__ import annotations

from testkit import raw_tables as raw

_WS = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return f"trim({x}, {_quote(_WS)})"


def _missing(x: str) -> str:
    return f"({x} IS NULL OR {_trim(x)} = '')"


def _fill(x: str) -> str:
    return f"CASE WHEN {_missing(x)} THEN 'unknown' ELSE {x} END"


_SECTOR_WORDS = [
    ("energy", ["energy", "energy sector"]),
    ("mining", ["mining", "mining sector"]),
    ("renewables", ["renewables", "renewable", "renewable energy"]),
    ("powerline", ["powerline", "power line"]),
    ("railways", ["railways", "railway", "rail"]),
    ("others", ["others", "other"]),
    ("security_and_surveillance", ["security and surveillance"]),
]


def _sector(x: str) -> str:
    word = _trim(f"regexp_replace(lower({_trim(x)}), '[^\\p{{L}}\\p{{N}}_\\s&/]', '', 'g')")
    arms = " ".join(
        f"WHEN {word} IN ({', '.join(map(_quote, words))}) THEN '{name}'"
        for name, words in _SECTOR_WORDS
    )
    return f"CASE WHEN {_missing(x)} THEN 'unknown' {arms} ELSE {word} END"


def _status(x: str) -> str:
    t = _trim(x)
    return (
        f"CASE WHEN {_missing(x)} THEN 'unknown' WHEN lower({t}) IN ('open','active') THEN 'Open' "
        f"WHEN lower({t}) IN ('dead','inactive') THEN 'Dead' "
        f"WHEN lower({t}) IN ('won','closed') THEN 'Won' "
        f"WHEN lower({t}) = 'on hold' THEN 'On Hold' WHEN lower({t}) = 'lost' THEN 'Lost' "
        f"ELSE {t} END"
    )


def _probability(x: str) -> str:
    # words are runs of letters; each gets a capital
    runs = f"regexp_extract_all(lower({_trim(x)}), '\\p{{L}}+|[^\\p{{L}}]+')"
    title = (
        f"array_to_string(list_transform({runs}, "
        "lambda w: concat(upper(substr(w, 1, 1)), substr(w, 2))), '')"
    )
    return f"CASE WHEN {_missing(x)} THEN 'unknown' ELSE {title} END"


def _execution(x: str) -> str:
    t = _trim(x)
    return (
        f"CASE WHEN {_missing(x)} THEN 'unknown' "
        f"WHEN lower({t}) LIKE 'executed until%' THEN 'Executed until current' "
        f"WHEN lower({t}) IN ('completed','done') THEN 'Completed' "
        f"WHEN lower({t}) IN ('ongoing','in progress') THEN 'Ongoing' "
        f"WHEN lower({t}) IN ('not started','pending') THEN 'Not Started' ELSE {t} END"
    )


def _amount(x: str) -> str:
    plain = f"regexp_replace({x}, '[₹$,\\s]', '', 'g')"
    number = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"
    return (
        f"coalesce(CASE WHEN regexp_matches({plain}, '{number}') "
        f"THEN TRY_CAST({plain} AS DOUBLE) END, 0.0)"
    )


def _clamped(x: str) -> str:
    return f"greatest({_amount(x)}, 0.0)"


_DATE_FORMATS = [
    "%Y-%m-%d", "%d-%m-%Y", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%B %d, %Y", "%b %d, %Y",
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y%m%d", "%d %b %Y", "%d-%b-%y",
    "%m.%d.%Y", "%B %d %Y", "%d %B, %Y", "%b %Y", "%Y%m%dT%H%M%S", "%m/%d/%Y %H:%M",
    "%d-%b-%Y %H:%M:%S", "%A, %B %d, %Y", "%b. %d, %Y", "%Y%m%d %H%M", "%m/%d/%Y %I:%M %p",
    "%d %B %Y %I:%M %p",
]


def _date(x: str) -> str:
    # DuckDB takes two digits for %Y, so short years are told apart first
    t = _trim(x)
    tries = ", ".join(f"try_strptime({t}, '{f}')" for f in _DATE_FORMATS)
    short = f"regexp_full_match({t}, '[0-9]{{1,2}}[-/][0-9]{{1,2}}[-/][0-9]{{2}}')"
    return (
        f"CAST(CASE WHEN {short} THEN try_strptime(replace({t}, '-', '/'), '%m/%d/%y') "
        f"ELSE coalesce({tries}) END AS TIMESTAMP)"
    )


def _total(x: str, where: str = "true") -> str:
    """Decimal below 1e15, where decimals count; null if nothing was added."""
    fine = f"CAST(sum(CAST({x} AS DECIMAL(20,4))) FILTER (WHERE abs({x}) < 1e15 AND {where}) AS DOUBLE)"
    large = f"sum({x}) FILTER (WHERE abs({x}) >= 1e15 AND {where})"
    return f"coalesce({fine} + {large}, {fine}, {large})"


def _sum(x: str) -> str:
    return f"coalesce({_total(x)}, 0.0)"


def _sum_positive(x: str) -> str:
    return f"coalesce({_total(x, f'{x} > 0')}, 0.0)"


def _avg(x: str) -> str:
    return f"{_total(x)} / count({x})"


def _fixed(x: str, digits: int) -> str:
    return f"format('{{:.{digits}f}}', CAST({x} AS DOUBLE))"


def _percent(part: str, whole: str) -> str:
    return (
        f"CASE WHEN {whole} > 0 THEN CAST({_fixed(f'({part}) / ({whole}) * 100', 1)} AS DOUBLE) "
        "ELSE 0.0 END"
    )


def _currency(x: str) -> str:
    return (
        f"concat('₹', CASE WHEN abs({x}) >= 10000000 THEN concat({_fixed(f'{x} / 10000000', 2)}, ' Cr') "
        f"WHEN abs({x}) >= 100000 THEN concat({_fixed(f'{x} / 100000', 2)}, ' L') "
        f"WHEN abs({x}) >= 1000 THEN concat({_fixed(f'{x} / 1000', 1)}, 'K') "
        f"ELSE {_fixed(x, 2)} END)"
    )


# --- cleaned tables -----------------------------------------------------------------

_DEALS = list(raw.DEAL_HEADERS)
_ORDERS = list(raw.WORK_ORDER_HEADERS)
_MONEY = [
    "amount_total", "billed_value", "collected_amount", "amount_to_be_billed",
    "amount_receivable",
]


def _nonempty(columns: list[str]) -> str:
    nulls = " AND ".join(f"{c} IS NULL" for c in columns)
    blanks = " AND ".join(f"({_trim(c)} = '')" for c in columns)
    return f"NOT ({nulls}) AND coalesce(NOT ({blanks}), true)"


def _cols(columns: list[str], rules: dict[str, str]) -> str:
    return ", ".join(f"{rules[c]} AS {c}" if c in rules else c for c in columns)


_RAW_DEALS = f"raw AS ({raw.for_duckdb('raw_deals')})"
_FIRST_DEALS = f"""{_RAW_DEALS},
nonempty AS (SELECT * FROM raw WHERE {_nonempty(_DEALS)}),
firsts AS (SELECT * FROM nonempty QUALIFY row_number() OVER (
  PARTITION BY deal_name, client_code, deal_value ORDER BY ordinal) = 1)"""
_DEAL_RULES = {
    "deal_value": _clamped("deal_value"),
    "sector": _sector("sector"),
    "deal_status": _status("deal_status"),
    "closure_probability": _probability("closure_probability"),
    **{c: _date(c) for c in ("close_date", "tentative_close_date", "created_date")},
    **{c: _fill(c) for c in ("deal_stage", "product_deal", "owner_code", "client_code")},
}
_KEPT_DEALS = f"""{_FIRST_DEALS},
stripped AS (SELECT {_cols(_DEALS, {c: _trim(c) for c in _DEALS})} FROM firsts
  WHERE deal_status IS NULL OR deal_status NOT IN ('Deal Status', 'deal_status')),
named AS (SELECT * FROM stripped WHERE deal_name IS NULL OR deal_name <> '')"""
_CLEAN_DEALS = f"""{_KEPT_DEALS},
deals AS MATERIALIZED (SELECT {_cols(_DEALS, _DEAL_RULES)} FROM named)"""

# The files hold copy 0 and 2 to 4 in order of position, then copy 1 in two more folders.
_FILE_ORDER = "CASE WHEN ordinal % 8 = 1 THEN 10 + (ordinal // 8) % 2 ELSE 0 END, ordinal"
_POSITIONS = f"SELECT ordinal, row_number() OVER (ORDER BY {_FILE_ORDER}) - 1 AS position FROM raw"
# Items always have an id, so none is an empty row.
_BOARD_DEALS = f"""{_RAW_DEALS},
firsts AS (SELECT * FROM raw QUALIFY row_number() OVER (
  PARTITION BY deal_name, client_code, deal_value ORDER BY {_FILE_ORDER}) = 1),
kept AS (SELECT * FROM firsts WHERE (deal_status IS NULL OR deal_status <> 'Deal Status')
  AND (deal_name IS NULL OR {_trim('deal_name')} <> '')),
named AS (SELECT ordinal, {_cols(_DEALS, {c: _trim(c) for c in _DEALS})} FROM kept),
deals AS (SELECT CAST(ordinal AS VARCHAR) AS item_id, coalesce(deal_name, '') AS item_name,
  client_code AS link, ordinal, {_cols(_DEALS, _DEAL_RULES)} FROM named)"""

_RAW_ORDERS = f"raw_wo AS ({raw.for_duckdb('raw_work_orders')})"
_FIRST_ORDERS = f"""{_RAW_ORDERS},
nonempty_wo AS (SELECT * FROM raw_wo WHERE {_nonempty(_ORDERS)}),
firsts_wo AS (SELECT * FROM nonempty_wo QUALIFY row_number() OVER (
  PARTITION BY deal_name, serial, amount_total
  ORDER BY ord_part, ord_supp, ord_date, ord_copy) = 1)"""
_ORDER_RULES = {
    "sector": _sector("sector"),
    "execution_status": _execution("execution_status"),
    **{c: _clamped(c) for c in _MONEY},
    **{
        c: _date(c)
        for c in (
            "probable_start_date", "probable_end_date", "date_po_loi", "last_invoice_date",
        )
    },
    **{
        c: _fill(c)
        for c in (
            "nature_of_work", "type_of_work", "invoice_status", "wo_status",
            "collection_status", "billing_status",
        )
    },
}
_CLEAN_ORDERS = f"""{_FIRST_ORDERS},
stripped_wo AS (SELECT {_cols(_ORDERS, {c: _trim(c) for c in _ORDERS})} FROM firsts_wo),
work_orders AS MATERIALIZED (SELECT {_cols(_ORDERS, _ORDER_RULES)} FROM stripped_wo)"""


def _on_deals(select: str) -> str:
    return f"WITH {_CLEAN_DEALS} {select}"


def _on_orders(select: str) -> str:
    return f"WITH {_CLEAN_ORDERS} {select}"


def _on_both(select: str) -> str:
    return f"WITH {_CLEAN_DEALS}, {_CLEAN_ORDERS} {select}"


def _on_cells(column: str, expr: str) -> str:
    return (
        f"WITH cells AS ({raw.for_duckdb('cells')}) "
        f"SELECT id, {column}, {expr} AS result FROM cells"
    )


def _null_tokens(x: str) -> str:
    tokens = (
        "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', "
        "'1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"
    )
    return f"CASE WHEN {x} NOT IN ({tokens}) THEN {x} END"


# --- quality ------------------------------------------------------------------------

_DQ_DEALS = f"""
counts AS (
  SELECT 'empty_rows' AS rule, (SELECT count(*) FROM raw) - (SELECT count(*) FROM nonempty) AS n
  UNION ALL SELECT 'duplicates', (SELECT count(*) FROM nonempty) - (SELECT count(*) FROM firsts)
  UNION ALL SELECT 'missing_sector', count(*) FROM named WHERE sector IS NULL OR sector = ''
  UNION ALL SELECT 'invalid_close_date', count(*) FROM named WHERE {_date('close_date')} IS NULL
  UNION ALL SELECT 'invalid_tentative_close_date', count(*) FROM named
    WHERE {_date('tentative_close_date')} IS NULL
  UNION ALL SELECT 'invalid_created_date', count(*) FROM named WHERE {_date('created_date')} IS NULL
  UNION ALL SELECT 'negative_deal_value', count(*) FROM named WHERE {_amount('deal_value')} < 0
),
dq_deals AS (
  SELECT 'deals' AS "table", rule, n AS affected, CASE rule
    WHEN 'empty_rows' THEN concat('Dropped ', n, ' fully empty rows')
    WHEN 'duplicates' THEN concat(n, ' duplicate rows removed.')
    WHEN 'missing_sector' THEN concat('Some deals are missing sector information. ', n,
      ' records affected. Results may be incomplete.')
    WHEN 'negative_deal_value' THEN concat(n, ' deals had negative values, reset to 0.')
    ELSE concat(replace(rule, 'invalid_', ''), ': ', n, ' unparseable dates set to null') END
    AS message
  FROM counts WHERE n > 0)"""

_MISMATCH = (
    "amount_receivable > 0 AND billed_value - collected_amount > 0 "
    "AND abs(amount_receivable - (billed_value - collected_amount)) > 1"
)
_NEGATIVE_ORDERS = " ".join(
    f"UNION ALL SELECT 'negative_{c}', count(*) FROM firsts_wo WHERE {_amount(c)} < 0"
    for c in _MONEY
)
_DQ_ORDERS = f"""
counts_wo AS (
  SELECT 'empty_rows' AS rule,
    (SELECT count(*) FROM raw_wo) - (SELECT count(*) FROM nonempty_wo) AS n
  UNION ALL SELECT 'duplicates',
    (SELECT count(*) FROM nonempty_wo) - (SELECT count(*) FROM firsts_wo)
  {_NEGATIVE_ORDERS}
  UNION ALL SELECT 'receivable_mismatch', count(*) FROM work_orders WHERE {_MISMATCH}
  UNION ALL SELECT 'missing_receivable', count(*) FROM work_orders WHERE amount_receivable = 0
),
dq_orders AS (
  SELECT 'work_orders' AS "table", rule, n AS affected, CASE rule
    WHEN 'empty_rows' THEN concat('Dropped ', n, ' fully empty rows')
    WHEN 'duplicates' THEN concat(n, ' duplicate rows removed.')
    WHEN 'receivable_mismatch' THEN concat(n, ' work orders have receivable != billed - collected',
      ' (likely due to GST differences)')
    WHEN 'missing_receivable' THEN concat('Receivable values missing for ', n,
      ' work orders. Results may be incomplete.')
    ELSE concat(n, ' work orders had negative ''', replace(rule, 'negative_', ''),
      ''', reset to 0.') END AS message
  FROM counts_wo WHERE n > 0)"""

_BOUND = (
    "SELECT CASE WHEN count(*) > 10 THEN avg(deal_value) + 3 * stddev_samp(deal_value) END "
    "FROM {t} WHERE deal_value > 0"
)
_DQ_OUTLIERS = f"""
bound AS (SELECT ({_BOUND.format(t='deals')}) AS upper),
dq_outliers AS (
  SELECT 'deals' AS "table", 'high_outliers' AS rule, count(*) AS affected,
    concat(count(*), ' deal(s) with unusually high values detected (>',
      format('{{:,}}', CAST(any_value(upper) AS BIGINT)),
      '). These are kept but may skew averages.') AS message
  FROM deals, bound WHERE deal_value > upper HAVING count(*) > 0)"""

# --- KPIs ---------------------------------------------------------------------------

_OPEN = "deal_value > 0 AND deal_status = 'Open'"
_BY_SECTOR = f"""SELECT sector, count(*) AS deal_count, {_sum('deal_value')} AS total_value,
  {_avg('deal_value')} AS avg_value FROM deals WHERE {_OPEN} GROUP BY sector"""
_ACTIVE = """greatest(
  count(*) FILTER (WHERE wo_status IN ('Open', 'open', 'unknown')),
  count(*) FILTER (WHERE execution_status IN ('Ongoing', 'Not Started',
    'Executed until current month', 'Partial Completed', 'Pause / struck',
    'Details pending from Client')))"""
_BILLED, _COLLECTED = _sum_positive("billed_value"), _sum_positive("collected_amount")
_RECEIVABLE = _sum_positive("amount_receivable")
_VALUED = "amount_total > 0"


def _sum_valued(x: str) -> str:
    return f"coalesce({_total(x, _VALUED)}, 0.0)"


_COMPLETION = _percent(_sum_valued("billed_value"), _sum_valued("amount_total"))
_TOTAL_PIPELINE = f"(SELECT {_sum('deal_value')} FROM deals WHERE {_OPEN})"
_AVERAGE = f"(SELECT coalesce({_avg('deal_value')}, 0.0) FROM deals WHERE deal_value > 0)"
_OPEN_COUNT = "(SELECT CAST(count(*) AS DOUBLE) FROM deals WHERE deal_status = 'Open')"


def _wo(expr: str) -> str:
    return f"(SELECT CAST({expr} AS DOUBLE) FROM work_orders)"


def _display(rows: str) -> str:
    """Rows (metric, value, unit, text) to (metric, value, unit, display)."""
    return f"""SELECT metric, CAST(value AS DOUBLE) AS value, unit, CASE unit
      WHEN 'text' THEN text WHEN 'money' THEN {_currency('value')}
      WHEN 'percent' THEN concat({_fixed('value', 1)}, '%')
      ELSE CAST(CAST(value AS BIGINT) AS VARCHAR) END AS display FROM ({rows}) kpi_rows"""


_KPI_ROWS = f"""
  SELECT 'total_pipeline' AS metric, {_TOTAL_PIPELINE} AS value, 'money' AS unit,
    CAST(NULL AS VARCHAR) AS text
  UNION ALL SELECT 'active_deals', {_OPEN_COUNT}, 'count', NULL
  UNION ALL SELECT 'avg_deal_size', {_AVERAGE}, 'money', NULL
  UNION ALL (SELECT 'top_sector', NULL, 'text', sector FROM ({_BY_SECTOR})
    ORDER BY total_value DESC, sector LIMIT 1)
  UNION ALL SELECT 'top_sector_value', max(total_value), 'money', NULL FROM ({_BY_SECTOR})
  UNION ALL SELECT 'deals_in_negotiation', count(*), 'count', NULL FROM deals
    WHERE deal_stage = 'F. Negotiations' AND deal_status = 'Open'
  UNION ALL SELECT 'active_work_orders', {_wo(_ACTIVE)}, 'count', NULL
  UNION ALL SELECT 'billing_completion', {_wo(_COMPLETION)}, 'percent', NULL
  UNION ALL SELECT 'total_receivable', {_wo(_RECEIVABLE)}, 'money', NULL
  UNION ALL SELECT 'total_billed', {_wo(_BILLED)}, 'money', NULL
  UNION ALL SELECT 'total_collected', {_wo(_COLLECTED)}, 'money', NULL
  UNION ALL SELECT 'collection_rate', {_wo(_percent(_COLLECTED, _BILLED))}, 'percent', NULL"""

_EXECUTION = """SELECT execution_status, count(*) AS count FROM work_orders
  WHERE execution_status <> 'unknown' GROUP BY execution_status"""

_REPORT = f"""
SELECT * FROM (VALUES (0, 0, '## Weekly Sales & Delivery Update'), (1, 0, '### Pipeline Overview'),
  (2, 0, '### Operational Highlights'), (3, 0, '### Financial Highlights'),
  (4, 0, '### Risks & Attention Items')) h(section, pos, line)
UNION ALL
SELECT s.section, s.pos, concat('- ', s.caption, ': ', k.display) FROM (VALUES
  ('total_pipeline', 1, 1, 'Total pipeline value'), ('top_sector', 1, 2, 'Top sector'),
  ('active_deals', 1, 3, 'Active deals'), ('avg_deal_size', 1, 4, 'Average deal size'),
  ('active_work_orders', 2, 1, 'Active work orders'),
  ('billing_completion', 2, 2, 'Billing completion rate'),
  ('total_billed', 3, 1, 'Total billed'), ('total_collected', 3, 2, 'Total collected'),
  ('total_receivable', 3, 3, 'Outstanding receivables'),
  ('collection_rate', 3, 4, 'Collection rate'),
  ('deals_in_negotiation', 4, 1, 'Deals in negotiation')) s(metric, section, pos, caption)
  JOIN ({_display(_KPI_ROWS)}) k ON s.metric = k.metric
UNION ALL
SELECT 1, CAST(100 + row_number() OVER (ORDER BY total_value DESC, sector) AS INT),
  concat('  - ', sector, ': ', {_currency('total_value')})
  FROM ({_BY_SECTOR}) b
UNION ALL
SELECT 2, CAST(100 + row_number() OVER (ORDER BY count DESC, execution_status) AS INT),
  concat('  - ', execution_status, ': ', count)
  FROM ({_EXECUTION}) e"""


def _run_metric() -> str:
    def rows(request: str, kpis: list[tuple[str, str, str]]) -> str:
        body = " UNION ALL ".join(
            f"SELECT '{m}' AS metric, {v} AS value, '{u}' AS unit, CAST(NULL AS VARCHAR) AS text"
            for m, v, u in kpis
        )
        return f"SELECT '{request}' AS request, d.* FROM ({_display(body)}) d"

    pipeline = [("total_pipeline", _TOTAL_PIPELINE, "money")]
    parts = [
        rows("pipeline_value", pipeline),
        rows("pipeline_by_sector", pipeline),
        rows("average_deal_size", [("average_deal_size", _AVERAGE, "money")]),
        rows("active_deals", [("active_deals", _OPEN_COUNT, "count")]),
        rows(
            "billing_completion_rate",
            [
                ("total_amount", _wo(_sum_valued("amount_total")), "money"),
                ("billed_amount", _wo(_sum_valued("billed_value")), "money"),
                ("unbilled_amount", _wo(_sum_valued("amount_to_be_billed")), "money"),
                ("completion_rate", _wo(_COMPLETION), "percent"),
            ],
        ),
        rows("total_billed", [("total_billed", _wo(_BILLED), "money")]),
        rows("total_collected", [("total_collected", _wo(_COLLECTED), "money")]),
        rows("receivables", [("total_receivable", _wo(_RECEIVABLE), "money")]),
        rows(
            "financial_summary",
            [
                ("total_billed", _wo(_BILLED), "money"),
                ("total_collected", _wo(_COLLECTED), "money"),
                ("total_receivable", _wo(_RECEIVABLE), "money"),
                ("collection_rate", _wo(_percent(_COLLECTED, _BILLED)), "percent"),
                ("outstanding_ratio", _wo(_percent(_RECEIVABLE, _BILLED)), "percent"),
            ],
        ),
        f"SELECT 'leadership_update' AS request, d.* FROM ({_display(_KPI_ROWS)}) d",
    ]
    return " UNION ALL ".join(parts)


def _frame(request: str, select: str, order: str, columns: list[str], last: int | None = None) -> str:
    """A metric's data as (request, row, column, value, text) from its own SELECT."""
    ranked = f"SELECT *, row_number() OVER (ORDER BY {order}) AS row FROM ({select}) f"
    if last:
        ranked = f"SELECT *, row_number() OVER (ORDER BY {order}) AS row FROM (SELECT * FROM ({select}) f ORDER BY {order} DESC LIMIT {last}) g"
    parts = []
    for i, c in enumerate(columns):
        value, text = ("CAST(NULL AS DOUBLE)", c) if i == 0 else (f"CAST({c} AS DOUBLE)", "CAST(NULL AS VARCHAR)")
        parts.append(f"SELECT '{request}' AS request, CAST(row AS INT) AS row, '{c}' AS \"column\", {value} AS value, {text} AS text FROM ({ranked}) r")
    return " UNION ALL ".join(parts)


def _metric_data() -> str:
    by_stage = (
        f"SELECT deal_stage, count(*) AS deal_count, {_sum('deal_value')} AS total_value "
        f"FROM deals WHERE {_OPEN} GROUP BY deal_stage"
    )
    trend = (
        "SELECT strftime(created_date, '%Y-%m') AS month, count(*) AS deal_count FROM deals "
        "WHERE created_date IS NOT NULL GROUP BY 1"
    )
    value = ["sector", "deal_count", "total_value", "avg_value"]
    largest = "total_value DESC, sector"
    billing = (
        f"SELECT sector, {_sum('billed_value')} AS billed, {_sum('collected_amount')} AS collected, "
        f"{_sum('amount_receivable')} AS receivable, {_sum('amount_to_be_billed')} AS to_be_billed "
        "FROM work_orders WHERE sector <> 'unknown' GROUP BY sector"
    )
    receivable = (
        f"SELECT sector, {_sum('amount_receivable')} AS receivable_amount, count(*) AS wo_count "
        "FROM work_orders WHERE amount_receivable > 0 GROUP BY sector"
    )
    kinds = (
        f"SELECT nature_of_work, count(*) AS count, {_sum('amount_total')} AS total_value "
        "FROM work_orders WHERE nature_of_work <> 'unknown' GROUP BY nature_of_work"
    )
    statuses = (
        "SELECT billing_status, count(*) AS count FROM work_orders "
        "WHERE billing_status NOT IN ('unknown', '') GROUP BY billing_status"
    )
    orders = f"SELECT sector, count(*) AS order_count, {_sum('amount_total')} AS total_value FROM work_orders GROUP BY sector"
    return " UNION ALL ".join([
        _frame("pipeline_value", _BY_SECTOR, largest, value),
        _frame("pipeline_by_sector", _BY_SECTOR, largest, value),
        _frame("pipeline_by_stage", by_stage, "total_value DESC, deal_stage", ["deal_stage", "deal_count", "total_value"]),
        _frame("deal_trends", trend, "month", ["month", "deal_count"], 6),
        _frame("work_orders_by_sector", orders, "order_count DESC, sector", ["sector", "order_count", "total_value"]),
        _frame("execution_status", _EXECUTION, "count DESC, execution_status", ["execution_status", "count"]),
        _frame("receivables", receivable, "receivable_amount DESC, sector", ["sector", "receivable_amount", "wo_count"]),
        _frame("billing_vs_collection", billing, "billed DESC, sector", ["sector", "billed", "collected", "receivable", "to_be_billed"]),
        _frame("work_orders_by_type", kinds, "count DESC, nature_of_work", ["nature_of_work", "count", "total_value"]),
        _frame("work_orders_by_status", statuses, "count DESC, billing_status", ["billing_status", "count"]),
    ])


_SUMMARY = (
    "SELECT 1 AS section, 'Deals dataset' AS item, CAST(NULL AS VARCHAR) AS value, "
    "count(*) AS count FROM deals UNION ALL "
    "(SELECT 2, 'Top sectors', sector, count(*) AS n FROM deals GROUP BY sector "
    "ORDER BY n DESC, sector LIMIT 5) UNION ALL "
    "SELECT 3, 'Status distribution', deal_status, count(*) FROM deals "
    "GROUP BY deal_status UNION ALL "
    "SELECT 4, 'Work orders dataset', NULL, count(*) FROM work_orders"
)


def _summary_lines() -> str:
    """(request, section, pos, line) of frames counted by remainder."""
    parts = []
    for rows in (19, 20, 21, 977):
        parts.append(f"""
SELECT 'by {rows}' AS request, 1 AS section, 0 AS pos, 'Key Metrics:' AS line
UNION ALL SELECT 'by {rows}', 1, 1, concat('  - orders: ', count(*)) FROM orders
UNION ALL SELECT 'by {rows}', 1, 2, '  - share: {rows}.5%'
UNION ALL SELECT 'by {rows}', 2, 0, 'Data Breakdown:'
UNION ALL SELECT 'by {rows}', 2, 1, 'rest | orders'
UNION ALL SELECT 'by {rows}', 2, CAST(CASE WHEN n <= 20 OR place <= 10 THEN place + 1 ELSE place - n + 22 END AS INT),
  concat(rest, ' | ', orders)
  FROM (SELECT *, row_number() OVER (ORDER BY orders DESC, rest) AS place, count(*) OVER () AS n
    FROM (SELECT o_orderkey % {rows} AS rest, count(*) AS orders FROM orders GROUP BY 1) c) r
  WHERE n <= 20 OR place <= 10 OR place > n - 10
UNION ALL SELECT 'by {rows}', 2, 12, '...' FROM (SELECT count(DISTINCT o_orderkey % {rows}) AS n FROM orders) d
  WHERE n > 20""")
    parts.append("SELECT 'by 20', 3, 0, 'Data Quality Notes:' UNION ALL SELECT 'by 20', 3, 1, '  ! Made of remainders.'")
    parts.append("SELECT 'none', 0, 0, 'No data available.'")
    return " UNION ALL ".join(parts)


def _closing_soon() -> str:
    cells = "deal_name, sector, deal_value, deal_stage, closure_probability, tentative_close_date"
    quarter = "year(tentative_close_date) = 2001 AND quarter(tentative_close_date) = 2"
    variants = {
        "month": "year(tentative_close_date) = 2001 AND month(tentative_close_date) = 5",
        "quarter": quarter,
        "quarter, sector": f"{quarter} AND sector = 'renewables'",
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS variant, {cells} FROM deals WHERE deal_status = 'Open' AND {where}"
        for name, where in variants.items()
    )


# --- questions ----------------------------------------------------------------------

_SUGGESTIONS = "|".join(
    [
        "How is our pipeline looking for the mining sector this quarter?",
        "What deals are likely to close this month?",
        "Which sectors generate the most revenue?",
        "How much receivable revenue do we have?",
        "What is the billing completion rate?",
        "Show me pipeline by deal stage",
        "Give me a leadership update",
    ]
)
_GIBBERISH = f"""
WITH questions AS ({raw.for_duckdb('questions')}),
stripped AS (SELECT *, {_trim('text')} AS t FROM questions),
flagged AS (SELECT conv_id, turn, text,
  length(t) < 3 OR NOT regexp_matches(t, '[a-zA-Z]')
  OR (length(t) >= 5 AND replace(t, left(t, 1), '') = '')
  OR regexp_full_match(t, '[a-z]{{1,2}}')
  OR (length(t) >= 6 AND NOT regexp_matches(t, '[aeiouAEIOU\\s]')) AS nonsensical FROM stripped)
SELECT *, CASE WHEN nonsensical THEN {_quote(_SUGGESTIONS)} END AS suggestions FROM flagged"""

_INTENT = f"""
WITH replies AS ({raw.for_duckdb('replies')}),
parts AS (SELECT *, {_trim('text')} AS t FROM replies),
blocks AS (SELECT *, {_trim("regexp_replace(string_split(t, '```')[2], '^json', '')")} AS block,
  list_filter(regexp_extract_all(t, '\\{{[^{{}}]*(?:\\{{[^{{}}]*\\}}[^{{}}]*)*\\}}'),
    lambda m: json_valid(m))[1] AS inner_json FROM parts),
found AS (SELECT *, CASE WHEN json_valid(t) THEN t WHEN json_valid(block) THEN block
    ELSE inner_json END AS j,
  CASE WHEN json_valid(t) THEN 'whole' WHEN json_valid(block) THEN 'fenced'
    WHEN inner_json IS NOT NULL THEN 'embedded' END AS s FROM blocks),
typed AS (SELECT *, coalesce(json_type(j) = 'OBJECT', false) AS ok FROM found)
SELECT conv_id, turn, text,
  CASE WHEN ok THEN coalesce(json_extract_string(j, '$.metric'), 'general_query')
    ELSE 'general_query' END AS metric,
  CASE WHEN ok THEN json_extract_string(j, '$.sector') END AS sector,
  CASE WHEN ok THEN json_extract_string(j, '$.period') END AS period,
  CASE WHEN ok THEN json_extract_string(j, '$.status_filter') END AS status_filter,
  CASE WHEN ok THEN json_extract_string(j, '$.description') ELSE t END AS description,
  CASE WHEN ok THEN s ELSE 'default' END AS source
FROM typed"""

_NONSENSE = "(f.nonsensical OR i.metric = 'nonsensical')"
_INTERPRET = f"""
WITH asked AS (SELECT conv_id, turn, text AS question, {_trim('text')} AS q FROM ({raw.for_duckdb('questions')}) a),
replied AS (SELECT conv_id, turn, text AS reply FROM ({raw.for_duckdb('replies')}) b),
intents AS ({_INTENT}),
flags AS ({_GIBBERISH})
SELECT a.conv_id, a.turn, a.question, r.reply, {_NONSENSE} AS nonsensical,
  CASE WHEN {_NONSENSE} THEN 'nonsensical' ELSE i.metric END AS metric,
  CASE WHEN NOT {_NONSENSE} THEN i.sector END AS sector,
  CASE WHEN NOT {_NONSENSE} THEN i.period END AS period,
  CASE WHEN NOT {_NONSENSE} THEN i.status_filter END AS status_filter,
  CASE WHEN {_NONSENSE} THEN a.q ELSE i.description END AS description,
  CASE WHEN f.nonsensical THEN 'question' ELSE i.source END AS source,
  CASE WHEN {_NONSENSE} THEN {_quote(_SUGGESTIONS)} END AS suggestions
FROM asked a JOIN replied r USING (conv_id, turn) JOIN intents i USING (conv_id, turn)
  JOIN flags f USING (conv_id, turn)"""

_VALUE_SCALE = "list_value(1.0::DOUBLE, -1.0, 100.0, 0.001, -0.01)[o_orderkey % 5 + 1]"


def oracle_sql() -> dict[str, str]:
    deals_list, orders_list = ", ".join(_DEALS), ", ".join(_ORDERS)
    board_cells = ", ".join(
        f'{c} AS "{raw.DEAL_HEADERS[c]}"'
        for c in raw.DEAL_HEADERS
    )
    return {
        "pipeline_by_sector": _on_deals(f"{_BY_SECTOR} ORDER BY total_value DESC, sector"),
        # sources
        "read_deals_csv": f"WITH {_RAW_DEALS} SELECT "
        + _cols(_DEALS, {c: _null_tokens(c) for c in _DEALS})
        + " FROM raw",
        "read_work_orders_csv": f"WITH {_RAW_ORDERS} SELECT "
        + _cols(_ORDERS, {c: _null_tokens(c) for c in _ORDERS})
        + " FROM raw_wo",
        "null_tokens": _on_cells("null_cell", _null_tokens("null_cell")),
        "board_items_wide": f"WITH {_RAW_DEALS} SELECT CAST(ordinal AS VARCHAR) AS item_id, "
        f"coalesce(deal_name, '') AS item_name, {board_cells}, client_code AS link FROM raw",
        "board_pages_items": f"WITH {_RAW_DEALS} SELECT CAST(ordinal AS VARCHAR) AS id, "
        f"coalesce(deal_name, '') AS name, {2 + len(_DEALS)} AS cells FROM raw",
        "landing_errors": "SELECT event_id, concat(CASE WHEN event_id % 5 = 0 THEN 'Unknown error' "
        "ELSE concat('failed for ', user_id) END, "
        "CASE WHEN event_id % 3 = 0 THEN '; retry' ELSE '' END) AS message "
        "FROM events WHERE event_type = 'error'",
        "board_columns": f"WITH b AS ({raw.for_duckdb('boards')}) "
        "SELECT id AS board_id, name AS board_name, 0 AS pos, 'name' AS column_id, "
        "'Name' AS title, 'name' AS type FROM b UNION ALL "
        "SELECT id, name, 1, 'c1', 'Sector', 'dropdown' FROM b UNION ALL "
        "SELECT id, name, 2, 'c2', 'Amount', "
        "CASE WHEN nation % 2 = 0 THEN 'numbers' ELSE 'status' END FROM b",
        "find_board": f"WITH b AS ({raw.for_duckdb('boards')}) "
        "SELECT id, name, 3 AS n_columns FROM b WHERE name ILIKE '%work orders%' "
        "ORDER BY k LIMIT 1",
        "load_status": _on_both(
            "SELECT 'deals' AS \"table\", 'loaded_from_csv' AS status, count(*) AS rows FROM deals "
            "UNION ALL SELECT 'work_orders', 'loaded_from_csv', count(*) FROM work_orders"
        ),
        "load_board": f"WITH {_BOARD_DEALS}, {_CLEAN_ORDERS} "
        "SELECT 'deals' AS \"table\", 'loaded_from_api' AS status, count(*) AS rows FROM deals "
        "UNION ALL SELECT 'work_orders', 'loaded_from_csv', count(*) FROM work_orders",
        "cached_metrics": f"WITH {_CLEAN_DEALS}, {_CLEAN_ORDERS}, {_DQ_DEALS}, {_DQ_ORDERS}, {_DQ_OUTLIERS}, "
        "findings AS (SELECT * FROM dq_deals UNION SELECT * FROM dq_orders UNION SELECT * FROM dq_outliers) "
        f"SELECT * FROM ({_run_metric()}) k UNION ALL "
        "SELECT 'findings', concat(\"table\", '.', rule), CAST(affected AS DOUBLE), 'count', message FROM findings "
        "UNION ALL SELECT 'cache', 'deals', CAST(count(*) AS DOUBLE), 'rows', '0 sources read again' FROM deals",
        "clean_deals_csv": f"WITH {_FIRST_DEALS}, "
        "kept AS (SELECT * FROM firsts WHERE deal_status IS NULL OR deal_status <> 'Deal Status'), "
        f"named AS (SELECT ordinal, {_cols(_DEALS, {c: _trim(c) for c in _DEALS})} FROM kept "
        f"WHERE deal_name IS NULL OR {_trim('deal_name')} <> '') "
        f"SELECT position, {_cols(_DEALS, {**_DEAL_RULES, 'product_deal': _fill('product_deal')})} "
        f"FROM named JOIN ({_POSITIONS}) p USING (ordinal)",
        "clean_deals_board": f"WITH {_BOARD_DEALS} SELECT deals.* EXCLUDE (ordinal), position "
        f"FROM deals JOIN ({_POSITIONS}) p USING (ordinal)",
        # schema
        "canonical_deals": f"WITH {_RAW_DEALS} SELECT ordinal, {deals_list} FROM raw",
        "canonical_work_orders": f"WITH {_RAW_ORDERS} SELECT * FROM raw_wo",
        "enforce_types": f"WITH cells AS ({raw.for_duckdb('cells')}) SELECT id, amount_cell, "
        "CASE WHEN x IS NULL OR isnan(x) THEN 0.0 ELSE x END AS result FROM (SELECT *, "
        "TRY_CAST(CASE WHEN amount_cell LIKE '%d' THEN regexp_replace(amount_cell, 'd$', '') "
        "ELSE amount_cell END AS DOUBLE) AS x FROM cells) t",
        # filters
        "drop_empty_rows": f"WITH {_RAW_DEALS} SELECT * FROM raw WHERE {_nonempty(_DEALS)}",
        "drop_header_rows": f"WITH {_RAW_DEALS} SELECT * FROM raw WHERE deal_status IS NULL "
        "OR deal_status <> 'Deal Status'",
        "drop_blank_names": f"WITH {_RAW_DEALS} SELECT * FROM raw WHERE deal_name IS NULL "
        f"OR {_trim('deal_name')} <> ''",
        "flag_gibberish": _GIBBERISH,
        # scalar functions
        "strip_strings": _on_cells("text_cell", _trim("text_cell")),
        "safe_float": _on_cells("amount_cell", _amount("amount_cell")),
        "parse_dates": _on_cells("date_cell", _date("date_cell")),
        "normalize_sector": _on_cells("sector_cell", _sector("sector_cell")),
        "normalize_status": _on_cells("status_cell", _status("status_cell")),
        "normalize_probability": _on_cells("probability_cell", _probability("probability_cell")),
        "normalize_execution": _on_cells("execution_cell", _execution("execution_cell")),
        "fill_categoricals": _on_cells("text_cell", _fill("text_cell")),
        "clamp_negative": f"WITH cells AS ({raw.for_duckdb('cells')}) "
        f"SELECT id, {_clamped('amount_cell')} AS result FROM cells",
        "format_currency": f"SELECT o_orderkey, {_currency('v')} AS result FROM "
        f"(SELECT o_orderkey, o_totalprice * {_VALUE_SCALE} AS v FROM orders) t",
        "extract_intent": _INTENT,
        # duplicates
        "dedupe_deals": f"WITH {_RAW_DEALS} SELECT * FROM raw QUALIFY row_number() OVER ("
        "PARTITION BY deal_name, client_code, deal_value ORDER BY ordinal) = 1",
        "dedupe_work_orders": f"WITH {_FIRST_ORDERS} SELECT * FROM firsts_wo",
        "dedupe_full_row": f"WITH {_RAW_ORDERS} SELECT DISTINCT {orders_list} FROM raw_wo",
        # cleaned tables
        "clean_deals": _on_deals("SELECT * FROM deals"),
        "clean_work_orders": _on_orders(f"SELECT {orders_list} FROM work_orders"),
        # pipeline metrics
        "pipeline_by_stage": _on_deals(
            f"SELECT deal_stage, count(*) AS deal_count, {_sum('deal_value')} AS total_value "
            f"FROM deals WHERE {_OPEN} GROUP BY deal_stage"
        ),
        "average_deal_size": _on_deals(f"SELECT {_AVERAGE} AS average_deal_size"),
        "total_pipeline_value": _on_deals(f"SELECT {_TOTAL_PIPELINE} AS total_pipeline"),
        "active_deals": _on_deals(
            "SELECT count(*) AS active_deals FROM deals WHERE deal_status = 'Open'"
        ),
        "closing_this_month": _on_deals(
            "SELECT deal_name, sector, deal_value, deal_stage, closure_probability, "
            "tentative_close_date FROM deals WHERE deal_status = 'Open' "
            "AND year(tentative_close_date) = 2001 AND month(tentative_close_date) = 5"
        ),
        "closing_this_quarter": _on_deals(
            "SELECT * FROM deals WHERE deal_status = 'Open' AND sector = 'renewables' "
            "AND year(tentative_close_date) = 2001 AND quarter(tentative_close_date) = 2"
        ),
        "deal_creation_trend": _on_deals(
            "SELECT strftime(created_date, '%Y-%m') AS month, count(*) AS deal_count FROM deals "
            "WHERE created_date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 6"
        ),
        "pipeline_stage_quarter": _on_deals(
            "SELECT deal_stage, count(deal_name) AS deal_count, "
            f"{_sum('deal_value')} AS total_value FROM deals WHERE {_OPEN} "
            "AND year(tentative_close_date) = 2001 AND quarter(tentative_close_date) = 2 "
            "GROUP BY deal_stage"
        ),
        "deals_in_negotiation": _on_deals(
            "SELECT count(*) AS deals_in_negotiation FROM deals "
            "WHERE deal_stage = 'F. Negotiations' AND deal_status = 'Open'"
        ),
        "top_sector": _on_deals(
            f"SELECT sector, total_value FROM ({_BY_SECTOR}) b "
            "ORDER BY total_value DESC, sector LIMIT 1"
        ),
        "top_sectors": _on_deals(
            "SELECT sector, count(*) AS count FROM deals GROUP BY sector "
            "ORDER BY count DESC, sector LIMIT 5"
        ),
        "status_distribution": _on_deals(
            "SELECT deal_status, count(*) AS count FROM deals GROUP BY deal_status"
        ),
        # operational metrics
        "work_orders_by_sector": _on_orders(
            f"SELECT sector, count(*) AS order_count, {_sum('amount_total')} AS total_value "
            "FROM work_orders GROUP BY sector"
        ),
        "billing_completion": _on_orders(
            f"SELECT {_sum_valued('amount_total')} AS total_amount, "
            f"{_sum_valued('billed_value')} AS billed_amount, "
            f"{_sum_valued('amount_to_be_billed')} AS unbilled_amount, "
            f"{_COMPLETION} AS completion_rate FROM work_orders"
        ),
        "execution_status": _on_orders(_EXECUTION),
        "execution_status_share": _on_orders(
            f"SELECT *, count / sum(count) OVER () AS share FROM ({_EXECUTION}) e"
        ),
        "active_work_orders": _on_orders(
            f"SELECT {_ACTIVE} AS active_work_orders FROM work_orders"
        ),
        "work_orders_by_type": _on_orders(
            f"SELECT nature_of_work, count(*) AS count, {_sum('amount_total')} AS total_value "
            "FROM work_orders WHERE nature_of_work <> 'unknown' GROUP BY nature_of_work"
        ),
        "work_orders_by_status": _on_orders(
            "SELECT billing_status, count(*) AS count FROM work_orders "
            "WHERE billing_status NOT IN ('unknown', '') GROUP BY billing_status"
        ),
        # financial metrics
        "total_billed": _on_orders(f"SELECT {_BILLED} AS total_billed FROM work_orders"),
        "total_collected": _on_orders(
            f"SELECT {_COLLECTED} AS total_collected FROM work_orders"
        ),
        "total_receivable": _on_orders(
            f"SELECT {_RECEIVABLE} AS total_receivable FROM work_orders"
        ),
        "collection_rate": _on_orders(
            f"SELECT {_percent(_COLLECTED, _BILLED)} AS collection_rate FROM work_orders"
        ),
        "financial_summary": _on_orders(
            f"SELECT {_BILLED} AS total_billed, {_COLLECTED} AS total_collected, "
            f"{_RECEIVABLE} AS total_receivable, "
            f"{_percent(_COLLECTED, _BILLED)} AS collection_rate, "
            f"{_percent(_RECEIVABLE, _BILLED)} AS outstanding_ratio FROM work_orders"
        ),
        "billing_vs_collection": _on_orders(
            f"SELECT sector, {_sum('billed_value')} AS billed, "
            f"{_sum('collected_amount')} AS collected, {_sum('amount_receivable')} AS receivable, "
            f"{_sum('amount_to_be_billed')} AS to_be_billed FROM work_orders "
            "WHERE sector <> 'unknown' GROUP BY sector"
        ),
        "billing_series_long": _on_orders(
            " UNION ALL ".join(
                f"SELECT sector, '{name}' AS series, {_sum(column)} AS amount "
                "FROM work_orders WHERE sector <> 'unknown' GROUP BY sector"
                for name, column in (
                    ("Billed", "billed_value"),
                    ("Collected", "collected_amount"),
                    ("Receivable", "amount_receivable"),
                )
            )
        ),
        "receivables_by_sector": _on_orders(
            f"SELECT sector, {_sum('amount_receivable')} AS receivable_amount, "
            "count(*) AS wo_count FROM work_orders WHERE amount_receivable > 0 GROUP BY sector"
        ),
        # quality
        "dq_deals": f"WITH {_KEPT_DEALS}, {_DQ_DEALS} SELECT * FROM dq_deals",
        "dq_work_orders": f"WITH {_CLEAN_ORDERS}, {_DQ_ORDERS} SELECT * FROM dq_orders",
        "dq_all": f"WITH {_CLEAN_DEALS}, {_CLEAN_ORDERS}, {_DQ_DEALS}, {_DQ_ORDERS}, "
        f"{_DQ_OUTLIERS} SELECT * FROM dq_deals UNION SELECT * FROM dq_orders "
        "UNION SELECT * FROM dq_outliers UNION SELECT 'load', 'load_warning', 1, "
        "'Unable to retrieve latest data from the board. Using CSV fallback.'",
        "deal_value_outliers": "WITH deals AS (SELECT o_orderkey, o_totalprice * "
        "CASE WHEN o_orderkey % 997 = 0 THEN 50.0::DOUBLE ELSE 1.0::DOUBLE END AS deal_value "
        f"FROM orders) SELECT * FROM deals WHERE deal_value > ({_BOUND.format(t='deals')})",
        "receivable_mismatch": _on_orders(
            "SELECT serial, billed_value, collected_amount, amount_receivable FROM work_orders "
            f"WHERE {_MISMATCH}"
        ),
        # reports
        "leadership_kpis": _on_both(_display(_KPI_ROWS)),
        "kpi_cards": _on_both(
            f"SELECT c.metric, label, value, display, caption FROM ({_display(_KPI_ROWS)}) k "
            "JOIN (VALUES ('total_pipeline', 'Pipeline Value', 'Open deals'), "
            "('active_deals', 'Active Deals', 'Status: Open'), "
            "('total_receivable', 'Receivables', 'Outstanding'), "
            "('avg_deal_size', 'Avg Deal Size', 'All open deals')) c(metric, label, caption) "
            "ON k.metric = c.metric"
        ),
        "metric_data": _on_both(_metric_data()),
        "closing_soon": _on_deals(_closing_soon()),
        "data_summary": _summary_lines(),
        "interpret_questions": _INTERPRET,
        "typed_dates": "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS stamp, "
        "CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events",
        "context_summary": _on_both(_SUMMARY),
        "unknown_metric": _on_both(_SUMMARY),
        "report_lines": _on_both(_REPORT),
        "run_metric": _on_both(_run_metric()),
    }
