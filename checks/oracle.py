"""The registered queries as SQL for DuckDB, written against the warehouse tables alone."""

from __future__ import annotations

# The two years of the filtered queries.
START, END = "1997-01-01", "1998-12-31"

# The text around the data of a prompt.
PROMPT_HEAD = (
    "You are a business analyst. Analyse this Ghana-based business data (GHS amounts) "
    "and give brief insights.\n\nDATA:\n"
)
PROMPT_TAIL = (
    "\n\nReply ONLY with this JSON — no markdown, no extra text, keep each value under 100 words:\n"
    '{"summary":"1-2 sentences on business health","strengths":"2-3 bullet points using •",'
    '"risks":"2-3 bullet points using •","recommendations":"3 numbered recommendations",'
    '"forecast":"1-2 sentences on outlook"}'
)

LINES = """lines AS (
  SELECT l.*, o.o_orderdate, c_nationkey, 't' || c.c_nationkey AS user_id,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(l_quantity AS INTEGER)) AS id,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey
  JOIN customer c ON o_custkey = c_custkey)"""

SALES_LEDGER = f"""{LINES}, ledger AS (
  SELECT user_id, id,
         CASE WHEN l_quantity = 50 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
         p_name AS product, price AS sales,
         CASE WHEN l_returnflag = 'R' OR c_nationkey = 7 THEN '' ELSE p_type END AS category
  FROM lines JOIN part ON l_partkey = p_partkey)"""

EXPENSE_LEDGER = f"""{LINES}, ledger AS (
  SELECT user_id, id,
         CASE WHEN l_quantity = 50 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date,
         s_name AS vendor, price * CAST(l_discount AS DECIMAL(4,2)) AS amount,
         CASE WHEN l_returnflag = 'R' OR c_nationkey = 7 THEN '' ELSE l_linestatus END AS category
  FROM lines JOIN supplier ON l_suppkey = s_suppkey)"""


def _raw(day: str, party: str, source: str, amount: str, category: str, table: str, key: str) -> str:
    return f"""{LINES}, raw AS (
  SELECT user_id, id,
         CASE l_quantity WHEN 43 THEN NULL WHEN 50 THEN 'not a date'
              WHEN 49 THEN strftime({day}, '%m/%d/%Y') WHEN 48 THEN strftime({day}, '%-d-%b-%y')
              WHEN 47 THEN strftime({day}, '%Y-%m-%dT10:00:00Z')
              WHEN 46 THEN strftime({day}, '%-m/%-d/%Y 0:00')
              WHEN 45 THEN strftime({day}, '%B %-d, %Y') WHEN 44 THEN strftime({day}, '%Y.%m.%d')
              ELSE strftime({day}, '%Y-%m-%d') END AS date,
         CASE l_quantity WHEN 43 THEN NULL WHEN 4 THEN '   ' WHEN 5 THEN 'NA' WHEN 42 THEN chr(9)
              ELSE {source} END AS {party},
         CASE l_quantity WHEN 43 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN '₵' || price WHEN 3 THEN ''
              WHEN 6 THEN '1,234' WHEN 7 THEN ' ' || price || ' ' WHEN 8 THEN '1d'
              WHEN 9 THEN '-' || price ELSE CAST(price AS VARCHAR) END AS {amount},
         CASE WHEN l_returnflag = 'R' OR l_quantity = 43 THEN NULL ELSE {category} END AS category
  FROM lines JOIN {table} ON {key})"""


RAW_SALES = _raw("o_orderdate", "product", "p_name", "sales", "p_type", "part", "l_partkey = p_partkey")
RAW_EXPENSES = _raw(
    "l_shipdate", "vendor", "s_name", "amount", "l_linestatus", "supplier", "l_suppkey = s_suppkey"
)

# Calendar day of a raw date text, in the spellings that occur.
SPELLINGS = (
    "%Y-%m-%d", "%m/%d/%Y", "%d-%b-%y", "%Y-%m-%dT%H:%M:%SZ", "%m/%d/%Y %H:%M", "%B %d, %Y", "%Y.%m.%d",
)
RAW_DAY = f"""CAST(coalesce({', '.join(f"try_strptime(date, '{s}')" for s in SPELLINGS)}) AS DATE)"""
# Spellings of "no value".
NA = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
BLANK = "' ' || chr(9)"
NUMBER = r"'^\s*[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)\s*$'"


def _flagged(raw: str, party: str, amount: str) -> str:
    """Raw rows after NA tokens, with typed columns and the reason for setting a row aside."""
    na = ", ".join(f"'{t}'" for t in NA)
    known = ",\n         ".join(
        f"CASE WHEN {c} IN ({na}) THEN NULL ELSE {c} END AS {c}"
        for c in ("date", party, amount, "category")
    )
    return f"""{raw}, known AS (
  SELECT user_id, id, {known} FROM raw),
typed AS (
  SELECT *, {RAW_DAY} AS day,
         CASE WHEN regexp_matches({amount}, {NUMBER}) THEN TRY_CAST({amount} AS DOUBLE) END AS num
  FROM known),
flagged AS (
  SELECT *, CASE WHEN coalesce(date, {party}, {amount}, category) IS NULL THEN 'empty_row'
                 WHEN {amount} IS NULL THEN 'missing_amount'
                 WHEN num IS NULL THEN 'bad_amount'
                 WHEN coalesce(trim({party}, {BLANK}), '') = '' THEN 'missing_party' END AS reject_reason
  FROM typed)"""


def ledger_sql(ledger: str, party: str, amount: str, kind: str, step: str) -> dict[str, str]:
    """Queries that exist once per ledger."""
    between = f"date BETWEEN DATE '{START}' AND DATE '{END}'"
    totals = f"""{ledger}, totals AS (
  SELECT user_id, {party}, sum({amount}) AS total FROM ledger GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, {party}) AS rank
  FROM totals)"""
    top = lambda n: f"""WITH {totals}
SELECT user_id, CAST(rank AS INTEGER) AS rank, {party}, CAST(total AS DOUBLE) AS total
FROM ranked WHERE rank <= {n}"""
    share = lambda rows: f"""WITH {totals}, base AS (
  SELECT user_id, sum(total) AS base_total FROM {rows} GROUP BY user_id)
SELECT user_id, CAST(rank AS INTEGER) AS rank, {party}, CAST(total AS DOUBLE) AS total,
       CAST(base_total AS DOUBLE) AS base_total,
       round_even(CAST(total AS DOUBLE) / CAST(base_total AS DOUBLE) * 100, 6) AS percent
FROM ranked JOIN base USING (user_id) WHERE rank <= 10"""
    heat = lambda year: f"""WITH {ledger}, days AS (
  SELECT user_id, {year} weekofyear(date) AS week, isodow(date) - 1 AS dow, {amount} AS v
  FROM ledger WHERE date IS NOT NULL),
grid AS (
  SELECT DISTINCT user_id, {'iso_year,' if year else ''} week, g.dow
  FROM days, (SELECT unnest(range(7)) AS dow) g)
SELECT user_id, {'CAST(iso_year AS INTEGER) AS iso_year,' if year else ''}
       CAST(week AS INTEGER) AS week, CAST(dow AS INTEGER) AS dow,
       CAST(coalesce(sum(v), 0) AS DOUBLE) AS total
FROM grid LEFT JOIN days USING (user_id, {'iso_year,' if year else ''} week, dow) GROUP BY ALL"""
    windows = lambda chosen, scope: f"""{ledger}, chosen AS (SELECT * FROM ledger WHERE {chosen}),
bounds AS (
  SELECT user_id, min(date) AS first_date, max(date) AS last_date,
         greatest(max(date) - min(date), 1) AS span
  FROM chosen GROUP BY user_id),
windows AS (
  SELECT *, CAST(first_date - CAST(span + 1 AS INTEGER) AS DATE) AS prior_start,
         CAST(first_date - 1 AS DATE) AS prior_end FROM bounds),
prior AS (
  SELECT l.* FROM ledger l JOIN windows w
    ON l.user_id = w.user_id AND l.date BETWEEN w.prior_start AND w.prior_end AND {scope})"""
    window = windows(between, "TRUE")
    categories = "('', 'PROMO', 'ECONOMY', 'F')"
    parties = f"(SELECT DISTINCT {party} FROM ledger WHERE {party} LIKE '%e%')"
    figures = lambda rows: f"""SELECT user_id, sum({amount}) AS total, count(*) AS records,
         count(DISTINCT {party}) AS parties FROM {rows} GROUP BY user_id"""
    number = "CAST({} AS DOUBLE)".format
    metric = lambda name, now, old: f"""SELECT user_id, '{name}' AS metric,
    {now} AS value, CASE WHEN p.records > 0 THEN {old} END AS previous
  FROM now LEFT JOIN old p USING (user_id)"""
    trends = lambda chosen, scope: f"""WITH {windows(chosen, scope)}, now AS ({figures('chosen')}), old AS ({figures('prior')}),
long AS (
  {metric('total', number('now.total'), number('p.total'))}
  UNION ALL {metric('average', 'CAST(now.total AS DOUBLE) / now.records',
                    'CAST(p.total AS DOUBLE) / p.records')}
  UNION ALL {metric('parties', number('now.parties'), number('p.parties'))}
  UNION ALL {metric('records', number('now.records'), number('p.records'))}),
changes AS (
  SELECT *, CASE WHEN previous <> 0 THEN (value - previous) / previous * 100 END AS p FROM long)
SELECT user_id, metric, round_even(value, 6) AS value, round_even(previous, 6) AS previous,
       round_even(p, 6) AS pct,
       CASE WHEN p IS NULL THEN 'none' WHEN p > 0 THEN 'up' WHEN p < 0 THEN 'down'
            ELSE 'flat' END AS direction,
       CASE WHEN p IS NULL THEN '— No prior period'
            WHEN p > 0 THEN '▲ ' || format('{{:.1f}}', p) || '% vs prev period'
            WHEN p < 0 THEN '▼ ' || format('{{:.1f}}', -p) || '% vs prev period'
            ELSE '→ No change vs prev period' END AS label
FROM changes"""
    listing = f"""strftime(date, '%Y-%m-%d') AS date, {party},
       CAST(round_even({amount}, 2) AS DOUBLE) AS {amount}, category"""
    rule = {
        "target": "WHEN goal = 0 THEN 'primary' WHEN pct >= 100 THEN 'success' "
        "WHEN pct >= 60 THEN 'warning' ELSE 'danger'",
        "budget": "WHEN goal = 0 THEN 'danger' WHEN pct >= 90 THEN 'danger' "
        "WHEN pct >= 60 THEN 'warning' ELSE 'success'",
    }[kind]
    hint = {
        "target": "Set a target above to track your progress",
        "budget": "Set a budget above to track your spending",
    }[kind]
    page = lambda where, order, page: f"""WITH {ledger}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}, id) AS position
  FROM ledger WHERE {where})
SELECT user_id, CAST(position AS INTEGER) AS position, id, {listing}
FROM ranked WHERE position BETWEEN {page * 10 - 9} AND {page * 10}"""
    return {
        "clean_ledger": f"""WITH {ledger}
SELECT user_id, id, date, {party}, CAST({amount} AS DOUBLE) AS {amount}, category FROM ledger""",
        "filter_ledger": f"""WITH {ledger}
SELECT user_id, id, date, {party}, CAST({amount} AS DOUBLE) AS {amount}, category
FROM ledger WHERE {between}""",
        "kpis": f"""WITH {ledger}, k AS ({figures('ledger')})
SELECT user_id, CAST(total AS DOUBLE) AS total,
       round_even(CAST(total AS DOUBLE) / records, 6) AS average, parties, records FROM k""",
        "filter_options": f"""WITH {ledger}
SELECT DISTINCT user_id, 'party' AS option, {party} AS value FROM ledger
UNION ALL SELECT DISTINCT user_id, 'category', category FROM ledger WHERE category <> ''
UNION ALL SELECT user_id, 'start_date', strftime(min(date), '%Y-%m-%d') FROM ledger GROUP BY 1
UNION ALL SELECT user_id, 'end_date', strftime(max(date), '%Y-%m-%d') FROM ledger GROUP BY 1""",
        "daily_totals": f"""WITH {ledger}
SELECT user_id, date, CAST(sum({amount}) AS DOUBLE) AS total
FROM ledger WHERE date IS NOT NULL GROUP BY user_id, date""",
        "top_parties_10": top(10),
        "top_parties_5": top(5),
        "party_share": share("(SELECT * FROM ranked WHERE rank <= 10)"),
        "party_share_all": share("ranked"),
        "month_over_month": f"""WITH {ledger}, anchor AS (
  SELECT user_id, date_trunc('month', max(date)) AS this FROM ledger GROUP BY user_id),
pairs AS (
  SELECT user_id, {party},
         coalesce(sum({amount}) FILTER (date_trunc('month', date) = this), 0) AS this_month,
         coalesce(sum({amount}) FILTER (date_trunc('month', date) < this), 0) AS last_month
  FROM ledger JOIN anchor USING (user_id)
  WHERE date_trunc('month', date) IN (this, this - INTERVAL 1 MONTH) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY this_month + last_month DESC, {party}) AS rank FROM pairs)
SELECT user_id, CAST(rank AS INTEGER) AS rank, {party}, CAST(this_month AS DOUBLE) AS this_month,
       CAST(last_month AS DOUBLE) AS last_month,
       CAST(this_month + last_month AS DOUBLE) AS combined
FROM ranked WHERE rank <= 8""",
        "weekday_heatmap": heat(""),
        "weekday_heatmap_iso_year": heat("isoyear(date) AS iso_year,"),
        "monthly_totals_6": f"""WITH {ledger}, months AS (
  SELECT user_id, coalesce(strftime(date, '%Y-%m'), 'NaT') AS month, sum({amount}) AS total
  FROM ledger GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month DESC) AS n FROM months)
SELECT user_id, month, CAST(total AS DOUBLE) AS total FROM ranked WHERE n <= 6""",
        "category_totals": f"""WITH {ledger}
SELECT user_id, category, CAST(sum({amount}) AS DOUBLE) AS total FROM ledger
WHERE user_id IN (SELECT user_id FROM ledger WHERE category <> '')
GROUP BY user_id, category""",
        "ledger_totals": f"""WITH {ledger}
SELECT user_id, CAST(sum({amount}) AS DOUBLE) AS total,
       round_even(CAST(sum({amount}) AS DOUBLE) / count(*), 6) AS average, count(*) AS records,
       min(date) AS first_date, max(date) AS last_date,
       strftime(min(date), '%Y-%m-%d') || ' to ' || strftime(max(date), '%Y-%m-%d') AS date_range
FROM ledger GROUP BY user_id""",
        "period_bounds": f"""WITH {window}
SELECT user_id, first_date, last_date, CAST(span AS INTEGER) AS span_days, prior_start, prior_end
FROM windows""",
        "prior_rows": f"""WITH {window}
SELECT user_id, id, date, {party}, CAST({amount} AS DOUBLE) AS {amount}, category FROM prior""",
        "prior_kpis": f"""WITH {window}, k AS ({figures('prior')})
SELECT user_id, CAST(total AS DOUBLE) AS total,
       round_even(CAST(total AS DOUBLE) / records, 6) AS average, parties, records FROM k""",
        "kpis_with_trend": trends(between, "TRUE"),
        f"{kind}_progress": f"""WITH {ledger}, sums AS (
  SELECT user_id, CAST(sum({amount}) AS DOUBLE) AS actual FROM ledger GROUP BY user_id),
goals AS (
  SELECT 't' || n_nationkey AS user_id, CAST({step} * (n_nationkey % 4) AS DOUBLE) AS goal
  FROM nation),
both_sides AS (
  SELECT user_id, coalesce(actual, 0) AS actual, coalesce(goal, 0) AS goal
  FROM sums FULL JOIN goals USING (user_id)),
done AS (
  SELECT *, CASE WHEN goal > 0 THEN least(actual / goal * 100, 100) ELSE 0.0 END AS pct
  FROM both_sides)
SELECT user_id, actual, goal, CAST(pct AS DOUBLE) AS pct, CASE {rule} END AS status,
       CASE WHEN goal > 0 THEN '₵' || format('{{:,.0f}}', actual) || ' of ₵' ||
            format('{{:,.0f}}', goal) || ' (' || format('{{:.1f}}', CAST(pct AS DOUBLE)) || '%)'
            ELSE '{hint}' END AS text
FROM done""",
        "ledger_listing": f"WITH {ledger} SELECT user_id, id, {listing} FROM ledger",
        "list_page": page("TRUE", "date DESC NULLS LAST", 2),
        "list_page_deep": page("TRUE", "date DESC NULLS LAST", 101),
        "list_page_global": f"""WITH {ledger}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY date DESC NULLS LAST, id) AS position FROM ledger)
SELECT CAST(position AS INTEGER) AS position, id, {listing}
FROM ranked WHERE position BETWEEN 2001 AND 2010""",
        "filter_ledger_all": f"""WITH {ledger}
SELECT user_id, id, date, {party}, CAST({amount} AS DOUBLE) AS {amount}, category
FROM ledger WHERE {between} AND category IN {categories} AND {party} IN {parties}""",
        "filter_ledger_tables": f"""WITH {ledger}
SELECT user_id, id, date, {party}, CAST({amount} AS DOUBLE) AS {amount}, category
FROM ledger WHERE date >= DATE '{START}' AND category IN {categories} AND {party} IN {parties}""",
        "scan_ledger_tenants": f"""WITH {ledger}
SELECT user_id, id, date, {party}, CAST({amount} AS DOUBLE) AS {amount}, category
FROM ledger WHERE user_id IN ('t1', 't7') AND {between}""",
        "kpis_with_trend_chosen": trends(f"{between} AND category IN {categories}", "TRUE"),
        "kpis_with_trend_filtered": trends(f"{between} AND category IN {categories}", f"category IN {categories}"),
        f"global_{kind}": f"""WITH {ledger}, done AS (
  SELECT *, CASE WHEN goal > 0 THEN least(actual / goal * 100, 100) ELSE 0.0 END AS pct
  FROM (SELECT CAST(sum({amount}) AS DOUBLE) AS actual FROM ledger),
       (SELECT CAST({step} * sum(n_nationkey % 4) AS DOUBLE) AS goal FROM nation))
SELECT actual, goal, CAST(pct AS DOUBLE) AS pct, CASE {rule} END AS status,
       '₵' || format('{{:,.0f}}', actual) || ' of ₵' || format('{{:,.0f}}', goal) || ' (' ||
       format('{{:.1f}}', CAST(pct AS DOUBLE)) || '%)' AS text FROM done""",
        "list_page_by_amount": page("category <> ''", f"{amount} DESC", 3),
        "ledger_cube": f"""WITH {ledger}, cube AS (
  SELECT user_id, 'day' AS grain, date, NULL AS {party}, NULL AS category,
         sum({amount}) AS total, count(*) AS records FROM ledger GROUP BY ALL
  UNION ALL
  SELECT user_id, 'party', CAST(date_trunc('month', date) AS DATE) AS m, {party}, NULL,
         sum({amount}), count(*) FROM ledger GROUP BY user_id, m, {party}
  UNION ALL
  SELECT user_id, 'category', NULL, NULL, category, sum({amount}), count(*) FROM ledger
  GROUP BY user_id, category)
SELECT user_id, grain, date, {party}, category, CAST(total AS DOUBLE) AS {amount}, records
FROM cube""",
        "scan_ledger": f"""WITH {ledger}
SELECT user_id, id, date, {party}, CAST({amount} AS DOUBLE) AS {amount}, category FROM ledger""",
    }


def upload_sql(raw: str, party: str, amount: str) -> dict[str, str]:
    flagged = _flagged(raw, party, amount)
    return {
        "clean_ledger_raw": f"""WITH {raw}, typed AS (
  SELECT user_id, id, {RAW_DAY} AS day, {party}, coalesce(category, '') AS category,
         CASE WHEN regexp_matches({amount}, {NUMBER}) THEN TRY_CAST({amount} AS DOUBLE) END AS {amount}
  FROM raw)
SELECT user_id, id, day AS date, {party}, {amount}, category FROM typed
WHERE {amount} IS NOT NULL AND trim({party}, {BLANK}) <> ''""",
        "ingest_upload": f"""WITH {flagged}
SELECT user_id, day AS date, {party}, num AS {amount}, coalesce(category, '') AS category
FROM flagged WHERE reject_reason IS NULL""",
        "ingest_quarantine": f"""WITH {flagged}
SELECT user_id, date, {party}, {amount}, category, reject_reason
FROM flagged WHERE reject_reason IS NOT NULL""",
    }


def _section(name: str, ledger: str, party: str, amount: str) -> str:
    """CTEs ``<name>_*``: the parts of one section of the summary."""
    head, body = ledger.rsplit(", ledger AS (", 1)
    own = f"{name}_ledger AS ({body}"
    return f"""{own}, {name}_totals AS (
  SELECT user_id, CAST(round_even(sum({amount}), 2) AS DECIMAL(38,2)) AS total,
         CAST(round_even(CAST(sum({amount}) AS DOUBLE) / count(*), 2) AS DECIMAL(38,2)) AS average,
         count(*) AS records,
         strftime(min(date), '%Y-%m-%d') || ' to ' || strftime(max(date), '%Y-%m-%d') AS date_range
  FROM {name}_ledger GROUP BY user_id),
{name}_sums AS (
  SELECT user_id, 'monthly' AS item, coalesce(strftime(date, '%Y-%m'), 'NaT') AS key,
         sum({amount}) AS total FROM {name}_ledger GROUP BY ALL
  UNION ALL SELECT user_id, 'top', {party}, sum({amount}) FROM {name}_ledger GROUP BY ALL
  UNION ALL SELECT user_id, 'by_category', category, sum({amount}) FROM {name}_ledger GROUP BY ALL),
{name}_placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, item
           ORDER BY CASE WHEN item <> 'monthly' THEN total END DESC, key) AS place,
         count(*) OVER (PARTITION BY user_id, item) AS size,
         max(CASE WHEN key <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, item) AS named
  FROM {name}_sums),
{name}_items AS (
  SELECT user_id, item, key, CAST(round_even(total, 2) AS DECIMAL(38,2)) AS value,
         row_number() OVER (PARTITION BY user_id, item ORDER BY place) AS position
  FROM {name}_placed
  WHERE (item = 'monthly' AND place > size - 6) OR (item = 'top' AND place <= 5)
     OR (item = 'by_category' AND named = 1))"""


def _summary() -> str:
    sales = _section("sales", SALES_LEDGER, "product", "sales")
    expenses = _section("expenses", EXPENSE_LEDGER, "vendor", "amount")
    return f"""{LINES}, {sales}, {expenses}, profit AS (
  SELECT user_id, a.total AS income, b.total AS cost,
         CAST(round_even(CAST(income AS DOUBLE) - CAST(cost AS DOUBLE), 2) AS DECIMAL(38,2)) AS gross,
         CAST(round_even((CAST(income AS DOUBLE) - CAST(cost AS DOUBLE)) / CAST(income AS DOUBLE) * 100,
                         1) AS DECIMAL(38,1)) AS margin
  FROM sales_totals a JOIN expenses_totals b USING (user_id))"""


def _flat_summary() -> str:
    parts = []
    for name, top in (("sales", "top_products"), ("expenses", "top_vendors")):
        parts += [
            f"SELECT user_id, '{name}' AS section, '{i}' AS item, 1 AS position, '' AS key, "
            f"CAST({i} AS VARCHAR) AS value FROM {name}_totals"
            for i in ("total", "average", "records", "date_range")
        ]
        parts.append(
            f"SELECT user_id, '{name}', CASE item WHEN 'top' THEN '{top}' ELSE item END, "
            f"CAST(position AS INTEGER), key, CAST(value AS VARCHAR) FROM {name}_items"
        )
    parts += [
        f"SELECT user_id, 'profit', '{label}', 1, '', CAST({c} AS VARCHAR) FROM profit"
        for label, c in (("gross_profit", "gross"), ("profit_margin", "margin"))
    ]
    return f"WITH {_summary()}\n" + "\nUNION ALL ".join(parts)


def _json_document() -> str:
    """CTEs up to ``documents(user_id, summary)``: the summary as indented JSON text."""
    ctes, pieces = [], []
    for name, top in (("sales", "top_products"), ("expenses", "top_vendors")):
        ctes.append(f"""{name}_maps AS (
  SELECT user_id, item, string_agg('      "' || key || '" : ' || value, ',' || chr(10)
         ORDER BY position) AS entries FROM {name}_items GROUP BY ALL),
{name}_json AS (
  SELECT t.user_id, '  "{name}" : {{' || chr(10) || '    "total" : ' || total || ',' || chr(10)
    || '    "average" : ' || average || ',' || chr(10) || '    "records" : ' || records || ','
    || chr(10) || '    "date_range" : "' || date_range || '",' || chr(10)
    || '    "monthly" : {{' || chr(10) || m.entries || chr(10) || '    }},' || chr(10)
    || '    "{top}" : {{' || chr(10) || p.entries || chr(10) || '    }},' || chr(10)
    || '    "by_category" : {{' || coalesce(chr(10) || c.entries || chr(10) || '    }}', ' }}') || chr(10)
    || '  }}' AS text
  FROM {name}_totals t
  JOIN {name}_maps m ON m.user_id = t.user_id AND m.item = 'monthly'
  JOIN {name}_maps p ON p.user_id = t.user_id AND p.item = 'top'
  LEFT JOIN {name}_maps c ON c.user_id = t.user_id AND c.item = 'by_category')""")
        pieces.append(f"{name}_json.text")
    return f"""{_summary()}, {', '.join(ctes)}, documents AS (
  SELECT user_id, '{{' || chr(10) || {(" || ',' || chr(10) || ").join(pieces)} || ',' || chr(10)
    || '  "profit" : {{' || chr(10) || '    "gross_profit" : ' || gross || ',' || chr(10)
    || '    "profit_margin" : ' || margin || chr(10) || '  }}' || chr(10) || '}}' AS summary
  FROM sales_json JOIN expenses_json USING (user_id) JOIN profit USING (user_id))"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# What happens to a record follows from its line's quantity.
SALES_LINES = f"""{LINES}, sold AS (
  SELECT user_id, id, CAST(l_quantity AS INTEGER) AS q,
         CASE WHEN l_quantity = 50 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
         p_name AS product, price AS sales,
         CASE WHEN l_returnflag = 'R' OR c_nationkey = 7 THEN '' ELSE p_type END AS category
  FROM lines JOIN part ON l_partkey = p_partkey)"""
OLD = "user_id, id, date, product, CAST(sales AS DOUBLE) AS sales, category"


def _new(seq: str, suffix: str = "") -> str:
    return f"""user_id, id || '{suffix}', CAST(date + CAST({seq} AS INTEGER) AS DATE),
       product || ' v' || {seq}, CAST(sales + {seq} AS DOUBLE), 'changed'"""


CHANGE_SQL = {
    "append_rows": f"""WITH {SALES_LINES} SELECT {OLD} FROM sold
UNION ALL SELECT {_new('2')} FROM sold WHERE q IN (13, 14)
UNION ALL SELECT {_new('1', '-new')} FROM sold WHERE q IN (15, 16, 17)""",
    "clear_tenant": f"""WITH {SALES_LINES} SELECT {OLD} FROM sold
WHERE user_id NOT IN (SELECT 't' || n_nationkey FROM nation WHERE n_nationkey % 4 = 0)""",
    "apply_updates": f"""WITH {SALES_LINES}
SELECT {OLD} FROM sold WHERE q NOT IN (1, 2, 3, 4, 5, 9, 10, 11, 12)
UNION ALL SELECT {_new('1')} FROM sold WHERE q IN (1, 2, 3, 4, 5, 9, 10)
UNION ALL SELECT {_new('2')} FROM sold WHERE q IN (11, 12)""",
    "apply_deletes": f"""WITH {SALES_LINES} SELECT {OLD} FROM sold WHERE q NOT BETWEEN 6 AND 14""",
    "apply_changes": f"""WITH {SALES_LINES} SELECT {OLD} FROM sold WHERE q > 14
UNION ALL SELECT {_new('1')} FROM sold WHERE q <= 5
UNION ALL SELECT {_new('2')} FROM sold WHERE q IN (13, 14)
UNION ALL SELECT {_new('1', '-new')} FROM sold WHERE q IN (15, 16)
UNION ALL SELECT {_new('2', '-new')} FROM sold WHERE q = 17""",
}

# One field per update; quantities up to 3 get several.
CHANGE_SQL["apply_changes_partial"] = f"""WITH {SALES_LINES}
SELECT user_id, id, CASE WHEN q IN (3, 5) THEN DATE '1999-09-09' ELSE date END AS date,
       CASE WHEN q IN (1, 2) THEN product || ' b' WHEN q = 6 THEN product || ' a' ELSE product END AS product,
       CAST(CASE WHEN q <= 4 THEN sales + 1 ELSE sales END AS DOUBLE) AS sales,
       CASE WHEN q = 3 THEN 'again' ELSE category END AS category
FROM sold WHERE q <> 8
UNION ALL SELECT user_id, id || '-new', NULL, product, CAST(sales AS DOUBLE), '' FROM sold WHERE q = 7"""
CHANGE_SQL["store_changes"] = CHANGE_SQL["apply_changes_partial"]

CHANGE_SQL["store_snapshots"] = f"""WITH {SALES_LINES}, changed AS (
{CHANGE_SQL["apply_changes_partial"].removeprefix(f"WITH {SALES_LINES}")})
SELECT *, 2 AS version FROM changed UNION ALL SELECT {OLD}, 1 FROM sold"""
CHANGE_SQL["append_twice"] = f"""WITH {SALES_LINES}
SELECT user_id, date, 'any' AS product, CAST(sales AS DOUBLE) AS sales, category,
       2 * count(*) AS records, 2 * count(*) AS ids FROM sold GROUP BY ALL"""
CHANGE_SQL["store_compacted"] = f"WITH {SALES_LINES} SELECT {OLD} FROM sold"

# An entry's amount; a number followed by "d" is a number in the engine that made the entries.
ENTRIES = f"""{RAW_SALES}, entries AS (
  SELECT user_id, id, date AS raw_date, {RAW_DAY} AS date, trim(product, {BLANK}) AS product,
         CASE WHEN sales = '1d' THEN 1.0 ELSE TRY_CAST(sales AS DOUBLE) END AS sales, category
  FROM raw)"""
ENTRY_COLUMNS = "date, product, sales, coalesce(category, '') AS category"

CHECK_SQL = {
    "validate_entries": f"""WITH {ENTRIES} SELECT user_id, id, {ENTRY_COLUMNS},
       CASE WHEN raw_date IS NULL OR coalesce(product, '') = '' OR sales IS NULL THEN 'missing_field'
            WHEN sales < 0 THEN 'negative_amount' WHEN date IS NULL THEN 'bad_date'
       END AS reject_reason FROM entries""",
    "validate_edits": f"""WITH {ENTRIES}
SELECT user_id, CASE WHEN category IS NULL THEN NULL ELSE id END AS id, {ENTRY_COLUMNS},
       CASE WHEN category IS NULL THEN 'no_record'
            WHEN raw_date IS NULL OR coalesce(product, '') = '' OR sales IS NULL THEN 'missing_field'
            WHEN date IS NULL THEN 'bad_date' END AS reject_reason FROM entries""",
    "csv_scan": f"""WITH {RAW_SALES}
SELECT user_id, coalesce(date, '') AS date, coalesce(product, '') AS product,
       coalesce(sales, '') AS sales, coalesce(category, '') AS category FROM raw""",
    "decode_uploads": f"""WITH {_flagged(RAW_SALES, 'product', 'sales')}
SELECT user_id, id || CASE WHEN category IS NULL THEN '.txt'
         WHEN CAST(split_part(id, '-', 1) AS BIGINT) % 4 = 3 THEN '.CSV' ELSE '.csv' END AS file,
       CASE WHEN category IS NOT NULL THEN day END AS date,
       CASE WHEN category IS NOT NULL THEN product END AS product,
       CASE WHEN category IS NOT NULL THEN num END AS sales, category,
       CASE WHEN category IS NULL THEN 'unsupported_file' ELSE reject_reason END AS reject_reason
FROM flagged""",
}

REPLY_SQL = f"""WITH {SALES_LEDGER}, days AS (
  SELECT user_id, date, sum(sales) AS total, (date - DATE '1990-01-01') % 7 AS kind
  FROM ledger WHERE date IS NOT NULL GROUP BY user_id, date)
SELECT user_id, CASE WHEN kind <= 3 THEN 'ok' WHEN kind = 4 THEN 'bad_json' ELSE 'error' END AS status,
       CASE WHEN kind <= 3 THEN CAST(CAST(total AS DECIMAL(38,2)) AS VARCHAR) END AS summary,
       CASE WHEN kind <= 1 THEN '["a","b"]' WHEN kind <= 3 THEN '' END AS strengths,
       CASE WHEN kind <= 3 THEN strftime(date, '%Y-%m-%d') END AS risks,
       CASE WHEN kind <= 1 THEN '1. keep' WHEN kind <= 3 THEN '' END AS recommendations,
       CASE WHEN kind <= 1 THEN 'up' WHEN kind <= 3 THEN '' END AS forecast
FROM days"""


def all_sql() -> dict[str, str]:
    out = ledger_sql(SALES_LEDGER, "product", "sales", "target", "1e8")
    out |= upload_sql(RAW_SALES, "product", "sales")
    twins = ledger_sql(EXPENSE_LEDGER, "vendor", "amount", "budget", "5e6")
    twins |= upload_sql(RAW_EXPENSES, "vendor", "amount")
    out |= {n if n in ("budget_progress", "global_budget") else f"expense_{n}": q for n, q in twins.items()}
    out |= CHANGE_SQL | CHECK_SQL
    out |= {"csv_ingest": out["ingest_upload"], "decode_large_uploads": out["ingest_upload"], "list_page_indexed": out["list_page_deep"]}
    flagged = _flagged(RAW_SALES, "product", "sales")
    out["csv_mixed_layouts"] = f"""WITH {flagged}
SELECT CASE WHEN l_odd THEN 'a' ELSE 'b' END || '.csv' AS file, user_id, day AS date, product, num AS sales,
       coalesce(category, '') AS category
FROM (SELECT *, CAST(split_part(id, '-', 1) AS BIGINT) % 2 = 1 AS l_odd FROM flagged)
WHERE reject_reason IS NULL"""
    spans = f"""{SALES_LEDGER}, begun AS (
  SELECT k, DATE '1991-11-20' + CAST(k * 97 AS INTEGER) AS b FROM range(25) r(k)),
spans AS (
  SELECT 't' || n.n_nationkey AS user_id, CAST(k AS BIGINT) AS window_, CASE WHEN k % 5 <> 0 THEN CAST(b AS DATE) END AS start_,
         CASE WHEN k % 7 <> 0 THEN CAST(b + CAST(k * k * 3 AS INTEGER) AS DATE) END AS end_
  FROM nation n, begun)"""
    figures = """CAST(coalesce(sum(sales), 0) AS DOUBLE) AS total, round_even(CAST(sum(sales) AS DOUBLE) / count(sales), 6) AS average"""
    out["kpis_windows"] = f"""WITH {spans}
SELECT s.user_id, window_ AS "window", start_ AS start, end_ AS "end", {figures}, count(sales) AS records
FROM spans s LEFT JOIN ledger l ON l.user_id = s.user_id AND l.date >= coalesce(start_, DATE '0001-01-01')
  AND l.date <= coalesce(end_, DATE '9999-12-31') GROUP BY ALL"""
    out["kpis_from_bitmaps"] = f"""WITH {spans}
SELECT s.user_id, window_ AS "window", start_ AS "first", end_ AS "last", {figures},
       count(DISTINCT product) AS parties, count(*) AS records
FROM spans s JOIN ledger l ON l.user_id = s.user_id AND l.date >= date_trunc('month', start_)
  AND l.date <= last_day(end_) GROUP BY ALL"""
    out["ingest_file_dates"] = f"""WITH {SALES_LEDGER}
SELECT user_id, CASE WHEN CAST(substr(user_id, 2) AS INTEGER) % 3 < 2 THEN date
                     ELSE make_date(year(date), day(date), month(date)) END AS date,
       product, CAST(sales AS DOUBLE) AS sales, category
FROM ledger WHERE CAST(substr(user_id, 2) AS INTEGER) % 3 < 2 OR date IS NULL OR day(date) <= 12"""
    changed = CHANGE_SQL["apply_changes_partial"].removeprefix(f"WITH {SALES_LINES}")
    final = f"""{SALES_LINES}, changed AS ({changed}), ledger AS (
  SELECT user_id, id, date, product, CAST(sales AS DECIMAL(18,2)) AS sales, category FROM changed WHERE user_id <> 't7'
  UNION ALL SELECT user_id, id, date, product, sales, category FROM sold WHERE user_id = 't7' AND q = 1)"""
    out["cube_refreshed"] = out["ledger_cube"].replace(SALES_LEDGER, final)
    long = """CASE WHEN CAST(split_part(id, '-', 5) AS INTEGER) BETWEEN 10 AND 40
            THEN product || chr(10) || '"b", c' || chr(13) || chr(10) || chr(10) || product ELSE product END"""
    out["csv_multiline_split"] = f"""WITH {flagged}
SELECT user_id, day AS date, {long} AS product, num AS sales, coalesce(category, '') AS category
FROM flagged WHERE reject_reason IS NULL"""
    out["csv_quarantine"] = f"""WITH {flagged}, q AS (
  SELECT user_id, reject_reason FROM flagged WHERE reject_reason IS NOT NULL
  UNION ALL SELECT user_id, reason FROM (SELECT DISTINCT user_id FROM raw),
    (VALUES ('no_rows'), ('unsupported_file'), ('repeated_header'), ('unclosed_quote'), ('too_many_fields'))
    extra(reason)
  UNION ALL SELECT NULL, 'missing_tenant')
SELECT user_id, reject_reason, count(*) AS n FROM q GROUP BY ALL"""
    money = "CAST({} AS DOUBLE) AS {}".format
    out |= {
        "profit": f"""WITH {_summary()}
SELECT user_id, {money('income', 'sales_total')}, {money('cost', 'expense_total')},
       {money('gross', 'gross_profit')}, {money('margin', 'profit_margin')} FROM profit""",
        "global_kpis": f"""WITH {SALES_LEDGER}, k AS (
  SELECT sum(sales) AS total, count(DISTINCT product) AS parties, count(*) AS records FROM ledger)
SELECT CAST(total AS DOUBLE) AS total, round_even(CAST(total AS DOUBLE) / records, 6) AS average,
       parties, records, '₵' || format('{{:,.0f}}', CAST(total AS DOUBLE)) AS total_text,
       '₵' || format('{{:,.0f}}', CAST(total AS DOUBLE) / records) AS average_text FROM k""",
        "ledger_listing_headings": f"""WITH {SALES_LEDGER}
SELECT user_id, id, strftime(date, '%Y-%m-%d') AS "Date", product AS "Product",
       CAST(round_even(sales, 2) AS DOUBLE) AS "Sales (₵)", category AS "Category" FROM ledger""",
        "business_summary": _flat_summary(),
        "summary_json": f"WITH {_json_document()} SELECT user_id, summary FROM documents",
        "insight_prompts": f"""WITH {_json_document()}
SELECT user_id, {_text(PROMPT_HEAD)} || summary || {_text(PROMPT_TAIL)} AS prompt FROM documents""",
        "parse_replies": REPLY_SQL,
    }
    return out
