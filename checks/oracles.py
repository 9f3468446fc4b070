"""The same results in plain SQL, written independently of the Spark plans.

Common table expressions rebuild the tables from the star schema, then each query is
stated the direct way: row-by-row joins, windows over whole groups, NOT IN. They
need to be right on small data, not fast on large.
"""

from __future__ import annotations

AS_OF_YM = "2001-08"

ISO = r"'^([0-9]{4}-[0-9]{2}-[0-9]{2})'"
YM = r"'^([0-9]{4}-(?:0[1-9]|1[0-2]))-(?:0[1-9]|[12][0-9]|3[01])'"
YR = r"'^([0-9]{4})-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])'"
BLANKS = r"chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)||chr(65279)"


def iso(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, {ISO}, 1), '') AS DATE)"


def ym(x: str) -> str:
    return f"nullif(regexp_extract({x}, {YM}, 1), '')"


def yr(x: str) -> str:
    return f"nullif(regexp_extract({x}, {YR}, 1), '')"


def week(x: str) -> str:
    d = iso(x)
    return f"CAST(ceil((dayofyear({d}) + dayofweek(date_trunc('year', {d}))) / 7.0) AS INTEGER)"


def parse_num(x: str) -> str:
    kept = f"regexp_replace({x}, '[^0-9.\\-]', '', 'g')"
    return (
        f"TRY_CAST(nullif(regexp_extract({kept}, '^(-?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+))', 1), '') AS DOUBLE)"
    )


def trim(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def date_text(x: str) -> str:
    """ISO prefix or the trimmed text; NULL for a missing cell."""
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL "
        f"ELSE coalesce(nullif(regexp_extract({trim(x)}, {ISO}, 1), ''), {trim(x)}) END"
    )


def serial_text(v: str) -> str:
    return (
        f"strftime((CASE WHEN {v} > 60 THEN DATE '1899-12-30' ELSE DATE '1899-12-31' END)"
        f" + CAST(floor({v}) AS INTEGER), '%Y-%m-%d')"
    )


def cell_date(x: str) -> str:
    """Date of a raw cell: a plain number is a day serial, zero is missing."""
    v = f"TRY_CAST({x} AS DOUBLE)"
    return (
        f"CASE WHEN regexp_matches({x}, '^[0-9]+(\\.[0-9]+)?$') THEN "
        f"CASE WHEN {v} = 0 THEN NULL WHEN {v} >= 1 AND {v} < 2958466 THEN {serial_text(v)} ELSE {x} END "
        f"ELSE {date_text(x)} END"
    )


def pct(num: str, den: str, places: int = 1, missing: str = "NULL") -> str:
    return (
        f"CASE WHEN {den} > 0 THEN round(CAST({num} AS DOUBLE) * 100.0 / {den}, {places}) "
        f"ELSE CAST({missing} AS DOUBLE) END"
    )


def high(num: str, den: str) -> str:
    return f"coalesce({den} > 0 AND CAST({num} AS DOUBLE) / nullif({den}, 0) > 0.1, false)"


def pct_text(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN printf('%.2f%%', {pct(num, den, 2)}) ELSE '0%' END"


def exact(x: str) -> str:
    """Sums that may pass BIGINT are DECIMAL(38,0); they are compared as DOUBLE."""
    return f"CAST({x} AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


ROW_ID = (
    "l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || "
    "CAST(l_quantity AS BIGINT) || '|' || CAST(l_extendedprice AS DECIMAL(18,2))"
)
ORDER_ID = "CASE WHEN l_suppkey % 97 = 0 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END"
BRAND = (
    "CASE l_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN '-' ELSE coalesce(p_brand, '') END"
)
SHORT_PRICE = r"regexp_replace(CAST(nullif(item_price, 0) AS VARCHAR), '\.?0+$', '')"

O_CTE = f"""
order_rows AS (
  SELECT {ROW_ID} AS id,
    l_orderkey || '-' || l_linenumber AS identifier,
    CASE WHEN l_partkey % 89 = 0 THEN '' ELSE strftime(o_orderdate, '%B %Y') END AS purchase_month,
    CASE WHEN l_partkey % 89 = 0 THEN ''
         WHEN l_partkey % 83 = 0 THEN strftime(o_orderdate, '%-m/%-d/%Y')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS purchase_date,
    {BRAND} AS brand,
    {ORDER_ID} AS amazon_order_id,
    CASE WHEN l_suppkey % 97 = 0 AND l_partkey % 89 = 0 THEN ''
         WHEN o_orderstatus = 'F' THEN 'Shipped'
         WHEN o_orderstatus = 'O' THEN 'Cancelled'
         WHEN l_linestatus = 'O' THEN 'On Trial' ELSE 'Shipped' END AS order_status,
    coalesce(p_name, '') AS product_name,
    'SKU-' || l_linenumber AS sku,
    'ASIN-' || l_partkey AS asin,
    CASE WHEN l_linestatus = 'F' THEN 'Shipped' ELSE 'Unshipped' END AS item_status,
    CAST(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE l_quantity END AS BIGINT) AS quantity,
    CASE WHEN l_discount = 0.0 THEN NULL WHEN l_discount = 0.01 THEN CAST(0 AS DECIMAL(18,2))
         ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS item_price,
    CAST(CAST(l_tax AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS item_tax,
    o_orderdate AS raw_day, l_linenumber AS ln, l_partkey AS pk
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
),
o AS (
  SELECT *, {week('purchase_date')} AS purchase_week, {ym('purchase_date')} AS purchase_ym,
    {yr('purchase_date')} AS purchase_y,
    md5(identifier || '|' || asin || '|' || purchase_date || '|' || coalesce({SHORT_PRICE}, '')) AS row_hash
  FROM order_rows
)"""

DISPOSITION = """CASE WHEN l_tax = 0.0 THEN '' WHEN l_tax = 0.01 THEN NULL
         WHEN l_linestatus = 'F' THEN 'SELLABLE'
         WHEN l_suppkey % 3 = 0 THEN 'CUSTOMER_DAMAGED'
         WHEN l_suppkey % 3 = 1 THEN 'DEFECTIVE' ELSE 'CARRIER_DAMAGED' END"""

# Return records of every line item; ``r`` are those flagged as returned.
R_CTE = f"""
reasons AS (
  SELECT *, CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber % 3 = 0 THEN 'TOO_SMALL'
    WHEN l_linenumber % 3 = 1 THEN 'NOT_AS_DESCRIBED' ELSE 'DEFECTIVE' END AS reason
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
),
return_rows AS (
  SELECT {ROW_ID} AS id, '' AS purchase_month, CAST(NULL AS VARCHAR) AS purchase_date,
    CASE WHEN l_partkey % 89 = 0 THEN '' ELSE strftime(l_shipdate, '%B %Y') END AS return_month,
    CASE WHEN l_partkey % 89 = 0 THEN '' ELSE strftime(l_shipdate, '%Y') END AS return_year,
    CASE WHEN l_partkey % 89 = 0 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS return_date,
    {ORDER_ID} AS order_id, 'SKU-' || l_linenumber AS sku, 'ASIN-' || l_linenumber AS asin,
    'FN-' || l_partkey AS fnsku, coalesce(p_name, '') AS product_name,
    CAST(l_quantity AS BIGINT) AS quantity, {DISPOSITION} AS disposition, reason,
    'Unit returned' AS status,
    CASE l_suppkey % 4 WHEN 0 THEN 'Men' WHEN 1 THEN 'Women' WHEN 2 THEN 'Unisex' ELSE '' END AS gender,
    {BRAND} AS brand,
    CASE WHEN l_linenumber % 4 = 0 THEN 'said "' || lower(reason) || '",' ||
      CASE WHEN l_suppkey % 2 = 0 THEN chr(10) ELSE ' ' END || 'sent back' ELSE '' END AS customer_comments,
    l_returnflag AS flag, l_suppkey AS sk, l_linenumber AS ln
  FROM reasons
),
any_r AS (
  SELECT *, {week('return_date')} AS return_week, {ym('return_date')} AS return_ym,
    {yr('return_date')} AS return_y,
    md5(order_id || '|' || asin || '|' || return_date || '|' || reason) AS row_hash
  FROM return_rows
),
r AS (SELECT * FROM any_r WHERE flag = 'R')"""

ORDER_COLUMNS = (
    "id, identifier, purchase_month, purchase_date, purchase_week, brand, amazon_order_id, order_status, "
    "product_name, sku, asin, item_status, quantity, CAST(item_price AS DOUBLE) AS item_price, "
    "CAST(item_tax AS DOUBLE) AS item_tax, row_hash, purchase_ym, purchase_y"
)
RETURN_COLUMNS = (
    "id, purchase_month, purchase_date, return_month, return_year, return_date, return_week, order_id, sku, "
    "asin, fnsku, product_name, quantity, disposition, reason, status, gender, brand, customer_comments, "
    "row_hash, return_ym, return_y"
)

RAW_ORDERS_CTE = f"""{O_CTE},
sheet AS (
  SELECT id,
    CASE WHEN ln = 5 THEN '' ELSE identifier END AS c_identifier,
    CASE WHEN ln = 5 THEN identifier || ' ' ELSE 'dup' END AS c_duplicate,
    purchase_month,
    CASE WHEN pk % 7 = 0 THEN datediff('day', DATE '1899-12-30', CAST(raw_day AS DATE)) || '.75'
         WHEN pk % 7 = 1 THEN '' WHEN pk % 7 = 2 THEN '0' ELSE ' ' || purchase_date END AS c_date2,
    CASE WHEN pk % 89 = 0 THEN '' ELSE strftime(raw_day, '%Y-%m-%dT10:00:00+00:00') END AS c_date,
    chr(9) || brand || '  ' AS c_brand,
    amazon_order_id, order_status, product_name, sku, asin, item_status,
    CASE WHEN ln = 6 THEN '(' || quantity || ')' WHEN ln = 7 THEN 'n/a'
         ELSE CAST(quantity AS VARCHAR) END AS c_quantity,
    CASE WHEN pk % 3 = 0 AND item_price > 0 THEN '$' || format('{{:,.2f}}', CAST(item_price AS DOUBLE))
         ELSE coalesce(CAST(item_price AS VARCHAR), '') END AS c_price,
    CAST(item_tax AS VARCHAR) AS c_tax
  FROM o
),
picked AS (
  SELECT *, coalesce(nullif(c_identifier, ''), c_duplicate) AS raw_identifier,
    CASE WHEN c_date2 NOT IN ('', '0') THEN c_date2 ELSE c_date END AS raw_date,
    CASE WHEN c_date <> '' THEN c_date WHEN c_date2 = '0' THEN '' ELSE c_date2 END AS hash_date,
    CASE WHEN TRY_CAST(c_price AS DOUBLE) = 0 THEN '' ELSE c_price END AS hash_price
  FROM sheet
),
dated AS (SELECT *, {cell_date('raw_date')} AS purchase_date FROM picked)"""

# Each cell stands under the workbook or the marketplace header; either way it is the
# only filled one, so the picked cell is the value itself.
RAW_RETURNS_CTE = f"""{R_CTE},
sheet AS (
  SELECT id, CASE WHEN ln = 3 THEN return_month ELSE ' ' END AS c_month,
    CASE WHEN ln = 3 THEN return_year ELSE '' END AS c_year,
    CASE WHEN return_date = '' THEN '' ELSE return_date || 'T08:30:00+00:00' END AS c_date,
    order_id || ' ' AS c_order, ' ' || reason AS c_reason,
    CASE WHEN ln = 7 THEN '0' ELSE CAST(quantity AS VARCHAR) END AS c_quantity,
    sku, asin, fnsku, product_name, coalesce(disposition, '') AS disposition, status, gender, brand,
    customer_comments, purchase_month
  FROM r
),
dated AS (SELECT *, {date_text('c_date')} AS return_date, {trim('c_order')} AS order_id,
  {trim('c_reason')} AS reason FROM sheet)"""

JOINED = "r JOIN o ON r.order_id = o.amazon_order_id"

MONTHLY_CTE = f"""
mo AS (
  SELECT purchase_ym AS month, min(purchase_date) AS month_start,
    {big("sum(CASE WHEN order_status <> 'On Trial' THEN quantity ELSE 0 END)")} AS order_units,
    CAST(sum(CASE WHEN order_status = 'Shipped' THEN item_price ELSE 0 END) AS DOUBLE) AS revenue,
    count(CASE WHEN order_status = 'Cancelled' THEN 1 END) AS cancelled
  FROM o WHERE purchase_date <> '' GROUP BY purchase_ym
),
mr AS (
  SELECT purchase_ym AS month, {exact('sum(r.quantity)')} AS return_units
  FROM {JOINED} WHERE o.purchase_date <> '' GROUP BY purchase_ym
),
monthly AS (
  SELECT mo.*, coalesce(mr.return_units, 0) AS return_units
  FROM mo LEFT JOIN mr ON mo.month IS NOT DISTINCT FROM mr.month
)"""

WEEKLY_CTE = f"""
wr AS (
  SELECT return_y AS year, return_week AS week, count(*) AS returns
  FROM r WHERE return_date <> '' GROUP BY return_y, return_week
),
wo AS (
  SELECT purchase_y AS year, purchase_week AS week, min(purchase_date) AS week_start,
    count(CASE WHEN order_status = 'Shipped' THEN 1 END) AS shipped_orders,
    {big("sum(CASE WHEN order_status = 'Shipped' THEN quantity ELSE 0 END)")} AS units,
    CAST(sum(CASE WHEN order_status = 'Shipped' THEN item_price ELSE 0 END) AS DOUBLE) AS revenue
  FROM o WHERE purchase_date <> '' AND purchase_week IS NOT NULL GROUP BY purchase_y, purchase_week
),
weekly AS (
  SELECT wo.*, coalesce(wr.returns, 0) AS returns
  FROM wo LEFT JOIN wr ON wo.week = wr.week AND wo.year = wr.year
)"""

PERIOD_CTE = f"""
ranked AS (
  SELECT month, CAST(row_number() OVER (ORDER BY month DESC) AS INTEGER) AS month_rank FROM (
    SELECT DISTINCT purchase_ym AS month FROM o
    WHERE purchase_date <> '' AND purchase_ym < '{AS_OF_YM}')
),
periods(period, months) AS (VALUES ('last_month', 1), ('last_3_months', 3), ('last_12_months', 12)),
period_rows AS (SELECT period, months, month, month_rank FROM periods JOIN ranked ON month_rank <= months),
p_units AS (
  SELECT period, months, {big("coalesce(sum(CASE WHEN order_status <> 'On Trial' THEN quantity END), 0)")} AS orders_units
  FROM periods LEFT JOIN period_rows USING (period, months) LEFT JOIN o ON purchase_ym = month
  GROUP BY period, months
),
p_joined AS (
  SELECT period, months, r.quantity, r.disposition
  FROM period_rows JOIN o ON purchase_ym = month JOIN r ON r.order_id = o.amazon_order_id
),
p_returns AS (
  SELECT period, months, {exact('coalesce(sum(quantity), 0)')} AS returns_total,
    {exact("coalesce(sum(CASE WHEN disposition = 'SELLABLE' THEN quantity ELSE 0 END), 0)")} AS sellable,
    {exact("coalesce(sum(CASE WHEN disposition <> '' AND disposition <> 'SELLABLE' THEN quantity ELSE 0 END), 0)")}
      AS unsellable
  FROM periods LEFT JOIN p_joined USING (period, months) GROUP BY period, months
),
p_disp AS (
  SELECT period, months, disposition, {exact('sum(quantity)')} AS units
  FROM p_joined WHERE disposition <> '' AND disposition <> 'SELLABLE' GROUP BY period, months, disposition
),
p_stats AS (SELECT * FROM p_returns JOIN p_units USING (period, months))"""

# Returns import, told row by row in arrival order (batch, id).
UPSERT_CTE = f"""{R_CTE},
incoming AS (
  SELECT 1 AS batch, * EXCLUDE (flag, sk, ln) FROM r
  UNION ALL
  SELECT 2, * EXCLUDE (flag, sk, ln) REPLACE (CASE WHEN sk % 10 = 0 THEN 'DEFECTIVE' ELSE '' END AS disposition)
  FROM r WHERE sk % 5 = 0
  UNION ALL
  SELECT 2, * EXCLUDE (flag, sk, ln) FROM any_r WHERE flag = 'A' AND sk % 5 = 0
),
told AS (
  SELECT *, row_number() OVER w AS nth,
    coalesce(max(CASE WHEN disposition <> '' THEN 1 ELSE 0 END) OVER
      (PARTITION BY row_hash ORDER BY batch, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled
  FROM incoming WINDOW w AS (PARTITION BY row_hash ORDER BY batch, id)
),
acted AS (
  SELECT *, nth > 1 AND filled = 0 AS still_blank,
    CASE WHEN nth = 1 THEN 'added' WHEN filled = 0 THEN 'updated' ELSE 'skipped' END AS action
  FROM told
),
filled AS (
  SELECT row_hash, arg_min(disposition, batch || '|' || id) AS fill FROM acted WHERE disposition <> '' GROUP BY row_hash
),
imported AS (
  SELECT acted.* REPLACE (coalesce(fill, '') AS disposition) FROM acted LEFT JOIN filled USING (row_hash) WHERE nth = 1
)"""

# Orders load: everything twice, the hash being (identifier, id).
LOAD_CTE = f"""{O_CTE},
resent AS (
  SELECT 1 AS batch, * REPLACE (md5(identifier || '|' || id) AS row_hash) FROM o WHERE id < '5'
  UNION ALL
  SELECT 2, * REPLACE (md5(identifier || '|' || id) AS row_hash) FROM o
),
loaded AS (
  SELECT *, row_number() OVER (PARTITION BY row_hash ORDER BY batch, id) AS nth FROM resent
)"""


def _o(select: str) -> str:
    return f"WITH {O_CTE} {select}"


def _r(select: str) -> str:
    return f"WITH {R_CTE} {select}"


def _both(ctes: str, select: str) -> str:
    return f"WITH {O_CTE}, {R_CTE}, {ctes.lstrip()} {select}"


DEDUP_ORDERS = """
  SELECT *, row_number() OVER (PARTITION BY amazon_order_id, sku ORDER BY
      CASE WHEN item_price IS NOT NULL AND item_price <> 0 THEN 0 ELSE 1 END,
      CASE WHEN purchase_date IS NOT NULL AND purchase_date <> '' THEN 0 ELSE 1 END, id) AS rn,
    amazon_order_id <> '' AND sku <> '' AS in_scope
  FROM o"""


def _dedup_returns(source: str) -> str:
    return f"""
  SELECT *, row_number() OVER (PARTITION BY order_id, asin, return_date, reason ORDER BY
      CASE WHEN disposition <> '' THEN 0 ELSE 1 END, batch, id) AS rn,
    order_id <> '' AND return_date <> '' AS in_scope
  FROM {source}"""


NUMBER_CELLS = """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 16
    WHEN 0 THEN '$' || format('{:,.2f}', l_extendedprice) WHEN 1 THEN '' WHEN 2 THEN '--' || l_linenumber
    WHEN 3 THEN l_linenumber || '-2' WHEN 4 THEN l_linenumber || '.2.3' WHEN 5 THEN '-.' || l_linenumber
    WHEN 6 THEN l_linenumber || '.' WHEN 7 THEN '(' || l_suppkey || ')' WHEN 8 THEN 'abc'
    WHEN 9 THEN l_linenumber || 'e5' WHEN 10 THEN '-' WHEN 11 THEN '.'
    WHEN 12 THEN 'USD ' || l_suppkey WHEN 13 THEN '0.5' WHEN 14 THEN l_linenumber || '.5'
    ELSE '-' || l_linenumber || '.25' END AS cell
  FROM lineitem"""

DATE_CELLS = """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CASE l_partkey % 6
    WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%dT10:00:00+00:00') WHEN 1 THEN ' ' || strftime(l_shipdate, '%Y-%m-%d') || ' '
    WHEN 2 THEN strftime(l_shipdate, '%-m/%-d/%Y') WHEN 3 THEN '' WHEN 4 THEN CAST(NULL AS VARCHAR)
    ELSE strftime(l_shipdate, '%Y-%m-%d') END AS cell
  FROM lineitem"""

SERIALS = """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 16 + l_partkey % 59 + 0.75 AS serial
  FROM lineitem"""

RESENT_RETURNS = """
  twice AS (
    SELECT 1 AS batch, * EXCLUDE (flag, sk, ln) REPLACE ('1|' || id AS id) FROM r
    UNION ALL
    SELECT 2, * EXCLUDE (flag, sk, ln) REPLACE ('2|' || id AS id,
      CASE WHEN sk % 10 = 0 THEN 'DEFECTIVE' ELSE '' END AS disposition) FROM r WHERE sk % 5 = 0
    UNION ALL
    SELECT 2, * EXCLUDE (flag, sk, ln) REPLACE ('2|' || id AS id) FROM any_r WHERE flag = 'A' AND sk % 5 = 0
  )"""

# One made-up load per order day.
LOG_CTE = """
  entries AS (
    SELECT 'orders-' || strftime(o_orderdate, '%Y-%m-%d') || '.csv' AS filename,
      md5('orders-' || strftime(o_orderdate, '%Y-%m-%d')) AS file_hash, 'orders' AS type,
      count(*) AS rows_added, count(*) FILTER (o_orderstatus = 'O') AS rows_skipped,
      strftime(o_orderdate, '%Y-%m-%d') AS uploaded_on
    FROM orders GROUP BY o_orderdate
  )"""

FACETS_CTE = """
  facets AS (
    SELECT DISTINCT 'reason' AS facet, reason AS value, CAST(NULL AS VARCHAR) AS earliest FROM r WHERE reason <> ''
    UNION ALL
    SELECT DISTINCT 'brand', brand, NULL FROM r WHERE brand <> '' AND brand <> '-'
    UNION ALL
    SELECT DISTINCT 'disposition', disposition, NULL FROM r WHERE disposition <> ''
    UNION ALL
    SELECT 'return_month', return_month, min(return_date) FROM r WHERE return_month <> '' GROUP BY return_month
    UNION ALL
    SELECT 'purchase_month', purchase_month, min(purchase_date) FROM o WHERE purchase_month <> ''
    GROUP BY purchase_month
  )"""

SEARCH = "(product_name ILIKE '%GEAR%' OR sku ILIKE '%GEAR%' OR asin ILIKE '%GEAR%' OR order_id ILIKE '%GEAR%')"
SEARCHES = [
    f"{SEARCH} AND reason = 'DEFECTIVE' AND disposition = 'SELLABLE'",
    "brand = 'Brand#2'",
    "return_month = 'March 1999'",
    f"{SEARCH} AND brand = 'Brand#2' AND reason = 'NOT_AS_DESCRIBED'",
    "brand = 'Brand#2' AND return_month = 'March 1999' AND reason = 'DEFECTIVE' AND disposition = 'SELLABLE' "
    "AND (product_name ILIKE '%a%' OR sku ILIKE '%a%' OR asin ILIKE '%a%' OR order_id ILIKE '%a%')",
]


def _table_rows() -> str:
    """The comparison table: metrics of each period side by side."""

    def share(num: str, den: str) -> str:
        return f"CASE WHEN {num} <> 0 AND {den} > 0 THEN round(CAST({num} AS DOUBLE) * 100.0 / {den}, 1) END"

    metrics = [
        (1, "orders_units", "orders_units"),
        (2, "returns", "returns_total"),
        (3, "returns_pct_of_orders", share("returns_total", "orders_units")),
        (4, "unsellable", "unsellable"),
        (5, "unsellable_pct_of_orders", share("unsellable", "orders_units")),
        (6, "unsellable_pct_of_returns", share("unsellable", "returns_total")),
        (10, "sellable", "sellable"),
        (11, "sellable_pct_of_orders", share("sellable", "orders_units")),
        (12, "sellable_pct_of_returns", share("sellable", "returns_total")),
    ]
    parts = [
        f"SELECT {n} AS position, '{name}' AS metric, '' AS disposition, period, CAST({x} AS DOUBLE) AS value FROM p_stats"
        for n, name, x in metrics
    ]
    each = [
        (7, "units", "units"),
        (8, "units_pct_of_returns", share("units", "returns_total")),
        (9, "units_pct_of_unsellable", share("units", "unsellable")),
    ]
    parts += [
        f"SELECT {n}, '{name}', disposition, period, CAST({x} AS DOUBLE) FROM p_disp JOIN p_stats USING (period)"
        for n, name, x in each
    ]
    rows = " UNION ALL ".join(parts)

    def column(period: str) -> str:
        value = f"max(value) FILTER (period = '{period}')"
        return f"CASE WHEN metric = 'units' THEN coalesce({value}, 0) ELSE {value} END AS {period}"

    columns = ", ".join(column(p) for p in ("last_month", "last_3_months", "last_12_months"))
    return (
        f"SELECT position, metric, disposition, replace(disposition, '_', ' ') AS label, {columns} "
        f"FROM ({rows}) GROUP BY position, metric, disposition"
    )


def _ingest_orders() -> str:
    return f"""WITH {RAW_ORDERS_CTE}
            SELECT id, {trim('raw_identifier')} AS identifier, {trim('purchase_month')} AS purchase_month,
              purchase_date, {week('purchase_date')} AS purchase_week, {trim('c_brand')} AS brand,
              amazon_order_id, order_status, product_name, sku, asin, item_status,
              CAST(coalesce({parse_num('c_quantity')}, 0) AS BIGINT) AS quantity,
              {parse_num('c_price')} AS item_price, {parse_num('c_tax')} AS item_tax,
              md5(raw_identifier || '|' || asin || '|' || hash_date || '|' || hash_price) AS row_hash,
              {ym('purchase_date')} AS purchase_ym, {yr('purchase_date')} AS purchase_y FROM dated"""


def _ingest_returns() -> str:
    return f"""WITH {RAW_RETURNS_CTE}
            SELECT id, purchase_month, CAST(NULL AS VARCHAR) AS purchase_date,
              coalesce(nullif({trim('c_month')}, ''), strftime({iso('return_date')}, '%B %Y'), '') AS return_month,
              coalesce(nullif(c_year, ''), strftime({iso('return_date')}, '%Y'), '') AS return_year,
              return_date, {week('return_date')} AS return_week, order_id, sku, asin, fnsku, product_name,
              CAST(CASE WHEN coalesce({parse_num('c_quantity')}, 0) = 0 THEN 1
                ELSE {parse_num('c_quantity')} END AS BIGINT) AS quantity,
              disposition, reason, status, gender, brand, customer_comments,
              md5(order_id || '|' || asin || '|' || coalesce(return_date, '') || '|' || reason) AS row_hash,
              {ym('return_date')} AS return_ym, {yr('return_date')} AS return_y FROM dated"""


def _loaded(rows: str) -> str:
    """A first-wins load of rows that arrive in the order of their ids."""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_hash ORDER BY id) AS rn FROM ({rows}))
      WHERE rn = 1"""


def _load_log() -> str:
    """A workbook of both sheets, then its returns sheet alone, twice (logged once)."""
    return f"""WITH o_all AS ({_ingest_orders()}), r_all AS ({_ingest_returns()}),
      n AS (SELECT (SELECT count(*) FROM o_all) AS o_seen, (SELECT count(DISTINCT row_hash) FROM o_all) AS o_new,
        (SELECT count(*) FROM r_all) AS r_seen, (SELECT count(DISTINCT row_hash) FROM r_all) AS r_new)
      SELECT 'book' AS filename, 'auto' AS type, o_new + r_new AS rows_added,
        o_seen + r_seen - o_new - r_new AS rows_skipped FROM n
      UNION ALL SELECT 'returns.csv', 'auto', 0, r_seen FROM n"""


def _maintained() -> str:
    return f"""WITH o AS ({_loaded(_ingest_orders())}), r AS ({_loaded(_ingest_returns())}),
      good AS (SELECT * FROM o WHERE amazon_order_id <> '' OR coalesce(purchase_date, '') <> '' OR order_status <> ''),
      best AS (SELECT *, row_number() OVER (PARTITION BY amazon_order_id, sku ORDER BY
          CASE WHEN coalesce(item_price, 0) <> 0 THEN 0 ELSE 1 END,
          CASE WHEN coalesce(purchase_date, '') <> '' THEN 0 ELSE 1 END, id) AS place FROM good),
      filled AS (SELECT * FROM r WHERE disposition <> ''),
      first AS (SELECT *, row_number() OVER (PARTITION BY order_id, asin, return_date, reason ORDER BY id) AS place
        FROM filled),
      n AS (SELECT (SELECT count(*) FROM o) AS n_o, (SELECT count(*) FROM good) AS n_good,
        (SELECT count(*) FROM best WHERE place = 1 OR amazon_order_id = '' OR sku = '') AS n_best,
        (SELECT count(*) FROM r) AS n_r, (SELECT count(*) FROM filled) AS n_filled,
        (SELECT count(*) FROM first WHERE place = 1 OR order_id = '' OR coalesce(return_date, '') = '') AS n_first)
      SELECT 'cleanup_bad_orders' AS operation, n_o - n_good AS deleted, n_good AS remaining FROM n
      UNION ALL SELECT 'dedup_orders', n_good - n_best, n_best FROM n
      UNION ALL SELECT 'cleanup_empty_disposition', n_r - n_filled, n_filled FROM n
      UNION ALL SELECT 'dedup_returns', n_filled - n_first, n_first FROM n
      UNION ALL SELECT 'truncate_orders', n_best, 0 FROM n
      UNION ALL SELECT 'truncate_returns', n_first, 0 FROM n"""


BREAKDOWNS = f"""SELECT 'reason' AS dimension, reason AS value, count(*) AS records, {big('sum(quantity)')} AS units
              FROM r WHERE reason <> '' GROUP BY reason
            UNION ALL SELECT 'disposition', disposition, count(*), {big('sum(quantity)')} FROM r
              WHERE disposition <> '' GROUP BY disposition
            UNION ALL SELECT 'gender', gender, count(*), {big('sum(quantity)')} FROM r WHERE gender <> '' GROUP BY gender
            UNION ALL (SELECT 'brand', brand, count(*) AS n, {big('sum(quantity)')} FROM r
              WHERE brand <> '' AND brand <> '-' GROUP BY brand ORDER BY n DESC, brand LIMIT 20)"""


def _rollup_values() -> str:
    filters = " UNION ALL ".join(
        f"SELECT DISTINCT 'filter {c}', {c}, NULL, NULL, NULL FROM r WHERE {c} NOT IN ('', {placeholder})"
        for c, placeholder in (("reason", "''"), ("disposition", "''"), ("brand", "'-'"))
    )
    return f"""WITH {UPSERT_CTE.replace('r AS (SELECT * FROM any_r', 'sent AS (SELECT * FROM any_r').replace('FROM r\n', 'FROM sent\n').replace('FROM r ', 'FROM sent ')},
      r AS (SELECT * FROM imported WHERE disposition <> '')
      SELECT dimension, value, records, units, CAST(NULL AS VARCHAR) AS earliest FROM ({BREAKDOWNS})
      UNION ALL {filters}
      UNION ALL SELECT 'filter return_month', return_month, NULL, NULL, min(return_date) FROM r
        WHERE return_month <> '' GROUP BY return_month"""


def _rollup_page() -> str:
    pages = [
        f"(SELECT {RETURN_COLUMNS.removeprefix('id, ')}, {n} AS page FROM imported "
        f"ORDER BY return_date DESC NULLS LAST, batch, id LIMIT 50 OFFSET {n * 50 - 50})"
        for n in (3, 40)
    ]
    return f"WITH {UPSERT_CTE} {pages[0]} UNION ALL {pages[1]}"


def _cleaned(select: str, ctes: str = "") -> str:
    return f"""WITH o AS (SELECT * REPLACE (CAST(item_price AS DECIMAL(18,2)) AS item_price) FROM ({_loaded(_ingest_orders())})
        WHERE amazon_order_id <> '' OR coalesce(purchase_date, '') <> '' OR order_status <> ''),
      r AS (SELECT * FROM ({_loaded(_ingest_returns())}) WHERE disposition <> '') {ctes} {select}"""


CARDS = f"""SELECT units AS order_units, revenue, return_records, return_units,
              {pct('return_units', 'units', 1, '0')} AS return_rate
            FROM (SELECT {big("sum(CASE WHEN order_status <> 'On Trial' THEN quantity ELSE 0 END)")} AS units,
                CAST(sum(CASE WHEN order_status = 'Shipped' THEN item_price ELSE 0 END) AS DOUBLE) AS revenue FROM o),
              (SELECT count(*) AS return_records, {big('sum(quantity)')} AS return_units FROM r)"""
WEEKS = f"""SELECT *, {pct('returns', 'shipped_orders')} AS return_rate,
            {high('returns', 'shipped_orders')} AS high_rate FROM weekly"""


def oracle_sql() -> dict[str, str]:
    keys = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    return {
        # --- sources and imports ------------------------------------------------
        "ingest_orders": _ingest_orders(),
        "ingest_returns": _ingest_returns(),
        "import_orders": f"""WITH {LOAD_CTE} SELECT count(*) FILTER (nth = 1) AS added,
            count(*) FILTER (nth > 1) AS skipped FROM loaded WHERE batch = 2""",
        "import_returns": f"WITH {UPSERT_CTE} SELECT action, count(*) AS n FROM acted WHERE batch = 2 GROUP BY action",
        "upload_history": f"""WITH {LOG_CTE}
            SELECT filename, file_hash, type, rows_added, rows_skipped, uploaded_on
            FROM entries ORDER BY uploaded_on DESC LIMIT 50""",
        "export_monthly": _both(MONTHLY_CTE, f"""SELECT month AS "Month", order_units AS "Shipped Orders",
            order_units AS "Units Sold", printf('%.2f', revenue) AS "Revenue", cancelled AS "Cancelled",
            return_units AS "Returns", return_units AS "Return Units",
            {pct_text('return_units', 'order_units')} AS "Return Rate" FROM monthly"""),
        "export_weekly": _both(WEEKLY_CTE, f"""SELECT year AS "Year", week AS "Week", week_start AS "Week Start",
            shipped_orders AS "Shipped Orders", units AS "Units", printf('%.2f', revenue) AS "Revenue",
            returns AS "Returns", {pct_text('returns', 'shipped_orders')} AS "Return Rate"
            FROM weekly WHERE year = '1998'"""),
        "export_returns": _r("""SELECT return_date AS "Return Date", purchase_month AS "Purchase Month",
            product_name AS "Product", brand AS "Brand", reason AS "Reason", disposition AS "Disposition",
            gender AS "Gender", quantity AS "Qty", customer_comments AS "Customer Comment",
            order_id AS "Order ID", asin AS "ASIN" FROM r WHERE reason = 'TOO_SMALL'"""),
        # --- scalars ----------------------------------------------------------------
        "parse_num": f"SELECT {keys}, cell, {parse_num('cell')} AS number FROM ({NUMBER_CELLS})",
        "parse_date_text": f"SELECT {keys}, cell, {date_text('cell')} AS parsed FROM ({DATE_CELLS})",
        "parse_date_serial": f"""SELECT {keys}, CAST(serial AS DOUBLE) AS serial,
            {serial_text('serial')} AS parsed FROM ({SERIALS})""",
        "week_number": f"SELECT {keys}, cell, {week('cell')} AS week FROM ({DATE_CELLS})",
        "row_hash": f"""SELECT {keys}, md5(l_orderkey || '|' || coalesce(cell, '') || '|' || l_linenumber) AS row_hash
            FROM ({DATE_CELLS})""",
        "js_number_text": rf"""SELECT {keys}, regexp_replace(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR),
            '\.?0+$', '') AS price, regexp_replace(printf('%.2f', l_quantity), '\.?0+$', '') AS quantity FROM lineitem""",
        "first_nonblank": f"""SELECT {keys}, {trim("CASE WHEN cell <> '' THEN cell WHEN l_linenumber % 2 = 0 "
            "THEN ' ' ELSE l_returnflag END")} AS picked FROM ({DATE_CELLS})""",
        "derive_return_month": f"""SELECT {keys}, coalesce(CASE WHEN l_linenumber = 1 THEN 'Feb' END,
            strftime({iso(trim('cell'))}, '%B %Y'), '') AS return_month FROM ({DATE_CELLS})""",
        "derive_return_year": f"""SELECT {keys}, coalesce(CASE WHEN l_linenumber = 1 THEN '1999' END,
            strftime({iso(trim('cell'))}, '%Y'), '') AS return_year FROM ({DATE_CELLS})""",
        "default_quantity": f"""SELECT *, CAST(round(of_order) AS BIGINT) AS order_units,
            CAST(round(of_return) AS BIGINT) AS return_units FROM (
              SELECT {keys}, coalesce({parse_num('cell')}, 0) AS of_order,
                CASE WHEN coalesce({parse_num('cell')}, 0) = 0 THEN 1 ELSE {parse_num('cell')} END AS of_return
              FROM ({NUMBER_CELLS}))""",
        "year_month": f"SELECT {keys}, {ym('cell')} AS ym FROM ({DATE_CELLS})",
        "year_text": f"SELECT {keys}, {yr('cell')} AS year FROM ({DATE_CELLS})",
        "current_ym": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym FROM orders",
        "safe_ratio_pct": f"""SELECT o_orderkey, {pct('l_sum', 'o_cnt', 2)} AS pct,
            {pct('l_sum', 'o_cnt', 1, '0')} AS pct_or_zero FROM (
              SELECT l_orderkey AS o_orderkey, {big("sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)")} AS l_sum,
                {big("sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END)")} AS o_cnt
              FROM lineitem GROUP BY l_orderkey)""",
        "high_rate_flag": f"""SELECT o_orderkey, {high('l_sum', 'o_cnt')} AS high FROM (
              SELECT l_orderkey AS o_orderkey, {big("sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)")} AS l_sum,
                {big("sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END)")} AS o_cnt
              FROM lineitem GROUP BY l_orderkey)""",
        "label_underscores": _r("SELECT id, replace(reason, '_', ' ') AS label FROM r"),
        "label_disposition": r"""WITH words AS (SELECT p_partkey,
              string_split(replace(p_type || '_' || p_name || '_' || lower(p_brand), '_', ' '), ' ') AS w FROM part)
            SELECT p_partkey, array_to_string([upper(x[1:1]) || x[2:] for x in w], ' ') AS label FROM words""",
        "label_month": _both(MONTHLY_CTE, """SELECT month,
            coalesce(strftime(CAST(month || '-01' AS DATE), '%b ''%y'), '') AS label FROM monthly"""),
        "money_label": "SELECT o_orderkey, '$' || format('{:,.2f}', CAST(o_totalprice AS DOUBLE)) AS total, "
            "format('{:,}', o_custkey) AS customer FROM orders",
        "page_count": _r("""SELECT brand, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM r GROUP BY brand"""),
        # --- filters ------------------------------------------------------------------
        "nonblank_filter": _r("SELECT id, reason FROM r WHERE reason <> '' AND reason IS NOT NULL"),
        "status_filter": _o("SELECT id, order_status, quantity FROM o WHERE order_status <> 'On Trial'"),
        "month_membership": _both(PERIOD_CTE, """SELECT id, purchase_ym FROM o
            WHERE purchase_ym IN (SELECT month FROM ranked WHERE month_rank <= 12)"""),
        "placeholder_filter": _r("SELECT id, brand FROM r WHERE brand <> '' AND brand <> '-'"),
        "unsellable_filter": _r("SELECT id, disposition FROM r WHERE disposition <> '' AND disposition <> 'SELLABLE'"),
        "search_returns": _r(" UNION ALL ".join(
            f"SELECT {i} AS part, {RETURN_COLUMNS} FROM r WHERE {where}" for i, where in enumerate(SEARCHES))),
        "filtered_count": _r(" UNION ALL ".join(
            f"SELECT {i} AS part, count(*) AS total FROM r WHERE {where}" for i, where in enumerate(SEARCHES))),
        "all_orders": _o(f"SELECT {ORDER_COLUMNS} FROM o"),
        "all_returns": _r(f"SELECT {RETURN_COLUMNS} FROM r"),
        "cleanup_bad_orders": _o("""SELECT id, amazon_order_id, purchase_date, order_status FROM o
            WHERE NOT (coalesce(amazon_order_id, '') = '' AND coalesce(purchase_date, '') = ''
              AND coalesce(order_status, '') = '')"""),
        "cleanup_empty_disposition": _r("SELECT id, disposition FROM r WHERE NOT (disposition IS NULL OR disposition = '')"),
        # --- joins and aggregations ------------------------------------------------------
        "returns_by_purchase_month": _both("x AS (SELECT 1)", f"""
            SELECT purchase_ym AS month, r.disposition, {exact('sum(r.quantity)')} AS units, {exact('count(*)')} AS matches
            FROM {JOINED} GROUP BY purchase_ym, r.disposition"""),
        "order_stats": _o(f"""SELECT count(*) AS total,
            {big("sum(CASE WHEN order_status = 'Shipped' THEN 1 ELSE 0 END)")} AS shipped,
            {big("sum(CASE WHEN order_status = 'Cancelled' THEN 1 ELSE 0 END)")} AS cancelled,
            CAST(sum(CASE WHEN order_status = 'Shipped' THEN item_price ELSE 0 END) AS DOUBLE) AS revenue,
            {big("sum(CASE WHEN order_status <> 'On Trial' THEN quantity ELSE 0 END)")} AS units FROM o"""),
        "return_stats": _r(f"SELECT count(*) AS total, {big('sum(quantity)')} AS units FROM r"),
        "monthly_orders": _both(MONTHLY_CTE, "SELECT * FROM mo"),
        "monthly_returns": _both(MONTHLY_CTE, "SELECT * FROM mr"),
        "weekly_returns": _both(WEEKLY_CTE, "SELECT * FROM wr"),
        "weekly_orders": _both(WEEKLY_CTE, "SELECT * FROM wo"),
        "returns_by_reason": _r(f"SELECT reason, count(*) AS records, {big('sum(quantity)')} AS units FROM r WHERE reason <> '' GROUP BY reason"),
        "returns_by_disposition": _r("SELECT disposition, count(*) AS records FROM r WHERE disposition <> '' GROUP BY disposition"),
        "returns_by_brand": _r(f"""SELECT brand, count(*) AS records, {big('sum(quantity)')} AS units FROM r
            WHERE brand <> '' AND brand <> '-' GROUP BY brand ORDER BY records DESC, brand LIMIT 20"""),
        "returns_by_gender": _r("SELECT gender, count(*) AS records FROM r WHERE gender <> '' GROUP BY gender"),
        "returns_diagnostic": _r("""SELECT count(*) AS total,
            count(*) FILTER (order_id <> '' AND order_id IS NOT NULL) AS with_order_id,
            count(*) FILTER (order_id = '' OR order_id IS NULL) AS no_order_id,
            min(return_date) FILTER (return_date <> '') AS earliest,
            max(return_date) FILTER (return_date <> '') AS latest FROM r"""),
        "returns_by_year": _r("SELECT return_y AS year, count(*) AS records FROM r WHERE return_date <> '' GROUP BY return_y"),
        "maintenance_counts": f"""WITH {O_CTE}, {R_CTE},
            kept AS (
              SELECT 'cleanup_bad_orders' AS operation, count(*) AS rows_before, count(*) FILTER (NOT (
                  amazon_order_id = '' AND purchase_date = '' AND order_status = '')) AS rows_after FROM o
              UNION ALL
              SELECT 'cleanup_empty_disposition', count(*), count(*) FILTER (disposition <> '') FROM r
              UNION ALL
              SELECT 'dedup_orders', count(*), count(*) FILTER (rn = 1 OR NOT in_scope) FROM ({DEDUP_ORDERS})
              UNION ALL
              SELECT 'dedup_returns', count(*), count(*) FILTER (rn = 1 OR NOT in_scope)
              FROM ({_dedup_returns('(SELECT 1 AS batch, * FROM r)')}))
            SELECT *, rows_before - rows_after AS rows_deleted FROM kept""",
        "ingest_counts": f"""WITH {LOAD_CTE}, {UPSERT_CTE}
            SELECT 'orders' AS dataset, batch, CASE WHEN nth = 1 THEN 'added' ELSE 'skipped' END AS action,
              count(*) AS n FROM loaded GROUP BY ALL
            UNION ALL
            SELECT 'returns', batch, action, count(*) FROM acted GROUP BY ALL""",
        # --- windows ------------------------------------------------------------------------
        "dedup_orders": _o(f"SELECT {ORDER_COLUMNS} FROM ({DEDUP_ORDERS}) WHERE rn = 1 OR NOT in_scope"),
        "dedup_returns": _both(RESENT_RETURNS, f"""SELECT {RETURN_COLUMNS}
            FROM ({_dedup_returns('twice')}) WHERE rn = 1 OR NOT in_scope"""),
        "period_months": _both(PERIOD_CTE, "SELECT * FROM period_rows"),
        "first_by_hash": _both(RESENT_RETURNS, f"""SELECT {RETURN_COLUMNS} FROM (
            SELECT *, row_number() OVER (PARTITION BY row_hash ORDER BY batch, id) AS rn FROM twice) WHERE rn = 1"""),
        "blank_state": f"WITH {UPSERT_CTE} SELECT id, row_hash, still_blank, action FROM acted WHERE batch = 2",
        "recent_months": _both(MONTHLY_CTE, """SELECT month, order_units, return_units FROM monthly
            ORDER BY month DESC NULLS LAST LIMIT 18"""),
        # --- sorts and limits -----------------------------------------------------------------
        "returns_page": _r(f"SELECT {RETURN_COLUMNS} FROM r ORDER BY return_date DESC NULLS LAST, id LIMIT 50 OFFSET 100"),
        "returns_page_deep": _r(f"SELECT {RETURN_COLUMNS} FROM r ORDER BY return_date DESC NULLS LAST, id LIMIT 50 OFFSET 1500"),
        "top_reasons": _r("""SELECT reason, replace(reason, '_', ' ') AS label, count(*) AS records FROM r
            WHERE reason <> '' GROUP BY reason ORDER BY records DESC, reason LIMIT 10"""),
        "diagnostic_samples": _r("""(SELECT 'no_order_id' AS sample, order_id, asin, return_date, reason, disposition
              FROM r WHERE order_id = '' OR order_id IS NULL ORDER BY id LIMIT 3)
            UNION ALL
            (SELECT 'with_order_id', order_id, asin, return_date, reason, disposition
              FROM r WHERE order_id <> '' ORDER BY id LIMIT 3)"""),
        "unsellable_rank": _both(PERIOD_CTE, """SELECT disposition, units FROM p_disp WHERE months = 12"""),
        # --- sets ------------------------------------------------------------------------------
        "facet_values": _both(FACETS_CTE, "SELECT facet, value FROM facets WHERE facet IN ('reason', 'brand', 'disposition')"),
        "facet_months": _both(FACETS_CTE, "SELECT value, earliest FROM facets WHERE facet = 'return_month'"),
        "distinct_years": _both(WEEKLY_CTE, "SELECT DISTINCT year FROM weekly"),
        "period_disposition_names": _both(PERIOD_CTE, """SELECT disposition, CAST(list_no AS INTEGER) AS list_no, units FROM (
              SELECT disposition, CASE months WHEN 12 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS list_no, units FROM p_disp)
            QUALIFY row_number() OVER (PARTITION BY disposition ORDER BY list_no) = 1"""),
        # --- modification -----------------------------------------------------------------------
        "insert_ignore": f"WITH {LOAD_CTE} SELECT {ORDER_COLUMNS} FROM loaded WHERE batch = 2 AND nth = 1",
        "insert_ignore_batch": f"WITH {LOAD_CTE} SELECT {ORDER_COLUMNS} FROM loaded WHERE nth = 1",
        "upsert_disposition": f"WITH {UPSERT_CTE} SELECT {RETURN_COLUMNS} FROM imported",
        "stream_ingest": _r(f"""SELECT {RETURN_COLUMNS} FROM (
            SELECT *, row_number() OVER (PARTITION BY row_hash ORDER BY id) AS rn FROM r) WHERE rn = 1"""),
        # --- the way of a file: sheet, table, log -----------------------------------------------
        "load_orders": f"SELECT * EXCLUDE (id, rn) FROM ({_loaded(_ingest_orders())})",
        "load_returns": f"SELECT * EXCLUDE (id, rn) FROM ({_loaded(_ingest_returns())})",
        "stream_sheets": f"SELECT * EXCLUDE (id, rn) FROM ({_loaded(_ingest_returns())})",
        "load_log": _load_log(),
        "rollup_values": _rollup_values(),
        "rollup_page": _rollup_page(),
        "rollup_weeks": _cleaned(WEEKS, f", {WEEKLY_CTE.lstrip()}"),
        "rollup_cards": _cleaned(CARDS),
        "file_fingerprint": """WITH hashed AS (
            SELECT md5((row_number() OVER (ORDER BY o_orderkey) - 1) || ':' || o_orderkey || '|' ||
              strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderstatus) AS h FROM orders),
          summed AS (SELECT count(*) AS lines, sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) AS a,
            sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT)) AS b FROM hashed)
          SELECT lines, md5(lines || '|' || a || '|' || b) AS fingerprint FROM summed""",
        "load_payload": f"WITH {UPSERT_CTE} SELECT {RETURN_COLUMNS.removeprefix('id, ')} FROM imported",
        "maintain_tables": _maintained(),
        # --- reports --------------------------------------------------------------------------------
        "dashboard_cards": _both("x AS (SELECT 1)", f"""
            SELECT units AS order_units, revenue, return_records, return_units,
              {pct('return_units', 'units', 1, '0')} AS return_rate
            FROM (SELECT {big("sum(CASE WHEN order_status <> 'On Trial' THEN quantity ELSE 0 END)")} AS units,
                CAST(sum(CASE WHEN order_status = 'Shipped' THEN item_price ELSE 0 END) AS DOUBLE) AS revenue FROM o),
              (SELECT count(*) AS return_records, {big('sum(quantity)')} AS return_units FROM r)"""),
        "period_order_units": _both(PERIOD_CTE, "SELECT * FROM p_units"),
        "period_returns": _both(PERIOD_CTE, "SELECT * FROM p_returns"),
        "period_dispositions": _both(PERIOD_CTE, "SELECT * FROM p_disp"),
        "period_stats": _both(PERIOD_CTE, "SELECT * FROM p_stats"),
        "period_table": _both(PERIOD_CTE, _table_rows()),
        "monthly_summary": _both(MONTHLY_CTE, f"""SELECT *, {pct('return_units', 'order_units')} AS return_rate,
            {high('return_units', 'order_units')} AS high_rate FROM monthly"""),
        "weekly_summary": _both(WEEKLY_CTE, f"""SELECT *, {pct('returns', 'shipped_orders')} AS return_rate,
            {high('returns', 'shipped_orders')} AS high_rate FROM weekly"""),
        "weekly_for_year": _both(WEEKLY_CTE, f"""SELECT *, {pct('returns', 'shipped_orders')} AS return_rate,
            {high('returns', 'shipped_orders')} AS high_rate FROM weekly WHERE year = '1997'"""),
        "breakdowns": _r(f"""SELECT 'reason' AS dimension, reason AS value, count(*) AS records, {big('sum(quantity)')} AS units
              FROM r WHERE reason <> '' GROUP BY reason
            UNION ALL SELECT 'disposition', disposition, count(*), {big('sum(quantity)')} FROM r
              WHERE disposition <> '' GROUP BY disposition
            UNION ALL SELECT 'gender', gender, count(*), {big('sum(quantity)')} FROM r WHERE gender <> '' GROUP BY gender
            UNION ALL (SELECT 'brand', brand, count(*) AS n, {big('sum(quantity)')} FROM r
              WHERE brand <> '' AND brand <> '-' GROUP BY brand ORDER BY n DESC, brand LIMIT 20)"""),
        "returns_browser": _r(f"""SELECT *, CAST(ceil(total / 50.0) AS BIGINT) AS pages FROM (
            SELECT {RETURN_COLUMNS}, count(*) OVER () AS total FROM r WHERE {SEARCH}
            ORDER BY return_date DESC NULLS LAST, id LIMIT 50 OFFSET 50)"""),
        "filter_options": _both(FACETS_CTE, "SELECT * FROM facets"),
        "returns_audit": _r("""SELECT 'totals' AS part, 'total' AS item, count(*) AS records, NULL AS detail FROM r
            UNION ALL SELECT 'totals', 'with_order_id', count(*), NULL FROM r WHERE order_id <> ''
            UNION ALL SELECT 'totals', 'no_order_id', count(*), NULL FROM r WHERE coalesce(order_id, '') = ''
            UNION ALL SELECT 'dates', 'earliest', NULL, min(return_date) FROM r WHERE return_date <> ''
            UNION ALL SELECT 'dates', 'latest', NULL, max(return_date) FROM r WHERE return_date <> ''
            UNION ALL SELECT 'years', return_y, count(*), NULL FROM r WHERE return_date <> '' GROUP BY return_y
            UNION ALL (SELECT 'samples', 'no_order_id', NULL, concat_ws('|', coalesce(order_id, ''), asin, return_date,
              reason, coalesce(disposition, '')) FROM r WHERE order_id = '' OR order_id IS NULL ORDER BY id LIMIT 3)
            UNION ALL (SELECT 'samples', 'with_order_id', NULL, concat_ws('|', order_id, asin, return_date, reason,
              coalesce(disposition, '')) FROM r WHERE order_id <> '' ORDER BY id LIMIT 3)"""),
        "rate_series": _both(MONTHLY_CTE, f"""SELECT month,
            coalesce(strftime(CAST(month || '-01' AS DATE), '%b ''%y'), '') AS label, order_units, return_units,
            {pct('return_units', 'order_units', 2, '0')} AS return_rate
            FROM monthly ORDER BY month DESC NULLS LAST LIMIT 18"""),
    }
