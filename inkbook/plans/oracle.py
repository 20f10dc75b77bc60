"""DuckDB SQL that states each query from its definition, for side-by-side
checks on the driver tables. Written from the business rules, not from the
Spark plans. Shared sub-results are named CTEs; each query pulls in only the
ones it needs."""
from __future__ import annotations

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}
RECURSIVE: set[str] = set()


def cte(name: str, sql: str, *deps: str, recursive: bool = False) -> None:
    CTES[name] = (sql, deps)
    if recursive:
        RECURSIVE.add(name)


def build(final: str, *deps: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for d in deps:
        visit(d)
    if not order:
        return final
    head = "WITH RECURSIVE " if RECURSIVE & set(order) else "WITH "
    return head + ",\n".join(f"{n} AS (\n{CTES[n][0]}\n)" for n in order) + "\n" + final


def R(expr: str, d: int = 2) -> str:
    # Through the shortest decimal string, as Spark converts doubles: a
    # direct double->decimal cast multiplies in floating point and can move
    # an exact half-cent tie for values above about 1e5.
    return f"CAST(round_even(TRY_CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,10)), {d}) AS DOUBLE)"


def M(expr: str) -> str:
    """Exact money sum (decimal); round it with R() before it becomes a double."""
    return f"sum(CAST({expr} AS DECIMAL(28,8)))"


def MD(expr: str) -> str:
    """Exact money sum, as a double (for unrounded outputs)."""
    return f"CAST({M(expr)} AS DOUBLE)"


def FIRST(c: str) -> str:
    return f"first({c} ORDER BY sales_in, job_id, {c}) FILTER (WHERE {c} IS NOT NULL)"


# --- jobs view over the driver tables (FIXTURES.md §2) ---------------------
cte("jobs", """
SELECT p.p_brand || ' ' || p.p_type AS job_id,
       CAST(c.c_custkey AS VARCHAR) AS customer_id,
       c.c_name AS customer_name,
       o.o_orderstatus AS job_status,
       CAST(o.o_orderdate AS DATE) AS sales_in,
       CAST(l.l_shipdate AS DATE) AS sales_out,
       CAST(l.l_shipdate AS DATE) AS ship_date,
       l.l_quantity AS quantity,
       l.l_extendedprice AS sell_price,
       l.l_extendedprice * (CAST(1 AS DOUBLE) - l.l_discount)
         - CAST(0.5 AS DOUBLE) * p.p_retailprice * l.l_quantity AS va_amount,
       l.l_extendedprice * (CAST(0.05 AS DOUBLE) - l.l_discount) AS manual_adjustment,
       l.l_extendedprice * l.l_tax AS purchases,
       CAST(0.3 AS DOUBLE) * p.p_retailprice * l.l_quantity AS paper,
       l.l_quantity * CAST(p.p_size AS DOUBLE) AS labour,
       CAST(0 AS DOUBLE) AS handling,
       l.l_quantity / CAST(10 AS DOUBLE) AS press_hrs,
       l.l_quantity * CAST(100 AS DOUBLE) AS impressions,
       CAST(p.p_size AS DOUBLE) AS plates,
       s.s_name AS rep,
       r.r_name AS region,
       c.c_mktsegment AS industry,
       p.p_type AS work_type,
       CASE WHEN l.l_orderkey % 97 = 0 THEN NULL
            WHEN l.l_linenumber % 5 = 0 THEN upper(p.p_name)
            WHEN l.l_linenumber % 7 = 0 THEN replace(p.p_name, ' ', '-')
            ELSE p.p_name END AS product_type,
       CASE r.r_name WHEN 'EUROPE' THEN 'Euro' WHEN 'AMERICA' THEN 'USD' ELSE 'Stg' END AS currency,
       concat_ws(':', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) AS row_key
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
""")

cte("jobs2", """
SELECT *, coalesce(va_amount / nullif(sell_price, 0), CAST(0 AS DOUBLE)) AS va_pct,
       trim(coalesce(product_type, 'Unspecified')) AS label_value
FROM jobs
""", "jobs")

cte("canon", """
SELECT lk, lv FROM (
  SELECT lk, lv, row_number() OVER (PARTITION BY lk ORDER BY n DESC, lv) AS rn
  FROM (SELECT regexp_replace(lower(label_value), '[^a-z0-9]', '', 'g') AS lk,
               label_value AS lv, count(*) AS n
        FROM jobs2 GROUP BY 1, 2) t) u
WHERE rn = 1
""", "jobs2")

cte("jd", """
SELECT j.*,
       coalesce(CASE j.currency WHEN 'Stg' THEN CAST(1.0 AS DOUBLE)
                                WHEN 'Euro' THEN CAST(0.86 AS DOUBLE) END, CAST(1.0 AS DOUBLE)) AS fx_rate,
       j.sell_price * fx_rate AS sell_price_base,
       j.va_amount * fx_rate AS va_amount_base,
       j.purchases * fx_rate AS purchases_base,
       j.manual_adjustment * fx_rate AS manual_adjustment_base,
       j.paper * fx_rate AS paper_base,
       j.labour * fx_rate AS labour_base,
       c.lv AS product_type_clean,
       CASE WHEN date_diff('day', j.sales_in, j.ship_date) BETWEEN 0 AND 180
            THEN date_diff('day', j.sales_in, j.ship_date) END AS lead_time_days,
       j.va_amount < 0 AS is_below_cost,
       j.va_pct < 0.25 AS is_low_margin,
       CAST(date_trunc('month', j.sales_in) AS DATE) AS month_start
FROM jobs2 j
JOIN canon c ON c.lk = regexp_replace(lower(j.label_value), '[^a-z0-9]', '', 'g')
""", "jobs2", "canon")

cte("asofd", "SELECT max(sales_in) AS as_of, min(sales_in) AS first_day FROM jd", "jd")

ORACLE: dict[str, str] = {}


def q(key: str, final: str, *deps: str) -> None:
    """Register a query; its result is also a CTE ``q_<key>`` for later marts."""
    ORACLE[key] = build(final, *deps)
    cte(f"q_{key}", final, *deps)
