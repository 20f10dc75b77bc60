"""The job-export contract: 36 source headers and their column names."""
from __future__ import annotations

from pyspark.sql import types as T

# Source header -> column name, in export order.
HEADER_MAP = {
    "Title": "job_id",
    "CustomerID": "customer_id",
    "Job Status": "job_status",
    "SalesIn": "sales_in",
    "Year": "year",
    "Month": "month",
    "Week No": "week_no",
    "SalesOut": "sales_out",
    "Quantity": "quantity",
    "Sell Price": "sell_price",
    "Mup%": "markup_pct",
    "VA Amount": "va_amount",
    "VA/24": "va_per_24",
    "VA%": "va_pct",
    "VA/K": "va_per_k",
    "Rebate": "rebate",
    "Puchases": "purchases",
    "Press hrs": "press_hrs",
    "Impressions": "impressions",
    "Handling": "handling",
    "Labour": "labour",
    "Paper": "paper",
    "labmup": "labour_markup",
    "manadj": "manual_adjustment",
    "mupnett": "markup_net",
    "Plates": "plates",
    "AmtInv": "amount_invoiced",
    "Customer Name": "customer_name",
    "Rep": "rep",
    "Region": "region",
    "Industry": "industry",
    "Work Type": "work_type",
    "Product Type": "product_type",
    "Binding Type": "binding_type",
    "Currency": "currency",
    "Ship date": "ship_date",
}

# Numeric, date and native-currency money columns.
NUMERIC_COLUMNS = [
    "quantity", "sell_price", "markup_pct", "va_amount", "va_per_24", "va_pct",
    "va_per_k", "rebate", "purchases", "press_hrs", "impressions", "handling",
    "labour", "paper", "labour_markup", "manual_adjustment", "markup_net",
    "plates", "amount_invoiced", "year", "month", "week_no",
]
DATE_COLUMNS = ["sales_in", "sales_out", "ship_date"]
MONEY_COLUMNS = [
    "sell_price", "va_amount", "purchases", "manual_adjustment", "paper",
    "labour", "handling", "markup_net", "amount_invoiced", "rebate",
    "va_per_24", "va_per_k",
]

# Persisted column order.
JOBS_COLUMNS = [
    "job_id", "customer_id", "customer_name", "job_status",
    "sales_in", "year", "month", "week_no", "sales_out",
    "quantity", "sell_price", "markup_pct", "va_amount", "va_per_24",
    "va_pct", "va_per_k", "rebate", "purchases", "press_hrs",
    "impressions", "handling", "labour", "paper", "labour_markup",
    "manual_adjustment", "markup_net", "plates", "amount_invoiced",
    "rep", "region", "industry", "work_type", "product_type",
    "binding_type", "currency", "ship_date",
]


def _type(name: str) -> T.DataType:
    if name in NUMERIC_COLUMNS:
        return T.DoubleType()
    if name in DATE_COLUMNS:
        return T.DateType()
    return T.StringType()


# Raw exports are read as text and coerced, so bad cells never fail a read.
JOBS_RAW_SCHEMA = T.StructType([T.StructField(h, T.StringType()) for h in HEADER_MAP])
JOBS_SCHEMA = T.StructType([T.StructField(c, _type(c)) for c in JOBS_COLUMNS])
