"""Thresholds and fixed values that drive every analysis.

One dataclass carries them all, so the published settings and the ones the
marts use cannot drift apart.
"""
from __future__ import annotations

from dataclasses import asdict, dataclass, field


# Fixed values that must equal the reference behaviour (FX planning rates,
# classification cut-offs, limits). Kept together and in natural order.
@dataclass(frozen=True)
class Config:
    base_currency: str = "GBP"
    base_currency_symbol: str = "£"
    # Rate per currency label; anything not listed converts at 1.0.
    fx_rates: dict = field(default_factory=lambda: {"Stg": 1.0, "Euro": 0.86})

    # churn, scored against each customer's own cadence
    at_risk_multiple: float = 1.25
    dormant_multiple: float = 2.5
    fallback_at_risk_days: int = 120
    fallback_dormant_days: int = 270
    min_orders_for_cadence: int = 3

    # reorder forecast
    min_orders_for_prediction: int = 3
    regular_cv: float = 0.4
    variable_cv: float = 0.9
    due_soon_days: int = 14
    forecast_horizon_days: int = 30
    overdue_floor_days: int = -10_000
    recent_orders: int = 3

    # pricing and margins
    low_margin_va_pct: float = 0.25
    underpriced_threshold_pct: float = 0.20

    # repeat work
    min_reprint_cycle_days: float = 30.0

    # delivery
    max_plausible_lead_days: int = 180
    min_product_jobs: int = 20
    trend_recent_months: int = 6
    trend_direction_days: float = 0.5

    # concentration shape
    near_tie_pct: float = 0.12
    flat_drop_pct: float = 0.08
    max_ranks_considered: int = 10

    # seasonality
    forecast_horizon_months: int = 6
    min_months_for_forecast: int = 14
    backtest_months: int = 6
    growth_floor: float = 0.5
    growth_cap: float = 2.0

    # price benchmark
    min_priced_jobs: int = 200
    holdout_buckets: int = 4  # one bucket of four is held out: a 75/25 split
    gbt_max_iter: int = 400
    gbt_max_depth: int = 5  # 32 leaves; the reference has 31
    gbt_step_size: float = 0.06
    gbt_max_bins: int = 255
    code_prior: float = 20.0  # jobs that draw a category's mean price to that of all
    seed: int = 42

    # list lengths
    top_customers: int = 20
    top_products: int = 10
    top_titles: int = 20
    top_repeat_products: int = 8
    top_pricing: int = 12
    top_peak_industries: int = 6
    top_slowest_jobs: int = 15
    top_flagged_jobs: int = 20
    top_findings: int = 5

    # findings
    min_years: float = 0.25
    days_per_year: float = 365.25

    def as_rows(self, spark):
        """Published thresholds as a (name, value) table."""
        rows = [(k, str(v)) for k, v in asdict(self).items()]
        return spark.createDataFrame(rows, "name string, value string")


DEFAULT = Config()
