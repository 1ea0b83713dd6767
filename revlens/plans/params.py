"""Query parameters.  The reference read these from widgets or hard-coded
them; here they are explicit and have the reference's defaults, with the
driver-data mapping of SURVEY §7.1 (cohort years 1995–2001, partial year 2001,
finance year 1997, business unit PROMO)."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from revlens.session import DEFAULT_AS_OF


@dataclass(frozen=True)
class Params:
    as_of: datetime = DEFAULT_AS_OF
    cost_per_ticket: float = 75.0
    acquisition_multiplier: float = 1.0
    operational_cost: float = 1.0
    years: tuple[int, ...] = tuple(range(1995, 2002))
    partial_year: int = 2001
    growth_rate: float = 0.1
    churn_rate: float = 0.05
    projection_years: int = 3
    hw_season: int = 2
    hw_horizon: int = 3
    hw_zooms: int = 2          # finer grids of hw_fine_fit and hw_fine_forecast
    finance_year: int = 1997
    finance_account: str = "Sales"
    finance_unit: str = "PROMO"
    finance_scenario: str = "Actuals"
    # KeySalting settings (rows_per_salt, max_hot, max_salts); defaults in operators/skew.py.
    skew: dict = field(default_factory=dict)


DEFAULT = Params()
