"""The named query catalogue.  Each entry takes
``(spark, sf_dir)`` and returns a lazy DataFrame over the driver tables at
``sf_dir``; nothing is collected."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import expr as E
from revlens.operators import clean, cohort, customers, finance, forecast, invoices, services
from revlens.plans.params import DEFAULT, Params
from revlens.session import ensure_checkpoint_dir
from revlens.sources import feeds as feeds_mod
from revlens.sources import exports, tables
from revlens.sources.csv_files import ORDER


class Feeds:
    """Cleaned feeds of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = DEFAULT):
        self.spark, self.sf_dir, self.p = spark, sf_dir, params

    def sources(self, table: str) -> list[str]:
        """The files that a feed's table is made from."""
        read = {"invoices": ["orders"], "services": ["lineitem", "orders"], "tickets": ["events"],
                "finance": ["lineitem", "part"]}
        return [feeds_mod.table_path(self.sf_dir, t) for t in read[table]]

    def settings(self, table: str) -> dict:
        """All else that a feed's table depends on."""
        return {"feeds": type(self).__name__, **({"as_of": self.p.as_of.isoformat()} if table == "services" else {})}

    def invoices(self) -> DataFrame:
        return clean.clean_keys(tables.invoice_feed(self.spark, self.sf_dir))

    def services(self) -> DataFrame:
        """Cleaned services with ``final_status``."""
        s = clean.clean_keys(tables.service_feed(self.spark, self.sf_dir))
        return services.with_final_status(s, self.p.as_of)

    def tickets(self) -> DataFrame:
        return clean.clean_keys(tables.ticket_feed(self.spark, self.sf_dir))

    def finance(self, **source_filters) -> DataFrame:
        """The wide finance sheet; ``source_filters`` (years, accounts,
        scenarios, exclude_accounts) restrict the source scan and must be
        implied by the query's own filters."""
        return tables.finance_feed(self.spark, self.sf_dir, **source_filters)

    def customers(self) -> DataFrame | None:
        """Customer dimension for per-segment forecast series."""
        return tables.read_table(self.spark, self.sf_dir, "customer")

    def raw_invoices(self) -> DataFrame:
        return tables.invoice_feed(self.spark, self.sf_dir)

    def raw_services(self) -> DataFrame:
        return tables.service_feed(self.spark, self.sf_dir)

    def raw_tickets(self) -> DataFrame:
        return tables.ticket_feed(self.spark, self.sf_dir)

    def typed_feed(self, feed: str) -> DataFrame:
        """One billing export from its text to a cleaned,
        typed feed.  Here the export is the driver's table written as text."""
        raw = exports.EXPORTS[feed](self.spark, self.sf_dir)
        return clean.clean_keys(feeds_mod.text_feed(raw, feed))

    def text_feeds(self) -> dict[str, DataFrame]:
        """Typed feeds before cleaning, by name."""
        return {**{n: feeds_mod.text_feed(export(self.spark, self.sf_dir), n) for n, export in exports.EXPORTS.items()},
                "ticket": tables.ticket_feed(self.spark, self.sf_dir)}

    def faulty_invoices(self) -> DataFrame:
        """An invoice export as text, with faults in it."""
        return exports.faulty_invoice_export(self.spark, self.sf_dir)

    def csv_invoices(self) -> DataFrame:
        """The typed invoices of a folder of CSV files."""
        folder = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/invoice-csv-{uuid.uuid4().hex}"
        return feeds_mod.read_feed(self.spark, exports.write_invoice_csv(self.spark, self.sf_dir, folder), "invoice")

    # Derived tables shared by many outputs (materialized once by the report runner).
    def service_stats(self) -> DataFrame:
        """A1 rollup per (product, userid), money as exact decimals."""
        return services.service_stats(self.services(), self.p.as_of)

    def costed(self) -> DataFrame:
        """Service rows with E5–E9 cost columns."""
        return services.with_cost_columns(self.services(), self.p.as_of)

    def user_costs(self) -> DataFrame:
        """D1/W6 per (product, userid)."""
        return services.user_cost(self.costed())

    def invoice_12m(self) -> DataFrame:
        """D2 per customer, money as exact decimals."""
        return invoices.invoice_12m_by_user(self.invoices(), self.p.as_of, exact=True)

    def invoice_revenue(self) -> DataFrame:
        """D3 per customer, money as exact decimals."""
        return invoices.invoice_revenue_by_user(self.invoices(), exact=True)

    def ticket_counts(self) -> DataFrame:
        """W10/D4 per customer."""
        return invoices.tickets_by_user(self.tickets())

    def profits(self) -> DataFrame:
        """J7/E12 per customer, money as exact decimals."""
        return invoices.profit(self.invoice_revenue(), self.ticket_counts(), self.p.cost_per_ticket, exact=True)


class CsvFeeds(Feeds):
    """The reference's own inputs: five billing CSV exports (invoice, domain,
    hosting, hostingaddon, ticket) and optionally the wide finance sheet."""

    def __init__(self, spark: SparkSession, paths: dict[str, str], finance_path: str | None = None,
                 params: Params = DEFAULT, fmt: str = "csv", on_bad_date: str = "raise",
                 on_bad_money: str = "raise", multi_line: bool = False):
        super().__init__(spark, "", params)
        self._feeds = feeds_mod.load_feeds(spark, paths, fmt, on_bad_date, on_bad_money, multi_line)
        self._paths, self._multi_line = paths, multi_line
        self._finance_path, self._fmt, self._on_bad_money = finance_path, fmt, on_bad_money
        self._on_bad_date = on_bad_date

    def sources(self, table: str) -> list[str]:
        read = {"invoices": ["invoice"], "services": list(feeds_mod.FEED_PRODUCT), "tickets": ["ticket"]}
        if table == "finance":
            if not self._finance_path:
                raise FileNotFoundError("no finance sheet given")
            return [self._finance_path]
        return [self._paths[f] for f in read[table]]

    def settings(self, table: str) -> dict:
        """Which file is which feed, and how exports are read."""
        return {**super().settings(table), "paths": self._paths, "finance": self._finance_path, "fmt": self._fmt,
                "on_bad_date": self._on_bad_date, "on_bad_money": self._on_bad_money, "multi_line": self._multi_line}

    def invoices(self) -> DataFrame:
        return clean.clean_keys(self._feeds["invoice"])

    def raw_services(self) -> DataFrame:
        return feeds_mod.service_table(self._feeds)

    def services(self) -> DataFrame:
        return services.with_final_status(clean.clean_keys(self.raw_services()), self.p.as_of)

    def tickets(self) -> DataFrame:
        return clean.clean_keys(self._feeds["ticket"])

    def finance(self, **source_filters) -> DataFrame:
        if not self._finance_path:
            raise FileNotFoundError("no finance sheet given")
        return feeds_mod.read_finance(self.spark, self._finance_path, self._fmt, self._on_bad_money, self._multi_line)

    def customers(self) -> DataFrame | None:
        return None

    def typed_feed(self, feed: str) -> DataFrame:
        return clean.clean_keys(self._feeds[feed].drop(ORDER))

    def raw_invoices(self) -> DataFrame:
        return self._feeds["invoice"]

    def raw_tickets(self) -> DataFrame:
        return self._feeds["ticket"]

    def text_feeds(self) -> dict[str, DataFrame]:
        return dict(self._feeds)

    def faulty_invoices(self) -> DataFrame:
        return feeds_mod.read_raw(self.spark, self._paths["invoice"], feeds_mod.FEED_COLUMNS["invoice"], self._fmt,
                                  self._multi_line)

    def csv_invoices(self) -> DataFrame:
        return self._feeds["invoice"]


def run_on_feeds(feeds: Feeds, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Build the named outputs (default: all that a report has) over one set of feeds."""
    return {n: _REGISTRY[n](feeds) for n in (names or [n for n in _REGISTRY if n not in _CHECKS])}


Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Callable[[Feeds], DataFrame]] = {}
_CHECKS: set[str] = set()       # queries on the reading itself, not outputs of a report


def query(name: str, check: bool = False):
    def deco(fn):
        _REGISTRY[name] = fn
        if check:
            _CHECKS.add(name)
        return fn
    return deco


def query_names() -> list[str]:
    return list(_REGISTRY)


def catalogue(params: Params = DEFAULT) -> dict[str, Query]:
    return {name: (lambda spark, sf_dir, _fn=fn: _fn(Feeds(spark, sf_dir, params)))
            for name, fn in _REGISTRY.items()}


def _rows_for(df: DataFrame, product: str) -> DataFrame:
    return df.where(F.col("product") == product)


# ---------------------------------------------------------------- cleaning
@query("clean_keys_invoices")
def _q_clean_invoices(f: Feeds):
    return f.invoices().select("id", "userid", "date", "status",
                               F.col("total").cast("double").alias("total"))


@query("clean_keys_services")
def _q_clean_services(f: Feeds):
    return clean.clean_keys(f.raw_services()).select("product", "id", "userid", "nextinvoicedate")


def _typed(f: Feeds, feed: str, money: list[str]) -> DataFrame:
    df = f.typed_feed(feed)
    return df.select(*[(F.col(c).cast("string") if c in ("id", "userid") else
                        F.col(c).cast("double") if c in money else F.col(c)).alias(c) for c in df.columns])


@query("typed_invoices")
def _q_typed_invoices(f: Feeds):
    return _typed(f, "invoice", ["total"])


@query("typed_hosting")
def _q_typed_hosting(f: Feeds):
    return _typed(f, "hosting", ["firstpaymentamount", "recurringamount"])


@query("csv_invoices", check=True)
def _q_csv_invoices(f: Feeds):
    df = clean.clean_keys(f.csv_invoices())
    return df.select(F.col("id").cast("bigint").alias("id"), F.col("userid").cast("bigint").alias("userid"), "date", "status",
                     F.col("total").cast("double").alias("total"))


@query("cleaning_counts", check=True)
def _q_cleaning_counts(f: Feeds):
    out = None
    for name, df in f.text_feeds().items():
        part = clean.cleaning_counts(df).select(F.lit(name).alias("feed"), "rule", "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("invoice_rejects", check=True)
def _q_invoice_rejects(f: Feeds):
    found = feeds_mod.rejects(feeds_mod.judged_feed(f.faulty_invoices(), "invoice"))
    return found.select("id", "userid", "date", "status", F.col("total").cast("double").alias("total"), "column", "value", "reason")


@query("invoice_sound_rows", check=True)
def _q_invoice_sound(f: Feeds):
    df = clean.clean_keys(feeds_mod.sound_rows(feeds_mod.judged_feed(f.faulty_invoices(), "invoice")))
    return df.select(F.col("id").cast("bigint").alias("id"), F.col("userid").cast("bigint").alias("userid"), "date", "status",
                     F.col("total").cast("double").alias("total"))


@query("paid_invoices_only")
def _q_paid(f: Feeds):
    return clean.paid_only(f.invoices()).select(
        "id", "userid", "date", F.col("total").cast("double").alias("total"))


# ---------------------------------------------------------------- row level
def _status_rows(f: Feeds, product: str):
    return _rows_for(f.services(), product).select("id", "userid", "nextinvoicedate", "final_status")


@query("domain_status")
def _q_domain_status(f: Feeds):
    return _status_rows(f, "domain")


@query("hosting_status")
def _q_hosting_status(f: Feeds):
    return _status_rows(f, "hosting")


@query("addon_status")
def _q_addon_status(f: Feeds):
    return _status_rows(f, "hostingaddons")


def _with_stats(f: Feeds):
    return services.services_with_stats(f.services(), f.p.as_of, **f.p.skew)


def _with_payment(f: Feeds):
    """Rows with W1/E4 only (one salted lookup; the rollup lookup is not needed)."""
    return services.with_payment(f.services(), **f.p.skew)


@query("min_next_invoice")
def _q_min_next(f: Feeds):
    return _with_payment(f).select("product", "id", "userid", "nextinvoicedate", "min_next")


@query("service_payment")
def _q_payment(f: Feeds):
    return _with_payment(f).select("product", "id", "userid",
                                   F.col("payment").cast("double").alias("payment"))


def _costed(f: Feeds):
    return f.costed()


@query("lagging_cycles")
def _q_lagging(f: Feeds):
    return _costed(f).select("product", "id", "userid", "final_status",
                             E.round_half_even(F.col("lagging_cycles"), 6).alias("lagging_cycles"))


@query("cycle_rate")
def _q_cycle_rate(f: Feeds):
    return _costed(f).select("product", "id", "userid",
                             E.round_half_even(F.col("cycle_rate"), 4).alias("cycle_rate"))


@query("free_service_cost")
def _q_free_cost(f: Feeds):
    return _costed(f).select("product", "id", "userid",
                             E.round_half_even(F.col("free_service_cost"), 4).alias("free_service_cost"))


@query("trailing_12m_flag")
def _q_trailing(f: Feeds):
    return invoices.with_trailing_flag(f.invoices(), f.p.as_of).select("id", "userid", "date", "in_12m")


def _masked(f: Feeds):
    return services.masked_values(_with_stats(f), f.p.as_of)


@query("active_services")
def _q_active_rows(f: Feeds):
    return _masked(f).select("product", "id", "userid",
                             F.col("active_services_row").cast("bigint").alias("active_services"))


@query("future_revenue")
def _q_future_rows(f: Feeds):
    return _masked(f).select("product", "id", "userid",
                             F.col("future_revenue_row").cast("double").alias("future_revenue"))


@query("domain_revenue_rows")
def _q_domain_rev_rows(f: Feeds):
    return _rows_for(_masked(f), "domain").select(
        "id", "userid", F.col("revenue_row").cast("double").alias("revenue"))


@query("revenue_12m_rows")
def _q_rev12_rows(f: Feeds):
    return invoices.revenue_12m_rows(f.invoices(), f.p.as_of, **f.p.skew)


# ---------------------------------------------------------------- per customer
def _rollup(f: Feeds, product: str):
    return services.rollup_output(_rows_for(f.service_stats(), product)).drop("product")


@query("domain_rollup")
def _q_domain_rollup(f: Feeds):
    return _rollup(f, "domain")


@query("hosting_rollup")
def _q_hosting_rollup(f: Feeds):
    return _rollup(f, "hosting")


@query("addon_rollup")
def _q_addon_rollup(f: Feeds):
    return _rollup(f, "hostingaddons")


def _user_cost(f: Feeds, product: str):
    return _rows_for(f.user_costs(), product).drop("product")


@query("user_cost_domain")
def _q_uc_domain(f: Feeds):
    return _user_cost(f, "domain")


@query("user_cost_hosting")
def _q_uc_hosting(f: Feeds):
    return _user_cost(f, "hosting")


@query("user_cost_addon")
def _q_uc_addon(f: Feeds):
    return _user_cost(f, "hostingaddons")


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


@query("invoice_12m_by_user")
def _q_inv12(f: Feeds):
    return _doubles(f.invoice_12m(), "revenue_12m")


@query("invoice_revenue_by_user")
def _q_invrev(f: Feeds):
    return _doubles(f.invoice_revenue(), "revenue")


@query("tickets_by_user")
def _q_tickets(f: Feeds):
    return f.ticket_counts()


@query("profit_by_customer")
def _q_profit(f: Feeds):
    return invoices.profit(_doubles(f.invoice_revenue(), "revenue"), f.ticket_counts(), f.p.cost_per_ticket)


# ---------------------------------------------------------------- customer level
def _revenue_long(f: Feeds):
    return customers.product_revenue_long(f.service_stats())


def _user_costs(f: Feeds):
    return f.user_costs()


@query("product_costs_long")
def _q_costs_long(f: Feeds):
    return customers.product_costs_long(_user_costs(f))


@query("product_revenue_long")
def _q_revenue_long(f: Feeds):
    r = _revenue_long(f)
    return r.select("product", "userid", "final_status", "active_services",
                    *[F.col(c).cast("double").alias(c) for c in ["payment", "future_revenue", "revenue"]])


@query("customer_free_cost")
def _q_customer_free_cost(f: Feeds):
    return customers.customer_free_cost(_user_costs(f), _doubles(f.invoice_12m(), "revenue_12m"))


@query("customer_revenue_summary")
def _q_customer_revenue(f: Feeds):
    return customers.customer_revenue_summary(_revenue_long(f), f.invoice_revenue())


@query("customer_totals")
def _q_customer_totals(f: Feeds):
    return customers.customer_totals(_revenue_long(f))


@query("highest_revenue_per_customer")
def _q_highest(f: Feeds):
    return customers.highest_revenue_per_customer(f.service_stats())


@query("revenue_by_product_status")
def _q_rev_by_status(f: Feeds):
    return customers.revenue_by_product_status(_revenue_long(f))


@query("active_clients")
def _q_active_clients(f: Feeds):
    return customers.active_clients(_revenue_long(f))


def _annual_kpis(f: Feeds):
    """The two KPIs of A10 that need neither tickets nor profit."""
    return customers.annual_kpis(f.invoice_12m(), _costed(f))


def _kpis(f: Feeds):
    return customers.kpis(f.invoice_12m(),
                          _costed(f),
                          f.profits(),
                          f.p.cost_per_ticket)


@query("kpis")
def _q_kpis(f: Feeds):
    return _kpis(f)


@query("kpi_text")
def _q_kpi_text(f: Feeds):
    return customers.kpi_text(_kpis(f), customers.active_clients(_revenue_long(f)))


@query("annual_metric_table")
def _q_metric_table(f: Feeds):
    return customers.annual_metric_table(_annual_kpis(f))


@query("acquisition_cost")
def _q_acquisition(f: Feeds):
    return customers.acquisition_cost(_annual_kpis(f), f.p.acquisition_multiplier, f.p.operational_cost)


# ---------------------------------------------------------------- cohort
@query("user_year_pivot")
def _q_user_year_pivot(f: Feeds):
    return cohort.user_year_pivot(f.invoices(), f.p.years)


@query("signup_signoff")
def _q_signup(f: Feeds):
    return cohort.signup_signoff(f.invoices())


def _cohort(f: Feeds, rounded: bool = True):
    return cohort.annual_cohort(f.spark, f.invoices(), f.p.years, rounded=rounded)


for _name, _metric in [("subscribers_by_year", "subscribers"), ("additions_by_year", "additions"),
                       ("disengagement_by_year", "disengagement"), ("revenue_by_year", "revenue"),
                       ("arpu_by_year", "arpu")]:
    query(_name)(lambda f, _m=_metric: cohort.metric_by_year(_cohort(f, rounded=False), _m).orderBy("year"))


@query("annual_cohort")
def _q_annual_cohort(f: Feeds):
    return _cohort(f).orderBy("year")


@query("lagged_subscribers")
def _q_lagged(f: Feeds):
    return cohort.lagged_subscribers(_cohort(f)).orderBy("year")


@query("cohort_forecast")
def _q_cohort_forecast(f: Feeds):
    return cohort.cohort_forecast(_cohort(f)).orderBy("year")


@query("forecast_table_long")
def _q_forecast_long(f: Feeds):
    return cohort.forecast_table_long(cohort.cohort_forecast(_cohort(f))).orderBy("year", "metric")


@query("rate_bands")
def _q_rate_bands(f: Feeds):
    return cohort.rate_bands(cohort.cohort_forecast(_cohort(f))).orderBy("year")


# ---------------------------------------------------------------- forecast
def _train_years(f: Feeds):
    return [y for y in f.p.years if y < f.p.partial_year]


def _hw_fit(f: Feeds, zooms: int = 0):
    series = forecast.revenue_series(f.invoices(), f.customers(), _train_years(f))
    return forecast.holt_winters(series, _train_years(f), f.p.hw_season, zooms)


def _hw_forecast(f: Feeds, rounded: bool = True):
    return forecast.hw_forecast(_hw_fit(f), max(_train_years(f)), f.p.hw_season, f.p.hw_horizon, rounded)


@query("hw_forecast")
def _q_hw_forecast(f: Feeds):
    return _hw_forecast(f)


@query("hw_fitted")
def _q_hw_fitted(f: Feeds):
    return forecast.hw_fitted(_hw_fit(f), _train_years(f))


@query("hw_fine_fit")
def _q_hw_fine_fit(f: Feeds):
    """Parameters and error of the zoomed fit of each series."""
    return _hw_fit(f, f.p.hw_zooms).select("series", "alpha", "beta", "gamma",
                                           E.round_half_even(F.col("state.sse"), 2).alias("sse"))


@query("hw_fine_forecast")
def _q_hw_fine_forecast(f: Feeds):
    return forecast.hw_forecast(_hw_fit(f, f.p.hw_zooms), max(_train_years(f)), f.p.hw_season, f.p.hw_horizon)


@query("growth_projection")
def _q_growth(f: Feeds):
    return forecast.growth_projection(_hw_forecast(f, rounded=False), f.p.growth_rate, f.p.churn_rate, f.p.projection_years)


# ---------------------------------------------------------------- finance
@query("finance_wide")
def _q_fin_wide(f: Feeds):
    """The wide finance sheet itself (the data preview of the original)."""
    fin = f.finance()
    return fin.select("Scenario", "business_unit", "Account", "Year",
                      *[F.col(m).cast("double").alias(m) for m in feeds_mod.FINANCE_MONTHS])


@query("finance_sales_by_unit")
def _q_fin_unit(f: Feeds):
    fin = f.finance(years=[f.p.finance_year], accounts=[f.p.finance_account])
    return finance.sales_by_unit(fin, f.p.finance_year, f.p.finance_account)


@query("finance_monthly_long")
def _q_fin_monthly(f: Feeds):
    fin = f.finance(years=[f.p.finance_year], accounts=[f.p.finance_account])
    return finance.monthly_long(fin, f.p.finance_year, f.p.finance_account, f.p.finance_unit)


@query("finance_yearly_by_account")
def _q_fin_yearly(f: Feeds):
    fin = f.finance(scenarios=[f.p.finance_scenario], exclude_accounts=[f.p.finance_account])
    return finance.yearly_by_account(fin, f.p.finance_scenario, f.p.finance_account)
