"""Cleaned feeds kept between report runs, and customer tables in buckets."""

import os
import re
import tempfile

import pytest

from conftest import SF_SMALL
from revlens.plans.catalog import CsvFeeds, Feeds, catalogue, run_on_feeds
from revlens.plans.params import Params
from revlens.plans.report import MaterializedFeeds, run_report
from revlens.plans.table_store import TableStore

NAMES = ["profit_by_customer", "domain_rollup"]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _tables(store):
    return sorted(d for d in os.listdir(store) if d != "manifest")


def _csv_folder():
    from test_csv_pipeline import FILES
    d = tempfile.mkdtemp(prefix="revlens-store-csv-")
    paths = {}
    for name, text in FILES.items():
        paths[name] = os.path.join(d, f"{name}.csv")
        with open(paths[name], "w") as fh:
            fh.write(text)
    return paths


def test_a_second_run_writes_no_feed_table(spark):
    store, out = tempfile.mkdtemp(prefix="revlens-store-"), tempfile.mkdtemp(prefix="revlens-report-")
    run_report(Feeds(spark, SF_SMALL), f"{out}/1", NAMES, store=store)
    first = _tables(store)
    assert [re.sub("-[0-9a-f]{32}$", "", t) for t in first] == ["invoices", "services", "tickets"]
    run_report(Feeds(spark, SF_SMALL), f"{out}/2", NAMES, store=store)
    assert _tables(store) == first
    for n in NAMES + ["_cleaning"]:       # the counts of cleaning come with a table that is used again
        assert _rows(spark.read.parquet(f"{out}/1/{n}")) == _rows(spark.read.parquet(f"{out}/2/{n}"))
    for n in NAMES:
        assert _rows(spark.read.parquet(f"{out}/2/{n}")) == _rows(catalogue()[n](spark, SF_SMALL))


def test_a_changed_file_or_setting_makes_only_its_own_tables_anew(spark):
    paths, store = _csv_folder(), tempfile.mkdtemp(prefix="revlens-store-")
    out = tempfile.mkdtemp(prefix="revlens-report-")

    def run(k, **kw):
        before = set(_tables(store))
        run_report(CsvFeeds(spark, paths, **kw), f"{out}/{k}", NAMES, store=store)
        return sorted(t.rsplit("-", 1)[0] for t in set(_tables(store)) - before)

    assert run(1) == ["invoices", "services", "tickets"]
    assert run(2) == []
    os.utime(paths["ticket"], (1, 1))
    assert run(3) == ["tickets"]
    later = Params(as_of=Params().as_of.replace(year=2002))
    assert run(4, params=later) == ["services"]
    assert run(5, on_bad_date="null") == ["invoices", "services", "tickets"]
    # Of each name the newest two stay.
    assert {t.rsplit("-", 1)[0]: sum(u.startswith(t.rsplit("-", 1)[0]) for u in _tables(store))
            for t in _tables(store)} == {"invoices": 2, "services": 2, "tickets": 2}


def test_a_run_that_dies_while_storing_is_not_read(spark):
    store = TableStore(spark, tempfile.mkdtemp(prefix="revlens-store-"))

    def dying(path):
        spark.range(3).write.parquet(path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.add("invoices", "s", dying)
    assert store.find("invoices", "s") is None

    def whole(path):
        spark.range(5).write.parquet(path)
        return {"rows": 5}

    path = store.add("invoices", "s", whole)
    found = store.find("invoices", "s")
    assert found["path"] == path and found["counts"] == {"rows": 5}
    assert store.read(path).count() == 5
    assert store.find("invoices", "t") is None and store.find("services", "s") is None
    store._remove(path)
    assert store.find("invoices", "s") is None      # a table that is gone is made again


def test_customer_joins_over_stored_tables_add_no_shuffle_of_them(spark):
    shared = MaterializedFeeds(Feeds(spark, SF_SMALL))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        outputs = run_on_feeds(shared, [
            "customer_free_cost", "customer_revenue_summary", "customer_totals", "highest_revenue_per_customer",
            "profit_by_customer", "invoice_12m_by_user", "invoice_revenue_by_user", "tickets_by_user",
            "product_costs_long", "product_revenue_long", "user_cost_domain", "domain_rollup", "hosting_rollup"])
        for name, df in outputs.items():
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, name
            assert _rows(df) == _rows(catalogue()[name](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        shared.close()
    assert not [t for t in spark.catalog.listTables() if t.name.endswith(shared._run)]
