"""The production runner materializes shared feeds as Parquet and
writes outputs that equal the lazily computed queries."""

import tempfile

from revlens.plans.catalog import Feeds, catalogue
from revlens.plans.report import run_report
from conftest import SF_SMALL


def test_run_report_writes_equal_outputs(spark):
    out = tempfile.mkdtemp(prefix="revlens-report-")
    names = ["profit_by_customer", "domain_rollup", "cohort_forecast", "finance_sales_by_unit",
             "user_cost_hosting", "customer_free_cost", "customer_revenue_summary", "kpis"]
    assert run_report(Feeds(spark, SF_SMALL), out, names) == names
    for n in names:
        written = spark.read.parquet(f"{out}/{n}")
        lazy = catalogue()[n](spark, SF_SMALL)
        assert sorted(map(tuple, written.collect()), key=repr) == sorted(map(tuple, lazy.collect()), key=repr)


def test_job_entry_point_on_driver_tables(spark):
    from revlens.__main__ import main
    out = tempfile.mkdtemp(prefix="revlens-job-")
    written = main(["--sf-dir", SF_SMALL, "--out", out, "--names", "kpis,tickets_by_user"], spark=spark)
    assert written == ["kpis", "tickets_by_user"]
    assert spark.read.parquet(f"{out}/kpis").count() == 1


def test_job_entry_point_on_csv_feeds(spark):
    import os
    from revlens.__main__ import main
    from test_csv_pipeline import FILES
    d = tempfile.mkdtemp(prefix="revlens-jobcsv-")
    pairs = []
    for name, text in FILES.items():
        path = os.path.join(d, f"{name}.csv")
        with open(path, "w") as fh:
            fh.write(text)
        pairs.append(f"{name}={path}")
    out = os.path.join(d, "out")
    written = main(["--feeds", ",".join(pairs), "--out", out, "--as-of", "2001-06-15T12:00:00",
                    "--names", "profit_by_customer,domain_rollup,annual_cohort"], spark=spark)
    assert written == ["profit_by_customer", "domain_rollup", "annual_cohort"]
    profit = {r.userid: r.revenue for r in spark.read.parquet(f"{out}/profit_by_customer").collect()}
    assert profit[1.0] == 116.0


def test_cleaning_counts_come_with_every_report(spark):
    from revlens.operators.clean import cleaning_counts
    out = tempfile.mkdtemp(prefix="revlens-report-")
    feeds = Feeds(spark, SF_SMALL)
    run_report(feeds, out, ["profit_by_customer", "domain_rollup"])
    got = {(r.feed, r.rule): r.n_rows for r in spark.read.parquet(f"{out}/_cleaning").collect()}
    assert {f for f, _ in got} == {"invoices", "tickets", "services"}
    for feed, raw in (("invoices", feeds.raw_invoices()), ("tickets", feeds.raw_tickets()), ("services", feeds.raw_services())):
        plain = {r.rule: r.n_rows for r in cleaning_counts(raw).collect()}
        assert {k: v for (f, k), v in got.items() if f == feed and v and k != "rows"} == plain
        assert got[feed, "rows"] == raw.count() == sum(plain.values())


def test_a_run_that_dies_leaves_the_published_report(spark, monkeypatch):
    import pytest
    from revlens.plans import report
    out = tempfile.mkdtemp(prefix="revlens-publish-")
    names = ["kpis", "tickets_by_user"]
    first = report.publish_report(Feeds(spark, SF_SMALL), out, names)
    before = report.read_published(spark, out, "tickets_by_user").collect()

    def dying(df, path, *args):
        if path.endswith("tickets_by_user"):
            raise RuntimeError("lost")
        return write(df, path, *args)

    write = report.write_result
    monkeypatch.setattr(report, "write_result", dying)
    with pytest.raises(RuntimeError, match="lost"):
        report.publish_report(Feeds(spark, "/root/testdata/sf0.01"), out, names)
    monkeypatch.undo()
    assert report.read_published(spark, out, "tickets_by_user").collect() == before
    second = report.publish_report(Feeds(spark, "/root/testdata/sf0.01"), out, names)
    assert second != first and report.read_published(spark, out, "tickets_by_user").count() != len(before)
    with pytest.raises(KeyError):
        report.read_published(spark, out, "domain_rollup")


def test_checkpoint_folder_without_the_setting(spark):
    """No setting: a local session has one folder for its life, a cluster is refused."""
    import pytest
    from revlens import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId, folder = "local[2]", "app-1", None

        def getConf(self):
            return Conf()

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        conf, sparkContext = Conf(), Context()

    s = Session()
    own = session.ensure_checkpoint_dir(s)
    assert session.ensure_checkpoint_dir(s) == own == s.sparkContext.folder
    assert session.ensure_checkpoint_dir(s, "/given") == "/given" == session.ensure_checkpoint_dir(s)
    s.sparkContext.master = "spark://host"
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(s)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
