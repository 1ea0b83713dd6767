"""Production runner: build every output over one set of feeds and write it.

Running the ~50 outputs as independent queries would recompute the cleaned
feeds (for the driver tables: the lineitem ⋈ orders join) for each of them.
The runner instead writes the shared intermediates once as Parquet below the
shared folder the cluster names in ``spark.checkpoint.dir`` and reads them
back: that cuts their lineage, so a lost executor never forces a recomputation
back to the source files, and every output reads only the columns and row
groups it needs.

With a ``store`` folder the cleaned feeds outlive the run: a later run whose
sources and settings are the same reads them instead of cleaning again.

Tables of one row per product and customer are stored in buckets by customer, so
the customer joins of all outputs read them without another shuffle.  Raw rows
are never bucketed: a customer may hold a large share of them.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from revlens.operators import clean
from revlens.operators.services import with_final_status
from revlens.plans.catalog import Feeds, run_on_feeds
from revlens.plans.table_store import TableStore
from revlens.session import ensure_checkpoint_dir
from revlens.sources.feeds import write_result


class MaterializedFeeds(Feeds):
    """Feeds whose cleaned tables are written once and then shared.  The cost
    columns are a projection of the written services."""

    def __init__(self, base: Feeds, store: TableStore | None = None):
        super().__init__(base.spark, base.sf_dir, base.p)
        self._base, self._store = base, store
        self._done: dict[str, DataFrame] = {}
        self._seen: dict[str, Observation] = {}
        self._counts: dict[str, dict[str, int]] = {}      # of tables that an earlier run stored
        self._tables: list[str] = []
        self._run = uuid.uuid4().hex
        self._folder = f"{ensure_checkpoint_dir(base.spark).rstrip('/')}/report-{self._run}"

    def _materialize(self, name: str, build) -> DataFrame:
        """A feed's table, written once: in the store if there is one, else in this run's folder."""
        if name not in self._done:
            if self._store is not None:
                self._done[name] = self._store.read(self._stored(name, build))
            else:
                df, path = build(), f"{self._folder}/{name}"
                write_result(df, path)
                self._done[name] = self.spark.read.schema(df.schema).parquet(path)
        return self._done[name]

    def _stored(self, name: str, build) -> str:
        signature = self._store.signature(self._base.sources(name), self._base.settings(name))
        found = self._store.find(name, signature)
        if found is not None:
            self._counts[name] = dict(found["counts"] or {})
            return found["path"]

        def write(path: str) -> dict[str, int]:
            write_result(build(), path)
            return dict(self._seen[name].get) if name in self._seen else {}

        return self._store.add(name, signature, write)

    def _by_customer(self, name: str, build) -> DataFrame:
        """A table with few rows a customer, in buckets by ``userid``."""
        if name not in self._done:
            table = f"{name}_{self._run}"
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            (build().repartition(n, "userid").write.bucketBy(n, "userid").format("parquet")
             .option("path", f"{self._folder}/{name}").saveAsTable(table))
            self._tables.append(table)
            self._done[name] = self.spark.table(table)
        return self._done[name]

    def close(self) -> None:
        """Take the tables of this run out of the catalogue; their files stay."""
        while self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop()}")

    def _cleaned(self, name: str, raw: DataFrame) -> DataFrame:
        """The cleaned feed, with its rows counted by rule as it is written."""
        df, self._seen[name] = clean.clean_keys_observed(raw, name)
        return df

    def cleaning(self) -> list[tuple[str, str, int]]:
        """Feed, rule and rows of every feed used so far; ``rows`` came in,
        ``kept`` went out, the others are the rows that each rule dropped.  A feed
        that an earlier run stored has the counts of that run."""
        counts = {**self._counts, **{name: seen.get for name, seen in self._seen.items()}}
        return [(name, rule, n) for name, seen in counts.items() for rule, n in seen.items()]

    def invoices(self) -> DataFrame:
        return self._materialize("invoices", lambda: self._cleaned("invoices", self._base.raw_invoices()))

    def services(self) -> DataFrame:
        return self._materialize("services", lambda: with_final_status(
            self._cleaned("services", self._base.raw_services()), self.p.as_of))

    def raw_invoices(self) -> DataFrame:
        return self._base.raw_invoices()

    def raw_services(self) -> DataFrame:
        return self._base.raw_services()   # one reader

    def raw_tickets(self) -> DataFrame:
        return self._base.raw_tickets()

    def text_feeds(self) -> dict[str, DataFrame]:
        return self._base.text_feeds()

    def faulty_invoices(self) -> DataFrame:
        return self._base.faulty_invoices()

    def csv_invoices(self) -> DataFrame:
        return self._base.csv_invoices()

    def tickets(self) -> DataFrame:
        return self._materialize("tickets", lambda: self._cleaned("tickets", self._base.raw_tickets()))

    def finance(self, **source_filters) -> DataFrame:
        return self._materialize("finance", self._base.finance)

    def customers(self):
        return self._base.customers()

    def typed_feed(self, feed: str) -> DataFrame:
        return self._base.typed_feed(feed)

    # Derived tables are built from the materialized feeds, then materialized too.
    def service_stats(self) -> DataFrame:
        return self._by_customer("service_stats", super().service_stats)

    def user_costs(self) -> DataFrame:
        return self._by_customer("user_costs", super().user_costs)

    def invoice_12m(self) -> DataFrame:
        return self._by_customer("invoice_12m", super().invoice_12m)

    def invoice_revenue(self) -> DataFrame:
        return self._by_customer("invoice_revenue", super().invoice_revenue)

    def ticket_counts(self) -> DataFrame:
        return self._by_customer("ticket_counts", super().ticket_counts)


def run_report(feeds: Feeds, out_dir: str, names: list[str] | None = None,
               mode: str = "overwrite", parallel_jobs: int = 4, store: str | None = None) -> list[str]:
    """Write each named output (default: all) as parquet under ``out_dir``.

    The shared tables are written first (in this thread); the writes are
    then submitted as concurrent Spark jobs from ``parallel_jobs`` driver
    threads, so small outputs overlap their scheduling instead of queueing.
    Nothing but job handles passes through the driver.  How many rows each
    cleaning rule dropped is written as ``_cleaning`` (feed, rule, n_rows).
    ``store`` names a folder in which the cleaned feeds are kept for later runs."""
    shared = MaterializedFeeds(feeds, TableStore(feeds.spark, store) if store else None)
    try:
        return _write_outputs(shared, out_dir, names, mode, parallel_jobs)
    finally:
        shared.close()


def _write_outputs(shared: MaterializedFeeds, out_dir: str, names: list[str] | None, mode: str,
                   parallel_jobs: int) -> list[str]:
    outputs = run_on_feeds(shared, names)

    def write(item):
        name, df = item
        write_result(df, f"{out_dir.rstrip('/')}/{name}", mode)
        return name

    if parallel_jobs <= 1:
        done = [write(item) for item in outputs.items()]
    else:
        with ThreadPoolExecutor(max_workers=parallel_jobs) as pool:
            done = list(pool.map(write, outputs.items()))
    counts = shared.spark.createDataFrame(shared.cleaning(), "feed string, rule string, n_rows long")
    write_result(counts.coalesce(1), f"{out_dir.rstrip('/')}/_cleaning", mode)
    return done


MANIFEST = "manifest"


def publish_report(feeds: Feeds, out_dir: str, names: list[str] | None = None, parallel_jobs: int = 4,
                   store: str | None = None) -> str:
    """A report that its readers see as a whole: all outputs go to a folder of
    their own, and one manifest row, written last, makes it the current one.  A
    run that dies half way leaves no row, so the former outputs stay current."""
    run = uuid.uuid4().hex
    out_dir = out_dir.rstrip("/")
    done = run_report(feeds, f"{out_dir}/run-{run}", names, "errorifexists", parallel_jobs, store)
    row = feeds.spark.createDataFrame([(run, done)], "run string, outputs array<string>")
    write_result(row.withColumn("published", F.current_timestamp()).coalesce(1), f"{out_dir}/{MANIFEST}", "append")
    return run


def read_published(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """Output ``name`` of the report published last."""
    out_dir = out_dir.rstrip("/")
    last = spark.read.parquet(f"{out_dir}/{MANIFEST}").orderBy(F.desc("published"), F.desc("run")).first()
    if name not in last["outputs"]:
        raise KeyError(f"the current report has no output {name!r}")
    return spark.read.parquet(f"{out_dir}/run-{last['run']}/{name}")
