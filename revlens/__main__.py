"""Job entry point: build the outputs and write them as parquet.

  python -m revlens --sf-dir /data/tables --out /shared/out [--names a,b]
  python -m revlens --feeds invoice=/in/inv.csv,domain=/in/dom.csv,hosting=/in/host.csv,\
hostingaddon=/in/addon.csv,ticket=/in/tickets.csv [--finance /in/finance.csv] --out /shared/out

With ``spark-submit`` the cluster's session settings apply (no master is set
here); ``spark.checkpoint.dir`` must name shared storage.
"""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import SparkSession

from revlens.plans.catalog import CsvFeeds, Feeds, query_names
from revlens.plans.params import Params
from revlens.plans.report import run_report
from revlens.session import build_session, ensure_checkpoint_dir


def _parse(argv=None) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="revlens", description=__doc__,
                                 formatter_class=argparse.RawDescriptionHelpFormatter)
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--sf-dir", help="directory of the driver parquet tables")
    src.add_argument("--feeds", help="comma-separated feed=path pairs for the five billing exports")
    ap.add_argument("--finance", help="wide finance sheet (CSV) for the finance outputs")
    ap.add_argument("--format", default="csv", help="feed file format (csv or parquet)")
    ap.add_argument("--out", required=True, help="output directory (one parquet table per output)")
    ap.add_argument("--names", help="comma-separated output names (default: all available)")
    ap.add_argument("--as-of", help="reference time, e.g. 2024-01-31T12:00:00 (default: params)")
    ap.add_argument("--store", help="folder of cleaned feeds kept for later runs with unchanged files")
    ap.add_argument("--checkpoint-dir", help="scratch folder of a local run; a cluster sets spark.checkpoint.dir")
    ap.add_argument("--master", help="Spark master for local runs (omit under spark-submit)")
    return ap.parse_args(argv)


def main(argv=None, spark: SparkSession | None = None) -> list[str]:
    args = _parse(argv)
    params = Params(as_of=datetime.fromisoformat(args.as_of)) if args.as_of else Params()
    spark = spark or build_session(args.master)
    ensure_checkpoint_dir(spark, args.checkpoint_dir)
    if args.sf_dir:
        feeds = Feeds(spark, args.sf_dir, params)
    else:
        paths = dict(kv.split("=", 1) for kv in args.feeds.split(","))
        feeds = CsvFeeds(spark, paths, args.finance, params, fmt=args.format)
    names = args.names.split(",") if args.names else None
    if names is None and isinstance(feeds, CsvFeeds) and not args.finance:
        names = [n for n in query_names() if not n.startswith("finance_")]
    return run_report(feeds, args.out, names, store=args.store)


if __name__ == "__main__":
    for name in main():
        print(name)
