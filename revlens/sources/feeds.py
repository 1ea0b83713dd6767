"""Generic feed readers and writers.

Billing exports arrive as CSV with a header.  Everything is read as text
(no inference: inference needs an extra pass over the data and is not stable
across files), missing-value tokens are turned into NULL, and each feed is then
projected leniently onto the columns the engine reads: a column the export
lacks becomes a typed NULL column instead of an error.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from revlens.functions.keys import KEY_TYPE, bound, exact_decimal, inexact, is_number, plain_number
from revlens.sources import csv_files

# The text tokens a lenient CSV reader treats as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Money of every text feed: four decimals, the scale of all exact sums downstream.
MONEY = "decimal(18,4)"

# Columns each feed contributes, with the type they are converted to after
# cleaning.  Keys stay text here; clean_keys coerces them.
FEED_COLUMNS = {
    "invoice": {"id": "string", "userid": "string", "date": "date", "status": "string",
                "total": MONEY},
    "domain": {"id": "string", "userid": "string", "nextinvoicedate": "date",
               "firstpaymentamount": MONEY, "recurringamount": MONEY,
               "status": "string"},
    "hosting": {"id": "string", "userid": "string", "nextinvoicedate": "date",
                "termination_date": "date", "firstpaymentamount": MONEY,
                "amount": MONEY, "billingcycle": "string", "domainstatus": "string"},
    "hostingaddon": {"id": "string", "userid": "string", "nextinvoicedate": "date",
                     "termination_date": "date", "firstpaymentamount": MONEY,
                     "recurring": MONEY, "billingcycle": "string", "status": "string"},
    "ticket": {"id": "string", "userid": "string"},
}

# Per-feed renames that bring the three service feeds to one schema.
FEED_RENAMES = {
    "hosting": {"amount": "recurringamount", "domainstatus": "status"},
    "hostingaddon": {"recurring": "recurringamount"},
}

KEYS = ("id", "userid")

FEED_PRODUCT = {"domain": "domain", "hosting": "hosting", "hostingaddon": "hostingaddons"}


def null_tokens(df: DataFrame) -> DataFrame:
    """Turn the missing-value tokens into NULL in every text column."""
    return df.select(*[
        F.when(~F.col(f"`{c}`").isin(MISSING_TOKENS), F.col(f"`{c}`")).alias(c)
        for c, t in df.dtypes if t == "string"
    ] + [F.col(f"`{c}`") for c, t in df.dtypes if t != "string"])


def lenient_project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Select ``columns`` in order; an absent column becomes NULL of the
    requested type.  Text columns are left as text for later typing."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f"`{c}`") if c in present else F.lit(None).cast("string")).alias(c)
        for c in columns
    ])


def parse_date(c: Column, on_bad_date: str = "raise") -> Column:
    """``yyyy-M-d`` text (single-digit month/day accepted) to a wall-clock
    timestamp.  ``on_bad_date='raise'`` fails the job like the reference,
    ``'null'`` maps unparseable text to NULL."""
    if on_bad_date == "null":
        return F.try_to_timestamp(c, F.lit("yyyy-M-d")).cast("timestamp_ntz")
    return F.to_timestamp_ntz(c, F.lit("yyyy-M-d"))


def parse_money(c: Column, what: str, on_bad_money: str = "raise") -> Column:
    """Money text to an exact decimal.  ``'raise'`` fails the job on text that
    is no number or does not fit exactly; ``'round'`` rounds to four places
    and maps text that is no number to NULL."""
    return c.try_cast(MONEY) if on_bad_money == "round" else exact_decimal(c, MONEY, what)


def _passed_on(df: DataFrame) -> list[Column]:
    """The place of a row in its file, where the reader gives it."""
    return [F.col(csv_files.ORDER)] if csv_files.ORDER in df.columns else []


def type_feed(df: DataFrame, feed: str, on_bad_date: str = "raise", on_bad_money: str = "raise") -> DataFrame:
    """Apply the feed's target types to a text projection."""
    out = []
    for c, t in FEED_COLUMNS[feed].items():
        col = F.col(c)
        if t == "date":
            col = parse_date(col, on_bad_date)
        elif t == MONEY:
            col = parse_money(col, f"{feed}.{c}", on_bad_money)
        out.append(col.alias(FEED_RENAMES.get(feed, {}).get(c, c)))
    return df.select(*out, *_passed_on(df))


def text_feed(raw: DataFrame, feed: str, on_bad_date: str = "raise", on_bad_money: str = "raise") -> DataFrame:
    """A feed from a table of text columns: missing tokens, lenient
    projection, target types."""
    return type_feed(_projected(raw, feed), feed, on_bad_date, on_bad_money)


def _projected(raw: DataFrame, feed: str) -> DataFrame:
    text = raw.select(*[F.col(f"`{c}`") for c in raw.columns if c in FEED_COLUMNS[feed]], *_passed_on(raw),
                      *[F.col(c) for c in (csv_files.FILE, csv_files.PROBLEM) if c in raw.columns])
    kept = [F.col(c) for c in text.columns if c not in FEED_COLUMNS[feed]]
    clean = null_tokens(text)
    return clean.select(*[(F.col(f"`{c}`") if c in clean.columns else F.lit(None).cast("string")).alias(c)
                          for c in FEED_COLUMNS[feed]], *kept)


FAULTS = "_faults"
_FAULT_TYPE = "array<struct<column: string, value: string, reason: string>>"


def _fault(column: str, value: Column, reason: str) -> Column:
    return F.struct(F.lit(column).alias("column"), value.alias("value"), F.lit(reason).alias("reason"))


def judged_feed(raw: DataFrame, feed: str) -> DataFrame:
    """A feed from a table of text columns with all faults of every row at
    once: its typed columns (NULL where the text is faulty) and ``_faults``, an
    array of column, text and reason.  A fault is a malformed record, a date
    that is none, money or a numeric key that the column's type does not hold
    exactly.  Text that is no number is no fault of a key: cleaning drops it."""
    df = _projected(raw, feed)
    out, faults = [], []
    for c, t in FEED_COLUMNS[feed].items():
        col, typed, wrong = F.col(c), F.col(c), None
        if t == "date":
            typed, reason = parse_date(col, "null"), "is no date (yyyy-M-d)"
            wrong = bound(col, lambda x: x.isNotNull() & parse_date(x, "null").isNull())
        elif t == MONEY:
            typed, reason = bound(col, lambda x: F.when(~inexact(x, x.try_cast(MONEY)), x.try_cast(MONEY))), f"does not fit {MONEY}"
            wrong = bound(col, lambda x: ~x.rlike(plain_number(MONEY)) & inexact(x, x.try_cast(MONEY)))
        elif c in KEYS:
            reason = f"does not fit {KEY_TYPE}"
            wrong = bound(F.trim(col), lambda x: ~x.rlike(plain_number(KEY_TYPE)) & is_number(x)
                          & inexact(x, x.try_cast(KEY_TYPE)))
        out.append(typed.alias(FEED_RENAMES.get(feed, {}).get(c, c)))
        if wrong is not None:
            faults.append(F.when(wrong, _fault(c, col, reason)))
    if csv_files.PROBLEM in df.columns:
        problem = F.col(csv_files.PROBLEM)
        faults.append(F.when(problem.isNotNull(), F.struct(
            F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value"), problem.alias("reason"))))
    file = [F.col(csv_files.FILE)] if csv_files.FILE in df.columns else []
    return df.select(*out, *_passed_on(df), *file, F.array_compact(F.array(*faults)).cast(_FAULT_TYPE).alias(FAULTS))


def sound_rows(judged: DataFrame) -> DataFrame:
    """The rows without a fault, as a typed feed."""
    sound = F.size(FAULTS) == 0
    # Spark may test later filters first: a faulty key must not reach its coercion.
    keys = {k: F.when(sound, F.col(k)) for k in KEYS}
    return judged.where(sound).withColumns(keys).drop(FAULTS, csv_files.FILE)


def rejects(judged: DataFrame) -> DataFrame:
    """One row per fault: the row's columns as they are, then ``column, value,
    reason``."""
    rest = [F.col(f"`{c}`") for c in judged.columns if c != FAULTS]
    return judged.where(F.size(FAULTS) > 0).select(*rest, F.inline(FAULTS))


def load_tolerant(spark: SparkSession, raw: DataFrame, feed: str, folder: str,
                  max_bad_share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The sound rows of a feed and its rejects, from one stored pass below
    ``folder``.  More faulty rows than ``max_bad_share`` of all is an error,
    which names the counts and where the rejects are."""
    seen = Observation(f"{feed} faults")
    path = f"{folder.rstrip('/')}/{feed}_judged"
    judged = judged_feed(raw, feed).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size(FAULTS) > 0).alias("bad"))
    judged.write.mode("overwrite").parquet(path)
    counts = seen.get
    if counts["bad"] > max_bad_share * counts["rows"]:
        raise ValueError(f"{counts['bad']} of {counts['rows']} rows of {feed} are faulty, {max_bad_share:.2%} are allowed; "
                         f"see {FAULTS} in {path}")
    stored = spark.read.parquet(path)
    return sound_rows(stored), rejects(stored)


def read_raw(spark: SparkSession, path: str, columns, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """The columns of an export as text.  CSV rows come with their place and
    what is wrong with them (``csv_files``)."""
    if fmt == "csv":
        return csv_files.read_rows(spark, path, columns, multi_line)
    raw = spark.read.format(fmt).load(path)
    return raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns])


def read_feed(spark: SparkSession, path: str, feed: str, fmt: str = "csv",
              on_bad_date: str = "raise", on_bad_money: str = "raise", multi_line: bool = False) -> DataFrame:
    """Read one billing export.  A missing path is an error (S2), and so
    is a malformed row.  Invoices of CSV files come with the place of each row,
    which D2/D3 order by; the other feeds have their own columns only."""
    if not path:
        raise FileNotFoundError(f"no path given for feed {feed!r}")
    raw = read_raw(spark, path, FEED_COLUMNS[feed], fmt, multi_line)
    typed = text_feed(csv_files.well_formed(raw) if fmt == "csv" else raw, feed, on_bad_date, on_bad_money)
    return typed if feed == "invoice" else typed.drop(csv_files.ORDER)


def load_feeds(spark: SparkSession, paths: dict[str, str], fmt: str = "csv",
               on_bad_date: str = "raise", on_bad_money: str = "raise",
               multi_line: bool = False) -> dict[str, DataFrame]:
    """All five feeds; every one of them is required."""
    missing = [f for f in FEED_COLUMNS if not paths.get(f)]
    if missing:
        raise FileNotFoundError(f"missing feed paths: {missing}")
    return {f: read_feed(spark, paths[f], f, fmt, on_bad_date, on_bad_money, multi_line) for f in FEED_COLUMNS}


SERVICE_COLUMNS = ["product", "id", "userid", "nextinvoicedate", "termination_date",
                   "firstpaymentamount", "recurringamount", "billingcycle", "status"]


def service_table(feeds: dict[str, DataFrame]) -> DataFrame:
    """The three service feeds, renamed to one schema and tagged with
    ``product``, as one table (columns a feed lacks are NULL)."""
    out = None
    for feed, product in FEED_PRODUCT.items():
        df = feeds[feed]
        cols = []
        for c in SERVICE_COLUMNS:
            if c == "product":
                cols.append(F.lit(product).alias(c))
            elif c in df.columns:
                cols.append(F.col(c))
            else:
                cols.append(F.lit(None).cast(_service_type(c)).alias(c))
        part = df.select(*cols)
        out = part if out is None else out.unionByName(part)
    return out


def _service_type(c: str) -> str:
    for feed in ("hosting", "hostingaddon", "domain"):
        for raw, t in FEED_COLUMNS[feed].items():
            if FEED_RENAMES.get(feed, {}).get(raw, raw) == c:
                return "timestamp_ntz" if t == "date" else t
    return "string"


FINANCE_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
                  "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def read_finance(spark: SparkSession, path: str, fmt: str = "csv", on_bad_money: str = "raise",
                 multi_line: bool = False) -> DataFrame:
    """S3: the wide finance sheet (Scenario, business_unit, Account, Year,
    Jan..Dec).  Months are money, kept as exact decimals.  A malformed row is an error."""
    cols = {"Scenario": "string", "business_unit": "string", "Account": "string", "Year": "int"}
    cols.update({m: MONEY for m in FINANCE_MONTHS})
    raw = read_raw(spark, path, cols, fmt, multi_line)
    raw = null_tokens(csv_files.well_formed(raw).drop(csv_files.ORDER) if fmt == "csv" else raw)
    projected = lenient_project(raw, cols)
    return projected.select(*[
        (F.col(c) if t == "string" else parse_money(F.col(c), c, on_bad_money) if t == MONEY
         else F.col(c).try_cast(t)).alias(c) for c, t in cols.items()
    ])


def write_result(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Persist a result table (the reference only showed them on screen)."""
    df.write.mode(mode).format(fmt).save(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
