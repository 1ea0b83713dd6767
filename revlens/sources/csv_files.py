"""Strict reading of CSV feeds (S1, S3): by column name in every file, with
malformed rows found and the place of every row kept.

The files of a feed may list their columns in different orders and may lack or
add some.  The header of each file is read on its own (one row a file), files
with equal headers are read together by position, and the wanted columns are
taken by name.  Of columns that share a name the first counts.  A file of no
bytes is passed over (Spark does not list it); one without a header is an error.

A row with fewer fields than its header is filled with NULL; a row with more
fields, with a quote that does not close, or with text after a closing quote, is
malformed.  ``""`` inside quotes is one quote, a quote inside an unquoted field
stands for itself.

Lines are split before they are parsed, so a file is read by as many tasks as
it has blocks, and a line break inside quotes makes malformed rows, never wrong
ones.  ``multi_line`` reads such fields; a file is then one task's, and a quote
that is still open at the end of the file takes the rest as its value.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns that the reader adds.
PROBLEM, ORDER, FILE = "_problem", "input_order", "_file"
_RAW, _PLACE = "_raw_record", "_place"
# Place of a row: file number, start of its block in the file, row in the block,
# as one number, so that "first row" is the least of a fixed-width value.
ORDER_TYPE = "decimal(38,0)"
_BLOCK_UNIT, _FILE_UNIT = 10 ** 10, 10 ** 26
_ROW = (1 << 33) - 1                # row in the partition, of monotonically_increasing_id
_BROADCAST_FILES = 50_000           # about 10 MB of file names
# A quoted field, or one that does not begin with a quote; nothing is tried twice.
_FIELD = r'(?:"(?:[^"]++|"")*+"|[^",][^,]*+|)'
_RECORD = rf"^{_FIELD}(?:,{_FIELD})*+$"
_QUOTED = r'"(?:[^"]++|"")*+"'


def _options(multi_line: bool) -> dict[str, str]:
    return {"escape": '"', "multiLine": str(multi_line).lower(), "mode": "PERMISSIVE", "inferSchema": "false"}


def data_files(spark: SparkSession, path: str | Sequence[str]) -> list[tuple[str, str]]:
    """The files below ``path`` in order of their names, each with the name
    that Spark gives its rows (no content is read)."""
    listed = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path))
    return sorted(tuple(r) for r in listed.select("path", "_metadata.file_path").distinct().collect())


def headers(spark: SparkSession, files: Sequence[str], multi_line: bool, threads: int = 8) -> list[tuple[str, ...]]:
    """The header of each file, as it stands there: the first row of each, read by Spark."""
    def first(file: str) -> tuple[str, ...]:
        rows = spark.read.options(header="false", **_options(multi_line)).csv(_literal(file)).head(1)
        if not rows:
            raise ValueError(f"{file} has no header")
        return tuple("" if v is None else v for v in rows[0])

    with ThreadPoolExecutor(max_workers=threads) as pool:
        return list(pool.map(first, files))


def _literal(file: str) -> str:
    """The path with its pattern characters escaped."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", file)


def _problem(fields: Column, sound: Column, n_fields: int) -> Column:
    return F.when(~sound, F.lit("a quote is not closed, or text follows a closing quote")) \
        .when(fields > n_fields, F.concat(fields.cast("string"), F.lit(f" fields where the header has {n_fields}")))


def _commas(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))


def read_rows(spark: SparkSession, path: str | Sequence[str], columns: Iterable[str],
              multi_line: bool = False) -> DataFrame:
    """The wanted columns of every row as text (NULL where a file lacks one),
    with ``input_order``, ``_file`` and ``_problem`` (NULL when well-formed)."""
    wanted = list(columns)
    files = data_files(spark, path)
    if not files:
        raise FileNotFoundError(f"no files at {path}")
    groups: dict[tuple[str, ...], list[str]] = {}
    for (file, _), header in zip(files, headers(spark, [f for f, _ in files], multi_line)):
        groups.setdefault(header, []).append(file)
    out = None
    for header, members in groups.items():
        part = (_whole_records if multi_line else _lines)(spark, header, [_literal(f) for f in members], wanted)
        out = part if out is None else out.unionByName(part)
    number = F.lit(0).cast("long")
    if len(files) > 1:
        names = spark.createDataFrame([(name, i) for i, (_, name) in enumerate(files)], "`of` string, file_no long")
        out = out.join(F.broadcast(names) if len(files) <= _BROADCAST_FILES else names, F.col(FILE) == F.col("of"), "left")
        number = F.coalesce("file_no", F.raise_error(F.concat(F.lit("rows of a file that was not listed: "), F.col(FILE))))
    place = (number.cast(ORDER_TYPE) * F.lit(str(_FILE_UNIT)).cast(ORDER_TYPE) + F.col(_PLACE)).cast(ORDER_TYPE)
    return out.select(*wanted, place.alias(ORDER), FILE, PROBLEM)


def _placed() -> list[Column]:
    block = F.col("_metadata.file_block_start").cast(ORDER_TYPE) * F.lit(_BLOCK_UNIT).cast(ORDER_TYPE)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)).cast(ORDER_TYPE)
    return [(block + row).cast(ORDER_TYPE).alias(_PLACE), F.col("_metadata.file_path").alias(FILE)]


def _wanted(header: tuple[str, ...], wanted: list[str], field) -> list[Column]:
    at = {name: i for i, name in reversed(list(enumerate(header)))}
    return [(field(f"_c{at[c]}") if c in at else F.lit(None).cast("string")).alias(c) for c in wanted]


def _fields(header: tuple[str, ...]) -> str:
    return ", ".join(f"`_c{i}` string" for i in range(len(header)))


def _lines(spark: SparkSession, header: tuple[str, ...], files: list[str], wanted: list[str]) -> DataFrame:
    """Files of one header, line by line: each line is read as one field, so
    that it is there as it stands, and then parsed."""
    lines = (spark.read.schema(f"`{_RAW}` string").options(header="true", sep="\u0001", quote="", inferSchema="false")
             .csv(files).select(_RAW, *_placed()))
    raw = F.col(_RAW)
    quoted = F.contains(raw, F.lit('"'))
    sound = ~quoted | raw.rlike(_RECORD)
    fields = F.when(quoted, _commas(F.regexp_replace(raw, _QUOTED, ""))).otherwise(_commas(raw)) + 1
    parsed = lines.withColumn("_r", F.from_csv(raw, F.lit(_fields(header)), _options(False)))
    return parsed.select(*_wanted(header, wanted, lambda c: F.col("_r").getField(c)), _PLACE, FILE,
                         _problem(fields, sound, len(header)).alias(PROBLEM))


def _whole_records(spark: SparkSession, header: tuple[str, ...], files: list[str], wanted: list[str]) -> DataFrame:
    """Files of one header, each as a whole: fields may hold line breaks."""
    rows = spark.read.schema(f"{_fields(header)}, `{_RAW}` string").options(
        header="true", columnNameOfCorruptRecord=_RAW, **_options(True)).csv(files)
    without = F.regexp_replace(F.col(_RAW), _QUOTED, "")        # kept by Spark where the number of fields differs
    return rows.select(*_wanted(header, wanted, F.col), *_placed(),
                       _problem(_commas(without) + 1, F.coalesce(~F.contains(without, F.lit('"')), F.lit(True)),
                                len(header)).alias(PROBLEM))


def well_formed(rows: DataFrame) -> DataFrame:
    """The rows; a malformed one stops the job, with its file and what is
    wrong.  The test is a filter, so no pruning of columns can skip it."""
    error = F.raise_error(F.concat(F.col(FILE), F.lit(": "), F.col(PROBLEM))).cast("boolean")
    return rows.where(F.when(F.col(PROBLEM).isNull(), F.lit(True)).otherwise(error)).drop(PROBLEM, FILE)
