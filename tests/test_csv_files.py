"""The strict CSV reader: names in every file, malformed rows, quotes, line
breaks, and the place of each row (D2, D3)."""

import collections
import csv
import io
import random
from datetime import datetime, timedelta

import pytest

from revlens.operators import clean, invoices
from revlens.sources import csv_files
from revlens.sources.feeds import (judged_feed, load_tolerant, read_feed, read_finance, read_raw, rejects, sound_rows,
                                   FEED_COLUMNS)

HEADER = "id,userid,date,status,total\n"


def _folder(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(tmp_path)


def _rows(df, *columns):
    return [tuple(r) for r in df.orderBy(csv_files.ORDER).select(*columns).collect()]


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    path = _folder(tmp_path, a="id,userid,date,status,total\n1,10,2001-1-1,Paid,1\n",
                   b="userid,id,total,extra,status\n20,2,5,zzz,Paid\n", c="id,id,userid\n3,99,30\n")
    got = _rows(read_feed(spark, path, "invoice"), "id", "userid", "status", "total")
    assert [(a, b, c, None if d is None else float(d)) for a, b, c, d in got] == \
        [("1", "10", "Paid", 1.0), ("2", "20", "Paid", 5.0), ("3", "30", None, None)]


@pytest.mark.parametrize("name", ["plain", "with space [1] {x} 100%", "ä"])
def test_names_of_files_are_no_patterns(spark, tmp_path, name):
    path = _folder(tmp_path, **{name: HEADER + "1,1,,Paid,1\n", "other": "userid,id\n2,2\n"})
    assert sorted(r.id for r in read_feed(spark, path, "invoice").collect()) == ["1", "2"]


@pytest.mark.parametrize("line", ["1,1,2001-1-1,Paid,1,6", "1,1,2001-1-1,Paid,1,", '1,1,2001-1-1,"Pa"id,1', '1,1,2001-1-1,"Paid,1'])
def test_malformed_row_stops_the_job_with_its_file(spark, tmp_path, line):
    path = _folder(tmp_path, good=HEADER + "1,1,2001-1-1,Paid,1\n", bad=HEADER + line + "\n")
    with pytest.raises(Exception, match="bad.csv"):
        read_feed(spark, path, "invoice").select("id").collect()
    with pytest.raises(Exception, match="bad.csv"):
        read_feed(spark, path, "invoice").count()


def test_short_rows_are_filled_and_quotes_read(spark, tmp_path):
    path = _folder(tmp_path, a=HEADER + '1,1,2001-1-1,"Pa ""x"", id",7\n2,2\n\n3,3,,5" pipe,1\n4,4,,"",\n')
    assert _rows(read_feed(spark, path, "invoice"), "id", "status") == [("1", 'Pa "x", id'), ("2", None), ("3", '5" pipe'), ("4", None)]


def test_line_breaks_in_quotes(spark, tmp_path):
    path = _folder(tmp_path, a=HEADER + '1,1,2001-1-1,"Pa\nid, ""q""",7\n2,2,,x,1\n')
    with pytest.raises(Exception, match="a quote is not closed"):
        read_feed(spark, path, "invoice").collect()
    assert _rows(read_feed(spark, path, "invoice", multi_line=True), "id", "status") == [("1", 'Pa\nid, "q"'), ("2", "x")]
    more = _folder(tmp_path, a=HEADER + "1,1,2001-1-1,Paid,7,8\n")
    with pytest.raises(Exception, match="6 fields where the header has 5"):
        read_feed(spark, more, "invoice", multi_line=True).collect()


def test_finance_sheet_is_read_as_strictly(spark, tmp_path):
    head = "Scenario,business_unit,Account,Year,Jan,Feb\n"
    path = _folder(tmp_path, a=head + "Actuals,X,Sales,2023,1.5,2\n", b="Feb,Jan,Year,Account,Scenario,business_unit\n4,3,2023,COGS,Budget,Y\n")
    got = sorted((r.Scenario, r.Account, r.Year, float(r.Jan), float(r.Feb)) for r in read_finance(spark, path).collect())
    assert got == [("Actuals", "Sales", 2023, 1.5, 2.0), ("Budget", "COGS", 2023, 3.0, 4.0)]
    with pytest.raises(Exception, match="7 fields where the header has 6"):
        read_finance(spark, _folder(tmp_path, a=head + "Actuals,X,Sales,2023,1,2,3\n")).collect()


@pytest.mark.parametrize("text", ["", "\n"])
def test_a_file_without_a_header_is_an_error(spark, tmp_path, text):
    with pytest.raises((ValueError, FileNotFoundError), match="no header|no files"):
        read_feed(spark, _folder(tmp_path, a=text), "ticket")


def test_random_records_equal_the_csv_module(spark, tmp_path):
    rnd = random.Random(5)
    pieces = ["", "a", '"', '""', ",", " ", "x y", "'", "é", "NA?", "\\", '\\"']
    rows = [["".join(rnd.choice(pieces) for _ in range(rnd.randrange(5))) for _ in range(3)] for _ in range(300)]
    rows = [[f"k{i}"] + r for i, r in enumerate(rows)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["k", "a", "b", "c"], *rows])
    got = _rows(csv_files.well_formed(csv_files.read_rows(spark, _folder(tmp_path, a=out.getvalue()), ["k", "a", "b", "c"])),
                "k", "a", "b", "c")
    assert [tuple(v or "" for v in r) for r in got] == [tuple(r) for r in rows]


def _reference_first_rows(rows, as_of):
    """Sort-free reading of D2/D3: customers without a positive paid invoice
    (or without one in the year) keep their first input row."""
    lo, hi = as_of - timedelta(days=365), as_of - timedelta(days=1)
    by_user = collections.defaultdict(list)
    for r in rows:
        by_user[r[1]].append(r)
    revenue, flag = {}, {}
    for user, own in by_user.items():
        paid = [r[4] for r in own if r[3] == "Paid"]
        positive = [x for x in paid if x > 0]
        revenue[user] = (len(positive) or None, sum(paid) if positive or own[0][3] == "Paid" else None)
        flags = [lo <= datetime.fromisoformat(r[2]) <= hi for r in own]
        flag[user] = True if any(f and r[3] == "Paid" for f, r in zip(flags, own)) else flags[0]
    return revenue, flag


def test_first_row_is_the_first_of_the_files(spark, tmp_path):
    """Neither ids nor dates are in order, and a customer's rows lie in several files and blocks."""
    rnd = random.Random(8)
    as_of = datetime(2001, 6, 15, 12)
    rows = [(i, rnd.randrange(1, 150), (datetime(1999, 1, 1) + timedelta(days=rnd.randrange(1000))).date().isoformat(),
             rnd.choice(["Paid", "Unpaid", "Cancelled"]), float(rnd.choice([0, 0, 0, -1, 5]))) for i in rnd.sample(range(10 ** 6), 900)]
    names = ["id", "userid", "date", "status", "total"]
    for part, order in enumerate(([0, 1, 2, 3, 4], [4, 3, 1, 0, 2], [0, 1, 2, 3, 4])):
        lines = [",".join(names[c] for c in order)] + \
            [",".join(str(r[c]) for c in order) for r in rows[300 * part:300 * part + 300]]
        (tmp_path / f"part-{part}.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        feed = clean.clean_keys(read_feed(spark, str(tmp_path), "invoice"))
        assert feed.rdd.getNumPartitions() > 5
        got_revenue = {int(r.userid): (r.paid_invoices, r.revenue) for r in invoices.invoice_revenue_by_user(feed).collect()}
        got_flag = {int(r.userid): r.in_12m for r in invoices.invoice_12m_by_user(feed, as_of).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    revenue, flag = _reference_first_rows(rows, as_of)
    assert got_revenue == revenue and got_flag == flag
    by_date = _reference_first_rows(sorted(rows, key=lambda r: (r[2], r[0])), as_of)
    assert by_date != (revenue, flag)


FAULTY = (HEADER + "1,10,2001-1-1,Paid,1.5\n2,10,2001-13-1,Paid,abc\n3,999999999999999999999,2001-1-1,Paid,1\n"
          "4,10,2001-1-1,Paid,1.23456\nx,10,2001-1-1,Paid,2\n5,0,,Paid,2\n6,10,2001-1-1,Paid,2,7\n,10,2001-1-1,Paid,2\n")


def test_rejects_and_sound_rows_add_up(spark, tmp_path):
    raw = read_raw(spark, _folder(tmp_path, a=FAULTY), FEED_COLUMNS["invoice"])
    judged = judged_feed(raw, "invoice")
    bad = {(r.id, r.column, r.value, r.reason) for r in rejects(judged).collect()}
    assert bad == {("2", "date", "2001-13-1", "is no date (yyyy-M-d)"), ("2", "total", "abc", "does not fit decimal(18,4)"),
                   ("3", "userid", "999999999999999999999", "does not fit decimal(28,8)"),
                   ("4", "total", "1.23456", "does not fit decimal(18,4)"), ("6", None, None, "6 fields where the header has 5")}
    good = sound_rows(judged)
    assert good.count() + rejects(judged).select("id").distinct().count() == raw.count() == 8
    assert sorted(int(r.id) for r in clean.clean_keys(good).collect()) == [1]


def test_tolerated_share_of_faulty_rows(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    raw = read_raw(spark, _folder(source, a=FAULTY), FEED_COLUMNS["invoice"])
    good, bad = load_tolerant(spark, raw, "invoice", str(out), max_bad_share=0.5)
    assert good.count() == 4 and bad.count() == 5
    with pytest.raises(ValueError, match="4 of 8 rows of invoice are faulty"):
        load_tolerant(spark, raw, "invoice", str(out), max_bad_share=0.4)


def test_cleaning_is_counted_in_the_pass_that_cleans(spark, tmp_path):
    text = "id,userid\n1,10\nNA,1\nabc,1\n2,\n3,x\n4,0\n5,0.0\n6,7\nNA,\n1e2,9\n"
    feed = read_feed(spark, _folder(tmp_path, a=text), "ticket")
    df, seen = clean.clean_keys_observed(feed, "ticket")
    kept = sorted((float(r.id), float(r.userid)) for r in df.collect())
    assert kept == sorted((float(r.id), float(r.userid)) for r in clean.clean_keys(feed).collect()) == [(1, 10), (6, 7), (100, 9)]
    counts = seen.get
    assert counts == {"rows": 10, "kept": 3, "null id": 2, "id is no number": 1, "null userid": 1,
                      "userid is no number": 1, "zero userid": 2}
    plain = {r.rule: r.n_rows for r in clean.cleaning_counts(feed).collect()}
    assert plain == {k: v for k, v in counts.items() if k != "rows"}
