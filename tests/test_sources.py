"""CSV feed reading: missing-value tokens, lenient projection, single-digit
dates, bad-date modes, then key cleaning."""

import tempfile

import pytest

from revlens.operators.clean import clean_keys
from revlens.sources.feeds import read_feed


def _csv(text):
    d = tempfile.mkdtemp(prefix="revlens-csv-")
    with open(f"{d}/feed.csv", "w") as fh:
        fh.write(text)
    return f"{d}/feed.csv"


def test_domain_csv_tokens_and_lenient_columns(spark):
    path = _csv("id,userid,nextinvoicedate,firstpaymentamount,status\n"
                "1,10,2001-7-5,12.50,Active\n"
                "NA,11,2001-07-05,1,Active\n"
                "abc,12,,1,Active\n"
                " 12 ,0,2001-01-01,1,Active\n"
                "1d,13,2001-01-01,1,Active\n"
                "3,n/a,2001-01-01,1,Active\n"
                "4,14,NULL,1,Active\n")
    df = read_feed(spark, path, "domain")
    assert df.columns == ["id", "userid", "nextinvoicedate", "firstpaymentamount", "recurringamount", "status"]
    got = sorted(tuple(r) for r in clean_keys(df).select("id", "userid", "nextinvoicedate",
                                                        "recurringamount").collect())
    assert [g[:2] for g in got] == [(1.0, 10.0), (4.0, 14.0)]
    assert got[0][2].isoformat() == "2001-07-05T00:00:00" and got[0][3] is None and got[1][2] is None


def test_bad_date_modes(spark):
    path = _csv("id,userid,date,status,total\n1,1,0000-00-00,Paid,1\n")
    assert read_feed(spark, path, "invoice", on_bad_date="null").first().date is None
    with pytest.raises(Exception):
        read_feed(spark, path, "invoice").collect()


def test_missing_path_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        read_feed(spark, "", "ticket")


def test_text_keys_keep_neighbours_apart(spark):
    path = _csv("id,userid\n1,9007199254740992\n2,9007199254740993\n3,18446744073709551615\n4,0x1p3\n"
                "5,1.5\n6,1e3\n7,Infinity\n")
    got = {int(r.id): str(r.userid) for r in clean_keys(read_feed(spark, path, "ticket")).collect()}
    assert got == {1: "9007199254740992.00000000", 2: "9007199254740993.00000000",
                   3: "18446744073709551615.00000000", 5: "1.50000000", 6: "1000.00000000"}


@pytest.mark.parametrize("key", ["1.123456789", "999999999999999999999"])
def test_key_that_does_not_fit_is_an_error(spark, key):
    with pytest.raises(Exception, match="does not fit"):
        clean_keys(read_feed(spark, _csv(f"id,userid\n1,{key}\n"), "ticket")).collect()


@pytest.mark.parametrize("total,rounded", [("12.34567", "12.3457"), ("99999999999999999999.5", None),
                                           ('"1,200.50"', None), ("abc", None)])
def test_money_that_does_not_fit_is_an_error_unless_rounding_is_asked_for(spark, total, rounded):
    path = _csv(f"id,userid,date,status,total\n1,1,2001-01-01,Paid,{total}\n")
    with pytest.raises(Exception, match="invoice.total does not fit"):
        read_feed(spark, path, "invoice").collect()
    got = read_feed(spark, path, "invoice", on_bad_money="round").first().total
    assert (None if got is None else str(got)) == rounded


def test_money_is_kept_as_given(spark):
    path = _csv("id,userid,date,status,total\n1,1,2001-01-01,Paid,12.345\n2,1,2001-01-01,Paid,1.5e2\n"
                "3,1,2001-01-01,Paid,-0.0001\n")
    assert [str(r.total) for r in read_feed(spark, path, "invoice").orderBy("id").collect()] == \
        ["12.3450", "150.0000", "-0.0001"]
