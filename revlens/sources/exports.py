"""The driver's tables written as the text of billing exports, with the faults
that real exports have, so that the text path (missing tokens, lenient
projection, dates, money, key coercion) runs over whole given tables.

Faults are dealt by remainders of the row's own numbers; every row is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.sources import tables

# Above 2^53 two neighbouring ids are one DOUBLE; a text key must keep them apart.
BIG_ID = 2 ** 53


def _dirty_id(k: Column) -> Column:
    text, rest = k.cast("string"), F.pmod(k, F.lit(11))
    return (F.when(rest == 0, F.concat(F.lit("  "), text, F.lit(" ")))
            .when(rest == 1, F.concat(text, F.lit(".0")))
            .when(rest == 2, F.lit("n/a"))
            .when(rest == 3, F.lit("0x1p3"))
            .when(rest == 4, F.concat(text, F.lit("d")))
            .when(rest == 5, (k + F.lit(BIG_ID)).cast("string"))
            .when(rest == 6, F.concat(text, F.lit(".5")))
            .otherwise(text))


def _dirty_user(k: Column) -> Column:
    rest = F.pmod(k, F.lit(7))
    return F.when(rest == 0, F.lit("abc")).when(rest == 1, F.lit("0")).otherwise(k.cast("string"))


def _date_text(c: Column, token: str) -> Column:
    return F.coalesce(F.date_format(c.cast("date"), "yyyy-M-d"), F.lit(token))


def invoice_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as the invoice export, with a column no feed knows."""
    inv = tables.invoice_feed(spark, sf_dir)
    return inv.select(
        F.lit("x").alias("notes"), _dirty_id(F.col("id")).alias("id"), _dirty_user(F.col("userid")).alias("userid"),
        F.when(F.pmod("id", F.lit(13)) == 0, F.lit("NULL")).otherwise(_date_text(F.col("date"), "")).alias("date"),
        "status",
        F.when(F.pmod("id", F.lit(17)) == 0, F.lit("#N/A")).otherwise(F.col("total").cast("string")).alias("total"))


def hosting_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosting services as their export, which lacks the first payment
    and has part of its amounts in exponent form."""
    s = tables.service_feed(spark, sf_dir).where(F.col("product") == "hosting")
    units = (F.col("recurringamount") * F.lit(10000)).cast("decimal(22,0)").cast("string")
    return s.select(
        _dirty_id(F.col("id")).alias("id"), _dirty_user(F.col("userid")).alias("userid"),
        _date_text(F.col("nextinvoicedate"), "None").alias("nextinvoicedate"),
        _date_text(F.col("termination_date"), "nan").alias("termination_date"),
        F.when(F.pmod("id", F.lit(6)) == 0, F.concat(units, F.lit("E-4")))
        .otherwise(F.col("recurringamount").cast("string")).alias("amount"),
        F.when(F.pmod("id", F.lit(5)) == 0, F.lit("N/A")).otherwise(F.col("billingcycle")).alias("billingcycle"),
        F.col("status").alias("domainstatus"))


EXPORTS = {"invoice": invoice_export, "hosting": hosting_export}


def faulty_invoice_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoice export with faults that typing cannot take: dates that are
    none, money that is no number or has too many places, ids with more places
    than a key holds.  A row can have several."""
    inv = tables.invoice_feed(spark, sf_dir).select("id", "userid", "date", "status", "total")
    n = F.col("id")

    def text(c: str) -> Column:
        return F.col(c).cast("string")

    return inv.select(
        F.when(n % 31 == 0, F.concat(text("id"), F.lit(".123456789"))).otherwise(text("id")).alias("id"),
        text("userid").alias("userid"),
        F.when(n % 19 == 0, F.lit("2000-13-45")).otherwise(_date_text(F.col("date"), "")).alias("date"), "status",
        F.when(n % 23 == 0, F.lit("abc")).when(n % 29 == 0, F.concat(text("total"), F.lit("567"))).otherwise(text("total")).alias("total"))


def write_invoice_csv(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """The invoices as CSV files of two headers: the files of odd ids list
    their columns in another order and have no date.  The notes hold quotes
    and commas."""
    inv = tables.invoice_feed(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"), F.col("userid").cast("string").alias("userid"),
        _date_text(F.col("date"), "NULL").alias("date"), "status", F.col("total").cast("string").alias("total"),
        F.concat(F.lit('Pa "'), F.col("id"), F.lit('", id')).alias("notes"))
    odd = F.pmod(F.col("id").cast("bigint"), F.lit(2)) == 1
    for part, columns in ((inv.where(~odd), ["id", "userid", "date", "status", "total", "notes"]),
                          (inv.where(odd), ["notes", "userid", "total", "id", "status"])):
        part.select(*columns).write.mode("append").options(header="true", escape='"').csv(folder)
    return folder
