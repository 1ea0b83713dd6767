"""Outputs do not depend on input order or partitioning (explicit total
tie-breaks, exact sums): the same query over a reshuffled copy of the feeds
gives the same rows."""

from pyspark.sql import functions as F

from revlens.operators import customers, invoices, services
from revlens.plans.catalog import Feeds
from conftest import AS_OF, SF_SMALL


def _same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_invariant_under_repartition(spark):
    f = Feeds(spark, SF_SMALL)
    inv = f.invoices()
    inv2 = inv.repartition(13, F.xxhash64("id")).sortWithinPartitions(F.desc("date"))
    _same(invoices.invoice_revenue_by_user(inv), invoices.invoice_revenue_by_user(inv2))
    _same(invoices.invoice_12m_by_user(inv, AS_OF), invoices.invoice_12m_by_user(inv2, AS_OF))
    svc = f.services()
    svc2 = svc.repartition(11, "id").sortWithinPartitions(F.desc("nextinvoicedate"))
    _same(services.user_cost(services.with_cost_columns(svc, AS_OF)),
          services.user_cost(services.with_cost_columns(svc2, AS_OF)))
    _same(customers.product_revenue_long(services.service_stats(svc, AS_OF)),
          customers.product_revenue_long(services.service_stats(svc2, AS_OF)))
