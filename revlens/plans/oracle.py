"""DuckDB oracle statements, one per catalogue entry.

They are written independently of the Spark plans, in the shape of the
reference's own computation: window transforms for the group-broadcast
columns and ``row_number`` for sort-then-keep-first.  Output names, types and
rounding match the Spark side (money summed as DECIMAL, derived doubles
rounded half-even as ``round_even(x * 10^n, 0) / 10^n``).
"""

from __future__ import annotations

from revlens.plans.params import DEFAULT, Params


def _ts(dt) -> str:
    return f"TIMESTAMP '{dt.strftime('%Y-%m-%d %H:%M:%S')}'"


def _r(x: str, n: int) -> str:
    return f"(round_even(({x}) * {10 ** n}.0::DOUBLE, 0) / {10 ** n}.0::DOUBLE)"


def ctes(p: Params) -> dict[str, str]:
    as_of = _ts(p.as_of)
    cycle = ("CASE billingcycle WHEN 'Annually' THEN 365.0::DOUBLE WHEN 'Monthly' THEN 30.0::DOUBLE "
             "WHEN 'Biennially' THEN 730.0::DOUBLE WHEN 'Semi-Annually' THEN 182.5::DOUBLE "
             "WHEN 'Triennially' THEN 1095.0::DOUBLE WHEN 'Quarterly' THEN 91.25::DOUBLE END")
    return {
        "inv": f"""inv AS (
  SELECT o_orderkey AS id, o_custkey AS userid, CAST(o_orderdate AS TIMESTAMP) AS date,
         CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Unpaid' WHEN 'P' THEN 'Cancelled' END AS status,
         CAST(o_totalprice AS DECIMAL(18,2)) AS total
  FROM orders
  WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND o_custkey <> 0)""",
        "inv12": f"""inv12 AS (
  SELECT *, coalesce(date IS NOT NULL AND date >= {as_of} - INTERVAL 365 DAY
                     AND date <= {as_of} - INTERVAL 1 DAY, false) AS in_12m
  FROM inv)""",
        "tix": """tix AS (
  SELECT event_id AS id, user_id AS userid FROM events
  WHERE event_type = 'error' AND event_id IS NOT NULL AND user_id IS NOT NULL AND user_id <> 0)""",
        "svc0": """svc0 AS (
  SELECT CASE l_partkey % 3 WHEN 0 THEN 'domain' WHEN 1 THEN 'hosting' WHEN 2 THEN 'hostingaddons' END AS product,
         l_orderkey AS id, o_custkey AS userid,
         CASE WHEN l_quantity <> 50 THEN CAST(l_shipdate AS TIMESTAMP) END AS nextinvoicedate,
         CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS TIMESTAMP) END AS termination_date,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS firstpaymentamount,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(18,2)) - CAST(l_discount AS DECIMAL(18,2)))
              AS DECIMAL(18,4)) AS recurringamount,
         CASE l_linenumber WHEN 1 THEN 'Monthly' WHEN 2 THEN 'Quarterly' WHEN 3 THEN 'Semi-Annually'
              WHEN 4 THEN 'Annually' WHEN 5 THEN 'Biennially' WHEN 6 THEN 'Triennially' WHEN 7 THEN 'One Time' END
              AS billingcycle,
         CASE WHEN l_linestatus = 'O' THEN 'Active' WHEN l_returnflag = 'N' THEN 'Completed' ELSE 'Cancelled' END
              AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND o_custkey <> 0)""",
        "svc": f"""svc AS (
  SELECT *, CASE WHEN product = 'domain' THEN
           CASE WHEN nextinvoicedate IS NULL THEN 'Inactive'
                WHEN nextinvoicedate >= {as_of} - INTERVAL 90 DAY THEN 'Active' ELSE 'Inactive' END
         ELSE
           CASE WHEN nextinvoicedate IS NULL THEN 'Active'
                WHEN termination_date IS NOT NULL THEN 'Inactive'
                WHEN nextinvoicedate >= {as_of} - INTERVAL 90 DAY THEN 'Active' ELSE 'Inactive' END
         END AS final_status
  FROM svc0)""",
        "svc_pay": """svc_pay AS (
  SELECT *, CASE WHEN nextinvoicedate = min_next THEN CAST(firstpaymentamount AS DECIMAL(20,4))
                 ELSE CAST(recurringamount AS DECIMAL(20,4)) END AS payment
  FROM (SELECT *, min(nextinvoicedate) OVER (PARTITION BY product, userid) AS min_next FROM svc))""",
        "svc_w": f"""svc_m AS (
  SELECT *, coalesce(payment > 0 AND final_status = 'Active', false) AS m_act,
            coalesce(nextinvoicedate > {as_of} AND final_status = 'Active', false) AS m_fut,
            coalesce(payment > 0 AND (CASE WHEN product = 'domain' THEN status = 'Active'
                                           ELSE status IN ('Active', 'Completed') END), false) AS m_rev
  FROM svc_pay),
svc_w AS (
  SELECT *,
    CASE WHEN m_act THEN count(*) FILTER (WHERE m_act) OVER (PARTITION BY product, userid) END AS active_services,
    CASE WHEN m_fut THEN sum(CASE WHEN m_fut THEN coalesce(payment, 0) END) OVER (PARTITION BY product, userid) END
      AS future_revenue,
    CASE WHEN m_rev THEN sum(CASE WHEN m_rev THEN payment END) OVER (PARTITION BY product, userid) END AS revenue
  FROM svc_m)""",
        "svc_cost": f"""svc_c0 AS (
  SELECT *, CASE WHEN final_status = 'Inactive' THEN 0.0::DOUBLE
                 WHEN final_status = 'Active' THEN
                   floor((epoch_us(nextinvoicedate) - epoch_us({as_of})) / 86400000000) / 30.0::DOUBLE END
            AS lagging_cycles
  FROM svc),
svc_c1 AS (SELECT *, coalesce(lagging_cycles > 0, false) AS free_flag FROM svc_c0),
svc_c2 AS (
  SELECT *, CASE WHEN product = 'domain' THEN CAST(recurringamount AS DOUBLE) / 12.0::DOUBLE
                 WHEN free_flag THEN CAST(recurringamount AS DOUBLE) / {cycle}
                 ELSE 0.0::DOUBLE END AS cycle_rate
  FROM svc_c1),
svc_cost AS (
  SELECT *, CASE WHEN free_flag THEN lagging_cycles * cycle_rate ELSE 0.0::DOUBLE END AS free_service_cost
  FROM svc_c2)""",
    }


_DEPS = {"inv12": ["inv"], "svc": ["svc0"], "svc_pay": ["svc"], "svc_w": ["svc_pay"],
         "svc_cost": ["svc"]}


def _with(p: Params, *names: str) -> str:
    defs = ctes(p)
    order: list[str] = []

    def visit(n):
        for d in _DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)
    for n in names:
        visit(n)
    return "WITH " + ",\n".join(defs[n] for n in order) + "\n"


def _exact_sum(x: str) -> str:
    return f"(CAST(sum(CAST(round_even(({x}) * 1000000.0::DOUBLE, 0) AS DECIMAL(30,0))) AS DOUBLE) / 1000000.0::DOUBLE)"


def oracle_statements(p: Params = DEFAULT) -> dict[str, str]:
    W = lambda *n: _with(p, *n)
    q: dict[str, str] = {}
    q["clean_keys_invoices"] = W("inv") + "SELECT id, userid, date, status, CAST(total AS DOUBLE) AS total FROM inv"
    q["clean_keys_services"] = W("svc0") + "SELECT product, id, userid, nextinvoicedate FROM svc0"
    key = ("CAST(CAST(CASE WHEN {k} % 11 = 5 THEN {k} + 9007199254740992 ELSE {k} END AS DECIMAL(28,8)) "
           "+ CASE WHEN {k} % 11 = 6 THEN 0.5 ELSE 0 END AS DECIMAL(28,8))::VARCHAR AS id, "
           "CAST(o_custkey AS DECIMAL(28,8))::VARCHAR AS userid")
    valid = "{k} % 11 NOT IN (2, 3, 4) AND o_custkey % 7 NOT IN (0, 1)"
    q["typed_invoices"] = f"""SELECT {key.format(k='o_orderkey')},
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS date,
  CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Unpaid' WHEN 'P' THEN 'Cancelled' END AS status,
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS total
FROM orders WHERE {valid.format(k='o_orderkey')}"""
    q["typed_hosting"] = f"""SELECT {key.format(k='l_orderkey')},
  CASE WHEN l_quantity <> 50 THEN CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) END AS nextinvoicedate,
  CASE WHEN l_returnflag = 'R' THEN CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) END AS termination_date,
  CAST(NULL AS DOUBLE) AS firstpaymentamount,
  CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(18,4))
       AS DOUBLE) AS recurringamount,
  CASE WHEN l_orderkey % 5 <> 0 THEN
    CASE l_linenumber WHEN 1 THEN 'Monthly' WHEN 2 THEN 'Quarterly' WHEN 3 THEN 'Semi-Annually' WHEN 4 THEN 'Annually'
         WHEN 5 THEN 'Biennially' WHEN 6 THEN 'Triennially' WHEN 7 THEN 'One Time' END END AS billingcycle,
  CASE WHEN l_linestatus = 'O' THEN 'Active' WHEN l_returnflag = 'N' THEN 'Completed' ELSE 'Cancelled' END AS status
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_partkey % 3 = 1 AND {valid.format(k='l_orderkey')}"""
    q["csv_invoices"] = W("inv") + (
        "SELECT id, userid, CASE WHEN id % 2 = 0 THEN date_trunc('day', date) END AS date, status, "
        "CAST(total AS DOUBLE) AS total FROM inv")
    dirty = ("CASE WHEN {k} % 11 = 2 THEN 'null id' WHEN {k} % 11 IN (3, 4) THEN 'id is no number' "
             "WHEN o_custkey % 7 = 0 THEN 'userid is no number' WHEN o_custkey % 7 = 1 THEN 'zero userid' ELSE 'kept' END")
    q["cleaning_counts"] = f"""SELECT feed, rule, count(*) AS n_rows FROM (
  SELECT 'invoice' AS feed, {dirty.format(k='o_orderkey')} AS rule FROM orders
  UNION ALL SELECT 'hosting', {dirty.format(k='l_orderkey')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_partkey % 3 = 1
  UNION ALL SELECT 'ticket', CASE WHEN event_id IS NULL THEN 'null id' WHEN user_id IS NULL THEN 'null userid'
    WHEN user_id = 0 THEN 'zero userid' ELSE 'kept' END FROM events WHERE event_type = 'error')
GROUP BY feed, rule"""
    faulty = """WITH raw AS (
  SELECT CASE WHEN o_orderkey % 31 = 0 THEN o_orderkey || '.123456789' ELSE o_orderkey::VARCHAR END AS id,
    o_custkey::VARCHAR AS userid, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day, o_orderkey AS n,
    CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Unpaid' WHEN 'P' THEN 'Cancelled' END AS status,
    CAST(o_totalprice AS DECIMAL(18,2)) AS amount
  FROM orders),
judged AS (
  SELECT *, CASE WHEN n % 19 <> 0 THEN day END AS date,
    CASE WHEN n % 23 <> 0 AND n % 29 <> 0 THEN CAST(amount AS DOUBLE) END AS total FROM raw)
"""
    q["invoice_rejects"] = faulty + """SELECT id, userid, date, status, total, 'id' AS column, id AS value,
  'does not fit decimal(28,8)' AS reason FROM judged WHERE n % 31 = 0
UNION ALL SELECT id, userid, date, status, total, 'date', '2000-13-45', 'is no date (yyyy-M-d)' FROM judged WHERE n % 19 = 0
UNION ALL SELECT id, userid, date, status, total, 'total', CASE WHEN n % 23 = 0 THEN 'abc' ELSE amount || '567' END,
  'does not fit decimal(18,4)' FROM judged WHERE n % 23 = 0 OR n % 29 = 0"""
    q["invoice_sound_rows"] = faulty + """SELECT n AS id, CAST(userid AS BIGINT) AS userid, date, status, total FROM judged
WHERE n % 31 <> 0 AND n % 19 <> 0 AND n % 23 <> 0 AND n % 29 <> 0 AND userid <> '0'"""
    q["paid_invoices_only"] = W("inv") + (
        "SELECT id, userid, date, CAST(total AS DOUBLE) AS total FROM inv WHERE status = 'Paid'")
    for name, prod in [("domain_status", "domain"), ("hosting_status", "hosting"),
                       ("addon_status", "hostingaddons")]:
        q[name] = W("svc") + (
            f"SELECT id, userid, nextinvoicedate, final_status FROM svc WHERE product = '{prod}'")
    q["min_next_invoice"] = W("svc_pay") + (
        "SELECT product, id, userid, nextinvoicedate, min_next FROM svc_pay")
    q["service_payment"] = W("svc_pay") + (
        "SELECT product, id, userid, CAST(payment AS DOUBLE) AS payment FROM svc_pay")
    q["lagging_cycles"] = W("svc_cost") + (
        f"SELECT product, id, userid, final_status, {_r('lagging_cycles', 6)} AS lagging_cycles FROM svc_cost")
    q["cycle_rate"] = W("svc_cost") + (
        f"SELECT product, id, userid, {_r('cycle_rate', 4)} AS cycle_rate FROM svc_cost")
    q["free_service_cost"] = W("svc_cost") + (
        f"SELECT product, id, userid, {_r('free_service_cost', 4)} AS free_service_cost FROM svc_cost")
    q["trailing_12m_flag"] = W("inv12") + "SELECT id, userid, date, in_12m FROM inv12"
    q["active_services"] = W("svc_w") + (
        "SELECT product, id, userid, CAST(active_services AS BIGINT) AS active_services FROM svc_w")
    q["future_revenue"] = W("svc_w") + (
        "SELECT product, id, userid, CAST(future_revenue AS DOUBLE) AS future_revenue FROM svc_w")
    q["domain_revenue_rows"] = W("svc_w") + (
        "SELECT id, userid, CAST(revenue AS DOUBLE) AS revenue FROM svc_w WHERE product = 'domain'")
    q["revenue_12m_rows"] = W("inv12") + """SELECT id, userid, CAST(CASE WHEN m THEN
        sum(CASE WHEN m THEN coalesce(total, 0) END) OVER (PARTITION BY userid) END AS DOUBLE) AS revenue_12m
  FROM (SELECT *, coalesce(in_12m AND status = 'Paid', false) AS m FROM inv12)"""
    for name, prod in [("domain_rollup", "domain"), ("hosting_rollup", "hosting"),
                       ("addon_rollup", "hostingaddons")]:
        q[name] = W("svc_w") + f"""SELECT userid, min(final_status) AS final_status,
  CAST(max(active_services) AS BIGINT) AS active_services, CAST(max(payment) AS DOUBLE) AS payment,
  CAST(max(future_revenue) AS DOUBLE) AS future_revenue, CAST(max(revenue) AS DOUBLE) AS revenue
FROM svc_w WHERE product = '{prod}' GROUP BY userid"""
    for name, prod in [("user_cost_domain", "domain"), ("user_cost_hosting", "hosting"),
                       ("user_cost_addon", "hostingaddons")]:
        q[name] = W("svc_cost") + _user_cost_sql(prod)
    q["invoice_12m_by_user"] = W("inv12") + _inv12_sql()
    q["invoice_revenue_by_user"] = W("inv") + _invrev_sql()
    q["tickets_by_user"] = W("tix") + "SELECT userid, count(*) AS tickets FROM tix GROUP BY userid"
    q["profit_by_customer"] = W("inv", "tix") + f"""SELECT coalesce(r.userid, t.userid) AS userid,
  coalesce(r.paid_invoices, 0) AS paid_invoices, coalesce(r.revenue, 0.0::DOUBLE) AS revenue,
  coalesce(t.tickets, 0) AS tickets,
  CAST(coalesce(t.tickets, 0) AS DOUBLE) * {float(p.cost_per_ticket)}::DOUBLE AS cost,
  coalesce(r.revenue, 0.0::DOUBLE) - CAST(coalesce(t.tickets, 0) AS DOUBLE) * {float(p.cost_per_ticket)}::DOUBLE AS profit
FROM ({_invrev_sql()}) r
FULL OUTER JOIN (SELECT userid, count(*) AS tickets FROM tix GROUP BY userid) t ON r.userid = t.userid"""
    q.update(more_statements(p))
    q.update(holt_winters_statements(p))
    return q


def _user_cost_sql(prod: str) -> str:
    return f"""SELECT userid, final_status, total_free_service_cost, lagging_cycles FROM (
  SELECT userid, final_status, lagging_cycles,
    coalesce(CAST(sum(CAST(round_even(free_service_cost * 1000000.0::DOUBLE, 0) AS DECIMAL(30,0)))
                  OVER (PARTITION BY userid) AS DOUBLE) / 1000000.0::DOUBLE, 0.0::DOUBLE) AS total_free_service_cost,
    row_number() OVER (PARTITION BY userid ORDER BY final_status, nextinvoicedate NULLS LAST, lagging_cycles) AS rn
  FROM svc_cost WHERE product = '{prod}') WHERE rn = 1"""


def _inv12_sql(revenue: str = "CAST(revenue_12m AS DOUBLE)") -> str:
    return f"""SELECT userid, {revenue} AS revenue_12m, in_12m FROM (
  SELECT *, row_number() OVER (PARTITION BY userid ORDER BY revenue_12m DESC NULLS LAST,
                                date NULLS FIRST, id) AS rn
  FROM (SELECT *, CASE WHEN m THEN sum(CASE WHEN m THEN coalesce(total, 0) END) OVER (PARTITION BY userid) END
                  AS revenue_12m
        FROM (SELECT *, coalesce(in_12m AND status = 'Paid', false) AS m FROM inv12)))
WHERE rn = 1"""


def _invrev_sql(revenue: str = "CAST(revenue AS DOUBLE)") -> str:
    return f"""SELECT userid, paid_invoices, {revenue} AS revenue FROM (
  SELECT *, row_number() OVER (PARTITION BY userid ORDER BY paid_invoices DESC NULLS LAST,
                                date NULLS FIRST, id) AS rn
  FROM (SELECT *,
          CASE WHEN mp THEN count(*) FILTER (WHERE mp) OVER (PARTITION BY userid) END AS paid_invoices,
          CASE WHEN m THEN sum(CASE WHEN m THEN coalesce(total, 0) END) OVER (PARTITION BY userid) END AS revenue
        FROM (SELECT *, coalesce(status = 'Paid', false) AS m,
                        coalesce(status = 'Paid' AND total > 0, false) AS mp FROM inv)))
WHERE rn = 1"""


def customer_ctes(p: Params) -> str:
    months = ", ".join(f"y{y}" for y in p.years)
    return f"""roll AS (
  SELECT product, userid, min(final_status) AS final_status, max(active_services) AS active_services,
         max(payment) AS payment, max(future_revenue) AS future_revenue, max(revenue) AS revenue
  FROM svc_w GROUP BY product, userid),
rollf AS (
  SELECT product, userid, final_status, CAST(coalesce(active_services, 0) AS BIGINT) AS active_services,
         coalesce(payment, 0) AS payment, coalesce(future_revenue, 0) AS future_revenue,
         coalesce(revenue, 0) AS revenue
  FROM roll),
ucost AS (
  SELECT product, userid, final_status, total_free_service_cost, lagging_cycles FROM (
    SELECT product, userid, final_status, lagging_cycles,
      coalesce(CAST(sum(CAST(round_even(free_service_cost * 1000000.0::DOUBLE, 0) AS DECIMAL(30,0)))
                    OVER (PARTITION BY product, userid) AS DOUBLE) / 1000000.0::DOUBLE, 0.0::DOUBLE)
        AS total_free_service_cost,
      row_number() OVER (PARTITION BY product, userid
                         ORDER BY final_status, nextinvoicedate NULLS LAST, lagging_cycles) AS rn
    FROM svc_cost) WHERE rn = 1),
inv12u AS ({_inv12_sql("revenue_12m")}),
invrevu AS ({_invrev_sql("revenue")}),
tixu AS (SELECT userid, count(*) AS tickets FROM tix GROUP BY userid),
profit AS (
  SELECT coalesce(r.userid, t.userid) AS userid, coalesce(r.revenue, 0) AS revenue,
         coalesce(t.tickets, 0) AS tickets
  FROM invrevu r FULL OUTER JOIN tixu t ON r.userid = t.userid),
kpi AS (
  SELECT coalesce(CAST((SELECT sum(revenue_12m) FROM inv12u) AS DOUBLE), 0.0::DOUBLE) AS annual_revenue,
         coalesce(CAST((SELECT sum(CAST(round_even(free_service_cost * 1000000.0::DOUBLE, 0) AS DECIMAL(38,0)))
                        FROM svc_cost) AS DOUBLE), 0.0::DOUBLE) / 1000000.0::DOUBLE AS free_service_cost,
         round_even(coalesce(CAST((SELECT sum(revenue) FROM profit) AS DOUBLE), 0.0::DOUBLE), 0) AS revenue_earned,
         coalesce(CAST((SELECT sum(revenue) FROM profit) AS DOUBLE), 0.0::DOUBLE)
           - coalesce(CAST((SELECT sum(tickets) FROM profit) AS DOUBLE), 0.0::DOUBLE)
             * {float(p.cost_per_ticket)}::DOUBLE AS profit),
clients AS (
  SELECT count(*) AS active_clients, count(*) FILTER (WHERE n > 0) AS active_clients_corrected
  FROM (SELECT userid, sum(active_services) AS n FROM rollf GROUP BY userid))"""


def cohort_ctes(p: Params) -> str:
    ycols = ",\n         ".join(
        f"sum(CASE WHEN year(date) = {y} THEN coalesce(total, 0) ELSE 0 END) AS y{y}" for y in p.years)
    yon = ", ".join(f"y{y}" for y in p.years)
    return f"""piv AS (
  SELECT userid,
         {ycols},
         strftime(min(date), '%Y') AS signup_year, strftime(max(date), '%Y') AS signoff_year,
         min(date) AS first_paid, max(date) AS last_paid
  FROM inv WHERE status = 'Paid' GROUP BY userid),
subs AS (
  SELECT CAST(substr(yname, 2) AS INTEGER) AS year, count(*) FILTER (WHERE v > 0) AS subscribers,
         sum(v) AS revenue
  FROM (UNPIVOT (SELECT {yon} FROM piv) ON {yon} INTO NAME yname VALUE v) GROUP BY yname),
adds AS (SELECT CAST(signup_year AS INTEGER) AS year, count(*) AS additions FROM piv
         WHERE signup_year IS NOT NULL GROUP BY 1),
dis AS (SELECT CAST(signoff_year AS INTEGER) AS year, count(*) AS disengagement FROM piv
        WHERE signoff_year IS NOT NULL GROUP BY 1),
yrs AS (SELECT year FROM subs UNION SELECT year FROM adds UNION SELECT year FROM dis),
coh AS (
  SELECT y.year, s.subscribers, a.additions, d.disengagement, CAST(s.revenue AS DOUBLE) AS revenue,
         CAST(s.revenue AS DOUBLE) / nullif(s.subscribers, 0) AS arpu
  FROM yrs y LEFT JOIN subs s ON s.year = y.year LEFT JOIN adds a ON a.year = y.year
       LEFT JOIN dis d ON d.year = y.year),
coh_r AS (
  SELECT year, subscribers, additions, disengagement, {_r('revenue', 2)} AS revenue, {_r('arpu', 2)} AS arpu
  FROM coh),
f1 AS (SELECT *, CAST(lag(subscribers, 1, 0) OVER (ORDER BY year) AS DOUBLE) AS ps FROM coh_r),
f2 AS (SELECT *, CAST(additions AS DOUBLE) / nullif(ps, 0) AS g,
                 CAST(disengagement AS DOUBLE) / nullif(ps, 0) AS c FROM f1),
f3 AS (SELECT *, ps - ps * lag(c, 1, 0.0::DOUBLE) OVER w + ps * lag(g, 1, 0.0::DOUBLE) OVER w AS fs,
                 lag(arpu, 1, 0.0::DOUBLE) OVER w AS pa
       FROM f2 WINDOW w AS (ORDER BY year)),
f4 AS (SELECT *, pa * fs AS fr FROM f3),
f5 AS (SELECT *, fr - revenue AS v FROM f4),
fc AS (
  SELECT year, subscribers, additions, disengagement, revenue, arpu,
         {_r('g', 2)} AS growth_rate, {_r('c', 2)} AS churn_rate, {_r('fs', 2)} AS forecast_subscribers,
         {_r('fr', 2)} AS forecast_revenue, {_r('v', 2)} AS variance,
         {_r('v / nullif(revenue, 0) * 100.0::DOUBLE', 2)} AS var_rate
  FROM f5)"""


def finance_ctes(p: Params) -> str:
    months = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    cells = ",\n         ".join(
        f"sum(CASE WHEN month(l_shipdate) = {i + 1} THEN signed END) AS {m}" for i, m in enumerate(months))
    return f"""fin AS (
  SELECT Scenario, business_unit, Account, Year,
         {cells}
  FROM (SELECT CASE l_linestatus WHEN 'O' THEN 'Actuals' WHEN 'F' THEN 'Budget' END AS Scenario,
               p_type AS business_unit,
               CASE l_returnflag WHEN 'N' THEN 'Sales' WHEN 'R' THEN 'COGS' WHEN 'A' THEN 'Returns' END AS Account,
               CAST(year(l_shipdate) AS INTEGER) AS Year, l_shipdate,
               CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18,2))
                    ELSE -CAST(l_extendedprice AS DECIMAL(18,2)) END AS signed
        FROM lineitem JOIN part ON l_partkey = p_partkey)
  GROUP BY Scenario, business_unit, Account, Year)"""


_MONTHS = "Jan, Feb, Mar, Apr, May, Jun, Jul, Aug, Sep, Oct, Nov, Dec"


def more_statements(p: Params = DEFAULT) -> dict[str, str]:
    q: dict[str, str] = {}
    cust = _with(p, "svc_w", "svc_cost", "inv12", "tix").rstrip("\n") + ",\n" + customer_ctes(p) + "\n"
    q["product_costs_long"] = cust + (
        "SELECT product, userid, final_status, total_free_service_cost, lagging_cycles FROM ucost")
    q["product_revenue_long"] = cust + """SELECT product, userid, final_status, active_services,
  CAST(payment AS DOUBLE) AS payment, CAST(future_revenue AS DOUBLE) AS future_revenue,
  CAST(revenue AS DOUBLE) AS revenue FROM rollf"""
    q["customer_free_cost"] = cust.rstrip("\n") + """,
w AS (SELECT userid,
  max(final_status) FILTER (product = 'hostingaddons') AS final_status_addon,
  max(final_status) FILTER (product = 'hosting') AS final_status_hosting,
  max(final_status) FILTER (product = 'domain') AS final_status_domain,
  max(total_free_service_cost) FILTER (product = 'hostingaddons') AS total_free_service_cost_addon,
  max(total_free_service_cost) FILTER (product = 'hosting') AS total_free_service_cost_hosting,
  max(total_free_service_cost) FILTER (product = 'domain') AS total_free_service_cost_domain
  FROM ucost GROUP BY userid),
s3 AS (SELECT coalesce(w.userid, i.userid) AS userid, w.* EXCLUDE (userid),
              CAST(i.revenue_12m AS DOUBLE) AS revenue_12m, i.in_12m
       FROM w FULL OUTER JOIN inv12u i ON w.userid = i.userid)
SELECT *, (0.0::DOUBLE
   + coalesce(round_even(total_free_service_cost_addon * 1000000.0::DOUBLE, 0), 0.0::DOUBLE)
   + coalesce(round_even(total_free_service_cost_hosting * 1000000.0::DOUBLE, 0), 0.0::DOUBLE)
   + coalesce(round_even(total_free_service_cost_domain * 1000000.0::DOUBLE, 0), 0.0::DOUBLE))
   / 1000000.0::DOUBLE AS free_service_cost_all_products
FROM s3"""
    q["customer_revenue_summary"] = cust.rstrip("\n") + """,
a AS (SELECT * FROM roll WHERE product = 'hostingaddons'),
h AS (SELECT * FROM roll WHERE product = 'hosting'),
d AS (SELECT * FROM roll WHERE product = 'domain'),
s1 AS (SELECT coalesce(a.userid, h.userid) AS userid,
              a.active_services AS as_a, h.active_services AS as_h, a.revenue AS r_a, h.revenue AS r_h,
              a.future_revenue AS f_a, h.future_revenue AS f_h
       FROM a FULL OUTER JOIN h ON a.userid = h.userid),
s2 AS (SELECT coalesce(s1.userid, d.userid) AS userid, as_a, as_h, d.active_services AS as_d, r_a, r_h,
              d.revenue AS r_d, f_a, f_h, d.future_revenue AS f_d
       FROM s1 FULL OUTER JOIN d ON s1.userid = d.userid),
s3 AS (SELECT coalesce(s2.userid, i.userid) AS userid, s2.* EXCLUDE (userid), i.revenue AS r_i, i.paid_invoices
       FROM s2 FULL OUTER JOIN invrevu i ON s2.userid = i.userid)
SELECT userid,
  CAST(coalesce(as_a, 0) AS BIGINT) AS active_services_addon, CAST(coalesce(as_h, 0) AS BIGINT) AS active_services_hosting,
  CAST(coalesce(as_d, 0) AS BIGINT) AS active_services_domain,
  CAST(coalesce(r_a, 0) AS DOUBLE) AS revenue_addon, CAST(coalesce(r_h, 0) AS DOUBLE) AS revenue_hosting,
  CAST(coalesce(r_d, 0) AS DOUBLE) AS revenue_domain, CAST(coalesce(r_i, 0) AS DOUBLE) AS invoice_revenue,
  CAST(coalesce(paid_invoices, 0) AS BIGINT) AS paid_invoices,
  CAST(coalesce(f_a, 0) + coalesce(f_h, 0) + coalesce(f_d, 0) AS DOUBLE) AS future_revenue_all_products,
  CAST(coalesce(f_a, 0) + coalesce(f_h, 0) + coalesce(f_d, 0) + coalesce(f_a, 0) + coalesce(f_h, 0)
       + coalesce(f_d, 0) + coalesce(r_a, 0) + coalesce(r_h, 0) + coalesce(r_d, 0) + coalesce(r_i, 0) AS DOUBLE)
    AS revenue_all_products,
  CAST(coalesce(r_a, 0) + coalesce(r_h, 0) + coalesce(r_d, 0) AS DOUBLE) AS revenue_all_products_corrected
FROM s3"""
    q["customer_totals"] = cust + """SELECT userid, CAST(sum(active_services) AS BIGINT) AS active_services,
  CAST(sum(payment) AS DOUBLE) AS payment, CAST(sum(future_revenue) AS DOUBLE) AS future_revenue,
  CAST(sum(revenue) AS DOUBLE) AS revenue FROM rollf GROUP BY userid"""
    q["highest_revenue_per_customer"] = cust + """SELECT userid, CAST(revenue AS DOUBLE) AS highest_revenue,
  CASE WHEN revenue IS NOT NULL THEN product END AS product
FROM (SELECT *, row_number() OVER (PARTITION BY userid ORDER BY revenue DESC NULLS LAST, product) AS rn FROM roll)
WHERE rn = 1"""
    q["revenue_by_product_status"] = cust + """SELECT product, final_status, CAST(sum(revenue) AS DOUBLE) AS revenue
FROM rollf GROUP BY product, final_status"""
    q["active_clients"] = cust + "SELECT active_clients, active_clients_corrected FROM clients"
    q["kpis"] = cust + "SELECT annual_revenue, free_service_cost, revenue_earned, profit FROM kpi"
    q["kpi_text"] = cust + """SELECT CAST(c.active_clients AS VARCHAR) AS active_clients,
  '$ ' || format('{:,.2f}', k.revenue_earned) AS revenue_earned, '$ ' || format('{:,.2f}', k.profit) AS profit
FROM kpi k, clients c"""
    q["annual_metric_table"] = cust + """SELECT 'Annual Revenue' AS metric, annual_revenue AS value FROM kpi
UNION ALL SELECT 'Free Service Cost' AS metric, free_service_cost AS value FROM kpi"""
    q["acquisition_cost"] = cust + f"""SELECT *, '$ ' || format('{{:,.2f}}', acquisition_cost) AS acquisition_text
FROM (SELECT annual_revenue, free_service_cost,
  {_r(f'(annual_revenue - free_service_cost - {float(p.operational_cost)}::DOUBLE) * {float(p.acquisition_multiplier)}::DOUBLE', 2)}
    AS acquisition_cost FROM kpi)"""

    coh = _with(p, "inv").rstrip("\n") + ",\n" + cohort_ctes(p) + "\n"
    ycast = ", ".join(f"CAST(y{y} AS DOUBLE) AS y{y}" for y in p.years)
    q["user_year_pivot"] = coh + f"SELECT userid, {ycast}, signup_year, signoff_year FROM piv"
    q["signup_signoff"] = coh + "SELECT userid, first_paid, last_paid, signup_year, signoff_year FROM piv"
    for name, metric in [("subscribers_by_year", "subscribers"), ("additions_by_year", "additions"),
                         ("disengagement_by_year", "disengagement"), ("revenue_by_year", "revenue"),
                         ("arpu_by_year", "arpu")]:
        q[name] = coh + f"SELECT year, {metric} AS value FROM coh WHERE {metric} IS NOT NULL"
    q["annual_cohort"] = coh + "SELECT * FROM coh_r"
    q["lagged_subscribers"] = coh + """SELECT year, subscribers,
  lag(subscribers, 1, 0) OVER (ORDER BY year) AS prev_subscribers FROM coh_r"""
    q["cohort_forecast"] = coh + "SELECT * FROM fc"
    metrics = ["subscribers", "additions", "disengagement", "revenue", "arpu", "growth_rate", "churn_rate",
               "forecast_subscribers", "forecast_revenue", "variance", "var_rate"]
    q["forecast_table_long"] = coh.rstrip("\n") + f""",
fcd AS (SELECT year, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in metrics)} FROM fc)
SELECT year, metric, value, format('{{:,.2f}}', value) AS value_text
FROM fcd UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(metrics)}))"""
    q["rate_bands"] = coh + """SELECT year, growth_rate, churn_rate,
  CASE WHEN coalesce(growth_rate < 0.1, false) THEN 'red' ELSE 'green' END AS growth_band,
  CASE WHEN coalesce(churn_rate < 0.05, false) THEN 'green' ELSE 'red' END AS churn_band FROM fc"""

    fin = "WITH " + finance_ctes(p) + "\n"
    q["finance_sales_by_unit"] = fin + f"""SELECT Scenario AS scenario, business_unit, CAST(sum(sales) AS DOUBLE) AS sales
FROM (UNPIVOT (SELECT Scenario, business_unit, {_MONTHS} FROM fin
               WHERE Year = {p.finance_year} AND Account = '{p.finance_account}')
      ON {_MONTHS} INTO NAME month VALUE sales)
GROUP BY Scenario, business_unit"""
    q["finance_monthly_long"] = fin + f"""SELECT Scenario AS scenario, month, CAST(sales AS DOUBLE) AS sales
FROM (UNPIVOT (SELECT Scenario, {_MONTHS} FROM fin
               WHERE Year = {p.finance_year} AND Account = '{p.finance_account}'
                 AND business_unit = '{p.finance_unit}')
      ON {_MONTHS} INTO NAME month VALUE sales)"""
    q["finance_wide"] = fin + "SELECT Scenario, business_unit, Account, Year, " + ", ".join(
        f"CAST({m} AS DOUBLE) AS {m}" for m in _MONTHS.split(", ")) + " FROM fin"
    absm = ", ".join(f"abs({m}) AS {m}" for m in _MONTHS.split(", "))
    q["finance_yearly_by_account"] = fin + f"""SELECT Account AS account, Year AS year, CAST(sum(sales) AS DOUBLE) AS sales
FROM (UNPIVOT (SELECT Account, Year, {absm} FROM fin
               WHERE Scenario = '{p.finance_scenario}' AND Account <> '{p.finance_account}')
      ON {_MONTHS} INTO NAME month VALUE sales)
GROUP BY Account, Year"""
    return q


def holt_winters_statements(p: Params = DEFAULT) -> dict[str, str]:
    """T6/T7 as a recursive CTE (season length 2, the default): the same
    grid, start values and recurrences, evaluated in the same operation
    order, so the chosen fit and its values are bit-identical."""
    if p.hw_season != 2:
        return {}
    train = [y for y in p.years if y < p.partial_year]
    n, lo, hi = len(train), min(train), max(train)
    yrs = ", ".join(f"({i + 1}, {y})" for i, y in enumerate(train))
    values = lambda vs: ", ".join(f"(CAST('{v!r}' AS DOUBLE))" for v in vs)
    grid = values((0.1, 0.3, 0.5, 0.7, 0.9))
    one = "1.0::DOUBLE"

    def fits(points: str, k: str) -> str:
        """Common table expressions ``init``, ``rec`` and ``best``, named with
        ``k``, of the fits at the points (series, a, b, g) of a table."""
        return f"""
init{k} AS (
  SELECT series, a, b, g, ((0.0::DOUBLE + y1) + y2) / 2.0::DOUBLE AS l0,
         (((0.0::DOUBLE + y3) + y4) / 2.0::DOUBLE - ((0.0::DOUBLE + y1) + y2) / 2.0::DOUBLE) / 2.0::DOUBLE AS b0,
         y1 - ((0.0::DOUBLE + y1) + y2) / 2.0::DOUBLE AS s1, y2 - ((0.0::DOUBLE + y1) + y2) / 2.0::DOUBLE AS s2
  FROM st0 JOIN ({points}) USING (series)),
rec{k} AS (
  SELECT * FROM (
    WITH RECURSIVE r(series, a, b, g, t, l, tr, s1, s2, sse, fitted) AS (
      SELECT series, a, b, g, 0, l0, b0, s1, s2, 0.0::DOUBLE, []::DOUBLE[] FROM init{k}
      UNION ALL
      SELECT r.series, r.a, r.b, r.g, r.t + 1,
             r.a * (x.y - r.s1) + ({one} - r.a) * (r.l + r.tr),
             r.b * ((r.a * (x.y - r.s1) + ({one} - r.a) * (r.l + r.tr)) - r.l) + ({one} - r.b) * r.tr,
             r.s2,
             r.g * ((x.y - r.l) - r.tr) + ({one} - r.g) * r.s1,
             r.sse + (x.y - ((r.l + r.tr) + r.s1)) * (x.y - ((r.l + r.tr) + r.s1)),
             list_append(r.fitted, (r.l + r.tr) + r.s1)
      FROM r JOIN ser x ON x.series = r.series AND x.idx = r.t + 1)
    SELECT * FROM r WHERE t = {n})),
best{k} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY sse, a, b, g) AS rn FROM rec{k})
  WHERE rn = 1)"""
    base = _with(p, "inv").rstrip("\n") + f""",
uy AS (SELECT userid, CAST(year(date) AS INTEGER) AS year, sum(coalesce(total, 0)) AS amount
       FROM inv WHERE status = 'Paid' AND year(date) BETWEEN {lo} AND {hi} GROUP BY userid, year(date)),
ser0 AS (SELECT c.c_mktsegment AS series, u.year, u.amount FROM uy u JOIN customer c ON c.c_custkey = u.userid
         UNION ALL SELECT 'ALL' AS series, year, amount FROM uy),
ser1 AS (SELECT series, year, {_r('CAST(sum(amount) AS DOUBLE)', 2)} AS y FROM ser0 GROUP BY series, year),
yrs AS (SELECT * FROM (VALUES {yrs}) t(idx, year)),
ser AS (SELECT nm.series, yrs.idx, coalesce(s.y, 0.0::DOUBLE) AS y
        FROM (SELECT DISTINCT series FROM ser1) nm CROSS JOIN yrs
        LEFT JOIN ser1 s ON s.series = nm.series AND s.year = yrs.year),
grid AS (SELECT ga.v AS a, gb.v AS b, gg.v AS g
         FROM (VALUES {grid}) ga(v), (VALUES {grid}) gb(v), (VALUES {grid}) gg(v)),
st0 AS (
  SELECT series, max(CASE WHEN idx = 1 THEN y END) AS y1, max(CASE WHEN idx = 2 THEN y END) AS y2,
         max(CASE WHEN idx = 3 THEN y END) AS y3, max(CASE WHEN idx = 4 THEN y END) AS y4
  FROM ser GROUP BY series HAVING count(*) >= 4),{fits("SELECT st0.series, grid.* FROM st0, grid", "")},
steps AS (SELECT * FROM (VALUES {", ".join(f"({h})" for h in range(1, p.hw_horizon + 1))}) t(step)),
fc AS (
  SELECT series, CAST(step AS INTEGER) AS step, CAST({hi} + step AS INTEGER) AS year,
         (l + CAST(step AS DOUBLE) * tr) + CASE WHEN (step - 1) % 2 = 0 THEN s1 ELSE s2 END AS forecast
  FROM best, steps)
"""
    q = {
        "hw_forecast": base + f"""SELECT *, '$' || format('{{:,.2f}}', forecast) AS forecast_text FROM (
  SELECT series, step, year, {_r('forecast', 2)} AS forecast FROM fc)""",
        "hw_fitted": base + f"""SELECT series, CAST(year AS INTEGER) AS year, {_r('f', 2)} AS fitted FROM (
  SELECT series, unnest(fitted) AS f, unnest(range({lo}, {hi + 1})) AS year FROM best)""",
    }
    fine, k = "", ""
    for zoom in range(p.hw_zooms):
        near = [f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, q.{c} + o{c}.v)) AS {c}" for c in "abg"]
        step = values(x * 0.05 / 4 ** zoom for x in (-2, -1, 0, 1, 2))
        points = (f"SELECT q.series, {', '.join(near)} FROM best{k} q, "
                  + ", ".join(f"(VALUES {step}) o{c}(v)" for c in "abg"))
        k = f"_{zoom + 1}"
        fine += "," + fits(points, k)
    q["hw_fine_fit"] = base.rstrip() + fine + f"""
SELECT series, a AS alpha, b AS beta, g AS gamma, {_r('sse', 2)} AS sse FROM best{k}"""
    q["hw_fine_forecast"] = base.rstrip() + fine + f"""
SELECT *, '$' || format('{{:,.2f}}', forecast) AS forecast_text FROM (
  SELECT series, CAST(step AS INTEGER) AS step, CAST({hi} + step AS INTEGER) AS year, {_r("""
    (l + CAST(step AS DOUBLE) * tr) + CASE WHEN (step - 1) % 2 = 0 THEN s1 ELSE s2 END""", 2)} AS forecast
  FROM best{k}, steps)"""
    factor = repr(1 + (p.growth_rate - p.churn_rate))
    proj, expr = [], "forecast"
    for k in range(1, p.projection_years + 1):
        expr = f"CAST(trunc(({expr}) * {factor}::DOUBLE) AS DOUBLE)"
        proj.append(f"SELECT series, CAST(year + {k} AS INTEGER) AS year, {expr} AS projected_revenue, "
                    f"'$ ' || format('{{:,.2f}}', {expr}) AS projected_text FROM fc WHERE step = 1")
    q["growth_projection"] = base + "\nUNION ALL\n".join(proj)
    return q
