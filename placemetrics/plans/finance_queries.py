"""Registered finance queries: one plan per customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemetrics.operators import finance as FI
from placemetrics.plans.proxies import Tables
from placemetrics.plans.sqlbase import cte, sql

QUERIES, ORACLE = {}, {}


def query(name: str, needs=None, body: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if body is not None:
            ORACLE[name] = sql(needs, body) if needs else body
        return fn
    return add


def f_plan(t: Tables) -> DataFrame:
    """One plan per customer; every nullable field is null at its own residue."""
    k = F.col("c_custkey")
    a = F.round(F.abs("c_acctbal") * 100).cast("bigint")

    def null_at(mod: int, c: Column) -> Column:
        return F.when(k % mod != 0, c)

    def _exact(text: Column) -> Column:
        return text.cast("decimal(21,18)")

    months = (k % 61 + 12).cast("int")
    return t.spread("customer").select(
        k.alias("plan_id"), null_at(7, a * 10).alias("deposit"), (a * 25 + 1000003).alias("facilities"),
        null_at(11, a * 3).alias("initial_inventory"), (k * 1000).alias("other_preparation"),
        null_at(13, a * 8).alias("target_reserve"), null_at(17, a * 20 + k).alias("equity"),
        null_at(19, a * 4 + 500000).alias("monthly_revenue"), a.alias("rent"), (a + k * 7).alias("labor"),
        null_at(23, F.lit(100000).cast("bigint")).alias("other"),
        null_at(31, _exact(F.concat(F.lit("0."), F.lpad((k % 99).cast("string"), 2, "0"), F.when(k % 9 == 4, F.concat(F.lit("0000000"), k % 7 + 1)).otherwise("")))).alias("variable_cost_rate"),
        null_at(37, k * 13).alias("existing_debt_payment"),
        F.when(k % 41 != 0, F.when(k % 5 == 0, F.lit(0)).otherwise(a * 30 + 1)).cast("bigint").alias("loan_principal"),
        null_at(43, _exact(F.concat(F.call_function("div", k % 97, F.lit(8)), F.lit("."), F.lpad((k % 97 % 8 * 125).cast("string"), 3, "0"), F.when((k % 11 == 5) & (k % 97 != 0), F.lit("00000123")).otherwise("")))).alias("annual_rate"),
        null_at(47, months).alias("total_months"),
        F.when(k % 29 == 0, months).otherwise((k % 12).cast("int")).alias("grace_months"),
        null_at(53, F.when(k % 2 == 0, F.lit("EQUAL_PAYMENT")).otherwise(F.lit("EQUAL_PRINCIPAL"))).alias("repayment_method"),
        (k % 13 + 12).cast("int").alias("cash_months"))


cte("f_plan", (), """SELECT k AS plan_id, CASE WHEN k % 7 <> 0 THEN a * 10 END AS deposit, a * 25 + 1000003 AS facilities,
 CASE WHEN k % 11 <> 0 THEN a * 3 END AS initial_inventory, k * 1000 AS other_preparation, CASE WHEN k % 13 <> 0 THEN a * 8 END AS target_reserve,
 CASE WHEN k % 17 <> 0 THEN a * 20 + k END AS equity, CASE WHEN k % 19 <> 0 THEN a * 4 + 500000 END AS monthly_revenue, a AS rent, a + k * 7 AS labor,
 CASE WHEN k % 23 <> 0 THEN CAST(100000 AS BIGINT) END AS other, CASE WHEN k % 31 <> 0 THEN (k % 99) * 100000000 + CASE WHEN k % 9 = 4 THEN k % 7 + 1 ELSE 0 END END AS rate_u,
 CASE WHEN k % 37 <> 0 THEN k * 13 END AS existing_debt, CASE WHEN k % 41 = 0 THEN NULL WHEN k % 5 = 0 THEN 0 ELSE a * 30 + 1 END AS principal,
 CASE WHEN k % 43 <> 0 THEN (k % 97) * 12500000000 + CASE WHEN k % 11 = 5 AND k % 97 <> 0 THEN 123 ELSE 0 END END AS rate_i, CASE WHEN k % 47 <> 0 THEN k % 61 + 12 END AS total_months,
 CASE WHEN k % 29 = 0 THEN k % 61 + 12 ELSE k % 12 END AS grace_months,
 CASE WHEN k % 53 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'EQUAL_PAYMENT' ELSE 'EQUAL_PRINCIPAL' END END AS repayment_method, k % 13 + 12 AS cash_months
 FROM (SELECT c_custkey AS k, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS a FROM customer)""")
_OPEN_MISS = "list_filter([CASE WHEN deposit IS NULL THEN 'openingExpenses.deposit' END, CASE WHEN initial_inventory IS NULL THEN 'openingExpenses.initialInventory' END], lambda x: x IS NOT NULL)"
cte("f_tot", ("f_plan",), f"""SELECT *, deposit + facilities + initial_inventory + other_preparation AS start, rent + labor + other AS fixed,
 equity + coalesce(principal, 0) - (deposit + facilities + initial_inventory + other_preparation) AS cash, {_OPEN_MISS} AS open_miss FROM f_plan""")
cte("f_loan_plan", ("f_plan",), """SELECT *, CASE WHEN coalesce(principal, 0) = 0 THEN 'READY' WHEN rate_i IS NULL OR total_months IS NULL OR repayment_method IS NULL THEN 'INSUFFICIENT_INPUT'
 WHEN grace_months >= total_months THEN 'UNSUPPORTED' ELSE 'READY' END AS loan_status, rate_i / 1e11 / 1200.0 AS r, total_months - grace_months AS n FROM f_plan""")
_STEP_INT = "(2 * {rem}::HUGEINT * rate_i + 120000000000000) // 240000000000000"
_PART = """CASE WHEN {m} <= grace_months THEN 0 WHEN {m} = total_months THEN {rem} WHEN repayment_method = 'EQUAL_PRINCIPAL' THEN least((2 * principal + n) // (2 * n), {rem})
 ELSE least(greatest(annuity - {i}, 0), {rem}) END"""
cte("f_loan_live", ("f_loan_plan",), """SELECT plan_id, principal, rate_i, total_months, grace_months, repayment_method, n,
 CAST(CASE WHEN rate_i = 0 THEN (2 * principal + n) // (2 * n) ELSE round(principal * r / (1 - pow(1 + r, -n))) END AS BIGINT) AS annuity
 FROM f_loan_plan WHERE loan_status = 'READY' AND coalesce(principal, 0) > 0""")
cte("f_fold", ("f_loan_live",), f"""SELECT plan_id, principal, rate_i, total_months, grace_months, repayment_method, n, annuity, CAST(0 AS BIGINT) AS month,
  CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS interest, CAST(principal AS BIGINT) AS remaining, CAST(0 AS BIGINT) AS paid FROM f_loan_live
 UNION ALL SELECT plan_id, principal, rate_i, total_months, grace_months, repayment_method, n, annuity, m, p, i, CAST(remaining - p AS BIGINT), CAST(paid + p + i AS BIGINT) FROM (
  SELECT *, CAST({_PART.format(m='m', rem='remaining', i='i')} AS BIGINT) AS p FROM (SELECT plan_id, principal, rate_i, total_months, grace_months, repayment_method, n, annuity,
   month + 1 AS m, CAST({_STEP_INT.format(rem='remaining')} AS BIGINT) AS i, remaining, paid FROM f_fold WHERE month < total_months))""")
cte("f_sched", ("f_fold",), "SELECT plan_id, month, part, interest, part + interest AS payment, remaining, paid, grace_months FROM f_fold WHERE month > 0")
cte("f_loan_sum", ("f_loan_plan", "f_sched"), """SELECT l.*, s.first_payment AS fp, s.after_grace, s.max_payment, s.tp, s.ti, CASE WHEN loan_status = 'READY' THEN coalesce(s.first_payment, 0) END AS first_payment
 FROM f_loan_plan l LEFT JOIN (SELECT plan_id, max(CASE WHEN month = 1 THEN payment END) AS first_payment, max(CASE WHEN month = grace_months + 1 THEN payment END) AS after_grace,
  max(payment) AS max_payment, CAST(sum(part) AS BIGINT) AS tp, CAST(sum(interest) AS BIGINT) AS ti FROM f_sched GROUP BY 1) s USING (plan_id)""")


def _rec(text: str) -> str:
    """Finance CTEs hold one recursive member."""
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def h(a: str, b: str) -> str:
    return f"CAST(CASE WHEN ({a}) < 0 THEN -((2 * -({a})::HUGEINT + ({b})) // (2 * ({b}))) ELSE (2 * ({a})::HUGEINT + ({b})) // (2 * ({b})) END AS BIGINT)"


cte("f_scen", ("f_loan_sum", "f_tot"), f"""SELECT plan_id, scenario, {h('t.monthly_revenue::HUGEINT * (100 + rev)', '100')} AS rev_s, {h('fixed::HUGEINT * (100 + fix)', '100')} AS fix_s,
 greatest(0, t.rate_u + var * 100000000) AS rate_s, t.monthly_revenue, fixed, t.rate_u, t.existing_debt, l.first_payment, l.loan_status, cash, open_miss, t.equity, t.cash_months
 FROM f_tot t JOIN f_loan_sum l USING (plan_id) CROSS JOIN (VALUES ('BASE', 0, 0, 0), ('ADVERSE', -20, 5, 5), ('IMPROVED', 10, -5, -2)) s(scenario, rev, fix, var)""")
_OP_OK = "monthly_revenue IS NOT NULL AND fixed IS NOT NULL AND rate_u IS NOT NULL"
_EV_OK = "fixed IS NOT NULL AND rate_u IS NOT NULL"


def _st(ok: str, loan: bool = False) -> str:
    tail = "WHEN loan_status <> 'READY' THEN loan_status " if loan else ""
    return f"CASE WHEN NOT ({ok}) THEN 'INSUFFICIENT_INPUT' WHEN rate_s >= 10000000000 THEN 'UNSUPPORTED' {tail}ELSE 'READY' END"


cte("f_even", ("f_scen",), f"""SELECT *, {_st(_OP_OK)} AS op_status, {_st(_EV_OK)} AS be_status, {_st(_EV_OK + ' AND existing_debt IS NOT NULL', True)} AS dbe_status,
 {_st(_OP_OK + ' AND existing_debt IS NOT NULL', True)} AS cash_status FROM f_scen""")


def totals(t: Tables) -> DataFrame:
    return FI.funding_totals(f_plan(t))


def summary(t: Tables) -> DataFrame:
    return FI.loan_summary(FI.with_loan(totals(t)))


def evens(t: Tables) -> DataFrame:
    return FI.break_even(FI.expand_scenarios(summary(t)))


def _joined(c: str) -> Column:
    return F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ",")


@query("fin_totals", ["f_tot"], """SELECT plan_id, start AS initial_total, CASE WHEN target_reserve IS NOT NULL THEN start + target_reserve END AS target,
 greatest(0, start + target_reserve - equity + 0 * (start + target_reserve - equity)) + 0 * (start + target_reserve - equity) AS gap, cash AS opening_cash,
 CASE WHEN cash IS NOT NULL AND target_reserve IS NOT NULL THEN greatest(0, target_reserve - cash) END AS shortfall,
 array_to_string(CASE WHEN target_reserve IS NULL THEN list_append(open_miss, 'targetReserve') ELSE open_miss END, ',') AS target_missing FROM f_tot""")
def fin_totals(t):
    return totals(t).select("plan_id", F.col("initial_expense_total.value").alias("initial_total"), F.col("target_funding.value").alias("target"),
                            F.col("planned_gap.value").alias("gap"), F.col("opening_cash.value").alias("opening_cash"),
                            F.col("reserve_shortfall.value").alias("shortfall"), _joined("target_funding.missing_fields").alias("target_missing"))


@query("fin_position", ["f_tot"], """SELECT plan_id, CASE WHEN cash IS NULL OR target_reserve IS NULL THEN 'INSUFFICIENT_INPUT' ELSE 'READY' END AS status,
 CASE WHEN cash IS NULL OR target_reserve IS NULL THEN NULL WHEN cash < 0 THEN 'INITIAL_EXPENSE_SHORTFALL' WHEN cash < target_reserve THEN 'RESERVE_SHORTFALL' ELSE 'TARGET_RESERVE_MET' END AS position FROM f_tot""")
def fin_position(t):
    return totals(t).select("plan_id", F.col("funding_position.status").alias("status"), F.col("funding_position.value").alias("position"))


@query("fin_scenarios", ["f_scen"], "SELECT plan_id, scenario, rev_s AS revenue, fix_s AS fixed_costs, CAST(rate_s AS BIGINT) AS rate_units FROM f_scen")
def fin_scenarios(t):
    return FI.expand_scenarios(totals(t)).select("plan_id", "scenario", F.col("s_revenue").alias("revenue"), F.col("s_fixed").alias("fixed_costs"),
                                                 F.call_function("div", F.col("s_rate"), F.lit(10 ** 8)).cast("bigint").alias("rate_units"))


@query("fin_break_even", ["f_even"], f"""SELECT plan_id, scenario, op_status, be_status, dbe_status, cash_status,
 CASE WHEN op_status = 'READY' THEN {h('rev_s::HUGEINT * (10000000000 - rate_s) - fix_s::HUGEINT * 10000000000', '10000000000')} END AS operating_balance,
 CASE WHEN be_status = 'READY' THEN {h('fix_s::HUGEINT * 10000000000', '(10000000000 - rate_s)')} END AS break_even,
 CASE WHEN dbe_status = 'READY' THEN {h('(fix_s + existing_debt + first_payment)::HUGEINT * 10000000000', '(10000000000 - rate_s)')} END AS debt_break_even,
 CASE WHEN cash_status = 'READY' THEN {h('rev_s::HUGEINT * (10000000000 - rate_s) - (fix_s + existing_debt + first_payment)::HUGEINT * 10000000000', '10000000000')} END AS first_month_cash FROM f_even""")
def fin_break_even(t):
    e = evens(t)
    return e.select("plan_id", "scenario", F.col("operating_balance.status").alias("op_status"), F.col("operating_break_even.status").alias("be_status"),
                    F.col("debt_break_even.status").alias("dbe_status"), F.col("first_month_cash.status").alias("cash_status"),
                    F.col("operating_balance.value").alias("operating_balance"), F.col("operating_break_even.value").alias("break_even"),
                    F.col("debt_break_even.value").alias("debt_break_even"), F.col("first_month_cash.value").alias("first_month_cash"))


@query("loan_schedule", ["f_sched"], """SELECT plan_id, CAST(month AS INTEGER) AS month, CASE WHEN month <= grace_months THEN 'GRACE' ELSE 'REPAYMENT' END AS phase,
 part AS principal, interest, payment, remaining FROM f_sched""")
def loan_schedule(t):
    return FI.loan_schedule(FI.with_loan(f_plan(t)), "plan_id")


@query("loan_summary", ["f_loan_sum"], """SELECT plan_id, loan_status AS status, first_payment, CASE WHEN loan_status = 'READY' THEN coalesce(after_grace, 0) END AS after_grace,
 CASE WHEN loan_status = 'READY' THEN coalesce(max_payment, 0) END AS maximum_payment, CASE WHEN loan_status = 'READY' THEN coalesce(tp, 0) END AS total_principal,
 CASE WHEN loan_status = 'READY' THEN coalesce(ti, 0) END AS total_interest FROM f_loan_sum""")
def loan_summary(t):
    return FI.loan_summary(FI.with_loan(f_plan(t))).select(
        "plan_id", F.col("loan.status").alias("status"), "first_payment", F.col("first_payment_after_grace").alias("after_grace"),
        "maximum_payment", "total_principal", "total_interest")


@query("cash_runway", ["f_even", "f_sched"], f""", sched AS MATERIALIZED (SELECT plan_id, month, payment, paid FROM f_sched),
 ask AS MATERIALIZED (SELECT *, CASE WHEN NOT ({_OP_OK} AND existing_debt IS NOT NULL) THEN 'INSUFFICIENT_INPUT' WHEN rate_s >= 10000000000 THEN 'UNSUPPORTED'
  WHEN cash IS NULL THEN 'INSUFFICIENT_INPUT' ELSE loan_status END AS status FROM f_even),
 months AS (SELECT a.*, unnest(generate_series(1, cash_months)) AS m FROM ask a WHERE status = 'READY'),
 paid AS (SELECT m.*, coalesce(s.payment, 0) AS payment, sum(coalesce(s.payment, 0)) OVER (PARTITION BY m.plan_id, m.scenario ORDER BY m.m) AS so_far
  FROM months m LEFT JOIN sched s ON s.plan_id = m.plan_id AND s.month = m.m),
 bal AS (SELECT plan_id, scenario, m, payment, {h('rev_s::HUGEINT * (10000000000 - rate_s) - (fix_s + existing_debt + payment)::HUGEINT * 10000000000', '10000000000')} AS after_debt,
  {h('cash::HUGEINT * 10000000000 + m * (rev_s::HUGEINT * (10000000000 - rate_s) - (fix_s + existing_debt)::HUGEINT * 10000000000) - so_far::HUGEINT * 10000000000', '10000000000')} AS closing FROM paid),
 neg AS (SELECT plan_id, scenario, CAST(min(CASE WHEN closing < 0 THEN m END) AS INTEGER) AS first_negative_month FROM bal GROUP BY 1, 2)
SELECT a.plan_id, a.scenario, a.status, array_to_string(CASE WHEN NOT ({_OP_OK} AND existing_debt IS NOT NULL) THEN
  list_filter([CASE WHEN monthly_revenue IS NULL THEN 'monthlyRevenue' END, CASE WHEN fixed IS NULL THEN 'monthlyFixedCosts.other' END, CASE WHEN a.rate_u IS NULL THEN 'variableCostRate' END,
   CASE WHEN existing_debt IS NULL THEN 'existingMonthlyDebtPayment' END], lambda x: x IS NOT NULL) ELSE [] END, ',') AS own_missing,
 CAST(b.m AS INTEGER) AS month, CAST(b.payment AS BIGINT) AS loan_payment, b.after_debt, b.closing, n.first_negative_month
 FROM ask a LEFT JOIN bal b USING (plan_id, scenario) LEFT JOIN neg n USING (plan_id, scenario)""")
def cash_runway(t):
    """One row per plan, scenario and month; one without a month where there is no answer."""
    r = FI.cash_runway(evens(t))
    own = F.filter("cash_missing", lambda x: x.isin("monthlyRevenue", "monthlyFixedCosts.other", "variableCostRate", "existingMonthlyDebtPayment"))
    return r.select("plan_id", "scenario", F.col("cash_status").alias("status"), F.array_join(own, ",").alias("own_missing"),
                    F.explode_outer("cash_balances").alias("b"), "first_negative_month").select(
        "plan_id", "scenario", "status", "own_missing", "b.month", "b.loan_payment", "b.after_debt", "b.closing", "first_negative_month")


for _n in ("fin_scenarios", "fin_break_even", "loan_schedule", "loan_summary", "cash_runway"):
    ORACLE[_n] = _rec(ORACLE[_n])


@query("fin_input_quality", None, """WITH r AS (SELECT c_custkey AS k, c_custkey % 17 AS m17, c_custkey % 61 + 12 AS tm FROM customer)
SELECT issue, count(*) AS row_count FROM (SELECT unnest(list_filter([CASE WHEN m17 IN (1, 2, 3) THEN 'INVALID_MONEY:equity' END,
 CASE WHEN k % 19 IN (1, 2) THEN 'INVALID_VARIABLE_RATE' END, CASE WHEN k % 23 IN (1, 2) THEN 'INVALID_INTEREST_RATE' END, CASE WHEN k % 29 = 1 THEN 'INVALID_TERM' END,
 CASE WHEN k % 31 = 1 THEN 'INVALID_GRACE' END, CASE WHEN k % 37 = 1 THEN 'INVALID_METHOD' END, CASE WHEN k % 41 IN (1, 2) THEN 'INVALID_CASH_MONTHS' END,
 CASE WHEN k % 5 <> 0 AND (CASE WHEN k % 31 = 1 THEN -1 WHEN k % 43 = 0 THEN 72 ELSE k % 12 END) >= (CASE WHEN k % 29 = 1 THEN 601 ELSE tm END) THEN 'GRACE_NOT_BELOW_TERM' END],
 lambda x: x IS NOT NULL)) AS issue FROM r) GROUP BY 1""")
def fin_input_quality(t):
    k = F.col("c_custkey")
    raw = t.customer.select(
        "c_custkey", F.when(k % 17 == 1, F.lit("-5")).when(k % 17 == 2, F.lit("007")).when(k % 17 == 3, F.lit("1234567890123456789"))
        .when(k % 17 != 4, (k * 1000).cast("string")).alias("equity"),
        F.when(k % 19 == 1, F.lit("1")).when(k % 19 == 2, F.lit("a")).when(k % 19 != 3, F.lit("0.35")).alias("variable_cost_rate"),
        F.when(k % 23 == 1, F.lit("100.5")).when(k % 23 == 2, F.lit("1.")).when(k % 23 != 3, F.lit("4.25")).alias("annual_rate"),
        F.when(k % 29 == 1, F.lit(601)).otherwise((k % 61 + 12).cast("int")).alias("total_months"),
        F.when(k % 31 == 1, F.lit(-1)).when(k % 43 == 0, F.lit(72)).otherwise((k % 12).cast("int")).alias("grace_months"),
        F.when(k % 37 == 1, F.lit("BULLET")).when(k % 37 != 2, F.lit("EQUAL_PAYMENT")).alias("repayment_method"),
        F.when(k % 41 == 1, F.lit(0)).when(k % 41 != 2, F.lit(24)).alias("cash_months"),
        F.when(k % 5 == 0, F.lit("0")).otherwise(F.lit("50000000")).alias("loan_principal"))
    v = FI.validate_plans(raw, ["equity", "loan_principal"])
    return v.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("row_count"))


@query("calc_dedupe", None, """SELECT c_custkey AS plan_id, key FROM (SELECT c_custkey, sha256('{"planId":"p' || c_custkey || '","inputRevision":' || c_custkey % 4
 || ',"inputSchemaVersion":"in-1","calculationVersion":"calc-2"}') AS key FROM customer) WHERE c_custkey % 3 <> 0""")
def calc_dedupe(t):
    k = F.col("c_custkey")
    keyed = t.customer.select("c_custkey", FI.calculation_key(F.concat(F.lit("p"), k.cast("string")), k % 4, F.lit("in-1"), F.lit("calc-2")).alias("calculation_key"))
    return FI.new_work(keyed, keyed.where(k % 3 == 0)).select(k.alias("plan_id"), F.col("calculation_key").alias("key"))


@query("provenance_keep", ["f_plan"], """SELECT plan_id, coalesce(principal IS NOT NULL AND plan_id % 6 NOT IN (1, 2), FALSE) AS kept FROM f_plan WHERE TRUE""")
def provenance_keep(t):
    p, k = f_plan(t), F.col("plan_id")
    changed = p.select("*", *[F.col(c).alias(f"old_{c}") for c in ("loan_principal", *FI.LOAN_TERMS)]).withColumns({
        "loan_principal": F.when(k % 6 == 1, F.coalesce(F.col("loan_principal"), F.lit(0)) + 1).otherwise(F.col("loan_principal")),
        "total_months": F.when(k % 6 == 2, F.when(F.col("total_months").isNull(), F.lit(1))).otherwise(F.col("total_months"))})
    return changed.select("plan_id", FI.keep_provenance("old_", "").alias("kept"))
