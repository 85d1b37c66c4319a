"""Plan finance over a table of plans. Money is whole won, every result is rounded once.

A result that cannot be given is a struct saying why: INSUFFICIENT_INPUT with the missing
fields, or UNSUPPORTED with a reason; a missing input is tested before an unsupported one.
All work on one plan stays inside its row (arrays of at most 600 months), so nothing here
shuffles: a billion plans are a billion independent rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal, localcontext

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemetrics.functions.money import half_up_div, let, wide
from placemetrics.operators.quality import issue_array

# Limits and scenario templates.
MAX_DIGITS = 18
MAX_RATE_PERCENT = 100
MAX_MONTHS = 600
MAX_CASH_MONTHS = 120
METHODS = ("EQUAL_PAYMENT", "EQUAL_PRINCIPAL")
SCENARIOS = (("BASE", 0, 0, 0), ("ADVERSE", -20, 5, 5), ("IMPROVED", 10, -5, -2))
OPENING = {"deposit": "openingExpenses.deposit", "facilities": "openingExpenses.facilities",
           "initial_inventory": "openingExpenses.initialInventory", "other_preparation": "openingExpenses.otherPreparation"}
FIXED = {"rent": "monthlyFixedCosts.rent", "labor": "monthlyFixedCosts.labor", "other": "monthlyFixedCosts.other"}
LOAN_TERMS = {"annual_rate": "newLoan.annualInterestRatePercent", "total_months": "newLoan.totalMonths",
              "grace_months": "newLoan.graceMonths", "repayment_method": "newLoan.repaymentMethod"}
RATE_UNIT = 10 ** 18                  # rates are whole numbers of this part: every accepted digit counts
INTEREST_DIVISOR = 1200 * RATE_UNIT   # percent per year, per month


# ---------------------------------------------------------------- results

def _missing(fields: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(name)) for c, name in fields.items()]))


def result(missing: Column, value: Column, unsupported: Column | None = None, reason: str | Column | None = None) -> Column:
    """``struct(status, value, missing_fields, reason)``."""
    bad = F.lit(False) if unsupported is None else unsupported
    why = reason if isinstance(reason, Column) else F.lit(reason).cast("string")
    status = (F.when(F.size(missing) > 0, "INSUFFICIENT_INPUT").when(bad, "UNSUPPORTED").otherwise("READY"))
    return F.struct(status.alias("status"), F.when(status == "READY", value).alias("value"),
                    F.when(status == "INSUFFICIENT_INPUT", missing).alias("missing_fields"),
                    F.when(status == "UNSUPPORTED", why).alias("reason"))


def sum_or_missing(fields: dict[str, str]) -> Column:
    """Sum of the columns, or the names of those that are null."""
    total = None
    for c in fields:
        v = F.col(c).cast("bigint")
        total = v if total is None else total + v
    return result(_missing(fields), total)


# ---------------------------------------------------------------- totals

def funding_totals(plans: DataFrame) -> DataFrame:
    """Initial total, target, gap, cash before opening, reserve shortfall, position."""
    base = plans.select("*", sum_or_missing(OPENING).alias("initial_expense_total"),
                        sum_or_missing(FIXED).alias("fixed_cost_total"))
    start, start_missing = F.col("initial_expense_total.value"), _missing(OPENING)
    reserve, equity = F.col("target_reserve"), F.col("equity")
    m_reserve, m_equity = _missing({"target_reserve": "targetReserve"}), _missing({"equity": "equity"})
    target_missing = F.concat(start_missing, m_reserve)
    cash_missing = F.concat(start_missing, m_equity)
    cash = equity + F.coalesce(F.col("loan_principal"), F.lit(0)) - start
    zero = F.lit(0).cast("bigint")
    position = (F.when(cash < 0, "INITIAL_EXPENSE_SHORTFALL").when(cash < reserve, "RESERVE_SHORTFALL")
                .otherwise("TARGET_RESERVE_MET"))
    return base.select(
        "*", result(target_missing, start + reserve).alias("target_funding"),
        result(F.concat(target_missing, m_equity), F.greatest(zero, start + reserve - equity)).alias("planned_gap"),
        result(cash_missing, cash).alias("opening_cash"),
        result(F.concat(cash_missing, m_reserve), F.greatest(zero, reserve - cash)).alias("reserve_shortfall"),
        result(F.concat(cash_missing, m_reserve), position).alias("funding_position"))


# ---------------------------------------------------------------- loans

@F.pandas_udf(T.LongType())
def annuity_payment(principal: pd.Series, rate_units: pd.Series, months: pd.Series) -> pd.Series:
    """Equal monthly payment at 50 digits, half up. Growth factors outgrow DECIMAL(38); one call per plan."""
    factors: dict = {}
    out = []
    with localcontext() as ctx:
        ctx.prec = 50
        for p, r, n in zip(principal, rate_units, months):
            if pd.isna(p) or pd.isna(r) or pd.isna(n) or n <= 0:
                out.append(None)
                continue
            key = (int(r), int(n))
            if key not in factors:
                rate = Decimal(int(r)) / Decimal(INTEREST_DIVISOR)
                factors[key] = rate / (1 - (1 + rate) ** -int(n)) if r else None
            amount = Decimal(int(p)) / int(n) if factors[key] is None else Decimal(int(p)) * factors[key]
            out.append(int(amount.quantize(Decimal(1), rounding="ROUND_HALF_UP")))
    return pd.Series(out, dtype="Int64")


def rate_units(rate: Column) -> Column:
    """A rate as a whole number of units of 10^-18, exact for every accepted text."""
    return (rate.cast("decimal(21,18)") * F.lit(RATE_UNIT).cast("decimal(19,0)")).cast("decimal(21,0)")


def _interest(remaining: Column, rate: Column) -> Column:
    """``remaining * rate / 1200``, half up."""
    return half_up_div(remaining.cast("decimal(17,0)") * rate, F.lit(str(INTEREST_DIVISOR)).cast("decimal(22,0)"))


def with_loan(plans: DataFrame) -> DataFrame:
    """Add ``loan`` (status) and ``schedule``: months with principal, interest, payment, balance.

    The schedule is a fold over the months of one plan inside its row.
    """
    principal = F.col("loan_principal").cast("bigint")
    no_loan = F.coalesce(principal, F.lit(0)) == 0
    missing = F.when(no_loan, F.array().cast("array<string>")).otherwise(_missing(LOAN_TERMS))
    bad_term = F.col("grace_months") >= F.col("total_months")
    status = result(missing, F.lit(None).cast("bigint"), ~no_loan & F.coalesce(bad_term, F.lit(False)), "GRACE_NOT_BELOW_TERM")
    rate = rate_units(F.col("annual_rate"))
    repay = (F.col("total_months") - F.col("grace_months")).cast("bigint")
    df = plans.select("*", status.alias("loan"), no_loan.alias("_none"), rate.alias("_rate"), repay.alias("_repay"))
    live = ~F.col("_none") & (F.col("loan.status") == "READY")
    equal = F.when(live & (F.col("repayment_method") == "EQUAL_PAYMENT"),
                   annuity_payment(F.when(live, principal), F.when(live, F.col("_rate")), F.when(live, F.col("_repay"))))
    df = df.withColumn("_annuity", equal).withColumn(
        "_even", F.when(live, F.call_function("div", principal * 2 + F.col("_repay"), F.col("_repay") * 2)))

    row_type = "array<struct<month:int,principal:bigint,interest:bigint,payment:bigint,remaining:bigint,paid:bigint>>"
    start = F.struct(principal.alias("left"), F.lit(0).cast("bigint").alias("paid"), F.array().cast(row_type).alias("rows"))
    zero = F.lit(0).cast("bigint")

    def month(acc: Column, m: Column) -> Column:
        # interest and principal part are bound once; every mention would be computed again
        def with_interest(x: Column) -> Column:
            part = (F.when(m <= F.col("grace_months"), zero).when(m == F.col("total_months"), x["left"])
                    .when(F.col("repayment_method") == "EQUAL_PRINCIPAL", F.least(F.col("_even"), x["left"]))
                    .otherwise(F.least(F.greatest(F.col("_annuity") - x["interest"], zero), x["left"])))
            return let(F.struct(part.alias("part"), x["interest"].alias("interest"), x["left"].alias("left")), with_part)

        def with_part(y: Column) -> Column:
            pay, left = y["part"] + y["interest"], y["left"] - y["part"]
            row = F.struct(m.cast("int").alias("month"), y["part"].alias("principal"), y["interest"].alias("interest"), pay.alias("payment"),
                           left.alias("remaining"), (acc["paid"] + pay).alias("paid"))
            return F.struct(left.alias("left"), (acc["paid"] + pay).alias("paid"), F.concat(acc["rows"], F.array(row)).cast(row_type).alias("rows"))

        return let(F.struct(acc["left"].alias("left"), _interest(acc["left"], F.col("_rate")).alias("interest")), with_interest)

    fold = F.aggregate(F.sequence(F.lit(1), F.col("total_months").cast("int")), start, month, lambda a: a["rows"])
    schedule = (F.when(live, fold).when(F.col("loan.status") == "READY", F.array().cast(row_type)))
    return df.withColumn("schedule", schedule).drop("_none", "_rate", "_repay", "_annuity", "_even")


def loan_schedule(with_loans: DataFrame, key: str) -> DataFrame:
    """One row per plan and month."""
    # the outer form: the plain one makes Spark test the size first and fold twice
    rows = with_loans.select(key, "grace_months", F.explode_outer("schedule").alias("s")).where(F.col("s").isNotNull())
    return rows.select(
        key, "s.month", F.when(F.col("s.month") <= F.col("grace_months"), "GRACE").otherwise("REPAYMENT").alias("phase"),
        "s.principal", "s.interest", "s.payment", "s.remaining")


def loan_summary(with_loans: DataFrame) -> DataFrame:
    """First payment, first after grace, largest payment and totals; zeros without a loan."""
    ready, rows, zero = F.col("loan.status") == "READY", F.col("schedule"), F.lit(0).cast("bigint")

    def of(c: Column) -> Column:
        return F.when(ready, F.coalesce(c, zero))

    def total(field: str) -> Column:
        return F.aggregate(rows, zero, lambda a, r: a + r[field])

    return with_loans.withColumns({
        "first_payment": of(F.get(rows, F.lit(0))["payment"]),
        "first_payment_after_grace": of(F.get(rows, F.coalesce(F.col("grace_months"), F.lit(0)))["payment"]),
        "maximum_payment": of(F.array_max(F.transform(rows, lambda r: r["payment"]))),
        "total_principal": of(total("principal")), "total_interest": of(total("interest"))})


# ---------------------------------------------------------------- scenarios

def expand_scenarios(totals: DataFrame, templates: Sequence[tuple[str, int, int, int]] = SCENARIOS) -> DataFrame:
    """Three rows per plan: percent changes on money rounded to won, rate points floored at zero."""
    t = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("rev"), F.lit(f).alias("fix"), F.lit(v).alias("var"))
                  for n, r, f, v in templates])
    d = totals.withColumn("_t", F.explode(t))

    def percent(c: Column, p: Column) -> Column:
        return half_up_div(wide(c) * (p + 100), F.lit(100))

    rate = rate_units(F.col("variable_cost_rate"))
    return d.withColumns({
        "scenario": F.col("_t.name"), "s_revenue": percent(F.col("monthly_revenue"), F.col("_t.rev")),
        "s_fixed": percent(F.col("fixed_cost_total.value"), F.col("_t.fix")),
        "s_rate": F.greatest(F.lit(0).cast("decimal(22,0)"), (rate + F.col("_t.var").cast("bigint") * (RATE_UNIT // 100)).cast("decimal(22,0)"))}).drop("_t")


def break_even(scenarios: DataFrame) -> DataFrame:
    """Operating balance, break-even revenues and first-month cash per plan and scenario.

    Needs the columns of ``loan_summary`` and ``expand_scenarios``.
    """
    fixed_missing = _missing(FIXED)
    rev = _missing({"monthly_revenue": "monthlyRevenue"})
    var = _missing({"variable_cost_rate": "variableCostRate"})
    debt = _missing({"existing_debt_payment": "existingMonthlyDebtPayment"})
    operating = F.concat(rev, fixed_missing, var)
    even = F.concat(fixed_missing, var)
    too_high = F.coalesce(F.col("s_rate") >= RATE_UNIT, F.lit(False))
    loan_bad = F.col("loan.status") == "UNSUPPORTED"
    loan_missing = F.coalesce(F.col("loan.missing_fields"), F.array().cast("array<string>"))
    margin = F.lit(RATE_UNIT) - F.col("s_rate")
    gross = wide(F.col("s_revenue")) * margin                        # parts of 10^-18 of a won
    fixed, first = F.col("s_fixed"), F.col("first_payment")
    old = F.col("existing_debt_payment")
    positive = F.when(margin > 0, margin)

    def with_debt(own: Column, value: Column) -> Column:
        # own inputs first, then the rate, then what the loan itself lacks
        miss = F.when((F.size(own) > 0) | too_high, own).otherwise(loan_missing)
        reason = F.when(too_high, F.lit("RATE_AT_LEAST_100")).otherwise(F.col("loan.reason"))
        return result(miss, value, too_high | loan_bad, reason)

    return scenarios.withColumns({
        "operating_balance": result(operating, half_up_div(gross - wide(fixed) * RATE_UNIT, F.lit(RATE_UNIT)), too_high, "RATE_AT_LEAST_100"),
        "operating_break_even": result(even, half_up_div(wide(fixed) * RATE_UNIT, positive), too_high, "RATE_AT_LEAST_100"),
        "debt_break_even": with_debt(F.concat(even, debt), half_up_div(wide(fixed + old + first) * RATE_UNIT, positive)),
        "first_month_cash": with_debt(F.concat(operating, debt),
                                      half_up_div(gross - wide(fixed + old + first) * RATE_UNIT, F.lit(RATE_UNIT)))})


def cash_runway(even: DataFrame) -> DataFrame:
    """Cash by month and the first negative month, per plan and scenario.

    ``cash_balances`` has, for every month, the loan payment, the cash left after debt and the closing
    balance. The balance after m months is ``opening + m * monthly margin - loan payments so far``; the
    payments so far are carried by the schedule, so no window over months is needed. What stands in the
    way is told in this order: missing inputs, a rate of 100 % or more, the opening cash, the loan.
    """
    empty = F.array().cast("array<string>")
    own = F.concat(_missing({"monthly_revenue": "monthlyRevenue"}), _missing(FIXED), _missing({"variable_cost_rate": "variableCostRate"}),
                   _missing({"existing_debt_payment": "existingMonthlyDebtPayment"}))
    too_high = F.coalesce(F.col("s_rate") >= RATE_UNIT, F.lit(False))
    status = (F.when(F.size(own) > 0, "INSUFFICIENT_INPUT").when(too_high, "UNSUPPORTED")
              .when(F.col("opening_cash.status") != "READY", F.col("opening_cash.status")).otherwise(F.col("loan.status")))
    missing = (F.when(F.size(own) > 0, own).when(too_high, empty).when(F.col("opening_cash.status") != "READY", F.col("opening_cash.missing_fields"))
               .otherwise(F.col("loan.missing_fields")))
    reason = F.when(status == "UNSUPPORTED", F.when(too_high, F.lit("RATE_AT_LEAST_100")).otherwise(F.col("loan.reason")))
    base = wide(F.col("s_revenue")) * (F.lit(RATE_UNIT) - F.col("s_rate")) - wide(F.col("s_fixed") + F.col("existing_debt_payment")) * RATE_UNIT
    zero = F.lit(0).cast("bigint")
    last = F.coalesce(F.get("schedule", F.size("schedule") - 1)["paid"], zero)

    def month(m: Column) -> Column:
        paid = F.coalesce(F.get("schedule", m - 1)["paid"], last)
        payment = F.coalesce(F.get("schedule", m - 1)["payment"], zero)
        units = wide(F.col("opening_cash.value")) * RATE_UNIT + base * m - wide(paid) * RATE_UNIT
        return F.struct(m.alias("month"), payment.alias("loan_payment"), half_up_div(base - wide(payment) * RATE_UNIT, F.lit(RATE_UNIT)).alias("after_debt"),
                        half_up_div(units, F.lit(RATE_UNIT)).alias("closing"))

    df = even.withColumns({"cash_status": status, "cash_missing": F.coalesce(missing, empty), "cash_reason": reason})
    df = df.withColumn("cash_balances", F.when(F.col("cash_status") == "READY", F.transform(F.sequence(F.lit(1), F.col("cash_months").cast("int")), month)))
    negative = F.get(F.filter("cash_balances", lambda r: r["closing"] < 0), F.lit(0))["month"]
    return df.withColumn("first_negative_month", negative)


# ---------------------------------------------------------------- inputs and keys

def validate_plans(raw: DataFrame, money: Sequence[str]) -> DataFrame:
    """Issues of a plan table whose amounts are text; null means not given and is fine."""
    rules = []
    for c in money:
        rules.append((f"INVALID_MONEY:{c}", F.col(c).isNotNull() & ~(F.col(c).rlike(r"^(0|[1-9]\d*)$") & (F.length(c) <= MAX_DIGITS))))
    number = r"^\d+(\.\d+)?$"

    def rate(c: str, bad) -> Column:
        ok_text = F.col(c).rlike(number) & (F.length(c) <= 20)
        return F.col(c).isNotNull() & (~ok_text | bad(F.when(ok_text, F.col(c)).try_cast("decimal(38,18)")))

    rules += [
        ("INVALID_VARIABLE_RATE", F.coalesce(rate("variable_cost_rate", lambda v: F.coalesce(v >= 1, F.lit(True))), F.lit(False))),
        ("INVALID_INTEREST_RATE", F.coalesce(rate("annual_rate", lambda v: F.coalesce(v > MAX_RATE_PERCENT, F.lit(True))), F.lit(False))),
        ("INVALID_TERM", F.coalesce(~F.col("total_months").between(1, MAX_MONTHS), F.lit(False))),
        ("INVALID_GRACE", F.coalesce(~F.col("grace_months").between(0, MAX_MONTHS - 1), F.lit(False))),
        ("INVALID_METHOD", F.coalesce(~F.col("repayment_method").isin(*METHODS), F.lit(False))),
        ("INVALID_CASH_MONTHS", ~F.coalesce(F.col("cash_months").between(1, MAX_CASH_MONTHS), F.lit(False))),
        ("GRACE_NOT_BELOW_TERM", F.coalesce(F.col("loan_principal").isNotNull() & (F.col("loan_principal") != "0")
                                            & (F.col("grace_months") >= F.col("total_months")), F.lit(False)))]
    return raw.withColumn("issues", issue_array(rules))


def calculation_key(plan_id: Column, revision: Column, input_version: Column, calc_version: Column) -> Column:
    """SHA-256 of what a stored result depends on."""
    return F.sha2(F.to_json(F.struct(plan_id.alias("planId"), revision.alias("inputRevision"),
                                     input_version.alias("inputSchemaVersion"), calc_version.alias("calculationVersion"))), 256)


def new_work(keyed: DataFrame, results: DataFrame, key: str = "calculation_key") -> DataFrame:
    """Plans whose key has no stored result."""
    return keyed.join(results.select(key).distinct(), key, "left_anti")


def keep_provenance(stored_prefix: str, next_prefix: str) -> Column:
    """True while all five loan values are unchanged; a stored value must exist."""
    same = F.col(f"{stored_prefix}loan_principal").isNotNull()
    for c in ("loan_principal", *LOAN_TERMS):
        same = same & F.col(f"{stored_prefix}{c}").eqNullSafe(F.col(f"{next_prefix}{c}"))
    return same
