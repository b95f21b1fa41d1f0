"""Time value of money, depreciation, bills and bonds, as closed forms and bounded in-row folds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .core import DIV0, NUM, VALUE, Val, finite, first_error, fx, guarded, number, numeric
from .dates import date_of, days_30_360, serial_of, when_of, year_fraction

#: Newton's stopping rule.
ROUNDS, CLOSE = 1000, 1e-7
#: Steps that a batch takes together, and how far from zero its rates may lie.
TOGETHER, NEAR = 20, 10.0


def _or0(x: Column | None) -> Column:
    return F.lit(0.0) if x is None else x


def future(rate: Column, n: Column, pmt: Column, pv: Column, due: Column) -> Column:
    """Future value of payments and a present value."""
    g = F.pow(1 + rate, n)
    return F.when(rate == 0, -(pv + pmt * n)).otherwise(-(pv * g + pmt * (1 + rate * due) * F.try_divide(g - 1, rate)))


def payment(rate: Column, n: Column, pv: Column, fv: Column, due: Column) -> Column:
    """Level payment."""
    g = F.pow(1 + rate, n)
    return F.when(rate == 0, F.try_divide(-(pv + fv), n)).otherwise(F.try_divide(-(pv * g + fv) * rate, (1 + rate * due) * (g - 1)))


def interest(rate: Column, per: Column, n: Column, pv: Column, fv: Column, due: Column) -> Column:
    """Interest part of the payment of a period."""
    pmt = payment(rate, n, pv, fv, due)
    whole = future(rate, per - 1, pmt, pv, due) * rate
    return F.when((per == 1) & (due == 1), 0.0).otherwise(F.when(due == 1, F.try_divide(whole - pmt * rate, 1 + rate)).otherwise(whole))


@numeric("FV", least=3, most=5)
def fv(rate, n, pmt, pv=None, due=None):
    """Future value."""
    return future(rate, n, pmt, _or0(pv), _or0(due))


@numeric("PV", least=3, most=5)
def pv(rate, n, pmt, fv=None, due=None):
    """Present value."""
    g = F.pow(1 + rate, n)
    return F.when(rate == 0, -(_or0(fv) + pmt * n)).otherwise(F.try_divide(-(_or0(fv) + pmt * (1 + rate * _or0(due)) * F.try_divide(g - 1, rate)), g))


@numeric("PMT", least=3, most=5)
def pmt(rate, n, pv, fv=None, due=None):
    """Level payment."""
    return guarded(payment(rate, n, pv, _or0(fv), _or0(due)), (n == 0, NUM))


@numeric("IPMT", least=4, most=6)
def ipmt(rate, per, n, pv, fv=None, due=None):
    """Interest part of a payment."""
    return guarded(interest(rate, per, n, pv, _or0(fv), _or0(due)), ((per < 1) | (per > n), NUM))


@numeric("PPMT", least=4, most=6)
def ppmt(rate, per, n, pv, fv=None, due=None):
    """Principal part of a payment."""
    a = (rate, per, n, pv, _or0(fv), _or0(due))
    return guarded(payment(rate, n, pv, a[4], a[5]) - interest(*a), ((per < 1) | (per > n), NUM))


def _cumulated(rate, n, pv, first, last, due, part) -> Val:
    total = F.aggregate(F.sequence(F.floor(first).cast("int"), F.greatest(F.floor(first), F.floor(last)).cast("int")), F.lit(0.0), lambda s, k: s + part(k.cast("double")))
    return guarded(total, ((rate <= 0) | (n <= 0) | (pv <= 0) | (first < 1) | (last < first) | (last > n), NUM))


@numeric("CUMIPMT", least=6)
def cumipmt(rate, n, pv, first, last, due):
    """Interest of a run of payments."""
    return _cumulated(rate, n, pv, first, last, due, lambda k: interest(rate, k, n, pv, F.lit(0.0), due))


@numeric("CUMPRINC", least=6)
def cumprinc(rate, n, pv, first, last, due):
    """Principal of a run of payments."""
    return _cumulated(rate, n, pv, first, last, due, lambda k: payment(rate, n, pv, F.lit(0.0), due) - interest(rate, k, n, pv, F.lit(0.0), due))


@numeric("NPER", least=3, most=5)
def nper(rate, pmt, pv, fv=None, due=None):
    """Number of periods."""
    f, d = _or0(fv), _or0(due)
    k = pmt * (1 + rate * d)
    ratio = F.try_divide(k - f * rate, k + pv * rate)
    return finite(Val(F.when(rate == 0, F.try_divide(-(pv + f), pmt)).otherwise(F.try_divide(F.ln(ratio), F.ln(1 + rate)))))


@F.pandas_udf(DoubleType())
def _rate(n, pmt, pv, fv, due, guess):
    """Newton on the balance at the end, a whole batch at a time."""
    import numpy as np

    r = guess.to_numpy(float).copy()
    n, pmt, pv, fv, due = (x.to_numpy(float) for x in (n, pmt, pv, fv, due))

    def balance(r):
        g = (1 + r) ** n
        return np.where(np.abs(r) < 1e-12, pv + pmt * n + fv, pv * g + pmt * (1 + r * due) * (g - 1) / np.where(r == 0, 1, r) + fv)

    with np.errstate(all="ignore"):
        done = np.zeros(len(r), bool)
        for _ in range(ROUNDS):
            y, slope = balance(r), (balance(r + 1e-6) - balance(r - 1e-6)) / 2e-6
            new = np.where(done, r, r - y / slope)
            done |= np.abs(new - r) < CLOSE
            r = new
            if done.all() or not np.isfinite(r[~done]).any():
                break
        import pandas as pd

        return pd.Series(np.where(done & np.isfinite(r), r, np.nan))


@numeric("RATE", least=3, most=6)
def rate(n, pmt, pv, fv=None, due=None, guess=None):
    """Rate a period; no number where Newton's steps do not settle."""
    return finite(Val(_rate(n, pmt, pv, _or0(fv), _or0(due), F.lit(0.1) if guess is None else guess)))


@numeric("EFFECT", least=2)
def effect(nominal, n):
    """Effective yearly rate."""
    n = F.floor(n)
    return guarded(F.pow(1 + F.try_divide(nominal, n), n) - 1, ((nominal <= 0) | (n <= 1), NUM))


@numeric("NOMINAL", least=2)
def nominal(effective, n):
    """Nominal yearly rate."""
    n = F.floor(n)
    return guarded(n * (F.pow(1 + effective, F.try_divide(F.lit(1.0), n)) - 1), ((effective <= 0) | (n < 1), NUM))


@numeric("PDURATION", least=3)
def pduration(rate, pv, fv):
    """Periods until a value is reached."""
    return guarded(F.try_divide(F.ln(F.try_divide(fv, pv)), F.ln(1 + rate)), ((rate <= 0) | (pv <= 0) | (fv <= 0), NUM))


@numeric("RRI", least=3)
def rri(n, pv, fv):
    """Rate of growth between two values."""
    return finite(Val(F.pow(F.try_divide(fv, pv), F.try_divide(F.lit(1.0), n)) - 1))


@numeric("SLN", least=3)
def sln(cost, salvage, life):
    """Straight-line depreciation."""
    return guarded(F.try_divide(cost - salvage, life), (life == 0, DIV0))


@numeric("SYD", least=4)
def syd(cost, salvage, life, per):
    """Sum-of-years'-digits depreciation."""
    return guarded(F.try_divide((cost - salvage) * (life - per + 1) * 2, life * (life + 1)), ((life <= 0) | (per < 1) | (per > life), NUM))


@numeric("DB", least=4, most=5)
def db(cost, salvage, life, per, months=None):
    """Fixed-declining depreciation, the rate rounded to three digits."""
    m = F.lit(12.0) if months is None else months
    rate = F.round(1 - F.pow(F.try_divide(salvage, cost), F.try_divide(F.lit(1.0), life)), 3)
    first = cost * rate * m / 12
    before = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(per)).cast("int")), F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("now")), lambda s, k: F.struct((s["sum"] + s["now"]).alias("sum"), F.when(k == 1, first).when(k == life + 1, (cost - s["sum"] - s["now"]) * rate * (12 - m) / 12).otherwise((cost - s["sum"] - s["now"]) * rate).alias("now")), lambda s: s["now"])
    return guarded(before, ((cost < 0) | (salvage < 0) | (life <= 0) | (per < 1) | (per > life + F.when(m < 12, 1).otherwise(0)), NUM))


@numeric("DDB", least=4, most=5)
def ddb(cost, salvage, life, per, factor=None):
    """Declining-balance depreciation down to the salvage value."""
    f = F.lit(2.0) if factor is None else factor
    out = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(per)).cast("int")), F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("now")), lambda s, k: F.struct((s["sum"] + s["now"]).alias("sum"), F.greatest(F.lit(0.0), F.least((cost - s["sum"] - s["now"]) * F.try_divide(f, life), cost - salvage - s["sum"] - s["now"])).alias("now")), lambda s: s["now"])
    return guarded(out, ((cost < 0) | (salvage < 0) | (life <= 0) | (per < 1) | (per > life) | (f <= 0), NUM))


# Aggregates over a column of flows.


def npv(rate: float | Column, flow: Column, position: Column) -> Column:
    """NPV of a grouped column: the flow at position 1 is discounted once."""
    return F.sum(flow / F.pow(1 + (rate if isinstance(rate, Column) else F.lit(float(rate))), position))


def xnpv(rate: float, flow: Column, day: Column, first_day: Column) -> Column:
    """Date-weighted NPV of a grouped column."""
    return F.sum(flow / F.pow(F.lit(1.0 + rate), F.datediff(day, first_day) / 365.0))


def _newton(flows: list[tuple[float, float]], guess: float) -> float | None:
    """Newton's steps for one list of flows (power, v)."""
    f = lambda r: sum(v / (1 + r) ** p for p, v in flows)
    r = guess
    for _ in range(ROUNDS):
        try:
            y, slope = f(r), (f(r + 1e-6) - f(r - 1e-6)) / 2e-6
            new = r - y / slope
        except (ZeroDivisionError, OverflowError, TypeError):
            return None
        if isinstance(new, complex) or not math.isfinite(new):
            return None
        if abs(new - r) < CLOSE:
            return new
        r = new
    return None


def _roots(flows: pa.Array, guess: pa.Array, least: float) -> pa.Array:
    """The rate of each list of flows (w, v) by Newton's steps; null where none is found.

    All lists of a batch step at once. Those that do not settle soon, or far from zero, where the steps hang on the last
    digit, are stepped through alone.
    """
    n = len(flows)
    owner = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(flows), 0).to_numpy(zero_copy_only=False))
    flat = flows.flatten()
    w, v = (pc.struct_field(flat, [c]).to_numpy(zero_copy_only=False).astype(float) for c in ("w", "v"))
    there = np.array(pc.and_(pc.is_valid(pc.struct_field(flat, ["w"])), pc.is_valid(pc.struct_field(flat, ["v"]))).to_numpy(zero_copy_only=False), bool)
    owner, w, v = owner[there], w[there], v[there]
    order = np.lexsort((v, w, owner))
    owner, w, v = owner[order], w[order], v[order]
    counts = np.bincount(owner, minlength=n)
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    begin = np.zeros(n)
    begin[some] = w[starts]
    power = (w - begin[owner]) / least
    out = np.full(n, np.nan)
    live = (np.bincount(owner[v > 0], minlength=n) > 0) & (np.bincount(owner[v < 0], minlength=n) > 0)
    rate = guess.to_numpy(zero_copy_only=False).astype(float)
    two_signs, every, first = np.flatnonzero(live), (power, v), rate
    offsets = np.r_[0, np.cumsum(counts)]
    with np.errstate(all="ignore"):
        for _ in range(TOGETHER):
            if not live.any():
                break
            mine = live[owner]
            owner, power, v = owner[mine], power[mine], v[mine]

            def value(r):
                grown = np.power((1 + r)[owner], power)
                # a power beyond all doubles, or a division by zero, ends the search
                return np.bincount(owner, np.where(np.isfinite(grown) & (grown != 0), v / grown, np.nan), n)  # noqa: B023

            new = rate - value(rate) / ((value(rate + 1e-6) - value(rate - 1e-6)) / 2e-6)
            live = live & np.isfinite(new)
            settled = live & (np.abs(new - rate) < CLOSE)
            out[settled] = new[settled]
            live &= ~settled
            rate = np.where(live, new, rate)
    power, v = every
    for i in two_signs[~(np.abs(out[two_signs]) < NEAR)].tolist():
        own = slice(offsets[i], offsets[i + 1])
        got = _newton(list(zip(power[own].tolist(), v[own].tolist(), strict=True)), float(first[i]))
        out[i] = np.nan if got is None else got
    return pa.array(out, mask=np.isnan(out))


@F.arrow_udf(DoubleType())
def _irr(flows: pa.Array, guess: pa.Array) -> pa.Array:
    return _roots(flows, guess, 1.0)


@F.arrow_udf(DoubleType())
def _xirr(flows: pa.Array, guess: pa.Array) -> pa.Array:
    return _roots(flows, guess, 365.0)


def irr(flow: Column, position: Column, guess: float = 0.1) -> Column:
    """IRR of a grouped column: null where no rate is found. A group is one investment's flows."""
    return _irr(F.collect_list(F.struct(position.cast("double").alias("w"), flow.cast("double").alias("v"))), F.lit(guess))


def xirr(flow: Column, day: Column, guess: float = 0.1) -> Column:
    """XIRR of a grouped column: null where no rate is found."""
    return _xirr(F.collect_list(F.struct(F.datediff(day, F.to_date(F.lit("1899-12-30"))).cast("double").alias("w"), flow.cast("double").alias("v"))), F.lit(guess))


# Bills and bonds.


def _bond(name: str, n_plain: int, least: int, most: int, order: bool = True):
    """Register a function of two dates, plain numbers and a basis that may be left out (the last argument)."""

    def put(f):
        def run(*args):
            a, b = when_of(args[0]), when_of(args[1])
            plain = [number(x) for x in args[2 : 2 + n_plain]]
            raw = args[2 + n_plain] if len(args) > 2 + n_plain else 0
            basis = number(raw)
            got = f(date_of(a.value), date_of(b.value), *(p.value for p in plain), raw if isinstance(raw, int) else F.floor(basis.value))
            got = got if isinstance(got, Val) else Val(got)
            rules = F.when((a.value <= 0) | (b.value <= 0), VALUE).when(~F.floor(basis.value).between(0, 4), NUM)
            if order:
                rules = rules.when(a.value >= b.value, NUM)
            return Val(got.value, F.coalesce(first_error(a, b, *plain, basis), rules, got.err))

        run.__doc__ = f.__doc__
        return fx(name, least=least, most=most)(run)

    return put


@_bond("DISC", 2, 4, 5)
def disc(settle, mature, price, redemption, basis):
    """Discount rate."""
    return guarded(F.try_divide(redemption - price, redemption * year_fraction(settle, mature, basis)), ((price <= 0) | (redemption <= 0), NUM))


@_bond("INTRATE", 2, 4, 5)
def intrate(settle, mature, investment, redemption, basis):
    """Rate of a fully invested security."""
    return guarded(F.try_divide(redemption - investment, investment * year_fraction(settle, mature, basis)), ((investment <= 0) | (redemption <= 0), NUM))


@_bond("RECEIVED", 2, 4, 5)
def received(settle, mature, investment, discount, basis):
    """Amount at maturity."""
    return guarded(F.try_divide(investment, 1 - discount * year_fraction(settle, mature, basis)), ((investment <= 0) | (discount <= 0), NUM))


@_bond("PRICEDISC", 2, 4, 5)
def pricedisc(settle, mature, discount, redemption, basis):
    """Price of a discounted security."""
    return guarded(redemption * (1 - discount * year_fraction(settle, mature, basis)), ((discount <= 0) | (redemption <= 0), NUM))


@_bond("YIELDDISC", 2, 4, 5)
def yielddisc(settle, mature, price, redemption, basis):
    """Yield of a discounted security."""
    return guarded(F.try_divide(redemption - price, price * year_fraction(settle, mature, basis)), ((price <= 0) | (redemption <= 0), NUM))


def _at_maturity(f):
    def run(settle, mature, issue, *rest):
        # issue comes as a serial among the plain numbers
        issued = date_of(issue)
        basis = rest[-1]
        return f(year_fraction(issued, mature, basis), year_fraction(issued, settle, basis), year_fraction(settle, mature, basis), *rest[:-1])

    run.__doc__ = f.__doc__
    return run


@_bond("PRICEMAT", 3, 5, 6)
@_at_maturity
def pricemat(dim, a, dsm, rate, yld):
    """Price of a security with interest at maturity."""
    return guarded(F.try_divide(100 + dim * rate * 100, 1 + dsm * yld) - a * rate * 100, ((rate < 0) | (yld < 0), NUM))


@_bond("YIELDMAT", 3, 5, 6)
@_at_maturity
def yieldmat(dim, a, dsm, rate, price):
    """Yield of a security with interest at maturity."""
    return guarded(F.try_divide(F.try_divide(1 + dim * rate, price / 100 + a * rate) - 1, dsm), ((rate < 0) | (price <= 0), NUM))


@fx("ACCRINT", least=6, most=7)
def accrint(issue, first, settle, rate, par, frequency, basis=0):
    """Interest from issue to settlement; first interest date and frequency are checked only."""
    a, f, b, r, p, q, k = when_of(issue), when_of(first), when_of(settle), number(rate), number(par), number(frequency), number(basis)
    return guarded(p.value * r.value * year_fraction(date_of(a.value), date_of(b.value), basis if isinstance(basis, int) else F.floor(k.value)), ((a.value >= b.value) | (r.value <= 0) | (p.value <= 0) | ~F.floor(q.value).isin(1, 2, 4) | ~F.floor(k.value).between(0, 4), NUM), args=(a, f, b, r, p, q, k))


@_bond("ACCRINTM", 2, 4, 5)
def accrintm(issue, settle, rate, par, basis):
    """Interest from issue to maturity."""
    return guarded(par * rate * year_fraction(issue, settle, basis), ((rate <= 0) | (par <= 0), NUM))


@_bond("TBILLPRICE", 1, 3, 3)
def tbillprice(settle, mature, discount, basis):
    """Price of a bill for 100."""
    return guarded(100 * (1 - discount * F.datediff(mature, settle) / 360.0), (discount <= 0, NUM), (F.datediff(mature, settle) > 366, NUM))


@_bond("TBILLYIELD", 1, 3, 3)
def tbillyield(settle, mature, price, basis):
    """Yield of a bill."""
    return guarded(F.try_divide((100 - price) * 360.0, price * F.datediff(mature, settle)), (price <= 0, NUM), (F.datediff(mature, settle) > 366, NUM))


@_bond("TBILLEQ", 1, 3, 3)
def tbilleq(settle, mature, discount, basis):
    """Bond-equivalent yield of a bill."""
    n = F.datediff(mature, settle)
    short = F.try_divide(365 * discount, 360 - discount * n)
    price = (100 - discount * 100 * n / 360) / 100
    term = n / F.when(n == 366, 366.0).otherwise(365.0)
    long = F.try_divide(-2 * term + 2 * F.sqrt(term * term - (2 * term - 1) * (1 - F.try_divide(F.lit(1.0), price))), 2 * term - 1)
    return guarded(F.when(n <= 182, short).otherwise(long), ((discount <= 0) | (n > 366), NUM))


def coupons_left(settle: Column, mature: Column, frequency: Column) -> Column:
    """Coupons payable between settlement and maturity."""
    step = (12 / frequency).cast("int")
    months = (F.year(mature) - F.year(settle)) * 12 + F.month(mature) - F.month(settle)
    near = F.floor(months / step).cast("int")
    return near + F.when(F.add_months(mature, -near * step) > settle, 1).otherwise(0)


def coupon_before(settle: Column, mature: Column, frequency: Column) -> Column:
    """The last coupon date at or before settlement."""
    return F.add_months(mature, (-coupons_left(settle, mature, frequency) * (12 / frequency)).cast("int"))


def coupon_after(settle: Column, mature: Column, frequency: Column) -> Column:
    """The first coupon date after settlement."""
    return F.add_months(mature, (-(coupons_left(settle, mature, frequency) - 1) * (12 / frequency)).cast("int"))


def _coupon(name, f):
    def run(settle, mature, frequency, basis):
        q = F.floor(frequency)
        return guarded(f(settle, mature, F.when(q.isin(1, 2, 4), q).otherwise(1)), (~q.isin(1, 2, 4), NUM))

    run.__doc__ = f"{name} of a bond."
    _bond(name, 1, 3, 4)(run)


_coupon("COUPNUM", lambda s, m, q: coupons_left(s, m, q).cast("double"))
_coupon("COUPPCD", lambda s, m, q: serial_of(coupon_before(s, m, q)))
_coupon("COUPNCD", lambda s, m, q: serial_of(coupon_after(s, m, q)))


@_bond("PRICE", 4, 6, 7)
def price(settle, mature, rate, yld, redemption, frequency, basis):
    """Price of a coupon bond for 100: a fold over its coupons."""
    q = F.when(F.floor(frequency).isin(1, 2, 4), F.floor(frequency)).otherwise(1)
    basis = F.lit(basis) if isinstance(basis, int) else basis
    before, after = coupon_before(settle, mature, q), coupon_after(settle, mature, q)
    n = coupons_left(settle, mature, q)
    span = F.when(basis == 1, F.datediff(after, before)).when(basis == 3, 365.0 / q).otherwise(360.0 / q)
    thirty = basis.isin(0, 4)
    gone = F.when(thirty, days_30_360(before, settle)).otherwise(F.datediff(settle, before))
    left = F.when(thirty, span - gone).otherwise(F.datediff(after, settle))
    part, coupon = left / span, 100 * rate / q
    growth = 1 + yld / q
    one = F.try_divide(redemption + coupon, 1 + part * yld / q) - coupon * gone / span
    many = F.try_divide(redemption, F.pow(growth, n - 1 + part)) + F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, k: s + F.try_divide(coupon, F.pow(growth, k - 1 + part))) - coupon * gone / span
    return guarded(F.when(n == 1, one).otherwise(many), ((rate < 0) | (yld < 0) | (redemption <= 0) | ~F.floor(frequency).isin(1, 2, 4), NUM))
