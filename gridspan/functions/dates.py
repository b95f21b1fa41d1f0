"""Date and time functions over serial numbers of the 1900 system.

Tables keep DATE and TIMESTAMP columns; serials exist at the formula boundary only. `serial_of` and `date_of` convert.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import COMPAT, EXCEL, NUM, VALUE, Val, first_error, fx, guarded, lift, number, numeric

DAY_ZERO = "1899-12-31"


def date_of(serial: Column) -> Column:
    """The date of a serial; serial 60, the day that never was, is 1900-02-28."""
    n = F.floor(serial).cast("int")
    return F.date_add(F.to_date(F.lit(DAY_ZERO)), n - F.when(n >= 60, 1).otherwise(0))


def serial_of(date: Column, mode: str = COMPAT) -> Column:
    """The serial of a date. COMPAT gives 1900-03-01 the serial 60, EXCEL 61."""
    n = F.datediff(date, F.to_date(F.lit(DAY_ZERO)))
    return (n + F.when(n > (60 if mode == COMPAT else 59), 1).otherwise(0)).cast("double")


def moment_of(serial: Column) -> Column:
    """The timestamp of a serial, to the second."""
    return F.timestamp_seconds(F.unix_timestamp(date_of(serial).cast("timestamp")) + F.round((serial - F.floor(serial)) * 86400))


def serial_of_moment(moment: Column, mode: str = COMPAT) -> Column:
    """The serial of a timestamp with its fraction of a day."""
    return serial_of(F.to_date(moment), mode) + (F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)) / 86400.0


def when_of(x) -> Val:
    """A serial from a number, a date text or a DATE/TIMESTAMP column."""
    v = lift(x)
    if v.kind == "number":
        return guarded(v.value, (v.value < 0, NUM), args=(v,))
    plain = F.coalesce(v.value.cast("string"), F.lit("0"))
    as_number, as_date = plain.try_cast("double"), F.coalesce(plain.try_cast("timestamp"), F.try_to_timestamp(plain, F.lit("y/M/d")))
    got = F.coalesce(as_number, serial_of_moment(as_date))
    return guarded(got, (got.isNull(), VALUE), (got < 0, NUM), args=(v,))


@numeric("DATE", least=3)
def date(y, m, d):
    """Serial of a year, month and day; months and days carry over; years before 1900 count from there."""
    y, m, d = (F.floor(x).cast("int") for x in (y, m, d))
    year = y + F.when(y < 1900, 1900).otherwise(0)
    whole = year * 12 + m - 1
    first = F.make_date(F.floor(whole / 12).cast("int"), (F.pmod(whole, F.lit(12)) + 1).cast("int"), F.lit(1))
    out = serial_of(F.date_add(first, d - 1))
    return guarded(out, ((y < 0) | (year > 9999) | (out < 0), NUM))


@numeric("TIME", least=3)
def time(h, m, s):
    """Fraction of a day."""
    total = F.floor(h) * 3600 + F.floor(m) * 60 + F.floor(s)
    return guarded((total % 86400) / 86400.0, (total < 0, NUM))


def _part(name: str, f, source=date_of) -> None:
    def run(x):
        v = when_of(x)
        return Val(f(source(v.value)).cast("double"), v.err, "number")

    run.__doc__ = f"{name} of a serial or date text."
    fx(name)(run)


for _name, _f in {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth}.items():
    _part(_name, _f)
for _name, _f in {"HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second}.items():
    _part(_name, _f, moment_of)


@fx("TODAY", least=0)
def today():
    """Serial of the current date, one value a query."""
    return Val(serial_of(F.current_date()))


@fx("NOW", least=0)
def now():
    """Serial of the current moment, one value a query."""
    return Val(serial_of_moment(F.current_timestamp()))


@fx("DAYS", least=2)
def days(end, start):
    """Whole days from start to end."""
    b, a = when_of(end), when_of(start)
    return Val((F.floor(b.value) - F.floor(a.value)).cast("double"), first_error(b, a))


@fx("WEEKDAY", most=3)
def weekday(x, kind=1, _=None):
    """Number of the weekday; the kind says where weeks start."""
    v, k = when_of(x), number(kind)
    sunday = F.pmod(F.floor(v.value) - 1, F.lit(7))  # 0: Sunday
    out = F.when(k.value == 1, sunday + 1).when(k.value == 2, F.pmod(sunday - 1, F.lit(7)) + 1).when(k.value == 3, F.pmod(sunday - 1, F.lit(7))).otherwise(F.pmod(sunday - (k.value - 10), F.lit(7)) + 1)
    return guarded(out.cast("double"), (~(k.value.between(1, 3) | k.value.between(11, 17)), NUM), args=(v, k))


@fx("EDATE", least=2)
def edate(x, months):
    """The same day so many months on, at most the month's last."""
    v, m = when_of(x), number(months)
    return Val(serial_of(F.add_months(date_of(v.value), F.floor(m.value).cast("int"))), first_error(v, m))


@fx("EOMONTH", least=2, most=3)
def eomonth(x, months, mode=COMPAT):
    """Last day of a month so many months on. COMPAT ends December on the 30th and has every fourth year leap."""
    v, m = when_of(x), number(months)
    moved = F.add_months(F.trunc(date_of(v.value), "month"), F.floor(m.value).cast("int"))
    if mode == EXCEL:
        return Val(serial_of(F.last_day(moved), mode), first_error(v, m))
    month = F.month(moved)
    last = F.when(month == 12, 30).when(month == 2, F.when(F.year(moved) % 4 == 0, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return Val(serial_of(F.date_add(moved, last - 1)), first_error(v, m))


def days_30_360(a: Column, b: Column, european: Column | bool = False) -> Column:
    """Days between dates of twelve months of 30 days."""
    eu = F.lit(european) if isinstance(european, bool) else european
    d1, d2 = F.dayofmonth(a), F.dayofmonth(b)
    us1 = F.when((F.month(a) == 2) & (F.last_day(a) == a), 30).otherwise(F.least(d1, F.lit(30)))
    us2 = F.when((d2 == 31) & (us1 == 30), 30).otherwise(d2)
    e1, e2 = F.when(eu, F.least(d1, F.lit(30))).otherwise(us1), F.when(eu, F.least(d2, F.lit(30))).otherwise(us2)
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + e2 - e1


@fx("DAYS360", least=2, most=3)
def days360(start, end, european=False):
    """Days of a 360-day year."""
    a, b, eu = when_of(start), when_of(end), number(european)
    return Val(days_30_360(date_of(a.value), date_of(b.value), eu.value != 0).cast("double"), first_error(a, b, eu))


def year_fraction(a: Column, b: Column, basis: Column | int) -> Column:
    """Years between dates by one of five day counts; a Python basis leaves only its own count in the plan."""
    low, high = F.least(a, b), F.greatest(a, b)
    n = F.datediff(high, low)
    years = F.year(high) - F.year(low)
    leap = lambda y: (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    first, last = F.make_date(F.year(low), F.lit(1), F.lit(1)), F.make_date(F.year(high) + 1, F.lit(1), F.lit(1))
    over_a_year = F.add_months(low, 12) < high
    feb29 = leap(F.year(low)) & (F.month(low) <= 2) | leap(F.year(high)) & (high >= F.make_date(F.year(high), F.lit(3), F.lit(1)))
    actual = F.when(over_a_year, F.datediff(last, first) / (years + 1)).otherwise(F.when(feb29 | leap(F.year(low)) & (years == 0), 366.0).otherwise(365.0))
    counts = [days_30_360(low, high) / 360.0, n / actual, n / 360.0, n / 365.0, days_30_360(low, high, True) / 360.0]
    if isinstance(basis, int):
        return counts[basis] if 0 <= basis <= 4 else F.lit(None).cast("double")
    return F.when(basis == 0, counts[0]).when(basis == 1, counts[1]).when(basis == 2, counts[2]).when(basis == 3, counts[3]).otherwise(counts[4])


@fx("YEARFRAC", least=2, most=3)
def yearfrac(start, end, basis=0):
    """Years between dates."""
    a, b, k = when_of(start), when_of(end), number(basis)
    return guarded(year_fraction(date_of(a.value), date_of(b.value), basis if isinstance(basis, int) else F.floor(k.value)), (~F.floor(k.value).between(0, 4), NUM), args=(a, b, k))


@fx("DATEDIF", least=3)
def datedif(start, end, unit: str):
    """Whole years (Y), months (M) or days (D) between dates; MD, YM, YD leave out larger units."""
    a, b = when_of(start), when_of(end)
    x, y = date_of(a.value), date_of(b.value)
    months = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x) - F.when(F.dayofmonth(y) < F.dayofmonth(x), 1).otherwise(0)
    out = {
        "Y": F.floor(months / 12),
        "M": months,
        "D": F.datediff(y, x),
        "MD": F.datediff(y, F.add_months(x, months)),
        "YM": months % 12,
        "YD": F.datediff(y, F.add_months(x, (F.floor(months / 12) * 12).cast("int"))),
    }.get(unit.upper())
    if out is None:
        return Val(F.lit(None).cast("double"), F.lit(NUM))
    return guarded(out.cast("double"), (a.value > b.value, NUM), args=(a, b))


@fx("NETWORKDAYS", least=2, most=3)
def networkdays(start, end, holidays: Column | None = None):
    """Mondays to Fridays between serials, signed, less an array of holiday serials: closed form, no sequence of days."""
    a, b = when_of(start), when_of(end)
    low, high = F.floor(F.least(a.value, b.value)), F.floor(F.greatest(a.value, b.value))
    before = lambda n: F.floor((n + 5) / 7) * 5 + F.least(F.pmod(n + 5, F.lit(7)), F.lit(5))  # noqa: E731  serial 2 is a Monday
    n = before(high + 1) - before(low)
    if holidays is not None:
        n = n - F.size(F.filter(F.array_distinct(holidays), lambda h: (h >= low) & (h <= high) & (F.pmod(F.floor(h) - 2, F.lit(7)) < 5)))
    return Val((n * F.when(a.value > b.value, -1).otherwise(1)).cast("double"), first_error(a, b))
