"""Queries of the formula functions: families applied to table columns, one projection or one aggregate each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspan.functions import aggregates as A
from gridspan.functions import call
from gridspan.functions.core import EXCEL, Val, add, compare, concat, divide, multiply, negate, percent, power, subtract
from gridspan.functions.dates import serial_of
from gridspan.functions.finance import irr, npv, xirr, xnpv

from .registry import register, table


def put(df, keys: list[str], digits: int | None, **vals: Val):
    """Keys, then the value of each function (rounded) where it is no error."""
    out = [(F.round(v.column(), digits) if digits is not None else v.column()).alias(n) for n, v in vals.items()]
    return df.select(*keys, *out)


def col(name: str) -> Column:
    """A column as a double."""
    return F.col(name).cast("double")


@register(
    "fn_operators",
    """SELECT p_partkey, p_size + p_retailprice AS v_add, p_size - p_retailprice AS v_sub, p_size * p_retailprice AS v_mul,
    CASE WHEN p_size = 1 THEN NULL ELSE p_retailprice / (p_size - 1) END AS v_div, CASE WHEN p_size = 1 THEN '#DIV/0!' END AS e_div,
    CAST(p_size AS DOUBLE) ^ 2 AS v_pow, -CAST(p_size AS DOUBLE) AS v_neg, p_size / 100.0::DOUBLE AS v_pct, p_brand || '-' || CAST(p_size AS VARCHAR) AS v_cat,
    p_size < 25 AS v_lt, p_type = 'PROMO' AS v_eq FROM part""",
)
def fn_operators(spark, sf_dir):
    """Operators with coercion and the error lane."""
    df, size, price = table(spark, sf_dir, "part"), F.col("p_size"), F.col("p_retailprice")
    q = divide(price, subtract(size, 1))
    return df.select(
        "p_partkey", add(size, price).column().alias("v_add"), subtract(size, price).column().alias("v_sub"), multiply(size, price).column().alias("v_mul"), q.column().alias("v_div"), q.err.alias("e_div"),
        power(size, 2).column().alias("v_pow"), negate(size).column().alias("v_neg"), percent(size).column().alias("v_pct"), concat(concat(F.col("p_brand"), "-"), size).column().alias("v_cat"),
        compare(size, "<", 25).column().alias("v_lt"), compare(F.col("p_type"), "=", "PROMO").column().alias("v_eq"),
    )


@register(
    "fn_math",
    """SELECT p_partkey, ABS(500 - p_retailprice) AS v_abs, ROUND(EXP(p_size / 10.0), 6) AS v_exp, ROUND(LN(p_size), 6) AS v_ln, ROUND(LN(p_size) / LN(2), 6) AS v_log2,
    ROUND(LOG10(p_size), 6) AS v_log10, ROUND(SQRT(p_size), 6) AS v_sqrt, ROUND(SQRT(PI() * p_size), 6) AS v_sqrtpi, ROUND(POWER(p_size, 1.5), 4) AS v_power,
    p_size % 7 + 0.0::DOUBLE AS v_mod, FLOOR(p_size / 7.0)::DOUBLE AS v_quot, SIGN(p_size - 25)::DOUBLE AS v_sign, CASE WHEN p_size <= 20 THEN FACTORIAL(p_size::INTEGER)::DOUBLE END AS v_fact,
    p_size * (p_size - 1) / 2.0::DOUBLE AS v_combin, p_size * (p_size - 1.0::DOUBLE) AS v_permut, GCD(p_size, 36)::DOUBLE AS v_gcd, LCM(p_size, 36)::DOUBLE AS v_lcm,
    ROUND(DEGREES(p_size), 6) AS v_deg, ROUND(RADIANS(p_size), 6) AS v_rad, ROUND((p_size - 25) / 10.0, 6)::DOUBLE AS v_std FROM part""",
)
def fn_math(spark, sf_dir):
    """Mathematical functions."""
    x, p = col("p_size"), col("p_retailprice")
    return put(
        table(spark, sf_dir, "part"), ["p_partkey"], None, v_abs=call("ABS", subtract(500, p)), v_exp=call("ROUND", call("EXP", x / 10), 6), v_ln=call("ROUND", call("LN", x), 6), v_log2=call("ROUND", call("LOG", x, 2), 6),
        v_log10=call("ROUND", call("LOG10", x), 6), v_sqrt=call("ROUND", call("SQRT", x), 6), v_sqrtpi=call("ROUND", call("SQRTPI", x), 6), v_power=call("ROUND", call("POWER", x, 1.5), 4),
        v_mod=call("MOD", x, 7), v_quot=call("QUOTIENT", x, 7), v_sign=call("SIGN", x - 25), v_fact=call("FACT", F.when(x <= 20, x).otherwise(-1.0)), v_combin=call("IF", compare(x, ">=", 2), call("COMBIN", F.greatest(x, F.lit(2.0)), 2), 0.0),
        v_permut=call("IF", compare(x, ">=", 2), call("PERMUT", F.greatest(x, F.lit(2.0)), 2), 0.0), v_gcd=call("GCD", x, 36), v_lcm=call("LCM", x, 36), v_deg=call("ROUND", call("DEGREES", x), 6), v_rad=call("ROUND", call("RADIANS", x), 6), v_std=call("ROUND", call("STANDARDIZE", x, 25, 10), 6),
    )


@register(
    "fn_trig",
    """SELECT p_partkey, """
    + ", ".join(f"ROUND({sql}, 6) AS {n}" for n, sql in {"v_sin": "SIN(p_size)", "v_cos": "COS(p_size)", "v_tan": "TAN(p_size)", "v_cot": "1 / TAN(p_size)", "v_csc": "1 / SIN(p_size)", "v_asin": "ASIN(p_size / 51.0)", "v_acos": "ACOS(p_size / 51.0)", "v_atan": "ATAN(p_size)", "v_atan2": "ATAN2(p_size, 3)", "v_sinh": "SINH(p_size / 10.0)", "v_cosh": "COSH(p_size / 10.0)", "v_tanh": "TANH(p_size / 10.0)", "v_coth": "1 / TANH(p_size / 10.0)", "v_asinh": "ASINH(p_size)", "v_acosh": "ACOSH(p_size)", "v_atanh": "ATANH(p_size / 51.0)"}.items())
    + " FROM part",
)
def fn_trig(spark, sf_dir):
    """Trigonometric and hyperbolic functions."""
    x = col("p_size")
    used = {"sin": x, "cos": x, "tan": x, "cot": x, "csc": x, "asin": x / 51, "acos": x / 51, "atan": x, "sinh": x / 10, "cosh": x / 10, "tanh": x / 10, "coth": x / 10, "asinh": x, "acosh": x, "atanh": x / 51}
    vals = {f"v_{n}": call(n, a) for n, a in used.items()} | {"v_atan2": call("ATAN2", 3, x)}
    return put(table(spark, sf_dir, "part"), ["p_partkey"], 6, **vals)


@register(
    "fn_rounding",
    """SELECT p_partkey, SIGN(p_retailprice) * FLOOR(ABS(p_retailprice) * 10 + 0.5) / 10 AS v_round, TRUNC(p_retailprice * 10) / 10 AS v_down, CEIL(p_retailprice * 10) / 10 AS v_up, TRUNC(p_retailprice) AS v_trunc,
    CEIL(p_retailprice / 5) * 5 AS v_ceiling, FLOOR(p_retailprice / 5) * 5 AS v_floor, FLOOR(p_retailprice / 5 + 0.5) * 5 AS v_mround, FLOOR(p_retailprice) AS v_int,
    2 * CEIL(p_retailprice / 2) AS v_even, 2 * CEIL((p_retailprice - 1) / 2) + 1 AS v_odd, p_size % 2 = 0 AS v_iseven, p_size % 2 = 1 AS v_isodd FROM part""",
)
def fn_rounding(spark, sf_dir):
    """Rounding functions."""
    p, s = col("p_retailprice"), col("p_size")
    return put(
        table(spark, sf_dir, "part"), ["p_partkey"], None, v_round=call("ROUND", p, 1), v_down=call("ROUNDDOWN", p, 1), v_up=call("ROUNDUP", p, 1), v_trunc=call("TRUNC", p), v_ceiling=call("CEILING", p, 5), v_floor=call("FLOOR", p, 5),
        v_mround=call("MROUND", p, 5), v_int=call("INT", p), v_even=call("EVEN", p), v_odd=call("ODD", p), v_iseven=call("ISEVEN", s), v_isodd=call("ISODD", s),
    )


@register(
    "fn_text",
    """SELECT p_partkey, UPPER(p_name) AS v_upper, LOWER(p_name) AS v_lower, LENGTH(p_name)::DOUBLE AS v_len, STRLEN(p_name)::DOUBLE AS v_lenb, LEFT(p_name, 4) AS v_left, RIGHT(p_name, 3) AS v_right, SUBSTR(p_name, 2, 3) AS v_mid,
    SUBSTR(p_name, 1, 1) || 'XY' || SUBSTR(p_name, 4) AS v_replace, REPLACE(p_name, 'a', '_') AS v_subst, REPEAT(p_brand, 2) AS v_rept, p_brand || ' ' || p_type AS v_concat, p_brand || '/' || p_type AS v_join,
    NULLIF(INSTR(p_name, 'a'), 0)::DOUBLE AS v_find, NULLIF(INSTR(LOWER(p_name), 'a'), 0)::DOUBLE AS v_search, p_name = p_brand AS v_exact, ASCII(p_name)::DOUBLE AS v_code, CHR(64 + p_size % 26 + 1) AS v_char,
    TRIM('  ' || p_brand || ' ') AS v_trim, REGEXP_MATCHES(p_name, '[0-9]') AS v_test, REGEXP_REPLACE(p_name, '[0-9]+', 'N', 'g') AS v_rrep, NULLIF(REGEXP_EXTRACT(p_name, '[0-9]+'), '') AS v_rext,
    TRY_CAST(REGEXP_EXTRACT(p_brand, '[0-9]+') AS DOUBLE) AS v_value FROM part""",
)
def fn_text(spark, sf_dir):
    """Text and regular-expression functions."""
    n, b, t, s = F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size")
    return put(
        table(spark, sf_dir, "part"), ["p_partkey"], None, v_upper=call("UPPER", n), v_lower=call("LOWER", n), v_len=call("LEN", n), v_lenb=call("LENB", n), v_left=call("LEFT", n, 4), v_right=call("RIGHT", n, 3), v_mid=call("MID", n, 2, 3),
        v_replace=call("REPLACE", n, 2, 2, "XY"), v_subst=call("SUBSTITUTE", n, "a", "_"), v_rept=call("REPT", b, 2), v_concat=call("CONCAT", b, " ", t), v_join=call("TEXTJOIN", "/", True, b, "", t),
        v_find=call("FIND", "a", n), v_search=call("SEARCH", "A", n), v_exact=call("EXACT", n, b), v_code=call("CODE", n), v_char=call("CHAR", s % 26 + 65),
        v_trim=call("TRIM", concat(concat("  ", b), " ")), v_test=call("REGEXTEST", n, "[0-9]"), v_rrep=call("REGEXREPLACE", n, "[0-9]+", "N"), v_rext=call("REGEXEXTRACT", n, "[0-9]+"), v_value=call("VALUE", call("REGEXEXTRACT", b, "[0-9]+")),
    )


@register(
    "fn_text_forms",
    """SELECT o_orderkey, FORMAT('{:,.2f}', o_totalprice) AS v_fixed, '$' || FORMAT('{:,.1f}', FLOOR(o_totalprice * 10 + 0.5) / 10) AS v_dollar, FORMAT('{:.0f}', FLOOR(o_totalprice + 0.5)) AS v_text0, strftime(o_orderdate, '%Y-%m-%d') AS v_date FROM orders""",
)
def fn_text_forms(spark, sf_dir):
    """Numbers and dates as text."""
    df, p = table(spark, sf_dir, "orders"), F.col("o_totalprice")
    return put(df, ["o_orderkey"], None, v_fixed=call("FIXED", p, 2), v_dollar=call("DOLLAR", p, 1), v_text0=call("TEXT", p, "0"), v_date=call("TEXT", serial_of(F.to_date("o_orderdate")), "yyyy-mm-dd"))


@register(
    "fn_dates",
    """WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT o_orderkey, (d - DATE '1899-12-30')::DOUBLE AS v_serial, YEAR(d)::DOUBLE AS v_year, MONTH(d)::DOUBLE AS v_month, DAY(d)::DOUBLE AS v_day, (DAYOFWEEK(d) + 1)::DOUBLE AS v_weekday, ISODOW(d)::DOUBLE AS v_weekday2,
    (CAST(d + INTERVAL 5 MONTH AS DATE) - DATE '1899-12-30')::DOUBLE AS v_edate, (LAST_DAY(CAST(d + INTERVAL 2 MONTH AS DATE)) - DATE '1899-12-30')::DOUBLE AS v_eomonth,
    (DATE '2002-01-01' - d)::DOUBLE AS v_days, (date_diff('month', d, DATE '2002-01-01') - CASE WHEN DAY(d) > 1 THEN 1 ELSE 0 END)::DOUBLE AS v_datedif_m, (DATE '2002-01-01' - d)::DOUBLE / 365 AS v_frac3,
    (SELECT COUNT(*) FROM range(0, 14) r(i) WHERE ISODOW(d + CAST(i AS INTEGER)) <= 5)::DOUBLE AS v_net14 FROM t""",
)
def fn_dates(spark, sf_dir):
    """Date functions over serials."""
    df = table(spark, sf_dir, "orders").withColumn("s", serial_of(F.to_date("o_orderdate")))
    s, end = Val(F.col("s"), kind="number"), call("DATE", 2002, 1, 1)
    return put(
        df, ["o_orderkey"], None, v_serial=s, v_year=call("YEAR", s), v_month=call("MONTH", s), v_day=call("DAY", s), v_weekday=call("WEEKDAY", s), v_weekday2=call("WEEKDAY", s, 2), v_edate=call("EDATE", s, 5),
        v_eomonth=call("EOMONTH", s, 2, EXCEL), v_days=call("DAYS", end, s), v_datedif_m=call("DATEDIF", s, end, "M"), v_frac3=call("YEARFRAC", s, end, 3), v_net14=call("NETWORKDAYS", s, add(s, 13)),
    )


@register(
    "fn_times",
    """SELECT event_id, HOUR(ts)::DOUBLE AS v_hour, MINUTE(ts)::DOUBLE AS v_minute, FLOOR(SECOND(ts))::DOUBLE AS v_second, ROUND((HOUR(ts) * 3600 + MINUTE(ts) * 60) / 86400.0, 6)::DOUBLE AS v_time FROM events""",
)
def fn_times(spark, sf_dir):
    """Time functions over serials."""
    from gridspan.functions.dates import serial_of_moment

    df = table(spark, sf_dir, "events").withColumn("s", serial_of_moment(F.col("ts")))
    h, m, s = (call(n, Val(F.col("s"), kind="number")) for n in ("HOUR", "MINUTE", "SECOND"))
    return put(df, ["event_id"], 6, v_hour=h, v_minute=m, v_second=s, v_time=call("TIME", h, m, 0))


@register(
    "fn_logical",
    """SELECT p_partkey, p_size > 10 AND p_size < 40 AS v_and, p_size < 10 OR p_size > 40 AS v_or, (p_size < 10) <> (p_size % 2 = 0) AS v_xor, NOT p_size > 10 AS v_not, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS v_if,
    CASE WHEN p_size > 40 THEN 'L' WHEN p_size > 20 THEN 'M' ELSE 'S' END AS v_ifs, CASE p_type WHEN 'PROMO' THEN 1.0::DOUBLE WHEN 'SMALL' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS v_switch,
    CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS v_choose, CASE WHEN p_size = 1 THEN -1.0::DOUBLE ELSE 10.0::DOUBLE / (p_size - 1) END AS v_iferror, p_size = 1 AS v_iserr FROM part""",
)
def fn_logical(spark, sf_dir):
    """Logical functions and errors as data."""
    s = F.col("p_size")
    q = divide(10, subtract(s, 1))
    return put(
        table(spark, sf_dir, "part"), ["p_partkey"], None, v_and=call("AND", s > 10, s < 40), v_or=call("OR", s < 10, s > 40), v_xor=call("XOR", s < 10, s % 2 == 0), v_not=call("NOT", s > 10), v_if=call("IF", s > 25, "big", "small"),
        v_ifs=call("IFS", s > 40, "L", s > 20, "M", F.lit(True), "S"), v_switch=call("SWITCH", F.col("p_type"), "PROMO", 1.0, "SMALL", 2.0, 0.0), v_choose=call("CHOOSE", s % 3 + 1, "a", "b", "c"), v_iferror=call("IFERROR", q, -1.0), v_iserr=call("ISERR", q),
    )


@register(
    "fn_engineering",
    """SELECT p_partkey, TO_BASE(p_size, 2) AS v_bin, FORMAT('{:o}', p_size) AS v_oct, FORMAT('{:X}', p_partkey % 100000) AS v_hex, (p_partkey % 100000)::DOUBLE AS v_back, LPAD(TO_BASE(p_size, 2), 8, '0') AS v_pad,
    (p_size & 12)::DOUBLE AS v_and, (p_size | 12)::DOUBLE AS v_or, xor(p_size, 12)::DOUBLE AS v_xor, (p_size << 3)::DOUBLE AS v_shl, (p_size >> 2)::DOUBLE AS v_shr, CASE WHEN p_size = 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v_delta,
    CASE WHEN p_size >= 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v_step, ROUND(SQRT(p_size * p_size + 16), 6) AS v_imabs, CAST(p_size AS VARCHAR) || '+4i' AS v_complex, CAST(p_size + 1 AS VARCHAR) || '+6i' AS v_imsum FROM part""",
)
def fn_engineering(spark, sf_dir):
    """Bases, bits and complex numbers."""
    s, k = F.col("p_size"), F.col("p_partkey") % 100000
    z = call("COMPLEX", s, 4)
    return put(
        table(spark, sf_dir, "part"), ["p_partkey"], None, v_bin=call("DEC2BIN", s), v_oct=call("DEC2OCT", s), v_hex=call("DEC2HEX", k), v_back=call("HEX2DEC", call("DEC2HEX", k)), v_pad=call("DEC2BIN", s, 8), v_and=call("BITAND", s, 12),
        v_or=call("BITOR", s, 12), v_xor=call("BITXOR", s, 12), v_shl=call("BITLSHIFT", s, 3), v_shr=call("BITRSHIFT", s, 2), v_delta=call("DELTA", s, 7), v_step=call("GESTEP", s, 30), v_imabs=call("ROUND", call("IMABS", z), 6), v_complex=z, v_imsum=call("IMSUM", z, "1+2i"),
    )


@register(
    "fn_finance",
    """WITH t AS (SELECT c_custkey, 0.01 + (c_custkey % 10) / 1000.0::DOUBLE AS r, 12 + c_custkey % 24 AS n, 1000.0::DOUBLE AS p FROM customer)
    SELECT c_custkey, ROUND(-(p * (1 + r) ^ n) * r / ((1 + r) ^ n - 1), 4) AS v_pmt, ROUND(-(100 * ((1 + r) ^ n - 1) / r), 4) AS v_fv, ROUND(-(100 * ((1 + r) ^ n - 1) / r) / (1 + r) ^ n, 4) AS v_pv,
    ROUND(-(p * r), 4) AS v_ipmt1, ROUND(LN(-200.0 / (-200.0 + p * r)) / LN(1 + r), 4) AS v_nper, ROUND((1 + r / 12) ^ 12 - 1, 6) AS v_effect, ROUND(12 * ((1 + r) ^ (1 / 12.0::DOUBLE) - 1), 6) AS v_nominal,
    ROUND((p - 100) / n, 4) AS v_sln, ROUND((p - 100) * (n - 1) * 2 / (n * (n + 1)), 4) AS v_syd, ROUND(LN(2) / LN(1 + r), 4) AS v_pdur, ROUND(2 ^ (1.0::DOUBLE / n) - 1, 6) AS v_rri, ROUND(p * 2 / n * (1 - 2.0::DOUBLE / n), 4) AS v_ddb FROM t""",
)
def fn_finance(spark, sf_dir):
    """Time value of money and depreciation."""
    df = table(spark, sf_dir, "customer").select("c_custkey", (0.01 + F.col("c_custkey") % 10 / 1000.0).alias("r"), (12 + F.col("c_custkey") % 24).alias("n"))
    r, n = F.col("r"), F.col("n")
    vals = {
        "v_pmt": call("PMT", r, n, 1000), "v_fv": call("FV", r, n, 100), "v_pv": call("PV", r, n, 100), "v_ipmt1": call("IPMT", r, 1, n, 1000), "v_nper": call("NPER", r, -200, 1000), "v_sln": call("SLN", 1000, 100, n),
        "v_syd": call("SYD", 1000, 100, n, 2), "v_pdur": call("PDURATION", r, 1000, 2000), "v_ddb": call("DDB", 1000, 0, n, 2),
    }
    six = {"v_effect": call("EFFECT", r, 12), "v_nominal": call("NOMINAL", r, 12), "v_rri": call("RRI", n, 1000, 2000)}
    return df.select("c_custkey", *(F.round(v.column(), 4).alias(k) for k, v in vals.items()), *(F.round(v.column(), 6).alias(k) for k, v in six.items()))


@register(
    "fn_bonds",
    """WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, (DATE '2002-06-30' - CAST(o_orderdate AS DATE))::DOUBLE AS n FROM orders)
    SELECT o_orderkey, ROUND((100 - 95) / (100 * (n / 365)), 6) AS v_disc, ROUND((100 - 95) / (95 * (n / 365)), 6) AS v_intrate, ROUND(100 * (1 - 0.02 * (n / 365)), 6) AS v_pricedisc, ROUND(95 / (1 - 0.02 * (n / 365)), 6) AS v_received,
    ROUND((100 - 95) / (95 * (n / 365)), 6) AS v_yielddisc, ROUND(1000 * 0.05 * n / 365, 6) AS v_accrintm, CASE WHEN n <= 366 THEN ROUND(100 * (1 - 0.03 * n / 360), 6) END AS v_tbillprice, CASE WHEN n <= 366 THEN ROUND((100 - 97) / 97.0 * 360 / n, 6) END AS v_tbillyield FROM t""",
)
def fn_bonds(spark, sf_dir):
    """Discounted securities and bills."""
    s, end = Val(serial_of(F.to_date("o_orderdate")), kind="number"), call("DATE", 2002, 6, 30)
    return put(
        table(spark, sf_dir, "orders"), ["o_orderkey"], 6, v_disc=call("DISC", s, end, 95, 100, 3), v_intrate=call("INTRATE", s, end, 95, 100, 3), v_pricedisc=call("PRICEDISC", s, end, 0.02, 100, 3), v_received=call("RECEIVED", s, end, 95, 0.02, 3),
        v_yielddisc=call("YIELDDISC", s, end, 95, 100, 3), v_accrintm=call("ACCRINTM", s, end, 0.05, 1000, 3), v_tbillprice=call("TBILLPRICE", s, end, 0.03), v_tbillyield=call("TBILLYIELD", s, end, 97),
    )


@register(
    "fn_coupons",
    """WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
    c AS (SELECT o_orderkey, d, MIN(CAST(DATE '2003-03-15' - INTERVAL (6 * k) MONTH AS DATE)) AS nxt, COUNT(*) AS n FROM t, range(0, 40) r(k) WHERE CAST(DATE '2003-03-15' - INTERVAL (6 * k) MONTH AS DATE) > d GROUP BY o_orderkey, d)
    SELECT o_orderkey, n::DOUBLE AS v_num, (nxt - DATE '1899-12-30')::DOUBLE AS v_next, (CAST(nxt - INTERVAL 6 MONTH AS DATE) - DATE '1899-12-30')::DOUBLE AS v_prev FROM c""",
)
def fn_coupons(spark, sf_dir):
    """Coupon dates and counts."""
    df, s, end = table(spark, sf_dir, "orders"), Val(serial_of(F.to_date("o_orderdate")), kind="number"), call("DATE", 2003, 3, 15)
    return put(df, ["o_orderkey"], None, v_num=call("COUPNUM", s, end, 2), v_next=call("COUPNCD", s, end, 2), v_prev=call("COUPPCD", s, end, 2))


@register(
    "fn_flows",
    """WITH t AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS d, l_extendedprice AS v, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_extendedprice, l_quantity, l_partkey) AS pos, MIN(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_orderkey) AS d0 FROM lineitem)
    SELECT l_orderkey, ROUND(SUM(v / 1.05 ^ pos), 4) AS v_npv, ROUND(SUM(v / 1.05 ^ ((d - d0) / 365.0::DOUBLE)), 4) AS v_xnpv FROM t GROUP BY l_orderkey""",
)
def fn_flows(spark, sf_dir):
    """NPV and XNPV of each order's lines."""
    from pyspark.sql import Window

    by = Window.partitionBy("l_orderkey")
    df = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(by.orderBy("l_shipdate", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey"))).withColumn("d", F.to_date("l_shipdate")).withColumn("d0", F.min("d").over(by))
    return df.groupBy("l_orderkey").agg(F.round(npv(0.05, F.col("l_extendedprice"), F.col("pos")), 4).alias("v_npv"), F.round(xnpv(0.05, F.col("l_extendedprice"), F.col("d"), F.col("d0")), 4).alias("v_xnpv"))


@register("fn_irr")
def fn_irr(spark, sf_dir):
    """IRR and XIRR of each order: its price out, its lines in. Newton's steps have no SQL form; tests hold the roots."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("pos"), (-F.col("o_totalprice") / 4).alias("v"), F.to_date("o_orderdate").alias("d"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"), (F.col("l_extendedprice") / 8).alias("v"), F.to_date("l_shipdate").alias("d"))
    return o.unionByName(li).groupBy("k").agg(F.round(irr(F.col("v"), F.col("pos")), 6).alias("irr"), F.round(xirr(F.col("v"), F.col("d")), 6).alias("xirr"))


@register("fn_distributions")
def fn_distributions(spark, sf_dir):
    """Distribution functions over sizes; DuckDB has none of them, tests hold known values."""
    s = F.col("p_size")
    return put(
        table(spark, sf_dir, "part"), ["p_partkey"], 9, norm=call("NORM.DIST", s, 25, 10, True), norm_inv=call("NORM.S.INV", s / 51), gamma=call("GAMMA.DIST", s, 3, 4, True), chisq=call("CHISQ.DIST.RT", s, 20), f=call("F.DIST", s / 10, 5, 9, True),
        binom=call("BINOM.DIST", s, 50, 0.4, True), negbinom=call("NEGBINOM.DIST", s, 5, 0.2, True), poisson=call("POISSON.DIST", s, 20, True), weibull=call("WEIBULL.DIST", s, 2, 20, True), expon=call("EXPON.DIST", s, 0.1, True), gammaln=call("GAMMALN", s),
    )


@register(
    "agg_basic",
    """SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS v_sum, ROUND(AVG(l_extendedprice), 4) AS v_avg, COUNT(l_quantity)::BIGINT AS v_count, MAX(l_extendedprice) AS v_max, MIN(l_extendedprice) AS v_min, ROUND(MEDIAN(l_extendedprice), 4) AS v_median,
    ROUND(STDDEV_SAMP(l_extendedprice), 4) AS v_sd, ROUND(STDDEV_POP(l_extendedprice), 4) AS v_sdp, ROUND(VAR_SAMP(l_quantity), 4) AS v_var, ROUND(VAR_POP(l_quantity), 4) AS v_varp, ROUND(POWER(SUM(l_discount), 2), 2) AS v_sumsq, ROUND(SUM(l_discount * l_discount), 4) AS v_sumsq_x,
    ROUND(EXP(AVG(LN(l_quantity))), 4) AS v_geo, ROUND(COUNT(*) / SUM(1 / l_quantity), 4) AS v_har, ROUND(VAR_POP(l_quantity) * COUNT(*), 2) AS v_devsq, ROUND(QUANTILE_CONT(l_quantity, 0.9), 4) AS v_p90, ROUND(QUANTILE_CONT(l_quantity, 0.25), 4) AS v_q1,
    COUNT(CASE WHEN l_discount = 0 THEN 1 END)::BIGINT AS v_countif FROM lineitem GROUP BY l_returnflag""",
)
def agg_basic(spark, sf_dir):
    """Aggregates by group in both modes."""
    q, p, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    r = lambda c, n=4: F.round(c, n)
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag")
        .agg(
            r(A.SUM(q), 2).alias("v_sum"), r(A.AVERAGE(p)).alias("v_avg"), A.COUNT(q).alias("v_count"), A.MAX(p).alias("v_max"), A.MIN(p).alias("v_min"), r(A.MEDIAN(p)).alias("v_median"), r(A.STDEV(p)).alias("v_sd"), r(A.STDEV_P(p)).alias("v_sdp"),
            r(A.VAR(q)).alias("v_var"), r(A.VAR_P(q)).alias("v_varp"), r(A.SUMSQ(d), 2).alias("v_sumsq"), r(A.SUMSQ(d, EXCEL)).alias("v_sumsq_x"), r(A.GEOMEAN(q, EXCEL)).alias("v_geo"), r(A.HARMEAN(q, EXCEL)).alias("v_har"), r(A.DEVSQ(q), 2).alias("v_devsq"),
            r(A.PERCENTILE(q, 0.9)).alias("v_p90"), r(A.QUARTILE(q, 1)).alias("v_q1"), F.count(F.when(d == 0, 1)).alias("v_countif"),
        )
    )


@register(
    "agg_shape",
    """SELECT l_linestatus, ROUND(SKEWNESS(l_extendedprice), 6) AS v_skew, ROUND(KURTOSIS(l_extendedprice), 6) AS v_kurt, MAX(l_quantity) AS v_large1, ROUND(SUM(l_quantity * l_extendedprice * l_discount), 2) AS v_sumproduct FROM lineitem GROUP BY l_linestatus""",
)
def agg_shape(spark, sf_dir):
    """Skewness, kurtosis, products."""
    p = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(A.SKEW(p), 6).alias("v_skew"), F.round(A.KURT(p), 6).alias("v_kurt"), A.MAX(F.col("l_quantity")).alias("v_large1"), F.round(A.SUMPRODUCT(F.col("l_quantity"), p, F.col("l_discount")), 2).alias("v_sumproduct"))


@register(
    "agg_bivariate",
    """SELECT l_returnflag, ROUND(CORR(l_extendedprice, l_quantity), 6) AS v_corr, ROUND(COVAR_POP(l_extendedprice, l_quantity), 3) AS v_cov, ROUND(COVAR_SAMP(l_extendedprice, l_quantity), 3) AS v_covs, ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 4) AS v_slope,
    ROUND(REGR_INTERCEPT(l_extendedprice, l_quantity), 3) AS v_icept, ROUND(POWER(CORR(l_extendedprice, l_quantity), 2), 6) AS v_rsq, ROUND(REGR_INTERCEPT(l_extendedprice, l_quantity) + 30 * REGR_SLOPE(l_extendedprice, l_quantity), 3) AS v_fore,
    ROUND(SUM(l_quantity * l_quantity - l_tax * l_tax), 2) AS v_x2my2, ROUND(SUM(l_quantity * l_quantity + l_tax * l_tax), 2) AS v_x2py2, ROUND(SUM((l_quantity - l_tax) * (l_quantity - l_tax)), 2) AS v_xmy2 FROM lineitem GROUP BY l_returnflag""",
)
def agg_bivariate(spark, sf_dir):
    """Statistics of two columns."""
    y, x, t = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(A.CORREL(y, x), 6).alias("v_corr"), F.round(A.COVAR(y, x), 3).alias("v_cov"), F.round(A.COVARIANCE_S(y, x), 3).alias("v_covs"), F.round(A.SLOPE(y, x), 4).alias("v_slope"), F.round(A.INTERCEPT(y, x), 3).alias("v_icept"),
        F.round(A.RSQ(y, x), 6).alias("v_rsq"), F.round(A.FORECAST(30, y, x), 3).alias("v_fore"), F.round(A.SUMX2MY2(x, t), 2).alias("v_x2my2"), F.round(A.SUMX2PY2(x, t), 2).alias("v_x2py2"), F.round(A.SUMXMY2(x, t), 2).alias("v_xmy2"),
    )
