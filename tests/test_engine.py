"""Formula functions, block operators and the registered queries with their SQL."""

import math
import zipfile
from datetime import date

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspan.functions import FUNCTIONS, aggregates, call
from gridspan.functions.core import EXCEL, Val, compare, concat, divide, error, negate, power
from gridspan.functions.dates import date_of, serial_of
from gridspan.operators import blocks, criteria, fill, graph, lookups, ranges, ranking, rules, versions
from gridspan.plans import catalog
from gridspan.sources import files
from gridspan.streaming import edits

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def value(spark, v: Val):
    """The one value, or the error, of a constant formula."""
    r = spark.range(1).select(v.column().alias("v"), v.err.alias("e")).first()
    return r["e"] or r["v"]


CASES = [
    ("SUM is no scalar", "SUMX", (1,), "#NAME?"),
    ("arity", "MOD", (1,), "#UNKNOWN!"),
    ("prefix", "_XLFN.SQRT", (9,), 3.0),
    ("coercion", "ABS", ("-3.5",), 3.5),
    ("text", "ABS", ("x",), "#VALUE!"),
    ("domain", "SQRT", (-1,), "#NUM!"),
    ("mod", "MOD", (-3, 2), 1.0),
    ("mod zero", "MOD", (3, 0), "#DIV/0!"),
    ("fact", "FACT", (5,), 120.0),
    ("factdouble", "FACTDOUBLE", (7,), 105.0),
    ("factdouble even", "FACTDOUBLE", (6,), 48.0),
    ("combin", "COMBIN", (8, 2), 28.0),
    ("permut", "PERMUT", (100, 3), 970200.0),
    ("gcd", "GCD", (24, 36, 60), 12.0),
    ("lcm", "LCM", (5, 2, 8), 40.0),
    ("multinomial", "MULTINOMIAL", (2, 3, 4), 1260.0),
    ("round", "ROUND", (-2.5, 0), -3.0),
    ("roundup", "ROUNDUP", (3.14159, 3), 3.142),
    ("mround", "MROUND", (-10, 3), "#NUM!"),
    ("even", "EVEN", (-1,), -2.0),
    ("odd", "ODD", (1.5,), 3.0),
    ("ceiling", "CEILING", (2.5, 1), 3.0),
    ("ceiling sign", "CEILING", (2.5, -1), "#NUM!"),
    ("atan2", "ATAN2", (1, 1), pytest.approx(0.785398163)),
    ("if", "IF", (True, "a", "b"), "a"),
    ("ifs none", "IFS", (False, 1), "#N/A"),
    ("switch", "SWITCH", (2, 1, "one", 2, "two"), "two"),
    ("choose", "CHOOSE", (4, 1, 2), "#VALUE!"),
    ("xor", "XOR", (True, True, True), True),
    ("and nothing", "AND", ("x",), "#VALUE!"),
    ("not", "NOT", (0,), True),
    ("proper", "PROPER", ("2-way street o'neil",), "2-Way Street O'Neil"),
    ("trim", "TRIM", ("  a   b ",), "a   b"),
    ("substitute", "SUBSTITUTE", ("a.b.c", ".", "-", 2), "a.b-c"),
    ("mid", "MID", ("Fluid Flow", 7, 20), "Flow"),
    ("replace", "REPLACE", ("abcdef", 3, 2, "*"), "ab*ef"),
    ("find", "FIND", ("M", "Miriam McGovern", 3), 8.0),
    ("search", "SEARCH", ("e", "Statements", 6), 7.0),
    ("find none", "FIND", ("z", "abc"), "#VALUE!"),
    ("char", "CHAR", (233,), "é"),
    ("code", "CODE", ("A",), 65.0),
    ("dollar", "DOLLAR", (-1234.567, 2), "($1,234.57)"),
    ("fixed", "FIXED", (1234.567, 1, True), "1234.6"),
    ("value", "VALUE", (" 12.5% ",), 0.125),
    ("value bad", "VALUE", ("12a",), "#VALUE!"),
    ("text", "TEXT", (1234.5, "#,##0.00"), "1,234.50"),
    ("text percent", "TEXT", (0.285, "0.0%"), "28.5%"),
    ("len clusters", "LEN", ("e\u0301👩‍👩‍👧x",), 3.0),
    ("left clusters", "LEFT", ("e\u0301bc", 2), "e\u0301b"),
    ("right clusters", "RIGHT", ("abe\u0301", 1), "e\u0301"),
    ("mid clusters", "MID", ("ae\u0301bc", 2, 2), "e\u0301b"),
    ("text zeros", "TEXT", (7, "000"), "007"),
    ("text optional", "TEXT", (3.5, "0.0##"), "3.5"),
    ("text sections", "TEXT", (-1234.5, '"$"#,##0.00;("$"#,##0.00)'), "($1,234.50)"),
    ("text negative", "TEXT", (-2.25, "0.0"), "-2.3"),
    ("text exponent", "TEXT", (12345, "0.00E+00"), "1.23E+04"),
    ("text unknown", "TEXT", (1, "??/??"), "#VALUE!"),
    ("textjoin", "TEXTJOIN", (", ", True, "a", "", "b"), "a, b"),
    ("address", "ADDRESS", (2, 28), "$AB$2"),
    ("address mixed", "ADDRESS", (2, 3, 2, False), "R2C[3]"),
    ("regexreplace nth", "REGEXREPLACE", ("a1b2c3", "[0-9]", "X", 2), "a1bXc3"),
    ("regexreplace last", "REGEXREPLACE", ("a1b2c3", "[0-9]", "X", -1), "a1b2cX"),
    ("regexextract", "REGEXEXTRACT", ("abc", "[0-9]"), "#N/A"),
    ("date", "DATE", (2008, 14, 2), 39846.0),
    ("date old", "DATE", (108, 1, 2), 39449.0),
    ("datedif", "DATEDIF", (36892, 37622, "Y"), 2.0),
    ("datedif days", "DATEDIF", (36892, 37257, "D"), 365.0),
    ("days360", "DAYS360", (40543, 40908), 360.0),
    ("edate", "EDATE", (40574, 1), 40602.0),
    ("eomonth", "EOMONTH", (40574, 1), 40602.0),
    ("eomonth december", "EOMONTH", (40513, 0), 40542.0),
    ("networkdays", "NETWORKDAYS", (41183, 41334), 110.0),
    ("weekday", "WEEKDAY", (39492, 2), 4.0),
    ("time", "TIME", (12, 0, 0), 0.5),
    ("yearfrac", "YEARFRAC", (40909, 41120, 0), pytest.approx(0.58055556)),
    ("date text", "YEAR", ("2011-03-04",), 2011.0),
    ("pmt", "PMT", (0.08 / 12, 10, 10000), pytest.approx(-1037.03208935)),
    ("fv", "FV", (0.06 / 12, 10, -200, -500, 1), pytest.approx(2581.40337406)),
    ("pv", "PV", (0.08 / 12, 240, 500), pytest.approx(-59777.1458512)),
    ("ipmt", "IPMT", (0.1 / 12, 1, 36, 8000), pytest.approx(-66.6666667)),
    ("ppmt", "PPMT", (0.1 / 12, 1, 24, 2000), pytest.approx(-75.6231860)),
    ("cumipmt", "CUMIPMT", (0.09 / 12, 360, 125000, 13, 24, 0), pytest.approx(-11135.232131)),
    ("cumprinc", "CUMPRINC", (0.09 / 12, 360, 125000, 13, 24, 0), pytest.approx(-934.1071234)),
    ("nper", "NPER", (0.01, -100, -1000, 10000, 1), pytest.approx(59.6738657)),
    ("rate", "RATE", (48, -200, 8000), pytest.approx(0.00770147, abs=1e-6)),
    ("db", "DB", (1000000, 100000, 6, 1, 7), pytest.approx(186083.333333)),
    ("db last", "DB", (1000000, 100000, 6, 7, 7), pytest.approx(15845.098474)),
    ("ddb", "DDB", (2400, 300, 10, 2), pytest.approx(384)),
    ("syd", "SYD", (30000, 7500, 10, 1), pytest.approx(4090.90909)),
    ("effect", "EFFECT", (0.0525, 4), pytest.approx(0.0535427)),
    ("nominal", "NOMINAL", (0.053543, 4), pytest.approx(0.05250032)),
    ("disc", "DISC", (43282, 46447, 97.975, 100, 1), pytest.approx(0.00233, abs=1e-4)),
    ("price", "PRICE", (39493, 43054, 0.0575, 0.065, 100, 2, 0), pytest.approx(94.63436162)),
    ("coupnum", "COUPNUM", (39107, 39767, 2), 4.0),
    ("tbillprice", "TBILLPRICE", (39538, 39600, 0.09), pytest.approx(98.45)),
    ("tbilleq", "TBILLEQ", (39538, 39600, 0.0914), pytest.approx(0.09415149)),
    ("bin2dec", "BIN2DEC", ("1111111111",), -1.0),
    ("dec2hex", "DEC2HEX", (-54,), "FFFFFFFFCA"),
    ("dec2bin", "DEC2BIN", (9, 4), "1001"),
    ("dec2bin short", "DEC2BIN", (9, 3), "#NUM!"),
    ("hex2oct", "HEX2OCT", ("F", 3), "017"),
    ("bad digits", "OCT2DEC", ("9",), "#NUM!"),
    ("bitxor", "BITXOR", (5, 3), 6.0),
    ("bitlshift", "BITLSHIFT", (4, 2), 16.0),
    ("bitlshift negative", "BITLSHIFT", (4, -2), "#NUM!"),
    ("imabs", "IMABS", ("5+12i",), 13.0),
    ("imaginary", "IMAGINARY", ("0-j",), -1.0),
    ("imreal", "IMREAL", ("6-9i",), 6.0),
    ("imsum", "IMSUM", ("3+4i", "5-3i", 2), "10+1i"),
    ("improduct", "IMPRODUCT", ("3+4i", "5-3i"), "27+11i"),
    ("imdiv", "IMDIV", ("-238+240i", "10+24i"), "5+12i"),
    ("imconjugate", "IMCONJUGATE", ("3+4i",), "3-4i"),
    ("imabs bad", "IMABS", ("x",), "#UNKNOWN!"),
    ("imsum bad", "IMSUM", ("x",), "#NUM!"),
    ("complex", "COMPLEX", (3, 4, "k"), "#VALUE!"),
    ("norm", "NORM.DIST", (42, 40, 1.5, True), pytest.approx(0.9087887802)),
    ("norm density", "NORMDIST", (42, 40, 1.5, False), pytest.approx(0.1093400498)),
    ("norm inverse", "NORMSINV", (0.9087888,), pytest.approx(1.3333347)),
    ("binom", "BINOM.DIST", (6, 10, 0.5, False), pytest.approx(0.205078125)),
    ("binom cdf", "BINOM.DIST", (6, 10, 0.5, True), pytest.approx(0.828125)),
    ("binom inv", "BINOM.INV", (6, 0.5, 0.75), 4.0),
    ("poisson", "POISSON", (2, 5, True), pytest.approx(0.1246520195)),
    ("gamma", "GAMMA.DIST", (10.00001131, 9, 2, True), pytest.approx(0.068094, abs=1e-6)),
    ("chisq", "CHISQ.DIST.RT", (18.307, 10), pytest.approx(0.0500006)),
    ("f", "F.DIST", (15.2068649, 6, 4, True), pytest.approx(0.99)),
    ("weibull", "WEIBULL.DIST", (105, 20, 100, True), pytest.approx(0.9295813901)),
    ("negbinom", "NEGBINOM.DIST", (10, 5, 0.25, False), pytest.approx(0.0550486604)),
    ("expon", "EXPON.DIST", (0.2, 10, True), pytest.approx(0.8646647168)),
    ("gammaln", "GAMMALN", (4,), pytest.approx(1.791759469)),
    ("gamma", "GAMMA", (-3.75,), pytest.approx(0.267866128)),
    ("type", "TYPE", ("a",), 2.0),
    ("n", "N", ("7",), 0.0),
]


def test_values(spark):
    """All constant cases in one projection a family; the errors among them."""
    columns = []
    for i, (_, name, args, _) in enumerate(CASES):
        v = call(name, *args)
        columns.append(F.coalesce(v.err, v.value.cast("string")).alias(f"c{i}"))
    bad = []
    for at in range(0, len(CASES), 15):
        row = spark.range(1).select(*columns[at : at + 15]).first()
        for i, (label, name, _, expect) in enumerate(CASES[at : at + 15]):
            got = row[i]
            if isinstance(expect, bool):
                expect = str(expect).lower()
            elif not isinstance(expect, str):
                got = float(got) if got is not None and not got.startswith("#") else got
            if got != expect:
                bad.append((label, name, got, expect))
    assert not bad


def test_operators_and_errors(spark):
    assert value(spark, negate(3)) == -3.0
    assert value(spark, power(negate(3), 2)) == 9.0  # the sign binds tighter than ^
    assert value(spark, divide(1, 0)) == "#DIV/0!"
    assert value(spark, concat(1.0, True)) == "1TRUE"
    assert value(spark, compare(F.lit("a"), "<", True)) is True
    assert value(spark, compare(9, "<", F.lit("a"))) is True
    assert value(spark, compare(F.lit("A"), "=", F.lit("a"))) is False
    assert value(spark, compare(F.lit("A"), "=", F.lit("a"), EXCEL)) is True
    assert value(spark, call("IFERROR", divide(1, 0), "none")) == "none"
    assert value(spark, call("IFNA", divide(1, 0), 1)) == "#DIV/0!"
    assert value(spark, call("ABS", error("#REF!"))) == "#REF!"
    assert value(spark, call("ISNA", call("NA"))) is True
    assert value(spark, call("ISBLANK", F.lit(None))) is True
    assert len(FUNCTIONS) > 230


def test_serials(spark):
    df = spark.createDataFrame([(date(1900, 2, 28),), (date(1900, 3, 1),), (date(1900, 3, 2),), (date(2000, 1, 1),)], "d date")
    assert [r[0] for r in df.select(serial_of(F.col("d"))).collect()] == [59.0, 60.0, 62.0, 36526.0]
    assert [r[0] for r in df.select(serial_of(F.col("d"), EXCEL)).collect()] == [59.0, 61.0, 62.0, 36526.0]
    assert df.select(date_of(serial_of(F.col("d"), EXCEL)).alias("x"), "d").filter("x <> d").count() == 0


def test_aggregate_modes(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    x = F.col("x")
    row = df.agg(aggregates.SUMSQ(x), aggregates.SUMSQ(x, EXCEL), aggregates.GEOMEAN(x, EXCEL), aggregates.HARMEAN(x, EXCEL), aggregates.KURT(x), aggregates.PERCENTILE_EXC(x, 0.5), aggregates.LARGE(x, 2), aggregates.SMALL(x, 4), aggregates.SUBTOTAL(109, x)).first()
    assert list(row) == [49.0, 21.0, pytest.approx(2.0), pytest.approx(12 / 7), None, 2.0, 2.0, None, 7.0]
    errs = spark.createDataFrame([(1, 10.0, None), (2, None, "#N/A"), (3, 20.0, None)], "p int, x double, e string")
    row = errs.agg(aggregates.AGGREGATE(9, 6, F.col("x"), F.col("e")), aggregates.AGGREGATE(14, 6, F.col("x"), F.col("e"), 1), aggregates.first_error(F.col("e"), F.col("p"))).first()
    assert list(row) == [30.0, 20.0, "#N/A"]
    none = df.filter("x > 9").agg(aggregates.SUM(x), aggregates.AVERAGE(x), aggregates.MAX(x), aggregates.PRODUCT(x)).first()
    assert list(none) == [0.0, None, 0.0, 0.0]


def test_criteria(spark):
    df = spark.createDataFrame([("apple", 5.0), ("apricot", -7.0), ("banana", None), ("a*", 20.0), (None, 1.0)], "t string, n double")
    count = lambda **k: df.agg(criteria.countifs(criteria.condition(df, k))).first()[0]
    assert [count(t="a*"), count(t="A*"), count(t="*an*"), count(t="a~*"), count(t="?pple"), count(t="<>apple"), count(n=">=5"), count(n="5"), count(n="=5"), count(n=5), count(n="<>apple")] == [3, 0, 1, 1, 1, 4, 2, 0, 1, 1, 5]
    neg = df.agg(criteria.maxifs(F.col("n"), F.col("n") < 0), criteria.maxifs(F.col("n"), F.col("n") < 0, EXCEL), criteria.averageifs(F.col("n"), F.col("t") == "banana")).first()
    assert list(neg) == [0.0, -7.0, 0.0]


def test_lookups(spark):
    keys = spark.createDataFrame([(4.0, "d", 0), (1.0, "a", 1), (2.0, "b", 2), (2.0, "b2", 3)], "k double, v string, pos int")
    left = spark.createDataFrame([(0.5,), (1.0,), (3.0,), (99.0,), (None,), (2.0,)], "x double")
    got = {r["x"]: (r["v"], r["err"]) for r in lookups.approximate(left, "x", keys, "k", "v", "pos").collect()}
    assert got == {0.5: (None, "#N/A"), 1.0: ("a", None), 3.0: ("b", None), 99.0: ("d", None), None: (None, "#N/A"), 2.0: ("b", None)}
    exact = {r["x"]: (r["v"], r["err"]) for r in lookups.vlookup(left, "x", keys, "k", "v", "pos").collect()}
    assert exact[2.0] == ("b", None) and exact[3.0] == (None, "#N/A")
    assert lookups.match(keys, "k", "pos", 3.0, 1).first()[0] == 3
    assert lookups.match(keys, "v", "pos", "B*", 0).first()[0] == 2
    assert lookups.approximate(left, "x", keys.filter("false"), "k", "v", "pos").filter("err is null").count() == 0


def test_ranks(spark):
    df = spark.createDataFrame([(float(v),) for v in (3, 1, 4, 1, 5)], "x double")
    assert [ranking.top_k(df, "x", k).first()["value"] for k in (1, 3)] == [5.0, 3.0]
    assert ranking.top_k(df, "x", 6).first()["err"] == "#NUM!"
    assert ranking.rank_value(df, "x", 1.0).first()["value"] == 4.0
    assert ranking.rank_value(df, "x", 1.0, average=True).first()["value"] == 4.5
    assert ranking.rank_value(df, "x", 9.0).first()["err"] == "#VALUE!"
    assert ranking.percent_rank(df, "x", 3.5).first()["value"] == 0.625
    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "o long, x double")
    out = ranking.cumulative(rows, "x", "o", "s").orderBy("o").collect()
    total = 0.0
    for r in out:
        total += r["x"]
        assert r["s"] == total


def test_recurrences_in_blocks(spark):
    rows = [(k, i, 0.5 + (i * 7 % 5) / 4, float(i % 3) - 1) for k, n in (("hot", 700), ("one", 1), (None, 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, a double, b double")
    expect, now = {}, {}
    for k, i, a, b in rows:
        now[k] = a * now.get(k, 2.0) + b
        expect[k, i] = now[k]
    for block in (1000, 30):
        out = {(r["k"], r["i"]): r["x"] for r in ranking.recurrence(df, ["k"], "i", 2.0, "a", "b", "x", block).collect()}
        assert out.keys() == expect.keys() and all(out[x] == pytest.approx(v, rel=1e-9) for x, v in expect.items())
    assert ranking.recurrence(df.filter("false"), ["k"], "i", 2.0, "a", "b", "x").count() == 0


def test_approximate_lookup_of_frequent_values(spark):
    table = spark.createDataFrame([(float(k), f"v{k}") for k in range(0, 100, 7)] + [(None, "none")], "key double, v string")
    df = spark.createDataFrame([(i, None if i % 50 == 0 else -1.0 if i % 50 == 1 else 30.0 if i % 3 else i / 4) for i in range(400)], "i int, x double")
    for ranges in (4, 1024):
        for r in lookups.approximate(df, "x", table, "key", "v", ranges=ranges).collect():
            low = r["x"] is None or r["x"] < 0
            assert (r["v"], r["err"]) == ((None, "#N/A") if low else (f"v{min(int(r['x'] // 7) * 7, 98)}", None))


def test_blocks(spark):
    df = spark.createDataFrame([("key1", 1.0, 2.0, 0), ("key2", 8.0, 4.0, 1), ("kye4", 5.0, 6.0, 2), ("key3", None, 3.0, 3)], "key string, field1 double, field2 double, ordinal int")
    block = blocks.Block("b", df, "key")
    assert block.refs("key*", "field*").agg(F.sum("field1"), F.sum("field2")).first()[:] == (9.0, 9.0)
    assert block.set_cell("key1", "field1", 100).ref("key1", "field1").first()[:] == (100.0, None)
    assert block.ref("none", "field1").first()["err"] == "#VALUE!"
    assert [r["key"] for r in block.sort("field1", descending=True).collect()] == ["key2", "kye4", "key1", "key3"]
    assert [r["key"] for r in block.sort("field1").collect()] == ["key1", "kye4", "key2", "key3"]
    moved = block.move_line(0, 2).df.orderBy("ordinal").collect()
    assert [r["key"] for r in moved] == ["key2", "kye4", "key1", "key3"]
    assert block.insert_lines(1, 2).df.count() == 6 and block.delete_lines(1, 2).df.agg(F.max("ordinal")).first()[0] == 1
    assert block.resize(6).df.count() == 6 and block.resize(2).df.count() == 2
    perm = spark.createDataFrame([(0, 3), (3, 0)], "old int, new int")
    assert [r["key"] for r in block.reorder(perm).df.orderBy("ordinal").collect()] == ["key3", "key2", "kye4", "key1"]
    held = blocks.Catalog(spark)
    held.register(block.add_field("both", F.col("field1") + F.col("field2")))
    assert held.evaluate("sum(both)", "b").first()[0] == 26.0 and ("both", "double") in held["b"].describe()
    held.remove("b")


def test_ranges():
    a, b = ranges.Range("s", 0, 0, 2, 2), ranges.Range("s", 2, 1, 4, 4)
    assert ranges.hull(a, b) == ranges.Range("s", 0, 0, 4, 4)
    assert ranges.intersection(a, b) == ranges.Range("s", 2, 1, 2, 2)
    assert ranges.intersection(a, ranges.Range("s", 5, 5, 6, 6)) == "#NULL!"
    assert ranges.hull(a, ranges.Range("t", 0, 0, 1, 1)) == "#VALUE!"


def test_fill(spark):
    assert [r[0] for r in fill.fill(spark, [2, 4], 3).orderBy("ordinal").select("value").collect()] == [6.0, 8.0, 10.0]
    assert [r[0] for r in fill.fill(spark, ["a", "b"], 3).orderBy("ordinal").select("value").collect()] == ["a", "b", "a"]


def test_rules(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate((1, 2, 3, 4, 5, 5))], "i int, x double")
    assert rules.top(df, "x", 20, "t", percent=True).filter("t").count() == 2
    assert rules.top(df, "x", 2, "t", bottom=True).filter("t").count() == 2
    assert rules.above_average(df, "x", "a", deviations=1).filter("a").count() == 2
    assert rules.duplicates(df, "x", "d").filter("d").count() == 2
    place = F.lit(0.5)
    row = spark.range(1).select(rules.icon(place, [0.33, 0.67]), rules.color(place, [(0, (255, 0, 0)), (1, (0, 0, 255))]), rules.time_period(F.to_date(F.lit("2024-05-15")), "thisWeek", F.to_date(F.lit("2024-05-13")))).first()
    assert list(row) == [1, "#800080", True]
    members = spark.createDataFrame([(1.0,), (5.0,)], "m double")
    assert {(r["key"], r["status"]) for r in rules.field_checks(df, "i", "x", "i", unique=True, members=members).collect()} == {(1, "membership"), (2, "membership"), (3, "membership"), (5, "unique")}
    with pytest.raises(ValueError):
        rules.mask([(F.lit(True), False)] * 54)


def test_versions(spark):
    log = spark.createDataFrame([(0, "s", 0, 0, "1"), (1, "s", 0, 0, "2"), (1, "s", 1, 0, "x"), (2, "s", 0, 0, None)], "version long, sheet string, r int, c int, value string")
    history = versions.History(log, 2, 2)
    assert history.state().collect()[0]["value"] == "x"
    assert history.undo() and history.state().count() == 2
    history.checkpoint("a")
    history.edit(spark.createDataFrame([("s", 5, 5, "new")], "sheet string, r int, c int, value string"))
    assert history.state().count() == 3 and not history.redo()
    history.restore("a")
    assert history.state().count() == 2
    base = versions.state_at(log, 0)
    assert versions.state_at(log, 1, base, 0).count() == 2
    ours, theirs = versions.state_at(log, 1), base.withColumn("value", F.lit("9"))
    assert versions.merge(base, ours, theirs).filter("conflict").count() == 1


def test_graph(spark):
    edges = graph.edges_of(spark, [("b", "a"), ("c", "b"), ("d", "a"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x")])
    assert {(r["cell"], r["level"]) for r in graph.trace(edges, spark.createDataFrame([("a",)], "cell string")).collect()} == {("a", 0), ("b", 1), ("d", 1), ("c", 2)}
    order = {r["cell"]: r["level"] for r in graph.levels(edges, spark.createDataFrame([(c,) for c in "abcdxyz"], "cell string")).collect()}
    assert order == {"a": 0, "b": 1, "c": 2, "d": 3, "x": None, "y": None, "z": None}
    assert graph.precedents(edges, spark.createDataFrame([("d",)], "cell string")).count() == 4


def test_csv_line_ends(spark, tmp_path):
    """Records end in CRLF, and a value with a line end comes back as one value."""
    df = spark.createDataFrame([(1, "a\nb"), (2, "c"), (3, None)], "i int, s string").coalesce(1)
    files.write_csv(df, str(tmp_path / "lines"))
    part = next((tmp_path / "lines").glob("part-*.csv")).read_bytes()
    assert part.startswith(b"i,s\r\n") and part.endswith(b"3,\r\n") and b'"a\r\nb"' in part
    rows = files.read_csv(spark, str(tmp_path / "lines"), "i int, s string").orderBy("i").collect()
    assert [tuple(r) for r in rows] == [(1, "a\nb"), (2, "c"), (3, None)]


def test_bounded_by_rows_and_bytes(spark):
    """A look-up table is broadcast only where both its rows and its bytes are few."""
    table = spark.range(50).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("v"), F.array("id").alias("a"))
    hinted = lambda **kw: "ResolvedHint" in lookups.bounded(table, **kw)._jdf.queryExecution().analyzed().toString()
    assert hinted() and not hinted(rows=49) and not hinted(size=49_000) and hinted(rows=50, size=60_000)
    assert lookups.bounded(table.filter("k < 0")).count() == 0


def test_cumulative_of_ties(spark):
    """Rows that tie in the order follow the tie-break columns."""
    rows = spark.createDataFrame([(i // 10, i, float(i % 7)) for i in range(200)], "o int, i int, x double")
    total = 0.0
    for r in ranking.cumulative(rows, "x", "o", "s", ties=["i"]).orderBy("i").collect():
        total += r["x"]
        assert r["s"] == total


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "i int, s string")
    files.write_csv(df, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), "i int, s string").filter("i = 1").first()["s"] == 'a "b", c'
    assert [r[0] for r in files.to_csv_lines(df, ["i", "s"]).collect()] == ['1,"a ""b"", c"', "2,"]
    text = "intro\n| a | b |\n|---|:-:|\n| 1 | x\\|y |\n| 2 | |\n\n| not | a table |\n"
    docs = spark.createDataFrame([(7, text), (8, None)], "k int, t string")
    cells = {(r["table"], r["r"], r["c"]): r["value"] for r in files.markdown_tables(docs, "k", "t").collect()}
    assert cells == {(0, 0, 0): "a", (0, 0, 1): "b", (0, 1, 0): "1", (0, 1, 1): "x|y", (0, 2, 0): "2", (0, 2, 1): ""}
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>hello</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2.5</v></c></row><row r="2"><c r="AA2" t="b"><v>1</v></c><c r="AB2"><f>A1+1</f></c></row></sheetData></worksheet>')
    book = files.read_workbooks(spark, str(tmp_path))
    assert {(r["r"], r["c"], r["kind"], r["value"], r["formula"]) for r in book.collect()} == {(0, 0, "text", "hello", None), (0, 1, "number", "2.5", None), (1, 26, "bool", "TRUE", None), (1, 27, "blank", None, "A1+1")}
    assert files.stale(book).count() == 1 and files.used_range(book).first()[:] == ("One", 2, 28) and files.window(book, "One", 0, 0, 0, 5).count() == 2


def test_streams(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    stream = edits.files(spark, str(tmp_path / "in"), schema)
    edits.drain(edits.windowed(stream, "ts", ["event_type"], "1 day", "1 hour", {"n": F.count("*")}), "by_day", "complete", str(tmp_path / "c1"))
    assert spark.table("by_day").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{DATA}/events.parquet").count()
    edits.drain(edits.sessions(stream, "ts", ["user_id"], "1 hour", "1 hour", {"n": F.count("*")}), "sessions", "append", str(tmp_path / "c2"))
    assert spark.table("sessions").count() > 0
    log = stream.select(F.lit("s").alias("sheet"), F.col("user_id").alias("r"), F.lit(0).alias("c"), "value", F.col("event_id").alias("version"))
    edits.drain(edits.latest_cells(log), "cells_now", "complete", str(tmp_path / "c3"))
    assert spark.table("cells_now").count() == spark.read.parquet(f"{DATA}/events.parquet").select("user_id").distinct().count()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return None
        return str(x) if isinstance(x, (str, bool)) or hasattr(x, "year") or type(x).__name__ == "bool" else f"{float(x):.9g}"

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(one, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        expect = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(expect.columns)
        assert normal(got) == normal(expect)


def test_irr(spark):
    flows = spark.createDataFrame([(1, 1, -70000.0), (1, 2, 12000.0), (1, 3, 15000.0), (1, 4, 18000.0), (1, 5, 21000.0), (2, 1, 5.0)], "g int, p int, v double")
    from gridspan.functions.finance import irr, npv, xirr

    out = {r["g"]: r["irr"] for r in flows.groupBy("g").agg(irr(F.col("v"), F.col("p")).alias("irr")).collect()}
    assert out[1] == pytest.approx(-0.0212448, abs=1e-6) and out[2] is None
    assert flows.filter("g = 1").agg(npv(0.1, F.col("v"), F.col("p"))).first()[0] == pytest.approx(sum(v / 1.1**i for i, v in enumerate((-70000, 12000, 15000, 18000, 21000), 1)))
    dated = spark.createDataFrame([(date(2008, 1, 1), -10000.0), (date(2008, 3, 1), 2750.0), (date(2008, 10, 30), 4250.0), (date(2009, 2, 15), 3250.0), (date(2009, 4, 1), 2750.0)], "d date, v double")
    assert dated.agg(xirr(F.col("v"), F.col("d"))).first()[0] == pytest.approx(0.373362535, abs=1e-6)


def test_rates_of_many_flows_at_once():
    """A batch of lists of flows gives what Newton's steps give for each list alone."""
    import random

    import pyarrow as pa

    from gridspan.functions import finance

    def alone(flows, guess, least):
        flows = sorted((f["w"], f["v"]) for f in flows or [] if f["w"] is not None and f["v"] is not None)
        if not any(v > 0 for _, v in flows) or not any(v < 0 for _, v in flows):
            return None
        f = lambda r: sum(v / (1 + r) ** ((w - flows[0][0]) / least) for w, v in flows)
        r = guess
        for _ in range(finance.ROUNDS):
            try:
                new = r - f(r) / ((f(r + 1e-6) - f(r - 1e-6)) / 2e-6)
            except (ZeroDivisionError, OverflowError):
                return None
            if isinstance(new, complex) or not math.isfinite(new):
                return None
            if abs(new - r) < finance.CLOSE:
                return new
            r = new
        return None

    rng = random.Random(2)
    lists = [[{"w": float(rng.randint(0, 900)), "v": rng.choice([-1, 1, 1]) * rng.random() * 1e4} for _ in range(rng.randint(1, 8))] for _ in range(300)]
    lists += [[], None, [{"w": None, "v": 1.0}, {"w": 1.0, "v": None}], [{"w": 0.0, "v": 0.0}], [{"w": 0.0, "v": -1.0}, {"w": 5000.0, "v": 1e300}]]
    flows = pa.array(lists, pa.list_(pa.struct([("w", pa.float64()), ("v", pa.float64())])))
    for least in (1.0, 365.0):
        got = finance._roots(flows, pa.array([0.1] * len(lists), pa.float64()), least).to_pylist()
        expect = [alone(f, 0.1, least) for f in lists]
        assert sum(x is not None for x in expect) > 15
        assert [None if x is None else round(x, 6) for x in got] == [None if x is None else round(x, 6) for x in expect]


def test_nested_complex_functions_stay_small(spark):
    """Each level of nesting adds as much as the one before, and the text of a part is not read again."""
    from gridspan.functions import call

    z = call("COMPLEX", F.col("a"), F.col("b"))
    sizes = []
    for _ in range(3):
        z = call("IMSUM", z, "1+2i")
        sizes.append(len(str(call("IMABS", z).column())))
    assert sizes[2] < 8 * sizes[0]
    assert len(str(call("HEX2DEC", call("DEC2HEX", F.col("a"))).column())) < 4 * len(str(call("DEC2HEX", F.col("a")).column()))
    df = spark.createDataFrame([(1.0, -4.0), (0.0, -0.0), (1e20, 2.5e-7), (float("nan"), 1.0), (None, 3.0), (3.0, float("inf"))], "a double, b double")
    z = call("COMPLEX", F.col("a"), F.col("b"))
    kept, read = call("IMSUM", z, "1-2i"), call("IMSUM", F.when(z.err.isNull(), z.value), "1-2i")
    for f in (kept, read):
        assert [r[0] for r in df.select(f.shown()).collect()] == ["2-6i", "#NUM!", "1.0E20-1.99999975i", "#NUM!", "1+1i", "#NUM!"]


def test_rounds_of_tracing_broadcast_nothing(spark, monkeypatch):
    """What a round joins is dealt by key, however small it is: broadcasts would all go through the driver."""
    plans, written = [], graph._written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(graph, "_written", seen)
    edges = spark.createDataFrame([(i, i // 2) for i in range(2, 40)], "cell long, uses long")
    assert graph.trace(edges, spark.createDataFrame([(3,)], "cell long")).count() == 15
    assert graph.levels(edges, spark.createDataFrame([(i,) for i in range(1, 40)], "cell long")).agg(F.max("level")).first()[0] == 5
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)


def test_limits_of_tracing_are_told(spark):
    """Without a limit cells are followed to the end; a limit that is met raises, and no chain passes for a cycle."""
    edges = spark.createDataFrame([(i + 1, i) for i in range(4)], "cell long, uses long").coalesce(1)
    start = spark.createDataFrame([(0,)], "cell long").coalesce(1)
    cells = spark.createDataFrame([(i,) for i in range(5)], "cell long").coalesce(1)
    for cut in (lambda: graph.trace(edges, start, 3), lambda: graph.levels(edges, cells, 4)):
        with pytest.raises(ValueError):
            cut()
    assert graph.trace(edges, start, 4).count() == graph.levels(edges, cells, 5).filter("level is not null").count() == 5
    assert {graph.trace.__defaults__, graph.precedents.__defaults__, graph.levels.__defaults__} == {(None,)}
