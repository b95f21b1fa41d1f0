"""Queries of blocks, lookups, conditional aggregates, ranks, fills, rules, versions and sources over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspan.operators import blocks, criteria, fill, graph, lookups, ranges, ranking, rules, versions
from gridspan.sources import files
from gridspan.streaming import edits

from .registry import register, table


@register(
    "sumifs_by_key",
    """SELECT l_returnflag, l_linestatus, ROUND(SUM(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END), 2) AS sum_qty, COUNT(CASE WHEN l_discount > 0.05 THEN 1 END)::BIGINT AS n_match,
    ROUND(AVG(CASE WHEN l_discount > 0.05 THEN l_extendedprice END), 4) AS mean_price, MAX(CASE WHEN l_discount > 0.05 THEN l_extendedprice END) AS max_price, MIN(CASE WHEN l_discount > 0.05 THEN l_quantity END) AS min_excel, 0.0::DOUBLE AS min_compat
    FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def sumifs_by_key(spark, sf_dir):
    """Columns of SUMIFS, COUNTIFS, AVERAGEIFS, MAXIFS and MINIFS formulas, one row a key, as a single grouped aggregate."""
    df = table(spark, sf_dir, "lineitem")
    test = criteria.condition(df, {"l_discount": ">0.05"})
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return criteria.by_key(df, ["l_returnflag", "l_linestatus"], {
        "sum_qty": F.round(criteria.sumifs(q, test), 2), "n_match": criteria.countifs(test), "mean_price": F.round(criteria.averageifs(p, test), 4), "max_price": criteria.maxifs(p, test),
        "min_excel": criteria.minifs(q, test, "excel"), "min_compat": criteria.minifs(q, test),
    })


@register(
    "criteria_wildcards",
    """SELECT COUNT(CASE WHEN p_type LIKE 'S%' THEN 1 END)::BIGINT AS n_prefix, COUNT(CASE WHEN p_type LIKE '%MO%' THEN 1 END)::BIGINT AS n_inner, COUNT(CASE WHEN p_brand LIKE 'Brand#1_' THEN 1 END)::BIGINT AS n_one, COUNT(CASE WHEN p_type <> 'PROMO' THEN 1 END)::BIGINT AS n_not,
    COUNT(CASE WHEN p_size = 5 THEN 1 END)::BIGINT AS n_five, 0::BIGINT AS n_text_number, ROUND(SUM(CASE WHEN p_type LIKE 'S%' AND p_size >= 10 THEN p_retailprice ELSE 0 END), 2) AS s_both FROM part""",
)
def criteria_wildcards(spark, sf_dir):
    """The criteria language: patterns, comparisons, and a plain text that never matches a number."""
    df = table(spark, sf_dir, "part")
    test = lambda **k: criteria.condition(df, k)
    return df.agg(
        criteria.countifs(test(p_type="S*")).alias("n_prefix"), criteria.countifs(test(p_type="*MO*")).alias("n_inner"), criteria.countifs(test(p_brand="Brand#1?")).alias("n_one"), criteria.countifs(test(p_type="<>PROMO")).alias("n_not"),
        criteria.countifs(test(p_size="=5")).alias("n_five"), criteria.countifs(test(p_size="5")).alias("n_text_number"), F.round(criteria.sumifs(F.col("p_retailprice"), test(p_type="S*", p_size=">=10")), 2).alias("s_both"),
    )


@register(
    "criteria_forms",
    """SELECT n_like, n_unlike, n_trimmed, n_blank_operand, n_separator, n_blank, n_any_blank, n_not_one, n_one, n_filled, n_below, n_text_below FROM
    (SELECT COUNT(*) FILTER (c_mktsegment LIKE 'B%') AS n_like, COUNT(*) FILTER (c_mktsegment NOT LIKE 'B%') AS n_unlike, COUNT(*) FILTER (c_acctbal > 5000) AS n_trimmed, 0::BIGINT AS n_blank_operand, 0::BIGINT AS n_separator,
      COUNT(*) FILTER (c_mktsegment < 'F') AS n_text_below FROM customer)
    CROSS JOIN (SELECT COUNT(*) FILTER (quality IS NULL) AS n_blank, COUNT(*) FILTER (quality IS NULL) AS n_any_blank, COUNT(*) FILTER (quality IS DISTINCT FROM 1) AS n_not_one, COUNT(*) FILTER (quality = 1) AS n_one,
      COUNT(*) FILTER (quality IS NOT NULL) AS n_filled, COUNT(*) FILTER (quality < 1) AS n_below FROM documents LEFT JOIN labels USING (doc_id))""",
)
def criteria_forms(spark, sf_dir):
    """Patterns behind = and <>, trimmed criteria, operands that are no numbers, and blanks."""
    count = lambda df, **k: {n: criteria.countifs(criteria.condition(df, c)) for n, c in k.items()}
    people = table(spark, sf_dir, "customer")
    marked = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    segment, balance, quality = "c_mktsegment", "c_acctbal", "quality"
    first = count(people, n_like={segment: "=B*"}, n_unlike={segment: "<>B*"}, n_trimmed={balance: " >5000 "}, n_blank_operand={balance: "> 5000"}, n_separator={balance: ">5_000"}, n_text_below={segment: "<F"})
    second = count(marked, n_blank={quality: "="}, n_any_blank={quality: "*"}, n_not_one={quality: "<>1"}, n_one={quality: "=1"}, n_filled={quality: "<>"}, n_below={quality: "<1"})
    return people.agg(*(c.alias(n) for n, c in first.items())).crossJoin(marked.agg(*(c.alias(n) for n, c in second.items())))


@register("blockrefs_filter_project", """SELECT p_partkey, p_type, p_retailprice FROM part WHERE p_partkey > 1500""")
def blockrefs_filter_project(spark, sf_dir):
    """Rows by a key condition, fields by a name pattern."""
    block = blocks.Block("part", table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice", F.col("p_size").alias("size")), "p_partkey")
    return block.refs(">1500", "p_*")


@register("blockref_cell", """SELECT p_retailprice AS value, NULL::VARCHAR AS err FROM part WHERE p_partkey = 77""")
def blockref_cell(spark, sf_dir):
    """One cell by key."""
    return blocks.Block("part", table(spark, sf_dir, "part"), "p_partkey").ref(77, "p_retailprice")


@register("block_export", """SELECT n_name, n_regionkey FROM nation WHERE n_name IN ('FRANCE', 'CHINA', 'NATION_3', 'NATION_7')""")
def block_export(spark, sf_dir):
    """Some keys, some fields."""
    return blocks.Block("nation", table(spark, sf_dir, "nation"), "n_name").export(["FRANCE", "CHINA", "NATION_3", "NATION_7"], ["n_name", "n_regionkey"])


@register("block_sort", """SELECT s_suppkey, s_acctbal, ROW_NUMBER() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier""")
def block_sort(spark, sf_dir):
    """A block sorted by a field; the place is the rank of its distinct values, spread by key within ties."""
    df = table(spark, sf_dir, "supplier")
    block = blocks.Block("supplier", df, "s_suppkey")
    ordered = ranking.rank_of(block.sort("s_acctbal", descending=True), "s_acctbal", "first")
    from pyspark.sql import Window

    ties = F.row_number().over(Window.partitionBy("s_acctbal").orderBy("s_suppkey")) - 1
    return ordered.select("s_suppkey", "s_acctbal", (F.col("first") + ties).cast("long").alias("place"))


@register(
    "block_derived_checks",
    """SELECT o_orderkey AS key, 'gross' AS field, 'failed' AS status FROM orders WHERE NOT (o_totalprice * 1.2 < 400000) UNION ALL SELECT o_orderkey, 'priority', 'failed' FROM orders WHERE NOT (o_orderpriority <> '1-URGENT' OR o_totalprice > 1000)""",
)
def block_derived_checks(spark, sf_dir):
    """Derived fields by templates and the violations of row checks."""
    block = blocks.Block("orders", table(spark, sf_dir, "orders"), "o_orderkey", derived={"gross": F.col("o_totalprice") * 1.2}, checks={"gross": F.col("gross") < 400000, "priority": (F.col("o_orderpriority") != "1-URGENT") | (F.col("o_totalprice") > 1000)})
    return block.violations()


@register(
    "block_edits",
    """WITH e AS (SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'EDITED' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (7, 8)) SELECT * FROM e UNION ALL SELECT 100, 'ADDED', 1""",
)
def block_edits(spark, sf_dir):
    """A cell set, rows deleted and a row added."""
    df = table(spark, sf_dir, "nation")
    new = spark.createDataFrame([(100, "ADDED", 1)], df.schema)
    gone = spark.createDataFrame([(7,), (8,)], "n_nationkey int")
    return blocks.Block("nation", df, "n_nationkey").set_cell(3, "n_name", "EDITED").delete(gone).upsert(new).df


@register(
    "block_lines",
    """SELECT n_name, CASE WHEN n_nationkey = 2 THEN 6 WHEN n_nationkey BETWEEN 3 AND 6 THEN n_nationkey - 1 ELSE n_nationkey END + CASE WHEN (CASE WHEN n_nationkey = 2 THEN 6 WHEN n_nationkey BETWEEN 3 AND 6 THEN n_nationkey - 1 ELSE n_nationkey END) >= 10 THEN 2 ELSE 0 END AS ordinal
    FROM nation UNION ALL SELECT NULL, 10 UNION ALL SELECT NULL, 11""",
)
def block_lines(spark, sf_dir):
    """A line moved and two inserted."""
    df = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("ordinal"))
    out = blocks.Block("nation", df, "n_name").move_line(2, 6).insert_lines(10, 2).df
    return out.select("n_name", F.col("ordinal").cast("int").alias("ordinal"))


@register("block_cells_round_trip", """SELECT n_nationkey AS ordinal, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation""")
def block_cells_round_trip(spark, sf_dir):
    """A block as long cells and back (convert to block)."""
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ordinal"), "n_name", "n_regionkey")
    return blocks.from_cells(blocks.to_cells(df, ["n_name", "n_regionkey"]), {0: "name", 1: "region"})


@register(
    "vlookup_exact",
    """WITH f AS (SELECT c_custkey, MIN(c_mktsegment) AS c_mktsegment FROM customer GROUP BY 1) SELECT o_orderkey, c_mktsegment, CASE WHEN c_custkey IS NULL THEN '#N/A' END AS err FROM orders LEFT JOIN f ON o_custkey = c_custkey""",
)
def vlookup_exact(spark, sf_dir):
    """A column of exact lookups as one join; misses are #N/A."""
    segment = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return lookups.vlookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", segment, "c_custkey", "c_mktsegment").select("o_orderkey", "c_mktsegment", "err")


@register(
    "vlookup_approximate",
    """WITH k AS (SELECT o_totalprice AS k, MIN(o_orderkey) AS v FROM orders GROUP BY 1), a AS (SELECT c_custkey, c_acctbal * 40 AS x FROM customer)
    SELECT c_custkey, v, CASE WHEN k IS NULL THEN '#N/A' END AS err FROM a ASOF LEFT JOIN k ON a.x >= k.k""",
)
def vlookup_approximate(spark, sf_dir):
    """Approximate lookups as an as-of join: the largest key at or below each value."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("k"), F.col("o_orderkey").alias("v"))
    left = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") * 40).alias("x"))
    return lookups.approximate(left, "x", keys, "k", "v", position="v").select("c_custkey", "v", "err")


@register("vlookup_wildcard", """WITH q AS (SELECT * FROM (VALUES ('S*'), ('*MO*'), ('zz*')) t(p)) SELECT p, (SELECT MIN(p_partkey) FROM part WHERE (p = 'S*' AND p_type LIKE 'S%') OR (p = '*MO*' AND p_type LIKE '%MO%')) AS p_partkey, CASE WHEN p = 'zz*' THEN '#N/A' END AS err FROM q""")
def vlookup_wildcard(spark, sf_dir):
    """Approximate lookup of texts: the first row that matches a pattern."""
    left = spark.createDataFrame([("S*",), ("*MO*",), ("zz*",)], "p string")
    return lookups.wildcard(left, "p", table(spark, sf_dir, "part").select("p_type", "p_partkey"), "p_type", "p_partkey", "p_partkey").select("p", "p_partkey", "err")


@register("blockref_column", """SELECT l_orderkey, l_linenumber, l_partkey, p_brand, NULL::VARCHAR AS err FROM lineitem JOIN part ON l_partkey = p_partkey""")
def blockref_column(spark, sf_dir):
    """A filled column of keyed references as one join."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lookups.blockref(li, "l_partkey", table(spark, sf_dir, "part"), "p_partkey", "p_brand", position="p_partkey")


@register(
    "match_positions",
    """SELECT (SELECT MIN(s_suppkey) FROM supplier WHERE s_acctbal = (SELECT s_acctbal FROM supplier WHERE s_suppkey = 5)) AS exact, (SELECT ARG_MAX(s_suppkey, (s_acctbal, s_suppkey)) FROM supplier WHERE s_acctbal <= 3000) AS below, (SELECT ARG_MAX(s_suppkey, (-s_acctbal, s_suppkey)) FROM supplier WHERE s_acctbal >= 3000) AS above""",
)
def match_positions(spark, sf_dir):
    """MATCH with its three kinds."""
    df = table(spark, sf_dir, "supplier")
    value = df.filter("s_suppkey = 5").select("s_acctbal").first()[0]
    parts = [lookups.match(df, "s_acctbal", "s_suppkey", v, k) for v, k in ((value, 0), (3000.0, 1), (3000.0, -1))]
    a, b, c = (p.withColumnRenamed("position", n) for p, n in zip(parts, ("exact", "below", "above"), strict=True))
    return a.crossJoin(b).crossJoin(c)  # one row each


def cells(spark, sf_dir):
    """The nation table as a long relation."""
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ordinal"), "n_nationkey", "n_name", "n_regionkey")
    return blocks.to_cells(df, ["n_nationkey", "n_name", "n_regionkey"]).select(F.lit("Sheet1").alias("sheet"), "r", "c", "value")


@register("index_offset", """SELECT n_nationkey AS r, 1 AS c, n_name AS value, 'index' AS how FROM nation WHERE n_nationkey = 4 UNION ALL SELECT n_nationkey, 2, CAST(n_regionkey AS VARCHAR), 'offset' FROM nation WHERE n_nationkey BETWEEN 6 AND 8""")
def index_offset(spark, sf_dir):
    """INDEX and OFFSET over cells."""
    x = cells(spark, sf_dir)
    return lookups.index(x, 5, 2).select("r", "c", "value", F.lit("index").alias("how")).unionByName(lookups.offset(x, 1, 0, 5, 2, 3, 1).select("r", "c", "value", F.lit("offset").alias("how")))


@register("indirect_refs", """SELECT * FROM (VALUES ('B3', (SELECT n_name FROM nation WHERE n_nationkey = 2), NULL), ('R5C2', (SELECT n_name FROM nation WHERE n_nationkey = 4), NULL), ('nonsense', NULL, '#REF!')) t(ref, value, err)""")
def indirect_refs(spark, sf_dir):
    """INDIRECT by A1 and R1C1 text."""
    refs = spark.createDataFrame([("B3",), ("R5C2",), ("nonsense",)], "ref string")
    return lookups.indirect(cells(spark, sf_dir), refs, "ref").select("ref", "value", "err")


@register("range_operators", """SELECT n_nationkey AS r, 'union' AS how FROM nation WHERE n_nationkey BETWEEN 2 AND 5 UNION ALL SELECT n_nationkey, 'union' FROM nation WHERE n_nationkey BETWEEN 4 AND 8 UNION ALL SELECT n_nationkey, 'inter' FROM nation WHERE n_nationkey BETWEEN 4 AND 5 UNION ALL SELECT n_nationkey, 'hull' FROM nation WHERE n_nationkey BETWEEN 2 AND 8""")
def range_operators(spark, sf_dir):
    """Union keeps duplicates, intersection and hull are rectangles."""
    a, b, x = ranges.Range("Sheet1", 2, 1, 5, 1), ranges.Range("Sheet1", 4, 1, 8, 1), cells(spark, sf_dir)
    parts = [(ranges.union(x, [a, b]), "union"), (ranges.intersection(a, b).of(x), "inter"), (ranges.hull(a, b).of(x), "hull")]
    out = [df.select(F.col("r"), F.lit(how).alias("how")) for df, how in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("rank_by_group", """SELECT o_orderkey, RANK() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS place FROM orders""")
def rank_by_group(spark, sf_dir):
    """RANK within groups by counts of distinct values."""
    return ranking.rank_of(table(spark, sf_dir, "orders"), "o_totalprice", "place", by=["o_orderpriority"]).select("o_orderkey", "place")


@register("rank_average", """SELECT p_partkey, RANK() OVER (ORDER BY p_size DESC) + (COUNT(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS place FROM part""")
def rank_average(spark, sf_dir):
    """RANK.AVG over a whole column: the window runs over distinct sizes."""
    return ranking.rank_of(table(spark, sf_dir, "part"), "p_size", "place", average=True).select("p_partkey", "place")


@register(
    "order_statistics",
    """SELECT (SELECT l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC LIMIT 1 OFFSET 9) AS large10, (SELECT l_extendedprice FROM lineitem ORDER BY l_extendedprice LIMIT 1 OFFSET 4) AS small5, (SELECT COUNT(*) + 1 FROM orders WHERE o_totalprice > (SELECT o_totalprice FROM orders WHERE o_orderkey = 3))::DOUBLE AS rank_eq""",
)
def order_statistics(spark, sf_dir):
    """LARGE, SMALL and RANK of one value, without sorting the table."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    x = o.filter("o_orderkey = 3").select("o_totalprice").first()[0]
    a = ranking.top_k(li, "l_extendedprice", 10).select(F.col("value").alias("large10"))
    b = ranking.top_k(li, "l_extendedprice", 5, largest=False).select(F.col("value").alias("small5"))
    c = ranking.rank_value(o, "o_totalprice", x).select(F.col("value").alias("rank_eq"))
    return a.crossJoin(b).crossJoin(c)  # one row each


@register("trimmed_and_modes", """WITH t AS (SELECT p_type, p_size, ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY p_size) AS i, COUNT(*) OVER (PARTITION BY p_type) AS n FROM part), m AS (SELECT p_type, p_size, COUNT(*) AS k, MIN(p_partkey) AS f FROM part GROUP BY 1, 2), a AS (SELECT p_type, AVG(p_size) AS mu FROM part GROUP BY 1)
    SELECT t.p_type, ROUND(AVG(t.p_size), 6) AS trimmed, (SELECT m.p_size FROM m WHERE m.p_type = t.p_type ORDER BY k DESC, f LIMIT 1) AS mode, (SELECT ROUND(AVG(ABS(p.p_size - a.mu)), 6) FROM part p JOIN a ON a.p_type = p.p_type WHERE p.p_type = t.p_type) AS avedev
    FROM t WHERE i > FLOOR(n * 0.2 / 2) AND i <= n - FLOOR(n * 0.2 / 2) GROUP BY t.p_type""")
def trimmed_and_modes(spark, sf_dir):
    """TRIMMEAN, MODE and AVEDEV by group."""
    df, by = table(spark, sf_dir, "part"), ["p_type"]
    t = ranking.trim_mean(df, "p_size", 0.2, by).select("p_type", F.round("value", 6).alias("trimmed"))
    m = ranking.mode_of(df, "p_size", "p_partkey", by).withColumnRenamed("value", "mode")
    d = ranking.mean_deviation(df, "p_size", by).select("p_type", F.round("value", 6).alias("avedev"))
    return t.join(m, "p_type").join(d, "p_type")


@register(
    "filled_formulas",
    """WITH t AS (SELECT event_id, user_id, value, ROW_NUMBER() OVER w AS nth, value - LAG(value) OVER w AS step, SUM(value) OVER (w ROWS UNBOUNDED PRECEDING) AS total, AVG(value) OVER (w ROWS 2 PRECEDING) AS mean3, LEAD(value) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, nth, ROUND(step, 4) AS step, ROUND(total, 2) AS total, ROUND(mean3, 4) AS mean3, next FROM t""",
)
def filled_formulas(spark, sf_dir):
    """Formulas filled down a column: lag, lead, running and sliding aggregates, occurrence counts."""
    by, order, v = ["user_id"], ["ts", "event_id"], F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", ranking.occurrence(by, order).cast("long").alias("nth"), F.round(v - ranking.previous("value", by, order), 4).alias("step"), F.round(ranking.running(F.sum("value"), by, order), 2).alias("total"),
        F.round(ranking.sliding(F.avg("value"), by, order, 2), 4).alias("mean3"), ranking.following("value", by, order).alias("next"),
    )


@register("whole_running_total", """SELECT o_orderkey, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cents FROM orders""")
def whole_running_total(spark, sf_dir):
    """=SUM(B$1:B5) down a whole table, in range parts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("x"))
    return ranking.cumulative(orders, "x", "o_orderkey", "cents").select("o_orderkey", F.col("cents").cast("long").alias("cents"))


@register(
    "linear_recurrence",
    """WITH RECURSIVE t AS (SELECT user_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), r AS (SELECT user_id, i, 0.5 * 0 + value AS x FROM t WHERE i = 1 UNION ALL SELECT t.user_id, t.i, 0.5::DOUBLE * r.x + t.value FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i + 1)
    SELECT user_id, i::BIGINT AS i, ROUND(x + 1e-8, 6) AS x FROM r""",
)
def linear_recurrence(spark, sf_dir):
    """X[r] = 0.5 X[r-1] + value[r] within each user."""
    from pyspark.sql import Window

    df = table(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("i"), F.lit(0.5).alias("a"), "value")
    return ranking.recurrence(df, ["user_id"], "i", 0.0, "a", "value", "x").select("user_id", "i", F.round(F.col("x") + 1e-8, 6).alias("x"))


@register("autofill_line", """SELECT i AS ordinal, 4.0::DOUBLE + 1.5 * (i + 1) AS value FROM range(0, 1000) t(i)""")
def autofill_line(spark, sf_dir):
    """Numbers continued in a line."""
    return fill.fill(spark, [1, 2.5, 4], 1000)


@register("goal_seek_rate", """SELECT c_custkey, ROUND(SQRT(ABS(c_acctbal) + 1), 4) AS x FROM customer""")
def goal_seek_rate(spark, sf_dir):
    """The input at which a formula meets a target, for every row."""
    df = table(spark, sf_dir, "customer").select("c_custkey", (F.abs("c_acctbal") + 1).alias("goal"))
    return fill.goal_seek(df, lambda x: x * x, F.col("goal"), 0, 1000, "x").select("c_custkey", F.round("x", 4).alias("x"))


@register("what_if_discounts", """SELECT CAST(s AS INTEGER) AS scenario, ROUND(SUM(l_extendedprice * (1 - d)), 2) AS revenue FROM lineitem, (VALUES (0, 0.0), (1, 0.1), (2, 0.2)) t(s, d) GROUP BY s""")
def what_if_discounts(spark, sf_dir):
    """Results under trial values, one pass."""
    return fill.what_if(table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_discount"), [{"l_discount": d} for d in (0.0, 0.1, 0.2)], {"revenue": F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)})


@register(
    "conditional_formats",
    """SELECT p_partkey, (CASE WHEN p_size > 40 THEN 1 ELSE 0 END + CASE WHEN p_size <= 40 AND p_type LIKE '%PROMO%' THEN 2 ELSE 0 END + CASE WHEN p_size <= 40 AND p_retailprice > (SELECT AVG(p_retailprice) FROM part) THEN 4 ELSE 0 END)::BIGINT AS mask, ROUND((p_size - (SELECT MIN(p_size) FROM part)) / ((SELECT MAX(p_size) - MIN(p_size) FROM part))::DOUBLE, 6) AS bar,
    COUNT(*) OVER (PARTITION BY p_retailprice) > 1 AS dup, p_retailprice >= (SELECT p_retailprice FROM part ORDER BY p_retailprice DESC LIMIT 1 OFFSET 9) AS top10 FROM part""",
)
def conditional_formats(spark, sf_dir):
    """Rules with priority and stop, data bars, duplicates, top ten and above average."""
    df = rules.above_average(table(spark, sf_dir, "part"), "p_retailprice", "above")
    df = rules.top(rules.duplicates(rules.scaled(df, "p_size", "bar"), "p_retailprice", "dup"), "p_retailprice", 10, "top10")
    size = F.col("p_size")
    bits = rules.mask([(rules.cell_is(size, ">", 40), True), (rules.cell_is(F.col("p_type"), "containsText", "promo"), False), (F.col("above"), False)])
    return df.select("p_partkey", bits.alias("mask"), F.round("bar", 6).alias("bar"), "dup", "top10")


@register("validation_rules", """SELECT p_partkey, p_type IN ('PROMO', 'SMALL') AS listed, p_size BETWEEN 10 AND 40 AS whole, LENGTH(p_name) > 8 AS longer FROM part""")
def validation_rules(spark, sf_dir):
    """List, whole-number and text-length validation."""
    return table(spark, sf_dir, "part").select("p_partkey", rules.in_list(F.col("p_type"), ["PROMO", "SMALL"]).alias("listed"), rules.valid(F.col("p_size"), "whole", "between", 10, 40).alias("whole"), rules.valid(F.col("p_name"), "textLength", ">", 8).alias("longer"))


@register("foreign_keys", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def foreign_keys(spark, sf_dir):
    """Membership violations as an anti join."""
    good = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return rules.not_in_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", good, "c_custkey").select("o_orderkey", "o_custkey")


@register("field_uniqueness", """WITH t AS (SELECT l_orderkey * 100 + l_linenumber AS x, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) AS i FROM lineitem) SELECT x AS key, 'unique' AS status FROM t WHERE i > 1""")
def field_uniqueness(spark, sf_dir):
    """Later copies of a key."""
    from pyspark.sql import Window

    df = table(spark, sf_dir, "lineitem").withColumn("x", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    df = df.withColumn("i", F.row_number().over(Window.partitionBy("x").orderBy("l_partkey", "l_suppkey", "l_shipdate")))
    return rules.field_checks(df, "x", "x", "i", unique=True)


def edit_log(spark, sf_dir):
    """Events as an edit log of one sheet: each event writes its value into its user's cell of its type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("version"), F.lit("s").alias("sheet"), F.col("user_id").cast("int").alias("r"), F.length("event_type").cast("int").alias("c"), F.col("value").cast("string").alias("value"))


@register("version_state", """SELECT 's' AS sheet, CAST(user_id AS INTEGER) AS r, CAST(LENGTH(event_type) AS INTEGER) AS c, MAX(event_id) AS last_version FROM events WHERE event_id <= (SELECT MAX(event_id) // 2 FROM events) GROUP BY 1, 2, 3""")
def version_state(spark, sf_dir):
    """The cells at a version of an edit log: the one at its middle."""
    log = edit_log(spark, sf_dir).withColumn("value", F.col("version").cast("string"))
    return versions.state_at(log, log.agg(F.max("version")).first()[0] // 2).select("sheet", "r", "c", F.col("value").cast("long").alias("last_version"))


@register(
    "version_diff",
    """WITH a AS (SELECT user_id, LENGTH(event_type) AS c, MAX(event_id) AS v FROM events WHERE event_id <= (SELECT MAX(event_id) // 2 FROM events) GROUP BY 1, 2), b AS (SELECT user_id, LENGTH(event_type) AS c, MAX(event_id) AS v FROM events GROUP BY 1, 2)
    SELECT CAST(user_id AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(a.v AS VARCHAR) AS before, CAST(b.v AS VARCHAR) AS after, CASE WHEN a.v IS NULL THEN 'added' ELSE 'changed' END AS change FROM b LEFT JOIN a USING (user_id, c) WHERE a.v IS NULL OR a.v <> b.v""",
)
def version_diff(spark, sf_dir):
    """What changed between two versions: the middle and the last one."""
    log = edit_log(spark, sf_dir).withColumn("value", F.col("version").cast("string"))
    last = log.agg(F.max("version")).first()[0]
    return versions.diff(versions.state_at(log, last // 2), versions.state_at(log, last)).drop("sheet")


@register("rows_inserted", """SELECT n_nationkey + CASE WHEN n_nationkey >= 5 THEN 2 WHEN n_nationkey = 4 THEN -1 ELSE 0 END AS r, n_name AS value FROM nation WHERE n_nationkey <> 3""")
def rows_inserted(spark, sf_dir):
    """Rows deleted and inserted: later cells move."""
    x = cells(spark, sf_dir).filter("c = 1")
    out = versions.shift_insert(versions.shift_delete(x, "Sheet1", 3, 1), "Sheet1", 4, 3)
    return out.select(F.col("r").cast("int").alias("r"), "value")


@register(
    "dependents",
    """WITH RECURSIVE e AS (SELECT p_partkey AS cell, CAST(FLOOR(p_partkey / 2) AS BIGINT) AS uses FROM part WHERE p_partkey > 1), r AS (SELECT 3::BIGINT AS cell, 0 AS level UNION ALL SELECT e.cell, r.level + 1 FROM e JOIN r ON e.uses = r.cell) SELECT cell, level FROM r""",
)
def dependents(spark, sf_dir):
    """All cells that depend on one, with their level."""
    edges = table(spark, sf_dir, "part").filter("p_partkey > 1").select(F.col("p_partkey").alias("cell"), F.floor(F.col("p_partkey") / 2).cast("long").alias("uses"))
    return graph.trace(edges, spark.createDataFrame([(3,)], "cell long"))


@register("calculation_levels", """SELECT p_partkey AS cell, CAST(FLOOR(LOG2(p_partkey)) AS INTEGER) AS level FROM part WHERE p_partkey > 0""")
def calculation_levels(spark, sf_dir):
    """Order of recalculation."""
    part = table(spark, sf_dir, "part").filter("p_partkey > 0")
    edges = part.filter("p_partkey > 1").select(F.col("p_partkey").alias("cell"), F.floor(F.col("p_partkey") / 2).cast("long").alias("uses"))
    return graph.levels(edges, part.select(F.col("p_partkey").alias("cell")))


@register("cycle_solver", """SELECT 'A1' AS cell, 20.0::DOUBLE AS value UNION ALL SELECT 'B1', 40.0""")
def cycle_solver(spark, sf_dir):
    """A cycle of linear formulas: A1 = 0.5 A1 + 10, B1 = 2 A1."""
    terms = spark.createDataFrame([("A1", "A1", 0.5), ("B1", "A1", 2.0)], "cell string, uses string, weight double")
    constants = spark.createDataFrame([("A1", 10.0), ("B1", 0.0)], "cell string, constant double")
    return graph.solve_linear(terms, constants, close=1e-4).select("cell", F.round("value", 3).alias("value"))


@register(
    "csv_lines",
    """SELECT CAST(conv_id AS VARCHAR) || ',' || CAST(turn AS VARCHAR) || ',' || CASE WHEN regexp_matches(text, '[",\r\n]') THEN '"' || REPLACE(text, '"', '""') || '"' ELSE text END AS line FROM conversations""",
)
def csv_lines(spark, sf_dir):
    """Records by the export rules."""
    return files.to_csv_lines(table(spark, sf_dir, "conversations"), ["conv_id", "turn", "text"])


@register("cell_types", """SELECT e.event_id, CASE WHEN event_type = 'click' THEN 'number' ELSE 'text' END AS kind, CASE WHEN event_type = 'click' THEN value END AS num FROM events e""")
def cell_types(spark, sf_dir):
    """Types of cells by what their text shows."""
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", F.col("value").cast("string")).otherwise(F.concat(F.lit("'"), F.col("value").cast("string"))).alias("value"))
    return files.typed(df).select("event_id", "kind", "num")


@register("used_ranges", """SELECT 'Sheet1' AS sheet, MAX(n_nationkey) + 1 AS rows, 3 AS columns FROM nation""")
def used_ranges(spark, sf_dir):
    """The extent of a sheet."""
    return files.used_range(cells(spark, sf_dir))


@register("event_windows", """SELECT event_type, TIME_BUCKET(INTERVAL 1 HOUR, ts) AS start, COUNT(*)::BIGINT AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    """Tumbling windows; the same plan runs on a stream."""
    out = edits.windowed(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour", "10 minutes", {"n": F.count("*"), "total": F.round(F.sum("value"), 2)})
    return out.select("event_type", F.col("window.start").alias("start"), "n", "total")


@register("top_products", """SELECT l_partkey, ROUND(SUM(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1 ORDER BY revenue DESC, l_partkey LIMIT 10""")
def top_products(spark, sf_dir):
    """A top-ten report."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_partkey").limit(10)


@register(
    "revenue_by_region",
    """SELECT r_name, YEAR(o_orderdate) AS year, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def revenue_by_region(spark, sf_dir):
    """Chained keyed references, then a report: the large sides meet once, on the order key."""
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = lookups.bounded(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))
    who = c.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    sales = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return sales.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("v"), 2).alias("revenue"))


@register("host_function_memo", """SELECT p_partkey, LENGTH(p_type)::BIGINT * 2 AS twice FROM part""")
def host_function_memo(spark, sf_dir):
    """A host function over distinct arguments, joined back."""
    from gridspan.operators import extensions

    return extensions.memoised(table(spark, sf_dir, "part").select("p_partkey", "p_type"), ["p_type"], lambda x: x["p_type"].str.len() * 2, "twice", "long").select("p_partkey", "twice")


@register("field_templates", """SELECT o_orderkey, o_totalprice * 0.2 AS tax, o_totalprice * 1.2 AS gross, o_totalprice * 1.2 > 300000 AS large FROM orders""")
def field_templates(spark, sf_dir):
    """Fields derived from each other, in the order of their use."""
    from gridspan.operators import extensions

    fields = {"large": F.col("gross") > 300000, "gross": F.col("o_totalprice") * 1.2, "tax": F.col("o_totalprice") * 0.2}
    return extensions.templates(table(spark, sf_dir, "orders"), fields, {"large": ["gross"]}).select("o_orderkey", "tax", "gross", "large")


@register("data_boundaries", """SELECT n_nationkey AS r, LEAD(n_nationkey) OVER (ORDER BY n_nationkey) AS next, COALESCE(LEAD(n_nationkey) OVER (ORDER BY n_nationkey) <> n_nationkey + 1, TRUE) AS edge FROM nation WHERE n_nationkey NOT IN (5, 6, 11)""")
def data_boundaries(spark, sf_dir):
    """The next occupied cell of a column, and where runs end."""
    from gridspan.operators import extensions

    return extensions.next_occupied(cells(spark, sf_dir).filter("c = 1 AND r NOT IN (5, 6, 11)")).select("r", "next", "edge")


@register("percent_ranks", """WITH o AS (SELECT o_totalprice AS x FROM orders) SELECT FLOOR((SELECT COUNT(*) FROM o WHERE x < (SELECT MAX(x) FROM o)) / ((SELECT COUNT(*) FROM o) - 1)::DOUBLE * 1000 + 1e-9) / 1000 AS value, NULL::VARCHAR AS err""")
def percent_ranks(spark, sf_dir):
    """PERCENTRANK of one value by counts."""
    o = table(spark, sf_dir, "orders")
    return ranking.percent_rank(o, "o_totalprice", o.agg(F.max("o_totalprice")).first()[0])


@register("markdown_cells", """SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS key, 0 AS "table", r, c, CASE WHEN r = 0 THEN ['role', 'turn'][c + 1] WHEN c = 0 THEN role ELSE CAST(turn AS VARCHAR) END AS value FROM (SELECT conv_id, turn, role FROM conversations), (VALUES (0), (1)) a(r), (VALUES (0), (1)) b(c)""")
def markdown_cells(spark, sf_dir):
    """Cells of Markdown tables in texts."""
    text = F.concat(F.lit("Some text\n| role | turn |\n|------|:----:|\n| "), F.col("role"), F.lit(" | "), F.col("turn").cast("string"), F.lit(" |\nmore"))
    docs = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("k"), text.alias("t"))
    return files.markdown_tables(docs, "k", "t").select("key", F.col("table").cast("int").alias("table"), F.col("r").cast("int").alias("r"), "c", "value")


@register("branch_merge", """SELECT n_nationkey AS r, CASE WHEN n_nationkey = 3 THEN 'ours' WHEN n_nationkey = 5 THEN 'theirs' ELSE n_name END AS value, n_nationkey = 3 AS conflict FROM nation""")
def branch_merge(spark, sf_dir):
    """Two branches from one base, with a conflict."""
    base = cells(spark, sf_dir).filter("c = 1")
    edit = lambda **k: base.withColumn("value", F.coalesce(*(F.when(F.col("r") == int(r[1:]), v) for r, v in k.items()), "value"))
    return versions.merge(base, edit(r3="ours"), edit(r3="other", r5="theirs")).select("r", "value", "conflict")


@register("latest_descriptors", """SELECT user_id AS id, MAX(event_id) AS version, ARG_MAX(event_type, event_id) AS body FROM events GROUP BY 1""")
def latest_descriptors(spark, sf_dir):
    """The newest version of each descriptor."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.col("event_type").alias("body"))
    return edits.latest_descriptors(rows)


@register("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, MIN(ts) AS start, COUNT(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    """Session windows; the same plan runs on a stream."""
    out = edits.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "2 hours", "10 minutes", {"n": F.count("*")})
    return out.select("user_id", F.col("session.start").alias("start"), "n")
