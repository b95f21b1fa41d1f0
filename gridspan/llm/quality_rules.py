"""Quality rules as a learned decision list, in DataFrame operations only.

Text statistics are Column expressions. Sequential covering learns from the labelled rows: each step asks Spark for one
small histogram (feature, bin) -> rows of either label among the rows that a growing rule still covers, adds the
condition that gains most, and stops when the rule is pure; pruning on a hash-held part of the rows drops conditions
that do not pay there. Rules go, in order, into one CASE expression. All labelled rows count; only histograms of
FEATURES x bins rows reach the driver.

Edge cases: a null text has no word and fails the base. Null, repeated or missing labels: null ones are left out, a
document with several labels counts once for each. Without labels of both kinds the list is empty and the base decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Features that conditions may test, from the statistics.
FEATURES = {
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
    "n_words": "double(n_words)",
}
#: Quantiles at which a feature is cut into bins.
CUTS = [0.01, 0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.2, 0.3, 0.5, 0.7, 0.8, 0.85, 0.88, 0.9, 0.92, 0.95, 0.98, 0.99]


def _found(col: str, pattern: str) -> Column:
    return F.regexp_count(F.col(col), F.lit(pattern)).cast("long")


def _hashes(words: str) -> Column:
    """One 64-bit hash for each 8-word window."""
    return F.expr(
        f"case when size({words}) >= {WINDOW} then transform(sequence(0, size({words}) - {WINDOW}), i -> xxhash64("
        + ", ".join(f"get(hashes, i + {k})" for k in range(WINDOW))
        + ")) else cast(array() as array<bigint>) end"
    )


def _repeated() -> Column:
    """Words inside windows whose hash occurs twice: positions of repeated windows widened to words, counted by their gaps."""
    return F.aggregate(
        F.col("starts"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")),
        lambda acc, i: F.struct((acc["n"] + WINDOW - F.greatest(F.lit(0), acc["end"] - i)).alias("n"), (i + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )


def statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """`carry` columns of docs and the statistics of `text`; nothing is shuffled."""
    df = docs.select(*carry, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), 0)).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("windows", _hashes("words"))
    df = df.withColumn("twice", F.size(F.array_distinct("windows")) < F.size("windows"))
    ordered = F.when(F.col("twice"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("s", ordered)
    again = F.filter(F.col("s"), lambda x, k: (F.get("s", k - 1)["h"].eqNullSafe(x["h"])) | (F.get("s", k + 1)["h"].eqNullSafe(x["h"])))
    df = df.withColumn("starts", F.when(F.col("twice"), F.array_sort(F.transform(again, lambda x: x["i"]))))
    return df.select(
        *carry,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _found("text", SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_repeated(), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _found("text", "[A-Z]").alias("n_upper"),
        _found("text", "[!?|]").alias("n_marks"),
        F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct"),
    )


def base_failed() -> Column:
    """Too few words, or too many inside repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


class Condition:
    """feature <= value or feature > value."""

    def __init__(self, feature: str, above: bool, value: float):
        self.feature, self.above, self.value = feature, above, value

    def column(self, features: dict[str, Column]) -> Column:
        """The condition as a Column."""
        return features[self.feature] > self.value if self.above else features[self.feature] <= self.value

    def __repr__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


Rule = list[Condition]


def _both(rule: Rule, features: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(features)
    return out


def _any(rules: list[Rule], features: dict[str, Column]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | _both(r, features)
    return out


def learn(labelled: DataFrame, label: str = "quality", max_rules: int = 6, max_conditions: int = 3, least_precision: float = 0.8, least_cover: int = 3) -> list[Rule]:
    """Rules for rejecting, in order. labelled: the statistics and a 0/1 label."""
    table = keep(labelled.filter(F.col(label).isNotNull()).select((F.col(label) == 0).alias("bad"), *(F.expr(c).alias(f) for f, c in FEATURES.items()), (F.pmod(F.xxhash64(*map(F.expr, FEATURES.values())), F.lit(3)) == 0).alias("prune")), "labelled")
    here = {f: F.col(f) for f in FEATURES}
    names = list(FEATURES)
    cuts_row = table.agg(*(F.percentile_approx(f, F.array(*map(F.lit, CUTS)), 10_000).alias(f) for f in names)).first()
    cuts = {f: sorted(set(cuts_row[f] or [])) for f in names}

    def bins(df: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
        """Counts of (all, bad) by feature and number of cuts that the value exceeds."""
        marks = F.array(*(sum(((F.col(f) > float(v)).cast("int") for v in cuts[f]), F.lit(0)) for f in names))
        rows = df.select("bad", F.posexplode(marks).alias("f", "bin")).groupBy("f", "bin").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("b")).collect()
        return {(names[r["f"]], r["bin"]): (r["n"], r["b"]) for r in rows}

    def counts(df: DataFrame, choices: list[Column]) -> list[tuple[int, int]]:
        got = df.agg(*(F.count(F.when(c, 1)).alias(f"n{i}") for i, c in enumerate(choices)), *(F.count(F.when(c & F.col("bad"), 1)).alias(f"b{i}") for i, c in enumerate(choices))).first()
        return [(got[f"n{i}"], got[f"b{i}"]) for i in range(len(choices))]

    rules: list[Rule] = []
    for _ in range(max_rules):
        left = table.filter(~_any(rules, here))
        rule: Rule = []
        n, b = 0, 0
        for _ in range(max_conditions):
            found = bins(left.filter(~F.col("prune")).filter(_both(rule, here)))
            if not rule:
                n, b = (sum(x[i] for (f, _), x in found.items() if f == names[0]) for i in (0, 1))
            if not b or b == n:
                break
            best, gain = None, 0.0
            for f in names:
                for k, value in enumerate(cuts[f]):
                    below = [sum(x[i] for (g, j), x in found.items() if g == f and j <= k) for i in (0, 1)]
                    for above, (m, c) in ((False, below), (True, (n - below[0], b - below[1]))):
                        if c >= least_cover and (won := c * (math.log2(c / m) - math.log2(b / n))) > gain + 1e-12:
                            best, gain = (Condition(f, above, value), m, c), won
            if best is None:
                break
            rule.append(best[0])
            n, b = best[1:]
        if not rule:
            break
        # prune: keep the prefix that is worth most on the held part
        values = counts(left.filter("prune"), [_both(rule[: i + 1], here) for i in range(len(rule))])
        worth = [(2 * c - m) / m if m else -1.0 for m, c in values]
        if max(worth) > -1.0:
            rule = rule[: worth.index(max(worth)) + 1]
        m, c = counts(left, [_both(rule, here)])[0]
        if c < least_cover or c < least_precision * m:
            break
        rules.append(rule)
    return rules


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """stats with base_failed, kept and rule: the number of the rule that rejected, or null."""
    case, features = F.lit(None).cast("int"), {f: F.expr(c) for f, c in FEATURES.items()}
    for i, rule in reversed(list(enumerate(rules, 1))):
        case = F.when(_both(rule, features), i).otherwise(case)
    out = stats.withColumns({"base_failed": base_failed(), "rule": case})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, rule and kept of every row of docs, by rules learnt from the labels."""
    stats = keep(statistics(docs, ["doc_id"]), "statistics")
    marked = stats.join(labels.select(F.col("doc_id").alias("doc_id"), "quality"), "doc_id")
    return judge(stats, learn(marked))
