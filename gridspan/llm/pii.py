"""Personal data by weak supervision, in DataFrame operations only.

Base patterns give spans that always stay. Wider patterns propose further candidates; regex, checksum, gazetteer and
context labelers vote yes, no or abstain on every candidate and base span. Spark counts the vote patterns over all
documents (at most 4 kinds x 3^5 patterns); expectation-maximisation over these counts, in which base spans are known to
be real, estimates the reliability of each labeler for each kind, and a logistic classifier of the votes is fitted to the
resulting posteriors. Its weights go into one Column expression that scores each candidate.

Edge cases: null and empty texts have no span. Rows that repeat are each reported. With no candidate anywhere the
estimates are the priors and nothing is added. Candidates that overlap a base span, or an earlier candidate, are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, rewritten
from .spans import found, luhn

KINDS = ["email", "ip", "card", "phone"]
# The base patterns: possessive, and starting where a run of their characters starts, so that long runs cost linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider shapes that may be personal data.
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]{1,63}+){1,5}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}(?:[.\x20/]\x20?[0-9]{4,6}){2,3}[0-9]{0,1}(?![0-9])",
    "phone": r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])",
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Words that speak for a kind just before it, in the corpus's languages.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|courriel|correo|contact|kontakt|contacto)\W{0,4}(?:\w+\W{1,3}){0,2}$",
    "ip": r"(?i)(?:\bip\b|ipv[46]|host|server|serveur|servidor|addr\w*|adresse)\W{0,4}(?:\w+\W{1,3}){0,2}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta|payment)\W{0,4}(?:\w+\W{1,3}){0,2}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|telefon|téléphone|teléfono|handy)\W{0,4}(?:\w+\W{1,3}){0,2}$",
}
AGAINST = r"(?i)(?:version|\bv\.?|isbn|issn|order|invoice|\bref|serial|page|\bfig|\bno\.?|[$€£#])\W{0,3}$"
# Gazetteers: top-level domains, first digits of issuers, area code shapes.
DOMAINS = r"(?i)(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?(?:com|org|net|edu|gov|io|info|biz|de|fr|es|it|eu|uk|us|ca|mx|ch|at|be|nl)$"
# Address blocks that hosts have, of both versions.
BLOCKS = r"(?i)^(?:0*(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.|(?:2[0-9a-f]{3}|3[0-9a-f]{3}|f[cd][0-9a-f]{2}|fe80):)"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6)"
AREAS = r"^\(?(?:[2-9][0-9]{2}|0[0-9]{1,3})\)?[\x20.-]"
LABELERS = ["strict", "check", "gazetteer", "context", "against"]
VOTES = "array<struct<kind:int,start:int,stop:int,base:boolean,votes:array<int>>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def valid(kind: str):
    """The checks that a base match must pass, as a function of the match."""

    def check(x: Column) -> Column:
        n = F.length(_digits(x["match"]))
        if kind == "ip":
            return x["match"].rlike(rf"^{PART}(?:\.{PART}){{3}}$")
        if kind == "card":
            return n.between(16, 19) & luhn(_digits(x["match"]))
        return n.between(8, 15) if kind == "phone" else F.lit(True)

    return check


def _votes(kind: str, x: Column, base: bool) -> Column:
    """1 for, 0 against, -1 no opinion, one for each labeler."""
    m, no = x["match"], F.lit(-1)
    n = F.length(_digits(m))
    parts = F.split(m, r"\.|\x20?[(\[{](?i:dot)[)\]}]\x20?")
    check = {
        "email": F.when((F.size(parts) >= 2) & F.element_at(parts, -1).rlike("^[A-Za-z]{2,}$"), 1).otherwise(0),
        "ip": F.when(m.rlike(r"^0+[.:]") | m.rlike(r"(?i)^([0-9a-f]+)(?:[.:]\1)+$"), 0).otherwise(1),
        "card": F.when(n.between(13, 19) & luhn(_digits(m)), 1).otherwise(0),
        "phone": F.when(n.between(8, 15) & ~_digits(m).rlike(r"^([0-9])\1+$"), 1).otherwise(0),
    }
    names = {"email": F.when(m.rlike(DOMAINS), 1).otherwise(0), "ip": F.when(m.rlike(BLOCKS), 1).otherwise(0), "card": F.when(m.rlike(ISSUERS), 1).otherwise(0), "phone": F.when(m.rlike(r"^\+"), 1).when(m.rlike(AREAS), 1).otherwise(0)}
    return F.array(
        F.lit(1 if base else -1),
        check[kind],
        names[kind],
        F.when(x["before"].rlike(CUES[kind]), 1).otherwise(-1),
        F.when(x["before"].rlike(AGAINST), 0).otherwise(-1),
    )


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def candidates(docs: DataFrame, carry: list[str]) -> DataFrame:
    """`carry` columns of docs and `found`: base spans and wider candidates with their votes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digit = text.rlike("[0-9]")
    needs = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    wide_needs = {"email": text.rlike(r"(?i)[(\[{]at[)\]}]"), "ip": text.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]"), "card": digit, "phone": digit}
    df = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), *(F.filter(found(text, BASE[k], needs[k]), valid(k)).alias(f"base_{k}") for k in KINDS), *(found(text, WIDE[k], wide_needs[k]).alias(f"wide_{k}") for k in KINDS))
    held = F.concat(*(F.transform(f"base_{k}", lambda x: F.struct(x["start"], x["stop"])) for k in KINDS))
    df = df.withColumn("held", held)

    def entry(k, base):
        return lambda x: F.struct(F.lit(KINDS.index(k)).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), F.lit(base).alias("base"), _votes(k, x, base).alias("votes"))

    parts = [F.transform(f"base_{k}", entry(k, True)) for k in KINDS]
    parts += [F.transform(F.filter(f"wide_{k}", lambda x: ~F.exists("held", lambda y: _overlaps(x, y))), entry(k, False)) for k in KINDS]
    return df.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), F.concat(*(p.cast(VOTES) for p in parts)).alias("found"))


class Reliability:
    """What expectation-maximisation and the classifier learnt, each by kind: reliabilities of the labelers, bias and weights of their votes."""

    #: Chances of a vote of 1, -1, 0 before anything is counted, for real and for other candidates, and how many candidates they weigh.
    FIRST, STRENGTH, PRIOR = ({1: 0.6, -1: 0.35, 0: 0.05}, {1: 0.15, -1: 0.35, 0: 0.5}), 20.0, 0.3

    def __init__(self, counts: dict[tuple[int, tuple[int, ...]], int], rounds: int = 40):
        self.belief: dict = {}
        self.chances = {k: [[dict(d) for d in self.FIRST] for _ in LABELERS] for k in range(len(KINDS))}
        self.bias, self.weights = [], []
        for kind in range(len(KINDS)):
            own = {votes: n for (k, votes), n in counts.items() if k == kind}
            self._reliabilities(kind, own, rounds)
            bias, weights = self._classifier({v: (n, self.belief[kind, v]) for v, n in own.items()})
            self.bias.append(bias)
            self.weights.append(weights)

    def _reliabilities(self, kind: int, own: dict[tuple[int, ...], int], rounds: int) -> None:
        """Beliefs of the vote patterns of one kind. Base spans are real; they anchor which side of the mixture is which."""
        chances, prior = self.chances[kind], self.PRIOR
        for _ in range(rounds if own else 0):
            for votes in own:
                odds = [1 - prior, prior]
                for both, v in zip(chances[1:], votes[1:], strict=True):
                    odds = [odds[0] * both[1][v], odds[1] * both[0][v]]
                self.belief[kind, votes] = 1.0 if votes[0] == 1 else odds[1] / (odds[0] + odds[1])
            loose = [(n, self.belief[kind, v]) for v, n in own.items() if v[0] != 1]
            prior = (self.PRIOR * self.STRENGTH + sum(n * p for n, p in loose)) / (self.STRENGTH + sum(n for n, _ in loose))
            for j, both in enumerate(chances):
                for side in (0, 1):  # 0: real, 1: not
                    mass = {v: self.STRENGTH * self.FIRST[side][v] for v in (1, 0, -1)}
                    for votes, n in own.items():
                        p = self.belief[kind, votes]
                        mass[votes[j]] += n * (p if side == 0 else 1 - p)
                    both[side] = {v: m / sum(mass.values()) for v, m in mass.items()}

    @staticmethod
    def _classifier(patterns: dict[tuple[int, ...], tuple[int, float]], steps: int = 600, rate: float = 0.5, shrink: float = 1e-3) -> tuple[float, dict[tuple[int, int], float]]:
        """Logistic regression of the posterior on the votes, all labelers but the base pattern itself; started at fair votes."""
        start = {(j, v): (1.2 if v else -1.2) for j in range(1, len(LABELERS)) for v in (0, 1)}
        bias, weights = -1.5, dict(start)
        data = [([(j, v) for j, v in enumerate(votes) if j and v >= 0], p, math.log1p(n)) for votes, (n, p) in patterns.items()]
        total = sum(w for *_, w in data) or 1.0
        for _ in range(steps if data else 0):
            grad_b, grad = 0.0, {x: shrink * (weights[x] - start[x]) for x in weights}
            for on, p, w in data:
                error = (1 / (1 + math.exp(-(bias + sum(weights[x] for x in on)))) - p) * w / total
                grad_b += error
                for x in on:
                    grad[x] += error
            bias = min(-0.5, bias - rate * grad_b)  # a candidate needs a vote
            weights = {x: w - rate * grad[x] for x, w in weights.items()}
        return bias, weights

    def chance(self, kind: int, votes: tuple[int, ...]) -> float:
        """The classifier's probability for one vote pattern."""
        return 1 / (1 + math.exp(-(self.bias[kind] + sum(self.weights[kind][j, v] for j, v in enumerate(votes) if j and v >= 0))))

    def score(self, x: Column) -> Column:
        """Probability that a candidate is personal data, as a Column."""
        total = F.element_at(F.array(*map(F.lit, self.bias)), x["kind"] + 1)
        for j in range(1, len(LABELERS)):
            vote = F.element_at(x["votes"], j + 1)
            of = lambda v: F.element_at(F.array(*(F.lit(w[j, v]) for w in self.weights)), x["kind"] + 1)  # noqa: E731, B023
            total = total + F.when(vote == 1, of(1)).when(vote == 0, of(0)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(table: DataFrame) -> Reliability:
    """Learn from a table with the column `found`."""
    rows = table.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes").count().collect()
    return Reliability({(r["kind"], tuple(r["votes"])): r["count"] for r in rows})


def classify(table: DataFrame, model: Reliability, threshold: float = 0.5) -> DataFrame:
    """`found` becomes `spans`, array<struct<kind, start, stop, base>> by kind and start: base spans and accepted ones."""
    accepted = F.filter("found", lambda x: x["base"] | (model.score(x) >= threshold))
    ordered = F.array_sort(F.transform(accepted, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"), x["base"].alias("base"))))
    clear = F.filter(ordered, lambda x, i: x["base"] | ~F.exists(F.slice(ordered, F.lit(1), i), lambda y: ~y["base"] & (x["start"] < y["stop"])))
    by_kind = F.array_sort(F.transform(clear, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["base"].alias("base"))))
    return table.withColumn("spans", by_kind).drop("found")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row of docs."""
    table = keep(candidates(docs, ["doc_id"]), "pii")
    return classify(table, fit(table))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by <KIND>; n_chars, where there is one, follows the text."""
    model = fit(candidates(docs, []))

    def change(inner: DataFrame) -> DataFrame:
        table = classify(candidates(inner, inner.columns), model)
        ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
        name = lambda x: F.upper(F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1))
        clear = F.aggregate(
            ordered,
            F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda acc, x: F.struct(
                F.greatest(acc["at"], x["stop"]).alias("at"),
                F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), name(x), F.lit(">"))).otherwise(acc["out"]).alias("out"),
            ),
            lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
        )
        table = table.withColumn("changed", F.size("spans") > 0)
        return table.withColumn("text", F.when(F.col("changed"), clear).otherwise(F.col("text")))

    return rewritten(docs, change)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")
