"""Quality by positive-unlabelled learning.

Trusted positives are the rows labelled 1, the unlabelled web text is every row outside the held-out fold, and the class
prior is estimated from the labels. The classifier minimises the non-negative unbiased risk
pi E_p[l(f, 1)] + max(0, E_u[l(f, 0)] - pi E_p[l(f, 0)]) with the logistic loss over text statistics: convex in the
weights, so Newton steps take the sums of gradient and curvature that Spark adds up over all rows. A step that would take
the second term below zero is halved. Several step sizes are tried in one pass over the rows, so learning takes at most
`rounds` + 1 passes.

Edge cases: null and empty texts have the statistics of an empty text and a score like any other. Null labels and ids
teach nothing. A document with several labels is positive if any is 1. Without positives the score is the prior.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, keep

SYMBOL = re.compile(r"[#*$%&|<>]")
UPPER = re.compile(r"[A-Z]")
DIGIT = re.compile(r"[0-9]")
MARK = re.compile(r"[!?|]")
N_PLAIN = 13
#: Step sizes that one pass tries, the first that will do is taken.
SIZES = [1.0, 0.5, 0.25, 2.0**-4, 2.0**-7, 2.0**-11]


def features(text: str | None) -> list[float]:
    """Statistics of a whole text, each about 0 to 1, and their squares, after a constant."""
    text = text or ""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, chars = max(1, len(words)), max(1, len(text))
    lengths = [len(w) for w in words]
    same = sum(map(str.__eq__, words, words[1:]))
    plain = [
        math.log1p(len(words)) / 10,
        len(SYMBOL.findall(text)) / n,
        len(UPPER.findall(text)) / chars,
        len(DIGIT.findall(text)) / chars * 4,
        len(MARK.findall(text)) / n,
        min(1.0, len(set(words)) / math.sqrt(n) / 20),
        len(set(words)) / n,
        min(1.0, sum(lengths) / n / 20),
        1 - len(set(lines)) / max(1, len(lines)),
        same / n,
        sum(x[-1] in ".!?" for x in lines) / max(1, len(lines)),
        sum(x <= 3 for x in lengths) / n,
        min(1.0, n / max(1, len(lines)) / 100),
    ]
    plain = [min(2.0, x) for x in plain]
    return [1.0, *plain, *(x * x for x in plain)]


def table_of(docs: DataFrame, labels: DataFrame, fold: int) -> DataFrame:
    """doc_id, learn, positive, known and x (array of double) of every row of docs."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py()) for t in batch.column(1)], pa.list_(pa.float32()))], ["doc_id", "x"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, x array<float>")
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q")).filter(crc_mod("doc_id", fold) != 0)
    return keep(rows.join(marks, "doc_id", "left").select("doc_id", "x", F.coalesce(crc_mod("doc_id", fold) != 0, F.lit(False)).alias("learn"), "q"), "quality")


def _sums(table: DataFrame, tried: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
    """For each of the tried weights, over all rows that teach: counts, losses, gradient and curvature. Spark adds the tasks' sums."""
    d = len(tried[0])
    width = 5 + 2 * d + d * d

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((len(tried), width))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, d)
            p = np.array(batch.column(1).fill_null(-1)) == 1
            for own, weights in zip(total, tried, strict=True):
                f = np.clip(x @ weights, -30, 30)
                s, loss = 1 / (1 + np.exp(-f)), np.logaddexp(0, f)
                own[:5] += [len(f), p.sum(), loss.sum(), loss[p].sum(), f[p].sum()]
                own[5 : 5 + d] += s @ x
                own[5 + d : 5 + 2 * d] += x[p].sum(axis=0)
                own[5 + 2 * d :] += ((x * (s * (1 - s))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["i", "v"])

    flat = np.zeros(len(tried) * width)
    for r in table.filter("learn").select("x", F.col("q").cast("int").alias("q")).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[r["i"]] = r["v"]
    return [{"n": got[0], "p": got[1], "loss": got[2], "loss_p": got[3], "f_p": got[4], "grad": got[5 : 5 + d], "x_p": got[5 + d : 5 + 2 * d], "hess": got[5 + 2 * d :].reshape(d, d)} for got in flat.reshape(len(tried), width)]


def fit(table: DataFrame, prior: float, rounds: int = 12, shrink: float = 1e-4) -> np.ndarray:
    """Weights that minimise the non-negative risk."""
    d = 1 + 2 * N_PLAIN
    weights = np.zeros(d)
    weights[0] = math.log(prior / (1 - prior))
    (now,) = _sums(table, [weights])
    if not now["p"]:
        return weights
    ridge = np.full(d, shrink)
    ridge[0] = 0
    risk = lambda s, w: (-prior * s["f_p"] / s["p"] + s["loss"] / s["n"] + 0.5 * ridge @ (w * w), s["loss"] / s["n"] - prior * s["loss_p"] / s["p"])
    for _ in range(rounds):
        grad = now["grad"] / now["n"] - prior * now["x_p"] / now["p"] + ridge * weights
        step = np.linalg.solve(now["hess"] / now["n"] + np.diag(ridge + 1e-9), grad)
        before = risk(now, weights)[0]
        tried = [weights - size * step for size in SIZES]
        for after, then in zip(tried, _sums(table, tried), strict=True):
            value, negative = risk(then, after)
            if value <= before and negative >= 0:
                break
        else:
            break
        weights, now = after, then
        if before - value < 1e-6:
            break
    return weights


def score(docs: DataFrame, labels: DataFrame, fold: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row of docs."""
    table = table_of(docs, labels, fold)
    known = table.filter("learn").agg(F.count("q").alias("n"), F.coalesce(F.sum(F.col("q").cast("int")), F.lit(0)).alias("p")).first()
    prior = (known["p"] + 1) / (known["n"] + 2)
    weights = F.array(*(F.lit(float(w)) for w in fit(table, prior)))
    total = F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    out = table.select("doc_id", F.coalesce(crc_mod("doc_id", fold) == 0, F.lit(False)).alias("held_out"), (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
