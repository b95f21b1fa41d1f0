"""Language identification by word-first backoff.

A word that the training corpus knows is scored by its log frequency in every language. An unseen word falls back to
its character n-grams, from the longest down: the first length of which any gram is known decides, by the mean of its
known grams. Word and gram counts are exact over all training rows and summed by Spark; no word and no gram is left out.
The `max_words` most frequent words go to every task; the others, known or not, meet their counts in a shuffle, where an
unseen word is scored once for all texts that hold it. No other table is broadcast: what grows with the corpus is dealt by
key in every join.

Edge cases: a null text, or one without a letter, is `und` with score 0. Rows with a null language or a null id train
nothing. With no training row at all every text is `und`. Ties between languages go to the first in sorted order. Rows
that repeat are predicted each. Columns of docs named `lang_pred` or `score` are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, floor_for, keep, shuffled

WORD = re.compile(r"[^\W\d_]+")
LONGEST_GRAM = 5
#: Entries that a counting or scoring task holds before it sends them on or forgets them.
FLUSH = 150_000


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return WORD.findall(text.lower())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def flush():
        for lang, counter in held.items():
            for at in range(0, len(items := list(counter.items())), 100_000):
                part = items[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([w for w, _ in part]), pa.array([n for _, n in part], pa.int64())], ["lang", "word", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.setdefault(lang, Counter()).update(words_of(text.as_py()))
            if sum(map(len, held.values())) > FLUSH:
                yield from flush()
    yield from flush()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict[str, int]] = {}

    def flush():
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = held.setdefault(lang, {})
            seen = counts.get
            edged = f"^{word}$"
            size = len(edged)
            for length in range(1, LONGEST_GRAM + 1):
                for i in range(size - length + 1):
                    gram = edged[i : i + length]
                    counts[gram] = seen(gram, 0) + n
        if sum(map(len, held.values())) > FLUSH:
            yield from flush()
    yield from flush()


def _scores(langs: list[str], totals: dict[str, int], distinct: int) -> list[Column]:
    """One column for each language, s0, s1, ...: the log frequency of a group of (lang, n) rows."""
    of = lambda lang: F.coalesce(F.sum(F.when(F.col("lang") == F.lit(lang), F.col("n"))), F.lit(0))
    return [F.log((of(lang) + 0.5) / (totals[lang] + 0.5 * distinct)).alias(f"s{i}") for i, lang in enumerate(langs)]


class Backoff:
    """What training counted: `words` (word, n, s0, ...) and `grams` (gram, s0, ...) as tables, and the frequent words themselves."""

    def __init__(self, langs: list[str], words: DataFrame, grams: DataFrame, frequent: dict[str, tuple[float, ...]]):
        self.langs, self.words, self.grams, self.frequent = langs, words, grams, frequent

    @property
    def columns(self) -> list[str]:
        """The score columns."""
        return [f"s{i}" for i in range(len(self.langs))]

    def backed_off(self, unseen: DataFrame) -> DataFrame:
        """(word, s0, ...) of words that training does not know, zeros where it knows no gram of them: a join for each length."""
        edged = F.concat(F.lit("^"), "word", F.lit("$"))
        out, left = None, keep(unseen.select("word"), "unseen")
        for n in range(LONGEST_GRAM, 0, -1):
            grams = left.filter(F.length(edged) >= n).select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length(edged) - n + 1), lambda i: F.substring(edged, i, F.lit(n)))).alias("gram"))
            known = self.grams.filter(F.length("gram") == n)
            got = keep(grams.join(shuffled(known), "gram").groupBy("word").agg(*(F.avg(c).alias(c) for c in self.columns)), f"grams{n}")
            out = got if out is None else out.unionByName(got)
            left = keep(left.join(shuffled(got), "word", "left_anti"), "unseen")
            if left.isEmpty():
                return out
        return out.unionByName(left.select("word", *(F.lit(0.0).alias(c) for c in self.columns)))


def fit(labelled: DataFrame, max_words: int = 60_000) -> Backoff:
    """Learn from columns `lang` and `text`; null languages and texts are left out."""
    rows = labelled.select("lang", "text").dropna()
    lexicon = keep(rows.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lexicon")
    grams = keep(lexicon.mapInArrow(_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    stats = {}
    for name, df in (("words", lexicon), ("grams", grams)):
        got = df.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
        stats[name] = {r["lang"]: r["n"] for r in got}, max([r["v"] for r in got], default=1)
    langs = sorted(stats["words"][0])
    if not langs:
        return Backoff([], lexicon, grams, {})
    words = keep(lexicon.groupBy("word").agg(F.sum("n").alias("n"), *_scores(langs, *stats["words"])), "words")
    table = words.filter(F.col("n") >= floor_for(words, "n", max_words)).drop("n").toArrow()
    frequent = dict(zip(table.column(0).to_pylist(), zip(*(c.to_pylist() for c in table.columns[1:]), strict=True), strict=True))
    return Backoff(langs, words, keep(grams.groupBy("gram").agg(*_scores(langs, *stats["grams"])), "scored"), frequent)


def predictions(docs: DataFrame, model: Backoff, carry: list[str]) -> DataFrame:
    """The columns `carry` of docs, then `lang_pred` and `score`, one row for each row of docs in no order."""
    if not model.langs:
        return docs.select(*carry, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shipped = docs.sparkSession.sparkContext.broadcast(model.frequent)
    width = len(model.langs)
    kept = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry))).schema
    names = ["rid", "word", "k", "words", "sums", *kept.names]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]):
        at = {w: i for i, w in enumerate(shipped.value)}
        matrix = np.array([*shipped.value.values()], float).reshape(-1, width)
        place = at.get
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                out: list[list] = [[] for _ in kinds]
                own: list[int | None] = []
                for i, (rid, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1), strict=True)):
                    words = words_of(text.as_py() or "")
                    places = [place(w) for w in words]
                    rare = Counter([w for w, x in zip(words, places, strict=True) if x is None])
                    sums = matrix[[x for x in places if x is not None]].sum(axis=0).tolist()
                    k = len(rare)
                    # the row's own record travels with its rare words, under a key that no word can be
                    for column, values in zip(out, ([rid] * (k + 1), [f"#{rid}", *rare], [None, *rare.values()], [len(words)] + [None] * k, [sums] + [None] * k), strict=True):
                        column += values
                    own += [i] + [None] * k
                own_rows = pa.array(own, pa.int32())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, kinds, strict=True)), *(part.column(2 + j).take(own_rows) for j in range(len(carry)))], names)

    inner = docs.select(F.monotonically_increasing_id().alias("rid"), "text", *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    fields = "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept)
    rows = keep(inner.mapInArrow(run, f"rid long, word string, k long, words long, sums array<double>{fields}"), "rare")
    met = rows.filter(F.col("k").isNotNull())
    known = model.words.drop("n")
    unseen = met.select("word").distinct().join(shuffled(known), "word", "left_anti")
    scored = met.select("rid", "word", "k").join(shuffled(known.unionByName(model.backed_off(unseen))), "word")
    cast = [F.sum(F.col("k") * F.col(c)).alias(c) for c in model.columns]
    rest = scored.groupBy("rid").agg(*cast)
    mine = rows.filter(F.col("words").isNotNull()).join(shuffled(rest), "rid", "left")
    total = F.array(*((F.col("sums")[i] + F.coalesce(c, F.lit(0.0))) / F.greatest(F.lit(1.0), F.col("words") / 20) for i, c in enumerate(model.columns)))
    best = F.array_max("total")
    some = F.col("words") > 0
    return mine.withColumn("total", total).select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)),
        F.when(some, F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("total", best).cast("int"))).otherwise("und").alias("lang_pred"),
        F.when(some, 1 / F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp(x - best))).otherwise(0.0).alias("score"),
    )


def predict(docs: DataFrame, model: Backoff) -> DataFrame:
    """The columns of docs, then `lang_pred` and `score`; a column of docs with either name is replaced."""
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    numbered = keep(docs.select(*(F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(names)), F.monotonically_increasing_id().alias("row")), "numbered")
    text = F.col(f"d{names.index('text')}").alias("text")
    found = predictions(numbered.select("row", text), model, ["row"])
    return numbered.join(shuffled(found), "row").select(*(F.col(f"d{i}").alias(c) for i, c in enumerate(names)), "lang_pred", "score")


def language_of(docs: DataFrame, fold: int = 5) -> DataFrame:
    """Predict every row of docs (doc_id, lang, text) from a model of the rows outside the held-out fold: doc_id, lang_pred, score."""
    return predictions(docs, fit(docs.filter(crc_mod("doc_id", fold) != 0)), ["doc_id"])
