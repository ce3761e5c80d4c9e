"""Language of whole texts by multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language come from a grouped sum over a bounded sample of
labelled texts; their log-probabilities are a matrix of 65,536 rows and one
column per language, which is broadcast (its size is checked). The n-grams of a
batch of texts are a sparse matrix by rows, which is multiplied by that matrix
in numpy; priors are the shares of the languages among the labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches
from .ngrams import BLOCK, SPACE, blocks, buckets, code_points

BITS, ORDERS = 16, (1, 2, 3)
#: About so many labelled texts of each language are learned from.
TEXTS_PER_LANGUAGE = 4000
#: Bytes of the matrix that may be broadcast; an error is raised for more languages than that allows (4,096).
MOST_BYTES = 1 << 30
#: Code points of short texts that are scored together.
TOGETHER = 1 << 16
SMOOTHING = 0.5
UNKNOWN = "und"
#: Characters of a passage, whose own language is compared with the text's, and passages taken at once.
PASSAGE, PASSAGES = 200, 80


def held_out(doc_id: F.Column) -> F.Column:
    """Whether crc32 of the id as text leaves remainder 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    log_probability: np.ndarray  # (2 ** BITS, languages), float32
    prior: np.ndarray

    def __post_init__(self) -> None:
        #: Mean log-likelihood of an n-gram of each language's learning texts.
        self.own = np.array([np.exp(p) @ p for p in self.log_probability.T.astype(float)])

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probabilities (texts, languages) and numbers of n-grams: a sparse matrix of the batch by the dense one.

        The sparse matrix is given by its rows' bounds and column numbers; an
        n-gram that a text has twice is there twice, each time as 1.
        """
        lap = max(ORDERS) - 1
        points = [code_points(t, True) for t in texts]
        bounds = np.cumsum([0, *(len(c) + lap for c in points)])
        flat = np.full(bounds[-1] + lap, SPACE, dtype=np.uint32)
        for at, c in zip(bounds, points):
            flat[at : at + len(c)] = c
        totals, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        left = np.repeat(bounds[:-1] + [len(c) for c in points], np.diff(bounds)) - np.arange(bounds[-1])  # up to the text's end
        for n in ORDERS:
            column = buckets(flat, BITS, (n,), False)
            second = min(1, n - 1)
            own = np.flatnonzero(~((flat[: bounds[-1]] == SPACE) & (flat[second : bounds[-1] + second] == SPACE)) & (left >= n))
            row = np.searchsorted(own, bounds)
            size, some = np.diff(row), np.flatnonzero(np.diff(row))
            sizes += size
            if len(some):
                totals[some] += np.add.reduceat(self.log_probability[column[own]], row[:-1][some], axis=0, dtype=np.float64)
        return totals, sizes

    def score(self, texts) -> list[tuple[str, float]]:
        """The likeliest language of each text and how sure that is: 1 / number of languages up to 1.

        Log-likelihoods are divided by the root of the number of n-grams, as
        neighbouring n-grams are far from independent.
        """
        out = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if self.languages and t and any(map(str.isalpha, t))]
        at = 0
        while at < len(known):
            stop, size = at + 1, len(texts[known[at]])
            while stop < len(known) and size + len(texts[known[stop]]) <= TOGETHER:
                size += len(texts[known[stop]])
                stop += 1
            some = known[at:stop]
            if size <= BLOCK:
                total, n = self.batch([texts[i] for i in some])
            else:  # one long text, in parts whose n-grams don't overlap
                total, n = np.zeros((1, len(self.languages))), np.zeros(1)
                for block in blocks(code_points(texts[some[0]], True), max(ORDERS) - 1):
                    b = buckets(block, BITS, ORDERS, True)
                    total[0] += self.log_probability[b].sum(axis=0, dtype=np.float64)
                    n += len(b)
            total = (total + self.prior) / np.sqrt(np.maximum(1, n))[:, None]
            p = np.exp(total - total.max(axis=1, keepdims=True))
            best = p.argmax(axis=1)
            for i, k, row in zip(some, best, p, strict=True):
                out[i] = self.languages[k], float(row[k] / row.sum())
            at = stop
        return out

    def evidence(self, text: str | None) -> tuple[str, float, float, int]:
        """The likeliest language, its fit, agreement, and the number of n-grams.

        fit is the mean log-likelihood of an n-gram less that of the language's
        own learning texts: about 0 for its prose. agreement is the share of
        n-grams in passages for which the same language is the likeliest.
        Neither depends on the number of languages.
        """
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, 0
        c, sums, sizes = code_points(text, True), [], []
        for at in range(0, max(1, len(c) - max(ORDERS) + 1), PASSAGE * PASSAGES):
            some = c[at : at + PASSAGE * PASSAGES + max(ORDERS) - 1]
            cuts = np.arange(0, PASSAGE * PASSAGES + 1, PASSAGE)
            total, size = np.zeros((PASSAGES, len(self.languages))), np.zeros(PASSAGES, dtype=np.int64)
            for n in ORDERS:
                found = buckets(some, BITS, (n,), False)
                second = min(1, n - 1)
                own = np.flatnonzero(~((some[: len(found)] == SPACE) & (some[second : len(found) + second] == SPACE)))
                own = own[own < PASSAGE * PASSAGES]
                bounds = np.searchsorted(own, cuts)
                rows = np.zeros((len(own) + 1, len(self.languages)))
                np.cumsum(self.log_probability[found[own]], axis=0, dtype=np.float64, out=rows[1:])
                total += rows[bounds[1:]] - rows[bounds[:-1]]
                size += np.diff(bounds)
            sums.append(total[size > 0])
            sizes.append(size[size > 0])
        passages, n = np.concatenate(sums), np.concatenate(sizes)
        best = int((passages.sum(axis=0) + self.prior).argmax())
        return self.languages[best], float(passages[:, best].sum() / n.sum() - self.own[best]), float(n[passages.argmax(axis=1) == best].sum() / n.sum()), int(n.sum())


def bounded_sample(labelled: DataFrame, label: str, per_label: int, id_col: str) -> tuple[DataFrame, dict]:
    """About ``per_label`` rows of each label, chosen by a hash of the id; and the number of rows of each label, sorted."""
    counts = {r[label]: r["n"] for r in labelled.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return labelled.limit(0), {}
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_label / n)))))
    part = F.pmod(F.xxhash64(F.lit(4), F.col(id_col)), F.lit(1 << 30)) < share[F.col(label)] * (1 << 30)
    return labelled.where(part), dict(sorted(counts.items()))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TEXTS_PER_LANGUAGE) -> Model:
    """Learn from rows with text and lang. Without any, the model answers ``und`` to everything."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sample, number = bounded_sample(rows, "lang", per_language, "doc_id")
    languages = list(number)
    if len(languages) << BITS > MOST_BYTES // 4:
        raise ValueError(f"{len(languages)} languages are more than the broadcast matrix allows")
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                own = sums.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                for block in blocks(code_points(text, True), max(ORDERS) - 1):
                    own += np.bincount(buckets(block, BITS, ORDERS, True), minlength=1 << BITS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": own[at]})

    # At most 2 ** BITS rows for each language reach the driver.
    summed = sample.select("text", "lang").mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((1 << BITS, len(languages)))
    column = {x: i for i, x in enumerate(languages)}
    counts[summed["bucket"].to_numpy(dtype=np.int64), summed["lang"].map(column).to_numpy(dtype=np.int64)] = summed["n"].to_numpy(dtype=float)
    log_p = np.log(counts + SMOOTHING) - np.log((counts + SMOOTHING).sum(axis=0))
    prior = np.array([number[x] for x in languages], dtype=float)
    return Model(languages, log_p.astype(np.float32), np.log(prior / prior.sum()))


def predictor(spark, model: Model):
    """A column function: text -> struct(lang_pred, score)."""
    sent = spark.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(sent.value.score(list(text)), columns=["lang_pred", "score"])

    return predict


def examiner(spark, model: Model):
    """A column function: text -> struct(lang_pred, fit, agreement, n) of Model.evidence."""
    sent = spark.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("fit", T.DoubleType()), T.StructField("agreement", T.DoubleType()), T.StructField("n", T.LongType())])

    @F.pandas_udf(kind)
    def examine(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.evidence(t) for t in text], columns=["lang_pred", "fit", "agreement", "n"])

    return examine


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    lang_pred is ``und`` with score 0 if the text is null or has no letters.
    Only the text decides. Repeated rows give repeated rows.
    """
    bounded_batches(docs.sparkSession)
    found = predictor(docs.sparkSession, model)(F.col("text"))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """fit on the rows that aren't held out, then identify all."""
    return identify(docs, fit(docs.where(~held_out(F.col("doc_id")))))

