"""Quality of documents by co-training two views: the text and the page's metadata.

The text view sees hashed character n-grams as they stand (case and signs
count) and how often a word repeats the one before. The metadata view sees
source, language, and the page's layout: orders of magnitude of its length and
lines, the share of lines that are distinct, and the share of signs. Each view
is a naive-Bayes log-odds model, calibrated by logistic regression on labelled
documents that it didn't learn from.

In each round both views score all unlabelled documents on Spark. What a view
is sure of is a pseudo-label for the other: its features are summed up by
class, and the other view learns from these sums beside the labelled
documents. In the end the calibrated views are combined on labelled documents
that neither learning nor calibration saw.

About LABELLED labelled documents of each class are collected (8 KB of
features each); of the unlabelled ones only sums of a fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free_name
from .langid import bounded_sample
from .ngrams import SPACE, blocks, buckets, code_points, letters

BITS, ORDERS = 12, (1, 2, 3)
#: Levels of the share of words that repeat the word before; they follow the n-gram buckets.
LEVELS = 8
FEATURES = (1 << BITS) + LEVELS
#: Labelled documents of each class that are learned from (bound).
LABELLED = 1500
#: n-grams that are added to a text's number, so that those of very short texts don't weigh too much.
FEW = 30
#: Rounds of exchange; odds from which a view is sure; weight of all pseudo-labels beside all labels.
ROUNDS, SURE, PSEUDO = 2, 0.97, 0.5
#: Buckets of the metadata view: source, language, length, lines, distinct lines, signs.
META = (256, 64, 32, 32, 9, 17)
#: Documents below are rejected; under even odds, as losing a good one costs more than keeping a bad one.
KEEP_FROM = 0.1
#: Shares are summed up as whole numbers of this size, so that sums don't depend on their order.
UNIT = 1 << 30


def repetition(text: str | None) -> int:
    """Bucket of the share of words that repeat the word before them."""
    words = (text or "").split()
    share = sum(map(eq, words, words[1:])) / max(1, len(words))
    return (1 << BITS) + min(LEVELS - 1, int(share * 2 * LEVELS))


def text_features(text: str | None) -> np.ndarray:
    """Shares of the hashed n-grams of a whole text, and 1 at its level of repetition."""
    own, n = np.zeros(FEATURES), 0
    for block in blocks(code_points(text or "", False), max(ORDERS) - 1):
        b = buckets(block, BITS, ORDERS, False)
        own += np.bincount(b, minlength=FEATURES)
        n += len(b)
    own /= n + FEW
    own[repetition(text)] = 1
    return own


def meta_features(source, lang, length, text: str | None) -> tuple[int, ...]:
    """Bucket of each metadata field; null has one of its own."""
    hashed = lambda x, n: 0 if x is None or x != x else 1 + zlib.crc32(str(x).encode()) % (n - 1)
    size = 0 if length is None or length != length else min(META[2] - 1, 1 + int(max(0, length)).bit_length())
    if not text:
        return hashed(source, META[0]), hashed(lang, META[1]), size, 0, 0, 0
    lines = text.split("\n")
    c = code_points(text, False)
    signs = (float((~letters()[c] & (c != SPACE)).sum()) + 5) / (len(c) + 100)
    return hashed(source, META[0]), hashed(lang, META[1]), size, min(META[3] - 1, len(lines).bit_length()), 1 + int(8 * len(set(lines)) / len(lines) - 1e-9), 1 + min(15, int(40 * signs))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, the last for the constant, by Newton steps with a ridge penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x * w[0] + w[1], -30, 30)))


@dataclass
class Model:
    text: np.ndarray  # log-odds by bucket
    meta: tuple[np.ndarray, ...]
    scale: tuple[float, float]
    text_fit: np.ndarray
    meta_fit: np.ndarray
    both: np.ndarray
    prior: float | None = None  # set if there was nothing to learn from

    def raw_text(self, text: str | None) -> float:
        total, n = 0.0, 0
        for block in blocks(code_points(text or "", False), max(ORDERS) - 1):
            b = buckets(block, BITS, ORDERS, False)
            total += float(self.text[b].sum())
            n += len(b)
        return (total / (n + FEW) + float(self.text[repetition(text)])) / self.scale[0]

    def raw_meta(self, features: tuple[int, ...]) -> float:
        return sum(float(m[i]) for m, i in zip(self.meta, features, strict=True)) / self.scale[1]

    def score(self, texts, sources, langs, lengths) -> pd.DataFrame:
        if self.prior is not None:
            return pd.DataFrame({"p_text": self.prior, "p_meta": self.prior, "score": self.prior}, index=range(len(texts)))
        p = chance(np.array([self.raw_text(t) for t in texts], dtype=float), self.text_fit)
        q = chance(np.array([self.raw_meta(meta_features(*row)) for row in zip(sources, langs, lengths, texts, strict=True)], dtype=float), self.meta_fit)
        z = np.column_stack([odds(p), odds(q), np.ones(len(p))]) @ self.both
        return pd.DataFrame({"p_text": p, "p_meta": q, "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})


NOTHING = Model(np.zeros(FEATURES), (), (1.0, 1.0), np.zeros(2), np.zeros(2), np.zeros(3), prior=0.5)
SUMS = "view string, class int, field int, bucket int, total long, n long"


def pseudo_sums(docs: DataFrame, model: Model) -> dict[tuple[str, int], tuple[list[np.ndarray], int]]:
    """Summed features of all ``docs`` that the other view is sure of, and their number, by view (text, meta) and class."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        sums = {(v, c): [np.zeros(n, dtype=np.int64) for n in ((FEATURES,) if v == "text" else META)] for v in ("text", "meta") for c in (0, 1)}
        seen = dict.fromkeys(sums, 0)
        for b in batches:
            for row in zip(b["source"], b["lang"], b["n_chars"], b["text"], strict=True):
                own, meta = text_features(row[3]), meta_features(*row)
                p = chance(np.array([own @ m.text / m.scale[0]]), m.text_fit)[0]
                q = chance(np.array([m.raw_meta(meta)]), m.meta_fit)[0]
                for view, sure in (("meta", p), ("text", q)):
                    if max(sure, 1 - sure) < SURE:
                        continue
                    key = view, int(sure > 0.5)
                    seen[key] += 1
                    if view == "text":
                        sums[key][0] += np.rint(own * UNIT).astype(np.int64)
                    else:
                        for total, i in zip(sums[key], meta, strict=True):
                            total[i] += 1
        for (view, c), fields in sums.items():
            for k, total in enumerate(fields):
                at = np.flatnonzero(total)
                yield pd.DataFrame({"view": view, "class": c, "field": k, "bucket": at, "total": total[at], "n": 0})
            yield pd.DataFrame({"view": [view], "class": [c], "field": [-1], "bucket": [0], "total": [0], "n": [seen[view, c]]})

    found = docs.select("source", "lang", "n_chars", "text").mapInPandas(run, SUMS).groupBy("view", "class", "field", "bucket").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("double").alias("total"), F.sum("n").alias("n")).toPandas()
    out = {}
    for v in ("text", "meta"):
        for c in (0, 1):
            own = found[(found["view"] == v) & (found["class"] == c)]
            fields = [np.zeros(n) for n in ((FEATURES,) if v == "text" else META)]
            for k, total in enumerate(fields):
                part = own[own["field"] == k]
                total[part["bucket"].to_numpy(dtype=int)] = part["total"].to_numpy(dtype=float) / (UNIT if v == "text" else 1)
            out[v, c] = fields, int(own["n"].sum())
    return out


def views(text: np.ndarray, meta: np.ndarray, y: np.ndarray, judge: np.ndarray, learn: np.ndarray, pseudo) -> Model:
    """Both views from the labelled rows in ``learn`` and the pseudo-labelled sums, calibrated on those in ``judge``."""
    means, tables = [], []
    for c in (0, 1):
        rows = learn & (y == c)
        mean, counts = text[rows].mean(axis=0, dtype=float), [np.bincount(meta[rows, k], minlength=n).astype(float) for k, n in enumerate(META)]
        if pseudo is not None:
            (own,), n = pseudo["text", c]
            if n:
                mean = (mean + PSEUDO * own / n) / (1 + PSEUDO)
            fields, n = pseudo["meta", c]
            if n:
                counts = [have + more * (PSEUDO * rows.sum() / n) for have, more in zip(counts, fields, strict=True)]
        means.append(mean)
        tables.append([np.log((x + 2) / (x.sum() + 2 * n)) for x, n in zip(counts, META, strict=True)])
    a = np.log((means[1] + 1e-5) / (means[0] + 1e-5))
    b = tuple(up - down for down, up in zip(*tables, strict=True))
    za, zb = text @ a, sum(m[meta[:, i]] for i, m in enumerate(b))
    scale = tuple(max(1e-9, float(z[judge].std())) for z in (za, zb))
    weight = balance(y[judge])
    fits = [logistic(z[judge, None] / s, y[judge].astype(float), weight) for z, s in zip((za, zb), scale, strict=True)]
    return Model(a, b, scale, *fits, np.zeros(3))


def balance(y: np.ndarray) -> np.ndarray:
    classes = np.array([(y == 0).sum(), (y == 1).sum()])
    return (classes.sum() / 2 / classes)[y]


def combined(model: Model, text: np.ndarray, meta: np.ndarray, y: np.ndarray) -> Model:
    """The model with the weights of its views fitted on these rows; a view never counts against its own verdict."""
    za, zb = text @ model.text, sum(m[meta[:, i]] for i, m in enumerate(model.meta))
    both = np.column_stack([odds(chance(z / s, w)) for z, s, w in zip((za, zb), model.scale, (model.text_fit, model.meta_fit), strict=True)])
    weight, target = balance(y), y.astype(float)
    w = logistic(both, target, weight)
    if (w[:2] < 0).any():
        left = int(w[0] < 0)  # the view that stays
        one = logistic(both[:, [left]], target, weight)
        w = np.array([0.0, 0.0, one[1]])
        w[left] = one[0]
    model.both = w
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = LABELLED) -> Model:
    """Learn from ``labels`` (doc_id, quality 0 or 1) and all ``docs`` (documents); ids of any type.

    Labels that are null, contradict each other or have no document are left
    out. With labels of one class or none the score is 0.5 for every document
    and nothing is rejected.
    """
    bounded_batches(docs.sparkSession)
    clear = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("high")).where("quality = high").drop("high")
    sample, classes = bounded_sample(clear, "quality", per_class, "doc_id")
    if len(classes) < 2:
        return NOTHING
    # The sample has about 2 * per_class rows: small enough to broadcast at any size of the input.
    sample = F.broadcast(sample.select(F.col("doc_id").alias("labelled"), "quality"))
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    known = rows.join(sample, F.col("doc_id") == F.col("labelled")).select(F.col("doc_id").cast("string").alias("doc_id"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("hash"), F.col("quality").cast("long").alias("y"), "text", "lang", "source", "n_chars")
    others = rows.join(sample, F.col("doc_id") == F.col("labelled"), "left_anti")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            meta = [np.array(meta_features(*x), dtype=np.int64) for x in zip(b["source"], b["lang"], b["n_chars"], b["text"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "hash": b["hash"], "y": b["y"], "text": [text_features(t).astype(np.float16).tobytes() for t in b["text"]], "meta": meta})

    got = known.mapInPandas(features, "doc_id string, hash long, y long, text binary, meta array<long>").toPandas().sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy(dtype=np.int64)
    if not ((y == 0).any() and (y == 1).any()):
        return NOTHING
    text = np.empty((len(got), FEATURES), dtype=np.float32)
    for i, row in enumerate(got.pop("text")):
        text[i] = np.frombuffer(row, dtype=np.float16)
    meta, tenth = np.stack(got["meta"].to_list()), got["hash"].to_numpy() % 10
    # Six tenths to learn from, two to calibrate and two to combine; where a class is missing in one, all rows serve for all.
    parts = [tenth < 6, (tenth == 6) | (tenth == 7), tenth > 7]
    if not all((part & (y == c)).any() for part in parts for c in (0, 1)):
        parts = [np.ones(len(y), dtype=bool)] * 3
    learn, judge, last = parts
    pseudo = None
    for _ in range(ROUNDS):
        pseudo = pseudo_sums(others, views(text, meta, y, judge, learn, pseudo))
    return combined(views(text, meta, y, judge, learn, pseudo), text[last], meta[last], y[last])


def scorer(spark, model: Model):
    """A column function: text, source, lang, n_chars -> struct(p_text, p_meta, score)."""
    sent = spark.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in ("p_text", "p_meta", "score")])

    @F.pandas_udf(kind)
    def score(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        return sent.value.score(text, source, lang, n_chars)

    return score


def scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` (all columns) with a struct column ``name``: p_text, p_meta, score; each 0 (bad) to 1."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(name, scorer(docs.sparkSession, model)("text", "source", "lang", "n_chars"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept) for every row of documents; kept from a score of KEEP_FROM.

    Null and empty texts are scored like any other. Repeated rows give
    repeated rows, an empty table an empty result.
    """
    name = free_name(docs, "quality")
    found = scored(docs, fit(docs, labels), name)
    return found.select("doc_id", f"{name}.*", (F.col(f"{name}.score") >= KEEP_FROM).alias("kept"))
