"""Quality rules: counts of a text, and a logistic regression over hashed word and character n-grams.

The rules count words, signs, repeated lines and repeated phrases of whole
texts and reject by fixed limits. The classifier sees the square roots of the
shares of hashed words, word pairs and character n-grams as they stand. It is
fitted on a bounded sample of labelled documents and calibrated on others of
them, so that its score is a probability; fixed thresholds turn it into a
verdict. Both work in one pass over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_text
from .langid import bounded_sample
from .ngrams import blocks, buckets, code_points
from .quality import balance, chance, logistic

#: Fixed signs and blanks of the rules.
SIGNS, BLANKS = "#*$%&|<>", "\t\n\v\f\r "
#: Fixed limits of the rules.
FEWEST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Buckets of words, of word pairs, and of character n-grams of these orders.
WORD_BITS, CHAR_BITS, ORDERS = 11, 12, (1, 2, 3)
FEATURES = 2 * (1 << WORD_BITS) + (1 << CHAR_BITS)
#: Labelled documents of each class that are learned from and calibrated on (bound).
LABELLED = 1500
#: Ridge penalty. Thresholds of the probability: below the first a document is rejected, from the second it is good, and else doubtful.
RIDGE, REJECT_BELOW, GOOD_FROM = 3.0, 0.2, 0.6
#: A probability for documents when nothing was learned.
UNKNOWN = 0.5
ODD = np.uint64(0x9E3779B97F4A7C15)


def coded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words in order, equal for equal words, and a 64-bit hash of each number's word."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return codes.astype(np.int64), pd.util.hash_array(distinct, categorize=False)


def repeated(codes: np.ndarray) -> int:
    """Words in windows of three words that occur twice or more."""
    if len(codes) < 4:
        return 0
    pairs = np.unique(codes[:-1] * (codes.max() + 1) + codes[1:], return_inverse=True)[1]
    _, at, n = np.unique(pairs[:-1] * (codes.max() + 1) + codes[2:], return_inverse=True, return_counts=True)
    often = n[at] > 1
    covered = np.zeros(len(codes), dtype=bool)
    for k in range(3):
        covered[k : k + len(often)] |= often
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    seen = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(seen) - len(set(seen))


def features(text: str, codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Roots of the shares of each kind of n-gram in its buckets."""
    own = np.zeros(FEATURES, dtype=np.int64)
    size, at = 1 << WORD_BITS, 0
    if len(codes):
        shift = np.uint64(64 - WORD_BITS)
        mixed = hashes * ODD
        own[:size] = np.bincount(((mixed >> shift).astype(np.int64))[codes], minlength=size)
        if len(codes) > 1:
            pairs = (mixed[codes[:-1]] + (hashes[codes[1:]] ^ ODD)) * ODD
            own[size : 2 * size] = np.bincount((pairs >> shift).astype(np.int64), minlength=size)
    for block in blocks(code_points(text, False), max(ORDERS) - 1):
        own[2 * size :] += np.bincount(buckets(block, CHAR_BITS, ORDERS, False), minlength=1 << CHAR_BITS)
    out = own.astype(float)
    for end in (size, 2 * size, FEATURES):
        out[at:end] /= max(1.0, out[at:end].sum())
        at = end
    return np.sqrt(out)


@dataclass
class Model:
    weights: np.ndarray  # by feature, the last for the constant
    fit: np.ndarray  # slope and constant of the calibration
    known: bool = True

    def probability(self, text: str, codes: np.ndarray, hashes: np.ndarray) -> float:
        if not self.known:
            return UNKNOWN
        return float(chance(features(text, codes, hashes) @ self.weights[:-1] + self.weights[-1], self.fit))


NOTHING = Model(np.zeros(FEATURES + 1), np.zeros(2), False)


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Logistic regression with a ridge penalty by Newton steps, each solved by conjugate gradients; x in single precision, rows of weight 0 don't count."""
    forth = lambda v: (x @ v.astype(np.float32)).astype(float)  # noqa: E731  with doubles numpy would copy x
    back = lambda v: (x.T @ v.astype(np.float32)).astype(float)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(forth(w) + b, -30, 30)))
        gap, curve = weight * (p - y), weight * (p * (1 - p) + 1e-9)
        g = np.append(back(gap) + ridge * w, gap.sum())
        step, r = np.zeros_like(g), -g
        d, old = r.copy(), r @ r
        for _ in range(25):
            if old <= 1e-12 * (g @ g):
                break
            z = curve * (forth(d[:-1]) + d[-1])
            hd = np.append(back(z) + ridge * d[:-1], z.sum() + 1e-6 * d[-1])
            a = old / (d @ hd)
            step, r = step + a * d, r - a * hd
            new = r @ r
            d, old = r + new / old * d, new
        w, b = w + step[:-1], b + step[-1]
        if np.abs(step).max() < 1e-6:
            break
    return np.append(w, b)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = LABELLED) -> Model:
    """Learn from ``labels`` (doc_id, quality 0 or 1) and their ``docs`` (doc_id, text); ids of any type.

    Labels that are null, contradict each other or have no document are left
    out; of documents that share a labelled id the first by the text's hash
    counts. With labels of one class or none every document gets UNKNOWN.
    """
    bounded_batches(docs.sparkSession)
    clear = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("high")).where("quality = high").drop("high")
    sample, classes = bounded_sample(clear, "quality", per_class, "doc_id")
    if len(classes) < 2:
        return NOTHING
    # The sample has about 2 * per_class rows: small enough to broadcast at any size of the input.
    sample = F.broadcast(sample.select(F.col("doc_id").alias("labelled"), F.col("quality").cast("long").alias("y")))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, F.col("doc_id") == F.col("labelled"))
    one = texts.groupBy(F.col("doc_id").cast("string").alias("doc_id"), "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "hash": b["hash"], "y": b["y"], "x": [features(t, *coded(t)).astype(np.float16).tobytes() for t in b["text"]]})

    got = one.select("doc_id", F.crc32(F.col("doc_id").cast("binary")).alias("hash"), "y", "text").mapInPandas(run, "doc_id string, hash long, y long, x binary").toPandas().sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy(dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return NOTHING
    x = np.empty((len(got), FEATURES), dtype=np.float32)
    for i, row in enumerate(got.pop("x")):
        x[i] = np.frombuffer(row, dtype=np.float16)
    # Seven tenths to learn from, three to calibrate; where a class is missing in one, all rows serve for both.
    learn = got["hash"].to_numpy() % 10 < 7
    judge = ~learn
    if not all((part & (y == c)).any() for part in (learn, judge) for c in (0, 1)):
        learn = judge = np.ones(len(y), dtype=bool)
    weight = np.zeros(len(y))
    weight[learn] = balance(y[learn])
    w = regression(x, y.astype(float), weight)
    z = (x @ w[:-1].astype(np.float32)).astype(float)[judge] + w[-1]
    return Model(w, logistic(z[:, None], y[judge].astype(float), balance(y[judge]), ridge=0.1))


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def counts(text: str, codes: np.ndarray) -> tuple[int, int, int, int, int]:
    return len(codes), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SIGNS)), repeated_lines(text), repeated(codes)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score) for every row of ``docs``; a null text has no words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            rows = []
            for text in b["text"]:
                text = text if isinstance(text, str) else ""
                codes, hashes = coded(text)
                rows.append((*counts(text, codes), m.probability(text, codes, hashes)))
            out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy(dtype=object))
            yield out

    return by_text(docs, run, f"{COUNTS}, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept, score, verdict) for every row of documents.

    base_failed: fewer than FEWEST_WORDS words, or more than
    MOST_REPEATED_PERCENT % of them in repeated windows of three. verdict is
    rules, reject, doubt or good; kept are doubtful and good ones. Null and
    empty texts fail the rules. Repeated rows give repeated rows, an empty
    table an empty result; other columns are ignored.
    """
    found = score(docs, fit(docs, labels))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    verdict = F.when(failed, "rules").when(F.col("score") < REJECT_BELOW, "reject").when(F.col("score") < GOOD_FROM, "doubt").otherwise("good")
    result = found.withColumns({"base_failed": failed, "verdict": verdict})
    return result.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("verdict").isin("doubt", "good").alias("kept"), "score", "verdict")
