"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a binary classifier on hashed character n-grams (one to three letters)
predicts the bit; a text gets the language of the nearest codeword, where a bit counts by its logistic loss, weighted by how
well its classifier knows that language in training. Where the second codeword is about as near, the text is flagged as ambiguous.

The model is fitted on a bounded sample of labelled documents: SAMPLE_ROWS in all, shared evenly by the languages,
the first of each in the order of a hash of doc_id. Whole texts count, in the sample and in predictions.

Defined results: null text and texts without a letter are "und" with score 0; without any labelled document everything
is "und"; with one language everything else has that language with score 1. Null doc_id is hashed as an empty string.
Equal rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 2000
DIM = 4096
EXHAUSTIVE = 6  #: up to so many languages all splits in two are learned; beyond, random codewords
UNDETERMINED = "und"
MARGIN = 0.1  #: of scores of the first and second language, below which a text is ambiguous
_PIECE = 1_000_000
_PLACES = 1 << 40
_letters: list[np.ndarray] = []


def features(text: str | None) -> np.ndarray | None:
    """Log counts of hashed n-grams, scaled to length one; None without a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    counts, any_letter = np.zeros(DIM, np.float64), False
    text = text or ""
    for at in range(0, len(text), _PIECE):
        piece = text[max(0, at - 2) : at + _PIECE].lower()
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters[0][c]
        any_letter |= bool(letter.any())
        c = np.where(letter, c, 32)
        c = c[letter | np.concatenate([[True], letter[:-1]])].astype(np.uint64)
        h = c * np.uint64(0x9E3779B97F4A7C15)
        for n in range(1, 4):
            if len(c) >= n:
                counts += np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=DIM)
            if n < 3 and len(c) > n:
                h = (h[:-1] ^ c[n:]) * np.uint64(0xC2B2AE3D27D4EB4F)
            else:
                break
    if not any_letter:
        return None
    x = np.log1p(counts)
    return (x / np.sqrt((x * x).sum())).astype(np.float32)


def codebook(n: int, seed: int = 5) -> np.ndarray:
    """(n, bits) of -1 and 1: all splits in two for few languages, else the best of random codes by least distance."""
    if n < 2:
        return np.ones((n, 0), np.int64)
    if n <= EXHAUSTIVE:
        rest = [s for s in product((-1, 1), repeat=n - 1) if min(s) < 0]
        return np.array([(1, *s) for s in rest], np.int64).T
    rng, best = np.random.default_rng(seed), None
    for _ in range(200):
        code = rng.choice([-1, 1], (n, 8 * int(np.ceil(np.log2(n)))))
        apart = ((code[:, None] != code[None]).sum(axis=2) + 1000 * np.eye(n, dtype=int)).min()
        if (np.abs(code.sum(axis=0)) < n).all() and (best is None or apart > best[0]):
            best = apart, code
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  #: (languages, bits)
    weights: np.ndarray  #: (DIM, bits)
    bias: np.ndarray
    trust: np.ndarray  #: (languages, bits): share of the language's training texts whose bit is right; rows sum to one

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(texts, languages), summing to one: softmax of the weighted losses."""
        if len(self.languages) == 1:
            return np.ones((len(x), 1))
        f = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -f * c) * t).sum(axis=1) for c, t in zip(self.code, self.trust)], axis=1)
        e = np.exp(-self.code.shape[1] * (loss - loss.min(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: list[str], rounds: int = 120, rate: float = 0.3, decay: float = 1e-5) -> Model:
    """Logistic classifiers for all bits at once, by Adam on the whole sample; each language weighs the same."""
    languages = sorted(set(y))
    code = codebook(len(languages))
    at = np.array([languages.index(v) for v in y], np.int64)
    if len(languages) < 2:
        return Model(languages, code, np.zeros((DIM, 0)), np.zeros(0), np.ones((len(languages), 0)))
    t = code[at].astype(np.float32)
    share = (1 / np.bincount(at)[at] / len(languages)).astype(np.float32)[:, None]
    w = np.zeros((DIM + 1, code.shape[1]), np.float32)
    xs = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, rounds + 1):
        f = xs @ w
        g = xs.T @ (-t * share / (1 + np.exp(np.clip(t * f, -30, 30)))) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    right = (xs @ w * t > 0).astype(np.float64)
    trust = np.stack([right[at == k].mean(axis=0) for k in range(len(languages))]) + 1e-6
    return Model(languages, code, w[:-1], w[-1], trust / trust.sum(axis=1, keepdims=True))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on labelled documents (doc_id, text, lang) that are not held out."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(_PLACES))
    labelled = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & ~held_out()).withColumn("_h", place)
    stats = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("_h").alias("first")).collect()  # a row for each language
    if not stats:
        return fit(np.empty((0, DIM), np.float32), [])
    each = max(1, sample_rows // len(stats))
    # the first rows by place are among those up to a place that four times as many are expected to reach
    upto = [(r["lang"], float(max(r["first"], _PLACES * min(1, 4 * each / r["n"])))) for r in stats]
    near = F.broadcast(docs.sparkSession.createDataFrame(upto, "lang string, _upto double"))
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    ids = labelled.select("lang", "doc_id", "_h").join(near, "lang").where("_h <= _upto").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= each).select("lang", "doc_id").distinct()
    # at most sample_rows ids; rows that share an id are cut to the same number again
    pick = F.broadcast(ids.withColumnRenamed("lang", "_l").withColumnRenamed("doc_id", "_d"))
    rows = labelled.join(pick, F.col("lang").eqNullSafe(F.col("_l")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", F.xxhash64("text")))).where(F.col("_r") <= each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x = [features(t) for t in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array([None if v is None else v.tobytes() for v in x], pa.binary())], names=["lang", "_r", "x"])

    got = sorted((r for r in rows.select("lang", "_r", "text").mapInArrow(run, "lang string, _r int, x binary").collect() if r["x"] is not None), key=lambda r: (r["lang"], r["_r"]))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(-1, DIM)
    return fit(x, [r["lang"] for r in got])


def predict(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """The columns keep of docs, then language, score and whether it is ambiguous, under names. Looks at nothing but text."""
    n = len(keep)
    inner = docs.select(F.col("text").alias("_li"), *[F.col(c).alias(f"_l{i}") for i, c in enumerate(keep)])
    out = ", ".join([*(f"`_l{i}` {inner.schema[f'_l{i}'].dataType.simpleString()}" for i in range(n)), "_lp string", "_ls double", "_la boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = [features(t) for t in part.column(0).to_pylist()]
                on = np.array([v is not None and bool(model.languages) for v in x])
                langs, score, unsure = [UNDETERMINED] * len(x), np.zeros(len(x)), np.ones(len(x), bool)
                if on.any():
                    s = model.scores(np.stack([v for v, k in zip(x, on) if k]))
                    best = s.argmax(axis=1)
                    for i, k in zip(np.flatnonzero(on), best):
                        langs[i] = model.languages[k]
                    score[on] = s.max(axis=1)
                    unsure[on] = s.shape[1] > 1 and np.sort(s, axis=1)[:, -1] - np.sort(s, axis=1)[:, -min(2, s.shape[1])] < MARGIN
                yield pa.record_batch([*part.columns[1:], pa.array(langs), pa.array(score), pa.array(unsure)], names=[*(f"_l{i}" for i in range(n)), "_lp", "_ls", "_la"])

    return inner.mapInArrow(run, out).toDF(*keep, *names)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs (doc_id, text, lang): doc_id, held_out, lang_pred, score, ambiguous for each row."""
    found = predict(docs, train(docs, sample_rows), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
