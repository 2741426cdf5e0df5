"""Language identification with error-correcting output codes.

Every language gets a binary codeword; one linear n-gram classifier per bit
predicts that bit, and loss-weighted decoding picks the codeword with the
smallest weighted loss (the weights of a class are its bits' training
accuracies).  A text whose two nearest codewords lie close together is flagged
ambiguous.

Features are hashed byte n-grams (2 to 4) of the lower-cased whole text, in
which everything but letters becomes a space.  The classifiers are fitted on a
bounded sample: at most ``per_language`` labelled texts of each language, chosen
by their hash, and of each at most ``most_grams`` n-grams, its most frequent
ones; every language is learned.  Scoring covers every row and whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0
and not ambiguous; so is every text when there is nothing to learn from; with
one learned language every text with a letter gets it.  Letters are Unicode
letters: digits, fractions and superscripts are none.  Ties between codewords go to the first language in code point order.  Very long texts are
scored in pieces with overlap, so memory is bounded.  Rows that repeat get
equal results; extra columns pass through ``predict`` untouched unless they
are called like its outputs, which replace them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, read, remainder, schema_of

DIM = 1 << 16
NGRAMS = (2, 3, 4)
_SEEDS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_PIECE = 1 << 20


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _clean(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "surrogatepass").translate(_KEEP) + b" "


def _grams(piece: bytes) -> list[np.ndarray]:
    """Hashed ids of the n-grams that start in the first ``_PIECE`` bytes of a piece, an array for each n."""
    raw = np.frombuffer(piece, dtype=np.uint8).astype(np.uint32)
    out = []
    for n, seed in zip(NGRAMS, _SEEDS, strict=True):
        starts = min(len(raw) - n + 1, _PIECE)
        if starts <= 0:
            continue
        code = raw[:starts].copy()
        for i in range(1, n):
            code = (code << np.uint32(8)) | raw[i : starts + i]
        out.append(((code * np.uint32(seed)) >> np.uint32(16)).astype(np.int32))
    return out


def _pieces(data: bytes):
    """Pieces that overlap by what an n-gram needs beyond its first byte, so that each n-gram starts in one piece only."""
    if len(data) <= _PIECE:
        yield data
        return
    for at in range(0, len(data), _PIECE):
        yield data[at : at + _PIECE + max(NGRAMS) - 1]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram ids of a whole text and their shares."""
    total = np.zeros(DIM, dtype=np.float64)
    for piece in _pieces(_clean(text)):
        for ids in _grams(piece):
            total += np.bincount(ids, minlength=DIM)
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), (total[ids] / total.sum()).astype(np.float32)


def code_matrix(k: int, seed: int = 7) -> np.ndarray:
    """Codewords (rows, entries -1 and 1): all distinct splits for up to 5 classes, else the best separated of seeded random ones."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 5:
        return np.array([[1 if c == 0 or not (b >> (c - 1)) & 1 else -1 for b in range(1, 1 << (k - 1))] for c in range(k)])
    rng, bits, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), None
    for _ in range(200):
        m = rng.choice((-1, 1), size=(k, bits))
        apart = min(int((m[i] != m[j]).sum()) for i in range(k) for j in range(i))
        if (abs(m.sum(0)) < k).all() and (best is None or apart > best[0]):
            best = (apart, m)
    return best[1]


@dataclass
class EcocModel:
    classes: list[str]
    code: np.ndarray
    weights: np.ndarray = field(repr=False)  # DIM x bits
    bias: np.ndarray
    trust: np.ndarray  # classes x bits, rows sum to 1
    ambiguous_below: float = 0.12

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for piece in _pieces(_clean(text)):
            for ids in _grams(piece):
                total += self.weights.take(ids, axis=0).sum(axis=0)
                n += len(ids)
        return total / max(n, 1) + self.bias

    def decode(self, f: np.ndarray) -> tuple[int, float, float]:
        """Nearest codeword, its share of exp(-loss), and the gap in loss to the second nearest."""
        loss = (self.trust * np.logaddexp(0, -self.code * f)).sum(1)
        order = np.argsort(loss, kind="stable")
        share = np.exp(-3 * (loss - loss[order[0]]))
        return int(order[0]), float(1 / share.sum()), float(loss[order[1]] - loss[order[0]])

    def predict_one(self, text: str | None) -> tuple[str, float, bool, str | None]:
        if not text or not self.classes or not has_letter(text):
            return "und", 0.0, False, None
        if len(self.classes) == 1:
            return self.classes[0], 1.0, False, None
        f = self.margins(text)
        best, score, gap = self.decode(f)
        second = np.argsort((self.trust * np.logaddexp(0, -self.code * f)).sum(1), kind="stable")[1]
        return self.classes[best], score, gap < self.ambiguous_below, self.classes[second]


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], steps: int = 60, rate: float = 4.0) -> EcocModel:
    """Fit the bit classifiers on (language, ids, shares): logistic loss, Adam from the smoothed log odds of the two sides."""
    classes = sorted({r[0] for r in rows})
    code = code_matrix(len(classes))
    if len(classes) < 2:
        return EcocModel(classes, code, np.zeros((DIM, 0), np.float32), np.zeros(0), np.ones((len(classes), 0)))
    y = np.array([classes.index(r[0]) for r in rows])
    ids, val = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    sizes = np.array([len(r[1]) for r in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    per = np.zeros((len(classes), DIM))
    for c in range(len(classes)):
        mine = y[row] == c
        per[c] = np.bincount(ids[mine], val[mine], DIM) / (y == c).sum() + 1e-6
    even = 1 / np.bincount(y)[y]  # classes count alike
    weights, bias, f = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.zeros((len(rows), code.shape[1]))
    for bit in range(code.shape[1]):  # one at a time: the memory is that of the sample's vectors
        t = code[y, bit]
        w = 2 * np.log(per[code[:, bit] > 0].mean(0) / per[code[:, bit] < 0].mean(0))
        m, v = np.zeros(DIM), np.zeros(DIM)
        for step in range(1, steps + 1):
            margin = np.add.reduceat(w[ids] * val, starts) + bias[bit]
            g = -t / (1 + np.exp(np.clip(t * margin, -30, 30))) * even
            grad = np.bincount(ids, val * g[row], DIM)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            w = w - 0.1 * rate / np.sqrt(step) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) - 1e-4 * w
            bias[bit] -= 0.05 * g.sum() / even.sum()
        weights[:, bit], f[:, bit] = w, np.add.reduceat(w[ids] * val, starts) + bias[bit]
    right = np.stack([(np.sign(f[y == c]) == code[c]).mean(0) for c in range(len(classes))]) + 1e-3
    return EcocModel(classes, code, weights, bias, right / right.sum(1, keepdims=True))


def _sample(rows: DataFrame, per_language: int) -> DataFrame:
    """(l, t): at most ``per_language`` different texts of each language, those with the smallest hashes.

    A first cut by the language's share of different texts leaves about four
    times as many, so that no language, however frequent, is ranked as a whole.
    """
    h = rows.withColumn("h", F.xxhash64("t"))
    counts = materialize(h.groupBy("l").agg(F.approx_count_distinct("h", 0.05).alias("n")), "languages")  # a row for each language
    coin = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / float(1 << 30)
    near = h.join(broadcast_if_small(counts), "l").where(coin * F.col("n") < 4.0 * per_language).groupBy("l", "h").agg(F.first("t").alias("t"))
    order = W.partitionBy("l").orderBy("h")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("l", "t")


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 300, most_grams: int = 4096) -> EcocModel:
    """Fit on a bounded sample of the rows with text and language.

    At most ``per_language`` feature vectors of ``most_grams`` entries reach the
    driver for each language that the labels name.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("t").isNotNull() & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))

    def vectors(batches):
        for b in batches:
            got = []
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, val = features(t)
                if len(ids) > most_grams:
                    top = np.sort(np.argsort(-val, kind="stable")[:most_grams])
                    ids, val = ids[top], val[top]
                got.append((name, ids.tobytes(), val.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary()))], ["l", "ids", "val"])

    got = _sample(rows, per_language).mapInArrow(vectors, "l string, ids binary, val binary").collect()
    return fit([(r["l"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["val"], np.float32)) for r in sorted(got, key=lambda r: (r["l"], bytes(r["ids"]), bytes(r["val"])))])


def predict(docs: DataFrame, model: EcocModel, text: str = "text") -> DataFrame:
    """Adds ``lang_pred, score, ambiguous, second`` to every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM x bits floats: bounded by the number of languages
    out = schema_of("lang_pred string, score double, ambiguous boolean, second string")

    @F.pandas_udf(out)
    def guess(texts):
        import pandas as pd

        own = sent.value
        return pd.DataFrame([own.predict_one(t) for t in texts], columns=[f.name for f in out])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in out.names]
    return docs.withColumn("_langid", guess(F.col(text))).select(*kept, "_langid.*")


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(remainder("doc_id", 3) != 1)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(learnable(docs))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous", "second")
