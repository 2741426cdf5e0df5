"""Toxicity by weak supervision.

Many weak voters (lexicon groups and patterns) vote toxic, clean or abstain on
each document.  A generative label model, fitted by expectation maximisation on
a sample of all training documents, labelled or not, estimates each voter's
accuracy, finds correlated voters and discounts them, and gives posterior
labels; a linear classifier is then trained on those posteriors alone and
scores every whole text.

Given labels serve two ends and are never a target of the classifier: the
labelled rows single out further lexicon words (log odds with a significance
bound), and their ballots are the prior (pseudo-counts) of the voters'
accuracies.  Both samples have a hard bound, ``max_rows`` each, taken by the
smallest hashes of id and text; scoring covers all rows.

Defined cases: null, empty and word-less texts are scored from the classifier's
intercept and predicted by the threshold like any other; documents with the
same text get the same score; documents without labels are scored, labels
without documents are ignored; several labels of one document count as the
largest; repeated rows are sampled once; without labels of both kinds, or with
an empty table, the plain votes of the general lexicon train the classifier.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, read, remainder

#: General lexicon, a voter for each group.
LEXICON = {
    "stupidity": "idiot idiots moron morons stupid stupidity dumb dumbass imbecile cretin dimwit brainless fool",
    "contempt": "pathetic loser losers clown clowns coward worthless useless failure nobody laughable",
    "disgust": "disgusting trash garbage scum filth filthy vermin vile gross repulsive revolting",
    "hostility": "hate kill die destroy despise shut hell damn bastard",
    "german": "idiot dummkopf trottel arschloch abschaum ekelhaft wertlos versager dreck",
    "french": "imbécile crétin ordure salaud connard minable pathétique répugnant",
    "spanish": "estúpido imbécil basura asqueroso patético inútil escoria cabrón",
}
_GROUPS = {name: frozenset(words.split()) for name, words in LEXICON.items()}
_MARKS = b"!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~\r\n\t\x0b\x0c"
_STRIP = bytes.maketrans(_MARKS, b" " * len(_MARKS))
_LEET = bytes.maketrans(b"013457@$", b"oieastas")
_YOU = re.compile(r"\b(?:you|your|du|dich|tu|toi|vous|usted)\b[^.!?\n]{0,40}", re.I)


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_STRIP).split()


_GENERAL = [frozenset(w.encode() for w in g) for g in _GROUPS.values()]
_EVERY = frozenset().union(*_GENERAL)


def signals(text: str | None, learned: frozenset[bytes]) -> list[float]:
    """One document's evidence: hits of each group, learned hits, distinct hits, masked hits, hits aimed at the reader, shouting, words."""
    words = tokens(text or "")
    known = _EVERY | learned
    hits = [w for w in words if w in known]
    counts = [float(sum(w in g for w in hits)) for g in _GENERAL]
    masked = sum(1 for w in words if not w.isalpha() and w.isascii() and (u := w.translate(_LEET)) != w and u in known)
    aimed = sum(any(w in known for w in tokens(m.group(0))) for m in _YOU.finditer(text)) if hits else 0
    shout = len(re.findall(r"\b[A-Z]{4,}\b[^\n]{0,20}!", text)) if text and "!" in text else 0
    return [*counts, float(sum(w in learned for w in hits)), float(len(set(hits))), float(masked), float(aimed), float(shout), float(len(words))]


NAMES = [*_GROUPS, "learned", "distinct", "masked", "aimed", "shouting", "length"]


def votes(x: np.ndarray) -> np.ndarray:
    """Voters' ballots (1 toxic, -1 clean, 0 abstain) from a matrix of signals.

    Lexicon and pattern voters say toxic on a hit and abstain otherwise; three
    absence voters say clean where their family finds nothing.
    """
    g = len(_GROUPS)
    hit = np.where(x[:, : g + 1] > 0, 1, 0)
    several = np.where(x[:, g + 1] > 1, 1, 0)
    pattern = np.where(x[:, g + 2 : g + 5] > 0, 1, 0)
    no_general = np.where(x[:, :g].sum(1) == 0, -1, 0)
    no_learned = np.where(x[:, g] == 0, -1, 0)
    nothing = np.where(x[:, : g + 4].sum(1) == 0, -1, 0)
    return np.column_stack([hit, several, pattern, no_general, no_learned, nothing])


@dataclass
class LabelModel:
    """Naive-Bayes-like generative model with voters' correlations folded in as discounts."""

    prior: float
    when: np.ndarray = field(repr=False)  # voter x ballot(-1, 0, 1) x class: probabilities
    discount: np.ndarray = field(repr=False)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        s = np.full(len(v), math.log(self.prior / (1 - self.prior)))
        for j in range(v.shape[1]):
            p = self.when[j][v[:, j] + 1]
            s += self.discount[j] * np.where(v[:, j] == 0, 0.25, 1.0) * np.log(p[:, 1] / p[:, 0])
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def ballots(v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted counts of each voter's ballots -1, 0 and 1."""
    return np.stack([((v == b) * weight[:, None]).sum(0) for b in (-1, 0, 1)], axis=1)


def fit_label_model(v: np.ndarray, prior: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 150) -> LabelModel:
    """Expectation maximisation over unlabelled ballots ``v``.

    ``prior`` holds the ballots of labelled rows, (clean, toxic): their counts
    are added to the expected ones as pseudo-counts of each class, at most as
    many as the class has in ``v``.  Correlations: the part of the ballots'
    correlation that remains within the classes; a voter's evidence is divided by one plus its
    summed positive residual correlations.
    """
    cast = np.maximum((v != 0).sum(1), 1)
    q = 0.05 + 0.9 * (v > 0).sum(1) / cast
    known = [None if prior is None or not len(x) else ballots(x, np.ones(len(x))) / len(x) for x in prior or (None, None)]
    if known[0] is not None and known[1] is not None:  # polarity from the labelled rows
        start = LabelModel(0.1, np.stack([(k + 1e-3) / (k + 1e-3).sum(1, keepdims=True) for k in known], axis=2), np.full(v.shape[1], 0.5))
        q = start.posterior(v)
    model = None
    for _ in range(rounds):
        mass = (float((1 - q).sum()), float(q.sum()))
        counts = []
        for c, w in enumerate((1 - q, q)):
            n = ballots(v, w) + 0.5
            counts.append(n if known[c] is None else n + known[c] * min(len(prior[c]), mass[c] + 1))
        when = np.stack([n / n.sum(1, keepdims=True) for n in counts], axis=2)
        mean1, mean0 = (q[:, None] * v).sum(0) / max(mass[1], 1e-9), ((1 - q)[:, None] * v).sum(0) / max(mass[0], 1e-9)
        r = v - (q[:, None] * mean1 + (1 - q)[:, None] * mean0)
        # Where labels say what the class is, a voter that it explains almost wholly has next to no residual:
        # a tenth of its variance keeps that from counting as correlation.
        sd = np.sqrt((r**2).mean(0) + (0.0 if known[1] is None else 0.1) * v.var(0)) + 1e-9
        corr = (r.T @ r) / len(v) / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
        model = LabelModel(float(np.clip(q.mean(), 0.005, 0.6)), when, 1 / (1 + np.where(corr > 0.1, corr, 0).sum(1)))
        before, q = q, model.posterior(v)
        if np.abs(q - before).max() < 1e-6:
            break
    return model


def design(x: np.ndarray) -> np.ndarray:
    """Features of the linear classifier: squashed hits, hit rate, squashed length."""
    g = len(_GROUPS)
    n = np.maximum(x[:, -1], 1)
    hits = x[:, : g + 5]
    return np.column_stack([np.minimum(hits, 1), np.log1p(hits), np.minimum(100 * x[:, g] / n, 3), np.minimum(100 * x[:, :g].sum(1) / n, 3), np.log1p(x[:, -1]) / 10])


@dataclass
class ToxicityModel:
    learned: frozenset
    weights: np.ndarray
    bias: float
    label_model: LabelModel | None = field(default=None, repr=False)
    threshold: float = 0.3

    def score(self, texts) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        x = np.array([signals(t, self.learned) for t in texts])
        return 1 / (1 + np.exp(-np.clip(design(x) @ self.weights + self.bias, -30, 30)))


def fit_linear(d: np.ndarray, q: np.ndarray, l2: float = 1e-3, steps: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps with a small ridge."""
    a = np.column_stack([d, np.ones(len(d))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], l2 * len(d))
    ridge[-1] = 1e-6 * len(d)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - q) + ridge * w
        hess = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn_words(labelled: DataFrame, top: int = 400, least: int = 8, z: float = 4.0, share: float = 0.8) -> frozenset[bytes]:
    """Words that mark the toxic training rows.

    A word counts once for each different word before it, so that copies of one
    toxic text, near ones too, single out none of its words.  Kept are words
    with ``least`` such contexts in toxic rows or more, toxic in ``share`` of
    their contexts, and toxic more often than chance by ``z`` standard errors
    (score test).  ``labelled(text, y)`` is the bounded sample; at most ``top``
    words, the most significant ones, reach the driver.
    """
    words = F.array_remove(F.split(F.lower(F.col("text")), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"), "")
    pairs = F.element_at(F.transform(F.array(words), lambda a: F.transform(a, lambda x, i: F.struct(x.alias("w"), F.coalesce(F.get(a, i - 1), F.lit("")).alias("before")))), 1)
    seen = labelled.select("y", F.explode(pairs).alias("p")).select("y", "p.w", "p.before").where("length(w) between 3 and 40").distinct()
    per = seen.groupBy("w").agg(F.sum("y").alias("t"), F.count("*").alias("m"))
    n = seen.agg(F.sum("y").alias("t"), F.count("*").alias("m")).first()
    if not n["t"] or n["t"] == n["m"]:
        return frozenset()
    p = n["t"] / n["m"]
    score = (F.col("t") - p * F.col("m")) / F.sqrt(p * (1 - p) * F.col("m"))
    best = per.where((F.col("t") >= least) & (F.col("t") >= share * F.col("m"))).withColumn("z", score).where(F.col("z") >= z)
    return frozenset(r["w"].encode() for r in best.orderBy(F.desc("z"), "w").limit(top).collect())


def _least_hashes(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` different (id, text) of ``rows(doc_id, h)``: a distributed top-k of numbers, no text moves."""
    return rows.select("doc_id", "h").distinct().orderBy(F.xxhash64("h", F.lit("toxic")), "h", "doc_id").limit(most)


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, y, part): ``all`` rows of any training document (y null), ``labelled`` ones with their label, each at most ``max_rows``."""
    y = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).where("text is not null")
    ids = rows.select("doc_id", "h")
    known = materialize(ids.join(y, "doc_id"), "labelled")
    want = _least_hashes(ids, max_rows).select("h", F.lit(None).cast("int").alias("y"), F.lit("all").alias("part"))
    for label in (0, 1):
        some = _least_hashes(known.where(F.col("y") == label), max_rows // 2)
        want = want.unionByName(some.select("h", F.lit(label).alias("y"), F.lit("labelled").alias("part")))
    want = materialize(want, "wanted")
    texts = rows.join(F.broadcast(want.select("h").distinct()), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))  # at most 2 * max_rows
    sample = materialize(texts.join(F.broadcast(want), "h").select("text", "y", "part"), "toxic-sample")  # the same bound
    discard(known, want)
    return sample


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, threshold: float = 0.3) -> ToxicityModel:
    """Fit on at most ``max_rows`` rows of ``docs(doc_id, text)``, labelled or not, and at most ``max_rows`` with ``labels(doc_id, toxic)``."""
    sample = _sample(docs, labels, max_rows)
    learned = learn_words(sample.where("part = 'labelled'"))

    def evidence(batches):
        for b in batches:
            x = [signals(t, learned) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1).cast(pa.int32())], ["x", "y"])

    rows = sample.select("text", "y").mapInArrow(evidence, "x array<double>, y int").collect()
    discard(sample)
    every = np.array([r["x"] for r in rows if r["y"] is None])
    known = [np.array([r["x"] for r in rows if r["y"] == c]) for c in (0, 1)]
    if not (len(every) and len(known[0]) and len(known[1])):  # nothing to learn polarity from: the general lexicon's plain votes
        x = np.zeros((80, len(NAMES)))
        x[:, -1] = 30
        x[40:, : len(_GROUPS)] = np.eye(len(_GROUPS))[np.arange(40) % len(_GROUPS)]
        x[40:, len(_GROUPS) + 1] = 1
        w, b = fit_linear(design(x), np.where(votes(x).max(1) > 0, 0.9, 0.02))
        return ToxicityModel(learned, w, b, None, threshold)
    model = fit_label_model(votes(every), (votes(known[0]), votes(known[1])))
    w, b = fit_linear(design(every), model.posterior(votes(every)))
    return ToxicityModel(learned, w, b, model, threshold)


def predict(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Adds ``score, predicted`` to every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(sent.value.score(list(texts)))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    out = docs.withColumn("_tox", score(F.col(text))).select(*kept, F.col("_tox").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= F.lit(model.threshold)).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs.where(remainder("doc_id", 4) != 2), labels.where(remainder("doc_id", 4) != 2))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
