"""Language of a text: the family first, then one-versus-one linear support vector machines inside it.

Families are learned: languages whose mean n-gram profiles lie closest are grouped until about the
square root of the number of languages is left. A text is the hashed counts of its byte 1- to
4-grams, over its whole length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, released, spread, text_of
from .encoding import forget

DIMENSIONS = 2048
#: Documents of each language that the classifier is fitted on, in expectation.
SAMPLE_PER_LANGUAGE = 400
UNDETERMINED = "und"
_STRETCH = 1 << 20
_WORDS = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    return any(c.isalpha() for m in _WORDS.finditer(text) for c in m.group())


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed n-gram counts, case folded."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, max(1, len(data)), _STRETCH):
        part = data[at : at + _STRETCH + 3].astype(np.uint32)
        gram = part
        for n in range(4):
            if n:
                gram = gram[:-1] * np.uint32(257) + part[n:]
            own = gram[: max(0, min(_STRETCH, len(data) - n - at))]
            slot = ((own + np.uint32(n * 7919)) * np.uint32(2654435761)) >> np.uint32(21)
            counts += np.bincount(slot, minlength=DIMENSIONS)
    out = np.sqrt(counts).astype(np.float32)
    return out / max(float(np.sqrt(out @ out)), 1e-9)


@dataclass
class Model:
    languages: list[str]
    families: list[list[int]]
    family_weights: np.ndarray  # families x (dimensions + 1)
    pairs: list[tuple[int, int]]
    pair_weights: np.ndarray  # pairs x (dimensions + 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and a score from 0 to 1 for each row of ``x``."""
        n = len(x)
        x = np.hstack([x, np.ones((n, 1), np.float32)])
        margins = 4 * (x @ self.family_weights.T)
        margins = np.exp(margins - margins.max(axis=1, keepdims=True))
        family = margins.argmax(axis=1)
        sure = margins.max(axis=1) / margins.sum(axis=1)
        wins = np.zeros((n, len(self.languages)))
        decided = 1 / (1 + np.exp(-4 * np.clip(x @ self.pair_weights.T, -50, 50))) if self.pairs else np.zeros((n, 0))
        for k, (a, b) in enumerate(self.pairs):
            wins[:, a] += decided[:, k]
            wins[:, b] += 1 - decided[:, k]
        language = np.empty(n, np.int64)
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if len(members) == 1:
                language[rows] = members[0]
            elif len(rows):
                own = wins[np.ix_(rows, members)]
                language[rows] = np.array(members)[own.argmax(axis=1)]
                sure[rows] *= own.max(axis=1) / (len(members) - 1)
        return language, np.clip(sure, 0, 1)


def svm(x: np.ndarray, positive: np.ndarray, strength: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    y = np.where(positive, 1.0, -1.0)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum()))
    step = 1 / (2 * float((share * (x * x).sum(axis=1)).sum()) + strength)
    w, last = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(rounds):
        v = w + (t / (t + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (x @ v))
        last, w = w, v - step * (strength * v - 2 * x.T @ (share * y * slack))
    return w


def fit_model(names: list[str], labels: np.ndarray, x: np.ndarray) -> Model:
    centres = np.stack([x[labels == k].mean(axis=0) for k in range(len(names))])
    centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-9
    families = [[k] for k in range(len(names))]
    near = centres @ centres.T
    while len(families) > max(1, round(len(names) ** 0.5)):
        a, b = max(combinations(range(len(families)), 2), key=lambda p: near[np.ix_(families[p[0]], families[p[1]])].mean())
        families[a] = sorted(families[a] + families[b])
        del families[b]
    of = {k: f for f, members in enumerate(families) for k in members}
    family = np.array([of[k] for k in labels])
    heads = [svm(x, family == f) if len(families) > 1 else np.zeros(x.shape[1] + 1) for f in range(len(families))]
    pairs = [p for members in families for p in combinations(members, 2)]
    inner = []
    for a, b in pairs:
        rows = (labels == a) | (labels == b)
        inner.append(svm(x[rows], labels[rows] == a))
    return Model(names, families, np.stack(heads).astype(np.float32), pairs, np.array(inner, np.float32).reshape(len(pairs), -1))


def learn(docs: DataFrame, folds: int = 5, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Fit on labelled documents outside the held-out fold; None without any.

    Each language gives about ``per_language`` documents (all, if it has fewer), chosen by a hash of
    the id, so what reaches the driver is bounded by the number of languages. Texts without letters
    and NULL languages teach nothing.
    """
    train = docs.filter((id_crc() % folds != 0) & F.col("lang").isNotNull())
    # one row per language
    totals = train.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    rates = [(r["lang"], min(1.0, per_language / r["n"])) for r in totals.collect()]
    if not rates:
        return None
    keep = F.lit(False)
    for name, rate in rates:
        draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 30))
        keep = keep | ((F.col("lang").cast("string") == name) & (draw < int(rate * (1 << 30))))

    def rows(batches):
        forget()
        for batch in batches:
            texts = text_of(batch)
            good = [i for i, t in enumerate(texts) if has_letter(t)]
            names = batch.column("lang").to_pylist()
            yield pa.RecordBatch.from_pydict(
                {"lang": [names[i] for i in good], "x": [features(texts[i]).astype("<f4").tobytes() for i in good]},
                schema=pa.schema([("lang", pa.string()), ("x", pa.binary())]),
            )

    chosen = train.filter(keep).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sample = chosen.mapInArrow(released(rows), "lang string, x binary").collect()
    sample.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    names = sorted({r["lang"] for r in sample})
    if not names:
        return None
    place = {name: k for k, name in enumerate(names)}
    x = np.stack([np.frombuffer(r["x"], "<f4") for r in sample])
    return fit_model(names, np.array([place[r["lang"]] for r in sample]), x)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row; `und` with score 0 for NULL, letterless texts or without a model."""

    def rows(batches):
        for batch in batches:
            texts = text_of(batch)
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            good = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            for at in range(0, len(good), 1024):
                some = good[at : at + 1024]
                language, score = model.predict(np.stack([features(texts[i]) for i in some]))
                for i, k, s in zip(some, language, score, strict=True):
                    names[i], scores[i] = model.languages[k], float(s)
            columns = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    return spread(docs).mapInArrow(released(rows), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """``docs`` without documents whose language is undetermined or scored under ``least``; columns unchanged."""

    def good(batches):
        forget()
        for batch in batches:
            texts = text_of(batch)
            keep = [model is not None and has_letter(t) for t in texts]
            some = [i for i, k in enumerate(keep) if k]
            for at in range(0, len(some), 1024):
                part = some[at : at + 1024]
                for i, s in zip(part, model.predict(np.stack([features(texts[i]) for i in part]))[1], strict=True):
                    keep[i] = bool(s >= least)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(released(good), docs.schema)
