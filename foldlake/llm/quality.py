"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's inputs x are its distinct words, hashed into buckets (each 1 / sqrt(distinct words)), standardised
statistics of its form, and its length in characters as stored. The score is the logistic of

    b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

whose last part is all pairwise interactions of rank ``rank``, in time linear in the inputs. It is trained by
AdaGrad in numpy on a bounded sample of labelled documents (about ``sample`` rows), then calibrated by a line through
the margins on a tenth of them that is held back. Scoring runs where the documents lie, over whole texts.

Defined results: a null text is empty; an empty text has no words and zero statistics and gets a score as any other.
A null length is counted from the text. Equal texts and lengths get equal scores, repeated rows a score each. Without
labelled rows every score is 0.5.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, packed, remembers, text_batches, unpacked, work_of, worker_of

REMEMBERED = 60_000
_known: dict[str, int] = {}
remembers("quality", _known.clear)


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    rank: int = 8
    sample: int = 6000
    epochs: int = 6
    rate: float = 0.05
    l2: float = 1e-5
    seed: int = 11


def bucket(word: str, buckets: int) -> int:
    """A worker remembers the words it has met, up to a bound."""
    b = _known.get(word)
    if b is None:
        if len(_known) > REMEMBERED:
            _known.clear()
        b = _known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return b % buckets


FORM = ("word length", "distinct share", "most frequent share", "repeats of the word before", "upper-case words", "capitalised words",
        "words with marks inside or behind", "words without letters", "words of one sign", "lines a word", "sentence ends a word", "digits", "distinct lines share", "length")


def form(text: str, n_chars: float | None) -> list[float]:
    """The statistics of FORM, shares mostly."""
    ws = text.split()
    if not ws:
        return [0.0] * (len(FORM) - 1) + [math.log1p(n_chars if n_chars is not None else len(text))]
    n, bag = len(ws), Counter(ws)
    d = len(bag)
    lines = [x for x in text.split("\n") if x.strip()]
    weigh = lambda test: sum(c for w, c in bag.items() if test(w)) / n
    return [
        sum(len(w) * c for w, c in bag.items()) / n, d / n, max(bag.values()) / n, sum(map(str.__eq__, ws[1:], ws)) / n,
        weigh(lambda w: w.isupper() and len(w) > 1), weigh(lambda w: w[0].isupper()), weigh(lambda w: not w.isalnum() and not w[:-1].isalnum()),
        weigh(lambda w: not any(map(str.isalpha, w))), weigh(lambda w: len(w) == 1), len(lines) / n, (text.count(". ") + text.count(".\n")) / n,
        weigh(lambda w: any(map(str.isdigit, w))), len(set(lines)) / len(lines) if lines else 0.0,
        math.log1p(n_chars if n_chars is not None else len(text)),
    ]


def inputs(text: str | None, n_chars: float | None, buckets: int) -> tuple[list[int], list[float]]:
    text = text or ""
    n_chars = None if n_chars is None or n_chars != n_chars else max(n_chars, 0)
    return sorted({bucket(w, buckets) for w in set(text.lower().split())}), form(text, n_chars)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    line: tuple[float, float] = (1.0, 0.0)
    settings: Settings = field(default_factory=Settings)

    def vector(self, at: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices, values): word buckets, then the statistics."""
        b = self.settings.buckets
        z = np.clip((shape - self.mean) / self.scale, -4, 4)
        return np.concatenate([at, np.arange(b, b + len(z))]), np.concatenate([np.full(len(at), 1 / math.sqrt(max(1, len(at)))), z / 2])

    def margin(self, i: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[i]
        s = x @ v
        return float(self.bias + x @ self.weights[i] + 0.5 * (s @ s - (x * x) @ (v * v).sum(1)))

    def score(self, at: list[int], shape: list[float]) -> float:
        m = self.margin(*self.vector(np.asarray(at, "i8"), np.asarray(shape)))
        return 1 / (1 + math.exp(-min(max(self.line[0] * m + self.line[1], -30), 30)))


def _calibrate(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (kept positive) and offset of the log-odds over margins, by Newton's method with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, w = p - y, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1]])
        a, b = np.array([a, b]) - np.linalg.solve(h, [(g * m).sum() + (a - 1), g.sum() + b])
        a = max(a, 0.05)
    return float(a), float(b)


def train(rows: list[tuple[list[int], list[float], int]], s: Settings) -> Model:
    rng = np.random.default_rng(s.seed)
    size = s.buckets + len(FORM)
    shapes = np.array([r[1] for r in rows], "f8").reshape(-1, len(FORM))
    scale = shapes.std(0) if len(rows) else np.ones(len(FORM))
    model = Model(shapes.mean(0) if len(rows) else np.zeros(len(FORM)), np.where(scale > 1e-9, scale, 1.0), 0.0,
                  np.zeros(size), rng.normal(0, 0.01, (size, s.rank)), settings=s)
    if not rows:
        model.factors[:] = 0
        return model
    data = [(*model.vector(np.asarray(at, "i8"), np.asarray(shape)), y) for at, shape, y in rows]
    order = rng.permutation(len(data))
    held, fit = order[: len(order) // 10], order[len(order) // 10 :]
    gw, gv, gb = np.full(size, 1e-3), np.full((size, s.rank), 1e-3), 1e-3
    for _ in range(s.epochs):
        for k in rng.permutation(fit):
            i, x, y = data[k]
            v = model.factors[i]
            sums = x @ v
            m = model.bias + x @ model.weights[i] + 0.5 * (sums @ sums - (x * x) @ (v * v).sum(1))
            g = 1 / (1 + math.exp(-min(max(m, -30), 30))) - y
            dw = g * x + s.l2 * model.weights[i]
            dv = g * (np.outer(x, sums) - v * (x * x)[:, None]) + s.l2 * v
            gb += g * g
            gw[i] += dw * dw
            gv[i] += dv * dv
            model.bias -= s.rate * g / math.sqrt(gb)
            model.weights[i] -= s.rate * dw / np.sqrt(gw[i])
            model.factors[i] = v - s.rate * dv / np.sqrt(gv[i])
    if len(held) >= 20:
        model.line = _calibrate(np.array([model.margin(*data[k][:2]) for k in held]), np.array([data[k][2] for k in held], "f8"))
    return model


def _features(buckets: int):
    @work_of("quality")
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(*inputs(t, n, buckets), int(y)) for t, n, y in zip(batch["text"], batch["n_chars"], batch["y"], strict=True)]
            yield pd.DataFrame(out, columns=["at", "shape", "y"])
    return rows


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        length_col: str | None = "n_chars", settings: Settings = Settings()) -> Model:
    """``labels``: (doc_id, label) rows that may be learnt from; of repeated ids the larger label counts. Inputs are made
    where the documents lie; the sample's inputs come to the driver."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    known = bounded_sample(known, "_id", settings.sample)
    length = F.col(length_col).cast("double") if length_col else F.lit(None).cast("double")
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), length.alias("n_chars"))
    rows = rows.join(F.broadcast(known), "_id").select("text", "n_chars", "y")  # the sample is bounded
    sample = rows.mapInPandas(_features(settings.buckets), "at array<int>, shape array<double>, y int").toPandas()
    out = [(list(a), list(s), int(y)) for a, s, y in zip(sample["at"], sample["shape"], sample["y"], strict=True)]
    return train(sorted(out), settings)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", length_col: str | None = "n_chars", keep: dict[str, Column] | None = None,
          accept: float = 0.7, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns ``keep`` of each row, and its score and prediction (1 from ``accept`` on) under the names ``out``."""
    spark = docs.sparkSession
    text_batches(spark)
    length = F.col(length_col).cast("double") if length_col else F.lit(None).cast("double")
    rows = docs.select(packed(keep).alias("kept"), F.col(text_col).alias("text"), length.alias("length"))
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = sent.value
        with worker_of("quality"):
            for text, n in texts:
                yield pd.Series([m.score(*inputs(t, x, m.settings.buckets)) for t, x in zip(text, n, strict=True)], dtype="float64")

    rows = rows.select("kept", scored("text", "length").alias("score"))
    return rows.select(*unpacked(keep), F.col("score").alias(out[0]), (F.col("score") >= accept).cast("int").alias(out[1]))
