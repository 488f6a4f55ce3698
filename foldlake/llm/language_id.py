"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

A text is the mean of the vectors of its words' subwords (the character 2- to 4-grams of its lower-cased words, ends
included as spaces, hashed into buckets). Vectors and softmax are trained together by stochastic gradient descent in numpy on a bounded
sample of labelled documents, about ``per_lang`` of each language. A tenth of the sample is held back to fit the softmax
temperature and the confidence under which a prediction counts as rejected. Scoring runs where the documents lie, over
whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected. Equal texts get equal
results. With no labelled row every text is ``und``. Ties go to the language first in order. A null id is no hindrance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, text_batches

UND = "und"
#: Odd multipliers of the hash.
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], "u8")
SHIFT = np.uint64(40)


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    dim: int = 16
    grams: tuple[int, int] = (2, 4)
    per_lang: int = 600
    epochs: int = 8
    rate: float = 0.4
    #: Share of held-back predictions above the rejection threshold that may be wrong.
    error: float = 0.01
    seed: int = 7


def subwords(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the text's n-grams: none reaches over the space between two words."""
    a = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    inside, h, every, inner = a != 32, a, [], None
    for n in range(2, s.grams[1] + 1):
        h = h[:-1] * MIX[0] + a[n - 1 :]
        if n > 2:
            middle = inside[n - 2 : len(inside) - 1]
            inner = middle if inner is None else inner[:-1] & middle
        if n >= s.grams[0]:
            every.append(h if inner is None else h[inner])
    counts = np.bincount(((np.concatenate(every) * MIX[1]) >> SHIFT).astype("i8") % s.buckets, minlength=s.buckets)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    langs: list[str]
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], s: Settings) -> Model:
    """``bags``: (buckets, counts) of each document. Learning falls linearly to zero."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], "i8")
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim))
    weights, bias = np.zeros((len(names), s.dim)), np.zeros(len(names))
    order = rng.permutation(len(bags))
    held, fit = order[: len(order) // 10], order[len(order) // 10 :]
    step, steps = 0, max(1, s.epochs * len(fit))
    for _ in range(s.epochs):
        for i in rng.permutation(fit):
            rate = s.rate * (1 - step / steps)
            step += 1
            at, c = bags[i]
            if not len(at):
                continue
            share = c / c.sum()
            v = share @ vectors[at]
            g = _softmax(weights @ v + bias)
            g[y[i]] -= 1
            back = weights.T @ g
            weights -= rate * np.outer(g, v)
            bias -= rate * g
            vectors[at] -= rate * len(at) ** 0.5 * share[:, None] * back  # few buckets move a mean of many
    model = Model(names, vectors.astype("f4"), weights, bias, 1.0, 0.0)
    used = [i for i in held if len(bags[i][0])]
    if used and len(names) > 1:
        z = np.array([weights @ ((bags[i][1] / bags[i][1].sum()) @ vectors[bags[i][0]]) + bias for i in used])
        loss = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(used)), y[used]], 1e-12)).mean() for t in np.geomspace(0.2, 5, 41)}
        model.temperature = float(min(loss, key=loss.get))
        p = _softmax(z / model.temperature)
        right, top = p.argmax(1) == y[used], p.max(1)
        down = np.argsort(-top, kind="stable")
        wrong = np.cumsum(~right[down]) / np.arange(1, len(down) + 1)
        good = np.flatnonzero(wrong <= s.error)
        model.reject_below = float(top[down[good[-1]]]) if len(good) else 1.0
    return model


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Model:
    """``labelled``: the rows that may be learnt from. Their bags of buckets are made where they lie; the sample's bags
    come to the driver."""
    s = settings
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    text_batches(rows.sparkSession)

    def bag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                at, n = subwords(text, s)
                out.append((lang, at.astype("i4"), n.astype("f4")))
            yield pd.DataFrame(out, columns=["lang", "at", "n"])

    sample = bounded_sample(rows, "doc_id", s.per_lang, "lang").mapInPandas(bag, "lang string, at array<int>, n array<float>").toPandas()
    sample["key"] = [zlib.crc32(np.asarray(a, "<i4").tobytes()) for a in sample["at"]]
    sample = sample.sort_values(["lang", "key"], kind="stable")  # not in the order in which tasks end
    bags = [(np.asarray(a, "i8"), np.asarray(n, "f8")) for a, n in zip(sample["at"], sample["n"], strict=True)]
    return train(bags, sample["lang"].tolist(), s)


def classify(text: str | None, m: Model, s: Settings) -> tuple[str, float, bool]:
    if text is None or not m.langs or not any(map(str.isalpha, text)):
        return UND, 0.0, True
    at, n = subwords(text, s)
    p = _softmax((m.weights @ ((n / n.sum()) @ m.vectors[at]) + m.bias) / m.temperature)
    k = int(p.argmax())
    return m.langs[k], float(p[k]), bool(p[k] < m.reject_below)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep: dict[str, Column] | None = None, settings: Settings = Settings()) -> DataFrame:
    """The columns ``keep`` of each row, and lang_pred, score (calibrated probability), rejected."""
    spark = docs.sparkSession
    text_batches(spark)
    keep = keep or {}
    rows = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(keep.values())], F.col(text_col).alias("text"))  # by number: names may clash
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string, score double, rejected boolean"])
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [classify(t, sent.value, settings) for t in batch["text"]]
            yield batch.drop(columns="text").assign(lang_pred=[x[0] for x in out], score=[x[1] for x in out], rejected=[x[2] for x in out])

    found = rows.mapInPandas(score, schema)
    return found.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(keep)], "lang_pred", "score", "rejected")
