"""Toxicity by weak supervision.

Items (words, and word beginnings as patterns) that mark toxic documents, and such as mark clean ones, are mined from a
bounded sample of labelled documents and dealt over ``voters`` lexicon and pattern voters, each of which votes for its own
side or abstains. Every document of the corpus is then voted on, and the votes are counted by pattern: ``voters`` bits give
at most 2 ** voters counts, whatever the corpus holds. From these counts a generative model with one hidden class estimates
by expectation maximisation how often documents are toxic, how often each voter votes in either class, and how the voters'
votes correlate given the class. It starts from the shares in which the items stood in labelled documents, which then weigh
as much as ``trust`` documents. A vote counts by its log ratio between the classes, and so does an abstention, which thereby
says what it says: little from a voter that seldom votes. What correlated voters do alike counts the less, the more of it is
repeated. Its posterior of each vote pattern labels a bounded sample of documents, on which a linear
classifier over hashed words and beginnings is trained, of which those count that enough of the sample's documents hold
and whose log ratio between the classes exceeds ``ratio`` by ``sure`` standard errors. Scores come from the classifier.

Defined results: a null or empty text has no words and scores by the intercept. Equal texts get equal scores, repeated
rows a score each. Without labelled rows, or without a toxic one, nothing is mined, no voter fires, and every document
scores 0. Texts are read whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, packed, text_batches, unpacked


@dataclass(frozen=True)
class Settings:
    voters: int = 14
    #: Of these, how many vote clean.
    clean: int = 4
    items: int = 400
    beginnings: tuple[int, ...] = (4, 5, 6, 7, 8)
    sample: int = 8000
    #: Toxic documents that hold an item at least, as a number and as a share of all of them; and the share of its
    #: documents that is toxic at least.
    least: int = 4
    support: float = 0.01
    pure: float = 0.8
    #: Documents that hold a mark of clean ones, as a share of all, at least; and the share of these that is toxic, against
    #: that of all, at most; it must lie below the share of all by ``sure`` standard errors.
    common: float = 0.05
    spotless: float = 0.25
    #: Documents as many of which the labelled sample's shares weigh in the label model.
    trust: float = 20.0
    #: Share of the classifier's sample that holds an input at least, and its log ratio between the classes at least.
    held: float = 0.005
    ratio: float = 1.0
    sure: float = 2.0
    steps: int = 150
    seed: int = 5


REMEMBERED = 300_000
#: Odd multipliers of a hash.
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], "u8")


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case words without the marks around them."""
    return {w for w in (x.strip(".,;:!?\"'()[]<>|*&%$#-") for x in set((text or "").lower().split())) if w}


def items_of(words: set[str], s: Settings) -> set[str]:
    """Words as they are, beginnings with ``*`` behind."""
    return words | {w[:n] + "*" for w in words for n in s.beginnings if len(w) >= n}


def weighed(texts: DataFrame, s: Settings) -> DataFrame:
    """Adds wt: 1 over the number of documents that seem copies, by any of a few least hashes of three words in a row.
    Else what copies of one toxic document share would look like a mark of toxicity. ``texts`` is a bounded sample."""

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signs = []
            for t in batch["text"]:
                w = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in (t or "").lower().split()] or [0], "u8")
                w = np.concatenate([w, w[-1:], w[-1:]])
                h = (w[:-2] * MIX[0] + w[1:-1]) * MIX[1] + w[2:]
                signs.append([int((((h ^ k) * MIX[0]) >> np.uint64(8)).min()) << 2 | i for i, k in enumerate(MIX)])
            yield batch.assign(_signs=signs)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields)
    t = cut(texts.withColumn("_n", F.monotonically_increasing_id()).mapInPandas(least, f"{fields}, _n bigint, _signs array<bigint>"), "signs")
    each = t.select("_n", F.explode("_signs").alias("_s"))
    most = each.join(each.groupBy("_s").count(), "_s").groupBy("_n").agg((1 / F.max("count")).alias("wt"))
    return cut(t.join(most, "_n").drop("_n", "_signs"), "weighed")


def mine(texts: DataFrame, s: Settings) -> tuple[dict[str, float], dict[str, float]]:
    """``texts`` (text, y, wt): items of toxic documents, and of clean ones, best first, with the share of their documents that is
    toxic. Counted by Spark; those over the thresholds are few and the best ``items`` of them come to the driver."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, y, wt) for t, y, wt in zip(batch["text"], batch["y"], batch["wt"], strict=True) for i in items_of(tokens(t), s)]
            yield pd.DataFrame(out, columns=["item", "y", "wt"])

    weight = F.round(F.sum("wt"), 6).alias("n"), F.round(F.sum(F.col("wt") * F.col("y")), 6).alias("toxic")
    counts = cut(texts.mapInPandas(rows, "item string, y int, wt double").groupBy("item").agg(*weight), "items")
    every = texts.agg(F.coalesce(F.sum(F.col("wt") * F.col("y")), F.lit(0.0)).alias("toxic"), F.coalesce(F.sum("wt"), F.lit(0.0)).alias("n")).first()
    good = counts.filter((F.col("toxic") >= max(s.least, s.support * every["toxic"])) & (F.col("toxic") >= s.pure * F.col("n")))
    worth = F.round(F.col("toxic") * F.log((F.col("toxic") + 0.5) / (F.col("n") - F.col("toxic") + 0.5)), 6)
    best = good.orderBy(F.desc(worth), "item").limit(s.items).collect()
    if not best:
        return {}, {}
    share = lambda r: (r["toxic"] + 0.5) / (r["n"] + 2)
    expected = F.col("n") * every["toxic"] / every["n"]
    few = (F.col("n") >= max(s.least, s.common * every["n"])) & (F.col("toxic") <= s.spotless * expected) & (expected - F.col("toxic") >= s.sure * F.sqrt(expected))
    clean = counts.filter(few & ~F.col("item").endswith("*")).orderBy(F.desc("n"), "item").limit(s.items).collect()
    return {r["item"]: share(r) for r in best}, {r["item"]: share(r) for r in clean}


def voters_of(items: Iterable[str], s: Settings, clean: Iterable[str] = ()) -> dict[str, int]:
    """Voter of each item. Of toxic items that begin alike the best is kept; words and beginnings are dealt in turn over the
    voters of their kind, half of those that vote toxic; marks of clean documents over the last ``clean`` voters."""
    kept: list[str] = []
    for i in items:
        i_ = i.rstrip("*")
        if not any(i_.startswith(k.rstrip("*")) or k.rstrip("*").startswith(i_) for k in kept):
            kept.append(i)
    toxic = s.voters - s.clean
    half = toxic // 2
    words, starts = [i for i in kept if i[-1] != "*"], [i for i in kept if i[-1] == "*"]
    out = {w: j % half for j, w in enumerate(words)} | {b: half + j % (toxic - half) for j, b in enumerate(starts)}
    return {c: toxic + j % s.clean for j, c in enumerate(clean) if s.clean} | out


class Voter:
    """Bits of the voters that fire on a text. A worker remembers the bits of each word it has met, up to a bound."""

    def __init__(self, voters: dict[str, int], s: Settings):
        self.voters, self.s, self.known = voters, s, {}

    def __call__(self, words: set[str]) -> int:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        bits = 0
        for w in words:
            b = self.known.get(w)
            if b is None:
                b = 0
                for i in items_of({w}, self.s) & self.voters.keys():
                    b |= 1 << self.voters[i]
                self.known[w] = b
            bits |= b
        return bits


@dataclass
class LabelModel:
    prior: float
    fires: np.ndarray  # (class, voter)
    excess: np.ndarray  # correlation of each pair of voters, given the class

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        v = ((masks[:, None] >> np.arange(self.fires.shape[1])) & 1).astype("f8")
        both = np.maximum(self.excess, 0)  # opposed voters repeat nothing
        alike = v * (v @ both) + (1 - v) * ((1 - v) @ both)  # how much of what a voter does is done by others
        said = v * np.log(self.fires[1] / self.fires[0]) + (1 - v) * np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        z = (said / (1 + alike)).sum(1) + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(masks: np.ndarray, counts: np.ndarray, s: Settings, false: np.ndarray) -> LabelModel:
    """From the number of documents with each vote pattern. ``false`` is the share of each voter's votes held wrong beforehand;
    the last ``clean`` of the voters vote clean, if there are so many."""
    m = len(false)
    toward = np.arange(m) < m - s.clean if m == s.voters and m > 2 * s.clean else np.ones(m, bool)
    v = ((masks[:, None] >> np.arange(m)) & 1).astype("f8")
    n = counts.astype("f8")
    rate = (n @ v) / max(n.sum(), 1)
    prior = float(np.clip((v[:, toward].sum(1) > 0) @ n / max(n.sum(), 1), 1e-4, 0.5))
    toxic = np.where(toward, 1 - false, false)
    start = np.clip(np.stack([rate * (1 - toxic) / (1 - prior), rate * toxic / prior]), 1e-5, 1 - 1e-3)
    model = LabelModel(prior, start, np.zeros((m, m)))
    for _ in range(2):  # without correlations, then with
        for _ in range(60):
            p = model.posterior(masks)
            w = np.stack([(1 - p) * n, p * n])
            model.fires = np.clip((w @ v + s.trust * start) / (w.sum(1, keepdims=True) + s.trust), 1e-6, 1 - 1e-3)
            model.prior = float(np.clip(w[1].sum() / max(w.sum(), 1), 1e-6, 0.9))
        p = model.posterior(masks)
        cov = np.zeros((m, m))
        for c, q in enumerate((1 - p, p)):
            d = v - model.fires[c]
            cov += d.T @ (d * (q * n)[:, None])
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        model.excess = cov / np.outer(sd, sd) * (1 - np.eye(m))
    return model


def hashes(word: str, s: Settings) -> list[int]:
    """Of the word and its beginnings: 32 bits, signed."""
    return [zlib.crc32(i.encode("utf-8", "surrogatepass")) - (1 << 31) for i in items_of({word}, s)]


@dataclass
class Classifier:
    """Linear in the hashes that a text's words have."""

    weights: dict[int, float]
    bias: float


class Scorer:
    """A worker remembers which hashes with a weight each word it has met has, up to a bound."""

    def __init__(self, classifier: Classifier, s: Settings):
        self.c, self.s, self.known = classifier, s, {}

    def __call__(self, words: set[str]) -> float:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in words.difference(known):
            known[w] = tuple(h for h in hashes(w, self.s) if h in self.c.weights)
        held = set().union(*map(known.__getitem__, words))
        return math.fsum(map(self.c.weights.__getitem__, held)) + self.c.bias


def train_linear(rows: list[tuple[np.ndarray, float, float]], ratios: dict[int, float], s: Settings) -> Classifier:
    """Logistic regression on soft labels by full-batch AdaGrad. An input is scaled by its log ratio between the classes
    (naive Bayes), so that those which tell most are learnt first; ``rows``: (inputs, posterior, weight)."""
    if not rows or not ratios or max(p for _, p, _ in rows) < 0.5:
        return Classifier({}, -40.0)
    y, wt = np.array([p for _, p, _ in rows]), np.array([w for _, _, w in rows])
    names = np.array(sorted(ratios), "i8")
    ratio = np.array([ratios[h] for h in names.tolist()])
    flat = np.searchsorted(names, np.concatenate([at for at, _, _ in rows]))
    row = np.repeat(np.arange(len(rows)), [len(at) for at, _, _ in rows])
    x = ratio[flat]
    w, b, gw, gb = np.zeros(len(names)), 0.0, np.full(len(names), 1e-6), 1e-6
    for _ in range(s.steps):
        m = np.bincount(row, x * w[flat], minlength=len(rows)) + b
        g = 1 / (1 + np.exp(-np.clip(m, -30, 30))) - y
        g *= wt
        dw = np.bincount(flat, x * g[row], minlength=len(names)) + 0.02 * w
        gw, gb = gw + dw * dw, gb + g.sum() ** 2
        w -= 0.2 * dw / np.sqrt(gw)
        b -= 0.2 * g.sum() / math.sqrt(gb)
    return Classifier(dict(zip(names.tolist(), (w * ratio).tolist(), strict=True)), float(b))


@dataclass
class Model:
    voters: dict[str, int]
    labels: LabelModel
    classifier: Classifier
    settings: Settings


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        settings: Settings = Settings()) -> Model:
    """``labels``: (doc_id, label) rows that may be learnt from, used to mine items only; of repeated ids the larger
    label counts. ``learn``: a condition on ``docs`` for the documents that the classifier may be trained on."""
    s = settings
    spark = docs.sparkSession
    text_batches(spark)
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), learn.alias("learn"))
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    known = bounded_sample(known, "_id", s.sample // 2, "y")
    items, clean = mine(weighed(d.join(F.broadcast(known), "_id").select("text", "y"), s), s)  # the sample is bounded
    voters = voters_of(items, s, clean)

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vote = Voter(voters, s)
        for batch in batches:
            yield batch[["_id", "learn"]].assign(mask=[vote(tokens(t)) for t in batch["text"]])

    id_type = d.schema["_id"].dataType.simpleString()
    voted = cut(d.mapInPandas(votes, f"_id {id_type}, learn boolean, mask int"), "votes")
    seen = voted.groupBy("mask").count().toPandas().sort_values("mask")  # at most 2 ** voters rows
    wrong = {**clean, **{i: 1 - share for i, share in items.items()}}
    false = np.array([max([wrong[i] for i, j in voters.items() if j == k], default=0.5) for k in range(s.voters)])
    model = fit_label_model(seen["mask"].to_numpy("i8"), seen["count"].to_numpy("i8"), s, false)
    p = dict(zip(seen["mask"].tolist(), model.posterior(seen["mask"].to_numpy("i8")).tolist(), strict=True))
    table = spark.createDataFrame([(int(k), float(x), int(x >= 0.5)) for k, x in p.items()] or [(0, 0.0, 0)], "mask int, p double, side int")
    posterior = voted.filter(F.col("learn") & F.col("_id").isNotNull()).join(F.broadcast(table), "mask").groupBy("_id").agg(F.max("p").alias("p"), F.max("side").alias("side"))
    chosen = bounded_sample(cut(posterior, "posterior"), "_id", s.sample // 2, "side")

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["p", "wt"]].assign(at=[sorted({h for w in tokens(t) for h in hashes(w, s)}) for t in batch["text"]])

    texts = weighed(d.join(F.broadcast(chosen.select("_id", "p")), "_id").select("text", "p"), s)
    sample = cut(texts.mapInPandas(bags, "p double, wt double, at array<int>"), "bags")
    total = sample.agg(F.coalesce(F.sum("wt"), F.lit(0.0)).alias("n"), F.coalesce(F.sum(F.col("p") * F.col("wt")), F.lit(0.0)).alias("p")).first()
    inputs = sample.select(F.explode("at").alias("h"), "p", "wt").groupBy("h").agg(F.sum("wt").alias("n"), F.sum(F.col("p") * F.col("wt")).alias("t"))
    toxic, clean = (F.col("t") + 0.5) / (total["p"] + 1), (F.col("n") - F.col("t") + 0.5) / (total["n"] - total["p"] + 1)
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") - F.col("t") + 0.5))
    inputs = inputs.filter(F.col("n") >= max(3, s.held * total["n"])).withColumn("ratio", F.log(toxic / clean)).filter(F.abs("ratio") - s.sure * error >= s.ratio)
    ratios = {r["h"]: r["ratio"] for r in inputs.select("h", "ratio").collect()}  # at most the sample's inputs over their least number
    names = np.array(sorted(ratios), "i4")

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = [np.asarray(a, "i4") for a in batch["at"]]
            yield batch[["p", "wt"]].assign(at=[a[np.isin(a, names)] for a in at])

    rows = sample.mapInPandas(kept, "p double, wt double, at array<int>").toPandas()
    rows["key"] = [zlib.crc32(np.asarray(a, "<i4").tobytes()) for a in rows["at"]]
    rows = rows.sort_values(["key", "p"], kind="stable")
    learnt = train_linear([(np.asarray(a, "i8"), p, wt) for a, p, wt in zip(rows["at"], rows["p"], rows["wt"], strict=True)], ratios, s)
    return Model(voters, model, learnt, s)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: dict[str, Column] | None = None, toxic_from: float = 0.5) -> DataFrame:
    """The columns ``keep`` of each row, score, predicted."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(packed(keep).alias("kept"), F.col(text_col).alias("text"))
    sent = spark.sparkContext.broadcast((model.classifier, model.settings))

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        margin = Scorer(*sent.value)
        for batch in texts:
            m = np.array([margin(tokens(t)) for t in batch], "f8")
            yield pd.Series(1 / (1 + np.exp(-np.clip(m, -30, 30))))

    rows = rows.select("kept", scored("text").alias("score"))
    return rows.select(*unpacked(keep), "score", (F.col("score") >= toxic_from).cast("int").alias("predicted"))
