"""Toxicity by a classifier chain.

Categories are predicted one after the other; each model is a linear (logistic) one over the presence of
hashed words and word beginnings, and over the log-odds that the chain gave for the categories before it. In
training these come from out-of-fold predictions, so a later model never learns from fitted answers.

Models are fitted on a bounded sample of labelled rows (`SAMPLE`). How often each feature goes with each category
is counted by Spark; the driver gets only the features that the models chose and, for each sampled row, one bit
for each of them. Scoring runs over every whole text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import materialize, with_fields
from ledgerloom.llm.textkit import NON_WORD, Words, chunks

#: The most labelled rows that a fit gathers, those least by a hash of their id.
SAMPLE = 8000
#: Features a model may use: those whose presence tells most about the category.
FEATURES = 400
FOLDS = 4
DIMENSIONS = 1 << 20
#: Word beginnings of so many bytes are features beside whole words.
STEMS = (4, 5, 6)
CHAIN = ("low_quality", "toxic", "toxic_low_quality")


def features(words: Words) -> np.ndarray:
    """A row of feature numbers for each word: the word itself and its beginnings."""
    own = [words.hashes(), *(words.hashes(p, seed=p) for p in STEMS)]
    return np.stack([(h >> np.uint64(44)).astype(np.int64) % DIMENSIONS for h in own], axis=1)


@dataclass
class Linear:
    """weights of the chosen features, of earlier categories' log-odds, and the intercept."""

    chosen: np.ndarray
    weights: np.ndarray
    chained: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(DIMENSIONS)
        out[self.chosen] = self.weights
        return out


@dataclass
class Chain:
    names: tuple[str, ...]
    models: list[Linear] = field(default_factory=list)

    def predict(self, sums: np.ndarray) -> np.ndarray:
        """sums: (rows, categories) of each model's feature weights; gives probabilities of each category."""
        logits = np.zeros_like(sums)
        for k, m in enumerate(self.models):
            logits[:, k] = np.clip(sums[:, k] + logits[:, :k] @ m.chained + m.intercept, -12, 12)
        return 1 / (1 + np.exp(-logits))


#: Shrinkage of weights: of 0.1, 0.3 and 1 the one with the fewest errors on held-out halves of the labelled rows.
RIDGE = 0.3
#: Rows of a block in which normal equations are summed up.
BLOCK = 1024


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Newton's method for ridge logistic regression; the last column of x is the intercept, not shrunk. The normal
    equations are summed up over blocks of rows, so memory beyond x follows the columns."""
    n = x.shape[1]
    w = np.zeros(n)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    shrink = np.full(n, ridge)
    shrink[-1] = 1e-6
    def loss(w: np.ndarray) -> float:
        out = float(shrink @ (w * w)) / 2
        for at in range(0, len(y), BLOCK):
            z = x[at : at + BLOCK].astype(np.float64) @ w
            out += float((np.logaddexp(0, z) - y[at : at + BLOCK] * z).sum())
        return out

    now = loss(w)
    for _ in range(rounds):
        gradient, curve = shrink * w, np.diag(shrink)
        for at in range(0, len(y), BLOCK):
            own = x[at : at + BLOCK].astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            gradient = gradient + own.T @ (p - y[at : at + BLOCK])
            curve += (own * (p * (1 - p) + 1e-9)[:, None]).T @ own
        step = np.linalg.solve(curve, gradient)
        while (after := loss(w - step)) > now and np.abs(step).max() > 1e-6:  # an overshoot
            step /= 2
        w, now = w - step, after
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Sample:
    """Sampled rows: packed bits (one for each feature of `known`, sorted), labels (rows, categories) and folds."""

    known: np.ndarray
    bits: np.ndarray
    labels: np.ndarray
    fold: np.ndarray

    def dense(self, chosen: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, chosen)
        return (self.bits[:, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(np.float32)


def _fit_one(x: np.ndarray, y: np.ndarray, earlier: np.ndarray, chosen: np.ndarray) -> Linear:
    if not len(y) or y.min() == y.max():  # one class only: a constant
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), float(np.log(rate / (1 - rate))))
    w = _logistic(np.hstack([x, earlier, np.ones((len(y), 1))], dtype=np.float32, casting="same_kind"), y)
    n = len(chosen)
    return Linear(chosen, w[:n], w[n:-1], float(w[-1]))


def fit_chain(sample: Sample, chosen: dict[tuple[int, int], np.ndarray], names: tuple[str, ...] = CHAIN, folds: int = FOLDS) -> Chain:
    """chosen: the features of each (category, held-out fold), fold -1 holding nothing out."""
    chain, n = Chain(names), len(sample.fold)
    earlier = np.zeros((n, 0))
    for k in range(len(names)):
        y = sample.labels[:, k].astype(float)
        chain.models.append(_fit_one(sample.dense(chosen[k, -1]), y, earlier, chosen[k, -1]))
        held = np.zeros(n)
        for f in range(folds):
            train, test = np.flatnonzero(sample.fold != f), np.flatnonzero(sample.fold == f)
            if len(train) and len(test):
                x = sample.dense(chosen[k, f])
                m = _fit_one(x[train], y[train], earlier[train], chosen[k, f])
                held[test] = (x[test] @ m.weights if len(m.chosen) else 0) + earlier[test] @ m.chained + m.intercept
        earlier = np.hstack([earlier, np.clip(held, -12, 12)[:, None]])
    return chain


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, fold, low, toxic, features) of at most `sample` documents that have a label, one row a doc_id (of
    several texts of one id the least). Labels of one doc_id that disagree count as 1 for toxic and quality."""
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce("quality", F.lit(1))).alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    there = own.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    picked = materialize(there.orderBy("h", "doc_id").limit(sample), "sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality", "toxic", "h").agg(F.min("text").alias("text"))  # at most `sample` rows are broadcast
    rows = texts.select("doc_id", F.pmod(F.col("h"), F.lit(FOLDS)).cast("int").alias("fold"), (1 - F.col("quality").cast("int")).alias("low"), F.col("toxic").cast("int").alias("toxic"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, texts in chunks(b.column(0).to_pylist(), b.column(4).to_pylist(), lower=True):
                w = Words(texts, NON_WORD)
                f = features(w)
                out += [np.unique(f[w.first[i] : w.first[i + 1]]).astype(np.int32) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.list_(pa.int32()))], ["doc_id", "fold", "low", "toxic", "features"])

    return materialize(rows.mapInArrow(run, with_fields(docs, "doc_id", "fold int, low int, toxic int, features array<int>")), "features")


def _choose(rows: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """For each category and held-out fold (-1: none) the FEATURES features whose presence in the other folds is
    furthest from chance under the category, both ways: at most FEATURES * 3 * (FOLDS + 1) rows reach the driver."""
    category = [F.col("low"), F.col("toxic"), F.col("low") * F.col("toxic")]
    models = [(k, f) for k in range(len(CHAIN)) for f in range(-1, FOLDS)]
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"n{k}") for k, c in enumerate(category)]]
    totals = {r.fold: r for r in rows.groupBy("fold").agg(*sums).collect()}
    one = rows.select("fold", "low", "toxic", F.explode("features").alias("feature"))
    in_fold = [F.count_if(F.col("fold") == f).alias(f"f{f}") for f in range(FOLDS)]
    with_it = [F.sum(F.when(F.col("fold") == f, c).otherwise(0)).alias(f"f{f}_{k}") for f in range(FOLDS) for k, c in enumerate(category)]
    counts = one.groupBy("feature").agg(*in_fold, *with_it)
    scores = []
    for k, held in models:
        folds = [f for f in range(FOLDS) if f != held]
        n, hit = (sum(totals[f][c] for f in folds if f in totals) for c in ("n", f"n{k}"))
        rate = hit / n if n else 0.0
        total = sum((F.col(f"f{f}") for f in folds), F.lit(0))
        with_y = sum((F.col(f"f{f}_{k}") for f in folds), F.lit(0))
        scores.append(F.struct(F.lit(k).alias("k"), F.lit(held).alias("held"), (F.abs(with_y - total * rate) / F.sqrt(total * (rate * (1 - rate)) + 1)).alias("score")))
    best = Window.partitionBy("m.k", "m.held").orderBy(F.desc("m.score"), "feature")
    top = counts.select("feature", F.explode(F.array(*scores)).alias("m")).where("m.score > 2").withColumn("place", F.row_number().over(best)).where(F.col("place") <= FEATURES)
    found = top.select("m.k", "m.held", "feature").collect()
    return {m: np.array(sorted(r.feature for r in found if (r.k, r.held) == m), np.int64) for m in models}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """The chain over CHAIN from `labels` (doc_id, quality, toxic), on at most `sample` labelled documents.

    Null texts count as empty, null labels as harmless; without a label the models are constants."""
    rows = _sample(docs, labels, sample)
    chosen = _choose(rows)
    known = np.unique(np.concatenate([np.zeros(0, np.int64), *chosen.values()]))
    shared = docs.sparkSession.sparkContext.broadcast(known)  # bounded as in _choose

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(np.isin(shared.value, f.values.to_numpy(), assume_unique=True)).tobytes() for f in b.column(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(bits, pa.binary())], ["doc_id", "fold", "low", "toxic", "bits"])

    got = rows.mapInArrow(run, with_fields(docs, "doc_id", "fold int, low int, toxic int, bits binary")).toArrow().sort_by([("doc_id", "ascending")])
    low, toxic = got.column("low").to_numpy().clip(0, 1), got.column("toxic").to_numpy().clip(0, 1)
    bits = np.frombuffer(b"".join(got.column("bits").to_pylist()), np.uint8).reshape(got.num_rows, -(-len(known) // 8))
    shared.unpersist()
    return fit_chain(Sample(known, bits, np.stack([low, toxic, low & toxic], axis=1), got.column("fold").to_numpy()), chosen)


class Scorer:
    """Scores texts with a chain: features the models don't use drop out by one table look-up."""

    def __init__(self, chain: Chain) -> None:
        self.chain = chain
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *(m.chosen for m in chain.models)]))
        self.number = np.zeros(DIMENSIONS, np.int32)
        self.number[used] = np.arange(1, len(used) + 1)
        self.weights = np.stack([m.table()[used] for m in chain.models], axis=1)
        self.base = len(used) + 1

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """(texts, categories)."""
        out = [np.zeros((0, len(self.chain.models)))]
        for _, own in chunks(texts, texts, lower=True):
            w = Words(own, NON_WORD)
            hit = self.number[features(w)]
            at, _ = np.nonzero(hit)
            doc = np.searchsorted(w.first, at, side="right") - 1
            doc, which = np.divmod(np.unique(doc * np.int64(self.base) + hit[hit > 0]), self.base)
            sums = [np.bincount(doc, self.weights[which - 1, c], minlength=len(own)) if len(which) else np.zeros(len(own)) for c in range(self.weights.shape[1])]
            out.append(self.chain.predict(np.stack(sums, axis=1)).round(6))
        return np.concatenate(out)


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """(doc_id, low_quality, toxic_score, toxic_low_quality, toxic) for each row of docs; probabilities are
    rounded to six digits, toxic is true from `threshold` on. Null and empty texts have no feature and get the
    models' base rates. Repeated rows stay; further columns are not carried."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by FEATURES for each category
    names = ["doc_id", "low_quality", "toxic_score", "toxic_low_quality"]
    schema = with_fields(docs, "doc_id", ", ".join(f"{n} double" for n in names[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            p = scorer.probabilities(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, c]) for c in range(3))], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("toxic", F.col("toxic_score") >= threshold)


def reject_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose text the chain finds toxic; columns, null texts and clean rows stay. The
    decision is made row by row in one pass over the texts, with no join."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            keep = scorer.probabilities(b.column(text).to_pylist())[:, CHAIN.index("toxic")] < threshold
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
