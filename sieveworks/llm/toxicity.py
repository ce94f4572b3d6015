"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before it."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.store import write_table

#: Labelled documents that the models are fitted on at most (in expectation) for each combination of labels.
TRAIN_DOCS = 500
FOLDS = 5
#: Features of one category: those whose share differs between its classes by so many standard errors, most first.
LEAST_Z, FEATURES = 3.5, 2000
STEPS, RATE, PENALTY = 400, 0.05, 1e-4
KEPT_TOKENS = 250_000
#: Rows of an id and labels that are sent to all executors; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]{2,}|[|]")


def features_of(token: str) -> tuple[str, ...]:
    """A word and its first letters; a run of signs as it is."""
    return (token, f"{token[:4]}-", f"{token[:5]}-") if token[0].isalpha() and len(token) >= 5 else (token,)


def document_features(text: str | None) -> set[str]:
    return {f for t in set(_TOKEN.findall(text.lower())) for f in features_of(t)} if text else set()


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Adam on the whole sample, classes weighted alike; the last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    share = max(1e-9, min(1 - 1e-9, y.mean()))
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * weight) + PENALTY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


class Chain:
    """One linear model for each category, in order. weights: feature -> weight; earlier: weight of each category before."""

    def __init__(self, categories: list[str], links: list[tuple[dict[str, float], list[float], float]]):
        self.categories, self.links = categories, links
        #: Features of tokens seen before that some link knows; serves all tasks of a Python worker.
        self.kept: dict[str, tuple[str, ...]] = {}
        names = {f for weights, _, _ in links for f in weights}
        self.table = {f: np.array([weights.get(f, 0.0) for weights, _, _ in links]) for f in names}

    def __call__(self, found: set[str]) -> list[float]:
        """The probability of each category for a document with these features."""
        sums, table = np.zeros(len(self.links)), self.table
        for f in sorted(found):  # in one order, so that sums agree between runs
            if (w := table.get(f)) is not None:
                sums += w
        probabilities: list[float] = []
        for i, (_, earlier, constant) in enumerate(self.links):
            z = sums[i] + constant + sum(a * b for a, b in zip(earlier, probabilities, strict=True))
            probabilities.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return probabilities


def _associated(found: list[set[str]], y: np.ndarray) -> list[str]:
    """The features that tell the labels of these documents apart best."""
    counts: dict[str, list[int]] = {}
    for own, label in zip(found, y.astype(int).tolist(), strict=True):
        for f in own:
            counts.setdefault(f, [0, 0])[label] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    scored = []
    for f, (c0, c1) in counts.items():
        p = (c0 + c1 + 1) / (len(y) + 2)
        z = abs(c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        if z >= LEAST_Z:
            scored.append((-z, f))
    return [f for _, f in sorted(scored)[:FEATURES]]


def _inputs(found: list[set[str]], names: list[str], earlier: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 by feature for each document, and the probabilities of the links before."""
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(found), len(names)), np.float32)
    for i, own in enumerate(found):
        x[i, [place[f] for f in own if f in place]] = 1
    return np.concatenate([x, earlier.astype(np.float32)], 1)


def _outside(found: list[set[str]], y: np.ndarray, folds: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Each document's probability by a model whose features and weights come from the other folds alone."""
    out = np.zeros(len(y))
    for fold in range(FOLDS):
        test = folds == fold
        train = y[~test]
        if not test.any():
            continue
        if len(train) == 0 or train.min() == train.max():
            out[test] = train.mean() if len(train) else 0.5
            continue
        kept = [own for own, t in zip(found, test.tolist(), strict=True) if not t]
        names = _associated(kept, train)
        w = _fit(_inputs(kept, names, earlier[~test]), train)
        x = _inputs([own for own, t in zip(found, test.tolist(), strict=True) if t], names, earlier[test])
        out[test] = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
    return out


def fit_chain(documents: list[tuple[int, set[str], tuple[int, ...]]], categories: list[str]) -> Chain:
    """documents: (fold, features, label of each category). Later links are trained on out-of-fold probabilities of the
    earlier ones, as they meet unseen documents when used. Without documents every probability is that of weight 0."""
    folds, found = np.array([d[0] for d in documents]), [d[1] for d in documents]
    labels = np.array([d[2] for d in documents], float).reshape(len(documents), len(categories))
    links, earlier = [], np.zeros((len(documents), 0))
    for k in range(len(categories)):
        y = labels[:, k]
        if len(y) == 0 or y.min() == y.max():
            links.append(({}, [0.0] * k, 0.0 if len(y) == 0 else float(6 * (2 * y[0] - 1))))
            earlier = np.concatenate([earlier, np.full((len(documents), 1), y[0] if len(y) else 0.5)], 1)
            continue
        names = _associated(found, y)
        w = _fit(_inputs(found, names, earlier), y)
        links.append((dict(zip(names, w[: len(names)].tolist(), strict=True)), w[len(names) : -1].tolist(), float(w[-1])))
        if k + 1 < len(categories):
            earlier = np.concatenate([earlier, _outside(found, y, folds, earlier)[:, None]], 1)
    return Chain(categories, links)


def train_chain(docs: DataFrame, labels: DataFrame, categories: list[str], train_docs: int = TRAIN_DOCS) -> Chain:
    """docs: doc_id, text. labels: doc_id and a 0/1 column for each category; rows with a null in any are left out, of
    repeated ids the largest labels hold. Fitted on a sample by a hash of the id, about train_docs for each combination."""
    known = labels.where(" AND ".join(f"`{c}` IS NOT NULL" for c in ["doc_id", *categories]))
    known = known.groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(c) for c in categories])
    steps, share = 1 << 20, F.lit(0)
    for row in known.groupBy(*categories).count().collect():
        same = F.lit(True)
        for c in categories:
            same = same & (F.col(c) == row[c])
        share = F.when(same, int(min(1.0, train_docs / row["count"]) * steps)).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(steps)) < share)
    chosen = write_table(chosen, "toxicity-sample")
    small = chosen.count() <= BROADCAST_ROWS
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen) if small else chosen, "doc_id")
    rows = rows.select("doc_id", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int").alias("fold"), "text", *categories)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(document_features(t)) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.list_(pa.string())), *b.columns[3:]], ["doc_id", "fold", "found", *categories])

    schema = f"doc_id {docs.select('doc_id').dtypes[0][1]}, fold int, found array<string>, " + ", ".join(f"`{c}` int" for c in categories)
    sample = rows.mapInArrow(describe, schema).toArrow().sort_by("doc_id")
    labelled = zip(sample["fold"].to_pylist(), sample["found"], *(sample[c].to_pylist() for c in categories), strict=True)
    return fit_chain([(fold, set(map(sys.intern, found.as_py())), tuple(label)) for fold, found, *label in labelled], categories)


def score_documents(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs (doc_id, text) with p_<category>, a row for each row. Null and empty texts have no features, so they get the
    chain's constants. No shuffle; tokens that no model knows are passed over."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kept = sent.value, sent.value.kept
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found: set[str] = set()
                for token in set(_TOKEN.findall(text.lower())) if text else ():
                    own = kept.get(token)
                    if own is None:
                        if len(kept) > KEPT_TOKENS:
                            kept.clear()
                        own = kept[token] = tuple(f for f in features_of(token) if f in model.table)
                    if own:
                        found.update(own)
                out.append(model(found))
            columns = [pa.array(c, pa.float64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.float64()) for _ in names]
            yield pa.record_batch([batch.column(0), *columns], ["doc_id", *names])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(score, f"doc_id {rows.dtypes[0][1]}, " + ", ".join(f"`{n}` double" for n in names))
