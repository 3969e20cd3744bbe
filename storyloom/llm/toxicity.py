"""Toxicity by a classifier chain.

The categories are predicted one after the other. Each link is a logistic regression over
the words of a text (whole words and their first four and five letters, present or not) and
the probabilities of the links before it. For training, these probabilities come from models
that have not seen the row (out-of-fold; equal texts share a fold); for scoring, from the
link's final model.

The models are fitted in one task on a sample of labelled rows, bounded by ``SAMPLE_ROWS``
and chosen by the hash of ``doc_id``. All documents are scored, whole.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import by_doc, text_of

#: Upper bound of the rows that the models are fitted on.
SAMPLE_ROWS = 8_000
FOLDS = 4
MIN_DOCS = 3
#: A feature takes part if its likelihood ratio against the label (G squared) is at least this.
EVIDENCE = 20.0
RIDGE = 1e-4
STEPS = 150
THRESHOLD = 0.5
#: Links in order, each with the condition on a row of labels that makes it positive.
CHAIN = {"poor": "quality = 0", "toxic": "toxic = 1"}
_WORDS = re.compile(r"\w+")
_SAMPLE_UNITS = 1 << 30


def features_of(word: str) -> tuple[str, ...]:
    return (word, word[:4] + "*", word[:5] + "**") if len(word) > 3 else (word,)


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _evidence(hits, total, positive, n):
    """G squared of each feature's two-by-two table with the label."""

    def part(seen, size, share):
        return seen * np.log(np.maximum(seen, 1e-12) / np.maximum(size * share, 1e-12))

    p, out = positive / n, 0.0
    for size, seen in ((total, hits), (n - total, positive - hits)):
        out = out + part(seen, size, p) + part(size - seen, size, 1 - p)
    return 2 * out


def _fit(rows, cols, n, m, extra, y):
    """Weights, weights of the extra columns and intercept of a ridge logistic regression.

    Full-batch steps with per-coordinate scaling (AdaGrad); rows and cols are the places
    of the ones.
    """
    k = extra.shape[1]
    w, v, b = np.zeros(m), np.zeros(k), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    if not 0 < y.sum() < n:
        return w, v, b
    used = _evidence(np.bincount(cols, y[rows], m), np.bincount(cols, minlength=m), y.sum(), n) >= EVIDENCE
    mine = used[cols]
    rows, cols = rows[mine], (np.cumsum(used) - 1)[cols[mine]]
    full, w, m = w, np.zeros(used.sum()), int(used.sum())
    # both classes weigh the same
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    gw, gv, gb = np.full(m, 1e-12), np.full(k, 1e-12), 1e-12
    b = 0.0
    for _ in range(STEPS):
        r = (_sigmoid(np.bincount(rows, w[cols], n) + extra @ v + b) - y) * weight
        dw, dv, db = np.bincount(cols, r[rows], m) + RIDGE * w, extra.T @ r + RIDGE * v, r.sum()
        gw += dw * dw
        gv += dv * dv
        gb += db * db
        w -= 0.3 * dw / np.sqrt(gw)
        v -= 0.3 * dv / np.sqrt(gv)
        b -= 0.3 * db / np.sqrt(gb)
    full[used] = w
    return full, v, b


def fit_chain(texts: list[str], labels: np.ndarray, folds: np.ndarray) -> pd.DataFrame:
    """``(link, feature, weight)``; the intercept is feature ``' b'``, the link before ``j`` is ``' j'``."""
    counts: dict[str, int] = {}
    bags = []
    for t in texts:
        bag = {f for w in words_of(t) for f in features_of(w)}
        bags.append(bag)
        for f in bag:
            counts[f] = counts.get(f, 0) + 1
    names = sorted(f for f, c in counts.items() if c >= MIN_DOCS)
    at = {f: i for i, f in enumerate(names)}
    places = [[at[f] for f in bag if f in at] for bag in bags]
    n, m = len(texts), len(names)
    rows = np.repeat(np.arange(n), [len(p) for p in places])
    cols = np.fromiter((c for p in places for c in sorted(p)), np.int64, len(rows))
    out, held = [], np.zeros((n, 0))
    for link in range(labels.shape[1]):
        y = labels[:, link].astype(float)
        w, v, b = _fit(rows, cols, n, m, held, y)
        keep = np.flatnonzero(np.abs(w) > 1e-6)
        out.append(pd.DataFrame({"link": link, "feature": [names[i] for i in keep], "weight": w[keep]}))
        out.append(pd.DataFrame({"link": link, "feature": [f" {j}" for j in range(link)] + [" b"], "weight": [*v, b]}))
        if link + 1 == labels.shape[1]:
            break
        unseen = np.zeros(n)
        for f in np.unique(folds):
            train = np.flatnonzero(folds != f)
            if not len(train):
                continue
            back = np.full(n, -1)
            back[train] = np.arange(len(train))
            own = back[rows] >= 0
            w, v, b = _fit(back[rows[own]], cols[own], len(train), m, held[train], y[train])
            p = _sigmoid(np.bincount(rows, w[cols], n) + held @ v + b)
            unseen[folds == f] = p[folds == f]
        held = np.column_stack([held, unseen])
    return pd.concat(out)


def train(docs: DataFrame, labels: DataFrame, chain: dict[str, str] = CHAIN, sample_rows: int = SAMPLE_ROWS) -> list[dict[str, float]]:
    """The chain's models, as one mapping of features to weights per link.

    Labelled rows with a null label or a null doc_id do not count; rows that repeat a doc_id
    count once. Without labelled documents every probability is one half at most.
    """
    known = labels.select("doc_id", *[F.expr(c).cast("int").alias(f"_y{i}") for i, c in enumerate(chain.values())]).dropna()
    known = known.groupBy("doc_id").agg(*[F.max(f"_y{i}").alias(f"_y{i}") for i in range(len(chain))])
    share = min(1.0, sample_rows / max(1, known.count()))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(_SAMPLE_UNITS)) < int(share * _SAMPLE_UNITS)
    # the sample is cut on both sides before anything is moved
    rows = docs.select("doc_id", text_of().alias("text")).filter(chosen).join(known.filter(chosen), "doc_id")
    n = len(chain)
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("_fold")
    rows = rows.dropDuplicates(["doc_id"]).select(F.lit(0).alias("_g"), "text", fold, *[f"_y{i}" for i in range(n)])

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["text"], kind="stable")
        return fit_chain(g["text"].tolist(), g[[f"_y{i}" for i in range(n)]].to_numpy(), g["_fold"].to_numpy())

    models: list[dict[str, float]] = [{} for _ in range(n)]
    for r in rows.groupBy("_g").applyInPandas(fit, "link int, feature string, weight double").collect():
        models[r.link][r.feature] = r.weight
    return models


def score(docs: DataFrame, models: list[dict[str, float]], chain: dict[str, str] = CHAIN, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, p_<link> ..., rejected)`` per row of ``docs``; rejected by the last link.

    A text without words (null, empty) has the intercepts' probabilities and is never
    rejected. Extra columns are not used; an empty table gives an empty result.
    """
    names = sorted({f for m in models for f in m if f[:1] != " "})
    at = {f: i for i, f in enumerate(names)}
    weights = np.array([[m.get(f, 0.0) for f in names] for m in models]).reshape(len(models), -1)
    links = [([m.get(f" {j}", 0.0) for j in range(i)], m.get(" b", 0.0)) for i, m in enumerate(models)]
    shared = docs.sparkSession.sparkContext.broadcast((at, weights, links))
    kind = docs.schema["doc_id"].dataType.simpleString()

    class Known(dict):
        def __missing__(self, word):
            found = tuple(i for i in map(shared.value[0].get, features_of(word)) if i is not None)
            if len(self) < 500_000:  # a cache, not a vocabulary
                self[word] = found
            return found

    def run(batches):
        cache = Known()
        _, held, steps = shared.value
        for b in batches:
            sums, empty = [], []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                ids = np.fromiter(set().union(*map(cache.__getitem__, words)), np.int64)
                sums.append(held[:, ids].sum(axis=1))
                empty.append(not words)
            total = np.array(sums).reshape(-1, len(steps))
            p: list[np.ndarray] = []
            for i, (before, bias) in enumerate(steps):
                p.append(_sigmoid(total[:, i] + sum((w * q for w, q in zip(before, p, strict=True)), np.zeros(len(total))) + bias))
            rejected = (p[-1] > threshold) & ~np.array(empty, bool)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, p), pa.array(rejected)], names=["doc_id", *[f"p_{c}" for c in chain], "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'p_{c} double' for c in chain)}, rejected boolean")


def keep_clean(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents; columns stay as they are."""
    return by_doc(docs, judged.filter("rejected").select("doc_id").distinct(), "left_anti")
