"""Toxicity by a classifier chain of logistic models.

The chain goes through label columns in order. The model of a category sees the text's features
and the probabilities of the categories before it. Those must be as uncertain in training as they
are later, so each earlier model is fitted once per fold and predicts the rows it has not seen;
these out-of-fold predictions are what the later model learns from. Features are words and the
character n-grams of words, hashed, and chosen by how unevenly they occur over the labels.
"""

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.words import lots, mix, word_hashes

#: Hashed feature places; a place is a chosen feature or nothing.
PLACES = 1 << 21
GRAMS = (3, 4, 5, 6)
#: Characters worked on at a time, which take about 300 bytes each.
LOT = 250_000


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, place) of every n-gram of GRAMS that holds no space but for its first or last character."""
    low = [t.lower() for t in texts]
    data = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le"), np.uint32)
    ends = np.zeros(len(data), np.int64)
    ends[np.cumsum([len(t) + 1 for t in low])] = 1
    owner = np.minimum(np.cumsum(ends) - ends, len(texts) - 1)
    blank = data <= 32
    blanks = np.concatenate([[0], np.cumsum(blank)])
    chars = np.where(blank, 32, data).astype(np.uint64)
    docs, places, total = [], [], np.zeros(len(chars), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        size = len(chars) - n + 1
        if size <= 0:
            break
        total = total[:size] * np.uint64(0x100000001B3) + chars[n - 1 :]
        if n in GRAMS:
            whole = (blanks[n - 1 : n - 1 + size] - blanks[1 : 1 + size] == 0) & (owner[:size] == owner[n - 1 :])
            docs.append(owner[:size][whole])
            places.append((mix(total[whole] * np.uint64(31) + np.uint64(n)) & np.uint64(PLACES - 1)).astype(np.int64))
    return np.concatenate(docs) if docs else np.zeros(0, np.int64), np.concatenate(places) if places else np.zeros(0, np.int64)


def _features(texts: list[str], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, feature, value), one entry for each feature a document has.

    Without `chosen` features are places; with it, a table from places to columns (-1: left out).
    A word's value is log(1 + count), an n-gram's log(1 + count per 1,000 characters).
    """
    word_doc, words = word_hashes(texts)
    gram_doc, grams = _grams(texts)
    doc = np.concatenate([word_doc, gram_doc])
    place = np.concatenate([(mix(words ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(PLACES - 1)).astype(np.int64), grams])
    scale = np.concatenate([np.ones(len(word_doc)), 1000.0 / np.array([max(len(t), 1) for t in texts])[gram_doc]]) if len(doc) else np.zeros(0)
    if chosen is not None:
        place = chosen[place]
        kept = place >= 0
        doc, place, scale = doc[kept], place[kept], scale[kept]
    key, first, count = np.unique(doc * PLACES + place, return_index=True, return_counts=True)
    return key // PLACES, key % PLACES, np.log1p(count * scale[first]).astype(np.float32)


@dataclass
class _Rows:
    """A sparse matrix by rows."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], minlength=self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], minlength=self.shape[1])

    def subset(self, keep: np.ndarray) -> "_Rows":
        new = np.cumsum(keep) - 1
        here = keep[self.row]
        return _Rows(new[self.row[here]], self.column[here], self.value[here], (int(keep.sum()), self.shape[1]))


@dataclass
class Linear:
    """A logistic model: weights of the features, of the earlier probabilities, and a constant."""

    weights: np.ndarray
    earlier: np.ndarray
    constant: float

    def probability(self, x: _Rows, before: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(x.dot(self.weights) + before @ self.earlier + self.constant, -30, 30)))


def fit_logistic(x: _Rows, before: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 100) -> Linear:
    """Least penalised log loss, by quasi-Newton steps from the last ten gradients."""
    d, k = x.shape[1], before.shape[1]

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.dot(p[:d]) + before @ p[d : d + k] + p[-1]
        r = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y
        value = np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty * (p[:-1] @ p[:-1])
        return value, np.concatenate([x.back(r) + penalty * p[:d], before.T @ r + penalty * p[d : d + k], [r.sum()]])

    p = np.zeros(d + k + 1)
    value, slope = loss(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, used = slope.copy(), []
        for s, g in reversed(past):
            a = (s @ step) / (s @ g)
            used.append(a)
            step -= a * g
        if past:
            s, g = past[-1]
            step *= (s @ g) / (g @ g)
        else:
            step /= max(1.0, np.linalg.norm(slope))
        for (s, g), a in zip(past, reversed(used), strict=True):
            step += s * (a - (g @ step) / (s @ g))
        size = 1.0
        while True:
            new_value, new_slope = loss(p - size * step)
            if new_value <= value - 1e-4 * size * (slope @ step) or size < 1e-8:
                break
            size /= 2
        moved, turned = -size * step, new_slope - slope
        if moved @ turned > 1e-12:
            past = [*past[-9:], (moved, turned)]
        p, done = p + moved, value - new_value < 1e-6 * max(1.0, abs(value))
        value, slope = new_value, new_slope
        if done:
            break
    return Linear(p[:d], p[d : d + k], float(p[-1]))


@dataclass
class ChainModel:
    """One linear model per category, in the chain's order, and the probability from which it counts."""

    categories: list[str]
    models: list[Linear]
    thresholds: list[float]
    chosen: np.ndarray = field(repr=False)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """A column for each category of the chain."""
        doc, column, value = _features(texts, self.chosen)
        x = _Rows(doc, column, value, (len(texts), int(self.chosen.max(initial=-1)) + 1))
        out = np.zeros((len(texts), 0))
        for model in self.models:
            out = np.column_stack([out, model.probability(x, out)])
        return out


def _choose(texts: list[str], labels: np.ndarray, most: int, least: int = 3) -> np.ndarray:
    """A table from places to columns: the `most` places whose values differ most over some label, by z score.

    The texts' features are summed lot by lot and not kept.
    """
    n, at = len(labels), 0
    seen, square = np.zeros(PLACES), np.zeros(PLACES)
    total, inside = np.zeros(PLACES), np.zeros((labels.shape[1], PLACES))
    for lot in lots(texts, LOT):
        doc, place, value = _features(lot)
        marks = labels[at : at + len(lot)]
        at += len(lot)
        seen += np.bincount(place, minlength=PLACES)
        total += np.bincount(place, value, minlength=PLACES)
        square += np.bincount(place, value**2, minlength=PLACES)
        for i, y in enumerate(marks.T):
            inside[i] += np.bincount(place, value * y[doc], minlength=PLACES)
    spread = np.sqrt(np.maximum(square / n - (total / n) ** 2, 1e-12))
    score = np.zeros(PLACES)
    for i, y in enumerate(labels.T):
        if 0 < y.sum() < n:
            gap = inside[i] / y.sum() - (total - inside[i]) / (n - y.sum())
            score = np.maximum(score, np.abs(gap) / spread * np.sqrt(y.sum() * (n - y.sum()) / n))
    score[seen < least] = 0
    best = np.argsort(-score, kind="stable")[:most]
    best = np.sort(best[score[best] > 0])
    table = np.full(PLACES, -1, np.int32)
    table[best] = np.arange(len(best))
    return table


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability cut with the best F1, halfway to the next lower one."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    at = int(np.argmax(f1))
    after = p[order[at + 1]] if at + 1 < len(y) else 0.0
    return float((p[order[at]] + after) / 2)


def fit_chain(texts: list[str], labels: np.ndarray, categories: Sequence[str], folds: int = 4, features: int = 6000) -> ChainModel:
    """Fit the chain on labelled texts; `labels` has a 0/1 column per category."""
    table = _choose(texts, labels, features)
    parts, at = [], 0
    for lot in lots(texts, LOT):
        doc, column, value = _features(lot, table)
        parts.append((doc + at, column, value))
        at += len(lot)
    doc, column, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    x = _Rows(doc, column, value, (len(texts), int(table.max(initial=-1)) + 1))
    # Copies of a text share a fold, so none is predicted by a model that has seen it.
    fold = pd.util.hash_array(np.array(texts, dtype=object), categorize=False) % folds
    before, models, thresholds = np.zeros((len(texts), 0)), [], []
    for y in labels.T.astype(float):
        unseen = np.zeros(len(texts))
        for f in range(folds):
            test = fold == f
            if test.any() and not test.all():
                part = fit_logistic(x.subset(~test), before[~test], y[~test])
                unseen[test] = part.probability(x.subset(test), before[test])
        models.append(fit_logistic(x, before, y))
        thresholds.append(_best_threshold(unseen, y))
        before = np.column_stack([before, unseen])
    return ChainModel(list(categories), models, thresholds, table)


def _pack(model: ChainModel) -> dict[str, bytes]:
    places = np.flatnonzero(model.chosen >= 0)
    weights = np.column_stack([m.weights for m in model.models]) if model.models else np.zeros((len(places), 0))
    heads = [np.concatenate([m.earlier, np.zeros(len(model.models) - len(m.earlier)), [m.constant, t]]) for m, t in zip(model.models, model.thresholds, strict=True)]
    return {"places": places.astype(np.int64).tobytes(), "weights": weights.astype(np.float64).tobytes(), "heads": np.array(heads).tobytes()}


def _unpack(places: bytes, weights: bytes, heads: bytes, categories: Sequence[str]) -> ChainModel:
    n = len(categories)
    where = np.frombuffer(places, np.int64)
    chosen = np.full(PLACES, -1, np.int32)
    chosen[where] = np.arange(len(where))
    w, h = np.frombuffer(weights).reshape(-1, n), np.frombuffer(heads).reshape(n, n + 2)
    models = [Linear(w[:, i], h[i, :i], float(h[i, n])) for i in range(n)]
    return ChainModel(list(categories), models, [float(x) for x in h[:, n + 1]], chosen)


def learned_rows(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("quality", "toxic"), id: str = "doc_id", text: str = "text", sample: int = 8000) -> DataFrame:
    """(id, text, y0, y1, ...): at most `sample` labelled documents, drawn by hashed ids and then by hashed ids and texts."""
    columns = [f"y{i}" for i in range(len(categories))]
    marks = labels.select(F.col(id).alias("id"), *[(F.col(c) > 0).cast("int").alias(y) for c, y in zip(categories, columns, strict=True)]).dropna()
    same = " and ".join(f"{y} = other_{y}" for y in columns)
    marks = marks.groupBy("id").agg(*[F.min(y).alias(y) for y in columns], *[F.max(y).alias(f"other_{y}") for y in columns]).filter(same).select("id", *columns)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).dropna()
    # Ids are few bytes and labels are far fewer than documents, so the sample is drawn before texts move.
    at = (F.xxhash64("id").cast("double") + 2.0**63) / 2.0**64
    share = min(1.0, 1.1 * sample / max(marks.count(), 1))
    drawn = rows.filter(at <= share).join(marks.filter(at <= share), "id").withColumn("at", F.xxhash64("id", "text"))
    return drawn.orderBy("at", "id", "text").limit(sample).drop("at")


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("quality", "toxic"), id: str = "doc_id", text: str = "text", sample: int = 8000) -> ChainModel | None:
    """The chain for 0/1 label columns, from a sample of at most `sample` labelled documents.

    One task fits the models on it. Rows with a NULL among text and labels are not learned from,
    nor are ids that the labels mark in different ways; other columns of both tables are ignored.
    None if no row is left.
    """
    columns = [f"y{i}" for i in range(len(categories))]
    learned = learned_rows(docs, labels, categories, id, text, sample).withColumn("all", F.lit(0))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "text", *columns])
        model = fit_chain(list(group["text"]), group[columns].to_numpy() > 0, categories)
        return pd.DataFrame({k: [v] for k, v in _pack(model).items()})

    made = learned.groupBy("all").applyInPandas(run, "places binary, weights binary, heads binary").collect()
    return _unpack(bytes(made[0]["places"]), bytes(made[0]["weights"]), bytes(made[0]["heads"]), categories) if made else None


def predict(docs: DataFrame, model: ChainModel | None, id: str = "doc_id", text: str = "text", categories: Sequence[str] = ("quality", "toxic")) -> DataFrame:
    """(id, p_<category>, is_<category>) for every row of `docs`, in one pass without a shuffle.

    NULL counts as empty. Without a model all probabilities of `categories` are NULL and nothing is marked.
    Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id).alias(id), F.col(text).alias("__text"))
    if model is None:
        nothing = [F.lit(None).cast("double").alias(f"p_{c}") for c in categories] + [F.lit(False).alias(f"is_{c}") for c in categories]
        return rows.select(id, *nothing)
    sent, n = docs.sparkSession.sparkContext.broadcast((_pack(model), model.categories)), len(model.categories)

    def run(batches):
        packed, categories = sent.value
        chain = _unpack(**packed, categories=categories)
        for batch in batches:
            made = [chain.probabilities(lot) for lot in lots(batch.column(1).to_pylist(), LOT)]
            p = np.concatenate(made) if made else np.zeros((0, n))
            marks = [pa.array(p[:, i] >= chain.thresholds[i]) for i in range(n)]
            names = [id, *[f"p_{c}" for c in categories], *[f"is_{c}" for c in categories]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, i]) for i in range(n)], *marks], names=names)

    kinds = [f"`p_{c}` double" for c in model.categories] + [f"`is_{c}` boolean" for c in model.categories]
    return rows.mapInArrow(run, ", ".join([f"`{id}` {docs.schema[id].dataType.simpleString()}", *kinds]))
