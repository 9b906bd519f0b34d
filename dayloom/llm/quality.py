"""Quality scores by histogram gradient-boosted trees over statistics of a document.

A document is described by its lengths, shares of character classes, shapes of words and lines and
how much of it repeats. Trees are grown on binned statistics: a level's histograms of gradients
give the best cut of every node at once. They are stored flat, as complete binary trees in arrays,
so that a batch of documents goes down all of them by array lookups.
"""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.words import lots, word_hashes

#: What a document is described by, in this order.
STATISTICS = [
    "log_chars", "log_words", "log_lines", "letters", "digits", "sentence_marks", "symbols", "upper", "blanks", "non_ascii",
    "word_length", "word_spread", "words_per_line", "short_lines", "empty_lines", "distinct_words", "commonest_word", "adjacent_repeats",
    "repeated_pairs", "repeated_fives", "repeated_lines", "letterless_words", "marked_words", "marked_lines", "repeated_chars",
    "commonest_symbol", "entropy",
]
#: Bytes worked on at a time, which take about 150 bytes each.
LOT = 250_000
BINS = 64


def _classes() -> dict[str, np.ndarray]:
    """Per byte, whether it belongs to a class; the first byte of a non-ASCII character counts as a letter."""
    byte = np.arange(256)
    ascii_letter = ((byte | 32) >= ord("a")) & ((byte | 32) <= ord("z"))
    digit = (byte >= ord("0")) & (byte <= ord("9"))
    mark = np.isin(byte, list(b".,;:!?"))
    blank = byte <= 32
    return {
        "letter": ascii_letter | (byte >= 192),
        "ascii": ascii_letter,
        "upper": (byte >= ord("A")) & (byte <= ord("Z")),
        "digit": digit,
        "mark": mark,
        "symbol": ~(ascii_letter | digit | mark | blank | (byte >= 128)),
        "blank": blank,
        "wide": byte >= 192,
        "char": (byte < 128) | (byte >= 192),
    }


_CLASS = _classes()


def _repeated(owner: np.ndarray, items: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: how many items have occurred in it before, and how often its commonest one does."""
    again, most = np.zeros(n), np.zeros(n)
    if len(items):
        order = np.lexsort((items, owner))
        o, x = owner[order], items[order]
        starts = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (x[1:] != x[:-1])]))
        counts = np.diff(np.append(starts, len(o)))
        again = np.bincount(o[starts], counts - 1, minlength=n)
        np.maximum.at(most, o[starts], counts)
    return again, most


def _spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def statistics(texts: list[str]) -> np.ndarray:
    """A row of STATISTICS for every text; all are finite, also for an empty text."""
    if not texts:
        return np.zeros((0, len(STATISTICS)))
    n = len(texts)
    coded = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    stops = np.cumsum([len(c) + 1 for c in coded])
    owner = np.repeat(np.arange(n), np.diff(stops, prepend=0))
    own = np.ones(len(data), bool)
    own[stops - 1] = False  # The byte that ends a text isn't part of it.

    def per(where: np.ndarray, rows: np.ndarray = owner) -> np.ndarray:
        return np.bincount(rows, where, minlength=n).astype(float)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return part / np.maximum(whole, 1)

    chars = per(_CLASS["char"][data] & own)
    blanks = per(_CLASS["blank"][data] & own)
    letters = per(_CLASS["letter"][data])
    solid = chars - blanks

    # Words are runs without blanks here; lines end at a line feed or with the text.
    w0, w1 = _spans(~_CLASS["blank"][data])
    word_doc, size = owner[w0], (w1 - w0).astype(float)
    words = np.bincount(word_doc, minlength=n).astype(float)
    mean = share(np.bincount(word_doc, size, minlength=n), words)
    spread = np.sqrt(np.maximum(share(np.bincount(word_doc, size**2, minlength=n), words) - mean**2, 0))
    letters_before = np.concatenate([[0], np.cumsum(_CLASS["letter"][data])])
    bare = letters_before[w1] == letters_before[w0]
    marked = _CLASS["mark"][data[w1 - 1]] if len(w1) else np.zeros(0, bool)

    l1 = np.flatnonzero(data == 10)
    l0 = np.concatenate([[0], l1[:-1] + 1])
    line_doc, line_size = owner[l1], l1 - l0
    lines = np.bincount(line_doc, minlength=n).astype(float)
    words_before = np.concatenate([[0], np.cumsum(np.bincount(w0, minlength=len(data)))])
    line_words = words_before[l1] - words_before[l0]
    ends = np.where(line_size > 0, _CLASS["mark"][data[np.maximum(l1 - 1, 0)]], False)

    # Repeats are counted on hashed words in lower case.
    doc, hashed = word_hashes(texts)
    tokens = np.bincount(doc, minlength=n).astype(float)
    again, most = _repeated(doc, hashed, n)

    def grams(k: int) -> tuple[np.ndarray, np.ndarray]:
        m = max(len(hashed) - k + 1, 0)
        total = np.zeros(m, np.uint64)
        for j in range(k):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashed[j : j + m]
        whole = doc[:m] == doc[k - 1 :] if m else np.zeros(0, bool)
        return doc[:m][whole], total[whole]

    pair_doc, pairs = grams(2)
    five_doc, fives = grams(5)
    same = hashed[1:] == hashed[:-1]
    same &= doc[1:] == doc[:-1]
    line_hash = np.array([hash(bytes(data[a:b])) for a, b in zip(l0, l1, strict=True)], np.int64)
    full = line_size > 0
    line_again, _ = _repeated(line_doc[full], line_hash[full], n)

    counts = np.bincount(owner[own] * 256 + data[own], minlength=256 * n).reshape(n, 256).astype(float)
    portion = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    entropy = -(portion * np.log2(np.where(portion > 0, portion, 1))).sum(axis=1)
    doubled = np.zeros(len(data), bool)
    doubled[1:] = (data[1:] == data[:-1]) & (owner[1:] == owner[:-1]) & own[1:] & ~_CLASS["blank"][data[1:]]

    return np.column_stack([
        np.log1p(chars), np.log1p(words), np.log1p(lines), share(letters, solid), share(per(_CLASS["digit"][data]), solid),
        share(per(_CLASS["mark"][data]), solid), share(per(_CLASS["symbol"][data]), solid),
        share(per(_CLASS["upper"][data]), letters), share(blanks, chars), share(per(_CLASS["wide"][data]), chars),
        mean, spread, share(words, lines), share(per(line_words < 5, line_doc), lines), share(per(line_words == 0, line_doc), lines),
        1 - share(again, tokens), share(most, tokens), share(per(same, doc[1:]), tokens),
        share(_repeated(pair_doc, pairs, n)[0], tokens), share(_repeated(five_doc, fives, n)[0], tokens), share(line_again, lines),
        share(per(bare, word_doc), words), share(per(marked, word_doc), words), share(per(ends, line_doc), lines),
        share(per(doubled), solid), share((counts * _CLASS["symbol"]).max(axis=1, initial=0), solid), entropy,
    ])


@dataclass
class Trees:
    """Complete binary trees of one depth: a node's children are 2i + 1 and 2i + 2, a row per tree.

    A document goes right where its statistic is above the node's cut. A node that isn't cut sends
    all to the left. `value` belongs to the last level.
    """

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @property
    def depth(self) -> int:
        return self.value.shape[1].bit_length() - 1

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - (len(value) - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _bin_edges(column: np.ndarray) -> np.ndarray:
    """Cuts halfway between different values at evenly spaced ranks, BINS - 1 at most."""
    values = np.sort(column)
    at = np.unique(np.linspace(0, len(values) - 1, BINS + 1).astype(int)[1:-1])
    distinct = np.unique(values)
    lower = np.unique(values[at])
    upper = distinct[np.minimum(np.searchsorted(distinct, lower, side="right"), len(distinct) - 1)]
    return np.unique(((lower + upper) / 2)[lower < upper])


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, penalty: float = 1.0, least: int = 10) -> Trees:
    """Boost log loss: each tree is grown level by level on histograms of first and second derivatives.

    `least` is the smallest number of rows on either side of a cut. Equal gains go to the first
    statistic and the lowest cut, so the result is the same on every run.
    """
    n, width = x.shape
    prior = (y.sum() + 1) / (n + 2)
    inner, leaves = (1 << depth) - 1, 1 << depth
    model = Trees(float(np.log(prior / (1 - prior))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not 0 < y.sum() < n:
        return model
    edges = [_bin_edges(c) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    cuts = np.full((width, BINS), np.inf)
    for i, e in enumerate(edges):
        cuts[i, : len(e)] = e
    flat = binned + np.arange(width) * BINS
    margin = np.full(n, model.base)
    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        slope, curve = p - y, np.maximum(p * (1 - p), 1e-12)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            key = ((node - first)[:, None] * (width * BINS) + flat).ravel()

            def histogram(weight: np.ndarray | None, key: np.ndarray = key, nodes: int = nodes) -> np.ndarray:
                rows = None if weight is None else np.repeat(weight, width)
                return np.bincount(key, rows, minlength=nodes * width * BINS).reshape(nodes, width, BINS).cumsum(axis=2)

            g, h, m = histogram(slope), histogram(curve), histogram(None)
            total_g, total_h, total_m = g[:, :, -1:], h[:, :, -1:], m[:, :, -1:]
            gain = g**2 / (h + penalty) + (total_g - g) ** 2 / (total_h - h + penalty) - total_g**2 / (total_h + penalty)
            gain = np.where((m >= least) & (total_m - m >= least) & np.isfinite(cuts), np.round(gain, 9), 0).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            good = gain[np.arange(nodes), best] > 0
            feature[first : first + nodes][good] = best[good] // BINS
            cut[first : first + nodes][good] = cuts.ravel()[best[good]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, slope, minlength=leaves) / (np.bincount(leaf, curve, minlength=leaves) + penalty)
        margin += value[leaf]
        made.append((feature, cut, value))
    return Trees(model.base, *(np.array(part) for part in zip(*made, strict=True)))


def held_out(id: Column) -> Column:
    """Whether a row's label is kept from learning: the CRC-32 of its id as text leaves 1 by 3. A row without an id isn't."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _described(rows: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Columns `keep` and an array with the statistics of the text, in one pass."""

    def run(batches):
        for batch in batches:
            made = [statistics(lot) for lot in lots(batch.column(0).to_pylist(), LOT)]
            x = np.concatenate(made) if made else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(list(x), pa.list_(pa.float64()))], names=[*keep, "statistics"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.select(text, *keep).mapInArrow(run, ", ".join([*kinds, "statistics array<double>"]))


def _learned(docs: DataFrame, labels: DataFrame, label: str, id: str, text: str, sample: int) -> DataFrame:
    """(y, statistics) of at most `sample` labelled documents, those with the smallest hashes."""
    marks = labels.select(F.col(id).alias("id"), (F.col(label) > 0).cast("int").alias("y")).dropna()
    marks = marks.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").drop("other")
    # Ids are few bytes and labels are far fewer than documents, so the sample is drawn before texts move.
    at = (F.xxhash64("id").cast("double") + 2.0**63) / 2.0**64
    share = min(1.0, 1.1 * sample / max(marks.count(), 1))
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).filter(at <= share).join(marks.filter(at <= share), "id")
    drawn = _described(rows, "text", ["y"]).select("y", "statistics", F.xxhash64("statistics").alias("at"))
    return drawn.orderBy("at", "statistics", "y").limit(sample).drop("at")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text", sample: int = 20_000) -> Trees:
    """Trees for a 0/1 label, learned from at most `sample` labelled documents in one task.

    The sample is drawn by hashes of ids, then by hashes of statistics. Rows without an id or a
    label, and ids that are labelled both ways, teach nothing; a NULL text counts as empty. Other
    columns are ignored, whatever their names. Without labelled rows every score is 0.5.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        made = fit_trees(np.stack(group["statistics"]), group["y"].to_numpy(float))
        return pd.DataFrame({"base": [made.base], "feature": [made.feature.tobytes()], "cut": [made.cut.tobytes()], "value": [made.value.tobytes()], "trees": [len(made.value)]})

    kinds = "base double, feature binary, cut binary, value binary, trees int"
    made = _learned(docs, labels, label, id, text, sample).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, kinds).collect()
    if not made:
        return Trees(0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    row = made[0]
    shaped = [np.frombuffer(bytes(row[c]), kind).reshape(row["trees"], -1) for c, kind in (("feature", np.int64), ("cut", float), ("value", float))]
    return Trees(row["base"], *shaped)


def predict(docs: DataFrame, model: Trees, id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep..., score, predicted) for every row of `docs`, in one pass without a shuffle.

    A NULL text counts as empty and has a score too. Rows that repeat an id each have theirs. The
    columns `keep` come along; others are ignored, whatever their names.
    """
    columns = [id, *keep]

    def run(batches):
        for batch in batches:
            made = [model.score(statistics(lot)) for lot in lots(batch.column(0).to_pylist(), LOT)]
            score = np.concatenate(made) if made else np.zeros(0)
            predicted = pa.array((score >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), predicted], names=[*columns, "score", "predicted"])

    rows = docs.select(F.col(text).alias("__text"), *columns)
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]
    return rows.mapInArrow(run, ", ".join([*kinds, "score double, predicted int"]))
