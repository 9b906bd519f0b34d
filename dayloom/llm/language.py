"""Language identification by nearest centroid over TF-IDF n-gram vectors.

Texts become vectors of hashed character n-grams (one to three letters, spaces between words),
log(1 + count) times inverse document frequency, at length one. Every language has several
centroids, from clustering a sample of its texts by cosine. A text gets the language of the
nearest centroid, and is rejected when it is farther from it than nearly all labelled texts of that
language that are nearest to the same centroid.
"""

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.words import gives_back, lots, mix, values

DIMENSIONS = 4096
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def gram_counts(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row of n-gram counts for each text. Anything but letters is a space; runs of spaces are one."""
    low = [t.lower() for t in texts]
    data = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le"), np.uint32)
    letter = _letters()[data]
    # A text ends with the line break behind it.
    ends = np.zeros(len(data), np.int64)
    ends[np.cumsum([len(t) + 1 for t in low])] = 1
    owner = np.minimum(np.cumsum(ends) - ends, len(texts) - 1)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = False
    chars, owner = np.where(letter, data, 32)[kept].astype(np.uint64), owner[kept]
    out = np.zeros(len(texts) * dimensions, np.int64)
    total = np.zeros(len(chars), np.uint64)
    for n in range(1, 4):
        size = len(chars) - n + 1
        if size <= 0:
            break
        total = total[:size] * np.uint64(0x100000001B3) + chars[n - 1 :]
        same = (owner[:size] == owner[n - 1 :]) & ((chars[:size] != 32) | (n > 1))
        bucket = (mix(total[same] + np.uint64(n)) & np.uint64(dimensions - 1)).astype(np.int64)
        out += np.bincount(owner[:size][same] * dimensions + bucket, minlength=len(out))
    return out.reshape(len(texts), dimensions)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    raw = np.log1p(counts) * idf
    norm = np.linalg.norm(raw, axis=1, keepdims=True)
    return (raw / np.where(norm > 0, norm, 1)).astype(np.float32)


def _small_lots(texts: Iterable[str | None], rows: int = 256):
    for lot in lots(texts, 1_000_000):
        for i in range(0, len(lot), rows):
            yield lot[i : i + rows]


def cluster(vectors: np.ndarray, k: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(centroids of length one, for each vector its centroid) by spherical k-means.

    It starts from vectors at even steps in the order of their cosine to the mean.
    """
    order = np.argsort(vectors @ vectors.mean(axis=0), kind="stable")
    k = min(k, len(vectors))
    chosen = order[[(2 * i + 1) * len(vectors) // (2 * k) for i in range(k)]]
    centroids = vectors[chosen]
    for _ in range(rounds):
        member = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.array([vectors[member == i].sum(axis=0) if (member == i).any() else centroids[i] for i in range(len(centroids))])
        new = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        if np.allclose(new, centroids, atol=1e-6):
            break
        centroids = new
    return centroids, np.argmax(vectors @ centroids.T, axis=1)


@dataclass
class LanguageModel:
    """`languages`, `centroids` and `radii` have an entry per centroid; `idf` one per dimension."""

    languages: list[str]
    centroids: np.ndarray
    radii: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) for texts with a letter."""
        counts = gram_counts(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = _vectors(counts, self.idf) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0).astype(float)
        # A few letters lie far from everything, so distance says nothing about them.
        telling = (counts > 0).sum(axis=1) >= MIN_GRAMS
        return [self.languages[i] for i in best], score, telling & (1.0 - score > self.radii[best])


#: Texts with fewer distinct n-grams are not rejected for their distance.
MIN_GRAMS = 60
#: A centroid's radius is the distance within which this share of its labelled texts lie, and SLACK more.
WITHIN, SLACK = 0.999, 0.08
#: Distances are counted in steps of one over this.
STEPS = 1000


def _within(counts: np.ndarray) -> float:
    """The distance within which a share of WITHIN lies, from counts per step."""
    return float(np.searchsorted(np.cumsum(counts), WITHIN * counts.sum()) + 1) / STEPS


def _radii(rows: DataFrame, languages: list[str], centroids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A radius per centroid from all `rows` (text, lang) whose nearest centroid is of their language.

    Only texts that can be rejected count, those with MIN_GRAMS n-grams. A centroid without such
    texts takes the radius of its language, and a language without them that of its short texts.
    """
    sent = rows.sparkSession.sparkContext.broadcast((languages, centroids, idf))
    shape = (len(languages), 2, STEPS + 1)

    @gives_back
    def count(batches):
        names, centers, weights = sent.value
        names, total = np.array(names, dtype=object), np.zeros(np.prod(shape), np.int64)
        for batch in batches:
            langs, at = np.array(batch.column(1).to_pylist(), dtype=object), 0
            for lot in _small_lots(values(batch.column(0))):
                grams = gram_counts(lot)
                cosine = _vectors(grams, weights) @ centers.T
                best = np.argmax(cosine, axis=1)
                step = (np.clip(1.0 - cosine[np.arange(len(lot)), best], 0.0, 1.0) * STEPS).astype(np.int64)
                telling = ((grams > 0).sum(axis=1) >= MIN_GRAMS).astype(np.int64)
                own = names[best] == langs[at : at + len(lot)]
                at += len(lot)
                total += np.bincount(np.ravel_multi_index((best[own], telling[own], step[own]), shape), minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], names=["cell", "n"])

    # At most 2,002 cells per centroid come to the driver.
    counted = rows.select("text", "lang").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(np.prod(shape), np.int64)
    for r in counted:
        counts[r["cell"]] = r["n"]
    counts = counts.reshape(shape)
    radii = []
    for i, name in enumerate(languages):
        whole = counts[[x == name for x in languages]].sum(axis=0)
        radii.append(_within(next((c for c in (counts[i, 1], whole[1], whole[0]) if c.any()), whole[0])))
    return np.array(radii) + SLACK


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", per_language: int = 1500, clusters: int = 4) -> LanguageModel:
    """Learn from all rows of `docs` that have a language and a letter.

    Document frequencies count all these rows. Centroids come from a sample of about
    `per_language` texts of each language (those whose hashed ids and texts are lowest), so one
    task clusters that many. Radii come from all rows again. The model has `clusters` times 16 KB
    per language.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(id), F.col(text)).alias("at"))
    rows = rows.filter(F.col("lang").isNotNull() & has_letter(F.col("text")))

    @gives_back
    def frequencies(batches):
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for lot in _small_lots(values(batch.column(0))):
                total += (gram_counts(lot) > 0).sum(axis=0)
                n += len(lot)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, DIMENSIONS), pa.int32()), pa.array([n, *total], pa.int64())], names=["bucket", "n"])

    counted = rows.select("text").mapInArrow(frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = {r["bucket"]: r["n"] for r in counted}
    idf = np.log((1 + found.get(-1, 0)) / (1 + np.array([found.get(b, 0) for b in range(DIMENSIONS)]))) + 1.0

    # A count per language, fewer than the centroids that follow, decides the share of its texts.
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    wanted = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["n"]))]) if sizes else None
    low = (F.col("at").cast("double") + 2.0**63) / 2.0**64
    # Hashes are spread evenly, so the rows below the share are about as many as wanted.
    share = F.try_element_at(wanted, F.col("lang")) if sizes else F.lit(0.0)
    sample = rows.filter(low <= share).select("lang", "text", "at")

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        texts = list(group.sort_values(["at", "text"])["text"])
        vectors = np.concatenate([_vectors(gram_counts(lot), idf) for lot in _small_lots(texts)])
        made, _ = cluster(vectors, clusters)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [c.tobytes() for c in made]})

    made = sample.groupBy("lang").applyInPandas(centroids, "lang string, centroid binary").collect()
    made.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    languages = [r["lang"] for r in made]
    centers = np.array([np.frombuffer(r["centroid"], np.float32) for r in made]).reshape(-1, DIMENSIONS)
    radii = _radii(rows, languages, centers, idf) if made else np.zeros(0)
    return LanguageModel(languages, centers, radii, idf)


def predict(docs: DataFrame, model: LanguageModel, id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, lang_pred, score, rejected, *keep) for every row of `docs`, in one pass without a shuffle.

    `score` is the cosine to the nearest centroid. `lang_pred` is `und`, with score 0, for NULL,
    for texts without a letter, and if nothing was learned; these are rejected. Ties go to the
    first language in order. Columns not named in `keep` are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @gives_back
    def run(batches):
        known = _letters()
        for batch in batches:
            langs, scores, rejected = [], [], []
            for lot in _small_lots(values(batch.column(1))):
                good = [bool(known[np.frombuffer(t.encode("utf-32-le"), np.uint32)].any()) for t in lot]
                a, b, c = sent.value.predict(lot)
                langs += [x if g else UNKNOWN for x, g in zip(a, good, strict=True)]
                scores += [float(x) if g else 0.0 for x, g in zip(b, good, strict=True)]
                rejected += [bool(x) or not g for x, g in zip(c, good, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_()), *[batch.column(place[c]) for c in keep]], names=[id, "lang_pred", "score", "rejected", *keep])

    carried = [c for c in dict.fromkeys(keep) if c != text]
    place = {c: i for i, c in enumerate(carried, 2)} | {text: 1}
    rows = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(carried)])
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id, *keep)]
    return rows.mapInArrow(run, ", ".join([kinds[0], "lang_pred string", "score double", "rejected boolean", *kinds[1:]]))


def held_out(id: Column, folds: int = 5) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is divisible by `folds`; no id counts as held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % folds == 0, F.lit(True))
