"""Lines that many documents share, counted exactly and dropped, with an index that can be reversed.

The index has two tables. `refs` counts exactly in how many documents each line key occurs.
`filters` holds one cuckoo filter per shard of the key space with the keys at or over the
threshold. Adding documents raises counts, and keys that reach the threshold are inserted into
their shard's filter; taking documents out lowers counts, and keys that fall below it are deleted
from the filter, which a Bloom filter could not do. Dropping lines asks the filters first and then
the exact counts, so a filter's false positives never cost a line.
"""

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.skew import salted_lookup
from dayloom.llm.words import gives_back
from dayloom.runtime import cut_lineage

BLANKS = b" \t\n\x0b\x0c\r"
#: Filters of at most this many bytes in all are sent to every task; beyond, keys meet their counts by a join.
BROADCAST_BYTES = 64_000_000


def line_key(line: bytes) -> bytes:
    """The key of a line: blanks stripped at both ends, A-Z in lower case."""
    return line.strip(BLANKS).lower()


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode()) >= least)


class CuckooFilter:
    """A set of 16-byte digests with deletion: 16-bit fingerprints in buckets of four.

    A digest has two buckets; the second follows from the first and the fingerprint, so a
    fingerprint can be moved without its key. A deleted digest must have been inserted.
    """

    SLOTS = 4
    KICKS = 500

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of_size(cls, keys: int) -> "CuckooFilter":
        """An empty filter with room for twice as many keys, and 64 at least."""
        buckets = 1 << max(4, (2 * keys // cls.SLOTS).bit_length())
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def holding(cls, digests: Sequence[bytes]) -> "CuckooFilter":
        size = len(digests)
        while True:
            made = cls.of_size(size)
            if all(made.insert(d) for d in digests):
                return made
            size *= 2

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        return cls(np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first bucket, second bucket) from digests seen as rows of two 64-bit numbers."""
        mask = np.uint64(len(self.table) - 1)
        prints = (parts[:, 0] >> np.uint64(48)).astype(np.uint16)
        prints = np.where(prints == 0, np.uint16(1), prints)
        first = parts[:, 1] & mask
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        jump = prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
        return (bucket ^ jump) & np.uint64(len(self.table) - 1)

    def contains(self, digests: Sequence[bytes]) -> np.ndarray:
        prints, first, second = self._places(np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2))
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)

    def insert(self, digest: bytes) -> bool:
        """False when there is no room; the filter is then to be made anew with a larger size."""
        prints, first, second = self._places(np.frombuffer(digest, np.uint64).reshape(1, 2))
        mark = prints[0]
        for bucket in (int(first[0]), int(second[0])):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = int(first[0])
        for turn in range(self.KICKS):
            slot = turn % self.SLOTS
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            bucket = int(self._other(np.array([bucket], np.uint64), np.array([mark], np.uint16))[0])
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        prints, first, second = self._places(np.frombuffer(digest, np.uint64).reshape(1, 2))
        for bucket in (int(first[0]), int(second[0])):
            here = np.flatnonzero(self.table[bucket] == prints[0])
            if len(here):
                self.table[bucket, here[0]] = 0
                return True
        return False


@dataclass
class LineIndex:
    """`refs` (shard, key, n_docs) and `filters` (shard, data) with the settings they were made with."""

    refs: DataFrame
    filters: DataFrame
    min_docs: int
    min_chars: int
    shards: int

    def repeated(self) -> DataFrame:
        """(key) of the lines in at least `min_docs` documents."""
        return self.refs.filter(F.col("n_docs") >= self.min_docs).select("key")


FILTER_SCHEMA = "shard int, data binary"


def _shard_of(key: Column, shards: int) -> Column:
    """The shard of a key: its first four bytes as a number, modulo the number of shards."""
    return F.pmod(F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _key_counts(docs: DataFrame, text: str, min_chars: int, shards: int) -> DataFrame:
    """(shard, key, n_docs): in how many rows of `docs` each key occurs."""

    @gives_back
    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(0):
                keys = {line_key(x) for x in (t.as_py() or "").encode().split(b"\n")}
                out += [_digest(k) for k in keys if _long_enough(k, min_chars)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["key"])

    # Counted before the shuffle, so a line of a third of all documents is one row per task.
    keys = docs.select(F.col(text).alias("__text")).mapInArrow(run, "key binary")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))
    return counts.select(_shard_of(F.col("key"), shards).alias("shard"), "key", "n_docs")


def build_index(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, shards: int | None = None) -> LineIndex:
    """The index of all rows of `docs`, each one document; writes the counts to the checkpoint folder.

    A key is kept from `min_chars` code points on. The number of shards follows
    spark.sql.shuffle.partitions unless given, so that a shard stays a task's size.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    refs = cut_lineage(_key_counts(docs, text, min_chars, shards))

    def make(shard: pd.DataFrame) -> pd.DataFrame:
        data = CuckooFilter.holding(list(shard["key"])).to_bytes()
        return pd.DataFrame({"shard": shard["shard"].iloc[:1], "data": [data]})

    filters = refs.filter(F.col("n_docs") >= min_docs).select("shard", "key").groupBy("shard").applyInPandas(make, FILTER_SCHEMA)
    return LineIndex(refs, cut_lineage(filters), min_docs, min_chars, shards)


def _changed(index: LineIndex, docs: DataFrame, text: str, sign: int) -> LineIndex:
    delta = _key_counts(docs, text, index.min_chars, index.shards).select("shard", "key", F.col("n_docs").alias("by"))
    before, after = F.coalesce("n_docs", F.lit(0)), F.coalesce("n_docs", F.lit(0)) + sign * F.coalesce("by", F.lit(0))
    least = index.min_docs
    merged = index.refs.join(delta, ["shard", "key"], "full").select(
        "shard", "key", after.alias("n_docs"),
        F.when((before < least) & (after >= least), 1).when((before >= least) & (after < least), -1).otherwise(0).alias("crossed"),
    )
    merged = cut_lineage(merged)
    # The keys over the threshold go along, for a filter that has no room left.
    moves = merged.filter((F.col("crossed") != 0) | (F.col("n_docs") >= least)).select("shard", "key", "crossed")

    def update(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        shard = (old if len(old) else keys)["shard"].iloc[:1]
        made = CuckooFilter.from_bytes(old["data"].iloc[0]) if len(old) else CuckooFilter.of_size(0)
        for key in keys["key"][keys["crossed"] < 0]:
            made.delete(key)
        if not all(made.insert(key) for key in keys["key"][keys["crossed"] > 0]):
            made = CuckooFilter.holding(list(keys["key"][keys["crossed"] >= 0]))
        return pd.DataFrame({"shard": shard, "data": [made.to_bytes()]})

    filters = index.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(update, FILTER_SCHEMA)
    refs = merged.filter("n_docs > 0").drop("crossed")
    return LineIndex(refs, cut_lineage(filters), least, index.min_chars, index.shards)


def insert_documents(index: LineIndex, docs: DataFrame, text: str = "text") -> LineIndex:
    """A new index with these documents added."""
    return _changed(index, docs, text, 1)


def delete_documents(index: LineIndex, docs: DataFrame, text: str = "text") -> LineIndex:
    """A new index without these documents, which must have been added before."""
    return _changed(index, docs, text, -1)


def _candidates(docs: DataFrame, index: LineIndex, id: str, text: str) -> DataFrame:
    """(id, key) of the lines that may be repeated: all that the filters let through, or simply all."""
    spark, least, shards = docs.sparkSession, index.min_chars, index.shards
    held = index.filters.agg(F.sum(F.length("data"))).first()[0] or 0
    sent = None
    if held <= BROADCAST_BYTES:
        sent = spark.sparkContext.broadcast({r["shard"]: bytes(r["data"]) for r in index.filters.collect()})

    @gives_back
    def keys(batches) -> Iterator[pa.RecordBatch]:
        filters = {k: CuckooFilter.from_bytes(v) for k, v in sent.value.items()} if sent else None
        for batch in batches:
            ids, out = [], []
            for i, t in enumerate(batch.column(1)):
                found = {line_key(x) for x in (t.as_py() or "").encode().split(b"\n")}
                new = [_digest(k) for k in found if _long_enough(k, least)]
                ids += [i] * len(new)
                out += new
            hit = _hits(filters, out, shards) if filters is not None else np.ones(len(out), bool)
            rows = [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, names=["id", "key"]).filter(pa.array(hit))

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("body"))
    return rows.mapInArrow(keys, f"id {docs.schema[id].dataType.simpleString()}, key binary")


def _hits(filters: dict[int, CuckooFilter], digests: list[bytes], shards: int) -> np.ndarray:
    """Which of the digests their shards' filters let through."""
    hit = np.zeros(len(digests), bool)
    if digests:
        shard = np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4)[:, 0] % shards
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if (f := filters.get(int(shard[part[0]]))) is not None:
                hit[part] = f.contains([digests[i] for i in part])
    return hit


def drop_repeated_lines(docs: DataFrame, index: LineIndex, id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, text, n_lines, n_dropped, *keep): each document without the lines in at least `min_docs` documents.

    The other lines stay in order, joined by line breaks. NULL or empty text is one empty line;
    empty keys are never dropped, so blank lines stay, and a document may end up empty. Rows are
    never dropped. A line repeated inside one document counts once. Rows that repeat an id are
    separate documents. Columns not named in `keep` are ignored; those in it must not be called
    like the results.
    """
    found = salted_lookup(_candidates(docs, index, id, text), index.repeated().withColumn("yes", F.lit(True)), "key", "id")
    drops = found.filter("yes").groupBy("id").agg(F.collect_set("key").alias("keys"))
    carried = [f"__k{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id).alias("__id"), F.col(text).alias("__body"), *[F.col(c).alias(n) for c, n in zip(keep, carried, strict=True)])
    rows = rows.join(drops, F.col("__id").eqNullSafe(F.col("id")), "left").select("__id", "__body", "keys", *carried)

    @gives_back
    def run(batches):
        for batch in batches:
            texts, lines, dropped = [], [], []
            for t, keys in zip(batch.column(1), batch.column(2), strict=True):
                all_lines = (t.as_py() or "").encode().split(b"\n")
                keys = frozenset(keys.as_py() or ())
                kept = [x for x in all_lines if _digest(line_key(x)) not in keys] if keys else all_lines
                texts.append(b"\n".join(kept).decode())
                lines.append(len(all_lines))
                dropped.append(len(all_lines) - len(kept))
            made = [batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[3:]], names=[id, text, "n_lines", "n_dropped", *keep])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id, *keep)]
    return rows.mapInArrow(run, ", ".join([kinds[0], f"`{text}` string", "n_lines bigint", "n_dropped bigint", *kinds[1:]]))
