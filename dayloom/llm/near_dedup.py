"""Near-duplicates by DartMinHash signatures, banded joining and exact verification.

A document is a bag of five-word shingles: a shingle that occurs w times is an element of weight w.
Darts fall on every element's region, one unit of weight after the other, in the order of their
rank; where they fall and which of the K coordinates they belong to are hashes of the element, so
equal regions get equal darts. A coordinate keeps its earliest dart. Two documents agree on a
coordinate with a probability equal to their weighted Jaccard similarity, and the number of darts
looked at depends on K and hardly on the document's size.

Signatures are cut into bands. The documents of a band's bucket are compared with the bucket's
first document, a star and not all pairs. Where a bucket still holds more than one class, its
documents meet again, with those of all other such buckets that have the same first document: a
document moves once for all of them. They are dealt into blocks of a bounded size, and pairs of
blocks are compared in tasks of their own, the largest class never with itself. Pairs that share a
bucket and whose signatures agree often enough are then verified. All comparisons are exact.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.sieve import passes, sieve_of
from dayloom.llm.skew import salted_lookup
from dayloom.llm.words import gives_back, lots, mix, occurrences, shingles, values
from dayloom.runtime import cut_lineage, rest

COORDINATES = 128
#: Characters sketched at a time, which take about 300 bytes each.
LOT = 200_000
#: 32 bands of 4 coordinates find a pair of similarity 0.8 with probability 1 - 5e-8.
ROWS, BANDS = 4, 32
#: Bits of a coordinate's mark. Four marks in lanes of 16 bits make a band, a 64-bit number.
MARK_BITS = 14
#: Tasks that a bucket's documents are dealt over; buckets are many, so each is repeated a few times only.
BUCKET_SALTS = 6
#: Shingles of the documents that meet as one block; two blocks of 32-bit hashes take 2 MB.
BLOCK_CELLS = 200_000
#: A pair of similarity 0.8 agrees on 102 of the 128 coordinates on average, with a deviation of
#: 4.5, and on fewer than 77 once in 10^8.
AGREEMENT = 77
_STEP = np.uint64(0xE7037ED1A0B428DB)


def dart_signatures(doc: np.ndarray, cells: np.ndarray, n_docs: int, k: int = COORDINATES) -> np.ndarray:
    """Signatures, a row of k marks per document, from (document, unit of weight).

    `cells` are hashes of units: an element of weight w has w of them (`occurrences`). A unit's
    darts come at rank r1 < r2 < ...; the gaps are exponential, so that darts are spread evenly
    over weight and rank. Darts are thrown up to a rank that fills the k coordinates of most
    documents; where some stay empty, the rank is doubled. `k` is a power of two. Rows of
    documents without units are all ones.
    """
    out = np.full(n_docs * k, np.iinfo(np.uint64).max, np.uint64)
    weight = np.bincount(doc, minlength=n_docs)
    reach = k * (np.log(k) + 1.0) / np.maximum(weight, 1)

    def dart(idx: np.ndarray, turn: np.ndarray) -> np.ndarray:
        return mix(cells[idx] + (turn + np.uint64(1)) * _STEP)

    def gap(darts: np.ndarray) -> np.ndarray:
        return -np.log(((darts >> np.uint64(23)).astype(np.float64) + 1.0) * 2.0**-41)

    low, bits = np.uint64((1 << MARK_BITS) - 1), (k - 1).bit_length()
    turn = np.zeros(len(doc), np.uint64)
    everyone = np.arange(len(doc))
    thrown = dart(everyone, turn)
    rank = gap(thrown)
    live = everyone
    while len(live):
        idx = live[rank[live] <= reach[doc[live]]]
        while len(idx):
            darts = thrown[idx]
            place = doc[idx] * k + (darts & np.uint64(k - 1)).astype(np.int64)
            # Ranks are positive, so their bits are in order; the low ones carry the dart's mark.
            packed = rank[idx].view(np.uint64) & ~low | (darts >> np.uint64(bits)) & low
            np.minimum.at(out, place, packed)
            turn[idx] += np.uint64(1)
            thrown[idx] = dart(idx, turn[idx])
            rank[idx] += gap(thrown[idx])
            idx = idx[rank[idx] <= reach[doc[idx]]]
        open_docs = (out.reshape(n_docs, k) == np.iinfo(np.uint64).max).any(axis=1) & (weight > 0)
        reach[open_docs] *= 2
        live = live[open_docs[doc[live]]]
    return (out & low).astype(np.uint16).reshape(n_docs, k)


def _bags(doc: np.ndarray, cells: np.ndarray, n_docs: int) -> list[bytes | None]:
    """A 128-bit digest of each document's bag, None for documents without words."""
    total = np.zeros((n_docs, 2), np.uint64)
    weight = np.bincount(doc, minlength=n_docs)
    if len(doc):
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        for j, key in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
            total[doc[starts], j] = np.add.reduceat(mix(cells ^ np.uint64(key)), starts)
    return [total[i].tobytes() if weight[i] else None for i in range(n_docs)]


def sketches(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, marked: bool = False) -> DataFrame:
    """(id, key, bag, signature): a hash of the row, a digest of the shingle bag, and the bands; both NULL without words.

    With `marked` a further column, `mark`, has the text's digest.
    """
    extra = ["mark"] if marked else []

    @gives_back
    def run(batches):
        for batch in batches:
            bags, signatures = [], []
            for lot in lots(values(batch.column(1)), LOT):
                doc, cells = occurrences(*shingles(lot, width))
                bags += _bags(doc, cells, len(lot))
                signatures += list(dart_signatures(doc, cells, len(lot)).view(np.int64)[:, :BANDS])
            signatures = [s if b else None for s, b in zip(signatures, bags, strict=True)]
            made = [batch.column(0), batch.column(2), pa.array(bags, pa.binary()), pa.array(signatures, pa.list_(pa.int64())), *[batch.column(3) for _ in extra]]
            yield pa.RecordBatch.from_arrays(made, names=["id", "key", "bag", "signature", *extra])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("body"), _key(F.col(id), F.col(text)).alias("key"), *[_mark(F.col(text)).alias(c) for c in extra])
    kinds = [f"id {docs.schema[id].dataType.simpleString()}", "key bigint", "bag binary", "signature array<bigint>", *[f"{c} string" for c in extra]]
    return rows.mapInArrow(run, ", ".join(kinds))


def _mark(text: Column) -> Column:
    return F.sha2(text, 256)


def _key(id: Column, text: Column) -> Column:
    """A hash that leads back to a row: of its id, or of its text where it has none."""
    return F.when(id.isNotNull(), F.xxhash64(id)).otherwise(F.xxhash64(text))


def _bag_cells(docs: DataFrame, wanted: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """(bag, cells, short) of the wanted bags (key, bag), from the text of their documents.

    `short` has the upper halves of the cells' hashes. A sieve holds back the texts that aren't
    asked for before they are shuffled, and a task passes on a key once. A text that doesn't give
    the bag (a key of different texts) is left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(sieve_of(wanted))

    @gives_back
    def asked(batches):
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            kept = passes(sent.value, keys.view(np.uint64))
            for i in np.flatnonzero(kept):
                kept[i] = (k := int(keys[i])) not in seen
                seen.add(k)
            yield batch.filter(pa.array(kept))

    @gives_back
    def run(batches):
        for batch in batches:
            at = 0
            # Cells take four times as much as texts, so each lot's leave as a batch of their own.
            for lot in lots(values(batch.column(0)), LOT):
                asked_for = batch.column(1).slice(at, len(lot))
                at += len(lot)
                doc, all_cells = occurrences(*shingles(lot, width))
                cuts = np.searchsorted(doc, np.arange(len(lot) + 1))
                good = [a == b for a, b in zip(_bags(doc, all_cells, len(lot)), asked_for.to_pylist(), strict=True)]
                halves = (all_cells >> np.uint64(32)).astype(np.uint32).view(np.int32)
                short = [np.sort(halves[cuts[i] : cuts[i + 1]]) for i in range(len(lot))]
                cells = [np.sort(all_cells[cuts[i] : cuts[i + 1]]).tobytes() for i in range(len(lot))]
                made = [asked_for, pa.array(cells, pa.binary()), pa.array(short, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(made, names=["bag", "cells", "short"]).filter(pa.array(good, pa.bool_()))

    rows = docs.select(_key(F.col(id), F.col(text)).alias("key"), F.col(text).alias("body")).mapInArrow(asked, "key bigint, body string")
    return rows.join(wanted, "key").select("body", "bag").mapInArrow(run, "bag binary, cells binary, short array<int>")


def _similar(pairs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of bags whose weighted Jaccard similarity is at least `threshold`, exactly."""
    left = cells.select(F.col("bag").alias("a"), F.col("cells").alias("a_cells"))
    right = cells.select(F.col("bag").alias("b"), F.col("cells").alias("b_cells"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "a_cells", "b_cells")

    @gives_back
    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n = len(x) + len(y)
                # A bag that is too small for the other can't reach the threshold.
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good.append(shared >= threshold * (n - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the edges (a, b): the smallest node of each connected component.

    Every round gives a node the smallest label around it and then that label's own label, so
    chains shorten by half; it ends when no label changes.
    """
    ways = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
    links = rest(edges.select(ways.alias("way")).select("way.*"))
    n = links.count()
    labels = rest(links.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("label")), n)
    while True:
        # Labels of neighbours are brought by joins on the nodes; minima are taken before the shuffle.
        near = links.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("low"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "low").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        moved = lower.join(jump, "next", "left").select("node", "was", F.least("next", F.coalesce("beyond", "next")).alias("label"))
        moved = rest(moved, n)
        labels = moved.select("node", "label")
        if moved.filter(F.col("was") != F.col("label")).isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """(id, class_id, class_size, kept) for every row of `docs`.

    Two documents are linked when the weighted Jaccard similarity of their bags of `width`-word
    shingles is at least `threshold`; classes are what links connect. `class_id` is the smallest
    id of the class, and its row stays. A text of fewer words is one shingle. A text without
    words, NULL or empty, is a class of its own and stays. A row without an id is linked like any
    other; it stays only if the whole class has no id, where all rows stay. Rows that repeat an id
    and a text are one document: all of them stay or go. Other columns are ignored, whatever their
    names.
    """
    return _classed(docs, id, text, threshold, width, cut_lineage(sketches(docs, id, text, width)))


def _classed(docs: DataFrame, id: str, text: str, threshold: float, width: int, sketched: DataFrame) -> DataFrame:
    """What `near_duplicates` gives, from the sketches of the rows; their `mark` stays if they have one."""
    # Equal bags are one node from here on; `bag` is its name.
    row = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "key")).alias("row")
    bags = sketched.filter("bag is not null").groupBy("bag").agg(row, F.min("signature").alias("signature"))
    bags = cut_lineage(bags.select("bag", "row.id", "row.key", "signature"))
    banded = bags.select("bag", F.transform("signature", lambda band, i: F.xxhash64(i, band)).alias("buckets"))
    in_bucket = banded.select("bag", F.explode("buckets").alias("bucket")).groupBy("bucket")
    buckets = rest(in_bucket.agg(F.count(F.lit(1)).alias("n"), F.min("bag").alias("first")).filter("n > 1").drop("n"))
    # Most buckets hold one bag, and those are sieved out before the others meet.
    shared = _in_shared(banded, sieve_of(buckets.select(F.col("bucket").alias("key"))))
    members = rest(salted_lookup(shared, buckets, "bucket", "bag", BUCKET_SALTS).filter("first is not null"))
    involved = rest(members.select("bag").distinct().join(bags.select("bag", "key"), "bag"), members.count())
    cells = cut_lineage(_bag_cells(docs, involved, id, text, width))

    stars = members.filter(F.col("bag") != F.col("first")).select(F.col("bag").alias("a"), F.col("first").alias("b")).distinct()
    edges = rest(_similar(stars, cells, threshold))
    labels = components(edges)
    across = rest(_across(members, labels, bags, cells, threshold))
    labels = components(edges.union(_similar(across, cells, threshold)))

    found = bags.select("bag", "id").join(labels.withColumnRenamed("node", "bag"), "bag", "left")
    classes = found.groupBy(F.coalesce("label", "bag").alias("label")).agg(F.min("id").alias("class_id"))
    led = found.select("bag", F.coalesce("label", "bag").alias("label")).join(classes, "label").select("bag", "label", "class_id")
    return _sized(sketched, led, id)


def _in_shared(banded: DataFrame, sieve: np.ndarray) -> DataFrame:
    """(bag, bucket) of the buckets that a sieve lets through, from (bag, buckets)."""
    sent = banded.sparkSession.sparkContext.broadcast(sieve)

    @gives_back
    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            kept = passes(sent.value, flat.to_numpy(zero_copy_only=False).view(np.uint64))
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[kept])), flat.filter(pa.array(kept))], names=["bag", "bucket"])

    return banded.mapInArrow(run, "bag binary, bucket bigint")


def _across(members: DataFrame, labels: DataFrame, bags: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of one bucket but different classes that seem similar, for buckets that hold more than one class.

    Buckets with the same first document are one meeting. Its documents outside the largest class
    are dealt into blocks by their bags, those of the largest class into blocks of their own, and
    a document goes to every pair of blocks that it takes part in: as often as the meeting has
    blocks, not as its buckets are many. The largest class, which may be a third of all documents,
    is never paired with itself.
    """
    classed = members.select("bucket", "first", "bag").join(labels.withColumnRenamed("node", "bag"), "bag", "left")
    classed = rest(classed.select("bucket", "first", "bag", F.coalesce("label", "bag").alias("label")), members.count())
    mixed = classed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    mixed = mixed.select("bucket", F.lit(True).alias("mixed"))
    met = salted_lookup(classed, mixed, "bucket", "bag", BUCKET_SALTS).filter("mixed").select("first", "bag", "label").distinct()
    met = rest(met.join(cells.select("bag", F.size("short").cast("long").alias("weight")), "bag"))

    classes = met.groupBy("first", "label").agg(F.sum("weight").alias("weight"))
    facts = classes.groupBy("first").agg(F.sum("weight").alias("all"), F.max(F.struct("weight", "label")).alias("largest"))
    blocks = lambda weight: F.greatest(F.ceil(weight / F.lit(float(BLOCK_CELLS))), F.lit(1))
    facts = facts.select("first", F.col("largest.label").alias("largest"), blocks(F.col("all") - F.col("largest.weight")).alias("few"), blocks(F.col("largest.weight")).alias("many"))
    here = salted_lookup(met.drop("weight"), facts, "first", "bag", BUCKET_SALTS)
    large = F.col("label") == F.col("largest")
    spread = F.xxhash64("bag", F.lit("block"))
    block = F.when(large, F.col("few") + F.pmod(spread, F.col("many"))).otherwise(F.pmod(spread, F.col("few")))
    partners = F.sequence(F.lit(0).cast("long"), F.when(large, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1))
    here = here.select("first", "bag", "label", block.alias("block"), F.explode(partners).alias("partner"))
    here = here.select("first", F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"), "block", "bag", "label")
    payload = bags.select("bag", "signature").join(cells.select("bag", "short"), "bag")
    return here.join(payload, "bag").groupBy("first", "i", "j").applyInPandas(_comparer(threshold), "a binary, b binary").distinct()


def _comparer(threshold: float):
    """Compares the documents of two blocks, or of one with itself."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = (rows[(rows["block"] == rows[x]).to_numpy()] for x in "ij")
        alone = rows["i"].iloc[0] == rows["j"].iloc[0]
        bands = np.stack(right["signature"].to_list()) if len(right) else np.zeros((0, BANDS), np.int64)
        marks = bands.view(np.uint16)
        size = right["short"].map(len).to_numpy(np.int64)
        stops = np.cumsum(size)
        halves = np.concatenate(right["short"].to_list()) if len(right) else np.zeros(0, np.int32)
        label, names = right["label"].to_numpy(), right["bag"].to_numpy()
        found = []
        for at, (bag, own, signature, short) in enumerate(zip(left["bag"], left["label"], left["signature"], left["short"], strict=True)):
            signature = np.asarray(signature, np.int64)
            good = (bands == signature).any(axis=1) & (label != own)
            if alone:
                good[: at + 1] = False
            near = np.flatnonzero(good)
            near = near[(marks[near] == signature.view(np.uint16)).sum(axis=1) >= AGREEMENT]
            # A bag that is too small for the other can't reach the threshold.
            near = near[np.minimum(size[near], len(short)) >= threshold * np.maximum(size[near], len(short))]
            if not len(near):
                continue
            own_cells = np.unique(short)
            picked = np.concatenate([np.arange(stops[b] - size[b], stops[b]) for b in near])
            place = np.searchsorted(own_cells, halves[picked])
            hit = own_cells[np.minimum(place, len(own_cells) - 1)] == halves[picked]
            # Halves that clash by chance count too, so this is never below the shared weight.
            shared = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size[near])[:-1]]), dtype=np.int64)
            enough = shared * (1 + threshold) >= threshold * (size[near] + len(short)) - 1e-9
            found += [(bag, names[b]) for b in near[enough]]
        return pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]}, dtype=object)

    return run


def _sized(sketched: DataFrame, led: DataFrame, id: str) -> DataFrame:
    """Every row with its class: through its bag if that is shared, on its own otherwise."""
    extra = [c for c in sketched.columns if c == "mark"]
    rows = sketched.select("id", "bag", *extra)
    copies = rows.filter("bag is not null").groupBy("bag").agg(F.count(F.lit(1)).alias("copies"))
    counted = led.join(copies, "bag")
    sizes = counted.groupBy("label").agg(F.sum("copies").alias("class_size"))
    shared = counted.join(sizes, "label").filter("class_size > 1").select("bag", "class_id", "class_size")
    out = salted_lookup(rows, shared, "bag", "id")
    alone = F.col("class_size").isNull()
    class_id = F.when(alone, F.col("id")).otherwise(F.col("class_id"))
    return out.select(F.col("id").alias(id), class_id.alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.col("id").eqNullSafe(class_id).alias("kept"), *extra)


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of `docs` that stay, one document per class, with all their columns.

    Rows are dropped by id and text, so a clean row stays where another one without an id, or with
    the same id, goes.
    """
    sketched = cut_lineage(sketches(docs, id, text, width, True))
    gone = _classed(docs, id, text, threshold, width, sketched).filter("not kept")
    gone = rest(gone.select(F.col(id).alias("__gone"), F.col("mark").alias("__mark")).distinct())
    sent = docs.sparkSession.sparkContext.broadcast(sieve_of(gone.select(F.xxhash64("__gone", "__mark").alias("key"))))

    @F.pandas_udf("boolean")
    def asked(keys: pd.Series) -> pd.Series:
        return pd.Series(passes(sent.value, keys.to_numpy(np.int64).view(np.uint64)))

    # Rows that no dropped one can equal stay where they are; only the others meet the dropped ones.
    flagged = docs.withColumn("__asked", asked(F.xxhash64(F.col(id), _mark(F.col(text)))))
    met = flagged.filter("__asked").drop("__asked")
    same = met[id].eqNullSafe(F.col("__gone")) & _mark(met[text]).eqNullSafe(F.col("__mark"))
    return flagged.filter("not __asked").drop("__asked").unionByName(met.join(gone, same, "left_anti"))
