"""Benchmark passages in documents: SimHash windows and exact verification, with DataFrame functions only.

A window has as many words as a benchmark item. It can only be similar to the item if it holds one
of the item's five-word shingles, and moving its start to the first such shingle loses nothing, so
windows start at those places (`anchors`). Each window gets a 64-bit SimHash of its shingles, in
which the copies of a shingle have different hashes: bags become sets, and no shingle that occurs
often sways the fingerprint. Fingerprints are cut into one block more than the radius: two
that differ in at most `RADIUS` bits agree on a block, so joining on (item size, block, value)
finds all of them. Pairs within the radius are verified by weighted Jaccard similarity, exactly.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.runtime import cut_lineage

#: Equal-sized sets of Jaccard similarity 0.8 have a cosine of 0.89, which is 9.7 of 64 bits on
#: average with a deviation of 2.9: 23 bits leave out one pair in 300,000.
RADIUS = 23
BITS = 64
#: Blocks as (lowest bit, mask): RADIUS + 1 of them, of two or three bits.
BLOCKS = [
    (BITS * b // (RADIUS + 1), (1 << (BITS * (b + 1) // (RADIUS + 1) - BITS * b // (RADIUS + 1))) - 1)
    for b in range(RADIUS + 1)
]
#: Shingles of items that are broadcast at a time (16 to 24 bytes each); more are taken in several lots.
LOT_SHINGLES = 1_000_000
#: Places of the three lanes in which a number counts three bits at a time.
_LANES = (0, 21, 42)
WIDTH = 5


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, in lower case."""
    return F.filter(F.split(F.lower(text), "[\\x00-/:-`{-\\x7f]+"), lambda w: w != "")


def shingles(text: Column) -> Column:
    """Hashes of all runs of five words, in order; none for shorter texts."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    return F.transform(
        F.array(hashes),
        lambda h: F.when(
            F.size(h) >= WIDTH,
            F.transform(F.sequence(F.lit(0), F.size(h) - WIDTH), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WIDTH)])),
        ).otherwise(F.lit([]).cast("array<bigint>")),
    )[0]


def simhash(bag: Column) -> Column:
    """A 64-bit fingerprint of an array of hashes; the second and later copies of an element are hashed with their number.

    Lanes of 21 bits count three bits at a time, so 21 sums hold the counts of the lower 63 bits
    and one more that of the last; bags have up to two million elements.
    """
    mask = F.lit(sum(1 << lane for lane in _LANES))
    zero = F.struct(*[F.lit(0).cast("long").alias(f"s{i}") for i in range(22)])
    # The sums, the element before, and how many copies of it came before that.
    start = F.struct(zero.alias("sums"), F.lit(None).cast("long").alias("last"), F.lit(0).alias("copy"))

    def add(sums: Column, h: Column) -> Column:
        ones = [F.shiftrightunsigned(h, i).bitwiseAND(mask) for i in range(21)] + [F.shiftrightunsigned(h, 63)]
        return F.struct(*[(sums[f"s{i}"] + x).alias(f"s{i}") for i, x in enumerate(ones)])

    def numbered(acc: Column, h: Column) -> Column:
        copy = F.when(acc["last"] == h, acc["copy"] + 1).otherwise(0)
        # The array of one binds the number, so that it is worked out once.
        return F.transform(
            F.array(copy),
            lambda j: F.struct(add(acc["sums"], F.when(j > 0, F.xxhash64(h, j)).otherwise(h)).alias("sums"), h.alias("last"), j.alias("copy")),
        )[0]

    def sign(acc: Column) -> Column:
        counts = {i + lane: F.shiftrightunsigned(acc[f"s{i}"], lane).bitwiseAND(F.lit((1 << 21) - 1)) for lane in _LANES for i in range(21)}
        counts[63] = acc["s21"]
        marks = F.lit(0).cast("long")
        for bit, count in counts.items():
            marks = marks + F.when(count * 2 > F.size(bag), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long"))
        return marks

    # Copies are neighbours in order. Never NULL, so that Spark needs no test of it in front.
    plain = F.size(F.array_distinct(bag)) == F.size(bag)
    counted = F.aggregate(F.sort_array(bag), start, numbered, lambda acc: sign(acc["sums"]))
    return F.coalesce(F.when(plain, F.aggregate(bag, zero, add, sign)).otherwise(counted), F.lit(0).cast("long"))


def _block(bits: Column, block: int) -> Column:
    low, mask = BLOCKS[block]
    return F.shiftrightunsigned(bits, low).bitwiseAND(F.lit(mask).cast("long"))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller counts over sum of the larger counts of two arrays."""
    plain = F.size(F.array_intersect(a, b))
    counted = F.aggregate(
        F.array_intersect(a, b), F.lit(0),
        lambda acc, s: acc + F.least(F.size(F.filter(a, lambda x: x == s)), F.size(F.filter(b, lambda x: x == s))),
    )
    distinct = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    shared = F.when(distinct, plain).otherwise(counted)
    return shared / (F.size(a) + F.size(b) - shared)


def fingerprints(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, n_words, bag, fingerprint) of the items with at least five words."""
    rows = benchmark.select(F.col(item).alias("item"), shingles(F.coalesce(F.col(text), F.lit(""))).alias("bag"))
    rows = rows.filter(F.size("bag") > 0)
    return rows.select("item", (F.size("bag") + WIDTH - 1).alias("n_words"), "bag", simhash(F.col("bag")).alias("fingerprint"))


def _windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, n_words, start, bag) of the windows that start at a shingle of an item of their size."""
    anchors = items.select("n_words", F.explode(F.array_distinct("bag")).alias("shingle")).distinct()
    # The outer form spares a test for empty arrays, which would compute the shingles a second time.
    places = docs.select("id", "shingles", F.posexplode_outer("shingles").alias("at", "shingle"))
    size = F.col("n_words") - (WIDTH - 1)
    # A window that would run over the end starts earlier; a shorter document is one window.
    start = F.greatest(F.lit(0), F.least(F.col("at"), F.size("shingles") - size))
    return places.join(F.broadcast(anchors), "shingle").select("id", "n_words", start.alias("start"), F.slice("shingles", start + 1, size).alias("bag"))


def _leaks(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    windows = _windows(docs, items).withColumn("fingerprint", simhash(F.col("bag")))

    def exploded(rows: DataFrame) -> DataFrame:
        values = F.array(*[_block(F.col("fingerprint"), b) for b in range(len(BLOCKS))])
        return rows.select("*", F.posexplode_outer(values).alias("block", "value"))

    index = exploded(items.select("item", "n_words", F.col("fingerprint"))).withColumnRenamed("fingerprint", "item_print")
    near = exploded(windows).join(F.broadcast(index), ["n_words", "block", "value"])
    differ = F.col("fingerprint").bitwiseXOR(F.col("item_print"))
    # A pair that agrees on several blocks is taken at the first of them.
    first = F.coalesce(*[F.when(_block(differ, b) == 0, b) for b in range(len(BLOCKS))])
    near = near.filter((F.bit_count(differ) <= RADIUS) & (first == F.col("block"))).select("id", "start", "bag", "item")
    bags = F.broadcast(items.select(F.col("item").alias("bag_item"), F.col("bag").alias("item_bag")))
    scored = near.join(bags, F.col("item").eqNullSafe(F.col("bag_item"))).withColumn("similarity", weighted_jaccard(F.col("bag"), F.col("item_bag")))
    # Rounded up by less than the next possible value, so that 4/5 is 0.8.
    return scored.filter(F.col("similarity") >= threshold - 1e-12).select("id", "item", "start", "similarity")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", threshold: float = 0.8, lot_shingles: int = LOT_SHINGLES,
) -> DataFrame:
    """(id, item, similarity, start): one row per document and item that a window of it resembles.

    `similarity` is the largest over the windows, weighted Jaccard over five-word shingles, at
    least `threshold`; `start` is the first word of the first such window. Items of fewer than
    five words have no shingle and match nothing; NULL texts count as empty. Rows that repeat an
    id are one document, rows without an id too; items that repeat an id or have none likewise. Other columns
    are ignored, whatever their names.

    Items are broadcast in lots of about `lot_shingles` shingles, counted first by one job over the
    benchmark, so a lot's size is known; the documents are scanned once per lot. Documents are
    shuffled only as rows of matching windows.
    """
    rows = docs.select(F.col(id).alias("id"), shingles(F.coalesce(F.col(text), F.lit(""))).alias("shingles"))
    items = fingerprints(benchmark, item, item_text)
    total = items.agg(F.sum(F.size("bag"))).first()[0] or 0
    lots = -(-total // lot_shingles) or 1
    found = None
    for lot in range(lots):
        part = items if lots == 1 else items.filter(F.pmod(F.xxhash64("item", "fingerprint"), F.lit(lots)) == lot)
        leaks = _leaks(rows, part, threshold)
        # Several lots are worked off one after the other, so that the plan stays small.
        leaks = cut_lineage(leaks) if lots > 1 else leaks
        found = leaks if found is None else found.union(leaks)
    best = found.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select(
        F.col("id").alias(id), F.col("item").alias(item), F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of `docs` without any benchmark passage, with all their columns.

    Rows are dropped by id and text, so a clean row stays where another one without an id, or with
    the same id, goes.
    """
    rows = docs.select(F.struct(F.col(id).alias("id"), F.sha2(F.col(text), 256).alias("mark")).alias("row"), F.col(text).alias("text"))
    leaks = contaminated(rows, benchmark, "row", "text", threshold=threshold)
    leaks = leaks.select(F.col("row.id").alias("__leak"), F.col("row.mark").alias("__mark")).distinct()
    same = docs[id].eqNullSafe(F.col("__leak")) & F.sha2(docs[text], 256).eqNullSafe(F.col("__mark"))
    return docs.join(leaks, same, "left_anti")
