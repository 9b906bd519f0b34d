"""Exact dedup, line dedup and near dedup against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.testing import assertDataFrameEqual

from dayloom.llm import exact_dedup, line_dedup, near_dedup
from dayloom.llm.words import occurrences, shingles, word_hashes
from tests.llm.helpers import bag, classes, documents, jaccard, words_of

RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choices("abcdefghij", k=5)) for _ in range(400)]


def sentence(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def test_exact_dedup_of_odd_rows(spark):
    long = "x" * 200_000
    rows = [(1, "a", None), (2, "a", None), (3, None, None), (4, "", None), (5, "A", None), (6, long, None), (7, long, None), (7, long, None), (None, "a", None), (None, "z", None)]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(documents(spark, rows)).collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 7, 3, False), (7, 7, 3, True), (None, None, 1, True)}
    assert exact_dedup.exact_dedup(documents(spark, []).limit(0)).count() == 0


def test_exact_dedup_of_a_hot_text(spark):
    rows = [(i, "hot" if i % 3 else f"own {i}", None) for i in range(3000)]
    got = exact_dedup.exact_dedup(documents(spark, rows).repartition(16)).filter("kept").agg(F.count("*"), F.max("group_size")).first()
    assert tuple(got) == (1001, 1999 + 1 if 2999 % 3 == 0 else 2000)


def test_exact_dedup_does_not_trust_a_weak_digest(spark):
    rows = [(1, "ab", None), (2, "cd", None), (3, "efg", None)]
    weak = exact_dedup.exact_dedup(documents(spark, rows), digest=F.length)
    with pytest.raises(Exception, match="share a digest"):
        weak.collect()


def test_drop_copies_keeps_columns(spark):
    docs = documents(spark, [(1, "a", "en"), (2, "a", "de"), (3, None, None)])
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()) == [2, 3]
    assert exact_dedup.drop_copies(docs).columns == docs.columns


def test_drop_copies_tells_rows_of_one_id_apart(spark):
    rows = [(1, "a", None), (2, "a", None), (1, "b", None), (None, "c", None), (None, "a", None), (1, "b", "again")]
    got = sorted(((r["doc_id"], r["text"], r["lang"]) for r in exact_dedup.drop_copies(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(2, "a", None), (1, "b", None), (1, "b", "again"), (None, "c", None)], key=str)


def lines_by_hand(texts, least):
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower()
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and seen[key(x)] >= least)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


ODD_LINES = [None, "", "\n", "  Footer \r", "footer", "FOOTER\nbody", "\x0bfooter\x0c\nfooter", "É\né\nfooter", "a\n\n\nb", "footer ", "x" * 100_000 + "\nfooter"]


def test_line_dedup_of_odd_rows(spark):
    docs = documents(spark, [(i, t, None) for i, t in enumerate(ODD_LINES)])
    index = line_dedup.build_index(docs, min_docs=3, shards=4)
    got = line_dedup.drop_repeated_lines(docs, index, keep=["lang"]).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_dropped"], r["text"]) for r in got] == lines_by_hand(ODD_LINES, 3)
    assert line_dedup.drop_repeated_lines(docs.limit(0), line_dedup.build_index(docs.limit(0))).count() == 0


def test_line_dedup_joins_when_filters_are_too_large_to_send(spark, monkeypatch):
    docs = documents(spark, [(i, t, None) for i, t in enumerate(ODD_LINES)])
    index = line_dedup.build_index(docs, min_docs=3, shards=4)
    sent = line_dedup.drop_repeated_lines(docs, index).orderBy("doc_id").collect()
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert line_dedup.drop_repeated_lines(docs, index).orderBy("doc_id").collect() == sent


def test_line_index_is_reversible(spark):
    old = documents(spark, [(i, f"shared\nown {i}\nhalf" if i < 2 else f"shared\nown {i}", None) for i in range(4)])
    new = documents(spark, [(10 + i, f"half\nfresh\nnew {i}", None) for i in range(3)])
    before = line_dedup.build_index(old, min_docs=3, shards=4)
    both = line_dedup.insert_documents(before, new)
    whole = line_dedup.build_index(old.union(new), min_docs=3, shards=4)
    assertDataFrameEqual(both.refs, whole.refs)
    back = line_dedup.delete_documents(both, new)
    assertDataFrameEqual(back.refs, before.refs)
    both_docs = old.union(new)
    for index, expected in ((both, whole), (back, before)):
        a = line_dedup.drop_repeated_lines(both_docs, index).orderBy("doc_id").collect()
        assert a == line_dedup.drop_repeated_lines(both_docs, expected).orderBy("doc_id").collect()
    assert {r["text"] for r in line_dedup.drop_repeated_lines(new, both).collect()} == {"new 0", "new 1", "new 2"}


def test_cuckoo_filter_inserts_and_deletes():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(3000)]
    made = line_dedup.CuckooFilter.holding(keys[:2000])
    assert made.contains(keys[:2000]).all()
    assert made.contains(keys[2000:]).mean() < 0.01
    assert all(made.delete(k) for k in keys[:1000])
    made = line_dedup.CuckooFilter.from_bytes(made.to_bytes())
    assert made.contains(keys[1000:2000]).all()
    assert made.contains(keys[:1000]).mean() < 0.01


def test_words_and_shingles_on_arrays():
    texts = ["The cat, sat-on THE mat!", "", "Été à Köln\n\tété", "one two", "!!", "a b c d e f a b c d e"]
    doc, hashes = word_hashes(texts)
    named = {}
    for i, t in enumerate(texts):
        got, want = hashes[doc == i], words_of(t)
        assert len(got) == len(want)
        for h, w in zip(got, want, strict=True):
            assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)
    doc, cells = occurrences(*shingles(texts))
    assert [int((doc == i).sum()) for i in range(len(texts))] == [sum((bag(t) or Counter()).values()) for t in texts]
    assert len(np.unique(cells[doc == 5])) == 7


def test_dart_signatures_estimate_weighted_jaccard():
    base = sentence(400).split()
    texts = [" ".join(base), " ".join(base[:340] + sentence(60).split()), " ".join(base[:200] * 2), "short text", "short text"]
    doc, cells = occurrences(*shingles(texts))
    sig = near_dedup.dart_signatures(doc, cells, len(texts), k=2048)
    for a in range(3):
        for b in range(a):
            assert abs((sig[a] == sig[b]).mean() - jaccard(bag(texts[a]), bag(texts[b]))) < 0.05
    assert (sig[3] == sig[4]).all()


def near_rows():
    rng = random.Random(11)
    rows = []
    for group in range(25):
        words = sentence(rng.choice([6, 40, 120, 300]), rng).split()
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
            rows.append((len(rows) + 1, " ".join(copy)))
    # A chain whose ends are less similar than its links.
    chain = sentence(200, rng).split()
    for step in range(6):
        rows.append((len(rows) + 1, " ".join(chain[5 * step : 5 * step + 160])))
    return rows


def test_near_dedup_against_all_pairs(spark):
    rows = near_rows()
    docs = documents(spark, [(i, t, None) for i, t in rows]).repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == classes(rows)


def test_near_dedup_finds_links_that_a_star_misses(spark, monkeypatch):
    # One band of no coordinates puts all documents into one bucket, whose first member links few.
    rows = near_rows()
    docs = documents(spark, [(i, t, None) for i, t in rows])
    plain = near_dedup.sketches

    def one_bucket(*args):
        return plain(*args).withColumn("signature", F.when(F.col("bag").isNotNull(), F.array_repeat(F.lit(0).cast("long"), near_dedup.BANDS)))

    monkeypatch.setattr(near_dedup, "sketches", one_bucket)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == classes(rows)


@pytest.mark.parametrize("block", [200_000, 2_000])
def test_near_dedup_of_a_family_of_near_but_unlinked_texts(spark, monkeypatch, block):
    # Copies of one text that are close to each other and mostly below the threshold, beside a large class of real copies.
    monkeypatch.setattr(near_dedup, "BLOCK_CELLS", block)
    rng = random.Random(5)
    words = sentence(200, rng).split()
    rows = []
    for i in range(220):
        copy = list(words)
        for _ in range(rng.choice([0, 1, 4, 5, 6, 7]) if i % 3 else 0):
            copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
        rows.append((len(rows) + 1, " ".join(copy) + (f" tail {i % 7}" if i % 3 == 0 else "")))
    want = classes(rows)
    assert len(set(want.values())) > 5
    docs = documents(spark, [(i, t, None) for i, t in rows]).repartition(4)
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()} == want


def test_rows_without_an_id_are_linked_to_their_near_copies(spark):
    words = sentence(60).split()
    near = " ".join([*words[:-1], "changed"])
    rows = [(7, " ".join(words), None), (None, near, None), (None, near + " twice", None), (None, "quite another text", None)]
    got = {(r["doc_id"], r["class_id"], r["class_size"], r["kept"]) for r in near_dedup.near_duplicates(documents(spark, rows)).collect()}
    assert got == {(7, 7, 3, True), (None, 7, 3, False), (None, None, 1, True)}
    kept = near_dedup.drop_near_copies(documents(spark, rows)).select("text").collect()
    assert {r["text"] for r in kept} == {rows[0][1], rows[3][1]}


def test_near_dedup_of_odd_rows(spark):
    text = "one two three four five six seven"
    long = sentence(20_000)
    rows = [(1, None, None), (2, "", None), (3, "!!", None), (4, text, None), (5, text.upper() + "!", None), (5, text, None), (None, text, None), (None, "nobody else says this", None), (6, "hi", None), (7, "hi", None), (8, long, None), (9, long + " end", None)]
    got = sorted(((r["doc_id"], r["class_id"], r["class_size"], r["kept"]) for r in near_dedup.near_duplicates(documents(spark, rows)).collect()), key=str)
    want = [(1, 1, 1, True), (2, 2, 1, True), (3, 3, 1, True), (4, 4, 4, True), (5, 4, 4, False), (5, 4, 4, False), (None, 4, 4, False), (None, None, 1, True), (6, 6, 2, True), (7, 6, 2, False), (8, 8, 2, True), (9, 8, 2, False)]
    assert got == sorted(want, key=str)
    assert near_dedup.near_duplicates(documents(spark, []).limit(0)).count() == 0
    kept = near_dedup.drop_near_copies(documents(spark, [r for r in rows if r[0]]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 8]


def test_bands_use_all_coordinates():
    assert near_dedup.ROWS * near_dedup.BANDS == near_dedup.COORDINATES
    assert (1 - 0.8**near_dedup.ROWS) ** near_dedup.BANDS < 1e-7


def test_near_copies_are_dropped_row_by_row(spark):
    text = "one two three four five six seven"
    rows = [(1, text, None), (None, text, None), (None, "nobody else says this", None), (None, None, None), (2, text + "!", None), (2, "some other words stay here", None)]
    kept = near_dedup.drop_near_copies(documents(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([r[:2] for r in (rows[0], rows[2], rows[3], rows[5])], key=str)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in near_dedup.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_components_leave_the_planner_a_known_size(spark, capsys):
    """A guess that is multiplied by every round's joins ends in more digits than a driver holds."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    found = near_dedup.components(edges)
    capsys.readouterr()
    found.explain("cost")
    sizes = re.findall(r"sizeInBytes=([0-9.E+]+) (\w+)", capsys.readouterr().out)
    assert sizes and all(unit in ("B", "KiB", "MiB") for _, unit in sizes)



def test_a_worker_holds_lots_and_not_whole_batches(spark, monkeypatch):
    docs = documents(spark, [(1, "a b c", None)])
    steps = []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, kinds: (steps.append(run), plain(self, run, kinds))[1])
    monkeypatch.setattr(near_dedup, "LOT", 20_000)
    near_dedup._bag_cells(docs, spark.createDataFrame([(1, b"x")], "key long, bag binary"), "doc_id", "text", 5)
    # Two shingles each, of very long words: what a batch's texts take shows, and not what NumPy does.
    texts = [" ".join(f"{c}{i:0>1500}" for c in "abcdef") for i in range(1_000)]
    size = sum(map(len, texts))
    bags = near_dedup._bags(*occurrences(*shingles(texts)), len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(bags, pa.binary())], names=["body", "bag"])
    del texts
    tracemalloc.start()
    try:
        made = [out.column("bag") for out in steps[-1](iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert pa.chunked_array(made).to_pylist() == bags
    assert peak < size / 2


def test_tables_of_few_rows_rest_in_few_files(spark, monkeypatch):
    kept = []
    plain = near_dedup.rest
    monkeypatch.setattr(near_dedup, "rest", lambda *args: (kept.append(plain(*args)), kept[-1])[1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.range(300).selectExpr("id % 20 as a", "id as b")
        assert {r["label"] for r in near_dedup.components(edges).collect()} == set(range(20))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [len(t.inputFiles()) for t in kept[1:]] == [1] * (len(kept) - 1)
