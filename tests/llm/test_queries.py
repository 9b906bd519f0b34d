"""The queries against their SQL, and the pipeline against brute force."""

import hashlib
import os
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

import check_queries  # noqa: E402
import corpus_pipeline  # noqa: E402
from dayloom.llm import language, toxicity  # noqa: E402
from dayloom.llm.queries import PIECE_MODEL, QUERIES, SQL  # noqa: E402
from dayloom.runtime import BATCH_BYTES  # noqa: E402
from tests.llm.helpers import classes  # noqa: E402
from tests.llm.test_text import leaks_by_hand  # noqa: E402


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = check_queries.rows(df.columns, [tuple(r) for r in df.collect()])
    cur = check_queries.duck(sf_dir).execute(SQL[name])
    assert got == check_queries.rows([d[0] for d in cur.description], cur.fetchall())


def test_near_dedup_matches_all_pairs(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op4_near_dedup"](spark, sf_dir).collect()}
    assert got == classes(rows)


def test_language_query_is_accurate(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in QUERIES["op5_language_id"](spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held) > 0


def gram_buckets(text):
    """n-gram counts of one to three letters by hand: runs of anything else are one space behind a letter."""
    from collections import Counter

    low, chars = text.lower(), []
    for i, c in enumerate(low + "\n"):
        if c.isalpha():
            chars.append(ord(c))
        elif i and low[i - 1].isalpha():
            chars.append(32)
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            if n == 1 and chars[i] == 32:
                continue
            h = 0
            for c in chars[i : i + n]:
                h = (h * 0x100000001B3 + c) % 2**64
            h = (h + n) % 2**64
            h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
            h = (h ^ (h >> 27)) * 0x94D049BB133111EB % 2**64
            out[(h ^ (h >> 31)) % language.DIMENSIONS] += 1
    return out


def test_language_query_equals_plain_python(spark, sf_dir):
    import zlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "", r["lang"], zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in docs.collect()]
    grams = {i: gram_buckets(t) for i, t, _, _ in rows}
    model = language.fit(docs.filter("crc32(cast(doc_id as string)) % 5 != 0"))
    learned = [i for i, t, lang, held in rows if not held and lang and any(c.isalpha() for c in t)]
    seen = Counter(b for i in learned for b in grams[i])
    idf = np.log((1 + len(learned)) / (1 + np.array([seen[b] for b in range(language.DIMENSIONS)]))) + 1
    assert np.allclose(model.idf, idf)
    got = {r["doc_id"]: r for r in QUERIES["op5_language_id"](spark, sf_dir).collect()}
    assert got.keys() == grams.keys()
    for i, t, _, held in rows:
        v = np.zeros(language.DIMENSIONS)
        for b, n in grams[i].items():
            v[b] = np.log1p(n) * idf[b]
        assert got[i]["held_out"] == held
        if not any(c.isalpha() for c in t):
            assert got[i]["lang_pred"] == "und"
            continue
        cosine = model.centroids @ (v / np.linalg.norm(v))
        best = int(np.argmax(cosine))
        assert got[i]["score"] == pytest.approx(min(max(cosine[best], 0), 1), abs=1e-5)
        assert got[i]["lang_pred"] == model.languages[best] or np.sort(cosine)[-1] - np.sort(cosine)[-2] < 1e-5


def test_toxicity_is_accurate_on_labels_it_has_not_seen(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, marks.filter("crc32(cast(doc_id as string)) % 3 != 0"))
    got = {r["doc_id"]: r["is_toxic"] for r in toxicity.predict(docs, model).collect()}
    unseen = {r["doc_id"]: bool(r["toxic"]) for r in marks.filter("crc32(cast(doc_id as string)) % 3 = 0").collect()}
    assert len(unseen) > 60 and sum(got[i] == y for i, y in unseen.items()) >= 0.95 * len(unseen)


def test_toxicity_query_equals_the_chain_without_spark(spark, sf_dir):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    marks = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    learn = sorted((i, t) for i, t in text.items() if i in marks and t is not None)
    chain = toxicity.fit_chain([t for _, t in learn], np.array([marks[i] for i, _ in learn]) > 0, ("quality", "toxic"))
    got = {r["doc_id"]: r for r in QUERIES["op9_toxicity"](spark, sf_dir).collect()}
    p = chain.probabilities([t or "" for t in text.values()])
    for i, row in zip(text, p, strict=True):
        assert got[i]["quality_score"] == pytest.approx(row[0], abs=1e-6) and got[i]["score"] == pytest.approx(row[1], abs=1e-6)
        assert got[i]["toxic"] == (row[1] >= chain.thresholds[1]) or abs(row[1] - chain.thresholds[1]) < 1e-6


def pipeline_by_hand(docs, kept_first, benchmark):
    """The stages after language ID, document by document."""
    docs = [(i, t) for i, t in docs if i in kept_first]
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower()
    seen = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")})
    docs = [(i, "\n".join(x for x in (t or "").split("\n") if not (key(x) and seen[key(x)] >= 10))) for i, t in docs]
    first = classes(docs)
    docs = [(i, t) for i, t in docs if first[i] == i]
    leaks = {i for i, _ in leaks_by_hand(docs, benchmark)}
    return {i: t for i, t in docs if i not in leaks}


def test_pipeline_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert first.columns == corpus_pipeline.COLUMNS
    benchmark = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = pipeline_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], {r["doc_id"] for r in first.collect()}, benchmark)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(want)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for i, t in want.items():
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_pipeline_sends_small_batches_to_python(spark, sf_dir, monkeypatch):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 4000, 1, 1).selectExpr("id as doc_id", "repeat('word ', 400) as text", "'en' as lang", "'x' as source", "2000L as n_chars")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    try:
        corpus_pipeline.encode_pieces(spark, docs, sf_dir)
        seen = docs.mapInArrow(sizes, "n long, bytes long").collect()
        # A batch ends with the row that passes the limit.
        assert sum(r["n"] for r in seen) == 4000 and max(r["bytes"] for r in seen) < BATCH_BYTES + 10_000
        spark.conf.set(limit, "100000b")
        corpus_pipeline.encode_pieces(spark, docs, sf_dir)
        assert spark.conf.get(limit) == "100000b"
    finally:
        spark.conf.unset(limit)
    # The other stages do so too, before anything else.
    stopped = InterruptedError()
    monkeypatch.setattr(corpus_pipeline, "small_batches", lambda spark: (_ for _ in ()).throw(stopped))
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(InterruptedError):
            stage(spark, docs, sf_dir)


def test_pipeline_stages_bear_odd_documents(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 !", None, "s", 4), (None, "words without an id", "en", None, 19), (4, "x " * 30_000, "de", "s", 60_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for odd in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, odd, sf_dir).columns == corpus_pipeline.COLUMNS
            stage(spark, odd, sf_dir).count()
        assert corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir).count() == odd.count()
