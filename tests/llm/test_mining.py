"""Collocations, quality scores and source divergence against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from dayloom.llm import collocations, divergence, quality, sieve
from dayloom.llm.queries import QUERIES
from tests.llm.helpers import documents

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", "  \t ", "...", "\n\n", "One", "one two", "ONE two; one TWO, one\ttwo", "É é É é. É é", "x" * 50_000, "a b " * 2_000 + "a", "tail\x0bof\x0ca text\r"]


def phrases_by_hand(rows, longest=3):
    """(lang, phrase) -> count, and lang -> words."""
    counts, words = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(ws)
            for n in range(1, longest + 1):
                counts.update((lang or "und", tuple(ws[i : i + n])) for i in range(len(ws) - n + 1))
    return counts, words


def collocations_by_hand(rows, longest=3, least=10, top=2000):
    counts, words = phrases_by_hand(rows, longest)
    rated = defaultdict(list)
    frequent = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in frequent.items():
        longer = [b for (other, q), b in frequent.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        rated[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, words[lang], -s) for lang, found in rated.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def invented(n, rng, words="ab cd ef gh ij kl É".split()):
    marks = [" ", " ", " ", "\t", ", ", ". ", "\n"]
    return ["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("top, longest", [(2000, 3), (4, 3), (2000, 4)])
def test_collocations_match_plain_counting(spark, top, longest):
    rng = random.Random(top + longest)
    texts = invented(120, rng) + ODD + ["very HOT text here. very hot text here"] * 40
    rows = [(i % 90 if i % 7 else None, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts)]
    got = collocations.collocations(documents(spark, rows).repartition(5), longest=longest, top=top).collect()
    want = collocations_by_hand([(t, lang) for _, t, lang in rows], longest, top=top)
    assert sorted(map(tuple, got)) == want and len(want) > 8


def test_collocations_in_small_lots_and_hand_overs(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LOT", 200)
    monkeypatch.setattr(collocations, "MOST", 100)
    rows = [(i, t, "en") for i, t in enumerate(invented(80, random.Random(3)))]
    got = collocations._lot_counts(collocations.Lot([t for _, t, _ in rows]), range(4), np.zeros(80, np.uint64), np.arange(80))
    assert got[2].sum() == sum(phrases_by_hand([(t, "en") for _, t, _ in rows])[0].values()) + phrases_by_hand([(t, "en") for _, t, _ in rows])[1]["en"]
    found = collocations.collocations(documents(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, found)) == collocations_by_hand([(t, lang) for _, t, lang in rows])


def test_equal_fingerprints_of_different_words_stay_apart(monkeypatch):
    lot = collocations.Lot(["aa bb aa cc, bb aa", "cc dd aa bb"])
    lot.hash = lot.hash & np.uint64(1)  # Many collisions: words are then told apart by their bytes.
    named = defaultdict(set)
    for number, a, b in zip(lot.numbers(), lot.start, lot.end, strict=True):
        named[lot.bytes[a:b]].add(int(number))
    assert all(len(x) == 1 for x in named.values()) and len(set.union(*named.values())) == len(named) == 4
    real = collocations.Lot(["aa bb aa cc, bb aa", "cc dd aa bb"])
    real.hash = real.hash & np.uint64(1)
    key, check, n, _ = collocations._lot_counts(real, range(3), np.zeros(2, np.uint64), np.arange(2))
    # Fingerprints collide here, but with their checks they count each run of words on its own.
    assert sorted(n) == sorted([*Counter("aa bb aa cc bb aa cc dd aa bb".split()).values(), *Counter(["aa bb", "bb aa", "aa cc", "bb aa", "cc dd", "dd aa", "aa bb"]).values(), 10])
    real.check = real.check & np.uint64(0)
    with pytest.raises(ValueError, match="share a fingerprint"):
        collocations._lot_counts(real, range(3), np.zeros(2, np.uint64), np.arange(2))


def test_a_lot_sorts_its_runs_once(monkeypatch):
    texts = invented(80, random.Random(4))
    counts, _ = phrases_by_hand([(t, "en") for t in texts])
    monkeypatch.setattr(collocations, "_combined", lambda *_: pytest.fail("sorted again"))
    for least, bits in ((1, None), (2, np.full(1 << 12, 255, np.uint8))):
        want = {k: n for k, n in counts.items() if len(k[1]) >= least}
        key, _, n, _ = collocations._lot_counts(collocations.Lot(texts), range(least, 4), np.zeros(80, np.uint64), np.arange(80), bits)
        assert len(set(key)) == len(key) and sorted(n) == sorted(want.values())


def test_words_are_told_apart_eight_bytes_at_a_time(monkeypatch):
    long = ["a" * n for n in (1, 7, 8, 9, 16, 17, 300)]
    own = [*long, *(w[:-1] + "b" for w in long), *(w + "\0" for w in long), "a" * 299 + "é", "b" + "a" * 16]
    lot = collocations.Lot([" ".join(own * 3), "", ". ".join(own)])
    assert len(set(lot.check)) == len(own)
    lot.hash = lot.hash & np.uint64(3)
    numbers = lot.numbers().reshape(4, len(own))
    assert len(set(numbers[0])) == len(own) and (numbers == numbers[0]).all()


def test_a_full_sieve_loses_nothing(spark, monkeypatch):
    rows = [(i, t, "en") for i, t in enumerate(invented(80, random.Random(9), "ab cd ef".split()))]
    want = collocations_by_hand([(t, lang) for _, t, lang in rows])
    for most, row in ((1 << 27, 1 << 12), (8, 1), (64, 1)):
        monkeypatch.setattr(sieve, "MOST_BITS", most)
        monkeypatch.setattr(sieve, "SIEVE_ROW", row)
        assert sorted(map(tuple, collocations.collocations(documents(spark, rows)).collect())) == want and want


def test_a_fingerprint_that_leads_nowhere_is_an_error(spark):
    rows = documents(spark, [(1, "a b", "en")], clash=False).selectExpr("lang", "text as body", "xxhash64(lang, text) as pointer")
    wrong = rows.selectExpr("pointer", "5L as key", "6 as check", "12L as n")
    with pytest.raises(Exception, match="lead to one phrase"):
        collocations._materialised(rows, wrong, 3).collect()


def test_collocations_of_empty_tables(spark):
    assert collocations.collocations(documents(spark, []).limit(0)).count() == 0
    assert collocations.collocations(documents(spark, [(1, None, None), (None, "", "en")])).count() == 0


def divergence_by_hand(rows, min_docs=10, top=10):
    rows = [(text or "", lang or "", source or "") for text, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, counts = Counter(), defaultdict(Counter)
        for text, where, source in rows:
            if where == lang:
                terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOW))
                docs.update(set(terms))
                counts[source].update(terms)
        kept = [t for t, n in docs.items() if n >= min_docs]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = shares(sum(counts.values(), Counter()))
        p = {s: shares(c) for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in p if o != s)
            terms = sorted((-f(p[s][t], whole[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > whole[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def test_divergence_matches_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_TERMS", 50)
    rng = random.Random(5)
    letters = "abcdefgÉß"
    texts = [" ".join("".join(rng.choices(letters, k=rng.choice([1, 1, 2]))) for _ in range(rng.randrange(30))) + rng.choice(["", "!", " 1A b"]) for _ in range(300)] + ODD
    rows = [(i % 200 if i % 5 else None, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts)]
    sources = [rng.choice(["s1", "s2", "S2", "é", None]) for _ in rows]
    # A language whose groups keep no term, one with a single source, and a source without a word.
    rows += [(900, "rare", "xx"), (901, None, "xx"), (902, "lonely", "yy"), (903, "12 34", "de")]
    sources += ["s1", "s9", "s1", "s7"]
    docs = spark.createDataFrame([(*r, s, 1, "t") for r, s in zip(rows, sources, strict=True)], "doc_id bigint, text string, lang string, source string, n int, term string")
    got = sorted(map(tuple, divergence.source_divergence(docs.repartition(4)).collect()))
    assert got == divergence_by_hand([(t, lang, s) for (_, t, lang), s in zip(rows, sources, strict=True)])
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_divergence_ranks_a_cell_of_many_equal_terms(spark):
    common = " ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    rows = [(i, common, "en", "s1") for i in range(12)] + [(20 + i, "other words", "en", "s2") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = divergence.source_divergence(docs)
    assert sorted(map(tuple, got.collect())) == divergence_by_hand([r[1:] for r in rows])


def test_terms_are_shuffled_once_and_paired_without_a_join(spark, monkeypatch):
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(divergence, "cut_lineage", cut)
    rows = [(f"ab cd e{'fgh'[i % 3]}", "en", f"s{i % 4}") for i in range(60)]
    got = divergence.source_divergence(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert sorted(map(tuple, got.collect())) == divergence_by_hand(rows)
    assert plans[0].count("Exchange hashpartitioning") == 1
    assert "term" not in "".join(line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)


def test_shares_are_exact_where_products_pass_64_bits(spark):
    rows = [(n, total, 7) for n in (0, 1, 8_999_999_999, 9_000_000_000, 9_000_000_001, 10**12) for total in (n, n + 5, 3 * n + 1)]
    shares = spark.createDataFrame(rows, "n bigint, total bigint, v bigint").selectExpr(divergence._share("n", "total", "v"))
    assert [r[0] for r in shares.collect()] == [1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in rows]


def test_terms_of_long_texts_are_cut_between_terms(monkeypatch):
    text = "ab cdé " * 500 + "z" * 300
    for part in (1 << 20, 17):
        monkeypatch.setattr(divergence, "PART", part)
        n, docs = Counter({b"ab": 1}), Counter()
        divergence.count_terms(text, n, docs)
        assert n == {b"ab": 501, "cdé".encode(): 500, b"z" * 300: 1} and docs == {b"ab": 1, "cdé".encode(): 1, b"z" * 300: 1}


def statistics_by_hand(text):
    chars = [c for c in text]
    words, lines, tokens = text.split(), text.split("\n"), re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    solid = [c for c in chars if ord(c) > 32]
    letters = [c for c in chars if c.isascii() and c.isalpha() or ord(c) >= 128]

    def share(a, b):
        return a / max(b, 1)

    pairs = list(zip(tokens, tokens[1:], strict=False))
    fives = [tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)]
    symbols = [c for c in solid if c.isascii() and not c.isalnum() and c not in ".,;:!?"]
    full = [x for x in lines if x]
    return {
        "log_chars": np.log1p(len(chars)), "log_words": np.log1p(len(words)), "log_lines": np.log1p(len(lines)),
        "letters": share(len(letters), len(solid)), "digits": share(sum(c in "0123456789" for c in chars), len(solid)),
        "sentence_marks": share(sum(c in ".,;:!?" for c in chars), len(solid)), "symbols": share(len(symbols), len(solid)),
        "upper": share(sum(c.isascii() and c.isupper() for c in chars), len(letters)), "blanks": share(len(chars) - len(solid), len(chars)),
        "non_ascii": share(sum(ord(c) >= 128 for c in chars), len(chars)),
        "word_length": np.mean([len(w.encode()) for w in words]) if words else 0, "word_spread": np.std([len(w.encode()) for w in words]) if words else 0,
        "words_per_line": share(len(words), len(lines)), "short_lines": share(sum(len(x.split()) < 5 for x in lines), len(lines)),
        "empty_lines": share(sum(not x.split() for x in lines), len(lines)),
        "distinct_words": 1 - share(len(tokens) - len(set(tokens)), len(tokens)), "commonest_word": share(max(Counter(tokens).values(), default=0), len(tokens)),
        "adjacent_repeats": share(sum(a == b for a, b in pairs), len(tokens)), "repeated_pairs": share(len(pairs) - len(set(pairs)), len(tokens)),
        "repeated_fives": share(len(fives) - len(set(fives)), len(tokens)), "repeated_lines": share(len(full) - len(set(full)), len(lines)),
        "letterless_words": share(sum(not any(c.isascii() and c.isalpha() or ord(c) >= 128 for c in w) for w in words), len(words)),
        "marked_words": share(sum(w[-1] in ".,;:!?" for w in words), len(words)), "marked_lines": share(sum(x[-1] in ".,;:!?" for x in full), len(lines)),
        "commonest_symbol": share(max(Counter(symbols).values(), default=0), len(solid)),
    }


def test_statistics_match_plain_python():
    texts = ["", "A", "!", "\n", "One two.\nTWO two two\n\nend 12 $$$", "same line here\n" * 5, "é É ß x1 €", *invented(20, random.Random(1))]
    made = quality.statistics(texts)
    assert np.isfinite(made).all() and made.shape == (len(texts), len(quality.STATISTICS))
    for text, row in zip(texts, made, strict=True):
        for name, value in statistics_by_hand(text).items():
            assert row[quality.STATISTICS.index(name)] == pytest.approx(value, abs=1e-9), (text, name)
    # Neighbours in a lot don't matter.
    assert np.allclose(made, np.concatenate([quality.statistics([t]) for t in texts]))
    assert quality.statistics([]).shape == (0, len(quality.STATISTICS))


def best_cut_by_hand(x, y, least):
    """The first tree's first cut, by trying every cut between different values."""
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = (0, None)
    for i in range(x.shape[1]):
        values = np.unique(x[:, i])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, i] <= cut
            if least <= left.sum() <= len(y) - least:
                best = max(best, (round(gain(left) + gain(~left) - gain(left | True), 9), (-i, -cut)))
    return -best[1][0], -best[1][1]


def test_trees_find_the_best_cut_and_learn():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 40, (400, 3)).astype(float)
    y = ((x[:, 1] > 17) ^ (x[:, 2] > 30)).astype(float)
    model = quality.fit_trees(x, y, trees=60, depth=3, least=5)
    feature, cut = best_cut_by_hand(x, y, 5)
    assert (model.feature[0][0], model.cut[0][0]) == (feature, cut)
    fresh = rng.integers(0, 40, (1000, 3)).astype(float)
    assert ((model.score(fresh) >= 0.5) == ((fresh[:, 1] > 17) ^ (fresh[:, 2] > 30))).mean() > 0.97
    again = quality.fit_trees(x, y, trees=60, depth=3, least=5)
    assert (again.score(fresh) == model.score(fresh)).all()

    def walk(row):
        total = model.base
        for f, c, v in zip(model.feature, model.cut, model.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(fresh[:50]), [walk(r) for r in fresh[:50]])
    assert len(quality.fit_trees(x, np.ones(400)).value) == 0 and quality.fit_trees(x, np.ones(400)).score(x).min() > 0.99


def test_quality_query_on_labels_it_has_not_seen(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = QUERIES["op12_quality"](spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    unseen = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(unseen) > 50 and np.mean([r["predicted"] == labels[r["doc_id"]] for r in unseen]) >= 0.97
    # The trees themselves, fitted here without Spark on the same rows, give the same scores.
    text = {r["doc_id"]: r["text"] for r in docs}
    learn = sorted(i for i in labels if i in text and zlib.crc32(str(i).encode()) % 3 != 1)
    model = quality.fit_trees(quality.statistics([text[i] or "" for i in learn]), np.array([labels[i] for i in learn], float))
    scores = dict(zip(text, model.score(quality.statistics([t or "" for t in text.values()])), strict=True))
    assert max(abs(r["score"] - scores[r["doc_id"]]) for r in got) < 1e-6


def test_quality_of_odd_tables(spark):
    good, bad = "words in a plain sentence, and more of them.", "$$$ $$$ $$$ ### !!! 0 0 0"
    rows = [(i, (good if i % 2 else bad) + " x" * (i % 9), None) for i in range(60)] + [(100 + i, t, None) for i, t in enumerate(ODD)] + [(None, good, None), (1, good, None)]
    docs = documents(spark, rows)
    marks = [(i, i % 2) for i in range(60)] + [(3, 1), (3, 1), (4, 1), (None, 0), (5, None), (999, 1)]
    labels = spark.createDataFrame([(i, y, "z") for i, y in marks], "doc_id bigint, quality int, statistics string")
    model = quality.fit(docs, labels)
    got = quality.predict(docs, model, keep=["label"]).collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got} == {r[0] for r in rows}
    right = [(r["predicted"], r["doc_id"] % 2) for r in got if r["doc_id"] is not None and r["doc_id"] < 60]
    assert all(a == b for a, b in right)
    # Without labels or documents there is a score all the same.
    for nothing in (quality.fit(docs, labels.limit(0)), quality.fit(docs.limit(0), labels)):
        assert {(r["score"], r["predicted"]) for r in quality.predict(docs, nothing).collect()} == {(0.5, 1)}
    assert quality.predict(docs.limit(0), model).count() == 0
    assert {r["held"] for r in docs.select(quality.held_out(docs.doc_id).alias("held")).filter("doc_id is null").collect()} == {False}


def test_quality_learns_from_a_bounded_sample(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i} " * (i % 5), "t") for i in range(300)], "doc_id bigint, text string, id string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id bigint, quality int")
    assert quality._learned(docs, labels, "quality", "doc_id", "text", 50).count() == 50
    assert len(quality.fit(docs, labels, sample=50).value) == 80
