"""Encoding, decoding, token counts and chat formatting against the library and by reading back."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from dayloom.llm import chat, pieces, token_counts
from tests.llm.helpers import documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", "a", " a", "  a  b\n\tc </s> <s> ", "▁x ▁▁ y", "日本語 😀\x00é́", "a\n\n b \n  ", "<unk> <0x0A>", "x" * 300 + " " * 20,
    "﻿   t\r\n", "▁", " ", "\n", "the quick brown fox. " * 3000, "z" * 20_000, "«Ünïcödé» — ‘quotes’",
]


def random_texts(n):
    rng = random.Random(3)
    parts = ["the", "Straße", " ", "  ", "\n", "▁", ".", ",", "123", "été", "😀", "\t", "ing", "</s>", "ß", "the the", "q", "​"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_counts_equal_the_library(library):
    texts = [t or "" for t in ODD] + random_texts(500)
    want = library.encode(texts)
    model = pieces.PieceModel(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)] == want
    assert token_counts.TokenCounter(model).count(texts) == [len(x) for x in want]


def test_a_full_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    texts = random_texts(50)
    model = pieces.PieceModel(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in model.encode([t])] == library.encode(texts)


def test_whole_tokens_are_proven(library):
    model = pieces.PieceModel(PATH)
    whole = token_counts.whole_tokens(model)
    assert len(whole) > 30_000
    for piece in random.Random(1).sample([p for p in whole if p.startswith("▁") and p.count("▁") == 1 and len(p) > 1], 300):
        assert library.encode(piece[1:]) == [library.piece_to_id(piece)]


def test_spans_cover_the_text_in_order():
    model = pieces.PieceModel(PATH)
    for text in [t or "" for t in ODD] + random_texts(200):
        (ids,) = model.encode([text])
        spans, data = model.spans(text, ids), text.encode()
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        if len(spans):
            assert spans[0][0] == 0 and spans[-1][1] == len(data)
        for i, (a, b) in zip(np.frombuffer(ids, "<u4"), spans, strict=True):
            if model.kinds[i] == pieces.NORMAL:
                shown = data[a:b].decode().replace(" ", "▁")
                assert model.pieces[i] in (shown, f"▁{shown}")


def test_normaliser_follows_a_compiled_character_map():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    (spec,) = [v for number, _, v, _, _ in pieces._fields(library.serialized_model_proto()) if number == pieces.NORMALIZER]
    normaliser = pieces.Normaliser(spec)
    for text in ["ＡＢＣ  ①  ", "ﬁ ½ é ㍿ x", "  a  b ", "", "   ", "ガ \xa0​z", "plain"] + random_texts(200):
        made = normaliser(text)
        assert made.data.decode() == library.normalize(text) == normaliser.text(text)
        assert len(made.begin) == len(made.end) == len(made.data)
        assert (made.begin <= made.end).all() and (np.diff(made.begin.astype(int)) >= 0).all()
    made = normaliser("x ㍿!")
    at = made.data.index("株".encode())
    assert (made.begin[at], made.end[at]) == (2, 5) and made.begin[made.data.index(b"!")] == 5


def test_a_worker_remembers_no_segments_of_a_task_that_ended(spark, monkeypatch):
    docs = documents(spark, [(1, "a b", None)])
    steps = []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, kinds: (steps.append(run), plain(self, run, kinds))[1])
    pieces.encoding_digests(docs, PATH)
    made = list(steps[-1](iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b", None])], names=["doc_id", "__text"])] * 2)))
    assert [b.column(1).to_pylist() for b in made] == [[4, 2]] * 2
    assert not pieces.piece_model(PATH).remembered


def test_encode_and_decode_of_odd_rows(spark, library):
    docs = documents(spark, [(i, t, None) for i, t in enumerate(ODD)] + [(None, "a b", None), (0, None, None)])
    coded = pieces.encode(docs, PATH)
    got = {r["doc_id"]: r for r in coded.collect()}
    assert coded.count() == len(ODD) + 2
    for i, t in enumerate(ODD):
        assert got[i]["ids"] == library.encode(t or "", add_bos=True, add_eos=True)
        assert len(got[i]["begins"]) == len(got[i]["ends"]) == len(got[i]["ids"])
    back = {r["doc_id"]: r["text"] for r in pieces.decode(coded, PATH).collect()}
    digests = {r["doc_id"]: r for r in pieces.encoding_digests(docs, PATH).collect()}
    for i in range(len(ODD)):
        assert back[i] == library.decode(got[i]["ids"])
        assert digests[i]["n_tokens"] == len(got[i]["ids"])
        assert digests[i]["ids_sha256"] == hashlib.sha256(np.array(got[i]["ids"], "<u4").tobytes()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(back[i].encode()).hexdigest()
    assert pieces.encode(docs.limit(0), PATH).count() == pieces.decode(coded.limit(0), PATH).count() == 0


def test_count_tokens_of_odd_rows(spark, library):
    docs = documents(spark, [(i, t, None) for i, t in enumerate(ODD)])
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, PATH, limit=100).collect()}
    for i, t in enumerate(ODD):
        n = len(library.encode(t or ""))
        assert tuple(got[i])[1:] == (len((t or "").encode()), n, n > 100)
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


TRICKY = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "[\\INST]", "<<s>s>", "[[INST]INST]\n", "", "plain", "</s>\n<s>[INST]user[/INST]"]


def test_escape_is_reversible():
    rng = random.Random(5)
    texts = TRICKY + ["".join(rng.choices(["<", "s", ">", "/", "[", "INST", "]", "\\", "x"], k=12)) for _ in range(2000)]
    for t in texts:
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROL)
    turns = [(r, t) for t in texts[:200] for r in ("user", "assistant", "a[/INST]b")]
    assert chat.read_turns(chat.format_turns(turns, [True] * len(turns))[0]) == turns


def conversations(spark):
    rng = random.Random(9)
    rows = []
    for conv, n in ((1, 3), (2, 40), (3, 1), (4, 700), (5, 2)):
        for i in range(n):
            role = "system" if i == 0 and conv in (2, 4) else "user" if i % 2 else "assistant"
            rows.append((conv, i, role, rng.choice(TRICKY) + " ".join(["word"] * rng.randrange(1, 60))))
    rows += [(6, None, None, None), (6, 0, "user", None), (6, 1, "assistant", "same"), (6, 1, "assistant", "same"), (6, 5, None, "x")]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (7, 0, "assistant", "word " * 5000), (7, -3, "system", "be brief")]
    return rows, spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'z' as tokens", "1 as own", "'q' as system", "2 as block", "'w' as window")


def in_order(rows):
    convs = {}
    for c, n, r, t in rows:
        convs.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    return {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in convs.items()}


def test_chat_windows_read_back(spark):
    rows, table = conversations(spark)
    rules = chat.ChatRules(budget=200, history_turns=2, history_tokens=80, block=64)
    windows = chat.chat_windows(table, PATH, rules)
    listed = windows.orderBy("conv", "block", "window").collect()
    want = in_order(rows)
    read, masked = {}, {}
    for w in listed:
        turns = chat.read_turns(w["formatted"])
        read.setdefault(w["conv"], []).extend(turns[w["repeated"] :])
        masked.setdefault(w["conv"], []).extend(chat.unescape(w["formatted"][s["start"] : s["end"]]) for s in w["loss"])
        whole = want[w["conv"]]
        if w["repeated"] and whole[0][0] == "system":
            assert turns[0] == whole[0]
    assert read == want
    assert masked == {c: [t for r, t in ts if r == "assistant"] for c, ts in want.items() if c in masked}
    # History was repeated somewhere, and no window but those of one long turn is far over the budget.
    assert any(w["repeated"] >= 2 for w in listed)
    digests = {r["conv_id"]: r for r in chat.conversation_digests(windows).collect()}
    for c, ts in want.items():
        said = "".join(t for r, t in ts if r == "assistant")
        assert digests[c]["n_turns"] == len(ts)
        assert digests[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        assert (digests[c]["loss_chars"], digests[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert digests[c]["formatted_chars"] == sum(len(w["formatted"]) for w in listed if w["conv"] == c)
    assert chat.conversation_digests(chat.chat_windows(table.limit(0), PATH)).count() == 0


def test_chat_windows_keep_to_the_budget(spark):
    counter = token_counts.token_counter(PATH)
    rows, table = conversations(spark)
    rows += [(8, 0, "user", "word " * 999), (8, 1, "assistant", "word " * 999)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for budget in (40, 200, 1024):
        rules = chat.ChatRules(budget=budget, history_turns=0, block=64)
        for w in chat.chat_windows(table, PATH, rules).collect():
            turns = chat.read_turns(w["formatted"])
            own, lead = turns[w["repeated"] :], turns[: w["repeated"]]
            sizes = counter.count([t for _, t in [*own, *lead]])
            assert len(own) == 1 or sum(sizes) <= budget, (w["conv"], budget)
            assert all(r == "system" for r, _ in lead)


def test_conversations_are_named_by_anything(spark):
    rows = [("a/1", 0, "user", "q"), ("a/1", 1, "assistant", "said"), ("b", 0, "assistant", "x"), (None, 0, "user", "lost")]
    table = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.conversation_digests(chat.chat_windows(table, PATH)).collect()}
    assert got == {"a/1": 2, "b": 1, None: 1}


def test_the_registered_queries_on_the_given_tables(spark, sf_dir, library):
    """op2, op3 and op10 against the library and plain Python, on every row."""
    from dayloom.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    encoded = {r["doc_id"]: r for r in QUERIES["op2_sentencepiece"](spark, sf_dir).collect()}
    counted = {r["doc_id"]: r for r in QUERIES["op3_token_counts"](spark, sf_dir).collect()}
    assert encoded.keys() == counted.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert encoded[i]["n_tokens"] == len(ids) and encoded[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert encoded[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert tuple(counted[i])[1:4] == (len(t.encode()), len(ids) - 2, len(ids) - 2 > 4096)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in QUERIES["op10_chat_format"](spark, sf_dir).collect()}
    want = in_order(rows)
    assert got.keys() == want.keys() and -1 in got
    for c, ts in want.items():
        said = "".join(t for r, t in ts if r == "assistant")
        assert got[c]["n_turns"] == len(ts) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
