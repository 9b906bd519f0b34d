"""The queries op1 to op13: each applies its operator to a whole table and digests the result."""

import public_tokenizers
from pyspark.sql import functions as F

from dayloom.llm import chat, collocations, decontaminate, divergence, exact_dedup, language, line_dedup, near_dedup, pieces, quality, secret_scan, token_counts, toxicity
from dayloom.llm.registry import QUERIES, SQL, query, table
from dayloom.llm.sql import COLLOCATIONS_SQL, DECONTAMINATE_SQL, DIVERGENCE_SQL, EXACT_DEDUP_SQL, LINE_DEDUP_SQL, SECRET_SCAN_SQL

__all__ = ["QUERIES", "SQL"]

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


@query("op1_line_dedup", LINE_DEDUP_SQL)
def op1_line_dedup(spark, folder):
    docs = table(spark, folder, "documents")
    index = line_dedup.build_index(docs, min_docs=10, min_chars=1)
    kept = line_dedup.drop_repeated_lines(docs, index)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_sentencepiece")
def op2_sentencepiece(spark, folder):
    return pieces.encoding_digests(table(spark, folder, "documents"), PIECE_MODEL)


@query("op3_token_counts")
def op3_token_counts(spark, folder):
    return token_counts.count_tokens(table(spark, folder, "documents"), PIECE_MODEL, limit=4096)


@query("op4_near_dedup")
def op4_near_dedup(spark, folder):
    return near_dedup.near_duplicates(table(spark, folder, "documents"), threshold=0.8)


@query("op5_language_id")
def op5_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = language.held_out(F.col("doc_id"))
    model = language.fit(docs.filter(~held_out))
    flags = docs.select("doc_id", "text", held_out.alias("held_out"))
    return language.predict(flags, model, keep=["held_out"])


@query("op6_exact_dedup", EXACT_DEDUP_SQL)
def op6_exact_dedup(spark, folder):
    rows = exact_dedup.exact_dedup(table(spark, folder, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op7_decontaminate", DECONTAMINATE_SQL)
def op7_decontaminate(spark, folder):
    leaks = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), threshold=0.8)
    return leaks.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"), F.col("start").cast("long").alias("start"))


@query("op8_secret_scan", SECRET_SCAN_SQL)
def op8_secret_scan(spark, folder):
    found = secret_scan.secret_spans(table(spark, folder, "documents"))

    def count(kind):
        wanted = secret_scan.KINDS.index(kind)
        return F.size(F.filter("base", lambda s: s["kind"] == wanted)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
    )


@query("op9_toxicity")
def op9_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), categories=("quality", "toxic"))
    return toxicity.predict(docs, model).select(
        "doc_id", F.col("is_toxic").alias("toxic"), F.col("p_toxic").alias("score"), F.col("p_quality").alias("quality_score")
    )


@query("op10_chat_format")
def op10_chat_format(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).selectExpr("-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{said}' as text")
    return chat.conversation_digests(chat.chat_windows(turns.unionByName(extra), PIECE_MODEL))


@query("op11_collocations", COLLOCATIONS_SQL)
def op11_collocations(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"), longest=3, least=10, top=2000)


@query("op12_quality")
def op12_quality(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = quality.held_out(F.col("doc_id"))
    model = quality.fit(docs.filter(~held_out), table(spark, folder, "labels"))
    return quality.predict(docs.withColumn("held_out", held_out), model, keep=["held_out"])


@query("op13_source_divergence", DIVERGENCE_SQL)
def op13_source_divergence(spark, folder):
    return divergence.source_divergence(table(spark, folder, "documents"))
