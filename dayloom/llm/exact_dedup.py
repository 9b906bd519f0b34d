"""Exact duplicates by skew-safe combining, with DataFrame functions only.

Three stages, each comparing whole texts and not only digests: copies in one input partition
collapse in the map-side combine; the partial groups of one digest meet per salt; the salt winners
meet once per text. A text held by a third of all rows reaches the last stage as at most `salts`
rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.skew import SALTS, salt, salted_lookup


def sha256(text: Column) -> Column:
    """The SHA-256 digest of a text as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """(digest, keep_id, group_size, n_texts): one row per digest, from three stages of combining.

    NULL texts count as empty. The largest id of a group stays; NULL ids lose against any other.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.select("id", "body", digest(F.col("body")).alias("digest"), salt("id", salts).alias("salt"))
    salted = rows.groupBy("digest", "salt", "body").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("digest", "body").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    return winners.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("n_texts")
    )


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for every row of `docs`, dropped ones too.

    Texts are equal when they are the same code points; NULL is the empty text. Rows that repeat
    an id and a text count in `group_size` and carry the same decision. An empty table gives no
    rows. Other columns are ignored, whatever their names. Should two different texts share a
    digest, the job fails and says so: groups are compared by content, and only a digest proven
    to stand for one text is used to lead rows back to their group.
    """
    groups = exact_groups(docs, id, text, salts, digest).filter("group_size > 1")
    groups = groups.withColumn(
        "keep_id",
        F.when(F.col("n_texts") == 1, F.col("keep_id")).otherwise(
            F.raise_error(F.lit("two texts share a digest; pass another digest")).cast(docs.schema[id].dataType)
        ),
    ).drop("n_texts")
    rows = docs.select(F.col(id).alias("id"), digest(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    found = salted_lookup(rows, groups, "digest", "id", salts)
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id), keep.alias("keep_id"), size.alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), "digest",
    )


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that `exact_dedup` keeps, with all their columns.

    Rows are told by id and text, so that a dropped row goes also where another row with its id stays.
    """
    kept = exact_dedup(docs, id, text).filter("kept").select(F.col(id).alias("__kept_id"), F.col("digest").alias("__kept_digest")).distinct()
    digest = sha256(F.coalesce(docs[text], F.lit("")))
    return docs.join(kept, docs[id].eqNullSafe(F.col("__kept_id")) & (digest == F.col("__kept_digest")), "left_semi")
