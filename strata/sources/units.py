"""Adapters that turn tables into units of analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.session import cut, small


def role_of(toxic: Column, quality: Column) -> Column:
    """A unit's role from its labels: toxic units stand for tests, poor ones for accessors."""
    return F.when(toxic == 1, "test").when(quality == 0, "accessor").otherwise("general")


def document_units(docs: DataFrame, labels: DataFrame | None = None, streams: bool = True) -> DataFrame:
    """One unit per document, in the columns of the functions table.

    ``language`` is lang, ``path`` source, ``qualified_name`` and ``pos`` the id;
    tokens are lower-case words, the structural stream is their shapes, sloc counts
    lines with a visible character and cc sentence ends plus one.
    """
    words = T.words(F.col("text"))
    base = docs.select(
        F.col("doc_id").alias("pos"),
        F.col("lang").alias("language"),
        F.col("source").alias("path"),
        F.col("doc_id").cast("string").alias("qualified_name"),
        F.lit(1).alias("start_line"),
        T.code_lines(F.col("text")).alias("sloc"),
        (T.sentence_ends(F.col("text")) + 1).alias("cc"),
        words.alias("tokens"),
    )
    base = base.withColumn("token_count", F.size("tokens")).withColumn("mass", T.mass(F.col("cc"), F.col("sloc")))
    if streams:
        base = base.withColumn("normalized_hash", T.stream_hash(F.col("tokens")))
        base = base.withColumn("token_hashes", T.hashed(F.col("tokens")))
        base = base.withColumn("shingle_seq", T.window_hashes(F.col("token_hashes")))
        base = base.withColumn("shape_hashes", T.hashed(F.transform("tokens", T.shape_class)))
        base = base.withColumn("ast_shingle_seq", T.window_hashes(F.col("shape_hashes")))
        base = base.withColumn("shingles", T.unique_sorted(F.col("shingle_seq")))
        base = base.withColumn("ast_shingles", T.unique_sorted(F.col("ast_shingle_seq")))
    if labels is None:
        base = base.withColumn("role", F.lit("general"))
    else:
        marks = labels.groupBy(F.col("doc_id").alias("pos")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
        base = base.join(small(cut(marks)), "pos", "left").withColumn("role", role_of(F.col("toxic"), F.col("quality"))).drop("toxic", "quality")
    return base.drop("tokens", "token_hashes", "shape_hashes")


def stored_units(docs: DataFrame, labels: DataFrame | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """:func:`document_units`, computed once: the joins below read its streams several times.

    ``columns`` names those wanted, if not all; the others are never computed.
    """
    made = document_units(docs, labels)
    return cut(made.select(*columns) if columns else made)
