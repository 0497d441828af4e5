"""Term mining: tokens, frequencies, ids by term, clustering of terms by embedding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..plans.checkpoints import cut
from .cleaning import number_rows
from .postings import postings
from .vectors import class_links, leaders, vector_classes


def term_rows(df: DataFrame, columns: list[str], key: str, custom: list[str] | None = None) -> DataFrame:
    """(termo, id, n): how often each row's text columns hold a term. Null texts hold none.

    Terms are counted within a row before anything is shuffled, so a frequent word costs a row a text at most.
    """
    words = F.flatten(F.array(*[tokens(F.col(f"`{c}`").cast("string"), custom) for c in columns]))
    return df.select(F.col(f"`{key}`").alias("id"), F.explode(words).alias("termo")).groupBy("termo", "id").agg(F.count("*").alias("n"))


def term_frequency(df: DataFrame, columns: list[str], key: str, custom: list[str] | None = None, unique: bool | None = None) -> DataFrame:
    """(termo, frequencia, ids_unicos), most frequent first, then by term.

    Where no two rows share a key, which is looked up unless ``unique`` says so, a row tells its terms' first
    occurrences itself and only counts by term are shuffled; else pairs of term and id are.
    """
    if unique is None:
        unique = df.where(F.col(f"`{key}`").isNull()).isEmpty() and df.groupBy(F.col(f"`{key}`")).count().where("count > 1").isEmpty()
    if unique:
        words = F.sort_array(F.flatten(F.array(*[tokens(F.col(f"`{c}`").cast("string"), custom) for c in columns])))
        first = F.transform(F.array(words), lambda w: F.transform(w, lambda x, i: F.struct(x.alias("termo"), F.when(F.get(w, i - 1) == x, 0).otherwise(1).alias("new"))))[0]
        found = df.select(F.explode(first).alias("t")).select("t.*").groupBy("termo").agg(F.count("*").alias("frequencia"), F.sum("new").alias("ids_unicos"))
    else:
        found = term_rows(df, columns, key, custom).groupBy("termo").agg(F.sum("n").alias("frequencia"), F.count("*").alias("ids_unicos"))
    return found.orderBy(F.desc("frequencia"), "termo")


def terms_frequency(df: DataFrame, columns: list[str], key: str, model, size: int, threshold: float = 0.8, custom: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequencies of terms, their ids, and (termo, base): the first term, in order of frequency, that each is like.

    ``model`` maps a list of terms to vectors; a term's place is its rank, so the commonest terms lead.
    """
    frequency = cut(term_frequency(df, columns, key, custom))
    ranked = cut(number_rows(frequency, [F.desc("frequencia"), F.asc("termo")], "pos").select((F.col("pos").cast("long") - 1).alias("pos"), "termo"))
    found = embedding_clusters(embed(ranked, "termo", model, size).select("pos", "v"), threshold)
    named = found.join(ranked, "pos").join(ranked.select(F.col("pos").alias("leader"), F.col("termo").alias("base")), "leader")
    return frequency, term_ids(df, columns, key, custom), named.select("termo", "base")


def term_ids(df: DataFrame, columns: list[str], key: str, custom: list[str] | None = None) -> DataFrame:
    """The distinct ids of each term as ``postings`` by termo: sorted blocks of a bounded size."""
    return postings(term_rows(df, columns, key, custom).select("termo", "id"), ["termo"])


def cosine_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """vectors (pos, v) -> (pos, earlier, cosine) of all pairs of different vectors at the threshold or above, in double
    precision. Equal vectors are one, at its first place: ``vectors.vector_classes`` tells which, ``link_counts`` how many."""
    return class_links(vector_classes(vectors)[0], threshold)


def embedding_clusters(vectors: DataFrame, threshold: float = 0.8) -> DataFrame:
    """vectors (pos, v) -> (pos, leader): leader clustering in order of pos."""
    return leaders(vectors, threshold)


def embed(df: DataFrame, column: str, model, size: int) -> DataFrame:
    """``df`` and ``v``: vectors from ``model``, a callable from a list of texts to a matrix, loaded once in each worker."""
    schema = T.StructType([*df.schema.fields, T.StructField("v", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            made = np.asarray(model(texts), np.float32).reshape(len(texts), size) if texts else np.zeros((0, size), np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.tolist(), pa.list_(pa.float32()))], [*batch.schema.names, "v"])

    return df.mapInArrow(run, schema)
