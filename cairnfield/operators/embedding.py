"""Interchangeable embedders, vector validation and a text embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.text import tokens
from cairnfield.functions.vectors import is_valid, l2_normalize
from cairnfield.session import cut_lineage

TEXTS_AT_ONCE = 500  # of a Python worker

EmbedFn = Callable[[pd.Series], list]


def isolate(fn: Callable[[object], object]) -> Callable[[pd.Series], tuple[list, list]]:
    """Apply ``fn`` per value, returning results and error texts side by side; one bad value never fails the rest."""

    def run(values: pd.Series) -> tuple[list, list]:
        results, errors = [], []
        for value in values:
            try:
                results.append(fn(value))
                errors.append(None)
            except Exception as e:  # any failure of a single input becomes its error text
                results.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return results, errors

    return run


def embed(
    df: DataFrame, model: str, dim: int, fn: Callable[[object], object], content: str = "content"
) -> tuple[DataFrame, DataFrame]:
    """Embed ``content`` per ``content_hash`` with ``fn``: rows tagged with ``model``, and failures with ``error``."""
    safe = isolate(fn)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors, errors = safe(batch[content])
            checked = []
            for i, vec in enumerate(vectors):
                if vec is not None and (len(vec) != dim or not np.isfinite(vec).all()):
                    vec, errors[i] = None, f"expected {dim} finite values"
                checked.append(None if vec is None else [float(x) for x in vec])
            yield pd.DataFrame({"content_hash": batch["content_hash"].to_numpy(), "vec": checked, "error": errors})

    schema = "content_hash string, vec array<float>, error string"
    # Results and failures are two parts of one written pass.
    done = cut_lineage(df.select("content_hash", content).mapInPandas(run, schema))
    ok = done.filter(F.col("error").isNull())
    ok = ok.select("content_hash", F.lit(model).alias("model"), F.lit(dim).alias("dim"), "vec")
    return ok, done.filter(F.col("error").isNotNull()).select("content_hash", "error")


def embed_new(
    df: DataFrame, have: DataFrame, model: str, dim: int, fn: Callable[[object], object]
) -> tuple[DataFrame, DataFrame]:
    """Like :func:`embed`, but content already embedded by this model is dropped before any Python runs."""
    done = have.filter(F.col("model") == model).select("content_hash")
    return embed(df.join(done, "content_hash", "left_anti"), model, dim, fn)


def validate_vectors(df: DataFrame, dim: int, vec: str = "vec") -> tuple[DataFrame, DataFrame]:
    """Rows with a usable vector of length ``dim``, and the others with a ``problem``."""
    good = is_valid(F.col(vec), dim)
    problem = (
        F.when(F.col(vec).isNull() | (F.size(vec) == 0), "empty")
        .when(F.size(vec) != dim, "wrong length")
        .otherwise("null or NaN component")
    )
    return df.filter(good), df.filter(~good).withColumn("problem", problem)


def embed_text(df: DataFrame, dim: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Hashed, idf-weighted bag of words per document, as a unit vector: ``key, vec``.

    Words are counted per document and slot in the task that reads them, each different word of a batch hashed once; the
    counts are written, as they are read for the idf table, which has at most ``dim`` rows, and for the vectors.
    """
    words = df.select(key, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("words"))
    kind = words.schema[key].dataType.simpleString()
    slots = words.mapInArrow(_slots(key, dim), f"`{key}` {kind}, slot int, tf double")
    counts = cut_lineage(slots.groupBy(key, "slot").agg(F.sum("tf").alias("tf")))
    n_docs = df.select(F.count(F.lit(1)).alias("n"), F.lit(1).alias("_one"))
    spread = counts.groupBy("slot").agg(F.count(F.lit(1)).alias("df")).withColumn("_one", F.lit(1))
    spread = spread.join(F.broadcast(n_docs), "_one")
    idf = spread.select("slot", F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)).alias("idf"))
    weighted = counts.join(F.broadcast(idf), "slot").withColumn("w", F.col("tf") * (1.0 + F.col("idf")))
    # A document has at most ``dim`` slots.
    by_doc = weighted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("_m"))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("_m")[i.cast("int")], F.lit(0.0))
    )
    return by_doc.select(key, dense.alias("_raw")).select(key, _as_floats(l2_normalize(F.col("_raw"))).alias("vec"))


def _slots(key: str, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``key, slot, tf`` of batches of a key and its list of words; a word's slot is its md5 modulo ``dim``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                keys, lists = batch.column(0).slice(start, TEXTS_AT_ONCE), batch.column(1).slice(start, TEXTS_AT_ONCE)
                words = lists.flatten().dictionary_encode()
                hashed = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in words.dictionary.to_pylist()]
                text = np.repeat(np.arange(len(keys)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
                spots = text * dim + np.asarray(hashed, dtype=np.int64)[words.indices.to_numpy()]
                counts = np.bincount(spots, minlength=len(keys) * dim)
                used = np.flatnonzero(counts)
                columns = [keys.take(pa.array(used // dim)), pa.array((used % dim).astype(np.int32)), pa.array(counts[used].astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, [key, "slot", "tf"])

    return run


def _as_floats(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("float"))
