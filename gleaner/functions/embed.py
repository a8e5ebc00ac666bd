"""Chunk vectors: what is embedded, by which policy, and with which embedder.

An embedder is a function from a pandas Series of texts to a Series of unit
vectors. No model is shipped; ``hashing_embedder`` needs none, is the same on
every machine, and serves as default and in tests.
"""

from __future__ import annotations

import ast
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from . import text as X

DIM = 64
#: Chunks that are embedded at a time.
CHUNKS = 500
PYTHON = "\\.pyi?$"
Embedder = Callable[[pd.Series], pd.Series]


def hashing_embedder(texts: pd.Series) -> pd.Series:
    """Signed counts of token hashes in DIM places, scaled to length 1 (an empty text: the first unit vector)."""

    def one(text: str | None) -> list[float]:
        v = np.zeros(DIM)
        for w in re.findall(fixed.TOKEN, text or ""):
            h = int.from_bytes(hashlib.blake2b(w.lower().encode(), digest_size=8).digest(), "little")
            v[h % DIM] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        return (v / n if n else np.eye(DIM)[0]).tolist()

    return texts.map(one)


def embed_query(text: str, embedder: Embedder = hashing_embedder) -> list[float]:
    return embedder(pd.Series([text]))[0]


def docstrings(code: str | None) -> str:
    """Docstrings and comments of over twelve characters of Python code; nothing if it does not parse."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError):
        return ""
    kinds = (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)
    found = [d for n in ast.walk(tree) if isinstance(n, kinds) and (d := ast.get_docstring(n))]
    found += [c.strip() for c in re.findall(r"#(.*)", code or "") if len(c.strip()) > 12]
    return "\n".join(found)


def python_docstrings(code: Column | str) -> Column:
    @F.pandas_udf(T.StringType())
    def of(code: pd.Series) -> pd.Series:
        return code.map(docstrings)

    return of(code)


def embed_target(path: Column, text: Column) -> Column:
    """As functions.text.embed_target, with Python code parsed."""
    python = F.lower(path).rlike(PYTHON)
    own = python_docstrings(F.when(python, text))
    return F.when(python, F.when(F.length(own) >= 40, own).otherwise("")).otherwise(X.embed_target(path, text))


def policy_version(revision: int = 2) -> str:
    """Name of the embedding policy: changes with its suffix sets or revision."""
    sets = repr(sorted((k, sorted(v)) for k, v in fixed.KIND_EXTS.items())) + str(revision)
    return f"v{revision}-{hashlib.blake2b(sets.encode(), digest_size=4).hexdigest()}"


def chunk_vectors(docs: DataFrame, embedder: Embedder = hashing_embedder) -> DataFrame:
    """doc_id, off, embedding, fingerprint, policy of every chunk; a document with nothing to embed gives one row with off -1 and no vector, so that a resumed build passes it over.

    What is embedded of a text, its chunks and their vectors are made in one Python step, CHUNKS at a time.
    """
    python = F.coalesce(F.lower("path").rlike(PYTHON), F.lit(False))
    target = F.when(python, F.col("text")).otherwise(X.embed_target(F.col("path"), F.col("text")))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), X.fingerprint(F.col("mtime"), F.col("text")).alias("fingerprint"), python.alias("python"), target.alias("t"))
    names = ["doc_id", "off", "embedding", "fingerprint"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, int, str]]:
        for batch in batches:
            for at in range(batch.num_rows):  # one text at a time
                doc, mark, python, text = (batch.column(i)[at].as_py() for i in range(4))
                if python:
                    text = own if len(own := docstrings(text)) >= 40 else ""
                found = X.cuts(text or "", 1400, 200)
                yield from ((doc, mark, a, text[a:b]) for a, b in found)
                if not found:
                    yield doc, mark, -1, ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pieces(batches)
        while some := list(itertools.islice(rows, CHUNKS)):
            docs, marks, offs, texts = zip(*some, strict=True)
            vectors = [None if o < 0 else list(v) for o, v in zip(offs, embedder(pd.Series(texts)), strict=True)]
            cols = (docs, pa.int64()), (offs, pa.int32()), (vectors, pa.list_(pa.float64())), (marks, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in cols], names)

    return marked.mapInArrow(run, "doc_id long, off int, embedding array<double>, fingerprint string").withColumn("policy", F.lit(policy_version()))
