"""Where vectors come from: sources that turn an Arrow array of texts into an array of vectors.

A source is anything with ``dimensions`` and ``vectors(texts)``; it travels to the workers, so models
are loaded there, on first use. Sources are opened by name; one that can't be had is an error, never
a silent substitute. Null texts never reach a source: their vectors are null.
"""

from __future__ import annotations

import hashlib
import http.client
import json
from collections.abc import Callable
from functools import cache
from typing import Any
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from quernel.functions.similarity import fake_embedding

SOURCES: dict[str, Callable[..., Any]] = {}


def source(name: str):
    def add(kind):
        SOURCES[name] = kind
        return kind

    return add


def open_source(name: str = "fake", **options):
    if name not in SOURCES:
        raise ValueError(f"unknown source of vectors {name!r}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name](**options)


def as_lists(matrix: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(matrix, dtype=np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.reshape(-1)))


@source("fake")
class HashVectors:
    """Deterministic vectors from a text's SHA-256; whole tables get them as an expression, without workers."""

    def __init__(self, dimensions: int = 128) -> None:
        self.dimensions = dimensions

    def column(self, text):
        return fake_embedding(text, self.dimensions).cast("array<float>")

    def vectors(self, texts: pa.Array) -> pa.Array:
        digits = "".join(hashlib.sha256(t.encode()).hexdigest() for t in texts.to_pylist())
        values = np.array([int(d, 16) for d in digits], dtype=np.float32).reshape(-1, 64)
        return as_lists((values[:, np.arange(self.dimensions) % 64] - 8) / 8)


@source("ollama")
class EndpointVectors:
    """An HTTP endpoint that takes ``{"model", "prompt"}`` at ``/api/embeddings`` and answers ``embedding``.

    It takes one text a call; all texts of a batch go over one connection.
    """

    def __init__(self, model: str, dimensions: int, base_url: str = "http://localhost:11434", prefix: str = "", timeout: float = 30) -> None:
        self.model, self.dimensions, self.url, self.prefix, self.timeout = model, dimensions, urlsplit(base_url), prefix, timeout

    def vectors(self, texts: pa.Array) -> pa.Array:
        link = (http.client.HTTPSConnection if self.url.scheme == "https" else http.client.HTTPConnection)(self.url.netloc, timeout=self.timeout)
        try:
            return pa.array([self._ask(link, self.prefix + t) for t in texts.to_pylist()], pa.list_(pa.float32()))
        finally:
            link.close()

    def _ask(self, link: http.client.HTTPConnection, prompt: str) -> list[float]:
        link.request("POST", f"{self.url.path.rstrip('/')}/api/embeddings", json.dumps({"model": self.model, "prompt": prompt}), {"Content-Type": "application/json"})
        answer = link.getresponse()
        body = answer.read()
        if answer.status != 200:
            raise OSError(f"the endpoint answered {answer.status}: {body[:200]!r}")
        return json.loads(body)["embedding"]


@cache
def _onnx_model(name: str):
    from fastembed import TextEmbedding

    return TextEmbedding(name)


@source("fastembed")
class OnnxVectors:
    """Vectors of the optional ``fastembed`` package; a worker loads a model once."""

    def __init__(self, model: str, dimensions: int, prefix: str = "") -> None:
        self.model, self.dimensions, self.prefix = model, dimensions, prefix

    def vectors(self, texts: pa.Array) -> pa.Array:
        found = _onnx_model(self.model).embed([self.prefix + t for t in texts.to_pylist()])
        return as_lists(np.array(list(found)).reshape(-1, self.dimensions))


def with_embedding(rows: DataFrame, text_col: str, vectors_of, name: str = "embedding") -> DataFrame:
    """``rows`` with a vector for each text, a batch at a time."""
    if hasattr(vectors_of, "column"):
        return rows.withColumn(name, vectors_of.column(F.col(text_col)))
    at = rows.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            there = texts.is_valid()
            known = vectors_of.vectors(texts.filter(there))
            places = np.cumsum(there.to_numpy(zero_copy_only=False)) - 1
            found = known.take(pa.array(places, mask=~there.to_numpy(zero_copy_only=False))).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, ArrayType(FloatType()))]))


def vector_of(spark: SparkSession, text: str, vectors_of) -> list[float]:
    """The vector of one text, such as a query's, by way of the same batches."""
    return vectors_of.vectors(pa.array([text], pa.string()))[0].as_py()
