"""Quality by compression: zstandard dictionaries of good and of bad text, and a calibrated score.

A text is cut into blocks of 2 KiB (all of it) and each block is compressed with either dictionary
by itself, so that a long text doesn't become its own dictionary. The sizes' difference over their
sum, and the bytes left for a byte of text, go through a logistic calibration to a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import logistic
from ledgerline.llm.common import drop_stored, fold, sampled, stored, table

BLOCK = 2048
THRESHOLD = 0.3
#: Folds 2, 3, 4 fill the dictionaries and fold 1 calibrates; fold 0 is held out.
#: Bounds of the labelled sample: documents a class for the dictionaries, rows of one block each that are taken of their whole texts, documents for the calibration.
DICTIONARY_DOCS, DICTIONARY_ROWS, CALIBRATION_DOCS = 2500, 12_000, 8000
DICTIONARY_BYTES, LEVEL = 112_640, 3
_made: dict[int, tuple] = {}


@dataclass(frozen=True)
class Model:
    """Without weights (a class has no labelled text) every text gets the score ``base``."""

    bad: bytes
    good: bytes
    weights: tuple[float, ...] | None
    base: float


def blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def _compressors(model: Model) -> tuple:
    key = hash((model.bad, model.good))
    if key not in _made:
        _made.clear()
        ready = []
        for data in (model.bad, model.good):
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=LEVEL)
            ready.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))
        _made[key] = tuple(ready)
    return _made[key]


def sizes(model: Model, text: str | None) -> tuple[int, int, int]:
    """(bytes with the bad dictionary, with the good one, of the text)."""
    bad, good = _compressors(model)
    a = b = n = 0
    for block in blocks(text):
        a += len(bad.compress(block))
        b += len(good.compress(block))
        n += len(block)
    return a, b, n


#: Columns of ``features`` that the normalised difference alone gives; the others are the compressed rate and the length.
DIFFERENCE = 3


def features(measured: np.ndarray) -> np.ndarray:
    """Rows of ``sizes`` -> rows of the calibration's inputs; an empty text has size 0 in all."""
    a, b, n = measured.reshape(-1, 3).astype(float).T
    difference = 20.0 * (a - b) / np.maximum(a + b, 1.0)
    rate = np.log(np.minimum(a, b) / np.maximum(n, 1.0) + 0.01)
    return np.column_stack([np.ones(len(n)), np.minimum(difference, 0), np.maximum(difference, 0), rate, rate**2, np.log1p(n) / 10.0])


def _labelled(docs: DataFrame, labels: DataFrame, folds: list[int], rows: int, only: int | None = None) -> DataFrame:
    """Texts of about ``rows`` labelled doc_ids of the folds. A doc_id with several labels counts as bad."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & fold(F.col("doc_id")).isin(folds))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = sampled(known if only is None else known.where(F.col("quality") == only), "doc_id", rows)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def train(docs: DataFrame, labels: DataFrame, inputs: int = 6) -> Model:
    """Learn from labelled rows outside fold 0; what is gathered is bounded by the constants above.

    inputs: how many columns of ``features`` the calibration sees (DIFFERENCE: no rate, no length).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                parts = blocks(x.as_py())
                yield pa.record_batch([pa.array(parts, pa.binary())], ["block"])

    found = {}
    for only in (0, 1):
        rows = stored(_labelled(docs, labels, [2, 3, 4], DICTIONARY_DOCS, only).select("text").mapInArrow(cut, "block binary"), "blocks")
        found[only] = sorted(bytes(r.block) for r in sampled(rows, "block", DICTIONARY_ROWS).collect())
        drop_stored(rows)
    base = len(found[1]) / max(1, len(found[0]) + len(found[1])) if found[0] or found[1] else 0.5
    try:
        trained = [zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, found[k])) // 4), found[k]).as_bytes() for k in (0, 1)]
    except zstandard.ZstdError:  # too little text to train from: the texts themselves, as raw content
        trained = [b"".join(found[k])[-DICTIONARY_BYTES:] for k in (0, 1)]
    if not all(trained):
        return Model(b"", b"", None, base)
    draft = Model(trained[0], trained[1], None, base)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([sizes(draft, x.as_py()) for x in batch.column(0)], dtype=np.int64).reshape(-1, 3)
            yield pa.record_batch([pa.array(found[:, k].copy()) for k in range(3)] + [batch.column(1)], ["a", "b", "n", "y"])

    rows = _labelled(docs, labels, [1], CALIBRATION_DOCS).select("text", F.col("quality").cast("int").alias("y")).mapInArrow(measure, "a long, b long, n long, y int").collect()
    x = features(np.array([[r.a, r.b, r.n] for r in rows], dtype=float))
    y = np.array([r.y for r in rows], dtype=float)
    prior = np.array([1.0, 4.0, 4.0, 0, 0, 0])
    weights = logistic.fit(x[:, :inputs], y, prior[:inputs], precision=0.01)
    weights = np.r_[weights, np.zeros(len(prior) - inputs)]
    return Model(trained[0], trained[1], tuple(map(float, weights)), base)


def score(model: Model):
    """A pandas UDF text -> score in 0..1, over whole texts; null counts as empty."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if model.weights is None:
            return pd.Series(np.full(len(texts), model.base))
        measured = np.array([sizes(model, x) for x in texts], dtype=np.int64).reshape(-1, 3)
        return pd.Series(logistic.sigmoid(features(measured) @ np.array(model.weights)))

    return run


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold; columns as they are.

    Every row is judged by its own text: repeated rows stay repeated, ids may be null.
    """
    text = F.col("text").cast("string")
    return docs.where(score(train(docs, labels))(text) >= THRESHOLD)


def op7_quality(spark, sf_dir):
    """Query: quality score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), score(train(docs, labels))("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
