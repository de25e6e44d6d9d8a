"""What the two text classifiers share: the bounded sample of labelled rows, calibration, scoring of all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.common import id_text, small_batches, text_blocks

SAMPLE = 1000  # labelled rows of each class that a model is fitted on, at most
SAMPLE_BYTES = 32_768  # longer texts are scored, but not learned from


def fold(modulus: int) -> F.Column:
    """crc32 of the decimal doc_id modulo `modulus`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: F.Column, per_class: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most per_class rows of each class among the labels in `allowed`, in a fixed pseudo-random order.

    Twice as many ids are drawn and broadcast, so that texts longer than most_bytes leave enough others. Labels other than 0 and 1, and
    labels of no document, are left out; of rows that repeat a doc_id one counts, that of the least text.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & allowed)
    order = F.xxhash64("doc_id")
    drawn = [known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(2 * per_class) for y in (0, 1)]
    short = id_text(docs).join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").filter(F.octet_length("text") <= most_bytes)
    once = short.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # of a bounded number of ids
    place = F.row_number().over(Window.partitionBy("y").orderBy(order, "doc_id"))
    rows = once.withColumn("place", place).filter(F.col("place") <= per_class).select("doc_id", "text", "y").collect()
    rows.sort(key=lambda r: (r[0] * 2654435761 % (1 << 32), r[0], r[2]))
    return [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the logistic curve 1 / (1 + exp(-(a margin + b))) with the greatest likelihood, lightly regularised."""
    centre, scale = float(margin.mean()), float(margin.std()) or 1.0
    x = np.stack([(margin - centre) / scale, np.ones(len(margin))], 1)
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-4])
    target = np.where(y == 1, 1 - 0.5 / (1 + (y == 1).sum()), 0.5 / (1 + (y == 0).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.clip(np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (p - target) + ridge @ w), -4, 4)
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)


def score_all(docs: DataFrame, margins, curve: tuple[float, float], held_out: F.Column, threshold: float = 0.7, carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of all rows, and the columns to carry along; margins(raw, at) gives a text's margin from its whole bytes."""
    a, b = curve
    small_batches(docs.sparkSession)
    carry = carry or []
    inner = [f"carried_{i}" for i in range(len(carry))]  # a carried column may have the name of a result
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(f"`{c}`").alias(i) for c, i in zip(carry, inner))]
    wide = docs.select(*columns)
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in wide.schema.fields[3:])

    def score(batches):
        for batch in batches:
            p = np.zeros(batch.num_rows)
            for i, j, raw, at in text_blocks(batch.column(2)):
                p[i:j] = 1 / (1 + np.exp(-np.clip(a * margins(raw, at) + b, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), *(batch.column(c) for c in inner)], names=["doc_id", "held_out", "score", "predicted", *inner])

    out = wide.mapInArrow(score, f"doc_id long, held_out boolean, score double, predicted int{kinds}")
    for c, i in zip(carry, inner):  # a result gives way to the carried column of its name
        out = out.drop(c).withColumnRenamed(i, c)
    return out


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data], dtype=np.int64)]).astype(np.int64)
