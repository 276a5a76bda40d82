"""A bounded, deterministic sample of labelled documents, for the classifiers."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkmill.session import ship

from .common import fold, text_bytes, tidied

#: Labelled rows of each class that training may use.
PER_CLASS = 3000
#: A text of more bytes is read by passages: pieces of PASSAGE bytes, evenly over the whole text, as many as fit.
LONGEST = 64 << 10
PASSAGE = 1 << 10


def by_passages(raw: bytes, longest: int, passage: int = PASSAGE) -> bytes:
    """A text that is too long, as passages spread evenly over it from its start to its end; each begins and ends at a blank where there is one near."""
    if len(raw) <= longest:
        return raw
    n, out = max(1, longest // passage), []
    for k in range(n):
        at = (len(raw) - passage) * k // max(1, n - 1)
        piece = raw[at : at + passage]
        a = piece.find(b" ", 0, 64) + 1 if at else 0
        b = piece.rfind(b" ", passage - 64) if at + passage < len(raw) else passage
        out.append(piece[a : b if b > a else passage])
    return b" ".join(out)


def sample(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held_out: int, *, per_class=PER_CLASS, longest=LONGEST, doc_id="doc_id", text="text") -> pd.DataFrame:
    """``text, label`` of at most ``per_class`` rows of each class outside the held-out fold.

    Rows are taken in the order of a hash of the id, so the sample doesn't depend on
    partitioning. The ids (a few thousand) are broadcast to the documents, which are not
    shuffled. Null labels and ids are not learned from, nor are ids with labels of both
    classes; labels that repeat count once. Of several texts with one id the least is taken.
    No row is left out for its length: a text of over ``longest`` bytes is read by passages.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(fold("doc_id", modulus) != held_out)
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    chosen = []
    for label in (0, 1):
        part = rows.where(F.col("label") == label).select("doc_id", "label", F.xxhash64("doc_id").alias("h"))
        chosen += [(r["doc_id"], r["label"]) for r in part.orderBy("h", "doc_id").limit(per_class).collect()]
    if not chosen:
        return pd.DataFrame({"text": pd.Series(dtype=str), "label": pd.Series(dtype=int)})
    ids = spark.createDataFrame(pd.DataFrame(chosen, columns=["sample_id", "label"]), "sample_id long, label int")
    found = docs.select(F.col(doc_id).cast("long").alias("sample_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids), "sample_id")

    def shortened(batches):
        for batch in batches:
            texts = [by_passages(t, longest).decode("utf-8", "ignore") for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), pa.array(texts, pa.string()), batch.column("label")], ["sample_id", "text", "label"])

    # one row of each id, however often it occurs: at most 2 * per_class rows of at most ``longest`` bytes
    one = found.mapInArrow(tidied(shortened), "sample_id long, text string, label int").groupBy("sample_id", "label").agg(F.min("text").alias("text"))
    return one.toPandas().sort_values("sample_id").reset_index(drop=True)[["text", "label"]]


def best_cut(logit, label, weight):
    """The logit that parts the classes with the fewest weighted errors, midway between two rows."""
    import numpy as np

    order = np.argsort(logit, kind="stable")
    x, y, w = logit[order], label[order], weight[order]
    errors = np.concatenate([[0], np.cumsum(w * (y == 1))]) + np.concatenate([np.cumsum((w * (y == 0))[::-1])[::-1], [0]])
    inner = np.concatenate([[True], x[1:] > x[:-1], [True]])
    best = np.flatnonzero(inner & (errors <= errors[inner].min() + 1e-12))
    k = int(best[len(best) // 2])
    return float(x[0] - 1 if k == 0 else x[-1] + 1 if k == len(x) else (x[k - 1] + x[k]) / 2)
