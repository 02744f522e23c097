"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, label: Callable[[dict], tuple[np.ndarray, np.ndarray]], sample: int, most_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about `sample` documents, an even choice by hash of their id, at most most_rows rows.

    label turns a document into its rows (x, y); rows with y < 0 are left out. It runs where the documents lie; only numbers
    reach the driver. Beyond most_rows the documents with the least hashes stay, so the choice and the order of the rows do not depend on the partitions.
    """
    n = docs.count()
    share = int(min(1.0, sample / max(1, n)) * 2**31)
    picked = docs.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(2**31)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, xs, ys = [], [], [], []
            for r in batch.to_pylist():
                x, y = label(r)
                known = np.flatnonzero(y >= 0)
                ids += [r["id"]] * len(known)
                at += known.tolist()
                xs += x[known].tolist()
                ys += y[known].tolist()
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, at, xs, ys), kinds)], names=["id", "at", "x", "y"])

    found = picked.mapInArrow(run, "id bigint, at int, x array<double>, y int")
    rows = found.orderBy(F.xxhash64(F.lit("order"), "id"), "id", "at").limit(most_rows).toArrow()
    if rows.num_rows == 0:
        return np.zeros((0, 0)), np.zeros(0)
    rows = rows.sort_by([("id", "ascending"), ("at", "ascending")])
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(rows.num_rows, -1)
    return x, np.array(rows.column("y"))
