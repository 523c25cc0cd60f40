"""Page-image fingerprints from raw grey pixels, with numpy on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIDE, INK_BELOW = 16, 200
FINGERPRINT = "doc_id long, page_idx int, hash array<long>, ink double"


def shrunk(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the cells of a height x width grid laid over the page."""
    rows = np.linspace(0, gray.shape[0], height + 1).astype(int)
    columns = np.linspace(0, gray.shape[1], width + 1).astype(int)
    sums = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    sums[1:, 1:] = gray.cumsum(0, dtype=float).cumsum(1)
    top, bottom = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1).clip(max=gray.shape[0])
    left, right = columns[:-1], np.maximum(columns[1:], columns[:-1] + 1).clip(max=gray.shape[1])
    area = (bottom - top)[:, None] * (right - left)[None, :]
    return (sums[np.ix_(bottom, right)] - sums[np.ix_(top, right)] - sums[np.ix_(bottom, left)] + sums[np.ix_(top, left)]) / area


def gradient_hash(gray: np.ndarray) -> list[int]:
    """256 bits, whether brightness rises from cell to cell, as four signed 64-bit integers."""
    small = shrunk(gray, SIDE, SIDE + 1)
    return np.packbits(small[:, 1:] > small[:, :-1]).view(">i8").tolist()


def fingerprints(pages: DataFrame) -> DataFrame:
    """doc_id, page_idx, width, height, pixels (grey bytes, row by row) -> hash and share of ink.

    Pages whose pixels do not fit their size, or are null, get a null hash and ink.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, inks = [], []
            for w, h, data in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if not data or not w or not h or len(data) != w * h or w < SIDE + 1 or h < SIDE:
                    hashes.append(None)
                    inks.append(None)
                    continue
                gray = np.frombuffer(data, np.uint8).reshape(h, w)
                hashes.append(gradient_hash(gray))
                inks.append(float((gray < INK_BELOW).mean()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(inks, pa.float64())], names=["doc_id", "page_idx", "hash", "ink"])

    return pages.select("doc_id", "page_idx", "width", "height", "pixels").mapInArrow(scan, FINGERPRINT)
