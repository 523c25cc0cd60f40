"""Packing by power-of-two decomposition.

Each document's token ids (with the end token) are cut into pieces whose lengths are the binary digits of
its length, the longest being the sequence length.  A piece is a sequence: no sequence crosses documents and
none is padded.  Pieces of equal lengths are gathered in a bucket, and a bucket with ``batch_tokens`` is a
batch: a block of equal lengths, with sequence ids in a row.  Every task has buckets of its own, so no ids
are shuffled; a task leaves at most one short batch per length.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, batch long"

_encoders: dict = {}


def encoder(vocabulary: str):
    """text -> numpy uint32 ids, equal to ``tokenizers`` with ``add_special_tokens=False``.

    The faster BPE library runs the same vocabulary (its ranks are the ids, its pattern the byte-level
    one); texts that spell a special token are left to ``tokenizers`` itself.
    """
    if vocabulary not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"

        path = public_tokenizers.path(vocabulary)
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if any(s in text for s in special):
                whole = _encoders.get("whole") or _encoders.setdefault("whole", Tokenizer.from_file(path))
                return np.asarray(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
            return fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4", copy=False)

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


def binary_pieces(total: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: full sequences, then the binary digits of the rest, falling."""
    cuts, at = [], 0
    while total - at >= longest:
        cuts.append((at, longest))
        at += longest
    bit = longest >> 1
    while bit:
        if total - at >= bit:
            cuts.append((at, bit))
            at += bit
        bit >>= 1
    return cuts


def _batch(rows: list[tuple], number: int) -> pa.RecordBatch:
    doc, start, length, tokens, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(tokens, pa.int64()), pa.array(ids, pa.binary()), pa.array([number] * len(rows), pa.int64())],
        names=["doc_id", "start", "length", "doc_tokens", "ids", "batch"],
    )


def pack_power_of_two(docs: DataFrame, sequence_length: int = 2048, vocabulary: str = "byte_bpe_50k.json", end_id: int = 1, batch_tokens: int = 1 << 16) -> DataFrame:
    """documents -> one row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned
    32-bit), batch, bucket (log2 of the length), sequence_id, offset.

    A null text is empty and so packs as the end token alone; rows are packed one by one, equal ones
    included; an empty table gives an empty result; columns besides doc_id and text are ignored.
    ``sequence_length`` must be a power of two.  Batch and sequence ids follow the partitions of the input and
    are unique, not gapless; the pieces of a batch have sequence ids in a row.  A very long document is
    held once, its pieces a batch at a time.
    """
    if sequence_length < 1 or sequence_length & (sequence_length - 1):
        raise ValueError("sequence_length must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = np.array([end_id], dtype="<u4")
        buckets: dict[int, list[tuple]] = {}
        context = TaskContext.get()
        numbers = itertools.count((context.partitionId() if context else 0) << 33)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                data = ids.tobytes()
                for start, length in binary_pieces(len(ids), sequence_length):
                    bucket = buckets.setdefault(length, [])
                    bucket.append((doc_id, start, length, len(ids), data[4 * start : 4 * (start + length)]))
                    if len(bucket) * length >= batch_tokens:
                        yield _batch(buckets.pop(length), next(numbers))
        for length in sorted(buckets):
            yield _batch(buckets[length], next(numbers))

    out = docs.select("doc_id", "text").mapInArrow(pieces, PIECES)
    return out.withColumn("bucket", F.log2("length").cast("int")).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
