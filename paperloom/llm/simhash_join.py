"""SimHash near duplicates by a grid join over segment popcounts.

A fingerprint's 64 bits are cut into 32 segments of two bits, and their bit counts make a point of a grid.
The Manhattan distance of two points is at most the Hamming distance of the fingerprints, so it rules pairs
out before the bits are compared.  The axes are dealt into ``parts``; points within distance 2 differ in at
most two parts and so share a cell of at least one of the grids that leave two parts out.  Equal
fingerprints are one point.  A cell with more points than its varying bits warrant is not paired: its points
meet by the value that is left when two of these bits are wiped, at most four to a value.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, small, trim, word_lists
from .components import connected_components

WORDS, SEED, BITS, NEAR = 3, 42, 64, 2
SEGMENTS = BITS // 2
LOW = 0x5555555555555555
#: Bits that tell two random points apart on one axis: -log2(6/16).
AXIS_BITS = 1.415
#: How much fuller than with random fingerprints cells are taken to be.
CROWDED = 64
#: Most rows of a table that is sent to every task.
SENT = 200_000


def fingerprint(data: bytes) -> int:
    """Bits set in over half of the hashes of a text's shingles, as a signed 64-bit number."""
    sums, n, before = np.zeros(BITS, np.int64), 0, []

    def add(shingles) -> int:
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        np.add(sums, np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64), out=sums)
        return len(h)

    for words in word_lists(data.lower()):
        words = before + words
        if len(words) >= WORDS:
            n += add(map(b" ".join, zip(*(words[k:] for k in range(WORDS)))))
        before = words[-(WORDS - 1) :]
    if not n and before:
        n = add([b" ".join(before)])
    return int(np.packbits(2 * sums > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, fp."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                found = [fingerprint(t.as_py() or b"") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "fp"])
        trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(scan, "doc_id long, fp long")


def unary_counts(fp: Column) -> Column:
    """The segments' bit counts in unary (00, 01, 11): two vectors of counts are as far apart, by Manhattan
    distance, as their codes have differing bits."""
    low, right = F.lit(LOW), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(right).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(right).bitwiseAND(low), 1))


def parts_for(points: int) -> int:
    """The number of parts with the least rows: one per point and grid, and the points met in a cell."""
    met = lambda p: points * CROWDED * 2.0 ** (-AXIS_BITS * SEGMENTS * (p - NEAR) / p)
    return min(range(NEAR + 1, SEGMENTS // 2 + 1), key=lambda p: comb(p, NEAR) * (1 + met(p)))


def grids(parts: int) -> list[int]:
    """Masks (signed) of the codes' bits that each grid keeps."""
    cuts = [round(k * SEGMENTS / parts) for k in range(parts + 1)]
    part = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    kept = [sum(part) - part[a] - part[b] for a, b in combinations(range(parts), NEAR)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in kept]


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near_links(points: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct fp -> links (a, b) of at most two differing bits; any two that are so near are linked, or
    both linked to the least that differs from them in the same two bits."""
    masks = grids(parts or parts_for(points.count()))
    dealt = F.explode(F.array(*(F.struct(F.lit(i).alias("grid"), F.col("code").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks))))
    cells = points.select("fp", unary_counts(F.col("fp")).alias("code")).select("fp", "code", dealt.alias("at")).select("at.grid", "at.cell", "fp", "code")
    full = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying")).filter("n > 1")
    full = materialize(full, "simhash-cells")
    shared = materialize(cells.join(small(full, SENT), ["grid", "cell"]), "simhash-shared")
    pairs = F.bit_count("varying") * (F.bit_count("varying") - 1)
    crowded = (F.col("n") > 3) & (F.col("n") - 1 > pairs)
    one = shared.filter(~crowded)
    two = one.select("grid", "cell", F.col("fp").alias("b"), F.col("code").alias("b_code"))
    met = one.join(two, ["grid", "cell"]).filter((F.col("fp") < F.col("b")) & (_differ("code", "b_code") <= NEAR) & (_differ("fp", "b") <= NEAR))
    links = met.select(F.col("fp").alias("a"), "b")
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.expr("varying").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    wiped = F.flatten(F.transform("bits", lambda i: F.transform(F.filter("bits", lambda j: j > i), lambda j: bit(i).bitwiseOR(bit(j)))))
    rest = shared.filter(crowded).select("fp", "varying").distinct().repartition("fp").withColumn("bits", bits)
    rest = rest.select("fp", F.explode(wiped).alias("wiped"))
    met = rest.groupBy("wiped", F.col("fp").bitwiseAND(F.bitwise_not("wiped")).alias("left")).agg(F.collect_set("fp").alias("met")).filter(F.size("met") > 1)
    met = met.select(F.array_min("met").alias("a"), F.explode("met").alias("b")).filter("a < b")
    found = materialize(links.unionByName(met).distinct(), "simhash-links")
    release(full, shared)
    return found


def simhash_components(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """documents -> doc_id, fingerprint, component_id, one row per input row.

    Null and empty texts have fingerprint zero and link as any other; rows that repeat an id or a text are
    rows of their own; a null id gives its row no part in a component's least id (null if there is no
    other); very long texts are read to their end, a stretch at a time; an empty table gives an empty
    result; columns besides doc_id and text are ignored.  ``parts`` changes the work, not the result.
    """
    rows = materialize(with_fingerprint(docs), "simhash-rows")
    points = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-points")
    links = near_links(points.select("fp"), parts)
    labels = connected_components(links).select(F.col("node").alias("fp"), "label")
    linked = materialize(labels.join(points, "fp"), "simhash-linked")
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    whole = materialize(linked.select("fp", "label").join(least, "label").select("fp", "least"), "simhash-least")
    release(links, linked)
    of = points.join(small(whole, SENT), "fp", "left").select("fp", F.when(F.col("least").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
