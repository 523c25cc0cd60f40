"""Numbers and suffixes in groups of any size, against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import naming
from paperloom.plans.finalize import finalize_plan

SCHEMA = "id int, folder string, name string"


@pytest.fixture
def many_parts(spark):
    """Small tables in several parts, as large ones are."""
    key, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def test_one_group_lies_in_many_parts(spark, many_parts):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, 1, 2, 3])) for i in range(400)]
    docs = spark.createDataFrame(rows, "id int, folder string, day int")
    order = [F.col("day").asc_nulls_last(), F.col("id").desc()]
    got = {r.id: r.seq for r in naming.numbered_per_group(docs, ["folder"], order, 7).collect()}
    want, last = {}, {}
    for i, f, d in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, -r[0])):
        want[i] = last[f] = last.get(f, 6) + 1
    assert got == want
    parts = docs.repartitionByRange(F.col("folder"), *order).filter("folder = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert parts > 1


def test_sums_of_weights(spark, many_parts):
    rows = [(i, i % 2, i % 5) for i in range(100)]
    got = {r.id: r.s for r in naming.running_sums(spark.createDataFrame(rows, "id int, g int, w int"), ["g"], [F.col("id")], "s", F.col("w")).collect()}
    assert got == {i: sum(w for j, h, w in rows if h == g and j <= i) for i, g, _ in rows}


def brute(rows, there):
    """The first row of a name keeps it unless a file has it; others take the least numbers that no name has."""
    exists, named, out, last = set(there), {(f, n) for _, f, n in rows} | set(there), {}, {}
    seen = set()
    for i, f, n in sorted(rows):
        if (f, n) not in seen and (f, n) not in exists:
            seen.add((f, n))
            out[i] = n
            continue
        seen.add((f, n))
        stem, dot, ext = n.rpartition(".")
        k = last.get((f, n), 0) + 1
        while (f, f"{stem}_{k}{dot}{ext}") in named:
            k += 1
        last[f, n] = k
        out[i] = f"{stem}_{k}{dot}{ext}"
    return out


@pytest.mark.parametrize("seed", range(2))
def test_suffixes_against_a_loop(spark, many_parts, seed):
    rng = random.Random(seed)
    some = lambda: rng.choice(["a.pdf", "a.pdf", "a.pdf", "b.pdf", f"a_{rng.randrange(1, 40)}.pdf", f"b_{rng.randrange(1, 9)}.pdf"])
    rows = [(i, rng.choice("fg"), some()) for i in range(150)]
    there = [(rng.choice("fg"), some()) for _ in range(25)]
    mk = spark.createDataFrame
    got = {r.id: r.placed for r in naming.without_collisions(mk(rows, SCHEMA), "folder", "name", [F.col("id")], mk(there, "folder string, name string")).collect()}
    assert got == brute(rows, there)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert naming.without_collisions(none, "folder", "name", [F.col("id")]).collect() == naming.numbered_per_group(none, ["folder"], [F.col("id")]).collect() == []


def test_numbers_of_finalized_files(spark):
    names = ["0007_001_X.pdf", "2020010009_001_X.pdf", "scan0042_001.pdf", "10000_001_X.pdf", "0050_001_X.txt", None]
    rows = spark.createDataFrame([("f", n) for n in names] + [("g", "x.pdf")], "folder string, name string")
    assert {r.folder: r.next_seq for r in naming.next_sequence(rows, ["folder"]).collect()} == {"f": 10, "g": 1}


def test_scan_order_numbers_documents_without_dates(spark):
    schema = "doc_id long, status string, date date, division string, company string, rel_dir string, n_pages int, blank array<int>, docsep array<int>"
    day = datetime.date
    docs = spark.createDataFrame([(1, "confirmed", day(2020, 3, 1), "7", "A/B", "x", 1, [], []), (2, "confirmed", day(2020, 1, 1), "7", "C", "x", 1, [], []), (3, "confirmed", None, "8", "C", "x", 1, [], [])], schema)
    got = lambda *a, **k: sorted((r.doc_id, r.seq, r.folder) for r in finalize_plan(docs, *a, **k).collect())
    assert got("mirror") == [(1, 1, "x"), (2, 2, "x"), (3, 3, "x")]
    assert got("company") == [(1, 1, "007/A_B"), (2, 2, "007/C"), (3, 1, "008/C")]
    assert got("flat", include_date=True) == [(1, 2, ""), (2, 1, "")]
    there = spark.createDataFrame([("", "2020010005_007_C.pdf"), ("", "other.pdf"), ("sub", "0099_007_C.pdf")], "folder string, name string")
    assert got("flat", existing=there) == [(1, 6, ""), (2, 7, ""), (3, 8, "")]
    assert got("flat", existing=there, start=20) == [(1, 20, ""), (2, 21, ""), (3, 22, "")]
