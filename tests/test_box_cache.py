"""Pages read through the cache of word boxes."""

import pytest
from pyspark.sql import functions as F

from paperloom.sources import box_cache

WANTED = "sha string, page_idx int, height double, zone string"


@pytest.fixture
def pages(spark):
    """Three files: a has digital words, b only recognised ones, c nothing at all."""
    mk = lambda rows: spark.createDataFrame(rows, box_cache.BOXES)
    digital = mk([("a", 0, 0, "One", 1.0, 2.0, 3.0, 4.0, 0.0), ("a", 0, 1, "Low", 1.0, 90.0, 3.0, 95.0, 0.0), ("b", 0, 0, " ", 1.0, 2.0, 3.0, 4.0, 0.0)])
    scanned = mk([("b", 0, 0, "Two", 100.0, 100.0, 200.0, 200.0, 80.0), ("b", 0, 1, "faint", 1.0, 1.0, 2.0, 2.0, 5.0)])
    wanted = spark.createDataFrame([("a", 0, 100.0, "x"), ("a", 0, 100.0, "y"), ("b", 0, 100.0, None), ("c", 0, 100.0, "x"), (None, 0, 1.0, "x")], WANTED)
    return wanted, digital, scanned


def reader(scanned, asked):
    def recognise(open_):
        asked.append(sorted(str(r.sha) for r in open_.collect()))
        return scanned.join(open_, ["sha", "page_idx"], "left_semi")

    return recognise


def read(path, wanted, digital, recognise, top=None):
    return sorted((r.sha, r.text, r.source) for r in box_cache.boxes_through_cache(path, wanted, digital, recognise, top).collect())


def test_second_run_recognises_only_what_had_no_box(spark, pages, tmp_path):
    wanted, digital, scanned = pages
    asked, path = [], str(tmp_path / "cache")
    first = read(path, wanted, digital, reader(scanned, asked))
    assert first == [("a", "Low", "digital"), ("a", "One", "digital"), ("b", "Two", "scanned")]
    assert read(path, wanted, digital, reader(scanned, asked)) == [(s, t, "cache") for s, t, _ in first]
    assert asked == [["None", "b", "c"], ["None", "c"]]


def test_zone_is_part_of_the_key(spark, pages, tmp_path):
    wanted, digital, scanned = pages
    path, recognise = str(tmp_path / "cache"), reader(scanned, [])
    assert read(path, wanted, digital, recognise, 0.5) == [("a", "One", "digital"), ("b", "Two", "scanned")]
    assert ("a", "Low", "digital") in read(path, wanted, digital, recognise)
    assert read(path, wanted, digital, recognise, 0.5) == [("a", "One", "cache"), ("b", "Two", "cache")]


def test_two_writers_of_a_page_count_once(spark, pages, tmp_path):
    wanted, digital, _ = pages
    path, boxes = str(tmp_path / "cache"), digital.filter("sha = 'a'")
    box_cache.store(path, boxes)
    box_cache.store(path, boxes.limit(1))
    assert box_cache.stored(spark, path).count() == 2
    (row,) = box_cache.cached(path, wanted).collect()
    least = min((r.writer, r.boxes) for r in box_cache.stored(spark, path).collect())
    assert row.boxes == least[1]
    box_cache.compact(path, str(tmp_path / "once"), spark)
    (kept,) = box_cache.stored(spark, str(tmp_path / "once")).collect()
    assert (kept.writer, kept.boxes) == least


def test_no_cache_and_no_pages(spark, pages, tmp_path):
    wanted, digital, scanned = pages
    path = str(tmp_path / "cache")
    assert box_cache.cached(path, wanted).count() == 0
    assert read(path, wanted.limit(0), digital, reader(scanned, [])) == []
    box_cache.store(path, digital.filter(F.lit(False)))
    assert box_cache.cached(path, wanted).count() == 0
