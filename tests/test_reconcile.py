"""The report's rows and outputs: statuses, matches and reasons, case by case."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import dates, desk, reconcile, reports

WORDS = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]


def test_outputs_case_by_case(spark):
    """Only an unfinished output can be a raw copy; a final one that no input serves is an orphan."""
    outputs = spark.createDataFrame(
        [(1, "h1", True, ""), (2, "h1", False, ""), (3, "h3", False, "broken"), (4, "h4", True, "no usable text layer"), (5, "h5", True, ""), (6, "h6", True, None), (7, None, None, None), (8, "h8", False, "")],
        "out_id long, sha string, final boolean, error string",
    )
    rows = spark.createDataFrame(
        [(1, "DONE_TEXT_MATCH", 5, "b"), (2, "SHARED_OUTPUT", 6, "d"), (3, "SHARED_OUTPUT", 6, "c"), (4, "BORDERLINE", 4, "x"), (5, "DONE_MANIFEST", None, "m"), (6, "DONE_IMAGE_MATCH", 8, "y")],
        "doc_id long, status string, out_id long, path string",
    )
    shas = spark.createDataFrame([("h1",), ("h1",), (None,)], "sha string")
    got = {r.out_id: (r.status, r.inputs, r.matched_inputs, r.reason) for r in reconcile.output_statuses(outputs, rows, shas).collect()}
    assert got == {
        1: ("ORPHAN_OUTPUT", 0, [], "no input matched this finalized file"), 2: ("RAW_COPY", 0, [], "byte-identical to an input PDF; not finalized"), 3: ("ORPHAN_OUTPUT", 0, [], "broken"),
        4: ("ORPHAN_OUTPUT", 0, [], "no usable text layer"), 5: ("MATCHED", 1, ["b"], ""), 6: ("SHARED_OUTPUT", 2, ["c", "d"], ""), 7: ("ORPHAN_OUTPUT", 0, [], "unrecognized file in output"),
        8: ("ORPHAN_OUTPUT", 1, ["y"], "unrecognized file in output"),
    }
    assert reconcile.output_statuses(outputs.limit(0), rows, shas).collect() == []
    assert {r.status for r in reconcile.output_statuses(outputs, rows.limit(0), shas.limit(0)).collect()} == {"ORPHAN_OUTPUT"}


@pytest.fixture(scope="module")
def tables(spark):
    text = lambda a, n=20: WORDS[a : a + n]
    inputs = [(1, text(0)), (2, text(30)), (3, text(60)), (4, text(90)), (5, text(120)), (6, text(150)), (7, text(180)), (8, []), (9, text(210)), (10, text(240)), (11, text(270)), (12, text(270))]
    outputs = [(101, text(120)), (102, text(150, 15) + text(400, 5)), (103, text(210) + ["zz01"]), (105, text(240)), (105, text(270))]
    pages = lambda rows: spark.createDataFrame([(i, k, t) for k, (i, t) in enumerate(rows)], "doc_id long, page_idx int, tokens array<string>").filter("size(tokens) > 0")
    docs = spark.createDataFrame([(i, f"in/{i}", f"h{i}") for i, _ in inputs], "doc_id long, path string, sha string")
    outs = spark.createDataFrame([(101, "x", True, "a.pdf"), (102, "y", True, "b.pdf"), (103, "z", True, "c.pdf"), (104, "h7", False, "d.pdf"), (105, "w", True, "e.pdf")], "out_id long, sha string, final boolean, name string")
    paths = lambda *ids: spark.createDataFrame([(f"in/{i}",) for i in ids], "path string")
    session = reconcile.session_flags(docs, paths(1), paths(2), paths(4), paths(3, 9), paths(9))
    manifest = spark.createDataFrame([("in/10", "h10", "out/e.pdf", None, "e.pdf"), ("in/2", "h2", "gone", None, None)], "path string, sha string, out_path string, out_sha string, out_name string")
    there = spark.createDataFrame([("out/e.pdf", "w", "e.pdf")], "out_path string, sha string, name string")
    return docs, outs, session, manifest, pages(inputs), pages(outputs), there


def test_report_names_outputs_and_reasons(spark, tables):
    rows = reconcile.report(*tables)
    got = {r.doc_id: (r.status, r.output_match, None if r.score is None else round(r.score, 3), r.reason) for r in rows.collect()}
    assert got == {
        1: ("DONE_SESSION", "", None, "marked reviewed in saved session"),
        2: ("REMAINING_PENDING", "", None, "in saved session pending list"),
        3: ("REMAINING_PENDING", "", None, "in saved scan plan but not marked processed"),
        4: ("REMAINING_AUTO", "", None, "auto-confirmed in session but not finalized"),
        5: ("DONE_TEXT_MATCH", "a.pdf", 1.0, "page fingerprint match (100% of pages)"),
        6: ("BORDERLINE", "b.pdf", 0.6, "weak match; verify before scanning"),
        7: ("REMAINING_RAW_COPY", "", None, "output contains only an unrenamed copy of this file"),
        8: ("UNREADABLE", "", None, "no usable text layer or page images; cannot compare safely"),
        9: ("DONE_TEXT_MATCH", "c.pdf", 0.952, "page fingerprint match (100% of pages)"),
        10: ("DONE_MANIFEST", "e.pdf", 1.0, "original SHA-256 is in rename_manifest.csv"),
        11: ("DONE_TEXT_MATCH", "e.pdf", 1.0, "page fingerprint match (100% of pages)"),
        12: ("BORDERLINE", "e.pdf", 1.0, "matches the same pages as another input; likely a duplicate page or shared template"),
    }
    outputs = {r.out_id: (r.status, r.matched_inputs) for r in reconcile.output_statuses(tables[1], rows, tables[0]).collect()}
    assert outputs == {101: ("MATCHED", ["in/5"]), 102: ("ORPHAN_OUTPUT", []), 103: ("MATCHED", ["in/9"]), 104: ("RAW_COPY", []), 105: ("MATCHED", ["in/11"])}


def test_report_becomes_text(spark, tables):
    rows = reconcile.report(*tables).withColumn("rel_path", F.concat("path", F.lit(".pdf")))
    outputs = reconcile.output_statuses(tables[1], rows, tables[0]).join(tables[1].select("out_id", F.col("name").alias("rel_path")), "out_id")
    lines = [r.line for r in reports.text_report(rows, outputs, {"Input": "in"}).orderBy("section", "part", "key", "line").collect()]
    assert "  BORDERLINE                         in/6.pdf -> b.pdf [0.600]  (weak match; verify before scanning)" in lines
    assert "  d.pdf  (byte-identical to an input PDF; not finalized)" in lines and "Remaining: 7" in lines and "Done: 5" in lines
    names = {r.output_file: r.matched_inputs for r in reports.outputs_table(outputs).collect()}
    assert names["a.pdf"] == "5" and names["b.pdf"] == ""


def test_empty_collections(spark, tables):
    docs, outs, session, manifest, a, b, there = tables
    assert reconcile.report(docs.limit(0), *tables[1:]).collect() == []
    alone = {r.status for r in reconcile.report(docs, outs.limit(0), session.limit(0), manifest.limit(0), a, b.limit(0), there.limit(0)).collect()}
    assert alone == {"REMAINING_NO_OUTPUT", "UNREADABLE"}


def test_slips_are_dated_up_to_the_end_of_the_year(spark):
    found = spark.sql("select date'2024-03-01' as today").select(*(dates.routing_date(F.lit(f"Routing Slip {t} 10:04:53"), F.col("today")).alias(n) for n, t in (("a", "2024-12-31"), ("b", "2025-01-01"), ("c", "2016-12-31"), ("d", "2017-01-01"))))
    r = found.first()
    assert str(r.a.date) == "2024-12-31" and r.b is None and r.c is None and str(r.d.date) == "2017-01-01"


def test_native_text_of_the_first_pages(spark):
    pages = spark.createDataFrame([(1, 0, "  " + "x" * 39 + " \n"), (1, 5, "y" * 99), (2, 0, "x" * 20), (2, 2, " " + "x" * 20), (3, 0, None), (3, 1, None), (4, 7, "z")], "doc_id long, page_idx int, page_text string")
    assert {tuple(r) for r in desk.native_text(pages).collect()} == {(1, False), (2, True), (3, False)}
    assert desk.native_text(pages.limit(0)).collect() == []
