import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.functions import arrays as A
from paperloom.functions import text as X
from paperloom.functions.fuzzy import common_subsequence, token_set_ratio
from paperloom.operators import dates, detectors, naming, qc, reconcile, reports, resolve, session, similarity
from paperloom.plans.finalize import finalize_plan
from paperloom.sources import sinks, tables

def as_of():
    return F.make_date(F.lit(2030), F.lit(1), F.lit(1))


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"]).select(column.alias("v")).first()["v"]


def test_token_set_ratio():
    assert token_set_ratio("alpha beta", "beta alpha gamma") == 100
    assert token_set_ratio("", "x") == 0
    assert 0 < token_set_ratio("north star", "south bend") < 60
    assert common_subsequence("kitten", "sitting") == 4


def test_version_order(spark):
    assert one(spark, X.version_parts(F.lit("v1.9.10")) > X.version_parts(F.lit("1.9.4")))


def test_names(spark):
    name = X.final_filename(F.lit(7), F.lit("003"), F.lit("Clark Dev/Corp"), F.lit("202101"))
    assert one(spark, name) == "2021010007_003_CLARK DEV_CORP.pdf"
    p = one(spark, X.parsed_stem(F.lit("2021010007_003_CLARK_CORP")))
    assert (p.yyyymm, p.seq, p.division, p.company) == ("202101", 7, "003", "CLARK_CORP")
    assert one(spark, X.parsed_stem(F.lit("c"))) is None
    assert one(spark, X.is_final_name(F.lit("a/0001_156_ALPHA.PDF"))) and not one(spark, X.is_final_name(F.lit("c.pdf")))


@pytest.mark.parametrize("dragged,target,after,want", [(0, 3, True, [1, 2, 3, 0, 4]), (4, 1, False, [0, 4, 1, 2, 3]), (9, 1, False, [0, 1, 2, 3, 4])])
def test_reordered(spark, dragged, target, after, want):
    order = F.array(*map(F.lit, range(5)))
    assert one(spark, A.reordered(order, F.lit(dragged), F.lit(target), F.lit(after))) == want


def test_page_moves(spark):
    refs = F.array(*map(F.lit, "abcd"))
    assert one(spark, A.moved(refs, F.array(F.lit(0)), F.lit(3))) == ["b", "c", "a", "d"]
    assert one(spark, A.inserted(refs, F.array(F.lit("x")), F.lit(99))) == ["a", "b", "c", "d", "x"]
    marks = one(spark, A.positions(A.page_refs(F.lit("d"), F.lit(3), F.array(F.lit(1)), F.array(F.lit(2))), "is_blank"))
    assert marks == [1]


def test_crop(spark):
    lit = lambda x: F.lit(float(x))
    half = A.display_to_page(lit(100), lit(200), F.lit(0), lit(100), lit(200), lit(0), lit(0), lit(50), lit(200))
    assert tuple(one(spark, half)) == (0, 0, 50, 200)
    assert one(spark, A.display_to_page(lit(100), lit(200), F.lit(0), lit(100), lit(200), lit(5), lit(5), lit(5.5), lit(200))) is None


def test_gate(spark):
    day = F.make_date(F.lit(2020), F.lit(1), F.lit(1))
    gate = lambda conf, date=day: one(spark, X.auto_confirmed(F.lit(True), F.lit(conf), date, F.lit(95), as_of()))
    assert gate(90) and not gate(89) and not gate(95, F.lit(None).cast("date"))


def test_blank_verdict(spark):
    v = lambda *a: one(spark, qc.blank_verdict(*map(F.lit, a)))
    assert [v(3, 2.5, 0.5), v(0, 0.5, 0.99), v(1, 1.5, 0.92), v(2, 1.0, 0.5)] == ["content", "blank", "blank", "needs_review"]


LETTER = """ALPHA LIFE INSURANCE CORPORATION
Makati City
The Insurance Commission
Juan Cruz, Complainant, -versus- BETA MUTUAL
ASSURANCE INC., Respondent.
We note GAMMA GROUP.
Very truly yours,
ALPHA LIFE INSURANCE CORPORATION
"""


def test_detectors(spark):
    pages = spark.createDataFrame([(1, 0, LETTER), (2, 0, "nothing here"), (3, 0, "")], "doc_id long, page_idx int, page_text string")
    found = {(r.doc_id, r.source, r["name"]) for r in detectors.candidates(pages).collect()}
    assert (1, "caption", "BETA MUTUAL ASSURANCE INC") in found
    assert (1, "letterhead", "ALPHA LIFE INSURANCE CORPORATION Makati City") in found
    assert (1, "signature", "ALPHA LIFE INSURANCE CORPORATION") in found
    assert {x[0] for x in found} == {1}
    region = detectors.sender_region(pages).filter("doc_id = 1").first()
    assert "GAMMA" not in region.sender and "GAMMA" in region.body


def test_combine(spark):
    docs = spark.createDataFrame([(i,) for i in range(1, 5)], ["doc_id"])
    c = spark.createDataFrame(
        [(1, 0, "alpha life", "caption", 0.9), (1, 1, "ALPHA LIFE", "signature", 0.8), (2, 0, "alpha life", "folder", 0.4), (3, 0, "zzz", "folder", 0.4), (3, 1, "qqq", "caption", 0.9)],
        "doc_id long, ord long, name string, source string, weight double",
    )
    roster = spark.createDataFrame([("ALPHA LIFE", 1), ("BETA", 2)], "entry string, ord int")
    out = {r.doc_id: r for r in resolve.combined(docs, c, resolve.roster_matches(c, roster)).collect()}
    assert out[1].confidence == 100 and out[1].cross_validated and out[1].tier == "caption+signature" and not out[1].needs_review
    assert out[2].confidence == 89 and out[2].needs_review
    assert out[3].company_name == "zzz" and out[3].matched is None and out[3].label == "none"
    assert out[4].company_name == "" and out[4].tier == "unresolved"


def test_margin(spark):
    roster = spark.createDataFrame([("ALPHA LIFE", 0), ("ALPHA LIFE TWO", 1), ("BETA CARE", 2)], "entry string, ord int")
    names = spark.createDataFrame([("ALPHA LIFE",), ("BETA CARE",)], ["name"])
    m = resolve.roster_matches(names, roster)
    assert {r["name"]: (r.entry, r.score, r.second) for r in m.collect()}["ALPHA LIFE"] == ("ALPHA LIFE", 100, 100)
    assert [r["name"] for r in resolve.margin_matches(m).collect()] == ["BETA CARE"]


def test_routing_date(spark):
    d = lambda t: one(spark, dates.routing_date(F.lit(t), as_of()))
    assert str(d("no 179002000123 on 05/06/2019").date) == "2019-05-06"
    assert d("Routing Slip 09/05!2017").source == "routing_slip_mmdd"
    assert d("Routing Slip L2018-09-20").source in ("routing_slip_date_only", "routing_slip_corrupted")
    assert d("01/02/2020 no header") is None and d("Routing Slip 01/02/2010") is None


def test_greedy_cover_and_shared(spark):
    rows = spark.createDataFrame(
        [(1, "DONE_TEXT_MATCH", 9, 0.99, [0, 1]), (2, "DONE_TEXT_MATCH", 9, 0.95, [0]), (3, "DONE_TEXT_MATCH", 8, 0.9, [0]), (4, "DONE_TEXT_MATCH", 7, 0.9, [0]), (5, "DONE_TEXT_MATCH", 7, 0.9, [1]), (6, "REMAINING_AUTO", None, None, None)],
        "doc_id long, status string, out_id long, score double, pages array<int>",
    )
    got = {r.doc_id: r.status for r in reconcile.with_shared(rows).collect()}
    assert got == {1: "DONE_TEXT_MATCH", 2: "BORDERLINE", 3: "DONE_TEXT_MATCH", 4: "SHARED_OUTPUT", 5: "SHARED_OUTPUT", 6: "REMAINING_AUTO"}


def test_upsert_and_resume(spark):
    old = spark.createDataFrame([("a", 0, "1"), ("b", 1, "2")], "key string, pos int, v string")
    new = spark.createDataFrame([("b", 0, None), ("c", 1, "4")], "key string, pos int, v string")
    got = sorted((r.pos, r["key"], r.v) for r in session.upsert(old, new, "key").collect())
    assert got == [(0, "a", "1"), (1, "b", None), (3, "c", "4")]
    plan = spark.createDataFrame([("x",), ("y",), ("z",)], ["path"])
    assert {r.path for r in session.remaining(plan, plan.filter("path = 'x'")).collect()} == {"y", "z"}


def test_repair(spark):
    snap = spark.createDataFrame([(["f"], ["g"], (["x", "y"], ["x"]))], "all_flagged_docs array<string>, auto_confirmed_docs array<string>, scan struct<plan:array<string>,processed:array<string>>")
    left = spark.createDataFrame([("y",)], ["path"])
    r = session.repaired(snap, left, "reprocess").first()
    assert r.all_flagged_docs == [] and r.scan.plan == ["y"] and r.scan.processed == []
    assert session.repaired(snap, left, "review").first().scan.processed == ["x"]


def test_repaired_rows(spark, tmp_path):
    """No status remains; repeated rows and other columns stay; empty tables and unknown modes."""
    report = spark.createDataFrame([("a", "DONE_SESSION", 1), ("b", "BORDERLINE", 2), ("b", "BORDERLINE", 2), (None, None, 3), ("c", "SHARED_OUTPUT", 4)], "path string, status string, plan int")
    rows = lambda mode: sorted((r.plan, r.path, r.processed) for r in session.repaired_plan(report, mode).collect())
    assert rows("reprocess") == [(2, "b", False), (2, "b", False), (3, None, False)]
    assert rows("review") == [(1, "a", True), (2, "b", False), (2, "b", False), (3, None, False), (4, "c", True)]
    assert session.repaired_plan(report.limit(0), "review").count() == 0
    docs = spark.createDataFrame([(1, "all_flagged_docs"), (2, "reviewed"), (3, None), (4, "auto_confirmed_docs")], "doc_id int, list string")
    assert [r.doc_id for r in session.repaired_documents(docs, "reprocess").orderBy("doc_id").collect()] == [2, 3]
    assert session.repaired_documents(docs, "review").count() == 4
    for repair, t in ((session.repaired_plan, report), (session.repaired_documents, docs)):
        with pytest.raises(ValueError):
            repair(t, "other")
    saved = f"{tmp_path}/session.json"
    sinks.write_index(docs, saved)
    assert sinks.discard_snapshot(spark, saved) and not sinks.discard_snapshot(spark, saved)


def test_collisions_step_over_names_in_use(spark):
    rows = spark.createDataFrame([(i, "f", n) for i, n in enumerate(["a.pdf", "a.pdf", "a_1.pdf", "a.pdf"])], "id int, folder string, name string")
    there = spark.createDataFrame([("f", "a_2.pdf")], "folder string, name string")
    got = [r.placed for r in naming.without_collisions(rows, "folder", "name", [F.col("id")], there).orderBy("id").collect()]
    assert got == ["a.pdf", "a_3.pdf", "a_1.pdf", "a_4.pdf"] and len(set(got)) == 4


def test_finalize_layouts(spark):
    docs = spark.createDataFrame([(1, "confirmed", None, "7", "ALPHA", "x", 3, [0], [2]), (2, "confirmed", None, "7", "", "x", 1, [], []), (3, "flagged", None, "7", "B", "x", 1, [], [])], "doc_id long, status string, date date, division string, company string, rel_dir string, n_pages int, blank array<int>, docsep array<int>")
    r = finalize_plan(docs).collect()
    assert [(x.doc_id, x.folder, x.placed, x.kept_pages) for x in r] == [(1, "x", "0001_007_ALPHA.pdf", [1])]
    assert finalize_plan(docs, "company").first().folder == "007/ALPHA"
    assert {x.result for x in sinks.audit_rows(finalize_plan(docs), docs).collect()} == {"ok", "error: no company", "error: flagged"}


def test_hamming_bands_find_all(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(40)]
    left = [(i, b) for i, b in enumerate(base)]
    right = [(i, b ^ sum(1 << k for k in rng.sample(range(63), rng.randrange(14)))) for i, b in enumerate(base)]
    mk = lambda x: spark.createDataFrame(x, "id long, bits long")
    want = {(i, j) for i, a in left for j, b in right if (a ^ b).bit_count() <= 10}
    assert {(r.id, r.other_id) for r in similarity.near_bits(mk(left), mk(right), 10).collect()} == want


def test_sources(spark, tmp_path):
    for p in ("a/b/real.pdf", "a/logs/no.pdf", ".hid/no.pdf", "x.PDF"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"%PDF")
    got = {(r.rel_dir, r.name) for r in tables.scan_files(spark, str(tmp_path)).collect()}
    assert got == {("a/b", "real.pdf"), ("", "x.PDF")}
    (tmp_path / "r.csv").write_text("Company Name\nALPHA\nALPHA\nBETA\n")
    assert {r.entry for r in tables.read_roster(spark, str(tmp_path / "r.csv")).collect()} == {"ALPHA", "BETA"}
    sinks.append_manifest(spark.createDataFrame([("1",)], ["timestamp"]), str(tmp_path / "m"))
    sinks.append_manifest(spark.createDataFrame([("2",)], ["timestamp"]), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    sinks.write_index(spark.createDataFrame(pd.DataFrame({"a": [1], "b": [b"x"]})), str(tmp_path / "i"))
    assert spark.read.json(str(tmp_path / "i")).columns == ["a"]


LETTERS = [
    "JUAN CRUZ, Complainant,\n- versus -\nACME LIFE INSURANCE CORPORATION, Respondent.\nx---x",
    "ANA LEE, Complainant, vs. 12-345, BETA MUTUAL UNDERWRITERS, INC., Respondents. Order. Respondent GAMMA PLANS INC. Respondent",
    "Subject: complaint vs. DELTA ASSURANCE COMPANY, claim\nThe president of the Epsilon Memorial Plans Corp, as Respondent",
    "no company here, Respondent", "", "   \n ", None, "versus versus Respondent Complainant ZETA CO",
    "INSURANCE COMMISSION\nACME LIFE INSURANCE CORPORATION\nTo: x\nVery truly yours,\nACME LIFE INSURANCE CORP\nManila",
    "OMICRON ASSURANCE COMPANY\n12 some street\nDear Sirs",
]


def test_staged_captions_equal_the_expressions(spark):
    from pyspark.sql import functions as F

    from paperloom.operators import detectors as D

    pages = spark.createDataFrame([(i, 0, t, 7) for i, t in enumerate(LETTERS)], "doc_id long, page_idx int, page_text string, name int")
    t, names = F.col("page_text"), ("caption", "caption_wide", "between_parties", "routing_slip")
    want = {r.doc_id: tuple(r[2:]) for r in pages.select("doc_id", "name", *(getattr(D, n)(t).alias(n) for n in names)).collect()}
    got = {r.doc_id: tuple(r[n] for n in names) for r in D.with_captions(pages).collect()}
    assert got == want and any(v[0] for v in got.values()) and any(v[3] for v in got.values())
    assert D.with_captions(pages.limit(0)).count() == 0


def test_windows_overlap_and_keep_their_words():
    import re

    from paperloom.functions.windows import word_windows

    kw = re.compile(r"\b(?:INSURANCE|LIFE)\b", re.IGNORECASE)
    text = "of the Acme (Life) Insurance, Inc. and of others"
    assert word_windows(text, kw, 2, 2) == ["Acme ( Life ) Insurance,", "Acme (Life) Insurance , Inc."]
    assert word_windows(text, kw, 9, 0, frozenset(["of", "the"]))[0] == "Acme ( Life"
    assert word_windows("", kw, 2, 2) == []


def test_date_contexts_overlap(spark):
    from pyspark.sql import functions as F

    from paperloom.operators.dates import date_candidates

    pages = spark.createDataFrame([(1, 0, "dated 01/02/2019 and then effective 03/04/2020 " + "x" * 300 + " issued 05/06/2021"), (2, 0, None), (3, 0, "")], "doc_id long, page_idx int, page_text string")
    rows = {str(r.date): set(r.keywords) for r in date_candidates(pages, F.lit("2025-01-01").cast("date")).collect()}
    assert set(rows) == {"2019-01-02", "2020-03-04", "2021-05-06"}
    assert {"dated", "effective"} <= rows["2019-01-02"] & rows["2020-03-04"] and "effective" not in rows["2021-05-06"] and "issued" in rows["2021-05-06"]


def test_all_detectors(spark):
    from paperloom.operators import resolve

    pages = spark.createDataFrame([(i, 0, t) for i, t in enumerate(LETTERS)], "doc_id long, page_idx int, page_text string")
    roster = spark.createDataFrame([("ACME LIFE INS CORP", 0), ("ACME LIFE INSURANCE CORPORATION", 1), ("INSURANCE COMMISSION", 2), ("BETA MUTUAL UNDERWRITERS INC", 3)], "entry string, ord long")
    folders = spark.createDataFrame([(0, 0, "beta mutual underwriters inc"), (4, 0, "scans")], "doc_id long, ord int, name string")
    hints = spark.createDataFrame([("folders", "scans", "OMEGA"), ("letterheads", "MANILA", "SIGMA")], "kind string, key string, company string")
    found = {(r.doc_id, r.source, r.name) for r in resolve.all_candidates(pages, roster, folders, hints).collect()}
    assert {(0, "folder", "BETA MUTUAL UNDERWRITERS INC"), (4, "learned", "OMEGA"), (8, "learned", "SIGMA"), (8, "gazetteer", "ACME LIFE INSURANCE CORPORATION")} <= found
    assert {x[1] for x in found} >= {"caption", "routing_slip", "letterhead", "signature", "gazetteer", "keyword", "folder", "learned"}
    assert not any(x[2] == "INSURANCE COMMISSION" for x in found) and not any(x[0] == 6 for x in found)
    assert resolve.all_candidates(pages.limit(0), roster).count() == 0


def test_manifest_rules(spark):
    """A path entry without its output does not hide a valid entry of the hash, which only valid entries guard."""
    from paperloom.operators import reconcile

    inputs = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2"), (3, "c", "h2"), (4, "d", None), (5, "e", "h5"), (6, "f", "h6")], "doc_id long, path string, sha string")
    manifest = spark.createDataFrame(
        [("a", "h1", "gone", None, None), ("z", "h1", "out1", None, None), ("b", "h2", "out2", None, None), ("y", "h2", "gone", None, None), ("e", "x", "gone", "s5", None), ("w", "h6", "gone", None, "n6")],
        "path string, sha string, out_path string, out_sha string, out_name string",
    )
    outputs = spark.createDataFrame([("out1", None, None), ("out2", None, ""), ("other", "s5", "n6")], "out_path string, sha string, name string")
    got = {r.doc_id: (r.in_manifest, r.valid) for r in reconcile.manifest_flags(inputs, manifest, outputs).collect()}
    assert got == {1: (True, True), 2: (True, True), 3: (True, False), 4: (False, False), 5: (True, True), 6: (True, True)}
    assert all(not r.in_manifest for r in reconcile.manifest_flags(inputs, manifest.limit(0), outputs).collect())


def test_image_rungs(spark):
    from paperloom.operators import reconcile, similarity

    page = lambda rows: spark.createDataFrame([(d, p, [h, 0, 0, 0], ink) for d, p, h, ink in rows], "doc_id long, page_idx int, hash array<long>, ink double")
    a = page([(1, 0, -2, 0.1), (1, 1, 0, 0.0), (2, 0, 9, 0.1), (3, 0, 0, 0.0)])
    b = page([(10, 0, -2, 0.1), (11, 0, 9, 0.1), (12, 0, 9, 0.1), (13, 0, 0, 0.0)])
    best = {r.doc_id: (r.out_id, r.ambiguous, r.pages) for r in similarity.unambiguous(similarity.image_matches(a, b)).collect()}
    assert best[1] == (10, False, [0]) and best[2][:2] == (12, True) and 3 not in best and 13 not in {v[0] for v in best.values()}
    inputs = spark.createDataFrame([(i, f"p{i}", f"h{i}") for i in range(1, 5)], "doc_id long, path string, sha string")
    none = inputs.limit(0)
    flags = reconcile.manifest_flags(inputs, spark.createDataFrame([], "path string, sha string, out_path string"), spark.createDataFrame([], "out_path string"))
    session = reconcile.session_flags(inputs, none, none, none, none, none)
    texts = spark.createDataFrame([], "doc_id long, out_id long, coverage double, score double, pages array<int>")
    images = spark.createDataFrame([(1, 10, 1.0, 1.0, False, [0]), (2, 12, 1.0, 1.0, True, [0])], "doc_id long, out_id long, coverage double, score double, ambiguous boolean, pages array<int>")
    rows = reconcile.statuses(inputs, session, flags, none.select("sha"), texts, none, images=images, pictured=a)
    assert {r.doc_id: (r.status, r.out_id) for r in rows.collect()} == {1: ("DONE_IMAGE_MATCH", 10), 2: ("BORDERLINE", 12), 3: ("REMAINING_NO_OUTPUT", None), 4: ("UNREADABLE", None)}


def test_roster_bounds_lose_nothing():
    import random

    from paperloom.functions.fuzzy import Roster

    rng = random.Random(2)
    vocabulary = ["alpha", "alfa", "beta", "bet", "gamma", "delta", "del", "inc", "corp", "insurance", "ins", "a", "zeta"]
    phrase = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 5)))
    entries = [phrase() for _ in range(120)]
    r = Roster(entries)
    for name in [phrase() for _ in range(150)] + ["", "qqq"]:
        scores = [token_set_ratio(name, e) for e in entries]
        assert all(b >= s for b, s in zip(r.bounds(name), scores, strict=True))
        best = min(range(len(entries)), key=lambda i: (-int(scores[i]), i))
        other = min((i for i in range(len(entries)) if entries[i] != entries[best]), key=lambda i: (-int(scores[i]), i))
        assert r.two_best(name) == [(int(scores[best]), best), (int(scores[other]), other)]


def test_text_report_order_and_empty(spark, tmp_path):
    rows = spark.createDataFrame([("BORDERLINE", "/in/b.pdf", "b.pdf", None, None, None), ("DONE_SESSION", "C:\\in\\a.pdf", "a.pdf", "o.pdf", 0.5, "why")], "status string, path string, rel_path string, output_match string, score double, reason string")
    outputs = spark.createDataFrame([], "status string, rel_path string, matched_inputs array<string>, reason string")
    sinks.write_text(reports.text_report(rows, outputs, {"Input": "x"}), str(tmp_path / "t"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "t")).orderBy("_metadata.file_name", "_metadata.file_block_start").collect()]
    assert lines[:3] == ["Remaining documents report", "=" * 48, "Input: x"]
    at = lines.index("--- REMAINING - scan these ---")
    assert lines[at + 1] == "  BORDERLINE" + " " * 25 + "b.pdf  ()"
    assert lines[lines.index("--- DONE ---") + 1].endswith("a.pdf -> o.pdf [0.500]  (why)")
    assert lines.count("  (none)") == 3
    assert [r.input_file for r in reports.remaining_table(rows).orderBy("rel_path").collect()] == ["a.pdf", "b.pdf"]
    assert reports.text_report(rows.limit(0), outputs, {}).filter("line = '  (none)'").count() == 5


def test_roster_and_hints_files(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("\ufeffVendor,No\r\nAlpha Insurance Corporation,1\r\n\"Beta, the\nsecond\",2\r\nVendor,3\r\n".encode())
    got = {r.entry for r in tables.read_roster(spark, str(tmp_path / "r.csv")).collect()}
    assert len(got) == 3 and "VENDOR" in got
    held = spark.createDataFrame([("VENDOR",)], ["entry"])
    assert {r.entry for r in tables.read_roster(spark, str(tmp_path / "r.csv"), held).collect()} == got - {"VENDOR"}
    (tmp_path / "h.json").write_text('{"folders": {"a": "A"}}')
    (tmp_path / "bad.json").write_text("[1, 2")
    assert [tuple(r) for r in tables.read_hints(spark, str(tmp_path / "h.json")).collect()] == [("folders", "a", "A")]
    assert not tables.read_hints(spark, str(tmp_path / "bad.json")).count() and not tables.read_hints(spark, str(tmp_path / "none.json")).count()


def test_known_roster_and_its_seed(spark, tmp_path):
    """The user's list wins over the seed, also where it is broken; only a missing one is answered by the seed."""
    own, seed, missing = (str(tmp_path / f"{n}.json") for n in ("own", "seed", "missing"))
    (tmp_path / "seed.json").write_text('[\n  "ALPHA INC",\n  "\u00d1AME, THE",\n  "ALPHA INC",\n  null,\n  " "\n]', encoding="utf-8")
    read = lambda *paths: sorted(r.entry for r in tables.read_known(spark, *paths).collect())
    assert read(missing, seed) == ["ALPHA INC", "\u00d1AME, THE"]
    for broken in ("", "[1, ", '{"a": 1}', '"BETA"', "[]", "null"):
        (tmp_path / "own.json").write_text(broken)
        assert read(own, seed) == [], broken
    (tmp_path / "own.json").write_text('\ufeff["BETA"]', encoding="utf-8")
    assert read(own, seed) == ["BETA"] and read(missing) == [] and read(missing, missing) == []


def test_document_dates_disagreement(spark):
    """Anchors that disagree on a page without candidates of theirs ask for a review; null and empty pages do not."""
    pages = spark.createDataFrame([(1, 0, "On March 5, 2010 we wrote"), (2, 0, None), (2, 1, ""), (3, 0, "March 5, 2010 only")], "doc_id long, page_idx int, page_text string")
    words = spark.createDataFrame([(1, 0, i, w) for i, w in enumerate("Document Date: 01/13/2011 no 9002000777".split())], "doc_id long, page_idx int, word_idx int, text string")
    words = words.withColumns({"left": F.col("word_idx") * 50.0, "top": F.lit(0.0), "width": F.lit(40.0), "page_height": F.lit(800.0)})
    got = {r.doc_id: r for r in dates.document_dates(pages, words, F.lit("2024-01-01").cast("date")).collect()}
    assert str(got[1].date) == "2010-03-05" and got[2].date is None and got[2].confidence == 0 and not got[2].needs_review and not got[3].needs_review
    assert dates.document_dates(pages.limit(0), words, F.lit("2024-01-01").cast("date")).count() == 0


def test_tier_ladder_takes_first_of_equal_pages(spark):
    text = "A. Cruz, Complainant, versus {} Insurance Corporation, Respondent."
    pages = spark.createDataFrame([(1, 0, text.format("Alpha")), (1, 1, text.format("Beta")), (2, 0, None)], "doc_id long, page_idx int, page_text string")
    roster = spark.createDataFrame([("ALPHA INS CORP", 1), ("BETA INS CORP", 2)], "entry string, ord long")
    got = {r.doc_id: r for r in resolve.tier_ladder(pages, roster).collect()}
    assert (got[1].company_name, got[1].tier, got[1].label) == ("ALPHA INS CORP", "caption", "high")
    assert (got[2].company_name, got[2].tier, got[2].needs_review) == ("", "unresolved", True)


def test_cancelled_stream_goes_on_later(spark, tmp_path):
    from paperloom.streaming import control, incremental

    spark.range(10).write.parquet(str(tmp_path / "in"))
    start = lambda: incremental.append_results(incremental.stream_table(spark, str(tmp_path / "in"), "id long"), lambda df: df, str(tmp_path / "out"), str(tmp_path / "at"))
    seen = []
    assert not control.run_until_cancelled(start(), lambda: True, seen.append)
    assert control.run_until_cancelled(start(), lambda: False, seen.append) and len(seen) >= 2
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(10))
    assert control.progress_text(2, 10, 4.0) == ("Processing 2/10 (working...) ~16s left", 26)
    assert control.progress_text(0, 0, 1.0) == ("Processing 0/0 (working...)", 10)
