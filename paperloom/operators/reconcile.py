"""Reconciling an input collection with an output collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .similarity import best_image_matches, best_text_matches

REMAINING = ("REMAINING_PENDING", "REMAINING_AUTO", "REMAINING_RAW_COPY", "REMAINING_NO_OUTPUT", "REMAINING_MANIFEST_MISSING_OUTPUT", "BORDERLINE", "UNREADABLE")


def manifest_flags(inputs: DataFrame, manifest: DataFrame, outputs: DataFrame) -> DataFrame:
    """inputs (doc_id, path, sha) -> doc_id, in_manifest, valid, recorded: the output's name or else path.

    ``manifest``: path, sha, out_path and, if known, out_sha and out_name; ``outputs``: out_path and, if known,
    sha and name.  An entry is valid if its output is there, by path, hash or name.  An input is valid by a
    valid entry of its path, else by valid entries of its hash if there are at least as many as input
    copies (``recorded`` is the least name among these).  It is in the manifest if it is valid or any entry of its path or hash lacks its output.  Null
    paths, hashes and names match nothing; empty tables give no match.
    """
    rows, there = manifest, F.lit(False)
    for left, right in (("out_path", "out_path"), ("out_sha", "sha"), ("out_name", "name")):
        if left in manifest.columns and right in outputs.columns:
            mark = f"__has_{left}"
            known = outputs.filter(F.col(right).isNotNull() & (F.col(right) != "")).select(F.col(right).alias(left)).distinct().withColumn(mark, F.lit(True))
            rows, there = rows.join(known, left, "left"), there | F.coalesce(F.col(mark), F.lit(False))
    called = F.coalesce(F.nullif(F.col("out_name"), F.lit("")), "out_path") if "out_name" in rows.columns else F.col("out_path")
    rows = rows.select("path", "sha", there.alias("__valid"), F.when(there, called).alias("__name"))
    valid, missing, least = F.count_if("__valid"), F.count_if(~F.col("__valid")), F.min("__name")
    by_path = rows.groupBy("path").agg(valid.alias("__vp"), missing.alias("__mp"), least.alias("__np"))
    by_hash = rows.groupBy("sha").agg(valid.alias("__vh"), missing.alias("__mh"), least.alias("__nh"))
    copies = inputs.groupBy("sha").agg(F.count(F.lit(1)).alias("__copies"))
    joined = inputs.select("doc_id", "path", "sha").join(by_path, "path", "left").join(by_hash.join(copies, "sha"), "sha", "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    good = (some("__vp") > 0) | ((some("__vh") > 0) & (some("__vh") >= some("__copies")))
    recorded = F.when(some("__vp") > 0, F.col("__np")).when(good, F.col("__nh"))
    return joined.select("doc_id", (good | (some("__mp") > 0) | (some("__mh") > 0)).alias("in_manifest"), good.alias("valid"), recorded.alias("recorded"))


def session_flags(inputs: DataFrame, reviewed: DataFrame, pending: DataFrame, auto: DataFrame, plan: DataFrame, processed: DataFrame) -> DataFrame:
    """inputs (doc_id, path) and the saved lists (path each) -> doc_id, reviewed, pending, auto, planned.

    What the saved plan has and its processed list lacks is pending as well, and planned if only for that."""
    left = plan.select("path").join(processed.select("path").distinct(), "path", "left_anti")
    lists = {"reviewed": reviewed, "listed": pending, "left": left, "auto": auto}
    out = inputs.select("doc_id", "path")
    for name, paths in lists.items():
        out = out.join(paths.select("path").distinct().withColumn(f"__{name}", F.lit(True)), "path", "left")
    yes = lambda name: F.coalesce(f"__{name}", F.lit(False))
    return out.select("doc_id", yes("reviewed").alias("reviewed"), (yes("listed") | yes("left")).alias("pending"), yes("auto").alias("auto"), (yes("left") & ~yes("listed")).alias("planned"))


def statuses(
    inputs: DataFrame, session: DataFrame, flags: DataFrame, raw: DataFrame, texts: DataFrame, readable: DataFrame, document: float = 0.85, coverage: float = 0.80, weak: float = 0.60,
    images: DataFrame | None = None, pictured: DataFrame | None = None,
) -> DataFrame:
    """The status of each input, the first rung of the ladder that holds.

    ``session``: doc_id, reviewed, pending, auto; ``flags``: ``manifest_flags``; ``raw``: shas of outputs that
    are unfinished copies; ``texts``: best text match per input; ``readable``: inputs with tokens.
    ``images``: best image match per input (doc_id, out_id, score, ambiguous, pages), looked at where texts do not
    match; ``pictured``: inputs with page images, which are not unreadable.
    """
    # Helper columns start with underscores, so that no column of the inputs clashes.
    named = lambda df, *columns: df.select("doc_id", *((F.col(c) if c in df.columns else F.lit(None)).alias(f"__{c}") for c in columns))
    rows = (
        inputs.select("doc_id", F.col("sha").alias("__sha"))
        .join(named(session, "reviewed", "pending", "auto", "planned"), "doc_id", "left")
        .join(named(flags, "in_manifest", "valid", "recorded"), "doc_id", "left")
        .join(raw.select(F.col("sha").alias("__sha")).distinct().withColumn("__raw", F.lit(True)), "__sha", "left")
        .join(named(texts, "out_id", "score", "coverage", "pages"), "doc_id", "left")
        .join(readable.select("doc_id").distinct().withColumn("__readable", F.lit(True)), "doc_id", "left")
    )
    if images is None:
        none = {"out": F.lit(None).cast("long"), "score": F.lit(None).cast("double"), "share": F.lit(None).cast("double"), "pages": F.col("__pages"), "some": F.lit(False), "vague": F.lit(False)}
        rows = rows.withColumns({f"__i_{k}": v for k, v in none.items()})
    else:
        share = F.col("coverage") if "coverage" in images.columns else F.lit(None).cast("double")
        found = images.select(
            "doc_id", F.col("out_id").alias("__i_out"), F.col("score").alias("__i_score"), share.alias("__i_share"), F.col("pages").alias("__i_pages"), F.lit(True).alias("__i_some"), F.col("ambiguous").alias("__i_vague")
        )
        rows = rows.join(found, "doc_id", "left")
    if pictured is not None:
        rows = rows.join(pictured.select("doc_id").distinct().withColumn("__pictured", F.lit(True)), "doc_id", "left")
    else:
        rows = rows.withColumn("__pictured", F.lit(False))
    yes = lambda c: F.coalesce(F.col(f"__{c}").cast("boolean"), F.lit(False))
    matched = (F.col("__coverage") >= coverage) & (F.col("__score") >= document)
    unseen = ~yes("readable") & ~yes("pictured")
    by_image = F.concat(F.lit("page image fingerprint match ("), _percent("__i_share"), F.lit(" of pages, "), F.size("__i_pages").cast("string"), F.lit(" page(s))"))
    # The rungs: whether they hold, the status, the reason, and where the output, the score and the pages come from.
    rungs = (
        (yes("reviewed"), "DONE_SESSION", F.lit("marked reviewed in saved session"), None),
        (yes("in_manifest") & yes("valid"), "DONE_MANIFEST", F.lit("original SHA-256 is in rename_manifest.csv"), None),
        (yes("pending"), "REMAINING_PENDING", F.when(yes("planned"), "in saved scan plan but not marked processed").otherwise("in saved session pending list"), None),
        (yes("auto"), "REMAINING_AUTO", F.lit("auto-confirmed in session but not finalized"), None),
        (yes("in_manifest"), "REMAINING_MANIFEST_MISSING_OUTPUT", F.lit("manifest entry exists but its output file is missing"), None),
        (matched, "DONE_TEXT_MATCH", F.concat(F.lit("page fingerprint match ("), _percent("__coverage"), F.lit(" of pages)")), "text"),
        (yes("i_some") & ~yes("i_vague"), "DONE_IMAGE_MATCH", F.coalesce(by_image, F.lit("page image fingerprint match")), "image"),
        (yes("i_some"), "BORDERLINE", F.lit("ambiguous page image match; verify before scanning"), "image"),
        (yes("raw"), "REMAINING_RAW_COPY", F.lit("output contains only an unrenamed copy of this file"), None),
        (F.col("__score") >= weak, "BORDERLINE", F.lit("weak match; verify before scanning"), "text"),
        (unseen, "UNREADABLE", F.lit("no usable text layer or page images; cannot compare safely"), None),
        (F.lit(True), "REMAINING_NO_OUTPUT", F.lit("no finalized output found"), None),
    )
    rung = F.lit(len(rungs) - 1)
    for i, (holds, *_) in reversed([*enumerate(rungs[:-1])]):
        rung = F.when(holds, i).otherwise(rung)
    rows = rows.withColumn("__rung", rung)
    at = lambda values: F.coalesce(*(F.when(F.col("__rung") == i, v) for i, v in enumerate(values)))
    source = lambda name: F.col("__rung").isin(*(i for i, r in enumerate(rungs) if r[3] == name))
    image = source("image")
    return rows.select(
        "doc_id", at([F.lit(r[1]) for r in rungs]).alias("status"), F.when(source("text"), F.col("__out_id")).when(image, F.col("__i_out")).alias("out_id"),
        F.when(image, F.col("__i_score")).when(F.col("__rung") == 1, F.lit(1.0)).otherwise(F.col("__score")).alias("score"), F.col("__coverage").alias("coverage"), F.when(image, F.col("__i_pages")).otherwise(F.col("__pages")).alias("pages"),
        at([r[2] for r in rungs]).alias("reason"), F.when(F.col("__rung") == 1, F.col("__recorded").cast("string")).alias("recorded"),
    )


def _percent(share: str) -> Column:
    """A share in whole percents, halves to the even one."""
    return F.concat(F.bround(F.col(share) * 100, 0).cast("long").cast("string"), F.lit("%"))


def covering_inputs(matches: DataFrame) -> DataFrame:
    """doc_id, out_id, score, pages -> doc_id, out_id, kept: which inputs add pages to their shared output.

    Inputs of an output go by score, then number of pages, then id; one is kept if it names no pages or
    is the first that names some page.  So the first input of every (output, page) is all that is needed, and
    no output is gathered in one task.  Null pages count as none; an empty table gives an empty result.
    """
    rows = matches.select("doc_id", "out_id", "score", F.coalesce("pages", F.array().cast("array<int>")).alias("pages"))
    place = F.struct((-F.col("score")).alias("s"), (-F.size("pages")).alias("n"), "doc_id")
    first = rows.select("out_id", F.explode("pages").alias("page"), place.alias("place")).groupBy("out_id", "page").agg(F.min("place").alias("place"))
    leads = first.select("out_id", F.col("place.doc_id").alias("doc_id"), F.lit(True).alias("__leads")).distinct()
    return rows.join(leads, ["out_id", "doc_id"], "left").select("doc_id", "out_id", ((F.size("pages") == 0) | F.coalesce("__leads", F.lit(False))).alias("kept"))


def with_shared(rows: DataFrame) -> DataFrame:
    """Statuses (and reasons, where there are any) after the pass over outputs that several inputs match."""
    matched = rows.filter("status in ('DONE_TEXT_MATCH', 'DONE_IMAGE_MATCH')").select("doc_id", "out_id", "score", "pages")
    # Counts by output are joined back, as a window would gather all inputs of an output in one task.
    several = matched.join(matched.groupBy("out_id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1"), "out_id").drop("__n")
    cover = covering_inputs(several)
    cover = cover.join(cover.groupBy("out_id").agg(F.count_if("kept").alias("__kept")), "out_id")
    merged = F.concat(F.col("__kept").cast("string"), F.lit(" inputs map to different pages of the same output; likely merged"))
    twice = F.lit("matches the same pages as another input; likely a duplicate page or shared template")
    changed = cover.select("doc_id", F.when(~F.col("kept"), F.struct(F.lit("BORDERLINE").alias("status"), twice.alias("reason"))).when(F.col("__kept") > 1, F.struct(F.lit("SHARED_OUTPUT").alias("status"), merged.alias("reason"))).alias("__new"))
    joined = rows.join(changed, "doc_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(f"__new.{c}"), c) for c in ("status", "reason") if c in rows.columns}).drop("__new")


def output_statuses(outputs: DataFrame, rows: DataFrame, input_shas: DataFrame) -> DataFrame:
    """outputs (out_id, sha, final and, if known, error) -> out_id, status, inputs, matched_inputs, reason.

    ``rows``: doc_id, status, out_id and, if known, path of the inputs; those that are done or share an output
    serve it.  A final output is matched, shared or an orphan, whatever its bytes; an unfinished one is a
    raw copy if an input has its hash, else an orphan.  ``matched_inputs`` are the paths (or ids) in order;
    each of them adds pages to the output, so there are not more than it has pages.  A null ``final`` is
    unfinished, a null hash is nobody's copy; empty tables serve nothing.
    """
    serving = rows.filter("out_id is not null and (status like 'DONE%' or status = 'SHARED_OUTPUT')")
    named = F.col("path") if "path" in rows.columns else F.col("doc_id").cast("string")
    used = serving.groupBy("out_id").agg(F.count(F.lit(1)).alias("__inputs"), F.sort_array(F.collect_list(named)).alias("__matched"))
    raw = input_shas.select(F.col("sha").alias("__sha")).filter("__sha is not null").distinct().withColumn("__raw", F.lit(True))
    error = F.nullif(F.col("error"), F.lit("")) if "error" in outputs.columns else F.lit(None).cast("string")
    j = outputs.select("out_id", F.col("sha").alias("__sha"), F.coalesce("final", F.lit(False)).alias("__final"), error.alias("__error")).join(used, "out_id", "left").join(raw, "__sha", "left")
    served, copy = F.col("__final") & (F.col("__inputs") > 0), ~F.col("__final") & F.coalesce("__raw", F.lit(False))
    status = F.when(served & (F.col("__inputs") > 1), "SHARED_OUTPUT").when(served, "MATCHED").when(copy, "RAW_COPY").otherwise("ORPHAN_OUTPUT")
    orphan = F.coalesce("__error", F.when(F.col("__final"), "no input matched this finalized file").otherwise("unrecognized file in output"))
    reason = F.when(served, F.coalesce("__error", F.lit(""))).when(copy, "byte-identical to an input PDF; not finalized").otherwise(orphan)
    matched = F.coalesce("__matched", F.array().cast("array<string>"))
    return j.select("out_id", status.alias("status"), F.coalesce("__inputs", F.lit(0)).alias("inputs"), matched.alias("matched_inputs"), reason.alias("reason"))


def report(inputs, outputs, session, manifest, input_pages, output_pages, out_paths, input_images=None, output_images=None, document: float = 0.85, page_least: float = 0.75) -> DataFrame:
    """The whole reconciliation, one row per input: doc_id, path, status, out_id, output_match, score, coverage,
    pages, reason.

    inputs: doc_id, path, sha; outputs: out_id, sha, final and, if known, name.  Only final outputs are
    compared.  Expensive matching is done only for inputs that no cheaper rung settles: of texts first, then
    of page images (doc_id, page_idx, hash, ink) for what texts leave open.  Text scores under 0.6 decide
    nothing; without a covered page they are not looked for and are null.  ``output_match`` is the name of the
    output (its id without names) or what the manifest recorded, else empty.
    """
    flags = manifest_flags(inputs, manifest, out_paths)
    settled = session.filter("reviewed or pending or auto").select("doc_id").union(flags.filter("in_manifest").select("doc_id")).distinct()
    final = outputs.filter("final").select(F.col("out_id").alias("doc_id")).distinct()
    best = best_text_matches(input_pages.join(settled, "doc_id", "left_anti"), output_pages.join(final, "doc_id", "left_semi"), page_least=page_least)
    images = pictured = None
    if input_images is not None and output_images is not None:
        best = written(best, "report-texts")
        pictured = input_images.select("doc_id")
        by_text = best.filter((F.col("coverage") >= 0.8) & (F.col("score") >= document)).select("doc_id")
        unsettled = input_images.join(settled, "doc_id", "left_anti").join(by_text, "doc_id", "left_anti")
        images = best_image_matches(unsettled, output_images.join(final, "doc_id", "left_semi"))
    rows = statuses(inputs, session, flags, outputs.filter("not final").select("sha"), best, input_pages, document, images=images, pictured=pictured)
    # Written, as the pass over shared outputs reads it several times.
    rows = with_shared(written(rows, "report-rows"))
    names = outputs.select("out_id", (F.col("name") if "name" in outputs.columns else F.col("out_id").cast("string")).alias("__name"))
    rows = rows.join(names, "out_id", "left").join(inputs.select("doc_id", F.col("path").alias("__path")), "doc_id")
    return rows.select("doc_id", F.col("__path").alias("path"), "status", "out_id", F.coalesce("__name", "recorded", F.lit("")).alias("output_match"), "score", "coverage", "pages", "reason")
