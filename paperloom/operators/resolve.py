"""Names against a roster: best and second-best matches, and corroboration across sources."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fuzzy import Roster, token_set_ratio
from ..functions.text import STRONG_RE, company_form, is_regulator, match_form, words
from ..sources.shared import written
from .detectors import CASE_HEADER, COMPLAINANT, HEAD_LINES, RESPONDENT, candidates, caption_keywords, header_corroborated, keyword_windows, lines_of, sender_region, with_captions

# Least score and boost by source, in the order of their labels; sources that confirm alone.
PROFILES = (("learned", 60, 10), ("caption", 80, 10), ("routing_slip", 80, 10), ("letterhead", 72, 6), ("signature", 72, 6), ("gazetteer", 68, 5), ("keyword", 88, 0), ("folder", 95, 0))
STRONG_SOURCES = ("learned", "caption", "routing_slip", "letterhead", "signature", "gazetteer")
OTHER_LEAST, MATCH_LEAST, WEAK_MOST = 95, 65, 89
DIGITS, CUT_SOURCES = "0123456789", ("caption", "routing_slip", "letterhead", "signature")
CHUNK, PART, BROADCAST_ROWS = 1000, 20_000, 100_000


def roster_matches(names: DataFrame, roster: DataFrame, normalize: bool = True, least: int = 0) -> DataFrame:
    """(name) and (entry, ord) -> name, entry, score, second: the best entry by token-set ratio.

    Scores are cut to whole numbers; ties go to the entry first in order; ``second`` is the best score
    among entries that differ from the best one.  Each distinct name is scored once against every chunk of the
    roster, ``PART`` names and ``CHUNK`` entries in a task at most; a bound rules out most entries unscored.
    With ``least``, lower scores may be missing.
    """
    distinct = names.select("name").distinct().withColumn("form", company_form(F.col("name")) if normalize else F.col("name"))
    distinct = written(distinct.filter("name is not null"), "roster-names")
    parts = max(1, -(-distinct.count() // PART))
    span = roster.agg(F.floor(F.min("ord") / CHUNK).alias("lo"), F.floor(F.max("ord") / CHUNK).alias("hi")).filter("lo is not null")
    asked = distinct.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts))).join(F.broadcast(span))  # one row
    asked = asked.select("name", "form", "part", F.explode(F.sequence("lo", "hi")).alias("chunk"))
    entries = roster.select("entry", "ord", F.floor(F.col("ord") / CHUNK).alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict = {"name": [], "entry": [], "ord": [], "score": []}
        held = sorted(zip(right.column("ord").to_pylist(), right.column("entry").to_pylist(), strict=True))
        known = Roster([e for _, e in held])
        for name, form in zip(left.column("name").to_pylist(), left.column("form").to_pylist(), strict=True) if held else ():
            for s, i in known.two_best(form or "", least):
                for k, v in (("name", name), ("entry", held[i][1]), ("ord", held[i][0]), ("score", s)):
                    out[k].append(v)
        return pa.table(out, schema=pa.schema([("name", pa.string()), ("entry", pa.string()), ("ord", pa.int64()), ("score", pa.int32())]))

    found = asked.groupBy("chunk", "part").cogroup(entries.groupBy("chunk", "part")).applyInArrow(score, "name string, entry string, ord long, score int")
    w = W.partitionBy("name").orderBy(F.desc("score"), "ord")
    ranked = found.withColumns({"rn": F.row_number().over(w), "top": F.first("entry").over(w)})
    return ranked.groupBy("name").agg(
        F.max(F.when(F.col("rn") == 1, F.col("entry"))).alias("entry"),
        F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("entry") != F.col("top"), F.col("score"))).alias("second"),
    )


def margin_matches(matches: DataFrame, least: int = 90, margin: int = 10) -> DataFrame:
    """Matches of at least ``least`` that beat the second-best entry by ``margin``."""
    return matches.filter((F.col("score") >= least) & (F.col("second").isNull() | (F.col("score") - F.col("second") >= margin)))


def in_order(hay, needle):
    """Whether the words of ``needle`` occur in ``hay`` in their order, gaps allowed."""
    step = lambda at, w: F.when(at < F.size(needle), F.when(F.get(needle, at) == w, at + 1).otherwise(at)).otherwise(at)
    return (F.size(needle) > 0) & (F.aggregate(hay, F.lit(0), step) == F.size(needle))


def gazetteer(texts: DataFrame, roster: DataFrame) -> DataFrame:
    """(doc_id, sender, body) and the roster -> doc_id, entry, weight: entries whose words occur in order.

    Regulators are no entries.  The sender region weighs 0.9, the whole text 0.7.  An entry can only occur where its rarest word does,
    so texts and entries meet in an equi-join on that word.
    """
    hay = texts.select("doc_id", words(F.col("sender")).alias("sender"), words(F.col("body")).alias("body"))
    entries = roster.filter(~is_regulator(F.col("entry"))).select("entry", words(F.col("entry")).alias("needle")).filter(F.size("needle") > 0)
    common = entries.select(F.explode(F.array_distinct("needle")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    keyed = entries.select("entry", "needle", F.explode(F.array_distinct("needle")).alias("word")).join(common, "word").groupBy("entry", "needle").agg(F.min(F.struct("n", "word")).alias("k")).select("entry", "needle", F.col("k.word").alias("word"))
    said = hay.select("doc_id", F.explode(F.array_distinct(F.concat("body", "sender"))).alias("word"))
    pairs = said.join(keyed, "word").join(hay, "doc_id")
    weight = F.when(in_order(F.col("sender"), F.col("needle")), F.lit(0.9)).when(in_order(F.col("body"), F.col("needle")), F.lit(0.7))
    return pairs.select("doc_id", "entry", weight.alias("weight")).filter("weight is not null")


def keyword_candidates(pages: DataFrame, roster: DataFrame) -> DataFrame:
    """doc_id, page_idx, entry: of each page, the entry that the first of its keyword windows matches beyond doubt."""
    windows = pages.select("doc_id", "page_idx", F.posexplode(keyword_windows(F.col("page_text"))).alias("i", "name"))
    # A second score under 80 is beaten by any match of 90 or more.
    sure = margin_matches(roster_matches(windows, roster, normalize=False, least=80)).select("name", "entry")
    return windows.join(sure, "name").groupBy("doc_id", "page_idx").agg(F.min_by("entry", "i").alias("entry"))


def all_candidates(pages: DataFrame, roster: DataFrame, folders: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """The eight detectors: doc_id, ord, name, source, weight, in the order in which they count.

    Captions, routing slips, letterheads and signatures from the text; roster (entry, ord) entries whose words
    occur in order; entries that keyword windows match; ``folders`` (doc_id, ord, name) that look like companies;
    and what was learned for a folder or a line of a letterhead (``hints``: kind, key, company).  Blank pages
    and null texts yield nothing.
    """
    pages = pages.select("doc_id", "page_idx", "page_text").filter(F.trim("page_text") != "")
    place = lambda d, o: (F.lit(d * 10**12) + o).cast("long").alias("ord")
    as_rows = lambda rows, d, o, name, source, weight: rows.select("doc_id", place(d, o), F.col(name).alias("name"), F.lit(source).alias("source"), weight.alias("weight"))
    found = candidates(pages).unionByName(as_rows(gazetteer(sender_region(pages), roster).join(roster.select("entry", "ord"), "entry"), 4, F.col("ord"), "entry", "gazetteer", F.col("weight")))
    found = found.unionByName(as_rows(keyword_candidates(pages, roster), 5, F.col("page_idx"), "entry", "keyword", F.lit(0.6)))
    if folders is not None:
        found = found.unionByName(as_rows(folder_hints(folders.select("doc_id", "ord", "name"), roster), 6, F.col("ord"), "name", "folder", F.lit(0.4)))
    if hints is not None:
        learned = lambda kind: hints.filter(F.col("kind") == kind).select("key", "company")
        if folders is not None:
            by_folder = folders.select("doc_id", "ord", F.col("name").alias("key")).join(learned("folders"), "key")
            found = found.unionByName(as_rows(by_folder, 7, F.col("ord"), "company", "learned", F.lit(0.95)))
        heads = pages.select("doc_id", "page_idx", F.posexplode(F.slice(lines_of(F.col("page_text")), 1, HEAD_LINES)).alias("i", "line")).withColumn("key", match_form(F.col("line")))
        found = found.unionByName(as_rows(heads.join(learned("letterheads"), "key"), 7, F.lit(10**9) + F.col("page_idx") * 100 + F.col("i"), "company", "learned", F.lit(0.95)))
    return written(found, "company-candidates")


def text_candidates(pages: DataFrame) -> DataFrame:
    """The candidates of the detectors that need nothing but the texts, cut out once and written."""
    return written(candidates(pages), "company-candidates")


def profile(column: str, place: int, other: int):
    out = F.lit(other)
    for p in PROFILES:
        out = F.when(F.col(column) == p[0], F.lit(p[place])).otherwise(out)
    return out


def source_label(sources):
    order = F.array(*(F.lit(p[0]) for p in PROFILES))
    rank = lambda s: F.struct(F.coalesce(F.nullif(F.array_position(order, s), F.lit(0)), F.lit(100)).alias("r"), s.alias("s"))
    return F.array_join(F.transform(F.sort_array(F.transform(sources, rank)), lambda x: x["s"]), "+")


def combined(docs: DataFrame, candidates: DataFrame, matches: DataFrame, threshold: int = 90) -> DataFrame:
    """(doc_id), candidates (doc_id, ord, name, source, weight) and their roster matches -> one row per doc.

    Candidates that match the same entry support each other; the entry with the most sources, then the
    highest confidence, then the best score, then the first candidate wins.  Two sources decide; a lone
    weak source stays below.  Without a match the folder, else the heaviest candidate, is suggested.
    The candidates are read several times: give a table that is written (``text_candidates``, ``all_candidates``).
    """
    return _with_defaults(docs.select("doc_id").join(_winners(candidates, matches, threshold), "doc_id", "left"), threshold)


def _winners(candidates: DataFrame, matches: DataFrame, threshold: int) -> DataFrame:
    """What is decided or suggested for each document that has a candidate."""
    scored = candidates.join(matches.select("name", "entry", "score"), "name", "left").filter((F.col("score") >= MATCH_LEAST) & F.col("entry").isNotNull())
    conf = F.when(F.col("score") >= profile("source", 1, OTHER_LEAST), F.least(F.lit(100), F.col("score") + profile("source", 2, 0))).otherwise(0)
    groups = scored.groupBy("doc_id", "entry").agg(
        F.collect_set("source").alias("sources"), F.max(conf).alias("conf"), F.max("score").alias("fuzzy"), F.min("ord").alias("first"),
        F.min_by("name", F.when(F.col("source") == "letterhead", F.col("ord"))).alias("letterhead"),
    )
    w = W.partitionBy("doc_id").orderBy(F.desc(F.size("sources")), F.desc("conf"), F.desc("fuzzy"), "first")
    best = groups.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    agreed = F.size("sources") >= 2
    confidence = F.when(agreed, F.greatest(F.col("conf"), F.lit(threshold), F.lit(90))).when(F.col("sources")[0].isin(*STRONG_SOURCES), F.col("conf")).otherwise(F.least(F.col("conf"), F.lit(WEAK_MOST)))
    won = best.select("doc_id", F.col("entry").alias("company_name"), F.col("entry").alias("matched"), F.col("fuzzy").alias("score"), F.least(confidence, F.lit(100)).alias("confidence"), source_label(F.col("sources")).alias("tier"), agreed.alias("cross_validated"))
    rest = candidates.join(won.select("doc_id"), "doc_id", "left_anti")
    v = W.partitionBy("doc_id").orderBy((F.col("source") == "folder").desc(), F.when(F.col("source") == "folder", F.lit(0.0)).otherwise(-F.col("weight")), "ord")
    raw = rest.withColumn("rn", F.row_number().over(v)).filter("rn = 1")
    raw = raw.select("doc_id", F.trim("name").alias("company_name"), F.lit(None).cast("string").alias("matched"), F.lit(None).cast("int").alias("score"), F.lit(0).alias("confidence"), F.col("source").alias("tier"), F.lit(False).alias("cross_validated"))
    return won.unionByName(raw)


def _with_defaults(out: DataFrame, threshold: int) -> DataFrame:
    c = F.coalesce("confidence", F.lit(0))
    label = F.when(F.col("matched").isNull(), "none").when(c >= threshold, "high").when(c >= 60, "medium").otherwise("low")
    return out.select(
        "doc_id", F.coalesce("company_name", F.lit("")).alias("company_name"), "matched", "score", c.alias("confidence"), F.coalesce("tier", F.lit("unresolved")).alias("tier"),
        F.coalesce("cross_validated", F.lit(False)).alias("cross_validated"), label.alias("label"), (c < threshold).alias("needs_review"),
    )


def free_digits(roster: DataFrame, hints: DataFrame | None = None) -> str:
    """The digits that no roster entry has and no line's hint can match on: they only fill places in a text."""
    told = roster.select(F.col("entry").alias("text"))
    if hints is not None:
        # Lines are looked up in match form, so other keys are never met.
        told = told.union(hints.filter((F.col("kind") == "letterheads") & (F.col("key") == match_form(F.col("key")))).select("key"))
    held = told.agg(*(F.max(F.contains("text", F.lit(d))).alias(d) for d in DIGITS)).first()
    return "".join(d for d in DIGITS if not held[d])


def document_forms(pages: DataFrame, free: str, folders: DataFrame | None = None) -> DataFrame:
    """doc_id, form: documents of one form differ in nothing but ``free`` digits, and have the same folders.

    Of digits it counts where they stand and which runs of them are equal, as words of a window are a set, and also how the runs are
    sorted where entries have digits; a page on which digits touch letters stays as it is, as such words are sorted among others by
    their digits.  A page number held twice makes a form of its own.
    """
    t, runs, known = F.col("page_text"), F.col("__runs"), F.col("__known")
    cut = pages.withColumn("__runs", F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0)))
    cut = cut.withColumn("__known", runs if len(free) == len(DIGITS) else F.array_sort(F.array_distinct(runs)))
    equal = F.array_join(F.transform(runs, lambda r: F.array_position(known, r).cast("string")), ",")
    bare = F.concat(equal, F.lit("|"), F.regexp_replace(t, f"[{free}]", free[0])) if free else F.concat(F.lit("|"), t)
    what = F.sha2(F.when(t.rlike(r"[0-9](?:(?=\p{L})|(?<=\p{L}[0-9]))"), F.concat(F.lit("|"), t)).otherwise(bare), 256)
    rows = cut.select("doc_id", F.lit("page").alias("kind"), F.col("page_idx").cast("long").alias("at"), what.alias("what"))
    if folders is not None:
        rows = rows.unionByName(folders.select("doc_id", F.lit("folder").alias("kind"), F.col("ord").cast("long").alias("at"), F.col("name").alias("what")))
    held = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("kind", "at", "what"))).alias("held"))
    twice = F.size(F.array_distinct(F.transform("held", lambda x: F.struct(x["kind"], x["at"])))) < F.size("held")
    return held.select("doc_id", F.unhex(F.sha2(F.to_json(F.struct("held", F.when(twice, F.col("doc_id")).alias("own"))), 256)).alias("form"))


def resolved(docs: DataFrame, pages: DataFrame, roster: DataFrame, folders: DataFrame | None = None, hints: DataFrame | None = None, threshold: int = 90) -> DataFrame:
    """``combined`` over ``all_candidates``, one row per doc, but documents of one form (``document_forms``) are searched once.

    The detectors take every digit alike, so what they find in one document of a form stands in all, at the same places.  Where a name
    cut out of the text holds a free digit, the form's other documents are searched on their own.  The pages are
    read up to three times: give a table that is written, or cheap.
    """
    pages = pages.select("doc_id", "page_idx", "page_text").filter(F.trim("page_text") != "")
    roster = written(roster.select("entry", "ord"), "roster")
    free = free_digits(roster, hints)
    forms = written(document_forms(pages, free, folders), "document-forms")
    # A form may hold most documents, so few forms are sent to them rather than they to their form.
    small = lambda rows: F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    first = written(forms.groupBy("form").agg(F.min("doc_id").alias("rep")), "forms")
    stands = forms.join(small(first), "form").select("doc_id", "rep")

    def searched(ids: DataFrame) -> DataFrame:
        # Written, as the detectors read both several times and would else sift all documents each time.
        of = lambda rows, name: None if rows is None else written(rows.join(ids, "doc_id", "left_semi"), name)
        return all_candidates(of(pages, "searched-pages"), roster, of(folders, "searched-folders"), hints)

    found = searched(first.select(F.col("rep").alias("doc_id")))
    if free:
        loose = found.filter(F.col("source").isin(*CUT_SOURCES) & F.col("name").rlike(f"[{free}]")).select(F.col("doc_id").alias("rep")).distinct()
        others = written(stands.filter("doc_id <> rep").join(loose, "rep", "left_semi").select("doc_id"), "searched-ids")
        if not others.isEmpty():
            found = found.unionByName(searched(others))
            stands = stands.join(others.select("doc_id", F.lit(True).alias("alone")), "doc_id", "left").select("doc_id", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("rep")).alias("rep"))
    won = written(_winners(found, roster_matches(found, roster), threshold).withColumnRenamed("doc_id", "rep"), "winners")
    return _with_defaults(docs.select("doc_id").join(stands.join(small(won), "rep"), "doc_id", "left"), threshold)


def folder_hints(folders: DataFrame, roster: DataFrame, least: int = 95) -> DataFrame:
    """Folder names (column name) that look like companies, in the roster's spelling where it is certain."""
    named = folders.filter(match_form(F.col("name")).rlike(STRONG_RE) & ~is_regulator(F.col("name")))
    found = roster_matches(named, roster, normalize=False).filter(F.col("score") >= least)
    upper = roster_matches(named.select(F.upper("name").alias("name")), roster, normalize=False).filter(F.col("score") >= least)
    best = found.select("name", "entry").unionByName(upper.select("name", "entry"))
    joined = named.withColumn("__n", F.upper("name")).join(best.select(F.upper("name").alias("__n"), "entry").distinct(), "__n", "left")
    return joined.withColumn("name", F.coalesce("entry", match_form(F.col("name")))).drop("__n", "entry").withColumns({"source": F.lit("folder"), "weight": F.lit(0.4)})


def snapped(names: DataFrame, matches: DataFrame, least: int = 70) -> DataFrame:
    """Chosen names in the roster's spelling where they match it well enough."""
    return names.join(matches.select("name", "entry", "score"), "name", "left").withColumn("chosen", F.when(F.col("score") >= least, F.col("entry")).otherwise(F.col("name")))


# Least score by how far a tier is trusted; an unknown tier never confirms.
HIGH_TIERS = ("caption", "caption_wide", "routing_slip", "complainant_respondent")
MEDIUM_TIERS = ("caption_keyword", "full_keyword")
TIER_LEAST = {"cross_validated": 70, "high": 80, "medium": 90, "header_corroborated": 85, "other": 999}


def tier_matches(names: DataFrame, matches: DataFrame, cross_validated: str | None = None) -> DataFrame:
    """(name, tier) and their roster matches -> company_name, confidence, label, needs_review.

    A match at the tier's least score confirms, with ten points more for trusted tiers; a lower one is a
    suggestion.  Keyword windows over the full text also need a clear lead over the second-best entry.
    """
    rows = names.join(matches, "name", "left")
    t, s = F.col("tier"), F.col("score")
    crossed = F.coalesce(F.col(cross_validated), F.lit(False)) if cross_validated else F.lit(False)
    least = F.when(crossed, TIER_LEAST["cross_validated"]).when(t.isin(*HIGH_TIERS), TIER_LEAST["high"]).when(t.isin(*MEDIUM_TIERS), TIER_LEAST["medium"]).when(t == "header_corroborated", TIER_LEAST["header_corroborated"]).otherwise(TIER_LEAST["other"])
    clear = (t != "full_keyword") | ((s >= 90) & (F.col("second").isNull() | (s - F.col("second") >= 10)))
    known = F.col("entry").isNotNull() & clear
    confirmed = known & (s >= least)
    high = t.isin(*HIGH_TIERS)
    return rows.select(
        *names.columns,
        F.when(known, F.col("entry")).otherwise(F.col("name")).alias("company_name"),
        F.when(confirmed, F.least(F.lit(100), s + F.when(high, 10).otherwise(0))).when(known, s).otherwise(0).alias("confidence"),
        F.when(confirmed & (crossed | high), "high").when(confirmed, "medium").when(known, "low").otherwise("none").alias("label"),
        (~confirmed).alias("needs_review"),
    )


def similar_names(a: str, b: str, least: int = 70) -> Column:
    """Whether two columns of names are alike; false where one is null."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([p is not None and q is not None and token_set_ratio(p, q) >= least for p, q in zip(x, y, strict=True)], dtype=bool)

    return alike(F.col(a), F.col(b))


def tier_ladder(pages: DataFrame, roster: DataFrame) -> DataFrame:
    """doc_id, name, tier, cross_validated, company_name, confidence, label, needs_review: one row per document.

    The first tier that names a company decides: the caption of the best page (a case header counts 4, both
    parties 2, a strong keyword 1; a page without any of these does not count, the first of equals does), then of the
    first page that has one the routing slip, the wide caption, the words between the parties, the caption's keywords,
    a keyword window that the roster matches beyond doubt, and the corroborated header.  Caption and routing slip
    confirm each other if they are alike.  Without any, the name is empty, the tier "unresolved".
    """
    docs, t = pages.select("doc_id").distinct(), F.col("page_text")
    pages = pages.select("doc_id", "page_idx", "page_text").filter("page_text <> ''")
    rows = with_captions(pages).withColumns({"caption_keyword": caption_keywords(t), "header_corroborated": header_corroborated(t)})
    marks = F.when(t.rlike(CASE_HEADER), 4).otherwise(0) + F.when(t.rlike(f"(?i){COMPLAINANT}") & t.rlike(f"(?i){RESPONDENT}"), 2).otherwise(0) + F.when(F.col("caption").rlike(STRONG_RE), 1).otherwise(0)
    first = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("page_idx"))).alias(c)
    best = rows.withColumn("marks", F.when(F.col("caption") != "", marks)).groupBy("doc_id").agg(
        F.max_by("caption", F.when(F.col("marks") > 0, F.struct("marks", -F.col("page_idx")))).alias("caption"), first("routing_slip"), first("caption_wide"),
        first("between_parties"), first("caption_keyword"), first("header_corroborated"),
    )
    best = written(docs.join(best, "doc_id", "left"), "ladder-names")
    # Keyword windows are matched only where no surer tier names a company.
    tiers = (("caption", "caption"), ("routing_slip", "routing_slip"), ("caption_wide", "caption_wide"), ("complainant_respondent", "between_parties"), ("caption_keyword", "caption_keyword"))
    open_ = best.filter(F.coalesce(*(F.col(c) for _, c in tiers)).isNull()).select("doc_id")
    full = keyword_candidates(pages.join(open_, "doc_id", "left_semi"), roster).groupBy("doc_id").agg(F.min_by("entry", "page_idx").alias("full_keyword"))
    tiers += (("full_keyword", "full_keyword"), ("header_corroborated", "header_corroborated"))
    chosen = F.coalesce(*(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("name"), F.lit(tier).alias("tier"))) for tier, c in tiers), F.struct(F.lit("").alias("name"), F.lit("unresolved").alias("tier")))
    named = best.join(full, "doc_id", "left").withColumn("cross_validated", similar_names("caption", "routing_slip"))
    named = named.select("doc_id", "cross_validated", chosen.alias("n")).select("doc_id", "n.name", "n.tier", "cross_validated")
    return tier_matches(named, roster_matches(named.filter("name <> ''"), roster), "cross_validated")
