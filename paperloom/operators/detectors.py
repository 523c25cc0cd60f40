"""Company names in page texts.

Each detector takes pages (doc_id, page_idx, page_text) and yields candidates (doc_id, ord, name, source,
weight).  All are built-in expressions: a caption is cut out of the text with a few regular expressions,
and line-based ones work on arrays of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.windows import windows_of
from .layout import runs

# Caption words, the header of a case, the subject line, noise that opens no company name, officers' titles.
VERSUS = r"(?:-\s*versus\s*-|versus|vs\.?\s|vs\s*\.\s)"
RESPONDENT = r"\b(?:respondents?|responder)\b"
COMPLAINANT = r"\bcomplainants?\b"
CASE_HEADER = r"(?i)republic\s+of\s+the\s+philippines"
SUBJECT = r"(?i)subject\s*:\s*(.+?)(?:\n|$)"
NOISE = r"(?i)^(?:[\d\s\-/().]+$|I\.?C\.?\s*\(CAD\)|CAD\s+CASE)"
TITLES = r"president|chairman|chief\s+executive\s+officer|ceo|managing\s+director"
HEAD_LINES, SIGNATURE_LINES, SIGNATURE_CHARS = 15, 8, 500
FILLER = (
    "president", "chairman", "ceo", "chief", "executive", "officer", "managing", "director", "of", "the", "for", "by",
    "its", "his", "her", "their", "a", "an", "in", "on", "at", "to", "from", "as", "and", "or", "represented",
    "general", "manager", "but", "no", "not", "nor", "yet", "also", "too", "very", "just", "only", "now", "here",
    "there", "then", "than",
)
WINDOW_STOP = (
    "versus", "vs", "v", "the", "of", "and", "for", "by", "its", "his", "her", "their", "a", "an", "in", "on", "at",
    "to", "from",
)


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def _named(raw: Column, least: int = 2, strong_only: bool = False) -> Column:
    """The normal form of a raw name that has a strong keyword or (unless barred) three words."""
    form, n = X.company_form(raw), F.size(_words(raw))
    strong = form.rlike(X.STRONG_RE)
    return F.when((n >= least) & (strong if strong_only else (strong | (n >= 3))), form)


def _parts(text: Column, pattern: str) -> Column:
    """What stands before and after the first match; one part without a match.  One pass finds both."""
    return F.split(text, f"(?i){pattern}", 2)


def _after(text: Column, pattern: str) -> Column:
    """What follows the first match, null without one."""
    return F.get(_parts(text, pattern), F.lit(1))


def _before(text: Column, pattern: str) -> Column:
    parts = _parts(text, pattern)
    return F.when(F.size(parts) > 1, parts[0])


def _clause(text: Column, marks: str = "[.]") -> Column:
    return X.without_edge_marks(F.get(F.split(text, marks), F.lit(0)))


def between_parties(text: Column) -> Column:
    """The first clause that names a company between "versus" and "Respondent", after "Complainant"."""
    span = _after(_before(_after(text, COMPLAINANT), RESPONDENT), VERSUS)
    clauses = F.transform(F.split(F.regexp_replace(span, r"\s*\n\s*", " "), "[,.]"), lambda c: X.without_edge_marks(c))
    real = F.filter(clauses, lambda c: (c != "") & ~c.rlike(NOISE))
    return F.get(F.filter(F.transform(real, lambda c: _named(c)), lambda c: c.isNotNull()), F.lit(0))


def caption(text: Column) -> Column:
    after = _after(text, VERSUS)
    return F.coalesce(between_parties(text), _named(_clause(F.coalesce(_after(after, RESPONDENT), after))))


def caption_wide(text: Column) -> Column:
    """Between the first two "Respondent", else the six, five or four words before the first."""
    between = X.without_edge_marks(_before(_after(text, RESPONDENT), RESPONDENT))
    before = _words(_before(text, RESPONDENT))
    last = lambda n: F.when(F.size(before) >= n, X.without_edge_marks(F.array_join(F.slice(before, -n, n), " ")))
    return F.coalesce(_named(between, strong_only=True), *(_named(last(n), 1, strong_only=True) for n in (6, 5, 4)))


def routing_slip(text: Column) -> Column:
    subject = F.when(text.rlike(SUBJECT), F.trim(F.regexp_extract(text, SUBJECT, 1)))
    after = _after(subject, VERSUS)
    return F.coalesce(_named(_clause(F.coalesce(_after(after, RESPONDENT), after))), _named(F.trim(F.get(F.split(subject, "[.,]"), F.lit(0))), strong_only=True))


def header_corroborated(text: Column) -> Column:
    """Words between an officer's title and a near "Respondent", without filler words."""
    from_title = F.substring(F.regexp_extract(text, rf"(?is)((?:{TITLES}).*)$", 1), 1, 500)
    between = _words(_before(from_title, RESPONDENT))
    kept = F.filter(between, lambda w: ~F.lower(w).isin(*FILLER))
    return F.when((F.size(between) <= 15) & (F.size(kept) >= 2), _named(X.without_edge_marks(F.array_join(kept, " ")), strong_only=True))


def _normal_windows(windows: Column) -> Column:
    """Windows of four characters or more without marks, in normal form."""
    bare = F.transform(windows, lambda w: F.trim(F.regexp_replace(F.regexp_replace(w, r"[.,:;\-|/]+", " "), r"\s+", " ")))
    return F.transform(F.filter(bare, lambda w: F.length(w) >= 4), X.company_form)


def caption_keywords(text: Column) -> Column:
    """The first keyword before "Respondent" whose window, four words before and three after it, has a strong
    keyword in its normal form."""
    windows = _normal_windows(windows_of(_before(text, RESPONDENT), X.ANY_KEYWORD_RE.removeprefix("(?i)"), 4, 3, WINDOW_STOP))
    return F.get(F.filter(windows, lambda w: w.rlike(X.STRONG_RE)), F.lit(0))


def keyword_windows(text: Column) -> Column:
    """Every keyword with up to six words before and four after it, in normal form; windows overlap."""
    return _normal_windows(windows_of(text, X.ANY_KEYWORD_RE.removeprefix("(?i)"), 6, 4))


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def head_lines(text: Column) -> Column:
    """Up to fifteen lines from the top, ending before the addressee."""
    lines = lines_of(text)
    stop = F.array_position(F.transform(lines, lambda x: x.rlike(X.ADDRESSEE_RE)), True)
    n = F.least(F.when(stop > 0, stop - 1).otherwise(F.size(lines)), F.lit(HEAD_LINES)).cast("int")
    return F.slice(lines, F.lit(1), n)


def _company_line(line: Column) -> Column:
    return X.match_form(line).rlike(X.STRONG_RE) & ~X.is_regulator(line)


def letterheads(pages: DataFrame) -> DataFrame:
    """Runs of up to four heading lines at the top of a page that name a company."""
    lines = pages.select("doc_id", "page_idx", F.posexplode(head_lines(F.col("page_text"))).alias("i", "line")).withColumn("heading", X.is_heading(F.col("line")))
    blocks = runs(lines, ["doc_id", "page_idx"], "i", "heading").groupBy("doc_id", "page_idx", "run").agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("l"))
    names = blocks.select("doc_id", "page_idx", F.col("l")[0]["i"].alias("i"), F.array_join(F.transform("l", lambda x: x["line"]), " ").alias("name"))
    return names.filter(_company_line(F.col("name")))


def signatures(pages: DataFrame) -> DataFrame:
    """Company lines among the eight after a letter's closing."""
    after = F.regexp_extract_all("page_text", F.lit(rf"(?i)\b(?:{X.CLOSING})\b(?=([\s\S]{{0,{SIGNATURE_CHARS}}}))"), F.lit(1))
    lines = pages.select("doc_id", "page_idx", F.posexplode(after).alias("m", "after")).select("doc_id", "page_idx", "m", F.posexplode(F.slice(lines_of(F.col("after")), 1, SIGNATURE_LINES)).alias("i", "name"))
    return lines.filter(_company_line(F.col("name")))


def sender_region(pages: DataFrame) -> DataFrame:
    """doc_id, sender, body: the tops of all pages with 400 characters from each closing (closings
    may overlap), and all text."""
    closing = F.regexp_extract_all("page_text", F.lit(rf"(?i)(?=(\b(?:{X.CLOSING})\b[\s\S]{{0,400}}))"), F.lit(1))
    sender = F.concat_ws(" ", F.array_join(head_lines(F.col("page_text")), " "), F.array_join(closing, " "))
    rows = pages.select("doc_id", "page_idx", sender.alias("s"), F.col("page_text").alias("t"))
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_idx", c))), lambda x: x[c]), " ")
    return rows.groupBy("doc_id").agg(text("s").alias("sender"), text("t").alias("body"))


def _form_of(raw: str) -> dict[str, Column]:
    """Columns for the normal form of a raw name and its number of words."""
    return {f"{raw}_form": X.company_form(F.col(raw)), f"{raw}_n": F.size(_words(F.col(raw)))}


def _accepted(raw: str, least: int = 2, strong_only: bool = False) -> Column:
    """As ``_named``, over the columns of ``_form_of``."""
    form, n = F.col(f"{raw}_form"), F.col(f"{raw}_n")
    strong = form.rlike(X.STRONG_RE)
    return F.when((n >= least) & (strong if strong_only else (strong | (n >= 3))), form)


def with_captions(pages: DataFrame) -> DataFrame:
    """Adds ``caption``, ``caption_wide``, ``between_parties`` and ``routing_slip`` of page_text.

    The same names as the expressions above give, but cut out step by step: every piece of text that
    several rules use is a column, so that no regular expression runs twice over a page.
    """
    own = pages.columns
    t = F.col("page_text")
    df = pages.withColumns(
        {"__v": _after(t, VERSUS), "__c": _after(t, COMPLAINANT), "__r": _after(t, RESPONDENT), "__b": _before(t, RESPONDENT), "__s": F.when(t.rlike(SUBJECT), F.trim(F.regexp_extract(t, SUBJECT, 1)))}
    )
    df = df.withColumns({"__cr": _before(F.col("__c"), RESPONDENT), "__vr": _after(F.col("__v"), RESPONDENT), "__rr": _before(F.col("__r"), RESPONDENT), "__bw": _words(F.col("__b")), "__sv": _after(F.col("__s"), VERSUS)})
    df = df.withColumns({"__span": _after(F.col("__cr"), VERSUS), "__svr": _after(F.col("__sv"), RESPONDENT)})
    last = lambda n: F.when(F.size("__bw") >= n, X.without_edge_marks(F.array_join(F.slice("__bw", -n, n), " ")))
    df = df.withColumns(
        {
            "__raw0": _clause(F.coalesce("__vr", "__v")), "__raw1": X.without_edge_marks(F.col("__rr")), "__raw2": _clause(F.coalesce("__svr", "__sv")), "__raw3": F.trim(F.get(F.split("__s", "[.,]"), F.lit(0))),
            "__raw4": last(4), "__raw5": last(5), "__raw6": last(6), "__clauses": F.transform(F.split(F.regexp_replace("__span", r"\s*\n\s*", " "), "[,.]"), X.without_edge_marks),
        }
    )
    df = df.withColumns({k: c for i in range(7) for k, c in _form_of(f"__raw{i}").items()})
    real = F.filter("__clauses", lambda c: (c != "") & ~c.rlike(NOISE))
    df = df.withColumn("__named", F.transform(real, lambda c: F.struct(X.company_form(c).alias("form"), F.size(_words(c)).alias("n"))))
    good = F.filter("__named", lambda x: (x["n"] >= 2) & ((x["n"] >= 3) | x["form"].rlike(X.STRONG_RE)))
    df = df.withColumn("between_parties", F.get(good, F.lit(0))["form"])
    return df.select(
        *own, F.coalesce("between_parties", _accepted("__raw0")).alias("caption"),
        F.coalesce(_accepted("__raw1", strong_only=True), *(_accepted(f"__raw{n}", 1, strong_only=True) for n in (6, 5, 4))).alias("caption_wide"),
        "between_parties", F.coalesce(_accepted("__raw2"), _accepted("__raw3", strong_only=True)).alias("routing_slip"),
    )


def candidates(pages: DataFrame) -> DataFrame:
    """All text detectors: doc_id, ord, name, source, weight, in the order in which they count."""
    pages = pages.filter(F.trim("page_text") != "").select("doc_id", "page_idx", "page_text")
    rule = lambda d, name, source, weight: F.struct(F.lit(d).alias("d"), F.col(name).alias("name"), F.lit(source).alias("source"), F.lit(weight).alias("weight"))
    per_page = F.array(rule(0, "caption", "caption", 0.9), rule(0, "caption_wide", "caption", 0.9), rule(0, "between_parties", "caption", 0.9), rule(1, "routing_slip", "routing_slip", 0.8))
    direct = with_captions(pages).select("doc_id", "page_idx", F.posexplode(per_page).alias("i", "c")).filter("c.name is not null and c.name <> ''")
    direct = direct.select("doc_id", (F.col("c.d") * 10**12 + F.col("page_idx") * 10**6 + F.col("i")).alias("ord"), "c.name", "c.source", "c.weight")
    lined = lambda rows, d, source, weight: rows.select("doc_id", (F.lit(d * 10**12) + F.col("page_idx") * 10**6 + F.col("i")).alias("ord"), "name", F.lit(source).alias("source"), F.lit(weight).alias("weight"))
    return direct.unionByName(lined(letterheads(pages), 2, "letterhead", 0.85)).unionByName(lined(signatures(pages), 3, "signature", 0.8))
