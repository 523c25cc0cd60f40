"""Text and naming expressions.  All are Columns of built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations, keyword classes, regulators, markers, context words and forbidden characters.
ABBREVIATIONS = (("INCORPORATED", "INC"), ("CORPORATION", "CORP"), ("INSURANCE", "INS"), ("PHILIPPINES", "PHILS"), ("COMPANY", "CO"))
STRONG = "INSURANCE|INS|CORPORATION|CORP|INCORPORATED|INC|COMPANY|CO|ASSURANCE|REINSURANCE|UNDERWRITERS|MUTUAL|PLANS|PRE-?NEED|MEMORIAL|HEALTH\\s+CARE|HMO"
WEAK = "ENTERPRISES|GROUP|HOLDINGS|ASSOCIATION|FOUNDATION|HOSPITAL|MEDICAL"
REGULATORS = ("INSURANCE COMMISSION", "OFFICE OF THE INSURANCE COMMISSIONER", "INSURANCE COMMISSIONER")
CLOSING = "very\\s+truly\\s+yours|yours\\s+faithfully|yours\\s+truly|yours\\s+sincerely|sincerely|respectfully|truly\\s+yours|faithfully\\s+yours"
ADDRESSEE = "office\\s+of\\s+the|the\\s+insurance\\s+commission|insurance\\s+commission|dear\\s+sirs?|attention\\s*:|to\\s*:"
CONTEXT_WORDS = ("date", "dated", "as of", "issued", "effective", "ref", "re:")
FORBIDDEN = '<>:"/\\|?*'
SKIPPED_FOLDERS = ("passed", "failed", "processed", "flagged", "logs", "data", "output")
EDGE_MARKS = ".,:;-|/"
FINAL_NAME = r"(?i)^(?:[0-9]{6})?[0-9]{4}_[^_]+_.+\.pdf$"

STRONG_RE, WEAK_RE, ANY_KEYWORD_RE = rf"(?i)\b(?:{STRONG})\b", rf"(?i)\b(?:{WEAK})\b", rf"(?i)\b(?:{STRONG}|{WEAK})\b"
CLOSING_RE, ADDRESSEE_RE = rf"(?i)\b(?:{CLOSING})\b", rf"(?i)(?:{ADDRESSEE})"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def match_form(text: Column) -> Column:
    """Upper case, only letters, digits and single spaces."""
    return squeezed(F.regexp_replace(F.upper(text), "[^A-Z0-9 ]", " "))


def company_form(text: Column) -> Column:
    """``match_form`` with the usual company words abbreviated."""
    out = F.upper(text)
    for word, short in ABBREVIATIONS:
        out = F.regexp_replace(out, rf"\b{word}\b", short)
    return squeezed(F.regexp_replace(out, "[^A-Z0-9 ]", " "))


def words(text: Column) -> Column:
    """Words of the match form."""
    return F.filter(F.split(match_form(text), " "), lambda w: w != "")


def page_tokens(text: Column) -> Column:
    """Distinct runs of four or more letters or digits, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{4,}"), F.lit(0)))


def without_edge_marks(text: Column) -> Column:
    return F.trim(F.btrim(F.trim(text), F.lit(EDGE_MARKS)))


def keyword_class(text: Column) -> Column:
    """strong, weak or none."""
    return F.when(text.rlike(STRONG_RE), "strong").when(text.rlike(WEAK_RE), "weak").otherwise("none")


def is_regulator(text: Column) -> Column:
    form = match_form(text)
    out = F.lit(False)
    for name in REGULATORS:
        out = out | form.contains(name)
    return out


def is_heading(line: Column) -> Column:
    """At least three letters, and mostly capitals (of all characters) or every word capitalised."""
    letters = F.length(F.regexp_replace(line, "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(line, "[^A-Z]", ""))
    title = line.rlike("[A-Z]") & ~line.rlike("[A-Za-z][A-Z]") & ~line.rlike("(^|[^A-Za-z])[a-z]")
    return (letters >= 3) & ((capitals / F.greatest(F.lit(1), F.length(line)) >= 0.7) | title)


def context_keywords(context: Column) -> Column:
    """The context words that occur anywhere in the text, in their fixed order."""
    lowered = F.lower(context)
    return F.filter(F.array(*map(F.lit, CONTEXT_WORDS)), lambda k: F.contains(lowered, k))


def division_code(text: Column) -> Column:
    """Trimmed; numbers of fewer than three digits are filled up with zeros, longer ones stay."""
    t = F.trim(text)
    return F.when(t.rlike("^[0-9]+$") & (F.length(t) < 3), F.lpad(t, 3, "0")).otherwise(t)


def safe_filename(text: Column) -> Column:
    return F.translate(text, FORBIDDEN, "_" * len(FORBIDDEN))


def final_filename(seq: Column, division: Column, company: Column, yyyymm: Column, include_date: bool = True, suffix: Column | None = None, uppercase: bool = True) -> Column:
    """[YYYYMM]NNNN_DIV_COMPANY[suffix].pdf; only the stem is put in capitals."""
    stem = F.concat(*([yyyymm] if include_date else []), F.format_string("%04d", seq), F.lit("_"), division, F.lit("_"), safe_filename(company), *([suffix] if suffix is not None else []))
    return F.concat(F.upper(stem) if uppercase else stem, F.lit(".pdf"))


def parsed_stem(stem: Column) -> Column:
    """struct(yyyymm, seq, division, company), null if the stem is no finalized name."""
    parts = F.split(stem, "_")
    head = parts[0]
    company = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "_")
    dated, plain = head.rlike("^[0-9]{10,}$"), head.rlike("^[0-9]{4}$")
    yyyymm = F.when(dated, F.substring(head, 1, 6)).otherwise(F.lit(""))
    seq = F.when(dated, F.try_to_number(F.substring(head, 7, 12), F.lit("999999999999"))).otherwise(F.try_to_number(head, F.lit("9999")))
    return F.when((F.size(parts) >= 3) & (dated | plain), F.struct(yyyymm.alias("yyyymm"), seq.cast("int").alias("seq"), parts[1].alias("division"), company.alias("company")))


def is_final_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1).rlike(FINAL_NAME)


def path_parts(rel: Column) -> Column:
    """struct(division, company) of a path relative to the output root."""
    parts = F.split(rel, "/")
    n = F.size(parts)
    company = F.when(n >= 3, F.array_join(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), "/")).when(n == 2, parts[0]).otherwise(F.lit("All Documents"))
    return F.struct(F.when(n >= 2, parts[0]).otherwise(F.lit("")).alias("division"), company.alias("company"))


def leading_date(name: Column) -> Column:
    """The first eight digits of a name, or nothing."""
    return F.regexp_extract(name, "^[0-9]{8}", 0)


def version_parts(text: Column) -> Column:
    """Numbers of a version; arrays compare as versions do."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, "^[vV]", ""), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 if either side is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def auto_confirmed(qc_passed: Column, company_conf: Column, date: Column, date_conf: Column, as_of: Column, earliest_year: int = 1950, use_dates: bool = True, least: int = 90) -> Column:
    """Whether a document needs no review."""
    dated = date.isNotNull() & (date >= F.make_date(F.lit(earliest_year), F.lit(1), F.lit(1))) & (date <= as_of) & (date_conf >= least)
    passed = qc_passed & (company_conf >= least)
    return F.coalesce(passed & dated if use_dates else passed, F.lit(False))


def month_stamp(date: Column, iso: Column | None = None, as_of: Column | None = None) -> Column:
    """yyyyMM of a date, else of a text that starts like an ISO day, else of ``as_of``; null without any."""
    found = [F.date_format(date, "yyyyMM")]
    if iso is not None:
        parts = F.split(iso, "-")
        found.append(F.when(F.size(parts) >= 2, F.concat(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))))
    if as_of is not None:
        found.append(F.date_format(as_of, "yyyyMM"))
    return F.coalesce(*found)
