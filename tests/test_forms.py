"""Documents that differ only in digits are searched once, and get what a search of each gives."""

from random import Random

from paperloom.operators import resolve
from paperloom.plans import composite_queries

LETTER = """{co}
{street} Main Street
Dear Sirs:
Customer {a}, Complainant, versus {b} {co}, Respondent.
Subject: claim vs. {co} {c}.
Date Requested {d}/{e}/{f}
Very truly yours,
{co} {g}
"""
NAMES = ("ALPHA LIFE INSURANCE CORPORATION", "BETA MUTUAL INC", "3M LIFE INSURANCE CORPORATION", "BLOCK 7 GROUP")
ROSTERS = (["ALPHA LIFE INSURANCE CORPORATION", "BETA MUTUAL INC", "X A CO"], ["ALPHA LIFE INSURANCE CORPORATION", "3M LIFE INSURANCE CORPORATION", "BETA 35 MUTUAL INC", "CLAIM 3 X INC"])


def _pages():
    """Few letters in many numbers: in captions and signatures or not, equal or not, in any order, some touching letters."""
    dice, out = Random(7), []
    for i in range(160):
        pick = lambda *c: dice.choice(c)
        many = {"co": pick(*NAMES), "a": pick("12", "35", "07", "990"), "d": pick("01", "12"), "e": pick("01", "12", "35"), "f": pick("1996", "2035"), "street": pick("7", "9", "35")}
        some = {"b": pick("", "", "12", "35", "x9 A"), "c": pick("", "", "24", "35 3"), "g": pick("", "", "5", "35", "1A")} if i % 2 else {"b": "", "c": "", "g": ""}
        out.append((i, 0, LETTER.format(**many, **some)))
    out += [(i, 1, pick("BLOCK 7", "BLOCK 9", "BLOCK 7\n35 1A X CO", "BLOCK 7\n22 1A X CO", "1 35 X CLAIM CO", "9 35 X CLAIM CO", "12 12 CLAIM X INC", "12 21 CLAIM X INC")) for i in range(40, 160)]
    out += [(7, 0, "Dated 12\nBETA MUTUAL INC"), (8, 0, "Dated 21\nBETA MUTUAL INC"), (170, 0, None), (171, 0, " "), (None, 0, LETTER.format(co=NAMES[0], a=1, b="", c="", d=1, e=2, f=3, g="", street=4))]
    return out


def test_forms_change_no_result(spark):
    pages = spark.createDataFrame(_pages(), "doc_id long, page_idx int, page_text string").repartition(3)
    docs = spark.createDataFrame([(i,) for i in (*range(180), 5, None)], "doc_id long")
    folders = spark.createDataFrame([(i, 0, ("alpha life insurance corporation", "scans 7", None, "Beta 35 Mutual Inc")[i % 4]) for i in range(0, 176, 3)], "doc_id long, ord int, name string")
    hints = spark.createDataFrame([("letterheads", "BLOCK 7", "OMEGA 1"), ("letterheads", "BLOCK_9", "PSI"), ("folders", "scans 7", "SIGMA 2")], "kind string, key string, company string")
    for names, h in ((ROSTERS[0], None), (ROSTERS[0], hints), (ROSTERS[1], hints)):
        roster = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "entry string, ord int")
        found = resolve.all_candidates(pages, roster, folders, h)
        each = resolve.combined(docs, found, resolve.roster_matches(found, roster))
        once = resolve.resolved(docs, pages, roster, folders, h)
        assert once.columns == each.columns
        assert sorted(map(str, once.collect())) == sorted(map(str, each.collect()))


def test_free_digits(spark):
    roster = spark.createDataFrame([("3M CO", 0), ("ALPHA 24", 1)], "entry string, ord int")
    hints = spark.createDataFrame([("letterheads", "BLOCK 7", "A"), ("letterheads", "NATION_8", "B"), ("folders", "9", "C")], "kind string, key string, company string")
    assert resolve.free_digits(roster) == "0156789" and resolve.free_digits(roster, hints) == "015689" and resolve.free_digits(roster.limit(0)) == resolve.DIGITS


def test_letters_are_searched_once_for_each_form(spark, monkeypatch):
    searched = []
    search = resolve.all_candidates
    monkeypatch.setattr(resolve, "all_candidates", lambda pages, *rest: searched.append(pages.count()) or search(pages, *rest))
    found = composite_queries.c_resolve(spark, "/root/testdata/sf0.001").collect()
    assert sum(searched) < len(found) / 2 and len({r.doc_id for r in found}) == len(found)
