"""Operators reach every row: each test failed while a part of the input was left out."""

import random
import string

from pyspark.sql import functions as F

from paperloom.functions.fuzzy import token_set_ratio
from paperloom.functions.text import company_form
from paperloom.operators import similarity
from paperloom.plans import more_queries, registry, relational_queries  # noqa: F401
from paperloom.sources import tables

FOLDER = "/root/testdata/sf0.001"


def test_roster_queries_take_all_parts(spark):
    parts = {r.p_partkey for r in tables.table(spark, FOLDER, "part").collect()}
    for name in ("j_fuzzy_best", "j_roster_snap", "c_tier_match"):
        assert {r.p_partkey for r in registry.QUERIES[name](spark, FOLDER).collect()} == parts
    entries = [r.entry for r in tables.roster(spark, FOLDER).orderBy("ord").collect()]
    forms = {r.p_partkey: r.form for r in relational_queries._misspelt(spark, FOLDER).select("p_partkey", company_form(F.col("name")).alias("form")).collect()}
    for r in registry.QUERIES["j_fuzzy_best"](spark, FOLDER).collect():
        scores = [int(token_set_ratio(forms[r.p_partkey], e)) for e in entries]
        assert (r.score, r.entry) == (max(scores), entries[scores.index(max(scores))])


def test_margin_query_finds_all_names_that_stand_out(spark):
    """Brute force: the best score over all names, and the best among the others."""
    parts = {r.p_partkey: r.p_name.upper() for r in tables.table(spark, FOLDER, "part").collect()}
    entries = sorted(set(parts.values()))
    want = {}
    for key, own in parts.items():
        name = " ".join(reversed(own.split(" "))) if key % 2 == 0 else own[1:]
        scores = [int(token_set_ratio(name, e)) for e in entries]
        best = max(scores)
        at = scores.index(best)
        if best >= 90 and best - max(scores[:at] + scores[at + 1 :]) >= 10:
            want[key] = (entries[at], best)
    found = registry.QUERIES["j_fuzzy_margin"](spark, FOLDER).collect()
    assert len(found) == len(want) > 100
    assert {r.p_partkey: (r.entry, r.score) for r in found} == want


def brute_matches(inputs, outputs):
    found = {}
    for i, a in inputs.items():
        for o, b in outputs.items():
            best = [max((len(p & q) / len(p | q), -k) for k, q in enumerate(b)) for p in a]
            if max(s for s, _ in best) > 0:
                top = sorted((s for s, _ in best), reverse=True)[: -(-len(best) * 9 // 10)]
                found[i, o] = (round(sum(s >= 0.75 for s, _ in best) / len(best), 9), round(sum(top) / len(top), 9), sorted({-k for s, k in best if s >= 0.75}))
    return found


def matched(spark, inputs, outputs):
    mk = lambda docs: spark.createDataFrame([(i, k, sorted(p)) for i, d in docs.items() for k, p in enumerate(d)], "doc_id long, page_idx int, tokens array<string>")
    rows = similarity.text_matches(mk(inputs), mk(outputs)).collect()
    assert len(rows) == len({(r.doc_id, r.out_id) for r in rows})
    return {(r.doc_id, r.out_id): (round(r.coverage, 9), round(r.score, 9), list(r.pages)) for r in rows}


def test_copies_of_frequent_tokens_match(spark):
    """A third of the outputs are copies of one text: all its tokens are too frequent to follow."""
    copy = [{"form", "letter", "dear", "customer"}, {"yours", "truly", "office"}]
    outputs = {1000 + i: copy if i % 3 == 0 else [{f"word{i}", f"other{i}", "dear"}] for i in range(90)}
    inputs = {1: copy, 2: [{"form", "letter", "dear", "nothing"}], 3: [{"word1", "other1", "dear"}], 4: [{"foreign", "tongue", "only"}], 5: copy}
    want = {k: v for k, v in brute_matches(inputs, outputs).items() if k[0] != 3 or k[1] == 1001}
    assert matched(spark, inputs, outputs) == want and want[1, 1000] == (1.0, 1.0, [0, 1])


def test_few_outputs_are_all_compared(spark):
    outputs = {1000 + i: [{"dear", "sirs", f"word{i % 30}", f"x{i}"}] for i in range(40)}
    inputs = {1: [{"dear", "sirs", "word3"}], 2: [{"dear", "sirs", "absent"}]}
    assert matched(spark, inputs, outputs) == brute_matches(inputs, outputs)


def test_image_pages_hold_whole_texts(spark, tmp_path):
    """The texts of 2 and 3 begin alike and go on differently; those of 2 and 5 are the same."""
    rng = random.Random(7)
    words = lambda n: " ".join(f"{rng.choice(string.ascii_letters) * rng.randrange(1, 9)}{rng.randrange(999)}" for _ in range(n))
    start = words(200)
    one, two = f"{start} {words(400)}", f"{start} {words(400)}"
    spark.createDataFrame([(2, one), (3, two), (5, one)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [(r.doc_id, r.out_id, r.ambiguous) for r in registry.QUERIES["j_image_match"](spark, str(tmp_path)).collect()]
    assert found == [(2, 5, False)]
