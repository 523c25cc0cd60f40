"""The training-data operators on inputs of which a part was left out."""

import random
import string

import numpy as np

from paperloom.llm import byte_cnn, ngram_join, pii, quality_rules, secret_scan

KEY = "a key for tests"


def test_secrets_of_several_parts():
    rng = random.Random(8)
    key = lambda n, of=string.ascii_letters + string.digits: "".join(rng.choice(of) for _ in range(n - 2)) + "a7"
    lines = [*(key(64) for _ in range(5)), "Qz7x8w=="]
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(lines) + "\n-----END RSA PRIVATE KEY-----\n"
    found = lambda t: [t[a:b] for _, a, b in secret_scan.all_spans(t)]
    assert found(pem) == lines and found(pem.replace("\n", "\r\n")) == lines
    parts = [key(36), key(60), key(43)]
    assert found("Bearer " + ".".join(parts)) == parts
    for between in (", ", '", "', "\n", "; "):
        assert found("our keys " + between.join(parts)) == parts
    assert found("our key " + parts[0] + " and then " + parts[1]) == parts[:1]


def test_identifiers_of_the_corpus_prime_the_measure(spark):
    rng = random.Random(3)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(30)) + "a7"
    docs = [f"the field zq_wrapped_fluxome{i % 3} and qvKonduitMapper{i % 2} in use, also {key}" for i in range(40)]
    docs += ["only here_once and plain words"]
    known = secret_scan.identifiers(texts(spark, docs))
    assert "qvKonduitMapper1" not in known and "zq_wrapped_fluxome" not in known  # long ones with digits might be keys
    names = secret_scan.identifiers(texts(spark, ["see zq_wrapped_fluxome, qvKonduit7 and qvKonduit7x"] * 3 + ["here_once", "qvKonduit7"]))
    assert names.split()[-1] == "qvKonduit7" and set(names.split()) == {"zq_wrapped_fluxome", "qvKonduit7", "qvKonduit7x"}
    candidate = "zqWrappedFluxome7qvKonduit7x"
    assert secret_scan.novelty(candidate, "", "zqWrappedFluxome7 qvKonduit7x ") < 0.6 < secret_scan.novelty(candidate, "")
    assert key not in known and secret_scan.identifiers(texts(spark, ["x", None])) == ""


def test_what_base_spans_leave_is_measured():
    whole = "Zx81kQp0aLmW92vT" + "0123456789abcdef01234567" + "QpLmZ7"
    text = f"the bearer {whole} is set"
    assert secret_scan.redact(text, secret_scan.all_spans(text), "") == "the bearer  is set"


def test_long_candidates_are_measured_to_their_end():
    rng = random.Random(9)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    for run in ("xy1" * 2000 + key, "xy1" * 100 + key + "xy1" * 2000, "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(6000))):
        assert secret_scan.all_spans(f"the bearer {run} is") == [("novel", 11, 11 + len(run))]
    assert secret_scan.all_spans("the bearer " + "xy1" * 2000 + " is") == []


def texts(spark, found):
    return spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")


def test_surrogates_stay_distinct_where_their_shape_is_used_up(spark):
    """26 surnames of one letter; none of their 13 surrogates of one letter is free."""
    docs = texts(spark, [f"Mr {c} came" for c in string.ascii_uppercase] + [f"Mrs B{c} Stone came" for c in "aeiou"])
    rows = pii.surrogate_pii(docs, KEY, rounds=3).collect()
    names = [r.text.split()[1] for r in rows if r.doc_id < 26]
    assert len(set(names)) == 26 and not {n.lower() for n in names} & set(string.ascii_lowercase)
    assert all(n[0].isupper() for n in names)


def test_longer_surrogates_are_rendered():
    key = b"k" * 32
    for kind, mention, entity in (("surname", "X", "x"), ("email", "a.b@c.de", "a.b@c.de"), ("ip", "1.2.3.4", "1.2.3.4"), ("phone", "+1 (017) 555-7713", "10175557713")):
        new = pii.surrogate(kind, entity, 3, key, 2)
        out = pii.rendered(mention, new)
        assert out.lower() == new if kind in ("surname", "email", "ip") else pii.canonical(out) == new
        assert kind == "ip" or len(new) == len(entity) + 2


def test_all_mentions_of_a_name_are_found():
    found = lambda t: [(m.kind, t[m.start : m.end]) for m in pii.mentions(t)]
    assert found("Mr Alan Turing spoke. Turing said, as Alan's friends and TURING's did, turing") == [
        ("name_m", "Alan"), ("surname", "Turing"), ("surname", "Turing"), ("name_m", "Alan"), ("surname", "TURING"),
    ]
    assert found("Mr John Paul George Smith left") == [("name_m", "John"), ("name_m", "Paul"), ("name_m", "George"), ("surname", "Smith")]
    assert found("Mr. J. Smith and I. J. wrote") == [("name_m", "J"), ("surname", "Smith"), ("name_m", "J")]
    assert found("Mr. J.R. Smith") == [("name_m", "J"), ("name_m", "R"), ("surname", "Smith")]
    assert found("Mr John Smith met Mr John") == [("name_m", "John"), ("surname", "Smith"), ("name_m", "John")]
    assert found("Mr Jones and Turing") == [("surname", "Jones")]
    out, counts = pii.replaced("Mr Alan Turing spoke. Turing said so to Smith-Turing", {}, b"k" * 32)
    assert "Turing" not in out and counts["surname"] == 3 and out.split()[2] == out.split()[4]


def test_small_groups_are_judged(spark):
    """A small source beside a large one of its language, and a rare language."""
    rng = random.Random(5)
    clean = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(400)) for _ in range(rng.randrange(12, 200)))
    bad = lambda: " ".join(f"{w}$$$###" for w in clean().split())
    rows = [(i, clean(), "en", "a") for i in range(300)] + [(300 + i, clean(), "en", "b") for i in range(20)] + [(320 + i, clean(), "xx", "c") for i in range(20)]
    rows += [(1000, bad(), "en", "b"), (1001, bad(), "xx", "c"), (1002, bad(), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    assert not kept & {1000, 1001, 1002} and len(kept) >= 335


def test_colliding_tokens_are_counted_one_by_one():
    """Sets of 300,000 tokens, of which some agree in the 32 bits that cells keep."""
    rng = np.random.default_rng(5)
    common, own = rng.integers(0, 1 << 63, 300_000).astype(np.uint64), rng.integers(0, 1 << 63, 300_000).astype(np.uint64)
    kept = lambda t: ngram_join._dealt(t, 1)[1]
    assert len(np.unique(kept(common))) < len(common)
    cells = np.empty(900_000, ngram_join._CELL)
    cells["token"] = np.concatenate((kept(common), kept(own), kept(common)))
    cells["id"] = np.repeat(np.array([3, 3, 5], np.uint64), 300_000)
    reported = np.bincount(ngram_join.shared_ids(cells), minlength=3)
    assert reported[2] == 300_000 and 300_000 <= reported[1] < 300_200
    heads = np.array([(1, 11, 0, 1), (2, 12, 1, 1)], ngram_join._HEAD)
    token, at = np.concatenate((kept(common), kept(common))), np.repeat(np.array([0, 1]), 300_000)
    found = ngram_join.matrix_counts(heads, token, at, 12)
    assert found["cells"].sum() == 300_000 and found["wide"].sum() == 0
    assert ngram_join.matrix_counts(heads, token, at, 1)["wide"].tolist() == [300_000, 300_000]


def test_very_long_texts_at_the_limit(spark):
    """Texts of 120,000 words: two share just three quarters of their shingles, two others just less."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**9)}" for _ in range(360_000)]
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    # n shared shingles in front, and the same number of own ones behind: n / (n + 2 * own).
    a, b = words[:120_000], words[:102_858] + words[120_000:137_140]
    c, d = words[140_000:260_000], words[140_000:242_840] + words[260_000:277_160]
    for one, two, links in ((a, b, True), (c, d, False)):
        x, y = shingles(one), shingles(two)
        both = len(x & y)
        assert (100 * both >= 75 * (len(x) + len(y) - both)) is links and abs(both / (len(x) + len(y) - both) - 0.75) < 1e-3
    docs = texts(spark, [" ".join(t) for t in (a, b, c, d)])
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_training_texts_are_whole_and_rows_do_not_depend_on_order(spark):
    """What tells the classes apart stands at the end of long texts; labels and rows repeat."""
    rng = random.Random(3)
    fill = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    rows = [(i, fill(900) + (" zzqxj" if i % 2 else " plain") * 150) for i in range(300)]
    labels = [(i, i % 2) for i in range(300)]
    p = byte_cnn.CnnParams(sample=60, epochs=25, filters=8)
    make = lambda r, y: byte_cnn.fit(spark.createDataFrame(r, "doc_id long, text string"), spark.createDataFrame(y, "doc_id long, quality int"), p)
    one = make(rows, labels)
    two = make(rows[::-1] + rows[:50] + [(None, "zzqxj"), (7, None)], labels[::-1])
    again = make(rows, labels + labels)
    for k, v in one.parts.items():
        assert np.array_equal(v, two.parts[k]) and np.allclose(v, again.parts[k])
    scores = one.score([t.encode() for _, t in rows])
    assert np.mean((scores >= 0.5) == np.array([i % 2 for i in range(300)])) > 0.95
