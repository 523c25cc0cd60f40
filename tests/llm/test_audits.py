"""SimHash components, the filter audit and the divergence audit against brute force, and on odd inputs."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import filter_audit, simhash_join, source_divergence

from .test_operators import LONG, WORD, empty, frame, odd


def slow_fingerprint(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, near=2):
    """Value -> least value reachable over links of at most ``near`` bits."""
    values, up = sorted(values), {}
    for v in values:
        up[v] = v

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    bits = np.array(values, dtype=np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= near):
            a, b = sorted((root(v), root(values[i + 1 + j])))
            up[b] = a
    return {v: root(v) for v in values}


def variants(rng, n, words):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(words)] = f"w{rng.randrange(500)}"
        yield " ".join(copy)


def test_simhash_components_match_brute_force(spark):
    rng = random.Random(4)
    texts = [t for n, words in ((60, 150), (60, 400), (20, 30)) for t in variants(rng, n, words)]
    texts += ["", None, " \n", "One", "one TWO", "One Two three", "É two three four", "x " * 200, *texts[:30]]
    docs = frame(spark, [(7 * i % 1009, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_join.simhash_components(docs).collect()}
    own = {7 * i % 1009: slow_fingerprint(t) for i, t in enumerate(texts)}
    of = components(set(own.values()))
    least = defaultdict(lambda: 1 << 60)
    for doc, fp in own.items():
        least[of[fp]] = min(least[of[fp]], doc)
    assert got == {doc: (f"{fp:016x}", least[of[fp]]) for doc, fp in own.items()}
    assert 2 < len(set(c for _, c in got.values())) < 0.9 * len(set(own.values()))


@pytest.mark.parametrize("parts", [3, 4, 7, 16])
def test_grids_lose_no_link_in_crowded_cells(spark, parts):
    """Balls of fingerprints around a few centres, some far larger than a cell may pair."""
    rng = random.Random(parts)
    found = {0, (1 << 64) - 1, 1, 1 << 63}
    for flips in (2, 5, 9):
        centre, at = rng.getrandbits(64), rng.sample(range(64), flips)
        found |= {centre ^ sum(1 << b for k, b in enumerate(at) if s >> k & 1) for s in range(2**flips)}
    centre = rng.getrandbits(64)
    found |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    points = spark.createDataFrame([(signed(x),) for x in found], "fp long")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash_join.near_links(points, parts).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    up = {v: v for v in found}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    assert {v: root(v) for v in found} == components(found)


def test_counts_bound_the_distance(spark):
    rng = random.Random(1)
    pairs = [(rng.getrandbits(64) - (1 << 63), rng.getrandbits(64) - (1 << 63)) for _ in range(50)]
    count = lambda x: [(x >> 2 * s & 3).bit_count() for s in range(32)]
    codes = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.bit_count(simhash_join.unary_counts(F.col("a")).bitwiseXOR(simhash_join.unary_counts(F.col("b")))).alias("far"))
    for a, b, far in codes.collect():
        assert far == sum(abs(x - y) for x, y in zip(count(a % (1 << 64)), count(b % (1 << 64)))) <= ((a ^ b) % (1 << 64)).bit_count()


def test_shingle_hash_is_the_one_of_expressions(spark):
    one = spark.sql("select xxhash64('a b c') as h").first().h
    assert simhash_join.fingerprint(b"A b\nc") == one


def test_stretches_change_no_fingerprint(monkeypatch):
    whole = [simhash_join.fingerprint(t.encode()) for t in (LONG, "a b", "a", "", " a  b c ")]
    monkeypatch.setattr(simhash_join, "word_lists", lambda d: (d[m.start() : m.end()].split() for m in re.finditer(rb"\S+\s*|\s+", d)))
    assert whole == [simhash_join.fingerprint(t.encode()) for t in (LONG, "a b", "a", "", " a  b c ")]


def test_simhash_of_odd_tables(spark):
    rows = simhash_join.simhash_components(odd(spark)).collect()
    assert len(rows) == odd(spark).count() and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert {r.component_id for r in rows if r.doc_id == 6} == {4}
    assert simhash_join.simhash_components(empty(spark)).collect() == []


def slow_audit(docs, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1 and d is not None} for k in (0, 1))
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    fails = []
    for d, text, source in docs:
        text = text or ""
        w = WORD.findall(text)
        f = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        f += "D" * bool(re.search("[#$%&*|]", text)) + "E" * (d is not None and d > least[text])
        fails.append((source or "", f, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {x[0] for x in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in fails if x[0] == part]
            gone = []
            for k, f in enumerate(order, 1):
                now = [x for x in left if f in x[1]]
                row = [len(left) - len(now), len(now), sum(f in x[1] for x in gone), sum(x[0] == part and x[1] == f for x in fails), sum(x[2] for x in now), sum(x[3] for x in now)]
                left, gone = [x for x in left if f not in x[1]], gone + now
                shapley[part, f] += len(now)
                out[part, order, k] = row
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def audited(spark, rows, labels):
    docs = frame(spark, [(d, t, "en", s) for d, t, s in rows])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit_filters(docs, marks).collect()}


def test_filter_audit_matches_brute_force(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(["alpha", "Beta", "GAMMA", "d#", "e"] + [f"w{i}" for i in range(rng.choice([2, 200]))]) for _ in range(rng.randrange(0, 120)))
    texts = [text() for _ in range(60)] + ["", None, "  ", LONG]
    rows = [(rng.randrange(150), rng.choice(texts), rng.choice(["a", "b", "", None])) for _ in range(200)]
    rows += [(None, texts[0], "a"), (None, texts[0], "a"), (3, texts[1], "b"), (3, texts[1], "b"), (3, texts[1], "a"), (3, texts[2], "a")] + [(9, texts[3], "c")] * 40
    labels = [(rng.choice([None, *range(150)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    assert audited(spark, rows, labels) == slow_audit(rows, labels)


def test_filter_audit_of_odd_tables(spark):
    rows = [(r.doc_id, r.text, r.source) for r in odd(spark).collect()]
    assert audited(spark, rows, [(4, 1, 1)]) == slow_audit(rows, [(4, 1, 1)])
    assert audited(spark, [], [(4, 1, 1)]) == {}
    assert audited(spark, rows, []) == slow_audit(rows, [])


def slow_divergence(docs):
    occur, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        occur[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = set()
    for (lang, source), own in occur.items():
        kept = [t for t, n in held[lang].items() if n >= 3]

        def prices(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p = prices(own)
        q = prices(sum((c for (x, _), c in occur.items() if x == lang), Counter()))
        found = {"term": [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if own[t] and p[t] > q[t]], "pair": []}
        for (x, other), counts in occur.items():
            if x == lang and other != source:
                r = prices(counts)
                found["pair"].append((sum((p[t] - r[t]) ** 2 // r[t] for t in kept), other))
        for part, values in found.items():
            ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))
            out |= {(lang, source, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= 200}
    return out


def diverged(spark, docs):
    return {tuple(r) for r in source_divergence.source_divergence(docs).collect()}


def test_divergence_matches_brute_force(spark):
    rng = random.Random(2)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1y", "naïve", "ß", "q"] + ["t" + chr(97 + i % 26) * (i // 26 + 1) for i in range(400)]
    rows = [(rng.choice(["en", "de"]), rng.choice(["a", "b", "c", "é", None]), " ".join(rng.choice(words) for _ in range(rng.randrange(80)))) for _ in range(150)]
    rows += [("en", "only here", ""), ("xx", "one", "rare words"), ("xx", "two", None), (None, None, "beta beta"), ("en", "a", "beta " * 5000)] + [("en", "hot", "beta Alpha")] * 60
    docs = frame(spark, [(i, t, lang, s) for i, (lang, s, t) in enumerate(rows)])
    assert diverged(spark, docs) == slow_divergence(rows)


def test_divergence_in_small_portions(spark, monkeypatch):
    rows = [("en", f"s{i % 3}", " ".join(f"{chr(97 + j)}{chr(97 + i % 7)}" for j in range(20))) for i in range(40)]
    docs = frame(spark, [(i, t, lang, s) for i, (lang, s, t) in enumerate(rows)])
    monkeypatch.setattr(source_divergence, "HELD", 5)
    assert diverged(spark, docs) == slow_divergence(rows)


def test_divergence_of_odd_tables(spark):
    rows = [(r.lang, r.source, r.text) for r in odd(spark).collect()]
    assert diverged(spark, odd(spark)) == slow_divergence(rows)
    assert diverged(spark, empty(spark)) == set()


def test_prices_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**15, 10**17, 10**6)], "n long, total long, v long").select(source_divergence.price("n", "total", "v").alias("p"))
    assert rows.first().p == 1 + 10**9 * (10**15 + 1) // (10**17 + 10**6)
