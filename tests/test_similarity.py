"""Prefix-filtered matches against brute force, and on odd inputs."""

import random

import pytest

from paperloom.operators import similarity

from .test_whole import brute_matches

PAGES = "doc_id long, page_idx int, tokens array<string>, sig string, pages string, first int, n int, b int"


def pages_of(spark, docs):
    """Pages with further columns whose names the operators use."""
    return spark.createDataFrame([(i, k, sorted(p), "x", "y", 1, 2, 3) for i, d in docs.items() for k, p in enumerate(d)], PAGES)


def corpus(rng, n, first):
    """A third are copies of one document, others are near copies of a few, the rest share frequent words only."""
    common = [f"common{i}" for i in range(12)]
    copied = [{"form", "letter", "dear", "customer"}, set(common[:9])]
    bases = [[{f"b{k}p{p}w{i}" for i in range(20)} | set(common[:3]) for p in range(3)] for k in range(6)]
    docs = {}
    for i in range(n):
        kind = i % 6
        if kind < 2:
            docs[first + i] = copied
        elif kind < 4:
            base = rng.choice(bases)[: rng.randrange(1, 4)]
            docs[first + i] = [(p - set(rng.sample(sorted(p), rng.randrange(8)))) | {f"own{rng.randrange(500)}" for _ in range(rng.randrange(5))} for p in base]
        else:
            docs[first + i] = [set(rng.sample(common, 5)) | {f"own{rng.randrange(500)}" for _ in range(rng.randrange(4))} for _ in range(rng.randrange(1, 3))]
    return docs


def candidates(inputs, outputs):
    """Which outputs an input meets: those with one of its followed tokens, or all without any."""
    df = {}
    for d in outputs.values():
        for t in set().union(*d):
            df[t] = df.get(t, 0) + 1
    most = max(20, len(outputs) // 5) if len(outputs) > 40 else 0
    for i, d in inputs.items():
        rare = {t for p in d for t in sorted((t for t in p if t in df), key=lambda t: (df[t], t))[:8]}
        followed = {t for t in rare if df[t] <= most}
        for o, e in outputs.items():
            if not followed or followed & set().union(*e):
                yield i, o


@pytest.mark.parametrize("n", [30, 150])
def test_prefixes_find_what_brute_force_finds(spark, n):
    rng = random.Random(n)
    inputs, outputs = corpus(rng, 60, 0), corpus(rng, n, 1000)
    allowed = set(candidates(inputs, outputs))
    want = {k: v for k, v in brute_matches(inputs, outputs).items() if k in allowed}
    a, b = pages_of(spark, inputs), pages_of(spark, outputs)
    for least in (0.5, 0.85):
        got = {(r.doc_id, r.out_id): (r.coverage, r.score, r.pages) for r in similarity.text_matches(a, b, least=least).collect()}
        assert got == {k: v for k, v in want.items() if v[1] >= least}
    best = {}
    for (i, o), v in want.items():
        if i not in best or (v[:2], -o) > (best[i][1][:2], -best[i][0]):
            best[i] = (o, v)
    got = {r.doc_id: (r.out_id, (r.coverage, r.score, r.pages)) for r in similarity.best_text_matches(a, b).collect()}
    assert got == {i: x for i, x in best.items() if x[1][0] > 0 or x[1][1] >= 0.6} and 20 < len(got) < 60


def test_sets_of_all_sizes(spark):
    """Sets of one to forty tokens against all subsets cut at either end, at limits that fall on whole tokens."""
    rng = random.Random(3)
    left = {i: [set(f"t{k}" for k in rng.sample(range(60), rng.randrange(1, 41)))] for i in range(60)}
    right = {1000 + i: [set(sorted(d[0])[: rng.randrange(1, len(d[0]) + 1)])] for i, d in left.items()}
    sets = lambda docs, key: pages_of(spark, docs).selectExpr(f"doc_id as {key}", "page_idx", "transform(tokens, t -> xxhash64(t)) as hashes")
    df = similarity.document_frequency(sets(right, "doc_id").withColumnRenamed("hashes", "tokens"))
    for least in (0.25, 0.5, 0.8, 1.0):
        got = {tuple(r) for r in similarity.similar_sets(sets(left, "id"), sets(right, "other_id"), least, df).collect()}
        want = {(i, o) for i, (a,) in left.items() for o, (b,) in right.items() if len(a & b) >= least * len(a | b) - 1e-12}
        assert want <= got and len(got) < 3600


@pytest.mark.parametrize("part", [6_000_000, 40])
def test_only_similar_sets_leave_their_parts(spark, monkeypatch, part):
    """Sets that share rare tokens but too few, in one part and in many: no row is made for those."""
    monkeypatch.setattr(similarity, "PART_TOKENS", part, raising=False)
    rng = random.Random(5)
    docs = lambda first: {first + i: [{f"t{k}" for k in rng.sample(range(40), rng.randrange(1, 12))} for _ in range(rng.randrange(1, 3))] for i in range(50)}
    left, right = docs(0), docs(1000)
    sets = lambda docs, key: pages_of(spark, docs).selectExpr(f"doc_id as {key}", "page_idx", "transform(tokens, t -> xxhash64(t)) as hashes")
    df = similarity.document_frequency(sets(right, "doc_id").withColumnRenamed("hashes", "tokens"))
    got = [tuple(r) for r in similarity.similar_sets(sets(left, "id"), sets(right, "other_id"), 0.4, df).collect()]
    want = {(i, o) for i, d in left.items() for o, e in right.items() if any(len(a & b) >= 0.4 * len(a | b) - 1e-12 for a in d for b in e)}
    assert sorted(got) == sorted(want) and 20 < len(want) < 1000


def test_empty_sides_match_nothing(spark):
    some, none = pages_of(spark, {1: [{"abcd", "efgh", "ijkl"}]}), pages_of(spark, {1: [{"x"}]}).limit(0)
    for a, b in ((some, none), (none, some), (none, none)):
        assert similarity.best_text_matches(a, b).collect() == similarity.text_matches(a, b).collect() == similarity.text_matches(a, b, least=0.5).collect() == []
    far = pages_of(spark, {5: [{"mnop", "qrst"}], 6: [set()]})
    assert similarity.best_text_matches(some, far).collect() == similarity.text_matches(some, far).collect() == []


def brute_best(inputs, outputs):
    allowed, best = set(candidates(inputs, outputs)), {}
    for (i, o), v in brute_matches(inputs, outputs).items():
        if (i, o) in allowed and (i not in best or (v[:2], -o) > (best[i][1][:2], -best[i][0])):
            best[i] = (o, v)
    return best


@pytest.mark.parametrize("n, part", [(30, 6_000_000), (150, 6_000_000), (150, 400)])
def test_best_of_all_pairs_however_low(spark, monkeypatch, n, part):
    """The best output of every input, in one part and in many, where most share a few tokens only; no pair is returned for it."""
    monkeypatch.setattr(similarity, "PART_TOKENS", part)
    rng = random.Random(n)
    inputs, outputs = corpus(rng, 60, 0), corpus(rng, n, 1000)
    found = similarity.best_text_matches(pages_of(spark, inputs), pages_of(spark, outputs), least=0.0).collect()
    assert {r.doc_id: (r.out_id, (r.coverage, r.score, r.pages)) for r in found} == brute_best(inputs, outputs)
    assert len(found) == len({r.doc_id for r in found}) and any(0 < r.score < 0.6 for r in found)


def test_parts_are_read_and_not_shuffled(spark, monkeypatch):
    """A part of one side meets all parts of the other where they are written: nothing is sent once for each of these."""
    monkeypatch.setattr(similarity, "PART_TOKENS", 40)
    rng = random.Random(2)
    sets = lambda first, key: pages_of(spark, {first + i: [{f"t{k}" for k in rng.sample(range(90), 9)}] for i in range(40)}).selectExpr(f"doc_id as {key}", "page_idx", "transform(tokens, t -> xxhash64(t)) as hashes")
    plan = similarity.similar_sets(sets(0, "id"), sets(1000, "other_id"), 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan


def test_best_images_against_brute_force(spark):
    """Pages with the same empty foot, in copies and near copies: best match and doubt as over all pairs, and few hashes that meet."""
    rng = random.Random(11)
    flipped = lambda h, n: [w ^ sum(1 << (b % 63) for b in at if b // 63 == i) for i, w in enumerate(h) for at in [bits]] if (bits := set(rng.sample(range(126), n))) is not None else h
    bases = [[rng.randrange(2**62), rng.randrange(2**62), 0, 0] for _ in range(40)]
    docs = {}
    for i in range(160):
        docs[i] = [rng.choice(bases) if i % 3 else flipped(rng.choice(bases), rng.randrange(14)) for _ in range(rng.randrange(1, 4))]
    far = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    want = {}
    for i, d in docs.items():
        found = []
        for o, e in docs.items() if i % 2 == 0 else ():
            near = [min(far(p, q) for q in e) for p in d]
            if o % 2 and (coverage := sum(n <= 10 for n in near) / len(near)) >= 0.5:
                found.append((coverage, sum(1 - n / 256 for n in near) / len(near), o))
        found.sort(reverse=True)
        if found:
            want[i] = (found[0][2], len(found) > 1 and found[0][0] == found[1][0] and found[0][1] - found[1][1] <= 0.01)
    pages = spark.createDataFrame([(i, k, h, 0.1) for i, d in docs.items() for k, h in enumerate(d)], "doc_id long, page_idx int, hash array<long>, ink double")
    a, b = pages.filter("doc_id % 2 = 0"), pages.filter("doc_id % 2 = 1")
    assert {r.doc_id: (r.out_id, r.ambiguous) for r in similarity.best_image_matches(a, b).collect()} == want and len(want) > 40
    whole = {(r.doc_id, r.out_id) for r in similarity.image_matches(a, b).collect()}
    assert whole == {(i, o) for i in docs for o in docs if i % 2 == 0 and o % 2 and any(far(p, q) <= 10 for p in docs[i] for q in docs[o])}
