"""The training-data operators against brute force, round trips and held-out accuracy, and on odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import byte_cnn, chat_rotation, mixing, ngram_join, packing, pii, quality_rules, secret_scan, sharding, topk_nra
from paperloom.llm.components import connected_components
from paperloom.llm.queries import op10_secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, size long, sig binary, kept boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))

KEY = "a key for tests"


def frame(spark, rows):
    """documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, 8, 9, b"x", True) for r in rows], SCHEMA)


def odd(spark):
    return frame(
        spark,
        [
            (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, "one two three", "en", None), (4, "one two three", "en", None), (4, "other words under the same id", "en", "a"),
            (None, "a text with a null id and a few more words to see", "en", "a"), (5, LONG, "de", "b"), (6, "ONE two THREE", "en", "b"), (7, "é" * 5000, "fr", "b"), (2**62, "x" * 100_000, "fr", "é"),
        ],
    )


def empty(spark):
    return odd(spark).filter("doc_id = -1")


# ---- mixing ------------------------------------------------------------------------------------


def test_targets_fill_and_share(spark):
    sizes = {"a": 100, "b": 10, "c": 400, None: 50, "d": 0}
    totals = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(totals).collect()}
    names, w = ["a", "b", "c", "d", None], {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}
    want, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        unit = left / sum(w[n] for n in open_)
        room = {n: min(unit * w[n], 2 * sizes[n] - want[n]) for n in open_}
        for n in room:
            want[n] += room[n]
        left -= sum(room.values())
        open_ = {n for n in open_ if want[n] < 2 * sizes[n] - 1e-9}
    assert all(math.isclose(got[n], want[n], abs_tol=1e-6) for n in names)


def test_mix_comes_near_targets(spark):
    rng = random.Random(2)
    docs = frame(spark, [(i, "w " * rng.randrange(1, 40), "en", rng.choice("aaab") if i % 9 else None) for i in range(3000)])
    rows = mixing.mix_to_weights(docs).collect()
    assert len(rows) == 3000 and all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in rows:
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(t - target) <= 20 for t, target in by.values())
    assert sorted(rows) == sorted(mixing.mix_to_weights(docs.repartition(7)).collect())


def test_mix_tells_repeated_rows_apart(spark):
    rows = [(None, "w " * 3, "en", "a")] * 300 + [(None, f"n{i} w", "en", "a") for i in range(300)] + [(7, "x y", "en", "b")] * 200
    for docs in (frame(spark, rows), frame(spark, rows).repartition(5)):
        by = collections.defaultdict(lambda: [0, 0.0])
        for r in mixing.mix_to_weights(docs).collect():
            assert r.taken in (0, r.size, 2 * r.size)
            by[r.source][0] += r.taken
            by[r.source][1] = r.target
        assert all(abs(t - target) <= 4 for t, target in by.values())
        assert mixing.mixed_rows(docs).count() == sum(r.copies for r in mixing.mix_to_weights(docs).collect())
        assert mixing.mixed_rows(docs).columns == docs.columns


def test_mix_odd(spark):
    rows = mixing.mix_to_weights(odd(spark)).collect()
    assert len(rows) == 11 and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix_to_weights(empty(spark)).count() == 0


# ---- sharding ----------------------------------------------------------------------------------


def plain_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if b >= s]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - s)
        else:
            bins.append(capacity - s)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(20))
def test_runs_pack_as_single_items_do(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 5, 8, rng.randrange(1, 60)]) for _ in range(rng.randrange(1, 120))]
    runs = sorted(collections.Counter(sizes).items(), reverse=True)
    placed = sharding.best_fit_decreasing(runs, 60)
    left = collections.Counter()
    for (s, n), pieces in zip(runs, placed, strict=True):
        assert sum(k for _, k in pieces) == n
        for b, k in pieces:
            left[b] += s * k
    assert sorted(60 - x for x in left.values()) == plain_best_fit(sizes, 60)


def test_shards(spark):
    rng = random.Random(3)
    texts = ["t" * rng.randrange(1, 400) + str(i) for i in range(2000)] + ["copy " * 30] * 700
    rows = sharding.shard_documents(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), 24).collect()
    loads, slots, homes = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes"
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[texts[r.doc_id]].add(r.shard)
    assert set(loads) == set(range(24)) and all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    alone = 700 * 158
    rest = sorted(loads.values())[:-1]
    assert max(loads.values()) == alone and rest[-1] - rest[0] <= 420


def test_shards_odd(spark):
    rows = sharding.shard_documents(odd(spark)).collect()
    assert len(rows) == 11 and sharding.shard_documents(empty(spark)).count() == 0
    assert len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1


# ---- packing -----------------------------------------------------------------------------------


def test_pieces():
    for total in (1, 2, 3, 2047, 2048, 2049, 5000):
        cuts = packing.binary_pieces(total, 2048)
        assert sum(n for _, n in cuts) == total and all(n & (n - 1) == 0 and n <= 2048 for _, n in cuts)
        assert [s for s, _ in cuts] == [sum(n for _, n in cuts[:i]) for i in range(len(cuts))]


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = odd(spark).unionByName(frame(spark, [(90, "a <|endoftext|> b", "en", "a"), (91, "Ünïcode 1234 'll  \n\n x", "en", "a")]))
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = packing.pack_power_of_two(docs).collect()
    of = collections.defaultdict(list)
    for r in rows:
        of[r.batch].append(r)
    assert all(len({r.length for r in b}) == 1 and max(r.sequence_id for r in b) - min(r.sequence_id for r in b) == len(b) - 1 for b in of.values())
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.bucket == math.log2(r.length) for r in rows)
    want = collections.Counter()
    for i, text in texts:
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        for s, n in packing.binary_pieces(len(ids), 2048):
            want[i, s, n, len(ids), np.array(ids[s : s + n], "<u4").tobytes()] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.doc_tokens, bytes(r.ids)) for r in rows) == want
    assert packing.pack_power_of_two(empty(spark)).count() == 0


# ---- top-k -------------------------------------------------------------------------------------


def brute_top_k(vectors, k):
    ok = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = collections.Counter()
    for n, (i, q) in enumerate(ok):
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(ok) if m != n)
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k]))
    return out


def test_top_k(spark):
    rng = np.random.default_rng(0)
    vectors = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8).astype(np.float32)]) for i in range(400)]
    vectors += [(i, [0.25] * 8) for i in range(400, 460)] + [(50, vectors[50][1])]
    vectors += [(900, None), (950, [None] * 8), (1000, [float("nan")] * 8), (None, [0.1] * 8)]
    vectors += [vectors[100]] * 3 + [vectors[7]] * 9
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    for df in (table, table.withColumns({c: F.lit(3) for c in ("vec", "block", "part", "copies", "copy", "score", "rank", "query")})):
        got = topk_nra.top_k(df, F.col("vec_id") % 50 == 0)
        assert collections.Counter(tuple(r) for r in got.collect()) == brute_top_k(vectors, 5)


def test_top_k_few_and_empty(spark):
    mk = lambda v: spark.createDataFrame(v, "vec_id long, embedding array<float>")
    few = [(0, [1.0, 2.0]), (1, [3.0]), (50, [-1.0, 0.5, 2.0])]
    rows = topk_nra.top_k(mk(few), F.col("vec_id") % 50 == 0).collect()
    assert {(r.query_id, r.vec_id) for r in rows} == {(0, 1), (0, 50), (50, 0), (50, 1)}
    assert topk_nra.top_k(mk(few[:0]), F.col("vec_id") % 50 == 0).count() == 0
    names = ("rank", "score", "query_id", "vec", "copies", "block")
    clash = topk_nra.top_k(mk(few).select("vec_id", "embedding", *(F.lit(9).alias(c) for c in names)), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in clash) == sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows)
    huge = [(0, [3e38, 3e38]), (1, [3e38, -1.0])]
    assert topk_nra.top_k(mk(huge), F.col("vec_id") % 50 == 0).count() == 1


def test_bounds_stop_early_and_stay_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (500, 3))
    q = rng.integers(-50, 50, (20, 3))
    for i, (rows, scores) in enumerate(topk_nra.block_top_k(x, np.arange(500), q, [np.array([], int)] * 20, 5)):
        want = sorted(range(500), key=lambda j: (-int(x[j] @ q[i]), j))[:5]
        assert rows.tolist() == want and scores.tolist() == [int(x[j] @ q[i]) for j in want]


def test_ids_are_those_of_the_tokenizer(spark):
    """Every id of a whole table, and of texts of mixed scripts, against the library itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text]
    rng = random.Random(4)
    alphabet = "aZ9 \n\t'é漢字ßЖ🙂\u200d\u0301_-.,<|>" + "".join(map(chr, range(0x20, 0x500, 7)))
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    encode = packing.encoder("byte_bpe_50k.json")
    assert all(encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids for t in texts)


# ---- n-gram join -------------------------------------------------------------------------------


def brute_components(docs):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(low))
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= 75 * len(s | t):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return collections.Counter((i, len(s), find(i) if i is not None else None) for i, s in sets)


@pytest.mark.parametrize("seed", range(2))
def test_join_finds_every_link(spark, seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for i in range(160):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 160))]
        if i % 4 == 0:
            base[len(base) // 2 : len(base) // 2] = passage
        docs.append(base)
    for i in range(160):
        d = list(rng.choice(docs[:40]))
        for _ in range(rng.randrange(0, 5)):
            d[rng.randrange(len(d))] = f"e{rng.randrange(9999)}"
        docs.append(d)
    rows = [(i, " ".join(d).upper() if i % 7 == 0 else "  ".join(d), "en", "a") for i, d in enumerate(docs)]
    got = collections.Counter(tuple(r) for r in ngram_join.jaccard_components(frame(spark, rows), ngram_join.JoinParams(share=0.45, whole=30, group_nodes=5, wide=3, chunk_tokens=400, part_tokens=900, bucket_cells=3000, matrix_cells=2000, broadcast_rows=10)).collect())
    assert got == brute_components([r[:2] for r in rows])


def test_join_odd(spark):
    docs = odd(spark).filter("doc_id is null or not (doc_id = 4 and text like 'other%')")
    assert collections.Counter(tuple(r) for r in ngram_join.jaccard_components(docs).collect()) == brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert ngram_join.jaccard_components(empty(spark)).count() == 0


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " end"
    rows = [(5, text, "en", "a"), (5, text, "en", "a"), (5, text, "en", "b"), (3, near, "en", "a"), (None, text, "en", "a"), (None, None, "en", "a"), (None, None, "en", "a")]
    rows += [(8, "other words of its own here", "en", "a")] * 3 + [(5, "another text under an id that repeats", "en", "a"), (9, "", "en", "a"), (10, "", "en", "a")]
    docs = frame(spark, rows)
    got = collections.Counter((r.doc_id, r.text) for r in ngram_join.one_of_each(docs).collect())
    assert got == collections.Counter([(3, near), (None, None), (8, rows[7][1]), (5, rows[10][1]), (9, ""), (10, "")])
    assert ngram_join.one_of_each(docs).columns == docs.columns and ngram_join.one_of_each(empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 201), (203, 201), (202, 203)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200, 203: 200}


# ---- quality rules -----------------------------------------------------------------------------


def brute_base(text):
    w = WORD.findall(text or "")
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    marked = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


def test_rules_base_and_verdict(spark):
    rng = random.Random(5)
    clean = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(400)) for _ in range(rng.randrange(12, 200)))
    rows = [(i, clean(), "en", "a" if i % 3 else "b") for i in range(600)]
    rows += [(600 + i, " ".join(f"{w}$$$###" for w in clean().split()), "en", "a") for i in range(30)]
    rows += [(700, "same words in a row here " * 9, "en", "a"), (701, "x y z\n\nx y z\n \n" + clean(), "en", "b")]
    docs = odd(spark).unionByName(frame(spark, rows))
    texts = collections.Counter((r.doc_id, *brute_base(r.text)) for r in docs.collect())
    out = quality_rules.quality_rules(docs).collect()
    assert collections.Counter((r.doc_id, *(r[c] for c in quality_rules.BASE)) for r in out) == texts
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in out if r.kept}
    assert len(kept & set(range(600))) >= 594 and not kept & set(range(600, 630)) and 700 not in kept
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == kept and quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(6, 6))
    cov, m, z = a @ a.T + np.eye(6), rng.normal(size=6), rng.integers(-5, 6, 6)
    row = {f"c_{i}_{j}": float(cov[i, j]) for i in range(6) for j in range(i + 1)} | {f"m{i}": float(m[i]) for i in range(6)} | {f"z{i}": int(z[i]) for i in range(6)}
    got = quality_rules.with_distance(quality_rules._cholesky(spark.createDataFrame([row]), 6), 6).first()["__d2"]
    assert math.isclose(got, float((z - m) @ np.linalg.inv(cov) @ (z - m)), rel_tol=1e-9)


def plain_mcd(x, p, tries=120):
    """The least regularised determinant over many random starts, concentrated in numpy."""
    n, d = x.shape
    h, rng, floors, best = -(-3 * n // 4), np.random.default_rng(1), np.diag(np.square(p.floors)), None
    fitted = lambda rows: (rows.mean(0), np.cov(rows.T, bias=True) * p.consistency + floors)
    for _ in range(tries):
        m, c = fitted(x[rng.choice(n, d + 1, replace=False)])
        before = np.inf
        while True:
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            m, c = fitted(x[d2 <= np.sort(d2)[h - 1]])
            now = np.linalg.slogdet(c)[1]
            if now >= before - 1e-9:
                break
            before = now
        if best is None or now < best[0]:
            best = (now, m, c)
    return best


def test_estimate_is_the_least_determinant(spark):
    rng, p, groups = np.random.default_rng(8), quality_rules.RobustParams(), {}
    for g in range(4):
        a = rng.normal(size=(6, 6)) * 200
        body = rng.normal(size=(700, 6)) @ a + rng.integers(0, 2000, 6)
        far = rng.normal(size=(140, 6)) * 80 + rng.integers(3000, 6000, 6)
        groups[str(g)] = np.floor(np.concatenate([body, far if g % 2 else body[:100]])).astype(np.int64)
    groups["flat"] = np.concatenate([np.zeros((900, 6), np.int64), rng.integers(0, 3000, (200, 6))])
    rows = spark.createDataFrame([(g, *map(int, r)) for g, x in groups.items() for r in x], "gid string, " + ", ".join(f"z{i} long" for i in range(6)))
    got = {r.gid: r for r in quality_rules.minimum_determinant(rows.repartition(5), p, 6).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        logdet, mean, _ = plain_mcd(x.astype(float), p)
        assert math.isclose(got[g].logdet, logdet, abs_tol=0.01)
        assert np.allclose([got[g][f"m{i}"] for i in range(6)], mean, atol=40)
    assert math.isclose(quality_rules.chi_squared_cutoff(0.001, 6), 22.458, abs_tol=1e-3)


def test_few_documents_are_judged(spark):
    rng = random.Random(6)
    text = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(k))
    rows = [(i, text(80), "en", "big") for i in range(300)] + [(300 + i, " ".join(f"{w}$$$###" for w in text(60).split()), "en", "small") for i in range(12)]
    kept = {r.doc_id for r in quality_rules.quality_rules(frame(spark, rows)).filter("kept").collect()}
    assert len(kept & set(range(300))) >= 297 and not kept & set(range(300, 312))
    lone = frame(spark, [(1, text(40), None, "x"), (2, text(50), None, None)])
    assert {r.doc_id for r in quality_rules.quality_rules(lone).filter("kept").collect()} == {1, 2}


# ---- secrets -----------------------------------------------------------------------------------


def test_base_spans_by_plain_regex():
    rng = random.Random(4)
    bits = ["token", "=", ": ", "API_KEY", "apikey", "passwd", '"', "'", " ", "abcdef012345", "deadbeef" * 3, "AKIA", "ABCDEFGHIJKLMNOP1234", "paſſword", "x.y", "\n", "é"]
    for _ in range(400):
        t = "".join(rng.choice(bits) for _ in range(30))
        want = [("assign", *m.span()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert secret_scan.base_spans(t) == want


def test_novelty_tells_keys_from_words():
    t = "the bearer credential Zx81kQp0aLmW92vTt7Yb3NcD is set"
    assert [t[a:b] for _, a, b in secret_scan.all_spans(t)] == ["Zx81kQp0aLmW92vTt7Yb3NcD"]
    for clean in ("private key user_name_access_token_2 here", "a plain Zx81kQp0aLmW92vTt7Yb3NcD string", "session 1234567890123456 and text"):
        assert secret_scan.all_spans(clean) == []
    assert secret_scan.redact("ab cd ef", [("hex", 3, 5), ("assign", 0, 4)], "#") == "# ef"


def test_secrets_odd(spark, tmp_path):
    docs = odd(spark).unionByName(frame(spark, [(80, 'x token = "0123456789abcdef0123456789abcdef" y', "en", "a")]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op10_secret_scan(spark, str(tmp_path)).collect()}
    assert (rows[80].n_assign, rows[80].n_hex, rows[80].spans) == (1, 1, "assign:2:43,hex:11:43")
    assert rows[80].base_sha256 == hashlib.sha256(b"assign:2:43,hex:11:43").hexdigest() and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    red = {r.doc_id: r.text for r in secret_scan.redact_secrets(docs).collect()}
    assert red[80] == 'x [SECRET]" y' and red[1] is None and red[5] == LONG
    assert secret_scan.redact_secrets(docs).columns == docs.columns and secret_scan.scan_secrets(empty(spark)).count() == 0


# ---- classifier --------------------------------------------------------------------------------


def test_classifier_learns_and_covers_whole_texts(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "under"]) for _ in range(rng.randrange(5, 400)))
    rows = [(i, good() if i % 4 else good().upper().replace(" ", "!! "), "en", "a") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(600)], "doc_id long, quality int")
    docs = frame(spark, rows).unionByName(odd(spark).filter("doc_id is null or doc_id > 600 or doc_id in (1, 2)").withColumn("doc_id", F.col("doc_id") + 10_000))
    model = byte_cnn.fit(docs, labels, byte_cnn.CnnParams(epochs=8, filters=8, sample=200))
    out = byte_cnn.score_quality(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) >= 0.95 * len(held)
    far = model.score([b"river stone " * 3000, b"river stone " * 3000 + b"RIVER!! STONE!! " * 600])
    assert far[1] < far[0]
    assert byte_cnn.score_quality(empty(spark), model).count() == 0
    assert byte_cnn.fit(docs, labels.limit(0)).score([b""])[0] == pytest.approx(0.5)


def test_convolution_is_a_sum_over_positions():
    p = byte_cnn.CnnParams(width=3, filters=2, chunk=8)
    m = byte_cnn.Model(p)
    data = bytes(range(20))
    x, owned = byte_cnn.chunks_of(data, p)
    top, _ = m.pooled(x)
    symbols = [*data, *[byte_cnn.PAD] * 30]
    for c in range(3):
        acts = [sum(m.parts["weights"][j, symbols[i + j]] for j in range(3)) for i in range(8 * c, 8 * c + 8)]
        assert np.allclose(top[c], np.maximum(np.max(acts, axis=0), 0), atol=1e-5)
    assert owned.tolist() == [8, 8, 4]


# ---- PII ---------------------------------------------------------------------------------------


def test_surrogates(spark):
    text = "Mr. John Smith met Mrs. Anna Smith; MR SMITH's +1 (017) 555-7713 is +10175557713, a.B9@Mail7.example.com, 1.23.200.5, 9807915762804490, 4111 1111 1111 1111, 123-45-6789. Госпожа Петрова"
    docs = odd(spark).unionByName(frame(spark, [(50, text, "en", "a"), (51, "call +1-017-555-7713 or a.b9@mail7.example.com", "en", "a"), (52, "nothing private 12 here", "en", "a")]))
    rows = {r.doc_id: r for r in pii.surrogate_pii(docs, KEY).collect()}
    out = rows[50].text
    before, after = pii.mentions(text), pii.mentions(out)
    assert [(m.kind, len(m.canonical)) for m in before] == [(m.kind, len(m.canonical)) for m in after]
    pairs = {(b.kind, b.canonical): a.canonical for b, a in zip(before, after, strict=True)}
    assert len(set(pairs.values())) == len(pairs) and all(v != k[1] for k, v in pairs.items())
    assert pairs["name_m", "john"][-1] not in "aeiou" and pairs["name_f", "anna"][-1] == "a" and re.search("[а-я]", pairs["surname", "петрова"])
    assert pii._luhn(pairs["card", "4111111111111111"])
    again = {(m.kind, m.canonical) for m in pii.mentions(rows[51].text)}
    assert again == {("phone", pairs["phone", "10175557713"]), ("email", pairs["email", "a.b9@mail7.example.com"])}
    assert rows[52].text == "nothing private 12 here" and rows[52].n_replaced == 0 and rows[1].text is None and rows[5].text == LONG
    assert pii.surrogate_pii(empty(spark), KEY).count() == 0
    assert pii.surrogate_pii(docs, key="other").filter("doc_id = 50").first().text != out


def test_collisions_are_drawn_again(spark):
    ips = [f"{a}.{b}.1.1" for a in range(8) for b in range(6)]
    docs = frame(spark, [(i, f"host {x} up", "en", "a") for i, x in enumerate(ips)])
    new = [r.text.split()[1] for r in pii.surrogate_pii(docs, KEY).collect()]
    assert len(set(new)) == len(ips) and not set(new) & set(ips)
    assert pii.collisions(docs, KEY).count() == 0


# ---- chat --------------------------------------------------------------------------------------


def test_rotation(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (2, 0, "system", "alone"), (3, None, None, "who"), (3, 1, "cy", "me"), (None, 1, "dee", "x"), (1, 2, "bob", "yo")]
    t = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("part", F.lit(5))
    rows = {(r.conv_id, r.participant): r for r in chat_rotation.rotate_perspectives(t).collect() if r.part >= 0}
    assert set(rows) == {(1, "ann"), (1, "bob"), (3, "cy"), (None, "dee")}
    ann = rows[1, "ann"]
    assert ann.text.startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n")
    assert [ann.text[s.start : s.end] for s in ann.segments if s.mask] == ["hi < |im_end|><|im_end|>", "<|im_end|>"] and ann.n_turns == 5
    assert [s.mask for s in rows[1, "bob"].segments] == [False, False, True, True, False]
    assert chat_rotation.rotate_perspectives(t.limit(0)).count() == 0


def test_rotation_of_long_texts_and_clashing_names(spark):
    turns = [(1, 0, "ann", LONG), (1, 1, "bob", "short"), (1, 1, "bob", "short")]
    t = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    names = ("part", "piece", "rows", "n_turns", "participant", "segments", "speaker", "mask", "start", "end", "share")
    rows = {r.participant: r for r in chat_rotation.rotate_perspectives(t.select("*", *(F.lit("x").alias(c) for c in names))).collect()}
    assert set(rows) == {"ann", "bob"} and all(r.n_turns == 3 for r in rows.values())
    learned = [rows["ann"].text[s.start : s.end] for s in rows["ann"].segments if s.mask]
    assert learned == [LONG + "<|im_end|>"]


def test_long_dialogues_come_in_parts(spark):
    """Joined, the parts of a long dialogue are its whole rendering, also where all turns share a number."""
    said = F.concat(F.lit("t"), F.col("id").cast("string"))
    t = spark.range(1000).select(F.lit(1).alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), said.alias("text"))
    short = spark.createDataFrame([(2, 0, "a", "hi"), (None, None, "a", None)], "conv_id int, turn int, role string, text string")
    for turns in (t.union(short), t.withColumn("turn", F.lit(3)).union(t), t.withColumns({"conv_id": F.lit(None).cast("int"), "text": F.lit("same")})):
        whole = {(r.conv_id, r.participant): r for r in chat_rotation.rotate_perspectives(turns).collect()}
        cut = {}
        for r in chat_rotation.rotate_perspectives(turns, part_bytes=2000).orderBy("part").collect():
            cut.setdefault((r.conv_id, r.participant), []).append(r)
        assert set(cut) == set(whole)
        for key, rows in cut.items():
            assert "".join(r.text for r in rows) == whole[key].text
            assert [s.turn for r in rows for s in r.segments] == [s.turn for s in whole[key].segments]
            for r in rows:
                assert all(r.text[s.start : s.end].endswith("<|im_end|>") and r.text[: s.start].endswith("assistant\n") == s.mask for s in r.segments)
                assert r.n_turns <= 2000 // 64 + 1 and len(r.segments) == r.n_turns
        assert any(len(rows) > 20 for rows in cut.values())
