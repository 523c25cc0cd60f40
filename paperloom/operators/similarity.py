"""Similarity joins of pages: rare-token candidates with set verification, and bit-vector distance."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sets
from ..functions.text import page_tokens
from ..sources.shared import written

PART_TOKENS = 4_000_000
BROADCAST_ROWS = 1_000_000
MATCHED = pa.schema([("id", pa.int64()), ("other_id", pa.int64()), ("coverage", pa.float64()), ("score", pa.float64()), ("pages", pa.list_(pa.int32()))])


def tokenized(pages: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, page_idx, tokens of the pages with at least ``least`` tokens: 3 for pages to be found, 1 for those to find them in."""
    return pages.select("doc_id", "page_idx", page_tokens(F.col("page_text")).alias("tokens")).filter(F.size("tokens") >= least)


def document_frequency(pages: DataFrame) -> DataFrame:
    """token, df: in how many documents a token occurs."""
    return pages.select("doc_id", F.explode("tokens").alias("token")).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def rarest_tokens(pages: DataFrame, df: DataFrame, k: int = 8) -> DataFrame:
    """doc_id, page_idx, token, df: each page's ``k`` tokens of least document frequency, ties by token.

    Frequencies may be those of tokens' hashes; then the hash of a token is returned.
    """
    key = F.xxhash64("word") if df.schema["token"].dataType == T.LongType() else F.col("word")
    exploded = pages.select("doc_id", "page_idx", F.explode("tokens").alias("word")).withColumn("token", key).join(df, "token")
    w = W.partitionBy("doc_id", "page_idx").orderBy("df", "word")
    return exploded.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).select("doc_id", "page_idx", "token", "df")


def followed_tokens(inputs: DataFrame, outputs: DataFrame, k: int = 8, floor: int = 20, share: int = 5, few: int = 40, df: DataFrame | None = None) -> DataFrame:
    """doc_id, token, followed: the rarest tokens of the inputs' pages that occur in the outputs.

    Frequencies are those among the outputs; tokens in more than max(floor, outputs / share) documents
    are not followed, and none is where there are at most ``few`` outputs.  ``df``: the frequencies, if at hand.
    """
    n = outputs.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") > few, F.greatest(F.lit(floor), F.floor(F.col("n") / share))).otherwise(0).alias("most"))
    rare = rarest_tokens(inputs, document_frequency(outputs) if df is None else df, k).select("doc_id", "token", "df").distinct()
    return rare.crossJoin(F.broadcast(n)).select("doc_id", "token", (F.col("df") <= F.col("most")).alias("followed"))


def candidate_documents(inputs: DataFrame, outputs: DataFrame, k: int = 8, followed: DataFrame | None = None) -> DataFrame:
    """doc_id, out_id: documents that share a followed token, which keeps the join near-linear.

    ``followed``: what ``followed_tokens`` gave, if it is at hand.
    """
    postings = outputs.select(F.col("doc_id").alias("out_id"), F.explode("tokens").alias("token")).distinct()
    rare = followed_tokens(inputs, outputs, k) if followed is None else followed
    return rare.filter("followed").join(postings, "token").select("doc_id", "out_id").distinct()


def hashed_jaccard(a, b):
    """Share of common elements of two arrays of distinct 64-bit numbers; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def _whole(pages: DataFrame) -> DataFrame:
    """doc_id, sig, pages: each document in one row, with the digest of its pages' token sets."""
    docs = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_idx", F.sort_array("tokens").alias("hashes")))).alias("pages"))
    return docs.select("doc_id", F.sha2(F.to_json("pages"), 256).alias("sig"), "pages")


def _scored(pairs: DataFrame, page_least: float) -> DataFrame:
    """sig, out_sig, pages, out_pages -> sig, out_sig, coverage, score, pages; without pairs that share no token."""
    each = pairs.select("sig", "out_sig", F.explode("pages").alias("p"), "out_pages").select("sig", "out_sig", "p", F.explode("out_pages").alias("q"))
    each = each.select("sig", "out_sig", "p.page_idx", F.col("q.page_idx").alias("out_page"), hashed_jaccard(F.col("p.hashes"), F.col("q.hashes")).alias("s"))
    best = each.groupBy("sig", "out_sig", "page_idx").agg(F.max(F.struct("s", (-F.col("out_page")).alias("p"))).alias("b"))
    good = F.col("b.s") >= page_least
    scored = best.groupBy("sig", "out_sig").agg(
        F.round(F.avg(good.cast("double")), 9).alias("coverage"), F.round(trimmed_mean(F.collect_list("b.s")), 9).alias("score"),
        F.sort_array(F.collect_set(F.when(good, -F.col("b.p")))).alias("pages"), F.max("b.s").alias("__top"),
    )
    return scored.filter("__top > 0").drop("__top")


def unfollowed_matches(inputs: DataFrame, outputs: DataFrame, followed: DataFrame, page_least: float = 0.75) -> DataFrame:
    """As ``text_matches``, for the inputs that share tokens with the outputs but have none to follow.

    They are compared with all outputs that share any token, as others score nothing.  Documents with the
    same pages are compared once.
    """
    alone = followed.groupBy("doc_id").agg(F.bool_or("followed").alias("any")).filter("not any").select("doc_id")
    one, two = _whole(inputs.join(alone, "doc_id", "left_semi")), _whole(outputs).withColumnsRenamed({"sig": "out_sig", "pages": "out_pages", "doc_id": "out_id"})
    tokens = lambda df, sig, pages: df.select(sig, F.explode(F.array_distinct(F.flatten(F.transform(pages, lambda p: p["hashes"])))).alias("token")).distinct()
    pairs = tokens(one, "sig", "pages").join(tokens(two, "out_sig", "out_pages"), "token").select("sig", "out_sig").distinct()
    pairs = pairs.join(one.groupBy("sig").agg(F.first("pages").alias("pages")), "sig").join(two.groupBy("out_sig").agg(F.first("out_pages").alias("out_pages")), "out_sig")
    return _scored(pairs, page_least).join(one.select("doc_id", "sig"), "sig").join(two.select("out_id", "out_sig"), "out_sig").select("doc_id", "out_id", "coverage", "score", "pages")


def similar_sets(left: DataFrame, right: DataFrame, least: float, df: DataFrame | None = None) -> DataFrame:
    """(id, page_idx, hashes) against the same with other_id -> id, other_id: a pair for every two that have
    pages whose sets of tokens are at least ``least`` (over 0) similar by Jaccard.  ``df`` is not needed any more:
    tokens are counted where they meet."""
    pages = lambda d, key: d.select(F.col(key).alias("id"), "page_idx", F.col("hashes").alias("tokens"), F.lit(1).alias("copies"))
    one, two = _packed(pages(left, "id"), 2, "left-parts"), _packed(pages(right, "other_id"), 3, "right-parts")
    return _met(one.withColumnRenamed("vocabulary", "hashes").withColumn("df", F.col("held")), two, least).select("id", "other_id")


def _packed(pages: DataFrame, few: int, name: str, by_rarity: bool = True) -> DataFrame:
    """(id, page_idx, tokens, copies) in parts of whole documents, of ``PART_TOKENS`` tokens or few more, one row and file
    for each (``sets.pack``)."""
    n = pages.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n")).first().n
    # A few parts at least, unless there is little to do, so that there are tasks for several cores.
    parts = max(-(-n // PART_TOKENS), min(few, -(-n // (PART_TOKENS // 6))), 1)
    rows = pages.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "page_idx", "tokens", F.col("copies").cast("int").alias("copies"))
    kind = rows.schema["tokens"].dataType.elementType.simpleString()
    return written(rows.groupBy("part").applyInArrow(lambda x: sets.pack(x, by_rarity), sets.PACKED.format(kind)), name, rows=1)


def _met(left: DataFrame, right: DataFrame, least: float, page_least: float = 0.75, follow: tuple[int, int] | None = None, best_only: bool = False) -> DataFrame:
    """Packed parts, the left's with ``hashes`` and ``df`` -> id, other_id, coverage, score, pages (``sets.matches``).

    Every part of the left meets every part of the right in one task.  They are read from where they are written, so
    nothing is shuffled, and documents that meet are ruled out and scored there, so that no pair is either.
    """
    columns = ("docs", "counts", "places", "sizes", "codes")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cell = lambda name: b.column(name)[i]  # noqa: B023, E731
                numbers = lambda name: cell(name).values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                if not len(cell("vocabulary")) or not len(cell("hashes")):
                    continue
                one, two = (sets.Pages(*(cell(f"{side}{c}").as_py() for c in columns)) for side in ("", "r_"))
                found = list(sets.matches(sets.Meeting(one, two, numbers("hashes"), numbers("vocabulary"), numbers("df")), least, page_least, follow, best_only))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(map(list, zip(*found)), MATCHED.types)], schema=MATCHED)

    one = left.select(*columns, "hashes", "df")
    two = right.select(*(F.col(c).alias(f"r_{c}") for c in columns), "vocabulary").hint("shuffle_replicate_nl")
    return one.crossJoin(two).mapInArrow(meet, "id long, other_id long, coverage double, score double, pages array<int>")


def _signed(pages: DataFrame) -> DataFrame:
    """doc_id, page_idx, tokens (numbers) -> doc_id, sig: a digest of each document's pages and their sets of tokens."""
    t = F.sort_array("tokens")
    signs = pages.select("doc_id", F.struct("page_idx", F.xxhash64(F.lit(1), t).alias("a"), F.xxhash64(F.lit(2), t).alias("b"), F.size("tokens").alias("n")).alias("p"))
    return signs.groupBy("doc_id").agg(F.unhex(F.md5(F.to_json(F.sort_array(F.collect_list("p"))))).alias("sig"))


def similar_documents(inputs: DataFrame, outputs: DataFrame, least: float, page_least: float = 0.75, k: int = 8, floor: int = 20, share: int = 5, few: int = 40, best_only: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of different documents whose score reaches ``least`` or that cover a page, and who has which pages.

    Returns (first, out_first, coverage, score, pages), (doc_id, first) and (out_id, out_first), where ``first`` is the
    least id of the documents with the same pages.  The pairs are those of ``text_matches``, but none is looked at unless
    some of its pages are ``least`` similar; where ``least`` is 0, all that share any token are.  With ``best_only`` only
    pairs that may be the input's best are returned, some for each part of the outputs.
    """
    hashes = lambda pages: pages.select("doc_id", "page_idx", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"))
    inputs, outputs = written(inputs.select("doc_id", "page_idx", "tokens"), "input-tokens"), written(hashes(outputs), "output-tokens")
    ins, outs = written(_signed(hashes(inputs)), "input-signs"), written(_signed(outputs), "output-signs")
    once = lambda signs, name: written(signs.groupBy("sig").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), name)
    first_in, first_out = once(ins, "inputs-once"), once(outs, "outputs-once")
    small = lambda first: F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    pages = lambda rows, first: rows.join(small(first.select(F.col("first").alias("doc_id"), "copies")), "doc_id").select(F.col("doc_id").alias("id"), "page_idx", "tokens", "copies")
    two = _packed(pages(outputs, first_out), 3, "output-parts")
    one = _packed(pages(inputs, first_in), 2, "input-parts", by_rarity=False)
    df = two.select(F.explode(F.arrays_zip("vocabulary", "held")).alias("v")).groupBy(F.col("v.vocabulary").alias("hash")).agg(F.sum("v.held").alias("df"))
    words = one.select("part", F.posexplode("vocabulary").alias("at", "word")).withColumn("hash", F.xxhash64("word"))
    asked = words.join(df, "hash", "left").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("at", "hash", F.coalesce("df", F.lit(0)).alias("df")))).alias("w"))
    asked = asked.select("part", F.col("w.hash").alias("hashes"), F.col("w.df").alias("df"))
    one = written(one.drop("vocabulary", "held").join(asked, "part"), "input-parts", rows=1)
    n = outs.count()
    near = _met(one, two, min(least, page_least), page_least, (k, max(floor, n // share) if n > few else 0), best_only)
    near = near.withColumns({c: F.round(c, 9) for c in ("coverage", "score")}).filter((F.col("score") >= least) | (F.col("coverage") > 0))
    near = written(near.withColumnsRenamed({"id": "first", "other_id": "out_first"}), "near-documents")
    whose = lambda signs, first: signs.join(first, "sig").select("doc_id", "first")
    return near, whose(ins, first_in), whose(outs, first_out).withColumnsRenamed({"doc_id": "out_id", "first": "out_first"})


def best_text_matches(inputs: DataFrame, outputs: DataFrame, least: float = 0.6, page_least: float = 0.75, k: int = 8) -> DataFrame:
    """doc_id, out_id, coverage, score, pages: each input's best output, if it covers a page or scores ``least``.

    What ``best_match`` of ``text_matches`` gives for these inputs, without looking at other pairs and without a
    row for every pair of copies.  Inputs whose best output scores less have no row; with a ``least`` of 0 all that share
    a token with an output they meet have one.
    """
    pairs, ins, _ = similar_documents(inputs, outputs, least, page_least, k, best_only=True)
    rank = F.struct("coverage", "score", (-F.col("out_first")).alias("o"))
    best = pairs.groupBy("first").agg(F.max_by(F.struct(F.col("out_first").alias("out_id"), "coverage", "score", "pages"), rank).alias("b"))
    return ins.join(best, "first").select("doc_id", "b.*")


def trimmed_mean(scores, share: float = 0.9):
    """Mean of the best ceil(share * n) scores of an array."""
    best = F.slice(F.sort_array(scores, False), F.lit(1), F.ceil(F.size(scores) * share).cast("int"))
    return F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)


def text_matches(inputs: DataFrame, outputs: DataFrame, page_least: float = 0.75, k: int = 8, least: float = 0.0) -> DataFrame:
    """doc_id, out_id, coverage, score, pages: pairs with their page-by-page similarity.

    Inputs meet the outputs that share a followed token with them, or all outputs where there is none.
    Each input page takes its best output page (the first, on ties); coverage is the share of pages at or
    above ``page_least`` and score the trimmed mean of the page scores, both to nine digits, so that neither
    depends on the order of sums.  Pages are compared by 64-bit hashes of their distinct tokens.

    With ``least`` over 0 only pairs of at least that score are returned, and only pairs with pages that
    similar are looked at.  Without it every pair that shares a token followed is, which can be a fixed share
    of all pairs.
    """
    if least > 0:
        pairs, ins, outs = similar_documents(inputs, outputs, least, page_least, k)
        return pairs.filter(F.col("score") >= least).join(ins, "first").join(outs, "out_first").select("doc_id", "out_id", "coverage", "score", "pages")
    # Written, as texts are cut into tokens here and several steps read them.
    hashes = lambda pages: pages.select("doc_id", "page_idx", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"))
    inputs, outputs = written(inputs.select("doc_id", "page_idx", "tokens"), "input-tokens"), written(hashes(outputs), "output-tokens")
    rare = written(followed_tokens(inputs, outputs, k), "followed-tokens")
    inputs = hashes(inputs)
    pairs = candidate_documents(inputs, outputs, k, rare)
    one = _whole(inputs).select(F.col("doc_id").alias("sig"), "pages")
    two = _whole(outputs).select(F.col("doc_id").alias("out_sig"), F.col("pages").alias("out_pages"))
    pairs = pairs.select(F.col("doc_id").alias("sig"), F.col("out_id").alias("out_sig")).join(one, "sig").join(two, "out_sig")
    followed = _scored(pairs, page_least).withColumnsRenamed({"sig": "doc_id", "out_sig": "out_id"})
    return followed.select("doc_id", "out_id", "coverage", "score", "pages").unionByName(unfollowed_matches(inputs, outputs, rare, page_least))


def best_match(matches: DataFrame) -> DataFrame:
    """Each input's output with the highest coverage, then score, then least id."""
    w = W.partitionBy("doc_id").orderBy(F.desc("coverage"), F.desc("score"), "out_id")
    return matches.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def sign_bits(vector, n: int = 64):
    """The signs of the first ``n`` (at most 64) components packed into one integer."""
    return F.aggregate(F.slice(vector, 1, n), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR((x > 0).cast("long")))


def hamming(a, b):
    """Distance of two packed bit vectors given as arrays of integers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def band_radii(most: int, bands: int) -> list[int]:
    """How many bits may differ in each band: vectors that differ in at most ``most`` bits are within the radius of one
    band at least, as all bands beyond theirs would make more than ``most``."""
    each, over = divmod(most, bands)
    return [each if i <= over else each - 1 for i in range(bands)]


def bands_for(few: int, many: int, most: int, bits: int, probes: int = 5000) -> tuple[int, float, float]:
    """bands, probes and share of pairs that meet, where these cost least: rows sent by ``few`` vectors that probe, by
    ``many`` that are probed, and pairs of random vectors that meet and are compared; at most ``probes`` a vector.

    Every choice finds the same pairs.  Bands grow wider, with more probes, as there are more vectors.
    """
    plans = []
    for bands in range(min(2, most + 1), min(most + 1, bits) + 1):
        sent, met = 0, 0.0
        for (a, b), r in zip(_cuts(bits, bands), band_radii(most, bands)):
            ball = sum(math.comb(b - a, k) for k in range(r + 1))
            sent, met = sent + ball, met + ball / 2 ** (b - a)
        if sent <= max(probes, most + 1):
            plans.append((few * sent + many * bands + few * many * met, bands, sent, met))
    return min(plans)[1:]


def _cuts(bits: int, bands: int) -> list[tuple[int, int]]:
    cuts = [round(i * bits / bands) for i in range(bands + 1)]
    return list(zip(cuts, cuts[1:]))


def _within(width: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` bits."""
    return [sum(1 << k for k in at) for n in range(radius + 1) for at in itertools.combinations(range(width), n)]


def near_bits(left: DataFrame, right: DataFrame, most: int = 10, bits: int = 64, bands: int | None = None) -> DataFrame:
    """id, bits against other_id, other_bits within ``most`` differing bits.

    Vectors are cut into bands.  Those of the smaller side send, for each band, every value within the band's radius,
    the others their own, so that an equi-join finds every pair; the distance is then computed exactly, before
    pairs that met twice are made one.  The number of ``bands`` follows from the counted sides (``bands_for``); it
    changes no result.  Null ids or vectors meet nothing; repeated rows give each pair once.
    """
    left, right = left.filter("id is not null and bits is not null"), right.filter("id is not null and bits is not null")
    sizes = left.count(), right.count()
    swapped = sizes[0] > sizes[1]
    bands = bands or bands_for(min(sizes), max(sizes), most, bits)[0]
    parts = list(zip(_cuts(bits, bands), band_radii(most, bands)))

    def sent(c: str, i: int, a: int, b: int, radius: int):
        own = F.shiftrightunsigned(c, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1).cast("long"))
        masks = F.split(F.lit(",".join(map(str, _within(b - a, radius)))), ",").cast("array<bigint>")
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("band"), own.bitwiseXOR(m).alias("part")))

    def keys(c: str, probing: bool):
        return F.explode(F.concat(*(sent(c, i, a, b, r if probing else 0) for i, ((a, b), r) in enumerate(parts) if r >= 0))).alias("x")

    one = left.select("id", "bits", keys("bits", not swapped)).select("id", "bits", "x.*")
    two = right.select(F.col("id").alias("other_id"), F.col("bits").alias("other_bits"), keys("bits", swapped)).select("other_id", "other_bits", "x.*")
    met = one.join(two, ["band", "part"]).withColumn("distance", F.bit_count(F.col("bits").bitwiseXOR(F.col("other_bits"))))
    return met.filter(F.col("distance") <= most).select("id", "other_id", "bits", "other_bits", "distance").distinct()


def _drawn(pages: DataFrame, least_ink: float) -> DataFrame:
    """doc_id, page_idx, hash of the pages that are not blank."""
    return pages.filter("hash is not null" + (f" and ink >= {least_ink}" if "ink" in pages.columns else "")).select("doc_id", "page_idx", "hash")


def near_hashes(inputs: DataFrame, outputs: DataFrame, most: int = 10, words: int = 4) -> DataFrame:
    """hash, out_hash: different values, each pair once, that differ in at most ``most`` bits.

    They agree on one of ``most`` + 1 bands.  A band takes every (``most`` + 1)th bit, as neighbouring bits of a page, such
    as those of an empty foot, are alike on many pages.
    """
    masks = [[sum(1 << (63 - j) for j in range(64) if (64 * w + j) % (most + 1) == i) for w in range(words)] for i in range(most + 1)]
    signed = lambda m: F.lit(m - 2**64 if m >= 2**63 else m).cast("long")
    key = lambda i: F.xxhash64(F.lit(i), *(F.get("hash", F.lit(w)).bitwiseAND(signed(m)) for w, m in enumerate(masks[i])))
    banded = lambda d: d.select("hash").distinct().select("hash", F.explode(F.array(*map(key, range(most + 1)))).alias("band"))
    met = banded(inputs).join(banded(outputs).withColumnRenamed("hash", "out_hash"), "band")
    return met.filter(hamming(F.col("hash"), F.col("out_hash")) <= most).select("hash", "out_hash").distinct()


def image_matches(inputs: DataFrame, outputs: DataFrame, most: int = 10, words: int = 4, least_ink: float = 0.006) -> DataFrame:
    """Pages with 256-bit hashes (doc_id, page_idx, hash and, if known, ink) -> doc_id, out_id, coverage, score,
    matched, pages.

    Pages without a hash, or with a share of ink under ``least_ink``, are blank and take no part.  Documents meet
    if any of their pages are within ``most`` bits; then every input page takes its nearest
    output page (the first, on ties).  Coverage is the share of pages within ``most`` bits, the score the mean
    of 1 - distance / bits over all pages, ``matched`` their number and ``pages`` the output pages they took.
    """
    inputs, outputs, bits = _drawn(inputs, least_ink), _drawn(outputs, least_ink), 64 * words
    near, of = near_hashes(inputs, outputs, most, words), outputs.select(F.col("doc_id").alias("out_id"), F.col("page_idx").alias("out_page"), F.col("hash").alias("out_hash"))
    pairs = near.join(inputs.select("doc_id", "hash"), "hash").join(of.select("out_id", "out_hash"), "out_hash").select("doc_id", "out_id").distinct()
    pages = pairs.join(inputs, "doc_id").join(of, "out_id")
    nearest = pages.groupBy("doc_id", "out_id", "page_idx").agg(F.min(F.struct(hamming(F.col("hash"), F.col("out_hash")).alias("d"), "out_page")).alias("near"))
    d = F.col("near.d")
    return nearest.groupBy("doc_id", "out_id").agg(
        F.avg((d <= most).cast("double")).alias("coverage"), F.avg(1 - d / bits).alias("score"), F.count_if(d <= most).alias("matched"),
        F.sort_array(F.collect_set(F.when(d <= most, F.col("near.out_page")))).alias("pages"),
    )


def best_image_matches(inputs: DataFrame, outputs: DataFrame, most: int = 10, words: int = 4, least_ink: float = 0.006) -> DataFrame:
    """What ``unambiguous`` of ``image_matches`` gives, without a row for every pair of copies.

    Of inputs with the same pages one is matched for all.  Of such outputs the two of the greatest ids are: one to be the
    best, and one to show that it is not alone.
    """
    inputs, outputs = written(_drawn(inputs, least_ink), "input-images"), written(_drawn(outputs, least_ink), "output-images")
    signs = lambda d: d.groupBy("doc_id").agg(F.md5(F.to_json(F.sort_array(F.collect_list(F.struct("page_idx", "hash"))))).alias("sig"))
    ins, outs = written(signs(inputs), "input-signs"), written(signs(outputs), "output-signs")
    first = outs.groupBy("sig").agg(F.max("doc_id").alias("first"))
    second = outs.join(first, "sig").filter(F.col("doc_id") < F.col("first")).groupBy("sig").agg(F.max("doc_id").alias("doc_id"))
    two = first.select(F.col("first").alias("doc_id")).unionByName(second.select("doc_id"))
    one = ins.groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    of = lambda pages, docs: written(pages.join(docs.select("doc_id"), "doc_id", "left_semi"), "images-once")
    best = unambiguous(image_matches(of(inputs, one), of(outputs, two), most, words, least_ink))
    return ins.join(best.join(one, "doc_id").drop("doc_id"), "sig").select("doc_id", *(c for c in best.columns if c != "doc_id"))


def unambiguous(matches: DataFrame, coverage: float = 0.5, margin: float = 0.01) -> DataFrame:
    """Each input's best image match, flagged if another one is as good (ties go to the later output)."""
    w = W.partitionBy("doc_id").orderBy(F.desc("coverage"), F.desc("score"), F.desc("out_id"))
    ranked = matches.filter(F.col("coverage") >= coverage).withColumns({"rn": F.row_number().over(w), "nc": F.lead("coverage").over(w), "ns": F.lead("score").over(w)})
    same = (F.col("nc") == F.col("coverage")) & (F.abs(F.col("score") - F.col("ns")) <= margin)
    return ranked.filter("rn = 1").select("doc_id", "out_id", "coverage", "score", F.coalesce(same, F.lit(False)).alias("ambiguous"), *(c for c in ("pages",) if c in matches.columns))
