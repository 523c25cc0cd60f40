"""Quality rules: robust multivariate outliers, in DataFrame operations only.

Each text becomes a vector of integer-scaled statistics.  Per language and source a minimum-covariance-
determinant estimate is sought: the mean and covariance of the ``core`` of the documents whose covariance has
the least determinant.  Several starts (coordinate medians and quartile ranges; mean and covariance; sign
covariance; covariance of squashed values) are concentrated: the core nearest to an estimate gives the next
one, whose determinant is never larger.  After two steps the best starts of each group go on until no
determinant falls any more, and the least one wins.  As many texts agree exactly in some statistic, the
covariance is regularised by a fixed diagonal (``floors``), in the steps as in the result.

A step needs two aggregations: counts and integer moments by group, start and distance bin, then by cell of
the one bin in which the core ends, so sums are exact whatever the partitioning.  A document is rejected if
its squared Mahalanobis distance exceeds the chi-squared quantile of ``tail``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CHARS, materialize, null_safe, release

SEPARATOR = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCALE, MOST = 1000, 10_000


@dataclass(frozen=True)
class RobustParams:
    """``core``: share of a group that an estimate rests on.  ``floors``: least standard deviation of each
    statistic, in the order of ``vector``.  ``consistency`` makes the covariance of the nearest ``core`` of a
    normal sample that of the whole (six dimensions).  ``tail``: share of a normal sample that would be
    rejected; it is so small as the statistics of clean texts have much longer tails.  ``early``: steps of all
    starts; ``best``: starts that go on; ``most_steps``: a bound on steps that is not reached in practice
    (every step has a lower determinant).  Groups under ``least_group`` documents are judged by a wider one."""

    core: float = 0.75
    early: int = 2
    best: int = 2
    most_steps: int = 50
    tail: float = 5e-11
    consistency: float = 1.36
    least_group: int = 50
    floors: tuple[float, ...] = (60.0, 60.0, 60.0, 100.0, 60.0, 60.0)
    least_words: int = 10
    most_repeat_percent: int = 20


def chi_squared_cutoff(tail: float, d: int) -> float:
    """The value that a chi-squared variable of d (even) degrees of freedom exceeds with probability ``tail``."""
    over = lambda x: exp(-x / 2) * sum((x / 2) ** k / factorial(k) for k in range(d // 2))
    low, high = 0.0, 4096.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) > tail else (low, mid)
    return high


def _removed(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def with_statistics(docs: DataFrame) -> DataFrame:
    """The input with the base statistics and three more (``__lines``, ``__upper``, ``__shout``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("__text", text).withColumn("__trim", F.btrim("__text", F.lit(SPACE_CHARS)))
    out = out.withColumn("__words", F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(F.split("__trim", SEPARATOR)))
    out = out.withColumn("__all_lines", F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    size = F.size("__words")
    window = lambda i: F.xxhash64(*(F.get("__words", i + k) for k in range(WINDOW)))
    hashes = F.when(size < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(size - WINDOW, F.lit(0))), window))
    out = out.withColumns(
        {
            "n_words": size.cast("long"),
            "word_chars": F.length(F.translate("__text", SPACE_CHARS, "")).cast("long"),
            "n_symbols": _removed(F.col("__text"), SYMBOLS),
            "n_dup_lines": (F.size("__all_lines") - F.size(F.array_distinct("__all_lines"))).cast("long"),
            "__lines": F.size("__all_lines").cast("long"),
            "__upper": F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long"),
            "__shout": _removed(F.col("__text"), "!?"),
            "__hashes": hashes,
        }
    ).drop("__text", "__trim", "__words", "__all_lines")
    # Only texts with a repeated window have their windows sorted.
    repeats = F.size("__hashes") > F.size(F.array_distinct("__hashes"))
    placed = F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn("__sorted", F.when(repeats, F.array_sort(placed))).drop("__hashes")
    same = lambda e, i: F.coalesce(F.get("__sorted", i)["h"] == e["h"], F.lit(False))
    starts = F.array_sort(F.transform(F.filter("__sorted", lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__sorted")


def base_failed(p: RobustParams) -> Column:
    return (F.col("n_words") < p.least_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(p.most_repeat_percent) * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics, scaled to integers: log mean word length, then square roots of the shares
    of symbols, repeated lines, repeated words, capitals and shouts.  Added constants damp short texts; values
    over ``MOST`` are held there, so that sums of squares stay within 64 bits for 9e10 documents."""
    n, c = F.col("n_words"), F.col("word_chars")
    share = lambda part, whole, extra: F.sqrt(part / (whole + F.lit(extra)))
    found = [
        F.log(F.greatest(c, F.lit(1)) / F.greatest(n, F.lit(1))),
        share(F.col("n_symbols"), n, 20),
        share(F.col("n_dup_lines"), F.col("__lines"), 5),
        share(F.col("n_repeat_words"), n, 20),
        share(F.col("__upper"), c, 50),
        share(F.col("__shout"), n, 20),
    ]
    return [F.least(F.floor(x * SCALE), F.lit(MOST)).cast("long").alias(f"z{i}") for i, x in enumerate(found)]


def _cholesky(est: DataFrame, d: int) -> DataFrame:
    """Adds l_i_j, the lower Cholesky factor of c_i_j, one column of the factor after the other."""
    for j in range(d):
        inner = reduce(lambda a, k: a - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"c_{j}_{j}"))
        est = est.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(inner, F.lit(1e-9))))
        est = est.withColumns(
            {f"l_{i}_{j}": reduce(lambda a, k, i=i: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"c_{i}_{j}")) / F.col(f"l_{j}_{j}") for i in range(j + 1, d)}
        )
    return est


def with_distance(rows: DataFrame, d: int) -> DataFrame:
    """Adds ``__d2``, the squared Mahalanobis distance of z from m under the factor l."""
    for i in range(d):
        rest = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"__y{k}"), range(i), F.col(f"z{i}") - F.col(f"m{i}"))
        rows = rows.withColumn(f"__y{i}", rest / F.col(f"l_{i}_{i}"))
    return rows.withColumn("__d2", reduce(lambda a, i: a + F.col(f"__y{i}") * F.col(f"__y{i}"), range(d), F.lit(0.0))).drop(*(f"__y{i}" for i in range(d)))


def _factor_columns(d: int) -> list[str]:
    return [f"m{i}" for i in range(d)] + [f"l_{i}_{j}" for i in range(d) for j in range(i + 1)]


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


def _moments(x: list[Column], names: tuple[str, str] = ("s", "s_")) -> list[Column]:
    """Count, sums and sums of products of integer columns."""
    one, two = names
    return [F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"{one}{i}") for i, c in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"{two}{i}_{j}") for i, j in _pairs(len(x)))]


def _estimate(moments: DataFrame, p: RobustParams, d: int, scale: float) -> DataFrame:
    """Moments -> mean, the regularised covariance's Cholesky factor and the logarithm of its determinant."""
    est = moments.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(d)})
    cov = lambda i, j: (F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * scale
    return _factored(est.withColumns({f"c_{i}_{j}": cov(i, j) + (p.floors[i] ** 2 if i == j else 0.0) for i, j in _pairs(d)}), d)


def _factored(est: DataFrame, d: int) -> DataFrame:
    logdet = F.lit(2.0) * reduce(lambda a, i: a + F.log(F.col(f"l_{i}_{i}")), range(d), F.lit(0.0))
    return _cholesky(est, d).select("gid", "start", *_factor_columns(d), logdet.alias("logdet"))


def _middles(rows: DataFrame, p: RobustParams, d: int) -> DataFrame:
    """(gid, q2_i, r_i): medians and quartile ranges (as standard deviations, no less than the floors) from
    histograms of the integer statistics, which have at most ``MOST`` values each."""
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.col(f"z{i}").alias("z")) for i in range(d)))).alias("x")
    hist = rows.select("gid", pairs).groupBy("gid", "x.dim", "x.z").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("gid", "dim")
    hist = hist.withColumns({"upto": F.sum("n").over(w.orderBy("z")), "all": F.sum("n").over(w)})
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("z")))
    quartiles = hist.groupBy("gid", "dim").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    pick = lambda c, i: F.max(F.when(F.col("dim") == i, F.col(c)))
    spread = lambda i: F.greatest((pick("q3", i) - pick("q1", i)) / F.lit(1.349), F.lit(p.floors[i]))
    return quartiles.groupBy("gid").agg(*(pick("q2", i).cast("double").alias(f"q2_{i}") for i in range(d)), *(spread(i).alias(f"r_{i}") for i in range(d)))


def starts(rows: DataFrame, p: RobustParams, d: int) -> DataFrame:
    """(gid, start, estimate) of four starts per group, from all its documents."""
    middles = materialize(_middles(rows, p, d), "rules-middles")
    plain = [F.col(f"q2_{i}").alias(f"m{i}") for i in range(d)] + [(F.col(f"r_{i}") if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i, j in _pairs(d)]
    first = middles.select("gid", F.lit(0).alias("start"), *plain, F.lit(0.0).alias("logdet"))
    second = _estimate(rows.groupBy("gid").agg(*_moments([F.col(f"z{i}") for i in range(d)])).withColumn("start", F.lit(1)), p, d, 1.0)
    # Standardised values as directions, and squashed: integers again, so that sums do not depend on their order.
    placed = rows.join(middles, "gid").withColumns({f"y{i}": (F.col(f"z{i}") - F.col(f"q2_{i}")) / F.col(f"r_{i}") for i in range(d)})
    length = F.sqrt(reduce(lambda a, i: a + F.col(f"y{i}") * F.col(f"y{i}"), range(d), F.lit(0.0)))
    whole = lambda x: F.round(x * 1000).cast("long")
    placed = placed.withColumn("length", length).withColumns(
        {f"u{i}": F.when(F.col("length") > 0, whole(F.col(f"y{i}") / F.col("length"))).otherwise(F.lit(0)) for i in range(d)} | {f"v{i}": whole(F.tanh(f"y{i}")) for i in range(d)}
    )
    both = _moments([F.col(f"u{i}") for i in range(d)], ("su", "su_")) + _moments([F.col(f"v{i}") for i in range(d)], ("sv", "sv_"))[1:]
    bent = materialize(placed.groupBy("gid").agg(*both).join(middles, "gid"), "rules-bent")

    def shaped(kind: str, start: int) -> DataFrame:
        # The shape of the bent values, in the units of the statistics, around the medians.
        c = {f"c_{i}_{j}": F.col(f"s{kind}_{i}_{j}") / F.col("n") / 1e6 * F.col(f"r_{i}") * F.col(f"r_{j}") + (p.floors[i] ** 2 if i == j else 0.0) for i, j in _pairs(d)}
        return _factored(bent.withColumn("start", F.lit(start)).withColumns({f"m{i}": F.col(f"q2_{i}") for i in range(d)} | c), d)

    out = materialize(reduce(DataFrame.unionByName, [first, second, shaped("u", 2), shaped("v", 3)]), "rules-starts")
    release(middles, bent)
    return out


BINS, CELLS = 16, 1 << 16


def concentrate(rows: DataFrame, est: DataFrame, p: RobustParams, d: int) -> DataFrame:
    """One step of every start: the estimate from the core nearest to the last one.

    The core ends in one bin of the distances (``BINS`` to a doubling); that one is counted again in
    ``CELLS`` cells, under a millionth of the distance each.  Documents of the last cell are all in."""
    near = with_distance(rows.join(est.drop("logdet"), "gid"), d).withColumn("bin", F.floor(F.log2(F.col("__d2") + 1) * BINS).cast("int"))
    by, z = ["gid", "start"], [F.col(f"z{i}") for i in range(d)]
    sums = ["n", *(f"s{i}" for i in range(d)), *(f"s_{i}_{j}" for i, j in _pairs(d))]
    w = W.partitionBy(*by)
    bins = near.groupBy(*by, "bin").agg(*_moments(z))
    bins = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)}).withColumn("core", F.ceil(F.col("all") * F.lit(p.core)))
    bins = materialize(bins.filter(F.col("upto") - F.col("n") < F.col("core")), "rules-bins")
    edges = bins.filter(F.col("upto") >= F.col("core")).select(*by, "bin", (F.col("upto") - F.col("n")).alias("under"), "core")
    low, high = (F.pow(F.lit(2.0), (F.col("bin") + k) / F.lit(BINS)) - 1 for k in (0, 1))
    cell = F.floor((F.col("__d2") - low) / (high - low) * CELLS)
    cells = near.join(edges, [*by, "bin"]).withColumn("cell", cell).groupBy(*by, "under", "core", "cell").agg(*_moments(z))
    cells = cells.withColumn("upto", F.col("under") + F.sum("n").over(w.orderBy("cell"))).filter(F.col("upto") - F.col("n") < F.col("core"))
    inside = bins.filter(F.col("upto") < F.col("core")).select(*by, *sums).unionByName(cells.select(*by, *sums))
    out = materialize(_estimate(inside.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums)), p, d, p.consistency), "rules-step")
    release(bins)
    return out


def _least(est: DataFrame, kept: int) -> DataFrame:
    """Of each group the starts with the least determinants."""
    place = F.row_number().over(W.partitionBy("gid").orderBy("logdet", "start"))
    return est.withColumn("place", place).filter(F.col("place") <= kept).drop("place")


def minimum_determinant(rows: DataFrame, p: RobustParams, d: int) -> DataFrame:
    """(gid, z0, ...) -> (gid, estimate): the concentrated start of least determinant."""
    est = starts(rows, p, d)

    def step(last: DataFrame) -> DataFrame:
        now = concentrate(rows, last, p, d)
        release(last)
        return now

    for _ in range(p.early):
        est = step(est)
    all_starts, est = est, materialize(_least(est, p.best), "rules-best")
    release(all_starts)
    for _ in range(p.most_steps):
        now = concentrate(rows, est, p, d)
        fell = est.select("gid", "start", F.col("logdet").alias("before")).join(now, ["gid", "start"]).agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        release(est)
        est = now
        if fell is None or fell < 1e-9:
            break
    out = materialize(_least(est, 1).drop("start"), "rules-least")
    release(est)
    return out


def group_id(count: Column, p: RobustParams) -> Column:
    """Small sources of a language are estimated together."""
    own, pooled = F.to_json(F.array("lang", "source")), F.to_json(F.array("lang"))
    return F.when(count >= p.least_group, own).otherwise(pooled)


def fit(stats: DataFrame, p: RobustParams = RobustParams()) -> DataFrame:
    """Statistics (with lang, source) -> lang, source, gid and the estimate's columns, one row per
    language and source.  A pool of small sources that is itself too small is judged by its whole language,
    a language that is too small by all documents, however few these are."""
    usable = stats.filter(~base_failed(p))
    sizes = usable.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("__n"))
    sizes = materialize(sizes.withColumn("own", group_id(F.col("__n"), p)), "rules-sizes")
    # Sources and languages are few; all windows are over their counts.
    in_pool, in_lang = F.sum("__n").over(W.partitionBy("own")), F.sum("__n").over(W.partitionBy("lang"))
    whole = F.concat(F.lit("all of "), F.to_json(F.array("lang")))
    gid = F.when(in_pool >= p.least_group, F.col("own")).when(in_lang >= p.least_group, whole).otherwise("all")
    groups = materialize(sizes.select("lang", "source", "own", whole.alias("whole"), gid.alias("gid"), "__n"), "rules-groups")
    needed = groups.select("gid").distinct()
    # A source is fitted in every group that judges some source and contains it.
    inside = groups.select("lang", "source", "__n", F.explode(F.array("own", "whole", F.lit("all"))).alias("gid")).join(needed, "gid", "left_semi")
    z = vector()
    d = len(z)
    rows = materialize(null_safe(usable.select("lang", "source", *z), inside.select("lang", "source", "gid"), ["lang", "source"]).select("gid", *(f"z{i}" for i in range(d))), "rules-vectors")
    est = minimum_determinant(rows, p, d)
    out = materialize(groups.select("lang", "source", "gid").join(est, "gid"), "rules-estimates")
    release(sizes, groups, rows, est)
    return out


def judge(stats: DataFrame, estimates: DataFrame, p: RobustParams = RobustParams()) -> DataFrame:
    """Adds base_failed, distance (null where there is no estimate or the base failed) and kept."""
    z = vector()
    rows = null_safe(stats.select("*", *z), estimates.drop("gid"), ["lang", "source"], "left").withColumn("base_failed", base_failed(p))
    rows = with_distance(rows, len(z))
    distance = F.when(~F.col("base_failed"), F.col("__d2"))
    # Every document that passes the base rule is in some group, so its distance is known.
    kept = ~F.col("base_failed") & F.coalesce(distance <= chi_squared_cutoff(p.tail, len(z)), F.lit(False))
    return rows.withColumns({"distance": distance, "kept": kept})


def quality_rules(docs: DataFrame, params: RobustParams = RobustParams()) -> DataFrame:
    """documents -> doc_id, the five base statistics, base_failed, distance, kept; one row per input row.

    A null text counts as empty and fails the base rule, as does any text under ten words.  Null
    languages and sources are values of their own.  Too small a pool is judged by its language, too
    small a language by all documents.  Repeated rows are judged alike; very long texts are counted whole; an
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    stats = materialize(with_statistics(docs.select("doc_id", "lang", "source", "text")).drop("text"), "rules-stats")
    return judge(stats, fit(stats, params), params).select("doc_id", *BASE, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, params: RobustParams = RobustParams()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    The statistics cost far more than a write of the texts, so both are written together, once."""
    own = [F.col(c).alias(f"__own_{i}") for i, c in enumerate(docs.columns)]
    stats = materialize(with_statistics(docs.select("lang", "source", "text", *own)).drop("text"), "rules-stats")
    kept = judge(stats, fit(stats, params), params).filter("kept")
    return kept.select(*(F.col(f"__own_{i}").alias(c) for i, c in enumerate(docs.columns)))
