"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Per document five transformed statistics are taken: log length, log mean word
length, log symbol rate, share of repeated lines, share of words in repeated
3-word windows. For each (language, source) a minimum-covariance-determinant
estimate is fitted by concentration steps: keep the ``h`` documents nearest in
Mahalanobis distance, refit mean and covariance on them, repeat. Documents whose
distance under the reweighted estimate exceeds a chi-square quantile are
rejected.

The cut is the quantile 1 - 1e-7: were a group's ordinary documents normal in these
statistics, one in ten million of them would go. It is set by that rule, not by labels, and
is loose on purpose, since real groups have longer tails (README: hits and misses at other
quantiles).

Everything is DataFrame expressions. Statistics are integers at 1/1024
resolution, so all sums are exact and a rerun gives the same verdicts whatever
the partitioning. A concentration step is one map-side-combined aggregation: sums
per (group, distance bin), then a running total over the bins of each group. No
group is gathered in one task, however large.

Defined results
* null or empty text: no words, ``base_failed``; null ``lang`` / ``source`` form
  groups of their own; repeated rows are judged one by one;
* a group with fewer than ``min_group`` fitted documents uses its language's
  estimate, then that of all documents; with none of them large enough nothing is
  rejected beyond the base rules;
* an empty table gives an empty table; extra columns are ignored by
  ``quality_verdicts`` and kept, with whatever names, by ``keep_good``, where rows
  that share a ``doc_id`` stay if one of them is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retailflow.llm.common import SMALL_ROWS, WHITE, WORD_GAP, forget, small_side, staged

SCALE = 1024
FEATURES = ("f0", "f1", "f2", "f3", "f4")
P = len(FEATURES)
#: Least spread of each statistic (its own units) that counts as ordinary: log
#: length, log word length, log1p of symbols per 100 words, repeated-line share,
#: repeated-window share. Added to every covariance, so constant statistics do not
#: turn any small difference into an outlier. Set by hand, not estimated: a third in length,
#: 6% in word length, from none to about one symbol per 100 words, a tenth of the lines and
#: 7% of the words repeated.
SPREAD = (0.30, 0.06, 0.60, 0.10, 0.07)
BINS_PER_OCTAVE = 16
#: Everything but the symbols that are counted.
NO_SYMBOLS = r"[^#*$%&|<>]+"


def _chi_cdf(x: float, k: int) -> float:
    """Chi-square distribution function (series of the incomplete gamma function)."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi_quantile(q: float, k: int) -> float:
    low, high = 1e-9, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_cdf(mid, k) < q else (low, mid)
    return high


def consistency(alpha: float) -> float:
    """Factor that makes the covariance of the central ``alpha`` share consistent."""
    return alpha / _chi_cdf(chi_quantile(alpha, P), P + 2)


# -- base statistics ---------------------------------------------------------


LOW = (1 << 21) - 1  # position bits of a packed window


def _word(i) -> Column:
    return F.get(F.col("_words"), i)


def _covered(positions: Column) -> Column:
    """Words covered by 3-word windows that start at the sorted positions."""
    return F.aggregate(
        positions,
        F.struct(F.lit(-9).alias("at"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(F.lit(3), x - acc["at"])).alias("n")),
        lambda acc: acc["n"],
    )


def _repeated_words(df: DataFrame) -> DataFrame:
    """Add ``_repeat``: words in 3-word windows found twice or more, first included.

    A window's hash and position are packed into one long and sorted, so repeats are
    neighbours. Neighbours are compared word by word: a hash collision shows as -2,
    and such a text (or one beyond 2^21 words) is sorted by its words instead.
    """
    n = F.size("_words")
    starts = F.slice("_words", F.lit(1), F.greatest(n - 2, F.lit(0)))
    low = F.lit(LOW).cast("long")
    packed = F.sort_array(
        F.transform(
            starts,
            lambda w, i: F.xxhash64(w, _word(i + 1), _word(i + 2))
            .bitwiseAND(F.bitwise_not(low))
            .bitwiseOR(i.cast("long")),
        )
    )
    df = df.withColumn("_packed", F.when((n >= 4) & (n <= LOW), packed))
    s = F.col("_packed")

    def alike(x, y):
        return F.coalesce(F.shiftright(x, 21) == F.shiftright(y, 21), F.lit(False))

    def spot(x):
        return x.bitwiseAND(low).cast("int")

    def same(a, b):
        return (_word(a) == _word(b)) & (_word(a + 1) == _word(b + 1)) & (_word(a + 2) == _word(b + 2))

    marks = F.transform(
        s,
        lambda x, i: F.when(
            alike(x, F.get(s, i - 1)), F.when(same(spot(x), spot(F.get(s, i - 1))), spot(x)).otherwise(-2)
        ).otherwise(F.when(alike(x, F.get(s, i + 1)), spot(x)).otherwise(-1)),
    )
    df = df.withColumn("_marks", marks)
    slow = F.sort_array(
        F.transform(
            starts, lambda w, i: F.struct(w.alias("a"), _word(i + 1).alias("b"), _word(i + 2).alias("c"), i.alias("i"))
        )
    )
    exact = (n >= 4) & (F.col("_marks").isNull() | F.array_contains("_marks", -2))
    df = df.withColumn("_slow", F.when(exact, slow))

    def equal(x, y):
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    t = F.col("_slow")
    hits = F.transform(
        t, lambda x, i: F.when(equal(x, F.get(t, i - 1)) | equal(x, F.get(t, i + 1)), x["i"]).otherwise(F.lit(-1))
    )
    places = F.when(exact, hits).otherwise(F.col("_marks"))
    repeat = F.coalesce(_covered(F.sort_array(F.filter(places, lambda x: x >= 0))), F.lit(0))
    return df.withColumn("_repeat", F.when(n >= 4, repeat).otherwise(0)).drop("_packed", "_marks", "_slow")


def base_stats(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed to
    documents with a ``text`` column, and ``_n_lines`` (lines with a word)."""
    body = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_words", F.filter(F.split(body, WORD_GAP), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: F.trim(x, F.lit(WHITE)) != ""))
    df = _repeated_words(df).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.regexp_replace(body, WORD_GAP, "")).cast("long"),
            "n_symbols": F.char_length(F.regexp_replace(body, NO_SYMBOLS, "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
            "n_repeat_words": F.col("_repeat").cast("long"),
        }
    )
    df = df.drop("_words", "_lines", "_repeat")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def transformed() -> list[Column]:
    """The statistic vector of a document, as integers at 1/SCALE resolution."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    values = (
        F.log(n.cast("double")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(100 * F.col("n_symbols") / n),
        F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
        F.col("n_repeat_words") / n,
    )
    return [F.round(v * SCALE).cast("long").alias(name) for v, name in zip(values, FEATURES)]


# -- estimation ---------------------------------------------------------------

PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _sums(names: list[str]) -> list[Column]:
    return [F.sum(x).alias(x) for x in names]


MOMENTS = ["n"] + [f"s_{i}" for i in range(P)] + [f"q_{i}{j}" for i, j in PAIRS]


def _with_moments(df: DataFrame, values: list[Column]) -> DataFrame:
    """One row's contribution to count, sums and co-moments."""
    parts = {"n": F.lit(1).cast("long")}
    parts |= {f"s_{i}": values[i] for i in range(P)}
    parts |= {f"q_{i}{j}": values[i] * values[j] for i, j in PAIRS}
    return df.withColumns(parts)


def _estimate(df: DataFrame, keys: list[str], inflate: float) -> DataFrame:
    """Moments -> mean ``m_*``, Cholesky factor ``l_*`` of the covariance, ``logdet``."""
    n = F.col("n").cast("double")
    df = df.withColumns({f"m_{i}": F.col(f"s_{i}") / n for i in range(P)})
    df = df.withColumns(
        {
            f"c_{i}{j}": F.lit(inflate) * (F.col(f"q_{i}{j}") / n - F.col(f"m_{i}") * F.col(f"m_{j}"))
            + F.lit((SPREAD[i] * SCALE) ** 2 if i == j else 0.0)
            for i, j in PAIRS
        }
    )
    for j in range(P):
        done = sum((F.col(f"l_{j}{k}") * F.col(f"l_{j}{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l_{j}{j}", F.sqrt(F.greatest(F.col(f"c_{j}{j}") - done, F.lit(1.0))))
        for i in range(j + 1, P):
            inner = sum((F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"l_{i}{j}", (F.col(f"c_{i}{j}") - inner) / F.col(f"l_{j}{j}"))
    logdet = sum((F.log(f"l_{i}{i}") for i in range(P)), F.lit(0.0))
    return df.select(*keys, *ESTIMATE, logdet.alias("logdet"))


ESTIMATE = [f"m_{i}" for i in range(P)] + [f"l_{i}{j}" for i, j in PAIRS]


def _distance(df: DataFrame) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance, by forward substitution."""
    for i in range(P):
        inner = sum((F.col(f"l_{i}{k}") * F.col(f"y_{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"y_{i}", (F.col(FEATURES[i]) - F.col(f"m_{i}") - inner) / F.col(f"l_{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(P)), F.lit(0.0)))


def _median_start(members: DataFrame) -> DataFrame:
    """Median and MAD of each statistic per group, from exact value counts."""
    counts = (
        members.select("grp", F.posexplode(F.array(*FEATURES)).alias("dim", "v"))
        .groupBy("grp", "dim", "v")
        .agg(F.sum(F.lit(1).cast("long")).alias("n"))
    )

    def middle(df, value, name):
        up_to = F.sum("n").over(W.partitionBy("grp", "dim").orderBy(value))
        whole = F.sum("n").over(W.partitionBy("grp", "dim"))
        return df.withColumn("_half", 2 * up_to >= whole).where("_half").groupBy("grp", "dim").agg(F.min(value).alias(name))

    med = middle(counts, "v", "med")
    dev = (
        counts.join(med, ["grp", "dim"])
        .groupBy("grp", "dim", F.abs(F.col("v") - F.col("med")).alias("dev"))
        .agg(F.sum("n").alias("n"))
    )
    least = F.get(F.array(*[F.lit(s * SCALE) for s in SPREAD]), F.col("dim"))
    both = med.join(middle(dev, "dev", "mad"), ["grp", "dim"]).withColumn("sd", F.greatest(1.4826 * F.col("mad"), least))

    def pick(value, i):
        return F.max(F.when(F.col("dim") == i, F.col(value).cast("double")))

    wide = both.groupBy("grp").agg(
        *[pick("med", i).alias(f"m_{i}") for i in range(P)], *[pick("sd", i).alias(f"l_{i}{i}") for i in range(P)]
    )
    return wide.select(
        "grp",
        F.lit(0).alias("start"),
        *[F.col(f"m_{i}") for i in range(P)],
        *[F.col(f"l_{i}{j}") if i == j else F.lit(0.0).alias(f"l_{i}{j}") for i, j in PAIRS],
        F.lit(0.0).alias("logdet"),
    )


def _clipped_start(members: DataFrame, medians: DataFrame) -> DataFrame:
    """Mean and covariance of values clipped at 2.5 spreads around the median."""

    def clip(i):
        reach = 2.5 * F.col(f"l_{i}{i}")
        x = F.least(F.greatest(F.col(FEATURES[i]).cast("double"), F.col(f"m_{i}") - reach), F.col(f"m_{i}") + reach)
        return F.round(x).cast("long")

    joined = _with_moments(members.join(small_side(medians), "grp"), [clip(i) for i in range(P)])
    sums = joined.groupBy("grp").agg(*_sums(MOMENTS))
    return _estimate(sums.withColumn("start", F.lit(1)), ["grp", "start"], 1.0)


def _concentrate(members: DataFrame, estimate: DataFrame, share: float) -> DataFrame:
    """One concentration step: refit on the ``share`` of each group nearest to the
    current estimate, whole distance bins at a time."""
    bins = _distance(members.join(small_side(estimate), "grp")).withColumn(
        "bin", F.floor(F.log2(F.col("d2") + 2.0**-20) * BINS_PER_OCTAVE)
    )
    bins = _with_moments(bins, [F.col(f) for f in FEATURES]).groupBy("grp", "start", "bin").agg(*_sums(MOMENTS))
    up_to = F.sum("n").over(W.partitionBy("grp", "start").orderBy("bin"))
    whole = F.sum("n").over(W.partitionBy("grp", "start"))
    near = bins.withColumn("_before", up_to - F.col("n")).withColumn("_all", whole)
    near = near.where(F.col("_before") < share * F.col("_all"))
    return _estimate(near.groupBy("grp", "start").agg(*_sums(MOMENTS)), ["grp", "start"], consistency(share))


def _groups(df: DataFrame) -> list[Column]:
    """Keys of the three nested groups of a document; nulls stay apart from texts."""
    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    return [
        F.concat(F.lit("source:"), F.to_json(F.struct(lang.alias("l"), source.alias("s")))),
        F.concat(F.lit("lang:"), F.to_json(F.struct(lang.alias("l")))),
        F.lit("all"),
    ]


def quality_verdicts(
    docs: DataFrame, share: float = 0.75, steps: int = 4, min_group: int = 50, cut: float = 1 - 1e-7
) -> DataFrame:
    """doc_id, base statistics, base_failed, kept and the squared distance ``d2``.

    ``share`` of a group carries the raw estimate, ``cut`` is the chi-square quantile
    beyond which a document is an outlier. The estimates come from all documents that
    pass the base rules.
    """
    spark = docs.sparkSession
    folders: list = []
    stats = base_stats(docs.select("doc_id", "text", "lang", "source")).drop("text")
    stats = staged(spark, stats.select("*", *transformed()).withColumn("grps", F.array(*_groups(stats))), "quality")
    good = stats.where(~F.col("base_failed"))
    sizes = good.select(F.explode("grps").alias("grp")).groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    large = staged(spark, sizes.where(F.col("size") >= min_group).select("grp"), "quality-groups", folders)
    members = good.select(F.explode("grps").alias("grp"), *FEATURES).join(small_side(large), "grp")
    medians = staged(spark, _median_start(members), "quality-start", folders)
    clipped = _clipped_start(members, medians)
    estimate = staged(spark, medians.unionByName(clipped), "quality-start", folders)
    for _ in range(steps):
        estimate = staged(spark, _concentrate(members, estimate, share), "quality-step", folders)
    # the start that ends with the smaller determinant
    best = estimate.groupBy("grp").agg(F.min_by(F.struct("start", *ESTIMATE), F.struct("logdet", "start")).alias("e"))
    best = staged(spark, best.select("grp", "e.*"), "quality-best", folders)
    # reweighting: refit on everything that is plausible under the raw estimate
    inner = _distance(members.join(small_side(best), "grp")).where(F.col("d2") <= chi_quantile(0.975, P))
    sums = _with_moments(inner, [F.col(f) for f in FEATURES]).groupBy("grp").agg(*_sums(MOMENTS))
    final = staged(spark, _estimate(sums, ["grp"], consistency(0.975)), "quality-final").drop("logdet")
    forget(spark, folders)
    # a document is judged by the narrowest of its groups that has an estimate
    few = final.count() <= SMALL_ROWS
    have = final.select("grp", F.lit(True).alias("_has"))
    for level in range(3):
        flag = have.withColumnsRenamed({"grp": "_g", "_has": f"_has{level}"})
        flag = F.broadcast(flag) if few else flag
        stats = stats.withColumn("_g", F.col("grps")[level]).join(flag, "_g", "left").drop("_g")
    judge = F.coalesce(*[F.when(F.col(f"_has{k}"), F.col("grps")[k]) for k in range(3)])
    scored = _distance(stats.withColumn("grp", judge).join(F.broadcast(final) if few else final, "grp", "left"))
    outlier = F.coalesce(F.col("d2") > chi_quantile(cut, P), F.lit(False))
    return scored.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~outlier).alias("kept"),
        "d2",
    )


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``quality_verdicts`` keeps, with all their columns."""
    good = quality_verdicts(docs, **options).where("kept").select(F.col("doc_id").alias("_good_id")).distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["_good_id"]), "left_semi")
