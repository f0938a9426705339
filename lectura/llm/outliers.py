"""Quality rules: base rules, then robust multivariate outliers, with DataFrame functions only.

Each document has counts (words, their characters, symbols, repeated lines, words in repeated 3-word windows). The base
rules come first. The rest is judged by the minimum covariance determinant of its language and source, over vectors of
five transformed statistics:

1. Three starts for each group share its medians and absolute deviations and differ by their correlations: none, those
   of the vectors' hyperbolic tangents, those of their directions from the median.
2. A concentration step takes mean and covariance of the `CORE` share of a group's vectors that lie nearest by the last
   estimate. From each start `TRIED` steps are done; the one of least determinant goes on, group by group, until a step
   lowers no group's log determinant by more than `SETTLED`, or `STEPS` are done.
3. The covariance is made consistent by the median distance, and one step more over all that lie within the usual bound
   reweights it. Documents beyond `CUTOFF` in squared Mahalanobis distance are rejected.

Most documents have no symbols or repeats at all, so covariances would be singular; the determinant that is made least
is that of a regularised covariance, and no switch depends on a group's size:

- of a language, the covariance plus squared `FLOORS`, these times 1 + `PRIOR` / n for n documents, so that a language
  of few rejects little and one of a single document nothing;
- of a source, the mean of its covariance with floors, weighted by its documents, and its language's final estimate,
  weighted by `PRIOR`. The final centre is the same mean of both centres.

Medians and shares come from counts in fine bins, so no group is ever gathered, and every aggregate is combined before it
is shuffled. Of the bin in which the share ends, all vectors count by the part of the bin that is needed, so that every
core weighs `CORE` times its group and determinants can be compared.

Defined results: null and empty texts have no words and fail the base rules; null languages and sources are groups of
their own; texts are counted whole; repeated rows get equal results; empty tables give no rows; an input column named
like an output is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, cut

CORE, TRIED, STEPS, SETTLED, PRIOR = 0.75, 2, 12, 0.01, 20
#: Squared distance that about one in 10^9 vectors of a normal distribution with five dimensions exceeds; the bound for
#: reweighting is passed by one in 40, and half of them lie within the median.
CUTOFF, USUAL, MEDIAN = 50.2, 12.83, 4.351
#: Words that a text must have, and the percentage of its words that may stand in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
FEATURES = ("x_words", "x_length", "x_symbols", "x_lines", "x_repeats")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Least standard deviation of each statistic.
FLOORS = (0.5, 0.08, 0.04, 0.1, 0.1)
#: Up to this many groups have their estimates sent to all executors; those of more are joined by shuffling.
BROADCAST_GROUPS = 100_000
#: Bins to one of a statistic, and to a factor of e of a squared distance.
FINE, FINE_DISTANCE = 100, 32
DIMENSIONS = range(len(FEATURES))
TRIANGLE = [(i, j) for i in DIMENSIONS for j in range(i + 1)]
Small = Callable[[DataFrame], DataFrame]
SPACE = r"[\x20\x09-\x0D]+"


def _repeated(words: Column) -> Column:
    """Words in windows of three that are found twice or more."""

    def covered(places: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(places) - 1), lambda k: F.least(F.lit(3), places[k] - places[k - 1]))
        return F.when(F.size(places) < 2, F.size(places) * 3).otherwise(F.aggregate(gaps, F.lit(3), lambda s, g: s + g))

    def marked(ordered: Column) -> Column:
        again = F.filter(ordered, lambda s, k: ((k > 0) & (F.get(ordered, k - 1)["h"] == s["h"])) | ((k + 1 < F.size(ordered)) & (F.get(ordered, k + 1)["h"] == s["h"])))
        return bind(F.sort_array(F.transform(again, lambda s: s["i"])), covered)

    def counted(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bind(ordered, marked)).otherwise(F.lit(0))

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(bind(hashes, counted))

    return bind(words, windows)


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = df.withColumn("__words", F.filter(F.split(whole, SPACE), lambda w: w != ""))
    found = found.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": _repeated(F.col("__words")).cast("long"),
        }
    ).drop("__words")
    return found.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _vector(df: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns(
        {
            "x_words": F.log1p("n_words"),
            "x_length": F.log((F.col("word_chars") + 1) / (words + 1)),
            "x_symbols": F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 1)),
            "x_lines": F.sqrt(F.col("n_dup_lines") / words),
            "x_repeats": F.sqrt(F.col("n_repeat_words") / words),
        }
    )


def _quantile(rows: DataFrame, keys: list[str], bin_: str, share: float) -> DataFrame:
    """For each group the bin in which the share of its rows ends (`__most`), and which part of that bin is needed."""
    counted = rows.groupBy(*keys, bin_).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*keys)  # groups have few bins, whatever their rows
    running = counted.withColumns({"__need": share * F.sum("__n").over(whole), "__to": F.sum("__n").over(whole.orderBy(bin_))})
    ends = running.filter((F.col("__to") >= F.col("__need")) & (F.col("__to") - F.col("__n") < F.col("__need")))
    return ends.select(*keys, F.col(bin_).alias("__most"), ((F.col("__need") - F.col("__to")) / F.col("__n") + 1).alias("__part"))


def _factored(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, means (m), covariances (c), their Cholesky factor (l) and log determinant of a frame of keys, m and c."""
    for i in DIMENSIONS:
        for j in range(i + 1):
            value = F.col(f"c{i}{j}")
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            found = found.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l{j}{j}"))
    log = sum((F.log(f"l{i}{i}") for i in DIMENSIONS[1:]), F.log("l00"))
    return found.select(*keys, *(f"m{i}" for i in DIMENSIONS), *(f"c{i}{j}" for i, j in TRIANGLE), *(f"l{i}{j}" for i, j in TRIANGLE), (2 * log).alias("log_det"))


def _starts(rows: DataFrame, small: Small) -> DataFrame:
    """Three estimates for each group around its medians."""
    key = ["__key"]
    each = rows.select(*key, F.posexplode(F.array(*FEATURES)).alias("__k", "__x"))
    middle = cut(_quantile(each.withColumn("__b", F.floor(F.col("__x") * FINE)), [*key, "__k"], "__b", 0.5).select(*key, "__k", ((F.col("__most") + 0.5) / FINE).alias("__m")))
    away = each.join(small(middle), [*key, "__k"]).withColumn("__b", F.floor(F.abs(F.col("__x") - F.col("__m")) * FINE))
    both = middle.join(_quantile(away, [*key, "__k"], "__b", 0.5), [*key, "__k"])
    pick = lambda i, x, name: F.max(F.when(F.col("__k") == i, x)).alias(f"{name}{i}")
    spread = [F.greatest(1.4826 * F.col("__most") / FINE, F.lit(floor)) for floor in FLOORS]
    center = cut(both.groupBy(*key).agg(*(pick(i, F.col("__m"), "m") for i in DIMENSIONS), *(pick(i, spread[i], "s") for i in DIMENSIONS)))
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}") for i, x in enumerate(FEATURES)]
    length = F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0]))
    found = rows.join(small(center), "__key").select(*key, *(x.alias(f"z{i}") for i, x in enumerate(z)), length.alias("__length"))
    unit = lambda i: F.when(F.col("__length") > 0, F.col(f"z{i}") / F.col("__length")).otherwise(0.0)
    sums = [F.covar_pop(F.tanh(f"z{i}"), F.tanh(f"z{j}")).alias(f"t{i}{j}") for i, j in TRIANGLE] + [F.sum(unit(i) * unit(j)).alias(f"u{i}{j}") for i, j in TRIANGLE]
    found = found.groupBy(*key).agg(*sums).join(center, "__key").withColumn("__start", F.explode(F.array(*map(F.lit, range(3)))))

    def covariance(i: int, j: int) -> Column:
        if i == j:
            return F.col(f"s{i}") ** 2 + FLOORS[i] ** 2
        across = lambda x: F.sqrt(F.col(f"{x}{i}{i}") * F.col(f"{x}{j}{j}"))
        alike = F.when(F.col("__start") == 0, 0.0)
        for k, x in ((1, "t"), (2, "u")):
            alike = alike.when((F.col("__start") == k) & (across(x) > 0), F.col(f"{x}{i}{j}") / across(x))
        return alike.otherwise(0.0) * F.col(f"s{i}") * F.col(f"s{j}")

    return _factored(found.select(*key, "__start", *(f"m{i}" for i in DIMENSIONS), *(covariance(i, j).alias(f"c{i}{j}") for i, j in TRIANGLE)), [*key, "__start"])


def _moments(rows: DataFrame, keys: list[str], priors: DataFrame, scale: Column | None = None) -> DataFrame:
    """The estimate of each group of rows with a weight (`__w`) and a point near its mean (m).

    With `scale` (of a group) the covariance is multiplied by it, and the centre is drawn to that of the prior.
    """
    away = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(FEATURES)]
    sums = [F.sum("__w").alias("w")] + [F.first(f"m{i}").alias(f"b{i}") for i in DIMENSIONS] + [(F.sum(F.col("__w") * away[i]) / F.sum("__w")).alias(f"d{i}") for i in DIMENSIONS]
    sums += [(F.sum(F.col("__w") * away[i] * away[j]) / F.sum("__w")).alias(f"q{i}{j}") for i, j in TRIANGLE]
    if scale is not None:
        sums.append(F.first(scale).alias("__scale"))
    found = rows.groupBy(*keys).agg(*sums).join(priors, "__key")
    w, prior = F.col("w"), F.col("p_weight")

    def covariance(i: int, j: int) -> Column:
        value = F.col(f"q{i}{j}") - F.col(f"d{i}") * F.col(f"d{j}")
        value = value if scale is None else value * F.col("__scale")
        value = value + F.col("p_floors") * FLOORS[i] ** 2 if i == j else value
        return (w * value + prior * F.col(f"pc{i}{j}")) / (w + prior)

    def center(i: int) -> Column:
        value = F.col(f"b{i}") + F.col(f"d{i}")
        return value if scale is None else (w * value + prior * F.col(f"pm{i}")) / (w + prior)

    return _factored(found.select(*keys, *(center(i).alias(f"m{i}") for i in DIMENSIONS), *(covariance(i, j).alias(f"c{i}{j}") for i, j in TRIANGLE)), keys)


def _distance(rows: DataFrame, shape: DataFrame, *more: str) -> DataFrame:
    """rows with `d2`, the squared Mahalanobis distance by their group's estimate, and `more` columns of that."""
    found = rows.join(shape, "__key")  # `shape` comes with its broadcast hint if it is small
    for i, x in enumerate(FEATURES):
        value = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            value = value - F.col(f"l{i}{j}") * F.col(f"y{j}")
        found = found.withColumn(f"y{i}", value / F.col(f"l{i}{i}"))
    total = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in DIMENSIONS[1:]), F.col("y0") * F.col("y0"))
    return found.withColumn("d2", total).select(*rows.columns, *more, "d2")


def _estimates(rows: DataFrame, priors: DataFrame, small: Small) -> DataFrame:
    """The final estimate of each group (`__key`) of vectors."""
    centers = [f"m{i}" for i in DIMENSIONS]
    fine = F.floor(F.log(F.col("d2") + 1e-9) * FINE_DISTANCE)

    def step(shape: DataFrame, keys: list[str]) -> DataFrame:
        near = _distance(rows, small(shape), *keys[1:], *centers).withColumn("__b", fine)
        core = near.join(small(_quantile(near, keys, "__b", CORE)), keys).filter("__b <= __most")
        return _moments(core.withColumn("__w", F.when(F.col("__b") < F.col("__most"), 1.0).otherwise(F.col("__part"))), keys, small(priors))

    shape = cut(_starts(rows, small))
    for _ in range(TRIED):
        shape = cut(step(shape, ["__key", "__start"]))
    names = [c for c in shape.columns if c not in ("__key", "__start")]
    least = F.min_by(F.struct(*names), F.struct("log_det", "__start")).alias("best")
    shape = cut(shape.groupBy("__key").agg(least).select("__key", "best.*"))
    for _ in range(STEPS):
        moved = step(shape, ["__key"]).withColumn("__after", F.lit(1))
        either = shape.withColumn("__after", F.lit(0)).unionByName(moved)
        chosen = either.groupBy("__key").agg(F.min_by(F.struct(*names), F.struct("log_det", "__after")).alias("best"), (F.max(F.when(F.col("__after") == 0, F.col("log_det"))) - F.min("log_det")).alias("__fall"))
        chosen = cut(chosen.select("__key", "best.*", "__fall"))
        shape = chosen.drop("__fall")
        if chosen.filter(F.col("__fall") > SETTLED).isEmpty():
            break
    near = _distance(rows, small(shape), *centers).withColumn("__b", fine)
    middle = _quantile(near, ["__key"], "__b", 0.5)
    scale = F.greatest(F.exp((F.col("__most") + 0.5) / FINE_DISTANCE) / MEDIAN, F.lit(1.0))
    usual = near.join(small(middle), "__key").withColumns({"__scale": scale, "__w": F.lit(1.0)}).filter(F.col("d2") <= USUAL * F.col("__scale"))
    return cut(_moments(usual, ["__key"], small(priors), F.col("__scale")))


def reject_outliers(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF, prior: float = PRIOR) -> DataFrame:
    """Adds the counts of `base_counts`, d2 (null for failures of the base rules), kept."""
    counts = base_counts(df.drop("d2", "kept"), text)
    # what the input holds is packed away, so that no name of a step meets one of its columns
    packed = F.struct(*(c for c in counts.columns if c != text)).alias("__in")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (lang, source)]
    rows = counts.select(packed, F.xxhash64(named[0]).alias("__lang"), F.xxhash64(*named).alias("__key"), "base_failed", *COUNTS)
    rows = cut(_vector(rows).drop(*COUNTS))
    passed = rows.filter(~F.col("base_failed"))
    sizes = cut(passed.groupBy("__lang", "__key").agg(F.count(F.lit(1)).alias("n")))
    small = F.broadcast if sizes.count() <= BROADCAST_GROUPS else (lambda x: x)
    nothing = [F.lit(0.0).alias(f"pm{i}") for i in DIMENSIONS] + [F.lit(0.0).alias(f"pc{i}{j}") for i, j in TRIANGLE]
    alone = sizes.groupBy(F.col("__lang").alias("__key")).agg((1 + prior / F.sum("n")).alias("p_floors")).select("__key", "p_floors", F.lit(0.0).alias("p_weight"), *nothing)
    whole = _estimates(passed.select(F.col("__lang").alias("__key"), *FEATURES), cut(alone), small)
    known = [F.col(f"m{i}").alias(f"pm{i}") for i in DIMENSIONS] + [F.col(f"c{i}{j}").alias(f"pc{i}{j}") for i, j in TRIANGLE]
    drawn = sizes.join(whole.withColumnRenamed("__key", "__lang"), "__lang").select("__key", F.lit(1.0).alias("p_floors"), F.lit(float(prior)).alias("p_weight"), *known)
    shape = _estimates(passed.select("__key", *FEATURES), cut(drawn), small)
    out = _distance(passed, small(shape)).unionByName(rows.filter("base_failed").withColumn("d2", F.lit(None).cast("double")))
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("d2") > cutoff, F.lit(False))
    return out.select("__in.*", "d2", kept.alias("kept"))
