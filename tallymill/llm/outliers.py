"""Robust multivariate outliers of document statistics, in DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import BLANKS, stored, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Keys over which the rows of a group are spread in joins.
SALTS = 32


#: All starts take the first steps; then the best of each group go on until they rest.
TRIAL = 2
FINALISTS = 2


@dataclass(frozen=True)
class Rule:
    """share: the part of a group's vectors that the estimate rests on. steps: an estimate rests when a step lowers its
    determinant by no more than settled (in logarithms), after so many steps at the latest. fit_rows: a group of fewer rows joins the pool
    of small groups of its language, then of all. floor: least standard deviation of each transformed statistic, as a part of
    its pooled spread (mean distance from the group's middle, over all groups), so that one that hardly varies in a group
    does not turn a trace of it into an outlier; least: its value where nothing varies anywhere. At the least floors a text
    fails for 2.3 % symbols among its characters, or repeated lines or words of 9 %, alone.
    distance: Mahalanobis distance above which a document goes; 5 leaves out 1.4 of 10,000 under a normal distribution."""

    share: float = 0.75
    steps: int = 25
    settled: float = 1e-2
    fit_rows: int = 60
    floor: float = 0.5
    least: tuple[float, ...] = (0.25, 0.06, 0.03, 0.06, 0.06)
    distance: float = 5.0


def statistics(docs: DataFrame) -> DataFrame:
    """lang, source, doc_id and, of every whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id",
        "lang",
        "source",
        text.alias("_text"),
        F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("_w"),
    )
    n = F.size("_w")
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_text", "\n", -1), lambda s: F.length(F.translate(s, BLANKS, "")) > 0)
    shaped = base.select(
        "doc_id",
        "lang",
        "source",
        n.cast("long").alias("n_words"),
        F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        windows.alias("_windows"),
    )
    # Places of the windows whose hash another window of the text has: neighbours in the sorted list of (hash, place).
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twin = F.transform(
        F.filter(
            F.transform(
                "_sorted",
                lambda x, k: F.struct(
                    x["i"].alias("i"),
                    (
                        F.coalesce(F.get("_sorted", k - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get("_sorted", k + 1)["h"] == x["h"], F.lit(False))
                    ).alias("twin"),
                ),
            ),
            lambda x: x["twin"],
        ),
        lambda x: x["i"],
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    sorted_ = shaped.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, placed).alias("_sorted"),
    )
    places = sorted_.withColumn("_at", F.when(F.col("_sorted").isNotNull(), F.sort_array(twin)))
    covered = F.aggregate(
        F.transform("_at", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - i, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda s, x: s + x,
    )
    return places.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_sorted", "_at")


def vector() -> list[Column]:
    """The transformed statistics: length, word length, and square roots of the shares of symbols, repeated lines and
    repeated words, which are near zero in most texts."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n + 1),
        F.log((F.col("word_chars") + 1) / n),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double")),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def _estimates(rows: DataFrame, xs: list[str], floors: tuple[float, ...]) -> DataFrame:
    """Mean, and Cholesky factor of the covariance, of each group and start: columns m0.. and l00, l10, l11, ...

    One aggregation of plain sums, so that partial aggregation reduces a hot group before the exchange."""
    return _factored(rows.groupBy("_group", "_start").agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)],
        *[F.covar_pop(xs[i], xs[j]).alias(f"c{j}{i}") for i, j in combinations_with_replacement(range(len(xs)), 2)],
    ), floors)


def _factored(got: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """The Cholesky factors of covariances c00, c10, c11, ... with the squared floors added to the variances."""
    p = len(floors)
    for i in range(p):
        got = got.withColumn(f"c{i}{i}", F.greatest(F.col(f"c{i}{i}"), F.lit(0.0)) + F.lit(floors[i] ** 2))
    for j in range(p):
        diagonal = F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        got = got.withColumn(f"l{j}{j}", F.sqrt(F.greatest(diagonal, F.lit(1e-12))))
        below = {
            f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0)))
            / F.col(f"l{j}{j}")
            for i in range(j + 1, p)
        }
        got = got.withColumns(below) if below else got
    return got.select("_group", "_start", *_columns(p))


def _concentrated(rows: DataFrame, fit: DataFrame, xs: list[str], floors: tuple[float, ...], share: float) -> DataFrame:
    """One step: the estimate that rests on the share of each group's rows that lie nearest under fit.

    One pass over the rows: each bin of distances adds up its rows' moments about the mean of fit, and those of the bins up to the edge
    are added together. What is exchanged grows with groups and bins, not with rows."""
    p = len(xs)
    pairs = list(combinations_with_replacement(range(p), 2))
    off = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(xs)]
    binned = _distances(rows, fit, xs, ["_group", "_start", *[u.alias(f"u{i}") for i, u in enumerate(off)]])
    sums = [f"s{i}" for i in range(p)] + [f"s{j}{i}" for i, j in pairs]
    bins = binned.groupBy("_group", "_start", "_bin").agg(
        F.count("*").alias("_n"),
        *[F.sum(f"u{i}").alias(f"s{i}") for i in range(p)],
        *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"s{j}{i}") for i, j in pairs],
    )
    group = Window.partitionBy("_group", "_start")
    inner = bins.withColumns(
        {"_below": F.sum("_n").over(group.orderBy("_bin")), "_all": F.sum("_n").over(group)}
    ).filter(F.col("_below") - F.col("_n") < share * F.col("_all"))
    moments = inner.groupBy("_group", "_start").agg(
        F.sum("_n").cast("double").alias("_n"), *[F.sum(s).alias(s) for s in sums]
    )
    mean = [F.col(f"s{i}") / F.col("_n") for i in range(p)]
    got = moments.join(fit.select("_group", "_start", *[F.col(f"m{i}").alias(f"o{i}") for i in range(p)]), ["_group", "_start"])
    return _factored(
        got.select(
            "_group",
            "_start",
            *[(F.col(f"o{i}") + mean[i]).alias(f"m{i}") for i in range(p)],
            *[(F.col(f"s{j}{i}") / F.col("_n") - mean[i] * mean[j]).alias(f"c{j}{i}") for i, j in pairs],
        ),
        floors,
    )


def _columns(p: int) -> list[str]:
    return [*(f"m{i}" for i in range(p)), *(f"l{i}{j}" for i in range(p) for j in range(i + 1))]


def _log_determinant(p: int) -> Column:
    return sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(p)), F.lit(0.0))


def _middle(judged: DataFrame, xs: list[str]) -> DataFrame:
    """q0.. (middle) and r0.. (spread by quartiles) of each statistic, by group."""
    got = judged.groupBy("_group").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i, x in enumerate(xs)])
    return got.select(
        "_group",
        *[F.col(f"p{i}")[1].alias(f"q{i}") for i in range(len(xs))],
        *[((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349).alias(f"r{i}") for i in range(len(xs))],
    )


def _floors(judged: DataFrame, middle: DataFrame, xs: list[str], rule: Rule) -> tuple[float, ...]:
    """Floors of the standard deviations: one row of numbers over all groups."""
    spread = _attach(judged, middle).agg(*[F.avg(F.abs(F.col(x) - F.col(f"q{i}"))) for i, x in enumerate(xs)]).first()
    return tuple(max(least, rule.floor * 1.2533 * (found or 0.0)) for least, found in zip(rule.least, spread))


def _starts(judged: DataFrame, middle: DataFrame, xs: list[str], floors: tuple[float, ...]) -> DataFrame:
    """Estimates to start from, by group and _start: 0 middle and spread of each statistic by itself; 1 covariance of the
    standardised statistics squeezed by tanh; 2 covariance of their directions; 3 mean and covariance of an eighth of the rows."""
    p = len(xs)
    middle = middle.withColumns({f"r{i}": F.greatest(F.col(f"r{i}"), F.lit(floors[i])) for i in range(p)})
    alone = middle.select(
        "_group",
        F.lit(0).alias("_start"),
        *[F.col(f"q{i}").alias(f"m{i}") for i in range(p)],
        *[(F.col(f"r{i}") if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(p) for j in range(i + 1)],
    )
    rows = _attach(judged, middle).withColumns({f"z{i}": (F.col(x) - F.col(f"q{i}")) / F.col(f"r{i}") for i, x in enumerate(xs)})
    rows = rows.withColumn("_length", F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)), F.lit(0.0))), F.lit(1e-9)))
    ys = [f"y{i}" for i in range(p)]
    kinds = [
        F.struct(F.lit(1).alias("_start"), *[F.tanh(f"z{i}").alias(y) for i, y in enumerate(ys)]),
        F.struct(F.lit(2).alias("_start"), *[(F.col(f"z{i}") / F.col("_length")).alias(y) for i, y in enumerate(ys)]),
        F.when(F.col("_salt") < SALTS // 8, F.struct(F.lit(3).alias("_start"), *[F.col(f"z{i}").alias(y) for i, y in enumerate(ys)])),
    ]
    spread = rows.select("_group", F.explode(F.array_compact(F.array(*kinds))).alias("_y")).select("_group", "_y.*")
    other = _estimates(spread, ys, (0.1,) * p).join(middle, "_group")
    # back to the units of the statistics
    other = other.select(
        "_group",
        "_start",
        *[F.when(F.col("_start") == 3, F.col(f"q{i}") + F.col(f"m{i}") * F.col(f"r{i}")).otherwise(F.col(f"q{i}")).alias(f"m{i}") for i in range(p)],
        *[(F.col(f"l{i}{j}") * F.col(f"r{i}")).alias(f"l{i}{j}") for i in range(p) for j in range(i + 1)],
    )
    return alone.unionByName(other)


def _edges(near: DataFrame, share: float) -> DataFrame:
    """The bin of distances at which the share of a group's rows is reached, by group and start."""
    group = Window.partitionBy("_group", "_start")
    return (
        near.groupBy("_group", "_start", "_bin")
        .agg(F.count("*").alias("_n"))
        .select(
            "_group",
            "_start",
            "_bin",
            F.sum("_n").over(group.orderBy("_bin")).alias("_below"),
            F.sum("_n").over(group).alias("_all"),
        )
        .filter(F.col("_below") >= share * F.col("_all"))
        .groupBy("_group", "_start")
        .agg(F.min("_bin").alias("_edge"))
    )


def _least(judged: DataFrame, xs: list[str], rule: Rule) -> DataFrame:
    """The estimate of least determinant of each group."""
    p = len(xs)
    middle = stored(_middle(judged, xs), "middle")
    floors = _floors(judged, middle, xs, rule)
    moving, rested = stored(_starts(judged, middle, xs, floors), "fit"), []
    determinant = _log_determinant(p).alias("_determinant")
    for step in range(rule.steps):
        before = moving.select("_group", "_start", determinant.alias("_before"))
        new = _concentrated(judged, moving, xs, floors, rule.share).withColumn("_determinant", determinant)
        new = new.join(before, ["_group", "_start"])
        if step + 1 == TRIAL:
            place = F.row_number().over(Window.partitionBy("_group").orderBy("_determinant", "_start"))
            new = new.withColumn("_place", place).filter(F.col("_place") <= FINALISTS).drop("_place")
        falls = (F.col("_determinant") < F.col("_before") - rule.settled) if step else F.lit(True)
        new = stored(new.withColumn("_falls", falls).drop("_before", "_determinant"), "fit")
        if step + 1 >= TRIAL:
            rested.append(new.filter("not _falls").drop("_falls"))
            new = new.filter("_falls")
        moving = new.drop("_falls")
        if moving.isEmpty():
            break
    fit = reduce(DataFrame.unionByName, rested, moving)
    best = F.min(F.struct(_log_determinant(p).alias("_determinant"), "_start", *_columns(p))).alias("_best")
    return stored(fit.groupBy("_group").agg(best).select("_group", "_best.*").drop("_determinant"), "fit")


def _squared(p: int, xs: list[str]) -> list[tuple[str, Column]]:
    """Columns, one after the other, that end in the squared Mahalanobis distance _d: forward substitution."""
    steps = []
    for i in range(p):
        rest = sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        steps.append((f"z{i}", (F.col(xs[i]) - F.col(f"m{i}") - rest) / F.col(f"l{i}{i}")))
    steps.append(("_d", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)), F.lit(0.0))))
    return steps


def _attach(rows: DataFrame, groups: DataFrame, *more: str) -> DataFrame:
    """Rows with the values of their group. Rows carry a salt, and a group's values are there once for each, so that a hot
    group is dealt to many tasks."""
    return rows.join(groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_group", *more, "_salt"])


def _distances(rows: DataFrame, fit: DataFrame, xs: list[str], keep: list[str | Column]) -> DataFrame:
    """Rows, once for each start, with their squared distance _d and its _bin."""
    got = _attach(rows, fit)
    for name, value in _squared(len(xs), xs):
        got = got.withColumn(name, value)
    return got.select(*keep, "_d", F.floor(F.log2(F.col("_d") + 2.0**-16) * 32).cast("int").alias("_bin"))


def reject(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, distance (Mahalanobis; null if base_failed) and kept.

    Minimum covariance determinant by concentration: groups are (lang, source); each step fits mean and covariance to
    the share of a group's vectors that lie nearest under the step before. Each group is fitted from four starts, the two of
    lesser determinant after two steps go on until they rest, and the estimate of least determinant counts. The boundary of the share is found in a histogram
    of distances, so no group is ever gathered. The covariance is scaled so that the share's own boundary is where a normal
    distribution of 5 statistics has it. Documents that fail the base rule take no part in the fit. Null lang and source are values of
    their own. A null text has no words and fails. Rows that repeat are judged each by itself. An empty table gives an
    empty one; other columns are left out.
    """
    xs = [f"x{i}" for i in range(len(rule.least))]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    every = stored(statistics(docs).withColumn("base_failed", failed), "statistics")
    names = [*every.columns]
    judged = every.filter(~F.col("base_failed")).withColumns(dict(zip(xs, vector())))
    # Small groups are pooled: (lang, source), else (lang), else all.
    size = judged.groupBy("lang", "source").agg(F.count("*").alias("_n"))
    by_lang = Window.partitionBy("lang")
    small = F.sum(F.when(F.col("_n") < rule.fit_rows, F.col("_n")).otherwise(0)).over(by_lang)
    value = [F.coalesce(F.concat(F.lit("="), c), F.lit("null")) for c in ("lang", "source")]
    named = size.withColumn("_small", small).select(
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
        F.when(F.col("_n") >= rule.fit_rows, F.to_json(F.array(*value)))
        .when(F.col("_small") >= rule.fit_rows, F.to_json(F.array(value[0])))
        .otherwise("[]")
        .alias("_group"),
    )
    judged = stored(
        judged.join(named, judged["lang"].eqNullSafe(named["_lang"]) & judged["source"].eqNullSafe(named["_source"]))
        .drop("_lang", "_source")
        .withColumn("_salt", F.pmod(F.xxhash64("doc_id", *xs), F.lit(SALTS)).cast("int")),
        "vectors",
    )
    far = _distances(judged, _least(judged, xs, rule), xs, ["_group", "_start", "_salt", *names])
    edge = _edges(far, rule.share)
    # Three quarters of a chi-square with 5 degrees of freedom lie below 6.626.
    scale = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("_edge") + 1) / 32) / 6.626)
    scored = _attach(far, edge, "_start").select(*names, F.sqrt(F.col("_d") / scale).alias("distance"))
    out = scored.unionByName(every.filter("base_failed").withColumn("distance", F.lit(None).cast("double")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= rule.distance))
