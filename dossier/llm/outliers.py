"""Quality rules by robust multivariate outliers (operator 9), DataFrame functions only.

A document first fails plain rules on its counts. The others are judged by a vector of transformed shares (mean word
length, symbols, capitals, punctuation). Per language, and per language and source, a minimum-covariance-determinant
estimate is made as by Rousseeuw and Van Driessen (1999): from several starts (one from coordinatewise medians and
deviations, the others from random subsets of DIMENSIONS + 1 rows) the mean and covariance are taken anew of the
``core`` share of rows nearest to the last estimate. After the first steps the start of the least determinant is taken
on, until no determinant falls any more. All starts of both kinds of groups go through a step together.

A source's estimate is drawn towards its language's by the weight of ``prior`` rows, so that small sources don't stand on
a few rows. Rejected are rows whose squared Mahalanobis distance, scaled so that its median is that of the chi-square
distribution, exceeds that distribution's quantile: ``tail`` is the share of normal rows beyond it.

Shares of short texts scatter; each share is therefore drawn towards the corpus mean by ``smooth`` characters or words
before the transformation.

All state between steps is a row per group, written to the shared folder. Defined cases: a null or empty text has zero
counts and fails the word rule; null language or source is a group of its own; a group with no row to estimate from, or
of constant statistics, rejects nothing that its language doesn't (variances have a floor); repeated rows are judged
alike; an empty table gives an empty result; other columns are passed through unless named like a result.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import beside, stored

SYMBOLS = "#*$%&|<>"
STOPS = ".,;:!?"
CAPITALS = "A-Z"
#: Median of the chi-square distribution with four degrees of freedom.
MEDIAN = 3.3567
DIMENSIONS = 4
#: Least standard deviation of a transformed statistic.
FLOOR = 0.01
FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _bind(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeated(words: Column, window: int) -> Column:
    """Words covered by windows that occur twice or more in the list."""

    def count(hashes: Column) -> Column:
        def judge(wins: Column) -> Column:
            def spread(pairs: Column) -> Column:
                alike = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
                same = F.filter(pairs, lambda x, i: alike(x, F.get(pairs, i - 1)) | alike(x, F.get(pairs, i + 1)))
                return _bind(F.array_sort(F.transform(same, lambda x: x["i"])), covered)

            def covered(places: Column) -> Column:
                steps = F.transform(places, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - p, F.lit(window))))
                return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

            ordered = F.array_sort(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0)).otherwise(_bind(ordered, spread))

        found = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, window)]))
        return F.when(F.size(hashes) < window, F.lit(0)).otherwise(_bind(F.slice(found, F.lit(1), F.size(hashes) - (window - 1)), judge))

    return _bind(F.transform(words, lambda w: F.xxhash64(w)), count)


def _only(text: Column, characters: str) -> Column:
    """The text without all other characters; a regular expression passes over whole runs of these."""
    return F.regexp_replace(text, rf"[^{characters}]+", "")


def counts(docs: DataFrame, window: int = 8) -> DataFrame:
    """docs with the plain counts of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    facts = F.struct(
        words.alias("w"), lines.alias("l"), F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"), _only(text, SYMBOLS + STOPS + CAPITALS).alias("rare")
    )

    def result(s: Column) -> Column:
        return F.struct(
            F.size(s["w"]).cast("long").alias("n_words"),
            s["word_chars"].alias("word_chars"),
            F.length(_only(s["rare"], SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
            _repeated(s["w"], window).cast("long").alias("n_repeat_words"),
            F.length(_only(s["rare"], CAPITALS)).cast("long").alias("n_caps"),
            F.length(_only(s["rare"], STOPS)).cast("long").alias("n_stops"),
        )

    return docs.select(*[c for c in docs.columns if c not in ("text", *FACTS, "n_caps", "n_stops")], F.inline(F.array(_bind(facts, result))))


def _beside(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """rows with the columns of their group (grp, _n, ..): few groups are broadcast, of many the heavy ones."""
    return rows.join(F.broadcast(groups.drop("_n")), "grp") if few else beside(rows, stored(groups), ["grp"])


MEANS = [f"m{i}" for i in range(DIMENSIONS)]
PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]
COVARIANCES = [f"c{i}{j}" for i, j in PAIRS]
FACTORS = [f"l{i}{j}" for i, j in PAIRS]
STATE = ["start", "n", *MEANS, *COVARIANCES, *FACTORS, "logdet"]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, m.., c..): mean and covariance of each group of rows, with a floor below variances."""
    x = [f"x{i}" for i in range(DIMENSIONS)]
    covariances = [f"covar_pop(x{i}, x{j})" for i, j in PAIRS]
    floored = [f"greatest({c}, {FLOOR**2!r}D) AS c{i}{j}" if i == j else f"{c} AS c{i}{j}" for c, (i, j) in zip(covariances, PAIRS, strict=True)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(m) for c, m in zip(x, MEANS, strict=True)], *map(F.expr, floored))


def _starts(rows: DataFrame, starts: int, most: int) -> tuple[DataFrame, bool]:
    """(grp, _n, some): first estimates of each group of rows (grp, x0..), and whether the groups are few."""
    x = [f"x{i}" for i in range(DIMENSIONS)]
    listed = ", ".join(x)
    drawn = {(s, k): f"r{s}_{k}" for s in range(1, starts) for k in range(DIMENSIONS + 1)}
    picked = [F.expr(f"min(struct(xxhash64({listed}, '{s} {k}') AS by, {listed})) AS {name}") for (s, k), name in drawn.items()]
    medians = stored(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"), *[F.percentile_approx(c, 0.5, 1000).alias(m) for c, m in zip(x, MEANS, strict=True)], *picked))
    few = medians.count() <= most
    spread = _beside(rows, medians.select("grp", "_n", *MEANS), few).groupBy("grp").agg(*[F.expr(f"greatest(1.4826D * percentile_approx(abs(x{i} - m{i}), 0.5, 1000), {FLOOR!r}D) AS s{i}") for i in range(DIMENSIONS)])
    plain = medians.join(spread, "grp").selectExpr("grp", "_n", "0 AS start", "_n AS n", *MEANS, *[f"s{i} * s{i} AS c{i}{j}" if i == j else f"0D AS c{i}{j}" for i, j in PAIRS])
    if not drawn:
        return _gathered(plain), few
    members = ", ".join(f"struct({s} AS start, {', '.join(f'{name}.{c} AS {c}' for c in x)})" for (s, _), name in drawn.items())
    random = _moments(medians.selectExpr("grp", "_n", f"inline(array({members}))"), ["grp", "_n", "start"])
    return _gathered(plain.unionByName(random)), few


def _factored(estimates: DataFrame) -> DataFrame:
    """estimates (m.., c..) with the Cholesky factor l.. of the covariance, floored on its diagonal, and logdet."""
    out = estimates
    for i, j in PAIRS:
        rest = " - ".join([f"c{i}{j}", *[f"l{i}{k} * l{j}{k}" for k in range(j)]])
        out = out.selectExpr("*", f"sqrt(greatest({rest}, {FLOOR**2!r}D)) AS l{i}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return out.selectExpr("*", f"2 * ({' + '.join(f'ln(l{i}{i})' for i in range(DIMENSIONS))}) AS logdet")


def _gathered(estimates: DataFrame) -> DataFrame:
    """(grp, _n, some): the factored estimates of each group as an array."""
    return _factored(estimates).groupBy("grp", "_n").agg(F.sort_array(F.collect_list(F.struct(*STATE))).alias("some"))  # a few starts


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns m (mean), l (factor of the covariance) and x."""
    steps: list[str] = []
    for i in range(DIMENSIONS):
        steps.append("((" + " - ".join([f"x{i} - m{i}", *[f"l{i}{k} * {steps[k]}" for k in range(i)]]) + f") / l{i}{i})")
    return F.expr(" + ".join(f"pow({step}, 2)" for step in steps))


def _concentrated(rows: DataFrame, state: DataFrame, core: float, few: bool) -> DataFrame:
    """(grp, _n, some): mean and covariance of the core share of rows nearest to each estimate in some, with log determinants."""
    x = [f"x{i}" for i in range(DIMENSIONS)]
    far = _beside(rows, state, few).select("grp", *x, F.inline("some"))
    edges = far.groupBy("grp", "start").agg(F.percentile_approx(_distance(), core, 1000).alias("edge"))
    edges = edges.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("start", "edge"))).alias("edges"))  # an entry per start
    near = _beside(rows, state.join(edges, "grp"), few).select("grp", *x, "edges", F.inline("some")).where(_distance() <= F.element_at("edges", F.col("start")))
    fresh = _moments(near, ["grp", "start"])
    return _gathered(fresh.join(state.select("grp", "_n"), "grp"))


def _best(state: DataFrame) -> DataFrame:
    """Of each group's estimates the one of the least determinant."""
    least = F.array_min(F.transform("some", lambda s: F.struct(s["logdet"].alias("by"), s.alias("s"))))["s"]
    return state.select("grp", "_n", F.array(least).alias("some"))


def estimate(rows: DataFrame, core: float = 0.75, starts: int = 4, first_steps: int = 2, settled: float = 0.01, most: int = 100_000) -> DataFrame:
    """(grp, n, logdet, m0.., c00..): the estimate of the least determinant for each group of rows (grp, x0..).

    All starts go through ``first_steps``; the best of each group goes on until in no group the log determinant falls by
    ``settled`` or more. Covariances are scaled so that the median of squared distances is the chi-square distribution's.
    At most ``most`` groups are broadcast whole.
    """
    state, few = _starts(rows, starts, most)
    state = stored(state)
    for _ in range(first_steps):
        state = stored(_concentrated(rows, state, core, few))
    state = stored(_best(state))
    while True:
        fresh = stored(_concentrated(rows, state, core, few))
        both = fresh.select("grp", F.get("some", 0)["logdet"].alias("now")).join(state.select("grp", F.get("some", 0)["logdet"].alias("was")), "grp")
        state, fall = fresh, both.agg(F.max(F.col("was") - F.col("now"))).first()[0]
        if fall is None or fall < settled:
            break
    best = state.select("grp", "_n", F.inline("some"))
    scale = _beside(rows, best, few).groupBy("grp").agg((F.percentile_approx(_distance(), 0.5, 1000) / MEDIAN).alias("scale"))
    return best.join(scale, "grp").select("grp", F.col("_n").alias("n"), "logdet", *MEANS, *[(F.col(c) * F.greatest("scale", F.lit(1e-3))).alias(c) for c in COVARIANCES])


def chi_square(tail: float) -> float:
    """The value that a chi-square variable with four degrees of freedom exceeds with probability tail."""
    low, high = 0.0, 2000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if math.exp(-middle / 2) * (1 + middle / 2) > tail else (low, middle)
    return high


def judge(docs: DataFrame, window: int = 8, least_words: int = 20, repeat_percent: int = 30, core: float = 0.75, starts: int = 4, prior: int = 200, smooth: float = 200.0, tail: float = 1e-9) -> DataFrame:
    """The other columns of docs with the counts, base_failed, distance (null where the base failed) and kept."""
    results = {*FACTS, "n_caps", "n_stops", "base_failed", "distance", "kept"}
    names = [c for c in docs.columns if c not in results and c != "text"]
    # Other columns travel in one struct: none can be taken for a column of the work.
    plain = docs.select(F.struct(*names).alias("row"), F.coalesce("lang", F.lit("\u0000")).alias("g1"), F.coalesce("source", F.lit("\u0000")).alias("g2"), "text")
    facts = stored(counts(plain, window)).withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))
    total = facts.where("NOT base_failed").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_caps", "n_stops")]).first()
    chars = max(1, total["word_chars"])

    def share(name: str) -> Column:
        return F.asin(F.sqrt(F.least((F.col(name) + smooth * total[name] / chars) / (F.col("word_chars") + smooth), F.lit(1.0))))

    mean = chars / max(1, total["n_words"])
    length = F.log((F.col("word_chars") + smooth * mean / 5) / (F.col("n_words") + smooth / 5))
    vectors = facts.select("*", length.alias("x0"), share("n_symbols").alias("x1"), share("n_caps").alias("x2"), share("n_stops").alias("x3"))
    sound = vectors.where("NOT base_failed").select(F.explode(F.array(F.struct("g1", F.lit(None).cast("string").alias("g2")), F.struct("g1", "g2"))).alias("grp"), *[f"x{i}" for i in range(DIMENSIONS)])
    found = stored(estimate(stored(sound), core, starts))
    wide = found.where("grp.g2 IS NULL").select("grp.g1", *[F.col(c).alias(f"w_{c}") for c in (*MEANS, *COVARIANCES)])
    mixed = found.where("grp.g2 IS NOT NULL").select("grp", "n", *MEANS, *COVARIANCES, "grp.g1").join(wide, "g1").select(
        "grp", F.col("n").alias("_n"), *[((F.col(c) * F.col("n") + F.col(f"w_{c}") * prior) / (F.col("n") + prior)).alias(c) for c in (*MEANS, *COVARIANCES)]
    )
    mixed = stored(_factored(mixed))
    # Every row that has a distance has a group; the others need none.
    judged = _beside(vectors.where("NOT base_failed").withColumn("grp", F.struct("g1", "g2")), mixed, mixed.count() <= 100_000).withColumn("distance", _distance())
    columns = ["row.*", *FACTS, "base_failed"]
    passed = judged.select(*columns, "distance", (F.col("distance") <= chi_square(tail)).alias("kept"))
    return passed.unionAll(facts.where("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))
