"""Label vocabulary: writings, similarity, look-alikes, rules and consolidation (VOC1-VOC15, JN11, PIP17)."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from dossier.functions.labels import distinct_labels, kind_rank
from dossier.functions.text import fold, fold_plain

#: By kind, the similarity at which labels are merged and at which a merge is suggested (VOC12).
THRESHOLDS = {"sender": (1.0, 0.85), "party": (1.0, 0.9), "topic": (0.96, 0.94), "object": (1.0, 0.9), "reference": (1.0, 1.0), "jurisdiction": (0.96, 0.85)}


def comparison_key(value: str) -> tuple[list[str], str, str, str]:
    """VOC1: numbers, all digits, letters and digits alone, and words sorted between those with a digit.

    Spaces between digits don't part a number; other signs do.
    """
    whole = re.sub(r"(?<=\d)\s+(?=\d)", "", fold_plain(value))
    words = re.findall(r"[^\W_]+", whole)
    out: list[str] = []
    run: list[str] = []
    for word in words:
        if any(c.isdigit() for c in word):
            out += [*sorted(run), word]
            run = []
        else:
            run.append(word)
    out += sorted(run)
    numbers = re.findall(r"\d+", whole)
    return numbers, "".join(numbers), "".join(words), " ".join(out)


def keys_of(value: Column | str) -> Column:
    """VOC1 as struct<numbers, digits, joined, sorted> in native expressions; a null value counts as empty."""
    column = F.col(value) if isinstance(value, str) else value
    whole = F.regexp_replace(fold(F.coalesce(column, F.lit(""))), r"(?<=\d)\s+(?=\d)", "")
    words = F.regexp_extract_all(whole, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    numbers = F.regexp_extract_all(whole, F.lit(r"(\d+)"), F.lit(1))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("run"))

    def add(state: Column, word: Column) -> Column:
        fixed = F.struct(F.concat(state["out"], F.sort_array(state["run"]), F.array(word)).alias("out"), none.alias("run"))
        return F.when(word.rlike(r"\d"), fixed).otherwise(F.struct(state["out"].alias("out"), F.concat(state["run"], F.array(word)).alias("run")))

    ordered = F.aggregate(words, start, add, lambda s: F.array_join(F.concat(s["out"], F.sort_array(s["run"])), " "))
    return F.struct(numbers.alias("numbers"), F.array_join(numbers, "").alias("digits"), F.array_join(words, "").alias("joined"), ordered.alias("sorted"))


def key_literal(value: str) -> Column:
    """The key of a value at hand."""
    numbers, digits, joined, ordered = comparison_key(value)
    return F.struct(F.array(*map(F.lit, numbers)).cast("array<string>").alias("numbers"), F.lit(digits).alias("digits"), F.lit(joined).alias("joined"), F.lit(ordered).alias("sorted"))


def same_writing(a: Column, b: Column) -> Column:
    """VOC2 on keys."""
    return (a["numbers"] == b["numbers"]) & ((a["joined"] == b["joined"]) | (a["sorted"] == b["sorted"]))


def regrouping(a: Column, b: Column) -> Column:
    """VOC3: the same digits cut into numbers at places of which one's include the other's."""

    def ends(k: Column) -> Column:
        sizes = F.transform(k["numbers"], lambda x: F.length(x))
        return F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x))

    within = (F.size(F.array_except(ends(a), ends(b))) == 0) | (F.size(F.array_except(ends(b), ends(a))) == 0)
    return (a["digits"] == b["digits"]) & (a["digits"] != "") & (a["numbers"] != b["numbers"]) & within


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(matched, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """VOC5: the bonus for up to four equal first characters always counts."""
    j = jaro(a, b)
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return j + same * 0.1 * (1 - j)


@F.pandas_udf(DoubleType())
def winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)])


def similarity(a: Column, b: Column) -> Column:
    """VOC4 on keys: 0 if numbers differ, 1 for one writing, else Jaro-Winkler of the sorted words."""
    return F.when(a["numbers"] != b["numbers"], 0.0).when(same_writing(a, b), 1.0).otherwise(winkler(a["sorted"], b["sorted"]))


def most_possible(a: Column, b: Column) -> Column:
    """VOC7: no pair of such lengths is more alike."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    j = (2 + short / long) / 3
    return F.when(long == 0, 1.0).otherwise(j + 0.4 * (1 - j))


def _bars(thresholds: dict[str, tuple[float, float]], place: int, other: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kind, pair in thresholds.items() for x in (kind, pair[place])]), F.col("kind")), F.lit(other))


#: Letters of Latin texts, the rare ones first; other characters are rarer still. The order decides how many pairs are looked at, not which are found.
_RARE = "zqxjkvbpygfwmucldrhsnioate "
_BANDS = 1.25


def _letters(text: Column) -> Column:
    """The characters of a text, each with its number among equal ones, the rare ones first: a set for each multiset."""
    ranked = F.array_sort(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.struct(F.instr(F.lit(_RARE), c).alias("r"), c.alias("c"))))
    return F.transform(ranked, lambda x, i: F.concat(x["c"], (i - F.array_position(ranked, x)).cast("string")))


def _overlap_needed(a: Column, b: Column, jaro_bar: Column) -> Column:
    """How many characters strings of such lengths have in common at least, if their Jaro similarity reaches the bar.

    With m matches Jaro is (m/a + m/b + (m - t)/m) / 3, at most (m/a + m/b + 1) / 3, and m is at most the characters in common.
    """
    return F.ceil((3 * jaro_bar - 1) * a * b / (a + b) - 1e-9)


def _signatures(rows: DataFrame, bar: Column, leg: str) -> DataFrame:
    """Rows with the keys under which alike ones of their leg meet.

    Winkler adds 0.1 of the rest to 1 for each of up to four equal first characters, so that a similarity of t needs a Jaro
    of t where the first characters differ (leg ``0``), and of (t - 0.4) / 0.6 where they are equal (leg ``1``, where the
    first character is part of the key). That bounds the lengths of two alike strings, and the characters they have in
    common by o. Lengths are put in bands; for two bands, o is taken at their least lengths. Ordered by rarity, the first
    n - o + 1 characters of both then share one, and the first n - o + 2 share two, if o is 2 or more: keys are these
    characters or, where that gives few keys, pairs of them.
    """
    n = F.col("n")
    jaro_bar = bar if leg == "0" else (bar - 0.4) / 0.6
    band = lambda x: F.floor(F.log(x.cast("double")) / F.lit(math.log(_BANDS)) + 1e-9)
    least = lambda k: F.greatest(F.ceil(F.pow(F.lit(_BANDS), k) - 1e-9), F.lit(1))
    ratio = F.greatest(3 * jaro_bar - 2, F.lit(0.001))
    keyed = rows.where("n > 0").withColumn("jb", jaro_bar).withColumn("own", band(n)).withColumn("other", F.explode(F.sequence(F.greatest(band(F.ceil(ratio * n - 1e-9)), F.lit(0)), band(F.floor(n / ratio + 1e-9)))))
    o = F.greatest(_overlap_needed(least(F.col("own")), least(F.col("other")), F.col("jb")), F.lit(1))
    keyed = keyed.withColumn("o", o)
    # Whether pairs serve must be the same for both sides: it hangs on the bands alone.
    longest = F.pow(F.lit(_BANDS), F.greatest("own", "other") + 1)
    keyed = keyed.withColumn("twos", (F.col("o") >= 2) & (longest - F.col("o") + 2 <= 12))
    first = F.slice("letters", F.lit(1), F.greatest(n - F.col("o") + F.when(F.col("twos"), 2).otherwise(1), F.lit(1)))
    twos = F.flatten(F.transform(first, lambda x, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda y: F.concat(x, F.lit("|"), y))))
    start = F.substring("k.sorted", 1, 1) if leg == "1" else F.lit("")
    return keyed.withColumn("signature", F.explode(F.when(F.col("twos"), twos).otherwise(first))).withColumn("meets", F.struct(start.alias("start"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "signature")).drop("jb", "own", "other", "o", "twos", "signature")


def alike_candidates(left: DataFrame, right: DataFrame, bar: Column) -> DataFrame:
    """Pairs of rows (kind, value, k of keys_of) of one kind and with equal numbers that may be alike by the bar: (kind, a, ka, b, kb, ...).

    Every pair with a similarity of the bar or more is among them; a bar of 0.45 or less would admit strings without a
    common character and raises an error. Columns of the sides come back as a_* and b_*. No block holds more than the
    labels that share a writing without its spaces, or rare characters and bands of length; pairs that have too few
    characters in common go before any comparison. Frequent keys are split by adaptive execution, being plain joins.
    """
    side = lambda rows, s: rows.withColumn("n", F.length("k.sorted")).withColumn("letters", _letters(F.col("k.sorted"))).withColumn("bar", F.when(bar <= 0.45, F.raise_error(F.lit("a similarity bar is above 0.45")).cast("double")).otherwise(bar))
    named = lambda rows, s, passed: rows.select("kind", F.col("k.numbers").alias("numbers"), "meets", F.struct(*[c for c in passed if c != "kind"], "n", "letters", "bar").alias(s))
    x, y = side(left, "a"), side(right, "b")
    found = None
    for leg in ("0", "1", "joined"):
        if leg == "joined":
            empty = F.struct(F.col("k.joined").alias("start"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit("").alias("signature"))
            p, q = x.withColumn("meets", empty), y.withColumn("meets", empty)
        else:
            p, q = _signatures(x, F.col("bar"), leg), _signatures(y, F.col("bar"), leg)
        met = named(p, "a", left.columns).join(named(q, "b", right.columns), ["kind", "numbers", "meets"]).where(F.col("a.value") != F.col("b.value"))
        if leg != "joined":
            same = F.substring("a.k.sorted", 1, 1) == F.substring("b.k.sorted", 1, 1)
            jaro_bar = F.when(same, (F.col("a.bar") - 0.4) / 0.6).otherwise(F.col("a.bar"))
            met = met.where((same if leg == "1" else ~same) & (F.size(F.array_intersect("a.letters", "b.letters")) >= _overlap_needed(F.col("a.n"), F.col("b.n"), jaro_bar)))
        met = met.select("kind", F.col("a.value").alias("va"), F.col("b.value").alias("vb"), *[F.col(s).dropFields("n", "letters", "bar").alias(s) for s in ("a", "b")])
        found = met if found is None else found.unionByName(met)
    return found.dropDuplicates(["kind", "va", "vb"]).drop("va", "vb")


def regrouped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (kind, a, b) of rows whose digits are grouped otherwise: first by the ways of grouping, then their labels."""
    cuts = lambda rows: rows.where("k.digits <> ''").select("kind", F.col("k.digits").alias("digits"), F.col("k.numbers").alias("numbers")).distinct()
    key = lambda c: F.struct(F.col("digits"), F.col(c).alias("numbers"))
    ways = cuts(left).withColumnRenamed("numbers", "na").join(cuts(right).withColumnRenamed("numbers", "nb"), ["kind", "digits"]).where(regrouping(key("na"), key("nb")))
    side = lambda rows, s: rows.select("kind", F.col("k.digits").alias("digits"), F.col("k.numbers").alias(f"n{s}"), F.struct(*[c for c in rows.columns if c != "kind"]).alias(s))
    return ways.join(side(left, "a"), ["kind", "digits", "na"]).join(side(right, "b"), ["kind", "digits", "nb"]).select("kind", "a", "b")


def look_alikes(labels: DataFrame, fresh: DataFrame | None = None, thresholds: dict[str, tuple[float, float]] = THRESHOLDS) -> DataFrame:
    """VOC6, JN11: pairs (kind, a, b, similarity, regrouping) of labels (kind, value) that are alike, or whose digits are grouped otherwise.

    Given `fresh` labels, only pairs with one of these.
    """
    keyed = labels.where("value IS NOT NULL").select("kind", "value").distinct().withColumn("k", keys_of("value"))
    bar = _bars(thresholds, 1, 0.9)
    left = keyed if fresh is None else keyed.join(fresh.select("kind", "value").distinct(), ["kind", "value"], "left_semi")
    flat = lambda rows: rows.select("kind", F.col("a.value").alias("a"), F.col("b.value").alias("b"), F.col("a.k").alias("ka"), F.col("b.k").alias("kb"))
    ordered = F.col("a") < F.col("b") if fresh is None else F.col("a") != F.col("b")
    near = flat(alike_candidates(left, keyed, bar)).where(ordered).withColumn("similarity", similarity(F.col("ka"), F.col("kb"))).where(F.col("similarity") >= bar).withColumn("regrouping", F.lit(False))
    again = flat(regrouped(left, keyed)).where(ordered).withColumn("similarity", similarity(F.col("ka"), F.col("kb"))).withColumn("regrouping", F.lit(True))
    out = near.unionByName(again).select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity", "regrouping")
    return out if fresh is None else out.distinct()


def suggestions(pairs: DataFrame, used: DataFrame, rules: DataFrame, limit: int = 50) -> DataFrame:
    """VOC8: undecided pairs, the less used label to merge into the more used."""
    apart = rules.where(F.col("action") == "keepApart").select("kind", F.least("value", "target").alias("a"), F.greatest("value", "target").alias("b"))
    open_ = pairs.join(apart, ["kind", "a", "b"], "left_anti")
    count = lambda c: used.select("kind", F.col("value").alias(c), F.col("documents").alias(f"n_{c}"))
    both = open_.join(count("a"), ["kind", "a"]).join(count("b"), ["kind", "b"])
    into = F.when((F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))), F.col("a")).otherwise(F.col("b"))
    out = both.select("kind", F.when(into == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("value"), into.alias("into"), "similarity", "regrouping", (F.col("n_a") + F.col("n_b")).alias("documents"))
    return out.orderBy(F.desc("similarity"), "regrouping", kind_rank(F.col("kind")), F.desc("documents"), "value", "into").limit(limit)


def _writings(value: str) -> list[tuple]:
    """VOC2: values with one of these in common are one writing."""
    numbers, _, joined, ordered = comparison_key(value)
    return [("joined", tuple(numbers), joined), ("sorted", tuple(numbers), ordered)]


def resolve_rules(rules: list[tuple[str, str, str, str | None]]) -> dict[tuple[str, str], str | None]:
    """VOC9: where each label of the user's rules (kind, value, action, target) ends; None if it is ignored."""
    deciding = [r for r in rules if r[2] in ("merge", "ignore")]
    first: dict[tuple, int] = {}
    for n, (kind, value, _, _) in enumerate(deciding):
        for w in _writings(value):
            first.setdefault((kind, w), n)
    out: dict[tuple[str, str], str | None] = {}
    for kind, value, _, _ in deciding:
        at: str | None = value
        seen = set()
        while at is not None:
            found = min((first[kind, w] for w in _writings(at) if (kind, w) in first), default=None)
            if found is None or found in seen:
                break
            seen.add(found)
            at = None if deciding[found][2] == "ignore" else deciding[found][3]
        out[kind, value] = at
    return out


def apply_rules(labels: DataFrame, rules: DataFrame, most_rules: int = 200_000) -> DataFrame:
    """VOC9, VOC11: labels (.., kind, value) with ruled ones rewritten or gone, by writing. Rules are the user's own list."""
    listed = [(r["kind"], r["value"], r["action"], r["target"]) for r in rules.orderBy("id").limit(most_rules + 1).collect()]
    if len(listed) > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    ends: dict[tuple, tuple] = {}
    for n, ((kind, value), target) in enumerate(resolve_rules(listed).items()):
        for leg, numbers, written in _writings(value):
            ends.setdefault((kind, leg, numbers, written), (n, target))
    rows = [(kind, leg, list(numbers), written, n, target) for (kind, leg, numbers, written), (n, target) in ends.items()]
    table = labels.sparkSession.createDataFrame(rows, "kind string, leg string, numbers array<string>, written string, turn int, target string")
    met = labels.withColumn("_k", keys_of("value"))
    for leg in ("joined", "sorted"):
        mine = F.broadcast(table.where(F.col("leg") == leg).select(F.col("kind").alias("_kind"), F.col("numbers").alias("_numbers"), F.col("written").alias("_written"), F.struct("turn", "target").alias(f"_{leg}")))
        met = met.join(mine, (F.col("kind") == F.col("_kind")) & (F.col("_k.numbers") == F.col("_numbers")) & (F.col(f"_k.{leg}") == F.col("_written")), "left").drop("_kind", "_numbers", "_written")
    rule = F.least(F.col("_joined"), F.col("_sorted"))  # the earlier rule
    kept = met.where(rule.isNull() | rule["target"].isNotNull())
    return kept.withColumn("value", F.coalesce(rule["target"], F.col("value"))).select(*labels.columns).distinct()


def align(labels: DataFrame, used: DataFrame, rules: DataFrame | None = None, thresholds: dict[str, tuple[float, float]] = THRESHOLDS) -> DataFrame:
    """VOC10: (kind, value, into): the vocabulary's label, strictly more used, that a label is a writing of.

    A label in use stays unless another one is the same writing; pairs that a rule keeps apart don't meet. Of equals the
    most used, then the first by value.
    """
    bar = _bars(thresholds, 0, 1.0)
    known = used.where("value IS NOT NULL").select("kind", "value", "documents").withColumn("k", keys_of("value"))
    mine = labels.where("value IS NOT NULL").select("kind", "value").distinct().join(used.select("kind", "value", "documents"), ["kind", "value"], "left").fillna(0, ["documents"]).withColumn("k", keys_of("value"))
    pairs = alike_candidates(mine, known, bar).where(F.col("b.documents") > F.col("a.documents"))
    met = pairs.select("kind", F.col("a.value").alias("value"), F.col("a.documents").alias("n"), F.col("a.k").alias("ka"), F.col("b.value").alias("into"), F.col("b.documents").alias("documents"), F.col("b.k").alias("kb"))
    scored = met.withColumn("similarity", similarity(F.col("ka"), F.col("kb"))).where((F.col("similarity") >= F.when(F.col("n") > 0, 1.0).otherwise(bar)))
    if rules is not None:
        apart = rules.where("action = 'keepApart' AND value IS NOT NULL AND target IS NOT NULL").select("kind", keys_of("value")["sorted"].alias("x"), keys_of("target")["sorted"].alias("y"))
        both = apart.unionByName(apart.select("kind", F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
        scored = scored.withColumn("x", F.col("ka.sorted")).withColumn("y", F.col("kb.sorted")).join(both, ["kind", "x", "y"], "left_anti").drop("x", "y")
    best = F.row_number().over(Window.partitionBy("kind", "value").orderBy(F.desc("similarity"), F.desc("documents"), "into"))
    return scored.withColumn("place", best).where("place = 1").select("kind", "value", "into")


def relabel(docs: DataFrame, kind: str, value: str, target: str | None) -> DataFrame:
    """VOC13, PIP17: documents whose labels change when a writing of (kind, value) becomes target, or goes."""
    wanted = key_literal(value)
    names = docs.columns
    flat = docs.select(*names, F.posexplode("labels").alias("pos", "label")).withColumn("k", keys_of("label.value"))
    fits = (F.col("label.kind") == kind) & same_writing(F.col("k"), wanted)
    fresh = F.when(fits, F.lit(target)).otherwise(F.col("label.value"))
    rebuilt = flat.withColumn("new", F.struct(F.col("label.kind").alias("kind"), fresh.alias("value"))).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("all"), F.bool_or(fits).alias("changed"))
    out = rebuilt.where("changed").select("doc_id", distinct_labels(F.filter(F.transform("all", lambda x: x["new"]), lambda x: x["value"].isNotNull())).alias("labels"))
    return docs.drop("labels").join(out, "doc_id").where(F.lit(True)).select(*names)


def most_alike(value: str, others: DataFrame, n: int) -> DataFrame:
    """RNK7: the n values of others (value, position) most alike to one, itself left out, the earlier on ties."""
    mine = key_literal(value)
    scored = others.where(F.col("value") != value).withColumn("similarity", similarity(mine, keys_of("value")))
    return scored.orderBy(F.desc("similarity"), "position").limit(n)


def stored_form(labels: Column, by_hand: Column) -> Column:
    """VOC17: struct<labels, tags_only, by_hand>: null labels while there are none, the by-hand ones that are among them."""
    some = F.size(labels) > 0
    tags = some & F.forall(labels, lambda x: x["kind"] == "tag")
    return F.struct(F.when(some, labels).alias("labels"), F.coalesce(tags, F.lit(False)).alias("tags_only"), F.filter(by_hand, lambda h: F.exists(labels, lambda x: x == h)).alias("by_hand"))


def decided(pairs: DataFrame, used: DataFrame) -> DataFrame:
    """VOC14: rules of judged pairs (kind, a, b, judged): both still in use; the same ones merge into the more used, others stay apart."""
    count = lambda c: used.select("kind", F.col("value").alias(c), F.col("documents").alias(f"n_{c}"))
    both = pairs.where("judged IS NOT NULL").join(count("a"), ["kind", "a"]).join(count("b"), ["kind", "b"])
    first = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    into, gone = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    return both.select("kind", gone.alias("value"), F.when(F.col("judged") == "same", "merge").otherwise("keepApart").alias("action"), into.alias("target"))


def guidance(used: DataFrame, limit: int) -> DataFrame:
    """VOC15: the most used labels of each kind."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("documents"), "value"))
    return used.withColumn("place", place).where(F.col("place") <= limit)


