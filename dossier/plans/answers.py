"""VAL3: plans of models' answers, checked against their requests, as column expressions over a table of answers.

An answer is JSON: labels (kind, value, and quote, the words of the request that ask for it), words that every document
must hold, and groupings (kind and quote). What the request doesn't bear out is left out, with a note; what may be wrong
but could be meant is asked again: a label whose quote runs over what labels of other kinds ask for (``spanning``), words
that stand among the alternatives which the request lists (``alternative``), words inside what asks to arrange the
documents (``arranging``), and kinds of document that the person's question doesn't name (``unnamed``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions import labels as L
from dossier.functions.text import bind, fold, one_line, tokens

#: Words, values of a kind and levels of grouping at most; letters that ground a word, and that inflection changes; words between alternatives.
WORDS, VALUES, DEPTH, GROUNDING, INFLECTION, GAP = 4, 10, 3, 3, 2, 0
ANSWER = "labels array<struct<kind:string,value:string,quote:string>>, words array<string>, grouping array<struct<kind:string,quote:string>>"
OWN = "tag"


def _within(some: Column, all_: Column) -> Column:
    return (F.size(some) > 0) & (F.size(F.array_except(some, all_)) == 0)


def inflected(a: Column, b: Column) -> Column:
    """Whether two folded words are one, as a plural or a case inflects it."""
    letters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    apart = F.array_position(F.zip_with(letters(a), letters(b), lambda x, y: x.eqNullSafe(y)), False)
    shared = F.when(apart == 0, F.length(a)).otherwise(apart - 1)
    begins = (a.startswith(b) & (F.length(b) >= GROUNDING)) | (b.startswith(a) & (F.length(a) >= GROUNDING))
    return (a == b) | begins | (shared >= F.greatest(F.lit(GROUNDING), F.least(F.length(a), F.length(b)) - INFLECTION))


def _places(words: Column, sequence: Column) -> Column:
    """Where a sequence has words: at those that it has once, else wherever it has them."""
    at = F.filter(F.transform(sequence, lambda w, i: F.when(F.array_contains(words, w), i)), lambda i: i.isNotNull())
    times = lambda i: F.size(F.filter(sequence, lambda w: w == F.get(sequence, i)))
    return bind(at, lambda every: bind(F.filter(every, lambda i: times(i) == 1), lambda once: F.when(F.size(once) > 0, once).otherwise(every)))


def _value(kind: Column, value: Column) -> Column:
    """A label as its kind keeps it; what is asked of a time may be any span."""
    spans = kind.isin(L.TIMES) & L.span(value).isNotNull()
    return F.when(spans, one_line(value)).otherwise(L.normalize(kind, value))


def _candidates(read: Column, asked: Column, arranging: Column) -> Column:
    """The answer's labels with their quotes' words and why they are left out, if they are, by kind."""
    rank = lambda kind: F.coalesce(L.kind_rank(kind), F.lit(0))

    def one(x: Column, i: Column) -> Column:
        arranges = F.flatten(F.transform(F.filter(arranging, lambda g: g["kind"] == x["kind"]), lambda g: g["quote"]))
        parts = F.struct(rank(x["kind"]).alias("rank"), _value(x["kind"], F.coalesce(x["value"], F.lit(""))).alias("value"), F.array_distinct(tokens(x["quote"])).alias("quote"), arranges.alias("arranges"))

        def judged(p: Column) -> Column:
            why = F.when(p["rank"] == 0, "unknownKind").when(p["value"].isNull(), "notOfItsKind").when(~_within(p["quote"], asked), "unquoted").when(_within(p["quote"], p["arranges"]), "onlyArranges")
            value = F.coalesce(p["value"], x["value"])
            return F.struct(p["rank"].alias("rank"), i.alias("i"), x["kind"].alias("kind"), value.alias("value"), p["quote"].alias("quote"), why.alias("why"))

        return bind(parts, judged)

    def after_others(every: Column) -> Column:
        # Words that a label of an earlier kind quotes ask for that one.
        earlier = lambda x: F.flatten(F.transform(F.filter(every, lambda y: y["why"].isNull() & (y["rank"] < x["rank"])), lambda y: y["quote"]))
        return F.transform(every, lambda x: x.withField("why", F.coalesce(x["why"], F.when(_within(x["quote"], earlier(x)), "askedForByAnother"))))

    return bind(F.array_sort(F.transform(F.coalesce(read["labels"], F.array().cast("array<struct<kind:string,value:string,quote:string>>")), one)), after_others)


def _spanning(every: Column) -> Column:
    """Values of the labels whose quote holds the whole quotes of two or more things that other kinds ask for."""

    def of(good: Column) -> Column:
        held = lambda x: F.array_distinct(F.transform(F.filter(good, lambda y: (y["kind"] != x["kind"]) & _within(y["quote"], x["quote"]) & (F.size(y["quote"]) < F.size(x["quote"]))), lambda y: F.array_sort(y["quote"])))
        return F.transform(F.filter(good, lambda x: F.size(held(x)) > 1), lambda x: x["value"])

    return bind(F.filter(every, lambda x: x["why"].isNull() | (x["why"] == "askedForByAnother")), of)


def _alternatives(words: Column, kept: Column, sequence: Column) -> Column:
    """The words, structs of a word and its tokens, that the request lists among the alternatives of a kind's labels: between two of them, or next to one or to another such word."""
    none = F.array().cast("array<string>")

    def among(placed: Column, kind: Column) -> Column:
        def grow(places: Column) -> Column:
            between = lambda p: F.exists(places, lambda a: F.exists(a, lambda i: i < p) & F.exists(places, lambda b: (a != b) & F.exists(b, lambda i: i > p)))
            start = F.struct(F.flatten(places).alias("at"), none.alias("found"))

            def step(state: Column, _: Column) -> Column:
                near = lambda p: F.exists(state["at"], lambda i: F.abs(i - p) <= GAP + 1)
                fresh = F.filter(placed, lambda w: ~F.array_contains(state["found"], w["word"]) & F.exists(w["places"], lambda p: between(p) | near(p)))
                grown = lambda some: F.struct(F.concat(state["at"], F.flatten(F.transform(some, lambda w: w["places"]))).alias("at"), F.concat(state["found"], F.transform(some, lambda w: w["word"])).alias("found"))
                return bind(fresh, grown)

            # A pass may bring words next to those of the pass before: as many passes as there are words.
            return F.when(F.size(places) > 1, F.aggregate(F.sequence(F.lit(1), F.lit(WORDS)), start, step)["found"]).otherwise(none)

        return bind(F.transform(F.filter(kept, lambda x: x["kind"] == kind), lambda x: _places(x["quote"], sequence)), grow)

    def listed(placed: Column) -> Column:
        every = F.flatten(F.transform(F.array_distinct(F.transform(F.filter(kept, lambda x: x["kind"] != OWN), lambda x: x["kind"])), lambda kind: among(placed, kind)))
        return bind(every, lambda found: F.filter(F.transform(words, lambda w: w["word"]), lambda w: F.array_contains(found, w)))

    some = bind(F.transform(words, lambda w: F.struct(w["word"].alias("word"), _places(w["tokens"], sequence).alias("places"))), listed)
    return F.when((F.size(words) > 0) & (F.size(kept) > 1), some).otherwise(none)


def checked_plan(answer: Column, request: Column, question: Column | None = None) -> Column:
    """struct<labels, words, grouping, notes, asked_again> of an answer; null if it is no JSON object.

    notes are `reason:value`, asked_again too. Lists are cut to their most; values that are alike when folded are one.
    Whatever is used again, or by every element, is bound.
    """
    folded = lambda some, of: F.transform(some, lambda x: x.withField("folded", fold(of(x))))
    kind_and_quote = "array<struct<kind:string,quote:array<string>>>"

    def of_read(read: Column) -> Column:
        given = F.struct(read.alias("read"), tokens(request).alias("sequence"), *([] if question is None else [tokens(question).alias("question")]))
        return F.when(read["labels"].isNotNull() | read["words"].isNotNull() | read["grouping"].isNotNull(), bind(given, with_request))

    def with_request(given: Column) -> Column:
        grouped = F.filter(F.coalesce(given["read"]["grouping"], F.array().cast("array<struct<kind:string,quote:string>>")), lambda g: g["kind"].isin([k for k in L.KINDS if k != OWN]))
        asked = F.array_distinct(given["sequence"])
        return bind(F.struct(F.transform(grouped, lambda g: F.struct(g["kind"].alias("kind"), F.array_distinct(tokens(g["quote"])).alias("quote"))).alias("grouped"), asked.alias("asked")), lambda more: with_grouping(given, more["grouped"], more["asked"]))

    def with_grouping(given: Column, grouped: Column, asked: Column) -> Column:
        arranging = F.coalesce(F.filter(grouped, lambda g: _within(g["quote"], asked)), F.array().cast(kind_and_quote))
        return bind(arranging, lambda arr: bind(_candidates(given["read"], asked, arr), lambda every: with_labels(given, grouped, asked, arr, every)))

    def with_labels(given: Column, grouped: Column, asked: Column, arr: Column, every: Column) -> Column:
        once = lambda good: F.filter(good, lambda x, i: ~F.exists(F.slice(good, F.lit(1), i), lambda y: (y["kind"] == x["kind"]) & (y["folded"] == x["folded"])))
        most = lambda some: F.filter(some, lambda x, i: F.size(F.filter(F.slice(some, F.lit(1), i), lambda y: y["kind"] == x["kind"])) < VALUES)
        good = folded(F.filter(every, lambda x: x["why"].isNull()), lambda x: x["value"])
        return bind(bind(bind(good, once), most), lambda labels: with_words(given, grouped, asked, arr, every, labels))

    def with_words(given: Column, grouped: Column, asked: Column, arr: Column, every: Column, labels: Column) -> Column:
        same = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
        why = lambda t, quoted: F.when(~_within(t, asked), "unsaid").when(F.exists(arr, lambda g: same(g["quote"], t)), "onlyArranges").when(_within(t, quoted), "askedForByALabel")
        cut = F.transform(F.transform(F.coalesce(given["read"]["words"], F.array().cast("array<string>")), one_line), lambda w: F.struct(w.alias("word"), tokens(w).alias("tokens")))
        judged = lambda quoted: F.transform(F.filter(cut, lambda w: F.size(w["tokens"]) > 0), lambda w: w.withField("why", why(w["tokens"], quoted)))
        first = lambda some: F.slice(F.filter(some, lambda w, i: ~F.exists(F.slice(some, F.lit(1), i), lambda x: x["folded"] == w["folded"])), 1, WORDS)

        def of_told(told: Column) -> Column:
            noted = lambda some, of: F.transform(F.filter(some, lambda x: x["why"].isNotNull()), lambda x: F.concat_ws(":", x["why"], x[of]))
            notes = F.concat(noted(every, "value"), noted(told, "word"))
            stays = folded(F.filter(told, lambda w: w["why"].isNull()), lambda w: w["word"])
            arranged = F.transform(bind(stays, first), lambda w: w.withField("inside", F.exists(arr, lambda g: _within(w["tokens"], g["quote"]))))
            return bind(arranged, lambda words: finished(given, grouped, every, labels, words, notes))

        return bind(bind(F.flatten(F.transform(labels, lambda x: x["quote"])), judged), of_told)

    def finished(given: Column, grouped: Column, every: Column, labels: Column, words: Column, notes: Column) -> Column:
        listed = bind(F.filter(words, lambda w: ~w["inside"]), lambda some: _alternatives(some, labels, given["sequence"]))
        again = [F.transform(_spanning(every), lambda v: F.concat(F.lit("spanning:"), v)), F.transform(listed, lambda w: F.concat(F.lit("alternative:"), w)), F.transform(F.filter(words, lambda w: w["inside"]), lambda w: F.concat(F.lit("arranging:"), w["word"]))]
        if question is not None:
            named = lambda x: F.forall(x["quote"], lambda w: F.exists(given["question"], lambda q: inflected(w, q)))
            again.append(F.transform(F.filter(labels, lambda x: (x["kind"] == "type") & ~named(x)), lambda x: F.concat(F.lit("unnamed:"), x["value"])))
        grouping = F.slice(F.array_distinct(F.transform(grouped, lambda g: g["kind"])), 1, DEPTH)
        pairs = F.transform(labels, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value")))
        return F.struct(pairs.alias("labels"), F.transform(words, lambda w: w["word"]).alias("words"), grouping.alias("grouping"), notes.alias("notes"), F.concat(*again).alias("asked_again"))

    return bind(F.from_json(answer, ANSWER), of_read)
