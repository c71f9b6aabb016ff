"""Whether what a reading says is written in a document (GRD1-GRD5), and checks of answers (VAL1, VAL4, VAL5, LLM1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.labels import KINDS, distinct_labels, normalize, split_labels
from dossier.functions.text import bind, fold

LEAST_LETTERS, NUMBER_WORDS, LABELS_PER_KIND, TITLE_SHARE = 3, 9, 5, 0.5


def written_words(text: Column) -> Column:
    """GRD1: the distinct folded words of a text."""
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def written_numbers(text: Column, most: int = NUMBER_WORDS) -> Column:
    """GRD1: writings with a digit: words of one line joined, up to nine, so that `AB 12 3` is also `ab123`."""
    words = lambda line: F.regexp_extract_all(fold(line), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))

    def joined(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(w) - i + 1)), lambda n: F.array_join(F.slice(w, i, n), "")))
        return F.when(F.size(w) > 0, F.flatten(runs)).otherwise(F.array().cast("array<string>"))

    every = F.flatten(F.transform(F.split(text, "\n"), lambda line: bind(words(line), joined)))
    return F.array_distinct(F.filter(every, lambda x: x.rlike("[0-9]")))


def name_is_written(name: Column, words: Column) -> Column:
    """GRD2: every word of three letters or more is in a word of the document; shorter ones as words or initials."""
    def of_parts(parts: Column) -> Column:
        long = F.filter(parts, lambda p: F.length(p) >= LEAST_LETTERS)
        initials = F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), "")
        all_in = (F.size(long) > 0) & F.forall(long, lambda p: F.exists(words, lambda w: w.contains(p)))
        return all_in | ((F.size(parts) > 1) & F.array_contains(words, initials)) | ((F.size(long) == 0) & F.forall(parts, lambda p: F.array_contains(words, p)) & (F.size(parts) > 0))

    return bind(F.regexp_extract_all(fold(name), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), of_parts)


def number_is_written(value: Column, numbers: Column) -> Column:
    """GRD3."""
    return F.array_contains(numbers, F.regexp_replace(fold(value), r"[^\p{L}\p{N}]+", ""))


def unwritten_share(title: Column, words: Column) -> Column:
    """GRD4: share of a title's long words that the document doesn't have."""
    long = F.filter(F.regexp_extract_all(fold(title), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda p: F.length(p) >= LEAST_LETTERS)
    missing = F.filter(long, lambda p: ~F.exists(words, lambda w: w.contains(p)))
    return F.when(F.size(long) > 0, F.size(missing) / F.size(long)).otherwise(0.0)


def year_is_written(day: Column, words: Column) -> Column:
    """GRD5."""
    return F.exists(words, lambda w: w.contains(F.substring(day, 1, 4)))


def day_is_written(day: Column, found: Column) -> Column:
    """GRD5: whether an ISO day is among the days that were found in a text."""
    return F.array_contains(found, day)


ANSWER = "labels array<struct<kind:string,value:string>>"


def validated(answers: DataFrame, answer: str = "answer", body: str = "body") -> DataFrame:
    """VAL1: labels of JSON answers: known kinds, split, normalised, grounded in the body, distinct, five of a kind; notes say what went."""
    read = F.coalesce(F.from_json(F.col(answer), ANSWER)["labels"], F.array().cast("array<struct<kind:string,value:string>>"))
    as_written = lambda x: F.struct(x["kind"].alias("kind"), normalize(x["kind"], x["value"]).alias("value"))
    named, numbered = (lambda x: x["kind"].isin("sender", "party")), (lambda x: x["kind"] == "reference")

    def of_split(split: Column) -> Column:
        return bind(F.filter(split, lambda x: x["kind"].isin(KINDS) & x["value"].isNotNull()), lambda known: of_known(split, known))

    def of_known(split: Column, known: Column) -> Column:
        return bind(F.filter(F.transform(known, as_written), lambda x: x["value"].isNotNull()), lambda shaped: of_shaped(split, known, shaped))

    def of_shaped(split: Column, known: Column, shaped: Column) -> Column:
        # The body is read for the kinds that are looked up in it, once for all their labels.
        written = F.struct(F.when(F.exists(shaped, named), written_words(F.col(body))).alias("words"), F.when(F.exists(shaped, numbered), written_numbers(F.col(body))).alias("numbers"))
        grounded = lambda x, w: F.when(named(x), name_is_written(x["value"], w["words"])).when(numbered(x), number_is_written(x["value"], w["numbers"])).otherwise(F.lit(True))
        return bind(bind(written, lambda w: F.filter(shaped, lambda x: grounded(x, w))), lambda left: F.struct(capped(distinct_labels(left)).alias("labels"), notes(split, known, shaped, left).alias("notes")))

    def capped(kept: Column) -> Column:
        return bind(kept, lambda some: F.flatten(F.transform(F.array(*map(F.lit, KINDS)), lambda kind: F.slice(F.filter(some, lambda x: x["kind"] == kind), 1, LABELS_PER_KIND))))

    def notes(split: Column, known: Column, shaped: Column, left: Column) -> Column:
        fewer = [(known, split, "unknownKinds"), (shaped, known, "unreadable"), (left, shaped, "ungrounded")]
        return F.filter(F.array(*[F.when(F.size(some) < F.size(before), why) for some, before, why in fewer]), lambda n: n.isNotNull())

    out = answers.withColumn("_validated", bind(split_labels(read), of_split))
    return out.withColumn("labels", F.col("_validated")["labels"]).withColumn("notes", F.col("_validated")["notes"]).drop("_validated")


def cited(answer: Column, sources: Column, shown: Column, names: Column) -> Column:
    """VAL4: struct<answer, sources>: sources that were shown, and `[n]` in the text as the n-th shown name."""
    marks = F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1))
    replaced = F.aggregate(marks, answer, lambda text, m: F.replace(text, F.concat(F.lit("["), m, F.lit("]")), F.coalesce(F.get(names, m.cast("int") - 1), F.lit(""))))
    return F.struct(replaced.alias("answer"), F.array_intersect(sources, shown).alias("sources"))


def judged(answer: Column) -> Column:
    """VAL5: `same`, `different` or null of a JSON judgement."""
    value = F.from_json(answer, "same boolean")["same"]
    return F.when(value, "same").when(~value, "different")


def ask(prompts: DataFrame, model: Callable[[str], str], valid: Callable[[str], bool], tries: int = 3) -> DataFrame:
    """LLM1: (id, answer, attempts) of prompts (id, prompt): asked again with the fault named until an answer is valid."""
    kind = prompts.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                prompt, answer = r.prompt, None
                for attempt in range(1, tries + 1):
                    answer = model(prompt)
                    if valid(answer):
                        break
                    prompt, answer = f"{r.prompt}\n\nThe last answer could not be read:\n{answer}", None
                rows.append((r.id, answer, attempt))
            yield pd.DataFrame(rows, columns=["id", "answer", "attempts"])

    return prompts.select("id", "prompt").mapInPandas(run, f"id {kind}, answer string, attempts int")
