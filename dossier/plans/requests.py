"""Requests to models and what comes back: prompt budgets, plans from answers, cells of a layout (PIP15, VAL2, VAL3)."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.labels import KINDS
from dossier.functions.text import fold_text
from dossier.plans.tasks import SearchPlan

WORDS, VALUES, DEPTH = 4, 10, 3


def within_budget(parts: Sequence[tuple[str, str, int]], budget: int) -> dict[str, str]:
    """PIP15: parts (name, text, rank) cut to a budget of characters: the highest rank is cut first, from its end."""
    out = {name: text for name, text, _ in parts}
    for name, _, _ in sorted(parts, key=lambda p: -p[2]):
        over = sum(map(len, out.values())) - budget
        if over <= 0:
            break
        out[name] = out[name][: max(0, len(out[name]) - over)]
    return out


def plan_of_answer(answer: str, request: str) -> tuple[SearchPlan, list[str]]:
    """VAL3: the plan of a JSON answer, and what was left out of it.

    An answer is {"labels": [{"kind", "value", "quote"}], "words": [..], "grouping": [..]}. A label stands if its kind
    is known and its quote is in the request; words stand if the request has them, up to the first letters in which an
    inflected form may differ.
    """
    notes: list[str] = []
    try:
        read = json.loads(answer)
    except ValueError:
        return SearchPlan(grouping=()), ["unreadable"]
    asked = fold_text(request)
    said = re.findall(r"[^\W_]+", asked)
    labels = []
    for item in read.get("labels", [])[: VALUES * len(KINDS)]:
        kind, value, quote = item.get("kind"), str(item.get("value", "")).strip(), fold_text(str(item.get("quote", "")))
        if kind not in KINDS or not value:
            notes.append("unknownKind")
        elif not quote or quote not in asked:
            notes.append("unquoted")
        elif (kind, value) not in labels:
            labels.append((kind, value))
    words = []
    for word in map(str, read.get("words", [])):
        stem = fold_text(word)[: max(4, len(word) - 2)]
        if any(w.startswith(stem) for w in said):
            words.append(word)
        else:
            notes.append("unsaidWord")
    grouping = [k for k in dict.fromkeys(read.get("grouping", [])) if k in KINDS][:DEPTH]
    return SearchPlan(labels=labels, words=words[:WORDS], grouping=grouping), notes


def cells(text: Column) -> Column:
    """VAL2: array of lines, each an array of its cells."""
    return F.transform(F.split(text, "\n"), lambda line: F.filter(F.transform(F.split(line, "\t"), lambda c: F.trim(c)), lambda c: c != ""))


def field_value(text: Column, name: str) -> Column:
    """VAL2: the cell after the one that ends with a field's name, else the first cell of the line below."""
    lines = cells(text)
    ends = lambda c: F.lower(F.regexp_replace(c, r"\s*:$", "")).endswith(name.lower())

    def of(line: Column, i: Column) -> Column:
        at = F.array_position(F.transform(line, lambda c: F.coalesce(ends(c), F.lit(False))), True)
        below = F.get(F.get(lines, i + 1), 0)
        return F.when(at > 0, F.coalesce(F.get(line, at.cast("int")), below))

    return F.get(F.filter(F.transform(lines, of), lambda v: v.isNotNull()), 0)


def cut_to_cell(value: Column, sender: Column, text: Column) -> Column:
    """VAL2: a party read together with the sender's cell beside it is the other cell."""
    joined = F.flatten(F.transform(cells(text), lambda line: F.transform(line, lambda c, i: F.struct(F.concat_ws(" ", c, F.get(line, i + 1)).alias("both"), c.alias("a"), F.get(line, i + 1).alias("b")))))
    hit = F.get(F.filter(joined, lambda j: (j["both"] == value) & j["b"].isNotNull() & ((j["a"] == sender) | (j["b"] == sender))), 0)
    return F.coalesce(F.when(hit["a"] == sender, hit["b"]).otherwise(hit["a"]), value)
