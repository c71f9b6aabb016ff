"""Dates in texts: scanning, and choosing a document's own date (DT1-DT4)."""

from __future__ import annotations

import re
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: Month names by language.
_NAMES = """
january february march april may june july august september october november december
janvier février mars avril mai juin juillet août septembre octobre novembre décembre
januar februar märz april mai juni juli august september oktober november dezember
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro
января февраля марта апреля мая июня июля августа сентября октября ноября декабря
gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre
jan feb mar apr may jun jul aug sep oct nov dec
"""
MONTHS = {name: i % 12 + 1 for i, name in enumerate(_NAMES.split())}
_MONTH = "|".join(sorted(map(re.escape, MONTHS), key=len, reverse=True))
#: In order: an earlier pattern's match claims its place.
_PATTERNS = [
    (re.compile(rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th|\.|º)?\s+(?:de\s+)?({_MONTH})\.?,?\s+(?:de\s+)?(\d{{4}})\b"), lambda m: (m[3], MONTHS[m[2].lower()], m[1])),
    # Looked ahead: a word before a digit, without which no name of a month is tried.
    (re.compile(rf"(?i)\b(?=\w+\.?\s+\d)({_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b"), lambda m: (m[3], MONTHS[m[1].lower()], m[2])),
    (re.compile(r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"), lambda m: (m[1], m[2], m[3])),
    (re.compile(r"\b(\d{4})-(\d{2})-(\d{2})\b|\b(\d{4})([./])(\d{1,2})\5(\d{1,2})\b"), lambda m: (m[1], m[2], m[3]) if m[1] else (m[4], m[6], m[7])),
    (re.compile(r"\b(\d{1,2})\.\s(\d{1,2})\.\s(\d{4})\b"), lambda m: (m[3], m[2], m[1])),
    (re.compile(r"\b(\d{2}) (\d{2}) (\d{4})\b"), lambda m: (m[3], m[2], m[1])),
    (re.compile(r"(?<![\d./-])(\d{1,2})([./-])(\d{1,2})\2(\d{4}|\d{2})(?![\d]|[./-]\d)"), lambda m: (m[4], m[3], m[1])),
]
#: Words before a date, and what they add to its score.
_LABELS = {
    3: ["date", "dated", "invoice date", "issued", "issue date", "data", "data de emissão", "datum", "rechnungsdatum", "fecha", "date de facturation", "от", "дата"],
    -3: ["due", "due date", "pay by", "vencimento", "data limite", "fällig", "vence", "échéance", "срок", "date of birth", "born", "birth", "data de nascimento", "geburtsdatum", "дата рождения"],
}
_LABEL = sorted(((w, s) for s, some in _LABELS.items() for w in some), key=lambda x: -len(x[0]))
#: One pass over a text: at each place the longest label that starts there, which of them is told by the group.
_LABELLED = re.compile("(?i)(?<!\\w)(?=[" + "".join(sorted({w[0] for w, _ in _LABEL})) + "])(?=(?:" + "|".join(f"({re.escape(w)})" for w, _ in _LABEL) + ")(?!\\w))")


def _day(y: str, m: str | int, d: str, pivot: int) -> date | None:
    year, month, day = int(y), int(m), int(d)
    if len(str(y)) == 2:
        year += 2000 if year <= pivot else 1900
    if month > 12 >= day:
        month, day = day, month
    try:
        return date(year, month, day)
    except ValueError:
        return None


def scan(text: str, pivot: int = 50) -> list[tuple[int, int, date]]:
    """DT1: (start, end, day) of dates that exist, in order of place."""
    found: list[tuple[int, int, date | None]] = []
    for pattern, parts in _PATTERNS:
        for m in pattern.finditer(text):
            if not any(a < m.end() and m.start() < b for a, b, _ in found):
                found.append((m.start(), m.end(), _day(*parts(m), pivot)))
    return sorted((a, b, d) for a, b, d in found if d)


def _candidates(text: str, window: int = 120) -> list[tuple]:
    dates = scan(text)
    out = []
    for n, (start, end, day) in enumerate(dates):
        line = text.count("\n", 0, start)
        begin = max(start - window, dates[n - 1][1] if n else 0)
        before = text[begin:start]
        above = before.rfind("\n", 0, max(before.rfind("\n"), 0))
        near = before[above + 1 :] if above >= 0 else before
        best = max(((m.end(m.lastindex), len(_LABEL[m.lastindex - 1][0]), _LABEL[m.lastindex - 1][1]) for m in _LABELLED.finditer(near)), default=None)
        out.append((day.isoformat(), start, line, best[2] if best else 0))
    return out


@F.pandas_udf(ArrayType(StructType().add("day", StringType()).add("start", IntegerType()).add("line", IntegerType()).add("label", IntegerType())))
def candidates(some: pd.Series) -> pd.Series:
    """Dates of a text with place, line and the weight of the nearest label before each."""
    return some.map(lambda t: [dict(zip(("day", "start", "line", "label"), c, strict=True)) for c in _candidates(t or "")])


def document_dates(texts: DataFrame, today: str, least: int = 1, head: float = 0.3, crowded: int = 3, key: str = "doc_id") -> DataFrame:
    """DT3: (key, date, score): the best date of each text. texts: (key, text, metadata_days array<string>)."""
    # Dealt by key once: rows of one key and line, or one key and day, are then together too.
    flat = texts.select(key, F.length("text").alias("n"), "metadata_days", F.inline(candidates("text"))).repartition(F.col(key))
    on_line = F.count(F.lit(1)).over(Window.partitionBy(key, "line"))
    this = int(today[:4])
    plausible = F.substring("day", 1, 4).cast("int").between(this - 30, this + 1)
    score = F.col("label") + F.when(F.col("start") < F.col("n") * head, 2).otherwise(0) + F.when(plausible, 1).otherwise(0) - F.when(on_line >= crowded, 1).otherwise(0) + F.when(F.array_contains("metadata_days", F.col("day")), 1).otherwise(0)
    scored = flat.withColumn("score", score).where(plausible).groupBy(key, "day").agg(F.max("score").alias("score"), F.min("start").alias("start"))
    best = scored.where(F.col("score") >= least).groupBy(key).agg(F.max_by(F.struct("day", "score"), F.struct("score", -F.col("start"))).alias("b"))
    return best.select(key, F.col("b.day").alias("date"), "b.score")


def month_key(at: Column) -> Column:
    """DT7: year and month of an instant."""
    return F.date_format(at, "yyyy-MM")


def since(at: Column, now: str, days: int) -> Column:
    """DT7: whether an instant lies in the days before now."""
    return at >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))


def fallback(found: Column, exif: Column, metadata: Column, created: Column, modified: Column) -> Column:
    """DT4: struct<date, source>."""
    some = [("text", found), ("exif", exif), ("pdfMeta", metadata), ("created", created), ("modified", modified)]
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("date"), F.lit(n).alias("source"))) for n, c in some])
