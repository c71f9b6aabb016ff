"""Benchmark decontamination by template canonicalisation (operator 10), DataFrame functions only.

Every text becomes a row of tokens in which numbers, names and units are typed placeholders with their values kept
aside. Windows of ``window`` placeholder tokens are hashed; the documents' windows meet the benchmark's by a hash join.
Windows in which only numbers and units are placeholders, and names are words without case, are met in the same way, so
that copies in capitals, title case or lower case are found too.
Along one alignment of document and item the slots must be consistent: an item's value stands for one value of the
document, so that "12 km ... 12 km" is caught as "7 km ... 7 km", not as "7 km ... 9 km". An
item is leaked into a document if the matching windows cover at least ``coverage`` of the item's tokens.

A number is a run of digits with inner points or commas. A unit is a word of UNITS after a number. A name is a
capitalised word that doesn't begin a sentence or line. Sentence ends are no tokens. Windows of placeholders alone say
nothing and aren't used.

An item of fewer tokens than a window is one window of its own length. The benchmark's windows, and the keys of the
documents that are read again, are broadcast only when they are counted to be at most ``broadcast_rows``; beyond that
both sides are shuffled.

Defined cases: null and empty texts match nothing; items without a token, or of placeholders alone, can't be found; a
null doc_id is a key like any other; repeated rows give the same pair once; of documents with one doc_id only those
texts that hold an item are leaks; empty tables give an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import small, stored, text_key

#: Unit words that may follow a number.
UNITS = "mm cm m km in ft mi mg g kg t lb oz ml l s ms min h hz khz mhz ghz w kw kwh mw v j kj cal kcal pa kpa b kb mb gb tb usd eur gbp percent euro euros dollar dollars pounds miles meters metres kilometers kilometres grams kilograms litres liters seconds minutes hours days weeks months years degrees".split()

NUMBER, NAME, UNIT = "\u0001", "\u0002", "\u0003"
#: A token of a text, and of a text with placeholders: these match one to one.
RAW = r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+"
TOKEN = r"[\u0001-\u0003]|[\p{L}\p{M}]+"


def _bind(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _clean(text: Column) -> Column:
    """The text without characters that stand for placeholders."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\u0001-\u0003]+", " ")


def template(text: Column, names: bool = True) -> Column:
    """array<string>: the tokens of a text, numbers, units and, if names, names as placeholders."""
    named = _clean(text) if not names else F.regexp_replace(_clean(text), r"\p{Lu}(?<=[\p{L}\p{M}\p{N},;'\u2019)\]\"]\x20\p{Lu})[\p{L}\p{M}]*", NAME)
    numbered = F.regexp_replace(named, r"[0-9]+(?:[.,][0-9]+)*", NUMBER)
    units = F.regexp_replace(numbered, rf"(?i){NUMBER}(\x20?)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{M}}])", f"{NUMBER}$1{UNIT}")
    return F.regexp_extract_all(F.lower(units), F.lit(TOKEN), F.lit(0))


def values(text: Column) -> Column:
    """array<string>: the tokens as written, lower-cased, in the same places."""
    return F.regexp_extract_all(F.lower(_clean(text)), F.lit(RAW), F.lit(0))


def windows(tokens: Column, window: int) -> Column:
    """array<long>: the hash of the window that starts at each token."""

    def over(codes: Column) -> Column:
        found = F.transform(codes, lambda h, i: F.xxhash64(h, *[F.get(codes, i + k) for k in range(1, window)]))
        return F.slice(found, F.lit(1), F.greatest(F.size(codes) - (window - 1), F.lit(0)))

    return _bind(F.transform(tokens, lambda t: F.xxhash64(t)), over)


def all_windows(text: Column, window: int) -> Column:
    """array<struct<p, h, named>>: the windows of both templates, those without names only where they differ."""

    def over(first: Column) -> Column:
        mine = F.transform(first, lambda h, i: F.struct(i.alias("p"), h.alias("h"), F.lit(True).alias("named")))
        other = F.transform(windows(template(text, names=False), window), lambda h, i: F.struct(i.alias("p"), h.alias("h"), F.lit(False).alias("named")))
        return F.concat(mine, F.filter(other, lambda x: ~x["h"].eqNullSafe(F.get(first, x["p"]))))

    return _bind(windows(template(text), window), over)


def _matches(docs: DataFrame, benchmark: DataFrame, window: int, coverage: float, broadcast_rows: int) -> DataFrame:
    """(doc_id, tk, item_id, covered, n_tokens): tk tells texts of one doc_id apart."""
    key = ["doc_id", "tk"]
    shorter = F.size(template(F.col("text")))
    lengths = [window] + sorted(r[0] for r in benchmark.select(shorter).where((shorter > 0) & (shorter < window)).distinct().collect())  # fewer than a window's tokens
    forms = benchmark.select("item_id", "text", template(F.col("text")).alias("t"), template(F.col("text"), names=False).alias("u"), values(F.col("text")).alias("v"))
    one = None
    for n in lengths:
        fits = F.size("t") >= window if n == window else F.size("t") == n
        some = forms.where(fits).select("*", F.lit(n).alias("len"), F.explode(all_windows(F.col("text"), n)).alias("w"))
        one = some if one is None else one.unionAll(some)
    items = one.select("item_id", "v", F.size("t").alias("n_tokens"), "len", "t", "u", F.when(F.col("w.named"), F.col("t")).otherwise(F.col("u")).alias("own"), F.col("w.p").alias("ip"), F.col("w.h").alias("h"))
    part = lambda c: F.slice(c, F.col("ip") + 1, F.col("len"))
    slot = lambda t: t.isin(NUMBER, NAME, UNIT)
    # A slot of either template has a value to be held against the document's, names without case too.
    held = F.transform(part("v"), lambda v, i: F.when(slot(F.get(part("t"), i)) | slot(F.get(part("u"), i)), v))
    asked = items.select("h", "item_id", "n_tokens", "len", "ip", F.size(F.filter(part("own"), slot)).alias("slots"), F.when(F.exists(held, lambda v: v.isNotNull()), held).alias("iv"))
    asked = small(asked.where("slots < len").drop("slots", "len"), broadcast_rows)
    every = [all_windows(F.col("text"), n) for n in lengths]
    found = every[0] if len(every) == 1 else F.concat(*every)
    rows = docs.select("doc_id", text_key(F.col("text")).alias("tk"), F.explode(found).alias("w")).select("doc_id", "tk", F.col("w.p").alias("p"), F.col("w.h").alias("h"))
    met = stored(rows.join(asked, "h").select(*key, "item_id", "n_tokens", "ip", "p", (F.col("p") - F.col("ip")).alias("shift"), "iv"))
    aligned = [*key, "item_id", "n_tokens", "shift"]
    free = met.where("iv IS NULL").select(*aligned, "ip")
    # Windows with slots need the document's values: only these documents are read again.
    held = met.where("iv IS NOT NULL")
    again = docs.select("doc_id", text_key(F.col("text")).alias("tk"), "text")
    few = small(held.select("tk").distinct(), broadcast_rows)
    again = again.join(few, "tk", "left_semi")
    wanted = held.groupBy(*key).agg(F.collect_list(F.struct("item_id", "n_tokens", "shift", "ip", "p", "iv")).alias("asked"))  # of one document
    same = again["doc_id"].eqNullSafe(wanted["doc_id"]) & (again["tk"] == wanted["tk"])
    seen = again.join(wanted.hint("shuffle_hash"), same).select(again["doc_id"], again["tk"], values(F.col("text")).alias("dv"), "asked")
    pair = lambda x, dv: F.filter(F.arrays_zip(x["iv"].alias("iv"), F.slice(dv, x["p"] + 1, window).alias("v")), lambda s: s["iv"].isNotNull())
    slotted = seen.select(*key, F.inline(F.transform("asked", lambda x: F.struct(x["item_id"].alias("item_id"), x["n_tokens"].alias("n_tokens"), x["shift"].alias("shift"), x["ip"].alias("ip"), pair(x, F.col("dv")).alias("pairs")))))
    # Along one alignment an item's value stands for one value of the document.
    judged = slotted.groupBy(*aligned).agg(F.collect_set("ip").alias("ips"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    single = F.size(F.array_distinct(F.transform("pairs", lambda s: s["iv"]))) == F.size("pairs")
    consistent = judged.where(single).select(*aligned, F.explode("ips").alias("ip"))
    places = free.unionAll(consistent).groupBy(*key, "item_id", "n_tokens").agg(F.sort_array(F.collect_set("ip")).alias("ips"))
    gaps = F.transform("ips", lambda p, i: F.least(F.lit(window), F.coalesce(F.get("ips", i + 1) - p, F.lit(window))))
    covered = F.least(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.col("n_tokens"))
    counted = places.select(*key, "item_id", covered.cast("long").alias("covered"), F.col("n_tokens").cast("long"))
    return counted.where(F.col("covered") >= coverage * F.col("n_tokens"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 5, coverage: float = 0.8, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, item_id, covered, n_tokens): items found in documents; covered of the item's n_tokens tokens match."""
    found = _matches(docs, benchmark, window, coverage, broadcast_rows)
    return found.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"), F.max("n_tokens").alias("n_tokens"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 5, coverage: float = 0.8, broadcast_rows: int = 500_000) -> DataFrame:
    """The documents in which no item was found, as they are."""
    found = small(_matches(docs, benchmark, window, coverage, broadcast_rows).select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk")).distinct(), broadcast_rows)
    same = docs["doc_id"].eqNullSafe(found["_id"]) & (text_key(docs["text"]) == found["_tk"])
    return docs.join(found, same, "left_anti")
