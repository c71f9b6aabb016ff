"""Text, label, identifier and date functions by examples."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import dates, identifiers
from dossier.functions import labels as L
from dossier.functions import text as T


def values(spark, expression, inputs, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_folding_and_keys(spark):
    assert values(spark, T.fold, ["FATURAÇÃO Él", None]) == ["faturacao el", None]
    assert values(spark, T.search_key, [" Tax-Return, 2025! "]) == ["tax return 2025"]
    assert values(spark, T.fold_exact, ["Ｅｄｐ", "ÉÀ"]) == ["edp", "ea"]
    assert values(spark, T.tokens, ["Período de Faturação nº 3"]) == [["periodo", "de", "faturacao", "nº", "3"]]
    names = ["file 10", "file 9", "File 2"]
    assert [n for _, n in sorted(zip(values(spark, T.natural_key, names), names, strict=True))] == ["File 2", "file 9", "file 10"]


def test_natural_order(spark):
    names = ["zebra", "Äpfel 3", "apfel 20", "Apfel 3", "file 100000000000000000000000000001", "file 99999999999999999999999999999", "file 07", "file 7 b", "éclair", "eclair", "f"]
    order = [r.x for r in spark.createDataFrame([(n,) for n in names], "x string").orderBy(T.natural_key(F.col("x")), "x").collect()]
    assert order == ["Apfel 3", "Äpfel 3", "apfel 20", "eclair", "éclair", "f", "file 07", "file 7 b", "file 99999999999999999999999999999", "file 100000000000000000000000000001", "zebra"]


def test_normalizing(spark):
    assert values(spark, T.normalize_text, ["﻿a \r\nb\r\n\r\n\r\n\r\nc\fd\x07 "]) == ["a\nb\n\nc\n\nd"]
    assert values(spark, lambda x: T.shorten(x, 10), ["one two three", "short", "abcdefghijklm"]) == ["one two", "short", "abcdefghij"]
    assert values(spark, lambda x: T.shorten(x, 7), ["one two three", "one  two three", "onetwothree"]) == ["one two", "one ", "onetwot"]
    assert len(values(spark, lambda x: T.excerpt(x, 60), ["y" * 500])[0]) == 60
    assert values(spark, T.page_quality, ["few", "1234 " * 20, "letters and words " * 5, "good letters " * 5 + "�" * 9]) == ["fewCharacters", "lowLetterShare", None, "replacementCharacters"]
    assert values(spark, T.filled_lines, ["a\n\n b\n"]) == [2]


def test_html_and_entities(spark):
    page = "<head><title>t</title></head><body><script>var a='<p>';</script><!-- c --><p>One &amp; two</p><table><tr><td>a</td><td>b</td></tr></table></body>"
    assert values(spark, T.html_text, [page]) == ["One &amp; two\n\na\tb"]
    assert values(spark, T.entities, ["&amp; &eacute; &#65; &#x42; &nosuch; &copy"]) == ["& é A B &nosuch; &copy"]


def test_names(spark):
    row = spark.createDataFrame([("2025-03-05", "EDP", "2025-03-05 EDP: bill/march")], "d string, s string, t string")
    assert row.select(T.made_name(F.col("d"), F.col("s"), F.col("t")).alias("n")).first().n == "2025-03-05 EDP - bill-march"
    assert values(spark, lambda x: T.bounded_name(x, F.lit(".pdf")), ["é" * 300])[0].endswith(".pdf")
    assert len(values(spark, lambda x: T.bounded_name(x, F.lit(".pdf")), ["é" * 300])[0].encode()) <= 250


def test_encodings():
    russian = "Это письмо о поставке товаров на склад"
    assert T.decode_bytes(russian.encode("koi8-r")) == (russian, "koi8-r")
    assert T.decode_bytes(russian.encode("cp1251"))[0] == russian
    assert T.decode_bytes("é".encode("cp1252"))[0] == "é" and T.decode_bytes(b"\xef\xbb\xbfa")[0] == "a"


def test_days_and_spans(spark):
    assert values(spark, L.iso_day, ["2025-03-05", "5.3.2025", "31.02.2025", "05/13/2025", "x", "1.2/2024"]) == ["2025-03-05", "2025-03-05", None, None, None, "2024-02-01"]
    assert values(spark, lambda x: F.concat_ws("|", L.span(x)["first"], L.span(x)["last"]), ["2025", "2025-02", "2024-07/2025-06", "soon"]) == ["2025-01-01|2025-12-31", "2025-02-01|2025-02-31", "2024-07-01|2025-06-31", ""]


def test_amounts(spark):
    got = values(spark, L.amount, ["€ 1.234,50", "72 EUR", "USD 1,234.5", "12 345,6 EUR", "free"])
    assert got == ["1234.50 EUR", "72 EUR", "1234.5 USD", "12345.6 EUR", None]


def test_amounts_by_examples(spark):
    written = ["54.21: EUR", "54.21eur", "12,50 €", "1 234,56 EUR", "EUR 1.234.567", "1,234.56 EUR", "£ 5", "$5", "5 kr", "12 %", "5", "1.2,3.4 EUR", "EUR 5 USD", "-3,5 CHF", "3 XYZ", None]
    assert values(spark, L.amount, written) == ["54.21 EUR", "54.21 EUR", "12.50 EUR", "1234.56 EUR", "1234567 EUR", "1234.56 EUR", None, None, None, None, None, None, None, "-3.5 CHF", None, None]


def test_label_arrays(spark):
    kind = "array<struct<kind:string,value:string>>"
    labels = [("sender", "EDP"), ("type", "bill"), ("sender", "edp"), ("type", "letter"), ("topic", "a; b")]
    pairs = lambda found: [(x.kind, x.value) for x in found]
    assert pairs(values(spark, L.distinct_labels, [labels], kind)[0]) == [("sender", "EDP"), ("type", "bill"), ("topic", "a; b")]
    assert pairs(values(spark, L.split_labels, [labels], kind)[0])[-2:] == [("topic", "a"), ("topic", "b")]
    label = lambda k, v: F.array(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")))
    assert pairs(values(spark, lambda x: L.edit_labels(x, label("sender", "Edp"), label("type", "invoice")), [labels[:2]], kind)[0]) == [("type", "invoice")]
    kept = values(spark, lambda x: L.keep_by_hand(label("topic", "read"), x, x, label("sender", "EDP")), [labels[:1]], kind)[0]
    assert pairs(kept) == [("sender", "EDP"), ("topic", "read")]
    assert values(spark, lambda x: L.first_value(x, "type"), [labels], kind) == ["bill"]


@pytest.mark.parametrize(
    ("text", "keys"),
    [
        ("IBAN: PT50 0002 0123 1234 5678 9015 4", ["iban:PT50000201231234567890154"]), ("DE89 3704 0044 0532 0130 01", []), ("NIF: 999 999 990", ["nif:999999990"]), ("NIF: 123456780", []),
        ("ИНН/КПП 7707083893/773601001, ОГРН 1027700132195, БИК 044525225", ["inn:7707083893", "kpp:773601001", "ogrn:1027700132195", "bik:044525225"]), ("VAT NL123456789B01", ["vat:NL123456789B01"]),
    ],
)
def test_identifiers(spark, text, keys):
    assert values(spark, identifiers.stable_keys, [text]) == [keys]


def test_generic_numbers_and_labels(spark):
    text = ["Contract no: AB-12345, IBAN DE89370400440532013000 and account DE89370400440532013000; contract AB-12345", "deal 777-1 account abc", None, ""]
    assert values(spark, identifiers.stable_keys, text) == [["account:AB-12345", "iban:DE89370400440532013000"], [], [], []]
    assert values(spark, lambda x: identifiers.stable_keys(x, ["deal"]), text[1:2]) == [["account:777-1"]]
    assert values(spark, identifiers.is_vat, ["RO0123", "SE123456789001", "SE123456789012", "FRI1123456789", "IE1234567WA", "PT123456780", "PT999999990", "XI123456789"]) == [False, True, False, False, True, False, True, True]
    assert values(spark, identifiers.is_nif, ["412345678", "000000000"]) == [False, False] and len(identifiers.IBAN_LENGTHS) == 78


def test_native_checks(spark):
    assert values(spark, identifiers.is_nif, ["999999990", "123456780"]) == [True, False]
    assert values(spark, identifiers.is_inn, ["7707083893", "7707083894"]) == [True, False]
    assert values(spark, identifiers.is_ogrn, ["1027700132195", "1027700132196"]) == [True, False]
    assert values(spark, identifiers.is_iban, ["DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 01", "XX"]) == [True, False, False]
    assert values(spark, identifiers.is_vat, ["NL123456789B01", "NL1"]) == [True, False]


@pytest.mark.parametrize(
    ("text", "days"),
    [
        ("Счёт № 3 от 15 мая 2024 г.", ["2024-05-15"]), ("Data de emissão: 20 de maio de 2026", ["2026-05-20"]), ("on 31.02.2025", []), ("05/13/2025", ["2025-05-13"]), ("01 02 2025", ["2025-02-01"]), ("March 5, 2024 and 2024-06-07", ["2024-03-05", "2024-06-07"]),
        ("2024年3月9日", ["2024-03-09"]),
    ],
)
def test_date_scan(text, days):
    assert [d.isoformat() for _, _, d in dates.scan(text)] == days


def test_document_dates(spark):
    rows = [(1, "Invoice date: 2024-03-12\nDue date: 2024-04-12\nDate of birth: 1994-01-02", None), (2, "Date of birth: 2001-02-03", None), (3, "no date", [])]
    found = {r.doc_id: r.date for r in dates.document_dates(spark.createDataFrame(rows, "doc_id long, text string, metadata_days array<string>"), "2026-09-22").collect()}
    assert found == {1: "2024-03-12"}
    at = spark.createDataFrame([(None, None, "b", "c", "d")], "f string, e string, m string, c string, x string")
    assert at.select(dates.fallback(*[F.col(c) for c in "femcx"]).alias("d")).first().d.source == "pdfMeta"


def test_dates_are_dealt_once(spark):
    """A text's dates are shuffled once, by key; the label that ends last counts, of those that start together the longest."""
    from dossier.functions import dates

    docs = spark.createDataFrame([(1, "Invoice date: 5 May 1999\nDue date: 4 June 1999"), (2, "Date of birth 1 Jan 1998, DATED March 3rd, 1997")], "doc_id long, text string").withColumn("metadata_days", F.array().cast("array<string>"))
    found = dates.document_dates(docs, "2002-01-01")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.doc_id, r.date) for r in found.collect()) == [(1, "1999-05-05"), (2, "1997-03-03")]
    assert [x[3] for x in dates._candidates("date de facturation 1.2.2003 date limite due data limite 4.5.2006")] == [3, -3]


def test_languages_as_counted_plainly(spark):
    import re
    from collections import Counter

    from dossier.functions import language

    texts = [("a", "the cat sat on the mat with the other cats"), ("b", "le chat était sur le tapis, là-bas; où ça?"), ("c", "𐐀𐐁 𐐨x 12 _ ab"), (None, "the mat"), ("a", None), ("b", " 1 é 2 "), ("a", "the"), ("c", "...")]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, lang string, text string").repartition(3)
    assert docs.select(language.words(F.col("text")).alias("w")).schema["w"].dataType.simpleString() == "string"  # a list of words before

    def grams(text):
        out = Counter()
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            out.update(f" {w} "[i : i + 3] for i in range(len(w)))
        return sorted(out, key=lambda g: (-out[g], g)), out

    summed = {}
    for lang, text in texts:
        if lang:
            summed.setdefault(lang, Counter()).update(grams(text)[1])
    want = {lang: {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], g))[:300])} for lang, c in summed.items()}
    profiles = language.learn(docs)
    assert profiles == want
    for r in language.detect(docs, profiles).collect():
        mine, n = grams(r.text)[0][:300], len(re.findall(r"[^\W\d_]+", r.text or ""))
        if not mine:
            assert (r.language, r.confidence) == ("und", 0.0)
            continue
        near = {k: (1 - sum(abs(i - p[g]) if g in p else 300 for i, g in enumerate(mine)) / (300 * len(mine))) ** 12 for k, p in want.items()}
        best = min(near, key=lambda k: (-near[k], k))
        assert abs(r.confidence - near[best] / sum(near.values())) < 1e-12 and r.language == (best if r.confidence >= (0.9 if n < 4 else 0.5) else "other")
    assert [r.language for r in language.detect(docs.where("id < 4"), {}).collect()] == ["other"] * 4
