"""Plans of answers by examples."""

import json

import pytest
from pyspark.sql import functions as F

from dossier.plans.answers import checked_plan, inflected


def plan(spark, answer, request, question=None):
    frame = spark.createDataFrame([(json.dumps(answer, ensure_ascii=False) if isinstance(answer, dict) else answer, request, question)], "a string, r string, q string")
    return frame.select(checked_plan(F.col("a"), F.col("r"), F.col("q") if question else None).alias("p")).first().p


def label(kind, value, quote):
    return {"kind": kind, "value": value, "quote": quote}


def test_inflected_words(spark):
    pairs = [("invoice", "invoices"), ("fatura", "faturas"), ("квитанции", "квитанция"), ("invoice", "insurance"), ("receipt", "recibo"), ("ab", "abc")]
    found = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(inflected(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in found] == [True, True, True, False, False, False]


def test_a_quote_over_other_labels_is_asked_again(spark):
    request = "квитанции за электричество 2026 года, по отправителю"
    answer = {"labels": [label("sender", "Мосэнергосбыт", "квитанции за электричество"), label("type", "invoice", "квитанции"), label("topic", "electricity", "электричество"), label("date", "2026", "2026 года")], "words": [], "grouping": [{"kind": "sender", "quote": "по отправителю"}]}
    found = plan(spark, answer, request)
    assert found.asked_again == ["spanning:Мосэнергосбыт"] and found.grouping == ["sender"] and ("date", "2026") in [tuple(x) for x in found.labels]


def test_words_among_alternatives_are_asked_again(spark):
    topics = lambda *some: [label("topic", x, x) for x in some]
    request = "invoices and receipts about electricity water gas internet phone insurance taxes rent from Portugal mentioning meter"
    found = plan(spark, {"labels": [*topics("electricity", "water", "gas", "internet", "phone"), label("jurisdiction", "Portugal", "Portugal")], "words": ["insurance", "taxes", "rent", "meter"]}, request)
    assert found.asked_again == ["alternative:insurance", "alternative:taxes", "alternative:rent"]
    between = plan(spark, {"labels": [label("type", "invoice", "bills"), *topics("electricity", "water", "rent")], "words": ["insurance"]}, "bills for electricity, water, insurance or rent")
    assert between.asked_again == ["alternative:insurance"]
    single = plan(spark, {"labels": topics("electricity"), "words": ["meter"]}, "electricity meter readings")
    assert single.words == ["meter"] and single.asked_again == []


@pytest.mark.parametrize(
    ("request_", "senders", "kind", "word"),
    [
        ("invoices from EDP or Galp with penalty", [("EDP Comercial", "EDP"), ("Galp Energia", "Galp")], "invoices", "penalty"),
        ("faturas da EDP e da Galp que falam da multa da luz", [("EDP Comercial", "da EDP"), ("Galp Energia", "da Galp")], "faturas", "multa"),
    ],
)
def test_a_word_near_alternatives_stays(spark, request_, senders, kind, word):
    found = plan(spark, {"labels": [*[label("sender", v, q) for v, q in senders], label("type", "invoice", kind)], "words": [word]}, request_)
    assert found.words == [word] and found.asked_again == [] and [x.value for x in found.labels if x.kind == "sender"] == ["EDP Comercial", "Galp Energia"]


def test_kinds_the_question_does_not_name(spark):
    answer = {"labels": [label("type", "attestation", "attestations"), label("type", "medical-report", "medical reports"), label("topic", "dental care", "dental")]}
    request = "dental attestations or medical reports"
    assert plan(spark, answer, request, "do I have anything about the dentist?").asked_again == ["unnamed:attestation", "unnamed:medical-report"]
    assert plan(spark, answer, request, "any attestation, or a medical report?").asked_again == [] and plan(spark, answer, request).asked_again == []


def test_what_the_request_does_not_bear_out_goes(spark):
    answer = {
        "labels": [label("sender", "EDP", "EDP"), label("party", "EDP", "EDP"), label("topic", "gas", "unsaid"), label("colour", "red", "EDP"), label("date", "soon", "EDP"), label("sender", "edp", "EDP"), label("type", "order", "by type")],
        "words": ["contracts", "EDP", "elsewhere", "by type", "Contracts", "type"], "grouping": [{"kind": "type", "quote": "by type"}, {"kind": "tag", "quote": "x"}, {"kind": "type", "quote": ""}],
    }
    found = plan(spark, answer, "contracts of EDP by type")
    assert [tuple(x) for x in found.labels] == [("sender", "EDP")] and found.words == ["contracts", "type"] and found.grouping == ["type"] and found.asked_again == ["arranging:type"]
    assert sorted(found.notes) == ["askedForByALabel:EDP", "askedForByAnother:EDP", "notOfItsKind:soon", "onlyArranges:by type", "onlyArranges:order", "unknownKind:red", "unquoted:gas", "unsaid:elsewhere"]
    assert plan(spark, "no json", "x") is None and plan(spark, {"words": None, "labels": []}, "x").words == []


def test_values_that_are_used_again_are_bound(spark):
    # The request's and each quote's and word's tokens are cut at one place of the expression, not wherever they are compared.
    found = checked_plan(F.col("a"), F.col("r"), F.col("q"))
    assert str(found._jc.toString()).count("regexp_extract_all") <= 6 and str(found._jc.toString()).count("from_json") == 1
