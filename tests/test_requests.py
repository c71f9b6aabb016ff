"""Budgets, plans from answers and layout cells."""

from pyspark.sql import functions as F

from dossier.plans import requests as R


def test_budget():
    assert R.within_budget([("rules", "r" * 10, 0), ("text", "t" * 50, 2), ("labels", "l" * 10, 1)], 30) == {"rules": "r" * 10, "text": "t" * 10, "labels": "l" * 10}
    assert R.within_budget([("rules", "r" * 10, 0), ("text", "t" * 5, 2), ("labels", "l" * 10, 1)], 12) == {"rules": "r" * 10, "text": "", "labels": "ll"}


def test_plan_of_answer():
    answer = '{"labels":[{"kind":"sender","value":"EDP","quote":"edp"},{"kind":"type","value":"bill","quote":"invoice"},{"kind":"x","value":"y","quote":"edp"}],"words":["faturas","zebra"],"grouping":["type","no","sender"]}'
    plan, notes = R.plan_of_answer(answer, "All EDP bills with fatura in them")
    assert plan.labels == [("sender", "EDP")] and plan.words == ["faturas"] and plan.grouping == ["type", "sender"] and notes == ["unquoted", "unknownKind", "unsaidWord"]
    assert R.plan_of_answer("?", "x")[1] == ["unreadable"]


def test_cells(spark):
    row = spark.createDataFrame([("Invoice no:\t12/3\nDate\n2025-01-02\nEDP\tMaria Silva",)], "t string")
    got = row.select(R.field_value(F.col("t"), "invoice no"), R.field_value(F.col("t"), "date"), R.field_value(F.col("t"), "nothing"), R.cut_to_cell(F.lit("EDP Maria Silva"), F.lit("EDP"), F.col("t"))).first()
    assert tuple(got) == ("12/3", "2025-01-02", None, "Maria Silva")
