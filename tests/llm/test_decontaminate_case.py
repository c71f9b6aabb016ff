"""Decontamination of copies in other cases and with other values."""

import pytest

pytest.importorskip("dossier.llm")

from dossier.llm import decontaminate


def test_copies_in_any_case_and_values_that_become_equal(spark):
    item = "A train leaves the old station at 12 km per hour and Anna reaches Paris after it has passed 15 small towns on its way"
    texts = [item.upper(), item.title(), item.lower(), item.upper().replace("12", "45"), item.replace("15", "12"), item.replace("12", "45").replace("Paris", "Rome"), "NOTHING OF THE KIND IS IN THIS TEXT AT ALL I SAY", item.upper().replace("STATION", "X").replace("HOUR", "Y").replace("TOWNS", "Z")]
    docs, items = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(0, item)], "item_id long, text string")
    for limit in (0, 1000):
        assert sorted(r.doc_id for r in decontaminate.leaks(docs, items, broadcast_rows=limit).collect()) == [0, 1, 2, 3, 4, 5]
