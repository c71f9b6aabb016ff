"""Actions on labels: documents, rules and events after each."""

import pytest

from dossier.operators import actions as A

LABELS = "array<struct<kind:string,value:string>>"


@pytest.fixture(scope="module")
def archive(spark):
    rows = [
        (1, [("sender", "EDP Comercial, S.A."), ("topic", "energy")], [("sender", "EDP Comercial, S.A.")], False),
        (2, [("sender", "EDP"), ("sender", "edp comercial SA")], [], False),
        (3, [("topic", "Energy"), ("tag", "house")], [("tag", "house")], False),
        (4, None, None, None),
        (5, [("sender", "Galp"), ("party", "EDP Comercial S.A.")], [], False),
    ]
    return A.Archive(spark.createDataFrame(rows, f"doc_id long, labels {LABELS}, by_hand {LABELS}, tags_only boolean"))


def labels(archive, doc):
    row = archive.documents.where(f"doc_id = {doc}").first()
    return [tuple(x) for x in row.labels], [tuple(x) for x in row.by_hand]


def rules(archive):
    return [(r.kind, r.value, r.action, r.target) for r in archive.rules]


def test_merge_of_every_writing(archive):
    assert A.preview(archive, "sender", "EDP Comercial SA", "EDP") == (2, True)
    done = A.merge(archive, "sender", "EDP Comercial SA", "EDP")
    assert done.documents == 2 and labels(done.archive, 1) == ([("sender", "EDP"), ("topic", "energy")], [("sender", "EDP")])
    assert labels(done.archive, 2)[0] == [("sender", "EDP")] and ("party", "EDP Comercial S.A.") in labels(done.archive, 5)[0]
    assert rules(done.archive) == [("sender", "EDP Comercial SA", "merge", "EDP")]
    assert [e.summary for e in done.archive.events] == ["Merged sender “EDP Comercial SA” into “EDP” on 2 documents"]
    again = A.merge(done.archive, "sender", "EDP Comercial SA", "EDP")
    assert again.archive is done.archive and again.rule == done.rule
    with pytest.raises(A.LabelRefused):
        A.merge(archive, "sender", "EDP", "EDP")


def test_rules_follow_a_rename_and_end_with_what_they_contradict(archive):
    first = A.merge(archive, "sender", "EDP Comercial SA", "EDP").archive
    second = A.rename(first, "sender", "EDP", "Energias de Portugal").archive
    assert rules(second) == [("sender", "EDP Comercial SA", "merge", "Energias de Portugal"), ("sender", "EDP", "merge", "Energias de Portugal")]
    assert second.events[-1].summary == "Renamed sender “EDP” to “Energias de Portugal” on 2 documents"
    back = A.merge(second, "sender", "Energias de Portugal", "EDP").archive
    assert rules(back) == [("sender", "EDP Comercial SA", "merge", "EDP"), ("sender", "Energias de Portugal", "merge", "EDP")]
    apart = A.keep_apart(back, "sender", "EDP", "Energias de Portugal")
    assert rules(apart.archive) == [("sender", "EDP Comercial SA", "merge", "EDP"), ("sender", "EDP", "keepApart", "Energias de Portugal")]
    assert A.keep_apart(apart.archive, "sender", "Energias de Portugal", "edp").archive is apart.archive
    merged = A.merge(apart.archive, "sender", "EDP", "Energias de Portugal").archive
    assert [r[2] for r in rules(merged)] == ["merge", "merge"] and rules(merged)[0][3] == "Energias de Portugal"
    with pytest.raises(A.LabelRefused):
        A.keep_apart(back, "sender", "EDP", "e.d.p")


def test_ignore_remove_add_forget(archive):
    gone = A.ignore(archive, "topic", "ENERGY")
    assert gone.documents == 2 and labels(gone.archive, 1)[0] == [("sender", "EDP Comercial, S.A.")]
    assert gone.archive.events[-1].summary == "Ignored topic “ENERGY” and took it off 2 documents"
    assert rules(A.merge(gone.archive, "topic", "power", "Energy").archive) == [("topic", "power", "merge", "Energy")]
    removed = A.remove(archive, "tag", "House")
    assert removed.documents == 1 and removed.rule is None and labels(removed.archive, 3) == ([("topic", "Energy")], [])
    assert A.remove(archive, "topic", "unheard of").archive is archive
    with pytest.raises(A.LabelRefused):
        A.add(archive, "tag", "HOUSE")
    with pytest.raises(A.LabelRefused):
        A.add(archive, "sender", "New")
    added = A.add(A.ignore(archive, "tag", "garden").archive, "tag", "garden").archive
    assert rules(added) == [("tag", "garden", "add", None)]
    moved = A.merge(added, "tag", "garden", "yard").archive
    assert [r[1:3] for r in rules(moved)] == [("yard", "add"), ("garden", "merge")]
    assert A.remove(moved, "tag", "yard").rule.action == "add"
    forgotten = A.forget(moved, moved.rules[-1].id)
    assert rules(forgotten.archive) == [("tag", "yard", "add", None)] and forgotten.archive.events[-1].summary == "Forgot: tag “garden” → “yard”"
    with pytest.raises(A.LabelRefused):
        A.forget(moved, 99)


def test_judgements_are_acted_on_once(archive):
    done = A.decide(archive, "sender", "Galp", "EDP", "different")
    assert rules(done.archive) == [("sender", "Galp", "keepApart", "EDP")] and done.archive.events[-1].actor == "system"
    assert A.decide(done.archive, "sender", "EDP", "Galp", "same") is None and A.decide(archive, "sender", "Galp", "No one", "same") is None
    merged = A.decide(archive, "topic", "energy", "Energy", "same")
    assert merged.documents >= 1
    table = A.Archive.of(merged.archive.documents, merged.archive.rules_table())
    assert table.rules == merged.archive.rules and merged.archive.events_table().count() == 1


def test_folded_groups_by_hand(spark):
    from dossier.plans import tasks

    rows = [(1, "EDP", "2024"), (2, "edp", "2023"), (3, "E.D.P", None), (4, "file 10", "2024"), (5, "file 9", "2024"), (6, None, "2020"), (7, None, None), (8, "—", None)]
    docs = spark.createDataFrame(rows, "doc_id long, s string, d string")
    found = tasks.folded_groups(docs, [("sender", "s"), ("date", "d")]).orderBy("place").collect()
    assert [(r.depth, r.sender, r.date, r.documents) for r in found] == [
        (1, "—", None, 1), (2, "—", None, 1), (1, "E.D.P", None, 1), (2, "E.D.P", None, 1), (1, "EDP", None, 2), (2, "EDP", "2024", 1), (2, "EDP", "2023", 1),
        (1, "file 9", None, 1), (2, "file 9", "2024", 1), (1, "file 10", None, 1), (2, "file 10", "2024", 1), (1, None, None, 2), (2, None, "2020", 1), (2, None, None, 1),
    ]
