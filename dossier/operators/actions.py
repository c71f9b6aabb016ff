"""Actions on labels: functions from (documents, rules, events) to the same (VOC13, VOC14, PIP17).

Documents are a table and stay one: an action adds an expression to each row's labels, without a join or a shuffle; how
many rows it changes is one aggregation. Rules and events are the user's own, a list of at most ``MOST_RULES``.

    archive = Archive(documents, rules)
    archive = merge(archive, "sender", "EDP Comercial", "EDP").archive

Defined cases: null labels are none; a label's writing stands for all its writings (``vocabulary.same_writing``); an
action that changes neither a rule nor a document is recorded nowhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import labels as L
from dossier.operators.vocabulary import comparison_key, key_literal, keys_of, same_writing

MOST_RULES = 200_000
#: Fixed value: the kind whose labels are the user's own.
OWN = "tag"


class LabelRefused(ValueError):
    """Why an action isn't done."""


@dataclass(frozen=True)
class Rule:
    id: int
    kind: str
    value: str
    action: str
    target: str | None = None

    def about(self, kind: str, value: str) -> bool:
        return self.kind == kind and same(self.value, value)

    def leads_to(self, value: str) -> bool:
        return self.target is not None and same(self.target, value)

    def apart(self, kind: str, a: str, b: str) -> bool:
        return self.action == "keepApart" and self.kind == kind and self.target is not None and ((same(self.value, a) and same(self.target, b)) or (same(self.value, b) and same(self.target, a)))

    def line(self) -> str:
        said = {"merge": f"“{self.value}” → “{self.target}”", "ignore": f"“{self.value}” ignored", "keepApart": f"“{self.value}” and “{self.target}” kept apart", "add": f"“{self.value}” added"}
        return f"{self.kind} {said[self.action]}"


@dataclass(frozen=True)
class Event:
    kind: str
    summary: str
    documents: int
    actor: str = "user"


@dataclass(frozen=True)
class Archive:
    """documents: doc_id, labels array<struct<kind,value>>, by_hand of the same type, tags_only boolean, and more."""

    documents: DataFrame
    rules: tuple[Rule, ...] = ()
    events: tuple[Event, ...] = field(default=())

    @classmethod
    def of(cls, documents: DataFrame, rules: DataFrame) -> Archive:
        """rules: id, kind, value, action, target."""
        rows = rules.select("id", "kind", "value", "action", "target").orderBy("id").limit(MOST_RULES + 1).collect()
        if len(rows) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        return cls(documents, tuple(Rule(*r) for r in rows))

    def rules_table(self) -> DataFrame:
        return self.documents.sparkSession.createDataFrame([(r.id, r.kind, r.value, r.action, r.target) for r in self.rules], "id long, kind string, value string, action string, target string")

    def events_table(self) -> DataFrame:
        return self.documents.sparkSession.createDataFrame([(n, e.kind, e.summary, e.documents, e.actor) for n, e in enumerate(self.events)], "seq int, kind string, summary string, documents long, actor string")

    def _with(self, gone: set[int], fresh: list[tuple], changed: dict[int, str] | None = None) -> tuple[Rule, ...]:
        """The rules without some, some with another target, and new ones with the next ids."""
        kept = [replace(r, target=(changed or {}).get(r.id, r.target)) for r in self.rules if r.id not in gone]
        following = max((r.id for r in self.rules), default=0) + 1
        return tuple(kept + [Rule(following + n, *x) for n, x in enumerate(fresh)])


@dataclass(frozen=True)
class Outcome:
    archive: Archive
    rule: Rule | None
    documents: int


def same(a: str, b: str) -> bool:
    """Whether two values at hand are one writing."""
    (na, _, ja, sa), (nb, _, jb, sb) = comparison_key(a), comparison_key(b)
    return na == nb and (ja == jb or sa == sb)


def _rewritten(labels: Column, kind: str, value: str, target: str | None) -> Column:
    """Labels with every writing of the label as target, or without it."""
    wanted = key_literal(value)
    fits = lambda x: (x["kind"] == kind) & same_writing(keys_of(x["value"]), wanted)
    if target is None:
        return F.filter(labels, lambda x: ~fits(x))
    new = F.transform(labels, lambda x: F.when(fits(x), F.struct(x["kind"].alias("kind"), F.lit(target).alias("value"))).otherwise(x))
    return F.when(F.exists(labels, fits), L.distinct_labels(new)).otherwise(labels)


def _bound(value: Column, use) -> Column:
    """use(value), in which value stands once however often it is used: actions on actions then grow by their number."""
    return F.get(F.transform(F.array(value), use), 0)


def _relabelled(documents: DataFrame, kind: str, value: str, target: str | None) -> tuple[DataFrame, int]:
    """The documents with the label written as target, or without it, and how many that changes."""
    new = lambda x: _rewritten(x, kind, value, target)
    n = documents.agg(F.count_if(_bound(F.col("labels"), lambda x: new(x) != x))).first()[0]
    return (documents.withColumns({c: _bound(F.col(c), new) for c in ("labels", "by_hand")}) if n else documents), n


def _in_use(documents: DataFrame, kind: str, value: str, any_writing: bool = False) -> int:
    """Documents that have the label, as written or in any writing."""
    wanted = key_literal(value)
    fits = (lambda x: same_writing(keys_of(x["value"]), wanted)) if any_writing else (lambda x: x["value"] == value)
    return documents.agg(F.count_if(F.exists("labels", lambda x: (x["kind"] == kind) & fits(x)))).first()[0]


def _normal(documents: DataFrame, kind: str, value: str) -> str | None:
    return documents.sparkSession.range(1).select(L.normalize(F.lit(kind), F.lit(value)).alias("v")).first()["v"]


def _named(archive: Archive, kind: str, value: str) -> str:
    """The label as its kind keeps it, or else as documents have it."""
    normal = _normal(archive.documents, kind, value)
    if normal is not None:
        return normal
    written = " ".join(value.split())
    if not _in_use(archive.documents, kind, written):
        raise LabelRefused(f"“{written}” is no {kind}")
    return written


def _target(archive: Archive, kind: str, value: str) -> str:
    normal = _normal(archive.documents, kind, value)
    if normal is None:
        raise LabelRefused(f"“{value}” is no {kind}")
    return normal


def _on(n: int, taken: bool = False) -> str:
    return "" if not n else (" and took it off " if taken else " on ") + f"{n} document{'s' * (n != 1)}"


def preview(archive: Archive, kind: str, value: str, into: str) -> tuple[int, bool]:
    """How many documents a merge or rename would change, and whether the target is in use already."""
    target, named = _target(archive, kind, into), _named(archive, kind, value)
    if named == target:
        raise LabelRefused(f"{kind} “{named}” is written so")
    return _relabelled(archive.documents, kind, named, target)[1], _in_use(archive.documents, kind, target) > 0


def merge(archive: Archive, kind: str, value: str, into: str, said: str = "Merged", actor: str = "user", because: str = "") -> Outcome:
    """The label is written as the target on every document and from now on.

    The rules it ends go: those about the label, those that drop the target or lead it back, and the one that keeps both
    apart. What was merged into the label follows it; a label that was added stays listed, as the target.
    """
    target, named = _target(archive, kind, into), _named(archive, kind, value)
    if named == target:
        raise LabelRefused(f"{kind} “{named}” is written so")
    over = {
        r.id for r in archive.rules
        if (r.action != "keepApart" and r.about(kind, named)) or (r.about(kind, target) and (r.action == "ignore" or (r.action == "merge" and r.leads_to(named)))) or r.apart(kind, named, target)
    }
    follow = {r.id: target for r in archive.rules if r.id not in over and r.action == "merge" and r.kind == kind and r.leads_to(named) and not r.about(kind, target)}
    fresh = []
    if any(r.id in over and r.action == "add" for r in archive.rules) and not any(r.action == "add" and r.about(kind, target) for r in archive.rules):
        fresh.append((kind, target, "add"))
    rules = archive._with(over, [*fresh, (kind, named, "merge", target)], follow)
    documents, n = _relabelled(archive.documents, kind, named, target)
    decided = lambda some: sorted((r.kind, r.value, r.action, r.target or "") for r in some)
    if not n and decided(rules) == decided(archive.rules):
        return Outcome(archive, next(r for r in archive.rules if r.action == "merge" and (r.kind, r.value, r.target) == (kind, named, target)), 0)
    event = Event("labelsMerged", f"{said} {kind} “{named}” {'to' if said == 'Renamed' else 'into'} “{target}”{_on(n)}{because}", n, actor)
    return Outcome(Archive(documents, rules, (*archive.events, event)), rules[-1], n)


def rename(archive: Archive, kind: str, value: str, to: str) -> Outcome:
    """A merge into a writing of the user's choosing."""
    return merge(archive, kind, value, to, said="Renamed")


def ignore(archive: Archive, kind: str, value: str) -> Outcome:
    """The label goes off every document and isn't read again."""
    named = _named(archive, kind, value)
    rules = archive._with({r.id for r in archive.rules if r.action != "keepApart" and r.about(kind, named)}, [(kind, named, "ignore")])
    documents, n = _relabelled(archive.documents, kind, named, None)
    event = Event("labelIgnored", f"Ignored {kind} “{named}”{_on(n, taken=True)}", n)
    return Outcome(Archive(documents, rules, (*archive.events, event)), rules[-1], n)


def remove(archive: Archive, kind: str, value: str) -> Outcome:
    """The label goes off every document; a later reading may give it again. A label that was added goes with its rule."""
    named = _named(archive, kind, value)
    added = [r for r in archive.rules if r.action == "add" and r.about(kind, named)]
    documents, n = _relabelled(archive.documents, kind, named, None)
    if not n and not added:
        return Outcome(archive, None, 0)
    event = Event("labelRemoved", f"Removed {kind} “{named}”" + (f" from {n} document{'s' * (n != 1)}" if n else ""), n)
    return Outcome(Archive(documents, archive._with({r.id for r in added}, []), (*archive.events, event)), added[0] if added else None, n)


def add(archive: Archive, kind: str, value: str) -> Outcome:
    """A tag of the user's own is listed, whether or not a document has it; one that was ignored is wanted again."""
    if kind != OWN:
        raise LabelRefused(f"a {kind} can't be added")
    named = _target(archive, kind, value)
    if any(r.action == "add" and r.about(kind, named) for r in archive.rules) or _in_use(archive.documents, kind, named, any_writing=True):
        raise LabelRefused(f"{kind} “{named}” is there")
    rules = archive._with({r.id for r in archive.rules if r.action == "ignore" and r.about(kind, named)}, [(kind, named, "add")])
    return Outcome(Archive(archive.documents, rules, (*archive.events, Event("labelAdded", f"Added {kind} “{named}”", 0))), rules[-1], 0)


def keep_apart(archive: Archive, kind: str, value: str, other: str, actor: str = "user", because: str = "") -> Outcome:
    """Two labels mean different things: a merge between them ends, and the rule is made once."""
    a, b = _named(archive, kind, value), _named(archive, kind, other)
    if same(a, b):
        raise LabelRefused(f"{kind} “{a}” is one label")
    ended = {r.id for r in archive.rules if r.action == "merge" and ((r.about(kind, a) and r.leads_to(b)) or (r.about(kind, b) and r.leads_to(a)))}
    there = next((r for r in archive.rules if r.apart(kind, a, b)), None)
    if there and not ended:
        return Outcome(archive, there, 0)
    rules = archive._with(ended, [] if there else [(kind, a, "keepApart", b)])
    event = Event("labelsKeptApart", f"Kept {kind} “{a}” and “{b}” apart{because}", 0, actor)
    return Outcome(Archive(archive.documents, rules, (*archive.events, event)), there or rules[-1], 0)


def forget(archive: Archive, rule_id: int) -> Outcome:
    """A rule is followed no longer; what it changed stays."""
    rule = next((r for r in archive.rules if r.id == rule_id), None)
    if rule is None:
        raise LabelRefused(f"no rule {rule_id}")
    return Outcome(Archive(archive.documents, archive._with({rule_id}, []), (*archive.events, Event("labelRuleForgotten", f"Forgot: {rule.line()}", 0))), rule, 0)


def decide(archive: Archive, kind: str, value: str, into: str, judgement: str) -> Outcome | None:
    """VOC14: what a model judged of two alike labels: the same merge into the one of more documents, others stay apart.

    Nothing is done, and null returned, if either is on no document, or a rule rewrites either or keeps them apart.
    """
    counts = [_in_use(archive.documents, kind, v) for v in (value, into)]
    decided = any(r.apart(kind, value, into) or (r.action in ("merge", "ignore") and (r.about(kind, value) or r.about(kind, into))) for r in archive.rules)
    if not all(counts) or decided:
        return None
    if judgement != "same":
        return keep_apart(archive, kind, value, into, "system", ", which the model judged different")
    source, target = (into, value) if counts[0] > counts[1] else (value, into)
    return merge(archive, kind, source, target, actor="system", because=", which the model judged the same")
