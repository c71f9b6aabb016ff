"""The similarity join and the alignment against all pairs."""

import itertools
import random

import pytest

from dossier.operators import vocabulary as V

WORDS = "energia comercial agua silva maria banco norte sul lisboa porto seguros gas luz casa nova martha marhta dwayne duane dixon dicksonx".split()


def labels_of(seed, n):
    rnd = random.Random(seed)
    out = ["", "-", "a", "b", "ab", "ba", "S.A.", "sa", "s a", "FT 1/23", "FT 12/3", "FT 123", "ft-1.23", "Ünited", "united", "x" * 80, "x" * 79 + "y", "日本 電力", "日本電力", "a b c d e f", "f e d c b a"]
    for _ in range(n):
        some = " ".join(rnd.sample(WORDS, rnd.randint(1, 4)))
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randrange(len(some))
            some = rnd.choice([some[:at] + rnd.choice("abcxyz ") + some[at:], some[:at] + some[at + 1 :], some[:at] + some[at : at + 2][::-1] + some[at + 2 :]])
        out.append(some + rnd.choice(["", "", "", " 7", " 1/2", " 12"]))
    return sorted(set(out))


def similar(a, b):
    (na, _, ja, sa), (nb, _, jb, sb) = V.comparison_key(a), V.comparison_key(b)
    return 0.0 if na != nb else 1.0 if ja == jb or sa == sb else V.jaro_winkler(sa, sb)


@pytest.mark.parametrize("bar", [0.5, 0.7, 0.85, 0.9, 0.96, 1.0])
def test_every_alike_pair_is_found(spark, bar):
    values = labels_of(int(bar * 100), 220)
    table = spark.createDataFrame([("topic", v) for v in values] + [("sender", values[0]), ("topic", None)], "kind string, value string")
    found = {(r.a, r.b): r.similarity for r in V.look_alikes(table, thresholds={"topic": (1.0, bar)}).where("NOT regrouping").collect()}
    want = {p: s for p in itertools.combinations(values, 2) if (s := similar(*p)) >= bar}
    assert found.keys() == want.keys()
    assert found == pytest.approx(want)


def test_regrouped_pairs_and_fresh_labels(spark):
    values = ["FT 1/23", "FT 12/3", "FT 1/2/3", "FT 123", "no digits", "V/2026/532774", "V2026532774"]
    table = spark.createDataFrame([("reference", v) for v in values], "kind string, value string")
    keys = {v: V.comparison_key(v) for v in values}

    def ends(numbers):
        return set(itertools.accumulate(map(len, numbers)))

    want = {p for p in itertools.combinations(sorted(values), 2) if keys[p[0]][1] == keys[p[1]][1] != "" and keys[p[0]][0] != keys[p[1]][0] and (ends(keys[p[0]][0]) <= ends(keys[p[1]][0]) or ends(keys[p[1]][0]) <= ends(keys[p[0]][0]))}
    assert {(r.a, r.b) for r in V.look_alikes(table).where("regrouping").collect()} == want
    fresh = spark.createDataFrame([("reference", "FT 123")], "kind string, value string")
    assert {(r.a, r.b) for r in V.look_alikes(table, fresh).where("regrouping").collect()} == {p for p in want if "FT 123" in p}


def test_alignment_is_that_of_all_pairs(spark):
    rnd, values = random.Random(3), labels_of(5, 150)
    used = {v: rnd.randint(1, 5) for v in values[::2]}
    apart = [(a, b) for a, b in itertools.combinations(values, 2) if 0.96 <= similar(a, b) < 1][:3]
    bar = 0.9
    want = {}
    for v in values:
        own = used.get(v)
        best = max(((s, n, into) for into, n in used.items() if into != v and n > (own or 0) and (s := similar(v, into)) >= (bar if own is None else 1.0) and (v, into) not in apart and (into, v) not in apart), key=lambda x: (x[0], x[1], [-ord(c) for c in x[2]]), default=None)
        if best:
            want[v] = best[:2]
    table = spark.createDataFrame([("topic", v) for v in values], "kind string, value string")
    usage = spark.createDataFrame([("topic", v, n) for v, n in used.items()], "kind string, value string, documents long")
    rules = spark.createDataFrame([("topic", a, "keepApart", b) for a, b in apart], "kind string, value string, action string, target string")
    found = {r.value: (pytest.approx(similar(r.value, r.into)), used[r.into]) for r in V.align(table, usage, rules, {"topic": (bar, bar)}).collect()}
    assert found == want


def test_candidates_are_few_and_bars_are_bounded(spark):
    """Digit-free labels don't all meet: the candidates are a small part of all pairs."""
    rnd = random.Random(9)
    values = sorted({"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(5, 14))) for _ in range(600)})
    table = spark.createDataFrame([("object", v) for v in values], "kind string, value string").withColumn("k", V.keys_of("value"))
    assert V.alike_candidates(table, table, V.F.lit(0.94)).count() < len(values) ** 2 / 100
    with pytest.raises(Exception, match="above 0.45"):
        V.alike_candidates(table, table, V.F.lit(0.3)).count()
