"""The training-data operators against brute force, and in the cases that their docstrings define."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest

pytest.importorskip("dossier.llm")

import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F

from dossier.llm import bpe, decontaminate, langid, lm, outliers, quality, simhash, substrings, toxicity, urls
from dossier.llm.common import labelled, remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tk string, row string, at int"
VOCABULARY = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def rows_of(texts, start=0):
    return [(start + i, t, "en", "s", len(t) if t is not None else None, "x", "y", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"w{i % 977} x{i % 31}." for i in range(30_000))
    texts = [None, "", "  \n\t ", "one", "a b c d", long, long, "İstanbul straße \x1c  two  spaces \n\n x", "é" * 3000, "12 34 " * 400, "word " * 500]
    rows = rows_of(texts) + rows_of([long])[:1] + [(5, long, "en", "s", 1, "x", "y", 1), (None, long, None, None, None, None, None, None), (3, "other text of the same id", "en", "s", 1, "x", "y", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_repeats(docs, window):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = collections.Counter()
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out[d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()] += 1
    return out


@pytest.mark.parametrize("crowd", [1, 8192])
def test_substrings_are_those_of_brute_force(spark, crowd):
    rng = np.random.default_rng(1)
    shared = [" ".join(f"p{j}_{i}" for i in range(90)) for j in range(3)]
    texts = []
    for k in range(60):
        own = " ".join(f"u{rng.integers(0, 4000)}" for _ in range(int(rng.integers(0, 120))))
        texts.append(f"{own} {shared[k % 3]} end{k} {own}" if k % 2 else own)
    texts[7] = texts[3]
    docs = list(enumerate(texts)) + [(None, texts[3]), (3, texts[3]), (9, None)]
    found = substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), crowd=crowd).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == brute_repeats(docs, 50)


def test_substrings_of_hard_and_empty_tables(hard, none):
    found = substrings.remove_repeats(hard)
    assert found.columns == [*hard.columns, "n_words", "n_removed", "kept"]
    by = {r.doc_id: r for r in found.collect()}
    assert by[6].n_removed == by[6].n_words == 60_000 and by[None].n_removed == 0
    assert substrings.remove_repeats(none).count() == 0


def brute_scores(docs, order, backoff=0.4):
    """Stupid backoff over word n-grams, each counted without the occurrence that is scored."""
    split = [(d, lm.folded(t or "").split()) for d, t in docs]
    seen = collections.Counter(tuple(x[i : i + n]) for _, x in split for n in range(1, order + 1) for i in range(len(x) - n + 1))
    total = sum(v for k, v in seen.items() if len(k) == 1)
    out = []
    for d, x in split:
        s = 0.0
        for i in range(len(x)):
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(x[i + 1 - n : i + 1])
                if n == 1:
                    s += math.log10(max(seen[g] - 1, 0.5) / max(total - 1, 1) * backoff ** (order - 1))
                elif seen[g] > 1:
                    s += math.log10((seen[g] - 1) / (seen[g[:-1]] - 1) * backoff ** (order - n))
                    break
        out.append((d, len(x), round(s, 6) if x else None))
    return sorted(map(str, out))


@pytest.mark.parametrize(("order", "batch_words"), [(1, 10), (2, 10), (3, 1_000_000), (4, 1)])
def test_lm_scores_are_those_of_brute_force(spark, order, batch_words):
    docs = [(0, "the cat sat on the mat"), (1, "The cat ran.\nThe dog sat"), (2, ""), (3, None), (4, "zzz"), (4, "the cat sat on the mat"), (5, "\x0b on  the\tmat the cat sat "), (6, "größe größe größe")]
    found = lm.scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), order=order, batch_words=batch_words).collect()
    assert brute_scores(docs, order) == sorted(str((r.doc_id, r.n_words, r.log10_sum if r.log10_sum is None else round(r.log10_sum, 6))) for r in found)


def test_lm_scores_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = lm.scores(docs, batch_words=5000).collect()
    assert brute_scores(list(map(tuple, docs.collect())), 3) == sorted(str((r.doc_id, r.n_words, r.log10_sum if r.log10_sum is None else round(r.log10_sum, 6))) for r in found)


def test_lm_of_hard_and_empty_tables(hard, none):
    assert lm.scores(hard).count() == hard.count() and lm.scores(none).count() == 0


def test_bpe_is_that_of_the_library(hard, none):
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
    want = collections.Counter()
    for r in hard.collect():
        ids, text = other.encode_ordinary(r.text or ""), (r.text or "").encode()
        want[r.doc_id, len(ids), ",".join(map(str, ids)), text] += 1
    found = bpe.encode_decode(hard, VOCABULARY, keep=["doc_id"], batch_bytes=1 << 20).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, ",".join(map(str, r.ids)), bytes(r.decoded)) for r in found) == want
    digest = bpe.encode_decode(hard, VOCABULARY, digests=True).where("doc_id = 4").first()
    assert digest.decoded_sha256 == hashlib.sha256(b"a b c d").hexdigest() and digest.tk == "x"
    assert bpe.encode_decode(none, VOCABULARY).count() == 0


def test_heap_and_fold_agree(spark):
    words = [b"", b"a", b" thing", "größe".encode(), b"=" * 90, b"abcabcabcabd" * 6, bytes(range(128, 200))]
    frame = spark.createDataFrame([(w,) for w in words], "word binary")
    for r in frame.select("word", bpe.fold_encode(F.col("word"), VOCABULARY).alias("ids")).collect():
        assert list(r.ids) == (bpe.heap_encode(bytes(r.word), VOCABULARY.ranks) if r.word else []), r.word


def test_a_piece_is_made_of_one_pair_in_the_plan(spark):
    # The driver describes plans with their literals: one pair a piece, and pieces of one character a byte.
    ranks = VOCABULARY.ranks
    assert len(VOCABULARY.pairs()._jc.toString()) < 30 * len(ranks) and len(VOCABULARY.pieces()._jc.toString()) < sum(map(len, ranks)) + 10 * len(ranks)


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def test_url_rules_and_templates(spark):
    cases = [
        ("https://A.Example.com/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"), ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"), ("x://com", "com", "", None, "allow"),
        ("http://y.net/es/2", "y.net", "/es/2", "net/es/", "block"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://h?q://z/", "h", "", None, "allow"), ("http://snet/es/", "snet", "/es/", None, "allow"),
    ]
    found = {r.n: r for r in urls.judge(spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "n int, url string, rule string"), RULES).collect()}
    assert [(found[i].host, found[i].path, found[i].rule, found[i].verdict) for i in range(len(cases))] == [c[1:] for c in cases]
    # A path whose labelled urls are blocked is learned for urls that no rule reaches.
    rows = [(f"http://h.org/bad/{i}",) for i in range(40)] + [(f"http://h.org/good/{i}",) for i in range(40)]
    rules = [("block", f"h.org/bad/{i}") for i in range(10, 30)] + [("allow", f"h.org/good/{i}") for i in range(10, 30)]
    got = urls.judge(spark.createDataFrame(rows, "url string"), rules).where("rule IS NULL").groupBy("template", "verdict").count().collect()
    assert {(r.template, r.verdict) for r in got} == {("/bad/*", "block"), ("/good/*", "allow")}
    assert urls.judge(spark.createDataFrame([], "url string"), RULES).count() == 0


def brute_templates(paths, support, share, differ):
    """{(host, path): template} of (host, path, n, blocked, allowed), node by node."""
    ln = lambda *some: sum(n * math.log(n) for n in some if n)
    out = {}

    def open_node(host, template, level, rows):
        if not rows:
            return
        for r in [r for r in rows if len(r[1]) <= level]:
            out[host, r[0]] = template
        going = [r for r in rows if len(r[1]) > level]
        if len(rows) < support:
            out.update({(host, r[0]): template + "/**" for r in going})
            return
        total, names = sum(r[2] for r in rows), collections.defaultdict(lambda: [0, 0, 0])
        digits = lambda s: s[:1].isdigit() and bool(re.match(r"^[0-9]+(\.[A-Za-z0-9]+)?$", s))
        for r in going:
            if not digits(r[1][level]):
                for k in range(3):
                    names[r[1][level]][k] += r[2 + k]
        kept = sorted((v[1] / v[0], v[2] / v[0], name, v) for name, v in names.items() if v[0] >= max(support, total * share))
        groups = []
        for *_, name, (n, b, a) in kept:
            mine = (n, (b, a, n - a - b), name)
            if groups:
                m, other, _ = groups[-1][-1]
                g = 2 * (ln(*mine[1]) + ln(*other) - ln(*[x + y for x, y in zip(mine[1], other, strict=True)]) - ln(n, m) + ln(n + m))
            if not groups or g > differ:
                groups.append([])
            groups[-1].append(mine)
        token = {}
        for some in groups:
            least = min(x[2] for x in some)
            token.update({x[2]: x[2] if len(some) == 1 else f"<{least}+{len(some) - 1}>" for x in some})
        below = collections.defaultdict(list)
        for r in going:
            below[token.get(r[1][level], "*")].append(r)
        for name, some in below.items():
            open_node(host, f"{template}/{name}", level + 1, some)

    by_host = collections.defaultdict(list)
    for host, path, n, b, a in paths:
        by_host[host].append((path, path.removeprefix("/").split("/"), n, b, a))
    for host, rows in by_host.items():
        open_node(host, "", 0, rows)
    return out


def test_url_templates_are_those_of_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = {}
    for _ in range(1500):
        parts = [str(rng.choice(["en", "de", "fr", "shop", "spam", f"u{rng.integers(0, 300)}", str(rng.integers(0, 99)), "x.html", "7.html", ""])) for _ in range(int(rng.integers(0, 6)))]
        blocked = "spam" in parts and rng.random() < 0.8
        host = str(rng.choice(["a.org", "a.org", "b.org", ""]))
        n = int(rng.integers(1, 4))
        rows[host, "/" + "/".join(parts)] = (n, n if blocked else 0, 0 if blocked or rng.random() < 0.5 else n)
    rows["deep.org", "/" + "/".join(["d"] * 4000)] = (9, 0, 0)
    paths = [(*k, *v) for k, v in rows.items()]
    frame = spark.createDataFrame(paths, "host string, path string, n long, blocked long, allowed long")
    found = {(r.host, r.path): r.template for r in urls.templates(frame).collect()}
    assert found == brute_templates(paths, 5, 0.02, 9.21)


def test_language_codes(spark, sf_dir, none, hard):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held", remainder(F.col("doc_id"), 4) == 2)
    found = langid.predict(docs.where("held"), langid.train(docs.where("NOT held")))
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert right >= 0.93 * n
    model = langid.train(none)
    assert {r.lang_pred for r in langid.predict(hard, model).collect()} == {"und"}
    one = langid.predict(hard, langid.train(hard)).collect()
    assert {r.lang_pred for r in one if (r.text or "").strip(" \n\t0123456789") == ""} == {"und"} and all(0 <= r.score <= 1 for r in one)
    assert langid.codewords(12).shape[0] == 12 and len({tuple(c) for c in langid.codewords(12)}) == 12


def brute_components(fps, distance):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("crowd", [4, 16384])
def test_simhash_links_are_all_found(spark, crowd):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = []
    for b in base:
        at = int(b)
        for _ in range(int(rng.integers(1, 12))):
            fps.append(at)
            for _ in range(int(rng.integers(1, 6))):
                at ^= 1 << int(rng.integers(0, 64))
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, first long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, 4, crowd)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == brute_components(fps, 4)


def test_bucket_groups_with_levels():
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate([rng.integers(0, 2**63, 1500, dtype=np.uint64), np.uint64(7) << np.arange(60, dtype=np.uint64)]))
    got = simhash.bucket_groups(fps, 4)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = np.arange(len(fps))
    while True:
        fresh = np.where(near, want[None, :], len(fps)).min(1)
        if (fresh == want).all():
            break
        want = fresh
    assert (got == want).all()


def test_components_of_a_long_chain(spark):
    """More rounds than a fixed number would allow for, and a star of many nodes."""
    edges = [(i, i + 1) for i in range(3000)] + [(10_000, 20_000 + i) for i in range(5000)]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(3001)) and all(roots[20_000 + i] == 10_000 for i in range(5000))


def test_language_codes_of_many_languages(spark):
    """More languages than any cap, each with words of its own; weights are those of one table of counts."""
    rng = np.random.default_rng(0)
    words = {f"l{k:03}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(12)] for k in range(270)}
    rows = [(" ".join(rng.choice(w, 20)), lang) for lang, w in words.items() for _ in range(2)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = langid.train(docs)
    assert len(model.languages) == 270
    few = spark.createDataFrame([(" ".join(rng.choice(w, 20)), lang) for lang, w in words.items()], "text string, lang string")
    right = langid.predict(few, model).where("lang = lang_pred").count()
    assert right >= 0.95 * 270
    counts = np.zeros((270, model.slots))
    for text, lang in rows:
        counts[model.languages.index(lang)] += np.bincount(langid.features(text, model.slots), minlength=model.slots)
    plain = langid.Model(model.languages, counts)
    assert np.allclose(plain.weights, model.weights, atol=1e-4) and np.allclose(plain.bit, model.bit, rtol=1e-3)


def test_fingerprints(spark, hard, none):
    text = "A b c d e"
    shingles = ["a b c d", "b c d e"]
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in shingles) for k in range(64)]
    want = sum(1 << k for k in range(64) if 2 * ones[k] > 2)
    row = simhash.near_duplicates(spark.createDataFrame([(1, text), (2, text), (2, "quite another text here"), (9, None), (8, "")], "doc_id long, text string")).select("doc_id", simhash.hex_digits(F.col("fp")).alias("f"), "component_id")
    got = sorted(map(tuple, row.collect()))
    assert (1, f"{want:016x}", 1) in got and all(c == 1 for d, _, c in got if d in (1, 2)) and (8, "0" * 16, 8) in got and (9, "0" * 16, 8) in got
    assert simhash.near_duplicates(hard).count() == hard.count() and simhash.near_duplicates(none).count() == 0


def test_quality(spark, sf_dir, hard, none):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    held = quality.score(docs.select("doc_id", "text"), model).join(labels.where(remainder(F.col("doc_id"), 5) == 0), "doc_id").collect()
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in held) >= 0.85 * len(held)
    got = quality.score(hard, model).collect()
    assert len(got) == hard.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(none, model).count() == 0
    assert {r.score for r in quality.score(hard, quality.train(none, labels)).collect()} == {0.5}
    x, starts, y = np.random.default_rng(0).normal(size=(9, 5)), np.array([0, 4]), np.array([1.0, 0.0])
    net = quality.AttentionModel(np.zeros(5), np.ones(5), 4, 3)
    loss = lambda: -(lambda s: (y * np.log(s) + (1 - y) * np.log(1 - s)).mean())(net.forward(x, starts)[0])
    gradient = net.gradient(y, starts, *net.forward(x, starts))
    for name in net.NAMES:
        flat, base = net.p[name].reshape(-1), loss()
        flat[0] += 1e-6
        assert (loss() - base) / 1e-6 == pytest.approx(gradient[name].reshape(-1)[0], abs=1e-4)
        flat[0] -= 1e-6


def test_quality_trains_on_every_passage(spark):
    """The passage that tells is the 300th of each text; repeated ids don't lift the bound on rows."""
    plain = "some plain words of a text " * 4000
    texts = [(i, plain + ("### $$$ %%% && " * 200 if i % 2 else "") + plain[:200]) for i in range(24)]
    docs, labels = spark.createDataFrame(texts + texts[:6], "doc_id long, text string"), spark.createDataFrame([(i, 1 - i % 2) for i in range(24)], "doc_id long, quality int")
    found = quality.score(docs, quality.train(docs, labels)).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in found)
    assert labelled(docs, labels, "quality", 5).count() == 5 and labelled(docs, labels, "quality", 100).count() == 24


def test_toxic_terms_of_any_script_and_number(spark):
    """More telling terms than any cap, in Cyrillic; every one is learned."""
    bad = [f"грубость{''.join('бгджзлпфцч'[int(c)] for c in f'{k:04}')}" for k in range(700)]
    rows = [(i, " ".join(bad) if i % 2 else "тихие слова и больше ничего") for i in range(40)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    assert len([w for w in lexicon.weights if w not in toxicity.SEED]) >= 700
    assert {r.doc_id % 2: r.n_matches for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), lexicon).collect()} == {0: 0, 1: 700}


def test_toxicity(spark, sf_dir, hard, none):
    lexicon = toxicity.Lexicon({"idiot": 4.0, "trash": 3.0}, ["trash can"])
    texts = ["you 1d10t", "you іdіоt!!", "ID­IOT$$$", "idiotic", "the trash can", "trash, can", "", None, "x" * 100_000 + " idiot"]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon).collect()}
    assert [got[i].n_matches for i in range(len(texts))] == [1, 1, 1, 0, 0, 1, 0, 0, 1]
    assert got[0].score > got[6].score == got[7].score
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    learned = toxicity.learn(docs, labels)
    assert toxicity.score(hard, learned).count() == hard.count() and toxicity.score(none, learned).count() == 0
    assert toxicity.learn(docs, labels.limit(0)).weights["idiot"] == toxicity.SEED_WEIGHT


def brute_counts(text):
    words = (text or "").encode().split()
    spots = collections.defaultdict(list)
    for i in range(len(words) - 7):
        spots[tuple(words[i : i + 8])].append(i)
    covered = {i + k for s in spots.values() if len(s) > 1 for i in s for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_outlier_counts(spark, sf_dir, hard, none):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), hard):
        for r in outliers.counts(docs.withColumn("t2", F.col("text")).select("t2", "text")).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(r.t2)
    got = outliers.judge(hard.withColumn("kept", F.lit("x"))).collect()
    assert len(got) == hard.count() and all(r.base_failed != r.kept or r.distance > outliers.chi_square(1e-9) for r in got)
    assert outliers.judge(none).count() == 0


def brute_estimate(x, core, starts, first_steps, settled):
    """(log determinant, mean, covariance scaled to the chi-square median) of the best start, in numpy."""
    x = np.array(x)

    def step(mean, cov):
        d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
        near = x[d <= np.sort(d)[int(np.ceil(core * len(x))) - 1]]
        return near.mean(0), np.cov(near.T, bias=True)

    middle = np.sort(x, 0)[int(np.ceil(len(x) / 2)) - 1]
    spread = 1.4826 * np.sort(np.abs(x - middle), 0)[int(np.ceil(len(x) / 2)) - 1]
    found = [(middle, np.diag(spread**2))] + [(some.mean(0), np.cov(some.T, bias=True)) for some in starts]
    for _ in range(first_steps):
        found = [step(*f) for f in found]
    best = min(found, key=lambda f: np.linalg.slogdet(f[1])[1])
    while True:
        fresh = step(*best)
        fall = np.linalg.slogdet(best[1])[1] - np.linalg.slogdet(fresh[1])[1]
        best = fresh
        if fall < settled:
            break
    d = np.einsum("ni,ij,nj->n", x - best[0], np.linalg.inv(best[1]), x - best[0])
    return np.linalg.slogdet(best[1])[1], best[0], best[1] * np.median(d) / outliers.MEDIAN


def test_determinant_estimates_are_those_of_brute_force(spark):
    """Groups of under a thousand rows, for which Spark's percentiles are exact."""
    rng = np.random.default_rng(8)
    mixing = rng.normal(size=(4, 4))
    groups = {"a": rng.normal(size=(301, 4)) @ mixing, "b": np.r_[rng.normal(size=(201, 4)), rng.normal(6, 0.3, (60, 4))]}
    frame = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "grp string, x0 double, x1 double, x2 double, x3 double")
    hashes = [F.xxhash64("x0", "x1", "x2", "x3", F.lit(f"{s} {k}")).alias(f"h{s}_{k}") for s in range(1, 4) for k in range(5)]
    drawn = frame.select("grp", "x0", "x1", "x2", "x3", *hashes).toPandas()
    got = {r.grp: r for r in outliers.estimate(frame).collect()}
    for g, x in groups.items():
        mine = drawn[drawn.grp == g]
        starts = [np.array([mine.loc[mine[f"h{s}_{k}"].idxmin(), ["x0", "x1", "x2", "x3"]].to_numpy(float) for k in range(5)]) for s in range(1, 4)]
        logdet, mean, cov = brute_estimate(x, 0.75, starts, 2, 0.01)
        assert got[g].logdet == pytest.approx(logdet, abs=0.05) and [got[g][f"m{i}"] for i in range(4)] == pytest.approx(list(mean), abs=0.05)
        assert [got[g][f"c{i}{j}"] for i in range(4) for j in range(i + 1)] == pytest.approx([cov[i, j] for i in range(4) for j in range(i + 1)], rel=0.1, abs=0.05)
    assert abs(got["b"].m0) < 0.3  # the far cluster has no part in the estimate
    assert outliers.chi_square(0.001) == pytest.approx(18.467, abs=0.001)


def test_outliers_are_found(spark):
    rng = np.random.default_rng(3)
    text = lambda: " ".join("".join(rng.choice(list("aeinrst"), int(rng.integers(2, 9)))) for _ in range(150)) + "."
    rows = [(i, text(), "en", f"s{i % 3}") for i in range(300)] + [(1000 + i, text().upper().replace(" ", "%%% "), "en", "s0") for i in range(20)]
    got = outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("NOT kept").select("doc_id").collect()
    found = {r.doc_id for r in got}
    assert set(range(1000, 1020)) <= found and len(found) <= 23  # a random clean text may be far off


def test_decontamination(spark, sf_dir, hard, none):
    item = "A train leaves the old station at 12 km per hour and reaches Paris after it has passed 12 small towns on its way"
    docs = [
        (1, f"Some words before. {item}. And after."), (2, item.replace("12", "45").replace("Paris", "Rome")), (3, item.replace("12", "45", 1)), (4, "Nothing of the kind is in this text at all, I say"),
        (5, " ".join(item.split()[:9])), (6, None), (7, ""), (1, f"Some words before. {item}. And after."),
    ]
    items = spark.createDataFrame([(0, item), (1, "too short"), (2, None)], "item_id long, text string")
    for limit in (0, 1000):
        got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items, broadcast_rows=limit).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 0), (2, 0)], limit
    assert decontaminate.leaks(hard, items).count() == 0 and decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(hard, items.limit(0)).count() == 0
    table, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()}
    whole = {(d.doc_id, b.item_id) for d in table.collect() for b in bench.collect() if d.text and b.text in d.text}
    assert whole <= found


def test_bpe_over_many_partitions(spark):
    """Numbers of batches and of words must not run into each other, however many tasks cut the table."""
    texts = [f"row {i} of many, größe {i % 7}" for i in range(300)]
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(200)
    found = {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in bpe.encode_decode(docs, VOCABULARY).collect()}
    assert found == {i: (other.encode_ordinary(t), t.encode()) for i, t in enumerate(texts)}


def test_bpe_decodes_any_ids(spark):
    ids = [[], [0, 1, 2], list(range(300)), [50255, 7]]
    pieces = {rank: piece for piece, rank in VOCABULARY.ranks.items()}
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "n int, ids array<int>")
    found = {r.n: bytes(r.d) for r in frame.select("n", bpe.decode(F.col("ids"), VOCABULARY).alias("d")).collect()}
    assert found == {i: b"".join(pieces[k] for k in x) for i, x in enumerate(ids)}
