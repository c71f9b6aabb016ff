"""The corpus pipeline: every stage against a brute-force version over the stage's own input."""

import collections
import hashlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers
import regex
import tiktoken

from dossier.llm import bpe, decontaminate, langid
from dossier.llm.common import stored


def kept_languages(rows, bench):
    """Counts made in one place instead of by tasks; decoding is the model's."""
    names = sorted({r.lang for r in rows if r.lang is not None and langid.LETTER.search(r.text or "")})
    counts = np.zeros((len(names), 1 << 15))
    for r in rows:
        if r.lang in names and langid.LETTER.search(r.text or ""):
            np.add.at(counts[names.index(r.lang)], langid.features(r.text, 1 << 15), 1)
    model = langid.Model(names, counts)
    found = [(r, *model.decode(r.text or "")) for r in rows]
    return [tuple(r) for r, lang, first, second in found if lang != langid.UNKNOWN and first - second >= 0.1]


def kept_of_groups(rows, bench):
    """Groups tied by a Jaccard similarity of 0.8 or more over five-word shingles, all pairs compared."""
    def shingles(text):
        words = [w.lower() for w in (text or "").encode().split()]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(r.text) for r in rows]
    label = {r.doc_id: r.doc_id for r in rows}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (len(a & b) >= 0.8 * len(a | b)) if a or b else True:
                x, y = sorted((label[rows[i].doc_id], label[rows[j].doc_id]))
                label = {k: x if v == y else v for k, v in label.items()}
    return [tuple(r) for r in rows if label[r.doc_id] == r.doc_id]


def without_passages(rows, bench):
    split = [(r, (r.text or "").encode().split()) for r in rows]
    first = {}
    for r, words in split:
        for i in range(len(words) - 49):
            key = tuple(words[i : i + 50])
            first[key] = min(r.doc_id, first.get(key, r.doc_id))
    out = []
    for r, words in split:
        gone = {i + k for i in range(len(words) - 49) if first[tuple(words[i : i + 50])] < r.doc_id for k in range(50)}
        text = b" ".join(w for i, w in enumerate(words) if i not in gone).decode() if gone else r.text
        if len(gone) < len(words) or not gone:
            out.append((r.doc_id, text, r.lang, r.source, len(text) if gone else r.n_chars))
    return out


def canonical(text):
    """Tokens with placeholders, and the tokens as written."""
    marks = decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT
    clean = regex.sub("[\u0001-\u0003]+", " ", text or "")
    named = regex.sub(r"(?<=[\p{L}\p{M}\p{N},;'’)\]\"]\x20)\p{Lu}[\p{L}\p{M}]*", marks[1], clean)
    numbered = regex.sub(r"[0-9]+(?:[.,][0-9]+)*", marks[0], named)
    units = regex.sub(rf"(?i){marks[0]}(\x20?)(?:{'|'.join(decontaminate.UNITS)})(?![\p{{L}}\p{{M}}])", rf"{marks[0]}\g<1>{marks[2]}", numbered)
    return regex.findall(r"[\u0001-\u0003]|[\p{L}\p{M}]+", units.lower()), regex.findall(r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+", clean.lower())


def without_items(rows, bench):
    marks = {decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT}
    places = collections.defaultdict(list)  # window: (item, its place)
    items = {b.item_id: canonical(b.text) for b in bench}
    for item, (tokens, _) in items.items():
        for i in range(len(tokens) - 4):
            if not set(tokens[i : i + 5]) <= marks:
                places[tuple(tokens[i : i + 5])].append((item, i))
    out = []
    for r in rows:
        tokens, values = canonical(r.text)
        met = collections.defaultdict(list)
        for p in range(len(tokens) - 4):
            for item, i in places.get(tuple(tokens[p : p + 5]), ()):
                met[item, p - i].append((i, p))
        found = collections.defaultdict(set)
        for (item, _), pairs in met.items():
            slots = {(items[item][1][i + k], values[p + k]) for i, p in pairs for k in range(5) if tokens[p + k] in marks}
            sound = len({a for a, _ in slots}) == len({b for _, b in slots}) == len(slots)
            found[item] |= {i for i, p in pairs if sound or not marks & set(tokens[p : p + 5])}
        if not any(len({i + k for i in some for k in range(5)}) >= 0.8 * len(items[item][0]) for item, some in found.items()):
            out.append(tuple(r))
    return out


def encoded(rows, bench):
    ranks = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (r.text or "").encode())]
        out.append((r.doc_id, r.lang, r.source, len(ids), *digests))
    return out


BRUTE = {"language": kept_languages, "near_duplicates": kept_of_groups, "repeated_passages": without_passages, "benchmark_leaks": without_items, "tokens": encoded}


def test_stages_are_those_of_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    rows, whole = docs.select(*corpus_pipeline.COLUMNS).collect(), docs.count()
    assert list(BRUTE) == [name for name, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        found = docs.collect()
        assert name == "tokens" or docs.columns == corpus_pipeline.COLUMNS
        assert collections.Counter(map(tuple, found)) == collections.Counter(BRUTE[name](rows, bench)), name
        rows = found
    assert len(rows) > 0.5 * whole


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_defined_cases(spark, sf_dir):
    """Nulls in every column, empty, long and repeated rows, ids shared by different texts, and columns of clashing names."""
    words = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' AND n_chars > 400").orderBy("doc_id").limit(3).collect()]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    long = " ".join(f"{w}{i % 900}" for i in range(60_000) for w in ("word",))
    rows = [(1, words[0]), (1, words[0]), (2, words[1]), (2, words[2]), (3, None), (4, ""), (None, words[1]), (5, long), (6, f"{words[2]} and then {item}"), (None, f"{item} at last")]
    names = "doc_id long, text string, lang string, source string, n_chars long, row string, tk string, score double, kept string, component_id string"
    docs = spark.createDataFrame([(d, t, "en" if t else None, None, None, "a", "b", 1.0, "c", "d") for d, t in rows], names)
    stages = dict(corpus_pipeline.STAGES)
    left = lambda name: sorted(str((r.doc_id, (r.text or "")[:30])) for r in stages[name](spark, docs, sf_dir).collect())
    shown = lambda some: sorted(str((d, (t or "")[:30])) for d, t in some)
    assert stages["language"](spark, docs, sf_dir).columns == corpus_pipeline.COLUMNS
    assert left("language") == shown([r for r in rows if r[1]])  # one language alone: every text with letters is of it
    assert left("near_duplicates") == shown([r for r in rows if r[0] != 4])
    passages = stages["repeated_passages"](spark, docs, sf_dir).collect()
    assert len(passages) == len(rows) and {r.text for r in passages if r.doc_id is None} == {words[1], f"{item} at last"}
    assert left("benchmark_leaks") == shown(rows[:-2])
    tokens = {(r.doc_id, r.n_tokens) for r in stages["tokens"](spark, docs, sf_dir).collect()}
    assert {(3, 0), (4, 0)} <= tokens and len(tokens) == 9
