"""Centroids, ranked search and SentencePiece against brute force and the library; repeated rows; the learned lexicon."""

import collections
import glob
import hashlib
import math
import os
import re
import time

import duckdb
import numpy as np
import pytest

pytest.importorskip("dossier.llm")

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from dossier.llm import clusters, pieces, queries, ranked, substrings, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_with_sql(name, spark, sf_dir, db):
    found = queries.QUERIES[name](spark, sf_dir)
    other = db.sql(queries.ORACLE[name])
    names = sorted(found.columns)
    assert sorted(other.columns) == names
    assert sorted(tuple(r[other.columns.index(c)] for c in names) for r in other.fetchall()) == sorted(map(tuple, found.select(*names).collect()))


def lloyd(rows, k, rounds, dims, scale=1024):
    """Clusters and squared distances by scanning every centroid, in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return collections.Counter((i, j, d) for (i, _), (d, j) in zip(kept, assign(), strict=True)), centres


@pytest.mark.parametrize(("k", "rounds"), [(1, 3), (2, 5), (9, 10), (40, 4), (5, 0)])
def test_clusters_are_those_of_the_full_scan(spark, k, rounds):
    rng = np.random.default_rng(k)
    # A grid of few values: ties between centroids, and equal vectors under several ids.
    rows = [(i, (rng.integers(-3, 4, 4) / 1024).tolist()) for i in range(300)] + [(1000 + i, rng.normal(i % 7, 0.3, 4).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (2000, None), (2001, [1.0]), (2002, [1.0, None, 1.0, 1.0]), (2003, [float("nan")] * 4), (2004, [float("-inf"), 0.0, 0.0, 0.0]), (2005, [])]
    table = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster long, v string").repartition(3)
    found = clusters.cluster(table, k, rounds, dims=4)
    want, centres = lloyd(rows, k, rounds, 4)
    assert collections.Counter(map(tuple, found.rows.select("vec_id", "cluster", "distance").collect())) == want
    assert found.centroids.tolist() == centres


def test_clusters_of_few_and_no_vectors(spark):
    one = spark.createDataFrame([(1, [0.5] * 64)] * 3, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in clusters.cluster(one).rows.collect()} == {(1, 0, 0)}
    empty = clusters.cluster(one.limit(0))
    assert empty.rows.columns == ["vec_id", "cluster", "distance"] and empty.rows.count() == 0
    with pytest.raises(Exception, match="components are below"):
        clusters.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))


def test_most_vectors_skip_the_scan():
    """The bounds spare distances, and the search gives what the scan gives."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(1000 * j, 50, (200, 8)) for j in range(16)]).astype(np.int64)
    old = points[::200] + 3
    new = old + rng.integers(-4, 5, old.shape)
    first, now = clusters.Exponion(old), clusters.Exponion(new)
    cluster, away, lower = first.scan(points, np.arange(16))
    moved = np.sqrt(clusters.squared(new, old))
    upper = np.sqrt(away) + moved[cluster] + 1e-6
    looked = now.search(points, cluster, upper, lower - moved.max() - 1e-6)
    assert cluster.tolist() == now.scan(points, np.arange(16))[0].tolist()
    assert looked < len(points) * 2


def rank(docs, asked, best=50):
    """Every document scored for every query."""
    cut = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(ranked.TERM, t or "")]
    held = [(d, collections.Counter(w), len(w)) for d, t in docs if (w := cut(t))]
    n_docs, words = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in asked:
        scored = []
        for d, c, n in held:
            m = 50 + (50 * n * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(cut(text)) if c[t])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:best])]
    return sorted(map(str, out))


HARD = [None, "", " .,;\n", "İstanbul STRASSE straße", "a_b-c", "x" * 200_000, "one\x00two\x7fthree", "日本語 テキスト 日本語", "𝄞 música"]


@pytest.mark.parametrize(("block", "waves", "group"), [(1, (1, 2), 5), (7, (2,), 100_000), (256, (4, 32), 100_000), (16, (), 60)])
def test_ranks_are_those_of_scoring_everything(spark, block, waves, group):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(1, 60)), p=weights / weights.sum())) for _ in range(400)]
    docs = [(i, t) for i, t in enumerate([*HARD, *texts, texts[0], texts[0]])] + [(None, texts[1]), (3, texts[2]), (3, texts[2])]
    asked = [(k, " ".join(rng.choice(vocabulary, 12))) for k in range(12)] + [(50, None), (51, "unheardof"), (52, "W1 w1 w2"), (52, "w3"), (None, "istanbul straße 日本語 x"), (53, " ".join(vocabulary))]
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, score int").repartition(3)
    index = ranked.index(table, block_docs=block)
    found = ranked.search(index, spark.createDataFrame(asked, "item_id long, text string"), best=10, waves=waves, group_terms=group)
    assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in found.collect()) == rank(docs, asked, 10)


def test_blocks_below_the_threshold_are_not_scored(spark):
    """A query whose words stand in one block only is answered from that block."""
    texts = [f"common words {'rare jewel ' * 3 if 100 <= i < 110 else ''} number{i}" for i in range(400)]
    index = ranked.index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), block_docs=20)
    asked = ranked.Queries([[b"rare", b"jewel", b"common"]])
    asked.weigh(ranked._holders(index, asked), index.documents)
    bounds = sorted((int(asked.bounds(r.terms, r.most)[0]) for r in index.blocks.collect()), reverse=True)
    got = ranked.search(index, spark.createDataFrame([(1, "rare jewel common")], "item_id long, text string"), best=10).collect()
    assert {r.doc_id for r in got} == set(range(100, 110)) and min(r.score for r in got) > bounds[1]


def test_ranked_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.search(ranked.index(none), asked).count() == 0
    found = ranked.search(ranked.index(spark.createDataFrame([(1, "a")], "doc_id long, text string")), asked.limit(0))
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_pieces_are_those_of_the_library(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [*HARD, " lead", "trail ", "a  b   c    d", " " * 1000, "▁ ▁▁x▁y", "tab\there\r\n\n  x", "é é �", "word " * 3000, "ab" * 20_000, "0123456789 " * 50, "🙂🙃", "<s> </s> <unk> <0x41>", "▁"]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    docs = [(i, t, i, "x") for i, t in enumerate(texts)] + [(3, texts[3], 0, "y"), (None, "no id", 0, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string, n_tokens long, ids string").repartition(3)
    for batch, bucket in ((16 << 20, 8 << 20), (1000, 2000)):
        found = pieces.encode_decode(table, pieces.Pieces.read(MODEL), keep=["doc_id"], batch_bytes=batch, bucket_bytes=bucket).collect()
        got = collections.Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in found)
        ids = [(d, library.encode(t or "", add_bos=True, add_eos=True)) for d, t, _, _ in docs]
        assert got == collections.Counter((d, len(x), tuple(x), library.decode(x)) for d, x in ids)
    digests = pieces.encode_decode(table, pieces.Pieces.read(MODEL), keep=["doc_id"], digests=True).where("doc_id = 4").first()
    ids = library.encode(texts[4], add_bos=True, add_eos=True)
    assert (digests.ids_sha256, digests.decoded_sha256) == (hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert pieces.encode_decode(table.limit(0), pieces.Pieces.read(MODEL)).count() == 0


def test_any_ids_decode_as_in_the_library():
    library, vocabulary = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Pieces.read(MODEL)
    table, marked = vocabulary.table(), np.array([p.startswith(pieces.MARK) for p, _, _ in vocabulary.pieces])
    rng = np.random.default_rng(3)
    for _ in range(300):
        ids = rng.integers(1, 32_000 if rng.random() < 0.5 else 300, int(rng.integers(0, 12)))
        assert pieces.decoded(ids, table, marked).decode() == library.decode(ids.tolist()), ids.tolist()


def test_pieces_that_cross_markers_are_refused():
    with pytest.raises(ValueError, match="crosses"):
        pieces.Pieces([("a▁b", 0.0, pieces.NORMAL)] + [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)], 1, 2)


def test_repeated_rows_are_worked_on_once(spark):
    """20,000 rows of one id and text, copies of a smaller document: time in proportion to the rows."""
    text = " ".join(f"w{i}" for i in range(600))
    small = spark.createDataFrame([(0, text), (1, "short text"), (2, text + " tail"), (2, text + " tail")], "doc_id long, text string")
    many = small.unionByName(spark.range(20_000).select(F.lit(9).cast("long").alias("doc_id"), F.lit("head " + text).alias("text")))
    begun = time.time()
    found = substrings.remove_repeats(many).groupBy("doc_id", "n_words", "n_removed", "kept").count().collect()
    assert time.time() - begun < 120
    assert {tuple(r) for r in found} == {(0, 600, 0, text, 1), (1, 2, 0, "short text", 1), (2, 601, 600, "tail", 2), (9, 601, 600, "head", 20_000)}


def test_words_of_the_lexicon_end_where_the_text_ends_them():
    assert toxicity.folded_words("You idiot! 1d10t, id!ot; call 911 $tupid @sshole x") == {"you", "idiot", "call", "stupid", "asshole"}
    lexicon = toxicity.Lexicon({"idiot": 4.0, "idioti": 4.0, "stupid": 1.0, "tupid": 1.0}, [])
    found = lexicon.matches(lexicon.automaton(), "you idiot! $tupid")
    assert [(a, b) for a, b, _ in found] == [(4, 10), (11, 17)]


def test_lexicon_weights_are_those_of_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["calm", "tree", "river", "stone"], 8)) + (" gnarl! Blorf." if i % 3 == 0 else " gnarl" if i == 1 else ""), int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).weights
    bad, good = 30, 60
    odds = lambda b, g: math.log((b + 0.5) / (bad + 1)) - math.log((g + 0.5) / (good + 1))
    assert {w: round(x, 9) for w, x in weights.items() if w not in toxicity.SEED} == {"gnarl": round(odds(30, 1), 9), "blorf": round(odds(30, 0), 9)}


def test_toxicity_of_documents_held_out(spark):
    """Labels not learned from: the share found among toxic and among other documents, at the query's threshold."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic IS NOT NULL")
    found = queries.QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    right = [np.mean([r.predicted == t for r in found if r.toxic == t]) for t in (0, 1)]
    assert len(found) > 500 and right[0] > 0.98 and right[1] > 0.8


def test_url_chains_take_one_round(spark, monkeypatch):
    """Thousands of segments that all paths share are one step; what the templates are doesn't change."""
    from dossier.llm import urls

    chain = "/".join(f"s{i}" if i % 3 else str(i) for i in range(4000))
    rows = [("h", f"/{chain}/{leaf}/{i}", 1, 0, 1) for i in range(8) for leaf in ("a", "b")] + [("h", f"/{chain}", 2, 1, 0), ("k", "/x/y", 1, 0, 0)]
    kept, counted = urls.stored, []
    monkeypatch.setattr(urls, "stored", lambda df: counted.append(1) or kept(df))
    found = {r.path: r.template for r in urls.templates(spark.createDataFrame(rows, "host string, path string, n long, blocked long, allowed long")).collect()}
    shown = "".join(f"/s{i}" if i % 3 else "/*" for i in range(4000))
    assert found["/x/y"] == "/**" and found[f"/{chain}"] == shown
    assert {found[f"/{chain}/{x}/{i}"] for x in "ab" for i in range(8)} == {f"{shown}/<a+1>/*"} and len(counted) < 20
