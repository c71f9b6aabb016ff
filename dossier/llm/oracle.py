"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations


def centroids(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """op11: the rounds of assigning and averaging, two steps for each."""
    away = "CAST(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    assign = "SELECT p.rid, p.vec_id, p.v, min(struct_pack(d := {away}, c := c.c)) AS best FROM points p CROSS JOIN {c} c GROUP BY ALL"
    steps = [
        f"points AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM points) ORDER BY h, v LIMIT {k})",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({assign.format(away=away, c=f'c{r}')})",
            f"s{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i)",
            f"m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY c)",
            f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)",
        ]
    steps.append(f"final AS MATERIALIZED ({assign.format(away=away, c=f'c{rounds}')})")
    return (
        "WITH " + ", ".join(steps) + f" SELECT f.vec_id, CAST(f.best.c AS INTEGER) AS cluster, f.best.d AS distance, CAST(sum(f.best.d) OVER (PARTITION BY f.best.c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(f.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM final f JOIN c{rounds} c ON c.c = f.best.c"
    )


#: op12: integers throughout but for the logarithm; a term counts once for an item.
RANKED = """
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t, row_number() OVER () AS rid FROM documents
), docs AS (SELECT rid, doc_id, len(t) AS n, t FROM words WHERE len(t) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
asked AS (SELECT DISTINCT item_id, rid, unnest(t) AS term FROM (
    SELECT item_id, row_number() OVER () AS rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM benchmark)),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY rid, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
impact AS (SELECT tf.rid, tf.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * docs) // terms)))) AS x FROM tf JOIN docs USING (rid) JOIN weight USING (term), totals),
scores AS (SELECT asked.item_id, asked.rid AS item, impact.rid, CAST(sum(x) AS BIGINT) AS score FROM asked JOIN impact USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores JOIN docs USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def oracle() -> dict[str, str]:
    return {"op11_centroids": centroids(), "op12_block_max": RANKED}
