"""Due jobs in every active state, and files over the limit."""

from dossier.plans import tasks
from dossier.sources import files


def test_due_jobs_in_all_states(spark):
    states = ["pending", "hashing", "extracting", "analysing", "filing", "done", "failed"]
    rows = [(i, "ingest", 100 + i, s, None, i == 0) for i, s in enumerate(states)]
    rows += [(10, "reanalyse", 102, "pending", None, False), (11, "reanalyse", 105, "pending", None, False), (12, "reindex", 102, "pending", None, False), (13, "adopt", 105, "pending", "2030-01-01", False), (14, "reanalyse", 106, "pending", None, False), (15, "reanalyse", None, "pending", None, False)]
    jobs = spark.createDataFrame(rows, "id long, kind string, doc_id long, state string, next_run_at string, gives_way boolean").selectExpr("id", "kind", "doc_id", "state", "cast(next_run_at AS timestamp) AS next_run_at", "gives_way")
    ids = lambda **how: [r.id for r in tasks.due_jobs(jobs, "2025-06-01", **how).orderBy("turn").collect()]
    # 10 waits for the reading in of 102, 11 for that of 105, which is not due yet
    assert ids() == [1, 2, 3, 4, 12, 14, 15, 0]
    assert ids(giving_way=False) == [1, 2, 3, 4, 12, 14, 15] and ids(before_the_model=True) == [1, 0]


def test_files_over_the_limit_stay_as_metadata(spark, tmp_path):
    for name, text in (("a.txt", "short"), ("b.txt", "much longer than that")):
        (tmp_path / name).write_text(text)
    got = {r.path[-5:]: r for r in files.extract(files.read_files(spark, str(tmp_path)), largest=10).collect()}
    assert got["a.txt"].text == "short" and not got["a.txt"].warnings
    assert (got["b.txt"].kind, got["b.txt"].text, got["b.txt"].metadata, got["b.txt"].warnings) == ("txt", None, {"length": "21"}, ["tooLarge"])
