"""Funnel, latencies, insights, evaluation and redaction (OBS1-OBS3, AGG5-AGG15, EVL1-2, SNK8, PIP4, PIP10, PIP21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import fold

#: Steps of the funnel and the stages that they hold.
STEPS = [("arrived", ["hash", "tag"]), ("deduplicated", ["dedupe"]), ("read", ["extract", "ocr", "vlm"]), ("understood", ["entities"]), ("analysed", ["analyse", "consolidate", "review"]), ("filed", ["filed", "name", "place", "embed", "index"])]
SEVERITY = ["skipped", "ok", "warn", "error"]
RETRY_DELAYS = [2, 8, 30]


def nearest_rank(value: Column, share: float) -> Column:
    """AGG9 as an aggregate: sorted[min(n-1, round((n-1)*share))], halves away from zero. For groups that fit a task."""
    every = F.sort_array(F.collect_list(value))
    return F.get(every, F.least(F.size(every) - 1, F.floor((F.size(every) - 1) * F.lit(share) + 0.5).cast("int")))


def latencies(steps: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """AGG9 for groups of any size: equal values are counted first, and ranks come from the counts' running sums.

    The running sums are made in ranges of values, so that a group of many different values is not one task's.
    """
    counts = steps.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange(F.col(group), F.col(value)).withColumn("_part", F.spark_partition_id()).persist()
    parts = ranged.groupBy(group, "_part").agg(F.sum("n").alias("in_part"))
    before = F.sum("in_part").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    parts = parts.select(group, "_part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("in_part").over(Window.partitionBy(group)).alias("total"))
    running = F.sum("n").over(Window.partitionBy(group, "_part").orderBy(value))
    placed = ranged.withColumn("_upto", running).join(F.broadcast(parts), [group, "_part"])  # at most a row per group and partition
    upto = F.col("before") + F.col("_upto")
    picked = lambda share: F.floor((F.col("total") - 1) * share + 0.5) + 1
    picks = [F.max(F.when((upto >= picked(share)) & (upto - F.col("n") < picked(share)), F.col(value))).alias(name) for name, share in shares.items()]
    return placed.groupBy(group).agg(F.max("total").alias("n"), *picks)


def severity(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), status)


def worst_by_stage(steps: DataFrame) -> DataFrame:
    """AGG10: per trace and stage the worst status and the summed duration."""
    summed = steps.groupBy("trace_id", "stage", "status").agg(F.sum("duration_ms").alias("ms"))
    return summed.groupBy("trace_id", "stage").agg(F.max_by("status", severity(F.col("status"))).alias("status"), F.sum("ms").alias("ms"))


def histogram(rows: DataFrame, column: Column, name: str) -> DataFrame:
    """AGG5: counts by value, null as `none`."""
    return rows.groupBy(F.coalesce(column, F.lit("none")).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def step_of(stage: Column) -> Column:
    """Place of a stage's step."""
    out = None
    for i, (_, stages) in enumerate(STEPS):
        out = F.when(stage.isin(stages), i) if out is None else out.when(stage.isin(stages), i)
    return out


def funnel(docs: DataFrame, traces: DataFrame, steps: DataFrame) -> DataFrame:
    """OBS1: (step, reached, passed, stopped, warned, mean_ms) of documents by the furthest step of their latest trace.

    docs (id, status), traces (id, doc_id), steps (trace_id, stage, status, duration_ms).
    """
    last = traces.groupBy("doc_id").agg(F.max("id").alias("trace_id"))
    stages = worst_by_stage(steps).withColumn("step", step_of(F.col("stage")))
    mine = docs.join(last, docs["id"] == last["doc_id"], "left").select(docs["id"].alias("doc_id"), docs["status"].alias("end"), "trace_id").join(stages, "trace_id", "left")
    furthest = mine.groupBy("doc_id").agg(F.first("end").alias("end"), F.coalesce(F.max("step"), F.lit(0)).alias("furthest"))
    final = len(STEPS) - 1
    stopped = ~F.col("end").isin("filed", "done")
    counts = furthest.groupBy("furthest").agg(F.count(F.lit(1)).alias("n"), F.count_if(stopped).alias("stopped"))
    names = F.explode(F.array(*[F.struct(F.lit(i).alias("step_index"), F.lit(n).alias("step")) for i, (n, _) in enumerate(STEPS)]))
    frame = docs.sparkSession.range(1).select(names.alias("s")).select("s.*")
    reached = frame.join(F.broadcast(counts), F.col("furthest") >= F.col("step_index"), "left").groupBy("step_index", "step").agg(  # a row per step
        F.coalesce(F.sum("n"), F.lit(0)).alias("reached"), F.coalesce(F.sum(F.when(F.col("furthest") == F.col("step_index"), F.col("stopped"))), F.lit(0)).alias("stopped")
    )
    following = F.lead("reached").over(Window.orderBy("step_index"))
    passed = F.greatest(F.lit(0), F.least(F.coalesce(following, F.col("reached") - F.col("stopped")), F.col("reached")))
    timing = mine.where("step IS NOT NULL").groupBy("step").agg(F.count_if(F.col("status") == "warn").alias("warned"), F.avg(F.when(F.col("status") != "error", F.col("ms"))).alias("mean_ms"))
    out = reached.withColumn("passed", passed)
    return out.join(F.broadcast(timing.withColumnRenamed("step", "step_index")), "step_index", "left").select("step_index", "step", "reached", "passed", "stopped", F.coalesce("warned", F.lit(0)).alias("warned"), "mean_ms")


def funnel_summary(found: DataFrame) -> DataFrame:
    """OBS2: where most stop, the slowest step, and the share that goes straight through."""
    first, last = F.max(F.when(F.col("step_index") == 0, F.col("reached"))), F.max(F.when(F.col("step_index") == len(STEPS) - 1, F.col("passed")))
    return found.agg(F.max_by("step", F.struct("stopped", -F.col("step_index"))).alias("main_stop"), F.max_by("step", F.coalesce("mean_ms", F.lit(-1.0))).alias("slowest"), (last / first).alias("straight_through"))


def funnel_rates(found: DataFrame) -> DataFrame:
    """OBS2: of each step the share that passes, and the share of all arrivals that reach it."""
    arrived = F.max(F.when(F.col("step_index") == 0, F.col("reached"))).over(Window.partitionBy())  # a row per step
    return found.withColumns({"pass_rate": F.when(F.col("reached") > 0, F.col("passed") / F.col("reached")), "cumulative": F.when(arrived > 0, F.col("reached") / arrived)})


def failure(kind: Column, attempts: Column, most: int = 3) -> Column:
    """PIP4: what follows a failure: struct<next, delay>."""
    delay = F.get(F.array(*map(F.lit, RETRY_DELAYS)), F.least(attempts, F.lit(len(RETRY_DELAYS) - 1)))
    state = (
        F.when(kind == "cancelled", "cancelled").when(kind == "modelAway", "waiting").when(kind == "final", "failed").when(kind == "sourceChanged", "restart").when(attempts + 1 < most, "retry").otherwise("parked")
    )
    return F.struct(state.alias("next"), F.when(state == "retry", delay).when(state == "waiting", 60).alias("delay"))


def redact(logs: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """SNK8: only the allowed keys of a map stay."""
    return logs.withColumn(column, F.map_filter(column, lambda k, _: k.isin(allowed)))


def trim_steps(steps: DataFrame, before: str, stages: list[str]) -> DataFrame:
    """PIP10: the exchanges of model stages in old traces go: out of JSON output, or to null in a struct's field."""
    old = (F.col("started_at") < F.lit(before).cast("timestamp")) & F.col("stage").isin(stages)
    if steps.schema["output"].dataType.typeName() == "string":
        # Of variants, so that the other fields stay what they are; what is no object stays as it is.
        fields = F.map_filter(F.from_json("output", "map<string,variant>"), lambda k, _: k != "exchange")
        trimmed = F.when(F.get_json_object("output", "$.exchange").isNotNull(), F.to_json(fields)).otherwise(F.col("output"))
    else:
        trimmed = F.col("output").withField("exchange", F.lit(None).cast("string"))
    return steps.withColumn("output", F.when(old, trimmed).otherwise(F.col("output")))


def confirmed_at(events: DataFrame, kinds: list[str], correct: str = "markedCorrect") -> DataFrame:
    """PIP21: when a document was confirmed, if that is the newest of its deciding events."""
    newest = events.where(F.col("kind").isin(kinds)).groupBy("doc_id").agg(F.max_by(F.struct("kind", "at"), F.struct("at", "id")).alias("e"))
    return newest.select("doc_id", F.when(F.col("e.kind") == correct, F.col("e.at")).alias("confirmed_at"))


def label_found(expected: Column, labels: Column, kind: Column) -> Column:
    """EVL2: one of the alternatives `a|b` is among the labels of a kind: amounts to the cent, times by prefix, else within."""
    mine = F.transform(F.filter(labels, lambda x: x["kind"] == kind), lambda x: x["value"])
    bare = lambda c: F.regexp_replace(fold(c), r"\s+", "")
    number = lambda c: F.regexp_extract(c, r"^(-?[0-9.]+)", 1).try_cast("double")
    code = lambda c: F.regexp_extract(c, r"([A-Z]{3})$", 1)

    def fits(alternative: Column, value: Column) -> Column:
        by_amount = (F.abs(number(alternative) - number(value)) < 0.005) & (code(alternative) == code(value))
        return F.when(kind == "amount", by_amount).when(kind.isin("date", "deadline", "period"), value.startswith(alternative)).otherwise(bare(value).contains(bare(alternative)))

    return F.exists(F.transform(F.split(expected, r"\|"), lambda a: F.trim(a)), lambda a: F.exists(mine, lambda v: F.coalesce(fits(a, v), F.lit(False))))


def evaluation(rows: DataFrame) -> DataFrame:
    """EVL1, AGG14: accuracies and the upper median of seconds of rows (expected_*, actual_*, seconds)."""
    rate = lambda a, b: F.avg((F.col(a) == F.col(b)).cast("double"))
    sender = F.avg(fold(F.col("actual_sender")).contains(fold(F.col("expected_sender"))).cast("double"))
    rates = rows.agg(rate("expected_status", "actual_status").alias("status"), rate("expected_type", "actual_type").alias("type"), sender.alias("sender"), rate("expected_date", "actual_date").alias("date"))
    median = latencies(rows.select(F.lit(0).alias("every"), "seconds"), "every", "seconds", {"median_seconds": 0.5}).select("median_seconds")
    return rates.join(F.broadcast(median), how="left")  # one row each


def report(rows: DataFrame, name: str = "name") -> DataFrame:
    """SNK9: an evaluation as lines of JSON (kind, report): one per row, one per kind of label, and one of the whole."""
    line = lambda frame, kind, *columns: frame.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*columns)).alias("report"))
    scored = row_score(rows)
    marks = [c for c in scored.columns if c.endswith("_right")] + ["labels_expected", "labels_found"]
    kinds, whole = labels_by_kind_found(rows), evaluation(rows)
    return line(scored, "row", F.col(name), *marks).unionByName(line(kinds, "kind", *kinds.columns)).unionByName(line(whole, "summary", *whole.columns))


def write_report(rows: DataFrame, path: str, name: str = "name") -> None:
    """SNK9: the lines of a report in a folder for each kind; a repeated write replaces it."""
    report(rows, name).withColumnRenamed("report", "value").write.mode("overwrite").partitionBy("kind").text(path)


def row_score(rows: DataFrame) -> DataFrame:
    """EVL1: rows (expected_*, actual_*, title_words array, title, expected_labels array<struct<kind,value>>, labels) with a mark for each expectation; null where nothing is expected."""
    same = lambda c: F.col(f"expected_{c}") == F.col(f"actual_{c}")
    sender = fold(F.col("actual_sender")).contains(fold(F.col("expected_sender")))
    title = F.when(F.size("title_words") > 0, F.forall("title_words", lambda w: fold(F.col("title")).contains(fold(w))))
    found = F.filter("expected_labels", lambda e: label_found(e["value"], F.col("labels"), e["kind"]))
    return rows.withColumns({"status_right": same("status"), "type_right": same("type"), "language_right": same("language"), "date_right": same("date"), "sender_right": sender, "title_right": title, "labels_expected": F.size("expected_labels"), "labels_found": F.size(found)})


def labels_by_kind_found(rows: DataFrame) -> DataFrame:
    """AGG14: by kind the rows that have a label of it, and of the expected labels how many were found."""
    has = rows.select(F.explode(F.array_distinct(F.transform("labels", lambda x: x["kind"]))).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))
    asked = rows.select("labels", F.explode("expected_labels").alias("e")).groupBy(F.col("e.kind").alias("kind")).agg(F.count(F.lit(1)).alias("expected"), F.count_if(label_found(F.col("e.value"), F.col("labels"), F.col("e.kind"))).alias("found"))
    return has.join(asked, "kind", "full_outer").select("kind", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))


def writings_per_sender(labels: DataFrame, sender: str = "sender") -> DataFrame:
    """AGG14: how many different values senders with more than one document have on average, and different labels by kind."""
    of = labels.groupBy("kind").agg(F.countDistinct("value").alias("distinct_labels"))
    many = labels.where(F.col("kind") == sender).groupBy(fold(F.col("value")).alias("who")).agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("value").alias("writings")).where("docs > 1")
    return of.crossJoin(many.agg(F.avg("writings").alias("mean_writings")))  # one row


def job_counts(jobs: DataFrame) -> DataFrame:
    """AGG12: active jobs that read documents in, index them again, or read them again."""
    active = jobs.where(F.col("state").isin("pending", "hashing", "extracting", "analysing", "filing"))
    return active.agg(F.count_if(F.col("kind").isin("ingest", "adopt")).alias("queued"), F.count_if(F.col("kind") == "reindex").alias("reindexing"), F.count_if(F.col("kind") == "reanalyse").alias("reading_again"))


def pair_judgement(rows: DataFrame) -> DataFrame:
    """AGG15: rows (same, judged, held_out): accuracy, wrong merges, wrong keep-apart, unanswered."""
    right = ((F.col("judged") == "same") & F.col("same")) | ((F.col("judged") == "different") & ~F.col("same"))
    return rows.agg(
        F.avg(F.coalesce(right, F.lit(False)).cast("double")).alias("accuracy"), F.count_if((F.col("judged") == "same") & ~F.col("same")).alias("wrongly_merged"),
        F.count_if((F.col("judged") == "different") & F.col("same")).alias("wrongly_kept_apart"), F.count_if(F.col("judged").isNull()).alias("unanswered"), F.count_if("held_out").alias("held_out"),
    )
