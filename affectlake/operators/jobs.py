"""From job files to lines of the result log: load, fit, score, evaluate, log.

A job names a task, a corpus and its label kind (``sources.registry``).  Texts are
given as vectors; the head is linear, see ``operators.heads``.  Epoch ``e`` of a job is a
fit of ``e`` rounds from the same start, so it does not matter which epochs ran before.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from affectlake.functions import vectors as X
from affectlake.functions.labels import one_hot
from affectlake.operators import heads, metrics
from affectlake.operators.lexicon import LabelAxes
from affectlake.operators.splits import few_shot
from affectlake.session import saved
from affectlake.sinks import results
from affectlake.sources import registry

KINDS = ("vad", "multi", "single")
#: Newton steps and descent steps of one round.
NEWTON_STEPS, DESCENT_STEPS = 2, 5
ZERO_SHOT = "emobank"


def evaluation_row(
    scored: DataFrame, kind: str, gold: Sequence[str] | str, predicted: Sequence[str] | str, loss: Column,
    split: str = "split",
) -> DataFrame:
    """One row: sizes, mean losses and metrics of the valid and the test rows."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
    table = metrics.evaluate(scored, kind, gold, predicted, [split])
    row = metrics.result_row(table, split, results.METRIC_SOURCES[kind])
    names = [(s, m) for s in ("valid", "test") for m in ("size", "loss")]
    values = scored.select(F.col(split).alias("s"), loss.alias("l")).agg(*[
        (F.count_if(F.col("s") == s) if m == "size" else F.avg(F.when(F.col("s") == s, F.col("l")))).alias(f"{s}_{m}")
        for s, m in names
    ]).first()
    return row.select(*[F.lit(values[f"{s}_{m}"]).alias(f"{s}_{m}") for s, m in names], "*")


def log_epoch(
    scored: DataFrame, kind: str, gold: Sequence[str] | str, predicted: Sequence[str] | str, loss: Column,
    path: str, epoch: int = 1, file_name: str = "run", n_updates: int = 0,
) -> bool:
    """Evaluate scored rows and append them to the log of their kind."""
    row = evaluation_row(scored, kind, gold, predicted, loss)
    run = [F.lit(v).alias(n) for n, v in (("epoch", epoch), ("file_name", file_name), ("n_updates", n_updates))]
    return results.log_evaluation(row.select(*run, "*"), kind, path)


def run_job(
    task: str, kind: str, rows: DataFrame, vector: str, label: str, size: int, path: str,
    axes: LabelAxes | None = None, zero_shot: DataFrame | None = None, epoch: int = 1, file_name: str = "run",
    n_updates: int = 0,
) -> None:
    """Fit on the train rows, evaluate valid and test, append to the logs under ``path``.

    * ``category-classification``: ``label`` is a class index (single) or a 0/1 array (multi).
    * ``vad-regression``: ``label`` is a struct ``v, a, d``.
    * ``vad-from-categories``: a head fitted on categories with the distribution loss is
      evaluated twice: its classes on ``rows``, and its scores on ``zero_shot``, which has
      the vector, ``split`` and a struct ``v, a, d`` in ``label``.
    """
    train = rows.filter("split = 'train'")
    gold = [F.col(label)[a].alias(f"g{a}") for a in "vad"]
    names = ["gv", "ga", "gd"]
    if task == "vad-regression":
        weights, bias = heads.fit_vad_regression(train.select(vector, *gold), vector, names)
        out = rows.select("split", *gold, X.linear_head(vector, weights, bias).alias("o"))
        scored = out.select("split", *names, *[X.relu(F.col("o")[i]).alias(a) for i, a in enumerate("vad")])
        log_epoch(scored, "vad", names, list("vad"), X.regression_loss([F.col(a) for a in "vad"], names), f"{path}/vad", epoch, file_name, n_updates)
    elif task == "category-classification" and kind == "single":
        weights, bias, _ = heads.fit_multinomial(train, vector, label, size, steps=NEWTON_STEPS * epoch)
        scored = rows.withColumn("logits", X.linear_head(vector, weights, bias))
        scored = scored.withColumn("class", (F.array_position("logits", F.array_max("logits")) - 1).cast("int"))
        log_epoch(scored, "single", label, "class", X.class_loss("logits", label), f"{path}/single", epoch, file_name, n_updates)
    elif task == "category-classification":
        weights, bias, _ = heads.fit_binomials(train, vector, label, size, steps=NEWTON_STEPS * epoch)
        scored = rows.withColumn("logits", X.linear_head(vector, weights, bias))
        scored = scored.withColumn("classes", X.threshold_classes("logits"))
        log_epoch(scored, "multi", label, "classes", X.binary_loss("logits", label), f"{path}/multi", epoch, file_name, n_updates)
    elif task == "vad-from-categories":
        hot = one_hot(label, size) if kind == "single" else F.col(label)
        width = train.select(F.size(vector).alias("n")).first()["n"]
        weights, bias, _ = heads.fit_vad_from_categories(
            train.select(vector, hot.alias("hot")), vector, "hot", axes, width, kind, steps=DESCENT_STEPS * epoch)
        head = X.linear_head(vector, weights, bias)
        scored = rows.withColumn("logits", head).withColumn("hot", hot)
        scored = scored.withColumn("e", X.vad_and_classes("logits", axes.orders, axes.scores, kind))
        predicted = F.col("e.classes")[0] if kind == "single" else F.col("e.classes")
        loss = X.emd_loss("logits", "hot", axes.orders, axes.gaps, kind)
        log_epoch(scored.withColumn("classes", predicted), kind, label, "classes", loss, f"{path}/{kind}", epoch, file_name, n_updates)
        other = zero_shot.select("split", *gold, X.vad_and_classes(head, axes.orders, axes.scores, kind).alias("e"))
        other = other.select("split", *names, *[F.col(f"e.{a}").alias(a) for a in "vad"])
        log_epoch(other, "vad", names, list("vad"), X.regression_loss([F.col(a) for a in "vad"], names), f"{path}/vad", epoch, file_name, n_updates)
    else:
        raise ValueError(f"unknown task {task!r} for labels of kind {kind!r}")


# ------------------------------------------------------------------- job files

def logs_of(task: str, dataset: str) -> list[str]:
    """The logs that every epoch of a job has a row in."""
    kind = registry.LABEL_KINDS[dataset]
    return [kind, "vad"] if task == "vad-from-categories" else [kind]


def finished_epochs(spark: SparkSession, spec: Row, out: str) -> set[int]:
    """Epochs of a job that all of its logs hold."""
    found = [
        {r["epoch"] for r in results.read_log(spark, log, f"{out}/{log}").filter(
            F.col("file_name") == spec["csv_file_name"]).select("epoch").collect()}
        for log in logs_of(spec["task"], spec["dataset"])
    ]
    return set.intersection(*found)


def run_jobs(
    spark: SparkSession, jobs_path: str, folders: Mapping[str, str], out: str,
    vectorise: Callable[[DataFrame], DataFrame], axes_of: Callable[[str], LabelAxes],
) -> list[tuple[str, int]]:
    """Run every job of the JSON files under a path: ``(file_name, epoch)`` of what was run.

    ``folders`` says where each dataset lies, ``vectorise`` adds the column ``vector`` to a
    corpus, ``axes_of`` gives a dataset's label axes.  All jobs are checked before the
    first one runs.  Epochs that stand in the logs are not run again, and a job without an
    open epoch does not even read its corpus; so a broken run goes on where it ended.
    """
    specs = registry.read_job(spark, jobs_path)
    bad = registry.job_violations(specs).collect()
    if bad:
        raise ValueError("bad jobs: " + ", ".join(sorted(f"{r['field']}={r['value']}" for r in bad)))
    ran = []
    for spec in sorted(specs.collect(), key=lambda r: r["csv_file_name"]):
        done = finished_epochs(spark, spec, out)
        missing = [e for e in range(1, (spec["max_epoch"] or 1) + 1) if e not in done]
        if missing:
            _run_epochs(spark, spec, missing, folders, out, vectorise, axes_of)
            ran += [(spec["csv_file_name"], e) for e in missing]
    return ran


def _run_epochs(spark, spec, epochs, folders, out, vectorise, axes_of) -> None:
    task, dataset = spec["task"], spec["dataset"]
    kind, names = registry.LABEL_KINDS[dataset], registry.LABEL_LISTS[dataset]

    def loaded(name: str) -> DataFrame:
        corpus = vectorise(registry.load_corpus(spark, name, folders[name]))
        if registry.LABEL_KINDS[name] == "single" and corpus.schema["label"].dataType.typeName() == "string":
            listed = registry.LABEL_LISTS[name]
            corpus = corpus.withColumn("label", (F.array_position(F.lit(list(listed)), F.col("label")) - 1).cast("int"))
        return saved(corpus.select("id", "split", "vector", "label"))

    rows = loaded(dataset)
    if (spec["few_shot_ratio"] or 1.0) < 1.0:
        few = few_shot(rows.filter("split = 'train'"), "id", spec["few_shot_ratio"])
        rows = saved(few.unionByName(rows.filter("split <> 'train'")))
    two = task == "vad-from-categories"
    other, axes = (loaded(ZERO_SHOT), axes_of(dataset)) if two else (None, None)
    steps = -(-rows.filter("split = 'train'").count() // (spec["train_batch_size"] or 32))
    for epoch in epochs:
        run_job(task, kind, rows, "vector", "label", len(names), out, axes, other, epoch, spec["csv_file_name"], epoch * steps)
