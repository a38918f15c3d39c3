"""Linear heads on fixed vectors: fitting, scoring, saving."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from affectlake.functions.vectors import EPSILON, axis_part, relu, sigmoid
from affectlake.operators.lexicon import LabelAxes
from affectlake.operators.solvers import binomials, least_squares, multinomial, summed
from affectlake.operators.splits import epoch_order
from affectlake.session import shared_folder

RIDGE = 1e-6


def as_features(df: DataFrame, vector: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(vector).cast("array<double>")))


# ---------------------------------------------------------------- Spark ML heads

def fit_single_label(df: DataFrame, vector: str, label: str, **options) -> LogisticRegressionModel:
    """Multinomial classifier of one class index."""
    settings = {"maxIter": 25, "regParam": 1e-3, "family": "multinomial", **options}
    rows = as_features(df, vector).select("features", F.col(label).cast("double").alias("label"))
    return LogisticRegression(**settings).fit(rows)


def fit_multi_label(df: DataFrame, vector: str, gold: str, size: int, **options) -> list[LogisticRegressionModel]:
    """One binary classifier per label; the vectors are cached across the fits."""
    settings = {"maxIter": 15, "regParam": 1e-3, "family": "binomial", **options}
    rows = as_features(df, vector).select("features", gold).persist()
    try:
        return [
            LogisticRegression(**settings).fit(
                rows.select("features", F.col(gold)[i].cast("double").alias("label"))
            )
            for i in range(size)
        ]
    finally:
        rows.unpersist()


def single_label_scores(model: LogisticRegressionModel, df: DataFrame, vector: str) -> DataFrame:
    scored = model.setPredictionCol("class").transform(as_features(df, vector))
    return (
        scored.withColumn("logits", vector_to_array("rawPrediction"))
        .withColumn("class", F.col("class").cast("int"))
        .drop("features", "rawPrediction", "probability")
    )


def multi_label_weights(models: Sequence[LogisticRegressionModel]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of all labels, for one dense head."""
    return (
        np.array([m.coefficients.toArray() for m in models]),
        np.array([m.intercept for m in models]),
    )


def fit_vad_regression(df: DataFrame, vector: str, gold: Sequence[str], ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Least squares of all axes by the normal equations: one pass, one matrix."""
    rows = df.select(vector, *gold)
    return least_squares(rows, vector_width(rows, vector), len(gold), ridge)


def vector_width(df: DataFrame, vector: str) -> int:
    found = df.select(F.size(vector).alias("n")).first()
    if found is None:
        raise ValueError("there are no rows to fit on")
    return found["n"]


def fit_binomials(
    df: DataFrame, vector: str, gold: str, labels: int, ridge: float = 1e-3, steps: int = 30,
) -> tuple[np.ndarray, np.ndarray, float]:
    """One binary classifier per label of a 0/1 array, as :func:`fit_multinomial`."""
    rows = df.select(vector, F.col(gold).cast("array<double>").alias("__gold")).persist()
    try:
        return binomials(rows, vector_width(rows, vector), labels, ridge, steps)
    finally:
        rows.unpersist()


def fit_multinomial(
    df: DataFrame, vector: str, label: str, classes: int, ridge: float = 1e-3, steps: int = 30,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Multinomial classifier as a dense head, to full precision: ``(weights, bias, gradient norm)``."""
    rows = df.select(vector, label).persist()
    try:
        return multinomial(rows, vector_width(rows, vector), classes, ridge, steps)
    finally:
        rows.unpersist()


# ------------------------------------------------------------- gradient descent

def descend(
    df: DataFrame,
    start: np.ndarray,
    loss_and_gradient: Callable[[np.ndarray, list[np.ndarray]], tuple[float, np.ndarray]],
    steps: int,
    rate: float,
) -> tuple[np.ndarray, list[float]]:
    """Full-batch gradient descent; returns the best parameters and every step's loss.

    Every column of ``df`` is a number or an equal-length array; sums are made as in
    :mod:`affectlake.operators.solvers`.  A step that makes the loss worse is taken back
    and the rate halved.
    """
    rows = df.count()
    if not rows:
        raise ValueError("there are no rows to fit on")
    best, best_loss, best_gradient = np.asarray(start, dtype="float64"), np.inf, None
    losses, trial = [], best
    for _ in range(steps + 1):
        point = trial

        def work(columns, point=point):
            import numpy as np

            loss, gradient = loss_and_gradient(point, columns)
            return np.concatenate([[loss], gradient])

        total = summed(df, len(point) + 1, work)
        loss = float(total[0] / rows)
        if best_gradient is None and not np.isfinite(loss):
            raise ValueError(f"the loss at the start is {loss}")
        if loss < best_loss:
            best, best_loss, best_gradient = point, loss, total[1:] / rows
        else:
            rate /= 2
        losses.append(loss)
        trial = best - rate * best_gradient
    return best, losses


def emd_loss_and_gradient(axes: LabelAxes, width: int, kind: str = "multi"):
    """Sum of the distribution losses of a batch and its gradient in the head.

    Parameters are a (3K, width + 1) matrix whose last column is the bias;
    columns are the vector and the multi-hot gold labels.
    """
    order, weight = np.array(axes.orders), np.array(axes.gaps)
    size, single = axes.size, kind == "single"

    def evaluate(point, columns):
        import numpy as np

        head = point.reshape(3 * size, width + 1)
        x = np.hstack([columns[0], np.ones((len(columns[0]), 1))])
        y = columns[1][:, order]
        z = (x @ head.T).reshape(-1, 3, size)
        if single:
            e = np.exp(z - z.max(axis=2, keepdims=True))
            p = e / e.sum(axis=2, keepdims=True)
        else:
            p = 1.0 / (1.0 + np.exp(-z))
        mass = p.sum(axis=2, keepdims=True) + EPSILON
        gold_mass = y.sum(axis=2, keepdims=True) + EPSILON
        step = np.cumsum(p / mass, axis=2) - np.cumsum(y / gold_mass, axis=2)
        loss = ((step * step * weight).sum(axis=2) + ((p - y) ** 2).sum(axis=2) / size).mean(axis=1)
        # Each normalised probability reaches all later cumulative sums.
        late = np.cumsum((2 * weight * step)[..., ::-1], axis=2)[..., ::-1]
        by_p = late / mass - (late * p).sum(axis=2, keepdims=True) / mass**2 + 2 * (p - y) / size
        if single:
            by_z = p * (by_p - (p * by_p).sum(axis=2, keepdims=True))
        else:
            by_z = p * (1 - p) * by_p
        gradient = (by_z / 3).reshape(len(x), -1).T @ x
        return float(loss.sum()), gradient.ravel()

    return evaluate


def fit_vad_from_categories(
    df: DataFrame, vector: str, gold: str, axes: LabelAxes, width: int,
    kind: str = "multi", steps: int = 15, rate: float = 20.0,
) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """A 3K head that minimises the distribution loss: ``(weights, bias, losses)``."""
    rows = df.select(F.col(vector), F.col(gold)).persist()
    try:
        start = np.zeros(3 * axes.size * (width + 1))
        point, losses = descend(rows, start, emd_loss_and_gradient(axes, width, kind), steps, rate)
    finally:
        rows.unpersist()
    head = point.reshape(3 * axes.size, width + 1)
    return head[:, :-1], head[:, -1], losses


def regression_loss_and_gradient(size: int, width: int):
    """Squared error of rectified axis predictions ``u . sigmoid(W x + b)``.

    Parameters are the (3K, width + 1) head followed by the 3 x K axis weights;
    columns are the vector and the (v, a, d) gold scores.
    """

    def evaluate(point, columns):
        import numpy as np

        cut = 3 * size * (width + 1)
        head, axis = point[:cut].reshape(3 * size, width + 1), point[cut:].reshape(3, size)
        x = np.hstack([columns[0], np.ones((len(columns[0]), 1))])
        p = 1.0 / (1.0 + np.exp(-(x @ head.T).reshape(-1, 3, size)))
        raw = (p * axis).sum(axis=2)
        error = np.maximum(raw, 0.0) - columns[1]
        by_raw = 2 * error * (raw > 0) / 3
        by_axis = (by_raw[..., None] * p).sum(axis=0)
        by_z = (by_raw[..., None] * axis * p * (1 - p)).reshape(len(x), -1)
        return float((error**2).mean(axis=1).sum()), np.concatenate([(by_z.T @ x).ravel(), by_axis.ravel()])

    return evaluate


def axis_regression(df: DataFrame, logits: str, gold: Sequence[str], size: int) -> np.ndarray:
    """Frozen stage: least squares of each axis on its K label probabilities, no bias."""
    parts = [sigmoid(axis_part(logits, i, size)).alias(f"p{i}") for i in range(3)]
    rows = df.select(*parts, *gold).persist()
    try:
        return np.array([least_squares(rows.select(f"p{i}", g), size, 1, RIDGE, intercept=False)[0][0] for i, g in enumerate(gold)])
    finally:
        rows.unpersist()


def fit_two_stage(
    df: DataFrame, vector: str, gold: Sequence[str], head: np.ndarray, bias: np.ndarray,
    axis: np.ndarray, size: int, steps: int = 10, rate: float = 0.5,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Unfrozen stage: head and axis weights together, from the frozen stage's start."""
    width = head.shape[1]
    rows = df.select(F.col(vector), F.array(*[F.col(g).cast("double") for g in gold])).persist()
    try:
        start = np.concatenate([np.hstack([head, bias[:, None]]).ravel(), axis.ravel()])
        point, losses = descend(rows, start, regression_loss_and_gradient(size, width), steps, rate)
    finally:
        rows.unpersist()
    cut = 3 * size * (width + 1)
    fitted = point[:cut].reshape(3 * size, width + 1)
    return fitted[:, :-1], fitted[:, -1], point[cut:].reshape(3, size), losses


# ----------------------------------------------------------------- mini-batches

def batch_schedule(rows: int, batch_size: int, epochs: int, freeze_epochs: int, rate: float, unfrozen_rate: float) -> list[dict]:
    """One entry per epoch: its steps, all steps up to its end, whether the head is frozen, the rate.

    The rate switches once, when the first epoch after the frozen ones begins.
    """
    steps = -(-rows // batch_size)
    return [
        {"epoch": e + 1, "steps": steps, "n_updates": steps * (e + 1), "frozen": e < freeze_epochs,
         "rate": rate if e < freeze_epochs else unfrozen_rate}
        for e in range(epochs)
    ]


def descend_batches(
    df: DataFrame, id_col: str, start: np.ndarray,
    loss_and_gradient: Callable[[np.ndarray, list[np.ndarray]], tuple[float, np.ndarray]],
    schedule: Sequence[dict], batch_size: int, frozen: np.ndarray, seed: int = 42,
) -> tuple[np.ndarray, list[float]]:
    """Gradient descent by mini-batches: the parameters and the mean loss of every epoch's steps.

    Every epoch has its own exact order of the rows and is written once, a folder per
    batch, so a step reads its batch only.  ``frozen`` marks parameters that stay as they
    are in the frozen epochs.  For batches that are worth a job each; the losses are those
    before each step.
    """
    point, losses = np.asarray(start, dtype="float64"), []
    values = [c for c in df.columns if c != id_col]
    for entry in schedule:
        path = shared_folder(df.sparkSession)
        batch = F.floor((F.col("position") - 1) / batch_size).cast("int")
        placed = epoch_order(df, id_col, entry["epoch"], seed).withColumn("batch", batch)
        placed.select("batch", *values).repartition("batch").write.partitionBy("batch").parquet(path)
        stored, total = df.sparkSession.read.schema(placed.select(*values, "batch").schema).parquet(path), 0.0
        for step in range(entry["steps"]):
            def work(columns, point=point):
                import numpy as np

                loss, gradient = loss_and_gradient(point, columns)
                return np.concatenate([[loss, len(columns[0])], gradient])

            sums = summed(stored.filter(F.col("batch") == step).select(*values), len(point) + 2, work)
            gradient = sums[2:] / sums[1]
            point = point - entry["rate"] * np.where(frozen & entry["frozen"], 0.0, gradient)
            total += sums[0] / sums[1]
        losses.append(total / entry["steps"])
    return point, losses


def fit_two_stage_batches(
    df: DataFrame, id_col: str, vector: str, gold: Sequence[str], head: np.ndarray, bias: np.ndarray, axis: np.ndarray,
    size: int, batch_size: int, epochs: int, freeze_epochs: int, rate: float, unfrozen_rate: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[dict]]:
    """Scores from categories by mini-batches: first the axis weights alone, then everything.

    Returns head, bias, axis weights and the schedule with the ``loss`` of every epoch.
    """
    rows = df.select(id_col, vector, F.array(*[F.col(g).cast("double") for g in gold]).alias("__gold")).persist()
    try:
        width, cut = head.shape[1], 3 * size * (head.shape[1] + 1)
        schedule = batch_schedule(rows.count(), batch_size, epochs, freeze_epochs, rate, unfrozen_rate)
        start = np.concatenate([np.hstack([head, bias[:, None]]).ravel(), axis.ravel()])
        point, losses = descend_batches(
            rows, id_col, start, regression_loss_and_gradient(size, width), schedule, batch_size, np.arange(len(start)) < cut)
    finally:
        rows.unpersist()
    fitted = point[:cut].reshape(3 * size, width + 1)
    logged = [{**entry, "loss": loss} for entry, loss in zip(schedule, losses, strict=True)]
    return fitted[:, :-1], fitted[:, -1], point[cut:].reshape(3, size), logged


# --------------------------------------------------------------------- scoring

def score_batches(
    df: DataFrame, vector: str, make_model: Callable[[], Callable], width: int,
    out: str = "logits", batch_size: int = 1024,
) -> DataFrame:
    """Score vectors with any model: ``make_model`` runs once per Python worker
    and returns a function from a (rows, width) array to a (rows, outputs) array."""
    score = predict_batch_udf(
        make_model, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
    return df.withColumn(out, score(F.col(vector).cast("array<double>")))


# --------------------------------------------------------------------- storage

def save_weights(spark: SparkSession, tensors: dict[str, np.ndarray], path: str) -> None:
    """Named arrays as a long Parquet table ``(name, row, col, value)``."""
    rows = [
        (name, int(i), int(j), float(value))
        for name, tensor in tensors.items()
        for (i, j), value in np.ndenumerate(np.atleast_2d(tensor))
    ]
    frame = spark.createDataFrame(rows, "name string, row int, col int, value double")
    frame.write.mode("overwrite").partitionBy("name").parquet(path)


def load_weights(
    spark: SparkSession, path: str, drop: Sequence[str] = ("head.weight", "head.bias")
) -> dict[str, np.ndarray]:
    """Reload saved arrays, without those of the old output head."""
    schema = "row int, col int, value double, name string"
    frame = spark.read.schema(schema).parquet(path).filter(~F.col("name").isin(list(drop)))
    tensors: dict[str, dict] = {}
    for r in frame.collect():
        tensors.setdefault(r["name"], {})[(r["row"], r["col"])] = r["value"]
    out = {}
    for name, cells in tensors.items():
        matrix = np.zeros((max(i for i, _ in cells) + 1, max(j for _, j in cells) + 1))
        for (i, j), value in cells.items():
            matrix[i, j] = value
        out[name] = matrix
    return out
