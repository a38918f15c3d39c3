"""Array mathematics on logits, probabilities and labels.

Element-wise steps are native higher-order functions.  Steps that combine
three axes of K values per row (distribution losses, predictions, dense heads)
run as Arrow batches: as unrolled expressions they outgrow the method size the
JVM compiles by default (see the measurements in the README).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

EPSILON = 1e-5
LM_WEIGHT_LOG = -4.6


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ------------------------------------------------------------ native functions

def axis_part(logits: Column | str, axis: int, size: int) -> Column:
    """The V (0), A (1) or D (2) third of a 3K array."""
    return F.slice(_c(logits), 1 + axis * size, size)


def total(values: Column | str) -> Column:
    return F.aggregate(_c(values), F.lit(0.0), lambda acc, x: acc + x)


def sigmoid(values: Column | str) -> Column:
    return F.transform(_c(values), lambda x: 1 / (1 + F.exp(-x)))


def relu(value: Column | str) -> Column:
    return F.greatest(_c(value), F.lit(0.0))


def softmax(values: Column | str) -> Column:
    """Shifted by the maximum; the two passes share no repeated exponentials."""
    values = _c(values)
    shifted = F.transform(
        F.arrays_zip(values.alias("x"), F.array_repeat(F.array_max(values), F.size(values)).alias("m")),
        lambda e: F.exp(e["x"] - e["m"]),
    )
    return normalise(shifted, 0.0)


def normalise(values: Column | str, epsilon: float = EPSILON) -> Column:
    """Divide by the sum plus epsilon.

    The sum travels as the first element, so that it is computed once per row
    and not once per element.
    """
    values = _c(values)
    packed = F.array(F.struct(values.alias("p"), (total(values) + F.lit(epsilon)).alias("s")))
    return F.flatten(
        F.transform(
            packed,
            lambda e: F.zip_with(
                e["p"], F.array_repeat(e["s"], F.size(e["p"])), lambda p, s: p / s
            ),
        )
    )


def squared_distance(left: Column | str, right: Column | str) -> Column:
    return total(F.zip_with(_c(left), _c(right), lambda a, b: (a - b) * (a - b)))


def within_class_loss(probs: Column | str, gold: Column | str, size: int) -> Column:
    """Squared differences of probabilities and labels over K."""
    return squared_distance(probs, gold) / F.lit(float(size))


def dot(left: Column | str, right: Column | str) -> Column:
    return total(F.zip_with(_c(left), _c(right), lambda a, b: a * b))


def weighted_sum(probs: Column | str, weights: Sequence[float]) -> Column:
    return dot(probs, F.array(*[F.lit(float(w)) for w in weights]))


def threshold_classes(logits: Column | str) -> Column:
    """Sigmoid of at least one half, which is a logit of at least zero."""
    return F.transform(_c(logits), lambda x: (x >= 0).cast("int"))


def first_argmax(values: Column | str) -> Column:
    values = _c(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def regression_loss(prediction: Sequence[Column | str], gold: Sequence[Column | str]) -> Column:
    """Squared error of the rectified prediction, averaged over the axes of a row."""
    errors = [(relu(p) - _c(g)) * (relu(p) - _c(g)) for p, g in zip(prediction, gold)]
    return sum(errors[1:], errors[0]) / F.lit(float(len(errors)))


def binary_loss(logits: Column | str, gold: Column | str) -> Column:
    """Stable binary cross-entropy on logits, mean over the labels of a row."""
    terms = F.zip_with(
        _c(logits),
        _c(gold),
        lambda x, y: F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x))),
    )
    return total(terms) / F.size(_c(logits))


def class_loss(logits: Column | str, index: Column | str) -> Column:
    """Softmax cross-entropy of one class index."""
    logits = _c(logits)
    top = F.array_max(logits)
    pairs = F.arrays_zip(logits.alias("x"), F.array_repeat(top, F.size(logits)).alias("m"))
    mass = F.aggregate(pairs, F.lit(0.0), lambda acc, e: acc + F.exp(e["x"] - e["m"]))
    return top + F.log(mass) - logits[_c(index)]


def shift_left(ids: Column | str) -> Column:
    """Next-token targets: drop the first id, pad with 0."""
    ids = _c(ids)
    return F.concat(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))), F.array(F.lit(0)))


def combined_objective(lm_loss: Column | str, other: Column | str) -> Column:
    return _c(lm_loss) * F.exp(F.lit(LM_WEIGHT_LOG)) + _c(other)


# ------------------------------------------------------------- Arrow functions

def linear_head(
    vector: Column | str,
    weights: Sequence[Sequence[float]],
    bias: Sequence[float] | None = None,
) -> Column:
    """``W x + b`` as one matrix product per Arrow batch; null vectors give null."""
    import numpy as np

    matrix = np.asarray(weights, dtype="float64").T
    offset = np.zeros(matrix.shape[1]) if bias is None else np.asarray(bias, dtype="float64")

    @F.arrow_udf("array<double>")
    def score(batch):
        import numpy as np
        import pyarrow as pa

        known = np.asarray(batch.is_valid())
        x = batch.drop_null().flatten().to_numpy(zero_copy_only=False)
        x = x.astype("float64").reshape(-1, matrix.shape[0])
        out = (x @ matrix + offset).ravel()
        ends = np.concatenate([[0], np.cumsum(known * matrix.shape[1])]).astype("int32")
        return pa.ListArray.from_arrays(ends, out, mask=pa.array(~known))

    return score(_c(vector))


def _as_matrix(values, width):
    """Arrays as rows of a matrix; a null array reads as zeros, see :func:`_absent`."""
    import numpy as np

    known = np.asarray(values.is_valid())
    flat = values.drop_null().flatten().to_numpy(zero_copy_only=False)
    matrix = np.zeros((len(values), width))
    matrix[known] = flat.astype("float64").reshape(-1, width)
    return matrix


def _absent(*columns):
    """Rows in which one of the arrays is null: their result is null."""
    import numpy as np

    return np.any([np.asarray(c.is_null()) for c in columns], axis=0)


def _activation(x, single):
    import numpy as np

    if single:
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)
    return 1.0 / (1.0 + np.exp(-x))


def emd_loss(
    logits: Column | str,
    gold: Column | str,
    orders: Sequence[Sequence[int]],
    gaps: Sequence[Sequence[float]],
    kind: str = "multi",
    parts: bool = False,
) -> Column:
    """Distribution loss of a 3K logit array against a K multi-hot array.

    Per axis: gap-weighted squared distance of the cumulative distributions,
    plus the squared probability differences over K; then the mean of the
    axes.  With ``parts`` the result is a struct of the loss and its six terms.
    """
    import numpy as np

    order = np.asarray(orders)
    weight = np.asarray(gaps, dtype="float64")
    size, single = order.shape[1], kind == "single"
    names = [f"{part}_{axis}" for part in ("between", "within") for axis in "vad"]
    schema = "struct<loss:double," + ",".join(f"{n}:double" for n in names) + ">"

    @F.arrow_udf(schema if parts else "double")
    def score(logit_batch, gold_batch):
        import numpy as np
        import pyarrow as pa

        p = _activation(_as_matrix(logit_batch, 3 * size).reshape(-1, 3, size), single)
        y = _as_matrix(gold_batch, size)[:, order]
        p_hat = p / (p.sum(axis=2, keepdims=True) + EPSILON)
        y_hat = y / (y.sum(axis=2, keepdims=True) + EPSILON)
        step = np.cumsum(p_hat, axis=2) - np.cumsum(y_hat, axis=2)
        between = (step * step * weight).sum(axis=2)
        within = ((p - y) ** 2).sum(axis=2) / size
        loss = (between + within).mean(axis=1)
        absent = _absent(logit_batch, gold_batch)
        if not parts:
            return pa.array(loss, mask=absent)
        columns = [loss, *between.T, *within.T]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["loss", *names], mask=pa.array(absent))

    return score(_c(logits), _c(gold))


def axis_cross_entropy(
    logits: Column | str, gold: Column | str, orders: Sequence[Sequence[int]], kind: str = "multi"
) -> Column:
    """Ablation loss: cross-entropy per axis, summed over the three axes."""
    import numpy as np

    order = np.asarray(orders)
    size, single = order.shape[1], kind == "single"

    @F.arrow_udf("double")
    def score(logit_batch, gold_batch):
        import numpy as np
        import pyarrow as pa

        absent = _absent(logit_batch, gold_batch)
        x = _as_matrix(logit_batch, 3 * size).reshape(-1, 3, size)
        y = _as_matrix(gold_batch, size)[:, order]
        if single:
            top = x.max(axis=2)
            lse = top + np.log(np.exp(x - top[..., None]).sum(axis=2))
            at = np.take_along_axis(x, y.argmax(axis=2)[..., None], axis=2)[..., 0]
            return pa.array((lse - at).sum(axis=1), mask=absent)
        terms = np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x)))
        return pa.array(terms.mean(axis=2).sum(axis=1), mask=absent)

    return score(_c(logits), _c(gold))


def vad_and_classes(
    logits: Column | str,
    orders: Sequence[Sequence[int]],
    sorted_scores: Sequence[Sequence[float]],
    kind: str = "multi",
) -> Column:
    """Expected V, A, D and the predicted classes of a 3K logit array, in one batch.

    ``classes`` is a 0/1 array (multi: geometric mean of the three sigmoids of a
    label is at least one half) or has one element, the first class with the
    largest logit sum (single).
    """
    import numpy as np

    order = np.asarray(orders)
    back = np.argsort(order, axis=1)
    scores = np.asarray(sorted_scores, dtype="float64")
    size, single = order.shape[1], kind == "single"

    @F.arrow_udf("struct<v:double,a:double,d:double,classes:array<int>>")
    def score(batch):
        import numpy as np
        import pyarrow as pa

        x = _as_matrix(batch, 3 * size).reshape(-1, 3, size)
        expected = (_activation(x, single) * scores).sum(axis=2)
        plain = np.take_along_axis(x, np.broadcast_to(back, x.shape), axis=2)
        if single:
            classes = plain.sum(axis=1).argmax(axis=1)[:, None]
        else:
            log_p = -np.logaddexp(0.0, -plain)
            classes = np.exp(log_p.sum(axis=1) / 3) >= 0.5
        width = classes.shape[1]
        ends = np.arange(0, (len(x) + 1) * width, width, dtype="int32")
        listed = pa.ListArray.from_arrays(ends, pa.array(classes.ravel().astype("int32")))
        return pa.StructArray.from_arrays(
            [*[pa.array(e) for e in expected.T], listed], ["v", "a", "d", "classes"], mask=pa.array(_absent(batch))
        )

    return score(_c(logits))
