"""Sums over rows for fitting: moments, normal equations and Newton steps.

A task turns its rows into one array of sums (numpy over Arrow batches); the arrays are
added up in SUM_TASKS tasks and last on the driver, which sees SUM_TASKS arrays of the
size of the parameters, or of their square, and never rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

SUM_TASKS = 16


def summed(df: DataFrame, size: int, work: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``work(columns)``, an array of ``size`` numbers per batch.

    Every column of ``df`` is a number or an equal-length array and comes as a vector or a
    matrix of doubles.
    """

    def partial(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = []
            for column in batch.columns:
                if pa.types.is_list(column.type):
                    flat = column.flatten().to_numpy(zero_copy_only=False)
                    columns.append(flat.astype("float64").reshape(batch.num_rows, -1))
                else:
                    columns.append(column.to_numpy(zero_copy_only=False).astype("float64"))
            total += work(columns)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = df.mapInArrow(partial, "sums binary").repartition(SUM_TASKS).mapInArrow(_added, "sums binary")
    return np.sum([np.frombuffer(r["sums"]) for r in parts.collect()] or [np.zeros(size)], axis=0)


def _added(batches):
    """One array: the sum of a task's arrays."""
    import numpy as np
    import pyarrow as pa

    total = None
    for batch in batches:
        for value in batch.column(0):
            one = np.frombuffer(value.as_py())
            total = one if total is None else total + one
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def moments(df: DataFrame, width: int) -> np.ndarray:
    """``Z' Z`` of all rows, where a row of Z holds the ``width`` numbers of ``df``'s columns and a last 1."""

    def work(columns):
        import numpy as np

        z = np.column_stack([*columns, np.ones(len(columns[0]))])
        return (z.T @ z).ravel()

    return summed(df, (width + 1) ** 2, work).reshape(width + 1, width + 1)


def solve_symmetric(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve by Cholesky; a matrix that is not positive definite has no single solution and is an error."""
    try:
        lower = np.linalg.cholesky(matrix)
    except np.linalg.LinAlgError:
        raise ValueError("the columns depend on each other; use a larger ridge") from None
    return np.linalg.solve(lower.T, np.linalg.solve(lower, right))


def least_squares(df: DataFrame, width: int, targets: int, ridge: float, intercept: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``(weights, bias)``, a row per target, that minimise the mean squared error plus ``ridge`` |w|^2.

    The first ``width`` numbers of a row are its features, the next ``targets`` what to
    predict.  All targets share one pass and one factorisation.
    """
    full = moments(df, width + targets)
    rows = full[-1, -1]
    if not rows:
        raise ValueError("there are no rows to fit on")
    used = [*range(width), width + targets] if intercept else list(range(width))
    gram = full[np.ix_(used, used)] + rows * ridge * np.diag([1.0] * width + [0.0] * intercept)
    found = solve_symmetric(gram, full[np.ix_(used, range(width, width + targets))]).T
    return (found[:, :-1], found[:, -1]) if intercept else (found, np.zeros(targets))


def binomials(
    df: DataFrame, width: int, labels: int, ridge: float, steps: int = 30, tolerance: float = 1e-12,
) -> tuple[np.ndarray, np.ndarray, float]:
    """As :func:`multinomial`, one binary classifier per label; ``df`` holds the vector and a 0/1 array.

    All labels share a pass a step; each has a Hessian and a step length of its own.
    """
    side = width + 1
    penalty = np.array([ridge] * width + [1e-12])

    def evaluated(point: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def work(columns):
            import numpy as np

            x, y = np.column_stack([columns[0], np.ones(len(columns[0]))]), columns[1]
            z = x @ point.T
            p = 1 / (1 + np.exp(-z))
            loss = (np.logaddexp(0, z) - y * z).sum(axis=0)
            hessian = [(x * (p[:, i] * (1 - p[:, i]))[:, None]).T @ x for i in range(labels)]
            return np.concatenate([[len(x)], loss, ((p - y).T @ x).ravel(), np.ravel(hessian)])

        total = summed(df, 1 + labels * (1 + side + side * side), work)
        rows = total[0]
        if not rows:
            raise ValueError("there are no rows to fit on")
        loss, gradient, hessian = np.split(total[1:] / rows, [labels, labels * (1 + side)])
        return (loss + (penalty * point**2).sum(axis=1) / 2, gradient.reshape(labels, side) + penalty * point,
                hessian.reshape(labels, side, side) + np.diag(penalty))

    point, rate = np.zeros((labels, side)), np.ones(labels)
    loss, gradient, hessian = evaluated(point)
    for _ in range(steps):
        if np.abs(gradient).max() < tolerance:
            break
        trial = point - rate[:, None] * np.stack([solve_symmetric(h, g) for h, g in zip(hessian, gradient, strict=True)])
        new = evaluated(trial)
        better = new[0] <= loss + 1e-15
        rate = np.where(better, 1.0, rate / 2)
        point = np.where(better[:, None], trial, point)
        loss = np.where(better, new[0], loss)
        gradient = np.where(better[:, None], new[1], gradient)
        hessian = np.where(better[:, None, None], new[2], hessian)
    return point[:, :-1], point[:, -1], float(np.abs(gradient).max())


def multinomial(
    df: DataFrame, width: int, classes: int, ridge: float, steps: int = 30, tolerance: float = 1e-12,
) -> tuple[np.ndarray, np.ndarray, float]:
    """``(weights, bias, gradient norm)`` of the classifier of one class index, by Newton steps.

    ``df`` holds the vector and the class.  Minimises the mean negative log likelihood
    plus ``ridge`` / 2 |w|^2; biases are not penalised and sum to 0.  Gradient and Hessian
    come from one pass a step; a step that makes the loss worse is halved.
    """
    size = classes * (width + 1)

    def evaluated(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def work(columns):
            import numpy as np

            x = np.column_stack([columns[0], np.ones(len(columns[0]))])
            label = columns[1].astype("int64")
            z = x @ point.reshape(classes, width + 1).T
            z -= z.max(axis=1, keepdims=True)
            logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
            p = np.exp(logs)
            off = p.copy()
            off[np.arange(len(x)), label] -= 1
            hessian = np.zeros((classes, width + 1, classes, width + 1))
            for c in range(classes):
                for d in range(c, classes):
                    block = (x * (p[:, c] * ((c == d) - p[:, d]))[:, None]).T @ x
                    hessian[c, :, d], hessian[d, :, c] = block, block
            loss = -logs[np.arange(len(x)), label].sum()
            return np.concatenate([[loss, len(x)], (off.T @ x).ravel(), hessian.ravel()])

        total = summed(df, 2 + size + size * size, work)
        rows = total[1]
        if not rows:
            raise ValueError("there are no rows to fit on")
        weights = point.reshape(classes, width + 1).copy()
        weights[:, -1] = 0
        penalty = np.tile([ridge] * width + [0.0], classes)
        return (total[0] / rows + ridge / 2 * (weights**2).sum(), total[2 : 2 + size] / rows + ridge * weights.ravel(),
                total[2 + size :].reshape(size, size) / rows + np.diag(penalty))

    # Adding the same to all biases changes nothing; this keeps their mean where it is.
    biases = np.zeros(size)
    biases[width :: width + 1] = 1
    fixed = np.outer(biases, biases) / classes
    point, rate = np.zeros(size), 1.0
    loss, gradient, hessian = evaluated(point)
    for _ in range(steps):
        if np.abs(gradient).max() < tolerance:
            break
        trial = point - rate * solve_symmetric(hessian + fixed, gradient)
        new = evaluated(trial)
        if new[0] <= loss + 1e-15:
            point, (loss, gradient, hessian), rate = trial, new, 1.0
        else:
            rate /= 2
    head = point.reshape(classes, width + 1)
    return head[:, :-1], head[:, -1], float(np.abs(gradient).max())
