"""Attribution of any model's score by Shapley kernel regression on a background sample.

A coalition says which features keep a row's own values; the others take those of a background row. Every
row is spread over coalitions and background rows, scored in one pass by the model, and the row's
contributions are the weighted regression of the mean scores on the coalitions, bound to add up to the score minus
the background's mean. Coalitions and weights are the same for all rows, so the regression is one small matrix,
solved once: a contribution is a sum of scores times its numbers, and one map-side combined aggregate
per row gives them all. With no more subsets than coalitions allowed, the result is exact.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.operators.sampling import sample_n

# --- fixed values: background rows and coalitions of a row
BACKGROUND = 100
COALITIONS = 100


def coalitions(size: int, most: int = COALITIONS, seed: int = fv.SEED) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions between none and all (rows of 0 and 1), and their weights.

    Subset sizes are taken in pairs from the outside in, whole ones while they fit; the rest of the room
    goes to a deterministic draw from the sizes that are left, which shares their weight.
    """
    rows: dict[tuple[int, ...], float] = {}
    room = most
    sizes = list(range(1, size))
    weight_of = {k: (size - 1) / (k * (size - k)) for k in sizes}
    while sizes:
        pair = sorted({sizes[0], size - sizes[0]})
        count = sum(math.comb(size, k) for k in pair)
        if count > room:
            break
        for k in pair:
            for members in itertools.combinations(range(size), k):
                rows[tuple(int(i in members) for i in range(size))] = weight_of[k] / math.comb(size, k)
            sizes.remove(k)
        room -= count
    if sizes and room:
        rng = np.random.default_rng((seed, size, most))
        shares = np.array([weight_of[k] for k in sizes])
        drawn: dict[tuple[int, ...], int] = {}
        for _ in range(room * 20):
            if len(drawn) + 1 >= room:
                break
            members = rng.permutation(size)[: rng.choice(sizes, p=shares / shares.sum())]
            row = np.isin(np.arange(size), members).astype(int)
            # a draw and its opposite balance each other
            for one in (tuple(row.tolist()), tuple((1 - row).tolist())):
                drawn[one] = drawn.get(one, 0) + 1
        total = sum(drawn.values())
        rows.update({row: shares.sum() * n / total for row, n in drawn.items()})
    table = np.array(list(rows), float).reshape(len(rows), size)
    return table, np.array(list(rows.values()))


def regression(table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(feature, coalition) numbers that turn mean scores into contributions; none and all come first and second."""
    size = table.shape[1]
    ends = np.zeros((size, 2 + len(table)))
    if size == 1:
        ends[0, :2] = -1, 1
        return ends
    design = table[:, :-1] - table[:, -1:]
    solve = np.linalg.pinv((design * weights[:, None]).T @ design) @ (design * weights[:, None]).T
    # what is explained: score - none - last * (all - none)
    target = np.zeros((len(table), 2 + len(table)))
    target[:, 2:] = np.eye(len(table))
    target[:, 0] = table[:, -1] - 1
    target[:, 1] = -table[:, -1]
    ends[:-1] = solve @ target
    ends[-1, :2] = -1, 1
    ends[-1] -= ends[:-1].sum(0)
    return ends


def _listed(values: np.ndarray) -> Column:
    """Numbers as one constant array."""
    return F.split(F.lit(",".join(map(repr, np.asarray(values, float).ravel().tolist()))), ",").cast("array<double>")


def kernel_attribution(
    df: DataFrame, scored: Callable[[DataFrame], DataFrame], names: Sequence[str], id_col: str,
    background: DataFrame | None = None, most: int = COALITIONS, seed: int = fv.SEED, prefix: str = "phi_",
) -> DataFrame:
    """Id, features and their contributions; they add up to the score minus the background's mean.

    ``scored`` adds a column ``score`` to rows with the named columns. The background is ``BACKGROUND`` rows of
    ``df`` with the smallest draws, or the rows given, which must be few. Ids must be unique; null feature values are
    handed on to the model as they are.
    """
    names = list(names)
    rows = (sample_n(df, id_col, BACKGROUND, seed) if background is None else background).select(
        *[F.col(n).cast("double").alias(n) for n in names]
    ).collect()
    if not rows:
        return df.select(id_col, *names, *[F.lit(None).cast("double").alias(f"{prefix}{n}") for n in names])
    others = np.array([[math.nan if x is None else x for x in r] for r in rows], float)
    table, weights = coalitions(len(names), most, seed)
    table = np.vstack([np.zeros(len(names)), np.ones(len(names)), table])
    numbers = regression(table[2:], weights)
    count, many = len(table), len(others)
    spread = df.select(id_col, *[F.col(n).cast("double").alias(n) for n in names]).withColumn(
        "_at", F.explode(F.sequence(F.lit(0), F.lit(count * many - 1)))
    )
    coalition, other = F.floor(F.col("_at") / many).cast("int"), (F.col("_at") % many).cast("int")
    mixed = spread.select(
        id_col, coalition.alias("_coalition"),
        *[
            F.when(_listed(table[:, i])[coalition] == 1, F.col(n)).otherwise(_listed(others[:, i])[other]).alias(n)
            for i, n in enumerate(names)
        ],
    )
    parts = [
        (F.sum(_listed(numbers[i])[F.col("_coalition")] * F.col("score")) / many).alias(f"{prefix}{n}") for i, n in enumerate(names)
    ]
    found = scored(mixed).groupBy(F.col(id_col).alias("_id")).agg(*parts)
    return df.select(id_col, *names).join(found, F.col(id_col) == F.col("_id")).drop("_id")
