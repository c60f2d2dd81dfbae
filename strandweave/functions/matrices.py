"""Matrix measures as Arrow batches of numpy, where built-ins can't express them: one stacked decomposition for each batch and vector length."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from strandweave.functions import numeric


def _by_length(f: Callable[..., np.ndarray], columns: tuple[pd.Series, ...]) -> np.ndarray:
    """f over the rows of each vector length, stacked; null vectors and pairs of unequal length give null."""
    size = [np.array([-1 if x is None else len(x) for x in c]) for c in columns]
    out = np.full(len(columns[0]), None, object)
    same = np.logical_and.reduce([s == size[0] for s in size])
    for n in np.unique(size[0][same & (size[0] > 0)]):
        at = np.flatnonzero(same & (size[0] == n))
        out[at] = f(*[np.array([np.asarray(x, float) for x in c.iloc[at]]) for c in columns])
    return out


def _pairwise(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Column, Column], Column]:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_by_length(f, (a, b)).astype(float))

    udf = F.pandas_udf(run, DoubleType())

    def measured(a: Column | str, b: Column | str) -> Column:
        a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
        return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(udf(a, b), F.lit(float("nan"))))  # Arrow gives NaN back as null

    return measured


foerstner = _pairwise(numeric.foerstner_batch)
log_frobenius = _pairwise(numeric.log_frobenius_batch)


def _psd(v: pd.Series) -> pd.Series:
    return pd.Series(_by_length(numeric.psd_batch, (v,)), dtype="boolean")


psd = F.pandas_udf(_psd, BooleanType())
MATRIX = {"log_frobenius": log_frobenius, "foerstner": foerstner}
