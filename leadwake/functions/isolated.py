"""Python steps whose failures stay in their row."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type


def isolated(fn: Callable, value: str) -> Callable[..., Column]:
    """``fn`` over rows as an Arrow step giving ``struct<value, error>`` per row.

    ``error`` is null where ``fn`` returned, else "ErrorName: message", and ``value`` is null then.  A result that doesn't fit
    the type ``value`` (DDL) is an error of its own row as well.  Rows are handed over one by one, so the Python objects of
    one row live at a time.  Only exceptions are held; a worker killed for memory is retried by Spark as usual.
    """
    kind = to_arrow_type(T.DataType.fromDDL(value))

    @F.arrow_udf(f"struct<value: {value}, error: string>")
    def step(*columns: pa.Array) -> pa.Array:
        values, errors = [], []
        for k in range(len(columns[0])):
            try:
                values.append(pa.scalar(fn(*[c[k].as_py() for c in columns]), kind))
                errors.append(None)
            except Exception as failure:  # the row's own result, whatever went wrong
                values.append(pa.scalar(None, kind))
                errors.append(f"{type(failure).__name__}: {failure}")
        return pa.StructArray.from_arrays([pa.array([v.as_py() for v in values], kind), pa.array(errors, pa.string())], ["value", "error"])

    return step
