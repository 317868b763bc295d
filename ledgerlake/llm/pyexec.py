"""Python columns that leave every other column in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def struct_udf(fn: Callable[..., dict[str, list]], ddl: str, arrow: pa.StructType) -> Callable[..., Column]:
    """An Arrow UDF that returns a struct; ``fn`` turns input arrays into one list per field.

    It counts as not deterministic, so that a filter on its result is not evaluated by a
    second call below the first.
    """

    @F.arrow_udf(ddl)
    def run(*arrays: pa.Array) -> pa.Array:
        made = fn(*arrays)
        return pa.StructArray.from_arrays([pa.array(made[f.name], type=f.type) if not isinstance(made[f.name], pa.Array) else made[f.name] for f in arrow], fields=list(arrow))

    return run.asNondeterministic()
