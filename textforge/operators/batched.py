"""A user function over batches of rows: columns in, new columns out."""

from __future__ import annotations

from typing import Any, Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

MapBatch = Callable[[dict[str, list[Any]]], Mapping[str, Sequence[Any]]]


def map_batches(
    df: DataFrame,
    make_function: Callable[[], MapBatch],
    inputs: Sequence[str],
    outputs: str | T.StructType,
    keep: Sequence[str] = (),
    batch_size: int = 1000,
) -> DataFrame:
    """Columns ``keep`` unchanged, and the columns ``outputs`` that the function makes of ``inputs``.

    ``make_function`` is called once per task, on the executor, so it can load what it needs there. Its function
    gets a dict of lists, at most ``batch_size`` values each (and never those of two Arrow batches), and returns one
    list per output column with a value per row: lists, structs and nulls included. All other columns are dropped. A missing or
    additional column, a list of another length or a value of another type fails the job.
    """
    outputs = T.StructType.fromDDL(outputs) if isinstance(outputs, str) else outputs
    names, types = outputs.names, [to_arrow_type(f.dataType) for f in outputs]
    inputs, keep = list(inputs), list(keep)
    if clash := sorted({*names} & {*keep}):
        raise ValueError(f"{', '.join(clash)}: both kept and made")
    schema = T.StructType([df.schema[c] for c in keep] + outputs.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make_function()
        for whole in batches:
            for begin in range(0, whole.num_rows, batch_size):
                batch = whole.slice(begin, batch_size)
                column = {c: batch.column(batch.schema.get_field_index(c)) for c in dict.fromkeys([*inputs, *keep])}
                made = function({c: column[c].to_pylist() for c in inputs})
                if {*made} != {*names}:
                    raise ValueError(f"the function gave {sorted(made)}, not {sorted(names)}")
                for name in names:
                    if len(made[name]) != batch.num_rows:
                        raise ValueError(f"{name}: {len(made[name])} values for {batch.num_rows} rows")
                arrays = [pa.array(list(made[n]), t) for n, t in zip(names, types)]
                yield pa.RecordBatch.from_arrays([*(column[c] for c in keep), *arrays], names=schema.names)

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, schema)
