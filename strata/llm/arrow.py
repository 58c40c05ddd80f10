"""Arrow-batched Python over one text column, without moving texts between tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows in one Arrow batch: texts of megabytes must fit a worker's memory together.
BATCH_ROWS = 256


def over_texts(
    docs: DataFrame, keep: list[str], text_col: str, schema: str, start: Callable[[], Callable[[list[str]], list]]
) -> DataFrame:
    """Columns ``keep`` and those of ``schema``, computed from each whole text.

    ``start`` runs once in each task and returns a function from a list of texts
    (null as empty) to one list or array per column of ``schema``. Bytes that are no
    UTF-8 are read as U+FFFD.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    source = docs.select(*[F.col(f"`{k}`") for k in keep], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]] if keep else []
    names = [*keep, *[part.strip().split()[0].strip("`") for part in schema.split(",")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            if batch.num_rows:
                made = [pa.array(x) for x in work([t.decode("utf-8", "replace") for t in batch.column("_text").to_pylist()])]
                kept = [batch.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=names)

    return source.mapInArrow(run, ", ".join([*fields, schema]))
