"""Table functions and grouped functions in Python that see whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udtf, pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


@arrow_udtf(returnType=StructType([StructField("id", LongType()), StructField("at", IntegerType()), StructField("sentence", StringType())]))
class Sentences:
    """The sentences of the texts of a table (id, text), each without spaces around; parts between full stops that are
    blank are left out, and null texts have none. A call gets a batch of rows."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        parts = pc.split_pattern_regex(rows.column("text").fill_null(""), "[.!?]+")
        ids, sentence = rows.column("id").take(pc.list_parent_indices(parts)), pc.utf8_trim(pc.list_flatten(parts), " \t\n\r\x0b\x0c")
        table = pa.table({"id": ids, "sentence": sentence}).filter(pc.not_equal(sentence, ""))
        # Places count the sentences of a text from 1; its rows stand together.
        own = table.column("id").combine_chunks().to_pandas()
        at = own.groupby((own != own.shift()).cumsum()).cumcount() + 1
        yield pa.table({"id": table.column("id"), "at": pa.array(at, pa.int32()), "sentence": table.column("sentence")})


@pandas_udf(DoubleType())
def trimmed_mean(value: pd.Series, times: pd.Series) -> float:
    """The mean without the tenth of the rows at either end, of a group's distinct values and how often each occurs."""
    order = value.argsort()
    value, times = value.iloc[order].to_numpy(float), times.iloc[order].to_numpy("int64")
    upto, n = times.cumsum(), int(times.sum())
    cut = n // 10
    kept = (upto.clip(max=n - cut) - (upto - times).clip(min=cut)).clip(min=0)
    return float((value * kept).sum() / kept.sum()) if n else None
