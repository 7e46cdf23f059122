"""Row-wise cleaning of a stream: the batch operators that need no other row run unchanged on one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions import cast
from ..operators import clean


def cleaned(stream: DataFrame, types: dict[str, str], tokens: Sequence[str] = cast.STRICT_TOKENS, id_cols: Sequence[str] = ()) -> DataFrame:
    """Missing tokens, types fitted on a training table, and normalised texts, for each arriving row."""
    return clean.standardise(clean.apply_schema(clean.replace_missing(stream, tokens), types), id_cols)


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, appended exactly once as Parquet."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
