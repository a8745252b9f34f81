"""Keys of a table's rows, and a table without some of its rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm._store import stored
from keyfold.llm.jaccard_join import MARKS, _marked

#: Keys that are sent to all tasks as they are: some 3 MB.
SENT_KEYS = 1 << 16


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a text column that tells all rows apart, the same whenever it is read, and the column's name.

    Rows of files are told apart by file and place in it, so nothing is written; rows of anything else
    are stored once with a number.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    if "_metadata" not in docs.columns:
        try:
            place = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
            return docs.withColumn(name, place), name
        except AnalysisException:
            pass  # no rows of files
    return stored(docs.withColumn(name, F.monotonically_increasing_id().cast("string")), "rows"), name


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose ``key`` is not among those of the stored table ``gone``, without the key.

    Few keys are sent to all tasks. Beyond ``SENT_KEYS``, a bit map of fixed size is: rows it rules out stay where
    they are, and only the others are joined with the keys.
    """
    gone = gone.select(key)
    if gone.count() <= SENT_KEYS:
        return rows.join(F.broadcast(gone), key, "left_anti").drop(key)
    marks = _marked(rows.sparkSession, gone.select(F.xxhash64(key).alias("sig")))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        bit = hashes.to_numpy().view(np.uint64) % np.uint64(MARKS)
        held = marks.value[(bit >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8)) & 1
        return pd.Series(held == 1)

    clear = rows.where(~maybe(F.xxhash64(key)))
    return clear.unionByName(rows.where(maybe(F.xxhash64(key))).join(gone, key, "left_anti").select(rows.columns)).drop(key)
