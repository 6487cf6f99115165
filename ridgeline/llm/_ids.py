"""Rows without those of a list of ids, where rows are wide: only rows that may be in the list are shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The filter has so many bits at most (8 MB); a fuller one only lets more rows through to the join.
FILTER_BITS = 1 << 26


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't among ids (a written table). A Bloom filter of bounded size passes most rows by; the rest
    are joined, so the result is exact. Rows with a null key stay. A key may be a struct; ids are distinct."""
    spark, columns = rows.sparkSession, rows.columns
    size = 1 << 10
    while size < min(16 * ids.count(), FILTER_BITS):
        size *= 2
    places = lambda c: [F.pmod(F.xxhash64(c), F.lit(size)), F.pmod(F.xxhash64(c, F.lit("second")), F.lit(size))]
    set_bits = ids.select(F.explode(F.array(*places(F.col(key)))).alias("p")).selectExpr("p div 64 as word", "shiftleft(1L, cast(p % 64 as int)) as bit")
    words = set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(size // 64, np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def may_hold(first: pa.Array, second: pa.Array) -> pa.Array:
        table, ok = shared.value.view(np.uint64), None
        for p in (first, second):
            p = p.to_numpy(zero_copy_only=False).astype(np.int64)
            one = (table[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ok = one if ok is None else ok & one
        return pa.array(ok, pa.bool_())

    found = may_hold(*places(F.col(key)))
    return rows.where(~found).unionByName(rows.where(found).join(ids.select(key).distinct(), key, "left_anti").select(*columns))
