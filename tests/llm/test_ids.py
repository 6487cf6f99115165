"""Anti-joins by filter against plain ones."""

from ridgeline.llm import _ids
from ridgeline.llm._ids import without


def test_without(spark, monkeypatch):
    rows = spark.createDataFrame([(None if k % 97 == 0 else k, f"t{k}") for k in range(3000)], "doc_id long, text string")
    for bits, ids in ((1 << 26, range(0, 3000, 7)), (1 << 10, range(0, 3000, 2)), (1 << 26, [])):
        monkeypatch.setattr(_ids, "FILTER_BITS", bits)
        listed = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        got = without(rows, listed, "doc_id")
        assert got.columns == rows.columns
        assert sorted(r.text for r in got.collect()) == sorted(r.text for r in rows.join(listed, "doc_id", "left_anti").collect())
