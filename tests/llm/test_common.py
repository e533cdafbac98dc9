import pytest
from skylocus.llm.common import cut, release


def test_release_deletes_what_cut_wrote_and_nothing_else(spark, tmp_path):
    given = tmp_path / "in" / "documents.parquet"
    spark.range(5).write.parquet(str(given))
    source = spark.read.parquet(str(given))
    kept, gone = cut(source), cut(source)
    with pytest.raises(ValueError):
        release(spark, gone, source)
    with pytest.raises(ValueError):
        release(spark, kept.where("id > 1"))
    assert source.count() == kept.count() == gone.count() == 5
    release(spark, gone)
    assert source.count() == kept.count() == 5
    with pytest.raises(Exception):
        gone.count()
    with pytest.raises(ValueError):
        release(spark, gone)


def test_workers_leave_their_modules_out_of_collections(spark):
    """Each task collects what it left; before, that went through all modules each time."""
    import gc

    import pyarrow as pa
    from skylocus.llm.common import tidy

    def frozen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gc.get_freeze_count()] * batch.num_rows, pa.int64())], names=["n"])

    assert all(r.n > 1000 for r in spark.range(8, numPartitions=4).mapInArrow(tidy(frozen), "n long").collect())
