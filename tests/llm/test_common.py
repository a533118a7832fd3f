import pyarrow as pa
from pyspark.sql import functions as F

from loomtext.llm.common import BATCH_BYTES, BATCH_CONF, mapped


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})


def test_batches_of_long_texts_are_bounded_and_whole(spark):
    d = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("text"))
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.unset(BATCH_CONF)
    try:
        n = [r.n for r in mapped(d, sizes, "n long").collect()]
        assert sum(n) == 2000 and max(n) * 20_000 < 1.1 * BATCH_BYTES
        spark.conf.set(BATCH_CONF, str(64 << 20))
        assert [r.n for r in mapped(d, sizes, "n long").collect()] == [2000]
        assert spark.conf.get(BATCH_CONF) == str(64 << 20)
    finally:
        spark.conf.unset(BATCH_CONF)
        if before is not None:
            spark.conf.set(BATCH_CONF, before)


def test_a_text_beyond_the_bound_and_an_empty_table(spark):
    long = spark.range(1).select(F.repeat(F.lit("x"), 3 * BATCH_BYTES).alias("text"))
    assert [r.n for r in mapped(long, sizes, "n long").collect()] == [1]
    assert sum(r.n for r in mapped(long.where("false"), sizes, "n long").collect()) == 0
