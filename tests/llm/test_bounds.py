"""What operators hold at once, in memory and on disk."""

import pyarrow as pa
from pyspark.sql import functions as F

from cuespan.llm import quality
from cuespan.llm.texts import by_batch


def test_batches_of_long_texts_end_by_their_bytes(spark):
    texts = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    sizes = by_batch(texts, lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"]), "n long, size long")
    rows = sizes.collect()
    assert sum(r["n"] for r in rows) == 2000
    assert max(r["size"] for r in rows) < 5_000_000


def test_quality_of_texts_over_many_batches(spark):
    rows = [(i, ("good words stand here. " if i % 2 else "BAD!! $$ ## 99 ") * (200 + i)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1500)], "doc_id long, quality int")
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} == {i for i in range(1500) if i % 2}
