"""What substring dedup and written tables leave on disk."""

from pyspark.sql import functions as F

from cuespan.llm import sentences
from cuespan.session import written, written_paths


def test_span_tables_go_once_they_are_used(spark):
    passage = "one two three four five six seven. eight nine ten eleven twelve. " * 3
    docs = spark.createDataFrame([(i, f"start {i}. {passage}") for i in range(6)], "doc_id long, text string")
    before = written_paths(spark)
    found = sentences.remove_repeats(docs)
    # The ranges to take out are there still; spans, counts and first places are not.
    assert len(written_paths(spark)) == len(before) + 1
    assert all(r["n_removed"] > 0 for r in found.collect())


def test_spans_in_turns_are_those_of_one(spark):
    docs = spark.createDataFrame(
        [(i, " ".join(f"w{(i % 4) * 7 + j % 31}" + "." * (j % 6 == 5) for j in range(90))) for i in range(12)], "doc_id long, text string")
    told = [sorted(map(str, sentences.repeated_spans(docs, turns=n).collect())) for n in (1, 4)]
    assert told[0] == told[1] and told[0]


def test_shuffle_files_go_when_a_table_is_written(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return found.mkString(",").count("/shuffle_")

    before = files()
    written(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n")))
    assert files() <= before
