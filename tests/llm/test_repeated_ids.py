"""Line deduplication of rows that repeat an id."""

from pyspark.sql import functions as F

from furrow.llm import line_dedup


def test_drop_lists_hold_each_line_once(spark):
    lines = [f"a line that is found again {i}" for i in range(20)]
    rows = [(0, "\n".join(lines))] + [(5, "\n".join(lines[:10 + i % 10])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    index = line_dedup.shard_index(docs, 1)
    lists = line_dedup.drop_lists(line_dedup.repeated_lines(docs, index, 1)).withColumn("n", F.size("drops")).collect()
    assert [(r.doc, r.n) for r in lists] == [(5, 19)]
    kept = line_dedup.deduplicated(docs).collect()
    assert len(kept) == 61 and all(r.kept_text == "" and r.n_dropped == r.n_lines for r in kept if r.doc_id == 5)
