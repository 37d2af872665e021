"""Row-local operators run unchanged under Structured Streaming."""

import tempfile

from pyspark.sql import functions as F

from tertulia.streaming.text_stream import profile_stream, read_document_stream

from conftest import SF_SMALL


def test_stream_profile_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="stream-src-")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs.repartition(3).write.mode("overwrite").parquet(src + "/in")
    stream = profile_stream(read_document_stream(spark, src + "/in"))
    q = (stream.writeStream.format("memory").queryName("profile_out")
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM profile_out")
    want = profile_stream(docs)
    assert got.count() == docs.count()
    assert got.exceptAll(want).count() == 0
