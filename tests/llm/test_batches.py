"""Memory of the Python workers that read texts."""

import sys

from tesserae.llm import common, toxicity


def test_texts_come_in_small_batches(spark):
    class Sizes:
        """Gives as a text's severity the bytes of the Arrow batch that it came in."""

        def expected(self, text):
            return float(sys._getframe(1).f_locals["batch"].nbytes)

    docs = spark.range(0, 200, 1, 1).selectExpr("id AS doc_id", "repeat('abcdefghij', 10000) AS text")
    got = {r.doc_id: r.severity for r in toxicity.score(docs, Sizes()).collect()}
    assert sorted(got) == list(range(200))
    assert max(got.values()) <= common.BATCH_BYTES + 200_000  # a batch ends with the row that passes the size

    long = spark.range(3).selectExpr("id AS doc_id", "repeat('x', 6000000) AS text")
    assert [r.severity >= 6_000_000 for r in toxicity.score(long, Sizes()).collect()] == [True] * 3


def test_a_smaller_batch_size_is_kept(spark):
    key, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        for given, want in (("1m", "1m"), ("64m", str(common.BATCH_BYTES))):
            spark.conf.set(key, given)
            assert common.map_texts(spark.range(5), iter, "id long").count() == 5
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)
