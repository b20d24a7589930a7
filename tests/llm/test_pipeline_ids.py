"""The pipeline's last stage returns the token ids themselves."""

import zlib

import numpy as np

import corpus_pipeline


def test_packed_rows_have_their_ids(spark):
    docs = spark.createDataFrame([(i, "some words to pack " * (i + 1)) for i in range(5)] + [(5, None)], "doc_id long, text string")
    rows = corpus_pipeline.packed(spark, docs, "").collect()
    assert len(rows) == 6
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32
