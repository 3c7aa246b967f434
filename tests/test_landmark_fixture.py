"""The landmark fixture takes every word and leaves none of its chance hits out."""

from suite.projections import TEXT_CONFIG, Tables


def test_each_word_is_a_peak_of_its_own_spelling(spark, tmp_path):
    spark.createDataFrame([(1, "a song a dance of the night")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    peaks = {r["frame"]: r["bin"] for r in Tables(spark, str(tmp_path)).peaks("documents", "doc_id").collect()}
    assert len(peaks) == 7
    assert peaks[0] == peaks[2]  # whatever word follows
    assert TEXT_CONFIG.ratio_quantization == 4096
