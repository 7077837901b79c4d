from leafmill.plans import text_queries as tx


def test_old_side_is_whole(spark, tmp_path):
    """A text damaged behind its first 400 characters only is an improvement."""
    text = "The surveyor was here and the people of the town were there. " * 8 + "\n\n" + "The people are over there on some of the open roads here. " * 40
    spark.createDataFrame([(1, "/mnt/c/a.pdf", text)], "doc_id long, path string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = tx.QUERIES["ref_j3_improve"](spark, str(tmp_path)).first()
    assert row.better and row.change == "improved"
