def docs_frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)
