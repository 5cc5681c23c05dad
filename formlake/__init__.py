"""formlake: form retrieval, layout and medallion jobs as Spark DataFrame operators."""
