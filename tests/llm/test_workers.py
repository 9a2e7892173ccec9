"""Workers of Python that a task of the pipeline takes at once."""

import corpus_pipeline


def test_passages_take_one_worker(spark):
    words = " ".join(f"word{i}" for i in range(90))
    docs = spark.createDataFrame([(i, f"own{i} ä {words} end{i}", "en", "web", 9) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    made = corpus_pipeline.repeated_passages(spark, docs, "")
    assert made._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    rows = made.collect()
    assert made.columns == corpus_pipeline.COLUMNS and all(r.n_chars == len(r.text) and "word50" not in r.text and f"own{r.doc_id}" in r.text for r in rows)
