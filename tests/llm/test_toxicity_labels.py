from pyspark.sql import functions as F

from pagequarry.llm import toxicity


def test_labels_without_document_say_nothing(spark):
    docs = spark.range(80).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 4 == 0, "you horrid nasty fool go away").otherwise("a calm day by the green river").alias("text"),
    )
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    strays = spark.range(1000, 4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))

    def found(table):
        rows = toxicity.severity(docs, table).collect()
        return {r["doc_id"]: (round(r["severity"], 6), r["toxic"]) for r in rows}

    plain = found(labels)
    assert plain == found(labels.unionByName(strays))
    assert all(toxic == (doc % 4 == 0) for doc, (_, toxic) in plain.items())


def test_only_labels_without_document(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id LONG, text STRING")
    strays = spark.createDataFrame([(8, 1), (9, 0)], "doc_id LONG, toxic INT")
    assert [(r["severity"], r["grade"], r["toxic"]) for r in toxicity.severity(docs, strays).collect()] == [(0.0, 0, False)] * 2
