"""The chunkers in SQL give the rows of the chunkers on frames."""

from pyspark.sql import functions as F

from tidepool.functions.text import protected_sentences
from tidepool.operators import chunking, lateral

TEXTS = [(1, "One sentence here. Another one follows! " * 60), (2, None), (3, ""), (4, "# Head\n\nbody text. More of it.\n\n## Sub\n| a | b |\n| 1 | 2 |\nend")]


def _rows(df):
    return sorted(map(str, df.collect()))


def test_lateral_chunkers(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("sentences", protected_sentences(F.col("text")))
    docs.createOrReplaceTempView("lateral_docs")
    lateral.register(spark)
    got = spark.sql("select d.doc_id, c.* from lateral_docs d, lateral chunk_standard(d.text, 100, 20) c")
    assert _rows(got) == _rows(chunking.chunk(docs, "standard", 100, 20)) and got.count() > 3
    got = spark.sql("select d.doc_id, c.* from lateral_docs d, lateral chunk_semantic(d.sentences, 100, 20) c")
    assert _rows(got) == _rows(chunking.chunk(docs, "semantic", 100, 20))
    got = spark.sql("select d.doc_id, c.* from lateral_docs d, lateral chunk_tree('t', d.text, 400, 50) c")
    assert _rows(got) == _rows(chunking.tree_chunks(docs, 400, 50, title=F.lit("t")))
    got = spark.sql("select d.doc_id, c.* from lateral_docs d, lateral chunk_levels(d.doc_id, d.text, 400) c")
    assert _rows(got) == _rows(chunking.level_chunks(docs, 400))
