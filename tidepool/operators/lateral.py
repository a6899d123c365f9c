"""The chunkers as table functions of SQL: ``SELECT d.doc_id, c.* FROM documents d, LATERAL chunk_standard(d.text, 400, 80) c``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tidepool.operators import chunking

CHUNKS = "chunk_index int, content string, tokens int"


class _Standard:
    """Whole sentences up to ``size`` tokens, with an overlap of whole sentences. Null and empty texts have no chunks."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        for i, c in enumerate(chunking.standard_chunks(text or "", size, overlap)):
            yield i, c, chunking.count_tokens(c)


class _Semantic:
    """Sentences (an array, e.g. of ``protected_sentences``) packed with overlaps of whole and partial ones."""

    def eval(self, sentences: list, size: int, overlap: int) -> Iterator[tuple]:
        for i, c in enumerate(chunking.semantic_chunks(list(sentences or []), size, overlap)):
            yield i, c, chunking.count_tokens(c)


class _Tree:
    """Chunks along the tree of markdown sections: kind, node, parent, level and title beside the chunk."""

    def eval(self, title: str, text: str, size: int, overlap: int) -> Iterator[tuple]:
        if text:
            for row in chunking.tree_rows(0, title or "", text, size, overlap):
                yield row[1:]


class _Levels:
    """Header and part chunks of sections; chunk ids hold the document's."""

    def eval(self, doc_id: int, text: str, size: int) -> Iterator[tuple]:
        for row in chunking.level_rows(doc_id, text or "", size):
            yield row[1:]


def _columns(schema: str) -> str:
    """A chunk schema without its document."""
    return schema.partition(", ")[2]


def register(spark: SparkSession) -> SparkSession:
    """Make chunk_standard, chunk_semantic, chunk_tree and chunk_levels known to SQL in this session."""
    for name, function, schema in (("chunk_standard", _Standard, CHUNKS), ("chunk_semantic", _Semantic, CHUNKS), ("chunk_tree", _Tree, _columns(chunking.TREE_CHUNK)), ("chunk_levels", _Levels, _columns(chunking.LEVEL_CHUNK))):
        spark.udtf.register(name, udtf(function, returnType=schema))
    return spark
