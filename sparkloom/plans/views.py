"""Views of the given tables in the shape of a document library.

The column expressions are plain SQL that Spark and DuckDB read alike, so both sides of a
comparison see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import table

#: Chunks of documents: a source is a document, its rows are the chunks, in the order of their id.
CHUNKS = {
    "id": "doc_id",
    "document_id": "source",
    "idx": "doc_id",
    "owner": "concat('u', doc_id % 7)",
    "folder": "case when doc_id % 5 = 0 then null else concat('f', doc_id % 5) end",
    "status": "case when doc_id % 11 = 0 then 'error' when doc_id % 11 = 1 then 'parsing' else 'done' end",
    "kind": "case when doc_id % 10 = 7 then 'table' when doc_id % 10 = 9 then 'image' else 'section' end",
    "section_id": "case when doc_id % 3 = 0 then '' else concat('s', cast(floor(doc_id / 60) as bigint)) end",
    "heading_path": "concat('h', cast(floor(doc_id / 100) as bigint))",
    "page_start": "cast(floor(doc_id / 40) as bigint)",
    "page_end": "cast(floor(doc_id / 40) as bigint) + doc_id % 2",
    "table_id": "case when doc_id % 10 = 7 then concat('t', cast(floor(doc_id / 200) as bigint)) end",
    "lang": "lang",
    "text": "text",
    "n_chars": "n_chars",
}

#: Memory items: a turn of a conversation, with the marks that the gate looks at.
MEMORY = {
    "id": "conv_id * 100 + turn",
    "tenant_id": "concat('t', conv_id % 3)",
    "user_id": "concat('u', conv_id % 11)",
    "project_id": "case when conv_id % 4 = 0 then null else concat('p', conv_id % 4) end",
    "thread_id": "conv_id",
    "turn": "turn",
    "scope": "case conv_id % 5 when 0 then 'user' when 1 then 'project' when 2 then 'document' when 3 then 'thread' else 'summary' end",
    "kind": "role",
    "content": "text",
    "confidence": "((conv_id * 7 + turn * 3) % 10) / 10.0",
    "relevance": "((conv_id * 3 + turn * 7) % 10) / 10.0",
    "sensitivity": "case when (conv_id + turn) % 9 = 0 then 'secret' when (conv_id + turn) % 4 = 0 then 'internal' else 'normal' end",
    "status": "case when (conv_id + turn) % 13 = 0 then 'deleted' when (conv_id + turn) % 7 = 0 then 'superseded' else 'active' end",
    "valid_day": "case when (conv_id + turn) % 6 = 0 then (conv_id + turn) % 30 end",
}


def as_sql(name: str, columns: dict[str, str], source: str) -> str:
    """A common table expression."""
    return f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*(f"{e} as {c}" for c, e in CHUNKS.items()))


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*(f"{e} as {c}" for c, e in MEMORY.items()))


CHUNKS_SQL = as_sql("chunks", CHUNKS, "documents")
MEMORY_SQL = as_sql("memory", MEMORY, "conversations")
