"""SQL functions and a Python table function: `register` makes them usable in spark.sql."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import chunking, parsing

#: Name -> definition over the views `runs` and `files`. Null repositories are equal to each other.
SQL_FUNCTIONS = {
    "get_next_sequence": "CREATE OR REPLACE TEMPORARY FUNCTION get_next_sequence(proj STRING, stamp STRING) RETURNS INT RETURN (SELECT coalesce(max(sequence), 0) + 1 FROM runs WHERE project_id = proj AND timestamp = stamp)",
    "find_duplicate_file": "CREATE OR REPLACE TEMPORARY FUNCTION find_duplicate_file(proj STRING, repo STRING, digest STRING) RETURNS TABLE (id STRING, relative_path STRING) RETURN SELECT r.id, r.relative_path FROM (SELECT min(struct(created_at, id, relative_path)) AS r FROM files WHERE project_id = proj AND repository_id <=> repo AND file_hash = digest) WHERE r IS NOT NULL",
    "find_previous_file_version": "CREATE OR REPLACE TEMPORARY FUNCTION find_previous_file_version(proj STRING, repo STRING, path STRING) RETURNS TABLE (id STRING, file_hash STRING) RETURN SELECT r.id, r.file_hash FROM (SELECT max(struct(created_at, id, file_hash)) AS r FROM files WHERE project_id = proj AND repository_id <=> repo AND relative_path = path) WHERE r IS NOT NULL",
}


@udtf(returnType="kind: string, name: string")
class CodeEntities:
    """SELECT * FROM code_entities(content): what a Python text defines and imports."""

    def eval(self, content: str):
        classes, functions, imports, _ = parsing.parse_python(content)
        for c in classes:
            yield "class", c[0]
        for f in functions:
            yield "function", f[0]
        for i in imports:
            yield "import", i


@udtf(returnType="chunk_no: int, kind: string, chunk: string")
class CodeChunks:
    """SELECT * FROM code_chunks(extension, content)."""

    def eval(self, extension: str, content: str):
        if content is not None:
            for i, (kind, chunk) in enumerate(chunking.chunk_text(extension, content)):
                yield i, kind, chunk


def register(spark: SparkSession) -> None:
    """Register all; the SQL functions need the views runs and files."""
    for definition in SQL_FUNCTIONS.values():
        spark.sql(definition)
    spark.udtf.register("code_entities", CodeEntities)
    spark.udtf.register("code_chunks", CodeChunks)
