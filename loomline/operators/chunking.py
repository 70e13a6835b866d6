"""Files into chunks for retrieval. Domain chunks of SQL are cut by built-in functions; greedy packing is a
fold over the lines of one file, run in an Arrow map (files are independent, so nothing is shuffled)."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import strip
from .parsing import find

OR = r"(?:OR\s+REPLACE\s+|OR\s+ALTER\s+)?"
#: Domain types of SQL objects in this order, and how their statements begin.
DOMAINS = (
    ("TABLE", rf"CREATE\s+{OR}(?:TEMP\s+|TEMPORARY\s+)?TABLE"),
    ("VIEW", rf"CREATE\s+{OR}VIEW"),
    ("FUNCTION", rf"CREATE\s+{OR}FUNCTION"),
    ("PROCEDURE", rf"CREATE\s+{OR}(?:PROCEDURE|PROC)"),
    ("TRIGGER", rf"CREATE\s+{OR}TRIGGER"),
    ("INDEX", r"CREATE\s+(?:UNIQUE\s+)?(?:CLUSTERED\s+)?(?:NONCLUSTERED\s+)?INDEX"),
    ("SCHEMA", r"CREATE\s+SCHEMA"),
)
SQL_TOKENS, CLASS_TOKENS, GENERIC_TOKENS, OVERLAP = 1500, 1000, 1000, 5


def estimate(text: str) -> int:
    return len(text) // 4


def domain_chunks(files: DataFrame, content: str = "content") -> DataFrame:
    """files with (chunk_no, domain, chunk): each created object up to the next; text before the first is dropped.

    Chunks are ordered by domain in order of first appearance, then by position.
    """
    any_object = "|".join(p for _, p in DOMAINS)
    pieces = F.filter(F.transform(F.split(F.col(content), rf"(?i)(?={any_object})"), strip), lambda s: s.rlike(rf"(?i)^(?:{any_object})"))
    kind = lambda s: F.coalesce(*[F.when(s.rlike(f"(?i)^(?:{p})"), F.lit(d)) for d, p in DOMAINS])
    typed = F.transform(pieces, lambda s, i: F.struct(kind(s).alias("domain"), i.alias("i"), s.alias("chunk")))
    order = F.array_distinct(F.transform("__t", lambda t: t["domain"]))
    sorted_ = F.array_sort(F.transform("__t", lambda t: F.struct(F.array_position("__order", t["domain"]).alias("g"), t["i"].alias("i"), t["domain"].alias("domain"), t["chunk"].alias("chunk"))))
    rows = files.withColumn("__t", typed).withColumn("__order", order).withColumn("__s", sorted_)
    return rows.select(*files.columns, F.posexplode("__s").alias("chunk_no", "__c")).select(*files.columns, "chunk_no", F.col("__c.domain").alias("domain"), F.col("__c.chunk").alias("chunk"))


def tables_of(c: Column) -> Column:
    return F.array_sort(F.array_distinct(find(c, r"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+([a-zA-Z_][\w.]*)")))


def embedding_text(context: Column, path: Column, kind: Column, tables: Column, content: Column) -> Column:
    """The text that is embedded: context, file, type and tables as comment lines before the content; no context or tables, no line."""
    before = F.when(context != "", F.concat(F.lit("-- Context:\n"), context, F.lit("\n")))
    named = F.when(F.size(tables) > 0, F.concat(F.lit("-- Tables: "), F.array_join(tables, ", ")))
    return F.concat_ws("\n", before, F.concat(F.lit("-- File: "), path), F.concat(F.lit("-- Type: "), kind), named, content)


# --- greedy packing -------------------------------------------------------------------------------


def pack(parts: list[str], most: int, glue: str) -> list[str]:
    """Parts joined by glue as long as the estimated tokens of all stay within `most`."""
    out, now, used = [], [], 0
    for p in parts:
        n = estimate(p)
        if now and used + n > most:
            out.append(glue.join(now))
            now, used = [], 0
        now.append(p)
        used += n
    return [*out, glue.join(now)] if now else out


def pack_statements(text: str) -> list[str]:
    return pack([f"{s.strip()};" for s in text.split(";") if s.strip()], SQL_TOKENS, "\n\n")


def pack_lines(text: str, most: int = GENERIC_TOKENS) -> list[str]:
    return pack(text.split("\n"), most, "\n")


def pack_overlapping(text: str, most: int = SQL_TOKENS) -> list[tuple[str, int, int]]:
    """(chunk, first line, last line): lines packed to `most` tokens, the last five repeated in the next chunk."""
    out, start, used = [], 0, 0
    lines = text.split("\n")
    for i, line in enumerate(lines):
        n = estimate(line)
        if i > start and used + n > most:
            out.append(("\n".join(lines[start:i]), start + 1, i))
            start = i - OVERLAP if i - start > OVERLAP else i
            used = sum(map(estimate, lines[start:i]))
        used += n
    return [*out, ("\n".join(lines[start:]), start + 1, len(lines))]


def cut_statement(statement: str) -> list[tuple[str, str, int, int, list[str]]]:
    """(kind, chunk, first and last offset in the statement, common table expressions it rests on) of a statement.

    Within the budget it is one chunk. Else its common table expressions are, each with the heads of those before it that it
    names, and the main part; without any its subqueries that fit; without those its statements packed.
    """
    if estimate(statement) <= SQL_TOKENS:
        return [("SQL_STATEMENT", statement, 0, len(statement) - 1, [])]
    spans = [(m.group(1), m.start(), _closing(statement, m.end() - 1)) for m in re.finditer(r"(?i)(?:\bwith\s+(?:recursive\s+)?|,\s*)(\w+)\s+as\s*\(", statement)]
    spans = [s for s in spans if s[2] > 0]
    if not spans:
        inner = [(m.start(), _closing(statement, m.start())) for m in re.finditer(r"(?i)\(\s*select\b", statement)]
        fitting = [("SQL_SUBQUERY", statement[a : b + 1], a, b, []) for a, b in inner if b > 0 and estimate(statement[a : b + 1]) <= SQL_TOKENS]
        if fitting:
            return fitting
        out, at = [], 0
        for c in pack_statements(statement):
            at = max(at, statement.find(c[:40].rstrip(";"), at))
            out.append(("SQL_STATEMENT", c, at, min(len(statement), at + len(c)) - 1, []))
        return out
    out, heads = [], {}
    for name, a, b in spans:
        body = statement[a : b + 1].lstrip(", \n")
        used = [n for n in heads if re.search(rf"\b{n}\b", body)]
        out.append(("SQL_CTE", "\n".join([*[heads[n] for n in used], body]), b + 1 - len(body), b, used))
        heads[name] = body[:500]
    end = spans[-1][2] + 1
    main = statement[end:].strip()
    if main:
        used = [n for n in heads if re.search(rf"\b{n}\b", main)]
        out.append(("SQL_STATEMENT", "\n".join([*[heads[n] for n in used], main]), len(statement) - len(statement[end:].lstrip()), len(statement) - 1, used))
    return out


def _closing(s: str, at: int) -> int:
    depth = 0
    for i in range(at, len(s)):
        depth += (s[i] == "(") - (s[i] == ")")
        if depth == 0:
            return i
    return -1


def statements(text: str) -> list[tuple[int, str]]:
    """(offset, statement) of each statement; dollar quotes, strings and comments keep their semicolons."""
    parts, quote, start, i = [], None, 0, 0
    while i < len(text):
        if quote:
            if text.startswith(quote, i):
                i += len(quote)
                quote = None
                continue
        elif text[i] in "'\"":
            quote = text[i]
        elif text[i] == "$" and (m := re.match(r"\$\w*\$", text[i:])):
            quote = m.group(0)
            i += len(quote)
            continue
        elif text.startswith("--", i):
            end = text.find("\n", i)
            i = end if end >= 0 else len(text)
            continue
        elif text[i] == ";":
            parts.append((start, text[start : i + 1]))
            start = i + 1
        i += 1
    parts.append((start, text[start:]))
    return [(at + len(p) - len(p.lstrip()), p.strip()) for at, p in parts if p.strip("; \n\t\r")]


def sql_pieces(text: str) -> list[tuple[str, str, int, int, list[str]]]:
    """(kind, chunk, first line, last line, common table expressions it rests on) of a SQL text."""
    out = []
    for at, statement in statements(text):
        for kind, chunk, first, last, used in cut_statement(statement):
            out.append((kind, chunk, text.count("\n", 0, at + first) + 1, text.count("\n", 0, at + last) + 1, used))
    return out


def sql_chunks(text: str) -> list[str]:
    """Statements, cut further where they are too long."""
    return [chunk for _, chunk, _, _, _ in sql_pieces(text)]


def python_chunks(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, chunk, first line, last line): imports, functions with decorators, classes (their methods if too long)."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [("GENERIC", *c) for c in pack_overlapping(text)]
    lines, out = text.split("\n"), []
    span = lambda n: (min([n.lineno, *[d.lineno for d in getattr(n, "decorator_list", [])]]), n.end_lineno)
    piece = lambda kind, a, b: (kind, "\n".join(lines[a - 1 : b]), a, b)
    imports = [n for n in tree.body if isinstance(n, ast.Import | ast.ImportFrom)]
    if imports:
        out.append(("PYTHON_IMPORT", "\n".join("\n".join(lines[n.lineno - 1 : n.end_lineno]) for n in imports), imports[0].lineno, imports[-1].end_lineno))
    for n in tree.body:
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append(piece("PYTHON_FUNCTION", *span(n)))
        elif isinstance(n, ast.ClassDef):
            whole = piece("PYTHON_CLASS", *span(n))
            methods = [m for m in n.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)]
            out += [whole] if estimate(whole[1]) <= CLASS_TOKENS or not methods else [piece("PYTHON_FUNCTION", *span(m)) for m in methods]
    return out or [("GENERIC", *c) for c in pack_overlapping(text)]


def chunk_text(extension: str, text: str) -> list[tuple[str, str]]:
    """(kind, chunk) by extension: SQL, Python, and lines for all others."""
    if extension in ("sql", "ddl", "dml"):
        return [(k, c) for k, c, _, _, _ in sql_pieces(text)]
    if extension in ("py", "pyspark", "python"):
        return [(k, c) for k, c, _, _ in python_chunks(text)]
    return [("GENERIC", c) for c in pack_lines(text)]


def chunk_files(files: DataFrame, keep: tuple[str, ...] = ("path",), content: str = "content", extension: Column | None = None) -> DataFrame:
    """(keep..., chunk_no, kind, chunk, tokens) of every file."""
    ext = extension if extension is not None else F.lower(F.regexp_extract(keep[0], r"\.([^./]+)$", 1))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [(*key, i, kind, chunk, estimate(chunk)) for *key, e, text in pdf.itertuples(index=False, name=None) if text is not None for i, (kind, chunk) in enumerate(chunk_text(e, text))]
            yield pd.DataFrame(rows, columns=[*keep, "chunk_no", "kind", "chunk", "tokens"])

    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep) + ", chunk_no int, kind string, chunk string, tokens int"
    return files.select(*keep, ext.alias("__ext"), F.col(content).alias("__text")).mapInPandas(run, schema)


#: Words that stand where a table's name would.
NO_TABLES = ("select", "lateral", "unnest", "values", "set")


def describe(kind: str, chunk: str) -> tuple[list[str], list[str], list[str]]:
    """(tables, qualified columns, functions defined) that a chunk names, each sorted and distinct."""
    tables = sorted({t for t in re.findall(r"(?i)\b(?:from|join|into|update)\s+([a-z_][\w.]*)", chunk) if t.lower() not in NO_TABLES})
    columns = sorted({c for c in re.findall(r"(?<![\w.])([A-Za-z_]\w*\.[A-Za-z_]\w*)(?![\w.(])", chunk) if c not in tables})
    if kind.startswith("SQL"):
        functions = re.findall(r"(?i)\bcreate\s+(?:or\s+(?:replace|alter)\s+)?(?:function|procedure|proc)\s+([\w.]+)", chunk)
    else:
        functions = re.findall(r"(?m)^\s*(?:async\s+)?def\s+(\w+)", chunk)
    return tables, columns, sorted(set(functions))


def pieces(extension: str, text: str) -> list[tuple[str, str, str, int, int, list[str]]]:
    """(language, kind, chunk, first line, last line, dependencies) of a file's chunks."""
    if extension in ("sql", "ddl", "dml"):
        return [("sql", kind, chunk, a, b, used) for kind, chunk, a, b, used in sql_pieces(text)]
    if extension in ("py", "pyspark", "python"):
        return [("python", kind, chunk, a, b, sorted(set(re.findall(r"(?m)^\s*(?:from|import)\s+([\w.]+)", chunk)))) for kind, chunk, a, b in python_chunks(text)]
    out, line = [], 1
    for chunk in pack_lines(text):
        n = chunk.count("\n")
        out.append((extension or "text", "GENERIC", chunk, line, line + n, []))
        line += n + 1
    return out


RECORD = "chunk_no int, language string, kind string, chunk string, start_line int, end_line int, tables array<string>, columns array<string>, functions array<string>, dependencies array<string>, context string, tokens int"


def chunk_records(files: DataFrame, keep: tuple[str, ...] = ("path",), content: str = "content", extension: Column | None = None) -> DataFrame:
    """The whole record of every chunk (see RECORD): span, language, what it names and rests on, and the context it is embedded with."""
    ext = extension if extension is not None else F.lower(F.regexp_extract(keep[0], r"\.([^./]+)$", 1))
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for *key, e, text in pdf.itertuples(index=False, name=None):
                for i, (language, kind, chunk, a, b, used) in enumerate(pieces(e, text) if text is not None else []):
                    context = f"-- CTEs defined: {', '.join(used)}" if language == "sql" and used else ""
                    rows.append((*key, i, language, kind, chunk, a, b, *describe(kind, chunk), used, context, estimate(chunk)))
            yield pd.DataFrame(rows, columns=[*keep, *names])

    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep) + ", " + RECORD
    return files.select(*keep, ext.alias("__ext"), F.col(content).alias("__text")).mapInPandas(run, schema)


def cache_misses(files: DataFrame, cache: DataFrame, version: int, days: int = 30, content: str = "content") -> DataFrame:
    """files whose content hash has no fresh entry of this schema version in the parse cache."""
    fresh = cache.where((F.col("schema_version") == version) & (F.col("created_at") >= F.current_timestamp() - F.expr(f"INTERVAL {days} DAYS")))
    return files.withColumn("file_hash", F.sha2(content, 256)).join(fresh.select("file_hash"), "file_hash", "left_anti")


def cache_put(cache: DataFrame, new: DataFrame, most: int = 10_000) -> DataFrame:
    """cache with new entries (file_hash and more) in place of older ones; the `most` accessed last are kept (ties by hash)."""
    merged = cache.join(new.select("file_hash"), "file_hash", "left_anti").unionByName(new)
    return merged.orderBy(F.desc("last_accessed"), "file_hash").limit(most)


def cache_touch(cache: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """cache with the time of access of the entries asked for (file_hash)."""
    hit = asked.select("file_hash").distinct().withColumn("__hit", F.lit(True))
    return cache.join(hit, "file_hash", "left").withColumn("last_accessed", F.when(F.col("__hit"), now).otherwise(F.col("last_accessed"))).drop("__hit").select(*cache.columns)


def cache_stats(cache: DataFrame, asked: DataFrame, version: int, days: int = 30, now: Column | None = None) -> DataFrame:
    """(entries, bytes, expired, hits, misses, hit_rate): one row about the cache and the keys asked for (file_hash)."""
    at = now if now is not None else F.current_timestamp()
    fresh = (F.col("schema_version") == version) & (F.col("created_at") >= at - F.expr(f"INTERVAL {days} DAYS"))
    whole = cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum((~fresh).cast("bigint")), F.lit(0)).alias("expired"))
    hits = asked.select("file_hash").join(cache.where(fresh).select("file_hash", F.lit(1).alias("__hit")), "file_hash", "left").agg(F.count("__hit").alias("hits"), (F.count("*") - F.count("__hit")).alias("misses"))
    rate = F.when(F.col("hits") + F.col("misses") > 0, F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6)).otherwise(0.0)
    return whole.join(F.broadcast(hits), F.lit(True)).withColumn("hit_rate", rate)  # one row
