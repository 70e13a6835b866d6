"""A guarded read-only SQL surface over temporary views, live or of a snapshot."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Words that a query may not contain, and words that it may begin with.
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "GRANT", "REVOKE", "EXEC", "EXECUTE", "CALL")
ALLOWED = ("SELECT", "WITH", "SHOW", "DESCRIBE", "EXPLAIN")


class RefusedSQL(ValueError):
    """The statement isn't a plain query."""


def check_words(sql: str) -> None:
    """Refuse forbidden words (even inside literals) and other beginnings; comments don't count."""
    bare = re.sub(r"/\*.*?\*/", " ", re.sub(r"--.*?(\n|$)", " ", sql.upper()), flags=re.DOTALL)
    if bad := next((w for w in FORBIDDEN if re.search(rf"\b{w}\b", bare)), None):
        raise RefusedSQL(f"forbidden word {bad}; only queries are allowed")
    words = bare.split()
    if not words or words[0] not in ALLOWED:
        raise RefusedSQL(f"a query must begin with one of {', '.join(ALLOWED)}")


def check_plan(spark: SparkSession, sql: str) -> None:
    """Refuse what Spark's parser takes for a command that writes, whatever words it is made of."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    name = plan.getClass().getSimpleName()
    if re.match(r"(Insert|Create|Drop|Alter|Truncate|Delete|Update|Merge|Set|Add|Clear|Cache|Uncache|Refresh|Load|Replace)", name):
        raise RefusedSQL(f"{name} is no query")


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The query's result over the given tables, in a session of its own so that views of other queries stay apart."""
    check_words(sql)
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    check_plan(own, sql)
    rows_of = spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    for name, df in (tables or {}).items():
        DataFrame(rows_of(own._jsparkSession, df._jdf.logicalPlan()), own).createOrReplaceTempView(name)
    return own.sql(sql)


def rows(result: DataFrame, limit: int | None = None, timeout: float = 30.0) -> dict:
    """columns, rows and row_count of a result; its jobs alone are cancelled when the time is over.

    All rows come, unless a limit is asked for: then row_count is still that of all rows, and truncated tells whether some are left out.
    """
    context = result.sparkSession.sparkContext
    tag = f"query-{uuid.uuid4().hex}"
    timer = threading.Timer(timeout, lambda: context.cancelJobsWithTag(tag))
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        got = result.collect() if limit is None else result.limit(limit).collect()
        n = len(got) if limit is None or len(got) < limit else result.count()
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    return {"columns": result.columns, "rows": [list(r) for r in got], "row_count": n, "truncated": n > len(got)}
