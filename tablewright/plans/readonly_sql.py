"""Read-only SQL over a set of named tables.

Spark's own parser decides what a statement is. A query may only name the given tables
and its own common table expressions; commands, inserts, other relations (files, catalog
tables) and functions that call into the JVM or read files are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tablewright.errors import ToolError

_STARTS = re.compile(r"\s*(SELECT|WITH)\b", re.IGNORECASE)
# Functions that run arbitrary code or read outside the given tables.
_REFUSED_FUNCTIONS = {"reflect", "java_method", "try_reflect", "read_files", "input_file_name"}
_QUERY_ROOTS_REFUSED = ("Command", "Insert", "Create", "Drop", "Replace", "Delete", "Update", "Merge")


def _items(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


def _walk(plan, known: frozenset[str]) -> Iterator[tuple]:
    """Every logical node, also of sub-queries and common table expressions, with the table names it may use.

    A name that a WITH defines is known to the definitions after it and to the query of that WITH only.
    """
    todo = [(plan, known)]
    while todo:
        node, names = todo.pop()
        yield node, names
        for expression in _items(node.expressions()):
            for e in _expressions(expression):
                yield e, names
                if _name(e) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                    todo.append((e.plan(), names))
        if _name(node) == "UnresolvedWith":
            for pair in _items(node.cteRelations()):
                own = pair._1().lower()
                todo.append((pair._2(), names | {own} if node.allowRecursion() else names))
                names = names | {own}
        else:
            todo.extend((inner, names) for inner in _items(node.innerChildren()) if hasattr(inner, "children"))
        todo.extend((child, names) for child in _items(node.children()))


def _expressions(expression) -> Iterator:
    stack = [expression]
    while stack:
        e = stack.pop()
        yield e
        stack.extend(_items(e.children()))


def _name(node) -> str:
    return node.getClass().getSimpleName()


def check_read_only(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame]) -> None:
    """Raise unless the text is one query over the given tables."""
    if not _STARTS.match(sql):
        raise ToolError(f"Only SELECT or WITH queries are allowed: {sql.strip()[:80]}")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:  # the JVM parser reports through several exception types
        raise ToolError(f"Query does not parse: {_first_line(error)}") from error
    for node, known in _walk(plan, frozenset(t.lower() for t in tables)):
        name = _name(node)
        if name == "UnresolvedRelation":
            parts = list(_items(node.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in known:
                raise ToolError(f"Table '{'.'.join(parts)}' not found. Available: {sorted(tables)}")
        elif name in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            parts = node.nameParts() if name == "UnresolvedFunction" else node.name()
            last = list(_items(parts))[-1].lower()
            if last in _REFUSED_FUNCTIONS:
                raise ToolError(f"Function not allowed: {last}")
        elif any(word in name for word in _QUERY_ROOTS_REFUSED) or name == "ScriptTransformation":
            raise ToolError(f"Only queries are allowed, found {name}")


def run_sql(tables: Mapping[str, DataFrame], sql: str) -> DataFrame:
    """Analysed, lazy result of a read-only query over the tables."""
    if not tables:
        raise ToolError("No tables to query")
    spark = next(iter(tables.values())).sparkSession
    check_read_only(spark, sql, tables)
    # The views live in a copy of the session that nothing else sees. Analysis binds the plan to
    # the tables, so the result belongs to the caller's session like any other.
    of_rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    own = spark._jsparkSession.cloneSession()
    try:
        for name, df in tables.items():
            of_rows(own, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
        analysed = own.sql(sql).queryExecution().analyzed()
        return DataFrame(of_rows(spark._jsparkSession, analysed), spark)
    except PySparkException as error:
        raise ToolError(f"Query failed: {_first_line(error)}") from error


def _first_line(error: Exception) -> str:
    return str(error).strip().splitlines()[0]
