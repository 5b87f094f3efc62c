"""What rule SQL may touch: one query, over the data and nothing else; and what Spark would cast behind its back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallyward.functions.sqltext import SqlTextError, first_word

_RELATION = re.compile(r"'UnresolvedRelation \[([^\]]*)\]")
_CTE = re.compile(r"'?(?:UnresolvedWith|CTE) \[([^\]]*)\]")
_FUNCTION = re.compile(r"'UnresolvedTableValuedFunction \[([^\]]*)\]")


def check_query(spark: SparkSession, sql: str, view: str = "data") -> None:
    """Raise unless the text is one SELECT whose only relation is the view."""
    if first_word(sql) not in ("SELECT", "WITH", "FROM", "VALUES"):
        raise SqlTextError("rule SQL must be a SELECT")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    text = plan.treeString()
    if "Insert" in plan.getClass().getSimpleName() or "Command" in plan.getClass().getSimpleName():
        raise SqlTextError("rule SQL must be a SELECT")
    names = {view.lower()}
    for found in _CTE.findall(text):
        names |= {n.strip().lower() for n in found.split(",")}
    for relation in _RELATION.findall(text):
        if relation.strip().lower() not in names:
            raise SqlTextError(f"rule SQL may only read {view}, not {relation}")
    for function in _FUNCTION.findall(text):
        if function.strip().lower() not in ("range", "explode", "unnest", "posexplode"):
            raise SqlTextError(f"rule SQL may not call the table function {function}")


def implicit_text_casts(df: DataFrame) -> list[str]:
    """Text columns that the analyser casts without having been told to, in order of first use."""
    jvm = df.sparkSession._jvm
    tag = jvm.org.apache.spark.sql.catalyst.expressions.Cast.USER_SPECIFIED_CAST()
    found: list[str] = []

    def expressions(node) -> None:
        if node.getClass().getSimpleName() == "Cast":
            child = node.child()
            if node.getTagValue(tag).isEmpty() and child.getClass().getSimpleName() == "AttributeReference" and child.dataType().typeName() == "string" and node.dataType().typeName() != "string":
                if child.name() not in found:
                    found.append(child.name())
        children = node.children()
        for i in range(children.size()):
            expressions(children.apply(i))

    def plans(node) -> None:
        own = node.expressions()
        for i in range(own.size()):
            expressions(own.apply(i))
        children = node.children()
        for i in range(children.size()):
            plans(children.apply(i))

    plans(df._jdf.queryExecution().analyzed())
    return found
