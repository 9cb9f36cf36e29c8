"""The guarded query surface: read-only statements in, ordered and annotated results out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from tallyforge.functions import frames, sqltext

#: Nodes of parsed statements that only read (fixed values).
READING = frozenset(
    "Project Aggregate Sort GlobalLimit LocalLimit Union Distinct Filter Join SubqueryAlias UnresolvedWith UnresolvedHaving UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedInlineTable ResolvedInlineTable LocalRelation Intersect Except Offset WithWindowDefinition Expand Generate Window Deduplicate UnresolvedTableValuedFunction OneRowRelation Tail LateralJoin Pivot Unpivot LimitAll".split()
)
#: Statements about tables that only read (fixed values).
DESCRIBING = frozenset("ShowTables ShowColumns DescribeRelation UnresolvedTableOrView ResolvedNamespace UnresolvedNamespace CurrentNamespace$".split())
#: Functions that reach past the data: code of the JVM, files, secrets and the session (fixed values).
REFUSED_FUNCTIONS = frozenset("reflect try_reflect java_method input_file_name input_file_block_start input_file_block_length aes_decrypt aes_encrypt try_aes_decrypt current_user user session_user version raise_error assert_true read_files cloud_files http_call".split())
#: Table functions that only make rows (fixed values).
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())


class Refused(ValueError):
    """A statement that may not run."""


def _seq(scala) -> list:
    it = scala.iterator()
    out = []
    while it.hasNext():
        out.append(it.next())
    return out


def _parts(name) -> list[str]:
    return [str(x) for x in _seq(name)]


def check(spark: SparkSession, sql: str) -> None:
    """Raises ``Refused`` unless a text is one statement that only reads the catalog.

    The parsed plan is walked whole, with its expressions and the plans in them: each node must be one that reads, each
    relation a name without a path and known to the catalog or to a WITH, each function none that reaches past the data.
    What can't be parsed is refused too; Spark's message comes with it.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # noqa: BLE001
        raise Refused(f"no statement: {str(e).splitlines()[0]}") from e
    named: set[str] = set()
    relations: list[list[str]] = []
    root = plan.getClass().getSimpleName()
    describing = root in DESCRIBING
    todo = [("plan", plan)]
    while todo:
        what, node = todo.pop()
        kind = node.getClass().getSimpleName()
        if what == "plan":
            if kind not in READING and not (describing and kind in DESCRIBING):
                raise Refused(f"not a query: {kind}")
            if kind == "UnresolvedRelation":
                relations.append(_parts(node.multipartIdentifier()))
            elif kind == "UnresolvedTableValuedFunction" and (name := _parts(node.name())[-1].lower()) not in TABLE_FUNCTIONS:
                raise Refused(f"blocked: {name}")
            elif kind == "UnresolvedWith":
                for pair in _seq(node.cteRelations()):
                    named.add(str(pair._1()).lower())
                    todo.append(("plan", pair._2()))
            todo += [("plan", c) for c in _seq(node.children())] + [("expression", e) for e in _seq(node.expressions())]
            if kind == "LateralJoin":
                todo.append(("plan", node.right().plan()))
        else:
            if kind == "UnresolvedFunction" and (name := _parts(node.nameParts())[-1].lower()) in REFUSED_FUNCTIONS:
                raise Refused(f"blocked: {name}")
            if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
                todo.append(("plan", node.plan()))
            if kind == "InSubquery":
                todo.append(("plan", node.query().plan()))
            todo += [("expression", c) for c in _seq(node.children())]
    for parts in relations:
        if not (len(parts) == 1 and parts[0].lower() in named) and not spark.catalog.tableExists(".".join(f"`{p}`" for p in parts)):
            raise Refused(f"no such table: {'.'.join(parts)}")


def ask(spark: SparkSession, sql: str) -> DataFrame:
    """The rows of a statement of the embedded engine's dialect; a WHERE may name aliases of the SELECT, columns go first."""
    text = sqltext.to_spark(sql)
    try:
        return spark.sql(text)
    except AnalysisException as e:
        named = (e.getMessageParameters() or {}).get("objectName", "").replace("`", "").rpartition(".")[2]
        again = sqltext.aliases_in_where(text, named) if named else text
        if again == text:
            raise
        return spark.sql(again)


@dataclass
class Result:
    frame: pd.DataFrame
    text: str
    chart: dict | None
    n_rows: int
    sql: str


def run(spark: SparkSession, sql: str, canonical: dict[str, str] | None = None, skip_tables: tuple[str, ...] = ()) -> Result:
    """Guard, rewrite, run, order, totals, chart and text of a statement.

    The result is collected within a bound; a longer one is counted but only its first rows are shown.
    """
    text = sqltext.strip_fences(sql)
    text = sqltext.to_spark(sqltext.prefer_canonical(text, canonical or {}, skip_tables))
    check(spark, text)
    df = ask(spark, text)
    frame = df.limit(frames.REORDER_ROWS + 1).toPandas()
    n = len(frame) if len(frame) <= frames.REORDER_ROWS else df.count()
    frame = frames.display_order(frame, text)
    c = frames.pick_chart(frame, text)
    moved = 0
    if c.label and c.value:
        frame, moved = frames.totals_last(frame, c.label, c.value)
    return Result(frame, frames.render(frame, c, moved), frames.chart_points(frame, text), n, text)


def answer(spark: SparkSession, question: str, write_sql: Callable[[str, str | None], str], **options) -> Result:
    """Asks ``write_sql(question, error)`` for a statement and runs it; after a failure it is asked once more."""
    sql = write_sql(question, None)
    if not sqltext.is_query(sql):
        raise Refused("no query came for this question")
    try:
        return run(spark, sql, **options)
    except (AnalysisException, ParseException, Refused) as e:
        return run(spark, write_sql(question, str(e).splitlines()[0]), **options)
