"""Read-only SQL over the index's views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Plans that a query may consist of; anything else (writes, DDL, settings, cache) is refused.
READ_ONLY = frozenset(
    "Project Filter Aggregate Sort Distinct Union Intersect Except Join Window WithWindowDefinition GlobalLimit LocalLimit Offset Tail SubqueryAlias UnresolvedRelation OneRowRelation UnresolvedInlineTable LocalRelation "
    "UnresolvedWith UnresolvedSubqueryColumnAliases UnresolvedHint UnresolvedHaving Having Generate Expand Pivot Unpivot LateralJoin UnresolvedTableValuedFunction RelationTimeTravel Sample View ExplainCommand ShowTables ShowColumns DescribeRelation "
    "CTERelationDef CTERelationRef WithCTE UnionLoop ResolvedHint Deduplicate BaseEvalPython UnresolvedTVFAliases Range UnresolvedNamespace CurrentNamespace UnresolvedTableOrView Repartition RepartitionByExpression".split()
)


#: Functions that leave the query: they call any Java method, or tell of files and the machine.
FORBIDDEN = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length version current_user session_user user".split())
#: Functions that may stand for a table.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())


class Refused(ValueError):
    """A statement that does more than read."""


def _every(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _names(seq) -> str:
    return ".".join(str(x) for x in _every(seq)).lower()


def _walk(jvm, plan) -> tuple[set[str], set[str], set[str], set[str]]:
    """Of a parsed statement with all inner plans and subqueries: classes of its plans, relations, functions, and the names
    that it defines itself (WITH)."""
    logical = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    inner = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    plans: set[str] = set()
    relations: set[str] = set()
    functions: set[str] = set()
    own: set[str] = set()
    stack = [plan]
    while stack:
        node = stack.pop()
        kind = node.getClass().getSimpleName().rstrip("$")
        if logical.isInstance(node):
            plans.add(kind)
            if kind == "UnresolvedRelation":
                relations.add(_names(node.multipartIdentifier()))
            elif kind == "UnresolvedTableValuedFunction":
                functions.add("table:" + _names(node.name()))
            elif kind == "UnresolvedWith":
                for k in range(node.cteRelations().size()):
                    pair = node.cteRelations().apply(k)
                    own.add(str(pair.productElement(0)).lower())
                    stack.append(pair.productElement(1))
            stack += _every(node.expressions())
        elif inner.isInstance(node):
            stack.append(node.plan())
        elif kind == "UnresolvedFunction":
            functions.add(_names(node.nameParts()))
        stack += _every(node.children())
    return plans, relations, functions, own


def run_query(spark: SparkSession, query: str, params: list | None = None, views: list[str] | None = None) -> DataFrame:
    """A parsed statement that only reads, with `?` for params: all its plans are of READ_ONLY, its tables are `views` (the
    session's temporary views if not given) or its own, and no function leads out of it."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:
        raise ValueError(f"not a statement: {str(e).splitlines()[0]}") from e
    plans, relations, functions, own = _walk(spark._jvm, plan)
    if other := plans - READ_ONLY:
        raise Refused(f"only reading statements may run, not {', '.join(sorted(other))}")
    known = {v.lower() for v in (views if views is not None else [t.name for t in spark.catalog.listTables() if t.isTemporary])}
    if other := relations - known - own:
        raise Refused(f"unknown tables: {', '.join(sorted(other))}")
    last = lambda f: f.rsplit(".", 1)[-1]
    if other := {f for f in functions if last(f) in FORBIDDEN or (f.startswith("table:") and last(f[6:]) not in TABLE_FUNCTIONS)}:
        raise Refused(f"functions that may not be called: {', '.join(sorted(other))}")
    return spark.sql(query, args=params or None)


def query_result(spark: SparkSession, query: str, params: list | None = None, limit: int = 10_000) -> dict:
    """Columns, rows and their number, for a client; at most `limit` rows are brought to it."""
    df = run_query(spark, query, params)
    rows = [list(r) for r in df.limit(limit).collect()]
    return {"columns": df.columns, "rows": rows, "count": len(rows)}
