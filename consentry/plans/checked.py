"""Checks user-written SQL by the nodes of its plan, never by its printed text.

``read_query`` walks the parsed plan: every node and every expression must be of a listed kind, every relation a single known
name, every function allowed. ``check_leaves`` then walks the analysed plan: whatever it reads must lie inside a governed view.
What is not listed is refused.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from consentry.operators.predicates import GovernanceError

# Functions governed SQL may call.
ALLOWED_FUNCTIONS = frozenset(
    """
    abs any_value approx_count_distinct avg bool_and bool_or ceil ceiling char_length coalesce
    concat concat_ws contains count count_if cume_dist current_date current_timestamp date
    date_add date_diff date_format date_sub date_trunc datediff day dayofmonth dayofweek
    dense_rank endswith exp first first_value floor greatest hour if ifnull initcap instr isnull
    isnotnull lag last last_value lcase lead least left length ln log lower lpad ltrim max mean
    median min minute mod month ntile nullif nvl percent_rank percentile_approx position pow
    power quarter rank replace reverse right round row_number rpad rtrim second sign sqrt
    startswith stddev stddev_pop stddev_samp substr substring sum to_date trim trunc ucase upper
    var_pop var_samp variance weekofyear year extract date_part timestampdiff timestampadd
    """.split()
)
# Names the parser gives to syntax.
SYNTAX = frozenset(["between", "array", "struct", "named_struct", "grouping_sets"])
# Kinds of plan nodes a query may have after parsing.
NODES = frozenset(
    """
    Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join AsOfJoin SubqueryAlias UnresolvedRelation UnresolvedWith
    Distinct Union Intersect Except UnresolvedHaving WithWindowDefinition UnresolvedSubqueryColumnAliases OneRowRelation
    UnresolvedInlineTable UnresolvedOrderByAll LocalRelation
    """.split()
)
# Kinds of expressions.
EXPRESSIONS = frozenset(
    """
    Literal UnresolvedAttribute UnresolvedStar UnresolvedAlias Alias UnresolvedFunction UnresolvedOrdinal
    NamedParameter PosParameter Cast TryCast And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan
    GreaterThanOrEqual Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive In InSubquery InSet Like
    ILike RLike IsNull IsNotNull IsTrue IsFalse CaseWhen If SortOrder ScalarSubquery Exists ListQuery UnresolvedWindowExpression
    WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame CurrentRow UnboundedPreceding
    UnboundedFollowing GroupingSets Cube Rollup UnresolvedExtractValue CurrentDate CurrentTimestamp Extract
    Substring StringTrim StringTrimLeft StringTrimRight Concat Upper Lower Between MultiCommutativeOp
    TimestampAdd TimestampDiff AttributeReference
    """.split()
)
# What an analysed plan may read besides governed views.
LEAVES = frozenset("OneRowRelation LocalRelation CTERelationRef UnionLoopRef".split())


@dataclass
class Query:
    """What a statement reads and calls, and its parsed plan as text."""

    relations: set[str] = field(default_factory=set)
    ctes: set[str] = field(default_factory=set)
    text: str = ""


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _items(sequence) -> Iterator:
    it = sequence.iterator()
    while it.hasNext():
        yield it.next()


def read_query(session: SparkSession, text: str) -> Query:
    """The relations of a single SELECT statement; raises GovernanceError for anything that is not listed."""
    try:
        plan = session._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:  # noqa: BLE001
        raise GovernanceError("not a single SELECT statement") from error
    query = Query(text=plan.toString())
    _plan(plan, query)
    return query


def _plan(node, query: Query) -> None:
    kind = _kind(node)
    if kind not in NODES:
        raise GovernanceError(f"{kind} is not allowed in a query")
    if kind == "UnresolvedRelation":
        parts = list(_items(node.multipartIdentifier()))
        if len(parts) != 1:
            raise GovernanceError(f"table {'.'.join(parts)!r} is not registered")
        query.relations.add(parts[0].lower())
    if kind == "UnresolvedWith":
        for relation in _items(node.cteRelations()):
            query.ctes.add(relation._1().lower())
            _plan(relation._2(), query)
    for child in _items(node.children()):
        _plan(child, query)
    for expression in _items(node.expressions()):
        _expression(expression, query)
    if kind == "WithWindowDefinition":
        for definition in _items(node.windowDefinitions().values()):
            _expression(definition, query)


def _expression(node, query: Query) -> None:
    kind = _kind(node)
    if kind not in EXPRESSIONS:
        raise GovernanceError(f"{kind} is not allowed in a query")
    if kind == "UnresolvedFunction":
        name = ".".join(_items(node.nameParts())).lower()
        if name not in ALLOWED_FUNCTIONS | SYNTAX:
            raise GovernanceError(f"function {name!r} is not allowed")
        for condition in _items(node.filter()):
            _expression(condition, query)
    if kind in ("ScalarSubquery", "Exists", "ListQuery"):
        _plan(node.plan(), query)
    for child in _items(node.children()):
        _expression(child, query)


def check_leaves(df: DataFrame, views: Mapping[str, str]) -> None:
    """Every leaf of the analysed plan must lie inside one of the temporary views."""
    _leaves(df._jdf.queryExecution().analyzed(), {v.lower() for v in views})


def _leaves(node, views: set[str]) -> None:
    kind = _kind(node)
    if kind == "View":
        name = node.desc().identifier()
        if node.isTempView() and name.table().lower() in views and name.database().isEmpty():
            return
        raise GovernanceError(f"{name.table()!r} is no governed view")
    children = list(_items(node.children())) + list(_items(node.subqueries()))
    if not children and kind not in LEAVES:
        raise GovernanceError(f"{kind} is read outside the governed views")
    if kind == "WithCTE":
        children += list(_items(node.cteDefs()))
    for child in children:
        _leaves(child, views)
