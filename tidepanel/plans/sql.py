"""The SQL surface: coverage, gaps and vintages of a store, and guarded read-only queries."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

#: The parsed plans that a query may be made of; anything else writes, changes or isn't known.
READING = frozenset(
    "Aggregate CTE Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LimitAll LocalLimit LocalRelation Offset OneRowRelation Pivot Project Range Repartition RepartitionByExpression ResolvedHint Sample Sort Subquery SubqueryAlias Tail TableValuedFunction Union Unpivot UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedPivot UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedWith UnresolvedOrderBy View Window WithWindowDefinition".split()
)


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(
        F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max("ingested_at").alias("last_ingested"), F.count_distinct("ingested_at").alias("vintages")
    )


def gaps(bars: DataFrame, max_gap_days: int = 5) -> DataFrame:
    """Stretches of more than ``max_gap_days`` days between two bars of a ticker."""
    before = F.lag("date").over(Window.partitionBy("ticker").orderBy("date"))
    rows = bars.select("ticker", before.alias("gap_start"), F.col("date").alias("gap_end"))
    return rows.withColumn("gap_days", F.datediff("gap_end", "gap_start").cast("long")).where(F.col("gap_days") > max_gap_days)


def vintages(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ingested_at").agg(F.count("*").alias("rows"), F.count_distinct("ticker").alias("tickers"))


def vintage_tags(bars: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """One row that says what data a run on these tickers saw."""
    some = bars.where(F.col("ticker").isin([t.upper() for t in tickers]))
    return some.agg(F.max("ingested_at").alias("last_ingested"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


#: The expressions that hold a plan of their own.
SUBQUERIES = frozenset("ScalarSubquery Exists ListQuery LateralSubquery FunctionTableSubqueryArgumentExpression".split())
#: The functions that a query may call. What isn't named here may reach out of the data.
FUNCTIONS = frozenset(
    """abs any any_value approx_count_distinct approx_percentile array array_agg array_contains array_distinct array_max array_min array_size avg between bool_and bool_or bround
    cast ceil ceiling char_length coalesce collect_list collect_set concat concat_ws corr cos count count_if covar_pop covar_samp cume_dist current_date current_timestamp
    date date_add date_diff date_format date_sub date_trunc datediff day dayofmonth dayofweek dayofyear degrees dense_rank div double e element_at every exp explode explode_outer extract
    first first_value floor format_number from_unixtime greatest grouping grouping_id hour if ifnull ilike int isnan isnotnull isnull kurtosis lag last last_day last_value lead
    least left length like ln log log10 log2 lower lpad ltrim make_date max max_by mean median min min_by minute mod mode month months_between named_struct nanvl negative
    next_day now nth_value ntile nullif nvl nvl2 percent_rank percentile percentile_approx pi pmod posexplode positive pow power quarter radians range rank regexp_extract
    regexp_like regexp_replace regr_count regr_intercept regr_r2 regr_slope replace right rlike round row_number rpad rtrim second shiftleft shiftright sign signum
    sin size skewness slice sort_array split split_part sqrt std stddev stddev_pop stddev_samp string struct substr substring sum tan timestamp to_date to_timestamp trim
    trunc try_avg try_cast try_divide try_sum unix_timestamp upper var_pop var_samp variance weekday weekofyear when width_bucket window year""".split()
)


#: What the parser leaves to be resolved and may stand in a query; anything else that is unresolved, such as
#: a function or table whose name is an expression, is refused.
UNRESOLVED = frozenset("UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedStar UnresolvedWindowExpression NamedParameter PosParameter MultiAlias".split())
#: Parts of the names of resolved expressions that run code of other classes.
FOREIGN = ("Reflect", "UDF", "UserDefined", "PythonUDTF", "HiveSimple", "HiveGeneric", "ApplyFunctionExpression")


def _nodes(plan):
    yield plan
    if plan.nodeName() in ("CTE", "UnresolvedWith"):
        yield from _nodes(plan.child())
    for group in (plan.children(), plan.innerChildren()):
        for i in range(group.size()):
            yield from _nodes(group.apply(i))


def _listed(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _calls(plan):
    """The names of all functions that the expressions of a parsed plan call, in its subqueries and windows too; what is
    called by anything but a plain name has that whole name."""
    for node in _nodes(plan):
        name = node.nodeName()
        if name == "UnresolvedTableValuedFunction":
            yield ".".join(_listed(node.name()))
        if name not in READING:
            yield f"({name})"
        todo = _listed(node.expressions())
        if name == "WithWindowDefinition":
            todo += _listed(node.windowDefinitions().values().toIndexedSeq())
        while todo:
            e = todo.pop()
            kind = e.getClass().getSimpleName()
            if kind == "UnresolvedFunction":
                yield ".".join(_listed(e.nameParts()))
                todo += _listed(e.arguments())
            elif kind == "UnresolvedGenerator":
                yield e.name().unquotedString()
            elif any(f in kind for f in FOREIGN) or ".analysis." in e.getClass().getName() and kind not in UNRESOLVED:
                yield kind
            elif kind in SUBQUERIES:
                yield from _calls(e.plan())
            todo += _listed(e.children())


def read_only(spark: SparkSession, query: str) -> None:
    """Raises ValueError unless the text is one statement that only reads, and calls only functions that stay within the
    data, told from its parsed plan."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as error:  # a parser error comes from the JVM as it is
        raise ValueError(f"this is not one query: {str(error).splitlines()[0]}") from error
    for name in _calls(plan):
        if name.startswith("("):
            raise ValueError(f"only reading queries are run; this one holds {name[1:-1]}")
        if name.lower() not in FUNCTIONS:
            raise ValueError(f"the function {name} is not among those that queries may call")


def resolved_only(frame: DataFrame) -> None:
    """Raises ValueError if the resolved plan calls code of other classes, by whatever name it was called."""
    todo = [frame._jdf.queryExecution().analyzed()]
    while todo:
        for node in _nodes(todo.pop()):
            expressions = _listed(node.expressions())
            while expressions:
                e = expressions.pop()
                kind = e.getClass().getSimpleName()
                if any(f in kind for f in FOREIGN):
                    raise ValueError(f"the query calls code of its own: {kind}")
                if kind in SUBQUERIES:
                    todo.append(e.plan())
                expressions += _listed(e.children())


def guarded(spark: SparkSession, query: str, limit: int = 1000, seconds: float = 300.0) -> tuple[DataFrame, bool]:
    """The first ``limit`` rows, dates and timestamps as ISO strings, and whether there are more: of one execution, which
    is cancelled after ``seconds``, with a ValueError."""
    read_only(spark, query)
    files = spark.conf.get("spark.sql.runSQLOnFiles")
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    try:
        frame = spark.sql(query)
    except ParseException as error:
        raise ValueError(str(error)) from error
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", files)
    resolved_only(frame)
    shown = iso(frame)
    tag, late = f"guarded-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    clock = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    clock.start()
    try:
        rows = shown.take(limit + 1)
    except (Py4JJavaError, PySparkException) as error:
        if late.is_set():
            raise ValueError(f"the query took more than {seconds:g} seconds") from error
        raise
    finally:
        clock.cancel()
        spark.sparkContext.removeJobTag(tag)
    return spark.createDataFrame(rows[:limit], shown.schema), len(rows) > limit


def iso(frame: DataFrame) -> DataFrame:
    def text(f: T.StructField):
        if isinstance(f.dataType, T.DateType):
            return F.date_format(f.name, "yyyy-MM-dd").alias(f.name)
        if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            return F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name)
        return F.col(f"`{f.name}`")

    return frame.select(*map(text, frame.schema))
