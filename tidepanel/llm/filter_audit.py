"""Filter interaction audit by direct relational replay.

Each row's failures are one number, a bit for each filter. Rows are crossed with all orders of the filters, a table as
long as the factorial of their number and so broadcast; each crossed row is exploded into its steps, the first filter that
fails is found, and what is kept, removed or redundant is counted by part, order and step. Spark aggregates on the map
side, so only one row for each part, order and step leaves a task, and no group is larger than the number of tasks.

The five filters of ``failures`` are those of the query: few words, few different words, many capitals, signs of code,
and copies. A row is a copy if its text is that of any row with a smaller id; a null id comes after all others. Copies are
told by SHA-256: the least id of a text is aggregated on the map side, and joined back to rows dealt by salt, so a text
that a third of the rows share is no hot key.

Null texts count as empty and are equal to empty ones; texts of any length are read whole. Null parts are the empty part.
Rows that repeat, or share an id, count each for itself; labels that repeat an id count once, as 1 if any says so, and
labels without an id label nothing. An
empty table gives no parts and so no rows. Other columns are left out, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import small, stored, table

FILTERS = "ABCDE"
SALTS = 16
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def failures(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``id``, ``part`` and ``mask`` of each row: bit i says that the row fails filter i of ``FILTERS``."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"))
    rows = rows.withColumns({"words": words(F.col("text")), "digest": F.unhex(F.sha2("text", 256))})
    capitals = F.length(F.regexp_replace("text", "[^A-Z]", ""))
    failed = (
        F.size("words") < 200,
        100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
        100 * capitals.cast("long") > 2 * F.length("text").cast("long"),
        F.col("text").rlike("[#$%&*|]"),
    )
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    flagged = stored(rows.select("id", "part", "digest", mask.alias("mask"), F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(SALTS)).alias("salt")), "flags")
    firsts = flagged.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    firsts = stored(firsts, "firsts")
    few = small(firsts, F.lit(64))
    if few is firsts:
        firsts, by = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), ["digest", "salt"]
    else:
        firsts, by = few, ["digest"]
    copy = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    return flagged.join(firsts, by, "left").select("id", "part", (F.col("mask") + F.when(copy, 1 << len(failed)).otherwise(0)).alias("mask"))


def orders(spark: SparkSession, filters: Sequence[str]) -> DataFrame:
    """``filter_order``, its name, and ``bits``, the bit of the filter at each step; one row for each order."""
    rows = [("".join(o), [1 << filters.index(f) for f in o]) for o in permutations(filters)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def replay(flags: DataFrame, filters: Sequence[str] = FILTERS, lost: Mapping[str, str] | None = None) -> DataFrame:
    """For rows ``part``, ``mask`` and any flags of 0 or 1: what happens at each step of each order, by part.

    ``lost`` names a count for each flag whose rows it counts as they are removed. Null flags count as 0."""
    lost = dict(lost or {})
    some = lambda condition: F.sum(F.when(condition, 1).otherwise(0)).cast("long")
    here = F.col("bits")[F.col("step") - 1]
    last = len(filters) + 1
    first = F.coalesce(*(F.when(F.col("mask").bitwiseAND(F.col("bits")[i]) != 0, i + 1) for i in range(len(filters))), F.lit(last))
    crossed = flags.crossJoin(F.broadcast(orders(flags.sparkSession, filters)))
    steps = crossed.withColumn("first_failed", first).withColumn("step", F.explode(F.array(*map(F.lit, range(1, last)))))
    removed = F.col("first_failed") == F.col("step")
    fails = F.col("mask").bitwiseAND(here) != 0
    counted = steps.groupBy("part", "filter_order", "step").agg(
        some(F.col("first_failed") > F.col("step")).alias("kept"),
        some(removed).alias("removed"),
        some(fails & (F.col("first_failed") < F.col("step"))).alias("redundant"),
        some(F.col("mask") == here).alias("unique_fails"),
        *(some(removed & (F.col(flag) == 1)).alias(name) for name, flag in lost.items()),
    )
    # A row for each part, order and step is left; a filter's removals are summed over its orders.
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    counted = stored(counted.withColumn("filter", letter), "steps")
    shares = counted.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return counted.join(shares, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley")


def audit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The five filters replayed over whole texts, with the labelled rows that each step loses."""
    told = labels.groupBy(F.col(key).alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    flags = failures(df, key, text, part).join(told, "id", "left").select("part", "mask", "good", "toxic")
    return replay(flags, FILTERS, {"good_lost": "good", "toxic_lost": "toxic"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN first IS NOT NULL AND (d.doc_id IS NULL OR d.doc_id > first) THEN 'E' ELSE '' END AS failed
  FROM d JOIN firsts USING (text) LEFT JOIN g ON g.doc_id = d.doc_id),
steps AS (SELECT part, good, toxic, failed, filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM fails, o),
told AS (SELECT *, filter_order[step] AS f, contains(failed, filter_order[step]) AS fails_here,
  len(list_intersect(string_split(failed, ''), string_split(substr(filter_order, 1, step - 1), ''))) > 0 AND failed <> '' AND step > 1 AS gone FROM steps),
counted AS (SELECT part, filter_order, step, f, count(*) FILTER (NOT gone AND NOT fails_here) AS kept, count(*) FILTER (NOT gone AND fails_here) AS removed,
  count(*) FILTER (gone AND fails_here) AS redundant, count(*) FILTER (failed = f) AS unique_fails,
  count(*) FILTER (NOT gone AND fails_here AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND fails_here AND toxic = 1) AS toxic_lost FROM told GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted
"""
