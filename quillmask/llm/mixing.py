"""Mix sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document's copies are a whole
part, which is certain, and a fractional part, which is its probability of one
copy more. For that copy the documents of a source are ranked by random odds
divided by inclusion odds, and the ranking is cut where the words taken come
nearest to what the whole copies leave open. The random numbers are digests of
the ids, so reruns agree.

The cut is found digit by digit in the rank (256 buckets a source and step), so
no task ever sorts a whole source.

Defined cases: a null text has size 0; documents without words take 0 words; a
null source is a source, last in order; an empty table gives no rows; rows with
equal ids (and all null ids) share a random number and are told apart by size;
of rows equal in both the cut takes as many as it needs, whichever they are.
Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmask.llm.common import documents, q, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
# Sources up to this count go to every executor as one small table.
BROADCAST_SOURCES = 10_000
LEVELS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def uniform(key: Column) -> Column:
    """A number between 0 and 1, ends excluded, from a key's digest."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source its words, target, whole copies, inclusion odds and open quota.

    sizes: (source, size). One row a source is ordered in one task; sources are
    the small dimension of a mix.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    per = per.withColumn("cap", F.col("source_size") * float(max_repeats))
    per = per.withColumn("ratio", F.col("cap") / F.col("w"))
    total = F.sum("source_size").over(Window.partitionBy()).cast("double")
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    capped = F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1))
    rest = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("share", (total - F.coalesce(capped, F.lit(0.0))) / rest)
    per = per.withColumn("rn", F.row_number().over(by_ratio))
    first_open = F.min_by(F.when(F.col("ratio") > F.col("share"), F.col("share")), F.when(F.col("ratio") > F.col("share"), F.col("rn")))
    per = per.withColumn("level", first_open.over(Window.partitionBy()))
    per = per.withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("w")))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = per.withColumn("times", times).withColumn("whole", F.floor("times"))
    return per.select(
        "source",
        "source_size",
        "target",
        "whole",
        (F.col("times") - F.col("whole")).alias("part"),
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("quota"),
    )


def pareto_rank(u: Column, part: Column) -> Column:
    """Random odds divided by inclusion odds."""
    return F.when(part > 0, (u / (1.0 - u)) / (part / (1.0 - part)))


def _cuts(narrow: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the last row of the ranking that is taken: (rank, id, size), and how many (m) of the n rows equal to it."""
    ranked = narrow.join(targets.filter("part > 0").select("source", "part", "quota"), narrow["source"].eqNullSafe(targets["source"])).select(
        narrow["source"], "id", "size", "quota", pareto_rank(F.col("u"), F.col("part")).alias("rank")
    )
    place = F.floor(F.col("rank") / (1.0 + F.col("rank")) * float(256**LEVELS))
    open_rows = ranked.withColumn("place", F.least(place, F.lit(256**LEVELS - 1)))
    for level in range(LEVELS):
        step = 256 ** (LEVELS - 1 - level)
        digit = (F.floor(F.col("place") / step) % 256).alias("digit")
        sums = open_rows.groupBy("source", digit).agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
        upto = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        before = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        # the last bucket that starts within the quota holds the cut
        cut = stored(
            before.filter(F.col("before") <= F.col("quota"))
            .groupBy("source")
            .agg(F.max("digit").alias("cut_digit"), F.max("before").alias("cut_before"))
        )
        # one row a source of the plan, checked for size like the plan itself
        cut = _small(cut).withColumnRenamed("source", "cut_source")
        joined = open_rows.withColumn("digit", digit).join(cut, F.col("source").eqNullSafe(F.col("cut_source")))
        open_rows = (
            joined.filter(F.col("digit") == F.col("cut_digit"))
            .withColumn("quota", F.col("quota") - F.col("cut_before"))
            .drop("digit", "cut_source", "cut_digit", "cut_before")
        )
    # equal rows are one row with a count, of which the cut may take a part
    same = open_rows.groupBy("source", "rank", "id", "size").agg(F.count("*").alias("n"), F.first("quota").alias("quota"))
    order = Window.partitionBy("source").orderBy("rank", F.col("id").asc_nulls_last(), "size")
    upto = F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    same = same.withColumn("before", F.coalesce(upto, F.lit(0)))
    fits = lambda k: F.col("before") + k * F.col("size") - F.col("size") / 2.0 <= F.col("quota")
    near = F.when(F.col("size") > 0, F.floor((F.col("quota") - F.col("before")) / F.col("size") + 0.5)).otherwise(F.col("n"))
    same = same.withColumn("near", F.greatest(F.lit(0), F.least(near, F.col("n"))))
    # the division may be off by one where the midpoint meets the quota
    exact = F.when((F.col("near") > 0) & ~fits(F.col("near")), F.col("near") - 1)
    exact = exact.when((F.col("near") < F.col("n")) & fits(F.col("near") + 1), F.col("near") + 1).otherwise(F.col("near"))
    # the bucket may hold no taken row: all rows of earlier buckets are below its first row
    edge = F.struct("rank", F.col("id").isNull().alias("no_id"), "id", "size")
    last = same.select("source", edge.alias("edge"), exact.alias("m"), "n")
    return last.groupBy("source").agg(F.max(F.when(F.col("m") > 0, F.struct("edge", "m", "n"))).alias("upto"), F.min("edge").alias("first"))


def _small(df: DataFrame) -> DataFrame:
    """Send a stored table to all executors only if it was seen to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else df


def plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_repeats=MAX_REPEATS):
    """Sizes of all rows and, per source, target and cut; both stored."""
    narrow = stored(
        docs.select(q(id_col).alias("id"), q(source_col).alias("source"), words(q(text_col)).alias("size"), uniform(q(id_col)).alias("u"))
    )
    targets = stored(source_targets(narrow, weights, max_repeats))
    cuts = _cuts(narrow, _small(targets)).withColumnRenamed("source", "cut_source")
    plans = targets.join(cuts, targets["source"].eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    return narrow, _small(stored(plans))


def _edge(id_: Column, size: Column, u: Column) -> Column:
    return F.struct(
        pareto_rank(u, F.col("plan.part")).alias("rank"), id_.isNull().alias("no_id"), id_.alias("id"), size.alias("size")
    )


def copies(id_: Column, size: Column, u: Column) -> Column:
    """Copies of a row, given the columns of its source's plan beside it; rows equal to the last taken one all count."""
    edge = _edge(id_, size, u)
    more = F.when(F.col("plan.upto").isNotNull(), edge <= F.col("plan.upto.edge")).otherwise(edge < F.col("plan.first"))
    extra = F.when((F.col("plan.part") > 0) & more, 1).otherwise(0)
    return F.when(size > 0, F.col("plan.whole") + extra).otherwise(0).cast("long")


def _with_copies(joined: DataFrame, plans: DataFrame, id_: Column, size: Column, u: Column) -> DataFrame:
    """Add the copies (n) to rows that have their plan beside them.

    Where the cut falls among equal rows, those are stored and numbered by the
    task that wrote them, so no task reads all of a large group.
    """
    n = copies(id_, size, u).alias("n")
    if not plans.filter("upto.m < upto.n AND upto.edge.size > 0").limit(1).count():
        return joined.select("*", n)
    tie = F.coalesce((F.col("plan.upto.m") < F.col("plan.upto.n")) & (_edge(id_, size, u) == F.col("plan.upto.edge")), F.lit(False))
    tied = stored(joined.filter(tie).select("*", n, F.spark_partition_id().alias("slot")))
    slots = tied.groupBy(F.col("plan.source").alias("of"), F.col("slot").alias("at")).agg(F.count("*").alias("held"))
    upto = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("held").over(upto), F.lit(0)))
    turn = F.row_number().over(Window.partitionBy("plan.source", "slot").orderBy(F.lit(0)))
    numbered = tied.withColumn("turn", turn).join(slots, F.col("plan.source").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("at")))
    late = F.when(F.col("before") + F.col("turn") > F.col("plan.upto.m"), 1).otherwise(0)
    part = numbered.withColumn("n", F.when(F.col("n") > 0, F.col("n") - late).otherwise(0).cast("long"))
    return joined.filter(~tie).select("*", n).unionByName(part.select(*joined.columns, "n"))


def decisions(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row."""
    narrow, plans = plan(docs, id_col, text_col, source_col, weights, max_repeats)
    joined = narrow.join(plans.select(F.struct("*").alias("plan")), F.col("source").eqNullSafe(F.col("plan.source")))
    n = F.col("n")
    return _with_copies(joined, plans, F.col("id"), F.col("size"), F.col("u")).select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("plan.source_size").alias("source_size"),
        F.col("plan.target").alias("target"),
        (n * F.col("size")).alias("taken"),
        n.alias("copies"),
    )


def mixed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns as given."""
    _, plans = plan(docs, id_col, text_col, source_col, weights, max_repeats)
    row = docs.select(F.struct(*[q(c) for c in docs.columns]).alias("row"))
    field = lambda name: F.col("row").getField(name)
    joined = row.join(plans.select(F.struct("*").alias("plan")), field(source_col).eqNullSafe(F.col("plan.source")))
    counted = _with_copies(joined, plans, field(id_col), words(field(text_col)), uniform(field(id_col)))
    times = counted.select("row", "n").filter("n > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).select("row.*")


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w FROM s),
r AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio FROM w),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE
         - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share,
         row_number() OVER (ORDER BY ratio, source NULLS LAST) AS rn FROM r),
t AS (
  SELECT source, source_size, least(cap, (SELECT arg_min(share, rn) FROM l WHERE ratio > share) * w) AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS times FROM t),
x AS (
  SELECT d.doc_id, d.size, d.u, p.source, p.source_size, p.target, floor(p.times)::BIGINT AS whole,
         p.times - floor(p.times) AS part, p.target - floor(p.times) * p.source_size AS quota
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
k AS (
  SELECT *, CASE WHEN part > 0 THEN (u / (1.0::DOUBLE - u)) / (part / (1.0::DOUBLE - part)) END AS rnk FROM x),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rnk, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS run FROM k),
n AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN part > 0 AND run - size / 2.0::DOUBLE <= quota THEN 1 ELSE 0 END END::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM n
"""
