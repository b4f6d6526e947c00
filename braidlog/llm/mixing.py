"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN

#: A source, and a document, counts at most so many times.
MAX_REPEATS = 3
#: Parts of one size class of a source, each ranked on its own.
PARTS = 16
SEED = "mix-1"


def size_class(size: Column) -> Column:
    """The size's binary exponent and next four bits: classes six percent wide or less."""
    e = F.length(F.bin(size))
    return F.when(e <= 5, size).otherwise(e * 32 + F.expr("0") + F.pmod(F.floor(size / F.pow(F.lit(2.0), e - 5)).cast("long"), F.lit(16)))


def targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size)`` with each source's ``target``.

    Sources in code point order, null last, weigh 1, 2, 3 in turn and share the
    total of all sizes; a share stops at ``max_repeats`` times its source and
    the excess is shared again by weight. The fixed point is the water level L
    with sum(min(L * weight, cap)) = total, found from prefix sums over the
    sources ordered by cap / weight. One row per source: the table is as small
    as the number of sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    cap = F.col("source_size") * max_repeats
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = (w.withColumn("filled", F.coalesce(F.sum(cap).over(before), F.lit(0)))
         .withColumn("spent", F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("total", F.sum("source_size").over(all_rows)).withColumn("weights", F.sum("weight").over(all_rows))
         .withColumn("level", (F.col("total") - F.col("filled")).cast("double") / (F.col("weights") - F.col("spent"))))
    fits = F.col("level") * F.col("weight") <= cap
    w = w.withColumn("final", F.min(F.when(fits, F.struct(F.col("spent"), F.col("level")))).over(all_rows)["level"])
    target = F.least(F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("weight"), cap.cast("double"))
    return w.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """``(id_col, size, source_size, target, copies, taken)``, one row per row of ``docs``.

    Every document of a source expects target / source_size copies. In a fixed
    order by size these expectations are summed; with one offset drawn for the
    source, a document is emitted once for each integer in its interval. Since
    neighbours in the order are alike in size, the words taken stay within
    about one long document of the target. ``taken`` is copies times size.

    The order is size class, part (id modulo ``PARTS``), size, id. Prefix sums
    take two levels: counts of (source, class, part) are summed, and rows are
    ranked within a part; no task ranks a whole source. Null texts have size 0;
    null sources are one source; ties and repeated rows are ranked in some order
    among themselves; a source of size 0 has target 0. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))
    part = F.pmod(F.coalesce(F.col("id").cast("long"), F.lit(0)), F.lit(PARTS))
    # the text is read once: all further steps use these narrow rows
    from .common import cut

    rows = cut(rows.withColumn("class", size_class(F.col("size"))).withColumn("part", part))
    parts = rows.groupBy("source", "class", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    goal = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), max_repeats)
    earlier = Window.partitionBy("source").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("\x00null"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    base = (parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
            .select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("part").alias("p"), "before"))
    goal = goal.select(F.col("source").alias("s"), "source_size", "target",
                       F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"), offset.alias("offset"))
    placed = base.join(goal, base["s"].eqNullSafe(goal["s"])).select(base["s"], "c", "p", "before", "source_size", "target", "rate", "offset")
    within = Window.partitionBy("source", "class", "part").orderBy("size", "id")
    ranked = rows.withColumn("rank", F.row_number().over(within))
    joined = ranked.join(placed, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("part") == F.col("p")))
    upto = F.col("before") + F.col("rank")
    at = lambda n: F.floor(n * F.col("rate") + F.col("offset"))
    copies = F.least(at(upto) - at(upto - 1), F.lit(max_repeats)).cast("long")
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))


#: The same result in DuckDB.
SQL = f"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0)::bigint as size from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from s0),
s2 as (select *, coalesce(sum(source_size * {MAX_REPEATS}) over w, 0)::bigint as filled, coalesce(sum(weight) over w, 0)::bigint as spent,
         sum(source_size) over ()::bigint as total, sum(weight) over ()::bigint as weights
       from s1 window w as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
s3 as (select *, (total - filled)::double / (weights - spent) as level from s2),
s4 as (select *, (select arg_min(level, spent) from s3 where level * weight <= source_size * {MAX_REPEATS}) as final from s3),
s5 as (select source, source_size, least(final * weight, (source_size * {MAX_REPEATS})::double) as target,
         ('0x' || substr(md5('{SEED}:' || coalesce(source, chr(0) || 'null')), 1, 8))::bigint::double / 4294967296.0 as off
       from s4),
r as (select d.*, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate, off,
        row_number() over (partition by d.source order by
          case when size < 32 then size else length(bin(size)) * 32 + (size >> (length(bin(size)) - 5)) % 16 end,
          doc_id % {PARTS}, size, doc_id) as n
      from d join s5 on d.source is not distinct from s5.source)
select doc_id, size, source_size, target, least(floor(n * rate + off) - floor((n - 1) * rate + off), {MAX_REPEATS})::bigint as copies,
  (least(floor(n * rate + off) - floor((n - 1) * rate + off), {MAX_REPEATS}) * size)::bigint as taken
from r
"""
