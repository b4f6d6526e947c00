"""A change feed from operations that still carry their list index.

Runs of text operations are fused: gaps and islands over the order of
operations within a transaction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import anchor


def patches(ops: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., obj, at, key_str, action, index, count, text, value)``.

    ``ops`` is in order of ``op.counter`` within ``by``. List deletes in a row
    at one index are one delete; directly followed by text on the same object
    they are one splice; text in a row on one object is one splice. Marks give
    no patch. Map deletes, puts, inserts and increments map one to one.
    """
    o = ops.where("action <> 'mark'").withColumn("obj", anchor(F.col("obj"))).withColumn("at", F.col("op.counter"))
    line = Window.partitionBy(*by).orderBy("at")
    kind = F.when((F.col("action") == "del") & F.col("key_str").isNull(), "d").when(F.col("action") == "splice_text", "t").otherwise("o")
    o = o.withColumn("kind", kind)
    before = lambda c: F.lag(c).over(line)
    same = before("obj") == F.col("obj")
    joins = same & (((F.col("kind") == "d") & (before("kind") == "d") & (before("key_idx") == F.col("key_idx")))
                    | ((F.col("kind") == "t") & before("kind").isin("t", "d")))
    o = o.withColumn("island", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(line))
    first = lambda c: F.min_by(c, "at")
    g = o.groupBy(*by, "island").agg(
        F.min("at").alias("at"), first("obj").alias("obj"), first("key_str").alias("key_str"), first("key_idx").alias("key_idx"), first("action").alias("first_action"),
        first("value").alias("value"), F.count_if(F.col("kind") == "d").alias("count"), F.count_if(F.col("kind") == "t").alias("typed"),
        F.expr("listagg(case when kind = 't' then value.s end, '') within group (order by at)").alias("text"))
    action = (F.when(F.col("typed") > 0, "splice_text").when(F.col("count") > 0, "delete").when(F.col("first_action") == "del", "delete")
              .when(F.col("first_action") == "make_object", "put").otherwise(F.col("first_action")))
    map_del = (F.col("first_action") == "del") & F.col("key_str").isNotNull()
    return g.select(*by, "obj", "at", "key_str", action.alias("action"),
                    F.when(map_del, 0).when(F.col("key_idx").isNotNull(), F.col("key_idx")).cast("long").alias("index"),
                    F.when(map_del, 1).otherwise(F.col("count")).cast("long").alias("count"),
                    F.when(F.col("typed") > 0, F.col("text")).alias("text"), F.when(action.isin("put", "insert", "increment"), F.col("value")).alias("value"))
