"""The registered queries of the core engine, each with the same result in DuckDB SQL.

Logs come from ``sources.adapters``; results are flat columns in whole numbers
and strings, so both engines agree bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codec, json as js
from .operators import dag, merge, patches, runs, sequence, state, sync, write
from .schema import OP_ID, anchor, value
from .sources import adapters as A
from .storage import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- SQL of the adapters
K = "cast(json_extract_string(props, '$.k') as bigint)"
EVENTS = f"""b0 as (
  select user_id as doc_id, concat('a', cast(event_id % 3 as varchar)) as actor, cast(floor(event_id / 3) as bigint) + 1 as counter, event_id,
    concat('k', cast({K} % 10 as varchar)) as key, {K} as k,
    case event_type when 'error' then 'del' when 'purchase' then 'increment' else 'put' end as action, cast(round(value * 100) as bigint) as v
  from events)"""


def log_sql(where: str = "true", observed: bool = False) -> str:
    part = "doc_id, key" if observed else "doc_id, key, actor"
    counter = "event_id + 1" if observed else "counter"
    return f"""with {EVENTS},
b as (select * replace ({counter} as counter) from b0),
ops0 as (select *, max(case when action in ('put', 'del') then counter * 2 + (action = 'put')::int end)
           over (partition by {part} order by counter rows between unbounded preceding and 1 preceding) as m from b),
ops as (select *, case when m % 2 = 1 then m // 2 end as pred, {'null' if observed else 'actor'} as pred_actor from ops0 where {where}),
dead as (select distinct doc_id, pred as counter, pred_actor as actor from ops where action in ('put', 'del') and pred is not null),
entries as (select * from ops o where action = 'put' and not exists (
  select 1 from dead d where d.doc_id = o.doc_id and d.counter = o.counter{'' if observed else ' and d.actor = o.actor'})),
winner as (select doc_id, key, max(struct_pack(c := counter, a := actor, v := v, k := k)) as w from entries group by doc_id, key)
"""


LOG = log_sql()
CUT = "event_id <= (select max(event_id) // 2 from events)"
WON = "select doc_id, key, w.c as counter, w.a as actor, w.v as v from winner"
GRAPH = """with ch as (
  select user_id as doc_id, concat('a', cast(event_id % 3 as varchar)) as actor, event_id as id,
    row_number() over (partition by user_id, event_id % 3 order by event_id)::bigint as seq,
    lag(event_id) over (partition by user_id, event_id % 3 order by event_id) as d1,
    case when event_id % 5 = 0 then lag(event_id) over (partition by user_id order by event_id) end as d2
  from events),
deps as (select doc_id, id, d1 as dep from ch where d1 is not null union select doc_id, id, d2 from ch where d2 is not null)
"""
LIST = """with recursive el as (select conv_id as doc_id, turn, role, text, case when turn > 1 then turn - 1 - turn % 2 end as par from conversations),
r as (select doc_id, turn, [-turn] as path from el where par is null
  union all select el.doc_id, el.turn, list_append(r.path, -el.turn) from r join el on el.doc_id = r.doc_id and el.par = r.turn),
o as (select el.*, row_number() over (partition by el.doc_id order by path)::bigint - 1 as pos from r join el using (doc_id, turn)),
vis as (select *, row_number() over (partition by doc_id order by pos)::bigint - 1 as idx, case when turn % 3 = 0 then 'sb:' || text else text end as val
  from o where turn % 5 <> 2)
"""
TEXT = """with c as (select doc_id, unnest(string_split(text, '')) as s, generate_subscripts(string_split(text, ''), 1) as i
  from documents where coalesce(text, '') <> ''),
t as (select doc_id, string_agg(s, '' order by i) as text, count(*)::bigint as n from c where i % 7 <> 0 group by doc_id)
"""


def _flat(won: DataFrame) -> DataFrame:
    return won.select("doc_id", F.col("key_str").alias("key"), "op.counter", "op.actor", F.col("value.i").alias("v"))


def _log(spark: SparkSession, sf_dir: str, tag: str = "int", observed: bool = False) -> DataFrame:
    return A.map_log(spark, sf_dir, tag, observed)


def _won(ops: DataFrame) -> DataFrame:
    return _flat(state.winners(state.entries(ops)))


# ---------------------------------------------------------------- maps
@query(LOG + WON)
def map_get_winner(spark, sf_dir):
    return _won(_log(spark, sf_dir))


@query(LOG + "select doc_id, key, counter, actor, v from entries")
def map_get_all(spark, sf_dir):
    return _flat(state.entries(_log(spark, sf_dir)))


@query(LOG + "select doc_id, key, count(*)::bigint as n from entries group by all")
def map_conflict_count(spark, sf_dir):
    return state.conflict_counts(state.entries(_log(spark, sf_dir))).select("doc_id", F.col("key_str").alias("key"), "n")


@query(LOG + "select distinct doc_id, key from entries")
def map_keys(spark, sf_dir):
    return state.keys(state.entries(_log(spark, sf_dir))).select("doc_id", F.col("key_str").alias("key"))


@query(LOG + "select doc_id, key, w.v as v, row_number() over (partition by doc_id order by key)::bigint - 1 as place from winner")
def map_values(spark, sf_dir):
    won = _won(_log(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("key")).cast("bigint") - 1
    return won.select("doc_id", "key", "v", place.alias("place"))


@query(LOG + "select doc_id, count(distinct key)::bigint as n from entries group by doc_id")
def map_length(spark, sf_dir):
    return state.map_length(state.entries(_log(spark, sf_dir))).select("doc_id", "n")


@query(log_sql(observed=True) + "select doc_id, key, w.c as counter, w.a as actor, w.v as v from winner")
def map_get_observed(spark, sf_dir):
    return _won(_log(spark, sf_dir, observed=True))


@query(LOG + """, d as (select doc_id, key, count(*)::bigint as n_deletes from ops where action = 'del' group by all)
select doc_id, key, n_deletes, count(*)::bigint as n_entries from d join entries using (doc_id, key) group by all""")
def map_delete_add_wins(spark, sf_dir):
    ops = _log(spark, sf_dir)
    dels = ops.where("action = 'del'").groupBy("doc_id", F.col("key_str").alias("key")).agg(F.count("*").alias("n_deletes"))
    live = state.conflict_counts(state.entries(ops)).select("doc_id", F.col("key_str").alias("key"), F.col("n").alias("n_entries"))
    return dels.join(live, ["doc_id", "key"])


@query(LOG + "select doc_id, key, case when w.v % 2 = 0 then w.v end as v from winner")
def typed_get(spark, sf_dir):
    ops = _log(spark, sf_dir)
    even = F.col("value.i") % 2 == 0
    mixed = F.when(even, value("int", F.col("value.i"))).otherwise(value("str", F.col("value.i").cast("string")))
    return state.typed_get(state.entries(ops.withColumn("value", mixed)), "int").select("doc_id", F.col("key_str").alias("key"), "v")


@query(LOG + """, inc as (select doc_id, pred as counter, pred_actor as actor, sum(v)::bigint as delta from ops where action = 'increment' and pred is not null group by all)
select e.doc_id, e.key, e.counter, e.actor, (e.v + coalesce(delta, 0))::bigint as v from entries e left join inc using (doc_id, counter, actor)""")
def counter_value(spark, sf_dir):
    ops = _log(spark, sf_dir, "counter")
    return state.counters(ops, state.entries(ops)).select("doc_id", F.col("key_str").alias("key"), "op.counter", "op.actor", "v")


@query(LOG + "select doc_id, w.c as counter, w.a as actor, w.k as v from winner where key = 'k3'")
def get_path(spark, sf_dir):
    """Every put makes a map that holds the event's property; the path goes through the winning map."""
    ops = _log(spark, sf_dir)
    makes = F.col("action") == "put"
    outer = ops.withColumn("value", F.when(makes, value("obj", F.lit("map"))).otherwise(F.col("value"))).withColumn("action", F.when(makes, "make_object").otherwise(F.col("action")))
    k = A.event_changes(spark, sf_dir).select("event_id", "k")
    inner = (ops.where(makes).join(k, "event_id").withColumn("obj", F.col("op")).withColumn("op", F.struct((F.col("op.counter") + (1 << 40)).alias("counter"), "op.actor"))
             .withColumn("key_str", F.lit("k")).withColumn("value", value("int", F.col("k"))).withColumn("pred", F.array().cast(ops.schema["pred"].dataType)).select(*ops.columns))
    at = state.get_path(state.entries(outer.unionByName(inner)), ["k3", "k"])
    return at.select("doc_id", (F.col("op.counter") - (1 << 40)).alias("counter"), "op.actor", F.col("value.i").alias("v"))


@query(LOG + """, made as (select doc_id, 'list' as kind from ops where action = 'put' and v % 3 = 0 union all select doc_id, 'map' from ops where action = 'put' and v % 3 <> 0
  union all select distinct doc_id, 'map' from ops)
select doc_id, kind, count(*)::bigint as n from made group by all""")
def object_types(spark, sf_dir):
    """Every put makes a list or a map."""
    ops = _log(spark, sf_dir)
    kind = F.when(F.col("value.i") % 3 == 0, "list").otherwise("map")
    made = ops.withColumn("value", F.when(F.col("action") == "put", value("obj", kind)).otherwise(F.col("value")))
    return state.objects(made).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query(LOG + """, cmd as (select doc_id, key from ops group by all)
select c.doc_id, c.key, count(e.counter)::bigint as n_pred, coalesce(sum(e.counter), 0)::bigint as sum_pred from cmd c left join entries e using (doc_id, key) group by all""")
def put_predecessors(spark, sf_dir):
    """For a put at every key, the entries that it would supersede."""
    ops = _log(spark, sf_dir)
    cmd = ops.select("doc_id", "obj", "key_str").distinct()
    p = state.with_pred(cmd, state.entries(ops))
    return p.select("doc_id", F.col("key_str").alias("key"), F.size("pred").cast("bigint").alias("n_pred"),
                    F.aggregate("pred", F.lit(0).cast("bigint"), lambda a, x: a + x["counter"]).alias("sum_pred"))


# ---------------------------------------------------------------- logs and merging
def _two(spark, sf_dir):
    ops = _log(spark, sf_dir)
    return ops.where("op.actor <> 'a2'"), ops.where("op.actor <> 'a0'")


@query(LOG + WON)
def merge_union(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return _won(merge.merge(a, b))


@query(LOG + WON)
def merge_idempotent(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return _won(merge.apply_changes(merge.merge(a, b), b))


@query(LOG + WON)
def merge_commutative(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return _won(merge.merge(b, a))


@query(GRAPH + """, half as (select doc_id, actor, max(seq) // 2 as s from ch group by all)
select doc_id, actor, ch.id, seq from ch join half using (doc_id, actor) where seq > s""")
def missing_changes(spark, sf_dir):
    g = A.change_graph(spark, sf_dir)
    half = g.groupBy("doc_id", "actor").agg(F.floor(F.max("seq") / 2).alias("s"))
    mine = g.join(half, ["doc_id", "actor"]).where("seq <= s").drop("s")
    return merge.missing_changes(mine, g).select("doc_id", "actor", "id", "seq")


@query(GRAPH + "select doc_id, actor, max(seq)::bigint as max_seq from ch group by all")
def clock(spark, sf_dir):
    return dag.clock(A.change_graph(spark, sf_dir))


@query(LOG + "select doc_id, actor, min(counter)::bigint as first from ops group by all")
def actor_table(spark, sf_dir):
    return state.actor_table(_log(spark, sf_dir)).select("doc_id", "actor", "first")


@query(LOG + "select doc_id, max(counter)::bigint + 1 as next_counter from ops group by doc_id")
def next_counter(spark, sf_dir):
    return state.next_counter(_log(spark, sf_dir))


# ---------------------------------------------------------------- the change graph
@query(GRAPH + "select doc_id, id, actor from ch where not exists (select 1 from deps d where d.doc_id = ch.doc_id and d.dep = ch.id)")
def heads(spark, sf_dir):
    return dag.heads(A.change_graph(spark, sf_dir)).select("doc_id", "id", "actor")


_AT = "(select doc_id, max(id) as id from ch where actor = 'a0' group by doc_id)"
_CLOSURE = GRAPH.replace("with ch", "with recursive ch") + f""", up as (select * from {_AT} union select deps.doc_id, deps.dep from up join deps on deps.doc_id = up.doc_id and deps.id = up.id)
"""


def _seen(spark, sf_dir):
    g = cut(A.change_graph(spark, sf_dir))
    return g, dag.ancestors(g, g.where("actor = 'a0'").groupBy("doc_id").agg(F.max("id").alias("id")), cut)


@query(_CLOSURE + "select doc_id, id from up")
def ancestors(spark, sf_dir):
    return _seen(spark, sf_dir)[1]


@query(_CLOSURE + "select doc_id, id from ch where not exists (select 1 from up where up.doc_id = ch.doc_id and up.id = ch.id)")
def changes_since(spark, sf_dir):
    g, known = _seen(spark, sf_dir)
    return dag.changes_since(g, known).select("doc_id", "id")


@query(GRAPH + "select distinct deps.doc_id, deps.dep as id from deps where deps.id % 3 <> 0 and deps.dep % 3 = 0")
def missing_deps(spark, sf_dir):
    g = A.change_graph(spark, sf_dir)
    return dag.missing_deps(g.where("actor <> 'a0'"))


@query("""select event_id as id, sha256(unhex(concat(lpad(to_hex(user_id), 32, '0'), """
       + ", ".join(f"substr(lpad(to_hex({x}), 16, '0'), {15 - 2 * i}, 2)" for x in ("event_id", "event_id + 1", "0", "1") for i in range(8))
       + """, sha256(user_id::varchar)))) as hash from events""")
def change_hash(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    actor = F.unhex(F.lpad(F.hex("user_id"), 32, "0"))
    deps = F.array(F.unhex(F.sha2(F.col("user_id").cast("string"), 256)))
    return e.select(F.col("event_id").alias("id"), dag.change_hash(actor, F.col("event_id"), F.col("event_id") + 1, F.lit(0), F.lit(1), deps).alias("hash"))


@query(GRAPH + "select doc_id, bool_and(ok) as linear from (select doc_id, actor, count(*) = max(seq) as ok from ch group by all) group by doc_id")
def linear_histories(spark, sf_dir):
    return dag.is_linear(A.change_graph(spark, sf_dir))


# ---------------------------------------------------------------- the past
def _past(spark, sf_dir):
    """The log as of the middle event, cut by the clock that each document had then."""
    ops = _log(spark, sf_dir)
    mid = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.floor(F.max("event_id") / 2)).first()[0]
    at = state.clock(ops.where(F.col("event_id") <= mid))
    return merge.visible_at(ops, at)


PAST = log_sql(CUT)


@query(PAST + WON)
def get_at(spark, sf_dir):
    return _won(_past(spark, sf_dir))


@query(PAST + "select distinct doc_id, key from entries")
def keys_at(spark, sf_dir):
    return state.keys(state.entries(_past(spark, sf_dir))).select("doc_id", F.col("key_str").alias("key"))


@query(PAST + "select doc_id, key, w.v as v from winner")
def values_at(spark, sf_dir):
    return _won(_past(spark, sf_dir)).select("doc_id", "key", "v")


@query(PAST + "select doc_id, count(distinct key)::bigint as n from entries group by doc_id")
def length_at(spark, sf_dir):
    return state.map_length(state.entries(_past(spark, sf_dir))).select("doc_id", "n")


# ---------------------------------------------------------------- lists
@query(LIST + "select doc_id, turn, pos from o")
def list_order(spark, sf_dir):
    return sequence.elements(A.list_log(spark, sf_dir, edits=False)).select("doc_id", (F.col("elem.counter") - 1).alias("turn"), "pos")


def _shown(spark, sf_dir):
    return sequence.visible(cut(A.list_log(spark, sf_dir)))


@query(LIST + "select doc_id, idx, val as v from vis")
def list_values(spark, sf_dir):
    return _shown(spark, sf_dir).select("doc_id", "idx", F.col("value.s").alias("v"))


@query(LIST + "select doc_id, turn, val as v from vis where idx = 1")
def list_get(spark, sf_dir):
    return sequence.get(_shown(spark, sf_dir), 1).select("doc_id", (F.col("elem.counter") - 1).alias("turn"), F.col("value.s").alias("v"))


@query(LIST + "select doc_id, turn + 1 as counter, role as actor from vis where idx = 0")
def cursor_create(spark, sf_dir):
    return sequence.cursors(_shown(spark, sf_dir), 0).select("doc_id", "cursor.counter", "cursor.actor")


@query(LIST + "select o.doc_id, o.turn, vis.idx from o left join vis using (doc_id, turn) where o.turn in (1, 2)")
def cursor_resolve(spark, sf_dir):
    ops = cut(A.list_log(spark, sf_dir))
    order = cut(sequence.elements(ops))
    made = order.select("doc_id", "obj", F.col("elem").alias("cursor")).where("cursor.counter in (2, 3)")
    return sequence.resolve_cursors(made, sequence.visible(ops, order)).select("doc_id", (F.col("cursor.counter") - 1).alias("turn"), "idx")


_MARK = LIST + """select a.doc_id, 'bold' as name, a.idx as start, b.idx + 1 as "end" from vis a join vis b using (doc_id)
  join (select doc_id, min(turn) as x, max(turn) as y from o group by doc_id) e using (doc_id) where a.turn = x and b.turn = y"""


@query(_MARK)
def marks(spark, sf_dir):
    ops = cut(A.list_log(spark, sf_dir))
    return sequence.marks(ops, cut(sequence.visible(ops))).select("doc_id", "name", "start", "end")


@query(_MARK.replace("from o where turn % 5 <> 2", "from o"))
def marks_at(spark, sf_dir):
    """Marks as of a cut before anything was deleted."""
    ops = A.list_log(spark, sf_dir)
    at = state.clock(ops.where("action <> 'del'"))
    then = merge.visible_at(ops, at)
    return sequence.marks(then, sequence.visible(then)).select("doc_id", "name", "start", "end")


# ---------------------------------------------------------------- text
def _typed(spark, sf_dir):
    """Every text as runs, and the marks of what was deleted."""
    typed, dels = A.text_runs(spark, sf_dir)
    return typed, runs.gone(sequence.deleted(dels))


@query(TEXT + "select doc_id, text from t")
def text_content(spark, sf_dir):
    return runs.text(*_typed(spark, sf_dir)).select("doc_id", "text")


@query(TEXT + "select doc_id, n from t")
def text_length(spark, sf_dir):
    return runs.length(*_typed(spark, sf_dir)).select("doc_id", "n")


@query(TEXT + """, half as (select doc_id, max(i) as n from c group by doc_id)
select doc_id, string_agg(s, '' order by i) as text from c join half using (doc_id) where i % 7 <> 0 and 2 * i <= n group by doc_id""")
def text_at(spark, sf_dir):
    """Text as of the clock at which half of each document was typed; deletes of that half are by another actor and are included."""
    typed, marks = _typed(spark, sf_dir)
    half = typed.groupBy("doc_id", "op.actor").agg(F.floor(F.max(F.col("op.counter") + F.col("n") - 1) / 2).alias("max_counter"))
    return runs.text(runs.visible_at(typed, half), marks).select("doc_id", "text")


@query(TEXT + "select doc_id, case when n >= 6 then substr(text, 1, 2) || 'xyz' || substr(text, 6) end as text from t where n >= 6")
def text_splice(spark, sf_dir):
    """Three characters at index 2 of every text replaced by three others."""
    typed, marks = _typed(spark, sf_dir)
    marks = cut(marks)
    gone, new = _spliced(typed, marks)
    both = typed.unionByName(new.withColumn("obj", F.lit(None).cast(OP_ID)))
    after = runs.text(both, marks.unionByName(runs.gone(sequence.deleted(gone))))
    return after.where("char_length(text) >= 6").select("doc_id", "text")  # as many as before the edit


def _spliced(typed: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The deletes and the run that put ``xyz`` for the three characters at index 2 of texts of six at least."""
    shown = cut(runs.shown(typed, marks))
    cmd = (shown.groupBy("doc_id", "obj").agg(F.sum("seen").alias("n")).where("n >= 6").select("doc_id", "obj", F.struct(F.lit(1 << 50).alias("counter"), F.lit("u").alias("actor")).alias("op"),
           F.lit(2).cast("bigint").alias("pos"), F.lit(3).alias("count"), F.lit("xyz").alias("text")))
    gone, new = runs.splice(cmd, shown)
    return cut(gone), cut(new)


# ---------------------------------------------------------------- patches
@query("select doc_id, 'splice_text' as action, 0::bigint as index, 0::bigint as count, text from documents where coalesce(text, '') <> ''")
def patches_splice(spark, sf_dir):
    typed, _ = A.text_runs(spark, sf_dir)
    return patches.patches(runs.as_ops(typed), ["doc_id"]).select("doc_id", "action", "index", "count", "text")


@query(TEXT + "select doc_id, i::bigint - 1 as index, 1::bigint as count from c where i % 7 = 0")
def patches_delete(spark, sf_dir):
    ops = A.text_log(spark, sf_dir).where("action = 'del'")
    return patches.patches(ops, ["doc_id"]).select("doc_id", "index", "count")


@query(LOG + "select doc_id, actor, counter as at, key, v from ops where action = 'put'")
def patches_put(spark, sf_dir):
    p = patches.patches(_log(spark, sf_dir).withColumn("actor", F.col("op.actor")), ["doc_id", "actor"]).where("action = 'put'")
    return p.select("doc_id", "actor", "at", F.col("key_str").alias("key"), F.col("value.i").alias("v"))


@query(LOG + "select doc_id, actor, counter as at, key, v as delta from ops where action = 'increment'")
def patches_increment(spark, sf_dir):
    p = patches.patches(_log(spark, sf_dir).withColumn("actor", F.col("op.actor")), ["doc_id", "actor"]).where("action = 'increment'")
    return p.select("doc_id", "actor", "at", F.col("key_str").alias("key"), F.col("value.i").alias("delta"))


# ---------------------------------------------------------------- JSON
def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("select event_id, json_extract_string(props, '/k') as v from events")
def json_pointer_get(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", js.get_pointer(F.col("props"), "/k").alias("v"))


_PATCH = "json_merge_patch(props, json_object('k', case when event_id % 2 = 0 then null else k + 1 end, 'u', user_id))"


@query(f"""with e as (select *, {K} as k from events), m as (select event_id, {_PATCH} as j from e)
select event_id, json_extract_string(j, '$.k') as k, json_extract_string(j, '$.u') as u from m""")
def json_merge_patch(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    patch = F.to_json(F.struct(F.when(F.col("event_id") % 2 != 0, F.col("k") + 1).alias("k"), F.col("user_id").alias("u")), {"ignoreNullFields": "false"})
    j = e.select("event_id", js.merge_patch(F.col("props"), patch).alias("j"))
    return j.select("event_id", F.get_json_object("j", "$.k").alias("k"), F.get_json_object("j", "$.u").alias("u"))


@query(f"""select event_id, case when event_id % 2 = 0 then cast({K} + 1 as varchar) end as k, cast(user_id as varchar) as u from events""")
def json_generate_merge_patch(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    new = F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, k + 1).otherwise(k).alias("k"), F.col("user_id").alias("u")))
    p = _events(spark, sf_dir).select("event_id", js.generate_merge_patch(F.col("props"), new).alias("p"))
    return p.select("event_id", F.get_json_object("p", "$.k").alias("k"), F.get_json_object("p", "$.u").alias("u"))


@query(f"""with e as (select event_id, {K} as k, user_id from events)
select event_id, '/a/k' as pointer, cast(k as varchar) as leaf from e union all select event_id, '/b/0', cast(user_id as varchar) from e
union all select event_id, '/b/1', '"x"' from e""")
def json_flatten(spark, sf_dir):
    e = _events(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("bigint")
    doc = F.concat(F.lit('{"a":{"k":'), k.cast("string"), F.lit('},"b":['), F.col("user_id").cast("string"), F.lit(',"x"],"c":{}}'))
    return e.select("event_id", F.explode(js.flatten(doc)).alias("x")).select("event_id", "x.pointer", "x.leaf")


@query(LOG + "select doc_id, key, cast(w.v as varchar) as v from winner")
def json_export(spark, sf_dir):
    """Every document as one JSON object, read back by key."""
    doc = js.export_maps(state.winners(state.entries(_log(spark, sf_dir))))
    back = doc.select("doc_id", F.explode(F.from_json("json", "map<string,string>")).alias("key", "v"))
    return back.select("doc_id", "key", "v")


@query(f"select event_id, case when {K} is null then 'null' else 'int' end as tag, {K} as i from events")
def json_import_types(spark, sf_dir):
    ops = js.import_json(_events(spark, sf_dir).select(F.col("event_id").alias("doc_id"), F.col("props").alias("json")), "imp")
    return ops.where("key_str = 'k'").select(F.col("doc_id").alias("event_id"), "value.tag", "value.i")


@query("select doc_id, lower(to_hex(encode(coalesce(lang, '')))) as h, to_base64(encode(coalesce(text, ''))) as b from documents")
def hex_base64(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.lower(F.hex(F.coalesce("lang", F.lit("")).cast("binary"))).alias("h"),
                    F.regexp_replace(F.base64(F.coalesce("text", F.lit("")).cast("binary")), "[\r\n]", "").alias("b"))


# ---------------------------------------------------------------- encodings
_RUNS = """with x as (select event_id, user_id, event_type, lag(event_type) over (partition by user_id order by event_id) as p from events),
y as (select *, sum(case when p is null or p <> event_type then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) as run from x)
"""


@query(_RUNS + "select user_id, run::bigint as run, min(event_type) as v, count(*)::bigint as n from y group by all")
def rle_runs(spark, sf_dir):
    return codec.runs(_events(spark, sf_dir), ["user_id"], "event_id", "event_type").select("user_id", "run", F.col("event_type").alias("v"), "n")


@query("select user_id, event_id, event_id - coalesce(lag(event_id) over (partition by user_id order by event_id), 0) as delta from events")
def delta_encode(spark, sf_dir):
    return codec.deltas(_events(spark, sf_dir), ["user_id"], "event_id", "event_id").select("user_id", "event_id", "delta")


@query(_RUNS.replace("event_type", "flag").replace("from events", "from (select *, event_type = 'click' as flag from events)")
       + "select user_id, run::bigint as run, bool_and(flag) as v, count(*)::bigint as n from y group by all")
def bool_runs(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("flag", F.col("event_type") == "click")
    return codec.runs(e, ["user_id"], "event_id", "flag").select("user_id", "run", F.col("flag").alias("v"), "n")


@query("select event_id, greatest(1, ceil(length(bin(event_id * 1000)) / 7.0))::bigint as n from events")
def leb128_length(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", codec.uleb128_length(F.col("event_id") * 1000).alias("n"))


@query("""with recursive d as (select event_id, event_id * 1000 as x, 0 as k from events union all select event_id, x // 128, k + 1 from d where x >= 128)
select event_id, string_agg(lower(lpad(to_hex((x % 128 + case when x >= 128 then 128 else 0 end)::bigint), 2, '0')), '' order by k) as bytes from d group by event_id""")
def leb128_bytes(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.lower(F.hex(codec.uleb128_column(F.col("event_id") * 1000))).alias("bytes"))


@query("select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from documents")
def hex_base64_decode(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    there = lambda c: F.coalesce(c, F.lit("")).cast("binary")
    return d.select("doc_id", js.hex_to_bytes(F.lower(F.hex(there(F.col("lang"))))).cast("string").alias("lang"), F.unbase64(F.base64(there(F.col("text")))).cast("string").alias("text"))


# ---------------------------------------------------------------- writing
_LIVE = "select doc_id, key, w.c as counter, w.a as actor, w.v as v from winner"
_TOP = ", top as (select doc_id, max(counter) as c from ops group by doc_id)\n"


def _commands(ops: DataFrame, actor: str = "w") -> DataFrame:
    """One edit of the root of each document."""
    return ops.select("doc_id").distinct().select("doc_id", F.lit(actor).alias("actor"), F.lit(None).cast(OP_ID).alias("obj"), F.lit(0).alias("n"))


def _after(ops: DataFrame, new: DataFrame) -> DataFrame:
    return ops.select(*write.COLUMNS).unionByName(new)


@query(LOG + _TOP + """select * from (select doc_id, key, w.c as counter, w.a as actor, w.v as v from winner where key <> 'k1')
union all select doc_id, 'k1', c + 1, 'w', 7 from top""")
def put_scalar(spark, sf_dir):
    ops = cut(_log(spark, sf_dir))
    new = write.put(_commands(ops).withColumn("key_str", F.lit("k1")).withColumn("value", value("int", F.lit(7))), ops)
    return _flat(state.entries(_after(ops, new)).where("key_str = 'k1'")).unionByName(_won(ops).where("key <> 'k1'"))


@query(LOG + "select doc_id, key, counter, actor, v from entries where key <> 'k2'")
def delete_key(spark, sf_dir):
    ops = cut(_log(spark, sf_dir))
    return _flat(state.entries(_after(ops, write.delete_key(_commands(ops).withColumn("key_str", F.lit("k2")), ops))))


@query(LOG + """, inc as (select doc_id, pred as counter, pred_actor as actor, sum(v)::bigint as delta from ops where action = 'increment' and pred is not null group by all)
select e.doc_id, e.key, e.counter, e.actor, (e.v + coalesce(delta, 0) + case when e.key = 'k3' then 5 else 0 end)::bigint as v from entries e left join inc using (doc_id, counter, actor)""")
def increment_key(spark, sf_dir):
    ops = cut(_log(spark, sf_dir, "counter"))
    held = state.entries(ops).where("key_str = 'k3'").select("doc_id").distinct()
    c = _commands(ops).join(held, "doc_id", "left_semi").withColumn("key_str", F.lit("k3")).withColumn("delta", F.lit(5))
    log = cut(_after(ops, write.increment(c, ops)))
    return state.counters(log, state.entries(log)).select("doc_id", F.col("key_str").alias("key"), "op.counter", "op.actor", "v")


@query(LOG + _TOP + """select doc_id, key, c + row_number() over (partition by doc_id order by key) as counter, v::bigint as v from top, (values ('x', 1), ('y', 2), ('z', 3)) t(key, v)
union all select doc_id, key, counter, v from entries""")
def put_all(spark, sf_dir):
    ops = cut(_log(spark, sf_dir))
    values = F.map_from_arrays(F.array(*map(F.lit, "zxy")), F.array(*(value("int", F.lit(k)) for k in (3, 1, 2))))
    return _flat(state.entries(_after(ops, write.put_all(_commands(ops).withColumn("values", values), ops)))).drop("actor")


@query(LOG + """select doc_id, 'object' as kind, v % 5 as a, v + 1 as b from (select doc_id, max(counter)::bigint as v from ops group by doc_id)""")
def put_tree(spark, sf_dir):
    """A nested tree put at a key, read back by export."""
    ops = cut(_log(spark, sf_dir))
    top = ops.groupBy("doc_id").agg(F.max("op.counter").alias("v"))
    tree = F.concat(F.lit('{"l":[{"a":'), (F.col("v") % 5).cast("string"), F.lit("},"), (F.col("v") + 1).cast("string"), F.lit(',"x"],"m":{"e":[],"kind":"object"}}'))
    c = _commands(ops).join(top, "doc_id").withColumn("key_str", F.lit("k1")).withColumn("json", tree)
    out = js.export_json(_after(ops, write.put_json(c, ops)))
    at = lambda p: F.get_json_object("json", "$.k1" + p)
    return out.select("doc_id", at(".m.kind").alias("kind"), at(".l[0].a").cast("bigint").alias("a"), at(".l[1]").cast("bigint").alias("b"))


def _list_edit(spark, sf_dir, least: int):
    """The list log, its visible elements, and a command for every list of ``least`` elements."""
    ops = cut(A.list_log(spark, sf_dir).drop("event_id"))
    shown = cut(sequence.visible(ops))
    held = sequence.length(shown).where(F.col("n") >= least).select("doc_id")
    return ops, shown, _commands(ops).join(held, "doc_id", "left_semi").withColumn("value", value("str", F.lit("new")))


def _list_after(ops: DataFrame, new: DataFrame) -> DataFrame:
    return sequence.visible(cut(_after(ops, new))).select("doc_id", "idx", F.col("value.s").alias("v"))


@query(LIST + "select doc_id, idx + (idx > 0)::bigint as idx, val as v from vis union all select doc_id, 1, 'new' from vis where idx = 0")
def list_insert(spark, sf_dir):
    ops, shown, c = _list_edit(spark, sf_dir, 1)
    return _list_after(ops, write.insert(c.withColumn("index", F.lit(1).cast("bigint")), ops, shown))


@query(LIST + "select doc_id, idx + 3 as idx, val as v from vis union all select doc_id, x::bigint, 'v' || x from (select distinct doc_id from vis), range(3) t(x)")
def list_insert_all(spark, sf_dir):
    ops, shown, c = _list_edit(spark, sf_dir, 1)
    values = F.array(*(value("str", F.lit(f"v{k}")) for k in range(3)))
    return _list_after(ops, write.insert_all(c.drop("value").withColumn("values", values).withColumn("index", F.lit(0).cast("bigint")), ops, shown))


@query(LIST + "select doc_id, idx, case when idx = 1 then 'new' else val end as v from vis")
def list_set(spark, sf_dir):
    ops, shown, c = _list_edit(spark, sf_dir, 2)
    return _list_after(ops, write.set_index(c.withColumn("index", F.lit(1).cast("bigint")), ops, shown))


@query(LIST + "select doc_id, idx - 1 as idx, val as v from vis where idx > 0")
def list_delete(spark, sf_dir):
    ops, shown, c = _list_edit(spark, sf_dir, 1)
    return _list_after(ops, write.delete_index(c.withColumn("index", F.lit(0).cast("bigint")), ops, shown))


@query(LIST + "select doc_id, 'em' as name, 0::bigint as start, 2::bigint as \"end\" from vis where idx = 1")
def list_mark(spark, sf_dir):
    ops, shown, c = _list_edit(spark, sf_dir, 2)
    new = write.mark(c.withColumn("name", F.lit("em")).withColumn("value", value("bool", F.lit(True))).withColumn("start", F.lit(0).cast("bigint")).withColumn("end", F.lit(2).cast("bigint")), ops, shown)
    return sequence.marks(_after(ops, new), shown).where("name = 'em'").select("doc_id", "name", "start", "end")


@query(LIST + "select doc_id, count(*)::bigint as n from vis group by doc_id")
def list_length(spark, sf_dir):
    return sequence.length(_shown(spark, sf_dir)).select("doc_id", "n")


@query(GRAPH + """, h as (select doc_id, id from ch where not exists (select 1 from deps d where d.doc_id = ch.doc_id and d.dep = ch.id)),
t as (select doc_id, max(id) + 1 as id from ch group by doc_id)
select doc_id, t.id, 1::bigint as seq, count(h.id)::bigint as n_deps, 1::bigint as n_ops from t join h using (doc_id) group by all""")
def commit(spark, sf_dir):
    """A put in every document committed: the change that depends on all heads, which is then the only head."""
    ops, g = cut(_log(spark, sf_dir)), cut(A.change_graph(spark, sf_dir))
    new = cut(write.put(_commands(ops).withColumn("key_str", F.lit("k1")).withColumn("value", value("int", F.lit(1))), ops))
    made = write.commit(new, g, "w")
    _, changes, _ = write.transact(ops, g, new, "w")
    return dag.heads(changes).join(made.select("doc_id", "id", "n_ops"), ["doc_id", "id"], "left").select("doc_id", "id", "seq", F.size("deps").cast("bigint").alias("n_deps"), "n_ops")


@query(LOG + _TOP + """select doc_id, 'delete' as action, 'k2' as key, null::bigint as v, 0::bigint as index, 1::bigint as count from top
union all select doc_id, 'put', 'k1', 7, null, 0 from top""")
def transact_with_patches(spark, sf_dir):
    ops, g = cut(_log(spark, sf_dir)), A.change_graph(spark, sf_dir)
    put = write.put(_commands(ops).withColumn("key_str", F.lit("k1")).withColumn("value", value("int", F.lit(7))), ops)
    log = cut(_after(ops, put))
    new = put.unionByName(write.delete_key(_commands(ops).withColumn("key_str", F.lit("k2")), log))
    p = write.transact(ops, g, new, "w")[2]
    return p.select("doc_id", "action", F.col("key_str").alias("key"), F.col("value.i").alias("v"), "index", "count")


@query(LOG + """, o as (select distinct doc_id from ops) select doc_id, 'k1' as key, 3::bigint as n from o""")
def fork_batch_put(spark, sf_dir):
    """Three forks write the same key and are merged: each put survives as a conflict."""
    ops = cut(_log(spark, sf_dir))
    branches = merge.fork(_commands(ops), ["f0", "f1", "f2"]).withColumn("actor", F.col("branch"))
    puts = [write.put(branches.where(F.col("branch") == b).withColumn("key_str", F.lit("k1")).withColumn("value", value("int", F.lit(k))), ops) for k, b in enumerate(("f0", "f1", "f2"))]
    merged = merge.merge(*(_after(ops, p) for p in puts))
    return state.conflict_counts(state.entries(merged).where("key_str = 'k1'")).select("doc_id", F.col("key_str").alias("key"), "n")


@query(LOG + """, f as (select doc_id, actor, min(counter) as first from ops group by all)
select doc_id, actor, row_number() over (partition by doc_id order by actor <> 'a1', first, actor)::bigint - 1 as place from f""")
def actor_places(spark, sf_dir):
    return state.actor_places(_log(spark, sf_dir), "a1").select("doc_id", "actor", "place")


# ---------------------------------------------------------------- nested documents
def _nested(spark, sf_dir, together=False):
    """A document for every event, with lists in maps and maps in lists."""
    e = _events(spark, sf_dir)
    k = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0)).cast("string")
    j = F.concat(F.lit('{"xs":[1,['), k, F.lit('],{}],"m":{"y":[{"z":'), F.col("event_id").cast("string"), F.lit(',"q":"a\\"b"},[]]},"u":'), F.col("user_id").cast("string"), F.lit("}"))
    docs = e.select(F.col("event_id").alias("doc_id"), j.alias("json"))
    return js.import_json(js.together(docs) if together else docs, "imp")


_EACH = f"select event_id as doc_id, coalesce({K}, 0) as k, user_id as u from events"


@query(f"""select doc_id, concat('{{"m":{{"y":[{{"q":"a\\"b","z":', doc_id, '}},[]]}},"u":', u, ',"xs":[1,[', k, '],{{}}]}}') as json from ({_EACH})""")
def json_export_nested(spark, sf_dir):
    return js.export_together(_nested(spark, sf_dir, together=True))


@query(LIST + """select doc_id, concat('[', string_agg(to_json(val)::varchar, ',' order by idx), ']') as json from vis where val not like '%/%' group by doc_id""".replace(" where val not like '%/%'", ""))
def json_export_lists(spark, sf_dir):
    """The visible elements of each list, as the list below a key."""
    ops = A.list_log(spark, sf_dir).drop("event_id").where("action <> 'mark'")
    box = F.struct(F.lit(1).cast("bigint").alias("counter"), F.lit("box").alias("actor"))
    made = ops.select("doc_id").distinct().withColumn("op", box).withColumn("key_str", F.lit("l")).withColumn("action", F.lit("make_object")).withColumn("value", value("obj", F.lit("list")))
    made = made.withColumn("pred", F.array().cast(f"array<{OP_ID}>")).withColumn("obj", F.lit(None).cast(OP_ID)).withColumn("after", F.lit(None).cast(OP_ID)).withColumn("key_idx", F.lit(None).cast("bigint"))
    out = js.export_json(ops.withColumn("obj", box).select(*write.COLUMNS).unionByName(made.select(*write.COLUMNS)))
    listed = F.expr("substring(json, 6, length(json) - 6)")
    shown = sequence.length(_shown(spark, sf_dir)).select("doc_id")
    return out.join(shown, "doc_id", "left_semi").select("doc_id", listed.alias("json"))


@query(TEXT + "select doc_id, to_json(text)::varchar as json from t")
def json_export_text(spark, sf_dir):
    """Typed text as the string below a key."""
    typed, marks = _typed(spark, sf_dir)
    box = F.struct(F.lit(1 << 45).alias("counter"), F.lit("box").alias("actor"))
    made = typed.select("doc_id").distinct().withColumn("op", box).withColumn("key_str", F.lit("t")).withColumn("action", F.lit("make_object")).withColumn("value", value("obj", F.lit("text")))
    made = made.withColumn("pred", F.array().cast(f"array<{OP_ID}>")).withColumn("obj", F.lit(None).cast(OP_ID)).withColumn("after", F.lit(None).cast(OP_ID)).withColumn("key_idx", F.lit(None).cast("bigint"))
    out = js.export_json(made.select(*write.COLUMNS), texts=(typed.withColumn("obj", box), marks))
    string = F.expr("substring(json, 6, length(json) - 6)")
    return out.select("doc_id", string.alias("json")).where("json <> '\"\"'")


@query(f"select doc_id, doc_id as z, k from ({_EACH})")
def get_path_index(spark, sf_dir):
    """Steps by key and by index: /m/y/0/z and /xs/1/0."""
    ops = cut(_nested(spark, sf_dir))
    live, shown = cut(state.entries(ops)), cut(sequence.visible(ops))
    z = state.get_path(live, ["m", "y", 0, "z"], shown).select("doc_id", F.col("value.i").alias("z"))
    return z.join(state.get_path(live, ["xs", 1, 0], shown).select("doc_id", F.col("value.i").alias("k")), "doc_id")


@query(f"select doc_id, 'list' as kind, 'imp' as actor, 0::bigint as n from ({_EACH})")
def obj_id(spark, sf_dir):
    """The id of the object at /m/y/1, an empty list; it is an object that was made, and a scalar has none."""
    ops = cut(_nested(spark, sf_dir))
    live, shown = cut(state.entries(ops)), cut(sequence.visible(ops))
    found = state.get_obj_id(live, ["m", "y", 1], shown)
    none = state.get_obj_id(live, ["u"]).groupBy("doc_id").agg(F.count("*").alias("n"))
    return found.join(state.objects(ops), ["doc_id", "obj", "kind"], "left_semi").join(none, "doc_id", "left").select("doc_id", "kind", "obj.actor", F.coalesce("n", F.lit(0)).alias("n"))


_AT_HEADS = _CLOSURE.rstrip() + ", " + log_sql("event_id in (select id from up)").removeprefix("with ")


def _at_heads(spark, sf_dir):
    """The log as the last change of one actor in each document sees it."""
    ops = A.map_log(spark, sf_dir).withColumn("change", F.col("event_id"))
    g = cut(A.change_graph(spark, sf_dir))
    return cut(dag.visible_at_heads(ops, g, g.where("actor = 'a0'").groupBy("doc_id").agg(F.max("id").alias("id")), cut, "change"))


@query(_AT_HEADS + WON)
def get_at_heads(spark, sf_dir):
    return _won(_at_heads(spark, sf_dir))


@query(_AT_HEADS + "select doc_id, key, cast(w.v as varchar) as v from winner")
def json_export_at_heads(spark, sf_dir):
    doc = js.export_json(_at_heads(spark, sf_dir).select(*write.COLUMNS))
    return doc.select("doc_id", F.explode(F.from_json("json", "map<string,string>")).alias("key", "v"))


@query(_CLOSURE.replace("deps.dep from up join deps on deps.doc_id = up.doc_id and deps.id = up.id", "deps.id from up join deps on deps.doc_id = up.doc_id and deps.dep = up.id").replace("max(id)", "min(id)")
       + "select doc_id, id from up")
def dependents(spark, sf_dir):
    g = cut(A.change_graph(spark, sf_dir))
    return dag.ancestors(g, g.where("actor = 'a0'").groupBy("doc_id").agg(F.min("id").alias("id")), cut, reverse=True)


@query(GRAPH + ", w as (select doc_id, id, row_number() over (partition by doc_id order by id desc)::bigint as place from ch where id % 4 = 0) select w.doc_id, place, w.id, actor, seq from w join ch using (doc_id, id)")
def changes_by_hash(spark, sf_dir):
    g = A.change_graph(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("id"))).cast("bigint")
    return dag.by_hash(g, g.where("id % 4 = 0").select("doc_id", "id", place.alias("place"))).select("doc_id", "place", "id", "actor", "seq")


# ---------------------------------------------------------------- patches of edits
@query(LIST + """select doc_id, 'insert' as action, 1::bigint as index, 'new' as v from vis where idx = 0""")
def patches_insert(spark, sf_dir):
    ops, shown, c = _list_edit(spark, sf_dir, 1)
    p = patches.patches(write.insert(c.withColumn("index", F.lit(1).cast("bigint")), ops, shown), ["doc_id"])
    return p.select("doc_id", "action", "index", F.col("value.s").alias("v"))


@query(TEXT + "select doc_id, 'splice_text' as action, 2::bigint as index, 3::bigint as count, 'xyz' as text from t where n >= 6")
def patches_delete_then_text(spark, sf_dir):
    """Three deletes at one index and the text typed there are one splice."""
    gone, new = _spliced(*_typed(spark, sf_dir))
    return patches.patches(gone.unionByName(runs.unfold(new)), ["doc_id"]).select("doc_id", "action", "index", "count", "text")


@query(LOG + """select doc_id, actor, counter as at, concat('{"obj":"root","key":"', key, '","action":{"type":"put","value":', v, ',"conflict":false}}') as json from ops where action = 'put'
union all select doc_id, actor, counter, concat('{"obj":"root","key":"', key, '","action":{"type":"increment","delta":', v, '}}') from ops where action = 'increment'
union all select doc_id, actor, counter, concat('{"obj":"root","key":"', key, '","action":{"type":"delete","index":0,"count":1}}') from ops where action = 'del'""")
def patches_json(spark, sf_dir):
    p = patches.patches(_log(spark, sf_dir).withColumn("actor", F.col("op.actor")), ["doc_id", "actor"])
    return p.select("doc_id", "actor", "at", js.patch_json(p).alias("json"))


@query(LOG + """select doc_id, counter as c, actor as a, concat('{"counter":', counter, ',"actor":"', actor, '"}') as op, '"root"' as obj,
concat('{"position":{"counter":', counter, ',"actor":"', actor, '"}}') as cursor,
concat('{"start":', counter, ',"end":', counter + 1, ',"name":"', key, '","value":', v, '}') as mark from ops""")
def ids_json(spark, sf_dir):
    ops = _log(spark, sf_dir)
    c = F.col("op.counter")
    return ops.select("doc_id", c.alias("c"), F.col("op.actor").alias("a"), js.op_id_json(F.col("op")).alias("op"), js.obj_id_json(anchor(F.col("obj"))).alias("obj"),
                      js.cursor_json(F.col("op")).alias("cursor"), js.mark_json(c, c + 1, F.col("key_str"), F.col("value")).alias("mark"))


@query(GRAPH + """select doc_id, id, concat('{"actor":"', actor, '","seq":', seq, ',"start_op":', id, ',"timestamp":0,"operations":1,"deps":[', coalesce(n, ''), ']}') as json
from ch left join (select doc_id, id, string_agg(dep, ',' order by dep) as n from deps group by all) using (doc_id, id)""")
def changes_json(spark, sf_dir):
    g = A.change_graph(spark, sf_dir)
    return g.select("doc_id", "id", js.change_json(F.col("actor"), F.col("seq"), F.col("id"), F.lit(0), F.lit(1), F.col("deps")).alias("json"))


# ---------------------------------------------------------------- JSON patches
@query("select event_id, '1' as z, cast(user_id as varchar) as u from events")
def json_patch(spark, sf_dir):
    """Add, copy, move, test, replace and remove on every event's properties."""
    e = _events(spark, sf_dir)
    patch = F.concat(F.lit('[{"op":"add","path":"/t","value":'), F.col("user_id").cast("string"), F.lit('},{"op":"copy","from":"/t","path":"/c"},{"op":"move","from":"/c","path":"/u"},'
                     '{"op":"remove","path":"/t"},{"op":"add","path":"/z","value":[0]},{"op":"add","path":"/z/-","value":2},{"op":"test","path":"/z","value":[0,2]},{"op":"replace","path":"/z","value":1}]'))
    j = e.select("event_id", js.json_patch(F.coalesce("props", F.lit("{}")), patch).alias("j"))
    return j.select("event_id", F.get_json_object("j", "$.z").alias("z"), F.get_json_object("j", "$.u").alias("u"))


@query(f"select event_id, cast({K} as varchar) as k, cast(event_id as varchar) as v from events")
def json_diff(spark, sf_dir):
    """The patch from one tree to another, applied."""
    e = _events(spark, sf_dir)
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("null"))
    old = F.concat(F.lit('{"a":[1,2,3],"k":'), k, F.lit(',"gone":{}}'))
    new = F.concat(F.lit('{"a":[1,'), F.col("event_id").cast("string"), F.lit('],"k":'), k, F.lit("}"))
    j = e.select("event_id", js.json_patch(old, js.diff_patch(old, new)).alias("j"))
    return j.select("event_id", F.get_json_object("j", "$.k").alias("k"), F.get_json_object("j", "$.a[1]").alias("v"))


@query("select event_id, cast(user_id as varchar) as a, cast(event_id as varchar) as b from events")
def json_unflatten(spark, sf_dir):
    doc = F.concat(F.lit('{"x":{"y":'), F.col("user_id").cast("string"), F.lit('},"l":[0,'), F.col("event_id").cast("string"), F.lit("]}"))
    j = _events(spark, sf_dir).select("event_id", js.unflatten(js.flatten(doc), lists=True).alias("j"))
    return j.select("event_id", F.get_json_object("j", "$.x.y").alias("a"), F.get_json_object("j", "$.l[1]").alias("b"))


# ---------------------------------------------------------------- sync
@query(GRAPH + "select doc_id, count(*)::bigint as n, count(*)::bigint as found, true as few from ch group by doc_id")
def bloom_membership(spark, sf_dir):
    """Every hash put into a document's filter is found in it, and over all filters under a twentieth of the others."""
    c = sync.with_hash(A.change_graph(spark, sf_dir))
    f = cut(sync.build_filters(c, ["doc_id"]))
    other = sync.probe(c.withColumn("hash", F.sha2(F.concat_ws("|", F.lit("other"), "doc_id", "id"), 256)), f, ["doc_id"])
    few = other.agg((F.count_if("maybe") * 20 < F.count("*")).alias("few"))
    return sync.probe(c, f, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("maybe").alias("found")).crossJoin(F.broadcast(few))


_SIDES = GRAPH + ", a as (select * from ch where actor <> 'a2'), b as (select * from ch where actor <> 'a0')\n"


def _sides(spark, sf_dir):
    g = A.change_graph(spark, sf_dir)
    return cut(g.where("actor <> 'a2'")), cut(g.where("actor <> 'a0'"))


@query(_SIDES + "select doc_id, count(*)::bigint as n, count(*)::bigint as n_b from (select doc_id, id from a union select doc_id, id from b) group by doc_id")
def sync_rounds(spark, sf_dir):
    """Messages and answers until both replicas hold the union; what a filter hides comes in a further round."""
    a, b, _ = sync.synchronise(*_sides(spark, sf_dir), cut)
    return a.groupBy("doc_id").agg(F.count("*").alias("n")).join(b.groupBy("doc_id").agg(F.count("*").alias("n_b")), "doc_id")


@query(_SIDES + """, n as (select doc_id, id from b where not exists (select 1 from a where a.doc_id = b.doc_id and a.id = b.id)
  and not exists (select 1 from deps d join b c on c.doc_id = d.doc_id and c.id = d.id where d.doc_id = b.doc_id and d.dep = b.id))
select doc_id, id from n union select d.doc_id, d.dep from deps d join a x on x.doc_id = d.doc_id and x.id = d.id
where not exists (select 1 from a y where y.doc_id = d.doc_id and y.id = d.dep)""")
def sync_needs(spark, sf_dir):
    """What a asks b for: b's heads and dependencies of its own that it lacks."""
    a, b = _sides(spark, sf_dir)
    return sync.message(a, dag.heads(b), None, cut)["need"].select("doc_id", "id")


@query(LOG + "select doc_id, count(*)::bigint as n_ops, sum(v)::bigint as sum_v from ops group by doc_id")
def save_load(spark, sf_dir):
    """The event log saved as one binary document per user and loaded again, with its operations counted."""
    back = codec.load(cut(codec.save(_log(spark, sf_dir))))
    return back.groupBy("doc_id").agg(F.count("*").alias("n_ops"), F.sum("value.i").alias("sum_v"))
