from braidlog.operators import state
from braidlog.schema import OPS
from braidlog.sources.adapters import map_log
from braidlog.streaming.ingest import ingest, read_log


def test_stream_equals_batch(spark, tmp_path):
    ops = map_log(spark, "/root/testdata/sf0.001").drop("event_id")
    late, early = ops.where("op.counter % 3 = 0"), ops.where("op.counter % 3 <> 0 or op.counter % 6 = 0")
    for k, part in enumerate((early, late)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(OPS).parquet(str(tmp_path / "in"))
        ingest(stream, str(tmp_path / "log"), str(tmp_path / "cp"), once=True).awaitTermination()
    key = lambda df: sorted((r.doc_id, r.key_str, r.op.counter, r.op.actor) for r in state.winners(state.entries(df)).collect())
    assert key(read_log(spark, str(tmp_path / "log"))) == key(ops)
