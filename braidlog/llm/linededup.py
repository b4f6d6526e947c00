"""Line dedup over levelled sorted runs of line hashes.

The index of seen lines is a set of runs in the shared folder. A run is a
Parquet table bucketed and sorted by a 128-bit line hash, with the number of
documents that hold the line and the ids that may still have to lose it. Each
batch of documents is merge-joined with the runs, which decides the lines it
and earlier batches lose, and adds one run at level 0; when a level has
``FANOUT`` runs they are merged to one run of the next level, so a hash is
rewritten once per level.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, work_dir

#: Runs of a level before they are merged, batches of a whole table at least, and
#: bytes of text in one batch at most.
FANOUT, BATCHES, BATCH_BYTES = 3, 4, 64 << 30
#: Lines that are joined by broadcast, at most: 24 bytes each.
HOT_LINES = 200_000
#: Keys shorter than this many code points are never dropped.
MIN_CHARS, MIN_DOCS = 20, 3
#: Fixed value: the white space stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> tuple[list[str], list[bytes | None]]:
    """A text's lines and each one's 16-byte key hash; None where the key is too short."""
    import xxhash

    lines = (text or "").split("\n")
    out = []
    for line in lines:
        key = line.strip(BLANK)
        out.append(xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None)
    return lines, out


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), ">i8").reshape(-1, 2).astype(np.int64)
    return both[:, 0], both[:, 1]


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(id, h1, h2)``: the distinct line hashes of each row; rows with a null id are left out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, keys = [], []
            for i, text in zip(b["id"], b["text"]):
                own = {k for k in line_keys(text, min_chars)[1] if k is not None}
                ids += [i] * len(own)
                keys += own
            h1, h2 = _halves(keys)
            yield pd.DataFrame({"id": np.array(ids, np.int64), "h1": h1, "h2": h2})

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "id long, h1 long, h2 long")


class LineIndex:
    """Levelled runs of line hashes below ``path``, a folder that all sessions share.

    A run is a table bucketed and sorted by hash: ``(h1, h2, n, last, first)``,
    with the number of documents of its batches that hold the line, and the
    largest and smallest id among them. ``manifest.json`` names the runs of each
    level; an index is opened again, by this or a later session, from its path.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path or work_dir(spark, "lines"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.written = 0
        self._tables: dict[str, str] = {}
        self._name = "braidlog_lines_" + uuid.uuid4().hex
        if self._fs().exists(self._at("manifest.json")):
            lines = spark.read.text(f"{self.path}/manifest.json").collect()
            kept = json.loads("".join(r[0] for r in lines))
            self.levels, self.written, self.buckets, self.fanout = kept["levels"], kept["written"], kept["buckets"], kept["fanout"]

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _save(self) -> None:
        """The manifest is written whole beside the old one and then takes its name."""
        fs, new, now = self._fs(), self._at("manifest.new"), self._at("manifest.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"levels": self.levels, "written": self.written, "buckets": self.buckets, "fanout": self.fanout}).encode()))
        out.close()
        fs.delete(now, False)
        fs.rename(new, now)

    def run(self, name: str) -> DataFrame:
        """The rows of one run, by a table that knows its buckets and their order."""
        if name not in self._tables:
            self.spark.sql(f"create table {self._name}_{name} (h1 bigint, h2 bigint, n bigint, last bigint, first bigint) using parquet "
                           f"clustered by (h1, h2) sorted by (h1, h2) into {self.buckets} buckets location '{self.path}/{name}'")
            self._tables[name] = f"{self._name}_{name}"
        return self.spark.table(self._tables[name])

    def _write(self, rows: DataFrame) -> str:
        name = f"run{self.written}"
        self.written += 1
        self._fs().delete(self._at(name), True)  # of a session that ended before its manifest was written
        (rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", f"{self.path}/{name}")
         .saveAsTable(f"{self._name}_{name}"))
        self._tables[name] = f"{self._name}_{name}"
        return name

    def _remove(self, runs: list[str]) -> None:
        for r in runs:
            if r in self._tables:
                self.spark.sql(f"drop table if exists {self._tables.pop(r)}")
            self._fs().delete(self._at(r), True)

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    @contextmanager
    def _planned(self) -> Iterator[None]:
        """While plans are made here, scans of runs give their rows in the order of the hashes.

        Unions are not taken to keep the buckets of their runs: merged so, equal
        hashes of several runs did not meet.
        """
        wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false"}
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def decided(self, new: str, min_docs: int = MIN_DOCS) -> DataFrame:
        """``(h1, h2, n, last, stale)`` of the lines of run ``new`` that ``min_docs`` documents hold by now.

        The run is merge-joined with every older one: both sides are bucketed and
        sorted, so nothing is shuffled or sorted. ``last`` is the largest holder so
        far; ``stale`` are the older holders that no earlier batch dropped and that
        this batch drops. While a line has fewer than three holders they are its
        largest and smallest, so a run tells them all.
        """
        rows = self.run(new)
        older = [r for r in self.runs() if r != new]
        for k, r in enumerate(older):
            rows = rows.join(self.run(r).toDF("h1", "h2", f"n{k}", f"last{k}", f"first{k}"), ["h1", "h2"], "left")
        at = lambda c: [F.col(f"{c}{k}") for k in range(len(older))]
        before = reduce(lambda x, y: x + y, [F.coalesce(c, F.lit(0)) for c in at("n")], F.lit(0))
        none = F.lit(None).cast("long")
        old_last = F.greatest(none, none, *at("last"))
        old_first = F.least(none, none, *at("first"))
        rows = rows.select("h1", "h2", "n", F.greatest("last", old_last).alias("top"), before.alias("before"), old_last.alias("a"), old_first.alias("b"))
        left = F.when(F.col("before") >= min_docs, F.array("a")).when(F.col("before") > 0, F.array_distinct(F.array("a", "b")))
        stale = F.filter(left, lambda x: x != F.col("top"))
        return rows.where(F.col("n") + F.col("before") >= min_docs).select("h1", "h2", "n", F.col("top").alias("last"), stale.alias("stale"))

    def add(self, hashed: DataFrame, min_docs: int = MIN_DOCS, hot_lines: int = HOT_LINES) -> DataFrame:
        """Add a batch ``(id, h1, h2)`` of ids that no other batch holds; returns what it decides, ``(id, h1, h2)`` to drop.

        The rows are those of the batch, and those of earlier batches whose line
        now has enough holders or a larger one. Over all batches, in any order, each
        line that ``min_docs`` (2 or 3) documents hold is dropped from all but the
        largest once. Counting goes over (hash, id) first, so a line that a third of
        the documents hold is counted in many tasks. Lines of over n / ``hot_lines``
        documents, of which n counted lines can have ``hot_lines`` at most, meet the
        batch by broadcast, all others by a shuffle in which no key has many rows.
        """
        if not 2 <= min_docs <= 3:
            raise ValueError("a run tells the holders of a line only while there are fewer than three")
        with self._planned():
            new = self._write(hashed.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last"), F.min("id").alias("first")))
            found = cut(self.decided(new, min_docs))
            self.levels = [[*(self.levels[0] if self.levels else []), new], *self.levels[1:]]
            self._compact()
            self._save()
        above = -(-(found.agg(F.sum("n")).first()[0] or 0) // hot_lines)
        hot = F.broadcast(found.where(F.col("n") > above).select("h1", "h2", "last"))
        rest = found.where(F.col("n") <= above).select("h1", "h2", "last")
        keys = ["h1", "h2"]
        met = hashed.join(hot, keys).unionByName(hashed.join(hot, keys, "left_anti").join(rest, keys)).where("id <> last")
        return met.select("id", *keys).unionByName(found.select(F.explode("stale").alias("id"), *keys))

    def _compact(self) -> None:
        """Runs of a full level become one of the next; the old ones go once the manifest names the new one."""
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full = self.levels[level]
            rows = reduce(DataFrame.unionByName, map(self.run, full))
            merged = self._write(rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.min("first").alias("first")))
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level], self.levels[level + 1] = [], [*self.levels[level + 1], merged]
            self._save()
            self._remove(full)
            level += 1

    def remove(self) -> None:
        """Delete all runs."""
        self._remove(self.runs())
        self.levels = []
        self._save()


def without_lines(docs: DataFrame, drop: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``__lines``, a struct ``(kept string, n_lines long, n_dropped long)``; null texts become empty.

    ``drop`` is ``(id, drop array<binary>)``, an id once.
    """
    @F.pandas_udf("kept string, n_lines long, n_dropped long")
    def run(texts: pd.Series, drop: pd.Series) -> pd.DataFrame:
        kept, n, m = [], [], []
        for text, gone in zip(texts, drop):
            if gone is None:
                kept.append(text)
                n.append(text.count("\n") + 1)
                m.append(0)
                continue
            lines, keys = line_keys(text, min_chars)
            gone = {bytes(x) for x in gone}
            left = [x for x, k in zip(lines, keys) if k is None or k not in gone]
            kept.append("\n".join(left))
            n.append(len(lines))
            m.append(len(lines) - len(left))
        return pd.DataFrame({"kept": kept, "n_lines": n, "n_dropped": m})

    run = run.asNondeterministic()  # else Spark copies it into a filter above, and each task splits all texts again in a second worker
    gone = drop.select(F.col("id").alias("__id"), F.col("drop").alias("__drop"))
    met = docs.join(gone, F.col(id_col).cast("long") == F.col("__id"), "left")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return met.withColumn("__lines", run(text, F.col("__drop"))).drop("__id", "__drop")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | None = None, min_docs: int = MIN_DOCS,
            min_chars: int = MIN_CHARS, fanout: int = FANOUT, hot_lines: int = HOT_LINES) -> DataFrame:
    """``docs``, all columns kept, with ``__lines`` (see ``without_lines``): texts without the lines that repeat across documents.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased.
    Keys of ``min_chars`` code points or more that ``min_docs`` documents hold
    lose all their lines except in the largest id holding it. Documents with
    the same id count once; rows with a null id lose nothing; a null or empty
    text is one empty line. Line hashes are written once, dealt to batches by id;
    each batch is merge-joined with the index's runs, writes what that decides
    and adds its own run. By default there are ``BATCHES`` batches, more where
    they would exceed ``BATCH_BYTES`` of text.
    """
    spark = docs.sparkSession
    if batches is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        batches = max(BATCHES, -(-size // BATCH_BYTES))
    index = LineIndex(spark, fanout=fanout)
    at = f"{index.path}/hashed"
    hashed_lines(docs, id_col, text_col, min_chars).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(at)
    hashed = spark.read.schema("id long, h1 long, h2 long, batch int").parquet(at)
    for k in range(batches):
        index.add(hashed.where(F.col("batch") == k).select("id", "h1", "h2"), min_docs, hot_lines).write.parquet(f"{index.path}/drop/batch={k}")
    index.remove()
    index._fs().delete(index._at("hashed"), True)
    both = F.concat(F.unhex(F.lpad(F.hex("h1"), 16, "0")), F.unhex(F.lpad(F.hex("h2"), 16, "0")))
    drop = spark.read.schema("id long, h1 long, h2 long").parquet(f"{index.path}/drop").groupBy("id").agg(F.collect_set(both).alias("drop"))
    return without_lines(docs, drop, id_col, text_col, min_chars)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id_col, kept, n_lines, n_dropped)``, one row per row; ``options`` are those of ``cleaned``."""
    return cleaned(docs, id_col, text_col, **options).select(id_col, "__lines.kept", "__lines.n_lines", "__lines.n_dropped")


#: The same digests in DuckDB.
SQL = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n
  from documents),
k as (select *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
j as (select k.*, (r.key is not null and k.doc_id <> r.last) as gone from k left join r on k.key = r.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by n) filter (where not gone), '')) as kept_sha256
from j group by doc_id
"""
