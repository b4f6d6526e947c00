"""Byte-level BPE encoding and decoding of whole texts.

Method: overlapping chunk encoding. A long text is cut into chunks that
overlap; the chunks are pre-tokenised in parallel, each from its own start.
The split pattern looks only forward, so two neighbours that share one
pre-token boundary agree on every later one: the first boundary that both see
in their overlap is where they are stitched. The pieces between the stitching
points are encoded by merge ranks. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points of one chunk, and of the overlap on either side of a cut.
CHUNK, OVERLAP = 32768, 2048
#: Distinct pieces whose ids a worker remembers; it forgets them when a task ends.
MEMO = 60_000


@lru_cache(maxsize=2)
def _model(path: str, pattern: str):
    import regex
    import tiktoken

    ranks: dict[bytes, int] = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    whole = tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    return {"split": regex.compile(pattern), "piece": whole, "memo": {},
            "bytes": {r: t for t, r in ranks.items()}}


def _encode_pieces(model: dict, pieces: list[str]) -> np.ndarray:
    memo, out = model["memo"], []
    add = out.extend
    for p in pieces:
        ids = memo.get(p)
        if ids is None:
            ids = tuple(model["piece"].encode_ordinary(p))
            if len(memo) >= MEMO:
                memo.clear()
            if len(p) <= 64:
                memo[p] = ids
        add(ids)
    return np.array(out, dtype=np.int32)


def trusted_ends(pieces: list[str], start: int, n_text: int) -> list[tuple[int, int]]:
    """``(boundary, pieces before it)`` where a cut-off text splits as the whole one.

    A piece that ends before the cut, and of whose start at least three code
    points are visible (the longest fixed alternative of the pattern), is
    matched as in the whole text.
    """
    out, at = [], 0
    for k, p in enumerate(pieces, 1):
        begun, at = at, at + len(p)
        if at < n_text and begun <= n_text - 3:
            out.append((start + at, k))
    return out


def _ids_digest(ids: np.ndarray) -> str:
    return hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest()


def _decoded(model: dict, ids: np.ndarray) -> bytes:
    return b"".join(map(model["bytes"].__getitem__, ids.tolist()))


def _with_digests(rows: pd.DataFrame, model: dict) -> pd.DataFrame:
    return rows.assign(ids_sha256=[_ids_digest(x) for x in rows["ids"]],
                       decoded_sha256=[hashlib.sha256(_decoded(model, x)).hexdigest() for x in rows["ids"]])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP, digest: bool = False) -> DataFrame:
    """``(id_col, ids array<int>, n_tokens long)``, one row per row of ``docs``.

    A null text counts as empty and an empty text has no tokens. Repeated rows
    give repeated results; a null id is kept. Other columns of ``docs`` are not
    read. A text in which neighbours share no boundary within the overlap (one
    endless word) is put together again and split as a whole.

    Texts of one chunk are encoded where they are read. Only chunks of longer
    texts are shuffled, and a group holds the chunks of one text. ``digest`` adds
    ``ids_sha256`` and ``decoded_sha256``, those of ``digests``: the worker that
    encoded a text decodes its ids, so a task needs no second worker for that.
    """
    if not 0 < 2 * overlap <= chunk:
        raise ValueError("the overlap must be positive and at most half a chunk")
    kind = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    done = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())),
                         T.StructField("n_tokens", T.LongType()),
                         *(T.StructField(x, T.StringType()) for x in ("ids_sha256", "decoded_sha256") if digest)])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(path, pattern)
        for b in batches:
            ids = [_encode_pieces(model, model["split"].findall(t)) for t in b["text"]]
            out = pd.DataFrame({"id": b["id"], "ids": ids, "n_tokens": [len(x) for x in ids]})
            yield _with_digests(out, model) if digest else out
        model["memo"].clear()

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pre-tokenise and encode one chunk; tell its boundaries in both overlaps."""
        model = _model(path, pattern)
        for b in batches:
            rows = []
            for sha, no, n, begin, text in zip(b["sha"], b["no"], b["n"], b["begin"], b["text"]):
                pieces = model["split"].findall(text)
                ids = [_encode_pieces(model, [p]) for p in pieces]
                before = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                last = no == n - 1
                ends = trusted_ends(pieces, begin, len(text)) if not last else None
                if last:
                    at = begin + np.cumsum([len(p) for p in pieces])
                    ends = [(int(x), k) for k, x in enumerate(at, 1)]
                head = [(x, before[k]) for x, k in ([(begin, 0), *ends] if no else []) if x <= no * chunk + overlap]
                tail = [(x, before[k]) for x, k in ends if x >= (no + 1) * chunk - overlap] if not last else []
                own = text[no * chunk - begin:(no + 1) * chunk - begin]
                rows.append((sha, no, n, np.array([x for x, _ in head], "i8"), np.array([k for _, k in head], "i8"),
                             np.array([x for x, _ in tail], "i8"), np.array([k for _, k in tail], "i8"),
                             np.concatenate(ids) if ids else np.empty(0, "i4"), own))
            yield pd.DataFrame(rows, columns=["sha", "no", "n", "head", "head_at", "tail", "tail_at", "ids", "own"]
                               ).assign(id=b["id"].to_numpy())[["id", "sha", "no", "n", "head", "head_at", "tail", "tail_at", "ids", "own"]]

    def stitch(g: pd.DataFrame) -> pd.DataFrame:
        copies = int((g["no"] == 0).sum())
        c = g.drop_duplicates("no").sort_values("no")
        rows = list(c.itertuples(index=False))
        begin, end = [0], []
        for a, b in zip(rows, rows[1:]):
            common, i, j = np.intersect1d(a.tail, b.head, return_indices=True)
            if not len(common):
                model = _model(path, pattern)
                ids = _encode_pieces(model, model["split"].findall("".join(c["own"])))
                break
            end.append(int(a.tail_at[i[0]]))
            begin.append(int(b.head_at[j[0]]))
        else:
            end.append(len(rows[-1].ids))
            ids = np.concatenate([r.ids[x:y] for r, x, y in zip(rows, begin, end)]).astype(np.int32)
        out = pd.DataFrame({"id": [g["id"].iloc[0]] * copies, "ids": [ids] * copies, "n_tokens": [len(ids)] * copies})
        return _with_digests(out, _model(path, pattern)) if digest else out

    short = src.where(F.char_length("text") <= chunk).mapInPandas(whole, done)
    n = F.ceil(F.char_length("text") / F.lit(chunk)).cast("int")
    begin = F.greatest(F.col("no") * chunk - overlap, F.lit(0))
    chunks = (src.where(F.char_length("text") > chunk)
              .select("id", "text", F.sha2("text", 256).alias("sha"), n.alias("n"))
              .select("id", "sha", "n", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("no"))
              .select("id", "sha", "n", "no", begin.alias("begin"),
                      F.expr(f"substring(text, greatest(no * {chunk} - {overlap}, 0) + 1, "
                             f"{chunk + overlap} + least(no * {chunk}, {overlap}))").alias("text")))
    parts = T.StructType([T.StructField("id", kind), T.StructField("sha", T.StringType()), T.StructField("no", T.IntegerType()),
                          T.StructField("n", T.IntegerType()),
                          *(T.StructField(x, T.ArrayType(T.LongType())) for x in ("head", "head_at", "tail", "tail_at")),
                          T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("own", T.StringType())])
    # the id is null-safe inside a grouping key
    long = chunks.mapInPandas(part, parts).groupBy("id", "sha").applyInPandas(stitch, done)
    return short.unionByName(long).withColumnRenamed("id", id_col)


def decoder(path: str, pattern: str):
    """A column function from an array of token ids to the text's bytes.

    Null gives null and no ids give no bytes; an id that is not in the ranks is
    an error.
    """

    @F.pandas_udf(T.BinaryType())
    def decode(ids: pd.Series) -> pd.Series:
        model = _model(path, pattern)
        return ids.map(lambda x: None if x is None else _decoded(model, x))

    return decode


@F.pandas_udf(T.StringType())
def ids_sha256(ids: pd.Series) -> pd.Series:
    """Lower-case hex SHA-256 of ids as little-endian unsigned 32-bit integers."""
    return ids.map(lambda x: None if x is None else _ids_digest(x))


def digests(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """``encoded`` rows as ``id_col, n_tokens, ids_sha256, decoded_sha256``."""
    decoded: Column = decoder(path, pattern)(F.col("ids"))
    return encoded.select(id_col, "n_tokens", ids_sha256("ids").alias("ids_sha256"),
                          F.sha2(decoded, 256).alias("decoded_sha256"))
