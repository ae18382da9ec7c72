"""Token counts of whole texts as the library gives them, huge documents in overlapping chunks (operator 3).

Ordinary documents are encoded whole. A document longer than ``chunk_chars`` becomes chunks that overlap
by ``overlap_chars``, dealt over the cluster and encoded with offsets. Two neighbours are spliced at a
token boundary that both have and that is proven stable: a place between two characters that stand side
by side in no piece of the vocabulary. Merging only ever joins neighbours into a piece of the vocabulary,
so no merge of the whole text crosses such a place, and what a chunk's own edge disturbs ends there. If
two chunks share no such place, the document is cut anew with chunks and overlaps eight times as long, at
last whole; so the count never depends on the cut.

Null and empty texts have no tokens. Repeated rows each get their row. An empty table gives none. Other columns are ignored,
whatever their names; rows with one doc_id are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.runtime import materialize

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 11
WIDEN = 8


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def inner_pairs(path: str) -> frozenset[str]:
    """All pairs of neighbouring characters inside the model's pieces."""
    model = processor(path)
    return frozenset(piece[i : i + 2] for piece in map(model.id_to_piece, range(model.get_piece_size())) for i in range(len(piece) - 1))


def stable_boundaries(text: str, pieces, lo: int, hi: int, pairs: frozenset[str]) -> list[tuple[int, int]]:
    """Places (in characters) in [lo, hi) where a piece starts that no piece of the vocabulary could span, with the pieces before each."""
    begins = np.array([p.begin for p in pieces], dtype=np.int64)  # in bytes of UTF-8
    ends = np.array([p.end for p in pieces], dtype=np.int64)
    at_byte = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text]))) if not text.isascii() else np.arange(len(text) + 1)
    # bytes of one character are several pieces, some of no width: no boundary there
    clean = np.flatnonzero((begins[1:] == ends[:-1]) & (ends[:-1] > begins[:-1]) & (ends[1:] > begins[1:])) + 1
    chars = np.searchsorted(at_byte, begins[clean])
    there = (chars >= max(lo, 1)) & (chars < min(hi, len(text))) & (at_byte[np.minimum(chars, len(text))] == begins[clean])
    shown = text.replace(" ", "▁")
    return [(c, n) for c, n in zip(chars[there].tolist(), clean[there].tolist()) if shown[c - 1 : c + 1] not in pairs]


def _count_whole(df: DataFrame, model_path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = processor(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                counts = [len(ids) for ids in model.encode([t or "" for t in some.column("text").to_pylist()], num_threads=1)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return df.select("doc_id", "n_bytes", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def _chunk_rows(long_docs: DataFrame, model_path: str, chunk: int, overlap: int) -> DataFrame:
    """Per chunk: token count and the stable boundaries (place in the document, tokens before it) near both ends."""
    cut = long_docs.withColumn("own", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)))
    chunks = cut.select("uid", "doc_id", "n_bytes", F.size("own").alias("n_chunks"), "own", F.posexplode("own").alias("chunk", "piece"))
    chunks = chunks.select("uid", "doc_id", "n_bytes", "n_chunks", "chunk", F.concat("piece", F.substring(F.coalesce(F.get("own", F.col("chunk") + 1), F.lit("")), 1, overlap)).alias("text"))
    spread = chunks.repartition("uid", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pairs = processor(model_path), inner_pairs(model_path)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                text, start = row["text"], row["chunk"] * chunk
                pieces = model.encode(text, return_type="proto").pieces
                out = {k: row[k] for k in ("uid", "doc_id", "n_bytes", "n_chunks", "chunk")} | {"n": len(pieces)}
                for side, lo, hi in (("head", 0, overlap), ("tail", chunk, len(text))):
                    found = stable_boundaries(text, pieces, lo, hi, pairs)
                    out[f"{side}_at"] = [start + c for c, _ in found]
                    out[f"{side}_n"] = [n for _, n in found]
                yield pa.RecordBatch.from_pylist([out], schema=_CHUNK_ARROW)

    return spread.mapInArrow(run, _CHUNK)


_CHUNK = "uid long, doc_id long, n_bytes long, n_chunks int, chunk int, n long, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>"
_CHUNK_ARROW = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_chunks", pa.int32()), ("chunk", pa.int32()), ("n", pa.int64()), *((k, pa.list_(pa.int64())) for k in ("head_at", "head_n", "tail_at", "tail_n"))])


def _spliced(chunks: DataFrame) -> DataFrame:
    """Per document: the count, or null if some pair of neighbours shares no stable boundary."""
    order = Window.partitionBy("uid").orderBy("chunk")
    pairs = chunks.withColumn("next_at", F.lead("head_at").over(order)).withColumn("next_n", F.lead("head_n").over(order))
    pairs = pairs.withColumn("splice", F.get(F.array_intersect("tail_at", "next_at"), F.lit(0)))
    before = lambda at, n: F.get(n, F.array_position(at, F.col("splice")).cast("int") - 1)
    last = F.col("chunk") == F.col("n_chunks") - 1
    # a chunk gives its tokens up to the splice; what its successor has before it goes
    part = F.when(last, F.col("n")).otherwise(before(F.col("tail_at"), F.col("tail_n")) - before(F.col("next_at"), F.col("next_n")))
    return pairs.withColumn("part", part).groupBy("uid", "doc_id", "n_bytes").agg(F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("n_tokens"))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    if overlap_chars > chunk_chars:
        raise ValueError("the overlap is longer than the chunk")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    is_long = F.length("text") > chunk_chars
    result = _count_whole(rows.filter(~is_long), model_path)
    pending = materialize(rows.filter(is_long).withColumn("uid", F.monotonically_increasing_id()), "long-documents")
    chunk, overlap = chunk_chars, overlap_chars
    while not pending.isEmpty():
        whole = F.length("text") <= chunk
        done = _count_whole(pending.filter(whole), model_path)
        spliced = materialize(_spliced(_chunk_rows(pending.filter(~whole), model_path, chunk, overlap)), "spliced")
        result = result.unionByName(done).unionByName(spliced.filter("n_tokens is not null").drop("uid"))
        failed = spliced.filter("n_tokens is null").select("uid")
        pending = materialize(pending.join(failed, "uid", "left_semi"), "widened")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
    return result.withColumn("over_limit", F.col("n_tokens") > limit)
