"""Packing token sequences into fixed-size bins, as few as possible.

Only the lengths matter, and there are at most ``capacity`` different ones, so the packing is
planned exactly for any number of documents from one count per length. Pieces above a third of
the capacity share a bin with at most one other such piece and are matched greedily, longest
first. The shorter ones then best-fit the gaps, longest first. The plan speaks of ranges of bins
and of ranges of ranks within a length; every piece finds its own place by its rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import materialise
from foliospark.llm.merges import WordMerges
from foliospark.llm.tokenise import ChunkEncoder

_RANK_BITS = 50


@dataclass(frozen=True)
class Placement:
    """Pieces of ``length`` with ranks from ``rank`` on: ``per_bin`` to a bin from ``first_bin`` on, at ``offset``."""

    length: int
    rank: int
    count: int
    per_bin: int
    first_bin: int
    offset: int


def plan_packing(counts: dict[int, int], capacity: int) -> tuple[list[Placement], int]:
    """Placements for ``counts[length]`` pieces of every length, and the number of bins."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    used, plan, bins = [0] * (capacity + 1), [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first bin, bins)

    def place(length: int, count: int, per_bin: int, first_bin: int, offset: int) -> None:
        plan.append(Placement(length, used[length], count, per_bin, first_bin, offset))
        used[length] += count
        left[length] -= count

    third = capacity // 3
    for a in range(capacity, third, -1):
        while left[a]:
            b = next((b for b in range(min(a, capacity - a), third, -1) if left[b] > (b == a)), 0)
            n = left[a] // 2 if b == a else min(left[a], left[b]) if b else left[a]
            place(a, n, 1, bins, 0)
            if b:
                place(b, n, 1, bins, a)
            gaps[capacity - a - b].append((bins, n))
            bins += n
    for s in range(third, 0, -1):
        gap = s
        while left[s]:
            while gap < capacity and not gaps.get(gap):
                gap += 1
            if not gaps.get(gap):
                per_bin = capacity // s
                n = -(-left[s] // per_bin)
                gaps[capacity].append((bins, n))
                bins += n
                gap = capacity
            first, n = gaps[gap].pop()
            per_bin = gap // s
            full = min(n, left[s] // per_bin)
            if full:
                place(s, full * per_bin, per_bin, first, capacity - gap)
                gaps[gap - per_bin * s].append((first, full))
            if full < n:
                rest = min(left[s], per_bin)
                if rest:
                    place(s, rest, rest, first + full, capacity - gap)
                    gaps[gap - rest * s].append((first + full, 1))
                if n - full - bool(rest):
                    gaps[gap].append((first + full + bool(rest), n - full - bool(rest)))
    return plan, bins


_encoders: dict[str, ChunkEncoder] = {}


def encoder_of(path: str) -> ChunkEncoder:
    """The worker's chunk cache for a vocabulary file of the ``tokenizers`` library.

    Plain words are merged many at once, as the library would; other chunks go through the
    library's whole tokenizer in one call, a special token between them keeping them apart.
    """
    if path not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        specials = {str(t): i for i, t in tokenizer.get_added_tokens_decoder().items()}
        mark, mark_id = next(iter(specials.items()), ("", -1))
        def whole(chunks: list[str]) -> list[bytes]:
            return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

        def between(chunks: list[str]) -> list[bytes]:
            ids = np.array(tokenizer.encode_batch_fast([mark.join(chunks)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == mark_id).tolist()
            data = ids.tobytes()
            return [data[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True)]

        def encode_many(chunks: list[str]) -> list[bytes]:
            found: list[bytes] = [b""] * len(chunks)
            for apart, encode in ((True, between), (False, whole)):
                some = [k for k, c in enumerate(chunks) if apart == bool(mark and mark not in c)]
                for k, ids in zip(some, encode([chunks[k] for k in some]) if some else (), strict=True):
                    found[k] = ids
            return found

        _encoders[path] = ChunkEncoder(encode_many, WordMerges.of(tokenizer.to_str()))
    return _encoders[path]


def _pieces(path: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, ranks, part = encoder_of(path), [0] * (capacity + 1), TaskContext.get().partitionId()
        for batch in batches:
            rows, piece, start, length, crc, rank = [], [], [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for row, ids in enumerate(encoder.encode(texts)):
                ids += end
                n = len(ids) // 4
                at, number = 0, 0
                while at < n:
                    size = (n % capacity or capacity) if at == 0 else capacity
                    rows.append(row)
                    piece.append(number)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    rank.append(ranks[size])
                    ranks[size] += 1
                    at, number = at + size, number + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(rows), pa.int64()), pa.array(rank, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "in_part"],
            )

    return run


def _assign(keys: np.ndarray, table: np.ndarray):
    def run(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(n))) for n in ("length", "rank"))
            k = np.searchsorted(keys, (length << _RANK_BITS) | rank, side="right") - 1
            _, first_rank, _, per_bin, first_bin, offset = table[k].T if len(k) else np.zeros((6, 0), np.int64)
            within = rank - first_rank
            sequence, place = first_bin + within // np.maximum(per_bin, 1), offset + within % np.maximum(per_bin, 1) * length
            kept = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(place, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end_id``; a null text counts as empty and is ``end_id``
    alone. Documents over ``capacity`` are cut into full pieces behind a first one that may be
    shorter. Every row is packed, so a repeated id has its pieces twice and a null id is carried
    along. An empty table gives an empty result; other columns are ignored.

    The driver gets one count per length (``capacity`` at most) and sends back the plan, whose
    size depends on ``capacity`` only.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "part", "in_part"))])
    pieces = materialise(docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(_pieces(tokenizer_path, end_id, capacity), schema), "pack-pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = plan_packing(counts, capacity)
    rows = sorted((p.length, p.rank, p.count, p.per_bin, p.first_bin, p.offset) for p in plan)
    table = np.array(rows, np.int64).reshape(-1, 6)
    keys = (table[:, 0] << _RANK_BITS) | table[:, 1]
    up_to = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = per_part.select("length", "part", (F.sum("n").over(up_to) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("in_part")).alias("rank"))
    out = T.StructType([*schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_assign(keys, table), out)
