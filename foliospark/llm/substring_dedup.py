"""Removal of repeated long passages by De Bruijn compaction.

Of the k-mers in a window of ``window`` words, the one with the least hash is the window's edge.
Neighbouring windows that share an occurrence of their edge form a path: the words around it. A
window that occurs twice has the same edge k-mer at the same place both times, so only paths on
edges that occur twice matter. Equal paths compact to one by their content: all their windows
are repeated. Where paths on an edge differ, the graph branches: one occurrence of each distinct
path is read again at its source coordinates and its windows are compared one by one.

Contents are told apart by 128 bits of hash (a k-mer's and the path's, or a window's own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import discard, materialise, settled

_PLACE_BITS = 24
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
#: Words handled at once; longer texts are cut into overlapping runs.
_RUN = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _kmers(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k word hashes."""
    n = len(words) - k + 1
    total = np.zeros(max(n, 0), np.uint64)
    for i in range(k):
        total = total * _BASE + words[i : i + n]
    return _mixed(total)


def _least_of(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` neighbours."""
    held, width = values, 1
    while 2 * width <= span:
        held = np.minimum(held[:-width], held[width:])
        width *= 2
    rest = span - width
    return np.minimum(held[: len(held) - rest], held[rest:]) if rest else held


def _runs(texts: list[bytes], window: int):
    """Groups of (row, first word, words), about ``_RUN`` words each; long texts overlap by a window."""
    group, held = [], 0
    for row, text in enumerate(texts):
        words = text.split()
        for lo in range(0, max(len(words) - window + 1, 0), _RUN):
            part = words[lo : lo + _RUN + window - 1] if lo or len(words) > _RUN + window else words
            group.append((row, lo, part))
            held += len(part)
            if held >= _RUN:
                yield group
                group, held = [], 0
    if group:
        yield group


def _paths(group, window: int, k: int):
    """Columns of all paths: index in the group, first window's place, windows, edge, content."""
    sizes = np.array([len(words) for _, _, words in group])
    joined = [b" ".join(words) for _, _, words in group]
    words = [w for _, _, part in group for w in part]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(group)), sizes)
    first = np.cumsum(sizes) - sizes
    # Byte offsets within the joined text of the word's own document.
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    origin = starts[first]
    edges = _kmers(hashes, k)
    place = np.arange(len(edges), dtype=np.uint64)
    least = _least_of((edges & ~_PLACE) | place, window - k + 1) & _PLACE
    at = np.flatnonzero(owner[: len(least)] == owner[window - 1 : window - 1 + len(least)])
    edge_at = least[at].astype(np.int64)
    new = np.r_[True, (edge_at[1:] != edge_at[:-1])] if len(at) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    count = np.diff(np.r_[begin, len(at)])
    start = at[begin]
    which = owner[start]
    byte_a = starts[start] - origin[which]
    byte_b = ends[start + count - 1 + window - 1] - origin[which]
    digest = xxhash.xxh3_64_intdigest
    contents = [digest(joined[w][a:b]) for w, a, b in zip(which.tolist(), byte_a.tolist(), byte_b.tolist(), strict=True)]
    return which, start - first[which], count, edges[edge_at[begin]], np.array(contents, np.uint64)


def _find_paths(window: int, k: int):
    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            for group in _runs(texts, window):
                which, place, count, edge, content = _paths(group, window, k)
                row = np.array([r for r, _, _ in group])[which]
                lo = np.array([lo for _, lo, _ in group])[which]
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(place + lo, pa.int32()), pa.array(count, pa.int32()), pa.array(edge.view(np.int64)), pa.array(content.view(np.int64))],
                    names=["doc_id", "text_hash", "place", "windows", "edge", "content"],
                )

    return run


def _read_windows(window: int):
    """The windows of the paths (place, windows, copies) listed with a text, by 128-bit digests."""

    def run(batches):
        for batch in batches:
            rows, places, alone, high, low = [], [], [], [], []
            for row, (text, paths) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = text.split()
                for p in paths:
                    for i in range(p["place"], p["place"] + p["windows"]):
                        d = xxhash.xxh3_128_digest(b" ".join(words[i : i + window]))
                        rows.append(row)
                        places.append(i)
                        alone.append(p["alone"])
                        high.append(d[:8])
                        low.append(d[8:])
            take = pa.array(rows, pa.int64())
            digests = [pa.array(np.frombuffer(b"".join(x), np.int64)) for x in (high, low)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(places, pa.int32()), pa.array(alone, pa.bool_()), *digests], names=["doc_id", "text_hash", "place", "alone", "high", "low"])

    return run


def _remove(window: int, with_text: bool):
    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                left = words
                if spans:
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, [s["place"] for s in spans], 1)
                    np.add.at(depth, [s["place"] + s["windows"] - 1 + window for s in spans], -1)
                    stay = np.cumsum(depth[:-1]) == 0
                    left = [words[i] for i in np.flatnonzero(stay).tolist()]
                n_removed.append(len(words) - len(left))
                if with_text:
                    kept.append((text or b"").decode() if left is words and text is not None else b" ".join(left).decode())
                else:
                    kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), *batch.columns[3:]], names=["doc_id", "n_words", "n_removed", "kept", *batch.schema.names[3:]])

    return run


def repeated_spans(docs: DataFrame, window: int = 35, k: int = 12) -> DataFrame:
    """From (doc_id, text), the repeated windows as (doc_id, text_hash, place, windows): ``windows`` of
    them from word ``place`` on.

    A document is named by its id and text hash, so rows that repeat an id stay apart, and rows
    that repeat both share their spans, which may be listed once a row. Only they stay written.
    """
    return settled(lambda: _repeated_spans(docs, window, k), "repeat-spans")


def _repeated_spans(docs: DataFrame, window: int, k: int) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType
    named = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    key = [T.StructField("doc_id", id_type), T.StructField("text_hash", T.LongType())]
    schema = T.StructType([*key, T.StructField("place", T.IntegerType()), T.StructField("windows", T.IntegerType()), T.StructField("edge", T.LongType()), T.StructField("content", T.LongType())])
    paths = materialise(named.mapInArrow(_find_paths(window, k), schema), "repeat-paths")
    # Written first, so that adaptive execution can split an edge with very many paths in the join.
    edges = materialise(paths.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("edge"), "repeat-edges")
    candidates = materialise(paths.join(edges, "edge", "left_semi"), "repeat-candidates")
    discard(paths, edges)
    paths = candidates
    # One row for each distinct path, with an occurrence of it.
    contents = paths.groupBy("edge", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_hash", "place", "windows")).alias("at"))
    contents = materialise(contents, "repeat-contents")
    whole = paths.join(contents.filter("copies > 1").select("edge", "content"), ["edge", "content"], "left_semi").select("doc_id", "text_hash", "place", "windows")
    forks = contents.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("edge")
    read = contents.join(forks, "edge", "left_semi").select("at.*", (F.col("copies") == 1).alias("alone"))
    read = read.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("place", "windows", "alone")).alias("paths"))
    texts = named.filter("text IS NOT NULL")
    sources = texts.join(read.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    # Rows that repeat an id and a text would read the same occurrence twice.
    sources = sources.select("doc_id", "text_hash", "text", "paths")
    window_schema = T.StructType([*key, T.StructField("place", T.IntegerType()), T.StructField("alone", T.BooleanType()), T.StructField("high", T.LongType()), T.StructField("low", T.LongType())])
    windows = sources.mapInArrow(_read_windows(window), window_schema)
    windows = materialise(windows.distinct(), "repeat-windows")
    same = windows.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("high", "low")
    single = windows.filter("alone").join(same, ["high", "low"], "left_semi").select("doc_id", "text_hash", "place", F.lit(1).alias("windows"))
    return whole.union(single)


def remove_repeats(docs: DataFrame, window: int = 35, k: int = 12, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and kept_text (or kept_sha256).

    Every word covered by a window of ``window`` words that starts anywhere else too is removed,
    all occurrences alike. A text without removed words stays as it is in kept_text; in others
    and in the digest the kept words are joined by one space. A null text has no words (kept_text
    empty); texts shorter than a window lose nothing. Repeated rows count as occurrences of each
    other; null ids are carried along; an empty table gives an empty result. The columns named by
    ``carry`` come back in a struct ``carried``; other columns are ignored.
    """
    own = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    extra = [F.struct(*carry).alias("carried")] if carry else []
    spans = repeated_spans(docs.select(*own), window, k)
    named = docs.select(*own, *extra).withColumn("text_hash", F.xxhash64("text"))
    spans = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("place", "windows")).alias("spans")).withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    joined = named.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    kept = "kept_text" if with_text else "kept_sha256"
    schema = T.StructType([T.StructField("doc_id", named.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), *(f for f in named.schema if f.name == "carried")])
    return joined.select("doc_id", "text", "spans", *(["carried"] if carry else [])).mapInArrow(_remove(window, with_text), schema).withColumnRenamed("kept", kept)
