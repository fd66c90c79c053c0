"""Byte-level BPE encoding and decoding by corpus-level merge replay.

All distinct words of a batch lie in one array of tokens. An inverted index leads from a merge's
rank to the positions where its pair stands. Merges are applied to all words at once in rank
order, and each touches only the two neighbours of the positions that it changes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliospark.llm.tokenise import ChunkEncoder


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class MergeReplay:
    """Encodes byte strings under ranks as tiktoken does: a whole token is itself, else lowest rank first, leftmost first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}  # bounded: ranks are few and only adjacent tokens are asked for

    def pair_rank(self, a: int, b: int) -> int:
        """The rank of the token that a and b make, or -1; negative tokens make none."""
        rank = self.pairs.get((a, b))
        if rank is None:
            rank = self.ranks.get(self.token[a] + self.token[b], -1) if a >= 0 and b >= 0 else -1
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            self.pairs[a, b] = rank
        return rank

    def one(self, word: bytes) -> list[int]:
        """The same for one word by rescanning, for the rare words whose merges lower a rank."""
        ids = [self.byte[b] for b in word]
        while True:
            best, at = min(((r, i) for i, r in enumerate(map(self.pair_rank, ids, ids[1:])) if r >= 0), default=(-1, -1))
            if at < 0:
                return ids
            ids[at : at + 2] = [best]

    def encode(self, words: Sequence[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = [[r] if (r := self.ranks.get(w)) is not None else None for w in words]
        todo = [i for i, ids in enumerate(out) if ids is None]
        token: list[int] = []
        starts: list[int] = []
        for i in todo:
            starts.append(len(token))
            token += [self.byte[b] for b in words[i]]
            token.append(-1)  # between words
        n = len(token)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        pair_rank, known = self.pair_rank, self.pairs.get  # most pairs are known: a look-up is cheaper than a call
        for p, pair in enumerate(zip(token, token[1:])):
            if (r := known(pair)) is None:
                r = pair_rank(*pair)
            if r >= 0:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
        queue = list(index)
        heapq.heapify(queue)
        again: set[int] = set()
        while queue:
            rank = heapq.heappop(queue)
            for p in sorted(index.pop(rank)):
                a = token[p]
                if a < 0:
                    continue
                q = following[p]
                pair = a, token[q]
                if (r := known(pair)) is None:
                    r = pair_rank(*pair)
                if r != rank:
                    continue  # changed since it was entered
                token[p], token[q] = rank, -2
                after = following[p] = following[q]
                before[after] = p
                left = before[p]
                for x, y in ((left, p), (p, after)):
                    if x < 0:
                        continue
                    pair = token[x], token[y]
                    if (r := known(pair)) is None:
                        r = pair_rank(*pair)
                    if r >= 0:
                        if r <= rank:
                            again.add(bisect_right(starts, p) - 1)
                        elif r in index:
                            index[r].append(x)
                        else:
                            index[r] = [x]
                            heapq.heappush(queue, r)
        for k, i in enumerate(todo):
            end = starts[k + 1] if k + 1 < len(starts) else n
            out[i] = self.one(words[i]) if k in again else [t for t in token[starts[k] : end] if t >= 0]
        return out  # type: ignore[return-value]


_replays: dict[tuple[str, str], tuple[MergeReplay, ChunkEncoder]] = {}


def replay_of(path: str, pattern: str) -> tuple[MergeReplay, ChunkEncoder]:
    """The worker's encoder for a rank file and a splitting pattern."""
    if (path, pattern) not in _replays:
        replay = MergeReplay(load_ranks(path))
        find = regex.compile(pattern).findall

        def encode_many(chunks: list[str]) -> list[bytes]:
            split = [[w.encode() for w in find(c)] for c in chunks]
            words = list({w for ws in split for w in ws})
            ids = dict(zip(words, (np.array(x, "<u4").tobytes() for x in replay.encode(words)), strict=True))
            return [b"".join([ids[w] for w in ws]) for ws in split]

        _replays[path, pattern] = replay, ChunkEncoder(encode_many)
    return _replays[path, pattern]


def decode(replay: MergeReplay, ids: bytes) -> bytes:
    return b"".join(map(replay.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _digest(path: str, pattern: str):
    def run(batches):
        replay, encoder = replay_of(path, pattern)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for ids in encoder.encode([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decode(replay, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode(path: str, pattern: str):
    def run(batches):
        _, encoder = replay_of(path, pattern)
        for batch in batches:
            found = [np.frombuffer(ids, "<u4").astype(np.int32) for ids in encoder.encode([t or "" for t in batch.column(1).to_pylist()])]
            ends = np.cumsum([0, *map(len, found)])
            values = pa.array(np.concatenate([np.empty(0, np.int32), *found]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        replay = MergeReplay(load_ranks(path))
        for batch in batches:
            texts = [b"".join(map(replay.token.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "data"])

    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null texts count as empty and have no ids.

    Narrow: no shuffle, one batch of texts in memory at a time. Repeated rows, null ids and
    empty tables pass through as they are; other columns are ignored.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(id_col, text_col).mapInArrow(_encode(ranks_path, pattern), schema)


def decode_documents(ids: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, data binary) from the rows of ``encode_documents``; null ids arrays decode to no bytes."""
    schema = T.StructType([T.StructField("doc_id", ids.schema["doc_id"].dataType), T.StructField("data", T.BinaryType())])
    return ids.select("doc_id", "ids").mapInArrow(_decode(ranks_path), schema)


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids.

    Nulls, repeated rows, empty tables and other columns as in ``encode_documents``.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(id_col, text_col).mapInArrow(_digest(ranks_path, pattern), schema)
