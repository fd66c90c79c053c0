"""Whole texts to token ids through their distinct chunks, exact for byte-level BPE.

The usual splitting pattern never matches across the place where white space follows a character
that is none. Texts are cut there and the chunks of a group of texts are told apart in C; each
distinct one is encoded once, and the group's ids are gathered from those of its distinct chunks.
Words of Latin letters may go to a ``WordMerges`` many at once; what else is encoded is remembered
between groups in two bounded generations.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliospark.llm.merges import WordMerges

#: Unicode's White_Space but for the space and the line feed.
_RARE = "\t\x0b-\r\x85\xa0  -     　"
_RARE_LIST = [chr(c) for c in (*range(9, 10), *range(11, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_CHUNK = re.compile(f"[ \n{_RARE}]*[^ \n{_RARE}]+|[ \n{_RARE}]+")
#: Between chunks; a text that holds it is handled by itself.
_CUT = "\x01"

#: A word of these, behind a space or not, is one match of the splitting pattern.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARKS = ".,;:!?*%&$#"
#: Where marks may be cut off: behind a letter or digit, or where nothing is before them.
_WORD_END = f"[0-9{LETTERS}]$|^$"
_WORD = f"^ ?[{LETTERS}]+$"
#: Bytes of the longest word that is merged with others; work on one grows with the square of its length.
_LONGEST_WORD = 64


def plain(text: str) -> bool:
    """Single spaces and line feeds are the only white space, so replacing them cuts the chunks."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in _RARE_LIST))


def cut_chunks(text: str) -> str:
    """The text with ``_CUT`` between its chunks; a single line feed is a chunk of its own."""
    if plain(text):
        return text.replace("\n", "\x01\n\x01").replace(" ", "\x01 ")
    return _CUT.join(_CHUNK.findall(text))


def _segments(texts: list[str], size: int) -> Iterator[tuple[int, str]]:
    """(text, part of it with its chunks cut), parts of about ``size`` characters."""
    for k, text in enumerate(texts):
        cut = cut_chunks(text)
        at = 0
        while len(cut) - at > size and (end := cut.find(_CUT, at + size)) >= 0:
            yield k, cut[at:end]
            at = end + 1
        yield k, cut[at:]


class ChunkEncoder:
    """``encode_many`` gives each chunk's ids as little-endian unsigned 32-bit integers.

    ``words``, if given, gives the same ids of words. ``limit`` bounds a generation of remembered
    chunks, ``longest`` the characters of one, and ``size`` those of texts worked on at once.
    """

    def __init__(self, encode_many: Callable[[list[str]], Sequence[bytes]], words: WordMerges | None = None, limit: int = 200_000, longest: int = 64, size: int = 1 << 22):
        self.encode_many, self.words, self.limit, self.longest, self.size = encode_many, words, limit, longest, size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text in turn."""
        held: list[tuple[int, str]] = []
        parts: dict[int, list[bytes]] = {}
        done, total = 0, 0
        for k, segment in self._all_segments(texts, parts):
            held.append((k, segment))
            total += len(segment)
            if total >= self.size:
                self._group(held, parts)
                for j in range(done, k):  # the last text may go on
                    yield b"".join(parts.pop(j))
                held, done, total = [], k, 0
        self._group(held, parts)
        for j in range(done, len(texts)):
            yield b"".join(parts.pop(j))

    def _all_segments(self, texts: list[str], parts: dict[int, list[bytes]]) -> Iterator[tuple[int, str]]:
        odd = {k for k, t in enumerate(texts) if _CUT in t}
        for k in odd:
            texts[k], chunks = "", _CHUNK.findall(texts[k])
            parts[k] = [b"".join(self.encode_many(chunks))]
        for k, segment in _segments(texts, self.size):
            yield k, segment

    def _group(self, held: list[tuple[int, str]], parts: dict[int, list[bytes]]) -> None:
        if not held:
            return
        lists = pc.split_pattern(pa.array([s for _, s in held], pa.large_string()), _CUT)
        coded = lists.flatten().dictionary_encode()
        ids, ends = gather(*self._distinct(coded.dictionary), coded.indices.to_numpy())
        bounds = np.r_[0, ends][lists.offsets.to_numpy()].tolist()
        for (k, _), a, b in zip(held, bounds, bounds[1:], strict=False):
            parts.setdefault(k, []).append(ids[a:b].tobytes())

    def _distinct(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where each chunk's start in it and how many they are. Marks behind a word match apart from it."""
        core = pc.utf8_rtrim(chunks, characters=_MARKS)
        core = pc.if_else(pc.match_substring_regex(core, _WORD_END), core, chunks)
        data, starts, sizes = _bytes(chunks)
        word_sizes = _bytes(core)[2]
        tails = _strings(data, starts + word_sizes, sizes - word_sizes)
        both = pa.concat_arrays([core, tails]).dictionary_encode()
        codes = both.indices.to_numpy()
        ids, ends = gather(*self._look_up(both.dictionary), np.stack([codes[: len(chunks)], codes[len(chunks) :]], axis=1).ravel())
        ends = ends[1::2]
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        return ids, starts, ends - starts

    def _look_up(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, starts, sizes = _bytes(chunks)
        is_word = np.zeros(len(chunks), bool)
        words, counts = np.empty(0, np.uint32), np.zeros(len(chunks), np.int64)
        if self.words:
            is_word = pc.match_substring_regex(chunks, _WORD).to_numpy(zero_copy_only=False) & (sizes <= _LONGEST_WORD)
            spelt, _ = gather(data, starts, sizes, np.flatnonzero(is_word))
            words, counts[is_word] = self.words.encode(spelt, sizes[is_word])
        rest = self._remembered(chunks.filter(pa.array(~is_word)).to_pylist())
        counts[~is_word] = np.fromiter(map(len, rest), np.int64, len(rest)) // 4
        pool = np.concatenate([words, np.frombuffer(b"".join(rest), "<u4")])
        first = np.empty(len(chunks), np.int64)
        order = np.argsort(~is_word, kind="stable")
        first[order] = np.cumsum(counts[order]) - counts[order]
        return pool, first, counts

    def _remembered(self, chunks: list[str]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # many small objects and no cycles
        try:
            found = list(map(self.young.get, chunks))
            missing = [k for k, ids in enumerate(found) if ids is None]
            for k, ids in zip(missing, map(self.old.get, [chunks[k] for k in missing]), strict=True):
                found[k] = ids
            missing, aged = [k for k in missing if found[k] is None], [k for k in missing if found[k] is not None]
            for k, ids in zip(missing, self.encode_many([chunks[k] for k in missing]), strict=True):
                found[k] = ids
            if len(self.young) > self.limit:
                self.old, self.young = self.young, {}
            self.young.update((chunks[k], found[k]) for k in (*aged, *missing) if len(chunks[k]) <= self.longest)
            return found  # type: ignore[return-value]
        finally:
            if collects:
                gc.enable()


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` named by ``codes`` one behind the other, and where each ends."""
    own = sizes[codes]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(codes) else 0
    return pool[np.repeat(starts[codes] - (ends - own), own) + np.arange(total)], ends


def _bytes(strings: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buffer of strings without nulls, and each one's start and size in it."""
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets[:-1], np.diff(offsets)


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.LargeStringArray:
    own, ends = gather(data, starts, sizes, np.arange(len(starts)))
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(own))
