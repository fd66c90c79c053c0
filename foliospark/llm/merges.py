"""Byte-pair merges of many short words at once."""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int64(1) << 62
_MIX = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: visible Latin-1 characters are themselves, the others follow from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordMerges:
    """A byte-level BPE model of the ``tokenizers`` library as arrays.

    In each round every word's leftmost pair of the least rank is merged, as the library does one
    word after the other. That is the same because no merge makes a pair of a lower rank, which
    ``of`` checks.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_letters()
        self.byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.uint64)
        bits = max(4, int(len(keys) * 16).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys, self.ranks = np.full(size + 64, ~np.uint64(0)), np.full(size + 64, _NONE)
        self.probes = 1
        for rank, (key, at) in enumerate(zip(keys.tolist(), (keys * _MIX >> self.shift).tolist(), strict=True)):
            probe = 0
            while self.keys[at + probe] != ~np.uint64(0):
                probe += 1
            self.keys[at + probe], self.ranks[at + probe] = key, rank
            self.probes = max(self.probes, probe + 1)

    @classmethod
    def of(cls, tokenizer: str) -> WordMerges | None:
        """From the tokenizer's JSON, or None where words are not plain byte-level merges."""
        whole = json.loads(tokenizer)
        model, split = whole["model"], whole["pre_tokenizer"] or {}
        if model["type"] != "BPE" or whole["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return None
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        known: dict[str, int] = dict.fromkeys(byte_letters().values(), -1)
        for rank, (a, b) in enumerate(merges):
            if a not in known or b not in known or a + b in known:
                return None
            known[a + b] = rank
        return cls(model["vocab"], merges) if known.keys() <= model["vocab"].keys() else None

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 32 | b).astype(np.uint64)
        at = (keys * _MIX >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.ranks[at], _NONE)
        left = np.flatnonzero((out == _NONE) & (self.keys[at] != ~np.uint64(0)))
        for probe in range(1, self.probes):
            if not len(left):
                break
            there = self.keys[at[left] + probe]
            hit = there == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]] + probe]
            left = left[~hit & (there != ~np.uint64(0))]
        return out

    def encode(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (their bytes one behind the other, and how many each has), and how many each gets."""
        token = self.byte[data]
        word = np.repeat(np.arange(len(sizes)), sizes)
        last = np.r_[word[1:] != word[:-1], True] if len(word) else np.empty(0, bool)
        rank = np.full(len(token), _NONE)
        inner = np.flatnonzero(~last)
        rank[inner] = self._rank(token[inner], token[inner + 1])
        done_words, done_tokens = [], []
        while len(token):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(word)])
            going = np.repeat(least < _NONE, sizes)
            done_words.append(word[~going])
            done_tokens.append(token[~going])
            token, word, rank, least = token[going], word[going], rank[going], np.repeat(least, sizes)[going]
            at = np.flatnonzero(rank == least)
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]] if len(at) else at
            token[at] = self.made[rank[at]]
            stay = np.ones(len(token), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # each word before has lost one token
            token, word, rank = token[stay], word[stay], rank[stay]
            self._renew(token, word, rank, at)
            before = at[at > 0] - 1
            self._renew(token, word, rank, before)
        owner = np.concatenate([np.empty(0, np.int64), *done_words])
        ids = np.concatenate([np.empty(0, np.int64), *done_tokens]).astype(np.uint32)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes))

    def _renew(self, token: np.ndarray, word: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
        rank[at] = _NONE
        at = at[at + 1 < len(token)]
        at = at[word[at] == word[at + 1]]
        rank[at] = self._rank(token[at], token[at + 1])
