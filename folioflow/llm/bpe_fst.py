"""Byte-pair encoding as a lazily determinised finite-state transducer.

A sequence of vocabulary items is the byte-pair encoding of its bytes exactly if each item encodes to itself and each
adjacent pair (a, b) encodes to (a, b).  So, reading bytes from left to right, every prefix has exactly one last item
that fits its predecessor, and the encoding of a text is decided by the *live boundaries*: positions from which the
bytes read so far are still the beginning of some vocabulary item.  A transducer state is the set of live boundaries,
each with the items that lead to it and are not yet emitted.  Items shared by all live boundaries are emitted at once:
the lookahead is bounded by the longest item.  States and transitions are made when first needed and kept.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

#: Fixed value: the pre-tokeniser pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space as PATTERN sees it. A text may be cut before each run of it: no piece holds any but at its start.
BLANKS = "".join(re.escape(c) for c in regex.findall(r"\s", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))))

#: Where the public vocabulary files are; a parameter of every operator that needs them.
TOKENIZER_DIR = os.environ.get("FOLIOFLOW_TOKENIZERS", "/opt/tokenizers")

MAX_STATES = 200_000
MAX_WORDS = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one base64 item and its rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(item): int(rank) for item, rank in map(bytes.split, file)}


class Transducer:
    """Encodes byte strings; states beyond ``MAX_STATES`` are forgotten and made again when needed."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.items = {rank: item for item, rank in ranks.items()}
        self.max_states = max_states
        self.begins = {item[:n] for item in ranks for n in range(len(item))}
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: (last emitted item or -1, ((pending items up to the boundary, ...), ...)); the last boundary is the end
        self.start = 0
        self.keys: list[tuple] = [(-1, ((),))]
        self.index: dict[tuple, int] = {self.keys[0]: 0}
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Encoding by repeated merging of the lowest rank: only used on an item or two, to compile transitions."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return tuple(self.ranks[p] for p in parts)

    def _ok(self, last: int, item: int) -> bool:
        if item not in self._whole:
            self._whole[item] = self.merge(self.items[item]) == (item,)
        if last < 0 or not self._whole[item]:
            return self._whole[item]
        key = (last, item)
        if key not in self._fits:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            self._fits[key] = self.merge(self.items[last] + self.items[item]) == key
        return self._fits[key]

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, chains = self.keys[state]
        pending = b"".join(self.items[i] for i in chains[-1])
        live, new = [], None
        for path in chains:
            tail = pending[sum(len(self.items[i]) for i in path) :] + bytes((byte,))
            item = self.ranks.get(tail)
            if new is None and item is not None and self._ok(path[-1] if path else last, item):
                new = (*path, item)
            if tail in self.begins:
                live.append(path)
        if new is None:
            raise ValueError("the vocabulary lacks a byte")
        live.append(new)
        common = 0
        while all(len(p) > common and p[common] == new[common] for p in live):
            common += 1
        out = new[:common]
        key = (out[-1] if out else last, tuple(p[common:] for p in live))
        if key not in self.index:
            self.index[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        self.moves[state][byte] = found = (self.index[key], out)
        return found

    def encode(self, data: bytes) -> tuple[int, ...]:
        if len(self.keys) > self.max_states:
            self._reset()
        state, out = self.start, []
        for byte in data:
            move = self.moves[state].get(byte) or self._move(state, byte)
            state = move[0]
            if move[1]:
                out.extend(move[1])
        out.extend(self.keys[state][1][-1])
        return tuple(out)


class _Words(dict):
    """Blanks and the word after them -> ids; filled by the transducer on first sight, emptied when it grows too large."""

    def __init__(self, fst: Transducer, limit: int):
        super().__init__()
        self.fst, self.limit = fst, limit
        self.pieces = regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > self.limit:
            self.clear()
        encode = self.fst.encode
        ids = tuple(i for piece in self.pieces(word) for i in encode(piece.encode("utf-8", "replace")))
        if len(word) <= 64:
            self[word] = ids
        return ids


class Encoder:
    """Text to ids and back for one byte-level vocabulary."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        self.fst = Transducer(load_ranks(path))
        self.pieces = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+").findall
        self.words = _Words(self.fst, max_words)
        self.lengths = np.zeros(max(self.fst.items) + 1, np.int32)
        for rank, item in self.fst.items.items():
            self.lengths[rank] = len(item)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.pieces(text))))

    def count(self, text: str) -> int:
        return sum(map(len, map(self.words.__getitem__, self.pieces(text))))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as ids arrive: an incremental UTF-8 state machine holds back the bytes of an unfinished character."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        items = self.fst.items
        for i in ids:
            if part := machine.decode(items[i]):
                yield part
        if part := machine.decode(b"", True):
            yield part

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Encoder:
    """One encoder a worker: the cache lives as long as the Python worker, across tasks."""
    return Encoder(f"{folder}/{name}.tiktoken")
