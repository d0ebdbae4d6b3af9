"""Token ids of whole texts from the tokenizers library, at corpus speed.

Neither vocabulary lets a token cross from a character that is no white space to ASCII
white space, nor from a Latin letter to one of some punctuation marks.  A text is cut there
and the library encodes every distinct piece once per worker, as far as its table
holds; the ids of a text are those of its pieces in order.  Tests compare this with encoding
whole texts.

The table is compact: open addressing over 64-bit hashes of the pieces, each slot with the place
of its ids in one array.  A batch of pieces is looked up and its ids are gathered in numpy.
"""

from __future__ import annotations

import os
import re

import numpy as np

from tidewatch.llm.common import give_back

# A piece: white space, then letters up to a mark, or else all up to white space; a run of
# white space that does not begin with an ASCII one is no place to cut.
# Possessive: no shorter match would do, so none is tried.
PIECE = re.compile(r"\s*+(?:[A-Za-z\u00df-\u00f6\u00f8-\u00ff]++(?=[.,;:!?%#$&*|])"
                   r"|\S++(?:(?![ \t-\r])\s++\S*+)*+)|\s++")
KEPT, KEPT_IDS = 1 << 20, 1 << 22  # pieces and ids of a worker's table: 44 MB when full
ROWS = 256  # texts cut at once
AT_ONCE = 2048  # pieces the library encodes at once; its results are large until their ids are taken

encoders: dict[int, Encoder] = {}


class Pieces:
    """Hash of a piece -> its ids.  Hash 0 marks a free slot."""

    def __init__(self, slots: int = 1 << 15):
        self.size = self.used = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self._slots(slots)

    def _slots(self, n: int) -> None:
        self.hash, self.start = np.zeros(n, np.int64), np.zeros(n, np.int32)
        self.count = np.zeros(n, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it is not in the table."""
        mask = len(self.hash) - 1
        slot = hashes & mask
        held = self.hash[slot]
        open_ = np.flatnonzero((held != hashes) & (held != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            held[open_] = self.hash[slot[open_]]
            open_ = open_[(held[open_] != hashes[open_]) & (held[open_] != 0)]
        return np.where(held == 0, -1, slot)

    def _place(self, hashes: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        mask = len(self.hash) - 1
        slot = hashes & mask
        left = np.arange(len(hashes))
        while len(left):
            at = slot[left]
            free = self.hash[at] == 0
            self.hash[at[free]] = hashes[left[free]]  # of several for one slot the last stays
            done = self.hash[at] == hashes[left]
            self.start[at[done]], self.count[at[done]] = start[left[done]], count[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & mask

    def add(self, hashes: np.ndarray, lists: list[list[int]]) -> bool:
        """Add distinct hashes that are not in the table, with their ids; whether slots moved."""
        count = np.fromiter(map(len, lists), np.int32, len(lists))
        total = int(count.sum())
        if self.size + total > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.size + total), np.uint32)
            grown[:self.size] = self.ids[:self.size]
            self.ids = grown
        self.ids[self.size:self.size + total] = np.fromiter(
            (i for ids in lists for i in ids), np.uint32, total)
        start = (self.size + np.cumsum(count) - count).astype(np.int32)
        self.size += total
        self.used += len(lists)
        moved = 2 * self.used > len(self.hash)
        if moved:
            held = np.flatnonzero(self.hash)
            old = self.hash[held], self.start[held], self.count[held]
            self._slots(1 << (4 * self.used - 1).bit_length())
            self._place(*old)
        self._place(hashes, start, count)
        return moved

    def gather(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slots in order, number of ids before each slot and after the last)."""
        count = self.count[slot]
        ends = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
        at = np.repeat(self.start[slot] - ends[:-1], count) + np.arange(ends[-1])
        return self.ids[at], ends


class Encoder:
    def __init__(self, json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        give_back()  # what reading the file took is more than what stays
        self.pieces = Pieces()

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, where each text's ids begin and the last ones end)."""
        # A full table is given up: frequent pieces are soon learnt anew.
        if self.pieces.used > KEPT or self.pieces.size > KEPT_IDS:
            self.pieces = Pieces()
        cut, stops = [], [0]
        for text in texts:
            cut += PIECE.findall(text)
            stops.append(len(cut))
        # Python hashes the bytes a string is held in: "\\r " and "\\u200d" differ in length only.
        hashes = np.fromiter(map(hash, cut), np.int64, len(cut))
        hashes ^= np.fromiter(map(len, cut), np.int64, len(cut)) * np.int64(0x2545F4914F6CDD1D)
        hashes[hashes == 0] = 1
        slot = self.pieces.find(hashes)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            fresh, first = np.unique(hashes[missing], return_index=True)
            if self.pieces.add(fresh, self.learn([cut[k] for k in missing[first]])):
                slot = self.pieces.find(hashes)
            else:
                slot[missing] = self.pieces.find(hashes[missing])
        ids, ends = self.pieces.gather(slot)
        return ids, ends[stops]

    def learn(self, pieces: list[str]) -> list[list[int]]:
        got = []
        for at in range(0, len(pieces), AT_ONCE):
            got += [e.ids for e in self.tokenizer.encode_batch_fast(
                pieces[at:at + AT_ONCE], add_special_tokens=False)]
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for i in range(0, len(texts), ROWS):
            ids, stops = self.flat(texts[i:i + ROWS])
            data = memoryview(ids.astype("<u4", copy=False).tobytes())
            out.extend(bytes(data[a * 4:b * 4]) for a, b in zip(stops[:-1], stops[1:]))
        return out


def encoder(json: str) -> Encoder:
    """This worker's encoder for a tokenizer file's content."""
    key = hash(json)
    if key not in encoders:
        encoders[key] = Encoder(json)
    return encoders[key]


def tokenizer_file(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()
