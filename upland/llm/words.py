"""Token ids of whole texts, with every different word of a block encoded once.

Both kinds of public tokenizer used here join nothing across a plain space between two visible characters: the
byte-level one splits its input there before it merges, and the piece model has no piece that holds its space mark after
another character (`Pieces` tests this on the model it is given, and what else cuts rest on). So a text may be cut before
such a space, its words encoded apart, and equal words encoded once: the ids are those of the whole text. Stretches without such a space (long
tokens, scripts without spaces) are one word. Words already met are kept by a worker up to a fixed number of bytes.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from upland.llm.common import mix

KEPT_WORDS = 500_000          # different words and
KEPT_BYTES = 16 << 20          # bytes of them that a worker keeps; beyond that it starts anew
MARK = "\u2581"               # stands for a space in pieces
JOINS = re.compile(f"[^{MARK}]{MARK}|[A-Za-z][.,;:!?)]|\n")
PART = 1 << 19                # words looked at together
STOPS = np.isin(np.arange(256), np.frombuffer(b".,;:!?)", np.uint8))
MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def word_starts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fine: bool = False) -> np.ndarray:
    """First bytes of the words of texts that follow one another in `data` ([starts, ends) each). A word starts where a
    text does, and at a space after an ASCII sign or letter (or a character of U+00C0-07FF, U+4000-DFFF) and before one.

    `fine` adds what a byte-level tokenizer always allows, which ends a run of letters at any other sign and takes a
    single line end apart, and a piece model if no piece joins such signs: starts at a mark of STOPS after an ASCII letter, at a line end between visible characters, and
    after that line end."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    sign = (data > 32) & (data < 127)
    follow = (data & 0xC0) == 0x80
    two, three = (data >= 0xC3) & (data <= 0xDF), (data >= 0xE4) & (data <= 0xED)
    last = sign.copy()
    last[1:] |= follow[1:] & two[:-1]
    last[2:] |= follow[2:] & follow[1:-1] & three[:-2]
    first = sign | two | three
    cut = data == 32
    if fine:
        line = data == 10
        cut |= line
    cut[0] = cut[-1] = False
    cut[1:-1] &= last[:-2] & first[2:]
    if fine:
        line &= cut
        cut[1:] |= line[:-1]
        letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        cut[1:] |= letter[:-1] & STOPS[data[1:]]
    full = ends > starts
    edge = ends[full] - 1
    cut[edge] &= (data[edge] != 32) & (data[edge] != 10)
    cut[starts[full]] = True
    return np.flatnonzero(cut)


def different(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each different word first stands, which of them each word is), numbered as they first stand. Words of up to
    16 bytes are told apart as two numbers and a length, longer ones by a dictionary."""
    ends = np.append(starts[1:], len(data))
    size = ends - starts
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
    low, high = eight[starts] & MASK[np.minimum(size, 8)], eight[np.minimum(starts + 8, len(data))] & MASK[np.clip(size - 8, 0, 8)]
    short = np.flatnonzero(size <= 16)
    key = mix(low[short] ^ mix(high[short] ^ (size[short].astype(np.uint64) << np.uint64(57))))
    _, one, of = np.unique(key, return_index=True, return_inverse=True)
    first, which = short[one], np.full(len(starts), -1, np.int64)
    pick = first[of]
    alike = (size[short] == size[pick]) & (low[short] == low[pick]) & (high[short] == high[pick])
    which[short[alike]] = of[alike]
    known: dict[bytes, int] = {}
    more = []
    for i in np.flatnonzero(which < 0).tolist():
        word = padded[starts[i]:ends[i]].tobytes()
        if word not in known:
            known[word] = len(first) + len(more)
            more.append(i)
        which[i] = known[word]
    first = np.concatenate([first, np.array(more, np.int64)])
    order = np.argsort(first)
    rank = np.empty(len(first), np.int64)
    rank[order] = np.arange(len(first))
    return first[order], rank[which]


class WordTable:
    """Numbers for different words. `learn` is called with the words not met before, in the order of their numbers;
    `forget` when all are dropped to stay within the bounds."""

    def __init__(self, learn: Callable[[list[bytes]], None], forget: Callable[[], None], most: int | None = None):
        self.most = most or KEPT_WORDS
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.learn, self.forget = learn, forget

    def numbers(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each word of one block; numbers hold until the next call."""
        if len(self.known) > self.most or self.held > KEPT_BYTES:
            self.known.clear()
            self.held = 0
            self.forget()
        out = np.empty(len(starts), np.int64)
        ends = np.append(starts[1:], len(data))
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
        raw = padded.tobytes()
        for at in range(0, len(starts), PART):
            s, e = starts[at:at + PART], ends[at:at + PART]
            size = e - s
            low = eight[s] & MASK[np.minimum(size, 8)]
            high = eight[np.minimum(s + 8, len(data))] & MASK[np.clip(size - 8, 0, 8)]
            key = mix(low ^ mix(high ^ (size.astype(np.uint64) << np.uint64(57))))
            _, one, which = np.unique(key, return_index=True, return_inverse=True)
            pick = one[which]
            alike = (size <= 16) & (size == size[pick]) & (low == low[pick]) & (high == high[pick])
            numbers = self._of(raw, s[one], e[one])
            out[at:at + PART] = numbers[which]
            if not alike.all():                          # words of more than 16 bytes, one by one
                rest = np.flatnonzero(~alike)
                out[at + rest] = self._of(raw, s[rest], e[rest])
        return out

    def _of(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        known, fresh = self.known, []
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            n = known.get(w)
            if n is None:
                n = known[w] = len(known)
                fresh.append(w)
                self.held += len(w)
            out[i] = n
        if fresh:
            self.learn(fresh)
        return out


class Rows:
    """Rows of numbers of different lengths, appended to and read back together."""

    def __init__(self, kind: str):
        self.kind, self.values, self.ends = kind, array(kind), array("q", [0])

    def add(self, rows) -> None:
        for r in rows:
            self.values.extend(r)
            self.ends.append(len(self.values))

    def add_flat(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Rows one after another, with their sizes."""
        base = len(self.values)
        self.values.frombytes(np.ascontiguousarray(values).tobytes())
        self.ends.frombytes((base + np.cumsum(sizes, dtype=np.int64)).tobytes())

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """(values, ends): row i is values[ends[i]:ends[i + 1]]."""
        values = np.array(self.values) if len(self.values) else np.zeros(0, self.kind)
        return values, np.array(self.ends)


def spread(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of the given rows, one row after another."""
    size = ends[rows + 1] - ends[rows]
    total = np.cumsum(size)
    if not len(total) or total[-1] == 0:
        return values[:0]
    return values[np.repeat(ends[rows] - (total - size), size) + np.arange(total[-1])]


def sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of values[first:last] for each pair of places."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[last] - total[first]


@lru_cache(maxsize=2)
def byte_level(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from U+0100
    on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


SIGNS = dict(enumerate(byte_signs()))
LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def byte_level_ids(path: str, words: list[bytes]) -> list[list[int]]:
    """Ids of words. A run of letters is put to the merges as it is, without the split into such runs."""
    t = byte_level(path)
    merged = t.model.tokenize
    out = [[k.id for k in merged(w.decode("latin-1").translate(SIGNS))] if LETTERS.fullmatch(w) else None for w in words]
    other = [i for i, ids in enumerate(out) if ids is None]
    for i, e in zip(other, t.encode_batch([words[i].decode() for i in other], add_special_tokens=False)):
        out[i] = e.ids
    return out


class Pieces:
    """A piece model, applied to words. A word starts with the space that stands before it, which is what the model itself
    puts before a text; other words (after a line end, marks) are encoded behind a line end, which is taken off again."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        n = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(s[3:5], 16)]) if m.is_byte(i) else s.replace(MARK, " ").encode() for i, s in enumerate(names)]
        plain = [s for i, s in enumerate(names) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        if any(JOINS.search(s) for s in plain):
            raise ValueError(f"{path} has pieces that join words, or letters and marks; texts cannot be cut for it")
        self.line = m.encode("\n")

    def ids(self, words: list[bytes]) -> list[list[int]]:
        texts = [w.decode() for w in words]
        out = self.model.encode([t[1:] if t[0] == " " else "\n" + t for t in texts], num_threads=1)
        return [ids if t[0] == " " else ids[len(self.line):] for t, ids in zip(texts, out)]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class ByteCoder:
    """Ids of texts by a byte-level tokenizer."""

    def __init__(self, path: str):
        self.path = path
        self.table = WordTable(self._learn, self._forget)
        self._forget()

    def _forget(self) -> None:
        self.ids = Rows("I")

    def _learn(self, words: list[bytes]) -> None:
        self.ids.add(byte_level_ids(self.path, words))

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n): the ids of the texts one after another, and how many each text has."""
        at = word_starts(data, starts, ends, fine=True)
        numbers = self.table.numbers(data, at)
        values, row_ends = self.ids.arrays()
        n = sums(row_ends[numbers + 1] - row_ends[numbers], np.searchsorted(at, starts), np.searchsorted(at, ends))
        return spread(values, row_ends, numbers), n


@lru_cache(maxsize=2)
def byte_coder(path: str) -> ByteCoder:
    """A worker's coder, which keeps what it has learned."""
    return ByteCoder(path)
