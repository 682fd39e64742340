"""Encoding of many texts with a tokenizer file, each distinct piece of text once.

A byte-level BPE never joins text across the start of a word. So texts are cut before single
spaces that stand between characters which certainly are no white space; pieces not met before
go through the tokenizers library, and their ids are put together again. The result is
that of encoding each whole text; pieces are told apart by their bytes, not by a hash alone.
"""

from __future__ import annotations

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; the pieces remembered, of some 60 bytes each; new pieces in one text.
CHUNK, MEMORY, JOINED = 2 << 20, 900_000, 256
_ODD = 0x9E3779B97F4A7C15
_U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser in the manner of splitmix64: equal values stay equal, others scatter over 64 bits."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        steps = [np.full(size, b, dtype=np.uint64) for b in (_ODD, pow(_ODD, -1, 1 << 64))]
        for s in steps:
            s[0] = 1
        _powers[:] = [np.cumprod(s) for s in steps]
    return _powers[0][:n], _powers[1][:n]


PUNCTUATION = ".,;:!?%&#*$|"
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U64(_ODD))


def spans_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTES) -> np.ndarray:
    """A 64-bit hash of each span of raw, by prefix sums of a polynomial in the bytes' table values."""
    power, inverse = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(table[raw] * power[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _U64(0xD6E8FEB86659FD93))


class _Memory:
    """Pieces of up to 16 bytes, as two numbers and a length, and their ids, in flat arrays with a hash table of linear probing.

    Piece 0 is the empty one. Past MEMORY pieces, those not met again since the last time are forgotten, or all if most were.
    """

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        room = 1 << 12
        self.n = self.n_ids = 0
        self.low, self.high, self.size = np.zeros(room, np.uint64), np.zeros(room, np.uint64), np.zeros(room, np.uint8)
        self.begin, self.count, self.met = np.zeros(room, np.uint32), np.zeros(room, np.uint8), np.zeros(room, bool)
        self.ids, self.table = np.zeros(4 * room, np.uint32), np.full(2 * room, -1, np.int32)
        self.add(np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.uint8), np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _slots(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = low * _U64(_ODD) + (high + size) * _U64(0xD1342543DE82EF95)
        return ((h ^ (h >> _U64(32))) * _U64(0xBF58476D1CE4E5B9) >> _U64(65 - len(self.table).bit_length())).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each piece's number, or -1."""
        at, mask = self._slots(low, high, size), len(self.table) - 1
        out = self.table[at].astype(np.int64)
        differ = lambda i, n: (self.low[n] != low[i]) | (self.high[n] != high[i]) | (self.size[n] != size[i])
        todo = np.flatnonzero(out >= 0)
        todo = todo[differ(todo, out[todo])]
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            out[todo] = self.table[at[todo]]
            todo = todo[out[todo] >= 0]
            todo = todo[differ(todo, out[todo])]
        self.met[out[out >= 0]] = True
        return out

    def add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The numbers of new pieces."""
        while self.n + len(low) > len(self.low):
            for name in ("low", "high", "size", "begin", "count", "met"):
                held = getattr(self, name)
                setattr(self, name, np.concatenate((held, np.zeros_like(held))))
            self.table = np.zeros(0, np.int32)
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)))
        new = slice(self.n, self.n + len(low))
        self.low[new], self.high[new], self.size[new], self.count[new], self.met[new] = low, high, size, count, False
        self.begin[new] = self.n_ids + np.cumsum(count) - count
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_ids = self.n + len(low), self.n_ids + len(ids)
        out = np.arange(new.start, new.stop)
        if not len(self.table):
            self.table = np.full(2 * len(self.low), -1, np.int32)
            self._place(np.arange(self.n))
        else:
            self._place(out)
        return out

    def _place(self, number: np.ndarray) -> None:
        at, mask = self._slots(self.low[number], self.high[number], self.size[number]), len(self.table) - 1
        while len(number):
            free = self.table[at] < 0
            self.table[at[free]] = number[free]
            left = self.table[at] != number
            number, at = number[left], (at[left] + 1) & mask

    def forget(self) -> None:
        if self.n > MEMORY:
            keep = np.flatnonzero(self.met[: self.n])
            keep = keep[(keep > 0) & (len(keep) <= MEMORY // 2)]
            held = self.low[keep], self.high[keep], self.size[keep], *gather(self.ids, self.begin, self.count, keep)
            self._clear()
            self.add(*held)


_FIRST = np.array([0] + [(1 << 8 * n) - 1 for n in range(1, 9)], dtype=np.uint64)  # masks of a number's first bytes


class Encoder:
    """encode(texts) gives the ids of all texts one after another, and how many each has."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = "".join(t.content for t in self._tokenizer.get_added_tokens_decoder().values())
        if any(c.isspace() for c in added):
            raise ValueError("added tokens with white space aren't supported")
        self._marks = np.zeros(256, bool)  # punctuation to cut before; none of an added token's characters
        self._marks[[c for c in PUNCTUATION.encode() if chr(c) not in added]] = True
        self._memory = _Memory()
        line = self._tokenizer.encode("\n", add_special_tokens=False).ids
        plain = self._tokenizer.normalizer is None and not any(t.lstrip or t.rstrip for t in self._tokenizer.get_added_tokens_decoder().values())
        self._line = np.uint32(line[0]) if plain and len(line) == 1 else None  # the id that parts pieces asked for in one text

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self._tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_column(pa.array(texts, pa.large_string()))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() of an Arrow column of strings, null as the empty one, straight from its bytes."""
        column = column.fill_null("") if column.null_count else column
        counts = np.zeros(len(column), np.int64)
        if not len(column):
            return np.zeros(0, np.uint32), counts
        _, offsets, data = column.buffers()
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        ends -= ends[0]
        out, at, size = [np.zeros(0, np.uint32)], 0, CHUNK
        while at < len(raw):  # a window at a time, which ends where a piece starts
            window = raw[at : at + size]
            upto = at + len(window)
            starts = np.flatnonzero(self._cuts(window, ends[np.searchsorted(ends, at) : np.searchsorted(ends, upto)] - at))
            if upto < len(raw):
                starts = starts[starts < len(window) - 2]  # the last bytes don't tell where pieces start
                if len(starts) < 2:  # one piece fills the window
                    size *= 2
                    continue
                upto, starts = at + int(starts[-1]), starts[:-1]
            ids, n = self._pieces(raw[at:upto], starts)
            out.append(ids)
            first, last = np.searchsorted(ends, at, "right") - 1, np.searchsorted(ends, upto)  # the texts in here
            edges = np.searchsorted(starts, np.clip(ends[first : last + 1], at, upto) - at)
            counts[first:last] += np.diff(np.concatenate(([0], np.cumsum(n)))[edges])
            at, size = upto, CHUNK
        return np.concatenate(out), counts

    def _pieces(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces that raw is cut into, and how many each has."""
        memory = self._memory
        memory.forget()
        ends = np.append(starts[1:], len(raw))
        size = ends - starts
        words = np.ndarray(len(raw) + 9, "<u8", np.concatenate((raw, np.zeros(16, np.uint8))), strides=(1,))
        low = words[starts] & _FIRST[np.minimum(size, 8)]
        high = words[np.minimum(starts + 8, len(raw))] & _FIRST[np.clip(size - 8, 0, 8)]
        length = size.astype(np.uint8)
        long = np.flatnonzero(size > 16)
        low[long], high[long], length[long] = 0, 0, 0  # asked for by themselves
        number = memory.find(low, high, length)
        new = np.flatnonzero(number < 0)
        if len(new):
            order = new[np.lexsort((high[new], low[new] ^ length[new]))]
            same = (low[order[1:]] == low[order[:-1]]) & (high[order[1:]] == high[order[:-1]]) & (length[order[1:]] == length[order[:-1]])
            fresh = np.concatenate(([True], ~same))
            one = order[fresh]
            number[order] = memory.add(low[one], high[one], length[one], *self._ask(raw, starts[one], ends[one]))[np.cumsum(fresh) - 1]
        ids, count = gather(memory.ids, memory.begin, memory.count, number)
        if len(long):
            own, n = self._ask(raw, starts[long], ends[long])
            ids = np.insert(ids, np.repeat((np.cumsum(count) - count)[long], n), own)
            count[long] = n
        return ids, count

    def _ask(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces by the tokenizer itself, and how many each has. Pieces that don't reach over a line end go as lines of one text, many in a call."""
        data = raw.tobytes()
        lines = np.flatnonzero(raw == 0x0A)
        joined = self._alone(raw, starts, ends) & (np.searchsorted(lines, starts) == np.searchsorted(lines, ends)) if self._line is not None else np.zeros(len(starts), bool)
        pieces = [data[s:e] for s, e in zip(starts[joined].tolist(), ends[joined].tolist(), strict=True)]
        flat = self._flat([b"\n".join([*pieces[i : i + JOINED], b""]).decode() for i in range(0, len(pieces), JOINED)])[0]
        stops = np.flatnonzero(flat == self._line)
        other = ~joined
        own, n = self._flat([data[s:e].decode() for s, e in zip(starts[other].tolist(), ends[other].tolist(), strict=True)])
        count, begin = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        count[joined], begin[joined] = np.diff(stops, prepend=-1) - 1, np.concatenate(([0], stops[:-1] + 1))[: len(stops)]
        count[other], begin[other] = n, len(flat) + np.cumsum(n) - n
        return gather(np.concatenate((flat, own)), begin, count, np.arange(len(starts)))

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(count.sum())), count

    @staticmethod
    def _alone(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether a piece starts with at most one space, and it or what follows it and its last character surely are no white space."""
        plain = (raw > 0x20) & (raw < 0x7F)
        lead = (raw >= 0xC3) & (raw <= 0xDF)
        begin = np.minimum(starts + (raw[starts] == 0x20), ends - 1)
        return (plain | lead)[begin] & (plain[ends - 1] | ((ends - starts > 1) & lead[ends - 2]))

    def _cuts(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where a piece starts: at each text, at single spaces and around single line ends between plain characters, and where punctuation follows a letter."""
        plain = (raw > 0x20) & (raw < 0x7F)
        letter = ((raw | 0x20) >= 0x61) & ((raw | 0x20) <= 0x7A) & plain
        lead = (raw >= 0xC3) & (raw <= 0xDF)  # first bytes of characters of two bytes, none of them white space
        rest = (raw >= 0x80) & (raw < 0xC0)
        before, after = plain.copy(), plain | lead  # whether a character that is no white space ends here, starts here
        before[1:] |= lead[:-1] & rest[1:]
        letter[1:] |= (raw[:-1] == 0xC3) & rest[1:] & (raw[1:] != 0x97) & (raw[1:] != 0xB7)  # Latin-1 letters, but for two signs
        out = np.zeros(len(raw), bool)
        gap = np.zeros(len(raw), bool)
        gap[1:-1] = before[:-2] & after[2:]
        out |= gap & (raw == 0x20)
        line = gap & (raw == 0x0A)
        out |= line
        out[1:] |= line[:-1] | (letter[:-1] & self._marks[raw[1:]])
        out[starts] = out[0] = True
        return out


def gather(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[begin[w] : begin[w] + length[w]] for each w of which, one after another, and the lengths."""
    n = length[which].astype(np.int64)
    place = np.cumsum(n) - n
    return flat[np.repeat(begin[which].astype(np.int64) - place, n) + np.arange(int(n.sum()))], n


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
