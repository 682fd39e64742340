"""Re-Pair: a shard of token ids as a grammar.

The most frequent pairs of neighbouring symbols become nonterminals, again and again, until no pair
is left that stands at ``least`` places. A round ranks all frequent pairs by their places that don't overlap
and replaces them in that order, as if one after another, so the work is done a round at a time.
After the first round only places next to a new symbol, and those that a better pair was in the way
of, can hold a frequent pair, so only these are counted again. No pair crosses from one document into the
next, so a document is a range of symbols, and the lengths that rules expand to let any document be
decoded by itself. Terminals are all ids up to the shard's largest.

The bytes of a shard: a header, the documents (id, whether null, first symbol, ids), the rules of each
round, the list of ids where numbers are short, and in planes the rules (left, right, length of the expansion) and the symbols.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from treelens.llm.tokens import gather

MAGIC = b"TLRP"
_HEAD = struct.Struct("<4sIIIIQQII")  # magic, documents, rounds, names, rules, symbols, ids, first nonterminal, crc32 of the rest
_HIGH = 1 << 31  # ids from here on are named by their place in a list


def _ordered(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """keys, of so many bits, in order, and where each stands: keys and places are sorted as one number if both fit."""
    width = len(keys).bit_length()
    if bits + width > 64:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = (keys << np.uint64(width)) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    return both >> np.uint64(width), (both & np.uint64((1 << width) - 1)).astype(np.int64)


def _ranked(pairs: np.ndarray, bits: int, none: np.uint64, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs, without none, that occur least times or more, the most frequent first, ties by their symbols; and each pair's place among them, or -1."""
    ordered, order = _ordered(pairs, bits)
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    count = np.diff(np.append(begin, len(ordered)))
    often = np.flatnonzero((count >= least) & (ordered[begin] != none))
    often = often[np.argsort(-count[often], kind="stable")]
    place = np.full(len(begin), -1, np.int32)
    place[often] = np.arange(len(often), dtype=np.int32)
    number = np.empty(len(pairs), np.int32)
    number[order] = np.repeat(place, count)
    return ordered[begin[often]], number


def _once_a_run(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of places at, ascending, that hold one symbol twice: the first, third, fifth of each run."""
    run = np.concatenate(([True], after[at[:-1]] != at[1:]))
    nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
    return nth % 2 == 0


def _winners(at: np.ndarray, of: np.ndarray, touch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of candidate places, ascending, and their ranks those that one after another, by rank, can be replaced; touch says which overlap the one after them."""
    won_at, won_of = [], []
    while len(at):  # a place wins if no overlapping one ranks before it; what overlaps a winner is out
        less = of[:-1] < of[1:]
        wins = np.ones(len(at), bool)
        wins[:-1] &= less | ~touch
        wins[1:] &= ~(less & touch)
        won_at.append(at[wins])
        won_of.append(of[wins])
        stay = ~wins
        stay[1:] &= ~(wins[:-1] & touch)
        stay[:-1] &= ~(wins[1:] & touch)
        touch = (touch & stay[1:])[stay[:-1]]
        at, of = at[stay], of[stay]
        touch = touch[: max(len(at) - 1, 0)]
    return np.concatenate(won_at), np.concatenate(won_of)


def repair(ids: np.ndarray, starts: np.ndarray, first: int, least: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, each document's first symbol, the rules' left and right sides, and how many rules each round made."""
    n = len(ids)
    seq = ids.astype(np.uint32)
    head = np.zeros(n + 1, bool)  # whether a document starts here
    head[starts], head[n] = True, True
    after, before = np.arange(1, n + 2), np.arange(-1, n)  # the neighbours of a place; place n is none
    gone, mark = np.zeros(n, bool), np.zeros(n, bool)
    left, right, made = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], []
    symbol, live = first, np.flatnonzero(~head[1:])  # places whose pair may be frequent
    while len(live):
        here, follow, bits = seq[live], seq[after[live]], symbol.bit_length()
        pairs = (here.astype(np.uint64) << np.uint64(bits)) | follow
        twins = np.flatnonzero(here == follow)
        none = np.uint64(symbol << bits | symbol)  # no such symbol yet
        between = live[:0]  # places of runs that overlap the counted ones
        if len(twins):
            odd = twins[~_once_a_run(live[twins], after)]
            between, pairs[odd] = live[odd], none
        chosen, number = _ranked(pairs, 2 * bits, none, least)
        if not len(chosen):
            break
        turn = np.flatnonzero(number >= 0)
        some = live[turn]
        at, of = _winners(some, number[turn], after[some[:-1]] == some[1:])
        good = np.bincount(of, minlength=len(chosen)) >= least
        which = good[of]
        at, of = at[which], of[which]
        out = after[at]
        ahead = after[out]
        seq[at] = (symbol - 1 + np.cumsum(good)[of]).astype(np.uint32)
        after[at], before[ahead], gone[out] = ahead, at, True
        left.append((chosen[good] >> np.uint64(bits)).astype(np.uint32))
        right.append((chosen[good] & np.uint64((1 << bits) - 1)).astype(np.uint32))
        made.append(int(good.sum()))
        symbol += made[-1]
        # What may be frequent now: pairs with a new symbol, and frequent ones that are still there.
        mark[some] = mark[between] = mark[at] = True
        mark[before[at[~head[at]]]] = True
        live = np.flatnonzero(mark)
        mark[live] = False
        live = live[~gone[live]]
        live = live[~head[after[live]]]
    kept = np.flatnonzero(~gone)
    return seq[kept], np.searchsorted(kept, starts), np.concatenate(left), np.concatenate(right), np.array(made, np.int64)


def _expand(symbols: np.ndarray, first: int, flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of symbols one after another, where rule r expands to flat[begin[r] : begin[r] + lengths[r]]."""
    rule = symbols >= first
    which = (symbols[rule] - np.uint32(first)).astype(np.int64)
    size = np.ones(len(symbols), np.int64)
    size[rule] = lengths[which]
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint32)
    out[end[~rule] - 1] = symbols[~rule]
    ids, n = gather(flat, begin, lengths, which)
    place = end[rule] - n
    out[np.repeat(place - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    return out


def _packed(x: np.ndarray) -> bytes:
    """Numbers of up to 32 bits: how many bits are above 16, the lower 16 of each, then a plane for each further bit."""
    planes = max(0, int(x.max(initial=0)).bit_length() - 16)
    parts = [np.array([planes], "u1"), (x & 0xFFFF).astype("<u2"), *[np.packbits((x >> (16 + p)).astype(np.uint8) & 1) for p in range(planes)]]
    return b"".join(part.tobytes() for part in parts)


def pack_shard(doc_ids: list, ids: np.ndarray, counts: np.ndarray, least: int = 4) -> bytes:
    starts = np.cumsum(counts) - counts
    names = np.zeros(0, np.uint32)
    if int(ids.max(initial=0)) >= _HIGH:  # no numbers are left for rules: terminals are places in a list of ids
        names, ids = np.unique(ids, return_inverse=True)
    first = int(ids.max(initial=0)) + 1
    seq, firsts, left, right, made = repair(ids, starts, first, least)
    lengths = np.ones(len(left), np.uint32)
    done = 0
    for m in made.tolist():  # a rule's sides are of earlier rounds
        sides = np.stack((left[done : done + m], right[done : done + m])).astype(np.int64) - first
        lengths[done : done + m] = np.where(sides >= 0, lengths[np.maximum(sides, 0)], 1).sum(axis=0)
        done += m
    numbers = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), firsts.astype("<u8"), counts.astype("<u8"), made.astype("<u4"), names.astype("<u4")]
    rest = b"".join([*(x.tobytes() for x in numbers), *(_packed(x) for x in (left, right, lengths, seq))])
    return _HEAD.pack(MAGIC, len(doc_ids), len(made), len(names), len(left), len(seq), len(ids), first, zlib.crc32(rest)) + rest


class Shard:
    """A shard's bytes, opened: ids(i) decodes one document, all_ids() all of them."""

    def __init__(self, blob: bytes):
        magic, n_docs, n_rounds, n_names, n_rules, n_symbols, self.n_ids, self.first, crc = _HEAD.unpack_from(blob)
        if magic != MAGIC or zlib.crc32(memoryview(blob)[_HEAD.size :]) != crc:
            raise ValueError("not a whole shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        def unpacked(n: int) -> np.ndarray:
            planes = int(take("u1", 1)[0])
            out = take("<u2", n).astype(np.uint32)
            for p in range(planes):
                out |= np.unpackbits(take("u1", (n + 7) // 8), count=n).astype(np.uint32) << np.uint32(16 + p)
            return out

        numbers, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if x else d for d, x in zip(numbers.tolist(), null.tolist(), strict=True)]
        self.firsts, self.counts = take("<u8", n_docs).astype(np.int64), take("<u8", n_docs).astype(np.int64)
        self.made, self.names = take("<u4", n_rounds), take("<u4", n_names)
        self.left, self.right, self.lengths, self.seq = unpacked(n_rules), unpacked(n_rules), unpacked(n_rules).astype(np.int64), unpacked(n_symbols)
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def _rules(self) -> tuple[np.ndarray, np.ndarray]:
        """All expansions one after another, and where each begins."""
        if self._flat is None:
            ends = np.cumsum(self.lengths)
            begin = ends - self.lengths
            flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
            done = 0
            for m in self.made.tolist():
                sides = np.stack((self.left[done : done + m], self.right[done : done + m]), axis=1).ravel()
                flat[begin[done] : ends[done + m - 1]] = _expand(sides, self.first, flat, begin, self.lengths)
                done += m
            self._flat = flat, begin
        return self._flat

    def _ids(self, seq: np.ndarray) -> np.ndarray:
        ids = _expand(seq, self.first, *self._rules(), self.lengths)
        return self.names[ids] if len(self.names) else ids

    def all_ids(self) -> np.ndarray:
        return self._ids(self.seq)

    def ids(self, i: int) -> np.ndarray:
        """One document's ids, from its own symbols alone."""
        end = self.firsts[i + 1] if i + 1 < len(self.firsts) else len(self.seq)
        return self._ids(self.seq[self.firsts[i] : end])
