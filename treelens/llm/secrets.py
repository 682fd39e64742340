"""Secret scans by patterns and by the cost of guessing.

Patterns find assignments, access keys and long hex runs. Beyond them, a value that stands in the
context of a credential counts as a secret if it is hard to guess: the cheapest segmentation of the
value into words, dates, repeats, keyboard walks and brute-force spans, found by dynamic programming,
must cost at least 10**MIN_GUESSES guesses. So a placeholder of words isn't reported, and a random string is.
Words are those of a short list and, if a tokenizer's file is named, its vocabulary's, which stands in the order
of how common its entries are.

One pass over whole texts, no shuffle. Defined results: a null text is empty; a document without a
secret has zero counts and empty lists; repeated rows give repeated results; a value of any length is judged whole, in time
in proportion to its length; an empty table gives no rows; other columns aren't read. Places are code points.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treelens.llm.common import pick, slices

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24}")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: A credential's context that a value follows, and the value; a value needs so many characters and decimal digits of guesses.
_CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth(?:orization)?|bearer|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|login)["']?(?:\x20+is)?\x20*(=>|:=|[:=]|\x20bearer\x20|\x20)\x20*["'`]?(?=[^\s"'`<>]{8})""", re.IGNORECASE | re.ASCII)
_VALUE = re.compile(r"""[^\s"'`<>]+""", re.ASCII)
_CUE = re.compile(r"pass|pwd|pin|secret|token|credential|auth|bearer|key|login", re.IGNORECASE | re.ASCII)
MIN_GUESSES = 10.0
#: Words by how soon they are guessed; longer units of a repeat and longer words aren't looked for.
WORDS = ("password admin letmein welcome monkey dragon master login qwerty secret user test guest root default changeme example sample dummy placeholder your token key value here none null true false "
         "api access private public client server database config summer winter spring autumn love sunshine princess football baseball shadow super hello freedom whatever company service system "
         "account name string hidden redacted insert replace enter todo").split()  # fmt: skip
MAX_WORD, MAX_UNIT = 16, 64
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Keys that a walk can start at, and ways to go on at a turn.
KEYS, WAYS = 40, 6
_LEET = str.maketrans("4301578$@!", "aeoistbsai")
_DATES = [
    re.compile(r"(?=((?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])))"),
    re.compile(r"(?=((?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d))"),
    re.compile(r"(?=((?:19|20)\d\d))"),
]
#: The way from a key to one beside it: along the row, or between rows.
_WAY = {x + y: 1 for row in KEYBOARD for x, y in zip(row, row[1:], strict=False)} | {x + y: 2 for up, down in zip(KEYBOARD, KEYBOARD[1:], strict=False) for x, y in zip(up, down, strict=False)}
_WAY |= {pair[::-1]: -way for pair, way in _WAY.items()}
_STEP = math.log10(2)


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


class Dictionary:
    """Words and their ranks: found in a text all at once, overlapping ones too."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.rank = {w: i + 1 for i, w in reversed(list(enumerate(words))) if 3 <= len(w) <= MAX_WORD}
        self._finder = ahocorasick.Automaton()
        for word, rank in self.rank.items():
            self._finder.add_word(word, (len(word), rank))
        if self.rank:
            self._finder.make_automaton()

    def found(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, rank)."""
        for last, (n, rank) in self._finder.iter(text) if self.rank else ():
            yield last + 1 - n, last + 1, rank


@functools.lru_cache(maxsize=4)
def dictionary(path: str | None = None) -> Dictionary:
    """WORDS, then the whole lower-case words of four letters or more that a tokenizer's vocabulary file holds, in its order."""
    words = list(WORDS)
    if path is not None:
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        words += [w for t in sorted(vocabulary, key=vocabulary.get) if re.fullmatch("Ġ[a-z]{4,}", t) for w in (t[1:],)]
    return Dictionary(words)


def _repeats(value: str) -> tuple[np.ndarray, np.ndarray]:
    """For each place where a repeat ends, its shortest unit's length and its turns, as many as there are; 0 elsewhere."""
    code = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    unit, turns = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for u in range(min(MAX_UNIT, n // 2), 0, -1):
        same = code[u:] == code[:-u]
        at = np.arange(n - u)
        run = at - np.maximum.accumulate(np.where(same, -1, at))  # characters up to here that equal the ones u before
        end = np.flatnonzero(run >= u)
        unit[end + u + 1], turns[end + u + 1] = u, run[end] // u + 1
    return unit, turns


def guess_cost(value: str, words: Dictionary | None = None, limit: float = math.inf) -> float:
    """log10 of the guesses for the cheapest segmentation; where that is limit or more, any number from limit on.

    A segment costs: a word its rank, twice that for capitals, four times for signs put for letters; a date 10**4;
    a repeat of at least two turns its unit's own cost times its turns; a walk of four keys or more on the keyboard the
    keys to start at times its length, and the ways to go on for each turn; a sequence of three letters or digits or
    more that follow each other the same without turns, and either twice for each change between capitals and others;
    brute force the alphabet of each character. Each segment other than brute force that doesn't start the value costs
    one further bit for the place where it starts.
    """
    words = dictionary() if words is None else words
    n, low = len(value), value.lower()
    if len(low) != n:  # letters whose small form is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    offers: dict[int, list[tuple[int, float]]] = {}
    reach = np.arange(n + 1)  # the first place where a segment starts that ends here

    def offer(start: int, end: int, cost: float) -> None:
        offers.setdefault(end, []).append((start, cost))
        reach[end] = min(reach[end], start)

    for start, end, rank in words.found(low):
        offer(start, end, math.log10(rank) + (0 if value[start:end] == low[start:end] else _STEP))
    if plain != low:
        for start, end, rank in words.found(plain):
            if plain[start:end] != low[start:end]:
                offer(start, end, math.log10(rank * 4))
    for pattern in _DATES:
        for m in pattern.finditer(low):
            offer(m.start(), m.end(1), 4.0)
    unit, turns = _repeats(value)
    reach = np.minimum(reach, np.arange(n + 1) - unit * turns)
    # The first place where a segment starts that ends behind here.
    ahead = np.append(np.minimum.accumulate(reach[::-1])[::-1][1:], n).tolist()
    unit, turns = unit.tolist(), turns.tolist()
    own: dict[str, float] = {}
    brute = {c: math.log10(_alphabet(c)) for c in set(value)}
    best, cheap = [0.0] * (n + 1), 0  # cheap: the last place that costs less than limit
    walk = turned = way = run = step = 0  # where the walk and the sequence that end here start
    shifts = walk_shifts = run_shifts = 0  # changes between capitals and others
    for j in range(1, n + 1):
        cost = best[j - 1] + brute[value[j - 1]]
        if j > 1:
            shift = value[j - 1].isupper() != value[j - 2].isupper()
            shifts += shift
            now = _WAY.get(low[j - 2 : j], 0)
            if not now:
                walk, turned, walk_shifts = j - 1, 0, shifts
            elif j - walk > 2 and now != way:
                turned += 1
            way = now
            now = ord(low[j - 1]) - ord(low[j - 2]) if brute[value[j - 1]] == brute[value[j - 2]] and low[j - 2 : j].isalnum() else 0
            if now not in (1, -1):
                run, run_shifts = j - 1, shifts
            elif now != step:
                run, run_shifts = j - 2, shifts - shift
            step = now
            if j - walk >= 4:
                cost = min(cost, best[walk] + math.log10(KEYS * (j - walk)) + turned * math.log10(WAYS) + (shifts - walk_shifts + (walk > 0)) * _STEP)
            if j - run >= 3:
                cost = min(cost, best[run] + math.log10(KEYS * (j - run)) + (shifts - run_shifts + (run > 0)) * _STEP)
        if u := unit[j]:
            part, start = value[j - u : j], j - u * turns[j]
            if part not in own:
                own[part] = guess_cost(part, words)
            cost = min(cost, best[start] + own[part] + math.log10(turns[j]) + (_STEP if start else 0))
        for start, more in offers.get(j, ()):
            cost = min(cost, best[start] + more + (_STEP if start else 0))
        best[j] = cost
        if cost < limit:
            cheap = j
        elif cheap < min(ahead[j], walk, run):  # all that follows starts from places that cost as much
            return cost
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if _LONG_HEX.search(text):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    return sorted(out)


def _prose(value: str) -> bool:
    """A word of letters alone, of which at most the first is a capital."""
    return value.isalpha() and value[1:] == value[1:].lower()


def guess_spans(text: str, min_guesses: float = MIN_GUESSES, words: Dictionary | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the values in a credential's context that are hard to guess."""
    if not _CUE.search(text):
        return []
    out, end = [], 0
    # The search goes on behind a cue, not behind what follows it: that may be a cue itself.
    for m in _CONTEXT.finditer(text):
        at = m.end()
        if at < end or _CONTEXT.match(text, at):
            continue
        value = _VALUE.match(text, at)[0].rstrip(".,;:!?)]}")
        # Behind a mere space plain words are prose; anything else is judged by its cost.
        if len(value) >= 8 and not (m[1].isspace() and _prose(value)) and guess_cost(value, words, min_guesses) >= min_guesses:
            end = at + len(value)
            out.append((at, 3, end))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"


def _scanner(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary(path)
        for batch in slices(batches):
            rows = []
            for text in batch["text"].to_pylist():
                text = text or ""
                base, more = base_spans(text), guess_spans(text, words=words)
                n = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return run


def scan_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Counts, a digest of the patterns' spans, and all spans of every document. ``vocabulary`` names a tokenizer's file to take words from."""
    rows = pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(_scanner(vocabulary), SCHEMA)
