"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A piece of n tokens costs ``n + quadratic * n * n / length``: its linear work and its attention to
itself. Documents are packed a window of tokens at a time, in the task that encodes them, so nothing
is shuffled. A document's full lengths are sequences of their own; what remains goes, largest
first, to the sequence of the window with the lowest cost that still has room. As many sequences
are opened as the remainders fill, so a window has less than one sequence of padding; a remainder
that no sequence has room for is cut over those with the most room.

Defined results: a null text is empty, and a document without tokens is its end id alone; repeated
rows are packed each; a document longer than a window makes a window of its own; an empty table
gives no rows; other columns aren't read. sequence_id is unique over the table and gapless within a
task's split of the input, so a task that is run again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treelens.llm import tokens
from treelens.llm.common import pick, slices

LENGTH, QUADRATIC, WINDOW = 2048, 1.0, 1 << 21
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n: np.ndarray | int, length: int = LENGTH, quadratic: float = QUADRATIC):
    return n + quadratic * n * n / length


def pack(lengths: np.ndarray, length: int = LENGTH, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, n, sequence, offset) of every piece; lengths are the documents' tokens."""
    pieces, sequence = [], 0
    for i, n in enumerate(lengths.tolist()):
        for start in range(0, n - length + 1, length):
            pieces.append((i, start, length, sequence, 0))
            sequence += 1
    rest = lengths % length
    n_bins = int(-(-rest.sum() // length))
    room = np.full(n_bins, length, np.int64)
    load = np.zeros(n_bins)
    for i in np.argsort(-rest, kind="stable").tolist():
        need, start = int(rest[i]), int(lengths[i] - rest[i])
        while need:
            fits = room >= need
            if fits.any():
                b, n = int(np.where(fits, load, np.inf).argmin()), need
            else:  # cut: fill the sequence with the most room, of these the cheapest
                b = int(np.where(room == room.max(), load, np.inf).argmin())
                n = int(room[b])
            pieces.append((i, start, n, sequence + b, length - int(room[b])))
            room[b] -= n
            load[b] += cost(n, length, quadratic)
            start += n
            need -= n
    return pieces


def _packer(path: str, end_id: int, length: int, quadratic: float, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokens.encoder(path).encode_column
        base = TaskContext.get().partitionId() << 32
        held: list[tuple[object, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, size
            lengths = np.array([len(ids) for _, ids in held], np.int64)
            rows = pack(lengths, length, quadratic)
            parts = [held[i][1][start : start + n] for i, start, n, _, _ in rows]
            columns = [
                pa.array([held[r[0]][0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                pa.array([tokens.crc(p) for p in parts], pa.int64()), pa.array([int(lengths[r[0]]) for r in rows], pa.int64()),
                pa.array([base + r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
            ]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            if with_ids:
                columns, names = [*columns, pa.array([p.astype("int32") for p in parts], pa.list_(pa.int32()))], [*names, "ids"]
            base += 1 + max(r[3] for r in rows)
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in slices(batches):
            ids, counts = encode(batch["text"])
            begin = 0
            for doc_id, n in zip(batch["doc_id"].to_pylist(), counts.tolist(), strict=True):
                if held and size + n + 1 > window:
                    yield flush()
                held.append((doc_id, np.append(ids[begin : begin + n], np.uint32(end_id))))
                begin += n
                size += n + 1
        if held:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, quadratic: float = QUADRATIC, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the piece's token ids, to be written as training sequences."""
    rows = pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(_packer(tokenizer, end_id, length, quadratic, window, with_ids), SCHEMA + (", ids array<int>" if with_ids else ""))
