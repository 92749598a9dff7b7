"""Cost-balanced packing of documents into sequences of bounded length."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, sequence_cost double, ids binary"
)
#: The split pattern and the special token of the byte-level vocabulary.
SPLIT_PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
SPECIAL = {"<|endoftext|>": 50256}

_encodings: dict[str, object] = {}


def vocabulary_path() -> str:
    """Rank file of the 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoding(path: str | None):
    path = path or vocabulary_path()
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding(
            "byte_bpe", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL
        )
    return _encodings[path]


def sequence_cost(tokens, linear: float, quadratic: float):
    """Cost of a document of so many tokens: a linear and an attention part."""
    return linear * tokens + quadratic * tokens * tokens


def plan_group(
    lengths: list[int], capacity: int, linear: float, quadratic: float
) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of the group once.

    Whole multiples of ``capacity`` are sequences of their own. The remainders,
    longest first, go to the sequence of lowest cost with room for them; one that
    fits nowhere is cut to fill the room that is left. What is over, less than
    ``capacity`` tokens, becomes sequences whose lengths are powers of two.
    """
    sequences: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        whole = n // capacity * capacity
        sequences += [[(doc, at, capacity)] for at in range(0, whole, capacity)]
        if n > whole:
            rest.append((doc, whole, n - whole))
    rest.sort(key=lambda piece: (-piece[2], piece[0]))
    count = sum(piece[2] for piece in rest) // capacity
    open_ones: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    cost = np.zeros(count)
    room = np.full(count, capacity, np.int64)
    over: list[tuple[int, int, int]] = []
    for doc, start, n in rest:
        best = int(np.argmin(np.where(room >= n, cost, np.inf))) if count else -1
        if best < 0 or room[best] < n:
            over.append((doc, start, n))
            continue
        open_ones[best].append((doc, start, n))
        room[best] -= n
        cost[best] += sequence_cost(n, linear, quadratic)
    gaps = [(k, int(room[k])) for k in np.flatnonzero(room)]
    tail = sum(piece[2] for piece in over) - sum(n for _, n in gaps)
    for bit in range(capacity.bit_length() - 1, -1, -1):
        if tail >> bit & 1:
            gaps.append((len(open_ones), 1 << bit))
            open_ones.append([])
    pieces = iter(over)
    doc, start, n = next(pieces, (0, 0, 0))
    for k, free in gaps:
        while free:
            if not n:
                doc, start, n = next(pieces)
            part = min(n, free)
            open_ones[k].append((doc, start, part))
            start, n, free = start + part, n - part, free - part
    return sequences + open_ones


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 2048,
    end_id: int = 1,
    vocabulary: str | None = None,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    group_tokens: int = 1 << 20,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, with its ids.

    Documents are tokenised and packed as they are read, in groups of about
    ``group_tokens`` tokens, so nothing is shuffled and a task holds one group.
    ``ids`` are little-endian unsigned 32-bit numbers. A document ends with
    ``end_id``; a null or empty text is that id alone. Rows with the same id are
    separate documents; other columns are left out. An empty table gives no rows.
    """
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_to_numpy
        base = TaskContext.get().partitionId() << 32
        ids: list = []
        tokens: list[np.ndarray] = []
        held = used = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, used
            plan = plan_group([len(t) for t in tokens], max_tokens, linear, quadratic)
            rows: list[list] = [[] for _ in range(9)]
            for number, sequence in enumerate(plan):
                offset = 0
                length = sum(n for _, _, n in sequence)
                cost = float(sum(sequence_cost(n, linear, quadratic) for _, _, n in sequence))
                for doc, start, n in sequence:
                    values = tokens[doc][start : start + n].astype("<u4").tobytes()
                    row = (ids[doc], start, n, len(tokens[doc]), base + used + number)
                    for column, value in zip(
                        rows, (*row, offset, length, cost, values), strict=True
                    ):
                        column.append(value)
                    offset += n
            used += len(plan)
            ids.clear()
            tokens.clear()
            held = 0
            kinds = [pa.int64()] * 7 + [pa.float64(), pa.binary()]
            names = [field.split(" ")[0] for field in PIECE_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = encode(text.as_py() or "", allowed_special="all")
                ids.append(doc_id.as_py())
                tokens.append(np.append(found, np.uint32(end_id)))
                held += len(found) + 1
                if held >= group_tokens:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        pack, PIECE_SCHEMA
    )
