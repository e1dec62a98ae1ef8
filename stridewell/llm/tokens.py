"""Byte-level BPE of whole texts with a public rank file.

A text is cut by the tokenizer's pattern into pieces, and no merge crosses a piece. Within a piece, a segment tree over
the byte positions holds, for every live part, the rank of its pair with the next part, and gives the leftmost pair of
the lowest rank at its root. A merge makes one part of two and updates the tree at three positions, so a piece of n
bytes takes n log n steps however long it is. Pieces seen before come from a bounded cache.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..common import require_columns

#: Where the public tokenizer files are, unless a path is given.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
# The pattern that belongs to the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_PIECES = 200_000
CACHE_PIECE_CHARS = 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1
    while size < n:
        size *= 2
    none = 1 << 62
    # a leaf is rank * size + position, so that the smallest is the leftmost of the lowest rank
    tree = [none] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))  # start of the next part
    before = list(range(-1, n - 1))
    while (best := tree[1]) != none:
        i = best % size
        j = after[i]
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
        changed = [(j, none)]
        r = get(piece[i : after[k]]) if k < n else None
        changed.append((i, none if r is None else r * size + i))
        h = before[i]
        if h >= 0:
            r = get(piece[h:k])
            changed.append((h, none if r is None else r * size + h))
        for at, value in changed:
            at += size
            tree[at] = value
            while at > 1:
                at >>= 1
                a, b = tree[2 * at], tree[2 * at + 1]
                low = a if a < b else b
                if tree[at] == low:
                    break
                tree[at] = low
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Ids of texts; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks, self.cache = ranks, {}
        # \s of the rank files' library is Unicode white space, without the separators 1C to 1F
        self.find = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall

    def encode(self, text: str, out: array) -> None:
        cache = self.cache
        for piece in self.find(text):
            ids = cache.get(piece)
            if ids is None:
                ids = array("i", merge_piece(piece.encode(), self.ranks))
                if len(piece) <= CACHE_PIECE_CHARS:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out.extend(ids)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str, ranks) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, pattern] = Encoder(ranks.value, pattern)
    return _ENCODERS[path, pattern]


def _texts(column: pa.Array) -> Iterator[str]:
    for x in column:
        yield x.as_py() or ""


def token_ids(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """doc_id and ids, the list of token ids of each document's whole text; an empty list for an empty or null text.

    A row per row: null and repeated doc_ids are kept. The rank file (`path`) is read by the driver and sent to the
    workers; its size doesn't depend on the data. `pattern` cuts texts into pieces; it belongs to the rank file. An empty table gives no rows; other columns are ignored.
    """
    return _encoded(documents, text, doc_id, path, pattern, True)


def token_counts(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """doc_id and n_tokens (bigint), the length of the list that token_ids gives."""
    return _encoded(documents, text, doc_id, path, pattern, False)


def _encoded(documents: DataFrame, text: str, doc_id: str, path: str | None, pattern: str, with_ids: bool) -> DataFrame:
    require_columns(documents, text, doc_id)
    path = path or os.path.join(FOLDER, "byte_bpe_50k.tiktoken")
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern, ranks)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                flat, ends = array("i"), [0]
                sizes = []
                for x in _texts(batch.column(1)):
                    encoder.encode(x, flat)
                    if with_ids:
                        ends.append(len(flat))
                    else:
                        sizes.append(len(flat))
                        del flat[:]
                if with_ids:
                    second = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.zeros(0, np.int32)))
                else:
                    second = pa.array(sizes, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), second], names=[doc_id, "ids" if with_ids else "n_tokens"])

    rows = documents.select(doc_id, text)
    kind = dict(rows.dtypes)[doc_id]
    return rows.mapInArrow(run, f"`{doc_id}` {kind}, " + ("ids array<int>" if with_ids else "n_tokens bigint"))
