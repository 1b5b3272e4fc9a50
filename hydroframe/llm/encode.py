"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

Token lists form a monoid: the ids of a text are reduced from the ids of its halves. Joining two neighbours re-encodes
a window around their border that grows on both sides until it begins and ends at a settled cut, a place where the
pre-tokenizer splits whatever stands elsewhere; the tokens outside of the window are then provably final and are
kept. Decoding concatenates the tokens' bytes up the same tree.

Defined cases: null and empty texts give the empty list; blank texts are encoded as they are; strings of special
tokens are ordinary text; repeated rows come out as often as they come in.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hydroframe.plans.io import only

#: Vocabulary file; a parameter of every function below.
RANKS_FILE = os.environ.get("HYDROFRAME_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Characters up to which a text is encoded in one piece.
LEAF = 2048
#: First width of the window on either side of a border; it doubles until it meets a settled cut.
WINDOW = 32

# The pre-tokenizer's pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# A word character is never in one piece with a following blank or punctuation mark: the pattern's classes are disjoint,
# and a piece continues only within its class. The sets are small ones whose class no Unicode version disputes.
_SETTLED = re.compile(r"(?<=[A-Za-z0-9一-龥])(?=[ \n\t\r.,;:(){}\[\]\\$%&=+/|<>\"_^~*。，])")


class Monoid:
    """The token monoid of one vocabulary."""

    def __init__(self, ranks_file: str = RANKS_FILE) -> None:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    def leaf(self, text: str) -> np.ndarray:
        """Ids of a text that is encoded in one piece."""
        return np.array(self.encoding.encode_ordinary(text), np.int32)

    def join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """Ids of left + right from those of both."""
        if not len(a) or not len(b):
            return b if not len(a) else a
        width = WINDOW
        while True:
            start = max(len(left) - width, 0)
            cuts = [m.start() for m in _SETTLED.finditer(left, max(start, 1), len(left))]
            if cuts or start == 0:
                start = cuts[-1] if cuts else 0
                break
            width *= 2
        width = WINDOW
        while True:
            cut = _SETTLED.search(right, 1, min(width, len(right)))
            if cut or width >= len(right):
                end = cut.start() if cut else len(right)
                break
            width *= 2
        window = self.leaf(left[start:] + right[:end])
        keep = self._tokens(a[::-1], len(left[start:].encode()))
        skip = self._tokens(b, len(right[:end].encode()))
        return np.concatenate([a[: len(a) - keep], window, b[skip:]])

    def _tokens(self, ids: np.ndarray, size: int) -> int:
        """How many leading tokens make up size bytes."""
        step = 64
        while True:
            total = np.cumsum(self.size[ids[:step]])
            if step >= len(ids) or total[-1] >= size:
                n = int(np.searchsorted(total, size)) + 1 if size else 0
                if n and total[n - 1] != size:
                    raise AssertionError("a settled cut lies inside a token")
                return n
            step *= 4

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of text by reduction over its halves, with a stack of partial sums instead of recursion."""
        if not text:
            return np.zeros(0, np.int32)
        if len(text) <= LEAF:
            return self.leaf(text)
        stack: list[tuple[int, str, np.ndarray]] = []
        for k in range(0, len(text), LEAF):
            part = text[k : k + LEAF]
            node = (0, part, self.leaf(part))
            while stack and stack[-1][0] == node[0]:
                level, before, ids = stack.pop()
                node = (level + 1, before + node[1], self.join(before, ids, node[1], node[2]))
            stack.append(node)
        while len(stack) > 1:
            (_, right, b), (level, left, a) = stack.pop(), stack.pop()
            stack.append((level, left + right, self.join(left, a, right, b)))
        return stack[0][2]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: their bytes, concatenated up the tree."""
        parts = [self.encoding.decode_single_token_bytes(int(i)) for i in ids]
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0].decode("utf-8") if parts else ""


_MONOIDS: dict[str, Monoid] = {}


def monoid(ranks_file: str = RANKS_FILE) -> Monoid:
    """The monoid of a vocabulary file, built once per process."""
    if ranks_file not in _MONOIDS:
        _MONOIDS[ranks_file] = Monoid(ranks_file)
    return _MONOIDS[ranks_file]


def encode_corpus(documents: DataFrame, ranks_file: str = RANKS_FILE) -> DataFrame:
    """(doc_id, ids) of every document; no shuffle, one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = monoid(ranks_file)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = [m.encode(t.as_py()) for t in part.column(1)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "ids"])

    return only(documents, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
