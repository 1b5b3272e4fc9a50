"""Evaluation texts inside a training corpus, found with an FM-index per shard (problem 9).

Texts and test items are reduced to words (markup, case, comment signs, line breaks and hyphenation removed). The
words of a shard of documents, as numbers of the items' vocabulary, are indexed: suffix array, Burrows-Wheeler
transform in a wavelet tree, and every SAMPLE-th suffix position. All neighbouring word pairs of all items are
searched backwards at once through the tree's ranks, which also tells how often each stands in the shard. Of every
item the rarer pairs are located by walking to the next sampled position; occurrences that lie on nearly one diagonal
are merged into spans. A span is confirmed when the longest common subsequence of its words with the item's has at
least half of the item's words.

What is sure to be found: a passage with half of the item's words in order of which a quarter of the item's pairs (KEPT)
stand side by side, be it half of the item in one piece or three quarters of it with every third word replaced. Of an
item with m pairs, of which a passage keeps k, any m - k + h have at least h in common with the passage, so the most
frequent k - h pairs need not be located. Items of fewer than SHORT words are found where all their words stand in a row.

What the index leaves out holds no pair: words of no item become separators, and lone item words fall away (unless an
item has one word). Shards are bounded by characters and run independently; the items (a fixed table, its size is
checked) go to every task.

Defined cases: null, empty and blank documents and items contain nothing; a repeated document is reported under each
of its ids, a repeated (doc_id, item) once; a document that holds an item several times has a span for each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hydroframe.plans.io import only

#: Items of fewer words are searched as they stand.
SHORT = 6
#: Shares of an item's pairs that a passage keeps, and that must be found on one diagonal before words are compared.
KEPT, FOUND = 0.25, 0.125
#: Located pairs that are sorted at once; beyond, items are worked through in turn.
MAX_PAIRS = 4_000_000
#: Words that a passage may be displaced by dropped and inserted ones, as a share of the item's.
SLACK = 0.3
#: Share of the item's words that a passage reproduces in order.
SHARE = 0.5
#: Distance of sampled suffix positions.
SAMPLE = 8
#: Characters of a shard.
SHARD_CHARS = 16_000_000
#: Items that a benchmark may have; they are held by every task.
MAX_ITEMS = 100_000

_HYPHEN = re.compile(r"(?<=\w)(?:-|\\-)[ \t]*\r?\n[ \t]*(?:%+[ \t]*)?(?=[^\W\d_])|\\-")
_COMMAND = re.compile(r"\\(?:[a-zA-Z@]+\*?|.)(?:\[[^\]\n]*\])?")
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[\u200b\u00ad\u200c\u200d\ufeff]")
_CLUSTER = regex.compile(r"\r\n|\X")


def words(text: str | None) -> list[str]:
    """Words of a text in order, without markup, case and compatibility forms."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "-" in text:
        text = _HYPHEN.sub("", text)
    if "\\" in text:
        text = _COMMAND.sub(" ", text)
    return _WORD.findall(text.lower())


def word_places(text: str) -> list[tuple[int, int]]:
    """(first character, last + 1) in the text of each of its words(); for the few documents with a passage."""
    parts, start = [], []
    at = 0
    for cluster in _CLUSTER.findall(text):
        plain = cluster.lower() if cluster.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", cluster)).lower()
        parts.append(plain)
        start += [at] * len(plain)
        at += len(cluster)
    t, place = "".join(parts), start

    def without(t: str, place: list[int], pattern: re.Pattern, instead: str) -> tuple[str, list[int]]:
        out, kept, last = [], [], 0
        for m in pattern.finditer(t):
            out += [t[last : m.start()], instead]
            kept += place[last : m.start()] + place[m.start() : m.start() + 1] * len(instead)
            last = m.end()
        return "".join([*out, t[last:]]), kept + place[last:]

    t, place = without(t, place, _HYPHEN, "")
    t, place = without(t, place, _COMMAND, " ")
    return [(place[m.start()], place[m.end() - 1] + 1) for m in _WORD.finditer(t)]


class WaveletTree:
    """Bit planes of a sequence, stably partitioned from the highest bit down (a wavelet matrix), with ranks."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.planes, self.zeros = bits, [], []
        s = symbols
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            self.planes.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(s) - int(bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol occurs before position at, elementwise."""
        low, high = np.zeros_like(at), at.copy()
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = plane[low], plane[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at a position, its rank there), elementwise."""
        symbol, low, high = np.zeros_like(at), np.zeros_like(at), at.copy()
        for plane, zeros in zip(self.planes, self.zeros):
            bit = plane[high + 1] - plane[high]
            a, b = plane[low], plane[high]
            low, high = np.where(bit == 1, zeros + a, low - a), np.where(bit == 1, zeros + b, high - b)
            symbol = symbol * 2 + bit
        return symbol, high - low


class FMIndex:
    """FM-index over a sequence of positive symbols; 0 ends it."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        t = np.concatenate([symbols, [0]]).astype(np.int64)
        n = len(t)
        rank = t.copy()
        width = 1
        order = np.argsort(rank, kind="stable")
        while True:  # prefix doubling, until all suffixes differ
            second = np.zeros(n, np.int64)
            second[: n - width] = rank[width:] + 1
            key = rank * (rank.max() + 2) + second
            order = np.argsort(key, kind="stable")
            step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = step
            if step[-1] == n - 1 or width >= n:
                break
            width *= 2
        self.n = n
        self.tree = WaveletTree(t[order - 1], max(int(alphabet).bit_length(), 1))
        counts = np.bincount(t, minlength=alphabet + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.sampled = np.full(n, -1, np.int64)
        here = (order % SAMPLE == 0) | (order == n - 1)
        self.sampled[here] = order[here]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges (from, to) of every row of phrases, by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            low, high = self.before[c] + self.tree.rank(c, low), self.before[c] + self.tree.rank(c, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, walking back to sampled ones."""
        at, walked = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(self.sampled[at] < 0)
        while len(todo):
            symbol, r = self.tree.access(at[todo])
            at[todo] = self.before[symbol] + r
            walked[todo] += 1
            todo = todo[self.sampled[at[todo]] < 0]
        return self.sampled[at] + walked


class Items:
    """Test items as numbers of their common vocabulary, with all their pairs and short phrases."""

    def __init__(self, rows: list[tuple[int, str | None]]) -> None:
        self.ids = [i for i, _ in rows]
        texts = [words(t) for _, t in rows]
        self.number: dict[str, int] = {}
        for t in texts:
            for w in t:
                self.number.setdefault(w, len(self.number) + 2)  # 1 is the separator
        self.texts = [[self.number[w] for w in t] for t in texts]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        pairs: dict[tuple, list[tuple[int, int]]] = {}
        self.whole: dict[int, tuple[list[int], np.ndarray]] = {}  # by length: items, phrases
        for k, t in enumerate(self.texts):
            if len(t) >= SHORT:
                for p in range(len(t) - 1):
                    pairs.setdefault((t[p], t[p + 1]), []).append((k, p))
        for n in range(1, SHORT):
            if short := [k for k, t in enumerate(self.texts) if len(t) == n]:
                self.whole[n] = short, np.array([self.texts[k] for k in short], np.int64)
        self.pairs = np.array(list(pairs), np.int64).reshape(-1, 2)
        # One row per pair and place in an item: number of the pair, item, offset; in the order of items.
        rows_ = sorted((k, o, p) for p, owned in enumerate(pairs.values()) for k, o in owned)
        self.item, self.offset, self.pair = (np.array([r[c] for r in rows_], np.int64) for c in range(3))
        m = np.maximum(self.sizes - 1, 1)
        self.least = np.maximum(np.ceil(FOUND * m).astype(np.int64), 1)
        self.asked = m - np.maximum(np.floor(KEPT * m).astype(np.int64), self.least) + self.least
        self.slack = np.maximum((SLACK * self.sizes).astype(np.int64), 2)
        self.shortest = min((n for n in self.whole), default=2)
        self.masks: list[dict[int, int]] = []
        for t in self.texts:
            mask: dict[int, int] = {}
            for p, x in enumerate(t):
                mask[x] = mask.get(x, 0) | 1 << p
            self.masks.append(mask)

    def rarest(self, frequency: np.ndarray) -> np.ndarray:
        """The rows to locate: of every item as many as must be, the rarest pairs first."""
        order = np.lexsort((self.offset, frequency[self.pair], self.item))
        first = np.searchsorted(self.item[order], np.arange(len(self.ids)))
        rank = np.arange(len(order)) - first[self.item[order]]
        return np.sort(order[rank < self.asked[self.item[order]]])


def longest_common(masks: dict[int, int], size: int, part: list[int]) -> int:
    """Length of the longest common subsequence with an item of size words, by bit-parallel columns.

    masks has the positions of each of the item's words as bits.
    """
    full = (1 << size) - 1
    v = full
    for x in part:
        if m := masks.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


Span = tuple[int, int, int]  # matched words, first word, last word + 1


def _extend(text: list[int], item: list[int], word: int, offset: int, step: int) -> int:
    """The last word that still matches the item, going on from a matching one; single replaced words are passed over."""
    last = word
    for ahead in range(1, len(item)):
        w, o = word + step * ahead, offset + step * ahead
        if not (0 <= w < len(text) and 0 <= o < len(item)) or abs(w - last) > 2:
            break
        if text[w] == item[o]:
            last = w
    return last


def _spans(items: Items, item: int, text: list[int], word: np.ndarray, offset: np.ndarray) -> list[Span]:
    """The confirmed spans of one item in one document, from its located pairs in the order of their diagonals."""
    size, slack, least = int(items.sizes[item]), int(items.slack[item]), int(items.least[item])
    diagonal = word - offset  # a passage keeps its words near one
    found: list[Span] = []
    k = 0
    while k < len(word):
        end = int(np.searchsorted(diagonal, diagonal[k] + 2 * slack, "right"))
        if len(np.unique(offset[k:end])) >= least:
            first, last = max(int(diagonal[k]) - slack, 0), int(diagonal[end - 1]) + size + slack
            n = longest_common(items.masks[item], size, text[first:last])
            if n >= SHARE * size:
                i, j = k + int(word[k:end].argmin()), k + int(word[k:end].argmax())
                begun, ended = _extend(text, items.texts[item], int(word[i]), int(offset[i]), -1), _extend(text, items.texts[item], int(word[j]), int(offset[j]), 1)
                found.append((n, begun, ended + 1))
        k = max(int(np.searchsorted(diagonal, diagonal[k] + slack, "right")), k + 1)
    out: list[Span] = []
    for n, a, b in sorted(found, key=lambda s: s[1:]):
        if out and a < out[-1][2]:
            out[-1] = (max(n, out[-1][0]), out[-1][1], max(b, out[-1][2]))
        else:
            out.append((n, a, b))
    return out


def search_shard(items: Items, docs: list[tuple[int, str | None]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(doc_id, item_id, matched words, first word, last word + 1, first character, last character + 1) of every
    confirmed span."""
    number, texts, symbols, where = items.number, [], [], []
    for k, (_, text) in enumerate(docs):
        found = [number.get(w, 1) for w in words(text)]
        texts.append(found)
        a = np.array(found, np.int64)
        known = np.concatenate([[False], a > 1, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= min(items.shortest, 2)
        if long.any():
            # Every run with one separator behind it.
            mark = np.zeros(len(a) + 1, np.int64)
            np.add.at(mark, begin[long], 1)
            np.add.at(mark, end[long], -1)
            at = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            breaks = np.flatnonzero(np.diff(at) > 1) + 1
            symbols += [np.insert(a[at], breaks, 1), [1]]
            where += [np.insert(at + (k << 32), breaks, -1), [-1]]
    if not symbols:
        return []
    text, place = np.concatenate(symbols), np.concatenate(where)
    index = FMIndex(text, len(number) + 2)
    spans: dict[tuple[int, int], list[Span]] = {}
    for n, (short, phrases) in items.whole.items():
        low, high = index.search(phrases)
        for k, a, b in zip(short, low.tolist(), high.tolist()):
            for at in place[index.locate(np.arange(a, max(a, b)))].tolist():
                spans.setdefault((at >> 32, k), []).append((n, at & 0xFFFFFFFF, (at & 0xFFFFFFFF) + n))
    if len(items.pairs):
        low, high = index.search(items.pairs)
        frequency = np.maximum(high - low, 0)
        rows = items.rarest(frequency)
        load = np.bincount(items.item[rows], frequency[items.pair[rows]], minlength=len(items.ids)).cumsum()
        block = (load // MAX_PAIRS)[items.item[rows]]
        for number_ in np.unique(block):
            part = rows[block == number_]
            # Every pair is located once, then given to its owners.
            used, owner = np.unique(items.pair[part], return_inverse=True)
            n = frequency[used]
            start = np.concatenate([[0], np.cumsum(n)])
            span_rows = np.repeat(low[used] - start[:-1], n) + np.arange(start[-1])
            at = place[index.locate(span_rows)] if len(span_rows) else span_rows
            times = n[owner]
            shift = np.concatenate([[0], np.cumsum(times)])
            mine = np.repeat(np.arange(len(part)), times)
            hit = at[np.repeat(start[:-1][owner] - shift[:-1], times) + np.arange(shift[-1])]
            doc, word = hit >> 32, hit & 0xFFFFFFFF
            item, offset = items.item[part][mine], items.offset[part][mine]
            key = (doc * len(items.ids) + item << 33) + word - offset + (1 << 32)
            order = np.argsort(key, kind="stable")
            key, word, offset, item, doc = key[order], word[order], offset[order], item[order], doc[order]
            # Only groups with enough located pairs on nearly one diagonal are looked at.
            reach = np.searchsorted(key, key + 2 * items.slack[item], "right") - np.arange(len(key))
            group = key >> 33
            for g in np.unique(group[reach >= items.least[item]]):
                i, j = np.searchsorted(group, [g, g + 1])
                if got := _spans(items, int(item[i]), texts[doc[i]], word[i:j], offset[i:j]):
                    spans[int(doc[i]), int(item[i])] = got
    out = []
    places: dict[int, list[tuple[int, int]]] = {}
    for (doc, item), found in sorted(spans.items()):
        if doc not in places:
            places = {doc: word_places(docs[doc][1])}
        for n, first, end in found:
            exact = len(places[doc]) == len(texts[doc])
            out.append((docs[doc][0], items.ids[item], n, first, end, places[doc][first][0] if exact else None, places[doc][end - 1][1] if exact else None))
    return out


def load_items(benchmark: DataFrame) -> Items:
    """The items, collected; refused beyond MAX_ITEMS."""
    rows = only(benchmark, "item_id", "text").limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"a benchmark has at most {MAX_ITEMS} items")
    return Items([(r[0], r[1]) for r in rows])


def leaked_spans(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, first_word, end_word, first_char, end_char) of every passage, in words of words() and
    characters of the text; no shuffle of the corpus."""
    items = load_items(benchmark)
    names = ["doc_id", "item_id", "n_words", "first_word", "end_word", "first_char", "end_char"]

    def frame(docs: list[tuple[int, str | None]]) -> pa.RecordBatch:
        found = search_shard(items, docs)
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(len(names))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                docs.append((doc_id.as_py(), text.as_py()))
                size += len(docs[-1][1] or "")
                if size >= SHARD_CHARS:
                    yield frame(docs)
                    docs, size = [], 0
        if docs:
            yield frame(docs)

    return only(documents, "doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document with a passage of the item."""
    return leaked_spans(documents, benchmark).select("doc_id", "item_id").distinct()
