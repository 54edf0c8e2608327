"""Byte-level BPE encoding with vectorised pre-tokenisation.

The texts of a batch become one array of code points and one array of their classes. A class already tells what the
next code point is where the pre-token pattern looks ahead. Each class is a function from states to states; such
functions compose associatively, so blocks are composed side by side, block results are combined by a doubling scan, and
a second pass marks every position at which a pre-token begins. No regular expression is run over text. The slices go
through a cache to pair merging by rank. Their offsets can be kept, which allows decoding slice by slice.

Cases: null and empty text give an empty list. Strings that look like special tokens are ordinary text. Texts of any
length are encoded whole. Repeated ids or texts are encoded each. Unpaired surrogates can not occur in Spark strings.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import spread

#: Folder of the vocabulary files; a parameter of every operator that needs one.
TOKENIZERS = os.environ.get("CORPUSCLE_TOKENIZERS", "/opt/tokenizers")

# classes of code points
(LETTER, L_ONE, L_TWO, NUMBER, APOS, OTHER, WS_MORE, WS_SPACE, WS_LAST, RESET, PAD) = range(11)
# states
(START, IN_LETTER, IN_NUMBER, IN_OTHER, IN_WS, SPACE, QUOTE, QUOTE_MORE) = range(8)

WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _base_classes() -> np.ndarray:
    """Class of every code point, apart from what depends on the next one."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            out[cp] = LETTER
        elif c == "N":
            out[cp] = NUMBER
    out[WHITE] = WS_MORE
    out[ord("'")] = APOS
    return out


@functools.cache
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and 'a pre-token begins here', by class and state."""
    nxt = np.zeros((11, 8), np.uint8)
    cut = np.zeros((11, 8), bool)
    run = {LETTER: IN_LETTER, L_ONE: IN_LETTER, L_TWO: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER, APOS: IN_OTHER}
    for cls in range(11):
        for s in range(8):
            if cls == PAD:
                nxt[cls, s] = s
            elif cls == RESET:
                nxt[cls, s], cut[cls, s] = START, True
            elif s == QUOTE_MORE:  # the second letter of 're 've 'll
                nxt[cls, s] = START
            elif s == QUOTE and cls == L_ONE:
                nxt[cls, s] = START
            elif s == QUOTE and cls == L_TWO:
                nxt[cls, s] = QUOTE_MORE
            elif cls in (WS_MORE, WS_SPACE, WS_LAST):
                nxt[cls, s] = {WS_MORE: IN_WS, WS_SPACE: SPACE, WS_LAST: START}[cls]
                cut[cls, s] = not (cls == WS_MORE and s == IN_WS)
            elif cls == APOS and s not in (SPACE, IN_OTHER, QUOTE):
                nxt[cls, s], cut[cls, s] = QUOTE, True
            else:
                nxt[cls, s] = run[cls]
                same = s == run[cls] or s == SPACE or s == QUOTE and run[cls] == IN_OTHER
                cut[cls, s] = not same
    return nxt, cut


def classes(cp: np.ndarray) -> np.ndarray:
    """Class of each code point; 0x110000 stands between texts."""
    sep = cp == 0x110000
    cls = _base_classes()[np.where(sep, 0, cp)]
    cls[sep] = RESET
    after = np.empty_like(cp)
    after[:-1], after[-1] = cp[1:], 0x110000
    nxt = np.empty_like(cls)
    nxt[:-1], nxt[-1] = cls[1:], RESET
    last = (cls == WS_MORE) & (nxt != WS_MORE) & (nxt != RESET)
    cls[last & (cp == 32)] = WS_SPACE
    cls[last & (cp != 32)] = WS_LAST
    small = cp < 128
    cls[small & np.isin(cp, [ord(c) for c in "stmd"])] = L_ONE
    two = ((cp == ord("r")) | (cp == ord("v"))) & (after == ord("e")) | (cp == ord("l")) & (after == ord("l"))
    cls[two] = L_TWO
    return cls


def pretoken_starts(cp: np.ndarray, block: int = 256) -> np.ndarray:
    """Positions in ``cp`` at which a pre-token (or a separator) begins."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    nxt, cut = _machine()
    states = nxt.shape[1]
    rows = -(-n // block)
    cls = np.full(rows * block, PAD, np.uint8)
    cls[:n] = classes(cp)
    cols = np.ascontiguousarray(cls.reshape(rows, block).T)
    flat, flat_cut = nxt.ravel(), cut.ravel()
    # 1: the function of each block, all blocks side by side
    f = np.tile(np.arange(states, dtype=np.uint8), (rows, 1))
    base = cols.astype(np.uint16) * states
    for k in range(block):
        f = flat[base[k][:, None] + f]
    # 2: inclusive scan of block functions by doubling
    d = 1
    while d < rows:
        f[d:] = np.take_along_axis(f[d:], f[:-d].copy(), 1)
        d *= 2
    # 3: every block again, now from its true state
    state = np.concatenate([[START], f[:-1, START]]).astype(np.uint8)
    marks = np.empty((block, rows), bool)
    for k in range(block):
        at = base[k] + state
        marks[k] = flat_cut[at]
        state = flat[at]
    return np.flatnonzero(marks.T.ravel()[:n])


class Vocabulary:
    """Ranks of a tiktoken file, with cached pair merging."""

    def __init__(self, path: str, cache_size: int = 500_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.cache: dict[str, list[int]] = {}
        self.cache_size = cache_size

    def merge(self, data: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        parts = [data[i : i + 1] for i in range(len(data))]
        if len(parts) > 100:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same merges in O(n log n): a heap of pairs over a linked list."""
        ranks, n = self.ranks, len(parts)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i] = a + b
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(parts[i] + parts[nxt[i]])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[nxt[i]]))
            p = prev[i]
            if p >= 0 and (r := ranks.get(parts[p] + parts[i])) is not None:
                heapq.heappush(heap, (r, p, parts[p], parts[i]))
        return [ranks[parts[i]] for i in range(n) if alive[i]]

    def ids_of(self, piece: str) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            if len(self.cache) >= self.cache_size:
                self.cache.clear()
            ids = self.merge(piece.encode("utf-8"))
            if len(piece) <= 64:
                self.cache[piece] = ids
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        if not hasattr(self, "tokens"):
            self.tokens = {r: b for b, r in self.ranks.items()}
        return b"".join(self.tokens[int(i)] for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(texts: list[str | None], vocab: Vocabulary, room: int = 1_000_000) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Per text: ids, code-point offsets of its pre-tokens, and how many ids each of these has."""
    at = 0
    while at < len(texts):
        chunk, size = [], 0
        while at < len(texts) and (not chunk or size < room):
            chunk.append(texts[at] or "")
            size += len(chunk[-1]) + 1
            at += 1
        lens = np.array([len(t) for t in chunk], np.int64)
        begin = np.concatenate([[0], np.cumsum(lens + 1)])
        joined = "\x00".join(chunk) + "\x00"
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        cp[begin[1:] - 1] = 0x110000
        starts = pretoken_starts(cp)
        first = np.searchsorted(starts, begin)
        stops = starts[1:].tolist() + [len(joined)]
        pos = starts.tolist()
        ids_of, cache = vocab.ids_of, vocab.cache
        for k in range(len(chunk)):
            a, b = first[k], first[k + 1] - 1  # the separator is the last start of the text
            ids: list[int] = []
            counts = np.empty(b - a, np.int32)
            for i in range(a, b):
                piece = joined[pos[i] : stops[i]]
                got = cache.get(piece)
                if got is None:
                    got = ids_of(piece)
                ids += got
                counts[i - a] = len(got)
            yield ids, (starts[a:b] - begin[k]).astype(np.int32), counts


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocab_file: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS, offsets: bool = False) -> DataFrame:
    """(key, ids), with ``offsets`` also the code-point start and the number of ids of each pre-token.

    A narrow map: no shuffle. Only the two columns are read.
    """
    path = f"{folder}/{vocab_file}"
    kind = dict(documents.dtypes)[key]
    schema = f"`{key}` {kind}, ids array<int>" + (", slice_starts array<int>, slice_ids array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for small in _slices(batch):
                ids, at, starts, n = [], [0], [], []
                for i, s, c in encode_texts(small.column(1).to_pylist(), vocab):
                    ids.append(np.array(i, np.int32))
                    at.append(at[-1] + len(i))
                    starts.append(s)
                    n.append(c)
                made = [small.column(0), _lists(ids)]
                names = [key, "ids"]
                if offsets:
                    made += [_lists(starts), _lists(n)]
                    names += ["slice_starts", "slice_ids"]
                yield pa.RecordBatch.from_arrays(made, names=names)

    return spread(documents.select(key, text)).mapInArrow(run, schema)


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", vocab_file: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens) by the same encoder."""
    path = f"{folder}/{vocab_file}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            n = [len(i) for i, _, _ in encode_texts(batch.column(1).to_pylist(), vocab)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return spread(documents.select(key, text)).mapInArrow(run, f"`{key}` {dict(documents.dtypes)[key]}, n_tokens bigint")


def _slices(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))
