"""Packing of token streams into windows by Karmarkar-Karp multiway differencing.

Every document is tokenised whole and ended with an id. It is cut into full
windows and a tail, and the tail into pieces of at most ``piece`` ids, so that
many small items can even out. Pieces are dealt by row, not by id, into groups of
about as many pieces as ``group_docs`` documents have: a repeated id or a null one
spreads like any other. Within a group the tails are differenced into
as few windows as the capacity allows. The number of windows rises whenever
the fullest one exceeds the capacity. Only piece rows (a few integers each)
are shuffled, never token ids, unless they are asked for.

Cases: null and empty texts hold the end id alone; rows with a null doc_id and
repeated rows are packed each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .minhash import BASE, U, mixed
from .shared import batches, doc_texts

PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
PACKED = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
IDS = T.StructField("ids", T.BinaryType())
OBJECTS = 200  # bytes of an entry of the word table, on average, beside its text and ids
SPLIT_AT = str.maketrans("\n\t\r", "   ")
#: Texts of these characters alone are split here as the tokenizer does: composed Latin letters, for which lower case and composition need no context.
LATIN = "À-ÖØ-öø-įı-ɏ"
ODD = re.compile(rf"[^\x00-\x1b\x20-\x7f{LATIN}]|<\|")
TOKENS = re.compile(rf"[a-z{LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\s0-9a-z{LATIN}]+")


class Words(dict):
    """Little-endian unsigned 32-bit ids of the words met so far; words are what stands between blanks.

    The tokenizer drops white space before it splits, so words are independent.
    ``remembered`` bounds the bytes of the table, which a worker keeps over its tasks."""

    def __init__(self, path: str, remembered: int) -> None:
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer, self.remembered, self.bytes = Tokenizer.from_file(path), remembered, 0
        ends = [number for token, number in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[ends] = True

    def encoded(self, words: list[str], single: bool) -> list[bytes]:
        """The ids of each word. ``single``: each is one word to the tokenizer too, so one call takes all and the ids that end words part them."""
        if single and words:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            at = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(at) == len(words):
                data = ids.tobytes()
                return [data[i:j] for i, j in zip([0, *at], at, strict=False)]
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: set[str], single: bool) -> None:
        new = list(words)
        ids = self.encoded(new, single)
        self.update(zip(new, ids, strict=True))
        self.bytes += OBJECTS * len(new) + 2 * sum(map(len, new)) + sum(map(len, ids))

    def forget(self, but: set[str]) -> None:
        """Beyond the bound, drops all words but those of the present batch that are short: the frequent ones are among them."""
        if self.bytes > self.remembered:
            kept = {word: self[word] for word in but if len(word) <= 64}
            self.clear()
            self.update(kept, **{"": b""})
            self.bytes = sum(OBJECTS + 2 * len(word) + len(ids) for word, ids in kept.items())


_words: dict[tuple[str, int], Words] = {}


def token_bytes(texts: list[str], path: str, remembered: int = 128 << 20) -> list[bytes]:
    """The ids of each text as bytes, without an end id: by what the tokenizer splits a text into, or by words between blanks."""
    key = path, remembered
    if key not in _words:
        _words[key] = Words(path, remembered)
    known = _words[key]
    odd = [bool(ODD.search(text)) for text in texts]
    split = [text.translate(SPLIT_AT).split(" ") if x else TOKENS.findall(text.lower()) for text, x in zip(texts, odd, strict=True)]
    met: set[str] = set()
    for single in (True, False):
        own = set(chain.from_iterable(words for words, x in zip(split, odd, strict=True) if x != single))
        known.learn(own.difference(known), single)
        met |= own
    out = [b"".join(map(known.__getitem__, words)) for words in split]
    known.forget(met)
    return out


def differenced(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item: the two partial partitions with the largest imbalance are merged, full against empty, until one is left."""
    parent = np.arange(len(sizes))
    heap = [(-int(size), i, np.array([size]), np.array([i])) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        if (both := len(a) + len(b) - windows) <= 0:
            loads, bins = np.concatenate([a, b]), np.concatenate([of_a, of_b])
        else:
            high_a, high_b = len(a) - both, len(b) - both
            parent[of_b[high_b:]] = of_a[high_a:][::-1]
            loads = np.concatenate([a[:high_a], a[high_a:] + b[high_b:][::-1], b[:high_b]])
            bins = np.concatenate([of_a, of_b[:high_b]])
        order = np.argsort(-loads, kind="stable")
        loads, bins = loads[order], bins[order]
        if len(loads) == windows:
            loads = loads - loads[-1]
        heapq.heappush(heap, (-int(loads[0]), turn, loads, bins))
        turn += 1
    while (up := parent[parent]).tolist() != parent.tolist():
        parent = up
    return np.unique(parent, return_inverse=True)[1]


def packed(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; full pieces have windows of their own."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = lengths == capacity
    window[full] = np.arange(full.sum())
    tails = np.flatnonzero(~full)
    if len(tails):
        sizes = lengths[tails]
        windows = -(-int(sizes.sum()) // capacity)
        while True:
            own = differenced(sizes, windows)
            loads = np.bincount(own, sizes).astype(np.int64)
            if loads.max() <= capacity:
                break
            windows += max(1, -(-int(np.maximum(loads - capacity, 0).sum()) // capacity))
        order = np.argsort(own, kind="stable")
        ends = np.cumsum(sizes[order])
        firsts = np.concatenate([[0], np.cumsum(loads)[:-1]])
        offset[tails[order]] = ends - sizes[order] - firsts[own[order]]
        window[tails] = own + full.sum()
    return window, offset


def cut(tokens: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces."""
    whole = tokens - tokens % capacity
    return [(i, capacity) for i in range(0, whole, capacity)] + [(i, min(piece, tokens - i)) for i in range(whole, tokens, piece)]


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, piece: int = 512, group_docs: int = 1024, keep_ids: bool = False, remembered: int = 128 << 20) -> DataFrame:
    """A row for each piece with its place in a window of at most ``capacity`` ids. ``remembered`` bounds each worker's table of words."""
    end = np.array([end_id], "<u4").tobytes()
    schema = T.StructType([T.StructField("grp", T.LongType()), *PIECES.fields, *([IDS] if keep_ids else [])])
    result = T.StructType([*PACKED.fields, IDS]) if keep_ids else PACKED
    docs = doc_texts(docs)
    groups = max(1, -(-docs.count() // group_docs))

    def tokenised(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        met: Counter[tuple[int | None, int]] = Counter()  # equal rows of this task are told apart by their number alone, so that a repeated task deals them alike
        for keys, texts in batches(items):
            rows: list[list] = [[] for _ in schema]
            for key, ids in zip(keys, token_bytes(texts, tokenizer_path, remembered), strict=True):
                ids += end
                count, own = len(ids) // 4, (key, zlib.crc32(ids))
                met[own] += 1
                for start, length in cut(count, capacity, piece):
                    part = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (met[own], key, start, length, zlib.crc32(part), count, part), strict=False):
                        column.append(value)
            columns = [pa.array(x, pa.binary() if n == "ids" else pa.int64()) for x, n in zip(rows, schema.names, strict=True)]
            with np.errstate(over="ignore"):
                hashed = np.full(len(rows[0]), task, U)
                for column in columns[:5]:
                    hashed = mixed(hashed * BASE + column.fill_null(-1).to_numpy(zero_copy_only=False).view(U) + U(1))
            columns[0] = pa.array((hashed % U(groups)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    def together(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        window, offset = packed(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(int(key[0]) << 32) + window, offset=offset)[result.names]

    return docs.mapInArrow(tokenised, schema).groupBy("grp").applyInPandas(together, result)
