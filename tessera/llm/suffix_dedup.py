"""Removal of repeated byte strings over a sampled suffix array.

A suffix is sampled where it begins with the least hash of all ``GRAM``-byte
strings of some ``length``-byte window. Equal windows choose the same place, so
the windows that choose one suffix, its block, can be compared with those that
choose an equal one elsewhere, and about one suffix in sixteen is needed.

1. Splitters from a sample of suffixes, eight for each bucket, range-partition the
   suffixes by their leading eight bytes and, among equal ones, by a hash of the rest
   of the gram, so that frequent words fall into many buckets. Each bucket is
   sorted locally by multikey quicksort, with machine words for characters: leading
   bytes, rest of the gram, block. Within a run of equal blocks every document but
   the smallest has the whole block repeated. A run of equal grams with several
   blocks is a border: its matches end inside a block. Its blocks are asked for in
   full.
2. The documents that are asked send the windows of those blocks to buckets of
   the same kind; in a run of equal windows again all but the smallest
   document have a repeat.
3. Each document marks its repeated blocks and windows and drops the bytes.

A task compares its own suffixes before it sends any, and sends one for each
block: what repeats in a third of all documents is a few records a task. Equal grams
never lie on both sides of a splitter, so no run goes on in the next bucket and
there is nothing to compare across a boundary. What buckets find out is a row for
each document and block, dealt to the texts by Spark. Texts are dealt twice by a
hash of the id, or of the text where there is none. Bytes are compared as the
leading eight and digests of 32 and 64 bits of what follows: of 10^13 suffixes some
10^26 / 2^97 pairs agree in the digests by chance, and their leading bytes would
have to agree as well.

Cases: null and empty texts and texts shorter than ``length`` lose nothing;
matches never cross documents; rows with one doc_id don't remove one another's
bytes, nor do rows without one, which count as larger than all others (ids from
7 * 2^60 on aren't told from them); an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import U, mixed, powers
from .shared import slices, trim, utf8, written

GRAM = 20
PLACES = (1 << 24) - 1
CHUNK, LONG = 1 << 20, 8 << 20  # bytes hashed at once; longer documents are cut between windows
FLUSH = 2_000_000  # suffixes that a task gathers before it compares and sends them
REPEATED, ASKED = 1, 2
NO_ID = 7 << 60  # rows without an id are numbered from here on
HIGH = np.uint64(1 << 63)
SPACING = 16  # bytes from one sampled suffix to the next, on average
BLOB = 1 << 16  # replies in a blob
DEALT = "bucket int, kind int, blob binary"
REPLY = "doc long, block long, status int"


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number that sorts like them."""
    return data[at[:, None] + np.arange(8)].view(">u8").ravel().astype(U)


class Chunk:
    """The sampled suffixes of some texts: ``own`` their text, ``low`` to ``high`` the windows that chose them, ``at`` their start."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int) -> None:
        self.data, self.length, size = data, length, len(data)
        self.own = self.low = self.high = self.at = np.zeros(0, np.int64)
        if size < length:
            return
        up, self.down = powers(size + 1)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[:size], dtype=U)])
        self.grams = mixed((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[: size - GRAM + 1])
        least = (self.grams & ~U(PLACES)) | np.arange(len(self.grams), dtype=U)
        wide, span = length - GRAM + 1, 1
        while 2 * span <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if wide > span:
            least = np.minimum(least[: -(wide - span)], least[wide - span :])
        chosen = (least & U(PLACES)).astype(np.int64)
        lengths = np.diff(offsets)
        text = np.repeat(np.arange(len(lengths)), lengths)[: len(chosen)]
        fits = np.arange(len(chosen)) <= offsets[1:][text] - length
        windows = np.flatnonzero(fits)
        chosen, text = chosen[windows], text[windows]
        if not len(windows):
            return
        new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(windows)]]) - 1
        self.own, self.low, self.high, self.at = text[first], windows[first], windows[last], chosen[first]

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))

    def blocks(self) -> np.ndarray:
        return mixed(self.digests(self.low, self.high + self.length) + (self.at - self.low).astype(U))

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leading bytes; 32 bits of the gram below tags of the bytes left and right of it; block."""
        if not len(self.at):
            return (np.zeros(0, U),) * 3
        side, end = (self.length - GRAM + 1) // 2, self.at + GRAM
        left = self.digests(np.maximum(self.at - side, 0), self.at) & U(0xFF)
        right = self.digests(end, np.minimum(end + side, len(self.data))) & U(0xFF)
        return leading(self.data, self.at), (self.grams[self.at] & U(0xFFFFFFFF)) | (left << U(32)) | (right << U(40)), self.blocks()

    def windows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, start, leading bytes and digest of the windows of some suffixes."""
        counts = (self.high - self.low + 1)[of]
        before = np.cumsum(counts) - counts
        start = np.repeat(self.low[of] - before, counts) + np.arange(counts.sum())
        return np.repeat(self.own[of], counts), start, leading(self.data, start), self.digests(start, start + self.length)


def chunks(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, Chunk]]:
    """Number of the first text, byte of it where the chunk begins, bounds of the texts, and suffixes."""
    data, offsets = utf8(column)
    at, count = 0, len(offsets) - 1
    while at < count:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        part, bounds = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        if len(part) <= LONG:
            yield at, 0, bounds, Chunk(part, bounds, length)
        else:  # one text; a window starts in one piece alone
            for start in range(0, len(part) - length + 1, LONG - length + 1):
                piece = part[start : start + LONG]
                bounds = np.array([0, len(piece)])
                yield at, start, bounds, Chunk(piece, bounds, length)
        at = to


SMALL = 1 << 18


def sorted_order(keys: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort: split in three by a pivot word; what equals it goes on with the next word. Small parts are sorted by all words left."""
    order = np.arange(len(keys[0]))
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == len(keys):
            continue
        own = order[low:high]
        word = keys[depth][own]
        if high - low <= SMALL:
            by = np.argsort(word)
            word = word[by]
            same = word[1:] == word[:-1]
            tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
            if len(tied) and depth + 1 < len(keys):
                run = np.cumsum(np.concatenate([[True], ~same]))[tied]
                by[tied] = by[tied][np.lexsort([key[own[by[tied]]] for key in keys[:depth:-1]] + [run])]
            order[low:high] = own[by]
            continue
        pivot = np.median(word[:: max(1, len(word) // 255)][:255].astype(np.float64))
        pivot = word[np.abs(word.astype(np.float64) - pivot).argmin()]
        less, more = word < pivot, word > pivot
        order[low:high] = np.concatenate([own[less], own[~less & ~more], own[more]])
        a, b = low + int(less.sum()), high - int(more.sum())
        todo += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def rank_of(doc: np.ndarray) -> np.ndarray:
    """Documents as they are compared: by id, those without one alike."""
    return np.minimum(doc, U(NO_ID) ^ HIGH)


def compared(lead: np.ndarray, gram: np.ndarray, block: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order; where a run of equal blocks starts; which records are those of a larger document than the run's first."""
    order = sorted_order([lead, gram, block, doc])
    same = np.ones(len(order) - 1, bool)
    for key in (lead, gram, block):
        own = key[order]
        same &= own[1:] == own[:-1]
    first = np.concatenate([[True], ~same])
    rank = rank_of(doc[order])
    return order, first, rank > rank[np.flatnonzero(first)[np.cumsum(first) - 1]]


def packed(arrays: tuple[np.ndarray, ...]) -> bytes:
    """Numbers as planes of bytes, which sorted and small ones compress well in."""
    return np.concatenate([np.ascontiguousarray(x.astype(U).view(np.uint8).reshape(-1, 8).T).ravel() for x in arrays]).tobytes()


def unpacked(blobs: list[bytes], width: int) -> list[np.ndarray]:
    parts = [np.frombuffer(b, np.uint8).reshape(width, 8, -1) for b in blobs if b]
    if not parts:
        return [np.zeros(0, U)] * width
    return [np.concatenate([np.ascontiguousarray(p[i].T).view(U).ravel() for p in parts]) for i in range(width)]


def _rows(bucket: list[int], kind: list[int], blob: list[bytes]) -> pa.Table:
    return pa.table([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["bucket", "kind", "blob"])


def _replies(doc: np.ndarray, block: np.ndarray, status: np.ndarray) -> pa.Table:
    """What documents are told."""
    return pa.table([pa.array((doc ^ HIGH).view(np.int64)), pa.array(block.view(np.int64)), pa.array(status.astype(np.int32))], names=["doc", "block", "status"])


def bounds_of(lead: np.ndarray, gram: np.ndarray, splitters: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where each bucket begins in sorted records."""
    leads, of_lead = np.unique(lead, return_inverse=True)
    own = (of_lead.astype(U) << U(32)) | gram
    place = np.searchsorted(leads, splitters[0], "left")
    there = np.append(leads, U(0))[np.minimum(place, len(leads))] == splitters[0]
    there &= place < len(leads)
    at = np.searchsorted(own, (place.astype(U) << U(32)) | np.where(there, splitters[1], U(0)), "left")
    return np.concatenate([[0], at, [len(lead)]])


def dealt(lead: np.ndarray, gram: np.ndarray, block: np.ndarray, doc: np.ndarray, splitters: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """One record of each block for its bucket; what is already known of the others goes along."""
    if not len(doc):
        return _rows([], [], [])
    low = gram & U(0xFFFFFFFF)
    order, first, repeated = compared(lead, low, block, doc)
    out: tuple[list, list, list] = ([], [], [])
    local = order[repeated]
    for number, at in enumerate(range(0, len(local), BLOB)):
        part = local[at : at + BLOB]
        for column, value in zip(out, (number % (len(splitters[0]) + 1), 1, packed((doc[part], block[part]))), strict=True):
            column.append(value)
    docs = doc[order]
    sent = order[~repeated & (first | np.concatenate([[True], docs[1:] != docs[:-1]]))]
    bounds = bounds_of(lead[sent], low[sent], splitters)
    for i in np.flatnonzero(np.diff(bounds)).tolist():
        part = sent[bounds[i] : bounds[i + 1]]
        for column, value in zip(out, (i, 0, packed((lead[part], gram[part], block[part], doc[part]))), strict=True):
            column.append(value)
    return _rows(*out)


def _resolve(ask: bool) -> Callable[[pa.Table], pa.Table]:
    """A bucket's records compared; out come replies."""

    def run(rows: pa.Table) -> pa.Table:
        kind, blob = rows.column("kind").to_pylist(), rows.column("blob").to_pylist()
        known, about = unpacked([b for k, b in zip(kind, blob, strict=True) if k], 2)
        told = [_replies(known, about, np.full(len(known), REPEATED))]
        lead, gram, block, doc = unpacked([b for k, b in zip(kind, blob, strict=True) if not k], 4)
        if len(doc):
            tags, gram = gram >> U(32), gram & U(0xFFFFFFFF)
            order, first, repeated = compared(lead, gram, block, doc)
            docs, status = doc[order], np.where(repeated, REPEATED, 0)
            if ask:
                grams = np.concatenate([[True], (lead[order][1:] != lead[order][:-1]) | (gram[order][1:] != gram[order][:-1])])
                heads, ranks = np.flatnonzero(first), rank_of(docs)
                low = np.minimum.reduceat(ranks[heads], np.flatnonzero(grams[heads]))
                high = np.maximum.reduceat(ranks[heads], np.flatnonzero(grams[heads]))
                run, tag = (np.cumsum(grams) - 1)[heads], tags[order][heads]
                agree = np.zeros(len(heads), bool)
                for part in (tag & U(0xFF), tag >> U(8)):
                    _, which, count = np.unique(run * 256 + part.astype(np.int64), return_inverse=True, return_counts=True)
                    agree |= count[which] > 1
                asked = (agree & (low < high)[run])[np.cumsum(first) - 1]
                status[asked & ~repeated] = ASKED
            found = status > 0
            told.append(_replies(docs[found], block[order][found], status[found]))
        trim()
        return pa.concat_tables(told)

    return run


def _of_docs(texts: pa.Table, replies: pa.Table) -> tuple[pa.Array, np.ndarray, list[np.ndarray], np.ndarray]:
    """Texts and numbers of a group; what its documents were told, sorted by document; documents that were told anything."""
    column = texts.column("text").cast(pa.large_string()).combine_chunks()
    ids = texts.column("doc").to_numpy().view(U) ^ HIGH
    doc, block, status = replies.column("doc").to_numpy().view(U) ^ HIGH, replies.column("block").to_numpy().view(U), replies.column("status").to_numpy()
    order = np.lexsort((block, doc))
    return column, ids, [doc[order], block[order], status[order]], np.unique(doc)


def _told(table: list[np.ndarray], doc: np.ndarray, block: np.ndarray, status: int) -> np.ndarray:
    """Which (document, block) pairs were told so. Digests of the pairs are looked up and then compared."""
    have = table[2] == status
    d, b = table[0][have], table[1][have]
    if not len(d) or not len(doc):
        return np.zeros(len(doc), bool)
    keys = mixed(d * U(0x9E3779B97F4A7C15) + b)
    order = np.argsort(keys)
    keys = keys[order]
    place = np.minimum(np.searchsorted(keys, mixed(doc * U(0x9E3779B97F4A7C15) + block)), len(keys) - 1)
    return (d[order][place] == doc) & (b[order][place] == block)


def remove_repeats(docs: DataFrame, length: int = 50, bucket_bytes: int = 4 << 20, least_buckets: int = 64, each: int = 16, keep_text: bool = False) -> DataFrame:
    """Per row the bytes, removed bytes and runs, and a digest of what stays; with ``keep_text`` what stays, too.

    ``bucket_bytes`` of text are meant for each bucket and each four groups of documents. Splitters come
    from a hashed sample of documents, about ``each`` suffixes of a document of average length,
    eight suffixes for each bucket and 128,000 at least: what reaches the driver grows as the number of buckets, by 128 bytes each,
    so very large tables want larger buckets (100 TB in buckets of 64 MB: 200 MB)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("doc", F.coalesce("doc_id", F.xxhash64("text").bitwiseAND(F.lit((1 << 60) - 1)) + F.lit(NO_ID)))
    total = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = max(least_buckets, -(-(total.bytes or 0) // bucket_bytes))
    groups = 4 * buckets  # of documents; small ones fill the partitions evenly

    def sampled(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(items):
                for _, _, _, chunk in chunks(batch.column("text"), length):
                    lead, gram, block = chunk.suffixes()
                    own = (mixed(block) >> U(11)).astype(np.float64) < kept * 2.0**53
                    yield pa.RecordBatch.from_arrays([pa.array(lead[own].view(np.int64)), pa.array((gram[own] & U(0xFFFFFFFF)).view(np.int64))], names=["lead", "gram"])

    wanted = max(128_000, 8 * buckets)
    share = max(1, (total.n or 1) * each // wanted)
    kept = min(1.0, SPACING * each * (total.n or 1) / max(1, total.bytes or 1))  # a long document gives more
    picked = texts.where(F.pmod(F.xxhash64("doc"), F.lit(share)) == 0).select("text").mapInArrow(sampled, "lead long, gram long").toArrow()
    lead, gram = (picked.column(c).to_numpy().view(U) for c in ("lead", "gram"))
    order = np.lexsort((gram, lead))[np.arange(1, buckets) * len(lead) // buckets] if len(lead) else np.zeros(0, np.int64)
    chosen = np.unique(np.stack([lead[order], gram[order]]), axis=1)
    splitters = chosen[0], chosen[1]

    def send(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if gathered:
                yield from dealt(*(np.concatenate(x) for x in zip(*gathered, strict=True)), splitters).to_batches()
            gathered.clear()

        with np.errstate(over="ignore"):
            for batch in items:
                ids = batch.column("doc").to_numpy().view(U) ^ HIGH
                for at, _, _, chunk in chunks(batch.column("text"), length):
                    gathered.append((*chunk.suffixes(), ids[at + chunk.own]))
                    if sum(len(x[0]) for x in gathered) >= FLUSH:
                        yield from flush()
            yield from flush()
        trim()

    told = written(texts.mapInArrow(send, DEALT).groupBy("bucket").applyInArrow(_resolve(True), REPLY), "suffix-replies")

    def ask(own: pa.Table, replies: pa.Table) -> pa.Table:
        column, ids, table, _ = _of_docs(own, replies)
        asked = np.isin(ids, table[0][table[2] == ASKED])
        if not asked.any():
            return _rows([], [], [])
        which = np.flatnonzero(asked)
        parts = []
        for at, _, _, chunk in chunks(column.take(pa.array(which)), length):
            doc = ids[which[at + chunk.own]]
            hit = np.flatnonzero(_told(table, doc, chunk.blocks() if len(doc) else doc, ASKED))
            if len(hit):
                text, _, lead, digest = chunk.windows(hit)
                parts.append((lead, mixed(digest) & U(0xFFFFFFFF), digest, ids[which[at + text]]))
        return dealt(*(np.concatenate(x) for x in zip(*parts, strict=True)), splitters) if parts else _rows([], [], [])

    def in_group(rows: DataFrame) -> DataFrame:
        return rows.withColumn("group", F.pmod(F.xxhash64("doc"), F.lit(groups)).cast("int"))

    by_group = in_group(texts).groupBy("group")
    windows = by_group.cogroup(in_group(told).groupBy("group")).applyInArrow(ask, DEALT)
    told_windows = written(windows.groupBy("bucket").applyInArrow(_resolve(False), REPLY), "suffix-windows")

    def finish(group: pa.Table, replies: pa.Table) -> pa.Table:
        kinds = replies.column("windows").to_numpy()
        column, ids, blocks, told_ids = _of_docs(group, replies.filter(pa.array(kinds == 0)))
        _, _, spans, more = _of_docs(group, replies.filter(pa.array(kinds == 1)))
        marks: dict[int, np.ndarray] = {}
        which = np.flatnonzero(np.isin(ids, np.concatenate([told_ids, more])))
        sizes = np.diff(utf8(column)[1])
        for at, base, bounds, chunk in chunks(column.take(pa.array(which)), length):
            if not len(chunk.at):
                continue
            doc, digest = ids[which[at + chunk.own]], chunk.blocks()
            whole = _told(blocks, doc, digest, REPEATED)
            starts, ends = [chunk.low[whole]], [chunk.high[whole] + length]
            part = np.flatnonzero(_told(blocks, doc, digest, ASKED))
            if len(part):
                text, start, _, window = chunk.windows(part)
                gone = _told(spans, ids[which[at + text]], window, REPEATED)
                starts.append(start[gone])
                ends.append(start[gone] + length)
            size = len(chunk.data) + 1
            covered = np.cumsum(np.bincount(np.concatenate(starts), minlength=size) - np.bincount(np.concatenate(ends), minlength=size)) > 0
            for i in range(len(bounds) - 1):
                if (own := covered[bounds[i] : bounds[i + 1]]).any():
                    number = int(which[at + i])
                    if number not in marks:
                        marks[number] = np.zeros(sizes[number], bool)
                    marks[number][base : base + len(own)] |= own
        rows: list[tuple] = []
        numbers = group.column("doc_id").to_pylist()
        for i, text in enumerate(column):
            data = text.as_buffer().to_pybytes()
            size, removed, runs = len(data), 0, 0
            if (gone := marks.get(i)) is not None:
                removed = int(gone.sum())
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                data = np.frombuffer(data, np.uint8)[~gone].tobytes()
            rows.append((numbers[i], size, removed, runs, hashlib.sha256(data).hexdigest(), *([data] if keep_text else [])))
        columns = zip(*rows, strict=True) if rows else [[]] * (6 if keep_text else 5)
        kinds_out = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
        return pa.table([pa.array(list(x), t) for x, t in zip(columns, kinds_out, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text])

    both = told.withColumn("windows", F.lit(0)).union(told_windows.withColumn("windows", F.lit(1)))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return by_group.cogroup(in_group(both).groupBy("group")).applyInArrow(finish, schema)
