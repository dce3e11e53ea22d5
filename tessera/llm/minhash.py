"""Near-duplicate detection by one-permutation hashing with optimal densification.

One hash of each word shingle gives both its bin (the top bits) and its value;
a bin keeps its least value, and an empty bin takes that of a bin which a fixed
random sequence names, so short documents fill all bins evenly. Bins are banded
into buckets. Documents with equal sets form a class, a node of the graph, and
only nodes go on. A bucket gives star-shaped candidate edges, from its smallest
node to every other member, so the number of pairs stays linear. Candidates are
confirmed on the full sets of whole texts. What then still lies in a bucket with
another component is compared in full, in salted blocks of the bucket: first by
counts of shingles by hash, which bound an intersection from above, then, for
members that have a partner within that bound, by their sets. So every pair that
shares a bucket is linked, or was tested, or is in one component; no pair becomes
a row before it is a link. Components come from alternating large and small stars.

With 128 bins in 32 bands of 4, a pair at similarity 0.8 shares no bucket with
probability (1 - 0.8^4)^32, about 5e-8; no other pair is missed. Sets hold 64-bit
hashes of shingles, and sets of one class agree in 128 bits.

Cases: null and empty texts have an empty set and are linked with nothing;
fewer words than a shingle are one shingle; repeated rows are each returned, with
one result; rows that repeat an id with another text are nodes of their own; a
null doc_id counts as larger than all others; an empty table gives an empty
result; extra columns are kept by ``keep_one`` and ignored by ``components``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.session import dealt_anew, sized

from .shared import NULL_ID, Scratch, slices, trim, utf8

BINS, BAND = 128, 4
CHUNK = 1 << 19  # bytes hashed at once
BLOCK_ROWS, BLOCK_BYTES = 2048, 1 << 23  # of a bucket's block, on average
COUNTS = 64
U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche in all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(size: int) -> list[np.ndarray]:
    """Powers of the base and its inverse; few long inputs aside, a table of bounded size serves all."""
    if len(_powers[0]) >= size:
        return _powers
    out = []
    for base in (BASE, INVERSE):
        steps = np.full(size, base)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    if size <= 4 * CHUNK:
        _powers[:] = out
    return out


def _hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word; A-Z count as lower case."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data)
    space = SPACE[data]
    first, last = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    first[offsets], last[offsets] = True, True
    inside = ~space
    starts = np.flatnonzero(inside & (first[:-1] | np.concatenate([[True], space[:-1]])))
    ends = np.flatnonzero(inside & (last[1:] | np.concatenate([space[1:], [True]]))) + 1
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[: len(data)], dtype=U)])
    words = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
    return words, np.searchsorted(offsets, starts, "right") - 1


def _long_words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one long text, piece by piece, cut at blanks."""
    out, at = [], 0
    while at < len(data):
        to = min(at + CHUNK, len(data))
        while to < len(data) and not (blanks := np.flatnonzero(SPACE[data[at:to]])).size:
            to = min(to + CHUNK, len(data))  # a word longer than a piece
        if to < len(data):
            to = at + int(blanks[-1]) + 1
        out.append(_hashed_words(data[at:to], np.array([0, to - at]))[0])
        at = to
    return np.concatenate(out)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = utf8(column)
    out: list[np.ndarray] = []
    at, count = 0, len(offsets) - 1
    while at < count:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        part = offsets[at : to + 1] - offsets[at]
        piece = data[offsets[at] : offsets[to]]
        with np.errstate(over="ignore"):
            if len(piece) > CHUNK:  # one text
                hashes = _long_words(piece)
                bounds = np.array([0, len(hashes)])
            else:
                hashes, own = _hashed_words(piece, part)
                bounds = np.searchsorted(own, np.arange(to - at + 1))
            weights = mixed(np.arange(1, words + 1, dtype=U))
            many = np.zeros(max(0, len(hashes) - words + 1), U)
            for i in range(words):
                many += hashes[i : i + len(many)] * (weights[i] | U(1))
            many = mixed(many + U(words))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a >= words:
                    out.append(np.unique(many[a : b - words + 1]))
                elif b > a:
                    out.append(mixed(np.array([(hashes[a:b] * (weights[: b - a] | U(1))).sum(dtype=U) + U(b - a)], U)))
                else:
                    out.append(np.zeros(0, U))
        at = to
    return out


def _donors(tries: int = 256) -> np.ndarray:
    """For each try and bin, the bin to copy from."""
    with np.errstate(over="ignore"):
        return (mixed(np.arange(tries * BINS, dtype=U) * BASE + U(7)) >> U(40)).astype(np.int64).reshape(tries, BINS) % BINS


def densified(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fills empty bins: from the first filled bin of its sequence, or else the next filled one around."""
    out, todo = values.copy(), ~filled
    for donors in _donors():
        rows, bins = np.nonzero(todo)
        if not len(rows):
            return out
        good = filled[rows, donors[bins]]
        rows, bins = rows[good], bins[good]
        out[rows, bins] = values[rows, donors[bins]]
        todo[rows, bins] = False
    for row in np.flatnonzero(todo.any(1)):
        have = np.flatnonzero(filled[row])
        empty = np.flatnonzero(todo[row])
        out[row, empty] = values[row, have[np.searchsorted(have, empty) % len(have)]]
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The bucket of each band for non-empty sets."""
    sizes = np.array([len(x) for x in sets])
    flat = mixed(np.concatenate(sets) + U(0x5851F42D4C957F2D))
    owner = np.repeat(np.arange(len(sets)), sizes)
    bins = (flat >> U(57)).astype(np.int64)
    values = np.full(len(sets) * BINS, np.iinfo(U).max, U)
    order = np.lexsort((flat, owner))
    slot = (owner * BINS + bins)[order]
    first = np.concatenate([[True], slot[1:] != slot[:-1]])
    values[slot[first]] = flat[order][first]
    values = values.reshape(-1, BINS)
    filled = np.zeros(len(sets) * BINS, bool)
    filled[slot[first]] = True
    dense = densified(values, filled.reshape(-1, BINS)).reshape(len(sets), -1, BAND)
    keys = np.zeros(dense.shape[:2], U)
    for i in range(BAND):
        keys = mixed(keys * BASE + dense[:, :, i])
    return mixed(keys + np.arange(dense.shape[1], dtype=U) * BASE).view(np.int64)


SIGNED = "doc_id long, sig long, n_shingles long, s1 long, s2 long, bands array<long>"


def signatures(texts: DataFrame, words: int) -> DataFrame:
    """Per row the size and a 128-bit digest of its set, and its buckets."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(items):
            sets = shingle_sets(part.column("text"), words)
            full = [i for i, x in enumerate(sets) if len(x)]
            bands: list = [[]] * len(sets)
            with np.errstate(over="ignore"):
                if full:
                    for i, keys in zip(full, band_keys([sets[i] for i in full]), strict=True):
                        bands[i] = keys
                digests = [np.array([[mixed(x + U(1)).sum(dtype=U), np.bitwise_xor.reduce(mixed(x + U(2)))]], U).view(np.int64)[0] if len(x) else (0, 0) for x in sets]
            columns = [part.column("doc_id"), part.column("sig"), pa.array([len(x) for x in sets], pa.int64()), *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sig", "n_shingles", "s1", "s2", "bands"])

    return texts.mapInArrow(run, SIGNED)


def counts_of(shingles: np.ndarray) -> np.ndarray:
    """How many of a set's shingles have each value of some bits of the hash."""
    return np.bincount(((shingles >> U(20)) & U(COUNTS - 1)).astype(np.int64), minlength=COUNTS).astype("<i4")


def _sets(held: DataFrame, words: int) -> DataFrame:
    """The shingle set of each node's text and its counts, as bytes, beside its buckets."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(items):
            sets = shingle_sets(part.column("text"), words)
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("bands"), pa.array([counts_of(x).tobytes() for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "bands", "counts", "shingles"])

    return held.select("node", "bands", "text").mapInArrow(run, "node long, bands array<long>, counts binary, shingles binary")


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b, set_a, set_b) those whose sets are similar enough."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[place] == small).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))
        trim()

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _groups(items: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, which may go on over several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in items:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(columns[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Block:
    """The members of a bucket that meet in one group: of two blocks, or of one."""

    def __init__(self, group: pa.Table, percent: int) -> None:
        self.percent = percent
        number = lambda name: group.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        self.nodes, self.parts, self.sizes, self.side = number("node"), number("component").copy(), number("n"), number("own")
        self.two = bool((number("i") != number("j"))[0])
        self.counts = np.stack([np.frombuffer(x.as_buffer(), "<i4") for x in group.column("counts")])
        self.earlier = np.zeros((len(self.nodes), 0), np.int64)
        if "bands" in group.column_names:
            bands = np.stack([np.asarray(x, np.int64) for x in group.column("bands").to_pylist()])
            self.earlier = bands[:, : int(np.flatnonzero(bands[0] == number("bucket")[0])[0])]
        self.sets = [np.frombuffer(x.as_buffer(), U) for x in group.column("shingles")] if "shingles" in group.column_names else None

    def reach(self, p: int) -> np.ndarray:
        """Later members of other components that may be similar to p: by sizes, and by the most that the intersection can be.

        Where buckets are known, a pair that shares an earlier one is left to that."""
        rest = np.arange(p + 1, len(self.nodes))
        rest = rest[self.parts[rest] != self.parts[p]]
        if self.two:
            rest = rest[self.side[rest] != self.side[p]]
        low, high = np.minimum(self.sizes[rest], self.sizes[p]), np.maximum(self.sizes[rest], self.sizes[p])
        rest = rest[100 * low >= self.percent * high]
        rest = rest[~(self.earlier[rest] == self.earlier[p]).any(1)]
        most = np.minimum(self.counts[rest], self.counts[p]).sum(1)
        return rest[100 * most >= self.percent * (self.sizes[rest] + self.sizes[p] - most)]

    def reached(self) -> np.ndarray:
        """Which members have a partner in reach."""
        out = np.zeros(len(self.nodes), bool)
        for p in range(len(self.nodes) - 1):
            if len(rest := self.reach(p)):
                out[p] = out[rest] = True
        return out

    def links(self) -> list[tuple[int, int]]:
        """Similar pairs of different components; a link makes its components one for what follows."""
        known, codes = np.unique(np.concatenate(self.sets), return_inverse=True)
        codes = np.split(codes, np.cumsum(self.sizes)[:-1])
        mark, out = np.zeros(len(known), bool), []
        for p in range(len(self.nodes) - 1):
            if not len(rest := self.reach(p)):
                continue
            mark[codes[p]] = True
            starts = np.concatenate([[0], np.cumsum(self.sizes[rest])[:-1]])
            both = np.add.reduceat(mark[np.concatenate([codes[q] for q in rest])].astype(np.int64), starts)
            mark[codes[p]] = False
            good = rest[100 * both >= self.percent * (self.sizes[p] + self.sizes[rest] - both)]
            out += [(int(self.nodes[p]), int(self.nodes[q])) for q in good]
            self.parts[np.isin(self.parts, self.parts[good])] = self.parts[p]
        return out


KEYS = ["bucket", "i", "j"]


def _in_blocks(left: DataFrame, carried: DataFrame, block_bytes: int | None) -> DataFrame:
    """Members of buckets dealt into blocks by hash, each two of which meet in a group, with their sets or counts."""
    weight = F.sum("n") * 8 / block_bytes if block_bytes else F.lit(0)
    sizes = left.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, weight)).cast("int").alias("blocks")).select(dealt_anew("bucket"), "blocks")
    own = F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int")
    dealt = left.join(sizes.hint("merge"), "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "component")
    return dealt.join(carried.hint("merge"), "node").repartition(*KEYS).sortWithinPartitions(*KEYS, "node")


def left_links(members: DataFrame, rows: int, parts: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """Links (a, b) between members of different components in a bucket, or None if no bucket has several."""
    now = members.join(parts.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(dealt_anew("bucket"))
    left = scratch.keep(sized(now.join(several.hint("merge"), "bucket").select("bucket", "node", "n", "component"), rows), "left")
    if left.isEmpty():
        scratch.drop("left")
        return None

    def near(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(items, KEYS):
            if group.num_rows > 1:
                keep = pa.array(Block(group, percent).reached())
                yield from group.select(["bucket", "node", "n", "component"]).filter(keep).to_batches()
        trim()

    def found(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(items, KEYS):
            if group.num_rows > 1:
                links = Block(group, percent).links()
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])
        trim()

    reached = _in_blocks(left, sets.select("node", "bands", "counts"), None).mapInArrow(near, "bucket long, node long, n long, component long").distinct()
    reached = scratch.keep(sized(reached, rows), "reached")
    scratch.drop("left")
    links = scratch.keep(sized(_in_blocks(reached, sets.drop("bands"), BLOCK_BYTES).mapInArrow(found, "a long, b long").distinct(), rows), "more")
    scratch.drop("reached")
    return links


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id (null ones as the largest), a hash of the text, n_shingles and component_id of every row."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("sig", F.xxhash64("text"))
    scratch = Scratch(docs.sparkSession)
    rows = docs.count()
    signed = scratch.keep(signatures(sized(texts, rows, 1 << 13), words), "signatures")
    # Nodes are numbered as they are written, so that rows which repeat an id need no other key.
    classes = signed.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "sig", "n_shingles", "bands")).alias("x"))
    classes = scratch.keep(sized(classes, rows, 1 << 15).select(F.monotonically_increasing_id().alias("node"), "s1", "s2", F.col("x.doc_id").alias("first"), F.col("x.sig").alias("sig"), F.col("x.n_shingles").alias("n"), F.col("x.bands").alias("bands")), "classes")
    members = classes.select("node", "n", F.explode("bands").alias("bucket"))
    several = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select(dealt_anew("bucket"))
    members = scratch.keep(sized(members.join(several.hint("merge"), "bucket").select("bucket", "node", "n"), 32 * rows, 1 << 19), "buckets")  # few buckets have more than one member
    needed = classes.join(members.select("node").distinct().hint("merge"), "node").select("node", F.col("first").alias("doc_id"), "sig", "bands")
    held = texts.join(needed, ["doc_id", "sig"]).dropDuplicates(["doc_id", "sig"])
    sets = scratch.keep(_sets(sized(held, rows, 1 << 13), words), "sets")

    centres = members.groupBy("bucket").agg(F.min("node").alias("a")).select(dealt_anew("bucket"), "a")
    sizes = members.join(centres.hint("merge"), "bucket").where("node <> a").select("a", F.col("node").alias("b"), F.col("n").alias("n_b")).distinct()
    first = sizes.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")).hint("merge"), "a")
    first = first.where(F.least(F.octet_length("set_a"), 8 * F.col("n_b")) * 100 >= F.greatest(F.octet_length("set_a"), 8 * F.col("n_b")) * percent)
    both = first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")).hint("merge"), "b")
    held_in = members.count()
    parts = connected_components(confirmed(both, percent), most=held_in)
    more = left_links(members, held_in, parts, sets, percent, scratch)
    if more is not None and not more.isEmpty():
        parts = connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), most=2 * held_in)
    scratch.drop("buckets", "sets")
    linked = parts.join(classes.select("node", "first").hint("merge"), "node")
    least = linked.groupBy("component").agg(F.min("first").alias("least")).select(dealt_anew("component"), "least")
    linked = linked.join(least.hint("merge"), "component").select("node", "least")
    named = classes.select("node", "s1", "s2", "first").join(linked.hint("merge"), "node", "left").select("s1", "s2", F.coalesce("least", "first").alias("least"))
    out = signed.select("doc_id", "sig", "n_shingles", "s1", "s2").join(named.hint("merge"), ["s1", "s2"], "left")
    return out.select("doc_id", "sig", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    real = lambda x: F.when(x != NULL_ID, x)
    out = _grouped(docs, words, percent)
    return out.select(real(F.col("doc_id")).alias("doc_id"), "n_shingles", real(F.col("component_id")).alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which no smaller id is a near-duplicate, directly or through others."""
    own_id, own_text = (next(f"_{x}{i}" for i in range(len(docs.columns) + 1) if f"_{x}{i}" not in docs.columns) for x in ("gone", "sig"))
    gone = _grouped(docs.select("doc_id", "text"), words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(own_id), F.col("sig").alias(own_text)).distinct()
    row = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)) == F.col(own_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(own_text))
    return docs.join(gone, row, "left_anti")
