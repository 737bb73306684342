"""Problem 4: near-duplicate sequences.

Sets of w consecutive ids, Jaccard at least t. That is a Hamming search: two sets of
sizes a and b have Jaccard >= t exactly if at most H = (1-t)/(1+t) * (a+b) elements
are in one of them only.

Candidates meet on neighbours: all elements have one total order (rare first), and an
element with the next one of its set makes a signature. In the order of the union of
two similar sets the at most H elements of one set only part the c common ones into at
most H+1 runs, so at least c-H-1 >= (2t-1)*max(a,b) - 1 = k signatures are common, and s
of them are among the first a-1-k+s of each set. So no similar pair is lost, and strangers
must share two elements side by side, not one, to meet. Sets too small for k >= 1 (all
sets, if t is at most a half) meet on single elements, of which similar sets share one
among the first a - ceil(t*a) + 1. Signatures are shuffled packed, and met by sorting
them as numbers; each meeting is a vote.

Each candidate pair then passes the pigeonring: elements fall into m segments on a ring, and if all
m differences sum to at most H, some segment begins a chain along which every
partial sum of l differences stays within l*H/m. The differences come from parity
sketches of the segments, as wide as the set is large, which never overstate them, so
no similar pair is lost; only pairs with such a chain get the full Hamming check.
"""

from __future__ import annotations

import gc
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavewright.storage import materialize, ship

SEGMENTS = 16
#: Signatures a pair must share to be a candidate (all they need, if they need fewer). Any number is exact; more of them meet fewer strangers.
SHARED = 4
#: The frequency sketch that orders elements has a counter of one byte for each element of the input, at most 2^24 of them: 16 MB. Beyond that the order blurs, which costs candidates and loses none.
SKETCH_BITS = 24
PAGE = 1 << 18
#: Tasks whose counters one group adds up, and at least as many count: each writes counters for all elements, so more tasks cost more.
FAN = 32
#: A list of ids is broadcast up to so many rows (8 MB), else joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: Signatures are shuffled in up to ROUNDS rounds of about ROUND elements of the input, so that not all of them are on disk at once; sorted in parts of about PART, packed HELD at once.
ROUNDS = 2
ROUND = 1 << 27
PART = 1 << 21
HELD = 1 << 21
#: Ids that are worked on at once, so that memory doesn't follow a batch of long rows (one sequence is one piece).
IDS_AT_ONCE = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(ids: np.ndarray, lengths: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences laid end to end: the sorted 64-bit hashes of each one's distinct runs of ``w`` ids, end to end, and how many each has."""
    ends = np.cumsum(lengths)
    runs = np.maximum(lengths - w + 1, 0)
    if not runs.any():
        return np.zeros(0, dtype=np.uint64), np.zeros(len(lengths), dtype=np.int64)
    ids = ids.astype(np.int64).view(np.uint64)
    h = np.zeros(len(ids) - w + 1, dtype=np.uint64)
    for k in range(w):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - w + 1 + k] + np.uint64(1)
    # A run must end where it began, within one sequence.
    owner = np.repeat(np.arange(len(lengths)), runs)
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    h = _mix(h[np.arange(len(owner)) - first[owner] + (ends - lengths)[owner]])
    for a, n in zip(first.tolist(), runs.tolist()):
        h[a : a + n].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(lengths))


def ring_bits(n: int) -> int:
    """Bits of the parity sketch of a set of ``n``: a power of two, three for two elements at least. Strangers then differ in well over the budget at t >= 0.6."""
    return max(SEGMENTS * 8, 1 << (3 * n // 2 - 1).bit_length() if n else 0)


def parity_sketch(elements: np.ndarray, bits: int) -> bytes:
    """``bits`` bits, segment by segment; a bit tells whether an odd number of the segment's elements hash to it."""
    slot = (elements >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketch: np.ndarray, bits: int) -> np.ndarray:
    """Rows of bytes as sketches of ``bits`` bits: neighbours are added up, which parity allows."""
    while sketch.shape[1] * 8 > bits:
        sketch = np.packbits(np.bitwise_xor.reduce(np.unpackbits(sketch, axis=1).reshape(len(sketch), -1, 2), axis=2), axis=1)
    return sketch


def differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of SEGMENTS lower bounds: in how many elements the two sets of each row of sketches differ, by segment."""
    bits = min(x.shape[1], y.shape[1]) * 8
    odd = np.bitwise_count(folded(x, bits) ^ folded(y, bits))
    return odd.reshape(len(odd), SEGMENTS, -1).sum(axis=2, dtype=np.int64)


def pigeonring(boxes: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """For each row of ``boxes`` (pairs x segments): has it a chain within ``budget`` (per pair) all the way round?

    The chain may start anywhere; after l segments at most l/m of the budget may be
    spent. Starts are dropped as their chains break, segment by segment.
    """
    m = boxes.shape[1]
    alive = np.ones(boxes.shape, dtype=bool)
    spent = np.zeros(boxes.shape, dtype=np.int64)
    for l in range(1, m + 1):
        spent += np.roll(boxes, 1 - l, axis=1)
        alive &= spent * m <= l * budget[:, None]
        if not alive.any():
            break
    return alive.any(axis=1)


def _sets(batch: pa.RecordBatch, w: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(seq ids, sizes, elements end to end)`` of slices of a batch that hold about IDS_AT_ONCE ids each."""
    seqs, lists = batch.column(0).to_numpy(), batch.column(1)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    a = 0
    while a < len(seqs):
        start = int(ends[a] - lengths[a])
        b = max(a + 1, int(np.searchsorted(ends, start + IDS_AT_ONCE, side="right")))
        elements, sizes = shingles(ids[start : ends[b - 1]], lengths[a:b], w)
        yield seqs[a:b], sizes, elements
        a = b


def _budget(t: float, a, b):
    return np.floor((1 - t) / (1 + t) * (a + b) + 1e-9).astype(np.int64)


def _longs(elements: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(elements.view(np.int64)))


def sequence_classes(sequences: DataFrame, w: int = 5) -> DataFrame:
    """``(seq_id, class_id, n)``: sequences with one set of shingles share the smallest ``seq_id``; ``n`` is the set's size.

    Sequences without shingles (NULL, empty, fewer than ``w`` ids) and NULL ids are
    left out. Ids inside a sequence that are NULL count as an id of their own.
    """
    ship(sequences.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seqs, sizes, elements in _sets(batch, w):
                at = np.cumsum(sizes) - sizes  # every sequence has a shingle
                columns = (seqs, sizes, np.add.reduceat(elements, at).view(np.int64), np.bitwise_xor.reduceat(_mix(elements), at).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["seq_id", "n", "d1", "d2"])

    digests = _with_shingles(sequences, w).mapInArrow(run, "seq_id bigint, n bigint, d1 bigint, d2 bigint")
    digests = materialize(digests, "digests")
    firsts = digests.groupBy("d1", "d2", "n").agg(F.min("seq_id").alias("class_id"))
    return digests.join(firsts, ["d1", "d2", "n"]).select("seq_id", "class_id", "n")


def _with_shingles(sequences: DataFrame, w: int) -> DataFrame:
    return sequences.where(f"seq_id is not null and size(tokens) >= {w}").select(F.col("seq_id").cast("bigint").alias("seq_id"), "tokens")


def _small(ids: DataFrame) -> DataFrame:
    """``ids``, to be broadcast if their number, which is counted, allows it; else sequences are shuffled to meet them."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def frequencies(sequences: DataFrame, bits: int, w: int) -> np.ndarray:
    """2^``bits`` counters: how many sequences hold an element of that hash, as :func:`coded`, so that order stays where counts are large. Never too low, so a 1 is sure."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int32)
        for batch in batches:
            for _, _, elements in _sets(batch, w):
                np.add.at(total, (elements >> np.uint64(64 - bits)).astype(np.int64), 1)
        pages = total.reshape(-1, min(PAGE, 1 << bits))
        for i in np.flatnonzero(pages.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([_packed(pages[i])], pa.binary())], ["page", "counters"])

    def add(pages: pa.Table) -> pa.Table:
        return pa.table({"page": pages["page"][:1], "task": pages["task"][:1], "counters": pa.array([_packed(sum(_unpacked(x.as_py()) for x in pages["counters"]))], pa.binary())})

    # One set of pages a task, added up as a tree, so no group is as large as the number of tasks; the driver gets the sum.
    fewer = sequences.coalesce(max(FAN, 2 * sequences.sparkSession.sparkContext.defaultParallelism))
    counted = materialize(fewer.mapInArrow(count, "page bigint, counters binary").withColumn("task", F.spark_partition_id()), "counted")
    tasks = (counted.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        counted = counted.withColumn("task", F.call_function("div", "task", F.lit(FAN)).cast("int")).groupBy("page", "task").applyInArrow(add, "page bigint, task int, counters binary")
        tasks = -(-tasks // FAN)
    sketch = np.zeros((max(1, (1 << bits) // PAGE), min(PAGE, 1 << bits)), dtype=np.uint8)
    for r in counted.toLocalIterator():
        sketch[r.page] = coded(_unpacked(r.counters))
    return sketch.ravel()


def _packed(counters: np.ndarray) -> bytes:
    """Low bytes, then high bytes, which hardly anywhere are more than 0."""
    return zlib.compress(np.minimum(counters, 65535).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), 1)


def _unpacked(page: bytes) -> np.ndarray:
    low, high = np.frombuffer(zlib.decompress(page), dtype=np.uint8).reshape(2, -1).astype(np.int32)
    return low + 256 * high


def coded(n: np.ndarray) -> np.ndarray:
    """Numbers up to 16 as they are, larger ones by sixteenths of an octave: one byte, in order."""
    return np.where(n <= 16, n, 16 + np.floor(16 * np.log2(np.maximum(n, 16) / 16))).astype(np.uint8)


def _octaves(n: np.ndarray) -> np.ndarray:
    """Eighths of an octave, rounded down; seven bits."""
    return np.minimum(np.floor(8 * np.log2(np.maximum(n, 1)) + 1e-9), 127).astype(np.uint8)


def paired_from(t: float) -> float:
    """The size from which a set meets all similar sets of that size or more by neighbours (module text); never for ``t`` up to a half."""
    return math.ceil(2 / (2 * t - 1) - 1e-9) if t > 0.5 else math.inf


def signatures(keys: np.ndarray, sizes: np.ndarray, t: float, shared: int = SHARED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets laid end to end, in order: ``(hashes, rows of sets, single)``; similar sets have ``shared`` hashes of neighbours in common (all they must, if fewer), or one of a single element."""
    first = np.cumsum(sizes) - sizes
    least = np.maximum(np.ceil((2 * t - 1) * sizes - 1 - 1e-9), 1)
    pairs = np.where(sizes >= paired_from(t), np.minimum(sizes - 1, sizes - 1 - least + shared), 0).astype(np.int64)
    singles = np.where(sizes * t < paired_from(t), sizes - np.ceil(t * sizes - 1e-9) + 1, 0).astype(np.int64)
    starts = [np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()) for n in (pairs, singles)]
    met = [keys[at] >= np.uint64(2 << 56) for at in starts]  # nobody else has the others: they meet nobody
    starts = [at[some] for at, some in zip(starts, met)]
    hashes = np.concatenate([_mix(keys[starts[0]] * np.uint64(0x9E3779B97F4A7C15) + keys[starts[0] + 1]), _mix(keys[starts[1]] ^ np.uint64(0xD6E8FEB86659FD93))])
    owners = np.concatenate([np.repeat(np.arange(len(sizes)), n)[some] for n, some in zip((pairs, singles), met)])
    return hashes, owners, np.arange(len(hashes)) >= len(starts[0])


def ordered(elements: np.ndarray, sizes: np.ndarray, counters: np.ndarray, bits: int) -> np.ndarray:
    """Keys of the sets' elements, each set in the one order of all elements, rare ones first: a byte of frequency, 56 bits of hash."""
    keys = (counters[(elements >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (elements >> np.uint64(8))
    at = 0
    for n in sizes.tolist():
        keys[at : at + n].sort()
        at += n
    return keys


def _small_type(n: int) -> np.dtype:
    return np.dtype(next(x for x in (np.uint8, np.uint16, np.uint32, np.uint64) if n <= np.iinfo(x).max))


def meetings(blocks: list[tuple], t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(seq, seq, votes)``, smaller first, of rows of equal hash whose sizes are near enough, from blocks of ``(first, width, steps, hashes, octaves)``."""
    seqs = np.concatenate([first + np.cumsum(np.frombuffer(steps, dtype=f"u{width}").astype(np.int64)) for first, width, steps, _, _ in blocks])
    hashes = np.concatenate([np.frombuffer(b[3], dtype=np.uint32) for b in blocks])
    octaves = np.concatenate([np.frombuffer(b[4], dtype=np.uint8) for b in blocks])
    order = np.argsort(hashes)
    hashes = hashes[order]
    far = math.ceil(-8 * math.log2(t) + 1e-6)
    # From here on a pair is sure to owe all the votes; the octave is rounded down.
    owing = _octaves(np.array([(SHARED + 1) / (2 * t - 1) if t > 0.5 else 1]))[0] + 1
    here, step = np.arange(len(hashes)), 0
    while True:
        step += 1
        here = here[: np.searchsorted(here, len(hashes) - step)]
        here = here[hashes[here] == hashes[here + step]]
        if not len(here):
            return
        for k in range(0, len(here), IDS_AT_ONCE):
            x, y = order[here[k : k + IDS_AT_ONCE]], order[here[k : k + IDS_AT_ONCE] + step]
            one, other = octaves[x] & 127, octaves[y] & 127
            single = octaves[x] >> 7
            near = (np.abs(one.astype(np.int16) - other) <= far) & (seqs[x] != seqs[y]) & (single == octaves[y] >> 7)
            votes = np.where((single == 1) | (np.maximum(one, other) < owing), SHARED, 1)[near]
            x, y = seqs[x[near]], seqs[y[near]]
            yield np.minimum(x, y), np.maximum(x, y), votes


def class_links(sequences: DataFrame, classes: DataFrame, t: float, w: int = 5) -> DataFrame:
    """``(class_a, class_b)`` of classes whose sets have Jaccard at least ``t``, smaller id first; every link, no class with itself."""
    spark = sequences.sparkSession
    copies = classes.where("seq_id <> class_id").select("seq_id")
    firsts = _with_shingles(sequences, w).join(_small(copies), "seq_id", "left_anti")
    total = classes.where("seq_id = class_id").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(SKETCH_BITS, max(8, (total - 1).bit_length()))
    frequency = spark.sparkContext.broadcast(frequencies(firsts, bits, w))
    rounds = max(1, min(ROUNDS, total // ROUND))
    parts = max(1, total // rounds // PART, int(spark.conf.get("spark.sql.shuffle.partitions")) if total > PART else 1)

    def met(turn: int) -> DataFrame:
        def blocks(held: list) -> Iterator[pa.RecordBatch]:
            part, hashes, seqs, octaves = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(seqs, kind="stable")
            order = order[np.argsort(part[order], kind="stable")]
            part, hashes, seqs, octaves = part[order], hashes[order], seqs[order], octaves[order]
            ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1
            rows = []
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                steps = np.diff(seqs[a:b], prepend=seqs[a])
                kind = _small_type(int(steps.max()))
                rows.append((int(part[a]), int(seqs[a]), kind.itemsize, steps.astype(kind).tobytes(), hashes[a:b].tobytes(), octaves[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "first", "width", "steps", "hashes", "octaves"])

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counters, held, n = frequency.value, [], 0
            for batch in batches:
                for seqs, sizes, elements in _sets(batch, w):
                    hashes, owners, single = signatures(ordered(elements, sizes, counters, bits), sizes, t)
                    mine = np.flatnonzero((hashes >> np.uint64(56)) % np.uint64(rounds) == turn)
                    hashes, owners = hashes[mine], owners[mine]
                    part = ((hashes >> np.uint64(32)) % np.uint64(1 << 24) * np.uint64(parts) >> np.uint64(24)).astype(_small_type(parts))
                    held.append((part, hashes.astype(np.uint32), seqs[owners], _octaves(sizes)[owners] | (single[mine].astype(np.uint8) << 7)))
                    n += len(mine)
                    if n >= HELD:
                        yield from blocks(held)
                        held, n = [], 0
            if n:
                yield from blocks(held)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_part: dict[int, list] = {}
            for batch in batches:
                for part, *block in zip(*(c.to_pylist() for c in batch.columns)):
                    by_part.setdefault(part, []).append(block)
            while by_part:
                for columns in meetings(by_part.popitem()[1], t):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["class_a", "class_b", "votes"])

        signed = firsts.mapInArrow(sign, "part int, first bigint, width int, steps binary, hashes binary, octaves binary")
        return signed.repartition(parts, "part").mapInArrow(meet, "class_a bigint, class_b bigint, votes bigint")

    votes = []
    for turn in range(rounds):
        counted = met(turn).groupBy("class_a", "class_b").agg(F.sum("votes").alias("votes"))
        votes.append(materialize(counted if rounds > 1 else counted.where(f"votes >= {SHARED}"), "votes"))
        if rounds > 1:  # the round's shuffle files go as soon as nothing refers to them
            del counted
            gc.collect()
            spark._jvm.System.gc()
    if rounds > 1:
        candidates = materialize(reduce(DataFrame.unionByName, votes).groupBy("class_a", "class_b").agg(F.sum("votes").alias("votes")).where(f"votes >= {SHARED}").select("class_a", "class_b"), "candidates")
    else:
        candidates = votes[0].select("class_a", "class_b")

    def of(pairs: DataFrame, describe, schema: str) -> DataFrame:
        """``pairs`` with what ``describe`` makes of both sides' sequences."""
        needed = _small(materialize(pairs.select(F.explode(F.array("class_a", "class_b")).alias("seq_id")).distinct(), "needed"))
        described = materialize(firsts.join(needed, "seq_id", "left_semi").mapInArrow(describe, f"seq bigint, {schema}"), "described")
        for side in "ab":
            pairs = pairs.join(described.select(F.col("seq").alias(f"class_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in described.columns[1:]]), f"class_{side}")
        return pairs

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            budget = _budget(t, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            ring_a, ring_b = batch.column("ring_a"), batch.column("ring_b")
            widths = np.stack([np.diff(np.frombuffer(r.buffers()[1], dtype=np.int32)[r.offset : r.offset + len(r) + 1]) for r in (ring_a, ring_b)])
            kept = np.zeros(batch.num_rows, dtype=bool)
            for wide in np.unique(widths, axis=1).T.tolist():
                some = np.flatnonzero((widths[0] == wide[0]) & (widths[1] == wide[1]))
                x, y = (np.frombuffer(b"".join(r.take(pa.array(some)).to_pylist()), dtype=np.uint8).reshape(len(some), -1) for r in (ring_a, ring_b))
                kept[some] = pigeonring(differences(x, y), budget[some])
            yield batch.select(["class_a", "class_b"]).filter(pa.array(kept))

    def rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seqs, sizes, elements in _sets(batch, w):
                ends = np.cumsum(sizes).tolist()
                made = [parity_sketch(elements[end - n : end], ring_bits(n)) for n, end in zip(sizes.tolist(), ends)]
                yield pa.RecordBatch.from_arrays([pa.array(seqs), pa.array(sizes), pa.array(made, pa.binary())], ["seq", "n", "ring"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seqs, sizes, elements in _sets(batch, w):
                yield pa.RecordBatch.from_arrays([pa.array(seqs), _longs(elements, sizes)], ["seq", "elements"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("elements_a"), batch.column("elements_b")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(common / (len(x) + len(y) - common) >= t)
            yield batch.select(["class_a", "class_b"]).filter(pa.array(kept, pa.bool_()))

    pruned = materialize(of(candidates, rings, "n bigint, ring binary").mapInArrow(chain, "class_a bigint, class_b bigint"), "pruned")
    return of(pruned, whole, "elements array<bigint>").mapInArrow(verify, "class_a bigint, class_b bigint")


def similar_classes(sequences: DataFrame, t: float = 0.8, w: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(classes, links)``: membership ``seq_id, class_id, n`` and pairs ``class_a, class_b`` of representatives.

    Complete: no link between different sets is lost, whatever their frequency.
    """
    if not 0 < t <= 1:
        raise ValueError("t must be in (0, 1]")
    classes = materialize(sequence_classes(sequences, w), "classes")
    return classes, materialize(class_links(sequences, classes, t, w), "links")


def similar_pairs(sequences: DataFrame, t: float = 0.8, w: int = 5) -> DataFrame:
    """``(seq_a, seq_b)``, smaller id first: all pairs of sequences with Jaccard at least ``t``, copies included.

    The pairs are the result, so its size is what the input asks for; searching is
    done between classes only, and copies are expanded at the end by equi-joins.
    """
    classes, links = similar_classes(sequences, t, w)
    several = classes.groupBy("class_id").count().where("count > 1").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"))
    members = classes.select("seq_id", "class_id")
    pairs = (
        links.unionByName(several)
        .join(members.select(F.col("seq_id").alias("x"), F.col("class_id").alias("class_a")), "class_a")
        .join(members.select(F.col("seq_id").alias("y"), F.col("class_id").alias("class_b")), "class_b")
        .where("x <> y AND (class_a <> class_b OR x < y)")
    )
    return pairs.select(F.least("x", "y").alias("seq_a"), F.greatest("x", "y").alias("seq_b"))
