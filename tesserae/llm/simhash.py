"""SimHash near-dedup with bit-sliced comparison.

The bits of fingerprints are cut into blocks; documents that agree on enough blocks share a bucket. Inside a block of buckets the
fingerprints are turned into vertical bit planes (one long integer a bit, one lane a document). The distances of all
lanes to the lane `s` places on are counted at once by carry-save adders over the planes, and a block is abandoned
for that `s` as soon as every lane is beyond the radius. A bucket with more than `bucket_limit` fingerprints is split
into chunks and each pair of chunks is compared in its own task, so every pair within a bucket is still compared.

Null text counts as empty and has fingerprint zero, which links like any other. Equal fingerprints are compared once,
through their smallest id. Rows with a null id get a fingerprint and a null component. Repeated rows stay. An empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, files_for, map_texts, release, row_files
from .components import connected_components

_GOLDEN = 0x9E3779B97F4A7C15
_CHUNK = 65536


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included, as unsigned 64-bit integers."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(whole, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = [digest(whole[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    return np.array(hashes, np.uint64)


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """A further 64-bit hash of each h (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(_GOLDEN * j & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def simhash_words(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """n_words * 64 fingerprint bits: a bit is 1 if set in over half the hashes. Works through 64k hashes at a time."""
    n = len(hashes)
    if not n:
        return np.zeros(n_words, np.uint64)
    ones = np.zeros(64 * n_words, np.int64)
    for at in range(0, n, _CHUNK):
        part = hashes[at : at + _CHUNK]
        wide = np.stack([part if j == 0 else _mixed(part, j) for j in range(n_words)], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1, bitorder="little")
        for b in range(0, len(part), 255):
            ones += np.add.reduce(bits[b : b + 255], axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id long, fp long): the 64-bit SimHash of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash_words(shingle_hashes(text.as_py(), shingle), 1).view(np.int64) for text in batch.column(1)]
            if fps:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(fps))], names=["id", "fp"])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, fp long")


def block_masks(n: int, radius: int, fill: float = 64) -> list[int]:
    """Masks of 64 bits, one of which leaves any two fingerprints within `radius` bits equal: the bits are cut into b blocks,
    and each mask holds b - radius of them. b is the least (up to radius + 4) at which n random fingerprints fill the
    buckets of a mask with at most `fill` each, so buckets stay small however many fingerprints there are."""
    for b in range(radius + 1, radius + 5):
        edges = [round(64 * i / b) for i in range(b + 1)]
        blocks = [(1 << hi) - (1 << lo) for lo, hi in itertools.pairwise(edges)]
        masks = [sum(c) for c in itertools.combinations(blocks, b - radius)]
        if n <= fill * 2 ** min(m.bit_count() for m in masks):
            break
    return masks


class BitPlanes:
    """Fingerprints of a block of lanes, stored as one long integer a bit."""

    def __init__(self, words: np.ndarray, radius: int):
        n, m = words.shape
        bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        self.planes = [int.from_bytes(row.tobytes(), "little") for row in packed]
        self.n, self.depth = n, (radius + 1).bit_length()
        #: Counters start so high that they overflow at radius + 1 differing bits.
        self.start = (1 << self.depth) - (radius + 1)

    def within(self, shift: int, active: int) -> int:
        """The lanes of `active` whose distance to the lane `shift` places on is at most the radius."""
        counters = [active if self.start >> d & 1 else 0 for d in range(self.depth)]
        over, planes = 0, self.planes
        for at in range(0, len(planes), 2):
            p, q = planes[at], planes[at + 1]
            p, q = p ^ (p >> shift), q ^ (q >> shift)
            # a full adder takes two planes and the lowest counter; its carry ripples up
            u = counters[0] ^ p
            carry = (counters[0] & p) | (u & q)
            counters[0] = u ^ q
            for d in range(1, self.depth):
                if not carry:
                    break
                c = counters[d]
                counters[d], carry = c ^ carry, c & carry
            over |= carry
            if at & 7 == 6 and not active & ~over:
                return 0
        return active & ~over


def _lanes(mask: int, n: int) -> np.ndarray:
    raw = np.frombuffer(mask.to_bytes((n + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little", count=n))


def block_roots(words: np.ndarray, sizes: np.ndarray, radius: int, like: Callable | None = None) -> np.ndarray:
    """words: the fingerprints of whole buckets one after another, sizes: the buckets' sizes.

    Returns the root of each lane: lanes of one bucket that links within `radius` bits (and `like`, if given: a test of lanes
    i, j and their distances) join have one root."""
    n = len(words)
    root = np.arange(n)
    left = np.concatenate([np.arange(s, 0, -1) for s in sizes]) - 1  # lanes of the same bucket that follow
    planes = BitPlanes(words, radius)
    for shift in range(1, int(sizes.max())):
        active = int.from_bytes(np.packbits(left >= shift, bitorder="little").tobytes(), "little")
        near = planes.within(shift, active)
        if not near:
            continue
        i = _lanes(near, n)
        j = i + shift
        i, j = (x[root[i] != root[j]] for x in (i, j))
        if like and len(i):
            i, j = (x[like(i, j, np.bitwise_count(words[i] ^ words[j]).sum(axis=1))] for x in (i, j))
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = root[a], root[b]
            if x != y:
                root[root == max(x, y)] = min(x, y)
    return root


def _compare(words: np.ndarray, ids: np.ndarray, n: np.ndarray | None, bucket: np.ndarray, radius: int, like: Callable | None, block: int) -> Iterator[tuple]:
    """All links inside the buckets (equal values are adjacent): arrays (a, b), a spanning forest."""
    cut = np.flatnonzero(np.diff(bucket)) + 1
    starts, sizes = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(bucket)]]))
    keep = sizes > 1
    starts, sizes = starts[keep], sizes[keep]
    order = np.argsort(-sizes, kind="stable")  # buckets of like sizes share a block
    starts, sizes = starts[order], sizes[order]
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = total[at] - sizes[at]
        end = max(at + 1, int(np.searchsorted(total, base + block, "right")))
        lanes = np.concatenate([np.arange(s, s + z) for s, z in zip(starts[at:end], sizes[at:end], strict=True)])
        test = None if like is None else (lambda m: lambda i, j, d: like(m[i], m[j], d))(n[lanes])
        root, got = block_roots(words[lanes], sizes[at:end], radius, test), ids[lanes]
        moved = root != np.arange(len(root))
        yield got[moved], got[root[moved]]
        at = end


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by `keys` as tables of whole groups of at least about `least` rows (but the last), and the group number of each row."""

    def marks(t: pa.Table) -> np.ndarray:
        changed = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            changed |= np.diff(t.column(k).to_numpy()) != 0
        return np.concatenate([[True], changed])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            t = pa.Table.from_batches(held)
            mark = marks(t)
            end = int(np.flatnonzero(mark)[-1])
            if end:
                yield t.slice(0, end), np.cumsum(mark[:end])
                held = t.slice(end).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.cumsum(marks(t))


def candidate_links(
    rows: DataFrame, words: list[str], radius: int, like: Callable | None = None, bucket_limit: int = 8192, block: int = 4096, star: bool = False
) -> DataFrame:
    """rows: (id, bucket, the fingerprint's words, and n if there is `like`). Returns links (a, b): spanning forests of the links
    within `radius` bits (and `like`, a test of both n and the distance) inside each bucket. Buckets of more than `bucket_limit` rows are
    compared chunk by chunk, or (`star`) joined as a whole without any comparison, where links are verified later."""
    names = ["id", "bucket", *words, *(["n"] if like else [])]
    large = durable(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first")).where(F.col("size") > bucket_limit))
    n_large = large.count()
    joined, stars = rows.select(*names, F.lit(-1).cast("long").alias("part")), None
    if n_large:
        few = F.broadcast(large) if n_large <= 100_000 else large
        if star:
            stars = rows.select("id", "bucket").join(few, "bucket").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
            joined = joined.join(few.select("bucket"), "bucket", "left_anti")
        else:
            parts = few.select("bucket", F.ceil(F.col("size") / bucket_limit).cast("int").alias("parts"))
            mine, n = F.pmod(F.xxhash64("id", "bucket"), F.col("parts")).cast("int"), F.col("parts")
            others = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(mine, j).cast("long") * n + F.greatest(mine, j))
            # a chunk meets every other chunk in its own task; a pair with itself is covered by any pair that holds it
            pairs = F.filter(others, lambda p: F.floor(p / n) != p % n)
            part = F.explode(F.when(n.isNull(), F.array(F.lit(-1).cast("long"))).otherwise(pairs))
            joined = rows.join(parts, "bucket", "left").select(*names, part.alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in sorted_groups(batches, ["bucket", "part"], _CHUNK):
            fps = np.stack([t.column(w).to_numpy() for w in words], axis=1).view(np.uint64)
            sizes = t.column("n").to_numpy() if like else None
            for a, b in _compare(fps, t.column("id").to_numpy(), sizes, group, radius, like, block):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    found = joined.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(run, "a long, b long")
    return (found.unionByName(stars) if stars is not None else found).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, fill: float = 64) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for each row: links at `radius` or fewer differing bits of 64.

    Exact: two linked fingerprints agree on one of the masks of `block_masks` at least.
    """
    total = docs.count()
    files = files_for(total)
    fps = durable(fingerprints(docs, id_col, text_col, shingle), row_files(total))
    reps = durable(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")), files)
    masks = block_masks(reps.count(), radius, fill)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for t, m in enumerate(signed)])
    links = candidate_links(reps.select("id", "fp", F.explode(keys).alias("bucket")), ["fp"], radius)
    comp = connected_components(links, total)
    named = reps.select("fp", F.col("id").alias("rep")).join(comp, F.col("rep") == F.col("node"), "left").select(
        F.col("fp").alias("fp_"), F.coalesce("root", "rep").alias("component_id")
    )
    return fps.join(named, F.col("fp") == F.col("fp_"), "left").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def _bit_difference(similarity: float) -> float:
    """Expected share of differing bits of two shingle sets of like size with this Jaccard similarity."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


class Likeness:
    """The test of candidates by set sizes and Hamming distance of wide SimHashes, and the exact one by the sets.

    Sizes of sets that are similar enough are within the factor `similarity`. Distances are at most 4 standard deviations beyond the
    mean at exactly `similarity`; with a set of at most `short` shingles, whose majorities tie often, at most 6 standard
    deviations below that of unlike texts."""

    def __init__(self, similarity: float, bits: int, short: int = 64):
        share = 1.02 * _bit_difference(similarity)  # 2 %: pairs of 65 shingles differ that much more than pairs of many
        self.similarity, self.short = similarity, short
        self.far = math.floor(bits / 2 - 3 * math.sqrt(bits))
        self.radius = min(self.far, round(bits * share + 4 * math.sqrt(bits * share * (1 - share))))

    def likely(self, n: np.ndarray, m: np.ndarray, distance: np.ndarray) -> np.ndarray:
        least, most = np.minimum(n, m), np.maximum(n, m)
        return (least >= self.similarity * most - 1e-9) & (distance <= np.where(least > self.short, self.radius, self.far))

    def enough(self, common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return common >= self.similarity * (n + m - common) - 1e-9


def common_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, limit: int = 1 << 26) -> np.ndarray:
    """Sizes of the intersections of sets i and j (sorted distinct values): by bit rows over the values that several sets
    share, where those take at most `limit` bytes and there are many pairs, else pair by pair."""
    if len(i) > 4 * len(sets):
        of = np.repeat(np.arange(len(sets)), list(map(len, sets)))
        _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1
        keep = count[value] > 1
        width = (int((count > 1).sum()) + 63) // 64
        if len(sets) * width * 8 <= limit:
            bits = np.zeros((len(sets), width * 64), np.uint8) if len(sets) * width * 64 <= limit else None
            if bits is not None:
                bits[of[keep], shared[value[keep]]] = 1
                rows = np.packbits(bits, axis=1).view(np.uint64)
            else:
                rows = np.zeros((len(sets), width), np.uint64)
                np.bitwise_or.at(rows, (of[keep], shared[value[keep]] >> 6), np.uint64(1) << (shared[value[keep]] & 63).astype(np.uint64))
            step = max(1, (1 << 21) // max(width, 1))
            return np.concatenate([np.bitwise_count(rows[i[a : a + step]] & rows[j[a : a + step]]).sum(axis=1, dtype=np.int64) for a in range(0, len(i), step)])
    return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)


def verified_merges(sets: list[np.ndarray], words: np.ndarray, label: np.ndarray, side: np.ndarray, test: Likeness) -> list[tuple[int, int]]:
    """The pairs (i, j) of sets, of different labels, that join all that links between them join: nearest fingerprints first, each verified on the
    sets, as long as its ends are apart. With two sides, only pairs between them are looked at."""
    n, two = len(sets), len(np.unique(side)) > 1
    sizes = np.array(list(map(len, sets)), np.int64)
    root = np.unique(label, return_inverse=True)[1]
    left, right, far = [], [], []
    step = max(1, (1 << 20) // max(n, 1))
    for a in range(0, n, step):
        rows = np.arange(a, min(n, a + step))
        d = np.bitwise_count(words[rows, None] ^ words[None]).sum(axis=2, dtype=np.int64)
        ok = test.likely(sizes[rows, None], sizes[None], d) & (root[rows, None] != root[None])
        ok &= (side[rows, None] < side[None]) if two else (rows[:, None] < np.arange(n)[None])
        i, j = np.nonzero(ok)
        left.append(rows[i])
        right.append(j)
        far.append(d[i, j])
    left, right, far = (np.concatenate(x) for x in (left, right, far))
    order = np.argsort(far, kind="stable")
    left, right, merges, turn = left[order], right[order], [], 0
    while len(left):
        apart = root[left] != root[right]
        left, right = left[apart], right[apart]
        if not len(left):
            break
        if turn < 8:  # each group's nearest pair
            take = np.union1d(np.unique(root[left], return_index=True)[1], np.unique(root[right], return_index=True)[1])
        else:
            take = np.arange(min(len(left), 1 << 14))
        turn += 1
        i, j = left[take], right[take]
        good = test.enough(common_counts(sets, i, j), sizes[i], sizes[j])
        for a, b in zip(i[good].tolist(), j[good].tolist(), strict=True):
            x, y = root[a], root[b]
            if x != y:
                root[root == max(x, y)] = min(x, y)
                merges.append((a, b))
        rest = np.ones(len(left), bool)
        rest[take] = False
        left, right = left[rest], right[rest]
    return merges


def near_duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    bits: int = 256,
    bands: int = 16,
    rows: int = 4,
    bucket_limit: int = 8192,
    chunk: int = 1024,
    load: int = 1 << 21,
) -> DataFrame:
    """(id, root) for each id that is not the smallest of its group of near copies.

    Links: Jaccard similarity of the sets of `shingle`-word shingles >= `similarity`; every link that joins two groups is verified on the sets.
    Equal sets are one text. Texts that agree on one of `bands` keys of `rows` min-hashes meet in a bucket, where their wide SimHashes
    are compared bit-sliced; at exactly 0.8, 1 - (1 - 0.8^4)^16 = 0.9998 of the pairs meet, whatever the size of the sets or the table. What is
    within the radius joins into families, as spanning forests, never as pairs; buckets beyond `bucket_limit` become families whole.
    A family goes to one task with its texts, which compares all its pairs and verifies the nearest ones first, until
    none that is likely is left between different groups. Families of more than `chunk` texts (or `load` shingles) are first cut by hash into parts, twice, which
    joins what is dense; then every pair of parts with texts that are still apart gets its task, so no link is lost.
    Of rows that repeat an id, any text's links count.
    """
    test = Likeness(similarity, bits)
    words = [f"w{k}" for k in range(bits // 64)]
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if not texts.groupBy("id").count().where("count > 1").isEmpty():
        texts = texts.distinct()
    total = docs.count()
    files = files_for(total)
    sets = durable(_profiles(texts, shingle, bits, bands, rows), row_files(total))
    reps = durable(sets.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")]), files)
    copied = reps.where("copies > 1").select("d1", "d2", F.col("id").alias("b"))
    same = durable(sets.select("d1", "d2", F.col("id").alias("a")).join(copied, ["d1", "d2"]).where("a <> b").select("a", "b").distinct(), files)
    rows_ = reps.select("id", "n", *[F.col("fp")[k].alias(w) for k, w in enumerate(words)], F.explode("keys").alias("bucket"))
    links = durable(candidate_links(rows_, words, test.far, test.likely, bucket_limit, star=True), files)
    joined = connected_components(links, total)
    family = joined.select(F.col("node").alias("id"), F.col("root").alias("family")).unionByName(joined.select(F.col("root").alias("id"), F.col("root").alias("family")).distinct())
    n = reps.groupBy("id").agg(F.sum("n").alias("n"))
    members = durable(family.join(n, "id"), files)
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("n") / load)).cast("int")
    families = durable(members.groupBy("family").agg(parts.alias("parts")), files)
    release(links)
    cut = families.where("parts > 1")
    n_cut = cut.count()
    if not n_cut:
        placed = members.select("id", "family", F.lit(0).alias("c1"), F.lit(0).alias("c2"), F.lit(0).alias("side"), F.col("id").alias("label"))
        found = durable(_merges(texts, placed, shingle, bits, test).repartition(files))
        return connected_components(found.unionByName(same), total)
    few = F.broadcast(cut) if n_cut <= 100_000 else cut
    hashed = lambda seed, k: F.pmod(F.xxhash64(F.lit(seed), F.col("id")), k).cast("int")
    large = durable(members.join(few, "family"), files)
    placed = members.join(few, "family", "left").select(
        "id", "family", F.coalesce(hashed(1, F.col("parts")), F.lit(0)).alias("c1"), F.lit(0).alias("c2"), F.lit(0).alias("side"), F.col("id").alias("label")
    )
    found = durable(_merges(texts, placed, shingle, bits, test).repartition(files))
    labels = _labelled(large, found, files)
    placed = labels.select("id", "family", hashed(2, F.col("parts")).alias("c1"), F.lit(0).alias("c2"), F.lit(0).alias("side"), "label")
    found = durable(found.unionByName(_merges(texts, placed, shingle, bits, test)).repartition(files))
    labels = _labelled(large, found, files)
    # a label with many texts has parts of its own, which need no comparison among each other; the others share parts
    of_label = labels.groupBy("family", "label").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("weight"))
    amount = F.greatest(F.ceil(F.col("texts") / chunk), F.ceil(F.col("weight") / load)).cast("int")
    own = durable(of_label.where((F.col("texts") * 2 >= chunk) | (F.col("weight") * 2 >= load)).withColumn("own_parts", amount).select("family", "label", "own_parts"), files)
    rest = labels.join(own, ["family", "label"], "left").withColumn("of", F.when(F.col("own_parts").isNotNull(), F.col("label")))
    shared = rest.where("of is null").groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("n") / load)).cast("int").alias("shared_parts"))
    rest = rest.join(F.broadcast(shared) if n_cut <= 100_000 else shared, "family", "left")
    rest = durable(rest.select("id", "family", "label", "of", F.xxhash64(F.lit(3), "of", hashed(3, F.coalesce("own_parts", "shared_parts"))).alias("c")), files)
    cells = durable(rest.groupBy("family", "c").agg(F.first("of").alias("of")), files)
    one, two = cells.select("family", F.col("c").alias("c1"), F.col("of").alias("o1")), cells.select("family", F.col("c").alias("c2"), F.col("of").alias("o2"))
    pairs = one.join(two, "family").where("(c1 < c2 and (o1 is null or o2 is null or o1 <> o2)) or (c1 = c2 and o1 is null)").select("family", "c1", "c2")
    ends = pairs.select("family", "c1", "c2", F.explode(F.when(F.col("c1") == F.col("c2"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    ends = ends.withColumn("c", F.when(F.col("side") == 0, F.col("c1")).otherwise(F.col("c2")))
    placed = rest.join(ends, ["family", "c"]).select("id", "family", "c1", "c2", "side", "label")
    found = durable(found.unionByName(_merges(texts, placed, shingle, bits, test)).repartition(files))
    return connected_components(found.unionByName(same), total)


def _labelled(members: DataFrame, links: DataFrame, files: int) -> DataFrame:
    """members with the label of the group that the links put each id into."""
    comp = connected_components(links, links.count())
    return durable(members.join(comp.select(F.col("node").alias("id"), F.col("root").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id")), files)


def _merges(texts: DataFrame, placed: DataFrame, shingle: int, bits: int, test: Likeness) -> DataFrame:
    """placed: (id, family, c1, c2, side, label). Verified links (a, b) that join labels inside each (family, c1, c2)."""
    keys = ["family", "c1", "c2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in sorted_groups(batches, keys, 256):
            edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]).tolist()
            ids, label, side, text = (*(t.column(c).to_numpy() for c in ("id", "label", "side")), t.column("text"))
            a, b = [], []
            for lo, hi in itertools.pairwise(edges):
                if len(np.unique(label[lo:hi])) > 1:
                    sets = [np.unique(shingle_hashes(x.as_py(), shingle)) for x in text.slice(lo, hi - lo)]
                    fps = np.stack([simhash_words(s, bits // 64) for s in sets])
                    for i, j in verified_merges(sets, fps, label[lo:hi], side[lo:hi], test):
                        a.append(ids[lo + i])
                        b.append(ids[lo + j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = texts.join(placed, "id").repartition(*keys).sortWithinPartitions(*keys)
    return map_texts(rows, run, "a long, b long")


#: Fixed odd multipliers, of which each gives one min-hash.
_ODDS = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(distinct: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band: a hash of `rows` min-hashes of a set of random 64-bit values. An empty set has none."""
    if not len(distinct):
        return np.empty(0, np.uint64)
    odds = _ODDS[: bands * rows]
    with np.errstate(over="ignore"):
        least = np.min([(distinct[at : at + 4096, None] * odds).min(axis=0) for at in range(0, len(distinct), 4096)], axis=0).reshape(bands, rows)
        key = np.arange(bands, dtype=np.uint64)
        for r in range(rows):
            key = _mixed(key ^ least[:, r], r + 1)
    return key


def _profiles(texts: DataFrame, shingle: int, bits: int, bands: int, rows: int) -> DataFrame:
    """(id, d1, d2: digest of the shingle set, n: its size, fp: its wide SimHash, keys: of its bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(1):
                distinct = np.unique(shingle_hashes(text.as_py(), shingle))
                digest = np.frombuffer(xxhash.xxh3_128_digest(distinct.tobytes()), np.int64)
                made.append((digest[0], digest[1], len(distinct), simhash_words(distinct, bits // 64).view(np.int64), band_keys(distinct, bands, rows).view(np.int64)))
            if made:
                d1, d2, n, fp, keys = zip(*made, strict=True)
                lists = lambda v: pa.array(v, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d1), pa.array(d2), pa.array(n, pa.int64()), lists(fp), lists(keys)], names=["id", "d1", "d2", "n", "fp", "keys"])

    return map_texts(texts, run, "id long, d1 long, d2 long, n long, fp array<long>, keys array<long>")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, one for each group of near copies: the one with the smallest id. Rows with a null id stay.

    Of repeated rows with one id, one stays (the one with the smallest text hash)."""
    groups = near_duplicate_groups(docs, id_col, text_col, **how)
    kept = docs.join(groups.select(F.col("node").alias("__copy")), F.col(id_col) == F.col("__copy"), "left_anti")
    ids = docs.select(F.col(id_col).alias("__repeated")).where("__repeated is not null")
    repeated = durable(ids.groupBy("__repeated").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__repeated"), 8)
    if repeated.isEmpty():
        return kept
    w = Window.partitionBy(id_col).orderBy(F.xxhash64(*[F.col(c) for c in docs.columns if c != id_col]))
    once = kept.join(repeated, F.col(id_col) == F.col("__repeated"), "left_semi").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return kept.join(repeated, F.col(id_col) == F.col("__repeated"), "left_anti").unionByName(once)
