"""Embedding near-dedup with an inverted multi-index.

Two codebooks, one for each half of the unit vectors, are fitted on a bounded sample (at most `sample` vectors, chosen by
hash); their product is the grid of cells and every vector is indexed. A vector visits cells in the order of the
multi-sequence traversal: by the sum over both halves of the squared distance to the border of the cell's half. It
stops at a radius calibrated on simulated pairs at exactly the wanted cosine, and on the sample's own pairs near it, so that `recall` of
both are reached; nearer pairs are reached more often. What the visits meet is verified by the cosine in double precision.

Cells are cut into chunks of at most `chunk` indexed vectors and `chunk` visitors, each pair of chunks being a task; links
are counted there and passed on as sums and spanning forests, never as pairs. Equal vectors are compared once.

Large groups of near copies are not compared pair by pair: pivots are found in the sample, and all vectors within half the
linking angle of one pivot are linked with each other by the triangle inequality, so they only count their group's size.
They are still compared with everything outside their group.

Vectors that are null, zero, or hold null or non-finite components link with nothing; each length of vectors has an index of its own. Rows
with a null id are compared too but have no component. Repeated rows stay and count as vectors of their own. An empty
table gives an empty result. Other columns of the input (labels too) are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, files_for, row_files
from .components import connected_components


#: A table of cells up to this many rows is broadcast; a longer one is joined by shuffling.
BROADCAST_ROWS = 500_000


def unit_rows(table) -> np.ndarray:
    """A list column as unit vectors in double precision."""
    flat = table.combine_chunks() if isinstance(table, pa.ChunkedArray) else table
    x = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_codebook(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """k-means centres of the rows of x."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def border_distances(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row, and its squared distance to the border with each other cell (0 for its own)."""
    d = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T
    own = d.argmin(axis=1)
    gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
    between = 2 * np.maximum(gaps[own], 1e-12)
    border = np.maximum(d - d[np.arange(len(x)), own][:, None], 0) / between
    border[np.arange(len(x)), own] = 0
    return own, border * border


def multi_sequence(d1: np.ndarray, d2: np.ndarray, radius: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in ascending order of d1[i] + d2[j], up to the radius."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap = [(s1[0] + s2[0], 0, 0)]
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > radius:
            return
        yield int(o1[i]), int(o2[j])
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if not j and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))


def dense_pivots(sample: np.ndarray, inner: float, least: int = 10, size: int = 4000) -> np.ndarray:
    """Vectors of the sample with `least` others of it within cosine `inner`, each group once, the largest first."""
    u = sample[:size]
    near = u @ u.T >= inner
    counts, pivots = near.sum(axis=1), []
    while len(counts) and counts.max() > least:
        i = int(counts.argmax())
        taken = near[i].copy()
        pivots.append(u[i])
        counts -= near[:, taken].sum(axis=1)
        near[:, taken] = False
    return np.array(pivots).reshape(-1, sample.shape[1])


class MultiIndex:
    """Codebooks of both halves, the calibrated radius, and the pivots of dense groups."""

    def __init__(self, sample: np.ndarray, n_vectors: int, cosine: float, recall: float, cell_size: int, seed: int = 7):
        self.half = sample.shape[1] // 2
        # cells of about cell_size vectors, as far as the sample has 20 vectors a centre
        k = int(min(max(2, len(sample) // 20), max(2, np.ceil(np.sqrt(n_vectors / cell_size)))))
        self.books = [fit_codebook(sample[:, : self.half], k), fit_codebook(sample[:, self.half :], k)]
        rng = np.random.default_rng(seed)
        x = sample[rng.choice(len(sample), min(len(sample), 4000), replace=False)]
        near = x @ x.T
        real = np.argwhere(np.triu((near >= cosine) & (near < (1 + cosine) / 2), 1))[:100_000]  # the sample's own pairs near the wanted cosine
        noise = rng.standard_normal(x.shape)
        noise -= (noise * x).sum(axis=1, keepdims=True) * x
        size = np.sqrt((noise * noise).sum(axis=1, keepdims=True))
        y = cosine * x + np.sqrt(1 - cosine * cosine) * noise / np.maximum(size, 1e-12)
        (_, b1), (_, b2) = self.borders(x)
        (c1, _), (c2, _) = self.borders(y)
        at = np.arange(len(x))
        #: Cosine of half the linking angle, with room for rounding.
        self.inner = np.sqrt((1 + cosine) / 2) + 1e-6
        self.pivots = dense_pivots(sample, self.inner)
        reach = np.quantile(b1[at, c1] + b2[at, c2], recall)
        if len(real):
            ((own1, r1), (own2, r2)), i, j = self.borders(x), real[:, 0], real[:, 1]
            reach = max(reach, np.quantile(r1[i, own1[j]] + r2[i, own2[j]], recall))
        self.radius = float(reach) + 1e-9

    def borders(self, x: np.ndarray):
        return border_distances(x[:, : self.half], self.books[0]), border_distances(x[:, self.half :], self.books[1])

    def dense_group(self, x: np.ndarray) -> np.ndarray:
        """The dense group of each row, or -1."""
        if not len(self.pivots):
            return np.full(len(x), -1)
        near = x @ self.pivots.T
        return np.where(near.max(axis=1) >= self.inner, near.argmax(axis=1), -1)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """The cell of each row, and the cells it visits: its own and later ones (the pair's other end visits the earlier)."""
        (c1, b1), (c2, b2) = self.borders(x)
        width = len(self.books[1])
        cells = c1 * width + c2
        return cells, [
            [c for i, j in multi_sequence(b1[r], b2[r], self.radius) if (c := i * width + j) >= own] for r, own in enumerate(cells.tolist())
        ]


def _forest(hits: np.ndarray, x_ids: np.ndarray, y_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, root) that span the components of the bipartite graph `hits`."""
    a, b = [], []
    open_x = hits.any(axis=1)
    while open_x.any():
        xs = np.zeros(len(x_ids), bool)
        ys = np.zeros(len(y_ids), bool)
        new = np.zeros(len(x_ids), bool)
        new[int(open_x.argmax())] = True
        while new.any():
            xs |= new
            more = hits[new].any(axis=0) & ~ys
            ys |= more
            new = hits[:, more].any(axis=1) & ~xs if more.any() else np.zeros(len(x_ids), bool)
        open_x &= ~xs
        ids = np.unique(np.concatenate([x_ids[xs], y_ids[ys]]))
        a.append(ids[1:])
        b.append(np.full(len(ids) - 1, ids[0]))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def embedding_components(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = 0.9,
    recall: float = 0.999,
    sample: int = 20_000,
    cell_size: int = 1000,
    chunk: int = 2048,
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: links at a cosine of at least `cosine`, between vectors of one length."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    finite = lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))), F.lit(False))
    usable = v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda e: e != 0)
    # a vector's digest: 128 bits, so that copies meet without moving vectors
    digest = [F.when(usable, F.xxhash64(F.lit(k), F.size(v), v)).alias(f"h{k}") for k in (1, 2)]
    total = vectors.count()
    of_row = durable(rows.select("id", *digest), row_files(total))
    reps = durable(
        rows.where(usable).select("id", "v", *digest).groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.coalesce("id", F.col("h1").bitwiseOR(F.lit(-(1 << 63)).cast("long")))),
        row_files(total),
    )
    found = None
    for length, n in sorted(tuple(r) for r in reps.groupBy(F.size(v)).count().collect()):  # a row for each length of vectors
        one = reps.where(F.size(v) == length)
        fit = one.orderBy(F.xxhash64("node"), "node").limit(sample).select("v").toArrow().column("v")
        links = _found(one, MultiIndex(unit_rows(fit), n, cosine, recall, cell_size), cosine, chunk)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "node long, other long, n long")
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("found"))
    comp = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), total)
    named = durable(
        reps.select("h1", "h2", "node", "copies").join(counts, "node", "left")
        .join(comp.select(F.col("node").alias("node_"), "root"), F.col("node") == F.col("node_"), "left")
        .select("h1", "h2", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "node").alias("root")),
        files_for(total),
    )
    linked = of_row.where("h1 is not null").join(named, ["h1", "h2"]).select("id", "n", "root")
    alone = of_row.where("h1 is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("root"))
    out = linked.unionByName(alone)
    component = F.when(F.col("id").isNotNull(), F.col("root"))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _found(reps: DataFrame, index: MultiIndex, cosine: float, chunk: int) -> DataFrame:
    """(node, null, links found here) and (node, other, 0) for links that span what is linked."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit_rows(batch.column("v"))
                cells, visits = index.visits(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ("node", "copies", "v")),
                        pa.array(cells.astype(np.int64)),
                        pa.array(index.dense_group(x).astype(np.int32)),
                        pa.array(visits, pa.list_(pa.int64())),
                    ],
                    names=["node", "copies", "v", "cell", "dense", "visits"],
                )

    kind = reps.schema["v"].dataType.simpleString()
    placed = durable(reps.select("node", "copies", "v").mapInArrow(visit, f"node long, copies long, v {kind}, cell long, dense int, visits array<long>"), row_files(reps.count()))
    # visitors of each part of a cell: all of the cell's, but for those of the part's own dense group
    own = placed.groupBy("cell", "dense").agg(F.count(F.lit(1)).alias("n_own"))
    guests = durable(placed.select(F.explode("visits").alias("cell"), F.col("dense").alias("from")).groupBy("cell", "from").agg(F.count(F.lit(1)).alias("n")), 24)
    every = guests.groupBy("cell").agg(F.sum("n").alias("n_all"))
    kin = guests.where(F.col("from") >= 0).withColumnRenamed("from", "dense")
    sized = own.join(every, "cell").join(kin, ["cell", "dense"], "left").withColumn("n_guests", F.col("n_all") - F.coalesce("n", F.lit(0)))
    parts = durable(
        sized.where("n_guests > 0").select(
            "cell", F.col("dense").alias("part"), F.ceil(F.col("n_own") / chunk).cast("int").alias("p"), F.ceil(F.col("n_guests") / chunk).cast("int").alias("q")
        ),
        24,
    )
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    host = placed.select("node", "copies", "v", "cell", "dense", F.lit(True).alias("host"), F.col("cell").alias("home"))
    host = host.join(parts.withColumnRenamed("part", "dense"), ["cell", "dense"]).withColumnRenamed("dense", "part")
    host = host.withColumn("pp", F.pmod(F.xxhash64("node"), F.col("p")).cast("int")).withColumn("qq", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    guest = placed.select("node", "copies", "v", F.explode("visits").alias("at"), "dense", F.lit(False).alias("host"), F.col("cell").alias("home"))
    guest = guest.withColumnRenamed("at", "cell").join(parts, "cell").where((F.col("dense") < 0) | (F.col("dense") != F.col("part")))
    guest = guest.withColumn("qq", F.pmod(F.xxhash64("node"), F.col("q")).cast("int")).withColumn("pp", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))

    def compare(table: pa.Table) -> pa.Table:
        host_ = table.column("host").to_numpy()
        guest_, ids, copies = ~host_, table.column("node").to_numpy(), table.column("copies").to_numpy()
        x, gi, hi = unit_rows(table.column("v")), ids[~host_], ids[host_]
        hits = x[guest_] @ x[host_].T >= cosine
        # a visitor that lives in this cell is indexed here too: each of its pairs counts once
        native = table.column("home").to_numpy()[guest_] == table.column("cell").to_numpy()[guest_]
        hits &= ~native[:, None] | (gi[:, None] < hi[None])
        out = [(gi, hits @ copies[host_]), (hi, hits.T @ copies[guest_])]
        a, b = _forest(hits, gi, hi)
        node = np.concatenate([out[0][0], out[1][0], a])
        n = np.concatenate([out[0][1], out[1][1], np.zeros(len(a), np.int64)]).astype(np.int64)
        other = pa.array(np.concatenate([np.zeros(len(gi) + len(hi), np.int64), b]), mask=np.arange(len(node)) < len(gi) + len(hi))
        keep = pa.array((n > 0) | (np.arange(len(node)) >= len(gi) + len(hi)))
        return pa.table({"node": node, "other": other, "n": n}).filter(keep)

    names = ["node", "copies", "v", "cell", "part", "home", "host", "pp", "qq"]
    both = host.select(*names).unionByName(guest.select(*names))
    compared = both.groupBy("cell", "part", "pp", "qq").applyInArrow(compare, "node long, other long, n long")
    groups = placed.where("dense >= 0").groupBy("dense").agg(F.sum("copies").alias("total"), F.min("node").alias("first"))
    members = placed.where("dense >= 0").select("node", "copies", "dense").join(F.broadcast(groups), "dense")  # as many groups as pivots, of which the sample of 4000 gives at most 400
    inside = members.select("node", F.lit(None).cast("long").alias("other"), (F.col("total") - F.col("copies")).alias("n"))
    ties = members.where("node <> first").select("node", F.col("first").alias("other"), F.lit(0).cast("long").alias("n"))
    return durable(compared.unionByName(inside.where("n > 0")).unionByName(ties).repartition(row_files(reps.count())))
