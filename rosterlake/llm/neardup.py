"""Near duplicates by circulant MinHash, banding, and exact Jaccard on full shingle sets.

Two fixed random permutations of the places 0 to PLACES - 1 stand for all hash functions: the first
scatters a set's shingles over the places; the second, shifted circularly by k, gives the k-th
coordinate as the smallest value at the set's places. A table of the second permutation, continued
at its end by its own beginning, makes all coordinates of one shingle a slice, and a signature the
minimum of slices. Bands of coordinates are hashed; sets that share a band are candidates, and a
link counts only when the full sets reach the threshold.

Steps: texts with equal sets are one node, so that any number of copies costs one row from there on.
Each bucket's smallest node is compared with the others first, which joins most of a group of near
copies. Then all pairs of different components that share a bucket, and whose sizes allow a link, are
compared: buckets are cut into cells of two neighbouring size classes, since a link cannot reach farther,
equal cells of several bands count once, and a cell is compared exactly, by matrix products inside tasks, of
which only the links come out. A cell above CHUNK nodes is dealt into blocks. No bucket is capped, and no task
gets more than a block. Components come from joins alone.

With 26 bands of 5 coordinates, two sets at a Jaccard similarity of 0.85 share no band with a
probability of 2.5e-7, at 0.9 of 6e-11.

Defined results
* Null text, empty text and text without a word: an empty set, linked with nothing, its own component.
* Equal ids in several rows: they are one document for the component number; each row is returned.
* A null id has a null component unless its set is linked to documents with ids, and is kept if its
  component is null.
* Texts of any length are read whole. Columns of the input other than id and text do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import workers_import
from rosterlake.operators.skew import SkewPolicy, skew_join
from rosterlake.session import written

BANDS, ROWS = 26, 5
PLACES = 1 << 22
#: Nodes, and shingles, that are compared with as many others in one block, and columns of its 0/1 matrices.
CHUNK, CHUNK_SHINGLES, COLUMNS = 1_024, 4_000_000, 8_192
#: Pairs of one hub in one task.
HUB_PAIRS = 2_000
#: Candidate documents of at most so many (8 bytes each) are sent to all executors to pick their texts.
BROADCAST_ROWS = 500_000
MOST_WORDS = 150_000


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and slices of the other: row p holds all coordinates of place p."""
    draw = np.random.Generator(np.random.PCG64(20_240_229))
    scatter = draw.permutation(PLACES).astype(np.uint32)
    ring = draw.permutation(PLACES).astype(np.uint32)
    ring = np.concatenate((ring, ring[: BANDS * ROWS]))
    return scatter, np.lib.stride_tricks.sliding_window_view(ring, BANDS * ROWS)


class Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_WORDS = Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of `size` words; of all words if there are fewer.

    bytes.lower and bytes.split touch ASCII only, as the definition of words asks.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = _mixed(total ^ hashes[i : len(hashes) - size + 1 + i]) + np.uint64(0x9E3779B97F4A7C15)
    return np.unique(total)


def signature(own: np.ndarray) -> np.ndarray:
    """BANDS * ROWS coordinates of a non-empty set."""
    scatter, slices = permutations()
    places = scatter[own & np.uint64(PLACES - 1)]
    found = np.full(slices.shape[1], PLACES, dtype=np.uint32)
    for i in range(0, len(places), 4096):
        np.minimum(found, slices[places[i : i + 4096]].min(axis=0), out=found)
    return found


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit number for each band, of its coordinates and its place."""
    total = np.arange(BANDS, dtype=np.uint64)
    for column in coordinates.reshape(BANDS, ROWS).T.astype(np.uint64):
        total = _mixed(total ^ column) + np.uint64(0x9E3779B97F4A7C15)
    return total


def signatures(df: DataFrame, size: int, id_col: str, text: str) -> DataFrame:
    """(doc, n, digest, bands): set size, 128-bit digest of the whole set, band keys."""
    workers_import(df.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys = [], [], []
            for value in batch.column(1):
                own = shingles(value.as_py(), size)
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest() if len(own) else None)
                keys.append(band_keys(signature(own)).astype(np.int64) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc", "n", "digest", "bands"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, "doc long, n long, digest string, bands array<long>")


def shingle_sets(df: DataFrame, size: int, id_col: str, text: str) -> DataFrame:
    """(node, own): the hashed set of each text, as a sorted array; equal rows count once."""
    workers_import(df.sparkSession)

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t.as_py(), size).astype(np.int64) for t in texts], pa.list_(pa.int64()))

    rows = df.select(F.col(id_col).cast("long").alias("node"), of(F.col(text)).alias("own"))
    return rows.groupBy("node", F.xxhash64("own").alias("same")).agg(F.first("own").alias("own")).drop("same")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in edges (a, b): root is the smallest node reachable.

    Each round gives every node the smallest root among its own and its neighbours', and then that
    root's root, so that distances shrink quickly; it ends when no root changes.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root"))
    labels = written(labels, "labels")
    while True:
        far = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(far, labels.node == far.a, "left").select("node", "root", F.least("root", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("root").alias("top"))
        found = written(lower.join(up, "low", "left").select("node", "root", F.least("low", "top").alias("new")), "labels")
        labels = found.select("node", F.col("new").alias("root"))
        if found.filter("new < root").isEmpty():
            return labels


def _hub_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each bucket's smallest node with its other nodes, as far as sizes allow a link.

    The smallest node is the same in most bands of a group, so a group of any size gives about one pair
    for each member.
    """
    hubs = members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"))
    pairs = members.join(hubs, "key").filter(F.col("node") > F.col("hub.node"))
    fits = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent
    return pairs.filter(fits).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()


def _linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the threshold; a hub's pairs are dealt into parts."""
    second = pairs.join(sets.select(F.col("node").alias("b"), F.col("own").alias("other")), "b")
    first = sets.select(F.col("node").alias("a"), "own")
    both = skew_join(second, first, ["a"], spread_by=["b"], measure=pairs, policy=SkewPolicy(rows=HUB_PAIRS))
    common = F.size(F.array_intersect("own", "other"))
    union = F.size("own") + F.size("other") - common
    return both.filter(common * 100 >= union * percent).select("a", "b").distinct()


def common_counts(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of the first sets with each of the second, exactly.

    Only elements of both lists matter. They number the columns of 0/1 matrices, whose product counts;
    columns are taken some at a time, so memory does not grow with the sets.
    """
    counts = np.zeros((len(first), len(second)), dtype=np.int64)
    shared = np.intersect1d(np.concatenate(first), np.concatenate(second))
    cells = [
        (np.repeat(np.arange(len(of)), [len(s) for s in of]), np.searchsorted(shared, flat), flat)
        for of in (first, second)
        for flat in [np.concatenate(of)]
    ]
    kept = []
    for rows, at, flat in cells:
        at[at == len(shared)] = 0
        on = shared[at] == flat if len(shared) else np.zeros(len(flat), dtype=bool)
        kept.append((rows[on], at[on]))
    for low in range(0, len(shared), COLUMNS):
        sides = []
        for (rows, at), of in zip(kept, (first, second)):
            here = (at >= low) & (at < low + COLUMNS)
            side = np.zeros((len(of), min(COLUMNS, len(shared) - low)), dtype=np.float32)
            side[rows[here], at[here] - low] = 1
            sides.append(side)
        counts += (sides[0] @ sides[1].T).astype(np.int64)
    return counts


def _block_links(group: pa.Table, percent: int) -> pa.Table:
    """Links between two parts of a cell (columns a, b, part, node, root, own) that join different roots.

    All pairs are compared; of the links, those that join what earlier ones have not are given.
    """
    part, a, b = (group.column(c).to_numpy() for c in ("part", "a", "b"))
    node, root = group.column("node").to_pylist(), group.column("root").to_pylist()
    own = [np.asarray(x, dtype=np.int64) for x in group.column("own").to_numpy(zero_copy_only=False)]
    left = np.flatnonzero(part == a[0])
    right = left if a[0] == b[0] else np.flatnonzero(part == b[0])
    out: list[tuple[int, int]] = []
    if len(left) and len(right) and len(set(root)) > 1:
        sizes = np.array([len(x) for x in own])
        common = common_counts([own[i] for i in left], [own[i] for i in right])
        union = sizes[left][:, None] + sizes[right][None, :] - common
        at = {r: r for r in root}

        def find(r: int) -> int:
            while at[r] != r:
                at[r] = at[at[r]]
                r = at[r]
            return r

        for i, j in zip(*np.nonzero(common * 100 >= union * percent)):
            x, y = left[i], right[j]
            p, q = find(root[x]), find(root[y])
            if p != q:
                at[p] = q
                out.append((min(node[x], node[y]), max(node[x], node[y])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _cells(members: DataFrame, percent: int) -> DataFrame:
    """(cell, node, root, parts): the cells in which links between different roots may lie.

    Sizes of linked sets differ by a factor of 100 / percent at most. Size classes grow by just that factor,
    so linked nodes are of one class or of neighbouring ones: cell c of a bucket holds its nodes of classes
    c and c - 1. A cell without a node of its own class, or with one root only, has nothing to find. Cells
    with the same nodes, as neighbouring bands often make, are one.
    """
    # Rounded up by a little: no two sizes at the very bound may fall two classes apart.
    step = math.log(100 / percent) * (1 + 1e-9)
    of_size = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")
    placed = members.withColumn("class", of_size).withColumn("of", F.explode(F.array(F.col("class"), F.col("class") + 1)))
    placed = placed.select(F.xxhash64("key", "of").alias("cell"), "node", "n", "root", (F.col("class") == F.col("of")).alias("own"))
    mixed = F.xxhash64("node", F.lit("cell"))
    cells = placed.groupBy("cell").agg(
        F.count("*").alias("rows"),
        F.sum("n").alias("shingles"),
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        F.bool_or("own").alias("owned"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.sum(mixed.cast("decimal(20,0)")).alias("s"),
    )
    cells = cells.filter((F.col("low") < F.col("high")) & F.col("owned")).groupBy("rows", "shingles", "x", "s").agg(F.min("cell").alias("cell"))
    parts = F.greatest(F.ceil(F.col("rows") / CHUNK), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    return placed.join(cells.select("cell", parts.alias("parts")), "cell").select("cell", "node", "root", "parts")


def _links_across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different roots among all pairs that share a bucket. members: (key, node, n, root).

    A cell's nodes are dealt into parts, and each two parts, and each part with itself, are a block for one
    task. A block's pairs stay inside its task, and only links come out.
    """
    cells = _cells(members, percent)
    part = F.pmod(F.xxhash64("node", "cell"), F.col("parts").cast("long")).cast("int")
    dealt = cells.withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = dealt.select("cell", F.least("part", "with").alias("a"), F.greatest("part", "with").alias("b"), "part", "node", "root")
    rows = written(blocks, "blocks").join(sets, "node")
    return rows.groupBy("cell", "a", "b").applyInArrow(lambda group: _block_links(group, percent), "a long, b long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", *, size: int = 5, percent: int = 80
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of df; component_id is the smallest id reachable.

    Linked are sets with 100 * intersection >= percent * union.
    """
    signed = written(signatures(df, size, id_col, text), "signatures")
    nodes = written(
        signed.filter("digest is not null and doc is not null")
        .groupBy("digest")
        .agg(F.min("doc").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        "nodes",
    )
    banded = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").select("key")
    members = written(banded.join(shared, "key"), "members")
    candidates = written(members.select("node").distinct(), "candidates")
    texts = df.select(F.col(id_col).cast("long").alias("node"), F.col(text).alias("text"))
    few = candidates.count() <= BROADCAST_ROWS
    texts = texts.join(F.broadcast(candidates) if few else candidates, "node", "left_semi")
    sets = written(shingle_sets(texts, size, "node", "text"), "sets")
    links = written(_linked_pairs(written(_hub_pairs(members, percent), "pairs"), sets, percent), "links")
    roots = written(components(links), "roots")
    rooted = members.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    more = written(_links_across(rooted, sets, percent), "links")
    if not more.isEmpty():
        roots = components(links.union(more))
    found = nodes.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    known = signed.join(found, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc")).otherwise(F.col("root"))
    return known.select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc") == component, component.isNull()).alias("kept"),
    )
