"""Centroid clustering in whole numbers: each round's centroids go to the tasks as a vantage-point tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import batch_of
from sparkwarden.session import cut_lineage

#: Components are below this in size, so that a squared distance over 128 dimensions fits 64 bits.
LARGEST = 1 << 27
#: Square roots are rounded; bounds give way by this part, so rounding never prunes a nearest centroid.
SLACK = 1e-12
BLOCK = 2048
FAR = np.iinfo(np.int64).max

SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


@dataclass(frozen=True)
class Settings:
    """``leaf``: most centroids in a leaf of the tree; the centroids of a round, and so the tree, are held by every task."""

    clusters: int = 40
    dims: int = 64
    rounds: int = 5
    scale: int = 256
    seed: int = 2
    leaf: int = 4


# ---- the tree -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays. An inner node holds one centroid, the vantage point, and two children: the nearer and the
    farther half of the others, with the least and the largest distance in each. A leaf holds up to ``leaf`` centroids."""

    members: np.ndarray
    children: np.ndarray
    low: np.ndarray
    high: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


def build(centres: np.ndarray, leaf: int) -> Tree:
    """The tree over all centroids; a vantage point is the one, of 16 tried, whose distances spread most."""
    members, children, low, high = [], [], [], []
    waiting = [(np.arange(len(centres)), None)]
    while waiting:
        inside, parent = waiting.pop()
        node = len(members)
        if parent is not None:
            children[parent[0]][parent[1]] = node
        children.append([-1, -1])
        low.append([0.0, 0.0])
        high.append([0.0, 0.0])
        if len(inside) <= leaf:
            members.append(np.resize(inside, leaf))
            continue
        tried = inside[np.linspace(0, len(inside) - 1, 16).astype(int)]
        vantage = max(tried.tolist(), key=lambda c: float(np.sqrt(squared(centres[inside], centres[c])).std()))
        members.append(np.resize([vantage], leaf))
        others = inside[inside != vantage]
        distances = np.sqrt(squared(centres[others], centres[vantage]))
        order = np.argsort(distances, kind="stable")
        for side, part in enumerate(np.array_split(order, 2)):
            if not len(part):
                continue
            low[node][side], high[node][side] = float(distances[part[0]]), float(distances[part[-1]])
            waiting.append((others[part], (node, side)))
    return Tree(np.array(members), np.array(children), np.array(low), np.array(high))


def search(vectors: np.ndarray, centres: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, of equally near ones the smallest number, and the squared distance.

    Every vector walks the tree best first and on its own: it holds the lower bounds of the nodes it may still
    enter, takes the least one, measures that node's centroids in whole numbers and bounds its children by the
    triangle inequality. It stops once the least bound is beyond the distance found; a bound equal to it is
    entered, since a centroid as near with a smaller number may be there. The vectors of a block step together.
    """
    count = len(vectors)
    bounds = np.full((count, len(tree.members)), np.inf)
    bounds[:, 0] = 0.0
    best, number = np.full(count, FAR), np.full(count, len(centres))
    going = np.arange(count)
    while len(going):
        node = bounds[going].argmin(1)
        low = bounds[going, node]
        on = low <= np.sqrt(best[going].astype(float)) * (1 + SLACK)
        going, node, low = going[on], node[on], low[on]
        bounds[going, node] = np.inf
        inner = tree.children[node, 0] >= 0
        for some, width in ((inner, 1), (~inner, tree.members.shape[1])):
            rows, own = going[some], tree.members[node[some], :width]
            distances = squared(vectors[rows][:, None, :], centres[own])
            for k in range(width):
                better = (distances[:, k] < best[rows]) | ((distances[:, k] == best[rows]) & (own[:, k] < number[rows]))
                best[rows[better]], number[rows[better]] = distances[better, k], own[better, k]
            if some is inner:
                _enter(bounds, rows, node[some], low[some], np.sqrt(distances[:, 0].astype(float)), tree)
    return number, best


def _enter(bounds, rows, node, low, away, tree: Tree) -> None:
    """Lower bounds of the children: how far the distance to the vantage point lies outside of the child's range."""
    for side in (0, 1):
        child, near, far = tree.children[node, side], tree.low[node, side], tree.high[node, side]
        outside = np.maximum(away - far, near - away) - SLACK * (away + far)
        there = child >= 0
        bounds[rows[there], child[there]] = np.maximum(low, outside)[there]


# ---- clustering -----------------------------------------------------------------------------------


def whole_vectors(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, v): the vectors that take part, each component as floor(scale * x)."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST / settings.scale)
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .filter((F.size("v") == settings.dims) & ~F.exists("v", bad))
        .select("vec_id", F.transform("v", lambda x: F.floor(x * settings.scale).cast("int")).alias("v"))
    )


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        yield part, part.column(1).flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def first_centres(whole: DataFrame, settings: Settings) -> np.ndarray | None:
    """The vectors whose ids have the smallest hashes, in the order of these; at most ``clusters`` rows are collected."""
    told = F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = whole.orderBy(F.sha2(told, 256), "vec_id", "v").limit(settings.clusters).select("v").collect()
    return np.array([r.v for r in rows], np.int64) if rows else None


def moved(whole: DataFrame, centres: np.ndarray, settings: Settings) -> np.ndarray:
    """The centroids after one round. Each task adds up its vectors by cluster, and Spark these sums."""
    tree, dims = build(centres, settings.leaf), settings.dims

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centres), dims), np.int64), np.zeros(len(centres), np.int64)
        for batch in batches:
            for _, block in _blocks(batch, dims):
                number, _ = search(block, centres, tree)
                counts += np.bincount(number, minlength=len(centres))
                for c in np.unique(number).tolist():
                    sums[c] += block[number == c].sum(0)
        held = np.flatnonzero(counts)
        yield batch_of([("cluster", held, pa.int32()), ("n", counts[held], pa.int64()), ("sums", sums[held].tolist(), pa.list_(pa.int64()))])

    parts = whole.mapInArrow(add_up, "cluster int, n long, sums array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(exact("n").alias("n"), exact("part").alias("total"))
    after = centres.copy()
    # one row for each component of each centroid
    for row in totals.collect():
        after[row.cluster, row.at] = int(row.total) // int(row.n)
    return after


def fit(whole: DataFrame, settings: Settings = Settings()) -> np.ndarray | None:
    """The centroids after all rounds, None without vectors. ``whole`` is read once a round, so store it before."""
    centres = first_centres(whole, settings)
    for _ in range(settings.rounds if centres is not None else 0):
        centres = moved(whole, centres, settings)
    return centres


def assigned(whole: DataFrame, centres: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    tree, dims = build(centres, settings.leaf), settings.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in _blocks(batch, dims):
                number, best = search(block, centres, tree)
                yield batch_of([("vec_id", part.column(0), None), ("cluster", number.astype(np.int32), None), ("distance", best, None)])

    return whole.mapInArrow(run, "vec_id long, cluster int, distance long")


def clusters(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of ``vectors(vec_id, embedding)``.

    k-means in whole numbers: a component x counts as floor(scale * x), nearest is by squared Euclidean distance,
    ties go to the smaller centroid, and a centroid moves to the floor of its vectors' mean. The start are the vectors
    whose ``seed:vec_id`` has the smallest SHA-256; fewer vectors than ``clusters`` give as many clusters.

    Vectors that are null, do not have ``dims`` components or hold null or non-finite ones take no part, nor do those
    with a component of 2**27 / scale or more, whose distances would not fit 64 bits. A null vec_id counts as an
    empty one in the hash and stays null; repeated rows count and come back as often as they are there; of rows of one id
    the smaller vector comes first. An empty table gives an empty result; other columns are not read. Sums that
    do not fit 64 bits are null.
    """
    spark = vectors.sparkSession
    whole = cut_lineage(whole_vectors(vectors, settings))
    centres = fit(whole, settings)
    if centres is None:
        return spark.createDataFrame([], SCHEMA)
    found = cut_lineage(assigned(whole, centres, settings))
    told = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centres.tolist())]
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    whole_sum, by_cluster = sum(int(r.s) for r in sums), {r.cluster: int(r.s) for r in sums}
    fits = lambda x: x if x <= FAR else None
    facts = spark.createDataFrame(
        [(c, fits(by_cluster[c]), fits(whole_sum), digest) for c, digest in told if c in by_cluster],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # one row for each cluster
    return found.join(F.broadcast(facts), "cluster").select(*[part.split()[0] for part in SCHEMA.split(", ")])
