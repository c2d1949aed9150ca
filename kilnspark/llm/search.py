"""Exact top-k inner products by ball-tree branch and bound.

Candidates lie in cells around pivots (centres of a bounded sample; they only decide what lies together), cells in shards of bounded size.
Each shard builds its ball tree once and stores it with its centre and radius. Queries lie in blocks of bounded size. A
node's bound for a query is <q, centre> + |q| radius. Shards are bounded first, by blocks of shards; in a first wave each query
searches the shard of the highest bound in each of these blocks, and its k-th score so far goes with it into the second wave, to those
shards alone whose bound reaches it. Inside a tree, nodes below that score are not opened, and leaves are read in the order of
their bounds while the k-th score rises.

Of rows with equal vectors only the k + 1 least ids can be among anyone's best; the others are left out before the search, so that a
vector that very many rows share costs no more than others.

Arithmetic is exact: integers held in floating point where all sums stay below 2**53 (components up to NARROW), else Python
integers; bounds are widened by more than the rounding error.

Defined cases: vectors that are null or hold a null or non-finite component take no part; vectors of different lengths do not
meet; null ids take no part; equal scores go to the smaller id; an inner product beyond a long counts as the nearest long; rows that
repeat an id are candidates each (a query never meets rows of its own id), and rows that repeat a query's id are queries each;
fewer than k candidates give fewer rows; an empty table gives an empty result."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.llm.common import Scratch

SHARD_ROWS = 8192
BLOCK_ROWS = 2048
#: Shards whose bounds are looked at together.
SHARD_BLOCK = 1024
LEAF = 128
SAMPLE_ROWS = 4096
PIVOTS = 512
#: Largest component, and largest dimension, of the vectors whose inner products floating point holds exactly.
NARROW, NARROW_DIM = 1 << 20, 4096
LONG = (1 << 63) - 1

SHARD, BLOCK = ["dim", "cell", "salt"], ["dim", "q_cell", "q_salt"]


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, dim, wide, v): floor(256 x) of each component, as 32-bit integers, or in decimal text where that is too narrow (wide)."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    good = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(~bad)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v, wide = [], []
            for x in batch["x"]:
                x = np.asarray(x, np.float64)
                wide.append(bool(np.abs(x).max() > NARROW // 256 or len(x) > NARROW_DIM))
                # 256 x is exact unless it overflows; whole numbers of that size have no fraction to cut
                v.append(b" ".join(str(int(e) * 256 if abs(e) > 2.0**60 else int(np.floor(256 * e))).encode() for e in x) if wide[-1] else np.floor(256 * x).astype("<i4").tobytes())
            yield pd.DataFrame({"id": batch["id"], "dim": batch["x"].map(len).astype(np.int32), "wide": wide, "v": v})

    return good.mapInPandas(run, "id long, dim int, wide boolean, v binary")


def matrix(v: pd.Series, dim: int, wide: bool) -> np.ndarray:
    """float64, or Python integers (object) of wide vectors."""
    if wide:
        out = np.empty((len(v), dim), object)
        for i, b in enumerate(v):
            out[i] = [int(s) for s in b.split(b" ")]
        return out
    return np.frombuffer(b"".join(v), "<i4").reshape(-1, dim).astype(np.float64)


def as_float(points: np.ndarray) -> np.ndarray:
    """Wide integers as the nearest floating-point numbers, infinite beyond their range."""
    if points.dtype != object:
        return points
    near = lambda x: float(x) if abs(x) < 1 << 1000 else (np.inf if x > 0 else -np.inf)
    return np.vectorize(near, otypes=[float])(points) if points.size else points.astype(float)


def upper_bounds(centres: np.ndarray, radii: np.ndarray, asks: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Of nodes (rows) for queries (columns); infinite where floating point can't tell."""
    with np.errstate(invalid="ignore", over="ignore"):
        out = centres @ asks.T + np.outer(radii, norms)
        out += 1e-9 * (np.abs(out) + np.outer(np.linalg.norm(centres, axis=1) + radii + 1, norms)) + 1e-6
    return np.where(np.isnan(out), np.inf, out)


def _alike(*arrays: np.ndarray) -> list[np.ndarray]:
    """All as Python integers if one of them is."""
    if any(a.dtype == object for a in arrays):
        return [a if a.dtype == object else a.astype(np.int64).astype(object) for a in arrays]
    return list(arrays)


class BallTree:
    """Nodes in arrays: rows [start, end) of `order`, centre, radius, children."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.order = np.argsort(ids, kind="stable")
        self.points, self.ids = points, ids
        self.nodes: list[tuple[int, int, int, int]] = []
        centres, radii, near = [], [], as_float(points)

        def build(a: int, b: int) -> int:
            own = near[self.order[a:b]]
            with np.errstate(invalid="ignore", over="ignore"):
                centre = own.mean(axis=0)
                apart = np.linalg.norm(own - centre, axis=1)
            at, radius = len(self.nodes), float(np.nan_to_num(apart.max(), nan=np.inf))
            self.nodes.append((a, b, -1, -1))
            centres.append(centre)
            radii.append(radius)
            if b - a > LEAF and 0 < radius < np.inf:
                far = own[apart.argmax()]
                other = own[np.linalg.norm(own - far, axis=1).argmax()]
                self.order[a:b] = self.order[a:b][np.argsort(own @ (other - far), kind="stable")]
                mid = (a + b) // 2
                self.nodes[at] = (a, b, build(a, mid), build(mid, b))
            return at

        if len(points):
            build(0, len(points))
        self.centres, self.radii = np.array(centres), np.array(radii)

    def stored(self) -> bytes:
        return pickle.dumps((self.order, self.points, self.ids, self.nodes, self.centres, self.radii))

    @classmethod
    def read(cls, raw: bytes) -> BallTree:
        tree = cls.__new__(cls)
        tree.order, tree.points, tree.ids, tree.nodes, tree.centres, tree.radii = pickle.loads(raw)
        return tree

    def search(self, asks: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of each query's k best with score >= floor, without rows of the query's own id; scores of -inf fill up."""
        near = as_float(asks)
        with np.errstate(over="ignore"):
            norms = np.linalg.norm(near, axis=1)
        leaves, told, open_ = [], [], [(0, np.arange(len(asks)))] if self.nodes else []
        while open_:
            node, who = open_.pop()
            bound = upper_bounds(self.centres[node : node + 1], self.radii[node : node + 1], near[who], norms[who])[0]
            who, bound = who[bound >= floor[who]], bound[bound >= floor[who]]
            _, _, left, right = self.nodes[node]
            if len(who) and left >= 0:
                open_ += [(left, who), (right, who)]
            elif len(who):
                leaves.append(node)
                told.append(np.full(len(asks), -np.inf))
                told[-1][who] = bound
        points, asks = _alike(self.points, asks)
        scores, ids = np.full((k, len(asks)), -np.inf, asks.dtype), np.full((k, len(asks)), LONG, np.int64)
        bounds = np.array(told).reshape(len(leaves), len(asks))
        turn = np.argsort(-bounds, axis=0, kind="stable")
        active = np.arange(len(asks))
        for place in range(len(leaves)):
            leaf = turn[place, active]
            bound = bounds[leaf, active]
            least = np.maximum(floor[active], scores[-1, active].astype(float))
            go = (bound > -np.inf) & (bound >= least - np.abs(least) * 1e-12)
            active, leaf = active[go], leaf[go]
            for one in np.unique(leaf):
                self._read(points, self.nodes[leaves[one]], active[leaf == one], asks, own, scores, ids)
        return scores, ids

    def _read(self, points: np.ndarray, node: tuple, who: np.ndarray, asks: np.ndarray, own: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Joins the rows of a leaf into the best of the queries `who`."""
        rows = self.order[node[0] : node[1]]
        got = points[rows] @ asks[who].T
        if got.dtype == object:
            got = np.clip(got, -LONG - 1, LONG)
        got = np.where(self.ids[rows][:, None] == own[who], -np.inf, got)
        all_scores = np.vstack([scores[:, who], got])
        all_ids = np.vstack([ids[:, who], np.repeat(self.ids[rows][:, None], len(who), axis=1)])
        first = np.lexsort((all_ids, -all_scores), axis=0)[: len(scores)] if got.dtype != object else np.array([sorted(range(len(all_ids)), key=lambda i: (-all_scores[i, j], all_ids[i, j]))[: len(scores)] for j in range(len(who))]).T
        scores[:, who], ids[:, who] = np.take_along_axis(all_scores, first, 0), np.take_along_axis(all_ids, first, 0)


def _pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension in a sample of SAMPLE_ROWS rows, at most PIVOTS centres of it, one for SHARD_ROWS rows."""
    n = rows.count()
    sample = rows.where("not wide").orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE_ROWS).toPandas()
    out, random = {}, np.random.default_rng(4)
    for dim, g in sample.groupby("dim"):
        points = matrix(g["v"], dim, False)
        count = int(min(PIVOTS, max(1, len(points) // 4), n * len(points) / len(sample) // SHARD_ROWS + 1))
        centres = points[random.permutation(len(points))[:count]]
        for _ in range(8):
            nearest = _nearest(points, centres)
            held = np.bincount(nearest, minlength=count)
            centres = np.array([points[nearest == c].mean(axis=0) if held[c] else centres[c] for c in range(count)])
        out[int(dim)] = centres
    return out


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def in_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """`rows` (id, dim, wide, v) with cell: the nearest pivot; -1 of dimensions without pivots, -2 of wide vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = np.where(batch["wide"], -2, -1)
            for dim, centres in pivots.items():
                own = np.flatnonzero(((batch["dim"] == dim) & ~batch["wide"]).to_numpy())
                if len(own):
                    cell[own] = _nearest(matrix(batch["v"].iloc[own], dim, False), centres)
            yield batch.assign(cell=cell)

    return rows.mapInPandas(run, "id long, dim int, wide boolean, v binary, cell int")


def _salted(rows: DataFrame, most: int) -> DataFrame:
    """`rows` with salt, so that (dim, cell, salt) holds about `most` rows at most."""
    parts = rows.groupBy("dim", "cell").agg(F.expr(f"count(*) div {most} + 1").alias("parts"))
    salted = rows.join(parts, ["dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id", "v"), "parts").cast("int")).drop("parts")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return salted.repartition(n, "dim", "cell", "salt")  # by all three: a grouping would be content with the join's dealing by (dim, cell)


def distinct_enough(rows: DataFrame, k: int) -> DataFrame:
    """Of the rows of one vector, those of the k + 1 least ids, each at most k times."""
    each = rows.groupBy("dim", "wide", "v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    order = Window.partitionBy("dim", "wide", "v").orderBy("id")
    few = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    return few.select("id", "dim", "wide", "v", F.explode(F.sequence(F.lit(1), "n")).alias("copy")).drop("copy")


def shard_trees(candidates: DataFrame) -> DataFrame:
    """(dim, cell, salt, centre, radius, tree) of the candidates' shards."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        dim, wide = int(rows["dim"].iloc[0]), bool(rows["wide"].iloc[0])
        tree = BallTree(matrix(rows["v"], dim, wide), rows["id"].to_numpy())
        radius = np.inf if wide else tree.radii[0]
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in SHARD}, "centre": [tree.centres[0].tobytes()], "radius": [radius], "tree": [tree.stored()]})

    return _salted(candidates, SHARD_ROWS).groupBy(*SHARD).applyInPandas(build, "dim int, cell int, salt int, centre binary, radius double, tree binary")


def query_blocks(queries: DataFrame) -> DataFrame:
    """(dim, q_cell, q_salt, asks) of the queries' blocks; asks: their ids and vectors."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "v"])
        asks = rows["id"].to_numpy(), matrix(rows["v"], int(rows["dim"].iloc[0]), bool(rows["wide"].iloc[0]))
        return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "q_cell": [rows["cell"].iloc[0]], "q_salt": [rows["salt"].iloc[0]], "asks": [pickle.dumps(asks)]})

    return _salted(queries, BLOCK_ROWS).groupBy("dim", "cell", "salt").applyInPandas(build, "dim int, q_cell int, q_salt int, asks binary")


def _tiles(blocks: DataFrame, shards: DataFrame, first: bool) -> DataFrame:
    """(block, shard, who): which queries of a block a shard has to be searched for. In the first wave each query goes to the best
    shard of each block of shards; in the second to the others whose bound reaches its k-th score (blocks have a column `floors` then)."""
    parts = shards.groupBy("dim").agg(F.expr(f"count(*) div {SHARD_BLOCK} + 1").alias("parts"))
    dealt = shards.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("cell", "salt"), "parts"))
    inside = F.array_sort(F.collect_list(F.struct("cell", "salt", "centre", "radius")))
    # a block of queries goes to each block of at most about SHARD_BLOCK shards, by number, so that the tiles spread; one row for each vector length is broadcast
    spread = blocks.join(F.broadcast(parts), "dim").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    met = spread.join(dealt.groupBy("dim", "part").agg(inside.alias("shards")), ["dim", "part"])

    def run(row: pd.DataFrame) -> pd.DataFrame:
        row = row.iloc[0]
        near = as_float(pickle.loads(row["asks"])[1])
        centres = np.array([np.frombuffer(s["centre"]) for s in row["shards"]])
        with np.errstate(over="ignore"):
            bounds = upper_bounds(centres, np.array([s["radius"] for s in row["shards"]]), near, np.linalg.norm(near, axis=1))
        best = np.arange(len(bounds))[:, None] == bounds.argmax(axis=0)
        go = best if first else (bounds >= pickle.loads(row["floors"])) & ~best
        rows = [(row["dim"], row["q_cell"], row["q_salt"], s["cell"], s["salt"], np.flatnonzero(g).astype(np.int32).tobytes()) for s, g in zip(row["shards"], go, strict=True) if g.any()]
        return pd.DataFrame(rows, columns=[*BLOCK, "cell", "salt", "who"])

    # a group is one row: what a task holds at a time is one block of queries and one of shards
    return met.groupBy(*BLOCK, "part").applyInPandas(run, "dim int, q_cell int, q_salt int, cell int, salt int, who binary")


def _searched(tiles: DataFrame, blocks: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """(block, at, query_id, vec_id, score): the k best that each query of a tile finds in its shard."""
    met = tiles.join(blocks, BLOCK).join(trees.select(*SHARD, "tree"), SHARD)

    def run(row: pd.DataFrame) -> pd.DataFrame:
        row = row.iloc[0]
        (ids, asks), tree = pickle.loads(row["asks"]), BallTree.read(row["tree"])
        who = np.frombuffer(row["who"], np.int32)
        floor = pickle.loads(row["floors"])[who] if "floors" in row else np.full(len(who), -np.inf)
        scores, found = tree.search(asks[who], ids[who], k, floor)
        place, one = np.nonzero(scores.astype(float) > -np.inf)
        out = pd.DataFrame({"at": who[one], "query_id": ids[who][one], "vec_id": found[place, one], "score": [int(s) for s in scores[place, one]]})
        return out.assign(dim=row["dim"], q_cell=row["q_cell"], q_salt=row["q_salt"])[[*BLOCK, "at", "query_id", "vec_id", "score"]].astype({"score": "int64"})

    return met.groupBy(*BLOCK, "cell", "salt").applyInPandas(run, "dim int, q_cell int, q_salt int, at int, query_id long, vec_id long, score long")


def _place(k: int) -> Column:
    return F.row_number().over(Window.partitionBy(*BLOCK, "at").orderBy(F.desc("score"), "vec_id"))


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates; both frames as `usable` gives them."""
    scratch, kept = Scratch(candidates.sparkSession), Scratch(candidates.sparkSession)
    pivots = _pivots(candidates)
    trees = scratch.table(shard_trees(in_cells(distinct_enough(candidates, k), pivots)), "trees")
    blocks = scratch.table(query_blocks(in_cells(queries, pivots)), "query-blocks")
    shards = trees.drop("tree")
    first = scratch.table(_searched(_tiles(blocks, shards, True), blocks, trees, k), "first-wave")
    kth = first.withColumn("rank", _place(k)).where(F.col("rank") == k).groupBy(*BLOCK).agg(F.collect_list(F.struct("at", "score")).alias("known"))  # at most a block's queries

    def floors(row: pd.DataFrame) -> pd.DataFrame:
        known = row.pop("known").iloc[0]
        floor = np.full(len(pickle.loads(row["asks"].iloc[0])[0]), -np.inf)
        for r in () if known is None else known:
            floor[r["at"]] = r["score"] - abs(r["score"]) * 1e-12
        return row.assign(floors=[pickle.dumps(floor)])

    raised = scratch.table(blocks.join(kth, BLOCK, "left").groupBy(*BLOCK).applyInPandas(floors, "dim int, q_cell int, q_salt int, asks binary, floors binary"), "raised")
    second = _searched(_tiles(raised, shards, False), raised, trees, k)
    found = kept.table(first.unionByName(second).withColumn("rank", _place(k)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")
    scratch.drop()
    return found


def search_report(embeddings: DataFrame, k: int = 5) -> DataFrame:
    """op7: the five best of all other vectors for each vector whose id is divisible by 50."""
    scratch = Scratch(embeddings.sparkSession)
    rows = scratch.table(usable(embeddings, "vec_id", "embedding"), "vectors")
    found = top_k(rows, rows.where("id % 50 = 0"), k)
    scratch.drop()
    return found
