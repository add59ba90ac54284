"""Exact top-k inner-product search with ball trees.

Vectors are dealt by row to shards of about ``SHARD`` rows, and each shard's ball tree is built
once and kept with its rows.  A node's bound is q.c + |q| r.  Nodes below the current kth score
of a query are dropped, level by level, and leaves are visited by falling bound in waves, the
kth score rising after each.

A stated query set meets all rows in blocks: a tile holds a few shards and a few blocks of
queries, so a shard is sent once for a tile's worth of queries.  Inside a tile the kth scores go
on from shard to shard; over tiles, shards are searched in waves, each four times as many as
all before, and after each wave the kth scores over everything seen so far go to the next.

Scores are exact: whole numbers are kept as doubles, multiplied as such where no sum reaches
2**53, as 64-bit integers where none reaches 2**62, and as Python's integers otherwise.  A
result whose score does not fit a long is an error.

Defined cases: rows whose vector is null, or holds a component that is null or not finite, take
no part; shorter vectors are padded with zeros, so an empty one has score 0 with any; rows are
told apart by their place and not by their id, so rows that repeat an id are candidates and
queries of their own, for each other as well; a row of a null id is a candidate, the last of
equal scores; an empty table, or no query, gives an empty result; further columns, whatever
their names, are left out.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARD = 16_384
BLOCK = 2_048
LEAF = 64
#: Shards and blocks of queries in a tile at most (64 and 16 MB at 64 dimensions).
TILE_SHARDS, TILE_BLOCKS = 16, 16
#: How many times the shards before a wave holds.
WAVE = 3
LEAST, MOST = -(2**63), 2**63 - 1


def scaled(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: whole numbers floor(scale * x) as doubles; only rows that take part."""
    # floor gives longs, which end at 2**63; from 2**52 on a double is whole already.
    whole = F.transform(vector_col, lambda x: F.when(F.abs(x.cast("double") * scale) < 2.0**52, F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale))
    good = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vector_col).isNotNull()).where(good).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


class BallTree:
    """Levels of balls over the rows of ``x``; every level halves the balls above it.  ``order``
    lists the rows leaf by leaf; ``edges`` are the ends of the leaves in it."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        parts, self.levels = [np.arange(len(x))], []
        while True:
            centre = np.array([x[p].mean(0) for p in parts])
            radius = np.array([np.sqrt(((x[p] - c) ** 2).sum(1).max()) for p, c in zip(parts, centre, strict=True)])
            self.levels.append((centre, radius))
            if max(map(len, parts)) <= leaf:
                break
            parts = [half for p in parts for half in self._halves(x, p)]
        self.order = np.concatenate(parts)
        self.edges = np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    @staticmethod
    def _halves(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = x[p]
        a = own[((own - own[0]) ** 2).sum(1).argmax()]
        b = own[((own - a) ** 2).sum(1).argmax()]
        order = np.argsort(own @ (b - a), kind="stable")
        return p[order[: len(p) // 2]], p[order[len(p) // 2 :]]


class Shard:
    """Rows in the order of their tree's leaves."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, unknown: np.ndarray, rows: np.ndarray):
        with np.errstate(over="ignore", invalid="ignore"):
            tree = BallTree(x)
        self.levels, self.edges = tree.levels, tree.edges
        self.x, self.ids, self.unknown, self.rows = (a[tree.order] for a in (x, ids, unknown, rows))
        self.most = np.abs(x).max(initial=0.0)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as longs; LEAST or MOST where one does not fit."""
    reach = float(np.abs(q).max(initial=0.0)) * float(np.abs(x).max(initial=0.0)) * max(1, x.shape[1])
    if reach < 2**53:
        return (q @ x.T).astype(np.int64)
    if reach < 2**62 and max(np.abs(q).max(), np.abs(x).max()) < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    a, b = ([[int(v) for v in row] for row in m.tolist()] for m in (q, x))
    return np.array([[min(max(sum(map(int.__mul__, r, c)), LEAST), MOST) for c in b] for r in a], np.int64)


class Best:
    """The k best candidates so far of each query of a block, and their kth scores."""

    def __init__(self, q: np.ndarray, rows: np.ndarray, floor: np.ndarray, k: int):
        self.q, self.rows, self.k, self.kth = q, rows, k, floor.copy()
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((q**2).sum(1))
        self.who, self.score, self.id, self.unknown = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def reach(self) -> np.ndarray:
        """kth scores as doubles, rounded down."""
        f = self.kth.astype(np.float64)
        return np.where(self.kth == LEAST, -np.inf, np.where(np.abs(f) < 2**53, f, np.nextafter(f, -np.inf)))

    def add(self, new: list[tuple[np.ndarray, ...]]) -> None:
        who, score, ids, unknown = (np.concatenate(z) for z in zip((self.who, self.score, self.id, self.unknown), *new, strict=True))
        # The longs' order is turned by their complement, as the least has no negative.
        by = np.lexsort((ids, unknown, ~score, who))
        who, score, ids, unknown = who[by], score[by], ids[by], unknown[by]
        begins = np.nonzero(np.concatenate(([True], who[1:] != who[:-1])))[0] if len(who) else np.zeros(0, int)
        place = np.arange(len(who)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(who)]))))
        kept = place < self.k
        self.who, self.score, self.id, self.unknown = who[kept], score[kept], ids[kept], unknown[kept]
        full = place[kept] == self.k - 1
        self.kth[self.who[full]] = np.maximum(self.kth[self.who[full]], self.score[full])

    def search(self, shard: Shard) -> None:
        if not len(shard.x) or not len(self.q):
            return
        alive, reach = np.ones((len(self.q), 1), bool), self.reach()
        for depth, (centre, radius) in enumerate(shard.levels):
            if depth:
                alive = np.repeat(alive, 2, axis=1)
            with np.errstate(over="ignore", invalid="ignore"):
                # Rounding is far below a part in 10**9 of what the sums are made of.
                far = self.norm[:, None] * (np.sqrt((centre**2).sum(1)) + radius)
                bound = self.q @ centre.T + self.norm[:, None] * radius + 1e-9 * far
            bound[np.isnan(bound)] = np.inf
            alive &= bound >= reach[:, None]
        bound[~alive] = -np.inf
        order = np.argsort(-bound, axis=1, kind="stable")
        alive, bound = np.take_along_axis(alive, order, 1), np.take_along_axis(bound, order, 1)
        start, width = 0, 1
        while start < order.shape[1]:
            who, nth = np.nonzero(alive[:, start : start + width] & (bound[:, start : start + width] >= self.reach()[:, None]))
            if not len(who):
                break
            leaf = order[who, start + nth]
            by = np.argsort(leaf, kind="stable")
            who, leaf = who[by], leaf[by]
            edges = np.nonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))[0]
            new = []
            for a, b in zip(edges, [*edges[1:], len(leaf)], strict=True):
                members, asked = slice(shard.edges[leaf[a]], shard.edges[leaf[a] + 1]), who[a:b]
                s = products(self.q[asked], shard.x[members])
                i, j = np.nonzero((s >= self.kth[asked][:, None]) & (shard.rows[members][None, :] != self.rows[asked][:, None]))
                j += members.start
                new.append((asked[i], s[i, j - members.start], shard.ids[j], shard.unknown[j]))
            self.add(new)
            start, width = start + width, width * 2


def _pack(*parts) -> bytes:
    import zstandard as z

    return z.ZstdCompressor(level=1).compress(pickle.dumps(parts, protocol=5))


def _unpack(data: pa.Scalar):
    import zstandard as z

    return pickle.loads(z.ZstdDecompressor().decompress(data.as_buffer()))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for null), and whether they are null."""
    return column.fill_null(0).to_numpy(), column.is_null().to_numpy()


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row that ``is_query`` holds
    for; fewer where there are fewer.  ``vectors`` as ``scaled`` gives them."""
    spark = vectors.sparkSession
    vectors = cut(vectors.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")))
    n, dims, asked = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count_if("asks")).first()
    dims, shards, blocks = max(1, dims or 1), max(1, -(-n // shard)), max(1, -(-asked // block))
    padded = F.concat("v", F.array_repeat(F.lit(0.0), dims - F.size("v")))
    rows = vectors.select("row", "vec_id", "asks", padded.alias("v"))

    def build(table: pa.Table) -> pa.Table:
        made = Shard(_matrix(table["v"], dims), *_numbers(table["vec_id"]), table["row"].to_numpy())
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "data": pa.array([_pack(made)], pa.binary())})

    def asking(table: pa.Table) -> pa.Table:
        data = _pack(_matrix(table["v"], dims), table["row"].to_numpy())
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    dealt = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")
    trees = cut(rows.withColumn("shard", dealt[0]).groupBy("shard").applyInArrow(build, "shard int, data binary"))
    queries = cut(rows.where("asks").withColumn("block", dealt[1]).groupBy("block").applyInArrow(asking, "block int, data binary"))

    kinds = pa.schema([("block", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def within(key, left: pa.Table, right: pa.Table) -> pa.Table:
        bests = []
        for data, kth in zip(right["data"], right["kth"].to_pylist(), strict=True):
            q, row = _unpack(data)
            known = dict(kth or ())
            bests.append(Best(q, row, np.array([known.get(r, LEAST) for r in row.tolist()], np.int64), k))
        for data in left["data"]:
            (held,) = _unpack(data)
            for best in bests:
                best.search(held)
        tables = [kinds.empty_table()]
        for number, b in zip(right["block"].to_pylist(), bests, strict=True):
            tables.append(pa.table([pa.array(np.full(len(b.who), number, np.int32)), pa.array(b.rows[b.who]), pa.array(b.id, mask=b.unknown), pa.array(b.score)], schema=kinds))
        return pa.concat_tables(tables)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def wave(first: int, last: int, kth: DataFrame | None) -> DataFrame:
        """Shards from ``first`` up to but not ``last`` against all queries."""
        size = max(1, min(TILE_SHARDS, (last - first) * blocks // tasks))
        deep = max(1, min(TILE_BLOCKS, (last - first) * blocks // (size * tasks)))
        asked = queries.withColumn("kth", F.lit(None).cast("map<long,long>")) if kth is None else queries.join(kth, "block", "left")
        across, down = -(-blocks // deep), -(-(last - first) // size)
        left = trees.where(F.col("shard").between(first, last - 1)).withColumn("s", F.floor((F.col("shard") - first) / size).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
        right = asked.withColumn("b", F.floor(F.col("block") / deep).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
        return left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(within, "block int, row long, vec_id long, score long")

    best = Window.partitionBy("block", "row").orderBy(F.desc("score"), F.col("vec_id").isNull(), "vec_id")

    def cut_to_k(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    found, done = cut(cut_to_k(wave(0, 1, None))), 1
    while done < shards:
        last = min(shards, done * (1 + WAVE))
        kth = found.where(F.col("rank") == k).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("row", "score"))).alias("kth"))
        found, done = cut(cut_to_k(found.drop("rank").unionByName(wave(done, last, kth)))), last
    ids = vectors.where("asks").select("row", F.col("vec_id").alias("query_id"))
    fits = F.when(F.col("score").isin(LEAST, MOST), F.raise_error(F.lit("a score does not fit a long"))).otherwise(F.col("score"))
    return found.join(ids, "row").select("query_id", "rank", "vec_id", fits.cast("long").alias("score"))
