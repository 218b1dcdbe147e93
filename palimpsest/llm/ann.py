"""Nearest neighbours by inner product with cross-polytope hashing.

A table turns unit vectors by pseudo-rotations (three rounds of random signs and a fast Hadamard
transform); a vector's cell is the signed axis that it is nearest to, after each of several rotations:
so many that a cell holds a few vectors. The last rotation counts with part of its axes alone, so the
number of cells follows the number of vectors. A query looks into the cells it is nearest to in every
table, nearest first, and what it finds is ranked again by the exact products of the original vectors.

How many cells a query looks into is not guessed: a bounded sample of the queries is compared with all
vectors, and each table is asked in how many cells their true neighbours would have been found. Where
neighbours are close that is a handful of cells, where there is no structure it is many.

The vectors are dealt into shards. A task sorts a shard's cells, table by table, and writes them with
the vectors to the shared folder, once; tasks that search map these files. So no vector is copied for a
table or a cell: only the queries travel, to each shard once, and the best that they found there.

Inner products become angles within bands of similar norm: a vector is scaled by its band's largest
norm and, unless the band's norms are equal, given one more component that makes it a unit vector. Equal
vectors are indexed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import delete_at_exit, drop_written, fresh_path, quoted, read_array, release_memory, write_array, written

#: Bytes of vectors of a shard.
SHARD_BYTES = 64 << 20
#: Queries that are compared with all vectors to learn how many cells must be looked into.
SAMPLE_QUERIES = 128
#: Tables, and the share of the true neighbours that the cells looked into are to hold.
TABLES, RECALL = 32, 0.93
#: Vectors wanted in a cell; cells beyond which a query looks into all of them; queries searched at once, and in one task.
CELL_VECTORS, MOST_PROBES, QUERIES, ASKED = 2, 4096, 64, 256
#: Products in memory at once.
BLOCK = 1 << 15
#: Norms within this share of each other count as equal.
ALIKE = 1e-5
#: Stands for all cells.
ALL = -1


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Hadamard transform of each row; the width is a power of two."""
    n, width, step = len(x), x.shape[1], 1
    while step < width:
        x = x.reshape(n, -1, 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    rnd = np.random.default_rng([seed, table, x.shape[1]])
    for _ in range(3):
        x = hadamard(x * rnd.choice([-1.0, 1.0], x.shape[1]))
    return x


@lru_cache(maxsize=256)
def _matrix_of(width: int, table: int, seed: int) -> np.ndarray:
    return rotated(np.eye(width), table, seed)


def turned(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """The same as rotated(); narrow rows are multiplied by the rotation's matrix, which is quicker than the transform's steps."""
    return x @ _matrix_of(x.shape[1], table, seed) if x.shape[1] <= 256 else rotated(x, table, seed)


def padded(x: np.ndarray, extra: np.ndarray | None) -> np.ndarray:
    """Rows with the extra component, if any, filled up by zeros to a power of two."""
    if extra is not None:
        x = np.concatenate((x, extra[:, None]), axis=1)
    return np.pad(x, ((0, 0), (0, (1 << max(1, (x.shape[1] - 1).bit_length())) - x.shape[1])))


def axes_for(n: int, width: int) -> list[int]:
    """How many signed axes each rotation of a table counts with, so that `n` vectors of a padded width come to CELL_VECTORS a cell."""
    out, left = [], max(1.0, n / CELL_VECTORS)
    while left >= 2 * width:
        out.append(2 * width)
        left /= 2 * width
    if left >= 4 or not out:
        out.append(min(2 * width, max(4, 1 << int(np.log2(max(1.0, left))))))
    return out


def nearness(x: np.ndarray, table: int, axes: list[int], seed: int) -> list[np.ndarray]:
    """How near each row is to the signed axes of each of a table's rotations: the components and their negatives."""
    out = []
    for k, n in enumerate(axes):
        y = turned(x, table * 16 + k, seed)[:, : n // 2]
        out.append(np.concatenate((y, -y), axis=1))
    return out


def cells_of(near: list[np.ndarray]) -> np.ndarray:
    """Each row's cell: its nearest axes as one number."""
    cell = np.zeros(len(near[0]), np.int64)
    for y in near:
        cell = cell * y.shape[1] + y.argmax(axis=1)
    return cell


def rank_of(near: list[np.ndarray], cell: np.ndarray) -> np.ndarray:
    """Which in each row's order of cells (see probes_of) a given cell is, from 1."""
    total, rest = np.zeros(len(cell)), cell
    for y in reversed(near):
        total += np.take_along_axis(y, (rest % y.shape[1])[:, None], 1)[:, 0]
        rest = rest // y.shape[1]
    rank = np.ones(len(cell), np.int64)
    step = max(1, (1 << 22) // int(np.prod([y.shape[1] for y in near])))
    for lo in range(0, len(cell), step):
        sums = np.zeros((len(cell[lo : lo + step]), 1))
        for y in near:
            sums = (sums[:, :, None] + y[lo : lo + step, None, :]).reshape(len(sums), -1)
        rank[lo : lo + step] += (sums > total[lo : lo + step, None] + 1e-12).sum(axis=1)
    return rank


def probes_of(near: list[np.ndarray], most: int) -> np.ndarray:
    """The `most` cells that each row is nearest to, nearest first, by the sum of its components there. The best prefixes make the best cells."""
    cells, total = np.zeros((len(near[0]), 1), np.int64), np.zeros((len(near[0]), 1))
    for y in near:
        cells = (cells[:, :, None] * y.shape[1] + np.arange(y.shape[1])).reshape(len(y), -1)
        total = (total[:, :, None] + y[:, None, :]).reshape(len(y), -1)
        keep = min(most, total.shape[1])
        if keep < total.shape[1]:
            at = np.argpartition(-total, keep - 1, axis=1)[:, :keep]
            cells, total = np.take_along_axis(cells, at, 1), np.take_along_axis(total, at, 1)
    return np.take_along_axis(cells, np.argsort(-total, axis=1, kind="stable"), 1)


@dataclass(frozen=True)
class Band:
    """Vectors of one width whose norms are within a factor of two: `top` is the largest, over two to the band; n how many there are."""

    band: int
    width: int
    top: float
    even: bool
    n: int

    @property
    def padded_width(self) -> int:
        return 1 << max(1, (self.width + (not self.even) - 1).bit_length())

    def units(self, x: np.ndarray) -> np.ndarray:
        """Vectors of the band as padded unit vectors."""
        scaled = np.ldexp(x, -self.band)
        norm = np.linalg.norm(scaled, axis=1)
        if self.even:
            return padded(scaled / norm[:, None], None)
        return padded(scaled / self.top, np.sqrt(np.maximum(0, 1 - (norm / self.top) ** 2)))

    def asked(self, x: np.ndarray) -> np.ndarray:
        """Queries as they are compared with the band: of norm one, the extra component nought."""
        top = np.abs(x).max(axis=1, keepdims=True)
        x = x / top
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return padded(x, None if self.even else np.zeros(len(x)))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows; what is undefined (infinity less infinity) is less than all."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = (q * x).sum(axis=1)
    return np.where(np.isnan(s), -np.inf, s)


def best_of(query: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best finds of each query: highest score first, then smallest id."""
    order = np.lexsort((found, -score, query))
    query, found, score = query[order], found[order], score[order]
    heads = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(heads, np.diff(np.append(heads, len(query))))
    ok = rank < k
    return query[ok], found[ok], score[ok]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), width)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, vectors in double precision) of a batch."""
    wide = np.asarray(pc.list_value_length(batch.column("v")))
    for d in np.unique(wide):
        rows = np.flatnonzero(wide == d)
        yield int(d), rows, _matrix(batch.column("v").take(pa.array(rows)), int(d)).astype(np.float64)


class Index:
    """Where the shards are and how they are looked into."""

    def __init__(self, folder: str, bands: list[Band], shards: int, tables: int, seed: int) -> None:
        self.folder, self.bands, self.shards, self.tables, self.seed = folder, bands, shards, tables, seed
        self.axes = [axes_for(-(-b.n // shards), b.padded_width) for b in bands]
        self.probes = [ALL] * len(bands)

    def build(self, rows: DataFrame) -> set[tuple[int, int]]:
        """Writes the shards of (rep, v, band, shard); returns which (shard, band number) there are."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            held = pa.Table.from_batches(got).combine_chunks()
            shard = held.column("shard")[0].as_py()
            for k, b in enumerate(self.bands):
                mine = held.filter(pc.and_(pc.equal(held.column("band"), b.band), pc.equal(pc.list_value_length(held.column("v")), b.width)))
                if not len(mine):
                    continue
                mine = mine.sort_by("rep").combine_chunks()
                x = _matrix(mine.column("v").combine_chunks(), b.width)
                write_array(self.folder, f"rep-{shard}-{k}", mine.column("rep").to_numpy())
                write_array(self.folder, f"vector-{shard}-{k}", x)
                for t in range(self.tables):
                    cell = np.concatenate([cells_of(nearness(b.units(x[lo : lo + BLOCK].astype(np.float64)), t, self.axes[k], self.seed)) for lo in range(0, len(x), BLOCK)])
                    order = np.argsort(cell, kind="stable")
                    write_array(self.folder, f"cell-{shard}-{k}-{t}", cell[order].astype(np.uint32 if np.prod(self.axes[k]) < 2**32 else np.int64))
                    write_array(self.folder, f"order-{shard}-{k}-{t}", order.astype(np.uint32 if len(order) < 2**32 else np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([k])], ["shard", "band"])
            release_memory()

        made = rows.repartitionById(self.shards, F.col("shard").cast("int")).mapInArrow(run, "shard long, band long").collect()
        return {(r.shard, r.band) for r in made}

    def _found(self, shard: int, k: int, q: np.ndarray) -> Iterator[np.ndarray]:
        """For each query the places in the shard's band that its cells hold."""
        unit, near = self.bands[k].asked(q), [[] for _ in q]
        for t in range(self.tables):
            cells, order = read_array(self.folder, f"cell-{shard}-{k}-{t}"), read_array(self.folder, f"order-{shard}-{k}-{t}")
            asked = probes_of(nearness(unit, t, self.axes[k], self.seed), self.probes[k]).astype(cells.dtype)
            lo, hi = (np.searchsorted(cells, asked.ravel(), side).reshape(asked.shape) for side in ("left", "right"))
            for places, first, after in zip(near, lo, hi, strict=True):
                some = first < after
                start, size = first[some], (after - first)[some]
                ends = np.cumsum(size)
                places.append(order[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)])
        seen = np.zeros(len(read_array(self.folder, f"rep-{shard}-{k}")), bool)
        for lists in near:
            seen[:] = False
            for places in lists:
                seen[places] = True
            yield np.flatnonzero(seen)

    def _blocks(self, shard: int, k: int, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of queries, places, vectors) to compare, at most BLOCK vectors at once."""
        x, probes = read_array(self.folder, f"vector-{shard}-{k}"), self.probes[k]
        if probes == ALL:
            for lo in range(0, len(x), BLOCK):
                own = x[lo : lo + BLOCK].astype(np.float64)
                yield np.arange(len(q)), np.arange(lo, lo + len(own)), own
            return
        for i, places in enumerate(self._found(shard, k, q)):
            for lo in range(0, len(places), BLOCK):
                part = places[lo : lo + BLOCK]
                yield np.array([i]), part, x[part].astype(np.float64)

    def search(self, shard: int, held: set[tuple[int, int]], rep: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query, found, score) of the k best that queries find in a shard, and with how many vectors each was compared."""
        for lo in range(0, len(q), QUERIES):
            mine, who = q[lo : lo + QUERIES], rep[lo : lo + QUERIES]
            best, looked = [], np.zeros(len(mine), np.int64)
            for b, band in enumerate(self.bands):
                if band.width != q.shape[1] or (shard, b) not in held:
                    continue
                names = read_array(self.folder, f"rep-{shard}-{b}")
                for some, places, own in self._blocks(shard, b, mine):
                    looked[some] += len(places)
                    with np.errstate(over="ignore", invalid="ignore"):
                        s = mine[some] @ own.T
                    s[np.isnan(s)] = -np.inf
                    if s.shape[1] > k:
                        # Finds that may tie with the k-th stay in until the exact scores are there.
                        least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                        i, j = np.nonzero(s >= least - np.where(np.isfinite(least), 1e-9 * np.abs(least), 0))
                    else:
                        i, j = (z.ravel() for z in np.indices(s.shape))
                    best.append(best_of(who[some[i]], names[places[j]], products(mine[some[i]], own[j]), k))
            if best:
                yield *best_of(*(np.concatenate(c) for c in zip(*best, strict=True)), k), looked

    def compared(self, queries: DataFrame, n_queries: int, held: set[tuple[int, int]], k: int) -> DataFrame:
        """(query, rep, score): the k best for each of (rep, v), of which there are about `n_queries`."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard = np.asarray(batch.column("shard"))
                for s in np.unique(shard).tolist():
                    part = batch.filter(pa.array(shard == s))
                    for _, rows, q in _by_width(part):
                        for query, found, score, _ in self.search(s, held, np.asarray(part.column("rep"))[rows], q, k):
                            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(found), pa.array(score)], ["query", "rep", "score"])
            release_memory()

        # A query goes to each shard once; a shard's queries are dealt among several tasks, none of which maps many shards.
        most = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(1, min(-(-n_queries * self.shards // ASKED), max(most, self.shards)))
        blocks = max(1, tasks // self.shards)
        sent = queries.select("rep", "v", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))).alias("shard"))
        spread = sent.repartitionById(tasks, ((F.col("shard") * blocks + F.pmod(F.xxhash64("rep"), F.lit(blocks))) % tasks).cast("int"))
        found = spread.mapInArrow(run, "query long, rep long, score double")
        top = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
        return found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).drop("r")

    def looked(self, queries: DataFrame, held: set[tuple[int, int]], k: int) -> DataFrame:
        """(rep, looked): with how many vectors of each shard a query is compared."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, rows, q in _by_width(batch):
                    rep = np.asarray(batch.column("rep"))[rows]
                    for s in range(self.shards):
                        for lo in range(0, len(q), QUERIES):
                            for _, _, _, n in self.search(s, held, rep[lo : lo + QUERIES], q[lo : lo + QUERIES], k):
                                yield pa.RecordBatch.from_arrays([pa.array(rep[lo : lo + QUERIES]), pa.array(n)], ["rep", "looked"])

        return queries.select("rep", "v").mapInArrow(run, "rep long, looked long")

    def tune(self, pairs: DataFrame, recall: float) -> None:
        """Sets how many cells are looked into, from (band, v, x), the band, a query and a true neighbour: so many that the share `recall` of each band's pairs is found.

        A band that no pair is in is looked into in each table's nearest cell alone.
        """
        probes = [1] * len(self.bands)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, rows, q in _by_width(batch):
                    x = _matrix(batch.column("x").take(pa.array(rows)), d).astype(np.float64)
                    band = np.asarray(batch.column("band"))[rows]
                    for k, b in enumerate(self.bands):
                        mine = np.flatnonzero((band == b.band) & (b.width == d))
                        if not len(mine):
                            continue
                        unit, there = b.asked(q[mine]), b.units(x[mine])
                        best = np.full(len(mine), np.iinfo(np.int64).max)
                        for t in range(self.tables):
                            best = np.minimum(best, rank_of(nearness(unit, t, self.axes[k], self.seed), cells_of(nearness(there, t, self.axes[k], self.seed))))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), k)), pa.array(best)], ["k", "rank"])

        ranks = pairs.select("band", "v", "x").mapInArrow(run, "k long, rank long").groupBy("k").agg(F.sort_array(F.collect_list("rank")).alias("ranks")).collect()
        for r in ranks:
            wanted = r.ranks[max(0, int(np.ceil(recall * len(r.ranks))) - 1)]
            probes[r.k] = ALL if wanted > MOST_PROBES or wanted >= np.prod(self.axes[r.k]) else wanted
        self.probes = probes


def _prepared(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, asks) of the rows that take part; vectors keep their floats."""
    kind = rows.schema[vector_col].dataType
    exact = kind.elementType if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType | T.DoubleType) else T.DoubleType()
    v = F.col(quoted(vector_col)).cast(T.ArrayType(exact))
    fit = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    ident = F.col(quoted(id_col)).cast("long").alias("id")
    asked = queries.select(ident).distinct()
    all_rows = rows.where(F.col(quoted(id_col)).isNotNull() & fit).select(ident, v.alias("v"))
    return written(all_rows.join(asked.withColumn("asks", F.lit(True)), "id", "left").select("id", "v", F.coalesce("asks", F.lit(False)).alias("asks")).distinct(), "ann-rows")


def _norm() -> tuple[Column, Column]:
    """The band of a vector, by the logarithm of its norm, and its norm over two to the band: neither overflows, whatever finite values there are."""
    top = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    # Scaled by its largest component first, and by a power of two after.
    share = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x.cast("double") / F.col("top")) * (x.cast("double") / F.col("top"))))
    return top, share


@dataclass
class Built:
    """(id, v, asks) of the rows that take part, (rep, asks, v, band) of the distinct vectors, their index, its parts, the number of queries."""

    marked: DataFrame
    distinct: DataFrame
    index: Index
    held: set[tuple[int, int]]
    asked: int


def build(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, recall: float = RECALL, seed: int = 17, shard_bytes: int = SHARD_BYTES) -> Built:
    """The index of all rows, tuned for the queries; see nearest()."""
    spark = rows.sparkSession
    marked = _prepared(rows, queries, id_col, vector_col)
    top, share = _norm()
    base = marked.groupBy("v").agg(F.min("id").alias("rep"), F.bool_or("asks").alias("asks")).withColumn("top", top).withColumn("share", share)
    band = F.floor(F.log2("top") + F.log2("share") + 0.5).cast("int")
    # The norm over two to the band lies about one; it is put together from logarithms where the band is beyond doubles.
    distinct = written(base.withColumn("band", band).withColumn("norm", F.pow(F.lit(2.0), F.log2("top") - F.col("band")) * F.col("share")).select("rep", "asks", "v", "band", "norm"), "ann-distinct")
    known = distinct.groupBy("band", F.size("v").alias("width")).agg(F.min("norm").alias("low"), F.max("norm").alias("high"), F.count("*").alias("n"), F.count_if("asks").alias("asked")).collect()
    bands = [Band(r.band, r.width, r.high * (1 + 1e-12), r.low >= r.high * (1 - ALIKE), r.n) for r in sorted(known)]
    shards = max(1, -(-sum(b.n * b.width for b in bands) * 8 // shard_bytes))
    folder = fresh_path(spark, "ann")
    delete_at_exit(spark, folder)
    index, asked = Index(folder, bands, shards, tables, seed), sum(r.asked for r in known)
    held = index.build(distinct.select("rep", "v", "band", F.pmod(F.xxhash64("rep"), F.lit(shards)).alias("shard")))
    if recall < 1 and asked:
        # The sample is compared with all vectors: every band is looked into whole until it is tuned.
        sample = written(distinct.where("asks").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_QUERIES).select("rep", "v"), "ann-sample")
        truth = index.compared(sample, min(asked, SAMPLE_QUERIES), held, k + 1).where("rep <> query").join(sample.select(F.col("rep").alias("query"), "v"), "query")
        index.tune(truth.join(distinct.select("rep", F.col("v").alias("x"), "band"), "rep"), recall)
        drop_written(sample)
    return Built(marked, distinct, index, held, asked)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, recall: float = RECALL, seed: int = 17, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, rank INT, vec_id, score): the k rows found nearest to each row of `queries` (ids of `rows`), but itself.

    Nearness is the inner product in double precision; nearest first, ties to the smaller id; fewer than k
    only if there are fewer. About the share `recall` of the true neighbours is found; at 1 all are, since
    every vector is looked at. Vectors that are null, empty, all zero or hold a null, NaN or infinity take no
    part, nor do rows with null ids; vectors of different lengths never meet. Products too large for a double
    are infinite. Rows that repeat an id and its vector count once. Other columns are ignored; empty tables
    give no rows. The number of rows compared in one task is bounded by a shard and by a batch of queries.
    """
    made = build(rows, queries, k, id_col, vector_col, tables, recall, seed, shard_bytes)
    marked, distinct = made.marked, made.distinct
    near = made.index.compared(distinct.where("asks").select("rep", "v"), made.asked, made.held, k + 1)
    # Of equal vectors only the k + 1 smallest ids can be among anyone's nearest.
    copies = marked.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    by_vector = distinct.select(F.col("v").alias("w"), "rep")
    copies = copies.join(by_vector, F.col("v") == F.col("w")).select("rep", "id").distinct()
    wide = near.join(copies, "rep").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1)
    lists = wide.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("found"))
    who = marked.where("asks").join(by_vector, F.col("v") == F.col("w")).select(F.col("id").alias("query_id"), F.col("rep").alias("query")).distinct()
    answers = who.join(lists, "query").select("query_id", F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k).alias("found"))
    return answers.select("query_id", F.posexplode("found").alias("pos", "f")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.score").alias("score"))
