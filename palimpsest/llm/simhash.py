"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 16 four-bit segments. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints, so all links
lie within `radius` of each other on that grid. The range join on the grid is exact: the segments
are dealt into groups, a pair within the radius agrees in all but `radius` groups at least, and a
cell is a choice of that many groups with their counts. There are the more groups the more
fingerprints there are, so that a cell stays small. Inside a cell the Manhattan distance of the
packed counts rules out most pairs; the exact Hamming distance decides on the others.

A cell of more than CELL_ROWS distinct fingerprints is dealt in blocks, every pair of blocks in a
task of its own, so no cell grows a task without bound and no pair is lost. Only links that span a
cell's groups leave it, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import blank_split, drop_written, free_names, joined, named, quoted, slices, texts_of, written
from palimpsest.llm.components import components

#: Distinct fingerprints of a cell that one task compares; larger cells are dealt in blocks of it.
CELL_ROWS = 4096
SEGMENTS, SEED = 16, 42
CHUNK = 1 << 16
#: Rows of one fingerprint that are joined in one part of a join.
SHARE_ROWS = 100_000
#: The chance that two segments at random have the same bit count; what a row of a cell costs in compared pairs, and how many cells a fingerprint may have.
ALIKE, ROW_COST, MOST_CELLS = 70 / 256, 30, 300
#: The low three bits, the high bit, and every other one of sixteen four-bit fields.
_LOW3, _HIGH1, _EVEN = np.uint64(0x7777777777777777), np.uint64(0x8888888888888888), np.uint64(0x0F0F0F0F0F0F0F0F)


def fingerprints_of(texts: pa.Array, shingle: int) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text (see fingerprints())."""
    words, first = blank_split(texts)
    if not len(words):
        return np.zeros(len(texts), np.uint64)
    buf, start, end = joined(words)
    n = np.diff(first)
    m = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), m)
    at = np.concatenate(([0], np.cumsum(m)))
    s = first[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
    a, b = start[s].tolist(), end[np.minimum(s + shingle, first[1:][doc]) - 1].tolist()
    h = np.fromiter(map(xxhash.xxh64_intdigest, (buf[i:j] for i, j in zip(a, b, strict=True)), repeat(SEED)), np.uint64, len(a))
    counts = np.zeros((len(n), 64), np.int64)
    for lo in range(0, len(h), CHUNK):
        part, owner = h[lo : lo + CHUNK], doc[lo : lo + CHUNK]
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[owner[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    on = counts * 2 > m[:, None]
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, fp BIGINT) of every row, over whole texts.

    A-Z is lower-cased, words are runs of non-blanks, shingles are `shingle` words joined by a space,
    repeats included; fewer words make one shingle of all, none (empty or null text) gives 0. A bit is
    1 if set in over half of the shingles' XXH64 (seed 42). Rows keep their id, null or repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch, "text"):
                fp = fingerprints_of(texts_of(part, "text"), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the sixteen segments of each fingerprint, in four bits each."""
    two = np.uint64(0x5555555555555555)
    x = fp - ((fp >> np.uint64(1)) & two)
    four = np.uint64(0x3333333333333333)
    return (x & four) + ((x >> np.uint64(2)) & four)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Manhattan distances of packed counts (0 to 4 in each field)."""
    up = (a | _HIGH1) - b  # in each field 8 + a - b, without a borrow from the next
    low = ~up & _HIGH1  # set where a < b
    ones = low >> np.uint64(3)
    gap = ((up & _LOW3) ^ (ones * np.uint64(7))) + ones
    pairs = (gap & _EVEN) + ((gap >> np.uint64(4)) & _EVEN)
    return (pairs * np.uint64(0x0101010101010101)) >> np.uint64(56)


def groups_for(n: int, radius: int) -> int:
    """The number of groups that makes the least work of `n` fingerprints: more groups are more cells, which hold less."""
    cost = lambda g: comb(g, radius) * (ROW_COST + n * ALIKE ** (SEGMENTS * (g - radius) / g))
    may = [g for g in range(radius + 1, SEGMENTS + 1) if g == radius + 1 or comb(g, radius) <= MOST_CELLS]
    return min(may, key=cost, default=SEGMENTS)


def grid_cells(fps: DataFrame, radius: int, n_groups: int) -> DataFrame:
    """(cell, fp): each distinct fingerprint once for each choice of all but `radius` groups of segments.

    A cell is the hash of a choice and its counts: what meets there by chance is told apart by the distances.
    Where no group need agree, all meet, in blocks.
    """
    groups = [[s for s in range(SEGMENTS) if s % n_groups == g] for g in range(n_groups)]
    count = lambda s: f"bit_count(shiftrightunsigned(fp, {4 * s}) & 15L)"
    packed = [" + ".join(f"{count(s)} * {5**k}L" for k, s in enumerate(group)) for group in groups]
    picks = [list(p) for p in combinations(range(n_groups), max(0, n_groups - radius))]
    counted = fps.selectExpr("fp", f"array({', '.join(packed)}) g")
    if n_groups <= radius:
        return counted.select(F.lit(0).cast("long").alias("cell"), "fp")
    chosen = F.transform(F.lit(picks), lambda pick, c: F.xxhash64(c, F.transform(pick, lambda k: F.get("g", k))))
    return counted.select(F.explode(chosen).alias("cell"), "fp")


def near(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs lie within the radius: the Manhattan distance of the counts first, then the Hamming distance of what is left."""
    ok = manhattan(pa_, pb) <= radius
    at = np.flatnonzero(ok)
    b_at = b[at] if b.ndim else b
    ok[at] = np.bitwise_count(a[at] ^ b_at) <= radius
    return ok


def _spanning(fp: np.ndarray, packed: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join what is within the radius in one cell, as a spanning forest: each node's search removes what it reaches."""
    a, b = [], []
    while len(fp) > 1:
        todo, fp, packed = [(fp[0], packed[0])], fp[1:], packed[1:]
        while todo and len(fp):
            x, p = todo.pop()
            found = near(fp, x, packed, p, radius)
            if found.any():
                a.append(np.full(found.sum(), x))
                b.append(fp[found])
                todo.extend(zip(fp[found], packed[found], strict=True))
                fp, packed = fp[~found], packed[~found]
    return a, b


def links_in_cells(rows: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of each run of equal (cell, block pair); the rows come sorted by them."""

    def linked(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        heads = np.flatnonzero(np.concatenate(([True], np.any(key[1:] != key[:-1], axis=1))))
        size = np.diff(np.append(heads, len(fp)))
        a, b = [], []
        small = np.repeat(size <= 32, size)
        run = np.repeat(np.arange(len(size)), size)
        packed = popcounts(fp)
        fps, counts, run = fp[small], packed[small], run[small]
        for d in range(1, int(size[size <= 32].max(initial=0))):
            same = run[d:] == run[:-d]
            x, y = fps[:-d][same], fps[d:][same]
            ok = near(x, y, counts[:-d][same], counts[d:][same], radius)
            a.append(x[ok])
            b.append(y[ok])
        for h, n in zip(heads[size > 32], size[size > 32], strict=True):
            more = _spanning(fp[h : h + n], packed[h : h + n], radius)
            a += more[0]
            b += more[1]
        a, b = (np.concatenate(v).view(np.int64) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    keep: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in rows:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(c)) for c in ("cell", "i", "j")], axis=1)
        fp = np.asarray(batch.column("fp")).view(np.uint64)
        if (key[0] == key[-1]).all():  # one cell goes on
            cut = 0 if not keep or (keep[-1][0][-1] == key[0]).all() else None
        else:
            cut = int(np.flatnonzero(np.any(key != key[-1], axis=1))[-1]) + 1
        if cut is None:
            yield linked(*(np.concatenate(v) for v in zip(*keep, strict=True)))
            keep = []
        elif cut:
            keep.append((key[:cut], fp[:cut]))
            yield linked(*(np.concatenate(v) for v in zip(*keep, strict=True)))
            keep = []
        keep.append((key[cut or 0 :], fp[cut or 0 :]))
    if keep:
        yield linked(*(np.concatenate(v) for v in zip(*keep, strict=True)))


def links(fps: DataFrame, radius: int = 3, cell_rows: int = CELL_ROWS, n_groups: int | None = None) -> DataFrame:
    """(a, b): links that connect whatever distinct fingerprints lie within `radius` differing bits of each other."""
    cells = grid_cells(fps, radius, n_groups or groups_for(fps.count(), radius))
    large = cells.groupBy("cell").count().where(F.col("count") > cell_rows).select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("n"))
    # A block meets itself and every other one: pairs (i, j) with i <= j.
    dealt = (
        cells.join(large, "cell", "left")
        .withColumn("n", F.coalesce("n", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("fp"), "n").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    # The number of partitions is left to the session and to adaptive execution.
    spread = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return spread.select(F.col("cell").cast("long"), F.col("i").cast("long"), F.col("j").cast("long"), "fp").mapInArrow(lambda rows: links_in_cells(rows, radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 3, cell_rows: int = CELL_ROWS, share_rows: int = SHARE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    Documents link where their fingerprints differ in at most `radius` bits; component_id is the
    smallest doc_id that can be reached. Equal fingerprints are one node, so copies, however many,
    never meet in pairs; those of more than `share_rows` rows are joined in parts. Rows repeat if they
    repeat in `docs`; a row with a null id gets its component's smallest id (null if it has none); texts
    without words share fingerprint zero. An empty table gives no rows. Other columns of `docs` are not
    looked at.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.ceil(F.count("*") / share_rows).cast("int").alias("parts")), "nodes")
    roots = components(links(nodes.select("fp"), radius, cell_rows))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "parts")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = written(rooted.join(least, "root").select(F.col("fp").alias("node"), "component_id", "parts"), "classes")
    drop_written(nodes, roots)
    # A fingerprint that very many rows share is dealt in parts. Each such stands for more than `share_rows` rows, which
    # bounds what is broadcast: a hundred thousand pairs of numbers for ten thousand million rows.
    hot = by_fp.where("parts > 1").select(F.col("node").alias("fp"), F.col("parts").alias("n"))
    dealt = fps.join(F.broadcast(hot), "fp", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.coalesce("n", F.lit(1))).cast("int"))
    classes = by_fp.withColumn("part_", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = dealt.join(classes, (dealt.fp == classes.node) & (F.col("part") == F.col("part_")))
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """`docs` without the documents that are not the smallest doc_id of their component.

    Rows with a null id cannot be named by a component and stay; rows that repeat one id are one
    document and stay or go together. Every column of `docs` is kept as it is; an empty table stays empty.
    """
    id_col = settings.get("id_col", "doc_id")
    (own,) = free_names(docs.columns, "gone")
    gone = near_duplicates(docs, **settings).where("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, F.col(quoted(id_col)).cast("long") == F.col(own), "left_anti").select(*named(docs.columns))
