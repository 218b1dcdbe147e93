"""An interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers.

Words are known by 64-bit hashes. Every task counts what it reads in sorted arrays and sends one
array per shard; a shard's arrays are merged by one task, which writes them to the shared folder:
sorted word hashes with counts, sorted (context, word) pairs with counts, contexts with their totals
and numbers of words seen once, twice and more often, and for each word its number of different
contexts. A word's id is its place among all hashes. Scoring looks up sorted needles in these files,
which are mapped, not loaded. Files are written under a passing name and renamed, so a task that runs
again leaves the same file. A worker maps a bounded number of them at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import blank_split, delete_at_exit, delete_path, drop_written, fresh_path, groups_of, read_array, slices, text_of, texts_of, with_column, write_array, written

#: Text bytes that a shard stands for; the number of shards has no upper limit.
SHARD_BYTES = 32 << 20
#: Counted entries that a task holds before it sends them.
HELD = 4_000_000
SEED = 42


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold the largest of them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts[:0]


class Tally:
    """Counts of a task, sent as one array of keys and one of counts for each shard."""

    def __init__(self, shard_of: Callable[[np.ndarray], np.ndarray]) -> None:
        self.shard_of, self.parts, self.n = shard_of, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, counts))
        self.n += len(keys)
        if self.n > HELD:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        keys, counts = add_up(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts, self.n = [], 0
        shard = self.shard_of(keys)
        order = np.argsort(shard, kind="stable")
        keys, counts, shard = keys[order], counts[order], shard[order]
        heads = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
        for a, b in zip(heads, [*heads[1:], len(keys)], strict=False):
            c = narrow(counts[a:b])  # few need more than a byte
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])], pa.int32()), pa.array([keys[a:b].tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary()), pa.array([c.itemsize], pa.int32())], ["shard", "keys", "counts", "wide"])


TALLY = "shard int, keys binary, counts binary, wide int"


def _merged(group: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys = [np.frombuffer(b, np.uint64) for b in group.column("keys").to_pylist()]
    counts = [np.frombuffer(b, f"u{w}").astype(np.int64) for b, w in zip(group.column("counts").to_pylist(), group.column("wide").to_pylist(), strict=True)]
    return group.column("shard")[0].as_py(), *add_up(np.concatenate(keys), np.concatenate(counts))


def _by_shard(tallies: DataFrame, shards: int, work: Callable[[int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["shard"]):
            yield from work(*_merged(group))

    # A shard is a partition: no two shards meet in a task by the chance of a hash.
    return tallies.repartitionById(shards, F.col("shard").cast("int")).mapInArrow(run, schema)


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The modified discounts for counts of 1, 2 and more, from the numbers of things counted 1 to 4 times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9  # too little text to estimate them
    y = n1 / (n1 + 2 * n2)
    bound = lambda x, k: min(max(x, 0.05), k - 0.05)
    return bound(1 - 2 * y * n2 / n1, 1), bound(2 - 3 * y * n3 / n2, 2), bound(3 - 4 * y * n4 / n3, 3)


@dataclass
class Model:
    """Where the arrays are, how long each shard's are, and the totals."""

    folder: str
    shards: int
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    n_tokens: int = 0
    n_words: int = 0
    end_count: int = 0
    types: int = 0
    pair_discounts: tuple[float, float, float] = (0.5, 0.75, 0.9)
    word_discounts: tuple[float, float, float] = (0.5, 0.75, 0.9)
    word_seen: tuple[int, int, int] = (0, 0, 0)
    end_contexts: int = 0
    counted: frozenset = frozenset()

    def delete(self, spark: SparkSession) -> None:
        """Removes the model's files, which otherwise go when the driver ends."""
        delete_path(spark, self.folder)

    # Ids: words from 0, then the end of a text, its beginning, and whatever is unknown.
    @property
    def end(self) -> int:
        return int(self.first[-1])

    @property
    def begin(self) -> int:
        return self.end + 1

    @property
    def unknown(self) -> int:
        return self.end + 2

    def hash_shard(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.shards.bit_length() + 1)).astype(np.int64) if self.shards > 1 else np.zeros(len(h), np.int64)

    def context_shard(self, v: np.ndarray) -> np.ndarray:
        return (v * np.uint64(self.shards) // np.uint64(self.unknown)).astype(np.int64)

    def _each(self, shard: np.ndarray) -> Iterator[tuple[int, slice]]:
        cut = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.unique(shard).tolist():
            yield s, slice(cut[s], cut[s + 1])

    def ids_of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and training counts of word hashes."""
        order = np.argsort(hashes)
        h, ids, counts = hashes[order], np.full(len(hashes), self.unknown, np.uint64), np.zeros(len(hashes), np.int64)
        for s, cut in self._each(self.hash_shard(h)):
            if self.first[s + 1] == self.first[s]:
                continue
            known = read_array(self.folder, f"word-{s}")
            at = np.searchsorted(known, h[cut])
            at[at == len(known)] = 0
            ok = known[at] == h[cut]
            ids[order[cut][ok]] = at[ok] + self.first[s]
            counts[order[cut][ok]] = read_array(self.folder, f"count-{s}")[at[ok]]
        return ids, counts

    def lower(self, w: np.ndarray) -> np.ndarray:
        """Probabilities of ids by the number of their different contexts, interpolated with the uniform one."""
        d, total = self.word_discounts, max(1, self.types)
        spare = sum(a * b for a, b in zip(d, self.word_seen, strict=True)) / total if self.types else 1.0
        n = np.zeros(len(w))
        order = np.argsort(w)
        x = w[order]
        word = x < self.end
        for s, cut in self._each(np.searchsorted(self.first, x[word], side="right") - 1):
            n[order[word][cut]] = read_array(self.folder, f"contexts-{s}")[(x[word][cut] - np.uint64(self.first[s])).astype(np.int64)] if f"contexts-{s}" in self.counted else 0
        n[w == self.end] = self.end_contexts
        return np.maximum(n - _discount(n, d), 0) / total + spare / (self.n_words + 1)

    def probabilities(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """P(w | v) of pairs of ids."""
        pairs = v << np.uint64(32) | w
        distinct, back = np.unique(pairs, return_inverse=True)
        v, w = distinct >> np.uint64(32), distinct & np.uint64(0xFFFFFFFF)
        p = self.lower(w)
        known = v < self.unknown
        for s, cut in self._each(self.context_shard(v[known])):
            if f"pair-{s}" not in self.counted:
                continue
            at = np.flatnonzero(known)[cut]
            keys, counts = read_array(self.folder, f"pair-{s}"), read_array(self.folder, f"pairs-{s}")
            place = np.searchsorted(keys, distinct[at])
            place[place == len(keys)] = 0
            c = np.where(keys[place] == distinct[at], counts[place], 0).astype(float)
            contexts, stats = read_array(self.folder, f"context-{s}"), read_array(self.folder, f"stats-{s}")
            place = np.searchsorted(contexts, v[at])
            place[place == len(contexts)] = 0
            seen = contexts[place] == v[at]
            total, spare = stats[place, 0], stats[place, 1]
            p[at] = np.where(seen, (np.maximum(c - _discount(c, self.pair_discounts), 0) + spare * p[at]) / np.where(seen, total, 1), p[at])
        return p[back]


def _discount(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.choose(np.minimum(n, 3).astype(np.int64), (0.0, *d))


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, which of them each word is, and where each text's words start."""
    words, first = blank_split(texts)
    coded = words.dictionary_encode()
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return h, np.asarray(coded.indices, np.int64), first


def _sequences(model: Model, word: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words (each text's end included) and where each text's tokens start."""
    n = len(first) - 1
    at = first + np.arange(n + 1)
    w = np.full(at[-1], model.end, np.uint64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    w[inside] = ids[word]
    v = np.empty(at[-1], np.uint64)
    v[1:] = w[:-1]
    v[at[:-1]] = model.begin
    return v, w, at


def fit(docs: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """A model of whole texts, A-Z lower-cased, of words between blanks and an end after each text.

    A null or empty text is an end alone; repeated rows count as often as they are there; ids and other
    columns are not looked at; of an empty table comes a model that knows no word. Counts are whole
    numbers of up to 64 bits. More than 2^32 distinct words raise an error: nothing is left out.
    """
    text = docs.select(text_of(text_col).alias("text"))
    size = text.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    shards = 1 << max(16, size.bytes // shard_bytes).bit_length() - 1
    folder = fresh_path(docs.sparkSession, "lm")
    delete_at_exit(docs.sparkSession, folder)
    model = Model(folder, shards)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(model.hash_shard)
        for batch in batches:
            for _, part in slices(batch, "text"):
                h, word, _ = _hashes(texts_of(part, "text"))
                yield from tally.add(h, np.bincount(word, minlength=len(h)))
        yield from tally.send()

    def keep_words(s: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        write_array(folder, f"word-{s}", keys)
        write_array(folder, f"count-{s}", narrow(counts))
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(keys)]), pa.array([int(counts.sum())])], ["shard", "n", "total"])

    made = _by_shard(text.mapInArrow(words, TALLY), shards, keep_words, "shard int, n long, total long").collect()
    sizes = np.zeros(shards, np.int64)
    for r in made:
        sizes[r.shard] = r.n
    model.first = np.concatenate(([0], np.cumsum(sizes)))
    model.end_count = size.n
    model.n_tokens, model.n_words = sum(r.total for r in made) + size.n, int(model.first[-1]) + (size.n > 0)
    if model.unknown >= 2**32:
        raise ValueError("more distinct words than 32-bit ids can tell apart")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(lambda keys: model.context_shard(keys >> np.uint64(32)))
        for batch in batches:
            for _, part in slices(batch, "text"):
                h, word, first = _hashes(texts_of(part, "text"))
                v, w, _ = _sequences(model, word, model.ids_of(h)[0], first)
                yield from tally.add(*np.unique(v << np.uint64(32) | w, return_counts=True))
        yield from tally.send()

    # A merged shard of pairs leaves its files, its numbers and, for every word, how many contexts it follows there.
    def keep_pairs(s: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        write_array(folder, f"pair-{s}", keys)
        write_array(folder, f"pairs-{s}", narrow(counts))
        v, w = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        heads = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        table = np.stack([np.add.reduceat(x, heads) for x in (counts, counts == 1, counts == 2, counts > 2)], axis=1).astype(np.int64)
        write_array(folder, f"context-{s}", v[heads].astype(np.uint32))
        write_array(folder, f"table-{s}", table)
        yield pa.RecordBatch.from_arrays([pa.array([-1 - s], pa.int32()), pa.array([np.array(_of_counts(counts) + [len(keys)], np.uint64).tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([8], pa.int32())], ["shard", "keys", "counts", "wide"])
        # The end of a text, whose id follows the last word's, goes with the last shard.
        tally = Tally(lambda keys: np.minimum(np.searchsorted(model.first, keys, side="right") - 1, shards - 1))
        yield from tally.add(*np.unique(w, return_counts=True))
        yield from tally.send()

    after = written(_by_shard(text.mapInArrow(pairs, TALLY), shards, keep_pairs, TALLY), "lm-contexts")
    told = after.where("shard < 0").select("shard", "keys").collect()
    numbers = np.sum([np.frombuffer(r["keys"], np.uint64) for r in told], axis=0).astype(int).tolist() if told else [0] * 5
    model.types, model.pair_discounts = numbers[4], discounts(numbers[:4])
    pair_shards = [-1 - r.shard for r in told]

    def keep_contexts(s: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = keys < model.end
        if own.any():
            dense = np.zeros(int(model.first[s + 1] - model.first[s]), np.int64)
            dense[(keys[own] - np.uint64(model.first[s])).astype(np.int64)] = counts[own]
            write_array(folder, f"contexts-{s}", narrow(dense))
        row = [s, *_of_counts(counts), int((counts > 2).sum()), int(counts[~own].sum()), int(own.any())]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["shard", "n1", "n2", "n3", "n4", "more", "ends", "any"])

    seen = _by_shard(after.where("shard >= 0"), shards, keep_contexts, "shard long, n1 long, n2 long, n3 long, n4 long, more long, ends long, any long").collect()
    drop_written(after)
    model.word_discounts = discounts([sum(r[f"n{k}"] for r in seen) for k in (1, 2, 3, 4)])
    model.word_seen = (sum(r.n1 for r in seen), sum(r.n2 for r in seen), sum(r.more for r in seen))
    model.end_contexts = sum(r.ends for r in seen)
    model.counted = frozenset([f"contexts-{r.shard}" for r in seen if r.any] + [f"pair-{s}" for s in pair_shards])

    # What a context gives to words unseen after it, now that the discounts are known.
    def keep_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column("id").to_pylist():
                table = read_array(folder, f"table-{s}")
                spare = table[:, 1:] @ np.array(model.pair_discounts)
                write_array(folder, f"stats-{s}", np.stack((table[:, 0].astype(float), spare), axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64())], ["id"])

    if pair_shards:
        spark = docs.sparkSession
        spark.createDataFrame([(s,) for s in pair_shards], "id long").repartition(min(len(pair_shards), 64)).mapInArrow(keep_stats, "id long").count()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "lm") -> DataFrame:
    """`docs` with a struct column `out`: n_tokens, n_known, base_score, score, of every whole text.

    Tokens are the words and one end; score is the model's log10 probability of them, base_score that of
    the training counts with a half added. A null text is empty; a column named `out` is replaced, all
    others are kept. A model of no text takes all words for unknown.
    """
    rows = docs.drop(out)
    kind = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = model.n_tokens + 0.5 * (model.n_words + 1)
        for batch in batches:
            for _, part in slices(batch, text_col):
                h, word, first = _hashes(texts_of(part, text_col))
                ids, counts = model.ids_of(h)
                v, w, at = _sequences(model, word, ids, first)
                c = np.full(len(w), model.end_count, np.int64)
                inside = np.ones(len(w), bool)
                inside[at[1:] - 1] = False
                c[inside] = counts[word]
                p = np.log10(model.probabilities(v, w))
                sums = [np.add.reduceat(x, at[:-1]) for x in ((c > 0).astype(np.int64), np.log10((c + 0.5) / whole), p)]
                found = pa.StructArray.from_arrays([pa.array(np.diff(at)), *map(pa.array, sums)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, out])

    long, double = T.LongType(), T.DoubleType()
    found = T.StructType([T.StructField("n_tokens", long), T.StructField("n_known", long), T.StructField("base_score", double), T.StructField("score", double)])
    return with_column(rows, run, out, found)
