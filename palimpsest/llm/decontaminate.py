"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark passages.

Normalising maps every byte of a text to one byte (A-Z to a-z, what is no word character to a
blank), so an offset in the normalised text is an offset in the original. Each text is scanned once.

The automaton does not hold every window of an item, which would be the item thirteen times over: it
holds the item cut into blocks of seven words, one after the other. Whatever shares a window of thirteen
words with an item holds one of these blocks whole; from each block found the match is followed to both
sides, word by word, and counts if it is a window long. So the automaton is as large as the benchmark.
It is rebuilt in each Python worker from the benchmark's words, which are broadcast; a shard of the
benchmark is bounded by SHARD_CHARS. A larger benchmark is scanned shard by shard, each pass writing
nothing but what it found, by the hash of the text it was found in.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import drop_written, free_names, named, quoted, slices, text_of, texts_of, with_column, written

#: Bound on the pattern characters of one automaton (about 60 bytes of memory each).
SHARD_CHARS = 2_000_000

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b if b >= 0x80 else b | 0x20 if 0x41 <= b <= 0x5A else b if bytes([b]) in [bytes([w]) for w in _WORD] else 0x20 for b in range(256))

_HIT = [T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("item", T.StringType())]
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPAN)])
_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

Item = tuple[str | None, list[bytes]]


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


def blocks_of(words: list[bytes], window: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first word, words) of the blocks of which every window holds one whole; an item shorter than a window is one block."""
    n = len(words)
    if n < window:
        yield 0, words
        return
    size = (window + 1) // 2
    for at in range(0, n - size + 1, window - size + 1):
        yield at, words[at : at + size]


def shards_of(items: Iterable[tuple[str | None, str]], most: int) -> Iterator[list[Item]]:
    """Items with their words, in lists that stay within `most` characters (or hold one item)."""
    shard, chars = [], 0
    for name, text in items:
        words = words_of(text.encode())
        cost = sum(map(len, words)) + len(words)
        if shard and chars + cost > most:
            yield shard
            shard, chars = [], 0
        if words:
            shard.append((name, words))
            chars += cost
    yield shard


class Scanner:
    """The automaton of one shard; items of the same words are one."""

    def __init__(self, items: list[Item], window: int) -> None:
        self.window = window
        names: dict[bytes, set[str | None]] = {}
        for name, words in items:
            names.setdefault(b" ".join(words), set()).add(name)
        self.items = [(text.split(), sorted(who, key=str)) for text, who in names.items()]
        held: dict[bytes, list[tuple[int, int]]] = {}
        for i, (words, _) in enumerate(self.items):
            for at, block in blocks_of(words, window):
                held.setdefault(b" ".join(block), []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for block, places in held.items():
            # Bytes as Latin-1 characters; the blanks around keep blocks on whole words.
            self.automaton.add_word(f" {block.decode('latin-1')} ", (block.count(b" ") + 1, places))
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def hits(self, words: list[bytes]) -> list[tuple[int, int, str | None]]:
        """(first word, word after the last, item) of every longest run that is shared with an item and holds a window of it."""
        if self.empty or not words:
            return []
        text = f" {b' '.join(words).decode('latin-1')} "
        found = list(self.automaton.iter(text))
        if not found:
            return []
        blanks = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 0x20)
        last = np.searchsorted(blanks, [end for end, _ in found]).tolist()
        out, done = [], {}
        for e, (_, (n, places)) in zip(last, found, strict=True):
            for i, at in places:
                item, who = self.items[i]
                # A run followed from one of its blocks is not followed again from the next ones.
                along = (i, e - n - at)
                if done.get(along, 0) >= e:
                    continue
                start, end, before, after = e - n, e, at, at + n
                while start and before and words[start - 1] == item[before - 1]:
                    start, before = start - 1, before - 1
                while end < len(words) and after < len(item) and words[end] == item[after]:
                    end, after = end + 1, after + 1
                done[along] = end
                if end - start >= min(self.window, len(item)):
                    out += [(start, end, name) for name in who]
        return out


def spans_of(data: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Code point spans in the original text of runs of hit words."""
    norm = np.frombuffer(data.translate(_TABLE), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], norm.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    runs = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return [{"start": int(points[start[a]]), "end": int(points[end[b - 1]])} for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1), strict=True)]


_scanners: dict[str, Scanner] = {}


def _scanner(key: str, shard, window: int) -> Scanner:
    """One scanner at a time is kept in a worker: the tasks that follow use it again."""
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(shard.value, window)
    return _scanners[key]


def _told(data: bytes, words: list[bytes], hits: list[tuple[int, int, str | None]]) -> dict:
    hit = np.zeros(len(words), dtype=bool)
    for s, e, _ in hits:
        hit[s:e] = True
    return {"n_words": len(words), "n_hit": int(hit.sum()), "items": sorted({i for _, _, i in hits if i is not None}), "spans": spans_of(data, hit) if hits else []}


def _bytes_of(part: pa.RecordBatch, text_col: str) -> list[bytes]:
    return texts_of(part, text_col).cast(pa.large_binary()).to_pylist()


def _scanned(rows: DataFrame, sent, window: int, text_col: str, out: str) -> DataFrame:
    """`rows` with what one shard, the only one, has in each text."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, sent, window)
        for batch in batches:
            for _, part in slices(batch, text_col):
                found = []
                for data in _bytes_of(part, text_col):
                    words = words_of(data)
                    found.append(_told(data, words, scanner.hits(words)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, _FOUND)], [*part.schema.names, out])

    return with_column(rows, run, out, FOUND)


def _text_key(text_col: str) -> list[Column]:
    return [F.xxhash64(text_of(text_col)), F.xxhash64(F.lit(1), text_of(text_col))]


def _hits_by_text(rows: DataFrame, sent, window: int, text_col: str) -> DataFrame:
    """(k1, k2, s, e, item): the hits of one shard by a hash of the text they are in; texts without any give no row."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, sent, window)
        for batch in batches:
            for _, part in slices(batch, "text"):
                each = [(k, hits) for k, data in enumerate(_bytes_of(part, "text")) if (hits := scanner.hits(words_of(data)))]
                at = pa.array([k for k, hits in each for _ in hits], pa.int64())
                flat = [h for _, hits in each for h in hits]
                yield pa.RecordBatch.from_arrays([part.column("k1").take(at), part.column("k2").take(at), pa.array([h[0] for h in flat], pa.int32()), pa.array([h[1] for h in flat], pa.int32()), pa.array([h[2] for h in flat], pa.string())], ["k1", "k2", "s", "e", "item"])

    k1, k2 = _text_key(text_col)
    return rows.select(k1.alias("k1"), k2.alias("k2"), text_of(text_col).alias("text")).mapInArrow(run, T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), *_HIT]))


def _gathered(rows: DataFrame, hits: DataFrame, text_col: str, out: str) -> DataFrame:
    """`rows` with the hits of their texts put together."""
    n1, n2, held = free_names(rows.columns, "k1", "k2", "hits")
    by_text = hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e", "item")).alias(held)).withColumnsRenamed({"k1": n1, "k2": n2})
    k1, k2 = _text_key(text_col)
    both = rows.join(by_text, (k1 == F.col(n1)) & (k2 == F.col(n2)), "left").select(*named(rows.columns), held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch, text_col):
                found = [_told(data, words_of(data), [(h["s"], h["e"], h["item"]) for h in hits or ()]) for data, hits in zip(_bytes_of(part, text_col), part.column(held).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, _FOUND)], [*part.schema.names[:-1], out])

    return with_column(both, run, out, FOUND, drop=1)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, shard_chars: int = SHARD_CHARS, out: str = "contamination") -> DataFrame:
    """`docs` with a struct column `out`: n_words, n_hit, items (sorted texts of item ids), spans (code points of hit runs).

    Words are runs of 0-9, a-z and non-ASCII characters after A-Z is lower-cased. A window is `window`
    consecutive words of an item, or all of a shorter item; items without words have none. A word inside
    any occurrence of a window is hit. A null text has no words; an item with a null id marks words but
    is not listed; repeated item ids count once. A column named `out` is replaced, all others are kept.
    An empty benchmark hits nothing; rows may repeat, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    items = ((r[0], r[1]) for r in benchmark.select(F.col(quoted(item_col)).cast("string"), text_of(item_text)).toLocalIterator())
    rows = docs.drop(out)
    todo = shards_of(items, shard_chars)
    shard, after = next(todo), next(todo, None)
    if after is None:
        return _scanned(rows, spark.sparkContext.broadcast(shard), window, text_col, out)
    hits, parts = None, []
    while shard is not None:
        sent = spark.sparkContext.broadcast(shard)
        parts.append(written(_hits_by_text(rows, sent, window, text_col), "contamination"))
        sent.destroy()
        hits = parts[-1] if hits is None else hits.unionAll(parts[-1])
        shard, after = after, next(todo, None)
    all_hits = written(hits.distinct(), "contamination")
    drop_written(*parts)
    return _gathered(rows, all_hits, text_col, out)


def is_contaminated(out: str = "contamination", share: int = 20) -> Column:
    """At least one word in `share` is hit."""
    c = F.col(quoted(out))
    return (c["n_hit"] > 0) & (c["n_hit"] * share >= c["n_words"])


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """`docs` without contaminated documents, columns as they were.

    Null and empty texts have no words and stay; rows of one text stay or go together, whatever their ids;
    an empty benchmark lets all stay, an empty table stays empty.
    """
    (own,) = free_names(docs.columns, "contamination")
    found = find_contamination(docs, benchmark, out=own, **settings)
    return found.where(~is_contaminated(own)).select(*named(docs.columns))
