"""Packing token sequences by best-fit decreasing.

Documents are tokenised where they are read and cut into full windows and a rest. Only the pieces'
descriptions (and their ids, if asked for) are shuffled, dealt by id; each partition then packs its
pieces, longest first, each into the open window with the least room that still takes it, which a
segment tree over the remaining capacity finds. A partition's result depends on its rows alone, not
on their order, so a task that runs again gives the same windows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from palimpsest.llm.common import quoted, slices, texts_of

#: Words whose ids a worker remembers (about 40 bytes each); beyond it those that never came twice are forgotten.
WORDS_KEPT = 800_000
LEARNT_AT_ONCE = 4096
#: Text tokenised at once.
SLICE = 6 << 20
#: Words of these letters, with these marks after them or not, are one piece or two to a tokenizer that parts letters from marks.
PLAIN, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"


class WordTokenizer:
    """Ids of whole texts, for tokenizers that never look across ASCII blanks: each distinct word is tokenised once.

    If the tokenizer marks the ends of words, plain words (PLAIN letters, then MARKS) are tokenised many
    at once, as one text: how many pieces each has is known, and so is where its ids end. That this holds
    for a tokenizer is tried on a few words when it is loaded; if not, each word is tokenised alone.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already
        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            ends = np.zeros(max(vocabulary.values()) + 1, bool)
            ends[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True
            some = ["Hello,", "wörld", "ÀÉ?!", "a", "it", "tell", "Zebra:", "ÿ..."]
            if (found := self._many(some, np.array([2, 1, 2, 1, 1, 1, 2, 2]), ends)) and found[0].tolist() == [i for w in some for i in self._ids(w)]:
                self.ends = ends
        self._keep(np.zeros(0, bool))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _keep(self, which: np.ndarray) -> None:
        """Forgets all known words but these."""
        if not which.any():
            self.known = pa.array([], pa.large_string())
            self.ids, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        else:
            n = np.diff(self.start)
            self.known, self.ids = self.known.filter(pa.array(which)), self.ids[np.repeat(which, n)]
            self.start = np.concatenate(([0], np.cumsum(n[which])))
        self.again = np.zeros(len(self.known), bool)

    def _many(self, words: list[str], pieces: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of plain words, tokenised as one text, and how many each has; None if their pieces are not as many as they should be."""
        ids = np.array(self._ids(" ".join(words)), np.uint32)
        place, last = np.flatnonzero(ends[ids]) + 1, np.cumsum(pieces)
        if len(place) != last[-1] or place[-1] != len(ids):
            return None
        return ids, np.diff(place[last - 1], prepend=0)

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Learns words that are not known; where each of them is now."""
        order, found, counts = [], [], []
        alone = np.arange(len(new))
        if self.ends is not None:
            plain = np.asarray(pc.match_substring_regex(new, f"^[{PLAIN}]+[{MARKS}]*$"))
            pieces = 1 + np.asarray(pc.match_substring_regex(new, f"[{re.escape(MARKS)}]$"))
            alone = np.flatnonzero(~plain)
            for part in np.array_split(np.flatnonzero(plain), max(1, -(-int(plain.sum()) // LEARNT_AT_ONCE))):
                if not len(part):
                    continue
                got = self._many(new.take(pa.array(part)).to_pylist(), pieces[part], self.ends)
                if got is None:
                    alone = np.concatenate((alone, part))
                    continue
                order.append(part)
                found.append(got[0])
                counts.append(got[1])
        # An encoding is much larger than its ids, so few are alive at once.
        for k in range(0, len(alone), LEARNT_AT_ONCE):
            part = alone[k : k + LEARNT_AT_ONCE]
            each = [e.ids for e in self.tokenizer.encode_batch_fast(new.take(pa.array(part)).to_pylist(), add_special_tokens=False)]
            n = np.fromiter(map(len, each), np.int64, len(each))
            order.append(part)
            found.append(np.fromiter(chain.from_iterable(each), np.uint32, int(n.sum())))
            counts.append(n)
        learnt = np.concatenate(order)
        place = np.empty(len(new), np.int64)
        place[learnt] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new.take(pa.array(learnt))])
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(np.concatenate(counts))))
        self.ids = np.concatenate((self.ids, *found))
        self.again = np.concatenate((self.again, np.zeros(len(new), bool)))
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids start (one more at the end)."""
        lists = pc.ascii_split_whitespace(texts)
        at = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if len(self.known) + len(words) > WORDS_KEPT:
            self._keep(self.again if self.again.sum() <= WORDS_KEPT // 2 else np.zeros(len(self.again), bool))
        place = pc.index_in(words, value_set=self.known)
        fresh = np.asarray(place.is_null())
        place = np.asarray(pc.fill_null(place, 0)).astype(np.int64)
        if fresh.any():
            place[fresh] = self._learn(words.filter(pa.array(fresh)))
        # Worth remembering is what came again, be it in the same slice.
        self.again[place[~fresh | (np.bincount(np.asarray(coded.indices), minlength=len(words)) > 1)]] = True
        word = place[np.asarray(coded.indices)]
        n = np.diff(self.start)[word]
        ends = np.cumsum(n)
        flat = self.ids[np.arange(ends[-1]) + np.repeat(self.start[word] - (ends - n), n)]
        return flat, np.concatenate(([0], ends))[at - at[0]]


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class CapacityTree:
    """A segment tree over 0..size-1 that finds the smallest open capacity of at least some length."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << max(1, (size - 1).bit_length())
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, on: bool) -> None:
        node = capacity + self.leaves
        self.open[node] = on
        while node > 1:
            node >>= 1
            now = self.open[2 * node] or self.open[2 * node + 1]
            if self.open[node] == now:
                return
            self.open[node] = now

    def at_least(self, length: int) -> int | None:
        node = length + self.leaves
        if node >= 2 * self.leaves:
            return None
        while not self.open[node]:
            while node & 1:  # the last of its parent's children
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # past the right end of a level
                return None
        while node < self.leaves:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; the lengths must not increase."""
    tree, stacks, used = CapacityTree(window + 1), {}, []
    number, offset = [], []
    for n in lengths:
        room = tree.at_least(n)
        if room is None:
            k, room = len(used), window
            used.append(0)
        else:
            k = stacks[room].pop()
            if not stacks[room]:
                tree.set(room, False)
        number.append(k)
        offset.append(used[k])
        used[k] += n
        if left := room - n:
            stack = stacks.setdefault(left, [])
            if not stack:
                tree.set(left, True)
            stack.append(k)
    return number, offset


def cut(flat: np.ndarray, at: np.ndarray, window: int, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ids with `end_id` after each text; the text of each piece, where it starts among all ids and how long it is."""
    size = np.diff(at) + 1
    ends = np.cumsum(size)
    ids = np.full(int(ends[-1]) if len(ends) else 0, end_id, "<u4")
    own = np.ones(len(ids), bool)
    own[ends - 1] = False
    ids[own] = flat
    n = -(-size // window)
    of = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = (ends - size)[of] + nth * window
    return ids, of, start, np.minimum(window, ends[of] - start)


def _schema(keep_ids: bool, placed: bool = False) -> T.StructType:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    fields = [T.StructField(n, T.LongType()) for n in names] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids
    return T.StructType(fields + [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")] * placed)


def pieces(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each text's ids and `end_id`, cut into full windows and a rest.

    A null text is empty and gives the end id alone. Rows keep their id, null or repeated; an empty table
    gives no rows, and other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(tokenizer)
        for batch in batches:
            for _, part in slices(batch, "text", SLICE):
                ids, of, start, length = cut(*coder.encode(texts_of(part, "text")), window, end_id)
                size = np.bincount(of, length, part.num_rows).astype(np.int64)
                first = np.cumsum(size) - size
                data = memoryview(ids).cast("B")
                crc = np.fromiter((zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(start.tolist(), length.tolist(), strict=True)), np.int64, len(of))
                columns = [part.column("doc_id").take(pa.array(of)), pa.array(start - first[of]), pa.array(length), pa.array(crc), pa.array(size[of])]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(start, len(ids)).astype(np.int32)), pa.array(ids.view("<i4"))))
                yield pa.RecordBatch.from_arrays(columns, _schema(keep_ids).names)

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, _schema(keep_ids))


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset: where each piece lies, gapless from 0 in its window.

    Every id of every document is in exactly one piece. Ties of length are ordered by id, then start;
    rows that repeat an id are packed one by one. An empty table gives no rows. Pieces are dealt by all
    that is known of them, so rows without an id or of one id spread like others. Partitions should hold
    many pieces each: what a partition cannot fill stays open in its last windows.
    """
    parts = pieces(docs, tokenizer, window, end_id, id_col, text_col, keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]))
        number, offset = best_fit_decreasing(rows.column("length").to_pylist(), window)
        base = TaskContext.get().partitionId() << 40
        rows = rows.append_column("sequence_id", pa.array(np.asarray(number, np.int64) + base)).append_column("offset", pa.array(offset, pa.int64()))
        yield from rows.to_batches(max_chunksize=65536)

    spread = parts.repartition(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"))
    return spread.mapInArrow(run, _schema(keep_ids, True))
