"""Toxicity by a factorization machine over hashed terms.

Terms are the 5-, 6- and 8-byte windows of the lower-cased, blank-joined words (with a blank at either
end), hashed to 64 bits: they see word beginnings that inflected forms share. Each is a feature three
times over, as found at least once, twice and four times in a text. A bounded sample of
labelled documents is read to find the terms that tell the classes apart; the machine is then fitted
in numpy on those documents' terms. score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over the
features of a text, so that pairs of terms can say more than their sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import blank_split, drop_written, free_names, joined, named, quoted, release_memory, slices, text_of, texts_of, with_column, written

#: Bounds: labelled documents that are read, terms in the model. Both are parameters of fit().
SAMPLE_DOCS, MOST_TERMS = 12_000, 20_000
#: A term must occur in so many positive documents of the sample, and so clearly (chi-squared), to be chosen.
LEAST_DOCS, LEAST_CHI2 = 5, 24.0
SIZES = (5, 6, 8)
#: A term's features: found so many times or more. Factors of each.
TIMES, FACTORS = (1, 2, 4), 4
MIX = np.uint64(0x9E3779B97F4A7C15)


def terms_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, text number) of every window, for each window size."""
    words, first = blank_split(texts)
    if not len(words):
        return
    buf, start, end = joined(words)
    data = np.frombuffer(b" " + buf + b" " * 9, np.uint8)
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    some = np.flatnonzero(np.diff(first))
    # A text's windows run from the blank before its first word to the blank after its last.
    lo, hi = start[first[:-1][some]], end[first[1:][some] - 1] + 2
    for size in SIZES:
        n = np.maximum(hi - lo - size + 1, 0)
        ends = np.cumsum(n)
        owner = np.repeat(some, n)
        at = np.arange(ends[-1]) + np.repeat(lo - (ends - n), n)
        h = (eight[at] & np.uint64((1 << 8 * size) - 1)) * MIX + np.uint64(size)
        yield h ^ (h >> np.uint64(29)), owner


@dataclass
class Machine:
    """terms (sorted hashes), the linear weights and factors of their features, the bias."""

    terms: np.ndarray
    weight: np.ndarray
    factor: np.ndarray
    bias: float

    def score_bags(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Scores of n documents from distinct (document, feature number) pairs."""
        linear = np.bincount(doc, self.weight[term], n)
        pair = np.zeros(n)
        for k in range(self.factor.shape[1]):
            v = self.factor[term, k]
            pair += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pair, -30, 30)))

    def bags(self, texts: pa.Array, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, feature number) pairs: feature len(TIMES) * t + k says that term t is there TIMES[k] times."""
        found = [np.zeros(0, np.int64)]
        if len(self.terms):
            for h, owner in terms_of(texts):
                may = sieve[h >> np.uint64(64 - SIEVE_BITS)]
                h, owner = h[may], owner[may]
                at = np.searchsorted(self.terms, h)
                at[at == len(self.terms)] = 0
                ok = self.terms[at] == h
                found.append(owner[ok] * len(self.terms) + at[ok])
        pairs, n = np.unique(np.concatenate(found), return_counts=True)
        times = (n[:, None] >= np.array(TIMES)).ravel()
        doc = np.repeat(pairs // max(1, len(self.terms)), len(TIMES))[times]
        feature = (pairs[:, None] % max(1, len(self.terms)) * len(TIMES) + np.arange(len(TIMES))).ravel()[times]
        return doc, feature

    def score(self, texts: pa.Array, sieve: np.ndarray) -> np.ndarray:
        return self.score_bags(*self.bags(texts, sieve), len(texts))

    def sieve(self) -> np.ndarray:
        """Which leading bits some chosen term has: most windows are ruled out by one look."""
        out = np.zeros(1 << SIEVE_BITS, dtype=bool)
        out[self.terms >> np.uint64(64 - SIEVE_BITS)] = True
        return out


SIEVE_BITS = 20
#: Text whose windows are in memory at once (about 60 bytes for each of its bytes).
SLICE = 1 << 20


def train(doc: np.ndarray, term: np.ndarray, label: np.ndarray, terms: np.ndarray, factors: int = FACTORS, epochs: int = 300, rate: float = 0.1, decay: float = 1e-4, seed: int = 0) -> Machine:
    """AdaGrad on the log loss of all documents at once; the classes weigh alike up to a factor of ten.

    One value a (document, feature) pair is held for each of five arrays, whatever the number of factors.
    """
    rnd = np.random.default_rng(seed)
    n, m = len(label), len(terms) * len(TIMES)
    w, v, b = np.zeros(m), np.ascontiguousarray(rnd.normal(0, 0.05, (m, factors)).T), 0.0
    gw, gv, gb = np.full(m, 1e-8), np.full((factors, m), 1e-8), 1e-8
    share = label.mean()
    scale = np.where(label == 1, min(10.0, 0.5 / share), 1.0)
    scale /= scale.sum()
    sums = np.empty((factors, n))
    for _ in range(epochs):
        z = b + np.bincount(doc, w[term], n)
        for k in range(factors):
            own = v[k][term]
            sums[k] = np.bincount(doc, own, n)
            own *= own
            z += 0.5 * (sums[k] ** 2 - np.bincount(doc, own, n))
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * scale
        each = off[doc]
        dw, dv = np.bincount(term, each, m) + decay * w, np.empty_like(v)
        for k in range(factors):
            own = sums[k][doc]
            own -= v[k][term]
            own *= each
            dv[k] = np.bincount(term, own, m) + decay * v[k]
        db = off.sum()
        gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
        w, v, b = w - rate * dw / np.sqrt(gw), v - 0.3 * rate * dv / np.sqrt(gv), b - rate * db / np.sqrt(gb)
    return Machine(terms, w, np.ascontiguousarray(v.T), float(b))


def _trained(terms: np.ndarray):
    """One task's work: the bags of the bounded sample in, one row with the machine's arrays out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, sizes, found = [], [], [np.zeros(0, np.int64)]
        for batch in batches:
            labels.append(np.asarray(batch.column("label"), np.float64))
            lists = batch.column("terms")
            sizes.append(np.asarray(pc.list_value_length(lists), np.int64))
            found.append(np.asarray(lists.flatten(), np.int64))
        if not labels:
            return
        size = np.concatenate(sizes)
        machine = train(np.repeat(np.arange(len(size)), size), np.concatenate(found), np.concatenate(labels), terms)
        yield pa.RecordBatch.from_arrays([pa.array([machine.weight.tobytes()]), pa.array([machine.factor.tobytes()]), pa.array([machine.bias])], ["weight", "factor", "bias"])
        release_memory()

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None, sample_docs: int = SAMPLE_DOCS, most_terms: int = MOST_TERMS) -> Machine:
    """A machine learnt from labelled documents, of which about `sample_docs` are drawn by a hash of their id.

    `learn` says which labels may be used. A document with several labels is toxic if one says so; of rows
    that repeat an id the first text in alphabetical order counts; null ids, labels or texts teach nothing.
    Where only one class is left, the machine scores all texts alike, by that class (0 without labels). The
    sample is counted, chosen from and fitted on executors, the fit in one task: only hashes of terms and
    the machine itself, both bounded by the sample, come to the driver.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(quoted(id_col)).isNotNull() & F.col(quoted(label_col)).isNotNull())
    known = (known if learn is None else known.where(learn)).groupBy(F.col(quoted(id_col)).cast("long").alias("_id")).agg((F.max(quoted(label_col)) > 0).cast("int").alias("label"))
    there = known.count()
    if not there:
        return Machine(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, 1)), -30.0)
    share = min(1.0, sample_docs / there)
    # The sample is bounded by a parameter, and so is what is broadcast of it.
    drawn = known.where(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * share))
    text = docs.select(F.col(quoted(id_col)).cast("long").alias("_id"), F.col(quoted(text_col)).cast("string").alias("text")).where("text is not null")
    sample = written(text.join(F.broadcast(drawn), "_id").groupBy("_id", "label").agg(F.min("text").alias("text")), "toxicity-sample")
    positive = sample.where("label = 1")
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        drop_written(sample)
        return Machine(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, 1)), 30.0 if 1 in sizes else -30.0)

    def counted(rows: DataFrame, keep=None) -> DataFrame:
        """For each term (of `keep`, if given) the documents that hold it as often as each of TIMES."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, sieve = keep.value if keep is not None else (None, None)
            for batch in batches:
                for _, part in slices(batch, "text", SLICE):
                    for h, owner in terms_of(texts_of(part, "text")):
                        if wanted is not None:
                            may = sieve[h >> np.uint64(64 - SIEVE_BITS)]
                            h, owner = h[may], owner[may]
                            at = np.searchsorted(wanted, h)
                            at[at == len(wanted)] = 0
                            ok = wanted[at] == h
                            h, owner = h[ok], owner[ok]
                        if not len(h):
                            continue
                        order = np.lexsort((owner, h))
                        h, owner = h[order], owner[order]
                        heads = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))))
                        times = np.diff(np.append(heads, len(h)))[:, None] >= np.array(TIMES)
                        term, first = np.unique(h[heads], return_index=True)
                        n = np.add.reduceat(times, first, axis=0, dtype=np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), *(pa.array(n[:, k]) for k in range(len(TIMES)))], ["term", *names])

        each = rows.select("text").mapInArrow(run, ", ".join(f"{c} long" for c in ["term", *names]))
        return each.groupBy("term").agg(*[F.sum(c).alias(c) for c in names])

    names = [f"n{k}" for k in range(len(TIMES))]
    hashes = lambda df: np.sort(df.select("term").toArrow().column("term").to_numpy().view(np.uint64))
    # Every term of enough positive documents; the sample bounds their number, and so what is broadcast of them.
    often = written(counted(positive).where(F.col("n0") >= LEAST_DOCS), "toxicity-terms")
    terms = hashes(often)
    if len(terms):
        sent = spark.sparkContext.broadcast((terms, Machine(terms, np.zeros(0), np.zeros((0, 1)), 0.0).sieve()))
        other = counted(sample.where("label = 0"), sent).select("term", *[F.col(c).alias(f"y{c}") for c in names])
        p, q = float(sizes[1]), float(sizes[0])

        def chi2(name: str) -> Column:
            x, y = F.col(name).cast("double"), F.coalesce(F.col(f"y{name}"), F.lit(0)).cast("double")
            spread = (x + y) * (F.lit(p + q) - x - y) * p * q
            gap = x * (F.lit(q) - y) - y * (F.lit(p) - x)
            return F.when(spread > 0, F.lit(p + q) * (gap * gap) / F.greatest(spread, F.lit(1.0))).otherwise(0.0)

        told = often.join(other, "term", "left").select("term", F.greatest(*map(chi2, names)).alias("chi2")).where(F.col("chi2") >= LEAST_CHI2)
        terms = hashes(told.orderBy(F.desc("chi2"), "term").limit(most_terms))
        sent.destroy()
    drop_written(often)
    bare = Machine(terms, np.zeros(len(terms)), np.zeros((len(terms), 1)), 0.0)
    chosen = spark.sparkContext.broadcast(bare)

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, sieve = chosen.value, chosen.value.sieve()
        for batch in batches:
            for _, part in slices(batch, "text", SLICE):
                doc, term = machine.bags(texts_of(part, "text"), sieve)
                starts = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("label"), pa.ListArray.from_arrays(pa.array(starts), pa.array(term.astype(np.int32)))], ["_id", "label", "terms"])

    bags = sample.mapInArrow(bagged, "_id long, label int, terms array<int>")
    row = bags.repartition(1).sortWithinPartitions("_id").mapInArrow(_trained(terms), "weight binary, factor binary, bias double").first()
    chosen.destroy()
    drop_written(sample)
    return Machine(terms, np.frombuffer(row.weight), np.frombuffer(row.factor).reshape(len(terms) * len(TIMES), FACTORS), row.bias)


def score(docs: DataFrame, machine: Machine, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """`docs` with a column `out`, the score of every whole text; a column of that name is replaced, all others are kept.

    A null text is empty, and an empty one is scored like any other, by the bias alone. Rows are scored one by
    one, so repeats get the same score; an empty table gives no rows.
    """
    rows = docs.drop(out)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = sent.value.sieve()
        for batch in batches:
            for _, part in slices(batch, text_col, SLICE):
                scores = sent.value.score(texts_of(part, text_col), sieve)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*part.schema.names, out])

    return with_column(rows, run, out, T.DoubleType())


def learnable(id_col: str = "doc_id", folds: int = 5, held_out: int = 0) -> Column:
    """Rows whose crc32 of the id as text is not `held_out` modulo `folds`; a null id is the empty text."""
    return F.crc32(text_of(id_col).cast("binary")) % folds != held_out


def without_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """`docs` without what scores at least `least`, columns as they were.

    Null and empty texts have the score of the bias; rows of one text stay or go together, whatever their
    ids; an empty table stays empty.
    """
    (own,) = free_names(docs.columns, "toxicity")
    return score(docs, machine, text_col, own).where(F.col(own) < least).select(*named(docs.columns))
