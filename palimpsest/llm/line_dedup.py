"""Line deduplication with levelled sorted runs of line hashes, in DataFrame operations only.

The documents arrive in batches, those of the largest ids first. A run is a table of line hashes that
batches have brought for the first time, with the largest doc_id that holds the line there: since ids
fall from batch to batch, that is the largest of all, the one document that may keep the line. Each new
batch is merged with the runs: the anti-join gives its first sightings, which become its own run at level
0; what meets a run (the semi-join) only adds to the tally of documents that hold the line, and names no
document. So a hash is in one run alone. As soon as a level holds `fanout` runs, they are merged into one of the next level, and
the number of runs stays logarithmic in the number of batches. After the last batch a line that enough
documents hold is lost wherever it stands, but for the document that its run names.

Runs and batches are bucketed and sorted by hash alike, so that they meet as they lie: no join with a run,
and no merge of runs, deals or sorts a run again. Hashes are 128 bits wide (two XXH64 of the same key
with different seeds).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, delete_at_exit, delete_path, drop_written, free_names, fresh_path, named, quoted, text_of, written

#: What is stripped at both ends of a line before it is compared.
BLANKS = " \t\n\x0b\f\r"
KEY = ["h1", "h2"]
#: Stands for a null doc_id, so that it is the smallest of all.
NO_ID = -(2**63)
#: Makes Spark trust the order of a bucket that is one file.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


@contextmanager
def _buckets_in_order(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(ORDERED, "false")
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERED, before)


class SortedTable:
    """Rows by hash, bucketed and sorted, in the shared folder; one bucket for each of the session's shuffle partitions."""

    def __init__(self, rows: DataFrame) -> None:
        self.spark = rows.sparkSession
        self.name, self.path = f"palimpsest_run_{uuid.uuid4().hex}", fresh_path(self.spark, "line-run")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with _buckets_in_order(self.spark):
            rows.write.format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", self.path).saveAsTable(self.name)
        delete_at_exit(self.spark, self.path)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def plain(self) -> DataFrame:
        """The rows read as files of no order: what is to be put together with other tables (see _merged)."""
        return self.spark.read.schema(self.rows().schema).parquet(self.path)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.path)


def _merged(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two runs as one: a merge of what is sorted alike. A hash is in one run alone, so a row is that of the run it is in, the first one if there were two.

    Not a union that is grouped: Spark takes a union of bucketed tables for bucketed itself, but does not put their buckets together.
    """
    a, b = one.select(*KEY, F.struct("n_docs", "keeper").alias("a")).hint("merge"), two.select(*KEY, F.struct("n_docs", "keeper").alias("b"))
    return a.join(b, KEY, "full_outer").withColumn("x", F.coalesce("b", "a")).select(*KEY, "x.n_docs", "x.keeper")


class LineRuns:
    """The runs of all batches so far, by level, and the tallies of lines that came again. Batches must come in falling order of their ids."""

    def __init__(self, fanout: int = 2) -> None:
        self.fanout, self.levels, self.tallies = fanout, [], []

    def runs(self) -> list[SortedTable]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """Takes in a batch (id, h1, h2), whose ids are all smaller than those of earlier batches; repeats of a line in a document count once.

        An empty batch adds an empty run; rows may repeat.
        """
        batch = SortedTable(lines.select("id", *KEY).distinct().groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper")))
        runs = self.runs()
        if not runs:
            self._put(0, batch)
            return
        with _buckets_in_order(batch.spark):
            first = reduce(lambda rest, run: rest.join(run.rows().select(*KEY).hint("merge"), KEY, "left_anti"), runs, batch.rows())
            own = SortedTable(first)
            # A hash is in one run at most, so no row of the batch is tallied twice.
            again = [SortedTable(batch.rows().join(run.rows().select(*KEY).hint("merge"), KEY, "left_semi").withColumn("keeper", F.lit(None).cast("long"))) for run in runs]
        batch.drop()
        self.tallies += again
        self._put(0, own)

    def _put(self, level: int, run: SortedTable) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            with _buckets_in_order(run.spark):
                merged = SortedTable(reduce(_merged, [x.rows() for x in old]))
            for x in old:
                x.drop()
            self._put(level + 1, merged)

    def sightings(self) -> DataFrame:
        """(h1, h2, n_docs, keeper): the rows of all runs, one for each hash."""
        return reduce(DataFrame.unionAll, [run.plain() for run in self.runs()])

    def repeated(self, least_docs: int) -> DataFrame:
        """(h1, h2, keeper): the hashes that at least `least_docs` documents hold. The keeper is that of the run the hash is in."""
        rows = reduce(DataFrame.unionAll, [t.plain() for t in [*self.runs(), *self.tallies]])
        counted = rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.min("keeper").alias("keeper"))
        return counted.where(F.col("n_docs") >= least_docs).select(*KEY, "keeper")

    def drop(self) -> None:
        for t in [*self.runs(), *self.tallies]:
            t.drop()


def _batches(ids: DataFrame, batches: int) -> list[int]:
    """Ids that part the documents into about equal batches, from the largest on; where many share an id, there are fewer."""
    if batches < 2:
        return []
    cuts = ids.agg(F.percentile_approx("id", F.array(*[F.lit(k / batches) for k in range(1, batches)]), F.lit(10_000)).alias("cuts")).first().cuts
    return sorted(set(cuts or []), reverse=True)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """`docs` with repeated lines gone from `text_col`, and columns n_lines and n_dropped BIGINT (any such columns of `docs` are replaced).

    Texts are split at \\n; a line's key is the line without blanks at its ends, A-Z lower-cased. A key
    of at least `least_chars` code points that at least `least_docs` documents hold is kept only in the
    largest id holding it (there with all its repeats). Rows of one id are one document, each row keeping
    its own remaining lines; a null id is one document, smaller than all others. An empty text is one
    empty line, a null text too, but it stays null. Empty tables give empty results.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = text_of(text_col)
    ident = F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(NO_ID))
    # Batch 0 has the largest ids: a document's batch is the number of cuts that are not smaller than its id.
    cuts = _batches(docs.select(ident.alias("id")), batches)
    batch = reduce(lambda n, cut: n + (F.col("id") <= cut).cast("int"), cuts, F.lit(0))
    # The same text under the same id has the same lines to lose: that pair is what joins rows to their losses.
    path = fresh_path(spark, "lines")
    (
        docs.select(ident.alias("id"), F.xxhash64(text).alias("of"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        .select("id", "of", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= least_chars)
        .select("id", "of", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), batch.alias("batch"))
        .write.partitionBy("batch")
        .parquet(path)
    )
    delete_at_exit(spark, path)
    lines = spark.read.schema("id long, of long, pos int, h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns(fanout)
    for b in range(len(cuts) + 1):
        runs.add(lines.where(F.col("batch") == b))
    # Written first, so that the join below deals both sides anew: Spark can then split a line that very many documents hold.
    repeated = written(runs.repeated(least_docs), "lines-repeated")
    runs.drop()
    lost = written(lines.join(repeated, KEY).where("id <> keeper").groupBy("id", "of").agg(F.sort_array(F.collect_set("pos")).alias("lost")), "lines-lost")
    delete_path(spark, path)
    drop_written(repeated)

    n_id, n_of, n_lost, n_split, n_stops = free_names([*docs.columns, "n_lines", "n_dropped"], "id", "of", "lost", "lines", "stops")
    lost = lost.withColumnsRenamed({"id": n_id, "of": n_of, "lost": n_lost})
    # Between two lost lines lies a stretch of kept ones; the ends count as lost.
    stops = F.concat(F.array(F.lit(-1)), F.col(n_lost), F.array(F.size(n_split)))
    stretch = lambda k: F.slice(n_split, F.get(n_stops, k) + 2, F.get(n_stops, k + 1) - F.get(n_stops, k) - 1)
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(n_lost)), stretch)), "\n")
    joined = docs.select(*named(own)).join(lost, (ident == F.col(n_id)) & (F.xxhash64(text) == F.col(n_of)), "left")
    whole = F.col(quoted(text_col))
    joined = joined.withColumn(n_split, F.split(whole.cast("string"), "\n", -1)).withColumn(n_stops, F.when(F.col(n_lost).isNotNull(), stops))
    return joined.select(
        *[F.when(F.col(n_lost).isNull() | whole.isNull(), whole).otherwise(kept).alias(c) if c == text_col else c_ for c, c_ in zip(own, named(own), strict=True)],
        F.when(whole.isNull(), F.lit(1)).otherwise(F.size(n_split)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col(n_lost).isNotNull(), F.size(n_lost)), F.lit(0)).cast("long").alias("n_dropped"),
    )
