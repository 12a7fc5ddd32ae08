"""Lines that an earlier document has, dropped by levelled sorted runs of line hashes.

Documents come in batches in the order of their ids. The hashes of all lines
seen so far lie in runs: tables bucketed and sorted by hash. A new batch is
merge-anti-joined with the runs one after the other, its hashes shuffled and
sorted once; what no run holds becomes a run of its own, with the document that
owns each hash. ``FAN`` runs of a level are compacted to one of the next, so a
batch meets few runs however many came before.

DataFrame expressions only.
"""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.decontaminate import LOWER, UPPER
from newsgraph.llm.tables import salt_count
from newsgraph.session import Scratch

LEAST_CHARS = 10
BATCHES, FAN = 5, 2
SPACES = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACES))
    # lower() is the fast way where it does the same: in lines of ASCII only.
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def document_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, text_hash, place, h1, h2`` of every line whose key has ``least_chars`` code points or more.

    The two hashes are 128 bits of the key together.
    """
    placed = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
    keyed = placed.select("doc_id", "text_hash", "place", line_key(F.col("line")).alias("key"))
    long = keyed.filter(F.length("key") >= least_chars)
    return long.select("doc_id", "text_hash", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """Sorted runs of line hashes in levels, each hash in one run with its owner.

    Runs are bucketed tables in a folder of ``scratch``, named in the session's
    catalog until ``close``. ``levels[k]`` lists the runs of level k.
    """

    def __init__(self, scratch: Scratch, fan: int = FAN, buckets: int | None = None):
        if fan < 2:
            raise ValueError("a level needs two runs at least to be compacted")
        self.scratch, self.spark, self.fan = scratch, scratch.spark, fan
        self.buckets = buckets or salt_count(self.spark)
        self.levels: list[list[str]] = [[]]

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` whose hash is in no run: one exchange of ``keys``, a merge with each run."""
        return reduce(lambda left, name: left.join(self.spark.table(name).hint("merge"), HASH, "left_anti"), self.runs(), keys)

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid4().hex}"
        writer = rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
        writer.option("path", f"{self.scratch.folder}/{name}").saveAsTable(name)
        return name

    def add(self, keys: DataFrame) -> None:
        """The hashes of ``keys`` that no run holds, as a new run; full levels are compacted.

        ``keys`` has ``h1, h2, doc_id``; of a hash's rows the least doc_id owns it,
        a null one only if there is no other.
        """
        owned = keys.groupBy(*HASH).agg(F.min("doc_id").alias("doc_id"))
        self.levels[0].append(self._write(self.fresh(owned)))
        level = 0
        while len(self.levels[level]) >= self.fan:
            full = self.levels[level]
            merged = self._write(reduce(DataFrame.unionByName, map(self.spark.table, full)).repartition(self.buckets, *HASH))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level], level = [], level + 1
            self.levels[level].append(merged)
            self._drop(full)

    def owners(self) -> DataFrame:
        """``h1, h2, doc_id`` of every hash in the runs."""
        return reduce(DataFrame.unionByName, [self.spark.table(name) for name in self.runs()])

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Forgets the tables; their files go with the scratch folder."""
        self._drop(self.runs())
        self.levels = [[]]


def _batch(doc_id: Column, bounds: list[float]) -> Column:
    """The number of bounds below an id; null ids are in the last batch."""
    number = sum(((doc_id > b).cast("int") for b in bounds), F.lit(0))
    return F.coalesce(number, F.lit(len(bounds)))


def dropped_lines(docs: DataFrame, scratch: Scratch, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """``doc_id, text_hash, dropped``: the places of the lines that a document loses, if any."""
    bounds = docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    bounds = sorted(set(bounds))
    lines = document_lines(docs).withColumn("batch", _batch(F.col("doc_id"), bounds))
    path = f"{scratch.folder}/lines-{uuid4().hex}"
    lines.write.partitionBy("batch").parquet(path)
    lines = docs.sparkSession.read.schema(lines.schema).parquet(path)
    runs = LineRuns(scratch, fan)
    try:
        for k in range(len(bounds) + 1):
            runs.add(lines.filter(F.col("batch") == k))
        owners = runs.owners()
        same = [F.col("l.h1") == F.col("o.h1"), F.col("l.h2") == F.col("o.h2"), F.col("l.doc_id").eqNullSafe(F.col("o.doc_id"))]
        lost = lines.alias("l").join(owners.alias("o"), same, "left_anti")
        places = lost.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("dropped"))
        return scratch.store(places, "dropped")
    finally:
        runs.close()


def _without(lines: Column, dropped: Column) -> Column:
    """The lines that stay, joined. Linear: places are told apart by hash sets, and the split is done once."""
    stay = lambda n: F.array_except(F.sequence(F.lit(0), n - 1), dropped)
    bound = F.transform(F.array(lines), lambda held: F.array_join(F.transform(stay(F.size(held)), lambda k: F.get(held, k)), "\n"))
    return F.get(bound, 0)


def dedup_lines(docs: DataFrame, scratch: Scratch, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """Every document with the lines of earlier documents dropped.

    ``doc_id, text, n_lines, n_dropped``: a line whose key (``line_key``) has
    LEAST_CHARS code points or more goes unless no document with a smaller id
    holds it; the rest stays as it is, joined by newlines. ``n_lines`` is before
    dropping. The result does not depend on ``batches`` and ``fan``.

    A null or empty text is one empty line and comes back empty. Rows with the
    same id count as one document and keep the same lines; a null id is larger
    than any other, all rows without an id being one document. Repeated lines
    within the owning document stay. An empty table gives an empty one; other
    columns are dropped. A text is split in one row, so it and its lines must fit
    a task; nothing else grows with a line, an id or a source.
    """
    lost = dropped_lines(docs.select("doc_id", "text"), scratch, batches, fan)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_hash(F.col("text")).alias("text_hash"))
    same = [F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")), F.col("d.text_hash") == F.col("p.text_hash")]
    joined = rows.alias("d").join(lost.alias("p"), same, "left")
    lines = lines_of(F.col("text"))
    return joined.select(
        "d.doc_id",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(_without(lines, F.col("dropped"))).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
