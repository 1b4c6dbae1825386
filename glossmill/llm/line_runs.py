"""Line deduplication over levelled, sorted runs of line hashes.

1. A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys
   of ``least`` code points or more are hashed; the hashes, with the document and the
   position of the line, are written once, by batch. A batch is a range of document ids.
2. Batches are taken in ascending order of ids. The distinct hashes of a batch are
   merge-anti-joined with every run; what is left is new and becomes a run of its own,
   with the smallest and the largest document that hold it in the batch.
3. A run is a table bucketed and sorted by hash, so runs are never shuffled again and a
   batch only shuffles itself. ``fanout`` runs of a level are merged into one run of the
   next, so few runs exist at any time.
4. A line goes if its hash is not new in its batch (a smaller document has it) or if the
   run names another document as its first. All lines of the first document stay.
5. Texts are rebuilt from the positions that stay.

Hashes of more than one in ``1 / HOT`` of a batch's lines, at most ``1 / HOT`` of them by
counting, are looked up in the tasks that read the lines; all others meet their run by
hash. So no hash brings more than that share of the lines to one task, and no line or
document is left out. Everything is DataFrame functions; no Python runs on executors.

Null and empty texts are one empty line. Documents with a null id are left as they are.
Rows that repeat an id count as one document. Lines are told apart by 128 bits of SHA-256.
Ids are whole numbers. Columns besides the key and the text are not read, whatever their
names; an empty table gives no rows. Very long texts are handled in linear time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import texts
from glossmill.session import materialise, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\f\r"
#: Code points of the shortest key that counts.
LEAST = 10
#: Batches of a whole table, and runs of a level that are merged.
BATCHES, FANOUT = 4, 2
#: Share of a batch's lines above which a hash is looked up without a shuffle.
HOT = 1 / 2000
_RUN = ("h", "first", "last", "n")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, ASCII capitals lowered."""
    bare = F.trim(line, F.lit(WHITE))
    # the fast function agrees with the other one on texts of ASCII characters alone
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, UPPER, LOWER)
    )


def line_hash(key: Column) -> Column:
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def _cuts(docs: DataFrame, key: str, batches: int) -> list[int]:
    """Ids that part the documents into about equal batches."""
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)), F.lit(10_000))).first()[0]
    return sorted(set(found or []))


def hashed_lines(docs: DataFrame, key: str, least: int, batches: int) -> tuple[DataFrame, int]:
    """Stored rows of all long lines: h, doc, row, pos, partitioned by batch; the last batch."""
    spark = docs.sparkSession
    cuts = _cuts(docs, key, batches) if batches > 1 else []
    batch = reduce(lambda a, c: a + (F.col("doc") > c).cast("int"), cuts, F.lit(0))
    lines = (
        docs.where(F.col(key).isNotNull())
        # the hash of the text stands below the generator, which would repeat it by line
        .select(F.col(key).cast("long").alias("doc"), F.xxhash64("text").alias("row"), "text")
        .select("doc", "row", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
        .select("doc", "row", "pos", line_key(F.col("line")).alias("k"))
        .where(F.length("k") >= least)
        .select(line_hash(F.col("k")).alias("h"), "doc", "row", "pos", batch.alias("batch"))
    )
    path = scratch_path(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    schema = "h binary, doc long, row long, pos int, batch int"
    return spark.read.schema(schema).parquet(path), len(cuts)


class Runs:
    """Levels of runs; each run is a table bucketed and sorted by hash."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose hash no run holds."""
        for name in self.names():
            keys = keys.join(self.spark.table(name).select("h").hint("merge"), "h", "left_anti")
        return keys

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, "h")
            .write.bucketBy(self.buckets, "h")
            .sortBy("h")
            .option("path", scratch_path(self.spark, name))
            .saveAsTable(name)
        )
        return name

    def add(self, keys: DataFrame) -> str:
        """Write the hashes no run holds as a run of the lowest level, and name it."""
        name = self._write(self.unseen(keys).select(*_RUN))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        return name

    def compact(self) -> None:
        """Merge full levels; the hashes of different runs are disjoint."""
        for at in range(len(self.levels)):
            while len(self.levels[at]) >= self.fanout:
                merged, self.levels[at] = self.levels[at][: self.fanout], self.levels[at][self.fanout :]
                rows = reduce(DataFrame.unionAll, [self.spark.table(x).select(*_RUN) for x in merged])
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(self._write(rows))
                self.forget(merged)

    def forget(self, names: list[str]) -> None:
        """Take tables out of the catalogue; their files stay in the scratch folder."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def add_batch(lines: DataFrame, runs: Runs) -> DataFrame:
    """Lines of a batch that go: doc, row, pos. The batch's new hashes become a run."""
    keys = materialise(
        lines.groupBy("h").agg(
            F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")
        )
    )
    run = runs.spark.table(runs.add(keys))
    total = keys.agg(F.sum("n")).scalar()
    often = keys.where(F.col("n") > F.lit(HOT) * F.coalesce(total, F.lit(0))).select("h")
    hot = materialise(
        often.join(run.select("h", "first"), "h", "left").withColumn("hot", F.lit(True))
    )
    met = lines.join(F.broadcast(hot), "h", "left")  # 1 / HOT rows at most
    goes = F.col("first").isNull() | (F.col("first") != F.col("doc"))
    frequent = met.where(F.col("hot")).where(goes)
    rare = met.where(F.col("hot").isNull()).drop("first", "hot")
    rare = rare.join(run.select("h", "first").hint("merge"), "h", "left").where(goes)
    return materialise(frequent.unionByName(rare, allowMissingColumns=True).select("doc", "row", "pos"))


def dedup_lines(
    docs: DataFrame,
    key: str = "doc_id",
    least: int = LEAST,
    batches: int = BATCHES,
    fanout: int = FANOUT,
    keep_text: bool = False,
) -> DataFrame:
    """Per document: key, n_lines, n_dropped, kept_sha256, and the kept text if asked for."""
    rows = texts(docs, key)
    lines, last = hashed_lines(rows, key, least, batches)
    runs, gone = Runs(docs.sparkSession, fanout), []
    for number in range(last + 1):
        gone.append(add_batch(lines.where(F.col("batch") == number).drop("batch"), runs))
        if number < last:
            runs.compact()
    runs.forget(runs.names())
    dropped = (
        reduce(DataFrame.unionAll, gone)
        .distinct()
        .groupBy(F.col("doc").alias("_doc"), F.col("row").alias("_row"))
        .agg(F.collect_list("pos").alias("_gone"))
    )
    same = (F.col(key).cast("long") == F.col("_doc")) & (F.xxhash64("text") == F.col("_row"))
    n = F.size("_lines")
    stays = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stays, lambda i: F.get("_lines", i)), "\n")
    )
    out = (
        rows.join(dropped, same, "left")
        .select(key, "text", "_gone", F.split("text", "\n").alias("_lines"))
        .select(
            key,
            n.cast("long").alias("n_lines"),
            F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
            kept.alias("kept_text"),
        )
        .withColumn("kept_sha256", F.sha2("kept_text", 256))
    )
    return out if keep_text else out.drop("kept_text")
