"""The stored index: append-only generations of Parquet tables and a log of commits.

A writer claims a generation of its own by creating a file that must not be there yet, writes its
rows under it and commits it last, so a lost run leaves nothing visible and is simply run again.
A commit is one file of the log, moved to the next free number; a move never replaces a file.  If
another writer took the number, its commit is read, documents that both have written are settled
(the later commit counts: it lists the other's rows as superseded) and the next number is tried.
The file system must create and move files without replacing; object stores that do not need one
writer at a time.

A document's live rows are those that no (doc_id, generation) pair of the table of superseded rows
names, until ``compact`` rewrites the tables.  Tables read by id are partitioned by a hash bucket
of that id and postings by a bucket of the term, so that a lookup opens few partitions.  The number
of buckets is chosen when an index is made and kept by it.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.operators import cells as clustered
from passagemill.operators import postings as inverse
from passagemill.operators.cache import Cache, bucket_of, filter_rows
from passagemill.operators.chunking import with_embed_text
from passagemill.operators.rerank import Reranker, keyword_overlap, scorer_name
from passagemill.operators.retrieval import Corpus
from passagemill.schemas import LIMITS, IngestError

KEYED = {"parents": "parent_id", "children": "chunk_id", "postings": "term", "embeddings": "text_hash"}
MAX_BROADCAST_PAIRS = 200_000
BUCKETS = 8
#: The bucket of postings that holds range rows.
RANGES = -1
#: How often a rewrite of the whole index starts again because others have written meanwhile.
ATTEMPTS = 5
_COMMIT = (
    "gen bigint, replaces array<bigint>, dim int, model_id string, model_revision string, pipeline_version int, buckets int"
)


class Conflict(Exception):
    """Others have committed since a rewrite of the whole index began."""


class Index:
    def __init__(
        self, spark: SparkSession, path: str, model_id: str, model_revision: str,
        pipeline_version: int = LIMITS.pipeline_version, buckets: int = BUCKETS,
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.model_id, self.model_revision = model_id, model_revision
        self.pipeline_version = pipeline_version
        self.buckets = buckets
        self.gens: list[int] = []  # committed and not rewritten, in the order of their commits
        self._kept: dict[tuple, object] = {}  # what has been worked out for these generations
        self._schemas: dict[str, object] = {}
        self.dim: int | None = None
        self.refresh()

    # --- state ------------------------------------------------------------------------

    def _read(self, name: str) -> DataFrame | None:
        try:
            reader = self.spark.read.schema(self._schemas[name]) if name in self._schemas else self.spark.read
            df = reader.parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        self._schemas[name] = df.schema
        return df

    def _once(self, name: str, make):
        """What ``make`` gives, worked out once for the generations that are visible now."""
        key = (name, *self.gens)
        if key not in self._kept:
            self._kept[key] = make()
        return self._kept[key]

    def _log(self) -> list:
        """All commits in order; one small row for each."""
        try:
            rows = self.spark.read.schema(_COMMIT).json(f"{self.path}/commits").select("*", F.input_file_name().alias("file"))
            return sorted(rows.collect(), key=lambda r: r.file.rsplit("/", 1)[-1])
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def refresh(self) -> None:
        """Read which generations are committed and check the index is ours."""
        log = self._log()
        if not log:
            return
        own = log[-1]
        if (own.model_id, own.model_revision, own.pipeline_version) != (
            self.model_id, self.model_revision, self.pipeline_version,
        ):
            raise IngestError(
                self.path,
                f"its vectors come from {own.model_id} revision {own.model_revision}, version "
                f"{own.pipeline_version} of the pipeline; remove the folder and ingest again",
            )
        gone = {g for r in log for g in r.replaces}
        self.gens = [r.gen for r in log if r.gen not in gone]
        self.dim, self.buckets = own.dim, own.buckets

    @property
    def exists(self) -> bool:
        return bool(self.gens)

    def table(self, name: str) -> DataFrame | None:
        """Committed rows of a table, superseded ones included."""
        df = self._read(name)
        if df is None:
            return None
        rows = df.where(F.col("gen").isin(self.gens))
        return with_embed_text(rows.drop("embed_text")) if name == "children" else rows

    def files(self) -> DataFrame | None:
        """The manifest: the live row of each document."""
        return self.live("files")

    def superseded_by(self, documents: DataFrame) -> DataFrame:
        """The live rows the given documents have now, as pairs (doc_id, dead)."""
        return self.files().join(documents, "doc_id", "left_semi").select("doc_id", F.col("gen").cast("bigint").alias("dead"))

    def dead(self) -> DataFrame | None:
        """Superseded pairs (doc_id, dead), or None while there are none."""

        def make():
            listed = self.table("superseded")
            return None if listed is None or listed.isEmpty() else listed.select("doc_id", "dead")

        return self._once("dead", make)

    def live(self, name: str) -> DataFrame | None:
        rows, dead = self.table(name), self.dead()
        if rows is None or dead is None:
            return rows
        few = self._once("few", lambda: dead.limit(MAX_BROADCAST_PAIRS + 1).count() <= MAX_BROADCAST_PAIRS)
        dead = dead.withColumnRenamed("dead", "gen")
        return rows.join(F.broadcast(dead) if few else dead, ["doc_id", "gen"], "left_anti")

    def postings(self) -> inverse.Postings:
        """Live postings: ranges that hold superseded passages are opened and shortened."""

        def make():
            blocks = self.table("postings").where(F.col("bucket") >= 0)
            made = inverse.Postings(blocks, self.table("ranges"), self.buckets)
            return made if self.dead() is None else inverse.without(made, self.dead(), F.col("gen"))

        return self._once("postings", make)

    def cells(self) -> clustered.Cells:
        """Live vectors by cell."""

        def make():
            made = clustered.Cells(self.table("vectors"), self.table("cells"))
            return made if self.dead() is None else clustered.without(made, self.dead())

        return self._once("cells", make)

    def cache(self) -> Cache | None:
        rows, filters = self.table("embeddings"), self.table("filters")
        return None if rows is None or filters is None or not self.exists else Cache(rows, filters, self.buckets)

    def child_ids(self, doc_id: str) -> DataFrame:
        return self.live("children").where(F.col("doc_id") == doc_id).select("chunk_id")

    # --- thresholds -------------------------------------------------------------------

    def _tau_of(self, reranker: Reranker) -> str:
        """A threshold holds for one encoder and one scorer."""
        return json.dumps([self.model_id, self.model_revision, scorer_name(reranker)])

    def get_tau(self, reranker: Reranker = keyword_overlap) -> float | None:
        rows = self._read("tau")
        if rows is None:
            return None
        mine = rows.where(F.col("tau_key") == self._tau_of(reranker))
        return mine.agg(F.max_by("tau", "seq").alias("tau")).collect()[0].tau

    def set_tau(self, value: float, reranker: Reranker = keyword_overlap) -> None:
        rows = self._read("tau")
        seq = 0 if rows is None else rows.agg(F.max("seq")).collect()[0][0] + 1
        row = [(self._tau_of(reranker), float(value), seq)]
        self.spark.createDataFrame(row, "tau_key string, tau double, seq bigint").coalesce(1).write.mode(
            "append"
        ).parquet(f"{self.path}/tau")

    # --- when files were read -------------------------------------------------------------

    def read_times(self) -> DataFrame | None:
        """(doc_id, file_sha256, size, mtime, seen): what a file of that size and time held when it was read."""
        return self._read("times")

    def keep_times(self, files: DataFrame) -> None:
        """Facts, true whatever becomes of the run, so they belong to no generation."""
        if not files.isEmpty():
            files.select("doc_id", "file_sha256", "size", "mtime", "seen").write.mode("append").parquet(f"{self.path}/times")

    # --- writing ----------------------------------------------------------------------

    def write(self, name: str, rows: DataFrame, gen: int) -> None:
        """Write one table of a generation; lookups stay clustered.

        Embeddings are balanced first; wide tables are written by the tasks that hold them, a file
        a task and bucket, since an exchange would move them whole once more.
        """
        target = f"{self.path}/{name}/gen={gen}"
        key = KEYED.get(name)
        if "bucket" in rows.columns:
            _writer(rows).partitionBy("bucket").parquet(target)
            return
        if key is None:
            _writer(rows).parquet(target)
            return
        bucketed = rows.withColumn("bucket", bucket_of(key, self.buckets))
        if name == "children":
            bucketed = bucketed.drop("embed_text")  # made of two other columns again
        if name == "embeddings":
            bucketed = bucketed.hint("rebalance", "bucket")
        _writer(bucketed.sortWithinPartitions("bucket", key)).partitionBy("bucket").parquet(target)

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def claim(self) -> int:
        """A generation that no other writer has or gets."""
        gen = max(self.gens, default=0) + 1
        while True:
            at, fs = self._hadoop(f"{self.path}/claims/{gen}")
            fs.mkdirs(at.getParent())
            if fs.createNewFile(at):
                return gen
            gen += 1

    def commit(self, gen: int, dim: int, replaces: list[int] | None = None) -> None:
        """Make a claimed generation visible; ``replaces`` are the generations that it rewrites as a whole."""
        known = set(self.gens)
        while True:
            log = self._log()
            gone = {g for r in log for g in r.replaces}
            others = [r.gen for r in log if r.gen not in known and r.gen not in gone]
            if others and replaces is not None:
                raise Conflict(self.path)
            if others:
                self._settle(gen, others)
                known |= set(others)
            row = {
                "gen": gen, "replaces": replaces or [], "dim": dim, "model_id": self.model_id, "model_revision": self.model_revision,
                "pipeline_version": self.pipeline_version, "buckets": self.buckets,
            }
            if self._publish(len(log) + 1, json.dumps(row)):
                return self.refresh()

    def _settle(self, gen: int, others: list[int]) -> None:
        """Rows that others have committed for documents of this generation are superseded by it."""
        mine = self.spark.read.parquet(f"{self.path}/files/gen={gen}").select("doc_id")
        theirs = self._read("files").where(F.col("gen").isin(others)).select("doc_id", F.col("gen").cast("bigint").alias("dead"))
        theirs.join(mine, "doc_id", "left_semi").write.mode("append").parquet(f"{self.path}/superseded/gen={gen}")

    def _publish(self, number: int, text: str) -> bool:
        """Put a commit under its number unless another is there."""
        aside, fs = self._hadoop(f"{self.path}/commits/_{uuid.uuid4().hex}")
        target, _ = self._hadoop(f"{self.path}/commits/{number:012d}.json")
        out = fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(fs.makeQualified(aside), fs.makeQualified(target), options)
            return True
        except Py4JJavaError as error:
            fs.delete(aside, False)
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False

    def check_dim(self, dim: int) -> None:
        if self.dim is not None and self.dim != dim:
            raise IngestError(
                self.path,
                f"it holds vectors of {self.dim} numbers, the encoder makes {dim}; "
                "remove the folder and ingest again",
            )

    def write_postings(self, children: DataFrame, gen: int) -> None:
        """Blocks in buckets of their terms, written once; range rows are beside them and copied to a table of their own."""
        bucket = F.when(F.col("term").isNull(), RANGES).otherwise(bucket_of("term", self.buckets))
        rows = inverse.inverted(children).withColumn("bucket", bucket)
        self.write("postings", rows, gen)
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/postings/gen={gen}")
        self.write("ranges", inverse.split(written.where(F.col("bucket") == RANGES)).ranges, gen)

    def write_cells(self, children: DataFrame, gen: int) -> None:
        """Vectors by cell; numbers of cells are those of the generation alone."""
        blocks, cells = clustered.build(children, first=gen * (clustered.MOST_CELLS + 1))
        _writer(blocks).partitionBy("cell").parquet(f"{self.path}/vectors/gen={gen}")
        self.write("cells", cells, gen)

    def compact(self) -> None:
        """Rewrite the live rows as one generation; earlier ones are no longer read."""
        for _ in range(ATTEMPTS):
            gen, old = self.claim(), list(self.gens)
            for name in ("children", "parents"):
                self.write(name, self.live(name).drop("gen", "bucket"), gen)
            stored = with_embed_text(self.spark.read.parquet(f"{self.path}/children/gen={gen}"))
            self.write_postings(stored, gen)
            self.write_cells(stored, gen)
            self.write("files", self.files().drop("gen"), gen)
            self.write("embeddings", self.table("embeddings").drop("gen", "bucket"), gen)
            hashes = self.spark.read.parquet(f"{self.path}/embeddings/gen={gen}").select("text_hash")
            self.write("filters", filter_rows(hashes, hashes.count(), self.buckets), gen)
            try:
                return self.commit(gen, self.dim, replaces=old)
            except Conflict:
                self.refresh()
        raise Conflict(self.path)

    # --- reading ----------------------------------------------------------------------

    def corpus(self, reranker: Reranker = keyword_overlap) -> Corpus:
        """What a search reads.  A missing index is empty, and reading never creates it."""
        if not self.exists:
            raise IngestError(self.path, "no index here")
        return Corpus(
            self.live("children"), self.live("parents"), postings=self.postings, cells=self.cells,
            tau=self.get_tau(reranker), buckets=self.buckets,
        )


def _writer(rows: DataFrame):
    return rows.write.mode("overwrite").option("compression", "zstd")


def orphans(stored: DataFrame, keep: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored rows of the given documents whose (doc_id, chunk_id) is not kept."""
    return stored.join(documents, "doc_id", "left_semi").join(keep, ["doc_id", "chunk_id"], "left_anti")
