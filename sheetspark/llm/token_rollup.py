"""Token counts by source, language and tokenizer version, kept up by signed deltas.

A batch of changes (insert, revise, delete) becomes signed sums by group: what the
ledger had of the documents it touches is taken back, what they have now is added.
Totals are additive, so a batch adds its sums to them and nothing is counted anew. A
delete or a revision takes back what the ledger says, not what the change says.

The ledger has a row for each document and tokenizer version, dealt by hash over
``buckets``. A batch appends what it changes to the buckets that it touches, deletes
included, and no more; a version's manifest tells for each bucket the files that hold
now: a base and the changes since, of which the last of a document holds. When the
changes of a bucket outnumber its base they become its new base, and when there are many
small ones they become one; so what is written, over time, is a few times what is
changed, however large the ledger. To take back what held, a batch reads the touched
buckets; one of few documents finds them by their row groups, as files are in order of
doc_id. Versions that no kept manifest names are deleted.

A batch is written under a name of its own attempt and published by one rename to
the next version's name, which fails if that is there. Of two writers that read the
same version one is first; the other reads anew and tries again, so what it takes
back is what holds then. A version bears its batch's id, and a batch whose id is
there changes nothing when it comes again, by a retry or a second writer. A writer
that dies leaves no trace in the totals. The rename must be one step, as it is in file
systems; in an object store, where it isn't, writers need a lock.

Of several changes of a document and version in one batch the last by ``seq`` holds
(then the largest count); an insert of what is there counts as a revision, a
revision of what isn't as an insert, a delete of what isn't as nothing. A null in
doc_id, source, lang or version is a value like others; a null count is 0. Groups
that come to nothing are not told. An empty batch commits and changes nothing. Null
and empty texts have no tokens; a very long text is one call of the library; other
columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetspark.llm.common import materialized, texts_of, with_arrow

GROUP = ["source", "lang", "version"]
KEY = ["doc_id", "version"]
ENTRIES = "doc_id long, source string, lang string, version string, n_tokens long, bucket int"
ROWS = "doc_id long, source string, lang string, version string, n_tokens long, gone boolean, at long, bucket int"
TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"
MANIFEST = "bucket int, base long, base_rows long, deltas array<long>, delta_rows long"
CHANGES = ["op", "doc_id", "source", "lang", "version", "n_tokens", "seq"]
BUCKETS = 32
#: Changes of a bucket that are kept apart at most; versions that readers may still hold; documents that a batch looks up by their ids.
MOST_DELTAS, KEPT_VERSIONS, FEW_DOCS = 16, 8, 1000


@dataclass
class Bucket:
    """Which versions' files hold for a bucket."""

    base: int = 0
    base_rows: int = 0
    deltas: list[int] = field(default_factory=list)
    delta_rows: int = 0

    @property
    def versions(self) -> list[int]:
        return [v for v in (self.base, *self.deltas) if v]

_engines: dict = {}


def engine(ranks_path: str):
    """One encoder of the tiktoken library a worker process."""
    if ranks_path not in _engines:
        import public_tokenizers
        import tiktoken

        from sheetspark.llm.byte_bpe import load_ranks

        _engines[ranks_path] = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
    return _engines[ranks_path]


def counted(docs: DataFrame, ranks_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens: the tokens of each text."""

    def make():
        encode = engine(ranks_path).encode_ordinary

        def call(column: pa.Array) -> list[pa.Array]:
            return [pa.array([len(encode(t)) for t in texts_of(column)], pa.int64())]

        return call

    return with_arrow(docs, [text], [T.StructField("n_tokens", T.LongType())], make, keep)


def _context(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    uri = jvm.org.apache.hadoop.fs.Path(path).toUri()
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, spark.sparkContext._jsc.hadoopConfiguration())


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def same(a: str, b: str, columns: list[str]) -> Column:
    """Whether the columns of two aliased tables agree; null is a value."""
    return reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


class Rollup:
    """The ledger and totals under a shared folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _found(self, pattern: str) -> list:
        return list(_context(self.spark, self.root).util().globStatus(_path(self.spark, f"{self.root}/{pattern}")) or [])

    def committed(self, batch_id: str) -> bool:
        name = batch_id.encode().hex()
        return bool(self._found(f"batches/{name}") or self._found(f"versions/*/batch-{name}"))

    def head(self) -> int:
        """The newest version, 0 if there is none."""
        return max((int(f.getPath().getName()) for f in self._found("versions/*")), default=0)

    def at(self, version: int) -> str:
        return f"{self.root}/versions/{version:012d}"

    def manifest(self, version: int) -> dict[int, Bucket]:
        """The files of each bucket: a row for each bucket."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.at(version)}/manifest").collect() if version else []
        return {r["bucket"]: Bucket(r["base"], r["base_rows"], list(r["deltas"]), r["delta_rows"]) for r in rows}

    def _rows(self, files: dict[int, list[int]]) -> DataFrame:
        """The rows that versions wrote to buckets, whether they still hold or not."""
        paths = [f"{self.at(v)}/entries/bucket={k}" for k, versions in files.items() for v in versions]
        if not paths:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(f"{ROWS}, slot int").parquet(*paths).withColumn("bucket", F.col("slot")).select(*_names(ROWS))

    def entries(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """What holds of each document and tokenizer version, in some buckets or in all."""
        version = self.head() if version is None else version
        now = {k: b for k, b in self.manifest(version).items() if buckets is None or k in buckets}
        # a base alone has each document once, and none that is gone
        settled = self._rows({k: b.versions for k, b in now.items() if not b.deltas})
        changed = {k: b.versions for k, b in now.items() if b.deltas}
        rows = settled.unionByName(latest_rows(self._rows(changed))) if changed else settled
        return rows.where("not gone").select(*_names(ENTRIES))

    def totals(self, version: int | None = None) -> DataFrame:
        version = self.head() if version is None else version
        if not version:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(f"{self.at(version)}/totals").where("n_docs <> 0 or n_tokens <> 0")

    def latest(self, changes: DataFrame) -> DataFrame:
        """The change that holds for each document and version, with its bucket."""
        last = F.max(F.struct("seq", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "op", "source", "lang")).alias("c")
        rows = changes.select(*CHANGES).groupBy(*KEY).agg(last).select(*KEY, "c.op", "c.source", "c.lang", "c.n_tokens")
        return rows.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(doc_id, version), {self.buckets}) as int)"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch of changes (op, doc_id, source, lang, version, n_tokens, seq); False if it is there already."""
        if self.committed(batch_id):
            return False
        base = f"{self.root}/attempts/{batch_id.encode().hex()}-{uuid.uuid4().hex}"
        self.latest(changes).write.parquet(f"{base}/changes")
        new = self.spark.read.parquet(f"{base}/changes")
        while not self.committed(batch_id):
            version = self.head()
            attempt = f"{base}/{version + 1}"
            self._write(attempt, version, new)
            context = _context(self.spark, self.root)
            context.mkdir(_path(self.spark, f"{attempt}/batch-{batch_id.encode().hex()}"), _folder(self.spark), True)
            if self._publish(attempt, version + 1):
                context.delete(_path(self.spark, base), True)
                self.vacuum()
                return True
        return False

    def _write(self, attempt: str, version: int, new: DataFrame) -> None:
        """The changes, what becomes of full buckets, the manifest and the totals, as they follow on a version."""
        now = self.manifest(version)
        touched = {r["bucket"]: r["count"] for r in new.groupBy("bucket").count().collect()}  # at most all buckets
        rows = new.select("doc_id", "source", "lang", "version", "n_tokens", (F.col("op") == "delete").alias("gone"), F.lit(version + 1).cast("long").alias("at"), "bucket")
        was = {k: now.get(k, Bucket()) for k in touched}
        full = {k for k, b in was.items() if b.delta_rows + touched[k] > b.base_rows}
        many = {k for k, b in was.items() if k not in full and len(b.deltas) >= MOST_DELTAS}
        # of full buckets all comes together, of those with many changes only the changes
        older = {k: was[k].versions if k in full else was[k].deltas for k in full | many}
        out = rows
        if any(older.values()):
            together, base = F.col("bucket").isin(*older), F.col("bucket").isin(*full) if full else F.lit(False)
            merged = latest_rows(self._rows(older).unionByName(rows.where(together)))
            out = rows.where(~together).unionByName(merged.withColumn("at", F.lit(version + 1).cast("long")))
            out = out.where(~(base & F.col("gone")))
        elif full:
            out = rows.where(~F.col("gone"))  # all buckets are new
        # a file has its bucket too, as files of several versions are read by their own names
        out = out.withColumn("slot", F.col("bucket")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "doc_id")
        out.write.partitionBy("bucket").parquet(f"{attempt}/entries")
        counts = {r["bucket"]: r["count"] for r in self.spark.read.schema(ROWS).parquet(f"{attempt}/entries").groupBy("bucket").count().collect()} if touched else {}
        for k, b in was.items():
            n = counts.get(k, 0)
            if k in full:
                now[k] = Bucket(version + 1 if n else 0, n)
            elif k in many:
                now[k] = Bucket(b.base, b.base_rows, [version + 1] if n else [], n)
            else:
                now[k] = Bucket(b.base, b.base_rows, [*b.deltas, version + 1], b.delta_rows + n)
        listed = [(k, b.base, b.base_rows, b.deltas, b.delta_rows) for k, b in now.items()]
        self.spark.createDataFrame(listed, MANIFEST).coalesce(1).write.parquet(f"{attempt}/manifest")
        # the signed sums of the batch: what held of its documents goes, what they have now comes
        held = self._rows({k: b.versions for k, b in was.items()})
        if sum(touched.values()) <= FEW_DOCS:
            ids = [r["doc_id"] for r in new.select("doc_id").distinct().collect()]
            held = held.where(F.col("doc_id").isin(*[i for i in ids if i is not None]) | (F.col("doc_id").isNull() if None in ids else F.lit(False)))
        held = held.alias("o").join(new.select(*KEY).alias("n"), same("o", "n", KEY), "left_semi")
        back = latest_rows(held).where("not gone").select(*GROUP, "n_tokens", F.lit(-1).alias("sign"))
        signed = back.unionByName(new.where("op <> 'delete'").select(*GROUP, "n_tokens", F.lit(1).alias("sign")))
        delta = signed.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        sums = self.totals(version).unionByName(delta).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.coalesce(1).write.parquet(f"{attempt}/totals")  # a row for each group

    def vacuum(self, keep: int = KEPT_VERSIONS) -> None:
        """Deletes files that none of the last ``keep`` versions names; that a batch was committed stays known."""
        context, head = _context(self.spark, self.root), self.head()
        old = [v for f in self._found("versions/*") if (v := int(f.getPath().getName())) <= head - keep]
        if not old:
            return
        named = {(v, k) for version in range(max(1, head - keep + 1), head + 1) for k, b in self.manifest(version).items() for v in b.versions}
        for v in old:
            for f in self._found(f"versions/{v:012d}/batch-*"):
                context.mkdir(_path(self.spark, f"{self.root}/batches/{f.getPath().getName()[6:]}"), _folder(self.spark), True)
            own = self._found(f"versions/{v:012d}/entries/bucket=*")
            left = [f for f in own if (v, int(f.getPath().getName().split("=")[1])) in named]
            for f in [f for f in own if f not in left] if left else self._found(f"versions/{v:012d}"):
                context.delete(f.getPath(), True)

    def _publish(self, attempt: str, version: int) -> bool:
        from py4j.protocol import Py4JJavaError

        context = _context(self.spark, self.root)
        context.mkdir(_path(self.spark, f"{self.root}/versions"), _folder(self.spark), True)
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(_path(self.spark, attempt), _path(self.spark, self.at(version)), options)
        except Py4JJavaError:
            if self.head() >= version:  # another writer was first
                return False
            raise
        return True


def latest_rows(rows: DataFrame) -> DataFrame:
    """Of the rows of a document and tokenizer version the last written."""
    last = F.max_by(F.struct("source", "lang", "n_tokens", "gone"), "at").alias("l")
    return rows.groupBy(*KEY, "bucket").agg(last, F.max("at").alias("at")).select(*KEY, "bucket", "at", "l.*").select(*_names(ROWS))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _folder(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault()


def inserts(docs: DataFrame, version: str, op: str = "insert") -> DataFrame:
    return docs.select(F.lit(op).alias("op"), F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.lit(version).alias("version"), "n_tokens", F.lit(0).alias("seq"))


def corpus_totals(docs: DataFrame, ranks_path: str, version: str, root: str) -> DataFrame:
    """Totals of a corpus by four batches, one of which comes twice, and what they were without its exact copies.

    All documents come in; each is revised to count an end token too; exact copies but for the one of
    the smallest doc_id go (then the totals are those of distinct texts: n_distinct_docs and
    n_distinct_tokens); and they come back (n_docs and n_tokens, of all documents).
    """
    rollup = Rollup(docs.sparkSession, root)
    rollup.commit("load", inserts(counted(docs, ranks_path, keep=["doc_id", "source", "lang"]), version))
    rollup.commit("ends", inserts(rollup.entries().withColumn("n_tokens", F.col("n_tokens") + 1), version, "revise"))
    texts = docs.where("text is not null")
    firsts = texts.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    copies = texts.select("doc_id").distinct().alias("d").join(firsts.alias("f"), same("d", "f", ["doc_id"]), "left_anti").alias("c")
    copies = rollup.entries().alias("e").join(copies, same("e", "c", ["doc_id"]), "left_semi")
    copies = materialized(copies, "rollup-copies")
    rollup.commit("copies", inserts(copies, version, "delete"))
    distinct = rollup.totals(rollup.head()).withColumnsRenamed({"n_docs": "n_distinct_docs", "n_tokens": "n_distinct_tokens"}).alias("d")
    rollup.commit("copies", inserts(copies, version, "delete"))  # a retry, which changes nothing
    rollup.commit("back", inserts(copies, version))
    both = rollup.totals().alias("t").join(distinct, same("t", "d", GROUP), "left")
    return both.select(*[F.col(f"t.{c}") for c in [*GROUP, "n_docs", "n_tokens"]], *[F.coalesce(F.col(f"d.{c}"), F.lit(0)).alias(c) for c in ("n_distinct_docs", "n_distinct_tokens")])
