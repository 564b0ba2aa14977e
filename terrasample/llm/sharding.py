"""Sharding by size-tiered compaction, with DataFrame functions only.

``append`` writes what arrives as it arrives: every task writes its rows as one small immutable shard, a file, without a
shuffle and without looking at ids. ``compact`` plans on the manifest alone, a row per shard: shards below half the target
are put in tiers by size (each ``fanout`` times the one below), a tier's shards are laid end to end and cut every
``target_bytes``, and a run of at least ``fanout`` shards, or of half the target, becomes one new shard. Data of merged
shards are read and written once, ``WAVE`` files at a time; all others stay where they are. So files have half to one and a
half times the target and of each tier at most ``fanout - 1`` smaller ones are left over.

A version is a manifest and a pointer to it. The pointer is written aside and put in its place by one call that fails if
the place is taken (a hard link on local disks, a rename that does not replace elsewhere), so of two writers one
commits and the other gets an error, readers see the old version or the new one, and a step that dies leaves only files
that no version names. ``read`` opens the files that the version names and no others; ``sweep`` removes single files that the
newest version does not name.

Ids of any type, null, repeated or sparse ones make no difference. Null texts count 0 bytes. Repeated rows are kept. An
empty table makes a version without shards. All columns are stored, inside one struct, so none can clash with the store's
own; what is appended later must have the columns of the first.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasample.llm._scratch import filesystem, only, remove
from terrasample.operators.ordering import running_total

#: Files that one job of a compaction or read names.
WAVE = 20_000
_MANIFEST = "shard string, rows long, bytes long, stored long, made long"


def create_once(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that appears whole and at once; FileExistsError if it is there already."""
    jvm = spark.sparkContext._jvm
    fs, final = filesystem(spark, path)
    fs.mkdirs(final.getParent())
    aside = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(text.encode())
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            java = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(java(final), java(aside))
        else:
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            options = spark.sparkContext._gateway.new_array(kind, 1)
            options[0] = kind.NONE
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(aside, final, options)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            raise FileExistsError(path) from None
        raise
    finally:
        if fs.exists(aside):
            fs.delete(aside, False)


@dataclass
class Store:
    """A folder of shards (``data/<write>/<file>``), manifests and the pointers to them (``versions/v<number>``)."""

    spark: SparkSession
    root: str
    id_col: str = "doc_id"
    text_col: str = "text"
    base_bytes: int = 1 << 20
    target_bytes: int = 128 << 20
    fanout: int = 4

    # --- versions ---
    def version(self) -> int:
        """The newest version, 0 if there is none."""
        return max(self._versions(), default=0)

    def _versions(self) -> list[int]:
        fs, p = filesystem(self.spark, f"{self.root}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]

    def _pointer(self, version: int) -> dict:
        fs, p = filesystem(self.spark, f"{self.root}/versions/v{version:08d}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """One row per shard of a version, the newest by default: rows, bytes of text, stored bytes, and the version
        that wrote it."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/{self._pointer(version)['manifest']}")

    def schema(self) -> T.StructType | None:
        version = self.version()
        return T.StructType.fromJson(self._pointer(version)["schema"]) if version else None

    def commit(self, shards: DataFrame, after: int, schema: T.StructType) -> int:
        """Make ``shards`` version ``after + 1``; fails if another writer was faster."""
        name = uuid.uuid4().hex
        shards.select(*[c.split()[0] for c in _MANIFEST.split(", ")]).write.parquet(f"{self.root}/manifests/{name}")
        try:
            create_once(self.spark, f"{self.root}/versions/v{after + 1:08d}", json.dumps({"manifest": name, "schema": schema.jsonValue()}))
        except FileExistsError:
            remove(self.spark, f"{self.root}/manifests/{name}")
            raise RuntimeError(f"version {after + 1} is already there: another writer committed first") from None
        return after + 1

    # --- data ---
    def _open(self, shards: list[str], schema: T.StructType) -> DataFrame:
        stored = T.StructType([T.StructField("doc", schema), T.StructField("n_bytes", T.LongType())])
        rows = self.spark.read.schema(stored).parquet(*[f"{self.root}/data/{s}" for s in shards])
        return rows.select("doc", "n_bytes", F.substring_index("_metadata.file_path", "/", -2).alias("shard"), F.col("_metadata.file_size").alias("stored"))

    def read(self, version: int | None = None) -> DataFrame:
        """The documents of a version, in one struct ``doc``, with their ``n_bytes``, ``shard`` and its ``stored`` bytes."""
        version = self.version() if version is None else version
        names = [r["shard"] for r in self.manifest(version).select("shard").toLocalIterator()]
        schema = T.StructType.fromJson(self._pointer(version)["schema"]) if version else T.StructType()
        if not names:
            return self.spark.createDataFrame([], T.StructType([T.StructField("doc", schema)])).selectExpr("doc", "0L AS n_bytes", "'' AS shard", "0L AS stored")
        out = None
        for a in range(0, len(names), WAVE):
            part = self._open(names[a : a + WAVE], schema)
            out = part if out is None else out.unionAll(part)
        return out

    def _write(self, rows: DataFrame, schema: T.StructType, made: int) -> DataFrame:
        """Write ``doc, n_bytes`` rows, each task's as one shard, and list what was written."""
        run = uuid.uuid4().hex
        rows.select("doc", "n_bytes").write.option("compression", "zstd").parquet(f"{self.root}/data/{run}")
        listed = self._open([run], schema).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_bytes").alias("bytes"), F.max("stored").alias("stored"))
        return listed.withColumn("made", F.lit(made).cast("long"))

    def append(self, docs: DataFrame) -> int:
        """Write ``docs`` as they come and commit; returns the version."""
        only(docs, self.id_col, self.text_col)
        after, known = self.version(), self.schema()
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
        if known and [(f.name, f.dataType.simpleString()) for f in known] != [(f.name, f.dataType.simpleString()) for f in schema]:
            raise ValueError(f"the store has the columns {known.simpleString()}, not {schema.simpleString()}")
        size = F.coalesce(F.octet_length(F.col(f"`{self.text_col}`")), F.lit(0)).cast("long")
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), size.alias("n_bytes"))
        return self.commit(self.manifest(after).unionByName(self._write(rows, schema, after + 1)), after, schema)

    def tier(self, size: Column) -> Column:
        out, edge = F.lit(0), self.base_bytes
        while edge < self.target_bytes // 2:
            out = out + F.when(size >= edge, 1).otherwise(0)
            edge *= self.fanout
        return out

    def planned(self, shards: DataFrame) -> DataFrame:
        """``shard, tier, run`` of the shards that are to be merged. No task has more than about the root of a tier's
        shards."""
        small = shards.where(F.col("stored") < self.target_bytes // 2).select("shard", "stored", self.tier(F.col("stored")).alias("tier"))
        parts = max(1, math.isqrt(small.count()))
        laid = running_total(small, ["tier"], ["shard"], F.pmod(F.xxhash64("shard"), F.lit(parts)), "stored", "upto")
        laid = laid.withColumn("run", F.floor((F.col("upto") - F.col("stored")) / F.lit(self.target_bytes)).cast("long"))
        runs = laid.groupBy("tier", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("stored").alias("of_run"))
        whole = runs.where((F.col("n") >= self.fanout) | ((F.col("n") > 1) & (F.col("of_run") * 2 >= self.target_bytes)))
        return laid.join(whole.select("tier", "run", "n"), ["tier", "run"]).select("shard", "tier", "run", "n")

    def _waves(self, runs: list) -> Iterator[list]:
        """Runs in groups of at most ``WAVE`` files, or one run."""
        wave, files = [], 0
        for r in runs:
            if wave and files + r["n"] > WAVE:
                yield wave
                wave, files = [], 0
            wave.append(r)
            files += r["n"]
        if wave:
            yield wave

    def compact(self) -> int:
        """Merge runs of similar size and commit; returns the version."""
        after, schema = self.version(), self.schema() or T.StructType()
        old = self.manifest(after)
        plan_at = f"{self.root}/aside-{uuid.uuid4().hex}"
        self.planned(old).write.parquet(plan_at)
        plan = self.spark.read.schema("shard string, tier int, run long, n long").parquet(plan_at)
        new = old.join(plan.select("shard"), "shard", "left_anti")
        rows = 0
        for wave in self._waves(plan.select("tier", "run", "n").distinct().orderBy("tier", "run").collect()):  # a row per new shard
            first, last = ((r["tier"], r["run"]) for r in (wave[0], wave[-1]))
            at = F.struct(F.col("tier").alias("a"), F.col("run").alias("b"))
            lo, hi = (F.struct(F.lit(t).alias("a"), F.lit(r).cast("long").alias("b")) for t, r in (first, last))
            merged = [(r["shard"], (r["tier"], r["run"])) for r in plan.where((at >= lo) & (at <= hi)).collect()]
            number = {(r["tier"], r["run"]): i for i, r in enumerate(wave)}
            into = self.spark.createDataFrame([(s, number[k]) for s, k in merged], "shard string, into int")
            docs = self._open([s for s, _ in merged], schema).join(F.broadcast(into), "shard")  # at most WAVE files, or those of one run
            written = self._write(docs.repartitionById(len(wave), "into"), schema, after + 1)
            new = new.unionByName(written)
        aside = f"{self.root}/aside-{uuid.uuid4().hex}"
        new.write.parquet(aside)
        new = self.spark.read.schema(_MANIFEST).parquet(aside)
        before, rows = (m.agg(F.sum("rows"), F.sum("bytes")).first() for m in (old, new))
        if before != rows:
            raise RuntimeError(f"compaction read {before} and wrote {rows}")
        return self.commit(new, after, schema)

    def sweep(self) -> None:
        """Remove what the newest version does not name. Other readers must have moved on to it."""
        newest = self.version()
        if not newest:
            return
        live = {r["shard"] for r in self.manifest().select("shard").toLocalIterator()}
        runs = {s.split("/")[0] for s in live}
        kept = {f"v{newest:08d}", self._pointer(newest)["manifest"]}
        fs, data = filesystem(self.spark, f"{self.root}/data")
        for run in fs.listStatus(data) if fs.exists(data) else []:
            name = run.getPath().getName()
            if name not in runs:
                fs.delete(run.getPath(), True)
                continue
            for file in fs.listStatus(run.getPath()):
                if file.getPath().getName().startswith("part-") and f"{name}/{file.getPath().getName()}" not in live:
                    fs.delete(file.getPath(), False)
        for folder in ("versions", "manifests"):
            for s in fs.listStatus(filesystem(self.spark, f"{self.root}/{folder}")[1]):
                if s.getPath().getName() not in kept and not s.getPath().getName().startswith("."):
                    fs.delete(s.getPath(), True)
        for s in fs.listStatus(filesystem(self.spark, self.root)[1]):
            if s.getPath().getName().startswith("aside-"):
                fs.delete(s.getPath(), True)


def shard(docs: DataFrame, root: str, **options) -> DataFrame:
    """Append ``docs`` to the store at ``root``, compact it, and return what is in it then: the id and bytes of each
    stored document with its ``shard`` (a file below ``root``/data), the version, and the shard's rows and bytes."""
    store = Store(docs.sparkSession, root, **options)
    store.append(docs)
    version = store.compact()
    store.sweep()
    sizes = store.manifest().select("shard", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    id_col = store.id_col
    rows = store.read().select(F.col(f"doc.`{id_col}`").alias(id_col), "n_bytes", "shard") if store.schema().fields else docs.select(id_col).limit(0)
    return rows.withColumn("version", F.lit(version).cast("long")).join(sizes, "shard").select(id_col, "n_bytes", "shard", "version", "shard_rows", "shard_bytes")


def read_back(docs: DataFrame, root: str, **options) -> DataFrame:
    """Shard ``docs`` and read the store back: of each stored document the id, ``n_bytes`` and ``text_md5``, the version,
    whether its shard has the rows and bytes that the manifest lists, and whether the shard ``fits``: at most twice the
    target, or as it arrived."""
    shard(docs, root, **options)
    store = Store(docs.sparkSession, root, **options)
    rows, version = store.read(), store.version()
    there = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows_there"), F.sum("n_bytes").alias("bytes_there"), F.max("stored").alias("stored_there"))
    listed = (F.col("rows") == F.col("rows_there")) & (F.col("bytes") == F.col("bytes_there")) & (F.col("stored") == F.col("stored_there"))
    fits = (F.col("stored") <= 2 * store.target_bytes) | (F.col("made") < version)
    shards = store.manifest().join(there, "shard").select("shard", listed.alias("listed"), fits.alias("fits"))
    text = F.col(f"doc.`{store.text_col}`")
    out = rows.select(F.col(f"doc.`{store.id_col}`").alias(store.id_col), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.md5(text).alias("text_md5"), "shard")
    return out.join(shards, "shard").select(store.id_col, "n_bytes", "text_md5", F.lit(version).cast("long").alias("version"), "listed", "fits")
