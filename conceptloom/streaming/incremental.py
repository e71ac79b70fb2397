"""Keep a lattice current while objects arrive.

The new concepts of a micro-batch are intersections of old ones with new rows,
and only concepts whose extent gains an object change at all.  Every batch is
therefore one walk over just those concepts; nothing else is recomputed.

State is three folders of tables, one part per batch number.  A batch that is
run again overwrites its own parts, so every object counts once.  After every few
batches rows and concepts are compacted: a snapshot of all batches so far takes
the place of their parts, which are then removed, so the number of files that a
batch reads is bounded and old versions of a concept are read once.  A snapshot
counts only once it is complete; batches that it holds are not taken in again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptloom.functions import masks as M
from conceptloom.operators.context import Context, from_masks
from conceptloom.operators.enumerate import build_lattice
from conceptloom.operators.lattice import Lattice, node_type


class LatticeState:
    """Lattice over a fixed attribute list, kept in ``folder`` (shared storage)."""

    def __init__(self, spark: SparkSession, folder: str, attributes: Sequence[str], method: str = "frontier", compact: int = 8):
        self.spark, self.folder, self.method, self.compact = spark, folder.rstrip("/"), method, compact
        self.attributes = tuple(attributes)
        self.k = M.word_count(len(self.attributes))
        object_fields = [T.StructField("obj_id", T.LongType()), T.StructField("name", T.StringType())]
        self._objects = T.StructType(
            object_fields + [T.StructField(c, T.LongType()) for c in M.names("m", self.k)]
        )
        self._rows = T.StructType(
            [T.StructField(c, T.LongType()) for c in [*M.names("m", self.k), "n"]]
        )

    def _read(self, kind: str, schema: T.StructType) -> DataFrame:
        part = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], part)  # nothing has arrived yet
        return self.spark.read.schema(part).parquet(f"{self.folder}/{kind}")

    def _children(self, folder: str) -> list[str]:
        """Names of what a folder of the state holds."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{folder}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{folder}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _upto(self) -> int:
        """The last batch of the newest complete snapshot, -1 without one."""
        done = [p for p in self._children("snapshot") if "_SUCCESS" in self._children(f"snapshot/{p}/nodes")]
        return max((int(p.removeprefix("upto=")) for p in done), default=-1)

    def _versions(self, kind: str, schema: T.StructType) -> DataFrame:
        """The parts of ``kind`` with their batch numbers, those of the newest snapshot as its last batch."""
        upto = self._upto()
        parts = self._read(kind, schema).where(F.col("batch") > upto)
        if upto < 0:
            return parts
        held = self.spark.read.schema(schema).parquet(f"{self.folder}/snapshot/upto={upto}/{kind}")
        return held.withColumn("batch", F.lit(upto).cast("bigint")).unionByName(parts)

    def _compact(self, batch: int) -> None:
        """Replace all parts up to ``batch`` by a snapshot; nodes are written last."""
        before, keys = self._upto(), M.names("m", self.k)
        target = f"{self.folder}/snapshot/upto={batch}"
        rows = self._versions("rows", self._rows).groupBy(*keys).agg(F.sum("n").alias("n"))
        rows.write.mode("overwrite").parquet(f"{target}/rows")
        self._newest().write.mode("overwrite").parquet(f"{target}/nodes")
        for kind in ("rows", "nodes"):
            for part in self._children(kind):
                if part.startswith("batch=") and int(part.removeprefix("batch=")) <= batch:
                    self._remove(f"{kind}/{part}")
        if before >= 0:
            self._remove(f"snapshot/upto={before}")

    def _newest(self) -> DataFrame:
        """The newest version of every concept."""
        keys = M.names("i", self.k)
        newest = F.max_by(F.struct("n_extent", "lower"), "batch").alias("v")
        return self._versions("nodes", node_type(self.k)).groupBy(*keys).agg(newest).select(*keys, "v.n_extent", "v.lower")

    def _write(self, df: DataFrame, kind: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={batch}")

    def append(self, objects: DataFrame, batch: int) -> None:
        """Take in a batch of objects (``obj_id``, ``name``, ``m*``)."""
        upto = self._upto()
        if batch <= upto:
            return  # run again after its snapshot was complete
        self._write(objects.select(*[F.col(f.name).cast(f.dataType) for f in self._objects]), "objects", batch)
        keys = M.names("m", self.k)
        arrived = self._read("objects", self._objects).where(F.col("batch") == batch)
        self._write(arrived.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "rows", batch)
        rows = (
            self._versions("rows", self._rows).where(F.col("batch") <= batch)
            .groupBy(*keys).agg(F.sum("n").alias("n"), (F.max("batch") == batch).alias("fresh"))
        )
        if not rows.where("fresh").limit(1).count():
            return
        lattice = build_lattice(self.context(), self.method, rows=rows)
        self._write(lattice.nodes, "nodes", batch)
        if batch - upto >= self.compact:
            self._compact(batch)

    def context(self) -> Context:
        return from_masks(self._read("objects", self._objects).drop("batch"), self.attributes)

    def lattice(self) -> Lattice:
        """The current lattice: the newest version of every concept; a single concept before the first object."""
        nodes = self._newest()
        found = nodes.count()
        return Lattice(self.context(), nodes, found) if found else build_lattice(self.context(), self.method)


def follow(objects: DataFrame, state: LatticeState, checkpoint: str, **trigger):
    """Start a streaming query that appends the object stream to ``state``."""
    writer = objects.writeStream.foreachBatch(lambda df, batch: state.append(df, batch))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
