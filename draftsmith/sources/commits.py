"""Folders that become visible as a whole, once.

Rows are written to a folder of their own and then named in a manifest, a file
whose creation is atomic.  Readers go by the manifests, so a job that dies before
its manifest leaves nothing to be seen, and one that is run again after it finds
the manifest and adds nothing.

:class:`Runs` builds a log-structured table on this: sorted-in-time runs of a
key-value history, of which ``fanout`` on a level are merged into one on the next,
so that reading costs at most ``fanout`` runs a level, whatever came before.
"""

from __future__ import annotations

import functools
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """The few file-system calls that manifests need, through Spark's own
    file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def create(self, name: str, text: str = "") -> bool:
        """False if the file is there already."""
        from py4j.protocol import Py4JJavaError

        path = self._path(f"{self.root}/{name}")
        if self._fs.exists(path):
            return False
        self._fs.mkdirs(path.getParent())
        try:
            out = self._fs.create(path, False)
        except Py4JJavaError:
            if self._fs.exists(path):  # another attempt was faster
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


def write_once(rows: DataFrame, out: str, job: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), **options) -> bool:
    """Add the rows of ``job`` to ``out`` unless they are there; whether they were
    added.  A job that is tried again, after a failure at any point, adds its rows
    once; the loser of two attempts at a time removes its own."""
    if not re.fullmatch(r"[A-Za-z0-9_.=-]+", job):
        raise ValueError(f"{job!r}: a job is named by letters, digits and _ . = -")
    folder = Folder(rows.sparkSession, out)
    if job in folder.names("_manifest"):
        return False
    attempt = uuid.uuid4().hex
    rows.write.options(**options).partitionBy(*partition_by).format(fmt).save(f"{folder.root}/job={job}/{attempt}")
    if folder.create(f"_manifest/{job}", attempt):
        return True
    folder.drop(f"job={job}/{attempt}")
    return False


def committed(spark: SparkSession, out: str) -> list[str]:
    """Folders of the jobs that have committed."""
    folder = Folder(spark, out)
    jobs = folder.names("_manifest")
    found = spark.read.text([f"{folder.root}/_manifest/{j}" for j in jobs], wholetext=True).select(F.col("_metadata.file_name").alias("job"), "value") if jobs else None
    return sorted(f"{folder.root}/job={r.job}/{r.value}" for r in found.collect()) if found is not None else []


def read_committed(spark: SparkSession, out: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """Rows of all committed jobs, one frame a job (``schema`` includes the columns
    that the folders are partitioned by)."""
    frames = [spark.read.schema(schema).options(**options).format(fmt).load(p) for p in committed(spark, out)]
    return functools.reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


class Runs:
    """A history of ``(key..., value...)`` rows in runs ``level=l/from=a/to=b`` of
    batches ``a`` to ``b``; of each key the newest row counts.

    A run is live when it is committed and not within another committed one, so a
    merge that dies before its manifest changes nothing, and one that dies before
    it has removed what it merged leaves folders that nobody reads.
    """

    def __init__(self, spark: SparkSession, out: str, keys: list[str], fanout: int = 4):
        self.spark, self.folder, self.keys, self.fanout = spark, Folder(spark, out), keys, fanout

    def _all(self) -> list[tuple[int, int, int]]:
        found = [re.fullmatch(r"(\d+)-(\d+)-(\d+)", n) for n in self.folder.names("_manifest")]
        return [tuple(map(int, m.groups())) for m in found if m]

    def live(self) -> list[tuple[int, int, int]]:
        """``(level, from, to)`` of the runs to read, in order of time."""
        runs = self._all()
        inside = lambda r: any(o != r and o[1] <= r[1] and r[2] <= o[2] and (o[2] - o[1], o[0]) > (r[2] - r[1], r[0]) for o in runs)
        return sorted((r for r in runs if not inside(r)), key=lambda r: r[1])

    def _place(self, run: tuple[int, int, int]) -> str:
        return "level={}/from={}/to={}".format(*run)

    def _write(self, rows: DataFrame, run: tuple[int, int, int]) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder.root}/{self._place(run)}")
        self.folder.create("_manifest/{}-{}-{}".format(*run))

    def _read(self, runs: list[tuple[int, int, int]]) -> DataFrame:
        read = self.spark.read.option("basePath", self.folder.root).parquet(*[f"{self.folder.root}/{self._place(r)}" for r in runs])
        values = [c for c in read.columns if c not in (*self.keys, "level", "from", "to")]
        newest = read.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "to").alias("_v"))
        return newest.select(*self.keys, "_v.*")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Add a batch's rows (a batch that is added again replaces its own) and merge
        what has become too many."""
        self._write(rows, (0, batch, batch))
        self.compact()

    def compact(self) -> None:
        level = 0
        while True:
            live = self.live()
            here = [r for r in live if r[0] == level]
            if len(here) >= self.fanout:
                merged = (level + 1, here[0][1], here[-1][2])
                self._write(self._read(here), merged)
            elif not any(r[0] > level for r in live):
                break
            level += 1
        kept = set(self.live())
        for run in self._all():
            if run not in kept:
                self.folder.drop("_manifest/{}-{}-{}".format(*run))
                self.folder.drop(self._place(run))

    def newest(self) -> DataFrame:
        """The newest row of each key."""
        return self._read(self.live())
