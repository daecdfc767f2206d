"""The price store: bars in Parquet, by version and ticker, with upserts that report restated values.

An upsert is one pass over all tickers: incoming rows win every key that they carry, whether they changed or not, and
only the tickers that came are written again, into folders of a new version. A manifest says which version each ticker
is read from. A version counts once its manifest is there, under the next number, which the file system lets one writer
create only; so a reader sees one version, whatever is written meanwhile, and no file is replaced. A writer whose number is
taken commits on top of the other if they had no ticker in common, and merges anew with what the other wrote if they had.
What no manifest names any more stays until ``vacuum``, for those who still read it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bars import SCHEMA, VALUES
from .frames import to_wide

TOLERANCE = 1e-9
#: How often a writer merges anew with what others wrote before it gives up.
ATTEMPTS = 5
#: Tenths of a second that a manifest may take to be written.
WAITS = 300


class ConcurrentWrite(RuntimeError):
    """Others wrote the same tickers each time that this writer tried."""


def conform(frame: DataFrame, order: str | None = None) -> DataFrame:
    """Known columns in their types, tickers in upper case, no row without date, ticker or adjusted close, and of rows
    with one key the last. ``order`` is the column that says which is last; without it, it is the order in which Spark
    reads them."""
    seq = F.col(order) if order else F.monotonically_increasing_id()
    known = [F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA if f.name in frame.columns]
    rows = frame.select(*known, seq.alias("__seq")).withColumn("ticker", F.upper("ticker")).dropna(subset=["date", "ticker", "adj_close"])
    last = Window.partitionBy("ticker", "date").orderBy(F.desc("__seq"))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__seq")


def revisions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Keys in both whose values differ by more than a relative tolerance in any column: old and new adjusted close.
    A value that was or becomes null is no revision."""
    values = [c for c in VALUES if c in stored.columns and c in incoming.columns]

    def differs(c: str):
        old, new = F.col(f"o.{c}").cast("double"), F.col(f"n.{c}").cast("double")
        return F.coalesce(F.abs(new - old) > F.lit(TOLERANCE) * F.greatest(F.abs(old), F.lit(1.0)), F.lit(False))

    both = stored.alias("o").join(incoming.alias("n"), ["ticker", "date"])
    changed = both.where(reduce(lambda a, b: a | b, map(differs, values)))
    return changed.select("ticker", "date", F.col("o.adj_close").alias("old_adj_close"), F.col("n.adj_close").alias("new_adj_close"))


def overlap(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return incoming.join(stored, ["ticker", "date"], "left_semi")


def merge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return stored.join(incoming, ["ticker", "date"], "left_anti").unionByName(incoming, allowMissingColumns=True)


@dataclass(frozen=True)
class Report:
    """What an upsert did. ``rows_written`` is the size of the touched tickers afterwards. ``revisions`` reads a table of its
    own, which is there until ``release``."""

    tickers: int
    rows_in: int
    rows_added: int
    rows_written: int
    revised: int
    revisions: DataFrame
    release: Callable[[], None] = lambda: None


def _escaped(ticker: str) -> str:
    """A ticker as the name of its folder."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{}[]^\x7f" or ord(c) < 32 else c for c in ticker)


class PriceStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = f"{self.root}/bars"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, number: int) -> dict[str, str] | None:
        """The version of each ticker, or nothing while the manifest is being written."""
        path, fs = self._fs(f"{self.root}/manifest/{number:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def _version(self, settled: bool = False) -> tuple[int, dict[str, str]]:
        """The number of the last manifest, 0 if there is none, and the version of each ticker. A reader takes the last one
        that is whole; with ``settled`` what is being written is waited for."""
        folder, fs = self._fs(f"{self.root}/manifest")
        tried = 0
        while True:
            names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
            numbers = sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), reverse=True)
            for number in numbers[:1] if settled else numbers:
                if (of := self._manifest(number)) is not None:
                    return number, of
            if not settled or not numbers:
                return 0, {}
            tried += 1
            if tried > WAITS:
                raise ConcurrentWrite(f"manifest {numbers[0]} was never finished")
            time.sleep(0.1)

    def _commit(self, number: int, of: dict[str, str]) -> bool:
        """Makes the manifest of a number, unless it is there."""
        path, fs = self._fs(f"{self.root}/manifest/{number:012d}.json")
        try:
            stream = fs.create(path, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        stream.write(json.dumps(of, sort_keys=True).encode())
        stream.close()
        return True

    def _read(self, of: dict[str, str]) -> DataFrame:
        """The bars of the tickers of a manifest, or of some of them."""
        if not of:
            return self.spark.createDataFrame([], SCHEMA)
        paths = [f"{self.path}/version={v}/ticker={t}" for t, v in sorted((_escaped(t), v) for t, v in of.items())]
        return self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(*paths).select(SCHEMA.names)

    def exists(self) -> bool:
        return bool(self._version()[1])

    def tickers(self) -> DataFrame:
        return self.spark.createDataFrame([(t,) for t in sorted(self._version()[1])], "ticker string")

    def clear(self) -> None:
        for name in ("bars", "manifest"):
            path, fs = self._fs(f"{self.root}/{name}")
            fs.delete(path, True)
        self.spark.catalog.clearCache()

    def vacuum(self) -> int:
        """Deletes the folders and manifests that the last version doesn't need; how many versions went. Nobody may be reading
        them or writing."""
        number, of = self._version()
        live, gone = {(v, _escaped(t)) for t, v in of.items()}, 0
        folder, fs = self._fs(self.path)
        for version in fs.listStatus(folder) if fs.exists(folder) else ():
            name = version.getPath().getName().removeprefix("version=")
            kept = [t for t in fs.listStatus(version.getPath()) if (name, t.getPath().getName().removeprefix("ticker=")) in live]
            if not kept:
                fs.delete(version.getPath(), True)
                gone += 1
                continue
            names = {t.getPath().getName() for t in kept}
            for ticker in fs.listStatus(version.getPath()):
                if ticker.isDirectory() and ticker.getPath().getName() not in names:
                    fs.delete(ticker.getPath(), True)
        folder, fs = self._fs(f"{self.root}/manifest")
        for file in fs.listStatus(folder) if fs.exists(folder) else ():
            if file.getPath().getName() != f"{number:012d}.json":
                fs.delete(file.getPath(), False)
        return gone

    def scan(self, tickers: Sequence[str] | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
        """Bars of the tickers with ``start <= date < end``, of the version that is there when this is called. Only the
        folders of the tickers are listed, and dates reach the row groups."""
        of = self._version()[1]
        if tickers is not None:
            wanted = {t.upper() for t in tickers}
            of = {t: v for t, v in of.items() if t in wanted}
        frame = self._read(of)
        if tickers is not None:
            frame = frame.where(F.col("ticker").isin(sorted(wanted)))
        if start is not None:
            frame = frame.where(F.col("date") >= F.lit(start))
        if end is not None:
            frame = frame.where(F.col("date") < F.lit(end))
        return frame.select(SCHEMA.names)

    def read(self, *args, **kwargs) -> DataFrame:
        return self.scan(*args, **kwargs).orderBy("ticker", "date")

    def read_wide(self, tickers: Sequence[str], start: date | None = None, end: date | None = None, column: str = "adj_close") -> DataFrame:
        return to_wide(self.scan(tickers, start, end), [t.upper() for t in tickers], column)

    def write(self, frame: DataFrame, ingested_at: datetime | None = None, order: str | None = None) -> Report:
        stamp = ingested_at or datetime.now(timezone.utc).replace(tzinfo=None)
        stage = f"{self.root}/staged-{uuid.uuid4().hex}"
        incoming = conform(frame.drop("ingested_at"), order).withColumn("ingested_at", F.lit(stamp).cast("timestamp_ntz"))
        incoming.write.parquet(f"{stage}/incoming")
        incoming = self.spark.read.parquet(f"{stage}/incoming")
        names = [r.ticker for r in incoming.select("ticker").distinct().collect()]  # the manifest's lines
        try:
            for _ in range(ATTEMPTS):
                report = self._merged(incoming, names, f"{stage}/revisions-{uuid.uuid4().hex}")
                if report is not None:
                    return report
            raise ConcurrentWrite(f"others wrote the same tickers {ATTEMPTS} times")
        finally:
            path, fs = self._fs(f"{stage}/incoming")
            fs.delete(path, True)
            if not fs.listStatus(path.getParent()):
                fs.delete(path.getParent(), True)

    def _merged(self, incoming: DataFrame, names: list[str], revised_path: str) -> Report | None:
        """Merges with the last version and commits the next; nothing if others were first with the same tickers."""
        number, of = self._version(settled=True)
        base = {t: of[t] for t in names if t in of}
        old = self._read(base)
        version = uuid.uuid4().hex
        folder, fs = self._fs(f"{self.path}/version={version}")
        revisions(old, incoming).write.parquet(revised_path)
        revised = self.spark.read.parquet(revised_path)
        held, _ = self._fs(revised_path)

        def release() -> None:
            fs.delete(held, True)
            if fs.exists(held.getParent()) and not fs.listStatus(held.getParent()):
                fs.delete(held.getParent(), True)

        if names:
            merge(old, incoming).select(SCHEMA.names).repartition("ticker").sortWithinPartitions("ticker", "date").write.option("compression", "zstd").partitionBy("ticker").parquet(f"{self.path}/version={version}")
            while not self._commit(number + 1, of | dict.fromkeys(names, version)):
                number, of = self._version(settled=True)
                if {t: of[t] for t in names if t in of} != base:
                    fs.delete(folder, True)
                    release()
                    return None
        written = self._read(dict.fromkeys(names, version))
        counts = incoming.agg(F.count("*"), F.count_distinct("ticker")).first()
        known = overlap(old, incoming).count()
        return Report(counts[1], counts[0], counts[0] - known, written.count(), revised.count(), revised, release)

    def view(self, name: str = "prices") -> None:
        self.scan().createOrReplaceTempView(name)
