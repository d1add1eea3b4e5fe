"""Keyed upsert, run ledger and data version over Parquet snapshots.

A table is a folder of immutable bucket files.  A load merges a batch into the buckets
it touches, writes new files for these and only then records them in the ledger; the
ledger names the files readers use, so a load that dies half way is invisible and a
repeated one changes nothing.

Buckets grow by linear hashing: when they hold too many rows on average, a load splits the
next ones in order, each into itself and one new bucket, and no other file is written.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from levelfield import catalog
from levelfield.sources.shaping import keep_first

STAMPS = ("updated_at", "scraped_at")
LEDGER = (
    "run_id string, target string, status string, at timestamp, "
    "buckets array<struct<bucket:int,n:bigint>>, rows bigint, error string, "
    "width int, skipped bigint, source string, batch bigint"
)


def _now() -> datetime.datetime:
    """The time with its zone, so that hosts of different zones agree."""
    return datetime.datetime.now(datetime.timezone.utc)


class AlreadyRunningError(RuntimeError):
    """A load of the same target is alive."""


class KeyTypeError(ValueError):
    """Keys of a batch that the table's key types cannot hold unchanged."""


def bucket_of(mark: Column, first: int, width: int) -> Column:
    """Bucket of a hashed key when ``width`` buckets have grown out of ``first``."""
    whole = first
    while whole * 2 <= width:
        whole *= 2
    low = F.pmod(mark, F.lit(whole))
    return F.when(low < width - whole, F.pmod(mark, F.lit(2 * whole))).otherwise(low).cast("int")


def split_from(bucket: int, first: int) -> int:
    """The bucket whose rows a new one shares."""
    whole = first
    while whole * 2 <= bucket:
        whole *= 2
    return bucket - whole


def merge_batch(
    current: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    now: Column | None = None,
    protected: Sequence[str] = (),
) -> DataFrame:
    """Insert or update by key.

    Only columns present in the batch change, and a present NULL overwrites.
    Keys and ``protected`` columns never change, the timestamp always does.  One
    row per key is expected in the batch (see ``keep_first``).
    """
    stamp = next((s for s in STAMPS if s in current.columns), None)
    changing = [
        c
        for c in batch.columns
        if c in current.columns and c not in keys and c not in STAMPS and c not in protected
    ]
    new = batch.select(
        *[F.col(k).alias(f"__key_{k}") for k in keys],
        F.struct(F.lit(True).alias("exists"), *changing, *[
            F.lit(None).cast(current.schema[p].dataType).alias(p)
            if p not in batch.columns else F.col(p)
            for p in protected if p in current.columns
        ]).alias("__new"),
    )
    same = [F.col(k) == F.col(f"__key_{k}") for k in keys]
    joined = current.withColumn("__old", F.lit(True)).join(new, same, "full_outer")
    arrived = F.col("__new").isNotNull()
    inserted = F.col("__old").isNull()
    types = {f.name: f.dataType for f in current.schema}

    def value(name: str) -> Column:
        if name in keys:
            return F.coalesce(F.col(name), F.col(f"__key_{name}"))
        if name == stamp:
            return F.when(arrived, now if now is not None else F.current_timestamp()).otherwise(
                F.col(name)
            )
        if name in changing:
            return F.when(arrived, F.col(f"__new.{name}")).otherwise(F.col(name))
        if name in protected:
            return F.when(inserted, F.col(f"__new.{name}")).otherwise(F.col(name))
        return F.col(name)

    return joined.select(*[value(c).cast(types[c]).alias(c) for c in current.columns])


class SnapshotTable:
    """One stored table, in buckets by key, and its ledger under a shared folder.

    A load merges its batch into the buckets it touches and writes those anew; the ledger
    names, for every bucket, the run whose files are current.  Files of other buckets stay
    as they are.  A table begins with ``buckets`` and splits as many as it takes to hold
    ``bucket_rows`` rows each on average, so choose that as about a task's share; a load at most
    doubles their number.
    """

    def __init__(
        self, spark: SparkSession, folder: str, name: str, schema: str, keys, buckets: int = 16,
        bucket_rows: int = 1_000_000,
    ):
        self.spark, self.name, self.keys, self.buckets = spark, name, list(keys), buckets
        self.bucket_rows = bucket_rows
        self.schema = spark.createDataFrame([], schema).schema
        self.root = f"{folder.rstrip('/')}/{name}"
        self.ledger_path = f"{self.root}/_ledger"

    def ledger(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(self.ledger_path)
        except AnalysisException:
            return self.spark.createDataFrame([], LEDGER)

    def _record(self, run_id: str, status: str, **values) -> None:
        at = values.pop("at", None) or _now()
        names = ("buckets", "rows", "error", "width", "skipped", "source", "batch")
        row = (run_id, self.name, status, at, *[values.get(n) for n in names])
        entry = self.spark.createDataFrame([row], LEDGER)
        entry.coalesce(1).write.mode("append").parquet(self.ledger_path)

    def _path(self, path: str):
        """The file system and a path of it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _lock(self):
        """The file system and the path whose existence means that a load is alive."""
        return self._path(f"{self.root}/_loading")

    def start(
        self, now: datetime.datetime | None = None, source: str | None = None, batch: int | None = None
    ) -> str:
        """Open a run, unless one younger than the stale limit is still open.

        The mark is created by the file system, which lets only one of two loads do so.  A
        numbered batch of a source has one writer, so its repetition takes over the mark its
        own broken run has left.
        """
        now = now or _now()
        files, path = self._lock()
        if not files.createNewFile(path):
            age = now.timestamp() - files.getFileStatus(path).getModificationTime() / 1000
            if age < catalog.STALE_RUN_HOURS * 3600 and not self._own(source, batch):
                raise AlreadyRunningError(f"{self.name} is being loaded")
            # Of several loads that find a stale mark, the one that deletes it goes on.
            if not files.delete(path, False) or not files.createNewFile(path):
                raise AlreadyRunningError(f"{self.name} is being loaded")
        run_id = uuid.uuid4().hex
        self._record(run_id, "running", at=now, source=source, batch=batch)
        return run_id

    def _own(self, source: str | None, batch: int | None) -> bool:
        """Whether the run that is open is an earlier attempt at this batch."""
        if source is None:
            return False
        last = self.ledger().agg(F.max_by(F.struct("source", "batch"), "at").alias("w")).first().w
        return last is not None and (last.source, last.batch) == (source, batch)

    def loaded(self, source: str, batch: int) -> bool:
        """Whether this batch of this source is in the table."""
        done = (F.col("status") == "success") & (F.col("source") == source) & (F.col("batch") == batch)
        return not self.ledger().where(done).limit(1).isEmpty()

    def finish(self, run_id: str, status: str, **values) -> None:
        """Close a run and let the next one start."""
        self._record(run_id, status, **values)
        files, path = self._lock()
        files.delete(path, False)

    def _state(self) -> tuple[int, dict[int, tuple[str, int]]]:
        """Number of buckets, and bucket → (run, rows) of its latest successful load."""
        done = self.ledger().where("status = 'success'")
        latest = done.select("run_id", "at", F.inline("buckets")).groupBy("bucket")
        rows = latest.agg(F.max_by(F.struct("run_id", "n"), "at").alias("w")).collect()  # a row a bucket
        width = done.agg(F.max("width")).first()[0] or self.buckets
        return width, {r.bucket: (r.w.run_id, r.w.n) for r in rows}

    def _read(self, runs: dict[int, tuple[str, int]]) -> DataFrame:
        paths = [f"{self.root}/{run}/__bucket={b}" for b, (run, n) in runs.items() if n]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _bucket(self, width: int) -> Column:
        return bucket_of(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), self.buckets, width)

    def current(self) -> DataFrame:
        """The table as of its latest successful loads; empty before the first."""
        return self._read(self._state()[1])

    def conform(self, batch: DataFrame) -> DataFrame:
        """``batch`` in the table's types, further columns left as they are.

        Keys are hashed and compared in the table's type only.  A key that this type cannot
        hold unchanged (a fraction in a whole number, a text that is no date) stops the load.
        """
        types = {f.name: f.dataType for f in self.schema}

        def key(name: str) -> Column:
            given, kind = F.col(name), types[name]
            if batch.schema[name].dataType == kind:
                return given
            fit = given.try_cast(kind)
            same = fit.cast(batch.schema[name].dataType).eqNullSafe(given)
            wrong = F.raise_error(F.concat(F.lit(f"key {name} does not fit {kind.simpleString()}: "), given.cast("string")))
            return F.when(same, fit).otherwise(wrong.cast(kind))

        return batch.withColumns(
            {c: key(c) if c in self.keys else F.col(c).cast(types[c]) for c in batch.columns if c in types}
        )

    def upsert(
        self,
        batch: DataFrame,
        order: Sequence[str] = (),
        now: Column | None = None,
        protected: Sequence[str] = (),
        source: str | None = None,
        number: int | None = None,
    ) -> int:
        """Merge a batch into the buckets it touches; the rows of the table afterwards.

        Rows without a whole key belong nowhere; the ledger says how many were ``skipped``.
        A batch ``number`` of a ``source`` is loaded once: the ledger's entry that names the
        new files also names the batch, so a repetition finds it there or finds nothing.
        """
        run_id = self.start(source=source, batch=number)
        told = {"source": source, "batch": number}
        try:
            if source is not None and self.loaded(source, number):
                width, before = self._state()
                rows = sum(n for _, n in before.values())
                self.finish(run_id, "repeated", rows=rows, **told)
                return rows
            typed = self.conform(batch)
            missing = F.col(self.keys[0]).isNull()
            for k in self.keys[1:]:
                missing = missing | F.col(k).isNull()
            single = keep_first(typed.where(~missing), self.keys, list(order) or self.keys)
            width, before = self._state()
            counts = typed.groupBy(F.when(~missing, self._bucket(width)).alias("b")).agg(F.count("*").alias("n")).collect()
            touched = {r.b for r in counts if r.b is not None}
            skipped = sum(r.n for r in counts if r.b is None)
            arriving = sum(r.n for r in counts if r.b is not None)
            rows = sum(n for _, n in before.values())
            wanted = -(-(rows + arriving) // self.bucket_rows)
            grown = max(width, min(2 * width, wanted))
            touched |= {b for new in range(width, grown) if (b := split_from(new, self.buckets)) < width}
            old = self._read({b: before[b] for b in sorted(touched) if b in before})
            merged = merge_batch(old, single, self.keys, now, protected)
            target = f"{self.root}/{run_id}"
            merged.withColumn("__bucket", self._bucket(grown)).repartition("__bucket").write.partitionBy(
                "__bucket").parquet(target)
            written = self.spark.read.parquet(target).groupBy("__bucket").count().collect() if touched else []
            allowed = touched | set(range(width, grown))
            if stray := [r[0] for r in written if r[0] not in allowed]:
                raise RuntimeError(f"rows of buckets {stray[:5]}, which the load does not replace")
        except Exception as error:
            self.finish(run_id, "failed", error=str(error), **told)
            if "does not fit" in str(error):
                raise KeyTypeError(str(error).split("\n")[0]) from error
            raise
        sizes = {r[0]: r[1] for r in written}
        replaced = [(b, sizes.get(b, 0)) for b in sorted(allowed if touched else ())]
        total = sum(({b: n for b, (_, n) in before.items()} | dict(replaced)).values())
        self.finish(
            run_id, "success", rows=total, buckets=replaced, width=grown, skipped=skipped, **told
        )
        return total

    def tidy(self, keep_hours: float = 24.0, now: datetime.datetime | None = None) -> int:
        """Delete files no reader needs; how many folders went.

        Needed are the current files of every bucket, and for ``keep_hours`` whatever else was
        written, for readers that began earlier.  The ledger's many small files become one:
        the whole is written first and the parts go afterwards, so a reader never misses an
        entry, and one it meets twice says the same.
        """
        run_id = self.start(now)
        gone = 0
        try:
            limit = ((now or _now()).timestamp() - keep_hours * 3600) * 1000
            needed = {(run, b) for b, (run, n) in self._state()[1].items() if n}
            files, root = self._path(self.root)
            for run in files.listStatus(root):
                name = run.getPath().getName()
                if not run.isDirectory() or name.startswith("_"):
                    continue
                buckets = [b for b in files.listStatus(run.getPath()) if b.isDirectory()]
                left = 0
                for bucket in buckets:
                    number = int(bucket.getPath().getName().split("=")[1])
                    if (name, number) in needed or bucket.getModificationTime() > limit:
                        left += 1
                    else:
                        gone += bool(files.delete(bucket.getPath(), True))
                if not left and run.getModificationTime() <= limit:
                    files.delete(run.getPath(), True)
            _, path = self._path(self.ledger_path)
            parts = [f.getPath() for f in files.listStatus(path) if f.getPath().getName().startswith("part-")]
            self.ledger().dropDuplicates(["run_id", "status"]).coalesce(1).write.mode("append").parquet(self.ledger_path)
            for part in parts:
                files.delete(part, False)
        except Exception as error:
            self.finish(run_id, "failed", error=str(error))
            raise
        self.finish(run_id, "tidied")
        return gone


# Table-specific loads: columns, keys and what a load must not overwrite.
TARGETS = {
    "player_market_value": (
        "entity_id string, valuation_date date, market_value double, club_at_time string, "
        "age_at_time int, scraped_at timestamp", ("entity_id", "valuation_date"), ()),
    "player_transfers": (
        "entity_id string, transfer_date date, club_from string, club_to string, fee double, "
        "kind string, market_value double, season string, scraped_at timestamp",
        ("entity_id", "transfer_date", "club_from", "club_to"), ()),
    "player_profile": (
        "entity_id string, birth_date date, age int, position string, nationality string, "
        "height int, foot string, joined_on date, contract_until date, scraped_at timestamp",
        ("entity_id",), ()),
    "team_identity": (
        "league string, season string, team string, external_id string, club_name string, "
        "updated_at timestamp", ("league", "season", "team"), ()),
    "player_id_mapping": (
        "entity_id string, external_id string, match_method string, match_confidence double, "
        "reviewed boolean, updated_at timestamp", ("entity_id",), ("reviewed",)),
}


def load_target(
    spark: SparkSession, folder: str, target: str, batch: DataFrame, now: Column | None = None,
    buckets: int = 16,
) -> SnapshotTable:
    """Load ``batch`` into one of TARGETS and return its table."""
    schema, keys, protected = TARGETS[target]
    table = SnapshotTable(spark, folder, target, schema, keys, buckets)
    table.upsert(batch, now=now, protected=protected)
    return table


def run_states(
    ledger: DataFrame, now: Column, stale_hours: int = catalog.STALE_RUN_HOURS
) -> DataFrame:
    """Latest state per run; a run open longer than the limit is stale."""
    runs = ledger.groupBy("run_id").agg(
        F.min("at").alias("started_at"),
        F.max(F.when(F.col("status") != "running", F.col("at"))).alias("finished_at"),
        F.max_by("status", F.struct("at", (F.col("status") != "running").alias("closed"))).alias(
            "status"
        ),
        F.max("rows").alias("rows"),
    )
    limit = now - F.make_dt_interval(hours=F.lit(stale_hours))
    stale = (F.col("status") == "running") & (F.col("started_at") <= limit)
    return runs.withColumn("state", F.when(stale, "stale").otherwise(F.col("status")))


def last_runs(states: DataFrame, limit: int = 5) -> DataFrame:
    return states.orderBy(F.col("started_at").desc(), "run_id").limit(max(1, limit))


def data_version(states: DataFrame) -> DataFrame:
    """When the latest successful run finished, or the no-data marker."""
    latest = F.max(F.when(F.col("status") == "success", F.col("finished_at")))
    text = F.date_format(latest, "yyyy-MM-dd'T'HH:mm:ss")
    return states.agg(F.coalesce(text, F.lit(catalog.NO_DATA_VERSION)).alias("version"))


def review_queue(mappings: DataFrame) -> DataFrame:
    """Matches found but not confirmed by a person, least certain first."""
    waiting = (~F.col("reviewed")) & F.col("external_id").isNotNull()
    return mappings.where(waiting).orderBy("match_confidence", "entity_id")
