"""Structured Streaming jobs over the same column expressions as the batch operators.

Every job takes a streaming DataFrame, an output folder and a checkpoint folder and returns the
started query. Outputs of ``foreachBatch`` jobs go to one ``batch_id=N`` folder that a replayed batch
overwrites, so a restart never doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sparkwarden.functions.paths import SCAN_EXTENSIONS, PathFilter
from sparkwarden.functions.text import read_text
from sparkwarden.operators.hypotheses import build_hypotheses
from sparkwarden.operators.proposals import build_proposals, signals_of
from sparkwarden.operators.reports import checkpoint_rows
from sparkwarden.operators.rules import BUILTIN_RULES, Rule
from sparkwarden.operators.tasks import eligible
from sparkwarden.operators.trace import hit_events
from sparkwarden.operators.transitions import judge_requests
from sparkwarden.session import cut_lineage

BINARY_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def file_stream(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """New files below a folder as a corpus stream, each once, as Spark's own file source finds them.

    Hidden names are left out and edited files do not come again; ``sources.changes.tree_stream`` has both.
    """
    reader = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    return reader.load(root).select(
        F.lit(root.rstrip("/")).alias("root"), path.alias("file_path"), read_text(F.col("content")).alias("content")
    )


def _start(writer, checkpoint: str, interval: str | None) -> StreamingQuery:
    """Run on an interval, or once over everything that is there."""
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start() if interval else writer.trigger(availableNow=True).start()


def _per_batch(stream: DataFrame, make: Callable[[DataFrame, int], DataFrame], out: str):
    def store(batch: DataFrame, batch_id: int) -> None:
        make(batch, batch_id).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(store)


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """All batches stored so far, with their ``batch_id``."""
    return spark.read.option("mergeSchema", False).parquet(out)


def _now(setting, batch_id: int):
    """A setting that is fixed, or a function of the micro-batch."""
    return setting(batch_id) if callable(setting) else setting


def scan_stream(corpus: DataFrame, out: str, checkpoint: str, as_of, scan_id,
                rules: Iterable[Rule] = BUILTIN_RULES, path_filter=PathFilter(),
                extensions: Iterable[str] = SCAN_EXTENSIONS, interval: str | None = None) -> StreamingQuery:
    """Continuous scan: every arriving file is matched, its proposals are stored with their batch.

    Time, scan id and path filter may be functions of the batch number; then each batch asks for its own.
    """

    def scan(batch: DataFrame, batch_id: int) -> DataFrame:
        files = eligible(batch, extensions, _now(path_filter, batch_id))
        return build_proposals(files, _now(as_of, batch_id), _now(scan_id, batch_id), rules)

    return _start(_per_batch(corpus, scan, out), checkpoint, interval)


def trace_stream(corpus: DataFrame, out: str, checkpoint: str, as_of, scan_id: str,
                 rules: Iterable[Rule] = BUILTIN_RULES, interval: str | None = None) -> StreamingQuery:
    """Append the trace events of every hit as JSON lines."""
    events = hit_events(build_proposals(corpus, as_of, scan_id, rules))
    return _start(events.writeStream.format("json").option("path", out), checkpoint, interval)


def checkpoint_stream(results: DataFrame, out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append the log row of every finished task as a JSON line."""
    return _start(checkpoint_rows(results).writeStream.format("json").option("path", out), checkpoint, interval)


def sighting_stream(proposals: DataFrame, out: str, checkpoint: str,
                    interval: str | None = None) -> StreamingQuery:
    """Continuous upsert, write side: each micro-batch stores only its own proposals.

    ``upsert_backlog(prior, sightings(...))`` gives the current backlog; ``snapshots.fold`` takes batches into
    a snapshot and keeps the pending part short. A batch thus costs its own size, not the backlog's.
    """
    return _start(_per_batch(proposals, lambda batch, _: batch, out), checkpoint, interval)


def sightings(spark: SparkSession, out: str) -> DataFrame:
    """Stored proposals ordered over batches."""
    rows = read_batches(spark, out)
    return rows.withColumn("ord", F.struct("batch_id", "ord"))


def _arrival(columns: Iterable[str]) -> list[Column]:
    """What tells versions of a file apart: time of change and listing, where the stream has them."""
    return [(F.col(c) if c in columns else F.lit(0)).cast("bigint").alias(c) for c in ("modified", "listing")]


def hypothesis_stream(corpus: DataFrame, out: str, checkpoint: str, as_of,
                      rules: Iterable[Rule] = BUILTIN_RULES, interval: str | None = None, compact_every: int = 20) -> StreamingQuery:
    """Keep hypotheses up to date: a file's hypotheses come from that file, so a batch needs no earlier ones.

    ``corpus`` may carry ``modified`` and ``listing``, which order the versions of a file, and ``deleted``. Each batch stores
    the hypotheses of its files and which versions it saw. The newest version replaces what earlier ones gave, in whatever
    order they come; of equally new ones that of the later batch counts, and within a batch the content decides, so a
    replay chooses the same. Every ``compact_every`` batches what still counts is stored as one table.
    """
    spark = corpus.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % compact_every == 0:
            _compact(spark, out, batch_id)
        gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        version = F.struct(*_arrival(batch.columns), F.xxhash64("content").alias("digest"))
        # read once: contents may cost a read of the tree
        files = cut_lineage(batch.select("root", "file_path", F.when(~gone, F.col("content")).alias("content"), version.alias("version")))
        newest = files.groupBy("file_path").agg(F.max("version").alias("newest"))
        older = files.select("file_path", "version").join(newest, "file_path").filter("version < newest").select("file_path", "version").distinct()
        kept = files.join(older, ["file_path", "version"], "left_anti")
        found = signals_of(build_proposals(kept, _now(as_of, batch_id), None, rules))
        # one version that came twice gives its signals twice
        single = found.dropDuplicates(["rule_id", "file_path", "ord"])
        build_hypotheses(single).write.mode("overwrite").parquet(f"{out}/hypotheses/batch_id={batch_id}")
        newest.select("file_path", "newest.modified", "newest.listing").write.mode("overwrite").parquet(f"{out}/files/batch_id={batch_id}")

    return _start(corpus.writeStream.foreachBatch(store), checkpoint, interval)


def _stored(spark: SparkSession, out: str, end: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Files and hypotheses of the last compaction and of the batches since, those before ``end`` if given."""
    try:
        tables = spark.read.parquet(f"{out}/base/files")
        base = tables.filter(F.col("at") < end) if end is not None else tables
        at = base.agg(F.max("at")).first()[0]
    except AnalysisException:
        at = None
    parts = []
    for name in ("files", "hypotheses"):
        rows = read_batches(spark, f"{out}/{name}").filter(F.col("batch_id") >= (at or 0))
        rows = rows.filter(F.col("batch_id") < end) if end is not None else rows
        parts.append(rows if at is None else rows.unionByName(spark.read.parquet(f"{out}/base/{name}/at={at}")))
    return parts[0], parts[1]


def _newest_hypotheses(files: DataFrame, hypotheses: DataFrame) -> tuple[DataFrame, DataFrame]:
    place = F.struct("modified", "listing", "batch_id")
    newest = files.groupBy("file_path").agg(F.max(place).alias("v")).select("file_path", "v.*")
    return newest, hypotheses.join(newest.select("file_path", "batch_id"), ["file_path", "batch_id"])


def _compact(spark: SparkSession, out: str, end: int) -> None:
    """Store what counts of the batches before ``end``; files last, as they make the table count."""
    files, found = _newest_hypotheses(*_stored(spark, out, end))
    for rows, name in ((found, "hypotheses"), (files, "files")):
        rows.write.mode("overwrite").parquet(f"{out}/base/{name}/at={end}")


def latest_hypotheses(spark: SparkSession, out: str) -> DataFrame:
    """The hypotheses of the newest version of every file; reads the last compaction and the batches since."""
    return _newest_hypotheses(*_stored(spark, out))[1].drop("batch_id")


def _by_delay(pending: DataFrame, delay) -> tuple[DataFrame, DataFrame]:
    """Requests that nothing can come before any more, and those that must wait: not older than the newest less the delay."""
    horizon = pending.agg(F.max("ts") - delay).scalar()
    return pending.filter(F.coalesce(F.col("ts") < horizon, F.lit(True))), pending.filter(F.col("ts") >= horizon)


def transition_stream(requests: DataFrame, backlog: DataFrame | Callable[[], DataFrame], out: str, checkpoint: str,
                      interval: str | None = None, compact_every: int = 20, delay: Column | int | None = None) -> StreamingQuery:
    """State machine per proposal id over a request stream.

    Requests apply in (ts, seq, new_state) order within a micro-batch, on top of what earlier batches accepted;
    a request that is illegal by then, late ones included, is logged as refused. ``backlog`` may be a function,
    which every batch asks for the proposals there are by then.

    With a ``delay`` (what can be taken from ``ts``: an interval, or a number) requests wait in a buffer until the newest ``ts``
    seen is more than that later, so requests that arrive out of order by no more are judged as if they had come in order; one that
    comes later still is judged when it comes. Those without a time do not wait. Each batch stores the buffer it starts from with
    its own requests, so a replay finds the same; :func:`outcomes` adds what still waits. Set the delay from the first batch on,
    it may be changed later.

    The states that a batch moved are stored next to its log (``out`` with ``_state``), and every
    ``compact_every`` batches all states so far as one table. A batch reads the last such table and the few
    moves since, never the log; a replay overwrites its own folders only.
    """
    spark = requests.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % compact_every == 0:
            table = _newest(_moves(spark, out, batch_id - compact_every, batch_id, requests.schema))
            table.write.mode("overwrite").parquet(f"{out}_state/all/{batch_id}")
        earlier = _newest(_moves(spark, out, batch_id // compact_every * compact_every, batch_id, requests.schema))
        if delay is not None:
            if batch_id:
                batch = batch.unionByName(_by_delay(_pending(spark, out, batch_id - 1, requests.schema), delay)[1])
            batch.write.mode("overwrite").parquet(f"{out}_state/pending/batch_id={batch_id}")
            batch = _by_delay(_pending(spark, out, batch_id, requests.schema), delay)[0]
        current = _current(backlog, earlier, batch)
        log = f"{out}/batch_id={batch_id}"
        judge_requests(current, batch).write.mode("overwrite").parquet(log)
        judged = spark.read.parquet(log)
        accepted = judged.filter("accepted").groupBy("id").agg(
            F.max_by(F.struct(F.col("new_state").alias("state"), F.col("ts").alias("updated_at")), F.struct("ts", "seq", "new_state")).alias("m")
        )
        accepted.select("id", "m.*", F.lit(batch_id).cast("bigint").alias("batch_id")).write.mode("overwrite").parquet(
            f"{out}_state/moves/{batch_id}"
        )

    return _start(requests.writeStream.foreachBatch(store), checkpoint, interval)


def _moves(spark: SparkSession, out: str, table: int, end: int, requests: StructType) -> DataFrame:
    """The table of all states before batch ``table`` and the moves of the batches from there to ``end``."""
    paths = [f"{out}_state/all/{table}"] * bool(table) + [f"{out}_state/moves/{n}" for n in range(table, end)]
    schema = f"id STRING, state STRING, updated_at {requests['ts'].dataType.simpleString()}, batch_id BIGINT"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _newest(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("id").agg(F.max_by(F.struct("state", "updated_at", "batch_id"), "batch_id").alias("m"))
    return last.select("id", "m.*")


def _pending(spark: SparkSession, out: str, batch_id: int, requests: StructType) -> DataFrame:
    """The buffer and the requests of a batch."""
    return spark.read.schema(requests).parquet(f"{out}_state/pending/batch_id={batch_id}")


def _current(backlog: DataFrame | Callable[[], DataFrame], earlier: DataFrame, batch: DataFrame) -> DataFrame:
    """The states, by now, of the proposals that a batch asks for."""
    now = backlog() if callable(backlog) else backlog
    ids = batch.select("id").distinct()
    return now.select("id", "state", "updated_at").join(ids, "id", "left_semi").join(
        earlier.select("id", F.col("state").alias("_state"), F.col("updated_at").alias("_at")), "id", "left"
    ).select("id", F.coalesce("_state", "state").alias("state"), F.coalesce("_at", "updated_at").alias("updated_at"))


def outcomes(spark: SparkSession, requests: StructType, backlog: DataFrame | Callable[[], DataFrame], out: str, delay: Column | int,
             compact_every: int = 20) -> DataFrame:
    """The log of a :func:`transition_stream` with a delay, and the outcomes of what still waits if nothing else came.

    ``requests`` is the schema of the stream, delay and ``compact_every`` are those of the job. Nothing is stored: the stream may go on.
    All is as of the last complete batch, a batch that broke off does not count; before the first one there is nothing to read.
    """
    last = spark.read.schema("batch_id BIGINT").parquet(f"{out}_state/pending").agg(F.max("batch_id")).first()[0]
    try:
        spark.read.parquet(f"{out}_state/moves/{last}")
    except AnalysisException:
        last -= 1
    waiting = _by_delay(_pending(spark, out, last, requests), delay)[1]
    earlier = _newest(_moves(spark, out, last // compact_every * compact_every, last + 1, requests))
    judged = read_batches(spark, out).filter(F.col("batch_id") <= last).drop("batch_id")
    return judged.unionByName(judge_requests(_current(backlog, earlier, waiting), waiting))


def filtered_stream(corpus: DataFrame, load_filter: Callable[[], PathFilter], out: str, checkpoint: str,
                    extensions: Iterable[str] = SCAN_EXTENSIONS, interval: str | None = None) -> StreamingQuery:
    """File selection that asks for its filter settings again on every micro-batch."""
    writer = _per_batch(corpus, lambda batch, _: eligible(batch, extensions, load_filter()), out)
    return _start(writer, checkpoint, interval)
