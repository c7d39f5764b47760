"""Importance resampling towards a target distribution, ranked by parallel sorting by regular sampling."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import batch_of, byte_list, pieces
from sparkwarden.session import cut_lineage

#: Words over UTF-8 bytes after lower-casing: digits, letters and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BETWEEN = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    """``percent`` of the documents with ``least_words`` or more are drawn.

    ``runs`` bounds sorted runs, segments and, squared, the samples that choose the splitters; a row of a run has
    about 40 bytes, so a run of 100 million rows still sorts within a task's memory and spill.
    """

    longest: int = 2
    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: int = 7
    runs: int = 1000


# ---- features -------------------------------------------------------------------------------------


def feature_hashes(text: bytes, longest: int, size: int = 1 << 18) -> Iterator[tuple[int, np.ndarray]]:
    """(words, checksums of the runs of 1 to ``longest`` words that end there) for one piece of the text after the other.

    The checksum of a run is that of the run before its last word carried on, so runs are never built as strings
    and pieces hand on nothing but checksums.
    """
    tails: list[int | None] = [None] * longest
    for piece in pieces(text, BETWEEN, size):
        words = WORD.findall(piece.lower())
        if not words:
            continue
        spaced = [b" " + w for w in words]
        runs: list[int | None] = list(map(crc32, words))
        found, ends = list(runs), [runs[-1]]
        for k in range(1, longest):
            before = [tails[k - 1], *runs[:-1]]
            # only at the start of a text there is no run to carry on
            missing = next((i for i, x in enumerate(before) if x is not None), len(before))
            carried = list(map(crc32, spaced[missing:], before[missing:]))
            found += carried
            runs = [None] * missing + carried
            ends.append(runs[-1])
        tails = ends
        yield len(words), np.array(found, np.uint32)


def bucket_counts(texts: DataFrame, column: str, settings: Settings) -> np.ndarray:
    """How many features of all texts fall in each bucket; a task sends one row a bucket at most."""
    longest, buckets = settings.longest, settings.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in byte_list(batch.column(0)):
                for _, found in feature_hashes(text, longest):
                    counts += np.bincount(found % buckets, minlength=buckets)
        held = np.flatnonzero(counts)
        yield batch_of([("bucket", held, pa.int32()), ("n", counts[held], pa.int64())])

    totals = texts.select(F.col(column).cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    # bounded by the number of buckets
    for row in totals.collect():
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, each count one larger."""
    size, every, wanted = len(raw), float(raw.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (every + size) / ((s + 1.0) * (wanted + size)))) for s, t in zip(raw.tolist(), target.tolist())],
        np.int64,
    )


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of a document in thousandths, from a hash of its id."""
    told = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(told.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, settings: Settings) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs(doc_id, text)``."""
    longest, buckets, seed = settings.longest, settings.buckets, settings.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_list(batch.column(1))):
                words = features = total = 0
                for n, found in feature_hashes(text, longest):
                    words, features, total = words + n, features + len(found), total + int(gain[found % buckets].sum())
                weight = total // features if features else 0
                rows.append((words, features, weight, weight + noise(doc_id, seed)))
            names = ("n_words", "n_features", "weight", "score")
            yield batch_of([("doc_id", batch.column(0), None), *[(n, list(c), pa.int64()) for n, c in zip(names, zip(*rows) if rows else [[]] * 4)]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long, score long"
    )


# ---- ranks by regular sampling --------------------------------------------------------------------

ROW = "doc_id long, n_features long, weight long, score long, at long, run int"


def sorted_runs(rows: DataFrame, most: int) -> DataFrame:
    """Each partition sorted on its own, highest score first; ``run`` and ``place`` tell where a row stands.

    The runs are stored: ``run`` and ``place`` make keys distinct, so a key that many rows share can be split between segments.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.append_column("place", pa.array(np.arange(seen, seen + batch.num_rows)))
            seen += batch.num_rows

    local = rows.coalesce(most).select(
        "doc_id", "n_features", "weight", "score", F.coalesce("doc_id", F.lit(LAST)).alias("at"), F.spark_partition_id().alias("run")
    )
    return cut_lineage(local.sortWithinPartitions(F.desc("score"), "at", "n_features").mapInArrow(place, f"{ROW}, place long"))


def regular_splitters(runs: DataFrame, lengths: dict[int, int]) -> list[tuple]:
    """The keys that cut all rows into as many segments as there are runs, chosen from regular samples of each run.

    A sample stands for the rows up to the next one of its run, so a segment is at most twice its share. Samples are collected:
    at most the square of the number of runs, a million with the default settings.
    """
    spark, count = runs.sparkSession, len(lengths)
    steps = spark.createDataFrame([(r, -(-n // count)) for r, n in lengths.items()], "run int, step long")
    key = [(-F.col("score")).alias("score"), "at", "n_features", "run", "place"]
    # one row for each run
    samples = runs.join(F.broadcast(steps), "run").filter(F.col("place") % F.col("step") == 0).select(*key, "step").collect()
    samples.sort()
    reached, out, share = 0, [], sum(lengths.values()) / count
    for row in samples:
        if out is not None and len(out) < count - 1 and reached >= share * (len(out) + 1):
            out.append(tuple(row)[:5])
        reached += row.step
    return out


def with_segments(runs: DataFrame, splitters: list[tuple]) -> DataFrame:
    """Each row with its ``segment``: how many splitters its key has reached."""
    scores = np.array([s[0] for s in splitters], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = -batch.column("score").to_numpy()
            low, high = np.searchsorted(scores, score, "left"), np.searchsorted(scores, score, "right")
            segment = high.astype(np.int32)
            # where a splitter has the same score, the rest of the key decides
            for i in np.flatnonzero(low < high).tolist():
                key = (int(score[i]), *(batch.column(c)[i].as_py() for c in ("at", "n_features", "run", "place")))
                segment[i] = bisect_right(splitters, key, int(low[i]), int(high[i]))
            yield batch.append_column("segment", pa.array(segment))

    return runs.mapInArrow(deal, f"{ROW}, place long, segment int")


def drawn_ranks(rows: DataFrame, percent: int, most: int) -> DataFrame:
    """``rows`` with ``rank``: the highest ``percent`` per cent by score, ties to the smaller doc_id, numbered from 1, the others null.

    Parallel sorting by regular sampling: runs are sorted in place and stored, their regular samples give the splitters, rows
    go to segments and merge there, and the counts of the segments before give exact ranks. Segments wholly beyond
    the last rank drawn are not exchanged.
    """
    spark = rows.sparkSession
    runs = sorted_runs(rows, most)
    # one row for each run, and below for each segment
    lengths = {r.run: r.n for r in runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = percent * sum(lengths.values()) // 100
    dealt = with_segments(runs, regular_splitters(runs, lengths) if lengths else [])
    counts = sorted((r.segment, r.n) for r in dealt.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect())
    before, reached = [], 0
    for segment, n in counts:
        if reached < wanted:
            before.append((segment, reached))
        reached += n
    columns = ["doc_id", "n_features", "weight", "score"]
    last = before[-1][0] if before else -1
    offsets = spark.createDataFrame(before, "segment int, reached long")
    order = Window.partitionBy("segment").orderBy(F.desc("score"), "at", "n_features", "run", "place")
    ranked = (
        dealt.filter(F.col("segment") <= last)
        .withColumn("here", F.row_number().over(order))
        .join(F.broadcast(offsets), "segment")
        .select(*columns, (F.col("reached") + F.col("here")).alias("rank"))
    )
    return ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).unionByName(
        dealt.filter(F.col("segment") > last).select(*columns, F.lit(None).cast("long").alias("rank"))
    )


def resampled(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs(doc_id, text)``, drawn towards ``target(text)``.

    Features are runs of words, hashed to buckets. ``weight`` is the floored mean over a document's features of how
    much likelier their buckets are in the target; ``score`` adds Gumbel noise, so the highest scores are a
    sample without replacement by these weights. ``rank`` numbers the drawn documents and is null for the others.

    Null and empty texts have no features, weight 0 and too few words to be drawn. A null doc_id is hashed as an empty
    one and comes last in ties; rows of one id tie by their number of features, and equal rows take consecutive ranks.
    Empty tables give an empty result or, as a target, counts of zero. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, "text", settings), bucket_counts(target, "text", settings))
    rows = cut_lineage(scored(docs, gain, settings))
    enough = F.col("n_words") >= settings.least_words
    ranked = drawn_ranks(rows.filter(enough), settings.percent, settings.runs)
    return ranked.unionByName(rows.filter(~enough).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
