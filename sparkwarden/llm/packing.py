"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import batch_of, whole_text
from sparkwarden.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    """Permitted sequence lengths, what a sequence costs, and tokens per independent shard.

    A sequence costs its length, a fixed ``overhead``, and for attention its length again for every ``attention``
    tokens that it holds: longer ones save overhead and hold long pieces, shorter ones save attention.
    """

    capacities: tuple[int, ...] = (512, 1024, 2048, 4096)
    overhead: int = 64
    attention: int = 16384
    shard_tokens: int = 1 << 20

    def cost(self, capacity: int) -> int:
        return capacity + self.overhead + capacity * capacity // self.attention

    def least(self, used: int) -> int:
        """The smallest permitted length that holds so many tokens."""
        return min(c for c in self.capacities if c >= used)


def word_length() -> Column:
    """Tokens of a text: its words, and one to end it."""
    return (F.regexp_count(whole_text(), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def pack(lengths: list[int], settings: Settings = Settings()) -> list[tuple[int, list[int]]]:
    """Bins (capacity, piece numbers) for pieces of 1 to the largest capacity tokens.

    Longest pieces first, equal ones in the order given. A piece goes to the open bin that it leaves least
    room in. Where none has room, a bin is opened, whose size is chosen in several ways: by what the pieces yet to
    come can fill it with (``foreseen``), or one size for all pieces that it holds. At the end every
    bin is cut down to the smallest permitted length that holds its contents, and the way of the least total cost is
    taken, of equal ones the first. So several sizes never cost more than any one of them.
    """
    sizes = sorted(settings.capacities)
    ways = [best_fit(lengths, settings, None), *(best_fit(lengths, settings, c) for c in sizes)]
    return min(ways, key=lambda bins: sum(settings.cost(c) for c, _ in bins))


def best_fit(lengths: list[int], settings: Settings, size: int | None) -> list[tuple[int, list[int]]]:
    """Best fit, longest pieces first, opening bins of one size, or of the least cost a foreseen token where it is None."""
    sizes = sorted(settings.capacities)
    most = sizes[-1]
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    counts = [0] * (most + 1)
    for n in lengths:
        counts[n] += 1
    left = sum(1 << n for n, count in enumerate(counts) if count)  # bit n: some piece of length n is yet to come
    bins: list[list[int]] = []
    used: list[int] = []
    open_with: list[list[int]] = [[] for _ in range(most + 1)]  # bins by their free room
    rooms = 0  # bit r: some bin has room r
    for i in order:
        need = lengths[i]
        counts[need] -= 1
        if not counts[need]:
            left ^= 1 << need
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            at = open_with[room].pop()
            if not open_with[room]:
                rooms ^= 1 << room
        else:
            if size is not None:
                room = max(size, settings.least(need))
            else:
                full = {c: foreseen(c, need, counts, left) for c in sizes if c >= need}
                room = min(full, key=lambda c: (settings.cost(settings.least(full[c])) / full[c], -c))
            at = len(bins)
            bins.append([])
            used.append(0)
        bins[at].append(i)
        used[at] += need
        room -= need
        if room:
            open_with[room].append(at)
            rooms |= 1 << room
    return [(settings.least(u), b) for u, b in zip(used, bins)]


def foreseen(capacity: int, need: int, counts: list[int], left: int) -> int:
    """How full a bin gets that holds a piece of ``need`` tokens and then the longest fitting pieces yet to come."""
    room = capacity - need
    while room:
        left &= (2 << room) - 1
        if not left:
            break
        longest = left.bit_length() - 1
        room -= min(counts[longest], room // longest) * longest
        left &= (1 << longest) - 1
    return capacity - room


def pieces(docs: DataFrame, length: Column, settings: Settings) -> DataFrame:
    """(row, doc_id, start, length, n_tokens) of every document, cut where it exceeds the largest capacity.

    ``row`` numbers the rows of ``docs``; the table is stored, so numbers and shards stay as they are.
    """
    most = max(settings.capacities)
    rows = cut_lineage(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), length.alias("n_tokens"))
    )
    starts = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / most)))
    cut = rows.filter("n_tokens > 0").select("*", starts.alias("part")).withColumn("start", F.col("part").cast("long") * most)
    return cut.withColumn("length", F.least(F.col("n_tokens") - F.col("start"), F.lit(most)).cast("long"))


def packed(docs: DataFrame, length: Column | None = None, settings: Settings = Settings()) -> DataFrame:
    """(bin_id, capacity, used, offset, doc_id, start, length), one row for each piece of a document.

    ``offset`` is the piece's place in the bin, ``start`` its place in the document. Documents are dealt over
    shards of about ``shard_tokens`` tokens, each packed on its own, so a shard's work does not grow with
    the corpus; at most a few bins per shard are less full for it. Only lengths are moved, never texts.
    Without ``length`` a text counts its words and one more; a null text counts as empty and so
    takes one token. A document of length 0, null or less has no piece. Repeated rows are packed as often as they
    occur, a null doc_id stays null, an empty table gives an empty result; other columns are not read.
    """
    cut = pieces(docs, length if length is not None else word_length(), settings)
    total = cut.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-total // settings.shard_tokens))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("row", "start"), F.lit(shards)))
    gathered = dealt.groupBy("shard").agg(F.collect_list(F.struct("length", "row", "start", "doc_id")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, shard in enumerate(batch.column(0).to_pylist()):
                flat = batch.column(1).slice(k, 1).flatten()
                yield _bins(shard, flat, settings)

    schema = "bin_id long, capacity int, used int, offset int, doc_id long, start long, length int"
    return gathered.mapInArrow(run, schema)


def _bins(shard: int, rows: pa.StructArray, settings: Settings) -> pa.RecordBatch:
    length, row, start = (rows.field(f).to_numpy() for f in ("length", "row", "start"))
    order = np.lexsort((start, row))  # whatever order the rows came in
    made = pack(length[order].tolist(), settings)
    sizes = [len(b) for _, b in made]
    at = order[np.array([i for _, b in made for i in b], np.int64)]
    filled = length[at]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    before = np.cumsum(filled) - filled
    return batch_of(
        [
            ("bin_id", np.repeat(np.arange(len(made)), sizes) + (shard << 24), pa.int64()),
            ("capacity", np.repeat([c for c, _ in made], sizes), pa.int32()),
            ("used", np.repeat(np.add.reduceat(filled, first), sizes), pa.int32()),
            ("offset", before - np.repeat(before[first], sizes), pa.int32()),
            ("doc_id", rows.field("doc_id").take(pa.array(at)), None),
            ("start", start[at], pa.int64()),
            ("length", filled, pa.int32()),
        ]
    )
