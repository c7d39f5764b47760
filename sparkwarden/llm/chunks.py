"""Removal of repeated passages by content-defined chunks: a gear rolling hash cuts, digests find the copies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import batch_of, byte_list, free_name, slices
from sparkwarden.session import cut_lineage

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Settings:
    """Where to cut, and how long a repeated run must be.

    ``mean_words``: words between cuts on average. ``unit_words``: least words of a chunk, which reaches from
    a cut to the first one that far on, so that chunks overlap and where they begin and end depends on nearby
    text alone. ``run_words``: least words of a run of repeated chunks that counts as a repeated passage.
    ``forced_words``: step of cuts where twice as many words have none. ``window``: bytes that the gear hash looks back (a power of two). ``solid``: bytes between cuts on average
    in text without white space.
    """

    mean_words: int = 4
    unit_words: int = 10
    run_words: int = 20
    forced_words: int = 16
    window: int = 8
    solid: int = 256
    seed: int = 9


# ---- cuts -----------------------------------------------------------------------------------------


def gear_hash(data: np.ndarray, settings: Settings) -> np.ndarray:
    """At each byte the gear hash of the ``window`` bytes up to it: ``h = 2 h + gear[byte]``, with doubling steps."""
    gear = np.random.default_rng(settings.seed).integers(0, 1 << 32, 256, dtype=np.uint32)
    value = gear[data]
    reach = 1
    while reach < settings.window:
        shifted = np.zeros_like(value)
        shifted[reach:] = value[:-reach] << np.uint32(reach)
        value = value + shifted
        reach *= 2
    return value * np.uint32(2654435769)


def cuts(data: np.ndarray, settings: Settings) -> np.ndarray:
    """Byte offsets where a chunk may begin: the start, words by their gear hash, places in long solid text, the end.

    A cut depends on the ``window`` bytes before it only, but for the regular steps. It lies at the first byte of a word, or of a
    character in text without white space.
    """
    if not len(data):
        return np.zeros(1, np.int64)
    value, space = gear_hash(data, settings), SPACE[data]
    begins = np.flatnonzero(space[:-1] & ~space[1:])
    chosen = value[begins] < (1 << 32) // settings.mean_words
    # text that repeats itself may never meet the condition: cut it at regular steps from the last cut on
    edges = np.concatenate([[0], np.flatnonzero(chosen), [len(begins)]])
    for i in np.flatnonzero(np.diff(edges) > 2 * settings.forced_words).tolist():
        chosen[edges[i] + settings.forced_words : edges[i + 1] : settings.forced_words] = True
    words = begins[chosen]
    lead = (data[1:] & 0xC0) != 0x80
    solid = np.flatnonzero(lead & ~space[:-1] & ~space[1:] & (value[:-1] < (1 << 32) // settings.solid))
    # only in solid text: no white space within the last ``solid`` bytes
    last = np.maximum.accumulate(np.where(space, np.arange(len(data)), -1))
    solid = solid[solid - last[solid] >= settings.solid]
    return np.unique(np.concatenate([[0], words + 1, solid + 1, [len(data)]]))


def units(text: bytes, settings: Settings) -> tuple[list[int], list[int], list[int], list[int]]:
    """Digest, first and end code point, and words of every chunk of a text.

    A chunk ends before the white space that precedes its last cut. A text with fewer words than ``unit_words``
    has none. Solid text counts a word for every 8 bytes.
    """
    data = np.frombuffer(text, np.uint8)
    at = cuts(data, settings)
    if len(at) < 2:
        return [], [], [], []
    space = SPACE[data]
    starts = ~space & np.concatenate([[True], space[:-1]])
    place = np.arange(len(data))
    begun = np.maximum.accumulate(np.where(starts, place, 0))
    # each byte's share of words: one at a word's first byte, one more at every 8th byte beyond the 32nd
    counted = np.concatenate([[0], np.cumsum(starts | ((place - begun > 32) & ((place - begun) % 8 == 0) & ~space))])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    # the end of the last word before each place
    ends = np.maximum.accumulate(np.concatenate([[0], np.where(space, 0, place + 1)]))
    to = np.searchsorted(counted[at], counted[at[:-1]] + settings.unit_words)
    whole = to < len(at)
    begin, end = at[:-1][whole], ends[at[to[whole]]]
    digest = xxhash.xxh3_64_intdigest
    digests = [digest(text[a:b]) for a, b in zip(begin.tolist(), end.tolist())]
    return digests, points[begin].tolist(), points[end].tolist(), (counted[end] - counted[begin]).tolist()


def chunk_table(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, tag, start, end, words, digest) for every chunk; texts stay where they are.

    ``tag`` tells texts of one doc_id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 2):
                rows, digests, starts, ends, words = [], [], [], [], []
                for i, text in enumerate(texts):
                    d, s, e, w = units(text, settings)
                    digests += d
                    starts += s
                    ends += e
                    words += w
                    rows.append(np.full(len(d), i))
                mine = pa.array(np.concatenate(rows))
                yield batch_of(
                    [
                        ("doc_id", part.column(0).take(mine), None),
                        ("tag", part.column(1).take(mine), None),
                        ("start", starts, pa.int32()),
                        ("end", ends, pa.int32()),
                        ("words", words, pa.int32()),
                        ("digest", np.array(digests, np.uint64).view(np.int64), pa.int64()),
                    ]
                )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _tag().alias("tag"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, tag int, start int, end int, words int, digest long")


def _tag():
    return F.hash(F.coalesce(F.col("text").cast("string"), F.lit("")))


# ---- repeated passages ----------------------------------------------------------------------------


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks whose digest occurs more than once, with the smallest doc_id that each occurs in.

    Counts and smallest ids combine before the shuffle, so a passage that a third of all documents share
    costs a row per task; the join that marks its occurrences has one row per digest on the other side, which
    lets Spark split a hot digest over tasks. A null doc_id counts as the smallest number.
    """
    known = chunks.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    found = known.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return known.join(found.filter("n > 1").select("digest", "first_doc"), "digest")


def passages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, tag, start, end, drop, first_doc) for each repeated passage of each text.

    A passage is a run of overlapping or touching repeated chunks with ``run_words`` words or more. Where
    ``drop`` is true equal chunks stand earlier (smaller doc_id, then smaller tag, then earlier in the text), the first of
    them in ``first_doc``; otherwise this is the one that stays. Code points, end exclusive.

    Chunks are gathered by text, so a group is never larger than the chunks of one text, however many rows have its id.
    """
    fields = ["start", "end", "words", "digest", "first_doc", "elsewhere"]
    known = docs.filter("text IS NOT NULL")
    rows = repeated_chunks(chunk_table(known, settings))
    if _shared_ids(known):
        rows = _told_apart(cut_lineage(rows))
    else:
        rows = rows.withColumn("elsewhere", F.lit(False))
    grouped = cut_lineage(rows.groupBy("doc_id", "tag").agg(F.collect_list(F.struct(*fields)).alias("rows")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2)
            flat = rows.flatten()
            doc, tag = (np.repeat(batch.column(k).to_numpy(), rows.value_lengths().to_numpy()) for k in (0, 1))
            values = [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]
            ids, tags, starts, ends, drops, firsts = runs(doc, tag, *values, settings)
            yield batch_of(
                [
                    ("doc_id", pa.array(ids, mask=ids == NO_ID), None), ("tag", tags, pa.int32()), ("start", starts, pa.int32()),
                    ("end", ends, pa.int32()), ("drop", drops, pa.bool_()), ("first_doc", pa.array(firsts, mask=firsts == NO_ID), None),
                ]
            )

    return grouped.mapInArrow(run, "doc_id long, tag int, start int, end int, drop boolean, first_doc long")


def _shared_ids(docs: DataFrame) -> bool:
    """Whether an id has several rows; only ids and hashes of texts are looked at."""
    return not docs.groupBy(F.col("doc_id").cast("long")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def _told_apart(rows: DataFrame) -> DataFrame:
    """Repeated chunks where an id may have several texts: each row once, and whether the first is in another text of the id.

    Equal rows, and the smallest tag of each digest in its first document, combine before the shuffle.
    """
    own = rows.filter("doc_id = first_doc").groupBy("digest").agg(F.min("tag").alias("first_tag"))
    return (
        rows.distinct()
        .join(own, "digest", "left")
        .withColumn("elsewhere", F.coalesce((F.col("doc_id") == F.col("first_doc")) & (F.col("tag") != F.col("first_tag")), F.lit(False)))
    )


def runs(doc, tag, start, end, words, digest, first, elsewhere, settings: Settings) -> list[np.ndarray]:
    """Join the repeated chunks of each text, those to drop and those to keep apart, into passages.

    Of equal chunks in the first document the earliest is kept. Columns: doc, tag, start, end, drop, first.
    """
    order = np.lexsort((start, digest, tag, doc))
    doc, tag, start, end, words, digest, first, elsewhere = (x[order] for x in (doc, tag, start, end, words, digest, first, elsewhere))
    before = np.zeros(len(doc), bool)
    before[1:] = (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (digest[1:] == digest[:-1])
    drop = (first != doc) | before | elsewhere
    order = np.lexsort((start, drop, tag, doc))
    doc, tag, start, end, words, drop, first = (x[order] for x in (doc, tag, start, end, words, drop, first))
    if not len(doc):
        return [doc, tag, start, end, drop, first]
    same = (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (drop[1:] == drop[:-1])
    text = np.concatenate([[0], np.cumsum(~same)])
    reach = int(end.max()) + 2
    reached = np.maximum.accumulate(end + text * reach) - text * reach
    earlier = np.concatenate([[0], reached[:-1]])  # only looked at within a text
    fresh = np.concatenate([[True], ~same | (start[1:] > earlier[1:] + 1)])
    # words of an overlap are shared out by length
    share = np.where(fresh, 1.0, np.maximum(0, end - np.maximum(start, earlier)) / np.maximum(1, end - start))
    at = np.flatnonzero(fresh)
    held = np.add.reduceat(words * share, at) >= settings.run_words
    made = [doc[at], tag[at], start[at], np.maximum.reduceat(end, at), drop[at], np.minimum.reduceat(first, at)]
    return [x[held] for x in made]


def repeated_passages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_kept, n_dropped, dropped_chars, drop_spans, kept_spans, first_docs) of each text with a repeated passage.

    Spans are arrays of (start, end) in code points; ``first_docs`` lists the documents whose passages the
    dropped ones repeat. Texts without a repeated passage, empty and null texts give no row. A repeated row
    (same doc_id and text) gives no second result and repeats only itself: its passages stay. A null doc_id
    comes before all others. An empty table gives an empty result; other columns are not read.
    """
    spans = F.sort_array(F.collect_list(F.when(F.col("drop"), F.struct("start", "end"))))
    kept = F.sort_array(F.collect_list(F.when(~F.col("drop"), F.struct("start", "end"))))
    return passages(docs, settings).groupBy("doc_id", "tag").agg(
        F.count_if(~F.col("drop")).alias("n_kept"),
        F.count_if("drop").alias("n_dropped"),
        F.coalesce(F.sum(F.when(F.col("drop"), F.col("end") - F.col("start"))), F.lit(0)).cast("long").alias("dropped_chars"),
        spans.alias("drop_spans"),
        kept.alias("kept_spans"),
        F.sort_array(F.collect_set(F.when(F.col("drop"), F.col("first_doc")))).alias("first_docs"),
    ).drop("tag")


def drop_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with every repeated passage but its first occurrence cut out of the texts.

    All rows and columns stay; ``n_chars``, where there is such a column, follows the new text. A text of
    which nothing but white space is left becomes empty.
    """
    found = passages(docs, settings).filter("drop").groupBy("doc_id", "tag").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")
    )
    name = free_name(docs, "cut_spans")
    keyed = found.select(F.col("doc_id").alias(f"{name}_id"), F.col("tag").alias(f"{name}_tag"), F.col("spans").alias(name))
    joined = docs.join(
        keyed, docs["doc_id"].cast("long").eqNullSafe(F.col(f"{name}_id")) & (_tag() == F.col(f"{name}_tag")), "left"
    ).select(*[docs[c] for c in docs.columns], F.col(name))
    names = docs.columns
    text_at = [c.lower() for c in names].index("text")
    size_at = [i for i, c in enumerate(names) if c.lower() == "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-1]
            spans = batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column(text_at).to_pylist()
            changed = [without(t, s) if s else t for t, s in zip(texts, spans)]
            columns[text_at] = pa.array(changed, columns[text_at].type)
            for i in size_at:
                sizes = [len(new) if s else old for new, s, old in zip(changed, spans, columns[i].to_pylist())]
                columns[i] = pa.array(sizes, columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)


def without(text: str, spans: list[dict]) -> str:
    """``text`` without the given code point spans; what stood around a cut is joined by the white space there."""
    out, at = [], 0
    for span in sorted((s["start"], s["end"]) for s in spans):
        out.append(text[at : span[0]])
        at = max(at, span[1])
    out.append(text[at:])
    left = "".join(out)
    return left if left.strip() else ""
