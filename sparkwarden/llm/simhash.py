"""Near-duplicate groups by SimHash, compared on vertical bit planes with carry-save counters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import batch_of, byte_list, free_name, slices
from sparkwarden.llm.components import roots
from sparkwarden.session import cut_lineage

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCKS = 5
GROUP_MOST = 2048
LANES = 1 << 17
EXACT_MOST = 1024
SET_MOST = 1 << 21


# ---- fingerprints ---------------------------------------------------------------------------------


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """64 majority bits over the hashes of all word shingles, as a signed integer; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        begins = (ends - lengths)[: 1 - size].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(begins, ends[size - 1 :].tolist())]
    rows = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 14):
        counts += np.unpackbits(rows[at : at + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(rows)).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fp) of every row, in one pass that keeps texts in place; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for t in byte_list(batch.column(2))]
            yield batch_of([("doc_id", batch.column(0), None), ("digest", batch.column(1), None), ("fp", found, pa.int64())])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, digest long, fp long")


def text_digest() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


# ---- comparison -----------------------------------------------------------------------------------


def bit_blocks(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` blocks of about equal size over the given bit positions."""
    return [sum(1 << b for b in chunk.tolist()) for chunk in np.array_split(np.array(bits), parts)]


def agreeing_masks(bits: list[int], radius: int, parts: int) -> list[int]:
    """Masks of which two values differing in up to ``radius`` of ``bits`` agree on at least one.

    That many differences touch at most ``radius`` blocks, so the others agree.
    """
    return [sum(c) for c in combinations(bit_blocks(bits, parts), parts - radius)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def close_lanes(values: np.ndarray, radius: int) -> np.ndarray:
    """For G groups of M values of one or more 64-bit words (G, M, N): lane j of row i tells that i and j are close.

    Bit plane p holds bit p of all members of a group side by side, 64 members to a word. Each plane is
    compared with one bit of every member at once; carry-save counters, started so that they run over
    exactly beyond ``radius``, add up the differences of 64 lanes per operation. The block is abandoned as
    soon as all its lanes, but for each member's own, have run over.
    """
    values = values if values.ndim == 3 else values[:, :, None]
    groups, members, parts = values.shape
    words = -(-members // 64)
    ones = np.uint64((1 << 64) - 1)
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius
    shape = (groups, members, words)
    counters = [np.full(shape, ones if start >> j & 1 else 0, np.uint64) for j in range(width)]
    over = np.zeros(shape, np.uint64)
    own = np.zeros((members, words), np.uint64)
    at = np.arange(members)
    own[at, at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
    lanes = np.bitwise_or.reduce(own, axis=0)
    rest = lanes & ~own
    for plane in range(64 * parts):
        bits = (values[:, :, plane // 64] >> np.uint64(plane % 64)) & np.uint64(1)
        packed = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")
        packed = np.pad(packed, ((0, 0), (0, words * 8 - packed.shape[1])))
        vertical = np.ascontiguousarray(packed).view(np.uint64)
        carry = vertical[:, None, :] ^ (np.uint64(0) - bits)[:, :, None]
        for counter in counters:
            counter_carry = counter & carry
            counter ^= carry
            carry = counter_carry
        over |= carry
        if plane % 8 == 7 and not np.any(rest & ~over):
            break
    return rest & ~over


def spanning_links(
    groups: list[np.ndarray], radius: int = RADIUS, names: list[np.ndarray] | None = None
) -> tuple[list[int], list[int]]:
    """Links (member, smallest member of its part) for the connected parts within each group of values.

    ``names``: what to call the members where they are not their own names.
    """
    by_size: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for group, name in zip(groups, names if names is not None else [g.astype(np.int64) for g in groups]):
        wide = group if group.ndim == 2 else group[:, None]
        by_size.setdefault(max(2, 1 << (len(group) - 1).bit_length()), []).append((wide, name))
    left, right = [], []
    for size, alike in by_size.items():
        step = max(1, LANES // (size * -(-size // 64)))
        for at in range(0, len(alike), step):
            block = alike[at : at + step]
            padded = np.zeros((len(block), size, block[0][0].shape[1]), np.uint64)
            valid = np.zeros((len(block), size), np.uint8)
            for k, (group, _) in enumerate(block):
                padded[k, : len(group)] = group
                valid[k, : len(group)] = 1
            near = close_lanes(padded, radius)
            packed = np.packbits(valid, axis=1, bitorder="little")
            packed = np.pad(packed, ((0, 0), (0, near.shape[2] * 8 - packed.shape[1])))
            near &= np.ascontiguousarray(packed).view(np.uint64)[:, None, :]
            for k in np.flatnonzero(near.any(axis=(1, 2))).tolist():
                _walk(block[k][1], near[k], left, right)
    return left, right


def _walk(keys: np.ndarray, near: np.ndarray, left: list[int], right: list[int]) -> None:
    """Visit each member of a group once, over lanes not seen before."""
    unseen = np.full(near.shape[1] * 64, True)
    unseen[len(keys) :] = False
    for first in range(len(keys)):
        if not unseen[first]:
            continue
        part, queue = [first], [first]
        unseen[first] = False
        while queue:
            lanes = np.unpackbits(near[queue.pop()].view(np.uint8), bitorder="little").astype(bool)
            new = np.flatnonzero(lanes & unseen)
            unseen[new] = False
            part.extend(new.tolist())
            queue.extend(new.tolist())
        if len(part) > 1:
            low = int(keys[part].min())
            for i in part:
                if keys[i] != low:
                    left.append(int(keys[i]))
                    right.append(low)


# ---- linking --------------------------------------------------------------------------------------


def near_links(distinct: DataFrame, radius: int = RADIUS, group_most: int = GROUP_MOST) -> DataFrame:
    """Links (a, b) that connect all values of ``distinct(fp)`` within ``radius`` bits, and no others.

    Values are grouped by the bits under each agreeing mask. A group with more than ``group_most`` members is
    divided again by sub-masks of its free bits: under these at least 53 bits are fixed, so as values are
    distinct no group can hold more than 2,048 of them, however many near copies there are.
    """
    masks = agreeing_masks(list(range(64)), radius, BLOCKS)
    finer = [
        [signed(m | s) for s in agreeing_masks([b for b in range(64) if not m >> b & 1], radius, BLOCKS)] for m in masks
    ]
    keyed = distinct.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask")).withColumn(
        "key", F.col("fp").bitwiseAND(F.col("mask"))
    )
    sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = keyed.join(sizes, ["mask", "key"])
    choice = F.create_map(*[x for m, fine in zip(masks, finer) for x in (F.lit(signed(m)), F.array(*[F.lit(f) for f in fine]))])
    divided = shared.select(
        "fp", F.explode(F.when(F.col("n") > group_most, choice[F.col("mask")]).otherwise(F.array("mask"))).alias("mask")
    )
    members = (
        divided.groupBy("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        .agg(F.collect_list("fp").alias("members"))
        .filter(F.size("members") > 1)
        .select("members")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = [np.array(g, np.int64).astype(np.uint64) for g in batch.column(0).to_pylist()]
            left, right = spanning_links(groups, radius)
            yield batch_of([("a", left, pa.int64()), ("b", right, pa.int64())])

    return members.mapInArrow(run, "a long, b long").distinct()


def _grouped(docs: DataFrame, radius: int) -> DataFrame:
    marked = cut_lineage(fingerprints(docs))
    least = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = roots(near_links(least.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = cut_lineage(least.join(parts, "fp"))
    named = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("first").alias("linked")), "root")
    firsts = least.join(named.select("fp", "linked"), "fp", "left").select("fp", F.coalesce("linked", "first").alias("component_id"))
    return marked.join(firsts, "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs(doc_id, text)``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest doc_id reachable.
    Equal texts share a fingerprint, so copies are never paired: links are sought between distinct fingerprints
    only. A null text counts as empty and an empty text has fingerprint zero, linked like any other. A null
    doc_id stays null; it is a component's id only where the component has no other. Repeated rows give
    repeated rows, an empty table an empty result; other columns are not read.
    """
    return _grouped(docs, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# ---- near copies by similarity --------------------------------------------------------------------


@dataclass(frozen=True)
class Copies:
    """Near copies by the similarity of their word shingles.

    Texts are candidates if one of the ``words`` of their SimHashes is the same within ``near`` of 64 bits, found in
    agreeing-bit groups as in ``near_links``; these are the closest copies. Texts of similarity 0.8 differ in about
    15 % of the bits (an angle of 27 degrees), far more than two of 64, and no affordable number of bit blocks would
    hold them all together. So for the rest whole fingerprints of ``words`` times 64 bits are compared, within
    ``radius`` bits: 80 of 256 is five deviations beyond the mean of the worst sets of similarity 0.8 (four of five
    shingles, 18.75 % of the bits), passed by one pair in 1.8 million. These texts meet if one of their ``keys``
    smallest shingle hashes is the same, which at 0.8 fails for one pair in 400,000. Candidates are near copies if the
    exact similarity of their sets of shingle hashes is ``similarity`` or more.
    """

    shingle: int = 5
    words: int = 4
    radius: int = 80
    keys: int = 8
    similarity: float = 0.8
    near: int = RADIUS


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes; empty without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: 1 - size].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends[size - 1 :].tolist())], np.uint64))


def wide_fingerprint(text: bytes, settings: Copies = Copies()) -> tuple[list[int], list[int]]:
    """The words of a wide SimHash and the smallest shingle hash of each key's own order; none without words."""
    return _wide(shingle_hashes(text, settings.shingle), settings)


def _wide(hashes: np.ndarray, settings: Copies) -> tuple[list[int], list[int]]:
    if not len(hashes):
        return [0] * settings.words, [0]
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, (settings.words + settings.keys, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = []
    for k in range(settings.words):
        mixed = _mixed(hashes, odd[k])
        counts = np.zeros(64, np.int64)
        for at in range(0, len(mixed), 1 << 14):
            rows = mixed[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(rows, axis=1).sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(mixed)).view(">i8")[0]))
    return out, [int(_mixed(hashes, odd[settings.words + k]).min().astype(np.int64)) for k in range(settings.keys)]


def _mixed(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    value = (hashes ^ (hashes >> np.uint64(31))) * odd[0]
    return (value ^ (value >> np.uint64(29))) * odd[1]


def word_links(prints: DataFrame, settings: Copies, group_most: int = GROUP_MOST) -> DataFrame:
    """Links (a, b) that connect all nodes of ``prints(node, bits)`` with a word of ``bits`` within ``settings.near`` bits of each other.

    The words of all nodes are compared as one set of distinct values, so nodes with the same word are never paired:
    each is linked with the smallest of them.
    """
    words = prints.select("node", F.explode("bits").alias("fp"))
    least = cut_lineage(words.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")))
    same = words.join(least.filter("n > 1"), "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = near_links(least.select("fp"), settings.near, group_most)
    for end in ("a", "b"):
        near = near.join(least.select(F.col("fp").alias(end), F.col("first").alias(f"node_{end}")), end)
    return same.union(near.select("node_a", "node_b")).filter("a <> b").distinct()


def wide_links(prints: DataFrame, settings: Copies, group_most: int = GROUP_MOST) -> DataFrame:
    """Links (a, b) between the nodes of ``prints(node, bits, keys)`` that share a key and are within the radius.

    A key with more than ``group_most`` nodes is cut into tiles, and every two tiles meet in a group of
    their own: no group is larger than two tiles, and no pair is left out.
    """
    keyed = prints.select("node", "bits", F.posexplode("keys").alias("k", "key"))
    sizes = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / group_most)
    shared = keyed.join(sizes, ["k", "key"]).withColumn("tiles", tiles.cast("int")).withColumn("t", F.pmod(F.col("node"), F.col("tiles")).cast("int"))
    # tile t meets every tile, itself included; the pair goes by its smaller and larger number
    met = shared.select("node", "bits", "k", "key", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
    groups = met.groupBy("k", "key", F.least("t", "o").alias("low"), F.greatest("t", "o").alias("high")).agg(
        F.collect_list(F.struct("node", "bits")).alias("members")
    ).filter(F.size("members") > 1).select("members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            names = flat.field("node").to_numpy()
            bits = flat.field("bits").flatten().to_numpy().astype(np.uint64).reshape(len(names), -1)
            at = np.cumsum(lists.value_lengths().to_numpy())[:-1]
            left, right = spanning_links(np.split(bits, at), settings.radius, np.split(names, at)) if len(names) else ([], [])
            yield batch_of([("a", left, pa.int64()), ("b", right, pa.int64())])

    return groups.mapInArrow(run, "a long, b long").distinct()


def _marked(docs: DataFrame, settings: Copies) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, node) of every row, and (node, first, text, size, bits, keys) of every set of shingles.

    ``node`` names the set, ``text`` is the digest of one text that has it, ``size`` its number of shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in byte_list(batch.column(2)):
                hashes = shingle_hashes(text, settings.shingle)
                found.append((_signed_digest(hashes), len(hashes), *_wide(hashes, settings)))
            yield batch_of(
                [
                    ("doc_id", batch.column(0), None), ("digest", batch.column(1), None),
                    ("node", [f[0] for f in found], pa.int64()), ("size", [f[1] for f in found], pa.int64()),
                    ("bits", [f[2] for f in found], pa.list_(pa.int64())), ("keys", [f[3] for f in found], pa.list_(pa.int64())),
                ]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), F.col("text").cast("string").alias("text"))
    marked = cut_lineage(rows.mapInArrow(run, "doc_id long, digest long, node long, size long, bits array<long>, keys array<long>"))
    distinct = marked.groupBy("node").agg(
        F.min("doc_id").alias("first"), F.min("digest").alias("text"), F.min("size").alias("size"), F.min(F.struct("bits", "keys")).alias("p")
    )
    return marked.select("doc_id", "digest", "node"), cut_lineage(distinct.select("node", "first", "text", "size", "p.*"))


def _signed_digest(hashes: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))


def _named(marked: DataFrame, least: DataFrame, parts: DataFrame) -> DataFrame:
    rooted = cut_lineage(least.select("node", "first").join(parts, "node"))
    named = rooted.select("node", "root").join(rooted.groupBy("root").agg(F.min("first").alias("linked")), "root")
    firsts = least.select("node", "first").join(named, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), F.coalesce("linked", "first").alias("component_id")
    )
    return marked.join(firsts, "node").drop("node")


def copies(docs: DataFrame, settings: Copies = Copies()) -> DataFrame:
    """(doc_id, digest, root, component_id) of every row: texts whose wide fingerprints are linked share a root.

    ``component_id`` is the smallest doc_id of the texts that do. Such texts are candidates only; see ``exact_copies``.
    """
    marked, least = _marked(docs, settings)
    return _named(marked, least, roots(wide_links(least.select("node", "bits", "keys"), settings)))


def exact_copies(docs: DataFrame, settings: Copies = Copies()) -> DataFrame:
    """(doc_id, digest, root, component_id) of every row, texts linked by the exact similarity of their shingles."""
    marked, least = _marked(docs, settings)
    prints = least.select("node", "bits", "keys")
    candidates = cut_lineage(roots(word_links(prints, settings).union(wide_links(prints, settings))))
    return _named(marked, least, roots(exact_links(docs, least, candidates, settings)))


def exact_links(docs: DataFrame, least: DataFrame, candidates: DataFrame, settings: Copies, group_most: int = EXACT_MOST) -> DataFrame:
    """Links (a, b) between nodes of one candidate component ``candidates(node, root)`` that have the similarity.

    Two nodes that meet as candidates are in one component, so comparing its members leaves no such pair out. Only
    members' sets of shingles are made, once each, from one text of the set. A component of more than ``group_most``
    members or of many shingles is cut into tiles of which every two meet.
    """
    members = cut_lineage(least.select("node", "text", "size").join(candidates, "node"))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all"))
    tiles = F.greatest(F.ceil(F.col("n") / group_most), F.ceil(F.col("all") / SET_MOST)).cast("int")
    placed = members.join(sizes.select("root", tiles.alias("tiles")), "root")
    # texts alike combine before the shuffle
    texts = docs.select(text_digest().alias("digest"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).groupBy("digest").agg(
        F.min("t").alias("t")
    )
    told = placed.join(texts, F.col("text") == F.col("digest")).select("node", "root", "tiles", "t")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, held in slices(batch, 3):
                found = [shingle_hashes(t, settings.shingle) for t in held]
                yield batch_of(
                    [
                        ("node", part.column(0), None), ("root", part.column(1), None), ("tiles", part.column(2), None),
                        ("bits", [_wide(h, settings)[0] for h in found], pa.list_(pa.int64())),
                        ("hashes", [h.view(np.int64) for h in found], pa.list_(pa.int64())),
                    ]
                )

    made = told.mapInArrow(sets, "node long, root long, tiles int, bits array<long>, hashes array<long>")
    tile = F.pmod(F.col("node"), F.col("tiles")).cast("int")
    met = made.select("*", tile.alias("t"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o")).select(
        "root", F.least("t", "o").alias("low"), F.greatest("t", "o").alias("high"), "node", "bits", "hashes"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _together(batches, 3):
            lists = group.column(5).combine_chunks()
            names, at = group.column(3).to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            bits = group.column(4).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(names), -1)
            left, right = similar_links(names, bits, lists.flatten().to_numpy(), at, settings)
            yield batch_of([("a", left, pa.int64()), ("b", right, pa.int64())])

    keys = ["root", "low", "high"]
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def _together(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that are equal in the first columns; a run may span batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(keys)])
        at = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:]):
            key = tuple(values[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def similar_links(names: np.ndarray, bits: np.ndarray, flat: np.ndarray, sizes: np.ndarray, settings: Copies) -> tuple[list[int], list[int]]:
    """Links (member, smallest member of its part) for the parts connected by similarity; ``flat`` holds the sets in turn.

    Each member is compared with those not yet in a part, all at once; those beyond the radius are left out first,
    in groups of any size.
    """
    count = len(names)
    if count > 64:
        near = np.unpackbits(close_lanes(bits[None], settings.radius)[0].view(np.uint8), axis=1, bitorder="little")[:, :count].astype(bool)
    else:  # planes of a few lanes cost more than counting each pair's bits
        near = np.bitwise_count(bits[:, None] ^ bits).sum(axis=-1) <= settings.radius
    ids = np.unique(flat, return_inverse=True)[1]
    begins = np.cumsum(sizes) - sizes
    marks = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    unseen = np.full(count, True)
    left, right = [], []
    for first in range(count):
        if not unseen[first]:
            continue
        part, queue = [first], [first]
        unseen[first] = False
        while queue:
            i = queue.pop()
            may = unseen & (np.minimum(sizes, sizes[i]) / np.maximum(sizes, sizes[i]) >= settings.similarity)
            may &= near[i]
            at = np.flatnonzero(may)
            if not len(at):
                continue
            own = ids[begins[i] : begins[i] + sizes[i]]
            marks[own] = True
            starts = np.cumsum(sizes[at]) - sizes[at]
            rows = np.arange(int(sizes[at].sum())) + np.repeat(begins[at] - starts, sizes[at])
            shared = np.add.reduceat(marks[ids[rows]].astype(np.int64), starts)
            marks[own] = False
            new = at[shared / (sizes[at] + sizes[i] - shared) >= settings.similarity]
            unseen[new] = False
            part.extend(new.tolist())
            queue.extend(new.tolist())
        if len(part) > 1:
            low = int(names[part].min())
            left += [int(names[k]) for k in part if names[k] != low]
            right += [low] * (len(part) - 1)
    return left, right


def keep_one(docs: DataFrame, settings: Copies = Copies()) -> DataFrame:
    """The rows of ``docs`` that represent their group of near copies, with all their columns.

    Groups are the components of pairs whose sets of shingles have the exact similarity of the settings.

    The document with the smallest doc_id stays; of several texts under that id in the group the one with the
    smallest digest, of repeated rows one. Documents without an id cannot be named as copies and stay. Texts
    without words are equal to each other; a null text counts as empty.
    """
    name, digest = free_name(docs, "kept_id"), free_name(docs, "kept_digest")
    # an id with texts in several groups represents each of them
    keep = exact_copies(docs, settings).filter("doc_id = component_id").groupBy("root").agg(
        F.min("component_id").alias(name), F.min("digest").alias(digest)
    ).select(name, digest).distinct()
    told = docs.withColumn(digest + "_", text_digest())
    joined = told.join(keep, (told["doc_id"].cast("long") == F.col(name)) & (told[digest + "_"] == F.col(digest)))
    return joined.dropDuplicates([name, digest]).select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
