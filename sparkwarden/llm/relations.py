"""Exact set-similarity join of documents on word shingles, with block-skipping lists and answers derived from a leader's."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import batch_of, byte_list, pieces
from sparkwarden.llm.components import roots
from sparkwarden.session import cut_lineage

SPACE = re.compile(rb"[\x20\x09-\x0d]")
SLICES = 64
#: 256 parity bits a set: each tells whether an odd number of its shingles falls on it.
PARITY = ("p0", "p1", "p2", "p3")


@dataclass(frozen=True)
class Settings:
    """Sets link at a similarity of ``percent`` in the hundred or more.

    ``sketch``: counters that tell frequent shingles; every task holds them, and their classes, a byte each, travel to all tasks.
    Enlarge it with the corpus: two shingles on one counter only blur the order. ``block``: most list entries of one side of a comparison.
    ``marks``: bits of the set of wanted texts, which only spares texts that are not wanted a second reading.
    """

    shingle: int = 4
    percent: int = 85
    seed: int = 42
    sketch: int = 1 << 21
    block: int = 2048
    marks: int = 1 << 24


# ---- sets -----------------------------------------------------------------------------------------


def shingles(text: bytes, size: int, seed: int, piece: int = 1 << 18) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, ascending; of fewer words that of the whole sequence, of none none."""
    digest, parts, held = xxhash.xxh64_intdigest, [], []
    for part in pieces(text, SPACE, piece):
        words = held + part.lower().split()
        if len(words) >= size:
            joined = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lengths + 1) - 1
            begins = (ends - lengths)[: len(words) - size + 1].tolist()
            found = [digest(joined[a:b], seed) for a, b in zip(begins, ends[size - 1 :].tolist())]
            parts.append(np.array(found, np.uint64))
        held = words[len(words) - size + 1 :] if len(words) >= size else words
    if not parts:
        return np.array([digest(b" ".join(held), seed)] if held else [], np.uint64)
    return np.unique(np.concatenate(parts))


def set_name(tokens: np.ndarray, seed: int) -> int:
    """A hash of the whole set, as a signed number."""
    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes(), seed)).astype(np.int64))


def parity(tokens: np.ndarray, bits: int = 256) -> np.ndarray:
    """Two sets differ in at least as many shingles as in parity bits."""
    odd = (np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def wide_parity(tokens: np.ndarray) -> np.ndarray:
    """As many parity bits as a large set has shingles, or up to twice as many; 256 would all be taken. None for a small one."""
    return parity(tokens, 1 << (len(tokens) - 1).bit_length()) if len(tokens) > 512 else np.array([], np.int64)


def prefix_length(n: int, percent: int) -> int:
    """Linked sets share one of so many rarest shingles, since they share ``percent`` of each."""
    return n + -percent * n // 100 + 1 if n else 0


def overlap_needed(a, b, percent: int):
    """The least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


# ---- arrays over all tasks ------------------------------------------------------------------------


def _sliced(array: np.ndarray) -> pa.RecordBatch:
    """An array as rows, without the slices that hold nothing."""
    parts = [(k, part) for k, part in enumerate(np.split(array, SLICES)) if part.any()]
    return batch_of([("slice", [k for k, _ in parts], pa.int32()), ("part", [p.tobytes() for _, p in parts], pa.binary())])


def _merged(parts: DataFrame, sent: type, add, finish, size: int) -> np.ndarray:
    """The arrays of all tasks merged by ``add``, as ``size`` bytes: slices are merged in tasks and come to the driver once each."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(part, sent)
                held[k] = add(held[k], values) if k in held else values.copy()
        yield batch_of([("slice", list(held), pa.int32()), ("part", [finish(v).tobytes() for v in held.values()], pa.binary())])

    out = np.zeros((SLICES, size // SLICES), np.uint8)
    for row in parts.repartition("slice").mapInArrow(merge, "slice int, part binary").collect():
        out[row.slice] = np.frombuffer(row.part, np.uint8)
    return out.reshape(-1)


def _place(tokens: np.ndarray, size: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def _class(counts: np.ndarray) -> np.ndarray:
    """Counts a fifth apart, in a byte."""
    return np.minimum(np.log2(counts + 1.0) * 4, 255).astype(np.uint8)


def frequency_classes(docs: DataFrame, settings: Settings) -> np.ndarray:
    """How frequent the shingles on each counter are, over all texts."""
    shingle, seed, size = settings.shingle, settings.seed, settings.sketch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, held = np.zeros(size, np.uint32), [], 0
        for batch in batches:
            for text in byte_list(batch.column(0)):
                waiting.append(_place(shingles(text, shingle, seed), size))
                held += len(waiting[-1])
                if held > size:
                    counts += np.bincount(np.concatenate(waiting), minlength=size).astype(np.uint32)
                    waiting, held = [], 0
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=size).astype(np.uint32)
        yield _sliced(counts.astype(np.int64))

    return _merged(docs.select(F.col("text").cast("string")).mapInArrow(run, "slice int, part binary"), np.int64, np.add, _class, size)


# ---- index ----------------------------------------------------------------------------------------


def marked(docs: DataFrame, classes: np.ndarray, settings: Settings) -> DataFrame:
    """(doc_id, digest, rec, n, p0..p3, wide, prefix) of every row: ``rec`` names its set, ``prefix`` holds its rarest shingles in order.

    The order is by frequency class, then by hash: one order for all sets, so linked sets share a shingle of their prefixes.
    A task gives a set's prefix once, so copies do not come back in the lists.
    """
    shingle, seed, percent, size = settings.shingle, settings.seed, settings.percent, settings.sketch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            recs, counts, bits, wide, prefixes = [], [], [], [], []
            for text in byte_list(batch.column(2)):
                tokens = shingles(text, shingle, seed)
                recs.append(set_name(tokens, seed))
                counts.append(len(tokens))
                bits.append(parity(tokens))
                wide.append(wide_parity(tokens))
                length = prefix_length(len(tokens), percent) if recs[-1] not in seen else 0
                order = np.lexsort((tokens, classes[_place(tokens, size)]))[:length] if length else []
                prefixes.append(tokens[order].view(np.int64))
                seen.add(recs[-1])
            flat = np.array(bits, np.int64).reshape(-1, 4)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            yield batch_of(
                [
                    ("doc_id", batch.column(0), None), ("digest", batch.column(1), None), ("rec", recs, pa.int64()), ("n", counts, pa.int32()),
                    *[(p, flat[:, i], pa.int64()) for i, p in enumerate(PARITY)], ("wide", wide, pa.list_(pa.int64())),
                    ("prefix", pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(prefixes) if prefixes else [], pa.int64())), None),
                ]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, digest long, rec long, n int, " + ", ".join(f"{p} long" for p in PARITY) + ", wide array<long>, prefix array<long>"
    )


def _digest() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def distinct_sets(rows: DataFrame) -> DataFrame:
    """(rec, n, p0..p3, wide, digest) of every distinct set that is not empty; ``digest`` is that of one of its texts."""
    return rows.filter("n > 0").select("rec", "n", *PARITY, "wide", "digest").dropDuplicates(["rec"])


def index_lists(rows: DataFrame) -> DataFrame:
    """(token, leader, rec, n, pos): the lists of the shingles that prefixes of several sets share.

    A list's leader is the set where the shingle stands earliest. A copy's own shingles are rare and come first,
    so the text that copies derive from is the likeliest to lead. Most shingles of a prefix are no other set's: rows are kept narrow
    until these are gone.
    """
    entries = rows.select("rec", "n", F.posexplode("prefix").alias("pos", "token")).select(
        "token", "rec", (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("n")).alias("at")
    )
    shared = entries.groupBy("token").agg(F.min("rec").alias("low"), F.max("rec").alias("high")).filter("low < high").select("token")
    lists = cut_lineage(entries.join(shared, "token").dropDuplicates(["token", "rec"]))
    leaders = lists.groupBy("token").agg(F.min_by("rec", "at").alias("leader"))
    n = F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return lists.join(leaders, "token").select("token", "leader", "rec", n.alias("n"), F.shiftright("at", 32).cast("int").alias("pos"))


# ---- exact answers --------------------------------------------------------------------------------


def _facts(sets: DataFrame, side: str) -> DataFrame:
    return sets.select(F.col("rec").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", *PARITY)])


def _differing(a: str, b: str) -> str:
    """In how many wide parity bits a and b differ; of the one with twice as many, bits that fall together are added first."""
    half = "CASE WHEN size({0}) > size({1}) THEN zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (p, q) -> p ^ q) ELSE {0} END"
    return f"aggregate(zip_with({half.format(a, b)}, {half.format(b, a)}, (p, q) -> p ^ q), 0, (sum, v) -> sum + bit_count(v))"


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and parity bits allow a link."""
    both = pairs.join(_facts(sets, "a"), "a").join(_facts(sets, "b"), "b")
    differing = sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PARITY), F.lit(0))
    needed = F.expr(f"({percent}L * (a_n + b_n) + {99 + percent}) div {100 + percent}")
    sizes = F.least("a_n", "b_n").cast("long") * 100 >= F.greatest("a_n", "b_n").cast("long") * percent
    most = F.col("a_n") + F.col("b_n") - 2 * needed
    near = both.filter(sizes & (differing <= most)).select("a", "b", most.alias("most"))
    large = sets.filter(F.size("wide") > 0)
    for side in "ab":
        near = near.join(large.select(F.col("rec").alias(side), F.col("wide").alias(f"{side}_wide")), side, "left")
    # by halving once the two become equally long, else there is nothing to compare
    halved = F.expr("size(a_wide) IN (size(b_wide), 2 * size(b_wide)) OR size(b_wide) = 2 * size(a_wide)")
    return near.filter(~F.coalesce(halved & (F.expr(_differing("a_wide", "b_wide")) > F.col("most")), F.lit(False))).select("a", "b")


def whole_sets(docs: DataFrame, sets: DataFrame, recs: DataFrame, settings: Settings) -> DataFrame:
    """(rec, tokens): the sets named by ``recs``, and perhaps some others, made from their texts once more; each once.

    A text is read again only if its digest is among the marks of the wanted ones; nothing is joined with the whole corpus.
    """
    shingle, seed, size = settings.shingle, settings.seed, settings.marks
    wanted = sets.join(recs, "rec", "left_semi").select("digest")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            bits[_place(batch.column(0).to_numpy().view(np.uint64), size)] = 1
        yield _sliced(np.packbits(bits))

    packed = _merged(wanted.mapInArrow(mark, "slice int, part binary"), np.uint8, np.bitwise_or, lambda v: v, size // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            digests = batch.column(0).to_numpy()
            at = _place(digests.view(np.uint64), size)
            hit = [i for i in np.flatnonzero(packed[at >> 3] >> (7 - (at & 7)) & 1).tolist() if digests[i] not in seen]
            seen.update(digests[hit].tolist())
            found = [shingles(t, shingle, seed) for t in byte_list(batch.column(1).take(pa.array(hit, pa.int64())))]
            recs = [set_name(t, seed) for t in found]
            yield batch_of([("rec", recs, pa.int64()), ("tokens", [t.view(np.int64) for t in found], pa.list_(pa.int64()))])

    read = docs.select(_digest().alias("digest"), F.col("text").cast("string").alias("text")).mapInArrow(run, "rec long, tokens array<long>")
    return read.dropDuplicates(["rec"])


def overlaps(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n, shared): the exact intersection of each pair. Both joins use one exchange of the sets."""
    a, b = (whole.select(F.col("rec").alias(s), F.col("tokens").alias(f"{s}_tokens")) for s in "ab")
    return pairs.join(a, "a").join(b, "b").select(
        "a", "b", F.size("a_tokens").alias("a_n"), F.size("b_tokens").alias("b_n"), F.size(F.array_intersect("a_tokens", "b_tokens")).alias("shared")
    )


def linked(percent: int) -> Column:
    shared = F.col("shared").cast("long")
    return shared * 100 >= percent * (F.col("a_n") + F.col("b_n") - shared)


# ---- lists ----------------------------------------------------------------------------------------

STEP = 64


def list_pairs(left: dict[str, np.ndarray], right: dict[str, np.ndarray], leader_n: int, percent: int) -> Iterator[tuple[int, int, bool]]:
    """Pairs (a, b, sure) of entries of one list that may link, of different components, neither of them the leader.

    Entries stand by the number of shingles from the list's own on, so blocks of them are skipped whole: where the
    longer rests of both blocks hold too few shingles for the smaller sets of both, or the sizes are too far apart. Within a
    block, each pair's overlap is bounded by the answers that the leader r has already: with |s r| and |y r| known, s and y share at most
    min(|s r|, |y r|) inside of r and min(|s| - |s r|, |y| - |y r|) outside, and at least |s r| + |y r| - |r|.
    Pairs for which that is enough are ``sure`` and need no look at the sets.
    """
    sides = []
    for side in (left, right):
        rest = side["n"] - side["pos"]
        order = np.lexsort((side["n"], -rest))
        cut = {k: v[order] for k, v in side.items()} | {"rest": rest[order]}
        sides.append([{k: v[i : i + STEP] for k, v in cut.items()} for i in range(0, len(order), STEP)])
    # the smallest set from each right block on
    smallest = np.minimum.accumulate([int(b["n"].min()) for b in reversed(sides[1])])[::-1] if sides[1] else []
    for i, a in enumerate(sides[0]):
        least = int(a["n"].min())
        for j in range(i if left is right else 0, len(sides[1])):
            b = sides[1][j]
            rest = min(int(a["rest"][0]), int(b["rest"][0]))
            if rest < overlap_needed(least, int(smallest[j]), percent):
                # the rests only get shorter from here on
                break
            if rest < overlap_needed(least, int(b["n"].min()), percent):
                continue
            if int(a["n"].max()) * 100 < int(b["n"].min()) * percent or int(b["n"].max()) * 100 < least * percent:
                continue
            yield from _block_pairs(a, b, leader_n, percent)


def _block_pairs(a, b, leader_n: int, percent: int) -> Iterator[tuple[int, int, bool]]:
    grid = lambda k: (a[k][:, None], b[k][None, :])
    (n, m), (x, y), (c, d), (r, s) = grid("n"), grid("known"), grid("comp"), grid("rec")
    needed = overlap_needed(n, m, percent)
    at_most = np.minimum(x, y) + np.minimum(n - x, m - y)
    # without a known answer anything up to the smaller set is possible
    at_most = np.where((x < 0) | (y < 0), np.minimum(n, m), at_most)
    fits = (c != d) & (r != s) & (np.minimum(*grid("rest")) >= needed) & (at_most >= needed)
    if not fits.any():
        return
    differing = sum(np.bitwise_count((p[:, None] ^ q[None, :]).view(np.uint64)).astype(np.int64) for p, q in ((a[k], b[k]) for k in PARITY))
    fits &= differing <= n + m - 2 * needed
    sure = (x >= 0) & (y >= 0) & (x + y - leader_n >= needed)
    for i, j in zip(*np.nonzero(fits)):
        u, v = int(a["rec"][i]), int(b["rec"][j])
        yield max(u, v), min(u, v), bool(sure[i, j])


ENTRY = ("rec", "n", "pos", "known", "comp", *PARITY)


def open_pairs(lists: DataFrame, answers: DataFrame, comps: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """(a, b, sure): what the leaders' answers leave open in the lists.

    Entries are inside if their component is the leader's. Pairs of inside entries are settled, so blocks of outside entries meet
    blocks of outside and of inside ones, and lists without outside entries are dropped. Blocks have a bounded size, so a long list is spread.
    """
    percent, most = settings.percent, settings.block
    known = answers.select(F.col("a").alias("rec"), F.col("b").alias("leader"), F.col("shared").alias("known"))
    comp = comps.select(F.col("node").alias("rec"), F.col("root"))
    named = (
        lists.filter("rec <> leader")
        .join(known, ["rec", "leader"], "left")
        .join(comp, "rec", "left")
        .join(comp.select(F.col("rec").alias("leader"), F.col("root").alias("leader_root")), "leader", "left")
        .select(
            "token", "leader", "rec", "n", "pos", F.coalesce("known", F.lit(-1)).alias("known"), F.coalesce("root", "rec").alias("comp"),
            (F.coalesce("root", "rec") != F.coalesce("leader_root", "leader")).alias("outside"),
        )
    )
    named = cut_lineage(named)
    counts = named.groupBy("token").agg(F.count_if("outside").alias("outs"), F.count(F.lit(1)).alias("every")).filter("outs > 0 and every > 1")
    blocks = lambda count: F.greatest(F.lit(1), F.ceil(count / F.lit(most))).cast("int")
    mine = F.pmod(F.xxhash64("rec", "token"), F.when(F.col("outside"), F.col("o")).otherwise(F.col("i"))).cast("int")
    up_to = lambda count: F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    o, i, at = F.col("o"), F.col("i"), F.col("at")
    # an outside block is the left side against itself, later outside blocks and all inside ones, and the right side against earlier ones
    left = F.concat(
        F.transform(F.sequence(at, o - 1), lambda k: F.struct(at.alias("l"), k.alias("r"), F.lit(True).alias("both"), F.lit(0).alias("side"))),
        F.transform(up_to(F.when(F.col("ins") > 0, i).otherwise(0)), lambda k: F.struct(at.alias("l"), k.alias("r"), F.lit(False).alias("both"), F.lit(0).alias("side"))),
    )
    right = F.transform(up_to(at), lambda k: F.struct(k.alias("l"), at.alias("r"), F.lit(True).alias("both"), F.lit(1).alias("side")))
    inside = F.transform(up_to(o), lambda k: F.struct(k.alias("l"), at.alias("r"), F.lit(False).alias("both"), F.lit(1).alias("side")))
    leaders = sets.select(F.col("rec").alias("leader"), F.col("n").alias("leader_n"))
    dealt = (
        named.join(counts, "token")
        .join(sets.select("rec", *PARITY), "rec")
        .join(leaders, "leader")
        .withColumns({"o": blocks(F.col("outs")), "i": blocks(F.col("every") - F.col("outs")), "ins": F.col("every") - F.col("outs")})
        .withColumn("at", mine)
        .withColumn("to", F.explode(F.when(F.col("outside"), F.concat(left, right)).otherwise(inside)))
    )
    # at most twice the block size in a group
    groups = dealt.groupBy("token", "leader_n", "to.l", "to.r", "to.both").agg(F.collect_list(F.struct("to.side", *ENTRY)).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, int], bool] = {}
            entries = batch.column(1)
            flat, starts = entries.flatten(), np.concatenate([[0], np.cumsum(entries.value_lengths().to_numpy())])
            columns = {k: flat.field(k).to_numpy().astype(np.int64) for k in ENTRY}
            sides = flat.field("side").to_numpy()
            for k, leader_n in enumerate(batch.column(0).to_pylist()):
                rows = np.arange(starts[k], starts[k + 1])
                left = {c: v[rows[sides[rows] == 0]] for c, v in columns.items()}
                right = {c: v[rows[sides[rows] == 1]] for c, v in columns.items()}
                # a group of one side only is an outside block against itself
                for a, b, sure in list_pairs(left, right if len(right["rec"]) else left, leader_n, percent):
                    out[a, b] = out.get((a, b), False) or sure
            a, b = zip(*out) if out else ((), ())
            yield batch_of([("a", list(a), pa.int64()), ("b", list(b), pa.int64()), ("sure", list(out.values()), pa.bool_())])

    return groups.select("leader_n", "entries").mapInArrow(run, "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))


def set_links(docs: DataFrame, rows: DataFrame, sets: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Links (a, b) between distinct sets that connect all linked ones, and no others.

    First every list's entries are compared with its leader; then only what these answers leave open between different components.
    """
    percent = settings.percent
    lists = cut_lineage(index_lists(rows))
    to_leader = lists.filter("rec <> leader").select(F.col("rec").alias("a"), F.col("leader").alias("b")).distinct()
    asked = cut_lineage(possible(to_leader, sets, percent))
    whole = whole_sets(docs, sets, asked.select(F.col("a").alias("rec")).union(asked.select("b")).distinct(), settings)
    answers = cut_lineage(overlaps(asked, whole))
    links = answers.filter(linked(percent)).select("a", "b")
    more = cut_lineage(open_pairs(lists, answers, roots(links), sets, settings))
    unsure = cut_lineage(possible(more.filter("not sure").select("a", "b"), sets, percent))
    whole = whole_sets(docs, sets, unsure.select(F.col("a").alias("rec")).union(unsure.select("b")).distinct(), settings)
    checked = overlaps(unsure, whole).filter(linked(percent)).select("a", "b")
    return links.union(more.filter("sure").select("a", "b")).union(checked)


def similar_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs(doc_id, text)``.

    A document's set holds its distinct word shingles, of fewer words the whole sequence. Documents link when 100 times their intersection
    is ``percent`` times their union or more; ``component_id`` is the smallest doc_id reachable by links, itself included. Equal
    sets link without being paired: links are sought between distinct sets. Shingles and sets are known by 64-bit hashes.

    Null, empty and blank texts have an empty set, link with nothing and are their own component. A null doc_id stays null and names
    a component only where there is no other; rows of one id are linked as the texts they are. Repeated rows give repeated rows, an empty table
    an empty result; other columns are not read. Texts are read in pieces, so a very long one costs eight bytes a word.
    """
    rows = cut_lineage(marked(docs, frequency_classes(docs, settings), settings))
    sets = cut_lineage(distinct_sets(rows))
    parts = roots(set_links(docs, rows, sets, settings)).withColumnRenamed("node", "rec")
    least = rows.filter("n > 0").groupBy("rec").agg(F.min("doc_id").alias("first")).join(parts, "rec", "left")
    least = cut_lineage(least.withColumn("root", F.coalesce("root", "rec")))
    named = least.select("rec", "root").join(least.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("rec", "component_id")
    narrow = rows.select("doc_id", F.when(F.col("n") > 0, F.col("rec")).alias("rec"), F.col("n").cast("long").alias("n_shingles"))
    found = narrow.filter("rec is not null").join(named, "rec").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(narrow.filter("rec is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
