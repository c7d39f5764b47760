"""N-best segmentation into sentence pieces: Viterbi scores forward, A-star search backward, and decoding."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import batch_of, slices, text_list

MARK = "▁"
#: Scores are whole numbers of this part of a natural logarithm: sums are exact and equal paths compare equal.
UNITS = 1 << 20
LOW = -(1 << 62)  # below every score
RUN = re.compile("[^ ] ")
SHORT = 3  # code points that fit into 64 bits together


@dataclass(frozen=True)
class Settings:
    """The vocabulary file, the number of segmentations wanted, how many units a task remembers, up to which length
    units are solved together, and how many characters a task works on at a time."""

    model: str
    best: int = 4
    remembered: int = 400_000
    together: int = 48
    part: int = 1 << 20


def default_settings() -> Settings:
    import public_tokenizers

    return Settings(model=public_tokenizers.path("piece_bpe_32k.model"))


def packed(points: np.ndarray, n: int) -> np.ndarray:
    """Each run of ``n`` code points as one number."""
    count = max(0, len(points) - n + 1)
    out = points[:count].astype(np.uint64)
    for k in range(1, n):
        out = (out << np.uint64(21)) | points[k : count + k].astype(np.uint64)
    return out


class Vocabulary:
    """Pieces with log-probabilities by Zipf's law over their merge ranks, and bytes for all other characters.

    ``unit`` cuts a text where no piece can lie across: before spaces, around line ends and marks that stand in
    the text, and before signs, but for those after a character that some piece holds before a sign. So a
    text's segmentations are the combinations of those of its units.
    """

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        read = SentencePieceProcessor(model_file=model)
        size = read.get_piece_size()
        ranks = {}
        self.shown: list[bytes] = [b""] * size
        self.byte_ids = [0] * 256
        for i in range(size):
            piece = read.id_to_piece(i)
            if read.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.shown[i] = bytes([int(piece[3:-1], 16)])
            elif not (read.is_control(i) or read.is_unknown(i) or read.is_unused(i)):
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError(f"piece {i} crosses the border of words")
                ranks[piece] = (i, -read.get_score(i))
                self.shown[i] = piece.replace(MARK, " ").encode()
        norm = math.log(sum(1 / (r + 1) for _, r in ranks.values()))
        self.pieces = {p: (i, -round((math.log(r + 1) + norm) * UNITS)) for p, (i, r) in ranks.items()}
        self.byte_score = -round((math.log(2 * size) + norm) * UNITS)
        # pieces, and None for what a longer piece begins with
        self.begun: dict[str, tuple[int, int] | None] = {p[:i]: None for p in self.pieces for i in range(1, len(p))}
        self.begun.update(self.pieces)
        # short pieces are looked up by their packed code points, longer ones by one automaton
        self.finder, self.short = ahocorasick.Automaton(), []
        for k, p in enumerate(self.pieces):
            if len(p) > SHORT:
                self.finder.add_word(p, k)
        self.finder.make_automaton()
        for n in range(1, SHORT + 1):
            listed = sorted((packed(np.array(list(map(ord, p)), np.uint64), n)[0], k) for k, p in enumerate(self.pieces) if len(p) == n)
            if listed:
                self.short.append((n, np.array([x for x, _ in listed], np.uint64), np.array([k for _, k in listed], np.int64)))
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.ids, self.scores = np.array(list(self.pieces.values()), np.int64).reshape(-1, 2).T
        signs = {c for p in self.pieces for c in p if not c.isalnum() and c != MARK}
        glue = {x for p in self.pieces for x, c in zip(p, p[1:]) if c in signs and x not in signs and x != MARK}
        listed = lambda chars: "[" + "".join(re.escape(c) for c in sorted(chars)) + "]" if chars else "(?!)"
        sign, other = listed(signs), f"[^ \\n{MARK}{listed(signs)[1:-1]}]"
        word = f"{other}+(?:(?<={listed(glue)}){sign}+{other}*)*"
        self.unit = re.compile(f" +{sign}*(?:{word})?|{sign}+(?:{word})?|{word}|\\n|{MARK}")

    def spelt(self, character: str) -> tuple[int, tuple[int, ...]]:
        """Score and ids of a character in bytes."""
        raw = character.encode()
        return len(raw) * self.byte_score, tuple(self.byte_ids[b] for b in raw)

    def edges(self, text: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """For each position (end, score, ids) of the pieces that begin there."""
        out, begun, size = [], self.begun, len(text)
        for i, c in enumerate(text):
            here = []
            for end in range(i + 1, size + 1):
                found = begun.get(text[i:end], 0)
                if found:
                    here.append((end, found[1], (found[0],)))
                elif found == 0:
                    break
            if not here or here[0][0] != i + 1:  # a character that is no piece
                here.insert(0, (i + 1, *self.spelt(c)))
            out.append(here)
        return out

    def unit_edges(self, unit: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """The lattice of a unit; a mark that stands in the text itself is spelt in bytes."""
        return [[(1, *self.spelt(MARK))]] if unit == MARK else self.edges(unit.replace(" ", MARK))

    def solve(self, unit: str) -> tuple[tuple[int, ...], int, float]:
        """Best ids of a unit, their score, and how far its second best segmentation is behind (or infinite).

        One forward pass with the two best scores of every position.
        """
        if unit == MARK:
            score, ids = self.spelt(MARK)
            return ids, score, math.inf
        text, get, low = unit.replace(" ", MARK), self.begun.get, LOW
        size = len(text)
        best, second, back = [low] * (size + 1), [low] * (size + 1), [None] * (size + 1)
        best[0] = 0
        for i in range(size):
            top, next_top, first = best[i], second[i], i + 1
            for end in range(first, size + 1):
                found = get(text[i:end], 0)
                if found:
                    ids, score = found
                elif end == first:
                    score, ids = self.spelt(text[i])
                elif found is None:
                    continue
                else:
                    break
                value, old = top + score, best[end]
                if value > old:
                    other = next_top + score
                    second[end] = old if old > other else other
                    best[end] = value
                    back[end] = (i, ids)
                elif value > second[end]:
                    second[end] = value
        path, at = [], size
        while at:
            at, ids = back[at]
            if type(ids) is int:
                path.append(ids)
            else:
                path.extend(reversed(ids))
        path.reverse()
        return tuple(path), best[size], best[size] - second[size] if second[size] > LOW // 2 else math.inf

    def solve_all(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``solve`` for many units without line ends or marks: scores, losses, numbers of ids, and the ids in turn.

        One search finds all pieces in all units. The forward pass goes over the place where pieces end, longest
        pieces first, and takes all units at a time, each of which has at most one piece of that end and length.
        """
        if not units:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)
        text = "\n".join(units).replace(" ", MARK) + "\n"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, units), np.int64, len(units))
        owner = np.repeat(np.arange(len(units)), size + 1)
        begins = np.cumsum(size + 1) - size - 1
        found = np.fromiter(chain.from_iterable(self.finder.iter(text) if len(self.finder) else ()), np.int64).reshape(-1, 2)
        lasts, which = [found[:, 0]], [found[:, 1]]
        for n, keys, numbers in self.short:
            run = packed(points, n)
            slot = np.minimum(np.searchsorted(keys, run), len(keys) - 1)
            at = np.flatnonzero(keys[slot] == run)
            lasts.append(at + n - 1)
            which.append(numbers[slot[at]])
        last, piece = np.concatenate(lasts), np.concatenate(which)
        lone = points != 10
        lone[last[self.lengths[piece] == 1]] = False
        spelt = np.flatnonzero(lone)  # characters that are no piece, as negative numbers
        coded = 1 + (points[spelt] >= 0x80) + (points[spelt] >= 0x800) + (points[spelt] >= 0x10000)
        last = np.concatenate([last, spelt])
        length = np.concatenate([self.lengths[piece], np.ones(len(spelt), np.int64)])
        gain = np.concatenate([self.scores[piece], coded * self.byte_score])
        piece = np.concatenate([piece, -1 - points[spelt].astype(np.int64)])
        unit = owner[last]
        to = last - begins[unit] + 1
        wide = int(size.max()) + 1
        turn = to * wide - length
        order = np.argsort(turn, kind="stable")
        turn, length, gain, piece, unit, to = (x[order] for x in (turn, length, gain, piece, unit, to))
        target = unit * wide + to
        best, second = np.full(len(units) * wide, LOW), np.full(len(units) * wide, LOW)
        back = np.zeros(len(units) * wide, np.int64)
        best[np.arange(len(units)) * wide] = 0
        edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(turn)]
        for a, b in zip(edges, edges[1:]):
            at = target[a:b]
            start = at - length[a:b]
            value, other = best[start] + gain[a:b], second[start] + gain[a:b]
            old = best[at]
            better = value > old
            second[at] = np.where(better, np.maximum(old, other), np.maximum(second[at], value))
            best[at] = np.maximum(old, value)
            back[at[better]] = np.flatnonzero(better) + a
        whole = np.arange(len(units)) * wide + size
        loss = np.where(second[whole] > LOW // 2, best[whole] - second[whole], np.inf)
        going, place, taken = np.arange(len(units)), whole, []
        while len(going):
            edge = back[place]
            taken.append((going, place, piece[edge]))
            place = place - length[edge]
            more = place % wide > 0
            going, place = going[more], place[more]
        _, place, piece = (np.concatenate(x) for x in zip(*taken))
        order = np.argsort(place, kind="stable")
        piece, unit = piece[order], place[order] // wide
        flat = np.where(piece >= 0, self.ids[np.maximum(piece, 0)], 0)
        count = np.ones(len(piece), np.int64)
        rare = np.flatnonzero(piece < 0)
        codes, which = np.unique(-1 - piece[rare], return_inverse=True)
        spelt_ids = [self.spelt(chr(c))[1] for c in codes.tolist()]
        count[rare] = np.array([len(x) for x in spelt_ids], np.int64)[which] if len(rare) else 0
        flat = np.repeat(flat, count)
        if len(rare):
            places = np.repeat((np.cumsum(count) - count)[rare], count[rare])
            many = count[rare]
            flat[places + np.arange(len(places)) - np.repeat(np.cumsum(many) - many, many)] = list(
                chain.from_iterable(spelt_ids[k] for k in which.tolist())
            )
        return best[whole], loss, np.bincount(unit, count, len(units)).astype(np.int64), flat.astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation; the space put before every text is taken off again."""
        return b"".join([self.shown[i] for i in ids]).decode()[1:]


def forward(edges: list) -> list:
    """Viterbi: the best score up to each position."""
    best = [-math.inf] * (len(edges) + 1)
    best[0] = 0
    for i, here in enumerate(edges):
        for end, score, _ in here:
            best[end] = max(best[end], best[i] + score)
    return best


def search(edges: list, wanted: int) -> list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]:
    """The ``wanted`` best paths as (score, [(from, to, ids)]), best first, by A-star from the end.

    A partial path from a position to the end is worth its own score and the forward Viterbi score of the
    position, which is exactly the best that can still be added: partial paths come off the heap in the
    order of the best whole paths through them, and the k-th to reach the start is the k-th best. Of equal
    ones the path nearest to the start goes first, so ties are not all followed at once.
    """
    best = forward(edges)
    into: list[list] = [[] for _ in range(len(edges) + 1)]
    for i, here in enumerate(edges):
        for end, score, ids in here:
            into[end].append((i, score, ids))
    tick, out = 0, []
    heap = [(-best[len(edges)], len(edges), 0, 0, None)]
    while heap and len(out) < wanted:
        _, at, _, gained, path = heapq.heappop(heap)
        if not at:
            steps = []
            while path:
                steps.append(path[0])
                path = path[1]
            out.append((gained, steps))
            continue
        for i, score, ids in into[at]:
            tick += 1
            heapq.heappush(heap, (-(gained + score + best[i]), i, tick, gained + score, ((i, at, ids), path)))
    return out


class Encoder:
    """Segments texts unit by unit and remembers the units it has seen, up to a bound.

    Units have numbers; ``values``, ``behind``, ``first``, ``sizes`` and ``good`` tell by number a unit's score, the loss
    of its second best segmentation, where its ids lie in ``flat``, how many these are and whether they spell the unit.
    """

    def __init__(self, settings: Settings):
        self.settings = settings
        self.words = Vocabulary(settings.model)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.values, self.behind = np.zeros(0, np.int64), np.zeros(0)
        self.first, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.good, self.flat = np.zeros(0, bool), np.zeros(0, np.int32)

    def learn(self, units: set[str]) -> None:
        """Solve units that are not known; ordinary ones all at once, long ones each on its own."""
        if not units:
            return
        alone = [u for u in units if len(u) > self.settings.together or u in (MARK, "\n")]
        usual = list(units.difference(alone))
        values, behind, sizes, flat = self.words.solve_all(usual)
        solved = [self.words.solve(u) for u in alone]
        values = np.concatenate([values, np.array([v for _, v, _ in solved], np.int64)])
        behind = np.concatenate([behind, np.array([b for _, _, b in solved], float)])
        sizes = np.concatenate([sizes, np.array([len(i) for i, _, _ in solved], np.int64)])
        flat = np.concatenate([flat, np.array(list(chain.from_iterable(i for i, _, _ in solved)), np.int32)])
        usual += alone
        first = np.cumsum(sizes) - sizes
        told = list(map(self.words.shown.__getitem__, flat.tolist()))
        good = [True] * len(usual)
        spans = np.add.reduceat(np.fromiter(map(len, told), np.int64, len(told)), first)
        if "".join(usual).encode() != b"".join(told) or spans.tolist() != [len(u.encode()) for u in usual]:
            good = [b"".join(told[a:b]) == u.encode() for u, a, b in zip(usual, first.tolist(), (first + sizes).tolist())]
        self.known.update(zip(usual, range(len(self.values), len(self.values) + len(usual))))
        self.first = np.concatenate([self.first, first + len(self.flat)])
        for name, more in (("values", values), ("behind", behind), ("sizes", sizes), ("good", np.array(good, bool)), ("flat", flat)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))

    def encode(self, text: str) -> tuple[list[int], list[float], list[list[tuple[int, int, list[int]]]]]:
        """Best ids, scores of the best segmentations, and of each the (first, end, ids) that replace some best ids."""
        ids, scores, swaps, _ = next(self.encode_all([text]))
        return ids.tolist(), scores, swaps

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[float], list, bool]]:
        """For each text the results of ``encode`` and whether all its segmentations spell it.

        Texts are worked on in parts of about ``part`` characters, many short texts or a part of a long one at a time.
        """
        held, size, made = [], 0, [Found(self.settings.best - 1) for _ in texts]
        done = 0
        for i, text in enumerate(texts):
            for part in parts(" " + text, self.settings.part):
                held.append((i, part))
                size += len(part)
                if size >= self.settings.part:
                    self._add(held, made)
                    held, size = [], 0
            if not held:
                for k in range(done, i + 1):
                    yield self._finish(made[k])
                    made[k] = None
                done = i + 1
        self._add(held, made)
        for k in range(done, len(texts)):
            yield self._finish(made[k])

    def _add(self, held: list[tuple[int, str]], made: list[Found]) -> None:
        cut = [self.words.unit.findall(part) for _, part in held]
        told = [np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units)) for units in cut]
        self.learn({units[k] for units, numbers in zip(cut, told) for k in np.flatnonzero(numbers < 0).tolist()})
        for (i, part), units, numbers in zip(held, cut, told):
            new = np.flatnonzero(numbers < 0)
            numbers[new] = [self.known[units[k]] for k in new.tolist()]
            sizes = self.sizes[numbers]
            starts = np.cumsum(sizes) - sizes
            ids = self.flat[np.repeat(self.first[numbers] - starts, sizes) + np.arange(int(sizes.sum()))]
            good = bool(self.good[numbers].all()) and "".join(units) == part
            made[i].add(units, ids, starts, sizes, self.values[numbers], self.behind[numbers], good)
        if len(self.known) > self.settings.remembered or len(self.flat) > 16 * self.settings.remembered:
            self.forget()

    def _finish(self, found: Found) -> tuple[np.ndarray, list[float], list, bool]:
        """Only the units with the ``best - 1`` smallest losses to their second best segmentation can differ in
        the wanted segmentations: a difference elsewhere costs more than each of these does alone. The search runs
        over the lattice of these units joined; all others keep their best pieces.
        """
        ids, good = np.concatenate(found.ids), found.good
        chosen = sorted(found.closest, key=lambda c: c[1])
        if not chosen:
            return ids, [found.total / UNITS], [[]], good
        joined, borders = [], []
        for _, _, unit, _, _ in chosen:
            shift = len(joined)
            joined += [[(e + shift, s, i) for e, s, i in here] for here in self.words.unit_edges(unit)]
            borders.append((shift, len(joined)))
        rest = found.total - sum(value for *_, value in chosen)
        scores, swaps = [], []
        for score, steps in search(joined, self.settings.best):
            scores.append((rest + score) / UNITS)
            mine = []
            for (_, first, unit, own, _), (low, high) in zip(chosen, borders):
                new = [x for a, _, i in steps if low <= a < high for x in i]
                if new != own:
                    mine.append((first, first + len(own), new))
                    good &= b"".join([self.words.shown[x] for x in new]) == unit.encode()
            swaps.append(mine)
        # of equally good segmentations the first found takes the place of the one in ``ids``
        return ids, scores, swaps, good


class Found:
    """What is known of a text from its parts so far: ids, score, and the units closest to another segmentation."""

    def __init__(self, most: int):
        self.most, self.ids, self.count, self.total, self.good = most, [], 0, 0, True
        self.closest: list[tuple] = []

    def add(self, units: list[str], ids, starts, sizes, values, behind, good: bool) -> None:
        if self.most:
            at = np.argpartition(behind, self.most)[: self.most] if len(behind) > self.most else np.arange(len(behind))
            for k in at[np.isfinite(behind[at])].tolist():
                a, b = int(starts[k]), int(starts[k] + sizes[k])
                self.closest.append((float(behind[k]), self.count + a, units[k], ids[a:b].tolist(), int(values[k])))
            self.closest = sorted(self.closest, key=lambda c: c[:2])[: self.most]
        self.ids.append(ids)
        self.count += len(ids)
        self.total += int(values.sum())
        self.good &= good


def parts(text: str, size: int) -> Iterator[str]:
    """Cut a text into parts of ``size`` characters or more, each but the last ending before a run of spaces: no unit lies across."""
    start = 0
    while start < len(text):
        end = text.find(" ", start + size)
        while end > 0 and text[end - 1] == " ":
            end -= 1
        if end <= start:  # no space, or the run in which the part begins reaches that far
            found = RUN.search(text, start + size)
            end = found.end() - 1 if found else len(text)
        yield text[start:end]
        start = end


def swapped(ids: list[int], swaps: list[tuple[int, int, list[int]]]) -> list[int]:
    """A segmentation from the best one and what replaces parts of it."""
    out, at = [], 0
    for first, end, new in swaps:
        out += ids[at:first] + list(new)
        at = end
    return out + ids[at:]


def segmentations(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, ids, scores, swaps, round_trip), one row for each row of ``docs(doc_id, text)``.

    ``ids``: a best segmentation; ``scores``: of the ``best`` best ones, best first, fewer where a text
    has fewer; ``swaps``: for each of these the (first, end, ids) that replace ``ids[first:end]``, see
    ``swapped``; ``round_trip``: whether all of them decode to the text. A null text counts as empty and, as every text
    begins with a space, has the piece of that. Repeated rows give repeated rows, a null doc_id stays
    null, an empty table gives an empty result; other columns are not read.
    """
    swap = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(settings)
        for batch in batches:
            for part, _ in slices(batch, 1):
                found = list(encoder.encode_all(text_list(part.column(1))))
                ids, scores, swaps, good = zip(*found)
                lengths = np.cumsum([0, *map(len, ids)])
                flat = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(ids)))
                told = [[[dict(zip(("first", "end", "ids"), s)) for s in mine] for mine in changes] for changes in swaps]
                yield batch_of(
                    [
                        ("doc_id", part.column(0), None), ("ids", flat, None), ("scores", scores, pa.list_(pa.float64())),
                        ("swaps", told, pa.list_(pa.list_(swap))), ("round_trip", good, pa.bool_()),
                    ]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, scores array<double>, swaps array<array<struct<first:int,end:int,ids:array<int>>>>, round_trip boolean"
    )


def decoded(coded: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, text) of a table with doc_id and ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(settings.model)
        for batch in batches:
            texts = [None if x is None else words.decode(x) for x in batch.column(1).to_pylist()]
            yield batch_of([("doc_id", batch.column(0), None), ("text", texts, pa.string())])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, text string"
    )
