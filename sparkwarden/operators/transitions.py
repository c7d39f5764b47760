"""Applying logged state changes to the backlog.

Each request is a function from states to states, and functions compose. So the log is cut into ranges of
(id, ts, seq, new_state); every range composes its own requests without knowing what came before, and the
composed functions of the ranges before give each range the state it starts from. An id with most of the
log is spread over ranges like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.operators.backlog import STATES
from sparkwarden.session import cut_lineage

# Which states may follow which.
ALLOWED_TRANSITIONS = {
    "detected": ("candidate", "rejected"),
    "candidate": ("validated", "rejected"),
    "validated": ("planned", "rejected"),
    "planned": ("rejected",),
    "rejected": (),
}

# states a request finds: the five known ones, another one, or no proposal at all
OTHER, ABSENT = len(STATES), len(STATES) + 1
WIDTH = len(STATES) + 2
# bits of a state in a packed function
BITS = 3
_OWN = ("_code", "_id", "_mark", "_text")


def may_follow(state: Column, new_state: Column) -> Column:
    """Whether a state may change into another; nothing follows an unknown state."""
    table = F.create_map(
        *[
            part
            for name, after in ALLOWED_TRANSITIONS.items()
            for part in (F.lit(name), F.array(*[F.lit(s) for s in after]).cast("array<string>"))
        ]
    )
    return F.coalesce(F.array_contains(F.try_element_at(table, state), new_state), F.lit(False))


def _functions() -> np.ndarray:
    """Row k: what a request for the k-th state does; then one that changes nothing; then one row per state that sets it."""
    rows = []
    for name in STATES:
        rows.append([STATES.index(name) if s in STATES and name in ALLOWED_TRANSITIONS[s] else i for i, s in enumerate((*STATES, None, None))])
    rows.append(list(range(WIDTH)))
    rows += [[state] * WIDTH for state in range(WIDTH)]
    return np.array(rows, np.uint8)


NOTHING = len(STATES)
SETS = NOTHING + 1


def prefixes(functions: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Row i: the functions of its group up to row i, one after the other. ``place`` counts rows within a group.

    Parallel prefix: in step d every row takes in the d rows before it, as a whole, until groups are covered.
    """
    out, step = functions.copy(), 1
    longest = int(place.max(initial=0))
    while step <= longest:
        rows = np.flatnonzero(place >= step)
        out[rows] = np.take_along_axis(out[rows], out[rows - step], 1)
        step *= 2
    return out


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add to each row of a sorted range the packed function of its id's rows before, from the start of the range.

    ``_other`` is the unknown state that the id started from, if that is in the range; ``_after`` is the function
    after the last row of the range, null elsewhere.
    """
    table = _functions()
    shifts = BITS * np.arange(WIDTH)
    # of the last row: its id, its key, the functions before and after it, the text of its start
    last_id = last_mark = last_text = None
    before = after = np.arange(WIDTH, dtype=np.uint8)
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, ids, marks = (batch.column(c).to_numpy() for c in ("_code", "_id", "_mark"))
        rows = np.arange(len(ids))
        begins = np.r_[True, ids[1:] != ids[:-1]]
        first = np.maximum.accumulate(np.where(begins, rows, 0))
        ends = prefixes(table[codes], rows - first)
        if last_id is not None and ids[0] == last_id:
            own = first == 0
            ends[own] = ends[own][:, after]
        else:
            last_mark, last_text, after = None, None, np.arange(WIDTH, dtype=np.uint8)
        starts = np.r_[after[None], ends[:-1]]
        starts[begins & (rows > 0)] = np.arange(WIDTH)
        # requests with equal keys are one request: they find the same state
        again = np.r_[last_mark is not None and marks[0] == last_mark, marks[1:] == marks[:-1]]
        if again[0]:
            starts[0] = before
        starts = starts[np.maximum.accumulate(np.where(again, 0, rows))]
        # a start stands first among the rows of its id
        texts = batch.column("_text").take(pa.array(first)).to_pylist()
        if last_text is not None:
            texts = [last_text if k == 0 else t for k, t in zip(first.tolist(), texts)]
        if held is not None:
            yield held
        packed = (starts.astype(np.int64) << shifts).sum(1).astype(np.int32)
        held = batch.select([c for c in batch.schema.names if c not in _OWN[1:]])
        for name, values in (("_function", pa.array(packed)), ("_other", pa.array(texts, pa.string())), ("_after", pa.nulls(len(rows), pa.int32()))):
            held = held.append_column(name, values)
        last_id, last_mark, last_text, before, after = ids[-1], marks[-1], texts[-1], starts[-1], ends[-1]
    if held is not None:
        final = int((after.astype(np.int64) << shifts).sum())
        at = held.schema.get_field_index("_after")
        yield held.set_column(at, "_after", pa.array([None] * (held.num_rows - 1) + [final], pa.int32()))


def _carried(ends: list) -> list[tuple]:
    """(slice, id, state, other): the state that each range's first id comes with from the ranges before."""
    out, reached, other, before = [], ABSENT, None, None
    for end in sorted(ends, key=lambda e: e["_slice"]):
        if before is not None:
            out.append((end["_slice"], before, reached, other))
        # a range that ends with another id starts anew
        if end["id"] != before:
            reached, other = ABSENT, None
        reached = end["_after"] >> (BITS * reached) & ((1 << BITS) - 1)
        before, other = end["id"], end["_other"] if end["_other"] is not None else other
    return out


def judge_requests(backlog: DataFrame, log: DataFrame) -> DataFrame:
    """Every request of ``log(id, ts, seq, new_state, reason)`` with its outcome.

    Requests of one id apply in (ts, seq, new_state) order; requests that repeat all three are one and
    the same and get the same outcome. Output adds from_state, accepted and refusal (invalid_state, not_found
    or not_allowed). Ids are those of ``backlog``, each once; a request without id is not found.

    The states of the backlog go into the same range exchange as the requests, each before those of its id. Ranges are
    stored; of each only the last row's function comes to the driver, as only an id that ends a range goes on in the next.
    """
    spark = log.sparkSession
    number = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("new_state")).cast("int") - 1
    asked = log.select(
        "*", F.coalesce(F.when(number >= 0, number), F.lit(NOTHING)).alias("_code"), 
        F.xxhash64("id", "ts", "seq", "new_state", *[F.col(c).isNull() for c in ("ts", "seq", "new_state")]).alias("_mark"), F.lit(None).cast("string").alias("_text"),
    )
    state = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state")).cast("int") - 1
    known = backlog.filter(F.col("id").isNotNull()).select(
        *[(F.col("id") if f.name == "id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in log.schema],
        (SETS + F.coalesce(F.when(state >= 0, state), F.lit(OTHER))).alias("_code"), F.xxhash64("id").alias("_mark"), F.col("state").alias("_text"),
    )
    order = ["id", (F.col("_code") < SETS), "ts", "seq", "new_state"]
    rows = asked.unionByName(known).withColumn("_id", F.xxhash64("id")).repartitionByRange(*order).sortWithinPartitions(*order)
    kept = [f for f in rows.schema if f.name not in _OWN[1:]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", _function int, _other string, _after int"
    stored = cut_lineage(rows.mapInArrow(_compose, schema).withColumn("_slice", F.spark_partition_id()))
    # one row for each range
    ends = stored.filter(F.col("_after").isNotNull()).select("_slice", "id", "_after", "_other").collect()
    kind = log.schema["id"].dataType.simpleString()
    carry = spark.createDataFrame([c for c in _carried(ends) if c[1] is not None], f"_from int, _cid {kind}, _state int, _text string")
    comes = (F.col("_slice") == F.col("_from")) & (F.col("id") == F.col("_cid"))
    requests = stored.filter(F.col("_code") < SETS).join(F.broadcast(carry), comes, "left")
    found = F.expr(f"shiftright(_function, {BITS} * coalesce(_state, {ABSENT})) & {(1 << BITS) - 1}")
    named = F.array(*[F.lit(s) for s in STATES], F.coalesce("_other", "_text"))
    judged = requests.withColumn("_found", found).withColumn("from_state", F.when(F.col("_found") < ABSENT, F.get(named, F.col("_found"))))
    refusal = (
        F.when(~F.coalesce(F.col("new_state").isin(*STATES), F.lit(False)), "invalid_state")
        .when(F.col("_found") == ABSENT, "not_found")
        .when(~may_follow(F.col("from_state"), F.col("new_state")), "not_allowed")
    )
    return judged.select(
        *log.columns, "from_state", refusal.isNull().alias("accepted"), refusal.alias("refusal")
    )


def move_states(backlog: DataFrame, judged: DataFrame) -> DataFrame:
    """The backlog after the accepted requests: last state reached and when.

    Outcomes stored per micro-batch carry ``batch_id``, which then goes before the time.
    """
    order = F.struct(*[c for c in ("batch_id", "ts", "seq") if c in judged.columns])
    last = (
        judged.filter("accepted")
        .groupBy("id")
        .agg(F.max_by("new_state", order).alias("_state"), F.max_by("ts", order).alias("_at"))
    )
    return backlog.join(last, "id", "left").select(
        *[
            F.coalesce("_state", "state").alias(c)
            if c == "state"
            else F.coalesce("_at", "updated_at").alias(c)
            if c == "updated_at"
            else F.col(c)
            for c in backlog.columns
        ]
    )
