"""Repair of conversation structure: the cheapest edits, by a Viterbi search that converges in parallel chunks.

A conversation's rows, in order of turn, shall end up with the roles ``(system? (user assistant)+)?``. Keeping a row
costs 0, another role 3, deletion 4 (blank and duplicate rows must go), an inserted empty row 3, a row left in
although its text is cut off 3 more. Costs to go are vectors over the four states (nothing yet, after system, after
user, after assistant). Rows lie in global order (conversation, turn, role, text) over range partitions, so a
conversation of any length is many segments in many tasks, and a segment many chunks, which numpy takes side by side.
Every chunk starts at its right end from a speculative vector; fix-up passes rerun chunks from the vector their right
neighbour found, back to the row where old and new vectors differ by a constant only, until no chunk's start vector
was wrong. Segments do the same over Spark joins. Tracing follows the stitched costs from all four states at once,
the least edit first (ASCII order), and chunks and segments are then chained by composing those four end states.

Skew: rows equal in conversation, turn, role and text are one counted row before any shuffle by order; first
occurrences of (role, text) are a combined minimum and a join that AQE can split; a conversation of a third of all
rows is split into segments. Its list of edits and the digest of its repaired text are one value, so ``repaired``
streams the rows of a conversation through one task, in memory that holds a batch of rows and that list.

Defined cases: a null role or text is one space; null turns come first and are no gap; rows of equal turn are ordered
by role and by the digest of their text; rows that repeat all count, the later ones as duplicates; a null conversation
id is a conversation of its own; a conversation of absent rows only has zeros, no edits and an empty text; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatmod.llm.frames import cut
from chatmod.llm.spans import frugal
from chatmod.session import bounded_broadcast

# Costs of the edits
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)           # states, and 1 to 3 also a row's role (0: another role)
AFTER_INSERT = np.array([USER, USER, ASSISTANT, USER])
GOAL = np.array([0, 2 * INSERT, INSERT, 0], np.int32)    # cost to go after the last row
CHUNK = 32                  # rows of a chunk
SEGMENT = 1 << 14           # rows of a segment
ID, SPACE, MARKS = "conv_id", r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def step(role: np.ndarray, late: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs to go before rows of ``role`` from those after them (a row of four for each); late: 3 if cut off."""
    stay = DELETE + after
    to_user = after[:, USER] + late + REROLE * (role != USER)
    to_assistant = after[:, ASSISTANT] + late + REROLE * (role != ASSISTANT)
    out = np.empty_like(after)
    out[:, START] = np.minimum(stay[:, START], to_user)
    out[:, SYSTEM] = np.minimum(stay[:, SYSTEM], to_user)
    out[:, ASSISTANT] = np.minimum(stay[:, ASSISTANT], to_user)
    out[:, USER] = np.minimum(stay[:, USER], to_assistant)
    keep = role == SYSTEM
    out[keep, START] = np.minimum(out[keep, START], late[keep] + after[keep, SYSTEM])
    user = np.minimum(out[:, USER], INSERT + out[:, ASSISTANT])
    out[:, ASSISTANT] = np.minimum(out[:, ASSISTANT], INSERT + out[:, USER])
    out[:, USER] = user
    out[:, START] = np.minimum(out[:, START], INSERT + user)
    out[:, SYSTEM] = np.minimum(out[:, SYSTEM], INSERT + user)
    return out


class Chunks:
    """The rows of some segments, in chunks that run side by side.

    ``costs[i]`` is the cost to go before row i and ``right[c]`` that after chunk c, both up to one constant per chunk;
    ``left[s]`` is that before segment s."""

    def __init__(self, role: np.ndarray, late: np.ndarray, bounds: np.ndarray, right: np.ndarray, chunk: int = CHUNK):
        self.role, self.late = role, late
        size = np.diff(bounds)
        number = np.maximum(1, -(-size // chunk))
        self.segment = np.repeat(np.arange(len(size)), number)
        self.first = np.cumsum(number) - number             # first chunk of every segment
        self.place = np.arange(len(self.segment)) - self.first[self.segment]
        self.lo = bounds[:-1][self.segment] + self.place * chunk
        self.hi = np.minimum(self.lo + chunk, bounds[1:][self.segment])
        last = self.place == number[self.segment] - 1
        self.right = np.where(last[:, None], right[self.segment], GOAL).astype(np.int32)
        self.costs = np.zeros((len(role), 4), np.int32)
        start = self.right.copy()
        self._run(np.arange(len(self.lo)), start, fresh=True)
        self.passes = 0
        inner = np.flatnonzero(~last)
        while len(inner):
            shift = start[inner + 1] - self.right[inner]
            wrong = inner[(shift != shift[:, :1]).any(axis=1)]
            if not len(wrong):
                break
            self.passes += 1
            self.right[wrong] = start[wrong + 1]
            self._run(wrong, start, fresh=False)
        self.left = start[self.first]

    def _run(self, chunks: np.ndarray, start: np.ndarray, fresh: bool) -> None:
        """Costs of ``chunks`` from their right ends, until old and new ones differ by a constant."""
        vectors = self.right[chunks]
        row = self.hi[chunks] - 1
        if fresh:
            start[chunks] = vectors
        while True:
            live = row >= self.lo[chunks]
            if not live.all():
                start[chunks[~live]] = vectors[~live]
                chunks, vectors, row = chunks[live], vectors[live], row[live]
            if not len(chunks):
                return
            vectors = step(self.role[row], self.late[row], vectors)
            if not fresh:
                shift = vectors - self.costs[row]
                same = (shift == shift[:, :1]).all(axis=1)
                for c, r, by in zip(chunks[same].tolist(), row[same].tolist(), shift[same, 0].tolist()):
                    self.costs[self.lo[c]:r + 1] += by
                    start[c] += by
                chunks, vectors, row = chunks[~same], vectors[~same], row[~same]
            self.costs[row] = vectors
            row = row - 1

    def trace(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edits from each of the four states before a chunk: (inserts before each row, edit of each row, state after each
        chunk). The first of D, I, K, R that the costs allow is the least."""
        inserts = np.zeros((4, len(self.role)), np.uint8)
        edits = np.zeros((4, len(self.role)), np.uint8)
        state = np.tile(np.arange(4), (len(self.lo), 1))
        live = np.arange(len(self.lo))
        row = self.lo.copy()
        while True:
            live = live[row[live] < self.hi[live]]
            if not len(live):
                return inserts, edits, state
            at = row[live]
            inner = at + 1 < self.hi[live]
            after = np.where(inner[:, None], self.costs[np.minimum(at + 1, len(self.costs) - 1)], self.right[live])
            before, role, late = self.costs[at], self.role[at], self.late[at]
            every = np.arange(len(live))
            for q in range(4):
                s = state[live, q]
                for _ in range(2):
                    put = (before[every, s] != DELETE + after[every, s]) & (before[every, s] == INSERT + before[every, AFTER_INSERT[s]])
                    inserts[q, at] += put
                    s = np.where(put, AFTER_INSERT[s], s)
                target = AFTER_INSERT[s]
                drop = before[every, s] == DELETE + after[every, s]
                first = ~drop & (role == SYSTEM) & (s == START) & (before[every, s] == late + after[:, SYSTEM])
                keep = ~drop & (first | (role == target) & (before[every, s] == late + after[every, target]))
                edits[q, at] = np.where(drop, ord("D"), np.where(keep, ord("K"), ord("R")))
                state[live, q] = np.where(drop, s, np.where(first, SYSTEM, target))
            row[live] += 1

    def chain(self, ends: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state before every chunk, state after every segment) if segments begin in ``states``."""
        begin = np.zeros(len(self.lo), np.int64)
        state = states.copy()
        for k in range(int(self.place.max(initial=-1)) + 1):
            c = np.flatnonzero(self.place == k)
            begin[c] = state[self.segment[c]]
            state[self.segment[c]] = ends[c, begin[c]]
        return begin, state


# -- rows in order, and their segments ------------------------------------------------------------------------------

def counted(rows: DataFrame, turn: str = "turn", role: str = "role", text: str = "text", absent: Column | None = None,
            copies: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, digest, blank, cut_off, n): equal rows counted, without their texts. ``absent`` rows only say
    that their conversation exists; ``copies`` is how often a row occurs (default 1)."""
    text_of = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    absent = F.lit(False) if absent is None else absent
    plain = rows.select(
        F.col(ID).alias("c"), F.when(~absent, F.col(turn).cast("long")).alias("t"),
        F.when(~absent, F.coalesce(F.col(role).cast("string"), F.lit(" "))).alias("r"),
        F.when(~absent, digest(text_of)).alias("d"),
        (~F.regexp_like(text_of, F.lit(SPACE))).alias("blank"), (~F.regexp_like(text_of, F.lit(MARKS))).alias("cut_off"),
        F.when(absent, F.lit(0)).otherwise(F.lit(1) if copies is None else copies).cast("long").alias("n"))
    return plain.groupBy("c", "t", "r", "d").agg(F.first("blank").alias("blank"), F.first("cut_off").alias("cut_off"), F.sum("n").alias("n"))


def digest(text: Column) -> Column:
    """What texts are told apart by: half of their SHA-256."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def _ordered(rows: DataFrame) -> DataFrame:
    """The counted rows with ``again`` (the role and text occur at an earlier turn), in range partitions."""
    first = rows.groupBy("c", "r", "d").agg(F.max(F.col("t").isNull()).alias("none"), F.min("t").alias("least"))       # null turns come first
    first = first.select(F.col("c").alias("c1"), F.col("r").alias("r1"), F.col("d").alias("d1"), F.when(~F.col("none"), F.col("least")).alias("t1"))
    same = F.col("c").eqNullSafe(F.col("c1")) & F.col("r").eqNullSafe(F.col("r1")) & F.col("d").eqNullSafe(F.col("d1"))
    # one row for each row of the left side at most, so a partition's hash table is no larger than its share
    marked = rows.join(first.hint("shuffle_hash"), same).select("c", "t", "r", "d", "blank", "cut_off", "n", (~F.col("t").eqNullSafe(F.col("t1"))).alias("again"))
    marked = cut(marked)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return marked.repartitionByRange(parts, "c", "t", "r", "d").sortWithinPartitions("c", "t", "r", "d")


NEIGHBOURS = 100_000        # segments told to their neighbours by a broadcast up to this many, by a shuffle beyond
_COUNTS = ["total", "blank", "duplicate", "truncated", "illegal", "distinct_turns"]
_SEGMENT = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("min_turn", pa.int64()), ("max_turn", pa.int64()),
                      ("first_role", pa.string()), ("last_role", pa.string()),
                      ("rows", pa.binary()), ("gone", pa.binary()), ("edge", pa.bool_())])


def _ddl(schema: pa.Schema, conv_type: str) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {conv_type if f.name == ID else kinds[f.type]}" for f in schema)


def _segments(limit: int, conv_type: pa.DataType):
    """Runs of rows of one conversation, as one record each: a byte per row that may stay (its role and whether it is cut
    off) and the number of rows that must go before each and at the end. ``edge``: the conversation may go on elsewhere, as
    only the first and the last of a partition and those cut at ``limit`` can."""
    schema = _SEGMENT.set(0, pa.field(ID, conv_type))

    def records(table: pa.Table, number: int, end: bool) -> pa.RecordBatch:
        n = table.num_rows
        codes = table.column("c").combine_chunks()
        code = np.array(codes.dictionary_encode().indices.fill_null(-1), np.int64)
        turn_known = np.array(table.column("t").is_valid(), bool)
        turn = np.array(table.column("t").fill_null(0), np.int64)
        times = np.array(table.column("n"), np.int64)
        blank, late, again = (np.array(table.column(x), bool) for x in ("blank", "cut_off", "again"))
        initial = [r[:1] if r is not None else "" for r in table.column("r").to_pylist()]
        role = np.array([{"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(x, 0) for x in initial], np.uint8)
        real = times > 0
        new = np.ones(n, bool)
        new[1:] = code[1:] != code[:-1]
        at = np.arange(n)
        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % limit == 0
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], n)
        seg = np.cumsum(new) - 1
        total = lambda x: np.bincount(seg, x, len(lo)).astype(np.int64)
        duplicate = np.where(blank, 0, times - 1 + again)
        stays = real & ~blank & ~again
        pair = np.zeros(n, bool)            # a row and the one before it in its segment: a legal change of role
        before = np.concatenate([[0], role[:-1]])
        legal = (before == SYSTEM) & (role == USER) | (before == USER) & (role == ASSISTANT) | (before == ASSISTANT) & (role == USER)
        pair[1:] = (seg[1:] == seg[:-1]) & real[1:] & real[:-1]
        illegal = np.where(real, times - 1, 0) + (pair & ~legal)
        other = real & turn_known
        other[1:] &= ~((seg[1:] == seg[:-1]) & turn_known[:-1] & real[:-1] & (turn[1:] == turn[:-1]))
        gone = np.where(real, times, 0) - stays
        packed = (role | (late.astype(np.uint8) << 2))
        edge = np.zeros(len(lo), bool)
        edge[1:] = code[lo[1:]] == code[lo[:-1]]            # cut at the limit
        edge[:-1] |= edge[1:]
        edge[0] |= number & 0xFFFFFFFFFF == 0
        edge[-1] |= end
        out = {c: [] for c in ("min_turn", "max_turn", "first_role", "last_role", "rows", "gone")}
        for a, b in zip(lo.tolist(), hi.tolist()):
            live = np.flatnonzero(real[a:b]) + a
            turns = live[turn_known[live]]
            out["min_turn"].append(int(turn[turns[0]]) if len(turns) else None)
            out["max_turn"].append(int(turn[turns[-1]]) if len(turns) else None)
            out["first_role"].append(initial[live[0]] if len(live) else None)
            out["last_role"].append(initial[live[-1]] if len(live) else None)
            keep = np.flatnonzero(stays[a:b]) + a
            # a row's further copies come after it
            sums = np.concatenate([[0], np.cumsum(gone[a:b])])
            marks = np.concatenate([[0], sums[keep - a], sums[-1:]])
            out["rows"].append(packed[keep].tobytes())
            out["gone"].append(np.diff(marks).astype("<i8").tobytes())
        columns = {ID: codes.take(pa.array(lo)), "part": np.arange(len(lo)) + number, "total": total(np.where(real, times, 0)),
                   "blank": total(np.where(blank & real, times, 0)), "duplicate": total(np.where(real, duplicate, 0)),
                   "truncated": total(stays & late), "illegal": total(illegal), "distinct_turns": total(other), "edge": edge, **out}
        return pa.RecordBatch.from_pydict({f.name: pa.array(columns[f.name], f.type) if f.name != ID else columns[ID] for f in schema}, schema=schema)

    @frugal
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held, went_on = None, False
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            # the last conversation may go on in the next batch
            c = table.column("c").combine_chunks().dictionary_encode().indices.fill_null(-1)
            c = np.array(c, np.int64)
            end = len(c) - int(np.argmax(c[::-1] != c[-1])) if len(c) and (c != c[-1]).any() else 0
            whole = not end and len(c) >= limit         # and its conversation goes on
            if whole:
                end = len(c)
            if end:
                out = records(table.slice(0, end), number, whole)
                if went_on:
                    out = out.set_column(out.schema.get_field_index("edge"), "edge", pa.array([True] + out.column("edge").to_pylist()[1:]))
                went_on = whole
                number += out.num_rows
                yield out
            held = table.slice(end)
        if held is not None and held.num_rows:
            yield records(held, number, True)

    return segments


_KEPT = [*_COUNTS, "min_turn", "max_turn", "first_role", "role_before", "turn_before"]
_EDITED = pa.schema([(ID, pa.int64()), ("place", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("min_turn", pa.int64()),
                     ("max_turn", pa.int64()), ("first_role", pa.string()), ("role_before", pa.string()), ("turn_before", pa.int64())])


# -- solving ----------------------------------------------------------------------------------------------------------

def _solve(work, schema: pa.Schema, limit: int = 1 << 18):
    """A function over record batches with ``rows`` and ``after``: ``work`` on slices of bounded size."""
    @frugal
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x.as_py()) for x in batch.column("rows")], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes + 1)])
            lo = 0
            while lo < len(sizes):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
                part = batch.slice(lo, hi - lo)
                data = np.frombuffer(b"".join(part.column("rows").to_pylist()), np.uint8)
                after = np.array(part.column("after").to_pylist(), np.int32).reshape(-1, 4)
                bounds = np.concatenate([[0], np.cumsum(sizes[lo:hi])])
                yield work(part, Chunks(data & 3, (data >> 2).astype(np.int32) * CUT_OFF, bounds, after), schema)
                lo = hi

    return solve


def _before(part: pa.RecordBatch, chunks: Chunks, schema: pa.Schema) -> pa.RecordBatch:
    """The vector before every segment, least entry 0."""
    left = chunks.left - chunks.left.min(axis=1, keepdims=True)
    return pa.RecordBatch.from_arrays([part.column(ID), part.column("place"), pa.array(left.tolist(), pa.list_(pa.int32()))], schema=schema)


def _ends(part: pa.RecordBatch, chunks: Chunks, schema: pa.Schema) -> pa.RecordBatch:
    """The state after every segment for each state before it."""
    _, _, state = chunks.trace()
    ends = [chunks.chain(state, np.full(part.num_rows, q))[1] for q in range(4)]
    return pa.RecordBatch.from_arrays([part.column(ID), part.column("place"), pa.array(np.stack(ends, axis=1).tolist(), pa.list_(pa.int32()))], schema=schema)


def _edits(part: pa.RecordBatch, chunks: Chunks, schema: pa.Schema) -> pa.RecordBatch:
    """The edits of every segment as text, and their cost."""
    inserts, edits, state = chunks.trace()
    begin, end = chunks.chain(state, np.array(part.column("state"), np.int64))
    of_row = np.repeat(begin, chunks.hi - chunks.lo)
    every = np.arange(len(of_row))
    put, edit = inserts[of_row, every].astype(np.int64), edits[of_row, every]
    audits, costs = [], []
    last = part.column("last").to_pylist()
    row = 0
    for i, gone in enumerate(part.column("gone").to_pylist()):
        gone = np.frombuffer(gone, "<i8")
        n = len(gone) - 1
        own = slice(row, row + n)
        tail = int(GOAL[end[i]]) // INSERT if last[i] else 0
        counts = np.stack([gone, np.append(put[own], tail), np.append(np.ones(n, np.int64), 0)], axis=1).ravel()
        signs = np.stack([np.full(n + 1, ord("D"), np.uint8), np.full(n + 1, ord("I"), np.uint8), np.append(edit[own], 0).astype(np.uint8)], axis=1).ravel()
        audits.append(np.repeat(signs, counts).tobytes().decode("ascii"))
        own_edit = edit[own]
        costs.append(int(DELETE * (gone.sum() + (own_edit == ord("D")).sum()) + INSERT * (put[own].sum() + tail) + REROLE * (own_edit == ord("R")).sum()
                         + chunks.late[own][own_edit != ord("D")].sum()))
        row += n
    made = {"audit": pa.array(audits, pa.string()), "cost": pa.array(costs, pa.int64())}
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else part.column(f.name).cast(f.type) for f in schema], schema=schema)


def _vector(values) -> Column:
    return F.array(*[F.lit(int(v)).cast("int") for v in values])


def _is_next(a: str, b: str, by: int) -> Column:
    return F.col(f"{a}.{ID}").eqNullSafe(F.col(f"{b}.{ID}")) & (F.col(f"{a}.place") == F.col(f"{b}.place") - by)


def _settled(parts: DataFrame, conv: str) -> DataFrame:
    """``parts`` (segments of conversations of several) with ``after``, the vector after each: fix-up passes over joins."""
    schema = pa.schema([(ID, pa.int64()), ("place", pa.int32()), ("before", pa.list_(pa.int32()))])
    ddl = f"{ID} {conv}, place int, before array<int>"
    found = None
    now = parts.withColumn("after", _vector(GOAL)).withColumn("wrong", F.lit(True))
    while True:
        run = now.where("wrong").select(ID, "place", "rows", "after").mapInArrow(_solve(_before, _arrow(schema, now)), ddl)
        found = cut(run if found is None else found.alias("f").join(
            bounded_broadcast(run, NEIGHBOURS).alias("r"), _is_next("f", "r", 0), "left").select(f"f.{ID}", "f.place", F.coalesce("r.before", "f.before").alias("before")))
        joined = now.alias("a").join(bounded_broadcast(found, NEIGHBOURS).alias("b"), _is_next("a", "b", 1), "left")
        told = F.when(F.col("a.last"), F.col("a.after")).otherwise(F.col("b.before"))
        wrong = F.transform("a.after", lambda x: x - F.array_min("a.after")) != F.transform(told, lambda x: x - F.array_min(told))
        now = cut(joined.select(*[F.col(f"a.{c}") for c in parts.columns], told.alias("after"), wrong.alias("wrong")))
        if now.where("wrong").isEmpty():
            return now.drop("wrong")


def _arrow(schema: pa.Schema, frame: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return schema.set(0, pa.field(ID, to_arrow_type(frame.schema[ID].dataType)))


def _begun(parts: DataFrame, conv: str) -> DataFrame:
    """(conv_id, place, state): the state before every segment. A segment maps the state before it to the one after it; the
    maps from the first segment on are composed over twice the distance in every round."""
    schema = pa.schema([(ID, pa.int64()), ("place", pa.int32()), ("map", pa.list_(pa.int32()))])
    maps = cut(parts.select(ID, "place", "rows", "after").mapInArrow(_solve(_ends, _arrow(schema, parts)), f"{ID} {conv}, place int, map array<int>"))
    longest = maps.agg(F.max("place")).first()[0] or 0
    by = 1
    while by <= longest:
        both = maps.alias("b").join(bounded_broadcast(maps, NEIGHBOURS).alias("a"), _is_next("a", "b", by), "left")
        whole = F.when(F.col("a.map").isNull(), F.col("b.map")).otherwise(F.transform("a.map", lambda q: F.element_at(F.col("b.map"), q + 1)))
        maps = cut(both.select(f"b.{ID}", "b.place", whole.alias("map")))
        by *= 2
    return maps.select(ID, (F.col("place") + 1).alias("place"), F.element_at("map", 1).alias("state"))


def find_repairs(rows: DataFrame, segment: int = SEGMENT, **columns) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal,
    cost and audit, the edits' initials. ``columns`` as of ``counted``."""
    ordered = _ordered(counted(rows, **columns))
    conv_type = ordered.schema["c"].dataType
    conv = conv_type.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    parts = cut(ordered.mapInArrow(_segments(segment, to_arrow_type(conv_type)), _ddl(_SEGMENT, conv)))

    def edits(of: DataFrame) -> DataFrame:
        return of.select(ID, "place", "rows", "gone", "last", "after", "state", *_KEPT).mapInArrow(_solve(_edits, _arrow(_EDITED, of)), _ddl(_EDITED, conv))

    # conversations that lie within one partition need nothing of other rows
    alone = {"place": F.lit(1), "last": F.lit(True), "after": _vector(GOAL), "state": F.lit(START), "role_before": F.lit(None).cast("string"),
             "turn_before": F.lit(None).cast("long")}
    whole = edits(parts.where("not edge").withColumns(alone))
    whole = whole.select(ID, F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("distinct_turns"), F.lit(0)).alias("gaps"),
                         "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    # the others: a segment or two of each partition, and those of very long conversations
    order = Window.partitionBy(ID).orderBy("part")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    every = F.count("*").over(Window.partitionBy(ID))
    edge = parts.where("edge")
    known = edge.select("part", F.row_number().over(order).alias("place"), (F.row_number().over(order) == every).alias("last"), (every > 1).alias("several"),
                        F.last("last_role", ignorenulls=True).over(earlier).alias("role_before"), F.max("max_turn").over(earlier).alias("turn_before"))
    edge = cut(edge.join(bounded_broadcast(known, NEIGHBOURS), "part"))
    goal = edge.withColumn("after", _vector(GOAL))
    begun = goal.where("not several").withColumn("state", F.lit(START))
    several = edge.where("several")
    if not several.isEmpty():
        settled = _settled(several, conv)
        states = bounded_broadcast(_begun(settled, conv), NEIGHBOURS)
        begun = begun.unionByName(settled.alias("s").join(states.alias("q"), _is_next("s", "q", 0), "left").select(
            "s.*", F.coalesce("q.state", F.lit(START)).alias("state")))
    crossing = F.concat("role_before", "first_role")
    illegal = F.col("illegal") + F.when(F.col("role_before").isNotNull() & F.col("first_role").isNotNull() & ~crossing.isin("su", "ua", "au"), 1).otherwise(0)
    again = F.coalesce(F.col("min_turn") == F.col("turn_before"), F.lit(False)).cast("int")
    pieces = F.array_sort(F.collect_list(F.struct("place", "audit")))
    joined = edits(begun).groupBy(ID).agg(
        F.coalesce(F.max("max_turn") - F.min("min_turn") + 1 - F.sum(F.col("distinct_turns") - again), F.lit(0)).alias("gaps"),
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"), F.sum(illegal).alias("illegal"),
        F.sum("cost").alias("cost"), F.array_join(F.transform(pieces, lambda x: x["audit"]), "").alias("audit"))
    return whole.unionByName(joined)


# -- the repaired conversations ------------------------------------------------------------------------------------

def _applied(digests: bool, schema: pa.Schema):
    """Rows in order, each conversation's record of edits first: the repaired rows, or that record with their digest."""
    names = {USER: "user", ASSISTANT: "assistant"}
    wants = [USER, USER, ASSISTANT, USER]

    @frugal
    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, total, record = "", 0, START, 0, hashlib.sha256(), None
        out: list[dict] = []

        def put(role: str, text: str, conv) -> None:
            nonlocal place
            if digests:
                total.update((("\n" if place else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            else:
                out.append({ID: conv, "position": place, "role": role, "text": text})
            place += 1

        def inserted(conv) -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = wants[state]
                put(names[state], "", conv)
                at += 1

        def finish() -> None:
            if record is not None and digests:
                out.append({**record, "repaired_sha256": total.hexdigest()})

        for batch in batches:
            convs = batch.column(ID)
            heads, roles, texts, times = (batch.column(c).to_pylist() for c in ("head", "r", "x", "n"))
            for i in range(batch.num_rows):
                if heads[i] is not None:
                    finish()
                    record = {ID: convs[i].as_py(), **heads[i]}
                    audit, at, state, place, total = record["audit"], 0, START, 0, hashlib.sha256()
                    inserted(record[ID])
                    continue
                for _ in range(times[i]):
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        own = roles[i]
                        state = SYSTEM if edit == "K" and own[:1] == "s" else wants[state]
                        put(own if edit == "K" else names[state], texts[i], record[ID])
                    inserted(record[ID])
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        finish()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return applied


def repaired(rows: DataFrame, found: DataFrame, digests: bool = False, turn: str = "turn", role: str = "role", text: str = "text",
             absent: Column | None = None, copies: Column | None = None) -> DataFrame:
    """The conversations after the edits ``found``: (conv_id, position, role, text), or, with ``digests``, ``found`` and
    repaired_sha256, that of all ``role:text`` joined by newlines. ``rows`` and the other arguments as of ``find_repairs``."""
    text_of = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    fields = [c for c in found.columns if c != ID]
    head = F.struct(*fields)
    records = found.select(ID, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("string").alias("r"),
                           F.lit(None).cast("binary").alias("d"), F.lit(None).cast("string").alias("x"), F.lit(0).cast("int").alias("n"), head.alias("head"))
    present = rows if absent is None else rows.where(~absent)
    present = present.select(ID, F.lit(1).alias("kind"), F.col(turn).cast("long").alias("t"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("r"),
                             digest(text_of).alias("d"), text_of.alias("x"), (F.lit(1) if copies is None else copies).cast("int").alias("n"),
                             F.lit(None).cast(records.schema["head"].dataType).alias("head"))
    both = records.union(present)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(parts, ID).sortWithinPartitions(ID, "kind", "t", "r", "d").select(ID, "r", "x", "n", "head")
    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = found.schema[ID].dataType
    if digests:
        schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in found.schema] + [("repaired_sha256", pa.string())])
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", repaired_sha256 string"
    else:
        schema = pa.schema([(ID, to_arrow_type(conv_type)), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        ddl = f"{ID} {conv_type.simpleString()}, position long, role string, text string"
    return both.mapInArrow(_applied(digests, schema), ddl)


def damage(conversations: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Test damage by crc32(``conv_id:turn``) % 20 (nulls: one space): 0 drops the row, 1 empties its text, 2 removes its
    ``[.!?]``, 3 repeats it, 4 makes its role user. The rows, and what ``find_repairs`` needs to know of them."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part(ID), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    rows = conversations.select(ID, "turn", F.when(kind == 4, F.lit("user")).otherwise(part("role")).alias("role"), text.alias("text"),
                                (kind == 0).alias("absent"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return rows, {"absent": F.col("absent"), "copies": F.col("copies")}
