"""Repair of conversations by rank-convergence parallel Viterbi.

Each turn is kept, given another role or deleted, and empty turns are inserted, at least cost, so that the roles read
``(s?(ua)+)?``.  Going backwards over the turns, a vector has the least cost from each of the four states of that pattern;
only finitely many vectors exist up to a constant (:data:`VECTORS`).

All turns are range-partitioned into one order and cut into blocks of bounded weight, whatever conversation they are of.
Conversations within a block are finished there.  The others are chunks in a row: every chunk starts from a speculative
vector, and fix-up passes run those chunks again whose right neighbour arrived at another vector, each only until its
vector differs from the one before by a constant.  Where vectors do not converge (long runs of one role), chunks tell what
they make of every vector, and these maps are composed in levels.  The stitched backward costs then drive the trace: chunks
tell in which state they end for each first state, the maps are composed in levels, and each chunk writes down its edits,
the least letters first.

What has to be one value of one conversation, its audit and the digest of its text, is streamed in order.

Rows: nulls read as one space, a null conversation is one of its own, null turns come first; rows of one turn are ordered
by role and SHA-256 of the text, so equal rows are neighbours; a role that is empty or begins with another letter cannot be
kept; a conversation without rows after damage has zeros and empty results; an empty table gives an empty result; further
columns are ignored.  Long texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendgrid.llm.shared import ship, stored

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLOCK = 4096  # weight of a block: one a turn and one for every 2 KB of text
TURN_BYTES = 2048
FIXUPS = 6  # fix-up passes before maps are composed
FAN = 8  # bits: 256 neighbours are composed at once
KINDS = ("s", "u", "a")

# The pattern: state 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
_NEXT_ROLE = ("u", "u", "a", "u")
_STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_END = (0, 4, 2, 0)


def code_of(kind: str, dead: bool, truncated: bool) -> int:
    """What matters of a turn: 0 for one that must go, else first letter of the role and truncation."""
    return 0 if dead else 1 + 2 * (KINDS.index(kind) if kind in KINDS else 3) + int(truncated)


def _edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what can be done with a turn."""
    out = [("D", DELETE, state)]
    if code:
        kind, more = (*KINDS, "")[(code - 1) // 2], (code - 1) % 2 * TRUNCATED
        if kind in _STEP[state]:
            out.append(("K", more, _STEP[state][kind]))
        out.append(("R", REROLE + more, _STEP[state][_NEXT_ROLE[state]]))
    return out


def _back(code: int, after: tuple) -> tuple[tuple, int]:
    """The vector in front of a turn, less its smallest cost, and that cost."""
    cost = [min(c + after[t] for _, c, t in _edits(code, s)) for s in range(4)]
    cost[2], cost[3] = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    cost[0], cost[1] = min(cost[0], INSERT + cost[2]), min(cost[1], INSERT + cost[2])
    low = min(cost)
    return tuple(c - low for c in cost), low


def _all_vectors() -> tuple[list[tuple], list[list[int]], list[list[int]]]:
    """Every vector that can occur, and for each and every code the vector in front and its constant."""
    vectors, follow, add = [_END], [], []
    number = {_END: 0}
    for v in vectors:  # grows while it is read
        rows = [_back(code, v) for code in range(9)]
        for w, _ in rows:
            if w not in number:
                number[w] = len(vectors)
                vectors.append(w)
        follow.append([number[w] for w, _ in rows])
        add.append([c for _, c in rows])
    return vectors, follow, add


VECTORS, _FOLLOW, _ADD = _all_vectors()
END = 0  # number of the vector behind the last turn
SPECULATIVE = _FOLLOW[END][code_of("u", False, False)]  # a vector as good as any


def run_back(codes: bytes, after: int, before: int | None = None, reached: int | None = None) -> int:
    """The vector in front of a chunk.  An earlier run from ``before`` that reached ``reached`` ends this one where both agree."""
    for code in reversed(codes):
        if after == before:
            return reached
        after = _FOLLOW[after][code]
        before = None if before is None else _FOLLOW[before][code]
    return after


def trace(codes: bytes, after: int, state: int, last: bool) -> tuple[str, str, int, int]:
    """Edits of a chunk as letters, the role each gives (``-``: none, ``k``: its own), the cost and the state behind."""
    numbers = [after]
    for code in reversed(codes):
        numbers.append(_FOLLOW[numbers[-1]][code])
    letters, roles, total, i = [], [], 0, 0
    while True:
        here = VECTORS[numbers[len(codes) - i]]
        if i < len(codes):
            then, more = VECTORS[numbers[len(codes) - i - 1]], _ADD[numbers[len(codes) - i - 1]][codes[i]]
            done = {letter: (cost, t) for letter, cost, t in _edits(codes[i], state) if cost + then[t] - more == here[state]}
        elif not last or here[state] == 0 and state in (0, 3):
            return "".join(letters), "".join(roles), total, state
        else:
            done = {}
        role = _NEXT_ROLE[state]
        letter = "D" if "D" in done else "I" if INSERT + here[_STEP[state][role]] == here[state] else min(done)
        cost, after_state = (INSERT, _STEP[state][role]) if letter == "I" else done[letter]
        letters.append(letter)
        roles.append({"D": "-", "K": "k"}.get(letter, role))
        total += cost
        state = after_state
        i += letter != "I"


_ROLE = {"u": "user", "a": "assistant"}


def _lines(letters: str, given: str, roles: list[str], texts: list[str]) -> list[str]:
    """The turns of a chunk after its edits."""
    out, i = [], 0
    for letter, role in zip(letters, given):
        if letter == "I":
            out.append(f"{_ROLE[role]}:")
            continue
        if letter != "D":
            out.append(f"{roles[i] if role == 'k' else _ROLE[role]}:{texts[i]}")
        i += 1
    return out


def _key(name: str = "conv_id") -> Column:
    return F.when(F.col(name).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(name).cast("string")))


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns after damage by checksum: ``key, turn, role, text``."""
    text_id = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select(
        _key().alias("key"), F.col("turn").cast("long").alias("turn"), text_id("role").alias("role"), text_id("text").alias("text"),
        (F.crc32(F.concat(text_id("conv_id"), F.lit(":"), text_id("turn"))) % 20).alias("_damage"))
    rows = rows.where("_damage != 0").select(
        "key", "turn", F.when(F.col("_damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_damage") == 1, "").when(F.col("_damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("_copies"))
    return rows.withColumn("_copy", F.explode("_copies")).drop("_copies", "_copy")


def _lay(block: int):
    """Number the turns of a sorted partition and cut it into blocks."""
    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, weight, raw, number = TaskContext.get().partitionId(), 0, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = 1 + batch.column("size").to_numpy() // TURN_BYTES
            own = (weight + np.cumsum(sizes) - sizes) // block
            steps = np.cumsum(np.append(own[0] != raw, own[1:] != own[:-1])) + number
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "turn", "role", "text", "sha", "blank", "truncated")), pa.array(np.full(batch.num_rows, part, np.int64)),
                 pa.array(steps.astype(np.int64)), pa.array((part << 40) + rows + np.arange(batch.num_rows))], names=_LAID_NAMES)
            rows, weight, raw, number = rows + batch.num_rows, weight + int(sizes.sum()), own[-1], int(steps[-1])
    return lay


_LAID = "key string, turn long, role string, text string, sha string, blank boolean, truncated boolean, part long, block long, pos long"
_LAID_NAMES = [c.split()[0] for c in _LAID.split(", ")]
_SECTION = ("key string, part long, block long, open boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, "
            "first_turn long, last_turn long, low long, high long, distinct long, codes binary, roles array<string>, texts array<string>, cost long, audit string, sha string")
_SECTION_NAMES = [c.split()[0] for c in _SECTION.split(", ")]


def _sections(group: pd.DataFrame) -> pd.DataFrame:
    """One row a conversation of a block; all but the first and the last are finished here."""
    group = group.sort_values("pos")
    keys = group["key"].to_numpy()
    edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    out = []
    columns = {c: group[c].tolist() for c in ("turn", "role", "text", "blank", "again", "truncated")}
    part, block = int(group["part"].iloc[0]), int(group["block"].iloc[0])
    for a, b in zip(edges, edges[1:]):
        turns, roles, texts, blank, again, truncated = (columns[c][a:b] for c in ("turn", "role", "text", "blank", "again", "truncated"))
        kinds = [r[:1] for r in roles]
        turns = [None if pd.isna(t) else int(t) for t in turns]
        known = [t for t in turns if t is not None]
        twice = [g and not e for g, e in zip(again, blank)]
        cut = [t and not e and not g for t, e, g in zip(truncated, blank, twice)]
        codes = bytes(code_of(k, e or g, t) for k, e, g, t in zip(kinds, blank, twice, cut))
        row = [keys[a], part, block, a == 0 or b == len(keys), sum(blank), sum(twice), sum(cut),
               sum(x + y not in ("su", "ua", "au") for x, y in zip(kinds, kinds[1:])), kinds[0], kinds[-1], turns[0], turns[-1],
               min(known, default=None), max(known, default=None), len(set(known)), codes]
        if row[3]:
            out.append([*row, roles, texts, None, None, None])
        else:
            letters, given, cost, _ = trace(codes, END, 0, True)
            text = "\n".join(_lines(letters, given, roles, texts))
            out.append([*row, None, None, cost, letters, hashlib.sha256(text.encode()).hexdigest()])
    frame = pd.DataFrame(out, columns=_SECTION_NAMES)
    for name in ("first_turn", "last_turn", "low", "high", "cost"):
        frame[name] = frame[name].astype("Int64")
    return frame


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first run of every chunk, from the end of its conversation or from the speculative vector."""
    for batch in batches:
        after = [SPECULATIVE if more else END for more in batch.column("more").to_pylist()]
        reached = [run_back(c, v) for c, v in zip(batch.column("codes").to_pylist(), after)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "at", "codes", "more")), pa.array(after, pa.int32()), pa.array(reached, pa.int32()),
                                          pa.array([True] * len(after))], names=_STATE_NAMES)


def _fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run chunks again that started from another vector than their neighbour reached."""
    for batch in batches:
        codes, after, reached, came = (batch.column(c).to_pylist() for c in ("codes", "after", "reached", "came"))
        now = [END if c is None else c for c in came]
        fixed = [r if v == n else run_back(c, n, v, r) for c, v, r, n in zip(codes, after, reached, now)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "at", "codes", "more")), pa.array(now, pa.int32()), pa.array(fixed, pa.int32()),
                                          pa.array([f != r for f, r in zip(fixed, reached)])], names=_STATE_NAMES)


_STATE = "key string, at long, codes binary, more boolean, after int, reached int, changed boolean"
_STATE_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def _vector_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a chunk makes of every vector; runs that meet go on as one."""
    for batch in batches:
        maps = []
        for codes in batch.column("codes").to_pylist():
            now = list(range(len(VECTORS)))
            for code in reversed(codes):
                follow = {v: _FOLLOW[v][code] for v in set(now)}
                now = [follow[v] for v in now]
            maps.append(now)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([(1 << 60) - a for a in batch.column("at").to_pylist()], pa.int64()),
                                          pa.array(maps, pa.list_(pa.int32()))], names=["key", "at", "map"])


def _state_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind a chunk for every state in front of it."""
    for batch in batches:
        maps = [[trace(c, v, s, not more)[3] for s in range(4)] for c, v, more in zip(*(batch.column(k).to_pylist() for k in ("codes", "after", "more")))]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("at"), pa.array(maps, pa.list_(pa.int32()))], names=["key", "at", "map"])


_MAP = "key string, at long, map array<int>"


def _composed(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("at")
    now = None
    for own in group["map"]:
        now = list(own) if now is None else [own[k] for k in now]
    return pd.DataFrame({"key": [group["key"].iloc[0]], "at": [int(group["at"].iloc[0]) >> FAN], "map": [now]})


def _handed(members: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    members = members.sort_values("at")
    value, values = int(above["value"].iloc[0]), []
    for own in members["map"]:
        values.append(value)
        value = int(own[value])
    return pd.DataFrame({"key": members["key"], "at": members["at"], "value": values})


def _stitched(maps: DataFrame, first: int, name: str) -> DataFrame:
    """``(key, at, value)``: what enters every member of a row of maps, composed by 256 neighbours a level."""
    levels = [stored(maps, f"{name}-maps")]
    while levels[-1].groupBy("key").count().where("count > 1").limit(1).count():
        levels.append(stored(levels[-1].groupBy("key", F.shiftright("at", FAN)).applyInPandas(_composed, _MAP), f"{name}-maps"))
    entering = levels.pop().select("key", "at", F.lit(first).alias("value"))
    for level in reversed(levels):
        entering = stored(level.groupBy("key", F.shiftright("at", FAN).alias("up")).cogroup(entering.groupBy("key", "at"))
                          .applyInPandas(_handed, "key string, at long, value int"), f"{name}-values")
    return entering


def _converged(chunks: DataFrame, fixups: int) -> DataFrame:
    """``(key, at, codes, more, after)``: the vector behind every chunk, up to a constant."""
    state = stored(chunks.mapInArrow(_start, _STATE), "turn-vectors")
    for _ in range(fixups):
        came = state.select("key", (F.col("at") - 1).alias("at"), F.col("reached").alias("came"))
        state = stored(state.join(came, ["key", "at"], "left").mapInArrow(_fix, _STATE), "turn-vectors")
        if state.where("changed").limit(1).count() == 0:
            return state
    behind = _stitched(chunks.mapInArrow(_vector_maps, _MAP), END, "turn-vector")
    behind = behind.select("key", ((1 << 60) - F.col("at")).alias("at"), F.col("value").alias("after"))
    return chunks.join(behind, ["key", "at"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for codes, after, state, more, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("codes", "after", "value", "more", "roles", "texts"))):
            letters, given, cost, _ = trace(codes, after, state, not more)
            out.append((cost, letters, "\n".join(_lines(letters, given, roles, texts))))
        columns = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("at"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()),
                                          pa.array(columns[2], pa.string())], names=["key", "at", "cost", "audit", "text"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of conversations whose chunks come in order."""
    key, letters, digest, any_text = None, [], None, False

    def row():
        return pa.RecordBatch.from_pydict({"key": [key], "audit": ["".join(letters)], "sha": [digest.hexdigest()]})
    for batch in batches:
        for own, audit, text in zip(*(batch.column(c).to_pylist() for c in ("key", "audit", "text"))):
            if own != key:
                if key is not None:
                    yield row()
                key, letters, digest, any_text = own, [], hashlib.sha256(), False
            letters.append(audit)
            if text:
                digest.update((("\n" if any_text else "") + text).encode())
                any_text = True
    if key is not None:
        yield row()


def _gaps(low: str, high: str, distinct: str) -> Column:
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  turns may be as far apart as longs can be
    return F.coalesce((wide(high) - wide(low) + 1 - wide(distinct)).try_cast("long"), F.lit(0).cast("long"))


def repair(conversations: DataFrame, block: int = BLOCK, fixups: int = FIXUPS) -> DataFrame:
    """Per conversation of the input: its faults, the least cost and edits after damage, and the digest of the repaired text."""
    spark = conversations.sparkSession
    ship(spark)
    rows = damaged(conversations).withColumn("sha", F.sha2("text", 256)).withColumn("size", F.octet_length("text"))
    rows = rows.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("truncated", ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"))
    order = [F.col("key"), F.asc_nulls_first("turn"), F.col("role"), F.col("sha"), F.col("_tie")]  # the last deals out equal rows
    rows = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    laid = stored(rows.mapInArrow(_lay(block), _LAID), "turns")

    first = laid.where("not blank").groupBy("key", "role", "sha").agg(F.min("pos").alias("seen"), F.count(F.lit(1)).alias("n"))
    first = stored(first.where("n > 1").drop("n"), "turns-repeated")
    marked = laid.join(first, ["key", "role", "sha"], "left").withColumn("again", F.coalesce(F.col("pos") > F.col("seen"), F.lit(False)))
    sections = stored(marked.drop("sha", "seen").groupBy("part", "block").applyInPandas(_sections, _SECTION), "turn-sections")
    closed = sections.where("not open").select("key", _gaps("low", "high", "distinct").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha")

    blocks = laid.groupBy("part").agg((F.max("block") + 1).alias("n"))  # one row for each range
    blocks = blocks.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    opened = sections.where("open").join(F.broadcast(blocks), "part").withColumn("at", F.col("_before") + F.col("block"))
    opened = stored(opened.drop("_before", "part", "block", "open", "cost", "audit", "sha"), "turn-chunks")
    right = opened.select("key", (F.col("at") - 1).alias("at"), F.col("first").alias("_first"), F.col("first_turn").alias("_turn"), F.lit(True).alias("_more"))
    linked = opened.join(right, ["key", "at"], "left").withColumn("more", F.coalesce("_more", F.lit(False)))

    state = _converged(stored(linked.select("key", "at", "codes", "more"), "turn-codes"), fixups).select("key", "at", "codes", "more", "after")
    state = stored(state, "turn-behind")
    value = _stitched(state.mapInArrow(_state_maps, _MAP), 0, "turn-state")
    work = opened.select("key", "at", "roles", "texts").join(state, ["key", "at"]).join(value, ["key", "at"])
    traced = stored(work.mapInArrow(_traced, "key string, at long, cost long, audit string, text string"), "turn-edits", packed=True)
    streamed = (traced.select("key", "at", "audit", "text").repartition("key").sortWithinPartitions("key", "at")
                .mapInArrow(_streamed, "key string, audit string, sha string"))
    between = F.col("more") & ~F.concat("last", "_first").isin("su", "ua", "au")
    counts = linked.select("key", "blank", "duplicate", "truncated", (F.col("illegal") + between.cast("long")).alias("illegal"), "low", "high",
                           (F.col("distinct") - (F.col("more") & F.coalesce(F.col("last_turn") == F.col("_turn"), F.lit(False))).cast("long")).alias("distinct"))
    counts = counts.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "distinct")), F.min("low").alias("low"), F.max("high").alias("high"))
    costs = traced.groupBy("key").agg(F.sum("cost").alias("cost"))
    stitched = counts.join(costs, "key").join(streamed, "key").select("key", _gaps("low", "high", "distinct").alias("gaps"), "blank", "duplicate", "truncated",
                                                                       "illegal", "cost", "audit", "sha")
    found = closed.unionByName(stitched)
    ids = conversations.select("conv_id").distinct().withColumn("key", _key())
    zero = lambda name: F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name)
    return ids.join(found, "key", "left").select(
        "conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
