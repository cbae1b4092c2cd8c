"""Substring dedup with a distributed difference-cover suffix order, on bytes.

Sampled pieces of every text (of :data:`PIECE` bytes, chosen by their content) show where a repeat of :data:`LENGTH`
bytes can be at all; only those regions go on.  There the positions that are not divisible by 3 are the sample: their
triples of triples are sorted and named over all regions, triples of names are sorted and named again, until a name
stands for 81 bytes.  The remaining positions are merged with the sample by the one or two bytes in front of a sampled
suffix: every two classes of positions have a common sorted list.  Equal neighbours within a list that agree on
:data:`LENGTH` bytes are repeats; the bytes they cover are removed.

Each sort is spread over ranges of keys.  A block of regions sends a key once, however often it holds it, and gets back
a name for it or, in the merge, whether it is repeated, so a passage that all texts hold costs one entry a block.  Regions
are dealt to blocks by the least of their pieces, so that copies of a passage tend to share blocks; a passage with very many
copies fills several.  The order of names is a fixed one, by a mix of the key's bits, and not the alphabetical one; equal
names mean equal bytes.

Rows: a null or empty text has no bytes; texts shorter than :data:`LENGTH` lose nothing; equal texts of that length or
more lose everything; repeated rows count as texts of their own; an empty table gives an empty result; further columns
are ignored.  Long texts are read whole.  The choice of regions uses hashes, and only adds regions where they collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid.llm.exchange import RANGE_KEYS, repeated_hashes, short_keys, unpacked
from spendgrid.llm.shared import discard, nodes_of, ship, small_side, stored, text_node, text_of
from spendgrid.llm.words import chunks, mixed, rolling_hash

LENGTH = 200
PIECE = 32
CHUNK = 1 << 17  # bytes of text whose arrays stay in a core's cache
AROUND = 32  # of so many neighbouring pieces one is chosen at least
BLOCK_BYTES = 1 << 19
NAME_BITS = 37
NAME_BYTES = 5
NAMING, MERGES = ("9", "27", "81"), ("sample", "one", "two")
_OTHER_BYTES = {"9": 1, "27": 6, "81": 6, "sample": 8, "one": 8, "two": 8}  # of a key's second word
_RANGE = 2_000_000
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _sliding(values: np.ndarray, width: int, pick, back: bool = False) -> np.ndarray:
    """``pick`` over ``width`` (a power of two) neighbours to the right, or to the left with ``back``; fewer at the end."""
    now, following, step = values.copy(), np.empty_like(values), 1
    while step < width:
        if step < len(now):
            near, rest = (slice(step, None), slice(None, step)) if back else (slice(None, -step), slice(-step, None))
            pick(now[:-step], now[step:], out=following[near])
            following[rest] = now[rest]
            now, following = following, now
        step *= 2
    return now


def chosen_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and hash of pieces that are least among :data:`AROUND` neighbours; the choice depends on nearby bytes alone."""
    n = len(data) - PIECE + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = rolling_hash(data, PIECE)
    inside = np.ones(n, bool)
    for end in offsets[1:-1]:
        inside[max(0, end - PIECE + 1):end] = False
    hashes[~inside] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = _sliding(hashes, AROUND, np.minimum)
    # the largest of the least values over all neighbourhoods that hold a piece
    most = _sliding(least, AROUND, np.maximum, back=True)
    at = np.flatnonzero(inside & (most == hashes))
    return at, hashes[at]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in chunks(batch.column("text"), CHUNK):
            raw = data.tobytes()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(first, len(offsets) - 1),
                "node": batch.column("node").slice(first, len(offsets) - 1), "n_bytes": pa.array(np.diff(offsets)),
                "whole_sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets, offsets[1:])]})


def _pieces(batch: pa.RecordBatch):
    nodes = nodes_of(batch)
    for first, data, offsets in chunks(batch.column("text"), CHUNK):
        at, hashes = chosen_pieces(data, offsets)
        yield nodes[first:first + len(offsets) - 1], np.searchsorted(at, offsets), hashes, np.zeros(len(at), bool)


def _regions(parts: int):
    """Regions ``piece, node, start, data``, a row each.  All chosen pieces well within a repeat are repeated pieces."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes = batch.column("keys").to_pylist(), nodes_of(batch).view(np.int64)
            for first, data, offsets in chunks(batch.column("text"), CHUNK):
                at, hashes = chosen_pieces(data, offsets)
                short, edges = short_keys(hashes, parts), np.searchsorted(at, offsets)
                alone = np.zeros(len(data) + 1, np.int64)
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    alone[at[a:b][~np.isin(short[a:b], unpacked(keys[first + i]))] + 1] = 1
                alone = np.cumsum(alone)
                ends = np.repeat(offsets[1:], np.diff(offsets))
                begin = np.flatnonzero(np.arange(len(data)) + LENGTH <= ends)
                inner = alone[begin + LENGTH - PIECE - AROUND + 2] - alone[begin + AROUND - 1]
                begin = begin[inner == 0]
                cover = np.zeros(len(data) + 1, np.int64)
                cover[begin] += 1  # no begin occurs twice
                cover[begin + LENGTH] -= 1
                covered = np.cumsum(cover[:-1]) > 0
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                new = np.append(True, ~covered[:-1] | (owner[1:] != owner[:-1])) if len(data) else np.zeros(0, bool)
                start = np.flatnonzero(covered & new)
                last = np.flatnonzero(covered & np.append(new[1:] | ~covered[1:], True)) + 1 if len(data) else start
                if not len(start):
                    continue
                # the least piece well within the region, which all copies of the region share
                low, high = np.searchsorted(at, start + AROUND), np.searchsorted(at, last - PIECE - AROUND, "right")
                least = [int(hashes[x:y].min()) if y > x else 0 for x, y in zip(low, high)]
                raw = data.tobytes()
                yield pa.RecordBatch.from_pydict({
                    "piece": pa.array(np.array(least, np.uint64).view(np.int64)),
                    "node": pa.array(nodes[first + owner[start]]),
                    "start": pa.array(start - offsets[owner[start]]), "data": pa.array([raw[x:y] for x, y in zip(start, last)], pa.binary())})
    return rows


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of neighbouring regions: ``block, nodes, starts, sizes, data``."""
    def out(nodes: list, starts: list, data: list) -> pa.RecordBatch:
        own, begin = np.array(nodes, "<i8"), np.array(starts, "<i8")
        block = int(mixed(own.view(np.uint64) + begin.view(np.uint64)).sum(dtype=np.uint64).view(np.int64))
        return pa.RecordBatch.from_pydict({
            "block": pa.array([block]), "nodes": pa.array([own.tobytes()], pa.binary()), "starts": pa.array([begin.tobytes()], pa.binary()),
            "sizes": pa.array([np.array([len(d) for d in data], "<i8").tobytes()], pa.binary()), "data": pa.array([b"".join(data)], pa.binary())})

    nodes, starts, data, size = [], [], [], 0
    for batch in batches:
        for node, start, region in zip(*(batch.column(k).to_pylist() for k in ("node", "start", "data"))):
            nodes.append(node)
            starts.append(start)
            data.append(region)
            size += len(region)
            if size >= BLOCK_BYTES:
                yield out(nodes, starts, data)
                nodes, starts, data, size = [], [], [], 0
    if nodes:
        yield out(nodes, starts, data)


def _low(values: np.ndarray, width: int) -> bytes:
    """The lowest bytes of 64-bit values."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(raw: bytes, width: int) -> np.ndarray:
    """The values of :func:`_low`."""
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _sampled(sizes: np.ndarray, span: int) -> np.ndarray:
    """Sampled positions of a block with ``span`` bytes to the end of their region."""
    end = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(end))
    return np.flatnonzero((place % 3 != 0) & (place + span <= end))


def _eight(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from every position as one word."""
    if not len(at):
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))[at].astype(np.uint64)


def _packed(a: np.ndarray, b: np.ndarray, c: np.ndarray, two: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Three names and two bytes in two words."""
    return a | (b << np.uint64(NAME_BITS)), (b >> np.uint64(64 - NAME_BITS)) | (c << np.uint64(10)) | (np.uint64(two) << np.uint64(10 + NAME_BITS))


def _keys(step: str, data: np.ndarray, sizes: np.ndarray, names: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a block that take part in a step, and their keys."""
    if step in NAMING:
        span = int(step)
        at = _sampled(sizes, span)
        if step == "9":
            return at, _eight(data, at), data[at + 8].astype(np.uint64)
        third = span // 3
        return at, *_packed(names[at], names[at + third], names[at + 2 * third])
    end = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(data))
    skip, front = {"sample": (0, 0), "one": (2, 1), "two": (1, 2)}[step]
    at = np.flatnonzero((place % 3 != skip) & (place + LENGTH <= end))
    byte = lambda k: data[at + k].astype(np.uint64)
    two = {0: lambda: byte(198) << np.uint64(8) | byte(199), 1: lambda: byte(0) << np.uint64(8) | byte(199),
           2: lambda: byte(0) << np.uint64(8) | byte(1)}[front]()
    return at, *_packed(names[at + front], names[at + front + 81], names[at + front + 117], two)


def _place(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Where a key stands in the order of names."""
    return mixed(one + other * _SPREAD)


def _distinct(step: str, row, parts: int):
    """Distinct keys of a block by range: places of the keys, and for each position the number of its key."""
    data, sizes = np.frombuffer(row.data, np.uint8), np.frombuffer(row.sizes, "<i8")
    names = None
    if step != "9":
        names = np.zeros(len(data), np.uint64)
        names[_sampled(sizes, int(step) // 3 if step in NAMING else 81)] = _wide(row.names, NAME_BYTES)
    at, one, other = _keys(step, data, sizes, names)
    place = _place(one, other)
    order = np.argsort(place)
    one, other, place = one[order], other[order], place[order]
    new = np.append(True, (one[1:] != one[:-1]) | (other[1:] != other[:-1])) if len(at) else np.zeros(0, bool)
    number = np.empty(len(at), np.int64)
    number[order] = np.cumsum(new) - 1
    part = ((place[new] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    return at, number, one[new], other[new], part, np.diff(np.append(np.flatnonzero(new), len(at))) > 1


_SENT = "part long, block long, one binary, other binary, several binary"


def _send(step: str, parts: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                _, _, one, other, part, several = _distinct(step, row, parts)
                edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                yield pd.DataFrame([(int(part[a]), row.block, one[a:b].tobytes(), _low(other[a:b], _OTHER_BYTES[step]), np.packbits(several[a:b]).tobytes())
                                    for a, b in zip(edges, np.append(edges[1:], len(part)))],
                                   columns=["part", "block", "one", "other", "several"])
    return rows


def _sort_range(step: str, parts: int):
    naming = step in NAMING

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        """Sort the keys of a range; equal neighbours have one name and are repeated."""
        part = int(group["part"].iloc[0])
        one = np.concatenate([np.frombuffer(k, "<u8") for k in group["one"]])
        other = np.concatenate([_wide(k, _OTHER_BYTES[step]) for k in group["other"]])
        totals = [len(k) // 8 for k in group["one"]]
        order = np.argsort(_place(one, other))
        a, b = one[order], other[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        number = np.empty(len(a), np.int64)
        number[order] = np.cumsum(new) - 1
        if naming:
            if int(new.sum()) * parts >= 1 << NAME_BITS:
                raise ValueError("more distinct pieces than names have bits for")
            name = number.astype(np.uint64) * np.uint64(parts) + np.uint64(part)
            out = lambda x, y: _low(name[x:y], NAME_BYTES)
        else:
            several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=n) for s, n in zip(group["several"], totals)])
            often = (np.bincount(number) + np.bincount(number, several)) > 1
            out = lambda x, y: np.packbits(often[number[x:y]]).tobytes()
        ends = np.cumsum(totals)
        return pd.DataFrame({"part": part, "block": group["block"].to_numpy(), "n": totals,
                             "found": [out(e - n, e) for e, n in zip(ends, totals)]})
    return decide


_BLOCK = "block long, nodes binary, starts binary, sizes binary, data binary, names binary"
_FOUND = "part long, block long, n long, found binary"


def _found(blocks: DataFrame, step: str, parts: int) -> DataFrame:
    """What a sort of all keys of a step says to every block and range."""
    return blocks.mapInPandas(_send(step, parts), _SENT).groupBy("part").applyInPandas(_sort_range(step, parts), _FOUND)


def _name(step: str, parts: int):
    def receive(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """The block with the names of a step."""
        out = block.copy()
        if len(block):
            _, number, *_ = _distinct(step, next(block.itertuples()), parts)
            names = [_wide(f, NAME_BYTES) for f in found.sort_values("part")["found"]]
            out["names"] = [_low(np.concatenate(names)[number], NAME_BYTES) if names else b""]
        return out
    return receive


def _named(blocks: DataFrame, step: str, parts: int) -> DataFrame:
    """Blocks with the names of a step.  The names are written first, so that the sent keys are gone when blocks travel."""
    found = stored(_found(blocks, step, parts), f"suffix-found-{step}", packed=True)
    named = stored(blocks.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(_name(step, parts), _BLOCK), f"suffix-{step}", packed=True)
    discard(found)
    return named


def _merge(parts: int):
    def receive(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """``(node, spans)``: covered begins and ends in each text's region, from the repeated keys of all merged lists."""
        out = []
        for row in block.itertuples():
            sizes, nodes, starts = np.frombuffer(row.sizes, "<i8"), np.frombuffer(row.nodes, "<i8"), np.frombuffer(row.starts, "<i8")
            begins = np.zeros(len(row.data) + 1, bool)
            for step in MERGES:
                own = found[found["step"] == step].sort_values("part")
                if len(own):
                    at, number, *_ = _distinct(step, row, parts)
                    often = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(own["found"], own["n"])]).astype(bool)
                    begins[at[often[number]]] = True
            begin = np.flatnonzero(begins)
            cover = np.zeros(len(row.data) + 1, np.int64)
            cover[begin] += 1
            cover[begin + LENGTH] -= 1
            gone, ends = (np.cumsum(cover[:-1]) > 0).astype(np.int8), np.cumsum(sizes)
            for node, start, a, b in zip(nodes, starts, ends - sizes, ends):
                steps = np.diff(np.concatenate([[0], gone[a:b], [0]]))
                spans = np.stack([np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)], axis=1) + start
                if len(spans):
                    out.append((node, spans.ravel()))
        return pd.DataFrame(out, columns=["node", "spans"])
    return receive


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for node, text, spans in zip(*(batch.column(k).to_pylist() for k in ("node", "text", "spans"))):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            pairs = np.array(sorted((s[i], s[i + 1]) for s in spans for i in range(0, len(s), 2)))
            gone = np.zeros(len(raw) + 1, np.int64)
            np.add.at(gone, pairs[:, 0], 1)
            np.subtract.at(gone, pairs[:, 1], 1)
            mask = np.cumsum(gone[:-1]) > 0
            runs = int((np.diff(np.concatenate([[0], mask.astype(np.int8)])) == 1).sum())
            out.append((node, int(mask.sum()), runs, hashlib.sha256(raw[~mask].tobytes()).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                         names=["node", "n_removed", "n_spans", "kept_sha256"])


def repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("node", text_node())
    described = stored(rows.mapInArrow(_describe, "doc_id long, node long, n_bytes long, whole_sha256 string"), "suffix-texts")
    texts = rows.select("node", "text")
    total = described.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = max(1, -(-total // (RANGE_KEYS * AROUND // 2)))
    hits = stored(repeated_hashes(texts, _pieces, parts, short=True), "suffix-hits")
    named = (texts.join(small_side(hits.select("node"), hits.count()), "node", "left_semi")
             .groupBy("node").agg(F.any_value("text").alias("text")))
    candidates = stored(named.join(hits, "node"), "suffix-candidates")
    discard(hits)
    regions = stored(candidates.mapInArrow(_regions(parts), "piece long, node long, start long, data binary"), "suffix-regions")
    near = regions.hint("rebalance", "piece").sortWithinPartitions("piece", "node", "start")
    blocks = stored(near.select("node", "start", "data").mapInArrow(
        _pack, "block long, nodes binary, starts binary, sizes binary, data binary").withColumn("names", F.lit(b"").cast("binary")), "suffix-blocks")
    discard(regions)
    size = blocks.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    ranges = max(1, -(-size * 2 // 3 // _RANGE))
    for step in NAMING:
        following = _named(blocks, step, ranges)
        discard(blocks)
        blocks = following
    merged = [stored(_found(blocks, step, ranges), f"suffix-{step}", packed=True).withColumn("step", F.lit(step)) for step in MERGES]
    found = merged[0].unionByName(merged[1]).unionByName(merged[2])
    spans = stored(blocks.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(_merge(ranges), "node long, spans array<long>"),
                   "suffix-spans", packed=True)
    discard(blocks)
    spans = spans.groupBy("node").agg(F.collect_list("spans").alias("spans"))
    removed = candidates.select("node", "text").join(spans, "node").mapInArrow(
        _cut, "node long, n_removed long, n_spans long, kept_sha256 string")
    copies = described.groupBy("node").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    both = described.join(removed, "node", "left").join(copies, "node", "left")
    copied = F.col("copies").isNotNull() & (F.col("n_bytes") >= LENGTH)
    return both.select(
        "doc_id", "n_bytes", F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"))
