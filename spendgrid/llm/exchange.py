"""Finding hashes that occur more than once over all texts, without a row for every hash.

Texts of a task are taken in blocks.  A block sends its distinct hashes by ranges, packed, with the text each is from.
A hash that occurs several times within the block is decided there, and one flagged entry tells the others: a hash that
every text holds is sent once a block.  A range is sorted in one task; its texts get back their repeated hashes.

Equal texts (equal ``node``) count as one text here; users of the module know their number from the node's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from spendgrid.llm.words import mixed

BLOCK_KEYS = 800_000
RANGE_KEYS = 2_000_000
_SENT = "part long, block long, kind int, nodes binary, sizes binary, keys binary, several binary, marked binary"
_TYPES = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("nodes", pa.binary()),
                    ("sizes", pa.binary()), ("keys", pa.binary()), ("several", pa.binary()), ("marked", pa.binary())])


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The range of a hash."""
    return ((hashes >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def short_keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Hashes as they come back where only 32 bits of each are sent: range and low bits."""
    return (part_of(hashes, parts).astype(np.uint64) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _block(node: np.ndarray, starts: np.ndarray, hashes: np.ndarray, marked: np.ndarray, parts: int, short: bool) -> list[tuple]:
    """Rows of a block.  ``hashes`` may repeat within a text; ``marked`` belongs to occurrences."""
    _, keep = np.unique(node, return_index=True)
    keep.sort()
    sizes = np.diff(starts)[keep]
    place = np.repeat(starts[keep] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    node, hashes, marked, doc = node[keep], hashes[place], marked[place], np.repeat(np.arange(len(keep)), sizes)
    if not len(hashes):
        return []
    keys = short_keys(hashes, parts) if short else hashes
    block = int(mixed(node).sum(dtype=np.uint64).view(np.int64))
    order = np.argsort(keys, kind="stable")
    keys, doc, marked, part = keys[order], doc[order], marked[order], part_of(hashes[order], parts)
    new = np.append(True, keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(keys)))
    run = np.cumsum(new) - 1
    rows = []
    often = length[run] > 1
    if often.any():
        # repeated within the block: decided here for all its texts
        by_doc = np.lexsort((keys[often], doc[often]))
        d, k = doc[often][by_doc], keys[often][by_doc]
        distinct = np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1]))
        d, k = d[distinct], k[distinct]
        own, counts = np.unique(d, return_counts=True)
        rows.append((int(abs(block) % parts), block, 1, node[own].tobytes(), counts.astype("<u4").tobytes(), k.tobytes(), b"", b""))
    any_mark = np.logical_or.reduceat(marked, first)
    keys, doc, several, part = keys[first], doc[first], length > 1, part[first]
    order = np.lexsort((doc, part))
    keys, doc, several, any_mark, part = keys[order], doc[order], several[order], any_mark[order], part[order]
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, b in zip(edges, np.append(edges[1:], len(part))):
        own, counts = np.unique(doc[a:b], return_counts=True)
        low = (keys[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() if short else keys[a:b].tobytes()
        rows.append((int(part[a]), block, 0, node[own].tobytes(), counts.astype("<u4").tobytes(), low,
                     np.packbits(several[a:b]).tobytes(), np.packbits(any_mark[a:b]).tobytes()))
    return rows


def _sender(read: Callable, parts: int, short: bool):
    def out(held: list) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[1]) for h in held]))])
        rows = _block(np.concatenate([h[0] for h in held]), starts, np.concatenate([h[2] for h in held]),
                      np.concatenate([h[3] for h in held]), parts, short)
        columns = list(zip(*rows)) or [[]] * len(_TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES.types)], schema=_TYPES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in read(batch):
                held.append(piece)
                size += len(piece[2])
                if size >= BLOCK_KEYS:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)
    return send


def _distinct(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])) if len(owner) else np.zeros(0, bool)
    return owner[new], keys[new]


def _entries(rows: pd.DataFrame, width: str) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Text and key of every entry of packed rows, and the entries of each row."""
    sizes = [np.frombuffer(s, "<u4") for s in rows["sizes"]]
    if not sizes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), []
    owner = np.concatenate([np.repeat(np.frombuffer(n, "<i8"), s) for n, s in zip(rows["nodes"], sizes)])
    return owner, np.concatenate([np.frombuffer(k, width) for k in rows["keys"]]), [int(s.sum()) for s in sizes]


def _decide(group: pd.DataFrame, short: bool, only_marked: bool, buckets: int) -> pd.DataFrame:
    owner, keys, _ = _entries(group[group["kind"] == 1], "<u8")
    sent = group[group["kind"] == 0]
    if len(sent):
        whose, hashes, totals = _entries(sent, "<u4" if short else "<u8")
        bits = lambda name: np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n)
                                            for f, n in zip(sent[name], totals)]).astype(bool)
        several, marked = bits("several"), bits("marked")
        order = np.argsort(hashes, kind="stable")
        hashes, whose, several, marked = hashes[order], whose[order], several[order], marked[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(hashes))))
        often = np.minimum.reduceat(whose, first) != np.maximum.reduceat(whose, first)
        often |= np.logical_or.reduceat(several, first)
        if only_marked:
            often &= np.logical_or.reduceat(marked, first)
        back = often[run] & ~several
        found = hashes[back].astype(np.uint64)
        if short:
            found |= np.uint64(group["part"].iloc[0]) << np.uint64(32)
        owner, keys = np.concatenate([owner, whose[back]]), np.concatenate([keys, found])
    owner, keys = _distinct(owner, keys)
    bucket = owner % buckets
    order = np.argsort(bucket, kind="stable")
    owner, keys, bucket = owner[order], keys[order], bucket[order]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(edges, np.append(edges[1:], len(bucket))):
        starts = np.flatnonzero(np.append(True, owner[a + 1:b] != owner[a:b - 1]))
        rows.append((int(bucket[a]), owner[a:b][starts].tobytes(), np.diff(np.append(starts, b - a)).astype("<u4").tobytes(), keys[a:b].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "nodes", "sizes", "keys"])


def _gather(group: pd.DataFrame) -> pd.DataFrame:
    owner, keys = _distinct(*_entries(group, "<u8")[:2])
    edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return pd.DataFrame({"node": owner[edges], "keys": [keys[a:b].tobytes() for a, b in zip(edges, np.append(edges[1:], len(owner)))]})


def repeated_hashes(rows: DataFrame, read: Callable, parts: int, short: bool = False, only_marked: bool = False) -> DataFrame:
    """``(node, keys)``: the hashes of every text that occur elsewhere as well, sorted and packed.

    ``read`` turns a batch of ``rows`` into pieces ``(nodes, starts, hashes, marked)``.  With ``short`` the keys are
    :func:`short_keys`, of which a few may be equal by chance.  With ``only_marked`` one of the occurrences is a marked
    one, except among those decided within a block.  Both ways are packed: a row for every block and range, and one for
    every range and bucket of texts.
    """
    decided = (rows.mapInArrow(_sender(read, parts, short), _SENT).groupBy("part")
               .applyInPandas(lambda group: _decide(group, short, only_marked, parts), "bucket long, nodes binary, sizes binary, keys binary"))
    return decided.groupBy("bucket").applyInPandas(_gather, "node long, keys binary")


def unpacked(keys: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a packed column."""
    return np.frombuffer(keys or b"", "<u8")
