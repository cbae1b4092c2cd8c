"""Phrase collocations per language, by prefix-free parsing.

Every piece of a text (words between marks) is cut where a word's own bytes say so, at *trigger* words, into chunks that
overlap by two words; equal passages are cut alike wherever they stand.  The distinct chunks with their number of
occurrences are the dictionary of the parse.  Phrases are then counted inside the dictionary only, weighted by the
occurrences of their chunk.  A chunk owns the phrases that begin in front of the next chunk, so that what stands in an
overlap is counted once.

Counting takes two passes over packed blocks of the dictionary.  The first sends a hash of 32 bits and a clipped count of
every phrase to ranges of the hash space; phrases whose hash reaches the least count come back to the blocks that hold
them.  The second counts those by their words, so equal hashes never add up, and phrases of parts of candidates are
always among them, since a part occurs at least as often as the whole.

Rows: null or empty texts have no words; a null language counts as ``und``; repeated rows count each; an empty table gives
an empty result; further columns are ignored; ties go by count and phrase.  Long texts are read whole; a text without any
trigger word is one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendgrid.llm.shared import discard, ship, stored, text_of
from spendgrid.llm.words import chunks, mixed

LEAST = 10  # occurrences of a candidate
LONGEST = 3  # words of a phrase
SHADOW = 50  # per cent of a phrase's occurrences in a longer candidate that drop it
BEST = 2000  # rows returned per language
TRIGGER = 16  # one word in so many begins a chunk
TEXT_BYTES = 1 << 18  # bytes parsed at once; a longer text alone
BLOCK_BYTES = 6 << 20  # text of a block of the dictionary
RANGE_KEYS = 3_000_000  # phrases of a range of the hash space
NO_LANGUAGE = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP[[0x20, 0x09]] = True
_CHUNK = pa.schema([("lang", pa.string()), ("chunk", pa.large_string()), ("own", pa.int32()), ("freq", pa.int64())])


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all spans, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[_spans(starts, sizes)])])


def parse(data: np.ndarray, offsets: np.ndarray, trigger: int = TRIGGER) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Chunks of all texts of a run: their words joined by one space, how many words each owns, and its text's number."""
    data = _LOWER[data]
    mark = _MARK[data]
    inside = ~(mark | _GAP[data])
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True
    begins = begins[:-1]
    before = np.append(False, inside[:-1])[:len(data)]
    starts = np.flatnonzero(inside & (~before | begins))
    last = np.append(begins[1:], True)[:len(data)]
    after = np.append(inside[1:], False)[:len(data)]
    ends = np.flatnonzero(inside & (~after | last)) + 1
    if not len(starts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(0, np.int64)
    text = np.searchsorted(offsets, starts, "right") - 1
    marks = np.cumsum(mark)[starts]
    new = np.append(True, (text[1:] != text[:-1]) | (marks[1:] != marks[:-1]))
    sizes = ends - starts
    key = sizes.astype(np.uint64)
    for k in range(8):  # the first bytes and the last ones tell whether a word is a trigger
        key = key * np.uint64(257) + np.where(sizes > k, data[np.minimum(starts + k, len(data) - 1)], 0).astype(np.uint64)
    key = mixed(key * np.uint64(257) + data[ends - 1])
    cut = new | (key % np.uint64(trigger) == 0)
    first = np.flatnonzero(cut)
    stop = np.append(first[1:], len(starts))
    piece_end = np.append(np.flatnonzero(new)[1:], len(starts))[(np.cumsum(new) - 1)[first]]
    until = np.minimum(stop + LONGEST - 1, piece_end)
    # the words of all texts, each with one space behind
    place = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat = np.full(place[-1], 32, np.uint8)
    flat[_spans(place[:-1], sizes)] = data[_spans(starts, sizes)]
    return _strings(flat, place[first], place[until] - 1), (stop - first).astype(np.int32), text[first]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = []
        for first, data, offsets in chunks(batch.column("text"), TEXT_BYTES):
            strings, own, text = parse(data, offsets)
            held.append(pa.table({"lang": batch.column("lang").take(pa.array(text + first)), "chunk": strings, "own": pa.array(own)}))
        if held:
            counts = pa.concat_tables(held).group_by(["lang", "chunk", "own"]).aggregate([([], "count_all")])
            yield from counts.rename_columns(["lang", "chunk", "own", "freq"]).select(_CHUNK.names).cast(_CHUNK).to_batches()


_BLOCK = "lang string, words long, n long, text binary, own binary, freq binary"


def _pack(block_bytes: int):
    """Blocks of chunks of one language: the chunks line by line, the words each owns, its occurrences."""
    def block(lang, held):
        table = pa.concat_tables(held)
        text = "\n".join(table.column("chunk").to_pylist()).encode()
        own, freq = table.column("own").to_numpy().astype("<i4"), table.column("freq").to_numpy().astype("<i8")
        return pa.RecordBatch.from_pydict({
            "lang": [lang], "words": [text.count(b" ") + table.num_rows], "n": [int((own * freq).sum())],
            "text": pa.array([text], pa.binary()), "own": [own.tobytes()], "freq": [freq.tobytes()]})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes = {}, {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lang in pc.unique(table.column("lang")).to_pylist():
                own = table.filter(pc.equal(table.column("lang"), lang))
                held.setdefault(lang, []).append(own)
                sizes[lang] = sizes.get(lang, 0) + pc.sum(pc.binary_length(own.column("chunk"))).as_py()
                if sizes[lang] >= block_bytes:
                    yield block(lang, held.pop(lang))
                    del sizes[lang]
            if sum(sizes.values()) >= 4 * block_bytes:  # many languages, none of which fills a block
                for lang in list(held):
                    yield block(lang, held.pop(lang))
                sizes = {}
        for lang, tables in held.items():
            yield block(lang, tables)
    return pack


def _grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each is first met, and the sum of its weights."""
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, np.int64)
    at = order[edges]
    return keys[at], at, np.add.reduceat(weights[order], edges) if len(keys) else np.zeros(0, np.int64)


class Block:
    """Phrases of a block: for each size the words' numbers, the hash and the weighted count of every distinct one."""

    def __init__(self, lang: str, text: bytes, own: bytes, freq: bytes):
        data = np.frombuffer(text, np.uint8)
        gaps = np.flatnonzero((data == 32) | (data == 10))
        starts, ends = np.append(0, gaps + 1), np.append(gaps, len(data))
        line = np.concatenate([[0], np.cumsum(data[gaps] == 10)])
        encoded = _strings(data, starts, ends).dictionary_encode()
        self.words, ids = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
        hashes = pd.util.hash_array(np.append(self.words.to_numpy(zero_copy_only=False), lang).astype(object), categorize=False)
        hashes, seed = hashes[:-1], hashes[-1]
        own, freq = np.frombuffer(own, "<i4"), np.frombuffer(freq, "<i8")
        first = np.searchsorted(line, np.arange(len(own)))
        owned = np.arange(len(ids)) - first[line] < own[line]
        weights = freq[line]
        self.phrases = []
        key, radix, count = ids, len(self.words), len(ids)
        for size in range(1, LONGEST + 1):
            if size > 1:
                count -= 1
                if int(key.max(initial=0)) * radix + radix >= 1 << 63:
                    key = np.unique(key, return_inverse=True)[1]
                key = key[:max(count, 0)] * radix + ids[size - 1:]
            at = np.flatnonzero(owned[:max(count, 0)] & (line[:max(count, 0)] == line[size - 1:]))
            _, where, sums = _grouped(key[at], weights[at])
            parts = [ids[at[where] + k] for k in range(size)]
            h = np.full(len(where), seed + np.uint64(size), np.uint64)
            for p in parts:
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + hashes[p])
            self.phrases.append((parts, h, sums))


def _keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Range and low bits of a hash."""
    return (((hashes >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _blocks(batch) -> Iterator[tuple[int, Block]]:
    for row in batch.to_pylist():
        yield row["block"], Block(row["lang"], row["text"], row["own"], row["freq"])


def _send(parts: int, least: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block in _blocks(batch):
                keys = np.concatenate([_keys(h, parts) for _, h, _ in block.phrases])
                keys, _, counts = _grouped(keys, np.minimum(np.concatenate([c for _, _, c in block.phrases]), least))
                counts = np.minimum(counts, least).astype(np.uint8)  # enough to tell whether the sum reaches it
                part = (keys >> np.uint64(32)).astype(np.int64)
                edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
                cuts = list(zip(edges, np.append(edges[1:], len(part))))
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(part[edges]), "block": pa.array([number] * len(cuts), pa.int64()),
                    "keys": pa.array([low[a:b].tobytes() for a, b in cuts], pa.binary()), "counts": pa.array([counts[a:b].tobytes() for a, b in cuts], pa.binary())})
    return send


def _frequent(least: int):
    def decide(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(k, "<u4") for k in group["keys"]])
        counts = np.concatenate([np.frombuffer(c, np.uint8) for c in group["counts"]]).astype(np.int64)
        sizes = np.array([len(c) for c in group["counts"]])
        found, _, sums = _grouped(keys, counts)
        often = found[sums >= least]
        at = np.minimum(np.searchsorted(often, keys), max(len(often) - 1, 0))
        back = often[at] == keys if len(often) else np.zeros(len(keys), bool)
        base = np.uint64(group["part"].iloc[0]) << np.uint64(32)
        ends = np.cumsum(sizes)
        return pd.DataFrame({"block": group["block"].to_numpy(), "found": [
            (keys[e - n:e][back[e - n:e]].astype(np.uint64) | base).tobytes() for e, n in zip(ends, sizes)]})
    return decide


def _count(parts: int):
    """Occurrences of the phrases of a block whose hash came back, by their words."""
    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        back = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(f, "<u8") for f in right["found"])]))
        for row in left.itertuples():
            block = Block(row.lang, row.text, row.own, row.freq)
            for size, (ids, hashes, sums) in enumerate(block.phrases, 1):
                keys = _keys(hashes, parts)
                at = np.minimum(np.searchsorted(back, keys), max(len(back) - 1, 0))
                take = np.flatnonzero(back[at] == keys) if len(back) else np.zeros(0, np.int64)
                phrase = [block.words.take(pa.array(p[take])) for p in ids]
                text = phrase[0] if size == 1 else pc.binary_join_element_wise(*phrase, pa.scalar(" ", pa.large_string()))
                rows.append(pd.DataFrame({"lang": row.lang, "size": size, "phrase": text.to_pandas(), "f": sums[take]}))
        return pd.concat(rows) if rows else pd.DataFrame({"lang": [], "size": [], "phrase": [], "f": []})
    return count


def phrase_counts(docs: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES, range_keys: int = RANGE_KEYS) -> tuple[DataFrame, DataFrame]:
    """``(lang, size, phrase, f)`` of all phrases of up to three words that occur ``least`` times, and ``(lang, n)``."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), text_of().alias("text"))
    dictionary = (rows.mapInArrow(_chunks, "lang string, chunk string, own int, freq long")
                  .groupBy("lang", "chunk", "own").agg(F.sum("freq").alias("freq")))
    packed = stored(dictionary.mapInArrow(_pack(block_bytes), _BLOCK).withColumn("block", F.monotonically_increasing_id()), "phrase-dictionary")
    totals = packed.groupBy("lang").agg(F.sum("n").alias("n"))
    words = packed.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    parts = max(1, -(-words * 2 // range_keys))
    decided = stored(packed.mapInArrow(_send(parts, least), "part long, block long, keys binary, counts binary").groupBy("part")
                     .applyInPandas(_frequent(least), "block long, found binary"), "phrase-hashes", packed=True)
    counted = (packed.groupBy("block").cogroup(decided.groupBy("block"))
               .applyInPandas(_count(parts), "lang string, size int, phrase string, f long"))
    frequent = stored(counted.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrases")
    discard(decided)
    return frequent, totals


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, **sizes: int) -> DataFrame:
    """The best phrases of every language: ``lang, rank, phrase, a, l, r, n, score``."""
    counts, totals = phrase_counts(docs, least, **sizes)
    candidates = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    word = F.split("phrase", " ")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "size", "phrase", "a", "cut", F.array_join(F.slice(word, F.lit(1), F.col("cut")), " ").alias("left"),
                       F.array_join(F.slice(word, F.col("cut") + 1, F.col("size") - F.col("cut")), " ").alias("right"))
    part = counts.select("lang", "phrase", "f")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr(
        "(1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"))
    of = lambda name, cut: F.max(F.when(F.col("cut") == cut, F.col(name))).alias(f"{name}{cut}")
    scored = cuts.groupBy("lang", "size", "phrase", "a").agg(*(of(name, cut) for name in ("l", "r", "score") for cut in range(1, LONGEST)))
    late = F.coalesce(F.col("score2") < F.col("score1"), F.lit(False))
    scored = scored.select("lang", "size", "phrase", "a", *(F.when(late, F.col(f"{name}2")).otherwise(F.col(f"{name}1")).alias(name) for name in ("l", "r", "score")))
    within = (candidates.where("size = 3").withColumn("inner", F.explode(F.array(
        F.array_join(F.slice(word, 1, 2), " "), F.array_join(F.slice(word, 2, 2), " "))))
        .groupBy("lang", F.col("inner").alias("phrase")).agg(F.max("a").alias("longer")))
    kept = (scored.join(within, ["lang", "phrase"], "left")
            .where(F.coalesce(100 * F.col("longer") < SHADOW * F.col("a"), F.lit(True)) | (F.col("size") > 2))
            .select("lang", "phrase", "a", "l", "r", "score"))
    # in two steps, so that one language is never ranked by one task alone
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = kept.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    share = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("rank") <= best)
    ranked = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
