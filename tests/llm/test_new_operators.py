"""Collocations, licence scan and turn repair against brute force, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from spendgrid.llm import anchor_dedup, collocations, exact_dedup, license_scan, mixing, ngram_join, quality, queries, suffix_dedup, turn_repair

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       *(T.StructField(c, T.StringType()) for c in ("chunk", "freq", "own", "key", "word", "held", "block", "n"))])
TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                      T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in ("key", "at", "sha", "pos", "block"))])


def _frame(spark, rows, schema):
    return spark.createDataFrame([(*r, *["x"] * (len(schema) - len(r))) for r in rows], schema)


def _texts():
    draw = np.random.default_rng(4)
    words = ["the", "of", "And", "new", "york", "city", "é\x01x", "日本", "a", "x-y"]
    prose = [" ".join(draw.choice(words, 60, p=np.array([9, 7, 6, 4, 4, 4, 2, 2, 3, 1]) / 42)) for _ in range(30)]
    texts = [p[:90] + ". " + p[90:150] + ",\n" + p[150:] for p in prose]
    texts += ["New York City! " * 8, "New  York\tCity? " * 8, "x " * 900, None, "", " \t\n", ".,;", "one", "a\x0bb\x0cc", texts[0], texts[0], "word" * 3000 + " end of it. " * 12]
    return [(None if i == 7 else i, t, None if i % 9 == 0 else ("en", "fr")[i % 2]) for i, t in enumerate(texts)] + [(3, texts[3], "fr")]


def _phrases(rows, least, best):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            counts[lang].update(tuple(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            for inner in ((p[:2], p[1:]) if len(p) == 3 else ()):
                longer[inner] = max(longer[inner], a)
        kept = []
        for p, a in candidates.items():
            if len(p) == 3 or 100 * longer[p] < 50 * a:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:best], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, best, sizes", [(10, 2000, {}), (2, 25, {"block_bytes": 400, "range_keys": 60})])
def test_collocations(spark, least, best, sizes):
    rows = _texts()
    got = collocations.collocations(_frame(spark, rows, SCHEMA).repartition(3), least, best, **sizes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = _phrases(rows, least, best)
    assert len(want) > 20 and sorted(tuple(r) for r in got.collect()) == want


def test_collocations_of_nothing(spark):
    assert collocations.collocations(_frame(spark, [], SCHEMA)).count() == 0
    assert collocations.collocations(_frame(spark, [(1, None, None), (2, " ", "en")], SCHEMA)).count() == 0


def test_chunks_own_every_word_once():
    texts = [(t or "").encode() for _, t, _ in _texts()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    strings, own, text = collocations.parse(data, offsets, trigger=3)
    n = Counter()
    for s, k, i in zip(strings.to_pylist(), own, text):
        assert k <= len(s.split(" ")) <= k + collocations.LONGEST - 1
        n[int(i)] += int(k)
    plain = [len(re.findall(r"[^\x20\x09-\x0D.,;:!?]+", t.decode())) for t in texts]
    assert [n[i] for i in range(len(texts))] == plain
    whole = collocations.parse(np.frombuffer(b"one two three. " * 50, np.uint8), np.array([0, 750]), trigger=2)[0]
    assert len(set(whole.to_pylist())) <= 3  # equal passages are cut alike


NOTICES = ["Licensed under CC BY-NC 4.0.", "licensed under the APACHE License, version 2.0", "All Rights Reserved cc by all rights\nreserved",
           "This work is licensed under the GNU General Public License, version 3.", "general public licence", "apache license", "version 2 apache the license",
           "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its associated documentation files",
           "Permission is hereby granted, and so on, to a person with documentation files of software"]


def _licensed():
    draw = np.random.default_rng(2)
    prose = [" ".join("".join(draw.choice(list("abcdeéñ"), 4)) for _ in range(50)) for _ in range(9)]
    rows = [f"{p}\n{n} {p[::-1]}" for p, n in zip(prose, NOTICES)] + NOTICES + prose
    rows += [None, "", " ", "-", "cc", "by", "cc by", "CC\x00BY", NOTICES[0], NOTICES[0], "license " * 500 + NOTICES[1], ("filler text " * 30000) + NOTICES[3], "averyveryverylongwordindeed cc by"]
    return [(None if i == 3 else i, t, "en") for i, t in enumerate(rows)]


def _base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
              for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def test_licences(spark):
    rows = _licensed()
    docs = _frame(spark, rows, SCHEMA).repartition(3)
    index = license_scan.weighed_index(docs)
    got = license_scan.scan(docs, index).collect()
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    want = sorted(((i, *_base(t)) for i, t, _ in rows), key=key)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == want
    by = {r.doc_id: r for r in got}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    for i, labels in ((0, "cc-by,cc-by-nc-4.0"), (1, "apache-2.0"), (4, ""), (5, ""), (6, ""), (7, "mit"), (8, ""), (len(NOTICES) * 2, "")):
        assert by[i].labels == labels, (i, by[i])
    long = next(r for r in got if r.n_words > 50000)
    assert long.labels == "gpl,gpl-3.0" and long.matches[0].first_word == 60000
    assert license_scan.scan(_frame(spark, [], SCHEMA), license_scan.weighed_index(_frame(spark, [], SCHEMA))).count() == 0


def test_word_counts_of_the_index(spark):
    rows = _licensed()
    index = license_scan.weighed_index(_frame(spark, rows, SCHEMA).repartition(4))
    for k, word in enumerate(index.vocabulary.words):
        held = sum(word in license_scan.words_of(t or "") for _, t, _ in rows)
        assert index.idf[k] == pytest.approx(np.log1p(len(rows) / (1 + held)) + 1e-9)


def test_vocabulary_compares_all_bytes():
    known = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefghij", "zz", "é", "abcdefghijklmnopq"]
    words = known + ["abcdefg", "abcdefghk", "b", "abcdefghijklmnop", "abcdefghijklmnopqr"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.append(0, ends[:-1] + 1)
    assert license_scan.Vocabulary(known).find(data, starts, ends).tolist() == [*range(len(known)), -1, -1, -1, -1, -1]


def _damage(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def _repaired(rows):
    """One conversation's results by trying all edits."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        options = []
        if i == len(rows):
            if state in (0, 3):
                options.append((0, "", ()))
        else:
            more = faults[i] == "truncated"
            options.append(add(best(i + 1, state, 0), 3, "D", None))
            if faults[i] not in ("blank", "duplicate"):
                if rows[i][2][:1] in step[state]:
                    options.append(add(best(i + 1, step[state][rows[i][2][:1]], 0), more, "K", f"{rows[i][2]}:{rows[i][3]}"))
                for role in ("user", "assistant"):
                    if role[0] in step[state]:
                        options.append(add(best(i + 1, step[state][role[0]], 0), 2 + more, "R", f"{role}:{rows[i][3]}"))
        for role in ("user", "assistant") if inserted < 3 else ():
            if role[0] in step[state]:
                options.append(add(best(i, step[state][role[0]], inserted + 1), 2, "I", f"{role}:"))
        return min(options, key=lambda o: o[:2]) if options else (10 ** 9, "", ())

    def add(rest, cost, letter, line):
        return rest[0] + cost, letter + rest[1], ((line,) if line is not None else ()) + rest[2]
    cost, audit, lines = best(0, 0, 0)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _conversations():
    draw, rows = np.random.default_rng(9), []
    for conv in range(60):
        for turn in range(int(draw.integers(1, 14))):
            text = str(draw.choice(["Yes.", "No!", "why", "", " \n", None, "Same. ", "a?  ", "end"])) if draw.random() < 0.5 else f"text {conv} {turn}."
            rows.append((None if conv == 5 else conv, None if draw.random() < 0.1 else turn + 10 * (draw.random() < 0.2),
                         str(draw.choice(["user", "assistant", "system", "tool", ""], p=[.4, .35, .1, .1, .05])), None if text == "None" else text))
    rows += [(100, t, "user", f"only users {t}.") for t in range(40)] + [(101, t, "tool", f"others {t}" + "." * (t % 2)) for t in range(40)]
    rows += [(102, t, ("user", "assistant")[t % 2], "long text. " * 900) for t in range(12)] + [(103, 1, "user", "again.")] * 30 + [(104, None, None, None)] * 3
    gone = [t for t in range(200) if zlib.crc32(f"105:{t}".encode()) % 20 == 0]
    rows += [(105, gone[0], "user", "all of it goes.")]
    return rows


@pytest.mark.parametrize("block, fixups", [(4096, 6), (2, 8), (5, 0), (40, 3)])
def test_turn_repair(spark, block, fixups):
    rows = _conversations()
    groups = {c: [] for c in {r[0] for r in rows}}
    for r in _damage(rows):
        groups[r[0]].append(r)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: _repaired(g) if g else empty for c, g in groups.items()}
    got = turn_repair.repair(_frame(spark, rows, TURNS).repartition(3), block, fixups).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(want) and want[105] == empty
    assert got[0].asDict().keys() == {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"}


def test_turn_repair_of_nothing(spark):
    assert turn_repair.repair(_frame(spark, [], TURNS)).count() == 0


def test_vectors_stay_few_and_runs_converge():
    assert len(turn_repair.VECTORS) < 64
    mixed = bytes(np.random.default_rng(1).choice([1, 3, 5, 7, 0, 4, 6], 300).tolist())
    assert len({turn_repair.run_back(mixed, v) for v in range(len(turn_repair.VECTORS))}) == 1
    for v in range(len(turn_repair.VECTORS)):
        assert turn_repair.run_back(mixed, v, turn_repair.END, turn_repair.run_back(mixed, turn_repair.END)) == turn_repair.run_back(mixed, v)


def test_registered_queries(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = queries.QUERIES["op11_collocations"](spark, folder)
    assert sorted(tuple(r) for r in got.collect()) == _phrases([(r.doc_id, r.text, r.lang) for r in docs], 10, 2000)
    got = queries.QUERIES["op12_license_scan"](spark, folder).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word or -1, r.last_word or -1, r.base_labels) for r in got) == sorted(
        (r.doc_id, b[0], b[1], b[2] or -1, b[3] or -1, b[4]) for r in docs for b in [_base(r.text)])
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    groups = {r[0]: [] for r in rows}
    for r in _damage(rows):
        groups[r[0]].append(r)
    got = queries.QUERIES["op13_turn_repair"](spark, folder).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {c: _repaired(g) for c, g in groups.items()}


def _thue_morse(n, flipped):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ["ab"[b ^ flipped] for b in bits]


def test_texts_built_to_agree_in_sums_of_powers(spark):
    """Letters after the Thue-Morse sequence or its complement, for which polynomials modulo 2**64 agree whatever the base."""
    letters = np.random.default_rng(3).choice(list("cdefgh"), 2048)
    texts = ["".join(x + y for x, y in zip(letters, _thue_morse(2048, f))) for f in (0, 1)]
    runs = [{t[i:i + 200] for i in range(len(t) - 199)} for t in texts]
    assert not runs[0] & runs[1]
    words = [f"w{i}" for i in range(35)]
    texts += [" ".join([*words[:17], "".join(_thue_morse(2048, f)), *words[18:]]) for f in (0, 1)]
    docs = _frame(spark, [(i, t, "en") for i, t in enumerate(texts)], SCHEMA)
    seen = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    want = {k: len({j for i in range(len(t) - 199) if seen[t[i:i + 200]] > 1 for j in range(i, i + 200)}) for k, t in enumerate(texts)}
    assert want[0] == want[1] == 0 and {r.doc_id: r.n_removed for r in suffix_dedup.repeats(docs).collect()} == want
    assert {r.doc_id: r.n_removed for r in anchor_dedup.repeats(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 0}
    assert {r.doc_id: r.component_id for r in ngram_join.similar_groups(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_columns_that_clash_with_helpers(spark):
    names = ["_id", "_ID2", "_twice", "_sha", "_copy", "_copies", "_source", "_rating", "x_id"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                           *(T.StructField(c, T.StringType()) for c in names)])
    rows = [(1, "one two three four five six", "a"), (2, "one two three four five six", "a"), (None, None, None), (3, "", "b"), (3, "", "b"), (4, "seven eight", "b")]
    docs = spark.createDataFrame([(*r, *(f"{c}{k}" for c in names)) for k, r in enumerate(rows)], schema)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 5)], "doc_id long, quality int, toxic int")
    for step in (lambda d: exact_dedup.drop_copies(d), lambda d: ngram_join.one_of_each(d), lambda d: mixing.mixed_documents(d, budget=None), lambda d: quality.keep_good(d, labels)):
        got = step(docs)
        assert got.columns == docs.columns
        assert all(r[c].startswith(c) for r in got.collect() for c in names)
