"""Likeness of versions and the cut of the mix, next to plain versions of their rules."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from spendgrid.llm import mixing, version_sketch
from spendgrid.llm.words import mixed


def _plain_pieces(text: str) -> list[bytes]:
    """The pieces of a text, place by place."""
    out = []
    for line in text.encode().split(b"\n"):
        cuts, last = [0], 0
        for place in range(len(line) - version_sketch.WINDOW):
            window = np.array([int.from_bytes(line[place:place + 8], "little")], np.uint64)
            if int(mixed(window)[0]) % 32 == 0:
                cut = place + version_sketch.WINDOW
                if cut - last > version_sketch.LEAST:
                    cuts.append(cut)
                last = cut
        for a, b in zip(cuts, cuts[1:] + [len(line)]):
            out += [line[k:min(k + version_sketch.GREATEST, b)] for k in range(a, b, version_sketch.GREATEST)]
    return out


def _plain_likeness(one: str, other: str) -> float:
    a, b = Counter(_plain_pieces(one)), Counter(_plain_pieces(other))
    every = sum((a | b).values())
    return sum((a & b).values()) / every if every else 1.0


def _texts() -> list[str]:
    drawn = random.Random(3)
    words = ["".join(drawn.choice("abcdefgh éß") for _ in range(drawn.randint(1, 9))) for _ in range(300)]
    prose = [" ".join(drawn.choice(words) for _ in range(n)) for n in (0, 1, 5, 40, 400, 400, 2000)]
    lines = "\n".join(" ".join(drawn.choice(words) for _ in range(12)) for _ in range(60))
    return [*prose, prose[4], lines, lines[:900] + "x" + lines[900:], "a" * 3000, "\n\n\n", "b\n\nb\n", "c" * 255 + "\n" + "c" * 257]


def test_likeness_is_that_of_the_pieces(spark):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in version_sketch.versions(docs).collect()}
    for i, text in enumerate(texts):
        following = texts[i - 1]
        assert abs(got[i].near_next - _plain_likeness(text, following)) < 1e-9
        assert abs(got[i].near_edited - _plain_likeness(text, version_sketch.edit(text, following))) < 1e-9
    assert got[4].fingerprint == got[7].fingerprint


def test_an_inserted_letter_changes_few_pieces():
    drawn = random.Random(5)
    line = "".join(drawn.choice("abcdefghijklmnopqrst ") for _ in range(3000))
    changed = [line[:k] + "Z" + line[k:] for k in (0, 1, 700, 1500, 2999, 3000)]
    owner, keys = version_sketch.paragraph_keys(version_sketch.pa.array([line, *changed], version_sketch.pa.large_string()))
    near = version_sketch.likeness(owner, keys, 7, np.zeros(6, int), np.arange(1, 7))
    assert near.min() > 0.9


def test_the_cut_of_the_mix_is_that_of_one_walk(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    drawn = random.Random(7)
    sources = ["hot"] * 300 + ["mid"] * 60 + [None] * 40 + ["small"] * 5 + ["none"] * 3
    rows = [(k, s, " ".join(["w"] * (0 if s == "none" else drawn.randint(0, 30)))) for k, s in enumerate(sources)]
    docs = spark.createDataFrame(rows + rows[:4], "doc_id long, source string, text string")
    measured = mixing.measured(docs)
    weights = mixing.source_weights(measured, 0.8, 0.9, 3.0)
    by_source = {r.source: r for r in weights.collect()}
    want, groups = {}, defaultdict(list)
    for (k, s, text), same in Counter(rows + rows[:4]).items():
        place = hashlib.md5(":".join(x for x in ("mix", s, str(k), hashlib.sha256(text.encode()).hexdigest()) if x is not None).encode()).hexdigest()
        block = int(place[:8], 16) % -(-by_source[s].rows // 8)
        turn = hashlib.md5(":".join(x for x in ("mix", s, str(block)) if x is not None).encode()).hexdigest()
        groups[s].append((turn, block, place, k, len(text.split()) * same))
    for s, members in groups.items():
        passes, rest = by_source[s].passes, by_source[s].rest
        end_of_block, walked = {}, 0
        for turn, block, *_, tokens in sorted(members):
            walked += tokens
            end_of_block[block] = walked
        walked = 0
        for turn, block, place, k, tokens in sorted(members):
            if end_of_block[block] <= rest:
                taken = True
            else:  # rows of the block that holds the cut are taken while they begin before it
                taken = walked < rest
            want[k] = passes + (taken and rest > 0)
            walked += tokens
    got = {r.doc_id: r.copies for r in mixing.permuted_copies(measured, weights).collect()}
    assert got == want
    assert 0 < sum(c == by_source["hot"].passes for k, c in got.items() if k < 300) < 300
