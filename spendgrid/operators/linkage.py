"""Grouping rules on the names of one unit, in memory bounded by the unit; larger units are handled by :mod:`grouping`."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

TILE = 256
DIGITS = 12

#: ``scores(i, j, k)`` gives the similarities of names i to j (exclusive) with names 0 to k (exclusive).
Scores = Callable[[int, int, int], np.ndarray]


def leaders(n: int, scores: Scores, threshold: float) -> np.ndarray:
    """Each name joins the most similar earlier leader in reach, the earliest of equals, or becomes one."""
    reps = np.arange(n)
    own: list[int] = []
    for start in range(0, n, TILE):
        block = scores(start, min(n, start + TILE), min(n, start + TILE))
        for i in range(start, min(n, start + TILE)):
            if own:
                near = block[i - start, own]
                best = int(near.argmax())
                if near[best] >= threshold:
                    reps[i] = own[best]
                    continue
            own.append(i)
    return reps


def complete_link(n: int, scores: Scores, threshold: float, before: list[dict[int, float]] | None = None,
                  names: np.ndarray | None = None) -> np.ndarray:
    """Each name joins the group all of whose members are in reach, the one whose least similar member is most similar.

    ``before`` has, for every name, the groups settled earlier that are wholly in reach, by representative and least score;
    ``names`` are the numbers of the names, which representatives share.  Only groups within reach are looked at.
    """
    names = np.arange(n) if names is None else names
    inside = set(names.tolist())
    reps = np.zeros(n, np.int64)
    members: dict[int, int] = {}  # of a group, among these names
    for start in range(0, n, TILE):
        stop = min(n, start + TILE)
        block = scores(start, stop, stop)
        for i in range(start, stop):
            row = block[i - start, :i]
            near = np.flatnonzero(row >= threshold)
            groups, which = np.unique(reps[near], return_inverse=True)
            counts = np.bincount(which, minlength=len(groups))
            least = np.full(len(groups), np.inf)
            np.minimum.at(least, which, row[near])
            settled = before[i] if before is not None else {}
            open_to = {}
            for g, count, low in zip(groups.tolist(), counts.tolist(), least.tolist()):
                if count == members[g] and (g in inside or g in settled):
                    open_to[g] = min(low, settled.get(g, np.inf))
            for g, low in settled.items():
                if g not in members:
                    open_to[g] = low
            best = min(open_to.items(), key=lambda x: (-x[1], x[0]))[0] if open_to else int(names[i])
            reps[i] = best
            members[best] = members.get(best, 0) + 1
    return reps


def density(n: int, scores: Scores, eps: float, min_samples: int) -> np.ndarray:
    """The first name of every name's cluster, or -1 for noise; a border name goes to the earliest cluster in reach."""
    near, held = {}, []
    for start in range(0, n, TILE):
        within = 1.0 - scores(start, min(n, start + TILE), n) <= eps
        held.append(within.sum(axis=1))
        for i in np.flatnonzero(held[-1]):
            near[start + int(i)] = np.flatnonzero(within[i])
    held = np.concatenate(held)
    core = held >= min_samples
    label = np.full(n, -1, np.int64)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack, label[i] = [i], i
            while stack:
                for j in near[stack.pop()]:
                    if core[j] and label[j] < 0:
                        label[j] = i
                        stack.append(int(j))
    for i in np.flatnonzero(~core & (held > 0)):
        around = near[i][core[near[i]]]
        if len(around):
            label[i] = label[around].min()
    return label


def average_link(mean: np.ndarray, count: np.ndarray, distance: float) -> np.ndarray:
    """The group each of some groups ends in when mutually nearest ones merge until none is within ``distance``.

    Average linkage never brings a merged group closer to a third one than its parts were: a group whose nearest one did
    not merge keeps it, so only the others look again.  Groups come in order; the earlier of equals counts as nearest.
    """
    mean, count, n = mean.copy(), count.astype(np.float64), len(mean)
    into, alive = np.arange(n), np.ones(n, bool)
    nearest, score, look = np.full(n, -1), np.full(n, -np.inf), np.arange(n)
    while True:
        living = np.flatnonzero(alive)
        for start in range(0, len(look), TILE):
            rows = look[start:start + TILE]
            found = np.round(mean[rows] @ mean[living].T, DIGITS)
            found[rows[:, None] == living[None, :]] = -np.inf
            if len(living) > 1:
                j = found.argmax(axis=1)
                nearest[rows], score[rows] = living[j], found[np.arange(len(rows)), j]
        if len(living) < 2:
            return into
        mutual = living[(nearest[nearest[living]] == living) & (living < nearest[living]) & (1.0 - score[living] <= distance)]
        if not len(mutual):
            return into
        gone = nearest[mutual]
        total = count[mutual] + count[gone]
        mean[mutual] = (mean[mutual] * count[mutual, None] + mean[gone] * count[gone, None]) / total[:, None]
        count[mutual], alive[gone] = total, False
        target = np.arange(n)
        target[gone] = mutual
        into = target[into]
        changed = np.zeros(n, bool)
        changed[mutual] = changed[gone] = True
        look = np.flatnonzero(alive & (changed | changed[nearest]))
