"""Context-tree weighting over binary decisions: the tree's estimates and their mixing, for arrays of (context, byte) pairs.

A byte is eight binary decisions, each at its own node (the bits so far, 1 to 255) of a context tree over the DEPTH bytes
before it. At every context the node's Krichevsky-Trofimov estimate is mixed, half and half, with the product of the
contexts one byte longer; so all depths are mixed by what they have foretold of the training text.

A pair is a 64-bit key: the last byte of context in its top byte, then the ones before it, and the byte itself at the
bottom. A branch is the part of the tree below some contexts of two bytes; branches are worked out one by one, and what
they share, the contexts of one byte and of none, is the top, of 256 * 255 nodes at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of context; with the byte itself they fit a 64-bit number.
DEPTH = 6
HALF = np.log(0.5)
LOG10 = np.log(10.0)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for positive numbers: Stirling's series seven places further up."""
    up = np.ones_like(x)
    for k in range(7):
        up *= x + k
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(up)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov estimate of so many zeros and ones; they are mostly few, so that of equal counts it
    is worked out once."""
    small = (zeros < len(_KT)) & (ones < len(_KT))
    out = np.empty(len(zeros))
    out[small] = _KT[zeros[small].astype(np.int64), ones[small].astype(np.int64)]
    z, o = zeros[~small], ones[~small]
    out[~small] = lgamma(z + 0.5) + lgamma(o + 0.5) - lgamma(z + o + 1.0) - np.log(np.pi)
    return out


_COUNTS = np.arange(64.0)[:, None]
_KT = lgamma(_COUNTS + 0.5) + lgamma(_COUNTS.T + 0.5) - lgamma(_COUNTS + _COUNTS.T + 1.0) - np.log(np.pi)


def own_share(kt: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The weight of a node's own estimate against that of the contexts below it."""
    return 1 / (1 + np.exp(np.clip(below - kt, -700, 700)))


@dataclass
class Level:
    """Nodes of one depth for one bit of the byte: keys, counts, log weights; parent: each one's place a depth up."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    kt: np.ndarray
    below: np.ndarray
    weight: np.ndarray
    parent: np.ndarray


def levels(keys: np.ndarray, counts: np.ndarray, bit: int) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """(levels of depth 2 to DEPTH, each pair's node in the deepest, each pair's bit) of a branch's sorted distinct keys.

    Pairs that are counted 0 times have nodes too: without counts a node weighs nothing and its chances are even.
    """
    byte, context = keys & 255, keys >> 8
    node = (1 << bit) | (byte >> (8 - bit))
    one = (byte >> (7 - bit) & 1).astype(bool)
    at = context << 8 | node  # sorted, as keys are
    new = np.diff(at, prepend=-1) != 0
    back = deepest = np.cumsum(new) - 1
    at = at[new]
    ones = np.bincount(back, weights=np.where(one, counts, 0), minlength=len(at))
    zeros = np.bincount(back, weights=np.where(one, 0, counts), minlength=len(at))
    kt = log_kt(zeros, ones)
    out = [Level(at, zeros, ones, kt, kt, kt, back)]
    for _ in range(DEPTH - 2):
        child = out[0]
        at, child.parent = np.unique((child.keys >> 16 << 8) | (child.keys & 255), return_inverse=True)
        zeros, ones, below = (np.bincount(child.parent, weights=w, minlength=len(at)) for w in (child.zeros, child.ones, child.weight))
        kt = log_kt(zeros, ones)
        out.insert(0, Level(at, zeros, ones, kt, below, np.logaddexp(HALF + kt, HALF + below), child.parent))
    return out, deepest, one


def above(level: Level) -> np.ndarray:
    """For each node of depth 2 the place of its node of depth 1 in the top: last byte << 8 | node."""
    return (level.keys >> 16 & 255) << 8 | (level.keys & 255)


def branch_top(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node of depth 1, zeros, ones, weight below) that a branch adds to the top; a node may come several times."""
    parts = []
    for bit in range(8):
        two = levels(keys, counts, bit)[0][0]
        up, back = np.unique(above(two), return_inverse=True)
        parts.append((up, *(np.bincount(back, weights=w, minlength=len(up)) for w in (two.zeros, two.ones, two.weight))))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def top_of_tree(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(sum, rest) by last byte << 8 | node, from (node, zeros, ones, weight below) of depth 1: depths 0 and 1 mixed."""
    zeros, ones, below = np.zeros((3, 1 << 16))
    for k, z, o, w in rows:
        zeros[k], ones[k], below[k] = z, o, w
    seen = zeros + ones > 0
    kt1 = log_kt(zeros, ones)
    weight1 = np.where(seen, np.logaddexp(HALF + kt1, HALF + below), 0.0).reshape(256, 256).sum(axis=0)
    z0, o0 = zeros.reshape(256, 256).sum(axis=0), ones.reshape(256, 256).sum(axis=0)
    own0 = np.where(z0 + o0 > 0, own_share(log_kt(z0, o0), weight1), 0.0)
    sum0, rest0 = own0 * (o0 + 0.5) / (z0 + o0 + 1), 1 - own0
    own1 = np.where(seen, own_share(kt1, below), 0.0)
    total = np.tile(sum0, 256) + np.tile(rest0, 256) * own1 * (ones + 0.5) / (zeros + ones + 1)
    return total, np.tile(rest0, 256) * (1 - own1)


def log10_chances(keys: np.ndarray, counts: np.ndarray, top: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the chance of each pair's byte in its context, for a branch's sorted distinct keys."""
    out = np.zeros(len(keys))
    for bit in range(8):
        tree, deepest, one = levels(keys, counts, bit)
        up = above(tree[0])
        total, rest = top[0][up], top[1][up]
        for d, x in enumerate(tree):
            if d:
                total, rest = total[x.parent], rest[x.parent]
            estimate = (x.ones + 0.5) / (x.zeros + x.ones + 1)
            own = np.ones(len(x.keys)) if d == DEPTH - 2 else own_share(x.kt, x.below)
            total, rest = total + rest * own * estimate, rest * (1 - own)
        chance = total[deepest]
        out += np.log(np.maximum(np.where(one, chance, 1 - chance), 1e-300))
    return out / LOG10
