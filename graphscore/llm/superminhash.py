"""SuperMinHash signatures (Ertl, 2017), vectorised over many sets at once.

Every element has a pseudorandom permutation of the m registers; in round j it offers j + uniform to the register that
its permutation names next. A set stops once no register can still improve, which for sets well over m takes one round.
"""

from __future__ import annotations

import numpy as np

from .hashing import U, mixed

_GOLD = 0x9E3779B97F4A7C15


def signatures(values: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """One row of m register values (float64) for each set ``values[at[i]:at[i + 1]]`` of distinct hashes; inf throughout for an empty set."""
    n = len(at) - 1
    sizes = np.diff(at)
    out = np.full((n, m), np.inf)
    row = np.repeat(np.arange(n), sizes)
    element, shuffle = values, None
    with np.errstate(over="ignore"):
        for j in range(m):
            x = mixed(element + U((j * 2 + 1) * _GOLD & (2**64 - 1)))
            uniform = (x >> U(11)).astype(np.float64) * 2.0**-53
            pick = j + (mixed(x + U(_GOLD)) >> U(40)).astype(np.int64) * (m - j) // (1 << 24)
            if j == 0:
                register, first = pick, pick
            else:
                if shuffle is None:  # only sets that need a second round get permutations
                    shuffle = np.tile(np.arange(m, dtype=np.int16), (len(element), 1))
                    each = np.arange(len(element))
                    shuffle[each, 0], shuffle[each, first] = first, 0
                each = np.arange(len(element))
                register = shuffle[each, pick].astype(np.int64)
                shuffle[each, pick] = shuffle[each, j]
            np.minimum.at(out.reshape(-1), row * m + register, uniform + j)
            # a set goes on while some register is above what the next round can offer
            going = (out > j + 1).any(1)
            keep = going[row]
            if not keep.any():
                break
            if not keep.all():
                element, row = element[keep], row[keep]
                first = first[keep] if shuffle is None else first
                shuffle = None if shuffle is None else shuffle[keep]
    return out
