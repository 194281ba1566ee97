"""Plain versions of operators, for small tests."""

import hashlib

import numpy as np


def brute_force(rows: list[tuple[int, bytes]], length: int) -> dict[int, tuple[int, int, int, str]]:
    """What suffix_dedup() gives, by a set of all strings; for small tests."""
    seen: set[bytes] = set()
    out = {}
    for k, s in sorted(rows):
        gone = np.zeros(len(s) + 1, bool)
        for p in range(len(s) - length + 1):
            if s[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(s[p : p + length])
        kept = bytes(c for c, g in zip(s, gone[:-1], strict=True) if not g)
        out[k] = (len(s), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out
