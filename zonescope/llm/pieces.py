"""What the encoders share: white space, bounded parts of a list, and lists of ids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Where a space has no other white space beside it, a pre-token starts at it, whatever the pattern's
#: letters and signs are: so such texts are cut at their spaces first.
SPACES_MEET = re.compile(r" \s|\s ")
USUAL = "\n\t\r"
RARE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in f" {USUAL}"]
MEETING = ["  ", *(pair for c in USUAL for pair in (f" {c}", f"{c} "))]


def spaces_meet(text: str) -> bool:
    """Whether white space stands beside a space; plain searches tell for most texts."""
    if any(c in text for c in RARE):
        return SPACES_MEET.search(text) is not None
    return any(pair in text for pair in MEETING)


def by_size(items: list, size, most: int) -> Iterator[list]:
    """Cut a list where the sizes of a part reach ``most``."""
    part, total = [], 0
    for item in items:
        part.append(item)
        total += size(item)
        if total >= most:
            yield part
            part, total = [], 0
    if part:
        yield part


def id_lists(rows: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])])
    return pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))
