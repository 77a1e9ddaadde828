"""Moving many small numbers between tasks as a few binary rows.

Rows of (part, head, body) carry, for one part of a hash space, the values of many documents:
``head`` lists (document key, number of values) and ``body`` the values one after another. That keeps
the shuffle near the size of the values themselves and spares a row for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SCHEMA = "part int, head binary, body binary"
HEAD = np.dtype([("key", "<i8"), ("count", "<u4")])
#: The same with a number that belongs to the document.
SIZED = np.dtype([*HEAD.descr, ("size", "<u4")])


def pack(part: np.ndarray, owner: np.ndarray, keys: np.ndarray, values: np.ndarray, sizes: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each part. ``owner`` (ascending) gives each value's place in ``keys`` and, if given, in ``sizes``."""
    order = np.argsort(part, kind="stable")
    part, owner, values = part[order], owner[order], values[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    parts, heads, bodies = [], [], []
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(part)]):
        if a == b:
            continue
        mine = owner[a:b]
        first = np.r_[0, np.flatnonzero(np.diff(mine)) + 1]
        head = np.empty(len(first), HEAD if sizes is None else SIZED)
        head["key"] = keys[mine[first]]
        if sizes is not None:
            head["size"] = sizes[mine[first]]
        head["count"] = np.diff(np.r_[first, b - a])
        parts.append(int(part[a]))
        heads.append(head.tobytes())
        bodies.append(values[a:b].tobytes())
    return pa.record_batch([pa.array(parts, pa.int32()), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], ["part", "head", "body"])


def unpack(batches: Iterator[pa.RecordBatch], dtype: np.dtype, sized: bool = False) -> tuple[np.ndarray, ...]:
    """(part, key, value), and size if ``sized``, of every value in the batches, as arrays."""
    kind = SIZED if sized else HEAD
    parts, heads, values = [], [], []
    for batch in batches:
        for p, h, b in zip(*(batch.column(k).to_pylist() for k in range(3))):
            head, body = np.frombuffer(h, kind), np.frombuffer(b, dtype)
            parts.append(np.full(len(body), p, np.uint64))
            heads.append(np.repeat(head[["key", "size"]] if sized else head["key"], head["count"]))
            values.append(body)
    if not parts:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, dtype), *([np.zeros(0, np.uint32)] if sized else []))
    part, head, value = np.concatenate(parts), np.concatenate(heads), np.concatenate(values)
    return (part, head["key"], value, head["size"]) if sized else (part, head, value)
