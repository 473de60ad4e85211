"""Fields of many protocol buffer messages at once: one pass of array operations reads the next field of every message, or
writes a field of all of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes after the data that a pass may look at.
PAD = 16


@dataclass
class Fields:
    """Fields by message, and in each in order; ``at`` and ``size`` tell where a field's bytes lie, ``value`` its number."""

    message: np.ndarray
    number: np.ndarray
    wire: np.ndarray
    value: np.ndarray
    at: np.ndarray
    size: np.ndarray

    def where(self, mask: np.ndarray) -> Fields:
        return Fields(*(getattr(self, n)[mask] for n in ("message", "number", "wire", "value", "at", "size")))


def varints(data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that begin at each place and where they end, -1 for those that do not end before ``stop``."""
    value, end, open_ = np.zeros(len(at), _U), np.full(len(at), -1, np.int64), np.arange(len(at))
    for k in range(10):
        place = at[open_] + k
        byte, inside = data[place], place < stop[open_]
        value[open_] |= (byte & 127).astype(_U) << _U(7 * k)
        last = inside & (byte < 128)
        end[open_[last]] = place[last] + 1
        open_ = open_[inside & (byte > 127)]
        if not len(open_):
            break
    return value, end


def scan(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[Fields, np.ndarray]:
    """The fields of the messages that lie from start to stop in ``data``, and which messages are malformed; groups count
    as such. ``data`` has PAD bytes at its end that belong to none."""
    at, bad = start.astype(np.int64), np.zeros(len(start), bool)
    live, found = np.flatnonzero(at < stop), []
    while len(live):
        tag, after = varints(data, at[live], stop[live])
        wire = (tag & _U(7)).astype(np.int64)
        number = (tag >> _U(3)).astype(np.int64)
        ok = (after >= 0) & (number > 0) & np.isin(wire, (0, 1, 2, 5))
        counted = ok & ((wire == 0) | (wire == 2))
        value, begin = np.zeros(len(live), _U), after.copy()
        value[counted], begin[counted] = varints(data, after[counted], stop[live[counted]])
        ok &= begin >= 0
        room = np.maximum(stop[live] - begin, 0)
        # A length that does not fit may be any 64-bit number.
        size = np.where(wire == 2, np.minimum(value, _U(1 << 40)).astype(np.int64), np.where(wire == 1, 8, np.where(wire == 5, 4, 0)))
        ok &= size <= room
        bad[live[~ok]] = True
        live, number, wire, value, begin, size = (x[ok] for x in (live, number, wire, value, begin, size))
        found.append((live, number, wire, value, begin, size))
        at[live] = begin + size
        live = live[at[live] < stop[live]]
    if not found:
        none = np.zeros(0, np.int64)
        return Fields(none, none, none, none.astype(_U), none, none), bad
    columns = [np.concatenate(c) for c in zip(*found)]
    order = np.argsort(columns[0], kind="stable")
    return Fields(*(c[order] for c in columns)), bad


def slices(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """Stretches of ``data`` as a binary column."""
    ends = np.concatenate([[0], np.cumsum(size)])
    raw = data[np.repeat(at - ends[:-1], size) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def column(data: np.ndarray, fields: Fields, n: int, number: int, kind: str) -> pa.Array:
    """A scalar field of n messages, the last where it repeats, its default where it is absent. Raises ArrowInvalid for text
    that is none. Kinds as the contract's tables have them."""
    own = fields.where((fields.number == number) & (fields.wire == {"f": 5, "s": 2}.get(kind, 0)))
    if kind == "s":
        # Every one must be text, also those that a later one replaces; the empty text is added at the end.
        texts = slices(data, np.append(own.at, 0), np.append(own.size, 0)).cast(pa.string())
        last = np.full(n, len(own.at), np.int64)
        last[own.message] = np.arange(len(own.at))
        return texts.take(pa.array(last))
    if kind == "f":
        out = np.zeros(n, np.float64)
        out[own.message] = np.ascontiguousarray(data[own.at[:, None] + np.arange(4)]).view("<f4").ravel()
        return pa.array(out)
    whole = np.zeros(n, np.int64)
    whole[own.message] = own.value.view(np.int64)
    return pa.array(whole != 0) if kind == "b" else pa.array(whole)


def varint_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of 64-bit numbers, in rows as wide as the longest, and how many of a row are the number's."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= _U(1 << 7 * k)
    rows = np.empty((len(values), int(size.max(initial=1))), np.uint8)
    for k in range(rows.shape[1]):
        rows[:, k] = (values >> _U(7 * k)) & _U(127)
        rows[:, k] |= (size > k + 1).astype(np.uint8) << 7
    return rows, size


def packed(prefix: bytes, rows: np.ndarray, size: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """The prefix and the first bytes of each row, so many as ``size`` says, as a binary column; empty where not ``there``."""
    whole = np.hstack([np.tile(np.frombuffer(prefix, np.uint8), (len(rows), 1)), rows])
    size = size + len(prefix) if there is None else np.where(there, size + len(prefix), 0)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    raw = whole[np.arange(whole.shape[1]) < size[:, None]]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
