"""WKB of whole columns of points, lines and polygons, by their buffers: no Python object a geometry."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.types import DIMS, KINDS

#: Kinds that are done here, with the lists they nest.
DEPTHS = {"point": 0, "linestring": 1, "polygon": 2}
#: Vertices that are moved at a time.
_SOME = 1 << 18


def _put(out: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
    """Rows of bytes to places in out."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    raw, at = values.view(np.uint8).reshape(len(places), width), np.arange(width)
    for k in range(0, len(places), _SOME):
        out[places[k : k + _SOME, None] + at] = raw[k : k + _SOME]


def _get(data: np.ndarray, places: np.ndarray, dtype: str, n: int = 1) -> np.ndarray:
    """n numbers from each place in data."""
    at = np.arange(np.dtype(dtype).itemsize * n)
    parts = [data[places[k : k + _SOME, None] + at].view(dtype) for k in range(0, len(places), _SOME)]
    return np.concatenate(parts).reshape(len(places), n) if parts else np.zeros((0, n), dtype)


def _lengths(values: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def encode(values: pa.Array, kind: str, dim: str) -> pa.Array | None:
    """Little-endian ISO WKB of a native column; None if it has nulls within geometries, or is of another kind."""
    if kind not in DEPTHS or pa.types.is_large_list(values.type):
        return None
    valid = values.is_valid().to_numpy(zero_copy_only=False)
    lists, leaf = [], values
    for _ in range(DEPTHS[kind]):
        lists.append(_lengths(leaf))
        leaf = leaf.flatten()
        if leaf.null_count:
            return None
    if [f.name for f in leaf.type] != list(dim):
        return None
    axes = [leaf.field(k) for k in range(len(dim))]
    if any(a.null_count for a in axes) and kind != "point":
        return None
    xy = np.stack([pc.fill_null(a, np.nan).to_numpy(zero_copy_only=False) for a in axes], 1).astype("<f8")
    width, head = 8 * len(dim), np.frombuffer(np.array([(1, KINDS.index(kind) + 1 + 1000 * DIMS.index(dim))], [("order", "u1"), ("code", "<u4")]).tobytes(), np.uint8)
    if kind == "point":
        sizes = np.full(len(values), 5 + width)
    elif kind == "linestring":
        sizes = 9 + width * lists[0]
    else:
        rings = np.repeat(np.arange(len(values)), lists[0])
        sizes = 9 + 4 * lists[0] + width * np.bincount(rings, lists[1], len(values)).astype(np.int64)
    sizes = np.where(valid, sizes, 0)
    row, out = _starts(sizes), np.zeros(int(sizes.sum()), np.uint8)
    _put(out, row[valid], np.broadcast_to(head, (int(valid.sum()), 5)))
    if kind == "point":
        _put(out, row[valid] + 5, xy[valid])
    elif kind == "linestring":
        _put(out, row[valid] + 5, lists[0][valid].astype("<u4"))
        of = np.repeat(np.arange(len(values)), lists[0])
        _put(out, row[of] + 9 + width * (np.arange(len(xy)) - _starts(lists[0])[of]), xy)
    else:
        _put(out, row[valid] + 5, lists[0][valid].astype("<u4"))
        before = 4 + width * lists[1]  # of a ring, then of those before it in its polygon
        total = _starts(before)
        first = _starts(lists[0])
        place = row[rings] + 9 + total - total[np.minimum(first, max(len(total) - 1, 0))][rings] if len(rings) else np.zeros(0, np.int64)
        _put(out, place, lists[1].astype("<u4"))
        of = np.repeat(np.arange(len(rings)), lists[1])
        _put(out, place[of] + 4 + width * (np.arange(len(xy)) - _starts(lists[1])[of]), xy)
    offsets = np.append(row, len(out)).astype(np.int32)
    mask = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(values), [mask, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def _nested(sizes: list[np.ndarray], xy: np.ndarray, dim: str, valid: np.ndarray) -> pa.Array:
    out = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in range(len(dim))], list(dim), mask=None if sizes or valid.all() else pa.array(~valid))
    for k in range(len(sizes) - 1, -1, -1):
        offsets = pa.array(np.append(0, np.cumsum(sizes[k])).astype(np.int32))
        out = pa.ListArray.from_arrays(offsets, out, mask=pa.array(~valid) if k == 0 and not valid.all() else None)
    return out


def decode(values: pa.Array, kind: str, dim: str) -> pa.Array | None:
    """The native column of WKB that is all little-endian, of this kind and dimension, in ISO's codes; None if any row is something else, or is cut short."""
    if kind not in DEPTHS or not pa.types.is_binary(values.type):
        return None
    valid = values.is_valid().to_numpy(zero_copy_only=False)
    buffers = values.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    start, size = offsets[:-1][valid], np.diff(offsets)[valid]
    width, code = 8 * len(dim), KINDS.index(kind) + 1 + 1000 * DIMS.index(dim)
    if (size < 9).any() or (len(start) and ((data[start] != 1).any() or (_get(data, start + 1, "<u4")[:, 0] != code).any())):
        return None
    if kind == "point":
        if (size != 5 + width).any():
            return None
        xy = np.zeros((len(values), len(dim)))
        xy[valid] = _get(data, start + 5, "<f8", len(dim))
        return _nested([], xy, dim, valid)
    count, every = _get(data, start + 5, "<u4")[:, 0].astype(np.int64), np.zeros(len(values), np.int64)
    every[valid] = count
    if kind == "linestring":
        if (size != 9 + width * count).any():
            return None
        of = np.repeat(np.arange(len(start)), count)
        xy = _get(data, start[of] + 9 + width * (np.arange(len(of)) - _starts(count)[of]), "<f8", len(dim))
        return _nested([every], xy, dim, valid)
    # ring by ring: the k-th rings of all polygons together, since a ring's place depends on those before it
    if (count * 4 > size).any():
        return None
    rings, place = np.zeros(int(count.sum()), np.int64), np.zeros(int(count.sum()), np.int64)
    at, first = start + 9, _starts(count)
    for k in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > k)
        if (at[live] + 4 > start[live] + size[live]).any():
            return None
        n = _get(data, at[live], "<u4")[:, 0].astype(np.int64)
        rings[first[live] + k], place[first[live] + k] = n, at[live] + 4
        at[live] += 4 + width * n
    if (at != start + size).any():
        return None
    of = np.repeat(np.arange(len(rings)), rings)
    xy = _get(data, place[of] + width * (np.arange(len(of)) - _starts(rings)[of]), "<f8", len(dim))
    return _nested([every, rings], xy, dim, valid)


# lines as text


#: Whole numbers below this are written without a point or an exponent by all ways of writing them.
_WHOLE = 1e15
#: A line in x and y as it is written here.
_LINE = re.compile(r"LINESTRING \((-?\d+(?:\.\d+)?(?: -?\d+(?:\.\d+)?)(?:, -?\d+(?:\.\d+)? -?\d+(?:\.\d+)?)*)\)", re.ASCII)


def lines_to_text(values: pa.Array) -> pa.Array | None:
    """WKT of lines in x and y whose coordinates are whole; None if any are not, are missing, or a line has no vertices."""
    if not pa.types.is_list(values.type) or not pa.types.is_struct(values.type.value_type) or [f.name for f in values.type.value_type] != ["x", "y"]:
        return None
    n, leaf = _lengths(values), values.flatten()
    if values.null_count or (n == 0).any() or leaf.null_count or any(leaf.field(k).null_count for k in (0, 1)):
        return None
    xy = np.stack([leaf.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1)
    if not (np.abs(xy) < _WHOLE).all() or (xy != np.floor(xy)).any():
        return None
    text = pc.cast(pa.array(xy.astype(np.int64).ravel()), pa.string())
    pairs = pc.binary_join_element_wise(text.take(pa.array(np.arange(0, len(text), 2))), text.take(pa.array(np.arange(1, len(text), 2))), " ")
    runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pairs), ", ")
    return pc.binary_join_element_wise(pa.scalar("LINESTRING ("), runs, pa.scalar(")"), "")


def lines_from_text(values: pa.Array) -> pa.Array | None:
    """The lines of WKT that is plain: lines in x and y, written as here, in plain decimals; None if any row is something else."""
    if values.null_count or not len(values):
        return None
    rows = values.to_pylist()
    if not all(map(_LINE.fullmatch, rows)):
        return None
    n = pc.add(pc.count_substring(values, ","), 1).to_numpy(zero_copy_only=False)
    flat = ", ".join([r[12:-1] for r in rows]).replace(",", "").split(" ")
    xy = pc.cast(pa.array(flat), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, 2)
    return _nested([n.astype(np.int64)], xy, "xy", np.ones(len(values), bool))
