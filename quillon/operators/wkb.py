"""Well-known binary: geometries as bytes, and back."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .spatial import GEOMETRY

#: Fixed values of the format: the kinds' numbers; EXTENDED marks a number of the system after the kind, and HIGH and MEASURED further coordinates.
KINDS = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6}
HIGH, MEASURED, EXTENDED = 0x80000000, 0x40000000, 0x20000000


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, order: str) -> int:
        self.at += 4
        return struct.unpack_from(f"{order}I", self.data, self.at - 4)[0]

    def points(self, order: str, n: int, width: int) -> list[dict]:
        rows = np.frombuffer(self.data, f"{order}f8", n * width, self.at).reshape(n, width)
        self.at += 8 * n * width
        return [{"x": x, "y": y} for x, y in rows[:, :2].tolist()]

    def shape(self) -> tuple[int, int | None, list]:
        """(kind, system, parts)."""
        order = "<" if self.data[self.at] else ">"
        self.at += 1
        code = self.number(order)
        srid = self.number(order) if code & EXTENDED else None
        plain = code & 0xFFFF
        width = 2 + bool(code & HIGH) + bool(code & MEASURED) + (1 if plain // 1000 in (1, 2) else 2 if plain // 1000 == 3 else 0)
        kind = plain % 1000
        if kind == 1:
            return kind, srid, [[self.points(order, 1, width)]]
        if kind == 2:
            return kind, srid, [[self.points(order, self.number(order), width)]]
        if kind == 3:
            return kind, srid, [[self.points(order, self.number(order), width) for _ in range(self.number(order))]]
        if kind in (5, 6):
            return kind, srid, [part for _ in range(self.number(order)) for part in self.shape()[2]]
        raise ValueError(f"no kind {code}")


def from_wkb(c: Column, srid: int = 0) -> Column:
    """A geometry from bytes of either order, extended ones with their own system; further coordinates are left out. NULL if the bytes hold something else or too little."""
    names = {v: k for k, v in KINDS.items()}

    @F.arrow_udf(GEOMETRY)
    def read(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            try:
                kind, own, parts = _Reader(v).shape()
                out.append({"kind": names[kind], "srid": srid if own is None else own, "parts": parts})
            except (TypeError, ValueError, IndexError, struct.error):
                out.append(None)
        ring = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        return pa.array(out, pa.struct([("kind", pa.string()), ("srid", pa.int32()), ("parts", pa.list_(pa.list_(ring)))]))

    return read(c)


def _written(kind: int, parts: list, srid: int | None = None) -> bytes:
    head = struct.pack("<BI", 1, kind | (EXTENDED if srid is not None else 0)) + (struct.pack("<I", srid) if srid is not None else b"")
    line = lambda r: np.array([(p["x"], p["y"]) for p in r], "<f8").tobytes()
    if kind == 1:
        return head + line(parts[0][0])
    if kind == 2:
        return head + struct.pack("<I", len(parts[0][0])) + line(parts[0][0])
    if kind == 3:
        return head + struct.pack("<I", len(parts[0])) + b"".join(struct.pack("<I", len(r)) + line(r) for r in parts[0])
    return head + struct.pack("<I", len(parts)) + b"".join(_written(kind - 3, [p]) for p in parts)


def as_wkb(g: Column, extended: bool = False) -> Column:
    """The bytes of a geometry, the low byte first; extended: with the number of its system."""

    @F.arrow_udf("binary")
    def write(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else _written(KINDS[v["kind"]], v["parts"], v["srid"] if extended else None) for v in values.to_pylist()], pa.binary())

    return write(g)
