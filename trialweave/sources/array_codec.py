"""Named n-d arrays in a binary file, and their values.

A file is: 8 bytes of magic, u32 version, u32 dtype code, u32 rank, u64 dims, u32 name length, the name, zero bytes to
a multiple of 8, the data. All little-endian; nothing may follow the data.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: The magic of files that this package writes; files of other writers are read by giving theirs.
MAGIC = b"TWARRAY\0"
# Version, dtype codes with item sizes.
VERSION = 1
DTYPES = {"f32": (1, 4), "f16": (2, 2), "bf16": (3, 2), "i32": (4, 4), "u32": (5, 4), "i8": (6, 1), "u8": (7, 1), "i64": (8, 8), "f64": (9, 8)}
NUMPY = {"f32": "<f4", "f16": "<f2", "bf16": "<u2", "i32": "<i4", "u32": "<u4", "i8": "i1", "u8": "u1", "i64": "<i8", "f64": "<f8"}
FLOATS = ("f32", "f16", "bf16", "f64")
NAME = re.compile(rb"[A-Za-z0-9_.-]{1,255}")


@dataclass(frozen=True)
class NamedArray:
    name: str
    dtype: str
    shape: tuple[int, ...]
    data: bytes


def encode(a: NamedArray, magic: bytes = MAGIC) -> bytes:
    if a.dtype not in DTYPES:
        raise ValueError(f"unknown dtype {a.dtype}")
    code, size = DTYPES[a.dtype]
    if any(not 0 <= d < 1 << 64 for d in a.shape) or math.prod(a.shape) * size != len(a.data):
        raise ValueError("the data's length does not fit the shape")
    name = a.name.encode("ascii", "replace")
    if not NAME.fullmatch(name):
        raise ValueError("bad name")
    head = magic + struct.pack(f"<III{len(a.shape)}QI", VERSION, code, len(a.shape), *a.shape, len(name)) + name
    return head + b"\0" * (-len(head) % 8) + a.data


def decode(raw: bytes, magic: bytes = MAGIC) -> NamedArray:
    at = 0

    def take(n: int, what: str) -> bytes:
        nonlocal at
        if n > len(raw) - at:
            raise ValueError(f"the file ends inside its {what}")
        at += n
        return raw[at - n : at]

    if take(8, "magic") != magic:
        raise ValueError("bad magic")
    version, code, rank = struct.unpack("<III", take(12, "header"))
    dtype = next((d for d, (c, _) in DTYPES.items() if c == code), None)
    if version != VERSION or dtype is None:
        raise ValueError("unknown version or dtype")
    shape = struct.unpack(f"<{rank}Q", take(8 * rank, "dims")) if rank * 8 <= len(raw) else take(8 * rank, "dims")
    (length,) = struct.unpack("<I", take(4, "name length"))
    name = take(length, "name")
    if not NAME.fullmatch(name):
        raise ValueError("bad name")
    if take(-at % 8, "padding").strip(b"\0"):
        raise ValueError("padding is not zero")
    if 0 not in shape and math.prod(shape) * DTYPES[dtype][1] != len(raw) - at or 0 in shape and len(raw) != at:
        raise ValueError("the data's length does not fit the dims")
    return NamedArray(name.decode(), dtype, tuple(shape), raw[at:])


def values(dtype: str, data: bytes) -> np.ndarray:
    """The elements; bf16 is widened to f32."""
    x = np.frombuffer(data, NUMPY[dtype])
    return (x.astype("<u4") << 16).view("<f4") if dtype == "bf16" else x


def ordered_keys(dtype: str, data: bytes) -> np.ndarray:
    """Integers in the order of the floats, one apart for neighbours, equal for both zeros (as Python ints or int64)."""
    bits = {"f32": 32, "f16": 16, "bf16": 16, "f64": 64}[dtype]
    u = np.frombuffer(data, f"<u{bits // 8}").astype(np.uint64)
    magnitude = (u & np.uint64((1 << (bits - 1)) - 1)).astype(np.int64)
    return np.where(u >> np.uint64(bits - 1) > 0, -magnitude, magnitude)


def read_arrays(spark: SparkSession, path: str, magic: bytes = MAGIC) -> DataFrame:
    """(path, name, dtype, shape, data, problem) of every file under a path; a file that can't be read has a problem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            out = []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    a = decode(bytes(raw), magic)
                    out.append((p, a.name, a.dtype, list(a.shape), a.data, None))
                except ValueError as e:
                    out.append((p, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "name", "dtype", "shape", "data", "problem"])

    return files.mapInPandas(run, "path string, name string, dtype string, shape array<long>, data binary, problem string")
