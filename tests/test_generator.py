"""The split generator against one that draws element after element."""

from __future__ import annotations

import math
import struct
from fractions import Fraction

import numpy as np
import pytest

from trialweave.sources import array_codec as ac
from trialweave.sources import generator as g


class Stream:
    """pcg32, one draw at a time."""

    def __init__(self, seed, stream):
        self.inc, self.s = (2 * stream + 1) % 2**64, 0
        self.draw()
        self.s = (self.s + seed) % 2**64
        self.draw()

    def draw(self):
        old = self.s
        self.s = (old * 6364136223846793005 + self.inc) % 2**64
        x, r = (((old >> 18) ^ old) >> 27) % 2**32, old >> 59
        return (x >> r | x << (32 - r)) % 2**32

    def wide(self):
        return self.draw() * 2**32 + self.draw()


def in_format(dtype, x):
    """A double rounded once, half to even: by comparing with all neighbours exactly."""
    if dtype != "bf16":
        return np.array([x]).astype(ac.NUMPY[dtype])[0]
    top = struct.unpack("<I", struct.pack("<f", np.float32(x)))[0] >> 16
    value = lambda b: Fraction(struct.unpack("<f", struct.pack("<I", b << 16))[0])
    near = [b for b in range(max(top - 2, 0), top + 3) if math.isfinite(struct.unpack("<f", struct.pack("<I", b << 16))[0])]
    return np.uint16(min(near, key=lambda b: (abs(value(b) - Fraction(x)), b & 1)))


def sequential(seed, e):
    rng, n, dtype, lo, hi = Stream(seed, g.stream_of(e["name"])), math.prod(e["shape"]), e["dtype"], e["lo"], e["hi"]
    out = []
    for _ in range(n):
        if e["dist"] == "integers":
            span = hi - lo
            size, draw = (2**32, rng.draw) if span <= 2**32 else (2**64, rng.wide)
            while (x := draw()) < size % span:
                pass
            out.append(lo + x % span)
            continue
        u = (rng.wide() >> 11) * 2.0**-53 if dtype == "f64" else (rng.draw() >> 8) * 2.0**-24
        x = in_format(dtype, lo + (hi - lo) * u)
        value = g.as_double(dtype, np.array([x]))[0]
        if not lo <= value < hi:
            x = g.next_to(dtype, np.array([x]), bool(value < lo))[0]
        out.append(x)
    return np.array(out, ac.NUMPY[dtype]).tobytes()


SPEC = [
    {"name": f"u.{d}", "dtype": d, "shape": [5, 41], "dist": "uniform", "lo": lo, "hi": hi}
    for d, lo, hi in (("f32", -1.0, 1.0), ("f16", 0.1, 0.3), ("bf16", -2.5, 3), ("f64", -1e300, 1e300))
] + [
    {"name": "wide", "dtype": "f32", "shape": [60], "dist": "uniform", "lo": 16777216, "hi": 16777220}, {"name": "tight", "dtype": "f16", "shape": [60], "dist": "uniform", "lo": 1.0, "hi": 1.001}, {"name": "low", "dtype": "bf16", "shape": [60], "dist": "uniform", "lo": 1e-40, "hi": 3e-40},
    {"name": "i8", "dtype": "i8", "shape": [300], "dist": "integers", "lo": -128, "hi": 128}, {"name": "u8", "dtype": "u8", "shape": [3, 3], "dist": "integers", "lo": 0, "hi": 1},
    {"name": "i32", "dtype": "i32", "shape": [500], "dist": "integers", "lo": -(2**31), "hi": 42}, {"name": "u32", "dtype": "u32", "shape": [200], "dist": "integers", "lo": 5, "hi": 2**31 + 9},
    {"name": "i64", "dtype": "i64", "shape": [400], "dist": "integers", "lo": -(2**63), "hi": 5}, {"name": "all", "dtype": "i64", "shape": [50], "dist": "integers", "lo": -(2**63), "hi": 2**63},
    {"name": "none", "dtype": "i32", "shape": [4, 0], "dist": "integers", "lo": 0, "hi": 9}, {"name": "one", "dtype": "f32", "shape": [], "dist": "uniform", "lo": 0, "hi": 1},
    {"name": "nothing", "dtype": "f32", "shape": [0], "dist": "uniform", "lo": 0, "hi": 1},
]


def test_published_draws():
    """The generator's published demo: seed 42, stream 54."""
    s = Stream(42, 54)
    assert [s.draw() for _ in range(6)] == [0xA15C02B7, 0x7B47F409, 0xBA1D3330, 0x83D2F293, 0xBFA4784B, 0xCBED606E] == g.draws(42, 54, 0, 6).tolist()
    s = Stream(9, 2**63 + 1)
    every = [s.draw() for _ in range(3000)]
    assert g.draws(9, 2**63 + 1, 0, 3000).tolist() == every and g.draws(9, 2**63 + 1, 1234, 100).tolist() == every[1234:1334]
    a, c = g.jump(2**64 - 1, 2 * 54 + 1)
    b, d = g.jump(1, 2 * 54 + 1)
    assert a * b % 2**64 == 1 and (c * b + d) % 2**64 == 0  # all the way round


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_split_equals_sequential(spark, block):
    table = g.spec_table(spark, SPEC)
    got = {r["name"]: r["data"] for r in g.whole(table, 2**63 + 11, block=block).collect()}
    assert set(got) == {e["name"] for e in SPEC}
    for e in SPEC:
        assert bytes(got[e["name"]]) == sequential(2**63 + 11, e), e["name"]


def test_one_array_by_many_tasks(spark):
    from pyspark.sql import functions as F

    spec = [{"name": "big", "dtype": "u32", "shape": [3000, 1000], "dist": "integers", "lo": 0, "hi": 3 * 10**9}]
    blocks = g.generate(g.spec_table(spark, spec), 5, block=1 << 18)
    rows = blocks.select("first", "n", F.octet_length("data").alias("bytes"), F.spark_partition_id().alias("task")).orderBy("first").collect()
    assert len(rows) > 10 and len({r["task"] for r in rows}) > 1 and [r["first"] for r in rows] == np.cumsum([0, *(r["n"] for r in rows)])[:-1].tolist()
    assert sum(r["n"] for r in rows) == 3_000_000 and all(r["bytes"] == 4 * r["n"] for r in rows)


def test_bf16_is_rounded_once():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=400), (1 + 2.0**-8) * (1 + rng.choice([-1, 0, 1], 200) * 2.0**-40), rng.normal(size=200) * 1e-40, [0.0, 2.0**-149, 2.0**-134, 3 * 2.0**-134]])
    assert g.rounded("bf16", np.abs(x)).tolist() == [int(in_format("bf16", v)) for v in np.abs(x).tolist()]
    assert g.as_double("bf16", g.next_to("bf16", np.array([0x0000, 0x8001, 0x3F80], "<u2"), True)).tolist() == [2.0**-133, 0.0, 1 + 2.0**-7]


def test_specifications():
    good = dict(SPEC[0])
    assert g.check_spec(SPEC, "s") == SPEC
    bad = [
        ("x", "sequence"), ([1], "no mapping|not a mapping"), ([good, good], "used twice"), ([good | {"more": 1}], "exactly"), ([good | {"name": "a/b"}], "name"), ([good | {"name": "a" * 248}], "longer"), ([good | {"dtype": "f8"}], "unknown dtype"),
        ([good | {"dist": "normal"}], "unknown dist"), ([good | {"dist": "integers"}], "does not draw"), ([good | {"shape": [-1]}], "shape"), ([good | {"lo": 1, "hi": 1}], "below"), ([good | {"lo": float("nan")}], "finite"), ([good | {"hi": 1e39}], "range"),
        ([good | {"lo": True}], "number"), ([good | {"hi": 2**53 + 1}], "exactly a double"), ([good | {"lo": 1 + 1e-12, "hi": 1 + 2e-12}], "no f32 value"), ([good | {"dtype": "f64", "lo": -1.7e308, "hi": 1.7e308}], "overflows"),
        ([good | {"dtype": "i8", "dist": "integers", "lo": 0, "hi": 129}], "fit"), ([good | {"dtype": "i8", "dist": "integers", "lo": 0.0, "hi": 9}], "no ints"),
    ]
    for spec, what in bad:
        with pytest.raises(g.SpecError, match=what):
            g.check_spec(spec, "s")
