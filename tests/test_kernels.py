from __future__ import annotations

import os
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.config import BACKUP, ChunkParams, ReductionConfig, SketchParams, from_json
from quern.kernels import cdc, codec, delta, features


def slow_cuts(data: bytes, p: ChunkParams) -> list[int]:
    """Straight from the rule, one chunk at a time."""
    gear, out, at = cdc.gear_table(p.gear_seed), [], 0
    while at < len(data):
        rest = len(data) - at
        if rest <= p.least:
            out.append(len(data))
            break
        i, h, end = p.least, 0, None
        while i < min(p.strict_until, rest) and end is None:
            h = (h >> 1) + gear[data[at + i]]
            i += 1
            end = i if h & p.strict_mask == 0 else None
        while i < min(p.most, rest) and end is None:
            h = (h >> 1) + gear[data[at + i]]
            i += 1
            end = i if h & p.loose_mask == 0 else None
        at += end or i
        out.append(at)
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_cut_points_follow_the_rule(data):
    for p in (ChunkParams(), ChunkParams(16, 64, 128), ChunkParams(32, 32, 32)):
        ends = cdc.cuts(data, p)
        assert ends == slow_cuts(data, p)
        sizes = np.diff([0, *ends])
        assert sum(sizes) == len(data) and all(0 < s <= p.most for s in sizes)


@pytest.mark.parametrize("p", [ChunkParams(), BACKUP, ChunkParams(1, 64, 4000), ChunkParams(64, 1024, 200_000)])
def test_cut_points_of_long_and_monotonous_data(p, monkeypatch):
    rng = random.Random(5)
    runs = b"".join(bytes([b]) * 700 for b in range(256))  # a run's hash comes as near as can be to the next whole number
    for data in (rng.randbytes(400_000), runs, bytes(50_000), b"ab" * 20_000 + rng.randbytes(3000), bytes(rng.choices(b"ab", k=30_000))):
        want = slow_cuts(data, p)
        assert cdc.cuts(data, p) == want
        with monkeypatch.context() as m:
            m.setattr(cdc, "UNSURE", np.uint64(1 << 31))  # half of all places are worked out byte by byte
            m.setattr(cdc, "BLOCK", 1000)
            assert cdc.cuts(data, p) == want


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 255, 1023, 1024, 1025])
def test_cut_point_bounds(n):
    for data in (bytes(n), b"ab" * (n // 2) + b"a" * (n % 2), os.urandom(n)):
        assert cdc.cuts(data, ChunkParams()) == slow_cuts(data, ChunkParams())


def test_an_inserted_byte_moves_few_cuts():
    rng = random.Random(1)
    data = rng.randbytes(60_000)
    one = {data[a:b] for a, b in zip([0, *cdc.cuts(data, ChunkParams())], cdc.cuts(data, ChunkParams()), strict=False)}
    for at in (0, 30_000, 59_999):
        other = data[:at] + b"!" + data[at:]
        ends = cdc.cuts(other, ChunkParams())
        same = sum(other[a:b] in one for a, b in zip([0, *ends], ends, strict=False))
        assert same > 0.95 * len(ends)


def test_both_mask_phases():
    assert ChunkParams().strict_until == 160 > ChunkParams().least  # live
    assert BACKUP.strict_until == 2048 < BACKUP.least  # the strict phase never runs


def polynomial_mod(v: int, poly: int) -> int:
    while v.bit_length() >= poly.bit_length():
        v ^= poly << (v.bit_length() - poly.bit_length())
    return v


def test_rolling_fingerprint_is_the_window_modulo_the_polynomial():
    p = SketchParams()
    data = random.Random(2).randbytes(150)
    got = features.rolling(np.frombuffer(data, np.uint8), np.arange(150), p)
    for j in range(len(data)):
        assert int(got[j]) == polynomial_mod(int.from_bytes(data[max(0, j - 47) : j + 1], "big"), p.polynomial)


@pytest.mark.parametrize("n", [0, 1, 11, 12, 31, 100, 1000, 1024])
def test_super_features_by_hand(n):
    p = SketchParams()
    data = random.Random(n).randbytes(n)
    size, peaks = n // 12, []
    for i in range(12):
        sub = data[i * size : (i + 1) * size if i < 11 else n]
        peaks.append(max([polynomial_mod(int.from_bytes(sub[max(0, j - 47) : j + 1], "big"), p.polynomial) for j in range(len(sub))], default=0))
    groups = [sorted(peaks[3 * g : 3 * g + 3], reverse=True) for g in range(4)]
    want = [xxhash.xxh64_intdigest(b"".join(groups[g][i].to_bytes(8, "little") for g in range(4)), 0) for i in range(3)]
    other = [random.Random(i).randbytes(i * 37 % 1500) for i in range(300)]
    assert features.super_features([data, *other, b"", data], p) == [want, *[features.super_features([o], p)[0] for o in other], features.super_features([b""], p)[0], want]


@pytest.mark.parametrize("window", [1, 2, 7, 48])
def test_fingerprints_of_odd_and_even_windows(window):
    p = SketchParams(window=window)
    runs = [random.Random(window + i).randbytes(i) for i in range(1, 70, 9)]
    got = features.rolling(np.frombuffer(b"".join(runs), np.uint8), np.concatenate([np.arange(len(r)) for r in runs]), p)
    want = [polynomial_mod(int.from_bytes(r[max(0, j + 1 - window) : j + 1], "big"), p.polynomial) for r in runs for j in range(len(r))]
    assert [int(v) for v in got] == want


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400), st.binary(max_size=400), st.integers(0, 300))
def test_delta_roundtrip(base, new, cut):
    for data in (new, base[:cut] + new + base[cut:], base, b"", base * 2):
        assert delta.decode(base, delta.encode(base, data)) == data


def test_delta_of_a_near_copy_is_small():
    base = random.Random(3).randbytes(1000)
    assert len(delta.encode(base, base[:400] + b"x" * 16 + base[416:])) < 40
    with pytest.raises(ValueError):
        delta.decode(base[:10], delta.encode(base, base))


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=2000), st.integers(0, 8160))
def test_compress_and_pad_roundtrip(data, seed):
    packed, ok = codec.compress(data)
    assert ok == (len(packed) < len(data))
    padded = codec.pad(packed, len(data), seed)
    assert codec.unpad(padded) == packed and codec.decompress(packed, ok) == data
    limit = min(len(data) - len(packed), 255)
    assert len(padded) - len(packed) - 4 == (0 if limit < 4 else 4 * max(1, seed % limit // 4))
    assert padded == codec.pad(packed, len(data), seed)


def test_incompressible_stays_raw():
    data = os.urandom(256)
    assert codec.compress(data) == (data, False)


def test_config():
    cfg = from_json('{"chunk": {"least": 32, "normal": 128, "most": 512}, "container_bytes": 1000, "secret": "00ff"}')
    assert cfg.chunk.most == 512 and cfg.secret == b"\0\xff" and cfg.keep_versions == 1
    with pytest.raises(ValueError):
        ChunkParams(10, 5, 20)
    with pytest.raises(ValueError):
        ReductionConfig(chunker="none")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600), st.sampled_from(["zstd", "zlib", "lz4"]))
def test_codecs_give_back_what_they_took(data, kind):
    for d in (data, data * 9):
        payload, packed = codec.compress(d, 1, kind)
        assert codec.decompress(payload, packed, kind) == d and len(payload) <= len(d)


def test_random_padding_goes_up_to_the_largest_chunk():
    a, b = (codec.pad(b"packed", 1024, 1000, 255, salt) for salt in (b"one", b"two"))
    assert a != b and len(a) == len(b) == 6 + 4 * (1000 % 255 // 4) + 4 and codec.unpad(a) == codec.unpad(b) == b"packed"
    assert len(codec.pad(b"x" * 1022, 1024, 1000, 255, b"s")) == 1022 + 4
