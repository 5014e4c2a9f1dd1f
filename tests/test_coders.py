import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.operators import coders as K
from strandline.operators import containers as N
from strandline.operators import tokens as T

LONG = st.integers(-(2**63), 2**63 - 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(LONG, max_size=80))
def test_residuals(v):
    assert K.residuals_decode(K.residuals_encode(v), len(v)) == v


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-5000, 5000), max_size=120))
def test_rice_filter_and_differences(v):
    assert K.rice_decode(K.rice_encode(v), len(v)) == v
    assert K.lms(K.lms(v), back=True) == v
    assert N.ints_decode(N.ints_encode(np.array(v, np.int64))).tolist() == v


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60))
def test_context_hash(v):
    assert K.fcm_decode(K.fcm_encode(v), len(v)) == v


def test_extremes_wrap():
    v = np.array([2**63 - 1, -(2**63), 0, 2**63 - 1], np.int64)
    assert (N.ints_decode(N.ints_encode(v)) == v).all()


def test_coder_spends_what_the_model_says():
    r = random.Random(3)
    v = [int(r.gauss(0, 50)) for _ in range(5000)]
    assert abs(len(K.residuals_encode(v)) - K.residuals_bits(v) / 8) < 16


def test_huffman():
    freqs = [int(1.6**k) + 1 for k in range(30)]
    for limit in (8, 15):
        lengths = K.huffman_lengths(freqs, limit)
        assert max(lengths) <= limit and abs(sum(2.0**-n for n in lengths) - 1) < 1e-9
    assert K.huffman_lengths([0, 5, 0]) == [0, 1, 0]


@pytest.mark.parametrize("shape", [(0, 4), (1, 1), (7, 5), (32, 48)])
def test_planes(shape):
    a = np.cumsum(np.random.default_rng(1).integers(-4, 5, shape), axis=1)
    assert (K.calic(K.calic(a), back=True) == a).all()
    assert (N.plane_decode(N.plane_encode(a)) == a).all()


def test_flat_plane_is_runs():
    blob = N.plane_encode(np.zeros((64, 64), np.int64))
    assert blob[:1] in (b"r", b"m", b"c") and len(blob) < 120


@pytest.mark.parametrize("mode", ["gray", "bayer", "rgb"])
def test_images(mode):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (16, 16, 3) if mode == "rgb" else (17, 16)).astype(np.uint8)
    blob = N.image_encode(a, mode)
    assert (N.image_decode(blob) == a).all()
    bad = bytearray(blob)
    bad[-3] ^= 0x55
    with pytest.raises((ValueError, struct.error, IndexError)):
        if (N.image_decode(bytes(bad)) == a).all():
            raise ValueError("the last bytes carry nothing")


def test_volume_prefers_slice_differences():
    v = np.cumsum(np.random.default_rng(2).integers(-2, 3, (5, 24, 24)), axis=0).astype(np.int16) + np.random.default_rng(3).integers(0, 4000, (24, 24)).astype(np.int16)
    blob = N.volume_encode(v)
    assert (N.volume_decode(blob) == v).all() and sum(p[:1] == b"d" for p in N.unpack(blob)[2:]) == 4


@pytest.mark.parametrize("channels", [1, 2, 3])
def test_sound(channels):
    t = np.arange(600)
    pcm = np.stack([(9000 * np.sin(t / (7 + c))).astype(np.int16) for c in range(channels)], axis=1)
    blob = N.audio_encode(pcm)
    assert (N.audio_decode(blob) == pcm).all() and len(blob) < pcm.nbytes


def test_video():
    rng = np.random.default_rng(4)
    frames = np.zeros((4, 32, 48), np.uint8)
    patch = rng.integers(0, 255, (8, 8))
    for k in range(4):
        frames[k, 8 : 16, 4 + 3 * k : 12 + 3 * k] = patch
    assert (N.video_decode(N.video_encode(frames)) == frames).all()
    still = np.repeat(rng.integers(0, 255, (1, 32, 32)).astype(np.uint8), 5, axis=0)
    assert len(N.video_encode(still)) < len(N.video_encode(still[:1])) + 200
    with pytest.raises(ValueError):
        N.video_encode(np.zeros((2, 17, 16), np.uint8))


@pytest.mark.parametrize("end", [b"\n", b"\r\n"])
@pytest.mark.parametrize("delimiter", [b";", b",", b"\t", b"|"])
@pytest.mark.parametrize("trailing", [True, False])
def test_grids(end, delimiter, trailing):
    rows = [[b"date", b"v", b"n"]] + [[b"2024-01-01", b"%d.%03d" % (200 + i % 7, i * 37 % 1000), b"%d" % i] for i in range(400)]
    data = end.join(delimiter.join(r) for r in rows) + (end if trailing else b"")
    blob = N.grid_encode(data)
    assert blob[:1] == b"\2" and N.grid_decode(blob) == data and len(blob) < len(data) / 3


@pytest.mark.parametrize("cells", [[b"04.216"], [b"+1.0"], [b"1.5", b"1.25"], [b"-0.00"], [b""], [b"234.840", b"0.000", b"-1.500"]])
def test_odd_numbers_come_back(cells):
    data = b"a;b\n" + b"".join(b"%s;x\n" % cells[i % len(cells)] for i in range(40))
    assert N.grid_decode(N.grid_encode(data)) == data


@pytest.mark.parametrize("data", [b"", b"x\n", b"a;b\n", b"just some prose", b"a;b;c\n1;2\n3;4;5;6\n", b'"x,y",z\n' * 4])
def test_no_grid_never_expands_much(data):
    assert N.grid_decode(N.grid_encode(data)) == data and len(N.grid_encode(data)) <= len(data) + 5


def test_records():
    rng = np.random.default_rng(0)
    a = np.cumsum(rng.integers(-9, 10, 4000)).astype("<i4") + 10000
    data = np.stack([a.view("<u4"), np.arange(4000, dtype="<u4")], axis=1).tobytes()
    assert N.find_period(data) == 8
    for widths in (None, [4, 4]):
        blob = N.records_encode(data + b"xyz", widths)
        assert N.records_decode(blob) == data + b"xyz" and len(blob) < len(data) / 2
    noise = rng.bytes(5000)
    assert N.find_period(noise) == 0 and N.records_decode(N.records_encode(noise)) == noise and len(N.records_encode(noise)) <= len(noise) + 5
    assert N.records_decode(N.records_encode(b"")) == b""


@pytest.mark.parametrize("size", [4, 8])
def test_floats(size):
    kind = f"<f{size}"
    special = np.tile(np.array([0.0, -0.0, np.nan, np.inf, -np.inf, 1.5], kind), 300).tobytes()
    cycle = ((np.arange(20000) % 500) / 8).astype(kind).tobytes()
    noise = np.random.default_rng(1).bytes(4000)
    for data in (special, cycle, noise, b"", b"abc"):
        assert N.floats_decode(N.floats_encode(data, size)) == data
    assert len(N.floats_encode(cycle, size)) < len(cycle) / 2 and len(N.floats_encode(noise, size)) <= len(noise) + 5


def _wav(pcm: np.ndarray) -> bytes:
    body = pcm.astype("<i2").tobytes()
    form = struct.pack("<HHIIHH", 1, pcm.shape[1], 8000, 16000 * pcm.shape[1], 2 * pcm.shape[1], 16)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body + b"LIST\x02\0\0\0ab"


def _fits(a: np.ndarray) -> bytes:
    cards = ["SIMPLE  =                    T", "BITPIX  =                   16", "NAXIS   =                    2", f"NAXIS1  = {a.shape[1]:20d}", f"NAXIS2  = {a.shape[0]:20d}", "END"]
    return "".join(c.ljust(80) for c in cards).ljust(2880).encode() + a.astype(">i2").tobytes()


def _npy(a: np.ndarray) -> bytes:
    import io

    f = io.BytesIO()
    np.save(f, a)
    return f.getvalue()


def test_routing():
    rng = np.random.default_rng(5)
    walk = np.cumsum(rng.integers(-3, 4, (40, 40)), axis=1).astype(np.int16)
    t = np.arange(800)
    wide = np.cumsum(np.cumsum(rng.integers(-1, 2, (48, 96)), axis=1), axis=0)
    wide = (128 + wide * 90 // np.abs(wide).max()).astype(np.uint8)
    frames = np.stack([wide[k : k + 32, 2 * k : 2 * k + 32] for k in range(4)]) + rng.integers(0, 3, (4, 32, 32)).astype(np.uint8)
    y4m = b"YUV4MPEG2 W32 H32 F25:1 Cmono\n" + b"".join(b"FRAME\n" + f.tobytes() for f in frames)
    grid = b"t;v;n\n" + b"".join(b"%d;%d.%02d;%d\n" % (i, i % 5, i * 7 % 100, i * i) for i in range(300))
    cases = {
        "npy": ("array/npy", _npy(walk)), "fits": ("image/fits", _fits(walk)), "y4m": ("video/y4m", y4m), "grid": ("text/plain", grid),
        "wav": ("audio/wav", _wav(np.stack([(9000 * np.sin(t / 9)), (9000 * np.sin(t / 11))], axis=1))), "deflate": ("text/json", b'{"a": 1}' * 50),
        "store": ("compressed/gzip", zlib.compress(b"x" * 100)),
    }
    for method, (kind, data) in cases.items():
        got, blob = N.choose(data, kind)
        assert got == method and N.restore(got, blob) == data and len(blob) <= len(data)
    assert N.choose(_npy(walk)[:50], "array/npy")[0] in ("store", "deflate")
    with pytest.raises(ValueError):
        N.restore("other", b"")


def test_parses():
    r = random.Random(1)
    samples = [b'{"name":"item%d","age":%d,"city":"somewhere"}' % (i, i * 7 % 90) for i in range(60)]
    model = T.train(samples[:50], [b'{"name":"item', b'","age":', b',"city":"somewhere"}'], [b"", samples[0]])
    for data in [*samples[50:], b"", b"a", bytes(range(256)), b"abc" * 200, bytes(r.randrange(256) for _ in range(300))]:
        best, greedy = T.parse(data, model), T.parse(data, model, greedy=True)
        assert T.expand(best, model) == data == T.expand(greedy, model)
        assert T.cost(best, model) <= T.cost(greedy, model) + 1e-6
        assert T.decompress(T.compress(data, model), model) == data
    blob = bytearray(T.compress(samples[55], model))
    assert len(blob) < len(samples[55])
    blob[20] ^= 0xFF
    with pytest.raises((ValueError, IndexError)):
        T.decompress(bytes(blob), model)
    with pytest.raises(ValueError):
        T.decompress(T.compress(samples[55], model), T.Model())


def test_match_rules():
    assert T.worth(3, 128) and not T.worth(3, 129) and T.worth(6, T.WINDOW) and not T.worth(2, 1)
    assert T.depth_for(10) == 2048 and T.depth_for(1 << 20) == 128
    d = [5, 5, 9, 5, 1, 9, 700, 5]
    assert T.distances_back(T.repeated_offsets(d)) == d
    assert [T.value_slot(v) for v in (1, 2, 3, 9)] == [(0, 0), (1, 0), (1, 1), (3, 1)]
