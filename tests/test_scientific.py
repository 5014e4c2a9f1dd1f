import base64
import struct

import numpy as np
import pytest

from strandline.sources import scientific as S


def _element(group, element, kind, body):
    if kind in (b"OW",):
        return struct.pack("<HH", group, element) + kind + b"\0\0" + struct.pack("<I", len(body)) + body
    return struct.pack("<HH", group, element) + kind + struct.pack("<H", len(body)) + body


def test_dicom():
    a = np.arange(12, dtype="<u2").reshape(3, 4)
    us = lambda e, v: _element(0x28, e, b"US", struct.pack("<H", v))
    data = b"\0" * 128 + b"DICM" + us(0x10, 3) + us(0x11, 4) + us(0x100, 16) + _element(0x7FE0, 0x10, b"OW", a.tobytes()) + b"end"
    head, pixels, rest = S.read_dicom(data)
    assert (pixels == a).all() and head + pixels.tobytes() + rest == data
    for bad in (b"", data[:150], data[:-20]):
        with pytest.raises(ValueError):
            S.read_dicom(bad)


def test_edf():
    head = bytearray(b" " * 256)
    head[236:244], head[252:256] = b"2       ", b"2   "
    fields = b" " * (216 * 2) + b"3       " + b"1       " + b" " * 64
    data = bytes(head) + fields + np.array([1, 2, 3, 9, 4, 5, 6, 8], "<i2").tobytes()
    a, b = S.read_edf(data)
    assert a.tolist() == [1, 2, 3, 4, 5, 6] and b.tolist() == [9, 8]
    with pytest.raises(ValueError):
        S.read_edf(b"x" * 300)


def test_fcs_mzml_bvh_mtx():
    a = np.arange(6, dtype="<f4").reshape(3, 2)
    text = b"/$TOT/3/$PAR/2/$BYTEORD/1,2,3,4/$DATATYPE/F/$P1B/32/$BEGINDATA/200/"
    data = (b"FCS3.0    " + b"%8d%8d" % (58, 58 + len(text) - 1) + b" " * 32 + text).ljust(200) + a.tobytes()
    assert (S.read_fcs(data) == a).all()
    enc = lambda x, kind: f'<binaryDataArray><cvParam name="{kind}"/><cvParam name="64-bit float"/><binary>{base64.b64encode(np.array(x, "<f8").tobytes()).decode()}</binary></binaryDataArray>'
    mz, intensity = S.read_mzml(f"<mzML><spectrum>{enc([1.5, 2.5], 'm/z array')}{enc([7, 8], 'intensity array')}</spectrum></mzML>".encode())[0]
    assert mz.tolist() == [1.5, 2.5] and intensity.tolist() == [7, 8]
    assert S.read_bvh("MOTION\nFrames: 1\nFrame Time: 0.01\n1.5 -0.25\n").tolist() == [[15000, -2500]]
    with pytest.raises(ValueError):
        S.read_bvh("Frame Time: 1\n0.123456\n")
    assert S.read_mtx("%%x\n3 3 3\n2 1 5\n1 2 7\n1 1 4\n").tolist() == [[1, 1, 4], [2, 1, 5], [1, 2, 7]]


def test_channels_and_bytes():
    rng = np.random.default_rng(1)
    base = rng.integers(-900, 900, 400)
    x = np.stack([base, base + rng.integers(-3, 4, 400), base // 2], axis=1)
    r = S.cross_channel(x)
    assert (S.cross_channel(r, back=True) == x).all()
    for size in (2, 4, 8):
        assert S.byte_shuffle(S.byte_shuffle(b"abcdefghijklmnopqrs", size), size, back=True) == b"abcdefghijklmnopqrs"
    assert S.read_interleaved(np.arange(7, dtype="<i2").tobytes(), 3).tolist() == [[0, 1, 2], [3, 4, 5]]
    assert S.aggregated_trades("12,1.5,true") == [12, 150_000_000, 1]
