"""Readers of laboratory formats: bytes to arrays, each a function for use in an Arrow function over blobs.

Only plain, uncompressed layouts are read; anything else is a ValueError, and
the blob then goes the way of unknown bytes.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from xml.etree import ElementTree

import numpy as np

from ..operators.containers import read_dicom  # noqa: F401 - a reader among these


def read_edf(data: bytes) -> list[np.ndarray]:
    """The 16-bit samples of each channel of a European Data Format recording."""
    try:
        records, channels = int(data[236:244]), int(data[252:256])
        at = 256 + 216 * channels
        sizes = [int(data[at + 8 * k : at + 8 * k + 8]) for k in range(channels)]
    except ValueError as e:
        raise ValueError("not an EDF header") from e
    body = np.frombuffer(data[256 * (channels + 1) :], "<i2")
    step = sum(sizes)
    if not step or len(body) < records * step:
        raise ValueError("cut short")
    rows = body[: records * step].reshape(records, step)
    ends = np.cumsum(sizes)
    return [rows[:, e - n : e].ravel() for e, n in zip(ends, sizes, strict=True)]


def read_interleaved(data: bytes, channels: int) -> np.ndarray:
    """(samples, channels) of raw 16-bit recordings; a rest that fills no sample is left out."""
    n = len(data) // (2 * channels)
    return np.frombuffer(data[: 2 * n * channels], "<i2").reshape(n, channels)


def read_fcs(data: bytes) -> np.ndarray:
    """(events, parameters) of a flow-cytometry file: 32-bit floats or whole numbers of one width."""
    if data[:3] != b"FCS":
        raise ValueError("not an FCS file")
    begin, end = int(data[10:18]), int(data[18:26])
    text = data[begin : end + 1].decode("latin-1")
    parts = text[1:].split(text[0])
    said = {k.upper(): v.strip() for k, v in zip(parts[::2], parts[1::2], strict=False)}
    n, k, first = int(said["$TOT"]), int(said["$PAR"]), int(said.get("$BEGINDATA") or data[26:34])
    order = "<" if said["$BYTEORD"].startswith("1") else ">"
    kind = {"F": "f4", "D": "f8"}.get(said["$DATATYPE"]) or f"u{int(said['$P1B']) // 8}"
    size = n * k * int(kind[1])
    if first + size > len(data):
        raise ValueError("cut short")
    return np.frombuffer(data[first : first + size], order + kind).reshape(n, k)


def read_mzml(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mass-to-charge ratios and intensities of each spectrum."""
    out = []
    for spectrum in ElementTree.fromstring(data).iter():
        if not spectrum.tag.endswith("}spectrum") and spectrum.tag != "spectrum":
            continue
        arrays = {}
        for b in (x for x in spectrum.iter() if x.tag.split("}")[-1] == "binaryDataArray"):
            names = {p.get("name") for p in b.iter() if p.tag.split("}")[-1] == "cvParam"}
            raw = base64.b64decode(next(x.text or "" for x in b.iter() if x.tag.split("}")[-1] == "binary"))
            raw = zlib.decompress(raw) if "zlib compression" in names else raw
            arrays["mz" if "m/z array" in names else "intensity"] = np.frombuffer(raw, "<f8" if "64-bit float" in names else "<f4")
        if {"mz", "intensity"} <= arrays.keys():
            out.append((arrays["mz"], arrays["intensity"]))
    return out


def read_bvh(text: str, decimals: int = 4) -> np.ndarray:
    """Frames of motion text as whole numbers; ValueError where the decimals would not come back."""
    _, found, rest = text.partition("Frame Time:")
    lines = rest.splitlines()[1:] if found else []
    rows = [[float(x) for x in line.split()] for line in lines if line.strip()]
    if not rows:
        raise ValueError("no motion")
    scaled = np.round(np.array(rows) * 10**decimals)
    if np.abs(scaled / 10**decimals - np.array(rows)).max() > 1e-9:
        raise ValueError("more decimals")
    return scaled.astype(np.int64)


def read_mtx(text: str) -> np.ndarray:
    """(row, column, value) triples of a sparse matrix, ordered by column, then row."""
    lines = [x for x in text.splitlines() if x and not x.startswith("%")]
    triples = np.array([[int(v) for v in x.split()] for x in lines[1:]], np.int64).reshape(-1, 3)
    return triples[np.lexsort((triples[:, 0], triples[:, 1]))]


def byte_shuffle(data: bytes, size: int, back: bool = False) -> bytes:
    """The bytes of fixed-width values place by place; bytes that fill no value stay last."""
    n = len(data) // size
    x = np.frombuffer(data[: n * size], np.uint8).reshape((size, n) if back else (n, size))
    return x.T.tobytes() + data[n * size :]


def cross_channel(samples: np.ndarray, back: bool = False, shift: int = 12) -> np.ndarray:
    """Each channel less what a sign-sign filter foretells from the channels before it, or back."""
    src = samples.astype(np.int64)
    out = src.copy()
    whole = out if back else src
    for c in range(1, src.shape[1]):
        weights = np.zeros(c, np.int64)
        for i in range(len(src)):
            guess = int(weights @ whole[i, :c]) >> shift
            out[i, c] = src[i, c] + guess if back else src[i, c] - guess
            e = src[i, c] if back else out[i, c]
            weights += np.sign(e) * np.sign(whole[i, :c])
    return out


def aggregated_trades(line: str, decimals: int = 8) -> list[int]:
    """The fields of a trade as whole numbers: decimals are scaled, truth values are 0 and 1."""
    out = []
    for f in line.split(","):
        if f.lower() in ("true", "false"):
            out.append(int(f.lower() == "true"))
        elif "." in f:
            whole, part = f.split(".")
            if len(part) > decimals or not re.fullmatch(r"-?\d+", whole):
                raise ValueError("decimals")
            out.append(int(whole + part.ljust(decimals, "0")))
        else:
            out.append(int(f))
    return out


# ------------------------------------------------------------------ writers

def _element(group: int, element: int, kind: bytes, body: bytes) -> bytes:
    size = b"\0\0" + struct.pack("<I", len(body)) if kind == b"OW" else struct.pack("<H", len(body))
    return struct.pack("<HH", group, element) + kind + size + body


def write_dicom(pixels: np.ndarray) -> bytes:
    """A plane of unsigned 16-bit pixels as explicit little-endian elements."""
    rows, columns = pixels.shape
    said = b"".join(_element(0x28, e, b"US", struct.pack("<H", v)) for e, v in ((0x10, rows), (0x11, columns), (0x100, 16)))
    return bytes(128) + b"DICM" + said + _element(0x7FE0, 0x10, b"OW", pixels.astype("<u2").tobytes())


def write_fits(plane: np.ndarray) -> bytes:
    """A plane of 16-bit numbers: header cards and the numbers, each filled up to 2,880 bytes."""
    h, w = plane.shape
    cards = [("SIMPLE", "T"), ("BITPIX", 16), ("NAXIS", 2), ("NAXIS1", w), ("NAXIS2", h)]
    head = b"".join(f"{k:<8}= {v:>20}".encode().ljust(80) for k, v in cards) + b"END".ljust(80)
    body = plane.astype(">i2").tobytes()
    return head.ljust(-(-len(head) // 2880) * 2880) + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def write_wav(pcm: np.ndarray, rate: int = 48_000) -> bytes:
    """16-bit samples (n, channels) as a wave file."""
    n = pcm.shape[1]
    form, body = struct.pack("<HHIIHH", 1, n, rate, 2 * n * rate, 2 * n, 16), pcm.astype("<i2").tobytes()
    parts = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(parts)) + parts


def write_y4m(luma: np.ndarray) -> bytes:
    """Frames (T, H, W) of bytes without chroma."""
    t, h, w = luma.shape
    return f"YUV4MPEG2 W{w} H{h} F25:1 Cmono\n".encode() + b"".join(b"FRAME\n" + f.astype(np.uint8).tobytes() for f in luma)


def write_edf(channels: list[np.ndarray]) -> bytes:
    """One record of 16-bit samples of some channels."""
    head = bytearray(b" " * 256)
    head[236:244], head[252:256] = b"1".ljust(8), str(len(channels)).encode().ljust(4)
    fields = b" " * (216 * len(channels)) + b"".join(str(len(c)).encode().ljust(8) for c in channels) + b" " * (32 * len(channels))
    return bytes(head) + fields + b"".join(c.astype("<i2").tobytes() for c in channels)


def write_fcs(events: np.ndarray) -> bytes:
    """(events, parameters) of 32-bit floats."""
    n, k = events.shape
    text = f"/$TOT/{n}/$PAR/{k}/$BYTEORD/1,2,3,4/$DATATYPE/F/$P1B/32/$BEGINDATA/512/".encode()
    head = b"FCS3.0    " + b"%8d%8d" % (58, 58 + len(text) - 1) + b" " * 32
    return (head + text).ljust(512) + events.astype("<f4").tobytes()


def write_mzml(spectra: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Mass-to-charge ratios and intensities of each spectrum, as deflated 64-bit floats."""

    def array(x: np.ndarray, kind: str) -> str:
        said = base64.b64encode(zlib.compress(x.astype("<f8").tobytes())).decode()
        names = "".join(f'<cvParam name="{k}"/>' for k in (kind, "64-bit float", "zlib compression"))
        return f"<binaryDataArray>{names}<binary>{said}</binary></binaryDataArray>"

    rows = "".join(f"<spectrum>{array(a, 'm/z array')}{array(b, 'intensity array')}</spectrum>" for a, b in spectra)
    return f"<mzML>{rows}</mzML>".encode()


def write_bvh(frames: np.ndarray, decimals: int = 4) -> str:
    """Whole numbers of the last decimal as lines of motion text."""
    lines = [" ".join(f"{v / 10**decimals:.{decimals}f}" for v in row) for row in frames]
    return "\n".join(["MOTION", f"Frames: {len(lines)}", "Frame Time: 0.008333", *lines]) + "\n"


def write_mtx(triples: np.ndarray, rows: int, columns: int) -> str:
    """(row, column, value) triples, counted from 1, as coordinate text."""
    return "\n".join(["%%MatrixMarket matrix coordinate integer general", f"{rows} {columns} {len(triples)}", *(f"{r} {c} {v}" for r, c, v in triples.tolist())]) + "\n"


# ------------------------------------------------------------------ flow records

#: A flow as 54 bytes: time and duration in microseconds, protocol, source address and port, direction, target address
#: and port, state, two types of service, packets, bytes, source bytes, label; a fixed layout.
FLOW = struct.Struct("<QIB4sIB4sIBBBIQQB")
_CODED = (2, 5, 8, 14)  # fields that are codes into dictionaries


def write_flows(rows: list[tuple]) -> tuple[bytes, list[list[str]]]:
    """Flows (addresses as four bytes; protocol, direction, state and label as text) as records, and the four dictionaries
    in the order in which values first come."""
    seen: list[dict[str, int]] = [{} for _ in _CODED]
    out = []
    for row in rows:
        row = list(row)
        for d, k in zip(seen, _CODED, strict=True):
            row[k] = d.setdefault(row[k], len(d))
        out.append(FLOW.pack(*row))
    return b"".join(out), [list(d) for d in seen]


def read_flows(data: bytes, names: list[list[str]]) -> list[tuple]:
    out = []
    for row in FLOW.iter_unpack(data):
        row = list(row)
        for d, k in zip(names, _CODED, strict=True):
            row[k] = d[row[k]]
        out.append(tuple(row))
    return out
