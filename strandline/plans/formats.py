"""Queries that write tables in file formats and read them back: what comes back is the source, through each format's bytes.

Every 16 vectors, or 10,000 rows at most, are a file; a file is one task's value, so any number of them spreads over the cluster.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import coders as K
from ..operators import containers as N
from ..registry import query
from ..sources import scientific as S
from ..sources.tables import plane, scaled, table

_PLANE = "SELECT vec_id AS y, CAST(x - 1 AS BIGINT) AS x, CAST(round(CAST(e AS DOUBLE) * 1000) AS BIGINT) AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS x FROM embeddings)"
_BAND = 16


def _npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def _encoded(method: str):
    encode, decode = N.METHODS[method]
    return lambda data: decode(encode(data))


#: Of each format how a band (rows, columns) of whole numbers is written, what its bytes go through, and how it is read.
_FORMATS = {
    "npy": (lambda a: _npy(a.astype("<i2")), _encoded("npy"), lambda d: N.read_npy(d)[1]),
    "npy_float": (lambda a: _npy(a.astype("<f8") / 8), _encoded("npy"), lambda d: N.read_npy(d)[1] * 8),
    "fits": (S.write_fits, _encoded("fits"), lambda d: N.read_fits(d)[1]),
    "dicom": (lambda a: S.write_dicom(a + 32768), _encoded("dicom"), lambda d: N.read_dicom(d)[1].astype(np.int64) - 32768),
    "wav": (lambda a: S.write_wav(a.T), _encoded("wav"), lambda d: N.read_wav(d)[1].T),
    "edf": (lambda a: S.write_edf(list(a)), None, lambda d: np.stack(S.read_edf(d))),
    "interleaved": (lambda a: a.T.astype("<i2").tobytes(), None, lambda d: S.read_interleaved(d, len(d) // 128).T),
    "fcs": (lambda a: S.write_fcs(a.T), None, lambda d: S.read_fcs(d).T.astype(np.int64)),
    "mzml": (lambda a: S.write_mzml([(np.arange(a.shape[1]), r) for r in a]), None, lambda d: np.stack([i for _, i in S.read_mzml(d)]).astype(np.int64)),
    "bvh": (lambda a: S.write_bvh(a.T).encode(), None, lambda d: S.read_bvh(d.decode()).T),
    "image": (lambda a: N.image_encode(a.astype("<i2")), None, N.image_decode),
    "bayer": (lambda a: N.image_encode(a.astype("<i2"), "bayer"), None, N.image_decode),
    "volume": (lambda a: N.volume_encode(a.astype("<i4").reshape(len(a), 8, -1)), None, lambda d: (v := N.volume_decode(d)).reshape(len(v), -1)),
    "sound": (lambda a: N.audio_encode(a.T.astype("<i2")), None, lambda d: N.audio_decode(d).T),
    "cascade": (
        lambda a: len(a).to_bytes(4, "big") + K.residuals_encode(K.cascade(a.ravel()).tolist()), None,
        lambda d: K.cascade(np.array(K.residuals_decode(d[4:], 64 * (n := int.from_bytes(d[:4], "big"))), np.int64), back=True).reshape(n, 64),
    ),
}


def _register(name: str):
    write, through, read = _FORMATS[name]

    @query(f"{name}_roundtrip", _PLANE)
    def roundtrip(spark, sf_dir):
        p = plane(spark, sf_dir).withColumn("band", F.floor(F.col("y") / _BAND))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["y", "x"])
            a = pdf["v"].to_numpy().reshape(pdf["y"].nunique(), -1)
            data = write(a)
            back = read(through(data) if through else data)
            return pd.DataFrame({"y": pdf["y"], "x": pdf["x"], "v": np.asarray(back).astype(np.int64).reshape(a.shape).ravel()})

        return p.groupBy("band").applyInPandas(run, "y long, x long, v long")


for _name in _FORMATS:
    _register(_name)


@query("mtx_roundtrip", "SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders")
def mtx_roundtrip(spark, sf_dir):
    """Orders as sparse triples (customer, order, amount), a file for each 10,000, through coordinate text and back."""
    t = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", scaled("o_totalprice").alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        triples = pdf[["o_custkey", "o_orderkey", "v"]].to_numpy() + np.array([1, 1, 0])
        back = S.read_mtx(S.write_mtx(triples, *triples[:, :2].max(axis=0).tolist())) - np.array([1, 1, 0])
        return pd.DataFrame(back, columns=["o_custkey", "o_orderkey", "v"])

    return B.through_files(t, "o_orderkey", run, "o_custkey long, o_orderkey long, v long")


_CLIP = f"SELECT y // 16 AS z, y % 16 AS y, x, ((v % 256) + 256) % 256 AS v FROM ({_PLANE})"


@query("video_roundtrip", _CLIP)
def video_roundtrip(spark, sf_dir):
    """Bands of 16 vectors as frames of a clip, eight frames a clip, through a video file's codec and back."""
    p = plane(spark, sf_dir).select(F.floor(F.col("y") / 16).alias("z"), F.pmod("y", F.lit(16)).alias("y"), "x", F.pmod("v", F.lit(256)).alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["z", "y", "x"])
        out = []
        sizes = pdf.groupby("z").size()
        whole = pdf[pdf["z"].isin(sizes[sizes == 16 * 64].index)]
        frames = whole["v"].to_numpy().reshape(-1, 16, 64).astype(np.uint8)
        back = N.METHODS["y4m"][1](N.METHODS["y4m"][0](S.write_y4m(frames))) if len(frames) else b""
        if len(frames):
            out.append(whole.assign(v=N.read_y4m(back)[2][0].ravel().astype(np.int64)))
        rest = pdf[~pdf["z"].isin(whole["z"])]  # a last band that fills no frame goes as a plane
        if len(rest):
            a = rest["v"].to_numpy().reshape(-1, 64)
            out.append(rest.assign(v=N.image_decode(N.image_encode(a.astype("<i2"))).ravel().astype(np.int64)))
        return pd.concat(out)[["z", "y", "x", "v"]]

    return p.groupBy(F.floor(F.col("z") / 8).alias("clip")).applyInPandas(run, "z long, y long, x long, v long")


@query(
    "flow_records_roundtrip",
    "SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS t, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events",
)
def flow_records_roundtrip(spark, sf_dir):
    """Events as 54-byte flow records with dictionaries for their types, a file for each 10,000, and back."""
    t = table(spark, sf_dir, "events").select("event_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))").alias("t"), "user_id", "event_type", scaled("value").alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [
            (t, 0, kind, u.to_bytes(4, "big"), 0, "->", bytes(4), 0xFFFFFFFF, "CON", 0, 255, 1, k, v, "none")
            for k, t, u, kind, v in zip(*(pdf[c].tolist() for c in ("event_id", "t", "user_id", "event_type", "v")), strict=True)
        ]
        back = S.read_flows(*S.write_flows(rows))
        return pd.DataFrame([(r[12], r[0], int.from_bytes(r[3], "big"), r[2], r[13]) for r in back], columns=["event_id", "t", "user_id", "event_type", "v"])

    return B.through_files(t, "event_id", run, "event_id long, t long, user_id long, event_type string, v long")


@query("placed_symbols_roundtrip", "SELECT event_id, props FROM events")
def placed_symbols_roundtrip(spark, sf_dir):
    """Messages as lines of bytes, each coded given the byte before and its place, a block for each 10,000, and back."""
    t = table(spark, sf_dir, "events").select("event_id", "props")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = [list((v or "").encode()) for v in pdf["props"]]
        used = sorted({b for x in lines for b in x})
        code = {b: k for k, b in enumerate(used)}
        blob = K.placed_encode([[code[b] for b in x] for x in lines], max(1, len(used)))
        back = K.placed_decode(blob, [len(x) for x in lines], max(1, len(used)))
        texts = [bytes(used[k] for k in x).decode() for x in back]
        return pd.DataFrame({"event_id": pdf["event_id"], "props": [x if v is not None else None for x, v in zip(texts, pdf["props"], strict=True)]})

    return B.through_files(t, "event_id", run, "event_id long, props string")
