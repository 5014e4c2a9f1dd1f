import random
import zlib

import numpy as np
import pytest

from strandline.__main__ import main
from strandline.functions import sql
from strandline.operators import coders as K
from strandline.operators import containers as N
from strandline.operators import specs as S
from strandline.operators import tokens as T
from strandline.sources import scientific as R


def test_specs_invert_and_tell_themselves():
    edges = [b"", b"a", b"text and more text", bytes(range(256)) * 3, random.Random(1).randbytes(1000), b"\0\1\2\3" * 250]
    for spec in S.SPECS:
        assert S.from_bytes(S.to_bytes(spec)) == spec
        for data in edges:
            assert S.invert(S.apply(data, spec), spec) == data
    for bad in (b"", b"\1", b"\1\x09\1", b"\2\0\1"):
        with pytest.raises(ValueError):
            S.from_bytes(bad)
    assert S.apply(b"\1\2\3\4\5", (("xor", 2),)) == bytes([1, 2, 3 ^ 1, 4 ^ 2, 5 ^ 3])
    assert S.apply(b"abcdefg", (("split", 3),)) == b"adgbecf"


def test_specs_are_chosen_by_packed_size(spark, sf_dir):
    best = lambda d: min(S.SPECS, key=lambda s: S.packed_size(d, s))
    assert best((np.arange(4000) * 3).astype("<u2").tobytes()) != () and best(b"the quick brown fox jumps over the lazy dog. " * 200) == ()
    from strandline import catalogue

    got = {r.source: (r.spec, r.size) for r in catalogue.QUERIES["transform_select"](spark, sf_dir).collect()}
    texts = [r.text.encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if r.text is not None]
    sizes = [(sum(len(zlib.compress(S.apply(t, s), 6)) for t in texts), k) for k, s in enumerate(S.SPECS) if s != (("fcm", 16),)]
    assert got["documents"] == (S.text(S.SPECS[min(sizes)[1]]), min(sizes)[0])


def test_filters_and_placed_symbols():
    rng = np.random.default_rng(2)
    for x in (np.zeros(0, np.int64), np.array([5]), np.array([5, -9]), np.cumsum(rng.integers(-50, 50, 900)), rng.integers(-30_000, 30_000, 600)):
        assert K.cascade(K.cascade(x), back=True).tolist() == x.tolist()
    lines = [[0, 1, 2, 1], [], [2] * 300, [0]]
    blob = K.placed_encode(lines, 3)
    assert K.placed_decode(blob, [len(x) for x in lines], 3) == lines and len(blob) < 60


def test_routes_of_dicom_and_all_chroma():
    a = np.cumsum(np.random.default_rng(3).integers(-3, 4, (64, 64)), axis=1) + 2000
    data = R.write_dicom(a)
    method, blob = N.choose(data, "image/dicom")
    assert method == "dicom" and len(blob) < len(zlib.compress(data, 9)) and N.restore(method, blob) == data
    for kind, shape in (("420", (16, 32)), ("411", (32, 16)), ("422", (32, 32)), ("444", (32, 64)), ("400", None), ("mono", None)):
        frame = bytes(32 * 64) + (bytes(2 * shape[0] * shape[1]) if shape else b"")
        clip = f"YUV4MPEG2 W64 H32 F25:1 C{kind}\n".encode() + (b"FRAME\n" + frame) * 2
        method, blob = N.choose(clip, "video/y4m")
        assert N.restore(method, blob) == clip and N.METHODS["y4m"][1](N.METHODS["y4m"][0](clip)) == clip
    with pytest.raises(ValueError):
        N.read_y4m(b"YUV4MPEG2 W16 H16 C999\nFRAME\n" + bytes(256))


def test_tokens_lazy_repeats_and_blob():
    r = random.Random(4)
    head = b"{\"name\":\"alice\",\"kind\":\"reader\",\"age\":"
    rows = [head + str(r.randrange(99)).encode() + b"}" for _ in range(120)]
    blob = T.select_blob(rows, 64, 32)
    assert len(blob) <= 64 and b"alice" in blob
    model = T.train(rows, [b"alice"], [b"", blob])
    for row in [*rows[:20], b"", bytes(range(256)), b"abcabcabcabcabdabcabd" * 9]:
        lazy = T.parse(row, model, lazy=True)
        assert T.expand(lazy, model) == row and T.cost(T.parse(row, model), model) <= T.cost(lazy, model) + 1e-6
        assert T.decompress(T.compress(row, model), model) == row
    d = [r.choice((3, 7, 9, 40, 1000)) for _ in range(200)]
    assert T.distances_back(T.repeated_offsets(d, T.REPEATS), T.REPEATS) == d


def test_flow_records():
    rows = [(10 + k, k, "tcp" if k % 2 else "udp", bytes([1, 2, 3, k]), 80, "->", bytes(4), 0xFFFFFFFF, "CON", 0, 255, 9, 8, 7, "none") for k in range(5)]
    data, names = R.write_flows(rows)
    assert len(data) == 54 * 5 and R.read_flows(data, names) == rows and names[0] == ["udp", "tcp"]


def test_sql_table_functions(spark):
    sql.register(spark)
    assert [tuple(x) for x in spark.sql("SELECT * FROM rle(array('a', 'a', NULL, NULL, 'b'))").collect()] == [(0, 2, "a"), (2, 2, None), (4, 1, "b")]
    tokens = spark.sql("SELECT * FROM tokenize('abcdabcdabcdabcdabcdabcd')").collect()
    assert sum(t["size"] for t in tokens) == 24 and any(t["kind"] == "match" and t["distance"] == 4 for t in tokens)
    assert spark.sql("SELECT * FROM route(CAST(repeat('a', 500) AS BINARY), 'text/plain')").first()["size"] < 100


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    r = random.Random(6)
    for k in range(30):
        (folder / f"{k}.json").write_text('{"name":"alice","kind":"reader","age":%d}' % r.randrange(99))
    path = lambda n: str(tmp_path / n)
    main(["identify", str(folder)])
    assert capsys.readouterr().out.count("json") >= 30
    main(["auto-compress", str(folder), path("routed")])
    main(["auto-decompress", path("routed"), path("back")])
    main(["train", str(folder), path("model")])
    main(["compress", str(folder), path("trained"), "-m", path("model"), "--or-route"])
    main(["decompress", path("trained"), path("back2"), "-m", path("model")])
    source = {f.name: f.read_bytes() for f in folder.iterdir()}
    for name in ("back", "back2"):
        assert {x.path.rsplit("/", 1)[1]: bytes(x.data) for x in spark.read.parquet(path(name)).collect()} == source
    sizes = [spark.read.parquet(path(n)).selectExpr("sum(size)").first()[0] for n in ("routed", "trained")]
    assert sizes[1] < sizes[0]
    main(["benchmark", str(folder)])
    assert "routed" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["identify", path("none") if (tmp_path / "none").mkdir() is None else ""])
