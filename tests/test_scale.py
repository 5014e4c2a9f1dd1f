"""What grows with the input: rows dealt out, values held at once, work done for each row."""

import random
import zlib

import numpy as np
from pyspark import AccumulatorParam
from pyspark.sql import functions as F

from strandline import catalogue
from strandline.operators import blocks as B
from strandline.operators import coders as K
from strandline.operators import containers as N
from strandline.operators import detect as D
from strandline.operators import specs as P
from strandline.operators import stencil as S
from strandline.operators import tokens as T


def _sad(now, before, size=16, reach=8):
    """Brute force over rows (y, x, v): what ``motion`` gives, sums of no values last."""
    my, mx = max(r[0] for r in before), max(r[1] for r in before)
    places = {}
    for y, x, v in before:
        places.setdefault((y, x), []).append(v)
    sums = {}
    for y, x, v in now:
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                for p in places.get((min(my, max(0, y + dy)), min(mx, max(0, x + dx))), ()):
                    met = sums.setdefault((y // size, x // size), {}).setdefault((dy, dx), [])
                    met += [abs(v - p)] if v is not None and p is not None else []
    best = {k: min((not m, sum(m), *d) for d, m in x.items()) for k, x in sums.items()}
    return {(*k, b[2], b[3], None if b[0] else b[1]) for k, b in best.items()}


def test_motion_deals_a_pixel_out_once_for_each_tile_near_it(spark):
    r = random.Random(1)
    now = [(y, x, r.randrange(-9, 10)) for y in range(70) for x in range(70) if r.random() < 0.9]
    before = [(y, x, v) for y, x, v in now if r.random() < 0.9] + [(3, 3, 5), (3, 3, 6), (40, 40, None)]
    now += [(2, 2, None), (5, 5, 1)]
    frame = lambda rows: spark.createDataFrame(rows, "y long, x long, v long")
    assert {tuple(x) for x in S.motion(frame(now), frame(before)).collect()} == _sad(now, before)
    assert S.tiles(frame(now), frame(before), [], 64, 8).count() <= 3 * len(now)


def test_motion_puts_sums_of_no_values_last(spark):
    now = spark.createDataFrame([(0, 0, 7)], "y long, x long, v long")
    before = spark.createDataFrame([(0, 0, None), (1, 0, 9)], "y long, x long, v long")
    assert [tuple(x) for x in S.motion(now, before).collect()] == [(0, 0, 1, -8, 2)]
    nothing = before.withColumn("v", F.lit(None).cast("long"))
    assert [tuple(x) for x in S.motion(now, nothing).collect()] == [(0, 0, -8, -8, None)]
    assert S.motion(now, before.limit(0)).collect() == []


def test_files_of_rows_have_a_size_that_no_table_changes(spark, tmp_path):
    spark.range(0, 30_000, 1, 1).selectExpr("id AS event_id", "timestamp_micros(id) AS ts", "id % 9 AS user_id", "'a' AS event_type", "id / 100 AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(0, 30_000, 1, 1).selectExpr("id AS o_orderkey", "id % 9 AS o_custkey", "id / 100 AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    most = spark.sparkContext.accumulator([0], _Most())
    for name in ("flow_records_roundtrip", "mtx_roundtrip", "placed_symbols_roundtrip", "float_dictionary_roundtrip", "records_codec_roundtrip"):
        df = catalogue.QUERIES[name](spark, str(tmp_path))
        assert "FlatMapGroups" not in df._jdf.queryExecution().toString() and df.count() == 30_000, name
    seen = B.through_files(spark.range(0, 25_000, 1, 1), "id", lambda pdf: (most.add([len(pdf)]), pdf)[1], "id long")
    assert sorted(r[0] for r in seen.collect()) == list(range(25_000)) and 0 < most.value[0] <= B.FILE


class _Most(AccumulatorParam):
    def zero(self, value):
        return [0]

    def addInPlace(self, a, b):
        return [max(a[0], b[0])]


def _fcm(words, bits=12):
    """The two tables word by word."""
    size, full = (1 << bits) - 1, (1 << 64) - 1
    table, deltas, h, g, last, chosen, left = {}, {}, 0, 0, 0, [], []
    for w in words:
        a, b = w ^ table.get(h, 0), w ^ (last + deltas.get(g, 0)) & full
        chosen.append(int(a > b))
        left.append(min(a, b))
        table[h], deltas[g] = w, (w - last) & full
        h, g, last = (h << 6 ^ w >> 48) & size, (g << 2 ^ deltas[g] >> 40) & size, w
    return chosen, left


def test_all_words_are_predicted_at_once():
    r = random.Random(2)
    walk = np.cumsum([r.random() for _ in range(700)]).view(np.uint64).tolist()
    for words in ([], [5], [0, (1 << 64) - 1], [r.choice((1, 7, r.getrandbits(64))) for _ in range(900)], walk, walk * 2):
        for bits in (8, 12, 20):
            chosen, left = K.fcm(words, bits)
            assert isinstance(left, np.ndarray) and (chosen.tolist(), left.tolist()) == _fcm(words, bits)


def test_sizes_of_all_specifications_take_shared_steps_once(monkeypatch):
    data, steps = random.Random(3).randbytes(500) + b"and some words " * 30, []
    apart = [P.packed_size(data, s) for s in P.SPECS]
    for name, f in P.STEPS.items():
        monkeypatch.setitem(P.STEPS, name, lambda *a, f=f, name=name: (steps.append((name, a[1])), f(*a))[1])
    assert P.packed_sizes(data) == apart and len(steps) == len({s[:k] for s in P.SPECS for k in range(1, len(s) + 1)})


def test_routes_code_no_more_than_can_win(monkeypatch):
    deflated, coded = [], []
    monkeypatch.setattr(N.zlib, "compress", lambda *a, f=zlib.compress: (deflated.append(1), f(*a))[1])
    assert N.choose(b"no grid in these words " * 20, "text/plain")[0] == "deflate" and len(deflated) == 1
    monkeypatch.setattr(N.K, "residuals_encode", lambda v, f=K.residuals_encode: (coded.append(1), f(v))[1])
    once = random.Random(4).randbytes(200)
    assert N.find_period(once * 9) == 200 and N.choose(once * 9, "binary/unknown")[0] == "deflate" and len(coded) < 120
    fields = b"".join((k * 3).to_bytes(4, "little") + (k * k).to_bytes(4, "little") for k in range(300))
    method, blob = N.choose(fields, "binary/unknown")
    assert method == "records" and blob == N.records_encode(fields) and N.restore(method, blob) == fields


def test_places_of_a_model_are_found_once(monkeypatch):
    model, found = T.Model([b"the "], b"some text of the model, some text of it"), []
    fresh = [T.matches(model.blob + d, len(model.blob), n) for d in (b"", b"it", b"some text, some text", b"aaaaaa") for n in (1, 2, 32)]
    monkeypatch.setattr(T, "places", lambda blob: found.append(blob))
    assert [T.matches(model.blob + d, len(model.blob), n, model.places) for d in (b"", b"it", b"some text, some text", b"aaaaaa") for n in (1, 2, 32)] == fresh
    assert T.decompress(T.compress(b"some text of the other", model), model) == b"some text of the other" and not found


def test_trained_against_untrained_counts_each_row_once(spark, tmp_path):
    rows = [(k % 3 if k else None, '{"name":"alice","kind":"reader","age":%d}' % (k % 50) if k % 7 else None) for k in range(200)]
    spark.createDataFrame(rows, "event_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    df = catalogue.QUERIES["trained_beats_untrained"](spark, str(tmp_path))
    assert [tuple(x) for x in df.collect()] == [(200, True)]


def test_share_of_printable_bytes_over_all_bytes(spark):
    some = [(bytes(range(256)),), (b"",), (b"\x7f\x80\xff\0\x1f",), (b"a\t\r\n ~",)]
    shares = spark.createDataFrame(some, "data binary").select(D.printable_ratio(F.col("data"))).collect()
    assert [x[0] for x in shares] == [98 / 256, 0.0, 0.0, 1.0]
