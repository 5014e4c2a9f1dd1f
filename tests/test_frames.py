import os

import pytest
from pyspark.sql import functions as F

from strandline.functions import bits
from strandline.functions.sql import register
from strandline.operators import blocks as B
from strandline.operators import detect, dictionary, grid, transforms
from strandline.operators import coders as K
from strandline.operators import tokens as T
from strandline.sources import blobs, store
from strandline.streaming import messages


def test_differences_with_nulls_and_one_row(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, 9), (2, 1, 7)], "g int, i int, v long")
    d = {(r.g, r.i): r.d for r in transforms.delta(df, "v", ["g"], ["i"]).collect()}
    assert d == {(1, 1): 5, (1, 2): None, (1, 3): 4, (2, 1): 7}  # from the last value that isn't null
    back = transforms.undelta(transforms.delta(df, "v", ["g"], ["i"]).drop("v"), "d", ["g"], ["i"])
    assert {(r.g, r.i): r.v for r in back.collect()} == {(1, 1): 5, (1, 2): None, (1, 3): 9, (2, 1): 7}
    assert transforms.delta(df.limit(0), "v", ["g"], ["i"]).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 8])
def test_prefix_sums_do_not_depend_on_partitions(spark, parts):
    df = spark.range(1000).repartition(parts).select(F.col("id").alias("i"), (F.col("id") % 7).alias("v"))
    got = [r.total for r in transforms.prefix_sums(df, "v", ["i"], block_rows=parts).orderBy("i").collect()]
    want, t = [], 0
    for i in range(1000):
        t += i % 7
        want.append(t)
    assert got == want


@pytest.mark.parametrize("n", [99, 100, 101])
def test_blocks(spark, n):
    df = spark.range(n).select(F.lit("a").alias("g"), F.col("id").alias("i"), ((F.col("id") * 37) % 11 - 5).alias("v"))
    coded = B.coded(B.in_blocks(df, "v", ["g"], ["i"], rows=50), K.residuals_encode)
    assert coded.count() == -(-n // 50)
    back = B.rows_back(B.decoded(coded, K.residuals_decode), ["g"], "i")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_detection_order_and_nulls(spark):
    rows = [(1, b"\x1f\x8b{"), (2, None), (3, b""), (4, b"  \n "), (5, b"a,b\n1,2\n3,4"), (6, bytes(range(256)))]
    got = {r.i: r.kind for r in detect.identify(spark.createDataFrame(rows, "i int, data binary"), "data").collect()}
    assert got == {1: "compressed/gzip", 2: "empty", 3: "empty", 4: "text/plain", 5: "text/csv", 6: "binary/unknown"}
    df = spark.createDataFrame([(b"\xc7x",), (b"AZ1",), (b"zz",)], "d binary")
    assert [r[0] for r in df.select(detect.container(F.col("d"))).collect()] == ["model", "auto", "unknown"]


def test_grid_cells_and_numbers(spark):
    rows = [(1, "a;b\r\n1.50;x\r\n-0.25;y\r\n"), (2, "a;b\n1;2;3\n4;5\n"), (3, "v|w\n01|1\n2|-0\n3|4"), (4, None)]
    by_rows = {r.k: (r.terminator, r.delimiter) for r in grid.delimiters(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert by_rows == {1: ("\r\n", ";"), 3: ("\n", "|")}
    long = grid.cells(spark.createDataFrame(rows, "k int, t string"), "k", "t")
    assert {r.k for r in long.select("k").distinct().collect()} == {1, 3}
    kinds = {(r.k, r.col): (r.ndec, r.numeric) for r in grid.numeric_columns(long.where("row > 0"), ["k", "col"]).collect()}
    assert kinds == {(1, 0): (2, True), (1, 1): (None, False), (3, 0): (None, False), (3, 1): (None, False)}


def test_runs_join_nulls(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, None, "a", "a", None, "b"])], "g int, i int, v string")
    runs = dictionary.run_lengths(df, "v", ["g"], ["i"])
    assert sorted((r.start, r.n, r.v) for r in runs.collect()) == [(0, 2, None), (2, 2, "a"), (4, 1, None), (5, 1, "b")]
    assert sorted((r.i, r.v) for r in dictionary.unrun(runs, "v", ["g"]).collect()) == [(i, v) for i, v in enumerate([None, None, "a", "a", None, "b"])]


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT zigzag(-3L) AS a, unzigzag(zigzag(-3L)) AS b, bucket(0L) AS c, bucket(9L) AS d, value_slot(9L) AS e, varint_length(300L) AS f, rice_length(9L, 2) AS g").first()
    assert tuple(r) == (5, -3, 0, 4, 3, 2, 5)
    x = spark.range(-50, 50).select("id", bits.unzigzag(bits.zigzag(F.col("id"))).alias("b"))
    assert x.where("id <> b").count() == 0


def test_folders_splits_and_leaks(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"f{k}.txt").write_bytes(b"same" if k > 3 else b"text %d" % k)
    files = blobs.read_folder(spark, str(tmp_path))
    assert files.count() == 6 and blobs.collect(files, ["txt"], 1, 100, 10).count() == 5
    split = blobs.split_by_order(files.withColumn("g", F.lit(1)), "path", ["g"])
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    assert train.count() == 4 and blobs.leaks(train, test).count() == 0
    blobs.require_disjoint(train, test, "name")
    with pytest.raises(ValueError, match="f5.txt"):
        blobs.require_disjoint(files.where("name = 'f4.txt'"), files.where("name = 'f5.txt'"), "name")


def test_generated_texts_are_stable(spark):
    for kind, want in (("json", "text/json"), ("logs", "text/log"), ("html", "text/html")):
        a = blobs.generated(spark, kind, 20)
        joined = spark.createDataFrame([(b"\n".join(bytes(r.data) for r in a.orderBy("id").collect()),)], "data binary")
        assert detect.identify(joined, "data").first().kind == want
        assert a.repartition(5).exceptAll(blobs.generated(spark, kind, 20)).count() == 0


def test_messages_and_fixed_point(spark):
    lines = spark.createDataFrame([("1 2 3",), ("1 2",), ("  4   5 6 ",)], "value string")
    assert sorted(r[0] for r in blobs.messages(lines, ["a", "b", "c"]).collect()) == ['{"a":"1","b":"2","c":"3"}', '{"a":"4","b":"5","c":"6"}']
    df = spark.createDataFrame([("1.25",), ("-0.50",), ("1.2",), (None,)], "s string")
    assert [r[0] for r in df.select(blobs.fixed_point("s", 2)).collect()] == [125, -50, None, None]


def test_store(spark, tmp_path):
    rows = [(1, "deflate", __import__("zlib").compress(b"abc")), (2, "store", b"xyz")]
    store.write_blobs(spark.createDataFrame(rows, "id int, method string, blob binary"), str(tmp_path / "b"))
    got = store.decode_blobs(store.read_blobs(spark, str(tmp_path / "b")))
    assert sorted((r.id, bytes(r.data)) for r in got.collect()) == [(1, b"abc"), (2, b"xyz")]
    assert os.path.isdir(tmp_path / "b" / "method=store")
    model = T.train([b"hello world %d" % i for i in range(10)], [b"hello "], [b""])
    store.save_model(spark, model, str(tmp_path / "m"))
    again = store.load_model(spark, str(tmp_path / "m"))
    assert T.decompress(T.compress(b"hello world 77", model), again) == b"hello world 77"


def test_streams_equal_batches(spark, tmp_path):
    src = spark.createDataFrame([(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, i * 3, f'{{"n":{i}}}') for i in range(120)], "i long, t string, k long, v long, m string")
    src = src.withColumn("t", F.col("t").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    shared = spark.sparkContext.broadcast(T.Model())
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = messages.encode_messages(stream.select("i", "m"), "m", shared).writeStream.format("memory").queryName("enc").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = messages.encode_messages(src.select("i", "m"), "m", shared)
    assert spark.table("enc").exceptAll(batch).count() == 0 and spark.table("enc").count() == 120
    q = messages.encode_windows(stream, "v", "k", "t").writeStream.format("memory").queryName("win").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    for r in spark.table("win").collect():
        assert len(K.residuals_decode(bytes(r.blob), r.n)) == r.n
