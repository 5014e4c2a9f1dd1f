"""What a blob holds, from its first bytes: signatures, then the share of printable bytes, then text cues.

The order of the rules is part of their meaning. Bytes are read as Latin-1
characters, so that lengths and offsets count bytes inside generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offset, signature, kind, codec: fixed values of public file formats, in order.
MAGIC = (
    (0, b"\x89PNG\r\n\x1a\n", "image/png", "store"),
    (0, b"\xff\xd8\xff", "image/jpeg", "store"),
    (0, b"GIF8", "image/gif", "store"),
    (0, b"YUV4MPEG2", "video/y4m", "videocodec"),
    (0, b"\x93NUMPY", "array/npy", "imagecodec"),
    (0, b"SIMPLE  =", "image/fits", "imagecodec"),
    (0, b"\x1f\x8b", "compressed/gzip", "store"),
    (0, b"PK\x03\x04", "compressed/zip", "store"),
    (0, b"\xfd7zXZ\x00", "compressed/xz", "store"),
    (0, b"(\xb5/\xfd", "compressed/zstd", "store"),
    (0, b"BZh", "compressed/bzip2", "store"),
    (0, b"\x7fELF", "binary/elf", "generic"),
    (0, b"%PDF", "doc/pdf", "store"),
    (128, b"DICM", "image/dicom", "imagecodec"),
)
#: Cues of source code, fixed values; so many in all make a text code.
KEYWORDS = ("def ", "import ", "class ", "return ", "#include", "function ", "public ", "package ", "=>", "const ", "var ")
KEYWORD_HITS = 3
SAMPLE, HEAD, PRINTABLE = 8192, 4096, 0.90
#: How lines of a log begin: a date or a time; a fixed value, as other expressions would find other kinds.
STAMP = r"^\s*[\[\(]?\d{4}-\d\d-\d\d|^\s*[A-Z][a-z]{2}\s+\d+\s+\d\d:\d\d|^\s*\d\d:\d\d:\d\d"


def latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def _at(data: Column, offset: int, size: int) -> Column:
    return F.substring(data, offset + 1, size)


def printable_ratio(data: Column) -> Column:
    """Share of the first 8,192 bytes that are printable ASCII, tab or a line end; 0 for none."""
    sample = latin(F.substring(data, 1, SAMPLE))
    n = F.length(sample)
    high = F.octet_length(sample) - n  # in UTF-8 the Latin-1 characters from 128 on take two bytes
    other = high + F.regexp_count(sample, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))
    return F.when(n == 0, F.lit(0.0)).otherwise((n - other) / n)


def text_kind(data: Column) -> Column:
    """json, xml, html, code, log, csv or plain; white space alone is plain."""
    head = F.regexp_replace(latin(F.substring(data, 1, HEAD)), r"^[\t-\r\x20]+", "")
    lines = F.slice(F.filter(F.split(latin(F.substring(data, 1, SAMPLE)), "\n"), lambda x: x != ""), 1, 6)

    def rest(some):  # of the first lines, which are found once
        stamped = F.size(F.filter(some, lambda x: F.rlike(x, F.lit(STAMP))))
        commas = F.transform(some, lambda x: F.length(x) - F.length(F.replace(x, F.lit(","))))
        kind = F.when(F.size(some) < 3, "text/plain").when(stamped >= F.floor(F.size(some) / 2) + 1, "text/log")
        return kind.when((F.array_min(commas) == F.array_max(commas)) & (F.array_min(commas) >= 1), "text/csv").otherwise("text/plain")

    def of(x):
        head, low = x["head"], x["low"]
        first = F.substring(head, 1, 1)
        hits = reduce(lambda a, b: a + b, [(F.length(low) - F.length(F.replace(low, F.lit(k)))) / len(k) for k in KEYWORDS])
        return (
            F.when(first.isin("{", "["), "text/json")
            .when((first == "<") & (F.contains(low, F.lit("<!doctype html")) | F.contains(low, F.lit("<html"))), "text/html")
            .when(first == "<", "text/xml")
            .when(hits >= KEYWORD_HITS, "text/code")
            .otherwise(F.element_at(F.transform(F.array(lines), rest), 1))
        )

    once = F.transform(F.array(head), lambda h: F.struct(h.alias("head"), F.lower(h).alias("low")))
    return F.element_at(F.transform(once, of), 1)


def identify(df: DataFrame, data: str, kind: str = "kind", codec: str = "codec") -> DataFrame:
    """``df`` with the kind and the codec to try for a binary column; null and empty data are empty."""
    raw = F.coalesce(F.col(data), F.lit(b""))
    rule = F.when(F.length(raw) == 0, F.struct(F.lit("empty").alias("kind"), F.lit("store").alias("codec")))
    answer = lambda k, c: F.struct((k if isinstance(k, Column) else F.lit(k)).alias("kind"), F.lit(c).alias("codec"))
    for offset, magic, k, c in MAGIC:
        rule = rule.when(_at(raw, offset, len(magic)) == F.lit(magic), answer(k, c))
    tiff = (_at(raw, 0, 4) == F.lit(b"II*\x00")) | (_at(raw, 0, 4) == F.lit(b"MM\x00*"))
    rule = rule.when(tiff & (_at(raw, 8, 2) == F.lit(b"CR")), answer("image/cr2", "imagecodec")).when(tiff, answer("image/tiff", "imagecodec"))
    rule = rule.when((_at(raw, 0, 4) == F.lit(b"RIFF")) & (_at(raw, 8, 4) == F.lit(b"WAVE")), answer("audio/wav", "audiocodec"))
    rule = rule.when(printable_ratio(raw) >= PRINTABLE, answer(text_kind(raw), "model")).otherwise(answer("binary/unknown", "generic"))
    return df.withColumn("_r", rule).withColumns({kind: F.col("_r.kind"), codec: F.col("_r.codec")}).drop("_r")


def container(data: Column) -> Column:
    """Which decoder a stored blob wants, by its first bytes."""
    return F.when(_at(data, 0, 1) == F.lit(b"\xc7"), "model").when(_at(data, 0, 2) == F.lit(b"AZ"), "auto").otherwise("unknown")
