"""Functions for SQL: scalar ones as SQL expressions, so that they stay in generated code; functions that give rows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import containers as N
from ..operators import tokens as K

FUNCTIONS = {
    "zigzag(v BIGINT) RETURNS BIGINT": "shiftleft(v, 1) ^ shiftright(v, 63)",
    "unzigzag(u BIGINT) RETURNS BIGINT": "shiftrightunsigned(u, 1) ^ -(u & 1)",
    "bucket(u BIGINT) RETURNS BIGINT": "CASE WHEN u = 0 THEN 0 ELSE length(bin(u)) END",
    "value_slot(v BIGINT) RETURNS BIGINT": "length(bin(v)) - 1",
    "varint_length(v BIGINT) RETURNS BIGINT": "greatest(1, ceil(CASE WHEN v = 0 THEN 0 ELSE length(bin(v)) END / 7))",
    "rice_length(u BIGINT, k INT) RETURNS BIGINT": "shiftrightunsigned(u, k) + 1 + k",
}


@udtf(returnType="at: int, kind: string, size: int, distance: int")
class Tokenize:
    """tokenize(text): the tokens of least cost without a model: bytes and matches, with their places."""

    def eval(self, text: str):
        at, model = 0, K.Model()
        for t in K.parse((text or "").encode(), model):
            size = t[1] if t[0] == "m" else 1
            yield at, "match" if t[0] == "m" else "byte", size, t[2] if t[0] == "m" else None
            at += size


@udtf(returnType="start: int, n: int, value: string")
class Rle:
    """rle(values): the runs of equal values of an array; nulls are equal."""

    def eval(self, values: list):
        start = 0
        for k in range(1, len(values or []) + 1):
            if k == len(values) or values[k] != values[start]:
                yield start, k - start, values[start]
                start = k


@udtf(returnType="method: string, size: int")
class Route:
    """route(data, kind): the encoding that the router takes for bytes of a kind, and its size."""

    def eval(self, data: bytes, kind: str):
        method, blob = N.choose(bytes(data or b""), kind)
        yield method, len(blob)


TABLE_FUNCTIONS = {"tokenize": Tokenize, "rle": Rle, "route": Route}


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL of this session."""
    for name, made in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, made)
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
