"""Delimited text: line ends, delimiters, and columns of canonical numbers.

Quotes are not understood on purpose: a quoted delimiter makes a line ragged,
and a ragged text is no grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Delimiters in the order in which they are tried, fixed values.
DELIMITERS = (";", ",", "\t", "|")


def count_of(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what)))) / len(what)


def layout(text: Column) -> Column:
    """Struct of terminator, trailing and lines; terminator is null where there are under 3 line ends or lines.

    CRLF only if every LF follows a CR.
    """
    ends = count_of(text, "\n")
    crlf = F.when((ends > 0) & (count_of(text, "\r\n") == ends), "\r\n").otherwise("\n")
    pieces = F.when(crlf == "\r\n", F.split(text, "\r\n")).otherwise(F.split(text, "\n"))
    trailing = F.element_at(pieces, -1) == ""
    lines = F.when(trailing, F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    ok = (ends >= 3) & (F.size(lines) >= 3)
    return F.struct(F.when(ok, crlf).alias("terminator"), trailing.alias("trailing"), lines.alias("lines"))


def delimiter(lines: Column) -> Column:
    """The first delimiter that every line has equally often, at least once; else null."""
    out = None
    for d in DELIMITERS:
        counts = _counts(lines, d)
        hit = (F.array_min(counts) == F.array_max(counts)) & (F.array_min(counts) >= 1)
        out = F.when(hit, F.lit(d)) if out is None else out.when(hit, F.lit(d))
    return out


def _counts(lines: Column, d: str) -> Column:
    return F.transform(lines, lambda x: count_of(x, d))


def delimiters(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terminator, delimiter) of the texts that are grids.

    Lines are counted as rows in generated code, and each text's least and
    greatest counts are aggregated before the shuffle.
    """
    ends = count_of(F.col(text), "\n")
    crlf = (ends > 0) & (count_of(F.col(text), "\r\n") == ends)
    seen = df.select(key, F.col(text).alias("_t"), ends.alias("_e"), crlf.alias("_crlf")).where("_e >= 3")
    rows = seen.select(key, "_crlf", "_e", F.posexplode(F.split("_t", "\n", -1)).alias("_i", "_l"))
    rows = rows.where((F.col("_i") < F.col("_e")) | (F.col("_l") != ""))  # the piece after a last line end is no line
    line = F.when(F.col("_crlf"), F.regexp_replace("_l", "\r$", "")).otherwise(F.col("_l"))
    counts = rows.select(key, "_crlf", *[count_of(line, d).alias(f"_{k}") for k, d in enumerate(DELIMITERS)])
    low = [F.min(f"_{k}").alias(f"a{k}") for k in range(len(DELIMITERS))]
    high = [F.max(f"_{k}").alias(f"b{k}") for k in range(len(DELIMITERS))]
    sums = counts.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first("_crlf").alias("_crlf"), *low, *high).where("_n >= 3")
    found = None
    for k, d in enumerate(DELIMITERS):
        hit = (F.col(f"a{k}") == F.col(f"b{k}")) & (F.col(f"a{k}") >= 1)
        found = F.when(hit, F.lit(d)) if found is None else found.when(hit, F.lit(d))
    out = sums.select(key, F.when(F.col("_crlf"), "\r\n").otherwise("\n").alias("terminator"), found.alias("delimiter"))
    return out.where(F.col("delimiter").isNotNull())


def cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, col, cell) of the texts that are grids; the header is row 0."""
    found = df.select(key, layout(F.col(text)).alias("g")).where(F.col("g.terminator").isNotNull())
    found = found.select(key, F.col("g.lines").alias("lines")).withColumn("d", delimiter(F.col("lines"))).where(F.col("d").isNotNull())
    rows = found.select(key, "d", F.posexplode("lines").alias("row", "line"))
    split = F.split(F.col("line"), F.concat(F.lit("\\Q"), F.col("d"), F.lit("\\E")), -1)
    return rows.select(key, F.col("row").cast("long").alias("row"), F.posexplode(split).alias("col", "cell")).withColumn("col", F.col("col").cast("long"))


def numeric_columns(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, ndec, numeric): columns whose cells are all canonical whole or fixed-point numbers.

    Canonical: an optional minus, no leading zero, one number of decimals for
    the column, not a negative zero, of at most 62 bits without the point.
    """
    cell = F.col("cell")
    point = F.instr(cell, ".")
    ndec = F.when(point > 0, F.length(cell) - point).otherwise(0)
    digits = F.replace(F.replace(cell, F.lit(".")), F.lit("-"))
    shape = F.rlike(cell, F.lit(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"))
    minus_zero = F.startswith(cell, F.lit("-")) & F.rlike(digits, F.lit("^0*$"))
    fits = (F.length(digits) <= 18) | (F.coalesce(F.try_to_number(digits, F.lit("9" * 38)), F.lit(0)) < F.lit(2**62))
    ok = shape & ~minus_zero & fits
    agg = long.groupBy(*by).agg(F.min(ndec).alias("low"), F.max(ndec).alias("ndec"), F.count_if(~ok | cell.isNull()).alias("bad"))
    numeric = (F.col("bad") == 0) & (F.col("low") == F.col("ndec"))
    return agg.select(*by, F.when(numeric, F.col("ndec")).cast("long").alias("ndec"), numeric.alias("numeric"))


def scaled(cell: Column) -> Column:
    return F.replace(cell, F.lit(".")).cast("long")


def unscaled(v: Column, ndec: Column) -> Column:
    """The canonical text of a whole number with its decimals."""
    digits = F.lpad(F.abs(v).cast("string"), F.greatest(ndec + 1, F.length(F.abs(v).cast("string"))).cast("int"), F.lit("0"))
    whole, part = F.substring(digits, F.lit(1), (F.length(digits) - ndec).cast("int")), F.right(digits, ndec.cast("int"))
    return F.concat(F.when(v < 0, "-").otherwise(""), whole, F.when(ndec > 0, F.concat(F.lit("."), part)).otherwise(""))
