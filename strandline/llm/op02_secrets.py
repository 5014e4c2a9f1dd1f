"""Secret scan by a trigram inverted index, in DataFrame and SQL functions alone.

From each rule's regular expression a Boolean query over trigrams is derived
that every match satisfies. The trigrams of each text are taken from it in one
pass, and the index holds, for shards of some thousand documents, the ids with
each trigram that a query asks for (postings of others would not be read; of a
run of letters ``PER_RUN`` are asked for, which costs some more candidates and
spares postings); postings are united and intersected shard by shard, and the
expressions run over candidates only. A rule without a mandatory trigram (runs
of hexadecimal digits) scans all documents. Positions come from the lengths of
what lies between matches and of the matches themselves, summed in blocks of the
root of their number, so that a text with many matches doesn't cost the square
of them.

Defined cases: a null text is empty; rows without an id are scanned by every
rule; rows that repeat an id are candidates together and scanned each; extra
columns pass through, and names that clash get underscores in front.
"""

from __future__ import annotations

import re._constants as K
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Documents a shard of the index holds on average; trigrams asked for a run of letters at most.
SHARD_ROWS, PER_RUN = 4096, 4
#: Strings that the derivation keeps apart before it settles for their trigrams.
MOST = 40


def _anycase(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret; group ``group`` of a match must have ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


_WORDS = "|".join([*map(_anycase, ("password", "passwd", "secret", "token")), _anycase("api") + "_?" + _anycase("key")])
BASE = (
    Rule("assign", rf"({_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}"),
)
RULES = BASE + MORE


# ------------------------------------------------------------------ trigram queries

def _strings(items) -> set[str] | None:
    """All strings that a part of an expression matches, in lower case, if they are few."""
    out = {""}
    for op, arg in items:
        if op is K.LITERAL:
            some = {chr(arg).lower()}
        elif op is K.IN:
            some = set()
            for o, a in arg:
                if o is K.LITERAL:
                    some.add(chr(a).lower())
                elif o is K.RANGE and a[1] - a[0] < MOST:
                    some |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
                else:
                    return None
            if len(some) > 8:
                return None
        elif op is K.SUBPATTERN:
            some = _strings(arg[3])
        elif op is K.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            some = None if None in parts else set().union(*parts)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[1] <= 4:
            one = _strings(arg[2])
            some = None if one is None else set().union(*({a * n for a in one} for n in range(arg[0], arg[1] + 1)))
        else:
            some = None
        if some is None or len(out) * len(some) > MOST:
            return None
        out = {a + b for a in out for b in some}
    return out


def _asked(text: str) -> frozenset[str]:
    """At most PER_RUN trigrams, spread over the text."""
    last = len(text) - 3
    if last < PER_RUN:
        return frozenset(text[k : k + 3] for k in range(last + 1))
    return frozenset(text[k : k + 3] for k in (round(i * last / (PER_RUN - 1)) for i in range(PER_RUN)))


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """A conjunction of disjunctions of sets of trigrams, all of a set being meant; empty: no condition."""
    out: list[list[frozenset[str]]] = []

    def settle(run: set[str]) -> None:
        if all(len(s) > 2 for s in run):
            shortest = (s for s in run if not any(t != s and t in s for t in run))
            either = {_asked(s) for s in shortest}
            out.append(sorted((a for a in either if not any(b < a for b in either)), key=sorted))

    def walk(items) -> None:
        run = {""}
        for item in items:
            some = _strings([item])
            if some is not None and len(run) * len(some) <= MOST:
                run = {a + b for a in run for b in some}
                continue
            settle(run)
            run = some or {""}
            op, arg = item
            if some is None and op is K.SUBPATTERN:
                walk(arg[3])
            elif some is None and op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0:
                walk(arg[2])
        settle(run)

    walk(parser.parse(regex))
    return out


# ------------------------------------------------------------------ index and candidates

def _either(words: list[str]) -> str:
    """An expression for any of some strings of one length, by their beginnings."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    if all(v == [""] for v in by.values()):
        return "[" + "".join(map(_plain, by)) + "]"
    return "(?:" + "|".join(_plain(c) + _either(v) for c, v in by.items()) + ")"


def _plain(c: str) -> str:
    return c if c.isalnum() or c == "_" else "\\" + c


def trigram_expression(trigrams: list[str]) -> str:
    """Matches, at each place where one of the trigrams stands, nothing, with the trigram as its group 1."""
    within = "".join("[" + "".join(_plain(c) for c in sorted({t[k] for t in trigrams})) + "]" for k in range(3))
    return f"(?={within})(?=({_either(trigrams)}))"


def trigram_index(docs: DataFrame, trigrams: list[str], *, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, trigram, ids): the documents of each shard whose lower-cased text has the trigram."""
    shards = max(1, -(-docs.count() // shard_rows))
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    found = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.pmod(F.xxhash64(id_col), F.lit(shards)).alias("shard"),
        F.array_distinct(F.regexp_extract_all(low, F.lit(trigram_expression(trigrams)), F.lit(1))).alias("trigrams"),
    )
    rows = found.select("id", "shard", F.explode("trigrams").alias("trigram"))
    return rows.groupBy("shard", "trigram").agg(F.collect_set("id").alias("ids"))


def candidates(index: DataFrame, queries: dict[str, list[list[frozenset[str]]]]) -> DataFrame:
    """(id, kinds): for each document the rules whose trigram query its postings satisfy."""
    shard = index.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("posts"))
    post = lambda t: F.coalesce(F.try_element_at("posts", F.lit(t)), F.array().cast(dict(index.dtypes)["ids"]))
    every = lambda xs: reduce(F.array_intersect, xs)
    some = lambda xs: reduce(F.array_union, xs)
    named = lambda kind: lambda i: F.struct(i.alias("id"), F.lit(kind).alias("kind"))
    hits = [
        F.transform(every([some([every([post(t) for t in sorted(a)]) for a in either]) for either in q]), named(kind))
        for kind, q in queries.items() if q
    ]
    flat = shard.select(F.explode(F.flatten(F.array(*hits))).alias("h")).select("h.id", "h.kind")
    return flat.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _let(value: Column, made) -> Column:
    """``made`` of a value that is found once, however often ``made`` uses it."""
    return F.element_at(F.transform(F.array(value), made), 1)


def _blocks(rows: Column) -> Column:
    """The rows in blocks of the root of their number."""
    step = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(rows))).cast("int"))
    last = F.greatest(F.lit(0), F.ceil(F.size(rows) / step).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(rows, k * step + 1, step))


def _running(rows: Column, value, merge, zero: Column, made, kind: str) -> Column:
    """``made(row, before)`` for each row of an array, ``before`` being all earlier rows' values merged.

    Rows go in blocks of the root of their number: arrays grow by appending, which copies them.
    """
    begin = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
    after = lambda s, t: F.struct(merge(s["at"], t).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    def heads(blocks):
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda t, x: merge(t, value(x))))
        return F.aggregate(totals, begin, after, lambda s: s["out"])

    def whole(z):
        inner = F.struct(z["head"].alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        step = lambda s, x: F.struct(merge(s["at"], value(x)).alias("at"), F.concat(s["out"], F.array(made(x, s["at"]))).alias("out"))
        return F.aggregate(z["block"], inner, step, lambda s: s["out"])

    return _let(_let(rows, _blocks), lambda blocks: F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), heads(blocks).alias("head")), whole)))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """(start, order, kind, end) of the rule's matches, in code points."""
    regex = F.lit(rule.regex)
    gap = F.transform(F.split(text, rule.regex, -1), F.length)
    hit = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.length)
    kept = F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
    rows = F.arrays_zip(gap.alias("gap"), hit.alias("hit"), kept.alias("kept"))
    size = lambda x: x["gap"] + F.coalesce(x["hit"], F.lit(0))

    def span(x, before):
        return F.struct(
            (before + x["gap"]).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (before + size(x)).alias("end"),
            F.coalesce(x["kept"], F.lit(False)).alias("kept"),
        )

    every = _running(rows, size, lambda a, b: a + b, F.lit(0), span, "struct<start:int,order:int,kind:string,end:int,kept:boolean>")
    plain = lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["kind"].alias("kind"), s["end"].alias("end"))
    return F.transform(F.filter(every, lambda s: s["kept"]), plain)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", name: str = "secrets") -> DataFrame:
    """``docs`` with its secrets: structs of start, order, kind and end (exclusive), by start, then rule."""
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    asked = sorted({t for q in queries.values() for either in q for a in either for t in a})
    name = C.free_name(docs.columns, name)
    kinds, own, text = C.free_name(docs.columns, "kinds"), C.free_name(docs.columns, "found_id"), F.coalesce(F.col(text_col), F.lit(""))
    found = docs
    if asked:
        hits = C.written(candidates(trigram_index(docs, asked, id_col=id_col, text_col=text_col), queries), "candidates")
        hits = hits.select(F.col("id").alias(own), F.col("kinds").alias(kinds))
        side = F.broadcast(hits) if hits.limit(300_001).count() <= 300_000 else hits
        found = docs.join(side, docs[id_col] == side[own], "left").drop(own)
    empty = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    parts = []
    for k, r in enumerate(rules):
        tried = F.col(id_col).isNull() | F.coalesce(F.array_contains(kinds, r.kind), F.lit(False)) if queries[r.kind] else F.lit(True)
        parts.append(F.when(tried & F.rlike(text, F.lit(r.regex)), _spans(text, r, k)).otherwise(empty))
    done = found.withColumn(name, F.array_sort(F.concat(*parts)))
    return done.drop(kinds) if asked else done


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret, overlapping ones as one, replaced by ``mark``; n_chars follows where it is a column."""
    name = C.free_name(docs.columns, "secrets")
    found = scan(docs, rules, text_col=text_col, name=name)
    text = F.col(text_col)
    # what stays: from where the spans before it end, to where a span begins; at last the rest
    cut = lambda s, before: F.struct(before.alias("a"), s["start"].alias("b"))
    cuts = _running(F.col(name), lambda s: s["end"], F.greatest, F.lit(0), cut, "struct<a:int,b:int>")
    last = F.struct(F.array_max(F.transform(name, lambda s: s["end"])).alias("a"), F.length(text).alias("b"))
    cuts = F.concat(F.filter(cuts, lambda c: c["b"] >= c["a"]), F.array(last))
    def pieces(block):  # cut from the block's part of the text, as a substring is found by walking to it
        a = F.element_at(block, 1)["a"]
        part = F.array(F.substring(text, a + 1, F.element_at(block, -1)["b"] - a))
        return F.flatten(F.transform(part, lambda p: F.transform(block, lambda c: F.substring(p, c["a"] - a + 1, c["b"] - c["a"]))))

    whole = F.array_join(F.flatten(F.transform(_let(cuts, _blocks), pieces)), mark)
    done = found.withColumn(text_col, F.when(F.size(name) > 0, whole).otherwise(text))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size(name) > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and positions of the secrets of every document."""
    found = scan(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.filter("secrets", lambda s: s["order"] == k)
    n = [F.size(of(k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return found.select(
        "doc_id", *n, F.sha2(told(F.filter("secrets", lambda s: s["order"] < len(BASE))), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans")
    )


def _sql() -> str:
    parts = []
    for k, r in enumerate(RULES):
        regex = r.regex.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {k} AS k, '{r.kind}' AS kind, start, start + len(hit[i]) AS stop FROM (
    SELECT doc_id, hit, part, i, (coalesce(list_sum([len(x) for x in gap[1:i]]), 0) + coalesce(list_sum([len(x) for x in hit[1:i - 1]]), 0))::BIGINT AS start
    FROM (SELECT doc_id, hit, part, gap, unnest(generate_series(1, len(hit))) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{regex}', 0) AS hit, regexp_extract_all(text, '{regex}', {r.group}) AS part,
        string_split_regex(text, '{regex}') AS gap FROM d)))
  WHERE len(part[i]) >= {r.least}""")
    named = "kind || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({" UNION ALL ".join(parts)}),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))},
  string_agg({named}, ',' ORDER BY start, k) FILTER (k < {len(BASE)}) AS base, string_agg({named}, ',' ORDER BY start, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


OP2_SQL = _sql()
