"""Code-point spans of regular expressions as DataFrame expressions (no Python at run time).

``split`` gives the text between matches and ``regexp_extract_all`` the matches;
running sums of both lengths give the offsets.  Rows without a match skip all of it.

Work is about linear in the text and the matches: running values are taken in chunks of
``CHUNK`` and then over the chunks, spans that cover a place are found by halving, and
texts are cut by way of pieces of ``PIECE`` code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
NO_SPANS = f"cast(array() as {SPAN})"
CHUNK = 64
PIECE = 1024
# halvings that reach any place of an array
STEPS = 31


def no_spans() -> Column:
    return F.expr(NO_SPANS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running sum, maximum or the like of an array<int>: op(so far, next), 0 at the start."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all"))

    def fold(array):
        def step(acc, v):
            new = op(acc["at"], v).cast("int")
            return F.struct(new.alias("at"), F.concat(acc["all"], F.array(new)).alias("all"))
        return F.aggregate(array, zero, step, lambda a: a["all"])

    def whole(v):
        last = F.floor((F.size(v) - 1) / CHUNK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda c: fold(F.slice(v, c * CHUNK + 1, F.lit(CHUNK))))
        return let(parts, lambda p: let(
            fold(F.transform(p, lambda x: F.element_at(x, -1))),
            lambda ends: F.flatten(F.transform(p, lambda x, i: F.when(i == 0, x).otherwise(
                F.transform(x, lambda y: op(F.get(ends, i - 1), y).cast("int")))))))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.expr("cast(array() as array<int>)")))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return running(values, F.greatest)


def first_above(sorted_: Column, limit: Column, strict: bool = True) -> Column:
    """0-based place of the first entry of an ascending array that is > (or >=) ``limit``; its size if none."""
    zero = F.struct(F.lit(0).alias("lo"), F.size(sorted_).alias("hi"))

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        at = F.get(sorted_, mid)
        high = at > limit if strict else at >= limit
        done = s["lo"] >= s["hi"]
        return F.struct(F.when(done | high, s["lo"]).otherwise(mid + 1).alias("lo"),
                        F.when(done | ~high, s["hi"]).otherwise(mid).alias("hi"))

    # as many halvings as the size has binary digits
    steps = F.char_length(F.bin(F.size(sorted_).cast("long")))
    return F.aggregate(F.sequence(F.lit(1), steps), zero, step, lambda s: s["lo"])


def regex_spans(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches as (kind, start, end, value), in order.

    Offsets are code points, the end exclusive.
    """
    def spans(both):
        lengths = F.flatten(F.zip_with(
            F.slice(both["pieces"], 1, F.size(both["values"])), both["values"],
            lambda p, v: F.array(F.char_length(p), F.char_length(v))))
        return let(running_sum(lengths), lambda at: F.transform(both["values"], lambda v, i: F.struct(
            F.lit(kind).alias("kind"), F.get(at, 2 * i).alias("start"), F.get(at, 2 * i + 1).alias("end"), v.alias("value"))))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"),
                    F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    return F.when(text.rlike(pattern), let(both, spans)).otherwise(no_spans())


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the order given."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def by_start(spans: Column, kinds: list[str]) -> Column:
    """Spans ordered by start, then by the order of ``kinds``, then by end."""
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(kinds) for x in (kind, k)])
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def by_kind(spans: Column, kinds: list[str]) -> Column:
    """Spans ordered by the order of ``kinds``, then start, then end."""
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(kinds) for x in (kind, k)])
    keyed = F.transform(spans, lambda s: F.struct(
        rank[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def cover(spans: Column) -> Column:
    """struct(starts, ends, spans) of spans ordered by start: ``ends`` are running maxima, so both ascend."""
    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return let(plain, lambda p: F.struct(
        F.transform(p, lambda s: s["start"]).alias("starts"),
        running_max(F.transform(p, lambda s: s["end"])).alias("ends"), p.alias("spans")))


def touched(covered: Column, start: Column, end: Column) -> Column:
    """Whether any span of a :func:`cover` overlaps [start, end)."""
    at = first_above(covered["ends"], start)
    return F.coalesce(F.get(covered["starts"], at) < end, F.lit(False))


def overlapping(covered: Column, start: Column, end: Column) -> Column:
    """The spans of a :func:`cover` that may overlap [start, end), by start; all that do are among them."""
    return let(F.struct(first_above(covered["ends"], start).alias("a"),
                        first_above(covered["starts"], end, strict=False).alias("b")),
               lambda r: F.slice(covered["spans"], r["a"] + 1, F.greatest(r["b"] - r["a"], F.lit(0))))


def replaced(text: Column, spans: Column, mask: Callable[[Column], Column]) -> Column:
    """``text`` with every span replaced by ``mask(span)``.

    ``spans`` are ordered by start; one that begins inside an earlier one adds nothing but
    may lengthen the cut.
    """
    def cut(parts, start, end):
        a, b = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")

        def sub(k, x, y):
            return F.coalesce(F.substring(F.get(parts, k), (x - k * PIECE + 1).cast("int"), (y - x).cast("int")), F.lit(""))

        return F.when(end <= start, F.lit("")).when(a == b, sub(a, start, end)).otherwise(F.concat(
            sub(a, start, (a + 1) * PIECE), F.array_join(F.slice(parts, a + 2, F.greatest(b - a - 1, F.lit(0))), ""),
            sub(b, b * PIECE, end)))

    def build(x):
        parts, ends, s = x["parts"], x["ends"], x["spans"]
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
        pieces = F.transform(s, lambda v, i: F.when(v["start"] >= before(i), F.concat(
            cut(parts, before(i), v["start"]), mask(v))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), cut(parts, F.element_at(ends, -1), F.char_length(text)))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    state = let(spans, lambda s: F.struct(parts.alias("parts"), running_max(
        F.transform(s, lambda v: v["end"])).alias("ends"), s.alias("spans")))
    return F.when(F.size(spans) > 0, let(state, build)).otherwise(text)
