"""Secret scans: fixed patterns plus sliding-window Shannon entropy, JVM expressions only.

Base spans are assignments to secret-like names, access key ids and long
lower-case hex runs.  The method adds ``entropy`` spans: candidate strings (runs
of token characters) are classed by their characters (hex, alphanumeric,
base64); a window of ``WINDOW`` characters slides over each, its character
counts are updated by the one that enters and the one that leaves, and windows
whose entropy reaches the class's threshold are hot.  The span runs from the
first to the last hot window.  Candidates are cut at the base spans, which
always stay; pieces of ``WINDOW`` characters or more are scanned, except those on
the allow-list (numbers, UUIDs, words without digits, names in lower case joined
by separators).

Everything is row-wise: no shuffle, no Python.  A null or empty text has no
spans and base_sha256 of the empty string.  Repeated rows give repeated rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.spans import by_start, cover, joined, let, no_spans, overlapping, regex_spans, replaced, running_max

KINDS = ["assign", "access", "hex", "entropy"]
MIN_SECRET = 6
WINDOW = 20
# bits of a window of 20 characters (at most log2 20 = 4.32) that count as random, by class
THRESHOLD = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}

# fixed values: the patterns of the three base kinds
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VALUE = r"[A-Za-z0-9+/_.=-]+$"

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALLOW = [
    r"^[0-9_=+/-]+$",                                                   # numbers, rules, dates
    r"^[A-Za-z_=+/-]+$",                                                # words and paths without a digit
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",            # UUIDs
    r"^[a-z]+([-_/][a-z]+)+([-_/]?[0-9]{1,4})?$",                       # slugs
    r"^(.)\1*$",                                                        # one character repeated
]


def _value_length(span) -> Column:
    """Length of the assigned value: the run of value characters after the first : or =."""
    value = F.regexp_extract(span["value"], ASSIGN, 1)
    return F.char_length(value)


def base_spans(text: Column) -> Column:
    assign = F.filter(regex_spans(text, ASSIGN, "assign"), lambda s: _value_length(s) >= MIN_SECRET)
    return F.concat(assign, regex_spans(text, ACCESS, "access"), regex_spans(text, HEX, "hex"))


def char_class(value: Column) -> Column:
    return F.when(value.rlike(r"^[0-9a-fA-F]+$"), "hex").when(value.rlike(r"^[A-Za-z0-9]+$"), "alnum") \
        .otherwise("base64")


def _term(c: Column) -> Column:
    """c * log2(c) of a count."""
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def hot_range(value: Column, threshold: Column, window: int = WINDOW) -> Column:
    """(first, last) 0-based starts of the windows of ASCII ``value`` with entropy >= threshold; first is -1 if none.

    State per step: counts as a string of 128 characters (code 32 + count at the place of the
    character's code), the sum of c*log2(c), and the hot range.  Entropy = log2(window) - sum / window.
    """
    start = F.struct(F.repeat(F.lit(" "), 128).alias("counts"), F.lit(0.0).alias("s"),
                     F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    # the codes as an array: each step reads one element, however long the value
    codes = F.transform(F.split(value, ""), F.ascii)
    return F.transform(F.array(codes), lambda a: _slide(a, start, threshold, window))[0]


def _slide(codes: Column, start: Column, threshold: Column, window: int) -> Column:
    def place(i):
        return F.get(codes, i - 1) + 1

    def count(counts, p):
        return F.ascii(F.substring(counts, p, F.lit(1))) - 32

    def put(counts, p, c):
        return F.overlay(counts, F.char(c + 32), p, F.lit(1))

    def step(acc, i):
        p_out = F.when(i > window, place(i - window)).otherwise(F.lit(128))
        c_out = F.when(i > window, count(acc["counts"], p_out)).otherwise(F.lit(1))
        less = F.when(i > window, put(acc["counts"], p_out, c_out - 1)).otherwise(acc["counts"])
        s1 = acc["s"] - _term(c_out) + _term(c_out - 1)
        p_in = place(i)
        return F.struct(less.alias("counts"), s1.alias("s"), p_in.alias("p"), count(less, p_in).alias("c"),
                        acc["first"].alias("first"), acc["last"].alias("last"))

    def fold(acc, i):
        # two lets in one step: the state after the leaving character, then after the entering one
        mid = step(acc, i)
        return F.transform(F.array(mid), lambda m: _enter(m, i, threshold, window, put))[0]

    return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, fold,
                       lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def _enter(m, i, threshold, window, put):
    s = m["s"] - _term(m["c"]) + _term(m["c"] + 1)
    hot = (i >= window) & (F.lit(math.log2(window)) - s / window >= threshold - 1e-9)
    at = (i - window).cast("int")
    return F.struct(put(m["counts"], m["p"], m["c"] + 1).alias("counts"), s.alias("s"),
                    F.when(hot & (m["first"] < 0), at).otherwise(m["first"]).alias("first"),
                    F.when(hot, at).otherwise(m["last"]).alias("last"))


def allowed(value: Column) -> Column:
    out = F.lit(False)
    for p in ALLOW:
        out = out | value.rlike(p)
    return out


def uncovered(span: Column, covered: Column, least: int = 1) -> Column:
    """The pieces of an ASCII span, of ``least`` characters or more, that no base span covers, in order."""
    def piece(p):
        return F.struct(span["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"),
                        F.substring(span["value"], p["start"] - span["start"] + 1, p["end"] - p["start"]).alias("value"))

    def gaps(over):
        # before each base span from the largest end so far, then after the last
        return let(running_max(F.transform(over, lambda b: b["end"])), lambda ends: F.transform(F.filter(
            F.concat(F.transform(over, lambda b, i: _gap(F.greatest(span["start"], F.coalesce(F.get(ends, i - 1), F.lit(0))), b["start"])),
                     F.array(_gap(F.greatest(span["start"], F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0))), span["end"]))),
            lambda p: p["end"] - p["start"] >= least), piece))

    return let(overlapping(covered, span["start"], span["end"]), gaps)


def _gap(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def entropy_spans(text: Column, base: Column, window: int = WINDOW) -> Column:
    pieces = let(cover(base), lambda c: F.flatten(F.transform(
        regex_spans(text, CANDIDATE, "entropy"), lambda s: uncovered(s, c, window))))
    found = F.filter(pieces, lambda s: (F.char_length(s["value"]) >= window) & ~allowed(s["value"]))

    def scored(s):
        kind = char_class(s["value"])
        limit = F.when(kind == "hex", THRESHOLD["hex"]).when(kind == "alnum", THRESHOLD["alnum"]) \
            .otherwise(THRESHOLD["base64"])
        return F.struct(s["start"].alias("start"), s["value"].alias("value"),
                        hot_range(s["value"], limit, window).alias("hot"))

    hot = F.filter(F.transform(found, scored), lambda s: s["hot"]["first"] >= 0)
    spans = F.transform(hot, lambda s: F.struct(
        F.lit("entropy").alias("kind"), (s["start"] + s["hot"]["first"]).cast("int").alias("start"),
        (s["start"] + s["hot"]["last"] + window).cast("int").alias("end"),
        F.substring(s["value"], s["hot"]["first"] + 1, s["hot"]["last"] - s["hot"]["first"] + window).alias("value")))
    return F.when(text.rlike(CANDIDATE), spans).otherwise(no_spans())


def find_secrets(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` in ``__doc`` plus ``__base`` and ``__added`` span arrays."""
    rows = docs.select(F.struct("*").alias("__doc"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__base", base_spans(F.col("__text")))
    return rows.withColumn("__added", entropy_spans(F.col("__text"), F.col("__base"), window))


def scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, and all spans of every document."""
    found = find_secrets(docs.select("doc_id", "text"), window)
    base, added = F.col("__base"), F.col("__added")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("__doc.doc_id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(joined(by_start(base, KINDS)), 256).alias("base_sha256"),
        joined(by_start(F.concat(base, added), KINDS)).alias("spans"))


MASK = "[SECRET]"


def redact(docs: DataFrame, window: int = WINDOW, mask: str = MASK) -> DataFrame:
    """The documents with every found span replaced by ``mask``; overlapping spans become one.

    All columns stay; ``n_chars``, where it is a whole number column, follows the new text.
    """
    found = find_secrets(docs, window)
    spans = by_start(F.concat(F.col("__base"), F.col("__added")), KINDS)
    clean = F.when(F.col("__doc.text").isNotNull(), replaced(F.col("__text"), spans, lambda s: F.lit(mask)))
    found = found.select("__doc", clean.alias("__new"))
    whole = {"tinyint", "smallint", "int", "bigint"}
    return found.select(*(
        F.col("__new").alias(c) if c == "text"
        else F.coalesce(F.char_length("__new").cast(t), F.col("__doc").getField(c)).alias(c)
        if c == "n_chars" and t in whole else F.col("__doc").getField(c).alias(c) for c, t in docs.dtypes))
