"""PII: information-theoretic sanitisation, JVM expressions only.

Base spans are e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone
numbers; each distinct value is a protected entity.  Corpus co-occurrence over
distinct whole texts (exact copies count once) then tells how strongly a term
reveals an entity: with n(t) texts that hold term t and n(t,e) that hold t and
entity e, the posterior is P(e|t) = n(t,e) / n(t) and -log2 P(e|t) is what is left
to guess.  At most ``REMOVE_BITS`` left: the term is removed; at most
``GENERALISE_BITS``: it is generalised; both wherever it stands, outside the base
spans, in a text that holds the entity.  A term needs ``SUPPORT`` texts with the
entity, or all of them where the entity stands in fewer, so that entities of one or
two texts are covered too.

Entities that stand in the same texts have the same statistics and are counted as
one class, so a text of many addresses found nowhere else adds one.  Only terms rare
enough to reveal an entity of a text (n(t) <= n(e) * 2^GENERALISE_BITS) meet its
classes.  Counts combine on the map side; joins are on a term, an entity, a class
and term, or a text key (MD5), where Spark splits hot keys at run time.

Patterns never cross a line end.  Null and empty texts have no spans; repeated rows
give repeated rows with equal results.  A word that overlaps a base span is no term to
mark, but counts as a word of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import written
from tabloom.llm.spans import by_kind, cover, joined, let, no_spans, regex_spans, replaced, touched

KINDS = ["email", "ip", "card", "phone", "remove", "generalise"]
SUPPORT = 3
REMOVE_BITS = 1.0
GENERALISE_BITS = 3.0

# fixed values: the four base patterns.  A match can begin only where a run of its first
# characters begins or the last match ended; possessive loops keep long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{3,}"
# terms in more texts than this are too many to list for a broadcast
FREQUENT = 200_000


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    codes = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(codes, lambda d, i: F.when(i % 2 == 0, d).otherwise(
        F.when(d > 4, d * 2 - 9).otherwise(d * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Base spans of a text, kind by kind, each in order."""
    def ip_ok(s):
        return F.forall(F.split(s["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(
            "^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))

    def card_ok(s):
        d = _digits(s["value"])
        return F.char_length(d).between(13, 19) & luhn(d)

    return F.concat(
        regex_spans(text, EMAIL, "email"),
        F.filter(regex_spans(text, IP, "ip"), ip_ok),
        F.filter(regex_spans(text, CARD, "card"), card_ok),
        F.filter(regex_spans(text, PHONE, "phone"), lambda s: F.char_length(_digits(s["value"])).between(9, 15)))


def entity(kind: Column, value: Column) -> Column:
    """Name of the protected entity: one for all spellings of a value."""
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def _found(docs: DataFrame, keep: Column) -> DataFrame:
    """kept, spans and, where there are any, the text and its key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(keep.alias("kept"), text.alias("text"))
    rows = rows.withColumn("spans", F.when(F.col("text").rlike(f"{EMAIL}|{IP}|{CARD}|{PHONE}"),
                                           base_spans(F.col("text"))).otherwise(no_spans()))
    held = F.size("spans") > 0
    return rows.select("kept", "spans", F.when(held, F.md5("text")).alias("copy"), F.when(held, F.col("text")).alias("text"))


def distinct_terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"\P{L}+")), lambda t: F.char_length(t) >= 3)


def term_texts(docs: DataFrame) -> DataFrame:
    """(term, texts): in how many distinct texts each term stands."""
    return docs.select("text").where(F.col("text").isNotNull()).distinct() \
        .select(F.explode(distinct_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("texts"))


def entity_classes(texts: DataFrame) -> DataFrame:
    """(copy, class, held): the classes of entities of each text; ``held``: the texts that hold them.

    A class is named by its smallest entity.
    """
    pairs = texts.select("copy", F.explode(F.array_distinct(F.transform(
        "spans", lambda s: entity(s["kind"], s["value"])))).alias("entity"))
    # the set of an entity's texts, by two hashes that do not depend on their order
    sets = pairs.groupBy("entity").agg(
        F.count("*").alias("held"), F.bit_xor(F.xxhash64("copy")).alias("a"), F.bit_xor(F.xxhash64("copy", F.lit(1))).alias("b"))
    names = sets.groupBy("held", "a", "b").agg(F.min("entity").alias("entity"))
    return pairs.join(names, "entity").select("copy", F.col("entity").alias("class"), "held")


def disclosing(texts: DataFrame, docs: DataFrame, support: int = SUPPORT, remove_bits: float = REMOVE_BITS,
               generalise_bits: float = GENERALISE_BITS) -> DataFrame:
    """(copy, term, kind): the terms of each text that reveal an entity it holds beyond a threshold."""
    classes = entity_classes(texts)
    widest = classes.agg(F.max("held")).first()[0]
    if widest is None:
        return classes.select("copy", F.col("class").alias("term"), F.col("class").alias("kind")).limit(0)
    reach = 2.0 ** generalise_bits
    counts = written(term_texts(docs), "term-texts")
    terms = texts.select("copy", F.explode(distinct_terms(F.col("text"))).alias("term"))
    # words too frequent to reveal any entity stand in most texts: where their list is short, they leave before the join
    often = counts.where(F.col("texts") > max(reach * widest, 1000)).select("term")
    if often.count() <= FREQUENT:
        terms = terms.join(F.broadcast(often), "term", "left_anti")
    rare = terms.join(counts.where(F.col("texts") <= reach * widest), "term")
    met = rare.join(classes, "copy").where(F.col("texts") <= reach * F.col("held")) \
        .select("copy", "class", "term", "held", "texts")
    left = F.log2(F.col("texts") / F.col("both"))
    found = met.groupBy("class", "term").agg(F.count("*").alias("both"), F.first("held").alias("held"), F.first("texts").alias("texts")) \
        .where((F.col("both") >= F.least(F.lit(support), "held")) & (left <= generalise_bits)).select(
            "class", "term", F.when(left <= remove_bits, "remove").otherwise("generalise").alias("kind"))
    # a word that reveals two entities keeps the stronger measure: "remove" sorts after "generalise"
    return met.join(found, ["class", "term"]).groupBy("copy", "term").agg(F.max("kind").alias("kind"))


def added_spans(text: Column, base: Column, kinds: Column) -> Column:
    """Spans of the words of ``kinds`` (term -> kind) outside the base spans, in order."""
    return let(cover(base), lambda c: F.transform(
        F.filter(regex_spans(text, TERM, "term"), lambda w: F.map_contains_key(kinds, F.lower(w["value"]))
                 & ~touched(c, w["start"], w["end"])),
        lambda w: F.struct(F.element_at(kinds, F.lower(w["value"])).alias("kind"), w["start"].alias("start"),
                           w["end"].alias("end"), w["value"].alias("value"))))


def find(docs: DataFrame, keep: Column, support: int = SUPPORT, remove_bits: float = REMOVE_BITS,
         generalise_bits: float = GENERALISE_BITS) -> DataFrame:
    """``kept``, base ``spans`` and ``added`` spans of every document."""
    found = written(_found(docs, keep), "entities")
    held = found.where("copy is not null")
    # rows with equal text have equal spans
    texts = written(held.select("copy", "spans", "text").dropDuplicates(["copy"]), "entity-texts")
    kinds = disclosing(texts, docs, support, remove_bits, generalise_bits) \
        .groupBy("copy").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds"))
    added = texts.join(kinds, "copy").select("copy", added_spans(F.col("text"), F.col("spans"), F.col("kinds")).alias("added"))
    # documents without entities have no key and take no part in the join
    return found.where("copy is null").select("kept", "spans", no_spans().alias("added")).unionByName(
        held.select("kept", "spans", "copy").join(added, "copy", "left").select(
            "kept", "spans", F.coalesce("added", no_spans()).alias("added")))


def scan(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans of every document."""
    got = find(docs, F.col("doc_id"), support)

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return got.select(F.col("kept").alias("doc_id"), *(count(k) for k in KINDS[:4]),
                      F.sha2(joined(by_kind(F.col("spans"), KINDS)), 256).alias("base_sha256"),
                      joined(by_kind(F.concat("spans", "added"), KINDS)).alias("spans"))


def sanitise(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """The documents with entities replaced by their kind, disclosing terms by [TERM] or nothing.

    All columns stay; ``n_chars``, where it is a whole number column, follows the new text.
    """
    rows = find(docs, F.struct("*"), support)

    def mask(s):
        return F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", "[TERM]").otherwise(
            F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    order = F.array_sort(F.transform(F.concat("spans", "added"), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = rows.select(F.col("kept").alias("__doc"), replaced(F.col("kept.text"), order, mask).alias("__new"))
    whole = {"tinyint", "smallint", "int", "bigint"}
    return out.select(*(
        F.col("__new").alias(c) if c == "text"
        else F.coalesce(F.char_length("__new").cast(t), F.col("__doc").getField(c)).alias(c)
        if c == "n_chars" and t in whole else F.col("__doc").getField(c).alias(c) for c, t in docs.dtypes))
