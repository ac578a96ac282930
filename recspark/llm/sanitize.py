"""Personal data in texts, and terms that give it away, with column expressions alone.

Method: information-theoretic sanitisation. Protected entities are the email addresses, IP addresses, card and phone
numbers that fixed patterns find (the base spans). How strongly a term reveals an entity is estimated from the
corpus: with ``n`` the number of distinct lines, ``PMI(c; t) = log(n_ct n / (n_c n_t))`` is what the term tells about
the entity, and ``IC(c) = log(n / n_c)`` is all there is to tell. ``n_c`` and ``n_t`` are the distinct lines of the whole
corpus that hold the entity or the term, ``n_ct`` those in which the term stands within ``REACH`` code points of
the entity. A term discloses an entity if ``PMI >= DISCLOSURE * IC`` and ``n_ct >= LEAST_LINES``: from fewer lines
nothing can be estimated, as every rare word of a single line would tell all. Lines that copies share count once.

A term is a longest run of letters and digits, A-Z lower-cased. A disclosing term is generalised to its first
``GENERAL`` code points and ``*`` if that class of terms, measured alike, discloses nothing; else it is removed. Both
are spans of kind ``term`` wherever the term stands in any text, unless they overlap a base span. Base spans stay.

The corpus is shuffled once, as distinct lines; terms are counted before they meet the candidates, so a frequent
word is one row for each task. The tables of candidates, disclosing terms and marked texts are written and
joined by Spark's choice for their size. Nothing reaches the driver, and no Python runs on rows.

A null or empty text has no spans; long texts are searched whole. Rows that repeat an id keep a row each, as spans
depend on the text alone. An empty table gives no rows. Other columns are ignored. Matches of one kind never
overlap; those of different kinds may. Positions are summed match by match in an array, so a text's cost has a part that
grows with the square of its number of matches, 16 bytes a step.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.session import materialize

REACH, LEAST_LINES, DISCLOSURE, GENERAL = 120, 3, 0.95, 3

#: Kinds in their order. Patterns match what the plain forms match: a look behind keeps a search from starting
#: again inside a run that has failed, and possessive repeats keep none of the ways back, of which there are none.
KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?+"
_WORD = r"[\p{L}\p{N}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: int, span: Column) -> Column:
    value = span["value"]
    if KINDS[kind] == "ip":
        return value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    n = F.length(_digits(value))
    if KINDS[kind] == "card":
        return (n >= 14) & (n <= 19) & F.call_function("luhn_check", _digits(value))
    return (n >= 10) & (n <= 15) if KINDS[kind] == "phone" else F.lit(True)


def _placed(found: Column, pieces: Column, kind: int) -> Column:
    """Spans of matches, from the matches and the pieces of text around them."""
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        return F.struct((start + F.length(x["m"])).alias("at"), F.concat(acc["starts"], F.array(start)).alias("starts"))

    def span(start: Column, m: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"), m.alias("value"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("m")))
    starts = F.aggregate(pairs, nothing, step, lambda acc: acc["starts"])
    return F.when(F.size(found) > 0, F.zip_with(starts, found, span)).otherwise(F.array().cast(_SPAN))


def with_base_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base``: ``start, kind, end, value`` of the patterns' valid matches, by start and kind."""
    found = [f"_found{k}" for k in range(len(KINDS))]
    matched = rows.withColumns({f: F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(p), F.lit(0)) for f, p in zip(found, PATTERNS, strict=True)})
    each = []
    for k, (f, p) in enumerate(zip(found, PATTERNS, strict=True)):
        spans = _placed(F.col(f), F.split(F.col(text), p, -1), k)
        each.append(F.filter(spans, partial(_valid, k)))
    return matched.withColumn("base", F.array_sort(F.concat(*each))).drop(*found)


def _lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(_lowered(text), F.lit(_WORD), F.lit(0))


def _class(term: Column) -> Column:
    return F.concat(F.substring(term, 1, GENERAL), F.lit("*"))


def _entity(span: Column) -> Column:
    """A name that the spellings of an entity share."""
    value = F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"] == 1, span["value"]).otherwise(_digits(span["value"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), value)


def _around(line: Column, span: Column) -> Column:
    """The line within reach of a span; a term that the reach cuts is left out."""
    before = F.greatest(span["start"] - REACH, F.lit(0))
    left = F.substring(line, before + 1, span["start"] - before)
    left = F.when(before > 0, F.regexp_replace(left, f"^{_WORD}", "")).otherwise(left)
    right = F.substring(line, span["end"] + 1, F.lit(REACH))
    right = F.when(F.length(line) > span["end"] + REACH, F.regexp_replace(right, f"{_WORD}$", "")).otherwise(right)
    return F.concat(left, F.lit("\n"), right)


def distinct_lines(docs: DataFrame) -> DataFrame:
    """``line``: the corpus as lines, each one once; blank ones are left out."""
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).distinct()


_MARK = "\x01"


def shared_lines(docs: DataFrame, least: int) -> DataFrame:
    """``entity, key, both``: distinct lines with an entity and a term or class near it, at least ``least``.

    The empty key counts the lines of the entity itself.
    """
    lines = distinct_lines(docs.where(F.col("text").rlike("@|[0-9]")).select("text")).where(F.col("line").rlike("@|[0-9]{2}|[0-9][\\x20.-][0-9]"))
    found = with_base_spans(lines, "line").where(F.size("base") > 0)

    def keys(span: Column) -> Column:
        near = _terms(_around(F.col("line"), span))
        every = F.concat(near, F.transform(near, _class), F.array(F.lit("")))
        return F.transform(every, lambda k: F.concat(_entity(span), F.lit(_MARK), k))

    # strings, as equal structs in an array are found pair by pair
    pairs = found.select(F.explode(F.array_distinct(F.flatten(F.transform("base", keys)))).alias("pair"))
    split = F.split("pair", _MARK, 2)
    counted = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= least)
    return counted.select(split[0].alias("entity"), split[1].alias("key"), "both")


def key_lines(docs: DataFrame) -> DataFrame:
    """``key, n``: distinct lines that hold each term and class; the empty key counts all lines."""
    terms = _terms(F.col("line"))
    every = F.array_distinct(F.concat(F.col("terms"), F.transform("terms", _class), F.array(F.lit(""))))
    keys = distinct_lines(docs).select(terms.alias("terms")).select(F.explode(every).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def disclosing_terms(docs: DataFrame, least: int = LEAST_LINES, disclosure: float = DISCLOSURE) -> DataFrame:
    """``term, instead``: terms that disclose an entity, and what stands for them (empty: they are removed)."""
    shared = materialize(shared_lines(docs, least), "shared-lines")
    wanted = shared.select("key").unionByName(shared.sparkSession.range(1).select(F.lit("").alias("key"))).distinct()
    counts = materialize(key_lines(docs).join(wanted, "key"), "key-lines")
    of_entity = shared.where("key = ''").select("entity", F.col("both").alias("own"))
    total = counts.where("key = ''").select(F.col("n").alias("total"))
    known = shared.where("key <> ''").join(of_entity, "entity").join(counts, "key")
    # a scalar subquery of one row
    n = total.scalar()
    told = F.log(F.col("both").cast("double") * n / (F.col("own").cast("double") * F.col("n")))
    all_ = F.log(n / F.col("own").cast("double"))
    telling = materialize(known.where((F.col("own") < n) & (told >= disclosure * all_)).select("key").distinct(), "telling")
    classes = telling.where("key like '%*'").select(F.col("key").alias("class"), F.lit(True).alias("tells"))
    terms = telling.where("key not like '%*'").select(F.col("key").alias("term"), _class(F.col("key")).alias("class"))
    kept = F.col("tells").isNull() & (F.length("term") > GENERAL)
    return terms.join(classes, "class", "left").select("term", F.when(kept, F.col("class")).otherwise(F.lit("")).alias("instead"))


def marked_texts(docs: DataFrame, telling: DataFrame) -> DataFrame:
    """``digest, pattern, instead``: for each distinct text with disclosing terms, a pattern of them and what stands for each."""
    words = docs.select(F.md5("text").alias("digest"), F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    hits = words.join(telling, "term").groupBy("digest").agg(F.collect_set(F.struct("term", "instead")).alias("hits"))
    # terms are letters and digits, so they stand for themselves in a pattern
    any_of = F.array_join(F.array_sort(F.transform("hits", lambda h: h["term"])), "|")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), any_of, F.lit(r")(?![\p{L}\p{N}])"))
    return hits.select("digest", pattern.alias("pattern"), F.map_from_entries("hits").alias("instead"))


def sanitized(docs: DataFrame, least: int = LEAST_LINES, disclosure: float = DISCLOSURE) -> DataFrame:
    """``doc_id, text, base, terms, sanitized`` of each row: spans of entities and of disclosing terms, and the text without them.

    Entities give way to their kind in brackets, generalised terms to their class, removed ones to nothing.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    there = texts.where("text is not null").select("text")
    telling = materialize(disclosing_terms(there, least, disclosure), "disclosing-terms")
    marked = materialize(marked_texts(there, telling), "marked-texts")
    rows = with_base_spans(texts.withColumn("digest", F.md5("text")).join(marked, "digest", "left"))
    low = _lowered(F.col("text"))
    rows = rows.withColumn("_hits", F.when(F.col("pattern").isNotNull(), F.regexp_extract_all(low, F.col("pattern"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    spans = _placed(F.col("_hits"), F.split(low, F.col("pattern"), -1), TERM)
    free = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    rows = rows.withColumn("terms", F.filter(spans, free))
    return rows.withColumn("sanitized", _without(F.col("text"), F.array_sort(F.concat("base", "terms")), F.col("instead"))).select(
        "doc_id", "text", "base", "terms", "sanitized"
    )


def _without(text: Column, spans: Column, instead: Column) -> Column:
    """The text with what stands for each span; of overlapping spans the first one's name stays."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.when(s["kind"] < TERM, F.element_at(names, F.least(s["kind"] + 1, F.lit(TERM)))).otherwise(F.element_at(instead, s["value"]))
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.concat(acc["out"], gap, F.when(s["start"] >= acc["at"], new).otherwise(F.lit("")))
        return F.when(s["end"] > acc["at"], F.struct(s["end"].alias("at"), out.alias("out"))).otherwise(acc)

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas, in their order."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digest(rows: DataFrame) -> DataFrame:
    """Counts and positions of the spans of rows of `sanitized`."""
    is_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = F.array_sort(F.concat("base", "terms"))
    return rows.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(every).alias("spans"))
