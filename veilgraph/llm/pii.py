"""Personal data: patterns, and terms that disclose a protected entity (DataFrame functions only).

Base spans are e-mail addresses, IPv4 addresses, card and phone numbers. Each value found is a protected
entity, and so is the part that it shares with others: domain, network, issuer, number without its last
four digits. Which words give an entity away is estimated from co-occurrence in the corpus: n(e) documents
have the entity, n(t) the term, n(t, e) the term within `REACH` characters of the entity. A term's
disclosure of an entity is its pointwise mutual information over the entity's information content,
log2(N n(t, e) / (n(t) n(e))) / log2(N / n(e)): 1 if the term never occurs without it. Pairs count that
chance doesn't explain: of the entity's c different contexts (copies are one), k have the term; C(c, k)
(n(t) / N)^k, bounded and multiplied by the number of pairs, must be at most `ALPHA`. So an entity of a
single context is given away only by words that spell a part of its own address. A term of disclosure
`LIMIT` or more is replaced by its prefix class ("abc*") if that class discloses less, and removed
otherwise, wherever it occurs.

Only pairs within a window are counted, so their number is linear in the text; counts are pre-aggregated.
Up to `LITERAL` terms are matched as a literal list; beyond that they are joined with their marks, without a
broadcast. Both give the same text.

Defined results: null text is empty and stays null when sanitised. Spans are code points, end exclusive.
Where spans overlap, sanitise() replaces their union once, by the first one's mark. Null ids are kept.
Other columns are carried as one struct, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.llm._common import materialize, row_id

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns; possessive, and started only where a leftmost match can start, so that they run in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that every text with a match passes.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
REACH, ALPHA, LIMIT, PREFIX = 48, 0.05, 0.95, 3
LITERAL = 4000
BLOCK = 256
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_INNER = r"0-9A-Za-z\x{80}-\x{10FFFF}"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _valid_span(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["value"])


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def match_spans(text: Column, pattern: Column | str, kind: Column) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value, kind), code points."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, p, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), m.alias("m")))

    def place(block: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            s = a["at"] + x["gap"]
            return F.struct((s + x["n"]).alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("start"), (s + x["n"]).alias("end"), x["m"].alias("value")))).alias("out"))

        return F.aggregate(block, empty, step, lambda a: a["out"])

    # Blocks keep the appending linear in texts with very many matches.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))
    starts = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, b: F.struct((a["at"] + F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["n"])).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        lambda a: a["out"],
    )
    spans = F.flatten(F.zip_with(blocks, starts, place))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), kind.alias("kind")))


_NONE = "array<struct<start:int,end:int,value:string,kind:int>>"


def base_spans(text: Column) -> Column:
    """All base spans, ordered by start and then kind (its place in KINDS)."""
    parts = []
    for i, kind in enumerate(KINDS):
        own = F.filter(match_spans(text, PATTERNS[kind], F.lit(i)), _valid_span(kind))
        some = text.contains("@") if kind == "email" else text.rlike(HINTS[kind])
        parts.append(F.when(some & text.rlike(PATTERNS[kind]), own).otherwise(F.array().cast(_NONE)).cast(_NONE))
    ordered = F.array_sort(F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))
    return ordered


def words(text: Column) -> Column:
    """All words, A-Z lower-cased."""
    return F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _SPLIT)


def terms(text: Column) -> Column:
    """Distinct words of at least three characters that aren't all digits."""
    return F.filter(F.array_distinct(words(text)), lambda w: (F.length(w) >= 3) & w.rlike("[^0-9]"))


def _stem(w: Column) -> Column:
    return F.substring(w, 1, PREFIX)


def _class_of(w: Column) -> Column:
    return F.concat(_stem(w), F.lit("*"))


def _with_classes(words: Column) -> Column:
    return F.array_distinct(F.concat(words, F.transform(words, _class_of)))


def _context(text: Column, s: Column) -> Column:
    """Whole words around a span, without what the patterns match."""
    first = F.greatest(F.lit(0), s["start"] - REACH)
    left = F.substring(text, first + 1, s["start"] - first)
    right = F.substring(text, s["end"] + 1, F.lit(REACH))
    left = F.when(first > 0, F.regexp_replace(left, rf"^[{_INNER}]+", "")).otherwise(left)
    right = F.when(F.length(right) == REACH, F.regexp_replace(right, rf"[{_INNER}]+$", "")).otherwise(right)
    out = F.concat(left, F.lit(" "), right)
    for kind in KINDS:
        out = F.regexp_replace(out, PATTERNS[kind], " ")
    return out


def _found(docs: DataFrame, keys: DataFrame, text: Column) -> DataFrame:
    """docs with __hits, which of the terms (key) the text has, and __marks, a map of theirs.

    An intersection leaves no repeats, so the words needn't be made distinct before it.
    """
    no_marks = F.create_map().cast("map<string,string>")
    empty = F.array().cast("array<string>")
    if keys.limit(LITERAL + 1).count() <= LITERAL:
        marks = {r["key"]: r["mark"] for r in keys.orderBy("key").collect()}
        out = docs.withColumn("__hits", F.array_intersect(words(text), F.lit(list(marks)).cast("array<string>")) if marks else empty)
        return out.withColumn("__marks", F.create_map(*[F.lit(x) for pair in marks.items() for x in pair]) if marks else no_marks)
    rows = materialize(docs.select("*", row_id("__row")), "documents")
    hits = rows.select("__row", F.explode(F.array_distinct(words(text))).alias("key")).join(keys, "key")
    hits = hits.groupBy("__row").agg(F.collect_set("key").alias("__hits"), F.map_from_entries(F.collect_set(F.struct("key", "mark"))).alias("__marks"))
    out = rows.join(hits, "__row", "left").withColumn("__hits", F.coalesce("__hits", empty)).drop("__row")
    return out.withColumn("__marks", F.coalesce("__marks", no_marks))


def _protected(s: Column) -> Column:
    """The entities that a span stands for: its value, and the part of it that others share."""
    low, digits, kind = F.lower(s["value"]), _digits(s["value"]), s["kind"]
    part = F.when(kind == 0, F.substring_index(low, "@", -1)).when(kind == 1, F.substring_index(low, ".", 3))
    part = part.when(kind == 2, F.substring(digits, 1, 6)).otherwise(F.regexp_replace(digits, ".{4}$", ""))
    return F.array(F.concat_ws(":", kind, F.when(kind <= 1, low).otherwise(digits)), F.concat_ws("/", kind, part))


def disclosing_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, mark): terms that disclose a protected entity, and what stands in for them."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    source = docs.select(text.alias("__text"))
    spans = source.select("__text", base_spans(F.col("__text")).alias("s")).where(F.size("s") > 0)

    def around(s: Column) -> Column:
        own = F.when(s["kind"] == 0, terms(F.substring_index(s["value"], "@", 1))).otherwise(F.array().cast("array<string>"))
        return F.struct(_protected(s).alias("e"), _context(F.col("__text"), s).alias("c"), own.alias("own"))

    seen_at = spans.select(F.monotonically_increasing_id().alias("row"), F.explode(F.transform("s", around)).alias("x"))
    near = seen_at.select("row", F.xxhash64("x.c").alias("h"), terms(F.col("x.c")).alias("w"), F.explode("x.e").alias("e"), F.col("x.own").alias("own"))
    near = materialize(near, "contexts")
    contexts = near.groupBy("e", "h").agg(F.count("*").alias("n")).groupBy("e").agg(F.count("*").alias("c"))
    entities = near.select("row", "e").distinct().groupBy("e").agg(F.count("*").alias("n_e")).join(contexts, "e")
    spelled = near.where(F.arrays_overlap("own", "w")).select("row", "e", "h", F.explode(_with_classes(F.array_intersect("own", "w"))).alias("key"), F.lit(True).alias("spelled"))
    several = near.join(entities.where("c > 1").select("e"), "e").select("row", "e", "h", F.explode(_with_classes(F.col("w"))).alias("key"), F.lit(False).alias("spelled"))
    once = several.unionByName(spelled).groupBy("e", "key", "row").agg(F.min("h").alias("h"), F.max("spelled").alias("spelled"))
    alike = once.groupBy("e", "key", "h").agg(F.count("*").alias("n"), F.max("spelled").alias("spelled"))
    counted = alike.groupBy("e", "key").agg(F.sum("n").alias("n_te"), F.count("*").alias("k"), F.max("spelled").alias("spelled"))
    counted = materialize(counted.where("k > 1 OR spelled").join(entities, "e"), "pairs")

    keys = counted.select("key").distinct()
    every = source.select(F.explode(_with_classes(terms(F.col("__text")))).alias("key")).groupBy("key").agg(F.count("*").alias("n_t"))
    seen = every.join(keys, "key")
    n, n_pairs = docs.count(), counted.count()
    ic = F.log2(F.lit(float(n)) / F.col("n_e"))
    value = F.log2(F.lit(float(n)) * F.col("n_te") / (F.col("n_t").cast("double") * F.col("n_e")))
    # C(c, k) <= (c e / k)^k.
    chance = F.col("k") * F.log2(F.col("c") * F.lit(math.e) * F.col("n_t") / (F.col("k") * F.lit(float(n)))) + F.log2(F.lit(float(n_pairs)))
    proven = F.col("spelled") | ((F.col("k") > 1) & (chance <= math.log2(ALPHA)))
    worst = counted.join(seen, "key").where((ic > 0) & proven).groupBy("key").agg(F.max(value / ic).alias("disclosure"))
    risky = materialize(worst.where(F.col("disclosure") >= LIMIT).select("key"), "risky")
    classes = risky.select(F.col("key").alias("class"))
    found = risky.where(~F.col("key").endswith("*")).select(F.col("key").alias("term"), _class_of(F.col("key")).alias("own"))
    marked = found.join(classes, F.col("own") == F.col("class"), "left")
    return marked.select("term", F.when(F.col("class").isNull(), F.col("own")).otherwise("[removed]").alias("mark"))


def _term_spans(text: Column, hits: Column) -> Column:
    pattern = F.concat(F.lit(rf"(?i)(?<![{_INNER}])(?:"), F.array_join(hits, "|"), F.lit(rf")(?![{_INNER}])"))
    return F.when(F.size(hits) > 0, match_spans(text, pattern, F.lit(len(KINDS)))).otherwise(F.array().cast(_NONE)).cast(_NONE)


def _annotated(docs: DataFrame, risky: DataFrame, text_col: str) -> DataFrame:
    """docs as __in, __text, __base, __terms (spans of disclosing terms outside base spans) and __marks (of the terms)."""
    rows = docs.select(F.struct("*").alias("__in"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    rows = _found(rows, risky.select(F.col("term").alias("key"), "mark"), F.col("__text"))
    rows = rows.withColumn("__base", base_spans(F.col("__text")))
    outside = F.filter(_term_spans(F.col("__text"), F.col("__hits")), lambda t: ~F.exists("__base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return rows.withColumn("__terms", F.transform(outside, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms."""
    risky = materialize(disclosing_terms(docs, text_col), "terms")
    rows = _annotated(docs.select(*dict.fromkeys([id_col, text_col])), risky, text_col)
    counts = [F.size(F.filter("__base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select(
        F.col("__in")[id_col].alias(id_col),
        *counts,
        F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("__base", "__terms"))).alias("spans"),
        F.size("__terms").cast("long").alias("n_terms"),
    )


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data and disclosing terms replaced in the text; other columns as they are."""
    risky = materialize(disclosing_terms(docs, text_col), "terms")
    rows = _annotated(docs, risky, text_col)
    marks = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    low = lambda s: F.translate(s["value"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    mark = lambda s: F.coalesce(F.get(marks, s["kind"]), F.try_element_at(F.col("__marks"), low(s)), F.lit("[removed]"))
    kind = "array<struct<start:int,end:int,mark:string>>"
    ordered = F.transform(F.array_sort(F.concat("__base", "__terms")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), mark(s).alias("mark")))

    def join(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["mark"].alias("mark"))
        return F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] > s["start"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(grown))).otherwise(F.concat(a, F.array(s)))

    rows = rows.withColumn("__cut", F.aggregate(ordered, F.array().cast(kind), join))
    pieces = F.transform(
        "__cut",
        lambda s, i: F.concat(
            F.substring(F.col("__text"), F.coalesce(F.get("__cut", i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get("__cut", i - 1)["end"], F.lit(0))),
            s["mark"],
        ),
    )
    tail = F.substring(F.col("__text"), F.element_at("__cut", -1)["end"] + 1, F.length("__text"))
    clean = F.when(F.size("__cut") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("__in")[text_col])
    return rows.select(*[(clean if c == text_col else F.col("__in")[c]).alias(c) for c in docs.columns])
