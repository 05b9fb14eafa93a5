"""Span algebra and segmentation of transcripts(doc_id, text). Offsets are code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions import vocab as V
from veilgraph.functions.spans import cut, regex_spans

SPAN = "array<struct<start:int,end:int>>"


def resolve_overlaps(detections: DataFrame) -> DataFrame:
    """Greedy: longest, then best score (missing: 0), then first; keep what is disjoint from all kept before."""
    cols = [c for c in detections.columns if c != "doc_id"]
    order = F.struct((F.col("start") - F.col("end")).alias("k0"), (-F.coalesce("score", F.lit(0.0))).alias("k1"), F.col("start").alias("k2"), F.struct(*cols).alias("row"))
    ranked = detections.groupBy("doc_id").agg(F.sort_array(F.collect_list(order)).alias("all"))
    kind = ranked.schema["all"].dataType.simpleString()

    def keep(kept: Column, x: Column) -> Column:
        hit = F.exists(kept, lambda k: (k["row"]["start"] < x["row"]["end"]) & (x["row"]["start"] < k["row"]["end"]))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(x)))

    kept = ranked.select("doc_id", F.explode(F.aggregate("all", F.array().cast(kind), keep)).alias("x"))
    return kept.select("doc_id", "x.row.*")


def number_mentions(detections: DataFrame) -> DataFrame:
    """<doc>_m0000 in order of start."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end")) - 1
    return detections.withColumn("mention_id", F.format_string("%s_m%04d", "doc_id", n))


def _ends_sentence(word: Column, run: Column) -> Column:
    """Whether a run of terminators in an unspaced word ends a sentence: not after an abbreviation, an initial or inside a number."""
    stem = F.substring(word, F.greatest(F.lit(1), run["start"] - 39), F.least(run["start"], F.lit(40)))
    following = F.substring(word, run["end"] + 1, F.lit(1))
    letters = F.lower(F.regexp_extract(stem, r"[A-Za-z][A-Za-z&'.]*$", 0))
    initials = F.split(letters, r"\.")
    abbreviated = F.array_contains(F.array(*map(F.lit, V.ABBREVIATIONS)), letters) | ((letters != "") & F.forall(initials, lambda x: F.length(x) == 1))
    in_number = (F.length(run["value"]) == 1) & F.right(stem, F.lit(1)).between("0", "9") & following.between("0", "9")
    marks = F.regexp_replace(run["value"], "[^.?!]", "")
    return marks.contains("?") | marks.contains("!") | ((marks == ".") & ~in_number & ~abbreviated)


def sentences(transcripts: DataFrame) -> DataFrame:
    """(doc_id, sent_ix, start, end) tiling each text.

    Sentences end at runs of terminators that neither abbreviate nor sit in a number, closers absorbed. Each
    unspaced word with a terminator is a row of its own, so the work is linear in the text.
    """
    rows = transcripts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = rows.select("doc_id", F.length("text").alias("n"), F.explode(regex_spans(F.col("text"), r"(?<!\S)[^\s.?!]*+[.?!]\S*")).alias("w"))
    runs = words.select("doc_id", "n", "w", F.explode(regex_spans(F.col("w.value"), "[.?!]+[\"'”’)\\]]*")).alias("x"))
    inner = runs.where(_ends_sentence(F.col("w.value"), F.col("x"))).select("doc_id", "n", (F.col("w.start") + F.col("x.end")).alias("end")).where("end < n")
    w = Window.partitionBy("doc_id").orderBy("end")
    every = inner.unionByName(rows.select("doc_id", F.length("text").alias("n"), F.length("text").alias("end")).where("n > 0"))
    return every.select("doc_id", (F.row_number().over(w) - 1).alias("sent_ix"), F.lag("end", 1, 0).over(w).alias("start"), "end")


LABEL = r"(?m)^[ \t]*[A-Z][A-Za-z.'’\-]*(?:[ \t]+[A-Z0-9#][A-Za-z0-9.'’\-]*){0,3}[ \t]*:[ \t]*"


def label_key(label: Column) -> Column:
    """'SPEAKER #2:' to 'speaker'."""
    low = F.lower(F.regexp_replace(F.trim(label), r"[.:]+$", ""))
    return F.trim(F.regexp_replace(low, r"(?:[\s_\-]+|\s*#\s*)(?:\d+|ii?i?)$", ""))


def turns(transcripts: DataFrame) -> DataFrame:
    """(doc_id, turn_ix, start, body, end, label, role) tiling each text; body is where the label ends."""
    rows = transcripts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.length("text").alias("n"), regex_spans(F.col("text"), LABEL).alias("labels"))
    lead = F.when((F.size("labels") == 0) | (F.get("labels", F.lit(0))["start"] > 0), F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value")))).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
    all_ = rows.where("n > 0").select("doc_id", "n", F.concat(lead, "labels").alias("all"))
    ends = F.transform(F.sequence(F.lit(1), F.size("all")), lambda i: F.coalesce(F.get("all", i)["start"], F.col("n")))
    parts = all_.select("doc_id", F.posexplode(F.arrays_zip(F.col("all").alias("l"), ends.alias("e"))).alias("turn_ix", "x"))
    parts = parts.select("doc_id", "turn_ix", F.col("x.l.start").alias("start"), F.col("x.l.end").alias("body"), F.col("x.e").alias("end"), F.regexp_replace(F.trim("x.l.value"), r"[ \t]*:$", "").alias("label"))
    key = label_key(F.col("label"))
    known = F.max(key.isin(*V.SUBJECT_WORDS)).over(Window.partitionBy("doc_id"))
    role = F.when(F.col("label") == "", "unknown").when(key.isin(*V.INTERVIEWER_WORDS), "interviewer").when(key.isin(*V.SUBJECT_WORDS), "subject").when(known, "other").otherwise("subject")
    return parts.withColumn("role", role)


def subject_mask(transcripts: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """(doc_id, text) of the same length, NUL outside what the subject (or nobody known) says, labels too."""
    parts = turn_rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "body", "end", "role"))).alias("parts"))
    text = F.coalesce("text", F.lit(""))

    def show(p: Column) -> Column:
        spoken = p["role"].isin("subject", "unknown")
        return F.when(spoken, F.concat(F.repeat(F.lit("\0"), p["body"] - p["start"]), cut(text, p["body"], p["end"]))).otherwise(F.repeat(F.lit("\0"), p["end"] - p["start"]))

    joined = transcripts.select("doc_id", "text").join(parts, "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.array_join(F.transform("parts", show), ""), text).alias("text"))


def as_of(points: DataFrame, rows: DataFrame, pos: str, at: str, carry: list[str]) -> DataFrame:
    """points with the carried columns of the row of their document that begins last at or before pos (NULL without one).

    A union and a window: linear in the document, whatever the number of points and rows.
    """
    kept = [c for c in points.columns if c not in carry]
    left = points.select("doc_id", F.col(pos).alias("__pos"), F.lit(1).alias("__kind"), F.struct(*kept).alias("__point"))
    right = rows.select("doc_id", F.col(at).alias("__pos"), F.lit(0).alias("__kind"), F.struct(*carry).alias("__row"))
    w = Window.partitionBy("doc_id").orderBy("__pos", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("__row", F.last("__row", ignorenulls=True).over(w))
    return both.where("__kind = 1").select("__point.*", *[F.col("__row")[c].alias(c) for c in carry])


def at_position(points: DataFrame, tiles: DataFrame, pos: str, ix: str) -> DataFrame:
    """points with the index of the tile that holds pos; beyond the end, the last tile."""
    return as_of(points, tiles, pos, "start", [ix])


def clipped_sentences(sentence_rows: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """Sentences cut at the borders of turns, with the next one in the same turn."""
    t = turn_rows.select("doc_id", "turn_ix", F.col("body").alias("ts"), F.col("end").alias("te"), "role")
    both = sentence_rows.join(t, "doc_id").where("start < te AND ts < end")
    out = both.select("doc_id", "turn_ix", "sent_ix", "role", F.greatest("start", "ts").alias("start"), F.least("end", "te").alias("end")).where("start < end")
    w = Window.partitionBy("doc_id", "turn_ix").orderBy("start")
    return out.withColumn("next_start", F.lead("start").over(w)).withColumn("next_end", F.lead("end").over(w))


def pack_windows(sentence_rows: DataFrame, budget: int = 4000) -> DataFrame:
    """(doc_id, window_ix, start, end): consecutive sentences up to the budget; a longer one is alone."""
    rows = sentence_rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))

    def add(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        fits = (F.size(out) > 0) & (x["end"] - F.try_element_at(out, F.lit(-1))["start"] <= budget)
        grown = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), x["end"].alias("end"))))
        return F.when(fits, grown).otherwise(F.concat(out, F.array(x)))

    packed = rows.select("doc_id", F.posexplode(F.aggregate("s", F.array().cast(SPAN), add)).alias("window_ix", "x"))
    return packed.select("doc_id", "window_ix", F.col("x.start").alias("start"), F.col("x.end").alias("end"))


def merge_spans(spans: Column) -> Column:
    """Sorted spans, overlapping or touching ones joined."""

    def add(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        grown = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (last["end"] >= x["start"]), grown).otherwise(F.concat(out, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPAN), add)


def snippets(mentions: DataFrame, transcripts: DataFrame, sentence_rows: DataFrame, radius: int = 160, most: int = 3, budget: int = 6000) -> DataFrame:
    """(doc_id, entity_id, context): surroundings of the first mentions, widened to sentences, joined with '...'."""
    w = Window.partitionBy("doc_id", "entity_id").orderBy("start")
    first = mentions.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    s = sentence_rows.select("doc_id", F.col("start").alias("ss"), F.col("end").alias("se"))
    wide = first.join(s, "doc_id").where(f"ss < end + {radius} AND se > start - {radius}").groupBy("doc_id", "entity_id", "mention_id").agg(F.min("ss").alias("start"), F.max("se").alias("end"))
    rows = wide.groupBy("doc_id", "entity_id").agg(merge_spans(F.collect_list(F.struct("start", "end"))).alias("spans")).join(transcripts.select("doc_id", "text"), "doc_id")
    context = F.concat(F.lit("..."), F.array_join(F.transform("spans", lambda x: F.trim(cut(F.col("text"), x["start"], x["end"]))), " ... "), F.lit("..."))
    return rows.select("doc_id", "entity_id", F.left(context, F.lit(budget)).alias("context"))


def tag_spans(text: Column, spans: Column) -> Column:
    """Put [tag ...] around spans (start, end, tag) that are sorted and disjoint."""
    before = F.transform(spans, lambda s, i: F.concat(cut(text, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), s["start"]), F.lit("["), s["tag"], F.lit(" "), cut(text, s["start"], s["end"]), F.lit("]")))
    tail = cut(text, F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0)), F.length(text))
    return F.concat(F.array_join(before, ""), tail)


def blank_spans(text: Column, spans: Column) -> Column:
    """NUL over sorted disjoint spans (start, end)."""
    parts = F.transform(spans, lambda s, i: F.concat(cut(text, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), s["start"]), F.repeat(F.lit("\0"), s["end"] - s["start"])))
    return F.concat(F.array_join(parts, ""), cut(text, F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0)), F.length(text)))


def excerpt(text: Column, head: int = 2600, tail: int = 1400) -> Column:
    """The text, or its head and tail where it is longer than both."""
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit("\n[...]\n"), F.right(text, F.lit(tail))))


def speaker_ranking(turn_rows: DataFrame) -> DataFrame:
    """(doc_id, label, chars, rank) of named subject labels by how much they say."""
    own = turn_rows.where((F.col("role") == "subject") & ~label_key(F.col("label")).isin(*V.SUBJECT_WORDS))
    sums = own.groupBy("doc_id", "label").agg(F.sum(F.col("end") - F.col("start")).alias("chars"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("chars"), "label")))


def find_forms(transcripts: DataFrame, forms: DataFrame) -> DataFrame:
    """Perfect detections of forms(doc_id, form, entity_type): every letter-bounded occurrence."""
    rows = transcripts.join(forms, "doc_id")
    rx = F.concat(F.lit(r"(?<![A-Za-z])\Q"), F.col("form"), F.lit(r"\E(?![A-Za-z])"))
    gaps = F.split(F.col("text"), rx, -1)
    step = F.length("form")
    starts = F.transform(F.sequence(F.lit(1), F.size(gaps) - 1), lambda i: F.aggregate(F.slice(gaps, F.lit(1), i), F.lit(0), lambda a, g: a + F.length(g)) + (i - 1) * step)
    found = rows.select("doc_id", "entity_type", "form", step.alias("n"), F.explode(F.when(F.size(gaps) > 1, starts)).alias("start"))
    return found.select("doc_id", "start", (F.col("start") + F.col("n")).alias("end"), "entity_type", F.lit(1.0).alias("score"), F.col("form").alias("text"), F.lit("gold").alias("recognizer"))


def validate_detections(detections: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Detections whose span does not read as their text, or whose label is unknown, with the reason."""
    rows = detections.join(transcripts.select("doc_id", F.col("text").alias("__text")), "doc_id", "left")
    bad_text = ~cut(F.col("__text"), F.col("start"), F.col("end")).eqNullSafe(F.col("text"))
    reason = F.when(F.col("__text").isNull(), "no transcript").when(bad_text, "span does not match").when(~F.col("entity_type").isin(*V.LABELS), "unknown label")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").drop("__text")
