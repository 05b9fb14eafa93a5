"""Entity resolution: exact names, unique containment, aliases, coreference, folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions import scalar as S
from veilgraph.functions import vocab as V
from veilgraph.functions.spans import cut, regex_spans
from veilgraph.store import materialize


def number_entities(groups: DataFrame, prefix: str, first: int = 1) -> DataFrame:
    """<doc>_<prefix>001 by first offset."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_start", "key")) + (first - 1)
    return groups.withColumn("entity_id", F.format_string(f"%s_{prefix}%03d", "doc_id", n))


def simple_entities(mentions: DataFrame, categories: tuple[str, ...], prefix: str, by_text: bool = True) -> DataFrame:
    """Mentions of the categories with entity_id: grouped by lower-cased text, or each on its own."""
    own = mentions.where(F.col("entity_type").isin(*categories)).withColumn("key", F.lower("text") if by_text else F.col("mention_id"))
    groups = own.groupBy("doc_id", "key").agg(F.min("start").alias("first_start"), F.min_by("entity_type", "start").alias("category"))
    return own.join(number_entities(groups, prefix).drop("first_start"), ["doc_id", "key"])


def identifier_entities(mentions: DataFrame) -> DataFrame:
    own = mentions.where(F.col("entity_type").isin(*V.IDENTIFIERS)).withColumn("key", F.concat_ws(":", "entity_type", F.lower("text")))
    groups = own.groupBy("doc_id", "key").agg(F.min("start").alias("first_start"), F.first("entity_type").alias("category"))
    return own.join(number_entities(groups, "ID").drop("first_start"), ["doc_id", "key"])


def person_entities(mentions: DataFrame) -> DataFrame:
    """Person mentions with entity_id, ambiguous and titled_elsewhere.

    Mentions with equal name tokens form a group (a single token keeps its title apart). A single-token
    group joins the one multi-token group of its document that holds the token; with several it is
    ambiguous. Groups of several tokens never join each other, so no closure is needed.
    """
    own = mentions.where(F.col("entity_type").isin(*V.PERSONS)).withColumn("tokens", S.name_tokens(F.col("text")))
    own = own.withColumn("title", F.when(F.size("tokens") == 1, S.honorific(F.col("text"))).otherwise(""))
    own = own.withColumn("gkey", F.when(F.size("tokens") == 0, F.lower("text")).otherwise(F.concat_ws(" ", F.array_join("tokens", " "), F.concat(F.lit("|"), F.col("title")))))
    groups = own.groupBy("doc_id", "gkey").agg(F.min("start").alias("first_start"), F.first("tokens").alias("tokens"), F.first("title").alias("title"))
    multi = groups.where("size(tokens) > 1").select("doc_id", F.col("gkey").alias("target"), F.explode(F.array_distinct("tokens")).alias("token"))
    single = groups.where("size(tokens) = 1").select("doc_id", "gkey", F.get("tokens", F.lit(0)).alias("token"), "title")
    hits = single.join(multi, ["doc_id", "token"]).groupBy("doc_id", "gkey").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    profiles = single.groupBy("doc_id", "token").agg((F.count("*") > 1).alias("titled_elsewhere"))
    flags = single.join(profiles, ["doc_id", "token"]).select("doc_id", "gkey", (F.col("titled_elsewhere") & (F.col("title") == "")).alias("titled_elsewhere"))
    linked = groups.join(hits, ["doc_id", "gkey"], "left").join(flags, ["doc_id", "gkey"], "left")
    linked = linked.select("doc_id", "gkey", "first_start", F.when(F.col("n") == 1, F.col("target")).otherwise(F.col("gkey")).alias("key"), (F.coalesce("n", F.lit(0)) > 1).alias("ambiguous"), F.coalesce("titled_elsewhere", F.lit(False)).alias("titled_elsewhere"))
    roots = number_entities(linked.groupBy("doc_id", "key").agg(F.min("first_start").alias("first_start")), "e").drop("first_start")
    named = linked.join(roots, ["doc_id", "key"]).drop("first_start", "key")
    return own.join(named, ["doc_id", "gkey"]).drop("gkey", "title")


def entity_at(spans: DataFrame, mentions: DataFrame, start: str, end: str, into: str) -> DataFrame:
    """spans with the first entity (by id) that has an overlapping mention."""
    m = mentions.select(F.col("doc_id").alias("__d"), F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("entity_id").alias("__id"))
    hit = (F.col("doc_id") == F.col("__d")) & (F.col(start) < F.col("__e")) & (F.col("__s") < F.col(end))
    return spans.join(m, hit, "left").groupBy(*spans.columns).agg(F.min("__id").alias(into))


def entity_before(points: DataFrame, mentions: DataFrame, pos: str, exclude: str, into: str) -> DataFrame:
    """points with the entity whose mention ends last at or before pos (excluding one); the first on ties."""
    m = mentions.select(F.col("doc_id").alias("__d"), F.col("end").alias("__e"), F.col("entity_id").alias("__id"))
    hit = (F.col("doc_id") == F.col("__d")) & (F.col("__e") <= F.col(pos)) & (F.col("__id") != F.coalesce(F.col(exclude), F.lit("")))
    best = F.min_by("__id", F.struct(-F.col("__e"), F.col("__id")))
    return points.join(m, hit, "left").groupBy(*points.columns).agg(best.alias(into))


def nearest_person(points: DataFrame, mentions: DataFrame, transcripts: DataFrame, reach: int = 140) -> DataFrame:
    """points(doc_id, pos, gender, exclude) with antecedent: by rising gap up to reach, of no other gender;
    none if a fresh person noun comes between."""
    fresh = rf"(?i)\b(?:a|an|the|my|this|that)\s+(?:{V.KIN}|guy|man|woman|boy|girl|lady|kid|person)\b"
    m = mentions.select(F.col("doc_id").alias("__d"), F.col("end").alias("__e"), F.col("entity_id").alias("__id"), F.col("gender").alias("__g"))
    hit = (F.col("doc_id") == F.col("__d")) & (F.col("__e") <= F.col("pos")) & (F.col("pos") - F.col("__e") <= reach) & (F.col("__id") != F.coalesce(F.col("exclude"), F.lit("")))
    fits = hit & ~((F.col("gender") != F.col("__g")) & F.col("gender").isNotNull() & F.col("__g").isNotNull())
    near = points.join(m, fits, "left").groupBy(*points.columns).agg(F.min_by(F.struct("__id", "__e"), F.struct(-F.col("__e"), F.col("__id"))).alias("__best"))
    joined = near.join(transcripts.select("doc_id", "text"), "doc_id")
    between = cut(F.col("text"), F.col("__best.__e"), F.col("pos"))
    return joined.withColumn("antecedent", F.when(~between.rlike(fresh), F.col("__best.__id"))).drop("__best", "text")


PRONOUN_GENDER = {"him": "M", "his": "M", "he": "M", "her": "F", "hers": "F", "she": "F"}
_QUOTES = tuple("\"'“”‘’")
_SUBJECT = None
#: Cue: the words before an alias, each a choice; _SUBJECT stands for a pronoun or a name.
ALIAS_CUES = {
    "call": (("call", "calls", "called", "calling"), _SUBJECT),
    "as": (("know", "knows", "knew", "known"), _SUBJECT, ("as",)),
    "real": (_SUBJECT, ("real",), ("name",), ("is", "was")),
    "by": (("go", "goes", "going", "went"), ("by",)),
    "nick": (("nicknamed",),),
}


def alias_cues(transcripts: DataFrame) -> DataFrame:
    """(doc_id, cue_rank, cue, start, subject, subject_start, alias, alias_start, alias_end).

    The text is a row of words and marks; a cue is a choice of words side by side, and the alias the
    capitalised words (three at most) that follow, in quotes or not.
    """
    words = transcripts.select("doc_id", regex_spans(F.col("text"), r"[A-Za-z]+(?:['’-][A-Za-z]+)*|[^\sA-Za-z]").alias("w"))
    at = lambda i: F.get("w", i)
    name = lambda i: F.coalesce(at(i)["value"].rlike(f"^{V.NAME_TOKEN}$"), F.lit(False))

    def fits(i: Column, choice: tuple[str, ...] | None) -> Column:
        if choice is not _SUBJECT:
            return F.coalesce(F.lower(at(i)["value"]).isin(*choice), F.lit(False))
        return name(i) | F.coalesce(F.lower(at(i)["value"]).isin(*PRONOUN_GENDER, "them", "their", "they"), F.lit(False))

    def found(choices: tuple) -> Callable[[Column], Column]:
        place = choices.index(_SUBJECT) if _SUBJECT in choices else None

        def alias(i: Column) -> Column:
            hit = F.lit(True)
            for k, choice in enumerate(choices):
                hit = hit & fits(i + k, choice)
            first = i + len(choices) + F.coalesce(at(i + len(choices))["value"].isin(*_QUOTES), F.lit(False)).cast("int")
            more = F.when(name(first + 1) & name(first + 2), 2).when(name(first + 1), 1).otherwise(0)
            subject = at(i + (place or 0))
            own = F.struct(
                at(i)["start"].alias("start"),
                (F.lit(None).cast("string") if place is None else subject["value"]).alias("subject"),
                subject["start"].alias("subject_start"),
                F.array_join(F.transform(F.slice("w", first + 1, more + 1), lambda x: x["value"]), " ").alias("alias"),
                at(first)["start"].alias("alias_start"),
                at(first + more)["end"].alias("alias_end"),
            )
            return F.when(hit & name(first), own)

        return alias

    out = None
    for rank, (cue, choices) in enumerate(ALIAS_CUES.items()):
        every = F.transform(F.sequence(F.lit(0), F.size("w") - 1), found(choices))
        hits = words.where(F.size("w") > 0).select("doc_id", F.explode(F.array_compact(every)).alias("x"))
        part = hits.select("doc_id", F.lit(rank).alias("cue_rank"), F.lit(cue).alias("cue"), "x.*")
        out = part if out is None else out.unionByName(part)
    return out


def alias_pairs(transcripts: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, cue, base, alias): entities that a cue says are one; mentions carry gender."""
    found = entity_at(alias_cues(transcripts), mentions, "alias_start", "alias_end", "alias_id").where("alias_id IS NOT NULL")
    literal = found.where(F.col("subject").isNotNull() & ~F.lower("subject").isin(*PRONOUN_GENDER, "them", "their", "they"))
    literal = literal.withColumn("subject_end", F.col("subject_start") + F.length("subject"))
    named = entity_at(literal, mentions, "subject_start", "subject_end", "base").drop("subject_end")
    other = found.where(F.col("subject").isNull() | F.lower("subject").isin(*PRONOUN_GENDER, "them", "their", "they"))
    points = other.withColumn("pos", F.col("start")).withColumn("gender", S.lookup(PRONOUN_GENDER, F.lower("subject"))).withColumn("exclude", F.col("alias_id"))
    bound = nearest_person(points, mentions, transcripts).withColumnRenamed("antecedent", "base").drop("pos", "gender", "exclude")
    pairs = named.unionByName(bound.select(*named.columns)).where("base IS NOT NULL AND base <> alias_id")
    return pairs.select("doc_id", "cue_rank", "cue", "start", "base", F.col("alias_id").alias("alias"))


def coref_pairs(clusters: DataFrame, mentions: DataFrame, sentence_of: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(doc_id, base, other, accepted, reason) for entities that a cluster (doc_id, cluster_id, start, end) touches.

    Genders that differ block, as does a shared sentence without a verdict; a verdict (doc_id, a, b, same)
    decides; without one the names must be compatible.
    """
    touched = entity_at(clusters, mentions, "start", "end", "entity_id").where("entity_id IS NOT NULL")
    first = touched.groupBy("doc_id", "cluster_id", "entity_id").agg(F.min("start").alias("at"))
    base = first.groupBy("doc_id", "cluster_id").agg(F.min_by("entity_id", "at").alias("base"))
    facts = mentions.join(sentence_of, ["doc_id", "mention_id"]).groupBy("doc_id", "entity_id").agg(F.first("gender", ignorenulls=True).alias("gender"), F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"), F.collect_set("sent_ix").alias("sents"))
    a = facts.select("doc_id", F.col("entity_id").alias("base"), F.struct("gender", "tokens", "sents").alias("x"))
    b = facts.select("doc_id", F.col("entity_id").alias("other"), F.struct("gender", "tokens", "sents").alias("y"))
    pairs = first.join(base, ["doc_id", "cluster_id"]).where("entity_id <> base").select("doc_id", "base", F.col("entity_id").alias("other")).distinct()
    rows = pairs.join(a, ["doc_id", "base"]).join(b, ["doc_id", "other"])
    if verdicts is None:
        rows = rows.withColumn("same", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(verdicts.select("doc_id", F.col("a").alias("base"), F.col("b").alias("other"), "same"), ["doc_id", "base", "other"], "left")
    conflict = F.coalesce(F.col("x.gender") != F.col("y.gender"), F.lit(False))
    together = F.arrays_overlap("x.sents", "y.sents")
    reason = F.when(conflict, "genders conflict").when(F.col("same").isNotNull(), F.when(F.col("same"), "confirmed").otherwise("refused")).when(together, "same sentence").when(S.names_compatible(F.col("x.tokens"), F.col("y.tokens")), "names compatible").otherwise("names differ")
    return rows.select("doc_id", "base", "other", reason.isin("confirmed", "names compatible").alias("accepted"), reason.alias("reason"))


def components(pairs: DataFrame) -> DataFrame:
    """(doc_id, node, root) of undirected pairs (doc_id, a, b); the root is the least node.

    Labels spread to neighbours and then jump to the label of their label, so long chains take few rounds.
    """
    both = materialize(pairs.select("doc_id", "a", "b").unionByName(pairs.select("doc_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    labels = both.groupBy("doc_id", F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
    while True:
        e = both.join(labels.select("doc_id", F.col("node").alias("b"), "root"), ["doc_id", "b"]).groupBy("doc_id", F.col("a").alias("node")).agg(F.min("root").alias("near"))
        grown = labels.join(e, ["doc_id", "node"]).select("doc_id", "node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = grown.select("doc_id", F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = grown.join(up, ["doc_id", "root"], "left").select("doc_id", "node", "was", F.least("root", F.coalesce("above", "root")).alias("root"))
        jumped = materialize(jumped, "roots")
        labels = jumped.select("doc_id", "node", "root")
        if jumped.where("was <> root").isEmpty():
            return labels


def fold(mentions: DataFrame, roots: DataFrame) -> DataFrame:
    """Mentions moved to the root entity; folded_from names where they came from."""
    r = roots.select("doc_id", F.col("node").alias("entity_id"), "root")
    out = mentions.join(r, ["doc_id", "entity_id"], "left")
    moved = F.col("root").isNotNull() & (F.col("root") != F.col("entity_id"))
    return out.withColumn("folded_from", F.when(moved, F.col("entity_id"))).withColumn("entity_id", F.coalesce("root", "entity_id")).drop("root")


def fold_values(values: DataFrame, roots: DataFrame, base_wins: bool) -> DataFrame:
    """field_values of folded entities at their root: folded ones overwrite, or (base_wins) only fill."""
    r = roots.select("doc_id", F.col("node").alias("entity_id"), "root")
    out = values.join(r, ["doc_id", "entity_id"], "left").withColumn("__own", F.col("root").isNull() | (F.col("root") == F.col("entity_id"))).withColumn("entity_id", F.coalesce("root", "entity_id")).drop("root")
    rank = F.when(F.col("__own") == F.lit(base_wins), 0).otherwise(1)
    w = Window.partitionBy("doc_id", "entity_id", "field").orderBy(F.col("value").isNull(), rank)
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__own")


def surface_forms(mentions: DataFrame) -> DataFrame:
    """(doc_id, entity_id, forms): distinct texts, longest first, then by text."""
    forms = F.array_sort(F.transform(F.collect_set("text"), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return mentions.groupBy("doc_id", "entity_id").agg(F.transform(forms, lambda x: x["t"]).alias("forms"))


def display_name(forms: Column, entity_id: Column, speaker: Column) -> Column:
    return F.coalesce(F.get(forms, F.lit(0)), F.when(speaker, "the interviewee"), entity_id)
