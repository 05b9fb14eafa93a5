"""From transcripts and detections to the graph: entities, values, edges, ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.functions import scalar as S
from veilgraph.functions import vocab as V
from veilgraph.functions.spans import cut
from veilgraph.operators import checks, entities, rules, text
from veilgraph.plans import arbitration
from veilgraph.store import materialize, step


@dataclass
class Graph:
    """Tables of one run."""

    transcripts: DataFrame
    mentions: DataFrame
    entities: DataFrame
    values: DataFrame
    edges: DataFrame
    ledger: DataFrame
    blocking: DataFrame
    flags: DataFrame


def speakers(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("doc_id", F.concat("doc_id", F.lit("_e000")).alias("speaker_id"))


def all_entities(mentions: DataFrame) -> DataFrame:
    """Mentions with entity_id and category, persons, places, dates, ages and identifiers alike."""
    keep = [*mentions.columns, "entity_id", "category"]
    people = entities.person_entities(mentions).withColumn("category", F.lit("PERSON")).select(*keep)
    places = entities.simple_entities(mentions, V.PLACES, "L").select(*keep)
    dates = entities.simple_entities(mentions, V.DATES, "D").select(*keep)
    ages = entities.simple_entities(mentions, ("AGE",), "A", by_text=False).select(*keep)
    ids = entities.identifier_entities(mentions).select(*keep)
    return people.unionByName(places).unionByName(dates).unionByName(ages).unionByName(ids)


def _long(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(field).alias("field"), F.col(c).cast("string").alias("value")) for c, field in columns.items()])
    return df.select("doc_id", "entity_id", F.explode(pairs).alias("x")).select("doc_id", "entity_id", "x.field", "x.value")


def _context(m: DataFrame, transcripts: DataFrame, kin: DataFrame, masks: DataFrame, clipped: DataFrame) -> DataFrame:
    """What checkers read about each entity, from its first mention."""
    first = m.groupBy("doc_id", "entity_id").agg(F.min_by(F.struct("start", "end", "text", "category"), F.struct("start", "end")).alias("m"), F.collect_set("text").alias("forms"))
    first = text.as_of(first.withColumn("at", F.col("m.start")), clipped, "at", "start", ["next_start", "next_end"])
    rows = first.join(transcripts, "doc_id").join(masks.withColumnRenamed("text", "subject_text"), "doc_id")
    s, e = F.col("m.start"), F.col("m.end")
    ends = kin.groupBy("doc_id", F.col("target").alias("entity_id")).agg(F.collect_set("detail").alias("kin_details"))
    kin_ids = kin.select("doc_id", F.explode(F.array("source", "target")).alias("entity_id")).distinct().withColumn("is_kin", F.lit(True))
    out = rows.select(
        "doc_id",
        "entity_id",
        F.col("m.category").alias("category"),
        F.col("m.text").alias("text"),
        "forms",
        cut(F.col("text"), F.greatest(F.lit(0), s - 60), s).alias("before"),
        cut(F.col("text"), e, e + 80).alias("after"),
        cut(F.col("text"), F.greatest(F.lit(0), s - 80), e + 80).alias("around"),
        cut(F.col("text"), F.col("next_start"), F.col("next_end")).alias("next_sentence"),
        S.parse_age(F.when(F.col("m.category") == "AGE", F.col("m.text")))["value"].alias("age_value"),
        (S.anchor(F.col("m.text")).isNotNull() & ~S.anchor(F.col("m.text")).isin(*V.LOCAL_ANCHORS)).alias("national_event"),
        F.col("text").alias("doc_text"),
        "subject_text",
        "interview_date",
    )
    return out.join(ends, ["doc_id", "entity_id"], "left").join(kin_ids, ["doc_id", "entity_id"], "left")


def _evidence(context: DataFrame, owners: DataFrame, near: DataFrame, dates: DataFrame, places: DataFrame | None) -> DataFrame:
    """context with what other operators found: cues of owners, the date beside an age, the birth date, the gazetteer's type."""
    keys = ["doc_id", "entity_id"]
    when = dates.select("doc_id", F.col("entity_id").alias("anchor_id"), F.col("resolved").cast("date").alias("anchor_date"))
    beside = near.select("doc_id", F.col("age_id").alias("entity_id"), F.col("date_id").alias("anchor_id"), F.lit(True).alias("anchor_near")).join(when, ["doc_id", "anchor_id"], "left")
    born = dates.where("category = 'DATE_OF_BIRTH'").groupBy("doc_id").agg(F.min("resolved").alias("dob"), F.count_distinct("resolved").alias("n")).where("n = 1")
    out = context.join(owners.drop("survivors"), keys, "left").join(beside, keys, "left").join(born.select("doc_id", F.col("dob").cast("date").alias("dob")), "doc_id", "left")
    # A birth date is held against the ages of who was born then.
    out = out.withColumn("dob", F.when(F.col("cue") & ~F.col("kin_after_cue") & ~F.col("third_person") & ~F.col("nearer_person"), F.col("dob")))
    if places is None:
        return out
    return out.join(places.select(*keys, F.col("type").alias("gaz_type"), F.lower("parent").alias("gaz_parent")), keys, "left")


def _decided(ledger: DataFrame) -> DataFrame:
    """What later waves read of the fields decided before, one row for each entity."""
    of = lambda field, what: F.max(F.when(F.col("field") == field, what))
    return ledger.groupBy("doc_id", "entity_id").agg(
        of("subtype_location", F.col("value")).alias("place_type"),
        of("subtype_location", F.array_contains("passed", "type_corroborated") & (F.size("failed") == 0)).alias("type_verified"),
        of("resolved_value", F.col("value")).alias("resolved"),
        of("shiftable", F.lower("value") == "true").alias("rule_shiftable"),
        of("value", F.size("failed") > 0).alias("age_refuted"),
    )


def run(transcripts: DataFrame, detections: DataFrame, proposals: DataFrame | None = None, gazetteer: tuple[DataFrame, DataFrame] | None = None, year_limit: int = 2030) -> Graph:
    """transcripts(doc_id, text, interview_date), detections (validated), proposals(doc_id, entity_id, field, value)."""
    spark, transcripts = transcripts.sparkSession, transcripts.hint("merge")
    found = text.number_mentions(text.resolve_overlaps(detections))
    # Written once: later steps read these many times over, and plans stay small.
    m = step(all_entities(step(found, "mentions")), "entities")
    who = speakers(transcripts)
    turn_rows = step(text.turns(transcripts), "turns")
    masks = step(text.subject_mask(transcripts, turn_rows), "masks")
    tiles = step(text.sentences(transcripts), "sentences")

    kin = step(rules.kinship(transcripts, m, who), "kinship")
    people = rules.person_attributes(m, transcripts, kin)
    values = _long(people, {"given": "given_name", "surname": "surname", "subtype": "subtype_person", "replace": "replace", "gender": "gender", "role": "role"})
    values = values.unionByName(_long(rules.person_ethnicity(m, transcripts), {"ethnicity": "ethnicity"}))
    speaker = rules.speaker_gender(masks).join(rules.speaker_ethnicity(masks), "doc_id").join(who, "doc_id").withColumnRenamed("speaker_id", "entity_id")
    values = values.unionByName(_long(speaker, {"gender": "interviewee_gender", "ethnicity": "ethnicity"}))

    values = step(values, "values")
    one = m.groupBy("doc_id", "entity_id").agg(F.min_by("category", "start").alias("category"), F.min_by("text", F.struct("start", "end")).alias("text"), F.min("start").alias("start"), F.min_by("end", "start").alias("end"))
    dates = step(rules.resolve_dates(one.where(F.col("category").isin(*V.DATES)).join(transcripts.select("doc_id", "interview_date"), "doc_id")), "dates")
    values = values.unionByName(_long(dates.withColumn("keep", F.col("shiftable")), {"resolved": "resolved_value", "shiftable": "shiftable", "approximate": "approximate", "keep": "replace_date"}))
    ages = rules.resolve_ages(one.where("category = 'AGE'"))
    values = values.unionByName(_long(ages.withColumn("replace", F.lit(True)), {"value": "value", "approximate": "approximate", "replace": "replace_age"}))
    ids = rules.identifiers(one.where(F.col("category").isin(*V.IDENTIFIERS)))
    values = values.unionByName(_long(ids.withColumn("kind", F.when(F.col("flag").isNull(), F.col("category"))), {"kind": "kind", "identifying": "identifying"}))

    edges = kin.select("doc_id", "source", "target", F.lit("RELATED_TO").alias("relation"), "detail", "evidence")
    near = step(rules.stated_with(*[text.at_position(x, tiles, "start", "sent_ix").hint("merge") for x in (ages, dates)]), "near")
    edges = edges.unionByName(near.select("doc_id", F.col("age_id").alias("source"), F.col("date_id").alias("target"), F.lit("STATED_WITH").alias("relation"), F.lit("").alias("detail"), F.lit("").alias("evidence")))
    found_places = None
    if gazetteer is None:
        unknown = one.where(F.col("category").isin(*V.PLACES)).withColumn("replace", F.lit(True))
        values = values.unionByName(_long(unknown, {"replace": "replace_location"}))
    else:
        forms = entities.surface_forms(m.where(F.col("category").isin(*V.PLACES)))
        # Written plainly: lookups in a gazetteer stay with Catalyst, as some names are far more common than others.
        found_places = step(rules.places(materialize(forms, "forms"), *gazetteer), "places")
        edges = edges.unionByName(rules.place_edges(found_places).withColumn("evidence", F.lit("")))
        kinds = found_places.join(one.select("doc_id", "entity_id", "category"), ["doc_id", "entity_id"]).withColumn("replace", rules.place_replace(F.col("category"), F.col("type")))
        values = values.unionByName(_long(kinds, {"type": "subtype_location", "parent": "location_parent", "replace": "replace_location"}))
    clipped = step(text.clipped_sentences(tiles, turn_rows), "clipped")
    owned = m.where(F.col("category").isin("AGE", "DATE_OF_BIRTH", *V.IDENTIFIERS))
    evidence = step(rules.owner_evidence(owned, clipped, transcripts, m.where("category = 'PERSON'")), "owners")
    owner = evidence.select("doc_id", "entity_id", F.when(F.size("survivors") == 1, F.get("survivors", F.lit(0))).alias("owner"))
    values = values.unionByName(_long(owner, {"owner": "owner"}))

    nodes = one.select("doc_id", "entity_id", "category").unionByName(who.select("doc_id", F.col("speaker_id").alias("entity_id"), F.lit("SPEAKER").alias("category")))
    fields = nodes.join(F.broadcast(arbitration.field_map(spark)), "category")
    given = proposals.hint("merge") if proposals is not None else spark.createDataFrame([], "doc_id string, entity_id string, field string, value string")
    context = _evidence(step(_context(m, transcripts, kin, masks, clipped), "about"), evidence, near, dates, found_places)
    spoken = who.join(masks.withColumnRenamed("text", "subject_text"), "doc_id").join(transcripts, "doc_id").select("doc_id", F.col("speaker_id").alias("entity_id"), "subject_text", F.col("text").alias("doc_text"))
    context = step(context.unionByName(spoken.withColumn("category", F.lit("SPEAKER")), allowMissingColumns=True).withColumn("year_limit", F.lit(year_limit)), "context")
    keys = ["doc_id", "entity_id", "field"]
    rule = step(values.select(*keys, F.col("value").alias("rule")).dropDuplicates(keys), "rules")
    given = given.groupBy(*keys).agg(F.max_by("value", F.struct("seq", "value")) if "seq" in given.columns else F.max("value")).toDF(*keys, "llm")
    cands = fields.join(rule, keys, "left").join(given, keys, "left")
    cands = cands.join(context.select("doc_id", "entity_id", "text", "national_event"), ["doc_id", "entity_id"], "left").withColumn("llm_ran", F.lit(proposals is not None))
    approximate = rule.where("field = 'approximate'").select("doc_id", "entity_id", (F.lower("rule") == "true").alias("approximate"))
    cands = step(cands.join(approximate, ["doc_id", "entity_id"], "left"), "candidates")
    ledger = None
    # A field's checkers and comparators read what earlier waves decided.
    for wave in sorted(w for w in arbitration.WAVES if w):
        own, seen = cands.where(F.col("wave") == wave), context
        if ledger is not None:
            decided = step(_decided(ledger), "decided")
            own = own.join(decided.select("doc_id", "entity_id", "place_type", "age_refuted"), ["doc_id", "entity_id"], "left")
            seen = context.join(decided, ["doc_id", "entity_id"], "left")
        # Fields with a closed set of values have each of them tried: a rule's silence may be settled so.
        closed = F.coalesce(*[F.when(F.col("field") == f, F.array(*map(F.lit, v))) for f, v in arbitration.ALTERNATIVES.items()], F.array().cast("array<string>"))
        tried = own.select(*keys, F.explode(F.array_distinct(F.concat(F.array_compact(F.array("rule", "llm")), closed))).alias("value")).where("value <> ''")
        tried = tried.join(seen, ["doc_id", "entity_id"])
        if found_places is not None:
            tried = tried.withColumn("parent_known", F.when(F.lower("value") == F.col("gaz_parent"), True))
        outcomes = step(checks.outcomes(tried, arbitration.WAVES[wave]), "outcomes")
        part = arbitration.arbitrate(own.drop("wave", "ord"), outcomes)
        ledger = step(part if ledger is None else ledger.unionByName(part), "ledger")
    ledger = step(arbitration.drop_name_collisions(ledger), "ledger")
    own = rules.owner_edges(ledger, who)
    edges = step(edges.unionByName(own.withColumn("evidence", F.lit(""))), "edges")
    attributes = arbitration.apply_ledger(rule.withColumnRenamed("rule", "value"), ledger).hint("merge")
    subtype = attributes.where("field = 'subtype'").select("doc_id", "entity_id", F.col("value").alias("subtype")).dropDuplicates(["doc_id", "entity_id"])
    return Graph(transcripts, m, nodes.join(subtype, ["doc_id", "entity_id"], "left"), attributes, edges, ledger, arbitration.blocking_fields(ledger), arbitration.review_flags(ledger))
