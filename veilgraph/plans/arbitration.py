"""Arbitration of rule values and proposals, as relational steps over candidates.

candidates: doc_id, entity_id, field, category, rule, llm, llm_ran, and where a comparator or a safe
direction needs them text, approximate, place_type, national_event, age_refuted. Values are strings;
'false' is a value, NULL and '' are none. outcomes: doc_id, entity_id, field, value, check_ord, check,
state for every value that may survive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.functions import scalar as S
from veilgraph.functions import vocab as V

#: Field, tier, conflict policy, comparator, what counts as unsafe, the safe value, attribute, canonical form.
POLICIES = [
    ("gender", "OPTIONAL", "rule_wins", "exact", "always", None, "gender", None),
    ("role", "OPTIONAL", "rule_wins", "kin_synonym", "always", None, "role", "lower"),
    ("ethnicity", "OPTIONAL", "rule_wins", "ci", "always", None, "ethnicity", "ethnonym"),
    ("interviewee_gender", "REQUIRED_VERIFIED", "block", "exact", "always", None, "gender", None),
    ("interviewee_identity", "REQUIRED_OR_ABSTAIN", "block", "exact", "any", None, "identity_entity_id", None),
    ("given_name", "REQUIRED_OR_ABSTAIN", "rule_wins", "ci", "always", None, "given_name", None),
    ("surname", "REQUIRED_OR_ABSTAIN", "rule_wins", "ci", "always", None, "surname", None),
    ("replace", "REQUIRED_VERIFIED", "safe_direction", "boolean", "false", "true", "replace", None),
    ("subtype_person", "OPTIONAL", "rule_wins", "upper", "always", None, "subtype", None),
    ("subtype_location", "OPTIONAL", "rule_wins", "loc_type", "always", None, "subtype", None),
    ("replace_location", "REQUIRED_OR_ABSTAIN", "safe_direction", "boolean", "false", "true", "replace", None),
    ("location_parent", "OPTIONAL", "rule_wins", "ci", None, None, "location_parent", None),
    ("resolved_value", "REQUIRED_OR_ABSTAIN", "rule_wins", "date_close", "always", None, "resolved_value", None),
    ("shiftable", "OPTIONAL", "safe_direction", "boolean", "false", "true", "shiftable", None),
    ("replace_date", "REQUIRED_OR_ABSTAIN", "safe_direction", "boolean", "false", "true", "replace", None),
    ("approximate", "OPTIONAL", "rule_wins", "boolean", "always", None, "approximate", None),
    ("value", "REQUIRED_OR_ABSTAIN", "rule_wins", "age_close", "always", None, "value", None),
    ("replace_age", "REQUIRED_OR_ABSTAIN", "safe_direction", "boolean", "false", "true", "replace", None),
    ("owner", "REQUIRED_OR_ABSTAIN", "rule_wins", "exact", "any", None, "owner", None),
    ("kind", "OPTIONAL", "rule_wins", "id_kind", "any", None, "category", None),
    ("identifying", "OPTIONAL", "rule_wins", "boolean", "always", None, "identifying", None),
    ("stated_with", "OPTIONAL", "rule_wins", "ci", "always", None, "stated_with", None),
    ("relation", "OPTIONAL", "rule_wins", "kin_synonym", None, None, "edge", None),
    ("same_person", "OPTIONAL", "safe_direction", "boolean", "true", None, "edge", None),
]
#: Fields that apply to a category, in order; a field of a later wave reads results of earlier ones.
FIELD_MAP = {
    "SPEAKER": ["interviewee_gender", "ethnicity"],
    "PERSON": ["gender", "given_name", "surname", "replace", "subtype_person", "role", "ethnicity"],
    "LOCATION": ["subtype_location", "location_parent", "replace_location"],
    "INSTITUTION": ["subtype_location", "location_parent", "replace_location"],
    "DATE_ABSOLUTE": ["resolved_value", "shiftable", "approximate", "replace_date"],
    "DATE_RELATIVE": ["resolved_value", "shiftable", "approximate", "replace_date"],
    "DATE_ANCHOR": ["resolved_value", "shiftable", "approximate", "replace_date"],
    "DATE_OF_BIRTH": ["resolved_value", "shiftable", "approximate", "replace_date", "owner"],
    "AGE": ["value", "owner", "stated_with", "approximate", "replace_age"],
    "PHONE": ["kind", "owner"],
    "EMAIL": ["kind", "owner"],
    "SSN_OR_ID": ["kind", "owner"],
    "USERNAME_HANDLE": ["kind", "owner"],
    "OCCUPATION": ["kind", "owner", "identifying"],
}
WAVES = {
    0: ["interviewee_identity", "relation", "same_person"],
    1: ["interviewee_gender", "gender", "given_name", "surname", "replace", "role", "ethnicity", "subtype_location", "resolved_value", "kind", "owner", "identifying"],
    2: ["subtype_person", "location_parent", "replace_location", "approximate", "shiftable", "value"],
    3: ["replace_date", "stated_with", "replace_age"],
}
ALTERNATIVES = {"owner": ("interviewee", "other"), "interviewee_gender": ("F", "M")}
DATE_TOLERANCE = {"DATE_RELATIVE": 60, "DATE_ABSOLUTE": 31, "DATE_OF_BIRTH": 31, "DATE_ANCHOR": 3}
COMPANIONS = {"owner": ("owner_basis",), "resolved_value": ("has_year", "granularity"), "value": ("stated_with",), "kind": ("digits", "local", "domain", "handle", "occupation")}



def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "field string, tier string, conflict string, comparator string, unsafe string, safe_value string, attr string, canon string")


def field_map(spark: SparkSession) -> DataFrame:
    wave = {f: w for w, fields in WAVES.items() for f in fields}
    return spark.createDataFrame([(k, f, i, wave[f]) for k, fields in FIELD_MAP.items() for i, f in enumerate(fields)], "category string, field string, ord int, wave int")


def agree(rule: Column, llm: Column) -> Column:
    """Whether two values agree under the policy's comparator."""
    t = F.coalesce("text", F.lit(""))
    a, b = S.iso_date(rule), S.iso_date(llm)
    gran = S.granularity(t)
    tolerance = S.lookup(DATE_TOLERANCE, F.col("category"), F.lit(31))
    months = (F.year(a) == F.year(b)) & (F.month(a) == F.month(b))
    near = F.when(gran == "year", F.year(a) == F.year(b)).when(gran == "season", months).otherwise(F.abs(F.date_diff(a, b)) <= tolerance)
    years = F.abs(rule.try_cast("int") - llm.try_cast("int"))
    out = (
        F.when(F.col("comparator").isin("ci", "upper", "boolean"), F.lower(F.trim(rule)) == F.lower(F.trim(llm)))
        .when(F.col("comparator") == "kin_synonym", S.kin_canon(rule) == S.kin_canon(llm))
        .when(F.col("comparator") == "loc_type", S.place_bucket(rule) == S.place_bucket(llm))
        .when(F.col("comparator") == "id_kind", S.kind_category(rule) == S.kind_category(llm))
        .when(F.col("comparator") == "date_close", near)
        .when(F.col("comparator") == "age_close", years <= F.when(F.coalesce("approximate", F.lit(False)), 5).otherwise(1))
        .otherwise(rule == llm)
    )
    return F.coalesce(out, F.lit(False))


def safer(rule: Column, llm: Column) -> Column:
    """The safe direction of two booleans that differ: replace if either says so, unless the rule's keep is proven."""
    outranks = (
        F.when(F.col("field") == "replace_location", F.lower("place_type").isin(*V.WIDE_PLACES))
        .when(F.col("field") == "replace_date", F.col("national_event"))
        .when(F.col("field") == "replace_age", F.col("age_refuted"))
        .otherwise(False)
    )
    either = (F.lower(rule) == "true") | (F.lower(llm) == "true")
    both = (F.lower(rule) == "true") & (F.lower(llm) == "true")
    kept = F.coalesce(outranks, F.lit(False)) & (F.lower(rule) == "false")
    return F.when(F.col("field") == "same_person", both).when(kept, False).otherwise(either).cast("string")


def _fan_in(outcomes: DataFrame) -> DataFrame:
    """Per value the ordered names of the checks that passed, failed and didn't apply."""

    def names(state: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col("state") == state, F.struct("check_ord", "check"))))
        return F.transform(own, lambda x: x["check"])

    return outcomes.groupBy("doc_id", "entity_id", "field", "value").agg(names("ok").alias("passed"), names("fail").alias("failed"), names("na").alias("skipped"))


def _with_checks(rows: DataFrame, checks: DataFrame, value: str, prefix: str) -> DataFrame:
    named = checks.select("doc_id", "entity_id", "field", F.col("value").alias(value), *[F.col(k).alias(f"{prefix}{k}") for k in ("passed", "failed", "skipped")])
    out = rows.join(named, ["doc_id", "entity_id", "field", value], "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({f"{prefix}{k}": F.coalesce(f"{prefix}{k}", empty) for k in ("passed", "failed", "skipped")})


def resolve(rows: DataFrame) -> DataFrame:
    """The decision table: action, value, source, blocking.

    What is read several times is a column of its own, as plans would else hold a copy for each reader.
    """
    rule, llm = F.col("rule"), F.col("llm")
    kept = rows.columns
    rows = rows.withColumns({"__rule": ~S.is_empty(rule), "__llm": ~S.is_empty(llm), "__same": agree(rule, llm), "__safe": safer(rule, llm)})
    has_r, has_l, same, safe = F.col("__rule"), F.col("__llm"), F.col("__same"), F.col("__safe")
    conflict = has_r & has_l & ~same
    decided = F.when(has_r & ~has_l, "keep").when(~has_r & ~has_l, "reject").when(has_r & same, "confirm").when(conflict, "conflict").when(F.size("l_failed") > 0, "reject").otherwise("fill")
    action = F.col("action")
    value = F.when((action == "conflict") & (F.col("conflict") == "block"), F.lit(None).cast("string")).when((action == "conflict") & (F.col("conflict") == "safe_direction"), safe).when(action == "fill", llm).when(has_r, rule)
    source = (
        F.when(action == "keep", "rule")
        .when(action == "confirm", "rule_confirmed")
        .when((action == "conflict") & (F.col("conflict") == "rule_wins"), "rule")
        .when((action == "conflict") & (F.col("conflict") == "safe_direction"), F.when(safe == F.lower(rule), "rule").otherwise("llm_checked"))
        .when(action == "fill", "llm_checked")
        .otherwise("")
    )
    may = F.col("llm_ran") & (F.col("tier") == "REQUIRED_VERIFIED")
    blocks = action.isin("keep", "reject") | ((action == "conflict") & (F.col("conflict") != "safe_direction"))
    return rows.withColumn("action", decided).select(*kept, "action", value.alias("out"), source.alias("source"), (may & blocks).alias("blocking"))


def guard(rows: DataFrame) -> DataFrame:
    """Checks the surviving value where the policy calls it unsafe."""
    out = F.col("out")
    unsafe = F.when(F.col("unsafe").isin("always", "any"), ~S.is_empty(out)).when(F.col("unsafe").isNotNull(), F.lower(out) == F.col("unsafe")).otherwise(False)
    kept = [c for c in rows.columns if c not in ("action", "out", "source", "blocking")]
    rows = rows.withColumn("__unsafe", F.coalesce(unsafe, F.lit(False)))
    unsafe = F.col("__unsafe")
    rows = rows.withColumn("__failed", unsafe & (F.size("o_failed") > 0))
    failed, unproven = F.col("__failed"), unsafe & (F.size("o_passed") == 0)
    required = F.col("tier") == "REQUIRED_VERIFIED"
    blocking = F.when(failed, required).when(unsafe, (F.col("blocking") & unproven) | (required & unproven & ~S.is_empty(out))).otherwise(F.col("blocking"))
    return rows.select(
        *kept,
        F.when(failed, "conflict").otherwise(F.col("action")).alias("action"),
        F.when(failed, F.col("safe_value")).otherwise(out).alias("out"),
        F.when(failed, "rule").otherwise(F.col("source")).alias("source"),
        blocking.alias("blocking"),
        *[F.when(unsafe, F.col(f"o_{k}")).otherwise(F.col(f"l_{k}")).alias(k) for k in ("passed", "failed", "skipped")],
    )


def survivors(outcomes: DataFrame) -> DataFrame:
    """(doc_id, entity_id, field, survivors): alternatives with a check passed and none failed."""
    closed = [f for f in ALTERNATIVES]
    per = _fan_in(outcomes.where(F.col("field").isin(*closed)))
    good = F.when((F.size("passed") > 0) & (F.size("failed") == 0), F.col("value"))
    return per.groupBy("doc_id", "entity_id", "field").agg(F.array_sort(F.collect_set(good)).alias("survivors"))


def canonical(value: Column) -> Column:
    """The policy's canonical form; never loses a value."""
    own = F.when(F.col("canon") == "lower", F.regexp_replace(F.lower(F.trim(value)), r"\.+$", "")).when(F.col("canon") == "ethnonym", S.ethnonym(value))
    return F.coalesce(own, value)


def arbitrate(candidates: DataFrame, outcomes: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """The ledger: doc_id, entity_id, field, action, value, source, blocking, passed, failed, skipped, verified."""
    spark = candidates.sparkSession
    checks = _fan_in(outcomes)
    # The registry has a fixed number of rows.
    rows = candidates.join(F.broadcast(registry if registry is not None else policies(spark)), "field")
    for name, kind in (("text", "string"), ("category", "string"), ("approximate", "boolean"), ("place_type", "string"), ("national_event", "boolean"), ("age_refuted", "boolean")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = resolve(_with_checks(rows, checks, "llm", "l_"))
    rows = guard(_with_checks(rows, checks, "out", "o_"))
    alone = survivors(outcomes)
    rows = rows.join(alone, ["doc_id", "entity_id", "field"], "left")
    derived = F.coalesce(S.is_empty(F.col("out")) & S.is_empty(F.col("rule")) & F.col("field").isin(*ALTERNATIVES) & (F.size("survivors") == 1), F.lit(False))
    rows = rows.withColumn("__derived", derived)
    derived = F.col("__derived")
    rows = rows.withColumn("__value", F.when(derived, F.get("survivors", F.lit(0))).otherwise(F.col("out")))
    return rows.select(
        "doc_id",
        "entity_id",
        "field",
        "attr",
        "tier",
        F.when(derived, "fill").otherwise(F.col("action")).alias("action"),
        canonical(F.col("__value")).alias("value"),
        F.when(derived, "checker_derived").otherwise(F.col("source")).alias("source"),
        F.when(derived, False).otherwise(F.coalesce("blocking", F.lit(False))).alias("blocking"),
        "passed",
        "failed",
        "skipped",
        ((F.size("passed") > 0) & (F.size("failed") == 0)).alias("verified"),
    )


def drop_name_collisions(ledger: DataFrame) -> DataFrame:
    """Where given name and surname agree the given name goes."""
    w = Window.partitionBy("doc_id", "entity_id")
    part = lambda f: F.max(F.when(F.col("field") == f, F.lower("value"))).over(w)
    hit = (F.col("field") == "given_name") & (part("given_name") == part("surname"))
    rows = ledger.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    return rows.withColumns(
        {
            "action": F.when(F.col("__hit"), "reject").otherwise(F.col("action")),
            "value": F.when(~F.col("__hit"), F.col("value")),
            "failed": F.when(F.col("__hit"), F.array_append("failed", F.lit("given_surname_collision"))).otherwise(F.col("failed")),
            "verified": F.col("verified") & ~F.col("__hit"),
        }
    ).drop("__hit")


def apply_ledger(values: DataFrame, ledger: DataFrame) -> DataFrame:
    """field_values(doc_id, entity_id, field, value) after the ledger: written, erased with companions, or left."""
    write = ledger.where("attr <> 'category' AND attr <> 'edge' AND (action IN ('fill', 'confirm', 'keep') OR (action = 'conflict' AND value IS NOT NULL))")
    write = write.select("doc_id", "entity_id", F.col("attr").alias("field"), "value").dropDuplicates(["doc_id", "entity_id", "field"])
    gone = ledger.where("action IN ('conflict', 'reject') AND value IS NULL AND attr <> 'category'")
    also = S.lookup({k: ",".join(v) for k, v in COMPANIONS.items()}, F.col("field"), F.lit(""))
    erase = gone.select("doc_id", "entity_id", F.explode(F.array_distinct(F.concat(F.array("attr"), F.filter(F.split(also, ","), lambda x: x != "")))).alias("field")).distinct()
    kept = values.select("doc_id", "entity_id", "field", "value").join(erase, ["doc_id", "entity_id", "field"], "left_anti").join(write.select("doc_id", "entity_id", "field"), ["doc_id", "entity_id", "field"], "left_anti")
    return kept.unionByName(write)


def review_flags(ledger: DataFrame) -> DataFrame:
    """(doc_id, entity_id, reason): what a reviewer has to look at, blocking first."""
    said = F.when(F.col("blocking"), F.concat(F.col("field"), F.lit(": needs a decision"))).when(F.col("action") == "conflict", F.concat(F.col("field"), F.lit(": rule and proposal differ"))).when((F.col("action") == "reject") & (F.size("failed") > 0), F.concat(F.col("field"), F.lit(": refuted by "), F.array_join("failed", ", ")))
    rows = ledger.withColumn("reason", said).where("reason IS NOT NULL")
    return rows.groupBy("doc_id", "entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("blocking")).alias("late"), "field", "reason"))), lambda x: x["reason"]), "; ").alias("reason"))


def blocking_fields(ledger: DataFrame) -> DataFrame:
    return ledger.where("blocking").select("doc_id", "entity_id", "field", F.concat(F.lit("unverified: "), F.coalesce("value", F.lit("none"))).alias("reason"))


def review_buckets(ledger: DataFrame) -> DataFrame:
    """Ledger rows as agree, suggest, conflict or unverified."""
    bucket = F.when(F.col("blocking") | (F.col("action") == "conflict"), "conflict").when(F.col("action") == "fill", "suggest").when((F.col("action") == "confirm") | F.col("verified"), "agree").otherwise("unverified")
    return ledger.withColumn("bucket", bucket)


def votes(answers: DataFrame) -> DataFrame:
    """answers(doc_id, entity_id, field, value, window_ix) to proposals: the most common value, the first on
    ties; confidence is high if more than one window says so."""
    n = answers.groupBy("doc_id", "entity_id", "field", "value").agg(F.count_distinct("window_ix").alias("n"), F.min("window_ix").alias("first"))
    best = n.groupBy("doc_id", "entity_id", "field").agg(F.max_by(F.struct("value", "n"), F.struct("n", -F.col("first"), F.col("value"))).alias("b"))
    return best.select("doc_id", "entity_id", "field", F.col("b.value").alias("value"), F.when(F.col("b.n") > 1, "high").otherwise("low").alias("confidence"))


def stated_first(answers: DataFrame) -> DataFrame:
    """Votes by basis: what was stated outranks what was inferred."""
    stated = votes(answers.where("basis = 'stated'")).withColumn("rank", F.lit(0))
    inferred = votes(answers.where("basis <> 'stated' OR basis IS NULL")).withColumn("rank", F.lit(1))
    w = Window.partitionBy("doc_id", "entity_id", "field").orderBy("rank")
    return stated.unionByName(inferred).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "rank")


def verified_quotes(claims: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Claims whose evidence is a quote of the transcript."""
    return claims.join(transcripts.select("doc_id", F.col("text").alias("__t")), "doc_id").where(S.quoted_in(F.col("evidence"), F.col("__t"))).drop("__t")


def cache_misses(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct prompts(model, system, prompt) without an answer in cache(key), with their key."""
    key = F.sha2(F.concat_ws("\0", "model", "system", "prompt"), 256)
    return prompts.withColumn("key", key).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
