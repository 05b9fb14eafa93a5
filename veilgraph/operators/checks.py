"""Checkers: Column builders that say ok, fail or na ("nothing to read") about a proposed value.

A checker reads the row of a candidate in its context. Context columns (missing ones may be NULL):
value; category; forms, text, before, after, around, sentence, next_sentence (of the first mention);
doc_text, subject_text, interview_date, year_limit; kin_details, is_kin, support; place_type, gaz_type,
parent_known, type_verified; resolved, dob, event, rule_shiftable; age_value, age_refuted;
cue, kin_after_cue, third_person, nearer_person, possessor; anchor_id, anchor_near, anchor_date;
quote, a_forms, b_forms, a_tokens, b_tokens, a_gender, b_gender, together, alias_cue, verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.functions import scalar as S
from veilgraph.functions import vocab as V

CHECKERS: dict[str, Callable[[], Column]] = {}
#: Checkers of each field, in the order in which they are reported.
FIELDS: dict[str, list[str]] = {}

c = F.col


def _v() -> Column:
    return F.col("value")


def register_checker(name: str, *fields: str) -> Callable:
    """Add a checker for the fields; the builder returns a Column over the context."""

    def add(builder: Callable[[], Column]) -> Callable[[], Column]:
        CHECKERS[name] = builder
        for f in fields:
            FIELDS.setdefault(f, []).append(name)
        return builder

    return add


def tri(applies: Column, passes: Column) -> Column:
    """ok or fail where it applies (and the test has an answer), else na."""
    return F.when(F.coalesce(applies, F.lit(False)) & passes.isNotNull(), F.when(passes, "ok").otherwise("fail")).otherwise("na")


def _refute(bad: Column) -> Column:
    """fail where bad, else na: never a confirmation."""
    return F.when(F.coalesce(bad, F.lit(False)), "fail").otherwise("na")


def _must(good: Column) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), "ok").otherwise("fail")


def _keep() -> Column:
    return F.lower(_v()) == "false"


_FEMALE, _MALE = r"(?i)\b(?:she|her|hers|herself)\b", r"(?i)\b(?:he|him|his|himself)\b"
_PERSONAL = rf"(?i)\b(?:my|our|his|her|their)\s+(?:\w+\s+){{0,2}}?(?:{V.KIN})\b"
_CUE = rf"(?i)\b(?:{'|'.join(V.PROFESSIONAL_CUES)})\b"


# --- gender ---
@register_checker("not_refuted_by_honorific", "gender")
def _() -> Column:
    g = F.array_distinct(F.array_compact(F.transform(c("forms"), S.honorific_gender)))
    return tri(F.size(g) > 0, F.forall(g, lambda x: x == _v()))


@register_checker("not_refuted_by_kin_word", "gender")
def _() -> Column:
    g = S.kin_gender(F.regexp_extract(F.right(c("before"), F.lit(24)), rf"(?i)\b({V.KIN}),?\s*$", 1))
    return tri(g.isNotNull(), g == _v())


@register_checker("not_refuted_by_pronoun", "gender")
def _() -> Column:
    read = F.concat_ws(" ", c("after"), c("next_sentence"))
    f, m = read.rlike(_FEMALE), read.rlike(_MALE)
    return F.when(~_v().isin("F", "M"), "fail").otherwise(tri(f != m, F.when(f, "F").otherwise("M") == _v()))


@register_checker("self_description_agrees", "interviewee_gender")
def _() -> Column:
    from veilgraph.operators.rules import self_described

    g = self_described(c("subject_text"))
    return F.when(F.size(g) > 1, "fail").otherwise(tri(F.size(g) == 1, F.get(g, F.lit(0)) == _v()))


@register_checker("honorific_address_agrees", "interviewee_gender")
def _() -> Column:
    g = S.lookup(V.HONORIFICS, F.lower(F.regexp_extract(c("doc_text"), r"(?m)^(?:INTERVIEWER|Q)[^\n]*?,\s+(Mr|Mrs|Ms|Miss|Sir|Madam)\b", 1)))
    return tri(g.isNotNull(), g == _v())


@register_checker("spouse_term_agrees", "interviewee_gender")
def _() -> Column:
    says = F.regexp_extract(c("subject_text"), r"(?i)\bmy\s+late\s+(husband|wife)\b", 1)
    return _refute(((F.lower(says) == "husband") & (_v() == "M") | (F.lower(says) == "wife") & (_v() == "F")) & c("subject_text").rlike(r"(?i)\bI(?:['’]m| am| was) (?:a|the) (?:widow|widower)\b"))


# --- speaker identity ---
@register_checker("named_in_self_reference_or_address", "interviewee_identity")
def _() -> Column:
    return _must(F.size("support") > 0)


@register_checker("not_introduced_as_a_relative", "interviewee_identity")
def _() -> Column:
    return _must(~c("before").rlike(rf"(?i)\b(?:my|our|his|her|their)\s+(?:\w+\s+){{0,2}}?(?:{V.KIN}),?\s*$"))


@register_checker("not_a_public_figure", "interviewee_identity")
def _() -> Column:
    return _must(~F.exists("forms", lambda x: F.lower(x).isin(*V.PUBLIC_FIGURES)))


# --- names ---
def _kept_tokens() -> Column:
    return F.flatten(F.transform(c("forms"), lambda x: F.split(F.lower(F.regexp_replace(x, "[,.]", " ")), r"\s+")))


@register_checker("part_is_token_of_mention", "given_name", "surname")
def _() -> Column:
    return _must(F.array_contains(_kept_tokens(), F.lower(F.regexp_replace(_v(), r"\.$", ""))))


@register_checker("part_not_a_title", "given_name", "surname")
def _() -> Column:
    return _must(~F.lower(_v()).isin(*V.HONORIFICS))


@register_checker("part_not_a_kin_word", "given_name", "surname")
def _() -> Column:
    return _must(~F.lower(_v()).isin(*V.NAME_STOP))


@register_checker("part_not_a_titled_surname", "given_name")
def _() -> Column:
    def titled(x: Column) -> Column:
        w = F.split(F.lower(F.regexp_replace(x, r"\.", "")), r"\s+")
        return (F.size(w) == 2) & F.get(w, F.lit(0)).isin(*V.HONORIFICS) & (F.get(w, F.lit(1)) == F.lower(_v()))

    return _refute(F.exists("forms", titled))


# --- persons ---
@register_checker("personal_signal_absent", "replace")
def _() -> Column:
    return tri(_keep(), ~(c("around").rlike(_PERSONAL) | c("around").rlike(_CUE) | c("before").rlike(r"(?i)\b(?:my|named|called)\s+$")))


@register_checker("not_kin_of_interviewee", "replace")
def _() -> Column:
    return tri(_keep(), ~F.coalesce(c("is_kin"), F.lit(False)))


@register_checker("role_corroborated", "role")
def _() -> Column:
    said = F.exists(F.coalesce(c("kin_details"), F.array().cast("array<string>")), lambda x: S.kin_canon(x) == S.kin_canon(_v()))
    kin = F.lower(_v()).isin(*V.KIN_GENDER)
    bound = F.regexp_like(c("before"), F.concat(F.lit(r"(?i)\b"), F.lower(_v()), F.lit(r",?\s*$")))
    return _must(said | F.when(kin, bound).otherwise(F.contains(F.lower(c("around")), F.lower(_v()))))


@register_checker("subtype_corroborated", "subtype_person")
def _() -> Column:
    family = (F.size(F.coalesce(c("kin_details"), F.array().cast("array<string>"))) > 0) | c("before").rlike(rf"(?i)\b(?:{V.KIN}),?\s*$")
    return F.when(_v().startswith("PUBLIC_FIGURE"), "na").when(_v() == "FAMILY", _must(family)).when(_v() == "PROFESSIONAL", _must(c("around").rlike(_CUE))).otherwise("fail")


# --- ethnicity ---
@register_checker("label_is_known_ethnonym", "ethnicity")
def _() -> Column:
    return _must(S.ethnonym(_v()).isNotNull())


def _label() -> Column:
    return F.concat(F.lit(r"(?i)\b"), F.regexp_replace(_v(), r"[-\s]", r"[- ]"), F.lit(r"\b"))


@register_checker("label_stated_in_transcript", "ethnicity")
def _() -> Column:
    return _must(F.regexp_like(c("doc_text"), _label()))


@register_checker("attributed_to_this_person", "ethnicity")
def _() -> Column:
    return _must(F.regexp_like(F.when(c("category") == "SPEAKER", c("subject_text")).otherwise(c("around")), _label()))


# --- places ---
@register_checker("type_in_enum", "subtype_location")
def _() -> Column:
    return _must(S.place_bucket(_v()).isNotNull())


@register_checker("type_corroborated", "subtype_location")
def _() -> Column:
    cue = F.regexp_like(c("around"), F.concat(F.lit(r"(?i)\b"), F.lower(_v()), F.lit(r"\b")))
    return F.when(c("gaz_type").isNotNull(), _must(S.place_bucket(c("gaz_type")) == S.place_bucket(_v()))).when(cue, "ok").otherwise("na")


@register_checker("parent_no_placeholder", "location_parent")
def _() -> Column:
    return _must(~S.is_placeholder(_v()))


@register_checker("parent_not_self", "location_parent")
def _() -> Column:
    return _must(~F.exists("forms", lambda x: F.lower(x) == F.lower(F.trim(F.split_part(_v(), F.lit(","), F.lit(1))))))


@register_checker("parent_resolves", "location_parent")
def _() -> Column:
    return tri(c("parent_known").isNotNull(), c("parent_known"))


@register_checker("keep_only_if_broad_place", "replace_location")
def _() -> Column:
    broad = (c("category") != "INSTITUTION") & F.lower(c("place_type")).isin(*V.BROAD_PLACES) & ~F.exists("forms", lambda x: F.lower(x).isin(*V.AMBIGUOUS_PLACES))
    return tri(_keep(), F.coalesce(broad, F.lit(False)))


@register_checker("keep_rests_on_a_verified_type", "replace_location")
def _() -> Column:
    return tri(_keep(), F.coalesce(c("type_verified"), F.lit(False)))


# --- dates ---
@register_checker("iso_valid", "resolved_value")
def _() -> Column:
    return _must(F.year(S.iso_date(_v())).between(1850, c("year_limit") + 1))


@register_checker("granularity_respected", "resolved_value")
def _() -> Column:
    return tri(S.granularity(c("text")) == "year", F.date_format(S.iso_date(_v()), "MM-dd") == "01-01")


@register_checker("not_after_interview", "resolved_value")
def _() -> Column:
    return tri(c("interview_date").isNotNull(), S.iso_date(_v()) <= c("interview_date"))


@register_checker("dob_plausible", "resolved_value")
def _() -> Column:
    years = F.date_diff(c("interview_date"), S.iso_date(_v())) / 365.25
    return tri((c("category") == "DATE_OF_BIRTH") & c("interview_date").isNotNull(), (years > 0) & (years < 120))


@register_checker("anchor_table_not_contradicted", "resolved_value")
def _() -> Column:
    return tri(S.anchor_date(c("text")).isNotNull(), F.abs(F.date_diff(S.iso_date(_v()), S.anchor_date(c("text")))) <= 3)


@register_checker("is_real_public_event", "shiftable")
def _() -> Column:
    return tri(_keep(), S.anchor(c("text")).isNotNull() | (c("category") == "DATE_ANCHOR") & c("event").isNotNull() & c("resolved").isNotNull())


@register_checker("keep_only_if_public_event", "replace_date")
def _() -> Column:
    return tri(_keep(), S.anchor(c("text")).isNotNull())


@register_checker("keep_is_not_a_local_event", "replace_date")
def _() -> Column:
    return tri(_keep(), ~F.coalesce(S.anchor(c("text")).isin(*V.LOCAL_ANCHORS), F.lit(False)))


@register_checker("source_hedge_agrees", "approximate")
def _() -> Column:
    hedged = c("text").rlike(rf"(?i)\b(?:{V.HEDGES})\b") | F.right(c("before"), F.lit(20)).rlike(rf"(?i)\b(?:{V.HEDGES})\s+(?:in\s+|the\s+)?$")
    exact = (S.granularity(c("text")) == "day") & c("category").isin("DATE_ABSOLUTE", "DATE_OF_BIRTH")
    return F.when(hedged, _must(F.lower(_v()) == "true")).otherwise(tri(exact, F.lower(_v()) == "false"))


@register_checker("age_parser_agrees", "approximate")
def _() -> Column:
    age = S.parse_age(c("text"))
    return tri((c("category") == "AGE") & age["value"].isNotNull(), age["approximate"].cast("string") == F.lower(_v()))


@register_checker("relative_date_is_approximate", "approximate")
def _() -> Column:
    return tri(c("category") == "DATE_RELATIVE", F.lower(_v()) == "true")


@register_checker("anchor_in_table_is_exact", "approximate")
def _() -> Column:
    return tri((c("category") == "DATE_ANCHOR") & S.anchor(c("text")).isNotNull(), F.lower(_v()) == "false")


# --- ages ---
def _int() -> Column:
    return F.when(_v().rlike(r"^-?\d{1,4}$"), _v()).try_cast("int")


@register_checker("plausible_range", "value")
def _() -> Column:
    return _must(_int().between(0, 115))


@register_checker("consistent_with_dob", "value")
def _() -> Column:
    return tri(c("dob").isNotNull() & c("interview_date").isNotNull(), _int() <= F.date_diff(c("interview_date"), c("dob")) / 365.25 + 1)


@register_checker("not_a_measurement", "value")
def _() -> Column:
    return _must(~S.is_measurement(F.left(c("after"), F.lit(24))))


@register_checker("keep_only_if_refuted_as_an_age", "replace_age")
def _() -> Column:
    return tri(_keep(), F.coalesce(c("age_refuted"), F.lit(False)))


@register_checker("keep_not_an_explicit_age_phrase", "replace_age")
def _() -> Column:
    return tri(_keep(), ~F.concat(c("text"), c("after")).rlike(r"(?i)^\W*[\w\s-]*?years?[\s-]+old"))


# --- owner ---
def _mine() -> Column:
    return _v() == "interviewee"


@register_checker("first_person_cue_present", "owner")
def _() -> Column:
    return tri(_mine(), F.coalesce(c("cue"), F.lit(False)))


@register_checker("no_kin_noun_between", "owner")
def _() -> Column:
    return tri(_mine() & c("cue"), ~c("kin_after_cue"))


@register_checker("no_nearer_named_person", "owner")
def _() -> Column:
    return tri(_mine() & c("cue"), ~F.coalesce(c("nearer_person"), F.lit(False)))


@register_checker("no_third_person_subject", "owner")
def _() -> Column:
    return tri(_mine() & c("cue"), ~c("third_person"))


@register_checker("third_party_identifiable", "owner")
def _() -> Column:
    some = c("nearer_person") | (c("cue") & c("kin_after_cue")) | c("possessor") | c("third_person")
    return tri(_v() == "other", F.coalesce(some, F.lit(False)))


@register_checker("not_bound_by_first_person", "owner")
def _() -> Column:
    bound = c("cue") & ~c("kin_after_cue") & ~c("third_person") & ~F.coalesce(c("nearer_person"), F.lit(False))
    return F.when((_v() == "other"), _refute(bound)).otherwise("na")


# --- identifiers ---
@register_checker("kind_is_known", "kind")
def _() -> Column:
    return _must(S.kind_category(_v()).isNotNull())


@register_checker("kind_renormalizes", "kind")
def _() -> Column:
    k = S.kind_category(_v())
    return tri(k.isNotNull(), S.normalise_identifier(k, c("text"))["flag"].isNull())


@register_checker("identifying_only_for_occupation", "identifying")
def _() -> Column:
    return tri(F.lower(_v()) == "true", c("category") == "OCCUPATION")


@register_checker("identifying_not_a_common_occupation", "identifying")
def _() -> Column:
    return tri(F.lower(_v()) == "true", ~F.lower(F.trim(c("text"))).isin(*V.COMMON_JOBS))


# --- age stated with a date ---
@register_checker("anchor_is_a_date_entity", "stated_with")
def _() -> Column:
    return _must(c("anchor_id").isNotNull())


@register_checker("anchor_is_near", "stated_with")
def _() -> Column:
    return tri(c("anchor_id").isNotNull(), c("anchor_near"))


@register_checker("implied_birth_year_plausible", "stated_with")
def _() -> Column:
    y = F.year(c("anchor_date"))
    return tri(y.isNotNull() & c("age_value").isNotNull(), (y - c("age_value")).between(1850, y))


# --- pairs ---
@register_checker("locally_provable", "relation")
def _() -> Column:
    return F.when(c("verdict") == "apply", "ok").when(c("verdict") == "reject", "fail").otherwise("na")


@register_checker("quote_is_transcript_text", "same_person")
def _() -> Column:
    return tri(~S.is_empty(c("quote")), S.quoted_in(c("quote"), c("doc_text")))


def _any_in(forms: str) -> Column:
    return F.exists(c(forms), lambda x: F.contains(F.lower(c("quote")), F.lower(x)))


@register_checker("quote_grounds_the_pair", "same_person")
def _() -> Column:
    a, b = _any_in("a_forms"), _any_in("b_forms")
    cue = c("quote").rlike(r"(?i)\b(?:call|called|calls|goes by|nicknamed|known as|real name)\b")
    return tri(~S.is_empty(c("quote")), (a & b) | ((a | b) & cue))


@register_checker("names_share_a_token", "same_person")
def _() -> Column:
    return tri(~F.coalesce(c("alias_cue"), F.lit(False)), F.arrays_overlap("a_tokens", "b_tokens"))


@register_checker("alias_cue_present", "same_person")
def _() -> Column:
    return tri(~F.arrays_overlap("a_tokens", "b_tokens"), F.coalesce(c("alias_cue"), F.lit(False)))


@register_checker("genders_do_not_conflict", "same_person")
def _() -> Column:
    return tri(c("a_gender").isNotNull() & c("b_gender").isNotNull(), c("a_gender") == c("b_gender"))


@register_checker("not_co_occurring_without_a_cue", "same_person")
def _() -> Column:
    return tri(c("together"), F.coalesce(c("alias_cue"), F.lit(False)))


CONTEXT = {
    **dict.fromkeys("value category text before after around sentence next_sentence doc_text subject_text place_type gaz_type event anchor_id quote a_gender b_gender verdict".split(), "string"),
    **dict.fromkeys("forms kin_details support a_forms b_forms a_tokens b_tokens".split(), "array<string>"),
    **dict.fromkeys("interview_date resolved dob anchor_date".split(), "date"),
    **dict.fromkeys("year_limit age_value".split(), "int"),
    **dict.fromkeys("is_kin parent_known type_verified rule_shiftable age_refuted cue kin_after_cue third_person nearer_person possessor anchor_near together alias_cue".split(), "boolean"),
}


def complete(context: DataFrame) -> DataFrame:
    """context with every column that a checker may read."""
    missing = {k: F.lit(None).cast(t) for k, t in CONTEXT.items() if k not in context.columns}
    return context.withColumns(missing) if missing else context


def outcomes(candidates: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row for each checker of each candidate (keys, field, value, context): check_ord, check, state.

    fields: those that candidates hold, where it is known; only their checkers enter the plan.
    """
    rows = complete(candidates)
    per = F.lit(None).cast("array<struct<ord:int,check:string,state:string>>")
    for field, names in FIELDS.items():
        if fields is not None and field not in fields:
            continue
        own = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("check"), CHECKERS[n]().alias("state")) for i, n in enumerate(names)])
        per = F.when(F.col("field") == field, own).otherwise(per)
    keys = [k for k in ("doc_id", "entity_id", "field", "value") if k in rows.columns]
    out = rows.select(*keys, F.explode(per).alias("x"))
    return out.select(*keys, F.col("x.ord").alias("check_ord"), F.col("x.check").alias("check"), F.col("x.state").alias("state"))


def relation_verdict(source_is_speaker: Column, relation: Column, evidence: Column, public: Column) -> Column:
    """apply, suggest or reject a proposed relation from its evidence sentence."""
    word = S.kin_canon(relation)
    known = word.isin(*sorted({*V.KIN_GENDER, *V.SOCIAL_WORDS}))
    said = F.exists(F.regexp_extract_all(F.lower(evidence), F.lit(rf"\b({V.KIN}|{'|'.join(V.SOCIAL_WORDS)})s?\b"), F.lit(1)), lambda w: S.kin_canon(w) == word)
    first = evidence.rlike(rf"(?i)\b(?:my|our)\s+(?:\w+\s+){{0,2}}?(?:{V.KIN}|{'|'.join(V.SOCIAL_WORDS)})\b")
    return F.when(public, "reject").when(~known, "suggest").when(said & (first == source_is_speaker), "apply").when(said, "suggest").otherwise("reject")
