"""Rule extractors: kinship, gender, ethnicity, roles, places, dates, ages, identifiers, speaker identity.

Mentions carry doc_id, mention_id, start, end, text, entity_type and entity_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions import scalar as S
from veilgraph.functions import vocab as V
from veilgraph.functions.spans import cut, regex_spans
from veilgraph.operators.entities import entity_at, entity_before
from veilgraph.operators.text import as_of

_KIN = rf"{V.MODIFIERS}(?:{V.KIN})"
_TITLE = rf"(?:(?:{'|'.join(t.capitalize() for t in V.TITLE_ONLY)})\.?\s+)?"
_POSSESSOR = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}"
#: Kinship patterns in order of precedence: name, whole match, what comes before the kin word, between it and the target.
KIN_PATTERNS = (
    ("chain", rf"\b(?i:my|our)\s+(?i:{_KIN})['’]s\s+(?i:{_KIN}),?\s+{_TITLE}{V.NAME}", rf"(?i:my|our)\s+(?i:{_KIN})['’]s\s+"),
    ("mine", rf"\b(?i:my|our)\s+(?i:{_KIN}),?\s+{_TITLE}{V.NAME}", r"(?i:my|our)\s+"),
    ("theirs", rf"\b(?i:his|her|their)\s+(?i:{_KIN}),?\s+{_TITLE}{V.NAME}", r"(?i:his|her|their)\s+"),
    ("named", rf"\b(?i:my|our|his|her|their|a|an)\s+(?i:{_KIN})(?:,|\s+(?i:was|is))?\s+(?i:named|called)\s+{_TITLE}{V.NAME}", r"(?i:my|our|his|her|their|a|an)\s+"),
    ("appositive", rf"\b{V.NAME},\s+(?i:my|our|his|her|their)\s+(?i:{_KIN})(?=[,.;:!?]|\s*$)", rf"{V.NAME},\s+(?i:my|our|his|her|their)\s+"),
    ("possessor", rf"\b{_POSSESSOR}['’]s\s+(?i:{_KIN}),?\s+{_TITLE}{V.NAME}", rf"{_POSSESSOR}['’]s\s+"),
)


def kinship(transcripts: DataFrame, mentions: DataFrame, speakers: DataFrame) -> DataFrame:
    """(doc_id, source, target, detail, evidence, pattern): first pattern, then first place wins for a pair.

    speakers(doc_id, speaker_id) own what is said in the first person; 'his', 'her' and 'a ... named'
    go to the person mentioned last before, or to nobody; a possessor is looked up by its own span.
    """
    rows = None
    for rank, (name, whole, lead) in enumerate(KIN_PATTERNS):
        m = transcripts.select("doc_id", F.explode(regex_spans(F.col("text"), whole)).alias("m"))
        value = F.col("m.value")
        head = F.regexp_extract(value, f"^({lead})", 1)
        tail = F.substring(value, F.length(head) + 1, F.length(value))
        kin = F.regexp_extract(tail, rf"^{V.MODIFIERS}((?i:{V.KIN}))\b", 1)
        # In "my mother's sister X" both words tell what X is.
        first = F.regexp_extract(head, rf"({V.KIN}['’]s\s+)$".replace(V.KIN, f"(?i:{V.KIN})"), 1) if name == "chain" else F.lit("")
        if name == "appositive":
            target = F.regexp_extract(value, f"^({V.NAME})", 1)
            t_start = F.col("m.start")
        else:
            target = F.regexp_extract(value, f"({V.NAME})$", 1)
            t_start = F.col("m.end") - F.length(target)
        owner = F.lower(F.regexp_extract(value, r"(?i)\b(my|our|his|her|their)\b", 1))
        possessor = F.regexp_extract(value, f"^({_POSSESSOR})['’]s", 1) if name == "possessor" else F.lit("")
        part = m.select("doc_id", F.lit(rank).alias("pattern_rank"), F.lit(name).alias("pattern"), F.col("m.start").alias("start"), value.alias("evidence"), F.lower(F.concat(first, kin)).alias("detail"), t_start.alias("t_start"), (t_start + F.length(target)).alias("t_end"), owner.alias("owner"), (F.col("m.start") + F.length(possessor)).alias("p_end"))
        rows = part if rows is None else rows.unionByName(part)
    people = mentions.where(F.col("entity_type").isin(*V.PERSONS))
    found = entity_at(rows, people, "t_start", "t_end", "target").where("target IS NOT NULL")
    found = entity_at(found.withColumn("p_start", F.col("start")), people, "p_start", "p_end", "possessor")
    found = entity_before(found, people, "start", "target", "antecedent").join(speakers, "doc_id")
    source = F.when(F.col("pattern") == "possessor", F.col("possessor")).when(F.col("owner").isin("my", "our"), F.col("speaker_id")).otherwise(F.col("antecedent"))
    edges = found.withColumn("source", source).where("source IS NOT NULL AND source <> target AND detail <> ''")
    w = Window.partitionBy("doc_id", "source", "target").orderBy("pattern_rank", "start")
    return edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("doc_id", "source", "target", "detail", "evidence", "pattern")


_NOUNS = {"F": r"woman|girl|lady|mother|mom|mama|grandmother|grandma|daughter|sister|widow|housewife", "M": r"man|boy|guy|gentleman|father|dad|papa|grandfather|grandpa|son|brother|widower"}
_CALLED = {"F": r"mom|mama|mother|grandma|granny|nana", "M": r"dad|daddy|papa|pop|papaw|grandpa|gramps"}


def self_described(masked: Column) -> Column:
    """Genders the speaker applies to themself, as an array."""
    out = []
    for g in ("F", "M"):
        says = rf"(?i)\b(?:I['’]?m|I am|I was|I became|I grew up)\s+(?:a|an|the|her|his|their|your|our|my)\s+(?:\w+\s+){{0,3}}?(?:{_NOUNS[g]})\b"
        called = rf"(?i)\bcall(?:ed|s)?\s+me\s+(?:their\s+)?(?:{_CALLED[g]})\b"
        out.append(F.when(masked.rlike(says) | masked.rlike(called), F.lit(g)))
    return F.array_compact(F.array(*out))


def speaker_gender(masks: DataFrame) -> DataFrame:
    """(doc_id, gender, flag) from masks(doc_id, text); unset and flagged where cues conflict."""
    g = self_described(F.col("text"))
    return masks.select("doc_id", F.when(F.size(g) == 1, F.get(g, F.lit(0))).alias("gender"), F.when(F.size(g) > 1, "conflicting gender cues").alias("flag"))


def person_attributes(mentions: DataFrame, transcripts: DataFrame, kin: DataFrame) -> DataFrame:
    """(doc_id, entity_id, given, surname, subtype, replace, gender, role): public figures keep their name
    unless something personal is said of them, and get no further defaults."""
    people = mentions.where(F.col("entity_type").isin(*V.PERSONS))
    longest = people.groupBy("doc_id", "entity_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("name"), F.array_distinct(F.collect_list(F.lower("text"))).alias("forms"), F.array_distinct(F.transform(F.collect_list("text"), S.honorific_gender)).alias("titles"))
    near = people.join(transcripts.select("doc_id", F.col("text").alias("t")), "doc_id")
    around = cut(F.col("t"), F.greatest(F.lit(0), F.col("start") - 60), F.col("end") + 60)
    before = cut(F.col("t"), F.greatest(F.lit(0), F.col("start") - 24), F.col("start"))
    after = cut(F.col("t"), F.col("end"), F.col("end") + 40)
    cue = rf"(?i)\b({'|'.join(V.PROFESSIONAL_CUES)})\b"
    cues = near.groupBy("doc_id", "entity_id").agg(
        F.bool_or(around.rlike(cue)).alias("professional"),
        F.min_by(F.lower(F.regexp_extract(around, cue, 1)), F.when(around.rlike(cue), F.col("start"))).alias("cue"),
        F.bool_or(before.rlike(rf"(?i)\b(?:my|our)\s+(?:{_KIN}\s+)?$|\b(?:named|called)\s+$") | after.rlike(r"(?i)^[^.!?]*no relation")).alias("personal"),
    )
    ends = kin.select("doc_id", F.explode(F.array("source", "target")).alias("entity_id")).distinct().withColumn("kin", F.lit(True))
    towards = kin.groupBy("doc_id", F.col("target").alias("entity_id")).agg(F.min_by("detail", "source").alias("detail"))
    rows = longest.join(cues, ["doc_id", "entity_id"]).join(ends, ["doc_id", "entity_id"], "left").join(towards, ["doc_id", "entity_id"], "left")
    # Columns of their own, as each reader would else have a copy in the plan.
    public = F.exists("forms", lambda f: f.isin(*V.PUBLIC_FIGURES)) & ~F.col("personal") & F.col("kin").isNull()
    rows = rows.withColumns({"__parts": S.name_parts(F.col("name")), "__public": public, "titles": F.array_compact("titles")})
    parts, public, titles = F.col("__parts"), F.col("__public"), F.col("titles")
    return rows.select(
        "doc_id",
        "entity_id",
        parts["given"].alias("given"),
        parts["surname"].alias("surname"),
        F.when(public, "PUBLIC_FIGURE").when(F.col("kin"), "FAMILY").when(F.col("professional"), "PROFESSIONAL").alias("subtype"),
        (~public).alias("replace"),
        F.when(~public, F.coalesce(S.kin_gender(F.col("detail")), F.when(F.size(titles) == 1, F.get(titles, F.lit(0))))).alias("gender"),
        F.when(~public, F.coalesce("detail", F.when(F.col("professional"), F.col("cue")))).alias("role"),
    )


_LABEL = r"[A-Z][a-z]+(?:[-\s][A-Z][a-z]+)?"
_PART = r"(?i:(?:part|half|mostly|full)\s+)?"
ETHNIC_PATTERNS = {
    "first": rf"(?i:\b(?:I['’]?m|I am|I was|we['’]?re|we are|we were|my (?:family|people|folks) (?:is|are|was|were))\s+){_PART}({_LABEL})\b",
    "heritage": rf"{_PART}\b({_LABEL})(?i:\s+(?:descent|heritage|ancestry|blood|stock|immigrants?|refugees?)\b)",
    "as_a": rf"(?i:\bas\s+an?\s+){_PART}({_LABEL})(?i:\s+\w+)",
}


def _labels(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), S.ethnonym)))


def speaker_ethnicity(masks: DataFrame) -> DataFrame:
    """(doc_id, ethnicity): the one known label that the speaker claims, or the one claimed without a hedge."""
    all_ = F.array_distinct(F.concat(*[_labels(F.col("text"), p) for p in ETHNIC_PATTERNS.values()]))
    sure = F.regexp_replace("text", r"(?i)\b(?:claimed|said|supposed|maybe|think|heard|always told)\b[^.!?]{0,90}", " ")
    plain = F.array_distinct(F.concat(*[_labels(sure, p) for p in ETHNIC_PATTERNS.values()]))
    return masks.select("doc_id", F.when(F.size(all_) == 1, F.get(all_, F.lit(0))).when(F.size(plain) == 1, F.get(plain, F.lit(0))).alias("ethnicity"))


def person_ethnicity(mentions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(doc_id, entity_id, ethnicity) of others, from up to 60 characters after their mentions."""
    near = mentions.where(F.col("entity_type").isin(*V.PERSONS)).join(transcripts.select("doc_id", F.col("text").alias("t")), "doc_id")
    after = cut(F.col("t"), F.col("end"), F.col("end") + 60)
    third = _labels(after, rf"(?i:^\W{{0,3}}(?:is|was|were|are)\s+){_PART}({_LABEL})\b")
    found = near.groupBy("doc_id", "entity_id").agg(F.array_distinct(F.flatten(F.collect_list(F.concat(third, _labels(after, ETHNIC_PATTERNS["heritage"]))))).alias("l"))
    return found.where("size(l) = 1").select("doc_id", "entity_id", F.get("l", F.lit(0)).alias("ethnicity"))


_INTRO = rf"\b(?:(?i:my (?:full |real )?name(?:['’]s| is| was)|I['’]?m|I am|(?:they|folks|everybody|people) (?:all )?calls? me|goe?s? by))\s+{_TITLE}({V.NAME})"
_INTRO_BACK = rf"\b({V.NAME})(?i:\s+(?:is|was)\s+what\s+(?:everybody|folks|people|they)\s+calls?\s+me\b|,\s+that['’]?s\s+(?:me|my name)\b)"


def identity_support(transcripts: DataFrame, masks: DataFrame, turn_rows: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, entity_id, kind): persons supported as the speaker by a label, a self-introduction or an address."""
    people = mentions.where(F.col("entity_type").isin(*V.PERSONS))
    labels = turn_rows.where("role = 'subject' AND label <> ''").select("doc_id", F.lower("label").alias("name"))
    by_label = people.join(labels, "doc_id").where(F.array_contains(S.name_tokens(F.col("text")), F.col("name")) | (F.lower("text") == F.col("name"))).select("doc_id", "entity_id", F.lit("label").alias("kind"))
    named = F.concat(F.regexp_extract_all("text", F.lit(_INTRO), F.lit(1)), F.regexp_extract_all("text", F.lit(_INTRO_BACK), F.lit(1)))
    intro = masks.select("doc_id", F.explode(F.transform(named, F.lower)).alias("name"))
    by_intro = people.join(intro, "doc_id").where(F.lower("text") == F.col("name")).select("doc_id", "entity_id", F.lit("self_intro").alias("kind"))
    spoken = people.join(turn_rows.where("role = 'interviewer'").select("doc_id", F.col("start").alias("ts"), F.col("end").alias("te")), "doc_id").where("start >= ts AND start < te").join(transcripts.select("doc_id", F.col("text").alias("t")), "doc_id")
    before, after = cut(F.col("t"), F.greatest(F.lit(0), F.col("start") - 60), F.col("start")), cut(F.col("t"), F.col("end"), F.col("end") + 4)
    sentence = F.concat(F.regexp_extract(before, r"([^?!\n]*)$", 1), F.col("text"), F.regexp_extract(cut(F.col("t"), F.col("end"), F.col("end") + 80), r"^([^.?!\n]*)", 1))
    comma = F.regexp_replace(before, rf"{_TITLE}$", "").rlike(r",\s*$") | after.rlike(r"^\s*,")
    second = sentence.rlike(r"(?i)\b(?:you|your|yours|yourself)\b")
    related = before.rlike(rf"(?i)\b(?:my|your|his|her|their)\s+(?:{_KIN}),?\s*$")
    referred = F.right(before, F.lit(40)).rlike(r"(?i)\b(?:named|called|about|mentioned|know|knew|remember)\b[^.?!]*$")
    titled = (S.honorific(F.col("text")) != "") | before.rlike(rf"(?:{'|'.join(t.capitalize() for t in V.TITLE_ONLY)})\.?\s+$")
    address = ~related & ~referred & F.when(titled, second | comma).otherwise(comma & second)
    by_address = spoken.where(address).select("doc_id", "entity_id", F.lit("address").alias("kind"))
    return by_label.union(by_intro).union(by_address).distinct()


def speaker_candidate(support: DataFrame) -> DataFrame:
    """(doc_id, entity_id): the only supported person; one supported by a label outranks the others."""
    one = support.groupBy("doc_id").agg(F.collect_set("entity_id").alias("all"), F.array_distinct(F.collect_list(F.when(F.col("kind") == "label", F.col("entity_id")))).alias("labelled"))
    pick = F.when(F.size("labelled") == 1, F.get("labelled", F.lit(0))).when((F.size("labelled") == 0) & (F.size("all") == 1), F.get("all", F.lit(0)))
    return one.select("doc_id", pick.alias("entity_id")).where("entity_id IS NOT NULL")


def places(forms: DataFrame, gazetteer: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, entity_id, gkey, type, parent) of forms(doc_id, entity_id, forms): longest form that is known."""
    tries = forms.select("doc_id", "entity_id", "forms", F.posexplode("forms").alias("rank", "form")).withColumn("form", F.lower("form"))
    known = tries.join(aliases, tries["form"] == aliases["alias"], "left").withColumn("k", F.coalesce("name_key", "form"))
    hit = known.join(gazetteer.select("gkey", "type", "parent"), F.col("k") == F.col("gkey"), "left")
    best = hit.groupBy("doc_id", "entity_id").agg(F.min_by(F.struct("gkey", "type", "parent"), F.when(F.col("gkey").isNotNull(), F.col("rank"))).alias("g"), F.first("forms").alias("forms"))
    shortest = F.lower(F.element_at("forms", -1))
    return best.select("doc_id", "entity_id", F.coalesce("g.gkey", shortest).alias("gkey"), F.col("g.type").alias("type"), F.col("g.parent").alias("parent"))


def place_edges(found: DataFrame) -> DataFrame:
    """LOCATED_IN from a place to its parent in the same document; of equal keys the last entity stands."""
    last = found.groupBy("doc_id", "gkey").agg(F.max_by("entity_id", "entity_id").alias("target"))
    child = found.where("parent IS NOT NULL").select("doc_id", F.col("entity_id").alias("source"), F.lower("parent").alias("gkey"), F.concat(F.col("type"), F.lit(" in "), F.col("parent")).alias("detail"))
    return child.join(last, ["doc_id", "gkey"]).where("source <> target").select("doc_id", "source", "target", F.lit("LOCATED_IN").alias("relation"), "detail")


def place_replace(category: Column, kind: Column) -> Column:
    """Broad places may stay; institutions and unknown places are replaced."""
    return ~((category == "LOCATION") & F.coalesce(F.lower(kind).isin(*V.BROAD_PLACES), F.lit(False)))


def resolve_dates(entities: DataFrame) -> DataFrame:
    """entities(doc_id, entity_id, category, text, interview_date) with resolved, shiftable, approximate, flag."""
    c, t = F.col("category"), F.col("text")
    absolute = S.parse_date(t)
    relative = S.relative_date(t, F.col("interview_date"))
    event = S.anchor_date(t)
    resolved = F.when(c == "DATE_ANCHOR", event).when(c == "DATE_RELATIVE", relative).otherwise(absolute["value"])
    flag = (
        F.when((c == "DATE_ANCHOR") & event.isNull(), "unknown event")
        .when((c == "DATE_RELATIVE") & F.col("interview_date").isNull(), "no interview date")
        .when((c == "DATE_RELATIVE") & relative.isNull(), "relative date not understood")
        .when(c.isin("DATE_ABSOLUTE", "DATE_OF_BIRTH") & absolute["value"].isNull(), "date not understood")
        .when(c.isin("DATE_ABSOLUTE", "DATE_OF_BIRTH") & ~t.rlike(r"\b(?:18|19|20)\d\d\b"), "no explicit year")
    )
    return entities.select("*", resolved.alias("resolved"), (~((c == "DATE_ANCHOR") & event.isNotNull())).alias("shiftable"), (c == "DATE_RELATIVE").alias("approximate"), flag.alias("flag"))


def resolve_ages(entities: DataFrame) -> DataFrame:
    age = S.parse_age(F.col("text"))
    return entities.select("*", age["value"].alias("value"), age["approximate"].alias("approximate"), F.when(age["value"].isNull(), "age not understood").alias("flag"))


def stated_with(ages: DataFrame, dates: DataFrame) -> DataFrame:
    """Each age with the nearest date (no birth date) at most one sentence away: doc_id, age_id, date_id, gap.

    ages and dates: (doc_id, entity_id, start, end, sent_ix); ties go to the first date.
    """
    d = dates.where("category <> 'DATE_OF_BIRTH'").select("doc_id", F.col("entity_id").alias("date_id"), F.col("start").alias("ds"), F.col("end").alias("de"), F.col("sent_ix").alias("dx"))
    gap = F.greatest(F.col("ds") - F.col("end"), F.col("start") - F.col("de"), F.lit(0))
    near = ages.join(d, "doc_id").where("abs(sent_ix - dx) <= 1").withColumn("gap", gap)
    w = Window.partitionBy("doc_id", "entity_id").orderBy("gap", "start", "ds", "date_id")
    return near.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("doc_id", F.col("entity_id").alias("age_id"), "date_id", "gap")


def identifiers(entities: DataFrame) -> DataFrame:
    """entities(doc_id, entity_id, category, text) with subtype, value, detail, identifying, flag."""
    return entities.select("*", S.normalise_identifier(F.col("category"), F.col("text")).alias("x")).select(*entities.columns, "x.*")


_FIRST = r"(?i)\b(?:I|I['’](?:m|d|ve|ll)|me|my|mine|myself|we|we['’](?:re|d|ve|ll)|our|ours|us)\b"
_THIRD = r"(?i)(?:^|[.!?]\s+)\W*(?:he|she|they)\b"


def owner_evidence(mentions: DataFrame, clipped: DataFrame, transcripts: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """(doc_id, entity_id, cue, kin_after_cue, third_person, nearer_person, survivors): interviewee if every spoken mention has a first-person cue in its own
    sentence or the four before (same turn, 600 characters) with no kin noun or third person after the
    cue and none of people(doc_id, start, end) between; other if a kin noun, a named person or a third-person
    subject binds it."""
    s = clipped.where("role IN ('subject', 'unknown')").select("doc_id", "turn_ix", F.col("start").alias("ss"), F.col("end").alias("se"))
    at = mentions.join(s, "doc_id").where("start >= ss AND start < se").select(*mentions.columns, "turn_ix", "ss", "se")
    prior = s.select("doc_id", "turn_ix", F.col("ss").alias("p"))
    look = at.join(prior, ["doc_id", "turn_ix"]).where("p <= ss AND start - p <= 600").groupBy(*at.columns).agg(F.sort_array(F.collect_list("p"), asc=False).alias("ps"))
    first = F.least(F.get("ps", F.lit(0)), F.element_at(F.slice("ps", 1, 5), -1))
    rows = look.join(transcripts.select("doc_id", F.col("text").alias("t")), "doc_id").withColumn("before", cut(F.col("t"), first, F.col("start"))).withColumn("sentence", cut(F.col("t"), F.col("ss"), F.col("se")))
    cue = F.col("before").rlike(_FIRST)
    after_cue = F.regexp_extract("before", rf"(?s).*{_FIRST[4:]}(.*)$".replace("(?s)", "(?is)"), 1)
    kin = after_cue.rlike(rf"(?i)\b(?:{V.KIN})\b")
    third = after_cue.rlike(r"(?i)\b(?:he|she|they)\b") | F.col("sentence").rlike(_THIRD)
    rows = rows.select("doc_id", "entity_id", "start", cue.alias("cue"), (cue & kin).alias("kin"), third.alias("third"), F.col("sentence").rlike(_THIRD).alias("subject"), (F.col("start") - F.length(after_cue)).alias("cue_at"))
    if people is None:
        rows = rows.withColumn("nearer", F.lit(False))
    else:
        named = people.select("doc_id", "end", F.col("start").alias("named_at"))
        rows = as_of(rows, named, "start", "end", ["named_at"]).withColumn("nearer", F.col("cue") & F.coalesce(F.col("named_at") >= F.col("cue_at"), F.lit(False)))
    mine = F.col("cue") & ~F.col("kin") & ~F.col("third") & ~F.col("nearer")
    other = F.col("kin") | F.col("nearer") | F.col("subject")
    flags = [F.bool_and("cue").alias("cue"), F.bool_or("kin").alias("kin_after_cue"), F.bool_or("third").alias("third_person"), F.bool_or("nearer").alias("nearer_person")]
    per = rows.groupBy("doc_id", "entity_id").agg(F.bool_and(mine).alias("mine"), F.bool_and(other).alias("other"), *flags)
    return per.select("doc_id", "entity_id", "cue", "kin_after_cue", "third_person", "nearer_person", F.array_compact(F.array(F.when(F.col("mine") & ~F.col("other"), "interviewee"), F.when(F.col("other") & ~F.col("mine"), "other"))).alias("survivors"))


def owner_edges(ledger: DataFrame, speakers: DataFrame) -> DataFrame:
    """ATTRIBUTE_OF to the speaker where the ledger leaves interviewee as the owner."""
    own = ledger.where("field = 'owner' AND value = 'interviewee'").join(speakers, "doc_id")
    return own.select("doc_id", F.col("entity_id").alias("source"), F.col("speaker_id").alias("target"), F.lit("ATTRIBUTE_OF").alias("relation"), F.lit("").alias("detail"))
