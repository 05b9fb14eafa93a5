"""Queries for the driver. Texts are rendered from columns; the SQL computes the truth from the columns.

So a query that recovers a value through the text is held against an independent expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.functions import scalar as S
from veilgraph.functions import vocab as V
from veilgraph.functions.spans import cut
from veilgraph.operators import checks, entities, rules, text
from veilgraph.plans import arbitration, artifact, build, graph, scoring
from veilgraph.sources.readers import gazetteer_tables
from veilgraph.store import materialize, step

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

GIVEN = ["Alma", "Boyd", "Clara", "Dewey", "Edith", "Floyd", "Greta", "Homer"]
FAMILY = ["Ashby", "Barlow", "Cordero", "Dunmore", "Ellery"]
KIN = ["sister", "brother", "aunt", "uncle", "cousin", "grandmother"]
NICK = ["Dot", "Buster", "Skip"]
ONES = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
TEENS = ["ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
MONTHS = [m.capitalize() for m in V.MONTHS]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))


def _sql(words: list[str], n: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"list_extract([{listed}], CAST(({n}) % {len(words)} + 1 AS INTEGER))"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(
        k.cast("string").alias("doc_id"), "c_custkey", "c_nationkey", _pick(GIVEN, k).alias("given"), _pick(FAMILY, k).alias("family"), _pick(GIVEN, k + 3).alias("other"), _pick(KIN, k).alias("kin"), _pick(NICK, k).alias("nick")
    )


def _mentions(docs: DataFrame, forms: Column) -> DataFrame:
    """Detections of an array of (form, entity_type), numbered."""
    listed = docs.select("doc_id", F.explode(forms).alias("f")).select("doc_id", F.col("f.form").alias("form"), F.col("f.entity_type").alias("entity_type")).distinct()
    found = text.find_forms(docs.select("doc_id", "text"), listed.withColumnRenamed("entity_type", "entity_type"))
    return materialize(text.number_mentions(text.resolve_overlaps(found)), "mentions")


def _form(form: Column, kind: str) -> Column:
    return F.struct(form.alias("form"), F.lit(kind).alias("entity_type"))


def _c(sql: str) -> str:
    """SQL over customers with the rendered names."""
    return f"""WITH c AS (SELECT *, CAST(c_custkey AS VARCHAR) AS doc_id, {_sql(GIVEN, 'c_custkey')} AS given, {_sql(FAMILY, 'c_custkey')} AS family,
      {_sql(GIVEN, 'c_custkey + 3')} AS other, {_sql(KIN, 'c_custkey')} AS kin, {_sql(NICK, 'c_custkey')} AS nick FROM customer) {sql}"""


# --- segmentation ---

_LABELS = "CASE role WHEN 'user' THEN 'INTERVIEWER' WHEN 'assistant' THEN 'NARRATOR' ELSE 'HOST #2' END"


def _interviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    line = F.concat(F.expr(_LABELS), F.lit(": "), F.col("text"))
    parts = rows.groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("p"))
    return parts.select("doc_id", F.array_join(F.transform("p", lambda x: x["l"]), "\n\n").alias("text"))


@query(
    "turns_by_role",
    """SELECT CASE role WHEN 'assistant' THEN 'subject' ELSE 'interviewer' END AS role, count(*) AS n_turns,
       CAST(sum(length(text) + CASE WHEN turn < last THEN 2 ELSE 0 END) AS BIGINT) AS chars
       FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY 1""",
)
def turns_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.turns(_interviews(spark, sf_dir))
    return t.groupBy("role").agg(F.count("*").alias("n_turns"), F.sum(F.col("end") - F.col("body")).cast("bigint").alias("chars"))


@query(
    "speaker_chars",
    f"""SELECT CAST(conv_id AS VARCHAR) AS doc_id, {_LABELS} AS label, count(*) AS n_turns FROM conversations GROUP BY 1, 2""",
)
def speaker_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.turns(_interviews(spark, sf_dir)).groupBy("doc_id", "label").agg(F.count("*").alias("n_turns"))


@query(
    "mask_length",
    f"""SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(sum(length(text) + length({_LABELS}) + 2) + 2 * (count(*) - 1) AS BIGINT) AS chars,
        CAST(sum(CASE WHEN role = 'assistant' THEN length(text) + CASE WHEN turn < last THEN 2 ELSE 0 END ELSE 0 END) AS BIGINT) AS shown
        FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY 1""",
)
def mask_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _interviews(spark, sf_dir)
    m = text.subject_mask(docs, text.turns(docs))
    return m.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.length(F.regexp_replace("text", "\\x00", "")).cast("bigint").alias("shown"))


_SENTENCE_CASES = ["Dr. Ames paid 3.50 for it. He left!", "We met at 4 p.m. on a Sunday. Did you? Yes.", "Wait... nope. Mrs. Poe said \"Go.\" Then we went.", "It cost 12.75. The U.S. Navy came?! Then no one."]
_SENTENCE_COUNTS = [2, 3, 3, 3]


@query(
    "sentence_counts",
    f"""SELECT o_orderkey, CAST(list_extract({_SENTENCE_COUNTS}, CAST(o_orderkey % 4 + 1 AS INTEGER)) AS BIGINT) AS n_sentences,
        CAST(length({_sql([s.replace("'", "''") for s in _SENTENCE_CASES], 'o_orderkey')}) AS BIGINT) AS covered FROM orders""",
)
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    docs = _read(spark, sf_dir, "orders").select(k.cast("string").alias("doc_id"), _pick(_SENTENCE_CASES, k).alias("text"))
    s = text.sentences(docs).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.col("end") - F.col("start")).cast("bigint").alias("covered"))
    return s.select(F.col("doc_id").cast("bigint").alias("o_orderkey"), "n_sentences", "covered")


@query("sentence_tiling")
def sentence_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return text.sentences(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("covered"))


@query("reading_windows")
def reading_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return text.pack_windows(text.sentences(docs))


@query("span_overlaps")
def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") % 40).cast("int")
    spans = li.select(F.col("l_orderkey").cast("string").alias("doc_id"), start.alias("start"), (start + F.col("l_quantity").cast("int") % 12 + 1).alias("end"), F.col("l_discount").alias("score"))
    return text.resolve_overlaps(spans)


@query("nearest_neighbour_turns", "SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS INTEGER) AS turn_ix, CAST(turn + 1 AS INTEGER) AS next_ix FROM conversations WHERE turn < (SELECT max(c.turn) FROM conversations c WHERE c.conv_id = conversations.conv_id)")
def nearest_neighbour_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _interviews(spark, sf_dir)
    t = text.turns(docs)
    points = t.select("doc_id", "turn_ix", F.col("end").alias("pos"))
    hit = text.at_position(points, t.select("doc_id", "start", F.col("turn_ix").alias("next_ix")), "pos", "next_ix")
    return hit.where("next_ix > turn_ix").select("doc_id", "turn_ix", "next_ix")


# --- identifiers, quotes, hashes over the documents ---


@query(
    "email_parts",
    r"""SELECT doc_id, lower(split_part(e, '@', 1)) AS local, lower(split_part(e, '@', 2)) AS domain, count(*) AS n FROM
        (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS e FROM documents) GROUP BY 1, 2, 3""",
)
def email_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), F.lit(0))).alias("e"))
    x = rows.select("doc_id", S.normalise_identifier(F.lit("EMAIL"), F.col("e")).alias("x"))
    return x.groupBy("doc_id", F.col("x.value").alias("local"), F.col("x.detail").alias("domain")).agg(F.count("*").alias("n"))


@query(
    "phone_digits",
    r"""SELECT doc_id, regexp_replace(p, '\D', '', 'g') AS digits, CASE WHEN length(regexp_replace(p, '\D', '', 'g')) IN (10, 11) THEN 'US_PHONE' ELSE 'PHONE' END AS subtype, count(*) AS n FROM
        (SELECT doc_id, unnest(regexp_extract_all(text, '\+1 \(\d{3}\) \d{3}-\d{4}')) AS p FROM documents) GROUP BY 1, 2, 3""",
)
def phone_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\+1 \(\d{3}\) \d{3}-\d{4}"), F.lit(0))).alias("p"))
    x = rows.select("doc_id", S.normalise_identifier(F.lit("PHONE"), F.col("p")).alias("x"))
    return x.groupBy("doc_id", F.col("x.value").alias("digits"), "x.subtype").agg(F.count("*").alias("n"))


@query("text_digests", "SELECT doc_id, sha256(text) AS sha256, CAST(length(text) AS BIGINT) AS chars FROM documents")
def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", S.text_digest(F.col("text")).alias("sha256"), F.length("text").cast("bigint").alias("chars"))


_SQUEEZED = r"lower(trim(regexp_replace({}, '[ \t\n\x0B\f\r]+', ' ', 'g')))"


@query(
    "quotes_of_own_text",
    f"""WITH q AS (SELECT doc_id, text, {_SQUEEZED.format("upper(replace(substr(text, 11, 40), 'ß', 'SS'))")} AS q FROM documents)
        SELECT doc_id, length(q) >= 4 AND contains({_SQUEEZED.format("text")}, q) AS quoted FROM q""",
)
def quotes_of_own_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents")
    return rows.select("doc_id", S.quoted_in(F.upper(F.substring("text", 11, 40)), F.col("text")).alias("quoted"))


# --- names and entities ---

_NAME_CASES = "CASE c_custkey % 6 WHEN 0 THEN 'Mr. ' || family WHEN 1 THEN given || ' ' || family WHEN 2 THEN 'Aunt ' || given WHEN 3 THEN given WHEN 4 THEN 'Father ' || given ELSE 'Dr. ' || given || ' ' || family END"


@query(
    "name_parts",
    _c(
        """SELECT c_custkey, CASE WHEN c_custkey % 6 IN (1, 2, 3, 5) THEN given END AS given_name,
        CASE WHEN c_custkey % 6 IN (0, 1, 5) THEN family END AS surname FROM c"""
    ),
)
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.name_parts(F.expr(_NAME_CASES))
    return _customers(spark, sf_dir).select("c_custkey", p["given"].alias("given_name"), p["surname"].alias("surname"))


@query(
    "honorific_gender",
    _c("SELECT c_custkey, CASE WHEN c_custkey % 6 IN (0, 4) THEN 'M' END AS gender FROM c"),
)
def honorific_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("c_custkey", S.honorific_gender(F.expr(_NAME_CASES)).alias("gender"))


@query(
    "person_groups",
    _c(
        """SELECT doc_id, CAST(2 AS BIGINT) AS n_entities, CAST(4 AS BIGINT) AS n_mentions, given || ' ' || family AS first_person FROM c WHERE c_custkey % 5 <> 0
        UNION ALL SELECT doc_id, CAST(3 AS BIGINT), CAST(3 AS BIGINT), given || ' ' || family FROM c WHERE c_custkey % 5 = 0"""
    ),
)
def person_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _customers(spark, sf_dir)
    plain = F.concat_ws(" ", "given", F.concat("family", F.lit(" met")), "other", F.lit("Zell once. Later"), "given", F.lit("saw Zell again."))
    unclear = F.concat_ws(" ", "given", F.concat("family", F.lit(" met")), "given", F.lit("Zell once. Later"), "given", F.lit("left."))
    docs = docs.withColumn("text", F.when(F.col("c_custkey") % 5 == 0, unclear).otherwise(plain))
    second = F.when(F.col("c_custkey") % 5 == 0, F.concat_ws(" ", "given", F.lit("Zell"))).otherwise(F.concat_ws(" ", "other", F.lit("Zell")))
    forms = F.array(_form(F.concat_ws(" ", "given", "family"), "PERSON"), _form(second, "PERSON"), _form(F.col("given"), "PERSON"), _form(F.lit("Zell"), "PERSON"))
    m = entities.person_entities(_mentions(docs, forms))
    return m.groupBy("doc_id").agg(F.count_distinct("entity_id").alias("n_entities"), F.count("*").alias("n_mentions"), F.min_by("text", "start").alias("first_person"))


@query("alias_links", _c("SELECT doc_id, 'call' AS cue, given || ' ' || family AS base_text, nick AS alias_text FROM c WHERE c_custkey % 2 = 0 UNION ALL SELECT doc_id, 'by', given || ' ' || family, nick FROM c WHERE c_custkey % 2 = 1"))
def alias_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _customers(spark, sf_dir)
    full = F.concat_ws(" ", "given", "family")
    docs = docs.withColumn("text", F.when(F.col("c_custkey") % 2 == 0, F.concat(full, F.lit(" was tall. Everybody called "), "given", F.lit(" "), "nick", F.lit("."))).otherwise(F.concat(full, F.lit(" goes by "), "nick", F.lit("."))))
    m = entities.person_entities(_mentions(docs, F.array(_form(full, "PERSON"), _form(F.col("given"), "PERSON"), _form(F.col("nick"), "NICKNAME")))).withColumn("gender", F.lit(None).cast("string"))
    m = materialize(m, "people")
    pairs = entities.alias_pairs(docs.select("doc_id", "text"), m)
    name = m.groupBy("doc_id", "entity_id").agg(F.max_by("text", F.length("text")).alias("t"))
    a = pairs.join(name.withColumnRenamed("entity_id", "base").withColumnRenamed("t", "base_text"), ["doc_id", "base"]).join(name.withColumnRenamed("entity_id", "alias").withColumnRenamed("t", "alias_text"), ["doc_id", "alias"])
    return a.select("doc_id", "cue", "base_text", "alias_text")


@query(
    "alias_components",
    "SELECT CAST(c_custkey // 100 AS VARCHAR) AS doc_id, count(*) AS n_nodes, count(DISTINCT c_custkey - c_custkey % 5) AS n_groups FROM customer GROUP BY 1",
)
def alias_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = _read(spark, sf_dir, "customer").select(F.floor(k / 100).cast("string").alias("doc_id"), k.alias("a"))
    node = lambda n: F.format_string("n%09d", n)
    pairs = rows.select("doc_id", node(F.col("a")).alias("a"), node(F.when(F.col("a") % 5 == 0, F.col("a")).otherwise(F.col("a") - 1)).alias("b"))
    inside = pairs.where("substring(a, 2, 9) div 100 = substring(b, 2, 9) div 100")
    found = entities.components(inside)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.count_distinct("root").alias("n_groups"))


# --- kinship, gender, ethnicity ---

_KIN_TEXT = {
    0: "concat('NARRATOR: I recall my ', kin, ' ', given, ' well.')",
    1: "concat('NARRATOR: I had an older ', kin, ' named ', given, '.')",
    2: "concat('NARRATOR: Then ', given, ', my ', kin, ', came by.')",
    3: "concat('NARRATOR: Well, ', other, ' was there. His ', kin, ' ', given, ' was too.')",
    4: "concat('NARRATOR: I met ', other, '''s ', kin, ' ', given, ' once.')",
}


def _kin_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = "CASE c_custkey % 5 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _KIN_TEXT.items()) + " END"
    return _customers(spark, sf_dir).withColumn("text", F.expr(case.replace("'''s '", "\"'s \"")))


def _kin_docs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _kin_texts(spark, sf_dir)
    return docs, materialize(entities.person_entities(_mentions(docs, F.array(_form(F.col("given"), "PERSON"), _form(F.col("other"), "PERSON")))), "people")


@query(
    "kin_edges",
    _c("SELECT doc_id, CASE WHEN c_custkey % 5 < 3 THEN 'speaker' ELSE other END AS source_text, given AS target_text, kin AS detail FROM c WHERE c_custkey % 5 <> 1"),
)
def kin_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, m = _kin_docs(spark, sf_dir)
    e = rules.kinship(docs.select("doc_id", "text"), m, build.speakers(docs))
    name = m.groupBy("doc_id", "entity_id").agg(F.min("text").alias("t"))
    named = e.join(name.withColumnRenamed("entity_id", "target").withColumnRenamed("t", "target_text"), ["doc_id", "target"]).join(name.withColumnRenamed("entity_id", "source").withColumnRenamed("t", "source_text"), ["doc_id", "source"], "left")
    return named.select("doc_id", F.coalesce("source_text", F.lit("speaker")).alias("source_text"), "target_text", "detail")


_KIN_SEX = "CASE WHEN kin IN ('sister', 'aunt', 'grandmother') THEN 'F' WHEN kin IN ('brother', 'uncle') THEN 'M' END"


@query("kin_attributes", _c(f"""SELECT doc_id, given AS name, CASE WHEN c_custkey % 5 <> 1 THEN 'FAMILY' END AS subtype, CASE WHEN c_custkey % 5 <> 1 THEN {_KIN_SEX} END AS gender,
        CASE WHEN c_custkey % 5 <> 1 THEN kin END AS role FROM c UNION ALL SELECT doc_id, other, 'FAMILY', NULL, NULL FROM c WHERE c_custkey % 5 >= 3"""))
def kin_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, m = _kin_docs(spark, sf_dir)
    t = docs.select("doc_id", "text")
    a = rules.person_attributes(m, t, rules.kinship(t, m, build.speakers(docs)))
    return a.select("doc_id", F.col("given").alias("name"), "subtype", "gender", "role")


_SELF = ["I am a mother of two.", "I was a boy then.", "Nothing to say.", "I was a girl. They call me grandpa."]


@query("speaker_gender", "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS gender, c_custkey % 4 = 3 AS flagged FROM customer")
def speaker_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _customers(spark, sf_dir).select("doc_id", F.concat(F.lit("INTERVIEWER: I am a father myself.\n\nNARRATOR: "), _pick(_SELF, F.col("c_custkey"))).alias("text"))
    g = rules.speaker_gender(text.subject_mask(docs, text.turns(docs)))
    return g.select("doc_id", "gender", F.col("flag").isNotNull().alias("flagged"))


_ETHNIC = ["My people are Scotch-Irish, you know.", "She always claimed we were Cherokee. We are Irish.", "He was of Filipino descent.", "Nobody ever asked."]


@query("speaker_ethnicity", "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, list_extract(['scotch-irish', 'irish', 'filipino', NULL], CAST(c_custkey % 4 + 1 AS INTEGER)) AS ethnicity FROM customer")
def speaker_ethnicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.speaker_ethnicity(_customers(spark, sf_dir).select("doc_id", _pick(_ETHNIC, F.col("c_custkey")).alias("text")))


_IDENTITY = ["NARRATOR: My name is {g}. I knew Zell.", "INTERVIEWER: Thank you, {g}. Could you go on?\n\nNARRATOR: Yes.", "INTERVIEWER: Tell me about {g}, the neighbour.\n\nNARRATOR: No."]


@query("speaker_identity", _c("SELECT doc_id, given AS name, CASE c_custkey % 3 WHEN 0 THEN 'self_intro' ELSE 'address' END AS kind FROM c WHERE c_custkey % 3 < 2"))
def speaker_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _customers(spark, sf_dir).withColumn("text", F.replace(_pick(_IDENTITY, F.col("c_custkey")), F.lit("{g}"), F.col("given")))
    m = entities.person_entities(_mentions(docs, F.array(_form(F.col("given"), "PERSON"), _form(F.lit("Zell"), "PERSON"))))
    m = materialize(m, "people")
    t = docs.select("doc_id", "text")
    turn_rows = text.turns(t)
    s = rules.identity_support(t, text.subject_mask(t, turn_rows), turn_rows, m)
    name = m.groupBy("doc_id", "entity_id").agg(F.min("text").alias("name"))
    return rules.speaker_candidate(s).join(s, ["doc_id", "entity_id"]).join(name, ["doc_id", "entity_id"]).select("doc_id", "name", "kind")


# --- places ---


def _gazetteer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, r = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    low = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("name"), F.lit("country").alias("type"), F.col("r_name").alias("parent"), F.concat(F.lit("old "), F.lower("n_name")).alias("aliases"))
    return gazetteer_tables(low.union(r.select("r_name", F.lit("region"), F.lit(""), F.lit(""))))


@query(
    "located_in",
    """SELECT CAST(c_custkey AS VARCHAR) AS doc_id, lower(n_name) AS child, lower(r_name) AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 2 = 0""",
)
def located_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    docs = _customers(spark, sf_dir).join(n, F.col("c_nationkey") == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    named = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("old "), F.lower("n_name"))).otherwise(F.col("n_name"))
    forms = docs.select("doc_id", F.explode(F.when(F.col("c_custkey") % 2 == 0, F.array(F.array(named, F.lit("L001")), F.array("r_name", F.lit("L002")))).otherwise(F.array(F.array(named, F.lit("L001"))))).alias("f"))
    found = rules.places(forms.select("doc_id", F.get("f", F.lit(1)).alias("entity_id"), F.array(F.get("f", F.lit(0))).alias("forms")), *_gazetteer(spark, sf_dir))
    key = found.select("doc_id", "entity_id", "gkey")
    e = rules.place_edges(found)
    return e.join(key.withColumnRenamed("entity_id", "source").withColumnRenamed("gkey", "child"), ["doc_id", "source"]).join(key.withColumnRenamed("entity_id", "target").withColumnRenamed("gkey", "parent"), ["doc_id", "target"]).select("doc_id", "child", "parent")


@query("place_replace", "SELECT n_nationkey, n_nationkey % 2 = 1 AS replace FROM nation")
def place_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return _read(spark, sf_dir, "nation").select("n_nationkey", rules.place_replace(F.when(k % 4 == 1, "INSTITUTION").otherwise("LOCATION"), F.when(k % 2 == 0, "country").when(k % 4 == 1, "country").otherwise("city")).alias("replace"))


def _place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "nation")
    up = n.select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"))
    low = c.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"))
    loop = up.select(F.concat(F.lit("r"), F.substring("target", 2, 9)).alias("source"), F.col("target").alias("target")).distinct()
    rows = up.union(low).union(loop)
    return rows.select(F.lit("d").alias("doc_id"), "source", "target", F.lit("LOCATED_IN").alias("relation"), F.lit("").alias("detail"), F.lit(0).alias("seq"))


@query(
    "location_chains",
    """SELECT 'c' || c_custkey AS node, 1 AS depth, 'n' || c_nationkey AS ancestor FROM customer UNION ALL
       SELECT 'c' || c_custkey, 2, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'n' || n_nationkey, 1, 'r' || n_regionkey FROM nation""",
)
def location_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chains(_place_edges(spark, sf_dir)).select("node", "depth", "ancestor")


@query(
    "location_tree",
    """SELECT 'r' || n_regionkey AS root, 2 AS depth, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL
       SELECT 'r' || n_regionkey, 1, count(*) FROM nation GROUP BY 1 UNION ALL SELECT DISTINCT 'r' || n_regionkey, 0, 1 FROM nation""",
)
def location_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tree(_place_edges(spark, sf_dir)).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query(
    "graph_rings",
    """WITH e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders), s AS (SELECT 'c1' AS n UNION ALL SELECT 'c4'),
       one AS (SELECT DISTINCT b AS n FROM e JOIN s ON a = n) SELECT n AS node, 1 AS ring FROM one
       UNION ALL SELECT DISTINCT a, 2 FROM e JOIN one ON b = one.n WHERE a NOT IN (SELECT n FROM s)""",
)
def graph_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "orders").select(F.lit("d").alias("doc_id"), F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target"))
    return graph.neighbours(e, spark.createDataFrame([("d", "c1"), ("d", "c4")], "doc_id string, node string")).select("node", "ring")


# --- dates and ages ---

_DAY = "CAST(o_orderdate AS DATE)"


@query(
    "dates_absolute",
    f"SELECT o_orderkey, {_DAY} AS resolved, TRUE AS has_year FROM orders",
)
def dates_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    month = _pick(MONTHS, F.month(d) - 1)
    shown = F.when(k % 4 == 0, F.concat(month, F.lit(" "), F.dayofmonth(d), F.lit(", "), F.year(d))).when(k % 4 == 1, F.concat(F.dayofmonth(d), F.lit(" "), F.left(month, F.lit(3)), F.lit(" "), F.year(d))).when(k % 4 == 2, F.concat(F.lit("the "), F.dayofmonth(d), F.lit("th of "), month, F.lit(" "), F.year(d))).otherwise(F.date_format(d, "M/d/yyyy"))
    p = S.parse_date(shown)
    return _read(spark, sf_dir, "orders").select("o_orderkey", p["value"].alias("resolved"), p["has_year"].alias("has_year"))


_SEASON_DAYS = {"spring": "03-20", "summer": "06-21", "autumn": "09-22", "winter": "12-21"}


@query("dates_season", f"SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y') || '-' || {_sql(list(_SEASON_DAYS.values()), 'o_orderkey')} AS DATE) AS resolved FROM orders")
def dates_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("the "), _pick(list(_SEASON_DAYS), F.col("o_orderkey")), F.lit(" of "), F.year("o_orderdate"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", S.parse_date(shown)["value"].alias("resolved"))


def _spoken(n: Column) -> Column:
    """21..99 in words."""
    return F.concat(_pick(TENS, F.floor(n / 10) - 2), F.when(n % 10 > 0, F.concat(F.lit("-"), _pick(ONES, n % 10 - 1))).otherwise(F.lit("")))


@query("spoken_years", "SELECT o_orderkey, CAST(CASE WHEN year(o_orderdate) < 2000 THEN year(o_orderdate) END AS INTEGER) AS year, make_date(year(o_orderdate), 1, 1) AS resolved FROM orders")
def spoken_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders")
    said = F.concat(F.lit("nineteen "), _spoken(F.year("o_orderdate") % 100))
    shown = F.concat(F.lit("back in "), F.when(F.year("o_orderdate") < 2000, said).otherwise(F.year("o_orderdate").cast("string")))
    return rows.select("o_orderkey", S.spoken_year(shown).cast("int").alias("year"), S.parse_date(shown)["value"].alias("resolved"))


_UNITS = ["day", "week", "month", "year", "decade"]


@query(
    "dates_relative",
    f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN {_DAY} - CAST((o_orderkey % 9 + 1) * list_extract([1, 7, 30, 365, 3650], CAST(o_orderkey % 5 + 1 AS INTEGER)) AS INTEGER)
        WHEN 1 THEN {_DAY} - 1 WHEN 2 THEN {_DAY} + list_extract([7, 30, 365], CAST(o_orderkey % 3 + 1 AS INTEGER))
        ELSE {_DAY} - CAST(CASE WHEN isodow({_DAY}) = 3 THEN 7 ELSE (isodow({_DAY}) + 4) % 7 END AS INTEGER) END AS resolved FROM orders""",
)
def dates_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    shown = F.when(k % 4 == 0, F.concat(_pick(ONES, k % 9), F.lit(" "), _pick(_UNITS, k % 5), F.lit("s ago"))).when(k % 4 == 1, "just yesterday").when(k % 4 == 2, F.concat(F.lit("next "), _pick(["week", "month", "year"], k % 3))).otherwise("last Wednesday")
    return _read(spark, sf_dir, "orders").select("o_orderkey", S.relative_date(shown, d).alias("resolved"))


@query("anchor_events", "SELECT p_partkey, list_extract([DATE '1969-07-20', DATE '1941-12-07', NULL], CAST(p_partkey % 3 + 1 AS INTEGER)) AS resolved, p_partkey % 3 <> 2 AS fixed FROM part")
def anchor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _pick(["around the moon landing", "after Pearl Harbor", "after the flood"], F.col("p_partkey"))
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.lit("d").alias("doc_id"), F.col("p_partkey").cast("string").alias("entity_id"), F.lit("DATE_ANCHOR").alias("category"), shown.alias("text"), F.lit(None).cast("date").alias("interview_date"))
    return rules.resolve_dates(rows).select("p_partkey", "resolved", (~F.col("shiftable")).alias("fixed"))


@query(
    "ages",
    """SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size ELSE 10 * (p_size % 8 + 2) + list_extract([2, 5, 8, 5], CAST(p_partkey % 4 + 1 AS INTEGER)) END AS INTEGER) AS value, p_partkey % 3 = 2 AS approximate FROM part WHERE p_size BETWEEN 1 AND 99""",
)
def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size"), F.col("p_partkey")
    word = F.when(n < 10, _pick(ONES, F.greatest(n - 1, F.lit(0)))).when(n < 20, _pick(TEENS, F.greatest(n - 10, F.lit(0)))).otherwise(_spoken(F.greatest(n, F.lit(20))))
    decade = F.concat(_pick(["early", "mid", "late", "her"], k), F.lit(" "), _pick(list(V.DECADES), n % 8))
    p = S.parse_age(F.when(k % 3 == 0, F.concat(n, F.lit(" years old"))).when(k % 3 == 1, F.concat(F.lit("maybe "), word)).otherwise(decade))
    return _read(spark, sf_dir, "part").where("p_size BETWEEN 1 AND 99").select("p_partkey", p["value"].cast("int").alias("value"), p["approximate"].alias("approximate"))


@query("age_checks", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'fail' ELSE 'ok' END AS not_a_measurement, CASE WHEN p_size * 4 <= 115 THEN 'ok' ELSE 'fail' END AS plausible_range FROM part")
def age_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = _read(spark, sf_dir, "part").select(F.lit("d").alias("doc_id"), k.cast("string").alias("entity_id"), F.lit("value").alias("field"), (F.col("p_size") * 4).cast("string").alias("value"), _pick([" feet deep", " years old", ", I guess"], k).alias("after"))
    o = checks.outcomes(rows).groupBy("entity_id").pivot("check", ["not_a_measurement", "plausible_range"]).agg(F.first("state"))
    return o.select(F.col("entity_id").cast("bigint").alias("p_partkey"), "not_a_measurement", "plausible_range")


_SPANS = "SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(event_id AS VARCHAR) AS id, CAST(event_id * 7 % 1000 AS INTEGER) AS s, CAST(event_id * 7 % 1000 + 4 AS INTEGER) AS e, CAST(event_id * 7 % 1000 // 100 AS INTEGER) AS x, event_id % 3 = 0 AS is_age FROM events"


def _event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.col("event_id") * 7 % 1000).cast("int")
    return _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.col("event_id").cast("string").alias("entity_id"), s.alias("start"), (s + 4).alias("end"), F.floor(s / 100).cast("int").alias("sent_ix"), F.lit("DATE_ABSOLUTE").alias("category"), (F.col("event_id") % 3 == 0).alias("is_age"))


@query(
    "age_with_nearest_date",
    f"""WITH p AS ({_SPANS}) SELECT doc_id, age_id, date_id, gap FROM (SELECT a.doc_id, a.id AS age_id, d.id AS date_id, greatest(d.s - a.e, a.s - d.e, 0) AS gap,
        row_number() OVER (PARTITION BY a.doc_id, a.id ORDER BY greatest(d.s - a.e, a.s - d.e, 0), d.s, d.id) AS n FROM p a JOIN p d ON a.doc_id = d.doc_id AND a.is_age AND NOT d.is_age AND abs(a.x - d.x) <= 1) WHERE n = 1""",
)
def age_with_nearest_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _event_spans(spark, sf_dir)
    return rules.stated_with(p.where("is_age"), p.where("NOT is_age"))


@query(
    "antecedents",
    f"""WITH p AS ({_SPANS}) SELECT doc_id, id, antecedent FROM (SELECT a.doc_id, a.id, m.id AS antecedent, row_number() OVER (PARTITION BY a.doc_id, a.id ORDER BY m.e DESC, m.id) AS n
        FROM p a JOIN p m ON a.doc_id = m.doc_id AND a.is_age AND NOT m.is_age AND m.e <= a.s) WHERE n = 1""",
)
def antecedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _event_spans(spark, sf_dir)
    points = p.where("is_age").select("doc_id", F.col("entity_id").alias("id"), F.col("start").alias("pos"), F.lit(None).cast("string").alias("none"))
    return entities.entity_before(points, p.where("NOT is_age"), "pos", "none", "antecedent").where("antecedent IS NOT NULL").select("doc_id", "id", "antecedent")


_OWNER = ["I was about {n} then.", "My sister was {n} then.", "She was {n} by then.", "It was {n} or so."]


@query("owners", "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, list_extract(['interviewee', 'other', 'other', ''], CAST(c_custkey % 4 + 1 AS INTEGER)) AS owner FROM customer")
def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _customers(spark, sf_dir).withColumn("text", F.concat(F.lit("INTERVIEWER: I wonder.\n\nNARRATOR: "), F.replace(_pick(_OWNER, F.col("c_custkey")), F.lit("{n}"), F.lit("fourteen"))))
    m = build.all_entities(_mentions(docs, F.array(_form(F.lit("fourteen"), "AGE"))))
    t = docs.select("doc_id", "text")
    turn_rows = text.turns(t)
    e = rules.owner_evidence(m, text.clipped_sentences(text.sentences(t), turn_rows), t)
    return e.select("doc_id", F.array_join("survivors", ",").alias("owner"))


# --- arbitration, votes, scores ---


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    field = _pick(["gender", "replace", "interviewee_gender", "owner"], k)
    pairs = {"gender": ("F", "M"), "replace": ("true", "false"), "interviewee_gender": ("F", "M"), "owner": ("interviewee", "other")}
    one = F.coalesce(*[F.when(field == f, F.lit(a)) for f, (a, _) in pairs.items()])
    two = F.coalesce(*[F.when(field == f, F.lit(b)) for f, (_, b) in pairs.items()])
    choose = lambda n: F.when(n == 0, F.lit(None).cast("string")).when(n == 1, one).otherwise(two)
    rows = _read(spark, sf_dir, "orders").select(F.lit("d").alias("doc_id"), k.cast("string").alias("entity_id"), field.alias("field"), choose(F.col("o_custkey") % 3).alias("rule"), choose(F.floor(F.col("o_custkey") / 3) % 3).alias("llm"), F.lit(True).alias("llm_ran"), F.lit("PERSON").alias("category"), (F.col("o_totalprice").cast("bigint") % 3).alias("mood"), one.alias("one"), two.alias("two"))
    state = lambda n: F.when(n == 0, "ok").when(n == 1, "fail").otherwise("na")
    tries = F.array(F.struct(F.col("one").alias("value"), state(F.col("mood")).alias("state")), F.struct(F.col("two").alias("value"), state((F.col("mood") + 1) % 3).alias("state")))
    o = rows.select("doc_id", "entity_id", "field", F.explode(tries).alias("x")).select("doc_id", "entity_id", "field", "x.value", F.lit(0).alias("check_ord"), F.lit("probe").alias("check"), "x.state")
    return rows, o


_ARBITRATE = """
WITH b AS (SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, list_extract(['gender', 'replace', 'interviewee_gender', 'owner'], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS field,
  list_extract(['F', 'true', 'F', 'interviewee'], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS one, list_extract(['M', 'false', 'M', 'other'], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS two,
  o_custkey % 3 AS r, (o_custkey // 3) % 3 AS l, CAST(trunc(o_totalprice) AS BIGINT) % 3 AS mood FROM orders),
c AS (SELECT *, CASE r WHEN 1 THEN one WHEN 2 THEN two END AS rule, CASE l WHEN 1 THEN one WHEN 2 THEN two END AS llm,
  CASE mood WHEN 0 THEN 'ok' WHEN 1 THEN 'fail' ELSE 'na' END AS s1, CASE mood WHEN 2 THEN 'ok' WHEN 0 THEN 'fail' ELSE 'na' END AS s2 FROM b),
d AS (SELECT *, CASE WHEN llm = one THEN s1 ELSE s2 END AS ls FROM c),
e AS (SELECT *, CASE WHEN rule IS NOT NULL AND llm IS NULL THEN 'keep' WHEN rule IS NULL AND llm IS NULL THEN 'reject' WHEN rule = llm THEN 'confirm' WHEN rule IS NOT NULL THEN 'conflict'
  WHEN ls = 'fail' THEN 'reject' ELSE 'fill' END AS a FROM d),
f AS (SELECT *, CASE WHEN a = 'conflict' AND field = 'interviewee_gender' THEN NULL WHEN a = 'conflict' AND field = 'replace' THEN 'true' WHEN a = 'fill' THEN llm WHEN rule IS NOT NULL THEN rule END AS v,
  field = 'interviewee_gender' AND a IN ('keep', 'reject', 'conflict') OR field = 'replace' AND a IN ('keep', 'reject') AS may FROM e),
g AS (SELECT *, CASE WHEN v = one THEN s1 WHEN v = two THEN s2 END AS vs, CASE WHEN field = 'replace' THEN coalesce(v = 'false', FALSE) ELSE v IS NOT NULL END AS unsafe FROM f),
h AS (SELECT *, unsafe AND vs = 'fail' AS bad FROM g),
i AS (SELECT *, CASE WHEN bad THEN 'conflict' ELSE a END AS action, CASE WHEN bad THEN CASE WHEN field = 'replace' THEN 'true' END ELSE v END AS value,
  CASE WHEN bad THEN field IN ('replace', 'interviewee_gender') WHEN unsafe THEN field IN ('replace', 'interviewee_gender') AND vs <> 'ok' ELSE may END AS blocking FROM h),
j AS (SELECT *, value IS NULL AND rule IS NULL AND field IN ('owner', 'interviewee_gender') AND (s1 = 'ok') <> (s2 = 'ok') AS derived FROM i)
SELECT entity_id, field, CASE WHEN derived THEN 'fill' ELSE action END AS action, CASE WHEN derived THEN CASE WHEN s1 = 'ok' THEN one ELSE two END ELSE value END AS value,
  CASE WHEN derived THEN FALSE ELSE blocking END AS blocking FROM j"""


@query("arbitration", _ARBITRATE)
def arbitration_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arbitration.arbitrate(*_candidates(spark, sf_dir)).select("entity_id", "field", "action", "value", "blocking")


@query("ledger_histogram", f"WITH l AS ({_ARBITRATE.strip()}) SELECT field, action, count(*) AS n FROM l GROUP BY GROUPING SETS ((field, action), (action))")
def ledger_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = scoring.ledger_histogram(arbitration.arbitrate(*_candidates(spark, sf_dir)))
    return h.groupBy("field", F.regexp_replace("label", "_.*", "").alias("action")).agg(F.sum("n").alias("n"))


@query("blocking_by_field", f"WITH l AS ({_ARBITRATE.strip()}) SELECT field, count(*) AS n FROM l WHERE blocking GROUP BY 1")
def blocking_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arbitration.blocking_fields(arbitration.arbitrate(*_candidates(spark, sf_dir))).groupBy("field").agg(F.count("*").alias("n"))


@query("review_board")
def review_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arbitration.review_buckets(arbitration.arbitrate(*_candidates(spark, sf_dir))).groupBy("field", "bucket").agg(F.count("*").alias("n"))


@query("safe_direction", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' OR l_linestatus = 'F' THEN 'true' ELSE 'false' END AS value FROM lineitem WHERE (l_returnflag = 'A') <> (l_linestatus = 'F')")
def safe_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "A").cast("string").alias("rule"), (F.col("l_linestatus") == "F").cast("string").alias("llm")).where("rule <> llm")
    rows = rows.withColumns({"field": F.lit("replace"), "place_type": F.lit(None).cast("string"), "national_event": F.lit(None).cast("boolean"), "age_refuted": F.lit(None).cast("boolean")})
    return rows.select("l_orderkey", "l_linenumber", arbitration.safer(F.col("rule"), F.col("llm")).alias("value"))


@query(
    "votes",
    """WITH n AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, event_type AS value, count(DISTINCT event_id) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
       SELECT doc_id, value, CASE WHEN n > 1 THEN 'high' ELSE 'low' END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f, value DESC) AS r FROM n) WHERE r = 1""",
)
def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.lit("e").alias("entity_id"), F.lit("f").alias("field"), F.col("event_type").alias("value"), F.col("event_id").alias("window_ix"))
    return arbitration.votes(a).select("doc_id", "value", "confidence")


@query("redaction_scores", "SELECT count(*) AS gold, count(*) FILTER (quality = 1 AND toxic = 0) AS leaks, count(*) FILTER (quality = 0 AND toxic = 1) AS over_redacted, count(*) FILTER (quality = toxic) AS correct, count(*) FILTER (quality = 1) AS gold_pos, count(*) FILTER (quality = 0) AS gold_neg FROM labels")
def redaction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.redaction(_read(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("gold_replace"), (F.col("toxic") == 1).alias("replace")))


@query(
    "relation_scores",
    """WITH g AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity < 30), p AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity > 20)
       SELECT 'all' AS layer, (SELECT count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM p)) AS tp, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM g)) AS fp, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM p)) AS missed""",
)
def relation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.lit("aunt").alias("detail"), F.lit("rule").alias("layer"), "l_quantity")
    return scoring.relations(li.where("l_quantity < 30"), li.where("l_quantity > 20")).where("layer = 'all'").select("layer", "tp", "fp", "missed")


@query("micro_average", "SELECT l_returnflag AS metric, CAST(count(*) FILTER (l_linestatus = 'F') AS BIGINT) AS num, count(*) AS den, round(count(*) FILTER (l_linestatus = 'F') / count(*), 9) AS ratio FROM lineitem GROUP BY 1")
def micro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("metric"), (F.col("l_linestatus") == "F").cast("bigint").alias("num"), F.lit(1).cast("bigint").alias("den"))
    return scoring.micro_average(rows).withColumn("ratio", F.round("ratio", 9))


@query("class_balance", "SELECT count(*) FILTER (quality = 1) AS gold_pos, count(*) FILTER (quality <> 1) AS gold_neg FROM labels")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.class_balance(_read(spark, sf_dir, "labels").withColumn("good", F.col("quality") == 1), "good")


# --- end to end ---


def _built(spark: SparkSession, sf_dir: str) -> build.Graph:
    docs = _kin_texts(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" I was fourteen then. It was March 4, 1951. Mail me at kin@mail.example.com.")))
    # Small files would be read by few tasks, each time; so texts are rendered once and lie in as many files as their size asks for.
    docs = step(docs.repartition("doc_id"), "transcripts")
    forms = F.array(_form(F.col("given"), "PERSON"), _form(F.col("other"), "PERSON"), _form(F.lit("fourteen"), "AGE"), _form(F.lit("March 4, 1951"), "DATE_ABSOLUTE"), _form(F.lit("kin@mail.example.com"), "EMAIL"))
    listed = docs.select("doc_id", F.explode(forms).alias("f")).select("doc_id", "f.form", "f.entity_type").distinct()
    found = text.find_forms(docs.select("doc_id", "text"), listed)
    return build.run(docs.select("doc_id", "text", F.lit("1999-06-01").cast("date").alias("interview_date")), found)


@query("graph_edges", _c("SELECT doc_id, relation, detail FROM c, (VALUES ('RELATED_TO'), ('STATED_WITH'), ('ATTRIBUTE_OF'), ('ATTRIBUTE_OF')) t(relation), LATERAL (SELECT CASE WHEN relation = 'RELATED_TO' THEN kin ELSE '' END AS detail) WHERE c_custkey % 5 <> 1 OR relation <> 'RELATED_TO'"))
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).edges.select("doc_id", "relation", "detail")


@query("graph_artifacts")
def graph_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _built(spark, sf_dir)
    a = artifact.build(g.transcripts, g.entities, g.mentions, g.values, g.edges, g.blocking, g.flags)
    return a.select("transcript_id", F.col("source.sha256").alias("sha256"), "interviewee_id", F.size("entities").alias("n_entities"), F.size("edges").alias("n_edges"), F.size("blocking").alias("n_blocking"), F.sha2(F.to_json(F.struct("entities", "edges")), 256).alias("digest"))


@query("span_slices", "SELECT doc_id, substr(text, 6, 20) AS slice FROM documents")
def span_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", cut(F.col("text"), F.lit(5), F.lit(25)).alias("slice"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinship edges of rendered transcripts, arbitrated: the ledger."""
    return _built(spark, sf_dir).ledger.select("doc_id", "entity_id", "field", "action", "value", "source", "blocking")


QUERIES["flagship_ledger"] = flagship
