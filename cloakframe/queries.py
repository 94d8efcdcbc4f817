"""One query for each operator of the engine, with the same as DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions import regex, similarity, validators
from cloakframe.operators import audit, detect, guard, link, patterns, placeholders, resolve
from cloakframe.plans import conversation
from cloakframe.plans.conversation import Thread
from cloakframe.plans.pipeline import Pipeline, restore, with_originals
from cloakframe.schema import detection, held
from cloakframe.sources import cache, messages
from cloakframe.sources.tables import shared_path, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


# ---------------------------------------------------------------- detection

_BAG = [("thtion", "PERSON"), ("retion", "PERSON"), ("ertion", "LOCATION"), ("antion", "ORGANIZATION")]
_BAG_SQL = "(VALUES ('thtion', 'PERSON', 1), ('retion', 'PERSON', 2), ('ertion', 'LOCATION', 3), ('antion', 'ORGANIZATION', 4)) AS bag(word, label, ord)"
#: Words of a text with their first position, for DuckDB: a mark before each word, then the lengths added up.
_WORDS_SQL = r"""
pieces AS (
  SELECT {key}, text, string_split(regexp_replace(text, '([\p{{L}}\p{{N}}_]+)', chr(57344) || '\1' || chr(57345), 'g'), chr(57344)) AS p FROM {table}
),
marked AS (SELECT {key}, unnest(p[2:]) AS piece, unnest(range(2, len(p) + 1)) AS i, length(p[1]) AS lead FROM pieces WHERE len(p) > 1),
words AS (
  SELECT {key}, string_split(piece, chr(57345))[1] AS word,
    CAST(lead + coalesce(sum(length(piece) - 1) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start
  FROM marked
)"""
_DOC_WORDS = "WITH " + _WORDS_SQL.format(key="doc_id", table="documents")


def _found(df: DataFrame, key: str = "doc_id") -> DataFrame:
    d = df.select(key, F.explode("detections").alias("d"))
    return d.select(key, F.col("d.label").alias("label"), F.col("d.text").alias("text"), F.col("d.start").alias("start"), F.col("d.end").alias("end"))


#: All matches with their positions, for DuckDB. Its patterns have no lookaround and ASCII classes; the texts' digits are ASCII.
_MATCHES_SQL = r"""
WITH pieces AS (
  SELECT {key}, string_split(regexp_replace({text}, '({pattern})', chr(57344) || '\1' || chr(57345), 'g'), chr(57344)) AS p FROM {table}
),
marked AS (SELECT {key}, unnest(p[2:]) AS piece, unnest(range(2, len(p) + 1)) AS i, length(p[1]) AS lead FROM pieces WHERE len(p) > 1),
found AS (
  SELECT {key}, '{label}' AS label, string_split(piece, chr(57345))[1] AS text,
    CAST(lead + coalesce(sum(length(piece) - 1) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start
  FROM marked
)
SELECT {key}, label, text, start, CAST(start + length(text) AS INTEGER) AS "end" FROM found"""


def _matches_sql(label: str, table: str = "documents", key: str = "doc_id", text: str = "text", pattern: str | None = None) -> str:
    known = {**patterns.GENERIC, **patterns.US, **patterns.EXTRA_COMMON, **patterns.GENERIC}
    return _MATCHES_SQL.format(key=key, text=text, table=table, label=label, pattern=(pattern or known[label]).replace("'", "''").replace(r"\"", '"'))


def _detect(labels: dict[str, str], **options) -> Query:
    return lambda spark, sf_dir: _found(detect.PatternDetector(labels, **options).add(_docs(spark, sf_dir)))


@query(_matches_sql("EMAIL"))
def detect_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect({"EMAIL": patterns.GENERIC["EMAIL"]})(spark, sf_dir)


@query(_matches_sql("IPV4"))
def detect_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect({"IPV4": patterns.GENERIC["IPV4"]})(spark, sf_dir)


@query(_matches_sql("URL", "pages", "page_id", "url"))
def detect_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return _found(detect.PatternDetector({"URL": patterns.GENERIC["URL"]}).add(pages, "url"), "page_id")


@query(_matches_sql("US_PHONE"))
def detect_us_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect({"US_PHONE": patterns.US["US_PHONE"]})(spark, sf_dir)


@query(_matches_sql("PHONE_INTERNATIONAL"))
def detect_phone_international(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect({"PHONE_INTERNATIONAL": patterns.EXTRA_COMMON["PHONE_INTERNATIONAL"]})(spark, sf_dir)


_SECRET = 'token = "[0-9a-f]{40}"'


@query(_matches_sql("SECRET", pattern=_SECRET))
def detect_custom_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect({"SECRET": _SECRET})(spark, sf_dir)


_CARD_SQL = (
    "WITH all_found AS ("
    + _matches_sql("CREDIT_CARD")
    + """), numbered AS (SELECT *, row_number() OVER () AS id, list_transform(string_split(regexp_replace(text, '[ -]', '', 'g'), ''), lambda c: CAST(c AS INTEGER)) AS d FROM all_found),
digits AS (SELECT id, len(d) AS n, unnest(d) AS x, unnest(range(1, len(d) + 1)) AS i FROM numbered),
good AS (SELECT id FROM digits GROUP BY id HAVING sum(CASE WHEN (n - i) % 2 = 1 THEN CASE WHEN 2 * x > 9 THEN 2 * x - 9 ELSE 2 * x END ELSE x END) % 10 = 0)
SELECT doc_id, label, text, start, "end" FROM numbered JOIN good USING (id)"""
)


@query(_CARD_SQL)
def detect_credit_card_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect({"CREDIT_CARD": patterns.GENERIC["CREDIT_CARD"]}, validators=validators.VALIDATORS)(spark, sf_dir)


@query("SELECT * FROM (" + _matches_sql("EMAIL") + ") UNION ALL SELECT * FROM (" + _matches_sql("IPV4") + ") UNION ALL SELECT * FROM (" + _matches_sql("URL") + ") UNION ALL SELECT * FROM (" + _CARD_SQL + ")")
def detect_generic_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect(patterns.GENERIC, validators=validators.VALIDATORS)(spark, sf_dir)


def _synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))


@query("SELECT c_custkey AS k, CAST(12 AS INTEGER) AS start, CAST(22 AS INTEGER) AS \"end\", '06' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS text FROM customer")
def detect_fr_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _synthetic(spark, sf_dir).withColumn("text", F.concat(F.lit("appelez  le "), F.lit("06"), F.lpad(F.col("k").cast("string"), 8, "0"), F.lit(" ou non")))
    return _found(detect.PatternDetector({"FR_PHONE": patterns.FRANCE["FR_PHONE"]}).add(rows), "k").select("k", "start", "end", "text")


@query(
    "SELECT c_custkey AS k, label, text FROM (SELECT c_custkey, unnest([{'label': 'FR_SIRET', 'text': lpad(CAST(c_custkey AS VARCHAR), 14, '0')},"
    " {'label': 'US_SSN', 'text': printf('%03d-%02d-%04d', c_custkey % 900, c_custkey % 100, c_custkey % 10000)}], recursive := true) FROM customer)"
)
def detect_national_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    text = F.concat(F.lit("no "), F.lpad(k.cast("string"), 14, "0"), F.lit(", "), F.format_string("%03d-%02d-%04d", k % 900, k % 100, k % 10000), F.lit("."))
    rows = _synthetic(spark, sf_dir).withColumn("text", text)
    pack = {"FR_SIRET": patterns.FRANCE["FR_SIRET"], "US_SSN": patterns.US["US_SSN"]}
    return _found(detect.PatternDetector(pack).add(rows), "k").select("k", "label", "text")


_IBAN = "lpad(CAST(c_custkey AS VARCHAR), 18, '0')"
_CHECK = f"98 - CAST({_IBAN} || '131400' AS HUGEINT) % 97"


@query(f"SELECT c_custkey AS k, 'DE' || lpad(CAST(({_CHECK} + c_custkey % 2) AS VARCHAR), 2, '0') || {_IBAN} AS iban, c_custkey % 2 = 0 AS valid FROM customer")
def iban_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    body = F.lpad(k.cast("string"), 18, "0")
    check = 98 - F.concat(body, F.lit("131400")).cast("decimal(30,0)") % 97 + k % 2
    rows = _synthetic(spark, sf_dir).select("k", F.concat(F.lit("DE"), F.lpad(check.cast("int").cast("string"), 2, "0"), body).alias("iban"))
    return rows.withColumn("valid", validators.iban(F.col("iban")))


_NIR_SQL = "'1' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 90 + 1 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0')"


@query(f"SELECT k, body || lpad(CAST(97 - CAST(body AS BIGINT) % 97 AS VARCHAR), 2, '0') AS nir, true AS valid, false AS valid_wrong FROM (SELECT c_custkey AS k, {_NIR_SQL} AS body FROM customer)")
def nir_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    body = F.concat(F.lit("1"), pad(k % 100, 2), pad(k % 12 + 1, 2), pad(k % 90 + 1, 2), pad(k % 1000000, 6))
    key = 97 - body.cast("bigint") % 97
    rows = _synthetic(spark, sf_dir).select("k", F.concat(body, pad(key, 2)).alias("nir"), F.concat(body, pad(key % 97 + 1, 2)).alias("wrong"))
    return rows.select("k", "nir", validators.nir(F.col("nir")).alias("valid"), validators.nir(F.col("wrong")).alias("valid_wrong"))


_EXACT_SQL = _DOC_WORDS + f' SELECT doc_id, label, words.word AS text, start, CAST(start + length(words.word) AS INTEGER) AS "end" FROM words JOIN {_BAG_SQL} ON lower(words.word) = bag.word'


@query(_EXACT_SQL)
def exact_match_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(detect.WordDetector(_BAG).add(_docs(spark, sf_dir)))


@query(_EXACT_SQL)
def exact_match_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    bag = spark.createDataFrame(_BAG, "word string, label string")
    return _found(detect.detect_words_joined(_docs(spark, sf_dir), bag))


@query("SELECT * FROM (" + _matches_sql("EMAIL") + ") UNION ALL SELECT * FROM (" + _EXACT_SQL + ")")
def composite_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = detect.CompositeDetector([detect.PatternDetector({"EMAIL": patterns.GENERIC["EMAIL"]}), detect.WordDetector(_BAG)])
    return _found(both.add(_docs(spark, sf_dir)))


@query(
    "SELECT doc_id, unnest(CASE WHEN n <= 512 THEN [0] ELSE range(0, CAST(ceil((n - 512) / 384.0) AS BIGINT) * 384 + 1, 384) END)::INTEGER AS start, n FROM (SELECT doc_id, length(text)::INTEGER AS n FROM documents)"
)
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return _docs(spark, sf_dir).select("doc_id", F.explode(detect.chunk_starts(n, 512, 128)).alias("start"), n.alias("n"))


@query(_EXACT_SQL)
def chunked_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks' overlap is longer than any word, and what a chunk's edge cuts out of a longer word is filtered by the whole text."""
    return _found(_chunk_checked(spark, sf_dir))


def _chunk_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = detect.ChunkedDetector(detect.WordDetector(_BAG), 512, 128).add(_docs(spark, sf_dir))
    edge = F.lit(f"^[{regex.WORD}]$")
    whole = lambda d: ~F.coalesce(F.regexp_like(F.substring(F.col("text"), d["start"], F.lit(1)), edge) & (d["start"] > 0), F.lit(False)) & ~F.coalesce(F.regexp_like(F.substring(F.col("text"), d["end"] + 1, F.lit(1)), edge), F.lit(False))
    return df.withColumn("detections", F.filter("detections", whole))


@query("SELECT sha, count(*) AS copies, any_value(n) AS n FROM (SELECT sha256(text) AS sha, len(regexp_extract_all(text, '" + patterns.GENERIC["EMAIL"] + "')) AS n FROM documents) GROUP BY sha")
def dedup_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect_distinct(_docs(spark, sf_dir), detect.PatternDetector({"EMAIL": patterns.GENERIC["EMAIL"]}))
    return found.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.count("*").alias("copies"), F.first(F.size("detections").cast("long")).alias("n"))


@query(
    _DOC_WORDS.replace("WITH ", "WITH hits AS (SELECT doc_id, count(*) AS n FROM (" + _EXACT_SQL + ") GROUP BY doc_id), ", 1)
    + " SELECT d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN 1 ELSE coalesce(n, 0) END AS n FROM documents d LEFT JOIN hits USING (doc_id)"
)
def override_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    one = F.array(detection(F.substring("text", 1, 1), F.lit("PERSON"), F.lit(0), F.lit(1), F.lit(1.0)))
    given = docs.where("doc_id % 7 = 0").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), one.alias("detections"))
    return detect.with_overrides(docs, detect.WordDetector(_BAG), given, ("doc_id",)).select("doc_id", F.size("detections").cast("long").alias("n"))


# ---------------------------------------------------------------- spans


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents of five spans each, with positions and confidences made from the key."""
    k = F.col("k")
    one = lambda i: detection(F.lit("x"), F.concat(F.lit("L"), F.lit(str(i))), (k * (i + 3)) % 40, (k * (i + 3)) % 40 + 4 + (k + i) % 9, ((k * (7 + i)) % 20) / 20)
    return _synthetic(spark, sf_dir).withColumn("detections", F.array(*(one(i) for i in range(5))))


_SCORED_SQL = "spans AS (SELECT c_custkey AS k, i, 'L' || i AS label, (c_custkey * (i + 3)) % 40 AS s, (c_custkey * (i + 3)) % 40 + 4 + (c_custkey + i) % 9 AS e, ((c_custkey * (7 + i)) % 20) / 20.0 AS conf FROM customer, range(0, 5) AS r(i))"


@query(f"WITH {_SCORED_SQL} SELECT k, label, CAST(s AS INTEGER) AS start FROM spans WHERE conf >= 0.5")
def span_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("k", F.explode(resolve.above(F.col("detections"), 0.5)).alias("d")).select("k", "d.label", "d.start")


@query(
    f"""WITH RECURSIVE {_SCORED_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY conf DESC, i) AS r FROM spans),
fold AS (
  SELECT k, 0 AS r, CAST([] AS STRUCT(s BIGINT, e BIGINT, label VARCHAR)[]) AS kept FROM (SELECT DISTINCT k FROM spans)
  UNION ALL
  SELECT f.k, x.r, CASE WHEN len(list_filter(f.kept, lambda o: o.s < x.e AND x.s < o.e)) > 0 THEN f.kept
    ELSE list_append(f.kept, {{'s': CAST(x.s AS BIGINT), 'e': CAST(x.e AS BIGINT), 'label': x.label}}) END
  FROM fold f JOIN ranked x ON x.k = f.k AND x.r = f.r + 1
)
SELECT k, o.label AS label, CAST(o.s AS INTEGER) AS start, CAST(o.e AS INTEGER) AS "end" FROM (SELECT k, unnest(kept) AS o FROM fold WHERE r = 5)"""
)
def span_confidence_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("k", F.explode(resolve.by_confidence(F.col("detections"))).alias("d")).select("k", "d.label", "d.start", "d.end")


# ---------------------------------------------------------------- entities


def _words_pipeline(**options) -> Pipeline:
    return Pipeline(detect.WordDetector(_BAG), **options)


_ENTITIES_SQL = (
    _DOC_WORDS
    + f""", hits AS (SELECT doc_id, label, lower(words.word) AS canonical, words.word AS surface, start FROM words JOIN {_BAG_SQL} ON lower(words.word) = bag.word),
entities AS (SELECT doc_id, label, canonical, count(*) AS mentions, min(start) AS first FROM hits GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY first) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS o FROM entities)
"""
)


@query(_ENTITIES_SQL + "SELECT doc_id, CAST(o - 1 AS INTEGER) AS entity_ord, label, canonical, mentions FROM numbered")
def link_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _words_pipeline().find(_docs(spark, sf_dir)).select("doc_id", F.posexplode("entities").alias("entity_ord", "e"))
    return found.select("doc_id", "entity_ord", "e.label", "e.canonical", F.size("e.detections").cast("long").alias("mentions"))


_FIRST_SQL = _DOC_WORDS + ", seed AS (SELECT doc_id, arg_min(word, start) AS word FROM words WHERE lower(word) IN ('thtion', 'retion') GROUP BY doc_id), "


@query(_FIRST_SQL + "hits AS (SELECT words.doc_id, count(*) AS n, min(start) AS first FROM words JOIN seed ON seed.doc_id = words.doc_id AND lower(seed.word) = lower(words.word) GROUP BY words.doc_id) SELECT doc_id, n AS mentions, first FROM hits")
def link_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first mention alone, expansion finds the others."""
    found = detect.WordDetector(_BAG[:2]).add(_docs(spark, sf_dir)).where(F.size("detections") > 0)
    first = F.slice(F.array_sort(F.transform("detections", lambda d: F.struct(d["start"].alias("s"), d.alias("d")))), 1, 1)
    found = found.withColumn("seed", F.transform(first, lambda x: x["d"])).withColumn("e", link.expand(F.col("text"), F.col("seed")))
    return found.select("doc_id", F.size("e").cast("long").alias("mentions"), F.array_min(F.transform("e", lambda d: d["start"])).alias("first"))


@query(_FIRST_SQL + "hits AS (SELECT doc_id FROM seed) SELECT doc_id, 1::BIGINT AS mentions FROM hits")
def link_min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mention shorter than the least length isn't expanded."""
    found = detect.WordDetector(_BAG[:2]).add(_docs(spark, sf_dir)).where(F.size("detections") > 0)
    found = found.withColumn("seed", F.slice("detections", 1, 1))
    return found.select("doc_id", F.size(link.expand(F.col("text"), F.col("seed"), min_length=7)).cast("long").alias("mentions"))


@query(_ENTITIES_SQL + "SELECT doc_id, count(*) AS entities FROM hits GROUP BY doc_id")
def link_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.WordDetector(_BAG).add(_docs(spark, sf_dir)).where(F.size("detections") > 0)
    return found.select("doc_id", F.size(link.unlinked(F.col("detections"))).cast("long").alias("entities"))


@query(_ENTITIES_SQL + "SELECT doc_id, count(*) AS entities, sum(mentions)::BIGINT AS mentions FROM (SELECT doc_id, label, sum(mentions) AS mentions FROM entities GROUP BY doc_id, label) GROUP BY doc_id")
def merge_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of one label are given a shared detection, and so become one."""
    found = _words_pipeline().find(_docs(spark, sf_dir)).where(F.size("entities") > 0)
    extra = lambda e: detection(F.lit("?"), e["label"], F.lit(1_000_000), F.lit(1_000_001), F.lit(1.0))
    shared = F.transform("entities", lambda e: F.struct(e["label"].alias("label"), e["canonical"].alias("canonical"), F.concat(e["detections"], F.array(extra(e))).alias("detections")))
    found = found.withColumn("shared", shared).withColumn("merged", link.merge_shared(F.col("shared")))
    total = F.aggregate("merged", F.lit(0).cast("long"), lambda n, e: n + F.size(e["detections"]) - 1)
    return found.select("doc_id", F.size("merged").cast("long").alias("entities"), total.alias("mentions"))


@query(
    _ENTITIES_SQL
    + """SELECT doc_id, label, canonical, mentions + CASE WHEN canonical = 'thtion' THEN 1 ELSE 0 END AS mentions, CASE WHEN canonical = 'thtion' THEN 'THTION' ELSE first_surface END AS first_text
FROM entities JOIN (SELECT doc_id, label, canonical, arg_min(surface, start) AS first_surface FROM hits GROUP BY ALL) USING (doc_id, label, canonical)"""
)
def link_known_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known mentions stand first in the entity of their text and label; those of another label, or of no entity here, appear nowhere."""
    known = lambda text, label: F.struct(F.lit(label).alias("label"), F.lower(F.lit(text)).alias("canonical"), F.array(detection(F.lit(text), F.lit(label), F.lit(0), F.lit(len(text)), F.lit(1.0))).alias("detections"))
    found = _words_pipeline().find(_docs(spark, sf_dir))
    linked = held(link.link_known(F.col("entities"), F.array(known("THTION", "PERSON"), known("RETION", "LOCATION"), known("nowhere", "PERSON"))))
    rows = found.withColumn("linked", linked).select("doc_id", F.explode("linked").alias("e"))
    return rows.select("doc_id", "e.label", "e.canonical", F.size("e.detections").cast("long").alias("mentions"), F.col("e.detections")[0]["text"].alias("first_text"))


def _leaders(measure: Callable[[Column, Column], Column], threshold: float) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _words_pipeline().find(_docs(spark, sf_dir)).where(F.size("entities") > 0)
        found = found.withColumn("merged", held(link.merge_similar(F.col("entities"), measure, threshold)))
        return found.select("doc_id", F.posexplode("merged").alias("i", "e")).select("doc_id", F.col("i").alias("entity_ord"), "e.label", "e.canonical", F.size("e.detections").cast("long").alias("mentions"))

    return run


@query(
    _ENTITIES_SQL
    + """, leader AS (SELECT doc_id, label, arg_min(canonical, first) AS canonical, min(first) AS first, sum(mentions)::BIGINT AS mentions FROM entities GROUP BY doc_id, label)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS entity_ord, label, canonical, mentions FROM leader"""
)
def fuzzy_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the words, only the two persons have one label; they differ in two of six letters."""
    return _leaders(similarity.levenshtein, 0.6)(spark, sf_dir)


@query()
def fuzzy_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaders(similarity.jaro_winkler, 0.75)(spark, sf_dir)


_PAIRS_SQL = "pairs AS (SELECT c_custkey AS k, lower(c_name) AS a, lower(c_mktsegment) || c_nationkey AS b FROM customer)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of small rows may be one split; the pairs are dealt to all cores, as their similarity costs far more than reading them."""
    pairs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lower("c_name").alias("a"), F.concat(F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("b"))
    return pairs.repartition(4 * spark.sparkContext.defaultParallelism, "k")


@query(f"WITH {_PAIRS_SQL} SELECT k, CAST(round(1e6 * (CASE WHEN a = b THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b), 1) END)) AS BIGINT) AS millionths FROM pairs")
def levenshtein_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("k", F.round(1e6 * similarity.levenshtein(F.col("a"), F.col("b"))).cast("long").alias("millionths"))


@query()
def jaro_winkler_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("k", F.round(1e6 * similarity.jaro_winkler(F.col("a"), F.col("b"))).cast("long").alias("millionths"))


# ---------------------------------------------------------------- tokens


def _tokens(factory: placeholders.Factory) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _words_pipeline().find(_docs(spark, sf_dir)).where(F.size("entities") > 0)
        rows = found.withColumn("tokens", factory.tokens(F.col("entities")))
        return rows.select("doc_id", F.explode(F.arrays_zip(F.transform("entities", lambda e: e["canonical"]).alias("canonical"), F.col("tokens"))).alias("z")).select("doc_id", F.col("z.canonical").alias("canonical"), F.col("z.tokens").alias("token"))

    return run


_HASH = "substring(sha256(canonical || ':' || label{0}), 1, 8)"
_BASE = "CASE label WHEN 'PERSON' THEN 'John Doe' WHEN 'LOCATION' THEN 'Paris' ELSE 'Acme' END"
_OWN = {**placeholders.BASES, "organization": "Acme"}
_FACTORIES: dict[str, tuple[placeholders.Factory, str | None]] = {
    "token_redact": (placeholders.Redact(), "'<<REDACT>>'"),
    "token_label": (placeholders.Label(), "'<<' || label || '>>'"),
    "token_label_counter": (placeholders.LabelCounter(), "'<<' || label || ':' || n || '>>'"),
    "token_redact_counter": (placeholders.RedactCounter(), "'<<REDACT:' || o || '>>'"),
    "token_label_hash": (placeholders.LabelHash(pepper=""), "'<<' || label || ':' || " + _HASH.format("") + " || '>>'"),
    "token_redact_hash": (placeholders.RedactHash(pepper=""), "'<<REDACT:' || " + _HASH.format("") + " || '>>'"),
    "token_salted_hash": (placeholders.LabelHash(salt="salt", pepper="pepper"), "'<<' || label || ':' || " + _HASH.format(" || ':salt:pepper'") + " || '>>'"),
    "token_realistic_counter": (placeholders.RealisticCounter(_OWN), f"{_BASE} || ':' || n"),
    "token_realistic_hash": (placeholders.RealisticHash(_OWN, pepper=""), f"{_BASE} || ':' || " + _HASH.format("")),
    "token_realistic_values": (placeholders.Realistic(), None),
}
for _name, (_factory, _expression) in _FACTORIES.items():
    _run = _tokens(_factory)
    _run.__name__ = _name
    query(None if _expression is None else _ENTITIES_SQL + f"SELECT doc_id, canonical, {_expression} AS token FROM numbered")(_run)


@query(
    "WITH m AS (SELECT doc_id, label, text FROM (" + _matches_sql("EMAIL") + ") UNION ALL SELECT doc_id, label, text FROM (" + _matches_sql("US_PHONE") + ") UNION ALL SELECT doc_id, label, text FROM (" + _matches_sql("IPV4") + r"""))
SELECT doc_id, text, CASE label
  WHEN 'EMAIL' THEN left(text, 1) || repeat('*', strpos(text, '@') - 2) || substring(text, strpos(text, '@'))
  WHEN 'US_PHONE' THEN repeat('*', length(regexp_replace(text, '\D', '', 'g')) - 4) || right(regexp_replace(text, '\D', '', 'g'), 4)
  ELSE left(text, 1) || repeat('*', length(text) - 1) END AS token
FROM m"""
)
def token_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = {"EMAIL": patterns.GENERIC["EMAIL"], "US_PHONE": patterns.US["US_PHONE"], "IPV4": patterns.GENERIC["IPV4"]}
    found = detect.PatternDetector(pack).add(_docs(spark, sf_dir)).where(F.size("detections") > 0).withColumn("entities", link.unlinked(F.col("detections")))
    rows = found.withColumn("tokens", placeholders.Mask().tokens(F.col("entities")))
    return rows.select("doc_id", F.explode(F.arrays_zip(F.transform("detections", lambda d: d["text"]).alias("text"), F.col("tokens"))).alias("z")).select("doc_id", F.col("z.text").alias("text"), F.col("z.tokens").alias("token"))


# ---------------------------------------------------------------- whole pipelines

_ANON_PATTERN = patterns.GENERIC["EMAIL"].replace("'", "''")


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{_ANON_PATTERN}', '<<EMAIL>>', 'g')) AS sha FROM documents")
def anonymize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(detect.PatternDetector({"EMAIL": patterns.GENERIC["EMAIL"]}), factory=placeholders.Label())
    return p.anonymize(_docs(spark, sf_dir)).select("doc_id", F.sha2(F.col("anonymized_text").cast("binary"), 256).alias("sha"))


_COUNTED_CTE = (
    _ENTITIES_SQL
    + r""", cut AS (
  SELECT doc_id, string_agg(
    coalesce(CASE WHEN bag.label IS NOT NULL THEN '<<' || numbered.label || ':' || n || '>>' END, p.word) || p.rest, '' ORDER BY p.i) AS tail
  FROM (SELECT doc_id, i, string_split(piece, chr(57345))[1] AS word, string_split(piece, chr(57345))[2] AS rest FROM marked) p
  LEFT JOIN """
    + _BAG_SQL
    + """ ON lower(p.word) = bag.word LEFT JOIN numbered USING (doc_id) WHERE bag.word IS NULL AND numbered.o IS NULL OR numbered.canonical = lower(p.word) OR (bag.word IS NULL AND numbered.o = 1)
  GROUP BY doc_id
),
counted AS (
  SELECT doc_id, pieces.text, coalesce(e.n, 0) AS n_entities, sha256(coalesce(pieces.p[1], '') || coalesce(cut.tail, '')) AS sha
  FROM pieces LEFT JOIN cut USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM entities GROUP BY doc_id) e USING (doc_id)
)
"""
)
_COUNTED_SQL = _COUNTED_CTE + "SELECT doc_id, n_entities, sha FROM counted"


@query(_COUNTED_SQL)
def anonymize_words_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _words_pipeline().anonymize(_docs(spark, sf_dir))
    return out.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.sha2(F.col("anonymized_text").cast("binary"), 256).alias("sha"))


def _generic() -> Pipeline:
    pack = {k: patterns.GENERIC[k] for k in ("EMAIL", "IPV4", "CREDIT_CARD")} | {"US_PHONE": patterns.US["US_PHONE"]}
    return Pipeline(detect.PatternDetector(pack, validators.VALIDATORS))


@query()
def anonymize_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: cards, addresses and phones of all documents replaced by numbered tokens, in one map stage."""
    return _generic().anonymize(_docs(spark, sf_dir)).select("doc_id", F.size("entities").alias("n_entities"), "anonymized_text")


def _sha(text: str) -> Column:
    return F.sha2(F.col(text).cast("binary"), 256)


@query(_COUNTED_CTE + "SELECT doc_id, n_entities, sha, sha256(text) AS restored_sha, CAST(NULL AS VARCHAR) AS error FROM counted")
def deanonymize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the texts become, and what restoring makes of that. The pipeline runs once: its output is stored."""
    p = _words_pipeline()
    done = stored(p.anonymize(_docs(spark, sf_dir)), "anonymized")
    # Texts that differ only where something was replaced have one output; their mapping is kept by document.
    asked = done.select("doc_id", "anonymized_text", F.size("entities").cast("long").alias("n_entities"))
    back = restore(asked, p.mapping(done, ("doc_id",)), keys=("doc_id",))
    return back.select("doc_id", "n_entities", _sha("anonymized_text").alias("sha"), _sha("restored").alias("restored_sha"), "error")


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN sha256(text) END AS restored_sha, CASE WHEN doc_id % 3 = 0 THEN 'missing' END AS error FROM documents")
def deanonymize_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _generic()
    done = stored(p.anonymize(_docs(spark, sf_dir)), "anonymized")
    asked = done.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("anonymized_text", F.lit("?"))).otherwise(F.col("anonymized_text")).alias("anonymized_text"))
    return restore(asked, p.mapping(done, ("doc_id",)), keys=("doc_id",)).select("doc_id", _sha("restored").alias("restored_sha"), "error")


@query("SELECT item_id, len(regexp_extract_all(text, '" + patterns.GENERIC["EMAIL"] + "')) = 0 AS passed FROM benchmark")
def guard_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = guard.DetectorGuard(detect.PatternDetector({"EMAIL": patterns.GENERIC["EMAIL"]})).add(_table(spark, sf_dir, "benchmark"), "text")
    return checked.select("item_id", "passed")


@query(_COUNTED_CTE + "SELECT doc_id, n_entities, sha, true AS passed FROM counted")
def guard_after_anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _words_pipeline().with_(guard=guard.DetectorGuard(detect.WordDetector(_BAG)))
    return p.anonymize(_docs(spark, sf_dir)).select("doc_id", F.size("entities").cast("long").alias("n_entities"), _sha("anonymized_text").alias("sha"), "passed")


_REPORT_SQL = "SELECT lang, label, count(*) AS entities, sum(mentions)::BIGINT AS mentions FROM (SELECT documents.lang, entities.* FROM entities JOIN documents USING (doc_id)) GROUP BY ROLLUP (lang, label)"


@query(_ENTITIES_SQL + _REPORT_SQL)
def pii_report_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _words_pipeline().find(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return audit.report_by_label(found, "lang").select("lang", "label", "entities", "mentions")


@query(_ENTITIES_SQL + "SELECT doc_id, s.stage AS stage FROM (SELECT doc_id FROM documents), (VALUES ('detect'), ('link'), ('replace')) AS s(stage)")
def audit_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.audit(_words_pipeline().anonymize(_docs(spark, sf_dir)), "doc_id")
    return rows.where(F.col("payload").isNotNull()).select("doc_id", "stage")


@query("SELECT event_id AS k, CASE WHEN event_id % 3 <> 0 THEN event_type END AS value FROM events")
def cache_ttl_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading by key: every third entry is expired."""
    now = [0.0]
    store = cache.TableCache(spark, shared_path(spark, "cache"), clock=lambda: now[0])
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("value"))
    for rest, ttl in ((0, 1.0), (1, 1e18), (2, None)):
        store.put_all(events.where(F.col("k") % 3 == rest), ttl)
    now[0] = 2.0
    return store.get_all(events.select("k", "key")).select("k", F.col("value").cast("string").alias("value"))


# ---------------------------------------------------------------- conversations

_NAMES = Thread("conv_id", "turn", "text")
_TURNS_SQL = (
    "WITH "
    + _WORDS_SQL.replace("{table}", "{{table}}").format(key="conv_id, turn")
    + f""", hits AS (SELECT conv_id, turn, label, lower(words.word) AS canonical, words.word AS surface, start FROM words JOIN {_BAG_SQL} ON lower(words.word) = bag.word),
memory AS (SELECT conv_id, label, canonical, min(turn * 1000000 + start) AS first FROM hits GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, label ORDER BY first) AS n FROM memory),
forms AS (SELECT conv_id, label, canonical, surface, min(turn) AS turn FROM hits GROUP BY ALL)
"""
)
_TURN_SQL = _TURNS_SQL.replace("{table}", "conversations")


def _replaced_sql(text: str, pairs: str) -> str:
    """The text with each of the pairs (a, b: replace a by b) put in. The bag's words have one length and don't overlap, so the order doesn't matter."""
    return f"CASE WHEN len({pairs}) > 0 THEN list_reduce(list_prepend({{'a': {text}, 'b': ''}}, {pairs}), lambda x, y: {{'a': replace(x.a, y.a, y.b), 'b': ''}}).a ELSE {text} END"


_ANON_TURNS_CTE = (
    """, known AS (
  SELECT f.conv_id, f.surface, f.turn, '<<' || f.label || ':' || n || '>>' AS token FROM forms f JOIN numbered USING (conv_id, label, canonical)
),
seen AS (
  SELECT c.conv_id, c.turn, list({'a': k.surface, 'b': k.token}) AS pairs FROM conversations c JOIN known k ON k.conv_id = c.conv_id AND k.turn <= c.turn GROUP BY ALL
),
turns AS (SELECT c.*, """
    + _replaced_sql("c.text", "pairs")
    + """ AS anonymized_text FROM conversations c LEFT JOIN seen USING (conv_id, turn))
"""
)
_ANON_TURNS_SQL = _TURN_SQL + _ANON_TURNS_CTE


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations")


@query(_TURN_SQL + "SELECT conv_id, label, canonical, CAST(first // 1000000 AS BIGINT) AS first_turn, CAST(n AS INTEGER) AS number FROM numbered")
def thread_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _words_pipeline().find(_turns(spark, sf_dir))
    return conversation.memory(found, _NAMES).select(F.col("thread").alias("conv_id"), "label", "canonical", "first_turn", "number")


@query(_TURN_SQL + "SELECT conv_id, canonical, string_agg(surface, '|' ORDER BY surface) AS surfaces FROM forms GROUP BY ALL")
def thread_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _words_pipeline().find(_turns(spark, sf_dir))
    rows = conversation.mentions(found, _NAMES).select("thread", "canonical", "label", "source").distinct()
    return rows.groupBy(F.col("thread").alias("conv_id"), "canonical", "label").agg(F.array_join(F.array_sort(F.collect_list("source")), "|").alias("surfaces")).drop("label")


@query(_ANON_TURNS_SQL + "SELECT conv_id, turn, anonymized_text FROM turns")
def thread_anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.anonymize(_turns(spark, sf_dir), _words_pipeline(), _NAMES).select("conv_id", "turn", "anonymized_text")


@query(_TURN_SQL + "SELECT c.conv_id, c.turn, count(surface) AS known FROM conversations c LEFT JOIN forms f ON f.conv_id = c.conv_id AND f.turn <= c.turn GROUP BY ALL")
def thread_known_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.anonymize(_turns(spark, sf_dir), _words_pipeline(), _NAMES).select("conv_id", "turn", F.size("forms").cast("long").alias("known"))


@query()
def thread_reference_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversation.anonymize_in_reference_order(_turns(spark, sf_dir), _words_pipeline(), _NAMES)
    return out.select(F.col("thread").alias("conv_id"), "turn", "anonymized_text")


@query(_ANON_TURNS_SQL + "SELECT conv_id, turn, sha256(anonymized_text) AS sha, arg_min(text, turn) OVER (PARTITION BY conv_id, anonymized_text) AS restored FROM turns")
def thread_deanonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored original, by thread and hash of the output (of equal outputs, the earliest turn's)."""
    done = stored(conversation.anonymize(_turns(spark, sf_dir), _words_pipeline(), _NAMES), "turns")
    back = with_originals(done, conversation.mapping(done, _NAMES), "anonymized_text", ("conv_id",))
    return back.select("conv_id", "turn", _sha("anonymized_text").alias("sha"), "restored")


@query(_TURN_SQL + ", first AS (SELECT conv_id, label, canonical, arg_min(surface, turn * 1000000 + start) AS surface FROM hits GROUP BY ALL) SELECT conv_id, 'seen ' || surface || '.' AS restored FROM first JOIN numbered USING (conv_id, label, canonical)")
def thread_deanonymize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply of the model that names each token of the thread."""
    p = _words_pipeline()
    found = p.find(_turns(spark, sf_dir))
    known = conversation.forms(found, p, _NAMES)
    replies = known.select(F.col("thread").alias("conv_id"), F.explode(F.array_distinct(F.transform("forms", lambda f: f["token"]))).alias("token"))
    replies = replies.select("conv_id", F.concat(F.lit("seen "), "token", F.lit(".")).alias("text"))
    return conversation.restore_tokens(replies, known, "text", "conv_id").select("conv_id", "restored")


@query(
    _TURNS_SQL.replace("{table}", "(SELECT * FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '')")
    + _ANON_TURNS_CTE
    + "SELECT conv_id, turn, role, CASE WHEN role IN ('user', 'assistant') AND trim(text) <> '' THEN anonymized_text ELSE text END AS content FROM turns"
)
def messages_before_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.before_model(_turns(spark, sf_dir), _words_pipeline(), names=_NAMES).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "content")


def _calls(strategy: messages.ToolStrategy) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Tool calls made of assistant turns, in their thread's tokens; the tool answers with the original."""
        p = _words_pipeline()
        turns = _turns(spark, sf_dir)
        done = conversation.anonymize(turns, p, _NAMES)
        known = conversation.forms(p.find(turns), p, _NAMES)
        calls = done.where("role = 'assistant'").select("conv_id", "turn", F.create_map(F.lit("q"), F.col("anonymized_text")).alias("args"), F.col("text").alias("response"))
        out = messages.tool_calls(calls, known, strategy, thread="conv_id")
        return out.select("conv_id", "turn", F.col("args")["q"].alias("query"), "response")

    return run


#: The tokens are replaced by the form that their entity was first seen as, and the response's forms, of any turn, by tokens.
_CALLS_SQL = (
    _ANON_TURNS_SQL
    + """, first AS (SELECT conv_id, label, canonical, arg_min(surface, turn * 1000000 + start) AS surface FROM hits GROUP BY ALL),
both_ways AS (
  SELECT conv_id, list({'a': '<<' || label || ':' || n || '>>', 'b': surface}) AS back FROM first JOIN numbered USING (conv_id, label, canonical) GROUP BY conv_id
),
every AS (SELECT conv_id, list({'a': surface, 'b': token}) AS forth FROM known GROUP BY conv_id)
SELECT conv_id, turn, """
)
_CALLS_FROM = " FROM turns LEFT JOIN both_ways USING (conv_id) LEFT JOIN every USING (conv_id) WHERE role = 'assistant'"
_QUERY, _RESPONSE = _replaced_sql("anonymized_text", "back") + " AS query", _replaced_sql("text", "forth") + " AS response"
for _name, _strategy, _columns in (
    ("messages_tool_strategy", messages.ToolStrategy.FULL, f"{_QUERY}, {_RESPONSE}"),
    ("messages_tool_inbound", messages.ToolStrategy.INBOUND_ONLY, f"{_QUERY}, text AS response"),
    ("messages_tool_passthrough", messages.ToolStrategy.PASSTHROUGH, "anonymized_text AS query, text AS response"),
):
    _run = _calls(_strategy)
    _run.__name__ = _name
    query(_CALLS_SQL + _columns + _CALLS_FROM)(_run)
