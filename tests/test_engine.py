"""The engine's stages on small tables, and expressions against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from cloakframe import queries
from cloakframe.errors import MappingMissing, ResidualFound
from cloakframe.functions import regex, register, similarity, validators
from cloakframe.operators import detect, guard, link, patterns, placeholders, replace, resolve
from cloakframe.plans import conversation, pipeline
from cloakframe.plans.conversation import Thread
from cloakframe.plans.pipeline import Pipeline
from cloakframe.schema import DETECTIONS, detections_from_json, detections_json
from cloakframe.sources.cache import TableCache
from cloakframe.sources.client import Client, call_for_each
from cloakframe.sources.messages import ToolStrategy, after_model, before_model, tool_calls

BAG = [("Patrick", "PERSON"), ("Marie", "PERSON"), ("Paris", "LOCATION"), ("France", "LOCATION")]


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_patterns_match_as_in_python(spark):
    texts = ["a@b.co, éa@b.co x", "1.2.3.4 256.1.1.1 é1.2.3.4é", "4111 1111 1111 1111x", "+1 (743) 555-2058", "+33 6 12 34 56 78", "x\x1cy 😀 a@b.fr 😀", "", "FR14 2004 1010 0505 0001 3M02 606", "user@x.org"]
    packs = [patterns.GENERIC, patterns.FRANCE, patterns.US, patterns.EUROPE, patterns.EXTRA_COMMON, patterns.EXTRA_EUROPE, patterns.EXTRA_US]
    for pack in packs:
        got = column(spark, texts, detect.PatternDetector(pack).column)
        for text, found in zip(texts, got, strict=True):
            assert [(d.text, d.label, d.start, d.end) for d in found] == [(m[0], label, m.start(), m.end()) for label, p in pack.items() for m in re.finditer(p, text)]


def test_translation_refuses(spark):
    for bad in ("a*", "(a)?(?(1)b|c)"):
        with pytest.raises(ValueError):
            regex.to_java(bad)
    marked = "" + "x a@b.co" + ""
    assert column(spark, [marked], detect.PatternDetector(patterns.GENERIC).column)[0][0].text == "a@b.co"


def test_words(spark):
    bag = detect.WordDetector([("$100", "MONEY"), ("cat", "ANIMAL"), ("café", "PLACE")])
    got = column(spark, ["category cat", "price: $100 and $200", "café and Café", "cat_x cat"], bag.column)
    assert [[(d.start, d.end) for d in x] for x in got] == [[(9, 12)], [(7, 11)], [(0, 4), (9, 13)], [(6, 9)]]


def test_validators(spark):
    assert column(spark, ["4111-1111-1111-1111", "79927398713", "79927398710", "4", "", None, "0"], validators.luhn) == [True, True, False, False, False, False, False]
    assert column(spark, ["DE89 3704 0044 0532 0130 00", "CH93 0076 2011 6238 5295 7", "DE89 3704 0044 0532 0130 01", "FR14", None], validators.iban) == [True, True, False, False, False]
    assert column(spark, ["1 84 12 76 451 089 46", "295057510800051", "284127645108946", "1 84 13 76 451 089 46", None], validators.nir) == [True, True, False, False, False]


def plain_jaro_winkler(a, b, weight=0.1):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    window, used, chars = max(max(len(a), len(b)) // 2 - 1, 0), [], []
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if b[j] == c and j not in used:
                used.append(j)
                chars.append(c)
                break
    if not used:
        return 0.0
    moved = sum(b[j] != c for j, c in zip(sorted(used), chars, strict=True)) / 2
    m = len(used)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro)


def test_similarities(spark):
    r = random.Random(1)
    pairs = [("".join(r.choice("abc") for _ in range(r.randint(0, 8))), "".join(r.choice("abc") for _ in range(r.randint(0, 8)))) for _ in range(300)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    for row in rows.select("a", "b", similarity.jaro_winkler(F.col("a"), F.col("b")).alias("s"), similarity.levenshtein(F.col("a"), F.col("b")).alias("l")).collect():
        assert row.s == pytest.approx(plain_jaro_winkler(row.a, row.b))
        assert (row.l == 1) == (row.a == row.b)


def test_jaro_winkler_of_odd_texts(spark):
    pairs = [("", ""), ("", "ab"), ("a\ue000b", "\ue000ab"), ("\ue000\ue001\ue002", "\ue002\ue001\ue000x"), ("\U0001f600bé", "bé\U0001f600"), ("aaaa", "aa"), ("martha", "marhta"), ("ab" * 40, "ba" * 30)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    for row in rows.select("a", "b", similarity.jaro_winkler(F.lower("a"), F.lower("b")).alias("s")).collect():
        assert row.s == pytest.approx(plain_jaro_winkler(row.a, row.b))
    nulls = spark.createDataFrame([(None, "a"), ("a", None), (None, None)], "a string, b string")
    assert [r.s for r in nulls.select(similarity.jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect()] == [0.0] * 3


def test_matches_of_long_texts(spark):
    import time

    def took(texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1).select("text", regex.find_all(F.col("text"), r"(?d)[\p{L}\p{N}_]+").alias("m"))
        began = time.time()
        found = rows.collect()
        for row in found:
            assert [(m.text, m.start, m.end) for m in row.m] == [(m[0], m.start(), m.end()) for m in re.finditer(r"\w+", row.text)]
        return time.time() - began

    def words(n):
        return " ".join(("é" * (i % 3) + f"w{i}" if i % 50 else "\ue000b \U0001f600") if i < 300 else f"w{i}," for i in range(n))

    took([words(n) for n in (1, 2, 15, 16, 17, 255, 256, 257, 300)])
    short = took([f"w{i}, é{i} " * 1000 for i in range(12)])
    assert took(["w1, é1 " * 12000]) < 5 * short


def test_pairs_of_one_split_are_dealt_to_all_cores(spark, sf):
    assert spark.read.parquet(f"{sf}/customer.parquet").rdd.getNumPartitions() == 1
    assert queries.QUERIES["jaro_winkler_similarity"](spark, sf).rdd.getNumPartitions() >= 4
    assert queries.QUERIES["levenshtein_similarity"](spark, sf).rdd.getNumPartitions() >= 4


def spans(*rows):
    return [{"text": t, "label": label, "start": s, "end": e, "confidence": c} for t, label, s, e, c in rows]


def test_greedy_resolution(spark):
    chain = spans(("a", "A", 0, 10, 0.5), ("b", "B", 8, 18, 0.9), ("c", "C", 16, 25, 0.6))
    touching = spans(("a", "A", 5, 9, 0.5), ("b", "B", 0, 5, 0.5))
    tie = spans(("a", "A", 0, 5, 0.5), ("b", "B", 2, 7, 0.5))
    got = column(spark, [chain, touching, tie, []], resolve.by_confidence, DETECTIONS)
    assert [[d.text for d in x] for x in got] == [["b"], ["b", "a"], ["a"], []]
    assert [len(x) for x in column(spark, [chain], lambda c: resolve.above(c, 0.6), DETECTIONS)] == [2]


def test_chunks(spark):
    text = "." * 19 + "Patrick " + "." * 18
    found = column(spark, [text, "Patrick", None], detect.ChunkedDetector(detect.WordDetector(BAG), 30, 15).column)
    assert [[(d.start, d.end) for d in x] for x in found] == [[(19, 26)], [(0, 7)], []]
    for size, overlap in ((0, 0), (5, -1), (5, 5)):
        with pytest.raises(ValueError):
            detect.ChunkedDetector(detect.WordDetector(BAG), size, overlap)


def test_callable_detector(spark):
    made = detect.model_detector("transformers", lambda: lambda t: [{"entity_group": "PER", "start": 0, "end": 3, "score": 0.5}, {"entity": "X", "start": 0, "end": 1, "score": 0.4}], {"PER": "PERSON"})
    got = column(spark, ["Bob is", "", None], made.column)
    assert [[(d.text, d.label, d.confidence) for d in x] for x in got] == [[("Bob", "PERSON", 0.5)], [], []]
    with pytest.raises(ValueError):
        detect.label_map({"a": "X", "b": "X"})
    assert detect.rows_of_pairs("Bob and Bobby, bob", [("Bob", "P"), ("Eve", "P")]) == [("Bob", "P", 0, 3, 1.0), ("bob", "P", 15, 18, 1.0)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, "Patrick est gentil. patrick habite à Paris 😀 avec Marie."), (2, ""), (3, None), (4, "rien")]
    return spark.createDataFrame(rows, "doc_id int, text string")


@pytest.mark.parametrize("factory", [placeholders.LabelCounter(), placeholders.RedactCounter(), placeholders.LabelHash(pepper=""), placeholders.RedactHash(pepper="x"), placeholders.Realistic()])
def test_round_trip(spark, texts, factory):
    p = Pipeline(detect.WordDetector(BAG), factory=factory, guard=guard.DetectorGuard(detect.WordDetector([("Patrick", "P")])))
    done = p.anonymize(texts)
    out = {r.doc_id: r for r in done.collect()}
    assert "atrick" not in out[1].anonymized_text and out[2].anonymized_text == "" and out[3].anonymized_text is None and out[4].anonymized_text == "rien"
    assert all(r.passed for r in out.values())
    back = {r.doc_id: (r.restored, r.error) for r in pipeline.restore(done.select("doc_id", "anonymized_text", "text"), p.mapping(done)).collect()}
    assert back == {1: (out[1].text, None), 2: ("", None), 3: (None, "missing"), 4: ("rien", None)}


def test_counter_tokens(spark, texts):
    got = Pipeline(detect.WordDetector(BAG)).anonymize(texts).where("doc_id = 1").first().anonymized_text
    assert got == "<<PERSON:1>> est gentil. <<PERSON:1>> habite à <<LOCATION:1>> 😀 avec <<PERSON:2>>."


def test_masks(spark):
    assert column(spark, ["patrick@email.com", "no", "@x.de"], placeholders.mask_email) == ["p******@email.com", "n*", "@****"]
    assert column(spark, ["+1 (555) 123-4567", "12-34"], placeholders.mask_numeric) == ["*******4567", "12-34"]
    assert column(spark, ["Patrick", "P", ""], placeholders.mask_default) == ["P******", "P", ""]
    hashed = spark.range(1).select(placeholders.hashed(F.lit("patrick"), F.lit("PERSON")).alias("h")).first().h
    assert hashed == "8628f8eb"


def test_expansion_and_overlap(spark):
    text = "Jean Dupont et Jean"
    detector = detect.WordDetector([("Jean Dupont", "PERSON"), ("Jean", "PERSON")])
    rows = spark.createDataFrame([(text,)], "text string")
    skip = Pipeline(detector).anonymize(rows).first().anonymized_text
    assert skip == "<<PERSON:1>> et <<PERSON:2>>"
    reference = Pipeline(detector, link=lambda t, d: link.link(t, d, overlap="reference")).anonymize(rows).first().anonymized_text
    assert reference != skip


def test_merging(spark):
    d = {"text": "x", "label": "A", "start": 0, "end": 1, "confidence": 1.0}
    e = {**d, "start": 5, "end": 6}
    entities = [[{"label": "A", "canonical": "x", "detections": [d]}, {"label": "A", "canonical": "y", "detections": [e]}, {"label": "A", "canonical": "z", "detections": [d, e]}]]
    kind = f"array<struct<label:string,canonical:string,detections:{DETECTIONS}>>"
    assert [len(x) for x in column(spark, entities, link.merge_shared, kind)] == [1]
    names = [[{"label": "P", "canonical": c, "detections": [{**d, "start": i}]} for i, c in enumerate(["patrick", "patric", "bob"])]]
    assert [[x.canonical for x in row] for row in column(spark, names, link.merge_similar, kind)] == [["patrick", "bob"]]


def test_replace_longest_first(spark):
    mapping = F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("token")) for a, b in (("Marc", "<1>"), ("Marc Dupont", "<2>"), ("", "<3>"), ("Marc", "<4>"), ("a.c", "<5>"))))
    assert column(spark, ["Marc Dupont, Marc, Marché, abc a.c", None], lambda c: replace.replace_all(c, mapping)) == ["<2>, <1>, <1>hé, abc <5>", None]
    assert column(spark, ["Marché Marc"], lambda c: replace.replace_all(c, mapping, word_boundary=True)) == ["Marché <1>"]


def test_guard_and_errors(spark):
    bad = guard.DetectorGuard(detect.WordDetector(BAG)).add(spark.createDataFrame([("Paris",)], "text string"), "text")
    with pytest.raises(ResidualFound):
        guard.enforce(bad)
    with pytest.raises(ValueError):
        placeholders.check_identity(placeholders.Mask())


def test_json(spark):
    rows = column(spark, [spans(("a", "A", 0, 1, 0.5))], lambda c: detections_from_json(detections_json(c)), DETECTIONS)
    assert rows[0][0].asDict() == {"text": "a", "label": "A", "start": 0, "end": 1, "confidence": 0.5}


@pytest.fixture(scope="module")
def turns(spark):
    rows = [("t", 0, "user", "Bonjour Patrick"), ("t", 1, "user", "Bonjour Marie"), ("t", 2, "assistant", "J'habite en France"), ("t", 3, "user", "France, PATRICK et Patrick"), ("u", 0, "user", "Marie"), ("u", 1, "system", "Marie")]
    return spark.createDataFrame(rows, "thread_id string, turn int, role string, text string")


def test_conversation(spark, turns):
    p = Pipeline(detect.WordDetector(BAG))
    done = conversation.anonymize(turns, p).cache()
    got = {(r.thread_id, r.turn): r.anonymized_text for r in done.collect()}
    assert got[("t", 1)] == "Bonjour <<PERSON:2>>" and got[("t", 3)] == "<<LOCATION:1>>, <<PERSON:1>> et <<PERSON:1>>" and got[("u", 0)] == "<<PERSON:1>>"
    known = conversation.forms(p.find(turns), p, Thread())
    replies = spark.createDataFrame([("t", "assistant", "Bonjour <<PERSON:2>>"), ("t", "assistant", "Ah, <<PERSON:1>>!"), ("t", "system", "<<PERSON:1>>")], "thread_id string, role string, text string")
    assert sorted(r.content for r in after_model(replies, conversation.mapping(done), known).collect()) == ["<<PERSON:1>>", "Ah, Patrick!", "Bonjour Marie"]
    before = {(r.thread_id, r.turn): r.content for r in before_model(turns, p).collect()}
    assert before[("u", 1)] == "Marie" and before[("u", 0)] == "<<PERSON:1>>"
    calls = spark.createDataFrame([("t", {"to": "<<PERSON:1>>"}, "sent to Patrick")], "thread_id string, args map<string,string>, response string")
    full = tool_calls(calls, known, ToolStrategy.FULL).first()
    assert full.args == {"to": "Patrick"} and full.response == "sent to <<PERSON:1>>"
    assert tool_calls(calls, known, ToolStrategy.INBOUND_ONLY).first().response == "sent to Patrick"


def test_reference_order(spark):
    rows = spark.createDataFrame([("t", 0, "Bonjour Patrick"), ("t", 1, "Bob part"), ("t", 2, "Bonjour Patrick")], "thread_id string, turn int, text string")
    p = Pipeline(detect.WordDetector([("Patrick", "PERSON"), ("Bob", "PERSON")]))
    reference = [r.anonymized_text for r in conversation.anonymize_in_reference_order(rows, p).orderBy("turn").collect()]
    assert reference == ["Bonjour <<PERSON:1>>", "<<PERSON:1>> part", "Bonjour <<PERSON:2>>"]
    assert [r.anonymized_text for r in conversation.anonymize(rows, p).orderBy("turn").collect()] == ["Bonjour <<PERSON:1>>", "<<PERSON:2>> part", "Bonjour <<PERSON:1>>"]


def test_stream(spark, turns, tmp_path):
    from cloakframe.streaming import conversation as stream

    turns.write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(turns.schema).json(str(tmp_path / "in"))
    q = stream.anonymize(source, Pipeline(detect.WordDetector(BAG))).writeStream.format("memory").queryName("turns_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.thread, r.turn): r.anonymized_text for r in spark.table("turns_out").collect()}
    assert got[("t", 3)] == "<<LOCATION:1>>, <<PERSON:1>> et <<PERSON:1>>" and len(got) == 6


def test_cache(spark, tmp_path):
    now = [100.0]
    cache = TableCache(spark, str(tmp_path / "cache"), clock=lambda: now[0])
    cache.create()
    cache.multi_set([("n:a", b"1"), ("n:b", b"2")])
    cache.set("x", b"old", ttl=10)
    assert cache.multi_get(["n:b", "?", "n:a"]) == [b"2", None, b"1"] and cache.exists("x")
    now[0] = 111.0
    assert cache.get("x") is None and cache.increment("n:a", 4) == 5
    with pytest.raises(ValueError):
        cache.add("n:a", b"")
    assert cache.set("n:b", b"3", expected=b"9") == 0 and cache.release("n:b", b"2") and not cache.expire("n:b", 5)
    cache.clear("n:")
    assert not cache.exists("n:a")


def test_client(spark):
    def transport(method, url, body):
        if url.endswith("/v1/deanonymize"):
            return 404, {}
        return 200, {"entities": [{"label": "P", "detections": []}, {"label": "P", "detections": [{"text": body["text"]}]}]}

    client = Client("http://x/", transport)
    assert len(client.detect("a")) == 1
    with pytest.raises(MappingMissing):
        client.deanonymize("a")
    rows = spark.createDataFrame([("a",), (None,)], "text string")
    got = {r.text: r.response for r in call_for_each(rows, lambda: Client("http://x", transport), "deanonymize").collect()}
    assert got[None] is None and "error" in got["a"]


def test_registered_functions(spark):
    assert "pii_luhn" in register.register(spark)
    row = spark.sql("SELECT pii_luhn('4111 1111 1111 1111') a, pii_mask('abc') b, pii_token_hash('patrick', 'PERSON', 8) c").first()
    assert (row.a, row.b, row.c) == (True, "a**", "8628f8eb")


def test_native_plan_has_no_shuffle_or_python(spark, texts):
    plan = Pipeline(detect.PatternDetector(patterns.GENERIC, validators.VALIDATORS)).anonymize(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_cache_query_reads_the_cache(spark, sf, monkeypatch):
    asked, get_all = [], TableCache.get_all
    monkeypatch.setattr(TableCache, "get_all", lambda self, keys: asked.append(self.path) or get_all(self, keys))
    got = {r.k: r.value for r in queries.cache_ttl_get(spark, sf).collect()}
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type").collect()
    assert len(asked) == 1 and got == {e.event_id: e.event_type if e.event_id % 3 else None for e in events}


def test_prefilter_of_inline_flags(spark):
    assert regex.needed("secret-[0-9]+") == "secret-" and "secret" not in regex.needed("(?i:secret)-[0-9]+")
    for pattern in ("(?i)secret-[0-9]+", "(?i:secret)-[0-9]+"):
        got = column(spark, ["a SECRET-12", "a secret-3"], detect.PatternDetector({"S": pattern}).column)
        assert [[d.text for d in row] for row in got] == [["SECRET-12"], ["secret-3"]]


def test_no_column_is_lost(spark):
    """Columns named like those that the operators use inside stay as they are."""
    own = {n: f"own {n}" for n in ("sha", "_sha", "_given", "_found", "_entities", "_tokens", "_known", "_done", "_stored", "_thread", "_doc_id", "detected")}
    rows = spark.createDataFrame([{"doc_id": "1", "turn": 1, "text": "Patrick was in Paris", **own}])
    p = Pipeline(detect.WordDetector(BAG))
    done = p.anonymize(rows)
    back = pipeline.restore(done, p.mapping(done, ("doc_id",)), keys=("doc_id",))
    given = rows.selectExpr("doc_id", "sha2(text, 256) AS sha").withColumn("detections", F.array().cast(DETECTIONS))
    outs = {
        "restore": back,
        "originals": pipeline.with_originals(done, p.mapping(done, ("doc_id",)), keys=("doc_id",)),
        "overrides": detect.with_overrides(rows, p.detector, given, ("doc_id",)),
        "distinct": detect.detect_distinct(rows, p.detector),
        "conversation": conversation.anonymize(rows, p, Thread("doc_id")),
    }
    for name, out in outs.items():
        row = out.first().asDict()
        assert {k: row[k] for k in own} == own, name
    assert back.first().restored == outs["originals"].first().restored == "Patrick was in Paris"
    assert outs["overrides"].first().detections == []
    assert len(outs["distinct"].first().detections) == 2


def test_unrelated_detections_column(spark):
    rows = spark.createDataFrame([("Patrick", "mine")], "text string, detections string")
    assert Pipeline(detect.WordDetector(BAG)).anonymize(rows).first().anonymized_text == "<<PERSON:1>>"


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_do_not_repeat_the_detection(spark, sf):
    """Each pattern is in one place of the plan, whatever filters and generators follow."""
    patterns_of = lambda df: optimised(df).count("regexp_replace")
    run = lambda name: patterns_of(queries.QUERIES[name](spark, sf))
    assert run("detect_email") == 1
    assert run("exact_match_dict") == len(queries._BAG)
    entities = patterns_of(Pipeline(detect.WordDetector(queries._BAG)).find(queries._docs(spark, sf)))
    assert run("link_group") == run("fuzzy_levenshtein") == entities
