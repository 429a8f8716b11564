"""The queries of this subpackage, and SQL for those that SQL can state."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.llm import bpe, exact, interaction, language, lines, mixing, neighbours, periodic, repetition, secrets, simhash, toxicity, urls
from descry.llm.common import SPACE, ship, table

QUERIES, ORACLES = {}, {}


def query(build):
    QUERIES[build.__name__] = lambda spark, sf_dir: build(ship(spark), sf_dir)
    return build


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


#: The rules of the url query.
RULES = [urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"),
         urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/")]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), RULES)


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.learn(docs.where(language.fold(4) != 2))
    found = language.predict(docs, profiles)
    return found.select("doc_id", (language.fold(4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_duplicate_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    earlier = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(2)) == 0
    found = exact.exact_duplicates(docs.where(earlier), docs.where(~earlier))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op9_exact_dedup"] = """
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM n"""


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Trained on the labels of the documents outside the held-out fold."""
    known = table(spark, sf_dir, "labels").where(language.fold(3) != 1)
    return toxicity.train(table(spark, sf_dir, "documents"), known)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return found.select("doc_id", (language.fold(3) == 1).alias("held_out"), "score", "predicted")


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base, counts = F.filter("spans", lambda s: s["kind"] != "crf"), map(number, secrets.KINDS)
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where the checksum of doc_id is divisible by ten, the words from a place on are replaced by repeats
    of the first of them. A null doc_id changes nothing."""
    checksum = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(checksum % 10 == 0, F.filter(F.split("text", SPACE), lambda w: w != ""))
    cut = docs.select("doc_id", "text", words.alias("words"), F.floor(checksum / 10).alias("g"), F.size(words).alias("n"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    cut = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    root = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(root, F.ceil(rest / F.col("p")).cast("int"))), 1, rest)
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_periodic_tails(table(spark, sf_dir, "documents")))
    whole = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # Greatest length / period, compared as whole numbers; runs come by start and period, so the first of equals stays.
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(whole, ""), 256).alias("runs_sha256"),
                         F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


# Equal windows of five words at distance q stand in every run of period q; an unbroken series of them is a run's stretch.
ORACLES["op11_periodic_runs"] = """
WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda crc, code:
    list_reduce([xor(crc, code), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS h
  FROM documents),
g AS (SELECT doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS changed, h // 10 AS g FROM c),
a AS (SELECT *, g % greatest(n, 1) AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT doc_id, n, CASE WHEN changed THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE words END AS words FROM p),
grams AS (SELECT doc_id, n, i, words[i + 1:i + 5] AS gram FROM (SELECT *, unnest(range(n - 4)) AS i FROM w WHERE n >= 6)),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i WHERE 4 * (y.i - x.i) <= x.n),
series AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS s FROM pairs),
found AS (SELECT doc_id, min(i) AS start, max(i) - min(i) + 5 + q AS length, q FROM series GROUP BY doc_id, q, s HAVING max(i) - min(i) + 5 + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM found GROUP BY ALL),
best AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
  first({'start': start, 'length': length, 'period': period} ORDER BY (length // period) DESC, (length % period) / period DESC, start, period) AS b FROM runs GROUP BY doc_id),
gone AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM runs) GROUP BY doc_id),
kept AS (SELECT w.doc_id, CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i - 1)) END AS kept FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(array_to_string(kept, ' '), '')) AS collapsed_sha256 FROM kept LEFT JOIN best USING (doc_id)"""


@query
def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit_orders(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_interaction"] = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
f AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
  doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM w),
m AS (SELECT f.doc_id, part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * coalesce(e, false)::INT AS mask,
  coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM f LEFT JOIN labels l ON f.doc_id = l.doc_id GROUP BY ALL),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM m GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM l p, l q, l r, l s, l t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step)),
g AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(n_good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
  coalesce(sum(n_toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT * EXCLUDE bit, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM g"""


@query
def op12_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op12_embedding_neighbours"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  AND list_dot_product(a.x, b.x) >= 0.95 * sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u),
degree AS (SELECT u AS vec_id, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN degree USING (vec_id)"""
