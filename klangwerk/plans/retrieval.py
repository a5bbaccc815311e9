"""Phrase, name and English retrieval on the driver's tables; SQL where the rules need no phonology."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klangwerk.functions import phonology as P
from klangwerk.functions import text as T
from klangwerk.operators import corpus as C
from klangwerk.operators import lexicon as L
from klangwerk.operators import mosaic as M
from klangwerk.operators import names as N
from klangwerk.operators import relational as O
from klangwerk.operators import workspace as W

from .registry import query

_KEYS = """(SELECT p_partkey AS id, p_size AS n, 'exact' AS channel, p_brand || p_type AS key FROM part UNION ALL SELECT p_partkey, p_size, 'multi', p_brand FROM part UNION ALL SELECT p_partkey, p_size, 'coda', right(p_type, 3) FROM part)"""


@query(f"""WITH l AS (SELECT * FROM (VALUES ('exact', 8, 0), ('multi', 8, 1), ('coda', 3, 2)) v(channel, most, o)),
 h AS (SELECT q.id AS query, x.id AS target, x.n, l.o, l.most, row_number() OVER (PARTITION BY q.id, x.channel ORDER BY x.n, x.id) AS r FROM {_KEYS} q JOIN {_KEYS} x USING (channel, key) JOIN l USING (channel) WHERE q.id % 50 = 0 AND q.id <> x.id),
 m AS (SELECT query, target, min(o) AS o, min(n) AS n FROM h WHERE r <= most GROUP BY 1, 2)
SELECT query, target, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY o, n, target) AS rank FROM m) WHERE rank <= 12""")
def jn05_channel_limits(t) -> DataFrame:
    """Channels with limits of their own, merged by the closest; asked for the parts whose ids 50 divides, against all."""
    keys = O.postings(t.part.withColumns({"bt": F.concat("p_brand", "p_type"), "end": F.right("p_type", F.lit(3))}), "p_partkey", {"exact": "bt", "multi": "p_brand", "coda": "end"})
    q = keys.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query"), "channel", "key", F.col("p_partkey").alias("target"))
    x = keys.join(t.part.select("p_partkey", F.col("p_size").alias("n")), "p_partkey").select(F.col("p_partkey").alias("target"), "channel", "key", "n")
    return N.limited_channels(q, x, "query", "target", {"exact": 8, "multi": 8, "coda": 3}, [F.asc("n")], 12, "target").select("query", "target", "rank")


@query("""WITH lex AS (SELECT DISTINCT lower(w) AS form FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey % 3 = 0)), n AS (SELECT DISTINCT p_type || ' ' || p_name AS name FROM part),
 w AS (SELECT name, unnest(string_split(lower(name), ' ')) AS form, len(string_split(name, ' ')) AS tokens FROM n), m AS (SELECT name, any_value(tokens) AS tokens, count(*) FILTER (lex.form IS NULL) AS missing FROM w LEFT JOIN lex USING (form) GROUP BY name)
SELECT name, tokens::INTEGER AS tokens, CASE WHEN tokens > 4 THEN 'unresolved_too_many_tokens' WHEN missing > 0 THEN 'unresolved_token' ELSE 'bounded_token_composition' END AS status FROM m""")
def ph37_name_resolution(t) -> DataFrame:
    """Types and names of parts as entity names, the words of every third name as the pronouncing lexicon."""
    words = t.part.where("p_partkey % 3 = 0").select(F.explode(F.split("p_name", " ")).alias("w")).select(F.lower("w").alias("form"), F.lower("w").alias("ipa")).distinct()
    names = t.part.select(F.concat_ws(" ", "p_type", "p_name").alias("name"))
    return N.resolved_names(names, words, "name", 4).select("name", "tokens", "status")


@query("""WITH a AS (SELECT s_suppkey AS id, s_nationkey AS key, 'nation' AS channel, s_acctbal AS pop FROM supplier UNION ALL SELECT c_custkey + 1000000, c_nationkey, 'nation', c_acctbal FROM customer),
 r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pop DESC, id) AS r FROM a) SELECT n_name AS query, id FROM nation JOIN r ON key = n_nationkey WHERE r <= 20""")
def jn08_entity_candidates(t) -> DataFrame:
    """Customers and suppliers as the names that a nation finds, the most popular first."""
    side = lambda df, k, key, pop, add: df.select((F.col(k) + add).alias("id"), F.col(key).cast("string").alias("nation"), F.col(pop).alias("pop"))
    names = side(t.supplier, "s_suppkey", "s_nationkey", "s_acctbal", 0).unionByName(side(t.customer, "c_custkey", "c_nationkey", "c_acctbal", 1000000))
    anchors = N.entity_postings(names, "id", {"nation": "nation"}).select("id", "channel", "key")
    q = t.nation.select(F.col("n_name").alias("query"), F.lit("nation").alias("channel"), F.col("n_nationkey").cast("string").alias("key"))
    return N.entity_candidates(q, anchors, names, "query", "id", [F.desc("pop"), F.asc("id")], per_channel=20).select("query", "id")


@query("""WITH x AS (SELECT c_custkey AS id, c_mktsegment AS category, c_nationkey, c_acctbal FROM customer), h AS (SELECT n_name AS query, id, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, id) AS r FROM nation JOIN x ON c_nationkey = n_nationkey
 WHERE category = CASE n_nationkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'AUTOMOBILE' END) SELECT query, id, c_name FROM h JOIN customer ON c_custkey = id WHERE r <= 15""")
def jn09_hydration(t) -> DataFrame:
    """Names of one category a query, cut first, their details joined to what is left."""
    names = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("category"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_acctbal").alias("pop"))
    anchors = N.entity_postings(names, "id", {"nation": "nation"}).select("id", "channel", "key")
    q = t.nation.select(F.col("n_name").alias("query"), F.lit("nation").alias("channel"), F.col("n_nationkey").cast("string").alias("key"))
    kind = F.when(F.col("n_nationkey") % 3 == 0, "BUILDING").when(F.col("n_nationkey") % 3 == 1, "MACHINERY").otherwise("AUTOMOBILE")
    wanted = t.nation.select(F.col("n_name").alias("query"), kind.alias("category"))
    found = N.entity_candidates(q, anchors, names, "query", "id", [F.desc("pop"), F.asc("id")], wanted, per_channel=15)
    return N.hydrated(found, t.customer.select(F.col("c_custkey").alias("id"), "c_name"), "id").select("query", "id", "c_name")


@query()
def jn05_english_channels(t) -> DataFrame:
    """Candidates of the twenty most used English words of five letters and more, with the product's limits."""
    # spoken once: queries and targets are read from one table of keys, which has an exact key of every form
    keys = W.settled(L.channels(L.pronounce(L.lexicon(t.documents.where("lang = 'en'")))).select("language", F.col("form").alias("target"), "channel", "key", "usage_rank"), f"{W.shared_dir(t.spark)}/klangwerk-keys-{uuid.uuid4().hex}")
    asked = O.top_per_group(keys.where((F.col("channel") == "exact") & (F.length("target") >= 5)), ["language"], [F.asc("usage_rank")], 20).select(F.col("target").alias("query"))
    keys = keys.drop("language")
    q = keys.join(asked, F.col("target") == F.col("query")).select("query", "target", "channel", "key")
    return N.limited_channels(q, keys, "query", "target", N.ENGLISH_CHANNELS, [F.asc_nulls_last("usage_rank")], N.ENGLISH_MOST, "target").select("query", "target", F.array_join("channels", ",").alias("channels"), "rank")


def _phrases(t) -> tuple[DataFrame, DataFrame]:
    """Sentences of German and English documents of at most eight words as phrases, with the corpus lexicon."""
    docs = t.documents.where(F.col("lang").isin(*L.LANGUAGES))
    lines = C.sentence_tokens(docs, "doc_id", "lang").where(F.size("tokens").between(2, 8)).select(F.concat_ws(":", "doc_id", "line_no").alias("phrase"), "lang", F.transform("tokens", lambda x: F.lower(x)).alias("tokens"))
    lexicon = L.lexicon(docs)
    # read by phrases and by queries: counted and spoken once
    return lines, W.settled(lexicon.withColumn("ipa", P.g2p(F.col("form"), F.col("language"))), f"{W.shared_dir(t.spark)}/klangwerk-lexicon-{uuid.uuid4().hex}")


@query()
def sq07_phrase_pronunciations(t) -> DataFrame:
    lines, lexicon = _phrases(t)
    return M.phrase_pronunciations(lines, lexicon, "phrase", "tokens", "lang").groupBy("lang", "status").agg(F.count("*").alias("phrases"), F.sum(F.col("a.syllable_count")).alias("syllables"))


@query()
def jn07_phrase_mosaic(t) -> DataFrame:
    """Phrases that rhyme across word boundaries with the ten most used words of five letters and more of each language."""
    lines, lexicon = _phrases(t)
    windows = M.phrase_windows(M.phrase_pronunciations(lines, lexicon, "phrase", "tokens", "lang"), "phrase", "lang")
    asked = O.top_per_group(lexicon.where(F.length("form") >= 5), ["language"], [F.asc("usage_rank")], 10).select(F.concat_ws(":", "language", "form").alias("query"), F.col("language").alias("lang"), "ipa")
    found = M.ranked_windows(M.retrieve_windows(asked, windows, "query", "phrase", "lang"), "query", "phrase", "lang", 50)
    return found.withColumn("channels", F.array_join("channels", ","))


@query()
def ph28_english_bridge(t) -> DataFrame:
    """German forms as English hears their rightmost rhyme."""
    words = L.lexicon(t.documents.where("lang = 'de'"))
    return words.select("form", P.english_bridge(P.g2p(F.col("form"), F.lit("de"))).alias("b")).select("form", "b.ipa", "b.position")
