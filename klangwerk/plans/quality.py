"""Evaluation, morphology and entity-name operators on the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klangwerk.operators import evaluation as E
from klangwerk.operators import morphology as M
from klangwerk.operators import relational as O
from klangwerk.operators.serving import json_object

from .corpus import _EVAL, _eval
from .more import _LEX, _lexicon
from .registry import query


@query(f"""WITH p AS (SELECT a.source, b.doc_id AS worse, a.doc_id AS better, (a.quality - b.quality)::INTEGER AS gold_gap, b.score - a.score AS score_gap FROM {_EVAL} a JOIN {_EVAL} b ON a.source = b.source AND a.quality > b.quality AND a.score < b.score)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY gold_gap DESC, score_gap DESC, better, worse) AS rank FROM p) WHERE rank <= 10""")
def ev05_discordant_pairs(t) -> DataFrame:
    """The ten clearest contradictions between length and label among the judged documents of a source."""
    out = E.discordant_pairs(_eval(t), "source", "doc_id", "score", "quality", 10)
    return out.withColumn("gold_gap", F.col("gold_gap").cast("int"))


_ACC = "(SELECT l_returnflag AS k, l_quantity >= 5 AS l, l_discount < 0.09 AS r, l_tax < 0.05 AS a, l_linenumber < 4 AS b, (l_partkey % 100) / 100.0::DOUBLE AS s FROM lineitem)"


@query(f"""SELECT k, count(*) AS cases, round(sum(l::INT) * 100.0 / count(*), 2) AS left_pct, round(sum(r::INT) * 100.0 / count(*), 2) AS right_pct, sum((l AND r)::INT)::BIGINT AS both_accepted, round(sum((l AND r AND a)::INT) * 100.0 / sum((l AND r)::INT), 2) AS exact_tail_pct,
 round(sum((l AND r AND b)::INT) * 100.0 / sum((l AND r)::INT), 2) AS stress_pct, round(sum(CASE WHEN l AND r THEN s END) / sum((l AND r)::INT), 5) AS mean_rhyme_score FROM {_ACC} GROUP BY k""")
def ev20_agreement(t) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("k"), (F.col("l_quantity") >= 5).alias("l"), (F.col("l_discount") < 0.09).alias("r"), (F.col("l_tax") < 0.05).alias("a"), (F.col("l_linenumber") < 4).alias("b"), (F.col("l_partkey") % 100 / 100.0).alias("rhyme_score"))
    return E.agreement_stats(rows, "l", "r", {"exact_tail": "a", "stress": "b"}, keys=["k"]).withColumn("mean_rhyme_score", F.round("mean_rhyme_score", 5))


@query("""WITH c AS (SELECT l_quantity AS s, count(*) AS n, sum((l_tax < 0.04)::INT) AS ok FROM lineitem GROUP BY 1), p AS (SELECT s, sum(n) OVER (ORDER BY s) AS kept, sum(ok) OVER (ORDER BY s) AS good, sum(n) OVER () AS total FROM c),
 f AS (SELECT share, min(s) AS threshold FROM p, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9, 1.0])::DOUBLE AS share) WHERE kept >= greatest(1, ceil(total * share)) GROUP BY 1)
SELECT share, threshold, kept::BIGINT AS retained, round(kept * 100 / total, 2) AS retained_pct, round(good * 100 / kept, 2) AS correct_pct FROM f JOIN p ON s = threshold""")
def ev14_calibration(t) -> DataFrame:
    return E.score_calibration(t.lineitem.select(F.col("l_quantity").alias("threshold"), (F.col("l_tax") < 0.04).alias("ok")), "threshold", "ok")


@query("""SELECT 'PushedFilters' AS expected, true AS found UNION ALL SELECT 'BroadcastHashJoin', true UNION ALL SELECT 'WindowGroupLimit', true UNION ALL SELECT 'CartesianProduct', false""")
def ev15_plan_checks(t) -> DataFrame:
    """That lookups push their keys down, broadcast small sides and cut groups before the shuffle."""
    top = O.top_per_group(t.lineitem.where("l_partkey = 7").join(F.broadcast(t.part.select(F.col("p_partkey").alias("l_partkey"))), "l_partkey"), ["l_suppkey"], [F.asc("l_orderkey")], 3)
    found = E.plan_lines(top, "PushedFilters", "BroadcastHashJoin", "WindowGroupLimit", "CartesianProduct")
    return t.spark.createDataFrame(list(found.items()), "expected string, found boolean")


_PAGE = """(SELECT p_brand AS k, p_name AS form, p_type AS lemma, 'SMALL' AS want, p_type AS family, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey * 977 % 400000 END AS usage, p_size > 45 AS rare, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)"""


@query(f"""WITH p AS (SELECT * FROM {_PAGE} WHERE r <= 20), n AS (SELECT a.k, a.r FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE b.k = a.k AND b.r < a.r AND lower(b.form) <> lower(a.form) AND 1.0 - levenshtein(lower(a.form), lower(b.form))::DOUBLE / greatest(1, length(a.form), length(b.form)) >= 0.80)),
 f AS (SELECT k, sum(n - 1) AS n FROM (SELECT k, family, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
SELECT k, count(*) AS results, sum((lemma = want)::INT)::BIGINT AS same_lemma, sum((usage IS NULL)::INT)::BIGINT AS unranked, coalesce(sum((usage > 100000)::INT), 0)::BIGINT AS over_100k, coalesce(sum((usage > 250000)::INT), 0)::BIGINT AS over_250k, sum(rare::INT)::BIGINT AS rare,
 count(*) - count(DISTINCT lower(form)) AS repeated_forms, (SELECT count(*) FROM n WHERE n.k = p.k) AS near_copies, coalesce((SELECT f.n FROM f WHERE f.k = p.k), 0)::BIGINT AS repeated_families FROM p GROUP BY k""")
def ev16_page_quality(t) -> DataFrame:
    from klangwerk.operators.policies import numbered

    page = numbered(t.part, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], "r").select(
        F.col("p_brand").alias("k"), F.col("p_name").alias("form"), F.col("p_type").alias("lemma"), F.lit("SMALL").alias("want"), F.col("p_type").alias("family"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") * 977 % 400000).alias("usage"), (F.col("p_size") > 45).alias("is_rare"), "r")
    return E.page_quality(page, "k", "r", "form", "lemma", "want", "family", "usage", F.col("is_rare"))


@query("""WITH w AS (SELECT DISTINCT p_brand AS k, lower(p_name) AS f FROM part WHERE p_size > 10), l AS (SELECT p_brand AS k, lower(p_name) AS f FROM part WHERE p_size % 4 = 0)
SELECT b.k, count(l.f) AS rows, count(w.f) AS retained, CASE WHEN count(l.f) > 0 THEN round(count(w.f)::DOUBLE / count(l.f), 4) ELSE 1.0 END AS retention FROM (SELECT DISTINCT p_brand AS k FROM part) b LEFT JOIN l ON l.k = b.k LEFT JOIN w ON w.k = l.k AND w.f = l.f GROUP BY b.k""")
def ev16_retention(t) -> DataFrame:
    rows = t.part.select(F.col("p_brand").alias("k"), F.col("p_name").alias("form"), (F.col("p_size") % 4).alias("tier"), "p_size")
    return E.retention(rows.where("p_size > 10"), rows, "k", "form", "tier")


@query(f"""WITH r AS (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS b, row_number() OVER (PARTITION BY source ORDER BY quality DESC, score DESC, doc_id) AS i FROM {_EVAL}),
 g AS (SELECT source, sum((pow(2, quality) - 1) / log2(a + 1)) AS a, sum((pow(2, quality) - 1) / log2(b + 1)) AS b, sum((pow(2, quality) - 1) / log2(i + 1)) AS i FROM r GROUP BY 1), m AS (SELECT avg(a / nullif(i, 0)) AS a, avg(b / nullif(i, 0)) AS b FROM g)
SELECT 'length' AS policy, round(a, 6) AS mean_ndcg, 0.0 AS delta FROM m UNION ALL SELECT 'order', round(b, 6), round(b - a, 4) FROM m""")
def ev19_ranking_experiment(t) -> DataFrame:
    return E.ranking_experiment(_eval(t), "source", {"length": [F.desc("score"), F.asc("doc_id")], "order": [F.asc("doc_id")]}, "quality", "length")


@query("""WITH f AS (SELECT o_orderpriority AS run, o_orderstatus AS k, count(*)::VARCHAR AS fp FROM orders GROUP BY 1, 2), b AS (SELECT k, fp FROM f WHERE run = (SELECT min(run) FROM f)), g AS (SELECT run, k FROM (SELECT DISTINCT run FROM f WHERE run <> (SELECT min(run) FROM f)), (SELECT k FROM b) UNION SELECT run, k FROM f WHERE run <> (SELECT min(run) FROM f))
SELECT g.run, g.k, b.fp AS expected, f.fp AS observed FROM g LEFT JOIN b USING (k) LEFT JOIN f ON f.run = g.run AND f.k = g.k WHERE b.fp IS DISTINCT FROM f.fp""")
def ev21_repeatability(t) -> DataFrame:
    runs = t.orders.groupBy(F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("k")).agg(F.count("*").cast("string").alias("fp"))
    return E.repeatability(runs, "run", "k", "fp")


@query("""SELECT left(sha256('round' || chr(0) || c_custkey::VARCHAR), 16) AS blind_id, c_name, c_mktsegment FROM customer""")
def ev24_blind_export(t) -> DataFrame:
    return E.blind_export(t.customer, "c_custkey", ["c_name", "c_mktsegment"], "round")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def sf24_json_parse(t) -> DataFrame:
    return t.events.select("event_id", json_object("props")["k"].alias("k"))


@query(f"""WITH RECURSIVE lex AS {_LEX}, s AS (SELECT form, max(i) AS cut FROM (SELECT form, substr(form, i + 1) AS suffix, length(form) - i AS i FROM (SELECT form, unnest(range(3, length(form) - 2)) AS i FROM lex WHERE length(form) >= 6)) x SEMI JOIN lex ON lex.form = x.suffix GROUP BY form),
 w AS (SELECT form, left(form, length(form) - cut) AS rest, right(form, cut) AS suffix, ''::VARCHAR AS parts, 0 AS n FROM s
  UNION ALL SELECT form, substr(rest, len + 1), suffix, parts || part || '+', n + 1 FROM (SELECT w.form, w.rest, w.suffix, w.parts, w.n, max(lex.form) AS part, max(length(lex.form)) AS len FROM w JOIN
   (SELECT form, length(form) AS l FROM lex WHERE length(form) >= 3) lex ON starts_with(w.rest, lex.form) WHERE n < 6 AND rest <> '' GROUP BY ALL
   HAVING true) q QUALIFY len = max(len) OVER (PARTITION BY form, rest, n))
SELECT form, parts || suffix AS parts FROM w WHERE rest = '' AND n > 0""")
def ph30_prefix_cover(t) -> DataFrame:
    lex = _lexicon(t)
    return M.prefix_cover(lex, lex).select("form", F.array_join("parts", "+").alias("parts"))


@query("""WITH l AS (SELECT DISTINCT p_type AS form, 'form' AS kind, p_type AS key, p_size % 7 = 0 AS historical, CASE WHEN p_size % 3 = 0 THEN p_size END AS usage_rank FROM part WHERE p_partkey <= 150), t AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE p_type END AS token FROM part),
 h AS (SELECT token, form, usage_rank, CASE WHEN form = token AND NOT historical AND usage_rank IS NOT NULL THEN 0 WHEN form = token AND NOT historical THEN 1 WHEN NOT historical AND usage_rank IS NOT NULL THEN 2 WHEN NOT historical THEN 3 WHEN form = token THEN 5 ELSE 6 END AS level FROM t JOIN l ON lower(token) = lower(key))
SELECT token, form, ['exact_current_ranked', 'exact_current', 'lower_current_ranked', 'lower_current', 'alias_current', 'exact_historical', 'lower_historical', 'alias_historical'][level + 1] AS level, usage_rank FROM h QUALIFY row_number() OVER (PARTITION BY token ORDER BY level, usage_rank NULLS LAST, form) = 1""")
def jn16_token_forms(t) -> DataFrame:
    lex = t.part.where("p_partkey <= 150").select(F.col("p_type").alias("form"), F.lit("form").alias("kind"), F.col("p_type").alias("key"), (F.col("p_size") % 7 == 0).alias("historical"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("usage_rank")).distinct()
    tokens = t.part.select(F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("token"))
    return M.token_forms(tokens, lex)


@query("""WITH s AS (SELECT DISTINCT lower(p_type) AS surface FROM part), o AS (SELECT p_partkey AS record, lower(p_type) AS k, 'headword' AS match_kind FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, lower(p_type), 'listed_form' FROM part WHERE p_size % 5 = 0)
SELECT surface, record, min(match_kind) AS match_kind FROM s JOIN o ON surface = k GROUP BY 1, 2""")
def jn25_dictionary_options(t) -> DataFrame:
    head, listed = (t.part.where(w).select(F.col("p_partkey").alias("record"), F.col("p_type").alias(n)) for w, n in (("p_size > 40", "headword"), ("p_size % 5 = 0", "form")))
    return M.dictionary_options(head, listed, t.part.select(F.lower("p_type").alias("surface")))


@query("""WITH o AS (SELECT p_brand AS name, ['curated', 'accepted_en_form', 'other', 'espeak_ng_generated_secondary'][(p_size % 4 + 1)::INTEGER] AS source, p_name AS ipa FROM part WHERE p_size > 5)
SELECT name, source, ipa FROM o QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE source WHEN 'curated' THEN 0 WHEN 'accepted_en_form' THEN 1 WHEN 'espeak_ng_generated_secondary' THEN 3 ELSE 4 END, ipa) = 1""")
def jn26_name_sources(t) -> DataFrame:
    source = F.element_at(F.array(*map(F.lit, ("curated", "accepted_en_form", "other", "espeak_ng_generated_secondary"))), (F.col("p_size") % 4 + 1).cast("int"))
    options = t.part.where("p_size > 5").select(F.col("p_brand").alias("name"), source.alias("source"), F.col("p_name").alias("ipa"))
    return M.name_resolution(t.part.select(F.col("p_brand").alias("name")), options)


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_name, p_partkey) AS r FROM part""")
def sf26_collated_order(t) -> DataFrame:
    """Names of one letter case as German sorts them; the ids tell equal ones apart."""
    from klangwerk.operators.policies import collated_order, numbered

    return numbered(t.part, ["p_brand"], [*collated_order("p_name", "de"), F.asc("p_partkey")], "r").select("p_partkey", "r")


_SHAPE = r"""CASE WHEN regexp_matches(s, '[^\x00-\x{24F}]') AND regexp_matches(s, '\p{L}') AND regexp_matches(regexp_replace(s, '\p{Latin}', '', 'g'), '\p{L}') THEN 'non_latin_letters' WHEN regexp_matches(s, '[^\p{L}\p{M}\p{N}\s''’\-‐‑‒–—]') THEN 'other_punctuation'
 WHEN regexp_matches(s, '\p{N}') AND regexp_matches(s, '\p{L}') THEN 'mixed_alnum' WHEN regexp_matches(s, '\p{N}') THEN 'numeric' WHEN regexp_matches(s, '\s') THEN 'multiword' WHEN regexp_matches(s, '[-‐‑‒–—''’]') THEN 'joined_lexeme'
 WHEN length(s) <= 1 THEN 'single_character' WHEN NOT regexp_matches(s, '\p{L}') THEN 'nonlexical' ELSE 'clean_single' END"""
_SURFACES = "(SELECT trim(x) AS s FROM (SELECT unnest(list_concat(string_split(coalesce(text, ''), ' '), string_split(coalesce(text, ''), chr(10)))) AS x FROM documents))"


@query(f"SELECT shape, bucket, count(*) AS n FROM (SELECT {_SHAPE} AS shape, CASE WHEN length(s) <= 1 THEN '1' WHEN length(s) <= 3 THEN '2-3' WHEN length(s) <= 7 THEN '4-7' WHEN length(s) <= 15 THEN '8-15' WHEN length(s) <= 31 THEN '16-31' ELSE '32+' END AS bucket FROM {_SURFACES}) GROUP BY 1, 2")
def sf11_surface_shapes(t) -> DataFrame:
    """Shapes and lengths of the words and lines of all documents."""
    from klangwerk.functions import text as T

    text = F.coalesce("text", F.lit(""))
    rows = t.documents.select(F.explode(F.concat(F.split(text, " "), F.split(text, "\n"))).alias("s"))
    return rows.groupBy(T.surface_class("s").alias("shape"), T.length_bucket("s").alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, round(CASE WHEN p_size % 3 = 0 THEN least(1.0, greatest(0.0, (p_size / 6.0 - 1.5) / 5)) WHEN p_size % 3 = 1 THEN least(1.0, greatest(0.0, 1 - (log10(p_partkey + 9) - 1) / 5.5)) ELSE 0.25 END, 9) AS usage,
 round(least(1.0, greatest(0.0, ln(1 + p_size) / ln(51))), 9) AS scaled FROM part""")
def sf18_usage_utility(t) -> DataFrame:
    from klangwerk.functions import text as T

    zipf, rank = F.when(F.col("p_size") % 3 == 0, F.col("p_size") / 6.0), F.when(F.col("p_size") % 3 == 1, F.col("p_partkey"))
    return t.part.select("p_partkey", F.round(T.usage_utility(zipf, rank), 9).alias("usage"), F.round(T.log_scaled("p_size", 50), 9).alias("scaled"))


@query("""WITH q AS (SELECT DISTINCT p_partkey AS query, replace(p_name, ' ', '-') AS k, p_size AS n FROM part WHERE p_partkey % 50 = 0)
SELECT q.query, x.p_partkey AS target FROM q JOIN part x ON replace(x.p_type || '-' || x.p_name, ' ', '-') LIKE '%' || q.k AND abs(x.p_size - q.n) <= 1""")
def fp04_suffix_search(t) -> DataFrame:
    """Parts whose type and name end with another's name, of nearly its size; the ids that 50 divides ask."""
    from klangwerk.functions import text as T

    index = t.part.select(F.col("p_partkey").alias("target"), F.explode(F.array_distinct(T.suffix_keys(F.replace(F.concat_ws("-", "p_type", "p_name"), F.lit(" "), F.lit("-"))))).alias("suffix"), F.col("p_size").alias("syllables"))
    asked = t.part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("suffix"), F.col("p_size").alias("syllables"))
    return O.suffix_search(asked, index, "query", "target").select("query", "target")


@query("""WITH k AS (SELECT p_partkey AS id, p_size AS n, 'exact' AS channel, p_name AS key FROM part UNION ALL SELECT p_partkey, p_size, 'head', split_part(p_name, ' ', 1) FROM part), q AS (SELECT * FROM k WHERE id % 50 = 0),
 h AS (SELECT q.id AS query, x.id AS target, x.channel, row_number() OVER (PARTITION BY q.id, x.channel ORDER BY x.n, x.id) AS r FROM q JOIN k x USING (channel, key) WHERE q.id <> x.id)
SELECT query, target, array_to_string(list_sort(list(channel)), ',') AS channels FROM h WHERE r <= 15 GROUP BY 1, 2""")
def jn03_family_heads(t) -> DataFrame:
    """The older lookups: whole keys, and keys that begin alike, as equal first parts."""
    from klangwerk.operators import names as N

    keys = O.postings(t.part.withColumn("head", O.family_head(F.replace("p_name", F.lit(" "), F.lit("-")))), "p_partkey", {"exact": "p_name", "head": "head"})
    x = keys.join(t.part.select("p_partkey", F.col("p_size").alias("n")), "p_partkey").select(F.col("p_partkey").alias("target"), "channel", "key", "n")
    q = keys.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query"), "channel", "key", F.col("p_partkey").alias("target"))
    return N.limited_channels(q, x, "query", "target", {"exact": 15, "head": 15}, [F.asc("n")], 1000, "target").select("query", "target", F.array_join("channels", ",").alias("channels"))


@query("""WITH b AS (SELECT o_custkey, o_orderkey, list_sort(list(DISTINCT l_linenumber)) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), p AS (SELECT *, lag(o_orderkey) OVER w AS previous, lag(s) OVER w AS was FROM b WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey, previous, len(list_intersect(s, coalesce(was, [])))::BIGINT AS shared_count, array_to_string(list_sort(list_intersect(s, coalesce(was, []))), ',') AS shared FROM p""")
def ui03_shared_placements(t) -> DataFrame:
    """A customer's orders as bars and their line numbers as steps."""
    from klangwerk.operators.revisions import shared_placements

    cues = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").withColumn("o_orderkey", F.col("l_orderkey"))
    out = shared_placements(cues, "o_custkey", "o_orderkey", "l_orderkey", "l_linenumber")
    return out.select("o_custkey", "o_orderkey", "previous", "shared_count", F.array_join(F.transform("shared", lambda x: x.cast("string")), ",").alias("shared"))


@query("""WITH e AS (SELECT p_partkey, p_brand, p_size % 4 AS tier, (p_partkey % 97) / 97.0::DOUBLE AS phonetic, (p_partkey % 11) / 11.0::DOUBLE AS syllable, CASE WHEN p_size % 3 = 0 THEN p_size / 6.0 END AS zipf, CASE WHEN p_size % 3 = 1 THEN p_partkey END AS usage_rank FROM part)
SELECT p_partkey, round(0.80 * phonetic + 0.14 * syllable + 0.06 * CASE WHEN zipf IS NOT NULL THEN least(1.0, greatest(0.0, (zipf - 1.5) / 5)) WHEN usage_rank > 0 THEN least(1.0, greatest(0.0, 1 - (log10(usage_rank + 9) - 1) / 5.5)) ELSE 0.25 END - CASE WHEN zipf IS NULL AND usage_rank IS NULL THEN 0.015 ELSE 0 END, 8) AS utility FROM e""")
def rk09_quality(t) -> DataFrame:
    from klangwerk.operators.english import quality

    k, n = F.col("p_partkey"), F.col("p_size")
    rows = t.part.select("p_partkey", (k % 97 / 97.0).alias("phonetic"), (k % 11 / 11.0).alias("syllable"), F.when(n % 3 == 0, n / 6.0).alias("zipf"), F.when(n % 3 == 1, k).alias("usage_rank"))
    return quality(rows).select("p_partkey", "utility")


@query("""SELECT p_partkey, round(CASE p_size % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.82 WHEN 2 THEN 0.78 ELSE 0.25 END + round(0.45 * ((p_partkey % 97) / 97.0), 6) + round(0.03 * least(6, p_size % 9) / 6.0, 6) + round(0.03 * (p_size % 4) / 3.0, 6) + round(0.07 * least(6.0, p_size / 7.0) / 6.0, 6)
 + CASE WHEN p_size % 5 = 0 THEN 0.025 WHEN p_size % 5 = 1 THEN 0.02 ELSE 0 END - round(0.08 * ((p_partkey % 13) / 13.0), 6) - CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 0.35 ELSE 0.5 END, 6) AS utility FROM part""")
def rk11_phrase_utility(t) -> DataFrame:
    from klangwerk.operators.phrases import utility

    k, n = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    types = F.when(n % 5 == 0, F.array(F.lit("phrase"), F.lit("proverb"))).when(n % 5 == 1, F.array(F.lit("idiom")))
    u = utility(pick(("perfect", "multisyllabic_slant", "family", "none"), n % 4), k % 97 / 97.0, (n % 9).cast("double"), (n % 4).cast("double"), n / 7.0, types, k % 13 / 13.0, pick(("safe", "marked", "restricted"), n % 3))
    return t.part.select("p_partkey", u.alias("utility"))


@query("""WITH s AS (SELECT conv_id, role, count(*) AS lines FROM conversations GROUP BY 1, 2) SELECT role, count(*) AS n, round(avg(lines), 6) AS mean, quantile_cont(lines, 0.25) AS p25, quantile_cont(lines, 0.5) AS median, quantile_cont(lines, 0.75) AS p75 FROM s GROUP BY 1""")
def ag20_structure_lines(t) -> DataFrame:
    """Conversations as songs and roles as sections: how many lines a section has."""
    from klangwerk.functions import text as T
    from klangwerk.operators.song import structure

    lines = t.conversations.select("conv_id", "turn", "role", F.col("role").alias("section"), F.size(T.word_tokens("text")).alias("tokens"), T.end_word(F.coalesce("text", F.lit(""))).alias("word"))
    out = structure(lines, "conv_id", "turn", "section", "role", "tokens")["lines"]
    return out.select(F.col("section").alias("role"), "n", F.round("mean", 6).alias("mean"), "p25", "median", "p75")
