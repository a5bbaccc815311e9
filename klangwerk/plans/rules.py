"""Filters, result orders, merges and summaries on the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klangwerk.functions import text as T
from klangwerk.operators import aggregates as A
from klangwerk.operators import filters as X
from klangwerk.operators import policies as P
from klangwerk.operators import song as S

from .corpus import _TURNS, _turns
from .registry import query


@query("""SELECT p_partkey, p_size <= 25 AS core, NOT p_size <= 25 AND p_size > 20 AS generated_only, true AS any_mode, CASE WHEN p_size <= 25 THEN p_retailprice > 1000 ELSE p_retailprice > 1200 END AS preferred FROM part""")
def fp01_availability(t) -> DataFrame:
    core, generated = F.col("p_size") <= 25, F.col("p_size") > 20
    return t.part.select("p_partkey", X.available("core", core, generated).alias("core"), X.available("generated", core, generated).alias("generated_only"), X.available("all", core, generated).alias("any_mode"),
                         X.preferred("all", core, F.col("p_retailprice") > 1000, F.col("p_retailprice") > 1200).alias("preferred"))


@query("""SELECT event_id FROM events WHERE value > 20 AND NOT (event_type = 'error') AND contains(props, '"k": 8')""")
def fp02_pronunciation_filters(t) -> DataFrame:
    flags = F.regexp_replace("props", '"k": 8', "secondary_opt_in")
    return t.events.where(X.pronunciation_filter(F.col("value") > 20, F.col("event_type") == "error", flags, generated_only=True)).select("event_id")


_NAMES = "(SELECT p_partkey, p_name, p_retailprice, list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: true) AS w FROM part)"


@query(f"""WITH q AS (SELECT DISTINCT p_name AS query, regexp_extract_all(lower(p_name), '[a-z0-9]+')[1:2] AS want FROM part WHERE p_partkey % 50 = 0),
 k AS (SELECT DISTINCT array_to_string(want, ' ') AS query, want FROM q), n AS {_NAMES},
 h AS (SELECT k.query, n.p_partkey, n.p_name, n.p_retailprice FROM k JOIN n ON len(list_filter(range(1, len(n.w) + 1), lambda i: n.w[i:i + len(k.want) - 1] = k.want)) > 0)
SELECT query, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY p_retailprice DESC, p_partkey) AS rank FROM h) WHERE rank <= 20""")
def fp06_name_search(t) -> DataFrame:
    """The first two words of every fiftieth part's name, as a phrase against all names."""
    asked = t.part.where("p_partkey % 50 = 0").select(F.array_join(F.slice(F.transform(T.word_tokens("p_name"), F.lower), 1, 2), " ").alias("q")).distinct()
    return X.name_search(t.part.select("p_partkey", "p_name", "p_retailprice"), "p_partkey", "p_name", asked, "q", [F.desc("p_retailprice"), F.asc("p_partkey")]).select("query", "p_partkey", "rank")


_TYPED = """(SELECT *, CASE p_size % 7 WHEN 0 THEN 'perfect' WHEN 1 THEN 'multisyllabic_perfect' WHEN 2 THEN 'family' WHEN 3 THEN 'slant' WHEN 4 THEN 'assonance' END AS prim,
 CASE WHEN p_partkey % 3 = 0 THEN ['consonance', 'assonance'] WHEN p_partkey % 3 = 1 THEN ['assonance', 'perfect'] END AS rel FROM part)"""
_TYPES_SQL = "list_filter(['multisyllabic_perfect', 'perfect', 'multisyllabic_slant', 'family', 'slant', 'assonance', 'consonance'], lambda x: (x = coalesce(prim, '') AND x NOT IN ('assonance', 'consonance')) OR (list_contains(coalesce(rel, []), x) AND x IN ('assonance', 'consonance')))"


def _typed(t) -> DataFrame:
    kind = F.element_at(F.array(*(F.lit(x) for x in ("perfect", "multisyllabic_perfect", "family", "slant", "assonance", None, None))), (F.col("p_size") % 7 + 1).cast("int"))
    rel = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("consonance"), F.lit("assonance"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("assonance"), F.lit("perfect")))
    return t.part.withColumns({"prim": kind, "rel": rel}).withColumn("types", X.result_types("prim", "rel"))


@query(f"SELECT p_partkey, array_to_string({_TYPES_SQL}, ',') AS types FROM {_TYPED}")
def fp07_result_types(t) -> DataFrame:
    return _typed(t).select("p_partkey", F.array_join("types", ",").alias("types"))


@query(f"SELECT p_partkey FROM (SELECT p_partkey, p_size, {_TYPES_SQL} AS types FROM {_TYPED}) WHERE list_contains(types, 'assonance') AND abs(p_size - 20) <= 3")
def fp08_writer_rows(t) -> DataFrame:
    return X.writer_rows(_typed(t), "types", "assonance", "p_size", "near3", 20).select("p_partkey")


@query("""SELECT c_custkey, len(r) = 0 AS default_eligible, array_to_string(r, ',') AS reasons FROM (SELECT c_custkey, list_filter([CASE WHEN NOT coalesce(n > 0, false) THEN 'no_analyzed_en_us_pronunciation' END,
 CASE WHEN coalesce(o, 0) = 0 AND coalesce(f, 0) > 0 THEN 'historical_only' END, CASE WHEN coalesce(n, 0) > 12 AND coalesce(p, 0) = 0 THEN 'explicit_proper_name_only' END, CASE WHEN c_acctbal < 0 THEN 'esdb_invalid_variant' END], lambda x: x IS NOT NULL) AS r
 FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey)""")
def fp10_publish_eligibility(t) -> DataFrame:
    status = lambda s, n: F.count_if(F.col("o_orderstatus") == s).alias(n)
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), status("O", "o"), status("F", "f"), status("P", "p"))
    e = X.publish_eligibility(F.col("n") > 0, F.col("o"), F.col("f"), F.when(F.col("n") > 12, F.col("n")), F.col("p"), F.col("c_acctbal") < 0)
    return t.customer.join(per, "c_custkey", "left").select("c_custkey", e.alias("e")).select("c_custkey", "e.default_eligible", F.array_join("e.exclusion_reasons", ",").alias("reasons"))


@query("""SELECT 'cheap_part' AS "view", count(*) AS n, count(DISTINCT p_brand) AS keys FROM part WHERE p_retailprice < 1200 UNION ALL SELECT 'part_name', count(*), count(DISTINCT p_name) FROM part""")
def fp12_views(t) -> DataFrame:
    names = X.compatibility_views({"part": t.part}, {"part_name": ("part", ["p_partkey", F.col("p_name").alias("key")]), "cheap_part": ("part", ["p_partkey", F.col("p_brand").alias("key")])}, {"cheap_part": F.col("p_retailprice") < 1200})
    return t.spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS view, count(*) AS n, count(DISTINCT key) AS keys FROM {n}" for n in names))


@query("""SELECT v.raw, CASE WHEN v.n IS NULL THEN 20 ELSE greatest(1, least(250, v.n)) END::INTEGER AS clamped, count(*) AS parts FROM (VALUES ('0', 0), ('7', 7), ('999', 999), ('-3', -3), ('x', NULL), ('', NULL), ('12.9', 12)) v(raw, n) CROSS JOIN part GROUP BY 1, 2""")
def fp13_clamps(t) -> DataFrame:
    rows = [(raw, X.clamp(raw)) for raw in ("0", "7", "999", "-3", "x", "", "12.9")]
    n = t.part.agg(F.count("*").alias("parts"))
    return t.spark.createDataFrame(rows, "raw string, clamped int").crossJoin(F.broadcast(n))  # seven rows and one


_GEN = "(SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'unresolved' ELSE 'resolved' END AS st, CASE WHEN o_custkey % 2 = 0 THEN 'espeak_ng' ELSE 'rules' END AS me, substr('ABCDU', (o_orderkey % 5 + 1)::INTEGER, 1) AS ti, CASE o_orderkey % 4 WHEN 0 THEN 'review' WHEN 1 THEN NULL ELSE 'admit' END AS de, o_custkey % 7 <> 0 AS found FROM orders)"
_DEFER = "CASE WHEN st = 'unresolved' OR ti = 'U' THEN 'U_unresolved' WHEN me = 'espeak_ng' THEN NULL WHEN ti = 'B' THEN 'client_B_source_backed' WHEN ti = 'C' THEN 'client_C_rules' WHEN ti = 'D' THEN 'client_D_grapheme' ELSE 'other_non_espeak' END"
_ACTIVE = "(st = 'resolved' AND me = 'espeak_ng' AND ti IN ('A', 'B'))"


@query(f"""SELECT active, deferred, dependency, count(*) AS n FROM (SELECT {_ACTIVE} AS active, {_DEFER} AS deferred, CASE WHEN NOT found THEN 'missing_backfill_dependency' WHEN de = 'admit' AND {_ACTIVE} THEN 'active_espeak_ab_token_missing_from_writer'
 WHEN coalesce(de, '') <> 'admit' THEN 'admission_' || coalesce(de, 'unknown') ELSE coalesce({_DEFER}, 'non_active_token') END AS dependency FROM {_GEN}) GROUP BY ALL""")
def fp14_generation_state(t) -> DataFrame:
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i.cast("int"))
    rows = t.orders.select(F.when(F.col("o_orderstatus") == "P", "unresolved").otherwise("resolved").alias("st"), F.when(F.col("o_custkey") % 2 == 0, "espeak_ng").otherwise("rules").alias("me"),
                           pick("ABCDU", F.col("o_orderkey") % 5 + 1).alias("ti"), pick(["review", None, "admit", "admit"], F.col("o_orderkey") % 4 + 1).alias("de"), (F.col("o_custkey") % 7 != 0).alias("found"))
    state = rows.select(X.active_generated("st", "me", "ti").alias("active"), X.deferred_bucket("st", "me", "ti").alias("deferred"), X.dependency_bucket(F.col("found"), "de", "st", "me", "ti").alias("dependency"))
    return A.summary_counts(state, ["active", "deferred", "dependency"])


@query("""SELECT o_orderkey FROM orders WHERE CASE WHEN o_custkey % 3 = 0 THEN 'en-US' ELSE 'de-DE' END = 'en-US' AND CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending' ELSE 'reviewed' END IN ('accepted', 'reviewed', 'accepted_source_composition', 'accepted_source_backed')""")
def fp15_runtime_eligible(t) -> DataFrame:
    locale = F.when(F.col("o_custkey") % 3 == 0, "en-US").otherwise("de-DE")
    state = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "pending").otherwise("reviewed")
    return t.orders.where(X.entity_runtime_eligible(locale, state, "en")).select("o_orderkey")


#: Parts as search results of their brand.
_RESULTS = f"""(SELECT p_brand AS query, p_partkey AS id, p_name AS word, p_size % 4 AS tier, p_size % 3 AS distance, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 37 % 100003 + 1 END AS usage_rank, (p_partkey % 97) / 97.0::DOUBLE AS score,
 prim AS primary_type, CASE WHEN p_partkey % 11 = 0 THEN ['rare'] ELSE [] END AS tags, {_TYPES_SQL} AS types, p_size % 5 AS strength, (p_partkey % 89) / 89.0::DOUBLE AS relation_score, p_retailprice AS price FROM {_TYPED})"""


def _results(t) -> DataFrame:
    return _typed(t).select(F.col("p_brand").alias("query"), F.col("p_partkey").alias("id"), F.col("p_name").alias("word"), (F.col("p_size") % 4).alias("tier"), (F.col("p_size") % 3).alias("distance"),
                            F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") * 37 % 100003 + 1).alias("usage_rank"), (F.col("p_partkey") % 97 / 97.0).alias("score"), F.col("prim").alias("primary_type"),
                            F.when(F.col("p_partkey") % 11 == 0, F.array(F.lit("rare"))).otherwise(F.array().cast("array<string>")).alias("tags"), "types", (F.col("p_size") % 5).alias("strength"), (F.col("p_partkey") % 89 / 89.0).alias("relation_score"), F.col("p_retailprice").alias("price"))


def _ranked(t, order, limit: int = 40) -> DataFrame:
    from klangwerk.operators.relational import top_per_group

    return top_per_group(_results(t), ["query"], [*order, F.asc("id")], limit).select("query", "id", "rank")


def _ranked_sql(order: str, limit: int = 40) -> str:
    return f"SELECT query, id, rank FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY {order}, id) AS rank FROM {_RESULTS}) WHERE rank <= {limit}"


_USAGE = "tier, distance, usage_rank NULLS LAST, score DESC, word"
_APPLIES = "(tier <> 0 AND primary_type IS NOT NULL AND usage_rank IS NOT NULL)"
_BEYOND = f"({_APPLIES} AND log10(usage_rank / 500.0) > 1)"
_MODERN = f"""tier, distance, CASE WHEN usage_rank IS NULL THEN 2 WHEN {_BEYOND} THEN 1 ELSE 0 END, CASE WHEN {_APPLIES} AND NOT {_BEYOND} AND list_contains(tags, 'rare') THEN 1 ELSE 0 END,
 CASE WHEN {_APPLIES} AND NOT {_BEYOND} THEN -floor((score + 1e-9) / 0.05) ELSE 0 END, usage_rank NULLS LAST, score DESC, word"""


@query(_ranked_sql(_USAGE))
def rk01_usage_order(t) -> DataFrame:
    return _ranked(t, P.usage_order())


@query(_ranked_sql(_MODERN))
def rk02_modern_order(t) -> DataFrame:
    """As results of a current query word of usage rank 500."""
    return _ranked(t, P.modern_order(F.lit(500), F.lit(True), "tags", "primary_type"))


@query(_ranked_sql("CASE WHEN list_contains(types, 'assonance') THEN 0 ELSE 1 END, strength, relation_score DESC, distance, usage_rank NULLS LAST, score DESC, word"))
def rk03_type_order(t) -> DataFrame:
    return _ranked(t, P.type_order("types", "assonance", "strength", "relation_score", P.usage_order()))


@query(_ranked_sql("lower(word)") .replace(", id)", ", price DESC, id)"))
def rk17_user_sort(t) -> DataFrame:
    """By the alphabet; equal words keep the order by price."""
    from klangwerk.operators.relational import top_per_group

    placed = P.numbered(_results(t), ["query"], [F.desc("price"), F.asc("id")], "index")
    return top_per_group(placed, ["query"], P.user_order("alpha"), 40).select("query", "id", "rank")


@query(_ranked_sql("tier, distance, CASE WHEN tier = 0 OR primary_type IS NULL THEN 0 ELSE 1 END, CASE WHEN tier = 0 OR primary_type IS NULL THEN (usage_rank IS NULL)::INT WHEN usage_rank > 0 THEN 0 ELSE 1 END, CASE WHEN NOT (tier = 0 OR primary_type IS NULL) THEN score - 0.05 * log10(usage_rank) END DESC NULLS LAST, usage_rank NULLS LAST, score DESC, word"))
def rk20_lexical_hybrid(t) -> DataFrame:
    from klangwerk.operators.relational import top_per_group

    rows = _results(t).withColumn("lexicon_layer", F.lit("modern"))
    return top_per_group(rows, ["query"], [*P.lexical_hybrid_order(0.05), F.asc("id")], 40).select("query", "id", "rank")


_ENTITIES = "(SELECT s_nationkey AS query, s_suppkey AS entity, CASE WHEN s_suppkey % 4 <> 0 THEN floor(s_acctbal)::BIGINT END AS qrank, s_suppkey % 5 AS sitelinks, s_suppkey % 3 AS wikipedias, s_suppkey % 7 AS external_ids, s_suppkey % 2 AS statements FROM supplier)"


@query(f"""SELECT query, entity, row_number() OVER (PARTITION BY query ORDER BY qrank DESC NULLS LAST, sitelinks DESC, wikipedias DESC, external_ids DESC, statements DESC, entity) AS control,
 row_number() OVER (PARTITION BY query ORDER BY sitelinks * 1000 + external_ids DESC, qrank DESC NULLS LAST, sitelinks DESC, wikipedias DESC, external_ids DESC, statements DESC, entity) AS hybrid FROM {_ENTITIES}""")
def rk21_entity_cut_orders(t) -> DataFrame:
    k = F.col("s_suppkey")
    rows = t.supplier.select(F.col("s_nationkey").alias("query"), k.alias("entity"), F.when(k % 4 != 0, F.floor("s_acctbal").cast("long")).alias("qrank"), (k % 5).alias("sitelinks"), (k % 3).alias("wikipedias"), (k % 7).alias("external_ids"), (k % 2).alias("statements"))
    scored = rows.withColumn("candidate_ppm", F.col("sitelinks") * 1000 + F.col("external_ids"))
    return P.numbered(P.numbered(scored, ["query"], P.entity_control_order(), "control"), ["query"], P.entity_hybrid_order(), "hybrid").select("query", "entity", "control", "hybrid")


@query(_ranked_sql("tier, floor((score + 1e-9) / 0.05) DESC, usage_rank NULLS LAST, score DESC, word"))
def rk22_score_bands(t) -> DataFrame:
    return _ranked(t, P.score_band_order())


@query(_ranked_sql("tier, relation_score DESC, usage_rank NULLS LAST, distance, word"))
def rk23_evidence_order(t) -> DataFrame:
    return _ranked(t, P.evidence_order(quality="relation_score"))


@query("""SELECT c_custkey, level FROM (SELECT c_custkey, CASE WHEN starts_with(lower(c_mktsegment), 'ma') THEN 0 WHEN contains(lower(c_mktsegment), 'ma') THEN 1 WHEN contains(lower(c_name), 'ma') THEN 2 END::INTEGER AS level FROM customer) WHERE level IS NOT NULL""")
def rk25_commands(t) -> DataFrame:
    return P.commands(t.customer.withColumn("keys", F.array("c_name")), "c_mktsegment", "keys", " Ma").select("c_custkey", "level")


@query("""SELECT p_partkey, array_to_string(list_filter([p_brand, p_type, CASE WHEN p_brand <> p_name THEN p_name END], lambda x: x IS NOT NULL AND x <> ''), '|') AS merged FROM part""")
def st03_ordered_union(t) -> DataFrame:
    merged = P.ordered_union(F.array("p_brand", "p_type"), F.array(F.lit(" "), F.col("p_brand"), F.col("p_name")), F.array(F.lit(None).cast("string")))
    return t.part.select("p_partkey", F.array_join(merged, "|").alias("merged"))


@query("""WITH w AS (SELECT 0 AS l, 'de' AS language, c_nationkey AS query, c_mktsegment || c_custkey % 9 AS normalized, c_acctbal AS s, c_custkey AS id FROM customer UNION ALL SELECT 1, 'en', c_nationkey, c_mktsegment || c_custkey % 7, c_acctbal, c_custkey FROM customer WHERE c_custkey % 3 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY l, query ORDER BY s DESC, id) AS channel_rank FROM w), o AS (SELECT *, row_number() OVER (PARTITION BY query, normalized ORDER BY channel_rank, l) AS k FROM r),
 m AS (SELECT 'word' AS kind, language, query, normalized, id, channel_rank, row_number() OVER (PARTITION BY query ORDER BY channel_rank, l, normalized) AS position FROM o WHERE k = 1),
 e AS (SELECT 'entity' AS kind, NULL AS language, s_nationkey AS query, s_name AS normalized, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS channel_rank FROM supplier)
SELECT * FROM m UNION ALL SELECT *, channel_rank FROM e""")
def st04_channel_merge(t) -> DataFrame:
    words = lambda n, keep: t.customer.where(keep).select(F.col("c_nationkey").alias("query"), F.concat("c_mktsegment", (F.col("c_custkey") % n).cast("string")).alias("normalized"), F.col("c_acctbal").alias("s"), F.col("c_custkey").alias("id"))
    names = t.supplier.select(F.col("s_nationkey").alias("query"), F.col("s_name").alias("normalized"), F.col("s_acctbal").alias("s"), F.col("s_suppkey").alias("id"))
    out = P.channel_merge([("de", words(9, F.lit(True))), ("en", words(7, F.col("c_custkey") % 3 == 0))], [("entity", names)], ["query"], [F.desc("s"), F.asc("id")], "normalized")
    return out.select("kind", "language", "query", "normalized", "id", "channel_rank", "position")


@query("""SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS channel_rank FROM customer""")
def wn13_channel_rank(t) -> DataFrame:
    return P.numbered(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], "channel_rank").select("c_nationkey", "c_custkey", "channel_rank")


@query(f"""WITH r AS (SELECT query, id, types, row_number() OVER (PARTITION BY query ORDER BY {_USAGE}, id) AS rank FROM {_RESULTS}), e AS (SELECT query, id, rank, unnest(types) AS type FROM r WHERE rank <= 40)
SELECT query, type, array_to_string(list(id ORDER BY rank), ',') AS items FROM e GROUP BY 1, 2""")
def ag04_grouped_results(t) -> DataFrame:
    from klangwerk.operators.relational import top_per_group

    page = top_per_group(_results(t), ["query"], [*P.usage_order(), F.asc("id")], 40)
    return A.grouped_results(page, ["query"], "types", "id", "rank").select("query", "type", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("""SELECT l_returnflag, count(*) AS n, quantile_cont(l_quantity, 0.1) AS p10, quantile_cont(l_quantity, 0.99) AS p99 FROM lineitem GROUP BY 1""")
def ag17_interpolated_quantile(t) -> DataFrame:
    return A.distribution(t.lineitem, ["l_returnflag"], "l_quantity", {"p10": 0.1, "p99": 0.99}).drop("mean")


@query("""WITH s AS (SELECT o_orderstatus || '/' || o_orderpriority AS stage, floor(o_totalprice / 100)::BIGINT AS ms FROM orders)
SELECT stage, count(*) AS n, round(avg(ms), 4) AS mean, round(stddev_pop(ms), 4) AS deviation, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, max(ms) AS largest FROM s GROUP BY 1""")
def ag18_stage_timing(t) -> DataFrame:
    ms = F.floor(F.col("o_totalprice") / 100).cast("long")
    rows = t.orders.select(F.create_map(F.concat_ws("/", "o_orderstatus", "o_orderpriority"), ms).alias("stages"))
    return A.stage_timing(rows, "stages").select("stage", "n", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"), "p50", "p95", "largest")


@query("""SELECT role, text_length, n, n::DOUBLE / sum(n) OVER (PARTITION BY role) AS probability FROM (SELECT role, length(text) // 50 AS text_length, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2)""")
def ag19_shares(t) -> DataFrame:
    counts = t.conversations.where("text IS NOT NULL").groupBy("role", F.floor(F.length("text") / 50).cast("long").alias("text_length")).agg(F.count("*").alias("n"))
    return A.shares(counts, ["role"], "n")


@query("""SELECT p_brand, p_type, max(p_size) AS confidence, bool_or(p_size > 45) AS proper, bool_and(p_size < 40) AS historical, arg_min(p_retailprice, p_partkey) FILTER (p_size % 2 = 0) AS gender,
 array_to_string(list_sort(list(DISTINCT p_size % 5)), ',') AS kinds FROM part GROUP BY 1, 2""")
def ag22_merged_options(t) -> DataFrame:
    rows = t.part.select("p_brand", "p_type", F.col("p_size").alias("confidence"), (F.col("p_size") > 45).alias("proper"), (F.col("p_size") < 40).alias("historical"), F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")).alias("gender"), "p_partkey", (F.col("p_size") % 5).cast("string").alias("kinds"))
    out = A.merged_options(rows, ["p_brand", "p_type"], "confidence", ["proper"], ["historical"], {"gender": F.col("p_partkey")}, [], ["kinds"])
    return out.withColumn("kinds", F.array_join("kinds", ","))


@query("""WITH b AS (SELECT p_brand, p_type, min((p_retailprice, p_partkey)) AS o FROM part GROUP BY 1, 2), s AS (SELECT p_brand, p_size, min((p_retailprice, p_partkey)) AS o FROM part GROUP BY 1, 2)
SELECT p_brand, types, sizes FROM (SELECT p_brand, array_to_string(list(p_type ORDER BY o), '|') AS types FROM b GROUP BY 1) JOIN (SELECT p_brand, array_to_string(list(p_size ORDER BY o), '|') AS sizes FROM s GROUP BY 1) USING (p_brand)""")
def ag28_first_seen_sets(t) -> DataFrame:
    out = A.first_seen_sets(t.part, ["p_brand"], ["p_retailprice", "p_partkey"], ["p_type", "p_size"])
    return out.select("p_brand", F.array_join("p_type", "|").alias("types"), F.array_join(F.transform("p_size", lambda x: x.cast("string")), "|").alias("sizes"))


@query("""WITH b AS (SELECT l_partkey, l_returnflag AS batch, min(l_suppkey) AS priority, min(l_discount) AS score, max(l_quantity) AS sources FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, min(priority) AS priority, arg_min(score, (priority, batch)) AS score, arg_min(sources, (priority, batch)) AS sources FROM b GROUP BY 1""")
def ag31_lexical_profiles(t) -> DataFrame:
    rows = t.lineitem.select("l_partkey", F.col("l_returnflag").alias("batch"), F.col("l_suppkey").alias("priority"), F.col("l_discount").alias("score"), F.col("l_quantity").alias("sources"))
    return A.lexical_profiles(rows, ["l_partkey"], "batch", "priority", ["score"], ["sources"])


@query("""SELECT o_custkey, min(o_orderpriority) AS canonical, max(o_orderkey % 20) AS token_count FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING bool_or(o_totalprice > 200000) AND max(o_orderkey % 20) BETWEEN 2 AND 16""")
def ag32_attested_groups(t) -> DataFrame:
    rows = t.orders.withColumn("tokens", F.col("o_orderkey") % 20)
    return A.attested_groups(rows, "o_custkey", "o_orderpriority", F.col("o_totalprice") > 200000, "tokens", F.col("o_orderstatus") != "P")


@query("""WITH r AS (SELECT p_name AS name, p_retailprice AS price, p_partkey AS id, CASE WHEN p_size % 6 = 0 THEN 'unresolved' WHEN p_size % 2 = 0 THEN 'exact' ELSE 'composed' END AS status, p_brand AS source, p_size % 4 AS tokens FROM part)
SELECT 'status' AS measure, status AS label, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'tokens', tokens::VARCHAR, count(*) FROM r GROUP BY 2
UNION ALL SELECT 'unresolved', name, 1 FROM (SELECT * FROM r WHERE status = 'unresolved' ORDER BY price DESC, id LIMIT 20)""")
def ag34_coverage_audit(t) -> DataFrame:
    status = F.when(F.col("p_size") % 6 == 0, "unresolved").when(F.col("p_size") % 2 == 0, "exact").otherwise("composed")
    rows = t.part.select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("id"), status.alias("status"), F.col("p_brand").alias("source"), (F.col("p_size") % 4).alias("tokens"))
    return A.coverage_audit(rows, "status", "source", "tokens", "name", [F.desc("price"), F.asc("id")])


_PAIRS = f"(SELECT DISTINCT a.conv_id, a.w AS a, b.w AS b FROM {_TURNS} a JOIN {_TURNS} b ON a.conv_id = b.conv_id AND a.r = b.r AND a.w <> b.w)"
_OCC = f"""(SELECT l.conv_id, l.turn AS lt, r.turn AS rt, 'identity' AS type FROM {_TURNS} l JOIN {_TURNS} r ON l.conv_id = r.conv_id AND l.w = r.w AND l.turn < r.turn
 UNION ALL SELECT l.conv_id, l.turn, r.turn, 'proxy' FROM {_TURNS} l JOIN {_PAIRS} p ON l.conv_id = p.conv_id AND l.w = p.a JOIN {_TURNS} r ON r.conv_id = p.conv_id AND r.w = p.b AND l.turn < r.turn)"""


def _occurrences(t) -> DataFrame:
    turns = _turns(t).withColumnRenamed("w", "word")
    own = turns.select("conv_id", "word", "r").distinct()
    rel = own.withColumnRenamed("word", "a").join(own.withColumnRenamed("word", "b"), ["conv_id", "r"]).where("a != b").select("conv_id", "a", "b", F.lit("proxy").alias("type"), F.lit(0.5).alias("score"))
    return S.occurrence_relations(turns.drop("r"), rel, "conv_id", "turn")


@query(f'SELECT conv_id, lt AS "left", rt AS "right", type FROM {_OCC}')
def jn19_occurrence_relations(t) -> DataFrame:
    return _occurrences(t).select("conv_id", "left", "right", "type")


@query(f"SELECT type, count(*) AS n FROM {_OCC} GROUP BY 1")
def sc06_relation_counts(t) -> DataFrame:
    return S.relation_counts(_occurrences(t), [])


@query(f"""WITH g AS (SELECT conv_id, r AS label, turn, turn - lag(turn) OVER (PARTITION BY conv_id, r ORDER BY turn) AS gap FROM {_TURNS})
SELECT conv_id, label, count(*) AS lines, min(turn) AS first_line, max(turn) AS last_line, max(gap) AS widest_gap FROM g GROUP BY 1, 2 HAVING count(*) > 1""")
def sc07_chains(t) -> DataFrame:
    return S.chains(_turns(t).withColumnRenamed("r", "label"), "conv_id", "turn")
