"""Audits, morphology, ranking policies and merges on the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klangwerk.functions import text as T
from klangwerk.operators import aggregates as G
from klangwerk.operators import policies as Y
from klangwerk.operators import audit as A
from klangwerk.operators import corpus as C
from klangwerk.operators import evaluation as E
from klangwerk.operators import morphology as M
from klangwerk.operators import phrases as H
from klangwerk.operators import ranking as R
from klangwerk.operators import relational as O

from .corpus import _tokens
from .registry import query

_LEX = f"(SELECT form, count(*) AS n FROM (SELECT unnest(tokens) AS form FROM {_tokens('documents')}) WHERE regexp_matches(form, '^[a-zäöüßéèêáíóúñç]+$') GROUP BY form)"


def _lexicon(t) -> DataFrame:
    return C.token_counts(t.documents).where(F.col("form").rlike("^[a-zäöüßéèêáíóúñç]+$"))


@query("""SELECT 'lineitem_part' AS "check", count(*) AS violations FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
UNION ALL SELECT 'orders_customer', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'labels_documents', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
UNION ALL SELECT 'customer_orders_quota', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 10)
UNION ALL SELECT 'returned_and_open', count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'""")
def ev07_invariants(t) -> DataFrame:
    parts = [A.orphans(t.lineitem.select(F.col("l_partkey").alias("p_partkey")), t.part, ["p_partkey"], "lineitem_part"), A.orphans(t.orders.select(F.col("o_custkey").alias("c_custkey")), t.customer, ["c_custkey"], "orders_customer"),
             A.orphans(t.labels, t.documents, ["doc_id"], "labels_documents"), A.excess(t.orders, "o_custkey", 10, "customer_orders_quota"), A.conflicts(t.lineitem, (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "returned_and_open")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""SELECT s_suppkey AS id, s_suppkey IN (SELECT l_suppkey FROM lineitem) AS passed FROM supplier""")
def ev11_sentinels(t) -> DataFrame:
    return A.sentinels(t.lineitem.select(F.col("l_suppkey").alias("id")), t.supplier.select(F.col("s_suppkey").alias("id")), "id")


@query("""SELECT l_orderkey, count(*) AS groups, sum(n - 1)::BIGINT AS excess FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1""")
def ev12_repeat_groups(t) -> DataFrame:
    return A.repeat_groups(t.lineitem, "l_orderkey", "l_returnflag")


@query(f"""WITH k AS (SELECT form FROM {_LEX} WHERE n >= 5), w AS (SELECT item_id, unnest(tokens) AS form FROM {_tokens('benchmark')})
SELECT item_id, count(*) AS tokens, sum(CASE WHEN k.form IS NULL THEN 0 ELSE 1 END)::BIGINT AS known, CASE WHEN sum(CASE WHEN k.form IS NULL THEN 0 ELSE 1 END) = 0 THEN 'none' WHEN sum(CASE WHEN k.form IS NULL THEN 0 ELSE 1 END) = count(*) THEN 'full' ELSE 'partial' END AS coverage
FROM w LEFT JOIN k USING (form) GROUP BY item_id""")
def ev13_coverage(t) -> DataFrame:
    tokens = t.benchmark.select("item_id", F.explode(F.transform(T.word_tokens("text"), F.lower)).alias("form"))
    return A.coverage(tokens, _lexicon(t).where("n >= 5"), "item_id", "form")


@query("""WITH p AS (SELECT * FROM (SELECT o_custkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 20),
 m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY r) AS f, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY r) AS g FROM p)
SELECT o_custkey, count(*) AS results, sum(CASE WHEN f > 1 THEN 1 ELSE 0 END)::BIGINT AS repeated_forms, sum(CASE WHEN g > 1 THEN 1 ELSE 0 END)::BIGINT AS repeated_families FROM m GROUP BY o_custkey""")
def ev06_page_metrics(t) -> DataFrame:
    ranked = t.orders.withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    return A.page_metrics(ranked, "o_custkey", "r", "o_orderpriority", "o_orderstatus")


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def ev22_provenance_duplicates(t) -> DataFrame:
    return A.duplicates(t.lineitem, ["l_orderkey", "l_partkey"])


@query("""SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def ev24_review_problems(t) -> DataFrame:
    return A.review_problems(t.documents, t.labels, "doc_id")


@query("""SELECT user_id, event_type, n, n::DOUBLE / sum(n) OVER (PARTITION BY user_id) AS share, n >= 10 AS saturated FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)""")
def ev25_channel_mix(t) -> DataFrame:
    return A.channel_mix(t.events, "user_id", "event_type", 10)


@query("""WITH a AS (SELECT p_brand AS k, p_partkey AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), b AS (SELECT p_brand AS k, p_partkey AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part WHERE p_size > 3),
 d AS (SELECT coalesce(a.k, b.k) AS k, min(CASE WHEN a.x IS DISTINCT FROM b.x THEN coalesce(a.r, b.r) END) AS first_mismatch FROM a FULL JOIN b ON a.k = b.k AND a.r = b.r GROUP BY 1),
 s AS (SELECT coalesce(a.k, b.k) AS k, count(*) FILTER (WHERE b.x IS NULL) AS only_left, count(*) FILTER (WHERE a.x IS NULL) AS only_right FROM a FULL JOIN b ON a.k = b.k AND a.x = b.x GROUP BY 1)
SELECT k, first_mismatch, only_left, only_right FROM d JOIN s USING (k)""")
def ev17_ordered_difference(t) -> DataFrame:
    side = lambda df, o: df.select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("x"), F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc(o), "p_partkey")).cast("long").alias("r"))
    return E.ordered_difference(side(t.part, "p_retailprice"), side(t.part.where("p_size > 3"), "p_size"), "k", "r", "x")


@query(f"""WITH lex AS {_LEX}, s AS (SELECT form, left(form, i) AS written, substr(form, i + 1) AS rgt FROM (SELECT form, unnest(range(3, length(form) - 2)) AS i FROM lex WHERE length(form) >= 6)),
 r AS (SELECT s.form, written, rgt, lex.n AS rn FROM s JOIN lex ON lex.form = rgt),
 v AS (SELECT DISTINCT form, written, rgt, rn, unnest([written, CASE WHEN written LIKE '%es' AND length(written) >= 5 THEN left(written, -2) END, CASE WHEN written LIKE '%en' AND length(written) >= 5 THEN left(written, -2) END, CASE WHEN written LIKE '%er' AND length(written) >= 5 THEN left(written, -2) END,
   CASE WHEN written LIKE '%s' AND length(written) >= 4 THEN left(written, -1) END, CASE WHEN written LIKE '%n' AND length(written) >= 4 THEN left(written, -1) END, CASE WHEN written LIKE '%e' AND length(written) >= 4 THEN left(written, -1) END, written || 'e']) AS lft FROM r)
SELECT form, lft AS "left", written, rgt AS "right" FROM (SELECT v.*, row_number() OVER (PARTITION BY v.form ORDER BY length(rgt) DESC, rn DESC, l.n DESC, lft) AS k FROM v JOIN lex l ON l.form = lft) WHERE k = 1""")
def jn17_compound_heads(t) -> DataFrame:
    lex = _lexicon(t)
    return M.compound_heads(lex, lex)


@query(f"""WITH lex AS {_LEX}, s AS (SELECT form, substr(form, i + 1) AS suffix FROM (SELECT form, unnest(range(3, length(form) - 2)) AS i FROM lex WHERE length(form) >= 6))
SELECT s.form, arg_max(suffix, length(suffix)) AS suffix FROM s JOIN lex ON lex.form = suffix GROUP BY s.form""")
def ph30_longest_known_suffix(t) -> DataFrame:
    lex = _lexicon(t)
    return M.longest_known_suffix(lex, lex)


_INFLECT = ", ".join(f"CASE WHEN form LIKE '%{e}' AND length(form) >= {len(e) + 2} THEN {{'lemma': left(form, -{len(e)}) || '{p}', 'inflection': '{k}'}} END" for e, p, k in M.ENDINGS)


@query(f"""WITH lex AS {_LEX}, o AS (SELECT form, unnest([{_INFLECT}]) AS o FROM lex) SELECT DISTINCT o.form, o.o.lemma AS lemma, o.o.inflection AS inflection FROM o JOIN lex ON lex.form = o.o.lemma""")
def ph34_inflections(t) -> DataFrame:
    lex = _lexicon(t)
    return M.inflected_from(lex, lex)


@query(f"""WITH c AS (SELECT source, g AS phrase, count(*) AS n FROM (SELECT source, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS g FROM {_tokens('documents')} WHERE len(tokens) >= 2) GROUP BY 1, 2),
 s AS (SELECT source, count(*) AS total FROM documents GROUP BY 1) SELECT phrase, round(sum(ln(1 + n * 1000000.0 / total)) / 20, 4) AS commonness, count(*) AS in_corpora FROM c JOIN s USING (source) GROUP BY phrase HAVING count(*) >= 3""")
def ag09_phrase_commonness(t) -> DataFrame:
    tokens = t.documents.select("source", F.transform(T.word_tokens("text"), F.lower).alias("tokens"))
    pairs = tokens.select("source", F.explode(T.neighbours("tokens")).alias("phrase")).groupBy("source", "phrase").agg(F.count("*").alias("n"))
    totals = t.documents.groupBy("source").agg(F.count("*").alias("total"))
    return H.commonness(pairs, totals, 20).where("in_corpora >= 3").select("phrase", F.round("commonness", 4).alias("commonness"), "in_corpora")


@query("""SELECT p_brand, array_to_string(list_sort(list(DISTINCT w)), ',') AS words FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY p_brand""")
def ag24_set_union(t) -> DataFrame:
    words = G.merged_sets(t.part.withColumn("words", F.split("p_name", " ")), ["p_brand"], "words")
    return words.select("p_brand", F.array_join("words", ",").alias("words"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS variant FROM orders)
SELECT o_custkey, o_orderkey, variant, coalesce(variant = min(CASE WHEN o_orderstatus = 'F' THEN variant END) OVER (PARTITION BY o_custkey), false) AS preferred FROM r""")
def ag23_preferred_variant(t) -> DataFrame:
    """A customer's orders as variants; the first finished one is preferred."""
    order = [F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")]
    return G.ranked_variants(t.orders, ["o_custkey"], order, F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey", "variant", "preferred")


@query("""WITH p AS (SELECT DISTINCT p_type, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 20),
 s AS (SELECT a.p_type, 1.0 - abs(a.p_size - b.p_size) / 50.0 AS s FROM p a JOIN p b ON a.p_type = b.p_type AND a.p_size < b.p_size)
SELECT p_type, items, round(m, 9) AS mean_similarity, round(x, 9) AS max_similarity FROM (SELECT p_type, count(*) AS items FROM p GROUP BY 1) LEFT JOIN (SELECT p_type, avg(s) AS m, max(s) AS x FROM s GROUP BY 1) USING (p_type)""")
def ag29_pairwise_similarity(t) -> DataFrame:
    """The twenty dearest parts of each type as a page: how alike its sizes are."""
    page = O.top_per_group(t.part, ["p_type"], [F.desc("p_retailprice"), F.asc("p_partkey")], 20)
    out = G.pairwise_similarity(page, ["p_type"], "p_size", lambda a, b: 1.0 - F.abs(a - b) / 50.0, 20)
    return out.select("p_type", "items", F.round("mean_similarity", 9).alias("mean_similarity"), F.round("max_similarity", 9).alias("max_similarity"))


@query("""WITH e AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), c AS (SELECT a, b, count(*) AS n FROM e WHERE b IS NOT NULL GROUP BY 1, 2),
 fwd AS (SELECT a, b AS m, n::DOUBLE / sum(n) OVER (PARTITION BY a) AS p FROM c), bwd AS (SELECT b AS z, a AS m, n::DOUBLE / sum(n) OVER (PARTITION BY b) AS q FROM c)
SELECT a AS start_type, z AS end_type, m AS middle, sqrt(p * q) AS bridge FROM fwd JOIN bwd USING (m)""")
def jn20_bridge(t) -> DataFrame:
    pairs = t.events.select(F.col("event_type").alias("a"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("b")).where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))
    out = C.bridges(G.shares(pairs, ["a"], "n", "p").select("a", "b", "p"), G.shares(pairs, ["b"], "n", "q").select("a", "b", "q"))
    return out.select(F.col("a").alias("start_type"), F.col("z").alias("end_type"), F.col("m").alias("middle"), "bridge")


@query("""SELECT p_brand, p_partkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY tier, floor((1.0 - score + 1e-9) / 0.02), dist, ppm DESC, p_retailprice DESC, score DESC, p_name, p_partkey) AS r FROM
 (SELECT *, p_size % 4 AS tier, (p_partkey % 97) / 97.0::DOUBLE AS score, p_size % 3 AS dist, rank() OVER (PARTITION BY p_type ORDER BY p_retailprice) AS ppm FROM part)) WHERE r <= 25""")
def rk14_entity_order(t) -> DataFrame:
    rows = t.part.withColumn("tier", F.col("p_size") % 4).withColumn("score", F.col("p_partkey") % 97 / 97.0).withColumn("dist", F.col("p_size") % 3).withColumn("ppm", F.rank().over(Window.partitionBy("p_type").orderBy("p_retailprice")))
    order = [F.asc("tier"), T.deficit_band("score"), F.asc("dist"), F.desc("ppm"), F.desc("p_retailprice"), F.desc("score"), F.asc("p_name"), F.asc("p_partkey")]
    return O.top_per_group(rows, ["p_brand"], order, 25).select("p_brand", "p_partkey", "rank")


@query("""WITH o AS (SELECT *, o_custkey % 10 AS query, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey % 10, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS c FROM orders),
 n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN a <= 20 THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey) AS task FROM o WHERE a <= 20 OR c <= 10)
SELECT query, o_orderkey, o_orderpriority, task FROM n WHERE task <= 60""")
def rk24_stratified_tasks(t) -> DataFrame:
    rows = t.orders.withColumn("query", F.col("o_custkey") % 10)
    return Y.stratified_tasks(rows, "query", "o_orderpriority", [F.desc("o_totalprice"), F.asc("o_orderkey")], 20, 10, 60).select("query", "o_orderkey", "o_orderpriority", "task")


@query("""SELECT p_partkey, floor((0.60 * (p_size / 50.0) + 0.15 * (p_retailprice / 2100.0) + 0.10 * CASE WHEN p_name LIKE '%e%' THEN 1 ELSE 0 END + 0.05 * 0.5) * 1000 + 0.003)::BIGINT AS popularity, floor(sqrt((p_size * 20000)::DOUBLE * (p_partkey % 1000 * 1000)))::BIGINT AS cut FROM part""")
def sf19_popularity(t) -> DataFrame:
    from klangwerk.operators.entities import hybrid_cut_score

    score = T.popularity(qrank=F.col("p_size") / 50.0, sitelinks=F.col("p_retailprice") / 2100.0, bilingual=F.when(F.col("p_name").contains("e"), 1.0).otherwise(0.0), external=F.lit(None).cast("double"), statements=F.lit(0.5))
    cut = hybrid_cut_score((F.col("p_size") * 20000).cast("long"), F.col("p_partkey") % 1000 * 1000)
    return t.part.select("p_partkey", F.floor(score * 1000 + 0.003).cast("long").alias("popularity"), cut.alias("cut"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN l_quantity >= 25 THEN 0 ELSE 1 END)::BIGINT AS rejected FROM lineitem GROUP BY 1, 2""")
def ev10_cut_summary(t) -> DataFrame:
    from klangwerk.operators.entities import cut_summary

    return cut_summary(t.lineitem, F.col("l_quantity") >= 25, "l_returnflag", "l_linestatus")


@query("""WITH n AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT user_id, count(*) AS steps, sum(CASE WHEN prev = event_type THEN 1 ELSE 0 END)::BIGINT AS repeated, count(DISTINCT event_type) AS kinds FROM n GROUP BY user_id""")
def ui03_previous_placement(t) -> DataFrame:
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.withColumn("prev", prev).groupBy("user_id").agg(F.count("*").alias("steps"), F.sum(F.when(F.col("prev") == F.col("event_type"), 1).otherwise(0)).alias("repeated"), F.countDistinct("event_type").alias("kinds"))


@query("""SELECT conv_id, count(*) AS turns, max(n) AS longest, sum(n)::BIGINT AS tokens FROM (SELECT conv_id, len(tokens) AS n FROM """ + _tokens("conversations") + """) GROUP BY conv_id""")
def sf14_lyric_tokens(t) -> DataFrame:
    return t.conversations.select("conv_id", F.size(T.word_tokens("text")).cast("long").alias("n")).groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("n").alias("longest"), F.sum("n").alias("tokens"))


@query("""SELECT lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) AS host, count(*) AS pages, sum(length(html))::BIGINT AS chars, max(length(regexp_replace(html, '<[^>]*>', '', 'g'))) AS longest_text FROM pages GROUP BY 1""")
def ag06_page_hosts(t) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1))
    return t.pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).cast("long").alias("chars"), F.max(F.length(F.regexp_replace("html", "<[^>]*>", ""))).cast("long").alias("longest_text"))
