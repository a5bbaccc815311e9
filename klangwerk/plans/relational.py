"""Relational operators of the inventory on the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klangwerk.functions import text as T
from klangwerk.operators import aggregates as A
from klangwerk.operators import filters as X
from klangwerk.operators import policies as Y
from klangwerk.operators import ranking as R
from klangwerk.operators import relational as O

from .registry import query


@query("""WITH u AS (SELECT 's' AS language, s_suppkey AS id, s_name AS name, s_acctbal AS usage FROM supplier
                UNION ALL SELECT 'c', c_custkey, c_name, c_acctbal FROM customer),
  o AS (SELECT *, CASE WHEN usage IS NULL OR usage <= 0 THEN 1 ELSE 0 END AS rank_class FROM u),
  p AS (SELECT *, row_number() OVER (PARTITION BY language, rank_class ORDER BY usage DESC, id) AS k, count(*) OVER (PARTITION BY language, rank_class) AS n FROM o)
SELECT language, id, rank_class::INTEGER AS rank_class, row_number() OVER (ORDER BY rank_class, k::DOUBLE / n, language, id)::BIGINT AS ordinal FROM p""")
def wn01_interleave(t) -> DataFrame:
    u = t.supplier.select(F.lit("s").alias("language"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("usage")).unionByName(
        t.customer.select(F.lit("c").alias("language"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("usage")))
    u = u.withColumn("rank_class", F.when(F.coalesce(F.col("usage"), F.lit(0.0)) <= 0, 1).otherwise(0))
    shared = R.interleave(u, "language", "rank_class", [F.desc("usage"), F.asc("id")])
    placed = R.ordinals(shared, [F.asc("rank_class"), F.asc("share"), F.asc("language"), F.asc("id")], F.col("rank_class") * 1000 + F.floor(F.col("share") * 256))
    return placed.select("language", "id", "rank_class", "ordinal")


@query("""SELECT p_brand, p_partkey, fill_rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand
  ORDER BY CASE WHEN p_size > 40 THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey) AS fill_rank FROM part) WHERE fill_rank <= 10""")
def wn02_nested_quota(t) -> DataFrame:
    return R.quota_fill(t.part, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 10, F.col("p_size") > 40).select("p_brand", "p_partkey", "fill_rank")


@query("SELECT o_custkey, arg_min(o_orderpriority, (o_orderpriority, o_orderkey)) AS primary_priority, count(*) AS orders FROM orders GROUP BY o_custkey")
def wn03_primary_category(t) -> DataFrame:
    first = O.best_per_group(t.orders, ["o_custkey"], [F.asc("o_orderpriority"), F.asc("o_orderkey")]).select("o_custkey", F.col("o_orderpriority").alias("primary_priority"))
    return first.join(t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders")), "o_custkey")


@query("""SELECT l_partkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey
  ORDER BY abs(l_quantity - 25), l_quantity, l_extendedprice, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 5""")
def jn02_bounded_lookup(t) -> DataFrame:
    order = [F.abs(F.col("l_quantity") - 25), F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return O.top_per_group(t.lineitem, ["l_partkey"], order, 5).select("l_partkey", "l_orderkey", "l_linenumber", "rank")


@query("""SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey))::BIGINT AS rank,
  CASE WHEN count(*) OVER (PARTITION BY c_nationkey) = 1 THEN 1.0 ELSE 1.0 - (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1)::DOUBLE / (count(*) OVER (PARTITION BY c_nationkey) - 1) END AS percentile FROM customer""")
def wn07_rank_percentile(t) -> DataFrame:
    order = [F.desc("c_acctbal"), F.asc("c_custkey")]
    p = R.rank_percentile(t.customer, ["c_nationkey"], order)
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*order)).cast("long")).select("c_custkey", "rank", "percentile")


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN 1000000 ELSE (below * 2000000 + (n - 1)) // (2 * (n - 1)) END::BIGINT AS ppm,
  CASE WHEN (CASE WHEN n = 1 THEN 1000000 ELSE (below * 2000000 + (n - 1)) // (2 * (n - 1)) END) >= 800000 THEN 'A'
       WHEN (CASE WHEN n = 1 THEN 1000000 ELSE (below * 2000000 + (n - 1)) // (2 * (n - 1)) END) >= 350000 THEN 'B' ELSE 'C' END AS tier
  FROM (SELECT p_partkey, rank() OVER (PARTITION BY p_type ORDER BY p_retailprice) - 1 AS below, count(*) OVER (PARTITION BY p_type) AS n FROM part)""")
def wn08_tie_percentile(t) -> DataFrame:
    p = R.tie_percentile_ppm(t.part, ["p_type"], "p_retailprice")
    return p.select("p_partkey", "ppm", R.popularity_tier(F.col("ppm") / 1_000_000).alias("tier"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before_quantity FROM lineitem""")
def wn14_cumulative_offsets(t) -> DataFrame:
    return A.cumulative_offsets(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity", "before_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "before_quantity")


@query("""SELECT p_partkey, (max(p_retailprice) OVER (PARTITION BY p_brand, p_type)) - p_retailprice AS delta FROM part""")
def wn10_delta_to_best(t) -> DataFrame:
    return A.delta_to_best(t.part, ["p_brand", "p_type"], "p_retailprice").select("p_partkey", "delta")


@query("""WITH w AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
 e AS (SELECT a, b FROM w UNION ALL SELECT NULL, a FROM w WHERE p IS NULL)
SELECT a AS from_type, b AS to_type, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY a) AS probability FROM e GROUP BY 1, 2""")
def wn12_transitions(t) -> DataFrame:
    """Neighbouring event types of each user, and with which types users begin and end."""
    out = A.transitions(t.events, ["user_id"], ["ts", "event_id"], "event_type")
    return out.select(F.col("from_value").alias("from_type"), F.col("to_value").alias("to_type"), "n", "probability")


@query("""WITH e AS (SELECT event_id, user_id, event_type, ts FROM events),
 d AS (SELECT event_id, CASE WHEN lead(event_type,1) OVER w = event_type THEN 1 WHEN lead(event_type,2) OVER w = event_type THEN 2
  WHEN lead(event_type,3) OVER w = event_type THEN 3 WHEN lead(event_type,4) OVER w = event_type THEN 4 END AS distance FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT distance::INTEGER AS distance, count(*) AS n FROM d WHERE distance IS NOT NULL GROUP BY 1""")
def wn11_repeat_distance(t) -> DataFrame:
    found = A.repeat_distance(t.events, ["user_id"], ["ts", "event_id"], "event_type")
    return found.where("distance IS NOT NULL").groupBy("distance").agg(F.count("*").alias("n"))


@query("""SELECT event_id, round(avg(floor(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 4) AS rolling_mean FROM events""")
def ag27_rolling_mean_parts(t) -> DataFrame:
    """Mean of the last hundred values of each user, in hundredths so that sums are exact."""
    cents = t.events.withColumn("cents", F.floor(F.col("value") * 100).cast("long"))
    return A.rolling_mean(cents, ["user_id"], ["ts", "event_id"], "cents").select("event_id", F.round("rolling_mean", 4).alias("rolling_mean"))


@query("""SELECT p_brand, arg_min(p_partkey, (-p_retailprice, p_partkey)) AS best, max(p_retailprice) AS price FROM part GROUP BY p_brand""")
def ag01_best_per_group(t) -> DataFrame:
    return O.best_per_group(t.part, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_brand", F.col("p_partkey").alias("best"), F.col("p_retailprice").alias("price"))


@query("""SELECT p_type, count(*) AS n, quantile_cont(p_retailprice, 0.25) AS p25, quantile_cont(p_retailprice, 0.5) AS median, quantile_cont(p_retailprice, 0.75) AS p75,
 quantile_cont(p_retailprice, 0.9) AS p90, quantile_cont(p_retailprice, 0.95) AS p95 FROM part GROUP BY p_type""")
def ag15_distribution(t) -> DataFrame:
    return A.distribution(t.part, ["p_type"], "p_retailprice").drop("mean")


@query("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max_value, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def ag16_nearest_rank(t) -> DataFrame:
    """Timing summary by event type: nearest-rank quantiles and the population deviation."""
    out = A.nearest_rank(t.events, ["event_type"], "value")
    return out.select("event_type", "p50", "p95", F.col("largest").alias("max_value"), "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("""SELECT c_mktsegment, count(*) AS n, sum((c_acctbal < 0)::INT)::BIGINT AS negative, sum((c_acctbal > 5000)::INT)::BIGINT AS rich, round(avg(c_nationkey), 6) AS mean_nation FROM customer GROUP BY c_mktsegment""")
def ag07_catalogue_stats(t) -> DataFrame:
    own = A.catalogue_stats(t.customer, {"negative": F.col("c_acctbal") < 0, "rich": F.col("c_acctbal") > 5000}, ["c_nationkey"], ["c_mktsegment"])
    return own.select("c_mktsegment", "n", "negative", "rich", F.round("mean_c_nationkey", 6).alias("mean_nation"))


@query("""SELECT o_custkey, count(*) AS orders, count(DISTINCT o_orderpriority) AS kinds, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders GROUP BY o_custkey HAVING count(*) >= 3""")
def ag05_grouped_search(t) -> DataFrame:
    return A.aggregated_search(t.orders, ["o_custkey"], 3, kinds=F.countDistinct("o_orderpriority"), first_date=F.min("o_orderdate"), last_date=F.max("o_orderdate")).withColumnRenamed("n", "orders")


@query("""WITH tags AS (SELECT event_id, unnest([event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END]) AS type FROM events) SELECT type, count(*) AS n FROM tags GROUP BY type""")
def ag03_count_by_type(t) -> DataFrame:
    tags = F.array("event_type", F.when(F.col("value") > 50, "high").otherwise("low"))
    return A.count_by_type(t.events.select(tags.alias("types")), "types")


@query("""WITH s AS (SELECT l_orderkey, coalesce(list_sort(list(DISTINCT CASE WHEN l_quantity >= 10 THEN l_returnflag END) FILTER (l_quantity >= 10)), []) AS v FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(v, ',') AS flags, CASE len(v) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'converged' ELSE 'conflict' END AS consensus FROM s""")
def ag21_consensus_and_set_merge(t) -> DataFrame:
    """Orders by the agreement of their lines' flags; lines of small quantity say nothing, so some orders stay unresolved."""
    said = t.lineitem.select("l_orderkey", F.when(F.col("l_quantity") >= 10, F.col("l_returnflag")).alias("flag"))
    return A.consensus(said, ["l_orderkey"], "flag").select("l_orderkey", F.array_join("values", ",").alias("flags"), F.col("state").alias("consensus"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def ag25_summary_counters(t) -> DataFrame:
    return A.summary_counts(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def ag14_unique_key_invariant(t) -> DataFrame:
    return A.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)""")
def jn10_semi_join(t) -> DataFrame:
    return O.semi(t.customer, t.orders.where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jn11_anti_join(t) -> DataFrame:
    return O.anti(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("""SELECT p_name, count(DISTINCT p_brand) AS locales FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1""")
def jn12_ambiguous_names(t) -> DataFrame:
    return O.ambiguous_names(t.part.withColumn("one", F.lit(1)), "one", "p_name", "p_brand").select("p_name", "locales")


@query("""SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(total, 0.0) AS largest FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def jn13_left_with_defaults(t) -> DataFrame:
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("largest"))
    return O.left_with_defaults(t.customer.select("c_custkey"), per, ["c_custkey"], {"orders": 0, "largest": 0.0})


@query("""SELECT c_custkey, o_orderkey AS last_order FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def jn22_best_current_row(t) -> DataFrame:
    last = O.best_per_group(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("last_order"))
    return t.customer.select("c_custkey").join(last, "c_custkey", "left")


_POSTINGS = """(SELECT p_partkey AS id, 'brand' AS channel, 0 AS channel_order, p_brand AS key FROM part UNION ALL SELECT p_partkey, 'type', 1, p_type FROM part UNION ALL SELECT p_partkey, 'size', 2, p_size::VARCHAR FROM part)"""


@query(f"SELECT channel, count(*) AS n, count(DISTINCT key) AS keys FROM {_POSTINGS} GROUP BY channel")
def st01_postings(t) -> DataFrame:
    p = O.postings(t.part, "p_partkey", {"brand": "p_brand", "type": "p_type", "size": "p_size"})
    return p.groupBy("channel").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@query(f"""WITH x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel, key ORDER BY id) AS r FROM {_POSTINGS}) WHERE r <= 50),
 h AS (SELECT q.id AS query_id, x.id AS target_id, min(q.channel_order) AS channel_order, count(*) AS channels FROM {_POSTINGS} q JOIN x ON q.channel = x.channel AND q.key = x.key WHERE q.id <> x.id AND q.id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, target_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY channels DESC, channel_order, target_id) AS rank FROM h) WHERE rank <= 10""")
def jn01_multi_channel_retrieval(t) -> DataFrame:
    """The stated query set, ids divisible by 50, against the fifty first rows of every posting: each lookup is bounded."""
    p = O.postings(t.part, "p_partkey", {"brand": "p_brand", "type": "p_type", "size": "p_size"})
    asked = p.where("p_partkey % 50 = 0")
    bounded = O.top_per_group(p, ["channel", "key"], [F.asc("p_partkey")], 50).drop("rank")
    hits = O.retrieve(asked.withColumnRenamed("p_partkey", "query_id"), bounded.withColumnRenamed("p_partkey", "target_id"), "query_id", "target_id").where("query_id <> target_id")
    return O.top_per_group(hits, ["query_id"], [F.desc(F.size("channels")), F.asc("channel_order"), F.asc("target_id")], 10).select("query_id", "target_id", "rank")


@query("""SELECT count(*) AS missing FROM (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part)""")
def st02_nesting_check(t) -> DataFrame:
    return O.missing_rows(t.part.select("p_partkey"), t.lineitem.select(F.col("l_partkey").alias("p_partkey")).distinct()).agg(F.count("*").alias("missing"))


@query("""SELECT coalesce(c.k, s.k) AS nation, CASE WHEN c.k IS NOT NULL AND s.k IS NOT NULL THEN 'both' WHEN c.k IS NOT NULL THEN 'word' ELSE 'entity' END AS kind, customers, suppliers
 FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) s ON c.k = s.k""")
def st05_consolidate(t) -> DataFrame:
    w = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    e = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return O.consolidate(w, e, ["nation"]).select("nation", "kind", "customers", "suppliers")


@query("""WITH a AS (SELECT o_custkey AS cust, list_sort(list(DISTINCT o_orderpriority)) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS cust, list_sort(list(DISTINCT o_orderpriority)) AS y FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT cust, len(list_intersect(x, y))::BIGINT AS shared, len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) AS jaccard,
 len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i]))::BIGINT AS common_prefix FROM a JOIN b USING (cust)""")
def st06_overlap(t) -> DataFrame:
    """Priorities of a customer's finished and open orders: shared ones, Jaccard and common beginning of the sorted lists."""
    side = lambda s, n: A.merged_sets(t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias(n)), ["cust"], n)
    return side("F", "x").join(side("O", "y"), "cust").select("cust", A.result_overlap("x", "y").alias("o")).select("cust", "o.*")


@query("""WITH u AS (SELECT p_brand, p_type, p_retailprice AS price, p_partkey AS id, 10 AS authority, 1 AS core, 0 AS generated FROM part WHERE p_size <= 25
 UNION ALL SELECT p_brand, p_type, p_retailprice, p_partkey, 110, 0, 1 FROM part WHERE p_size > 20)
SELECT p_brand, p_type, (arg_min(id, (authority, id))) AS id, min(authority)::INTEGER AS authority, max(core)::INTEGER AS core, max(generated)::INTEGER AS generated FROM u GROUP BY 1, 2""")
def sk03_authority_upsert(t) -> DataFrame:
    core = t.part.where("p_size <= 25").select("p_brand", "p_type", F.col("p_partkey").alias("id"), F.lit(1).alias("core"), F.lit(0).alias("generated"))
    generated = t.part.where("p_size > 20").select("p_brand", "p_type", F.col("p_partkey").alias("id"), F.lit(0).alias("core"), F.lit(1).alias("generated"))
    return O.authority_upsert([(core, 10), (generated, 110)], ["p_brand", "p_type"], ["id"], ["core", "generated"])


@query("SELECT event_type, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def sk04_counter_upsert(t) -> DataFrame:
    batch = lambda cond: t.events.where(cond).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("total"))
    return O.counter_upsert([batch("value < 50"), batch("value >= 50 OR value IS NULL")], ["event_type"], ["n", "total"])


@query("""SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE l.l_partkey IN (SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 20)""")
def sk08_closure_copy(t) -> DataFrame:
    chosen = O.top_per_group(t.part, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 20).select(F.col("p_partkey").alias("l_partkey"))
    return O.closure_copy(chosen, t.lineitem, ["l_partkey"]).select("l_orderkey", "l_linenumber")


@query("""SELECT count(*) AS n, sum(('0x' || substr(sha256(c_custkey::VARCHAR || chr(1) || c_name || chr(1) || c_mktsegment), 1, 12))::BIGINT)::VARCHAR AS h FROM customer""")
def sk09_fingerprint(t) -> DataFrame:
    return O.fingerprint(t.customer, ["c_custkey", "c_name", "c_mktsegment"]).select("n", F.col("h").cast("string").alias("h"))


@query("""SELECT s_name, o FROM (SELECT s_name, row_number() OVER (ORDER BY s_name, s_suppkey)::BIGINT AS o FROM supplier)""")
def wn06_ordinals(t) -> DataFrame:
    return R.ordinals(t.supplier, [F.asc("s_name"), F.asc("s_suppkey")], F.left("s_name", F.lit(16)), "o").select("s_name", "o")


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) <= 2 AS f FROM part),
 n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN f THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey) AS r FROM m) SELECT p_brand, p_type, p_partkey FROM n WHERE r <= 15""")
def rk04_type_coverage(t) -> DataFrame:
    return R.type_coverage(t.part, "p_brand", "p_type", [F.desc("p_retailprice"), F.asc("p_partkey")], 2, 15).select("p_brand", "p_type", "p_partkey")


@query("""SELECT c_mktsegment, c_custkey FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('seed' || chr(0) || c_custkey::VARCHAR), c_custkey) AS r FROM customer) WHERE r <= 5""")
def rk19_stable_sample(t) -> DataFrame:
    return R.stable_sample(t.customer, ["c_mktsegment"], "c_custkey", "seed", 5).select("c_mktsegment", "c_custkey")


@query("""SELECT o_orderkey, highest_before FROM (SELECT o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before FROM orders) WHERE highest_before > o_totalprice""")
def rk16_rank_violations(t) -> DataFrame:
    o = t.orders.withColumn("place", F.struct("o_orderdate", "o_orderkey"))
    return R.rank_violations(o, "o_custkey", "place", "o_totalprice").select("o_orderkey", "highest_before")


@query("""SELECT kind, id, rank FROM (SELECT *, row_number() OVER (ORDER BY balance DESC, kind, id) AS rank FROM (SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier)) WHERE rank <= 50""")
def rk18_merge_limit(t) -> DataFrame:
    side = lambda df, kind, key, value: df.select(F.lit("all").alias("list"), F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(value).alias("balance"))
    parts = [side(t.customer, "c", "c_custkey", "c_acctbal"), side(t.supplier, "s", "s_suppkey", "s_acctbal")]
    return Y.merged_limit(parts, ["list"], [F.desc("balance"), F.asc("kind"), F.asc("id")], 50).select("kind", "id", "rank")


@query("""SELECT p_partkey, floor((1.0 - p_size / 50.0 + 1e-9) / 0.02)::BIGINT AS deficit, floor((p_size / 50.0 + 1e-9) / 0.05)::BIGINT AS band FROM part""")
def sf17_bands(t) -> DataFrame:
    share = F.col("p_size") / 50.0
    return t.part.select("p_partkey", T.deficit_band(share).alias("deficit"), T.score_band(share).alias("band"))


@query("""WITH n AS (SELECT DISTINCT p_type, p_name FROM part) SELECT a.p_type, a.p_name AS a, b.p_name AS b, 1.0 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) AS similarity
 FROM n a JOIN n b ON a.p_type = b.p_type AND a.p_name < b.p_name""")
def sf06_edit_similarity(t) -> DataFrame:
    """The different names of each type, a bounded vocabulary, with each other."""
    n = t.part.select("p_type", "p_name").distinct()
    pairs = n.select("p_type", F.col("p_name").alias("a")).join(n.select("p_type", F.col("p_name").alias("b")), "p_type").where("a < b")
    return pairs.select("p_type", "a", "b", T.edit_similarity("a", "b").alias("similarity"))


@query("""SELECT c_mktsegment, s_suppkey, 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) AS dice FROM
 (SELECT DISTINCT c_mktsegment, c_nationkey, list_distinct(list_transform(range(1, greatest(2, length(c_mktsegment))), lambda i: substr(c_mktsegment, i, 2))) AS x FROM customer) JOIN
 (SELECT s_suppkey, s_nationkey, list_distinct(list_transform(range(1, greatest(2, length(s_name))), lambda i: substr(s_name, i, 2))) AS y FROM supplier) ON c_nationkey = s_nationkey""")
def sf08_bigram_dice(t) -> DataFrame:
    """Suppliers with the different segments of their nation: a supplier meets each value once, not each customer."""
    j = t.customer.select("c_mktsegment", "c_nationkey").distinct().join(t.supplier, F.col("c_nationkey") == F.col("s_nationkey"))
    return j.select("c_mktsegment", "s_suppkey", T.bigram_dice("c_mktsegment", "s_name").alias("dice"))


@query("""SELECT c_name, count(*) AS rows, c_name = 'Customer#00000001' AS exact, max(c_acctbal) AS most FROM customer WHERE starts_with(c_name, 'Customer#00000001') GROUP BY c_name ORDER BY exact DESC, c_name LIMIT 250""")
def fp03_prefix_search(t) -> DataFrame:
    return X.prefix_search(t.customer, "c_name", "Customer#00000001", [F.max("c_acctbal").alias("most")], 250).select("c_name", "rows", "exact", "most")


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'rod') AND contains(p_type, 'M') AND p_size BETWEEN 10 AND 20")
def fp05_contains_filter(t) -> DataFrame:
    """Parts whose type holds an M, whose name names a rod, and of middle size."""
    parts = t.part.withColumn("types", F.split("p_name", " "))
    return X.contains_search(parts, "p_type", "M", "types", "rod", F.col("p_size").between(10, 20)).select("p_partkey", "p_name")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 AND o_orderstatus = 'F' THEN 'A' WHEN o_totalprice >= 100000 THEN 'B' WHEN o_orderstatus <> 'O' THEN 'C' ELSE 'D' END AS tier FROM orders""")
def fp16_quality_tier(t) -> DataFrame:
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return t.orders.select("o_orderkey", X.quality_tier((price >= 200000) & (status == "F"), price >= 100000, status != "O").alias("tier"))


@query("""SELECT user_id, arg_min(scope, prio) AS decision FROM (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'admit' WHEN value > 50 THEN 'review' ELSE 'reject' END AS scope,
 CASE WHEN event_type = 'purchase' THEN 0 WHEN value > 50 THEN 1 ELSE 2 END AS prio FROM events) GROUP BY user_id""")
def fp09_admission(t) -> DataFrame:
    decision = F.when(F.col("event_type") == "purchase", "admit").when(F.col("value") > 50, "review").otherwise("reject")
    return X.admitted(t.events.withColumn("scope", decision), ["user_id"], "scope")


@query("""SELECT l_partkey, l_suppkey, min(l_shipdate) AS first_ship, min(l_quantity) AS least, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS statuses, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1, 2""")
def ag30_evidence_merge(t) -> DataFrame:
    lines = t.lineitem.withColumn("returned", F.col("l_returnflag") == "R")
    out = A.merged_evidence(lines, ["l_partkey", "l_suppkey"], ["l_shipdate", "l_quantity"], ["l_linestatus"], ["returned"])
    return out.select("l_partkey", "l_suppkey", F.col("l_shipdate").alias("first_ship"), F.col("l_quantity").alias("least"), F.array_join("l_linestatus", ",").alias("statuses"), "returned")
