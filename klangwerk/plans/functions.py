"""Functions and set operators on the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klangwerk.functions import surfaces as S
from klangwerk.functions import text as T
from klangwerk.operators import audit as A
from klangwerk.operators import corpus as C
from klangwerk.operators import entities as N
from klangwerk.operators import morphology as M
from klangwerk.operators import phrases as H
from klangwerk.operators import policies as Y
from klangwerk.operators import relational as O
from klangwerk.operators import revisions as V

from .corpus import _W, _tokens
from .more import _LEX, _lexicon
from .registry import query

_WORDS = f"regexp_extract_all(coalesce(text, ''), '{_W}')"


@query("""SELECT conv_id, turn, lower(trim(regexp_replace(regexp_replace(text, '[‘’ʼ´`]', '''', 'g'), '\\s+', ' ', 'g'))) AS plain FROM conversations""")
def sf01_normalize_surface(t) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.normalize_surface("text").alias("plain"))


@query(f"SELECT conv_id, turn, len({_WORDS})::INTEGER AS words, array_to_string({_WORDS}, '|') AS joined FROM conversations")
def sf02_word_tokens(t) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.size(T.word_tokens("text")).alias("words"), F.array_join(T.word_tokens("text"), "|").alias("joined"))


_LINE = "(SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM conversations)"


@query(f"""SELECT conv_id, turn, line_no::INTEGER AS line_no, array_to_string(tokens, ' ') AS tokens FROM (SELECT *, list_transform(regexp_extract_all(line, '{_W}'), lambda x: lower(x)) AS tokens FROM {_LINE})
 WHERE NOT regexp_matches(line, '(?i)https?://|www\\.') AND len(tokens) BETWEEN 3 AND 48 AND length(regexp_replace(line, '[^0-9]', '', 'g')) * 4 <= length(line)""")
def sf03_model_lines(t) -> DataFrame:
    return C.sentence_tokens(t.conversations, "conv_id", "turn").select("conv_id", "turn", "line_no", F.array_join("tokens", " ").alias("tokens"))


_CLASS = ("CASE " + " ".join("WHEN lower(x) IN (" + ", ".join(f"'{w}'" for w in ws) + f") THEN '{k}'" for k, ws in C.FUNCTION_WORDS.items())
          + " WHEN lower(x) = upper(x) THEN 'fixed' WHEN upper(x) = x AND length(x) > 1 THEN 'upper' WHEN left(x, 1) = upper(left(x, 1)) AND substr(x, 2) = lower(substr(x, 2)) THEN 'title' WHEN lower(x) = x THEN 'lower' ELSE 'fixed' END")


@query(f"SELECT conv_id, turn, array_to_string(list_transform({_WORDS}, lambda x: {_CLASS}), ' ') AS shape FROM conversations")
def sf05_shape_key(t) -> DataFrame:
    return t.conversations.select("conv_id", "turn", C.shape_key(T.word_tokens("text")).alias("shape"))


@query("""WITH p AS (SELECT p_partkey, p_name AS a, p_type || ' ' || p_name AS b, lower(p_brand) AS c FROM part), l AS (SELECT *, list_filter(range(1, least(length(a), length(c)) + 1), lambda i: left(a, i) = left(c, i)) AS x, list_filter(range(1, least(length(a), length(b)) + 1), lambda i: right(a, i) = right(b, i)) AS y FROM p)
SELECT p_partkey, len(x)::INTEGER AS prefix, len(y)::INTEGER AS suffix FROM l""")
def sf07_common_ends(t) -> DataFrame:
    b = F.concat_ws(" ", "p_type", "p_name")
    return t.part.select("p_partkey", T.common_prefix_length("p_name", F.lower("p_brand")).alias("prefix"), T.common_suffix_length("p_name", b).alias("suffix"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS x, string_split(p_type || ' ' || reverse(p_name), ' ') AS y, ['red', 'hot', 'rod', 'LARGE'] AS z FROM part)
SELECT p_partkey, len(list_intersect(x, z))::DOUBLE / len(list_distinct(list_concat(x, z))) AS jaccard, len(list_intersect(list_distinct(z), list_distinct(x)))::DOUBLE / len(list_distinct(x)) AS overlap FROM w""")
def sf09_token_sets(t) -> DataFrame:
    """Jaccard similarity and overlap (SF-10) of a name's words with four words."""
    x, z = F.split("p_name", " "), F.array(*map(F.lit, ("red", "hot", "rod", "LARGE")))
    return t.part.select("p_partkey", T.jaccard(x, z).alias("jaccard"), T.token_overlap(z, x).alias("overlap"))


_SURF = "(SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '[1] ' || c_name WHEN 1 THEN c_name || ' …' WHEN 2 THEN '<b>' || c_mktsegment WHEN 3 THEN ' ' WHEN 4 THEN 'a b ' || c_mktsegment WHEN 5 THEN c_mktsegment || '!?' ELSE c_mktsegment END AS s FROM customer)"


def _surfaces(t) -> DataFrame:
    k, n, m = F.col("c_custkey") % 7, F.col("c_name"), F.col("c_mktsegment")
    s = F.when(k == 0, F.concat(F.lit("[1] "), n)).when(k == 1, F.concat(n, F.lit(" …"))).when(k == 2, F.concat(F.lit("<b>"), m)).when(k == 3, " ").when(k == 4, F.concat(F.lit("a b "), m)).when(k == 5, F.concat(m, F.lit("!?"))).otherwise(m)
    return t.customer.select("c_custkey", s.alias("s"))


@query(f"""SELECT c_custkey, CASE WHEN trim(s) = '' THEN 'empty_surface' WHEN regexp_matches(trim(s), '^\\[\\d+\\]\\s*') THEN 'wiktionary_numbered_display' WHEN regexp_matches(s, '\\.\\.\\.|…') THEN 'ellipsis_placeholder' WHEN regexp_matches(s, '\\{{\\{{|\\}}\\}}|<[^>]+>') THEN 'markup_fragment' END AS artifact FROM {_SURF}""")
def sf12_artifacts(t) -> DataFrame:
    return _surfaces(t).select("c_custkey", S.artifact("s").alias("artifact"))


@query(f"""WITH r AS (SELECT c_custkey, c_custkey % 11 = 0 AS h, list_filter([CASE WHEN regexp_matches(s, '\\p{{N}}') THEN 'digit_bearing' END, CASE WHEN c_custkey % 11 = 0 THEN 'historical_only' END,
 CASE WHEN len(list_filter(regexp_extract_all(s, '{_W}'), lambda x: regexp_full_match(x, '\\p{{L}}'))) >= 2 THEN 'multiple_single_letter_tokens' END,
 CASE WHEN length(regexp_replace(s, '[\\p{{L}}\\p{{N}}\\s''’\\-]', '', 'g')) >= 2 AND length(regexp_replace(s, '[\\p{{L}}\\p{{N}}\\s''’\\-]', '', 'g')) >= length(regexp_replace(s, '\\s', '', 'g')) * 0.15 THEN 'punctuation_heavy' END], lambda x: x IS NOT NULL) AS reasons FROM {_SURF})
SELECT c_custkey, CASE WHEN h THEN 'restricted' WHEN len(reasons) > 0 THEN 'marked' ELSE 'safe' END AS safety, array_to_string(reasons, ',') AS reasons FROM r""")
def sf13_safety(t) -> DataFrame:
    s = S.safety("s", F.col("c_custkey") % 11 == 0)
    return _surfaces(t).select("c_custkey", s["class"].alias("safety"), F.array_join(s["reasons"], ",").alias("reasons"))


@query("""SELECT conv_id, turn, lower(regexp_extract(text, '([\\p{L}\\p{N}]+(?:[-''’][\\p{L}\\p{N}]+)*)[^\\p{L}\\p{N}]*$', 1)) AS word FROM conversations""")
def sf15_end_words(t) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.end_word("text").alias("word"))


@query("""SELECT n_nationkey, CASE WHEN k < 26 THEN chr(65 + k) WHEN k < 702 THEN chr(65 + (k - 26) // 26) || chr(65 + k % 26) ELSE chr(65 + (k - 702) // 676) || chr(65 + (k - 702) // 26 % 26) || chr(65 + k % 26) END AS label FROM (SELECT n_nationkey, (n_nationkey * 37)::INTEGER AS k FROM nation)""")
def sf16_scheme_labels(t) -> DataFrame:
    return t.nation.select("n_nationkey", T.scheme_label(F.col("n_nationkey") * 37).alias("label"))


@query("""SELECT p_partkey, CASE WHEN q IS NOT NULL AND u IS NOT NULL THEN floor(sqrt((q * u)::DOUBLE))::BIGINT ELSE floor(coalesce(q, u, 0) / 2.0)::BIGINT END AS cut FROM (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size::BIGINT * 20000 END AS q, CASE WHEN p_size % 4 <> 0 THEN p_partkey % 1000 * 1000 END AS u FROM part)""")
def sf20_cut_score(t) -> DataFrame:
    q, u = F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("long") * 20000), F.when(F.col("p_size") % 4 != 0, F.col("p_partkey") % 1000 * 1000)
    return t.part.select("p_partkey", N.hybrid_cut_score(q, u).alias("cut"))


@query("""SELECT p_partkey, abs(p_size % 6 - 3) <= 0 AS same, abs(p_size % 6 - 3) <= 2 AS near2, p_size % 6 >= 3 AS three, p_size % 6 = 2 AS two FROM part""")
def sf21_syllable_filters(t) -> DataFrame:
    f = lambda m: T.syllable_filter(m, F.col("p_size") % 6, F.lit(3)).alias({"same": "same", "near2": "near2", "3": "three", "2": "two"}[m])
    return t.part.select("p_partkey", f("same"), f("near2"), f("3"), f("2"))


@query("SELECT c_custkey, sha256('s' || chr(0) || c_custkey::VARCHAR) AS score FROM customer")
def sf23_stable_scores(t) -> DataFrame:
    return t.customer.select("c_custkey", T.stable_score("s", "c_custkey").alias("score"))


@query("""SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN 30 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 80 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1000 ELSE 0 END)::INTEGER AS penalty FROM orders""")
def sf27_evidence_penalty(t) -> DataFrame:
    k = F.col("o_orderkey")
    tags = F.array_compact(F.array(F.when(k % 2 == 0, "context"), F.when(k % 3 == 0, "regional"), F.when(k % 5 == 0, "connected"), F.lit("unknown")))
    return t.orders.select("o_orderkey", T.evidence_penalty(tags).alias("penalty"))


@query(f"""WITH lex AS {_LEX}, s AS (SELECT form, unnest(range(3, length(form) - 2)) AS i FROM lex WHERE length(form) >= 6) SELECT form, count(*) AS splits, sum(CASE WHEN left(form, i) LIKE '%s' AND i >= 4 THEN 1 ELSE 0 END)::BIGINT AS linked FROM s GROUP BY form""")
def sf30_split_candidates(t) -> DataFrame:
    """Splits of the corpus's forms, and how many left parts end with a linking s."""
    each = _lexicon(t).select("form", F.explode(T.split_candidates("form")).alias("s"))
    linked = F.array_contains(T.left_variants("s.left"), F.expr("left(s.left, length(s.left) - 1)")) & F.col("s.left").endswith("s") & (F.length("s.left") >= 4)
    return each.groupBy("form").agg(F.count("*").alias("splits"), F.count_if(linked).alias("linked"))


@query("""SELECT l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 60000.0 / 90 / 4 * CASE WHEN l_linenumber % 4 = 0 THEN 4.0 / 3 ELSE 4.0 / 3 END ELSE 60000.0 / 90 / 4 * 2 / 3 END AS ms, round(count(*) / (60000.0 / 90 * 4 / 1000), 6) AS density FROM lineitem GROUP BY l_linenumber""")
def sf32_rhythm(t) -> DataFrame:
    n = t.lineitem.groupBy("l_linenumber").agg(F.count("*").alias("n"))
    ms = S.step_ms(F.lit(90.0), F.lit(16.0), F.col("l_linenumber"), F.lit(True), F.lit(1.0))
    return n.select("l_linenumber", ms.alias("ms"), F.round(S.syllables_per_second(F.col("n"), F.lit(60000.0 / 90 * 4)), 6).alias("density"))


@query(f"""WITH lex AS {_LEX}, v AS (SELECT upper(left(form, 1)) || '-' || substr(form, 2) AS f, form FROM lex WHERE n >= 20 AND left(form, 1) <> 'ß' UNION ALL SELECT form || '''s', form FROM lex WHERE n >= 20 AND left(form, 1) <> 'ß')
SELECT f AS form, lex.form AS target, kind FROM (SELECT f, lower(regexp_replace(f, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS t, 'punctuation' AS kind FROM v UNION ALL SELECT f, lower(regexp_extract(f, '^(.+?)[''’]s?$', 1)), 'possessive' FROM v) a JOIN lex ON lex.form = a.t WHERE a.t <> '' AND a.t <> lower(f)""")
def ph35_aliases(t) -> DataFrame:
    """Forms with a hyphen after the first letter and with a possessive ending, against the corpus lexicon."""
    lex = _lexicon(t)
    often = lex.where("n >= 20 AND left(form, 1) != 'ß'")  # whose capital differs from system to system
    made = often.select(F.concat(F.upper(F.left("form", F.lit(1))), F.lit("-"), F.expr("substr(form, 2)")).alias("f")).unionByName(often.select(F.concat("form", F.lit("'s")).alias("f")))
    found = M.punctuation_aliases(made.select(F.lower("f").alias("form"), "f"), lex)
    return made.select("f", F.lower("f").alias("form")).distinct().join(found, "form").select(F.col("f").alias("form"), "target", "kind")


@query("""WITH b AS (SELECT 0 AS b, s_nationkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS name, s_suppkey AS rank FROM supplier UNION ALL SELECT 1, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_custkey FROM customer)
SELECT k, min(b) FILTER (name IS NOT NULL) AS first_batch, max(coalesce(rank, 0)) AS rank FROM b GROUP BY k""")
def sk05_attribute_upsert(t) -> DataFrame:
    """The batch whose attribute counts, and the largest rank of both."""
    side = lambda df, k, keep, rank, b: df.select(F.col(k).alias("k"), F.when(keep, b).alias("first_batch"), F.col(rank).alias("rank"))
    return O.attribute_upsert([side(t.supplier, "s_nationkey", F.col("s_suppkey") % 3 == 0, "s_suppkey", 0), side(t.customer, "c_nationkey", F.col("c_custkey") % 2 == 0, "c_custkey", 1)], ["k"], ["first_batch"], ["rank"])


@query("""SELECT p_brand, p_type FROM part WHERE p_size <= 10 UNION SELECT p_brand, p_type FROM part WHERE p_size > 40""")
def sk06_set_insert(t) -> DataFrame:
    old, new = (t.part.where(w).select("p_brand", "p_type").distinct() for w in ("p_size <= 10", "p_size > 40"))
    return old.unionByName(O.anti(new, old, ["p_brand", "p_type"]))


@query("""SELECT c_mktsegment, c_nationkey % 5 AS name, count(DISTINCT c_nationkey) AS locales FROM customer GROUP BY 1, 2 HAVING count(DISTINCT c_nationkey) > 1""")
def fp11_ambiguity(t) -> DataFrame:
    return O.ambiguous_names(t.customer.withColumn("name", F.col("c_nationkey") % 5), "c_mktsegment", "name", "c_nationkey")


@query("""SELECT q.c_custkey AS query, s.s_suppkey AS target, 'nation' AS channels FROM customer q JOIN supplier s ON s_nationkey = c_nationkey WHERE q.c_custkey % 50 = 0""")
def jn06_index_lookup(t) -> DataFrame:
    q = O.postings(t.customer.where("c_custkey % 50 = 0"), "c_custkey", {"nation": "c_nationkey"}).withColumnRenamed("c_custkey", "query")
    x = O.postings(t.supplier, "s_suppkey", {"nation": "s_nationkey"}).withColumnRenamed("s_suppkey", "target")
    return O.retrieve(q, x, "query", "target").select("query", "target", F.array_join("channels", ",").alias("channels"))


@query("""SELECT n_nationkey, n_name, coalesce(r, 0) AS popularity FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS r FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def jn14_attach_rank(t) -> DataFrame:
    ranks = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("popularity"))
    return O.left_with_defaults(t.nation.select("n_nationkey", "n_name"), ranks, ["n_nationkey"], {"popularity": 0})


@query(f"""WITH lex AS {_LEX} SELECT DISTINCT w AS form FROM (SELECT unnest(tokens) AS w FROM {_tokens('benchmark')}) WHERE w IN (SELECT form FROM lex)""")
def jn18_attested_forms(t) -> DataFrame:
    asked = t.benchmark.select(F.explode(F.transform(T.word_tokens("text"), lambda x: F.lower(x))).alias("form")).distinct()
    return O.semi(asked, _lexicon(t), ["form"])


@query("""SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'""")
def jn21_backfill_work(t) -> DataFrame:
    side = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select("l_partkey", "l_suppkey").distinct()
    return O.anti(side("R"), side("A"), ["l_partkey", "l_suppkey"])


@query("""SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 4, (p_partkey % 97) DESC, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END, p_retailprice, p_partkey) AS r FROM part) WHERE r = 1""")
def ag02_best_normalized(t) -> DataFrame:
    order = [F.asc(F.col("p_size") % 4), F.desc(F.col("p_partkey") % 97), F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0).asc(), F.asc("p_retailprice"), F.asc("p_partkey")]
    return O.best_per_group(t.part, ["p_brand"], order).select("p_brand", "p_partkey")


@query(f"""WITH c AS (SELECT source, form, count(*) AS n FROM (SELECT source, unnest(tokens) AS form FROM {_tokens('documents')}) GROUP BY 1, 2), s AS (SELECT source, sum(n)::BIGINT AS total FROM c GROUP BY 1)
SELECT form, source, n, total, round(n * 1e6 / total, 4) AS per_million FROM c JOIN s USING (source) WHERE n >= 20""")
def ag10_usage_evidence(t) -> DataFrame:
    counts = C.token_counts(t.documents, "source")
    totals = counts.groupBy("source").agg(F.sum("n").alias("total"))
    return C.usage_evidence(counts.where("n >= 20"), totals, "form", "source").withColumn("per_million", F.round("per_million", 4))


@query("""SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal < 0, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END NULLS LAST, c_custkey) = 1""")
def wn05_representative(t) -> DataFrame:
    usage = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal"))
    return O.best_per_group(t.customer, ["c_mktsegment"], [(F.col("c_acctbal") < 0).asc(), usage.asc_nulls_last(), F.asc("c_custkey")]).select("c_mktsegment", "c_custkey")


@query("""SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 = 0 DESC, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey % 4, o_orderkey % 5, o_totalprice DESC, o_orderkey % 7 DESC, o_orderkey) AS rank FROM orders)""")
def rk12_phrase_order(t) -> DataFrame:
    k = F.col("o_orderkey")
    safety = F.when(F.col("o_orderstatus") == "F", "safe").when(F.col("o_orderstatus") == "O", "marked").otherwise("restricted")
    rows = t.orders.select("o_custkey", "o_orderkey", (k % 3 == 0).alias("eligible"), safety.alias("safety"), (k % 4).alias("tier"), (k % 5).alias("band"), F.col("o_totalprice").alias("utility"), (k % 7).alias("phonetic"), k.alias("phrase"))
    return Y.numbered(rows, ["o_custkey"], H.order()).select("o_custkey", "o_orderkey", "rank")


@query("""WITH a AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_retailprice DESC, p_partkey) = 1), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey) = 1) SELECT p_brand, p_partkey FROM b""")
def rk13_frame_dedupe(t) -> DataFrame:
    return H.deduped(t.part, "p_brand", ["p_name", "p_size"], [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_brand", "p_partkey")


@query("""SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 4, p_partkey % 97 DESC, p_size % 3, p_name, p_partkey) AS rank FROM part""")
def rk05_sound_order(t) -> DataFrame:
    order = [F.asc(F.col("p_size") % 4), F.desc(F.col("p_partkey") % 97), F.asc(F.col("p_size") % 3), F.asc("p_name"), F.asc("p_partkey")]
    return Y.numbered(t.part, ["p_brand"], order).select("p_brand", "p_partkey", "rank")


@query(f"""WITH l AS (SELECT conv_id, turn, list_concat(['<s>', '<s>', '<s>', '<s>'], list_transform({_WORDS}, lambda x: lower(x)), ['</s>']) AS p FROM conversations)
SELECT context, nxt AS next, count(*) AS n FROM (SELECT array_to_string(p[i - 4:i - 1], ' ') AS context, p[i] AS nxt FROM (SELECT p, unnest(range(5, len(p) + 1)) AS i FROM l)) GROUP BY 1, 2 HAVING count(*) >= 2""")
def sq05_padded_contexts(t) -> DataFrame:
    pairs = t.conversations.select(F.explode(T.padded_contexts(F.transform(T.word_tokens("text"), lambda x: F.lower(x)))).alias("p"))
    return pairs.groupBy(F.array_join("p.context", " ").alias("context"), F.col("p.next").alias("next")).agg(F.count("*").alias("n")).where("n >= 2")


@query("SELECT length, count(*) AS windows, count(DISTINCT w) AS different FROM (" + " UNION ALL ".join(
    f"SELECT {n} AS length, array_to_string(tokens[i:i + {n - 1}], chr(1)) AS w FROM (SELECT tokens, unnest(range(1, len(tokens) - {n - 2})) AS i FROM {_tokens('benchmark')} WHERE len(tokens) >= {n})" for n in range(4, 9)) + ") GROUP BY 1")
def sq06_source_windows(t) -> DataFrame:
    items = t.benchmark.select("item_id", F.transform(T.word_tokens("text"), lambda x: F.lower(x)).alias("tokens"))
    return C.windows(items, "item_id").groupBy("length").agg(F.count("*").alias("windows"), F.countDistinct("h").alias("different"))


_MODEL = """(SELECT *, sum(n) OVER (PARTITION BY context) AS total FROM (SELECT prev AS context, event_type AS nxt, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL GROUP BY 1, 2))"""


@query(f"""WITH p AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), s AS (SELECT user_id, coalesce(m.n::DOUBLE / m.total, 1e-9) AS p FROM p LEFT JOIN {_MODEL} m ON m.context = p.prev AND m.nxt = p.event_type WHERE prev IS NOT NULL)
SELECT user_id, round(exp(avg(ln(greatest(p, 1e-9)))), 9) AS score, avg(CASE WHEN p <= 1e-9 THEN 1.0 ELSE 0.0 END) AS floored FROM s GROUP BY user_id""")
def mk05_sequence_scores(t) -> DataFrame:
    """Users' sequences of event types by the transition probabilities (MK-02) of all of them."""
    from pyspark.sql.window import Window

    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = t.events.select(F.col("event_id").alias("id"), "user_id", F.array(prev).alias("context"), F.col("event_type").alias("next")).where("context[0] IS NOT NULL")
    counts = pairs.groupBy(F.lit(1).alias("length"), F.col("context")[0].alias("context"), "next").agg(F.count("*").alias("n"))
    p = C.transition_probability(pairs.select("id", "context", "next"), C.top_transitions(counts), 1)
    return C.sequence_score(p.join(pairs.select("id", "user_id"), "id"), "user_id").select("user_id", F.round("score", 9).alias("score"), "floored")


@query("""SELECT 'parts_per_brand' AS "check", count(*) AS violations FROM (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > 8) UNION ALL SELECT 'orders_without_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def ev08_distribution_integrity(t) -> DataFrame:
    return A.excess(t.part, "p_brand", 8, "parts_per_brand").unionByName(A.orphans(t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.customer, ["c_custkey"], "orders_without_customer"))


@query("""WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), k AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey <= 5)
SELECT p_partkey, count(*) AS tokens, count(k.w) AS known, CASE WHEN count(k.w) = 0 THEN 'none' WHEN count(k.w) = count(*) THEN 'full' ELSE 'partial' END AS coverage FROM w LEFT JOIN k USING (w) GROUP BY p_partkey""")
def ev23_surface_coverage(t) -> DataFrame:
    words = lambda df: df.select("p_partkey", F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return A.coverage(words(t.part), words(t.part.where("p_partkey <= 5")), "p_partkey", "w")


@query("""SELECT title, path, len(string_split(path, '/')) - 1 AS depth FROM (SELECT c_name AS title, '/' || c_mktsegment || '/' || c_nationkey AS path FROM customer) WHERE path = '/BUILDING' OR starts_with(path, '/BUILDING/') AND contains(lower(title), '1')""")
def ui02_library(t) -> DataFrame:
    rows = t.customer.select(F.col("c_name").alias("title"), F.concat_ws("/", F.lit(""), "c_mktsegment", "c_nationkey").alias("path"))
    return V.library(rows, "/BUILDING", "1").select("title", "path", F.size("parts").cast("long").alias("depth"))


@query("""WITH a AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE string_split(p_name, ' ')[2] END AS head, p_type AS analysis, p_brand AS form FROM part)
SELECT form, count(DISTINCT analysis) AS analyses, array_to_string(list_sort(list(DISTINCT head) FILTER (head IS NOT NULL)), ',') AS heads, CASE coalesce(count(DISTINCT head), 0) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'converged' ELSE 'conflict' END AS state FROM a GROUP BY form""")
def ag33_compound_evidence(t) -> DataFrame:
    """Brands as forms, types as analyses and the second words of names as the heads that they state; no split is attested."""
    rows = t.part.select(F.col("p_brand").alias("form"), F.col("p_type").alias("analysis"), F.when(F.col("p_size") % 4 != 0, F.element_at(F.split("p_name", " "), 2)).alias("head"))
    none = t.spark.createDataFrame([], "form string, n long")
    return M.compound_evidence(rows, rows.select("form").distinct(), none).select("form", "analyses", F.array_join("heads", ",").alias("heads"), "state")


@query("""WITH d AS (SELECT c_custkey AS document, o_orderkey AS bar, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderpriority AS t FROM customer JOIN orders ON o_custkey = c_custkey),
 n AS (SELECT * FROM d WHERE bar % 5 <> 0), w AS (SELECT document, bar, pos, CASE WHEN bar % 7 = 0 THEN 'x' ELSE t END AS t FROM d WHERE bar % 3 <> 0)
SELECT coalesce(n.document, w.document) AS document, coalesce(n.bar, w.bar) AS bar, CASE WHEN w.bar IS NULL THEN 'added' WHEN n.bar IS NULL THEN 'removed' WHEN n.t <> w.t THEN 'changed' ELSE 'same' END AS state FROM n FULL JOIN w ON n.document = w.document AND n.bar = w.bar""")
def ui01_revision_diff(t) -> DataFrame:
    """A customer's orders as bars: two revisions in the same order, each without some bars."""
    from pyspark.sql.window import Window

    d = t.orders.select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("bar"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("at"), F.col("o_orderpriority").alias("t"))
    was = d.where("bar % 3 != 0").withColumn("t", F.when(F.col("bar") % 7 == 0, "x").otherwise(F.col("t")))
    return V.compare_revisions(d.where("bar % 5 != 0"), was, "document", "bar", "at", "t").select("document", "bar", "state")
