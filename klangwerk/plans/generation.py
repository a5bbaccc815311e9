"""Decoder operators on the driver's tables, with SQL where their rules are columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klangwerk.operators import beam as B
from klangwerk.operators import corpus as C
from klangwerk.operators import decoder as D
from klangwerk.operators import workspace as W

from .registry import query

_CLAMP = "least(1.0, greatest(0.0, {}))"
_USAGE = f"coalesce(CASE WHEN p_partkey % 3 = 0 THEN {_CLAMP.format('p_size / 40.0')} END, CASE WHEN p_partkey % 5 = 0 THEN p_size / 50.0 END, CASE WHEN p_partkey % 2 = 0 THEN {_CLAMP.format('1 - log10(p_partkey + 1) / 7')} END, CASE WHEN p_size > 25 THEN {_CLAMP.format('log10(p_size + 1) / 6')} END, 0.5)"
_SCORE, _ASSO, _CONS = "(p_partkey % 97) / 97.0::DOUBLE", "(p_partkey % 31) / 31.0::DOUBLE", "(p_partkey % 41) / 41.0::DOUBLE"
_KIND = "CASE p_size % 3 WHEN 0 THEN 'phrase' WHEN 1 THEN 'entity' ELSE 'word' END"
_PRIMARY = "CASE p_size % 4 WHEN 0 THEN 'multisyllabic_perfect' WHEN 1 THEN 'family' WHEN 2 THEN 'slant' END"


def _parts(t) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    usage = D.usage_quality(F.when(k % 3 == 0, size / 40.0), F.when(k % 5 == 0, size / 50.0), F.when(k % 2 == 0, k), F.when(size > 25, size))
    return t.part.withColumns({"score": k % 97 / 97.0, "assonance": k % 31 / 31.0, "consonance": k % 41 / 41.0, "kind": F.when(size % 3 == 0, "phrase").when(size % 3 == 1, "entity").otherwise("word"),
                               "primary": F.when(size % 4 == 0, "multisyllabic_perfect").when(size % 4 == 1, "family").when(size % 4 == 2, "slant"), "usage": usage})


@query(f"""SELECT p_partkey, round({_USAGE}, 9) AS usage, round(CASE WHEN contains(coalesce({_PRIMARY}, ''), 'multi') THEN greatest({_SCORE}, 0.94) ELSE {_SCORE} * 0.72 END, 9) AS multi,
 round(CASE WHEN {_KIND} = 'phrase' THEN greatest({_SCORE}, 0.9) ELSE {_SCORE} * 0.48 END, 9) AS mosaic, round(greatest({_ASSO}, {_SCORE} * 0.55), 9) AS assonance_mode,
 round({_CLAMP.format(f'greatest({_ASSO}, {_CONS}) * 0.7 + {_SCORE} * 0.3')}, 9) AS internal, round({_CLAMP.format(f'{_SCORE} * 0.72 + {_ASSO} * 0.16 + {_CONS} * 0.12')}, 9) AS balanced FROM part""")
def mk06_mode_scores(t) -> DataFrame:
    mode = lambda m, n: F.round(D.mode_score(m, F.col("score"), F.col("kind"), F.col("primary"), F.col("assonance"), F.col("consonance")), 9).alias(n)
    return _parts(t).select("p_partkey", F.round("usage", 9).alias("usage"), mode("multi", "multi"), mode("mosaic", "mosaic"), mode("assonance", "assonance_mode"), mode("internal", "internal"), mode("balanced", "balanced"))


_POOL = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, kind, normalized ORDER BY p_partkey) AS k FROM
 (SELECT p_brand AS query, p_partkey, {_KIND} AS kind, lower(p_name) AS normalized, p_name AS surface, {_SCORE} AS phonetic, {_USAGE} AS usage, {_CONS} AS support FROM part) WHERE kind <> 'entity') WHERE k = 1)"""


def _pool(t) -> DataFrame:
    rows = _parts(t).select(F.col("p_brand").alias("query"), "p_partkey", "kind", F.lower("p_name").alias("normalized"), F.col("p_name").alias("surface"), F.col("score").alias("phonetic"), "usage", F.col("consonance").alias("support"))
    return D.candidate_pool(rows, "query", [F.asc("p_partkey")], entities=False)


@query(f"SELECT query, kind, count(*) AS n, min(p_partkey) AS first FROM {_POOL} GROUP BY 1, 2")
def mk06_candidate_pool(t) -> DataFrame:
    return _pool(t).groupBy("query", "kind").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query(f"""WITH q AS (SELECT *, {_CLAMP.format('phonetic * (0.5 + 0.65 * 0.32) + usage * (0.16 + 0.72 * 0.12) + support * (0.18 + 0.72 * 0.18)')} AS quality FROM {_POOL}),
 p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(quality, 9) DESC, phonetic DESC, surface) AS place, max(quality) OVER (PARTITION BY query) AS best FROM q),
 c AS (SELECT *, count(*) FILTER (quality >= CASE WHEN best > 0 THEN best ELSE 1 END * (0.44 + 0.72 * 0.18)) OVER (PARTITION BY query) AS good FROM p)
SELECT query, p_partkey, place FROM c WHERE place <= greatest(24, least(floor(48 + 0.38 * 80 + 0.5)::INTEGER, good))""")
def mk07_tail_reservoir(t) -> DataFrame:
    return D.tail_reservoir(_pool(t), "query", ties=("p_partkey",)).select("query", "p_partkey", "place")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity % 16)::INTEGER AS a, greatest(3, least(28, (l_quantity % 31)::INTEGER)) AS t FROM lineitem)
SELECT a AS actual, t AS target, greatest(1, floor(t * (0.10 + 0.38 * 0.08) + 0.5)::INTEGER) AS tolerance, round(least(1.0, exp(-abs(a - t) / greatest(1.5, t * 0.28)) * 0.9 + 0.1 * CASE WHEN a < 3 THEN a / 3.0 WHEN a > greatest(12, t) THEN exp(-(a - greatest(12, t)) / 4.0) WHEN t <= 9 AND a > 9 THEN 0.92 ELSE 1 END), 9) AS fit, count(*) AS n FROM v GROUP BY ALL""")
def mk15_length_fit(t) -> DataFrame:
    rows = t.lineitem.select((F.col("l_quantity") % 16).cast("int").alias("actual"), (F.col("l_quantity") % 31).cast("int").alias("asked"))
    b = D.target_bounds(F.col("asked"), 0.38)
    return rows.select("actual", b["target"].alias("target"), b["tolerance"].alias("tolerance"), F.round(D.length_fit(F.col("actual"), F.col("asked")), 9).alias("fit")).groupBy("actual", "target", "tolerance", "fit").agg(F.count("*").alias("n"))


@query(f"""WITH d AS (SELECT o_orderkey, (o_orderkey % 101) / 101.0::DOUBLE AS f, (o_custkey % 7) / 7.0::DOUBLE AS z, (o_orderkey % 11) / 11.0::DOUBLE AS e, o_custkey % 9 AS run, o_orderkey % 13 = 0 AS ex, 3 + o_custkey % 16 AS target FROM orders),
 n AS (SELECT *, {_CLAMP.format('pow(greatest(f, 1e-9), 0.24) * (1 - z)')} AS tr, CASE WHEN ex THEN 0 ELSE {_CLAMP.format('e * 0.72 + (1 - least(1.0, run / 6.0)) * 0.28')} END AS nov FROM d),
 m AS (SELECT *, {_CLAMP.format('tr * 0.42 + e * 0.18 + 0.5 * 0.15 + e * 0.05 + z * 0.09 + z * 0.06 + f * 0.05')} AS nat FROM n)
SELECT o_orderkey, ex OR run >= CASE WHEN target >= 14 THEN 7 WHEN target >= 10 THEN 6 ELSE 5 END AS copied, round({_CLAMP.format('(nat * 0.596 + f * 0.428 + 0.5 * 0.12 + nov * 0.139 + e * 0.08) / 1.363 + 0')}, 9) AS utility FROM m""")
def mk11_draft_scores(t) -> DataFrame:
    share = lambda c, n: F.col(c) % n / float(n)
    f, z, e = share("o_orderkey", 101), share("o_custkey", 7), share("o_orderkey", 11)
    rows = t.orders.select("o_orderkey", f.alias("forward"), z.alias("zero_rate"), e.alias("context_depth"), F.lit(None).cast("double").alias("shape_fit"), e.alias("phrase_support"), z.alias("start"), z.alias("tail_fit"), f.alias("usage"),
                           f.alias("rhyme"), e.alias("support"), e.alias("window_novelty"), (F.col("o_custkey") % 9).alias("matched_windows"), (F.col("o_custkey") % 9).alias("longest_run"), (F.col("o_orderkey") % 13 == 0).alias("exact_source"),
                           (3 + F.col("o_custkey") % 16).alias("target"), F.lit(None).cast("double").alias("entity"))
    return D.draft_scores(rows).select("o_orderkey", "copied", F.round("utility", 9).alias("utility"))


@query("""WITH l AS (SELECT o_orderkey AS line, o_custkey AS song, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_returnflag || l_linestatus) AS shape, count(*) AS length FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
 p AS (SELECT * FROM (SELECT length, shape, count(*) AS n, row_number() OVER (PARTITION BY length ORDER BY count(*) DESC, shape) AS r FROM l GROUP BY 1, 2) WHERE r <= 5), m AS (SELECT *, max(n) OVER (PARTITION BY length) AS most FROM p)
SELECT line, count(m.shape) AS patterns, round(max(len(list_filter(range(1, l.length + 1), lambda i: l.shape[i] = m.shape[i]))::DOUBLE / l.length * 0.9 + ln(1 + n) / ln(1 + most) * 0.1), 6) AS fit FROM l LEFT JOIN m USING (length) GROUP BY line""")
def mk04_shape_fit(t) -> DataFrame:
    """Orders as lines and the states of their items as shapes, against the five commonest shapes of each length."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("s")))), lambda x: x["s"]).alias("shape"), F.count("*").alias("length"))
    return C.shape_fit(lines, C.shape_patterns(lines, "shape", "length", 5), "line", "shape", "length")


@query("""WITH t AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS w FROM documents WHERE lang = 'en'), s AS (SELECT lower(w) AS form, w = upper(w) AND length(w) > 1 AS u, left(w, 1) = upper(left(w, 1)) AND substr(w, 2) = lower(substr(w, 2)) AND NOT (w = upper(w) AND length(w) > 1) AS t FROM t),
 n AS (SELECT form, count(*) AS n, sum(u::INT) AS u, sum(t::INT) AS t FROM s GROUP BY 1) SELECT form, n, CASE WHEN u >= n * 0.6 THEN upper(form) WHEN t >= n * 0.6 THEN upper(left(form, 1)) || substr(form, 2) ELSE form END AS written FROM n""")
def sf04_preferred_casing(t) -> DataFrame:
    words = t.documents.where("lang = 'en'").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))).alias("form"))
    return C.preferred_casing(words)


#: Uses from which a word belongs to the model's vocabulary.
VOCABULARY = 10
_LINES = """(SELECT row_number() OVER () AS line, lang AS model, tokens FROM (SELECT lang, list_transform(regexp_extract_all(l, '[\\p{L}\\p{N}]+(?:[-''\u2019][\\p{L}\\p{N}]+)*'), lambda x: lower(x)) AS tokens, l FROM
 (SELECT lang, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents) WHERE NOT regexp_matches(l, '(?i)https?://|www\\.') AND length(regexp_replace(l, '[^0-9]', '', 'g')) * 4 <= length(l)) WHERE len(tokens) BETWEEN 3 AND 48 AND lang IS NOT NULL)"""


def _known_lines(t) -> DataFrame:
    """line, model (language) and tokens, null where a word is rare."""
    lines = C.sentence_tokens(t.documents, "doc_id", "lang").where("lang IS NOT NULL").select(F.monotonically_increasing_id().alias("line"), F.col("lang").alias("model"), "tokens")
    counts = lines.select("model", F.explode("tokens").alias("form")).groupBy("model", "form").agg(F.count("*").alias("n"))
    return C.within_vocabulary(lines, "line", "tokens", C.prune_vocabulary(counts, VOCABULARY), "model")


@query(f"""WITH l AS {_LINES}, w AS (SELECT line, model, unnest(tokens) AS form, generate_subscripts(tokens, 1) AS pos FROM l), v AS (SELECT model, form FROM w GROUP BY 1, 2 HAVING count(*) >= {VOCABULARY}),
 k AS (SELECT w.line, w.model, ['<s>', '<s>'] || list(v.form ORDER BY pos) || ['</s>'] AS p FROM w LEFT JOIN v ON v.model = w.model AND v.form = w.form GROUP BY 1, 2),
 i AS (SELECT model, p, unnest(range(3, len(p) + 1)) AS i FROM k), e AS (SELECT model, k AS length, p[i - k:i - 1] AS c, p[i] AS next FROM i, (VALUES (1), (2)) x(k))
SELECT model, length::INTEGER AS length, array_to_string(c, ' ') AS context, next, count(*) AS n FROM e WHERE next IS NOT NULL AND len(list_filter(c, lambda x: x IS NULL)) = 0 GROUP BY ALL""")
def ag12_gap_transitions(t) -> DataFrame:
    """Each language's transitions between words of its vocabulary that stand side by side in the text."""
    return C.transitions(_known_lines(t), 2, "model", gaps=True)


@query()
def mk14_generated_lines(t) -> DataFrame:
    """Lines of six words that end in frequent line ends of each language, one request for each first letter, thirty draws each."""
    shared, run = W.shared_dir(t.spark), uuid.uuid4().hex
    lines = W.settled(_known_lines(t), f"{shared}/klangwerk-lines-{run}")
    ends = lines.groupBy("model", F.element_at("tokens", -1).alias("surface")).agg(F.count("*").alias("n")).where("surface IS NOT NULL").withColumn("query", F.concat_ws(":", "model", F.left("surface", F.lit(1))))
    ends = W.settled(ends, f"{shared}/klangwerk-ends-{run}")
    grams = W.settled(C.both_counts(lines, 2, "model", gaps=True), f"{shared}/klangwerk-grams-{run}")
    W.released(t.spark, f"{shared}/klangwerk-lines-{run}")
    tables = B.build(*C.both_transitions(grams, 2, "model"), 2, buckets=max(16, grams.count() // 500_000), most=16)
    W.released(t.spark, f"{shared}/klangwerk-grams-{run}")
    pool = ends.select("query", "model", "surface", F.col("surface").alias("normalized"), F.lit("word").alias("kind"), F.array("surface").alias("tokens"), D.usage_quality(*(F.lit(None).cast("double"),) * 3, F.col("n")).alias("usage"), F.lit(1.0).alias("phonetic"), F.lit(1.0).alias("support"))
    return B.generate(tables, D.tail_reservoir(pool, "query"), "query", count=3, most=30)
