"""Corpus, song and evaluation operators on the driver's text tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klangwerk.functions import text as T
from klangwerk.operators import aggregates as A
from klangwerk.operators import corpus as C
from klangwerk.operators import evaluation as E
from klangwerk.operators import relational as O
from klangwerk.operators import song as G

from .registry import query

_W = r"[\p{L}\p{N}]+(?:[-''’][\p{L}\p{N}]+)*"


def _tokens(table: str) -> str:
    return f"(SELECT *, list_transform(regexp_extract_all(coalesce(text, ''), '{_W}'), lambda x: lower(x)) AS tokens FROM {table})"


@query(f"SELECT form, count(*) AS n FROM (SELECT unnest(tokens) AS form FROM {_tokens('documents')}) GROUP BY form")
def sr02_token_counts(t) -> DataFrame:
    return C.token_counts(t.documents).select("form", "n")


@query(f"""WITH c AS (SELECT source, form, count(*) AS n FROM (SELECT source, unnest(tokens) AS form FROM {_tokens('documents')}) GROUP BY 1, 2),
 s AS (SELECT source, sum(n)::BIGINT AS total FROM c GROUP BY 1), k AS (SELECT count(*) AS sources FROM s)
SELECT form, (sum(c.n::BIGINT * 1000000000 // s.total)::BIGINT // (SELECT sources FROM k))::BIGINT AS score, count(*) AS in_sources, sum(c.n)::BIGINT AS n FROM c JOIN s USING (source) GROUP BY form""")
def ag08_usage_rank(t) -> DataFrame:
    return C.usage_rank(C.token_counts(t.documents, "source"))


@query(f"""WITH w AS (SELECT DISTINCT form FROM (SELECT unnest(tokens) AS form FROM {_tokens('documents')})),
 r AS (SELECT form, regexp_extract(form, '[aeiouyäöü]+[^aeiouyäöü]*$') AS tail FROM w), p AS (SELECT form, CASE WHEN tail <> '' THEN tail ELSE right(form, 3) END AS rhyme FROM r)
SELECT rhyme, count(*) AS words, min(form) AS first_word, max(form) AS last_word FROM p GROUP BY rhyme""")
def ph33_rhyme_groups(t) -> DataFrame:
    w = t.documents.select(F.explode(F.transform(T.word_tokens("text"), F.lower)).alias("form")).distinct()
    return w.groupBy(T.rhyme_proxy("form").alias("rhyme")).agg(F.count("*").alias("words"), F.min("form").alias("first_word"), F.max("form").alias("last_word"))


_LINES = f"""(SELECT doc_id, line_no, tokens FROM (SELECT doc_id, line_no, line, list_transform(regexp_extract_all(line, '{_W}'), lambda x: lower(x)) AS tokens
 FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents))
 WHERE NOT regexp_matches(line, '(?i)https?://|www\\.') AND len(tokens) BETWEEN 3 AND 48 AND length(regexp_replace(line, '[^0-9]', '', 'g')) * 4 <= length(line))"""


@query(f"SELECT doc_id, count(*) AS lines, sum(len(tokens))::BIGINT AS tokens FROM {_LINES} GROUP BY doc_id")
def sr13_sentence_lines(t) -> DataFrame:
    return C.sentence_tokens(t.documents, "doc_id").groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.size("tokens")).alias("tokens"))


@query(f"""SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(1, len(tokens))), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS gram FROM {_LINES}) GROUP BY gram HAVING count(*) >= 3""")
def ag11_bigram_census(t) -> DataFrame:
    return C.gram_counts(C.sentence_tokens(t.documents), 2).where("n >= 3")


_ORDER = 4
_PAIRS = f"""(SELECT list_concat({["<s>"] * _ORDER}, tokens, ['</s>']) AS p FROM {_LINES})"""
_TRANS = "(SELECT length, context, nxt AS next, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT {k} AS length, array_to_string(p[i - {k}:i - 1], ' ') AS context, p[i] AS nxt FROM (SELECT p, unnest(range({_ORDER + 1}, len(p) + 1)) AS i FROM {_PAIRS})" for k in range(1, _ORDER + 1)) + ") GROUP BY 1, 2, 3)"


@query(f"""SELECT length, context, next, n, rank, total FROM (SELECT *, sum(n) OVER (PARTITION BY length, context)::BIGINT AS total FROM
 (SELECT *, row_number() OVER (PARTITION BY length, context ORDER BY n DESC, next) AS rank FROM {_TRANS} WHERE n >= 2) WHERE rank <= 128)""")
def wn04_top_transitions(t) -> DataFrame:
    """The model: contexts of one to four words, transitions seen twice, the 128 best of each context."""
    return C.model(C.sentence_tokens(t.documents), _ORDER, least=2).select("length", "context", "next", "n", "rank", "total")


@query(f"SELECT length, count(*) AS states, sum(n)::BIGINT AS n FROM {_TRANS} GROUP BY length")
def ag12_transition_census(t) -> DataFrame:
    return C.transitions(C.sentence_tokens(t.documents), _ORDER).groupBy("length").agg(F.count("*").alias("states"), F.sum("n").alias("n"))


_KEPT = f"""(SELECT length, context, nxt, n FROM (SELECT length, context, next AS nxt, n, dense_rank() OVER (PARTITION BY length ORDER BY t DESC, context) AS state, row_number() OVER (PARTITION BY length, context ORDER BY n DESC, next) AS r
 FROM (SELECT *, sum(n) OVER (PARTITION BY length, context) AS t FROM {_TRANS})) WHERE state <= 500 AND r <= 128)"""


@query(f"SELECT length, context, nxt AS next, n FROM {_KEPT}")
def ag13_frequent_states(t) -> DataFrame:
    """The five hundred most frequent states of each length, with their continuations."""
    return C.model(C.sentence_tokens(t.documents), _ORDER, states=500).select("length", "context", "next", "n")


def _windows_sql(table: str) -> str:
    return " UNION ALL ".join(f"SELECT {n} AS length, array_to_string(tokens[i:i + {n - 1}], chr(1)) AS w, * FROM (SELECT *, unnest(range(1, len(tokens) - {n - 2})) AS i FROM {table} WHERE len(tokens) >= {n})" for n in range(4, 9))


@query(f"""WITH d AS (SELECT DISTINCT w, length FROM ({_windows_sql(_tokens('documents'))})), b AS (SELECT item_id, w, length FROM ({_windows_sql(_tokens('benchmark'))}))
SELECT item_id, coalesce(longest, 0)::INTEGER AS longest FROM benchmark LEFT JOIN (SELECT item_id, max(b.length) AS longest FROM b SEMI JOIN d ON b.w = d.w AND b.length = d.length GROUP BY 1) USING (item_id)""")
def mk03_source_novelty(t) -> DataFrame:
    items = t.benchmark.select("item_id", F.transform(T.word_tokens("text"), F.lower).alias("tokens"))
    docs = t.documents.select(F.transform(T.word_tokens("text"), F.lower).alias("tokens"))
    return C.novelty(items, docs, "item_id")


_KINDS = f"""(SELECT 'sentence' AS kind, tokens FROM {_tokens('documents')} UNION ALL SELECT 'lyric', tokens FROM {_tokens('conversations')} UNION ALL SELECT 'phrase', tokens[1:6] FROM {_tokens('documents')} WHERE doc_id % 3 = 0)"""


@query(f"""WITH c AS (SELECT item_id, tokens FROM {_tokens('benchmark')} UNION ALL SELECT -1 - conv_id, tokens FROM {_tokens('conversations')} WHERE turn = 0),
 s AS (SELECT kind, tokens FROM {_KINDS}), k AS (SELECT DISTINCT kind, length, w FROM ({_windows_sql('s')})), b AS (SELECT item_id, length, w FROM ({_windows_sql('c')})),
 h AS (SELECT item_id, kind, max(length) AS l, count(*) AS m FROM b JOIN k USING (length, w) GROUP BY ALL), x AS (SELECT DISTINCT item_id, kind, true AS e FROM c JOIN s USING (tokens) WHERE len(tokens) > 0),
 g AS (SELECT item_id, bool_or(e) FILTER (kind <> 'phrase') AS e, max(l) FILTER (kind <> 'phrase') AS l, sum(m) FILTER (kind <> 'phrase') AS m, max(l) FILTER (kind = 'phrase') AS p FROM h FULL JOIN x USING (item_id, kind) GROUP BY item_id)
SELECT item_id, coalesce(e, false) AS exact_source, coalesce(l, 0)::INTEGER AS longest_run, coalesce(m, 0)::BIGINT AS matched_windows, CASE WHEN len(tokens) > 0 THEN round(1.0 - least(1.0, coalesce(l, 0) / greatest(1, len(tokens))::DOUBLE), 6) ELSE 1.0 END AS novelty,
 coalesce(p, 0)::INTEGER AS phrase_run, CASE WHEN len(tokens) > 0 THEN round(least(1.0, coalesce(p, 0) / greatest(1, least(8, len(tokens)))::DOUBLE), 6) ELSE 0.0 END AS phrase_support FROM c LEFT JOIN g USING (item_id)""")
def mk03_novelty_by_kind(t) -> DataFrame:
    """Benchmark items and first turns against documents, turns and the beginnings of every third document as phrases."""
    tokens = F.transform(T.word_tokens("text"), F.lower).alias("tokens")
    c = t.benchmark.select("item_id", tokens).unionByName(t.conversations.where("turn = 0").select((-1 - F.col("conv_id")).alias("item_id"), tokens))
    docs = t.documents.select("doc_id", tokens)
    sources = docs.select(F.lit("sentence").alias("kind"), "tokens").unionByName(t.conversations.select(F.lit("lyric").alias("kind"), tokens)).unionByName(docs.where("doc_id % 3 = 0").select(F.lit("phrase").alias("kind"), F.slice("tokens", 1, 6).alias("tokens")))
    return C.source_novelty(c, C.novelty_by_kind(c, sources, "item_id", "kind"), "item_id")


@query(f"""WITH p AS (SELECT item_id, tokens AS pat, array_to_string(tokens[1:2], ' ') AS k, len(tokens) AS n FROM {_tokens('benchmark')} WHERE len(tokens) > 0),
 d AS (SELECT doc_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM {_tokens('documents')} WHERE len(tokens) > 0),
 h AS (SELECT doc_id, item_id, i, tokens, pat, n FROM d JOIN p ON p.n > 1 AND array_to_string(d.tokens[i:i + 1], ' ') = p.k UNION ALL SELECT doc_id, item_id, i, tokens, pat, n FROM d JOIN p ON p.n = 1 AND d.tokens[i] = p.k)
SELECT doc_id, item_id, (i - 1)::BIGINT AS place FROM h WHERE tokens[i:i + n - 1] = pat""")
def jn15_containment(t) -> DataFrame:
    """Every place where a whole benchmark item stands in a document."""
    items = t.benchmark.select("item_id", F.transform(T.word_tokens("text"), F.lower).alias("pattern"))
    docs = t.documents.select("doc_id", F.transform(T.word_tokens("text"), F.lower).alias("tokens"))
    return O.contained_sequences(docs, items, "doc_id", "tokens", "item_id", "pattern")


_END = f"lower(regexp_extract(text, '([\\p{{L}}\\p{{N}}]+(?:[-''’][\\p{{L}}\\p{{N}}]+)*)[^\\p{{L}}\\p{{N}}]*$', 1))"
_RHYME = "CASE WHEN regexp_extract(w, '[aeiouyäöü]+[^aeiouyäöü]*$') <> '' THEN regexp_extract(w, '[aeiouyäöü]+[^aeiouyäöü]*$') ELSE right(w, 3) END"
_TURNS = f"(SELECT conv_id, turn, w, {_RHYME} AS r FROM (SELECT conv_id, turn, {_END} AS w FROM conversations WHERE text IS NOT NULL) WHERE w <> '')"


def _turns(t) -> DataFrame:
    return t.conversations.where("text IS NOT NULL").select("conv_id", "turn", T.end_word("text").alias("w")).where("w <> ''").withColumn("r", T.rhyme_proxy("w"))


@query(f"SELECT a.conv_id, a.turn, max(b.turn) AS prior FROM {_TURNS} a JOIN {_TURNS} b ON a.conv_id = b.conv_id AND a.r = b.r AND b.turn < a.turn GROUP BY 1, 2")
def sc04_line_relation(t) -> DataFrame:
    last = F.max("turn").over(Window.partitionBy("conv_id", "r").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    return _turns(t).withColumn("prior", last).where("prior IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("prior").alias("prior"))


@query(f"SELECT least(a.w, b.w) AS a, greatest(a.w, b.w) AS b, count(*) AS n FROM {_TURNS} a JOIN {_TURNS} b ON a.conv_id = b.conv_id AND a.r = b.r AND a.turn < b.turn WHERE a.w <> b.w GROUP BY 1, 2")
def sc02_word_pairs(t) -> DataFrame:
    a, b = _turns(t).alias("a"), _turns(t).alias("b")
    on = (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.r") == F.col("b.r")) & (F.col("a.turn") < F.col("b.turn")) & (F.col("a.w") != F.col("b.w"))
    return a.join(b, on).groupBy(F.least("a.w", "b.w").alias("a"), F.greatest("a.w", "b.w").alias("b")).agg(F.count("*").alias("n"))


@query("""SELECT role AS from_role, nxt AS to_role, count(*) AS n FROM (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS nxt FROM conversations) WHERE nxt IS NOT NULL GROUP BY 1, 2""")
def ag20_section_transitions(t) -> DataFrame:
    walk = A.transitions(t.conversations, ["conv_id"], ["turn", "role"], "role")
    return walk.where("from_value IS NOT NULL AND to_value IS NOT NULL").select(F.col("from_value").alias("from_role"), F.col("to_value").alias("to_role"), "n")


_EVAL = "(SELECT d.source, d.lang, l.quality = 1 AS gold, d.n_chars >= 1500 AS predicted, d.n_chars AS score, l.quality, d.doc_id FROM documents d JOIN labels l USING (doc_id))"


def _eval(t) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").select("source", "lang", (F.col("quality") == 1).alias("gold"), (F.col("n_chars") >= 1500).alias("predicted"), F.col("n_chars").alias("score"), "quality", "doc_id")


_CONF = """sum((predicted AND gold)::INT)::BIGINT AS tp, sum((predicted AND NOT gold)::INT)::BIGINT AS fp, sum((NOT predicted AND gold)::INT)::BIGINT AS fn, sum((NOT predicted AND NOT gold)::INT)::BIGINT AS tn"""
_RATES = "tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS fpr, CASE WHEN fn + tp > 0 THEN fn / (fn + tp) END AS fnr"


@query(f"SELECT {_RATES} FROM (SELECT {_CONF} FROM {_EVAL})")
def ev01_confusion(t) -> DataFrame:
    return E.confusion(_eval(t), F.col("predicted"), F.col("gold"))


@query(f"SELECT source, {_RATES} FROM (SELECT source, {_CONF} FROM {_EVAL} GROUP BY source)")
def ev04_confusion_by_tag(t) -> DataFrame:
    return E.confusion(_eval(t), F.col("predicted"), F.col("gold"), "source")


@query(f"""WITH e AS (SELECT CASE WHEN score >= 3000 THEN 'long' WHEN score >= 1000 THEN 'mid' ELSE 'short' END AS p, CASE WHEN quality = 1 THEN 'long' ELSE 'short' END AS g FROM {_EVAL}),
 l AS (SELECT p AS label FROM e UNION SELECT g FROM e), c AS (SELECT label, (SELECT count(*) FROM e WHERE p = label) AS predicted, (SELECT count(*) FROM e WHERE g = label) AS gold, (SELECT count(*) FROM e WHERE p = label AND g = label) AS hits FROM l)
SELECT label, predicted, gold, hits, CASE WHEN predicted > 0 THEN hits / predicted END AS precision, CASE WHEN gold > 0 THEN hits / gold END AS recall FROM c""")
def ev02_class_metrics(t) -> DataFrame:
    e = _eval(t).select(F.when(F.col("score") >= 3000, "long").when(F.col("score") >= 1000, "mid").otherwise("short").alias("p"), F.when(F.col("quality") == 1, "long").otherwise("short").alias("g"))
    return E.class_metrics(e, "p", "g")


@query(f"""SELECT a.source, sum(CASE WHEN a.score > b.score THEN 1 ELSE 0 END)::BIGINT AS concordant, sum(CASE WHEN a.score < b.score THEN 1 ELSE 0 END)::BIGINT AS discordant, sum(CASE WHEN a.score = b.score THEN 1 ELSE 0 END)::BIGINT AS tied
 FROM {_EVAL} a JOIN {_EVAL} b ON a.source = b.source AND a.quality > b.quality GROUP BY 1""")
def ev03_concordance(t) -> DataFrame:
    return E.concordance(_eval(t), "source", "score", "quality")


@query(f"""WITH r AS (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r, row_number() OVER (PARTITION BY source ORDER BY quality DESC, score DESC, doc_id) AS i FROM {_EVAL})
SELECT source, round(sum((pow(2, quality) - 1) / log2(r + 1)) / nullif(sum((pow(2, quality) - 1) / log2(i + 1)), 0), 5) AS ndcg FROM r GROUP BY source""")
def ev03_ndcg(t) -> DataFrame:
    return E.ndcg(_eval(t), "source", [F.desc("score"), F.asc("doc_id")], "quality").select("source", F.round("ndcg", 5).alias("ndcg"))


@query("""WITH o AS (SELECT doc_id, n_chars % 7 AS v FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, n_chars % 7 + CASE WHEN source = 'src1' THEN 1 ELSE 0 END AS v FROM documents WHERE doc_id % 5 <> 0)
SELECT state, count(*) AS n FROM (SELECT CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.doc_id = n.doc_id) GROUP BY state""")
def ev18_refresh_diff(t) -> DataFrame:
    # two revisions of the whole table, one without some keys: the input of a comparison, not a sample of it
    old = t.documents.where("doc_id % 3 <> 0").select("doc_id", (F.col("n_chars") % 7).alias("v"))
    new = t.documents.where("doc_id % 5 <> 0").select("doc_id", (F.col("n_chars") % 7 + F.when(F.col("source") == "src1", 1).otherwise(0)).alias("v"))
    return E.refresh_diff(old, new, ["doc_id"], "v").groupBy("state").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, sha256(array_to_string(regexp_extract_all(coalesce(text, ''), '[a-z]+'), chr(1))) AS h FROM documents""")
def sf22_sequence_hash(t) -> DataFrame:
    return t.documents.select("doc_id", T.sequence_hash(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]+"), F.lit(0))).alias("h"))


@query("""SELECT lang, count(*) AS docs, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars, sum(CASE WHEN text IS NULL OR trim(text) = '' THEN 1 ELSE 0 END)::BIGINT AS blank FROM documents GROUP BY lang""")
def ag26_census(t) -> DataFrame:
    counted = A.census(t.documents, ["lang"], "source", "n_chars", F.col("text").isNull() | (F.trim("text") == ""))
    return counted.withColumnsRenamed({"n": "docs", "size": "chars"})


@query("""SELECT lang, source, count(DISTINCT doc_id // 100) AS sources, sum(n_chars)::BIGINT AS n_chars, sum(length(coalesce(text, '')))::BIGINT AS size FROM documents GROUP BY 1, 2""")
def ag06_grouped_evidence(t) -> DataFrame:
    """Evidence of each language and source: hundreds of ids as what it comes from."""
    rows = t.documents.withColumns({"part": F.floor(F.col("doc_id") / 100), "size": F.length(F.coalesce("text", F.lit(""))).cast("long")})
    return A.evidence_in_groups(rows, ["lang", "source"], "part", ["n_chars", "size"])


@query(f"""WITH w AS (SELECT conv_id, turn, nullif({_END}, '') AS w FROM conversations), f AS (SELECT conv_id, w, min(turn) AS prior FROM w WHERE w IS NOT NULL GROUP BY 1, 2)
SELECT conv_id, turn, prior, 1.0::DOUBLE AS score FROM w JOIN f USING (conv_id, w) WHERE prior < turn""")
def sc04_identity_pairs(t) -> DataFrame:
    """Turns whose closest earlier turn ends in the same word, which no other relation can beat."""
    words = G.settled_words(t.conversations, "conv_id", "turn")
    return G.strongest_pairs(words, "conv_id", "turn", "en").where("type = 'identity'").select("conv_id", "turn", "prior", "score")


@query(f"""WITH w AS (SELECT DISTINCT conv_id, turn, nullif({_END}, '') AS w FROM conversations) SELECT a.conv_id, count(*) AS n FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.w = b.w AND a.turn < b.turn GROUP BY 1""")
def sc06_identity_counts(t) -> DataFrame:
    """How many pairs of turns of a conversation end in the same word, among all relations of its end words."""
    words = G.settled_words(t.conversations, "conv_id", "turn")
    related = G.occurrence_relations(words, G.word_relations(words, "conv_id", "en"), "conv_id", "turn")
    return G.relation_counts(related, ["conv_id"]).where("type = 'identity'").select("conv_id", "n")
