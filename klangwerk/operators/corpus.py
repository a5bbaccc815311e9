"""Corpus statistics and the n-gram model (AG-08..13, SQ-05/06, MK-01..05) over documents of any number."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klangwerk.functions import text as T

from . import workspace as W

START, END = "<s>", "</s>"


def token_counts(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """SR-02: words of each group and how often they occur; counts combine before the shuffle."""
    return docs.select(*keys, F.explode(F.transform(T.word_tokens(text), F.lower)).alias("form")).groupBy(*keys, "form").agg(F.count("*").alias("n"))


def usage_rank(counts: DataFrame, source: str = "source") -> DataFrame:
    """AG-08: mean share per million over all sources (missing ones count zero), and in how many a form occurs.

    Shares are exact integers in millionths per million, so equal corpora give equal scores anywhere."""
    totals = counts.groupBy(source).agg(F.sum("n").alias("total"))
    n_sources = totals.agg(F.count("*").alias("sources"))
    share = F.floor(F.col("n").cast("decimal(20,0)") * 1_000_000_000 / F.col("total")).cast("long")
    per = counts.join(totals, source).select("form", source, "n", share.alias("share"))
    summed = per.groupBy("form").agg(F.sum("share").alias("shares"), F.count("*").alias("in_sources"), F.sum("n").alias("n"))
    return summed.join(F.broadcast(n_sources)).select("form", F.floor(F.col("shares") / F.col("sources")).cast("long").alias("score"), "in_sources", "n")


def sentence_tokens(docs: DataFrame, *keys: str, text: str = "text", least: int = 3, most: int = 48) -> DataFrame:
    """SF-03: lines as token arrays of ``least`` to ``most`` words, without URLs and lines of mostly digits."""
    line = docs.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
    tokens = line.where(~F.col("line").rlike("(?i)https?://|www\\.")).withColumn("tokens", F.transform(T.word_tokens("line"), F.lower))
    digits = F.length(F.regexp_replace("line", "[^0-9]", ""))
    return tokens.where(F.size("tokens").between(least, most) & (digits * 4 <= F.length("line"))).select(*keys, "line_no", "tokens")


def gram_counts(tokens: DataFrame, n: int) -> DataFrame:
    """Counts of n-grams as space-joined text."""
    return tokens.select(F.explode(T.ngrams("tokens", n)).alias("g")).groupBy(F.array_join("g", " ").alias("gram")).agg(F.count("*").alias("n"))


#: Between the words of a gram, in place of words that are missing, and as next word of a context that is only asked for.
_SEP, _GAP, _ASK = "\u0001", "\u0002", "\u0003"


def _dealt(grams: DataFrame, order: int, *keys: str) -> DataFrame:
    """keys, near, g: grams (the words _w0.. and the next one) as text, dealt by their contexts' last two words."""
    words = [F.coalesce(f"_w{j}", F.lit(_GAP)) for j in range(order + 1)]
    return grams.select(*keys, F.xxhash64(*keys, *words[max(0, order - 2) : order]).alias("near"), F.concat_ws(_SEP, *words).alias("g")).repartition("near")


def _length_counts(tokens: DataFrame, order: int, *keys: str, gaps: bool = False, asked: DataFrame | None = None) -> list[tuple[list[str], DataFrame]]:
    """For each context length what its contexts are grouped by, and their counts: keys, near, length, context, next, n.

    A word is shuffled once, with the words before it: contexts of two words and more are whole where their last two words are,
    so their counts, and windows over them, need no other shuffle.  ``asked`` (array ``context``) adds rows of next _ASK."""
    padded = F.concat(F.array_repeat(F.lit(START), order), "tokens", F.array(F.lit(END)))
    each = F.arrays_zip(*(F.slice("_t", F.lit(j + 1), F.size("_t") - order).alias(f"_w{j}") for j in range(order + 1)))
    grams = tokens.select(*keys, padded.alias("_t")).select(*keys, F.explode(each).alias("p")).select(*keys, "p.*")
    if gaps:
        grams = grams.where(F.col(f"_w{order}").isNotNull() & F.col(f"_w{order - 1}").isNotNull())
    if asked is not None:
        own = asked.where(F.size("context") > 0).select(*keys, *(F.get("context", F.size("context") - order + j).alias(f"_w{j}") for j in range(order)), F.lit(_ASK).alias(f"_w{order}"))
        grams = grams.unionByName(own)
    dealt, out = _dealt(grams, order, *keys), []
    for k in range(1, order + 1):
        rows = dealt.withColumn("g", F.substring_index("g", _SEP, -(k + 1))) if k < order else dealt
        near = F.col("near") if k >= min(2, order) else F.lit(0).cast("long")
        # grams with gaps are left out by their counts: a filter on the gram would move below the shuffle, and each length then have its own
        partial = gaps or asked is not None
        counts = rows.groupBy(*keys, near.alias("near"), "g").agg((F.count_if(~F.col("g").contains(_GAP)) if partial else F.count("*")).alias("n"))
        counts = counts.where("n > 0") if partial else counts
        context = F.translate(F.substring_index("g", _SEP, k), _SEP, " ")
        group = [*keys, "near", "context"] if k >= min(2, order) else [*keys, "context"]
        out.append((group, counts.select(*keys, "near", F.lit(k).alias("length"), context.alias("context"), F.substring_index("g", _SEP, -1).alias("next"), "n")))
    return out


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def transitions(tokens: DataFrame, order: int, *keys: str, gaps: bool = False) -> DataFrame:
    """AG-12: counts of (context, next) for all context lengths 1..order, from padded sequences, in one pass; of each group by keys.

    With ``gaps``, null tokens stand for words outside the vocabulary: what has one is not counted, so that no words become
    neighbours that were none."""
    return _united([counts.drop("near") for _, counts in _length_counts(tokens, order, *keys, gaps=gaps)])


def both_counts(tokens: DataFrame, order: int, *keys: str, gaps: bool = False) -> DataFrame:
    """keys, g, n: the counted grams from which `both_transitions` makes the transitions of both directions."""
    padded = F.concat(F.array_repeat(F.lit(START), order), "tokens", F.array_repeat(F.lit(END), order))
    each = F.arrays_zip(*(F.slice("_t", F.lit(j + 1), F.size("_t") - order).alias(f"_w{j}") for j in range(order + 1)))
    grams = tokens.select(*keys, padded.alias("_t")).select(*keys, F.explode(each).alias("p")).select(*keys, "p.*")
    if gaps:
        grams = grams.where(F.col(f"_w{order}").isNotNull() & F.col(f"_w{order - 1}").isNotNull())
    return grams.select(*keys, F.concat_ws(_SEP, *(F.coalesce(f"_w{j}", F.lit(_GAP)) for j in range(order + 1))).alias("g")).groupBy(*keys, "g").agg(F.count("*").alias("n"))


def both_transitions(grams: DataFrame, order: int, *keys: str) -> tuple[DataFrame, DataFrame]:
    """AG-12: `transitions` of `both_counts`, and the same read backwards as `decoder.backward_counts` counts them.

    A line is padded on both sides as if it were read in both directions; each direction leaves out what only the other sees."""
    spark, out = grams.sparkSession, ([], [])
    for k in range(1, order + 1):
        rows = grams
        if k < order:  # both directions read them
            shorter = grams.groupBy(*keys, F.substring_index("g", _SEP, -(k + 1)).alias("g")).agg(F.sum("n").alias("n"))
            rows = W.settled(shorter, f"{W.shared_dir(spark)}/klangwerk-grams-{uuid.uuid4().hex}")
            W.released(spark)
        rows = rows.where(~F.col("g").contains(_GAP))
        word = lambda i: F.substring_index(F.substring_index("g", _SEP, i + 1), _SEP, -1)
        last, first = F.substring_index("g", _SEP, -1), F.substring_index("g", _SEP, 1)
        context = lambda text: F.translate(text, _SEP, " ")
        ahead, behind = F.substring_index("g", _SEP, k), F.substring_index("g", _SEP, -k)
        out[0].append(rows.where(word(k - 1) != END).select(*keys, F.lit(k).alias("length"), context(ahead).alias("context"), last.alias("next"), "n"))
        out[1].append(rows.where((word(1) != START) & (first != END)).select(*keys, F.lit(k).alias("length"), context(behind).alias("context"), first.alias("next"), "n"))
    return _united(out[0]), _united(out[1])


def model(tokens: DataFrame, order: int, *keys: str, most: int = 128, least: int = 1, states: int | None = None, gaps: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """WN-04, AG-13: what `top_transitions` makes of `transitions` seen ``least`` times, without moving them again; only of the
    ``states`` contexts of each length that were seen most often, or of contexts that ``asked`` (array ``context``) ends in."""
    out = []
    for group, counts in _length_counts(tokens, order, *keys, gaps=gaps, asked=asked):
        real = F.col("next") != _ASK if asked is not None else F.lit(True)
        counts = counts.where(F.col("n") >= least) if asked is None else counts.where(~real | (F.col("n") >= least))
        if states is not None:
            top = counts.groupBy(*group).agg(F.sum(F.when(real, F.col("n"))).alias("_t")).orderBy(F.desc("_t"), "context").limit(states)
            counts = counts.join(F.broadcast(top.select("context")), "context")  # so many contexts
        own = Window.partitionBy(*group)
        ranked = counts.withColumn("rank", F.row_number().over(own.orderBy(F.desc(real), F.desc("n"), "next")).cast("long"))
        if asked is None:
            kept = ranked.where(F.col("rank") <= most)
        else:
            kept = ranked.withColumn("_asked", F.max(~real).over(own)).where(F.col("_asked") & real & (F.col("rank") <= most))
        out.append(kept.withColumn("total", F.sum("n").over(own)).select(*keys, "length", "context", "next", "n", "rank", "total"))
    return _united(out)


#: Words up to which a vocabulary is sent to the tasks; a larger one is joined.
MAX_BROADCAST_WORDS = 500_000


def within_vocabulary(lines: DataFrame, line: str, tokens: str, vocabulary: DataFrame, *keys: str) -> DataFrame:
    """AG-13: the lines with null in place of words outside the vocabulary (keys, form), in their places."""
    spark = lines.sparkSession
    vocabulary = W.settled(vocabulary.select(*keys, "form"), f"{W.shared_dir(spark)}/klangwerk-words-{uuid.uuid4().hex}")
    if vocabulary.count() <= MAX_BROADCAST_WORDS:
        return _marked(lines.select(line, *keys, tokens).where(F.size(tokens) > 0), tokens, vocabulary, *keys)
    each = lines.select(line, *keys, F.posexplode(tokens).alias("at", "form"))
    known = each.join(vocabulary.withColumn("_known", F.lit(True)), [*keys, "form"], "left")
    kept = F.struct("at", F.when(F.col("_known"), F.col("form")).alias("form"))
    return known.groupBy(line, *keys).agg(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["form"]).alias(tokens))


def _marked(lines: DataFrame, tokens: str, vocabulary: DataFrame, *keys: str) -> DataFrame:
    """`within_vocabulary` where the lines stand: nothing is shuffled."""
    text = F.concat_ws(_SEP, *(F.col(k).cast("string") for k in keys), "form")
    sent = lines.sparkSession.sparkContext.broadcast([r[0] for r in vocabulary.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in (*keys, "form")))).select(text).collect()])
    at, names = len(keys), [f"_k{i}" for i in range(len(keys))]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(sent.value, pa.string())
        for batch in batches:
            lists, own = batch.column(batch.num_columns - at - 1), batch.columns[batch.num_columns - at :]
            words, of = pc.cast(lists.flatten(), pa.string()), pc.list_parent_indices(lists)
            whole = pc.binary_join_element_wise(*(pc.cast(c.take(of), pa.string()) for c in own), words, _SEP)
            marked = pc.if_else(pc.is_in(whole, value_set=known), words, pa.scalar(None, pa.string()))
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), marked)
            yield pa.RecordBatch.from_arrays([*batch.columns[: batch.num_columns - at - 1], out], names=batch.schema.names[: batch.num_columns - at])

    asked = lines.select(*(c for c in lines.columns if c != tokens), tokens, *(F.col(k).cast("string").alias(n) for k, n in zip(keys, names)))
    return asked.mapInArrow(run, lines.select(*(c for c in lines.columns if c != tokens), tokens).schema)


def top_transitions(counts: DataFrame, k: int = 128) -> DataFrame:
    """WN-04: the k most frequent continuations of each context, and their total."""
    own = Window.partitionBy("length", "context")
    ranked = counts.withColumn("rank", F.row_number().over(own.orderBy(F.desc("n"), "next")).cast("long")).where(F.col("rank") <= k)
    return ranked.withColumn("total", F.sum("n").over(own))


def prune_vocabulary(counts: DataFrame, least: int) -> DataFrame:
    """AG-13: forms seen at least ``least`` times; start and end marks always stay."""
    return counts.where((F.col("n") >= least) | F.col("form").isin(START, END))


def frequent_states(counts: DataFrame, k: int) -> DataFrame:
    """AG-13: the transitions of the k contexts of each length that were seen most often."""
    totals = counts.groupBy("length", "context").agg(F.sum("n").alias("_t"))
    top = totals.withColumn("_r", F.row_number().over(Window.partitionBy("length").orderBy(F.desc("_t"), "context"))).where(F.col("_r") <= k)
    return counts.join(F.broadcast(top.select("length", "context")), ["length", "context"])  # k contexts a length


def shape_patterns(lines: DataFrame, shape: str, length: str, k: int = 96) -> DataFrame:
    """MK-04: the k most frequent shape patterns of each length (arrays of classes), with their counts."""
    n = lines.groupBy(length, shape).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(length).orderBy(F.desc("n"), shape)).cast("long")).where(F.col("rank") <= k)


def shape_fit(candidates: DataFrame, patterns: DataFrame, key: str, shape: str, length: str) -> DataFrame:
    """MK-04: how well a line's shape fits the patterns of its length: the best of 1 - (places that differ) / length, weighted
    towards frequent patterns by a tenth; patterns counts those compared, fit is null without any."""
    p = patterns.select(length, F.col(shape).alias("_p"), F.col("n").alias("_n"), F.max("n").over(Window.partitionBy(length)).alias("_most"))
    met = candidates.select(key, shape, length).join(p, length, "left")
    same = F.size(F.filter(F.zip_with(shape, "_p", lambda a, b: a == b), lambda x: x)) / F.greatest(F.lit(1), F.col(length))
    fit = same * 0.9 + F.log1p("_n") / F.log1p("_most") * 0.1
    return met.groupBy(key).agg(F.count("_p").alias("patterns"), F.round(F.max(F.when(F.col("_p").isNotNull(), fit)), 6).alias("fit"))


#: Function words of the two languages, by class.
FUNCTION_WORDS = {
    "article": ("der", "die", "das", "ein", "eine", "the", "a", "an"),
    "pronoun": ("ich", "du", "er", "sie", "es", "wir", "ihr", "i", "you", "he", "she", "it", "we", "they"),
    "preposition": ("in", "an", "auf", "mit", "von", "zu", "of", "on", "at", "to", "with", "from", "by"),
    "conjunction": ("und", "oder", "aber", "denn", "and", "or", "but", "for"),
    "negation": ("nicht", "kein", "not", "no", "never"),
}


def token_class(token: Column) -> Column:
    """SF-05: the class of a function word, else its shape."""
    t = F.lower(token)
    named = F.coalesce(*(F.when(t.isin(*words), kind) for kind, words in FUNCTION_WORDS.items()))
    return F.coalesce(named, T.token_shape(token))


def shape_key(tokens: Column | str) -> Column:
    """SF-05: classes of the tokens in order, joined."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.array_join(F.transform(c, lambda t: token_class(t)), " ")


def preferred_casing(tokens: DataFrame, form: str = "form", least: float = 0.6) -> DataFrame:
    """SF-04: per lower-case form its number and how it is best written: in capitals or with a capital if at least that share of
    its uses is, else in small letters."""
    shaped = tokens.select(F.lower(form).alias("form"), T.token_shape(form).alias("s"))
    n = shaped.groupBy("form").agg(F.count("*").alias("n"), F.count_if(F.col("s") == "upper").alias("u"), F.count_if(F.col("s") == "title").alias("t"))
    own = F.when(F.col("u") >= F.col("n") * least, F.upper("form")).when(F.col("t") >= F.col("n") * least, F.concat(F.upper(F.left("form", F.lit(1))), F.expr("substr(form, 2)"))).otherwise(F.col("form"))
    return n.select("form", "n", own.alias("written"))


def usage_evidence(counts: DataFrame, totals: DataFrame, form: str, source: str) -> DataFrame:
    """AG-10: per form and source uses per million: n, total and per_million."""
    return counts.join(totals, source).select(form, source, "n", "total", (F.col("n") * 1e6 / F.col("total")).alias("per_million"))


def backoff(contexts: DataFrame, model: DataFrame, order: int = 4) -> DataFrame:
    """MK-01: continuations of each context (array ``context``, id ``id``) from the longest of its suffixes that the model knows."""
    suffix = F.transform(F.sequence(F.lit(1), F.least(F.lit(order), F.size("context"))), lambda k: F.struct(k.alias("length"), F.array_join(F.slice("context", F.size("context") - k + 1, k), " ").alias("context")))
    hit = contexts.select("id", F.explode(suffix).alias("s")).select("id", "s.length", "s.context").join(model, ["length", "context"])
    longest = F.max("length").over(Window.partitionBy("id"))
    return hit.withColumn("_longest", longest).where(F.col("length") == F.col("_longest")).drop("_longest")


def transition_probability(pairs: DataFrame, model: DataFrame, order: int = 4, floor: float = 1e-9) -> DataFrame:
    """MK-02: for (id, context, next), n / total of the longest suffix of the context that was followed by next, else the floor."""
    suffix = F.transform(F.sequence(F.lit(1), F.least(F.lit(order), F.size("context"))), lambda k: F.struct(k.alias("length"), F.array_join(F.slice("context", F.size("context") - k + 1, k), " ").alias("context")))
    each = pairs.select("id", "next", F.explode(suffix).alias("s")).select("id", "next", "s.length", "s.context")
    hit = each.join(model.select("length", "context", "next", "n", "total"), ["length", "context", "next"])
    best = hit.groupBy("id").agg(F.max_by(F.col("n") / F.col("total"), "length").alias("p"), F.max("length").alias("used_length"))
    return pairs.select("id").distinct().join(best, "id", "left").select("id", F.coalesce("p", F.lit(floor)).alias("p"), F.coalesce("used_length", F.lit(0)).alias("used_length"))


def sequence_score(probabilities: DataFrame, key: str, p: str = "p") -> DataFrame:
    """MK-05: exp of the mean log probability, and the share of floored ones."""
    return probabilities.groupBy(key).agg(F.exp(F.avg(F.log(F.greatest(F.col(p), F.lit(1e-9))))).alias("score"), F.avg(F.when(F.col(p) <= 1e-9, 1.0).otherwise(0.0)).alias("floored"))


def windows(tokens: DataFrame, *keys: str, lengths: range = range(4, 9)) -> DataFrame:
    """SQ-06: hashed windows of 4..8 tokens."""
    hashed = lambda n: F.transform(T.ngrams("tokens", n), lambda g: F.struct(F.lit(n).alias("length"), F.xxhash64(F.array_join(g, "\u0001")).alias("h")))
    grams = F.concat(*map(hashed, lengths))
    return tokens.select(*keys, F.explode(grams).alias("w")).select(*keys, "w.length", "w.h")


#: Windows of the candidates up to which they are broadcast; beyond it the same join is a shuffle join.
MAX_BROADCAST_WINDOWS = 2_000_000
#: Tokens of the shortest and the longest window.
SHORTEST, WIDEST = 4, 8
#: Fixed value: the kind of sources that support a line; all other kinds make it a copy.
PHRASE = "phrase"


def _shortest_windows(tokens: DataFrame, *keys: str) -> DataFrame:
    """keys, place and hash of every window of four tokens."""
    t = F.col("tokens")
    each = F.arrays_zip(*(F.slice(t, F.lit(i + 1), F.greatest(F.lit(0), F.size(t) - SHORTEST + 1)).alias(f"t{i}") for i in range(SHORTEST)))
    hashed = F.transform(each, lambda z: F.xxhash64(*(z[f"t{i}"] for i in range(SHORTEST))))
    return tokens.where(F.size(t) >= SHORTEST).select(*keys, F.posexplode(hashed).alias("place", "h"))


def _all_windows(shortest: DataFrame, sequence: str) -> DataFrame:
    """All windows from those of four tokens: where the next ones stand at the next places, their hashes tell the longer window."""
    own = Window.partitionBy(sequence).orderBy("place")
    df, keys, whole = shortest, [F.col("h")], F.lit(True)
    entries = [F.struct(F.lit(SHORTEST).alias("length"), F.xxhash64("h").alias("w"), whole.alias("ok"))]
    for j in range(1, WIDEST - SHORTEST + 1):
        df = df.withColumn(f"_p{j}", F.lead("place", j).over(own)).withColumn(f"_h{j}", F.lead("h", j).over(own))
        whole = whole & (F.col(f"_p{j}") == F.col("place") + j)
        keys.append(F.col(f"_h{j}"))
        entries.append(F.struct(F.lit(SHORTEST + j).alias("length"), F.xxhash64(*keys).alias("w"), F.coalesce(whole, F.lit(False)).alias("ok")))
    return df.withColumn("_w", F.explode(F.filter(F.array(*entries), lambda e: e["ok"]))).select(*shortest.columns, F.col("_w.length").alias("length"), F.col("_w.w").alias("w"))


def novelty_by_kind(candidates: DataFrame, sources: DataFrame, key: str, kind: str) -> DataFrame:
    """MK-03: key, kind, exact (a source is the same token sequence), longest (of the windows of four to eight tokens that the
    candidate shares with the kind's sources) and matched (how many of its windows are shared); a row for each kind found.

    Both sides have ``tokens``.  Sources are cut to windows of four tokens, and only those that a candidate has are shuffled;
    longer windows are made of these hits alone."""
    sequence = candidates.select(key, "tokens").withColumn("_id", F.xxhash64(F.col(key).cast("string")))
    shortest = _shortest_windows(sequence, key, "_id")
    own = _all_windows(shortest, "_id").select(key, "length", "w")
    asked = shortest.select("h").distinct()
    few = asked.limit(MAX_BROADCAST_WINDOWS + 1).count() <= MAX_BROADCAST_WINDOWS
    numbered = sources.select(F.col(kind).alias("kind"), "tokens").withColumn("_sid", F.monotonically_increasing_id())
    hits = _shortest_windows(numbered, "kind", "_sid").join(F.broadcast(asked) if few else asked, "h", "left_semi").select("kind", "_sid", "place", "h")
    known = _all_windows(hits, "_sid").select("kind", "length", "w").distinct()
    shared = own.join(known, ["length", "w"]).groupBy(key, "kind").agg(F.max("length").alias("longest"), F.count("*").alias("matched"))
    line = F.xxhash64(F.array_join("tokens", "\u0001"), F.size("tokens"))
    lines = candidates.where(F.size("tokens") > 0).select(key, line.alias("_line")).distinct()
    wanted = lines.select("_line").distinct()
    same = sources.where(F.size("tokens") > 0).select(F.col(kind).alias("kind"), line.alias("_line")).join(F.broadcast(wanted) if few else wanted, "_line", "left_semi").distinct()
    exact = lines.join(same, "_line").select(key, "kind", F.lit(True).alias("exact")).distinct()
    both = shared.join(exact, [key, "kind"], "full")
    return both.select(key, "kind", F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("matched", F.lit(0)).cast("long").alias("matched"))


def source_novelty(candidates: DataFrame, by_kind: DataFrame, key: str) -> DataFrame:
    """MK-03: key, exact_source, longest_run, matched_windows, novelty, phrase_run and phrase_support of every candidate.

    Phrases support a line, other kinds make it less new: novelty is the part of the line beyond the longest copied run."""
    n = F.size("tokens")
    strict, phrase = F.col("kind") != PHRASE, F.col("kind") == PHRASE
    summed = by_kind.groupBy(key).agg(F.max(F.when(strict, F.col("exact"))).alias("e"), F.max(F.when(strict, F.col("longest"))).alias("l"), F.sum(F.when(strict, F.col("matched"))).alias("m"), F.max(F.when(phrase, F.col("longest"))).alias("p"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda c, most: F.least(F.lit(1.0), zero(c) / F.greatest(F.lit(1), most))
    return candidates.select(key, F.coalesce(n, F.lit(0)).alias("_n")).join(summed, key, "left").select(
        key, F.coalesce("e", F.lit(False)).alias("exact_source"), zero("l").alias("longest_run"), zero("m").alias("matched_windows"),
        F.when(F.col("_n") > 0, F.round(1.0 - share("l", F.col("_n")), 6)).otherwise(1.0).alias("novelty"), zero("p").alias("phrase_run"),
        F.when(F.col("_n") > 0, F.round(share("p", F.least(F.lit(WIDEST), F.col("_n"))), 6)).otherwise(0.0).alias("phrase_support"))


def novelty(candidates: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """MK-03: the longest window that each candidate shares with the sources; 0 if none."""
    by_kind = novelty_by_kind(candidates, sources.withColumn("kind", F.lit("")), key, "kind")
    return candidates.select(key).distinct().join(by_kind.select(key, "longest"), key, "left").select(key, F.coalesce("longest", F.lit(0)).alias("longest"))


def shape(tokens: Column | str) -> Column:
    """SF-05: shapes of the tokens, joined."""
    return F.array_join(F.transform(tokens, T.token_shape), " ")


def bridges(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """JN-20: a, z, m and bridge: continuations m of a (probability p) from which z may come (q), with sqrt(p q).

    ``forward``: a, b, p and ``backward``: a, b, q of bounded vocabularies (the model keeps its best continuations)."""
    return forward.select("a", F.col("b").alias("m"), "p").join(backward.select(F.col("b").alias("z"), F.col("a").alias("m"), "q"), "m").select("a", "z", "m", F.sqrt(F.col("p") * F.col("q")).alias("bridge"))
