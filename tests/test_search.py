"""Search, song and sequential operators against brute force on small data."""

from pyspark.sql import functions as F

from klangwerk.functions import text as T
from klangwerk.operators import corpus as C
from klangwerk.operators import lexicon as L
from klangwerk.operators import ranking as R
from klangwerk.operators import relational as O
from klangwerk.operators import search as S
from klangwerk.operators import song as G

WORDS = "haus maus laus raus baum traum raum schaum tag schlag mag frag reise weise kreise leise hand sand wand land stein bein fein klein".split()


def lexicon(spark):
    return spark.createDataFrame([("de", w, 100 - i, 1, i + 1) for i, w in enumerate(WORDS)], "language string, form string, n long, sources long, usage_rank long")


def test_search_finds_perfect_rhymes_first(spark):
    words = lexicon(spark)
    got = S.search(words.where("form in ('haus', 'reise')"), words).collect()
    tops = {q: {r.form for r in got if r.query == q and r.tier == 0} for q in ("haus", "reise")}
    assert tops == {"haus": {"maus", "laus", "raus"}, "reise": {"weise", "kreise", "leise"}}
    assert all(r.form != r.query for r in got) and {r.position for r in got if r.query == "haus"} == set(range(1, sum(r.query == "haus" for r in got) + 1))


def test_bounded_lookup_prefers_near_syllables(spark):
    t = L.channels(L.pronounce(lexicon(spark)))
    got = S.candidates(t.where("form = 'haus'"), t, 2).collect()
    assert 0 < len(got) <= 2 * 7


def test_scheme(spark):
    lines = spark.createDataFrame([(1, i, f"word {w}.") for i, w in enumerate(["haus", "baum", "maus", "traum", "tag"])] + [(2, 0, "stein"), (2, 1, None)], "song long, line long, text string")
    words = G.line_words(lines, "song", "line")
    got = {(r.song, r.line): r.label for r in G.scheme(words, G.strongest_pairs(words, "song", "line", "de").where("type in ('perfect', 'multisyllabic_perfect')"), "song", "line").collect()}
    assert got == {(1, 0): "A", (1, 1): "B", (1, 2): "A", (1, 3): "B", (1, 4): "C", (2, 0): "A", (2, 1): "—"}


def test_scheme_looks_at_every_earlier_line(spark):
    """However far back; an equal end word is closest, of equally close lines the first counts."""
    ends = ["haus", *["tag", "brief", "mond", "schule"] * 5, "maus", "haus"]
    lines = spark.createDataFrame([(1, i, f"word {w}") for i, w in enumerate(ends)], "song long, line long, text string")
    words = G.line_words(lines, "song", "line")
    m = {r.line: r for r in G.strongest_pairs(words, "song", "line", "de").collect()}
    assert (m[21].prior, m[21].primary) == (0, True) and m[21].type in ("perfect", "multisyllabic_perfect")
    assert (m[22].prior, m[22].type, m[22].score) == (0, "identity", 1.0) and m[17].prior == 1 and m[17].type == "identity"
    labels = [r.label for r in G.scheme(words, G.strongest_pairs(words, "song", "line", "de"), "song", "line").orderBy("line").collect()]
    assert labels == ["A", *"BCDE" * 5, "A", "A"]
    assert {(r.label, r.lines, r.first_line, r.last_line, r.widest_gap) for r in G.chains(G.scheme(words, G.strongest_pairs(words, "song", "line", "de"), "song", "line"), "song", "line").collect()} == {
        ("A", 3, 0, 22, 21), *((x, 5, i + 1, i + 17, 4) for i, x in enumerate("BCDE"))}
    rel = G.occurrence_relations(words, G.word_relations(words, "song", "de"), "song", "line")
    got = {(r.left, r.right): r.type for r in rel.collect()}
    assert got[0, 22] == "identity" and got[0, 21] in ("perfect", "multisyllabic_perfect") and sum(t == "identity" for t in got.values()) == 41
    assert {(r.type): r.n for r in G.relation_counts(rel, ["song"]).collect()}["identity"] == 41


def test_channel_cut_keeps_what_a_query_can_take(spark):
    """The cut of the postings before the join changes no result."""
    words = L.channels(L.pronounce(lexicon(spark)))
    ask = words.where("form IN ('haus', 'reise', 'hand')")
    for limit in (1, 3, 50):
        got = {(r["query"], r.form) for r in S.candidates(ask, words, limit).collect()}
        want = set()
        rows = [r.asDict() for r in words.collect()]
        for q in (r for r in rows if r["form"] in ("haus", "reise", "hand")):
            hits = [r for r in rows if r["channel"] == q["channel"] and r["key"] == q["key"] and r["form"] != q["form"]]
            hits.sort(key=lambda r: (abs(r["syllables"] - q["syllables"]), r["syllables"], r["usage_rank"], r["form"]))
            want |= {(q["form"], r["form"]) for r in hits[:limit]}
        assert got == want


def test_redundancy_and_utility(spark):
    assert S.redundancy("liebe", "diebe") == 0 and S.redundancy("", "a") == 0 and S.redundancy("haus", "haus") == 1
    assert S.redundancy("arbeitsweise", "arbeitsreise") == round(1 - 1 / 12, 4) and S.redundancy("handlungsort", "handlungsarm") == round(0.5 + 0.45 * 9 / 12, 4)
    assert S.redundancy("a", "b", ("x", "x")) == 1 and S.redundancy("a", "b", (None, None), ("f", "f")) == 0.92
    rows = spark.createDataFrame([("nacht", "macht", 1, 1, 100, 1000, 0.9, 0, False, "", ""), ("arbeitsweise", "arbeitsreise", 4, 5, 10, None, 0.8, 1, True, "", ""), ("gehen", "ging", 2, 1, None, 5, 0.7, 2, False, "gehen", "gehen")],
                                 "query string, form string, query_syllables int, syllables int, query_rank int, usage_rank int, score double, tier int, rare boolean, query_lemma string, lemma string")
    got = {r["query"]: (r.overlap, r.utility, r.writer_tier) for r in S.utility(rows).collect()}
    assert got["nacht"] == (0.0, round(0.72 * 0.9 + 0.16 + 0.12 * 0.85, 4), 0)
    over = round(max(0.5 + 0.45 * 7 / 12, 0.9 * 11 / 12), 4)
    assert got["arbeitsweise"] == (over, round(0.72 * 0.8 + 0.08 + 0.12 * 0.25 - 0.16 * over - 0.08, 4), 2)
    assert got["gehen"][0] == 1.0 and got["gehen"][2] == 5


def test_near_tie_bands(spark):
    df = spark.createDataFrame([("q", i, s) for i, s in enumerate([0.90, 0.89, 0.88, 0.86, 0.85, 0.80])], "k string, id long, score double")
    got = [r.band for r in R.near_tie_bands(df, ["k"], "score", ["id"]).orderBy("id").collect()]
    assert got == [0, 0, 0, 1, 1, 2]


def test_capped_greedy_chains(spark):
    rows = [("q", 1, "a", "x"), ("q", 2, "a", "y"), ("q", 3, "b", "x"), ("q", 4, "b", "y"), ("q", 5, "c", "z")]
    got = R.capped_greedy(spark.createDataFrame(rows, "k string, r long, e string, s string"), "k", "r", {"e": 1, "s": 1}, 10).orderBy("r").collect()
    assert [r.r for r in got] == [1, 4, 5]


def test_ordinals_equal_one_global_window(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("v"))
    got = {r.v: r.o for r in R.ordinals(df, [F.asc("v")], F.floor(F.col("v") / 40), "o").collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted(got))}


def test_containment_handles_short_patterns_and_nulls(spark):
    seqs = spark.createDataFrame([(1, "a b a b c".split()), (2, []), (3, None)], "id long, t array<string>")
    pats = spark.createDataFrame([(10, ["a", "b"]), (11, ["c"]), (12, ["b", "a", "b", "c"]), (13, []), (14, ["c", "a"])], "pid long, p array<string>")
    got = {(r.id, r.pid, r.place) for r in O.contained_sequences(seqs, pats, "id", "t", "pid", "p").collect()}
    assert got == {(1, 10, 0), (1, 10, 2), (1, 11, 4), (1, 12, 1)}


def test_backoff_and_probability(spark):
    tokens = spark.createDataFrame([("a b c".split(),), ("a b d".split(),), ("x b d".split(),)], "tokens array<string>")
    model = C.top_transitions(C.transitions(tokens, 3))
    ask = spark.createDataFrame([(1, ["a", "b"], "c"), (2, ["zzz", "b"], "d"), (3, ["qq"], "d")], "id long, context array<string>, next string")
    best = {r.id: r.next for r in C.backoff(ask, model, 3).where("rank = 1").collect()}
    assert best == {1: "c", 2: "d"}
    p = {r.id: round(r.p, 6) for r in C.transition_probability(ask, model, 3).collect()}
    assert p == {1: 0.5, 2: round(2 / 3, 6), 3: 0.0}


def test_text_functions(spark):
    one = spark.range(1)
    row = one.select(T.scheme_label(F.lit(0)).alias("a"), T.scheme_label(F.lit(26)).alias("b"), T.scheme_label(F.lit(27)).alias("c"), T.scheme_label(F.lit(702)).alias("d"),
                     T.common_prefix_length(F.lit("abcd"), F.lit("abxd")).alias("p"), T.common_suffix_length(F.lit("abcd"), F.lit("xbcd")).alias("s"), T.common_prefix_length(F.lit(""), F.lit("a")).alias("z"),
                     T.suffix_keys(F.lit("aɪ-ə")).alias("k"), T.token_shape(F.lit("Haus")).alias("t"), T.token_shape(F.lit("HAUS")).alias("u"), T.token_shape(F.lit("12")).alias("f"),
                     T.left_variants(F.lit("arbeits")).alias("l")).first()
    assert (row.a, row.b, row.c, row.d, row.p, row.s, row.z) == ("A", "AA", "AB", "AAA", 2, 3, 0)
    assert row.k == ["aɪ-ə", "ɪ-ə"] and (row.t, row.u, row.f) == ("title", "upper", "fixed") and "arbeit" in row.l


def test_transitions_shuffle_a_word_once(spark):
    """Counts, models and asked contexts against brute force; all lengths read one shuffle of the grams."""
    from collections import Counter

    lines = ["a b a b c", "a b a c", "b a b", "c"]
    tokens = spark.createDataFrame([(x.split(),) for x in lines], "tokens array<string>")
    n = Counter()
    for x in lines:
        p = ["<s>"] * 3 + x.split() + ["</s>"]
        n.update((k, " ".join(p[i - k : i]), p[i]) for i in range(3, len(p)) for k in (1, 2, 3))
    counts = C.transitions(tokens, 3)
    assert {(r.length, r.context, r.next): r.n for r in counts.collect()} == dict(n)
    asked = spark.createDataFrame([(["x", "a", "b"],), (["c"],), (["b", "b"],), ([],)], "context array<string>")
    whole = {(r.length, r.context, r.next, r.n, r["rank"], r.total) for r in C.top_transitions(counts, 2).collect()}
    model = C.model(tokens, 3, most=2, asked=asked)
    assert {tuple(r) for r in C.model(tokens, 3, most=2).collect()} == whole
    assert {tuple(r) for r in model.collect()} == {r for r in whole if (r[0], r[1]) in {(1, "b"), (2, "a b"), (1, "c")}}
    frequent = {tuple(r)[:4] for r in C.top_transitions(C.frequent_states(counts, 2), 128).select("length", "context", "next", "n").collect()}
    assert {(r.length, r.context, r.next, r.n) for r in C.model(tokens, 3, states=2).collect()} == frequent
    for df in (counts, model):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Generate explode(arrays_zip") <= 1 or "ReusedExchange" in plan


def test_padded_contexts_of_a_long_text(spark):
    """The words of a text are read once, not again for each of its words: 6,000 words take no time to speak of."""
    import time

    long = spark.createDataFrame([(" ".join(f"w{i}" for i in range(6000)),)], "text string").repartition(1)
    began = time.perf_counter()
    pairs = long.select(F.explode(T.padded_contexts(T.word_tokens("text"))).alias("p")).select("p.*").collect()
    assert len(pairs) == 6001 and list(pairs[0].context) == ["<s>"] * 4 and list(pairs[-1].context) == [f"w{i}" for i in range(5996, 6000)] and time.perf_counter() - began < 15
    grams = long.select(F.explode(T.ngrams(T.word_tokens("text"), 5)).alias("g")).collect()
    assert len(grams) == 5996 and list(grams[7].g) == [f"w{i}" for i in range(7, 12)]
