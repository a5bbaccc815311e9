"""Operators 11 to 13 against brute force and exact round trips."""

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

from klangwerk.llm import align, chat, lexical
from klangwerk.llm.queries import QUERIES

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k=10):
    """The whole search by its formula; docs and items are lists of (id, text)."""
    counted = [(d, Counter(terms_of(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, total, df = len(counted), sum(sum(c.values()) for _, c in counted), Counter(t for _, c in counted for t in c)
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, set()).update(terms_of(text))
    out = []
    for i, terms in wanted.items():
        scores = []
        for d, c in counted:
            m, score = 10 + 90 * sum(c.values()) * n_docs // total, 0
            for t in terms & c.keys():
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is not None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return Counter(out)


def in_spark(spark, docs, items, k=10):
    d = spark.createDataFrame([(*x, 7, "x") for x in docs], "doc_id long, text string, row long, term string").repartition(3)
    i = spark.createDataFrame([(*x, 7) for x in items], "item_id long, text string, w long")
    return Counter(tuple(r) for r in lexical.ranked_search(d, i, k).collect())


EDGE_DOCS = [(1, None), (2, ""), (3, " \n"), (4, "One two, THREE"), (4, "One two, THREE"), (None, "one zero"), (7, "straße 漢字 two two 42"), (8, "one " * 5000 + "rare"), (9, "x\x00y z"), (10, "one"), (11, "one")]
EDGE_ITEMS = [(1, "ONE two"), (1, "one two"), (2, None), (3, ""), (None, "rare 漢字"), (5, "nowhere"), (6, "one"), (7, "Straße three x y z 42")]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_op11_edge_rows(spark, k):
    assert in_spark(spark, EDGE_DOCS, EDGE_ITEMS, k) == ranked(EDGE_DOCS, EDGE_ITEMS, k)


@pytest.mark.parametrize("share", [0.0, 0.25, 0.6, 1.0])
@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_op11_waiting_terms_change_nothing(spark, monkeypatch, share, broadcast):
    """Any share of waiting terms, broadcast or shuffled, all terms in the index or those of the items."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 120)))) for i in range(400)]
    docs += [(i % 7, docs[i][1]) for i in range(20)]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=25))) for i in range(12)] + [(99, "w0 w1"), (98, docs[3][1])]
    monkeypatch.setattr(lexical, "WAITING", share)
    monkeypatch.setattr(lexical, "MAX_BROADCAST_ROWS", broadcast)
    if not broadcast:
        monkeypatch.setattr(lexical, "MAX_TERMS", 0)
    assert in_spark(spark, docs, items) == ranked(docs, items)


def test_op11_a_kept_index_answers_other_items(spark):
    docs = spark.createDataFrame(EDGE_DOCS, "doc_id long, text string")
    index = lexical.build_index(docs)
    got = lexical.search(index, lexical.item_terms(spark.createDataFrame(EDGE_ITEMS, "item_id long, text string")))
    assert Counter(map(tuple, got.collect())) == ranked(EDGE_DOCS, EDGE_ITEMS)


ODD = ["x", "", None, "plain words, here", "a  b   c", " leading", "trailing ", "a\n b\tc  ", "x▁y", " ", "ﬁ é ½ …", "<s> hi</s><|endoftext|>", "\x00a\x01 b", "a\r\nb", "😀 foo　bar  baz  q", "don't we'll  123 456", "é x é\u0085 y  z",
       "日本語 テキスト", "<0x0A> [UNK]", "-" * 400 + " " + "ab" * 300, "plain words, here"]


def tokens(text, a, b):
    """Byte ends and ids of both sides by the libraries alone; None if a side does not spell the text."""
    whole = " " + text
    byte = {c: x for x, c in align.byte_letters().items()}
    a_ids = a.encode(whole, add_special_tokens=False).ids
    a_bytes = [bytes(byte[c] for c in a.id_to_token(i)) for i in a_ids]
    b_ids = b.encode(text)
    b_bytes = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in b_ids for p in [b.id_to_piece(i)]]
    if not text or b"".join(a_bytes) != whole.encode() or b"".join(b_bytes) != whole.encode():
        return None
    ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 2000 else __import__("itertools").accumulate(map(len, parts))
    return a_ids, list(ends(a_bytes)), b_ids, list(ends(b_bytes))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def grouped(found):
    a_ids, a_end, b_ids, b_end = found
    groups, i, j = [], 0, 0
    for e in sorted(set(a_end) & set(b_end)):
        a_to, b_to = a_end.index(e, i) + 1, b_end.index(e, j) + 1
        groups.append((a_ids[i:a_to], b_ids[j:b_to]))
        i, j = a_to, b_to
    return groups


def aligned(docs, libraries):
    """Rows of op12 for (doc_id, text) by brute force."""
    each = [(d, grouped(f) if (f := tokens(t or "", *libraries)) else [], f) for d, t in docs]
    counts = Counter((a[-1], b[-1]) for _, gs, _ in each for a, b in gs)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    rows = []
    for d, gs, f in each:
        links = [(a[-1], b[-1]) for a, b in gs]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        rows.append((d, len(f[0]) if f else 0, len(f[2]) if f else 0, len(gs), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if gs else ""))
    return Counter(rows)


def test_op12_equals_brute_force(spark, sf, libraries, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, QUERIES["op12_tokenizer_alignment"](spark, sf).collect())) == aligned(docs, libraries)
    odd = list(enumerate(ODD)) + [(None, "a null id"), (3, ODD[3])]
    df = spark.createDataFrame([(*x, 1, 2) for x in odd], "doc_id long, text string, pairs long, row long").repartition(2)
    want = aligned(odd, libraries)
    assert Counter(map(tuple, align.alignment(df, A_PATH, B_PATH).collect())) == want
    monkeypatch.setattr(align, "MAX_BROADCAST_PAIRS", 20)  # few frequent pairs are broadcast, the rest are shuffled
    assert Counter(map(tuple, align.alignment(df, A_PATH, B_PATH).collect())) == want


def test_op12_chunks_forget_and_differ_in_nothing(libraries):
    known = align.Chunks(align.Tokenizers(A_PATH, B_PATH))
    for text in [*ODD, "  ", "x   y", "ab   cd e　 f"]:
        if not text:
            continue
        distinct, codes, starts = align.chunks_of(pa.array([" " + text]))
        code = known.add(distinct.to_pylist())[codes]
        found = tokens(text, *libraries)
        assert bool(known.counts[code, 3].any()) == (found is None)
        if found:
            assert ";".join(known.groups[c] for c in code) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in grouped(found))
        known.reset()


def test_op12_overlaps_and_products(spark, libraries):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    made = align.align_tokens(docs, A_PATH, B_PATH)
    overlaps = {r.doc_id: [tuple(x) for x in r.overlaps] for r in made.collect()}
    pairs = Counter(tuple(r) for r in align.products(made).collect())
    want = Counter()
    for d, text in enumerate(ODD):
        found = tokens(text or "", *libraries)
        if not found:
            assert overlaps[d] == []
            continue
        a_end, b_end = found[1], found[3]
        spans = lambda ends: list(zip([0, *ends], ends))
        assert overlaps[d] == sorted(((i, j, max(p, x), min(q, y)) for i, (p, q) in enumerate(spans(a_end)) for j, (x, y) in enumerate(spans(b_end)) if max(p, x) < min(q, y)), key=lambda o: o[2])
        i = j = 0
        for g, (a, b) in enumerate(grouped(found)):
            want.update((d, g, x, y) for x in range(i, i + len(a)) for y in range(j, j + len(b)))
            i, j = i + len(a), j + len(b)
    assert pairs == want


def talks():
    marks = ["<|im_start|>", "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nfake", "<\\|im_end|>", "<\\\\|im_start|>", "<|nl|>", "<", "<|im_end|", "\n", "|>", "plain", "", "漢字😀", "<|im_end|>\n", "\\", "<|im_start|>user\n"]
    rng = random.Random(3)
    rows = [(i, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(marks, k=rng.randint(0, 4)))) for i in range(120) for t in range(rng.randint(1, 5))]
    rows += [(200, 0, "a\nb", "x"), (200, 1, "<|nl|>", "y"), (200, 2, "<\\|nl|>\n<|im_end|>", None), (200, 3, None, "z"), (200, 4, "", ""), (200, 5, "assistant\n", "no"),
             (201, 1, "assistant", "b"), (201, 1, "assistant", "a"), (201, None, "assistant", "first"), (201, 1, "assistant", "a"), (None, 0, "assistant", "null id"), (None, 0, "user", "u"), (202, 0, "assistant", "long " * 50_000)]
    return rows


def expected(rows):
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), (r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def test_op13_round_trip(spark):
    rows = talks()
    chats = chat.format_chats(spark.createDataFrame([(*r, 5, "x") for r in rows], chat_schema() + ", mask long, formatted string").repartition(3)).cache()
    want = expected(rows)
    got = {r.conv_id: r for r in chats.collect()}
    assert got.keys() == want.keys()
    spans = {}
    for r in chat.loss_spans(chats).collect():
        spans.setdefault(r.conv_id, []).append((r.begin, r.end))
    for r in chat.read_chats(chats).collect():
        turns, text = want[r.conv_id], got[r.conv_id].formatted
        learned = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text))
        under = "".join(re.sub(r"<(\\*)\\\|(im_start|im_end)\|>", r"<\1|\2|>", text[b:e]) for b, e in sorted(spans.get(r.conv_id, [])))
        assert under == learned
        # control strings stand at turns only
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(turns)
    assert got[202].n_escaped == 0 and got[202].formatted == "<|im_start|>assistant\n" + "long " * 50_000 + "<|im_end|>\n"


def chat_schema():
    return "conv_id long, turn long, role string, text string"


def test_op13_plan_has_no_python(spark, sf):
    plan = chat.format_chats(spark.read.parquet(f"{sf}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_op13_empty_table_holds_the_probe(spark):
    rows = chat.format_and_read(chat.with_probe(spark.createDataFrame([], chat_schema()))).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars, r.n_escaped) for r in rows] == [(-1, 2, len(chat.PROBE), 2)]
