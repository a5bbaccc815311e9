"""The pipeline against what its stages must do to planted documents."""

import hashlib

import numpy as np
import pytest
import public_tokenizers as P

import corpus_pipeline
from klangwerk.llm.common import settle

WORDS = {"en": "the of and house water light stone garden river winter letter morning story window silver".split(),
         "de": "der die und das haus wasser schloss garten brücke winter straße morgen geschichte fenster silber".split()}


def prose(rng, lang, n):
    return " ".join(WORDS[lang][k] + ("." if rng.random() < 0.1 else "") + (str(rng.integers(50)) if rng.random() < 0.2 else "") for k in rng.integers(0, 15, n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    docs = [(i, prose(rng, ("en", "de")[i % 2], 120), ("en", "de")[i % 2]) for i in range(40)]
    item = prose(rng, "en", 40)
    docs += [(100, docs[0][1], "en"), (101, docs[1][1] + " ende", "de"), (102, prose(rng, "en", 60) + " " + item + " " + prose(rng, "en", 30), "en"),
             (103, docs[2][1][:300] + " write to me.now@mail.example.com or +1 (212) 555-0100 today", "en"), (104, None, "en"), (105, "", None), (106, "12 34 --", "de"),
             (107, "qxzvw jkqxz wqjxk zzxqv kjwqx " * 12, None), (108, "漢字仮名交 文章例示文 " * 20, None)]
    d = str(tmp_path_factory.mktemp("planted"))
    rows = [(i, t, g, "s", len(t or ""), "extra") for i, t, g in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, {i: t for i, t, _ in docs}


def test_stages(spark, planted):
    d, texts = planted
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "byte_bpe"]
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, d), name)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "personal_data":
            masked = {r.doc_id: r.text for r in docs.collect()}
    plain = set(range(40))
    assert kept[0] == plain | {100, 101, 102, 103}
    assert kept[1] == plain | {102, 103}
    assert kept[2] == kept[3] == kept[4] == plain | {103}
    assert "<EMAIL>" in masked[103] and "<PHONE>" in masked[103] and "example.com" not in masked[103]
    assert all(masked[i] == texts[i] for i in plain)

    import tiktoken

    from klangwerk.llm.bpe_ranks import read_ranks

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in docs.collect():
        assert list(r.ids) == enc.encode_ordinary(masked[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.text_sha256 == hashlib.sha256(masked[r.doc_id].encode()).hexdigest()


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
