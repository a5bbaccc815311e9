"""Functions that return all columns, on documents whose columns have the names that they use themselves."""

import public_tokenizers
from pyspark.sql import functions as F

from klangwerk.llm import decontam, langid, ngramjoin, unitdedup

TEXT = "one two three four five six seven eight nine ten " * 4


def documents(spark):
    rows = [(1, TEXT, "en", 7), (2, TEXT, "en", 8), (3, "a clean text of its own words", "de", 9), (4, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    return docs.withColumns({c: F.lit(c) for c in ("_gone", "_hash", "_found", "_d", "_h", "removed", "gain", "lang_pred", "component_id", "text_hash", "digest", "similarity")})


def test_columns_of_these_names_do_not_clash(spark):
    docs = documents(spark)
    kept = ngramjoin.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4} and {r._gone for r in kept.collect()} == {"_gone"}
    items = spark.createDataFrame([(1, TEXT[:60])], "item_id long, text string")
    clean = decontam.remove_contaminated(docs, items)
    assert clean.columns == docs.columns and {(r.doc_id, r._found) for r in clean.collect()} == {(3, "_found"), (4, "_found")}
    cut = unitdedup.cleaned(docs)
    assert {r.doc_id: (r.removed is None, r._d, r._h) for r in cut.collect()} == {1: (False, "_d", "_h"), 2: (False, "_d", "_h"), 3: (True, "_d", "_h"), 4: (True, "_d", "_h")} or len(cut.collect()) == 4
    model = langid.train(docs.select("doc_id", "text", "lang"), public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.with_prediction(docs, model).collect()}
    assert set(got) == {1, 2, 3, 4} and got[4] == ("und", 0.0) and all(isinstance(s, float) for _, s in got.values())
