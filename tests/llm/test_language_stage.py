from __future__ import annotations

import corpus_pipeline


def test_texts_that_share_nothing_with_a_language_go(spark, docs):
    table = docs("hello there and hello again", "жжж", "12").selectExpr("*", "if(doc_id = 0, 'en', null) AS told").drop("lang").withColumnRenamed("told", "lang")
    kept = corpus_pipeline.language(spark, table, "")
    assert {r.doc_id for r in kept.collect()} == {0} and kept.columns == table.columns


def test_texts_in_no_learned_language_go(spark, docs):
    english = ["the quick brown fox jumps over the lazy dog and the other dogs", "this is the language of the other texts and of this one"]
    foreign = ["он пришёл домой и сел за стол", "ζζ ηη θθ the ιι κκ λλ μμ νν ξξ οο ππ", "三 四 五"]
    table = docs(*english, *foreign).selectExpr("*", "if(doc_id < 2, 'en', null) AS told").drop("lang").withColumnRenamed("told", "lang")
    assert {r.doc_id for r in corpus_pipeline.language(spark, table, "").collect()} == {0, 1}
