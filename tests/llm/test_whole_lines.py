from __future__ import annotations

import corpus_pipeline
from lodestone.llm import entry


def test_copies_of_short_lines_go_from_the_queries(spark, docs, tmp_path):
    texts = ["kept\nA. b\n\n  \nsame here once", "A. b\n\n  \nsame here, once\nA. c", "A. b\nonly this"]
    docs(*texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = entry.op4_line_dedup(spark, str(tmp_path)).collect()
    want = {(1, 0, 0, 1, False), (2, 0, 0, 1, False), (1, 3, 0, 4, True)}
    assert {(r.doc_id, r.line_no, r.like_doc, r.like_line, r.edits_apart) for r in rows} == want
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs(*texts), str(tmp_path)).collect()}
    assert kept == {0: texts[0], 1: "\n  \nA. c", 2: "only this"}
