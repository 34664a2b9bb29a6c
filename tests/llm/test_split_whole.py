"""p9_found cuts its documents whole, as p9_pieces does."""

from loomlog.llm import queries, split


def test_found_documents_are_cut_to_their_end(spark, tmp_path, monkeypatch):
    long = "".join(f"Sentence {i} of a long text. " for i in range(3000))
    rows = [(1, long), (2, "x " * 2000 + "\n\n" + long), (3, "y " * 1500), (4, "short"), (5, ""), (6, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made, real = [], split.split_documents
    monkeypatch.setattr(split, "split_documents", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    assert sorted(r["doc_id"] for r in queries.p9_found(spark, str(tmp_path)).collect()) == [1, 2]
    pieces = sorted((r["doc_id"], r["piece_no"], r["start"], r["end"], r["text"]) for r in made[0].collect())
    texts = dict(rows)
    for doc in (1, 2):
        own = [p for p in pieces if p[0] == doc]
        assert len(own) > 5 and own[0][2] == 0 and own[-1][3] == len(texts[doc])  # to the end, not its beginning only
        assert all(x[2] < y[2] <= x[3] < y[3] for x, y in zip(own, own[1:]))
        assert all(text == texts[doc][a:e] for _, _, a, e, text in own)
    assert {p[0] for p in pieces} == {1, 2}
