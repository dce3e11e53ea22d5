"""The pipeline's stages against what the operators' brute-force versions say."""

import corpus_pipeline
from tessera.llm import secret_scan, toxicity
from tessera.llm.shared import table

from .test_operators import brute_groups, brute_lines


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "secrets", "packing"]
    clean = stages["toxicity"](spark, docs, sf)
    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf, "labels"))).collect()}
    assert texts(clean) == [x for x in texts(docs) if not scores[x[0]]]
    lines = stages["line_dedup"](spark, clean, sf)
    assert texts(lines) == sorted((d, t) for d, _, _, t in brute_lines(texts(clean)))
    one = stages["near_dedup"](spark, lines, sf)
    kept = {d for d, _, _, k in brute_groups(texts(lines), 5) if k}
    assert texts(one) == [x for x in texts(lines) if x[0] in kept]
    masked = stages["secrets"](spark, one, sf)
    assert masked.columns == docs.columns
    assert all(not [s for s in spans if s.kind != "assign"] for (spans,) in secret_scan.scan_documents(masked).select("spans").collect())
    pieces = stages["packing"](spark, masked, sf)
    whole = pieces.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect()
    assert {r.doc_id for r in whole} == {d for d, _ in texts(masked)} and all(r.doc_tokens == r["sum(length)"] for r in whole)


def test_stages_on_odd_and_empty_tables(spark, sf, odd, none):
    for docs, rows in ((odd, 15), (none, 0)):
        held, counts = docs, []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            held = stage(spark, held, sf)
            assert held.columns == docs.columns
            counts.append(held.count())
        texts = lambda df: [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        lines = [(d, t) for d, _, _, t in brute_lines(texts(docs))]
        assert counts[:2] == [rows, rows] and counts[2] == counts[3] == sum(k for *_, k in brute_groups(lines, 5))
        pieces = corpus_pipeline.STAGES[-1][1](spark, held, sf)
        assert sum(r.start == 0 for r in pieces.collect()) == counts[3]


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
