"""The pipeline's stages against what their operators say of each document."""

import corpus_pipeline
from tallyweave.llm.common import read, stored
from tallyweave.llm.decontamination import Windows, benchmark_items
from tests.llm.test_near_copies import slow_pairs


def test_stages_decide_on_all_they_get(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stored(stage(spark, kept[-1], sf_dir), name))
        assert kept[-1].columns == columns
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    # Near copies: of each group linked by a five-word Jaccard of 0.8 or more the smallest id is left.
    rows = sorted((r["doc_id"], r["text"]) for r in kept[2].select("doc_id", "text").collect())
    label = list(range(len(rows)))
    for a, b in sorted(slow_pairs([t for _, t in rows])) * 8:
        label[a] = label[b] = min(label[a], label[b])
    assert ids[3] == {rows[k][0] for k in label}
    windows = Windows(benchmark_items(read(spark, sf_dir, "benchmark")))
    assert ids[4] == {r["doc_id"] for r in kept[3].collect() if not windows.find(r["text"])[1]}
    last = corpus_pipeline.STAGES[-1][1](spark, kept[-1], sf_dir)
    assert {r["doc_id"] for r in last.where("n_tokens > 0").collect()} == ids[4]
