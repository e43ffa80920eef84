"""The pipeline, each stage on what the one before kept."""

from collections import Counter

import corpus_pipeline
from tests.llm.conftest import NONBLANK, SMALL, words
from tests.llm.test_operators import classes, hits, jump


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    states = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        states.append(stage(spark, states[-1], SMALL).cache())
        assert states[-1].columns == columns
    last = corpus_pipeline.STAGES[-1][1](spark, states[-1], SMALL).collect()
    ids = [Counter(r.doc_id for r in s.collect()) for s in states]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    gone = set(ids[0]) - set(ids[1])
    # eleven toxic rows teach little; clean documents still stay
    assert sum(labels.get(i) == 0 for i in gone) <= 0.05 * sum(v == 0 for v in labels.values())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(ids[2]) == {i for i, (_, _, kept) in classes([(i, texts[i]) for i in ids[1]], 80).items() if kept}
    windows = {}
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(r.text)
        for j in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(r.item_id)
    assert set(ids[3]) == {i for i in ids[2] if not hits(texts[i], windows)[4]}
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) <= 2
    size = lambda c: sum(n * len(words(texts[i], NONBLANK)) for i, n in c.items())
    assert abs(size(ids[4]) / size(ids[3]) - 1.5) < 0.15
    assert Counter(r.doc_id for r in last) == ids[4]
    assert all(r.text == texts[r.doc_id] for r in last) and {*columns} <= {*last[0].asDict()}
    assert all(r.shard == jump(r.doc_id, 40) for r in last)
