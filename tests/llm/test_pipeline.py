import collections
import re

import corpus_pipeline
from geoloom.llm.store import written


def test_stages_hold_what_they_promise(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    rows = docs.collect()
    texts = [bytes(c + 32 if 65 <= c <= 90 else c for c in r.text.encode()) for r in rows]
    assert len(set(texts)) == len(texts)
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    where = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    for k, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in where[x] if j < k)
        assert all(100 * n < 80 * (len(s) + len(sets[j]) - n) for j, n in common.items())
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(f" {i} " in " " + " ".join(re.findall(r"\w+", r.text.lower())) + " " for r in rows for i in items)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(r.doc_id for r in rows)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
