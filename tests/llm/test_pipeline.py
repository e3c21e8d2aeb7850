import corpus_pipeline as p
import pyarrow.parquet as pq

from . import test_decontaminate, test_minhash, test_native, test_quality
from tabloom.llm.common import table, written


def test_stages_take_effect(spark, sf):
    names = [n for n, _ in p.STAGES]
    assert names == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE"]
    docs = table(spark, sf, "documents")
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    items = test_decontaminate.pairs(f"{sf}/benchmark.parquet", "item_id", "text")
    step = docs
    kept = []
    for name, stage in p.STAGES[:-1]:
        step = written(stage(spark, step, sf), "stage")
        assert step.dtypes == docs.dtypes
        kept.append({r.doc_id: r.text for r in step.collect()})
    # quality: no line is above the limits in so small a table
    good = [(r["doc_id"], r["text"]) for r in rows if not test_quality.brute(r["text"])[5]]
    assert kept[0] == dict(good)
    single = [(i, t) for (i, t), b in zip(good, test_minhash.brute(good, 5)) if b[3]]
    assert kept[1] == dict(single)
    clean = {r[0] for r in test_decontaminate.brute(single, items) if not r[5]}
    assert set(kept[2]) == clean
    assert set(kept[3]) == clean
    assert not any(any(test_native.brute_secrets(t)[:3]) for t in kept[3].values())
    last = {r.doc_id: r for r in p.STAGES[-1][1](spark, step, sf).collect()}
    assert set(last) == clean
    import hashlib
    assert all(r.decoded_sha256 == hashlib.sha256(kept[3][i].encode()).hexdigest() for i, r in last.items())
    assert p.run(spark, sf).count() == len(clean)


def test_empty_and_hard_rows(spark, make_docs, hard_rows, sf):
    for docs in (make_docs(hard_rows), make_docs(hard_rows).limit(0)):
        for _, stage in p.STAGES:
            docs = stage(spark, docs, sf)
        docs.collect()
