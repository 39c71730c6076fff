import hashlib

import numpy as np

import corpus_pipeline
from paywarden.llm.queries import tokenizer_path
from tests.conftest import SF
from tests.llm.conftest import edge_rows
from tests.llm.test_lines import replay
from tests.llm.test_near import plain_classes, plain_matches


def test_run_equals_the_stages_replayed(spark):
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    assert all(d.lang for d in docs)                       # nothing here is rejected, see test_classifiers
    cut = replay([(d.doc_id, d.source, d.text) for d in docs], 0.1, 5)
    texts = [(i, t) for i, _, t in cut]
    classes = plain_classes(texts)
    kept = [(i, t) for i, t in texts if classes[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, _ in plain_matches(kept, items)}
    library = Tokenizer.from_file(tokenizer_path())
    want = {i: hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, t in kept if i not in bad}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_on_edge_rows(spark, edge, empty):
    for name, stage in corpus_pipeline.STAGES:
        for docs, most in ((edge, len(edge_rows())), (empty, 0)):
            out = stage(spark, docs, SF)
            if name != "tokens":
                assert out.columns == corpus_pipeline.COLUMNS
            assert out.count() <= most
