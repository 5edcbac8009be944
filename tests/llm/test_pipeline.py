"""The corpus pipeline, stage by stage, against plain versions on a small corpus."""

import corpus_pipeline
from folio.llm import queries
from tests.llm.conftest import prose
from tests.llm.test_near_duplicates import plain_components, plain_near, plain_wide_fingerprint
from tests.llm.test_scoring import junk


def corpus():
    texts = [prose(i, 120) for i in range(60)] + [junk(i, 120) for i in range(60, 100)]
    texts += [texts[0], texts[1], texts[1] + " and more"]
    texts += [prose(200, 60) + " " + prose(700, 30), prose(201, 80) + " password=hunter2hunter2 " + prose(202, 40), None, ""]
    return texts


def test_stages(spark, docs_of, save):
    texts = corpus()
    docs = docs_of(texts)
    at = save(documents=docs, benchmark=spark.createDataFrame([(1, prose(700, 30))], "item_id long, text string"), labels=spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)], "doc_id long, quality int, toxic int"))
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dups", "benchmark", "secrets", "mix"]
    kept = stages["quality"](spark, docs, at)
    scores = {r["doc_id"]: r["predicted"] for r in queries.op6_quality(spark, at).collect()}
    assert ids(kept) == sorted(i for i, p in scores.items() if p) and kept.schema == docs.schema
    assert not set(ids(kept)) & set(range(60, 100)) and set(range(60)) <= set(ids(kept))
    fps = [plain_wide_fingerprint(t) for t in texts]
    roots = plain_components(len(texts), lambda a, b: plain_near(fps[a], fps[b]))
    deduped = stages["near_dups"](spark, docs, at)
    assert ids(deduped) == sorted(set(roots)) and deduped.schema == docs.schema
    clean = stages["benchmark"](spark, docs, at)
    assert ids(clean) == [i for i in range(len(texts)) if i != 103] and clean.schema == docs.schema
    redacted = {r["doc_id"]: r["text"] for r in stages["secrets"](spark, docs, at).collect()}
    assert redacted[104] == texts[104].replace("password=hunter2hunter2", "[assign]") and all(redacted[i] == texts[i] for i in range(len(texts)) if i != 104)
    mixed = stages["mix"](spark, docs, at)
    assert mixed.columns == [*docs.columns, "taken"] and all(r["taken"] > 0 for r in mixed.collect())
    final = corpus_pipeline.run(spark, at)
    assert set(ids(final)) <= set(range(60)) | {104} and ids(final) == ids(corpus_pipeline.run(spark, at))


def test_empty_corpus(spark, docs_of, save):
    at = save(documents=docs_of(["x"]).limit(0), benchmark=spark.createDataFrame([], "item_id long, text string"), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, at).count() == 0
