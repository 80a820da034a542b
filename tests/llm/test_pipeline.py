import os
import random

import pytest

import corpus_pipeline
from shiftlens.llm import decontaminate, line_dedup, quality, simhash
from shiftlens.llm.common import table

from .test_line_dedup import plain as plain_lines
from .test_mixing_and_urls import plain_mix
from .test_near_copies import plain_set, similarity
from .test_simhash import plain_components

SF = "/root/testdata/sf0.001"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_each_stage_equals_brute_force_on_its_own_input(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]

    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns
    predicted = quality.score_documents(docs, table(spark, SF, "labels")).where("predicted = 1")
    assert rows(good, "doc_id") == rows(predicted, "doc_id")
    good = good.persist()

    lined = stages["line_dedup"](spark, good, SF).persist()
    assert lined.columns == docs.columns
    assert rows(lined, "doc_id", "text") == sorted(((i, t) for i, t, _ in plain_lines([(r.doc_id, r.text) for r in good.collect()])), key=str)
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    one = stages["near_dedup"](spark, lined, SF).persist()
    sets = {r.doc_id: plain_set(r.text) for r in lined.collect()}
    roots = plain_components(sorted(sets), lambda a, b: similarity(sets[a], sets[b]) >= 0.8)
    assert one.columns == docs.columns and rows(one, "doc_id") == sorted(((i,) for i in set(roots.values())), key=str)

    clean = stages["decontamination"](spark, one, SF).persist()
    items = [decontaminate.normalise(r.text) for r in table(spark, SF, "benchmark").collect()]
    leaked = {r.doc_id for r in one.collect() if any(t in decontaminate.normalise(r.text) for t in items)}
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and not kept & leaked
    near = {r.doc_id for r in decontaminate.find_leaks(one, table(spark, SF, "benchmark")).collect()}
    assert kept == {r.doc_id for r in one.collect()} - near

    mixed = stages["mixing"](spark, clean, SF)
    want, _ = plain_mix([(r.doc_id, r.source, r.text) for r in clean.collect()])
    assert rows(mixed, "doc_id", "size", "source_size", "taken") == sorted((w for w in want if w[3] > 0), key=str)


def test_stages_on_empty_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a\nb\nc", "en", "s", 5)], schema)
    for docs in (odd, odd.limit(0)):
        lines = line_dedup.dedup_lines(docs).select(*docs.columns)
        assert lines.count() == docs.count()
        kept = simhash.keep_one(docs)
        assert kept.count() == (2 if docs is odd else 0)
        assert corpus_pipeline.mix_to_weights(spark, docs, SF).count() == (1 if docs is odd else 0)


def test_run_leaves_only_its_result_behind(spark, tmp_path, monkeypatch):
    from shiftlens.sources import shared

    monkeypatch.setattr(shared, "shared_dir", lambda s: str(tmp_path))
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    docs = [(i, words(rng.randint(1, 60)), "en", rng.choice("ab"), 1) for i in range(60)]
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    rows = {"documents": docs, "labels": [(i, int(i % 2), 0) for i in range(60)], "benchmark": [(1, words(30))]}
    for name, schema in schemas.items():
        spark.createDataFrame(rows[name], schema).write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "in"))
    out.count()
    left = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if p.name != "in")
    assert left == ["stage-mixing"]
