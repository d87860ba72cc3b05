import hashlib
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from llm_helpers import brute_components
from rollbook.llm import mixing, quality
from rollbook.llm.common import table
from test_lines import brute

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """The documents, and what every stage returns, written and read again."""
    out = [table(spark, DIR, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_are_the_dealt_ones(spark, outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "bpe"]
    assert all(o.columns == outputs[0].columns for o in outputs[1:-1])
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_quality_drops_what_scores_low(spark, outputs):
    docs = outputs[0]
    scores = quality.score(docs, quality.fit(docs, table(spark, DIR, "labels"))).collect()
    assert set(rows(outputs[1])) == {r.doc_id for r in scores if r.predicted}
    good = {r.doc_id for r in table(spark, DIR, "labels").where("quality = 1").collect()}
    assert len(good - set(rows(outputs[1]))) <= 0.02 * len(good)


def test_lines_are_cut(outputs):
    expected = {i: t for i, t, *_ in brute([(r.doc_id, r.text) for r in outputs[1].collect()])}
    got = rows(outputs[2])
    assert {i: r.text for i, r in got.items()} == expected
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_one_document_of_each_group_stays(outputs):
    components = brute_components([(r.doc_id, r.text) for r in outputs[2].collect()], 5, 80)
    assert set(rows(outputs[3])) == {c for _, c in components.values()}


def test_mix_keeps_and_orders(spark, outputs):
    placed = mixing.place(outputs[3]).orderBy("__slot", "__place").select("doc_id").collect()
    files = [r.doc_id for r in outputs[4].select("doc_id").collect()]
    assert sorted(files) == sorted(rows(outputs[3]))
    assert [r.doc_id for r in corpus_pipeline._mix(spark, outputs[3], DIR).select("doc_id").collect()] == [r.doc_id for r in placed]


def test_bpe_and_run(spark, outputs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in outputs[4].collect()}
    got = rows(outputs[5])
    assert set(got) == set(texts)
    for i, r in got.items():
        ids = t.encode(texts[i], add_special_tokens=False).ids
        assert (r.n_tokens, bytes(r.ids)) == (len(ids), struct.pack(f"<{len(ids)}I", *ids))
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {(r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, DIR).collect()} == {(i, bytes(r.ids)) for i, r in got.items()}


def test_odd_rows_and_empty_table(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DIR)
            if name != "bpe":
                assert out.columns == docs.columns, name
            if name in ("line_dedup", "mix", "bpe"):
                assert out.count() == docs.count(), name
            else:
                assert out.count() <= docs.count(), name


def test_the_schedule_reaches_the_result(spark, odd, empty, docs):
    """Whatever order the last stage's rows come in."""
    expected = [(r["__slot"], r["__place"], r.doc_id) for r in mixing.place(docs).orderBy("__slot", "__place").select("__slot", "__place", "doc_id").collect()]
    out = corpus_pipeline._bpe(spark, docs.orderBy("n_chars"), DIR)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256", "slot", "place"]
    assert [(r.slot, r.place, r.doc_id) for r in out.collect()] == expected
    assert corpus_pipeline._bpe(spark, odd, DIR).select("slot", "place").distinct().count() == odd.count()
    assert corpus_pipeline._bpe(spark, empty, DIR).count() == 0
