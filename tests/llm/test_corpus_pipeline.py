"""The pipeline's stages on the small tables and on awkward rows, each against plain Python."""

import re

import pyarrow.parquet as pq
import pytest
import sentencepiece

import corpus_pipeline
from spindleflow.llm.common import staged, tokenizer_path


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = staged(stage(spark, docs, sf), "test-stage")
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else {b""}


def test_all_but_the_last_keep_the_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert 4 <= len(names) <= 5
    for name in names[:-1]:
        assert stages[name].columns == stages["input"].columns


def test_toxic_documents_go_and_clean_ones_stay(stages, sf):
    kept = texts(stages["toxicity"])
    marked = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    assert set(kept) < set(texts(stages["input"]))
    clean = [k for k, toxic in marked.items() if not toxic]
    assert sum(k in kept for k in clean) >= 0.95 * len(clean)


def test_one_of_each_group_stays(stages):
    before, after = texts(stages["toxicity"]), texts(stages["near copies"])
    sets = {k: shingles(t) for k, t in before.items()}
    likes = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    keys = sorted(before)
    for a in keys:
        for b in keys:
            if a < b and likes(a, b) >= 0.95:
                assert not (a in after and b in after)
    for gone in set(before) - set(after):
        assert max(likes(gone, k) for k in keys if k != gone) >= 0.7


def test_secrets_are_hidden(stages):
    before, after = texts(stages["near copies"]), texts(stages["secrets"])
    assert set(before) == set(after)
    changed = [k for k in after if after[k] != before[k]]
    hard = re.compile(r"[0-9a-f]{16,}|AKIA[A-Z0-9]{14,}")
    assert all(not hard.search(t) for t in after.values())
    assert all(hard.search(before[k]) or re.search(r"(?i)passw|secret|token|api_?key|[A-Za-z0-9+/_-]{16}", before[k]) for k in changed)
    assert all(r.n_chars == len(r.text) for r in stages["secrets"].collect())


def test_the_mix_repeats_documents_within_the_limit(stages):
    before, after = stages["secrets"].collect(), stages["mix"].collect()
    known = {r.doc_id: r.text for r in before}
    times = {}
    for r in after:
        assert known[r.doc_id] == r.text
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 2
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t))
    assert sum(size(r.text) for r in after) == pytest.approx(1.5 * sum(size(r.text) for r in before), rel=0.1)


def test_the_last_stage_encodes(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    known = {r.doc_id: r.text for r in stages["mix"].collect()}
    for r in stages["pieces"].collect():
        assert r.piece_ids == library.encode(known[r.doc_id])


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    rows = [(1, "one two three", "en", "a", 13), (2, None, None, None, None), (3, "", "en", None, 0), (4, "one two three", "en", "a", 13), (4, "one two three", "en", "a", 13), (None, "no id", "en", "b", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in found} <= {1, 2, 3, None}
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
