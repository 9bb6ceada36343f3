"""The pipeline on a small corpus, against plain versions of all its stages."""

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import numpy as np  # noqa: E402
from test_text import Library, edited, plain_languages, plain_overlaps, plain_redaction, plain_spans, prose  # noqa: E402

from wavelode.llm import text_dedup  # noqa: E402
from wavelode.llm.shared import new_path, write_table  # noqa: E402


def plain_stages(rows, items):
    """Documents (id, text) after each stage, by loops."""
    after = {}
    found = plain_languages([(r[0], r[1], r[2]) for r in rows])
    rows = [(r[0], r[1]) for r, (lang, share) in zip(rows, found, strict=True) if lang != "und" and share >= corpus_pipeline.LEAST_SCORE]
    after["language_id"] = list(rows)
    sets = [set(text_dedup.shingles(t).tolist()) for _, t in rows]
    near = {i: i for i in range(len(rows))}
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    near[i] = near[j] = min(near[i], near[j])
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[near[i]] = min(least.get(near[i], doc_id), doc_id)
    rows = sorted({r for i, r in enumerate(rows) if least[near[i]] == r[0]})
    after["near_dedup"] = list(rows)
    bad = {d for d, _ in plain_overlaps(rows, items)}
    rows = [r for r in rows if r[0] not in bad]
    after["decontamination"] = list(rows)
    after["secrets"] = [(i, plain_redaction(t, plain_spans(t))) for i, t in rows]
    return after


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    item = prose(5000, 40)
    rows = [(i, prose(i), "en", "s", len(prose(i))) for i in range(30)]
    rows += [(40, prose(3), "en", "s", 1), (41, edited(prose(4), 1, 1), "en", "s", 1), (42, prose(77) + " " + item, "en", "s", 1), (43, "12345 678", "en", "s", 9), (44, prose(78) + " password=abcdef0123456789ab", "en", "s", 1), (45, None, None, None, None), (46, "", None, None, None)]
    rows += [rows[5], rows[5], (47, prose(79, 3000), None, "s", 1)]
    # One word in the middle of 80 and of 72 words changes five shingles: near at 80 per cent and not at 90.
    rows += [(48, edited(prose(6, 55), 3, 1), "en", "s", 1), (49, prose(6, 55), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs.write.parquet(f"{path}/documents.parquet")
    return path, docs, rows, plain_stages(rows, [(1, item)])


def test_stages_and_run_equal_plain_versions(spark, corpus):
    path, docs, rows, plain = corpus
    now = docs
    for name, step in corpus_pipeline.STAGES:
        now = write_table(step(spark, now, path), new_path(spark, name))
        if name != "packing":
            assert now.columns == docs.columns
            assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted(plain[name]), name
        if name == "secrets":
            assert all(r.n_chars == len(r.text) for r in now.where("doc_id = 44").collect())
    assert 0 < len(plain["decontamination"]) < len(plain["near_dedup"]) < len(plain["language_id"]) < len(rows)
    out, tool = corpus_pipeline.run(spark, path).toPandas(), Library("byte_bpe_50k.json")
    whole = out.sort_values("piece").groupby("doc_id").ids.agg(lambda x: b"".join(map(bytes, x))).to_dict()
    assert whole == {i: tool.encode(t) + np.array([0], "<u4").tobytes() for i, t in plain["secrets"]}
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all() and out.groupby("sequence_id").length.sum().max() <= 2048


def test_clashing_columns_and_empty_tables(spark, corpus):
    path, docs, rows, plain = corpus
    names = ["doc_id", "text", "lang", "findings", "n_chars", "a.b", "Score", "blob", "LANG_PRED", "_kept"]
    more = docs.toDF(*names[:5]).selectExpr("*", "1 as `a.b`", "2.0 as Score", "'x' as blob", "'y' as LANG_PRED", "0 as _kept")
    for start, left in ((more, len(plain["secrets"])), (more.limit(0), 0)):
        now = start
        for name, step in corpus_pipeline.STAGES[:-1]:
            now = write_table(step(spark, now, path), new_path(spark, name))
            assert now.columns == names
        assert now.count() == left
    assert corpus_pipeline.STAGES[-1][1](spark, now, path).count() == 0
