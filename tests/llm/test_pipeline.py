"""The pipeline's stages against plain versions of what they do."""

import collections

import pytest
from tests.llm.helpers import SCHEMA, WORD, corpus, table
from tests.llm.test_filters import plain_groups, plain_lines, plain_measures
from tests.llm.test_shaping import check_packing

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [r for r in corpus(20, 80) if r[0] not in (None, 4, 5, 104)]
    table(spark, rows).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_stages_do_what_they_say(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near duplicates", "mixing", "packing"]

    def run(name, docs):
        out = stages[name](spark, docs, path)
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
        return corpus_pipeline.materialize(out)

    kept = run("quality rules", docs)
    assert collections.Counter(rows_of(kept)) == collections.Counter(r for r in rows if plain_measures(r[1])[-1])
    lines = run("line dedup", kept)
    assert collections.Counter((r[0], r[1]) for r in rows_of(lines)) == collections.Counter({(d, t): n for (d, _, _, t), n in plain_lines(rows_of(kept)).items()})
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    single = run("near duplicates", lines)
    groups = plain_groups([r for r in rows_of(lines) if WORD.search(r[1])])
    assert sorted(r[0] for r in rows_of(single) if WORD.search(r[1])) == sorted({c for _, _, c in groups})
    mixed = run("mixing", single)
    texts = {r[0]: r[1] for r in rows_of(single)}
    taken = collections.Counter()
    for doc, text, _, source in rows_of(mixed):
        assert texts[doc].startswith(text)
        taken[source] += len(WORD.findall(text))
    sizes = collections.Counter()
    for _, text, _, source in rows_of(single):
        sizes[source] += len(WORD.findall(text))
    assert all(taken[s] <= 2 * n for s, n in sizes.items())
    assert 1.5 * sum(sizes.values()) - len(sizes) <= sum(taken.values()) <= 1.5 * sum(sizes.values())
    packed = run("packing", mixed)
    check_packing(rows_of(mixed), packed.collect(), 2048)


def test_run_equals_the_stages_in_turn(spark, folder):
    path, _ = folder
    once = collections.Counter((r.doc_id, r.piece, r.n_words) for r in corpus_pipeline.run(spark, path).collect())
    again = collections.Counter((r.doc_id, r.piece, r.n_words) for r in corpus_pipeline.run(spark, path).collect())
    assert once == again and once


def test_an_empty_table_runs_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
