"""The stages, each on its own input, and their registration."""

import importlib

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    top = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(str(top / str(k)))
        after = spark.read.parquet(str(top / str(k)))
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name
    assert [n for n, _, _ in stages] == ["quality", "language", "near_duplicates", "mix", "pieces"]


def test_quality_stage_keeps_the_good(spark, stages):
    _, before, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    mine = [r.doc_id for r in before.collect() if r.doc_id in labels]
    assert sum((d in kept) == (labels[d] == 1) for d in mine) >= 0.95 * len(mine)


def test_language_stage_keeps_what_has_a_language(stages):
    _, before, after = stages[1]
    assert after.count() >= 0.98 * before.count()


def test_near_duplicate_stage_is_brute_force(stages):
    from pagewright.llm.jaccard_tgm import shingles

    _, before, after = stages[2]
    rows = sorted((r.doc_id, set(shingles(r.text).tolist())) for r in before.collect())
    kept = {r.doc_id for r in after.collect()}
    near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    group = {}
    for k, (d, s) in enumerate(rows):
        group[d] = d
        for e, t in rows[:k]:
            if s and t and near(s, t):
                a, b = group[d], group[e]
                group = {x: min(a, b) if g in (a, b) else g for x, g in group.items()}
    assert kept == {d for d, g in group.items() if d == g}


def test_mix_stage_takes_what_the_operator_decides(stages):
    from pagewright.llm import mixing

    _, before, after = stages[3]
    assert after.count() == sum(r.copies for r in mixing.mix(before)[0].collect())


def test_pieces_stage_covers_every_row(stages):
    _, before, after = stages[4]
    assert after.count() == before.count() and after.where("not round_trip").count() == 0


def test_registered_names():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
    assert set(e.oracle_sql()) <= names


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(importlib.import_module("pagewright").__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert ".llm" not in p.read_text(), p
