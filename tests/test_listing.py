"""Pushed predicates of the listing source, and how folders are dealt."""

import os

import pytest
from pyspark.sql import functions as F

from pagewright.operators import search
from pagewright.sources import files


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for k in range(60):
        folder = top / f"d{k % 4}" / f"e{k % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{'report' if k % 2 else 'note'}_{k:02d}.{'pdf' if k % 5 else 'PDF'}").write_bytes(b"x" * (k * 10))
    (top / ".hidden.pdf").write_bytes(b"1")
    (top / "_empty.pdf").write_bytes(b"")
    os.symlink(top / "d0", top / "link")
    os.symlink(top / "nowhere", top / "broken.pdf")
    return str(top)


def everything(tree):
    out = []
    for folder, _, names in os.walk(tree):
        out += [(os.path.join(folder, n), n, os.stat(os.path.join(folder, n)).st_size) for n in names if os.path.exists(os.path.join(folder, n)) and not os.path.isdir(os.path.join(folder, n))]
    return out


CONDITIONS = {
    "size > 100 and size <= 400": lambda p, n, s: 100 < s <= 400, "name like 'report%' and name like '%.pdf'": lambda p, n, s: n.startswith("report") and n.endswith(".pdf"),
    "name in ('note_00.PDF', 'report_01.pdf')": lambda p, n, s: n in ("note_00.PDF", "report_01.pdf"), "not (name like '%.pdf') and size >= 10": lambda p, n, s: not n.endswith(".pdf") and s >= 10,
    "name like '%rep%' or size = 0": lambda p, n, s: "rep" in n or s == 0, "is_dir": lambda p, n, s: False, "size <=> 10 and name is not null": lambda p, n, s: s == 10, "name < 'note_30'": lambda p, n, s: n < "note_30",
    "size = 10 and lower(name) like 'report%'": lambda p, n, s: s == 10 and n.startswith("report"),
}


@pytest.mark.parametrize("condition", CONDITIONS)
def test_predicates_give_the_same_rows(spark, tree, condition):
    got = sorted(r.path for r in files.listing(spark, tree).where(condition).collect())
    assert got == sorted(p for p, n, s in everything(tree) if CONDITIONS[condition](p, n, s))


def test_folders_are_pruned_by_path(spark, tree):
    for prefix in (f"{tree}/d1/e1/", f"{tree}/d1", f"{tree}/", f"{tree}/zzz"):
        got = sorted(r.path for r in files.listing(spark, tree).where(F.col("path").startswith(prefix)).collect())
        assert got == sorted(p for p, _, _ in everything(tree) if p.startswith(prefix))
    reader = files.ListingReader(tree, True)
    reader.conditions = [files.Condition.of(files.StringStartsWith(("path",), f"{tree}/d1/e1/"))]
    assert [p.path for p in reader.partitions()] == [tree, f"{tree}/d1", f"{tree}/d1/e1"]
    one = next(p for p, n, _ in everything(tree) if n == "report_01.pdf")
    assert files.listing(spark, tree).where(F.col("path") == one).count() == 1


def test_what_a_source_can_take_leaves_the_plan(spark, tree):
    listed = files.readable(files.listing(spark, tree), 300)
    plan = search.search_pattern(listed, "report_*.pdf", 300)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("BatchScan")[0]
    assert "size" not in above.replace("size#", "size") or "> 0" not in above  # only the pattern itself is left to Spark
    assert "StartsWith" not in above and "EndsWith(name" not in above and "RLIKE" in above
    untouched = []
    reader = files.ListingReader(tree, False)
    rest = list(reader.pushFilters([files.StringStartsWith(("name",), "report"), files.GreaterThan(("modified_time",), 0), files.Not(files.EqualTo(("size",), 0))]))
    assert [type(f) for f in rest] == [files.GreaterThan] and len(reader.conditions) == 2
    real, os.stat = os.stat, lambda p, **k: (untouched.append(p), real(p, **k))[1]
    try:
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    finally:
        os.stat = real
    asked = [p for p in untouched if p.startswith(tree)]
    assert len(rows) == 30 and all(os.path.basename(p).startswith("report") for p in asked)  # no look at files that the name rules out


def test_large_folders_are_several_tasks(spark, tmp_path, monkeypatch):
    names = {f"f{k:04d}.pdf" for k in range(1000)}
    for n in names:
        (tmp_path / n).touch()
    monkeypatch.setattr(files, "ENTRIES", 100)
    monkeypatch.setattr(files, "BATCH", 64)
    reader = files.ListingReader(str(tmp_path), True)
    parts = reader.partitions()
    shares = [[r for b in reader.read(p) for r in b.to_pylist()] for p in parts]
    assert len(parts) == 10 and all(50 < len(s) < 200 for s in shares)
    assert sorted(r["name"] for s in shares for r in s if not r["is_dir"]) == sorted(names) and sum(r["is_dir"] for s in shares for r in s) == 1
    assert files.listing(spark, str(tmp_path)).count() == 1000


def test_directories_are_listed_on_request(spark, tree):
    got = sorted(r.path for r in files.listing(spark, tree, dirs=True).where("is_dir").collect())
    assert got == sorted(folder for folder, _, _ in os.walk(tree))


def test_folders_by_uri(spark, tree):
    uri = f"file://{tree}"
    plain = {(r.path, r.name, r.size, r.modified_time) for r in files.listing(spark, tree).collect()}
    found = {(r.path, r.name, r.size, r.modified_time) for r in files.listing(spark, uri).collect()}
    linked = {p for p in (r[0] for r in found) if p.startswith(f"{uri}/link/")}  # a store does not tell links from folders
    assert {(p.removeprefix("file://"), n, s) for p, n, s, _ in found if p not in linked} == {(p, n, s) for p, n, s, _ in plain}
    some = files.listing(spark, uri).where(F.col("path").startswith(f"{uri}/d2/") & (F.col("size") > 100))
    assert sorted(r.path for r in some.collect()) == sorted(f"file://{p}" for p, n, s, _ in plain if p.startswith(f"{tree}/d2/") and s > 100)
    contents = {r.path: len(r.content) for r in files.content_of(some).collect()}
    assert contents == {f"file://{p}": s for p, n, s, _ in plain if p.startswith(f"{tree}/d2/") and s > 100}
    with pytest.raises(FileNotFoundError):
        files.listing(spark, f"{uri}/nowhere")


def test_contents_are_dealt_by_the_number_of_files(spark, tree):
    """A folder's files are one task of the listing, but not one of their contents."""
    some = files.listing(spark, f"{tree}/d2").where("size > 0")
    assert some.count() == 15 and some.rdd.getNumPartitions() < 5
    dealt = files.dealt(some, 3)
    assert dealt.rdd.getNumPartitions() == 5 and len([x for x in dealt.rdd.glom().collect() if x]) > 2
    sizes = lambda df: sorted((r.path, len(r.content)) for r in files.content_of(df).collect())
    assert sizes(dealt) == sizes(some) == sorted((r.path, r.size) for r in some.collect())
    assert files.dealt(some.limit(0)).count() == 0
