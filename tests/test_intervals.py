"""Totals of all directories from path intervals equal the one-row-per-ancestor rollup."""

from fileglade.operators.intervals import subtree_totals
from fileglade.operators.rollup import rollup_all_directories

TREE = [
    ("/", "vault", "DIR"), ("/vault/", "ice", "DIR"), ("/vault/", "fire", "DIR"), ("/vault/", "void", "DIR"),
    ("/vault/ice/", "cube.raw", "FILE", 12, 16, 300, 310),
    ("/vault/ice/shard/", "a.raw", "FILE", None, 4, 100, None),
    ("/vault/ice/shard/deeper/more/", "b.raw", "FILE", 7, 8, None, 50),
    ("/vault/fire/", "torch.raw", "FILE", 3, 4, 900, 905),
    ("/vault/fire0/", "beside.raw", "FILE", 1, 1, 5, 5),
    ("/other/", "x.raw", "FILE", 2, 2, 1, 1),
] + [(f"/chain/{'d/' * i}", f"f{i}", "FILE", i, i, i, i) for i in range(12)]


def rows(frame):
    return sorted(tuple(r) for r in frame.select(
        "path", "file_count", "total_bytes", "total_used", "mtime", "atime").collect())


def test_equals_rollup_of_all_directories(make):
    catalog = make(TREE)
    assert rows(subtree_totals(catalog, parts=3)) == rows(rollup_all_directories(catalog))


def test_only_directories_and_empty(make):
    catalog = make([("/", "a", "DIR"), ("/a/", "b", "DIR")])
    assert rows(subtree_totals(catalog, parts=2)) == rows(rollup_all_directories(catalog))
    assert subtree_totals(make([]), parts=2).count() == 0
