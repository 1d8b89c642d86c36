import csv
import json
import pathlib

import pytest

from fileglade.operators import rollup as R
from fileglade.operators.listing import open_listing
from fileglade.plans.browser import envelope
from fileglade.sinks import export as E

NASTY = ["=1+1", "+cmd", " lead", 'quo"te', "com,ma", "new\nline", "\ttab", "plain", "üñï"]


def read_csv(folder):
    rows = []
    for part in sorted(pathlib.Path(folder).glob("part-*.csv")):
        with open(part, newline="", encoding="utf-8") as handle:
            rows += list(csv.DictReader(handle))
    return rows


def test_listing_export(make, tmp_path):
    rows = [("/d/", n, "FILE", i, None, 1_712_345_678_987_654_321, None) for i, n in enumerate(NASTY)]
    found = open_listing(make(rows), "/d/")
    target = E.export_listing(found, "/d/", str(tmp_path))
    assert target.endswith("/listing-d")
    got = read_csv(target)
    safe = ["'" + n if n[0] in "=+-@\t\r\n" else n for n in NASTY]
    order = sorted(range(len(NASTY)), key=lambda i: NASTY[i].encode())
    assert [r["name"] for r in got] == [safe[i] for i in order]
    assert list(got[0]) == [
        "name", "element_type", "size", "used", "mtime", "atime", "owner_name", "extension", "nlinks",
    ]
    first = next(r for r in got if r["name"] == "plain")
    assert (first["size"], first["used"], first["mtime"], first["atime"]) == (
        "7", "", "2024-04-05T19:34:38.987654321", "",
    )
    manifest = json.loads(next(pathlib.Path(f"{target}.manifest").glob("part-*.json")).read_text())
    assert (manifest["row_count"], manifest["truncated"]) == (len(NASTY), False)


def test_truncated_export_says_so(make, tmp_path):
    found = open_listing(make([("/a/b/", f"f{i}", "FILE", 1, 1) for i in range(30)]), "/a/b", cap=20)
    target = E.export_listing(found, "/a/b", str(tmp_path), "size", "desc")
    assert target.endswith("/listing-a_b-TRUNCATED")
    assert len(read_csv(target)) == 20
    with pytest.raises(Exception, match="already exists"):
        E.export_listing(found, "/a/b", str(tmp_path))


def test_rollup_export_has_every_group_in_order(make, tmp_path):
    rows = [(f"/x/=g{i:03d}/", "f", "FILE", i % 7, i, i, i) for i in range(600)]
    groups = R.rollup_groups(make(rows), "/x/", 1)
    got = read_csv(E.export_rollup(groups, "/x/", str(tmp_path)))
    assert len(got) == 600
    assert list(got[0]) == [
        "folder", "file_count", "total_bytes", "total_used", "last_modified", "last_accessed",
    ]
    keys = [(-int(r["total_bytes"]), r["folder"]) for r in got]
    assert keys == sorted(keys) and all(r["folder"].startswith("'=g") for r in got)


def test_envelope_nests_children_in_rank_order(make):
    rows = make([(f"/x/{n}/", "f", "FILE", s, 1, 5, 5) for n, s in (("a", 1), ("b", 9), ("c", 5))])
    groups = R.rollup_groups(rows, "/x/", 1)
    whole = envelope(
        R.children(groups, 2), R.totals(groups), path="/x/", catalog_snapshot=None, rows_scanned=3
    ).collect()
    assert len(whole) == 1
    row = whole[0]
    assert [c["name"] for c in row["children"]] == ["b", "c"]
    assert (row["totals"]["total_bytes"], row["rows_scanned"], row["catalog_snapshot"]) == (15, 3, None)
