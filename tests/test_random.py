"""Random catalogs against plain Python."""

import random

import pytest

from fileglade.operators import hierarchy as H
from fileglade.operators import listing as L
from fileglade.operators import rollup as R

COMPONENTS = ["a", "b", "ab", "c c", "😀", "%", "_", "", "é"]


def random_catalog(seed):
    rng = random.Random(seed)
    folders = [
        "/" + "".join(rng.choice(COMPONENTS) + "/" for _ in range(rng.randint(0, 5)))
        for _ in range(60)
    ]
    # One directory holds a third of all rows.
    folders += [folders[0]] * 30
    rows, used = [], set()
    for i in range(600):
        parent = rng.choice(folders)
        kind = rng.choices(["FILE", "DIR", "SYMLINK", None], [8, 2, 1, 1])[0]
        name = rng.choice([c for c in COMPONENTS if c]) if kind == "DIR" else f"n{i:04d}"
        if (parent, name) in used:
            continue
        used.add((parent, name))
        numbers = [rng.choice([None, rng.randint(0, 50)]) for _ in range(4)]
        rows.append((parent, name, kind, *numbers))
    return rng, folders, rows


def merge(old, size, used, mtime, atime, files=1):
    def later(a, b):
        return max((v for v in (a, b) if v is not None), default=None)

    return (
        old[0] + files,
        old[1] + (size or 0),
        old[2] + (used or 0),
        later(old[3], mtime),
        later(old[4], atime),
    )


def brute_rollup(rows, prefix, depth):
    groups = {}
    for parent, name, kind, *numbers in rows:
        if kind == "FILE" and parent.startswith(prefix):
            parts = [c for c in parent[len(prefix):].split("/") if c]
            key = "/".join(parts[:depth]) or "."
            groups[key] = merge(groups.get(key, (0, 0, 0, None, None)), *numbers)
        elif kind == "DIR" and parent == prefix:
            groups.setdefault(name, (0, 0, 0, None, None))
    return groups


def by_name(rows):
    return {
        r["name"]: (r["file_count"], r["total_bytes"], r["total_used"], r["mtime"], r["atime"])
        for r in rows
    }


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rollups(make, seed):
    rng, folders, rows = random_catalog(seed)
    catalog = make(rows).cache()
    requests = {("/", 1), ("/", 3)}
    for _ in range(6):
        folder = R.normalize_prefix(rng.choice(folders))
        requests.add((folder, rng.randint(1, 4)))
    many = R.rollup_many(catalog, list(requests)).collect()
    for prefix, depth in requests:
        expected = brute_rollup(rows, prefix, depth)
        assert by_name(R.rollup_groups(catalog, prefix, depth).collect()) == expected
        part = [r for r in many if (r["prefix"], r["depth"]) == (prefix, depth)]
        assert by_name(part) == expected


@pytest.mark.parametrize("seed", [4, 5])
def test_listings(make, seed):
    rng, folders, rows = random_catalog(seed)
    catalog = make(rows).cache()
    path = R.normalize_prefix(folders[0])
    here = sorted((r for r in rows if r[0] == path), key=lambda r: r[1].encode())
    for _ in range(4):
        cap = rng.choice([5, len(here) or 1, 10**6])
        sort, order = rng.choice(["name", "size", "mtime", "atime"]), rng.choice(["asc", "desc"])
        kept = here[:cap]
        found = L.open_listing(catalog, path, cap=cap)
        assert (found.total_rows, found.truncated) == (len(kept), len(here) > cap)
        sign = -1 if order == "desc" else 1
        at = {"size": 3, "mtime": 5, "atime": 6}.get(sort)

        def place(row):
            # A null type sorts behind files, as null flags do.
            kind = {"DIR": 0, None: 2}.get(row[2], 1)
            if at is None:
                code = [sign * b for b in row[1].encode()] + ([0] if sign < 0 else [-1])
                return (kind, code)
            return (row[at] is None, sign * (row[at] or 0), kind, row[1].encode())

        expected = [r[1] for r in sorted(kept, key=place)]
        page = rng.randint(1, 4)
        shown, where = found.page(page, 20, sort, order)
        begin = (where.number - 1) * 20
        assert [r["name"] for r in shown.collect()] == expected[begin : begin + 20]


@pytest.mark.parametrize("seed", [6])
def test_children_of_every_directory(make, seed):
    _, _, rows = random_catalog(seed)
    catalog = make(rows)
    children = {}
    for parent, name, kind, *_ in rows:
        if kind == "DIR":
            children.setdefault(parent, []).append(name)
    got = {}
    for r in H.tree_levels(catalog, 2).collect():
        got.setdefault(r["parent_path"], {})[r["position"]] = (r["name"], r["more_dirs"])
    assert got == {
        parent: {
            i: (n, max(len(names) - 2, 0))
            for i, n in enumerate(sorted(names, key=str.encode)[:2], start=1)
        }
        for parent, names in children.items()
    }
