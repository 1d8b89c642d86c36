"""Incremental rollups equal a full rollup of the new snapshot."""

from fileglade.operators import rollup as ru
from fileglade.operators.incremental import changed_directories, directory_state, refreshed_groups

REQUESTS = [("/", 1), ("/srv/", 2), ("/srv/maps/", 1), ("/tmp/", 1)]

BEFORE = [
    ("/", "srv", "DIR"), ("/", "tmp", "DIR"), ("/", "old", "DIR"),
    ("/srv/", "maps", "DIR"), ("/srv/", "logs", "DIR"), ("/srv/", "idle", "DIR"),
    ("/srv/maps/", "north.tif", "FILE", 700, 512, 90, 95),
    ("/srv/maps/", "south.tif", "FILE", 300, 256, 40, 99),
    ("/srv/maps/deep/", "east.tif", "FILE", None, 128, 70, 70),
    ("/srv/logs/", "a.log", "FILE", 10, 4, 20, 21),
    ("/srv/logs/", "b.log", "FILE", 11, 4, 25, 26),
    ("/tmp/", "scratch.bin", "FILE", 5, 5, 10, 10),
    ("/old/", "gone.txt", "FILE", 1, 1, 1, 1),
]
AFTER = [
    ("/", "srv", "DIR"), ("/", "tmp", "DIR"), ("/", "new", "DIR"),
    ("/srv/", "maps", "DIR"), ("/srv/", "logs", "DIR"), ("/srv/", "fresh", "DIR"),
    ("/srv/maps/", "south.tif", "FILE", 300, 256, 40, 99),          # north.tif, the newest, went
    ("/srv/maps/deep/", "east.tif", "FILE", 5, 128, 70, 70),        # size known now
    ("/srv/logs/", "a.log", "FILE", 10, 4, 20, 21),
    ("/srv/logs/", "b.log", "FILE", 11, 4, 25, 26),
    ("/srv/logs/", "c.log", "FILE", 12, 4, 30, 31),                 # added, newer
    ("/tmp/", "scratch.bin", "FILE", 5, 5, 10, 10),
    ("/new/", "made.txt", "FILE", 2, 2, 50, 50),
]


def rows(frame):
    return sorted(tuple(r) for r in frame.select(
        "prefix", "depth", "name", "file_count", "total_bytes", "total_used", "mtime", "atime").collect())


def test_equals_full_rollup(make):
    before, after = make(BEFORE), make(AFTER)
    old_groups = ru.rollup_many(before, REQUESTS)
    old_state = directory_state(before, REQUESTS)
    got = refreshed_groups(after, REQUESTS, old_groups, old_state)
    assert rows(got) == rows(ru.rollup_many(after, REQUESTS))


def test_only_changed_directories(make):
    before, after = make(BEFORE), make(AFTER)
    changed = {r.parent_path for r in changed_directories(
        directory_state(before, REQUESTS), directory_state(after, REQUESTS)).collect()}
    assert changed == {"/srv/maps/", "/srv/maps/deep/", "/srv/logs/", "/old/", "/new/"}


def test_nothing_changed(make):
    before = make(BEFORE)
    old_groups = ru.rollup_many(before, REQUESTS)
    got = refreshed_groups(before, REQUESTS, old_groups, directory_state(before, REQUESTS))
    assert rows(got) == rows(old_groups)
