import json

from fileglade.sources import control as C


def test_views(spark, tmp_path):
    records = [
        {"name": "", "alias": "al", "path": "/b", "protocols": ["NFS", "S3"], "tenant_id": 7},
        {"name": "n", "alias": "al", "path": "/a", "protocols": None, "policy_name": "p1", "policy": "p2"},
        {"name": None, "path": "/c", "policy_name": "", "policy": "p2", "tenant_name": "t", "tenant_id": 1},
        {"name": "no path"},
        {"name": "blank path", "path": ""},
    ]
    file = tmp_path / "views.json"
    file.write_text("\n".join(json.dumps(r) for r in records))
    expected = [
        ("n", "/a", [], "p1", None),
        ("al", "/b", ["NFS", "S3"], None, "7"),
        ("/c", "/c", [], "p2", "t"),
    ]
    views = C.normalised_views(C.read_views(spark, str(file)))
    assert [tuple(r) for r in views.collect()] == expected
    texts = spark.createDataFrame([(json.dumps(r),) for r in records], "record string")
    parsed = C.normalised_views(C.parse_views(texts))
    assert [tuple(r) for r in parsed.collect()] == expected


def test_capacity(spark):
    full = {"logical": 10, "unique": 5, "usable": 7, "percent": 12.5, "average_atime": "2 days"}
    records = [
        ("/nested", json.dumps({"details": full, "logical": 99})),
        ("/flat", json.dumps(full)),
        ("/part", json.dumps({"logical": 3})),
        ("/empty", json.dumps({"details": {}, "logical": 99})),
        ("/list", json.dumps({"details": [1], "logical": 99})),
        ("/null", json.dumps({"details": None, "logical": 99})),
        ("/none", None),
        ("/array", "[1, 2]"),
    ]
    frame = spark.createDataFrame(records, "path string, record string")
    rows = {r["path"]: tuple(r)[1:] for r in C.capacity(frame).collect()}
    lifted = (True, True, "10", "5", "7", "12.5", "2 days")
    nothing = (True, True, None, None, None, None, None)
    assert rows["/nested"] == rows["/flat"] == lifted
    assert rows["/part"] == (True, True, "3", None, None, None, None)
    for path in ("/empty", "/list", "/null", "/none", "/array"):
        assert rows[path] == nothing, path


def test_variant_reader_equals_text_reader(spark):
    from fileglade.sources import control

    records = spark.createDataFrame(
        [
            ("/a/", '{"details": {"logical": 9, "usable": null, "percent": 1.5}, "logical": -9}'),
            ("/b/", '{"logical": 4, "average_atime": "1-URGENT", "extra": {"k": 1}}'),
            ("/c/", '{"details": [2], "logical": 2}'),
            ("/d/", '{"details": null, "logical": 3}'),
            ("/e/", "[1, 2]"),
            ("/f/", "not json"),
            ("/g/", None),
        ],
        "path string, record string",
    )
    text = sorted(map(tuple, control.capacity(records).collect()), key=str)
    variant = sorted(map(tuple, control.capacity_variant(records).collect()), key=str)
    assert variant == text
    fields = {(r.path, r.key, r.is_object) for r in control.record_fields(records).collect()}
    assert ("/b/", "extra", True) in fields and ("/c/", "details", False) in fields
    assert not {p for p, _, _ in fields} & {"/e/", "/f/", "/g/"}
