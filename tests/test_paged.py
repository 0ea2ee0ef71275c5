"""Listings by cursor, read in executors."""

import json

import pytest

from lodestar.sources.paged import read_catalogue


def put(root, server, pages):
    cursors = [None, *[f"c{i}" for i in range(1, len(pages))]]
    for k, (cursor, tools) in enumerate(zip(cursors, pages, strict=True)):
        place = root / f"server={server}" / f"cursor={cursor or 'start'}"
        place.mkdir(parents=True)
        page = {"tools": [{"name": t, "about": f"about {t}"} for t in tools]} | ({"next": f"c{k + 1}"} if k + 1 < len(pages) else {})
        (place / "part-0.json").write_text(json.dumps(page))


def test_pages_are_followed_to_their_end(spark, tmp_path):
    put(tmp_path, "claims", [["get", "list"], [], ["pay"]])
    put(tmp_path, "policy", [["search"]])
    put(tmp_path, "bare", [[]])
    root = f"file://{tmp_path}"
    got = read_catalogue(spark, ["claims", "policy", "bare"], root)
    assert got.rdd.getNumPartitions() == 3
    assert sorted(tuple(r) for r in got.collect()) == [
        ("claims", "get", "claims__get", "about get", 0, None), ("claims", "list", "claims__list", "about list", 0, None),
        ("claims", "pay", "claims__pay", "about pay", 2, "c2"), ("policy", "search", "policy__search", "about search", 0, None),
    ]
    assert [r.tool for r in read_catalogue(spark, ["claims"], root, after={"claims": "c1"}).collect()] == ["pay"]
    assert read_catalogue(spark, ["bare"], root).count() == 0


def test_listing_that_turns_in_a_circle(spark, tmp_path):
    put(tmp_path, "loop", [["a"], ["b"], ["c"]])
    (tmp_path / "server=loop" / "cursor=c2" / "part-0.json").write_text(json.dumps({"tools": [], "next": "c1"}))
    with pytest.raises(Exception, match="twice"):
        read_catalogue(spark, ["loop"], f"file://{tmp_path}").collect()
