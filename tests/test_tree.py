"""Source trees as a data source."""

import os

import pytest

from quaymark.sources import tree


def test_every_entry_is_a_row(spark, tmp_path):
    root = tmp_path / "r"
    for path, data in {"a.php": "<?php", "s/b.js": "é", "s/t/c.bin": b"\xff\xfe", "s/t/u/v/d.txt": "deep", "node_modules/x.js": "no", "s/node_modules": "a file", "out/e.php": "no", "s/big.txt": "x" * 50}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data if isinstance(data, bytes) else data.encode())
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "secret.php").write_text("no")
    os.symlink(tmp_path / "other", root / "s" / "link")
    os.symlink(root / "a.php", root / "s" / "t" / "same.php")
    os.symlink("nowhere", root / "gone")
    rows = tree.read_source_tree(spark, str(root), "r", exclude=["./out/"], max_bytes=40)
    found = {r.path: (r.kind, r.length, r.text) for r in rows.collect()}
    assert found == {
        "a.php": ("file", 5, "<?php"), "s/b.js": ("file", 2, "é"), "s/t/c.bin": ("file", 2, None), "s/t/u/v/d.txt": ("file", 4, "deep"), "s/node_modules": ("file", 6, "a file"), "s/big.txt": ("file", 50, None),
        "node_modules": ("pruned", None, None), "out": ("excluded", None, None), "s/link": ("link", None, None), "s/t/same.php": ("link", None, None), "gone": ("link", None, None),
    }
    assert len(rows.collect()) == len(found) and rows.rdd.getNumPartitions() == 3
    assert {r.path: r.sha256 for r in rows.collect()}["s/big.txt"] is None and len({r.path: r.sha256 for r in rows.collect()}["s/t/c.bin"]) == 64
    bare = tree.read_source_tree(spark, str(root), "r", contents=False).where("kind = 'file'").collect()
    assert all(r.text is None and r.length is not None for r in bare) and len(bare) == 7


def test_no_tree_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="no folder"):
        tree.read_source_tree(spark, str(tmp_path / "none"), "r").collect()
