"""The bucket merge against whole-table merges, broken-off writes, and files of untouched buckets."""

import pytest

from loomgraph.operators import merge

SCHEMA = "id long, name string, at long"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def files(path):
    import glob

    return set(glob.glob(f"{path}/data/**/*.parquet", recursive=True))


def content(spark, path):
    return sorted((r.id if r.id is not None else -1, r.name, r.at) for r in merge.merged(spark, path).collect())


def test_merges_equal_whole_rewrites(spark, tmp_path):
    path, want = str(tmp_path / "t"), {}
    assert merge.merged(spark, path) is None
    for n in range(4):
        batch = [(i * 7 % 50 + n, f"n{n}-{i}", n * 100 + i) for i in range(40)] + [(5, "hot", 1000 * n + k) for k in range(200)] + [(None, "none", n)]
        last = {}
        for r in batch:
            if r[0] not in last or r[2] > last[r[0]][2]:
                last[r[0]] = r
        counts = merge.merge_rows(rows(spark, batch), path, "id", "at", 16)
        assert counts == {"inserted": len(set(last) - set(want)), "updated": len(set(last) & set(want)), "kept": len(set(want) - set(last))}
        want.update(last)
        assert content(spark, path) == sorted((-1 if i is None else i, r[1], r[2]) for i, r in want.items())
    asked = spark.createDataFrame([(5,), (7,), (999,)], "id long")
    assert {(r.id, r.name) for r in merge.merged_keys(spark, path, asked, "id").collect()} == {(i, want[i][1]) for i in (5, 7) if i in want}
    before = content(spark, path)
    assert merge.clean_versions(spark, path, 1) > 0 and content(spark, path) == before


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    merge.merge_rows(rows(spark, [(i, "a", 0) for i in range(400)]), path, "id", "at", 32)
    old = files(path)
    merge.merge_rows(rows(spark, [(3, "b", 1), (401, "c", 1)]), path, "id", "at")
    assert old <= files(path)
    parts = merge._manifest(spark, path, 1)
    assert sum(m.version == 1 for m in parts) <= 2 and sum(m.rows for m in parts) == 401
    assert merge.merge_rows(rows(spark, []), path, "id", "at") == {"inserted": 0, "updated": 0, "kept": 401}
    assert merge.merged(spark, path).count() == 401


def test_a_write_broken_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    merge.merge_rows(rows(spark, [(i, "a", 0) for i in range(50)]), path, "id", "at", 8)
    before = content(spark, path)

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(merge, "_switch", fails)
        with pytest.raises(RuntimeError):
            merge.merge_rows(rows(spark, [(1, "b", 1), (90, "b", 1)]), path, "id", "at")
    assert content(spark, path) == before
    assert merge.merge_rows(rows(spark, [(1, "b", 1), (90, "b", 1)]), path, "id", "at") == {"inserted": 1, "updated": 1, "kept": 49}
    assert len(content(spark, path)) == 51
