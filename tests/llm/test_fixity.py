import pytest
from pyspark.sql import functions as F

from quarrymill.llm import fixity
from quarrymill.llm.fixity import MerkleTree, audit, read_warc, warc_records

SCHEMA = "archive long, offset long, record_id long, record string"


def plain(left, right):
    def by(rows):
        out = {}
        for a, o, _, r in rows:
            if a is not None and o is not None:
                out.setdefault((a, o), []).append((r is not None, r or ""))
        return {k: sorted(v) for k, v in out.items()}

    x, y = by(left), by(right)
    return sorted((*k, "missing" if k not in y else "extra" if k not in x else "changed") for k in x.keys() | y.keys() if x.get(k) != y.get(k))


def found(spark, left, right):
    got = audit(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()
    return sorted((r.archive, r.offset, r.fault) for r in got)


BIG = 1 << 62
ROWS = [(a, o * 30_000, a * 10 + o, f"record {a} {o}") for a in range(6) for o in range(9)]
ROWS += [(-(1 << 63), 5, 1, "least"), (BIG, BIG, 2, "large"), (BIG + 1, -5, 3, None), (7, 7, 4, ""), (None, 1, 5, "x"), (1, None, 6, "x"), (3, 0, 8, "twice"), (3, 0, 9, "twice"), (2, 1, None, "r\r\n")]


def test_faults_equal_plain_comparison(spark):
    right = [r for k, r in enumerate(ROWS) if k % 13 != 4]
    right = [(a, o, i, "other" if o == 60_000 and a in (2, 5) else "" if i == 3 else r) for a, o, i, r in right] + [(9, 9, 9, "new"), (3, 0, 1, "twice"), (0, 1, 2, "new")]
    assert found(spark, ROWS, right) == plain(ROWS, right) and len(plain(ROWS, right)) > 10


def test_equal_replicas_end_at_the_root(spark, monkeypatch):
    levels = []
    descend = MerkleTree.children
    monkeypatch.setattr(MerkleTree, "children", lambda self, level, parents: levels.append(level) or descend(self, level, parents))
    assert found(spark, ROWS, ROWS[::-1]) == [] and set(levels) == {0}
    assert found(spark, [], []) == []
    assert found(spark, ROWS[:3], []) == plain(ROWS[:3], [])


@pytest.mark.parametrize("most", [0, 2_000])
def test_trees_of_other_heights(spark, monkeypatch, most):
    monkeypatch.setattr(fixity, "FILTERED", most)
    left = [(a, 0, a, f"r{a}") for a in range(300)]
    assert found(spark, left, left[:20]) == plain(left, left[:20])
    right = [(a, o, i, r + "!" * (a in (4, 290))) for a, o, i, r in left]
    assert found(spark, left, right) == [(4, 0, "changed"), (290, 0, "changed")]


def test_records_and_offsets(spark, tmp_path):
    rows = [(1, "http://a/", "<p>é</p>"), (2, None, None), (1, "http://a/", "<p>é</p>"), (None, "u", "x"), (1024, "http://b/", "")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record string")
    got = sorted(tuple(r) for r in warc_records(pages).collect())
    assert [r[:1] + r[2:3] for r in got] == [(0, 1), (0, 1), (0, 2), (1, 1024)]
    at = 0
    for _, offset, _, record in got[:3]:
        assert offset == at
        at += len(record.encode())
    assert "Content-Length: 9\r\n\r\n<p>é</p>\r\n\r\n" in got[0][3] and got[3][1] == 0
    (tmp_path / "a.warc").write_bytes("".join(r[3] for r in got[:3]).encode())
    (tmp_path / "b.warc").write_bytes(b"no WARC file")
    back = read_warc(spark, str(tmp_path)).withColumn("record", F.decode("record", "utf-8")).collect()
    assert sorted((r.offset, r.record) for r in back) == sorted([(r[1], r[3]) for r in got[:3]] + [(0, "no WARC file")])
    assert warc_records(pages.limit(0)).collect() == []
