"""The bounded sample against sorting all rows."""

import hashlib

import pytest

from palimpsest.llm.common import bounded_sample


def hash_of(i):
    return int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("bound", [1, 7, 100, 5000])
def test_sample_is_that_of_a_sort(spark, bound):
    rows = [(i, "hot" if i % 10 else "rare", i * 2) for i in range(3000)] + [(9001, None, 1), (9002, None, 2)]
    found = bounded_sample(spark.createDataFrame(rows, "doc_id long, lang string, n long"), "doc_id", "lang", bound)
    assert found.columns == ["doc_id", "lang", "n"]
    wanted = []
    for g in {r[1] for r in rows}:
        wanted += sorted((r for r in rows if r[1] == g), key=lambda r: hash_of(r[0]))[:bound]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)


def test_sample_of_nothing(spark):
    assert bounded_sample(spark.createDataFrame([], "doc_id long, lang string"), "doc_id", "lang", 5).count() == 0

