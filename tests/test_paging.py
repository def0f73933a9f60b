"""Pages at any offset against a sorted list, and how many files they read."""

import random

import pytest

from corpusweave.operators.paging import PagedTable


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    return [(i, f"t{i}") for i in r.sample(range(100_000), 3000)]


@pytest.mark.parametrize("newest", [True, False])
def test_pages_of_a_sorted_list(spark, rows, newest):
    t = PagedTable.build(spark.createDataFrame(rows, "id bigint, title string"), files=12, newest=newest)
    want = sorted(rows, reverse=newest)
    assert t.total() == 3000 and len(t._files()[0]) >= 6
    for offset in (0, 7, 1499, 2980, 2995, 2999, 3000, 9999):
        assert [tuple(x) for x in t.page(20, offset).collect()] == want[offset : offset + 20]
    again = PagedTable(spark, t.path, newest=newest)
    assert [x.id for x in again.page(5, 1234).collect()] == [i for i, _ in want[1234:1239]]


def test_far_offsets_read_two_files_at_most(spark, rows):
    t = PagedTable.build(spark.createDataFrame(rows, "id bigint, title string"), files=12)
    for offset in range(0, 3000, 97):
        files, skip = t.files_of(20, offset)
        assert 1 <= len(files) <= 2 and skip >= 0
        assert len(t.page(20, offset).inputFiles()) <= 2


def test_empty_table(spark):
    t = PagedTable.build(spark.createDataFrame([], "id bigint, title string"))
    assert t.total() == 0 and t.page(20, 0).count() == 0
