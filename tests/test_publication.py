"""Publication: whole inserts or none, parents first, two writers at once."""

import pytest

from memlift.plans.source_plans import folder
from memlift.sources.sinks import Publication

ROWS, KIDS = "id long, body string", "kid long, id long"


def ids(publication, schema=ROWS):
    return sorted(r[0] for r in publication.read(schema).collect())


def test_inserts_are_whole_or_nothing(spark):
    p = Publication(spark, f"{folder(spark)}/t")
    rows = lambda *xs: spark.createDataFrame([(x, "b") for x in xs], ROWS)
    assert ids(p) == [] and p.insert(rows(1, 2), "id") == 2 and p.insert(rows(3), "id") == 1
    for bad in (rows(4, 3), rows(5, 5), rows(6, None)):
        with pytest.raises(ValueError):
            p.insert(bad, "id")
    assert p.insert(rows(), "id") == 0 and ids(p) == [1, 2, 3]


def test_children_need_their_parents(spark):
    at = folder(spark)
    p, c = Publication(spark, f"{at}/p"), Publication(spark, f"{at}/c")
    kids = lambda *xs: spark.createDataFrame(xs, KIDS)
    with pytest.raises(ValueError, match="id 1 isn't published"):
        c.insert(kids((10, 1)), "kid", p, "id")
    p.insert(spark.createDataFrame([(1, "b")], ROWS), "id")
    c.insert(kids((10, 1), (11, None)), "kid", p, "id")
    with pytest.raises(ValueError):
        c.insert(kids((12, 1), (13, 2)), "kid", p, "id")
    assert ids(c, KIDS) == [10, 11]


@pytest.mark.parametrize("other, wanted", [([7], [1, 7]), ([1], [1])])
def test_two_writers_at_once(spark, monkeypatch, other, wanted):
    """A second writer commits after the first has looked and before it commits: the first looks again, and is refused only if its
    ids are taken."""
    at = f"{folder(spark)}/t"
    first, second = Publication(spark, at), Publication(spark, at)
    rows = lambda xs: spark.createDataFrame([(x, "b") for x in xs], ROWS)
    real, turns = Publication._commit, []

    def commit(self, number, name):
        if self is first and not turns:
            turns.append(number)
            assert second.insert(rows(other), "id") == 1
        return real(self, number, name)

    monkeypatch.setattr(Publication, "_commit", commit)
    if other == [1]:
        with pytest.raises(ValueError, match="there already"):
            first.insert(rows([1]), "id")
    else:
        assert first.insert(rows([1]), "id") == 1
    assert turns == [0] and ids(second) == wanted
