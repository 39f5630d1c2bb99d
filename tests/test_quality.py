import pytest

from aerovox.operators import quality
from aerovox.operators.quality import Rule


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, 0.5), (2, 1.2), (3, None)], "id int, confidence double")


def test_warn_keeps_and_counts(rows):
    rule = Rule("range", "confidence <= 1")
    assert quality.enforce(rows, rule).count() == 3
    assert [tuple(r) for r in quality.report(rows, rule).collect()] == [("range", "warn", 3, 2)]


def test_drop_removes_breaches_and_unknowns(rows):
    assert [r.id for r in quality.enforce(rows, Rule("range", "confidence <= 1", "drop")).collect()] == [1]


def test_fail_raises(rows):
    with pytest.raises(Exception, match="confidence_range"):
        quality.enforce(rows, quality.CONFIDENCE_IN_RANGE).collect()


def test_fail_passes_good_rows(rows):
    assert quality.enforce(rows.where("id = 1"), quality.CONFIDENCE_IN_RANGE).count() == 1


def test_quarantine_names_the_breaches(rows):
    got = quality.quarantine(rows, Rule("range", "confidence <= 1"), Rule("first", "id < 2")).collect()
    assert {r.id: r.breached for r in got} == {2: ["range", "first"], 3: ["range", "first"]}


def test_unknown_action():
    with pytest.raises(ValueError):
        Rule("x", "true", "explode")
