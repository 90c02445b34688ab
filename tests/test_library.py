"""Queries over the stored catalog make the parts of it that they read, and no others."""

from pathlib import Path

import pytest

from assayer.plans import library, slicing
from assayer.plans.queries import cases, traces

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")


@pytest.fixture
def unsliced(monkeypatch):
    """A session without catalogs, in which nothing may be clustered."""

    def clustered(*_, **__):
        raise AssertionError("clustered")

    monkeypatch.setattr(library, "_STORES", {})
    monkeypatch.setattr(slicing, "cluster_traces", clustered)


def test_traces_and_cases_are_stored_without_slices(spark, unsliced):
    assert library.stored_traces(spark, str(DATA)).count() == traces(spark, str(DATA)).count()
    assert library.exported_dataset(spark, str(DATA)).count() == cases(spark, str(DATA)).count() + 1


def test_an_experiment_needs_no_slices(spark, unsliced):
    assert library.stored_comparisons(spark, str(DATA)).count() == cases(spark, str(DATA)).count()
    assert [d.name for d in library.stored(spark, str(DATA)).catalog.datasets().collect()] == ["talks"]
    with pytest.raises(AssertionError, match="clustered"):  # these list what the slices gave
        library.dataset_list(spark, str(DATA))
