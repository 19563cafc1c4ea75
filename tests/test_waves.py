"""Fits that the study makes for every wave are made for every wave."""

import pytest

from cohortframe.operators import bccg, quantreg
from cohortframe.plans import catalog
from cohortframe.plans.fixtures import Data


@pytest.mark.parametrize("name, module, fit", [("mdl_quantile_reg", quantreg, "quantile_regression"), ("mdl_bccg_fit", bccg, "bccg_fit")])
def test_fits_of_every_wave(spark, folder, monkeypatch, name, module, fit):
    given = {}

    def record(rows, y, xs, by, *args, **kwargs):
        given.update(rows=rows, by=by)
        raise InterruptedError

    monkeypatch.setattr(module, fit, record)
    with pytest.raises(InterruptedError):
        catalog.queries()[name](spark, folder)
    waves = {r.age for r in Data(spark, folder).waves().where("bmi IS NOT NULL").select("age").distinct().collect()}
    assert "age" in given["by"] and len(waves) > 2
    assert {r.age for r in given["rows"].select("age").distinct().collect()} >= waves
