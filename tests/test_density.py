"""Kernel densities against the sum over all rows, to the bound that binning gives."""

import numpy as np

from cohortframe.operators.aggregate import kernel_density


def test_density_against_all_rows(spark):
    draw = np.random.default_rng(4)
    groups = {1: draw.normal(0, 1, 400), 2: draw.gamma(2, 3, 150), None: draw.normal(50, 9, 30)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(3, 1.0), (3, 1.0), (4, None), (1, None)]
    got = kernel_density(spark.createDataFrame(rows, "g int, x double"), "x", ["g"]).toPandas()
    assert len(got) == 512 * len(groups) and got.columns.tolist() == ["g", "point", "x", "density"]
    for g, values in groups.items():
        found = got[got.g.isna() if g is None else got.g == g].sort_values("point")
        quartiles = np.quantile(values, [0.25, 0.75])
        width = 0.9 * min(values.std(ddof=1), (quartiles[1] - quartiles[0]) / 1.34) * len(values) ** -0.2
        x = np.linspace(values.min() - 3 * width, values.max() + 3 * width, 512)
        assert np.allclose(found.x, x)
        gap = (x[:, None] - values) / width
        density = np.exp(-gap * gap / 2).sum(1) / (np.sqrt(2 * np.pi) * width * len(values))
        bound = (x[1] - x[0]) ** 2 / (8 * np.sqrt(2 * np.pi) * width**3)
        assert np.abs(found.density - density).max() <= bound + 1e-12
        assert abs(np.trapezoid(found.density, found.x) - 1) < 0.01
