import numpy as np

from larmor.operators import voronoi


def test_cells_of_fine_spokes():
    # The 40 nearest of most points lie on their own spoke.
    steps = np.linspace(0.1, 5, 60)
    angles = np.arange(6) * np.pi / 3
    spokes = np.stack([np.cos(angles), np.sin(angles)], 1)
    points = np.concatenate([np.zeros((1, 2)), *[steps[:, None] * s for s in spokes]])
    few, every = voronoi.cell_volumes(points, 6.0), voronoi.cell_volumes(points, 6.0, len(points))
    assert np.allclose(few, every)
    assert few.sum() < 4 * 6.0**2  # cells do not overlap within the box


def test_cells_of_fine_lines_in_space():
    steps = np.linspace(-1, 1, 9)
    points = np.concatenate([np.stack([steps, np.full(9, y), np.full(9, z)], 1) for y, z in ((-0.7, 0), (0.7, 0.2))])
    assert np.allclose(voronoi.cell_volumes(points, 2.0, 4), voronoi.cell_volumes(points, 2.0, len(points)))


def test_shell_cells_of_crowded_directions():
    angles = np.linspace(0, 0.4, 9)
    points = 3.0 * np.concatenate([np.stack([np.cos(angles), np.sin(angles), np.full(9, z)], 1) for z in (-0.3, 0.3)])
    assert np.allclose(voronoi.sphere_weights(points, neighbours=4), voronoi.sphere_weights(points, neighbours=len(points)))
