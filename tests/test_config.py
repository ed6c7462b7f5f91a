import math

import pytest
import yaml

from velograph import config
from velograph.config import Run, axis_points

TREE = {
    "FileNames": {"any": "input.h5"},
    "SplineMesh": {f"{k}_{p}": v for k, vs in {"Tor1": (3, 0, 1), "Tor2": (4, 0, 6.28), "Tor3": (4, 0, 6.28), "Vpar": (5, -7, 7), "Mu": (4, 0, 12)}.items() for p, v in zip(("ncells", "min", "max"), vs, strict=True)},
    "SpeciesInfo": [{"name": "ion", "charge": 1, "mass": 1, "N_maxw": 1, "T_maxw": 2, "Upar_maxw": 0.5}],
    "Application": {"version": "mpi_transpose", "n_iterations": 0, "eps": 0.1},
}


def test_default_sizes():
    assert Run().extents == {"species": 2, "tor1": 18, "tor2": 32, "tor3": 32, "vpar": 16, "mu": 10}
    assert math.prod(Run().extents.values()) == 5_898_240


def test_points():
    assert axis_points("hermite", 2, 0, 1) == [0, 0.5, 1]
    assert axis_points("periodic", 2, 0, 1) == [0, 0.5]
    assert axis_points("greville", 2, 0.0, 6.0) == [0, 1, 3, 5, 6]
    with pytest.raises(ValueError):
        axis_points("hermite", 0, 0, 1)
    with pytest.raises(ValueError):
        axis_points("odd", 2, 0, 1)


def test_mapping_and_errors():
    run = config.from_mapping(TREE)
    assert run.file_name == "input.h5" and run.extents["tor1"] == 6 and run.species[0].t_maxw == 2
    with pytest.raises(ValueError, match="gpu2cpu"):
        config.from_mapping(TREE | {"Application": TREE["Application"] | {"version": "gpu2cpu"}})
    with pytest.raises(ValueError, match="Mu_max"):
        config.from_mapping(TREE | {"SplineMesh": {k: v for k, v in TREE["SplineMesh"].items() if k != "Mu_max"}})
    with pytest.raises(ValueError):
        config.from_mapping(TREE | {"SpeciesInfo": []})


def test_args(tmp_path, capsys):
    a, b = tmp_path / "a.yaml", tmp_path / "b.yml"
    a.write_text(yaml.safe_dump(TREE))
    b.write_text("store: 1\n")
    run, store = config.parse_args([str(a), str(b)])
    assert run.version == "mpi_transpose" and store == {"store": 1}
    for bad in ([], [str(a)], [str(a), "x.json"]):
        with pytest.raises(SystemExit) as e:
            config.parse_args(bad)
        assert e.value.code == 1
    assert "usage" in capsys.readouterr().err
