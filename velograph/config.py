"""Run configuration: read from YAML, checked at once, with defaults for every key."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

MODES = ("mpi_transpose", "in-situ-diagnostic")
#: Axis name: kind of boundary, whether periodic, and the prefix of its keys.
KINDS = {"tor1": ("greville", False, "Tor1"), "tor2": ("periodic", True, "Tor2"), "tor3": ("periodic", True, "Tor3"), "vpar": ("hermite", False, "Vpar"), "mu": ("hermite", False, "Mu")}


def axis_points(kind: str, ncells: int, lo: float, hi: float) -> list[float]:
    """Interpolation points of cubic splines on a uniform axis: `greville` has clamped averages of knots (ncells + 3),
    `periodic` leaves the right end out (ncells), `hermite` has all break points (ncells + 1)."""
    if ncells < 1:
        raise ValueError(f"an axis needs one cell at least, not {ncells}")
    h = (hi - lo) / ncells
    if kind == "periodic":
        return [lo + i * h for i in range(ncells)]
    if kind == "hermite":
        return [lo + i * h for i in range(ncells + 1)]
    if kind == "greville":
        inner = [lo + i * h for i in range(1, ncells)]
        return [lo, lo + h / 3, *inner, hi - h / 3, hi]
    raise ValueError(f"unknown kind of axis: {kind}")


@dataclass(frozen=True)
class Axis:
    name: str
    kind: str
    ncells: int
    lo: float
    hi: float
    periodic: bool

    @property
    def points(self) -> list[float]:
        return axis_points(self.kind, self.ncells, self.lo, self.hi)

    @property
    def breakpoints(self) -> list[float]:
        return [self.lo + i * (self.hi - self.lo) / self.ncells for i in range(self.ncells + 1)]

    @property
    def length(self) -> float:
        return self.hi - self.lo


@dataclass(frozen=True)
class Species:
    name: str
    charge: float
    mass: float
    n_maxw: float
    t_maxw: float
    upar_maxw: float


def _default_axes() -> dict[str, Axis]:
    cells = {"tor1": (15, 0.0, 1.0), "tor2": (32, 0.0, 2 * math.pi), "tor3": (32, 0.0, 2 * math.pi), "vpar": (15, -7.0, 7.0), "mu": (9, 0.0, 12.0)}
    return {n: Axis(n, KINDS[n][0], *cells[n], KINDS[n][1]) for n in KINDS}


def _default_species() -> tuple[Species, ...]:
    return Species("electron", -1.0, 0.0005, 1.0, 1.0, 0.0), Species("ion", 1.0, 1.0, 1.0, 1.0, 3.0)


@dataclass(frozen=True)
class Run:
    axes: dict[str, Axis] = field(default_factory=_default_axes)
    species: tuple[Species, ...] = field(default_factory=_default_species)
    version: str = "in-situ-diagnostic"
    n_iterations: int = 10
    eps: float = 0.1
    file_name: str = ""

    def __post_init__(self):
        if self.version not in MODES:
            raise ValueError(f"unknown version {self.version!r}; it is one of {', '.join(MODES)}")
        if self.n_iterations < 0:
            raise ValueError("n_iterations can't be negative")
        if not self.species:
            raise ValueError("SpeciesInfo is empty")
        for s in self.species:
            if s.t_maxw <= 0:
                raise ValueError(f"T_maxw of {s.name} must be positive")
        for a in self.axes.values():
            if a.hi <= a.lo:
                raise ValueError(f"axis {a.name}: max must be over min")

    @property
    def extents(self) -> dict[str, int]:
        """Points of species and each axis, in the order of the distribution."""
        return {"species": len(self.species)} | {n: len(a.points) for n, a in self.axes.items()}

    def with_cells(self, **ncells: int) -> Run:
        """A copy with other numbers of cells."""
        axes = {n: Axis(n, a.kind, ncells.get(n, a.ncells), a.lo, a.hi, a.periodic) for n, a in self.axes.items()}
        return Run(axes, self.species, self.version, self.n_iterations, self.eps, self.file_name)


def from_mapping(tree: dict[str, Any]) -> Run:
    """A run of a parsed YAML tree. Keys of SplineMesh and Application that are absent are errors."""

    def at(section: str, key: str, kind: type) -> Any:
        try:
            return kind(tree[section][key])
        except KeyError:
            raise ValueError(f"missing key {section}.{key}") from None
        except (TypeError, ValueError) as e:
            raise ValueError(f"{section}.{key}: {e}") from None

    axes = {}
    for n, (kind, periodic, key) in KINDS.items():
        axes[n] = Axis(n, kind, at("SplineMesh", f"{key}_ncells", int), at("SplineMesh", f"{key}_min", float), at("SplineMesh", f"{key}_max", float), periodic)
    rows = tree.get("SpeciesInfo") or []
    try:
        species = tuple(Species(str(r.get("name", f"species{i}")), *(float(r[k]) for k in ("charge", "mass", "N_maxw", "T_maxw", "Upar_maxw"))) for i, r in enumerate(rows))
    except KeyError as e:
        raise ValueError(f"SpeciesInfo lacks {e}") from None
    names = list((tree.get("FileNames") or {}).values())
    return Run(axes, species, at("Application", "version", str), at("Application", "n_iterations", int), at("Application", "eps", float), str(names[0]) if names else "")


def load(path: str) -> Run:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_mapping(yaml.safe_load(f))


def is_yaml(path: str) -> bool:
    return Path(path).suffix in (".yaml", ".yml")


def parse_args(args: list[str], usage: str = "usage: velograph CONFIG.yaml STORE.yaml") -> tuple[Run, dict[str, Any]]:
    """The run and the store's settings, of two YAML paths; else a usage message and a failing exit."""
    if len(args) < 2:
        print(usage, file=sys.stderr)
        raise SystemExit(1)
    for p in args[:2]:
        if not is_yaml(p):
            print(f"expected a .yaml file, not {p}\n{usage}", file=sys.stderr)
            raise SystemExit(1)
    import yaml

    with open(args[1], encoding="utf-8") as f:
        store = yaml.safe_load(f) or {}
    return load(args[0]), store
