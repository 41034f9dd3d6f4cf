"""Manifests: what to build, from which data, with which rules and layers.

YAML scalars stay strings, so tag values such as 2 or yes are not turned into numbers or booleans.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Rule:
    minzoom: int
    maxzoom: int | None = None
    tags: tuple[tuple[str, str], ...] = ()
    keys: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    include: str | tuple[str, ...] = "None"  # "None", "All" or keys


@dataclass(frozen=True)
class Manifest:
    leaf_zoom: int
    layer_order: tuple[str, ...]
    layers: dict[str, tuple[str, ...]]
    rules: dict[str, Rule]
    all_tags: bool = False
    include_leaves: tuple[int, ...] = ()
    report_options: tuple[str, ...] = ()
    source: str | None = None
    planet: str | None = None
    archive: str | None = None
    warnings: list[str] = field(default_factory=list, compare=False)

    def __post_init__(self) -> None:
        if self.leaf_zoom % 2 or not 0 <= self.leaf_zoom <= 14:
            raise ValueError(f"leaf_zoom must be even and 14 at most: {self.leaf_zoom}")


OPTIONS = (
    "write_fb_tiles", "lookup_strings_and_values", "include_strings", "include_values", "include_layers", "include_features",
    "include_geometries",
)


def parse(raw: dict, base: Path | None = None) -> Manifest:
    """A manifest from its parsed form; relative paths are taken from ``base``."""
    data, render = raw.get("data") or {}, raw.get("render") or {}

    def place(name: str) -> str | None:
        return str((base or Path()) / data[name]) if data.get(name) else None

    def rule(body: dict) -> Rule:
        include = body.get("include") or "None"
        if isinstance(include, dict):
            include = tuple(sorted(include.get("Keys", ())))
        elif isinstance(include, list):
            include = tuple(sorted(include))
        maxzoom = body.get("maxzoom")
        return Rule(
            int(body["minzoom"]), None if maxzoom in (None, "") else int(maxzoom), tuple((str(k), str(v)) for k, v in body.get("tags") or ()),
            tuple(body.get("keys") or ()), tuple(body.get("values") or ()), include,
        )

    options = tuple(raw.get("report_options") or ())
    return Manifest(
        int(render["leaf_zoom"]), tuple(render.get("layer_order") or ()), {k: tuple(v or ()) for k, v in (raw.get("layers") or {}).items()},
        {k: rule(v) for k, v in (raw.get("rules") or {}).items()}, str(render.get("all_tags", "false")).lower() == "true",
        tuple(int(h) for h in data.get("include_leaves") or ()), options, place("source"), place("planet"), place("archive"),
        [f"unknown report option: {o}" for o in options if o not in OPTIONS],
    )


def load(path: str) -> Manifest:
    """A manifest file, or ``manifest.yaml`` of a directory; the planet directory is made if missing."""
    import yaml

    file = Path(path)
    if file.is_dir():
        file /= "manifest.yaml"
    found = parse(yaml.load(file.read_text(), Loader=yaml.BaseLoader), file.parent)
    if found.planet:
        Path(found.planet).mkdir(parents=True, exist_ok=True)
    return found


def to_dict(m: Manifest) -> dict:
    rules = {}
    for name, r in m.rules.items():
        include = r.include if isinstance(r.include, str) else {"Keys": list(r.include)}
        rules[name] = {"minzoom": r.minzoom, "tags": [list(t) for t in r.tags], "keys": list(r.keys), "values": list(r.values), "include": include}
        if r.maxzoom is not None:
            rules[name]["maxzoom"] = r.maxzoom
    return {
        "data": {k: v for k, v in (("source", m.source), ("planet", m.planet), ("archive", m.archive)) if v} | {"include_leaves": list(m.include_leaves)},
        "render": {"leaf_zoom": m.leaf_zoom, "layer_order": list(m.layer_order), "all_tags": m.all_tags},
        "layers": {k: list(v) for k, v in m.layers.items()},
        "rules": rules,
        "report_options": list(m.report_options),
    }


def save(m: Manifest, directory: str) -> None:
    """The manifest beside the planet it describes, so that it can be opened from there."""
    folder = Path(directory)
    folder.mkdir(parents=True, exist_ok=True)
    body = to_dict(m)
    body["data"]["planet"] = "./"
    (folder / "manifest.yaml").write_text(json.dumps(body, indent=1))


STAR = parse(
    {
        "render": {"leaf_zoom": 8, "layer_order": ["Regions", "Nations", "Urgent", "Orders", "Suppliers", "Customers", "Parts"]},
        "layers": {
            "Regions": ["region"], "Nations": ["nation", "region"], "Urgent": ["urgent"], "Orders": ["urgent", "orders_open", "orders"],
            "Suppliers": ["supplier"], "Customers": ["customer", "builder", "costumer"], "Parts": ["part", "brushed"], "Lost": ["part"],
        },
        "rules": {
            "region": {"minzoom": 0, "tags": [["type", "boundary"]], "include": "All"},
            "nation": {"minzoom": 2, "tags": [["type", "multipolygon"]], "include": {"Keys": ["name"]}},
            "a_urgent": {"minzoom": 6, "tags": [["priority", "1-URGENT"]]},
            "urgent": {"minzoom": 0, "tags": [["priority", "1-URGENT"]], "include": "All"},
            "orders_open": {"minzoom": 4, "maxzoom": 6, "values": ["O"], "include": {"Keys": ["priority", "status"]}},
            "orders": {"minzoom": 6, "keys": ["priority"]},
            "supplier": {"minzoom": 2, "values": ["supplier"], "include": {"Keys": ["nation"]}},
            "builder": {"minzoom": 4, "maxzoom": 5, "tags": [["segment", "BUILDING"]], "include": "All"},
            "customer": {"minzoom": 6, "keys": ["segment"]},
            "silent": {"minzoom": 0, "tags": [["segment", "MACHINERY"]]},
            "part": {"minzoom": 8, "keys": ["brand"], "include": "All"},
            "waterway": {"minzoom": 0}, "ferry": {"minzoom": 3, "keys": ["ferry"], "values": ["harbour"], "tags": [["route", "ferry"]]},
        },
    }
)
LISTED = (*range(65534, 0, -7), *range(0, 65536, 14), 7, 1 << 40)  # a list of leaves: unsorted, with repeats and unknown ones
