"""Compiling rules to lookup tables and classifying entities by them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.sources.manifest import Manifest, parse, to_dict

NO_RULE = "no_rule"
TAG, VALUE, KEY = 0, 1, 2


def criteria(m: Manifest) -> dict[tuple, str]:
    """(class, k, v) of each criterion to its rule; of rules with the same one the last by name wins."""
    rows: dict[tuple, str] = {}
    for name in sorted(m.rules):
        rule = m.rules[name]
        rows |= {(TAG, k, v): name for k, v in rule.tags}
        rows |= {(VALUE, None, v): name for v in rule.values}
        rows |= {(KEY, k, None): name for k in rule.keys}
    return rows


def lookups(spark: SparkSession, m: Manifest) -> DataFrame:
    """class, k, v, rule: what each criterion leads to. One row per criterion, so it is as small as the manifest."""
    return spark.createDataFrame([(*key, name) for key, name in criteria(m).items()], "class int, k string, v string, rule string")


def evals(spark: SparkSession, m: Manifest) -> DataFrame:
    """rule, minzoom, maxzoom, include, include_keys; no_rule shows at leaf zoom only, with all tags."""
    rows = [(NO_RULE, m.leaf_zoom, m.leaf_zoom, "All", [])]
    for name in sorted(m.rules):
        r = m.rules[name]
        kind, keys = (r.include, []) if isinstance(r.include, str) else ("Keys", list(r.include))
        rows.append((name, r.minzoom, m.leaf_zoom if r.maxzoom is None else r.maxzoom, kind, keys))
    return spark.createDataFrame(rows, "rule string, minzoom int, maxzoom int, include string, include_keys array<string>")


def layer_rules(spark: SparkSession, m: Manifest) -> DataFrame:
    """layer_pos, layer, rule: known layers in order, no_rule first; a layer outside layer_order is left out."""
    order = [NO_RULE, *m.layer_order]
    rows = {(0, NO_RULE, NO_RULE)}
    rows |= {(order.index(layer), layer, rule) for layer, names in m.layers.items() if layer in order for rule in names if rule in m.rules}
    return spark.createDataFrame(sorted(rows), "layer_pos int, layer string, rule string")


def layer_warnings(spark: SparkSession, m: Manifest) -> DataFrame:
    """kind, name: layers that are not in layer_order, and layers' rules that don't exist."""
    rows = [("layer", layer) for layer in sorted(set(m.layers) - set(m.layer_order))]
    rows += sorted({("rule", rule) for names in m.layers.values() for rule in names if rule not in m.rules})
    return spark.createDataFrame(rows, "kind string, name string")


def rule_strings(spark: SparkSession, m: Manifest) -> DataFrame:
    """s: every key and value that a rule names."""
    found = {s for r in m.rules.values() for s in (*r.keys, *r.values, *(x for t in r.tags for x in t))}
    return spark.createDataFrame([(s,) for s in sorted(found)], "s string")


def unmatched(strings: DataFrame, tagged: DataFrame) -> DataFrame:
    """The strings of the rules that no tag has. Keys and values are made distinct before they meet the few strings."""
    tags = tagged.select(F.explode("tags").alias("t"))
    seen = tags.select(F.explode(F.array("t.k", "t.v")).alias("s")).distinct()
    return strings.join(seen, "s", "left_anti")


def classify(tagged: DataFrame, m: Manifest) -> DataFrame:
    """``tagged`` (kind, osm_id, tags) with rule: tag criteria before values before keys, then the order of tags.

    The three lookups fold to maps of the manifest's size and tags are matched within the row: no join, no
    shuffle, and no explosion of tags.
    """
    found = criteria(m)
    maps = {c: {(k, v): rule for (kind, k, v), rule in found.items() if kind == c} for c in (TAG, VALUE, KEY)}

    def table(items: dict[str, str]):
        if not items:
            return F.create_map().cast("map<string,string>")
        return F.create_map(*[F.lit(x) for pair in items.items() for x in pair])

    by_tag = table({f"{k}\x00{v}": rule for (k, v), rule in maps[TAG].items()})
    by_value = table({v: rule for (_, v), rule in maps[VALUE].items()})
    by_key = table({k: rule for (k, _), rule in maps[KEY].items()})

    def first(lookup, name):
        hits = F.filter(F.transform("tags", lambda t: F.try_element_at(lookup, name(t))), lambda x: x.isNotNull())
        return F.get(hits, F.lit(0))

    won = F.coalesce(
        first(by_tag, lambda t: F.concat(t["k"], F.lit("\x00"), t["v"])),
        first(by_value, lambda t: t["v"]),
        first(by_key, lambda t: t["k"]),
        F.lit(NO_RULE),
    )
    return tagged.withColumn("rule", won)


def save(m: Manifest, directory: str) -> None:
    """The rules and layers beside the planet that was built with them."""
    body = to_dict(m)
    folder = Path(directory)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "rules.json").write_text(json.dumps({k: body[k] for k in ("render", "layers", "rules")}, indent=1))


def open_saved(directory: str) -> Manifest:
    """The rules of a planet; a missing or unreadable file gives the defaults: no rule but no_rule, at leaf zoom 12."""
    try:
        return parse(json.loads((Path(directory) / "rules.json").read_text()))
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return parse({"render": {"leaf_zoom": 12}})
