"""Flagship composition: assemble a tree from prioritised layers, then gate its scripts.

Plan shape: one scan per input, one keyed aggregate (the overlay, however
the replace/newer layers are mixed), then narrow gate columns. The gate
summary (readiness) is a separate small aggregate over the rejected rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.overlay import layered_overlay, layered_overlay_late, union_layers, with_position
from strata.operators.quality import readiness
from strata.operators.scripts import REJECT, gate_scripts


def assemble(layers: Sequence[DataFrame], path: str = "path", priority: str = "priority",
             tiebreak: Sequence[str] = (), newer: Sequence[int] = (), ts: str = "mtime",
             content: str = "content", managed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Overlay the layers (union by name; ``priority`` orders them, ``newer``
    marks newer-wins ones, configuration layers simply get the highest
    priorities) and add the script ``gate`` column to the merged tree."""
    merged = layered_overlay(union_layers(*layers), [path], priority=priority, tiebreak=tiebreak,
                             newer=newer, ts=ts)
    return gate_scripts(merged, path=path, content=content, managed=managed)


def assemble_late(layers: Sequence[DataFrame], path: str = "path", priority: str = "priority",
                  tiebreak: Sequence[str] = (), newer: Sequence[int] = (), ts: str = "mtime",
                  content: str = "content", managed: Callable[[Column], Column] | None = None, by_row: bool = True) -> DataFrame:
    """``assemble`` for large contents: each layer is a file scan, and contents
    are read for the merged tree only (``overlay.layered_overlay_late``)."""
    placed = union_layers(*(with_position(x, by_row) for x in layers))
    merged = layered_overlay_late(placed, [path], [content], priority=priority, tiebreak=tiebreak, newer=newer, ts=ts)
    return gate_scripts(merged, path=path, content=content, managed=managed)


#: The layers of the assembly, low to high, with the directory each goes to; a
#: directory of None keeps the layer's own paths.
CHAIN = (("core", None), ("plugins", None), ("sites", None), ("third_party_jars", None), ("build_config", None), ("project", None),
         ("sql", "WEB-INF/sql/"), ("site_docs", "doc/xml/"), ("classes", "WEB-INF/classes/"), ("default_conf", None), ("local_conf", None))
FIRST_RUN_NEWER = ("third_party_jars", "classes")
LATER_RUN_NEWER = ("third_party_jars", "project", "sql", "site_docs", "classes")
LATER_RUN_SKIPS = ("core", "plugins", "sites")


def assemble_chain(trees: Mapping[str, DataFrame], target: DataFrame | None = None, path: str = "path", ts: str = "mtime",
                   tiebreak: Sequence[str] = (), place: bool = True) -> DataFrame:
    """The whole chain of layers, by name, as one overlay.

    First run (no ``target``): all layers; third-party jars and classes win only
    if newer. Later run: ``target`` is what the last run made; core, plugins and
    sites are not taken again, and project files, sql and site docs win only if
    newer as well. ``place`` puts a layer's paths under its directory. Within
    plugins and sites ``tiebreak`` decides between equal paths.
    """
    names = [n for n, _ in CHAIN]
    if unknown := set(trees) - set(names):
        raise ValueError(f"unknown layers {sorted(unknown)}; known: {', '.join(names)}")
    layers = [] if target is None else [target.withColumns({"layer": F.lit("target"), "priority": F.lit(0)})]
    for i, (name, directory) in enumerate(CHAIN, start=1):
        if name in trees and (target is None or name not in LATER_RUN_SKIPS):
            tree = trees[name].withColumns({"layer": F.lit(name), "priority": F.lit(i)})
            layers.append(tree.withColumn(path, F.concat(F.lit(directory), path)) if place and directory else tree)
    newer = [names.index(n) + 1 for n in (FIRST_RUN_NEWER if target is None else LATER_RUN_NEWER)]
    return layered_overlay(union_layers(*layers), [path], tiebreak=tiebreak, newer=newer, ts=ts)


def assemble_readiness(assembled: DataFrame, path: str = "path") -> DataFrame:
    """The readiness row of an assembled tree."""
    return readiness(assembled.where(assembled["gate"] == REJECT), path=path)
