"""Diagram text to graphs: a small Mermaid flowchart reader, cycle breaking and graph checks for one diagram at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.text import actor_of_node, fenced_diagram

#: Lines that declare no nodes or edges, by their first word.
SKIPPED = ("graph", "flowchart", "style", "classdef", "linkstyle", "class", "subgraph", "direction", "end", "%%")
_ID = r"[A-Za-z_][\w-]*?"
_NODE = re.compile(r"([A-Za-z_]\w*)\s*(?:\(\[|\[\[|\(\(|\[\(|\{\{|\[|\(|\{|>)+\s*\"?(.*?)\"?\s*(?:\]\)|\]\]|\)\)|\)\]|\}\}|\]|\)|\})+")
_ARROW = re.compile(r"\s*<?(?:-{2,}|={2,}|-\.+-?)(?:>|x|o)?\s*")
_PIPE = re.compile(r"\|[^|]*\|")


def parse(text: str | None) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Nodes (id, label) in order of appearance and distinct edges of a flowchart.

    The last non-empty label of a node wins; chains give one edge per arrow; a token between arrows that is no identifier
    breaks the chain; an inline edge label ('A -- yes --> B') is read as a node of its own, as the source notation is ambiguous.
    """
    labels: dict[str, str] = {}
    edges: dict[tuple[str, str], None] = {}
    for line in re.split(r"[\n;]", text or ""):
        line = line.strip()
        if not line or line.split(None, 1)[0].lower().startswith("%%") or line.split(None, 1)[0].lower() in SKIPPED:
            continue
        for name, label in _NODE.findall(line):
            if label.strip() or name not in labels:
                labels[name] = label.strip() or labels.get(name, "")
        bare = _PIPE.sub("", _NODE.sub(r"\1", line))
        before: list[str] = []
        for part in _ARROW.split(bare):
            now = [x.strip() for x in part.split("&")]
            if not all(re.fullmatch(r"[A-Za-z_]\w*", x) for x in now):
                before = []
                continue
            for x in now:
                labels.setdefault(x, "")
            for a in before:
                for b in now:
                    edges[a, b] = None
            before = now
    return list(labels.items()), list(edges)


def break_cycles(nodes: list[str], edges: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(kept, removed) edges: depth-first from the nodes in order, along edges in order, the last edge of the first cycle found goes, until none is left."""
    kept, removed = list(edges), []
    while True:
        down: dict[str, list[str]] = {}
        for a, b in kept:
            down.setdefault(a, []).append(b)
        state: dict[str, int] = {}
        found = None
        for root in nodes:
            if found or root in state:
                continue
            stack: list[tuple[str, Iterator[str]]] = [(root, iter(down.get(root, ())))]
            state[root] = 1
            while stack and not found:
                v, it = stack[-1]
                w = next(it, None)
                if w is None:
                    state[v] = 2
                    stack.pop()
                elif state.get(w) == 1:
                    found = (v, w)
                elif w not in state:
                    state[w] = 1
                    stack.append((w, iter(down.get(w, ()))))
        if not found:
            return kept, removed
        kept.remove(found)
        removed.append(found)


def _parse_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, t in zip(b["diagram_id"], b["text"]):
            nodes, edges = parse(t)
            rows += [(i, "node", k, v, label) for k, (v, label) in enumerate(nodes)]
            rows += [(i, "edge", k, a, c) for k, (a, c) in enumerate(edges)]
        yield pd.DataFrame(rows, columns=["diagram_id", "kind", "ord", "a", "b"])


def mermaid(diagrams: DataFrame) -> DataFrame:
    """(diagram_id, kind, ord, a, b, actor) of (diagram_id long, text): nodes as (id, label) with their actor, edges as (from, to)."""
    d = diagrams.where("diagram_id is not null").select("diagram_id", fenced_diagram(F.coalesce("text", F.lit(""))).alias("text"))
    r = d.mapInPandas(_parse_rows, "diagram_id long, kind string, ord long, a string, b string")
    return r.withColumn("actor", F.when(F.col("kind") == "node", actor_of_node(F.col("a"))))


def _break_rows(b: pd.DataFrame) -> pd.DataFrame:
    nodes = b[b["src"].isna()].sort_values("dst")["dst"].tolist()
    e = b[b["src"].notna()].sort_values(["src", "dst"])
    _, gone = break_cycles(nodes, list(zip(e["src"], e["dst"])))
    e = e.assign(removed=[x in set(gone) for x in zip(e["src"], e["dst"])])
    return e[["dag_id", "src", "dst", "removed"]]


def acyclic_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (dag_id, src, dst) with removed: those broken out of cycles; nodes and edges are visited in order of their ids. A graph is one task's work."""
    n = nodes.select("dag_id", F.lit(None).cast("string").alias("src"), F.col("node_id").alias("dst")).distinct()
    return n.unionByName(edges.select("dag_id", "src", "dst").distinct()).groupBy("dag_id").applyInPandas(_break_rows, "dag_id long, src string, dst string, removed boolean")
