"""Texts and reply schemas for labelling and judging calls: rendered by column expressions, checked by plain dictionaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name an empty list of allowed labels gets, and the scores a verdict may have.
NO_LABEL, SCORES = "__none__", [-1, 0, 1]


def taxonomy_block(name: str, entries: Column) -> Column:
    """'name: (empty)' or the name over one bullet per (label, description)."""
    line = F.transform(entries, lambda e: F.concat(F.lit("- "), e["label"], F.when(F.coalesce(e["description"], F.lit("")) != "", F.concat(F.lit(": "), e["description"])).otherwise("")))
    return F.when(F.coalesce(F.size(entries), F.lit(0)) <= 0, F.lit(f"{name}: (empty)")).otherwise(F.concat(F.lit(f"{name}:\n"), F.array_join(line, "\n")))


def numbered(texts: Column) -> Column:
    """One line '1. text' per element."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(t, F.lit("")))), "\n")


def judge_transcript(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda u, i: F.concat(F.lit("["), i.cast("string"), F.lit("] ("), u["actor"], F.lit(") "), F.coalesce(u["text"], F.lit("")))), "\n")


def judge_rules(rules: Column) -> Column:
    """One line 'id [kind]: text' per rule."""
    return F.array_join(F.transform(rules, lambda r: F.concat(r["rule_id"], F.lit(" ["), r["kind"], F.lit("]: "), F.coalesce(r["text"], F.lit("")))), "\n")


def checklist_prompt(phase: Column, nodes: Column, edges: Column) -> Column:
    """A graph and its phase, for turning the graph into rules."""
    n = F.array_join(F.transform(nodes, lambda v: F.concat(v["node_id"], F.lit(" ("), F.coalesce(v["actor"], F.lit("unknown")), F.lit("): "), F.coalesce(v["label"], F.lit("")))), "\n")
    e = F.array_join(F.transform(edges, lambda x: F.concat(x["src"], F.lit(" -> "), x["dst"])), "\n")
    return F.concat(F.lit("Phase: "), phase, F.lit("\n\nNodes:\n"), n, F.lit("\n\nEdges:\n"), e)


def whole_dialogue_prompt(block: Column, dialogue: Column, n: Column) -> Column:
    return F.concat(F.lit("Labels:\n"), block, F.lit("\n\nConversation:\n"), dialogue, F.lit("\n\nGive one label for each of the "), n.cast("string"), F.lit(" turns."))


def window_prompt(block: Column, window: Column, target: Column) -> Column:
    """The turns around one, the one to label marked by an arrow; target is its index inside the window."""
    lines = F.array_join(F.transform(window, lambda u, i: F.concat(F.when(i == target, "> ").otherwise("  "), F.lit("("), u["actor"], F.lit(") "), F.coalesce(u["text"], F.lit("")))), "\n")
    return F.concat(F.lit("Labels:\n"), block, F.lit("\n\nContext:\n"), lines, F.lit("\n\nGive the label of the marked turn."))


def _allowed(labels: list[str]) -> list[str]:
    return sorted(set(labels)) or [NO_LABEL]


def whole_schema(user: list[str], agent: list[str], n: int) -> dict:
    """A reply of exactly n labels, each from either list."""
    return {"type": "object", "properties": {"labels": {"type": "array", "minItems": n, "maxItems": n, "items": {"type": "string", "enum": _allowed([*user, *agent])}}}, "required": ["labels"], "additionalProperties": False}


def window_schema(labels: list[str]) -> dict:
    return {"type": "object", "properties": {"label": {"type": "string", "enum": _allowed(labels)}}, "required": ["label"], "additionalProperties": False}


def agent_schema(agent: list[str], turns: list[int]) -> dict:
    """A reply of (index, label) for the agent's turns only."""
    item = {"type": "object", "properties": {"index": {"type": "integer", "enum": turns}, "label": {"type": "string", "enum": _allowed(agent)}}, "required": ["index", "label"], "additionalProperties": False}
    return {"type": "object", "properties": {"labels": {"type": "array", "minItems": len(turns), "maxItems": len(turns), "items": item}}, "required": ["labels"], "additionalProperties": False}


def verdict_schema(rules: list[str]) -> dict:
    item = {"type": "object", "properties": {"rule_id": {"type": "string", "enum": _allowed(rules)}, "score": {"type": "integer", "enum": SCORES}, "justification": {"type": "string"}}, "required": ["rule_id", "score", "justification"], "additionalProperties": False}
    return {"type": "object", "properties": {"verdicts": {"type": "array", "items": item}}, "required": ["verdicts"], "additionalProperties": False}


def checklist_schema() -> dict:
    item = {"type": "object", "properties": {"id": {"type": "string"}, "kind": {"type": "string", "enum": ["presence", "transition"]}, "text": {"type": "string"}}, "required": ["id", "kind", "text"], "additionalProperties": False}
    return {"type": "object", "properties": {"rules": {"type": "array", "items": item}}, "required": ["rules"], "additionalProperties": False}
