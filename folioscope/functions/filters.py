"""Boolean text filters written as plain data and compiled to one Spark Column.

A filter is a leaf dict ``{"value": str, "match": kind, "negate": bool}`` or a group
``{"operator": "and" | "or", "children": [...], "negate": bool}``. Kinds: ``contains``
(default; ``%`` and ``_`` are literal), ``like`` (the user's own wildcards),
``regex``, ``glob`` and ``near`` (``left`` and ``right`` filters-by-word within
``words`` of one another). Negating a group negates all of it. An empty group is true.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH, MAX_NODES, MAX_WILDCARDS, MAX_COST = 5, 50, 10, 100


def any_of(*values: str) -> dict:
    return {"operator": "or", "children": [{"value": v} for v in values]}


def all_of(*children: dict) -> dict:
    return {"operator": "and", "children": list(children)}


def none_of(*values: str) -> dict:
    return {"operator": "or", "children": [{"value": v} for v in values], "negate": True}


def near(left: str, right: str, words: int) -> dict:
    return {"match": "near", "left": left, "right": right, "words": words}


def like_pattern(value: str) -> str:
    """A containment pattern in which the value's own wildcards are literal."""
    return "%" + re.sub(r"([\\%_])", r"\\\1", value) + "%"


def glob_pattern(value: str) -> str:
    return "(?i)^" + ".*".join(re.escape(p) for p in value.split("*")) + "$"


def near_pattern(left: str, right: str, words: int) -> str:
    """Either order, with at most ``words - 1`` words between; words are runs of letters and digits."""
    a, b = re.escape(left), re.escape(right)
    gap = f"[^A-Za-z0-9]+(?:[A-Za-z0-9]+[^A-Za-z0-9]+){{0,{words - 1}}}"
    edge = "(?:^|[^A-Za-z0-9])", "(?:[^A-Za-z0-9]|$)"
    return f"(?i){edge[0]}(?:{a}{gap}{b}|{b}{gap}{a}){edge[1]}"


def leaf(column: Column, node: dict) -> Column:
    kind = node.get("match", "contains")
    if kind == "near":
        out = column.rlike(near_pattern(node["left"], node["right"], node["words"]))
    elif kind == "like":
        out = column.ilike(node["value"])
    elif kind == "regex":
        out = column.rlike("(?i)" + node["value"])
    elif kind == "glob":
        out = column.rlike(glob_pattern(node["value"]))
    elif kind == "contains":
        out = column.ilike(like_pattern(node["value"]))
    else:
        raise ValueError(f"unknown match kind {kind!r}")
    return ~out if node.get("negate") else out


def compiled(column: Column | str, node: dict) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    if "operator" not in node:
        return leaf(column, node)
    join = (lambda a, b: a | b) if node["operator"] == "or" else (lambda a, b: a & b)
    parts = [compiled(column, c) for c in node["children"]]
    out = reduce(join, parts) if parts else F.lit(True)
    return ~out if node.get("negate") else out


def nodes(node: dict, path: str = "0"):
    """(path, node) of the filter and all below it."""
    yield path, node
    for i, child in enumerate(node.get("children", [])):
        yield from nodes(child, f"{path}.{i}")


def explained(column: str, node: dict) -> tuple[dict[str, Column], dict[str, Column]]:
    """(columns of the leaves by name, verdict of each node by path, over those names): each leaf is evaluated once."""
    leaves: dict[str, Column] = {}
    verdicts: dict[str, Column] = {}

    def visit(path: str, node: dict) -> Column:
        if "operator" not in node:
            name = f"leaf_{path.replace('.', '_')}"
            leaves[name] = leaf(F.col(column), node)
            verdicts[path] = F.col(name)
            return verdicts[path]
        join = (lambda a, b: a | b) if node["operator"] == "or" else (lambda a, b: a & b)
        parts = [visit(f"{path}.{i}", c) for i, c in enumerate(node["children"])]
        out = reduce(join, parts) if parts else F.lit(True)
        verdicts[path] = ~out if node.get("negate") else out
        return verdicts[path]

    visit("0", node)
    return leaves, dict(sorted(verdicts.items()))


def left_to_right(column: str, terms: list[tuple[str, str]]) -> Column:
    """[("", a), ("or", b), ("and not", c)] strictly from left to right, without precedence."""
    out = None
    for word, value in terms:
        term = leaf(F.col(column), {"value": value, "negate": word.endswith("not")})
        out = term if out is None else (out | term if word.startswith("or") else out & term)
    return F.lit(True) if out is None else out


def cost(node: dict) -> int:
    """1 for a leaf, 2 more with a wildcard, 3 more for a regular expression, 5 for proximity, 1 for a group."""
    if "operator" in node:
        return 1 + sum(map(cost, node["children"]))
    if node.get("match") == "near":
        return 7
    return 1 + 2 * bool(set(node["value"]) & set("*%")) + 3 * (node.get("match") == "regex")


def problems(node: dict) -> list[str]:
    """What the limits and the form of the filter forbid; empty if nothing."""
    out = []
    every = list(nodes(node))
    if max(p.count(".") for p, _ in every) >= MAX_DEPTH:
        out.append("nested too deeply")
    if len(every) > MAX_NODES:
        out.append("too many nodes")
    if sum(set(n.get("value", "")) & set("*%") != set() for _, n in every) > MAX_WILDCARDS:
        out.append("too many wildcards")
    if cost(node) > MAX_COST:
        out.append("too costly")
    if any("operator" in n and not n["children"] for _, n in every):
        out.append("empty group")
    if any("operator" not in n and n.get("match") != "near" and not n.get("value") for _, n in every):
        out.append("empty value")
    return out


def number_filter(column: Column | str, operator: str, value: float) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return {">": column > value, "<": column < value, ">=": column >= value, "<=": column <= value, "=": column == value}[operator]


def from_terms(terms: list[tuple[str, str]]) -> dict:
    """[("", a), ("or", b), ("and", c), ("and not", d)]: runs of "or" bind first, then "and"."""
    groups: list[list[dict]] = []
    for word, value in terms:
        node = {"value": value, "negate": word.endswith("not")}
        if word == "or" and groups:
            groups[-1].append(node)
        else:
            groups.append([node])
    return all_of(*(g[0] if len(g) == 1 else {"operator": "or", "children": g} for g in groups))


ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_value(text: str) -> int | None:
    """The value of a well-formed roman numeral of either case, null for anything else."""
    text = text.upper()
    if not text or not re.fullmatch("M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})", text):
        return None
    values = [ROMAN[c] for c in text]
    return sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0], strict=True))


def article_filter(value: str, number: str = "article_num", title: str = "title", concept: str = "concept", negate: bool = False) -> Column:
    """Title or concept contains the value, or it names the article's number ("3", "III", "Article III")."""
    word = re.sub(r"(?i)^article\s+", "", value).strip()
    n = int(word) if word.isdigit() else roman_value(word)
    out = F.coalesce(F.col(title).ilike(like_pattern(value)), F.lit(False)) | F.coalesce(F.col(concept).ilike(like_pattern(value)), F.lit(False))
    if n is not None:
        out = out | (F.col(number) == n)
    return ~out if negate else out
