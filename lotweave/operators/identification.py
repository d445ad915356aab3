"""Causal graphs: which paths join two variables, and which sets of others block them. Graphs are a handful of nodes, on the driver."""

from __future__ import annotations

from itertools import chain, combinations

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the graph in which location L moves text T, outcome Y, property X and context C, and X and C move T and Y.
GRAPH = [("L", "X"), ("L", "C"), ("L", "T"), ("L", "Y"), ("X", "T"), ("X", "Y"), ("C", "T"), ("C", "Y")]


def paths(edges: list[tuple[str, str]], a: str, b: str) -> list[list[str]]:
    """All simple paths between two nodes, arrows either way."""
    near: dict[str, set[str]] = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    out, open_ = [], [[a]]
    while open_:
        p = open_.pop()
        if p[-1] == b:
            out.append(p)
        else:
            open_ += [[*p, n] for n in sorted(near.get(p[-1], ())) if n not in p]
    return sorted(out)


def below(edges: list[tuple[str, str]], node: str) -> set[str]:
    out, todo = set(), [node]
    while todo:
        n = todo.pop()
        if n not in out:
            out.add(n)
            todo += [v for u, v in edges if u == n]
    return out


def blocked(edges: list[tuple[str, str]], path: list[str], given: set[str]) -> bool:
    """Whether a set blocks a path: it has a node that isn't a collider, or leaves out a collider and all below it."""
    have = set(edges)
    for x, m, y in zip(path, path[1:], path[2:]):
        if (x, m) in have and (y, m) in have:
            if not below(edges, m) & given:
                return True
        elif m in given:
            return True
    return False


def separated(edges: list[tuple[str, str]], a: str, b: str, given: set[str]) -> bool:
    return all(blocked(edges, p, given) for p in paths(edges, a, b))


def minimal_sets(edges: list[tuple[str, str]], a: str, b: str) -> list[set[str]]:
    """The smallest sets that block all paths between two nodes: none of their subsets does."""
    rest = sorted({n for e in edges for n in e} - {a, b})
    out: list[set[str]] = []
    for s in chain.from_iterable(combinations(rest, k) for k in range(len(rest) + 1)):
        if separated(edges, a, b, set(s)) and not any(o <= set(s) for o in out):
            out.append(set(s))
    return out


def path_table(spark: SparkSession, edges: list[tuple[str, str]], a: str, b: str, given: set[str]) -> DataFrame:
    """(path, blocked)"""
    return spark.createDataFrame([("-".join(p), blocked(edges, p, given)) for p in paths(edges, a, b)], "path string, blocked boolean")


def directed_paths(edges: list[tuple[str, str]], a: str, b: str) -> list[list[str]]:
    """The simple paths from a to b along the arrows; none means that a does nothing to b."""
    have = set(edges)
    return [p for p in paths(edges, a, b) if all(step in have for step in zip(p, p[1:]))]


def is_backdoor_set(edges: list[tuple[str, str]], a: str, b: str, given: set[str]) -> bool:
    """Whether a set blocks every path into a, and nothing below a is in it."""
    into = [p for p in paths(edges, a, b) if (p[1], a) in set(edges)]
    return not (below(edges, a) - {a}) & given and all(blocked(edges, p, given) for p in into)
