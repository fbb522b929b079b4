"""Selections: selector strings, boolean group expressions and combinations, parsed once into Columns.

Selector clauses are joined by `;` and all must hold. `type:`, `mol:` and `id:` take lists of numbers and inclusive
ranges; `region:` takes a box, slab or sphere in wrapped coordinates. A leading `selection_mode:` clause says whether a
group is evaluated on the first frame alone (static, the default) or on every frame.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, distance_squared, wrap

FIELDS = {"type": "type", "mol": "mol", "molecule": "mol", "id": "id"}
STATIC, DYNAMIC = "static", "dynamic"


class SelectionError(ValueError):
    pass


def _number(text: str, kind: type = int):
    try:
        return kind(text.strip())
    except ValueError:
        raise SelectionError(f"not a number: {text!r}") from None


def _ranges(text: str) -> list[tuple[int, int]] | None:
    """None for `*`; reversed ranges are turned round."""
    if text.strip() == "*":
        return None
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        a, dash, b = part.partition("-")
        low, high = (_number(a), _number(b)) if dash else (_number(a), _number(a))
        out.append((min(low, high), max(low, high)))
    return out


@dataclass
class Selector:
    mode: str | None = None
    ranges: dict[str, list[tuple[int, int]]] = field(default_factory=dict)
    region: tuple[str, tuple] | None = None

    @property
    def spatial(self) -> bool:
        return self.region is not None

    def column(self, box: Box | None = None) -> Column:
        """The selector over columns type, mol, id and, for a region, x, y, z."""
        terms: list[Column] = []
        for name, ranges in self.ranges.items():
            terms.append(reduce(lambda a, b: a | b, (F.col(name).between(a, b) for a, b in ranges), F.lit(False)))
        if self.region:
            if box is None:
                raise SelectionError("a region needs a box")
            p = wrap(box, F.col("x"), F.col("y"), F.col("z"))
            shape, v = self.region
            if shape == "box":
                terms += [c.between(float(v[2 * k]), float(v[2 * k + 1])) for k, c in enumerate(p)]
            elif shape == "slab":
                terms.append(p["xyz".index(v[0])].between(float(v[1]), float(v[2])))
            else:
                center = wrap(box, *(F.lit(float(c)) for c in v[:3]))
                terms.append(distance_squared(box, p, center) <= float(v[3]) ** 2)
        return reduce(lambda a, b: a & b, terms, F.lit(True))


def _region(text: str) -> tuple[str, tuple]:
    shape, *args = (p.strip() for p in text.split(","))
    if shape == "box" and len(args) == 6:
        v = [_number(a, float) for a in args]
        return shape, tuple(x for k in (0, 2, 4) for x in sorted(v[k : k + 2]))
    if shape == "slab" and len(args) == 3 and args[0] in ("x", "y", "z"):
        return shape, (args[0], *sorted(_number(a, float) for a in args[1:]))
    if shape == "sphere" and len(args) == 4:
        v = tuple(_number(a, float) for a in args)
        if v[3] < 0:
            raise SelectionError("a sphere's radius is not negative")
        return shape, v
    raise SelectionError(f"not a region: {text!r}")


def parse_selector(text: str) -> Selector:
    out = Selector()
    for i, clause in enumerate(filter(None, (c.strip() for c in text.split(";")))):
        if clause in ("*", "all"):
            continue
        name, colon, rest = clause.partition(":")
        name = name.strip()
        if not colon:
            raise SelectionError(f"not a clause: {clause!r}")
        if name == "selection_mode":
            if i or rest.strip() not in (STATIC, DYNAMIC):
                raise SelectionError("selection_mode leads, and is static or dynamic")
            out.mode = rest.strip()
        elif name in FIELDS:
            ranges = _ranges(rest)
            if ranges is not None:
                out.ranges.setdefault(FIELDS[name], []).extend(ranges)
        elif name == "region":
            out.region = _region(rest)
        else:
            raise SelectionError(f"unknown field: {name!r}")
    return out


# --- boolean expressions ------------------------------------------------------------------------------------------

Tree = tuple  # ("name", n) | ("and", a, b) | ("or", a, b) | ("not", a)
_TOKEN = re.compile(r"\s*(?:([&|!()])|([^\s&|!()]+))")


def parse_boolean(text: str, negation: bool) -> Tree:
    """`|` of `&` of names and parentheses; `!` only where negation is allowed."""
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SelectionError(f"cannot read {text!r}")
        tokens.append(m.group(1) or m.group(2))
        at = m.end()
    spot = 0

    def peek() -> str | None:
        return tokens[spot] if spot < len(tokens) else None

    def take() -> str:
        nonlocal spot
        spot += 1
        return tokens[spot - 1]

    def chain(op: str, name: str, below) -> Tree:
        left = below()
        while peek() == op:
            take()
            left = (name, left, below())
        return left

    def factor() -> Tree:
        t = peek()
        if t == "(":
            take()
            inner = either()
            if peek() != ")":
                raise SelectionError(f"unbalanced parentheses in {text!r}")
            take()
            return inner
        if t == "!" and negation:
            take()
            return ("not", factor())
        if t is None or t in "&|!)":
            raise SelectionError(f"a name is missing in {text!r}")
        return ("name", take())

    def both() -> Tree:
        return chain("&", "and", factor)

    def either() -> Tree:
        return chain("|", "or", both)

    tree = either()
    if peek() is not None:
        raise SelectionError(f"something follows the expression in {text!r}")
    return tree


def names_of(tree: Tree) -> set[str]:
    return {tree[1]} if tree[0] == "name" else set().union(*(names_of(t) for t in tree[1:]))


def to_column(tree: Tree, columns: dict[str, Column]) -> Column:
    if tree[0] == "name":
        if tree[1] not in columns:
            raise SelectionError(f"unknown group {tree[1]!r}")
        return columns[tree[1]]
    parts = [to_column(t, columns) for t in tree[1:]]
    return ~parts[0] if tree[0] == "not" else parts[0] & parts[1] if tree[0] == "and" else parts[0] | parts[1]


def parse_combine(text: str) -> Tree:
    """An expression over A and T, in either case; empty means A&T."""
    tree = parse_boolean((text.strip() or "A&T").upper(), negation=True)
    if not names_of(tree) <= {"A", "T"}:
        raise SelectionError("a combination knows A and T only")
    return tree


def canonical(tree: Tree) -> str:
    if tree[0] == "name":
        return tree[1]
    if tree[0] == "not":
        return "!" + (canonical(tree[1]) if tree[1][0] in ("name", "not") else f"({canonical(tree[1])})")
    op = {"and": "&", "or": "|"}[tree[0]]
    part = lambda t: f"({canonical(t)})" if tree[0] == "and" and t[0] == "or" else canonical(t)
    return part(tree[1]) + op + part(tree[2])


def selection_key(atom_group: str, topo_group: str, combine: str) -> str:
    return f"A={atom_group};T={topo_group};combine={canonical(parse_combine(combine))}"


# --- groups -------------------------------------------------------------------------------------------------------


class Groups:
    """Named atom groups: selectors (with a colon) and expressions over other groups.

    Static groups are evaluated on the first frame and become sets of ids; dynamic ones are Columns per frame."""

    def __init__(self, definitions: dict[str, str], atoms: DataFrame, positions: DataFrame, box: Box | None = None):
        self.atoms, self.positions, self.box = atoms, positions, box
        self.definitions = {"all": "*", **definitions}
        self.parsed: dict[str, tuple[str, Selector | Tree]] = {}
        for name, text in self.definitions.items():
            mode = None
            m = re.match(r"\s*selection_mode\s*:\s*(\w+)\s*;?", text)
            body = text
            if m:
                mode, body = m.group(1), text[m.end() :]
                if mode not in (STATIC, DYNAMIC):
                    raise SelectionError("selection_mode is static or dynamic")
            what = parse_selector(body) if ":" in body or body.strip() in ("", "*", "all") else parse_boolean(body, negation=False)
            self.parsed[name] = (mode or STATIC, what)
        if not isinstance(self.parsed["all"][1], Selector) or self.parsed["all"][0] != STATIC:
            raise SelectionError("the group all is a static selector")
        for name in self.parsed:
            self._check(name, ())

    def _check(self, name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise SelectionError("groups refer to each other in a circle: " + " > ".join((*path, name)))
        if name not in self.parsed:
            raise SelectionError(f"unknown group {name!r}")
        mode, what = self.parsed[name]
        if isinstance(what, tuple):
            for other in names_of(what):
                self._check(other, (*path, name))
                if mode == STATIC and self.is_dynamic(other):
                    raise SelectionError(f"static group {name!r} refers to dynamic {other!r}")

    def is_dynamic(self, name: str) -> bool:
        if name not in self.parsed:
            raise SelectionError(f"unknown group {name!r}")
        return self.parsed[name][0] == DYNAMIC

    def _column(self, name: str) -> Column:
        what = self.parsed[name][1]
        if isinstance(what, Selector):
            return what.column(self.box)
        return to_column(what, {n: self._column(n) for n in names_of(what)})

    def ids(self, name: str) -> DataFrame:
        """Ids of a static group, as of the first frame."""
        self._check(name, ())
        if self.is_dynamic(name):
            raise SelectionError(f"group {name!r} is dynamic")
        first = self.positions.filter("frame = 0").join(self.atoms.select("id", "type", "mol"), "id")
        return first.filter(self._column(name)).select("id")

    def members(self, name: str) -> DataFrame:
        """(frame, id) of the group in every frame."""
        frames = self.positions.select("frame", "id", "x", "y", "z").join(self.atoms.select("id", "type", "mol"), "id")
        if not self.is_dynamic(name):
            return frames.join(self.ids(name), "id", "left_semi").select("frame", "id")
        what = self.parsed[name][1]
        if isinstance(what, Selector):
            return frames.filter(what.column(self.box)).select("frame", "id")
        flagged, columns = frames, {}
        for n in sorted(names_of(what)):
            if self.is_dynamic(n):
                inner = self.parsed[n][1]
                columns[n] = self._column(n) if isinstance(inner, Selector) else self._column(n)
            else:  # frozen on the first frame
                flagged = flagged.join(self.ids(n).withColumn(f"__{n}", F.lit(True)), "id", "left")
                columns[n] = F.coalesce(F.col(f"__{n}"), F.lit(False))
        return flagged.filter(to_column(what, columns)).select("frame", "id")

    def sizes(self, name: str) -> DataFrame:
        """frame and n_selected, frames without members too."""
        counted = self.members(name).groupBy("frame").agg(F.count("*").alias("n"))
        return self.positions.select("frame").distinct().join(counted, "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("n_selected"))


def combined_ids(atoms: DataFrame, a: DataFrame, t: DataFrame, combine: str) -> DataFrame:
    """Ids of the universe for which the combination of memberships in a and t holds."""
    tree = parse_combine(combine)
    flags = atoms.select("id").join(a.select("id").distinct().withColumn("A", F.lit(True)), "id", "left").join(t.select("id").distinct().withColumn("T", F.lit(True)), "id", "left")
    held = {n: F.coalesce(F.col(n), F.lit(False)) for n in ("A", "T")}
    return flags.filter(to_column(tree, held)).select("id")


def inline_is_dynamic(selector: str) -> bool:
    """A measure's unnamed selector follows the frames exactly if it has a region."""
    return parse_selector(selector).spatial
