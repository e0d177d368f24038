"""Rules that rewrite rows: the best matching rule of a row, and its assignments."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_name
from ..functions.scalars import header_token, number_text, parse_number
from ..functions.search import count_upto

#: Groups up to which matching is one expression of the plan; more are looked up in a table.
COMPILED = 48
#: Rows of a table of rules up to which it is broadcast: settings read from files, well under 100 MB.
BROADCAST_ROWS = 50_000


@dataclass(frozen=True)
class Rule:
    """A rule matches if all conditions of some group hold; then its fields are set.

    A condition (field, low, high) holds for numbers equal to low if low = high, else in
    [low, high). Each field may be given several values.
    """

    name: str
    groups: tuple[tuple[tuple[str, float, float], ...], ...]
    assignments: dict[str, tuple[float, ...]] = field(default_factory=dict, hash=False)

    def combinations(self) -> list[dict[str, float]]:
        """Every choice of one value for each field, fields in the order of their names."""
        names = sorted(self.assignments)
        return [dict(zip(names, values, strict=True)) for values in product(*(self.assignments[n] for n in names))]


#: Other names of the fields that rules speak of, by header token (fixed values).
ALIASES = {
    "latitude": ("latitude", "lat"),
    "longitude": ("longitude", "lon"),
    "frequency": ("frequency", "freq", "earfcn", "nrarfcn"),
    "pci": ("pci",),
    "mcc": ("mcc",),
    "mnc": ("mnc",),
    "rsrp": ("rsrp",),
    "sinr": ("sinr",),
}


def resolve(names: list[str], columns: list[str], mapping: dict[str, str] | None = None) -> dict[str, str]:
    """The column each rule field means.

    Exact name, then the same letters in another case, then equal header tokens, then
    SSRef for a field named frequency, then the column mapped to that logical field, else
    the name itself.
    """
    mapping = mapping or {}
    token = lambda s: "".join(ch for ch in s.lower() if ch.isascii() and ch.isalnum())
    lower, tokens = {}, {}
    for c in columns:
        lower.setdefault(c.lower(), c)
        tokens.setdefault(token(c), c)
    out = {}
    for n in names:
        logical = next((k for k, others in ALIASES.items() if token(n) in others), None)
        options = [n if n in columns else None, lower.get(n.lower()), tokens.get(token(n)), tokens.get("ssref") if token(n) == "frequency" else None, mapping.get(logical or "")]
        out[n] = next((o for o in options if o), n)
    return out


def _holds(number: Column, low: float, high: float) -> Column:
    inside = number == low if low == high else (number >= low) & (number < high)
    return F.coalesce(inside, F.lit(False))


def match(df: DataFrame, rules: list[Rule], mapping: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``rule``: the one with the largest matching group, ties to the first name; null if none.

    A few groups are compiled to one expression over the row. Of more, a row meets those
    only that are keyed by one of its values.
    """
    ordered = sorted(rules, key=lambda r: r.name)
    groups = [(len(g), -k, g) for k, r in enumerate(ordered) for g in r.groups]
    if not groups:
        return df.withColumn("rule", F.lit(None).cast("string"))
    names = sorted({c[0] for _, _, g in groups for c in g})
    column = resolve(names, df.columns, mapping)
    numbers = [parse_number(F.col(f"`{column[n]}`").cast("string")) if column[n] in df.columns else F.lit(None).cast("double") for n in names]
    held = free_name(df, "numbers")
    at = df.withColumn(held, F.array(*numbers))
    number = lambda f: F.get(F.col(held), F.lit(names.index(f)))
    if len(groups) <= COMPILED:
        options = []
        for size, k, group in groups:
            test = F.lit(True)
            for f, low, high in group:
                test = test & _holds(number(f), low, high)
            options.append(F.when(test, F.struct(F.lit(size).alias("size"), F.lit(k).alias("k"))))
        best = F.array_max(F.array(*options))
        named = F.array(*[F.lit(r.name) for r in ordered])
        return at.withColumn("rule", F.get(named, -best["k"])).drop(held)
    return _looked_up(at, held, names, groups, ordered).drop(held)


_GROUP = "struct<size: int, k: int, conditions: array<struct<f: int, low: double, high: double>>>"


def _stretches(rows: list[tuple], f: int) -> tuple[list[float], list[list[tuple]]]:
    """Sorted ends of the groups' ranges of field ``f``, and a tree over the stretches between them.

    Stretch i has the numbers with i ends at or below. Node 1 is the whole line, node n has
    nodes 2n and 2n + 1 as halves, and the stretches are the last nodes. A group is at the few
    nodes that make up its range. Of those with no other condition a node keeps the best.
    """
    own = [(row, next((low, high) for g, low, high in row[2] if g == f)) for row in rows]
    ends = sorted({e for _, range_ in own for e in range_})
    number = {e: i for i, e in enumerate(ends)}
    leaves = 1 << len(ends).bit_length()
    nodes: list[list[tuple]] = [[] for _ in range(2 * leaves)]
    for row, (low, high) in own:
        a, b = leaves + number[low] + 1, leaves + number[high] + 1
        while a < b:
            if a & 1:
                nodes[a].append(row)
                a += 1
            if b & 1:
                b -= 1
                nodes[b].append(row)
            a, b = a // 2, b // 2
    for held in nodes:
        alone = max((r for r in held if len(r[2]) == 1), default=None)
        held[:] = [r for r in held if r is alone or len(r[2]) > 1 and (alone is None or r[:2] > alone[:2])]
    return ends, nodes


def _looked_up(at: DataFrame, held: str, names: list[str], groups: list[tuple], ordered: list[Rule]) -> DataFrame:
    """``match`` by tables: groups with an exact condition are joined by its value, those of ranges found by the stretch of a value."""
    spark = at.sparkSession
    exact: dict[int, dict[float, list]] = {}
    rest = []
    values: dict[str, set[float]] = {}
    for _, _, g in groups:
        for f, low, high in g:
            if low == high:
                values.setdefault(f, set()).add(low)
    for size, k, g in groups:
        row = (size, k, [(names.index(f), float(low), float(high)) for f, low, high in g])
        # The field with the most values tells groups apart best.
        keys = [(len(values[f]), f, low) for f, low, high in g if low == high]
        if keys:
            _, f, low = max(keys)
            exact.setdefault(names.index(f), {}).setdefault(float(low), []).append(row)
        else:
            rest.append(row)
    tried, dropped = [], []
    for f, by_value in sorted(exact.items()):
        key, own = free_name(at, f"key_{f}"), free_name(at, f"groups_{f}")
        table = spark.createDataFrame(sorted(by_value.items()), f"`{key}` double, `{own}` array<{_GROUP}>")
        table = F.broadcast(table) if len(by_value) <= BROADCAST_ROWS else table
        at = at.join(table, F.get(F.col(held), F.lit(f)) == F.col(key), "left")
        tried.append(F.coalesce(F.col(own), F.array().cast(f"array<{_GROUP}>")))
        dropped += [key, own]
    ends_of: dict[int, set[float]] = {}
    for row in rest:
        for f, low, high in row[2]:
            ends_of.setdefault(f, set()).update((low, high))
    ranged: dict[int, list] = {}
    for row in rest:
        if all(low < high for _, low, high in row[2]):  # else it holds for no number
            ranged.setdefault(max((len(ends_of[f]), f) for f, _, _ in row[2])[1], []).append(row)
    for f, rows in sorted(ranged.items()):
        ends, nodes = _stretches(rows, f)
        key, own = free_name(at, f"ends_{f}"), free_name(at, f"stretches_{f}")
        table = spark.createDataFrame([(ends, nodes)], f"`{key}` array<double>, `{own}` array<array<{_GROUP}>>")
        at = at.crossJoin(F.broadcast(table))  # one row
        leaf = count_upto(F.col(key), len(ends), F.get(F.col(held), F.lit(f))) + F.lit(len(nodes) // 2)
        above = F.array(*[F.lit(j) for j in range((len(nodes) // 2).bit_length())])
        met = F.flatten(F.transform(above, lambda j: F.get(F.col(own), F.call_function("shiftright", leaf, j))))
        tried.append(F.coalesce(met, F.array().cast(f"array<{_GROUP}>")))
        dropped += [key, own]
    inside = lambda c: _holds_at(F.get(F.col(held), c["f"]), c)
    fitting = F.filter(F.concat(*tried), lambda g: F.forall(g["conditions"], inside))
    best = F.array_max(F.transform(fitting, lambda g: F.struct(g["size"].alias("size"), g["k"].alias("k"))))
    number = free_name(at, "rule_no")
    at = at.withColumn(number, -best["k"])
    named = spark.createDataFrame([(k, r.name) for k, r in enumerate(ordered)], f"`{number}` int, `{number}_name` string")
    named = F.broadcast(named) if len(ordered) <= BROADCAST_ROWS else named
    return at.join(named, number, "left").withColumn("rule", F.col(f"{number}_name")).drop(*dropped, number, f"{number}_name")


def _holds_at(number: Column, c: Column) -> Column:
    inside = F.when(c["low"] == c["high"], number == c["low"]).otherwise((number >= c["low"]) & (number < c["high"]))
    return F.coalesce(inside, F.lit(False))


def expand(matched: DataFrame, rules: list[Rule], keep_original: bool = False, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rows with a rule are replaced by one row for each combination of its values.

    Set fields are written as text, whole numbers without a fraction; fields that are
    no column yet are added, in the order of their names. ``pos`` counts a row's copies
    from 0; with ``keep_original`` the unchanged row comes first. Rows without a rule pass.
    """
    names = sorted({n for r in rules for n in r.assignments})
    column = resolve(names, matched.columns, mapping)
    targets = sorted(set(column.values()))
    if not targets:
        return matched.withColumn("pos", F.lit(0))
    own, of = free_name(matched, "copies"), {c: n for n, c in column.items()}
    kind = ", ".join(f"`{t}`: double" for t in targets)
    of_rule = []
    for rule in rules:
        copies = [tuple(float(c[n]) if n in c else None for n in (of[t] for t in targets)) for c in rule.combinations()]
        of_rule.append((rule.name, [*([(None,) * len(targets)] if keep_original else []), *copies]))
    table = matched.sparkSession.createDataFrame(of_rule, f"rule string, `{own}` array<struct<{kind}>>")
    table = F.broadcast(table) if len(of_rule) <= BROADCAST_ROWS else table
    none = F.array(F.struct(*[F.lit(None).cast("double").alias(t) for t in targets]))
    joined = matched.join(table, "rule", "left")
    rows = joined.select(*matched.columns, F.posexplode(F.coalesce(F.col(own), none)).alias("pos", own))
    for t in targets:
        old = F.col(f"`{t}`") if t in matched.columns else F.lit(None).cast("string")
        rows = rows.withColumn(t, F.coalesce(number_text(F.col(own)[t]), old.cast("string")))
    return rows.drop(own)


def header_tokens(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("token", header_token(F.col(name)))
