"""The difference of two tables by key: missing, added and changed cells.

Both sides meet in one full outer join on the key. Rows in which nothing differs
leave at once; the others yield the numbers of their differing cells, which are
exploded, and only then is a cell spelled out. A table is scanned once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ComparisonError
from ..functions.equality import FLOATING, measures, sql_text, values_equal
from ..options import CompareOptions

MISSING, ADDED, CHANGED = "missing", "added", "changed"
#: Columns of a difference after those of the key.
DIFFERENCE_COLUMNS = ("field_name", "table1_value", "table2_value", "difference_type", "message", "type1", "type2", "absolute_difference", "percentage_difference", "levenshtein_distance", "time_difference_seconds")


def key_list(key: str | list[str] | tuple[str, ...] | None) -> list[str]:
    if not key:
        raise ValueError("a primary key is needed")
    return [key] if isinstance(key, str) else list(key)


def check_inputs(t1: DataFrame, t2: DataFrame, key: list[str], mapping: dict[str, str]) -> None:
    """Keys and mapped columns must exist, and no name may be mapped to twice."""
    for what, names, df in (("key", key, t1), ("key", [mapping[k] for k in key if k in mapping], t2), ("mapped", mapping, t1), ("mapped", mapping.values(), t2)):
        lost = sorted(set(names) - set(df.columns))
        if lost:
            raise ComparisonError(f"{what} columns not in the table: {', '.join(lost)}")
    if len(set(mapping.values())) < len(mapping):
        raise ComparisonError("two columns are mapped to the same one")


def duplicate_keys(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Non-null keys that occur more than once, with their number of rows (``n``)."""
    keys = key_list(key)
    return with_keys(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose whole key is there; NaN is no key."""
    tests = [f"`{k}` IS NOT NULL" + (f" AND NOT isnan(`{k}`)" if isinstance(df.schema[k].dataType, FLOATING) else "") for k in keys]
    return df.filter(" AND ".join(tests))


@dataclass
class Joined:
    """The full outer join of two sides. Columns of table 1 are l0, l1 ..., of table 2 r0, r1 ..., keys k0 ..."""

    df: DataFrame
    key: list[str]
    left: dict[str, tuple[str, T.DataType]]
    right: dict[str, tuple[str, T.DataType]]
    mapping: dict[str, str]
    options: CompareOptions


def default_mapping(t1: DataFrame, t2: DataFrame) -> dict[str, str]:
    return {c: c for c in t1.columns if c in set(t2.columns)}


def prepare(t1: DataFrame, t2: DataFrame, key, mapping: dict[str, str] | None, options: CompareOptions) -> tuple[DataFrame, DataFrame, list[str], dict[str, str]]:
    """Both tables without ignored columns and with aliases applied, the keys and the mapping."""
    keys = key_list(key)
    aliases, ignored = options.column_aliases, set(options.ignore_columns) - set(keys)
    if aliases:
        t1, t2 = (df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns}) for df in (t1, t2))
    mapping = dict(mapping) if mapping is not None else default_mapping(t1, t2)
    for k in keys:
        mapping.setdefault(k, k)
    hidden = {mapping.get(c, c) for c in ignored} | (ignored - set(mapping.values()))
    mapping = {a: b for a, b in mapping.items() if a not in ignored}
    if ignored:
        t1 = t1.drop(*ignored)
        t2 = t2.drop(*[c for c in hidden if c not in {mapping[k] for k in keys}])
    check_inputs(t1, t2, keys, mapping)
    return t1, t2, keys, mapping


def side(df: DataFrame, keys: list[str], letter: str, unique: str) -> tuple[DataFrame, dict[str, tuple[str, T.DataType]]]:
    """One side of the join under its own names; a duplicate key raises if it is to be found lazily."""
    rest = [c for c in df.columns if c not in keys]
    names = {c: (f"{letter}{i}", df.schema[c].dataType) for i, c in enumerate(rest)}
    out = with_keys(df, keys).selectExpr(*[f"`{k}` AS k{i}" for i, k in enumerate(keys)], *[f"`{c}` AS {n}" for c, (n, _) in names.items()], f"true AS in_{letter}")
    if unique == "lazy":  # by the join's own partitioning: no shuffle more
        n = F.count(F.lit(1)).over(W.partitionBy(*[f"k{i}" for i in range(len(keys))]))
        out = out.withColumn(f"in_{letter}", F.when(n > 1, F.raise_error(F.lit("duplicate primary key")).cast("boolean")).otherwise(F.lit(True)))
    return out, names


def join(t1: DataFrame, t2: DataFrame, key, mapping: dict[str, str] | None = None, options: CompareOptions | None = None, how: str = "full_outer") -> Joined:
    """Both sides joined on the key; rows with a null in their key are in no category."""
    o = options or CompareOptions()
    t1, t2, keys, mapping = prepare(t1, t2, key, mapping, o)
    if o.unique_keys == "eager":
        for df, own in ((t1, keys), (t2, [mapping[k] for k in keys])):
            found = duplicate_keys(df, own).limit(3).collect()
            if found:
                raise ComparisonError(f"primary key {own} is not unique, e.g. {[tuple(r)[:-1] for r in found]}")
    left, l_names = side(t1, keys, "l", o.unique_keys)
    right, r_names = side(t2, [mapping[k] for k in keys], "r", o.unique_keys)
    df = left.join(right, [f"k{i}" for i in range(len(keys))], how)
    return Joined(df, keys, l_names, r_names, mapping, o)


def row_status(j: Joined) -> Column:
    return F.when(F.col("in_r").isNull(), MISSING).when(F.col("in_l").isNull(), ADDED).otherwise("common")


def equal_columns(j: Joined) -> dict[str, Column]:
    """Of each mapped column that is no key, whether both values are equal."""
    out = {}
    for c, (name, kind) in j.left.items():
        other = j.mapping.get(c)
        if other in j.right:
            r_name, r_kind = j.right[other]
            own = j.options.comparators.get(c)
            a, b = F.col(name), F.col(r_name)
            out[c] = F.coalesce(own(a, b), F.lit(False)) if own else values_equal(a, b, kind, r_kind, j.options)
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_number(cases: dict[int, str], kind: str) -> Column:
    """The value of the cell whose number is ``i``, from SQL texts; equal ones share a branch."""
    numbers: dict[str, list[str]] = {}
    for i, c in cases.items():
        numbers.setdefault(c, []).append(str(i))
    branches = " ".join(f"WHEN i IN ({', '.join(n)}) THEN {c}" for c, n in numbers.items())
    return F.expr(f"CAST({f'CASE {branches} END' if branches else 'NULL'} AS {kind})")


def cells(j: Joined, kinds: tuple[str, ...] = (MISSING, ADDED, CHANGED)) -> DataFrame:
    """A row for each differing cell: the key's columns, then DIFFERENCE_COLUMNS.

    A missing or added row gives one for each of its columns that is no key, with
    that table's name; a key-only table gives none.

    Cells are numbered: first those of missing rows, then of added, then of
    changed ones. What is alike in all of them is written as SQL text, as each
    Column call from Python takes its time.
    """
    left = list(j.left.items()) if MISSING in kinds else []
    right = list(j.right.items()) if ADDED in kinds else []
    equal = equal_columns(j) if CHANGED in kinds else {}
    n_missing, n_gone = len(left), len(left) + len(right)
    common = [(c, j.left[c], j.right[j.mapping[c]]) for c in equal]
    first = {i: sql_text(n, k) for i, (_, (n, k)) in enumerate(left)} | {n_gone + i: sql_text(n, k, True) for i, (_, (n, k), _) in enumerate(common)}
    second = {n_missing + i: sql_text(n, k) for i, (_, (n, k)) in enumerate(right)} | {n_gone + i: sql_text(n, k, True) for i, (_, _, (n, k)) in enumerate(common)}
    names = [c for c, _ in left + right] + list(equal)
    type1 = {i: _quoted(k.simpleString()) for i, (_, (_, k)) in enumerate(left)} | {n_gone + i: _quoted(k.simpleString()) for i, (_, (_, k), _) in enumerate(common)}
    type2 = {n_missing + i: _quoted(k.simpleString()) for i, (_, (_, k)) in enumerate(right)} | {n_gone + i: _quoted(k.simpleString()) for i, (_, _, (_, k)) in enumerate(common)}

    rows = j.df.select("*", *[(~same).alias(f"d{i}") for i, same in enumerate(equal.values())])
    numbers = lambda lo, hi: f"array({', '.join(map(str, range(lo, hi)))})"
    differing = ", ".join(f"CASE WHEN d{i} THEN {n_gone + i} END" for i in range(len(equal)))
    some = " OR ".join(["false", *(["in_r IS NULL"] if left else []), *(["in_l IS NULL"] if right else []), *(f"(in_l AND in_r AND d{i})" for i in range(len(equal)))])
    picked = f"CASE WHEN in_r IS NULL THEN {numbers(0, n_missing)} WHEN in_l IS NULL THEN {numbers(n_missing, n_gone)} ELSE filter(array({differing}), x -> x IS NOT NULL) END"
    rows = rows.filter(some).select("*", F.explode_outer(F.expr(f"CAST({picked} AS array<int>)")).alias("i")).filter("i IS NOT NULL")

    details: dict[str, Column] = {}
    for i, (_, (n1, k1), (n2, k2)) in enumerate(common):
        for c, value in measures(F.col(n1), F.col(n2), k1, k2).items():
            here = F.col("i") == n_gone + i
            details[c] = details[c].when(here, value) if c in details else F.when(here, value)
    kind_of = {"levenshtein_distance": "int", "absolute_difference": "double", "percentage_difference": "double", "time_difference_seconds": "double"}
    values = {
        "field_name": _by_number({i: _quoted(c) for i, c in enumerate(names)}, "string"),
        "table1_value": _by_number(first, "string"),
        "table2_value": _by_number(second, "string"),
        "difference_type": F.expr(f"CASE WHEN i < {n_missing} THEN '{MISSING}' WHEN i < {n_gone} THEN '{ADDED}' ELSE '{CHANGED}' END"),
        "type1": _by_number(type1, "string"),
        "type2": _by_number(type2, "string"),
    } | {c: details.get(c, F.lit(None)).cast(k) for c, k in kind_of.items()}
    null = " ".join(f"WHEN {i} THEN ({first[i]} IS NULL) <> ({second[i]} IS NULL)" for i in range(n_gone, n_gone + len(common)))
    changed = f"CASE WHEN CASE i {null} END THEN 'one side is null' ELSE 'values differ' END" if common else "NULL"
    values["message"] = F.expr(f"CASE WHEN i < {n_missing} THEN 'exists only in table 1' WHEN i < {n_gone} THEN 'exists only in table 2' ELSE {changed} END")
    return rows.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(j.key)], *[values[c].alias(c) for c in DIFFERENCE_COLUMNS])


def diff(t1: DataFrame, t2: DataFrame, key, mapping: dict[str, str] | None = None, options: CompareOptions | None = None) -> DataFrame:
    """All differing cells of two tables; the plan is one full outer join."""
    return cells(join(t1, t2, key, mapping, options))


def missing(t1: DataFrame, t2: DataFrame, key, mapping=None, options: CompareOptions | None = None) -> DataFrame:
    """Cells of the rows that only table 1 has: an anti join that reads only the key of table 2."""
    j = join(t1, t2, key, mapping, options, "left_anti")
    return cells(Joined(j.df.withColumn("in_r", F.lit(None).cast("boolean")), j.key, j.left, {}, {}, j.options), (MISSING,))


def added(t1: DataFrame, t2: DataFrame, key, mapping=None, options: CompareOptions | None = None) -> DataFrame:
    """Cells of the rows that only table 2 has."""
    o = options or CompareOptions()
    p1, p2, keys, mapping = prepare(t1, t2, key, mapping, o)
    left, _ = side(p1, keys, "l", o.unique_keys)
    right, names = side(p2, [mapping[k] for k in keys], "r", o.unique_keys)
    df = right.join(left, [f"k{i}" for i in range(len(keys))], "left_anti").withColumn("in_l", F.lit(None).cast("boolean"))
    return cells(Joined(df, keys, {}, names, {}, o), (ADDED,))


def changed(t1: DataFrame, t2: DataFrame, key, mapping=None, options: CompareOptions | None = None) -> DataFrame:
    """Differing cells of the rows that both tables have: an inner join.

    Sides of like size are shuffled, so that every core compares cells; a side
    that is far smaller may be broadcast if Spark finds it small enough.
    """
    sizes = sorted(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in (t1, t2))
    alike = sizes[1] < 10 * sizes[0]
    return cells(join(t1.hint("merge") if alike else t1, t2, key, mapping, options, "inner"), (CHANGED,))


def row_differences(j: Joined) -> DataFrame:
    """The key, the row's status and the number of differing cells of every row of either table."""
    n = F.lit(0)
    for equal in equal_columns(j).values():
        n = n + F.when(equal, 0).otherwise(1)
    status = row_status(j)
    return j.df.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(j.key)], status.alias("row_status"), F.when(status == "common", n).otherwise(0).cast("long").alias("changed_cells"))


def ordered(differences: DataFrame, key) -> DataFrame:
    """By difference type, field name and key."""
    return differences.orderBy("difference_type", "field_name", *key_list(key))


def key_json(key) -> Column:
    """The key as a JSON object of texts."""
    return F.to_json(F.struct(*[F.col(f"`{k}`").cast("string").alias(k) for k in key_list(key)]))
