"""Data contracts.  Every check is one aggregation (or one keyed join) that lists violations;
``require`` and ``join_validated`` additionally raise."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


class ContractError(ValueError):
    """A table does not satisfy its contract."""


def rule_failures(df: DataFrame, rules: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """All rules in one pass: rows per rule for which the rule is false or unknown."""
    counts = df.groupBy(*by).agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()], F.count(F.lit(1)).alias("_rows"))
    entry = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("failures")) for n in rules]))
    return counts.select(*by, "_rows", entry.alias("e")).select(*by, "e.rule", "e.failures", F.col("_rows").alias("n_rows"))


def require(df: DataFrame, rule: Column, message: str) -> DataFrame:
    """Raise unless every row satisfies ``rule``; returns ``df`` for chaining."""
    if not df.where(~F.coalesce(rule, F.lit(False))).limit(1).isEmpty():
        raise ContractError(message)
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def cardinalities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column; the two-level count keeps every column's values spread."""
    parts = None
    for c in columns:
        one = df.select(F.col(c).cast("string").alias("v")).where("v IS NOT NULL").distinct().agg(F.count(F.lit(1)).alias("n_distinct")).select(F.lit(c).alias("column_name"), "n_distinct")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def join_validated(left: DataFrame, right: DataFrame, on: Sequence[str], relation: str = "m:1", how: str = "inner") -> DataFrame:
    """Join that refuses duplicate keys on the '1' sides and rows of ``left`` without a partner."""
    on = list(on)
    if not duplicate_keys(right, on).limit(1).isEmpty():
        raise ContractError(f"right side is not unique on {on}")
    if relation == "1:1" and not duplicate_keys(left, on).limit(1).isEmpty():
        raise ContractError(f"left side is not unique on {on}")
    if how == "inner" and not left.join(right.select(*on), on, "left_anti").limit(1).isEmpty():
        raise ContractError(f"rows of the left side have no partner on {on}")
    return left.join(right, on, how)


def order_mismatches(a: DataFrame, b: DataFrame, position: str, key: str) -> DataFrame:
    """Positions where two stores hold different keys or only one store has a row."""
    x = a.select(position, F.col(key).alias("key_a"))
    y = b.select(position, F.col(key).alias("key_b"))
    return x.join(y, position, "full_outer").where(~F.col("key_a").eqNullSafe(F.col("key_b")))


def group_sets(df: DataFrame, group: str, column: str, expected: Sequence) -> DataFrame:
    """Set of values per group against the expected set; values are deduplicated before collecting."""
    want = F.array(*[F.lit(v) for v in sorted(expected)])
    small = df.select(group, F.col(column).cast("long").alias("v")).distinct()
    inside = small.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_values"),
        F.sort_array(F.collect_set(F.when(F.array_contains(want.cast("array<bigint>"), F.col("v")), F.col("v")))).alias("hit"))
    return inside.select(group, "n_values", F.size("hit").alias("n_expected"), ((F.col("n_values") == len(expected)) & (F.size("hit") == len(expected))).alias("ok"))


def paired_slots(df: DataFrame, group: str, base: str, slot: str) -> DataFrame:
    """Each group must hold two rows of one base condition and two different slots."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), (F.min(base) == F.max(base)).alias("same_base"), (F.min(slot) != F.max(slot)).alias("two_slots")) \
        .withColumn("ok", (F.col("n") == 2) & F.col("same_base") & F.col("two_slots"))


def in_box(box: dict[str, tuple[float, float]]) -> Column:
    """Closed-interval membership; a plain conjunction, so it reaches the scan."""
    out = F.lit(True)
    for c, (lo, hi) in box.items():
        out = out & F.col(c).between(lo, hi)
    return out


def forbidden_columns(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Per column: does its name carry a leaking token, and how many values would leak."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    entry = [F.struct(F.lit(c).alias("column_name"), F.lit(any(t in c.lower() for t in tokens)).alias("forbidden"), F.col(c).alias("n_values")) for c in df.columns]
    return counts.select(F.explode(F.array(*entry)).alias("e")).select("e.*")


def refuse_columns(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    leaking = [c for c in df.columns if any(t in c.lower() for t in tokens)]
    if leaking:
        raise ContractError(f"forbidden columns {leaking}")
    return df


def not_finite_positive(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rules = {c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) < float("inf")) & (F.col(c) > 0) for c in columns}
    return rule_failures(df, rules)


def coverage_state(df: DataFrame, lookup: DataFrame, keys: Sequence[str], box: dict[str, tuple[float, float]]) -> DataFrame:
    """exact_match / in_box_pred / out_of_box by tuple lookup, then box membership."""
    hit = df.join(lookup.select(*keys).distinct().withColumn("_hit", F.lit(True)), list(keys), "left")
    state = F.when(F.col("_hit"), "exact_match").when(in_box(box), "in_box_pred").otherwise("out_of_box")
    return hit.withColumn("coverage", state).drop("_hit")


def qc_flags(rules: dict[str, Column]) -> Column:
    """Names of the triggered rules joined by '|', or 'ok'."""
    names = F.concat_ws("|", F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])))
    return F.when(names == "", "ok").otherwise(names)


def job_completeness(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """missing / unexpected / duplicate / complete per key."""
    seen = observed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = expected.select(key).distinct().withColumn("_want", F.lit(True)).join(seen, key, "full_outer")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("n") > 1, "duplicate").otherwise("complete")
    return both.select(key, F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


def physical_guard(maps: DataFrame, field: str, base: str, tol: float) -> DataFrame:
    """Every cell must be finite and satisfy field >= min(base, 0) - tol; values are reported, never clipped."""
    margin = F.zip_with(field, base, lambda z, s: z - F.least(s, F.lit(0.0)))
    rows = maps.withColumn("_m", margin)
    bad = lambda m: m.isNull() | F.isnan(m) | (F.abs(m) == float("inf"))
    low = F.size(F.filter("_m", lambda m: F.coalesce(m < -tol, F.lit(False))))
    finite = ~F.exists("_m", lambda m: F.coalesce(bad(m), F.lit(True)))
    return rows.select("map_id", F.array_min(field).alias("min_field"), F.array_min("_m").alias("min_margin"), low.alias("n_violations"), finite.alias("finite"), (finite & (low == 0)).alias("ok"))


def profile_suitable(profile: Column, edge_frac: float, edge: int = 3) -> Column:
    """Edge samples return to background: max |edge| <= edge_frac * max, with a positive max."""
    top = F.array_max(profile)
    ends = F.concat(F.slice(profile, 1, edge), F.slice(profile, -edge, edge))
    return F.coalesce((top > 0) & (F.array_max(F.transform(ends, F.abs)) <= edge_frac * top), F.lit(False))


def elongation_suspicious(width: Column, height: Column, min_aspect: float) -> Column:
    return F.greatest(width, height) / F.least(width, height) < min_aspect


def annotation_progress(items: DataFrame, done: Column, by: Sequence[str], position: str) -> DataFrame:
    return items.groupBy(*by).agg(F.count_if(done).alias("n_done"), F.min(F.when(~done, F.col(position))).alias("first_incomplete"), F.bool_and(done).alias("complete"))
