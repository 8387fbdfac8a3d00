"""Wide facts: time-bounded joins, dimension lookups, merges of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streammart.functions.scalars import age

#: Dimensions up to so many rows are broadcast after a count; larger ones are joined by shuffle.
MAX_BROADCAST_ROWS = 1_000_000


def small(dim: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``dim`` with a broadcast hint if it has at most ``most`` rows."""
    return F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim


def interval_join(left: DataFrame, right: DataFrame, key: Column, left_ts: Column, right_ts: Column, lower: str, upper: str) -> DataFrame:
    """Inner join on ``key`` with right_ts in [left_ts + lower, left_ts + upper], both ends included.

    Bounds are interval literals such as ``-5 SECONDS``. Works on batches and on streams with watermarks.
    """
    near = right_ts.between(left_ts + F.expr(f"INTERVAL {lower}"), left_ts + F.expr(f"INTERVAL {upper}"))
    return left.join(right, key & near)


def enrich(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, columns: dict[str, str], hint: bool = True) -> DataFrame:
    """Left join of a dimension: adds ``{dimension column: new name}``; a miss leaves nulls."""
    wanted = dim.select(F.col(dim_key).alias("_key"), *(F.col(c).alias(n) for c, n in columns.items()))
    kept = small(wanted) if hint else wanted
    return facts.join(kept, facts[fact_key] == kept["_key"], "left").drop("_key")


def with_user(facts: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Adds user_gender and user_age at ``as_of`` from (id, gender, birthday)."""
    wide = enrich(facts, users, "user_id", "id", {"gender": "user_gender", "birthday": "_birthday"})
    return wide.withColumn("user_age", age("_birthday", as_of)).drop("_birthday")


def with_product(facts: DataFrame, skus: DataFrame, spus: DataFrame, trademarks: DataFrame, categories: DataFrame) -> DataFrame:
    """The chain sku -> spu, trademark, category: keys come from the first lookup."""
    wide = enrich(facts, skus, "sku_id", "id", {"sku_name": "sku_name", "spu_id": "spu_id", "tm_id": "tm_id", "category3_id": "category3_id"})
    wide = enrich(wide, spus, "spu_id", "id", {"spu_name": "spu_name"})
    wide = enrich(wide, trademarks, "tm_id", "id", {"tm_name": "tm_name"})
    return enrich(wide, categories, "category3_id", "id", {"name": "category3_name"})


def merge_preferring(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join that gives each shared column once, the right side's value."""
    a, b = left.alias("a"), right.alias("b")
    condition = None
    for k in on:
        condition = (F.col(f"a.{k}") == F.col(f"b.{k}")) if condition is None else condition & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    only_left = [F.col(f"a.{c}").alias(c) for c in left.columns if c not in right.columns]
    return a.join(b, condition, how).select(*only_left, *(F.col(f"b.{c}").alias(c) for c in right.columns))


def merge_coalescing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join that gives each shared column once, the left value if it isn't null."""
    a, b = left.alias("a"), right.alias("b")
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on], "full")
    names = list(dict.fromkeys([*left.columns, *right.columns]))
    pick = lambda c: [F.col(f"{s}.{c}") for s, d in (("a", left), ("b", right)) if c in d.columns]
    return both.select(*(F.coalesce(*pick(c)).alias(c) for c in names))


def cart_merge(cart: DataFrame, added: DataFrame) -> DataFrame:
    """Items added to carts: quantities of the same (user_id, sku_id) add up, others are new rows."""
    return cart.unionByName(added).groupBy("user_id", "sku_id").agg(F.sum("sku_num").alias("sku_num"))


def nest(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str, *order: str) -> DataFrame:
    """Each parent with its children as an array sorted by ``order``; parents without any have an empty one."""
    fields = [*order, *(c for c in children.columns if c not in order and c != child_key)]
    grouped = children.groupBy(F.col(child_key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    joined = parents.join(grouped, parents[parent_key] == grouped["_key"], "left").drop("_key")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
