"""Exact copies: cheap pre-filters first, then content hashes, then heads and claims of whole classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsift.plans.running import running_sum

PIECE = 16 << 10


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def content_sample(content: Column, piece: int = PIECE) -> Column:
    """A 64-bit hash of the length and of the first, middle and last piece; equal contents have equal samples."""
    data = content.cast("binary")
    n = F.octet_length(data)
    middle = F.greatest(F.lit(0), F.floor((n - piece) / 2)).cast("int") + 1
    last = F.greatest(F.lit(0), n - piece).cast("int") + 1
    return F.xxhash64(n, F.substring(data, 1, piece), data.substr(middle, F.lit(piece)), data.substr(last, F.lit(piece)))


def shared_lengths(items: DataFrame, length: Column) -> DataFrame:
    """Items whose length another item has: only their contents need a look. Counted by partial aggregation, not by a window."""
    items = items.withColumn("length", length)
    counts = items.groupBy("length").agg(F.count(F.lit(1)).alias("n_length")).filter("n_length > 1")
    return items.join(counts, "length")


def shared_samples(items: DataFrame, sample: Column, length: str = "length") -> DataFrame:
    """Of items with shared lengths, those whose sample another of the same length has."""
    items = items.withColumn("sample", sample)
    counts = items.groupBy(length, "sample").agg(F.count(F.lit(1)).alias("n_sample")).filter("n_sample > 1")
    return items.join(counts, [length, "sample"])


def exact_sets(items: DataFrame, id_col: str, hash_col: str = "hash") -> DataFrame:
    """(hash, members, n): contents that two items have, members in order."""
    sets = items.groupBy(hash_col).agg(F.sort_array(F.collect_list(id_col)).alias("members"), F.count(F.lit(1)).alias("n"))
    return sets.filter("n > 1")


def heads(items: DataFrame, id_col: str, key: Column, name: str = "head") -> DataFrame:
    """Each item with the smallest id of its class; partial aggregation keeps a class of very many items cheap."""
    keyed = items.withColumn("_key", key)
    least = keyed.groupBy("_key").agg(F.min(id_col).alias(name))
    return keyed.join(least, "_key").drop("_key")


def identical_pairs(items: DataFrame, id_col: str, head_col: str) -> DataFrame:
    """(a, b) of every item that is not a head with its head: the pairs of a set follow from these."""
    return items.filter(F.col(id_col) != F.col(head_col)).select(F.col(head_col).alias("a"), F.col(id_col).alias("b"))


def all_identical_pairs(sets: DataFrame, members: str = "members") -> DataFrame:
    """(a, b), a < b, of every two members of a set; for reports that spell pairs out."""
    first = sets.select(F.posexplode(members).alias("i", "a"), members)
    return first.select("a", F.explode(F.expr(f"slice({members}, i + 2, size({members}))")).alias("b"))


def expand_claims(claims: DataFrame, classes: DataFrame, id_col: str, head_col: str, carried: list[str]) -> DataFrame:
    """Claims between heads -> claims between all members of both classes, low id first; `flipped` says that the ends changed places."""
    left = classes.select(F.col(head_col).alias("a"), F.col(id_col).alias("x"))
    right = classes.select(F.col(head_col).alias("b"), F.col(id_col).alias("y"))
    wide = claims.join(left, "a").join(right, "b").filter("x <> y")
    return wide.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("x") > F.col("y")).alias("flipped"), *carried)


def colour_heads(items: DataFrame, class_col: str, id_col: str, value_col: str, bar: float = 1.5) -> DataFrame:
    """Within a class, in order of id, each item's head is the first head alike in colour (values within the bar); a null value is alike to none.

    The rule depends on the order, so a class is worked through in one place; classes are sets of one analysis.
    """
    import pandas as pd

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(id_col)
        found, out = [], []
        for name, value in zip(part[id_col], part[value_col], strict=True):
            head = next((h for h, v in found if not pd.isna(value) and abs(v - value) <= bar), None)
            if head is None:
                head = name
                if not pd.isna(value):
                    found.append((name, value))
            out.append(head)
        return pd.DataFrame({id_col: part[id_col], "colour_head": out})

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(class_col, id_col, value_col).groupBy(class_col).applyInPandas(walk, f"{id_col} {kind}, colour_head {kind}")


def first_stated(pairs: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """The first row of each unordered pair, in the order of statement."""
    ends = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(*order)
    return pairs.withColumn("_n", F.row_number().over(ends)).filter("_n = 1").drop("_n")


def best_of(verdicts: DataFrame, keys: list[str], standing: str = "standing", points: str = "n_in", order: str = "step") -> DataFrame:
    """Of rows of the same keys the one with the best standing, then most points, then earliest step."""
    w = Window.partitionBy(*keys).orderBy(F.col(standing).desc(), F.col(points).desc(), order)
    return verdicts.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def name_ranks(items: DataFrame, name: str) -> DataFrame:
    """Competition rank of names, from 0: how many items have a smaller name. Ranked among distinct names with their counts, which are fewer than the items."""
    counts = items.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_sum(counts, [F.col(name)], F.col("_n"), "_up_to").select(name, (F.col("_up_to") - F.col("_n")).alias("name_rank"))
    return items.join(ranks, name)


def alike_in_colour(a_colour: Column, b_colour: Column, a_coding: Column, b_coding: Column, apart: Column, bar: float = 1.5) -> Column:
    """What two files of one grey plane are: twins if their colour is the same, to the bit or by one coding, or their chroma lies within the bar; null if nothing says."""
    coded = a_coding.isNotNull() & (a_coding == b_coding)
    return F.when((a_colour == b_colour) | coded, "twin").when(apart <= bar, "twin").when(apart.isNotNull(), "apart")


def settles_sameness(several: Column, features: Column) -> Column:
    """Whether a file's analysis may say that it is another's: it shows one picture, and something in it could be matched."""
    return ~several & (features > 0)
