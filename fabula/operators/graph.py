"""Graphs of characters: co-occurrence, and entities resolved from names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cooccurrence_graph(cast: DataFrame, max_nodes: int, max_edges: int, least: float = 0.12) -> DataFrame:
    """Edges ``a, b, weight`` among the ``max_nodes`` characters in most scenes (``scene_id, name``).

    A weight is the Jaccard similarity of both characters' scenes, to three digits; of the ``4 * max_edges`` pairs that
    share most scenes those of ``least`` or more stay. The nodes are few, so they are broadcast."""
    members = cast.select("scene_id", "name").distinct()
    nodes = members.groupBy("name").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "name").limit(max_nodes)
    kept = members.join(F.broadcast(nodes.select("name")), "name", "left_semi")
    x, y = kept.alias("x"), kept.alias("y")
    pairs = x.join(y, (F.col("x.scene_id") == F.col("y.scene_id")) & (F.col("x.name") < F.col("y.name")))
    common = pairs.groupBy(F.col("x.name").alias("a"), F.col("y.name").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    top = common.orderBy(F.desc("c"), "a", "b").limit(4 * max_edges)
    side = lambda c: F.broadcast(nodes.select(F.col("name").alias(c), F.col("k").alias(f"k_{c}")))
    weight = F.round(F.col("c") / (F.col("k_a") + F.col("k_b") - F.col("c")), 3)
    return top.join(side("a"), "a").join(side("b"), "b").select("a", "b", weight.alias("weight")).filter(F.col("weight") >= least)


def jaro(a: str, b: str) -> float:
    """Jaro similarity: characters that match within half the longer string, and their transpositions."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    mine = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                mine.append(x)
                break
    theirs = [y for y, t in zip(b, taken, strict=True) if t]
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def name_similarity(a: str, b: str) -> float:
    """Jaro-Winkler similarity (prefix of four, weight 0.1), or 0.92 where one name contains the other, if more."""
    base = jaro(a, b)
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    inside = 0.92 if a and b and (a in b or b in a) else 0.0
    return max(base + prefix * 0.1 * (1 - base), inside)


def similar_names(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` with ``similarity``."""

    @F.pandas_udf("double")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([name_similarity(p or "", q or "") for p, q in zip(x, y, strict=True)])

    return pairs.withColumn("similarity", similar(a, b))


def resolve_names(mentions: DataFrame, merge_at: float = 0.85, ask_at: float = 0.65, often: int = 8, large: int = 5) -> DataFrame:
    """``script_id, name, entity, place, ask``: names of a script (script_id, name, n) joined greedily, by mentions and then
    by length, the larger first (ties by name). A name joins the first entity whose own name is ``merge_at`` like it; before
    that, an entity that is ``ask_at`` like it is asked about if it has more than ``large`` names or both names have ``often``
    mentions together, and joined if ``approved`` (a column of mentions, an array of entities, if there is one) has it.
    ``ask`` is the first entity that was asked about in vain; ``place`` an entity's place in the order in which they were
    made. Order decides, so a script's names are one group; a script has few."""
    asked = F.col("approved") if "approved" in mentions.columns else F.array().cast("array<string>")
    rows = mentions.select("script_id", "name", F.col("n").cast("bigint").alias("n"), asked.alias("approved"))

    def resolve(key: tuple, names: pd.DataFrame) -> pd.DataFrame:
        heads: list[tuple[str, int]] = []
        sizes: list[int] = []
        out = []
        order = sorted(zip(names["name"], names["n"], names["approved"], strict=True), key=lambda x: (-x[1], -len(x[0]), x[0]))
        for name, n, approved in order:
            home, ask = None, None
            allowed = set(approved) if approved is not None else set()
            for place, (head, m) in enumerate(heads):
                like = name_similarity(name, head)
                if like >= merge_at or (like >= ask_at and (sizes[place] > large or n + m >= often) and head in allowed):
                    home = place
                    break
                if ask is None and like >= ask_at and (sizes[place] > large or n + m >= often):
                    ask = head
            if home is None:
                home = len(heads)
                heads.append((name, n))
                sizes.append(0)
            sizes[home] += 1
            out.append((key[0], name, heads[home][0], home, ask))
        return pd.DataFrame(out, columns=["script_id", "name", "entity", "place", "ask"])

    return rows.groupBy("script_id").applyInPandas(resolve, "script_id bigint, name string, entity string, place int, ask string")


def roles(entities: DataFrame) -> DataFrame:
    """``entities`` (script_id, entity, place, scenes) with ``rank`` (from 0) and ``role``. By number of scenes, then place: the
    first leads; the second opposes if it is in two scenes and in half as many as the first; who else is in two scenes
    supports, and others are minor."""
    by_script = Window.partitionBy("script_id")
    rank = F.row_number().over(by_script.orderBy(F.desc("scenes"), "place")) - 1
    half = F.greatest(F.lit(2), F.floor(F.max("scenes").over(by_script) * 0.5))
    role = (
        F.when(F.col("rank") == 0, "protagonist")
        .when((F.col("rank") == 1) & (F.col("scenes") >= F.col("_half")), "antagonist")
        .when(F.col("scenes") >= 2, "supporting")
        .otherwise("minor")
    )
    return entities.withColumns({"rank": rank, "_half": half}).withColumn("role", role).drop("_half")
