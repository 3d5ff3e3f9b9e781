"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic. Raking scales the cells' token weights in turn
to the source targets and to the language and topic shares of the corpus, never beyond a source's allowed
repetition; the source targets are met last. A source that cannot reach its weight is held at its cap, and what
it lacks goes to the others in proportion to their weights. Documents are then sampled by the calibrated number
of repetitions of their cell. Within a cell they stand in classes of like size, ordered by size, and are drawn
systematically; a class's number of copies is whole, and the tokens that rounding leaves over or short go to the
source's next smaller class, so a source misses its goal by about its shortest text.

Sources count without outer blanks and in lower case. Documents of unlisted or null source, and texts without
tokens, are never sampled; they count in the total. Null and empty languages and topics
are one value. Languages are told apart by the two letters of their code; everything else is "other", so cells
are bounded by targets * 677 * topics * size classes, whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.skew import prefix_sums
from starloom.runtime import Scratch

CELL = ["source", "lang", "topic"]
STEP = 8  # size classes for each doubling of the size


def source_name(c: str) -> Column:
    return F.lower(F.trim(c))


def language(c: str) -> Column:
    """The two letters that a language code starts with, in lower case; "other" for anything else."""
    code = F.regexp_extract(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))), "^([a-z]{2})(?![a-z])", 1)
    return F.when(code != "", code).otherwise(F.lit("other"))


def reach(targets: pd.DataFrame, available: dict[str, float], total: float) -> pd.DataFrame:
    """Tokens each source can give: its weight of ``total`` up to its cap; what capped sources lack is spread
    over the others. Adds ``tokens``, ``capped`` (cannot reach its weight), ``goal`` and ``wanted`` (the weight)."""
    t = targets.copy()
    t["tokens"] = [float(available.get(s, 0.0)) for s in t["source"]]
    cap = t["tokens"] * t["max_repeats"]
    want = t["weight"] * total
    t["capped"] = cap < want
    goal, open_ = np.zeros(len(t)), np.ones(len(t), bool)
    while True:
        left = total - goal[~open_].sum()
        weight = t["weight"].to_numpy() * open_
        if weight.sum() <= 0:
            break
        share = left * weight / weight.sum()
        over = open_ & (share > cap.to_numpy())
        if not over.any():
            goal[open_] = share[open_]
            break
        goal[over] = cap.to_numpy()[over]
        open_ &= ~over
    return t.assign(goal=goal, wanted=want)


def rake(cells: pd.DataFrame, goals: pd.DataFrame, rounds: int = 200) -> np.ndarray:
    """Repetitions of each cell (source, lang, topic, tokens) that meet the source goals, and the language and
    topic shares as far as caps allow."""
    goal, cap = goals.set_index("source")["goal"], goals.set_index("source")["max_repeats"]
    tokens = cells["tokens"].to_numpy(float)
    top = tokens * cells["source"].map(cap).to_numpy(float)
    codes = [pd.factorize(cells[c])[0] for c in ("lang", "topic", "source")]
    total = float(goal.sum())
    wants = [np.bincount(c, tokens) / max(tokens.sum(), 1e-9) * total for c in codes[:2]]
    wants.append(goal.reindex(pd.factorize(cells["source"])[1]).to_numpy(float))
    x = tokens.copy()
    for _ in range(rounds):
        before = x.copy()
        for c, want in zip(codes, wants):
            have = np.bincount(c, x, len(want))
            x = np.minimum(x * np.where(have > 0, want / np.maximum(have, 1e-9), 0)[c], top)
        if np.abs(x - before).max(initial=0) < 1e-6 * max(total, 1):
            break
    for _ in range(50):  # the source goals exactly: what cells at their cap lack goes to the source's others
        have = np.bincount(codes[2], x, len(wants[2]))
        lack = wants[2] - have
        room = np.bincount(codes[2], top - x, len(wants[2]))
        x = x + np.where(lack[codes[2]] > 0, (top - x) * np.minimum(1, (lack / np.maximum(room, 1e-9)))[codes[2]], x * (lack / np.maximum(have, 1e-9))[codes[2]])
        if np.abs(lack).max(initial=0) < 1e-6 * max(total, 1):
            break
    return np.divide(x, tokens, out=np.zeros_like(x), where=tokens > 0)


def _cells(docs: DataFrame) -> pd.DataFrame:
    """Documents and tokens by source, language, topic and size class: a bounded table, whatever the corpus."""
    cells = docs.groupBy(*CELL, "size").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).toPandas()
    return cells.sort_values([*CELL, "size"], ignore_index=True)


def allot(cells: pd.DataFrame, goals: pd.DataFrame) -> np.ndarray:
    """Whole numbers of copies of each (source, lang, topic, size) from ``repeats``. What rounding leaves over or short in
    tokens goes on to the cell's next smaller class, from there to the source's next cell, and at last to the
    source's smallest classes that have room."""
    out = np.zeros(len(cells), np.int64)
    cap = cells["source"].map(goals.set_index("source")["max_repeats"]).to_numpy(np.int64) * cells["n"].to_numpy(np.int64)
    mean = (cells["tokens"] / cells["n"]).to_numpy(float)
    want = (cells["repeats"] * cells["tokens"]).to_numpy(float)
    for _, part in cells.groupby("source", sort=True):
        left = 0.0
        order = part.sort_values(["size", "lang", "topic"], ascending=[False, True, True]).index.to_numpy()
        for i in order:
            left += want[i]
            out[i] = min(max(0, round(left / mean[i])), cap[i])
            left -= out[i] * mean[i]
        for i in order[::-1]:  # what is still left over, smallest first
            more = int(min(max(round(left / mean[i]), -out[i]), cap[i] - out[i]))
            out[i] += more
            left -= more * mean[i]
    return out


def mix(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, pd.DataFrame]:
    """(doc_id, source, lang, topic, tokens, copies) of all documents taken at least once, and the goals."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    want = targets.select(source_name("source").alias("source"), "weight", "max_repeats").toPandas()
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "topic")]
    size = F.floor(F.log2(F.greatest(F.col("tokens"), F.lit(1))) * STEP).cast("int").alias("size")
    docs = scratch.keep(docs.select("doc_id", "source", *named, "tokens", size))
    total = float(docs.agg(F.sum("tokens")).first()[0] or 0)
    listed = docs.where(F.col("source").isin(want["source"].to_list()) & (F.col("tokens") > 0))
    cells = _cells(listed)
    goals = reach(want, cells.groupby("source")["tokens"].sum().to_dict(), total)
    whole = cells.groupby(CELL, as_index=False)["tokens"].sum()
    whole["repeats"] = rake(whole, goals) if len(whole) else []
    cells = cells.merge(whole[[*CELL, "repeats"]], on=CELL)
    cells["take"] = allot(cells, goals) if len(cells) else []
    take = spark.createDataFrame(cells[[*CELL, "size", "n", "take"]].astype({"take": "int64"}), "source string, lang string, topic string, size int, n bigint, take bigint")
    rows = listed.withColumns({"h": F.xxhash64("doc_id"), "one": F.lit(1).cast("long")})
    placed = prefix_sums(spark, rows, [*CELL, "size"], ["tokens", "h", "doc_id"], "one", "before", scratch).join(F.broadcast(take), [*CELL, "size"])
    # the k-th of n documents has the whole numbers of copies between k * take / n and (k + 1) * take / n, from half a copy on
    at = [F.floor((F.col("before") + i) * (F.col("take") / F.col("n")) + 0.5) for i in (0, 1)]
    drawn = placed.withColumn("copies", (at[1] - at[0]).cast("int")).where("copies > 0")
    return drawn.select("doc_id", *CELL, "tokens", "copies"), goals


def report(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, max_repeats, tokens, capped, goal, reached, share, repeats, wanted) of every listed source; ``wanted``
    is its weight of all tokens."""
    mixed, goals = mix(docs, targets)
    spark = docs.sparkSession
    reached = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"), F.max("copies").alias("repeats"))
    plan = spark.createDataFrame(goals, "source string, weight double, max_repeats int, tokens double, capped boolean, goal double, wanted double")
    got = plan.join(F.broadcast(reached), "source", "left").fillna(0, ["reached", "repeats"])
    whole = got.agg(F.sum("reached")).scalar()
    return got.withColumn("share", F.col("reached") / F.greatest(whole, F.lit(1)))


def short_sources(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source) of the listed sources that cannot reach their weight of the corpus's tokens: those that the raked and drawn
    mix leaves below it. An exact check follows, since a source may also miss its weight by the rounding of
    one text: all its tokens at the allowed repetition must be too few."""
    return report(docs, targets).where((F.col("reached") < F.col("wanted")) & (F.col("tokens") * F.col("max_repeats") < F.col("wanted"))).select("source")
