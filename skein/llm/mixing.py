"""Problem 7: mixing sources to target weights.

Hierarchical budgeting over the tree mix > domain > language > source. Domains are a table (source, domain); a source that it lacks is a domain of its own. A mix's budget is ``budget`` tokens or, by default, the
tokens its sources hold once. Weights are given for sources; a source's weight is spread over its languages as its tokens are, and
a node weighs what its leaves weigh. A node can take what its leaves hold times max_repeats. Budgets go down the tree: each child gets
its share by weight, no more than it can take, and what some cannot take goes to their siblings by weight; only what a whole
node cannot take reaches its own siblings, that is, an ancestor's other children.

Each leaf's budget is filled from seeded epochs: epoch e orders the leaf's records by a hash of (seed, e, id); whole epochs
are taken while they fit, and of the last one the records from its beginning as long as their tokens fit. So no record is used more
than max_repeats times, the result is the same on any cluster, and a larger budget only adds records. The prefix is found without
gathering a leaf: hashes fall into ``cells`` cells, summed first; only the cell the budget ends in is ordered.

Sources are compared lower-cased, trimmed, with "_" as "-"; languages by their first two letters, "und" if unknown. Records with no
tokens, null texts or sources that a mix doesn't name take no part; a target without records or with a weight or repeats that are
null or not positive counts as one whose capacity is nil. Of a target named twice the largest weight counts. Records with the same id
are used alike. Actual shares are reported for every target.
"""

from __future__ import annotations

import base64
import importlib.util
import sys
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.tables import written

_encoders: dict[str, object] = {}


def encoder(path: str, name: str):
    """A byte-level BPE of a public vocabulary file, built once in each worker."""
    if (key := f"{path}/{name}") not in _encoders:
        import tiktoken

        spec = importlib.util.spec_from_file_location("_tokenizer_files", Path(path) / "__init__.py")
        files = importlib.util.module_from_spec(spec)
        sys.modules.setdefault("_tokenizer_files", files)
        spec.loader.exec_module(files)
        with (Path(path) / name).open("rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[key] = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def with_tokens(df: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, tokenizer_dir: str, tokenizer: str) -> DataFrame:
    """(id, source, lang, tokens): the size of each record that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_dir, tokenizer).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) for t in batch.column(3).to_pylist()]
            yield pa.record_batch([*batch.columns[:3], pa.array(n, pa.int64())], names=["id", "source", "lang", "tokens"])

    lang = F.lower(F.trim(lang_col)).substr(1, 2)
    rows = df.select(F.col(id_col).cast("long").alias("id"), canonical(F.col(source_col)).alias("source"), F.when(F.length(lang) == 2, lang).otherwise("und").alias("lang"), F.col(text_col).alias("text"))
    return rows.where("id is not null and text is not null and source is not null").mapInArrow(run, "id bigint, source string, lang string, tokens bigint").where("tokens > 0")


def canonical(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "_", "-")


def share_out(budget: float, weights: list[float], room: list[float]) -> list[float]:
    """``budget`` divided by weight among children that can take no more than ``room`` each; what some can't take goes to the others."""
    got = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and room[i] > 0]
    left = min(budget, sum(room[i] for i in open_))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if got[i] + left * weights[i] / total >= room[i]]
        if not full:
            for i in open_:
                got[i] += left * weights[i] / total
            break
        for i in full:
            left -= room[i] - got[i]
            got[i] = room[i]
        open_ = [i for i in open_ if i not in full]
    return got


def plan_mix(leaves: pd.DataFrame, budget: float | None, levels: tuple[str, ...] = ("domain", "lang", "source")) -> pd.DataFrame:
    """The budget of every leaf of a mix: rows with the levels, weight (of the leaf), tokens and max_repeats; adds ``budget``."""
    leaves = leaves.reset_index(drop=True)
    room = (leaves["tokens"] * leaves["max_repeats"]).astype(float)
    out = pd.Series(0.0, index=leaves.index)

    def down(index: list[int], amount: float, depth: int) -> None:
        if depth == len(levels):
            for i, x in zip(index, share_out(amount, [leaves["weight"][i] for i in index], [room[i] for i in index]), strict=True):
                out[i] = x
            return
        groups: dict[str, list[int]] = {}
        for i in sorted(index, key=lambda i: leaves[levels[depth]][i]):
            groups.setdefault(leaves[levels[depth]][i], []).append(i)
        got = share_out(amount, [sum(leaves["weight"][i] for i in g) for g in groups.values()], [sum(room[i] for i in g if leaves["weight"][i] > 0) for g in groups.values()])
        for g, x in zip(groups.values(), got, strict=True):
            down(g, x, depth + 1)

    down(list(leaves.index), float(leaves["tokens"].sum()) if budget is None else budget, 0)
    return leaves.assign(budget=out)


def _budgets(sized: DataFrame, targets: DataFrame, domains: DataFrame | None, budget: float | None) -> DataFrame:
    """(mix_name, source, lang, target_weight, max_repeats, tokens, budget) of every leaf."""
    held = sized.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens"))
    whole = held.groupBy("source").agg(F.sum("tokens").alias("whole"))
    named = targets.select("mix_name", canonical(F.col("source")).alias("source"), "target_weight", "max_repeats").where("mix_name is not null and source is not null")
    named = named.groupBy("mix_name", "source").agg(F.max("target_weight").alias("target_weight"), F.max_by("max_repeats", "target_weight").alias("max_repeats"))
    named = named.withColumn("target_weight", F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).withColumn("max_repeats", F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)))
    if domains is None:
        named = named.withColumn("domain", F.col("source"))
    else:
        known = domains.select(canonical(F.col("source")).alias("source"), "domain").where("source is not null and domain is not null").groupBy("source").agg(F.min("domain").alias("domain"))
        named = named.join(known, "source", "left").withColumn("domain", F.coalesce("domain", "source"))
    leaves = (
        named.join(held, "source", "left").join(whole, "source", "left")
        .select("mix_name", "domain", F.coalesce("lang", F.lit("und")).alias("lang"), "source", "target_weight", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("target_weight") * F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("weight"))
    )

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        return plan_mix(pdf, budget)[["mix_name", "source", "lang", "target_weight", "max_repeats", "tokens", "budget"]]

    return leaves.groupBy("mix_name").applyInPandas(each, "mix_name string, source string, lang string, target_weight double, max_repeats int, tokens bigint, budget double")


def mix_records(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", domains: DataFrame | None = None, budget: float | None = None, tokenizer_dir: str = "/opt/tokenizers", tokenizer: str = "byte_bpe_multi_50k.tiktoken", cells: int = 4096, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(mix_name, id, source, lang, tokens, uses): the records each mix uses and how often; and the budgets of its leaves."""
    sized = written(with_tokens(df, id_col, text_col, source_col, lang_col, tokenizer_dir, tokenizer))
    budgets = written(_budgets(sized, targets, domains, budget))
    epochs = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens") + 1e-9), F.col("max_repeats"))).otherwise(0).cast("int")
    leaf = budgets.select("mix_name", "source", "lang", epochs.alias("whole"), (F.col("budget") - epochs * F.col("tokens")).alias("rest")).where("whole > 0 or rest > 0")
    # targets are a few rows a mix, and there are as many leaves as languages of a source: planned by their size, not forced
    hashed = sized.join(leaf, ["source", "lang"]).withColumn("h", F.xxhash64(F.lit(seed), "whole", "id"))
    hashed = hashed.withColumn("cell", F.pmod(F.shiftrightunsigned("h", 8), F.lit(cells)).cast("int"))
    key = ["mix_name", "source", "lang"]
    sums = hashed.where("rest > 0").groupBy(*key, "cell").agg(F.sum("tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))).select(*key, "cell", F.coalesce("before", F.lit(0)).alias("before"), "n")
    placed = hashed.join(before, [*key, "cell"], "left")
    inside = F.col("before") + F.col("n") <= F.col("rest")
    cut = placed.where((F.col("before") <= F.col("rest")) & ~inside)
    cut = cut.withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy(*key, "cell").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)))
    last = placed.where(inside).select("mix_name", "id", "source", "lang", "tokens", (F.col("whole") + 1).alias("uses")).unionByName(cut.select("mix_name", "id", "source", "lang", "tokens", (F.col("whole") + (F.col("upto") <= F.col("rest")).cast("int")).alias("uses")))
    rest = placed.where(F.col("before").isNull() | (F.col("before") > F.col("rest"))).select("mix_name", "id", "source", "lang", "tokens", F.col("whole").alias("uses"))
    return last.unionByName(rest).where("uses > 0"), budgets


def mix_shares(selected: DataFrame, budgets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, actual_share, tokens, records, most_uses): what each target asked for and got."""
    got = selected.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used"), F.count("*").alias("records"), F.max("uses").alias("most_uses"))
    asked = budgets.groupBy("mix_name", "source").agg(F.max("target_weight").alias("w"))
    joined = asked.join(got, ["mix_name", "source"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    over = Window.partitionBy("mix_name")
    return joined.select(
        "mix_name", "source",
        F.round(F.col("w") / F.sum("w").over(over), 6).alias("target_share"), F.round(F.coalesce(F.col("used") / F.nullif(F.sum("used").over(over), F.lit(0)), F.lit(0.0)), 6).alias("actual_share"),
        F.col("used").alias("tokens"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
