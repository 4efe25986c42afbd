"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtext.session import durable

#: Folder of the public tokenizers' vocabulary files, and the one used unless told otherwise.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "piece_bpe_32k.model"


def token_counter(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):  # noqa: ANN201
    """A column function that counts the tokens of whole texts; null counts 0. The vocabulary is read once a worker."""

    @F.pandas_udf(T.LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        path = str(Path(folder) / vocabulary)
        if vocabulary.endswith(".model"):
            model = importlib.import_module("sentencepiece").SentencePieceProcessor(model_file=path)
            size = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        elif vocabulary.endswith(".tiktoken"):
            pattern = importlib.import_module("public_tokenizers").PATTERN
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).open("rb"))}
            model = importlib.import_module("tiktoken").Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            size = lambda texts: [len(model.encode_ordinary(t)) for t in texts]
        else:
            model = importlib.import_module("tokenizers").Tokenizer.from_file(path)
            model.encode_special_tokens = True
            size = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
        for s in parts:
            yield pd.Series(size([t if isinstance(t, str) else "" for t in s]), dtype="int64")

    return count


def pivotal(weights: np.ndarray, chances: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Dependent rounding of fractional chances that keeps the weighted sum and every chance's expectation.

    The open record and the next one trade mass, by random, until one of them is 0 or 1. Returns the chances, all integral but
    at most one, and the place of that one (-1 if there is none).
    """
    p = chances.copy()
    at = -1
    for j in range(len(p)):
        if p[j] <= 1e-12 or p[j] >= 1 - 1e-12 or weights[j] <= 0:
            p[j] = round(p[j]) if weights[j] > 0 else float(rng.random() < p[j])
            continue
        if at < 0:
            at = j
            continue
        i, ratio = at, weights[at] / weights[j]
        up = min(1 - p[i], p[j] / ratio)  # mass that i can take from j, in chances of i
        down = min(p[i], (1 - p[j]) / ratio)
        move = up if rng.random() * (up + down) < down else -down
        p[i] += move
        p[j] -= move * ratio
        at = -1
        for k in (i, j):
            if p[k] <= 1e-9 or p[k] >= 1 - 1e-9:
                p[k] = round(p[k])
            else:
                at = k
    return p, at


def _seed(*parts: object) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("|".join(map(str, parts)))


def plan(docs: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per wanted source: `source, target_share, max_repeats, docs, have, budget, rate`.

    budget is target_share times the wanted total (all tokens of the wanted sources unless given); rate is the mean number of
    copies of a document, budget / have, at most max_repeats. Repeated sources in `targets` are added up (the least
    max_repeats counts); null or negative numbers count as 0.
    """
    wanted = targets.where("source is not null").groupBy("source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"),
    )
    sizes = docs.where("source is not null").groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("have"))
    both = durable(wanted.join(sizes, "source", "left").na.fill(0, ["docs", "have"]), "mix-sizes")
    if total is None:
        total = both.agg(F.sum("have")).first()[0] or 0
    budget = F.col("target_share") * F.lit(float(total))
    return both.withColumn("budget", budget).withColumn("rate", F.when(F.col("have") > 0, F.least(F.col("budget") / F.col("have"), F.col("max_repeats").cast("double"))).otherwise(0.0))


def mixture(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", total: int | None = None, seed: int = 1, group: int = 5_000, fan_in: int = 256, counter: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Draws the mixture: `id, source, tokens, copies` for every record with a copy, and the report of shares.

    Each record gets the whole part of its source's rate as copies; the fractional rest is rounded by pivotal sampling with the
    tokens as weights, so each source keeps its tokens to within one record. Records are grouped by a hash of their id into
    groups of about `group` whatever the source's size, so a hot source is many groups; the open record of each group (at most
    one) goes up a tree of groups of `fan_in` until one is left per source, which is decided by its chance. Every random
    choice is seeded by the group, and each level is written, so a lost executor repeats the same choices.

    Report: `source, target_share, max_repeats, budget, have, reached, reached_share, capped`: reached_share is of the tokens
    drawn in all; `capped` tells the sources that cannot reach their budget. Sources not among the targets, or null, are left
    out; null texts have 0 tokens and are never drawn. Repeated ids are records of their own as long as the rest of the row
    differs, else they share one decision. Empty tables give an empty mixture and shares of 0.
    """
    count = token_counter()(F.col(text)) if counter is None else counter
    sized = durable(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(source).alias("source"), count.alias("tokens")).where("id is not null"), "mix-tokens")
    rates = durable(plan(sized, targets, total), "mix-plan")
    few = rates.select("source", "docs", "rate", F.greatest(F.ceil(F.col("docs") / group), F.lit(1)).alias("groups"))
    drawn = sized.join(few, "source").where("tokens > 0 and rate > 0")
    sure = drawn.select("id", "source", "tokens", F.floor("rate").cast("bigint").alias("copies"), (F.col("rate") - F.floor("rate")).alias("p"), F.pmod(F.xxhash64("id", F.lit(seed)), F.col("groups")).alias("g"))
    level = durable(sure, "mix-sure")

    def settle(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["id", "tokens"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(_seed(seed, *key))
        x = x.iloc[rng.permutation(len(x))].reset_index(drop=True)
        p, left = pivotal(x["tokens"].to_numpy(float), x["p"].to_numpy(float), rng)
        if left >= 0 and key[2]:
            p[left], left = float(rng.random() < p[left]), -1
        x["p"] = p
        x["open"] = np.arange(len(x)) == left
        return x[["id", "source", "tokens", "g", "p", "open"]]

    schema = "id bigint, source string, tokens bigint, g bigint, p double, open boolean"
    open_rows = level.where("p > 0").select("id", "source", "tokens", "p", "g")
    groups = max(1, int(few.agg(F.max("groups")).first()[0] or 1))
    settled = []
    while True:
        last = groups == 1
        done = durable(open_rows.withColumn("last", F.lit(last)).groupBy("source", "g", "last").applyInPandas(settle, schema), "mix-level")
        settled.append(done.where("not open").select("id", "source", "tokens", F.col("p").cast("bigint").alias("extra")))
        if last:
            break
        groups = -(-groups // fan_in)
        open_rows = done.where("open").select("id", "source", "tokens", "p", F.floor(F.col("g") / fan_in).alias("g"))
    extras = settled[0]
    for x in settled[1:]:
        extras = extras.unionByName(x)
    extras = extras.where("extra > 0").groupBy("id", "source", "tokens").agg(F.max("extra").alias("extra"))
    chosen = durable(level.join(extras, ["id", "source", "tokens"], "left").select("id", "source", "tokens", (F.col("copies") + F.coalesce("extra", F.lit(0))).alias("copies")).where("copies > 0"), "mixture")
    reached = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"))
    report = rates.join(reached, "source", "left").na.fill(0, ["reached"])
    whole = report.agg(F.sum("reached")).first()[0] or 0
    shares = report.select(
        "source", "target_share", "max_repeats", "budget", "have", "reached", (F.col("reached") / F.lit(float(max(whole, 1)))).alias("reached_share"), (F.col("have") * F.col("max_repeats") < F.col("budget")).alias("capped"),
    )
    return chosen, shares
