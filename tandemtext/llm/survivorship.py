"""Best representative of each duplicate group: one surviving value per field, elected by votes of the group's records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtext.functions.folding import hash128, trimmed
from tandemtext.session import durable


def file_key(name: Column) -> Column:
    """A file name without folder, letter case and outer blanks."""
    return trimmed(F.lower(F.regexp_replace(trimmed(name), r"^.*[/\\]", "")))


def with_trust(df: DataFrame, sources: DataFrame, name: str = "file", trust: str = "trust") -> DataFrame:
    """Adds `vote_trust`: the trust of the row's source, 0 where null or unknown.

    The source list is aggregated to one row per name (the highest trust), so the join never multiplies rows; Catalyst
    broadcasts it only while its size is below the session's threshold, else it is a shuffle join.
    """
    known = sources.select(file_key(F.col(name)).alias("_file_key"), F.col(trust).alias("_trust")).groupBy("_file_key").agg(F.max("_trust").alias("_trust"))
    return df.withColumn("_file_key", file_key(F.col(name))).join(known, "_file_key", "left").withColumn("vote_trust", F.coalesce("_trust", F.lit(0))).drop("_file_key", "_trust")


def ballots(df: DataFrame, id_col: str, group: list[str], fields: dict[str, str], time: str, half_life_days: float = 365.0) -> DataFrame:
    """Unpivots the rows' fields to ballots and adds up the votes for each value.

    fields: name -> column. Returns one row per group, field, normalised value, trust and time: `g1, g2, field, v1, v2,
    vote_trust, at, n, first_id, value, votes`. The votes of a row are (1 + trust) times 2 ** -(age / half life); a null time
    counts as the earliest and adds no recency. Partial aggregation collapses repeated rows before the shuffle, so a group
    with a third of all rows sends one row per distinct ballot and task.
    """
    g1, g2 = hash128(*[F.col(c) for c in group])
    at = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(2**62)).cast("bigint"))
    unpivoted = df.select(
        g1.alias("g1"), g2.alias("g2"), F.col(id_col).cast("bigint").alias("id"), F.col("vote_trust").cast("int").alias("vote_trust"), at.alias("at"),
        F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.col(c).cast("string").alias("value")) for name, c in fields.items()])).alias("x"),
    )
    long = unpivoted.select("g1", "g2", "id", "vote_trust", "at", "x.field", trimmed(F.col("x.value")).alias("value")).where("value <> ''")
    v1, v2 = hash128(F.col("value"))
    decay = F.pow(F.lit(2.0), F.greatest(F.col("at"), F.lit(0)) / F.lit(86_400e6 * half_life_days) - F.lit(60.0))
    return (
        long.select("g1", "g2", "field", v1.alias("v1"), v2.alias("v2"), "vote_trust", "at", "id")
        .groupBy("g1", "g2", "field", "v1", "v2", "vote_trust", "at")
        .agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
        .withColumn("votes", F.col("n") * (1 + F.col("vote_trust")) * decay)
    )


def elected(cast: DataFrame) -> DataFrame:
    """The winners of each group and field: `g1, g2, field, winner_id, votes, best_id, dominant_id`.

    winner_id: the first row (by trust, then time, then smallest id) that carries the value with the most votes; ties go to
    the value whose best row is more trusted, then later, then has the smaller id. best_id: the single row with the most votes,
    ties to the more trusted, then the later one, then the smaller id. dominant_id: best_id if no other row of the group is more
    trusted, later, or equal in both, else null. As a row's votes never fall with its trust and time, no other row can be that.
    """
    values = cast.groupBy("g1", "g2", "field", "v1", "v2").agg(
        F.sum("votes").alias("votes"), F.max(F.struct("vote_trust", "at", (-F.col("first_id")).alias("earlier"))).alias("best"),
    )
    winners = values.groupBy("g1", "g2", "field").agg(F.max(F.struct("votes", "best")).alias("w")).select(
        "g1", "g2", "field", F.col("w.votes").alias("votes"), (-F.col("w.best.earlier")).alias("winner_id"),
    )
    by_row = cast.groupBy("g1", "g2", "field", "vote_trust", "at").agg(F.sum("n").alias("n"), F.min("first_id").alias("id"), F.max(F.col("votes") / F.col("n")).alias("own"))
    rank = F.struct(F.greatest("own", F.lit(0.0)), "vote_trust", "at")
    single = by_row.groupBy("g1", "g2", "field").agg(
        F.max_by(F.struct("id", "vote_trust", "at", "n"), rank).alias("best"), F.max("vote_trust").alias("trust"), F.max("at").alias("latest"),
    )
    sole = (F.col("best.vote_trust") == F.col("trust")) & (F.col("best.at") == F.col("latest")) & (F.col("best.n") == 1)
    best = single.select("g1", "g2", "field", F.col("best.id").alias("best_id"), F.when(sole, F.col("best.id")).alias("dominant_id"))
    return winners.join(best, ["g1", "g2", "field"])


def duplicate_groups(df: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """Groups of rows with equal keys, disregarding outer white space: `g1, g2, first_id, members`; rows with a blank key have none."""
    trimmed_keys = df.select(F.col(id_col).cast("bigint").alias("id"), *[trimmed(F.col(k)).alias(f"k{i}") for i, k in enumerate(keys)])
    g1, g2 = hash128(*[F.col(f"k{i}") for i in range(len(keys))])
    solid = trimmed_keys.where(" and ".join(f"k{i} <> ''" for i in range(len(keys))))
    return solid.select("id", g1.alias("g1"), g2.alias("g2")).groupBy("g1", "g2").agg(F.min("id").alias("first_id"), F.count("*").alias("members")).where("members > 1")


def survivors(df: DataFrame, sources: DataFrame, id_col: str, keys: list[str], fields: list[str], source: str = "file", time: str = "committed_at", half_life_days: float = 365.0) -> DataFrame:
    """Elects a surviving value of every field for each group of rows with equal keys (outer white space aside).

    Returns `first_id, members` and, for each field, `<field>_id` (the row whose value survives: most votes), `<field>_votes`
    and `<field>_dominant` (the row that beats every other in trust and time, else null). Null and blank values have no vote;
    a field without any vote gets nulls. Null times count as earliest, unknown or null sources as trust 0. Rows with a null
    or blank key or a null id belong to no group. Repeated rows are counted each. Other columns are ignored. Empty table: no rows.
    """
    needed = df.select(F.col(id_col).cast("bigint").alias("_id"), *[trimmed(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(f).alias(f"_v{i}") for i, f in enumerate(fields)], F.col(time).alias("_at"), F.col(source).alias("file"))
    solid = needed.where("_id is not null and " + " and ".join(f"_k{i} <> ''" for i in range(len(keys))))
    group = [f"_k{i}" for i in range(len(keys))]
    groups = duplicate_groups(df.where(F.col(id_col).isNotNull()), id_col, keys)
    cast = durable(ballots(with_trust(solid, sources), "_id", group, {f: f"_v{i}" for i, f in enumerate(fields)}, "_at", half_life_days), "ballots")
    wide = elected(cast).join(groups, ["g1", "g2"], "left_semi").groupBy("g1", "g2").pivot("field", fields).agg(F.max("winner_id").alias("id"), F.max("votes").alias("votes"), F.max("dominant_id").alias("dominant"))
    return groups.join(wide, ["g1", "g2"], "left").drop("g1", "g2")
