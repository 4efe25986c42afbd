"""Memory layers: a permanent memory and runtime layers of submitted batches, looked up one by one and merged with their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandemtext.functions import text as tx
from tandemtext.operators import memory
from tandemtext.session import durable

#: A whole match of at least this similarity makes fragments of its layer needless.
STRONG = 0.85
#: How a runtime layer's file is named.
BATCH_FILE = r"_batch_(\d+)\.json$"


def layer_files(spark: SparkSession, paths: list[str], own: str | None = None) -> DataFrame:
    """Runtime-layer files below the given folders or patterns and the own folder: `path, batch, document, ord`.

    Paths are normalised and listed once; files without a batch number come last, the others by number, then by path.
    """
    places = [*paths, *([own] if own else [])]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(places).select("path") if places else spark.createDataFrame([], "path string")
    known = rows.select(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "/(?:\\./)+", "/").alias("path")).distinct().where(F.col("path").rlike(BATCH_FILE) | F.col("path").rlike(r"\.json$"))
    named = known.select("path", F.expr(rf"try_cast(nullif(regexp_extract(path, '{BATCH_FILE.replace(chr(92), chr(92) * 2)}', 1), '') as int)").alias("batch"), F.element_at(F.split("path", "/"), -2).alias("document"))
    return named.withColumn("ord", F.row_number().over(W.orderBy(F.col("batch").isNull(), F.coalesce("batch", F.lit(0)), "path")))  # one row a file


def named_layers(entries: DataFrame) -> DataFrame:
    """Entries with `layer`: the permanent memory is one, each document's batch another."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return entries.withColumn("layer", F.when(F.col("scope") == "permanent", F.lit("permanent")).otherwise(F.concat_ws("/", F.lit("runtime"), part("document"), part("batch"))))


def layer_counts(entries: DataFrame) -> DataFrame:
    """Layers and entries by scope: `scope, layers, entries`."""
    return named_layers(entries).groupBy("scope").agg(F.count_distinct("layer").alias("layers"), F.count("*").alias("entries"))


def runtime_entries(units: DataFrame, submitted: DataFrame, document: str, batch: int) -> DataFrame:
    """The entries of exactly the submitted ids `id` that may be written: those not preserved, with a source and a target.

    units: `id, source, target, context, baseline, locked, source_locked, preserve`. Texts are kept without outer blanks.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    preserved = flag("preserve") | flag("source_locked") | (flag("locked") & (F.coalesce("baseline", F.lit("")) != ""))
    rows = units.where(~preserved).join(submitted.select("id").distinct(), "id", "left_semi")
    solid = rows.select("id", tx.stripped(F.col("source")).alias("source"), tx.stripped(F.col("target")).alias("target"), F.coalesce("context", F.lit("")).alias("context")).where("source <> '' and target <> ''")
    return solid.withColumns({"scope": F.lit("runtime"), "document": F.lit(document), "batch": F.lit(batch)})


def rebuilt(layers: DataFrame, units: DataFrame, submitted: DataFrame) -> DataFrame:
    """All runtime layers anew: for each `document, batch` of `submitted` (with `id`) the entries of its units as they are now.

    What the old `layers` hold for other documents or batches is left out, as nothing vouches for it.
    """
    keys = submitted.select("id", "document", "batch").distinct()
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    free = units.where(~(flag("preserve") | flag("source_locked") | (flag("locked") & (F.coalesce("baseline", F.lit("")) != ""))))
    rows = free.join(keys, "id").select("document", "batch", "id", tx.stripped(F.col("source")).alias("source"), tx.stripped(F.col("target")).alias("target"), F.coalesce("context", F.lit("")).alias("context"))
    known = layers.select("document", "batch").distinct()
    return rows.where("source <> '' and target <> ''").join(known.withColumn("former", F.lit(True)), ["document", "batch"], "left").withColumn("former", F.coalesce("former", F.lit(False)))


PROVENANCE = ["scope", "batch", "document"]


def _prepared(entries: DataFrame) -> DataFrame:
    order = F.struct(F.coalesce((F.col("scope") == "runtime").cast("int"), F.lit(-1)).alias("late"), F.col("batch").isNull().alias("none"), F.coalesce("batch", F.lit(0)).alias("at"), F.coalesce("document", F.lit("")).alias("doc"))
    return named_layers(entries).withColumn("place", order)


def _matched(queries: DataFrame, known: DataFrame) -> DataFrame:
    """The best matches of each layer with what orders them: `q, own, e, similarity, rank, late, at, no, same`.

    own, no and same are numbers in place of the layer, of the document in order of name and of the entries with one shown source and
    context, so that no texts are moved with the matches.
    """
    shown = [tx.display_tags(F.col("source")).alias("source"), F.coalesce("context", F.lit("")).alias("context")]
    same = known.where("source is not null").select("e", *shown).groupBy("source", "context").agg(F.min("e").alias("same"), F.collect_list("e").alias("es")).select("same", F.explode("es").alias("e"))
    documents = known.select("document").where("document is not null").distinct().withColumn("no", F.row_number().over(W.orderBy("document")))  # one row a document
    own = known.groupBy("layer").agg(F.min("e").alias("own"))
    numbered = known.where("scope is not null").select("e", "layer", "source", "context", "document", (F.col("scope") == "runtime").alias("late"), F.coalesce("batch", F.lit(-1)).alias("at")).join(own, "layer").join(documents, "document", "left").join(same, "e")
    few = durable(numbered.select("e", F.col("own").alias("layer"), "source", "context", "late", "at", "no", "same"), "layer-entries")
    return memory.fuzzy_matches(queries, few, keep=("late", "at", "no", "same")).withColumnRenamed("layer", "own")


def whole_matches(queries: DataFrame, entries: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Whole matches of `q, source, context` from all layers, with their provenance.

    entries: `e, source, target, context, file, scope, batch, document`. Each layer gives its own best matches. The permanent
    ones all count, first; of the runtime ones with one shown source and context the latest batch's, in order of similarity, then
    batch. Texts are shown with readable tags.

    Returns `q, scope, batch, document, e, source, target, context, file, similarity, pos`; pos orders the rows of a query and scope.
    """
    matched = _matched(queries, _prepared(entries)) if matched is None else matched
    latest = W.partitionBy("q", "late", "same").orderBy(F.desc("at"), F.desc("no"), F.desc("rank"))
    left = matched.withColumn("k", F.when(F.col("late"), F.row_number().over(latest)).otherwise(1)).where("k = 1")
    order = W.partitionBy("q", "late").orderBy(F.desc("similarity"), F.desc("at"), "no", "rank", "e")
    placed = left.withColumn("pos", F.when(F.col("late"), F.row_number().over(order)).otherwise(F.col("rank"))).select("q", "e", "similarity", "pos")
    about = entries.select("e", tx.display_tags(F.col("source")).alias("source"), tx.display_tags(F.col("target")).alias("target"), F.coalesce("context", F.lit("")).alias("context"), "file", *PROVENANCE)
    return placed.join(about, "e").select("q", *PROVENANCE, "e", "source", "target", "context", "file", "similarity", "pos")


def _numbered(known: DataFrame) -> DataFrame:
    """Entries with numbers in place of layer, source, place, shown target and document, so that no texts are moved with what is found: `e, own, small, s, place, source, target, file, dt, at, no, runtime`.

    small: whether all of the layer's entries are candidates for fragments.
    """
    own = known.groupBy("layer").agg(F.min("e").alias("own"), (F.count("source") <= memory.CANDIDATES).alias("small"))
    texts = known.where("source is not null").groupBy("source").agg(F.min("e").alias("s"))
    targets = [F.col("dt_text").isNull().alias("none"), F.coalesce("dt_text", F.lit("")).alias("text")]
    shown = known.select("e", "layer", "source", "target", "file", "scope", "batch", "document", "place", tx.display_tags(F.col("target")).alias("dt_text")).select("*", *targets).drop("dt_text")
    same = shown.groupBy("none", "text").agg(F.min("e").alias("dt"))
    places = known.select("place").distinct().withColumn("stage", F.row_number().over(W.orderBy("place")))  # one row a layer
    documents = known.select("document").where("document is not null").distinct().withColumn("no", F.row_number().over(W.orderBy("document")))  # one row a document
    every = shown.where("source is not null").join(own, "layer").join(texts, "source").join(same, ["none", "text"]).join(places, "place").join(documents, "document", "left")
    late = F.coalesce(F.col("scope") == "runtime", F.lit(False)).alias("runtime")
    return durable(every.select("e", "own", "small", "s", F.col("stage").alias("place"), "source", "target", "file", "dt", F.coalesce("batch", F.lit(-1)).cast("int").alias("at"), F.coalesce("no", F.lit(0)).alias("no"), late), "layer-numbers")


def fragments(queries: DataFrame, entries: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Fragments for `q, source, context` from the layers without a match of at least STRONG, never from a source that a layer so far matched.

    Of runtime fragments with one text and target the best counts, the latest of equal ones. Queries without a run that could be a
    fragment are left out first, as they match very many layers.

    Returns `q, scope, batch, document, fragment, e, source, target, file, score, coverage, sources, files, pos`.
    """
    known = _prepared(entries)
    asked = durable(queries.where(memory.has_run("source")), "piece-queries")
    matched = durable(_matched(asked, known), "layer-matches") if matched is None else matched
    numbers = _numbered(known)
    texts = numbers.where("e = s").select("s", "source")
    strong = matched.where(F.col("similarity") >= STRONG).select("q", "own").distinct()
    seen = durable(matched.select("q", "e").join(numbers.select("e", "s", "place"), "e").groupBy("q", "s").agg(F.min("place").alias("since")), "layer-seen")
    self = asked.select("q", "source").join(texts, "source").select("q", "s", F.lit(0).alias("since"))
    barred = seen.unionByName(self).groupBy("q", "s").agg(F.min("since").alias("since")).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("s", "since"))).alias("seen"))
    wide = asked.select("q", "source").join(barred, "q", "left").join(strong.groupBy("q").agg(F.collect_list("own").alias("strong")), "q", "left")
    wide = durable(wide.select("q", "source", F.coalesce("seen", F.array().cast("array<struct<s:bigint,since:int>>")).alias("seen"), F.coalesce("strong", F.array().cast("array<bigint>")).alias("strong")), "piece-lists")
    found = memory.layer_pieces(wide, numbers.where("small")).withColumn("coverage", F.bround(F.length("fragment") / F.greatest("m", F.lit(1)), 4)).drop("m")
    large = numbers.where("not small")
    if not large.isEmpty():
        pieces = memory.fragment_matches(asked.select("q", "source"), large.select("e", F.col("own").cast("string").alias("layer"), "place", "source", "target", "file"), seen=seen.join(texts, "s").select("q", F.col("source").alias("entry"), "since"))
        left = pieces.withColumn("own", F.col("layer").cast("bigint")).join(strong, ["q", "own"], "left_anti").join(large.select("e", "dt", "at", "no", "runtime"), "e")
        found = found.unionByName(left.select(*found.columns))
    order = [F.desc("score"), F.desc("at"), "no", "rank"]
    every = found.repartition("q").withColumn("k", F.when(F.col("runtime"), F.row_number().over(W.partitionBy("q", "runtime", "fragment", "dt").orderBy(*order))).otherwise(1)).where("k = 1")
    placed = every.withColumn("pos", F.when(F.col("runtime"), F.row_number().over(W.partitionBy("q", "runtime").orderBy(F.desc("score"), F.desc("files"), F.desc("at"), "no", "rank", "e"))).otherwise(F.col("rank")))
    about = entries.where("scope is not null").select("e", tx.display_tags(F.col("source")).alias("source"), tx.display_tags(F.col("target")).alias("target"), "file", *PROVENANCE)
    numbers_of = [F.col(c).cast("bigint").alias(c) for c in ("sources", "files")]
    return placed.select("q", "e", "fragment", "score", "coverage", *numbers_of, "pos").join(about, "e").select("q", *PROVENANCE, "fragment", "e", "source", "target", "file", "score", "coverage", "sources", "files", "pos")


def lookup(queries: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole matches and fragments together; the matches are worked out once."""
    matched = durable(_matched(queries, _prepared(entries)), "layer-matches")
    return whole_matches(queries, entries, matched), fragments(queries, entries, matched)
