"""Translation-memory lookups: recall by n-grams, exact verification, fragments, layers, upsert."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandemtext.functions import text as tx
from tandemtext.functions.alike import alike_block
from tandemtext.functions.overlap import PARTS, code_counts, code_rows, count_block, merge_blocks, support_block, weighted_block
from tandemtext.functions.pieces import piece_block
from tandemtext.functions.vectorized import best_fragment, ratio
from tandemtext.session import MIN_PARTITIONS, durable, shuffle_partitions, sized_join

POOLS = {3: 300, 2: 500}
SHORT_QUERY, THRESHOLD, TOP = 6, 0.6, 3
#: Characters of a fragment that is not weak, at least (text.weak_fragment).
LEAST = 4
#: Texts of a block in which grams are counted, at least and at most, and queries that a block takes at once.
BLOCK_LEAST, BLOCK_MOST, BLOCK_QUERIES = 3_000, 1 << 17, 1 << 15
#: A layer of at most so many entries has all that share a gram in its pools.
WHOLE = POOLS[min(POOLS)]
#: Entries of one text that meet its similar queries at once.
SPREAD = 1_000
#: Candidates of a layer for fragments, the fragments that a layer gives.
CANDIDATES, PIECES = 200, 5
#: Entries of small layers in a block that is searched for fragments, and queries that it takes at once.
PIECE_MOST, PIECE_QUERIES = 1 << 14, 1 << 12


def gram_table(df: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """The distinct n-grams of each text: `id, gram`."""
    return df.select(F.col(id_col).alias("id"), F.explode(tx.ngrams(tx.segments(F.col(text)), n)).alias("gram"))


def document_frequency(grams: DataFrame) -> DataFrame:
    return grams.groupBy("gram").agg(F.count("*").alias("df"))


def with_layer(entries: DataFrame) -> DataFrame:
    """Entries with a `layer`; without one all of them are one layer. Each layer is looked up by itself."""
    return entries if "layer" in entries.columns else entries.withColumn("layer", F.lit(""))


def compact(entries: DataFrame, most: int = max(POOLS.values())) -> tuple[DataFrame, DataFrame]:
    """The distinct sources of each layer of entries `e, source` and their first entries: `t, layer, source, n, size` and `t, e`.

    t is the text's first entry, n the number of its entries, size its normalised length. At most `most` entries of a text are
    kept, as no pool can hold more; that limit is applied by each task before the shuffle.
    """
    solid = with_layer(entries).where("source is not null")
    texts = durable(solid.groupBy("layer", "source").agg(F.min("e").alias("t"), F.count("*").alias("n")).withColumn("size", F.length(tx.normalized(F.col("source")))), "memory-texts")
    ranked = solid.withColumn("k", F.row_number().over(W.partitionBy("layer", "source").orderBy("e"))).where(F.col("k") <= most)
    return texts, durable(ranked.select("layer", "source", "e").join(texts.select("layer", "source", "t"), ["layer", "source"]).select("t", "e"), "memory-members")


def grams_of(texts: DataFrame, n: int) -> DataFrame:
    """The texts of compact() with their distinct n-grams as one array: `t, layer, n, size, grams`."""
    return durable(texts.select("t", "layer", "n", "size", tx.ngrams(tx.segments(F.col("source")), n).alias("grams")), "text-grams")


def shared_grams(asked: DataFrame, grams: DataFrame) -> DataFrame:
    """For queries `q, grams` the texts that share a gram, with the number of shared ones: `q, t, layer, n, shared`."""
    known = grams.repartition("t").select("t", F.explode("grams").alias("gram"))  # where the queries are broadcast, a text's counts stay in its task
    counts = known.join(asked.select("q", F.explode("grams").alias("gram")), "gram").groupBy("t", "q").agg(F.count("*").alias("shared"))
    return counts.join(grams.select("t", "layer", "n"), "t")


def at_least(counts: DataFrame, limit: int, by: str = "shared") -> DataFrame:
    """The rows of `q, layer, n` that can be among the first `limit` entries of a query and layer by a whole number: ties stay in.

    From a histogram of each query's numbers, so that nothing but what is needed is ever sorted.
    """
    steps = counts.groupBy("q", "layer", by).agg(F.sum(F.least("n", F.lit(limit))).alias("m"))
    upto = steps.withColumn("upto", F.sum("m").over(W.partitionBy("q", "layer").orderBy(F.desc(by))))
    least = upto.groupBy("q", "layer").agg(F.coalesce(F.max(F.when(F.col("upto") >= limit, F.col(by))), F.min(by)).alias("least"))
    return counts.join(least, ["q", "layer"]).where(F.col(by) >= F.col("least")).drop("least")


def _cut(texts: DataFrame, members: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """The first `limit` entries of each query and layer by the order, then by entry: rows of `texts` with `e`."""
    own = [c for c in texts.columns if c not in ("q", "layer")]
    first = texts.withColumn("k", F.row_number().over(W.partitionBy("q", "layer").orderBy(*order, "t"))).where(F.col("k") <= limit).drop("k")
    few = F.sum(F.least("n", F.lit(limit)))
    before = first.withColumn("tie", F.dense_rank().over(W.partitionBy("q", "layer").orderBy(*order)))
    before = before.withColumn("before", few.over(W.partitionBy("q", "layer").orderBy("tie")) - few.over(W.partitionBy("q", "layer", "tie"))).where(F.col("before") < limit)
    wide = before.select("q", "layer", *own).join(members, "t")
    return wide.withColumn("k", F.row_number().over(W.partitionBy("q", "layer").orderBy(*order, "e"))).where(F.col("k") <= limit).drop("k")


def pool(queries: DataFrame, texts: DataFrame, members: DataFrame, n: int, limit: int, least: float = 0.0) -> DataFrame:
    """For each query `q, source` and layer the entries that share most n-grams with it: `q, t, e`; ties by normalised length, first shared gram, entry.

    Counted over distinct texts, queries with one source once, so a text on a third of all rows counts once. Large layers
    are counted in blocks of texts, small ones with a join. With `least`, entries of large layers may be left out whose ratio
    their characters keep under it, after the pool is cut.
    """
    asked = durable(queries.groupBy("source").agg(F.min("q").alias("q")), "pool-queries")
    large, small = _by_size(texts)
    parts = [_block_pool(asked, texts.where(F.col("layer") == layer), members, n, limit, size, least) for layer, size in large.items()]
    if not parts or not small.isEmpty():
        parts.append(_join_pool(asked, small, members, n, limit))
    return _to_all(reduce(DataFrame.unionByName, parts), queries, asked)


def _by_size(texts: DataFrame) -> tuple[dict[str, int], DataFrame]:
    """The layers of at least BLOCK_LEAST texts with their sizes, and the texts of the others."""
    sizes = {r["layer"]: r["n"] for r in texts.groupBy("layer").agg(F.count("*").alias("n")).where(F.col("n") >= BLOCK_LEAST).collect()}  # few: each has so many texts
    return sizes, texts.where(~F.col("layer").isin(list(sizes))) if sizes else texts


def _block_pool(asked: DataFrame, texts: DataFrame, members: DataFrame, n: int, limit: int, size: int, least: float = 0.0) -> DataFrame:
    """The pools of one layer of `size` texts: `q, t, e`.

    Each block of texts is indexed by one task, counts the shared grams of all queries (in groups) and gives the first texts of
    each, some times as many as an even share. Where a block may have left out too much, the query is asked again for all.
    """
    plain = (tx.strip_markup(F.col("source")) if least else F.lit("")).alias("plain")
    known = texts.select("t", F.least("n", F.lit(limit)).cast("int").alias("n"), F.col("size").cast("int").alias("size"), _joined(), plain)
    return _from_blocks(asked.select("q", _joined(), plain), known, members, lambda most: count_block(n, most, least), limit, size).select("q", "t", "e")


def _joined(text: str = "source") -> Column:
    return F.array_join(tx.segments(F.col(text)), "\n").alias("segs")


def _from_blocks(asked: DataFrame, texts: DataFrame, members: DataFrame, count: Callable[[int], Callable], limit: int, size: int) -> DataFrame:
    """The first `limit` entries of each query among `size` texts in blocks: `q, t, e, shared`; count(most) gives a block's first texts."""
    blocks = max(min(MIN_PARTITIONS, -(-size // BLOCK_LEAST)), -(-size // BLOCK_MOST))
    groups = -(-asked.count() // BLOCK_QUERIES)
    known = texts.withColumn("block", F.pmod(F.xxhash64("t"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(groups, 1) - 1)))).withColumn("part", F.col("part") * blocks + F.col("block"))
    wide = asked.select("*", F.pmod(F.xxhash64("q"), F.lit(max(groups, 1))).alias("at"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).withColumn("part", F.col("at") * blocks + F.col("block"))

    def first(some: DataFrame, most: int) -> DataFrame:
        counts = some.select(*asked.columns, "part").groupBy("part").cogroup(known.select(*texts.columns, "part").groupBy("part")).applyInArrow(count(most), "q bigint, data binary, more boolean")
        return durable(counts.repartition("q").sortWithinPartitions("q").mapInArrow(merge_blocks(limit), "q bigint, t bigint, n int, room int, shared bigint"), "pool")

    found = first(wide, min(limit, 3 * limit // blocks + 16))
    again = found.where("room < 0").select("q")
    if not again.isEmpty():
        found = found.where("room is null or room > 0").unionByName(first(wide.join(again, "q", "left_semi"), limit))
    single = found.where("room is null and n = 1").select("q", "t", F.col("t").alias("e"), "shared")
    several = found.where("room > 0 or n > 1").join(members, "t")
    every = several.where("room is null").select("q", "t", "e", "shared")
    part = several.where("room > 0").withColumn("k", F.row_number().over(W.partitionBy("q").orderBy("e"))).where("k <= room").select("q", "t", "e", "shared")
    return single.unionByName(every).unionByName(part)


def _join_pool(asked: DataFrame, texts: DataFrame, members: DataFrame, n: int, limit: int) -> DataFrame:
    """The pools of layers of any size: `q, t, e`.

    A histogram of the counts leaves out what cannot be in the pool before anything is sorted; the first shared gram is
    looked up for the rest only.
    """
    grams = grams_of(texts, n)
    asked = durable(asked.withColumn("grams", tx.ngrams(tx.segments(F.col("source")), n)), "pool-grams")
    left = at_least(durable(shared_grams(asked, grams), "pool-counts"), limit)
    both = left.join(asked.select("q", F.col("grams").alias("asked")), "q").join(grams.select("t", "size", "grams"), "t")
    named = both.select("q", "t", "layer", "n", "shared", "size", F.array_min(F.array_intersect("asked", "grams")).alias("first"))
    return _cut(named, members, [F.desc("shared"), "size", "first"], limit).select("q", "t", "e")


def _to_all(found: DataFrame, queries: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows found for one query of each source, for all queries with it."""
    names = queries.select("source", F.col("q").alias("id")).join(asked.select("source", "q"), "source").select("q", "id")
    return found.join(names, "q").drop("q").withColumnRenamed("id", "q")


def short_pairs(short: DataFrame, texts: DataFrame) -> DataFrame:
    """Short queries `q, source` with the texts that can reach the threshold: `q, t`.

    A ratio of 0.6 needs lengths within 3/7 and 7/3 of each other and a common character; the join is on both, so that texts
    without a common character never meet.
    """
    plain = tx.strip_markup(F.col("source"))
    letters = F.array_distinct(F.split(plain, ""))
    known = texts.select("t", F.length(plain).alias("n"), F.explode(letters).alias("c"))
    wide = short.select("q", F.length(plain).alias("m"), letters.alias("cs")).select("q", F.explode("cs").alias("c"), F.sequence(F.ceil(F.col("m") * 3 / 7).cast("int"), F.floor(F.col("m") * 7 / 3).cast("int")).alias("ns"))
    return wide.select("q", "c", F.explode("ns").alias("n")).join(known, ["n", "c"]).select("q", "t").distinct()


def recall(queries: DataFrame, entries: DataFrame, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Candidates of the queries `q, source` among the entries of each layer, both pools; for short queries, all that can reach the threshold.

    Gives `q, t` with the texts, and the texts `t, layer, source, ...`. A pool is cut by entries: one text on very many of them fills it.
    """
    texts, members = compact(entries)
    bare = F.length(F.regexp_replace(tx.normalized(F.col("source")), tx.SEPARATORS, ""))
    short, long = queries.where(bare <= SHORT_QUERY), queries.where(bare > SHORT_QUERY)
    pairs = short_pairs(short, texts)
    for n, limit in POOLS.items():
        pairs = pairs.unionByName(pool(long, texts, members, n, limit, least).select("q", "t"))
    return durable(pairs.distinct(), "tm-recall"), texts


def fuzzy_matches(queries: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, top: int = TOP, keep: tuple[str, ...] = ()) -> DataFrame:
    """The best entries of each layer for each query: `q, layer, e, similarity, rank`, with the entries' columns `keep`.

    queries: `q, source, context`; entries: `e, source, context` and perhaps `layer`. The ratio is worked out once for each pair
    of distinct texts; of one text's entries with one context only the first `top` can be among the best. Sorted by rounded
    similarity, context affinity, entry. Layers that no pool can cut are searched together, text by text, the others by pools.
    """
    asked = durable(queries.where("source <> ''").groupBy("source").agg(F.min("q").alias("q")), "tm-queries")
    named = queries.select("q", "source", F.coalesce("context", F.lit("")).alias("qc")).join(asked.select("source", F.col("q").alias("a")), "source").select("a", "q", "qc")
    solid = with_layer(entries).where("source is not null")
    large = durable(solid.groupBy("layer").agg(F.count("*").alias("n")).where((F.col("n") > WHOLE) | (F.col("n") >= BLOCK_LEAST)).select("layer"), "large-layers")
    parts = [_alike_rows(asked, named, sized_join(solid, large, "layer", "left_anti"), threshold, top, keep)]
    if not large.isEmpty():
        parts.append(_pool_rows(asked, named, sized_join(solid, large, "layer", "left_semi"), threshold, top, keep))
    rows = reduce(DataFrame.unionByName, parts).repartition("q")  # later windows of a query need no other shuffle
    order = W.partitionBy("q", "layer").orderBy(F.desc("similarity"), F.desc("affinity"), "e")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("q", "layer", "e", "similarity", "rank", *keep)


def _first_entries(entries: DataFrame, top: int, keep: tuple[str, ...]) -> DataFrame:
    """Of each layer's entries with one source and context the first `top`: `e, layer, source, ec` and the columns `keep`."""
    contexts = W.partitionBy("layer", "source", "ec").orderBy("e")
    return entries.select("e", "layer", "source", F.coalesce("context", F.lit("")).alias("ec"), *keep).withColumn("k", F.row_number().over(contexts)).where(F.col("k") <= top).drop("k")


def _scored(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return rows.select("q", "layer", "e", "similarity", tx.context_affinity(F.col("qc"), F.col("ec")).alias("affinity"), *keep)


def _pool_rows(asked: DataFrame, named: DataFrame, entries: DataFrame, threshold: float, top: int, keep: tuple[str, ...]) -> DataFrame:
    """The entries with a similar text from the pools of each layer: `q, layer, e, similarity, affinity`."""
    pairs, texts = recall(asked, entries, threshold)
    known = texts.select("t", "layer", F.col("source").alias("entry"))
    both = pairs.join(asked.select("q", F.col("source").alias("query")), "q").join(known, "t").select("q", "query", "entry", "layer")
    once = both.select("query", "entry").distinct()
    scored = once.withColumn("r", ratio(tx.strip_markup(F.col("query")), tx.strip_markup(F.col("entry")), F.lit(threshold))).where(F.col("r") >= threshold)
    hits = durable(both.join(scored, ["query", "entry"]).select(F.col("q").alias("a"), F.col("entry").alias("source"), "layer", F.bround("r", 4).alias("similarity")), "tm-hits")
    return _scored(named.join(hits, "a").join(_first_entries(entries, top, keep), ["layer", "source"]), keep)


def _alike_rows(asked: DataFrame, named: DataFrame, entries: DataFrame, threshold: float, top: int, keep: tuple[str, ...]) -> DataFrame:
    """The entries with a similar text from layers of at most WHOLE entries: `q, layer, e, similarity, affinity`.

    Their pools hold all that share a gram, so it makes no difference in which layers a text is: each pair of distinct texts is
    looked at once, in blocks of texts. Texts on many entries are joined to them in several parts.
    """
    counted = entries.groupBy("source").agg(F.min("e").alias("t"), F.ceil(F.count("*") / SPREAD).cast("int").alias("parts"))
    texts = durable(counted, "alike-texts")
    first = _first_entries(entries, top, keep).join(texts, "source").select("e", "layer", "ec", "t", F.pmod(F.xxhash64("e"), F.col("parts")).cast("int").alias("share"), *keep)
    hits = durable(_alike(asked, texts, threshold).withColumnRenamed("q", "a"), "alike-hits")
    wide = named.join(hits, "a").join(texts.select("t", "parts"), "t").select("q", "qc", "t", "similarity", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("share"))
    return _scored(wide.join(first, ["t", "share"]), keep)


def _alike(asked: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The texts `t, source` that share a 2-gram with each query `q, source` (any, if it is short) and reach the threshold: `q, t, similarity`."""
    blocks = max(2 * MIN_PARTITIONS, -(-texts.count() // BLOCK_MOST))
    groups = max(-(-asked.count() // BLOCK_QUERIES), 1)
    plain = tx.strip_markup(F.col("source")).alias("plain")
    free = (F.length(F.regexp_replace(tx.normalized(F.col("source")), tx.SEPARATORS, "")) <= SHORT_QUERY).alias("free")
    known = texts.select("t", plain, _joined(), F.pmod(F.xxhash64("t"), F.lit(blocks)).alias("block")).select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("at"))
    wide = asked.select("q", plain, _joined(), free, F.pmod(F.xxhash64("q"), F.lit(groups)).alias("at")).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    part = (F.col("at") * blocks + F.col("block")).alias("part")
    found = wide.select("q", "plain", "segs", "free", part).groupBy("part").cogroup(known.select("t", "plain", "segs", part).groupBy("part")).applyInArrow(alike_block(min(POOLS), threshold), "q bigint, t bigint, r double")
    return found.select("q", "t", F.bround("r", 4).alias("similarity"))


def idf_candidates(queries: DataFrame, entries: DataFrame, limit: int = 200) -> DataFrame:
    """Entries of each layer by the sum of the inverse frequencies of shared 3- and 2-grams: `q, layer, e, score`, at most `limit` a query and layer.

    Frequencies count entries, worked out from distinct texts and their numbers.
    """
    texts, members = compact(entries, limit)
    asked = durable(queries.groupBy("source").agg(F.min("q").alias("q")), "idf-queries")
    large, small = _by_size(texts)
    parts = [_block_scores(asked, texts.where(F.col("layer") == layer), members, limit, size).withColumn("layer", F.lit(layer)) for layer, size in large.items()]
    if not parts or not small.isEmpty():
        parts.append(_join_scores(asked, small, members, limit))
    return _to_all(reduce(DataFrame.unionByName, parts), queries, asked)


def _block_scores(asked: DataFrame, texts: DataFrame, members: DataFrame, limit: int, size: int) -> DataFrame:
    """The scores of one layer of `size` texts: `q, e, score`."""
    known = texts.select("t", F.col("n").alias("all"), F.least("n", F.lit(limit)).cast("int").alias("n"), F.col("size").cast("int").alias("size"), _joined())
    df = known.select("segs", F.col("all").alias("n")).mapInArrow(code_counts, "code bigint, df bigint").groupBy("code").agg(F.sum("df").alias("df"))
    total = texts.agg((F.sum("n") + 1).alias("total"))
    grams = asked.select("q", _joined()).mapInArrow(code_rows, "q bigint, code bigint").join(df, "code").crossJoin(F.broadcast(total))
    weighed = grams.select("q", F.struct("code", (F.log(F.col("total") / (F.col("df") + 1)) + 1).alias("w")).alias("x")).groupBy("q").agg(F.collect_list("x").alias("xs"))
    wanted = durable(weighed.select("q", F.col("xs.code").alias("codes"), F.col("xs.w").alias("weights")), "idf-grams")
    return _from_blocks(wanted, known.drop("all"), members, weighted_block, limit, size).select("q", "e", (F.col("shared") / F.lit(PARTS)).alias("score"))


def _join_scores(asked: DataFrame, texts: DataFrame, members: DataFrame, limit: int) -> DataFrame:
    """The scores of layers of any size: `q, layer, e, score`."""
    asked = asked.withColumn("segs", tx.segments(F.col("source")))
    totals = texts.groupBy("layer").agg((F.sum("n") + 1).alias("total"))
    parts = []
    for n in (3, 2):
        known = grams_of(texts, n).select("t", "layer", "n", F.explode("grams").alias("gram"))
        df = known.groupBy("layer", "gram").agg(F.sum("n").alias("df"))
        idf = df.join(totals, "layer").select("layer", "gram", (F.log(F.col("total") / (F.col("df") + 1)) + 1).alias("idf"))
        wanted = asked.select("q", F.explode(tx.ngrams(F.col("segs"), n)).alias("gram")).join(idf, "gram")
        parts.append(wanted.join(known.select("t", "layer", "gram"), ["layer", "gram"]).groupBy("q", "t").agg(F.sum("idf").alias("score")))
    sums = parts[0].unionByName(parts[1]).groupBy("q", "t").agg(F.round(F.sum("score"), 9).alias("score"))
    scores = durable(sums.join(texts.select("t", "layer", "n", "size"), "t").withColumn("step", F.floor(F.col("score") * 8)), "idf-scores")
    return _cut(at_least(scores, limit, "step").drop("step"), members, [F.desc("score"), "size"], limit).select("q", "layer", "e", "score")


def fragment_support(fragments: DataFrame, entries: DataFrame) -> DataFrame:
    """How many distinct sources and files have a segment with each fragment: `layer, fragment, sources, files`.

    Large layers are searched in blocks of texts, to which all their fragments go; of small layers many share a task.
    """
    fragments, entries = with_layer(fragments), with_layer(entries).where("source is not null")
    files = entries.where("file <> ''").select("file").distinct().withColumn("no", F.row_number().over(W.orderBy("file")))  # one row a file
    pairs = durable(entries.select("layer", "source", "file").distinct().join(files, "file", "left").groupBy("layer", "source").agg(F.collect_set("no").alias("files")), "support-pairs")
    sizes = {r["layer"]: r["n"] for r in pairs.groupBy("layer").agg(F.count("*").alias("n")).where(F.col("n") >= BLOCK_LEAST).collect()}  # few: each has so many texts
    blocks = max([MIN_PARTITIONS, *(-(-n // BLOCK_MOST) for n in sizes.values())])
    large, own = F.col("layer").isin(list(sizes)) if sizes else F.lit(False), F.xxhash64("layer").alias("own")
    salt = F.when(large, F.pmod(F.xxhash64("source"), F.lit(blocks))).otherwise(F.lit(0).cast("bigint"))
    part = F.when(large, F.col("salt")).otherwise(F.pmod(F.xxhash64("layer"), F.lit(shuffle_partitions(entries.sparkSession)))).alias("part")
    known = pairs.withColumn("salt", salt).select(part, large.alias("large"), own, _joined(), "files")
    asked = fragments.where("fragment is not null").select("layer", "fragment").distinct()
    asked = asked.withColumn("salt", F.explode(F.when(large, F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(F.array(F.lit(0))))).select(part, large.alias("large"), own, "layer", "fragment")
    found = asked.groupBy("part", "large").cogroup(known.groupBy("part", "large")).applyInArrow(lambda f, t: support_block(f, t), "layer string, fragment string, sources bigint, files array<int>")
    return found.groupBy("layer", "fragment").agg(F.sum("sources").alias("sources"), F.size(F.array_distinct(F.flatten(F.collect_list("files")))).cast("bigint").alias("files"))


def has_run(text: str) -> Column:
    """Whether a segment has as many characters as a fragment needs."""
    return F.exists(tx.segments(F.col(text)), lambda s: F.length(s) >= LEAST)


def layer_pieces(queries: DataFrame, entries: DataFrame, top: int = PIECES) -> DataFrame:
    """fragment_matches() for layers of at most CANDIDATES entries, all of which are candidates: `q, e, fragment, score, m, sources, files, rank, dt, at, no, runtime`.

    queries: `q, source, seen, strong`: pairs `s, since` of texts that are no evidence from a place on, sorted, and layers to leave
    out; entries: `e, own, s, place, source, target, file, dt, at, no, runtime`, with numbers for layer, text, place, shown
    target and document. Whole layers are searched in blocks. Of runtime entries with one fragment and shown target only a
    block's best one is given, which a layer's own order does not change. m is the length of the query's segments.
    """
    rows = entries.where("source is not null").select("e", "own", "s", "place", "source", F.coalesce("file", F.lit("")).alias("file"), "target", "dt", "at", "no", "runtime", _joined())
    blocks, groups = max(MIN_PARTITIONS, -(-rows.count() // PIECE_MOST)), max(-(-queries.count() // PIECE_QUERIES), 1)
    known = rows.withColumn("block", F.pmod(F.xxhash64("own"), F.lit(blocks))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = queries.select("q", _joined(), F.col("seen.s").alias("ex"), F.col("seen.since").alias("since"), "strong", F.pmod(F.xxhash64("q"), F.lit(groups)).alias("group")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    part = (F.col("group") * blocks + F.col("block")).alias("part")
    kind = "q bigint, e bigint, fragment string, score double, m int, sources int, files int, rank int, dt bigint, at int, no int, runtime boolean"
    return asked.select("q", "segs", "ex", "since", "strong", part).groupBy("part").cogroup(known.select(*rows.columns, part).groupBy("part")).applyInArrow(piece_block(top), kind)


def fragment_matches(queries: DataFrame, entries: DataFrame, top: int = PIECES, limit: int = CANDIDATES, seen: DataFrame | None = None) -> DataFrame:
    """Reusable fragments of each layer for each query: `q, layer, fragment, e, target, score, coverage, sources, files, rank`.

    queries: `q, source` and perhaps `layer`, if a query asks some layers only; entries: `e, source, target, file`. An entry with
    the query's own source is no evidence for it, nor, with `seen` (`q, entry, since`), one with a source that a layer not after its
    own has matched; entries then have the `place` of their layer.
    """
    entries = with_layer(entries)
    candidates = idf_candidates(queries.select("q", "source").distinct(), entries, limit)
    if "layer" in queries.columns:
        candidates = candidates.join(queries.select("q", "layer").distinct(), ["q", "layer"], "left_semi")
    asked, known = queries.select("q", F.col("source").alias("query")).distinct(), entries.select("e", "source").where("source is not null")
    m = F.length(F.replace("qs", F.lit("\n")))
    both = candidates.join(asked.select("q", _joined("query").alias("qs")), "q").join(known.select("e", _joined().alias("es")), "e")  # other texts of the few that have a fragment come later
    found = both.withColumn("b", best_fragment(LEAST)("qs", "es")).select("q", "layer", "e", "score", "b.fragment", F.length("b.segment").alias("n"), m.alias("m")).where(~tx.weak_fragment(F.col("fragment")))
    found = durable(found, "fragments-found").join(asked, "q").join(entries.select("e", "target", F.coalesce("file", F.lit("")).alias("file"), F.col("source").alias("entry")), "e").where("query <> entry")
    if seen is not None:
        found = found.join(entries.select("e", "place"), "e").join(seen, ["q", "entry"], "left").where("since is null or since > place").drop("since", "place")
    best = durable(found.drop("query"), "fragments")
    size, cover = F.length("fragment"), F.length("fragment") / F.greatest("m", F.lit(1))
    scored = best.join(fragment_support(best, entries), ["layer", "fragment"]).withColumns({
        "coverage": F.bround(cover, 4),
        "score": F.bround(F.col("score") + size * 2.0 + cover * 10.0 + size / F.greatest("n", F.lit(1)) * 2.0 + F.col("sources") * 1.25 + F.col("files") * 0.75, 4),
    })
    order = [F.desc("score"), F.desc("files"), F.desc("sources"), F.desc(F.length("fragment")), "file", "entry", "e"]
    once = durable(scored.withColumn("k", F.row_number().over(W.partitionBy("q", "layer", "fragment", "target").orderBy(*order))).where("k = 1").drop("k"), "fragments-once")
    other = once.select(F.col("q").alias("q2"), F.col("layer").alias("l2"), F.col("fragment").alias("f2"), F.col("score").alias("s2"), F.col("e").alias("e2"), F.col("target").alias("t2"))
    left = once.join(other, F.expr("q = q2 and layer = l2 and target is not null and contains(f2, fragment) and s2 >= score and not (f2 = fragment and e2 = e and t2 <=> target)"), "left_anti")
    return left.withColumn("rank", F.row_number().over(W.partitionBy("q", "layer").orderBy(*order))).where(F.col("rank") <= top).select("q", "layer", "fragment", "e", "target", "score", "coverage", "sources", "files", "rank")


def first_wins(entries: DataFrame, order: str = "entry_id") -> DataFrame:
    """One row per source and context (outer blanks aside): the first; rows with a blank source or target are left out."""
    s, t, c = (tx.stripped(F.coalesce(F.col(x), F.lit(""))) for x in ("source", "target", "context"))
    solid = entries.where((s != "") & (t != "")).withColumns({"_s": s, "_c": c})
    firsts = solid.groupBy("_s", "_c").agg(F.min(order).alias(order))
    return solid.drop("_s", "_c").join(firsts.select(order), order, "left_semi")


def upsert(old: DataFrame, new: DataFrame, replace: bool = True, last: int | None = None) -> DataFrame:
    """MERGE of new entries into a memory, by source and context (outer blanks aside), as if they came one after another by entry_id.

    Of old rows with one key only the first counts. If `replace` and the new row's file is the same (null and empty are one), it
    takes the new row's texts, the last of several; another file leaves it as it is. A new key is appended with a new entry_id,
    its own counted on from the memory's last, `last` where `old` is a part of the memory (no global numbering); later new rows with
    its key and file replace it likewise.
    """
    key = {"_s": tx.stripped(F.coalesce("source", F.lit(""))), "_c": tx.stripped(F.coalesce("context", F.lit(""))), "_f": F.coalesce("file", F.lit(""))}
    o, n = old.withColumns(key), new.withColumns(key)
    texts = F.struct("source", "target", "context", "file")
    last_of = n.groupBy("_s", "_c", "_f").agg(F.max_by(texts, "entry_id").alias("u"))
    firsts = o.groupBy("_s", "_c").agg(F.min_by(F.struct("entry_id", "_f"), "entry_id").alias("x")).select("_s", "_c", F.col("x.entry_id").alias("entry_id"), F.col("x._f").alias("_f"))
    pick = lambda c: F.when(F.col("u").isNotNull() & F.lit(replace), F.col(f"u.{c}")).otherwise(F.col(c)).alias(c)
    columns = ["entry_id", pick("source"), pick("target"), pick("context"), pick("file")]
    kept = o.join(firsts.join(last_of, ["_s", "_c", "_f"]).select("entry_id", "u"), "entry_id", "left").select(*columns)
    fresh = n.join(firsts.select("_s", "_c"), ["_s", "_c"], "left_anti").groupBy("_s", "_c").agg(F.min_by(F.struct("source", "target", "context", "file", "_f"), "entry_id").alias("x"), F.min("entry_id").alias("at"))
    start = old.agg(F.coalesce(F.max("entry_id"), F.lit(0))).first()[0] if last is None else last
    added = fresh.select("_s", "_c", (F.lit(start) + F.col("at")).cast("bigint").alias("entry_id"), "x.*").join(last_of, ["_s", "_c", "_f"]).select(*columns)
    return kept.unionByName(added)


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """New entries after the old ones without looking for equal keys, numbered on from the memory's last entry_id."""
    start = old.agg(F.coalesce(F.max("entry_id"), F.lit(0))).first()[0]
    return old.unionByName(new.withColumn("entry_id", (F.lit(start) + F.col("entry_id")).cast("bigint")))


def layered(entries: DataFrame) -> DataFrame:
    """The entry that counts for each source and context: permanent before runtime, later batches before earlier ones.

    `source, context, target, entry_id, scope, batch`; ties go to the later entry_id of the runtime layers and the first of the permanent.
    """
    rank = F.struct(
        (F.col("scope") == "permanent").cast("int").alias("layer"), F.coalesce(F.when(F.col("scope") == "runtime", F.col("batch")), F.lit(-1)).alias("at"),
        F.when(F.col("scope") == "permanent", -F.col("entry_id")).otherwise(F.col("entry_id")).alias("tie"),
    )
    solid = entries.where(tx.stripped(F.coalesce("target", F.lit(""))) != "").withColumn("context", F.coalesce("context", F.lit("")))
    return solid.groupBy("source", "context").agg(F.max_by(F.struct("target", "entry_id", "scope", "batch"), rank).alias("w")).select("source", "context", "w.*")
