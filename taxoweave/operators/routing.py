"""Which inputs are settled by name, which branch the others belong to, and their batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import similarity, text
from ..scratch import keep


def path_matches(inputs: DataFrame, refs: DataFrame) -> DataFrame:
    """Per distinct (name, input path): n_refs, and the best reference by path similarity.

    inputs: name, full_path; refs: id, name, full_path, ord. Leaves that have the name and the words
    of the path in common score alike, so each such class is compared once, however many leaves it
    has; a path is taken apart once, before classes meet."""
    words = lambda c: F.array_sort(text.path_words(F.col(c)))
    a = inputs.select(F.lower("name").alias("k"), F.col("full_path").alias("input_path")).distinct().withColumn("mine", words("input_path"))
    b = refs.groupBy(F.lower("name").alias("k"), F.col("full_path").alias("ref_path")).agg(F.min(F.struct("ord", "id")).alias("r"), F.count("*").alias("n"))
    b = b.withColumn("theirs", words("ref_path")).groupBy("k", "theirs").agg(F.min("r").alias("r"), F.sum("n").alias("n"))
    pairs = a.select("k", "mine").distinct().join(b, "k").withColumn("score", similarity.set_jaccard(F.col("mine"), F.col("theirs")))
    best = F.max_by(F.struct("r", "score"), F.struct("score", -F.col("r.ord")))
    classes = pairs.groupBy("k", "mine").agg(F.sum("n").alias("n_refs"), best.alias("b"))
    return a.join(classes, ["k", "mine"]).select("k", "input_path", "n_refs", F.col("b.r.id").alias("ref_id"), "b.score")


def exact_router(inputs: DataFrame, refs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """inputs with match_id, confidence, method: one reference of the name: 1.0; several: the best by
    path if it is over the threshold: 0.9; else none and method null (left over)."""
    best = path_matches(inputs, refs).select(F.col("k"), F.col("input_path"), "n_refs", "ref_id", "score")
    rows = inputs.withColumn("k", F.lower("name")).join(best.withColumnRenamed("input_path", "full_path"), ["k", "full_path"], "left")
    sure = F.when(F.col("n_refs") == 1, 1.0).when(F.col("score") > settings.path_similarity, 0.9)
    return rows.withColumn("confidence", sure).withColumn("match_id", F.when(F.col("confidence").isNotNull(), F.col("ref_id"))).withColumn("match_method", F.when(F.col("confidence").isNotNull(), "exact")).drop("k", "n_refs", "ref_id", "score")


def words_of(names: Column) -> Column:
    """Distinct words between white space of all names of a path."""
    return F.array_distinct(F.filter(F.split(F.lower(F.array_join(names, " ")), r"\s+"), lambda w: w != ""))


def target_branches(inputs: DataFrame, refs: DataFrame) -> DataFrame:
    """key, root_id: roots of reference leaves that share a word of the path with the input.

    Both sides meet as distinct (path words, root), not leaf by leaf."""
    a = inputs.select("key", F.explode(words_of(F.col("names"))).alias("w"))
    b = refs.select(F.explode(words_of(F.col("names"))).alias("w"), text.root_of(F.col("path_ids")).alias("root_id")).distinct()
    return a.join(b, "w").select("key", "root_id").distinct()


def best_branch(inputs: DataFrame, refs: DataFrame, targets: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """key, root_id: of several targets the one whose first leaves' paths are most alike on average,
    the smallest id on ties and if none is alike. compat: a branch's leaves are all whose path
    begins with the root's id, as text."""
    leaves = refs.select("ord", "full_path", "path", text.root_of(F.col("path_ids")).alias("root"))
    if settings.compat:
        roots = targets.select("root_id").distinct()
        leaves = leaves.crossJoin(F.broadcast(roots)).where(F.col("path").startswith(F.col("root_id")))  # roots are the tree's top level
    else:
        leaves = leaves.withColumnRenamed("root", "root_id")
    w = Window.partitionBy("root_id").orderBy("ord")
    sample = leaves.withColumn("n", F.row_number().over(w)).where(F.col("n") <= settings.branch_sample).select("root_id", text.path_words(F.col("full_path")).alias("theirs"))
    # the few samples of a root lie in one row, so that no pair is sent
    samples = sample.groupBy("root_id").agg(F.collect_list("theirs").alias("samples"))
    rows = targets.join(inputs.select("key", text.path_words(F.col("full_path")).alias("mine")), "key").join(samples, "root_id", "left")
    total = F.aggregate("samples", F.lit(0.0), lambda n, x: n + similarity.set_jaccard(F.col("mine"), x))
    mean = F.coalesce(total / F.size("samples"), F.lit(0.0))
    best = F.struct((-F.round(mean, 12)).alias("s"), "root_id")
    return rows.groupBy("key").agg(F.min(best).alias("b")).select("key", "b.root_id")


def branch_groups(inputs: DataFrame, refs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """key, ord, root_id for all inputs: those without a target are dealt in turn to the groups, in
    order of the groups' first members; without any group all are ``general``."""
    # read four times below, so written once
    clear = keep(best_branch(inputs, refs, target_branches(inputs, refs), settings).join(inputs.select("key", "ord"), "key"), "clear")
    groups = clear.groupBy("root_id").agg(F.min("ord").alias("first"))
    # one row for each root of the reference
    turn = groups.withColumn("turn", F.row_number().over(Window.orderBy("first")) - 1).crossJoin(groups.agg(F.count("*").alias("groups")))
    rest = inputs.select("key", "ord").join(clear.select("key"), "key", "left_anti")
    size = groups.agg(F.count("*").alias("groups"))
    dealt = round_robin(rest, "ord").crossJoin(size).withColumn("turn", F.when(F.col("groups") > 0, F.pmod("place", F.greatest("groups", F.lit(1)))))
    dealt = dealt.join(turn.select("turn", "root_id"), "turn", "left").select("key", "ord", F.coalesce("root_id", F.lit("general")).alias("root_id"))
    return clear.select("key", "ord", "root_id").unionByName(dealt)


def round_robin(rows: DataFrame, order: str) -> DataFrame:
    """place: 0, 1, ... in ``order`` over all rows."""
    return numbered(rows, order, "place")


def numbered(rows: DataFrame, order: str | list[str], name: str, start: int = 0) -> DataFrame:
    """Rows numbered in order without one task for all: range partitions are numbered inside and
    shifted by the sizes of those before. The partitions are held, as both steps have to see the same."""
    order = [order] if isinstance(order, str) else order
    spread = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).persist()
    inside = spread.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = spread.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("__n")
    return inside.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__in") - 1 + start).drop("__part", "__in", "__before")


def batches(rows: DataFrame, order: str, size: int = DEFAULT.batch_size, by: str | None = None) -> DataFrame:
    """batch_id: every ``size`` rows in order, in each group of ``by`` if it is given."""
    if by is None:
        return numbered(rows, order, "__place").withColumn("batch_id", F.floor(F.col("__place") / size)).drop("__place")
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("batch_id", F.floor((F.row_number().over(w) - 1) / size))
