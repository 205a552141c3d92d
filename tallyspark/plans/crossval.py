"""Whole-run scoring under nested cross-validation, as one plan.

The outer folds hold out test runs; within the training runs of each, inner folds choose the multiplier of the
threshold. A fit is (outer, inner), inner -1 for the whole training set; a profile is (outer, inner, part), where part
says which of the fit's normal runs are left out to be scored (-1: none, for the fit's test runs). All fits, parts and
multipliers are keys of the same joins and aggregations. Cells are summed up by fit and own part before parts and grains
multiply them, and a run's cells of a feature meet a profile as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import evaluate, faults, runscore

FOLDS, MOST_FALSE_ALARMS = 5, 0.1
MULTIPLIERS = tuple(k / 4 for k in range(17))
FIT, PART = ("outer", "inner"), ("outer", "inner", "part")


def fits(runs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(outer, inner, role, place, the runs' columns): role train or test of each fit; place orders a fit's training runs.

    runs: run, position (0, 1, ... in the shuffled order), family, setting, task, batch, faulty."""
    numbers = F.array(*[F.lit(k).cast("long") for k in range(folds)])
    rows = runs.withColumn("outer", F.explode(numbers)).withColumn("held", F.col("position") % folds == F.col("outer"))
    # the place among the outer fold's training runs: the position less the held-out ones before it
    rows = rows.withColumn("at", F.col("position") - F.floor((F.col("position") + folds - 1 - F.col("outer")) / folds)).withColumn("own", F.col("at") % folds)
    inner = rows.where("not held").withColumn("inner", F.explode(numbers)).withColumn("role", F.when(F.col("own") == F.col("inner"), "test").otherwise("train")).withColumn("place", F.struct("own", "at"))
    last = rows.withColumn("inner", F.lit(-1).cast("long")).withColumn("role", F.when(F.col("held"), "test").otherwise("train")).withColumn("place", F.struct(F.lit(0).cast("long").alias("own"), "at"))
    return inner.unionByName(last).drop("held", "at", "own")


def profiles(normals: DataFrame, cells: DataFrame, least: int = 2) -> DataFrame:
    """(part's keys, grain, feature, spread, means by step) of normals (fit, own, others, run, task, batch), where others
    are the parts that a run counts for; as runscore.grain_profiles() of all of these parts' members."""
    own, by = [*FIT, "own", "others", "task", "batch"], [*PART, *runscore.GRAIN]
    spread_out = lambda df: runscore._grains(df.withColumn("part", F.explode("others"))).drop("own", "others")
    enough = spread_out(normals.join(cells.select("run").distinct(), "run").groupBy(*own).agg(F.count("*").alias("runs"))).groupBy(*by).agg(F.sum("runs").alias("runs")).where(F.col("runs") >= least).drop("runs")
    moments = normals.join(cells, "run").groupBy(*own, "feature", "step").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    each = W.partitionBy(*by, "feature", "step")
    parts = spread_out(moments).join(enough, by, "left_semi").withColumn("mean", F.sum(F.col("n") * F.col("m")).over(each) / F.nullif(F.sum("n").over(each), F.lit(0)))
    squares = F.sum(F.col("n") * (F.col("v") + (F.col("m") - F.col("mean")) ** 2))
    means = parts.groupBy(*by, "feature", "step").agg(F.max("mean").alias("mean"), F.when(F.sum("n") > 1, squares / (F.sum("n") - 1)).alias("var"))
    return means.groupBy(*by, "feature").agg(runscore.level().alias("spread"), F.map_from_entries(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("step", "mean")))).alias("means"))


def scores(runs: DataFrame, cells: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(outer, inner, part, run, score): each fit's normal runs scored out of sample (part 0, 1, ...), and its test runs (part -1)."""
    all_ = fits(runs, folds)
    normals = all_.where("role = 'train' and not faulty").withColumn("n", F.row_number().over(W.partitionBy(*FIT).orderBy("place")) - 1).withColumn("many", F.count("*").over(W.partitionBy(*FIT)))
    normals = normals.withColumn("parts", F.when(F.col("many") >= 2 * folds, folds).otherwise(F.col("many")).cast("long")).withColumn("own", F.col("n") % F.col("parts"))
    others = F.concat(F.array(F.lit(-1).cast("long")), F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: k != F.col("own")))
    normals = normals.withColumn("others", others)
    members = normals.withColumn("part", F.explode("others")).select(*PART, "run", "task", "batch")
    asked = normals.select(*FIT, F.col("own").alias("part"), "run", "task", "batch").unionByName(all_.where("role = 'test'").select(*FIT, F.lit(-1).cast("long").alias("part"), "run", "task", "batch"))
    chosen, by = runscore.chosen_grain(asked, members, *PART), [*PART, *runscore.GRAIN]
    rows = cells.groupBy("run", "feature").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("cells"))
    known = F.filter("cells", lambda c: F.map_contains_key("means", c["step"]))
    z = F.transform(known, lambda c: (c["value"] - F.element_at("means", c["step"])) / F.col("spread"))
    total = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x))
    found = chosen.join(rows, "run").join(profiles(normals.select(*FIT, "own", "others", "run", "task", "batch"), cells), [*by, "feature"]).select(*PART, "run", z.alias("z")).where(F.size("z") > 0)
    factors = found.select(*PART, "run", runscore.factor(F.size("z"), total(F.filter("z", lambda x: x.isNotNull()))).alias("factor"))
    listed, top = F.col("factors"), F.array_max("factors")
    mean = total(F.transform(listed, lambda f: F.exp(f - top))) / F.size(listed)
    return factors.groupBy(*PART, "run").agg(F.array_sort(F.collect_list("factor")).alias("factors")).select(*PART, "run", (top + F.ln(mean)).alias("score"))


def nested(runs: DataFrame, cells: DataFrame, *, folds: int = FOLDS, multipliers: tuple[float, ...] = MULTIPLIERS, groups: list[tuple[str, str]] | None = None) -> DataFrame:
    """Each run (run, family, setting, faulty) with its outer fold, the multiplier chosen without it, its score and whether it is flagged."""
    found = scores(runs, cells, folds)
    limits = found.where("part >= 0").groupBy(*FIT).agg(F.avg("score").alias("centre"), F.stddev_samp("score").alias("sd"))
    tested = found.where("part = -1").join(limits, list(FIT)).join(runs.select("run", "family", "setting", "faulty"), "run")
    flagged = F.col("score") > F.col("centre") + F.col("k") * F.col("sd")
    tried = tested.where("inner >= 0").withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in multipliers]))).withColumn("flagged", F.coalesce(flagged, F.lit(False)))
    alarms = tried.groupBy("outer", "k").agg((F.count_if(F.col("flagged") & ~F.col("faulty")) / F.nullif(F.count_if(~F.col("faulty")), F.lit(0))).alias("false_alarms"))
    f1 = evaluate.confusion(tried, "outer", "k", groups=groups).where("tp + fn > 0").groupBy("outer", "k").agg(F.avg("f1").alias("f1"))
    results = alarms.join(f1, ["outer", "k"], "left").select("outer", "k", "false_alarms", F.coalesce("f1", F.lit(0.0)).alias("f1"))
    # ties of F1 are ties of fractions: rounded, so that the order of additions doesn't decide
    best = faults.best_multiplier(results.withColumn("f1", F.round("f1", 9)), "outer", most_false_alarms=MOST_FALSE_ALARMS)
    return tested.where("inner = -1").join(best, "outer").select("run", "family", "setting", "faulty", "outer", "k", "score", F.coalesce(flagged, F.lit(False)).alias("flagged"))
