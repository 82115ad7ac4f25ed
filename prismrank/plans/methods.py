"""Retrieval methods as plans, cross-validation, ablation and sweeps (A11, A12,
A14, A16, R15, R17, G18, G21, G23).

A method turns samples (sample_id, label, bands) and a role into features; all
methods share one evaluation.  The conditioning vector of the spectral methods
is an explicit column, named in the result: with ``own_label`` a sample's own
class shapes its features, on both sides, so such scores are not those of a
label-free search.
"""

from __future__ import annotations

import time
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismrank.functions import vectors as V
from prismrank.operators import attribution, graph, kernel, pca, ranking, report, scoring
from prismrank.session import kept

STAGES = ("selected", "mean", "affinity", "fiedler", "full")
#: Methods beside the stages: the mean of the bands of the spectral indices (near
#: infrared, red, green, short-wave infrared, those that are there), three
#: principal components of all bands, propagation over the gallery, and votes.
METHODS = (*STAGES, "index", "pca", "propagation", "vote")
RGB_BANDS = (3, 2, 1)
INDEX_BANDS = (7, 3, 2, 11)
ALPHAS = (0.3, 0.5, 0.7)


def check_methods(methods: list[str]) -> None:
    """F6."""
    if unknown := [m for m in methods if m not in METHODS]:
        raise ValueError(f"unknown methods {', '.join(unknown)}; there are {', '.join(METHODS)}")


def check_folds(wanted: list[int] | None, k: int) -> list[int]:
    """F4."""
    folds = [f for f in range(k) if wanted is None or f in wanted]
    if not folds:
        raise ValueError("no such fold")
    return folds


def class_queries(train: DataFrame, label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """label, query: the centroid over the bands of a class's training rows, for
    each value of ``by``."""
    keys = [*by, label]
    each = train.select(*keys, F.explode("bands").alias("x")).select(*keys, F.posexplode("x").alias("d", "x"))
    dims = each.groupBy(*keys, "d").agg(F.avg("x").alias("x"))
    return dims.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("query"))


def first_label(labels: Column) -> Column:
    """The one label that conditions a sample with several."""
    return F.get(labels, F.lit(0))


def strongest_label(multi_hot: Column) -> Column:
    """The first place of the largest value of a multi-hot vector."""
    return (F.array_position(multi_hot, F.array_max(multi_hot)) - 1).cast("int")


def condition(samples: DataFrame, train: DataFrame, mode: str = "own_label", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``query`` and ``conditioning``.  ``own_label``: the
    centroid of the sample's class; ``mean_band``: its own mean band, which
    needs no label."""
    if mode == "own_label":
        return samples.join(class_queries(train, by=by), [*by, "label"]).withColumn("conditioning", F.lit(mode))
    if mode == "mean_band":
        return samples.withColumn("query", graph.mean_fusion("bands")).withColumn("conditioning", F.lit(mode))
    raise ValueError(f"unknown conditioning {mode!r}")


def fused(samples: DataFrame, stage: str, config: kernel.Config = kernel.Config(k=3), chosen: tuple[int, ...] = RGB_BANDS) -> DataFrame:
    """sample_id, vec by an ablation stage."""
    if stage in ("selected", "index"):
        places = chosen if stage == "selected" else INDEX_BANDS
        some = F.filter(F.array(*[F.get("bands", F.lit(b)) for b in places]), lambda x: x.isNotNull())
        return samples.select("sample_id", graph.mean_fusion(some).alias("vec"))
    if stage == "mean":
        return samples.select("sample_id", graph.mean_fusion("bands").alias("vec"))
    if stage == "affinity":
        return samples.select("sample_id", graph.affinity_fusion("bands", "query", config.sigma).alias("vec"))
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}")
    c = replace(config, num_steps=0) if stage == "fiedler" else config
    return kernel.run(samples, c).select("sample_id", F.col("fused").alias("vec"))


def named(features: DataFrame, roles: DataFrame, side: str, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Features of one role as the ``side`` query or gallery of an evaluation;
    keys beside sample_id stay."""
    labels = roles.filter(F.col("role") == side).select(*keys, "label")
    more = [k for k in keys if k != "sample_id"]
    return features.join(labels, list(keys)).select(*more, F.col("sample_id").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"), F.col("vec").alias(f"{side}_vec"))


def role_sizes(samples: DataFrame, roles: DataFrame, by: tuple[str, ...] = ()) -> tuple[int, int, int]:
    """Sizes for ``ranking.evaluate_blocks`` from the roles, not from features
    that are costly to make: gallery rows, queries, width of a band."""
    counts = roles.groupBy(*by, "role").count().groupBy("role").agg(F.max("count").alias("n")).collect()
    n = {r.role: r.n for r in counts}
    one = samples.select(F.size(F.get("bands", F.lit(0))).alias("w")).first()
    return n.get("gallery", 0), n.get("query", 0), max(1, one.w) if one else 1


def features_of(rows: DataFrame, method: str, train: DataFrame, gallery: DataFrame, config: kernel.Config, mode: str) -> DataFrame:
    """sample_id, vec of the samples in ``rows`` by a method that is fitted on
    ``train`` (class centroids, votes) or on ``gallery`` (components)."""
    if method == "vote":
        fitted = train.select(graph.mean_fusion("bands").alias("vec"), F.col("label").alias("class_id"))
        texts = class_queries(train).select(F.col("label").alias("class_id"), F.col("query").alias("vec"))
        asked = rows.select(F.col("sample_id").alias("image_id"), graph.mean_fusion("bands").alias("vec"))
        return scoring.logit_features(scoring.vote_logits(asked, fitted, texts)).select(F.col("image_id").alias("sample_id"), "vec")
    if method == "pca":
        flat = lambda df: df.select("sample_id", F.flatten("bands").alias("vec"))
        return pca.project(flat(rows), pca.fit(flat(gallery), 3)).withColumn("vec", V.l2_normalize("vec"))
    wanted = condition(rows, train, mode) if method in ("affinity", "fiedler", "full") else rows
    return fused(wanted, "selected" if method == "propagation" else method, config)


def method_sides(samples: DataFrame, roles: DataFrame, method: str, config: kernel.Config, mode: str) -> list[DataFrame]:
    """Queries and gallery of one method over one fold.  Each side's features are
    made from the samples of its role alone, and once."""
    check_methods([method])
    labelled = samples.join(roles.select("sample_id", "role"), "sample_id")
    of = {r: labelled.filter(F.col("role") == r).drop("role") for r in ("train", "query", "gallery")}
    return [named(features_of(of[r], method, of["train"], of["gallery"], config, mode), roles, r) for r in ("query", "gallery")]


def evaluate_method(samples: DataFrame, roles: DataFrame, method: str, config: kernel.Config = kernel.Config(k=3), mode: str = "own_label", ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per-query rows of one method over one fold."""
    q, g = method_sides(samples, roles, method, config, mode)
    if method == "propagation":
        return propagation(q, g, ks=ks).withColumn("method", F.lit(method))
    return ranking.evaluate_blocks(q, g, ks, sizes=role_sizes(samples, roles)).withColumn("method", F.lit(method))


def evaluate_features(features: DataFrame, roles: DataFrame, method: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per-query rows of features (sample_id, vec) however they were made, for
    example by an encoder from images of three bands, of indices or of principal
    components.  They are written once, as an encoder is costly."""
    features = kept(features.select("sample_id", "vec"), "features")
    return ranking.evaluate_blocks(named(features, roles, "query"), named(features, roles, "gallery"), ks).withColumn("method", F.lit(method))


def propagation(queries: DataFrame, gallery: DataFrame, alphas: tuple[float, ...] = ALPHAS, neighbours: int = 20, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per-query rows with the alpha that is best on these queries, as
    the baseline chooses it.  The graph is built once and all alphas are scored
    in one pass; their qualities are a few rows."""
    rows = kept(scoring.alpha_rows(queries, gallery, scoring.gallery_graph(gallery, neighbours), alphas, tuple(sorted({*ks, 1, 5}))), "alphas")
    best = scoring.alpha_quality(rows, alphas, (1, 5)).filter("best").first()
    unwanted = [f"{x}_at_{k}" for k in (1, 5) if k not in ks for x in ("hit", "found")]
    return rows.filter(F.col("mix") == (best.alpha_pos if best else 0)).drop("mix", *unwanted)


def evaluate_folds(samples: DataFrame, roles: DataFrame, method: str, config: kernel.Config = kernel.Config(k=3), ks: tuple[int, ...] = (1, 5, 10), folds: list[int] | None = None) -> DataFrame:
    """A stage or the index mean over all folds of ``roles`` (sample_id, label,
    fold_id, role) as one plan; ``folds``: all values of fold_id, if known."""
    by = ("fold_id",)
    labelled = samples.join(roles.select("sample_id", "fold_id", "role"), "sample_id")

    def side(role: str) -> DataFrame:
        rows = labelled.filter(F.col("role") == role).drop("role")
        if method in ("affinity", "fiedler", "full"):
            rows = condition(rows, labelled.filter("role = 'train'"), by=by)
        # a sample has one vector per fold
        made = fused(rows.withColumn("sample_id", F.struct("sample_id", "fold_id")), method, config)
        return named(made.select("sample_id.sample_id", "sample_id.fold_id", "vec"), roles, role, ("sample_id", "fold_id"))

    rows = ranking.evaluate_blocks(side("query"), side("gallery"), ks, by=by, sizes=role_sizes(samples, roles, by), groups=tuple(folds or ()))
    return rows.withColumn("method", F.lit(method))


def cross_validate(samples: DataFrame, folds: DataFrame, k: int, methods: list[str], config: kernel.Config = kernel.Config(k=3), wanted: list[int] | None = None) -> DataFrame:
    """Per-query rows of all methods and folds; ``folds``: sample_id, label,
    bucket (L2).  Stages run over all folds at once, the methods that fit a graph,
    components or votes fold by fold."""
    check_methods(methods)
    chosen = check_folds(wanted, k)
    fold = F.col("fold_id")
    role = F.when(F.col("bucket") == fold, "query").when(F.col("bucket") == (fold + 1) % k, "gallery").otherwise("train")
    roles = folds.select("sample_id", "label", "bucket", F.explode(F.array(*[F.lit(f) for f in chosen])).alias("fold_id")).select("sample_id", "label", "fold_id", role.alias("role"))
    out = None
    for m in methods:
        if m in (*STAGES, "index"):
            found = [evaluate_folds(samples, roles, m, config, folds=chosen)]
        else:
            found = [evaluate_method(samples, roles.filter(fold == f).drop("fold_id"), m, config).withColumn("fold_id", F.lit(f)) for f in chosen]
        for rows in found:
            out = rows if out is None else out.unionByName(rows)
    return out


def fold_metrics(query_rows: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    return ranking.summary(query_rows, ks, ["method", "fold_id"])


def ablation(samples: DataFrame, roles: DataFrame, config: kernel.Config = kernel.Config(k=3)) -> DataFrame:
    """The five stages with their differences.  The stage is a key of one
    evaluation, whose blocks the stages share."""
    by, orders = "stage_order", tuple(range(1, len(STAGES) + 1))
    sides = [[side.withColumn(by, F.lit(n)) for side in method_sides(samples, roles, stage, config, "own_label")] for n, stage in zip(orders, STAGES)]
    queries, gallery = (reduce(DataFrame.unionByName, some) for some in zip(*sides))
    rows = ranking.evaluate_blocks(queries, gallery, by=(by,), sizes=role_sizes(samples, roles), groups=orders)
    found = ranking.summary(rows, by=[by])
    stages = samples.sparkSession.range(1, len(STAGES) + 1).select(F.col("id").cast("int").alias(by), F.get(F.array(*map(F.lit, STAGES)), (F.col("id") - 1).cast("int")).alias("component"))
    # a stage without queries has a row as well
    out = stages.join(found, by, "left").withColumn("num_queries", F.coalesce("num_queries", F.lit(0)).cast("long"))
    return report.deltas(out.select(*[c for c in found.columns if c != by], by, "component"), ["r_at_1", "r_at_10"])


def sweep(samples: DataFrame, roles: DataFrame, grid: dict[str, list], base: kernel.Config = kernel.Config(k=3), ap: bool = True) -> DataFrame:
    """One parameter at a time; cells param_name, pos, param_value and
    metrics (``ap``: with mAP, for which all rows are ranked)."""
    labelled = samples.join(roles.select("sample_id", "role"), "sample_id")
    train = labelled.filter("role = 'train'")
    cells = [(p, i, v) for p, values in grid.items() for i, v in enumerate(values)]
    configs = [replace(base, **{p: v}) for p, _, v in cells]
    keys = ("sample_id", "config")
    numbered = roles.withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(len(cells) - 1))))

    def side(role: str) -> DataFrame:
        made = kernel.run(condition(labelled.filter(F.col("role") == role).drop("role"), train), configs)
        return named(made.select("sample_id", "config", F.col("fused").alias("vec")), numbered, role, keys)

    # the cell is a key of one evaluation: each sample is fused once a cell
    sizes = role_sizes(samples, roles)
    if ap:
        rows = ranking.evaluate_blocks(side("query"), side("gallery"), by=("config",), sizes=sizes)
    else:
        rows = ranking.hits_blocks(side("query"), side("gallery"), by=("config",), rows=sizes[1])
    of = lambda k, kind: F.get(F.array(*[F.lit(c[k]).cast(kind) for c in cells]), F.col("config"))
    out = ranking.summary(rows, by=["config"])
    return out.withColumns({"param_name": of(0, "string"), "pos": of(1, "int"), "param_value": of(2, "double")}).drop("config")


def leave_one_band_out(samples: DataFrame, roles: DataFrame, bands: int, method: str = "mean", config: kernel.Config = kernel.Config(k=3)) -> DataFrame:
    """The method run again without each band: dropped, r_at_1, r_at_10,
    what the band adds to either (all bands minus without it), and its rank by
    R@10 (1: the band that matters most)."""
    kept = attribution.without_band(samples)
    asked = role_sizes(samples, roles)[1]
    out = None
    for b in (None, *range(bands)):
        some = samples if b is None else kept.filter(F.col("dropped") == b).drop("dropped")
        if method == "propagation":  # its alpha is chosen by AP as well
            found = evaluate_method(some, roles, method, config)
        else:
            found = ranking.hits_blocks(*method_sides(some, roles, method, config, "own_label"), (1, 10), rows=asked)
        rows = ranking.summary(found, (1, 10)).select(F.lit(b).cast("int").alias("dropped"), "r_at_1", "r_at_10")
        out = rows if out is None else out.unionByName(rows)
    whole = Window.orderBy(F.col("dropped").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row per band
    out = out.withColumns({f"delta_{m}": F.first(m).over(whole) - F.col(m) for m in ("r_at_1", "r_at_10")}).filter("dropped IS NOT NULL")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.round("delta_r_at_10", 9).desc(), "dropped")))


def fusion_times(samples: DataFrame, stages: tuple[str, ...] = STAGES, runs: int = 3, config: kernel.Config = kernel.Config(k=3)) -> DataFrame:
    """Component, run, value: milliseconds a sample for which a stage's
    fusion ran as a whole (with ``query`` in ``samples``); input of
    ``report.timing``."""
    n, rows = max(samples.count(), 1), []
    for stage in stages:
        for r in range(runs):
            began = time.perf_counter()
            fused(samples, stage, config).write.format("noop").mode("overwrite").save()
            rows.append((stage, r, (time.perf_counter() - began) * 1000 / n))
    return samples.sparkSession.createDataFrame(rows, "component string, run int, value double")


def text_to_image(texts: DataFrame, gallery: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One query per class (class_id, vec) against labelled images."""
    q = texts.select(F.col("class_id").cast("long").alias("query_id"), F.col("class_id").alias("query_label"), V.l2_normalize("vec").alias("query_vec"))
    return ranking.evaluate(q, gallery, ks)
