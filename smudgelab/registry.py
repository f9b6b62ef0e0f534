"""Registered queries: every operator over the given tables.

Where stored experiments and metrics are needed, orders stand for experiments
and line items for their metrics, so the work grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smudgelab import spec as S
from smudgelab.functions import sizes, text
from smudgelab.functions import vectors as V
from smudgelab.functions.hashing import digest, row_key, text_digest
from smudgelab.operators import (
    clusters,
    columns,
    corruption,
    distances,
    documents,
    encoders,
    neighbours,
    planar,
    probe,
    profiles,
    sampling,
    scores,
    subsets,
    suite_encoder,
    synthesis,
)
from smudgelab.operators.lookup import lookup_join
from smudgelab.operators.ranking import digest_rank
from smudgelab.plans import evaluate as evaluation
from smudgelab.plans import classification, grid, models, report, search, suite, views
from smudgelab.session import work_folder
from smudgelab.sources import checks, tables

SEED = 42
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---------------------------------------------------------------- labelled tables

CUSTOMER = S.DatasetSpec("customer", "c_custkey", "c_nationkey", ("c_acctbal",), ("c_mktsegment",))
CUSTOMER_SEGMENT = S.DatasetSpec("customer", "c_custkey", "c_mktsegment", ("c_acctbal",), ("c_nationkey",))
ORDERS = S.DatasetSpec("orders", "o_orderkey", "o_orderstatus", ("o_totalprice",), ("o_custkey", "o_orderpriority"))
LINEITEM = S.DatasetSpec(
    "lineitem", "row_id", "l_returnflag",
    ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ("l_linestatus", "l_linenumber"),
)
PART = S.DatasetSpec("part", "p_partkey", "p_brand", ("p_size", "p_retailprice"), ("p_type", "p_name"))


def keyed_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with a key over the columns that tell them apart."""
    df = table(spark, folder, "lineitem").withColumn("cents", F.rint(F.col("l_extendedprice") * 100).cast("bigint"))
    return df.withColumn("row_id", row_key("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cents"))


def pick(index: Column, *values: object) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


ALL_PANELS = (*report.PROBE_PANELS, *report.DISTANCE_PANELS, *report.IDEAL_PANELS)


def experiments(spark: SparkSession, folder: str) -> DataFrame:
    """One experiment per order."""
    key = F.col("o_orderkey")
    clean = F.col("o_orderstatus") == "P"
    return table(spark, folder, "orders").select(
        key.cast("string").alias("experiment_id"),
        text.dataset_name(F.col("o_custkey")).alias("dataset_name"),
        F.floor(F.col("o_totalprice") / 50).cast("int").alias("train_size"),
        F.floor(F.col("o_totalprice") / 100_000).cast("int").alias("test_size"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("number_of_classes"),
        F.lit(8).alias("number_of_features"),
        pick(key % 3, 100, 200, 300).alias("random_seed"),
        F.when(clean, S.NONE).otherwise(pick(F.floor(key / 3) % 3, S.MCAR, S.SCAR, S.CSCAR)).alias("error_type"),
        F.when(clean, S.CLEAN_CLEAN)
        .when(F.col("o_orderstatus") == "F", S.CLEAN_DIRTY)
        .otherwise(S.DIRTY_DIRTY)
        .alias("tag"),
        F.when(clean, 0).otherwise(pick(F.floor(key / 9) % 3, 10, 20, 40)).cast("smallint").alias("row_corruption_percent"),
        F.when(clean, 0).otherwise(20).cast("smallint").alias("column_corruption_percent"),
    )


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """One metric row per line item; the highest tax stands for a NaN value."""
    panel = F.col("l_partkey") % len(ALL_PANELS)
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("experiment_id"),
        pick(panel, *[p[0] for p in ALL_PANELS]).alias("evaluation_type"),
        pick(panel, *[p[1] for p in ALL_PANELS]).alias("metric_name"),
        F.when(F.col("l_tax") > 0.075, F.lit(float("nan"))).otherwise(F.col("l_quantity") / 50).alias("metric_value"),
        pick(F.col("l_suppkey") % 3, 10, 20, 40).cast("smallint").alias("row_corruption_percent"),
    )


def vector_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Given vectors as clean reference, and a damaged copy: 30 % of the rows have
    every fifth component multiplied by ten."""
    df = table(spark, folder, "embeddings").withColumn("reference", V.as_doubles(F.col("embedding")))
    h = sampling.row_digest(SEED, "test", "vec_id")
    cuts = sampling.DigestCuts(df, h)
    hit = h <= cuts.cut(sizes.sample_size(30, cuts.total))
    damaged = F.transform("reference", lambda x, i: F.when(i % 5 == 0, x * 10).otherwise(x))
    return df.select(
        "vec_id", "label", "reference", F.when(hit, damaged).otherwise(F.col("reference")).alias("embedding"),
        hit.alias("is_corrupted"),
    )


# ---------------------------------------------------------------- sampling and corruption


@query
def mcar_customer(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "customer")
    done = corruption.corrupt(df, CUSTOMER, S.CorruptionSpec(S.MCAR, SEED, 20, 50))
    return done.flagged.select("c_custkey", "c_acctbal", "c_mktsegment", "is_corrupted")


@query
def scar_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and changed cells per column after scaling, one pass over the table."""
    done = corruption.corrupt(keyed_lineitem(spark, folder), LINEITEM, S.CorruptionSpec(S.SCAR, SEED, 10, 50))
    facts = []
    for c in LINEITEM.numeric:
        differs = ~F.col(c).eqNullSafe(F.col(corruption.CLEAN_PREFIX + c)) if c in done.columns else F.lit(False)
        total = F.sum(F.rint(F.col(c) * 100).cast("bigint"))
        facts.append(F.struct(F.lit(c).alias("column"), total.alias("total_cents"), F.count_if(differs).alias("changed")))
    return done.flagged.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


@query
def cscar_customer(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "customer")
    done = corruption.corrupt(df, CUSTOMER, S.CorruptionSpec(S.CSCAR, SEED, 20, 100))
    return done.flagged.select(
        "c_custkey", F.col("clean_c_mktsegment").alias("old"), F.col("c_mktsegment").alias("new"), "is_corrupted"
    )


@query
def cscar_orders_wide(spark: SparkSession, folder: str) -> DataFrame:
    """A category with as many values as there are customers."""
    df = table(spark, folder, "orders")
    done = corruption.corrupt(df, ORDERS.keep(["o_custkey"]), S.CorruptionSpec(S.CSCAR, SEED, 40, 100))
    return done.flagged.select(
        "o_orderkey", F.col("clean_o_custkey").alias("old"), F.col("o_custkey").alias("new"), "is_corrupted"
    )


AUDIT_MODES = (S.CLEAN_CLEAN, S.CLEAN_DIRTY, S.DIRTY_CLEAN, S.DIRTY_DIRTY)


@query
def corruption_audit(spark: SparkSession, folder: str) -> DataFrame:
    dataset = ORDERS.keep(["o_totalprice", "o_orderpriority"])
    split = sampling.split_train_test(
        table(spark, folder, "orders").select("o_orderkey", *dataset.features, "o_orderstatus"), "o_orderkey", SEED
    )
    prepared = sampling.Prepared(split, dataset)
    parts = []
    for kind in (S.MCAR, S.CSCAR):
        for mode in AUDIT_MODES:
            result = corruption.corrupt_by_mode(prepared, mode, S.CorruptionSpec(kind, SEED, 20, 100))
            audited = corruption.audit_mode(result)
            if audited is not None:
                parts.append(audited.select(F.lit(mode).alias("tag"), F.lit(kind).alias("error_type"), "*"))
    return reduce(DataFrame.unionByName, parts).withColumn("rate", F.round("rate", 6))


@query
def audit_stored_tables(spark: SparkSession, folder: str) -> DataFrame:
    clean = table(spark, folder, "customer")
    dirty = corruption.corrupt(clean, CUSTOMER, S.CorruptionSpec(S.MCAR, SEED, 40, 100)).data
    audited = corruption.audit_tables(clean, dirty, "c_custkey", CUSTOMER.features)
    return audited.withColumn("rate", F.round("rate", 6))


@query
def corrupted_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged rows of both sides of a split table."""
    dataset = PART.keep(["p_size", "p_retailprice"])
    split = sampling.split_train_test(table(spark, folder, "part"), "p_partkey", SEED)
    spec = S.CorruptionSpec(S.SCAR, SEED, 10, 100)
    result = corruption.corrupt_by_mode(sampling.Prepared(split, dataset), S.DIRTY_DIRTY, spec)
    return result.corrupted_rows("p_partkey")


@query
def meaningful_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Per experiment the damaged rows and columns, and whether the run says anything.

    Line items with a return flag of R stand for damaged rows, their line numbers
    for damaged columns.
    """
    runs = experiments(spark, folder).select("experiment_id", "tag")
    hit = F.col("l_returnflag") == "R"
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("experiment_id")).agg(
        F.count_if(hit).alias("corrupted_rows"),
        F.countDistinct(F.when(hit, F.col("l_linenumber"))).alias("corrupted_columns"),
    )
    both = runs.join(lines, "experiment_id", "left").fillna(0, ["corrupted_rows", "corrupted_columns"])
    return both.where(corruption.meaningful()).select("experiment_id", "tag", "corrupted_rows", "corrupted_columns")


@query
def split_caps_part(spark: SparkSession, folder: str) -> DataFrame:
    done = sampling.prepare(table(spark, folder, "part"), PART, SEED, max_rows=300, max_features=3, max_classes=S.MAX_CLASSES)
    return done.data


@query
def split_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    done = sampling.prepare(keyed_lineitem(spark, folder), LINEITEM, SEED, max_rows=10_000)
    keys = F.col("row_id")
    return done.data.groupBy("split", "l_returnflag").agg(
        F.count("*").alias("rows"), F.min(keys).alias("first_key"), F.max(keys).alias("last_key")
    )


@query
def sample_orders(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.exact_sample(table(spark, folder, "orders"), "o_orderkey", SEED, 1_000, "pick").select(
        "o_orderkey", "o_custkey"
    )


@query
def keep_and_recode_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of two classes with their labels recoded."""
    kept = sampling.keep_classes(table(spark, folder, "orders"), "o_orderstatus", ["F", "O"])
    recoded = columns.recode(kept, "o_orderstatus", {"F": 0, "O": 1})
    return recoded.select("o_orderkey", F.col("o_orderstatus").cast("int").alias("label"))


@query
def kfold_counts(spark: SparkSession, folder: str) -> DataFrame:
    folded = sampling.assign_folds(table(spark, folder, "orders"), "o_orderkey", SEED, 10)
    return folded.groupBy("fold").agg(
        F.count("*").alias("rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


@query
def batch_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Batches per return flag under the adaptive limit."""
    df = keyed_lineitem(spark, folder)
    facts = df.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("classes")
    )
    limited = facts.select(
        "l_returnflag", sizes.inference_limit(F.col("n"), F.lit(11), F.col("classes")).alias("batch_limit")
    )
    sized = lookup_join(df.select("row_id", "l_returnflag"), limited, ["l_returnflag"], "inner")
    batched = sampling.assign_batches(sized, "row_id", SEED, F.col("batch_limit"), ["l_returnflag"])
    return batched.groupBy("l_returnflag", "batch").agg(
        F.count("*").alias("rows"), F.min("row_id").alias("first_key"), F.max("row_id").alias("last_key")
    )


@query
def inference_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Batch limit of every experiment from its sizes."""
    classes = F.col("number_of_classes") * 2
    return experiments(spark, folder).select(
        "experiment_id",
        sizes.inference_limit(F.col("train_size"), F.col("train_size") % 500, classes).alias("batch_limit"),
    )


@query
def test_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Place of each test row inside its class."""
    split = sampling.split_train_test(table(spark, folder, "orders"), "o_orderkey", SEED)
    return subsets.positions(split.where("split = 'test'"), "o_orderkey", SEED, ["o_orderstatus"]).select(
        "o_orderkey", "o_orderstatus", F.col("pos").cast("bigint").alias("pos")
    )


# ---------------------------------------------------------------- grid, profiles, integrity

GRID_SEEDS = (100, 200, 300)
SKIPPED = (5, 8)


def suite_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """One dataset per supplier; those with a positive balance have a listed task."""
    supplier = table(spark, folder, "supplier")
    listed = supplier.where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("dataset_id"), (F.col("s_suppkey") + 100_000).alias("task_id")
    )
    datasets = supplier.select(F.col("s_suppkey").alias("dataset_id"))
    kept = grid.skip_datasets(datasets, SKIPPED)
    return grid.with_task_id(kept, listed).withColumn("dataset_name", text.dataset_name(F.col("dataset_id")))


@query
def config_grid(spark: SparkSession, folder: str) -> DataFrame:
    return grid.grid(suite_datasets(spark, folder), GRID_SEEDS, grid.configurations())


@query
def grid_pending(spark: SparkSession, folder: str) -> DataFrame:
    open_settings = grid.pending(config_grid(spark, folder), experiments(spark, folder))
    return open_settings.select(
        text.dataset_id(F.col("dataset_name")).alias("dataset_id"),
        "random_seed", "tag", "error_type", "row_corruption_percent", "column_corruption_percent",
    )


@query
def suite_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Line items of each part type as one dataset of a suite."""
    part = table(spark, folder, "part").select("p_partkey", "p_type", "p_brand")
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_quantity").join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    profiled = profiles.dataset_profiles(lines, ["p_type"], "p_brand", 11)
    task = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "regression").otherwise("classification")
    reported = profiles.suite_report(profiled.withColumns({"suite": F.lit("part types"), "task": task}))
    return reported.select(*[F.round(c, 6).alias(c) if c.startswith("share") else F.col(c) for c in reported.columns])


@query
def run_profile(spark: SparkSession, folder: str) -> DataFrame:
    done = sampling.prepare(table(spark, folder, "part"), PART, SEED, max_rows=None)
    return profiles.run_profile(done.data, done.dataset)


@query
def class_lists(spark: SparkSession, folder: str) -> DataFrame:
    listed = profiles.class_list(table(spark, folder, "orders"), "o_orderpriority", ["o_orderstatus"])
    return listed.select("o_orderstatus", F.concat_ws(",", "classes").alias("classes"), F.size("classes").alias("n"))


@query
def schema_checks(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines, customer = (table(spark, folder, t) for t in ("orders", "lineitem", "customer"))
    rows = [
        ("duplicate key", "orders", checks.duplicate_keys(orders, ["o_orderkey"])),
        ("duplicate key", "lineitem", checks.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])),
        ("orphan", "lineitem", checks.orphans(lines, "l_orderkey", orders, "o_orderkey")),
        ("orphan", "orders", checks.orphans(orders, "o_custkey", customer, "c_custkey")),
    ]
    counted = [
        df.agg(F.count("*").alias("violations")).select(
            F.lit(check).alias("check_name"), F.lit(name).alias("table_name"), "violations"
        )
        for check, name, df in rows
    ]
    nulls = checks.null_counts(customer, customer.columns).select(
        F.concat(F.lit("null "), "column").alias("check_name"),
        F.lit("customer").alias("table_name"),
        F.col("nulls").alias("violations"),
    )
    return reduce(DataFrame.unionByName, [*counted, nulls])


@query
def unrepeatable_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Datasets whose listed parts are not all in the test side of ``part``."""
    split = sampling.split_train_test(table(spark, folder, "part"), "p_partkey", SEED, 0.95)
    tested = split.where("split = 'test'").select(F.col("p_partkey").alias("row_id"))
    manifest = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("experiment_id"), F.col("l_partkey").alias("row_id")
    )
    missing = subsets.missing_from_test(manifest, tested, ["row_id"])
    return checks.reject_unrepeatable(experiments(spark, folder), missing)


@query
def manifest_json(spark: SparkSession, folder: str) -> DataFrame:
    """Line numbers as JSON lists, flat or [train, test], read back as test rows."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    runs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    stored = documents.row_documents(
        lines.join(runs, "l_orderkey"), ["l_orderkey"], "l_linenumber",
        nested=F.col("o_orderstatus") == "O", is_train=F.col("l_returnflag") == "N",
    )
    decoded = stored.select("l_orderkey", text.test_side_rows(F.col("document")).alias("rows"))
    return decoded.select(F.col("l_orderkey").alias("experiment_id"), F.explode("rows").alias("row_id"))


@query
def consistency_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Experiments by reason of rejection; line items stand for embeddings."""
    vectors = table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("experiment_id"))
    checked = subsets.check_consistency(experiments(spark, folder), vectors)
    return checked.groupBy(F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count("*").alias("runs"))


@query
def evaluation_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """What an evaluation leaves out, and why; line items stand for embeddings and damaged rows."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("experiment_id"), F.col("l_linenumber").alias("row_id"), "l_tax"
    )
    lost = (F.col("row_id") == 7) & (F.col("l_tax") > 0.075)
    manifest = lines.select(
        "experiment_id", F.when(lost, 100).otherwise(F.col("row_id")).alias("row_id"), F.lit("test").alias("side")
    )
    return evaluation.rejects(experiments(spark, folder), lines, manifest)


@query
def not_evaluated(spark: SparkSession, folder: str) -> DataFrame:
    finite = metrics(spark, folder).where(~F.isnan("metric_value") & (F.col("evaluation_type") == "LP_ALL_TLGT"))
    return grid.not_evaluated(experiments(spark, folder), finite).select("experiment_id", "dataset_name", "tag")


@query
def clean_reference_links(spark: SparkSession, folder: str) -> DataFrame:
    matched, missing = subsets.clean_reference(experiments(spark, folder))
    return matched.unionByName(missing).select("experiment_id", "clean_experiment_id")


@query
def borrowed_rows(spark: SparkSession, folder: str) -> DataFrame:
    return subsets.borrowed_rows(experiments(spark, folder)).select(
        "experiment_id", F.col("row_corruption_percent").cast("int").alias("row_corruption_percent"),
        "source_experiment_id",
    )


@query
def experiment_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of 300 stored experiments."""
    ordered = experiments(spark, folder).select("experiment_id", "dataset_name", "tag")
    return tables.page(ordered, F.col("experiment_id").desc(), 300, 300)


@query
def first_run_of_dataset(spark: SparkSession, folder: str) -> DataFrame:
    runs = experiments(spark, folder).select("experiment_id", "dataset_name", "random_seed", "tag")
    return subsets.first_by(runs, ["dataset_name", "random_seed"], "tag", "experiment_id")


# ---------------------------------------------------------------- vectors


@query
def distances_from_reference(spark: SparkSession, folder: str) -> DataFrame:
    pairs = vector_pairs(spark, folder).withColumn("experiment_id", F.lit("vectors"))
    measured = distances.mean_distances(pairs, ["experiment_id"], ("ZED", "COS", "ED"))
    return measured.select("samples_type", "metric_name", F.round("metric_value", 6).alias("metric_value"))


@query
def distances_from_clean_run(spark: SparkSession, folder: str) -> DataFrame:
    """The same through stored runs: link, match on position, cut to the labels."""
    vectors = vector_pairs(spark, folder).withColumn("pos", F.col("vec_id"))
    runs = spark.createDataFrame(
        [("clean", "v", 1, S.CLEAN_CLEAN, S.NONE, 0, 0), ("dirty", "v", 1, S.CLEAN_DIRTY, S.MCAR, 30, 20)],
        "experiment_id string, dataset_name string, random_seed int, tag string, error_type string, "
        "row_corruption_percent smallint, column_corruption_percent smallint",
    )
    counted = vectors.groupBy("label").agg(F.count("*").alias("labels"))
    kept = subsets.keep_first(vectors, counted.withColumn("last", F.col("labels") * 9), ["label"], "last")
    clean = kept.select(F.lit("clean").alias("experiment_id"), "pos", F.col("reference").alias("embedding"))
    dirty = kept.select(F.lit("dirty").alias("experiment_id"), "pos", "embedding", "is_corrupted")
    links, _ = subsets.clean_reference(runs)
    measured = distances.mean_distances(subsets.pair_by_position(dirty, clean, links), ["experiment_id"])
    return measured.select(
        "experiment_id", "samples_type", "metric_name", F.round("metric_value", 6).alias("metric_value")
    )


@query
def clean_row_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Clean rows = all less damaged, with labels attached again by key."""
    pairs = vector_pairs(spark, folder)
    clean = subsets.clean_rows(pairs.select("vec_id"), pairs.where("is_corrupted"), ["vec_id"])
    return subsets.attach_labels(clean, table(spark, folder, "embeddings").select("vec_id", "label"), ["vec_id"])


@query
def vector_scalars(spark: SparkSession, folder: str) -> DataFrame:
    """Softmax of the components and the place of the largest."""
    soft = V.softmax(F.col("reference"))
    rows = vector_pairs(spark, folder).select("vec_id", soft.alias("soft"))
    return rows.select(
        "vec_id", F.round(F.array_max("soft"), 6).alias("top"), V.argmax(F.col("soft")).alias("place")
    )


@query
def matrix_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of a label as matrices of bounded size and back to rows."""
    rows = vector_pairs(spark, folder)
    ranked = digest_rank(rows.withColumn("d", digest(SEED, "place", "vec_id")), "d", ["label"])
    stored = documents.matrices(ranked, ["label"], "pos", "embedding", 100)
    back = documents.matrix_rows(stored, ["label"], 100)
    return back.select("label", "pos", F.round(V.total(F.col("embedding")), 6).alias("component_sum"))


@query
def knn_similarity(spark: SparkSession, folder: str) -> DataFrame:
    typed = subsets.with_samples_type(vector_pairs(spark, folder))
    near = neighbours.neighbour_similarity(typed, ["samples_type"], "vec_id", "embedding")
    return near.select("samples_type", "k", F.round("similarity", 6).alias("similarity"))


@query
def cluster_purity(spark: SparkSession, folder: str) -> DataFrame:
    typed = subsets.with_samples_type(vector_pairs(spark, folder)).withColumn("cluster", F.col("vec_id") % 4)
    pure = clusters.purity(typed, ["samples_type"], "cluster", "label")
    return pure.select("samples_type", F.round("purity", 6).alias("purity"))


@query
def cluster_silhouette(spark: SparkSession, folder: str) -> DataFrame:
    typed = subsets.with_samples_type(vector_pairs(spark, folder))
    shaped = clusters.silhouette(typed, ["samples_type"], "vec_id", "embedding", "label")
    return shaped.select("samples_type", F.round("silhouette", 6).alias("silhouette"))


@query
def cluster_silhouette_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Silhouettes of squared and cosine distances, linear in the rows."""
    typed = subsets.with_samples_type(vector_pairs(spark, folder))
    parts = [
        clusters.moment_silhouette(typed, ["samples_type"], "embedding", "label", m).withColumn("measure", F.lit(m))
        for m in (clusters.SQUARED, clusters.COSINE)
    ]
    shaped = parts[0].unionByName(parts[1])
    return shaped.select("samples_type", "measure", F.round("silhouette", 6).alias("silhouette"))


@query
def mirror_2d(spark: SparkSession, folder: str) -> DataFrame:
    flat = vector_pairs(spark, folder).select(
        "vec_id", "label", F.col("reference")[0].alias("x"), F.col("reference")[1].alias("y")
    )
    turned = planar.mirror(flat, ["label"], horizontally=True, vertically=True)
    return turned.select("vec_id", "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# ---------------------------------------------------------------- scores


def judged_documents(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    return labels.join(table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


@query
def auc_binary(spark: SparkSession, folder: str) -> DataFrame:
    auc = scores.roc_auc(judged_documents(spark, folder), ["lang"], "quality", "n_chars")
    return auc.select("lang", F.round("roc_auc", 6).alias("roc_auc"))


@query
def auc_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """A score with many ties over the largest table."""
    df = table(spark, folder, "lineitem").withColumn("hit", (F.col("l_returnflag") == "R").cast("int"))
    auc = scores.roc_auc(df, ["l_linestatus"], "hit", "l_extendedprice")
    return auc.select("l_linestatus", F.round("roc_auc", 6).alias("roc_auc"))


@query
def auc_one_vs_rest(spark: SparkSession, folder: str) -> DataFrame:
    typed = subsets.with_samples_type(vector_pairs(spark, folder)).withColumn(
        "p", V.softmax(F.col("embedding"))
    )
    auc = scores.roc_auc_one_vs_rest(typed, ["samples_type"], "label", "p", list(range(64)))
    return auc.select("samples_type", F.round("roc_auc", 6).alias("roc_auc"))


def rounded_scores(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in ("accuracy", "recall", "precision", "f1_score")])


@query
def class_scores_binary(spark: SparkSession, folder: str) -> DataFrame:
    df = judged_documents(spark, folder).withColumn("predicted", (F.col("n_chars") > 2_000).cast("int"))
    return rounded_scores(scores.class_scores(df, ["lang"], "quality", "predicted", F.lit(1)), "lang")


@query
def class_scores_micro(spark: SparkSession, folder: str) -> DataFrame:
    df = scores.with_prediction(vector_pairs(spark, folder), "embedding", list(range(64)))
    df = df.withColumn("predicted", F.col("prediction") % 10)
    return rounded_scores(scores.class_scores(df, ["is_corrupted"], "label", "predicted"), "is_corrupted")


@query
def reg_scores(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem").withColumn("predicted", F.col("l_quantity") * 1_500)
    scored = scores.regression_scores(df, ["l_returnflag"], "l_extendedprice", "predicted")
    return scored.select("l_returnflag", F.round("mse", 2).alias("mse"), F.round("r2", 6).alias("r2"))


# ---------------------------------------------------------------- encoding


def holed_customer(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "customer")
    return corruption.corrupt(df, CUSTOMER, S.CorruptionSpec(S.MCAR, SEED, 20, 100)).data


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query
def impute_encode(spark: SparkSession, folder: str) -> DataFrame:
    df = holed_customer(spark, folder)
    mended = columns.impute(df, CUSTOMER, columns.learn_columns(df, CUSTOMER))
    codes = columns.label_codes(mended, "c_nationkey", "nation_code")
    hot = columns.one_hot(lookup_join(mended, codes, ["c_nationkey"]), "c_mktsegment", SEGMENTS)
    return hot.select(
        "c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"), "nation_code",
        *[f"c_mktsegment_{s}" for s in SEGMENTS],
    )


@query
def part_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Dense codes of all parts sold, and of the parts of each return flag."""
    lines = table(spark, folder, "lineitem")
    whole = columns.label_codes(lines, "l_partkey").withColumn("l_returnflag", F.lit("all"))
    by_flag = columns.label_codes(lines, "l_partkey", group=["l_returnflag"])
    return whole.unionByName(by_flag).select("l_returnflag", "l_partkey", "code")


@query
def column_modes(spark: SparkSession, folder: str) -> DataFrame:
    names = ["l_shipmonth", "l_linenumber", "l_returnflag", "l_partkey"]
    df = table(spark, folder, "lineitem").withColumn("l_shipmonth", F.month("l_shipdate"))
    return columns.column_modes(df, names)


def long_vectors(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode("embedding").alias("component", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query
def context_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows embedded in a damaged train context."""
    split = sampling.split_train_test(holed_customer(spark, folder), "c_custkey", SEED)
    return long_vectors(encoders.embed_test_side(split, CUSTOMER), "c_custkey")


@query
def oof_embedding(spark: SparkSession, folder: str) -> DataFrame:
    embedded = suite_encoder.out_of_fold_embeddings(table(spark, folder, "customer"), CUSTOMER, SEED)
    return long_vectors(embedded, "c_custkey")


# ---------------------------------------------------------------- reports


@query
def report_probe(spark: SparkSession, folder: str) -> DataFrame:
    done = report.probe_report(experiments(spark, folder), metrics(spark, folder))
    return done.withColumns({"value": F.round("value", 6), "baseline": F.round("baseline", 6)})


@query
def report_distance(spark: SparkSession, folder: str) -> DataFrame:
    done = report.distance_report(experiments(spark, folder), metrics(spark, folder))
    return done.withColumn("value", F.round("value", 6))


@query
def report_context_size(spark: SparkSession, folder: str) -> DataFrame:
    done = report.context_size_report(experiments(spark, folder), metrics(spark, folder))
    return done.withColumn("value", F.round("value", 6))


@query
def report_ideal(spark: SparkSession, folder: str) -> DataFrame:
    done = report.ideal_report(experiments(spark, folder), metrics(spark, folder))
    return done.withColumns({"value": F.round("value", 6), "baseline": F.round("baseline", 6)})


@query
def report_composite_names(spark: SparkSession, folder: str) -> DataFrame:
    joined = report.joined_metrics(experiments(spark, folder), metrics(spark, folder))
    return report.average_by_composite_name(joined, ["tag"]).withColumn("value", F.round("value", 6))


@query
def report_series(spark: SparkSession, folder: str) -> DataFrame:
    averages = report.distance_report(experiments(spark, folder), metrics(spark, folder))
    lines = report.series(averages, [*report.PANEL, "tag"])
    return lines.select(
        *report.PANEL, "tag", "error_type", F.posexplode(F.arrays_zip("rates", "values")).alias("place", "point")
    ).select(
        *report.PANEL, "tag", "error_type", "place", F.col("point.rates").alias("rate"),
        F.round("point.values", 6).alias("value"),
    )


@query
def report_ranges(spark: SparkSession, folder: str) -> DataFrame:
    ranges = report.panel_ranges(report.distance_report(experiments(spark, folder), metrics(spark, folder)))
    return ranges.select(*report.PANEL, *[F.round(c, 6).alias(c) for c in ("low", "high", "padded_low", "padded_high")])


@query
def experiment_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Exact keys and inclusive size bounds together."""
    runs = experiments(spark, folder).where(report.size_bounds(train_size_max=5_000, train_size_min=0, test_size_min=2))
    chosen = (F.col("tag") == S.DIRTY_DIRTY) & (F.col("error_type") == S.SCAR) & (F.col("random_seed") == 200)
    return runs.where(chosen).select(
        "experiment_id", "dataset_name", F.col("row_corruption_percent").cast("int").alias("row_corruption_percent")
    )


# ---------------------------------------------------------------- learned results (no SQL counterpart)


@query
def probe_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    rows = vector_pairs(spark, folder).withColumns(
        {"experiment_id": F.lit("vectors"), "row_corruption_percent": F.lit(30)}
    )
    return evaluation.probe_metrics(rows).select(
        "evaluation_type", "metric_name", F.round("metric_value", 6).alias("metric_value")
    )


@query
def probe_distributed(spark: SparkSession, folder: str) -> DataFrame:
    """One probe over all line items: too large for a task, fitted across executors."""
    df = table(spark, folder, "lineitem").select(
        F.lit("lineitem").alias("run"),
        F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("v"),
        (F.col("l_extendedprice") > 40_000).cast("int").alias("y"),
    )
    return probe.probe_auc(df, ["run"], "v", "y").select("run", F.round("roc_auc", 6).alias("roc_auc"))


@query
def transfer_probes(spark: SparkSession, folder: str) -> DataFrame:
    rows = vector_pairs(spark, folder).withColumn("experiment_id", F.lit("vectors"))
    return evaluation.transfer_metrics(rows).select(
        "evaluation_type", "metric_name", F.round("metric_value", 6).alias("metric_value")
    )


@query
def kmeans_purity(spark: SparkSession, folder: str) -> DataFrame:
    rows = vector_pairs(spark, folder).select(
        F.lit("vectors").alias("experiment_id"), F.col("vec_id").alias("row_id"), "embedding", "label", "is_corrupted"
    )
    runs = spark.createDataFrame([("vectors", 10)], "experiment_id string, number_of_classes int")
    return evaluation.clustering_metrics(rows, runs).select("evaluation_type", "metric_name", "metric_value")


@query
def pca_2d(spark: SparkSession, folder: str) -> DataFrame:
    return planar.project_2d(vector_pairs(spark, folder), "embedding", ["vec_id", "label", "is_corrupted"])


@query
def synthetic_rows(spark: SparkSession, folder: str) -> DataFrame:
    return synthesis.synthesize(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"], SEED)


def split_customer(spark: SparkSession, folder: str, dataset: S.DatasetSpec = CUSTOMER_SEGMENT) -> sampling.Prepared:
    return sampling.prepare(table(spark, folder, "customer"), dataset, SEED)


@query
def classification_run(spark: SparkSession, folder: str) -> DataFrame:
    spec = S.CorruptionSpec(S.MCAR, SEED, 20, 50)
    return models.classification_run(split_customer(spark, folder), SEED, S.DIRTY_DIRTY, spec)


@query
def regression_run(spark: SparkSession, folder: str) -> DataFrame:
    dataset = S.DatasetSpec("lineitem", "row_id", "l_extendedprice", ("l_quantity", "l_discount", "l_tax"), ("l_returnflag",), "regression")
    split = sampling.split_train_test(keyed_lineitem(spark, folder), "row_id", SEED)
    return models.regression_run(split, dataset)


@query
def embedding_models(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy and R² of linear models on out-of-fold and plain embeddings."""
    df = table(spark, folder, "customer")
    split = sampling.split_train_test(df, "c_custkey", SEED).select("c_custkey", (F.col("split") == "test").alias("is_test"))
    plain = encoders.ContextEncoder.fit(df, CUSTOMER).transform(df).select("c_custkey", "c_nationkey", "embedding")
    folded = suite_encoder.out_of_fold_embeddings(df, CUSTOMER, SEED).drop("fold")
    parts = []
    for name, vectors in (("plain", plain), ("out of fold", folded)):
        rows = vectors.join(split, "c_custkey")
        accuracy = models.probe_accuracy(rows, "c_nationkey", "is_test", 0.001)
        fitted = models.embedding_regression(rows, "c_nationkey", "is_test").select("r2")
        one = F.lit(1)
        parts.append(
            accuracy.withColumn("one", one).join(fitted.withColumn("one", one), "one").select(
                F.lit(name).alias("embeddings"), F.round("accuracy", 6).alias("accuracy"), F.round("r2", 6).alias("r2")
            )
        )
    return parts[0].unionByName(parts[1])


@query
def grid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Logistic or modified Huber loss, whichever is best over all strengths and folds."""
    dataset = S.DatasetSpec("orders", "o_orderkey", "is_open", ("o_totalprice",), ("o_orderpriority",))
    df = table(spark, folder, "orders").withColumn("is_open", (F.col("o_orderstatus") == "O").cast("int"))
    prepared = sampling.prepare(df, dataset, SEED, test_size=0.5, max_rows=None)
    return search.search_report(spark, prepared.data, dataset, SEED).select(
        "loss", "alpha", F.round("cv_roc_auc", 6).alias("cv_roc_auc"), F.round("roc_auc", 6).alias("roc_auc")
    )


SUITE_PART = S.DatasetSpec("part", "p_partkey", "p_type", ("p_size", "p_retailprice"), ("p_brand",))


def sweep_folder(spark: SparkSession, folder: str) -> str:
    """Sweep over customers and parts, all seeds and settings, stored in the shared work place.

    A second call finds every setting stored and does nothing.
    """
    base = work_folder(spark)
    source = text_digest(0, "sweep source", folder.rstrip("/"))[:16]
    target = f"{base}/smudgelab-{spark.sparkContext.applicationId}/{source}"
    tables_of_suite = [(table(spark, folder, d.name), d) for d in (CUSTOMER_SEGMENT, SUITE_PART)]
    suite.run_suite(spark, tables_of_suite, target)
    return target


@query
def sweep_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Stored experiments of a sweep with the vectors and damaged rows of each."""
    target = sweep_folder(spark, folder)
    runs = tables.read_table(spark, target, "embeddings_experiments")
    vectors = tables.read_table(spark, target, "embeddings").groupBy("experiment_id").agg(F.count("*").alias("vectors"))
    hit = tables.read_table(spark, target, "corrupted_rows").groupBy("experiment_id").agg(F.count("*").alias("hit"))
    return runs.join(vectors, "experiment_id").join(hit, "experiment_id", "left").select(
        "dataset_name", "random_seed", "tag", "error_type", "row_corruption_percent", "train_size", "test_size",
        "number_of_classes", "number_of_features", "vectors", F.coalesce("hit", F.lit(0)).alias("damaged_rows"),
    )


@query
def classification_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Stored scores of the classification sweep over the same tables, seeds and settings.

    The scores themselves are learned; whether each is there and a share is told for every run.
    """
    base = work_folder(spark)
    source = text_digest(0, "classification source", folder.rstrip("/"))[:16]
    target = f"{base}/smudgelab-{spark.sparkContext.applicationId}/{source}"
    suite_tables = [(table(spark, folder, d.name), d) for d in (CUSTOMER_SEGMENT, SUITE_PART)]
    classification.run_classification(spark, suite_tables, target)
    stored = tables.read_table(spark, target, classification.TABLE)
    names = [d.name for _, d in suite_tables]
    rows = classification.described(spark, stored, names, S.DEFAULT_SEEDS, grid.configurations())
    shares = [F.coalesce(F.col(c).between(0, 1), F.lit(False)) for c in ("roc_auc", "accuracy", "recall", "precision", "f1_score")]
    return rows.select(
        "dataset_name", "random_seed", "tag", "error_type", "row_corruption_percent", "train_size", "test_size",
        reduce(lambda a, b: a & b, shares).alias("is_scored"),
    )


SWEEP_TABLES = ("embeddings_experiments", "embeddings", "corrupted_rows")


def with_settings(found: DataFrame, runs: DataFrame) -> DataFrame:
    return found.join(runs.select("experiment_id", "dataset_name", "random_seed", "tag", "error_type"), "experiment_id").select(
        "dataset_name", "random_seed", "tag", "error_type", "row_corruption_percent", "evaluation_type", "metric_name", "metric_value"
    )


def evaluated(spark: SparkSession, folder: str, older: bool) -> DataFrame:
    """Metrics of one set over the sweep, stored and read back."""
    target = sweep_folder(spark, folder)
    evaluation.run_evaluation(spark, target, older)
    found = tables.read_table(spark, target, "embedding_evaluation_metrics")
    current = F.col("evaluation_type").startswith("LP_") | F.col("evaluation_type").startswith("DFR_")
    runs = tables.read_table(spark, target, "embeddings_experiments")
    return with_settings(found.where(~current if older else current), runs)


@query
def evaluate_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return evaluated(spark, folder, older=False)


@query
def evaluate_sweep_older(spark: SparkSession, folder: str) -> DataFrame:
    """The older set of metrics over the same runs."""
    return evaluated(spark, folder, older=True)


@query
def planar_views(spark: SparkSession, folder: str) -> DataFrame:
    target = sweep_folder(spark, folder)
    stored = [tables.read_table(spark, target, t) for t in SWEEP_TABLES]
    wanted = "dataset_name = 'customer' AND random_seed = 100 AND tag = 'DIRTY_DIRTY' AND error_type = 'MCAR'"
    chosen = stored[0].where(wanted).agg(F.min("experiment_id")).first()[0]
    prepared = sampling.prepare(table(spark, folder, "customer"), CUSTOMER_SEGMENT, 100)
    raw = views.raw_vectors(prepared.data.where("split = 'test'"), prepared.dataset)
    return views.planar_view(chosen, *stored, raw=raw, flips={"RAW": "FLIP_VER"})
