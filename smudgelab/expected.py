"""Expected results of the registered queries as SQL over the same tables.

The statements restate each query on its own terms: ranks by window functions
over whole tables, pairs by plain joins.
"""

from __future__ import annotations

from smudgelab.plans.report import CONTEXT_PANELS, DISTANCE_PANELS, IDEAL_PANELS, PROBE_PANELS

EXPECTED: dict[str, str] = {}

# ---------------------------------------------------------------- shared parts

LINES = """lines AS (
  SELECT *, md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                          round(l_extendedprice * 100)::BIGINT)) AS row_id FROM lineitem)"""

RUNS = """runs AS (
  SELECT o_orderkey::VARCHAR AS experiment_id, 'OpenML-' || o_custkey AS dataset_name,
    floor(o_totalprice / 50)::INT AS train_size, floor(o_totalprice / 100000)::INT AS test_size,
    substr(o_orderpriority, 1, 1)::INT AS number_of_classes,
    ([100, 200, 300])[o_orderkey % 3 + 1] AS random_seed,
    CASE WHEN o_orderstatus = 'P' THEN 'NONE'
         ELSE (['MCAR', 'SCAR', 'CSCAR'])[(o_orderkey // 3) % 3 + 1] END AS error_type,
    CASE o_orderstatus WHEN 'P' THEN 'CLEAN_CLEAN' WHEN 'F' THEN 'CLEAN_DIRTY' ELSE 'DIRTY_DIRTY' END AS tag,
    CASE WHEN o_orderstatus = 'P' THEN 0 ELSE ([10, 20, 40])[(o_orderkey // 9) % 3 + 1] END AS row_corruption_percent,
    CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 20 END AS column_corruption_percent
  FROM orders)"""

PANELS = (*PROBE_PANELS, *DISTANCE_PANELS, *IDEAL_PANELS)


def _list(values: list[str]) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + "])"


MEASURES = f"""measures AS (
  SELECT l_orderkey::VARCHAR AS experiment_id,
    {_list([p[0] for p in PANELS])}[l_partkey % {len(PANELS)} + 1] AS evaluation_type,
    {_list([p[1] for p in PANELS])}[l_partkey % {len(PANELS)} + 1] AS metric_name,
    CASE WHEN l_tax > 0.075 THEN 'NaN'::DOUBLE ELSE l_quantity / 50 END AS metric_value,
    ([10, 20, 40])[l_suppkey % 3 + 1] AS rate
  FROM lineitem)"""

JOINED = f"""{RUNS}, {MEASURES}, joined AS (
  SELECT m.*, r.tag, r.error_type, r.train_size, r.test_size
  FROM runs r JOIN measures m ON r.experiment_id = m.experiment_id)"""


def _in(panels: tuple[tuple[str, str], ...]) -> str:
    return "(evaluation_type, metric_name) IN (" + ", ".join(f"('{a}', '{b}')" for a, b in panels) + ")"


PAIRS = """pairs AS (
  SELECT vec_id, label, reference, hit AS is_corrupted,
    CASE WHEN hit THEN list_transform(reference, lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN x * 10 ELSE x END)
         ELSE reference END AS embedding
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS reference,
          row_number() OVER (ORDER BY md5('42:row:test:' || vec_id))
            <= greatest(floor(30 * count(*) OVER () / 100), 1) AS hit
        FROM embeddings)),
typed AS (
  SELECT *, 'ALL' AS samples_type FROM pairs
  UNION ALL SELECT *, CASE WHEN is_corrupted THEN 'COR' ELSE 'CLE' END FROM pairs)"""


def split(table: str, key: str, share: str = "0.3", seed: int = 42) -> str:
    """Rows of a table with their side."""
    return f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('{seed}:split:' || {key}))
      <= ceil({share} * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM {table}"""


def hit(key: str, percent: int, side: str, over: str = "") -> str:
    """Whether a row is among those to damage."""
    return f"""row_number() OVER ({over} ORDER BY md5('42:row:{side}:' || {key}))
      <= greatest(floor({percent} * count(*) OVER ({over}) / 100), 1)"""


def columns(names: list[str], percent: int, side: str, kind: str) -> str:
    """Columns to damage."""
    values = ", ".join(f"('{n}')" for n in names)
    count = max(int(percent * len(names) / 100), 1)
    return f"SELECT c FROM (VALUES {values}) v(c) ORDER BY md5('42:column:{side}:{kind}:' || c) LIMIT {count}"


def shift(rows: str, column: str, side: str) -> str:
    """old → new over the values of the chosen rows."""
    ranked = [
        f"""(SELECT v, row_number() OVER (ORDER BY md5('42:{end}:{side}:{column}:' || v)) AS n
          FROM (SELECT DISTINCT {column} AS v FROM {rows} WHERE hit AND {column} IS NOT NULL))"""
        for end in ("old", "new")
    ]
    return f"SELECT a.v AS old, b.v AS new FROM {ranked[0]} a JOIN {ranked[1]} b ON a.n = b.n"


# ---------------------------------------------------------------- sampling and corruption

EXPECTED["mcar_customer"] = f"""
WITH cols AS ({columns(["c_acctbal", "c_mktsegment"], 50, "all", "MCAR")}),
rows AS (SELECT *, {hit("c_custkey", 20, "all")} AS hit FROM customer)
SELECT c_custkey,
  CASE WHEN hit AND 'c_acctbal' IN (SELECT c FROM cols) THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN hit AND 'c_mktsegment' IN (SELECT c FROM cols) THEN NULL ELSE c_mktsegment END AS c_mktsegment,
  hit AS is_corrupted
FROM rows"""

_SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EXPECTED["scar_lineitem"] = f"""
WITH {LINES},
cols AS ({columns(_SCALED, 50, "all", "SCAR")}),
rows AS (SELECT *, {hit("row_id", 10, "all")} AS hit FROM lines),
long AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v, hit FROM rows" for c in _SCALED) + """),
scaled AS (
  SELECT "column", v, CASE WHEN hit AND "column" IN (SELECT c FROM cols)
    THEN v * ([10, 100, 1000])[('0x' || substr(md5('42:factor:all:' || "column"), 1, 8))::BIGINT % 3 + 1]
    ELSE v END AS w
  FROM long)
SELECT "column", sum(round(w * 100)::BIGINT)::BIGINT AS total_cents,
  count(*) FILTER (v IS DISTINCT FROM w) AS changed
FROM scaled GROUP BY "column" """

EXPECTED["cscar_customer"] = f"""
WITH rows AS (SELECT *, {hit("c_custkey", 20, "all")} AS hit FROM customer),
map AS ({shift("rows", "c_mktsegment", "all")})
SELECT c_custkey, c_mktsegment AS old, CASE WHEN hit THEN map.new ELSE c_mktsegment END AS new,
  hit AND map.new IS DISTINCT FROM c_mktsegment AS is_corrupted
FROM rows LEFT JOIN map ON c_mktsegment = map.old"""

EXPECTED["cscar_orders_wide"] = f"""
WITH rows AS (SELECT *, {hit("o_orderkey", 40, "all")} AS hit FROM orders),
map AS ({shift("rows", "o_custkey", "all")})
SELECT o_orderkey, o_custkey AS old, CASE WHEN hit THEN map.new ELSE o_custkey END AS new,
  hit AND map.new IS DISTINCT FROM o_custkey AS is_corrupted
FROM rows LEFT JOIN map ON o_custkey = map.old"""


def _audit() -> str:
    steps = [f"sides AS ({split('orders', 'o_orderkey')})"]
    parts = []
    for side in ("train", "test"):
        rows = f"{side}_rows"
        steps.append(
            f"{rows} AS (SELECT *, {hit('o_orderkey', 20, side)} AS hit FROM sides WHERE split = '{side}')"
        )
        steps.append(f"{side}_map AS ({shift(rows, 'o_orderpriority', side)})")
        tags = [t for t in ("CLEAN_DIRTY", "DIRTY_CLEAN", "DIRTY_DIRTY")
                if (side == "train") == t.startswith("DIRTY") or t == "DIRTY_DIRTY"]
        for tag in tags:
            for column in ("o_totalprice", "o_orderpriority"):
                parts.append(
                    f"SELECT '{tag}' AS tag, 'MCAR' AS error_type, '{side}' AS side, '{column}' AS \"column\", "
                    f"count(*) AS rows, count(*) FILTER (hit) AS changed, "
                    f"round(count(*) FILTER (hit) / count(*), 6) AS rate FROM {rows}"
                )
            changed = "count(*) FILTER (hit AND new IS DISTINCT FROM o_orderpriority)"
            parts.append(
                f"SELECT '{tag}', 'CSCAR', '{side}', 'o_orderpriority', count(*), {changed}, "
                f"round({changed} / count(*), 6) FROM {rows} LEFT JOIN {side}_map ON o_orderpriority = old"
            )
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(parts)


EXPECTED["corruption_audit"] = _audit()

EXPECTED["audit_stored_tables"] = f"""
WITH rows AS (SELECT *, {hit("c_custkey", 40, "all")} AS hit FROM customer)
SELECT c AS "column", count(*) AS rows, count(*) FILTER (hit) AS changed,
  round(count(*) FILTER (hit) / count(*), 6) AS rate
FROM rows, (VALUES ('c_acctbal'), ('c_mktsegment')) v(c) GROUP BY c"""

EXPECTED["corrupted_manifest"] = f"""
WITH sides AS ({split("part", "p_partkey")}),
rows AS (
  SELECT split, p_partkey, CASE split WHEN 'train' THEN
    {hit("p_partkey", 10, "train", "PARTITION BY split")} ELSE
    {hit("p_partkey", 10, "test", "PARTITION BY split")} END AS hit FROM sides)
SELECT split AS side, p_partkey::VARCHAR AS row_id FROM rows WHERE hit"""

EXPECTED["meaningful_runs"] = f"""
WITH {RUNS}, lines AS (
  SELECT l_orderkey::VARCHAR AS experiment_id, count(*) AS r, count(DISTINCT l_linenumber) AS c
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
counted AS (SELECT experiment_id, tag, coalesce(r, 0) AS corrupted_rows, coalesce(c, 0) AS corrupted_columns
  FROM runs LEFT JOIN lines USING (experiment_id))
SELECT * FROM counted
WHERE (tag = 'CLEAN_CLEAN' AND corrupted_rows = 0 AND corrupted_columns = 0)
   OR (tag <> 'CLEAN_CLEAN' AND corrupted_rows > 0 AND corrupted_columns > 0)"""


def _part_features() -> list[str]:
    import hashlib

    names = ["p_size", "p_retailprice", "p_type", "p_name"]
    kept = sorted(names, key=lambda c: hashlib.md5(f"42:feature:{c}".encode()).hexdigest())[:3]
    return [n for n in names if n in kept]


EXPECTED["split_caps_part"] = f"""
WITH classes AS (
  SELECT p_brand FROM (SELECT DISTINCT p_brand FROM part) ORDER BY md5('42:class:' || p_brand) LIMIT 10),
kept AS (SELECT * FROM part WHERE p_brand IN (SELECT p_brand FROM classes)),
sides AS ({split("kept", "p_partkey")}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42:train:' || p_partkey)) AS n FROM sides)
SELECT p_partkey, {", ".join(_part_features())}, p_brand, split FROM ranked WHERE split = 'test' OR n <= 300"""

EXPECTED["split_lineitem"] = f"""
WITH {LINES}, sides AS ({split("lines", "row_id")}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42:train:' || row_id)) AS n FROM sides)
SELECT split, l_returnflag, count(*) AS rows, min(row_id) AS first_key, max(row_id) AS last_key
FROM ranked WHERE split = 'test' OR n <= 10000 GROUP BY split, l_returnflag"""

EXPECTED["sample_orders"] = """
SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('42:pick:' || o_orderkey) LIMIT 1000"""

EXPECTED["keep_and_recode_classes"] = """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS label
FROM orders WHERE o_orderstatus IN ('F', 'O')"""

EXPECTED["kfold_counts"] = """
WITH folded AS (
  SELECT o_orderkey, (('0x' || substr(md5('42:fold:' || o_orderkey), 1, 8))::BIGINT % 10)::INT AS fold FROM orders)
SELECT fold, count(*) AS rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM folded GROUP BY fold"""


def limit(rows: str, features: str, classes: str) -> str:
    text = "10000"
    for size, most in ((rows, 8000), (features, 400), (classes, 8)):
        text = f"(CASE WHEN {size} > {most} THEN floor({text} * 0.8) ELSE {text} END)"
    return f"{text}::INT"


EXPECTED["batch_ids"] = f"""
WITH {LINES},
facts AS (SELECT l_returnflag, {limit("count(*)", "11", "count(DISTINCT l_linenumber)")} AS batch_limit
  FROM lines GROUP BY l_returnflag),
ranked AS (SELECT row_id, l_returnflag,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('42:batch:' || row_id)) - 1 AS pos FROM lines)
SELECT l_returnflag, floor(pos / batch_limit)::BIGINT AS batch, count(*) AS rows,
  min(row_id) AS first_key, max(row_id) AS last_key
FROM ranked JOIN facts USING (l_returnflag) GROUP BY ALL"""

EXPECTED["inference_limits"] = f"""
WITH {RUNS} SELECT experiment_id,
  {limit("train_size", "train_size % 500", "number_of_classes * 2")} AS batch_limit FROM runs"""

EXPECTED["test_positions"] = f"""
WITH sides AS ({split("orders", "o_orderkey")})
SELECT o_orderkey, o_orderstatus,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:position:' || o_orderkey)) - 1 AS pos
FROM sides WHERE split = 'test'"""

# ---------------------------------------------------------------- grid, profiles, integrity

_GRID = """suite AS (
  SELECT s_suppkey AS dataset_id, CASE WHEN s_acctbal > 0 THEN s_suppkey + 100000 ELSE s_suppkey END AS task_id,
    'OpenML-' || s_suppkey AS dataset_name
  FROM supplier WHERE s_suppkey NOT IN (5, 8)),
settings AS (
  SELECT tag, error_type, row_corruption_percent, column_corruption_percent
  FROM (VALUES ('CLEAN_CLEAN'), ('CLEAN_DIRTY'), ('DIRTY_DIRTY')) m(tag),
       (VALUES ('NONE'), ('MCAR'), ('SCAR'), ('CSCAR')) t(error_type),
       (VALUES (0), (10), (20), (40)) r(row_corruption_percent),
       (VALUES (0), (20)) c(column_corruption_percent)
  WHERE (tag = 'CLEAN_CLEAN') = (error_type = 'NONE')
    AND (error_type = 'NONE') = (row_corruption_percent = 0)
    AND (error_type = 'NONE') = (column_corruption_percent = 0)),
grid AS (SELECT * FROM suite, (VALUES (100), (200), (300)) s(random_seed), settings)"""

_GRID_COLUMNS = """random_seed, tag, error_type, row_corruption_percent::SMALLINT AS row_corruption_percent,
  column_corruption_percent::SMALLINT AS column_corruption_percent"""

EXPECTED["config_grid"] = f"WITH {_GRID} SELECT dataset_id, task_id, dataset_name, {_GRID_COLUMNS} FROM grid"

EXPECTED["grid_pending"] = f"""
WITH {_GRID}, {RUNS} SELECT dataset_id, {_GRID_COLUMNS} FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.dataset_name = g.dataset_name AND r.random_seed = g.random_seed
  AND r.tag = g.tag AND r.error_type = g.error_type AND r.row_corruption_percent = g.row_corruption_percent
  AND r.column_corruption_percent = g.column_corruption_percent)"""

EXPECTED["suite_limits"] = """
WITH profiled AS (
  SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS k,
    CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'regression' ELSE 'classification' END AS task
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type),
counted AS (
  SELECT 'part types' AS suite, task, count(*) AS tasks, count(*) FILTER (n > 10000) AS over_samples,
    count(*) FILTER (n * 0.7 > 10000) AS over_train_samples, count(*) FILTER (n * 0.3 > 10000) AS over_test_samples,
    count(*) FILTER (11 > 500) AS over_features,
    count(*) FILTER (task = 'classification' AND k > 10) AS over_classes
  FROM profiled GROUP BY task)
SELECT *, round(over_samples / tasks, 6) AS share_samples, round(over_train_samples / tasks, 6) AS share_train_samples,
  round(over_test_samples / tasks, 6) AS share_test_samples, round(over_features / tasks, 6) AS share_features,
  round(over_classes / tasks, 6) AS share_classes
FROM counted"""

EXPECTED["run_profile"] = f"""
WITH sides AS ({split("part", "p_partkey")})
SELECT count(*) FILTER (split = 'train') AS train_size, count(*) FILTER (split = 'test') AS test_size,
  count(DISTINCT p_brand) FILTER (split = 'train') AS number_of_classes, 4 AS number_of_features
FROM sides"""

EXPECTED["class_lists"] = """
SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS classes,
  count(DISTINCT o_orderpriority)::INT AS n
FROM orders GROUP BY o_orderstatus"""

EXPECTED["schema_checks"] = """
SELECT 'duplicate key' AS check_name, 'orders' AS table_name, count(*) AS violations
  FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'duplicate key', 'lineitem', count(*)
  FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'orphan', 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orphan', 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
""" + " ".join(
    f"UNION ALL SELECT 'null {c}', 'customer', count(*) FILTER ({c} IS NULL) FROM customer"
    for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
)

EXPECTED["unrepeatable_datasets"] = f"""
WITH {RUNS}, sides AS ({split("part", "p_partkey", "0.95")})
SELECT DISTINCT dataset_name FROM runs JOIN lineitem ON experiment_id = l_orderkey::VARCHAR
WHERE l_partkey NOT IN (SELECT p_partkey FROM sides WHERE split = 'test')"""

EXPECTED["manifest_json"] = """
SELECT l_orderkey AS experiment_id, l_linenumber::BIGINT AS row_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O' OR l_returnflag <> 'N'"""

EXPECTED["consistency_gate"] = f"""
WITH {RUNS}, counted AS (
  SELECT r.*, (SELECT count(*) FROM lineitem WHERE l_orderkey::VARCHAR = r.experiment_id) AS n FROM runs r)
SELECT CASE WHEN n = 0 THEN 'no embeddings' WHEN n < test_size THEN 'fewer embeddings than labels'
  WHEN number_of_classes <= 1 THEN 'single class' ELSE 'usable' END AS reason, count(*) AS runs
FROM counted GROUP BY 1"""

EXPECTED["evaluation_rejects"] = f"""
WITH {RUNS}, counted AS (
  SELECT l_orderkey::VARCHAR AS experiment_id, count(*) AS n,
    bool_or(l_linenumber = 7 AND l_tax > 0.075) AS lost FROM lineitem GROUP BY 1),
datasets AS (SELECT DISTINCT dataset_name FROM runs JOIN counted USING (experiment_id) WHERE lost),
judged AS (
  SELECT r.*, CASE WHEN n IS NULL THEN 'no embeddings' WHEN n < test_size THEN 'fewer embeddings than labels'
    WHEN number_of_classes <= 1 THEN 'single class'
    WHEN dataset_name IN (SELECT dataset_name FROM datasets)
      THEN 'damaged rows missing from the test side of the dataset' END AS reason
  FROM runs r LEFT JOIN counted USING (experiment_id))
SELECT experiment_id, dataset_name, reason FROM judged WHERE reason IS NOT NULL
UNION ALL SELECT experiment_id, dataset_name, 'no clean reference' FROM judged d
WHERE reason IS NULL AND tag <> 'CLEAN_CLEAN' AND NOT EXISTS (
  SELECT 1 FROM judged c WHERE c.reason IS NULL AND c.dataset_name = d.dataset_name
    AND c.random_seed = d.random_seed AND c.tag = 'CLEAN_CLEAN' AND c.error_type = 'NONE'
    AND c.row_corruption_percent = 0 AND c.column_corruption_percent = 0)"""

EXPECTED["not_evaluated"] = f"""
WITH {RUNS}, {MEASURES} SELECT experiment_id, dataset_name, tag FROM runs WHERE experiment_id NOT IN (
  SELECT experiment_id FROM measures WHERE NOT isnan(metric_value) AND evaluation_type = 'LP_ALL_TLGT')"""

EXPECTED["clean_reference_links"] = f"""
WITH {RUNS} SELECT d.experiment_id, (SELECT min(c.experiment_id) FROM runs c
  WHERE c.dataset_name = d.dataset_name AND c.random_seed = d.random_seed AND c.tag = 'CLEAN_CLEAN'
    AND c.error_type = 'NONE' AND c.row_corruption_percent = 0 AND c.column_corruption_percent = 0)
  AS clean_experiment_id
FROM runs d WHERE d.tag <> 'CLEAN_CLEAN'"""

EXPECTED["borrowed_rows"] = f"""
WITH {RUNS}, donors AS (
  SELECT dataset_name, random_seed, row_corruption_percent, experiment_id, row_number() OVER (
    PARTITION BY dataset_name, random_seed, row_corruption_percent
    ORDER BY error_type = 'CSCAR', error_type, experiment_id) AS n
  FROM runs WHERE tag = 'CLEAN_DIRTY'),
takers AS (SELECT experiment_id, dataset_name, random_seed, p FROM runs,
  (VALUES (0), (10), (20), (40)) v(p) WHERE tag = 'CLEAN_CLEAN')
SELECT t.experiment_id, t.p AS row_corruption_percent, d.experiment_id AS source_experiment_id
FROM takers t LEFT JOIN donors d ON t.dataset_name = d.dataset_name AND t.random_seed = d.random_seed
  AND t.p = d.row_corruption_percent AND d.n = 1"""

EXPECTED["experiment_page"] = f"""
WITH {RUNS} SELECT experiment_id, dataset_name, tag FROM runs ORDER BY experiment_id DESC LIMIT 300 OFFSET 300"""

EXPECTED["first_run_of_dataset"] = f"""
WITH {RUNS} SELECT experiment_id, dataset_name, random_seed, tag FROM runs
QUALIFY row_number() OVER (PARTITION BY dataset_name, random_seed ORDER BY tag, experiment_id) = 1"""

# ---------------------------------------------------------------- vectors

_DISTANCES = """measured AS (
  SELECT samples_type,
    sqrt(list_sum(list_transform(list_zip(zr, ze), lambda p: power(p[1] - p[2], 2)))) AS zed,
    1 - list_sum(list_transform(list_zip(reference, embedding), lambda p: p[1] * p[2]))
      / (sqrt(list_sum(list_transform(reference, lambda x: x * x)))
         * sqrt(list_sum(list_transform(embedding, lambda x: x * x)))) AS cos,
    sqrt(list_sum(list_transform(list_zip(reference, embedding), lambda p: power(p[1] - p[2], 2)))) AS ed
  FROM (
    SELECT *,
      list_transform(reference, lambda x: (x - list_avg(reference)) / list_stddev_pop(reference)) AS zr,
      list_transform(embedding, lambda x: (x - list_avg(embedding)) / list_stddev_pop(embedding)) AS ze
    FROM typed))"""


def _means(metrics: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT samples_type, '{m.upper()}' AS metric_name, round(avg({m}), 6) AS metric_value "
        "FROM measured GROUP BY samples_type"
        for m in metrics
    )


EXPECTED["distances_from_reference"] = f"WITH {PAIRS}, {_DISTANCES} {_means(('zed', 'cos', 'ed'))}"

EXPECTED["distances_from_clean_run"] = f"""
WITH {PAIRS.replace("typed AS", "everything AS")},
typed AS (SELECT e.* FROM everything e JOIN (SELECT label, count(*) * 9 AS last FROM pairs GROUP BY label) c
  ON e.label = c.label WHERE vec_id < last), {_DISTANCES}
SELECT 'dirty' AS experiment_id, * FROM ({_means(("zed", "cos"))})"""

EXPECTED["clean_row_labels"] = f"WITH {PAIRS} SELECT vec_id, label FROM pairs WHERE NOT is_corrupted"

EXPECTED["vector_scalars"] = f"""
WITH {PAIRS}, powers AS (SELECT vec_id, list_transform(reference, lambda x: exp(x)) AS p FROM pairs)
SELECT vec_id, round(list_max(p) / list_sum(p), 6) AS top,
  (list_position(p, list_max(p)) - 1)::INT AS place FROM powers"""

EXPECTED["matrix_round_trip"] = f"""
WITH {PAIRS} SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5('42:place:' || vec_id)) - 1 AS pos,
  round(list_sum(embedding), 6) AS component_sum FROM pairs"""

EXPECTED["knn_similarity"] = f"""
WITH {PAIRS}, ranked AS (
  SELECT a.samples_type, a.vec_id, list_cosine_similarity(a.embedding, b.embedding) AS s,
    row_number() OVER (PARTITION BY a.samples_type, a.vec_id
      ORDER BY list_cosine_similarity(a.embedding, b.embedding) DESC) AS n
  FROM typed a JOIN typed b ON a.samples_type = b.samples_type AND a.vec_id <> b.vec_id)
SELECT samples_type, k, round(avg(s), 6) AS similarity
FROM ranked JOIN (VALUES (1), (3), (5), (10)) v(k) ON n <= k GROUP BY samples_type, k"""

EXPECTED["cluster_purity"] = f"""
WITH {PAIRS}, counted AS (
  SELECT samples_type, vec_id % 4 AS c, label, count(*) AS n FROM typed GROUP BY ALL),
shares AS (SELECT samples_type, c, max(n) / sum(n) AS share FROM counted GROUP BY ALL)
SELECT samples_type, round(avg(share), 6) AS purity FROM shares GROUP BY samples_type"""

EXPECTED["cluster_silhouette"] = f"""
WITH {PAIRS}, near AS (
  SELECT a.samples_type, a.vec_id, a.label, b.label AS other, sum(list_distance(a.embedding, b.embedding)) AS d,
    count(*) AS n
  FROM typed a JOIN typed b ON a.samples_type = b.samples_type AND a.vec_id <> b.vec_id GROUP BY ALL),
ab AS (
  SELECT samples_type, vec_id, max(CASE WHEN label = other THEN d / n END) AS a,
    min(CASE WHEN label <> other THEN d / n END) AS b
  FROM near GROUP BY ALL)
SELECT samples_type, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
FROM ab GROUP BY samples_type"""

EXPECTED["cluster_silhouette_moments"] = f"""
WITH {PAIRS}, near AS (
  SELECT a.samples_type, a.vec_id, a.label, b.label AS other, count(*) AS n,
    sum(list_distance(a.embedding, b.embedding) ** 2) AS squared_euclidean,
    sum(1 - list_cosine_similarity(a.embedding, b.embedding)) AS cosine
  FROM typed a JOIN typed b ON a.samples_type = b.samples_type AND a.vec_id <> b.vec_id GROUP BY ALL),
long AS (UNPIVOT near ON squared_euclidean, cosine INTO NAME measure VALUE d),
ab AS (
  SELECT samples_type, vec_id, measure, max(CASE WHEN label = other THEN d / n END) AS a,
    min(CASE WHEN label <> other THEN d / n END) AS b
  FROM long GROUP BY ALL)
SELECT samples_type, measure, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
FROM ab GROUP BY ALL"""

EXPECTED["mirror_2d"] = f"""
WITH {PAIRS} SELECT vec_id, label, round(max(reference[1]) OVER (PARTITION BY label) - reference[1], 6) AS x,
  round(max(reference[2]) OVER (PARTITION BY label) - reference[2], 6) AS y FROM pairs"""

# ---------------------------------------------------------------- scores


def auc(rows: str, group: str) -> str:
    """AUC of (group, y, s) rows by mid-ranks."""
    return f"""
SELECT {group}, round((sum(r) FILTER (y = 1) - p * (p + 1) / 2) / (p * q), 6) AS roc_auc
FROM (
  SELECT {group}, y, rank() OVER (PARTITION BY {group} ORDER BY s)
      + (count(*) OVER (PARTITION BY {group}, s) - 1) / 2 AS r,
    count(*) FILTER (y = 1) OVER (PARTITION BY {group}) AS p,
    count(*) FILTER (y = 0) OVER (PARTITION BY {group}) AS q
  FROM ({rows}))
WHERE p > 0 AND q > 0 GROUP BY {group}, p, q"""


_JUDGED = "labels JOIN documents USING (doc_id)"
EXPECTED["auc_binary"] = auc(f"SELECT lang, quality AS y, n_chars AS s FROM {_JUDGED}", "lang")
EXPECTED["auc_lineitem"] = auc(
    "SELECT l_linestatus, (l_returnflag = 'R')::INT AS y, l_extendedprice AS s FROM lineitem", "l_linestatus"
)
EXPECTED["auc_one_vs_rest"] = f"""
WITH {PAIRS}, powers AS (
  SELECT samples_type, label, list_transform(embedding, lambda x: exp(x)) AS p FROM typed),
long AS (SELECT samples_type, c, (label = c)::INT AS y, p[c + 1] / list_sum(p) AS s
  FROM powers, (SELECT unnest(range(64))::INT AS c)),
each AS (
  SELECT samples_type, c, (sum(r) FILTER (y = 1) - p * (p + 1) / 2) / (p * q) AS a
  FROM (SELECT samples_type, c, y,
      rank() OVER (PARTITION BY samples_type, c ORDER BY s)
        + (count(*) OVER (PARTITION BY samples_type, c, s) - 1) / 2 AS r,
      count(*) FILTER (y = 1) OVER (PARTITION BY samples_type, c) AS p,
      count(*) FILTER (y = 0) OVER (PARTITION BY samples_type, c) AS q FROM long)
  WHERE p > 0 AND q > 0 GROUP BY samples_type, c, p, q)
SELECT samples_type, round(avg(a), 6) AS roc_auc FROM each GROUP BY samples_type"""

EXPECTED["class_scores_binary"] = f"""
WITH judged AS (SELECT lang, quality AS y, (n_chars > 2000)::INT AS p FROM {_JUDGED}),
counted AS (SELECT lang, count(*) AS n, count(*) FILTER (y = p) AS ok, count(*) FILTER (y = 1 AND p = 1) AS tp,
  count(*) FILTER (y = 1) AS pos, count(*) FILTER (p = 1) AS claimed FROM judged GROUP BY lang)
SELECT lang, round(ok / n, 6) AS accuracy, round(CASE WHEN pos > 0 THEN tp / pos ELSE 0 END, 6) AS recall,
  round(CASE WHEN claimed > 0 THEN tp / claimed ELSE 0 END, 6) AS precision,
  round(CASE WHEN pos + claimed > 0 THEN 2 * tp / (pos + claimed) ELSE 0 END, 6) AS f1_score
FROM counted"""

EXPECTED["class_scores_micro"] = f"""
WITH {PAIRS}, judged AS (
  SELECT is_corrupted, avg((label = (list_position(embedding, list_max(embedding)) - 1) % 10)::INT) AS a
  FROM pairs GROUP BY is_corrupted)
SELECT is_corrupted, round(a, 6) AS accuracy, round(a, 6) AS recall, round(a, 6) AS precision,
  round(a, 6) AS f1_score FROM judged"""

EXPECTED["reg_scores"] = """
SELECT l_returnflag, round(avg(power(l_extendedprice - l_quantity * 1500, 2)), 2) AS mse,
  round(1 - avg(power(l_extendedprice - l_quantity * 1500, 2)) / var_pop(l_extendedprice), 6) AS r2
FROM lineitem GROUP BY l_returnflag"""

# ---------------------------------------------------------------- encoding

HOLED = f"""holed AS (
  SELECT c_custkey, c_nationkey, CASE WHEN hit THEN NULL ELSE c_acctbal END AS c_acctbal,
    CASE WHEN hit THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM (SELECT *, {hit("c_custkey", 20, "all")} AS hit FROM customer))"""


def mode_of(rows: str) -> str:
    return (
        f"(SELECT c_mktsegment FROM {rows} WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment "
        "ORDER BY count(*) DESC, c_mktsegment LIMIT 1)"
    )


EXPECTED["impute_encode"] = f"""
WITH {HOLED}, filled AS (
  SELECT c_custkey, c_nationkey, coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM holed)) AS c_acctbal,
    coalesce(c_mktsegment, {mode_of("holed")}) AS c_mktsegment FROM holed)
SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal,
  (dense_rank() OVER (ORDER BY c_nationkey) - 1)::INT AS nation_code, """ + ", ".join(
    f"(c_mktsegment = '{s}')::INT AS c_mktsegment_{s}"
    for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
) + " FROM filled"

EXPECTED["column_modes"] = "WITH long AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS \"column\", ({value})::VARCHAR AS v FROM lineitem"
    for name, value in (
        ("l_shipmonth", "month(l_shipdate)"), ("l_linenumber", "l_linenumber"),
        ("l_returnflag", "l_returnflag"), ("l_partkey", "l_partkey"),
    )
) + """), counted AS (SELECT "column", v, count(*) AS n FROM long GROUP BY ALL)
SELECT "column", v AS mode FROM counted
QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) = 1"""


def embedded(rows: str, context: str, keep: str = "c_custkey") -> str:
    """Vectors of ``rows`` given the statistics of ``context``: 16 components."""
    sign = "(CASE WHEN substr({}, i::INT, 1) < '8' THEN 1.0 ELSE -1.0 END)::DOUBLE"
    return f"""
SELECT {keep}, i::INT - 1 AS component, round((
    {sign.format("md5('0:project:0:c_acctbal')")} * (coalesce(c_acctbal, m) - m) / s
    + CASE WHEN v IN (SELECT c_mktsegment FROM {context} WHERE c_mktsegment IS NOT NULL)
        THEN {sign.format("md5('0:project:0:c_mktsegment=' || v)")} ELSE 0 END) / sqrt(2), 6) AS value
FROM (SELECT *, coalesce(c_mktsegment, {mode_of(context)}) AS v FROM {rows}),
  (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM {context}),
  (SELECT unnest(range(1, 17)) AS i)"""


EXPECTED["context_embedding"] = f"""
WITH {HOLED}, sides AS ({split("holed", "c_custkey")}),
train AS (SELECT * FROM sides WHERE split = 'train'), test AS (SELECT * FROM sides WHERE split = 'test')
{embedded("test", "train")}"""

_FOLDED = """folded AS (
  SELECT *, ('0x' || substr(md5('42:fold:' || c_custkey), 1, 8))::BIGINT % 10 AS fold FROM customer)"""
EXPECTED["oof_embedding"] = f"WITH {_FOLDED}, " + ", ".join(
    f"in{f} AS (SELECT * FROM folded WHERE fold = {f}), out{f} AS (SELECT * FROM folded WHERE fold <> {f})"
    for f in range(10)
) + " UNION ALL ".join(embedded(f"in{f}", f"out{f}") for f in range(10))

# ---------------------------------------------------------------- reports


def averages(keys: str, where: str = "true") -> str:
    return f"""SELECT {keys}, error_type, rate, avg(metric_value) AS value FROM joined
  WHERE NOT isnan(metric_value) AND {where} GROUP BY {keys}, error_type, rate"""


_PANEL_TAG = "evaluation_type, metric_name, tag"


def _with_baseline(panels: tuple[tuple[str, str], ...], tags: str, base_tag: str) -> str:
    return f"""
WITH {JOINED}, lines AS ({averages(_PANEL_TAG, f"{_in(panels)} AND tag IN ({tags})")}),
base AS (SELECT evaluation_type, metric_name, avg(metric_value) AS baseline FROM joined
  WHERE tag = '{base_tag}' GROUP BY ALL)
SELECT {_PANEL_TAG}, error_type, rate, round(value, 6) AS value, round(baseline, 6) AS baseline
FROM lines LEFT JOIN base USING (evaluation_type, metric_name)"""


_DISTANCE_LINES = averages(_PANEL_TAG, f"{_in(DISTANCE_PANELS)} AND tag IN ('CLEAN_DIRTY', 'DIRTY_DIRTY')")

EXPECTED["report_probe"] = _with_baseline(
    PROBE_PANELS, "'DIRTY_DIRTY', 'CLEAN_DIRTY', 'CLEAN_CLEAN'", "CLEAN_CLEAN"
)
EXPECTED["report_distance"] = f"""
WITH {JOINED}, lines AS ({_DISTANCE_LINES})
SELECT {_PANEL_TAG}, error_type, rate, round(value, 6) AS value FROM lines"""
EXPECTED["report_context_size"] = f"WITH {JOINED} " + " UNION ALL ".join(
    f"""SELECT evaluation_type, metric_name, '{name}' AS context, error_type, rate, round(value, 6) AS value FROM (
  {averages("evaluation_type, metric_name", f"{_in(CONTEXT_PANELS)} AND tag = 'CLEAN_DIRTY' AND {bounds}")})"""
    for name, bounds in (("few", "train_size <= 5000"), ("many", "train_size BETWEEN 5000 AND 10000"))
)
EXPECTED["report_ideal"] = _with_baseline(IDEAL_PANELS, "'DIRTY_DIRTY'", "CLEAN_DIRTY")
EXPECTED["report_composite_names"] = f"""
WITH {JOINED} SELECT tag, error_type, rate, round(value, 6) AS value FROM ({averages("tag")})"""
EXPECTED["report_series"] = f"""
WITH {JOINED}, lines AS ({_DISTANCE_LINES})
SELECT {_PANEL_TAG}, error_type, (row_number() OVER (PARTITION BY {_PANEL_TAG}, error_type ORDER BY rate) - 1)::INT
  AS place, rate, round(value, 6) AS value FROM lines"""
EXPECTED["report_ranges"] = f"""
WITH {JOINED}, lines AS ({_DISTANCE_LINES}),
ends AS (SELECT evaluation_type, metric_name, min(value) AS low, max(value) AS high FROM lines GROUP BY ALL)
SELECT evaluation_type, metric_name, round(low, 6) AS low, round(high, 6) AS high,
  round(low - (high - low) * 0.1, 6) AS padded_low, round(high + (high - low) * 0.1, 6) AS padded_high FROM ends"""
EXPECTED["experiment_lookup"] = f"""
WITH {RUNS} SELECT experiment_id, dataset_name, row_corruption_percent FROM runs
WHERE train_size <= 5000 AND test_size >= 2 AND tag = 'DIRTY_DIRTY' AND error_type = 'SCAR' AND random_seed = 200"""

EXPECTED["part_codes"] = """
SELECT 'all' AS l_returnflag, l_partkey, (row_number() OVER (ORDER BY l_partkey) - 1)::INT AS code
FROM (SELECT DISTINCT l_partkey FROM lineitem)
UNION ALL
SELECT l_returnflag, l_partkey, (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_partkey) - 1)::INT
FROM (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem)"""

# ---------------------------------------------------------------- sweep over a suite

SEEDS = (100, 200, 300)
PERCENTS = (10, 20, 40)
#: name, key, target, the one category that shifts, number of features
SUITE = (
    ("customer", "c_custkey", "c_mktsegment", "c_nationkey", 2),
    ("part", "p_partkey", "p_type", "p_brand", 3),
)


def suite_sides(name: str, key: str, target: str, category: str) -> str:
    """Rows of a table per seed, split and with the train side capped."""
    return f"""{name}_sides AS (
  SELECT seed, {key} AS k, {target} AS y, {category}::VARCHAR AS v,
    CASE WHEN row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':split:' || {key}))
      <= ceil(0.3 * count(*) OVER (PARTITION BY seed)) THEN 'test' ELSE 'train' END AS side
  FROM {name}, (VALUES {", ".join(f"({s})" for s in SEEDS)}) s(seed)),
{name}_rows AS (
  SELECT * FROM {name}_sides
  QUALIFY side = 'test' OR row_number() OVER (PARTITION BY seed, side ORDER BY md5(seed || ':train:' || k)) <= 10000)"""


def _suite_damage(name: str, category: str) -> str:
    """Damaged rows per seed, side, type and percent."""
    return f"""{name}_hits AS (
  SELECT seed, side, p, k, v FROM (
    SELECT *, row_number() OVER (PARTITION BY seed, side ORDER BY md5(seed || ':row:' || side || ':' || k)) AS r,
      count(*) OVER (PARTITION BY seed, side) AS n
    FROM {name}_rows), (VALUES {", ".join(f"({p})" for p in PERCENTS)}) t(p)
  WHERE r <= greatest(floor(p * n / 100), 1)),
{name}_values AS (SELECT DISTINCT seed, side, p, v FROM {name}_hits WHERE v IS NOT NULL),
{name}_ranks AS (
  SELECT *,
    row_number() OVER (PARTITION BY seed, side, p ORDER BY md5(seed || ':old:' || side || ':{category}:' || v)) AS a,
    row_number() OVER (PARTITION BY seed, side, p ORDER BY md5(seed || ':new:' || side || ':{category}:' || v)) AS b
  FROM {name}_values),
{name}_changed AS (
  SELECT h.seed, h.side, h.p, count(*) AS n
  FROM {name}_hits h JOIN {name}_ranks o ON h.seed = o.seed AND h.side = o.side AND h.p = o.p AND h.v = o.v
  JOIN {name}_ranks w ON w.seed = o.seed AND w.side = o.side AND w.p = o.p AND w.b = o.a
  WHERE w.v <> h.v GROUP BY ALL),
{name}_damage AS (
  SELECT seed, side, kind, p, count(*) AS n FROM {name}_hits, (VALUES ('MCAR'), ('SCAR')) t(kind) GROUP BY ALL
  UNION ALL SELECT seed, side, 'CSCAR', p, n FROM {name}_changed)"""


def _sweep_runs() -> str:
    steps, parts = [], []
    for name, key, target, category, features in SUITE:
        steps += [suite_sides(name, key, target, category), _suite_damage(name, category)]
        steps.append(f"""{name}_runs AS (
  SELECT seed, 'CLEAN_CLEAN' AS tag, 'NONE' AS kind, 0 AS p, 0 AS n FROM (SELECT DISTINCT seed FROM {name}_rows)
  UNION ALL SELECT seed, 'CLEAN_DIRTY', kind, p, sum(n) FROM {name}_damage WHERE side = 'test' GROUP BY ALL
  UNION ALL SELECT seed, 'DIRTY_DIRTY', kind, p, sum(n) FROM {name}_damage GROUP BY ALL),
{name}_facts AS (
  SELECT seed, count(*) FILTER (side = 'train') AS train_size, count(*) FILTER (side = 'test') AS test_size,
    count(DISTINCT y) FILTER (side = 'train') AS number_of_classes
  FROM {name}_rows GROUP BY seed)""")
        parts.append(f"""SELECT '{name}' AS dataset_name, seed AS random_seed, tag, kind AS error_type,
  p AS row_corruption_percent, train_size, test_size, number_of_classes, {features} AS number_of_features,
  test_size AS vectors, n::BIGINT AS damaged_rows FROM {name}_runs JOIN {name}_facts USING (seed)""")
    return "WITH " + ",\n".join(steps) + "\n" + " UNION ALL ".join(parts)


EXPECTED["sweep_runs"] = _sweep_runs()

EXPECTED["classification_sweep"] = f"""
SELECT dataset_name, random_seed, tag, error_type, row_corruption_percent, train_size, test_size, TRUE AS is_scored
FROM ({_sweep_runs()})"""
