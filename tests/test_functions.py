from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from smudgelab.functions import text
from smudgelab.functions import vectors as V
from smudgelab.operators.distances import euclidean_from_reference


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_cosine_distance(spark):
    assert value(spark, V.cosine_distance(vec(1, 0), vec(0, 1))) == 1
    assert value(spark, V.cosine_distance(vec(1, 2, 3), vec(2, 4, 6))) == pytest.approx(0)
    assert value(spark, V.cosine_distance(vec(0, 0), vec(1, 1))) is None


def test_z_norm(spark):
    assert value(spark, V.z_normalize(vec(5, 5, 5))) == [0, 0, 0]
    x = np.array([1.0, 4, -2, 7])
    assert value(spark, V.z_normalize(vec(*x))) == pytest.approx(list((x - x.mean()) / x.std()))
    assert value(spark, euclidean_from_reference(vec(1, 2, 3), vec(2, 4, 6))) == pytest.approx(0)
    assert value(spark, euclidean_from_reference(vec(1, 2, 3), vec(2, 4, 6), False)) == pytest.approx(math.sqrt(14))


def test_softmax_and_argmax(spark):
    soft = value(spark, V.softmax(vec(1000, 1001, 999)))
    assert sum(soft) == pytest.approx(1) and soft[1] == max(soft)
    assert value(spark, V.argmax(vec(1, 3, 3))) == 1


@pytest.mark.parametrize(
    ("document", "rows"),
    [("[]", []), ("[4,5]", [4, 5]), ("[[1,2],[3]]", [3]), ("[ [], [7, 8] ]", [7, 8]), ("[[1]]", None)],
)
def test_test_side_rows(spark, document, rows):
    assert value(spark, text.test_side_rows(F.lit(document))) == rows


def test_names(spark):
    assert text.evaluation_name("linear_probing", "all", "task_labels") == "LP_ALL_TLGT"
    assert text.evaluation_name("distance_from_reference", "clean", metric="cosine", scenario="perfect_data") == "DFR_CLE_COS_PD"
    assert value(spark, text.joined_name("LP", None, F.lit(None).cast("string"), "X")) == "LP_X"
    assert value(spark, text.dataset_id(F.lit("OpenML-123"))) == 123
    kind, rate = text.split_type_and_rate(F.lit("SCAR_40"))
    assert (value(spark, kind), value(spark, rate)) == ("SCAR", 40)


def test_record_id_is_repeatable(spark):
    a, b = (value(spark, text.record_id(F.lit("x"), F.lit(None).cast("string"))) for _ in range(2))
    assert a == b and len(a) == 32


def test_flatten_and_encode(spark):
    nested = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)))
    assert value(spark, text.flatten_one_level(nested)) == [1, 2, 3]
    assert value(spark, text.encode_list(nested)) == "[[1,2],[3]]"
