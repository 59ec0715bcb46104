"""How rotate_movement and translate_movement are planned, and what they give for odd rows."""

import math
import re

import pytest

from convoke.operators import motion

ONE, QUARTER = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [[0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [-1.0, 0.0, 0.0]]
ROTATIONS = "bucket string, badge string, segment_start_time double, r array<array<double>>, event_id long"


def rotations(spark, *rows):
    return spark.createDataFrame([(bucket, badge, None if t is None else float(t), r, i) for i, (bucket, badge, t, r) in enumerate(rows)], ROTATIONS)


@pytest.mark.parametrize("clip", [False, True])
def test_turns_are_compiled(spark, capsys, clip):
    # The JVM doesn't compile a method of over 8,000 bytes; it had 22,372 where each use of a cofactor found it anew.
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        motion.rotate_movement(rotations(spark, ("s", "1", 0, ONE)), clip).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("clip", [False, True])
def test_turns_of_odd_rows(spark, clip):
    rows = rotations(
        spark,
        ("s", "1", 0, ONE), ("s", "1", 1, QUARTER), ("s", "1", 1, ONE), ("s", "1", None, QUARTER),
        ("s", "2", 0, ONE), ("s", "2", 1, None), ("s", "2", 2, QUARTER), ("s", "2", 3, ONE),
        ("s", "3", 0, QUARTER), ("s", "3", 1, [[None, 0.0, 1.0], [0.0, 1.0, 0.0], [-1.0, 0.0, None]]),
        ("s", "4", 0, None), ("s", "5", 0, [[0.0] * 3] * 3), ("s", "5", 1, ONE),
        (None, "1", 0, ONE), (None, "1", 1, QUARTER), ("s", None, 0, QUARTER), ("s", None, 1, ONE),
    )
    got = {(r.bucket, r.badge): round(r.movement, 6) for r in motion.rotate_movement(rows, clip).collect()}
    # A time that is null comes first; what follows a null, and what a matrix without an inverse or a cell gives, adds nothing.
    assert got == {("s", "1"): 270, ("s", "2"): 90, ("s", "3"): 0, ("s", "4"): 0, ("s", "5"): 0, (None, "1"): 90, ("s", None): 90}


def test_noise(spark):
    more = [[1.0 + 1e-9, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = rotations(spark, ("s", "1", 0, ONE), ("s", "1", 1, more))
    assert math.isnan(motion.rotate_movement(rows).first().movement) and motion.rotate_movement(rows, True).first().movement == 0
    assert motion.rotate_movement(rows.limit(0)).collect() == []
