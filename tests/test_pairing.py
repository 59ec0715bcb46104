"""What pairing.paired sends through its exchange, and what it gives for odd rows."""

import re

from convoke.operators import pairing as P

ONE, QUARTER = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [[0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [-1.0, 0.0, 0.0]]


def seen(spark, *rows):
    return spark.createDataFrame([(pair, tag, i, t, sender, main, other, r, x) for i, (pair, tag, t, sender, main, other, r, x) in enumerate(rows)], P.SIGHTINGS)


def test_a_sighting_travels_once(spark, capsys):
    rows = seen(spark, ("p", "7", 0.0, "m", "m", "o", ONE, [1.0, 2.0, 3.0]))
    P.paired(rows.repartition(3), 1.0).explain("formatted")
    sent = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning", capsys.readouterr().out)
    assert [re.sub(r"#\d+L?", "", x) for x in sent] == ["pair, tag, arrival, time, camera, own"]


def test_odd_sightings(spark):
    odd, far = [[1.0, None], None, [0.0, 0.0, 1.0, 2.0]], [0.0, 0.0, 9.0]
    rows = seen(
        spark,
        ("p", "1", 0.0, "m", "m", "o", odd, None), ("p", "1", 1.0, "third", "m", "o", QUARTER, far), ("p", "1", 2.0, "o", "m", "o", None, [1.0]),
        ("p", "1", 3.0, None, "m", "o", QUARTER, far), ("p", "1", 9.0, "m", "m", "o", ONE, far), ("p", "1", None, "o", "m", "o", ONE, far),
        ("p", "2", 0.0, "m", "m", "m", ONE, far), ("p", "2", 1.0, "m", "m", None, QUARTER, []), ("p", "2", 2.0, "o", None, "o", QUARTER, far),
        (None, "1", 0.0, "m", "m", "o", ONE, far), (None, "1", 0.0, "o", "m", "o", QUARTER, far), ("p", None, 0.0, "m", "m", "m", ONE, far),
    )
    got = {r.arrival: (r["pair"], r.tag, r.time, r.rm, r.tm, r.ra, r.ta) for r in P.paired(rows, 5.0).collect()}
    assert got == {
        2: ("p", "1", 2.0, odd, None, None, [1.0]), 3: ("p", "1", 3.0, odd, None, None, [1.0]),
        6: ("p", "2", 0.0, ONE, far, ONE, far), 7: ("p", "2", 1.0, QUARTER, [], ONE, far), 8: ("p", "2", 2.0, QUARTER, [], QUARTER, far),
        10: (None, "1", 0.0, ONE, far, QUARTER, far), 11: ("p", None, 0.0, ONE, far, ONE, far),
    }
    assert P.paired(rows.limit(0), 5.0).collect() == []
