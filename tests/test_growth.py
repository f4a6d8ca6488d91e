"""Steps that once grew faster than their input, or went wrong beyond the small tables."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrum.functions import columns as L
from lodestrum.functions import physics as P
from lodestrum.operators import coincidence, intervals
from lodestrum.plans import catalog, conditioning, extended, files, further, parameters, ranking, selection, statistics  # noqa: F401
from lodestrum.sources import files as S

DAY = 86_400_000_000


def against_sql(spark, folder, name, **tables):
    """Rows of a query over small tables given as SQL, and those of its own SQL."""
    duck = duckdb.connect()
    for t, sql in tables.items():
        duck.sql(f"COPY ({sql}) TO '{folder}/{t}.parquet'")
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    d = catalog.QUERIES[name](spark, str(folder))
    plain = lambda v: round(float(v), 6) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else v
    rows = lambda x: sorted(([plain(v) for v in r] for r in x), key=str)
    want = duck.sql(catalog.ORACLES[name]).project(",".join(f'"{c}"' for c in d.columns)).fetchall()
    return str(rows(d.collect())), str(rows(want))


def events(rows):
    """SQL of an events table of (id, seconds, user, type, value)."""
    values = ", ".join(f"({i}, {t}, {u}, '{k}', {v}::DOUBLE)" for i, t, u, k, v in rows)
    return f"SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(t::BIGINT * 1000000) AS ts, u::BIGINT AS user_id, k AS event_type, v AS value, '{{}}' AS props FROM (VALUES {values}) x(i, t, u, k, v)"


def test_redshift_of_distance_in_few_steps(spark):
    z = [0.0, 1e-6, 0.05, 0.4, 1.0, 2.5, 6.0, 9.99]
    d = spark.createDataFrame([(x,) for x in z], "z double").select("z", P.luminosity_distance(F.col("z")).alias("d"))
    for x, got in d.select("z", P.redshift(F.col("d"))).collect():
        assert got == pytest.approx(x, abs=1e-10)
    far, none = spark.createDataFrame([(1e6,), (None,)], "d double").select(P.redshift(F.col("d"))).collect()
    assert far[0] == pytest.approx(10.0) and none[0] is None
    # Eight steps of a batch take a second or two; 44 halvings of each row took minutes.
    began = time.monotonic()
    spark.range(0, 400_000, 1, 8).select(P.luminosity_distance(F.col("id") / 160_000).alias("d")).select(F.sum(P.redshift(F.col("d")))).collect()
    assert time.monotonic() - began < 40


def test_chunks_of_long_segments(spark, tmp_path):
    """From the sixth chunk on a place in microseconds is beyond an int."""
    got, want = against_sql(spark, tmp_path, "overlapping_chunks", events=events([(1, 5, 0, "signup", 201), (2, 6, 1500, "signup", 300), (3, 7, 9000, "signup", 250), (4, 8, 60_000, "signup", 260), (5, 9, 450, "signup", 400)]))
    assert got == want


def test_every_fourth_event_and_the_first_third(spark, tmp_path):
    rows = [(1, 0, 7, "click", 1), (2, 60, 7, "view", 2), (4, 90, 7, "purchase", 3), (3, 95, 7, "purchase", 4), (9, 30, 7, "signup", 5), (8, 99, 7, "signup", 6), (7, 20_000, 7, "signup", 7), (6, 50, 8, "signup", 8)]
    got, want = against_sql(spark, tmp_path, "four_way_coincidence", events=events(rows))
    assert got == want and got.count("[") == 3


def test_reduced_clusters_weigh_ids(spark, tmp_path):
    """Ids 10,000 apart outweigh a hundredth of the value."""
    rows = [(1, 10, 5, "click", 3.25), (20_000, 20, 5, "click", 3.26), (2, 30, 6, "view", 3.25), (9_000, 40, 6, "view", 3.26), (3, 50, 6, "view", 1.0)]
    got, want = against_sql(spark, tmp_path, "reduced_clusters", events=events(rows))
    assert got == want


def test_spherical_angles_beyond_a_turn(spark, tmp_path):
    """Angles of several turns, a polar one beyond half a turn, and a length of 0."""
    rows = [(i, i, u, "view", v) for i, (u, v) in enumerate([(0, 0.0), (340, 0.0), (628, 12.5), (629, 12.5), (1500, 99.99), (9000, 560.21), (89_999, 700.5), (314, 628.31), (315, 628.32), (77, 1300.25), (1, 3.0), (2, 511.0)])]
    got, want = against_sql(spark, tmp_path, "scalar_conversions", events=events(rows))
    assert got == want


def test_logit_at_and_beyond_its_ends(spark, tmp_path):
    rows = [(i, i, 1, "view", v) for i, v in enumerate([0.0, 0.01, 250.0, 499.99, 500.0, 500.01, 560.21])]
    got, want = against_sql(spark, tmp_path, "transforms_and_priors", events=events(rows))
    assert got == want and "-inf" in got and "nan" in got
    assert spark.createDataFrame([(None,)], "x double").select(L.logit(F.col("x"), 0, 500)).first()[0] is None


def test_single_stands_where_a_coincidence_adds_nothing(spark, tmp_path):
    """Left open by the SQL; an event whose partner has no size is a single, whatever the order of the rows."""
    rows = [(i, 10 * i, i // 2, "click" if i % 2 else "view", 3.25 * i if i % 2 else 0.0) for i in range(400)]
    events_ = duckdb.connect()
    events_.sql(f"COPY ({events(rows)}) TO '{tmp_path}/events.parquet'")
    got = catalog.QUERIES["best_coincidence"](spark, str(tmp_path)).collect()
    assert len(got) == 200 and {r["combo"] for r in got} == {"a"}


def test_most_shared_without_pairs(spark):
    """Intervals of any lengths with many equals, in small and large blocks, against all pairs; and no join of pairs in the plan."""
    rng = np.random.default_rng(3)
    make = lambda n, longest: [(int(i), int(s), int(s + w)) for i, s, w in zip(rng.permutation(n), rng.integers(0, 300, n), rng.integers(0, longest, n), strict=True)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, start long, end long")
    for n, longest, other in ((150, 30, 12), (150, 60, 60), (150, 10, 40), (8, 40, 5)):
        a, b = make(150, longest), make(n, other)
        want = {}
        for i, s, e in a:
            near = [(min(e, y) - max(s, x), -x, -k) for k, x, y in b if min(e, y) > max(s, x)]
            if near:
                want[i] = (-max(near)[2], max(near)[0])
        for block in (7, 50, 10_000):
            d = intervals.most_shared(frame(a), frame(b), block=block)
            assert {r["id"]: (r["other"], r["shared"]) for r in d.collect()} == want
    assert "Join" not in d._jdf.queryExecution().executedPlan().toString()


def test_utc_times_take_each_step_once(spark):
    """The seconds of a row were once written out at every leap second of every leap second."""
    plan = catalog.QUERIES["utc_times"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("timestampdiff(") <= 2


def test_xml_documents_of_many_rows(spark):
    """20,000 rows of one document, a column left out and one that is not there; a document without rows. Once each row took the whole document apart."""
    head = '<Doc><Table Name="sngl:table"><Column Name="sngl:event" Type="int_8s"/><Column Name="sngl:name" Type="lstring"/><Column Name="sngl:snr" Type="real_8"/><Stream Name="sngl:table" Delimiter=",">'
    text = lambda n: head + ",\n".join(f'{i},"s {i}",{i / 4}' for i in range(n)) + "</Stream></Table></Doc>"
    d = spark.createDataFrame([(text(20_000),), (text(0),)], "value string").coalesce(1)
    began = time.monotonic()
    got = d.select(F.explode(S.xml_rows(F.col("value"), "sngl", {"snr": "double", "event": "bigint", "none": "string"})).alias("x")).select("x.*").collect()
    assert time.monotonic() - began < 30
    assert [tuple(r) for r in got] == [(i / 4, i, None) for i in range(20_000)]


def test_loudest_near_without_pairs(spark):
    """Windows of any width with many equals, against all pairs; and no join in the plan."""
    rng = np.random.default_rng(5)
    make = lambda n: [(int(i), int(t), float(s), int(k)) for i, t, s, k in zip(rng.permutation(n), rng.integers(0, 300, n), rng.integers(0, 5, n), rng.integers(0, 2, n), strict=True)]
    a, b = make(120), make(150)
    frame = lambda rows: spark.createDataFrame(rows, "id long, t long, stat double, k long")
    for w in (1, 3, 10, 1000):
        want = {}
        for i, t, _, k in a:
            near = [(s, -j, u - t) for j, u, s, key in b if key == k and abs(u - t) <= w]
            if near:
                want[i] = (-max(near)[1], max(near)[0], max(near)[2])
        d = coincidence.loudest_near(frame(a), frame(b), w, "k")
        assert {r["id"]: (r["best"], r["stat"], r["apart"]) for r in d.collect()} == want
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(d) and "Join" not in plan(catalog.QUERIES["injection_followup"](spark, "/root/testdata/sf0.001"))
