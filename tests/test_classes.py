"""Classes of equal members are multiplied out last, in packs, and no pair of them is shuffled."""

from __future__ import annotations

import random

from forkline.operators import graph, relations
from forkline.session import bucketed


def test_class_pairs_over_packs(spark, monkeypatch):
    monkeypatch.setattr(relations, "PACK", 7)
    members = spark.createDataFrame([(k % 3, k) for k in range(90)], "class long, member long")
    met = spark.createDataFrame([(0, 0), (0, 1)], "a_class long, b_class long")
    wanted = {(a, b) for a in range(0, 90, 3) for b in range(90) if b % 3 in (0, 1)}
    found = [tuple(p) for p in relations.class_pairs(members, met).collect()]
    assert len(found) == len(wanted) and set(found) == wanted


def test_equal_boxes_meet_as_one(spark, monkeypatch):
    rng, rows = random.Random(4), []
    for k in range(120):
        x, y = rng.randrange(6), rng.randrange(6)
        rows.append((k, float(x), float(y), x + 1.5, y + (0.0 if k % 10 == 0 else 2.5)))  # flat ones overlap with nothing, nor with their like
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    over = lambda a, b: a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]
    wanted = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and over(a, b))
    met = []
    monkeypatch.setattr(relations, "class_pairs", lambda members, pairs, f=relations.class_pairs: (met.append(pairs.count()), f(members, pairs))[1])
    assert sorted(tuple(p) for p in relations.rect_overlap(df, 5.0).collect()) == wanted
    assert len(met) == 2 and sum(met) < len(wanted)  # classes met, not boxes


def test_equal_sets_are_tried_once(spark, monkeypatch):
    rng = random.Random(5)
    sets = {k: {rng.choice("abcd") for _ in range(rng.randrange(1, 4))} | ({None} if k % 9 == 0 else set()) for k in range(150)}
    df = spark.createDataFrame([(k, m) for k, s in sets.items() for m in s] + [(None, "a")], "owner long, item string")
    wanted = sorted((a, b) for a in sets for b in sets if a != b and None not in sets[a] and sets[a] <= sets[b])
    met = []
    monkeypatch.setattr(relations, "class_pairs", lambda members, pairs, f=relations.class_pairs: (met.append(pairs.count()), f(members, pairs))[1])
    assert sorted(tuple(p) for p in relations.subset_join(df, "owner", "item").collect()) == wanted
    assert met[0] <= 30 * 30 < len(wanted)


def test_mutual_reach_needs_no_closure(spark, monkeypatch):
    from forkline.plans import graph_queries

    monkeypatch.setattr(graph, "transitive_closure", None)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6)], "src long, dst long")
    monkeypatch.setattr(graph_queries, "successions", lambda *_: edges)
    assert sorted(tuple(p) for p in graph_queries.scc_mutual_reach(spark, "").collect()) == [(1, 2), (1, 3), (2, 3), (4, 5)]


def test_bucketed_rows_stay_where_they_are(spark):
    rows = bucketed(spark.range(100).selectExpr("id % 7 AS k", "id"), "k")
    grouped = rows.groupBy("k").count()
    assert sorted(tuple(r) for r in grouped.collect()) == [(k, 15 if k < 2 else 14) for k in range(7)]
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()


def test_hidden_paths_stop_where_all_is_met(spark, monkeypatch):
    """1 and 2 are all that is shown of theirs and meet over 11 at once; a long hidden tail behind is not walked."""
    tail = [(11, 12)] + [(k, k + 1) for k in range(12, 19)]
    both = [(1, 11), (11, 2), (2, 11), (11, 1), *tail]
    other = [(3, 31), (31, 32), (32, 4), (3, 33), (33, 34), (34, 4)]  # 3 meets 4 after two hidden nodes, the lesser text; 4 never meets 3
    written = []
    monkeypatch.setattr(graph, "materialised", lambda df, f=graph.materialised: (written.append(df.columns), f(df))[1])
    edges = spark.createDataFrame(both + other, "src long, dst long")
    found = graph.hidden_paths(edges, spark.createDataFrame([(1,), (2,), (3,), (4,)], "node long"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, 1, "11"), (2, 1, 1, "11"), (3, 4, 2, "31,32")]
    assert sum(c == ["src", "at", "path"] for c in written) <= 3  # the first, the second and an empty one


def test_no_pair_of_a_class_is_made_in_vain(spark, monkeypatch):
    monkeypatch.setattr(relations, "PACK", 7)
    members = spark.createDataFrame([(k % 3, (k * 37) % 90) for k in range(90)] + [(9, 1000)], "class long, member long")
    packs = relations.packed(members).orderBy("class", "pack").collect()
    for c in (0, 1, 2, 9):
        arrays = [r.members for r in packs if r["class"] == c]
        assert all(len(a) <= 7 for a in arrays) and sum(arrays, []) == sorted(sum(arrays, []))  # packs of a class do not overlap
    made, multiplied = [], relations._multiplied
    monkeypatch.setattr(relations, "_multiplied", lambda facing: (made.append(multiplied(facing)), made[-1])[1])
    found = sorted(tuple(p) for p in relations.member_pairs(members).collect())
    of = {(k * 37) % 90: k % 3 for k in range(90)}
    assert found == [(a, b) for a in range(90) for b in range(a + 1, 90) if of[a] == of[b]]
    assert made[0].where("a >= b").isEmpty()
