"""Clusters of nodes against plain loops in whole numbers."""

import hashlib
import math
import random

from mediacat.llm import centroids as C


def by_hand(rows, components, clusters, rounds, scale=1024, seed=3):
    sound = [
        (i, [math.floor(scale * x) for x in v]) for i, v in rows
        if v is not None and len(v) == components and all(x is not None and math.isfinite(x) and abs(x * scale) < C.LARGEST for x in v)
    ]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), b"".join(x.to_bytes(4, "little", signed=True) for x in r[1]))
    middles = [v for _, v in sorted(sound, key=key)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(middles))

    for _ in range(rounds):
        owner = [nearest(v)[1] for _, v in sound]
        for j in range(len(middles)):
            own = [v for (_, v), o in zip(sound, owner) if o == j]
            if own:
                middles[j] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *nearest(v)) for i, v in sound]
    per = {j: sum(d for _, d, o in out if o == j) for j in range(len(middles))}
    return sorted(((i, j, d, per[j], sum(per.values()), tuple(middles[j])) for i, d, j in out), key=repr)


def found(df):
    return sorted(((r.node_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect()), key=repr)


def test_against_plain_loops(spark):
    rng = random.Random(2)
    middles = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in middles[i % 5]]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(400, 460)] + [(5, rows[7][1]), (5, rows[7][1]), (None, [0.25] * 6)]
    odd = [(500, None), (501, []), (502, [1.0] * 5), (503, [float("nan")] * 6), (504, [None] + [1.0] * 5), (505, [float("inf")] * 6), (506, [1e30] * 6)]
    table = spark.createDataFrame([(i, v, 3, 4) for i, v in rows + odd], "node_id bigint, speeds array<double>, cluster int, distance int").repartition(5)
    for clusters, rounds in ((4, 3), (8, 10), (1, 1), (3, 0)):
        got = found(C.cluster_speeds(table, components=6, clusters=clusters, rounds=rounds))
        assert got == by_hand(rows + odd, 6, clusters, rounds)


def test_few_and_none(spark):
    schema = "node_id bigint, speeds array<double>"
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.0, 0.0])], schema)
    assert found(C.cluster_speeds(table, components=2)) == by_hand([tuple(r) for r in table.collect()], 2, 8, 10)
    none = C.cluster_speeds(table, components=3)
    assert none.count() == 0 and none.columns == ["node_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_nodes_of_the_project(spark):
    nodes = spark.createDataFrame(
        [(1, {"hevc_nvenc": 300.0, "libx265": 30.0}), (2, {"hevc_nvenc": 290.0}), (3, {"libx265": 28.0}), (4, None)], "id bigint, benchmarks map<string,double>"
    )
    speeds = C.speed_vectors(nodes, ["hevc_nvenc", "libx265"])
    assert [list(r.speeds) for r in speeds.orderBy("node_id").collect()] == [[300.0, 30.0], [290.0, 0.0], [0.0, 28.0], [0.0, 0.0]]
    groups = {r.node_id: r.cluster for r in C.cluster_speeds(speeds, components=2, scale=1, clusters=2, rounds=5).collect()}
    assert groups[1] == groups[2] != groups[3] == groups[4]
