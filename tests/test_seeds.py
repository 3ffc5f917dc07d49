"""Pruning around seed sockets under four rules against plain sets."""

import random
from collections import defaultdict

from spanlight.operators import joins as J


def test_rules_in_one_expansion(spark):
    rng = random.Random(2)
    nodes, edges = [], []
    for case in ("a", "b", "c", "no seed"):
        for i in range(25):
            socket = i % 3 == 0
            match = lambda p: int(socket and case != "no seed" and rng.random() < p)
            nodes.append((case, f"n{i}", "socket" if socket else "process", "" if socket else str(100 + i // 2), int(not socket and rng.random() < 0.1), match(0.2), match(0.3)))
        edges += [(case, f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(22)]
    got = {(r.case_id, r.rule): tuple(r)[2:] for r in J.seed_pruning(spark.createDataFrame(nodes, "case_id string, id string, kind string, pid string, label int, address_match int, port_match int"), spark.createDataFrame(edges, "case_id string, u string, v string")).collect()}
    assert len(got) == 16
    for case in {n[0] for n in nodes}:
        mine = {n[1]: n for n in nodes if n[0] == case}
        near = defaultdict(set)
        for c, u, v in edges:
            if c == case:
                near[u].add(v)
                near[v].add(u)
        pids = {n[3] for n in mine.values() if n[2] == "process" and n[4] and n[3]}
        for rule, ok in {"joint": lambda a, p: a and p, "address": lambda a, p: a, "port": lambda a, p: p, "either": lambda a, p: a or p}.items():
            seeds = {i for i, n in mine.items() if n[2] == "socket" and ok(n[5], n[6])}
            kept = set(seeds)
            for _ in range(2):
                kept |= {v for u in kept for v in near[u]}
            kept = kept if seeds else set(mine)
            assert got[case, rule] == (len(seeds), 25, len(kept), int(bool(pids)), int(bool(pids & {mine[i][3] for i in kept})))
