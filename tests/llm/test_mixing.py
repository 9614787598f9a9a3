import re

from llm_helpers import SCHEMA, prose, row

from panelspark.llm import mixing as mx


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * sizes[s] + 1e-9]
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def documents(spark):
    rows, i = [], 0
    for k, (source, n) in enumerate([("b", 90), ("a", 10), (None, 25), ("é", 60), ("Z", 3), ("hot", 400)]):
        for _ in range(n):
            rows.append(row(i, prose(i, 5 + (i * 37) % 200), source))
            i += 1
    return rows + [row(i, None, "b"), row(i + 1, "", "nothing"), row(i + 2, " \n", "nothing"), row(None, "of no id at all", "a"), row(3, rows[3][1], "b")]


def test_targets_and_takings(spark):
    rows = documents(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mx.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source: dict = {}
    for d, t, _, s, *_ in rows:
        by_source[s] = by_source.get(s, 0) + size(t)
    want = brute_targets(by_source)
    assert len(got) == len(rows)
    taken: dict = {}
    source = {(d, size(t)): s for d, t, _, s, *_ in rows}
    for r in got:
        s = source[(r.doc_id, r.size)]
        assert r.source_size == by_source[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 2 * mx.BLOCK), (s, taken[s], t)
    again = mx.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_sainte_lague_equals_highest_quotients(spark):
    votes = {"p": [53, 24, 23, 1, 7], "q": [10, 10, 10], "r": [1000, 3, 2]}
    seats = {"p": 17, "q": 5, "r": 40}
    most = {"p": 30, "q": 2, "r": 38}
    df = spark.createDataFrame([(k, i, v, seats[k], most[k]) for k, vs in votes.items() for i, v in enumerate(vs)], "k string, i int, v long, s long, m long")
    got = {(r.k, r.i): r.quota for r in mx.sainte_lague(df, ["k"], "v", "s", "m", "i").collect()}
    for k, vs in votes.items():
        won = [0] * len(vs)
        for _ in range(seats[k]):
            best = max((v / (2 * won[i] + 1), -i) for i, v in enumerate(vs) if won[i] < most[k])
            won[-best[1]] += 1
        assert [got[(k, i)] for i in range(len(vs))] == won, k


def test_sainte_lague_of_skewed_votes(spark):
    for votes, seats in (([4000, *[1000] * 6], 1000), ([4001, 1003, 997, 50, 3, 3], 877)):
        df = spark.createDataFrame([("x", i, v, seats, 5000) for i, v in enumerate(votes)], "k string, i int, v long, s long, m long")
        won = [0] * len(votes)
        for _ in range(seats):
            best = max((v / (2 * won[i] + 1), -i) for i, v in enumerate(votes))
            won[-best[1]] += 1
        assert [r.quota for r in mx.sainte_lague(df, ["k"], "v", "s", "m", "i").orderBy("i").collect()] == won


def test_mixed_texts(spark):
    rows = [r for r in documents(spark) if r[0] is not None][:-1]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = {r.doc_id: r.taken for r in mx.mix(df).collect()}
    words: dict = {}
    text = {r[0]: r[1] for r in rows}
    for r in mx.mixed_texts(df).collect():
        got = r.text.split()
        words[r.doc_id] = words.get(r.doc_id, 0) + len(got)
        assert r.text == text[r.doc_id] or set(got) <= set(text[r.doc_id].split())
    assert words == {d: n for d, n in taken.items() if n}


def test_empty_table(empty):
    assert mx.mix(empty).count() == 0 and mx.mixed_texts(empty).count() == 0


def test_blocks_are_not_broadcast(spark):
    """The blocks grow with the words of all documents: no side of their join goes whole through the driver."""
    df = spark.createDataFrame([row(i, prose(i, 300), "ab"[i % 2]) for i in range(20)], SCHEMA)
    for out in (mx.mix(df), mx.pieces(*mx.plan(df))):
        joins = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "block" in line.split("Inner")[0]]
        assert joins and not any("Broadcast" in line for line in joins), joins
