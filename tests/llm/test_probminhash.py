import numpy as np
from llm_helpers import by_id, prose, row, SCHEMA

from panelspark.llm import linking, probminhash as pm
from panelspark.llm.words import counted, shingles, word_hashes


def sets(text):
    h, _, w = counted(*shingles(*word_hashes([text]), 5))
    return h, w


def brute(ha, wa, hb, wb):
    a, b = dict(zip(ha.tolist(), wa.tolist())), dict(zip(hb.tolist(), wb.tolist()))
    keys = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in keys) for d in a.keys() & b.keys())


def test_probability_jaccard_equals_its_definition():
    one = prose(1, 60) + " " + " ".join(["again and again it goes on"] * 4)
    other = one.replace("again", "once", 3) + prose(2, 20)
    x, y = sets(one), sets(other)
    assert abs(pm.probability_jaccard(*x, *y) - brute(*x, *y)) < 1e-12 and abs(pm.probability_jaccard(*x, *x) - 1) < 1e-12


def test_signatures_agree_as_often_as_they_should():
    one, other = prose(1, 200), prose(1, 150) + " " + prose(2, 50)
    x, y = sets(one), sets(other)
    n = 4000
    who = pm.signatures(np.concatenate([x[0], y[0]]), np.repeat([0, 1], [len(x[0]), len(y[0])]), np.concatenate([x[1], y[1]]), 2, n)
    assert abs((who[0] == who[1]).mean() - pm.probability_jaccard(*x, *y)) < 4 * (0.25 / n) ** 0.5


def brute_classes(rows):
    found = {}
    for d, t in rows:
        found.setdefault(d, t)
    ids = sorted(found)
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    s = {d: sets(found[d]) for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if pm.probability_jaccard(*s[a], *s[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


def edited(text, places):
    w = text.split()
    for p in places:
        w[p] = f"edit{p}"
    return " ".join(w)


def test_classes_equal_brute_force(spark, odd):
    rows = [(100 + i, edited(prose(9, 200), [(i * 7) % 200] if i % 2 else [])) for i in range(12)]
    rows += [(200 + i, edited(prose(10, 120), range(0, i))) for i in range(6)] + [(300 + i, prose(20 + i, 90)) for i in range(10)]
    rows += [(d, t) for d, t in ((r.doc_id, r.text) for r in odd.collect()) if d is not None and d != 4] + [(4, prose(1, 60))]
    df = spark.createDataFrame([row(d, t) for d, t in rows], SCHEMA)
    got = {r.doc_id: r.class_id for r in pm.near_duplicates(df).collect()}
    assert got == brute_classes(rows)


def test_odd_documents(odd, odd_rows, empty):
    got = by_id(pm.near_duplicates(odd).collect())
    assert sum(map(len, got.values())) == len(odd_rows)
    assert {got[d][0].class_id for d in (1, 2, 9, 13)} == {1} and got[5][0].class_id == 4 and got[5][0].copy_of == 4 and got[6][0].class_id == 4 and got[8][0].class_id == 7
    assert pm.near_duplicates(empty).count() == 0
    kept = pm.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == [1, 3, 4, 7, 10, 11, 12, 14]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(129, 200)]
    got = {r.id: r.root for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[200] == 100 and got[115] == 100


def test_groups_without_a_common_leader(spark):
    """Members alike among themselves but not like the least one are found, by leaders in turn as by all pairs."""
    ids = list(range(40))
    members = spark.createDataFrame([(1, i) for i in ids] + [(2, i) for i in ids if i % 2], "grp long, id long")
    alike = lambda pairs: pairs.where("a > 0 AND pmod(a, 5) = pmod(b, 5)")
    for enough in (1_000_000, 0):
        got = {r.id: r.root for r in linking.linked(members, alike, enough=enough).collect()}
        assert got == {i: (i % 5 or 5) for i in ids if i}


def test_links_of_rows_without_an_id_and_of_repeated_ids(spark):
    """A near copy under a null id has its class; each text of an id that has several is a document of its own."""
    one, other, third = prose(1, 200), prose(2, 200), prose(3, 200)
    near = one.replace(one.split()[100], "changed", 1)
    like = other.replace(other.split()[50], "different", 1)
    df = spark.createDataFrame([(1, one), (None, near), (7, like), (7, third), (8, other), (None, prose(4, 90)), (9, prose(5, 90))], "doc_id long, text string")
    got = {}
    for r in pm.classified(df).collect():
        got.setdefault(r.doc_id, []).append(r.class_id)
    assert got[1] == [1] and 1 in got[None] and got[9] == [9]
    apart = [c for c in got[7] if c != got[8][0]]
    assert got[8][0] in got[7] and len(apart) == 1 and len(got[None]) == 2 and len({*got[None], *got[7], 9}) == 5
    assert pm.classified(df.limit(0)).count() == 0


def test_rounds_pass_on_the_members_outside_alone(spark, monkeypatch):
    """One large group of few links, and groups that share its members: what all rounds write does not grow with their number, no pair is verified twice."""
    ids = list(range(60))
    members = spark.createDataFrame([(g, i) for g in range(1, 3) for i in ids if g == 1 or i % g], "grp long, id long")
    own, written, pairs = linking.stored, {}, []

    def stored(df, tag):
        out = own(df, tag)
        written[tag] = written.get(tag, 0) + out[1]
        return out

    def alike(some):
        pairs.extend((r.a, r.b) for r in some.collect())
        return some.where("a % 3 <> 0 AND pmod(a, 20) = pmod(b, 20)")

    monkeypatch.setattr(linking, "stored", stored)
    got = {r.id: r.root for r in linking.linked(members, alike).collect()}
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids[:i]:
            if j % 3 and (j - i) % 20 == 0:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    assert got == {i: root(i) for i in ids if any(root(j) == root(i) for j in ids if j != i)}
    assert len(pairs) == len(set(pairs)) and written["rooted"] <= 2 * written["members"]
