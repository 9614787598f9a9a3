from llm_helpers import SCHEMA, by_id, prose, row

from panelspark.llm import licenses as li


def test_planted_notices_are_found(spark):
    rows, want = [], {}
    for i, (name, text) in enumerate(sorted(li.TEMPLATES.items())):
        rows.append((i, prose(i, 37) + " " + text.upper() + " " + prose(50 + i, 61)))
        want[i] = name
    words = li.TEMPLATES["MIT"].split()
    words[20] = "edited"
    rows += [(900, prose(1, 300)), (901, prose(2, 9) + " " + " ".join(words)), (902, "Licensed under the Apache License, Version 3.0. " + prose(3, 5))]
    got = by_id(li.scan(spark.createDataFrame([row(d, t) for d, t in rows], SCHEMA)).collect())
    for i, name in want.items():
        r = got[i][0]
        assert name in r.licenses, name
        m = next(m for m in r.matches if m.license == name)
        n = len(li.word_hashes([li.TEMPLATES[name]])[0])
        assert m.containment == 1.0 and (m.first, m.past) == (37, 37 + n)
    assert got[900][0].n_matches == 0 and got[901][0].licenses == ["MIT"] and "Apache-2.0-notice" not in got[902][0].licenses


def test_odd_documents(odd, odd_rows, empty):
    got = li.scan(odd).collect()
    assert len(got) == len(odd_rows) and all(r.n_matches == 0 and r.licenses == [] for r in got) and li.scan(empty).count() == 0


def test_brute_force(spark):
    """Every run of a template's words at 80 % is retrieved by its bands."""
    known = li.Templates(li.TEMPLATES)
    import numpy as np

    for t, name in enumerate(known.names):
        words = li.TEMPLATES[name].split()
        text = prose(7, 50) + " " + " ".join(words) + " " + prose(8, 50)
        h, owner = li.shingles(*li.word_hashes([text]), li.SHINGLE)
        assert any(m[1] == t for m in known.matches(h, owner)), name
        assert np.isin(h, known.sets[t]).sum() >= 0.8 * len(known.sets[t])
