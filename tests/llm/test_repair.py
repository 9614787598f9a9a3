"""Repair of conversations against an exhaustive search and a plain recomputation of the whole query."""

import hashlib
import random
import re
import zlib

import pyarrow.parquet as pq
from llm_helpers import DATA

from panelspark.llm.repair import repair, repaired

GRAMMAR = re.compile(r"(s?(ua)+)?")


def searched(kinds):
    """Every way of editing within a cost bound that grows until some way fits; the least audit of the cheapest."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def ways(t, state, left, audit):
        if t == len(kinds):
            if state in ("", "a"):
                yield left, audit
        else:
            role, truncated, must_go = kinds[t]
            if left >= 4:
                yield from ways(t + 1, state, left - 4, audit + "D")
            more = 3 * truncated
            if not must_go:
                if left >= more and (state, role) in step:
                    yield from ways(t + 1, step[state, role], left - more, audit + "K")
                for new in "ua":
                    if left >= more + 3 and (state, new) in step:
                        yield from ways(t + 1, new, left - more - 3, audit + "R")
        for new in "ua":
            if left >= 3 and (state, new) in step:
                yield from ways(t, new, left - 3, audit + "I")

    bound = 0
    while not (found := [a for left, a in ways(0, "", bound, "") if left == 0]):
        bound += 1
    return bound, min(found)


def test_layers_against_exhaustive_search():
    r = random.Random(5)
    for n in range(6):
        for _ in range(60 if n else 1):
            kinds = [(r.choice(["s", "u", "a", "u", "a", ""]), r.random() < 0.25, False) for _ in range(n)]
            kinds = [(role, False, True) if r.random() < 0.2 else (role, cut, False) for role, cut, _ in kinds]
            assert repaired(kinds) == searched(kinds), kinds


def plain(rows):
    """The contract step by step, with the exhaustive search replaced by repaired() (held against it above)."""
    space = " \t\n\x0b\x0c\r"
    out, by_conv = {}, {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(key.encode()) % 20
        kept = by_conv.setdefault(conv, [])
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        kept += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    for conv, own in by_conv.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, kinds, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            body = text.rstrip(space)
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else ""
            kinds.append((initial, fault == 2, fault in (0, 1)))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = repaired(kinds)
        n, t, lines = sum(c != "D" for c in audit), 0, []
        names = {"s": "system", "u": "user", "a": "assistant"}
        roles = ("s" if n % 2 else "") + "ua" * (n // 2)
        for edit in audit:
            role = names[roles[len(lines)]] if len(lines) < n else None
            if edit == "I":
                lines.append((role, ""))
                continue
            if edit != "D":
                lines.append((own[t][1] if edit == "K" else role, own[t][2]))
            t += 1
        assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in lines)) and t == len(own)
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return out


def collected(df):
    rows = df.collect()
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def test_whole_table(spark):
    rows = pq.read_table(f"{DATA}/sf0.01/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()
    assert collected(repair(spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet"))) == plain([tuple(r.values()) for r in rows])


def test_odd_rows(spark):
    r, rows = random.Random(3), []
    for conv in (None, *range(40)):
        for turn in [None, None, *range(r.randint(0, 9))]:
            rows.append((conv, turn if r.random() < 0.9 else 3, r.choice(["user", "assistant", "system", "", None, "User", "tool", "ü"]), r.choice(["Yes.", "Yes. ", "no", "", None, " \t\n", "é日本語!", "!?", " ", "a" * 5_000 + ".\x0b"])))
    rows += [rows[5], rows[6]] + [(100, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3_000)] + [(101, 7, "user", "Same.")] * 50
    df = spark.createDataFrame([(*x, "clash", 1, "clash") for x in rows], "conv_id long, turn long, role string, text string, audit string, cost int, body string")
    assert collected(repair(df)) == plain(rows)
    assert repair(df.limit(0)).count() == 0
    dropped = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    gone = repair(spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(x) for x in gone] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
