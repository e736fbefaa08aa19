import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from docloom.llm import conversation_repair as cr
from docloom.llm.conversation_repair import CONVERSATION, Chart, Grammar
from tests.conftest import DATA

WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired lines) by trying every sequence of edits; rows are (role, text, must be deleted, cut off)."""
    best = [(4 * len(rows) + 1, "", [])]

    def go(i, state, cost, audit, lines):  # state: b(egin), s, u, a
        if (cost, audit) >= best[0][:2] and cost >= best[0][0]:
            return
        if i == len(rows) and state in "ba" and (cost, audit) < best[0][:2]:
            best[0] = cost, audit, lines
        wants = "u" if state in "bsa" else "a"
        name = {"u": "user", "a": "assistant"}[wants]
        if cost + 3 <= best[0][0]:
            go(i, wants, cost + 3, audit + "I", [*lines, f"{name}:"])
        if i < len(rows):
            role, text, must, cut = rows[i]
            go(i + 1, state, cost + 4, audit + "D", lines)
            if not must:
                first = role[:1]
                if first == wants or (first == "s" and state == "b"):
                    go(i + 1, first, cost + 3 * cut, audit + "K", [*lines, f"{role}:{text}"])
                if first != wants:
                    go(i + 1, wants, cost + 3 + 3 * cut, audit + "R", [*lines, f"{name}:{text}"])

    go(0, "b", 0, "", [])
    return best[0]


def plain(rows):
    """Contract rows by conversation, step by step; rows are (conv_id, turn, role, text)."""
    groups = {}
    for c, t, role, text in rows:
        out = groups.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(t is not None, t or 0, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    result = []
    for c, g in groups.items():
        g.sort()
        seen, faults, given = set(), [0, 0, 0, 0], []
        for _, _, role, text in g:
            ink = text.rstrip(WHITE)
            f = 1 if not ink else 2 if (role, text) in seen else 3 if ink[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[f] += 1
            given.append((role, text, f in (1, 2), f == 3))
        turns = {t for has, t, _, _ in g if has}
        first = [r[2][:1] for r in g]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(first, first[1:], strict=False))
        cost, audit, lines = cheapest(given)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        result.append((c, gaps, *faults[1:], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(result, key=str)


ROLES = ["user", "assistant", "system", "u", "", "tool", "sys", " "]


@pytest.mark.parametrize("seed", range(300))
def test_chart_is_the_cheapest(seed):
    r = random.Random(seed)
    rows = [(r.choice(ROLES[: r.choice([3, 8])]), f"t{i}", r.random() < 0.2, r.random() < 0.2) for i in range(r.randint(0, 6))]
    edits = list(cr.repaired(rows, CONVERSATION))
    cost, audit, lines = cheapest(rows)
    assert (edits[-1][3], "".join(e[0] for e in edits)) == (cost, audit)
    kept = [f"{role}:{text}" for e, role, text, c in edits if c < 0 and e != "D"]
    assert kept == lines and re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in kept))


@pytest.mark.parametrize("slack", [4, None])
def test_long_conversation_settles_as_it_goes(slack):
    """Equal to dynamic programming over the grammar's states, with few edits held at a time."""
    r = random.Random(7)
    rows = [(r.choice(["user", "assistant", "assistant", "user", "system"]), "", r.random() < 0.05, r.random() < 0.1) for _ in range(3000 if slack else 250)]
    g = Grammar(CONVERSATION.start, CONVERSATION.productions, CONVERSATION.roles, slack=slack)
    chart, audit, most = Chart(g), [], 0
    for role, _, must, cut in rows:
        audit += [e.edit for e in chart.take(role[0], must, cut)]
        most = max(most, chart.read - len(audit))
        assert sum(map(len, chart.columns.values())) < 40
    cost, rest = chart.done()
    audit = "".join(audit) + "".join(e.edit for e in rest)
    assert slack is None or most < 300
    step = {"b": "u", "s": "u", "a": "u", "u": "a"}
    states = {"b": (0, "")}

    def inserted(states):
        for _ in range(3):
            for st, (c, x) in list(states.items()):
                to = step[st]
                states[to] = min(states.get(to, (10**9, "")), (c + 3, x + "I"))
        return states

    for role, _, must, cut in rows:
        new = {}
        for st, (c, x) in inserted(states).items():
            ways = [(st, c + 4, x + "D")]
            if not must:
                if role[0] == step[st] or (role[0] == "s" and st == "b"):
                    ways.append((role[0], c + 3 * cut, x + "K"))
                if role[0] != step[st]:
                    ways.append((step[st], c + 3 + 3 * cut, x + "R"))
            for to, c2, x2 in ways:
                new[to] = min(new.get(to, (10**9, "")), (c2, x2))
        states = new
    inserted(states)
    assert (cost, audit) == min(v for s, v in states.items() if s in "ba")


def test_other_grammars():
    """Brackets: items of many origins, completed inside one another."""
    g = Grammar("s", {"s": ((), ("s", "o", "s", "c"))}, {"o": "open", "c": "close"}, rerole=2, delete=3, insert=2)
    for text, cost in [("", 0), ("oc", 0), ("ococ", 0), ("oocc", 0), ("o", 2), ("co", 4), ("ooc", 2), ("occ", 2), ("ooo", 4), ("ooooocccc", 2)]:
        chart = Chart(g)
        for x in text:
            chart.take(x, False, False)
        assert chart.done()[0] == cost, text


SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("fault", T.StringType()), T.StructField("gone", T.StringType())])


def saved(spark, folder, rows):
    spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_op12(spark, tmp_path):
    r = random.Random(3)
    texts = ["Yes.", "No", "no!\n", "", " ", None, "Why?", "a.b", "漢。", "x" * 50_000 + ".", "\x00.", "end.\x85", "end "]
    rows = [(c, t if r.random() < 0.9 else None, r.choice([*ROLES[:4], None]), r.choice(texts)) for c in [*range(150), None] for t in range(r.randint(1, 4))]
    rows += [(1000, 2, "user", "Yes."), (1000, 2, "user", "Yes."), (1000, 2, "assistant", "Yes."), (1000, 9, "user", "Yes."), (-(1 << 62), (1 << 63) - 1, "user", "Hi.")]
    got = cr.op12_conversation_repair(spark, saved(spark, tmp_path / "a", rows)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
    assert cr.op12_conversation_repair(spark, saved(spark, tmp_path / "b", [])).count() == 0


def test_all_short_conversations(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r) for r in cr.op12_conversation_repair(spark, DATA).collect()}
    assert set(got) == {r[0] for r in rows}
    for want in plain(rows):
        assert got[want[0]] == want


def test_repair_gives_the_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "user", "Hi."), (1, 4, "assistant", "So.")]
    out = sorted(map(tuple, cr.repair(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()))
    cost, audit, lines = cheapest([("system", "Be kind.", False, False), ("assistant", "Hello.", False, False), ("user", "Hi.", False, False), ("user", "Hi.", True, False), ("assistant", "So.", False, False)])
    assert "".join(x[2] for x in out) == audit and [x[1] for x in out] == list(range(len(out)))
    assert [f"{x[3]}:{x[4]}" for x in out if x[2] != "D"] == lines
