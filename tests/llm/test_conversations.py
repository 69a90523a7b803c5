"""Repairs against a search over all edits, and long conversations cut into blocks."""

import hashlib
import heapq
import itertools
import random
import re

import pytest

from sightline.llm import conversations as c


def model(rows):
    """Report of one conversation: rows are (turn, role, text), cheapest edits by search in order of (cost, edits)."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), y[2].encode()))
    seen, faults = set(), []
    for t, r, x in rows:
        kind = "blank" if not x.strip(c.SPACE) else "duplicate" if (r, x) in seen else "truncated" if x.rstrip(c.SPACE)[-1] not in ".!?" else ""
        faults.append(kind)
        seen.add((r, x))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, edits, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", state):
            break
        # What is left depends on the place and on the role before only.
        key = (i, state[-1:])
        if key in done:
            continue
        done.add(key)

        def go(by, letter, to, role, line):
            new = state + role
            if re.fullmatch("s?(ua)*u?", new):
                heapq.heappush(heap, (cost + by, edits + letter, to, new, lines + line))

        for role in ("user", "assistant"):
            go(2, "I", i, role[0], (f"{role}:",))
        if i < len(rows):
            _, r, x = rows[i]
            go(3, "D", i + 1, "", ())
            if faults[i] not in ("blank", "duplicate"):
                t = faults[i] == "truncated"
                go(t, "K", i + 1, r[:1] or "?", (f"{r}:{x}",))
                for role in ("user", "assistant"):
                    go(2 + t, "R", i + 1, role[0], (f"{role}:{x}",))
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, edits, sha)


def random_rows(draw, n):
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Hi.", "Hi. \n", "what?", "no end", " \t", "", None, "other!", "x", "y.", "é…", "z z?"]
    turns = [None, *range(8)]
    return [(draw.choice(turns), draw.choice(roles[: draw.choice([3, 7])]), draw.choice(texts)) for _ in range(n)]


def results(spark, conversations):
    rows = [(k, t, r, x, "extra", 1) for k, turns in conversations.items() for t, r, x in turns]
    df = spark.createDataFrame(rows, "id string, turn int, role string, text string, sign string, block int")
    found = c.repair(df, conv="id")
    shas = {r["conv"]: r["sha256"] for r in c.digests(found.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {r["conv"]: (*(r[n] for n in names), shas.get(r["conv"], empty)) for r in found.report.collect()}


def test_random_conversations(spark):
    draw = random.Random(3)
    given = {(None if i == 5 else f"c{i}"): random_rows(draw, draw.randint(1, 9)) for i in range(400)}
    got = results(spark, given)
    assert got.keys() == given.keys()
    for k, rows in given.items():
        assert got[k] == model(rows), (k, rows)


def test_long_conversations_in_blocks(spark):
    draw = random.Random(4)
    roles, n = ["user", "assistant", "system"], 2 * c.BLOCK + 300
    given = {f"long{j}": [(i, draw.choice(roles[:j]), f"{draw.randint(0, 4 * n)}" + draw.choice([".", ""])) for i in range(n)] for j in (2, 3)}
    given["equal"] = [(1, "user", "same.")] * 3000 + [(1, "user", " ")] * 500
    given |= {f"s{i}": random_rows(draw, 6) for i in range(50)}
    got = results(spark, given)
    for k, rows in given.items():
        want = model(rows)
        assert got[k] == want, (k, [(a, b) for a, b in zip(got[k], want) if a != b][0][0])


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found = c.repair(df)
    assert found.report.count() == 0 and found.turns.count() == 0 and c.digests(found.turns).count() == 0


def test_each_suffix_is_one_node(spark, monkeypatch):
    """The automaton makes a node for each distinct suffix, not for each turn."""
    words = ["ua", "sua", "uaua", "aua", "uuA", "", "UaUa"]
    made = []
    extended = c.extended
    monkeypatch.setattr(c, "extended", lambda sign, rest: made.append(sign) or extended(sign, rest))

    class Plan:  # runs the task's function here
        def __getattr__(self, name):
            return lambda *a, **k: self

        def mapInArrow(self, run, schema):
            import pyarrow as pa

            backs = sorted(w[::-1] for w in words)
            return list(run(iter([pa.record_batch([["0,4,2,0"] * len(backs), backs], ["ending", "back"])])))

    (batch,) = c.solve(Plan())
    assert batch.num_rows == len(words)
    assert len(made) == len({w[i:] for w in words for i in range(len(w))})


@pytest.mark.parametrize("ending", [c.END, (0, c.NEVER, c.NEVER, c.NEVER), (5, 2, 0, 4)])
def test_costs_of_states(ending):
    """Costs from every state equal a relaxation over single edits."""
    draw = random.Random(str(ending))
    for _ in range(200):
        word = "".join(draw.choice("suaoSUAO") for _ in range(draw.randint(1, 6)))
        node, cost = c.leaf(ending), list(ending)
        for sign in reversed(word):
            node = c.extended(sign, node)
            t, before = sign.isupper(), cost
            cost = []
            for q in range(4):
                options = [3 + before[q], 2 + t + before[c.MADE[q]]]
                if (to := c.ALLOWED[q].get(sign.lower())) is not None:
                    options.append(t + before[to])
                cost.append(min(options))
            for _ in range(5):
                cost = [min(cost[q], 2 + cost[c.MADE[q]]) for q in range(4)]
        assert list(node.cost) == cost
