"""Role repair against a brute-force search of all edits, and rendering."""

import random
from functools import lru_cache

import pytest

from rivulet.llm import chat
from rivulet.llm.chat import ASSISTANT, FINAL, INSERT, LEGAL, MERGE, RELABEL, START


def brute(roles):
    """Least cost by trying keep, relabel, merge and any number of inserts."""

    @lru_cache(None)
    def best(k, state, inserts):
        found = [0] if k == len(roles) and (state in FINAL or not roles) else []
        if inserts < 3 and roles:
            found += [INSERT + best(k, s, inserts + 1) for s in LEGAL[state]]
        if k < len(roles):
            found += [(0 if s == roles[k] else RELABEL) + best(k + 1, s, 0) for s in LEGAL[state]]
            if state != START and not inserts:
                found.append(MERGE + (0 if roles[k] in (state, START) else RELABEL) + best(k + 1, state, 0))
        return min(found, default=1 << 50)

    return best(0, START, 0)


def legal(turns):
    state = START
    for role in turns:
        new = chat.ROLES.index(role) + 1
        if new not in LEGAL[state]:
            return False
        state = new
    return state in FINAL


@pytest.mark.parametrize("block", [256, 3, 1])
def test_cost_is_least_and_turns_are_legal(spark, block):
    rnd = random.Random(block)
    convs = {c: [rnd.choice(["system", "User", "assistant", "user", "assistant", "bot", "tool", None]) for _ in range(rnd.randint(1, 9))] for c in range(150)}
    convs[500] = ["user"] * 3000
    rows = [(c, t, r, f"{c}.{t}") for c, roles in convs.items() for t, r in enumerate(roles)]
    rnd.shuffle(rows)
    got = chat.repair_roles(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), block=block).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.ordinal, r.slot)):
        by.setdefault(r.conv_id, []).append(r)
    for c, roles in convs.items():
        own = by[c]
        states = tuple(chat.role_state(r) for r in roles)
        if len(roles) < 20:
            assert {r.cost for r in own} == {brute(states)}, roles
        assert legal([r.role for r in own if r.edit != "merge"])
        assert [r.text for r in own if r.edit != "insert"] == [f"{c}.{t}" for t in range(len(roles))]
        spent, last = 0, START
        for r in own:
            new = chat.ROLES.index(r.role) + 1
            if r.edit == "insert":
                spent += INSERT
            elif r.edit == "merge":
                assert new == last
                spent += MERGE + (0 if states[r.ordinal] in (last, START) else RELABEL)
            else:
                assert (r.edit == "keep") == (new == states[r.ordinal])
                spent += RELABEL * (r.edit == "relabel")
            last = new
        assert spent == own[0].cost


def test_rendering_nulls_ties_and_clashing_columns(spark):
    rows = [(1, 0, "user", "Hi", 1), (1, 1, "user", "there", 1), (1, 2, "assistant", None, 1), (2, 0, "assistant", "A", 1), (None, None, None, None, None), (3, 5, "user", "b", 0), (3, 5, "user", "a", 0)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, ordinal int")
    got = {r.conv_id: r for r in chat.render(chat.repair_roles(df)).collect()}
    head = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got[1].rendered == head("user", "Hi\n\nthere") + head("assistant", "") and got[1].cost == MERGE
    assert got[3].rendered == head("user", "a") + head("assistant", "b") and got[3].cost == RELABEL
    assert legal([part.split("\n")[0] for part in got[None].rendered.split("<|im_start|>")[1:]])
    assert got[2].cost == INSERT and got[2].rendered == head("user", "") + head("assistant", "A")
    assert chat.repair_roles(df.limit(0)).collect() == []
    assert ASSISTANT in FINAL


def test_very_long_turns_white_space_around_roles_and_clashing_columns(spark):
    long = "wort " * 300_000
    rows = [(1, 0, "\tuser\n", long, "a", 1), (1, 1, " Assistant", None, "b", 2), (2, 0, "user", "", "c", 3), (2, 0, "user", "", "c", 3)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, edit string, cost int")
    got = {r.conv_id: r for r in chat.render(chat.repair_roles(turns)).collect()}
    assert got[1].rendered == f"<|im_start|>user\n{long}<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n" and got[1].cost == 0
    assert got[2].cost == RELABEL and got[2].n_turns == 2
    assert chat.render(chat.repair_roles(turns.limit(0))).count() == 0
