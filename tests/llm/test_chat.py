"""op4: the cheapest repair against all repairs, and cuts at any place."""

import hashlib
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import chat
from lodestone.llm.queries import op4_chat_format
from tests.conftest import DATA

KIND = "conv_id long, turn long, role string, text string, cost string, rendered int"
ROLES = ["system", "user", "assistant", "tool", None]


def cheapest(roles):
    """Least cost over all ways to go through the automaton, by plain enumeration."""
    best = {chat.START: 0}
    for code in chat.role_codes(roles).tolist():
        nxt = {}
        for s, c in best.items():
            for cost, to, _, _ in chat.OPTIONS[code][s]:
                nxt[to] = min(nxt.get(to, 1 << 60), c + cost)
        best = nxt
    return min(c + int(chat.FINISH[s]) for s, c in best.items()) if roles else 0


def turns_of(text):
    parts = [p for p in text.split(chat.CLOSE) if p]
    return [p.removeprefix(chat.OPEN).split("\n", 1) for p in parts]


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return bool(roles) and len(roles) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


def check(rows, turns):
    """rows of one conversation in order, turns: (role, text)."""
    assert sum(r.cost for r in rows) == cheapest([t[0] for t in turns])
    shown = turns_of("".join(r.rendered for r in rows))
    assert legal([s[0] for s in shown])
    said = "".join(s[1] for s in shown).replace("\n", "")
    assert said == "".join((t[1] or "").replace("<|im_", "< |im_") for t in turns).replace("\n", "")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(ROLES), min_size=1, max_size=9))
def test_program_finds_the_least_cost(roles):
    chosen = chat.repair(roles)
    end = chosen[-1][1]
    assert sum(c[0] for c in chosen) + int(chat.FINISH[end]) == cheapest(roles)


def test_enumeration_is_right_on_short_ones():
    for roles in itertools.product(ROLES[:4], repeat=2):
        ways = []
        for a in chat.OPTIONS[int(chat.role_codes([roles[0]])[0])][chat.START]:
            for b in chat.OPTIONS[int(chat.role_codes([roles[1]])[0])][a[1]]:
                ways.append(a[0] + b[0] + int(chat.FINISH[b[1]]))
        assert min(ways) == cheapest(list(roles))
    assert cheapest(["user", "assistant"]) == 0 and cheapest(["user"]) == chat.INSERT


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_conversations_may_be_cut_anywhere(spark, partitions):
    long = [(1, t, ROLES[(t * 7 + t // 3) % 5], f"m{t} <|im_end|>") for t in range(40)]
    rows = long + [(2, 0, "user", "q"), (2, 1, "assistant", None), (3, 0, None, ""), (0, 0, "assistant", "a"), (4, 0, "User ", "x"), (4, 0, "User ", "x")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], KIND).repartition(5)
    got = chat.format_chats(df, partitions).collect()
    assert len(got) == len(rows)
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in got if r.conv_id == conv], key=lambda r: r.turn)
        check(own, [(r[2], r[3]) for r in rows if r[0] == conv])


def test_one_long_conversation_is_cut_by_its_bytes(spark, monkeypatch):
    monkeypatch.setattr(chat, "BYTES", 20_000)
    rows = [(7, t, ROLES[(t * 5 + t // 4) % 5], f"{t} " * 400) for t in range(90)]
    rows += [(7, 200, "user", x) for x in ("b", "a", None, "", "a", "long " * 900)]  # ties in all but the text
    got = chat.format_chats(spark.createDataFrame([(*r, "c", 1) for r in rows], KIND).repartition(5))
    assert got.rdd.getNumPartitions() > 4
    digest = lambda x: "" if x is None else hashlib.md5(x.encode()).hexdigest()  # noqa: E731, S324
    check(got.collect(), [(r[2], r[3]) for r in sorted(rows, key=lambda r: (r[1], digest(r[3])))])


def test_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None), (None, 1, "user", "x", None, None)], KIND)
    rows = chat.format_chats(df).collect()
    assert len(rows) == 2 and {r.conv_id for r in rows} == {None}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_whole_table(spark):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    got = op4_chat_format(spark, DATA).collect()
    assert len(got) == len(turns)
    for conv in {t.conv_id for t in turns}:
        key = lambda r: (r.turn, r.role or "")
        mine = sorted([t for t in turns if t.conv_id == conv], key=lambda t: (*key(t), t.text or ""))
        own = [r for r in got if r.conv_id == conv]
        assert sum(r.cost for r in own) == cheapest([t.role for t in mine])
