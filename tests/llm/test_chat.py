"""Role repair: the same rows wherever chunks begin, and the query against the plain rules."""

import random

import pytest
from test_operators import cheapest

from hetweave.llm import chat, queries

KNOWN = {"system": 1, "user": 2, "assistant": 3}
PRICE = {"keep": 0, "merge": chat.MERGE, "relabel": chat.RELABEL, "relabel_merge": chat.MERGE + chat.RELABEL, "insert": chat.INSERT}


@pytest.fixture(scope="module")
def talks(spark):
    """Conversations full of ties, one of them long, with nulls, repeated rows and a very long text."""
    rng = random.Random(8)
    roles = ["system", "user", "assistant", " User", None, "tool"]
    rows = [(c, t, rng.choice(roles), f"text {c} {t}") for c in range(60) for t in range(rng.randint(1, 12))]
    rows += [(90, t, rng.choice(roles), None) for t in range(400)]
    rows += [(91, 0, "user", "word " * 50_000), (91, 0, "user", "word " * 50_000), (None, None, "tool", "lost"), (None, 1, None, None)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").cache()


def told(out):
    """Each conversation's fragments in order, whatever chunks they were cut into."""
    rows = sorted(out.collect(), key=lambda r: (str(r.conv_id), r.span, r.k, r.sub))
    return [(r.conv_id, r.turn, r.action, r.role, r.fragment, r.is_last) for r in rows]


def test_chunks_change_nothing(spark, talks):
    whole = told(chat.repair_roles(talks))
    for chunk in (1, 2, 7):
        assert told(chat.repair_roles(talks, chunk=chunk)) == whole


def test_traces_agree():
    """All ways cut in two anywhere: the second part's start is where the whole way is then."""
    rng = random.Random(3)
    for _ in range(200):
        roles = [rng.randint(0, 3) for _ in range(rng.randint(1, 9))]
        end = int((chat.forward(roles, chat._START)[-1] + chat._END).argmin())
        way = chat.trace(roles, chat._START, end)[1]
        for k in range(len(roles)):
            before = chat.forward(roles[:k], chat._START)[-1]
            start, rest = chat.trace(roles[k:], before, end)
            assert rest == way[k:] and start == (way[k - 1][0] if k else 0) == chat.starts(roles[k:], before)[end]


def test_query(spark, talks, tmp_path):
    """op6: cheapest cost by search, legal turns, every turn once, in order and with its whole text."""
    talks.write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op6_chat_repair(spark, str(tmp_path)).collect()
    given = talks.collect()
    for c in {r.conv_id for r in given}:
        own = sorted((r for r in given if r.conv_id == c), key=lambda r: (r.turn is not None, r.turn or 0, r.role is not None, r.role or ""))
        rows = sorted((r for r in out if r.conv_id == c), key=lambda r: (r.span, r.k, r.sub))
        assert sum(PRICE[r.action] for r in rows) == cheapest([KNOWN.get((r.role or "").strip().lower(), 0) for r in own])
        kept = [r for r in rows if r.action != "insert"]
        assert [r.turn for r in kept] == [r.turn for r in own]
        assert all((o.text or "") in r.fragment for r, o in zip(kept, own, strict=True))
        turns = [r.role for r in rows if "merge" not in r.action]
        rest = turns[1:] if turns[0] == "system" else turns
        assert rest == ["user", "assistant"] * (len(rest) // 2) and rest
        assert [r.is_last for r in rows] == [False] * (len(rows) - 1) + [True]
