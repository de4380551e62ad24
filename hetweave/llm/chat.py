"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation,
ending with the assistant. Each given turn may be kept, relabelled, or merged into the turn
before it, and empty turns may be put in; each repair has a cost. Dynamic programming over the
automaton of legal turns finds the cheapest way. States: 0 nothing yet, 1 after the system
turn, 2 after a user turn, 3 after an assistant turn.

The programme is a chain of 4 x 4 cost matrices in the (min, +) algebra, which is associative:
a conversation is cut into chunks of turns, each chunk yields its matrix, the chunks' matrices
are chained into the costs of the states before each chunk. Under those each chunk traces back
from every state it may end in to the one it then starts from; these maps are chained from the
end, and each chunk goes the one way that is left. So among equally cheap ways the same is taken
wherever chunks begin. No task holds a conversation, however long. The chain of chunks is itself
short: one row for CHUNK turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hetweave.llm.common import cut, small_batches

CHUNK = 4096
KEEP, MERGE, RELABEL, INSERT = 0, 1, 6, 4
STATES = 4
_ROLE_OF_STATE = ("", "system", "user", "assistant")
#: Legal next states. Ends: in state 3, or 0 for no turns at all.
_NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
_INFINITE = 1 << 40


@lru_cache(maxsize=64)
def _steps(role: int) -> tuple[np.ndarray, list[list[tuple[int, ...]]]]:
    """Costs from state to state by one turn of a role, and what is done: states entered, then
    "merge" as -1 for a turn that joins the one before it."""
    cost = np.full((STATES, STATES), _INFINITE, np.int64)
    how: list[list[tuple[int, ...]]] = [[() for _ in range(STATES)] for _ in range(STATES)]

    def offer(a: int, b: int, c: int, did: tuple[int, ...]) -> None:
        if c < cost[a, b]:
            cost[a, b], how[a][b] = c, did

    for a in range(STATES):
        if a:
            offer(a, a, MERGE if a == role else MERGE + RELABEL, (-1,))
        for way, added in _ways(a):
            b = way[-1]
            offer(a, b, INSERT * added + (KEEP if b == role else RELABEL), way)
    return cost, how


def _ways(a: int) -> list[tuple[tuple[int, ...], int]]:
    """Paths of legal states from a whose last is this turn and whose others are empty turns."""
    out, front = [], [(b,) for b in _NEXT[a]]
    while front:
        out += [(p, len(p) - 1) for p in front]
        front = [(*p, b) for p in front for b in _NEXT[p[-1]] if len(p) < 3]
    return sorted(out, key=lambda x: (x[1], x[0]))


#: Costs of the states before the first turn.
_START = np.array([0] + [_INFINITE] * (STATES - 1), np.int64)
#: Cost to end in each state: after a user turn an empty assistant turn follows.
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
_END_WAYS: tuple[tuple[int, ...], ...] = ((), (2, 3), (3,), ())


def chunk_matrix(roles: list[int]) -> np.ndarray:
    """The (min, +) product of the turns' matrices."""
    total = np.where(np.eye(STATES, dtype=bool), 0, _INFINITE)
    for r in roles:
        total = (total[:, :, None] + _steps(r)[0][None]).min(axis=1)
    return np.minimum(total, _INFINITE)


def forward(roles: list[int], costs: np.ndarray) -> list[np.ndarray]:
    """Costs of the states before the first turn, as given, and after each turn."""
    out = [costs]
    for r in roles:
        out.append(np.minimum((out[-1][:, None] + _steps(r)[0]).min(axis=0), _INFINITE))
    return out


def starts(roles: list[int], costs: np.ndarray) -> list[int]:
    """For each state after the turns, the state before them on the cheapest way; the lowest of equals at each turn."""
    back = np.arange(STATES)
    for r, cost in zip(roles[::-1], forward(roles, costs)[-2::-1], strict=True):
        back = (cost[:, None] + _steps(r)[0]).argmin(axis=0)[back]
    return back.tolist()


def trace(roles: list[int], before: np.ndarray, end: int) -> tuple[int, list[tuple[int, tuple[int, ...]]]]:
    """The cheapest way to end under the costs before: the state it starts from, then the state after each turn and what it did."""
    costs = forward(roles, before)
    out, state = [], end
    for k in range(len(roles) - 1, -1, -1):
        cost, how = _steps(roles[k])
        last = int((costs[k] + cost[:, state]).argmin())
        out.append((state, how[last][state]))
        state = last
    return state, out[::-1]


def _actions(roles: list[int], before: np.ndarray, end: int, last: bool) -> list[tuple[int, int, str, str, str]]:
    """(k, sub, action, role, opening) of each given turn and each empty one put in.

    opening is what comes before the turn's text; the very last row of a conversation also gets
    a close, which the caller adds.
    """
    rows, (state, way) = [], trace(roles, before, end)
    for k, (after, did) in enumerate(way):
        right = after == roles[k]
        if did == (-1,):
            rows.append((k, 0, "merge" if right else "relabel_merge", _ROLE_OF_STATE[after], "\n\n"))
        for j, s in enumerate(() if did == (-1,) else did):
            action = "insert" if j < len(did) - 1 else "keep" if right else "relabel"
            rows.append((k, j, action, _ROLE_OF_STATE[s], _open(state, s)))
            state = s
        state = after
    if last:
        for j, s in enumerate(_END_WAYS[end]):
            rows.append((len(roles) - 1, 10 + j, "insert", _ROLE_OF_STATE[s], _open(state, s)))
            state = s
    return rows


def _open(before: int, state: int) -> str:
    return ("<|end|>\n" if before else "") + f"<|{_ROLE_OF_STATE[state]}|>\n"


_PLAN = "array<struct<k:int,sub:int,action:string,role:string,opening:string>>"


def repair_roles(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The repaired turns as fragments: (conv_id, span, k, sub, turn, action, role, fragment, is_last).

    Fragments in order of (span, k, sub) make up the rendered conversation: a turn opens with
    <|role|> and a line end, merged turns go on after a blank line, and <|end|> closes a turn.
    action is keep, relabel, merge, relabel_merge or insert; inserted turns have no text and a
    null turn number. Costs: merge 1, insert 4, relabel 6, relabel and merge 7; of equally cheap
    ways the one with the lowest earlier states is taken, so reruns agree.

    Turns are ordered by number, nulls first, then role and text; repeated rows are turns of
    their own. Null texts are empty; unknown and null roles are relabelled or merged. Rows with
    a null conversation id are one conversation. Role names match without case and outer space.
    An empty table gives no rows; extra columns are not carried.

    Chunks are ranges of turn numbers, and runs of `chunk` rows inside one.
    """
    small_batches(turns.sparkSession)
    clean = F.lower(F.trim(F.col(role)))
    state = F.coalesce(F.when(clean == "system", 1).when(clean == "user", 2).when(clean == "assistant", 3), F.lit(0))
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.coalesce(F.col(conv_id).cast("string"), F.lit("")).alias("c"),
        F.col(conv_id).isNull().alias("no_c"),
        F.coalesce(F.floor(F.col(turn) / chunk), F.lit(-1)).cast("long").alias("span"),
        F.col(turn).alias("turn"),
        F.col(role).alias("given"),
        state.alias("state"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.xxhash64(text).alias("h"),
    )
    order = [F.col("turn").asc_nulls_first(), "given", "h"]
    number = F.row_number().over(Window.partitionBy("c", "no_c", "span").orderBy(*order)) - 1
    narrow = rows.select("c", "no_c", "span", "turn", "given", "state", "h").withColumn("k", number)
    narrow = narrow.withColumn("part", F.floor(F.col("k") / chunk).cast("long"))
    chunks = narrow.groupBy("c", "no_c", "span", "part").agg(F.sort_array(F.collect_list(F.struct("k", "state"))).alias("s"))
    per = F.count("*").over(Window.partitionBy("c", "no_c"))
    chunks = cut(chunks.select("c", "no_c", "span", "part", F.transform("s", lambda x: x["state"]).alias("roles")).withColumn("parts", per))

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            plans = []
            for roles in b.roles:
                roles = list(roles)
                end = int((chunk_matrix(roles)[0] + _END).argmin())
                plans.append(_actions(roles, _START, end, True))
            yield b[["c", "no_c", "span", "part"]].assign(is_last=True, plan=plans)

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["c", "no_c", "span", "part"]].assign(m=[chunk_matrix(list(r)).reshape(-1).tolist() for r in b.roles])

    def reached(group: pd.DataFrame) -> pd.DataFrame:
        """Costs of the states before each chunk of one conversation, and after its last."""
        group = group.sort_values(["span", "part"])
        costs = [_START]
        for m in group.m:
            costs.append(np.minimum((costs[-1][:, None] + np.array(m).reshape(STATES, STATES)).min(axis=0), _INFINITE))
        costs = [c.tolist() for c in costs]
        return group[["c", "no_c", "span", "part"]].assign(before=costs[:-1], after=costs[1:])

    def backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            maps = [starts(list(r.roles), np.array(r.before)) for r in b.itertuples()]
            yield b[["c", "no_c", "span", "part", "before", "after"]].assign(back=maps)

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        """The state after each chunk of one conversation: the cheapest last one, then the maps from the end on."""
        group = group.sort_values(["span", "part"])
        states = [int((np.array(group.after.iloc[-1]) + _END).argmin())]
        for back in group.back.tolist()[:0:-1]:
            states.append(int(back[states[-1]]))
        return group[["c", "no_c", "span", "part", "before"]].assign(end=states[::-1], is_last=[*[False] * (len(group) - 1), True])

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            plans = [_actions(list(r.roles), np.array(r.before), r.end, r.is_last) for r in b.itertuples()]
            yield b[["c", "no_c", "span", "part", "is_last"]].assign(plan=plans)

    kind = "c string, no_c boolean, span long, part long"
    short = chunks.where("parts = 1").drop("parts").mapInPandas(alone, f"{kind}, is_last boolean, plan {_PLAN}")
    many = chunks.where("parts > 1").drop("parts")
    at = ["c", "no_c", "span", "part"]
    costs = many.mapInPandas(matrices, f"{kind}, m array<long>").groupBy("c", "no_c").applyInPandas(reached, f"{kind}, before array<long>, after array<long>")
    maps = many.join(costs, at).mapInPandas(backward, f"{kind}, before array<long>, after array<long>, back array<int>")
    between = maps.groupBy("c", "no_c").applyInPandas(ends, f"{kind}, before array<long>, end int, is_last boolean")
    long_ = many.join(between, at).mapInPandas(traced, f"{kind}, is_last boolean, plan {_PLAN}")
    steps = short.unionByName(long_).select("c", "no_c", "span", "part", "is_last", F.size("plan").alias("n"), F.posexplode("plan").alias("j", "p"))
    steps = steps.select("c", "no_c", "span", (F.col("part") * chunk + F.col("p.k")).cast("int").alias("k"), "p.sub", "p.action", "p.role", "p.opening", (F.col("is_last") & (F.col("j") == F.col("n") - 1)).alias("is_last"))
    # the numbering above, once more, now with the texts
    texts = rows.withColumn("k", number).select("conv_id", "c", "no_c", "span", "k", "turn", "text")
    out = texts.join(steps.withColumnRenamed("k", "of"), ["c", "no_c", "span"]).where("k = of")
    new = F.col("action") == "insert"
    body = F.concat("opening", F.when(new, F.lit("")).otherwise(F.col("text")), F.when(F.col("is_last"), F.lit("<|end|>\n")).otherwise(F.lit("")))
    return out.select("conv_id", "span", "k", "sub", F.when(~new, F.col("turn")).alias("turn"), "action", "role", body.alias("fragment"), "is_last")


def render(fragments: DataFrame) -> DataFrame:
    """(conv_id, rendered): whole conversations, for consumers that want them in one string.

    Each is gathered in one row, so this is for conversations of ordinary length; fragments in
    order are the same text for any length.
    """
    piece = F.struct("span", "k", "sub", "fragment")
    parts = F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["fragment"])
    return fragments.groupBy("conv_id").agg(F.array_join(parts, "").alias("rendered"))
