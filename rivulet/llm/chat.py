"""Chat formatting with minimum-cost role repair.

A conversation is repaired so that its roles follow a legal-turn automaton, then
rendered. Each turn may keep or change its role (*relabel*), join the turn before it
(*merge*), or follow an empty turn put in before it (*insert*). Dynamic programming
over the automaton's states finds the cheapest sequence of these edits.

The cost of a block of turns is a matrix from state to state, and matrices combine by
(min, +) products. So a conversation of any length is cut into blocks: matrices are
made block by block, only they (a few numbers a block) are chained per conversation,
and each block is then traced back by itself. The texts of a conversation are gathered
only if the caller asks for whole strings.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
#: States: before any turn, and after a turn of each role.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Legal turns after each state: one optional system turn, then user and assistant by turns.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: States in which a conversation may end.
FINAL = (ASSISTANT,)
#: Costs: a changed role costs more than a merge, an empty turn the most.
RELABEL, MERGE, INSERT = 3, 2, 4
#: Other names of roles, lower-cased; any other role is unknown and costs a relabel.
NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "model": ASSISTANT, "bot": ASSISTANT}
BLOCK = 256
_FAR = 1 << 40
#: White space around a role's name that does not matter.
_TRIM = " \t\n\r\x0b\x0c"


def role_state(role: str | None) -> int:
    """State of a role; 0 for an unknown one."""
    return NAMES.get((role or "").strip(_TRIM).lower(), START)


def ways(state: int) -> list[tuple[tuple[int, ...], int, int]]:
    """(inserted roles, new state, cost) to place one more turn of any role."""
    out = [((), s, 0) for s in LEGAL[state]]
    for gap in LEGAL[state]:
        out += [((gap,), s, INSERT) for s in LEGAL[gap]]
        # Two empty turns never help: from any state each role is at most two turns away.
    return out


def options(state: int, role: int) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """(cost, new state, edit, inserted roles) for one turn, cheapest first; ties by
    fewer inserts, then merge last."""
    found = []
    for inserted, new, cost in ways(state):
        change = 0 if new == role else RELABEL
        found.append((cost + change, new, "relabel" if change else "keep", inserted))
    if state != START:
        found.append((MERGE + (0 if role in (state, START) else RELABEL), state, "merge", ()))
    return sorted(found, key=lambda x: (x[0], len(x[3]), x[2] == "merge", x[1]))


_OPTIONS = {(s, r): options(s, r) for s in range(4) for r in range(4)}
#: Cost of ending in each state: an empty turn may close the conversation.
_END = [0 if s in FINAL else INSERT if any(t in FINAL for t in LEGAL[s]) else 0 if s == START else 2 * INSERT for s in range(4)]
_STEP = np.full((4, 4, 4), _FAR, np.int64)
for (_s, _r), _found in _OPTIONS.items():
    for _c, _t, *_ in _found:
        _STEP[_r, _s, _t] = min(_STEP[_r, _s, _t], _c)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


def block_matrix(roles: list[int]) -> np.ndarray:
    """Least cost from each state to each over some turns."""
    out = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for r in roles:
        out = product(out, _STEP[r])
    return out


def chain(matrices: list[np.ndarray]) -> tuple[int, list[int]]:
    """(least cost, state at each block border) of whole conversations; ties go to the
    smaller state."""
    costs = [np.where(np.arange(4) == START, 0, _FAR)]
    for m in matrices:
        costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), _FAR))
    ended = costs[-1] + np.array(_END)
    state = int(ended.argmin())
    borders = [state]
    for m, before in zip(reversed(matrices), reversed(costs[:-1])):
        state = int((before + m[:, state]).argmin())
        borders.append(state)
    return int(ended.min()), borders[::-1]


def trace(roles: list[int], begin: int, end: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """(state, edit, inserted roles) of each turn on a cheapest way from begin to end."""
    after = [np.where(np.arange(4) == end, 0, _FAR)]
    for r in reversed(roles):
        after.append(np.minimum((_STEP[r] + after[-1][None, :]).min(axis=1), _FAR))
    after.reverse()
    out, state = [], begin
    for k, r in enumerate(roles):
        best = min(_OPTIONS[state, r], key=lambda o: (o[0] + after[k + 1][o[1]], len(o[3]), o[2] == "merge", o[1]))
        _, state, edit, inserted = best
        out.append((state, edit, inserted))
    return out


def repair_roles(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Repaired turns of every conversation.

    Returns (conv, ordinal, role, text, edits): ordinal counts the input turns from 0;
    an input turn gives one row, which a merge joins to the last row before it that is
    not a merge (``edits`` says keep, relabel or merge); each inserted empty turn gives
    a row with the ordinal of the turn that follows and edit insert, a closing one the
    number of turns. ``slot`` orders rows of one ordinal.

    Turns are ordered by turn number, null first; repeated numbers by role and text.
    A null conversation id is one conversation. An unknown or null role fits any role
    at the cost of a relabel. A null text is empty. A conversation's cost is in the
    column cost of each of its rows. Of equally cheap repairs the one with fewer
    inserts, then without a merge, counts. Other columns are ignored, whatever their
    names. An empty table gives no rows; texts of any length pass by unread.
    """
    conv_type = dict(turns.dtypes)[conv_col]
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = numbered(rows).withColumn("block", F.floor(F.col("ordinal") / block).cast("bigint"))
    names = F.create_map(*itertools.chain(*((F.lit(k), F.lit(v)) for k, v in NAMES.items())))
    placed = placed.withColumn("state", F.coalesce(F.try_element_at(names, F.lower(F.trim(F.coalesce("role", F.lit("")), F.lit(_TRIM)))), F.lit(START)))

    states = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "state"))), lambda x: x["state"].cast("string"))
    grouped = placed.groupBy("conv", "block").agg(F.array_join(states, "").alias("roles"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [block_matrix([int(c) for c in s]).astype("<i8").tobytes() for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(2), pa.array(found, pa.binary())], ["conv", "block", "roles", "matrix"])

    costed = grouped.select("conv", "block", "roles").mapInArrow(matrices, f"conv {conv_type}, block bigint, roles string, matrix binary")
    # One small record a block: a conversation of a million turns chains four thousand.
    chained = costed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "matrix", "roles"))).alias("blocks"))

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, out = [], {k: [] for k in ("ordinal", "slot", "cost", "role", "edit")}
            for k, blocks in enumerate(batch.column(1).to_pylist()):
                cost, states = chain([np.frombuffer(b["matrix"], "<i8").reshape(4, 4) for b in blocks])
                ordinal = 0
                put = lambda slot, role, edit: (conv.append(k), [out[n].append(v) for n, v in zip(out, (ordinal, slot, cost, ROLES[role - 1], edit))])  # noqa: B023, E731
                for b, begin, end in zip(blocks, states[:-1], states[1:]):
                    for state, edit, inserted in trace([int(c) for c in b["roles"]], begin, end):
                        for slot, role in enumerate(inserted):
                            put(slot, role, "insert")
                        put(len(inserted), state, edit)
                        ordinal += 1
                state, slot = states[-1], 0
                while state not in FINAL and state != START:
                    state = ASSISTANT if state == USER else USER
                    put(slot, state, "insert")
                    slot += 1
            types = {"ordinal": pa.int64(), "slot": pa.int32(), "cost": pa.int64(), "role": pa.string(), "edit": pa.string()}
            columns = [pa.array(out[name], kind) for name, kind in types.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(conv, pa.int64())), *columns], ["conv", *types])

    fixed = chained.mapInArrow(borders, f"conv {conv_type}, ordinal bigint, slot int, cost bigint, role string, edit string")
    texts = placed.select(F.col("conv").alias("c"), F.col("ordinal").alias("o"), "text")
    joined = fixed.join(texts, fixed.conv.eqNullSafe(F.col("c")) & (fixed.ordinal == F.col("o")) & (fixed.edit != "insert"), "left")
    return joined.select(F.col("conv").alias(conv_col), "ordinal", "slot", "role", F.coalesce("text", F.lit("")).alias("text"), "edit", "cost")


def numbered(rows: DataFrame) -> DataFrame:
    """Turns with their 0-based place in the conversation.

    Windows hold one run of turn numbers at a time, so a long conversation is not
    numbered by one task: runs of 4096 numbers are counted, and offsets are added.
    """
    rows = rows.withColumn("__run", F.floor(F.coalesce("turn", F.lit(-1)) / 4096).cast("bigint"))
    local = rows.withColumn("__local", F.row_number().over(W.partitionBy("conv", "__run").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    sizes = rows.groupBy("conv", "__run").agg(F.count("*").alias("__n"))
    before = W.partitionBy("conv").orderBy("__run").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col("conv").alias("__conv"), F.col("__run").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    on = local.conv.eqNullSafe(offsets["__conv"]) & (local["__run"] == offsets["__r"])
    return local.join(offsets, on).withColumn("ordinal", F.col("__local") + F.col("__offset") - 1).select(*[c for c in rows.columns if c != "__run"], "ordinal")


def render(repaired: DataFrame, conv_col: str = "conv_id", begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """One string for each conversation: a header, the text and an end for each turn.

    Merged texts follow after an empty line. Gathers each conversation's text in one
    row, as the result asks for; returns (conv, n_turns, n_edits, cost, rendered).
    """
    lead = F.when(F.col("edit") == "merge", F.concat(F.lit("\n\n"), F.col("text"))).otherwise(
        F.concat(F.when((F.col("ordinal") > 0) | (F.col("slot") > 0), F.lit(f"{end}\n")).otherwise(""), F.lit(begin), F.col("role"), F.lit("\n"), F.col("text"))
    )
    parts = repaired.withColumn("__part", lead)
    return parts.groupBy(conv_col).agg(
        F.count_if(F.col("edit") != "merge").alias("n_turns"),
        F.count_if(F.col("edit") != "keep").alias("n_edits"),
        F.max("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "slot", "__part"))), lambda x: x["__part"]), "").alias("__body"),
    ).select(conv_col, "n_turns", "n_edits", "cost", F.concat("__body", F.lit(f"{end}\n")).alias("rendered"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired and rendered conversations."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return render(repair_roles(turns)).withColumn("rendered_sha256", F.sha2("rendered", 256))
