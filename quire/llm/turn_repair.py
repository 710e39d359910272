"""Repair of the structure of conversations at the least cost.

Roles must spell `(s?(ua)+)?` by their initials.  A time-major dynamic program holds, for every row of
every conversation and every state of that pattern, the least cost of what is still to be done; edits
are then traced from the first row on, for all conversations of a bucket of similar length at once.

Rows are dealt out by ranges of (conversation, turn), so a conversation of any size is spread over tasks.
A task repairs the conversations that lie wholly inside it.  The first and the last one of a task, and
those too long for its buffer, are cut into fragments: each fragment gives a 4 x 4 matrix of least costs
from state to state, matrices are combined over a conversation, and the fragments then trace their own edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.staging import stage

BLANKS = " \t\n\x0b\x0c\r"
#: A conversation of more rows or bytes in one task is cut into fragments of about this size.
ROWS, BYTES = 16_384, 32 << 20
DELETE, INSERT, REROLE, LATE = 4, 3, 3, 3
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after a leading system turn, after a user's, after an assistant's.  From each, where
#: the role that must follow leads, and where a row of each initial (other, s, u, a) leads; -1: nowhere.
NEXT = np.array([2, 2, 3, 2])
KEEP = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
#: Cost of the turns that are missing at the end.
END = np.array([0, 2 * INSERT, INSERT, 0])
FAR = 1 << 50
ROLE = {2: "user", 3: "assistant"}


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows damaged by the crc32 of `id:turn` modulo 20, with a column `gone` for those that 0 drops.

    1 empties the text, 2 removes its `.`, `!` and `?`, 3 repeats the row next to itself, 4 makes the role
    user.  A null role or text is one space, and so is a null id or turn inside the hashed text.
    """
    as_text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    code = F.crc32(F.concat(as_text(id_col), F.lit(":"), as_text(turn_col)).cast("binary")) % 20
    out = rows.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{turn_col}`").alias(turn_col), as_text(role_col).alias(role_col), as_text(text_col).alias(text_col), code.alias("gone"))
    text = F.when(F.col("gone") == 1, "").when(F.col("gone") == 2, F.regexp_replace(f"`{text_col}`", "[.!?]", "")).otherwise(F.col(f"`{text_col}`"))
    role = F.when(F.col("gone") == 4, "user").otherwise(F.col(f"`{role_col}`"))
    copies = F.explode(F.when(F.col("gone") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select(f"`{id_col}`", f"`{turn_col}`", role.alias(role_col), text.alias(text_col), (F.col("gone") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def backward(fault: np.ndarray, initial: np.ndarray, length: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[time, conversation, state]: the least cost of the rows from a time on; fault and initial are [time, conversation]."""
    steps, n = fault.shape
    out = np.empty((steps + 1, n, 4), np.int64)
    out[steps] = end
    for t in range(steps - 1, -1, -1):
        after, whole, late = out[t + 1], (fault[t] == NONE) | (fault[t] == TRUNCATED), LATE * (fault[t] == TRUNCATED)
        to = KEEP[:, initial[t]].T
        kept = np.where(whole[:, None] & (to >= 0), late[:, None] + np.take_along_axis(after, np.maximum(to, 0), 1), FAR)
        turned = np.where(whole, REROLE + late, FAR)[:, None] + after[:, NEXT]
        cost = np.minimum(np.minimum(after + DELETE, kept), turned)
        for _ in range(2):  # more than two turns are never put in at one place
            cost = np.minimum(cost, INSERT + cost[:, NEXT])
        out[t] = np.where((t < length)[:, None], cost, after)
    return out


def trace(costs: np.ndarray, fault: np.ndarray, initial: np.ndarray, length: np.ndarray, state: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """[conversation, step] letters of the cheapest edits, the least in ASCII of equals (0: no edit), and the states at the end."""
    steps, n = fault.shape
    each, letters = np.arange(n), []
    for t in range(steps):
        live = t < length
        whole, late = (fault[t] == NONE) | (fault[t] == TRUNCATED), LATE * (fault[t] == TRUNCATED)
        while live.any():
            here, after = costs[t, each, state], costs[t + 1]
            to = KEEP[state, initial[t]]
            gone = live & (after[each, state] + DELETE == here)
            more = live & ~gone & (costs[t, each, NEXT[state]] + INSERT == here)
            kept = live & ~gone & ~more & whole & (to >= 0) & (after[each, np.maximum(to, 0)] + late == here)
            turned = live & ~gone & ~more & ~kept
            letters.append((68 * gone + 73 * more + 75 * kept + 82 * turned).astype(np.uint8))
            state = np.where(more | turned, NEXT[state], np.where(kept, to, state))
            live = more
    while last and (more := END[state] > 0).any():
        letters.append((73 * more).astype(np.uint8))
        state = np.where(more, NEXT[state], state)
    return (np.stack(letters, 1) if letters else np.zeros((n, 0), np.uint8)), state


def seen_before(group: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Whether an earlier row of the group has the digest (rows of two 64-bit numbers)."""
    order = np.lexsort((digest[:, 1], digest[:, 0], group))
    g, d = group[order], digest[order]
    out = np.zeros(len(group), bool)
    out[order[1:]] = (g[1:] == g[:-1]) & (d[1:] == d[:-1]).all(1)
    return out


def applied(audit: str, state: int, roles: list, texts: list) -> Iterator[tuple[str, str]]:
    """The turns that edits make of rows, from a state of the pattern on."""
    at = 0
    for letter in audit:
        if letter in "IR":
            state = int(NEXT[state])
            yield ROLE[state], texts[at] if letter == "R" else ""
        elif letter == "K":
            state = 1 if roles[at][:1] == "s" else 2 if roles[at][:1] == "u" else 3
            yield roles[at], texts[at]
        at += letter != "I"


def _numbers(table: pa.Table, name: str, fill: int = 0) -> np.ndarray:
    return table.column(name).combine_chunks().fill_null(fill).to_numpy(zero_copy_only=False)


def _digests(table: pa.Table) -> np.ndarray:
    joined = b"".join(table.column("digest").to_pylist())
    return np.frombuffer(joined, "<u8").reshape(-1, 4)[:, :2]


def illegal_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ~((a == 1) & (b == 2) | (a == 2) & (b == 3) | (a == 3) & (b == 2))


def whole_conversations(table: pa.Table, keep_texts: bool) -> dict:
    """Columns of results of a table of whole conversations, sorted."""
    g = table.column("g").combine_chunks()
    new = np.r_[True, pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)]
    first = np.flatnonzero(new)
    names, n = g.take(pa.array(first)), len(first)
    live = ~_numbers(table, "gone", True)
    owner = (np.cumsum(new) - 1)[live]
    initial, fault, turn = _numbers(table, "initial")[live], _numbers(table, "fault")[live].copy(), _numbers(table, "turn")[live]
    known = table.column("turn").is_valid().to_numpy()[live]
    fault[(fault != BLANK) & seen_before(owner, _digests(table)[live])] = DUPLICATE

    count = lambda mask: np.bincount(owner[mask], minlength=n)
    length = np.bincount(owner, minlength=n)
    start = np.cumsum(length) - length
    pair = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    bad = np.r_[False, pair & illegal_pairs(initial[:-1], initial[1:])] if len(owner) else np.zeros(0, bool)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, owner[known], turn[known])
    np.maximum.at(high, owner[known], turn[known])
    fresh = known.copy()
    fresh[1:] &= ~(pair & known[:-1] & (turn[1:] == turn[:-1]))
    some = count(known) > 0
    gaps = np.where(some, np.where(some, high, 0) - np.where(some, low, 0) + 1 - count(fresh), 0)

    cost, audits = np.zeros(n, np.int64), [""] * n
    bucket = np.where(length > 0, np.frexp(np.maximum(length - 1, 0.5))[1], -1)  # lengths up to a power of two
    for b in np.unique(bucket[bucket >= 0]):
        own = np.flatnonzero(bucket == b)
        steps = np.arange(length[own].max())
        at = np.minimum(start[own] + steps[:, None], len(owner) - 1)
        f, i = fault[at], initial[at]
        costs = backward(f, i, length[own], np.broadcast_to(END, (len(own), 4)))
        edits, _ = trace(costs, f, i, length[own], np.zeros(len(own), np.int64), True)
        cost[own] = costs[0, :, 0]
        for k, row in zip(own.tolist(), edits):
            audits[k] = row[row > 0].tobytes().decode()
    rows = table.filter(pa.array(live))
    roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
    shas, turns = [], []
    for k in range(n):
        s, e = int(start[k]), int(start[k] + length[k])
        made = list(applied(audits[k], 0, roles[s:e], texts[s:e]))
        shas.append(hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
        turns.append([{"role": r, "text": t} for r, t in made] if keep_texts else None)
    return {"g": names, "whole": [True] * n, "gaps": gaps, "blank": count(fault == BLANK), "duplicate": count(fault == DUPLICATE), "truncated": count(fault == TRUNCATED),
            "illegal": count(bad), "cost": cost, "audit": audits, "repaired_sha256": shas, "turns": turns}


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, turns array<struct<role string, text string>>"
CARRIED = "turn long, role string, text string, digest binary, fault int, initial int, gone boolean"
STAGED = f"g string, whole boolean, part int, piece int, pos long, {RESULT}, {CARRIED}"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _staged_schema() -> pa.Schema:
    fields = []
    for x in STAGED.replace("array<struct<role string, text string>>", "turns").split(", "):
        name, kind = x.split()
        fields.append((name, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])) if kind == "turns" else _ARROW[kind]))
    return pa.schema(fields)


def _cutter(keep_texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, part, piece = _staged_schema(), TaskContext.get().partitionId(), 0
        held, broken = None, True  # broken: rows of the first conversation that is held may be elsewhere

        def filled(columns: dict, n: int) -> pa.RecordBatch:
            arrays = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema]
            arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
            return pa.RecordBatch.from_arrays([pa.array(a, f.type) if not isinstance(a, pa.Array) else a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

        def fragment(t: pa.Table) -> pa.RecordBatch:
            nonlocal piece
            piece += 1
            n = t.num_rows
            return filled({"whole": [False] * n, "part": [part] * n, "piece": [piece] * n, "pos": np.arange(n)} | {c: t.column(c) for c in t.column_names}, n)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            g = held.column("g").combine_chunks()
            cuts = np.flatnonzero(pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)) + 1
            if len(cuts):
                begin = 0
                if broken:
                    yield fragment(held.slice(0, int(cuts[0])))
                    begin, broken = int(cuts[0]), False
                inner = held.slice(begin, int(cuts[-1]) - begin)
                if inner.num_rows:
                    found = whole_conversations(inner, keep_texts)
                    yield filled(found, len(found["g"]))
                held = held.slice(int(cuts[-1]))
            if held.num_rows >= ROWS or held.nbytes >= BYTES:
                yield fragment(held)
                held, broken = None, True
        if held is not None and held.num_rows:
            yield fragment(held)

    return run


def _summary(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """What a fragment's rows add up to, and its matrix of least costs from state to state."""
    rows = rows.sort_values("pos")
    rows = rows[~rows["gone"]]
    fault, initial = rows["fault"].to_numpy(), rows["initial"].to_numpy()
    n = len(rows)
    ends = np.where(np.eye(4, dtype=bool), 0, FAR // 4)
    four = lambda x: np.repeat(x[:, None], 4, 1)
    matrix = backward(four(fault), four(initial), np.full(4, n), ends)[0].T  # [from, to]
    turns = rows["turn"].dropna().to_numpy().astype(object)
    pairs = int(illegal_pairs(initial[:-1], initial[1:]).sum()) if n else 0
    count = lambda x: int((fault == x).sum())
    out = [*key, n, int(initial[0]) if n else None, int(initial[-1]) if n else None, int(turns[0]) if len(turns) else None, int(turns[-1]) if len(turns) else None,
           len(set(turns.tolist())), count(BLANK), count(DUPLICATE), count(TRUNCATED), pairs, matrix.ravel().tolist()]
    return pd.DataFrame([out], columns=SUMMARY.replace("array<long>", "x").replace(" long", "").replace(" string", "").replace(" int", "").replace(" x", "").split(", ")).astype({"first_turn": "Int64", "last_turn": "Int64", "first": "Int64", "last": "Int64"})


SUMMARY = "g string, part int, piece int, n long, first int, last int, first_turn long, last_turn long, n_turns long, blank long, duplicate long, truncated long, illegal long, matrix array<long>"


def _ends(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each fragment of a conversation, the least costs after it; the conversation's figures stand at its first fragment."""
    rows = rows.sort_values(["part", "piece"]).reset_index(drop=True)
    ends, after = [None] * len(rows), END.astype(np.int64)
    for k in range(len(rows) - 1, -1, -1):
        ends[k] = after.tolist()
        after = (np.array(rows["matrix"][k]).reshape(4, 4) + after).min(1)
    live = rows[rows["n"] > 0]
    a, b = live["last"].to_numpy()[:-1].astype(int), live["first"].to_numpy()[1:].astype(int)
    timed = rows[rows["n_turns"] > 0]
    f, l = [int(x) for x in timed["first_turn"]], [int(x) for x in timed["last_turn"]]
    distinct = int(timed["n_turns"].sum()) - sum(x == y for x, y in zip(l[:-1], f[1:]))
    figures = {c: int(rows[c].sum()) for c in ("blank", "duplicate", "truncated")} | {"illegal": int(rows["illegal"].sum()) + int(illegal_pairs(a, b).sum()), "gaps": l[-1] - f[0] + 1 - distinct if f else 0, "cost": int(after[0])}
    return pd.DataFrame({"g": key[0], "part": rows["part"], "piece": rows["piece"], "ends": ends, "is_last": [k == len(rows) - 1 for k in range(len(rows))]} | {c: [v if k == 0 else 0 for k in range(len(rows))] for c, v in figures.items()})


ENDS = "g string, part int, piece int, ends array<long>, is_last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _traces(key: tuple, rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """A fragment's edits and last state from each of the four states that it may begin in."""
    rows = rows.sort_values("pos")
    rows = rows[~rows["gone"]]
    four = lambda x: np.repeat(x[:, None], 4, 1)
    fault, initial, length = four(rows["fault"].to_numpy()), four(rows["initial"].to_numpy()), np.full(4, len(rows))
    costs = backward(fault, initial, length, np.broadcast_to(np.array(ends["ends"].iloc[0]), (4, 4)))
    edits, state = trace(costs, fault, initial, length, np.arange(4), bool(ends["is_last"].iloc[0]))
    return pd.DataFrame({"g": [key[0]], "part": [key[1]], "piece": [key[2]], "exits": [state.tolist()], "edits": [[r[r > 0].tobytes().decode() for r in edits]]})


def _entries(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The state that each fragment of a conversation begins in, and the edits from there."""
    rows, state, begins, audits = rows.sort_values(["part", "piece"]).reset_index(drop=True), 0, [], []
    for exits, edits in zip(rows["exits"], rows["edits"]):
        begins.append(state)
        audits.append(edits[state])
        state = int(exits[state])
    return pd.DataFrame({"g": key[0], "part": rows["part"], "piece": rows["piece"], "state": begins, "audit": audits})


def _pieces(key: tuple, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("pos")
    rows = rows[~rows["gone"]]
    made = list(applied(found["audit"].iloc[0], int(found["state"].iloc[0]), rows["role"].tolist(), rows["text"].tolist()))
    return pd.DataFrame({"g": [key[0]], "part": [key[1]], "piece": [key[2]], "audit": [found["audit"].iloc[0]], "n": [len(made)],
                         "lines": ["\n".join(f"{r}:{t}" for r, t in made)], "turns": [[{"role": r, "text": t} for r, t in made]]})


def _joined(keep_texts: bool):
    """Reads sorted pieces and gives a row a conversation; of the lines only a running digest is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, audit, sha, turns, any_ = None, [], None, [], False
        row = lambda: pd.DataFrame({"g": [now], "audit": ["".join(audit)], "repaired_sha256": [sha.hexdigest()], "turns": [turns if keep_texts else None]})
        for b in batches:
            for g, a, n, lines, made in zip(b["g"], b["audit"], b["n"], b["lines"], b["turns"]):
                if g != now:
                    if now is not None:
                        yield row()
                    now, audit, sha, turns, any_ = g, [], hashlib.sha256(), [], False
                audit.append(a)
                if n:
                    sha.update((("\n" if any_ else "") + lines).encode())
                    any_ = True
                if keep_texts:
                    turns += list(made)
        if now is not None:
            yield row()

    return run


def fragments_joined(fragments: DataFrame, keep_texts: bool) -> DataFrame:
    """Results of the conversations that lie in fragments."""
    key = ["g", "part", "piece"]
    place = F.struct("part", "piece", "pos")
    live = fragments.where("NOT gone")
    firsts = live.groupBy("g", "digest").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "digest", "place")
    slim = fragments.select(*key, "pos", "turn", "digest", "fault", "initial", "gone")
    again = F.col("place").isNotNull() & ~F.col("gone") & (F.col("fault") != BLANK) & (place != F.col("place"))
    light = stage(slim.join(stage(firsts, "firsts"), ["g", "digest"], "left").select(*key, "pos", "turn", "initial", "gone", F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault")), "turns")
    summaries = light.groupBy(*key).applyInPandas(_summary, SUMMARY)
    ends = stage(summaries.groupBy("g").applyInPandas(_ends, ENDS), "ends")
    traces = light.groupBy(*key).cogroup(ends.groupBy(*key)).applyInPandas(_traces, "g string, part int, piece int, exits array<long>, edits array<string>")
    entries = stage(traces.groupBy("g").applyInPandas(_entries, "g string, part int, piece int, state int, audit string"), "entries")
    pieces = fragments.select(*key, "pos", "role", "text", "gone").groupBy(*key).cogroup(entries.groupBy(*key)).applyInPandas(
        _pieces, "g string, part int, piece int, audit string, n long, lines string, turns array<struct<role string, text string>>")
    made = pieces.repartition("g").sortWithinPartitions(*key).mapInPandas(_joined(keep_texts), "g string, audit string, repaired_sha256 string, turns array<struct<role string, text string>>")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ends.groupBy("g").agg(*[F.sum(c).alias(c) for c in names]).join(made, "g").select("g", *names, "audit", "repaired_sha256", "turns")


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None, keep_texts: bool = True) -> DataFrame:
    """A row a conversation: its faults, the cost and letters of the cheapest edits, the repaired turns and their SHA-256.

    Rows are taken by turn (nulls first); rows of one turn by role, then by the SHA-256 of role and text.
    A row's first fault counts: blank, duplicate (role and text seen earlier), truncated (the last
    character that is no blank is not one of `.!?`).  Keep costs 0, Rerole 3, Delete 4 (blank and duplicate
    rows must go), Insert 3; a truncated row that stays adds 3.  Of equal costs the ASCII-least letters count.
    A null role or text is one space; rows with a null id are one conversation; rows of which gone_col is
    true only say that the conversation exists.  A conversation without rows has zeros, no edits and the digest
    of an empty text.  Repeated rows are duplicates.  Other columns are left out, whatever their names.  An
    empty table gives none.  Without keep_texts, `turns` is null: a conversation may then exceed what a row holds,
    but for its letters, which are one value.  Its lines pass one task as a stream, as SHA-256 has no parallel form.
    """
    kind = dict(rows.dtypes)[id_col]
    string = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    key = F.col(f"`{id_col}`")
    base = rows.select(
        F.when(key.isNull(), "n").otherwise(F.concat(F.lit("v"), key.cast("string"))).alias("g"), F.col(f"`{turn_col}`").cast("long").alias("turn"), string(role_col).alias("role"),
        string(text_col).alias("text"), (F.coalesce(F.col(f"`{gone_col}`"), F.lit(False)) if gone_col else F.lit(False)).alias("gone"))
    final: Column = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    initial = F.substring("role", 1, 1)
    base = base.select(
        "g", "turn", "role", "text", "gone", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("digest"),
        F.when(final == "", BLANK).when(final.isin(".", "!", "?"), NONE).otherwise(TRUNCATED).alias("fault"),
        F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0).alias("initial"), F.monotonically_increasing_id().alias("row"))
    order = ["g", "turn", "role", "digest", "row"]
    dealt = base.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    found = stage(dealt.mapInArrow(_cutter(keep_texts), STAGED), "conversations")
    results = [c.split()[0] for c in RESULT.split(", ") if " " in c and not c.startswith("text ")]
    whole = found.where("whole").select("g", *results)
    broken = fragments_joined(found.where("NOT whole").select("g", "part", "piece", "pos", *[c.split()[0] for c in CARRIED.split(", ")]), keep_texts)
    return whole.unionByName(broken).select(F.when(F.col("g") != "n", F.expr("substring(g, 2)").cast(kind)).alias(id_col), *results)
