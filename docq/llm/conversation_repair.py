"""Repair of conversations: the cheapest edits that give turns a legal order.

A conversation is legal when the initials of its roles are ``(s?(ua)+)?``.
Edits go over its rows in order: K keeps a row, R gives it another role (user
or assistant), D deletes it, I inserts an empty turn.  A cost table over (rows
consumed, state of the pattern) gives the least cost; the edits on some
cheapest way are its optimal arcs.  Of all cheapest ways the one with the least
string of initials is wanted.  Arcs are ranked by the strings of 1, 2, 4, ...
initials that begin with them, each round from two ranks of the round before,
and carry a pointer to the arc that follows after so many; the least-ranked arc
of the start and the doubled pointers then give the whole way.

All conversations of a batch are worked on at once with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = np.array(list("DIKR"))
D, I, K, R = range(4)
ROW_COST = {"D": 3, "I": 2, "K": 0, "R": 2}
#: States of the pattern: nothing yet, after s, after u, after a.
FROM_USER = (0, 1, 3)
#: Rows of whole conversations worked on at once.
BATCH_ROWS = 8192
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

REPAIRED = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"
)


def cost_to_go(last: np.ndarray, n: np.ndarray, kind: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """(places, 4): least cost from each place (rows consumed, state) to a legal end.

    last: the place after the last row of each conversation; n: its rows.  kind
    (0 s, 1 u, 2 a, 3 other) and fault stand at the places before their rows.
    """
    f = np.zeros((len(kind), 4), dtype=np.int64)
    order = np.argsort(-n, kind="stable")
    most = -n[order]
    for back in range(int(n.max(initial=0)) + 1):
        at = last[order[: np.searchsorted(most, -back, "right")]] - back
        if back == 0:
            g = np.full((len(at), 4), 1 << 40, dtype=np.int64)
            g[:, 0] = g[:, 3] = 0
        else:
            then, k = f[at + 1], kind[at]
            g = then + ROW_COST["D"]
            lost = np.where((fault[at] == BLANK) | (fault[at] == DUPLICATE), 1 << 40, fault[at] == TRUNCATED)
            user, assistant = then[:, 2] + lost + np.where(k == 1, 0, ROW_COST["R"]), then[:, 3] + lost + np.where(k == 2, 0, ROW_COST["R"])
            for q in FROM_USER:
                np.minimum(g[:, q], user, out=g[:, q])
            np.minimum(g[:, 2], assistant, out=g[:, 2])
            g[:, 0] = np.minimum(g[:, 0], np.where(k == 0, then[:, 1] + lost, 1 << 40))
        g[:, 2] = np.minimum(g[:, 2], g[:, 3] + ROW_COST["I"])
        for q in FROM_USER:
            np.minimum(g[:, q], g[:, 2] + ROW_COST["I"], out=g[:, q])
        f[at] = g
    return f


def optimal_arcs(f: np.ndarray, kind: np.ndarray, fault: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from node, label, to node) of the edits on cheapest ways; node = 4 * place + state.
    ends: whether a place is after its conversation's last row."""
    place = np.arange(len(kind))
    then = np.vstack((f[1:], np.zeros((1, 4), np.int64)))
    kept = ~ends & (fault != BLANK) & (fault != DUPLICATE)
    extra = (fault == TRUNCATED).astype(np.int64)
    out = []

    def add(label: int, q: int, to: int, forward: int, ok: np.ndarray, cost):
        target = then[:, to] if forward else f[:, to]
        good = np.flatnonzero(ok & (f[:, q] == cost + target))
        out.append((4 * good + q, np.full(len(good), label), 4 * (good + forward) + to))

    always = np.ones(len(place), dtype=bool)
    for q in range(4):
        to = 3 if q == 2 else 2
        add(D, q, q, 1, ~ends, ROW_COST["D"])
        add(I, q, to, 0, always, ROW_COST["I"])
        add(K, q, to, 1, kept & (kind == to - 1), extra)
        add(R, q, to, 1, kept & (kind != to - 1), extra + ROW_COST["R"])
    add(K, 0, 1, 1, kept & (kind == 0), extra)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def least_paths(source: np.ndarray, label: np.ndarray, target: np.ndarray, starts: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """The way of least labels from each start: (lengths, arcs of all ways in order).

    Labels are small numbers; no two arcs of a node have one label, and no way is
    endless.  Item `arcs` stands for the end: rank 0, followed by itself.
    """
    arcs = len(source)
    rank = np.append(label + 1, 0)
    # The least-ranked arc of each node; ranks of the first round are the labels.
    best = np.full(nodes, arcs)
    order = np.lexsort((label, source))
    first = np.append(True, source[order][1:] != source[order][:-1]) if arcs else np.zeros(0, bool)
    best[source[order[first]]] = order[first]
    pointer, steps = [np.append(best[target], arcs)], np.append(np.ones(arcs, np.int64), 0)
    while (pointer[-1] != arcs).any():
        p = pointer[-1]
        _, rank = np.unique(rank * (arcs + 8) + rank[p], return_inverse=True)
        steps = steps + steps[p]
        pointer.append(p[p])
    # Of the arcs that leave a start, the one whose whole string is least.
    at = np.full(nodes, arcs)
    order = np.lexsort((rank[:arcs], source))
    first = np.append(True, source[order][1:] != source[order][:-1]) if arcs else np.zeros(0, bool)
    at[source[order[first]]] = order[first]
    begin = at[starts]
    length = steps[begin]
    way = np.repeat(begin, length)
    ahead = np.arange(len(way)) - np.repeat(np.cumsum(length) - length, length)
    for k, p in enumerate(pointer):
        move = (ahead >> k) & 1 == 1
        way[move] = p[way[move]]
    return length, way


def solve(n: np.ndarray, kind: np.ndarray, fault: np.ndarray):
    """Conversations of n rows each, one after another: (cost, lengths of the audits,
    labels, rows the edits are at, roles they give: 1 user, 2 assistant)."""
    last = np.cumsum(n + 1) - 1
    ends = np.zeros(int((n + 1).sum()), dtype=bool)
    ends[last] = True
    k, x = np.full(len(ends), 3), np.zeros(len(ends), dtype=np.int64)
    k[~ends], x[~ends] = kind, fault
    f = cost_to_go(last, n, k, x)
    source, label, target = optimal_arcs(f, k, x, ends)
    starts = 4 * (last - n)
    length, way = least_paths(source, label, target, starts, 4 * len(ends))
    row = source[way] // 4
    row -= np.repeat(np.arange(len(n)), length)  # one place more than rows in each conversation
    return f[starts // 4, 0], length, label[way], row, target[way] % 4 - 1


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole conversations, of about BATCH_ROWS rows or of one conversation."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        key = np.stack((ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()))
        change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if before is not None and (before != key[:, 0]).any():
            change = np.append(0, change)
        before = key[:, -1]
        if len(change) and sum(b.num_rows for b in held) + int(change[-1]) >= BATCH_ROWS:
            held.append(batch.slice(0, int(change[-1])))
            yield pa.Table.from_batches(held)
            held = [batch.slice(int(change[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, turn, role, text, gone, kind, fault in order of conversation and turn."""
    for table in _conversations(batches):
        ids, turn, role, text, gone, kind, fault = (c.combine_chunks() for c in table.columns)
        null, value = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        opens = np.append(True, (null[1:] != null[:-1]) | (value[1:] != value[:-1]))
        conv = np.cumsum(opens) - 1
        there = np.flatnonzero(~gone.to_numpy(zero_copy_only=False))
        names = ids.take(pa.array(np.flatnonzero(opens)))
        m, conv = len(names), conv[there]
        roles, texts = role.take(pa.array(there)).to_pylist(), text.take(pa.array(there)).to_pylist()
        kind, fault = kind.to_numpy()[there], fault.to_numpy()[there].astype(np.int64)
        seen = set()
        for i, row in enumerate(zip(conv.tolist(), roles, texts, strict=True)):
            if fault[i] != BLANK:
                if row in seen:
                    fault[i] = DUPLICATE
                else:
                    seen.add(row)
        n = np.bincount(conv, minlength=m)
        cost, length, label, row, to = solve(n, kind, fault)

        turns = turn.take(pa.array(there))
        valid = turns.is_valid().to_numpy(zero_copy_only=False)
        t, c = turns.fill_null(0).to_numpy()[valid], conv[valid]
        gaps = np.zeros(m, dtype=np.int64)
        if len(t):
            head = np.append(True, c[1:] != c[:-1])
            tail = np.append(head[1:], True)
            distinct = np.bincount(c[head | np.append(True, t[1:] != t[:-1])], minlength=m)
            gaps[c[head]] = t[tail] - t[head] + 1 - distinct[c[head]]
        same = conv[1:] == conv[:-1]
        legal = np.isin(kind[:-1] * 4 + kind[1:], (1, 6, 9))  # su, ua, au
        illegal = np.bincount(conv[1:][same & ~legal], minlength=m) if len(conv) else np.zeros(m, np.int64)
        faults = [np.bincount(conv[fault == x], minlength=m) for x in (BLANK, DUPLICATE, TRUNCATED)]

        bounds = np.append(0, np.cumsum(length))
        marks = "".join(LABELS[label])
        audit = [marks[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        kept = np.flatnonzero(label != D)
        new = ("", "user", "assistant")
        out_role = [roles[row[i]] if label[i] == K else new[to[i]] for i in kept]
        out_text = ["" if label[i] == I else texts[row[i]] for i in kept]
        turns_out = pa.StructArray.from_arrays([pa.array(out_role, pa.string()), pa.array(out_text, pa.string())], names=["role", "text"])
        repaired = pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, bounds), pa.int32()), turns_out)
        numbers = [pa.array(x.astype(np.int64)) for x in (gaps, *faults, illegal, cost)]
        yield pa.RecordBatch.from_arrays(
            [names, *numbers, pa.array(audit, pa.string()), repaired],
            names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"],
        )


def repair(turns: DataFrame, gone: Column | None = None) -> DataFrame:
    """One row for each conversation: conv_id; gaps (turn numbers missing between
    its first and last); blank, duplicate, truncated (rows by their first fault);
    illegal (neighbouring rows whose roles may not follow each other); cost; audit
    (the initials of the cheapest edits, of equal ones the least string); repaired
    (its turns after the edits: role, text).

    Blank: no character but white space.  Duplicate: role and text of an earlier
    row.  Truncated: the last character but white space is none of ``.!?``.  Blank and duplicate
    rows must be deleted (3 each, as any row); R and I cost 2; a truncated row
    that stays costs 1 more.

    turns: conv_id, turn, role, text; other columns are not read.  Rows where
    `gone` is true are not there, but their conversation is answered (zeros, an
    empty audit and no turns, where nothing else is left of it).  Rows go by turn, nulls first;
    ties and repeated rows by role, then text.  A null role or text is one space.
    Rows with a null conv_id are one conversation.  A role with another initial
    than s, u, a (case counts) cannot stay.  An empty table gives no rows.

    Rows of a conversation go through one task, which holds one conversation at a
    time: that is the bound, as the repaired conversation is one value.
    """
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"),
    )
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(0)
    ready = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ready.select("*", kind.cast("int").alias("kind"), fault.cast("int").alias("fault")).mapInArrow(_repair, REPAIRED)
