"""Conversation structure repair: the cheapest edits that give the roles `(s?(ua)+)?`, and of these the audit least in ASCII.

Rows of a conversation are in order of turn (null first), role, text. What a role may follow depends on one
of four states: nothing yet, after s, after u, after a. Deleting a row keeps the state; keeping or
reroling a row, or inserting one, goes to the state of its role. A state allows one user or assistant role at
most, so the edits that leave a node (a place between rows, and a state) have different letters.

1. A cost pass from the last row to the first gives each node its distance from a permitted end. Inserts
   cost something and consume no row, so two in a row are all that can help, and both ends of a step are known.
2. Arcs that keep the distances are the optimal ones. Each is ranked by the letters of the least audit that
   begins with it: by the first letter, then by pairs of ranks for 2, 4, 8 ... letters, where a pointer leads
   from an arc to the arc that follows 1, 2, 4 ... letters later on its least audit (the end follows itself).
3. Of the arcs that leave a conversation's first node, the one of least rank begins its audit; doubled
   pointers give the arcs at even places, those at odd places, and so on down to all of them.

The passes run over many conversations at once, on a few numbers a row: Python sees no text. A conversation's
repaired text and audit meet in one row, as their digests do. Its first RUN_TURNS turns go there directly;
later ones, and those without a number, are sorted in runs of RUN_TURNS before.

Null texts, roles and turns count as one blank where a text is made of them. A null conv_id is one
conversation. Repeated rows are duplicates. A conversation all of whose rows are dropped keeps its row. An
empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sql_crc32, table

RUN_TURNS = 64
#: Costs of the edits, and what each truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = r"\x20\x09-\x0D"
_FAR = 1 << 40
#: States: nothing yet, after s, after u, after a; the role that is wanted next, and the state that it leads to.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
USER, ASSISTANT = "user", "assistant"
NEXT = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])
#: What ends an audit is less than any letter.
_END, _D, _I, _K, _R = range(5)
LETTERS = np.array(["", "D", "I", "K", "R"])


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, `copies`: what is left after faults that depend on the CRC of `conv_id:turn`."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(named.cast("binary")) % 20
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        role.alias("role_before"),
        text.alias("text_before"),
        F.when(kind == 4, USER).otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def gathered_rows(rows: DataFrame) -> DataFrame:
    """conv_id, and `rows`: its rows in order, an array of (turn, ..., role, text); dropped ones are left out."""
    least = F.lit(-(2**63))
    turn = F.coalesce("turn", least)
    row = F.struct(turn.alias("turn"), "role_before", "text_before", "role", "text")
    copied = rows.select("conv_id", F.coalesce(F.floor(F.col("turn") / RUN_TURNS), least).alias("run"), F.explode_outer(F.array_repeat(row, F.col("copies"))).alias("row"))
    one = F.when(F.col("row").isNotNull(), F.array("row")).otherwise(F.slice(F.array("row"), 1, 0))
    first = copied.where("run = 0").select("conv_id", "run", one.alias("rows"))
    later = copied.where("run != 0").groupBy("conv_id", "run").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    runs = F.array_sort(F.collect_list(F.struct("run", "rows")))
    return first.unionByName(later).groupBy("conv_id").agg(runs.alias("runs")).select("conv_id", F.flatten("runs.rows").alias("rows"))


def codes(rows: Column) -> list[Column]:
    """What the passes need of each row: the kind of its role (1 s, 2 u, 3 a, 0 else), its faults, and what equal rows share."""
    kind = lambda r: F.when(F.startswith(r, F.lit("s")), 1).when(F.startswith(r, F.lit("u")), 2).when(F.startswith(r, F.lit("a")), 3).otherwise(0)
    last = lambda t: F.right(F.rtrim(t, F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    same = lambda r: F.sha2(F.concat(F.length(r["role"]).cast("string"), F.lit(":"), r["role"], r["text"]), 256)
    return [F.transform(rows, f) for f in (lambda r: kind(r["role"]), lambda r: last(r["text"]) == "", lambda r: ~last(r["text"]).isin(".", "!", "?"), same)]


def _distances(kinds: np.ndarray, must: np.ndarray, cut: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each node the cost of the cheapest edits to a permitted end; conversations have one node place more than rows."""
    places = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    firsts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    far = np.full((int((sizes + 1).sum()), 4), _FAR, dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")  # the longest first, so those that still have rows are a beginning
    have = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0) + 1), side="right")  # how many have so many rows
    for back in range(int(sizes.max(initial=0)) + 1):
        mine = order[: have[back]]
        here = places[mine] + sizes[mine] - back
        if back == 0:
            step = np.full((len(mine), 4), _FAR, dtype=np.int64)
            step[:, [START, AFTER_A]] = 0
        else:
            row, after = firsts[mine] + sizes[mine] - back, far[here + 1]
            stay = np.where(must[row], _FAR, TRUNCATED * cut[row])[:, None]
            forced = REROLE + after[:, NEXT]
            keep = np.where(kinds[row][:, None] == NEXT, after[:, NEXT], _FAR)
            keep[:, START] = np.where(kinds[row] == AFTER_S, after[:, AFTER_S], keep[:, START])
            step = np.minimum(DELETE + after, stay + np.minimum(forced, keep))
        # One insert, or two: each leads to what can be reached from there without another insert of the same role.
        far[here] = step
        far[here, AFTER_U] = np.minimum(step[:, AFTER_U], INSERT + step[:, AFTER_A])
        far[here, AFTER_A] = np.minimum(step[:, AFTER_A], INSERT + step[:, AFTER_U])
        for s in (START, AFTER_S):
            far[here, s] = np.minimum(step[:, s], INSERT + far[here, AFTER_U])
    return far


def _optimal_arcs(kinds: np.ndarray, must: np.ndarray, cut: np.ndarray, sizes: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, letter and target node of each arc that a cheapest way may take, in order of node and letter. Node: place * 4 + state."""
    places = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    place = np.arange(len(kinds)) + np.repeat(np.arange(len(sizes)), sizes)  # of the node before each row
    from_, letter, to = [], [], []

    def add(at: np.ndarray, state: int, kind: int, target: np.ndarray, cost: np.ndarray | int, allowed: np.ndarray | bool) -> None:
        ok = allowed & (far[at, state] < _FAR) & (far[at, state] == cost + far.ravel()[target])
        from_.append((at * 4 + state)[ok])
        to.append(target[ok])
        letter.append(np.full(int(ok.sum()), kind))

    every, stay = np.arange(len(far)), TRUNCATED * cut
    for s in range(4):
        add(place, s, _D, (place + 1) * 4 + s, DELETE, True)
        add(every, s, _I, every * 4 + NEXT[s], INSERT, True)
        add(place, s, _R, (place + 1) * 4 + NEXT[s], REROLE + stay, ~must)
        add(place, s, _K, (place + 1) * 4 + NEXT[s], stay, ~must & (kinds == NEXT[s]))
    add(place, START, _K, (place + 1) * 4 + AFTER_S, stay, ~must & (kinds == AFTER_S))
    ends = places + sizes
    for s in (START, AFTER_A):  # the end follows itself
        from_.append(ends * 4 + s)
        to.append(ends * 4 + s)
        letter.append(np.full(len(ends), _END))
    node, letter, to = np.concatenate(from_), np.concatenate(letter), np.concatenate(to)
    order = np.lexsort((letter, node))
    return node[order], letter[order], to[order]


def least_audits(first_nodes: np.ndarray, node: np.ndarray, letter: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(conversation, arc) of the least audits, in order. Arcs are ranked by their least audits of 1, 2, 4 ... letters.

    Arcs are sorted by node and letter; those of a node differ in their letters, so the least audit of so
    many letters has one arc at each place, and one pointer for each arc is enough."""
    rank, pointers = letter.astype(np.int64), [np.searchsorted(node, to)]  # the arc of the least letter that leaves the target
    while (letter[pointers[-1]] != _END).any():
        ahead = pointers[-1]
        rank = np.unique(rank * (rank.max() + 1) + rank[ahead], return_inverse=True)[1].reshape(-1)
        pointers.append(ahead[ahead])
    begin = np.searchsorted(node, first_nodes)
    count = np.searchsorted(node, first_nodes, side="right") - begin
    tried = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    whose = np.repeat(np.arange(len(first_nodes)), count)
    best = np.lexsort((rank[tried], whose))
    arcs, owner = tried[best][np.searchsorted(whose, np.arange(len(first_nodes)))], np.arange(len(first_nodes))
    for ahead in reversed(pointers):
        arcs, owner = np.stack([arcs, ahead[arcs]], axis=1).ravel(), np.repeat(owner, 2)
        live = letter[arcs] != _END
        arcs, owner = arcs[live], owner[live]
    return owner, arcs


def _unseen(same: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """False for a row whose role and text an earlier one of its conversation has."""
    return ~pd.DataFrame({"o": owner, "s": same}).duplicated().to_numpy()


_PLAN = "cost long, audit string, blank long, duplicate long, truncated long, illegal long, plan array<struct<row:int,role:string>>"


def repaired_batch(kinds: pd.Series, blank: pd.Series, cut: pd.Series, same: pd.Series) -> pd.DataFrame:
    """For each conversation its cost, audit and counts, and `plan`: for each row of the repaired one the row
    it comes from (-1: inserted) and its new role (null: its own)."""
    sizes = kinds.map(len).to_numpy("int64")
    flat = lambda s, kind: np.concatenate([np.empty(0, kind), *s]).astype(kind)
    kinds, blank, cut = flat(kinds, np.int64), flat(blank, bool), flat(cut, bool)
    owner, count = np.repeat(np.arange(len(sizes)), sizes), lambda flags: np.bincount(owner[flags], minlength=len(sizes))
    repeated = ~_unseen(flat(same, object), owner) & ~blank
    must, cut = blank | repeated, cut & ~blank & ~repeated
    pair = owner[1:] == owner[:-1]
    legal = ((kinds[:-1] == 1) & (kinds[1:] == 2)) | ((kinds[:-1] == 2) & (kinds[1:] == 3)) | ((kinds[:-1] == 3) & (kinds[1:] == 2))
    illegal = np.bincount(owner[1:][pair & ~legal], minlength=len(sizes))
    far = _distances(kinds, must, cut, sizes)
    places = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    node, letter, to = _optimal_arcs(kinds, must, cut, sizes, far)
    whose, arcs = least_audits(places * 4 + START, node, letter, to)
    letters, state = letter[arcs], to[arcs] % 4
    row = node[arcs] // 4 - places[whose]  # the place before a row has its number
    made = letters != _D
    new_role = np.where(state == AFTER_U, USER, ASSISTANT).astype(object)
    new_role[letters == _K] = None
    source = np.where(letters == _I, -1, row)
    bounds = np.searchsorted(whose, np.arange(len(sizes) + 1))
    audit = ["".join(LETTERS[letters[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    plan = [[{"row": int(r), "role": x} for r, x in zip(source[a:b][made[a:b]], new_role[a:b][made[a:b]], strict=True)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pd.DataFrame({"cost": far[places, START], "audit": audit, "blank": count(blank), "duplicate": count(repeated), "truncated": count(cut), "illegal": illegal, "plan": plan})


def repair_plans(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield repaired_batch(*batch)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, and `messages`: role and text of the repaired conversation."""
    made = gathered_rows(rows).withColumn("p", F.pandas_udf(repair_plans, _PLAN)(*codes(F.col("rows"))))
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t > -(2**63))
    gaps = F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0)).cast("long")
    old = lambda s: F.get(F.col("rows"), s["row"])  # noqa: E731  null before the first
    messages = F.transform("p.plan", lambda s: F.struct(F.coalesce(s["role"], old(s)["role"]).alias("role"), F.coalesce(old(s)["text"], F.lit("")).alias("text")))
    return made.select("conv_id", gaps.alias("gaps"), *[F.col(f"p.{c}").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")], messages.alias("messages"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repaired(damaged(table(spark, sf_dir, "conversations")))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    return out.withColumn("repaired_sha256", F.sha2(said, 256)).drop("messages")


def _sql_ways(x: str) -> str:
    """DuckDB: the fold's step over a row `x`. s.w holds, for each state, the least (key, text), where a key is
    the cost in ten digits and the audit after it; two equally cheap ways to a node never begin alike."""
    key = lambda w, cost, letter: f"lpad((left({w}.k, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({w}.k, 11) || '{letter}'"
    way = lambda w, cost, letter, more="''": f"{{'k': {key(w, cost, letter)}, 't': {w}.t || {more}}}"
    least = lambda *ways: f"list_sort([{', '.join(ways)}])[1]"
    said = lambda role: f"chr(10) || {role} || ':' || {x}.text"
    never = lambda cost, ok: f"(CASE WHEN {ok} THEN {cost} ELSE 1000000000 END)"
    stay = f"CASE WHEN {x}.cut THEN {TRUNCATED} ELSE 0 END"
    w = [f"s.w[{k + 1}]" for k in range(4)]
    forced, kept = never(f"{REROLE} + {stay}", f"NOT {x}.must"), lambda kind: never(stay, f"NOT {x}.must AND {x}.kind = {kind}")
    into = [
        [way(w[0], DELETE, "D")],
        [way(w[1], DELETE, "D"), way(w[0], kept(1), "K", said(f"{x}.role"))],
        [way(w[2], DELETE, "D"), *[y for k in (0, 1, 3) for y in (way(w[k], kept(2), "K", said(f"{x}.role")), way(w[k], forced, "R", said("'user'")))]],
        [way(w[3], DELETE, "D"), way(w[2], kept(3), "K", said(f"{x}.role")), way(w[2], forced, "R", said("'assistant'"))],
    ]
    return "[" + ", ".join(least(*ways) for ways in into) + "]"


def _sql_inserts(w: str) -> str:
    """DuckDB: the same states after up to two inserts."""
    way = lambda k, letters, text: f"{{'k': lpad((left({w}[{k}].k, 10)::BIGINT + {INSERT * len(letters)})::VARCHAR, 10, '0') || substr({w}[{k}].k, 11) || '{letters}', 't': {w}[{k}].t || {text}}}"
    user, both, other = "chr(10) || 'user:'", "chr(10) || 'user:' || chr(10) || 'assistant:'", "chr(10) || 'assistant:'"
    third = ", ".join([f"{w}[3]", *[way(k, "I", user) for k in (1, 2, 4)]])
    fourth = ", ".join([f"{w}[4]", way(3, "I", other), *[way(k, "II", both) for k in (1, 2)]])
    return f"[{w}[1], {w}[2], list_sort([{third}])[1], list_sort([{fourth}])[1]]"


_NO_WAY = "{'k': '1000000000', 't': ''}"

#: A fold from the first row on, which carries the least way to each state; nothing is ranked.
OP12_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0,
    {sql_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault FROM conversations
), b AS (
  SELECT conv_id, turn, role0, text0, CASE WHEN fault = 4 THEN 'user' ELSE role0 END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text
  FROM c, LATERAL (SELECT unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END))) WHERE fault <> 0
), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, text0) AS place FROM b
), f AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open_end, lag(role) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM r
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (open_end AND NOT blank AND NOT again) AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'kind': CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END, 'must': blank OR again, 'cut': open_end, 'role': role, 'text': text}} ORDER BY place) AS rows_
  FROM f GROUP BY conv_id
), w AS (
  SELECT *, list_reduce(list_prepend({{'kind': -1, 'must': false, 'cut': false, 'role': '', 'text': '', 'w': [{{'k': '0000000000', 't': ''}}, {_NO_WAY}, {_NO_WAY}, {_NO_WAY}]}},
      list_transform(rows_, lambda x: {{'kind': x.kind, 'must': x.must, 'cut': x.cut, 'role': x.role, 'text': x.text, 'w': [{_NO_WAY}, {_NO_WAY}, {_NO_WAY}, {_NO_WAY}]}})),
    lambda s0, x: {{'kind': 0, 'must': false, 'cut': false, 'role': '', 'text': '', 'w': [{{'w': {_sql_inserts("s0.w")}}}].list_transform(lambda s: {_sql_ways("x")})[1]}}).w AS ways FROM g
), e AS (SELECT *, list_sort([ways[1], {_sql_inserts("ways")}[4]])[1] AS best FROM w)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(best.k, 10)::BIGINT, 0) AS cost, coalesce(substr(best.k, 11), '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""
