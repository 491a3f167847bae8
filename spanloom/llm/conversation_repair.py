"""Conversation structure repair: faults of damaged conversations, and the cheapest edits to a well-formed one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_texts, materialise

#: How many crc32 remainders there are, and what the first five do.
DAMAGES, DROP, EMPTY, UNSTOP, REPEAT, TO_USER = 20, 0, 1, 2, 3, 4
RESPEAK, DELETE, INSERT, UNENDED = 2, 3, 2, 1
#: States of s?(ua)+ after what has been given out: nothing, s, a user's turn, an assistant's. The state that the next user's
#: or assistant's turn leads to, its role, and the states in which all may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT, ENDS = (USER, USER, ASSISTANT, USER), (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: A row's letter in a signature: x if it has to go, else its role's initial (o: any other), capital if truncated.
GONE = "x"


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, dropped: the rows after damage, those that it drops among them with dropped set. Nulls in
    role and text, and in what the damage is dealt by, count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn))), F.lit(DAMAGES))
    bare = F.when(kind == EMPTY, F.lit("")).when(kind == UNSTOP, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    return rows.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.when(kind == TO_USER, F.lit("user")).otherwise(space(role)).alias("role"),
        bare.alias("text"),
        (kind == DROP).alias("dropped"),
        F.explode(F.when(kind == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _moves() -> dict[str, list[tuple[int, str, int, int]]]:
    """By letter: from state, edits (insertions, then the row's own), cost, to state."""
    out = {}
    for letter in "suaoSUAO" + GONE:
        moves = out[letter] = []
        for state in range(4):
            at, edits, cost = state, "", 0
            for _ in range(3):  # further insertions only come back to a state
                moves.append((state, edits + "D", cost + DELETE, at))
                if letter != GONE:
                    late = UNENDED * letter.isupper()
                    kept = {"s": SYSTEM if at == START else None, "u": USER if at != USER else None, "a": ASSISTANT if at == USER else None}.get(letter.lower())
                    if kept is not None:
                        moves.append((state, edits + "K", cost + late, kept))
                    moves.append((state, edits + "R", cost + late + RESPEAK, NEXT[at]))
                at, edits, cost = NEXT[at], edits + "I", cost + INSERT
    return out


MOVES = _moves()


class Layer:
    """What one more row of a signature adds: for each state the cheapest cost, the state before and the edits since, and
    the state's place among the others in the order of the whole audits."""

    __slots__ = ("cost", "before", "edits", "place")

    def __init__(self, cost, before, edits, place):
        self.cost, self.before, self.edits, self.place = cost, before, edits, place


#: Before any row. Audits of a layer all end in a row's own edit, so none begins another and places suffice to compare them.
ROOT = Layer([0, None, None, None], [None] * 4, [""] * 4, [0, 0, 0, 0])


def layer(above: Layer, letter: str) -> Layer:
    best: list[tuple | None] = [None] * 4
    for state, edits, cost, to in MOVES[letter]:
        if above.cost[state] is not None:
            now = (above.cost[state] + cost, above.place[state], edits, state)
            if best[to] is None or now < best[to]:
                best[to] = now
    order = sorted((b[1:3], to) for to, b in enumerate(best) if b)
    place = [0] * 4
    for k, (_, to) in enumerate(order):
        place[to] = k
    return Layer([b and b[0] for b in best], [b and b[3] for b in best], [b and b[2] for b in best], place)


def answer(path: list[Layer]) -> tuple[int, str]:
    """Cost and audit at a terminal node, path being the layers from the root to it."""
    last, found = path[-1], []
    for state in range(4):
        at = state
        for k in range(3):
            if last.cost[state] is not None and at in ENDS and (at == ASSISTANT or state == START):
                found.append((last.cost[state] + INSERT * k, last.place[state], "I" * k, state))
            at = NEXT[at]
    cost, _, tail, state = min(found)
    parts = [tail]
    for one in reversed(path):
        parts.append(one.edits[state] or "")
        state = one.before[state]
    return cost, "".join(reversed(parts))


def answers(signatures: Iterator[str]) -> Iterator[tuple[int, str]]:
    """Cost and audit of each of the signatures, which come sorted: a walk over their prefix trie, of which only the path to
    the present node is held. A layer is made once for all signatures that share the prefix."""
    path, before, done = [ROOT], "", None
    for now in signatures:
        if done is None or now != before:
            same, most = 0, min(len(now), len(before))
            while same < most and now[same] == before[same]:
                same += 1
            del path[same + 1 :]
            for letter in now[same:]:
                path.append(layer(path[-1], letter))
            before, done = now, answer(path)
        yield done


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _signatures(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its rows in order: conv_id, signature and figures. Holds a letter a row."""
    conv, have = None, False
    state: dict = {}

    def fresh():
        return {"letters": [], "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "initial": None}

    def row():
        gaps = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
        return conv, "".join(state["letters"]), gaps, *(state[f] for f in FIGURES[1:])

    for batch in it:
        done = []
        for c, turn, initial, fault, dropped in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "initial", "fault", "dropped")), strict=True):
            if not have or c != conv:
                if have:
                    done.append(row())
                conv, have, state = c, True, fresh()
            if dropped:
                continue
            if turn is not None and turn != state["high"]:
                state["low"] = turn if state["low"] is None else state["low"]
                state["high"], state["turns"] = turn, state["turns"] + 1
            if fault:
                state[fault] += 1
            known = initial if initial in ("s", "u", "a") else "o"
            state["letters"].append(GONE if fault in ("blank", "duplicate") else known.upper() if fault else known)
            if state["initial"] is not None and state["initial"] + known not in ("su", "ua", "au"):
                state["illegal"] += 1
            state["initial"] = known
        if done:
            yield _batch(done)
    if have:
        yield _batch([row()])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, signature, *figures = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(signature), *(pa.array(f, pa.int64()) for f in figures)], names=["conv_id", "signature", *FIGURES])


def _solved(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds cost and audit to rows sorted by signature."""

    def coming():
        for batch in it:
            held.append(batch)
            yield from batch.column("signature").to_pylist()

    held: list[pa.RecordBatch] = []
    costs, audits = [], []
    for cost, audit in answers(coming()):
        costs.append(cost)
        audits.append(audit)
        if len(costs) == held[0].num_rows:
            batch = held.pop(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.int64()), pa.array(audits)], names=[*batch.schema.names, "cost", "audit"])
            costs, audits = [], []


def _written(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and the digest of the repaired conversation. A conversation's first row holds its audit, the others are its
    rows in order; texts are digested as they come."""
    conv, have, audit, at, state, digest, first = None, False, "", 0, START, None, True

    def put(role: str, text: str) -> None:
        nonlocal first
        digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
        first = False

    def insert() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = NEXT[state]
            put(ROLES[state], "")
            at += 1

    for batch in it:
        done = []
        for c, edits, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "audit", "role", "text")), strict=True):
            if edits is not None:
                if have:
                    insert()
                    done.append((conv, digest.hexdigest()))
                conv, have, audit, at, state, digest, first = c, True, edits, 0, START, hashlib.sha256(), True
                continue
            insert()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = SYSTEM if state == START and role.startswith("s") else NEXT[state]
                put(role, text)
            elif edit == "R":
                state = NEXT[state]
                put(ROLES[state], text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names=["conv_id", "repaired_sha256"])
    if have:
        insert()
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])


def repair(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text, dropped, as damaged() gives them. One row for every conv_id, of dropped rows too:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, as the query's contract words them.

    Faults and role initials of a conversation make a signature, a letter a row; conversations are sorted by signature and
    each task walks the prefix trie of its signatures (answers). Conversations of one signature may be dealt to many tasks.
    The rows of one conversation come to one task in order, as their digest is one pass over them; a task streams them
    and holds a letter a row, the length of its audit, so that memory is that of the longest result row. Texts are shuffled once.

    A null conv_id is a conversation of its own. Rows of one turn come in the order of role, then of the digest of the text;
    null turns come first. A conversation without rows: zeros, an empty audit, the digest of nothing. No rows at all: none.
    """
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text", "dropped")
    rows = rows.withColumn("digest", F.sha2("text", 256))
    space = r"[\x20\x09-\x0D]"
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    bare = rows.select("conv_id", "turn", "role", "digest", "dropped", blank.alias("bare"), (~F.col("text").rlike(rf"[.!?]{space}*\z")).alias("open"))
    bare = bare.repartition("conv_id")
    # dropped and blank rows repeat nothing that counts; the window's rows are those of a conversation already, so nothing is shuffled
    again = F.row_number().over(W.partitionBy("conv_id", "dropped", "bare", "role", "digest").orderBy("turn"))
    fault = F.when(F.col("bare"), "blank").when(F.col("nth") > 1, "duplicate").when(F.col("open"), "truncated")
    bare = bare.withColumn("nth", again).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "role", "digest", "nth", fault.alias("fault"), "dropped")
    ordered = bare.sortWithinPartitions("conv_id", "turn", "role", "digest", "nth").select("conv_id", "turn", "initial", "fault", "dropped")
    figures = ", ".join(f"{f} bigint" for f in FIGURES)
    signed = materialise(ordered.mapInArrow(_signatures, f"conv_id bigint, signature string, {figures}"), "signatures")
    by_signature = signed.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature")
    solved = materialise(by_signature.mapInArrow(_solved, f"conv_id bigint, signature string, {figures}, cost bigint, audit string"), "repairs")
    texts = rows.where("not dropped").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", F.lit(None).cast("string").alias("audit"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = solved.select("conv_id", F.lit(0).alias("kind"), null("bigint", "turn"), null("string", "role"), null("string", "digest"), null("string", "text"), "audit")
    both = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    digests = map_texts(both.select("conv_id", "audit", "role", "text"), _written, "conv_id bigint, repaired_sha256 string")
    digests = materialise(digests.select(F.col("conv_id").alias("of"), "repaired_sha256"), "digests")
    return solved.join(digests, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", *FIGURES, "cost", "audit", "repaired_sha256")


def _sql() -> str:
    """The same in SQL (of DuckDB), row by row: s0 .. s3 are the cheapest cost, audit and repaired lines by state."""
    inserted = lambda x, to: f"{{'c': {x}.c + {INSERT}, 'a': {x}.a || 'I', 'r': list_append({x}.r, '{ROLES[to]}:')}}"
    edited = lambda x, edit, cost, line=None: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}', 'r': {f'list_append({x}.r, {line})' if line else f'{x}.r'}}}"
    if_ = lambda condition, value: f"case when {condition} then {value} else {never} end"
    never = "{'c': 1000000000000::bigint, 'a': '', 'r': []::varchar[]}"
    keep = lambda x, letter: if_(f"not gone and letter = '{letter}'", edited(x, "K", "late", "role || ':' || text"))
    speak = lambda x, to: if_("not gone", edited(x, "R", f"late + {RESPEAK}", f"'{ROLES[to]}:' || text"))
    delete = lambda x: edited(x, "D", DELETE)
    least = lambda *x: f"list_min([{', '.join(x)}])"
    close = lambda source, kept: (
        f"(select {kept}, s0, s1, {least('s2', *(inserted(x, USER) for x in ('s0', 's1', 's3')))} s2, {least('s3', inserted('s2', ASSISTANT))} s3 from {source})"
    )
    after = (
        delete("s0"),
        least(delete("s1"), keep("s0", "s")),
        least(delete("s2"), *(keep(x, "u") for x in ("s0", "s1", "s3")), *(speak(x, USER) for x in ("s0", "s1", "s3"))),
        least(delete("s3"), keep("s2", "a"), speak("s2", ASSISTANT)),
    )
    return f"""
with recursive k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') key from conversations
), h as (
  select *, xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(key, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end)) % {DAMAGES} kind from k
), d as (
  select conv_id, turn, case when kind = {TO_USER} then 'user' else role end as role,
    case kind when {EMPTY} then '' when {UNSTOP} then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when kind = {REPEAT} then [0, 1] else [0] end) from h where kind <> {DROP}
), convs as materialized (select conv_id, row_number() over () g from (select distinct conv_id from conversations)
), o as (select g, turn, role, text, row_number() over (partition by g order by turn nulls first, role, sha256(text)) i from d join convs on convs.conv_id is not distinct from d.conv_id
), f as (
  select *, left(role, 1) letter, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when row_number() over (partition by g, role, text order by i) > 1 then 'duplicate'
    when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then 'truncated' else '' end fault from o
), r as materialized (
  select *, fault in ('blank', 'duplicate') gone, case when fault = 'truncated' then {UNENDED} else 0 end late, lag(letter) over (partition by g order by i) || letter pair from f
), figures as (
  select g, max(turn) - min(turn) + 1 - count(distinct turn) gaps, count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') "duplicate",
    count(*) filter (fault = 'truncated') truncated, count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) illegal, max(i) n from r group by g
), dp as (
  select g, 0::bigint i, {{'c': 0::bigint, 'a': '', 'r': []::varchar[]}} s0, {never} s1, {never} s2, {never} s3 from convs
  union all
  select x.g, r.i, {", ".join(f"{a} s{k}" for k, a in enumerate(after))}
  from {close(close("dp", "g, i"), "g, i")} x join r on r.g = x.g and r.i = x.i + 1
), ends as (select g, i, {least("s0", "s3")} best from {close(close("dp", "g, i"), "g, i")})
select conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce("duplicate", 0) "duplicate", coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
  best.c as cost, best.a as audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) repaired_sha256
from convs join ends using (g) left join figures using (g) where ends.i = coalesce(figures.n, 0)
"""


SQL = _sql()
