import hashlib
import heapq
import random
import re
import zlib

import pytest

from spanloom.llm import conversation_repair as c


def cheapest(letters):
    """Shortest path over (rows done, role initials given out as a state); audits in full."""
    queue, seen = [(0, "", 0, "")], set()
    while queue:
        cost, audit, k, state = heapq.heappop(queue)  # state: last role given out
        if k == len(letters) and state in ("", "a"):
            return cost, audit
        if (k, state) in seen:
            continue
        seen.add((k, state))
        steps = [(2, "I", k, "a" if state == "u" else "u")]
        if k < len(letters):
            x = letters[k]
            steps.append((3, "D", k + 1, state))
            if x != "x":
                late = x.isupper()
                steps.append((2 + late, "R", k + 1, "a" if state == "u" else "u"))
                if (x.lower() == "s" and state == "") or (x.lower() == "u" and state != "u") or (x.lower() == "a" and state == "u"):
                    steps.append((late, "K", k + 1, x.lower()))
        for more, edit, to, into in steps:
            heapq.heappush(queue, (cost + more, audit + edit, to, into))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    out, left = [], damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, faults, letters = set(), [], ""
        for _, _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            known = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if fault in ("blank", "duplicate") else known.upper() if fault else known
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(letters)
        done, k, state = [], 0, ""
        for edit in audit:
            if edit == "I":
                state = "a" if state == "u" else "u"
                done.append(("user" if state == "u" else "assistant") + ":")
                continue
            _, _, role, text = mine[k]
            k += 1
            if edit == "K":
                state = role[0]
                done.append(f"{role}:{text}")
            elif edit == "R":
                state = "a" if state == "u" else "u"
                done.append(("user" if state == "u" else "assistant") + f":{text}")
        digest = hashlib.sha256("\n".join(done).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 kind", "2 digest", "3 audit", "4 dropped")
    return sorted((tuple(r) for r in c.repair(c.damaged(df)).collect()), key=str)


def test_layers_against_shortest_paths():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(0, 8))) for _ in range(3000)})
    assert list(c.answers(iter(words))) == [cheapest(w) for w in words]


def test_shared_prefixes_are_solved_once(monkeypatch):
    made = []
    monkeypatch.setattr(c, "layer", lambda above, letter, real=c.layer: made.append(letter) or real(above, letter))
    words = sorted(["uaua", "uaua", "uauu", "ua", "suua", "sua"])
    assert len(list(c.answers(iter(words)))) == 6
    assert len(made) == 5 + 5  # nodes of the trie: u a u a, u | s u a, u a


def test_a_long_signature():
    word = "sua" + "uaUxo" * 40_000
    (cost, audit), = c.answers(iter([word]))
    assert cost > 0 and sum(e != "I" for e in audit) == len(word)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    texts = ["", " \n", "Hello.", "Why", "So?\x0b", "Wait! no", "\x1f", " ", None, "Yes!", "é."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "ually"]
    rows = [
        (rng.choice([None, *range(60)]), rng.choice([None, *range(9), *range(9)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"{rng.random()}.")
        for _ in range(900)
    ]
    rows += rng.sample(rows, 60) + [(1000, None, "user", "Hi."), (1001, 10**15, "user", "Hi."), (1001, -(10**15), "assistant", "Yes.")]
    dropped = next(k for k in range(2000, 3000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    got = run(spark, rows)
    assert got == plain(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got


def test_edges(spark):
    assert run(spark, []) == []
    long_text = "word " * 400_000 + "end."
    rows = [(1, k, ("user", "assistant")[k % 2], long_text if k == 2 else f"Text {k}.") for k in range(3000)]
    assert run(spark, rows) == plain(rows)


def test_sql_agrees_with_the_plain_version():
    import duckdb

    rng = random.Random(9)
    texts = ["", " \n", "Hello.", "Why", "Wait! no", None, "Yes!", "é.", "a.\n"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for _ in range(300)]
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(con.execute(c.SQL).fetchall(), key=str) == plain(rows)
