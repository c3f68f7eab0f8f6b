import hashlib
import heapq
import random
import zlib

import pytest

from clickweir.llm import conversations

DDL = "conv_id long, turn long, role string, text string, size string, alive string, seq int, cost string, audit double, fault string"
SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults_of(rows):
    seen, faults = set(), []
    for _, _, role, text in rows:
        kept = text.rstrip(SPACES)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return faults


def search(rows, faults):
    """Cheapest audit, least by ASCII, by search over all edits: the roles so far are spelled out and matched at the end."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, out = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (at, last) in done:
            continue
        done.add((at, last))
        for letter in "ua":
            if letter in follows[last] and len(audit) < 3 * len(rows) + 3:
                heapq.heappush(heap, (cost + 3, audit + "I", at, letter, (*out, ("user" if letter == "u" else "assistant") + ":")))
        if at < len(rows):
            role, text = rows[at][2:]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, out))
            if faults[at] not in ("blank", "duplicate"):
                late = 3 if faults[at] == "truncated" else 0
                if role[:1] and role[:1] in follows[last]:
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, role[0], (*out, f"{role}:{text}")))
                for letter, name in (("u", "user"), ("a", "assistant")):
                    if letter in follows[last]:
                        heapq.heappush(heap, (cost + 3 + late, audit + "R", at + 1, letter, (*out, f"{name}:{text}")))


def brute(rows):
    """A forward search is right about costs; of equal costs in one state it may keep the wrong audit, so ties are
    settled by trying every letter in ASCII order against the cost of what is left."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in damage(rows) if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        faults, turns = faults_of(own), sorted({r[1] for r in own if r[1] is not None})
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = least(own, faults)
        gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def least(rows, faults):
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    memo = {}

    def rest(at, last, inserts=0):
        if (at, last, inserts) not in memo:
            ways = [(0, "", ())] if at == len(rows) and last in ("", "a") else []
            for letter, name in (("u", "user"), ("a", "assistant")):
                if letter in follows[last] and inserts < 4:
                    c, a, o = rest(at, letter, inserts + 1)
                    ways.append((c + 3, "I" + a, (f"{name}:", *o)))
            if at < len(rows):
                role, text = rows[at][2:]
                late = 3 if faults[at] == "truncated" else 0
                c, a, o = rest(at + 1, last)
                ways.append((c + 4, "D" + a, o))
                if faults[at] not in ("blank", "duplicate"):
                    for letter, name in (("u", "user"), ("a", "assistant")):
                        if letter in follows[last]:
                            c, a, o = rest(at + 1, letter)
                            ways.append((c + 3 + late, "R" + a, (f"{name}:{text}", *o)))
                    if role[:1] and role[:1] in follows[last]:
                        c, a, o = rest(at + 1, role[0])
                        ways.append((c + late, "K" + a, (f"{role}:{text}", *o)))
            memo[at, last, inserts] = min(ways, default=(10**9, "", ()))
        return memo[at, last, inserts]

    found = rest(0, "")
    assert found[0] == search(rows, faults)[0]
    return found


def check(spark, rows, parts=5):
    frame = spark.createDataFrame([(*r, "x", "x", 1, "x", 1.5, "x") for r in rows], DDL).repartition(parts)
    got = conversations.repair(spark, conversations.damaged(frame)).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == brute(rows)


def test_against_brute_force(spark):
    pick = random.Random(11)
    rows = []
    for conv in range(250):
        roles = ["system"] * (pick.random() < .3) + ["user", "assistant"] * pick.randrange(5)
        for turn, role in enumerate(roles):
            if pick.random() < .15:
                role = pick.choice(["user", "assistant", "system", "tool", "", "Üser", None, "summary", "agent"])
            text = pick.choice(["Hello there.", "Why?", "ok", "So it is!\n", "  ", "é. ", "same.", None, f"line {turn}\nmore {pick.random()}.", "end. \t\x0b"])
            rows.append((conv, turn + (turn > 2 and pick.random() < .2), role, text))
    rows += [(None, t, "user", "a.") for t in (None, 1, 2)] + [(-5, None, None, None), (-6, 1 << 40, "user", "x" * 100_000), (-6, 0, "assistant", "y.")]
    rows += [(-7, 3, "user", "twice."), (-7, 3, "user", "twice."), (-7, 3, "assistant", "b"), (-7, None, "assistant", "a")]
    check(spark, rows)


def test_a_long_conversation_and_many_alike(spark):
    pick = random.Random(5)
    rows = [(1, t, pick.choice(["user", "assistant"]), f"text {t}{pick.choice(['.', ''])}") for t in range(3000)]
    rows += [(c, t, ["user", "assistant"][t % 2], f"t {t}.") for c in range(2, 400) for t in range(4)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(spark, conversations.damaged(frame)).collect()}
    own = sorted((r for r in damage(rows) if r[0] == 1), key=lambda r: r[1])
    automaton = conversations.Automaton()
    assert got[1][5] == search(own, faults_of(own))[0] == automaton.read(spelled(own)[::-1])[0] and len(got) == 399
    assert {c: g for c, g in got.items() if c > 1} == brute([r for r in rows if r[0] > 1])


def spelled(rows):
    letters = [r[2][:1] if r[2][:1] in "sua" else "o" for r in rows]
    return "".join("x" if f in ("blank", "duplicate") else c.upper() if f else c for c, f in zip(letters, faults_of(rows)))


def test_nodes_are_made_once():
    """Signatures in order of their reversal: as many nodes as different suffixes."""
    pick = random.Random(2)
    words = sorted({"".join(pick.choice("suaoUAx") for _ in range(pick.randrange(9))) for _ in range(3000)})
    automaton, fresh = conversations.Automaton(), {}
    got = {w: automaton.read(w) for w in words}
    assert automaton.made == len({w[:i] for w in words for i in range(1, len(w) + 1)})
    for w in words[::7]:
        fresh[w] = conversations.Automaton().read(w)
    assert fresh == {w: got[w] for w in fresh}
    assert len(automaton._classes) < 200    # classes of nodes do not grow with the nodes


def test_none(spark):
    frame = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversations.repair(spark, conversations.damaged(frame)).collect() == []


@pytest.mark.parametrize("word,audit,cost", [("", "", 0), ("ua", "KK", 0), ("sua", "KKK", 0), ("a", "IK", 3), ("u", "KI", 3), ("s", "D", 4), ("uu", "KR", 3),
                                             ("x", "D", 4), ("usa", "KDK", 4), ("aua", "IKKK", 3), ("Ua", "KK", 3), ("o", "D", 4), ("oa", "RK", 3)])
def test_small_audits(word, audit, cost):
    assert conversations.Automaton().read(word[::-1]) == (cost, audit)


def test_rows_of_a_repair(spark):
    rows = [(1, 0, "system", "be good."), (1, 1, "user", "hi."), (1, 2, "user", "still here."), (2, 0, "assistant", " ")]
    frame = spark.createDataFrame([(*r, True) for r in rows], "conv_id long, turn long, role string, text string, alive boolean")
    report = conversations.reports(spark, frame)
    got = [tuple(r) for r in conversations.repaired(frame, report).collect()]
    assert got == [(1, 1, "K", "system", "be good."), (1, 2, "K", "user", "hi."), (1, 3, "R", "assistant", "still here.")]
    assert {r["conv_id"]: (r["cost"], r["audit"], r["illegal"]) for r in report.collect()} == {1: (3, "KKR", 1), 2: (4, "D", 0)}
