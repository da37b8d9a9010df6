"""Chat formatting and the repair of conversations against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib
from itertools import pairwise

import pytest

from tessera.llm import chat_format, repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, pos int, block string, n long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "b", 2) for r in rows], SCHEMA)


def talk(seed, n, long=0):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        turns = long if conv == 0 and long else r.randint(1, 9)
        for t in range(turns):
            role = "system" if t == 0 and r.random() < 0.4 else r.choice(["user", "assistant"])
            text = r.choice(["Yes.", "No", "A longer one?", "ok ok\n", " ", "", f"word {r.randrange(50)}.", f"word {r.randrange(50)}", "é <|im_end|> <\\|x."])
            rows.append((conv, t if r.random() < 0.95 else t + 1, role, text))
    return rows


ODD = [
    (None, None, None, None), (None, 0, "user", "hi."), (None, 0, "user", "hi."), (None, 1, "assistant", "yes"), (7, None, "user", "a."), (7, None, "assistant", "b."),
    (8, 3, "tool", "x."), (8, 5, "User", "y."), (9, 1, "", ""), (10, 0, "user", "tie."), (10, 0, "assistant", "tie."), (11, 0, "user", "w " * 60_000 + "."), (11, 1, "assistant", "Long.\n\n"),
]


def crc(conv, turn):
    return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text, h = " " if role is None else role, " " if text is None else text, crc(conv, turn)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    return out


def cheapest(turns):
    """(cost, audit, repaired turns) by Dijkstra's search over (turns read, state), all audits compared whole."""
    import heapq

    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(turns) and state in (0, 3):
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        for name in ("user", "assistant"):
            if (state, name[0]) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", i, step[state, name[0]], (*out, (name, ""))))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, step[state, role[:1]], (*out, (role, text))))
                for name in ("user", "assistant"):
                    if (state, name[0]) in step:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, step[state, name[0]], (*out, (name, text))))


def expected(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in harmed(rows) if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns, faults = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            inked = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not inked else "duplicate" if (role, text) in seen else "truncated" if inked[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            turns.append((role, text, fault))
        there = {t for t, _, _ in own if t is not None}
        cost, audit, out = cheapest(turns)
        gaps = max(there) - min(there) + 1 - len(there) if there else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairwise(turns))
        found[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest())
    return found


@pytest.mark.parametrize("block", [2, 5, 512])
def test_repair_against_brute_force(spark, block):
    rows = talk(3, 60, long=40)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired(table(spark, rows), repair.Settings(block=block)).collect()}
    assert got == expected(rows)


@pytest.mark.parametrize("block", [1, 3, 512])
def test_repair_of_odd_tables(spark, block):
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired(table(spark, ODD), repair.Settings(block=block)).collect()}
    assert got == expected(ODD)
    assert repair.repaired(table(spark, []), repair.Settings(block=block)).collect() == []


def test_repaired_rows_hold_the_texts(spark):
    rows = [(1, 0, "user", "One."), (1, 1, "user", "Two."), (1, 2, "user", "Two."), (2, 0, "assistant", "Hm")]
    found = repair.repair(table(spark, rows))
    got = sorted((r.key, r.pos, r.sub, r.role, r.text, r.edit) for r in found.rows.collect())
    assert got == [("=1", 0, 0, "user", "One.", "K"), ("=1", 1, 0, "assistant", "Two.", "R")]
    assert {r.key: (r.cost, r.audit) for r in found.report.collect()} == {"=1": (5, "KRD"), "=2": (3, "D")}


def plain(rows):
    """Rows in order with nulls as empty texts, by conversation."""
    found = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        found.setdefault(conv, []).append((role or "", text or ""))
    return found


def windows_of(turns, s):
    """(begin, end, shown, system) by a plain loop over the turns."""
    tokens = [len(re.findall(r"[^\W\d_]+|\d+|[^\w\s]|_", t)) + s.marks for _, t in turns]
    system = turns[0][0] == "system"
    out, fill = [], 0
    for i, n in enumerate(tokens):
        if i % s.block and fill + n <= s.budget:
            fill += n
            out[-1][1] = i
            continue
        shown, head = i, tokens[0] * system
        while i and i - shown < s.history_turns and shown > system and sum(tokens[shown - 1 : i]) <= min(s.history, s.budget - head - n):
            shown -= 1
        fill = n if i == 0 else head + sum(tokens[shown : i + 1])
        out.append([i, i, shown, system and i > 0])
    return out, tokens


@pytest.mark.parametrize("settings", [chat_format.Settings(), chat_format.Settings(budget=30, history=14, history_turns=3), chat_format.Settings(budget=25, history=20, history_turns=2, block=4, salts=2), chat_format.Settings(budget=1, history=0, block=3)])
def test_windows_against_brute_force(spark, settings):
    rows = talk(5, 40, long=30) + ODD
    got = {}
    for r in chat_format.chat_format(table(spark, rows), settings).collect():
        got.setdefault(r.key, []).append(r)
    want = plain(rows)
    assert len(got) == len(want)
    for conv, turns in want.items():
        own = sorted(got["" if conv is None else f"={conv}"], key=lambda r: r.begin)
        spans, tokens = windows_of(turns, settings)
        assert [(r.begin, r.end) for r in own] == [(a, b) for a, b, _, _ in spans]
        learnt = []
        for r, (a, b, shown, system) in zip(own, spans):
            places = [0] * system + [*range(max(shown, int(system)), b + 1)]
            read = chat_format.turns_of(r.formatted)
            assert [x[:2] for x in read] == [turns[p] for p in places]
            assert r.repeated == sum(p < a for p in places) and r.n_tokens == sum(tokens[p] for p in places)
            assert r.n_tokens <= settings.budget or a == b and r.repeated <= 1
            learnt += [chat_format.unescaped(r.formatted[m.begin : m.end]) for m in r["mask"]]
            assert all(r.formatted[m.end :].startswith(chat_format.END) for m in r["mask"])
        assert learnt == [t for role, t in turns if role == "assistant"]


def test_formatted_conversations_read_back(spark):
    rows = talk(6, 30) + ODD + chat_format.PLANTED
    got = {r.conv_id: r for r in chat_format.digested(table(spark, rows)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, turns in plain(rows).items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss)) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert chat_format.digested(table(spark, [])).collect() == []


def test_escapes_are_reversible(spark):
    r = random.Random(8)
    texts = ["".join(r.choice(["<", "|", "\\", "<|", "im_end|>", "\n", "a"]) for _ in range(r.randint(0, 12))) for _ in range(300)]
    rows = [(i, 0, text, text) for i, text in enumerate(texts)]
    for row in chat_format.chat_format(table(spark, rows)).collect():
        ((role, text, _, _),) = chat_format.turns_of(row.formatted)
        assert role == text == texts[int(row.key[1:])]
        assert row.formatted.count("<|") == 2
