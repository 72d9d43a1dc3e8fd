"""Repaired conversations against a plain table of all states."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import dialogue
from tidemark.llm.dialogue import Item

SCHEMA = "conv_id bigint, turn bigint, role string, text string, rows int, nth int, part string, digest string"
ODD = (1, 2, "clash", "clash")
STATES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def brute_way(rows, entry="", exits=("", "a")):
    """(cost, letters) from the end back; rows are (letter, forced, cut)."""
    then = {"": "u", "s": "u", "u": "a", "a": "u"}
    worst = (10**9, "~")
    rest = {s: (0, "") if s in exits else worst for s in STATES}

    def inserting(table):
        for _ in range(4):
            for s in STATES:
                cost, letters = table[then[s]]
                table[s] = min(table[s], (cost + 2, "I" + letters))
        return table

    rest = inserting(rest)
    for letter, forced, cut in reversed(rows):
        now = {}
        for s in STATES:
            ways = [(rest[s][0] + 3, "D" + rest[s][1])]
            if not forced:
                if letter in STATES[s]:
                    cost, letters = rest[STATES[s][letter]]
                    ways.append((cost + cut, "K" + letters))
                cost, letters = rest[then[s]]
                ways.append((cost + 2 + cut, "R" + letters))
            now[s] = min(ways)
        rest = inserting(now)
    return rest[entry]


def damage(conv_id, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
    fault = zlib.crc32(key.encode()) % 20
    text = {1: "", 2: text.translate(str.maketrans("", "", ".!?"))}.get(fault, text)
    return [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)


def brute(rows):
    """The whole result by conversation."""
    every = defaultdict(list)
    for conv_id, *row in rows:
        every[conv_id] += damage(conv_id, *row)
    out = {}
    for conv_id, found in every.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, kinds = set(), []
        for _, role, text in found:
            body = text.strip(" \t\n\v\f\r")
            kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        letters = [role[:1] for _, role, _ in found]
        cost, audit = brute_way([(x, k in ("blank", "duplicate"), k == "truncated") for x, k in zip(letters, kinds)])
        lines, at, state = [], iter(found), ""
        for edit in audit:
            row = None if edit == "I" else next(at)
            if edit == "D":
                continue
            state = STATES[state][row[1][:1]] if edit == "K" else {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            role = row[1] if edit == "K" else {"u": "user", "a": "assistant"}[state]
            lines.append(f"{role}:{row[2] if row else ''}")
        turns = [t for t, _, _ in found if t is not None]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        out[conv_id] = (
            conv_id, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines,
        )
    return out


def conversations(seed=5):
    pick = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    said = ["Yes.", "No!", "Why?", "cut off", "", "  \n", None, "Ä ö.", "end.  ", "Well. then"]
    rows = []
    for conv_id in range(150):
        usual = pick.random() < 0.4
        for turn in range(pick.choice([1, 2, 3, 5, 8, 12])):
            role = ("user", "assistant")[turn % 2] if usual else pick.choice(roles)
            text = f"Row {pick.random()}." if usual else pick.choice(said)
            rows.append((conv_id, pick.choice([turn, turn, turn * 2, None, 3]), role, text))
    rows += [rows[0]] * 3 + [(None, t, "user", "Hm.") for t in range(4)] + [(None, None, None, None)]
    rows += [(900, t, pick.choice(roles), pick.choice(said) if pick.random() < 0.5 else f"{t}.") for t in range(700)]
    rows += [(901, 1, "user", "again.")] * 300 + [(902, -5, "system", "x" * 200_000), (902, 7, "user", "?")]
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_least_letters_of_cheapest_edits(seed):
    pick = random.Random(seed)
    for _ in range(300):
        rows = [(pick.choice("suaxx"), pick.random() < 0.2, pick.random() < 0.3) for _ in range(pick.randint(0, 9))]
        items = [Item(letter, "", int(forced), cut) for letter, forced, cut in rows]
        assert dialogue.cheapest(items, dialogue.NOTHING, dialogue.COMPLETE) == brute_way(rows)


def test_pieces_join_to_the_same_edits():
    pick = random.Random(8)
    for _ in range(60):
        rows = [(pick.choice("suax"), pick.random() < 0.2, pick.random() < 0.3) for _ in range(pick.randint(1, 40))]
        pieces, step = [], pick.randint(1, 6)
        for at in range(0, len(rows), step):
            items = [Item(letter, "", int(forced), cut) for letter, forced, cut in rows[at : at + step]]
            ways = [
                {"entry": s, "leaves": t, "cost": way[0], "letters": way[1]}
                for s in range(4) for t in range(4) if (way := dialogue.cheapest(items, s, (t,), closed=True))
            ]
            pieces.append({"part": 0, "nth": at, "ways": ways, "first": None, "first_turn": None}
                          | dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0))
        found = list(dialogue._joined(pieces))
        assert (found[0]["cost"], "".join(p["letters"] for p in found)) == brute_way(rows)


@pytest.fixture(scope="module")
def data(spark):
    rows = conversations()
    return rows, spark.createDataFrame([(*r, *ODD) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("piece", [256, 3])
def test_matches_brute_force(data, monkeypatch, piece):
    monkeypatch.setattr(dialogue, "PIECE", piece)
    rows, df = data
    got = dialogue.repaired(df, dialogue.damaged(df)).collect()
    want = {k: v[:-1] for k, v in brute(rows).items()}
    assert {r.conv_id: tuple(r) for r in got} == want and len(got) == len(want)


def test_rows_that_are_left(data, monkeypatch):
    monkeypatch.setattr(dialogue, "PIECE", 50)
    rows, df = data
    left = defaultdict(list)
    found = dialogue.repaired_rows(df, dialogue.damaged(df)).orderBy("part", "nth", "place").collect()
    for row in found:
        left[row.conv_id].append(f"{row.role}:{row.text}")
    assert left == {k: v[-1] for k, v in brute(rows).items() if v[-1]}


def test_undamaged_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dialogue.repaired(empty).count() == 0 and dialogue.repaired_rows(empty).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 4, None, None)], "conv_id int, turn int, role string, text string")
    (row,) = dialogue.repaired(df).collect()
    assert (row.gaps, row.blank, row.cost, row.audit) == (2, 1, 3, "KKD")
