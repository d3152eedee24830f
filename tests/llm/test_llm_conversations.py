import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
SHAPE = re.compile(r"(s?(ua)+)?")


def wrecked(rows):
    """Rows after the stated damage, by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out[conv] += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    for held in out.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}\x1f{r[2]}".encode()).hexdigest()))
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen
                   else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, lines) by plain texts: a state is the role initials' last letter, everything is compared whole."""
    def steps(state):
        return "a" if state == "u" else "u"

    def grown(held):
        todo = list(held.items())
        while todo:
            state, (cost, audit, lines) = todo.pop()
            role = "assistant" if steps(state) == "a" else "user"
            new = (cost + 3, audit + "I", (*lines, f"{role}:"))
            if steps(state) not in held or new[:2] < held[steps(state)][:2]:
                held[steps(state)] = new
                todo.append((steps(state), new))
        return held

    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, lines) in grown(best).items():
            options = [(state, cost + 4, "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] == steps(state) or (state == "" and role[:1] == "s"):
                    options.append((role[:1], cost + more, "K", (*lines, f"{role}:{text}")))
                named = "assistant" if steps(state) == "a" else "user"
                options.append((steps(state), cost + more + 3, "R", (*lines, f"{named}:{text}")))
            for to, price, letter, kept in options:
                new = (price, audit + letter, kept)
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = after
    return min((v for k, v in grown(best).items() if k in ("", "a")), key=lambda v: v[:2])


def expected(rows):
    out = {}
    for conv, held in wrecked(rows).items():
        faults = faults_of(held)
        cost, audit, lines = cheapest(held, faults)
        turns = {t for t, _, _ in held if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(held, held[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    found = {r.conv_id: (*(r[c] for c in repair.COUNTS), r.audit, r.repaired_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def query(spark, tmp_path, rows, partitions=5):
    path = tmp_path / "conversations.parquet"
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as audit", "1 as part", "2 as rows")
    frame.repartition(partitions).write.mode("overwrite").parquet(str(path))
    return repair.op13_conversation_repair(spark, str(tmp_path))


def made(seed, conversations, longest):
    pick = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(pick.randint(1, longest)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = pick.choice(["", " \t", "Yes.", "No", "Why?", "One. two", f"{turn} ok!", f"{turn} and", None])
            rows.append((conv, pick.choice([turn, turn, turn, None, turn // 2]), role, text))
    return rows


def test_every_sequence_of_edits():
    """All edit sequences of short conversations: none is cheaper, or as cheap and smaller."""
    pick = random.Random(3)
    for _ in range(60):
        rows = [(i, pick.choice(["user", "assistant", "system", "tool"]), pick.choice(["a.", "b.", "c", ""]))
                for i in range(pick.randint(0, 3))]
        faults = faults_of(rows)
        found = []
        for extra in range(5):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), extra):
                for letters in itertools.product("DKR", repeat=len(rows)):
                    for roles in itertools.product("ua", repeat=extra + letters.count("R")):
                        audit, shape, cost, given = "", "", 0, iter(roles)
                        for i in range(len(rows) + 1):
                            for _ in range(places.count(i)):
                                audit, shape, cost = audit + "I", shape + next(given), cost + 3
                            if i < len(rows):
                                kept = letters[i] != "D"
                                audit += letters[i]
                                cost += {"D": 4, "K": 0, "R": 3}[letters[i]] + 3 * (kept and faults[i] == "truncated")
                                if kept:
                                    shape += next(given) if letters[i] == "R" else rows[i][1][:1]
                                if kept and faults[i] in ("blank", "duplicate"):
                                    cost += 10 ** 6
                        if SHAPE.fullmatch(shape):
                            found.append((cost, audit))
        got = repair.settle(1, rows)
        assert (got[6], got[7]) == min(found)
        assert cheapest(rows, faults)[:2] == min(found)


@pytest.mark.parametrize("piece", [2048, 3, 1])
def test_query_equals_plain_texts(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece)
    rows = made(7, 60, 9) + [(None, t, "user", "x.") for t in (None, 1, 4)] + [(900, None, "user", "y.")] * 2
    rows += [(901, t, "assistant" if t % 2 else "user", f"{t} is it.") for t in range(150)]  # a long one
    assert result(query(spark, tmp_path, rows)) == expected(rows)


def test_a_conversation_over_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", 16)
    pick = random.Random(5)
    rows = [(1 << 60, t, pick.choice(["user", "assistant", "tool"]), pick.choice([f"{t}.", f"{t % 40} again.", f"{t}", ""]))
            for t in range(3000)] + made(1, 20, 5)
    width = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(query(spark, tmp_path, rows)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", width)


def test_long_texts_and_repeated_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_CHARS", 5000)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "word " * 3000 + f"{t}.") for t in range(6)]
    rows += [(2, 1, "user", "same.")] * 400
    assert result(query(spark, tmp_path, rows)) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []).count() == 0


def test_fixture(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert result(repair.op13_conversation_repair(spark, sf_dir)) == expected(rows)


def test_colliding_hashes_do_not_decide(monkeypatch):
    monkeypatch.setattr(repair, "_MODULUS", 2)
    pick, edits, texts, nodes = random.Random(2), repair.Edits(), [""], [0]
    for _ in range(300):
        at = pick.randrange(len(nodes))
        letter = pick.choice("DIKR")
        nodes.append(edits.add(nodes[at], letter))
        texts.append(texts[at] + letter)
    for _ in range(4000):
        i, j = pick.randrange(len(nodes)), pick.randrange(len(nodes))
        assert edits.less(nodes[i], nodes[j]) == (texts[i] < texts[j])
