"""Repair of conversation structure."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from peerscope.llm import conversation_repair as repair

BLANKS = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """The contract's damage, row by row, in the order of the repair."""
    out = []
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        out += [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{r[2]}:{r[3]}".encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(BLANKS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_edits(initials, found):
    """Cheapest edits with the least initials, by plain recursion over whole strings."""
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(k, state, inserted):
        options = []
        if k == len(initials):
            if state in ("", "a"):
                options.append((0, ""))
        else:
            options.append(_with(4, "D", best(k + 1, state, 0)))
            if found[k] not in ("blank", "duplicate"):
                more = 3 * (found[k] == "truncated")
                options.append(_with(3 + more, "R", best(k + 1, turn[state], 0)))
                own = initials[k]
                if (own == "s" and state == "") or (own == "u" and state != "u") or (own == "a" and state == "u"):
                    options.append(_with(more, "K", best(k + 1, own, 0)))
        if inserted < 3:
            options.append(_with(3, "I", best(k, turn[state], inserted + 1)))
        return min(options, default=(10**9, ""))

    return best(0, "", 0)


def _with(cost, letter, rest):
    return cost + rest[0], letter + rest[1]


def rebuilt(rows, audit):
    state, k, out = "", 0, []
    for letter in audit:
        _, _, role, text = rows[k] if k < len(rows) else (None,) * 4
        if letter in "IR":
            state = "a" if state == "u" else "u"
            out.append(("user" if state == "u" else "assistant", text if letter == "R" else ""))
        elif letter == "K":
            state = role[0]
            out.append((role, text))
        k += letter != "I"
    assert k == len(rows) and GRAMMAR.fullmatch("".join(r[:1] for r, _ in out))
    return out


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = damaged([r for r in rows if r[0] == conv])
        found = faults(own)
        initials = [r[2][:1] for r in own]
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit = best_edits(tuple(initials), tuple(found))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        text = "\n".join(f"{r}:{t}" for r, t in rebuilt(own, audit))
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def results(spark, rows, **limits):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, at int, `audit.b` string").repartition(4)
    found = repair.digest(repair.repair(repair.damage(table), **limits), table).collect()
    return sorted((tuple(r[n] for n in NAMES) for r in found), key=str)


def conversation(conv, turns, seed):
    chooser = random.Random(seed)
    rows = []
    for k in range(turns):
        role = chooser.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "u"])
        if chooser.random() < 0.6:
            role = ["user", "assistant"][k % 2]
        text = chooser.choice(["Yes.", "No!", "cut off", "", " \n", None, "same thing.", f"own {k}?", f"tail {k} \t", "ünï ☃.", "a:b."])
        rows.append((conv, chooser.choice([k, k, k, None, k // 2]), role, text))
    return rows


@pytest.mark.parametrize("seed", range(300))
def test_hirschberg_is_the_least_of_the_cheapest(seed):
    chooser = random.Random(seed)
    n = chooser.randrange(0, 12)
    initials = tuple(chooser.choice(["s", "u", "a", "t", ""]) for _ in range(n))
    found = tuple(chooser.choice(["", "", "blank", "truncated", "duplicate"]) for _ in range(n))
    codes = bytes(
        3 * ("sua".index(i) if i and i in "sua" else 3) + {"": 0, "blank": 1, "duplicate": 1, "truncated": 2}[f] for i, f in zip(initials, found, strict=True)
    ) + bytes([repair.END])
    cost, audit = best_edits(initials, found)
    assert "".join(repair.hirschberg(codes, 0, len(codes), 0, 0)) == audit
    assert repair.run_forward(codes, 0, len(codes), 0)[2] == cost


def test_all_edit_strings():
    """Every string of edits of up to two rows: none is cheaper, and none as cheap is less."""
    price = {"K": 0, "R": 3, "D": 4, "I": 3}
    for initials in itertools.chain(itertools.product("suat", repeat=1), itertools.product("suat", repeat=2)):
        for found in itertools.product(["", "blank", "truncated"], repeat=len(initials)):
            options = []
            for size in range(7):
                for letters in itertools.product("KRDI", repeat=size):
                    audit = "".join(letters)
                    if len(audit) - audit.count("I") != len(initials):
                        continue
                    k, outs = 0, [""]
                    cost = sum(price[c] for c in audit)
                    for c in audit:
                        if c != "I":
                            cost += 3 * (found[k] == "truncated" and c != "D")
                            if found[k] == "blank" and c != "D":
                                outs = []
                        outs = [o + new for o in outs for new in {"K": [initials[min(k, len(initials) - 1)]], "D": [""]}.get(c, ["u", "a"])]
                        k += c != "I"
                    if any(GRAMMAR.fullmatch(o) for o in outs):
                        options.append((cost, audit))
            assert best_edits(initials, found) == min(options)


@pytest.mark.parametrize("limits", [{}, {"most_rows": 7}, {"most_rows": 1}, {"most_bytes": 300}])
def test_repair(spark, limits):
    rows = [r for k in range(60) for r in conversation(k, k % 9, k)]
    rows += conversation(None, 12, 1000) + conversation(500, 150, 1001)
    rows += [(600, 3, "user", "again.")] * 90 + [(700, None, "system", "x " * 5000)] + [(800, k, None, None) for k in range(5)]
    assert results(spark, rows, **limits) == expected(rows)


def test_fragments_add_up(spark):
    rows = conversation(5, 80, 3)
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    parts = repair.repair(repair.damage(table), most_rows=9).orderBy("at").collect()
    want = expected(rows)[0]
    assert len(parts) > 5 and not any(r["whole"] for r in parts)
    assert sum(r["cost"] for r in parts) == want[6] and "".join(r["audit"] for r in parts) == want[7]
    text = "\n".join(f"{m['role']}:{m['text']}" for r in parts for m in r["messages"])
    assert hashlib.sha256(text.encode()).hexdigest() == want[8]


def test_empty_and_fully_dropped(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert repair.digest(repair.repair(repair.damage(empty)), empty).count() == 0
    gone = next(k for k in itertools.count() if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert results(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_given_table(spark):
    from peerscope.llm.queries import QUERIES

    found = QUERIES["op12_hirschberg_repair"](spark, "/root/testdata/sf0.01").collect()
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted((tuple(r[n] for n in NAMES) for r in found), key=str) == expected([tuple(r) for r in table])
