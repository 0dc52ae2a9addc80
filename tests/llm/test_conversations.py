"""Conversation repair against a search over all edits."""

import hashlib
import random
import zlib

from inkveil.llm import conversations

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def cheapest(turns):
    """(cost, audit, states) by taking the least (cost, audit) of each place and state; turns are (initial, fault)."""
    best = {0: (0, "")}

    def insertions(b):
        for _ in range(3):
            for q, (c, a) in list(b.items()):
                for r in "ua":
                    if (q, r) in NEXT:
                        to = NEXT[q, r]
                        b[to] = min(b.get(to, (9**9, "")), (c + 3, a + "I"))
        return b

    best = insertions(best)
    for initial, fault in turns:
        new = {}
        for q, (c, a) in best.items():
            put = lambda to, x: new.__setitem__(to, min(new.get(to, (9**9, "")), x))
            put(q, (c + 4, a + "D"))
            if fault not in ("b", "d"):
                t = 3 * (fault == "t")
                if (q, initial) in NEXT:
                    put(NEXT[q, initial], (c + t, a + "K"))
                for r in "ua":
                    if (q, r) in NEXT:
                        put(NEXT[q, r], (c + t + 3, a + "R"))
        best = insertions(new)
    return min(best[q] for q in (0, 3) if q in best)


def test_repair_of_kinds():
    rng = random.Random(13)
    layers = conversations.Layers()
    for _ in range(3000):
        turns = [(rng.choice("suaauaua-"), rng.choice(["", "", "", "t", "b", "d"])) for _ in range(rng.randrange(12))]
        kinds = bytes(conversations.KINDS.index((r, {"": 0, "t": conversations.SHORT}.get(f, conversations.FORCED))) for r, f in turns)
        assert conversations.repair(kinds, layers) == cheapest(turns), turns
    assert all(v[-1] == 15 for v in layers.values)


def expected(rows):
    by, out = {}, set()
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        sp = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, turns = set(), []
        for turn, role, text in own:
            bare = text.rstrip(SPACE)
            turns.append((role[:1], "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        n = [r[0] for r in own if r[0] is not None]
        count = lambda f: sum(x[1] == f for x in turns)
        cost, audit = cheapest(turns)
        lines, state, rest = [], 0, iter(own)
        for e in audit:
            turn, role, text = next(rest) if e != "I" else (None, "", "")
            if e != "D":
                r = role[:1] if e == "K" else "a" if state == 2 else "u"
                lines.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[r]}:{text}")
                state = NEXT[state, r]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out.add((conv, max(n) - min(n) + 1 - len(set(n)) if n else 0, count("b"), count("d"), count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def test_query(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "No?\n ", "ok", "Why!", "", " \t", None, " ", "a. ", "中文。", "Yes." + str(turn)])))
    rows += [(None, t, r, "Hi.") for t, r in enumerate(["system", "user", "assistant"])] + [(900, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}." if t % 7 else "Same.") for t in range(5000)]
    rows += [(901, 3, "user", "Again.")] * 40 + [(902, None, "user", "x"), (902, None, "user", "x"), (902, None, "assistant", "x" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS k", "2 AS copies", "3 AS cost", "4 AS digest", "5 AS seen", "6 AS n")
    df.repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in conversations.op13_conversation_repair(spark, str(tmp_path)).collect()]
    want = expected(rows)
    assert len(got) == len(want) and set(got) == want
    assert any(not r[7] for r in got)  # a conversation without rows left
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert conversations.op13_conversation_repair(spark, f"{tmp_path}/none").count() == 0
