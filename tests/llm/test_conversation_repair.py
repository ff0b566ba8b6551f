import hashlib
import itertools
import random
import re
import zlib

import pytest
from llm_helpers import stored

from eventmart.llm import conversation_repair as repair_module
from eventmart.llm import queries

FORM = re.compile("(s?(ua)+)?")
ROWS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        end = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, judged):
    """Every sequence of edits up to two inserts at each place, tried out."""
    best = None
    between = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"], ["user", "user"], ["assistant", "assistant"]]
    per_row = []
    for (role, text), fault in zip(rows, judged):
        ways = [(3, "D", None)]
        if fault not in ("blank", "duplicate"):
            extra = fault == "truncated"
            ways += [(extra, "K", (role, text))] + [(2 + extra, "R", (to, text)) for to in ("user", "assistant")]
        per_row.append(ways)
    for edits in itertools.product(*per_row):
        for inserts in itertools.product(between, repeat=len(rows) + 1):
            cost = sum(e[0] for e in edits) + 2 * sum(map(len, inserts))
            if best and cost > best[0]:
                continue
            out, audit = [(n, "") for n in inserts[0]], "I" * len(inserts[0])
            for (_, letter, row), after in zip(edits, inserts[1:]):
                audit += letter + "I" * len(after)
                out += ([row] if row else []) + [(n, "") for n in after]
            if FORM.fullmatch("".join(r[:1] or "-" for r, _ in out)):
                found = (cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out)))
                best = min(best or found, found)
    return best


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            code = zlib.crc32(key.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            mine += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(f"{len(r[1])}:{r[1]}{r[2]}")))
        pairs = [(r, t) for _, r, t in mine]
        judged = faults(pairs)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:]))
        out[conv] = (gaps, *(judged.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *cheapest(pairs, judged))
    return out


def conversations():
    rng, rows = random.Random(13), []
    for conv in range(150):
        for k in range(rng.randrange(1, 4)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "s", "tool", "", None])
            text = rng.choice(["Good.", "So!", "What", "why? ", "same.", "same.", "", None, "\t\n", "long. text"])
            rows.append((conv, rng.choice([k, k, k, 2 * k, None, -k]), role, text))
    rows += [(None, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(3)] + [(None, None, "user", "x.")]
    dropped = next(t for t in range(1000) if zlib.crc32(f"900:{t}".encode()) % 20 == 0)
    return rows + [(900, dropped, "user", "gone.")]


def test_query_equals_trying_everything(spark, tmp_path):
    rows = conversations()
    df = spark.createDataFrame(rows, ROWS).repartition(5).selectExpr("*", "'x' as present", "1 as kind", "2 as digest", "3 as `at`")
    found = queries.QUERIES["op13_conversation_repair"](spark, stored(spark, tmp_path, df, "conversations")).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == plain(rows)
    assert len(found) == len(plain(rows))
    gone = next(r for r in found if r.conv_id == 900)
    assert tuple(gone)[1:] == (0, 0, 0, 0, 0, 0, "", sha(""))


def test_no_conversations(spark, tmp_path):
    df = spark.createDataFrame([], ROWS)
    assert queries.QUERIES["op13_conversation_repair"](spark, stored(spark, tmp_path, df, "conversations")).count() == 0


def plain_program(rows, judged):
    """Cost and audit by a table over rows from the last to the first."""
    togo = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    follows = {0: 2, 1: 2, 2: 3, 3: 2}
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    for (role, _), fault in zip(reversed(rows), reversed(judged)):
        now = {}
        for place in range(4):
            ways, at = [], place
            for k in range(3):
                at = at if k == 0 else follows[at]
                ways.append((2 * k + 3, "I" * k + "D", at))
                if fault in (None, "truncated"):
                    extra = fault == "truncated"
                    ways.append((2 * k + 2 + extra, "I" * k + "R", follows[at]))
                    if (at, role[:1]) in kept:
                        ways.append((2 * k + extra, "I" * k + "K", kept[at, role[:1]]))
            now[place] = min((c + togo[p][0], a + togo[p][1]) for c, a, p in ways)
        togo = now
    return togo[0]


@pytest.mark.parametrize("spill", [1, 3, 1 << 18])
def test_long_conversations_spill_their_pointers(tmp_path, monkeypatch, spill):
    monkeypatch.setattr(repair_module, "SPILL_ROWS", spill)
    rng = random.Random(spill)
    for _ in range(60):
        weights = [rng.random() ** 3 for _ in range(5)]
        rows = [(rng.choices(["user", "assistant", "system", "tool", ""], weights)[0], rng.choice(["a.", "b", "", "c!", "d?"]) + " " * k) for k in range(rng.randrange(40))]
        judged = faults(rows)
        one = repair_module._Conversation(1, f"file://{tmp_path}/{spill}")
        for k, (role, text) in enumerate(rows):
            one.add(k, role, text, judged[k] != "duplicate")
        result = one.result()
        assert result[6:8] == plain_program(rows, judged)
        assert result[2:5] == tuple(judged.count(f) for f in ("blank", "duplicate", "truncated"))
    assert not list(tmp_path.glob("*/*.back"))


def test_a_conversation_with_most_rows(spark):
    """One conversation holds most rows, over many Arrow batches, among them one text thousands of times."""
    rows = [(1, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(24_000)]
    rows += [(1, 24_000 + k, "user", "same.") for k in range(9_000)] + [(k, 0, "user", "hi.") for k in range(2, 40)]
    found = {r.conv_id: r for r in repair_module.repair(spark.createDataFrame(rows, ROWS).repartition(8)).collect()}
    big = found[1]
    assert (big.gaps, big.blank, big.duplicate, big.truncated, big.illegal, big.cost) == (0, 0, 8_999, 0, 8_999, 3 * 8_999 + 2)
    assert big.audit == "K" * 24_001 + "D" * 8_999 + "I"
    body = [f"{r}:{t}" for _, _, r, t in rows[:24_001]] + ["assistant:"]
    assert big.repaired_sha256 == sha("\n".join(body))
    assert all(found[k].audit == "KI" for k in range(2, 40))


def test_state_machine_is_small():
    repair_module._step.cache_clear()
    rng = random.Random(1)
    one = repair_module._Conversation(1, "")
    for k in range(20_000):
        one.add(k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", ""]), rng.random() < 0.8)
    assert repair_module._step.cache_info().currsize < 2_000
