"""Chat windows against a plain reading of the rules, on odd conversations."""

import hashlib
import random
import re

import pytest

from placemetrics.llm import chat

ROWS = "conv_id long, turn long, role string, text string, block long, window string, place int"
MARK = re.compile(r"([\[<])(\\*)(/?INST\]|/s>)")
TOKEN = re.compile(r"[^\W_]{1,6}|[^\x20\x09-\x0D]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tokens(text):
    return len(TOKEN.findall(text))


def expected(conversation, budget, history, most, block):
    """Windows of one conversation as lists of (place, new), turn by turn; and its escaped turns."""
    turns = [(t, *(MARK.sub(r"\1\\\2\3", x or "") for x in (r, x_))) for t, r, x_ in conversation]
    turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    weight = [tokens(r) + tokens(x) + 3 for _, r, x in turns]
    system = 0 if turns[0][1] == "system" else None
    room = max(1, budget - (weight[0] if system == 0 else 0) - most)
    blocks = {}
    for i, (t, _, _) in enumerate(turns):
        blocks.setdefault(None if t is None else t // block, []).append(i)
    windows, previous = [], []
    for places in blocks.values():
        own = [i for i in places if i != system]
        total = sum(weight[i] for i in own)
        large = {i for i in own if total > room and 2 * weight[i] > room}
        largest = max([weight[i] for i in own if i not in large], default=0)
        span = room + 1 if total <= room else room - largest
        here, last, passed, count = [[i for i in places if i == system]], None, 0, 0
        for i in own:
            count += i in large
            now = (count, i in large, passed // span)
            passed += 0 if i in large else weight[i]
            if last is not None and now != last:
                here.append([])
            here[-1].append(i)
            last = now
        past = [i for i in previous if i != system][-history:] if history else []
        for w in here:
            back, used = [], 0
            for i in reversed(past[-history:] if history else []):
                used += weight[i]
                if used > most:
                    break
                back.append(i)
            head = [system] if system == 0 and 0 not in w else []
            windows.append(([(i, False) for i in [*head, *reversed(back)]] + [(i, True) for i in w]))
            past = past + [i for i in w if i != system]
        previous = places
    return windows, turns


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    words = ["ok", "</s>", "[INST]", "[\\INST]", "<\\\\/s>", "été", "日本", "a_b", "𝔘x", "\\", "[/INST]", "\n", "longerword", "1234567"]
    rows = []
    for conv in range(12):
        if conv % 3:
            rows.append((conv, 0, "system", "be </s> brief " * (conv + 1)))
        for turn in range(1, rng.choice([2, 7, 40, 90])):
            rows.append((conv, turn * rng.choice([1, 1, 3]), ("user", "assistant")[turn % 2], " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 12, 60, 400])))))
    rows += [(20, 0, "system", "alone"), (21, 0, "assistant", None), (21, 0, "assistant", None), (22, None, None, "no turn"), (22, 5, "tool[INST]", "</s>"),
             (22, 5, "assistant", "x"), (23, 1, "system", "s"), (23, 900, "user", "u"), (23, 901, "assistant", "v"), (None, 0, "assistant", "no conversation"), (None, 1, "user", ""),
             (24, -3, "assistant", "before"), (24, 2, "assistant", "")]
    return spark.createDataFrame([(*r, 7, "w", 1) for r in rows], ROWS)


@pytest.mark.parametrize("budget, history, most, block", [(1024, 2, 256, 256), (120, 2, 40, 16), (60, 3, 30, 7), (200, 0, 10, 1000)])
def test_windows(odd, budget, history, most, block):
    given = {}
    for r in odd.collect():
        given.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    made = chat.format_windows(odd, budget, history, most, block=block)
    rows = {}
    for r in sorted(made.collect(), key=lambda r: (r.block, r.window)):
        rows.setdefault(r.conv_id, []).append(r)
    assert set(rows) == set(given)
    for conv, turns in given.items():
        windows, escaped = expected(turns, budget, history, most, block)
        assert len(rows[conv]) == len(windows), conv
        for r, want in zip(rows[conv], windows, strict=True):
            text, spans = "", []
            for i, new in want:
                _, role, body = escaped[i]
                text += f"[INST]{role}[/INST]"
                if new and role == "assistant":
                    spans.append((len(text), len(body)))
                text += f"{body}</s>"
            assert r.text == text
            assert sorted((s.start, s.length) for s in r.loss) == spans
            assert (r.n_context, r.n_turns) == (sum(not n for _, n in want), sum(n for _, n in want))
            assert r.tokens == sum(tokens(escaped[i][1]) + tokens(escaped[i][2]) + 3 for i, _ in want)
            # Over the budget only with a single turn of its own beside the system turn.
            assert r.tokens <= budget or sum(new and (i > 0 or escaped[0][1] != "system") for i, new in want) == 1


def test_digests(spark, odd):
    for block in (256, 5):
        got = {r.conv_id: r for r in chat.digests(chat.format_windows(odd, 100, 2, 30, block=block)).collect()}
        given = {}
        for r in odd.collect():
            given.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
        assert set(got) == set(given)
        for conv, turns in given.items():
            turns.sort(key=lambda t: (*t[:2], MARK.sub(r"\1\\\2\3", t[2]), MARK.sub(r"\1\\\2\3", t[3])))
            learned = "".join(x for _, _, r, x in turns if r == "assistant")
            want = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(learned), sha(learned))
            assert tuple(got[conv])[1:5] == want
    assert chat.digests(chat.format_windows(spark.createDataFrame([], ROWS))).count() == 0


def test_escaping(spark):
    texts = ["[INST]", "[\\INST]", "[\\\\/INST]", "<</s>", "<\\/s>", "</s></s>", "[INST", "\\[INST]\\", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape("t").alias("e")).select("t", "e", chat.unescape("e").alias("u")).collect()
    for r in rows:
        assert r.u == r.t
        assert not any(m in r.e for m in (chat.OPEN, chat.CLOSE, chat.END))
