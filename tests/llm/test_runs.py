"""Periodic runs against a scan of every lag."""

import hashlib
import random
import zlib

import pytest

from placemetrics.llm import queries, runs


def brute(words, repeats=4, least=6):
    """Every maximal stretch of every lag, kept under its smallest period."""
    n, found = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if (i, end + q) not in found:
                found[i, end + q] = q
            i = end
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, repeats * q))


def samples():
    rng = random.Random(8)
    for k in range(400):
        letters = "ab" if k % 2 else "abcdefgh"
        words = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
            words += (unit * rng.randint(2, 9))[:rng.randint(1, 40)] + [rng.choice("xyz") for _ in range(rng.randint(0, 3))]
        yield words


def test_runs_are_those_of_every_lag():
    texts = list(samples()) + [["a"] * 5, ["a"] * 6, ["a"] * 500, [], ["a", "b"] * 4, (["a"] * 7 + ["b"]) * 30, list("abc") * 3 + ["a", "b"]]
    assert runs.runs_of(texts) == [brute(t) for t in texts]
    assert [runs.runs_of([t])[0] for t in texts] == [brute(t) for t in texts]
    for repeats, least in ((2, 2), (3, 9)):
        assert runs.runs_of(texts, repeats, least) == [brute(t, repeats, least) for t in texts]


def test_long_text():
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 400)}" for _ in range(60_000)]
    unit = [f"w{rng.randint(0, 400)}" for _ in range(1_111)]
    words[9_000:9_000 + 10_000] = (unit * 10)[:10_000]
    words[30_000:30_200] = ["w1"] * 200
    got = runs.runs_of([words])[0]
    assert (1_111 in {q for _, _, q in got}) and any(q == 1 and length >= 200 for _, length, q in got)
    for s, length, q in got:
        assert words[s:s + length - q] == words[s + q:s + length]


@pytest.mark.parametrize("planted", [False, True])
def test_documents(spark, planted):
    texts = [" ".join(w) for w in list(samples())[:120]] + [None, "", " \n\t", "a b a\x1cb\x0ba " * 9, "x " * 30]
    rows = [(2 ** 60 + k, t, 3, "r") for k, t in enumerate(texts)] + [(None, "y z " * 10, 1, "r"), (2 ** 60, texts[0], 1, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, runs string")
    found = runs.find_runs(docs, words_of=queries.repeated_tail if planted else None)
    got = sorted(map(tuple, runs.digests(found).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        words = runs.WORD.findall(t or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if planted and i is not None and h % 10 == 0 and n:
            a, g = (h // 10) % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        rs = brute(words)
        gone = {j for s, length, q in rs for j in range(s + q, s + length)}
        best = max(rs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(rs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in rs)),
                     sha(" ".join(w for j, w in enumerate(words) if j not in gone))))
    assert got == sorted(want, key=str)
    assert runs.digests(runs.find_runs(docs.limit(0))).count() == 0
