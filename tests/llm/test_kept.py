from placemetrics.llm import words


def test_kept_until_another_operator_starts():
    made = []

    def task(parts):
        for part in parts:
            yield words.kept(("own", 1), lambda: made.append(part) or len(made)), part

    encodes, other = words.thrifty(task, keeps=True), words.thrifty(lambda parts: iter(parts))
    assert [n for n, _ in encodes(iter("ab"))] + [n for n, _ in encodes(iter("c"))] == [1, 1, 1]
    assert list(other(iter("d"))) == ["d"] and not words._kept
    assert list(encodes(iter("e"))) == [(2, "e")] and made == ["a", "e"]
