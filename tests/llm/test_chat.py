"""Preference formatting against brute force."""

from tidewatch.llm import chat


def show(role, text):
    return f"<|{role}|>\n{text}\n<|end|>\n"


def plain(rows):
    """Pairs from conversations, by loops over lists."""
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in talks.items()}
    reply = {c: next((t for r, t in v if r == "assistant"), None) for c, v in talks.items()}
    out = {}
    for conv, turns in talks.items():
        ends = [k for k, (r, _) in enumerate(turns) if r == "assistant"]
        if not ends:
            continue
        good = turns[: ends[-1] + 1]
        other = reply.get(conv + 1)
        bad = [*good[:-1], ("assistant", other or "")]
        prefix = next((k for k in range(len(good)) if good[k] != bad[k]), len(good))

        def side(turns):
            text, mask = "", []
            for role, said in turns[prefix:]:
                head = f"<|{role}|>\n"
                if role == "assistant":
                    mask.append(f"{len(text) + len(head)}:{len(text) + len(show(role, said))}")
                text += show(role, said)
            return text, ",".join(mask)

        out[conv] = (conv, prefix, "".join(show(*t) for t in good[:prefix]), *side(good), *side(bad))
    return out


ROWS = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Hello 😀"), (1, 2, "user", "Bye"), (1, 3, "assistant", "Ciao"),
        (1, 4, "user", "after the last reply"), (2, 0, "system", None), (2, 1, "assistant", "Only é"),
        (3, 1, "assistant", "same"), (3, 0, None, "x"), (4, 0, "assistant", "same"), (5, 0, "user", "no reply"),
        (6, None, "assistant", "first"), (6, 0, "user", "u"), (6, 0, "user", "u"), (6, 0, "assistant", "tie"),
        (None, 0, "user", "lost"), (None, 1, "assistant", "lost"), (7, 0, "user", "q" * 50000), (7, 1, "assistant", "")]
SCHEMA = "conv_id long, turn long, role string, text string, prefix int, at string"


def test_pairs(spark):
    turns = spark.createDataFrame([(*r, 1, "x") for r in ROWS], SCHEMA)
    got = {r.pair_id: tuple(r) for r in chat.preference_pairs(*chat.variants(turns)).collect()}
    assert got == plain(ROWS)
    assert chat.preference_pairs(*chat.variants(turns.limit(0))).count() == 0


def test_sides_of_different_length(spark):
    schema = "pair_id long, at int, role string, text string"
    good = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"),
                                  (1, 3, "assistant", "d"), (2, 0, "user", "alone"), (3, 0, "user", "s")], schema)
    bad = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (3, 0, "user", "s")], schema)
    got = {r.pair_id: r for r in chat.preference_pairs(good, bad).collect()}
    assert set(got) == {1, 3}
    assert (got[1].prefix_turns, got[1].rejected) == (2, "") and got[1].chosen == show("user", "c") + show("assistant", "d")
    assert (got[3].prefix_turns, got[3].chosen, got[3].rejected, got[3].prompt) == (1, "", "", show("user", "s"))
