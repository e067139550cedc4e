"""Spans of turns whose roles hold what the probe is made of."""

from foliospark.llm import chat


def test_a_role_that_holds_the_probe():
    for role in (chat._PROBE, f"a{chat._PROBE}b", chat._PROBE[0] * 3 + chat._PROBE, chat._PROBE[0] + "x"):
        turns = [("user", "first"), (role, "second"), ("assistant", chat._PROBE)]
        for render in (chat.template, lambda t: "".join(r + x for r, x in t)):
            text, spans, stable = chat.locate(turns, render)
            assert stable and [text[a:z] for _, a, z, _ in spans] == [chat.escape(x) if render is chat.template else x for _, x in turns]
            assert [s[0] for s in spans] == [0, *(s[3] for s in spans[:-1])] and spans[-1][3] == len(text)
