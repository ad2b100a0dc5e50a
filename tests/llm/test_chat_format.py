"""op10: exact round trips, by property and by example."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import chat_format as C

pieces = st.lists(st.sampled_from([*C.CONTROLS, "\\", "\\\\", "<", ">", "[", "]", "s", "/", " ", "é", "ok", "\n", "<</", "SYS"]), max_size=12).map("".join)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), pieces), pieces), max_size=4))
def test_round_trip(turns):
    made = [C.render(r, t) for r, t in turns]
    text = "".join(m[0] for m in made)
    assert [x[:2] for x in C.parse(text)] == turns
    assert all(C.unescape(s[a:b]) == t for (s, a, b), (_, t) in zip(made, turns))


def test_plain_text_is_not_escaped():
    assert C.render("user", "a \\ b [x] <y>")[0] == "<s>[INST]a \\ b [x] <y>[/INST]"


def test_digests(spark):
    rows = [(1, 2, "assistant", "b\\"), (1, 1, "user", "</s>"), (1, 3, "tool", None), (2, 1, None, "x [/ROLE]"), (None, 5, "system", ""), (3, None, "user", "n"), (3, 1, "assistant", "z"), (3, 1, "assistant", "z"), (4, 0, "user", "long " * 50000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segment string").repartition(3)
    got = {r["conv_id"]: r for r in C.read_back(C.formatted(df)).collect()}
    assert len(got) == 5
    for conv in got:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(C.render(x[2] or "", x[3] or "")[0]) for x in own)
    assert C.read_back(C.formatted(df.limit(0))).count() == 0
