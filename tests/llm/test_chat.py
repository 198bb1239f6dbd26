import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packetsieve.llm import chat

SNIPPETS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[SEP]", "[/ROLE]", "\\", "\\\\", " ", "a", "é🎉", "\n", "[", "</", "INST]", ""]
pieces = st.lists(st.sampled_from(SNIPPETS), max_size=6).map("".join)
roles = st.one_of(st.sampled_from(["user", "assistant", "system"]), pieces)
turns = st.lists(st.tuples(roles, pieces), max_size=5)


@given(turns)
@settings(max_examples=500, deadline=None)
def test_any_turns_read_back(said):
    text, spans = chat.formatted(said)
    assert chat.parsed(text) == said
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in said if r == "assistant"]


@given(pieces)
@settings(max_examples=300, deadline=None)
def test_escapes_are_undone(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not [m for m in chat.CONTROL.finditer(chat.escape(text)) if not m[1]]


def test_only_conflicting_turns_are_escaped():
    text, _ = chat.formatted([("user", "plain [brackets] \\n"), ("assistant", "</s>")])
    assert text == "[INST] plain [brackets] \\n [/INST]<s> \\</s> </s>"


@pytest.mark.parametrize("text", ["x", "[INST] a", "[INST] a</s>", "[INST]a [/INST]", "[/INST] a [INST]", "[INST] [/INST]", "[ROLE] user [SEP] x [/ROLE]", "[INST] a [/INST] ", "\\[INST] a [/INST]"])
def test_other_texts_are_refused(text):
    with pytest.raises(chat.GrammarError):
        chat.parsed(text)


def brute(rows):
    groups = {}
    for conv_id, turn, role, text in rows:
        groups.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv_id, own in groups.items():
        own = [(role, text) for _, _, role, text in sorted(own)]
        loss = "".join(t for r, t in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv_id] = (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss))
    return out


def test_round_trip_of_odd_conversations(spark, prose, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 2000)
    rows = [(i, t, ["system", "user", "assistant"][min(t, 1 + (t + 1) % 2)], prose(30, i * 9 + t)) for i in range(30) for t in range(6)]
    rows += [(40, 0, "user", None), (41, 0, None, "no role"), (42, 3, "tool", "[ROLE] x [SEP]"), (42, None, "assistant", "\\</s>"), (42, 3, "assistant", "")]
    rows += [(None, 1, "user", "no id"), (None, 0, "assistant", "</s>")] + [(43, 1, "assistant", "same")] * 4
    rows += [(44, 0, "assistant", prose(30000, 3))] + [(45, t, ["user", "assistant"][t % 2], "[INST] " + prose(20, t)) for t in range(500)]
    wide = [(*r, "x", "y", "z", "w") for r in rows]
    convs = spark.createDataFrame(wide, "conv_id long, turn long, role string, text string, part string, turns string, loss string, chars string")
    got = {r["conv_id"]: r for r in chat.chat_round_trip(convs).collect()}
    want = brute(rows)
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == want
    parts = chat.format_conversations(convs.drop("part"))
    sizes = {}
    for p in parts.collect():
        sizes[p["conv_id"]] = sizes.get(p["conv_id"], 0) + len(p["text"])
    assert sizes == {k: r["formatted_chars"] for k, r in got.items()}
    assert parts.where("conv_id = 45").count() > 5
    assert chat.chat_round_trip(convs.limit(0)).count() == 0
