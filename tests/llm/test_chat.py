import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tagweave.llm import chat

HARD = "</s>[INST] ok [/INST]"
pieces = st.text(alphabet="ab <>[]/\\sINSTROLEPY\n", max_size=12) | st.sampled_from(
    [HARD, "<s>", "[\\INST]", "[\\\\/SYS]", "<\\/s>", "[ROLE] x [SEP]", " ", "<", "[", "\\", "[/", "</s"])
turns = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a [SEP] b", HARD]),
                           st.lists(pieces, max_size=5).map("".join)), max_size=7)


@settings(max_examples=300, deadline=None)
@given(turns)
def test_round_trip(t):
    escaped = [(chat.escape(r), chat.escape(x)) for r, x in t]
    text, spans, rewritten = chat.locate(escaped)
    assert chat.read_back(text) == t and rewritten is None
    assert [s[1] for s in spans[:-1]] == [s[0] for s in spans[1:]]
    for (role, x), (_, _, lo, hi) in zip(t, spans):
        assert chat.unescape(text[lo:hi]) == (x if role == "assistant" else "")


def test_rewriting_templates_are_detected():
    def folds(turns, prompt=False):       # drops all but the last assistant's text
        last = max((i for i, t in enumerate(turns) if t[0] == "assistant"), default=-1)
        return "".join(f"<{r}>{x if r != 'assistant' or i == last else '...'}" for i, (r, x) in enumerate(turns)) + ("<assistant>" if prompt else "")

    t = [("user", "q"), ("assistant", "abc"), ("user", "r"), ("assistant", "def")]
    assert chat.locate(t, folds)[2] == 3
    assert chat.locate(t[:3], folds)[2] is None

    def closes(turns, prompt=False):      # an end mark after everything
        return "".join(f"<{r}>{x}" for r, x in turns) + "<end>"
    assert chat.locate(t, closes)[2] == 0


def digests(rows):
    text = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), h(text), len(loss), h(loss)


def test_table_and_hard_conversation(spark):
    from tagweave.llm.queries import op10_incremental_chat
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    by = {-7: [("user", HARD), ("assistant", HARD)]}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    got = op10_incremental_chat(spark, "/root/testdata/sf0.001").collect()
    assert {r["conv_id"]: tuple(r[1:5]) for r in got} == {k: digests(v) for k, v in by.items()} and len(got) == len(by)
    assert all(r["rewritten_at"] is None and r["formatted_chars"] > r["loss_chars"] for r in got)


def test_edge_rows(spark):
    rng = random.Random(2)
    rows = [(1, 1, "assistant", None), (1, 0, None, "x"), (1, 0, None, "x"), (None, 0, "user", "n"), (None, None, "user", "m"),
            (2, 5, "user", ""), (3, 1, "assistant", "y" * 200_000)]
    rows += [(4, i, rng.choice(["user", "assistant"]), f"t{i} {HARD}") for i in range(300)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted int, spans string").repartition(5)
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    by = {}
    for c, turn, r, t in sorted(rows, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0)):
        by.setdefault(c, []).append((r, t))
    assert {k: tuple(v[1:5]) for k, v in got.items()} == {k: digests(v) for k, v in by.items()}
    assert chat.format_conversations(df.limit(0)).count() == 0
