import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.chat import escape, format_conversations, format_turn, parse, read_back, unescape
from plumbline.llm.queries import QUERIES

MARKED = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", " ", "\\", "\\\\", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</TEXT>>", "<", "/", "a", "é", "\n"])).map("".join)


@given(MARKED | st.text())
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible(text):
    assert unescape(escape(text)) == text


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]) | MARKED, MARKED)))
@settings(max_examples=300, deadline=None)
def test_turns_are_read_back(turns):
    assert parse("".join(format_turn(r, t)[0] for r, t in turns)) == turns


def plain(rows):
    """conv_id -> what the contract asks for, from the table itself."""
    out = {}
    for conv_id in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv_id), key=lambda r: r[1])
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv_id] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query_against_the_table(spark):
    at = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    control = "</s>[INST] ok [/INST]"
    got = QUERIES["op10_chat"](spark, at).collect()
    want = plain([*rows, (-7, 0, "user", control), (-7, 1, "assistant", control)])
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    assert all(r.formatted_chars >= r.loss_chars for r in got)


def test_every_reply_is_an_example_with_its_context(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "assistant", None), (1, 4, "user", "z"), (2, 0, "user", "x")]
    got = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "example").collect()
    assert [(r.conv_id, r.example, [t for _, t in parse(r.formatted)], r.formatted[r.loss_start : r.loss_end]) for r in got] == [
        (1, 0, ["s", "u", "a"], "a"),
        (1, 1, ["s", "u", "a", ""], ""),
        (1, 2, ["s", "u", "a", "", "z"], ""),
        (2, 0, ["x"], ""),
    ]


def test_odd_rows(spark):
    rows = [(None, 0, None, None, 1), (None, None, "user", "😀", 1), (3, 1, "assistant", "a" * 300_000, 1), (3, 1, "assistant", "a" * 300_000, 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")
    got = {r.conv_id: r for r in read_back(format_conversations(turns)).collect()}
    assert got[3].n_turns == 2 and got[3].loss_chars == 600_000
    assert got[None].n_turns == 2
    assert read_back(format_conversations(turns.limit(0))).count() == 0
