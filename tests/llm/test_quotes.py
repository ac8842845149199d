import pytest

from flowscope.llm import queries
from flowscope.llm import quotes as Q

SCHEMA = "conv_id bigint, turn bigint, role string, text string, own_text string"


def test_parse_levels():
    own, passages = Q.parse(">> deep one\n> shallow\n> more\nmine\n> > again deep\nend")
    assert own == "mine\nend"
    assert [(a, b) for a, b, _ in passages] == [(1, 0), (2, 0), (2, 4)]
    assert passages[0][2] == Q.normal_hash("shallow more")
    assert Q.parse(None) == ("", []) and Q.parse("") == ("", [])
    assert Q.parse(" >>> x")[1] == [(3, 0, Q.normal_hash("x"))]
    assert Q.normal_hash(" A  b\n") == Q.normal_hash("a b") and Q.normal_hash(" \n") is None


def messages():
    return [
        (1, 0, "user", "Hello  there\nfriend", "clash"),
        (1, 1, "assistant", "> hello there\n> FRIEND\nHi, how can I help?", None),
        (1, 2, "user", ">> Hello there friend\n> Hi, how can I help?\nWith nothing", None),
        (1, 3, "user", "An aside", None),
        (1, 4, "assistant", "> An aside\nnoted", None),
        (1, 5, "assistant", "> Hello there\n> friend\nback to the start", None),
        (2, 0, "user", "> With nothing\nfrom elsewhere", None),
        (2, 1, "user", "> nobody said this\nown", None),
        (2, 2, "user", "> only quoted", None),
        (3, 0, "user", "Hello there friend", None),
        (3, 1, "user", "> hello there friend\nsame place first", None),
        (3, 2, "user", None, None), (3, 3, "user", "", None),
        (None, 0, "user", "> An aside\nx", None), (4, None, None, "y", None),
        (5, 0, "user", "z", None), (5, 0, "user", "z", None), (5, 1, "user", "> z\nq", None), (5, 1, "user", "> z\nq", None),
    ]


@pytest.fixture(scope="module")
def ordered(spark):
    return Q.reply_order(spark.createDataFrame(messages(), SCHEMA).repartition(3)).collect()


def test_parents_and_threads(ordered):
    assert len(ordered) == len(messages())
    at = {(r.conv, r.turn): r for r in ordered}
    parent = {k: (r.parent_conv, r.parent_turn) for k, r in at.items()}
    assert parent[1, 1] == (1, 0) and parent[1, 2] == (1, 1) and parent[1, 4] == (1, 3) and parent[1, 5] == (1, 0)
    assert parent[2, 0] == (1, 2) and parent[2, 1] == (None, None) and parent[2, 2] == (None, None)
    assert parent[3, 1] == (3, 0) and parent[5, 1] == (5, 0)
    assert (at[1, 2].root, at[1, 2].depth, at[1, 2].n_quotes, at[1, 2].n_linked) == (0, 2, 2, 2)
    assert (at[1, 4].root, at[1, 4].depth) == (3, 1) and (at[1, 5].root, at[1, 5].depth) == (0, 1)
    assert (at[2, 0].root, at[2, 0].depth) == (0, 0)
    assert at[1, 1].own_text == "Hi, how can I help?" and at[3, 2].own_text == "" and at[2, 2].own_text == ""


def test_source_of_an_equal_text_elsewhere(spark):
    rows = [(9, 4, "u", "> same\nreply", None), (7, 1, "u", "same", None), (8, 0, "u", "same", None), (9, 5, "u", "same", None), (7, 0, "u", "> same\nx", None)]
    got = {(r.conv, r.turn): (r.parent_conv, r.parent_turn) for r in Q.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[9, 4] == (7, 1)
    assert got[7, 0] == (8, 0)


def test_trimmed_and_interleaved_quotes(spark):
    mail = "Dear all,\nthe first question is this.\nIt has two lines.\n\nThe second is short.\nBye"
    rows = [
        (1, 0, "u", mail, None), (1, 1, "u", "The second is short.", None),
        (1, 2, "u", "> The FIRST  question is this.\n> It has two lines.\nyes\n> The second is short.\nno", None),
        (1, 3, "u", "> It has two lines.\n> \n> The second is short.\ntrimmed", None),
        (1, 4, "u", "> the first question is this.\n> The second is short.\nnot contiguous", None),
        (2, 0, "u", "> the first question is this.\nelsewhere", None), (2, 1, "u", "> Bye\n> and more\nbeyond the end", None),
    ]
    got = {(r.conv, r.turn): r for r in Q.reply_order(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    parent = {k: (r.parent_conv, r.parent_turn, r.n_linked) for k, r in got.items()}
    assert len(got) == len(rows) and parent[1, 2] == (1, 1, 2) and parent[1, 3] == (1, 0, 1) and parent[2, 0] == (1, 0, 1)
    assert parent[1, 4] == (None, None, 0) and parent[2, 1] == (None, None, 0)


def test_greetings_lead_to_no_other_conversation(spark):
    rows = [
        (1, 1, "u", "Some question\nThanks", None), (1, 2, "u", "> thanks\nwelcome", None),
        (2, 0, "u", "> thanks\nyou too", None), (2, 1, "u", "> Some question\n> Thanks\nnot four words more", None),
        (3, 0, "u", "Thanks\na line that only stands here once\nRegards", None),
        (4, 0, "u", "> Thanks\n> a line that only stands here once\nlong enough", None),
        (5, 0, "u", "> a line that only stands here once\n> Thanks\nanother order", None),
    ]
    got = {(r.conv, r.turn): (r.parent_conv, r.parent_turn) for r in Q.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 2] == (1, 1) and got[2, 0] == (None, None) and got[4, 0] == (3, 0) and got[5, 0] == (None, None)
    assert got[2, 1] == (1, 1), "the passage is the whole text of that message"
    loose = {(r.conv, r.turn): r.parent_conv for r in Q.reply_order(spark.createDataFrame(rows, SCHEMA), foreign_words=1).collect()}
    assert loose[2, 0] == 1


def test_the_query_reaches_stretches(spark):
    rows = [(1, t, "u", f"first {t}\nsecond {t}\nthird {t}", None) for t in range(6)]
    held = Q.parsed(queries.quoting(spark.createDataFrame(rows, SCHEMA).select("conv_id", "turn", "role", "text")))
    own = {r.own_hash for r in held.select("own_hash").collect()}
    asked = [p.hash for r in held.select("passages").collect() for p in r.passages]
    assert sum(h not in own for h in asked) >= 4
    found = Q.links(held).collect()
    assert len(found) == len(asked) and all(r.parent_conv == 1 and r.parent_turn < r.turn for r in found)


def test_long_chain(spark):
    rows = [(1, i, "u", (f"> m{i - 1}\n" if i else "") + f"m{i}", None) for i in range(70)]
    got = Q.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.root == 0 and r.depth == r.turn for r in got)
    whole = Q.conversations(Q.reply_order(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(whole) == 1 and whole[0].texts == [f"m{i}" for i in range(70)]


def test_empty_table(spark):
    assert Q.reply_order(spark.createDataFrame([], SCHEMA)).count() == 0
