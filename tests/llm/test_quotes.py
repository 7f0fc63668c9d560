"""Quotation parsing and linking, and messages that have odd contents."""

from cataloom.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, body string, depth int"


def _threads(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return {(r["conv_id"], r["seq"]): r for r in quotes.threads(docs).collect()}


def test_levels_and_passages():
    text = "On Monday Ann wrote:\n> > deep  One\n> >two\n>\n> Near\n> \n>> other\n\nown\n\n  Line "
    body, passages = quotes.parse(text)
    assert body == "own\n\n  Line "
    assert passages == [(2, "deep one two"), (2, "deep one"), (2, "two"), (1, "near"), (2, "other"), (0, "own"), (0, "line")]
    assert quotes.parse(None) == ("", []) and quotes.parse("> x") == ("", [(1, "x")])
    assert quotes.parse("> ...") == ("", [])


def test_replies_in_order(spark):
    rows = [
        (1, 0, "user", "What is a lattice?\nAnd a field?"),
        (1, 1, "user", "Unrelated words"),
        (1, 2, "user", "> and A FIELD?\n\nA ring."),
        (1, 3, "user", "> what is   a lattice? and a\n> field?\nAn order."),
        (1, 4, "user", ">> And a field?\n> A ring.\nNo."),
        (2, 0, "user", "> what is a lattice?\nelsewhere"),
    ]
    got = _threads(spark, rows)
    assert [got[1, k]["answers"] for k in range(1, 6)] == [None, None, 1, 1, 3]  # the fourth message's quote is wrapped anew
    assert [got[1, k]["depth"] for k in range(1, 6)] == [0, 0, 1, 1, 2]
    assert [got[1, k]["reply_order"] for k in range(1, 6)] == [0, 4, 1, 3, 2]
    assert got[1, 5]["quoted"] == "1:3 2:1" and got[1, 5]["body"] == "No." and got[2, 1]["answers"] is None
    rows[3] = (1, 3, "user", "> what was a lattice? and a\n> ring?\nAn order.")
    assert _threads(spark, rows)[1, 4]["answers"] is None


def test_ties_repeats_nulls_and_long_texts(spark):
    long = "word " * 200_000
    rows = [(1, 0, "a", "same"), (1, 1, "a", "same"), (1, 2, "a", "> same\nx"), (1, 2, "a", "> same\nx"), (1, 3, None, None), (1, None, "a", ""), (None, 0, "a", "solo"), (None, 1, "a", "> solo\ny"), (3, 0, "a", long), (3, 1, "a", "> " + long + "\nz")]
    got = _threads(spark, rows)
    assert len(got) == len(rows)
    by = {r["body"]: r for r in got.values()}
    twice = sorted((r["seq"], r["answers"]) for r in got.values() if r["body"] == "x")
    assert [a for _, a in twice] == [3, 3]  # the null turn is first; of equal passages the latest earlier message counts
    assert by["y"]["answers"] == 1 and by["z"]["answers"] == 1 and by["z"]["depth"] == 1


def test_empty_table(spark):
    assert quotes.threads(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bodies_are_the_messages_that_quotes_were_put_on(spark):
    made = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    out = quotes.threads(quotes.quoted_conversations(made)).collect()
    before = {(r["conv_id"], r["turn"]): r["text"] for r in made.collect()}
    assert all(r["body"] == before[r["conv_id"], r["turn"]].strip("\n") for r in out)
    # within a conversation the turn that was quoted is found, whatever its length
    for r in out:
        if r["turn"] and r["turn"] % 5 != 4 and not (r["turn"] % 3 == 2 and r["turn"] < 2):
            assert r["answers"] == r["seq"] - (2 if r["turn"] % 3 == 2 else 1)
