"""Quotation linking and reply order, by hand and against SQL."""

import duckdb
import pyarrow as pa

from rigscope.llm import chat
from rigscope.llm import queries
from rigscope.llm.tables import read

SCHEMA = "root string, conv_id long, turn long, role string, text string, position string"
TALK = [
    (1, 0, "user", "How do I sort a list in place?\nIt has many rows."),
    (1, 1, "assistant", "Use the sort method of the list.\n\nIt keeps equal rows in order."),
    (1, 2, "user", "An unrelated remark about the weather."),
    (1, 3, "user", "> Use the sort   method of the LIST.\nDoes it return anything?"),
    (1, 4, "assistant", "> > Use the sort method of the list.\n> Does it return anything?\nNo, it gives None."),
    (1, 5, "user", ">> Does it return anything?\n> No, it gives None.\nThank you!"),
    (1, 6, "user", "> An unrelated remark about the weather\nTrue."),
    (1, 7, "user", "> words that nobody has written before\nWho said that?"),
    (1, 8, "user", "> Thank you!\n> > No, it gives None.\n>>> Does it return anything?\n\nDeep."),
    (1, 9, "user", "  > indented quote marks\n\t>\n>"),
    (1, 10, "user", ""),
    (2, 0, None, None),
    (2, 1, "user", "Use the sort method of the list."),
    (2, 2, "user", "> How do I sort a list in place?\nNot of this conversation."),
    (2, 3, "user", "> > It keeps equal rows in order.\n> Use the sort method of the list.\nhere"),
    (3, 0, "user", "> It quotes what comes later on\nfirst"),
    (3, 1, "user", "It quotes what comes later on"),
    (3, 2, "user", "It quotes what comes later on"),
    (3, 3, "user", "> It quotes what comes later on\nagain"),
]


def frame(spark, rows):
    return spark.createDataFrame([("clash", *r, "clash") for r in rows], SCHEMA)


def test_links_and_order(spark):
    got = {(r.conv, r.turn): r for r in chat.linked_messages(frame(spark, TALK)).collect()}
    assert len(got) == len(TALK)
    replies = {k: r.reply_to for k, r in got.items() if r.reply_to is not None}
    assert replies == {(1, 3): 1, (1, 4): 3, (1, 5): 4, (1, 6): 2, (1, 8): 5, (2, 3): 1, (3, 3): 1}
    assert {k: r.root for k, r in got.items() if k[0] == 1} == {
        (1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 1, (1, 4): 1, (1, 5): 1, (1, 6): 2, (1, 7): 7, (1, 8): 1, (1, 9): 9, (1, 10): 10}
    order = [t for _, t in sorted((r.position, k[1]) for k, r in got.items() if k[0] == 1)]
    assert order == [0, 1, 3, 4, 5, 8, 2, 6, 7, 9, 10]
    assert got[1, 4].own == "No, it gives None." and got[1, 9].own == "" and got[1, 7].n_linked == 0


def test_sql_gives_the_same(spark, monkeypatch):
    con = duckdb.connect()
    con.register("conversations", pa.table({n: [r[k] for r in TALK] for k, n in enumerate(
        ("conv_id", "turn", "role", "text"))}))
    want = sorted(con.sql(chat.op7_sql()).fetchall())
    monkeypatch.setattr(queries, "read", lambda *a: frame(spark, TALK))
    assert sorted(
        tuple(r) for r in queries.op7_chat_formatting(spark, "").collect()) == want


def test_long_conversation_spreads_and_goes_on_in_blocks(spark):
    n = 700
    rows = [(5, 0, "user", "message number zero")] + [
        (5, k, "user", f"> message number {k - 1 if k > 1 else 'zero'}\nmessage number {k}") for k in range(1, n)]
    rows += [(6, k, "user", "the same words here") for k in range(100)]
    said = chat.linked_messages(frame(spark, rows)).collect()
    assert all(r.root == 0 and r.position == r.turn and r.reply_to == (r.turn - 1 if r.turn else None)
               for r in said if r.conv == 5)
    blocks = chat.formatted(frame(spark, rows)).where("conv_id = 5").orderBy("block").collect()
    assert [b.n_messages for b in blocks] == [64] * 10 + [60]
    assert ",".join(b.turns for b in blocks) == ",".join(map(str, range(n)))


def test_odd_rows(spark):
    rows = [(None, 1, "user", "> quoted words here\nx"), (None, 0, "user", "quoted words here"), (7, None, "user", "no turn"),
            (7, 1, "a", "b"), (7, 1, "a", "b"), (7, 1, "a", "> no turn\n> no turn"), (8, 0, "user", "line\n" * 3000),
            (8, 1, "user", "> line\n" * 3000 + "ok"), (8, 1, "user", "> line\n" * 3000 + "ok")]
    got = chat.linked_messages(frame(spark, rows)).collect()
    assert sorted((str(r.conv), r.position) for r in got) == sorted(
        [("None", 0), ("None", 1), ("7", 0), ("7", 1), ("7", 2), ("7", 3), ("8", 0), ("8", 1), ("8", 2)])
    assert [r.reply_to for r in got if r.conv == 8 and r.turn == 1] == [0, 0]
    assert chat.formatted(frame(spark, [])).collect() == []


def test_documents_match_sql_and_plan_has_no_python(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/sf0.001/conversations.parquet')")
    found = queries.op7_chat_formatting(spark, "/root/testdata/sf0.001")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(chat.op7_sql()).fetchall())
    assert read(spark, "/root/testdata/sf0.001", "conversations").count() == sum(r.n_messages for r in found.collect())
