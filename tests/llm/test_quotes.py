import hashlib

from pyspark.sql import functions as F

from tidelog.llm import quote_links


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


THREAD = [
    (1, 0, "u", "Hello there my friend.\nHow are you?"),
    (1, 1, "a", "I am fine, thanks."),
    (1, 2, "u", "On Monday A wrote:\n> Hello there my  FRIEND.\n> How are you?\nGood question.\n>> nested none"),
    (1, 3, "a", "> > Hello there my friend.\n> > How are you?\n> Good question.\nYes indeed"),
    (2, 0, "u", "> I am fine, thanks.\nwhy"),
    (2, 1, "a", None),
    (1, 4, "u", "> How are you?\nline quote"),
    (1, 4, "u", "> How are you?\nline quote"),
    (None, None, "u", "z"),
]


def test_links_order_and_own_text(spark):
    df = rows_of(spark, THREAD)
    got = {(r.conv_id, r.turn): r for r in quote_links.link(df).collect()}
    assert quote_links.link(df).count() == len(THREAD)
    assert [got[(1, t)].position for t in range(5)] == [1, 2, 3, 4, 5] and got[(None, None)].position == 1
    assert [got[(1, t)].reply_turn for t in range(5)] == [None, 0, 0, 2, 0]
    assert got[(1, 2)].own_text == "Good question." and got[(1, 3)].own_text == "Yes indeed"
    assert (got[(1, 2)].n_quoted, got[(1, 2)].n_linked, got[(1, 2)].deepest) == (2, 1, 2)
    assert (got[(1, 3)].n_quoted, got[(1, 3)].n_linked, got[(1, 3)].quoted_turn) == (2, 2, 0)
    assert (got[(2, 0)].quoted_conv, got[(2, 0)].quoted_turn, got[(2, 0)].reply_turn) == (1, 1, None)
    assert got[(2, 1)].own_text == "" and got[(2, 1)].reply_turn == 0


def test_rendered_thread_gives_back_its_messages(spark):
    """Every mail quotes the one before, with what that one quoted a level deeper; linking restores texts and replies."""
    bodies = [[f"Body {c} {t} alpha.\nSecond line {c} {t}." for t in range(6)] for c in range(20)]
    mails = []
    for c, texts in enumerate(bodies):
        last = None
        for t, body in enumerate(texts):
            mail = body if last is None else body + "\nOn Monday A wrote:\n" + "\n".join("> " + x for x in last.split("\n"))
            mails.append((c, t, "u", mail))
            last = mail
    got = quote_links.link(rows_of(spark, mails)).collect()
    for r in got:
        assert r.own_text == bodies[r.conv_id][r.turn]
        assert r.reply_turn == (r.turn - 1 if r.turn else None) and r.position == r.turn + 1
        assert (r.n_quoted, r.n_linked, r.deepest) == (r.turn, r.turn, r.turn)


def test_statement_agrees_on_quotes(spark):
    """The DuckDB statement on threads that do quote (the driver's table has no quote)."""
    import duckdb

    rows = [*THREAD, *NULLS]
    rows += [(5, 0, "u", "One line.\n\nTwo > not a quote."), (5, 1, "a", "  > One line.\nLe 3 mai B a écrit :\n>\n> Two > not a quote.\nfin"), (6, 0, "u", "> \n>> Yes indeed\n"), (6, 3, "u", "> unknown words\nx")]
    frame = rows_of(spark, rows)
    con = duckdb.connect()
    con.register("conversations", frame.toArrow())
    want = con.sql(quote_links.ORACLE_OP3)
    names = sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    found = quote_links.link(frame).withColumn("own_sha256", F.sha2("own_text", 256)).select(*names).collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_common_passage_and_empty(spark):
    mails = [(c, t, "u", "> The same line for all.\nown" if t else "The same line for all.") for c in range(50) for t in range(2)]
    got = quote_links.link(rows_of(spark, mails)).collect()
    assert len(got) == 100 and all(r.quoted_conv == r.conv_id and r.reply_turn == 0 for r in got if r.turn)
    assert quote_links.link(rows_of(spark, [])).count() == 0


def test_query_matches_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    source = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    turns = {}
    for c, t in source:
        turns.setdefault(c, []).append(t)
    for r in quote_links.op3(spark, sf).collect():
        before = [t for t in turns[r.conv_id] if t < r.turn]
        assert r.position == len(before) + 1 and r.reply_turn == max(before, default=None) and r.n_quoted == 0
        assert r.own_sha256 == hashlib.sha256((source[(r.conv_id, r.turn)].text or "").encode()).hexdigest()


def test_columns_of_any_name_are_kept(spark):
    """Columns with the names of outputs and of every intermediate value."""
    clash = ["position", "reply_turn", "source", "previous", "answers", "conv_", "at_", "conv_null", "at_null", "conv", "at", "tie", "passages", "own_text", "m", "body", "with.dot", "h", "k"]
    plain = quote_links.link(rows_of(spark, THREAD))
    df = rows_of(spark, THREAD).withColumns({c: F.lit(f"kept {c}") for c in clash})
    out = quote_links.link(df)
    assert out.columns[: 4 + len(clash)] == df.columns and len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert len(rows) == len(THREAD) and all(r[c] == f"kept {c}" for r in rows for c in clash)
    made = plain.columns[4:]
    assert sorted((str(tuple(r)[4 + len(clash) :]) for r in rows)) == sorted(str(tuple(r[c] for c in made)) for r in plain.collect())


def test_an_original_elsewhere_counts_whatever_the_own_conversation_holds(spark):
    """The asking conversation says the passage later, or the asking message says it itself."""
    later = [(1, 0, "u", "> The passage P.\nask"), (1, 5, "u", "The passage P."), (2, 0, "u", "The passage P.")]
    itself = [(1, 0, "u", "> The passage P.\nThe passage P."), (2, 0, "u", "The passage P.")]
    for rows in (later, itself):
        got = {(r.conv_id, r.turn): r for r in quote_links.link(rows_of(spark, rows)).collect()}[(1, 0)]
        assert (got.n_linked, got.quoted_conv, got.quoted_turn) == (1, 2, 0)


NULLS = [
    (5, 0, "u", "> The passage of nine.\nask"), (5, 3, "u", "The passage of nine."), (9, 0, "u", "The passage of nine."), (12, 0, "u", "The passage of nine."),
    (7, None, "u", "Before all."), (7, 0, "u", "between"), (7, 1, "u", "> Before all.\nyes"),
    (None, 0, "u", "> of nobody\nx"), (None, 2, "u", "of nobody"), (13, 4, "u", "of nobody"), (14, 0, "u", "> of nobody\ny"),
]


def test_own_conversation_does_not_hide_another_and_null_turns_come_first(spark):
    rows = [
        (5, 0, "u", "> The passage of nine.\nask"), (5, 3, "u", "The passage of nine."), (9, 0, "u", "The passage of nine."), (12, 0, "u", "The passage of nine."),
        (6, 0, "u", "> only here\nlater"), (6, 1, "u", "only here"),
        (7, None, "u", "Before all."), (7, 0, "u", "between"), (7, 1, "u", "> Before all.\nyes"),
        (None, 0, "u", "> of nobody\nx"), (None, 2, "u", "of nobody"), (13, 4, "u", "of nobody"),
        (14, 0, "u", "> of nobody\ny"),
    ]
    got = {(r.conv_id, r.turn): r for r in quote_links.link(rows_of(spark, rows)).collect()}
    linked = {k: (r.n_linked, r.quoted_conv, r.quoted_turn, r.reply_turn) for k, r in got.items() if r.n_quoted}
    assert linked == {
        (5, 0): (1, 9, 0, None), (6, 0): (0, None, None, None), (7, 1): (1, 7, None, None), (None, 0): (1, 13, 4, None), (14, 0): (1, None, 2, None),
    }
