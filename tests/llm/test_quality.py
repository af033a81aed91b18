import collections
import re

from tidelog.llm import line_quality

from .helpers import awkward, docs, prose, words


def base(t):
    t = t or ""
    w = words(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, covered = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def facts(spark, rows):
    out = line_quality.clean(docs(spark, rows))
    name = [c for c in out.columns if c.startswith("quality")][-1]
    return [r[name] for r in out.collect()]


def test_base_counts(spark):
    more = ["a b c d e f " * 3, "x y z", "one two three four five six seven eight nine ten\n" * 2, "# | a b c d e f g h i j k", "é b " * 12, "w " * 400]
    rows = awkward(enumerate(more, 50))
    for (_, t, *_), q in zip(rows, facts(spark, rows)):
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == base(t)


def test_lines_go_and_losers_go(spark):
    good = prose(6, 9)
    cases = {
        "\n".join(good): (0, True),
        "\n".join([*good, "Home | About | Contact | News | Shop"]): (1, True),
        "\n".join([*good, "By using this site you accept our cookie policy and so on."]): (1, True),
        "\n".join([*good, "a line of very many words that never comes to any kind of an end at all"]): (1, True),
        "\n".join(["Home | About | Contact | News | Shop" * 9, good[0], good[1]]): (1, False),
        "\n".join(["###*** $$$ %%% &&& word"] * 20 + good[:1]): (20, False),
    }
    rows = [(k, t, "en", "s", 1, "q", "x", 1) for k, t in enumerate(cases)]
    for want, q in zip(cases.values(), facts(spark, rows)):
        assert (q.removed_lines, q.kept) == want, q


def test_clean_documents_stay_whole(spark):
    rows = [(k, "\n".join(prose(20, 100 + k)), "en", "s", 1, "q", "x", 1) for k in range(30)]
    for r, q in zip(rows, facts(spark, rows)):
        assert q.kept and q.removed_lines == 0 and q.clean_text == r[1]


def test_stage_and_empty(spark):
    rows = awkward()
    out = line_quality.stage(spark, docs(spark, rows), "")
    assert out.columns == docs(spark, rows).columns and all(r.n_chars == len(r.text) for r in out.collect())
    assert line_quality.stage(spark, docs(spark, []), "").count() == 0


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen"


def test_punctuation_rule_reads_the_whole_line(spark):
    good = prose(6, 9)
    gone = {
        LONG + ".": False, LONG + "." + " " * 80: False, LONG + ".\r": False, "First sentence here. " + LONG: False, LONG + "。" + LONG: False, LONG: True, LONG + " v1.2x of a": True, LONG + "." + "x" * 70: True,
        LONG + "\nand goes on here.": False, LONG + "\nÉt": True, "short line": False,
    }
    rows = [(k, "\n".join([*good, x]), "en", "s", 1, "q", "x", 1) for k, x in enumerate(gone)]
    assert [q.removed_lines == 1 for q in facts(spark, rows)] == list(gone.values())


def test_notices_in_four_languages(spark):
    good = prose(6, 9)
    notices = [
        "© 2020 Acme. All rights reserved.", "Alle Rechte vorbehalten.", "Unsere Datenschutzerklärung lesen.", "Tous droits réservés.", "Voir la politique de confidentialité.", "Todos los derechos reservados.",
        "Utilizamos cookies propias.", "Lea la POLÍTICA DE PRIVACIDAD.",
    ]
    rows = [(k, "\n".join([*good, x]), "en", "s", 1, "q", "x", 1) for k, x in enumerate([*notices, "Das Recht ist vorbehalten.", "Los derechos de todos."])]
    assert [q.removed_lines for q in facts(spark, rows)] == [1] * len(notices) + [0, 0]


def test_statement_agrees_on_awkward_rows(spark):
    """The DuckDB statement over rows that the driver's table doesn't have; neither side shares the other's expressions for windows and lines."""
    import duckdb

    more = [LONG, LONG + "\nand goes on here.", "Home | About | News | Shop\n" * 3, "# % word\nAlle Rechte vorbehalten.\n\n" + "\n".join(prose(9, 5)), "a b c d e f " * 3, "x\r\ny\x0bz"]
    rows = [r for r in awkward(enumerate(more, 60)) if not r[1] or "\x00" not in r[1]]
    frame = docs(spark, rows)
    con = duckdb.connect()
    con.register("documents", frame.select("doc_id", "text").toPandas())
    want = con.sql(line_quality.ORACLE_OP7)
    names = [c for c in want.columns if c not in ("doc_id", "clean_sha256")]
    got = line_quality.clean(frame)
    name = [c for c in got.columns if c.startswith("quality")][-1]
    plain = lambda i: None if i is None or i != i else int(i)
    found = sorted((str(r.doc_id), *(r[name][c] for c in names)) for r in got.collect())
    at = [want.columns.index(c) for c in names]
    assert found == sorted((str(plain(r[want.columns.index("doc_id")])), *(r[i] for i in at)) for r in want.fetchall())


def test_op7_is_the_operator_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = line_quality.op7(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id]) and not (r.base_failed and r.kept)


def test_notices_are_the_phrases():
    """The grouped pattern finds what its phrases find one by one, in any case, at a word's start only."""
    grouped = re.compile(line_quality.notices(line_quality.BOILERPLATE))
    plain = [re.compile(r"(?i)\b" + p) for p in line_quality.BOILERPLATE]
    said = ["cookies akzeptieren", "Alle Cookies akzeptieren", "xcookies akzeptieren", "INSCRIVEZ-VOUS À notre newsletter", "términos de uso", "Condiciones de servicio", "usamos cookies",
            "ir al contenido", "partir al contenido", "activar javascript", "Privacy Policy", "privacy policyholder", "a clean sentence, all right", "lorem ipsum dolor", "datenschutzerklärung", ""]
    said += [re.sub(r"\(\?:|\)\??|\\b|\|.*", "", re.sub(r"\[(.).\]", r"\1", p)) for p in line_quality.BOILERPLATE]
    assert all(p[0].isascii() and p[0].isalpha() for p in line_quality.BOILERPLATE)
    for text in said:
        assert bool(grouped.search(text)) == any(p.search(text) for p in plain), text
    assert [bool(grouped.search(t)) for t in said[:16]] == [True, True, False, True, True, True, True, True, False, True, True, False, False, True, True, False]


def test_the_stage_judges_lines_once(spark):
    """The filter on the outcome isn't computed from the text again."""
    df = line_quality.stage(spark, spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), "")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("orem ipsum") == 1
