"""Line-first cleaning (DataFrame functions only).

Every line is judged by punctuation, navigation and boilerplate rules; failing lines go; a document that
loses too much of its text, or is too short, too repetitive or too full of symbols, is rejected.

All of it is row-local: no shuffle, no Python. Repeated word windows are found by hashes first; only
rows that have equal hashes compare the windows themselves, so the counts are exact.

Defined cases: null and empty texts have no words and are rejected (base_failed); lines without a word are
dropped from the cleaned text only where a rule removes them and never count as loss; repeated rows are
judged alike; an empty table gives an empty result; clashing column names of the input aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, free_name, spread, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5


#: Phrases of site notices in four languages, after a word's start and without regard to ASCII case; each begins with a plain letter (fixed values).
BOILERPLATE = (
    r"all rights reserved\b", r"terms of (?:use|service)\b", r"privacy policy\b", r"cookie policy\b", r"use of cookies\b", r"we use cookies\b", r"accept (?:all )?cookies\b",
    r"sign up for our newsletter\b", r"subscribe to our newsletter\b", r"click here to\b", r"skip to (?:main )?content\b", r"share (?:this )?on (?:facebook|twitter)\b",
    r"enable javascript\b", r"javascript is (?:disabled|required)\b", r"lorem ipsum\b",
    r"alle rechte vorbehalten\b", r"nutzungsbedingungen\b", r"allgemeine gesch[äÄ]ftsbedingungen\b", r"datenschutzerkl[äÄ]rung\b", r"cookie-richtlinie\b", r"wir verwenden cookies\b",
    r"cookies akzeptieren\b", r"newsletter abonnieren\b", r"abonnieren sie unseren newsletter\b", r"klicken sie hier\b", r"zum (?:haupt)?inhalt springen\b",
    r"auf (?:facebook|twitter) teilen\b", r"javascript (?:ist deaktiviert|aktivieren)\b",
    r"tous droits r[éÉ]serv[éÉ]s\b", r"conditions (?:g[éÉ]n[éÉ]rales )?d[’']utilisation\b", r"politique de confidentialit[éÉ]", r"politique (?:en mati[èÈ]re )?de cookies\b",
    r"nous utilisons des cookies\b", r"accepter (?:tous )?les cookies\b", r"abonnez-vous [àÀ] notre newsletter\b", r"inscrivez-vous [àÀ] notre newsletter\b", r"cliquez ici\b",
    r"aller au contenu\b", r"partager sur (?:facebook|twitter)\b", r"activer javascript\b",
    r"todos los derechos reservados\b", r"t[éÉ]rminos de (?:uso|servicio)\b", r"condiciones de (?:uso|servicio)\b", r"pol[íÍ]tica de (?:privacidad|cookies)\b", r"utilizamos cookies\b", r"usamos cookies\b",
    r"aceptar (?:todas )?las cookies\b", r"suscr[íÍ]b(?:ase|ete) a nuestro bolet[íÍ]n\b", r"haga clic aqu[íÍ]", r"saltar al contenido\b", r"ir al contenido\b", r"compartir en (?:facebook|twitter)\b",
    r"habilitar javascript\b", r"activar javascript\b",
)


def notices(phrases: tuple[str, ...]) -> str:
    """One pattern for phrases that begin with a letter. They are grouped by it, so that at a word's start a letter is tried once and not once a phrase."""
    rests: dict[str, list[str]] = {}
    for phrase in phrases:
        rests.setdefault(phrase[0], []).append(phrase[1:])
    return r"(?i)\b(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in rests.items()) + ")"


@dataclass(frozen=True)
class Rules:
    """Limits of the line and document rules."""

    min_words: int = 10  # base rule
    max_repeat_percent: int = 20  # base rule
    max_loss: float = 0.5  # share of word characters that removed lines may hold
    min_left_words: int = 10
    max_symbol_share: float = 0.05  # of word characters, per line
    #: a line of that many words or more has a mark that ends a sentence, wherever, or goes on in the next line
    unpunctuated_words: int = 12
    navigation_marks: str = "|»›•>"
    min_navigation_marks: int = 3
    boilerplate: str = notices(BOILERPLATE)
    sentence_end: str = r"[.!?…:;][\"')\]»”’]*(?:[\x20\x09-\x0D]|\z)|[。！？]"
    goes_on: str = r"^[\x20\x09-\x0D]*[a-zà-öø-ÿ]"  # the first letter of a line that continues the one before


def letters(column: Column) -> Column:
    """Number of characters that aren't white space."""
    return F.length(F.translate(column, SPACES, "")).cast("long")


def count_of(column: Column, characters: str) -> Column:
    kept = "".join("\\" + c for c in characters)
    return F.length(F.regexp_replace(column, f"[^{kept}]+", "")).cast("long")


def line_fails(line: Column, after: Column, rules: Rules) -> Column:
    """True for a line that a rule removes; lines without a word never fail. after: the next line, null at the end."""
    escaped = lambda characters: "".join("\\" + c for c in dict.fromkeys(characters))
    marked = line.rlike(f"[{escaped(SYMBOLS + rules.navigation_marks)}]")  # few lines need the next two
    symbols = count_of(line, SYMBOLS) > F.lit(rules.max_symbol_share) * letters(line)
    marks = escaped(rules.navigation_marks)
    navigation = line.rlike(f"^(?:[^{marks}]*+[{marks}]){{{rules.min_navigation_marks}}}")
    long = line.rlike(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){%d}" % rules.unpunctuated_words)
    unended = ~line.rlike(rules.sentence_end) & long & ~F.coalesce(after.rlike(rules.goes_on), F.lit(False))
    return ((marked & (symbols | navigation)) | unended | line.rlike(rules.boilerplate)) & line.rlike(WORD)


def covered_words(starts: Column, width: int) -> Column:
    """Words that windows of that width cover, from their sorted, distinct starts."""
    gaps = F.zip_with(F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))), F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(width)))
    total = F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)
    return F.when(F.size(starts) > 0, total + F.lit(width)).otherwise(F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once and no projection of its own, which would copy the whole row."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column) -> Column:
    """Words within windows of five that the text has twice or more."""

    def exact() -> Column:
        """Windows as arrays of words, sorted with their starts; those equal to a neighbour are repeated."""
        starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
        pairs = F.sort_array(F.transform(starts, lambda i: F.struct(F.slice(words, i, WINDOW).alias("w"), i.alias("i"))))
        same = lambda body, k, x: F.coalesce(F.get(body, k)["w"] == x["w"], F.lit(False))
        marked = lambda body: F.transform(body, lambda x, k: F.when(same(body, k - 1, x) | same(body, k + 1, x), x["i"]))
        return let(let(pairs, lambda body: F.sort_array(F.array_compact(marked(body)))), lambda at: covered_words(at, WINDOW))

    # hashes of five words; the last four are of fewer words and so differ
    windows = lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
    some = lambda wins: (F.size(F.array_distinct(wins)) < F.size(wins)) & (F.size(words) >= WINDOW)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(hashes, windows), lambda wins: F.when(some(wins), exact()).otherwise(F.lit(0)).cast("long"))


def line_facts(text: Column, rules: Rules) -> Column:
    """What the line rules leave of the text."""

    def facts(lines: Column, left: Column) -> Column:
        untouched = F.size(lines) == F.size(left)
        cleaned = F.when(untouched, text).otherwise(F.array_join(left, "\n"))
        with_word = let(F.filter(lines, lambda x: x.rlike(WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
        return F.struct(with_word.cast("long").alias("n_dup_lines"), cleaned.alias("clean_text"), (F.size(lines) - F.size(left)).cast("long").alias("removed_lines"))

    return let(F.split(text, "\n", -1), lambda lines: let(F.filter(lines, lambda x, i: ~line_fails(x, F.get(lines, i + 1), rules)), lambda left: facts(lines, left)))


def clean(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """docs with one more struct column, free_name(docs, "quality"): counts, base_failed, kept, clean_text, removed_lines, loss."""
    raw, out = free_name(docs, "_q_raw"), free_name(docs, "_q_facts")
    body = text_of(text)
    counts = let(
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)),
        lambda words: F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).alias("n_repeat_words")),
    )
    r, f = F.col(raw), F.col(out)
    untouched = r["lines"]["removed_lines"] == 0
    n_letters = letters(body)
    whole = F.struct(
        r["counts"]["n_words"].alias("n_words"), n_letters.alias("word_chars"), count_of(body, SYMBOLS).alias("n_symbols"),
        r["lines"]["n_dup_lines"].alias("n_dup_lines"), r["counts"]["n_repeat_words"].alias("n_repeat_words"), r["lines"]["clean_text"].alias("clean_text"),
        F.when(untouched, n_letters).otherwise(letters(r["lines"]["clean_text"])).alias("left_chars"),
        F.when(untouched, r["counts"]["n_words"]).otherwise(F.regexp_count(r["lines"]["clean_text"], F.lit(WORD)).cast("long")).alias("left_words"),
        r["lines"]["removed_lines"].alias("removed_lines"),
    )
    # a row of its own for each: a filter on the outcome isn't pushed below it, which would compute the facts again for each of its fields
    facts = F.explode(F.array(F.struct(counts.alias("counts"), line_facts(body, rules).alias("lines"))))
    df = docs.withColumn(raw, facts).withColumn(out, whole).drop(raw)
    base = (f["n_words"] < rules.min_words) | (100 * f["n_repeat_words"] > rules.max_repeat_percent * f["n_words"])
    loss = F.when(f["word_chars"] > 0, 1 - f["left_chars"] / f["word_chars"]).otherwise(F.lit(0.0))
    kept = ~base & (loss <= rules.max_loss) & (f["left_words"] >= rules.min_left_words)
    return df.withColumn(free_name(docs, "quality"), f.withField("base_failed", base).withField("loss", loss).withField("kept", kept)).drop(out)


def op7(spark, sf_dir: str) -> DataFrame:
    """The contract query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = F.col("quality")
    return clean(spread(docs)).select(
        "doc_id", *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_lines", "left_chars", "left_words")],
        F.sha2(q["clean_text"], 256).alias("clean_sha256"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are kept, with their cleaned text, in the columns of documents."""
    name = free_name(docs, "quality")
    q = F.col(name)
    done = clean(docs).where(q["kept"]).withColumn("text", q["clean_text"])
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def _oracle() -> str:
    r = Rules()
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    spaces = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    symbols = r"[#*$%&|<>]"
    n_letters = lambda x: f"length(translate({x}, {spaces}, ''))"
    n_of = lambda x, p: f"len(regexp_extract_all({x}, {quoted(p)}))"
    fails = f"""regexp_matches(line, {quoted(WORD)}) AND (
      {n_of("line", symbols)} > {r.max_symbol_share} * {n_letters("line")} OR {n_of("line", f"[{r.navigation_marks}]")} >= {r.min_navigation_marks}
      OR ({n_of("line", WORD)} >= {r.unpunctuated_words} AND NOT regexp_matches(line, {quoted(r.sentence_end)}) AND NOT coalesce(regexp_matches(after, {quoted(r.goes_on)}), false)) OR regexp_matches(line, {quoted(r.boilerplate)}))"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, {quoted(WORD)}) AS ws FROM d),
i AS (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i FROM w),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, list_slice(ws, i, i + {WINDOW - 1})) AS n FROM i),
rep AS (
  SELECT rid, CAST(sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS BIGINT) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM win WHERE n > 1) GROUP BY 1
),
s AS (SELECT rid, generate_subscripts(s, 1) AS k, unnest(s) AS line FROM (SELECT rid, string_split(t, chr(10)) AS s FROM d)),
l AS (SELECT *, lead(line) OVER (PARTITION BY rid ORDER BY k) AS after FROM s),
j AS (SELECT *, regexp_matches(line, {quoted(WORD)}) AS has_word, {fails} AS fails FROM l),
c AS (
  SELECT rid, count(*) FILTER (has_word) - count(DISTINCT line) FILTER (has_word) AS n_dup_lines, count(*) FILTER (fails) AS removed_lines,
         coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT fails), '') AS clean
  FROM j GROUP BY 1
),
f AS (
  SELECT d.doc_id, len(ws) AS n_words, {n_letters("t")} AS word_chars, {n_of("t", symbols)} AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, removed_lines,
         {n_letters("clean")} AS left_chars, {n_of("clean", WORD)} AS left_words, sha256(clean) AS clean_sha256
  FROM d JOIN w USING (rid) JOIN c USING (rid) LEFT JOIN rep USING (rid)
)
SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed,
       NOT (n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words)
       AND (word_chars = 0 OR 1 - left_chars / word_chars <= {r.max_loss}) AND left_words >= {r.min_left_words} AS kept
FROM f
"""


ORACLE_OP7 = _oracle()
