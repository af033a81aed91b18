"""Secret scans by a trigram inverted index (DataFrame functions only).

``trigram_query`` derives from a rule's regular expression a Boolean query over trigrams that every
match must satisfy. The index holds, for each trigram that some query names, the keys (64-bit text hashes)
of the texts that contain it in either case. Postings are intersected by one aggregation that ORs
trigram bits per key (copies of a text share a key, so hot copies fold before the shuffle), queries are
evaluated on the bits, and only candidates run the rule's expression over the whole text. Rules without a
mandatory trigram scan every text. Two texts that share a hash can only add candidates, never lose one.

Defined cases: null is the empty text, which has no span; repeated rows each get their result; ids may be
null or tie; an empty table gives an empty result; extra columns are kept, whatever their names, and the result's column gets
underscores where its name is taken. Offsets count code points. Work grows with a text's length, and with its matches to the power of one and a half.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_checked, spread, staged, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: characters that the group (0: the whole match) must have for the match to stay."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


def _either_case(word: str) -> str:
    """A word in ASCII letters of either case; engines differ in what else an ignore-case flag lets in."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


RULES = (
    Rule("assign", f"(?:{'|'.join(map(_either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),  # the same spans as runs of any length, filtered
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)

#: A set of exact strings is cut off here and turned into a query.
MOST_STRINGS = 32
BITS = 60  # trigram bits in one long


def trigram_query(pattern: str):
    """True (every text may match), a trigram, or ("and"/"or", [queries]); trigrams are in lower case."""
    return _concat(list(sre_parser.parse(pattern)))


def _concat(items) -> object:
    parts, strings = [], {""}
    for exact, query in map(_item, items):
        if exact is not None and len(strings) * len(exact) <= MOST_STRINGS:
            strings = {a + b for a, b in itertools.product(strings, exact)}
            continue
        parts.append(_of_strings(strings))
        if exact is None:
            parts.append(query)
            strings = {""}
        else:
            strings = set(exact)
    return _join("and", [*parts, _of_strings(strings)])


def _exact(items) -> set[str] | None:
    """The strings that a sequence can match, if they are few."""
    strings = {""}
    for exact, _ in map(_item, items):
        if exact is None or len(strings) * len(exact) > MOST_STRINGS:
            return None
        strings = {a + b for a, b in itertools.product(strings, exact)}
    return strings


def _item(item) -> tuple[set[str] | None, object]:
    """(strings that the node can match, or None; else a query that its matches satisfy)."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg).lower()}, True
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
        return {chr(a).lower() for _, a in arg}, True
    if op is sre.SUBPATTERN:
        inner = list(arg[-1])
        return (_exact(inner), True) if _exact(inner) is not None else (None, _concat(inner))
    if op is sre.BRANCH:
        sets = [_exact(list(x)) for x in arg[1]]
        if all(s is not None for s in sets):
            return set().union(*sets), True
        return None, _join("or", [_concat(list(x)) for x in arg[1]])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        exact = _exact(list(inner))
        if exact is not None and high != sre.MAXREPEAT and sum(len(exact) ** k for k in range(low, int(high) + 1)) <= MOST_STRINGS:
            return {"".join(x) for k in range(low, int(high) + 1) for x in itertools.product(exact, repeat=k)}, True
        return None, _concat(list(inner)) if low else True
    return None, True


def _of_strings(strings: set[str]) -> object:
    if any(len(s) < 3 for s in strings):
        return True
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [x for x in sets if not any(y < x for y in sets)]  # a weaker condition absorbs stronger ones
    return _join("or", [_join("and", sorted(x)) for x in sorted(least, key=sorted)])


def _join(how: str, parts: list) -> object:
    if how == "or" and any(p is True for p in parts):
        return True
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else (how, parts)


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def any_of(words: list[str]) -> str:
    """A regular expression for any of the words, as a tree of their letters, so that a place is turned down after a few comparisons."""
    quoted = lambda text: re.sub(r"([^A-Za-z0-9])", r"\\\1", text)
    one_of = lambda letters: "[" + "".join(map(quoted, letters)) + "]"
    rest = {c: sorted(w[1:] for w in words if w[0] == c) for c in sorted({w[0] for w in words})}
    if not any(any(tails) for tails in rest.values()):
        return one_of(rest)
    branch = lambda c: quoted(c) + (any_of(rest[c]) if any(rest[c]) else "")
    letters = list(rest)
    if len(letters) <= 4:
        return "(?:" + "|".join(map(branch, letters)) + ")"
    width = -(-len(letters) // 4)
    parts = [letters[i : i + width] for i in range(0, len(letters), width)]
    return "(?:" + "|".join(f"(?={one_of(part)})(?:{'|'.join(map(branch, part))})" for part in parts) + ")"


def postings(docs: DataFrame, wanted: list[str], text: str = "text") -> DataFrame:
    """The inverted index: (trigram, key) for each of the wanted trigrams (by number) that a text contains; one pass over a text finds all."""
    body = text_of(text)
    found = F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(f"(?=({any_of(wanted)}))"), F.lit(1)))
    number = F.array_position(F.array(*map(F.lit, wanted)), F.col("gram")) - 1
    return docs.select(F.xxhash64(body).alias("key"), F.explode(found).alias("gram")).select("key", number.cast("int").alias("trigram"))


def candidates(index: DataFrame, queries: list, wanted: list[str]) -> DataFrame:
    """Intersect: (key, hits), where bit i of hits says that the text may match query i."""
    words = range((len(wanted) + BITS - 1) // BITS)
    bits = [
        F.bit_or(F.when(F.expr(f"trigram div {BITS}") == w, F.expr(f"shiftleft(1L, cast(trigram % {BITS} as int))")).otherwise(F.lit(0).cast("long"))).alias(f"b{w}")
        for w in words
    ]
    at = {t: i for i, t in enumerate(wanted)}

    def holds(query) -> Column:
        if isinstance(query, str):
            i = at[query]
            return F.col(f"b{i // BITS}").bitwiseAND(F.lit(1 << i % BITS)) != 0
        return reduce(lambda a, b: a & b if query[0] == "and" else a | b, map(holds, query[1]))

    hits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(holds(q), F.lit(1 << i)).otherwise(F.lit(0)) for i, q in enumerate(queries) if q is not True])
    return index.groupBy("key").agg(*bits).select("key", hits.cast("long").alias("hits")).where("hits != 0")


def running(numbers: Column) -> Column:
    """For each number of an array the sum of those before it. Appending copies, so sums go by blocks of the square root of the length."""
    zero = F.array(F.lit(0).cast("long"))

    def sums(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def by_blocks(values: Column, width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(values), width), lambda i: F.slice(values, i, width))

        def joined(blocks: Column) -> Column:
            totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + x))
            # sums() gives one entry more than it has numbers
            own = lambda b, start: F.slice(sums(b, start), 1, F.size(b))
            return F.flatten(let(sums(totals, F.lit(0).cast("long")), lambda starts: F.transform(blocks, lambda b, i: own(b, F.get(starts, i)))))

        return let(blocks, joined)

    return F.when(F.size(numbers) == 0, F.slice(zero, 1, 0)).otherwise(let(numbers, lambda values: by_blocks(values, F.ceil(F.sqrt(F.size(values))).cast("int"))))


def spans_of(text: Column, rule: Rule, kind: int) -> Column:
    """The rule's matches in order as (start, kind, end): pieces between matches and matches are summed up."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    pairs = F.zip_with(pieces, whole, lambda piece, match: F.array(F.length(piece).cast("long"), F.length(match).cast("long")))
    places = running(F.filter(F.flatten(pairs), lambda n: n.isNotNull()))  # piece, match, piece, match, ..., piece
    span = lambda at: F.transform(judged, lambda j, i: F.when(
        F.length(j) >= rule.least, F.struct(F.get(at, 2 * i + 1).cast("int").alias("start"), F.lit(kind).alias("kind"), F.get(at, 2 * i + 2).cast("int").alias("end")),
    ))
    return let(places, lambda at: F.array_compact(span(at)))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with one more column, free_name(docs, "secrets"): array of (start, kind, end) by start, then by the rules' order."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(trigrams_of, queries)))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    key, hits, out = (free_name(docs, x) for x in ("_secret_key", "_secret_hits", "secrets"))
    df = docs.withColumn(key, F.xxhash64(text_of(text)))
    if wanted:
        index = staged(postings(docs, wanted, text), "secret-postings")
        few = staged(candidates(index, queries, wanted), "secret-candidates")
        df = join_checked(df, few.select(F.col("key").alias(key), F.col("hits").alias(hits)), [key], "left")
    else:
        df = df.withColumn(hits, F.lit(0).cast("long"))
    body = text_of(text)
    found = []
    for i, (rule, query) in enumerate(zip(rules, queries)):
        may = body.rlike(rule.pattern) if query is True else F.coalesce(F.col(hits).bitwiseAND(F.lit(1 << i)) != 0, F.lit(False))
        found.append(F.when(may, spans_of(body, rule, i)).otherwise(none))
    return df.withColumn(out, F.sort_array(F.concat(*found))).drop(key, hits)


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9(spark, sf_dir: str) -> DataFrame:
    """The contract query over all documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = scan(docs).select("doc_id", "secrets")
    n_base = sum(r.base for r in RULES)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.filter("secrets", lambda s: s["kind"] < n_base)), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"),
    )


def _oracle() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {i} AS kind, '{r.kind}' AS name, {r.least} AS least, generate_subscripts(string_split_regex(t, '{p}'), 1) AS k, "
            f"unnest(string_split_regex(t, '{p}')) AS piece, unnest(regexp_extract_all(t, '{p}')) AS whole, unnest(regexp_extract_all(t, '{p}', {r.group})) AS judged "
            f"FROM d WHERE regexp_matches(t, '{p}')"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
s AS (
  SELECT *, CAST(sum(length(piece) + coalesce(length(whole), 0)) OVER (PARTITION BY rid, kind ORDER BY k) AS BIGINT) AS stop FROM m
),
f AS (SELECT rid, kind, name, stop - length(whole) AS start, stop FROM s WHERE whole IS NOT NULL AND length(judged) >= least),
g AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM f GROUP BY rid
)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


ORACLE_OP9 = _oracle()
