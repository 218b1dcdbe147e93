"""Secret scanning with a trigram inverted index, in DataFrame operations only.

A Boolean trigram query is derived from each rule's regex (Cox, 2012): every match must hold the
trigrams that the query asks for. The index holds, for the trigrams that any rule asks for, which
documents have them; a rule's postings are intersected and united as its query says, and only the
candidates are matched against the regex. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import free_names, named, quoted, running_sums, text_of, written

#: Exact strings a part of a regex may stand for before they are turned into a query, and trigrams asked of each.
EXACT_MOST, TRIGRAMS_MOST = 64, 3
#: Bits used of each BIGINT of the postings' bit sets.
BITS = 62


@dataclass(frozen=True)
class Rule:
    """A kind of secret: `least` is the least length of `group` in a match that counts."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base kinds, in order, then well-known credential formats. The length conditions of
#: access and hex are inside their patterns: both match maximal runs, of which the short ones fail.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A query is True (no condition), a trigram, or ("and" | "or", frozenset of queries).
Query = bool | str | tuple


def _combine(kind: str, parts: list[Query]) -> Query:
    if kind == "or" and any(p is True for p in parts):
        return True
    flat = {q for p in parts if p is not True for q in (p[1] if isinstance(p, tuple) and p[0] == kind else [p])}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _spread(trigrams: list[str]) -> list[str]:
    """A few trigrams of a string, its first and last among them: the others would rule out little more, and each is looked for in every text."""
    n = len(trigrams)
    return trigrams if n <= TRIGRAMS_MOST else [trigrams[round(k * (n - 1) / (TRIGRAMS_MOST - 1))] for k in range(TRIGRAMS_MOST)]


def _of_strings(strings: set[str]) -> Query:
    return _combine("or", [_combine("and", _spread([s[i : i + 3] for i in range(len(s) - 2)]) if len(s) >= 3 else [True]) for s in strings])


def _parts(node) -> tuple[set[str] | None, Query]:
    """The exact strings that a parsed regex stands for, if few, and what else each match must hold."""
    exact, queries = {""}, []
    for op, arg in node:
        more, query = _part(op, arg)
        queries.append(query)
        if more is not None and exact is not None and len(exact) * len(more) <= EXACT_MOST:
            exact = {a + b for a in exact for b in more}
            continue
        if exact is not None:
            queries.append(_of_strings(exact))
        exact = {""} if more is None else more
        queries.append(False)  # a gap: what follows does not adjoin what came before, or not all of it
    gap = any(q is False for q in queries)
    queries = [q for q in queries if q is not False]
    if gap or len(queries) > 1 and not exact:
        return None, _combine("and", [*queries, _of_strings(exact)])
    return exact, _combine("and", queries)


def _part(op, arg) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, True
    if op is sre.IN:
        some: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                some.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                some |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (some, True) if len(some) <= 8 else (None, True)
    if op is sre.SUBPATTERN:
        return _parts(arg[-1])
    if op is sre.BRANCH:
        each = [_parts(p) for p in arg[1]]
        if all(e is not None for e, _ in each) and sum(len(e) for e, _ in each) <= EXACT_MOST:
            return set().union(*(e for e, _ in each)), True
        return None, _combine("or", [_combine("and", [q, _of_strings(e)]) if e is not None else q for e, q in each])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, inner = arg
        exact, query = _parts(inner)
        if exact is not None and (low, high) == (0, 1):
            return exact | {""}, True
        if exact is not None and low == high and len(exact) ** low <= EXACT_MOST:
            return reduce(lambda a, b: {x + y for x in a for y in b}, [exact] * low, {""}), query
        return None, _combine("and", [query, _of_strings(exact)]) if low and exact is not None else query if low else True
    if op is sre.AT:
        return {""}, True
    return None, True


def trigram_query(regex: str) -> Query:
    """What the lower-cased form of a text must hold for the regex to match it; True if that cannot be said."""
    exact, query = _parts(sre_parser.parse(regex))
    return _combine("and", [query, _of_strings(exact)]) if exact is not None else query


def trigrams_of(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set() if query is True else set().union(*map(trigrams_of, query[1]))


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """(id, of, tri): the inverted index, a row for each of `trigrams` that a text holds in lower case."""
    low = keyed.select("id", "of", F.lower("text").alias("low"))
    return low.select("id", "of", F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams)]))).alias("tri"))


def _holds(query: Query, at: dict[str, int]) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        k = at[query]
        return F.col(f"bits{k // BITS}").bitwiseAND(F.lit(1 << k % BITS)) != 0
    parts = [_holds(q, at) for q in sorted(query[1], key=str)]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


def candidates(index: DataFrame, rules: list[tuple[str, Query]], trigrams: list[str]) -> DataFrame:
    """(id, of, kinds): the rules whose postings, intersected and united as their queries say, hold a document."""
    at = {t: k for k, t in enumerate(trigrams)}
    words = range((len(trigrams) + BITS - 1) // BITS)
    bits = [F.bit_or(F.when((F.col("tri") >= w * BITS) & (F.col("tri") < (w + 1) * BITS), F.expr(f"shiftleft(1L, tri - {w * BITS})")).otherwise(F.lit(0).cast("long"))).alias(f"bits{w}") for w in words]
    kinds = F.array_compact(F.array(*[F.when(_holds(q, at), F.lit(kind)) for kind, q in rules]))
    return index.groupBy("id", "of").agg(*bits).select("id", "of", kinds.alias("kinds")).where(F.size("kinds") > 0)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "secrets") -> DataFrame:
    """`docs` with a column `out`: ARRAY<STRUCT<start, rule, kind, end>> of code point spans, by start, then the rules' order.

    Matches of a rule are leftmost and do not overlap; those that fail its length are dropped. A null text
    is empty. Rows may repeat ids or have none; other columns are kept, one named `out` is replaced. An
    empty table gives no rows.
    """
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = [(r.kind, queries[r.kind]) for r in rules if queries[r.kind] is not True]
    trigrams = sorted(set().union(*(trigrams_of(q) for _, q in indexed)))
    text = text_of(text_col)
    ident, of = F.col(quoted(id_col)).cast("string"), F.xxhash64(text)
    own = [c for c in docs.columns if c != out]
    n_id, n_of, n_kinds, n_found = free_names([*docs.columns, out], "id", "of", "kinds", "found")
    rows = docs
    if indexed:
        index = postings(docs.select(ident.alias("id"), of.alias("of"), text.alias("text")), trigrams)
        found = written(candidates(index, indexed, trigrams), "secret-candidates").withColumnsRenamed({"id": n_id, "of": n_of, "kinds": n_kinds})
        rows = rows.join(found, ident.eqNullSafe(F.col(n_id)) & (of == F.col(n_of)), "left")
    asked = {r.kind: F.lit(True) if queries[r.kind] is True else F.array_contains(n_kinds, r.kind) for r in rules}
    verified = rows.select(*named(own), F.struct(*[_matches(r, text, asked[r.kind]).alias(f"r{k}") for k, r in enumerate(rules)]).alias(n_found))
    spans = [_spans(F.col(f"{n_found}.r{k}"), k, r) for k, r in enumerate(rules)]
    return verified.select(*named(own), F.array_sort(F.concat(*spans)).alias(out))


def _matches(rule: Rule, text: Column, asked: Column) -> Column:
    """What lies between matches, the matches, and the group that is measured; null where there is no match."""
    regex = F.lit(rule.regex)
    found = [F.split(text, rule.regex, -1).alias("gap"), F.regexp_extract_all(text, regex, 0).alias("all")]
    if rule.group:
        found.append(F.regexp_extract_all(text, regex, rule.group).alias("size"))
    return F.when(asked & F.rlike(text, regex), F.struct(*found))


def _spans(found: Column, k: int, rule: Rule) -> Column:
    empty = F.expr("cast(array() as array<struct<start:bigint,rule:int,kind:string,end:bigint>>)")
    size = found["size"] if rule.group else found["all"]
    length = lambda texts, i: F.char_length(F.get(texts, i)).cast("long")
    # A match ends after all gaps and matches up to it.
    ends = running_sums(F.transform(found["all"], lambda m, i: F.char_length(m).cast("long") + length(found["gap"], i)))
    spans = F.transform(ends, lambda end, i: F.when(length(size, i) >= rule.least, F.struct((end - length(found["all"], i)).alias("start"), F.lit(k).alias("rule"), F.lit(rule.kind).alias("kind"), end.alias("end"))))
    return F.when(found.isNull(), empty).otherwise(F.filter(spans, lambda s: s.isNotNull()))
