"""Secret scan with a trigram inverted index; only SQL functions run on the executors.

Each rule is a regular expression.  From its syntax tree a Boolean query over
trigrams is derived on the driver: an AND of ORs of ANDs, of text that every match
has to hold.  The postings (trigram, document) are built for the trigrams that some
query names, intersected by document, and evaluated; the documents that remain for
a rule are verified with the regular expression itself.  A rule without mandatory
trigrams is run over every document.

The index knows a document by the hash of its text, since the verdict depends on
nothing else: ids may be missing or repeated, copies are indexed alike, and two texts
that shared a hash would only be verified in vain.  Candidates are broadcast after a
count, so that no text is shuffled.

Trigrams are taken from the lower-cased text, so a case-insensitive rule and a
case-sensitive one use the same postings; folding can only add candidates.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import body, documents, let, quoted, unused, written

try:  # the standard library's own parser of its patterns
    from re import _parser as sre_parse
except ImportError:  # Python before 3.11
    import sre_parse  # type: ignore


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: The group whose length is tested, and the least length.
    group: int = 0
    least: int = 0
    base: bool = False
    #: The pattern whose matches are masked, where it is not `regex`.
    hide: str = ""


_HEADER = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
#: The rest of a key: all text up to the footer, unless another line of dashes comes first ...
_TO_FOOTER = r"(?:(?!-----)[\s\S])*?-----END [A-Z ]{0,40}PRIVATE KEY-----"
#: ... or without a footer the known header fields and the base64 run.  White space, quotes and marks of
#: quoted or escaped lines belong to the run if 16 characters of base64 follow, or the short last line.
#: All of them repeat one character at a time, which Java does without recursion; a repeated alternation
#: would need a frame of the stack for each turn.
_BREAKS = r"(?:(?=\s|\\[nr]|(?<=\\)[nr])[\s\\nr])*"
_FIELDS = rf"(?:{_BREAKS}(?:Proc-Type|DEK-Info):[^\r\n\\]*){{0,4}}"
_RUN = r"""(?:(?=[A-Za-z0-9+/=]|[\s\\"'>#*|,]{1,16}(?:[A-Za-z0-9+/]{16}|[A-Za-z0-9+/]{1,15}(?:=|\s*[\r\n]|\\[nr]|["']|\s*\Z)))[A-Za-z0-9+/=\s\\"'>#*|,])*"""

_NAMED = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]"""

#: The base rules come first, in the order in which kinds are listed.  A run of one
#: character class with a least length is the same as the run with that length tested.
#: Of assignments those of a short value consume text but are no secrets; what is hidden
#: starts at the first long value.
RULES = (
    Rule("assign", _NAMED + "+)", 2, 12, True, _NAMED + "{12,})"),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("private_key", f"{_HEADER}(?:{_TO_FOOTER}|{_FIELDS}{_RUN})"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)

#: A set of alternatives larger than this is treated as unknown text.
MOST_STRINGS = 64


def trigram_query(regex: str) -> list[set[frozenset[str]]]:
    """The Boolean trigram query of a pattern: all clauses must hold, and of a clause
    one set of trigrams must be contained.  No clause: every document is a candidate."""
    clauses: list[set[frozenset[str]]] = []

    def tri(s: str) -> frozenset[str]:
        return frozenset(s[i : i + 3] for i in range(len(s) - 2))

    def close(run: set[str]) -> None:
        options = {tri(s.lower()) for s in run}
        if options and all(options):
            clauses.append(options)

    def exact(tokens) -> set[str] | None:
        """All strings that the tokens match, or None if there are too many."""
        out = {""}
        for op, arg in tokens:
            name = str(op)
            if name == "LITERAL":
                part = {chr(arg)}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                part = {chr(a) for _, a in arg}
            elif name == "SUBPATTERN":
                part = exact(arg[3])
            elif name == "BRANCH":
                parts = [exact(x) for x in arg[1]]
                part = None if any(p is None for p in parts) else set().union(*parts)
            elif name == "MAX_REPEAT" and arg[1] <= 2 and (inner := exact(arg[2])) is not None:
                part = {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(inner, repeat=n)}
            else:
                part = None
            if part is None:
                return None
            out = {a + b for a in out for b in part}
            if len(out) > MOST_STRINGS:
                return None
        return out

    def walk(tokens) -> None:
        run = {""}
        for token in tokens:
            part = exact([token])
            if part is not None and len(run) * len(part) <= MOST_STRINGS:
                run = {a + b for a in run for b in part}
                continue
            close(run)
            run = {""}
            if str(token[0]) == "SUBPATTERN":
                walk(token[1][3])
            elif str(token[0]) == "MAX_REPEAT" and token[1][0] >= 1:
                walk(token[1][2])
        close(run)

    walk(list(sre_parse.parse(regex)))
    return clauses


#: Candidates (a hash and a number each) that may be broadcast: about 40 MB.
BROADCAST_CANDIDATES = 500_000
#: Numbers whose running sum is taken at once; longer arrays are cut into blocks of that size.
SUMMED = 128


def _key(text_col: str) -> Column:
    return F.xxhash64(body(text_col))


def postings(docs: DataFrame, trigrams: list[str], text_col: str = "text") -> DataFrame:
    """(trigram, doc): the inverted index for the given trigrams; doc is the hash of a text."""
    lower = docs.select(_key(text_col).alias("doc"), F.lower(body(text_col)).alias("lower"))
    held = F.array_compact(F.array(*[F.when(F.contains("lower", F.lit(t)), F.lit(t)) for t in trigrams]))
    return lower.select(F.explode(held).alias("trigram"), "doc")


def candidates(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text") -> DataFrame:
    """(doc, rules): the rules, by the bits of a number, whose trigram query a text meets."""
    wanted = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.regex))}
    names = sorted({t for q in wanted.values() for clause in q for option in clause for t in option})
    if not names:
        return docs.select(_key(text_col).alias("doc"), F.lit(0).cast("bigint").alias("rules")).where("false")
    place = {t: (i // 62, i % 62) for i, t in enumerate(names)}
    masks = F.array(*[
        F.struct(F.lit(t).alias("trigram"), F.lit(place[t][0]).alias("word"), F.lit(1 << place[t][1]).cast("bigint").alias("bit")) for t in names
    ])
    index = postings(docs, names, text_col)
    table = docs.sparkSession.range(1).select(F.explode(masks).alias("m")).select("m.*")  # one row for each trigram of the rules
    words = max(w for w, _ in place.values()) + 1
    found = index.join(F.broadcast(table), "trigram").groupBy("doc").agg(*[
        F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0).cast("bigint")).alias(f"m{w}") for w in range(words)
    ])

    def all_of(option: frozenset[str]) -> Column:
        test = F.lit(True)
        for w in range(words):
            if need := sum(1 << place[t][1] for t in option if place[t][0] == w):
                mask = F.lit(need).cast("bigint")
                test = test & (F.col(f"m{w}").bitwiseAND(mask) == mask)
        return test

    def met(query) -> Column:
        out = F.lit(True)
        for clause in query:
            one = F.lit(False)
            for option in sorted(clause, key=sorted):
                one = one | all_of(option)
            out = out & one
        return out

    bits = F.lit(0).cast("bigint")
    for k, q in wanted.items():
        bits = bits + F.when(met(q), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return found.select("doc", bits.alias("rules")).where("rules <> 0")


def with_rules(docs: DataFrame, rules: tuple[Rule, ...], text_col: str) -> tuple[DataFrame, list[Column]]:
    """docs, all columns, with what the index says of each text; and whether a text is to be verified, for each rule."""
    doc, bits = unused(docs, "__secret_doc", "__secret_rules")
    cand = written(candidates(docs, rules, text_col).select(F.col("doc").alias(doc), F.col("rules").alias(bits)))
    few = cand.count() <= BROADCAST_CANDIDATES
    told = docs.join(F.broadcast(cand) if few else cand, _key(text_col) == F.col(doc), "left")
    named = F.coalesce(bits, F.lit(0).cast("bigint"))
    return told, [(named.bitwiseAND(F.lit(1 << k).cast("bigint")) != 0) if trigram_query(r.regex) else F.lit(True) for k, r in enumerate(rules)]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def running_sums(numbers: Column) -> Column:
    """The running sums of a non-empty array of int: within blocks, to which the sums of the blocks before are added."""
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / SUMMED).cast("int")), lambda b: F.slice(a, b * SUMMED + 1, SUMMED))
    within = lambda x, base: F.transform(x, lambda _, j: base + _total(F.slice(x, F.lit(1), j + 1)))
    joined = lambda blocks, totals: F.flatten(F.transform(blocks, lambda x, i: let(_total(F.slice(totals, F.lit(1), i)), lambda base: within(x, base))))
    return let(let(numbers, cut), lambda blocks: let(F.transform(blocks, _total), lambda totals: joined(blocks, totals)))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Structs (start, k, end, kind) of a rule's matches, in code points, end exclusive.

    The text between matches comes from a split by the same pattern, so ends are running
    sums of lengths.  The pattern runs once for a text without a match, and four times for
    one with matches, however many.
    """
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(group)), F.length)
    between = F.transform(F.split(text, rule.regex, -1), F.length)
    parts = F.arrays_zip(F.slice(between, F.lit(1), F.size(between) - 1).alias("gap"), lengths(0).alias("size"), lengths(rule.group).alias("tested"))

    def placed(parts: Column) -> Column:
        ends = running_sums(F.transform(parts, lambda m: m["gap"] + m["size"]))
        rows = F.transform(F.arrays_zip(parts.alias("m"), ends.alias("end")), lambda r: F.struct(
            (r["end"] - r["m"]["size"]).alias("start"), F.lit(order).alias("k"), r["end"].alias("end"), F.lit(rule.kind).alias("kind"), r["m"]["tested"].alias("tested"),
        ))
        kept = F.filter(rows, lambda r: r["tested"] >= rule.least)
        return F.transform(kept, lambda r: F.struct(r["start"].alias("start"), r["k"].alias("k"), r["end"].alias("end"), r["kind"].alias("kind")))

    none = F.array().cast("array<struct<start:int,k:int,end:int,kind:string>>")
    return F.when(text.rlike(rule.regex), let(parts, placed)).otherwise(none)


def find_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "found") -> DataFrame:
    """docs, all columns, with `out`: an array of (start, k, end, kind) by start and rule.

    Null and empty texts have no spans.  Spans of one kind do not overlap, those of
    different kinds may.  Every row is scanned on its own text, whatever its id.  A column
    of docs that is named `out` gives way, all others pass through.
    """
    told, asked = with_rules(docs, rules, text_col)
    text = body(text_col)
    none = F.array().cast("array<struct<start:int,k:int,end:int,kind:string>>")
    parts = [F.when(ask, spans(text, rule, k)).otherwise(none) for k, (rule, ask) in enumerate(zip(rules, asked, strict=True))]
    return told.select(*[quoted(c) for c in docs.columns if c != out], F.array_sort(F.concat(*parts)).alias(out))


def joined_spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_secret_scan(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find_secrets(docs).select("doc_id", "found")
    base = [r.kind for r in RULES if r.base]
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(joined_spans(F.filter("found", lambda s: s["k"] < len(base))), 256).alias("base_sha256"),
        joined_spans(F.col("found")).alias("spans"),
    )


def masked(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret replaced by [kind]; the longest rules first, keys before all others.

    Each rule is one replacement in what the rules before it have left, so the time is
    linear in the text.  Texts without a secret are unchanged, nulls stay null.  All other
    columns pass through as they are, whatever their names.
    """
    told, asked = with_rules(docs, rules, text_col)

    def hidden(rule: Rule, ask: Column) -> Callable[[Column], Column]:
        return lambda t: F.when(ask, F.regexp_replace(t, rule.hide or rule.regex, f"[{rule.kind}]")).otherwise(t)

    clean = F.col(text_col)
    for rule, ask in sorted(zip(rules, asked, strict=True), key=lambda x: x[0].kind != "private_key"):
        clean = let(clean, hidden(rule, ask))
    return told.select(*[clean.alias(c) if c == text_col else quoted(c) for c in docs.columns])
