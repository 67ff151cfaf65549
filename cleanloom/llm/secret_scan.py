"""Secrets in texts: rules with a trigram index in front."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.common import small_or_shuffled
from cleanloom.session import cut

Clauses = frozenset[frozenset[str]]
#: Alternatives a rule's trigram query may have; a query that grows beyond asks for less, never for more.
MOST_CLAUSES = 64
ANY: Clauses = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    """``head`` and ``value`` are patterns; a match counts if the value has ``least`` characters or more."""

    kind: str
    head: str
    value: str
    least: int
    base: bool = False

    @property
    def pattern(self) -> str:
        return f"({self.head})({self.value})"


def either_case(*words: str) -> str:
    """The words, A-Z in either case, as alternatives."""
    return "(?:" + "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in words) + ")"


RULES = (
    Rule("assign", either_case("password", "passwd", "secret", "token", "api_?key") + r"""["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 12, True),
    Rule("access", "", "AKIA[A-Z0-9]{14,}", 18, True),
    Rule("hex", "", "[0-9a-f]{16,}", 16, True),
    Rule("private_key", "", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 1),
    Rule("forge_token", "", "gh[pousr]_[A-Za-z0-9]{36,}", 1),
    Rule("chat_token", "", "xox[abpr]-[0-9A-Za-z-]{10,}", 1),
    Rule("web_token", "", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1),
)


def both(a: Clauses, b: Clauses) -> Clauses:
    out = frozenset(x | y for x in a for y in b)
    return simplest(out) if len(out) <= MOST_CLAUSES else simplest(a if ANY != a else b)


def simplest(clauses: Clauses) -> Clauses:
    """Without alternatives that ask for more than another."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def trigrams_of(strings: frozenset[str]) -> Clauses:
    return simplest(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def trigram_query(pattern: str) -> Clauses:
    """What every match of the pattern must hold, as alternatives of trigrams that stand together, in lower case.

    Literals and small classes give sets of exact strings, which grow along a sequence; where one ends (a large
    class, an open repeat) its trigrams are asked for. An empty alternative means that nothing is mandatory.
    """
    parser = re._parser  # the standard library's own reading of a pattern

    def exact(op, value) -> frozenset[str] | None:
        name = str(op)
        if name == "LITERAL":
            return frozenset([chr(value).lower()])
        if name == "IN":
            chars = set()
            for o, v in value:
                if str(o) == "LITERAL":
                    chars.add(chr(v).lower())
                elif str(o) == "RANGE" and v[1] - v[0] < 8:
                    chars.update(chr(c).lower() for c in range(v[0], v[1] + 1))
                else:
                    return None
            return frozenset(chars) if len(chars) <= 8 else None
        if name == "SUBPATTERN":
            return sequence(value[3])
        if name == "BRANCH":
            parts = [sequence(p) for p in value[1]]
            return None if None in parts else frozenset().union(*parts)
        if name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] == 0 and value[1] == 1:
            inner = sequence(value[2])
            return None if inner is None else inner | {""}
        return None

    def sequence(items) -> frozenset[str] | None:
        out = frozenset([""])
        for op, value in items:
            part = exact(op, value)
            if part is None or len(out) * len(part) > MOST_CLAUSES:
                return None
            out = frozenset(a + b for a in out for b in part)
        return out

    def needs(items) -> Clauses:
        asked, run = ANY, frozenset([""])
        for op, value in items:
            part = exact(op, value)
            if part is not None and len(run) * len(part) <= MOST_CLAUSES:
                run = frozenset(a + b for a in run for b in part)
                continue
            asked, run = both(asked, trigrams_of(run)), frozenset([""])
            name = str(op)
            if name == "SUBPATTERN":
                asked = both(asked, needs(value[3]))
            elif name == "BRANCH":
                either = frozenset().union(*[needs(p) for p in value[1]])
                asked = both(asked, simplest(either) if len(either) <= MOST_CLAUSES else ANY)
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                asked = both(asked, needs(value[2]))
        return both(asked, trigrams_of(run))

    return needs(parser.parse(pattern))


def postings(docs: DataFrame, trigrams: list[str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The index of the rules' trigrams: trigram, doc_id for every document that holds it in either case."""
    low = F.lower(F.col(text_column).cast("string"))
    there = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("_low"), t))
    return docs.select(F.col(id_column).alias("doc_id"), low.alias("_low")).select("doc_id", F.explode(there).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, set[str]]:
    """Documents and the rules (kinds) that may match them: doc_id, kinds; and the kinds that must scan all texts.

    The postings of an alternative's trigrams are intersected by counting them for each document.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    scan = {k for k, q in queries.items() if ANY == q or frozenset() in q}
    wanted = [(k, n, t, len(clause)) for k, q in queries.items() if k not in scan for n, clause in enumerate(sorted(map(sorted, q))) for t in clause]
    spark = docs.sparkSession
    asked = spark.createDataFrame(wanted, "kind string, clause int, trigram string, needed int")  # a few rows for each rule
    index = postings(docs, sorted({t for _, _, t, _ in wanted}) or ["\x00\x00\x00"], id_column, text_column)
    met = index.distinct().join(F.broadcast(asked), "trigram").groupBy("doc_id", "kind", "clause").agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed"))
    return met.where("n = needed").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")), scan


def spans_of(text: Column, rule: Rule) -> Column:
    """Matches of a rule, leftmost first and not overlapping: array of (start, end), in code points.

    Matches are marked in the text and the text cut at the marks, so starts follow from lengths.
    """
    marked = F.regexp_replace(text, F.lit(rule.pattern), F.lit("\x01$1\x02$2\x03"))
    pieces = F.split(marked, "\x01", -1)
    none = F.array().cast("array<struct<start:int,end:int,long:boolean>>")
    start = F.struct(F.char_length(F.get(pieces, 0)).alias("at"), none.alias("found"))

    def step(state: Column, piece: Column) -> Column:
        second, third = F.instr(piece, "\x02"), F.instr(piece, "\x03")
        found = F.struct(
            state["at"].alias("start"), (state["at"] + third - 2).alias("end"), (third - second - 1 >= rule.least).alias("long")
        )
        return F.struct((state["at"] + F.char_length(piece) - 2).alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

    found = F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, step)["found"]
    return F.when(text.rlike(rule.pattern), F.filter(found, lambda x: x["long"])).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Secrets of every document: doc_id and found, an array of (start, order, end, kind) sorted by these.

    Only candidates of the index are verified, but for rules without mandatory trigrams. Null texts hold none; null and
    repeated ids are looked up by their id, so each of their rows is verified for what any of them may hold.
    """
    may, everywhere = candidates(docs, rules, id_column, text_column)
    may = cut(may).select(F.col("doc_id").alias("_may"), F.col("kinds").alias("_kinds"))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("_raw"))
    rows = rows.join(small_or_shuffled(may), F.col("doc_id").eqNullSafe(F.col("_may")), "left")
    marks = "\x01\x02\x03"
    rows = rows.select("doc_id", "_kinds", F.when(F.col("_raw").rlike("[\x01-\x03]"), F.translate("_raw", marks, "\x04\x04\x04")).otherwise(F.col("_raw")).alias("_text"))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")

    def listed(n: int, rule: Rule) -> Column:
        entry = lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("order"), s["end"].alias("end"), F.lit(rule.kind).alias("kind"))
        spans = F.transform(spans_of(F.col("_text"), rule), entry)
        return spans if rule.kind in everywhere else F.when(F.array_contains("_kinds", rule.kind), spans).otherwise(none)

    found = [listed(n, rule) for n, rule in enumerate(rules)]
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
