"""Secrets in texts, found through an inverted index of trigrams that the rules make mandatory."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.frames import col
from plumbline.llm.common import key_filter, maybe_in, saved

#: Above so many strings a set of possible strings is no longer listed.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches from the left without overlap; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds in their order, then kinds with published token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # the whole run, like [0-9a-f]+ with the shorter runs dropped
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("repository", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
BASE = 3


def _strings(tree) -> set[str] | None:
    """All strings that a parsed pattern can match, if they are few; lower case."""
    found = {""}
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            part = {chr(value).lower()}
        elif name == "IN":
            if any(str(o) not in ("LITERAL", "RANGE") for o, _ in value):
                return None
            part = {chr(c).lower() for o, v in value for c in ([v] if str(o) == "LITERAL" else range(v[0], v[1] + 1))}
        elif name == "SUBPATTERN":
            part = _strings(value[-1])
        elif name == "BRANCH":
            branches = [_strings(b) for b in value[1]]
            part = None if None in branches else set().union(*branches)
        elif name == "MAX_REPEAT" and value[1] <= 3:
            once = _strings(value[2])
            part = once and {"".join(x) for n in range(value[0], value[1] + 1) for x in itertools.product(once, repeat=n)}
        else:
            return None
        if part is None or len(part) * len(found) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in part}
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """A Boolean query that every match satisfies: one of the returned sets of trigrams is in the lower-cased text whole.

    The pattern's parse tree is cut into maximal runs whose strings can be listed; all strings of such a run together
    are one alternative each, and the run with the longest shortest string is taken. No alternatives: nothing is
    mandatory and the rule has to scan everything.
    """
    tree = list(re._parser.parse(pattern))
    best: set[str] = set()
    for start in range(len(tree)):
        for stop in range(start + 1, len(tree) + 1):
            strings = _strings(tree[start:stop])
            if strings is None:
                break
            if min(map(len, strings)) > min(map(len, best), default=2):
                best = strings
    return sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in best}, key=sorted)


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's matches, in code points, end exclusive.

    Every match is taken together with the text since the last one (``\\G`` keeps the search from starting elsewhere);
    the positions are the running sum of these lengths.
    """
    pattern = F.lit(rf"\G([\s\S]*?)({rule.pattern})")
    gaps, found = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    value = F.regexp_extract_all(text, pattern, F.lit(2 + rule.group)) if rule.group else found
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("found"), value.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        end = begin + F.length(part["found"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        none = F.array().cast("array<struct<start:int,end:int>>")
        return F.struct(end.alias("at"), F.concat(state["spans"], F.when(F.length(part["value"]) >= rule.least, one).otherwise(none)).alias("spans"))

    return F.aggregate(parts, start, add, lambda s: s["spans"])


def _of_rule(spans: Column, number: int) -> Column:
    """The spans with the rule's number, in the order in which they sort."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("rule"), s["end"].alias("end")))


def trigram_index(texts: DataFrame, queries: Sequence[list[frozenset[str]]]) -> DataFrame:
    """Postings (trigram, text_key) of the trigrams that the queries ask for, over columns text_key and lowered."""
    asked = sorted({t for query in queries for terms in query for t in terms})
    if not asked:
        return texts.select(F.lit("").alias("trigram"), "text_key").limit(0)
    present = F.filter(F.array(*[F.when(F.contains("lowered", F.lit(t)), F.lit(t)) for t in asked]), lambda t: t.isNotNull())
    return texts.select("text_key", F.explode(present).alias("trigram")).distinct()


def find_secrets(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Find what looks like a password, key or token in every whole text.

    Each rule's pattern gives a Boolean query of trigrams. Texts are posted under the trigrams asked for, copies once;
    the posting lists of a query's alternatives are intersected by counting, which texts hold all of one's trigrams.
    Only these candidates are verified with the pattern itself; a filter of fixed size lets all other texts pass by the join. A rule without mandatory trigrams (a run of hexadecimal
    digits, say) scans all texts. The key of a text is a 64-bit hash; texts that share one share their candidates, which
    verification then tells apart.

    The columns of ``docs`` and ``spans``: array<struct<kind, start, end>> in code points, end exclusive, by
    start and then by the rules' order. A null text has no spans; repeated rows are scanned alike; an empty table gives
    no rows. Columns of other names, nulls in them included, pass through; an input column ``spans`` is replaced.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    text = F.coalesce(col(text_column), F.lit(""))
    keyed = docs.select(F.xxhash64(text).alias("text_key"), F.lower(text).alias("lowered"))
    postings = saved(trigram_index(keyed, queries), "trigram-postings")
    asked = [
        (number, branch, len(terms), term)
        for number, query in enumerate(queries) for branch, terms in enumerate(query) for term in sorted(terms)
    ]
    # as many rows as the rules have trigrams
    terms = docs.sparkSession.createDataFrame(asked, "rule int, branch int, needed int, trigram string")
    held = postings.join(F.broadcast(terms), "trigram").groupBy("text_key", "rule", "branch", "needed").agg(F.count(F.lit(1)).alias("n"))
    candidates = saved(
        held.filter("n = needed").groupBy("text_key").agg(F.collect_set("rule").alias("candidate_rules")), "secret-candidates"
    )
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), F.xxhash64(text).alias("row_key"))
    flagged = rows.withColumn("hit", maybe_in(key_filter(candidates.select(F.col("text_key").alias("key"))), F.col("row_key")))
    met = flagged.filter("hit").join(candidates, F.col("row_key") == F.col("text_key"), "left")
    passed = flagged.filter("not hit").withColumn("candidate_rules", F.lit(None).cast("array<int>"))
    looked = passed.select("row", "candidate_rules").unionByName(met.select("row", "candidate_rules"))
    whole = F.coalesce(F.col("row")[text_column], F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int>>")
    found = []
    for number, (rule, query) in enumerate(zip(rules, queries)):
        spans = spans_of(whole, rule)
        if query:
            candidate = F.coalesce(F.array_contains("candidate_rules", number), F.lit(False))
        else:
            candidate = F.regexp_like(whole, F.lit(rule.pattern))
        found.append(_of_rule(F.when(candidate, spans).otherwise(none), number))
    names = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform(
        F.array_sort(F.concat(*found)),
        lambda s: F.struct(names[s["rule"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return looked.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "spans"], spans.alias("spans"))


def listed(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` of all spans, or of those of the given kinds, comma-joined."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span, or run of spans that overlap, replaced by ``mask``; spans come in order of start."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        ahead = F.concat(state["out"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit(mask))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(span["start"] >= state["at"], ahead).otherwise(state["out"]).alias("out"),
        )

    end = F.aggregate(spans, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, end).otherwise(text)
