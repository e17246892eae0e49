"""Rule evaluation: contents in, one finding for each rule that holds and for each defence that is missing.

Both are found in one pass over a content by an automaton of the literals that detectors need (derived from their expressions), in an Arrow-batched UDF, which
runs an expression only where one of its literals occurs; the same expressions as Catalyst predicates take some times as long and have to be compiled
(engine="expressions" has them). All else is Catalyst expressions on the contents' own rows: nothing is shuffled or joined.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules, taxonomy
from ..functions.rulefile import RuleSet, needs
from .batches import small_batches

FINDING = ("entity_id", "seq", "analyzer", "severity", "threat_category", "threat_type", "summary", "content_type")


def ascii_only(c: Column) -> Column:
    """Rules see bytes: what isn't ASCII is neither a letter nor white space to them."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "¤")


def java_regex(regex: str, ignore_case: bool) -> str:
    return ("(?di)" if ignore_case else "(?d)") + regex


def _hit(c: Column, low: Column):
    def hit(detector) -> Column:
        _, _, ignore_case, regex = detector
        match = c.rlike(java_regex(regex, ignore_case))
        guard = None  # a search for a literal costs far less than the expression, which then seldom runs
        for x in sorted(needs(regex) or ()):
            guard = F.contains(low, F.lit(x)) if guard is None else guard | F.contains(low, F.lit(x))
        return match if guard is None else guard & match

    return hit


def _fold(op, none: bool):
    def fold(parts: list[Column]) -> Column:
        out = parts[0] if parts else F.lit(none)
        for p in parts[1:]:
            out = op(out, p)
        return out

    return fold


_any, _all = _fold(lambda a, b: a | b, False), _fold(lambda a, b: a & b, True)
COUNTS = {">=": int.__ge__, ">": int.__gt__, "==": int.__eq__, "<": int.__lt__, "<=": int.__le__, "!=": int.__ne__}


class Matcher:
    """What holds for a text: rules of a set, and defences that it lacks. Expressions run only where one of their literals occurs."""

    def __init__(self, rule_set: RuleSet):
        self.rules = rule_set
        every = [(d.regex, d.ignore_case) for d in rule_set.detectors] + [(x, True) for d in rules.DEFENSES for x in d[3:]]
        self.first_defense = len(rule_set.detectors)
        self.regexes = [re.compile(x, re.ASCII | (re.IGNORECASE if i else 0)) for x, i in every]
        self.always, by = [], {}
        for i, (x, _) in enumerate(every):
            for literal in needs(x) or ():
                by.setdefault(literal, []).append(i)
            if not needs(x):
                self.always.append(i)
        # A rule that holds for a text without any of its strings must be evaluated for each.
        self.empty = [r for r in rule_set.names if self._holds(r, frozenset(), "")]
        self.of = {(d.rule, d.name): i for i, d in enumerate(rule_set.detectors)}
        try:
            import ahocorasick
        except ImportError:  # without the automaton every expression runs
            self.automaton, self.always = None, list(range(len(every)))
            return
        self.automaton = ahocorasick.Automaton()
        for x, at in by.items():
            self.automaton.add_word(x, at)
        self.automaton.make_automaton()

    def _holds(self, rule: str, hits: frozenset, c: str) -> bool:
        def count(d, sign, n) -> bool:
            return COUNTS[sign](sum(1 for _ in self.regexes[self.of[d.rule, d.name]].finditer(c)) if c else 0, n)

        return self.rules.combine(rule, lambda d: (d.rule, d.name) in hits, any, all, lambda x: not x, count)

    def found(self, content: str | None) -> tuple[list[str], list[int]]:
        """Rules that hold, sorted, and numbers of defences that are missing; neither of a blank content."""
        if not content or not content.strip(" "):
            return [], []
        c = content if content.isascii() else re.sub(r"[^\x00-\x7F]", "¤", content)
        some = set(self.always)
        if self.automaton is not None:
            for _, at in self.automaton.iter(c.lower()):
                some.update(at)
        hit = {i for i in some if self.regexes[i].search(c)}
        ds = self.rules.detectors
        names = frozenset((ds[i].rule, ds[i].name) for i in hit if i < self.first_defense)
        held = sorted({r for r in {x for x, _ in names} | set(self.empty) if self._holds(r, names, c)})
        have = {(i - self.first_defense) // 2 for i in hit if i >= self.first_defense}
        return held, [i for i in range(len(rules.DEFENSES)) if i not in have]


def found(contents: DataFrame, rule_set: RuleSet | None = None) -> DataFrame:
    """contents (entity_id, content, ...) with `rules` (see matched_rules) and `missing`, numbers of the defences that a content lacks; null for blank ones.
    A worker holds a batch's contents, so the session's Arrow batches are bounded (see small_batches)."""
    small_batches(contents.sparkSession)
    known = rule_set or rules.DEFAULT
    held: list[Matcher] = []

    def go(s: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(Matcher(known))
        each = {c: held[0].found(c) for c in s.unique()}  # a batch's copies are looked at once
        return pd.DataFrame({"rules": [each[c][0] for c in s], "missing": [each[c][1] if c and c.strip(" ") else None for c in s]})

    udf = F.pandas_udf(go, T.StructType([T.StructField("rules", T.ArrayType(T.StringType())), T.StructField("missing", T.ArrayType(T.IntegerType()))]))
    return contents.withColumn("_f", udf("content")).select(*contents.columns, "_f.rules", "_f.missing")


def matched_rules(contents: DataFrame, engine: str = "automaton", rule_set: RuleSet | None = None) -> DataFrame:
    """contents (entity_id, content, ...) with `rules`, the sorted names of the rules that hold. Null and blank contents have none."""
    if engine == "automaton":
        return found(contents, rule_set).drop("missing")
    known = rule_set or rules.DEFAULT
    base = contents.withColumn("_c", ascii_only(F.col("content"))).withColumn("_l", F.lower("_c"))
    hit = _hit(F.col("_c"), F.col("_l"))
    held = [F.when(known.combine(r, hit, _any, _all, lambda x: ~x), F.lit(r)) for r in known.names]
    return base.withColumn("rules", F.when(F.length(F.trim("content")) > 0, F.array_compact(F.array(*held))).otherwise(F.array().cast("array<string>"))).drop("_c", "_l")


def _by_rule(value: dict[str, str], c: Column) -> Column:
    out = F.lit("UNKNOWN")
    for k, v in value.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def rule_rows(rule_set: RuleSet | None = None, content_type: str = "description") -> Column:
    """The findings of a row with `rules`, as an array of structs: one for each rule, all with the content's summary. Threats that the taxonomy doesn't know are
    UNKNOWN."""
    known = rule_set or rules.DEFAULT
    of = {r: taxonomy.THREAT.get(("yara", t), (None, t, "UNKNOWN", "UNKNOWN")) for r, t in known.threats.items()}
    n = F.size("rules")
    names = F.array_join(F.transform("rules", lambda r: F.translate(r, "_", " ")), ", ")
    summary = F.concat(F.lit("Detected "), n.cast("string"), F.when(n == 1, " threat: ").otherwise(" threats: "), names)
    return F.transform("rules", lambda r, i: F.struct(
        i.cast("int").alias("seq"), F.lit("YARA").alias("analyzer"), _by_rule({k: t[3] for k, t in of.items()}, r).alias("severity"), _by_rule({k: t[2] for k, t in of.items()}, r).alias("threat_category"),
        _by_rule(known.threats, r).alias("threat_type"), summary.alias("summary"), F.lit(content_type).alias("content_type"), r.alias("rule"),
    ))


def _missing(name: str) -> str:
    return f"No {name.replace('_', ' ').lower()} defense found."


ALL_PRESENT = "All prompt defenses present."


def defense_rows(first: int = 0) -> Column:
    """The findings of a row with `missing`, like rule_rows, numbered from `first` on; one INFO where none is missing, and none of blank contents."""
    def row(seq, severity, category, name, summary) -> Column:
        return F.struct(seq.cast("int").alias("seq"), F.lit("PROMPTDEFENSE").alias("analyzer"), severity.alias("severity"), category.alias("threat_category"), name.alias("threat_type"), summary.alias("summary"), F.lit("description").alias("content_type"), F.lit(None).cast("string").alias("rule"))

    column = lambda k: F.array(*[F.lit(_missing(d[0]) if k < 0 else d[k]) for d in rules.DEFENSES])
    of = lambda k, i: F.element_at(column(k), i + 1)
    none = F.array(row(F.lit(first), F.lit("INFO"), F.lit("NONE"), F.lit("ALL_DEFENSES_PRESENT"), F.lit(ALL_PRESENT)))
    some = F.transform("missing", lambda i: row(i + first, of(1, i), of(2, i), of(0, i), of(-1, i)))
    return F.when(F.col("missing").isNull(), F.slice(none, 1, 0)).when(F.size("missing") == 0, none).otherwise(some)


def _exploded(df: DataFrame, rows: Column, also: tuple[str, ...]) -> DataFrame:
    """A row for each of `rows`. A plain explode would have a filter of its own pushed below the UDF, which would then run twice, in two workers a task."""
    return df.select("entity_id", *also, F.explode_outer(rows).alias("f")).filter("f is not null").select("entity_id", *also, "f.*")


def rule_findings(contents: DataFrame, content_type: str = "description", rule_set: RuleSet | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """FINDING rows and the rule: one for each rule that holds for a content, with the contents' columns `also`."""
    return _exploded(found(contents, rule_set), rule_rows(rule_set, content_type), also)


def defense_findings(contents: DataFrame) -> DataFrame:
    """FINDING rows of defences that a content lacks; one INFO row where it lacks none. Blank contents are refused, so they give no row."""
    return _exploded(found(contents), defense_rows(), ()).select(*FINDING)


def finding_rows(contents: DataFrame, rule_set: RuleSet | None = None) -> DataFrame:
    """contents with `findings`: all findings of a content in one array, rules' first and defences from 100 on."""
    return found(contents, rule_set).withColumn("findings", F.concat(rule_rows(rule_set), defense_rows(100)))


def findings(contents: DataFrame, rule_set: RuleSet | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """FINDING rows of both analyzers from one pass."""
    return _exploded(finding_rows(contents, rule_set), F.col("findings"), also).select(*FINDING, *also)


def apply_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """findings with `dropped` and the judge's reason. verdicts (entity_id, ord, idx string, reason): an index that isn't a whole number of the entity's
    findings, counted from 0, is ignored; of several for one finding the last speaks."""
    valid = verdicts.filter(F.col("idx").rlike("^(0|[1-9][0-9]{0,8})$")).select("entity_id", F.col("idx").cast("int").alias("seq"), "ord", "reason")
    last = valid.groupBy("entity_id", "seq").agg(F.max_by("reason", "ord").alias("meta_reason"), F.lit(True).alias("_v"))
    return findings.join(last, ["entity_id", "seq"], "left").withColumn("dropped", F.coalesce("_v", F.lit(False))).drop("_v")
