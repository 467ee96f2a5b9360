"""Link harvest with many rules, few of whose expressions run on each text.

Rules are rows (rule_no, source, pattern, template, literal): a text that a pattern matches holds its literal. Each rule
is filed under the first characters of its literal; the grams of those lengths that a text holds, met with all filed ones in one
set operation per text, fetch the rules that may match. Only then is the literal looked for and the expression run. Rules
without a literal are tried on every text. Results equal those of every expression on every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import bind
from millrace.operators.skew import salted_join
from millrace.session import settle

LONGEST_GRAM = 6
SHAPE = "rule_no int, source string, pattern string, template string, literal string"


def literal_of(pattern: str) -> str:
    """The longest run of plain characters every match holds: characters at the top level of the expression that no
    quantifier follows. Empty if flags or alternatives stand in the way."""
    if "|" in re.sub(r"\((?:[^()\\]|\\.)*\)|\\.|\[(?:[^\]\\]|\\.)*\]", "", pattern) or "(?i" in pattern:
        return ""
    runs, depth, i, run = [], 0, 0, ""
    while i < len(pattern):
        c = pattern[i]
        step = 2 if c == "\\" else 1
        if c == "[":
            step = re.match(r"\[\^?\]?(?:[^\]\\]|\\.)*\]", pattern[i:]).end()
        char = pattern[i + 1:i + 2] if c == "\\" and not pattern[i + 1:i + 2].isalnum() else c if c not in "\\[](){}.*+?^$" else ""
        depth += (c == "(") - (c == ")")
        quantified = pattern[i + step:i + step + 1] in tuple("*?{")
        if char and not depth and c != ")" and not quantified:
            run += char
            if pattern[i + step:i + step + 1] == "+":
                runs.append(run)
                run = ""
        else:
            runs.append(run)
            run = ""
        if c == "{":
            step = pattern[i:].index("}") + 1
        i += step
    return max([*runs, run], key=len)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (source, pattern, template) as a table, in their order."""
    return spark.createDataFrame([(n, *r, literal_of(r[1])) for n, r in enumerate(rules)], SHAPE)


def _gram(literal: Column) -> Column:
    return F.substring(literal, 1, LONGEST_GRAM)


def _grams(chars: Column, lengths: list[int]) -> Column:
    """All runs of so many characters. Taken from the list of characters: a place in a string is only found by walking
    there from its start, which would make the work grow with the square of a text's length."""
    def runs(n: int) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        return F.transform(places, lambda i: F.concat_ws("", *[F.get(chars, i + k) for k in range(n)]))

    return F.concat(F.array(F.lit("")), *map(runs, lengths))


def candidates(texts: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, text and the rule's columns) of the pairs whose literal is in the text; key is unique in texts (key, text)."""
    filed = settle(rules.withColumn("gram", _gram(F.col("literal"))), "rules")
    shelves = settle(filed.groupBy("gram").agg(F.collect_set(F.struct(*rules.columns)).alias("filed")), "shelves")
    lengths = [r["n"] for r in shelves.select(F.length("gram").alias("n")).distinct().collect() if r["n"]]
    known = shelves.agg(F.collect_set("gram").alias("all")).scalar()  # one small string per filed gram
    held = bind(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)), lambda chars: F.array_intersect(
        _grams(chars, sorted(lengths)), F.col("all")))
    # written once: the join counts its left side before it joins
    asked = settle(texts.select(key, "text", known.alias("all")).select(key, F.explode(held).alias("gram")), "asked")
    met = salted_join(asked, shelves, ["gram"], "inner", [key])
    pairs = met.select(key, F.inline("filed"))
    return pairs.join(texts.select(key, "text"), key).where(F.contains("text", F.col("literal")))


def link_rows(texts: DataFrame, rules: DataFrame, key: str = "message_id") -> DataFrame:
    """(key, pos, source, job_id, url): distinct links by rule and then by position; of rules of one source the first counts."""
    expression = F.concat(F.lit("(?U)"), F.col("pattern"))
    found = candidates(texts, key, rules).select(
        key, "rule_no", "source", "template",
        F.posexplode(F.array_distinct(F.regexp_extract_all("text", expression, F.lit(1)))).alias("place", "job_id"))
    first = found.groupBy(key, "source", "job_id").agg(F.min(F.struct("rule_no", "place", "template")).alias("f"))
    rows = F.array_sort(F.collect_list(F.struct("f.rule_no", "f.place", "source", "job_id",
                                                F.replace(F.col("f.template"), F.lit("{}"), F.col("job_id")).alias("url"))))
    return (first.groupBy(key).agg(rows.alias("links")).select(key, F.posexplode("links").alias("pos", "l"))
            .select(key, "pos", "l.source", "l.job_id", "l.url"))


def unmatched(hrefs: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct values of hrefs (text) that no rule matches."""
    kinds = settle(hrefs.select("text").distinct().withColumn("href", F.col("text")), "hrefs")
    expression = F.concat(F.lit("(?U)"), F.col("pattern"))
    hit = candidates(kinds, "href", rules).where(F.regexp_like("text", expression)).select("href").distinct()
    return kinds.join(hit, "href", "left_anti").select("text")
