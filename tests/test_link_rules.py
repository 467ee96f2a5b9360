"""Many link rules against every expression on every text."""

import random
import re

from millrace import fixed_values as fv
from millrace.operators import extract, link_rules


def test_literals_are_in_every_match():
    for pattern, want in [(r"jk(?:=|%3D)([0-9a-f]{10,20})", "jk"), (r"linkedin\.com/(?:comm/)?jobs/view/(\d{6,12})", "linkedin.com/"),
                          (r"a|b", ""), (r"(?i)abc", ""), (r"abc?d", "ab"), (r"x+yz(\d)", "yz"), (r"[a-z]foo\.bar", "foo.bar"),
                          (r"ab{2,3}cd", "cd"), (r"\d\w", ""), (r"q(a|b)rst", "rst"), (r"ab+c", "ab")]:
        assert link_rules.literal_of(pattern) == want, pattern


def rules_and_texts(n=1000):
    rng = random.Random(3)
    rules = [*fv.LINK_RULES, ("any", r"(\d{9})", "https://any.example/{}")]
    rules += [(f"board{i // 2}", rf"board{i}\.example\.com/(?:jobs|careers)/(\d+)", f"https://b{i}.example/{{}}") for i in range(n)]
    texts = []
    for i in range(80):
        parts = [f"https://board{rng.randrange(n + 50)}.example.com/jobs/{rng.randrange(99)}" for _ in range(rng.randrange(6))]
        parts += ["https://x.example/?jk=abcdef0123456", "gh_jid=12345", "123456789 "][:rng.randrange(4)]
        texts.append((i, " and ".join(parts)))
    return rules, [*texts, (900, ""), (901, "no links at all")]


def test_few_expressions_run_and_all_links_are_found(spark):
    rules, texts = rules_and_texts()
    table, frame = link_rules.rule_table(spark, rules), spark.createDataFrame(texts, "message_id long, text string")
    want = []
    for i, text in texts:
        seen, links = set(), []
        for source, pattern, template in rules:
            for job in re.findall(pattern, text):
                if (source, job) not in seen:
                    seen.add((source, job))
                    links.append((source, job, template.format(job)))
        want += [(i, n, *link) for n, link in enumerate(links)]
    got = sorted(map(tuple, link_rules.link_rows(frame, table).collect()))
    assert got == sorted(want) and len(want) > 150
    assert link_rules.candidates(frame, "message_id", table).count() < len(texts) * len(rules) / 100
    few = link_rules.rule_table(spark, fv.LINK_RULES)
    assert sorted(map(tuple, link_rules.link_rows(frame, few).collect())) == sorted(map(tuple, extract.link_rows(frame).collect()))
    hrefs = spark.createDataFrame([(h,) for _, t in texts for h in t.split(" and ")] * 2, "text string")
    left = sorted(r["text"] for r in link_rules.unmatched(hrefs, table).collect())
    assert left == sorted({h for _, t in texts for h in t.split(" and ") if not any(re.search(p, h) for _, p, _ in rules)})
    assert link_rules.link_rows(frame.limit(0), table).count() == 0 and link_rules.link_rows(frame, table.limit(0)).count() == 0


def test_work_grows_with_the_length_of_a_text_and_no_faster(spark):
    from time import perf_counter
    table = link_rules.rule_table(spark, [("a", r"site\.example/(\d+)", "https://a/{}"), ("b", r"😀é/(\d+)", "https://b/{}")])
    text = "é😀 " * 150_000 + "site.example/7 😀é/8"
    frame = spark.createDataFrame([(1, text), (2, "sit"), (3, None), (4, "😀é/9")], "message_id long, text string")
    start = perf_counter()
    got = sorted((r["message_id"], r["url"]) for r in link_rules.link_rows(frame, table).collect())
    assert got == [(1, "https://a/7"), (1, "https://b/8"), (4, "https://b/9")]
    assert perf_counter() - start < 60
