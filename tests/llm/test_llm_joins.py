"""N-gram join, substring dedup, decontamination and license scan against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import xxhash

from helpers import SF_DIR, WORD, awkward, docs, empty, lower, plain, prose, table, thue_morse
from millrace.llm import decontaminate, licenses, ngram_join, phrases
from millrace.llm.common import words


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def brute_join(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(sets)))
    links = [0] * len(sets)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            if a is not None and b is not None and x and 100 * len(x & y) >= 90 * len(x | y):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[top(i)] = min(d, low.get(top(i), d))
    return sorted(((d, len(x), None if d is None else low[top(i)], links[i]) for i, (d, x) in enumerate(sets)), key=str)


def mutated(text, n, seed):
    w = text.split(" ")
    rng = random.Random(seed)
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{seed}x{i}"
    return " ".join(w)


def test_words_match_the_rule():
    texts = ["a b c", None, "", " x\ty\r\nz ", "A B c", "é ñ"]
    got = []
    for c in words(pa.array(texts)):
        got += [[c.body[s:e].decode() for s, e in zip(c.start[a:b], c.end[a:b])] for a, b in zip(c.first[:-1], c.first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]


def test_every_similar_pair_shares_a_signature():
    rng = random.Random(5)
    for size in [*range(2, 60), 100, 333, 1000, 2900]:
        for _ in range(4):
            a = {rng.getrandbits(63) for _ in range(size)}
            drop = rng.randint(0, size // 9)
            add = rng.randint(0, size // 9)
            b = set(list(a)[drop:]) | {rng.getrandbits(63) for _ in range(add)}
            x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
            if a != b and 100 * len(a & b) >= 90 * len(a | b):
                assert np.intersect1d(ngram_join.signatures(x, 90, 100), ngram_join.signatures(y, 90, 100)).size


def test_join_equals_brute_force_on_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 2_000)  # several blocks in a cluster
    base = prose(1, 200)
    rows = [(i, mutated(base, i % 7, i)) for i in range(60)] + [(100 + i, prose(i, 90)) for i in range(30)]
    rows += [(200 + i, mutated(prose(2, 90), i % 4, i)) for i in range(20)] + [(300, prose(2, 90)), (301, prose(2, 90))]
    got = plain(ngram_join.join(docs(spark, [(d, t, None, None) for d, t in rows])))
    assert sorted(got, key=str) == brute_join(rows)


def test_join_of_awkward_rows(spark):
    frame = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert sorted(plain(ngram_join.join(frame)), key=str) == brute_join(rows)
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(
        map(str, [1, 3, 4, 5, 6, 7, 9, None, 12, 13]))
    assert not plain(ngram_join.join(empty(spark))) and not plain(ngram_join.keep_one(empty(spark)))


def brute_phrases(rows, size=20):
    first, out = {}, []
    own = [(1 << 62) | (xxhash.xxh64((t or "").encode(), seed=42).intdigest() & (1 << 62) - 1) for _, t in rows]
    order = [(n if d is None else d, WORD.findall(t or "")) for n, (d, t) in zip(own, rows)]
    for d, w in order:
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            first[key] = min(first.get(key, (d, i)), (d, i))
    for (d, _), (at, w) in zip(rows, order):
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < (at, i):
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_phrases_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 150)  # many shards, and some in several tasks
    monkeypatch.setattr(phrases, "SHARD_VISITS", 5)
    monkeypatch.setattr(phrases, "PIECE_WINDOWS", 13)
    shared = [prose(40 + i, n) for i, n in enumerate((20, 21, 35, 90))]
    rng = random.Random(1)
    rows = []
    for i in range(80):
        parts = [prose(i, rng.randint(5, 40)), rng.choice(shared), prose(1000 + i, rng.randint(0, 9) + 1)]
        if i % 5 == 0:
            parts.append(rng.choice(shared))
        if i % 9 == 0:
            parts = parts[:1] * 3
        rows.append((1000 - i, " ".join(parts)))
    rows += [(2000, rows[3][1]), (1, rows[4][1]), (2001, "na " * 50), (2002, "na " * 19), (2003, "na " * 20 + "end")]
    got = plain(phrases.dedup(docs(spark, [(d, t, None, None) for d, t in rows])))
    assert sorted(got, key=str) == brute_phrases(rows)


def test_phrases_of_awkward_rows(spark):
    frame = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert sorted(plain(phrases.dedup(frame)), key=str) == brute_phrases(rows)
    assert not plain(phrases.dedup(empty(spark)))


def test_phrases_query_equals_brute_force(spark):
    from millrace.llm.queries import op6_repeated_phrases
    rows = [tuple(r) for r in table(spark, "documents").select("doc_id", "text").collect()]
    assert sorted(plain(op6_repeated_phrases(spark, SF_DIR)), key=str) == brute_phrases(rows)


def distance(item, text):
    """Smallest edit distance of item to any part of text, by the textbook table."""
    above = list(range(len(item) + 1))
    best = above[-1]
    for c in text:
        row = [0]
        for i, p in enumerate(item, 1):
            row.append(min(row[-1] + 1, above[i] + 1, above[i - 1] + (c != p)))
        above, best = row, min(best, row[-1])
    return best


def test_edit_distance_and_recall():
    rng = random.Random(3)
    for _ in range(60):
        item = "".join(rng.choice("abcd ") for _ in range(rng.randint(40, 110))).strip() + "zz"
        item = decontaminate.plain(item)
        edited = list(item)
        for _ in range(rng.randint(0, len(item) // 20 + 2)):
            i = rng.randrange(len(edited))
            edited[i:i + 1] = rng.choice([[], ["x"], [edited[i], "y"]])
        text = "lead in " + "".join(edited) + " and out"
        got = decontaminate.Finder([(1, item)])(text)
        want = distance(item, decontaminate.plain(text))
        assert [g[2] for g in got] == ([want] if want <= len(item) // 20 else [])
        for _, _, d, a, b in got:
            assert distance(item, decontaminate.plain(text)[a:b]) == d


def test_leaks_of_awkward_rows(spark):
    items = spark.createDataFrame([(1, prose(1, 30)), (2, None), (3, ""), (4, "short"), (5, prose(777)), (1, prose(1, 30)),
                                   (None, prose(3, 25).upper()), (9, " ".join(prose(i) for i in range(9)))],
                                  "item_id long, text string")
    frame = awkward(spark)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, items).collect()}
    assert got == {(1, 1), (2, 1), (3, None), (9, 1), (10, 1), (9, None), (10, None), (9, 9), (10, 9)}
    left = decontaminate.clean(frame, items)
    assert left.columns == frame.columns
    assert sorted(map(str, (r["doc_id"] for r in left.collect()))) == sorted(map(str, [4, 5, 6, 7, 8, None, 12, 13]))
    assert not plain(decontaminate.leaks(empty(spark), items))
    assert decontaminate.clean(frame, items.limit(0)).count() == frame.count()


def test_leaks_query_equals_brute_force(spark, monkeypatch):
    from millrace.llm.queries import op9_benchmark_leaks
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1_500)  # several blocks
    items = [(r["item_id"], decontaminate.plain(r["text"])) for r in table(spark, "benchmark").collect()]
    texts = [(r["doc_id"], decontaminate.plain(r["text"])) for r in table(spark, "documents").collect()]
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in op9_benchmark_leaks(spark, SF_DIR).collect()}
    exact = {(d, i) for d, t in texts for i, x in items if x in t}
    assert exact and {k for k, v in got.items() if v == 0} == exact


def test_license_guarantee():
    low = licenses.SHARE * 0.5 / (2 + (1 - licenses.SHARE) * 0.5)
    assert (1 - low) ** licenses.BANDS < 1e-8


def test_licenses_of_awkward_rows(spark):
    mit = licenses.TEMPLATES["mit"]
    short = licenses.TEMPLATES["mit-line"]
    changed = mit.replace("without restriction", "with no limits at all")
    rows = [(1, prose(1) + "\n" + mit.upper() + prose(2), None, None), (2, short, None, None), (3, None, None, None),
            (4, "", None, None), (5, "MIT License", None, None), (6, prose(9, 5000) + " " + short, None, None),
            (None, short, None, None), (7, changed, None, None), (7, changed, None, None), (8, mit[:60], None, None)]
    texts = licenses.templates(spark)
    got = {(r["doc_id"], r["license_id"]): r for r in licenses.scan(docs(spark, rows), texts).collect()}
    assert set(got) == {(1, "mit"), (2, "mit-line"), (6, "mit-line"), (None, "mit-line"), (7, "mit")}
    assert got[1, "mit"]["containment"] == 1.0 and 0.8 <= got[7, "mit"]["containment"] < 1.0
    assert not plain(licenses.scan(empty(spark), texts))
    none = spark.createDataFrame([("a", None), ("b", "too short")], "license_id string, text string")
    assert not plain(licenses.scan(docs(spark, rows), none))


def test_license_plan_has_no_python(spark):
    frame = licenses.scan(table(spark, "documents"), licenses.templates(spark))
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_kept(rows, width, num, den):
    """The smallest id of each group of rows linked by num/den of their shingles."""
    sets = {}
    for d, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[d] = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and den * len(x & y) >= num * len(x | y):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {top(d) for d in sets}


def test_pipeline_drops_near_copies_of_five_words_and_four_fifths(spark):
    import corpus_pipeline as cp
    rows = [(k * 100 + i, mutated(prose(k, 200), n, i)) for k in range(1, 4) for i, n in enumerate((0, 3, 4, 5, 9, 30))]
    rows += [(900, "four words in all"), (901, "FOUR words in all"), (902, "four words in"), (903, "")]
    want = brute_kept(rows, 5, 80, 100)
    assert want != brute_kept(rows, 3, 90, 100)
    kept = cp.drop_near_copies(spark, docs(spark, [(d, t, None, None) for d, t in rows]), SF_DIR).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(want)


def test_every_pair_of_four_fifths_shares_a_signature():
    rng = random.Random(6)
    for size in [*range(1, 60), 100, 333, 1000, 2900]:
        for _ in range(4):
            a = {rng.getrandbits(63) for _ in range(size)}
            b = set(list(a)[rng.randint(0, size // 5):]) | {rng.getrandbits(63) for _ in range(rng.randint(0, size // 5))}
            x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
            if a != b and 100 * len(a & b) >= 80 * len(a | b):
                assert np.intersect1d(ngram_join.signatures(x, 80, 100), ngram_join.signatures(y, 80, 100)).size


def test_short_notices_are_found(spark):
    import re
    texts = {"one": "Proprietary", "two": "License: MIT", "three": "All rights reserved.", "four": "SPDX-License-Identifier: MIT",
             "five": "Licensed under CC BY-NC 4.0.", "none": "?!"}
    bodies = ["All rights reserved.", prose(1) + "\n© 2024 X. ALL RIGHTS\nRESERVED", "rights reserved, all", "# License: MIT",
              "// SPDX-License-Identifier: MIT\n" + prose(2) + " license: mit", "proprietary " * 3, "a b all rights", "MIT License",
              prose(3) + " All rights reserved. All rights reserved. Proprietary", "", None, "License", "All rights are reserved"]
    want = {}
    for d, body in enumerate(bodies):
        w = re.findall(r"[^\W_]+", (body or "").lower())
        for k, v in texts.items():
            t = re.findall(r"[^\W_]+", v.lower())
            spots = [i for i in range(len(w) - len(t) + 1) if len(t) < 5 and t and w[i:i + len(t)] == t]
            begins = {b for i in spots for b in (i - 1, i) if b >= 0}  # windows of two shingles at every one
            if begins:
                want[d, k] = (1.0, min(begins), len(begins))
    found = licenses.scan(docs(spark, [(i, b, None, None) for i, b in enumerate(bodies)]), licenses.templates(spark, texts))
    assert {(r[0], r[1]): tuple(r)[2:] for r in found.collect()} == want and len(want) == 8
    given = licenses.scan(docs(spark, [(1, "© X. All rights reserved.", None, None)]), licenses.templates(spark)).collect()
    assert [r["license_id"] for r in given] == ["all-rights-reserved"]


def test_repetitive_words_are_told_apart(spark):
    """Words that structured hashes confuse: neither linked, nor taken for copies, nor for a window that was there."""
    a, b = thue_morse()
    rows = [(1, a), (2, b), (3, " ".join([a] * 25)), (4, " ".join([b] * 25)), (5, prose(1, 30) + " " + a), (6, prose(1, 30) + " " + b)]
    frame = docs(spark, [(d, t, None, None) for d, t in rows])
    assert sorted(plain(ngram_join.join(frame)), key=str) == brute_join(rows)
    assert sorted(plain(phrases.dedup(frame)), key=str) == brute_phrases(rows)


def test_keep_one_decides_by_row(spark):
    a, b = prose(1, 80), prose(2, 80)
    near = a + " end"
    rows = [(3, a), (5, a), (5, b), (7, near), (7, b.upper()), (8, "x y"), (8, "z q"), (8, "X Y"), (9, a + " fin"), (9, near),
            (2, prose(3)), (2, prose(4)), (4, prose(3)), (4, prose(4) + " z")]
    frame = docs(spark, [(d, t, None, None) for d, t in rows])
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(frame).collect()]
    assert sorted((d, t.lower()) for d, t in kept) == sorted(
        [(3, a), (5, b), (8, "x y"), (8, "z q"), (2, prose(3)), (2, prose(4))])
    assert sorted(plain(ngram_join.join(frame)), key=str) == brute_join(rows)


def test_copies_and_sets_of_their_own_go_no_further(spark):
    """Most texts have too many shingles to themselves; no pair that is similar is among them."""
    rows = [(i, prose(i, 150)) for i in range(60)] + [(100 + i, mutated(prose(i, 150), 2, i)) for i in range(10)]
    frame = docs(spark, [(d, t, None, None) for d, t in rows])
    _, told = ngram_join.classes(frame, 5, 80, 100)
    groups = told.select("k1", "k2", "doc_id", "copies", ngram_join.F.lit(146).alias("n_shingles"))
    left = {r["doc_id"] for r in ngram_join.shared_enough(frame, groups, 5, 80, 100).collect()}
    assert {*range(10), *range(100, 110)} <= left and len(left) < 40


def test_a_long_repeated_document_is_dealt_to_many_shards(spark, monkeypatch):
    """Its pieces meet in no single automaton, and texts without ids are documents of their own."""
    monkeypatch.setattr(phrases, "SHARD_WORDS", 2_000)
    long_text = " ".join(f"w{i * 7919 % 30_011}" for i in range(30_000))
    rows = [(1, long_text), (2, "a b " + long_text + " c"), (3, long_text[20_000:90_000]), (None, long_text), (None, prose(2, 50)),
            (None, prose(2, 50) + " x")]
    frame = docs(spark, [(d, t, None, None) for d, t in rows])
    got = plain(phrases.dedup(frame))
    assert sorted(got, key=str) == brute_phrases(rows)


def test_word_hashes_tell_words_apart():
    rng = random.Random(9)
    found = {"".join(rng.choice("ab") for _ in range(n)) for n in range(1, 80) for _ in range(60)} | set(thue_morse()) | {
        "a" * n for n in range(1, 200)} | {"ab" * n for n in range(1, 100)} | {"x\0", "x", "x\0\0", "\0"}
    (chunk,) = words(pa.array([" ".join(sorted(found))]))
    assert len(set(chunk.hashes.tolist())) == len(found)
    again = np.concatenate([c.hashes for c in words(pa.array(sorted(found)))])
    assert again.tolist() == chunk.hashes.tolist()  # wherever a word stands


def test_a_shard_gets_shared_words_only(spark, monkeypatch):
    line = " ".join(f"shared{i}" for i in range(30))
    rows = [(d, " ".join(f"w{d}x{i}" for i in range(3000)) + " " + line + " " + " ".join(f"v{d}x{i}" for i in range(3000)))
            for d in (1, 2, 3)] + [(4, f"{line} {line}")]
    sent, located = [], phrases.located

    def spy(streams):
        sent.extend(len(r["text"].split()) for r in streams.where("kind = 1").collect())
        return located(streams)

    monkeypatch.setattr(phrases, "located", spy)
    got = plain(phrases.dedup(docs(spark, [(d, t, None, None) for d, t in rows])))
    assert sorted(got) == brute_phrases(rows)
    assert sorted(sent) == [30, 30, 60]


def test_join_moves_a_set_once_and_only_inside_a_cluster(spark, monkeypatch):
    moved, given = {}, ngram_join.settle

    def seen(frame, name):
        if "values" in frame.columns or "sets" in frame.columns:
            moved[name] = frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        return given(frame, name)

    monkeypatch.setattr(ngram_join, "settle", seen)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 2)  # several blocks in a cluster
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables beyond it are joined
    words = [f"w{k}" for k in range(400)]
    near = [" ".join([*words[:9 * i], f"x{i}", *words[9 * i + 1:]]) for i in range(9)]
    rows = [(i, t) for i, t in enumerate([*near, near[3], prose(1), prose(2), "", None])] + [(4, near[4]), (4, prose(5)), (None, near[0])]
    try:
        got = plain(ngram_join.join(docs(spark, [(d, t, None, None) for d, t in rows])))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert sorted(got, key=str) == brute_join(rows)
    assert sum(moved.values()) == 1
