"""Language ID, quality, HTML, mixing, token files, top-k and the pipeline."""

import array
import itertools
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from test_llm_joins import brute_kept
from helpers import SF_DIR, WORD, awkward, docs, empty, plain, table, thue_morse
from millrace.llm import html_main, language, mixing, ngram_join, quality, token_files, topk
from millrace.llm.queries import op2_html_main_text, op3_quality_rules, op7_exact_top_k, op10_language_id, tokenizer_file
from millrace.session import settle

SF01 = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    told = op10_language_id(spark, SF01).join(table(spark, "documents").sparkSession.read.parquet(
        f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in told) / len(told) > 0.95
    assert sum(r["accepted"] for r in told) / len(told) > 0.95
    assert all(0 <= r["score"] <= 1 for r in told)


def test_language_of_awkward_rows(spark):
    frame = awkward(spark)
    contents = language.dictionaries(table(spark, "documents"))
    told = language.classify(frame, contents)
    assert sorted(told.columns) == sorted({*frame.columns, "lang_pred", "score", "accepted"})
    rows = told.collect()
    assert len(rows) == frame.count()
    for r in rows:
        none = r["text"] is None or not any(map(str.isalpha, r["text"]))
        assert (r["lang_pred"] == "und") == none
        assert not (none and (r["accepted"] or r["score"]))
    assert not plain(language.classify(empty(spark), contents))
    assert {r["lang_pred"] for r in language.classify(frame, language.dictionaries(empty(spark))).collect()} == {"und"}


def test_dictionaries_skip_the_held_out_fold(spark):
    frame = docs(spark, [(i, f"word{i} text", "en", None) for i in range(60)])
    body = language.dictionaries(frame)["en"].decode()
    for i in range(60):
        assert (f"word{i} " in body) == (zlib.crc32(str(i).encode()) % 4 != 2)


def test_quality_held_out(spark):
    told = op3_quality_rules(spark, SF01).where("held_out").join(
        spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in told) / len(told) > 0.95


def test_quality_of_awkward_rows(spark):
    frame = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 14)] + [(1, 0), (7, None), (None, 1)],
                                   "doc_id long, quality int")
    told = quality.scores(frame, labels).collect()
    assert len(told) == frame.count() and all(0 <= r["score"] <= 1 for r in told)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in told)
    assert {r["score"] for r in quality.scores(frame, labels.limit(0)).collect()} == {0.5}
    assert not plain(quality.scores(empty(spark), labels))


def test_tree_rules():
    tree = ("DecisionTreeClassificationModel: depth=2\n  If (feature 0 <= 1.5)\n   If (feature 0 <= 0.5)\n    Predict: 0.0\n"
            "   Else (feature 0 > 0.5)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n")
    name = quality.FEATURES[0]
    assert quality.tree_rules(tree) == {((name, True, 1.5),), ((name, True, 0.5),),
                                        ((name, False, 0.5), (name, True, 1.5)), ((name, False, 1.5),)}


def brute_marginals(model, tree):
    nodes = tree.nodes
    own = [model._evidence(n) for n in nodes]
    own[0] = [1.0, 1e-6, 1e-6]
    out = np.zeros((len(nodes), 3))
    for states in itertools.product(range(3), repeat=len(nodes)):
        p = own[0][states[0]]
        for n in range(1, len(nodes)):
            pair = model.pair[nodes[n].tag in html_main.PLAIN]
            p *= own[n][states[n]] * pair[states[nodes[n].up]][states[n]]
        for n, s in enumerate(states):
            out[n][s] += p
    return out / out.sum(1, keepdims=True)


def test_messages_equal_enumeration(spark):
    model = html_main.fit(table(spark, "pages"))
    for page in ("<div class=post><p>One two.</p><div class=ad>Buy</div></div>",
                 "<article><h1>T</h1><ul><li>a<li>b</ul></article><nav><a href=/>x</a></nav>"):
        tree = html_main.Tree(page)
        assert np.allclose(model.marginals(tree), brute_marginals(model, tree), atol=1e-9)


PAGES = [
    (None, ""), ("", ""), ("no markup", ""), ("<html><head><title>x</title></head></html>", ""),
    ("<body><nav><a href=/>Home</a></nav><article><h1>A &amp; B&nbsp;C</h1><p>One\n  two<p>th<b>re</b>e&#33; &am",
     "A & B C One two three! &am"),
    ("<article><p>Body.</p><script>var x='<p>no</p>'</script><style>p{}</style><!-- no --><p>End.</p></article>"
     "<footer>&copy; site</footer>", "Body. End."),
    ("<body><div class='cookie notice'><p>We use cookies.</p></div><article><p>Text of it.</p><p>More text.</p>"
     "<section class=comments><p>A reader has a lot to say about it here.</p></section></article>"
     "<aside>" + "<p>Side matter, a paragraph of it.</p>" * 6 + "</aside></body>", "Text of it. More text."),
    ("<html><body><div class=header><p>Site</p></div><div class=content><h1>T</h1><p>Words of the text.</p></div>"
     "<div class=sidebar><p>Side</p></div><form><p>Sign up</p></form></body></html>", "T Words of the text."),
]


def test_pages_of_many_kinds(spark):
    model = html_main.fit(table(spark, "pages"))
    frame = spark.createDataFrame([(i, None, h, "x") for i, (h, _) in enumerate(PAGES)],
                                  "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_main.extract(frame, model).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want))
    assert not plain(html_main.extract(frame.limit(0), html_main.fit(frame.limit(0))))


def test_given_pages_give_their_articles(spark):
    import html
    import re
    raw = {r["page_id"]: r["html"] for r in table(spark, "pages").collect()}
    for r in op2_html_main_text(spark, SF_DIR).collect():
        inner = re.search(r"<article>(.*)</article>", raw[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", inner))
        assert r["text"] == " ".join(" ".join(" ".join(html.unescape(b) for b in blocks).split()).split())


def test_mix_of_awkward_rows(spark):
    frame = awkward(spark)
    rows = mixing.taken_words(frame, block=16).collect()
    assert len(rows) == frame.count()
    per = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        mine = per.setdefault(r["source_size"], [0, 0, r["target"]])
        mine[0] += r["taken"]
        mine[1] += r["size"]
    for size, (taken, sizes, target) in per.items():
        assert sizes % size == 0 if size else sizes == 0
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - 1.5 * total) <= 4
    assert plain(mixing.taken_words(frame, block=16)) == plain(mixing.taken_words(frame.repartition(5), block=16))
    assert not plain(mixing.taken_words(empty(spark)))


def test_mixed_documents_hold_the_taken_words(spark):
    frame = awkward(spark)
    mixed = mixing.mixed_documents(frame, block=16)
    assert mixed.columns == frame.columns
    got, want = {}, {}
    for r in mixed.collect():
        assert r["n_chars"] == len(r["text"])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    for r in mixing.taken_words(frame, block=16).collect():
        if r["taken"]:
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    assert got == want
    assert not plain(mixing.mixed_documents(empty(spark)))


def test_schedule_is_even_and_complete(spark):
    goals = spark.createDataFrame([("a", 0, 9000, 5, 9000.0), ("b", 1, 900, 2, 1500.4), ("c", 2, 5, 1, 3.0)],
                                  "source string, number int, source_size long, weight int, target double")
    rows = sorted(map(tuple, mixing.schedule(goals, 10).collect()))
    for number, target in ((0, 9000), (1, 1500), (2, 3)):
        own = [r for r in rows if r[1] == number]
        assert sorted(r[2] for r in own) == list(range(len(own)))
        assert sum(r[3] for r in own) == target
    head = [r for r in rows if r[0] < 500]
    assert abs(sum(r[1] == 0 for r in head) / len(head) - 9000 / 10503.4) < 0.02


def brute_tokens(rows, end=2):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_file())
    library.encode_special_tokens = True
    start, out = 0, []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((d, start, len(ids), zlib.crc32(array.array("I", ids).tobytes())))
        start += len(ids)
    return out


def test_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(token_files, "MEMORY_PIECES", 40)  # forgets all the time
    bits = [" ", "  ", "\n", " \n", "a", "b", "'s", "é", "1", "　", "\t", ".", "x y", " q", "日", "<|endoftext|>", "\r", "\n\n", "\r\n", "z\n", "\x1c", "\u2028", ""]
    rng = random.Random(2)
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    encode = token_files.Encoder(tokenizer_file())
    texts += thue_morse() * 2
    for low in range(0, len(texts), 7):
        for text, own in zip(texts[low:low + 7], encode(texts[low:low + 7])):
            assert np.frombuffer(own, "<i4").tolist() == encode.library.encode(text, add_special_tokens=False).ids
            assert len(encode.later) < 40 + 2 * 7 * 14


def test_token_files_round_trip(spark, tmp_path):
    frame = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r["doc_id"], r["text"]) for r in frame.collect())
    folder = token_files.write(frame, str(tmp_path / "t"), tokenizer_file(), parts=3)
    assert sorted(map(tuple, token_files.checksums(token_files.read(spark, folder)).collect())) == brute_tokens(rows)
    some = token_files.read(spark, folder).where("doc_id = 7").collect()
    assert len(some) == 1 and some[0]["ids"][-1] == 2
    import pyarrow.parquet as pq
    files = sorted((tmp_path / "t" / "tokens").glob("part-*.parquet"))
    seen = [d for f in files for d in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
    assert seen == [r[0] for r in rows]
    group = pq.ParquetFile(max(files, key=lambda f: f.stat().st_size)).metadata.row_group(0)
    assert group.column(0).has_offset_index and group.column(0).has_column_index


def test_token_files_of_awkward_rows(spark):
    frame = awkward(spark)
    got = sorted(map(tuple, token_files.digest(frame, tokenizer_file()).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13]
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    assert not plain(token_files.digest(empty(spark), tokenizer_file()))


def brute_top(rows, k=10):
    q = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q.setdefault(i, [math.floor(1024 * x) for x in v])
    out = []
    for i in q:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, "embeddings").collect()]
    assert sorted(map(tuple, op7_exact_top_k(spark, SF_DIR).collect())) == brute_top(rows)


@pytest.mark.parametrize("kind", ["ties", "clusters"])
def test_top_k_with_several_cells(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "PIVOTS", 4)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 3, 0.2) for _ in range(5)]) for i in range(600)]
    if kind == "ties":
        rows = [(i, [1.0, 0.5] if i % 3 else v[:2]) for i, v in rows]
    rows += [(700, None), (701, [1.0, None]), (800, [float("nan"), 1.0]), (900, [float("inf")]), (None, [1.0, 1.0]),
             (1000, []), (1100, [0.5])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows],
                                  "vec_id long, embedding array<double>, label int, score string")
    vectors = topk.quantized(frame)
    asked = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    assert sorted(map(tuple, topk.search(vectors, asked).collect())) == brute_top(rows)
    none = vectors.limit(0)
    assert not plain(topk.search(none, none.withColumnRenamed("vec_id", "query_id")))
    few = topk.search(vectors.where("vec_id < 3"), asked.where("query_id = 0")).collect()
    assert sorted((r["rank"], r["query_id"]) for r in few) == [(1, 0), (2, 0)]


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline as cp
    from millrace.llm import decontaminate
    given = table(spark, "documents")
    docs_now = given
    for i, (_, stage) in enumerate(cp.STAGES):
        before = [r.asDict() for r in docs_now.collect()]
        after = settle(stage(spark, docs_now, SF_DIR), "stage")
        rows = [r.asDict() for r in after.collect()]
        if i < 4:
            assert after.columns == given.columns
        ids = {r["doc_id"] for r in rows}
        if i == 0:
            judge = language.Judge(language.dictionaries(given))
            want = {r["doc_id"]: judge(r["text"]) for r in before}
            assert ids == {d for d, w in want.items() if w[2]}
            assert all(r["lang"] == want[r["doc_id"]][0] for r in rows)
        elif i == 1:
            classes = ngram_join.join(docs_now, 5, 80, 100).collect()
            assert ids == {r["component_id"] for r in classes} and len(rows) == len(ids)
            assert ids == brute_kept([(r["doc_id"], r["text"]) for r in before], 5, 80, 100)
        elif i == 2:
            items = [decontaminate.plain(r["text"]) for r in table(spark, "benchmark").collect()]
            assert not any(x in decontaminate.plain(r["text"]) for r in rows for x in items)
            assert ids >= {r["doc_id"] for r in before
                           if not any(decontaminate.Finder([(1, x)])(r["text"]) for x in items)}
        elif i == 3:
            words = sum(len(WORD.findall(r["text"])) for r in before)
            assert abs(sum(len(WORD.findall(r["text"])) for r in rows) - 1.5 * words) <= 40
        else:
            assert sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)
            assert len(rows) == len(before)
        docs_now = after
    assert cp.run(spark, SF_DIR).count() == len(rows)


def test_stages_take_awkward_and_empty_tables(spark):
    import corpus_pipeline as cp
    for frame in (awkward(spark), empty(spark)):
        for i, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, frame, SF_DIR)
            assert i == 4 or out.columns == frame.columns
            assert out.count() <= 2 * frame.count()


OPEN_PAGES = [
    ("<html><head><title>x</title><body><article><h1>T</h1><p>Words of it.</p></article></body></html>", "T Words of it."),
    ("<html><head><meta charset=utf-8><title>x</title><article><p>No body tag.</p></article>", "No body tag."),
    ("<head><title>x<body><article><p>Open title.</p></article>", "Open title."),
    ("<head><noscript><img src=a><p>Turn it on</p></noscript><title>x</title><body><article><p>Text.</p></article>", "Text."),
    ("<head><noscript><link href=a><body><article><p>Open noscript.</p></article>", "Open noscript."),
    ("<article><p>One.</p><button>OK<p>Two.</p><p>Three.</p></article>", "One. Two. Three."),
    ("<article><p>One.</p><select><option>a<option>b<p>Two.</p></article>", "One. Two."),
    ("<article><p>One.<video src=a>No video<p>Two.</p><object data=b><p>Three.</p></article>", "One. Two. Three."),
    ("<article><p>One.</p><button><select><option>x<p>Two.</p><button>y<p>Three.</p></article>", "One. Two. Three."),
    ("<article><p>One.</p><button><div>OK</div></button><select><option>a<option>b</select><video><p>No</p></video>"
     "<p>Two.</p></article>", "One. Two."),
    ("<article><p>Of<svg/> <math><mi>x</mi><mo>=</mo><mspace/><mn>2</mn></math> it is said.</p></article>", "Of x=2 it is said."),
]


@pytest.mark.parametrize("page, want", OPEN_PAGES)
def test_pages_without_end_tags(spark, page, want):
    assert html_main.main_text(html_main.fit(table(spark, "pages")), page) == want


def test_encoder_looks_a_word_up_once_for_all_its_places():
    encode = token_files.Encoder(tokenizer_file())
    asked = []

    class Kept(dict):
        def get(self, key, *default):
            asked.append(key)
            return super().get(key, *default)

    encode.later = Kept()
    texts = ["the mill, the river\nand the mill", "a mill", "the the the the", "the\tmill the ", ""] * 3
    for text, own in zip(texts, encode(texts)):
        assert np.frombuffer(own, "<i4").tolist() == encode.library.encode(text, add_special_tokens=False).ids
    assert asked.count("the") <= 2 and asked.count("mill") <= 2  # as known, and after it was learned


def test_encoder_keeps_a_word_once_whatever_marks_follow_it():
    encode = token_files.Encoder(tokenizer_file())
    marks = ["", ".", "***", "'", ".$$$", "\"),", "_"]
    texts = ["x" + "".join(f" {w}{m}" for m in marks) + f"\n{w}%%% it's 'S{m}" for w in ("sheerely", "don't", "Größe") for m in marks]
    assert encode(texts) == [encode._ids(t).tobytes() for t in texts]
    assert not {"sheerely.", "sheerely***", "Größe'", "don't_"} & set(encode.later)
    assert {"sheerely", "\nsheerely", "Größe", "don't"} <= set(encode.later)


def test_an_encoder_no_task_takes_up_again_is_let_go(monkeypatch):
    monkeypatch.setattr(token_files, "IDLE_SECONDS", 0.2)
    path = tokenizer_file()
    first = token_files.encoder(path)
    token_files._rest(path)
    assert token_files.encoder(path) is first  # the next task in time
    time.sleep(0.5)
    assert token_files.encoder(path) is first  # that task is not through
    token_files._rest(path)
    time.sleep(0.5)
    assert path not in token_files._encoders
