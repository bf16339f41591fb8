import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from tallyhouse.llm import line_dedup
from tallyhouse.llm import queries as q
from tallyhouse.llm.components import components
from tallyhouse.llm.decontaminate import contamination_digest, find_benchmark
from tallyhouse.llm.embedding_dedup import close_pairs, embedding_near_duplicates, unit
from tallyhouse.llm.fm_index import FMIndex, suffix_array
from tallyhouse.llm.html_text import LABELLED, extract_main_text, grow_tree, main_text
from tallyhouse.llm.language_id import predict_language, train_language_model
from tallyhouse.llm.line_dedup import dedup_lines
from tallyhouse.llm.mixing import mix_sources, source_targets
from tallyhouse.llm.ngram_join import ngram_jaccard_join
from tallyhouse.llm.quality import score_quality, train_quality_model
from tallyhouse.llm.url_filter import filter_urls, lookup_keys
from tallyhouse.llm.warc import Gap, digest, encode_record, read_warc, salvage, warc_round_trip, write_warc

DOC = "doc_id long, text string, source string, id long, weight string"


def docs_of(spark, texts, source="s"):
    """Rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, source, 7, "x") for i, t in texts], DOC)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def groups(links, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def copies(seed=3, n=60):
    """Texts with near copies around the threshold, exact copies, short, empty and null ones."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n // 6):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 30, 80]))]
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(999)}"
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), "", None, " \t ", "one two", "One  two", "x " * 3000, "x " * 4000]
    return list(enumerate(texts))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, x) for x in range(1001, 1300)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    got = dict(map(tuple, components(spark.createDataFrame(edges + [(5, 5), (None, 4)], "a long, b long").repartition(7)).collect()))
    want = groups(edges, {x for e in edges for x in e})
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if k in got} and len(got) >= 200 + 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_ngram_join_against_brute_force(spark, seed):
    data = copies(seed)
    sets = {}
    for i, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    count, comp = Counter(x for e in links for x in e), groups(links, sets)
    got = ngram_jaccard_join(docs_of(spark, [*data, (None, "a b c d e f")]).repartition(5)).collect()
    assert len(got) == len(data) + 1
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.n_shingles) == (None, 2)
        else:
            assert (r.n_shingles, r.n_links, r.component_id) == (len(sets[r.doc_id]), count[r.doc_id], comp[r.doc_id])


def test_ngram_join_of_nothing_and_of_repeated_rows(spark):
    assert ngram_jaccard_join(docs_of(spark, [])).count() == 0
    twice = docs_of(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])
    assert sorted(map(tuple, ngram_jaccard_join(twice).collect())) == [(1, 2, 1, 1), (1, 2, 1, 1), (2, 2, 1, 1)]


def test_ngram_join_of_ids_with_several_texts(spark):
    p, q_, r = ("a b c d e f", " ".join(f"w{i}" for i in range(40)), "one two three four five six")
    rows = [(6, p), (7, q_), (8, q_.replace("w39", "v")), (9, p), (9, q_), (2, r), (3, r), (3, None), (4, "alone here"), (None, p)]
    got = {(x.doc_id, x.component_id) for x in ngram_jaccard_join(docs_of(spark, rows).repartition(3)).collect()}
    assert got == {(6, 6), (7, 6), (8, 6), (9, 6), (2, 2), (3, 2), (4, 4), (None, None)}


def test_line_dedup_equals_sql(spark, duck):
    assert rows_of(q.op4_line_dedup(spark, DATA).toPandas()) == rows_of(duck.execute(q.SQL["op4_line_dedup"]).fetchdf())


def test_line_dedup_forms_agree(spark):
    docs = q.table(spark, DATA, "documents").select("doc_id", "text")
    assert rows_of(dedup_lines(docs, native=True).toPandas()) == rows_of(dedup_lines(docs, native=False).toPandas())


def test_line_dedup_cases(spark):
    long = " ".join(f"w{i}" for i in range(40))
    near = long.replace("w39", "other")
    texts = [(1, f"{long}\nshort line"), (2, f"short line\n{near}\nkept words are not like any"), (3, None), (None, long), (4, ""), (2, f"short line\n{near}\nkept words are not like any"), (5, f"{near}\n{near}")]
    for native in (True, False):
        got = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs_of(spark, texts), native=native).collect()}
        assert got == {(1, f"{long}\nshort line", 2, 0), (2, "short line\nkept words are not like any", 3, 1), (3, None, 0, 0), (None, long, 1, 0), (4, "", 1, 0), (5, "", 2, 2)}
    out = dedup_lines(docs_of(spark, []))
    assert out.count() == 0 and out.columns == [*docs_of(spark, []).columns, "n_lines", "n_removed"]


def similar_to_earlier(docs, least_words, k=5):
    """(id, line) of lines whose set of shingles has a Jaccard similarity of 0.8 with an earlier line's, pair by pair."""
    sets, gone = [], set()
    for i, t in sorted(docs):
        for at, line in enumerate((t or "").split("\n")):
            w = re.findall(r"[^\x20\x09-\x0D]+", low(line))
            if len(w) >= max(1, least_words):
                own = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))}
                if any(100 * len(own & x) >= 80 * len(own | x) for x in sets):
                    gone.add((i, at))
                sets.append(own)
    return gone


@pytest.mark.parametrize("least_words", [0, 1, 3, 5, 7])
def test_short_lines_against_brute_force(spark, least_words):
    rng = random.Random(7)
    lines = ["", " ", "one", "One", "one two", "ONE \t two", "two one", "one two three", "one two three four", "one two three four five", "one two three four five six", "les.", " les. ", "a a a a", "a a a a a a", "a a a"]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 5)))) for i in range(30)]
    gone = similar_to_earlier(docs, least_words)
    want = [(i, "\n".join(x for at, x in enumerate(t.split("\n")) if (i, at) not in gone)) for i, t in docs]
    for native in (True, False):
        got = dedup_lines(docs_of(spark, docs).repartition(3), least_words=least_words, native=native)
        assert sorted((r.doc_id, r.text) for r in got.collect()) == want


@pytest.mark.parametrize("seed", [0, 2, 1000])
def test_line_dedup_against_brute_force(spark, seed):
    """Lines over a few frequent tokens, in which near copies differ at an end or inside."""
    rng = random.Random(seed)
    stock = [" ".join(f"s{rng.randrange(12)}" for _ in range(12)) for _ in range(6)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            w = " ".join(rng.choice(stock) for _ in range(rng.randrange(1, 5))).split()
            for _ in range(rng.randrange(3)):
                w[rng.choice([0, -1, rng.randrange(len(w))])] = f"v{rng.randrange(5)}"
            lines.append(" ".join(w))
        docs.append((i, "\n".join(lines)))
    gone = similar_to_earlier(docs, 1)
    want = [(i, "\n".join(x for at, x in enumerate(t.split("\n")) if (i, at) not in gone)) for i, t in docs]
    got = dedup_lines(docs_of(spark, docs).repartition(3), least_words=1)
    assert gone and sorted((r.doc_id, r.text) for r in got.collect()) == want


def test_line_dedup_of_lines_with_added_ends(spark):
    """Near copies of different length, alone on their tokens, so that tokens of one prefix lie behind the other."""
    rng = random.Random(5)
    docs = []
    for i in range(150):
        w = [f"b{i}x{j}" for j in range(rng.randrange(10, 30))]
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([f"c{i}x{j}" for j in range(rng.randrange(4))] + w + [f"d{i}x{j}" for j in range(rng.randrange(4))]))]
    rng.shuffle(docs)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    gone = {i for i, _ in similar_to_earlier(docs, 1)}
    assert 40 < len(gone) < 140
    for native in (True, False):
        assert {r.doc_id for r in dedup_lines(docs_of(spark, docs), native=native).where("n_removed > 0").collect()} == gone


def test_line_dedup_compares_no_sets_of_long_lines_that_are_far(spark, monkeypatch):
    """Bitmaps tell lines of 300 words apart whose sets are alike by about 0.6, before any set travels."""
    rng = random.Random(11)
    docs = []
    for i in range(20):
        w = [f"p{i}x{j}" for j in range(300)]
        far, near = list(w), list(w)
        for j in rng.sample(range(10, 290, 10), 14):
            far[j] = f"q{i}x{j}"
        near[150] = f"r{i}"
        docs += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(far)), (3 * i + 2, " ".join(near if i < 5 else ["alone", str(i)]))]
    tables, written = {}, line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, tag: tables.setdefault(tag, written(df, tag)))
    gone = {r.doc_id for r in dedup_lines(docs_of(spark, docs), least_words=1).where("n_removed > 0").collect()}
    assert gone == {i for i, _ in similar_to_earlier(docs, 1)} == {3 * i + 2 for i in range(5)}
    ids = lambda tag: {r.id for r in tables[tag].select("id").distinct().collect()}
    assert ids("later") > gone and ids("fitting") == gone


def test_line_dedup_with_clashing_names_and_many_repeats(spark):
    names = ["id", "line", "row", "gone", "lines", "_id", "_gone", "n", "key1", "n_lines"]
    docs = spark.createDataFrame([(1, "a b c d e f\n" * 20_000, *names)], ["doc_id", "text", *names])
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", *names[:-1], "n_lines", "n_removed"]
    r = got.first()
    assert (r.text, r.n_lines, r.n_removed, r["_gone"]) == ("a b c d e f\n", 20_001, 19_999, "_gone")


def test_suffix_array_and_index():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (50, 2), (400, 3), (300, 5000)):
        text = rng.integers(0, top + 1, n)
        assert suffix_array(text, top).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
        index = FMIndex(text, top)
        for m in (1, 2, 4):
            starts = rng.integers(0, n, 20) % max(1, n - m + 1)
            pats = np.array([text[s : s + m] for s in starts if s + m <= n] or np.zeros((0, m), np.int64))
            if not len(pats):
                continue
            lo, hi = index.search(pats, np.full(len(pats), m))
            for p, a, b in zip(pats, lo, hi):
                want = [i for i in range(n - m + 1) if (text[i : i + m] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute_contamination(docs, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    windows = defaultdict(set)
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(name))
    out = {}
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if own := windows.get(tuple(w[j : j + size])):
                    hit |= set(range(j, j + size))
                    names |= own
        out[i] = (len(w), len(hit), sorted(names))
    return out


@pytest.mark.parametrize("block", [2_000_000, 10])
def test_decontamination_against_brute_force(spark, block):
    item = " ".join(f"w{i}" for i in range(14))
    items = [(1, item), (2, "Tiny item!"), (3, None), (4, ""), (None, "nothing at all"), (10, item.upper()), (5, "a a a a a a a a a a a a")]
    docs = [(1, f"x {item}. y"), (2, "tiny, ITEM tiny item"), (3, None), (4, ""), (5, "tiny"), (6, "item " + " ".join(f"w{i}" for i in range(3, 13))), (7, "a " * 500), (8, "clean text of w1 w2 w3")]
    got = find_benchmark(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    want = brute_contamination(docs, [x for x in items if x[0] is not None])
    for r in got.collect():
        assert (r.n_words, sum(s.last - s.first for s in r.spans), sorted(r["items"])) == want[r.doc_id], r
    assert got.count() == len(docs)
    assert contamination_digest(got).where("contaminated").count() == sum(h > 0 for _, h, _ in want.values())


def test_decontamination_with_text_ids_and_any_number_of_blocks(spark):
    rng = random.Random(4)
    items = [(f"i{i}", " ".join(f"w{rng.randrange(6)}" for _ in range(rng.choice([3, 10, 14])))) for i in range(40)]
    docs = [(f"d{i}", " ".join(f"w{rng.randrange(6)}" for _ in range(300)) + " " + rng.choice(items)[1]) for i in range(20)] + [(None, items[0][1]), ("e", None)]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    want = brute_contamination(docs, items)
    for words in (10**6, 200, 80):
        got = find_benchmark(spark.createDataFrame(docs, "doc_id string, text string"), benchmark, block_words=words).collect()
        assert len(got) == len(docs)
        for r in got:
            assert (r.n_words, sum(s.last - s.first for s in r.spans), sorted(r["items"])) == want[r.doc_id]


def test_decontamination_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = brute_contamination(docs, items)
    for r in q.op7_decontamination(spark, DATA).collect():
        assert (r.n_words, r.n_hit, r.n_items) == (*want[r.doc_id][:2], len(want[r.doc_id][2]))


def test_close_pairs_miss_nothing():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 32))
    v = unit(np.concatenate([base, base + 0.08 * rng.normal(size=base.shape) * np.linspace(0, 6, 40)[:, None]]))
    for least in (0.6, 0.9, 0.99):
        assert set(zip(*map(np.ndarray.tolist, close_pairs(v, v, least)))) == {(i, j) for i in range(80) for j in range(80) if float(np.einsum("i,i", v[i], v[j])) >= least}


def test_embedding_duplicates(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base, base * 3, base + 0.3 * rng.normal(size=base.shape), base + 0.15 * rng.normal(size=base.shape)]).astype(np.float32).astype(float)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [], 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (None, x[0].tolist(), 1)]
    v = unit(x)
    links = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if v[i] @ v[j] >= 0.9] + [(905, 906)]
    count, comp = Counter(a for e in links for a in e), groups(links, [r[0] for r in rows if r[0] is not None])
    got = embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id], comp[r.vec_id], comp[r.vec_id] == r.vec_id)
    assert embedding_near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_duplicates_of_ids_with_several_vectors(spark):
    axis = lambda i, j=None: [float(x == i) + 0.3 * (x == j) for x in range(12)]
    rows = [(1, axis(0)), (1, axis(1)), (2, axis(0, 5)), (3, axis(1, 6)), (4, None), (4, axis(2)), (4, [0.0] * 12), (5, axis(2, 7)), (6, axis(3)), (7, axis(4)), (8, axis(4, 8)), (9, axis(3)), (9, axis(4)), (10, axis(9)), (10, axis(9, 10)), (11, None), (11, [])]
    got = embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    want = {1: (2, 1), 2: (1, 1), 3: (1, 1), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (2, 6), 8: (2, 6), 9: (3, 6), 10: (0, 10), 11: (0, 11)}
    assert len(got) == len(rows) and all((r.n_links, r.component_id, r.kept) == (*want[r.vec_id], want[r.vec_id][1] == r.vec_id) for r in got)


def test_html_cases(spark):
    tree = grow_tree(LABELLED[:, :-1], LABELLED[:, -1])
    page = """<html><head><title>t</title><script>var x = "</p>";</script></head><body><header class=top><p>Site name</p></header><nav><a href=/>Home</a></nav>
    <article><h1>A &amp; B</h1><p>First   paragraph with <b>bold</b>&nbsp;words &lt;here&gt;.<p>Second one<!-- note --> goes on.<div class="ad">Buy this now please.</div>
    <form><label>Your mail</label></form><div id="comments"><p>A reader says many words here and there and more.</p></div></article><footer>&copy; me</footer></body></html>"""
    assert main_text(page, tree) == "A & B\nFirst paragraph with bold words <here>.\nSecond one goes on."
    pages = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "<p" * 3000, "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_main_text(pages).collect()}
    assert got[2] == got[3] == ("", 0) and got[1][1] == len(got[1][0])
    assert extract_main_text(pages.limit(0)).count() == 0


ARTICLE = "<h1>A title here</h1><p>The first paragraph has quite a few words in it, as paragraphs do.<p>And the second one goes on with <a href=/x>a link</a> and more plain words."
ARTICLE_TEXT = "A title here\nThe first paragraph has quite a few words in it, as paragraphs do.\nAnd the second one goes on with a link and more plain words."
WRAPS = [
    '<div class="layout has-sidebar"><article>{}</article></div>', '<article class="post comments-open">{}</article>', '<form id="aspnetForm"><main>{}</main></form>',
    '<main id="content">{}</main>', '<div role="main">{}</div>', '<div class="page-with-menu"><div class="post">{}</div></div>',
]
AROUND = ["{}", "<nav><a href=/>Home</a> <a href=/b>News</a></nav>{}<footer>All rights are ours</footer>", "<div class=cookie-notice>We use cookies here</div>{}<div id=comments><p>A reader says this.</p></div>", '<header><a href="/">Site</a></header>{}<aside class=sidebar><ul><li><a href=/q>Other page</a></ul></aside>', "<title>no end of the head</title><body>{}<form><input><label>Your mail</label></form>"]


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("wrap", WRAPS)
def test_html_layouts(wrap, around):
    tree = grow_tree(LABELLED[:, :-1], LABELLED[:, -1])
    assert main_text("<html><head>" + around.format(wrap.format(ARTICLE)) + "</html>", tree) == ARTICLE_TEXT


def test_html_article_header_and_odd_tags():
    tree = grow_tree(LABELLED[:, :-1], LABELLED[:, -1])
    assert main_text("<article><header><h1>My title</h1></header><p>Some words of the text <p title='a < b'>and <b title=\"x > y\">more</b> of it</article>", tree) == "My title\nSome words of the text\nand more of it"


@pytest.mark.parametrize("bad", ["<p", "<p ", '<p"', "<svg>", "<a href='", "</", "<title", "<p x=\"'>", "<div>", "<nav>x", "<select>", "<![CDATA[", "x</div>"])
def test_html_takes_time_linear_in_the_page(bad):
    import time

    tree = grow_tree(LABELLED[:, :-1], LABELLED[:, -1])
    took = []
    for n in (100_000, 400_000):
        start = time.process_time()
        main_text(bad * (n // len(bad)), tree)
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 0.5


def test_language_and_quality_on_held_out_rows(spark):
    got = q.op6_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert list(got.held_out) == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.95 and got.score.between(0, 1).all()
    got = q.op8_quality(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").toPandas()
    assert (got.quality == got.predicted)[got.held_out].mean() > 0.8 and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_classifiers_take_odd_rows(spark):
    docs = spark.createDataFrame([(1, "der die das und", "de", 0.5), (2, "the of and to", "en", 0.5), (3, None, "en", 0.5), (None, "the and", None, 0.5), (4, "12 34 !?", "en", 0.5), (5, "", "de", 0.5), (6, "the " * 60000, "en", 0.5), (7, "das \ud800".encode("utf-8", "replace").decode(), "de", 0.5)], "doc_id long, text string, lang string, score double")
    model = train_language_model(docs)
    got = {r.doc_id: r.lang_pred for r in predict_language(docs, model).collect()}
    assert got[1] == "de" and got[2] == "en" and got[3] == got[4] == got[5] == "und" and got[6] == "en"
    assert predict_language(docs, train_language_model(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    for some in (labels, labels.limit(0), labels.where("doc_id = 1")):
        out = score_quality(docs, train_quality_model(docs, some)).toPandas()
        assert len(out) == 8 and out.score.between(0, 1).all()


@pytest.mark.parametrize("name", ["op3_mixing", "op10_url_filter"])
def test_native_query_equals_sql(spark, duck, name):
    assert rows_of(q.QUERIES[name](spark, DATA).toPandas()) == rows_of(duck.execute(q.SQL[name]).fetchdf())


def test_mixing_reaches_its_targets(spark):
    rows = [(i, "w " * (i % 7), s) for i, s in enumerate(["b"] * 50 + ["a"] * 5 + [None] * 20 + ["c"])] + [(None, None, "a"), (3, "w w", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs, block_tokens=4).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby("source_size"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.5
    assert rows_of(mix_sources(docs.repartition(3), block_tokens=4).toPandas()) == rows_of(got)
    assert mix_sources(docs.limit(0)).count() == 0
    t = {r.source: r.target for r in source_targets(spark.createDataFrame([("a", 10), ("b", 100), (None, 1000)], "source string, source_size long")).collect()}
    assert t == {"a": 30.0, "b": 300.0, None: 780.0}


def test_mixing_follows_its_schedule(spark, monkeypatch):
    """Slots by plain arithmetic: which block each point reaches, and how near every prefix is to the shares."""
    rows = [(i, "w " * (1 + i % 9), s) for i, s in enumerate(["a"] * 60 + ["b"] * 30 + [None] * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    block, got = 4, mix_sources(docs, block_tokens=4).toPandas().set_index("doc_id")
    total, names = int(got["size"].sum()), ["a", "b", None]
    target = {s: got.target[[r[0] for r in rows if r[2] == s]].iloc[0] for s in names}
    bounds = np.cumsum([target[s] for s in names]) / total
    n, golden = -(-total // block) + 4 * len(names), 618033988749894848
    reached = [names[int(np.searchsorted(bounds, i * golden % 10**18 / 1e18, side="right"))] for i in range(1, n + 1)]
    for s in names:
        ids = sorted((r[0] for r in rows if r[2] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        tokens = [i for i in ids for _ in range(int(got["size"][i]))]
        blocks, quota, first, rank = -(-len(tokens) // block), int(target[s] + 0.5), {}, 0
        for slot, which in enumerate(reached, 1):
            if which == s:
                a, left = rank % blocks * block, quota - rank // blocks * len(tokens) - rank % blocks * block
                for i in tokens[a : a + block][: max(left, 0)]:
                    first.setdefault(i, slot)
                rank += 1
        assert {i: x for i, x in got.first_slot[ids].dropna().items()} == first
        counts = np.cumsum([which == s for which in reached])
        assert np.abs(counts - np.arange(1, n + 1) * target[s] / total).max() < 2.5
    monkeypatch.setattr("tallyhouse.llm.mixing._GOLDEN", 1)
    other = mix_sources(docs, block_tokens=4).toPandas().set_index("doc_id")
    assert not other.first_slot.equals(got.first_slot.reindex(other.index))


def test_url_filter_cases(spark):
    entries = spark.createDataFrame([("Ads.com", "x", 10, True), ("ads.com", "x", 20, False), ("site.org/bad", "y", 5, True), (None, "z", 1, True), ("ads.com", "x", 30, True), ("ads.com", "x", 30, False)], "pattern string, category string, dated long, active boolean")
    cases = [("http://a.ads.com/x", 9, 0), ("http://a.ads.com/x", 10, 1), ("https://u@ADS.com:80/", 19, 1), ("http://ads.com", 20, 0), ("http://ads.com.", 30, 1), ("http://badads.com/", 15, 0), ("http://site.org/bad/deep?q", 6, 1), ("http://site.org/badly", 6, 0), ("http://site.org/bad", 4, 0), (None, 6, 0), ("no url", 6, 0), ("http://ads.com", None, 0)]
    captures = spark.createDataFrame([(i, u, t, "c") for i, (u, t, _) in enumerate(cases)] + [(1, "http://a.ads.com/x", 10, "c")], "page_id long, url string, fetched long, category string")
    got = filter_urls(captures, entries).collect()
    assert len(got) == len(cases) + 1 and all(r.n_active == cases[r.page_id][2] and r.blocked == (r.n_active > 0) for r in got)
    assert filter_urls(captures.limit(0), entries).count() == 0 and filter_urls(captures, entries.limit(0)).where("blocked").count() == 0
    assert spark.range(1).select(lookup_keys(F.lit("http://a.b.c/x/y?z"))).first()[0] == ["a.b.c", "b.c", "c", "a.b.c/x", "a.b.c/x/y"]


def test_url_filter_with_clashing_names_and_long_urls(spark):
    names = ["_url", "_at", "_first", "since", "until"]
    long = "http://site.org/bad" + "/x" * 50_000
    captures = spark.createDataFrame([(1, long, 6, *names), (2, "http://site.org/good", 6, *names)], ["page_id", "url", "fetched", *names])
    entries = spark.createDataFrame([("site.org/bad/x", "y", 5, True)], "pattern string, category string, dated long, active boolean")
    got = {r.page_id: (r.n_active, r.pattern, r["_first"]) for r in filter_urls(captures, entries).collect()}
    assert got == {1: (1, "site.org/bad/x", "_first"), 2: (0, None, "_first")}


def test_classifiers_take_clashing_names(spark):
    docs = spark.createDataFrame([(i, t, lang, "a", "b", 1) for i, (t, lang) in enumerate([("der die das und", "de"), ("the of and to", "en")] * 4)], ["doc_id", "text", "lang", "_id", "id", "label"])
    assert {r.lang_pred for r in predict_language(docs, train_language_model(docs)).collect()} == {"de", "en"}
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"), "_id", "id")
    assert score_quality(docs, train_quality_model(docs, labels)).where("predicted = doc_id % 2").count() >= 4


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "same é", 1), (5, None, "same é", 1), (3, "u", None, 1), (4, "u", "", 1), (None, "u", "same é", 1), (6, "u", "x" * 300_000, 1)]
    got = {r.page_id: tuple(r)[1:] for r in warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, row int")).collect()}
    same, none = digest("same é".encode()), digest(b"")
    assert got == {1: (7, same, "revisit", 5), 5: (7, same, "response", None), 3: (0, none, "revisit", 4), 4: (0, none, "response", None), None: (7, same, "response", None), 6: (300_000, digest(b"x" * 300_000), "response", None)}
    assert warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_keeps_records_with_long_headers(spark):
    pages = [(i, "http://a/" + "é" * n, "p") for i, n in enumerate((10, 40_000, 300_000))]
    got = warc_round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None)]
    record = encode_record({"WARC-Type": "response", "WARC-Target-URI": "u" * 70_000}, b"x")
    assert isinstance(next(salvage(io.BytesIO(record))), Gap) and next(salvage(io.BytesIO(gzip.compress(record)))).block == b"x"


@pytest.mark.parametrize("pack", [gzip.compress, bytes])
def test_salvage(spark, pack):
    records = [pack(encode_record({"WARC-Type": "response", "WARC-Block-Digest": "sha1:" + digest(b"x%d" % i * 50)}, b"x%d" % i * 50)) for i in range(12)]
    good = b"".join(records)
    at = len(b"".join(records[:4]))
    broken = bytearray(good)
    broken[at + len(records[4]) // 2] ^= 255
    for data, lost in ((good, 0), (bytes(broken), 1), (good[:at] + b"noise\x1f\x8b\x08 WARC/1.1\r\n" + good[at:], 0), (good[:-9] if pack is gzip.compress else good[:-60], 1), (good[: at - 5] + good[at + 5 :], 2)):
        found = list(salvage(io.BytesIO(data)))
        assert sum(not isinstance(x, Gap) for x in found) == 12 - lost
        assert sum(x.length for x in found) == len(data)
        ends = 0
        for x in found:
            assert x.offset == ends
            ends += x.length


def test_read_warc_logs_gaps(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"p{i}") for i in range(6)], "page_id long, url string, html string").coalesce(1)
    files = write_warc(pages, f"file://{tmp_path}/w")
    path = next((tmp_path / "w").glob("*.gz"))
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 255
    path.write_bytes(bytes(data))
    got = read_warc(files, f"file://{tmp_path}/w").collect()
    assert sum(r.quarantine is None for r in got) == 5 and sum(r.quarantine is not None for r in got) == 1


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == p.COLUMNS, name
        from tallyhouse.llm.scratch import written

        docs = written(out, "stage")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and 0.5 * len(before) < len(after)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert set(after) == {i for i, (_, hit, _) in brute_contamination(before.items(), items).items() if not hit}
        if name in ("n-gram join", "decontamination"):
            assert all(after[i] == before[i] for i in after)
        before = after
    mix = p.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert sorted(mix.doc_id) == sorted(before)


def test_pipeline_drops_contaminated_rows_without_id(spark):
    import corpus_pipeline as p

    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, "clean words", "en", "s", 1), (2, item, "en", "s", 1), (None, item, "en", "s", 1), (None, "clean words too", "en", "s", 1), (None, None, "en", "s", 1), (None, f"x {item} y", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(((r.doc_id, r.text) for r in p.benchmark_free(spark, docs, DATA).collect()), key=str) == [(1, "clean words"), (None, "clean words too"), (None, None)]


def test_pipeline_stages_against_other_ways(spark):
    """Language ID against op6, line dedup and n-gram join against all pairs that share a shingle, mixing against OP3_SQL."""
    import corpus_pipeline as p
    import duckdb

    from tallyhouse.llm.scratch import written

    words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)

    def similar(sets):
        """Pairs (i, j), i < j, of sets with a Jaccard similarity of 0.8 or more."""
        holders, pairs = defaultdict(list), Counter()
        for j, own in enumerate(sets):
            for x in own:
                pairs.update((i, j) for i in holders[x])
                holders[x].append(j)
        return [(i, j) for (i, j), both in pairs.items() if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)]

    def shingles_of(w):
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(p.STAGES)
    docs = written(stages["language id"](spark, docs, DATA), "stage")
    after = {r.doc_id: r.text for r in docs.collect()}
    told = q.op6_language_id(spark, DATA).where((F.col("lang_pred") != "und") & (F.col("score") >= p.LEAST_SCORE)).collect()
    assert after == {r.doc_id: before[r.doc_id] for r in told}

    docs, before = written(stages["line dedup"](spark, docs, DATA), "stage"), after
    after = {r.doc_id: r.text for r in docs.collect()}
    lines = [(i, at, shingles_of(words_of(x.lower()))) for i, t in sorted(before.items()) for at, x in enumerate(t.split("\n"))]
    gone = {lines[j][:2] for _, j in similar([x[2] for x in lines])}
    want = {}
    for i, t in before.items():
        kept = "\n".join(x for at, x in enumerate(t.split("\n")) if (i, at) not in gone)
        if kept == t or words_of(kept):
            want[i] = kept
    assert gone and after == want

    docs, before = written(stages["n-gram join"](spark, docs, DATA), "stage"), after
    after = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(before)
    comp = groups([(ids[i], ids[j]) for i, j in similar([shingles_of(words_of(low(before[i]))) for i in ids])], ids)
    assert after == {i: before[i] for i in ids if comp[i] == i}

    docs = written(stages["decontamination"](spark, docs, DATA), "stage")
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841 (the table of the SQL)
    assert rows_of(stages["mixing"](spark, docs, DATA).toPandas()) == rows_of(con.execute(q.SQL["op3_mixing"]).fetchdf())


def test_embedding_tiles_shuffle_no_vectors(spark, monkeypatch):
    """Over many blocks, with a large group of near copies and vectors that float32 can't hold: all links, and shuffles that don't grow with the blocks."""
    from tallyhouse.llm import embedding_dedup

    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 48)).astype(np.float32).astype(float)
    x[::10] = x[0] + 0.15 * rng.normal(size=(300, 48))
    monkeypatch.setattr(embedding_dedup, "BLOCK", 128)

    def shuffled():
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    got = embedding_near_duplicates(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).collect()
    assert shuffled() - before < 3 * x.nbytes
    v = unit(x)
    near = v @ v.T >= 0.9
    comp = groups([tuple(e) for e in np.argwhere(near).tolist() if e[0] < e[1]], list(range(3000)))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(near[i].sum()) - 1, comp[i]) for i in range(3000)}
