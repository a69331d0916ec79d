import hashlib
import random
import tracemalloc

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings, strategies as st

from lectern.llm.common import first_ids, one_row_each, training_rows
from lectern.llm import bpe, common, decontam, html_mincut, langid, quality, queries, quotes, sharding, simhash, toxicity, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (5, "x" * 3000 + " end"), (None, "no id here"), (6, "🙂 é ß " * 40), (7, "a\r\nb\x00c")]


def docs_of(spark, rows, schema=DOC):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)


def clashing(df):
    """Extra columns with the names that operators make."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("score", "fp", "kept", "y", "shard", "held_out", "n", "__id", "__text")})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'sre L\n\t .,1é ", max_size=120), st.integers(5, 40), st.integers(5, 12))
def test_stitching_gives_the_pre_tokens_of_the_whole(text, chunk, overlap):
    pattern = public_tokenizers.PATTERN
    chunks = bpe.split_chunks(text, chunk, min(overlap, chunk))
    pieces = bpe.stitch(chunks, [bpe.boundaries(t, pattern) for _, t in chunks], pattern, chunk)
    assert "".join(pieces) == text
    assert [t for p in pieces for t in regex.findall(pattern, p)] == regex.findall(pattern, text)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(queries.RANKS))


def test_encoding_equals_the_library_and_round_trips(spark, ranks):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    long_text = "".join(rng.choice(["the", " and", "  ", "\n\n", "'ll", "é", "123", "...", " "]) for _ in range(9000))
    rows = [*ODD, (8, long_text), (9, " " * 5000)]
    got = bpe.encode(clashing(docs_of(spark, rows)), ranks, public_tokenizers.PATTERN, chunk=1000, overlap=60, decoded=True).collect()
    assert len(got) == len(rows)
    expected = sorted((str(i), np.asarray(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == expected
    again = bpe.decode(bpe.encode(docs_of(spark, rows), ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in again.collect()) == sorted((i, d) for i, _, d in expected)


def test_codecs_of_vocabularies_of_one_size(spark, ranks):
    base = {bytes([i]): i for i in range(256)}
    docs = spark.createDataFrame([(1, "abcd"), (2, None)], "doc_id long, text string").coalesce(1)
    one, two = (bpe.encode(docs, base | {pair: 256}, ".+").select("n_tokens", "ids").collect() for pair in (b"ab", b"cd"))
    assert [r.n_tokens for r in one] == [r.n_tokens for r in two] == [3, 0] and one[0].ids != two[0].ids
    coded = spark.createDataFrame([(1, None), (2, bytearray(b"\x61\x00\x00\x00"))], "doc_id long, ids binary")
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(coded, base, ".+").collect()} == {1: b"", 2: b"a"}


def test_repeats_of_long_texts(spark, ranks):
    docs = docs_of(spark, [(1, "word and " * 400)] * 7 + [(None, "word and " * 400)] * 2).repartition(3)
    got = bpe.encode(docs, ranks, public_tokenizers.PATTERN, chunk=500, overlap=50).collect()
    assert len(got) == 9 and len({(r.n_tokens, bytes(r.ids)) for r in got}) == 1


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n#", max_size=80))
def test_text_counts_by_brute_force(text):
    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip()]
    _, ids, chars, symbols, duplicates, repeats = quality.text_counts(text)
    assert (len(ids), chars, symbols, duplicates, repeats) == (len(words), sum(map(len, words)), text.count("#"), len(lines) - len(set(lines)), len(covered))


def test_quality_learns_and_handles_odd_rows(spark):
    rng = random.Random(2)
    word = lambda bad: rng.choice(["###", "%%%", "$$"]) if bad and rng.random() < 0.5 else "".join(rng.choices("abcdefg", k=4))
    rows = [(i, " ".join(word(i % 2) for _ in range(80))) for i in range(100, 220)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(100, 200)] + [(300, None), (None, 1)], "doc_id long, quality int")
    docs = clashing(docs_of(spark, ODD + rows))
    got = {(r.doc_id, r.n_words): r.kept for r in quality.judge(docs, labels).collect()}
    assert all(got[i, 80] == (i % 2 == 0) for i, _ in rows) and not any(got[k] for k in got if k[1] < 50)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_quality_fit_needs_little_more_than_its_vectors(spark):
    """The driver's own memory in the fit, by the numbers that the executors send: 24 bytes for each, and 24 MB."""
    rng = random.Random(20)
    rows = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(1200))) for i in range(300)]
    sent = sum(len(set(part.tolist())) for _, t in rows for part in quality.features(t, *quality.text_counts(t)[:2]))
    docs, labels = docs_of(spark, rows), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    assert quality.fit(docs, labels, 20) is not None and sent > 1_500_000
    tracemalloc.start()
    try:
        quality.fit(docs, labels)
        assert tracemalloc.get_traced_memory()[1] < 24 * sent + 24e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_fits_in_blocks_equal_the_dense_ones(monkeypatch, block):
    rng = np.random.default_rng(21)
    x = np.where(rng.random((60, 40)) < 0.2, rng.integers(1, 9, (60, 40)), 0).astype(np.float32)
    x[[0, 30, 59]], x[:, [0, 20, 39]] = 0, 0
    y = (rng.random((60, 2)) < 0.4).astype(float)
    row, col = np.nonzero(x)
    whole = common.fit_logistic(row, col, x[row, col] * 0.5, y, 40, l2=1e-2)
    monkeypatch.setattr(common, "BLOCK", block)
    w, b = common.fit_logistic(row.astype(np.uint16), col.astype(np.uint16), x[row, col], y, 40, l2=1e-2, scale=0.5)
    assert np.array_equal(w, whole[0]) and np.array_equal(b, whole[1]) and not w[[0, 20, 39]].any()
    error = (common.sigmoid(x * 0.5 @ w + b) - y) / 60
    assert abs((x * 0.5).T @ error + 1e-2 * w).max() < 1e-3 and abs(error.sum(0)).max() < 1e-3
    assert np.allclose(common.linear_scores(row, col, x[row, col], w[:, 0], 60, 0.5), x * 0.5 @ w[:, 0])
    none = np.zeros(0, np.uint16)
    assert not common.fit_logistic(none, none, none.astype("f4"), y[:, 0], 40)[0].any() and not common.linear_scores(none, none, none, w[:, 0], 3).any()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=14))
def test_maximal_segments_by_brute_force(scores):
    """Segments are disjoint, and the best one has the greatest sum of any."""
    got = toxicity.maximal_segments(scores)
    assert all(sum(scores[a:b]) == s > 0 for a, b, s in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    best = max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)
    assert max((s for *_, s in got), default=0) == max(best, 0)
    # Every positive item lies in a segment.
    assert all(any(a <= i < b for a, b, _ in got) for i, s in enumerate(scores) if s > 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-9, 9), max_size=16), st.integers(0, 10**6))
def test_all_maximal_segments_by_recursion(scores, seed):
    """The best segment, then those left and right of it, and so on; small fractions part ties."""
    rng = random.Random(seed)
    scores = [x + rng.random() / 100 for x in scores]

    def best(low, high):
        options = [(sum(scores[a:b]), a, b) for a in range(low, high) for b in range(a + 1, high + 1)]
        total, a, b = max(options, default=(0, 0, 0))
        return [*best(low, a), (a, b, total), *best(b, high)] if total > 0 else []

    got = toxicity.maximal_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in best(0, len(scores))] and all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, best(0, len(scores))))


def test_toxicity_finds_passages_and_leaves_clean_texts(spark):
    rng = random.Random(3)
    clean = lambda n: ["".join(rng.choices("abcdefgh", k=3)) for _ in range(n)]

    def text(i):
        words = clean(120)
        if i % 4 == 0:
            for at in range(40, 60, 5):
                words[at] = rng.choice(["zorkling", "zorkled", "quuxish"])
        return " ".join(words)

    rows = [(i, text(i)) for i in range(1000, 1600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    docs = clashing(docs_of(spark, ODD + rows))
    got = [r for r in toxicity.rate(docs, labels).collect() if (r.doc_id or 0) >= 1000]
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.98
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 1
    model = toxicity.fit(docs, labels)
    found = toxicity.passages(docs.filter("doc_id = 1000"), model).first()
    assert 35 <= found.first_token <= 41 and 55 <= found.end_token <= 65
    assert toxicity.rate(docs, labels.limit(0)).count() == docs.count()


def test_rows_of_one_id_bring_one_row_to_the_fits(spark):
    docs = docs_of(spark, [(1, f"text {i}") for i in range(10_000)] + [(2, "other"), (None, "none")])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 0), (None, 1, 1)] * 50, "doc_id long, quality int, toxic int")
    assert sorted(r.y for r in training_rows(docs, labels, "quality", 10, any_fold=True).collect()) == [0, 1]
    ids = docs.withColumnRenamed("doc_id", "__id").select("__id", "text")
    assert one_row_each(ids, first_ids(ids, 5)).count() == 2 and first_ids(ids.limit(0), 5).count() == 0
    assert first_ids(spark.range(5000).withColumnRenamed("id", "__id"), 700).count() == 700


def test_calibration_at_every_size(spark):
    """Two labelled rows, or a label of one kind only, give every text a score, without another rule for small tables."""
    docs = docs_of(spark, [(i, "good clean words " * 30 if i % 2 else "zork zork bad " * 30) for i in range(8)])
    for n in (0, 1, 2, 8):
        labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(n)], "doc_id long, quality int, toxic int")
        assert all(0 <= r.score <= 1 for r in toxicity.rate(docs, labels).collect())
        assert quality.judge(docs, labels).count() == 8


def test_long_and_repeated_texts(spark):
    words = "the quick brown fox jumps over a lazy dog and then rests".split()
    rng = random.Random(14)
    long_text = " ".join(rng.choices(words, k=60_000))
    rows = [(1, long_text), (1, long_text), (2, "x" * 400_000), (3, long_text + " end")]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for out, column in ((quality.judge(docs, labels), "quality"), (toxicity.rate(docs, labels), "score"), (langid.identify(docs), "score"), (simhash.near_duplicates(docs), "fp")):
        got = [(r.doc_id, r[column]) for r in out.collect()]
        assert len(got) == 4 and len({x for i, x in got if i == 1}) == 1
    assert {r.n_words for r in quality.judge(docs, labels).collect()} == {60_000, 1, 60_001}


def test_decoding_by_brute_force_and_ties():
    rng = np.random.default_rng(15)
    for n in (2, 4, 9):
        code = langid.codewords(n)
        model = langid.Model([f"l{i}" for i in range(n)], code, rng.normal(size=(1 << langid.BITS, code.shape[1])), rng.normal(size=code.shape[1]), rng.random(code.shape[1]) + 0.1)
        for text in ("abc def", "żółw", "x" * 50):
            at = langid.grams(text)
            margin = [sum(model.weights[g, j] for g in at) * langid.SCALE / len(at) + model.bias[j] for j in range(code.shape[1])]
            costs = [sum(model.importance[j] * np.log1p(np.exp(-m if code[i, j] else m)) for j, m in enumerate(margin)) for i in range(n)]
            assert model.judge(text)[0] == f"l{int(np.argmin(costs))}"
    even = langid.Model(["a", "b"], langid.codewords(2), np.zeros((1 << langid.BITS, 1)), np.zeros(1), np.ones(1))
    assert even.judge("text") == ("a", 0.5, True)
    assert [even.judge(t)[0] for t in ("½ ² 3", "Ⅷ", None, "", "é")] == ["und", "und", "und", "und", "a"]


def test_codewords_tell_languages_apart():
    for n in (2, 3, 5, 7, 12):
        code = langid.codewords(n)
        assert code.shape[0] == n and min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 1


def test_language_of_held_out_and_odd_rows(spark):
    letters = {"aa": "abcd", "bb": "efgh", "cc": "ijkl"}
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choices(letters[x], k=5)) for _ in range(30)), x) for i in range(300) for x in [sorted(letters)[i % 3]]]
    odd = [(900, None, "aa"), (901, "123 !!", "aa"), (902, "abcd", None)]
    docs = spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows + odd], DOC)
    got = {r.doc_id: r for r in langid.identify(clashing(docs)).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows if got[i].held_out)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "aa"
    assert langid.identify(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=7), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 4)), max_size=10))
def test_minimum_cut_by_brute_force(pull, edges):
    edges = [(a % len(pull), b % len(pull), float(w)) for a, b, w in edges if a % len(pull) != b % len(pull)]
    cost = lambda x: sum(-p if p < 0 and x[i] else p if p > 0 and not x[i] else 0 for i, p in enumerate(pull)) + sum(w for a, b, w in edges if x[a] != x[b])
    got = html_mincut.minimum_cut([float(p) for p in pull], edges)
    n = len(pull)
    assert abs(cost(got) - min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))) < 1e-6


def test_page_text():
    page = """<html><head><title>T</title><script>var a="</p><p>no";</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies.</p></div><article><h1>Head &amp; more</h1><p>First <b>bo</b>ld,<br>line
    two.<p>a < b</p><aside>Related: x</aside><table><tr><td>c1<td>c2</table></article><section id=comments><p>A reader says.</p></section>
    <form><input>Mail<button>Go</button></form><footer>&copy; me</footer></body></html>"""
    weights = np.array([1.5, -4.0, 1.0, 0.5, 0.5, 1.0])
    assert html_mincut.main_text(page, weights, -1.5) == "Head & more First bold, line two. a < b c1 c2"
    assert html_mincut.main_text(None, weights, -1.5) == html_mincut.main_text("<p", weights, -1.5) == ""


@pytest.mark.parametrize("page", [
    "<body><select><option>A<option>B</select>{}", "<body><select><optgroup label=x><option>A<optgroup label=y><option>B</select>{}",
    "<body><svg width='1' />{}", "<body><svg/>{}", "<body><svg><title/><path d='x'/><g><circle r=1 /></g></svg>{}", "<body><math display=block />{}",
    "<head><title>T</title><meta charset=x>{}", "<html><head><link rel=x href=/a/>{}", "<body><div><button>x</div>{}", "<body><datalist><option>A</option><option>B</datalist>{}",
    "<body><svg><foreignObject><div>in</div></foreignObject></svg>{}", "<body><svg width=10/><text>no</text></svg>{}"])
def test_silent_elements_end_where_they_must(page):
    kept = [b[0] for b in html_mincut.blocks(page.format("<article><p>Some text. <svg><text>no</text></svg>More.</p><select><option>no</option></select></article>"))]
    assert " ".join(kept) == "Some text. More."


def test_names_outweigh_only_where_they_are_whole():
    prose = "A paragraph of some length, with commas, that says a thing or two."
    weights = np.array([1.5, -4.0, 1.0, 0.5, 0.5, 1.0])
    inside = f"<article><header class=entry-header><h1>Title</h1></header><p>{prose}</p><div class='side-effects'><p>Nausea, or fever.</p></div><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> be.</p></article>"
    assert html_mincut.main_text(f"<body><div class='main-nav'>Home</div>{inside}<div id=commentList><p>{prose}</p></div></body>", weights, -1.5) == f"Title {prose} Nausea, or fever. Let x=1 be."
    assert [html_mincut.name_strength(x) for x in ("nav", "siteFooter", "cookie-notice", "side-effects", "post-content", "headerless", "entry-header")] == [-2, -2, -2, -1, 2, 0, -2]


def test_the_cut_alone_separates_a_page_that_names_nothing():
    """No element says what it is: the classifier's capacities and the edges decide; a short line amid prose is kept by
    its edges, which the classifier alone would drop."""
    prose = "A paragraph of some length, with commas, that says a thing or two about its matter, and ends."
    page = "<div>" + "".join(f"<div><a href=x>Link {i}</a></div>" for i in range(6)) + f"</div><div><p>{prose}<p>{prose}<p>See<p>{prose}</div><div><a href=a>About</a><br><a href=b>Terms</a></div>"
    weights = np.array([1.5, -4.0, 1.0, 0.5, 0.5, 1.0])
    assert html_mincut.main_text(page, weights, -1.5) == f"{prose} {prose} See {prose}"
    assert html_mincut.traits("See", 0, 0) @ weights - 1.5 < 0


def test_text_ends_a_head():
    assert [b[0] for b in html_mincut.blocks("<head><title>T</title>Words at once<p>and more")] == ["Words at once", "and more"]


def test_long_and_repeated_pages(spark):
    page = "<article>" + "<p>Some words of a paragraph.</p>" * 3000 + "</article><footer>f</footer>"
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    got = [(r.page_id, len(r.text)) for r in html_mincut.extract(clashing(pages)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 3000 * 27 - 1)] * 2 + [(2, 0), (None, 0)]))


def test_alignment_by_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.randint(1, 3) for _ in range(rng.randint(1, n))] for n in (6, 9))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontam.align(np.array(a), np.array(b))[0] == h.max()


def test_leaks_of_edited_copies(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    items = [[word() for _ in range(30)] for _ in range(20)]
    edited = [w if i % 6 else word() for i, w in enumerate(items[3])]
    filler = lambda n: [word() for _ in range(n)]
    rows = [(10, " ".join(filler(500) + items[1] + filler(500))), (11, " ".join(filler(50) + edited)), (12, " ".join(filler(300))), (13, " ".join(items[2][:5] + filler(100))), (10, " ".join(items[1]))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(0, None), (None, "x"), (50, "tiny item")], "item_id long, text string")
    docs = clashing(docs_of(spark, ODD + rows))
    got = sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect())
    assert got == [(10, 1), (10, 1), (11, 3)]
    assert sorted(str(r.doc_id) for r in decontam.drop_leaks(docs, bench).collect()) == sorted(str(i) for i, _ in ODD + rows if i not in (10, 11))
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0


def test_leaks_of_much_copied_items_and_of_common_words(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    hot, common = [word() for _ in range(20)], "it is in the end that which was to be of the and for it all".split()
    stop = lambda n: [rng.choice(common + ["on", "as", "by", "or"]) for _ in range(n)]
    rows = [(i, " ".join([word() for _ in range(15)] + (hot if i % 3 == 0 else []) + [word() for _ in range(15)])) for i in range(60)]
    rows += [(100 + i, " ".join(stop(40) + (common if i % 3 == 0 else []) + [word() for _ in range(5)])) for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(hot)), (2, " ".join(common))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs_of(spark, rows), bench).collect()}
    assert {(i, 1) for i in range(0, 60, 3)} | {(100 + i, 2) for i in range(0, 30, 3)} <= got and {i for i, k in got if k == 1} == set(range(0, 60, 3))
    # Windows left out by their bound would not have scored: the same as aligning each of them.
    index = decontam.Index([(r.item_id, decontam.words(r.text)) for r in bench.collect()])
    pruned = [index.leaks(t) for _, t in rows]
    index.bound = lambda key, window: float("inf")
    assert [index.leaks(t) for _, t in rows] == pruned


def test_leaks_of_parts_of_long_items(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    long, huge = [word() for _ in range(200)], [word() for _ in range(500)]
    filler = lambda n: [word() for _ in range(n)]
    edited = [w if i % 6 else word() for i, w in enumerate(huge[200:300])]
    rows = [(1, filler(300) + long[50:145] + filler(300)), (2, filler(20) + huge[:240]), (3, long[20:40]), (4, filler(100) + edited), (5, filler(300) + long[:20] + filler(300)), (6, long[:8]), (7, filler(400))]
    docs = docs_of(spark, [(i, " ".join(ws)) for i, ws in rows])
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(huge))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, r.end_word) for r in decontam.find_leaks(docs, bench).collect()}
    assert sorted(got) == [(1, 1), (2, 2), (3, 1), (4, 2)] and got[1, 1] == (300, 395) and got[2, 2] == (20, 260)
    assert sorted(r.doc_id for r in decontam.drop_leaks(docs, bench).collect()) == [5, 6, 7]


def test_seeds_find_what_aligning_every_pair_finds():
    """Recall against the alignment of every item with every whole text, for copies with any share of words changed."""
    rng = random.Random(13)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(400)]
    items = [(k, rng.choices(vocabulary, k=rng.randint(12, 40))) for k in range(15)]
    texts = []
    for _ in range(120):
        _, ws = rng.choice(items)
        share = rng.random() * 0.35
        texts.append(rng.choices(vocabulary, k=rng.randint(0, 60)) + [rng.choice(vocabulary) if rng.random() < share else w for w in ws if rng.random() > share / 4] + rng.choices(vocabulary, k=rng.randint(0, 60)))
    index = decontam.Index(items)
    every, found = set(), set()
    for i, ws in enumerate(texts):
        numbers = np.array([index.number.get(w, 0) for w in ws], np.int64)
        every |= {(i, key) for key, item in enumerate(index.items) if decontam.align(item, numbers)[0] >= decontam.least_score(len(item), len(ws))}
        found |= {(i, key) for key, *_ in index.leaks(" ".join(ws))}
    assert found <= every and len(found) >= 0.97 * len(every) and len(every) > 90


def test_seed_numbers_may_wrap():
    index = decontam.Index([(1, ["a", "b", "c", "d", "e"]), (2, ["f", "g"])])
    index.base = np.uint64(1 << 40)
    index.codes = {size: np.unique(index.code(np.array([s for s in index.seeds if len(s) == size], np.uint64).reshape(-1, size).T)) for size in (1, 2, 3)}
    assert [k for k, *_ in index.leaks("x a b c d e y")] == [1] and [k for k, *_ in index.leaks("f g")] == [2] and not index.leaks("a c e b d")


def test_links_connect_what_all_pairs_do(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)} | set(range(16))
    for _ in range(2):
        fps |= {f ^ (1 << rng.randrange(64)) for f in list(fps)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    got = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()
    root = {r.node: r.root for r in got}
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    array = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 4):
            parent[find(i)] = find(int(j))
    classes = {}
    for i, f in enumerate(signed):
        classes.setdefault(find(i), set()).add(f)
    mine = {}
    for f in signed:
        mine.setdefault(root.get(f, f), set()).add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


def test_near_duplicates_of_odd_rows(spark):
    copy = " ".join(f"word{i}" for i in range(200))
    docs = clashing(docs_of(spark, [*ODD, (30, copy), (20, copy + " more"), (40, copy)]))
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (30, 20), (40, 20), (20, 20)} <= got and (None, None) in got
    kept = simhash.keep_one(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 6, 7, 20, None])) and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(80)) for c in "xyz")
    rows = [(1, x), (4, x), (4, y), (4, y), (None, z), (None, z), (None, x), (9, None), (8, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, __times int")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns and sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted([("1", x), ("4", y), ("None", z), ("8", "")])
    assert len({r[2] for r in got.collect()}) == 4


def test_fingerprints_by_the_rule(spark):
    import xxhash

    rng = random.Random(12)
    texts = [" ".join(rng.choice(["A", "bb", "Cé", "dd\t", "🙂"]) for _ in range(n)) for n in (0, 1, 3, 4, 5, 60, 700)] + ["Z" * 200_000, None]
    for text in texts:
        words = [w for w in regex.split(r"[\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
        wanted = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) % (1 << 64) == wanted


def test_links_of_a_key_over_many_batches(spark):
    """One key holds many fingerprints, more than an Arrow batch: links are the same as those of one batch."""
    fps = [(k << 40) | (1 << (14 + k % 12)) for k in range(64)]
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    whole = {(r.u, r.v) for r in simhash.components(simhash.links(frame)).select("node", "root").toDF("u", "v").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {(r.u, r.v) for r in simhash.components(simhash.links(frame)).select("node", "root").toDF("u", "v").collect()} == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_url_templates_learn_from_labels(spark):
    rows = [(i, f"http://h.com/bad/{i}") for i in range(10)] + [(10 + i, f"http://h.com/good/{i}") for i in range(10)] + [(90, "http://H.com/bad/abc"), (91, "http://other.org/bad/1"), (92, None), (93, "nothing"), (94, "x://h.com?/bad/1")]
    rules = [urls.Rule("com", f"/bad/{i}", "block") for i in range(8)] + [urls.Rule("com", "/good/", "allow")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'x' AS n", "'x' AS verdict")
    got = {r.page_id: r for r in urls.judge(pages, rules).collect()}
    assert got[9].verdict == "block" and got[9].rule is None and got[9].pattern == "/bad/(abc|{n})" and got[90].verdict == "block"
    assert got[3].rule == "com/bad/3" and got[15].verdict == "allow" and got[91].verdict == "allow"
    assert (got[92].host, got[92].path, got[93].host, got[94].host, got[94].path, got[90].host) == ("", "", "", "h.com", "", "h.com")
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_branches_merge_by_make_and_labels_by_brute_force(spark):
    """Sections of one make pool their labels; a section of another make, or with other labels, stays apart."""
    rows = [(s, f"http://h.com/{s}/{i}") for s in ("en", "fr", "ok") for i in range(40)] + [("p", f"http://h.com/p/{i}/edit") for i in range(40)] + [("login", "http://h.com/login")]
    deep = [("d", f"http://h.com/a/b/c/d/e/f/g/{x}") for x in ("one", "two/three")]
    pages = spark.createDataFrame([(k, u) for k, (_, u) in enumerate(rows + deep)] * 2, "page_id long, url string")
    rules = [urls.Rule("com", f"/en/{i}", "block") for i in range(1, 10)] + [urls.Rule("com", f"/ok/{i}", "allow") for i in range(1, 10)]
    got = urls.judge(pages, rules).collect()
    assert len(got) == 2 * len(rows + deep)
    said = {}
    for r in got:
        if r.rule is None:
            said.setdefault((rows + deep)[r.page_id][0], set()).add((r.pattern, r.verdict))
    assert said["en"] == said["fr"] == {("/(en|fr)/{n}", "block")} and said["ok"] == {("/ok/{n}", "allow")}
    assert said["p"] == {("/p/{n}/edit", "allow")} and said["login"] == {("/login", "allow")} and len(said["d"]) == 1


def plain_verdicts(rows, rules):
    """{row number: (host, path, rule, verdict, pattern)} by the definitions, in plain loops over every url."""
    out, counts = {}, {}
    for k, url in rows:
        m = regex.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.name), r.name), default=None)
        parts = [regex.sub("[0-9]+", "{n}", regex.sub(r"(?i)\b(?=[0-9a-f]*[0-9])[0-9a-f]{8,}(?:-[0-9a-f]+)*\b", "{x}", x)) for x in path[1:].split("/")]
        template = tuple(parts if len(parts) <= urls.DEPTH else [*parts[: urls.DEPTH - 1], "/".join(parts[urls.DEPTH - 1 :])])
        out[k] = [host, path, best and best.name, best and best.verdict, template]
        n = counts.setdefault((host, template), [0, 0, 0])
        n[0] += 1
        n[1] += best is not None
        n[2] += best is not None and best.verdict == "block"
    node = {key: () for key in counts}
    for level in range(urls.DEPTH):
        children = {}
        for host, template in counts:
            if len(template) > level:
                children.setdefault((host, node[host, template]), set()).add(template[level])
        for host, template in counts:
            if len(template) > level:
                here, wide = template[level], len(children[host, node[host, template]]) > urls.MAX_CHILDREN
                ending = regex.search(r"(\.[A-Za-z]{1,5})$", here)
                node[host, template] = (*node[host, template], here if not wide or here == "" else "*" + (ending[1] if ending else ""))
        node = dict(sorted(node.items(), key=lambda kv: kv[0]))
    leaves = {}
    for key, at in node.items():
        leaves.setdefault((key[0], at), [0, 0, 0])
        leaves[key[0], at] = [a + b for a, b in zip(leaves[key[0], at], counts[key])]
    pattern = {key: key[1] for key in leaves}
    for level in range(urls.DEPTH - 1, -1, -1):
        groups = {}
        for (host, at), (n, l, b) in leaves.items():
            if len(at) > level:
                child = groups.setdefault((host, at[:level]), {}).setdefault(at[level], [0, 0, {}])
                below = pattern[host, at][level + 1 : level + 3]
                child[0], child[1], child[2][below] = child[0] + l, child[1] + b, child[2].get(below, 0) + n
        into = {parent: urls.merged([(name, *c) for name, c in kids.items()]) for parent, kids in groups.items()}
        for host, at in leaves:
            if len(at) > level:
                p = pattern[host, at]
                pattern[host, at] = (*p[:level], into[host, at[:level]][at[level]], *p[level + 1 :])
    pooled = {}
    for key, (_, l, b) in leaves.items():
        x = pooled.setdefault((key[0], pattern[key]), [0, 0])
        x[0], x[1] = x[0] + l, x[1] + b
    prior = (sum(c[2] for c in counts.values()) + 1) / (sum(c[1] for c in counts.values()) + 2)
    for row in out.values():
        key = (row[0], pattern[row[0], node[row[0], row[4]]])
        l, b = pooled[key]
        learned = "block" if l >= urls.LEAST_LABELS and (b + urls.PRIOR_WEIGHT * prior) / (l + urls.PRIOR_WEIGHT) >= urls.REJECT_AT else "allow"
        row[3:] = [row[3] or learned, "/" + "/".join(key[1])]
    return {k: tuple(r) for k, r in out.items()}


def test_urls_by_brute_force(spark):
    rng = random.Random(22)
    word = lambda: rng.choice(["en", "fr", "news", "a1b2c3d4e5", "", str(rng.randint(1, 999)), f"t{rng.choice('abcdefghijklmnopqrst')}.html", "Über"])
    hosts = ["Example.com", "www.example.com", "example.net", "x.y.example.net:80", "notexample.com", "org"]
    rows = [(i, f"{rng.choice(['http', 'ftp', ''])}://{rng.choice(hosts)}" + "".join("/" + word() for _ in range(rng.randint(0, 4))) + rng.choice(["", "?q=/en/", "#x", "/"])) for i in range(500)]
    rows += [(900, None), (901, ""), (902, "no scheme/en"), (903, "://"), (904, "http://h?x://y/z"), (905, "a\nb://example.com/en/7")]
    rules = [*queries.RULES, urls.Rule("example.com", "/news", "block"), urls.Rule("com", "/t", "block")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    wanted = plain_verdicts(rows, rules)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict, r.pattern) for r in got} == wanted
    assert {"block", "allow"} == {v[3] for v in wanted.values() if v[2] is None}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abc"), st.integers(1, 60)), st.dictionaries(st.sampled_from("abc"), st.integers(1, 60)))
def test_alike_is_symmetric_and_equal_counts_are_alike(a, b):
    assert urls.alike(a, b) == urls.alike(b, a) and urls.alike(a, a) and urls.alike(a, {k: 7 * n for k, n in a.items()})


def test_many_children_become_a_wildcard(spark):
    rows = [(i, f"http://h.com/post/{chr(97 + i % 26)}{chr(97 + i // 26)}title.html") for i in range(60)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), []).collect()
    assert {r.pattern for r in got} == {"/post/*.html"} and {r.verdict for r in got} == {"allow"}


def test_quotes_link_to_their_authors(spark):
    rows = [(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "On Monday X wrote:\n> how ARE you\nFine."), (1, 2, "user", "> > How are you?\n> Fine.\nGood."), (1, 3, "user", "> never said\nWhat?"), (1, 3, "user", "> never said\nWhat?"), (2, 1, "user", "> Hello there."), (None, 1, None, None), (3, None, "user", "x")]
    conv = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.turn): (r.text, r.quote_levels, r.parent_turn, r.root_turn, r.depth) for r in quotes.link_quotes(conv).collect()}
    assert got[1, 1] == ("Fine.", 1, 0, 0, 1) and got[1, 2] == ("Good.", 2, 1, 0, 2) and got[1, 3] == ("What?", 1, None, 3, 0) and got[2, 1] == ("", 1, None, 1, 0)
    assert quotes.link_quotes(conv).count() == len(rows) and quotes.link_quotes(conv.limit(0)).count() == 0


def test_quotes_rewrapped_in_part_and_of_repeated_lines(spark):
    rows = [(1, 0, "OK"), (1, 1, "one two three\nfour five six\nseven eight nine"), (1, 2, "> one two\n> three four five\n> six seven\nrewrapped"), (1, 3, "> four, FIVE\npart of a line"), (1, 5, "OK"), (1, 6, "> OK\nlatest"),
            (1, 7, "five of my own"), (1, 8, "> On Monday X wrote:\n> two three\n> [...]\n> eight nine\nelided"), (1, 9, "> seven eight nine\n> and never said\none line of it"), (1, 5000, "> OK\nfar later"), (2, 0, "OK"), (2, 1, "> > OK\n> never said")]
    conv = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth) for r in quotes.link_quotes(conv).collect()}
    assert {k: v[0] for k, v in got.items() if v[0] is not None} == {(1, 2): 1, (1, 3): 1, (1, 6): 5, (1, 8): 1, (1, 9): 1, (1, 5000): 5, (2, 1): 0}
    assert got[1, 6] == (5, 5, 1) and got[1, 5000] == (5, 5, 1)


def test_own_lines_are_not_lost(spark):
    rows = [(1, 0, "user", "My teacher said:\nlisten.\n    indented code\nend"), (1, 1, "assistant", "She wrote:\n> listen.\nYes <|end|> and <\\|x"), (None, None, "user", "> a quote\nShe wrote:"), (1, None, None, "x wrote:\n\n> y"), (2, 0, "a<|b", "\r\nline\r\n")]
    conv = spark.createDataFrame(rows * 2, "conv_id long, turn long, role string, text string")
    got = quotes.link_quotes(conv).collect()
    assert len(got) == 2 * len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 0].text == rows[0][3] and by[1, 1].text == "Yes <|end|> and <\\|x" and by[1, 1].parent_turn == 0
    assert by[None, None].text == "She wrote:" and by[1, None].text == "" and by[1, None].parent_turn is None
    assert by[1, 1].formatted == "<|assistant|>\nYes <\\|end|> and <\\\\|x\n<|end|>\n" and by[2, 0].formatted == "<|a<\\|b|>\nline\n<|end|>\n"
    assert regex.sub(r"<\\(\\*)\|", r"<\1|", by[1, 1].formatted[len("<|assistant|>\n") : -len("\n<|end|>\n")]) == by[1, 1].text


def plain_links(conversation):
    """{turn: (text, parent, root, depth)} of one conversation by definition, in plain loops."""
    word = lambda s: regex.findall(r"[\p{L}\p{N}]+", s.lower())
    own, quoted = {}, {}
    for turn, text in conversation:
        lines = []
        for raw in text.split("\n"):
            m = regex.match(r"[ \t]*((?:>[ \t]?)*)(.*)", raw)
            lines.append((m[1].count(">"), m[2].strip(" "), raw))
        keep, runs = [], []
        for i, (level, line, raw) in enumerate(lines):
            rest = lines[i + 1 : i + 3]
            follows = bool(rest) and (rest[0][0] > level or rest[0][1] == "" and rest[0][0] <= level and len(rest) > 1 and rest[1][0] > level)
            if follows and regex.fullmatch(r"(?:On .* wrote|.* (?:wrote|said)) ?:", line):
                continue
            if level == 0:
                keep.append(raw)
            level = 0 if regex.fullmatch(r"\[?\.{3}\]?", line) else level
            if runs and runs[-1][0] == level:
                runs[-1][1].append(line)
            else:
                runs.append((level, [line]))
        own[turn] = regex.sub(r"^(?:[ \t]*\n)+|\s+$", "", "\n".join(keep))
        quoted[turn] = [r for level, r in runs if level]
    holds = lambda t, ws: any(word(own[t])[i : i + len(ws)] == ws for i in range(len(word(own[t])) - len(ws) + 1))
    parent = {}
    for turn, runs in quoted.items():
        found = []
        for run in runs:
            options = [(True, word(" ".join(run)))] + [(False, word(x)) for x in run]
            met = [(whole, len(ws), max(earlier)) for whole, ws in options if ws and (earlier := [t for t in own if t < turn and holds(t, ws)])]
            found += [max(met)[2]] if met else []
        if found:
            parent[turn] = max(found)
    out = {}
    for turn in own:
        root, depth = turn, 0
        while root in parent:
            root, depth = parent[root], depth + 1
        out[turn] = (own[turn], parent.get(turn), root, depth)
    return out


def test_quotes_by_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for conv in range(40):
        texts = []
        for turn in range(rng.randint(2, 9)):
            fresh = ["\n".join(" ".join(rng.choices("one two three Four five, six. Ünd".split(), k=rng.randint(1, 5))) for _ in range(rng.randint(1, 3)))]
            if texts and rng.random() < 0.8:
                body = regex.sub(r"\s+", " ", rng.choice(texts)) if rng.random() < 0.5 else rng.choice(texts)
                ws = body.split(" ")
                if rng.random() < 0.4 and "\n" not in body:
                    cut = sorted(rng.sample(range(len(ws) + 1), 2)) if len(ws) > 1 else [0, len(ws)]
                    body = "\n".join(" ".join(ws[k : k + 3]) for k in range(cut[0], cut[1], 3))
                fresh = rng.choice([["He said:"], ["He wrote:", ""], []]) + ["> " + x for x in body.split("\n")] + (["> ..."] if rng.random() < 0.2 else []) + fresh
            texts.append("\n".join(fresh))
        rows += [(conv, turn, "user", t) for turn, t in enumerate(texts)]
    odd = [(None, 1, "user", "> one"), (1, None, None, "> two\r\nx"), (50, 0, "user", "said\n\n"), (50, 1, "a<|b", "> said\n<\\|z"), (50, 1, "user", "no quote"), (50, 2, None, None)]
    schema = "conv_id long, turn long, role string, text string"
    frame = quotes.link_quotes(spark.createDataFrame(rows + odd, schema))
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows + odd)
    found = con.execute(queries.ORACLES["op3_chat_quotes"])
    names = [c[0] for c in found.description]
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in frame.select(*names).collect()) and sorted(names) == sorted(frame.columns)
    got = {(r.conv_id, r.turn): (r.text, r.parent_turn, r.root_turn, r.depth) for r in quotes.link_quotes(spark.createDataFrame(rows, schema)).collect()}
    wanted = {(conv, turn): x for conv in range(40) for turn, x in plain_links([(t, s) for c, t, _, s in rows if c == conv]).items()}
    assert got == wanted and sum(x[1] is not None for x in wanted.values()) > 50 and max(x[3] for x in wanted.values()) > 2


def test_latest_authors_by_brute_force(spark):
    rng = random.Random(11)
    draw = lambda n: sorted({(rng.randint(0, 1), rng.randint(0, 4000), rng.randint(0, 3)) for _ in range(n)})
    quoted, authors = draw(300), draw(40)
    schema = "conv_id long, turn long, hash long"
    got = quotes.latest_authors(spark.createDataFrame(quoted, schema), spark.createDataFrame(authors, schema)).collect()
    assert sorted((r.conv_id, r.turn, r.hash, r.author) for r in got) == [(c, t, h, max((u for d, u, g in authors if (d, g) == (c, h) and u < t), default=None)) for c, t, h in quoted]


def test_shards_fit_and_equal_the_sql(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(400)] + [(1, "y" * 300)] * 5 + [(None, "n"), (500, None)]
    docs = clashing(docs_of(spark, rows))
    got = sharding.assign(docs, 1000).collect()
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
    assert all(r.shard_bytes == size[r.shard] and r.oversized == (size[r.shard] > 1000) for r in got)
    bits = {r.doc_id: r.shard for r in got}
    assert all(bin(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16))[2:].zfill(60).startswith(bits[i]) for i, _ in rows if i is not None)
    frame = docs.select("doc_id", "text").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("f", frame)
    con.execute("create table documents as select * from f")
    sql = queries.ORACLES["op10_sharding"].replace(str(sharding.SHARD_BYTES), "1000")
    key = lambda r: tuple(map(str, r))
    expected = sorted(map(key, con.execute(sql).fetchall()))
    assert expected == sorted(key((r.doc_id, r.shard, r.depth, r.n_bytes, r.shard_bytes, r.oversized)) for r in got)
    assert sharding.assign(docs.limit(0), 1000).count() == 0


def test_written_shards(spark, tmp_path):
    docs = docs_of(spark, [(i, "x" * 50) for i in range(40)] + [(None, None), (3, "again")])
    sharding.write_shards(docs, str(tmp_path / "out"), 500)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((str(r.doc_id), r.text or "") for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    shard = {r.doc_id: "s" + r.shard for r in sharding.assign(docs, 500).collect()}
    assert all(shard[r.doc_id] == r.shard for r in back.collect()) and len(set(shard.values())) > 3


def test_pipeline_by_brute_force(spark, tmp_path):
    """run() over a planted corpus, against each stage's decision made plainly on what the stage before kept."""
    import corpus_pipeline as p
    import tiktoken

    rng = random.Random(16)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(3, 8))) for _ in range(3000)]
    clean = lambda n=90: rng.choices(vocabulary, k=n)
    toxic = lambda: clean(40) + rng.choices(["zorkling", "zorkled", "quuxish", "vexfoul"], k=12) + clean(40)
    junk = lambda: [rng.choice(["###", "%%%", "$$"]) if rng.random() < 0.5 else w for w in clean()]
    items = [clean(30) for _ in range(8)]
    kinds = {"clean": [clean() for _ in range(300)], "toxic": [toxic() for _ in range(80)], "junk": [junk() for _ in range(80)], "leak": [clean(60) + items[i % 8] + clean(60) for i in range(30)], "short": [clean(10) for _ in range(20)]}
    texts = [(kind, " ".join(ws)) for kind, many in kinds.items() for ws in many]
    rng.shuffle(texts)
    rows = [(i, t) for i, (_, t) in enumerate(texts)]
    copies = [t for k, t in texts if k == "clean"][:60]
    rows += [(2000 + i, t) for i, t in enumerate(copies)] + [(3000 + i, t + " and more") for i, t in enumerate(copies)] + [(2000, copies[0]), (None, copies[1]), (None, None), (4000, ""), (4001, "word " * 60)]
    kind_of = dict(enumerate(k for k, _ in texts))
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(k not in ("junk", "short")), int(k == "toxic")) for i, k in kind_of.items() if i % 4 != 3], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    got = p.run(spark, d).collect()

    labels = spark.read.parquet(f"{d}/labels.parquet")
    left = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    model = toxicity.fit(docs_of(spark, left), labels)
    left = [(i, t) for i, t in left if model.probability(model.evidence(t or "")) < toxicity.PREDICT_AT]
    assert not any(kind_of.get(i) == "toxic" for i, _ in left) and sum(kind_of.get(i) == "clean" for i, _ in left) == 300
    rated = quality.fit(docs_of(spark, left), labels)

    def good(text):
        words, ids, *_, repeats = quality.text_counts(text or "")
        return len(ids) >= 50 and 100 * repeats <= 50 * len(ids) and rated.probability(text, words, ids) >= quality.KEEP_AT

    left = [(i, t) for i, t in left if good(t)]
    assert not any(kind_of.get(i) in ("junk", "short") for i, _ in left) and sum(kind_of.get(i) == "clean" for i, _ in left) == 300
    prints, group = [simhash.fingerprint(t) for _, t in left], list(range(len(left)))
    changed = True
    while changed:
        changed = False
        for a in range(len(left)):
            for b in range(a):
                if group[a] != group[b] and bin((prints[a] ^ prints[b]) % (1 << 64)).count("1") <= simhash.DISTANCE:
                    old, new = max(group[a], group[b]), min(group[a], group[b])
                    group, changed = [new if g == old else g for g in group], True
    first = {}
    for g, (i, t) in zip(group, left):
        key = (i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), t)
        first[g] = min(first.get(g, key), key)
    left = [(None if none else i, t) for none, i, _, t in first.values()]
    assert len(left) < len(group) - 60
    index = [decontam.words(" ".join(ws)) for ws in items]

    def leaked(text):
        ws = decontam.words(text)
        number = {w: k + 1 for k, w in enumerate(sorted({w for item in index for w in item}))}
        window = np.array([number.get(w, 0) for w in ws], np.int64)
        return any(decontam.align(np.array([number[w] for w in item]), window)[0] >= decontam.least_score(len(item), len(ws)) for item in index)

    left = [(i, t) for i, t in left if not leaked(t)]
    assert not any(kind_of.get(i) == "leak" for i, _ in left)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(queries.RANKS)), special_tokens={})
    wanted = [(str(i), len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in left for ids in [library.encode_ordinary(t)]]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(wanted)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    docs_of(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = start = p.table(spark, d, "documents").cache()
    for i, (name, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, d).cache()
        if i < len(p.STAGES) - 1:
            assert docs.columns == start.columns, name
        assert 0 < docs.count() <= start.count()
    assert docs.select("doc_id").distinct().count() == docs.count()
