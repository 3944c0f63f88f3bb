"""Operators against brute force, and on nulls, empty texts, ties and repeated rows."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html, jaccard, licenses, pieces, secrets, topk, toxicity, url_filter, warc

LONG = " ".join(f"w{i}" for i in range(300))


def test_topk_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(300)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8)]
    rows += [(i, [1.0] * 8) for i in range(400, 420)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.filter("vec_id % 50 = 0")).collect()
    good = {i: np.floor(256 * np.array(v)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:5]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want


def test_url_filter(spark):
    urls = ["http://A.example.com/en/71?x", "https://x.net/de/1", "http://example.net/de/8#a", "http://ex.org/es/", "no scheme", None, "", "http://spam-farm.example.org/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[1][2:] == ("net/de/", "block") and got[2][2:] == ("example.net/de/8", "allow") and got[3][2:] == ("org/es/", "block")
    assert got[4] == got[5] == got[6] == ("", "", None, "allow") and got[7][3] == "block"


def test_secrets_against_python(spark):
    texts = ['é password = "abc123" Token:xyz api-key=1', "AKIA" + "A" * 16 + " AKIAB", "f" * 30 + "g" + "0" * 23, None, "", "token=" + "a1" * 20]
    df = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    kinds = [("assign", re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    for r in secrets.report(df).collect():
        t = texts[r.doc_id] or ""
        spans = sorted((m.start(), n, m.end(), k) for n, (k, rx, g, least) in enumerate(kinds) for m in rx.finditer(t) if len(m[g]) >= least)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()


def test_jaccard_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = [f"x{i}" for i in range(120)]
    texts = [None, "", " \t", "a b", "A b", "a", LONG, LONG]
    for _ in range(30):
        w = list(base)
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(0, len(w))] = "new"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(3, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        for a, b in itertools.combinations(range(len(texts)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_join(df).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_jaccard_of_nothing(spark):
    assert jaccard.similar_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_decontaminate_finds_edited_items():
    item = " ".join(f"q{i}" for i in range(40))
    index = decontaminate.Index([(1, item), (2, "other words " * 10)])
    changed = item.replace("q5 ", "zz ").replace("q20 ", "").replace("q30 ", "q30 yy ")
    assert index.scan(LONG + " " + changed + " " + LONG)[0][:2] == (1, 3)
    assert index.scan(LONG) == [] and index.scan(None) == [] and index.scan("") == []


@pytest.mark.parametrize("text", ["", "a", " a  b ", "straße 日本\n\tx", LONG])
def test_pieces_round_trip_and_best_score(text):
    codec = pieces.Codec(pieces.model_path())
    ids = codec.encode(text)
    assert codec.decode(ids) == text
    marked = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
    assert ids == codec.viterbi(marked)


def test_html_keeps_the_article_only():
    page = "<html><head><title>t</title></head><body><nav><a>menu</a></nav><header>head</header><div class='sidebar'>side</div><article><h1>Head &amp; line</h1><p>One  two.<p>Three, four.</article><div id='comments'><p>reader</p></div><footer>foot</footer></body></html>"
    assert html.extract(page) == "Head & line\n\nOne two.\n\nThree, four."
    assert html.extract(None) == "" and html.extract("") == ""


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é " + "x" * 200
    rows = [(3, "http://a.b/c", big), (1, None, big), (2, "u", None), (4, "u", "same"), (5, "u", "same"), (6, "http://a.b/c", "a\r\n\r\nb" + "y" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive(df, tmp_path.as_uri()).collect()}
    assert len(got) == 6 and all(r.sound for r in got.values())
    assert got[3].record_type == "revisit" and got[3].refers_to == 1 and got[5].record_type == "response"
    assert got[6].payload_digest == hashlib.sha256(rows[5][2].encode()).hexdigest()
    blocks = {b.block_id: bytes(b.block) for b in spark.read.parquet(tmp_path.as_uri() + "/index").collect()}
    directory = warc.Directory.load(tmp_path.as_uri() + "/directory")
    hits = [h for b in directory.blocks("b,a)/c") for h in warc.search(blocks[b], "b,a)/c")]
    assert len(hits) == 2 and directory.blocks("zz,none)/") == []


def test_warc_without_or_with_repeated_ids(spark, tmp_path):
    big = "y" * 150
    rows = [(None, "http://a.b/", big), (5, "http://a.b/", big), (5, "http://a.b/", big), (7, "u\tv", big), (None, None, None), (8, None, "z" * 120), (None, "q", "n" * 101), (None, "q", "n" * 101)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.archive(df, tmp_path.as_uri()).collect())
    assert got == [(0, "response", 0)] * 3 + [(0, "revisit", 5), (5, "response", 0), (5, "revisit", 5), (7, "revisit", 5), (8, "response", 0)]
    empty = tmp_path.as_uri() + "-empty"
    assert warc.archive(df.limit(0), empty).collect() == []


def test_licences():
    index = licenses.Index(licenses.TEMPLATES)
    assert set(index.scan("so it is.\nReleased under the MIT License.\n")) == {"MIT"}
    assert index.scan(None) == {} and index.scan("the license") == {}


def test_toxicity_learns_gapped_words(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("aetnos"), rng.integers(2, 7)))
    docs = [(i, " ".join([word() for _ in range(20)] + (["grumblor"] if i % 3 == 0 else []))) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = d.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    m = toxicity.fit(d, lab)
    s = m.score(["ante grumblor", "g-r-u-m-b-l-o-r", "grumxblor", "ante tone", "", None])
    assert (s[:3] >= 0.5).all() and (s[3:] < 0.5).all()


def test_html_paths_decide_without_an_article():
    more = "Long text, with words. " * 20
    page = f"<body><div><h1>Head</h1><p>{more}<ul><li>one</li></ul><p>{more}</div><div><a href=x>all linked</a></div><article class='comment-body'><p>I like, it. {more}</article></body>"
    assert html.extract(page) == "\n\n".join(["Head", more.strip(), "one", more.strip()])
    assert html.extract("<div><b>x" * 4000).count("x") == 4000  # unclosed marks, in time in proportion


def test_html_on_spark(spark):
    rows = [(None, "u", "<p>a, b."), (2, None, None), (2, None, ""), (9007199254740993, "x", "<script>1</script>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in html.extract_pages(df).collect())
    assert got == [(0, "u", "a, b.", 5), (2, None, "", 0), (2, None, "", 0), (9007199254740993, "x", "", 0)]
    assert html.extract_pages(df.limit(0)).collect() == []


def clashing(spark, rows):
    names = ["score", "ids", "n_ids", "found", "slice", "component_id", "hash", "owner", "_t"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({n: F.lit("x") for n in names})


ROWS = [(None, None, None, None), (1, "", "en", "a"), (2, "token=abcdef", "en", "a"), (2, "token=abcdef", "en", "a"), (9007199254740993, "a b c " * 4000, None, "b"), (4, "c" * 5000, "en", None)]


def test_every_operator_takes_nulls_repeats_clashes_and_nothing(spark):
    docs = clashing(spark, ROWS)
    items = spark.createDataFrame([(1, "a b c a b c"), (2, None), (3, "")], "item_id long, text string")
    machine = toxicity.train([["badword"]] * 3, [["good", "fine"]] * 3)
    runs = [
        lambda d: toxicity.score(d, machine, ["doc_id"]), lambda d: pieces.encode(d, keep=d.columns), licenses.scan, lambda d: decontaminate.leaks(d, items),
        secrets.report, secrets.redact, jaccard.similar_join,
    ]
    for run in runs:
        got = run(docs)
        ids = {r.doc_id for r in got.collect()}
        assert ids <= {None, 1, 2, 4, 9007199254740993}
        assert run(docs.limit(0)).count() == 0
    assert {r.doc_id for r in pieces.encode(docs).filter("round_trip").collect()} == {None, 1, 2, 4, 9007199254740993}
    assert [r.n_live for r in secrets.report(docs).filter("doc_id = 2").collect()] == [1, 1]
    assert secrets.redact(docs).columns == docs.columns and secrets.redact(docs).filter("text = 'token=[SECRET]'").count() == 2


def test_pieces_search_is_the_full_search():
    codec = pieces.Codec(pieces.model_path())
    rng = np.random.default_rng(8)

    def full(text):  # best score over all segmentations, by the definition
        best = [0.0] + [-1e18] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - codec.longest), end):
                hit = codec.ids.get(text[start:end])
                best[end] = max(best[end], best[start] + hit[1] if hit else -1e18)
            if best[end] < -1e17:
                best[end] = best[end - 1] - pieces.BYTE_PENALTY
        return best[-1]

    gain = {i: s for i, s in codec.ids.values()}
    for _ in range(300):
        text = "".join(rng.choice(["a", "th", "e", " ", "\n", "tion", "x", "==", "ing "], rng.integers(1, 40)))
        marked = (pieces.MARK + text.replace(" ", pieces.MARK))
        ids = codec.encode(text)
        feeds = sum(i not in gain for i in ids)
        assert codec.decode(ids) == text
        assert abs(sum(gain.get(i, 0.0) for i in ids) - feeds * pieces.BYTE_PENALTY - full(marked)) < 1e-3
    long = "a" * 20_000
    assert codec.decode(codec.encode(long)) == long


def test_decontaminate_recall_at_the_limit():
    rng = np.random.default_rng(9)
    vocabulary = ["".join(rng.choice(list("aeioustrnl"), rng.integers(3, 9))) for _ in range(1500)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(15, 60)))) for i in range(100)]
    index, filler, words, letters = decontaminate.Index(items), " ".join(rng.choice(vocabulary, 80)), 0, 0
    for i, text in items:
        w = text.split()
        edited = list(w)
        for p in rng.choice(len(w), int(0.2 * len(w)), replace=False):
            edited[p] = ["zzzz", "", w[p] + " qqqq"][rng.integers(3)]
        spelt = [x[:-1] + "q" if k % 4 == 0 and len(x) > 4 else x for k, x in enumerate(w)]
        words += any(f[0] == i for f in index.scan(f"{filler} {' '.join(edited)} {filler}"))
        letters += any(f[0] == i for f in index.scan(f"{filler} {' '.join(spelt)} {filler}"))
    assert words >= 95 and letters >= 90
    assert index.scan(filler) == []
