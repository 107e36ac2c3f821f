"""Operators against brute force, libraries and exact round trips, with nulls, empties, repeats and empty tables."""

import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import byte_bpe, common, decontamination, graph_search, html_extraction, jaccard_join, language_id, substring_dedup, token_counts, toxicity, url_reputation

DOCS = "doc_id long, text string"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    out = [None, "", "  \n", "One", "one two", "ONE two", "héllo wörld 日本 12½  x\t\n y", "a" * 700, "<s> ▁ \n\n end  "]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return list(enumerate(out))


def shingle_sets(texts):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_components(texts):
    sets = shingle_sets(texts)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def jaccard_rows(spark, texts):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(texts, DOCS)).collect()}


def test_jaccard_join(spark, texts):
    assert jaccard_rows(spark, texts) == brute_components(texts)


@pytest.mark.parametrize("slice_size", [7, jaccard_join.SLICE])
def test_jaccard_join_of_many_texts_that_share_their_rarest_passage(spark, monkeypatch, slice_size):
    """The passage's shingles are hot keys, so links between components can only come from the second round."""
    monkeypatch.setattr(jaccard_join, "SLICE", slice_size)
    rng = random.Random(8)
    passage = [f"rare{i}" for i in range(24)]
    rows = []
    for _ in range(40):
        filler = [rng.choice("abcdef") for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(1, 4)):
            copy = list(filler)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice("abcdef")
            rows.append(" ".join(passage + copy[: len(copy) - rng.randint(0, 2)]))
    texts = list(enumerate(rows))
    expected = brute_components(texts)
    assert len({c for _, c in expected.values()}) > 5
    assert jaccard_rows(spark, texts) == expected


def brute_links(texts):
    """Distinct sets that each text's set links with."""
    sets = {i: frozenset(s) for i, s in shingle_sets(texts).items()}
    distinct = set(sets.values())
    return {i: sum(1 for o in distinct if s and o and o != s and 100 * len(s & o) >= 75 * len(s | o)) for i, s in sets.items()}


@pytest.mark.parametrize("meet_sets", [11, jaccard_join.MEET_SETS])
def test_jaccard_join_counts_all_links_of_large_groups(spark, monkeypatch, texts, meet_sets):
    """Groups of more than FEW near copies, whose keys are hot, besides small ones; copies and a repeated id."""
    monkeypatch.setattr(jaccard_join, "MEET_SETS", meet_sets)
    rng = random.Random(21)
    rows = [t for _, t in texts]
    for size in (17, 60):
        base = [f"{rng.choice('pqrst')}{rng.randrange(900)}" for _ in range(80)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(9000)}"
            rows.append(" ".join(copy))
    rows += rows[-5:]
    many = list(enumerate(rows))
    got = {r.doc_id: r.n_links for r in jaccard_join.jaccard_components(spark.createDataFrame([*many, many[-1]], DOCS)).collect()}
    expected = brute_links(many)
    assert max(expected.values()) > jaccard_join.FEW
    assert got == expected


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_connected_components(spark):
    """A chain, a hub, a repeated edge, an edge to itself and null ends."""
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 130)] + [(100, 101), (7, 7), (500, 500), (None, 3), (3, None)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 130), 100)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_byte_bpe(spark, texts):
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.RANKS)), special_tokens={})
    got = {r.doc_id: (np.frombuffer(r.tokens, "<u4").tolist(), bytes(r.decoded).decode()) for r in byte_bpe.decode(byte_bpe.encode(spark.createDataFrame(texts, DOCS))).collect()}
    assert got == {i: (library.encode_ordinary(t or ""), t or "") for i, t in texts}
    odd = spark.createDataFrame([(None, "of a null id"), (7, "twice"), (7, "twice")], DOCS)
    rows = byte_bpe.encode(odd, decoded=True).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in rows) == [(0, "of a null id"), (7, "twice"), (7, "twice")]
    assert sorted(r.doc_id is None for r in rows) == [False, False, True]
    assert byte_bpe.encode(spark.createDataFrame([], DOCS), decoded=True).count() == 0


def test_token_counts(spark, texts):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(spark.createDataFrame(texts, DOCS)).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in texts}


def test_decontamination(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([("b1", passage), ("b2", "short one"), ("b3", None), ("b4", "...")], "item_id string, text string")
    docs = [(1, f"X {passage.upper()}! tail"), (2, "a short, one here short one"), (3, None), (4, ""), (5, f"{passage} short one"), (6, "alpha beta gamma")]
    got = {r.doc_id: (r.n_words, list(r.hit), list(r["items"])) for r in decontamination.hits(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert got == {1: (12, list(range(1, 11)), ["b1"]), 2: (6, [1, 2, 4, 5], ["b2"]), 3: (0, [], []), 4: (0, [], []), 5: (12, list(range(12)), ["b1", "b2"]), 6: (3, [], [])}
    left = {r.doc_id: r.text for r in decontamination.decontaminate(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert left == {1: "X! tail", 2: "a here", 3: None, 4: "", 6: "alpha beta gamma"}
    assert {r.n_words for r in decontamination.hits(spark.createDataFrame(docs, DOCS), bench.limit(0)).collect()} == {12, 6, 0, 3}


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/x?q", "http://a.example.com/en/", "https://b.net/fr/1#t", "http://c.com", None, "nothing", "http://d.org/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = spark.createDataFrame([(6, 1)], "page_id long, bad int")
    got = {r.page_id: tuple(r)[1:] for r in url_reputation.judge(pages, bad).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[1][2:] == ("example.com/en/", "block") and got[2][2:] == ("net/fr/", "block")
    assert got[3][:3] == ("c.com", "", None) and got[4][:3] == got[5][:3] == ("", "", None)


def test_reputation_blocks_only_what_is_surely_bad(spark):
    rows = [("bad.org", 1)] * 40 + [("good.org", 0)] * 40 + [("new.org", None)]
    got = {r.host: r.blocked for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got == {"bad.org": True, "good.org": False, "new.org": False}


def test_registered_domains(spark):
    hosts = ["a.b.example.co.uk", "example.co.uk", "co.uk", "x.y.com", "y.com", "com", "", "a.b.io"]
    domain, suffix = url_reputation.domain_of(F.col("h"))
    got = [tuple(r) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(domain, suffix).collect()]
    assert got == [("example.co.uk", "co.uk"), ("example.co.uk", "co.uk"), ("co.uk", "uk"), ("y.com", "com"), ("y.com", "com"), ("com", "com"), ("", ""), ("b.io", "io")]


def test_url_query_blocks_by_reputation_as_its_sql_does(spark, tmp_path):
    """A host of bad outcomes, a hot good one, repeated and null pages; the registered query against its SQL, and empty tables."""
    import duckdb

    from annalist.llm import oracle, queries

    urls = ["http://bad.org/a"] * 30 + ["http://good.org/b"] * 300 + ["https://a.b.co.uk/", "http://x.net/es/1", None, "nothing"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    labels = [(i, 0 if i < 28 else 1, 0) for i in range(60)] + [(400, 0, 1), (None, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(tuple(r) for r in queries.op3_url_filters(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect())
    with duckdb.connect() as db:
        for t in ("pages", "labels"):
            db.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        assert got == sorted(db.execute(oracle.URLS).fetchall())
    assert {r[1] for r in got if r[4] == "block"} == {"bad.org", "x.net"}
    pages = spark.createDataFrame([(1, "http://d.org/", "u"), (1, "http://d.org/", "v"), (None, None, None)], "page_id long, url string, salt string")
    none = spark.createDataFrame([], "page_id long, bad int")
    assert sorted(r.verdict for r in url_reputation.judge(pages, none).collect()) == ["allow"] * 3
    assert url_reputation.judge(pages.limit(0), none).count() == 0


def test_html():
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>Head</h1><p><b>One &amp; two.<br><p>Three  \n four.</article><footer>f</footer></body>'
    assert html_extraction.extract(page) == "Head\n\nOne & two.\n\nThree four."
    assert html_extraction.extract(None) == html_extraction.extract("") == ""
    assert html_extraction.extract("<article><p>cut off <a hre") == "cut off"


BODY = [f"Paragraph {i} tells of the harvest, of the long road to the sea and of what the old people said about it." for i in range(4)]
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(8)) + "</ul>"


@pytest.mark.parametrize("content", ["article", "main", 'div class="social-science"', 'div id="share-prices"', 'div class="sidebar"', "section", "td"])
def test_html_regions_are_chosen_by_the_clusters(content):
    """The same truth whether the region is an article, a plain group, or one whose name speaks against it."""
    tag = content.split()[0]
    wrap = ("<table><tr>", "</tr></table>") if tag == "td" else ("", "")
    page = f"<body><div>{MENU}</div><div class='ad-box'>Buy two and get one for nothing, today only.</div>{wrap[0]}<{content}><h1>Harvest</h1>" + "".join(f"<p>{b}</p>" for b in BODY) + f"<p>Short.</p><p>{BODY[0]}</p></{tag}>{wrap[1]}<div>{MENU}</div><div class='comments'><p>First!</p></div><footer>All rights</footer></body>"
    truth = ["Harvest", *BODY, "Short.", BODY[0]]
    assert html_extraction.extract(page) == "\n\n".join(truth)


def test_html_parts_inside_an_article():
    page = f"<article><header><h1>Head</h1></header><p>{BODY[0]}</p><div id='share-prices'><p>{BODY[1]}</p></div><div class='share-buttons'>Tell all</div><aside>Side</aside><p>{BODY[2]}</p><section id='comments'><p>I disagree.</p></section></article><div><p>{BODY[3]}</p></div>"
    assert html_extraction.extract(page) == "\n\n".join(["Head", *BODY[:3]])


def test_html_without_any_region():
    assert html_extraction.extract("just words") == "just words"
    assert html_extraction.extract("<nav>menu</nav>") == ""
    assert html_extraction.extract("<p>One</p><p>Two") == "One\n\nTwo"


def test_html_deep_pages_take_linear_time():
    import time

    start = time.time()
    assert html_extraction.extract("<article>" + "<b>" * 20000 + "deep" + "</i>" * 20000 + "<p>" * 2000 + "end") == "deep\n\nend"
    assert time.time() - start < 3


def test_html_table(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS __other")
    got = [tuple(r) for r in html_extraction.extract_pages(pages, keep=("url", "text", "__other")).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", 1, "a"), (1, "u", 1, "a"), (None, None, 1, ""), (2, "v", 1, "")], key=str)
    assert html_extraction.extract_pages(pages.limit(0)).count() == 0


def test_language_id(spark):
    rng = random.Random(3)
    make = lambda syl: " ".join("".join(rng.choice(syl) for _ in range(3)) for _ in range(80))
    rows = [(make(("ka", "to", "mi")), "aa") for _ in range(20)] + [(make(("sch", "ei", "ung")), "bb") for _ in range(20)]
    profiles = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    docs = [(1, make(("ka", "to", "mi"))), (2, make(("sch", "ei", "ung"))), (3, None), (4, "12 !")]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(docs, DOCS), profiles).collect()}
    assert got == {1: "aa", 2: "bb", 3: "und", 4: "und"}
    assert language_id.train(spark.createDataFrame([], "text string, lang string")) is None


def brute_phrases(text, sample):
    """Greedy parse: the longest match in the sample, plus the character that breaks it."""
    n = i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        i, n = j + 1, n + 1
    return n


@pytest.mark.parametrize("dense", [0, language_id.DENSE])
def test_language_phrases_run_across_lanes(monkeypatch, dense):
    monkeypatch.setattr(language_id, "LANE", 7)
    rng = random.Random(9)
    sample = {lang: "".join(rng.choice(letters) for _ in range(400)) for lang, letters in (("aa", "abc "), ("bb", "abd "), ("cc", "aé"))}
    profiles = language_id.Profiles(sample, dense)
    texts = [sample["aa"][3:200], sample["bb"][:7], "zzz", "a", *("".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 90))) for _ in range(60))]
    assert profiles.phrases(texts).tolist() == [[brute_phrases(t, sample[lang]) for lang in profiles.langs] for t in texts]


def test_language_id_of_many_characters_and_none(spark):
    """A script of 3,000 characters is told from another; numbers are no letters; repeated rows, null ids, a tie."""
    rng = random.Random(2)
    scripts = {"xx": [chr(0x4E00 + i) for i in range(3000)], "yy": [chr(0xAC00 + i) for i in range(3000)]}
    pairs = {k: [rng.choice(v) + rng.choice(v) for _ in range(1500)] for k, v in scripts.items()}
    make = lambda k: "".join(rng.choice(pairs[k]) for _ in range(150))
    rows = [(make(k), k) for k in scripts for _ in range(60)] + [(None, "xx"), ("a b", None), ("", "yy")]
    profiles = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame([(1, make("xx")), (2, make("yy")), (2, None), (None, "½ ²"), (4, "Ⅷ ① 7"), (5, "qq"), (5, "qq")], DOCS).selectExpr("*", "'zz' AS lang_pred", "1 AS score")
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language_id.identify(docs, profiles).collect())
    assert got == [(0, "und"), (1, "xx"), (2, "und"), (2, "yy"), (4, "und"), (5, "xx"), (5, "xx")]
    assert language_id.identify(docs.limit(0), profiles).count() == 0


def test_toxicity(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice("abcdefghijkl") * rng.randint(1, 3) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words[3:6] = ["vile" + rng.choice("abcdef") for _ in range(3)]
        docs.append((i, " ".join(words)))
        labels.append((i, i % 2, int(bad)))
    docs += [(1000, None), (1001, "")]
    table = spark.createDataFrame(docs, DOCS)
    chain = toxicity.train(table, toxicity.label_categories(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    got = {r.doc_id: r.toxic for r in toxicity.score(table, chain).collect()}
    assert got == {i: i % 4 == 0 for i in range(400)} | {1000: False, 1001: False}


def test_substring_dedup(spark):
    shared = "The first sentence has some words. The second one has others too! And so has the third, at length."
    docs = [(1, f"Start here. {shared} End."), (2, f"Other start. {shared} Other end."), (3, None), (4, ""), (5, "Nothing shared at all.")]
    got = {r.doc_id: (r.text, r.n_removed) for r in substring_dedup.clean(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("Other start. Other end.", 3), 3: (None, 0), 4: ("", 0), 5: (docs[4][1], 0)}
    for _, t in docs[:2]:
        assert "".join(substring_dedup.sentences(t)) == t


def test_substring_dedup_without_sentence_marks(spark):
    """Copies without marks, and passages of 50 words spliced in mid-sentence, of many and of few distinct words."""
    rng = random.Random(12)

    def prose(n, distinct, marks=0.0):
        return " ".join(f"w{rng.randrange(distinct)}" + (rng.choice(".,") if rng.random() < marks else "") for _ in range(n))

    copy = prose(60, 9000)
    docs = [(1, copy), (2, copy), (3, prose(60, 9000))]
    for i in range(60):
        passage = prose(50, rng.choice((300, 9000)), rng.choice((0, 0.1)))
        docs += [(i * 2 + j, f"{prose(rng.randint(1, 40), 9000)} {passage} {prose(rng.randint(1, 40), 9000)}") for j in (10, 11)]
    docs.append((200, docs[3][1]))
    got = {r.doc_id: (r.text, r.n_removed) for r in substring_dedup.clean(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[1] == (copy, 0) and got[3] == (docs[2][1], 0) and got[2][0] == "" and got[200][0] == ""
    for i in range(60):
        assert got[i * 2 + 10][1] == 0 and got[i * 2 + 11][1] > 0
    for text in (prose(300, 3), prose(300, 9000, 0.2), " \n" + "a  " * 80 + "\n b.c"):
        assert "".join(substring_dedup.sentences(text)) == text


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[5:40] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = graph_search.nearest(vectors, vectors.where("vec_id % 20 = 0"), 10).collect()
    hits = total = 0
    for q in range(0, 600, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:10]
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        hits += len({r.vec_id for r in mine} & set(best.tolist()))
        total += 10
    assert hits / total >= 0.9


def recall(spark, x, k=20, kind="float"):
    """Of the k best by brute force, the share that the search over several shards finds; scores are checked exactly."""
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    found: dict[int, list] = {}
    for r in graph_search.nearest(vectors, vectors.where("vec_id % 20 = 0"), k).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q, rows in found.items():
        s = x.astype(float) @ x[q].astype(float)
        assert [r for r, _, _ in sorted(rows)] == list(range(1, k + 1))
        assert all(abs(score - s[v]) < 1e-9 for _, v, score in rows)
        s[q] = -np.inf
        hits += len({v for _, v, _ in rows} & set(np.lexsort((np.arange(len(s)), -s))[:k].tolist()))
    return hits / (k * len(found))


@pytest.mark.parametrize("kind", ["unit", "clusters", "gaussian", "norms"])
def test_nearest_neighbours_recall_over_shards(spark, monkeypatch, kind):
    monkeypatch.setattr(graph_search, "SHARD", 1000)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    if kind == "clusters":
        x = rng.normal(size=(40, 32))[rng.integers(0, 40, 3000)] + 0.3 * x
    if kind in ("unit", "norms"):
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "norms":
        x *= rng.lognormal(0, 1, size=(3000, 1))
    assert recall(spark, x, kind="double") >= 0.9


def test_nearest_neighbours_of_odd_tables(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [1.0, 2.0, 3.0]), (1, [0.5, 0.5]), (None, [1.0, 1.0]), (2, []), (3, [None, 1.0]), (4, [float("inf"), 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS shard", "2 AS q")
    assert [tuple(r) for r in graph_search.nearest(vectors, vectors.where("vec_id % 20 = 0"), 200).collect()] == [(0, 1, 1, 0.5)]
    assert graph_search.nearest(vectors.limit(0), vectors.limit(0), 5).count() == 0


ODD = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (2, None), (3, ""), (None, None), (4, "x " * 5000 + "end"), (4, "other text of the same id")]


@pytest.fixture
def odd(spark):
    """Null and repeated ids, null, empty and long texts, and columns called like the operators' results and helpers."""
    clash = ("items", "hit", "h", "row", "n_removed", "n_sentences", "toxic", "p_toxic", "tokens", "n_tokens", "component_id", "id", "c", "n", "lang", "score")
    return spark.createDataFrame(ODD, DOCS).selectExpr("*", *(f"'kept' AS {c}" for c in clash))


def test_jaccard_join_of_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(odd).collect()), key=str)
    assert got == sorted([(1, 2, 1, 0), (1, 2, 1, 0), (None, 2, None, 0), (2, 0, 2, 0), (3, 0, 3, 0), (None, 0, None, 0), (4, 2, 4, 0), (4, 2, 4, 0)], key=str)


def test_decontamination_of_odd_rows(spark, odd, monkeypatch):
    bench = spark.createDataFrame([("a", "one two three four five six"), (None, "end"), ("b", None), ("c", "same id")], "item_id string, text string").withColumn("hit", F.lit(1))
    for broadcast, least, most in ((1 << 25, 1 << 20, 1 << 24), (0, 1 << 20, 1 << 24), (0, 64, 64)):  # the last bitmap lets every block through
        for name, value in (("BROADCAST_BYTES", broadcast), ("MIN_BITS", least), ("MAX_BITS", most)):
            monkeypatch.setattr(decontamination, name, value)
        got = sorted(((r.doc_id, r.n_words, len(r.hit), list(r["items"])) for r in decontamination.hits(odd, bench).collect()), key=str)
        assert got == sorted([(1, 6, 6, ["a"]), (1, 6, 6, ["a"]), (None, 6, 6, ["a"]), (2, 0, 0, []), (3, 0, 0, []), (None, 0, 0, []), (4, 5001, 0, []), (4, 6, 2, ["c"])], key=str)
    left = decontamination.decontaminate(odd, bench)
    assert left.columns == odd.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, ""), (1, ""), (None, ""), (2, None), (3, ""), (None, None), ODD[6], (4, "other text of the")], key=str)
    assert decontamination.hits(odd.limit(0), bench).count() == decontamination.decontaminate(odd.limit(0), bench).count() == 0


def test_windows_of_a_large_benchmark_are_not_broadcast(spark, monkeypatch):
    assert [decontamination.bitmap_bits(n) for n in (1, 1 << 16, (1 << 16) + 1, 1 << 30)] == [1 << 20, 1 << 20, 1 << 21, 1 << 24]
    bench = spark.createDataFrame([("a", "one two three four five six seven eight")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five six seven eight nine"), (2, "one two")], DOCS)
    for held, merged in ((1 << 25, 0), (0, 1)):
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", held)
        found = decontamination.hits(docs, bench)
        assert sorted((r.doc_id, list(r.hit)) for r in found.collect()) == [(1, list(range(1, 9))), (2, [])]
        assert str(found._jdf.queryExecution().sparkPlan()).count("SortMergeJoin") == merged


def test_decontamination_of_long_gaps_takes_linear_time(spark):
    import time

    bench = spark.createDataFrame([("a", "secret words")], "item_id string, text string")
    gap = " " * 200_000
    docs = spark.createDataFrame([(1, f"A{gap}secret words{gap}b{gap}\n")], DOCS)
    decontamination.decontaminate(docs.limit(0), bench).count()
    start = time.time()
    assert decontamination.decontaminate(docs, bench).first().text == f"A{gap}b{gap}\n"
    assert time.time() - start < 20


def test_substring_dedup_of_odd_rows(spark, odd):
    out = substring_dedup.clean(odd)
    assert sorted(out.columns) == sorted(odd.columns)
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in out.collect()), key=str)
    kept = [(i, t, 0) for i, t in ODD if not (t or "").startswith("x ")]
    assert [r for r in got if not (r[1] or "").startswith("x ")] == sorted(kept, key=str)
    assert substring_dedup.clean(odd.limit(0)).count() == 0


def brute_dedup(docs):
    """Plain Python over the pieces: later occurrences of runs are covered and cut with the white space before them."""
    first, covered = {}, {}
    runs = []
    for i, t in docs:
        pieces = substring_dedup.sentences(t)
        words = [p.lower().split() for p in pieces]
        n = len(pieces)
        for a in range(n):
            for b in range(a + 1, n):
                size = sum(map(len, words[a : b + 1]))
                if size >= substring_dedup.MIN_WORDS:
                    shorter = (b - a > 1) and size - len(words[b]) >= substring_dedup.MIN_WORDS, (b - a > 1) and size - len(words[a]) >= substring_dedup.MIN_WORDS
                    if not all(shorter):
                        runs.append((tuple(x for w in words[a : b + 1] for x in w), i, a, b))
                    if all(shorter):
                        break
        covered[i] = set()
    for run, i, a, b in sorted(runs, key=lambda r: (r[1], r[2], r[3])):
        if first.setdefault(run, (i, a, b)) != (i, a, b):
            covered[i].update(range(a, b + 1))
    out = {}
    for i, t in docs:
        pieces = substring_dedup.sentences(t)
        kept = [p for k, p in enumerate(pieces) if k not in covered[i]]
        text = "".join(kept)
        out[i] = (t if not covered[i] else text.lstrip() if 0 in covered[i] else text, len(covered[i]))
    return out


def test_substring_dedup_as_brute_force(spark):
    rng = random.Random(31)
    passages = [" ".join(f"v{rng.randrange(400)}" + (rng.choice(".!?") if rng.random() < 0.12 else "") for _ in range(rng.randint(20, 90))) for _ in range(6)]
    docs = []
    for i in range(30):
        parts = [" ".join(f"u{rng.randrange(5000)}" + ("." if rng.random() < 0.1 else "") for _ in range(rng.randint(3, 60))) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages))
        docs.append((i, rng.choice((" ", "\n")).join(parts)))
    docs += [(30, docs[4][1]), (31, passages[0] + " " + passages[0])]
    got = {r.doc_id: (r.text, r.n_removed) for r in substring_dedup.clean(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == brute_dedup(docs)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (2, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(odd.union(odd), toxicity.label_categories(labels))
    out = toxicity.score(odd, chain, keep=("text", "toxic", "p_toxic", "items"))
    assert out.columns == ["doc_id", "text", "items", "p_low_quality", "p_toxic", "toxic"] and out.count() == len(ODD)
    assert toxicity.train(odd, toxicity.label_categories(labels.limit(0))) is None
    assert {r.p_toxic for r in toxicity.score(odd, None).collect()} == {0.0}
    assert toxicity.score(odd.limit(0), chain).count() == 0


def test_toxicity_held_out(spark):
    """The chain against held-out documents; the second model is fed the first one's out-of-fold probabilities."""
    rng = random.Random(14)
    docs, labels = [], []
    for i in range(900):
        words = [f"w{rng.randrange(300)}" for _ in range(40)]
        low, bad = rng.random() < 0.3, rng.random() < 0.25
        words[:3] = [f"junk{rng.randrange(5)}" for _ in range(3)] if low else words[:3]
        words[5:8] = [f"vile{rng.randrange(5)}" for _ in range(3)] if bad else words[5:8]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not low), int(bad)))
    table = spark.createDataFrame(docs, DOCS)
    chain = toxicity.train(table, toxicity.label_categories(spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")))
    assert len(chain.links[0]) == 0 and len(chain.links[1]) == 1
    got = {r.doc_id: r.toxic for r in toxicity.score(table, chain).collect()}
    assert sum(got[i] == bool(t) for i, _, t in labels[600:]) / 300 > 0.97


def test_token_counts_of_odd_rows(spark, odd):
    got = [(r.doc_id, r.n_bytes) for r in token_counts.count_tokens(odd).collect()]
    assert sorted(got, key=str) == sorted([(i, len((t or "").encode())) for i, t in ODD], key=str)
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


def test_byte_bpe_of_odd_rows(spark, odd):
    got = [(r.doc_id, bytes(r.decoded).decode()) for r in byte_bpe.decode(byte_bpe.encode(odd)).collect()]
    assert sorted(got, key=str) == sorted([(i, t or "") for i, t in ODD], key=str)
