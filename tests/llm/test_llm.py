"""Operators of ``llm`` against plain versions of themselves, and their defined cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hushlake.llm import chunks, decontamination, html_text, licenses, near_dup, packing, quality, secrets, toxicity, url_filter
from hushlake.llm.components import components
from hushlake.llm.words import ALNUM, blocks, text_buffers, window_hash

WORDS = "the of and thing ander oration listen märz uñido red blue green stone water light".split()
#: columns whose names the operators use inside
CLASH = "id long, row long, node long, text_key long, score double, spans string, label string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def documents(spark, rows):
    """``rows`` of (doc_id, text); the other columns of the table, and clashing ones."""
    rows = [(i, t, "en", f"src{(i or 0) % 5}", len(t or ""), 1, 2, 3, 4, 0.5, "x", "y") for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH
    return spark.createDataFrame(rows, schema).repartition(3)


def test_url_statistics_leave_out_the_fold(spark):
    rng = random.Random(29)
    rows = [(rng.choice(["a.com", "b.net", "c.org"]) if k % 9 else f"once{k}.de", rng.randrange(5), float(rng.random() < 0.4)) for k in range(400)]
    rows.append((None, 1, 1.0))
    share = sum(r[2] for r in rows) / len(rows)
    df = spark.createDataFrame(rows, "suffix string, fold long, label double")
    got = url_filter.out_of_fold(df, url_filter._fold_sums(df), share).collect()
    want = Counter()
    for suffix, fold, label in rows:
        others = [r[2] for r in rows if r[0] == suffix and r[1] != fold and suffix is not None]
        rate = (sum(others) + share * url_filter.SMOOTHING) / (len(others) + url_filter.SMOOTHING)
        want[suffix, fold, label, round(rate, 9), round(math.log1p(len(others)), 9)] += 1
    assert Counter((r.suffix, r.fold, r.label, round(r.suffix_rate, 9), round(r.suffix_count, 9)) for r in got) == want
    assert all(abs(r.suffix_rate - share) < 1e-9 for r in got if (r.suffix or "").startswith("once"))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, blanks, repeated rows, a long text, and copies."""
    rng = random.Random(1)
    base = prose(rng, 80)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (None, base), (7, base), (7, base),
        (8, base + " more"), (9, prose(rng, 30_000)), (10, "é" * 50), (None, None), (11, "\u00a0x\u2003y"),
    ]
    return documents(spark, rows)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_and_hashes():
    texts = ["", "a  b\nA b", None, "ünder\tx", "x", "é é", "\u00a0 y"]
    column = pa.array(texts).slice(1)
    seen = []
    for block in blocks(column):
        h = block.hashes()
        for d in range(len(block)):
            seen.append([(bytes(block.data[block.start[w] : block.end[w]]), int(h[w])) for w in range(block.lo[d], block.hi[d])])
    expected = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts[1:]]
    assert [[w.decode() for w, _ in s] for s in seen] == expected
    by_word = {}
    for w, h in itertools.chain(*seen):
        assert by_word.setdefault(w.lower(), h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert text_buffers(pa.array([], pa.string()))[1].tolist() == [0]


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    up = {n: n for e in edges for n in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: root(n) for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, size):
    w = words_of(text)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def brute_components(rows, size=4):
    sets = {i: shingles(t, size) for i, t in rows}
    least = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return sets, least


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        base = prose(rng, rng.choice([3, 6, 40, 120])).split()
        for _ in range(rng.choice([1, 3, 12])):
            text = list(base)
            for _ in range(rng.randrange(1 + len(text) // 14)):
                text[rng.randrange(len(text))] = "edit" + str(rng.randrange(999))
            rows.append((1000 - 7 * n, " ".join(text)))
            n += 1
    sets, least = brute_components(rows)
    got = near_dup.near_duplicates(documents(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == least
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_groups_are_compared_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE_CLASSES", 5)
    rng = random.Random(4)
    base = prose(rng, 60).split()
    rows = []
    for i in range(40):
        text = list(base)
        for _ in range(rng.randrange(5)):
            text[rng.randrange(60)] = f"new{rng.randrange(99)}"
        rows.append((i, " ".join(text)))
    got = near_dup.near_duplicates(documents(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)[1]


def test_estimates_follow_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[200:2200])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    agree = near_dup.agreeing(near_dup.signature(a)[1], near_dup.signature(b)[1])
    assert abs(near_dup.estimate(agree) - true) < 0.15
    assert agree >= near_dup.least_agreement(0.8)


def test_likely_links_join_what_all_pairs_join():
    rng = np.random.default_rng(23)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    sets, group = [], []
    for g in range(12):
        base = pool[rng.integers(0, 3000) :][:300]
        for k in range(int(rng.integers(1, 15))):
            sets.append(np.unique(np.concatenate([base[: 300 - 25 * (k % 6)], rng.integers(0, 2**63, 10 * (k % 4)).astype(np.uint64)])))
            group.append(g)
    sizes, packed = np.array([len(s) for s in sets]), np.stack([near_dup.signature(s)[1] for s in sets])
    x, y = near_dup.likely_links(np.array(group), sizes, packed, 80)
    least, pairs = near_dup.least_agreement(0.8), []
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            fits = 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j]) and near_dup.agreeing(packed[i], packed[j]) >= least
            if group[i] == group[j] and fits:
                pairs.append((i, j))

    def parts(links):
        sets_of = near_dup._Sets(len(sets))
        for a, b in links:
            sets_of.join(a, b)
        return [frozenset(k for k in range(len(sets)) if sets_of.root(k) == sets_of.root(i)) for i in range(len(sets))]

    found = list(zip(x.tolist(), y.tolist(), strict=True))
    assert set(found) <= set(pairs) and parts(found) == parts(pairs) and len(found) < len(pairs)


def test_one_bucket_in_many_tiles(spark, monkeypatch):
    """Near copies that share most bands, with buckets and clusters cut into tiny tiles."""
    rng = random.Random(24)
    base, rows = prose(rng, 120).split(), []
    for i in range(60):
        text = list(base)
        for k in range(rng.randrange(6)):
            text[rng.randrange(120)] = f"w{i}x{k}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, prose(rng, 40)) for i in range(20)]
    monkeypatch.setattr(near_dup, "BUCKET_TILE", 4)
    monkeypatch.setattr(near_dup, "TILE_CLASSES", 8)
    got = near_dup.near_duplicates(documents(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)[1]


def test_near_duplicates_defined_cases(spark, odd):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    for i in (1, 2, 3):
        assert (by[i].n_shingles, by[i].component_id, by[i].kept) == (0, i, True)
    assert by[5].component_id == 4 and not by[5].kept
    assert by[8].component_id == 7 and by[None].component_id is None
    kept = near_dup.keep_representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 7, 9, 10, 11]
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def test_toxicity_learns_held_out_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        text = prose(rng, 60).split()
        bad = i % 3 == 0
        if bad:
            for _ in range(4):
                text[rng.randrange(60)] = rng.choice(["zqxword", "vlkgrim", "wpjfoul"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    table = spark.createDataFrame(labels + [(0, None), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(documents(spark, rows), table).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels], "doc_id long, toxic int")
    again = toxicity.toxicity_scores(documents(spark, rows), flipped).collect()
    assert {r.doc_id: round(r.score, 9) for r in again} == {r.doc_id: round(r.score, 9) for r in got}


def test_toxicity_defined_cases(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity_scores(odd, none).collect()
    assert len(rows) == odd.count() and all(r.predicted == 0 for r in rows)
    assert toxicity.drop_toxic(odd, none).columns == odd.columns
    assert toxicity.toxicity_scores(odd.limit(0), none).count() == 0


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(7)
    counts = rng.integers(0, 3, toxicity.SYMBOLS**2).astype(float).reshape(toxicity.SYMBOLS, -1)
    lower = np.full(toxicity.SYMBOLS, 1 / toxicity.SYMBOLS)
    assert np.allclose(toxicity._discounted(counts, lower).sum(axis=-1), 1)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_respects_every_capacity(rule):
    rng = random.Random(8)
    counts = {rng.randrange(1, 100): rng.randrange(1, 200) for _ in range(40)}
    capacity = packing.Capacity(tokens=100, documents=7, attention=6000, rule=rule)
    counts = {k: n for k, n in counts.items() if k * k <= 6000}
    plan = packing.plan_packing(counts, capacity)
    used = Counter()
    filled = {}
    for length, n in counts.items():
        sequence, offset = plan.place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            filled.setdefault(s, []).append((o, length))
            used[s] += 1
    assert len(filled) == plan.sequences
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 100 and len(pieces) <= 7 and sum(k * k for _, k in pieces) <= 6000
    # no worse than first fit, which looks at every open sequence
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            for b in bins:
                if b[0] + length <= 100 and b[1] < 7 and b[2] + length * length <= 6000:
                    break
            else:
                bins.append(b := [0, 0, 0])
            b[0], b[1], b[2] = b[0] + length, b[1] + 1, b[2] + length * length
    assert plan.sequences <= 1.05 * len(bins)


def test_packing_round_trip(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(odd, with_ids=True).collect()
    texts = Counter((r.doc_id, r.text) for r in odd.collect())
    whole = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length <= 4096 and zlib.crc32(p.ids) == p.ids_crc32
        whole.setdefault(p.doc_id, []).append(p)
    for (doc_id, text), n in texts.items():
        if doc_id is None:
            continue
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(whole[doc_id], key=lambda p: p.start)[::n]
        assert b"".join(bytes(p.ids) for p in own) == ids.tobytes()
        assert [p.piece for p in own] == list(range(len(own))) and all(p.length == 1024 for p in own[1:])
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) == -(-sum(p.length for p in pieces) // 1024)
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_packing_reads_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "a  <|endoftext|>  b\n", "<|endoftext|><|endoftext|>", "<|endoftext", "x <|ENDOFTEXT|>"]
    pieces = packing.pack_documents(documents(spark, list(enumerate(texts))), with_ids=True).collect()
    got = {p.doc_id: np.frombuffer(p.ids, "<u4").tolist() for p in pieces}
    assert got == {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    assert got[0] == [64, 50256, 65, 2]


PAGE = """<html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body class="has-sidebar">
<header><a>Home</a></header><nav><li>menu</li></nav><div class="cookie-notice"><p>We use cookies</p></div>
<article class="post"><header><h1>A &amp; B</h1></header><p>First <b>bold<br>text<p>Second&nbsp;  para 1 < 2<aside>side</aside>
<ul><li>one<li>two</ul><!-- <p>no</p> --><form>f</form>%s</article><section id="comments"><p>nice</p></section><footer>&copy; x"""


def test_html_blocks():
    texts = [t for _, _, t, _ in html_text.parse_blocks(PAGE % "<p>end</p>")]
    assert texts == ["A & B", "First bold text", "Second para 1 < 2", "one", "two", "end"]
    assert [t for _, _, t, _ in html_text.parse_blocks("plain &lt;b&gt; text <p>b<!-- open")] == ["plain <b> text", "b"]
    assert html_text.parse_blocks("") == [] and html_text.parse_blocks("<script>x") == []


@pytest.mark.parametrize("names", [
    "class='no-sidebar'", "class='has-sidebar'", "class='comments-open'", "class='entry social'", "class='with-ads'", "id='search-results-page'",
    "class='sidebar'", "class='site-footer'",
])
def test_html_wrappers_keep_the_article(names):
    inner = "<p>one two three four</p><p>five six seven eight</p>"
    for whole in (inner, f"<article>{inner}</article>", f"<main>{inner}</main>"):
        page = f"<body><nav>menu</nav><div {names}>{whole}<div class='site-footer'>terms</div></div></body>"
        assert [t for _, _, t, _ in html_text.parse_blocks(page)] == ["one two three four", "five six seven eight"]
    page = f"<body><article>{inner}</article><div class='widget-area'>x</div><div id='comments'><article class='comment-body'>{inner * 3}</article></div>"
    assert len(html_text.parse_blocks(page)) == 2


def test_site_tree_cuts_what_every_page_says(spark):
    rng = random.Random(9)
    rows = [(k, f"http://A.example.org/{k}", f"<body><p>{prose(rng, 30)}</p><p>{prose(rng, 9)}</p><p>Read our terms</p></body>") for k in range(30)]
    rows += [(100 + k, f"http://b.example.org/{k}", "<body><p>same page</p></body>") for k in range(30)]
    rows += [(200, None, "<p>x</p>"), (201, "http://c", None), (202, "nothing", ""), (200, None, "<p>x</p>")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for k in range(30):
        paragraphs = re.findall("<p>(.*?)</p>", rows[k][2])
        assert by[k].text == "\n\n".join(paragraphs[:2]) and by[k].n_cut == 1
        assert by[100 + k].text == "same page"
    assert by[200].text == "x" and by[201].text == "" and by[202].n_chars == 0
    assert all(r.n_chars == len(r.text) for r in got)


def test_site_tree_leaves_marked_articles(spark):
    rng = random.Random(18)
    shared = [prose(rng, 12) for _ in range(40)]
    rows = []
    for k in range(10):
        own = [*shared[:20], f"changed {k}", *shared[20:]]
        rows.append((k, f"http://a.example.org/{k}", "<article>" + "".join(f"<p>{p}</p>" for p in own) + "</article>"))
    for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text.split("\n\n") == [*shared[:20], f"changed {r.page_id}", *shared[20:]] and r.n_cut == 0


def test_site_tree_judges_marked_articles(spark):
    """A notice within every article is cut, also where others hold it outside; copies of one page are no evidence."""
    rng = random.Random(53)
    shared = [prose(rng, 12) for _ in range(20)]
    notice, want, rows = "<p>Read our terms</p>", {}, []

    def add(host, page, *texts):
        want[len(rows)] = "\n\n".join(texts)
        rows.append((len(rows), f"http://{host}.example.org/{len(rows)}", page))

    for k in range(30):
        a, b = prose(rng, 30), prose(rng, 9)
        add("marked", f"<article id='post-{k}' class='post'><h1>{b}</h1><p>{a}</p>{notice}</article>", b, a)
        both = f"<p>{a}</p><p>{b}</p>"
        add("mixed", f"<body><article>{both}</article>{notice}</body>" if k % 2 else f"<body>{both}{notice}</body>", a, b)
        add("copies", f"<body>{both}{notice}</body>", a, b)
    for mark in ("div", "article"):
        for host in ("copies", f"alone-{mark}"):
            for k in range(40):
                texts = [*shared[:10], f"changed {mark} {k}", *shared[10:]]
                add(host, f"<{mark}>" + "".join(f"<p>{t}</p>" for t in texts) + f"</{mark}>", *texts)
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def test_near_copies_of_pages(spark):
    """Against all pairs: no page of little equal text is taken for a copy, and of a group of copies few are left."""
    rng = random.Random(54)
    rows = []
    for group in range(40):
        base = [prose(rng, rng.randrange(8, 16)) for _ in range(40)]
        for _ in range(6):
            texts = [prose(rng, 12) if rng.random() < (0.05, 0.4)[group % 2] else t for t in base]
            rows.append((len(rows), "http://h.org/", "".join(f"<p>{t}</p>" for t in texts)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", html_text.host_of(F.col("url")))
    parsed = html_text.parsed_pages(pages, "bigint").cache()
    texts = {r.page: set(r.blocks) for r in parsed.collect()}
    size = lambda blocks: sum(map(len, blocks))
    alike = {(a, b) for a in texts for b in texts if b < a and 100 * size(texts[a] & texts[b]) >= 80 * size(texts[a] | texts[b])}
    must, got = {a for a, _ in alike}, {r.page for r in html_text.near_copies(parsed).collect()}
    assert got <= must and len(must) > 60 and len(got) >= 0.95 * len(must)


def test_secrets_match_plain_patterns(spark, odd):
    rng = random.Random(10)
    parts = ["token = \"", "PASSWORD:", "secret:token=", "api_key='", "AKIA", "deadbeef" * 3, "0123456789abcdef", "x9Y8z7" * 4, "ſecret=", " ", "é", "\n", "ab=cd", "Z" * 13]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))) for k in range(150)]
    got = secrets.scan_secrets(documents(spark, rows)).collect()
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    texts = dict(rows)
    for r in got:
        text = texts[r.doc_id]
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        base = [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex"))
        assert set(base) <= set(filter(None, r.spans.split(",")))
    assert secrets.scan_secrets(odd).count() == odd.count()
    assert secrets.scan_secrets(odd.limit(0)).count() == 0


def test_secrets_of_many_owners_are_examples(spark):
    shared, own = "a1B2c3D4e5F6g7H8i9J0k1L2", "Zz9Yy8Xx7Ww6Vv5Uu4Tt3Ss2"
    rows = [(k, f"see {shared} here") for k in range(20)] + [(20, f"use {own} now é"), (21, None)]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    assert all(got[k].spans == "" and got[k].n_example == 1 and got[k].max_owners == 5 for k in range(20))
    assert got[20].spans == f"owned:4:{4 + len(own)}" and got[20].n_live == 1
    masked = {r.doc_id: r for r in secrets.redact_secrets(docs).collect()}
    assert masked[20].text == "use [SECRET] now é" and masked[20].n_chars == len("use [SECRET] now é")
    assert masked[3].text == rows[3][1] and masked[21].text is None


def test_quality_measures_match(spark, odd):
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice(WORDS[:4]) for _ in range(rng.randrange(60))).replace(" the ", rng.choice(["\n", " $# ", "\n\n", " "]))) for k in range(120)]
    got = {r.doc_id: r for r in quality.quality(documents(spark, rows)).collect()}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", text)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeat = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert (r.n_symbols, r.n_repeat_words) == (len(re.findall("[#*$%&|<>]", text)), len(repeat))
        assert r.base_failed == (len(w) < 20 or 100 * len(repeat) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality(odd).count() == odd.count() and quality.quality(odd.limit(0)).count() == 0


def test_expectation_maximisation_finds_good_documents():
    rng = np.random.default_rng(12)
    good = rng.random(5000) < 0.8
    right = rng.random((5000, len(quality.RULES))) < 0.85
    told = rng.random((5000, len(quality.RULES))) < 0.9
    vote = np.where(told, np.where(right == good[:, None], quality.GOOD, quality.BAD), quality.ABSTAIN)
    codes = vote @ (3 ** np.arange(len(quality.RULES))[::-1])
    kinds, back, n = np.unique(codes, return_inverse=True, return_counts=True)
    posterior, accuracy = quality.vote_posteriors(kinds, n.astype(float))
    assert ((posterior[back] >= 0.5) == good).mean() > 0.97
    assert np.abs(accuracy - 0.85).max() < 0.03


def test_licenses(spark, odd):
    texts = [
        "Licensed under CC BY-NC 4.0. x", "This work is licensed under the GNU General Public License, version 2.", "All rights reserved. ALL RIGHTS RESERVED",
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "cc bye", "ünder cc\u00e9 by", "all rights", "",
        "x " * 50 + "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met: y",
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, list(enumerate(texts)))).collect()}
    assert [got[k].labels for k in range(10)] == ["cc-by,cc-by-nc", "gpl", "reserved", "mit", "apache", "", "", "", "", "bsd"]
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (2, 0, 3, "reserved")
    assert got[5].first_word is None and all(0 <= r.score <= 1 for r in got.values())
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(odd.limit(0)).count() == 0
    assert licenses.common_subsequence([1, 2, 3, 4], [0, 1, 3, 9, 4]) == 3


def plain_labels(text):
    """Labels of templates that a text holds, by the classic table over every stretch of words."""
    def tokens(s):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), s))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    words, out = tokens(text), set()
    for label, template in licenses.TEMPLATES:
        t = tokens(template)
        starts = range(0, max(1, len(words) - len(t)), max(1, len(t) // 4))
        if any(len(t) - common(t, words[s : s + len(t) + len(t) // 4 + 1]) <= len(t) // licenses.ONE_IN for s in starts):
            out.add(label)
    flat = " " + " ".join(words) + " "
    return ",".join(sorted(out | {label for phrase, label in licenses.PHRASES if f" {phrase} " in flat}))


def test_whole_licenses_against_plain_search(spark):
    rng = random.Random(21)
    texts = []
    for _, whole in licenses.WHOLE:
        words = whole.split()
        texts.append(" ".join(words))
        changed = list(words)
        for k in rng.sample(range(len(words)), len(words) // 20):  # one word in twenty is another
            changed[k] = f"other{k}"
        texts.append(f"{prose(rng, 40)} {' '.join(changed)} {prose(rng, 40)}")
        gap = len(words) // 2  # six words more in the middle
        texts.append(" ".join(words[:gap]) + f" {prose(rng, 6)} " + " ".join(words[gap:]))
        texts.append(" ".join(words[len(words) // 3 : len(words) // 2]))  # a fragment
        texts.append(" ".join(rng.sample(words, len(words))))  # the words, not their order
    texts += [texts[1]] * 3 + [None]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, list(enumerate(texts)))).collect()}
    assert {k: r.labels for k, r in got.items()} == {k: plain_labels(t or "") for k, t in enumerate(texts)}
    for k, (label, _) in enumerate(licenses.WHOLE):
        assert all(label in got[5 * k + j].labels.split(",") for j in range(3))
        assert "mit" not in got[5 * k + 4].labels


def test_license_filter_lets_the_join_decide(spark, monkeypatch):
    """With a filter of one bit nearly every window reaches the join; results stay."""
    rng = random.Random(22)
    texts = [prose(rng, 60), f"{prose(rng, 30)} {licenses.WHOLE[0][1]}", "of the software in the software", ""]
    frame = documents(spark, list(enumerate(texts)))
    expected = sorted(licenses.scan_licenses(frame).collect())
    monkeypatch.setattr(licenses, "FILTER_BITS", 1)
    assert sorted(licenses.scan_licenses(frame).collect()) == expected
    assert [r.labels for r in expected] == ["", "mit", "", ""]


def test_alnum_words():
    text = "A-b_c 9É\x7f~z"
    block = next(blocks(pa.array([text]), ALNUM))
    got = [bytes(block.data[a:b]).decode() for a, b in zip(block.start, block.end, strict=True)]
    assert got == re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.replace("A", "a")) or got == ["A", "b", "c", "9É", "z"]


def test_decontamination(spark, odd):
    rng = random.Random(13)
    items = [(k, prose(rng, rng.choice([5, 6, 15, 40]))) for k in range(12)] + [(50, None), (51, ""), (52, "too short"), (3, None)]
    rows, expected = [], set()
    for i in range(80):
        text = prose(rng, rng.randrange(10, 120)).split()
        if i % 4 == 0:
            k = rng.randrange(12)
            leak = re.sub("[a-z]", lambda m: m[0].upper(), items[k][1]).split()
            for _ in range(len(leak) // 8):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(len(text))
            text[at:at] = leak
            expected.add((i, k))
        rows.append((i, " ".join(text)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    got = decontamination.benchmark_overlaps(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected
    clean = decontamination.decontaminate(docs, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i in range(80) if i % 4] and clean.columns == docs.columns
    assert decontamination.decontaminate(odd, bench).count() == odd.count()
    assert decontamination.benchmark_overlaps(docs, bench.limit(0)).count() == 0
    assert decontamination.benchmark_overlaps(docs.limit(0), bench).count() == 0


def test_seeds_meet_every_agreement():
    for n in range(5, 20):
        least = decontamination.least_stretch(n, 80, 13)
        masks = decontamination.MASKS if least >= decontamination.LONG_STRETCH else decontamination.SHORT_MASKS
        codes = np.arange(1 << n)
        hit = np.zeros(len(codes), dtype=bool)
        for mask in masks:
            for at in range(n - len(mask) + 1):
                bits = int(mask, 2) << at
                hit |= codes & bits == bits
        for code in codes[~hit].tolist():
            begin, end = decontamination.best_stretch(np.array([code >> k & 1 for k in range(n)], dtype=bool), 80)
            assert end - begin < least, f"{code:0{n}b}"


def test_short_items_with_a_changed_word(spark):
    rng = random.Random(17)
    items = [(k, prose(rng, 5 + k % 11)) for k in range(33)] + [(99, "four words are few")]
    rows, expected = [], set()
    for k, text in items:
        words = text.split()
        for j in range(len(words)):
            changed = [*words[:j], "changed", *words[j + 1 :]]
            rows.append((100 * k + j, " ".join([*prose(rng, 20).split(), *changed, *prose(rng, 20).split()])))
            if len(words) >= 5:
                expected.add((100 * k + j, k))
    got = decontamination.benchmark_overlaps(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected


def test_best_stretch_matches_brute_force():
    rng = np.random.default_rng(14)
    for _ in range(200):
        same = rng.random(rng.integers(1, 30)) < 0.7
        a, b = decontamination.best_stretch(same, 80)
        longest = max((j - i for i in range(len(same) + 1) for j in range(i, len(same) + 1) if 100 * same[i:j].sum() >= 80 * (j - i)))
        assert b - a == longest and 100 * same[a:b].sum() >= 80 * (b - a)


def test_repeated_passages(spark, odd):
    rng = random.Random(15)
    passage = prose(rng, 70)
    rows = [(k, prose(rng, 120)) for k in range(30)]
    for k in (3, 11, 20):
        words = rows[k][1].split()
        at = rng.randrange(len(words))
        rows[k] = (k, " ".join([*words[:at], passage, *words[at:]]))
    rows.append((40, "in-document only. " * 40))
    docs = documents(spark, [*rows, (None, passage), (20, rows[20][1])])
    got = chunks.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {3, 11, 20}
    texts = dict(rows)
    for r in got:
        assert texts[r.doc_id][r.start : r.end] in passage and r.first_doc_id == 3 and r.kept == (r.doc_id == 3)
    cut = {r.doc_id: r.text for r in chunks.cut_repeats(docs).collect()}
    assert cut[3] == texts[3] and cut[0] == texts[0] and len(cut[11]) < len(texts[11]) - 150
    assert chunks.cut_repeats(odd).columns == odd.columns and chunks.cut_repeats(odd).count() == odd.count()
    assert chunks.repeated_passages(odd.limit(0)).count() == 0


def test_passages_stand_in_their_partners(spark):
    """Word for word; chunks that different documents share are no passage; shifted copies of periodic text are."""
    rng = random.Random(23)
    sources = [prose(rng, 200) for _ in range(25)]
    stitched = " ".join(t[60 * k % 500 :][:60] for k, t in enumerate(sources))
    a, b = prose(rng, 90), prose(rng, 90)
    rows = list(enumerate(sources)) + [(30, stitched), (31, f"{a} {b}"), (32, f"{prose(rng, 40)} {a}"), (33, f"é {b} {a} x")]
    rows += [(40, "ab cdé " * 300), (41, "so " + "cdé ab " * 200), (42, "w" * 5000), (43, "x" + "w" * 900), (44, "short"), (45, "short")]
    texts, got = dict(rows), chunks.repeated_passages(documents(spark, rows)).collect()
    assert {r.doc_id for r in got} == {31, 32, 33, 40, 41, 42, 43}
    for r in got:
        piece = texts[r.doc_id][r.start : r.end]
        assert len(piece) >= 150 and r.partner_doc_id != r.doc_id and r.kept == (r.first_doc_id == r.doc_id)
        assert texts[r.partner_doc_id][r.partner_start : r.partner_start + len(piece)] == piece
    for k, text in ((32, a), (33, a), (33, b)):
        at = texts[k].index(text)
        held = set().union(*(range(r.start, r.end) for r in got if r.doc_id == k))
        assert len(held & set(range(at, at + len(text)))) > len(text) - 200
    assert len(chunks.cut_repeats(documents(spark, rows)).where("doc_id = 33").first().text) < len(texts[33]) - 500


def test_importance_equals_a_plain_tree(spark):
    """Entropies of a plain tree; evidence grows with the pages of a host, and no size switches it."""
    rng = random.Random(31)
    rows, weights = [], {}
    for n in (1, 3, 7, 8, 9, 40):
        for k in range(n):
            blocks = ["Read our terms"] + [prose(rng, 9) for _ in range(3)] + (["Half"] if k % 2 else [])
            rows.append((len(rows), f"http://h{n}.org/{k}", "".join(f"<p>{b}</p>" for b in blocks)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", html_text.host_of(F.col("url")))
    parsed = html_text.parsed_pages(pages, "bigint").collect()
    got = {(r.host, r.node): (r.content, r.markup) for r in html_text.node_importance(html_text.parsed_pages(pages, "bigint")).collect()}
    want = {}
    for host in {p.host for p in parsed}:
        mine = [p for p in parsed if p.host == host]
        n = len(mine)
        for node in {x for p in mine for b in p.nodes for x in (b.forward, b.backward)}:
            values = []
            for what in ("content", "markup"):
                held = Counter()
                for p in mine:
                    found = {b[what] for b in p.nodes if node in (b.forward, b.backward)}
                    held.update(found or {f"none{p.page_id}"})
                entropy = -sum(c / n * math.log(c / n) for c in held.values()) / math.log(max(n, 2))
                weight = (n - 1) / (n - 1 + html_text.PRIOR_PAGES)
                values.append(1 - weight * (1 - entropy) if n > 1 else 1.0)
            want[host, node] = values
    assert got.keys() == want.keys()
    assert all(abs(g - w) < 1e-9 for key in want for g, w in zip(got[key], want[key], strict=True))
    out = {r.page_id: r.text for r in html_text.extract_text(pages.drop("host")).collect()}
    for page, url, _ in rows:
        n = int(re.search(r"h(\d+)", url)[1])
        weights.setdefault(n, set()).add("terms" in out[page])
        assert out[page].count("\n\n") >= 2
    assert weights == {1: {True}, 3: {True}, 7: {True}, 8: {False}, 9: {False}, 40: {False}}


def test_cuts_follow_content():
    rng = random.Random(16)
    text = prose(rng, 400)
    pieces = []
    for t in (text, "an insertion in front: " + text):
        block = next(blocks(pa.array([t])))
        a, b = chunks.chunk_block(block)
        raw = t.encode()
        assert b"".join(raw[x:y] for x, y in zip(a, b, strict=True)) == raw
        pieces.append([raw[x:y] for x, y in zip(a, b, strict=True)])
    assert pieces[0][5:] == pieces[1][-len(pieces[0][5:]) :]


def test_url_verdicts(spark):
    hosts = ["a.example.net", "example.com", "x.example.com", "b.org", "c.example.org", "net", "evilnet"]
    rows = [(k, f"http://{hosts[k % 7].upper()}/{('en', 'de', 'fr')[k % 3]}/{k}?a=1&b=2#f") for k in range(210)]
    rows += [(300, None), (301, "no scheme"), (302, "http://b.net"), (303, "x://y://z/p"), (304, ""), (305, "http://example.net/en/")]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows)
    for k, url in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(r), r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        best = max(fits, default=(0, None, None))
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, best[1])
        assert r.verdict == best[2] if best[2] else r.verdict in ("allow", "block")
    assert got[302].rule is None and got[303].host == "y:"
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(empty).count() == 0


def test_window_hash_depends_on_order():
    words = np.array([1, 2, 1, 2, 3], dtype=np.uint64)
    h = window_hash(words, np.array([0, 1, 2]), range(2))
    assert h[0] == h[2] != h[1]


def test_one_id_with_two_texts_loses_neither(spark):
    rng = random.Random(18)
    first, other = prose(rng, 60), prose(rng, 60)
    near = first.replace(first.split()[30], "changed", 1)
    rows = [(1, first), (1, other), (1, other), (2, near), (3, other), (4, ""), (4, None), (None, first)]
    kept = [(r.doc_id, r.text) for r in near_dup.keep_representatives(documents(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted([(1, first), (1, other), (4, ""), (4, None), (None, first)], key=repr)
    # of linked texts of one id one stays
    both = [(r.doc_id, r.text) for r in near_dup.keep_representatives(documents(spark, [(5, first), (5, near), (6, near)])).collect()]
    assert len(both) == 1 and both[0][0] == 5


def test_copies_and_a_common_passage(spark):
    """3,000 copies and near copies of one text, and one passage in a third of all rows."""
    rng = random.Random(19)
    items = [(k, prose(rng, 30)) for k in range(20)]
    passage, base = items[0][1], prose(rng, 40)
    rows = [(k, base + " " + items[1][1]) for k in range(1500)]
    rows += [(k, f"{base} e{k} {items[1][1]}") for k in range(1500, 3000)]
    rows += [(k, f"{prose(rng, 12)} {passage} {prose(rng, 12)}" if k % 2 else prose(rng, 40)) for k in range(3000, 6000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.benchmark_overlaps(documents(spark, rows), bench).select("doc_id", "item_id").collect()
    expected = {(k, 1) for k in range(3000)} | {(k, 0) for k in range(3000, 6000) if k % 2}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
