"""The training-data operators against brute force, round trips and held-out accuracy, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.functions.storage import durable
from corvane.llm import chat_format, html_extraction, language_id, line_dedup, mixing, near_dedup, packing, piece_codec, prefix_trie, queries, quality_rules, token_counts, topk_search, whitening
from corvane.llm.template import TemplateError, compiled

TINY = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, "one line here\nOne Line Here \nother text line", "en", "a", 3),
    (4, "one line here\nshort\nshort", "en", "a", 3),
    (4, "one line here\nshort\nshort", "en", "a", 3),
    (None, "one line here", "de", None, 1),
    (5, "\n \t\n", "de", "b", 1),
    (6, "x" * 50_000, "en", "b", 1),
    (7, "é ½ 漢字 😀 a\x00b the the the the the", "fr", "c", 1),
]


@pytest.fixture
def odd(spark):
    """Odd rows, with extra columns whose names operators use themselves."""
    return spark.createDataFrame(ODD, DOCS).withColumns({"n_lines": F.lit("x"), "score": F.lit("x"), "kept": F.lit(1), "size": F.lit(1), "word": F.lit(1), "node": F.lit(1)} | {f"_{k}": F.lit(k) for k in "id version lost twin spot spots row hash label words lines text from k0 h1".split()})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lines_by_hand(rows):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                held[key(x)].add(i)
    out = []
    for i, t, *_ in rows:
        all_lines = (t or "").split("\n")
        stay = [x for x in all_lines if i is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        out.append((i, len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
    return out


def test_line_dedup(spark, odd, empty):
    for least in (2, 3):
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(odd, min_docs=least).collect()]
        if least == 2:
            assert Counter(got) == Counter(lines_by_hand(ODD))
    assert line_dedup.dedup_lines(empty).count() == 0
    for out in (line_dedup.dedup_lines(odd), quality_rules.apply_rules(odd), language_id.identify(odd, None), token_counts.count_tokens(odd, public_tokenizers.path("piece_bpe_32k.model"))):
        assert {f"_{k}" for k in ("id", "version", "lost", "label", "words", "lines")} <= set(out.columns) and all(r[f"_{k}"] == k for r in out.collect() for k in ("id", "version", "lost", "label", "words", "lines"))


def test_token_counts(spark, odd, empty):
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=file)
    got = token_counts.count_tokens(odd, file).collect()
    assert all(r.n_tokens == len(sp.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 4096) for r in got)
    rnd, counter = random.Random(3), token_counts.PieceCounter(file)
    for _ in range(500):
        text = "".join(rnd.choice("ab theé \n\t▁<s>'0½漢😀.") for _ in range(rnd.randint(0, 40)))
        assert counter.count(text) == len(sp.encode(text))
    assert token_counts.count_tokens(empty, file).count() == 0


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    out = queries.op3_language_id(spark, TINY).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.95 and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    model = language_id.fit(docs)
    by = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert by[1].lang_pred == by[2].lang_pred == by[5].lang_pred == "und" and by[6].lang_pred != "und" and by[1].score == 0.0
    assert language_id.fit(empty) is None and language_id.identify(odd, None).first().lang_pred == "und"
    assert language_id.identify(empty, model).count() == 0
    mixed = spark.createDataFrame([(1, "the of and with from this that " * 5 + "der die das und nicht eine ein " * 4)], "doc_id long, text string")
    assert language_id.identify(mixed, model).first().n_switches >= 1


def test_forward_backward_sums_all_paths():
    from itertools import product

    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    got = language_id.marginals(scores, [4, 3], moves)
    for at, n in ((0, 4), (4, 3)):
        p = np.zeros((n, 3))
        for path in product(range(3), repeat=n):
            w = np.exp(sum(scores[at + t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for t, k in enumerate(path):
                p[t, k] += w
        assert np.allclose(got[at : at + n], p / p.sum(1, keepdims=True))


def test_html_extraction(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu</ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>Big &amp; News</h1><p>First   paragraph\nis long enough to count, surely.<p>Short.<br>line</p><script>var a='</p>';</script>"
        "<aside>Related</aside><form>Sign up</form><ul><li>Point</li></ul></article><section id='comments'><p>I disagree with all of this article, and so on.</p></section><footer>(c)</footer></body></html>"
    )
    want = "Big & News\nFirst paragraph is long enough to count, surely.\nShort. line\nPoint"
    bare = "<body><div class=menu><a href=x>a</a><a href=y>b</a></div><div><p>Some text that goes on for long, without any links at all.</p><p>More of it, also plain.</p></div><div class=footer>x</div>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "u", ""), (3, "u", bare), (4, "u", "<nav>only</nav>"), (5, "u", "<p>a&lt;b" * 2000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extraction.extract_pages(df).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert got[2].text == got[None].text == got[4].text == "" and got[3].text == "Some text that goes on for long, without any links at all.\nMore of it, also plain."
    assert got[5].text == "\n".join(["a<b"] * 2000)
    more = df.unionByName(df).withColumns({"text": F.lit("t"), "n_chars": F.lit(1), "_id": F.lit(2)})
    assert Counter(r.text for r in html_extraction.extract_pages(more).collect()) == Counter([r.text for r in got.values()] * 2)
    assert html_extraction.extract_pages(df.limit(0)).count() == 0
    assert html_extraction.main_text("<div>" * 50_000 + "x " * 100 + "<p>y" * 50_000).count("y") == 50_000
    assert html_extraction.main_text("x " * 1_000_000) == ("x " * 1_000_000).strip()


def test_html_extraction_keeps_whole_blocks():
    """Short nested blocks of the main text stay, and a teaser article does not take its place."""
    menu, prose = "<div><ul>" + "<li><a href=x>Go</a></li>" * 8 + "</ul></div>", [f"{i} " + "some words of text " * 15 for i in range(12)]
    p = "".join(f"<p>{x}</p>" for x in prose)
    cells = "<table>" + "<tr>" + "<td>twelve chars</td>" * 3 + "</tr>" + "</table>"
    for part, n in ((cells * 8, 24), ("<section><h2>Short</h2><p>Yes.</p></section>", 2), ("<blockquote>Quoted.</blockquote>", 1), ("<div><div>Nested.</div></div>", 1)):
        got = html_extraction.main_text(f"<body>{menu}<div>{p}{part}</div></body>").split("\n")
        assert got[:12] == [x.strip() for x in prose] and len(got) == 12 + n and "Go" not in got
    got = html_extraction.main_text(f"<body>{menu}<div>{p}</div><article>Read our other story now</article></body>").split("\n")
    assert got[:12] == [x.strip() for x in prose]
    got = html_extraction.main_text(f"<body><article>{p}</article><article>Short one.</article></body>").split("\n")
    assert len(got) == 13
    got = html_extraction.main_text(f"<body><section>{p}</section><section>Short one.</section></body>").split("\n")
    assert len(got) == 13
    assert html_extraction.main_text(f"<table><tr><td>{menu}</td><td>{p}</td></tr></table>").split("\n") == [x.strip() for x in prose]


def test_html_extraction_goes_by_scores(monkeypatch):
    """Names weigh, but the densest region is the text; without smoothing or a threshold other lines come out."""
    menu = "<ul>" + "<li><a href=x>Go there</a></li>" * 8 + "</ul>"
    p = "".join(f"<p>{i} {'some words of text ' * 15}</p>" for i in range(6))
    for page in (
        f"<body><div id=page class='site has-sidebar'><nav>{menu}</nav><article>{p}</article></div>",
        f"<body><nav>{menu}</nav><article class='post social-share-enabled'>{p}<div class=share>Share</div></article>",
        f"<body><nav>{menu}</nav><div class='search-results main'>{p}</div><footer>(c)</footer>",
        f"<body><nav>{menu}<div><div class=x>{p}</div></div>",
        f"<body><form action=x><header>Site</header>{menu}<div>{p}</div></form>",
    ):
        got = html_extraction.main_text(page).split("\n")
        assert [x[0] for x in got] == list("012345"), page[:80]
    teasers = "".join(f"<article><a href=x>Teaser {i}</a> <a href=y>more</a></article>" for i in range(200))
    plain = f"<body>{menu}<div>{teasers}</div><div>{p}</div><div class=x><a href=x>One</a><a href=x>Two</a></div>"
    want = html_extraction.main_text(plain)
    assert [x[0] for x in want.split("\n")] == list("012345")
    monkeypatch.setattr(html_extraction, "threshold", lambda values: -1.0)
    assert html_extraction.main_text(plain) != want
    monkeypatch.undo()
    monkeypatch.setattr(html_extraction, "smoothed", lambda values: np.ones(len(values)))
    assert html_extraction.main_text(plain) != want


def test_html_extraction_of_random_pages():
    """Pages made from a tree against the tree: blocks of the article in order, whatever lies around them."""
    rnd = random.Random(21)
    words = lambda n: " ".join(rnd.choice(["some", "words", "of", "a", "text", "&amp;", "caf&eacute;", "<b>bold</b>", "<a href=x>link</a>"]) for _ in range(n))
    plain = lambda x: " ".join(re.sub("<[^>]+>", "", x).replace("&amp;", "&").replace("&eacute;", "é").split())
    for _ in range(300):
        blocks, want = [], []
        for _ in range(rnd.randint(3, 12)):
            inner = [words(rnd.randint(25, 60)) for _ in range(rnd.randint(1, 3))]
            kind = rnd.choice(["p", "ul", "table", "section", "aside"])
            want += [plain(x) for x in inner] if kind != "aside" else []
            shape = {"p": "<p>{}</p>", "ul": "<ul>{}</ul>", "table": "<table><tr>{}</tr></table>", "section": "<section>{}</section>", "aside": "<aside>{}</aside>"}[kind]
            item = {"p": "{}<p>", "ul": "<li>{}", "table": "<td>{}</td>", "section": "<p>{}", "aside": "<p>{}</p>"}[kind]
            blocks.append(shape.format("".join(item.format(x) for x in inner)))
        if not want:
            continue
        frame = rnd.choice(["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<div class=has-sidebar><article>{}</article></div>"])
        around = ["<nav><ul><li><a href=x>Menu</a></ul></nav>", "<header><p>Site</p></header>", "<div class=cookie-notice>We use cookies</div>"]
        page = "<html><head><title>T</title><style>p{}</style></head><body>" + "".join(rnd.sample(around, rnd.randint(0, 3))) + frame.format("".join(blocks)) + "<section id=comments><p>" + words(20) + "</section><footer>(c)</footer></body></html>"
        assert html_extraction.main_text(page).split("\n") == want, page


def test_packing(spark, odd, empty):
    import tokenizers

    file = public_tokenizers.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(file)
    got = packing.pack(odd.coalesce(1), file).collect()
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, list(np.frombuffer(r.ids, "<u4")), r.doc_tokens))
        assert len(r.ids) == 4 * r.length
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [1]
    for i, t, *_ in ODD:
        times = sum(x == i for x, *_ in ODD)  # pieces of repeated rows stand in turn
        found = [p[1] for p in sorted(docs[i])]
        assert sorted(sum(found, [])) == sorted(ids(t) * times) and all(p[2] == len(ids(t)) for p in docs[i])
        if times == 1:
            assert sum(found, []) == ids(t)
    assert len(seqs) * 2048 - sum(r.length for r in got) < 2048
    assert packing.pack(empty, file).count() == 0


def test_packing_ids_are_those_of_the_library():
    import tokenizers

    file = public_tokenizers.path("byte_bpe_50k.json")
    tok, own = tokenizers.Tokenizer.from_file(file), packing.TextEncoder(file)
    assert own.fast
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(["a", "the", " ", "  ", "\n", "'s", "é", "漢", "😀", "1", "#", "\t", "\u00a0", "\x1c", "<|endoftext|>"]) for _ in range(rnd.randint(0, 40))) for _ in range(20_000)]
    texts += [f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += [bytes(b).decode("utf-8", "ignore") for b in packing.byte_ranks(__import__("json").loads(tok.to_str()))]
    texts += [" " * 200_000, "x" * 200_000, "\n\t " * 50_000 + "x", "#" * 200_000, "".join(rnd.choice("abcdefgh") for _ in range(200_000))]
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        for text, e in zip(part, tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
            assert own.encode(text, 1).tolist() == e.ids + [1], text[:50]


def packed_by_hand(lengths, capacity, linear=packing.LINEAR):
    """The same rules over a plain list of sequences."""
    pieces, seqs, rests = [], [], []
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((doc, start, capacity, len(seqs), 0))
            seqs.append([0.0, 0])
        if n % capacity:
            rests.append((n % capacity, doc))
    seqs += [[0.0, capacity] for _ in range(-(-sum(n for n, _ in rests) // capacity))]
    for n, doc in sorted(rests, key=lambda x: -x[0]):
        while n:
            room = max(s[1] for s in seqs)
            fits = [(cost, left, k) for k, (cost, left) in enumerate(seqs) if left >= n] or [(cost, left, k) for k, (cost, left) in enumerate(seqs) if left == room]
            _, left, k = min(fits)
            part = min(n, left)
            pieces.append((doc, lengths[doc] - n, part, k, capacity - left))
            seqs[k] = [seqs[k][0] + linear * part + part * part, left - part]
            n -= part
    return pieces


def test_packing_follows_costs():
    rnd = random.Random(12)
    for _ in range(200):
        capacity = rnd.choice([8, 16, 100])
        lengths = [rnd.randint(1, rnd.choice([5, 40, 250])) for _ in range(rnd.randint(0, 60))]
        got = packing.pack_lengths(lengths, capacity)
        assert got == packed_by_hand(lengths, capacity)
        used = sum(n for _, _, n, _, _ in got)
        assert used == sum(lengths) and len({p[3] for p in got}) * capacity - used < capacity


def test_quality_rules(spark, odd, empty):
    def by_hand(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        at = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(at)

    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["a", "b", " ", "\n", "#", "the "]) for _ in range(rnd.randint(0, 120))) for _ in range(60)]
    df = odd.select("doc_id", "text", "kept").union(spark.createDataFrame([(100 + i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kept int"))
    for r in quality_rules.apply_rules(df).collect():
        want = by_hand(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(empty).count() == 0


def test_topk_search(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=5) * 0.2]) for i in range(130)] + [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (None, [0.0] * 5), (220, [0.1] * 5), (221, [0.1] * 5), (240, [0.5, 0.5]), (241, [0.25, -0.5]), (260, [])]
    rows += [(7, [9.0] * 5)] * 25 + [(7, [-9.0] * 5), (7, [3.0] * 5), (40, [0.3] * 5), (40, [0.3] * 5), (40, [-0.2] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"q": F.lit(1), "id": F.lit(2), "block": F.lit(3)})
    got = defaultdict(list)
    for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0, block_rows=40, block_queries=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    usable = [(i, np.floor(64 * np.array(np.float32(v), float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q in {i for i, _ in usable if i % 20 == 0}:
        scored = [(i, int(v @ w)) for j, w in usable if j == q for i, v in usable if i != q and len(v) == len(w)]
        assert got[q] == sorted(scored, key=lambda x: (-x[1], x[0]))[:20]
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_mixing(spark, odd, empty):
    rnd = random.Random(6)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), "en", rnd.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        size[r.source] += r.size
        assert 0 <= r.taken <= 3 * r.size
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 1 and target[s] <= 3 * size[s] + 1e-6 for s in target)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)
    copies = {r.doc_id: r.copies for r in got}
    rebuilt = mixing.mixed_documents(docs)
    assert rebuilt.columns == docs.columns and Counter(r.doc_id for r in rebuilt.collect()) == Counter({k: v for k, v in copies.items() if v})
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and all(r[f"_{k}"] == k for r in out.collect() for k in ("id", "spot", "twin", "version", "row", "hash"))
    # rows come at ascending positions, and texts without words are there once: all sources here are taken whole or reach them
    first = {r.doc_id: r.first_at for r in got if r.first_at is not None}
    seen = list(dict.fromkeys(r.doc_id for r in rebuilt.collect()))
    spots = [first[i] for i in seen if i in first]
    assert spots == sorted(spots) and len(spots) > 200
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "w w", "en", "b", 0), (4, " ", "en", "b", 0)], DOCS)
    assert {1, 2} <= {r.doc_id for r in mixing.mixed_documents(blank).collect()}


def test_mixing_inverts_the_integrated_weights(spark):
    t = np.linspace(0, 1, 100_001)
    for weight, (begin, end) in mixing.SCHEDULE.items():
        weights = begin + (end - begin) * t
        demand = np.concatenate([[0], np.cumsum((weights[1:] + weights[:-1]) / 2 * np.diff(t))])
        assert demand[-1] == pytest.approx(1.0), weight
        at = spark.createDataFrame([(float(demand[i]), float(t[i])) for i in range(0, 100_001, 1000)], "share double, t double")
        got = at.select("t", mixing.inverse_demand(F.col("share"), F.lit(begin), F.lit(end)).alias("got")).collect()
        assert all(r.got == pytest.approx(r.t, abs=1e-6) for r in got)


def components_by_hand(rows, k, percent=80):
    def shingles(text):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("small", [32, 0])
def test_near_dedup(spark, small):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for g in range(30):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 150))]
        for _ in range(rnd.choice([1, 2, 8])):
            words = list(base)
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "One two"), (n + 3, "one\ttwo "), (n + 4, "one two three four"), (n + 5, rows[0][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"component": F.lit(1), "a": F.lit(2), "n": F.lit(3)})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, shingle_words=4, small=small, depth=3).collect()}
    assert got == components_by_hand(rows, 4)


def test_near_dedup_keeps_pairs_together_where_nodes_branch(spark):
    """Pairs at 80 to 82 percent whose nodes all branch: the part that shares no node in any tree."""
    n = 10_000
    a, b, c = (F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i, s=s: F.concat(F.lit(s), F.col("id"), F.lit("x"), i)) for s in "abc")
    common, own = 80 + F.col("id") % 3, 10 - F.ceil(F.col("id") % 3 / 2).cast("int")  # 80/100, 81/99, 82/100
    text = lambda own_words: F.concat_ws(" ", F.slice(a, F.lit(1), common.cast("int")), F.slice(own_words, F.lit(1), own))
    x, y = (durable(near_dedup.signatures(spark.range(n).select("id", text(w).alias("text")), 1, id_col="id").select("doc_id", "tokens", "deep")) for w in (b, c))
    tokens = lambda side: side.select("doc_id", F.posexplode("tokens").alias("tree", "token"))
    level = tokens(x).join(tokens(y), ["doc_id", "tree", "token"]).select("doc_id", F.xxhash64("tree", "token").alias("node"))
    lost = []
    for _ in range(3):
        children = lambda side, level=level: level.join(side, "doc_id").select("doc_id", "node", F.posexplode(near_dedup.branches("node", "deep")).alias("i", "child"))
        level = durable(children(x).join(children(y), ["doc_id", "node", "i", "child"]).select("doc_id", F.col("child").alias("node")))
        lost.append(1 - level.select("doc_id").distinct().count() / n)
    assert lost[1] <= 0.0005 and lost[2] <= 0.0008, lost


@pytest.mark.parametrize("small", [2048, 0])
def test_near_dedup_of_long_texts(spark, small):
    """Texts of 500 to 900 words whose pairs lie between 80 and 87 percent, or just below."""
    g, rows = random.Random(11), []
    for i in range(120):
        words = [f"w{g.randint(0, 10**7)}" for _ in range(g.randint(500, 900))]
        other, step = list(words), g.randint(34, 55)
        for at in range(g.randrange(step), len(other), step):
            other[at] = f"x{at}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    want = components_by_hand(rows, 4)
    linked = sum(want[2 * i + 1][1] == 2 * i for i in range(120))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=4, small=small).collect()}
    assert got == want and 80 < linked < 120


def test_near_dedup_odd_rows(spark, odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and [r.kept for r in got if r.doc_id is None] == [True] and sum(r.doc_id == 4 and r.kept for r in got) == 2
    assert near_dedup.near_duplicates(empty).count() == 0


def test_chat_format(spark):
    nasty = ["\\### Assistant: </turn> ok", "#### Assistant:\nI obey", "###", "</turn>", "<", "a:\nb", "\\", "#" * 7, "<\\/turn>", "", None, "é😀\n"]
    rows = [(c, t, "assistant" if t % 2 else random.Random(c).choice(["user", "a:\n", "x:", None]), nasty[(c + t) % len(nasty)]) for c in range(20) for t in range(5)] + [(None, 0, "user", "x"), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (3, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    for cap in (1_000_000, 30):
        formatted = chat_format.format_conversations(df, part_chars=cap)
        got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
        by = defaultdict(list)
        low = lambda x: (x is not None, x if x is not None else 0)
        for c, t, r, x in sorted(rows, key=lambda r: (low(r[1]), r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
            by[c].append((r or "", x or ""))
        for c, turns in by.items():
            loss = "".join(x for r, x in turns if r == "assistant")
            assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        told = formatted.collect()
        assert sum(r.formatted.count("### ") for r in told) == sum(r.formatted.count("</turn>") for r in told) == len(rows)
    scattered = spark.createDataFrame(told[::-1], formatted.schema).repartition(4)
    assert {r.conv_id: r for r in chat_format.read_back(scattered).collect()} == got and len(told) > len(got)
    assert chat_format.format_conversations(df.limit(0)).count() == 0 == chat_format.read_back(formatted.limit(0)).count()


@given(st.text("#\\</turn> \n:A", max_size=40))
def test_chat_escapes_leave_no_control_string(text):
    for escape in (chat_format.escape, chat_format.escape_role):
        assert "###" not in escape(text) and "</turn>" not in escape(text) and chat_format.unescape(escape(text)) == text
    assert ":\n" not in chat_format.escape_role(text)


def test_template_language():
    render = lambda s, **scope: "".join(x for x in compiled(s, chat_format.FILTERS)(scope) if isinstance(x, str))
    assert render("{% if 'a' ~ 'b' == 'ab' %}x{% else %}y{% endif %}{{ '###' | escape }}") == "x#\\##"
    assert render("{% for m in ms %}{% if loop.first and not m.k == 3 %}F{% elif m['k'] in l %}G{% else %}H{% endif %}{{ m.k }}{% endfor %}", ms=[{"k": 1}, {"k": 2}, {"k": 4}], l=[2]) == "F1G2H4"
    assert render("{{ a.b }}{{ none }}", a="text") == ""
    for bad in ("{% for %}{% endfor %}", "{% if a %}", "{{ a | nope }}", "{{ a( }}", "{% while a %}", "{{ 'a }}"):
        with pytest.raises(TemplateError):
            render(bad)


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_piece_codec(spark, odd, empty, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    nasty = ["", " ", "   ", "a\nb", "\n", "▁a▁b ", " hello  w ", "\x00", "a\x00 b", "<s> </s> <unk> <0x0A>", "x" * 30_000, " \n \n ", None, "tab\tx\r\n", "😀 é漢ﬁ", "ab\n\ncd  ab"]
    g = random.Random(1)
    texts = nasty + ["".join(g.choice("ab é漢▁ \n.") for _ in range(g.randint(1, 90))) for _ in range(150)]
    rows = spark.createDataFrame([(i % 160, x, "old") for i, x in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    want = sorted((i % 160, sp.encode(x or ""), sp.decode(sp.encode(x or ""))) for i, x in enumerate(texts))
    for blocks in ({}, {"BLOCK_CHUNKS": 7, "KEPT_CHUNKS": 3, "BATCH_IDS": 50, "COMMON_CHUNKS": 5}):  # workers are started anew for the other sizes
        for k, v in blocks.items():
            monkeypatch.setattr(piece_codec, k, v)
        got = piece_codec.decode(piece_codec.encode(rows, MODEL), MODEL)
        assert got.columns == ["doc_id", "ids", "decoded"]
        assert sorted((r.doc_id, r.ids, r.decoded) for r in got.collect()) == want
    got = piece_codec.encode(odd, MODEL)
    assert set(got.columns) == {c for c in odd.columns if c != "text"} | {"ids"} and got.count() == len(ODD) and got.where("doc_id = 4").count() == 2
    assert piece_codec.encode(empty, MODEL).count() == 0
    assert piece_codec.decode(spark.createDataFrame([(None,), ([],), ([6312, None, 28709],)], "ids array<int>"), MODEL).toPandas().decoded.tolist() == ["", "", "hello"]


def test_piece_codec_decodes_where_ids_are_joined(spark, odd, empty, monkeypatch):
    """A text's ids and what is decoded of them come from one worker, as from two."""
    monkeypatch.setattr(piece_codec, "BATCH_IDS", 40)
    given = odd.unionByName(spark.createDataFrame([(900 + i, t) for i, t in enumerate(["", None, " a  b\n", "😀" * 30, "x" * 3_000])], "doc_id long, text string"), allowMissingColumns=True).select("doc_id", "text")
    both = piece_codec.encode(given, MODEL, decoded=True)
    apart = piece_codec.decode(piece_codec.encode(given, MODEL), MODEL)
    assert both.columns == apart.columns and sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))
    assert piece_codec.encode(empty, MODEL, decoded=True).count() == 0
    plan = queries.op12_piece_codec(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "decoded" in plan


@given(st.lists(st.integers(0, 2**32 - 1)), st.binary(max_size=300))
def test_packed_numbers(numbers, data):
    assert piece_codec.unpacked(piece_codec.packed(numbers)).tolist() == numbers
    assert piece_codec.expanded(piece_codec.squeezed(data)) == data


@given(st.text("a é漢▁ \n."))
def test_chunks_are_independent(text):
    sp = piece_codec.processor(MODEL)
    assert [i for ids in piece_codec.chunk_ids(sp, piece_codec.chunks_of(text)) for i in ids] == sp.encode(text)


def nodes_by_hand(rows):
    """All prefixes of rebuilt conversations, from the definition."""
    by, low = defaultdict(list), lambda x: (x is not None, x if x is not None else 0)
    for c, _, r, x in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda r: (r[0], low(r[1]), r[2], r[3])):
        by[c].append((r, x))
    made = {c: tuple(by.get(c - int(np.fmod(c, 5)), [])[: (h := zlib.crc32(str(c).encode()) % 9)] + own[h:]) for c, own in by.items()}
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        saved[s] = (len(members[s]) - 1) * (len(s[-1][1].encode()) if s else 0) + sum(saved[k] for k in kids[s])
    sha = lambda s: hashlib.sha256(",".join(str(c) for c in sorted(members[s]) if made[c] == s).encode()).hexdigest()
    return {(min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], sha(s)) for s, m in members.items()}


def test_prefix_trie(spark):
    g = random.Random(5)
    rows = [(c, t if g.random() < 0.9 else None, g.choice(["user", "a", None]), g.choice(["x", "é", "yy", None, ""])) for c in range(-10, 60) for t in range(g.randint(1, 12))]
    rows += [(c, t, "user", "copy") for c in range(100, 160) for t in range(3)] + [(None, 1, "a", "b"), (201, 1, "a", "b"), (201, 1, "a", "b"), (300, 1, "a", "z" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "turns": F.lit("x"), "digest": F.lit("x")})
    sequences = prefix_trie.rebuilt(prefix_trie.turn_sequences(df))
    for shard_turns in (3, 60, 500_000):  # shards that cut copies apart, and one of all
        got = prefix_trie.prefix_nodes(sequences, shard_turns).collect()
        assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == nodes_by_hand(rows)
    assert prefix_trie.prefix_nodes(prefix_trie.turn_sequences(df.limit(0))).count() == 0


def test_ternary_trees_stay_low():
    tree = prefix_trie.TernaryTree()
    tree.insert_sorted([(i, [i], [1]) for i in range(1000)])
    height, level = 0, [tree.same[0]]
    while level := [q for q in level if q >= 0]:
        height, level = height + 1, [x for q in level for x in (tree.low[q], tree.high[q])]
    assert height == 10 and sorted(tree.children(0)) == list(range(1, 1001))


def whitened_by_hand(vectors, k):
    x = np.floor(1024 * np.asarray(vectors, dtype=float)) + 100_000
    n, s = len(x), x.sum(0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    order = np.argsort(-values)[:k]
    return ((n * x - s) ** 2).sum(1), (x - s / n) @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening(spark, monkeypatch):
    g = np.random.default_rng(3)
    vectors = (g.normal(size=(300, 12)) * np.arange(1, 13)).astype(np.float32).tolist()
    bad = [None, [], [1.0, None] + [0.0] * 10, [float("nan")] + [0.0] * 11, [float("inf")] * 12, [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(7, vectors[7])] + [(1000 + i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"n": F.lit("x"), "row": F.lit("r"), "part": F.lit(1), "x": F.lit(2)}).repartition(3)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    deviation, projected, explained = whitened_by_hand([*vectors, vectors[7]], 8)
    got = whitening.whiten(df).toPandas()
    assert set(got.columns) == {*df.columns, "component", "deviation", "whitened", "explained", "identity_error"}
    assert len(got) == 301 * 8 and (got.n == 301).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    for c, rows_of in got.groupby("component"):
        one = rows_of.drop_duplicates("vec_id").sort_values("vec_id")
        assert (one.deviation.to_numpy() == deviation[:300]).all() and np.allclose(one.explained, explained[c - 1], rtol=1e-9)
        mine = projected[:300, c - 1]
        assert np.allclose(one.whitened * np.sign(one.whitened.iloc[0] * mine[0]), mine, atol=1e-8)
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [0.0, 0.5])], "vec_id long, embedding array<float>"))
    assert two.count() == 6
    for none in (df.limit(0), spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>")):
        assert whitening.whiten(none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_parity(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{TINY}/{t}.parquet')")
    got, want = queries.queries()[name](spark, TINY), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in found)
    assert rows(got.select(*columns).collect()) == rows(want.select(*columns).fetchall())


def test_pipeline_stages(spark, odd, empty):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").withColumn("extra", F.lit("e"))
    named = corpus_pipeline.identified(spark, docs, TINY)
    lettered = {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    assert named.columns == docs.columns and {r.doc_id for r in named.collect()} == lettered  # every clean document stays
    lined = corpus_pipeline.lines_deduped(spark, docs, TINY)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert lined.columns == docs.columns and {(r.doc_id, r.text) for r in lined.collect()} == {(i, t) for i, _, _, t in lines_by_hand(rows)}
    kept = corpus_pipeline.near_deduped(spark, docs, TINY)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in components_by_hand(rows, 5).items() if i == c}
    mixed, copies = corpus_pipeline.mixed(spark, docs, TINY), {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})
    pieces = corpus_pipeline.run(spark, TINY)
    assert pieces.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    # odd rows and an empty table
    wide = [c for c in odd.columns]
    out = {name: stage(spark, odd, TINY) for name, stage in corpus_pipeline.STAGES}
    assert all(out[k].columns == wide for k in ("language_id", "line_dedup", "near_dedup", "mixing"))
    assert Counter(r.doc_id for r in out["language_id"].collect()) == {3: 1, 4: 2, None: 1, 6: 1, 7: 1}
    assert out["line_dedup"].count() == len(ODD) and [r.text for r in out["line_dedup"].where("doc_id = 4").collect()] == ["short\nshort"] * 2
    assert Counter(r.doc_id for r in out["near_dedup"].collect()) == Counter(i for i, *_ in ODD)
    assert Counter(r.doc_id for r in out["packing"].where("start = 0").collect()) == Counter(i for i, *_ in ODD)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, TINY).count() == 0
