"""The operators that SQL can't express, against plain loops over generated rows."""

import html
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken

from symweave.llm import bpe_codec, chat_format, decontamination, html_extraction, language_id, quality, secrets, topk_search, url_filter

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words_of(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_both_merge_queries_and_pieces_agree(spark):
    codec = bpe_codec.Codec(bpe_codec.read_ranks(spark, RANKS), PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=dict(codec.rank), special_tokens={})
    rng = random.Random(20)
    kinds = ["ab", "=-", "etaoin", LETTERS, "a", "é漢😀x"]
    words = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(1, 150))).encode() for _ in range(150)]
    one, all_at_once, long = codec.encode_words(words), codec.encode_words(words, bpe_codec.ENCODE_RUNS), codec.encode_long(words)
    for a, b, c in zip(one, all_at_once, long, strict=True):
        assert a.tolist() == b.tolist() == c.tolist()
    for text in ("".join(rng.choice(LETTERS) for _ in range(32_000)), "x" + "=" * 9_999, "abc" * 5_000, "z" + " " * 5_000 + "y"):
        ids, decoded = codec.texts([text])
        assert np.frombuffer(ids[0], np.int32).tolist() == library.encode_ordinary(text) and decoded == [text.encode()]


def test_top_k_by_row(spark):
    rng = np.random.default_rng(21)
    vectors = np.round(rng.normal(0, 0.4, (240, 6)), 3)
    ids = [i % 200 for i in range(240)]  # forty ids have two rows, two of them as queries; some rows are copies
    vectors[200], vectors[201], vectors[220] = vectors[0], vectors[1], vectors[20]
    frame = spark.createDataFrame([(i, [float(x) for x in v], 7) for i, v in zip(ids, vectors)], "vec_id bigint, embedding array<double>, row int")
    whole = np.floor(64 * vectors).astype(np.int64)
    wanted = []
    for q in range(240):
        if ids[q] % 20 == 0:
            rows = sorted((-int(whole[c] @ whole[q]), ids[c]) for c in range(240) if c != q)[:20]
            wanted += [(ids[q], k + 1, c, -s) for k, (s, c) in enumerate(rows)]
    assert sorted(tuple(r) for r in topk_search.top_k(frame).collect()) == sorted(wanted)
    wide = spark.createDataFrame([(i, [1e6 * i, 2.0]) for i in range(40)], "vec_id bigint, embedding array<double>")
    assert {tuple(r) for r in topk_search.top_k(wide, 1).collect()} == {(0, 1, 1, 128 * 128), (20, 1, 39, 64**2 * 10**12 * 20 * 39 + 128 * 128)}
    try:
        topk_search.top_k(wide.selectExpr("vec_id", "transform(embedding, x -> 1e5 * x) as embedding")).collect()
        raise AssertionError("a score beyond 64 bits was given")
    except Exception as e:
        assert "OverflowError" in str(e)


def test_sketches_decide_candidates(spark, monkeypatch):
    rng = random.Random(22)
    items = [(i, words_of(rng, 12 + 5 * i)) for i in range(8)]
    rows = [(100 + i, f"{words_of(rng, 40)} {text} {words_of(rng, 3)}") for i, text in items] + [(200 + i, f"{items[3][1]} {words_of(rng, 5)}") for i in range(60)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, h int, item_key string")
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id, r.n_shared) for r in decontamination.contaminated(docs, table).collect()}

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    wanted = {(d, i, len(shingles(t) & shingles(s))) for d, t in rows for i, s in items if len(shingles(t) & shingles(s)) >= 0.8 * len(shingles(s))}
    assert found == wanted and len(wanted) == 68
    whole = decontamination.item_sketches
    monkeypatch.setattr(decontamination, "item_sketches", lambda sets, c: whole(sets.where("item_id <> 3"), c))
    assert {r.item_id for r in decontamination.contaminated(docs, table).collect()} == set(range(8)) - {3}


def made_page(rng, host):
    """(html, article text): a page as its host makes them."""
    sentence = lambda n: words_of(rng, n).capitalize() + rng.choice([".", " &amp; co.", " <b class=\"ad-hoc\">so</b>.", " <i>yes</i>!"])
    paragraphs = [sentence(rng.randrange(4, 40)) for _ in range(rng.randrange(1, 9))]
    body = "".join(f"<p>{p}" + rng.choice(["</p>", "", "</p>\n"]) for p in paragraphs)
    plain = [html.unescape(re.sub("<[^>]*>", "", p)).strip() for p in paragraphs]
    around = lambda n: f"<a href='/{rng.random()}'>{words_of(rng, n)}</a>"
    menu, ad = f"<nav><ul><li>{around(1)}<li>{around(2)}</ul></nav>", f"<div class='ad-box promo'>{words_of(rng, rng.randrange(3, 20))}</div>"
    side = f"<div class='sidebar'><h3>{words_of(rng, 2)}</h3>{around(4)}</div>"
    remarks = f"<section id='comments'><h2>Said</h2><article><p>{words_of(rng, 30)}</p></article></section>"
    cookie = f"<div class='cookie-notice'>{words_of(rng, 9)} <button>ok</button></div>"
    form = f"<form><label>{words_of(rng, 1)}</label><input><textarea>x</textarea>{words_of(rng, 2)}</form>"
    made = (
        f"<article class='post p{rng.randrange(99)}'>{body}{form}</article>{side}{remarks}",
        f"<div class='layout no-sidebar'><div class='entry-content'>{body}{ad}</div>{side}</div>{remarks}",
        f"<div id='main' class='content has-sidebar share-enabled'>{body}</div><aside>{words_of(rng, 12)}</aside>{cookie}",
        f"<form id='all'><table><tr><td class='nav-menu'>{around(3)}</td><td class='story'>{body}</td></tr></table></form>",
    )[host]
    return f"<html><head><title>{words_of(rng, 3)}</title><style>p{{}}</style></head><body class='single comments-open'>{menu}{cookie}{made}{ad}<script>1 < 2</script><footer>{words_of(rng, 6)}</footer></body></html>", " ".join(plain)


def test_html_finds_known_articles(spark):
    rng = random.Random(23)
    made = [(i, f"http://h{i % 4}.net/{i}", *made_page(rng, i % 4)) for i in range(120)]
    frame = spark.createDataFrame([(i, u, h, "x") for i, u, h, _ in made], "page_id bigint, url string, html string, path string")
    found = {r.page_id: r.text for r in html_extraction.extract_main_text(frame).collect()}
    shares = []
    for i, _, _, text in made:
        a, b = Counter(found[i].split()), Counter(text.split())
        both = sum((a & b).values())
        shares.append(2 * both / max(1, sum(a.values()) + sum(b.values())))
    assert np.mean(shares) >= 0.95 and min(shares) >= 0.6, (np.mean(shares), min(shares))


def test_html_broken_pages_in_linear_time():
    import time

    for page in ('<a "' * 40_000, "<![CDATA[" * 40_000, '<div class="a b">' * 20_000 + "x", "<b>" * 30_000 + "</i>" * 30_000 + "x", "<svg>" * 30_000, "<script" * 30_000, '<a "x>y" "' * 30_000, "<" * 200_000, "<a '" * 30_000 + ">"):
        began = time.time()
        html_extraction.text_in(page)
        assert time.time() - began < 5, page[:20]


def plain_score(net, body):
    sums = [[sum(float(net.tables[k][body[j + k] if j + k < len(body) else 0][f]) for k in range(quality.SPAN)) for f in range(quality.FILTERS)] for j in range(len(body))]
    blocks = (len(body) + quality.SPAN - 1) // quality.BLOCK + 1
    chunks = max(1, -(-(blocks - quality.CHUNK) // quality.STEP) + 1)
    active = []
    for c in range(chunks):
        inside = sums[c * quality.STEP * quality.BLOCK : min(blocks, c * quality.STEP + quality.CHUNK) * quality.BLOCK]
        active.append([max(0.0, max((s[f] for s in inside), default=-1e9) + float(net.bias[f])) for f in range(quality.FILTERS)])
    features = [sum(a[f] for a in active) / chunks for f in range(quality.FILTERS)] + [max(a[f] for a in active) for f in range(quality.FILTERS)]
    hidden = [max(0.0, sum(features[i] * net.w1[i][h] for i in range(len(features))) + net.b1[h]) for h in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(hidden[h] * net.w2[h][0] for h in range(quality.HIDDEN)) + net.b2[0]))))


def test_quality_by_plain_loop(spark):
    rng = random.Random(24)
    rows = [(i, words_of(rng, 50) if i % 3 else words_of(rng, 30).replace(" ", " !! ")) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)] + [(4, 0, 0)], "doc_id bigint, quality int, toxic int")
    docs = lambda r: spark.createDataFrame([(*x, "s") for x in r], "doc_id bigint, text string, score string")
    net = quality.train_quality(docs(rows), labels)
    asked = rows[:12] + [(500, None), (501, ""), (502, "x"), (503, words_of(rng, 400)), (503, rows[0][1])]
    found = quality.score_quality(docs(asked), net).collect()
    assert sorted((str(r.doc_id), round(r.score, 4)) for r in found) == sorted((str(d), round(plain_score(net, (t or "").encode()), 4)) for d, t in asked)


def test_quality_learns_from_whole_texts_of_one_row_an_id(spark):
    rng = random.Random(25)
    long = words_of(rng, 40_000)
    docs = spark.createDataFrame([(1, long), (2, "b b"), (2, "a a"), (3, None), (4, "no label"), (9, "z" * 300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0), (9, None), (8, 1)], "doc_id bigint, quality int")
    rows = lambda **k: {(r.doc_id, r.text, r.quality) for r in quality.training_rows(docs, labels, **k).collect()}
    assert len(long) > 200_000 and rows() == {(1, long, 1), (2, "a a", 0), (3, "", 1)}
    assert len(rows(sample=2)) <= 2 and all(len(t) <= 100 for _, t, _ in rows(sample_bytes=100))


def plain_spans(text):
    """(start, stop, kind) by start, then kind: each weak secret is held against each base span and each other part."""
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    others = [m.span() for m in secrets.IDENTIFIER.finditer(text)]
    for m in secrets.ENDPOINT.finditer(text):
        user = secrets.USERINFO.match(text, m.start(), m.end())
        others.append((user.end() if user else m.start(), m.end()))
    linked = []
    for m in secrets.SECRET.finditer(text):
        a, b = m.span()
        if secrets.looks_random(m[0]) and not any(a < y and x < b for x, _, y, _ in spans) and any((y <= a or x >= b) and x <= b + 200 and y >= a - 200 for x, y in others):
            linked.append((a, 3, b, "linked"))
    return [(a, b, kind) for a, _, b, kind in sorted(spans + linked)]


def plain_redacted(text, spans):
    out, at = "", 0
    for a, b, _ in sorted(spans, key=lambda s: (s[0], -s[1])):
        out += (text[at:a] + "[secret]") if a >= at else ""
        at = max(at, b)
    return out + text[at:]


def test_secrets_by_brute_force(spark):
    rng = random.Random(26)
    weak = lambda n=24: "".join(rng.choice("abcXYZ0123456789qwRT-_/+") for _ in range(n))
    parts = [
        lambda: f'password = "{weak(10)}"', lambda: f"api_key:{weak(5)}", lambda: f"Token={weak(30)}", lambda: "AKIA" + weak(14).upper().replace("-", "Q").replace("_", "Z").replace("/", "7").replace("+", "8"), lambda: "%064x" % rng.getrandbits(256),
        lambda: "%020x" % rng.getrandbits(80), lambda: f"user = bob{rng.randrange(9)}", lambda: f"client_id: {weak(22)}", lambda: f"https://a.example.net/{weak(26)}", lambda: f"ftp://bob:{weak(21)}@h.net/x", lambda: "host: db.example.org", weak, lambda: weak(150),
        lambda: words_of(rng, rng.choice([3, 20, 60])), lambda: "é漢😀", lambda: "key_id=ASIA" + weak(16).upper().replace("-", "A").replace("_", "B").replace("/", "C").replace("+", "D"),
    ]
    texts = [rng.choice([" ", "\n", ", ", ""]).join(rng.choice(parts)() for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    seen = Counter()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, _spans string, base int")
    found = {r.doc_id: [(s.start, s.stop, s.kind) for s in r.spans] for r in secrets.scan_secrets(docs).collect()}
    for i, text in enumerate(texts):
        wanted = plain_spans(text)
        seen.update(k for _, _, k in wanted)
        assert found[i] == wanted, text
    assert min(seen[k] for k in secrets.KINDS) > 20
    left = {r.doc_id: r for r in secrets.redact_secrets(docs).collect()}
    for i, text in enumerate(texts):
        assert left[i].text == plain_redacted(text, found[i]) and left[i]._spans == "x"


def test_language_by_plain_sums(spark):
    rng = random.Random(27)
    vocabulary = {"aa": "tok lum peri sana".split(), "bb": "wix gnoz drub hyrl".split(), "cc": "tok drub oont".split()}
    text = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    docs = [(i % 40, text(k, 30), k) for i, k in enumerate(["aa", "bb", "cc", "aa"] * 30)] + [(7, None, "aa"), (8, "x", None), (None, "y", "bb"), (1, "", "bb"), (3, text("cc", 60_000), "cc")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, lang string, part int")
    model = language_id.train_language(frame, 10_000)
    used = {(d, t, k) for d, t, k in docs if None not in (d, t, k)}
    for i, name in enumerate(model.languages):
        counts = np.full(language_id.TABLE, 0.02)
        for _, t, k in used:
            if k == name:
                np.add.at(counts, language_id.trigrams(t), 1)
        assert np.allclose(model.table[i], np.log(counts / counts.sum()), atol=1e-5)
    pages = [(i, f"http://{rng.choice('xyz')}.{k}{rng.randrange(2)}.{rng.choice(['net', 'org'])}/{i}", f"<html lang={rng.choice([k, 'aa'])}><p>{text(k, rng.choice([0, 1, 40]))}") for i, k in enumerate(["aa", "bb", "cc"] * 20)]
    pages += [(0, pages[0][1], pages[0][2]), (90, None, None), (91, "", ""), (92, "http://x.aa0.net", "<p>" + text("bb", 50_000))]
    found = language_id.identify_languages(spark.createDataFrame([(*p, "z", 0.5) for p in pages], "page_id bigint, url string, html string, lang string, evidence double"), model).collect()
    size = len(model.languages)
    logs, keys = [], []
    for _, url, page in pages:
        m = re.search(r"<html\b[^>]*?\blang\s*=\s*([a-z]+)", page or "")
        t = language_id.trigrams(re.sub("<[^>]*>", " ", page or ""))
        logs.append([sum(float(x) for x in model.table[i][t]) * min(1.0, language_id.EVIDENCE / max(len(t), 1)) for i in range(size)])
        host = (url or "").partition("://")[2].partition("/")[0]
        keys.append({"host": host, "domain": ".".join(host.split(".")[-2:]), "suffix": host.split(".")[-1], "declared": m[1] if m else ""})

    def posterior(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    own = [posterior(x) for x in logs]
    sums = defaultdict(lambda: [0.0] * size)
    for k, p in zip(keys, own):
        for name, value in k.items():
            sums[name, value] = [a + b for a, b in zip(sums[name, value], p)]
    whole = [sum(p[i] for p in own) for i in range(size)]
    count, c = sum(whole), language_id.STRENGTH
    wanted = []
    for (page_id, _, _), k, p, x in zip(pages, keys, own, logs):
        total = []
        for i in range(size):
            less = lambda name: max(sums[name, k[name]][i] - p[i], 0.0)  # noqa: B023, E731
            n = lambda name: max(sum(sums[name, k[name]]) - 1, 0.0)  # noqa: B023, E731
            domain = (less("domain") + c * (whole[i] + 1) / (count + size)) / (n("domain") + c)
            v = x[i] + math.log((less("host") + c * domain) / (n("host") + c))
            for name in ("suffix", "declared"):
                if k[name]:
                    v += math.log((less(name) + c * sum(sums[name, k[name]]) / max(count, 1.0)) / (whole[i] + c))
            total.append(v)
        best = posterior(total)
        wanted.append((page_id, k["declared"], model.languages[best.index(max(best))], round(max(best), 3)))
    assert sorted((r.page_id, r.declared, r.lang, round(r.probability, 3)) for r in found) == sorted(wanted)


def test_url_filter_by_walks(spark):
    rng = random.Random(28)
    hosts = ["good.org", "a.good.org", "bad.com", "x.bad.com", "other.net", "third.de"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['', 'ok/', 'p/'])}{i}" + rng.choice(["", "?q=1", "#f"]) for i in range(160)]
    links = [rng.choice([None, None, rng.choice(urls), f"http://{rng.choice(hosts)}/far{rng.randrange(9)}"]) for _ in urls]
    long = "http://other.net/" + "l" * 100_000
    forms = [lambda u: f'<link rel="canonical" href="{u}">', lambda u: f"<META http-equiv=refresh content='3;URL={u}'>"]
    rows = [(i, u, rng.choice(forms)(v) if v else "<p>x") for i, (u, v) in enumerate(zip(urls, links))] + [(500, long, forms[0]("http://bad.com/1")), (0, urls[0], "<p>x")]
    rules = [("good.org", "/", "allow"), ("bad.com", "/", "block"), ("bad.com", "/ok/", "allow"), ("x.bad.com", "/p/", "block"), ("bad.com", "/", "block")]
    table = spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, component string")
    found = sorted((r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(table, spark.createDataFrame(rules, "host string, path string, action string")).collect())
    key = lambda u: u.split("://", 1)[1].split("#")[0]

    def ruled(k):
        host, path = k.split("/")[0], "/" + k.partition("/")[2].split("?")[0]
        fits = [(len(h + p), a == "allow", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, None)

    near = defaultdict(set)
    for _, u, page in rows:
        m = re.search(r"""(?:href="|URL=)([^"']*)""", page)
        if m:
            near[key(u)].add(key(m[1]))
            near[key(m[1])].add(key(u))
    wanted = []
    for i, u, _ in rows:
        seen, waiting = {key(u)}, [key(u)]
        for k in waiting:
            fresh = near[k] - seen
            seen |= fresh
            waiting += fresh
        rule, verdict = ruled(key(u))
        actions = {ruled(k)[1] for k in seen}
        wanted.append((i, rule, verdict or ("allow" if "allow" in actions else "block" if "block" in actions else "allow")))
    assert found == sorted(wanted) and sum(r is None and v == "block" for _, r, v in wanted) > 3


def test_chat_trees_by_walks(spark):
    rng = random.Random(29)
    rows, wanted = [], {}
    for conv in range(12):
        n = rng.randrange(1, 30)
        parent = {i: rng.choice([None, *range(max(0, i - 4), i)]) if i else None for i in range(n)}
        score = {i: rng.choice([None, 0.0, 1.0, 2.5]) for i in range(n)}
        body = {i: rng.choice(["", None, "hi <|im_end|>", "<\\|x", "é漢"]) for i in range(n)}
        role = {i: rng.choice(["user", "assistant", None]) for i in range(n)}
        rows += [(conv, i, parent[i], role[i], body[i], score[i]) for i in range(n)]
        paths = []
        for leaf in set(range(n)) - set(parent.values()):
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            paths.append((-sum(score[i] or 0.0 for i in path), leaf, [(role[i] or "", body[i] or "") for i in reversed(path)]))
        for k, (s, leaf, turns) in enumerate(sorted(paths)[:3]):
            wanted[conv, k + 1] = (leaf, -s, turns, "".join(t for r, t in turns if r == "assistant"))
    rows += [rows[0], (*rows[0][:2], rows[0][2], "zz", "later", 9.0), (5, None, None, "user", "no node", 1.0), (77, 1, 1, "user", "a loop", 1.0)]
    rows += [(99, 0, None, "assistant", "long " * 200_000, 0.0)]
    wanted[99, 1] = (0, 0.0, [("assistant", "long " * 200_000)], "long " * 200_000)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, node bigint, parent bigint, role string, text string, score double, up string")
    back = chat_format.read_back(chat_format.format_reply_trees(frame, 3)).collect()
    assert {(r.conv_id, r.branch): (r.leaf, r.score, [(t.role, t.text) for t in r.turns], r.loss_text) for r in back} == wanted
