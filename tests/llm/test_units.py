"""The operators' plain parts against brute force, without Spark."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quartzite.llm import bpe, hnsw, langid, pagetext, pii, simhash, tokenfile, topk_search
from quartzite.llm.queries import BYTE_BPE, WORD_BPE, vocabulary

ALPHABET = ["a", "B", "9", " ", "  ", "\n", "\t", ".", ",", "'s", "'ll", "é", "ß", "日", "😀", " ", "the ", "-", "ا", "½", "\r\n"]


def texts(n, longest, seed=1):
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("leaf", [1, 3, 17])
def test_bpe_tree_equals_library(leaf):
    encoding, pieces, lengths = bpe.codec(vocabulary(BYTE_BPE))
    encode = lambda s: np.array(encoding.encode_ordinary(s), np.uint32)
    for t in texts(60, 400) + ["", " " * 500, "a" * 3000, "\n" * 100 + "x", "日" * 700]:
        ids = bpe.encode_tree(t, encode, lengths, leaf)
        assert ids.tolist() == encoding.encode_ordinary(t)
        assert bpe.decode_tree(ids, pieces, 5) == t.encode()


def test_word_tokenizer_equals_library():
    coder = tokenfile.WordTokenizer(vocabulary(WORD_BPE), most=50)
    some = texts(200, 300) + ["", "Straße ÀÉ İstanbul", "a<|endoftext|>b", "x\x1cy", "ﬁne ΑΣ", "it's we'll 12³ ½ª", "a.,b ... .'s it's. 3.14,15 ,x", ". , .", "a\x0b.\x0bb"]
    for lo in range(0, len(some), 20):
        for t, got in zip(some[lo : lo + 20], coder.encode(pa.array(some)[lo : lo + 20])):
            assert np.frombuffer(got, "<u2").tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 63, 64, 1000, 200_000])
def test_rans_round_trip(n):
    r = np.random.default_rng(n)
    s = np.minimum(r.zipf(1.3, n), 49_407).astype("<u2")
    f = tokenfile.frequency_table(np.bincount(s, minlength=1 << 16))
    assert f.sum() == 1 << tokenfile.SCALE and (f[np.unique(s)] > 0).all()
    freq = f.astype(np.uint64)
    start = np.cumsum(freq) - freq
    states, words = tokenfile.rans_encode(s, freq, start, tokenfile.lanes_for(n))
    assert (tokenfile.rans_decode(n, states, words, freq, start, np.repeat(np.arange(1 << 16, dtype=np.uint16), f)) == s).all()
    with pytest.raises((ValueError, IndexError)):
        broken = words.copy()
        if not len(broken):
            raise ValueError
        broken[0] ^= 1 << 30
        tokenfile.rans_decode(n, states, broken[:-1], freq, start, np.repeat(np.arange(1 << 16, dtype=np.uint16), f))


def test_ids_of_a_large_vocabulary():
    assert tokenfile.id_type(1 << 16) == "<u2" and tokenfile.id_type((1 << 16) + 1) == "<u4"
    r = np.random.default_rng(0)
    s = r.integers(0, 200_000, 50_000).astype("<u4")
    f = tokenfile.frequency_table(np.bincount(s, minlength=200_000))
    freq = f.astype(np.uint64)
    start = np.cumsum(freq) - freq
    states, words = tokenfile.rans_encode(s, freq, start, 64)
    assert (tokenfile.rans_decode(len(s), states, words, freq, start, np.repeat(np.arange(200_000, dtype="<u4"), f)) == s).all()


def test_frequency_table_extremes():
    n = np.zeros(1 << 16, np.int64)
    n[:49_000] = 1
    n[5] = 10**12
    f = tokenfile.frequency_table(n)
    assert f.sum() == 1 << tokenfile.SCALE and (f[:49_000] > 0).all()
    one = np.zeros(1 << 16, np.int64)
    one[7] = 3
    assert tokenfile.frequency_table(one)[7] == 1 << tokenfile.SCALE


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_equals_plain_patterns():
    r = random.Random(3)
    parts = ["a", "b.c", "@", "@x.y", ".", "1", "25", "255", "300", " ", "-", "+", "+1 ", "(5) ", "4111111111111111", "4111 1111 1111 1111", "555-0100", "é", "\n", "10.0.0.1", "%", "_"]
    for _ in range(3000):
        t = "".join(r.choices(parts, k=r.randint(0, 25)))
        assert pii.spans(t)[0] == plain_spans(t), t
    assert pii.spans("1" * 200_000 + "a" * 200_000 + "@")[0] == []


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("Write to jane dot doe at example dot com now", "email", "jane dot doe at example dot com"),
        ("mail: jane.doe (at) example [dot] org.", "email", "jane.doe (at) example [dot] org"),
        ("mail jane＠example．com!", "email", "jane＠example．com"),
        ("mail jаne@exаmple.com!", "email", "jаne@exаmple.com"),
        ("call plus one four one five five five five two six seven one today", "phone", "plus one four one five five five five two six seven one"),
        ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
        ("host １０.1.2.3 is up", "ip", "１０.1.2.3"),
        ("jane​@example.com", "email", "jane​@example.com"),
        ("mail jane at example.com today", "email", "jane at example.com"),
        ("mail jane@example dot com.", "email", "jane@example dot com"),
        ("mail jane_at_example_dot_com now", "email", "jane_at_example_dot_com"),
        ("mail jane dot doe at example dot cloud now", "email", "jane dot doe at example dot cloud"),
        ("escribe a juan arroba ejemplo punto es hoy", "email", "juan arroba ejemplo punto es"),
        ("an max [at] beispiel [punkt] de.", "email", "max [at] beispiel [punkt] de"),
        ("mail j.doe(at)example.com", "email", "j.doe(at)example.com"),
        ("mail jane@exampıe.com", "email", "jane@exampıe.com"),
        ("tarjeta cuatro uno uno uno uno uno uno uno uno uno uno uno uno uno uno uno ya", "card", "cuatro uno uno uno uno uno uno uno uno uno uno uno uno uno uno uno"),
        ("carte quatre un un un, un un un un, un un un un, un un un un voilà", "card", "quatre un un un, un un un un, un un un un, un un un un"),
        ("Ruf plus vier neun drei null eins zwei drei vier fünf sechs sieben an", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs sieben"),
        ("card 4l11 1111 1111 111l ok", "card", "4l11 1111 1111 111l"),
        ("card four triple one 1111 1111 1111 ok", "card", "four triple one 1111 1111 1111"),
        ("host one nine two dot one six eight dot zero dot one up", "ip", "one nine two dot one six eight dot zero dot one"),
        ("host 192 (dot) 168 (dot) 0 (dot) 1 up", "ip", "192 (dot) 168 (dot) 0 (dot) 1"),
    ],
)
def test_pii_disguises(text, kind, part):
    base, added = pii.spans(text)
    at = text.index(part)
    assert (at, pii.KINDS.index(kind), at + len(part)) in added or (at, pii.KINDS.index(kind), at + len(part)) in base


@pytest.mark.parametrize(
    "text",
    [
        "Look at the dot on the map. One of two men at home, three times four. Élan à côté; naïve · 5–6.",
        "Visit us at example.com or look at example dot com. Met her at St.Pauli point de vue.",
        "Uno de dos, un deux trois quatre, eins zwei drei; B2B in 5S and 1O reasons, look_at_this.file, v1.0 at 10.5",
    ],
)
def test_pii_clean_prose_stays_clean(text):
    assert pii.spans(text) == ([], [])


def test_fingerprint_by_bits():
    import xxhash

    for t in ["", "One", "a b", "A b\tc d e\n" * 7, "été x y z w"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))
        assert simhash.fingerprint(t.encode()) == want


@pytest.mark.parametrize("h", [2, 8, 16])
def test_topk_kernel_equals_brute_force(h):
    r = np.random.default_rng(5)
    c = np.floor(r.normal(size=(700, 16)) * r.lognormal(size=(700, 1)) * 20)
    c[100:200] = c[0]
    q, ids = c[::50], np.arange(700) * 3
    qi, who, score = topk_search.scan_shard(ids[::50], q, np.full(len(q), topk_search.LEAST), ids, c, 10, 64, 5, (topk_search.rotation_of(c)[0], [h]))
    for i in range(len(q)):
        s = (c @ q[i]).astype(int)
        want = sorted((-x, j) for x, j in zip(s, ids) if j != ids[::50][i])[:10]
        assert sorted((-x, j) for k, j, x in zip(qi, who, score) if k == i) == want


def test_topk_scores_of_huge_vectors():
    """Beyond 2^53 scores are exact, beyond a long they are its end, and nothing overflows on the way."""
    r = np.random.default_rng(6)
    c = np.concatenate([np.rint(r.normal(size=(40, 4)) * 10**k) for k in (2, 8, 12, 200)])
    q, ids = c[::9], np.arange(len(c))
    qi, who, score = topk_search.scan_shard(ids[::9], q, np.full(len(q), topk_search.LEAST), ids, c, 10, 16)
    for i in range(len(q)):
        s = [max(topk_search.LEAST, min(topk_search.MOST, sum(int(a) * int(b) for a, b in zip(q[i], x)))) for x in c]
        want = sorted((-x, j) for j, x in enumerate(s) if j != ids[::9][i])[:10]
        assert sorted((-int(x), j) for k, j, x in zip(qi, who, score) if k == i) == want


def test_hnsw_recall_and_split_graphs():
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 32))
    x[:1000] = x[0] + r.normal(size=(1000, 32)) * 1e-3
    nodes, links = hnsw.build(x)
    q = x[::30]
    at = hnsw.search(q, hnsw.lifted(x), nodes, links, 128)
    hit = 0
    for i in range(len(q)):
        hit += len(set(np.argsort(-(x @ q[i]))[:20]) & set(at[i]))
    assert hit / (20 * len(q)) >= 0.9
    for n in (1, 2, 5, 70):
        nodes, links = hnsw.build(x[:n])
        assert set(hnsw.search(q, hnsw.lifted(x[:n]), nodes, links, 128)[0]) - {-1} == set(range(n))


def test_grams_and_model_without_letters():
    for t in ("123 !?", "😀", "👍🏽 12", "𝟙𝟚", "\U0010ffff"):
        assert len(langid.grams(t)[0]) == 0
    assert len(langid.grams("𐐀")[0]) and len(langid.grams("𝐀")[0])  # letters beyond 0xffff
    at, n = langid.grams("Aa")
    assert n.sum() == 3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice"><div>We use</div> cookies</div>
<article><h1>Ti&amp;tle &lt;x&gt;</h1><p>One <b>two</b>
   three.<p>Be.<br>So</p><div class="ad">Buy</div><p>a < b</p><!-- <p>gone</p> --><form>Name<input></form><section id=comments><p>Nice!</p></section></article>
<aside>More</aside><footer>&copy; x</footer></body></html>"""


def test_page_text():
    assert pagetext.main_text(PAGE) == "Ti&tle <x>\n\nOne two three.\n\nBe. So\n\na < b"
    assert pagetext.main_text(None) == pagetext.main_text("") == pagetext.main_text("<nav>x</nav>") == ""
    assert pagetext.main_text("<article><p>cut o") == "cut o"
    assert pagetext.main_text("<article><p>cut</p><p cla") == "cut"


@pytest.mark.parametrize("mark", ['article class="post"', 'main', 'div class="entry-content"', 'div id="content"', 'div itemprop="articleBody"', 'section class="story"'])
def test_page_marks_of_the_article(mark):
    name = mark.split()[0]
    page = f"""<body class="post content"><div id="header"><p>The Site.</p></div><div class="main-menu"><p>Menu here.</p></div><{mark}><h1>T</h1><p>A.</p><ul><li>x</li><li>y</li></ul>
<div class="comments"><p>Nice one.</p></div><p class=notice>Paid.<p>B</p><div hidden>h</div></{name}><div class="sidebar"><p>Side.</p></div><p>Outside.</p></body>"""
    assert pagetext.main_text(page) == "T\n\nA.\n\nx\n\ny\n\nB"


def test_page_without_article():
    body = "".join(f"<p>{'word ' * 40}{i}.</p>" for i in range(4))
    page = f"<div>My site</div><ul><li><a href=a>Home</a></li><li><a href=b>About us</a></li></ul><h2>Head</h2>{body}<p>End.</p><div><a href=c>Imprint</a></div><div>Made with care</div>"
    got = pagetext.main_text(page).split("\n\n")
    assert got[0] == "Head" and got[1].endswith("0.") and got[-1] == "End." and len(got) == 6


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<main><article><h1>Head</h1><p>The main text of it.</p></article></main><section class='latest'><article>teaser</article></section>", "Head|The main text of it."),
        ("<main><h1>Head</h1><article><p>Body one.</p><p>Two.</p></article><div class='related-posts'><p>More</p></div></main>", "Head|Body one.|Two."),
        ("<article><p class='warning'>Hot.</p><div class='social-science'><p>Study.</p></div><div id='search-results'><p>Found.</p></div></article>", "Hot.|Study.|Found."),
        ("<article><p>Press the <button>Save</button> key.</p><p><button>Share</button></p><div class='ad-slot'>Buy</div><ul class='share-buttons'><li>X</li></ul></article>", "Press the Save key."),
        ("<p>Intro</p><p>" + "word " * 60 + "</p><ul><li>milk</li><li>eggs</li><li>flour</li><li>salt</li></ul>", "Intro|" + ("word " * 60).strip() + "|milk|eggs|flour|salt"),
        ("<p>" + "word " * 60 + "</p><p>see also</p>", ("word " * 60).strip() + "|see also"),
        ("<article>tiny</article><div>" + "<p>" + "word " * 60 + "</p></div>", "tiny|" + ("word " * 60).strip()),
        ("<article><p>A.</p><div class='reader-comments'><p>Nice.</p></div><div id='cookie-consent'>c</div><section class='sponsored-content'>s</section><div class='side-bar'>b</div><div class='new-products'>kept</div></article>", "A.|kept"),
        ("<article><p>A.</p><aside>x</aside><div role='complementary'>y</div><p>a&nbsp;&amp; b</p></article>", "A.|a & b"),
    ],
)
def test_pages_that_marks_or_lengths_decide(page, want):
    assert pagetext.main_text(page) == want.replace("|", "\n\n")


def test_page_text_keeps_wrapped_pages_and_linked_lines():
    p = "<p>" + "Some article text that is long enough to count as a paragraph of prose. " * 3 + "</p>"
    text = p[3:-4].strip()
    assert pagetext.main_text(f"<body><form action=x><div>{p}{p}</div></form></body>") == f"{text}\n\n{text}"
    linked = f"<article><h2><a href=x>A linked headline</a></h2>{p}{p}<p><a href=y>A closing paragraph that is a link</a></p></article>"
    assert pagetext.main_text(linked) == f"A linked headline\n\n{text}\n\n{text}\n\nA closing paragraph that is a link"
    small = "<form><p>Your name and address</p><input></form>"
    assert pagetext.main_text(f"<article>{p}{small}{p}</article>{small}") == f"{text}\n\n{text}"
    assert pagetext.main_text(f"<article>{p}{p}<ul><li><a href=z>Next page</a></li></ul></article>") == f"{text}\n\n{text}"


def test_bounds_decide_what_topk_scores():
    """On the test table under a third of all pairs is scored, and results are those of plain products."""
    import pyarrow.parquet as pq

    c = np.floor(1024 * np.stack(pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pandas().sort_values("vec_id").embedding.to_numpy()).astype(np.float64))
    ids = np.arange(len(c))
    q, q_id, tally = c[::100], ids[::100], []
    at, who, score = topk_search.scan_shard(q_id, q, np.full(len(q), topk_search.LEAST), ids, c, 10, tally=tally)
    full = (q @ c.T).astype(np.int64)
    for i in range(len(q)):
        want = sorted(((-s, j) for j, s in enumerate(full[i]) if j != q_id[i]))[:10]
        assert [(-s, w) for s, w in zip(score[at == i], who[at == i])] == want
    assert sum(tally) < len(q) * len(c) / 3


def test_surge_and_dive_against_brute_force():
    """Every stretch of up to three lines of one side, tried one by one."""
    rng = random.Random(5)
    for _ in range(2000):
        n = rng.randint(1, 12)
        size = [rng.choice((0, 0, 5, 20, 60, 300)) for _ in range(n)]
        side, now = [], True
        for _ in range(n):
            now = now if rng.random() < 0.7 else not now
            side.append(now)
        if not any(size):
            continue
        stretches = [range(i, j) for i in range(n) for j in range(i + 1, min(n, i + pagetext.WINDOW) + 1) if len(set(side[i:j])) == 1]
        total = lambda r: sum(size[i] for i in r)
        bar = min(pagetext.SURGE, max(map(total, stretches)) * pagetext.SHARE)
        high = {i for r in stretches if total(r) >= bar for i in r if size[i]}
        assert pagetext.surge_and_dive(size, side) == (min(high), max(high))


def test_densest_box_takes_its_heading_and_leaves_what_stands_around():
    text = "A paragraph of the article that is long enough to be more than a threshold of some eighty-six characters."
    p = f"<p>{text}</p>"
    around = "<div><a href=a>Home</a><a href=b>Shop</a></div>"
    page = f"<body><div>{around}<div><h1>Title</h1><p>By one</p></div><div>{p}{p}{p}<p>End.</p></div><div>Some offer</div><div>(c) Us</div></div></body>"
    assert pagetext.main_text(page) == f"Title\n\nBy one\n\n{text}\n\n{text}\n\n{text}\n\nEnd."
    split = f"<body><div>{p}{p}{p}{p}{p}</div><div>{around}</div><div>{p}</div></body>"
    assert pagetext.main_text(split).count(text) == 6
    assert pagetext.main_text("<div>" * 20000 + p) == text


def test_shards_grow_with_the_root_of_rows_and_beams_with_theirs():
    assert hnsw.shard_rows_for(0, 64) == hnsw.shard_rows_for(50_000, 64) == 8192
    assert hnsw.shard_rows_for(10**8, 64) == hnsw.shard_rows_for(10**10, 64) == 131072
    assert hnsw.shard_rows_for(10**6, 64) == 16_000 and hnsw.shard_rows_for(10**8, 4096) == 4096
    assert hnsw.beam_for(100, 192) == hnsw.beam_for(8192, 192) == 192 and hnsw.beam_for(32768, 192) == 384


def test_a_wider_beam_keeps_recall_in_a_larger_shard():
    x = np.random.default_rng(3).normal(size=(16384, 24))
    nodes, links = hnsw.build(x)
    q = x[:128]
    found = hnsw.search(q, hnsw.lifted(x), nodes, links, hnsw.beam_for(len(x), 192))
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found.tolist(), best.tolist())]) >= 0.9
