"""Kernels against plain versions of themselves."""

import random
import re

import numpy as np
import xxhash

from strandforge.llm import decontaminate, html, language, pii, quality, simhash, toxicity


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_is_the_majority_of_shingle_hashes():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 9, 400):
        text = "\t".join(rng.choice(["Aé", "the", "Of", "x y", "ÉLAN"]) for _ in range(n))
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_tree_finds_all_links_of_every_layout():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce(np.array([1 << int(b) for b in rng.integers(0, 64, 3)], np.uint64)) for _ in range(120)]
    values = np.unique(np.concatenate([base, [base[i % 40] ^ f for i, f in enumerate(flips)]]))
    want = {(int(a), int(b)) for a in values for b in values if a < b and int(a ^ b).bit_count() <= 4}
    got = set()
    for node, near in simhash.BKTree(values).visit(values, 4):
        got |= {(min(int(values[node]), int(values[k])), max(int(values[node]), int(values[k]))) for k in near if k != node}
    assert got == want
    for n in (100, 1 << 21, 1 << 40):
        keys = simhash.shard_bits(n)
        for a, b in want:
            assert any(all((a >> s) % (1 << (e - s)) == (b >> s) % (1 << (e - s)) for s, e in k) for k in keys)


def _classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_spanning_links_keep_the_components():
    rng = np.random.default_rng(5)
    values = np.unique(np.concatenate([[b ^ np.uint64(1 << int(k)) for k in rng.integers(0, 64, 12)] for b in rng.integers(0, 1 << 63, 12, dtype=np.uint64)]))
    at = {int(v): i for i, v in enumerate(values)}
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 4]
    left, right = values[::2], values[1::2]
    within = simhash.spanning_links(values, None, 4)
    assert len(within) < len(values)
    assert _classes(len(values), [(at[a], at[b]) for a, b in within]) == _classes(len(values), pairs)
    parts = simhash.spanning_links(left, None, 4) + simhash.spanning_links(right, None, 4) + simhash.spanning_links(left, right, 4)
    assert _classes(len(values), [(at[a], at[b]) for a, b in parts]) == _classes(len(values), pairs)


def test_alignment_scores():
    sw = lambda a, b: decontaminate.smith_waterman(np.array(a), np.array(b))

    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    rng = random.Random(2)
    for _ in range(60):
        a = [rng.randint(1, 6) for _ in range(rng.randint(1, 14))]
        b = [rng.randint(0, 6) for _ in range(rng.randint(0, 25))]
        assert sw(a, b)[0] == plain(a, b)
    assert sw([1, 2, 3, 4], [9, 9, 1, 2, 3, 4, 9]) == (8, 2, 6)
    assert sw([1, 2, 3, 4, 5, 6], [9, 1, 2, 9, 3, 4, 5, 6]) == (11, 1, 8)


def test_pii_patterns_match_plain_search():
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b@", "@", ".", "c.d", " ", "%", "-", "x@y.z"]) for _ in range(rng.randint(0, 20)))
        assert list(pii._emails(text)) == [m.span() for m in pii.EMAIL.finditer(text)]
        dots = "".join(rng.choice("12..x ") for _ in range(rng.randint(0, 40)))
        assert [m.span() for m in pii._IP_RUNS.finditer(dots)] == [m.span() for m in pii.IP.finditer(dots)]
    assert pii.detect("7" * 300_000) == []
    found = pii.detect("mail me.x@host.example.com, 10.0.0.255 or 10.0.0.256; 4111 1111 1111 1111, +49 (30) 123-4567.")
    assert [k for k, *_ in found] == ["email", "ip", "card", "phone"]


def test_disguised_identifiers_map_back():
    for text, kind, span in [
        ("write to john [at] mail [dot] example [dot] com now", "email", "john [at] mail [dot] example [dot] com"),
        ("write jane at mail dot example dot org today", "email", "jane at mail dot example dot org"),
        ("jоhn@exаmple.com!", "email", "jоhn@exаmple.com"),
        ("call plus four nine three zero one two three four five six", "phone", "plus four nine three zero one two three four five six"),
        ("ｊｏｅ＠ｅｘ.com", "email", "ｊｏｅ＠ｅｘ.com"),
        ("a​@b.de x", "email", "a​@b.de"),
        ("ip one two seven dot zero dot zero dot one ok", "ip", "one two seven dot zero dot zero dot one"),
        ("card 4lll 1111 1l11 1111.", "card", "4lll 1111 1l11 1111"),
        ("card ٤١١١ ١١١١ ١١١١ ١١١١", "card", "٤١١١ ١١١١ ١١١١ ١١١١"),
        ("joe_at_mail_dot_com", "email", "joe_at_mail_dot_com"),
        ("x joe&#64;mail.com", "email", "joe&#64;mail.com"),
        ("joe @ mail . com", "email", "joe @ mail . com"),
        ("a joe(at)mail(dot)co(dot)uk b", "email", "joe(at)mail(dot)co(dot)uk"),
    ]:
        base, spans = pii.find_pii(text)
        assert (kind, span) in [(k, text[s:e]) for k, s, e in spans], (text, spans)
        assert set(base) <= set(spans)
    for clean in ("he looked at the dot on the map. com", "one two three go", "they met at noon. Dots are fine", "a dot on x at y. Es for", ""):
        assert pii.find_pii(clean) == ([], [])
    assert pii.mask("x a@b.de y") == "x <email> y"


def test_worded_addresses_under_any_ending():
    for text, span in [
        ("mail anna at firm dot ch now", "anna at firm dot ch"),
        ("mail joe @ mail . it. Then", "joe @ mail . it"),
        ("ask joe @ mail . co . uk now", "joe @ mail . co . uk"),
        ("x eva_at_mail_dot_nl", "eva_at_mail_dot_nl"),
        ("bo at shop dot firm dot museum, or", "bo at shop dot firm dot museum"),
        ("al @ firm dot berlin", "al @ firm dot berlin"),
        ("al at firm dot amsterdam", "al at firm dot amsterdam"),
        ("a dot b: lea at firm.at", "lea at firm.at"),
        ("they met at home . lea at firm dot biz", "lea at firm dot biz"),
    ]:
        assert [(k, text[s:e]) for k, s, e in pii.find_pii(text)[1]] == [("email", span)], text
    for clean in ("we met at noon . it was @ home", "look at this dot matrix", "they sat at home . the dot on it", "he is @ home . it"[:9]):
        assert pii.find_pii(clean) == ([], []), clean


def test_quality_measures():
    assert quality.measure("") == (0, 0, 0, 0, 0)
    assert quality.measure("a b c a b c") == (6, 6, 0, 0, 6)
    assert quality.measure("a a a a") == (4, 4, 0, 0, 4)
    assert quality.measure("é # x\n\n\n \né # x") == (6, 6, 2, 1, 6)
    assert quality.measure("a b c d b c d e") == (8, 8, 0, 0, 6)
    assert quality.measure("x y z") == (2, 4, 0, 0, 0)


def _page(article, nav="Home", ad="Buy"):
    return f"<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><a>{nav}</a></nav><div class='ad'>{ad}</div>{article}<footer>&copy; x</footer></body></html>"


def test_article_text():
    get = lambda s: html.main_text(html.parse(s), {})
    assert get(_page("<article><h1>A &amp; B</h1><p><b>One<br><p>Two\n  three</p><div class='comments'><p>me too</p></div></article>")) == "A & B One Two three"
    assert get(_page("<article><header><h1>H</h1><span>by me</span></header><p>x <em>y</em>z</p><ul><li>p<li>q</ul><form>f</form><aside>s</aside></article>")) == "H x yz p q"
    assert get("") == "" and get("<p") == "" or get("<p") == "<p"
    assert get("<body><p>only text</p></body>") == "only text"
    assert get("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert get("a<b " * 20_000).startswith("a")
    assert html.template_of(html.parse("<div>" * 3000 + "x"), [html.parse("<div>" * 3000 + y) for y in "yz"]) == {}


def test_deep_and_long_tags_keep_the_article():
    get = lambda s: html.main_text(html.parse(s), {})
    deep = lambda inner, n=400: "<div>" * n + inner + "</div>" * n
    assert get(f"<body><article><p>one</p>{deep('two')}<p>three</p></article><div><p>foot</p></div></body>") == "one two three"
    assert get(f"<body>{deep('<nav><div>menu</div></nav><article><p>a</p><div>b</div><aside><div>no</div></aside>c</article><div>out</div>')}</body>") == "a b c"
    assert get(f"<body><article>{deep('<p>x<p>y</p>', 250)}<div class='comments'><p>me too</p></div>z</article></body>") == "x y z"
    assert get(f"<article><p data-x={'y' * 9000}>text</p></article>") == "text"
    assert get("<article>" + "<font>" * 3000 + "<p>a</p><p>b</p></article><footer>f</footer>") == "a b"


def test_article_without_article_tag():
    get = lambda s: html.main_text(html.parse(s), {})
    prose = "".join(f"<p>Sentence number {i} of the story goes on for a while.</p>" for i in range(5))
    want = " ".join(f"Sentence number {i} of the story goes on for a while." for i in range(5))
    for page in (
        f"<body class='has-sidebar'><div id='header'><h1>Site</h1></div><div class='menu'><a>x</a></div><div class='content with-sidebar'>{prose}</div><div class='sidebar'><p>Also read this one</p></div><div class='footer'>bye</div></body>",
        f"<body><header>Site name</header><main>{prose}<section id='comments'><h3>Comments</h3><p>{'nice text ' * 80}</p></section></main><div role='contentinfo'>c</div></body>",
        f"<body><table><tr><td class='nav'>a b c</td><td>{prose}</td></tr></table><div class='cookie-notice'>We use cookies</div><form><input><p>Sign up</p></form></body>",
    ):
        assert get(page) == want, page


def test_template_is_what_aligned_pages_repeat():
    body = lambda t: f"<body><div><p>Welcome to the site of all sites</p></div><div><p>{t}</p><p>{t[::-1]}</p></div></body>"
    pages = [html.parse(body(" ".join(f"w{k}{i}" for i in range(20)))) for k in range(4)]
    template = html.template_of(pages[0], pages)
    assert html.main_text(pages[0], template).startswith("w00") and "Welcome" not in html.main_text(pages[0], template)
    assert html.template_of(pages[0], [pages[0], pages[1]]) == {}  # one telling page proves nothing


def test_blanks_are_never_template():
    body = lambda k: "<article>" + "".join(f"<p><b>w{k}{i}</b> <i>v{k}{i}</i> and so on {k * 7 + i}</p>" for i in range(4)) + f"<div><p>end {k}</p></div></article>"
    pages = [html.parse(body(k)) for k in range(4)]
    text = html.main_text(pages[0], html.template_of(pages[0], pages[1:]))
    assert text.startswith("w00 v00 and so on 0 w01 v01")


def test_tree_matching_counts_pairs():
    a, b = html.parse("<div><p>x</p><ul><li>1</li></ul></div>"), html.parse("<div><p>y</p><ul><li>1</li><li>2</li></ul></div>")
    assert html._match(a, a, {}) == a.size == 7
    assert html._match(a, b, {}) == 7  # root, div, p and its slot, ul, li and its text


def test_tree_matching_is_the_best_of_all_pairings():
    def plain(a, b):
        if a.sign != b.sign:
            return 0
        table = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children, 1):
            for j, y in enumerate(b.children, 1):
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + plain(x, y))
        return 1 + table[-1][-1]

    rng = random.Random(4)

    def tree(depth):
        kids = "".join(rng.choice(["x", "y", "<br>", *([tree(depth - 1)] * 4 if depth else "z")]) for _ in range(rng.randint(0, 4)))
        tag = rng.choice(["div", "section", "span class=k"])
        return f"<{tag}>{kids}</{tag.split()[0]}>"

    for _ in range(300):
        a, b = html.parse(tree(3) + tree(2)), html.parse(tree(3) + tree(2))
        assert html._match(a, b, {}) == plain(a, b)


def test_wide_pages_align_in_linear_time():
    import time

    rows = lambda k, n: "<table>" + "".join(f"<tr><td>{'same ' if i % 50 == 0 else f'k{k}'} {i}</td><td class=c{i % 3}><b>v{k}</b> w{i * k}</td></tr>" for i in range(n)) + "</table>"
    began = time.time()
    a, b = (html.parse(f"<body><p>The site of all</p>{rows(k, 8000)}</body>") for k in (1, 2))
    same = html.constant_nodes(a, b)
    assert time.time() - began < 8
    assert len([x for x in html.body_texts(a) if id(x) in same]) >= 160


def test_deep_pairs_weigh_all_their_nodes():
    """Beyond any depth of recursion, two trees that differ at the bottom alone pair up in all but that."""
    tree = lambda inner, n: html.parse("<div><i>a</i>" * n + inner + "<b>z</b></div>" * n)
    for n in (10, 149, 151, 400, 5000):
        a, b = tree("<p>x</p>", n), tree("<ul><li>y</li></ul>", n)
        assert html._match(a, b, {}) == 1 + n * 5  # the root, and of each level div, i, b and their texts
    # the deeper of two places to pair with is worth more, though that shows only far down
    n = 300
    a = html.parse("<section>" + "<div>" * n + "<p>1</p><p>2</p>" + "</div>" * n + "</section>")
    b = html.parse("<section>" + "<div>" * n + "<em>1</em>" + "</div>" * n + "<div>" * n + "<p>3</p><p>4</p><p>5</p>" + "</div>" * n + "</section>")
    pairs = html._align(a.children[0].children, b.children[0].children, {})[1]
    assert pairs == [(0, 1)]


def test_deep_pages():
    deep = "<div>" * 100_000 + "<nav>Home Nav words</nav><p>story</p><p>more</p>" + "</div>" * 100_000 + "<footer>f</footer>"
    page = html.parse(deep)
    assert html.main_text(page, html.template_of(page, [html.parse(deep.replace("story", x).replace("more", x + "1")) for x in "abc"])) == "story more"
    assert html.main_text(html.parse(f"<article>{'<div>' * 205}<nav>Home</nav>text here{'</div>' * 205}<p>end</p></article>"), {}) == "text here end"


def test_names_beside_other_words_are_no_noise():
    get = lambda s: html.main_text(html.parse(s), {})
    sections = ["<section class='search-trees'><p>Search trees keep keys.</p></section>", "<section class='social-history'><p>The social history of it.</p></section>", "<div class='share price'>The share price rose.</div>", "<div class='menu-of-the-day'><p>Soup and bread.</p></div>"]
    assert get(f"<article><h1>T</h1>{''.join(sections)}<p>End.</p></article>") == "T Search trees keep keys. The social history of it. The share price rose. Soup and bread. End."
    noise = ["<div class='share-buttons'><a href=x>Share it</a></div>", "<div class='ad-slot ad-300'>Buy now</div>", "<div id=comments class='clearfix'><p>me too</p></div>", "<div class='related'><p>Read also</p></div>", "<ul class='social-icons-2x dark'><li><a>Tweet</a></li></ul>", "<div class='cookie-notice'>We bake</div>", "<div class='newsletter signup-form'><input>mail</div>"]
    assert get(f"<article><p>One.</p>{''.join(noise)}<p>Two.</p></article>") == "One. Two."


def _site(rng, k, article):
    """A page of a site whose names tell nothing; what of it is content."""
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    prose = [" ".join(word() for _ in range(rng.randint(8, 30))) for _ in range(rng.randint(2, 7))]
    shared = "This passage of ten words or more is in some pages only"
    if rng.random() < 0.3:
        prose.insert(rng.randint(0, len(prose)), shared)
    body = "".join(f"<p>{p}</p>" for p in prose)
    tag = "article" if article else "div class='k2'"
    end = "article" if article else "div"
    promise = "<div class='z1'>We never sell what you tell us and neither do our friends</div>"
    return f"<body><div class='q1'><span>The Daily Thing</span> <span>since 1900</span></div><{tag}>{promise}{body}<div class='z9'>Like what you read so far? Tell all of your friends</div></{end}><div class='w3'><p>All of this belongs to the Thing and to nobody else</p></div></body>", " ".join(prose)


def test_template_decides_where_names_tell_nothing():
    for article in (True, False):
        rng = random.Random(11)
        pages = [_site(rng, k, article) for k in range(40)]
        trees = [html.parse(x) for x, _ in pages]
        marks = [html.marks_of(t) for t in trees[:12]]
        got = [html.main_text(t, html.template_of(t, trees[:4], marks)) for t in trees]
        assert sum(g == w for g, (_, w) in zip(got, pages, strict=True)) >= 38
        assert all(html.main_text(t, {}) != g for t, g in zip(trees, got, strict=True))  # without the template all differ


def test_kernel_is_the_normalised_overlap():
    x, y = language.ngram_presence("The cat"), language.ngram_presence("the dog.")
    k = language.kernel([x], [y])[0, 0]
    assert abs(k - len(np.intersect1d(x, y)) / np.sqrt(len(x) * len(y))) < 1e-6
    assert len(language.ngram_presence("123 !?")) == 0 and len(language.ngram_presence("😀😀 12")) == 0
    assert len(language.ngram_presence("😀𐐀")) > 0  # a letter beyond the first plane


def test_folded_weights_equal_the_kernel_expansion():
    texts = ["der hund und die katze", "die maus und der mann", "the dog and the cat", "the mouse and a man"]
    p = [language.ngram_presence(t) for t in texts]
    model = language.fit(p, ["de", "de", "en", "en"], 2)
    assert model.predict(["the man and the mouse", "", "77"])[0] == ["en", "und", "und"]
    x = [language.ngram_presence(t) for t in ("ein hund und the cat", "a b c", "xyz")]
    full = np.zeros((language.BUCKETS, 2))
    full[model.buckets] = model.weights
    assert np.allclose(model.scores(x), [full[i].sum(axis=0) / np.sqrt(len(i)) for i in x], atol=1e-5)
    assert language.fit([], []).predict(["abc"]) == (["und"], [0.0])


def test_distance_model_without_training_text():
    assert toxicity.train_dictionaries([], []) is None
    m = toxicity.DistanceModel(b"", b"", 0, (0.5,))
    assert m.scorer()("whatever") == 0.5
    assert len(toxicity.sampled_words("a b c d " * 100, 7)) == 7


def test_calibration_counts_windows():
    rng = random.Random(3)
    plain, marked = (["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)] for _ in range(2))
    ordinary = [rng.choices(plain, k=30) for _ in range(300)]
    toxic = [rng.choices(plain, k=28) + rng.choices(marked[:10], k=2) for _ in range(300)]
    data = toxicity.train_dictionaries(toxic[:200], ordinary[:200])
    unseen = [(1, g) for g in toxicity.fold_gains(data, toxic[200:])] + [(0, g) for g in toxicity.fold_gains(data, ordinary[200:])]
    assert all(g.sum() == 30 for _, g in unseen)
    score = toxicity.calibrate(data, unseen).scorer()
    assert min(score(" ".join(t)) for t in toxic[:50]) > max(score(" ".join(t)) for t in ordinary[:50])
