"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from convseries.llm import exact_dedup, graphs, html_text, mixing, near_dedup, packing, quality, queries, repeats, token_files, tokens, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, size long, rank long, key string"


def corpus(seed=0, n=60):
    """Small documents with copies, near copies, shared passages, repeats, nulls, ties and one long text."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = text(80)
    texts = [text(rng.randint(1, 120)) for _ in range(n)]
    for k in range(0, n, 7):
        texts[k] = texts[k] + " " + passage + "\n" + text(10)
    base = text(120).split(" ")
    for k in range(1, n, 5):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = "edit" + str(rng.randrange(10**6))
        texts[k] = " ".join(own)
    texts += [texts[3], texts[3].upper(), " " + texts[3] + "\n", None, "", " \t\n", "a b c\na b c\na b c a b c", text(6000), "x", "\x0b\x0c"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", None, "S"]), 7, 1, 2, 3, "k") for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[5]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], r[0] % 3 and 1, 0) for r in rows] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


# -- 1 -----------------------------------------------------------------------------------------------------------------


def plain_counts(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(spark, docs, rows, labels, empty):
    out = quality.quality_table(docs, labels).collect()
    assert len(out) == len(rows)
    want = {r[0]: plain_counts(r[1]) for r in rows}
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.quality_table(empty, labels).count() == quality.drop_low_quality(empty, labels).count() == 0
    assert set(quality.drop_low_quality(docs, labels).columns) == set(docs.columns)
    assert quality.drop_low_quality(docs, labels).count() == sum(r.kept for r in out)


def test_cutoffs_hold_their_bound():
    assert quality.log_binomial_cdf(2, 10, 0.3) == pytest.approx(np.log(0.3827827864))
    cells, good = np.array([0, 50, 120]), np.array([9000, 900, 5])
    cut = quality.choose_cutoff(cells, good, 0.004, 0.01)
    assert cut == 51 and quality.choose_cutoff(cells, np.array([20, 3, 0]), 0.004, 0.01) == quality.GRID + 1
    rng, failures = np.random.default_rng(0), 0
    for _ in range(200):  # the true rate at cell 100 is twice the allowed one
        bad = rng.binomial(2000, 0.02)
        failures += quality.choose_cutoff(np.array([0, 100]), np.array([2000 - bad, bad]), 0.01, 0.05) <= 100
    assert failures <= 20


def test_small_strata_reject(spark):
    words = ["".join(random.Random(k).choices("abcdefgh", k=1 + k % 9)) for k in range(400)]
    rng = random.Random(5)

    def text(junk):
        own = rng.sample(words, 70)
        return " ".join(w + "#" if junk and k % 3 == 0 else w for k, w in enumerate(own))

    found = []
    for lang, good, bad, free in (("en", 600, 60, 600), ("de", 230, 40, 400), ("fr", 100, 30, 100)):
        kinds = [1] * good + [0] * bad + [None] * (free - 90) + [-1] * 90
        found += [(len(found) + k, lang, text(kind in (0, -1)), kind) for k, kind in enumerate(kinds)]
    docs = spark.createDataFrame(found, "doc_id long, lang string, text string, kind int")
    labels = docs.where("kind >= 0").select("doc_id", F.col("kind").alias("quality"))
    out = quality.quality_table(docs, labels).join(docs.select("doc_id", "kind"), "doc_id").collect()
    for lang, n_bad in (("en", 60), ("de", 40), ("fr", 0)):  # 100 good rows cannot show a risk of 0.02
        own = [r for r in out if r.lang == lang]
        assert sum(r.kind == 0 and not r.kept for r in own) == n_bad
        good = [r.kept for r in own if r.kind == 1]
        assert good.count(False) <= 0.02 * len(good)


def plain_signals(text):
    n, chars, symbols, dup, repeats = plain_counts(text)
    lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    mean = chars / max(n, 1)
    unit = lambda x: max(0.0, min(1.0, x))
    values = symbols * 2 / max(chars, 1), dup / max(lines, 1), repeats / max(n, 1), (5.0 - mean) / 5.0, (mean - 5.0) / 20.0
    return [int(unit(v) * quality.GRID) for v in values], n < 50 or 100 * repeats > 50 * n


def plain_verdicts(rows, labels, risk=0.02, delta=0.05, grid=200, weight=0.02):
    """kept by id, from the definition: rows are (id, text, stratum), labels id -> 0 or 1 (the smallest)."""
    from math import comb

    cells = {i: plain_signals(t) for i, t, _ in rows}
    strata = defaultdict(list)
    for i, t, s in rows:
        if not cells[i][1]:
            strata[s or ""].append((i, t))
    paths = {}
    for s, own in strata.items():
        bad = [cells[i][0] for i, _ in own if labels.get(i) == 0]
        free = [cells[i][0] for i, _ in own if i not in labels]
        steps = []
        if not bad or not free:
            steps = [(k, c) for c in range(grid, 0, -1) for k in range(5)]
        else:
            pieces = []
            for k in range(5):
                share = lambda group, c: sum(x[k] >= c for x in group) / len(group)  # noqa: B023, E731
                at, slope = grid + 1, float("inf")
                while at > 1:
                    gains = [((share(bad, c) - share(bad, at) + weight) / (share(free, c) - share(free, at) + weight), c) for c in range(at - 1, 0, -1)]
                    best = max(g for g, _ in gains)
                    if best <= 1:
                        break
                    end, slope = next(c for g, c in gains if g == best), min(slope, best)
                    pieces += [(-slope, k, c) for c in range(at - 1, end - 1, -1)]
                    at = end
            steps = [(k, c) for _, k, c in sorted(pieces, key=lambda x: x[0])]
        trials = {}
        for i, t in own:
            if i in labels:
                trials[t] = min(labels[i], trials.get(t, 1))
        paths[s] = steps, [plain_signals(t)[0] for t, y in trials.items() if y == 1]
    tested, chosen = max(1, sum(bool(good) for _, good in paths.values())), {}
    for s, (steps, good) in paths.items():
        cut, best = [grid + 1] * 5, [grid + 1] * 5
        for k, c in steps if good else []:
            cut[k] = c
            wrong = sum(any(v >= x for v, x in zip(g, cut)) for g in good)
            if sum(comb(len(good), j) * risk**j * (1 - risk) ** (len(good) - j) for j in range(wrong + 1)) > delta / tested:
                break
            best = list(cut)
        chosen[s] = best
    return {i: not cells[i][1] and not any(v >= x for v, x in zip(cells[i][0], chosen[s or ""])) for i, _, s in rows}


def test_verdicts_equal_the_definition(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=1 + k % 9)) for k in range(400)]

    def text(junk):
        own = rng.sample(words, rng.randint(60, 75))
        return " ".join(w + "#" * rng.randint(0, 2) if junk and rng.random() < 0.4 else w for w in own)

    rows, labels = [], {}
    for lang, good, bad, free in (("en", 420, 50, 300), (None, 250, 30, 120), ("de", 90, 20, 50), ("fr", 3, 0, 10)):
        for k in range(good + bad + free):
            i = len(rows)
            junk = good <= k < good + bad or k >= good + bad + free - 25
            rows.append((i, rows[i - 1][1] if k % 9 == 8 else text(junk or rng.random() < 0.004), lang))
            if k < good + bad:
                labels[i] = int(k < good)
    rows += [(len(rows), None, "en"), (len(rows) + 1, "", None), (len(rows) + 2, "few words", "de")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, counts long, stratum long").repartition(3)
    marks = spark.createDataFrame(list(labels.items()) + [(0, 1), (None, 0), (7, None)], "doc_id long, quality int")
    want = plain_verdicts(rows, labels)
    assert {r.doc_id: r.kept for r in quality.quality_table(docs, marks).collect()} == want
    assert 0 < sum(labels.get(i) == 0 and not k for i, k in want.items())
    left = quality.drop_low_quality(docs, marks)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, k in want.items() if k}
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "PythonUDF" not in plan  # no text is shuffled, nothing is counted again


def test_rule_steps_take_what_separates_first():
    bad, free = np.zeros((2, 2, quality.GRID + 1), np.int64)
    bad[0, 40:50], free[0, 45], free[0, 1] = 5, 60, 340
    bad[1, :10], free[1, :10] = 5, 40
    steps = quality.rule_steps(bad, free)
    assert steps[-1] == (0, 40) and {s for s, _ in steps} == {0}
    none = np.zeros_like(bad)
    assert quality.rule_steps(none, free)[:3] == [(0, 200), (1, 200), (0, 199)] and len(quality.rule_steps(bad, none)) == 2 * quality.GRID


# -- 2 -----------------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    stopped = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in stopped)
        w = sum(weight[s] for s in names if s not in stopped)
        now = {s for s in names if s not in stopped and rest * weight[s] >= 2 * sizes[s] * w}
        if not now:
            return {s: 2.0 * sizes[s] if s in stopped else rest * weight[s] / w for s in names}
        stopped |= now


def test_mix(docs, rows, empty):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    targets, source, taken = plain_targets(size), {r[0]: r[3] for r in rows}, Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(targets[s]) and r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    for s in size:
        assert abs(taken[s] - targets[s]) <= max(r["size"] for r in out if source[r.doc_id] == s)
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    assert mixing.mix_sources(empty).count() == 0
    mixed = mixing.apply_mix(docs)
    copies = Counter()
    for r in out:
        copies[r.doc_id] += r.copies
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == +copies
    assert mixing.apply_mix(empty).count() == 0


# -- 3 -----------------------------------------------------------------------------------------------------------------


def plain_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = True
        edges = np.diff(np.concatenate([[0], covered.astype(int), [0]]))
        kept = bytes(np.frombuffer(t, np.uint8)[~covered]) if t else b""
        out.append((len(t), int(covered.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1500, 2])
def test_repeats(docs, rows, empty, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_SPANS", most)
    out = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect())
    want = sorted((r[0], *x) for r, x in zip(rows, plain_removed([(r[1] or "").encode() for r in rows], 200)))
    assert out == want and any(x[2] for x in want)
    if most > 2:
        assert repeats.remove_repeats(empty).count() == 0


def test_repeats_without_ids_and_of_frequent_passages(spark, monkeypatch):
    """Null and repeated ids are documents like others; a passage in every document is dealt to salts."""
    rng = random.Random(6)
    text = lambda k: "".join(rng.choices("abcdefghij ", k=k))
    often, rare = text(300), text(260)
    rows = [(None if k % 3 == 0 else k % 50, text(rng.randint(0, 150)) + often[rng.randint(0, 60) :] + text(30)) for k in range(1100)]
    rows += [(None, text(20) + rare), (7, rare + text(20)), (None, None), (None, text(431)), (3, "x" * 500), (3, "x" * 230)]
    rows += [(None, rows[-3][1]), (None, rows[-3][1])]
    docs = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, a long, d binary").repartition(5)
    show = lambda rows: Counter((-1 if i is None else i, *x) for i, *x in rows)
    got = show((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect())
    assert got == show((r[0], *x) for r, x in zip(rows, plain_removed([(r[1] or "").encode() for r in rows], 200)))


def test_run_length_index():
    rng = random.Random(2)
    for t in range(60):
        letters = b"ab" if t % 2 else b"abcdefgh"
        base = bytes(rng.choice(letters) for _ in range(60))
        spans = []
        for _ in range(rng.randint(1, 10)):
            x = bytearray(base[rng.randint(0, 20) : rng.randint(25, 60)])
            x[rng.randrange(len(x))] = rng.choice(letters)
            spans.append(bytes(x))
        length = rng.randint(4, 18)
        for span, marks, (_, removed, _, _) in zip(spans, repeats.mark_block(spans, length), plain_removed(spans, length)):
            assert sum(b - a for a, b in repeats._merged([{"start": a, "end": b} for a, b in marks])) == removed, span


# -- 4 -----------------------------------------------------------------------------------------------------------------

PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><div class='cookie-notice'>We use cookies.</div><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
    "<div id=wrap><div class='sidebar'><h3>About</h3><p>Some words about me.</p></div><article><h2>Title</h2><p>Text &amp; more<br>of it<p>Second&nbsp; <b>bold</b>\n para<script>var x='</p>';</script></article>"
    "<div class='comments'><p>I like this.</p></div></div><form>Name <input></form><footer>&copy; 2020</footer>"
)


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (3, "u", "", "z"), (1, "u", PAGE, "x"), (4, "u", "<p", "z")], "page_id long, url string, html string, text string")
    out = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract_text(pages).collect())
    want = "Title\nText & more of it\nSecond bold para"
    assert out == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0), (4, "", 0)]
    assert html_text.extract_text(pages.limit(0)).count() == 0


PROSE = "Some longer sentence of running text that stands in this page as its main matter. " * 3


def built_model():
    counts = Counter()
    for nodes, labels in html_text.labelled_pages():
        counts.update(html_text.count_labels(nodes, labels))
    return html_text.TreeModel(counts)


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><div>{}</div>",  # a head without an end
        "<head><meta charset=utf-8><p>{}",
        "<body><div title=it's><p>{}</p></div>",  # quotes in bare values
        "<body><div title=5\" id=x><p>{}</p></div>",
        '<body><div class="a""><p>{}</p></div>',  # a quote too many
        "<body><div class = 'a' data-x='<p>'><p>{}</p></div>",
        "<title>T</title><p>{}</p>",  # titles and fields are not content wherever they stand
        "<body><p>{}</p><textarea><p>typed</p></textarea>",
        "<body><title>T</title><p>{}</p><noscript><p>no script</p></noscript>",
        "<!doctype html><!--x><p>hidden</p>--><body><!--><p>{}</p>",
        "<body><p>{}</p><!-- open <p>hidden</p>",
        "<body><p>{}</p><script>var a = '<p>x</p>'; // <\\/script>",
        "<body><p>{}</p><STYLE>p::after</style ><p class=footer",
        "<body><p>{}</p></></ x><?x?><![CDATA[y]]>",
        "<html class=a><html><body><body><head><p>{}</p>",
    ],
)
def test_markup_as_browsers_read_it(page):
    assert built_model().text(page.format(PROSE)) == PROSE.strip()


def test_references_are_decoded_piece_by_piece():
    assert built_model().text(f"<p>&lt;b&gt; &am<b>p;</b> &amp;lt; &eacute;&#233;&#xE9;&nbsp;&notit; {PROSE}</p>") == f"<b> &amp; &lt; ééé ¬it; {PROSE.strip()}"


@pytest.mark.parametrize("piece", ['<a "', "<a b=c ", "<div a='", "<b>", "<b><div></b>", "<p>x", "<li>", "<!--", "<script>", "</", "<", "&", "<title>", "<table><td>", "<a href=x>"])
def test_time_is_linear(piece):
    import time

    began = time.perf_counter()
    html_text.parse(piece * 100_000)
    assert time.perf_counter() - began < 20  # seconds where quadratic work takes hours


def built_pages(n=120, seed=3):
    """Pages from templates other than those of the training pages, with their main texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    sentence = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    out = []
    for i in range(n):
        blocks = [sentence(6), *(sentence(rng.randint(25, 60)) for _ in range(rng.randint(2, 6))), sentence(20)]
        inline = lambda t: t.replace(" ", " <em>", 1).replace(" ", "</em> ", 2).replace("</em> ", " ", 1) if rng.random() < 0.3 else t
        body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{inline(b)}" + "</p>" * rng.randint(0, 1) for b in blocks[1:-1]) + f"<blockquote>{blocks[-1]}</blockquote>"
        tag, name = rng.choice([("article", ""), ("main", ""), ("div", " class='post-content'"), ("section", " id=article-body"), ("div", " class='entry'")])
        menu = "".join(f"<li><a href='/{word()}'>{word()}</a>" for _ in range(rng.randint(3, 9)))
        side = f"<{(k := rng.choice(['aside', 'div']))} class='sidebar widget'><h4>{word()}</h4><ul>{menu}</ul></{k}>"
        notes = "".join(f"<div class=comment><p>{sentence(12)}</p></div>" for _ in range(rng.randint(0, 3)))
        head = f"<!DOCTYPE html><html><head><title>{blocks[0]}</title><style>a{{}}</style>" + "</head>" * rng.randint(0, 1)
        out.append((i, f"{head}<body><div class='cookie-banner'>{sentence(8)}</div><header class=top><nav><ul>{menu}</ul></nav></header><div id=page>{side if i % 2 else ''}<{tag}{name}>{body}</{tag}><div class=advert>{sentence(5)}</div><div id=comments>{notes}</div>{'' if i % 2 else side}</div><form><input><button>{word()}</button></form><footer><p>{sentence(6)}</p></footer></html>", "\n".join(blocks)))
    return out


def test_built_pages_give_their_articles(spark):
    built = built_pages()
    pages = spark.createDataFrame([(i, "u", page, 1) for i, page, _ in built], "page_id long, url string, html string, text long")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    wrong = [(i, got[i], text) for i, _, text in built if got[i] != text]
    assert len(wrong) <= len(built) // 50, wrong[:2]


LONG = "Readers wrote long sentences here about many things that they had seen and thought of. " * 4
ARTICLE = "<h1>Title here</h1>" + "".join(f"<p>Paragraph {i} of the article tells a long story with many words in it, and goes on for a while.</p>" for i in range(4))
MAIN = re.sub("<[^>]*>", "\n", ARTICLE).replace("\n\n", "\n").strip()
#: Pages with their main text: text right in a body, and what stands in or beside an article without belonging to it, as long as the article.
HARD_PAGES = {
    "text in the body": (f"<body>{PROSE}</body>", PROSE.strip()),
    "no tags": ("Just some plain text, without any tag", "Just some plain text, without any tag"),
    "short lines": ("<body>a<br><br>b</body>", "a b"),
    "one short paragraph": ("<html><body><p>Hello world.</p></body></html>", "Hello world."),
    "loose text beside paragraphs": (f"<body><h1>T of it</h1>{PROSE}<p>{LONG}</p>{PROSE}</body>", f"T of it\n{PROSE.strip()}\n{LONG.strip()}\n{PROSE.strip()}"),
    "an unnamed div": (f"<body><nav><ul><li><a>x</a></li></ul></nav><div>{LONG}<p>{LONG}</p>{LONG}</div><footer>(c) 2020 Company. All rights reserved.</footer></body>", "\n".join([LONG.strip()] * 3)),
    "line breaks": (f"<body><div class='post-body'>{LONG}<br>{LONG}</div><div class='sidebar'><h3>Popular</h3><p>{LONG[:150]}</p><ul><li><a>One thing</a></li></ul></div></body>", f"{LONG.strip()} {LONG.strip()}"),
    "comments in the article": (f"<body><nav><a>Home</a></nav><article>{ARTICLE}<section class='comments'><h2>Comments</h2><p>{LONG}</p><p>{LONG}</p></section></article></body>", MAIN),
    "many comments": (f"<body><article>{ARTICLE}<section class='comments'>{f'<div class=comment><p>{LONG}</p></div>' * 30}</section></article></body>", MAIN),
    "a list of comments": (f"<body><article>{ARTICLE}</article><ol class='comment-list'>{f'<li><p>{LONG}</p></li>' * 10}</ol></body>", MAIN),
    "comments as articles": (f"<body><main>{ARTICLE}{f'<article class=comment><p>{LONG}</p></article>' * 2}</main></body>", MAIN),
    "a thread": (f"<body><article>{ARTICLE}<div id='disqus_thread'><p>{LONG}</p><p>{LONG}</p></div></article></body>", MAIN),
    "newsletter": (f"<body><article>{ARTICLE}<div class='newsletter'>{LONG}</div></article></body>", MAIN),
    "advert": (f"<body><article>{ARTICLE}<div class='advert'><p>{LONG}</p></div></article></body>", MAIN),
    "cookies before": (f"<body><div class='cookie-banner'><p>{LONG}</p></div><main>{ARTICLE}</main></body>", MAIN),
    "cookies inside": (f"<body><main><div class='cookie-banner'><p>{LONG}</p></div>{ARTICLE}</main></body>", MAIN),
    "notice": (f"<body><div class='gdpr notice'><p>{LONG}</p></div><div class='content'>{ARTICLE}</div></body>", MAIN),
    "form": (f"<body><article>{ARTICLE}<form><label>Name</label><input><p>{LONG}</p><button>Go</button></form></article></body>", MAIN),
    "related": (f"<body><article>{ARTICLE}<div class='related'><h3>Related</h3><ul><li><a href=x>Other story</a></li></ul></div></article></body>", MAIN),
}


@pytest.mark.parametrize("name", HARD_PAGES)
def test_hard_pages(name):
    page, want = HARD_PAGES[name]
    assert built_model().text(page) == want


def test_hard_pages_with_a_trained_model(spark, sf):
    """The model of the given pages, and one whose sample is empty, which is the built one."""
    given = spark.read.parquet(f"{sf}/pages.parquet")
    model = html_text.train_model(given)
    assert {name: model.text(page) for name, (page, _) in HARD_PAGES.items()} == {name: want for name, (_, want) in HARD_PAGES.items()}
    assert html_text.train_model(given, sample_rows=0).unary == built_model().unary
    # given pages say themselves what is content; token F1 of all of them
    hits = found = real = 0
    for r in given.collect():
        nodes, blocks = html_text.parse(r.html or "")
        labels = html_text.own_labels(nodes)
        if labels:
            want, got = Counter(w for k, t in blocks if labels[k] for w in t.split()), Counter(model.text(r.html).split())
            hits, found, real = hits + (want & got).total(), found + got.total(), real + want.total()
    assert 2 * hits / (found + real) > 0.999


def test_messages_are_exact():
    """Marginals by enumeration over a small tree."""
    from itertools import product

    model = built_model()
    nodes, _ = html_text.parse("<body><div class=ad><p>x y z</p></div><article><p>Some text</p></article></body>")
    total, ones = 0.0, np.zeros(len(nodes))
    weights = [[np.exp(sum(model.unary[f][y] for f in fs if f in model.unary)) for y in (0, 1)] for fs in html_text.features(nodes)]
    for labels in product((0, 1), repeat=len(nodes)):
        p = (0.95, 0.05)[labels[0]]
        for k, y in enumerate(labels):
            p *= weights[k][y] * (model.pair[nodes[k].tag in html_text.HOLDERS][labels[nodes[k].parent]][y] if k else 1)
        total += p
        ones += p * np.array(labels)
    assert model.marginals(nodes) == pytest.approx(ones / total, rel=1e-9)


# -- 5 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("digits", [64, 1])
def test_exact_groups(docs, rows, empty, digits):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    want = sorted((r[0], min(g, key=lambda x: (-len(x[1] or ""), x[0]))[0], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for r in g)
    out = exact_dedup.exact_groups(docs, digest_hex=digits, memtable_rows=3 if digits == 64 else 100).collect()  # 24 runs, two levels
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)
    if digits == 64:
        assert exact_dedup.exact_groups(empty).count() == 0
        kept = exact_dedup.drop_exact_copies(docs)
        assert kept.columns == docs.columns and kept.select("doc_id").distinct().count() == len(groups)
        assert exact_dedup.drop_exact_copies(empty).count() == 0


def test_exact_groups_without_ids(spark):
    rows = [(None, "a b"), (None, "ab"), (4, "a  b"), (5, None), (None, ""), (6, "c"), (None, "d")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, digest string, sha string")
    out = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect())
    assert out == Counter([(None, 4, 3, False), (None, 4, 3, False), (4, 4, 3, True), (5, 5, 2, True), (None, 5, 2, False), (6, 6, 1, True), (None, None, 1, True)])
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(4, "a  b"), (5, None), (6, "c"), (None, "d")])


# -- 6 -----------------------------------------------------------------------------------------------------------------


def test_grammar():
    g = toxicity.ToxicGrammar(toxicity.SEED_INSULTS, np.ones(toxicity.N_FEATURES), -3.0)
    kinds = dict(g.clauses("You are an idiot. This is not stupid! He said moron; they will kill you, nothing here"))
    assert kinds["You are an idiot"] == (1, 1, 0, 0) and kinds["This is not stupid"] == (1, 0, 1, 0)
    assert kinds["He said moron"] == (1, 1, 0, 1) and kinds["they will kill you, nothing here"] == (3, 1, 0, 0)
    assert g.score(None) == g.score("") == pytest.approx(1 / (1 + np.exp(3)))
    assert g.score("you idiot") > g.score("some idiotic word")


def test_reports_reach_over_colons_and_quotations():
    g = toxicity.ToxicGrammar(toxicity.SEED_INSULTS, np.ones(toxicity.N_FEATURES), -3.0)
    kinds = lambda t: [c[2:] for _, c in g.clauses(t)]
    assert kinds("He said: you idiot") == [(0, 1)]
    assert kinds('She wrote "You idiot! You moron." You scum') == [(0, 1), (0, 1), (0, 0)]
    assert kinds('She wrote "You idiot! You moron\nYou scum') == [(0, 1), (0, 1), (0, 0)]
    assert kinds('"You idiot." You moron') == [(0, 0), (0, 0)]
    assert g.features("He said: you idiot")[-4:-1].tolist() == [0, 0, 0] and g.features("You idiot, moron")[-4] == pytest.approx(np.log(3))


def plain_features(g, text):
    """The features by rules, clause by clause, without an automaton; for texts without quotations."""
    x, asserted, n_words = Counter(), set(), 0
    for clause in re.split(r"[.!?;\n]+", text.lower()):
        words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause)
        n_words += len(words)
        names = {toxicity.INSULT: "i", toxicity.THREAT: "t", toxicity.SLUR: "s", toxicity.TARGET: "m", toxicity.NEGATION: "n", toxicity.REPORT: "r"}
        signs = "".join(names[g.symbol(w)] for w in words if g.symbol(w) is not None)
        said = re.sub("[mnr]", "", signs)
        if not said:
            continue
        what = (1 if len(said) == 1 else 2) if "i" in said else 3 if said[0] == "t" else 4 if said.count("s") == 1 else 5
        before = re.split("[its]", signs)[0]
        c = (what, int("m" in signs), int("n" in before), int("r" in before))
        x[toxicity.CLASSES.index(c)] += 1
        if not c[2] and not c[3]:
            asserted |= {w for w in words if g.symbol(w) in (toxicity.INSULT, toxicity.SLUR)}
    out = np.zeros(toxicity.N_FEATURES)
    for k, n in x.items():
        out[k] = n
    ends = len(re.findall(r"[.!?;\n]+", text))
    slurs = {w for w in asserted if g.symbol(w) == toxicity.SLUR}
    out[-1] = 100 * sum(x.values()) / (n_words + ends + 20)
    out[-2] = max((sum(w.startswith(t) and len(w) > len(t) for w in slurs) for t in g.stems), default=0)
    out[-3], out[-4] = len(slurs), len(asserted - slurs)
    return np.log1p(out)


def test_features_equal_the_rules():
    rng = random.Random(12)
    g = toxicity.ToxicGrammar(toxicity.SEED_INSULTS, stems=frozenset(["grob", "groble"]))
    words = ["idiot", "Moron", "stupid", "kill", "grobling", "groblex", "grobs", "grob", "you", "they", "not", "never", "said", "wrote", "plain", "word", "it's", "12", ".", "!", ";", "\n", ",", ":"]
    for _ in range(1500):
        text = " ".join(rng.choices(words, k=rng.randint(0, 25)))
        assert g.features(text).tolist() == pytest.approx(plain_features(g, text).tolist()), text
    long = "plain words and nothing else. " * 100_000 + "You idiot"
    assert g.features(long).tolist() == pytest.approx(plain_features(g, long).tolist())


def test_fit_has_no_slope():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    y = (x @ rng.normal(size=6) + rng.logistic(size=300) > 0.4).astype(float)
    w, b = toxicity.fit_logistic(x, y)
    loss = lambda w, b: np.logaddexp(0, -(2 * y - 1) * (x @ w + b)).sum() + 0.5 * w @ w + 0.5e-3 * b * b
    for k in range(7):
        step = np.eye(7)[k] * 1e-4
        assert loss(w, b) <= min(loss(w + step[:6], b + step[6]), loss(w - step[:6], b - step[6]))


def test_toxicity_learns_and_holds_out(spark, empty):
    rng = random.Random(4)
    data, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = ["plain", "words", "of", "text"] * 20
        if toxic:
            for w in rng.sample(["zonk", "blorp", "idiot"], 2):
                words.insert(rng.randrange(80), w)
        data.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([(*r, "z", 1, 0.5, 2) for r in [*data, (900, None), (901, "")]], "doc_id long, text string, term string, y long, score double, _id long")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    grammar = toxicity.train_grammar(docs, labels)
    assert {"zonk", "blorp"} <= grammar.said
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, grammar).collect()}
    assert len(out) == 402 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [i for i in range(400) if out[i].held_out]
    assert sum(out[i].predicted == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert 0 <= out[900].score < 0.5 and out[900].score == out[901].score
    assert toxicity.score_toxicity(docs.union(docs).withColumn("doc_id", F.lit(None).cast("long")), grammar).where("doc_id IS NULL").count() == 804
    assert toxicity.score_toxicity(empty, grammar).count() == 0
    untrained = toxicity.train_grammar(docs, labels.limit(0))
    assert untrained.score("you idiot") > untrained.score("hello there")


def test_common_words_are_no_threats():
    """Neutral prose has a threat in none of the languages; `die` is an article in one of them."""
    grammar = toxicity.ToxicGrammar(toxicity.SEED_INSULTS)
    neutral = {
        "en": "The people of the town said that you can see them on their way to the sea. She told you all of it.",
        "de": "Die Frau und die Kinder sind da, sagte er. Ihr habt die Häuser gesehen, die du kennst. Nie war die Stadt so still.",
        "fr": "Vous avez vu la ville, dit elle. Tu es venu avec eux et ils ne sont pas partis.",
        "es": "Ellos vieron la ciudad, dijo ella. Ustedes nunca vinieron con ellos.",
    }
    assert not {"die", "der", "das", "la", "le", "the"} & toxicity.THREATS
    for text in neutral.values():
        assert grammar.clauses(text) == []
    assert grammar.clauses("I will kill you")[0][1][0] == 3


def test_repeated_labelled_rows_count_once(spark):
    rows = [(k, "you are a zonk" if k % 4 == 0 else "a quiet day in the town") for k in range(200)]
    docs = spark.createDataFrame([*rows, *rows[:50] * 8, *[(4, f"another text {k} of this document") for k in range(300)]], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    once = toxicity.train_grammar(docs.dropDuplicates(["doc_id", "text"]), labels)
    more = toxicity.train_grammar(docs, labels)
    assert once.said == more.said and np.allclose(once.weights, more.weights) and "zonk" in more.said
    few = toxicity.train_grammar(docs, labels, sample_rows=60)  # the texts of one id are sampled too
    assert few.weights is not None and 0 < few.score("you are a zonk") < 1


# -- 7 -----------------------------------------------------------------------------------------------------------------


def plain_components(rows, percent=85):
    sets = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets[r[0]] = frozenset(zip(w, w[1:], w[2:], w[3:], w[4:])) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("few", [48, 2])
def test_near_groups(docs, rows, empty, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "FEW", few)
    want = plain_components(rows)
    out = near_dedup.near_groups(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    if few == 48:
        assert near_dedup.near_groups(empty).count() == 0
        left = near_dedup.drop_near_copies(docs)
        assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, (_, c) in want.items() if c == i}


def plain_components_by_row(rows, percent=85):
    """Component of each id where an id may stand on several rows: rows are vertices, rows of one id are linked."""
    numbered = {r[0]: None for r in rows}
    ids = {k: r[0] for k, r in enumerate(rows)}
    alone = plain_components([(k, r[1]) for k, r in enumerate(rows)], percent)
    parent = {i: i for i in numbered}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (_, c) in alone.items():
        x, y = find(ids[k]), find(ids[c])
        parent[max(x, y)] = min(x, y)
    return {k: (alone[k][0], find(ids[k])) for k in alone}


def test_ids_with_several_texts(spark):
    """A link of any text of an id counts, in any order of the rows; an empty text goes with the others of its id."""
    rng = random.Random(4)
    text = lambda: [f"w{rng.randrange(5000)}" for _ in range(100)]
    near = lambda words: " ".join("edited" if k == 50 else w for k, w in enumerate(words))
    a, b, c = text(), text(), text()
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(c)), (5, None), (5, near(c)), (6, ""), (7, " ".join(a)), (7, " ".join(a)), (None, " ".join(b)), (8, " ".join(text())), (8, " ".join(text()))]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(2)
        got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs).collect()}
        assert {(i, c) for i, _, c, _ in got} == {(1, 1), (2, 1), (3, 1), (7, 1), (4, 4), (5, 4), (6, 6), (8, 8), (None, None)}
        assert all(kept == (c == i) for i, _, c, kept in got) and (5, 0, 4, False) in got


@pytest.mark.parametrize("few", [48, 2])
def test_near_groups_of_repeated_ids(spark, rows, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "HEAD_MEMBERS", 3)
    own = [(r[0] % 37, r[1]) for r in rows if r[0] is not None]
    want = plain_components_by_row(own)
    got = near_dedup.near_groups(spark.createDataFrame(own, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((own[k][0], n, c) for k, (n, c) in want.items())


def test_pairs_travel_without_the_heads_text(spark):
    """A head's text goes ahead of its members, once for each part."""
    texts = spark.createDataFrame([(k, f"a b c d e f {k}") for k in range(500)], "id long, text string")
    pairs = spark.range(1, 500).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    rows = near_dedup._beside_heads(pairs, texts)
    assert rows.where("NOT member").count() == 3 and rows.where("member").count() == 499 and rows.columns == ["b", "part", "member", "a", "text"]
    assert {(r.size_a, r.size_b, r.both) for r in near_dedup.measured(pairs, texts).collect()} == {(3, 3, 2)}


def thue_morse(n):
    """Words of n letters that polynomial hashes modulo a power of two cannot tell from their complement."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_long_words_are_told_apart(spark):
    rows = []
    for n in (1024, 2048, 4096):
        a, b = thue_morse(n)
        rows += [a, b, f"one two {a} four five six", f"one two {b} four five six"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = near_dedup.near_groups(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(i, i) for i in range(len(rows))]


def test_recall_of_links(spark, sf):
    """All pairs of the small table: every link ends in one component; nothing else is joined."""
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(table).collect()}
    assert got == {i: c for i, (_, c) in plain_components(rows).items()}
    assert sum(i % 50 == 0 for i in got) > 1


def test_recall_of_a_larger_table(spark, sf):
    """Every link of the documents of sf0.01 whose id is divisible by 50, with all documents, ends in one component."""
    table = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in table.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = frozenset(zip(w, w[1:], w[2:], w[3:], w[4:])) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    component = {r.doc_id: r.component_id for r in near_dedup.near_groups(table).collect()}
    found = missed = 0
    for i in (i for i in sets if i % 50 == 0 and sets[i]):
        for j, other in sets.items():
            if j != i and 100 * len(sets[i] & other) >= 85 * len(sets[i] | other):
                found, missed = found + (component[i] == component[j]), missed + (component[i] != component[j])
    assert found > 3 and missed == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(k, "the same words here " * 20, 1, 2, 3, 4, 5) for k in range(3)], "doc_id long, text string, _gone long, gone long, id long, component_id long, k1 long")
    left = near_dedup.drop_near_copies(docs)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [0]


def test_super_minhash_estimates():
    rng = np.random.default_rng(0)
    universe = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = universe[:200], universe[50:250]
    sets = np.concatenate([np.sort(a), np.sort(b)])
    s = near_dedup.super_minhash(sets, np.array([0, 200, 400]), 224)
    assert abs((s[0] == s[1]).mean() - 150 / 250) < 0.12
    assert (near_dedup.super_minhash(np.sort(a), np.array([0, 200]), 224)[0] == s[0]).all()
    tiny = near_dedup.super_minhash(universe[:1], np.array([0, 1, 1]), 16)
    assert len(set(tiny[0].tolist())) == 16 and (tiny[1] == 2**64 - 1).all()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    out = {r.id: r.component for r in graphs.components(edges).collect()}
    assert all(out[i] == 0 for i in range(41)) and out[100] == out[90] == 90
    assert graphs.components(edges.limit(0)).count() == 0


# -- 8 and 9 -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_pieces_give_the_tokenizers_ids(name, kind, rows):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(name)
    plain = Tokenizer.from_file(path)
    texts = [r[1] or "" for r in rows] + ["a  b\n\n c\t\td  x <|endoftext|> it's\r\nx", "\n\nx  ", "é　 b\u00a0c ", "<|startoftext|>x,<|endoftext|>.a", "×é÷, É,x İ ß", "don't a's, x','ll 12,345 a1b2", "ﬁ ½ 中文。字 a\u0301, e"]
    got = [ids[a:b].tolist() for _, ids, first in tokens.encoded_texts(pa.array(texts), path, kind, None) for a, b in zip(first, first[1:])]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_ids_do_not_depend_on_neighbours(name, kind):
    """Short texts with white-space ends, control and odd characters, many in one batch."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(name)
    plain, rng = Tokenizer.from_file(path), random.Random(11)
    signs = [" ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x00", "\x1c", "\x85", "\u00a0", "\u3000", "\u2028", "a", "B", "é", "ß", "İ", "x1", "12", ".", ",", "'", "'s", "'LL", "-", "<|endoftext|>", "<|endof", "text|>", "中", "ﬁ", "e\u0301", "=\u0338", "word", "Hello", "😀"]
    texts = ["hello\n\n", "world", "hello\n\n", "", " ", "x", "\n"] + ["".join(rng.choices(signs, k=rng.randint(0, 7))) for _ in range(20000)]
    for order in (texts, texts[::-1]):
        got = [ids[a:b].tolist() for _, ids, first in tokens.encoded_texts(pa.array(order), path, kind, None) for a, b in zip(first, first[1:])]
        want = [e.ids for e in plain.encode_batch(order, add_special_tokens=False)]
        assert [(t, g, w) for t, g, w in zip(order, got, want) if g != w] == []


def test_other_tokenizers_are_encoded_whole(tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "other.json"))
    texts = ["some words,  and\n\nmore", "x", "", " y"]
    got = [ids[a:b].tolist() for _, ids, first in tokens.encoded_texts(pa.array(texts), str(tmp_path / "other.json"), "byte", None) for a, b in zip(first, first[1:])]
    assert got == [other.encode(t, add_special_tokens=False).ids for t in texts]


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(docs, rows, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    plain, start, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted((r[0], r[1] or "") for r in rows):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), digest(ids)))
        start += len(ids)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    docs.sparkSession.conf.set(coalesce, "false")
    found = token_files.token_file_digests(docs, path)
    docs.sparkSession.conf.unset(coalesce)
    assert found.rdd.getNumPartitions() > 1  # files are read in parallel
    assert sorted(map(tuple, found.collect())) == sorted(want)
    null = docs.sparkSession.createDataFrame([(None, "a\n\n"), (None, None), (4, "b")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.start, r.n_tokens) for r in token_files.token_file_digests(null, path).collect()) == [(False, 4, 2), (True, 0, 1), (True, 1, 3)]
    assert token_files.token_file_digests(empty, path).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    plain, want = Tokenizer.from_file(path), []
    for r in rows:
        ids = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want += [(r[0], k // 512, k, len(ids[k : k + 512]), digest(ids[k : k + 512])) for k in range(0, len(ids), 512)]
    out = packing.pack(docs, path, capacity=512).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= -(-sum(w[3] for w in want) // 512) + 1
    assert packing.pack(empty, path).count() == 0


def optimum(lengths, capacity):
    """Fewest bins by search."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] >= lengths[k] and bins[i] not in bins[:i]:
                bins[i] -= lengths[k]
                place(k + 1, bins)
                bins[i] += lengths[k]
        place(k + 1, [*bins, capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(lengths, minlength=capacity + 1)
        fixed = packing.dominant_sets(counts, capacity)
        rest = [x for x in range(1, capacity + 1) for _ in range(counts[x])]
        assert all(sum(s) <= capacity for s, _ in fixed)
        assert sorted(rest + [x for s, t in fixed for x in s for _ in range(t)]) == sorted(lengths)
        assert sum(t for _, t in fixed) + optimum(rest, capacity) == optimum(lengths, capacity)
        plan = packing.plan_slots(dict(Counter(lengths)), capacity)
        assert plan["sequences"] <= optimum(lengths, capacity) * 1.5 + 1


# -- 10 ----------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = ["http://A.Example.org/es/x?y", "https://example.org/en/12#t", "https://example.org", "x://www.casino-win.example.net?q=/", "ftp://b.com/de/", "http://com/fr/1", "no scheme", None, "", "http://spam-farm.example.org/en/7", "http://notexample.org/es/", "HTTP://ads.x/"]
    urls += ["http://ads.x/" + "y" * 100_000]
    pages = spark.createDataFrame([(i, u, "mine", "k", True) for i, u in enumerate(urls)] + [(0, urls[0], "again", "k", False)], "page_id long, url string, rule string, key string, listed boolean")
    listed = spark.createDataFrame([(h,) for h in ("www.casino-win.example.net", "spam-farm.example.org", "ads.x", "ads.x", "not.here", None)], "key string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, queries.RULES, listed).collect()}
    assert out == {
        0: ("a.example.org", "/es/x", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"), 2: ("example.org", "", None, "allow"), 3: ("www.casino-win.example.net", "", None, "block"),
        4: ("b.com", "/de/", "com/de/", "block"), 5: ("com", "/fr/1", "com/fr/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("spam-farm.example.org", "/en/7", "org/", "allow"), 10: ("notexample.org", "/es/", "org/", "allow"), 11: ("ads.x", "/", None, "block"), 12: ("ads.x", "/" + "y" * 100_000, None, "block"),
    }
    assert url_filter.filter_urls(pages.limit(0), queries.RULES, listed).count() == 0
    null = spark.createDataFrame([(None, None), (None, "http://ads.x/")], "page_id long, url string")
    assert sorted(r.verdict for r in url_filter.filter_urls(null, queries.RULES, listed).collect()) == ["allow", "block"]


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"), (F.col("id") % 9 == 0).alias("listed"))
    cascade = url_filter.BloomCascade.build(universe, bits_per_key=3)
    assert len(cascade.levels) > 2
    assert universe.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0

    cut = url_filter.BloomCascade.build(universe, bits_per_key=3, part_words=4)
    assert len(cut.levels[0].parts) == 4  # a filter of several rows
    assert universe.where(cut.contains(F.col("key")) != F.col("listed")).count() == 0
    half = universe.withColumn("listed", F.xxhash64("key") % 2 == 0)
    short = url_filter.BloomCascade.build(half, part_words=16, most_parts=2)
    assert short.levels[0].n_bits == 2048  # far fewer than ten bits a key
    assert half.where(short.contains(F.col("key")) != F.col("listed")).count() == 0


@pytest.mark.parametrize("listed", [60, 3000])
def test_cascade_of_more_keys_than_bits(spark, listed):
    """Levels whose keys no filter can hold end in a table, at an even level and at the first."""
    universe = spark.range(5000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"), (F.col("id") < listed).alias("listed"))
    cascade = url_filter.BloomCascade.build(universe, part_words=1, most_parts=1)
    assert cascade.rest is not None and len(cascade.levels) == (1 if listed == 60 else 0)
    marked = cascade.mark(universe, F.col("key"), "found")
    assert marked.count() == 5000 and marked.where("found != listed").count() == 0 and marked.columns == ["key", "listed", "found"]
    pages = universe.select(F.col("key").alias("page_id"), F.concat(F.lit("http://"), "key", F.lit("/x")).alias("url"), "listed")
    out = url_filter.filter_urls(pages, [], universe.where("listed").select("key"), part_words=1, most_parts=1)
    assert out.where((F.col("verdict") == "block") != F.col("listed")).count() == 0 and out.count() == 5000


# -- queries -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    cell = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(cell, r)) for r in df.select(*names).collect()) == sorted(tuple(map(cell, r)) for r in found.fetchall())


def hash36(i):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:9], 16)


def plain_mix(rows):
    """(copies by row) of the mix by a sort: rows are (id, text, source)."""
    n = lambda t: len(WORD.findall(t or ""))
    size = Counter()
    for _, t, s in rows:
        size[s] += n(t)
    targets, out = plain_targets(size), []
    for i, t, s in rows:
        whole = int(targets[s] // max(size[s], 1)) if targets[s] >= size[s] else 0
        budget = targets[s] - whole * size[s]
        cell = sum(n(x) for j, x, z in rows if z == s and hash36(j) == hash36(i))
        upto = sum(n(x) for j, x, z in rows if z == s and hash36(j) <= hash36(i))
        out.append(min(2, whole + (2 * upto - cell <= 2 * budget)))
    return out


def plain_pipeline(rows, labels, path):
    """What each stage of the pipeline keeps, from the definitions: rows are (id, text, lang, source). The last entry counts (id, piece, start, length, crc32)."""
    from tokenizers import Tokenizer

    out = []
    verdict = plain_verdicts([r[:3] for r in rows], labels)
    rows = [r for r in rows if verdict[r[0]]]
    out.append([r[0] for r in rows])
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    best = {k: min(g, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0] for k, g in groups.items()}
    rows = [r for r in rows if best[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")] == r[0]]
    out.append([r[0] for r in rows])
    component = plain_components([r for r in rows if r[0] is not None])
    rows = [r for r in rows if r[0] is None or component[r[0]][1] == r[0]]
    out.append([r[0] for r in rows])
    copies = plain_mix([(r[0], r[1], r[3]) for r in rows])
    rows = [r for r, k in zip(rows, copies) for _ in range(k)]
    out.append([r[0] for r in rows])
    plain, pieces = Tokenizer.from_file(path), []
    for r in rows:
        ids = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 0]
        pieces += [(r[0], k // 2048, k, len(ids[k : k + 2048]), digest(ids[k : k + 2048])) for k in range(0, len(ids), 2048)]
    return [*map(Counter, out), Counter(pieces)]


def test_pipeline_equals_plain_python(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.q for r in spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("q")).collect()}
    want = plain_pipeline([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()], labels, queries.tokenizer_path("word_bpe_49k.json"))
    for (name, stage), kept in zip(corpus_pipeline.STAGES[:-1], want):
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and Counter(r.doc_id for r in after.select("doc_id").collect()) == kept, name
        docs = after.checkpoint()
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want[-1]
    room = Counter()
    for r in out:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 2048 and len(room) <= -(-sum(room.values()) // 2048) + 1


@pytest.mark.parametrize("n", [0, 40])
def test_pipeline_of_odd_tables(spark, tmp_path, n):
    """Empty tables; null ids, texts, languages and sources; columns with the operators' own names."""
    import corpus_pipeline

    rng = random.Random(n)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(300)]
    rows = [(None if k % 7 == 3 else k, None if k % 11 == 5 else " ".join(rng.choices(words, k=rng.randint(40, 90))), rng.choice(["en", None]), rng.choice(["a", None, "b"]), 1, "r", 2.0) for k in range(n)]
    rows += [rows[k] for k in range(0, n, 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, copies double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, n, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path)).checkpoint()
        assert after.columns == docs.columns and after.count() <= 2 * docs.count(), name
        docs = after
    assert (corpus_pipeline.run(spark, str(tmp_path)).count() > 0) == (n > 0)
