"""Operators that judge texts one by one: repetition, BPE, extraction, quality, decontamination."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, decontamination, extraction, quality, repetition

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, **more):  # noqa: ANN001, ANN201
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in more.items()}).repartition(3)


ODD = [None, "", " ", "\n", "one", "a b\na b\n", "x " * 400, "é ü z 日本 語", "same text here", "same text here", "word " * 30_000]


# ---- repetition ------------------------------------------------------------------------------------------------------


def slow_counts(text: str) -> tuple:
    words = WORD.findall(text)
    at: dict[tuple, list[int]] = {}
    for k in range(len(words) - 7):
        at.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {p for places in at.values() if len(places) > 1 for k in places for p in range(k, k + 8)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(covered)


def test_repetition_counts_equal_brute_force(spark) -> None:  # noqa: ANN001
    rng = random.Random(1)
    texts = ODD[:-1] + ["".join(rng.choice(["a ", "b ", "c\n", "# ", "dd\t"]) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    got = {r["doc_id"]: r for r in repetition.repetition(docs(spark, texts, kept="clash", n_words="clash")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        n, *rest = slow_counts(t or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 20 or 100 * rest[-1] > 30 * n)
        assert not (r["base_failed"] and r["kept"])


def slow_verdict(text: str) -> tuple[dict[str, float], bool]:
    """Cover shares by marking words one by one, and the verdict."""
    words = WORD.findall(text)
    chars = sum(map(len, words)) or 1
    shares = {}
    for n in repetition.MAX_COVER:
        runs = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        covered = {p for k, r in enumerate(runs) if runs.count(r) > 1 for p in range(k, k + n)}
        shares[f"cover_{n}"] = sum(len(words[p]) for p in covered) / chars
    lines = text.split("\n")
    shares["line_cover"] = sum(len(w) for x in lines if lines.count(x) > 1 for w in WORD.findall(x)) / chars
    n_words, *_, repeats = slow_counts(text)
    fine = all(shares[f"cover_{n}"] <= most for n, most in repetition.MAX_COVER.items()) and shares["line_cover"] <= repetition.MAX_LINE_COVER
    return shares, n_words >= 20 and 100 * repeats <= 30 * n_words and fine


def test_repetition_verdicts_equal_brute_force() -> None:
    rng = random.Random(20)
    texts = ["", "x"]
    for _ in range(150):
        parts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 4))]
        texts.append(rng.choice(["\n", " "]).join(rng.choice(parts) for _ in range(rng.randint(1, 6))) + " ".join(str(rng.random()) for _ in range(rng.randint(0, 60))))
    found = repetition.measure(texts)
    for t, text in enumerate(texts):
        shares, kept = slow_verdict(text)
        assert all(abs(found[c][t] - x) < 1e-9 for c, x in shares.items())
        assert bool(found["kept"][t]) == kept
    assert 10 < sum(found["kept"]) < 140


def test_repetition_rejects_repeats_and_keeps_clean_text() -> None:
    rng = random.Random(2)
    clean = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(200))
    loop = " ".join(f"w{i % 7}" for i in range(200))
    assert repetition.measure([clean, loop])["kept"].tolist() == [True, False]


def test_repetition_of_no_rows(spark) -> None:  # noqa: ANN001
    assert repetition.repetition(docs(spark, [])).count() == 0


# ---- BPE -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary() -> str:
    return bpe.vocabulary_of(None)


def test_bpe_equals_the_library(vocabulary: str) -> None:
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(vocabulary)
    rng = random.Random(3)
    alphabet = [" ", "  ", "a", "B", "\n", "\t", "1", ".", "'s", "é", "à", "日", " ", "　", "<|endoftext|>", "ß", "#", "\x1c", "\x85"]
    texts = [t or "" for t in ODD[:-1]] + ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(3000)] + ["x" * 5000 + " y"]
    own = bpe.Encoder(vocabulary, most_kept=50)  # a small table is emptied again and again
    for start in range(0, len(texts), 100):
        part = texts[start : start + 100]
        for text, ids, want in zip(part, own.encode(part), library.encode_batch(part, add_special_tokens=False), strict=True):
            assert ids.tolist() == want.ids, repr(text)
            assert own.decode(ids) == library.decode(want.ids, skip_special_tokens=False) == text


def test_bpe_cuts_are_forced_and_independent(vocabulary: str) -> None:
    """Cuts stand at pairs inside no token, between words and inside them, and fragments encode by themselves."""
    own = bpe.Encoder(vocabulary)
    inside = {p for t in own.bytes.to_pylist() if t not in own.special for p in zip(t, t[1:], strict=False)}
    rng = random.Random(13)
    alphabet = [*"bqjxzv'.,!-07 \n", "'s", "'ll", " '", "\t", "é", "日", " ", "\u2003", "\u00a0", "\u2019", "\x1d", "  ", "\r\n"]
    texts = ["one two  three à four", "a\n b c", "bqbq qzqz", "x\ny"] + ["".join(rng.choices(alphabet, k=rng.randint(2, 30))) for _ in range(3000)]
    within = 0
    for text in texts:
        pieces = own.fragments(text)
        assert "".join(pieces) == text
        for piece, after in zip(pieces, pieces[1:], strict=False):
            assert (piece.encode()[-1], after.encode()[0]) not in inside
            within += piece[-1].isalpha() and after[0].isalpha()
        alone = [i for x in own.library.encode_batch(pieces, add_special_tokens=False) for i in x.ids]
        assert alone == own.library.encode(text, add_special_tokens=False).ids, repr(text)
    assert within > 100
    assert own.fragments("bqbq two") == ["b", "q", "b", "q", " two"]


def test_bpe_refuses_other_vocabularies(vocabulary: str) -> None:
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Encoder(vocabulary.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'))


def test_bpe_query_form(spark) -> None:  # noqa: ANN001
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs(spark, ODD, ids="clash", n_tokens="clash")).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        r = got[i]
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_digests(docs(spark, [])).count() == 0


# ---- extraction ------------------------------------------------------------------------------------------------------


def test_extraction_of_an_article() -> None:
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">Home</a></ul></nav><!-- ad --><div class="ad">Buy this, now, please.</div>
    <article><h1>A title</h1><p><b>First   paragraph, with &amp; and&nbsp;more.<br><p>Second one.</p></article>
    <aside><p>Aside, with text, of some length, to read.</p></aside><footer>&copy; all</footer></body></html>"""
    assert extraction.extract(page) == "A title\nFirst paragraph, with & and more.\nSecond one."


def test_extraction_without_article_element() -> None:
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="menu"><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div>
    <div class="cookie-notice">We use cookies. Accept?</div><div class="content"><h2>Title here</h2><p>First para, with text, and more text to read. It goes on.
    <p>Second; short.<form><input name=q>Search</form></div><div class="sidebar"><p>Related, stuff, links. And more text in here.</p></div>
    <section id="comments"><p>Reader: I think, that this is great.</p></section></body></html>"""
    assert extraction.extract(page) == "Title here\nFirst para, with text, and more text to read. It goes on.\nSecond; short."


def test_extraction_of_odd_pages(spark) -> None:  # noqa: ANN001
    pages = [None, "", "plain text", "<p>a<p>b<b>c</p><script>x", "<div", "a < b and c > d", "<article>" + "<p>Long, long text.</p>" * 5000 + "</article>", "<p>same</p>", "<p>same</p>"]
    rows = spark.createDataFrame([(i, None, p, "clash") for i, p in enumerate(pages)], "page_id long, url string, html string, n_chars string").repartition(2)
    got = {r["page_id"]: r for r in extraction.main_text(rows).collect()}
    assert [got[i]["text"] for i in (0, 1, 2, 3)] == ["", "", "plain text", "a\nbc"]
    assert got[6]["text"].count("\n") == 4999
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert extraction.main_text(rows.limit(0)).count() == 0


@pytest.mark.parametrize("quote", ['"', "'"])
def test_extraction_of_long_attributes(quote) -> None:  # noqa: ANN001
    long = quote + "hidden id=x > A1+/, " * 1000 + quote
    page = f"""<article><h1>A title</h1><div class=ad data-x={long}>Buy this, now, please.</div><p>First paragraph, with text.</p>
    <p><img src={long}>Second one, after an image.</p><div data-x={long}>Third one, in a long tag.</div><script data-x={long}>var t = "</p>";</script></article>"""
    assert extraction.extract(page) == "A title\nFirst paragraph, with text.\nSecond one, after an image.\nThird one, in a long tag."


def test_extraction_of_tags_that_never_end() -> None:
    assert extraction.extract("<p>a <b title='x <i>c</i> d") == "a <b title='x c d"
    for piece in ("<a ", "<a '", "<a '\" ", "<a x='\"'", "<![CDATA[", "<!x", "<svg ", "</p '"):
        began = time.perf_counter()
        extraction.extract("<p>" + piece * 100_000)
        assert time.perf_counter() - began < 10


def test_extraction_keeps_the_whole_article() -> None:
    long = ", ".join(["A paragraph of many words"] * 16) + "."
    rest = "<nav><a href=1>Home</a></nav><div class=sidebar><p>Aside, with text.</p></div>"
    more = "<ul class=x><li><a href=2>One</a></ul><div class=y><a href=3>Two links</a> <a href=4>here</a></div>"
    short = f"<p>{long}</p><section><p>Yes.</p><p>No.</p></section><table><caption>Sums</caption><tr><th>Year</th><td>7</td></tr></table><div>So</div><div>it goes</div>"
    kept = f"{long}\nYes.\nNo.\nSums\nYear\n7\nSo\nit goes"
    assert extraction.extract(f"<body>{rest}<article>{short}{more}</article></body>") == kept
    assert extraction.extract(f"<body>{rest}<main><h1>Title</h1><article>{short}{more}</article></main></body>") == f"Title\n{kept}"
    parts = "".join(f"<article><h2>Part {i}</h2><p>{long[: 90 * i]}</p></article>" for i in (1, 2, 3))
    said = "\n".join(f"Part {i}\n{long[: 90 * i].strip()}" for i in (1, 2, 3))
    assert extraction.extract(f"<body>{rest}<article><p>First.</p>{parts}</article></body>") == f"First.\n{said}"
    assert extraction.extract(f"<body>{rest}<div>{parts}</div></body>") == said


LONG = " ".join(["A paragraph, of many words, that goes on."] * 6)


def test_extraction_by_ratios_alone() -> None:
    """No telling names, no article element: sums of length and punctuation, the container and the threshold decide."""
    page = f"""<body><div class=a1><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div><div class=b2><h1>Title</h1><p>{LONG}</p><p>{LONG}</p>
    <table><tr><td>Seven</table></div><div class=c3>Partner offers here, click now.</div><div class=d4><p>All rights, reserved.</p></div></body>"""
    assert extraction.extract(page) == f"Title\n{LONG}\n{LONG}\nSeven"


def test_extraction_threshold_decides(monkeypatch) -> None:  # noqa: ANN001
    page = f"<body><nav><a href=1>Home</a></nav><div class=x><p>{LONG}</p></div><footer>All rights, reserved.</footer></body>"
    assert extraction.extract(page) == LONG
    monkeypatch.setattr(extraction, "THRESHOLD", -1)
    assert extraction.extract(page) == f"Home\n{LONG}\nAll rights, reserved."


def test_extraction_names_only_weigh() -> None:
    """A weak name that everything carries tells nothing; a heading before the container and a data URI do no harm."""
    uri = "data:image/png;base64," + "A1b2>" * 3000
    page = f"""<body><div class="sidebar"><h1>Title</h1><div class=t><p><img src="{uri}">{LONG}</p><p>{LONG}</p></div><div class=ad>Buy this, now.</div></div></body>"""
    assert extraction.extract(page) == f"Title\n{LONG}\n{LONG}"
    assert extraction.extract(f"<article><header><h1>Title</h1></header><p>{LONG}</p><footer>By me.</footer></article>") == f"Title\n{LONG}"


def test_extraction_judges_siblings_by_element() -> None:
    """Sibling elements without telling names share a path; an advert and a menu beside the article don't come with it."""
    page = f"<div><p>{LONG}</p></div><div>Buy now cheap offers today</div><div><a>Home</a> <a>News</a></div>"
    assert extraction.extract(page) == LONG
    assert extraction.extract(f"<body>{page}</body>") == LONG
    parts = f"<div><p>{LONG}</p></div><div><p>{LONG[:90]}</p></div>"
    assert extraction.extract(f"<body><div>{parts}</div></body>") == f"{LONG}\n{LONG[:90].strip()}"
    mixed = "<ul><li>One thing.<li><a href=1>Another thing</a><li>A third one, too.</ul>"
    assert extraction.extract(f"<article><p>{LONG}</p>{mixed}<ul><li><a>Home</a><li><a>News</a></ul></article>") == f"{LONG}\nOne thing.\nAnother thing\nA third one, too."


def test_extraction_of_a_short_article_with_unnamed_comments() -> None:
    article = "<article><h1>Title</h1><p>Short one.</p></article>"
    for comment in (f"<p>{LONG}</p>", f"<div><p>{LONG}</p></div>", f"<div>{LONG}</div>", f"<ul><li>{LONG}</ul>"):
        assert extraction.extract(f"<body>{article}{comment * 10}</body>") == "Title\nShort one."
    assert extraction.extract(f"<body><h1>Title</h1><article><p>Short one.</p></article><div>{f'<p>{LONG}</p>' * 10}</div></body>") == "Title\nShort one."


def test_extraction_keeps_bylines_and_the_like() -> None:
    for name in ("meta", "byline", "tags", "rating", "disclaimer", "poll"):
        assert extraction.extract(f"<article><h1>Title</h1><p class={name}>By Ann, 3 May</p><p>{LONG}</p></article>") == f"Title\nBy Ann, 3 May\n{LONG}"


def test_extraction_of_deep_pages() -> None:
    """Time and memory are linear in depth."""
    import tracemalloc

    for piece in ("<div>", "<p><div>", "<li><div>", "<div></x>", "<div><tr>", "<ul><li>", "<td><div>", "<div><li></li>", "<div class=a>x"):
        took = []
        for n in (10_000, 40_000):
            began = time.process_time()
            out = extraction.extract(piece * n + "a")
            took.append(time.process_time() - began)
            assert out.endswith("a")
        assert took[1] < 12 * max(took[0], 0.05), piece
    tracemalloc.start()
    extraction.extract("<div>" * 10_000 + "a")
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()


def slow_scores(found: list) -> list[float]:
    """The method's definitions, one block at a time, over lists of ancestors."""

    def line(e) -> list:  # noqa: ANN001
        """The elements from the root to e."""
        out = []
        while e is not None:
            out.insert(0, e)
            e = e.parent
        return out

    lines = [line(b.element) for b, _ in found]
    paths = [tuple((e.path.tag, e.path.name) for e in x) for x in lines]
    free = [max(0, len(said) - b.linked) for b, said in found]
    marks = [sum(c in ".,;:!?。，、！？；" for c in said) for _, said in found]
    mean = lambda of, p: sum(x for x, q in zip(of, paths, strict=True) if q == p) / paths.count(p)
    fused = []
    for k, (b, _) in enumerate(found):
        around = [j for j in (k - 1, k, k, k + 1) if 0 <= j < len(found)]
        a, c = (sum(mean(of, paths[j]) for j in around) / len(around) for of in (free, marks))
        fused.append(a * (1 + c) * extraction.WEAK**b.weak)
    outermost = lambda x: next((e for e in x if e.path.tag in ("article", "main")), None)
    articles = {outermost(x) for x, f in zip(lines, free, strict=True) if f and outermost(x) is not None and outermost(x).weak == 0}
    if certain := len(articles) == 1:
        home = line(articles.pop())
    else:
        total = sum(fused)
        held = lambda e: sum(f for f, x in zip(fused, lines, strict=True) if e in x[:-1])
        home = max((x[: k + 1] for x in lines for k in range(len(x) - 1) if total and held(x[k]) >= extraction.SHARE * total), key=len, default=lines[0][:1])
        home = line(outermost(home) or home[-1])
    weight = {p: sum(f for f, q in zip(fused, paths, strict=True) if q == p) for p in paths}
    inside = [home[-1] in x for x in lines]
    least = min((b.weak for (b, _), i in zip(found, inside, strict=True) if i), default=0)
    out = []
    for (b, _), x, p, i in zip(found, lines, paths, inside, strict=True):
        tag = p[-1][0]
        common = sum(e in home for e in x) - 1
        steps = (len(home) - 1 - common) + max(0, len(x) - 2 - common)
        step = 0.75 if re.fullmatch("h[1-6]", tag) else 0.7 if tag in extraction._TEXT and not certain else 0.4
        own = [c for (c, _), y, q in zip(found, lines, paths, strict=True) if q == p and (y[-2:-1] == x[-2:-1] if tag in extraction._TEXT else y[-1] is x[-1])]
        linked = sum(c.linked for c in own) / max(1, sum(len("".join(c.parts)) for c in own))
        share = weight[p] / (max(weight.values()) or 1)
        place = 1 + share if i else step**steps + (0 if certain else share)
        out.append(0.05 ** max(0, b.weak - least) * min(1, 2 - 2 * linked) * place / 2)
    return out


def test_extraction_equals_slow_scores(sf_dir) -> None:  # noqa: ANN001
    import html

    import pyarrow.parquet as pq

    rng = random.Random(14)
    tags = ["div", "p", "section", "article", "ul", "li", "h2", "nav", "footer", "a", "b", "div class=ad", "div class=x"]

    def grow(depth: int) -> str:
        tag = rng.choice(tags)
        inner = "".join(grow(depth - 1) for _ in range(rng.randint(1, 3))) if depth else "Some words, here. " * rng.randint(0, 6)
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    pages = pq.read_table(f"{sf_dir}/pages.parquet")["html"].to_pylist() + [grow(4) for _ in range(150)]
    for page in pages:
        found = [(b, said) for b in extraction.blocks(page) if (said := " ".join(html.unescape("".join(b.parts)).split()))]
        if found:
            got = extraction.scores(found)
            assert all(abs(got[b.element] - want) < 1e-9 for (b, _), want in zip(found, slow_scores(found), strict=True))


# ---- quality ---------------------------------------------------------------------------------------------------------


def labelled(n: int) -> tuple[list[str], list[int]]:
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(500)]
    texts, marks = [], []
    for i in range(n):
        good = i % 3 > 0
        body = rng.choices(words, k=rng.randint(30, 200))
        texts.append(". ".join(" ".join(body[k : k + 9]).capitalize() for k in range(0, len(body), 9)) + "." if good else " ".join(w.upper() + rng.choice(["###", "%%%", "!!"]) for w in body))
        marks.append(int(good))
    return texts, marks


def test_quality_on_held_out_rows(spark) -> None:  # noqa: ANN001
    texts, marks = labelled(600)
    labels = spark.createDataFrame([(i, m, 0) for i, m in enumerate(marks)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs(spark, [*texts, None, ""]), labels).collect()}
    import zlib

    assert len(got) == 602
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(600))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert np.mean([got[i]["predicted"] == marks[i] for i in held]) > 0.97


def test_quality_ignores_held_out_labels(spark) -> None:  # noqa: ANN001
    import zlib

    texts, marks = labelled(200)
    held = {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}
    scores = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, 1 - m if flip and i in held else m) for i, m in enumerate(marks)], "doc_id long, quality int")
        scores.append(sorted((r["doc_id"], round(r["score"], 9)) for r in quality.classify(docs(spark, texts), labels).collect()))
    assert scores[0] == scores[1]


def test_quality_without_labels_or_rows(spark) -> None:  # noqa: ANN001
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["predicted"] for r in quality.classify(docs(spark, ["a", None]), none).collect()} == {1}
    some = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert quality.classify(docs(spark, []), some).count() == 0
    assert quality.keep_good(docs(spark, ["a b c", "d"]), some).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def slow_scores_of_quality(texts: list[str], marks: list[int]) -> list[float]:
    """The method on one machine: all rows at once, normal equations from whole matrices, pooling by repeated merging."""
    import zlib

    x = np.array([quality.statistics(t) for t in texts])
    y = np.array(marks, dtype=float)
    part = np.array([zlib.crc32(str(i).encode()) % 4 for i in range(len(texts))])
    rng = np.random.default_rng(quality.SEED)
    weights = rng.normal(size=(x.shape[1], quality.FEATURES)) / (quality.WIDTH * np.sqrt(x.shape[1]))
    shift = rng.uniform(0, 2 * np.pi, quality.FEATURES)
    known = x[part != 2]
    z = np.clip((x - known.mean(axis=0)) / np.maximum(known.std(axis=0), 1e-6), -6, 6)
    z = np.hstack([np.cos(z @ weights + shift) * np.sqrt(2 / quality.FEATURES), np.ones((len(x), 1))])
    own = part < 2
    penalty = quality.RIDGE * own.sum() * np.eye(z.shape[1]) / quality.FEATURES
    penalty[-1, -1] = 1e-9
    raw = z @ np.linalg.solve(z[own].T @ z[own] + penalty, z[own].T @ y[own])
    rest = part == 3
    bins = np.floor(np.clip((raw[rest] + 0.5) / 2, 0, 1 - 1e-9) * quality.BINS)
    blocks = [[raw[rest][bins == b].sum(), y[rest][bins == b].sum(), float((bins == b).sum())] for b in np.unique(bins)]
    k = 0
    while k + 1 < len(blocks):
        if blocks[k][1] / blocks[k][2] >= blocks[k + 1][1] / blocks[k + 1][2]:
            blocks[k : k + 2] = [[a + b for a, b in zip(blocks[k], blocks[k + 1], strict=True)]]
            k = max(0, k - 1)
        else:
            k += 1
    level = np.interp(raw, [b[0] / b[2] for b in blocks], [b[1] / b[2] for b in blocks])
    return np.clip(0.999 * level + 0.001 * np.clip((raw + 0.5) / 2, 0, 1), 0, 1).tolist()


def test_quality_equals_brute_force(spark) -> None:  # noqa: ANN001
    texts, marks = labelled(400)
    rng = random.Random(19)
    marks = [m if rng.random() < 0.85 else 1 - m for m in marks]  # noise, so that calibration has something to pool
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs(spark, texts), labels).collect()}
    want = slow_scores_of_quality(texts, marks)
    assert max(abs(got[i] - w) for i, w in enumerate(want)) < 1e-6


def test_quality_fits_on_a_bounded_share(spark) -> None:  # noqa: ANN001
    texts, marks = labelled(900)
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, quality int")
    rows = quality.labelled(docs(spark, texts), labels, 200)
    assert 120 < rows.count() < 280
    got = {r["doc_id"]: r["predicted"] for r in quality.classify(docs(spark, texts), labels, 200).collect()}
    assert np.mean([got[i] == m for i, m in enumerate(marks)]) > 0.97


def test_quality_of_odd_texts(spark) -> None:  # noqa: ANN001
    texts, marks = labelled(100)
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs(spark, [*texts, *ODD], score="clash", held_out="clash"), labels).collect()}
    assert len(got) == 100 + len(ODD) and all(0 <= x <= 1 for x in got.values())


def test_isotonic_rises() -> None:
    at, level = quality.isotonic(np.arange(6.0), np.array([0, 3, 1, 2, 4, 4.0]), np.full(6, 4.0))
    assert (np.diff(level) > 0).all() and (np.diff(at) > 0).all()


# ---- decontamination -------------------------------------------------------------------------------------------------


def slow_hit(item: bytes, text: bytes) -> bool:
    """Whether a window of the item occurs in the text with few enough edits, by the full table."""
    w, e, _ = decontamination.budget(len(item))
    for s in range(len(item) - w + 1):
        pattern = item[s : s + w]
        row = [0] * (len(text) + 1)
        for i, a in enumerate(pattern, 1):
            above, row[0] = row[0], i
            for j, b in enumerate(text, 1):
                above, row[j] = row[j], min(above + (a != b), row[j] + 1, row[j - 1] + 1)
        if min(row) <= e:
            return True
    return False


def test_decontamination_equals_brute_force() -> None:
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choices("aeiostnr", k=rng.randint(1, 5))) for _ in range(n))
    items = [say(rng.randint(5, 22)) for _ in range(6)] + ["tiny", None, ""]
    index = decontamination.Index.build(list(enumerate(items)))
    for round_ in range(60):
        item = decontamination.normal(rng.choice(items[:6]))
        w, e, _ = decontamination.budget(len(item))
        s = rng.randrange(len(item) - w + 1)
        part = bytearray(item[s : s + w])
        for _ in range(rng.randint(0, 2 * e)):
            p = rng.randrange(len(part))
            part[p : p + rng.randint(0, 1)] = rng.choice([b"", b"x", b"y "])
        text = decontamination.normal(say(5)) + b" " * (round_ % 2) + bytes(part) + decontamination.normal(say(4))
        found = index.search([b"", text, b"nothing here"])
        assert found[0] == found[2] == set()
        assert found[1] == {k for k, t in enumerate(index.texts) if slow_hit(t, text)}


def test_decontamination_by_short_items(spark) -> None:  # noqa: ANN001
    """Items without a q-gram occur as whole words or not at all; very long texts are searched to their end."""
    bench = spark.createDataFrame([(1, "tiny q"), (2, "Tiny  Q!"), (3, "ab"), (4, "exactly 10"), (5, " \n")], "item_id long, text string")
    texts = ["here is tiny q now", "here is tiny qq now", "AB", "cab", "it's exactly-10, so", "w " * 300_000 + "tiny q", None, ""]
    got = [sorted(r["item_ids"]) for r in decontamination.contamination(docs(spark, texts), bench).orderBy("doc_id").collect()]
    assert got == [[1, 2], [], [3], [], [4], [1, 2], [], []]


def test_decontamination_over_tables(spark, sf_dir) -> None:  # noqa: ANN001
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog while the seven wizards wait in the hall"), (2, None), (3, "")], "item_id long, text string")
    texts = [None, "", "THE QUICK -- brown fox; jumps over\nthe lazy dog while the seven wizards wait in the hall!", "clean text", "clean text"]
    for block in (decontamination.BLOCK_BYTES, 10):  # one block, and one for each item
        got = {r["doc_id"]: r for r in decontamination.contamination(docs(spark, texts, item_ids="clash"), bench, block).collect()}
        assert [got[i]["contaminated"] for i in range(5)] == [False, False, True, False, False]
        assert got[2]["item_ids"] == [1]
    assert decontamination.contamination(docs(spark, texts), bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.contamination(docs(spark, []), bench).count() == 0
    assert [r["doc_id"] for r in decontamination.keep_clean(docs(spark, texts), bench).orderBy("doc_id").collect()] == [0, 1, 3, 4]


def test_decontamination_finds_whole_passages(spark, sf_dir) -> None:  # noqa: ANN001
    documents, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], i) for r in decontamination.contamination(documents, bench).collect() for i in r["item_ids"]}
    items = [(i, decontamination.normal(t)) for i, t in bench.select("item_id", "text").collect()]
    want = {(d, i) for d, t in documents.select("doc_id", "text").collect() for i, x in items if x in decontamination.normal(t)}
    assert want and want <= got


def test_decontamination_in_blocks_equals_one_block(spark, sf_dir) -> None:  # noqa: ANN001
    """A benchmark in many blocks gives the same rows: repeated texts, no texts, several items in one text, extra columns."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [r.text for r in bench.orderBy("item_id").limit(30).collect() if r.text]
    texts = [None, "", "clean words only", f"a {items[0]} b {items[1]} c", f"a {items[0]} b {items[1]} c", *(f"so {x} it goes" for x in items[:8])]
    rows = docs(spark, texts, item_ids="clash", _text_hash_of="kept")
    rows = rows.unionByName(rows)
    one = decontamination.contamination(rows, bench)
    many = decontamination.contamination(rows, bench, block_bytes=2000)
    assert one.columns == many.columns
    said = lambda df: sorted(map(str, df.collect()))
    assert said(one) == said(many) and many.filter("contaminated").count() >= 20
    assert many.filter(F.size("item_ids") > 1).count() >= 4
