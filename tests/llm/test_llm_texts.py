"""Page texts, fingerprints, token counts and licence scans."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from datadict.llm import fingerprints, html_extract, html_lines, licenses, token_counts

# --- pages --------------------------------------------------------------------------------------


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        found = html_lines.shared_lines(a, b)
        rest = iter(b)
        assert len(found) == lcs(a, b) and found == sorted(set(found)) and all(any(x == y for y in rest) for x in (a[i] for i in found))


@pytest.mark.parametrize("html, text", [
    ("<article><h1>A &amp; B</h1><p>x<br>y\n z<p>u</article>", "A & B\nx y z\nu"),
    ("<nav>n</nav><article><header><h1>T</h1></header><p>b</p><aside>s</aside><div class='share-buttons'>z</div></article><footer>f", "T\nb"),
    ("<body><header>top</header><main><p>m<form>f</form></main><div id=comments>c</div></body>", "m"),
    ("<article>one<div class='ad'>buy</div>two <script>if (a<b) document.write('</p>')</script>three", "one\ntwo three"),
    ("<article><section class='comments'><p>c</p></section><p>kept &lt;b&gt; &nbsp; &#233;</p></article>", "kept <b> é"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", "a\nb\n1 2"),
    ("<article><p title='a > b'>q</p><!-- no <p> --><style>p{}</style></article>", "q"),
    ("<article><h1 id=menu-theory>M</h1><h2 id='search'>S</h2><p class='notice-period'>n</p><div class='related-work'><p>w</p></div></article>", "M\nS\nn\nw"),
    ("<article><p>a</p><div class='related-posts widget2'>r</div><div id='comments-list'>c</div><p class=ad>x</p></article>", "a"),
    ("<body><form action=x><h1>T</h1><input name=q><p>body</p>Name<label>l</label><button>go</button></form></body>", "T\nbody"),
    ("<body><p>text</p><form><p>Sign up</p></form></body>", "text"),
    ("<article><p>cut <b>off", "cut off"), ("", ""), ("plain text", "plain text"), ("<article></article>", ""),
])
def test_marked_pages(spark, html, text):
    lines, parts, doubts = html_lines.page_lines(html)
    said = html_extract.verdicts(parts, doubts)
    assert "\n".join(t for t, v in zip(lines, said) if v != html_extract.FRAME) == text


def test_page_differencing(spark):
    def page(t):
        return f"<html><body><div>Site name</div><div>Home</div><p>{t} one</p><p>{t} two</p><div>Copyright</div></body></html>"

    rows = [(1, "http://a.b/x/1", page("A")), (2, "http://A.b/x/2?q", page("B")), (2, "http://A.b/x/2?q", page("B")),
            (3, None, page("C")), (4, "http://c.d", None), (None, "http://e.f/1", page("D")), (5, "http://a.b/y", page("E"))]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], "page_id long, url string, html string, key int, dropped string")
    got = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_extract.main_text(df).collect())
    alone = lambda t: f"Site name\nHome\n{t} one\n{t} two\nCopyright"
    want = {1: "A one\nA two", 2: "B one\nB two", 3: alone("C"), 4: "", None: alone("D"), 5: "E one\nE two"}
    assert got == Counter((i, u, want[i], len(want[i])) for i, u, _ in rows)
    assert html_extract.main_text(df.limit(0)).count() == 0


def twin(pages):
    """Text and deleted lines of each page, from plain loops over sorted pages."""
    def key(url):
        rest = url.split("://", 1)[1]
        host, _, path = rest.partition("/")
        return host.lower(), "/" + path.split("?")[0].split("#")[0]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    parsed = {i: html_lines.page_lines(html) for i, _, html in pages}
    order = sorted((*key(url), i) for i, url, _ in pages)
    out = {}
    for at, (host, path, i) in enumerate(order):
        lines, parts, doubts = parsed[i]
        best = min((p for p in parts if p), default=html_lines.OTHER)
        text = [p == best for p in parts]
        sure = [t and not d and best not in (html_lines.OTHER, html_lines.FORM) for t, d in zip(text, doubts)]
        near = [order[k] for k in (at - 1, at + 1) if 0 <= k < len(order) and order[k][0] == host]
        near.sort(key=lambda o: -common(o[1], path))
        own, gone, tables = {k for k, t in enumerate(text) if t}, set(), []
        for o in near:
            other = parsed[o[2]][0]
            best_at = [[0] * (len(other) + 1) for _ in range(len(lines) + 1)]
            for x in range(len(lines)):
                for y in range(len(other)):
                    best_at[x + 1][y + 1] = best_at[x][y] + 1 if lines[x] == other[y] else max(best_at[x][y + 1], best_at[x + 1][y])
            x, y, both = len(lines), len(other), set()
            while x and y:
                if lines[x - 1] == other[y - 1]:
                    x, y = x - 1, y - 1
                    both.add(x)
                elif best_at[x - 1][y] >= best_at[x][y - 1]:
                    x -= 1
                else:
                    y -= 1
            if not own or own - both:
                tables.append(both)
        for k, both in enumerate(tables):
            if own and len(own & both) >= 0.8 * len(own) and k + 1 < len(tables):
                both &= tables[k + 1]
            gone = {x for x in both if not sure[x]}
            if gone:
                break
        out[i] = ("\n".join(t for k, t in enumerate(lines) if text[k] and k not in gone), len(gone))
    return out


def test_page_texts_equal_a_twin(spark, sf_dir):
    """The given pages, and made ones without marks: frames of all sizes, copies, near copies."""
    rng, made = random.Random(3), []
    for i in range(120):
        host, frame = i % 4, 2 + 8 * (i % 4)
        body = [f"<p>own {i if rng.random() < 0.8 else i - 4} {k}</p>" for k in range(rng.randrange(1, 9))]
        frames = [f"<div>frame {host} {k}</div>" for k in range(frame)]
        kind = "<article>{}<div class='related-work'>{}</div></article>" if i % 10 == 9 else "{}{}"
        html = kind.format("".join(frames[:frame // 2]) + "".join(body), "".join(frames[frame // 2:]))
        made.append((10000 + i, f"https://H{host}.org/{rng.randrange(3)}/p{i:03}?q={i}", html))
    given = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    kind = "page_id long, url string, html string"
    got = {r["page_id"]: (r["text"], r["n_deleted"]) for r in html_extract.main_text(spark.createDataFrame(made, kind)).collect()}
    assert got == twin(made) and sum(n for _, n in got.values()) > 500
    assert not any("frame" in t for i, (t, n) in got.items() if n and (i - 10000) % 10 != 9)
    seen = {r["page_id"]: (r["text"], r["n_deleted"]) for r in html_extract.main_text(spark.createDataFrame(given, kind)).collect()}
    want = twin(given)
    assert {i: t for i, (t, _) in seen.items()} == {i: t for i, (t, _) in want.items()}
    assert sum(n for _, n in seen.values()) == sum(n for _, n in want.values())


def test_alignment_of_very_long_pages():
    """Rows of the table are made again between kept ones; the memory does not grow with the product."""
    a = [x for k in range(12000) for x in (k, -k - 1)]
    b = [x for k in range(12000) for x in (k, 10 ** 6 + k)]
    assert html_lines.shared_lines(a, b) == list(range(0, 24000, 2))


# --- fingerprints -------------------------------------------------------------------------------

def test_neighbours_and_edits(spark):
    rng = random.Random(5)
    rows = [(i * 3, " ".join(rng.choice(["käse", "b", "c", "d", "e"]) for _ in range(rng.randrange(40)))) for i in range(120)]
    rows[7] = (21, None)
    df = spark.createDataFrame([(*r, 0, False) for r in rows], "doc_id long, text string, part int, ahead boolean").repartition(5)
    got = {r["doc_id"]: r for r in fingerprints.edited_pairs(df).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        near, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[:len(t) - half] + near[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        bins = fingerprints.bins_of(pa.array([t, edited, near]))
        assert r["fingerprint"] == fingerprints.as_text(bins[:1])[0] and r["edited_fingerprint"] == fingerprints.as_text(bins[1:2])[0]
        assert (r["near_edited"], r["near_next"]) == tuple(fingerprints.likeness(bins[[0, 0]], bins[[1, 2]]))


def test_fingerprint_edges(spark):
    run = lambda rows: fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert run([]) == []
    assert [(r["doc_id"], r["near_edited"], r["near_next"]) for r in run([(1, None)])] == [(1, 1.0, 1.0)]
    rows = [(None, "a b"), (None, "c"), (3, None), (3, "x y z w"), (3, "x y z w"), (9, "z" * 100000)]
    got = run(rows)
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 7}) == 1


def test_likeness_follows_edits():
    rng = random.Random(3)
    words = [f"w{rng.randrange(4000)}" for _ in range(600)]
    texts = [" ".join(words)]
    for share in (0.02, 0.1, 0.5):
        other = list(words)
        for i in rng.sample(range(600), int(600 * share)):
            other[i] = "new" + str(i)
        texts.append(" ".join(other))
    texts.append(" ".join(words[300:] + words[:300]))
    bins = fingerprints.bins_of(pa.array(texts))
    near = [float(fingerprints.likeness(bins[:1], bins[i:i + 1])[0]) for i in range(len(texts))]
    assert near[0] == 1.0 and near[0] > near[1] > near[2] > near[3]
    assert near[4] < 0.9  # the same k-mers in another order are less alike
    assert np.array_equal(fingerprints.bins_of(pa.array([None, ""])), np.zeros((2, 64)))


def test_one_token_counter_for_all_tasks_of_a_process():
    assert token_counts.pre_token_counter() is token_counts.pre_token_counter()


# --- token counts -------------------------------------------------------------------------------

def test_edits_count_as_a_new_count():
    pattern, count = token_counts.pre_token_counter()
    rng = random.Random(5)
    bits = ["'", "r", "e", "s", " ", "  ", "\n", "a", "Bc", "12", ".", "é", "!?", "'re", "ll", " x", "<|endoftext|>", "日本", "\x1c", "\xa0"]
    some = lambda k: "".join(rng.choice(bits) for _ in range(rng.randrange(k + 1)))
    whole = lambda t: sum(map(count, pattern.findall(t)))
    for n in range(800):
        text = some(400 if n % 3 else 40)
        tree = token_counts.TokenTree(*token_counts.leaves_of(text, pattern, count))
        for _ in range(5):
            tree, text, _ = token_counts.edit(tree, text, rng.randint(-2, len(text) + 3), rng.choice([0, 0, 1, 2, 5, 40, 300]),
                                              some(rng.choice([0, 1, 3, 30, 900])), pattern, count)
            assert tree.n_tokens == whole(text) and tree.chars[1] == len(text)


def test_edited_counts(spark):
    rows = [(1, "Some words, and more: it's 12 o'clock. " * 30), (2, None), (2, ""), (None, "x"), (3, "ab" * 20000), (1, "a b")]
    got = token_counts.edited_counts(spark.createDataFrame([(*r, 0, "") for r in rows], "doc_id long, text string, edits int, tree_chars string")).collect()
    pattern, count = token_counts.pre_token_counter()
    want = Counter()
    for i, t in rows:
        t = t or ""
        n = len(t)
        e = t[:n // 2] + t[n // 2 + 10:]
        e = e[:n // 3] + t[:20] + e[n // 3:]
        e = e[:max(0, len(e) - 5)] + t[:7]
        want[i, n, sum(map(count, pattern.findall(t))), len(e), sum(map(count, pattern.findall(e)))] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["n_tokens"], r["edited_n_chars"], r["edited_n_tokens"]) for r in got) == want
    assert token_counts.edited_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- licences -----------------------------------------------------------------------------------

FILES = [
    (1, "r/LICENSE", "Released under the MIT License."), (2, "r/a/b/x.py", "code"), (3, "r/a/COPYING", "Licensed under the Apache License, Version 2.0."),
    (4, "r/a/c.py", "# This work is licensed under the GNU General Public License, version 3.\ncode"), (5, "s/x.py", "code"),
    (6, "r/z.py", None), (7, None, "Released under the MIT License."), (8, None, "nothing"), (9, "top.py", ""), (None, "r/a/b/x.py", "the of")]


def test_license_scan(spark):
    df = spark.createDataFrame([(*f, 0, "") for f in FILES], "doc_id long, path string, text string, best int, holder string")
    got = {(r["doc_id"], r["path"]): (r["license"], r["scope"], r["from_path"]) for r in licenses.license_scan(df).collect()}
    assert got == {
        (1, "r/LICENSE"): ("MIT", "own", None), (2, "r/a/b/x.py"): ("Apache-2.0", "inherited", "r/a/COPYING"),
        (3, "r/a/COPYING"): ("Apache-2.0", "own", None), (4, "r/a/c.py"): ("GPL-3.0", "own", None), (5, "s/x.py"): (None, "none", None),
        (6, "r/z.py"): ("MIT", "inherited", "r/LICENSE"), (7, None): ("MIT", "own", None), (8, None): (None, "none", None),
        (9, "top.py"): (None, "none", None), (None, "r/a/b/x.py"): ("Apache-2.0", "inherited", "r/a/COPYING")}
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_licence_files_of_any_length(spark):
    """A long text with a notice is a licence file as a short one is; others of its folder inherit from it."""
    notice = "Released under the MIT License."
    rows = [(3, "web", "en", "word " * 5000 + "\n" + notice), (4, "web", "en", "nothing"), (5, None, None, None), (None, "web", "en", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    paths = {r["doc_id"]: r["path"] for r in licenses.with_paths(df).collect()}
    assert paths == {3: "web/LICENSE-3", 4: "web/en/0/4.txt", 5: "unknown/unknown/0/5.txt", None: "web/en/0/null.txt"}
    got = {r["doc_id"]: (r["license"], r["scope"], r["from_path"]) for r in licenses.license_scan(licenses.with_paths(df)).collect()}
    assert got == {3: ("MIT", "own", None), 4: ("MIT", "inherited", "web/LICENSE-3"), 5: (None, "none", None),
                   None: ("MIT", "inherited", "web/LICENSE-3")}


def test_cosine_against_all_terms():
    """The lines that are passed by could not have reached the limit."""
    texts = [t for _, _, t in FILES if t] + list(licenses.TEMPLATES.values()) + ["version 2", "the work is under license", "released to the public"]
    having = Counter(t for x in texts for t in licenses.terms_of(x))
    scanner = licenses.Scanner(licenses.TEMPLATES, len(texts), having, licenses.LIMIT)
    weight = lambda t: math.log((1 + len(texts)) / (1 + having[t])) + 1
    for text in texts:
        best = 0.0
        v = {t: c * weight(t) for t, c in licenses.terms_of(text).items()}
        for template in licenses.TEMPLATES.values():
            w = {t: c * weight(t) for t, c in licenses.terms_of(template).items()}
            dot = sum(x * w.get(t, 0) for t, x in v.items())
            best = max(best, dot / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in w.values())) if v else 0)
        found = scanner.best(text)
        assert (found is not None) == (best >= licenses.LIMIT) and (found is None or abs(found[1] - best) < 1e-9)
