import math
import re
from collections import Counter, defaultdict

import pytest

from sluice.llm.language import identify, visible_text

FOLDER = "/root/testdata/sf0.01"
TEXTS = {"en": "the cat and the dog are with this house and that garden", "de": "der Hund und die Katze sind mit dem Haus und nicht allein", "fr": "le chat et le chien sont avec la maison et dans les jardins"}


def page(lang, text, declared=None):
    return f'<html lang="{declared or lang}"><head><script>var x = "the and";</script></head><body><nav>der die das</nav><p>{text}</p><footer>und</footer></body></html>'


def tables(spark, pages):
    docs = spark.createDataFrame([(i, t, lang, "x") for i, (lang, t) in enumerate([*TEXTS.items()] * 5)] + [(90, None, "en", "x"), (91, "nichts", None, "x")], "doc_id bigint, text string, lang string, post string")
    return spark.createDataFrame([(*p, "x", 1.0) for p in pages], "page_id bigint, url string, html string, host string, loglik double"), docs


def test_evidence_is_fused(spark):
    pages = [(i, f"https://www.seite.de/{i}", page("de", TEXTS["de"])) for i in range(8)] + [(20 + i, f"http://user@site.com:80/{i}", page("en", TEXTS["en"])) for i in range(8)]
    pages += [(40, "https://www.seite.de/x", page("de", "")), (41, "https://other.de/", page("de", "")), (42, "https://www.seite.de/y", page("fr", TEXTS["fr"] * 3, "de"))]
    pages += [(43, None, None), (44, "", ""), (45, "no address", "no markup"), (46, "https://site.com/z", page("en", "", " ")), (46, "https://site.com/z", page("en", "", " "))]
    rows = identify(*tables(spark, pages)).collect()
    found = {r["page_id"]: r["lang"] for r in rows}
    assert len(rows) == len(pages)
    assert all(found[i] == "de" for i in range(8)) and all(found[20 + i] == "en" for i in range(8))
    assert found[40] == "de" and found[41] == "de" and found[46] == "en"  # no text: host and suffix, markup
    assert found[42] == "fr"  # the text against markup and host
    assert all(r["lang"] in TEXTS and 1 / 3 <= r["confidence"] <= 1 + 1e-9 for r in rows)
    assert {r["host"] for r in rows if r["page_id"] >= 43 and r["page_id"] <= 45} == {""}


def test_hidden_text_is_left_out():
    assert visible_text(page("en", "a &amp; b<br>c")) == "a & b c"
    assert visible_text(None) == "" == visible_text("<!-- x --><style>p{}</style>")


def test_pages_agree_with_their_address(spark):
    """The test data name the language of a page in its address."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    rows = identify(pages, spark.read.parquet(f"{FOLDER}/documents.parquet")).join(pages.select("page_id", "url"), "page_id").collect()
    truth = [re.search(r"/(en|de|fr|es)/", r["url"])[1] for r in rows]
    assert sum(r["lang"] == t for r, t in zip(rows, truth)) >= 0.97 * len(rows)
    assert sum(r["text_lang"] == t for r, t in zip(rows, truth)) >= 0.95 * len(rows)


def test_empty_tables(spark):
    pages, docs = tables(spark, [(1, "https://a.de/", page("de", "und"))])
    assert identify(pages.limit(0), docs).collect() == []
    assert [r["lang"] for r in identify(pages, docs.limit(0)).collect()] == [None]


def brute(pages, docs):
    """Languages and confidences from dictionaries of counts, page by page, by the definition."""

    def grams(text):
        raw = f" {text.lower()} ".encode()
        return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(raw) - 2)]

    def address(url):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        return m[1].lower() if m else ""

    def markup(page):
        m = re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", page or "")
        return m[1].lower() if m else ""

    names = sorted({x for _, x in docs})
    counts = {x: Counter(g for t, y in docs if y == x for g in grams(t)) for x in names}
    sizes = {x: sum(c.values()) + 0.5 * 65536 for x, c in counts.items()}
    seen = []
    for i, url, page in pages:
        found = grams(visible_text(page)) if visible_text(page) else []
        text = [sum(math.log((counts[x][g] + 0.5) / sizes[x]) for g in found) / (1 + len(found) / 50) for x in names]
        share = [math.exp(v - max(text)) for v in text]
        host = address(url)
        seen.append((i, host, host.split(".")[-1], markup(page), text, [v / sum(share) for v in share]))

    def summed(group):
        out = defaultdict(lambda: [0.0] * len(names))
        for row in seen:
            out[group(row)] = [a + b for a, b in zip(out[group(row)], row[5])]
        return out

    every, suffixes, hosts, declared = (summed(g) for g in (lambda r: 0, lambda r: r[2], lambda r: r[1], lambda r: r[3]))
    overall = [(v + 1) / (sum(every[0]) + len(names)) for v in every[0]]
    for i, host, suffix, mark, text, own in seen:
        above = [(c + 20 * p) / (sum(suffixes[suffix]) + 20) for c, p in zip(suffixes[suffix], overall)]
        others = [max(a - b, 0) for a, b in zip(hosts[host], own)]
        prior = [(c + 5 * p) / (sum(others) + 5) for c, p in zip(others, above)]
        right = [0.9 if x == mark else 0.1 / max(len(declared) - 1, 1) for x in names]
        said = [1.0] * len(names) if mark == "" else [(c + 20 * e) / (n + 20) for c, e, n in zip(declared[mark], right, every[0])]
        logs = [v + math.log(p) + math.log(d) for v, p, d in zip(text, prior, said)]
        yield i, names[logs.index(max(logs))], 1 / sum(math.exp(v - max(logs)) for v in logs)


def test_equal_to_the_definition(spark):
    """The posterior of every page of the test data; with so high a bound every labelled document is in the sample."""
    pages, docs = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("pages", "documents"))
    odd = spark.createDataFrame([(-1, None, None), (-2, "", ""), (-3, "https://user@Odd.EXAMPLE:80/x", "<HTML lang='DE'><p>und der"), (-3, "ftp://odd.example", "<p>the")], "page_id bigint, url string, html string")
    pages = pages.select("page_id", "url", "html").union(odd)
    found = sorted(identify(pages, docs, per_language=10**6).select("page_id", "lang", "confidence").collect())
    labelled = [tuple(r) for r in docs.select("text", "lang").collect() if None not in tuple(r)]
    expected = sorted(brute([tuple(r) for r in pages.collect()], labelled))
    assert len(found) == len(expected) > 20
    for f, e in zip(found, expected):
        assert f[0] == e[0] and f[2] == pytest.approx(e[2], rel=1e-6)
        assert f[1] == e[1] or e[2] < 0.5 + 1e-6
