"""Pages read and changed by positions: text, redaction, safe views and verdicts, hostile input included."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import html as H
from sparkloom.functions import pages, pay


def test_text_without_code_comments_and_hidden_elements():
    page = (
        "<html><head><title>T</title></head><body class=x><h1>A&nbsp;B</h1><!-- <p>no</p> --><svg><text>hid</text></svg><p>1&ndash;2 &lt;b&gt; &copy;&#8212;</p>"
        "<table><tr><td>c</td><td>d</td></tr></table><STYLE>p{}</STYLE><template><p>t</p></template>e<br>f  \t g<script>'<p>'</script ></body>tail"
    )
    assert pages.visible_text(page) == "A B\n\n1–2 <b> ©—\n\nc d\n\ne\nf g"
    assert pages.visible_text("<head><title>T</title></head><svg><text>hid</text></svg>a&ndash;b") == "a–b"
    assert pages.visible_text("a<!-- b --!> c") == "a" and pages.visible_text("x<script>y") == "x y"
    for odd in ("", "<", "<<>>", "&#xFFFFFFFF;", "<body>", "</body><body>x", "\x00\ud800", "</p>"):
        assert isinstance(pages.visible_text(odd), str) and isinstance(pages.redacted(odd)[0], str) and isinstance(pages.safe_view(odd), str)


@pytest.mark.parametrize(
    "page",
    ["<!--" * 20000 + "<script>" * 10000 + "<p " * 20000 + "x " * 300000, "<script>" * 10000 + "<svg>" * 10000 + "<p " * 20000 + "x " * 300000, "<svg></script>" * 40000, "<textarea>" * 40000 + "</textarea>", '<input value="' * 40000, "<input " + "value=x " * 40000 + ">", "<svg>" * 30000 + "</svg>" * 30000],
    ids=range(7),
)
def test_hostile_pages_take_linear_time(page):
    for f in (pages.visible_text, pages.redacted, pages.safe_view):
        began = time.perf_counter()
        f(page)
        assert time.perf_counter() - began < 5


def plain_without(page, name):
    """Elements removed one after the other, searched from the start each time."""
    at = 0
    while True:
        m = re.compile(rf"<{name}\b", re.I).search(page, at)
        c = m and re.compile(rf"</{name}\s*>", re.I).search(page, m.start())
        if not c:
            return page
        page, at = page[: m.start()] + page[c.end() :], m.start()


def test_elements_against_a_search_from_the_start():
    rng = random.Random(7)
    bits = ["<script>", "</script>", "<svg a='1'>", "</svg >", "<style>", "</STYLE>", "x", " ", "<p>", "<scripture>", "</", ">"]
    for _ in range(400):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        marks = pages.Markup(page, ["script", "svg", "style"])
        want = page
        for name in ("script", "style", "svg"):
            marks.elements(name)
            want = plain_without(want, name)
        assert marks.text() == want


def test_redaction_counts_every_rule():
    page = (
        '<script src=x></script><script><iframe></iframe><object>q</object><embed src=1><noscript>n</noscript><input type="hidden" value="s"><input value="me" onclick="go()"><option data-value=3>'
        '<textarea name=a>typed</textarea><meta name="csrf-token" content="1"><meta charset="u"> Ann Lee, ann lee, 555-010-0199 will Will'
    )
    text, counts = pages.redacted(page, pages.own_patterns(["Ann Lee", "(555) 010 0199", "Lee", "ab"], ["Will", ""]))
    assert text == '<input><option><textarea name=a></textarea><meta charset="u"> [redacted], [redacted], [redacted] will [redacted]'
    assert counts == {"embed": 2, "event_handler": 1, "form_value": 2, "frame": 1, "hidden_input": 1, "noscript": 1, "own_details": 4, "script": 2, "textarea_text": 1, "token_meta": 1}


def test_safe_view():
    page = '<meta http-equiv="refresh" content=0><meta charset=u><script>a</script><base href=/><p onclick="x" id=1>t<iframe src=/>u<object>v</object><embed>'
    assert pages.safe_view(page) == "<meta charset=u><p id=1>tuv</object>"


def test_columns_keep_nulls(spark):
    df = spark.createDataFrame([("<p>a<b>b", 1), (None, 2)], "h string, html int")
    got = df.select(pages.text_of(F.col("h")).alias("t"), pages.view_of(F.col("h")).alias("v"), pages.redaction_of(F.col("h"), ["a"])["html"].alias("r")).collect()
    assert tuple(got[0]) == ("ab", "<p>a<b>b", "<p>a<b>b") and tuple(got[1]) == (None, None, None)


def test_verdict_takes_the_first_step_that_holds(spark):
    form = "<form><input name=a><select></select><textarea></textarea></form>"
    cases = [
        ("https://x.org/checkpoint/1", "", form, "gated"), ("https://x.org/a", "", '<div class="cf-turnstile"></div>', "gated"), ("https://x.org/login", "", form, "login"),
        ("https://x.org/a", "", "<input type='password'><p>hi", "login"), ("https://x.org/a", "", "<input type='password'>" + "long " * 200, "unknown"), ("https://x.org/a", "Error 404", form, "missing"),
        ("https://x.org/a", "", f"You Already Applied {form}", "applied"), ("https://x.org/a", "", f"This job is closed {form}", "closed"), ("https://x.org/a", "", f"Thank you {form}", "form"),
        ("https://x.org/a", "", "Thank you", "success"), ("https://x.org/done", "", "x", "success"), ("https://x.org/a", "", '<script type="application/ld+json">{"@type": "JobPosting"}</script>', "structured"),
        ("https://x.org/a", None, None, "unknown"), ("https://x.org/a", "", "<script>already applied</script><!-- closed -->", "unknown"),
    ]
    df = spark.createDataFrame([(i, u, t, h) for i, (u, t, h, _) in enumerate(cases)], "i int, u string, t string, h string")
    h = F.col("h")
    kind = pages.page_verdict(F.col("u"), F.col("t"), h, pages.text_of(h), H.challenge(F.col("u"), h), H.fillable_form(h), ["/login"], ["already applied"], ["is closed"], ["thank you"], ["/done"])
    got = {r["i"]: r["k"] for r in df.select("i", kind.alias("k")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_annual_figures(spark):
    df = spark.createDataFrame([(20.0, "hour"), (1000.0, "week"), (3000.5, "month"), (90000.0, "year"), (90000.0, None), (500.0, None), (100.0, "day"), (700.0, "hour"), (-5.0, "year"), (None, "year")], "v double, p string")
    got = [r[0] for r in df.select(pay.annualised(F.col("v"), F.col("p"))).collect()]
    assert got == [41600, 52000, 36006, 90000, 90000, None, None, None, None, None]


def test_only_closed_entities_are_decoded_on_request():
    page = "a&amp;b &amp c&copy &lt;i&gt; &#65; &#66 &nosuch; &amp;lt; x&&amp"
    assert pages.visible_text(page, closed=True) == "a&b &amp c&copy <i> A &#66 &nosuch; &lt; x&&amp"
    assert pages.visible_text(page) == "a&b & c\u00a9 <i> A B &nosuch; &lt; x&&"


def test_a_batch_is_read_in_slices(spark):
    import pyarrow as pa

    batch = pa.array([f"<p>{i}</p>" if i % 9 else None for i in range(3 * pages.SLICE + 1)])
    got = list(pages._over(iter([batch]), pages.visible_text, pa.string()))
    assert [len(a) for a in got] == [pages.SLICE] * 3 + [1] and pa.concat_arrays(got).to_pylist() == [str(i) if i % 9 else None for i in range(len(batch))]
    df = spark.createDataFrame([("<script>a</script><script>b</script>",), (None,)], "h string")
    rows = df.select(pages.redaction_counts_of(F.col("h")).alias("c"), pages.redaction_of(F.col("h"))["counts"].alias("d"), pages.redaction_of(F.col("h"))["html"].alias("h")).collect()
    assert [tuple(r) for r in rows] == [({"script": 2}, {"script": 2}, ""), (None, None, None)]
