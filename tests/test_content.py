"""Main content of pages against a walk with a stack of open elements."""

import random
import re

from folioscope.operators import content


def walk(html):
    """Elements by a stack for each kind: (tag, start, finish, chars, links), segments counted from 0."""
    html = re.sub(r"(?is)<!--.*?(?:-->|$)|<(script|style|noscript|template|head)\b.*?(?:</\1\s*>|$)", "", html)
    parts = re.findall(r"(?s)<[/!?A-Za-z][^>]*>|[^<]+|<", html)
    open_, out, asides, links, chars, linked = {}, [], 0, 0, 0, 0
    for i, s in enumerate(parts):
        m = re.match(r"(?s)^<(/?)([A-Za-z][A-Za-z0-9]*)[^>]*>$", s)
        if m and not s.endswith("/>"):
            tag, closes = m[2].lower(), bool(m[1])
            if tag == "a":
                links = max(0, links - 1) if closes else links + 1
            elif tag in content.ASIDE:
                asides = max(0, asides - 1) if closes else asides + 1
            elif tag in content.CONTAINERS:
                stack = open_.setdefault(tag, [])
                if not closes:
                    stack.append((i, chars, linked))
                elif stack:
                    a, c, k = stack.pop()
                    out.append((tag, a, i, chars - c, linked - k))
        elif not re.match(r"(?s)^<[/!?A-Za-z][^>]*>$", s) and not asides:
            for e, to in content.ENTITIES:
                s = s.replace(e, to)
            n = len(re.sub(r"[ \t\n\x0b\f\r\xa0]", "", s))
            chars += n
            linked += n if links else 0
    out += [(tag, a, len(parts) - 1, chars - c, linked - k) for tag, stack in open_.items() for a, c, k in stack]
    return sorted(out)


def elements(spark, pages):
    got = {}
    for x in content.elements(spark.createDataFrame(pages, "page_id long, html string")).collect():
        got.setdefault(x.page_id, []).append((x.tag, x.start, x.finish, x.chars, x.links))
    return {p: sorted(v) for p, v in got.items()}


def test_elements_against_a_stack(spark):
    r = random.Random(1)
    bits = ["<div>", "</div>", "<div class='x'>", "<p>", "</p>", "<section>", "</section>", "<a href='y'>", "</a>", "<nav>", "</nav>", "<main>", "</main>", "<br/>", "<div/>", "text ", " &amp; more", "<!-- <div> -->", "<script>if (a<b) '</div>'</script>", "5 < 6 ", " ", "<ARTICLE>", "</Article>"]
    pages = [(i, "".join(r.choice(bits) for _ in range(r.randrange(1, 60)))) for i in range(120)] + [(900, None), (901, ""), (902, "<!-- never closed <div>text"), (903, "</div></div><div>a</div>")]
    got = elements(spark, pages)
    for i, html in pages:
        assert got.get(i, []) == walk(html or ""), html


def test_given_pages_against_a_stack(spark):
    pages = [(x.page_id, x.html) for x in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()]
    got = elements(spark, pages)
    assert all(got.get(i, []) == walk(html) for i, html in pages) and len(got) > 10


def test_choice(spark):
    long, links = "word " * 60, "<a href='x'>" + "link " * 70 + "</a>"
    pages = {
        1: f"<body><div>{long}{long}</div><article>small</article><main>tiny text</main></body>",
        2: f"<body><article>{long}</article><main>{long}</main></body>",
        3: f"<body><nav>{long}{long}</nav><div>{links}</div><section><h1>Head</h1><p>{long}&amp; end</p></section></body>",
        4: "<body><div>short</div> words</body>",
        5: "plain &lt;text&gt; only",
        6: f"<div id='outer'><div>{long}",
        7: "<body><script>x</script></body>",
        8: None,
    }
    got = {x.page_id: x for x in content.main_content(spark.createDataFrame(list(pages.items()), "page_id long, html string")).collect()}
    assert [(got[i].container, got[i].tag, got[i].outcome) for i in pages] == [
        ("main_or_article", "main", "short"), ("main_or_article", "main", "ready"), ("density", "section", "ready"), ("body", "body", "short"), ("page", None, "short"), ("density", "div", "ready"), ("body", "body", "empty"), ("page", None, "empty"),
    ]
    assert got[3].text == "Head\n" + long.strip() + " & end" and got[5].text == "plain <text> only" and got[6].text == long.strip() and got[4].text == "short\nwords"
