"""Main text of HTML pages: the maximum-scoring subsequence of words and tags, weights from labelled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their part in a page (fixed values).
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td
tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
BOILER = frozenset("""nav header footer aside form button select option menu dialog svg canvas object audio video map label
fieldset""".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that mark what is not the article (fixed values): whole words, and beginnings.
HINTS = frozenset("""ad ads adv alert banner consent dialog dropdown form foot footer gdpr header hidden legal login
menu modal nav navi navigation notice notices notification overlay pager pagination paywall popup reply replies respond reviews
search share sharing shares side signup skip social sponsored sticky tagcloud toc toolbar tooltip topbar widget
contentinfo complementary""".split())
STEMS = ("advert", "breadcrumb", "comment", "cookie", "copyright", "disclaimer", "disqus", "masthead", "navbar", "newsletter",
         "outbrain", "promo", "recommend", "related", "sidebar", "sponsor", "subscri", "taboola", "teaser")
# Words that say nothing of their own in a class name made of several (fixed values).
NEUTRAL = frozenset("""area articles bar block blocks body bottom box button buttons column container content icon icons inner item items
left link links list main module outer panel posts primary right row secondary section small stories top unit wrap wrapper zone""".split())
ON_ARTICLE = ("advert", "comment", "promo", "recommend", "related", "sponsor", "teaser", "reply", "replies", "ad", "ads")
# Weights where no page is labelled: a word, a tag by its name.
PRIOR = {"word": 1.0, "a": -0.5, "li": -0.3, "other": -0.2}
LINKED = 0.2  # of its weight that a word in a link keeps
BONUS = 1.0  # of its weight that a word gains in an element that marks the article
# Elements that no share of the page's words makes the article; words that a mark needs to be overruled
# where it holds no heading, article or main, and its least ratio to the words outside of all marks.
NEVER = frozenset("nav footer aside button select option menu dialog svg canvas object audio video map label".split())
BODY_WORDS, BODY_RATIO = 50, 10


def _patterns():
    import re

    return {
        "tag": re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"),
        "loose": re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^>]*)>"),
        "attr": re.compile(r"(?:^|[\s\"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I),
        "part": re.compile(r"[a-z]+"),
        "raw": {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW},
        "space": re.compile(r"\s+"),
    }


# Marks that stand; that tell of what is said about articles; of any other kind; and, inside an article, of a class
# name with other words in it (related-work), which counts only if the element looks like boilerplate as well.
FIXED, ABOUT, WRAP, HINT = 1, 2, 3, 4
CONTROLS = frozenset("input textarea select button".split())
FEW_WORDS, FEW_SHARE, FORM_WORDS = 30, 20, 100  # what looks like boilerplate: few words, a small part of the page; a form


def _names(one: str, name: str, pat) -> int:
    """The mark that one class name, id or role tells: 0, ABOUT or WRAP; HINT where it has other words too."""
    parts = pat["part"].findall(one)
    hints, found = 0, 0
    for part in parts:
        about = part in ON_ARTICLE or part.startswith(ON_ARTICLE[:7])
        if about if name in CONTENT else part in HINTS or part.startswith(STEMS):
            hints += 1
            found = ABOUT if about or found == ABOUT else WRAP
        else:
            hints += part in NEUTRAL
    return found if not found or hints == len(parts) else -found


def _boiler(name: str, attrs: str, pat, inside: bool = False, in_form: bool = True) -> int:
    """The mark of an element that, by its name and attributes, is not part of an article; else 0. Inside an
    article, a label outside forms is prose, and class names with other words in them are hints only."""
    mark = 0
    if name == "label" and inside and not in_form:
        return 0
    if name in BOILER:
        mark = FIXED if name in NEVER else WRAP
    if not attrs or name in ("html", "body", "main"):
        return mark
    for key, value in pat["attr"].findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true" and name not in CONTENT):
            return FIXED
        if key == "style":
            if "display:none" in value.replace(" ", ""):
                return FIXED
            continue
        for one in value.split():
            if mark == FIXED or one.startswith(("has-", "no-", "with-", "is-", "js-")):
                continue
            found = _names(one, name, pat)
            if found < 0:
                found = HINT if inside else -found
            if found and (mark in (0, HINT) or found == ABOUT):
                mark = found
    return mark


def _settled(nodes, items):
    """items of scan() with their nodes -> (items, labelled), where nodes are resolved to flags.

    A node is a marked element, or an article or main element. A mark is overruled when its element holds
    more than half of the page's words and three times those outside of all marks, and it holds a main or
    (but for what is said about articles) an article; or BODY_WORDS words, and either an h1 or
    BODY_RATIO times the words outside. Words in links count for none of this. FIXED marks stand. A HINT counts
    only where most of the element's words are in links, it is a small form, or it has FEW_WORDS and one in
    FEW_SHARE of the page's at most."""
    words, linked, controls = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for it in items:
        if it[0] is None:
            (linked if it[6] else words)[it[5]] += it[2]
        elif it[0] in CONTROLS:
            controls[it[2]] += 1
    total, free = sum(words), words[0]
    holds = [0] * len(nodes)  # bits: an article, a main, an h1
    for k in range(len(nodes) - 1, 0, -1):
        up, _, mark, _, own = nodes[k]
        holds[k] |= own
        if mark > 0:
            words[up] += words[k]
            linked[up] += linked[k]
            controls[up] += controls[k]
        holds[up] |= holds[k]
    out, inner, live, labelled = [False] * len(nodes), [False] * len(nodes), [False] * len(nodes), False
    for k in range(1, len(nodes)):
        up, within, mark, header, own = nodes[k]
        out[k], inner[k], live[k] = out[up], inner[up], live[within]
        if mark > 0:
            n = words[k]
            if mark == HINT and not (linked[k] > n or (controls[k] and n < FORM_WORDS)
                                     or (n + linked[k] <= FEW_WORDS and FEW_SHARE * n <= total)):
                continue
            body = n >= BODY_WORDS and (holds[k] & 4 or (mark == WRAP and n > BODY_RATIO * free))
            over = mark != FIXED and 2 * n > total and n >= 3 * free and bool(
                holds[k] & (2 if mark == ABOUT else 3) or body)
            out[k] |= not over
            inner[k] |= not over and not (header and live[within])  # of a header inside an article, headings belong to it
        elif mark == 0 and not out[up]:
            live[k] = labelled = True
    got = []
    for it in items:
        if it[0] is not None:
            got.append((it[0], live[it[1]], out[it[2]]))
        else:
            got.append((None, live[it[1]], it[2], it[3], it[4], (inner if it[7] else out)[it[5]], it[6]))
    return got, labelled


def scan(html: str, pat):
    """Page -> (items, labelled). items: (tag name, inside an article, in boilerplate) or, for a run of
    text, (None, inside, words, block, text, boilerplate, in a link); linear in the page. Unclosed comments, scripts and
    tags run to the page's end, as in browsers."""
    import html as h

    tag, loose, raw, space = pat["tag"], pat["loose"], pat["raw"], pat["space"]
    items, stack, opened = [], [], {}
    nodes = [(0, 0, 0, False, 0)]  # marked around it, article around it, mark (-1 for an h1), a header, bits it tells its marks
    boiler = article = block = headings = 0  # innermost marked and article nodes; number of the block; open headings
    last = html.rfind(">")
    pos, n = 0, len(html)

    def text(s):
        if s:
            s = h.unescape(s) if "&" in s else s
            items.append((None, article, len(s.split()), block, s, boiler, opened.get("a", 0) > 0, headings > 0))

    def pop(name):
        nonlocal boiler, article, headings
        while stack:
            e = stack.pop()
            opened[e[0]] -= 1
            boiler, article = e[1], e[2]
            headings -= e[0] in HEADINGS
            if e[0] == name:
                return

    while pos < n:
        at = html.find("<", pos)
        if at < 0:
            text(html[pos:])
            break
        text(html[pos:at])
        after = html[at + 1: at + 2]
        if after == "!" or after == "?":
            if html.startswith("<!--", at):
                end = html.find("-->", at + 2 if html.startswith("<!-->", at) else at + 4)
                pos = n if end < 0 else end + 3
            elif html.startswith("<![CDATA[", at):
                end = html.find("]]>", at)
                text(html[at + 9: n if end < 0 else end].replace("&", "&amp;"))
                pos = n if end < 0 else end + 3
            else:
                end = html.find(">", at)
                pos = n if end < 0 else end + 1
            continue
        if not (after.isascii() and after.isalpha()) and not (after == "/" and html[at + 2: at + 3].isascii() and html[at + 2: at + 3].isalpha()):
            text("&lt;")
            pos = at + 1
            continue
        m = (tag.match(html, at) or loose.match(html, at)) if at < last else None
        if m is None:  # a tag that the page's end cuts off
            break
        close, name, attrs = m[1], m[2].lower(), m[3]
        pos = m.end()
        if name in BLOCKS:
            block += 1
        elif name == "br" or name == "img":
            items.append((None, article, 0, block, " ", boiler, False, False))
        if close:
            if opened.get(name):
                items.append((name, article, boiler))
                pop(name)
            continue
        if name in raw:
            end = raw[name].search(html, pos)
            pos = n if end is None else end.start()
            if end is not None:
                stop = html.find(">", pos)
                pos = n if stop < 0 else stop + 1
            continue
        if name in BLOCKS and opened.get("p"):
            pop("p")
        if name == "li" and stack and any(e[0] == "li" for e in stack[-2:]) and not any(e[0] in ("ul", "ol") for e in stack[-1:]):
            pop("li")
        mark = _boiler(name, attrs, pat, bool(article), bool(opened.get("form") or opened.get("fieldset")))
        items.append((name, article, boiler))
        if name in VOID or attrs.endswith("/") and name not in BLOCKS:
            continue
        stack.append((name, boiler, article))
        opened[name] = opened.get(name, 0) + 1
        if mark:
            nodes.append((boiler, article, mark, name == "header", 0))
            boiler = len(nodes) - 1
        elif name in CONTENT or name == "h1":
            nodes.append((boiler, article, -1 if name == "h1" else 0, False, {"article": 1, "main": 2, "h1": 4}[name]))
            if name in CONTENT:
                article = len(nodes) - 1
        headings += name in HEADINGS
    return _settled(nodes, items)


def best_region(scores):
    """(first, last) of the contiguous items of greatest sum, the first and then the longest of equals;
    None if no item scores above zero. One pass."""
    best, found, total, start = 0.0, None, 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best or (found is not None and total == best and start == found[0]):
            best, found = total, (start, k)
    return found


def main_text(html: str | None, weights: dict, pat) -> str:
    """The blocks of the best region, without what isn't the article, joined by line feeds.

    Every page is scored: an article or main element adds BONUS to its words, no more. Where at least half
    of the best region's words lie in such elements, the text is theirs, from all those that the region
    touches; else it is the region's, inside and out."""
    if not html:
        return ""
    items, _ = scan(html, pat)
    word, other = weights["word"], weights["other"]
    scores = []
    for it in items:
        if it[0] is not None:  # what goes in any case is no reason to end the region
            scores.append(0.0 if it[2] else weights.get(it[0], other))
        elif it[5]:
            scores.append(0.0)
        else:
            scores.append(word * it[2] * (1 + BONUS if it[1] else LINKED if it[6] else 1.0))
    region = best_region(scores)
    if region is None:
        return ""
    first, last = region
    inside = sum(it[2] for it in items[first: last + 1] if it[0] is None and it[1] and not it[5])
    outside = sum(it[2] * (LINKED if it[6] else 1) for it in items[first: last + 1] if it[0] is None and not it[1] and not it[5])
    marked = inside > 0 and inside >= outside
    if marked:  # the whole of the elements at its ends
        while first > 0 and items[first][1] and items[first - 1][1]:
            first -= 1
        while last + 1 < len(items) and items[last][1] and items[last + 1][1]:
            last += 1
    use = {it[3] for it in items[first: last + 1] if it[0] is None}
    parts: dict[int, list[str]] = {}
    for it in items:
        if it[0] is None and it[3] in use and not it[5] and (it[1] or not marked):
            parts.setdefault(it[3], []).append(it[4])
    lines = (pat["space"].sub(" ", "".join(p)).strip() for p in parts.values())
    return "\n".join(x for x in lines if x)


def page_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from the labelled pages: those that mark their article with an article or main element that
    holds at least half of the words (teasers elsewhere than in the article say nothing).

    A word weighs the share of text words that lie in the article; a tag weighs minus its share
    outside, by name, so that tags which articles use cost little. What is known not to be the article
    (menus, adverts) counts on neither side. Counts are
    summed up per task; the result has a row for each element name of the fixed lists and one for the
    rest, whatever the corpus."""
    def count(batches):
        from collections import Counter

        import pandas as pd

        pat = _patterns()
        known = BLOCKS | VOID | BOILER | frozenset("a b i u em strong span code sub sup small q cite abbr time mark s del ins".split())
        inside, outside = Counter(), Counter()
        for part in batches:
            for html in part["html"]:
                items, labelled = scan(html, pat) if html else ([], False)
                here = [it for it in items if it[0] is None and not it[5]]
                if labelled and 2 * sum(it[2] for it in here if it[1]) >= sum(it[2] for it in here):
                    for it in items:
                        if it[5] if it[0] is None else it[2]:
                            continue
                        (inside if it[1] else outside)[(it[0] if it[0] in known else "other") if it[0] else "word"] += \
                            it[2] if it[0] is None else 1
        names = sorted(inside.keys() | outside.keys())
        if names:
            yield pd.DataFrame({"name": names, "i": [inside[x] for x in names], "o": [outside[x] for x in names]})

    rows = pages.select(pages[f"`{html_col}`"].cast("string").alias("html")).mapInPandas(count, "name string, i long, o long") \
        .groupBy("name").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).collect()
    out = dict(PRIOR)
    for r in rows:
        if r["i"] + r["o"]:
            share = r["i"] / (r["i"] + r["o"])
            out[r["name"]] = max(share, 0.1) if r["name"] == "word" else -(0.02 + 2.0 * (1 - share))
    return out


def extract(pages: DataFrame, weights: dict[str, float], html_col: str = "html"):
    """A column with the main text of each page; empty for null, empty and wordless pages. Whole pages
    are read, in one linear scan; ties go to the first region."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(html):
        import pandas as pd

        pat = _patterns()
        return pd.Series([main_text(x, weights, pat) for x in html], dtype=object)

    return run.asNondeterministic()(pages[f"`{html_col}`"].cast("string"))


def extract_pages(pages: DataFrame, html_col: str = "html", weights: dict[str, float] | None = None,
                  out_col: str = "text") -> DataFrame:
    """``pages`` with the column ``out_col`` (which replaces one of that name). One row per input row:
    repeated rows, null ids and null urls stay as they are. Empty table: no rows."""
    return pages.withColumn(out_col, extract(pages, weights or page_weights(pages, html_col), html_col))
