"""Main text of web pages by two-pass block rules.

Pass one splits a page into blocks at block-level tags and classifies each by its link density, its length and its stop-word
density, with thresholds of the page's language: good, bad, or ambiguous (short, or of middling density). Where a page is in none
of the languages whose stop words are known, the share of short words stands for it, or of marks in scripts without spaces. Much
linked text is bad unless dense prose holds it. Pass two gives the ambiguous ones the label of their nearest decided neighbours.
The element that a block stands in has two says only: blocks of navigation, forms, adverts and comments are never good, nor are
those beside a page's main element; and where neighbours disagree or are missing, a block of the main element is good. A page
of which nothing was decided is its short blocks that have a letter or digit. Good blocks are joined in page order.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import read

_RAW = "script|style|noscript|template|iframe|textarea|title|svg|math|object|audio|video|canvas|select|noembed|noframes|xmp"
_TOKEN = re.compile(
    rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<raw>{_RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<more>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<more2>[^>]*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_BLOCK = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre section article main header footer nav aside form fieldset legend figure figcaption address hr body html head details summary dialog center menu option label button".split()
)
#: Elements that are kept on the stack; others only break blocks or are inline.
_BOX = frozenset("div section article main header footer nav aside form fieldset ul ol dl table figure dialog details menu button blockquote body span p li td".split())
_AWAY = frozenset("nav footer aside form dialog menu button fieldset".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notification|alert|popup|pop-up|modal|overlay|newsletter|subscri\w*|sidebar|side|rail|widgets?|related|recommend\w*|trending|popular|menu|nav|navbar|navigation|breadcrumbs?|footer|foot|masthead|topbar|toolbar|pagination|pager|share|sharing|social|login|signin|signup|register|search|copyright|disclaimer|skip|hidden|print|tags?)(?=$|[\s_-])",
    re.I,
)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|comment-?list|discussion|disqus|replies|reply|respond|responses|reviews?)(?=$|[\s_-])", re.I)
#: A whole name that says "no main text" inside a main element too; other bad names are section titles there as well, and links decide.
_SURE_NAME = re.compile(
    r"ads?|advert\w*|adsense|banner|sponsor\w*|promo|cookies?|consent|gdpr|popup|pop-up|modal|overlay|newsletter|sidebar|widgets?|nav|navbar|breadcrumbs?|footer|masthead|topbar|toolbar|pagination|pager|share|sharing|login|signin|signup|skip|hidden",
    re.I,
)
_SURE_COMMENT = re.compile(r"comments?|commentlist|comment-?list|comments-?(?:area|section)|disqus|replies|respond", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|head)(?=$|[\s_-])", re.I)
_OWN = re.compile(r"(?:article|post|entry|content|story|body|main|page-title)", re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")
#: Marks of prose, and letters of scripts that set no spaces between words.
_MARK = re.compile("[,.;:!?、。，．；：！？]")
_UNSPACED = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]")
#: Frequent words by language.
STOP_WORDS = {
    language: frozenset(words.split())
    for language, words in {
        "en": """a about after all also an and any are as at be because been before but by can could did do does down for from had has have he her here him his how i if in into is it its just like
    made many may me more most my no not now of on one only or other our out over said she should so some such than that the their them then there these they this time to two up us was we were
    what when where which who will with would you your""",
        "de": """    aber alle als also am an auch auf aus bei bin bis das dass dem den der des die dies doch du durch ein eine einem einen einer er es für haben hat ich ihr im in ist ja kann mein mit nach nicht
    noch nur oder ohne sein sich sie sind so über um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur""",
        "fr": """    au aux avec ce ces cette comme dans de des du elle elles en est et eux il ils je la le les leur lui ma mais me même mes mon ne nos notre nous on ou où par pas plus pour qu que qui sa sans se
    ses si son sont sur ta te tes tout tu un une vos votre vous y été être""",
        "es": """    al como con cuando de del desde donde dos el ella ellos en entre era es esta este esto ha hasta hay la las le lo los más me mi muy no nos o os para pero por porque que se ser si sin sobre son
    su sus también te todo tu un una uno y ya yo""",
    }.items()
}


@dataclass(frozen=True)
class Rules:
    """Lengths in characters, densities as shares; stop_words: the density from which a block is nearly good, and good, by language."""

    short: int = 70
    long: int = 200
    links: float = 0.2
    #: Linked share from which dense prose is bad too, and the share of short words that prose of other languages has.
    most_links: float = 0.5
    short_words: float = 0.22
    stop_words: tuple = (("en", 0.08, 0.16), ("de", 0.06, 0.13), ("fr", 0.05, 0.12), ("es", 0.06, 0.13))


@dataclass
class _Block:
    inside: bool  # in an article or main element
    away: bool  # in an element that holds no main text
    heading: bool
    doubt: int = 0  # number of the outermost element whose name casts doubt on it, 0 if none
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    label: str = ""
    by: str = ""  # what has decided: links, density, veto, neighbours or container
    text: str = ""


def _names(more: str) -> tuple[str, bool]:
    """The class, id and role of a tag, and whether it is hidden."""
    names, hidden = [], False
    for name, a, b, c in _ATTRIBUTE.findall(more):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            names.append(value)
        hidden |= name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower() or name == "aria-hidden" and value.lower() == "true"
    return " ".join(names), hidden


def _kind(tag: str, more: str, inside: bool) -> str:
    """What an opened element says of its content: main, away, comment, doubt, or nothing. Names on body, article and main say nothing against it."""
    names, hidden = _names(more) if more.strip() else ("", False)
    if hidden:
        return "away"
    if names and tag not in ("body", "article", "main"):
        if inside:
            if any(map(_SURE_COMMENT.fullmatch, names.split())):
                return "comment"
            if any(map(_SURE_NAME.fullmatch, names.split())):
                return "away"
            if tag not in _AWAY and (_COMMENT.search(names) or _BAD_NAME.search(names)):
                return "doubt"
        elif _COMMENT.search(names):
            return "comment"
        elif _BAD_NAME.search(names) or _HEADER.search(names) and not _OWN.search(names):
            return "away"
    if tag in ("article", "main") or names and re.search(r"(?:^|\s)main(?:$|\s)", names):
        return "main"
    if tag in _AWAY or tag == "header" and not inside:
        return "away"
    return ""


def blocks(page: str) -> list[_Block]:
    """The page's blocks that have text, with white space made single spaces and character references decoded."""
    stack: list[tuple[str, str]] = []
    found: list[_Block] = []
    now: _Block | None = None
    heading, links, breaks, inside, away, doubts, doubt = False, 0, 0, False, False, 0, 0
    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            if now is None:
                if not text.strip():
                    continue
                now = _Block(inside, away, heading, doubt)
                found.append(now)
            text = html.unescape(text)
            now.parts.append(text)
            if links:
                now.linked += len(text.strip())
            if text.strip():
                breaks = 0
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        end, more = bool(m["end"] or m["end2"]), m["more"] or m["more2"] or ""
        if tag == "br":
            breaks += 1
            if now is not None:
                now.parts.append(" ")
                if breaks > 1:
                    now = None
            continue
        if tag == "a":
            links = 0 if end else 1
            continue
        if tag in _BLOCK:
            now, breaks = None, 0
            if tag != "li" and not end:
                links = 0
            heading = tag in _HEADING and not end
        if tag not in _BOX or more.rstrip().endswith("/") and tag not in ("p", "div"):
            continue
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag not in ("p", "span", "li", "td") or k == len(stack) - 1:
                        del stack[k:]
                    break
        else:
            kind = _kind(tag, more, inside)
            if tag in ("span", "p", "li", "td") and kind not in ("away", "comment"):
                continue
            if tag == "p" or kind == "main":
                while stack and stack[-1][0] == "p":
                    stack.pop()
            if kind == "doubt":
                doubts += 1
                kind = f"doubt {doubts}"
            stack.append((tag, kind))
        inside, away, doubt = False, False, 0
        for _, kind in stack:
            if kind == "main":
                inside, away = True, away == "comment" and away
            elif kind == "comment":
                away = "comment"
            elif kind == "away":
                away = away or "away"
            elif kind and not doubt:
                doubt = int(kind.split()[1])
        away = bool(away)
    for b in found:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in found if b.text]


def _densities(found: list[_Block], rules: Rules) -> tuple[list[float], float]:
    """Each block's density as a multiple of what prose has, and the multiple from which it is nearly prose: of the stop words of the language
    that has most of them on the page (of ties the first). Where all the page has not twice as many of them as prose must have, also of words of at most
    three letters, or of marks where words aren't set apart; the greater counts."""
    words = [_WORD.findall(b.text.lower()) for b in found]
    counts = Counter(w for ws in words for w in ws)
    language, low, high = max(rules.stop_words, key=lambda x: sum(counts[w] for w in STOP_WORDS[x[0]]))
    stop = STOP_WORDS[language]
    share = lambda ws, fits: sum(map(fits, ws)) / len(ws) if ws else 0.0
    densities = [share(ws, stop.__contains__) / high for ws in words]
    if sum(counts[w] for w in stop) < 2 * high * counts.total():
        marked = lambda text: float(len(_MARK.findall(text)) * 60 >= len(text) and _UNSPACED.search(text) is not None)
        densities = [max(d, share(ws, lambda w: len(w) <= 3) / rules.short_words, marked(b.text)) for d, b, ws in zip(densities, found, words, strict=True)]
    return densities, low / high


def _first_pass(found: list[_Block], framed: bool, rules: Rules) -> None:
    """Labels blocks good, bad, near (middling density) or short."""
    densities, low = _densities(found, rules)
    for b, density in zip(found, densities, strict=True):
        size = len(b.text)
        prose = density >= 1 and size >= rules.short and not b.away
        if b.linked > (rules.most_links if prose else rules.links) * size:
            b.label, b.by = "bad", "links"
        elif b.away or b.text[0] == "©" and size < rules.short:
            b.label, b.by = "bad", "veto"
        elif size < rules.short:
            b.label = "short"
        elif density >= 1 and (b.inside or size > rules.long):
            b.label, b.by = ("bad", "veto") if framed and not b.inside else ("good", "density")
        elif density >= low or b.inside:
            b.label = "near"
        else:
            b.label, b.by = "bad", "density"


def _nearest(found: list[_Block], order: range) -> list[str | None]:
    """For each block the label of the last decided one before it in this order, of those on its side of the main element."""
    near, last = [None] * len(found), {}
    for k in order:
        near[k] = last.get(found[k].inside)
        if found[k].by:
            last[found[k].inside] = found[k].label
    return near


def _second_pass(found: list[_Block], framed: bool) -> None:
    """Labels what the first pass has left ambiguous by the nearest decided neighbours; where these don't agree, the element decides."""
    before, after = _nearest(found, range(len(found))), _nearest(found, range(len(found) - 1, -1, -1))
    decided = any(b.by for b in found)
    for b, pair in zip(found, zip(before, after, strict=True), strict=True):
        if b.by:
            continue
        around = set(pair)
        if around == {"good"} or around == {"bad"}:
            b.label, by = around.pop(), "neighbours"
        elif framed:
            by = "neighbours" if around == {"good", None} and b.inside or around == {"bad", None} and not b.inside else "container"
            b.label = "good" if b.inside else "bad"
        elif b.label == "near":
            b.label, by = "good" if "good" in around or around == {None} else "bad", "neighbours"
        elif b.heading and decided:
            b.label, by = "good" if pair[1] == "good" else "bad", "neighbours"
        else:
            b.label, by = "good" if around == {"good", None} or not decided and not b.away and any(map(str.isalnum, b.text)) else "bad", "neighbours"
        b.by = by


def label(found: list[_Block], rules: Rules = Rules()) -> None:
    """Labels every block good or bad, in two passes."""
    sizes, linked = Counter(), Counter()
    for b in found:
        sizes[b.doubt] += len(b.text)
        linked[b.doubt] += b.linked
    for b in found:
        b.away = b.away or b.doubt > 0 and linked[b.doubt] > rules.links * sizes[b.doubt]
    framed = any(b.inside and not b.away for b in found)
    _first_pass(found, framed, rules)
    _second_pass(found, framed)


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    found = blocks(page or "")
    label(found, rules)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Rules = Rules()) -> DataFrame:
    """One row per row of pages: id, url, text, n_chars.

    Null and empty pages have the empty text; broken markup is read as browsers do, as far as blocks go; long pages are read
    whole; repeated rows give repeated rows; an empty table gives an empty one. Other columns are not read, so names may clash.
    """

    @F.pandas_udf("text string, n_chars long")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in batches:
            found = [main_text(x, rules) for x in some]
            yield pd.DataFrame({"text": found, "n_chars": pd.Series([len(x) for x in found], dtype="int64")})

    return pages.select(F.col(id_col), F.col(url_col), texts(F.col(html_col)).alias("t")).select(id_col, url_col, "t.text", "t.n_chars")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
