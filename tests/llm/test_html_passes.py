"""Both passes of the block rules against plain versions, and the text of the given pages against their own markup."""

import html
import os
import random
import re
from collections import Counter

import pandas as pd
import pytest

from tallyspark.llm import html_text as H

DATA = "/root/testdata/sf0.001/pages.parquet"
STOPS = ["the", "of", "and", "to", "in", "that", "with"]


def page(rnd):
    """Blocks of known links, lengths and stop words, some of them in an article."""
    parts, inside = [], False
    for _ in range(rnd.randint(1, 14)):
        if rnd.random() < 0.15:
            parts.append("</article>" if inside else "<article>")
            inside = not inside
        words = [rnd.choice(STOPS) if rnd.random() < rnd.choice([0, 0.1, 0.3]) else "wxyz" for _ in range(rnd.choice([3, 20, 60]))]
        text = " ".join(words)
        parts.append(rnd.choice(["<p>{}</p>", "<h2>{}</h2>", "<p><a href=x>{}</a></p>", "<nav><p>{}</p></nav>", "<div>{}</div>"]).format(text))
    return "".join(parts)


def plain(found, rules):
    """What the docstring promises, block by block."""
    framed = any(b.inside and not b.away for b in found)
    first = []
    for b in found:
        words = re.findall(r"[^\W\d_]+", b.text.lower())
        stops = sum(w in H.STOP_WORDS["en"] for w in words) / len(words) if words else 0
        if b.linked > (0.5 if stops >= 0.16 and len(b.text) >= 70 and not b.away else 0.2) * len(b.text) or b.away:
            first.append("bad")
        elif len(b.text) < 70:
            first.append("?short")
        elif stops >= 0.16 and framed and not b.inside and len(b.text) > 200:
            first.append("bad")
        elif stops >= 0.16 and (b.inside or len(b.text) > 200):
            first.append("good")
        else:
            first.append("?near" if stops >= 0.08 or b.inside else "bad")
    out, decided = [], any(x[0] != "?" for x in first)
    for k, b in enumerate(found):
        if first[k][0] != "?":
            out.append(first[k])
            continue
        same = [j for j in range(len(found)) if found[j].inside == b.inside and first[j][0] != "?"]
        left, right = [first[j] for j in same if j < k][-1:], [first[j] for j in same if j > k][:1]
        votes = left + right
        if len(votes) == 2 and votes[0] == votes[1]:
            out.append(votes[0])
        elif framed:
            out.append("good" if b.inside else "bad")
        elif first[k] == "?near":
            out.append("good" if "good" in votes or not votes else "bad")
        elif b.heading and decided:
            out.append("good" if right == ["good"] else "bad")
        else:
            out.append("good" if votes == ["good"] or not decided else "bad")
    return out


def test_passes_equal_plain_rules():
    rnd, seen = random.Random(16), Counter()
    for _ in range(1500):
        found = H.blocks(page(rnd))
        words = [w for b in found for w in b.text.split()]
        if sum(w in STOPS for w in words) < 0.05 * len(words):
            continue  # no language to tell
        H.label(found)
        assert [b.label for b in found] == plain(found, H.Rules())
        seen.update(b.by for b in found)
    assert min(seen[k] for k in ("links", "density", "veto", "neighbours", "container")) > 100


PLAIN = "This is a paragraph of the text that we want to keep, and it is long enough to be one of those that count for it. " * 2
OTHERS = {
    "italian": "Il governo ha deciso di non aumentare le tasse per il prossimo anno, ma la spesa per la scuola e la salute non sarà ridotta, come ha detto il ministro in aula davanti ai deputati della maggioranza e della opposizione.",
    "polish": "W tym roku nie ma w planie nowych dróg, bo na to nie ma już z czego dać, ale od maja do lata ma być w tej gminie nowy most, po to aby się dało do niej i z niej łatwo i o każdej porze dnia dojechać na czas, a nie jak do tej pory raz na dzień.",
    "chinese": "今年的计划里没有新的道路，因为已经没有资金了。但是从五月到夏天，这个地区将有一座新桥，人们可以方便地往来。" * 4,
}


@pytest.mark.parametrize("text", [*OTHERS.values(), PLAIN])
def test_articles_of_other_languages_in_a_plain_element(text):
    page = f'<body><div class="nav"><a href="/">Home</a> <a href="/x">Other</a></div><div class="text"><p>{text}</p></div><div><a href="/a">One</a> | <a href="/b">Two</a></div></body>'
    assert H.main_text(page) == " ".join(text.split())


def test_what_an_article_keeps():
    linked = "It is said that <a href=/x>the new rules for the town</a> are not to be had in this year, and that it is for the <a href=/y>council to say</a> when they are."
    mark = "© 2020 was the year in which the small sign was on the front of every page, and it was not the last of them to be."
    got = H.main_text(f"<article><p>{PLAIN}</p><p>{linked}</p><p>{mark}</p><p>© 2020 Acme</p></article>")
    assert got == "\n".join([" ".join(PLAIN.split()), re.sub("<[^>]*>", "", linked), mark])
    assert H.main_text("<p>Hello world</p>") == "Hello world" and H.main_text("<nav><p>Home</p></nav>") == ""
    assert H.main_text("<h1>Title</h1><p>Hello world</p>") == "Title\nHello world"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")
def test_given_pages_equal_their_markup():
    seen = Counter()
    for source in pd.read_parquet(DATA).html:
        article = re.search(r"<article>(.*)</article>", source, re.S)[1]
        parts = re.split(r"</?(?:p|h1|ul|li|div|br><br)[^>]*>", article)
        wanted = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))).split()) for x in parts]
        assert H.main_text(source) == "\n".join(x for x in wanted if x)
        found = H.blocks(source)
        H.label(found)
        seen.update(b.by for b in found)
    assert seen["links"] + seen["density"] + seen["neighbours"] > 0.5 * sum(seen.values())
