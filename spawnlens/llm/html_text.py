"""Main-text extraction by a linear-chain conditional random field over the leaf blocks of a page.

A page is read into leaf blocks: runs of text between block-level tags, each with the tags, classes and ids that it stands in. Features are
those ancestors, the block's length, link share, final mark and place. The field has two labels (main text or not), is trained by gradient
ascent on the exact likelihood of labelled pages, and decoded by Viterbi. Scripts, styles, comments, templates and the head are markup and
never blocks. The labelled pages are made by `labelled_pages`: page frames of many kinds around invented prose.

Results for odd input: null or empty html gives an empty text; html without tags is one block; unclosed or stray tags are repaired as browsers do, and elements nested over 512 deep are put side by side;
null urls and ids stay; repeated rows are extracted each; input columns named like the result's are replaced. An empty table gives an
empty table.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, tidy

# HTML's inline, void and raw-text elements, and which open elements a start tag closes.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture source svg object param".split())
INLINE |= set("math semantics annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noscript noembed noframes xmp".split())
UNSEEN = set("svg template select canvas audio video".split())
IN_HEAD = set("base basefont bgsound link meta title noscript noframes style script template".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: White space and an attribute as HTML's tokenizer reads them: names and bare values may hold quotes, a quote that never closes is part of a name.
_W = r"\t\n\f\r "
_ATTRIBUTE = rf"[^{_W}/>][^{_W}/>=]*+(?:[{_W}]*+=[{_W}]*+(?:\"[^\"]*\"|'[^']*'|[^{_W}\"'>][^{_W}>]*+)?)?"
#: A comment, a tag, a tag whose quotes do not end before the page does, another declaration, a tag that the page's end cuts.
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^{_W}/>]*+)((?>[{_W}/]++|{_ATTRIBUTE})*+)>|<(/?)([a-zA-Z][^{_W}/>]*+)([^>]*+)>|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(rf"([^{_W}/>][^{_W}/>=]*+)(?:[{_W}]*+=[{_W}]*+(?:\"([^\"]*)\"|'([^']*)'|([^{_W}\"'>][^{_W}>]*+))?)?")
WORD = re.compile(r"[a-z]+")
#: Open elements at most: as in browsers, a deeper one takes the place of the last, so that the time of a page grows with its length only.
DEPTH = 512


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


@lru_cache(maxsize=20_000)
def marks(tag: str, attributes: str) -> tuple[str, ...]:
    """A tag's features: its name, and the words of its class, id and role."""
    words = {w for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id", "role") for w in WORD.findall((m[2] or m[3] or m[4] or "").lower())} if attributes else ()
    return (tag, *sorted("." + w for w in words))


def closes_itself(attributes: str) -> bool:
    """Whether the tag ends in a slash that is no part of a bare value."""
    if not attributes.endswith("/"):
        return False
    last = None
    for last in ATTRIBUTE.finditer(attributes):
        pass
    return last is None or last[4] is None or last.end() < len(attributes)


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks.

    Tags are read as HTML's tokenizer does. Where a browser would lose text to a slip, it is kept: an element of RAW (but script and style)
    or UNSEEN whose end tag never comes, and any element that closes itself, is empty; a quote that never ends ends with its tag.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    unseen: list[str] = []  # open elements from one of UNSEEN on
    pieces: list[str] = []
    linked, in_link, in_head = 0, 0, False
    page = page or ""
    lowered = page.lower()
    if len(lowered) != len(page):  # a few capitals become two code points
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                out.append(Block(tuple(x for _, ms in stack for x in ms), text, linked))
        linked = 0

    def leave_head() -> None:
        nonlocal in_head
        in_head = False
        k = next((k for k, (t, _) in enumerate(stack) if t == "head"), None)
        if k is not None:
            pop(k)

    def take(s: str) -> None:
        nonlocal linked
        if not s or unseen:
            return
        if in_head:
            if not s.strip(" \t\n\f\r"):
                return
            leave_head()
        s = entities.unescape(s) if "&" in s else s
        pieces.append(s)
        if in_link:
            linked += len(s.strip())

    def pop(k: int) -> None:
        nonlocal in_link
        if any(t == "a" for t, _ in stack[k:]):
            in_link = sum(t == "a" for t, _ in stack[:k])
        del stack[k:]

    next_end: dict[str, int] = {}

    def ends(tag: str, start: int) -> int:
        """Where the element's end tag stands, or -1. Starts only grow, so what was found before holds until it is passed, and a page is searched once a tag."""
        k = next_end.get(tag, 0)
        if 0 <= k < start or tag not in next_end:
            while (k := lowered.find(f"</{tag}", start)) >= 0:
                if (after := lowered[k + 2 + len(tag) : k + 3 + len(tag)]) and after in " \t\n\f\r/>":
                    break
                start = k + 2
            next_end[tag] = k
        return k

    at = 0
    while m := TOKEN.search(page, at):
        take(page[at : m.start()])
        at = m.end()
        name, attributes = m[2] or m[5], m[3] if m[2] else m[6]
        if name is None:
            if m[0].startswith("<![CDATA[") and any(t == "math" for t, _ in stack):
                stop = page.find("]]>", m.start())
                stop = len(page) if stop < 0 else stop
                pieces.append(page[m.start() + 9 : stop])  # character data: no references
                at = min(stop + 3, len(page))
            continue
        tag, closing = name.lower(), m[1] or m[4]
        if unseen:
            if closing:
                if tag in unseen:
                    while unseen.pop() != tag:
                        pass
                    continue
                if all(t != tag for t, _ in stack):
                    continue
                unseen.clear()  # the end of an element around it
            else:
                if tag in ("script", "style") and (stop := ends(tag, at)) >= 0:
                    at = stop
                if tag not in VOID and not attributes.endswith("/"):
                    unseen.append(tag)
                continue
        if tag == "br":
            take(" ")
        elif closing:
            if tag in RAW:
                continue
            if tag not in INLINE:
                flush()
            if tag == "head" and in_head:
                leave_head()
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is not None:
                pop(k)
        else:
            if in_head and tag not in IN_HEAD:
                leave_head()
            if tag in RAW or tag in UNSEEN:
                stop = ends(tag, at)
                if closes_itself(attributes) and (tag in UNSEEN or stop < 0 or lowered.find(f"<{tag}", at, stop) >= 0):
                    continue
                if tag in RAW:
                    at = stop if stop >= 0 else len(page) if tag in ("script", "style") else at
                elif stop >= 0:
                    unseen.append(tag)
                continue
            if tag not in INLINE:
                flush()
                if tag == "head":
                    in_head = not out and all(t != "body" for t, _ in stack)
                for k in range(len(stack) - 1, -1, -1):
                    open_tag = stack[k][0]
                    if open_tag == "p" or open_tag in CLOSES.get(tag, ()):
                        pop(k)
                        break
                    if open_tag not in INLINE:
                        if open_tag in SCOPE.get(tag, ()) or tag not in CLOSES:
                            break
            if tag not in VOID and not attributes.endswith("/"):
                if len(stack) >= DEPTH:
                    pop(DEPTH - 1)
                stack.append((tag, marks(tag, attributes)))
                in_link += tag == "a"
    take(page[at:])
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    out, n = [], len(found)
    for k, b in enumerate(found):
        size = len(b.text)
        share = b.linked / size
        out.append([
            "bias", *{f"in {x}" for x in b.path if x not in ("html", "body")}, f"tag {next((x for x in reversed(b.path) if x[0] != '.'), '')}",
            f"size {min(7, size.bit_length() // 2 + (size >= 40))}", "link all" if share > 0.8 else "link some" if share > 0.3 else "link none",
            f"end {b.text[-1] if b.text[-1] in '.!?:' else 'other'}", "first" if k == 0 else "last" if k == n - 1 else "inner", *(["mark ©"] if "©" in b.text else []),
        ])
    return out


class Field:
    """Weights by feature of label 1 against label 0, and scores of label pairs."""

    def __init__(self, weights: dict[str, float], pairs: list[list[float]]):
        self.weights, self.pairs = weights, pairs

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not rows:
            return []
        get, ((a, b), (c, d)) = self.weights.get, self.pairs
        zero, one, back = 0.0, 0.0, []
        for k, row in enumerate(rows):
            e = sum(get(f, 0.0) for f in row)
            if not k:
                zero, one = 0.0, e
                continue
            z0, z1, o0, o1 = zero + a, one + c, zero + b, one + d
            back.append((z1 > z0, o1 >= o0))
            zero, one = max(z0, z1), max(o0, o1) + e
        labels = [int(one > zero)]
        for z, o in reversed(back):
            labels.append(int(o if labels[-1] else z))
        return labels[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """Stochastic gradient ascent on the log-likelihood of labels, by forward and backward sums."""
    index: dict[str, int] = {}
    coded = [([np.array([index.setdefault(f, len(index)) for f in row]) for row in rows], np.array(y)) for rows, y in pages if rows]
    w, t, order = np.zeros(len(index)), np.zeros((2, 2)), random.Random(1)
    for r in range(rounds):
        order.shuffle(coded)
        step = rate / (1 + 0.3 * r)
        for rows, y in coded:
            n = len(rows)
            e = np.zeros((n, 2))
            e[:, 1] = [w[f].sum() for f in rows]
            fw, bw = np.zeros((n, 2)), np.zeros((n, 2))
            fw[0] = e[0]
            for k in range(1, n):
                fw[k] = np.logaddexp(fw[k - 1, 0] + t[0], fw[k - 1, 1] + t[1]) + e[k]
            for k in range(n - 2, -1, -1):
                bw[k] = np.logaddexp(t[:, 0] + e[k + 1, 0] + bw[k + 1, 0], t[:, 1] + e[k + 1, 1] + bw[k + 1, 1])
            z = np.logaddexp(*fw[-1])
            p1 = np.exp(fw[:, 1] + bw[:, 1] - z)
            for f, g in zip(rows, y - p1, strict=True):
                w[f] += step * g
            if n > 1:
                both = np.exp(fw[:-1, :, None] + t[None] + (e[1:] + bw[1:])[:, None, :] - z)
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                t += step * (seen - both.sum(axis=0)) / n
            w *= 1 - ridge
    return Field({f: float(w[k]) for f, k in index.items()}, t.tolist())


def labelled_pages(n: int = 240, seed: int = 7) -> list[tuple[str, set[str]]]:
    """Pages of many frames, with the block texts that are main text."""
    rng = random.Random(seed)
    syllables = "ba do ka li mo ne ri su ta ve que sch ion er an th".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    serial = iter(range(10**9))

    def say(a: int, b: int, mark: str = ".") -> str:
        return f"{words(a, b).capitalize()} {next(serial)}{mark}"

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{say(1, 2, "")}</a></li>' for _ in range(k))

    # Names that page frames give to what is not main text.
    aside_names = "sidebar widget related recommended newsletter share social promo popular tags".split()
    notice_names = "cookie-notice banner consent alert notice popup subscribe".split()
    ad_names = "ad ads advert advertisement sponsor sponsored".split()
    comment_names = "comments comment-list reader-comments discussion responses".split()
    menu_names = "menu nav navbar breadcrumb topnav main-menu".split()
    main_names = "content post-body entry-content article-body story text main-content".split()
    out = []
    for _ in range(n):
        main: set[str] = set()

        def keep(s: str) -> str:
            main.add(s)
            return s

        def prose(k: int) -> str:
            parts = []
            for _ in range(k):
                s = keep(say(1, 3) if rng.random() < 0.25 else say(5, 80))
                kind = rng.random()
                if kind < 0.12:
                    parts.append(f"<p><b>{s}<br>")
                elif kind < 0.2:
                    a, _, b = s.partition(" ")
                    parts.append(f"<p>{a} <em>{b}</em></p>")
                elif kind < 0.26:
                    parts.append(f'<ul>{"".join(f"<li>{keep(say(3, 20))}</li>" for _ in range(rng.randint(1, 4)))}</ul><p>{s}</p>')
                elif kind < 0.3:
                    parts.append(f"<blockquote>{s}</blockquote>")
                elif kind < 0.36:
                    parts.append(f"<h2>{keep(say(1, 6, ''))}</h2><p>{s}</p>")
                elif kind < 0.42:
                    a, _, b = s.partition(" ")
                    parts.append(f'<p>{a} <a href="/{word()}">{b}</a></p>')
                else:
                    parts.append(f"<p>{s}</p>")
            return "".join(parts)

        title = say(3, 10, "")
        body = [f"<h1>{keep(title)}</h1>"] if rng.random() < 0.85 else []
        if rng.random() < 0.3:
            body.append(prose(1) + f'<div class="{rng.choice(ad_names)}">{say(2, 12)}</div>')
        body.append(prose(rng.randint(1, 9)))
        inner = "".join(body)
        frame = rng.random()
        if frame < 0.5:
            inner = f"<article>{inner}</article>"
        elif frame < 0.65:
            inner = f"<main>{inner}</main>"
        elif frame < 0.75:
            inner = f"<main><article>{inner}</article></main>"
        else:
            inner = f'<div class="{rng.choice(main_names)}">{inner}</div>'
        before, after = [], []
        if rng.random() < 0.5:
            before.append(f"<header><p>{say(1, 6, '')}</p>{f'<p>{say(3, 12)}</p>' * (rng.random() < 0.4)}</header>")
        menu = links(rng.randint(2, 8))
        before.append(f"<nav><ul>{menu}</ul></nav>" if rng.random() < 0.7 else f'<div class="{rng.choice(menu_names)}"><ul>{menu}</ul></div>')
        if rng.random() < 0.6:
            before.append(f'<div class="{rng.choice(ad_names)}">{say(3, 20)}</div>')
        if rng.random() < 0.35:
            rng.choice((before, after)).append(f'<div class="{rng.choice(notice_names)}"><p>{say(5, 25)}</p><button>{say(1, 2, "")}</button></div>')
        if rng.random() < 0.4:
            rng.choice((before, after)).append(f'<aside><h3>{say(1, 3, "")}</h3><p>{say(4, 25)}</p><ul>{links(rng.randint(1, 4))}</ul></aside>')
        if rng.random() < 0.35:
            after.append(f'<div class="{rng.choice(aside_names)}"><h3>{say(1, 3, "")}</h3><ul>{links(rng.randint(2, 5))}</ul><p>{say(4, 20)}</p></div>')
        if rng.random() < 0.35:
            noted = "".join(f'<div class="comment"><p>{say(3, 40)}</p></div>' for _ in range(rng.randint(1, 5)))
            tag = rng.choice(("section", "div"))
            note = f'<{tag} {rng.choice(("class", "id"))}="{rng.choice(comment_names)}"><h3>{say(1, 2, "")}</h3>{noted}</{tag}>'
            if inner.endswith("</article>") and rng.random() < 0.3:
                inner = inner[: -len("</article>")] + note + "</article>"
            else:
                after.append(note)
        if rng.random() < 0.3:
            rng.choice((before, after)).append(f"<form><label>{say(1, 3, ':')}</label><input><p>{say(4, 15)}</p><button>{say(1, 2, '')}</button></form>")
        if rng.random() < 0.9:
            after.append(f"<footer>{rng.choice(('&copy; ', ''))}{say(2, 15)}{f'<p>{say(3, 20)}</p>' * (rng.random() < 0.4)}</footer>")
        out.append((f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{''.join(before)}{inner}{''.join(after)}</body></html>", main))
    return out


@lru_cache(maxsize=2)
def trained(n: int = 240, seed: int = 7) -> Field:
    pages = []
    for page, main in labelled_pages(n, seed):
        found = blocks(page)
        pages.append((features(found), [int(b.text in main) for b in found]))
    return fit(pages)


def main_text(field: Field, page: str | None) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, y in zip(found, field.decode(features(found)), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None, html_col: str = "html") -> DataFrame:
    """Replaces the html by text string."""
    bounded_batches(pages.sparkSession)
    field = field or trained()
    sent = pages.sparkSession.sparkContext.broadcast(field)  # bounded: the features of the labelled pages
    others = [c for c in pages.columns if c not in (html_col, "text")]
    schema = T.StructType([pages.schema[c] for c in others] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index(html_col))
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([*part.select(others).columns, pa.array([main_text(f, raw[i].as_py()) for i in range(k, k + part.num_rows)], pa.string())], names=[*others, "text"])

    return pages.select(*others, html_col).mapInArrow(tidy(run), schema)
