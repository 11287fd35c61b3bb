"""Keyword-stuffed pages, link lists and tag lists, told from text by repetition and clause structure."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators.bounded import spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

# Words that clauses are built with, of English, German and Spanish.
_CLAUSE_WORDS = frozenset(
    (
        "a an the of to in on at by from with without into over under about after before between through during against and or but nor so how why if as than that which who what when where while because since though although unless until "
        "is are was were be been being am has have had do does did can could will would shall should may might must not no it its this these those there here he she they we you i our your their his her them us one only also still then "
        "der die das den dem des ein eine einer eines einem einen und oder aber wenn weil dass ob als wie wo was wer nach vor bei mit ohne von zu zum zur im in an am auf aus für durch über unter zwischen ist sind war waren wird werden wurde wurden hat haben hatte kann muss soll nicht kein keine es er sie wir ihr sich auch noch nur schon "
        "el la los las un una unos unas de del al y o e pero si porque que cuando donde como con sin por para en entre sobre tras desde hasta es son era fue fueron ser está están ha han había se lo le les su sus no ya más este esta estos estas aunque según"
    ).split()
)
# Signs that Chinese clauses are built with.
_CLAUSE_SIGNS = frozenset("的了是在把将已请为与和就被从到由对其该并但而或所后前时可应会有没吗呢据如若因")
# Captions of site navigation, which are neither tags nor sentences.
_NAVIGATION = frozenset(
    "home|products|contact|imprint|about us|about|career|careers|downloads|download|data sheets|kontakt|impressum|produkte|startseite|welcome|login|search|sitemap|privacy|datenschutz|inicio|productos|contacto|descargas|下载|首页|产品|联系我们|关于我们|招聘".split("|")
)
_BROKEN = re.compile(r"[\x80-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{2,}")
_CONTENT = re.compile(r"<meta\b[^<>]*?\bcontent=\"([^\"]*)\"[^<>]*/?>|<meta\b[^<>]*?\bcontent=\"([^\"]*)$", re.M)
_BLOCK = re.compile(r"</?(?:li|br|p|div|ul|ol|tr|td|th|table|h\d|title|option)\b[^<>]*>")
_MARKUP = re.compile(r"</?(?!a[\s>])[a-z][^<>]*>|&[a-z]+;|<\|[a-z]+\|>")
_DOTTED = re.compile(r"\b(?:\w\.){3,}\w\b\.?")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|(?<=[一-鿿][!?])")
_DATA = re.compile(r"^\W*\d{4}-\d\d-\d\d|^\W*\d+\s*[x×]\s|;\s*\d+(?:[.,]\d+)?\s*(?:;|$)|^(?:[^\t]*\t){2}")
_CODE = re.compile(r":=|;\s*$|^\s*(?:--|/\*|//|\*/)|^\s*(?:begin|end|declare|else|loop|is|as)\b\s*$|\b(?:select|update|return|function|procedure|create)\b.*[(;=]|[{}]")
_TOKEN = re.compile(r"(?:(?![一-鿿])[\w'-])*(?![一-鿿])[^\W\d_](?:(?![一-鿿])[\w'-])*|[一-鿿]|\d+")
#: What a line's shape is made of: links, words and numbers, Chinese signs, signs that separate items, ends of sentences.
_UNIT = re.compile(
    r"(?P<link><a\b[^<>]*>?|(?:https?://|www\.)[^\s\"'<>()\]|]+|(?<![\w.])[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?:/[^\s\"'<>()\]|]*)?)"
    r"|(?P<word>\d[\d.,]*\d|(?:(?![一-鿿])[\w'])(?:(?![一-鿿])[\w'.-]*(?![一-鿿])[\w'])?)|(?P<han>[一-鿿])"
    r"|(?P<mark>[,;|•★·»«▪►→、\t*/~#@:]|(?<=\s)[-–—‧](?=\s)|(?<=[一-鿿])\s+(?=[^\W\d_])|(?<=[^\W_])\s+(?=[一-鿿]))|(?P<end>[.!?。]+(?=[\"'”’)]*(?:\s|$|[一-鿿])))"
)
_ENDED = re.compile(r"[.!?。！？][\"'”’)]*\s*$")
#: Numbers of list items.
_NUMBERED = re.compile(r"(^|[|»*]\s*)\d{1,3}[.)]\s+", re.M)
_HAN = re.compile(r"[一-鿿]")
_SIGNS = re.compile(r"\s+")

#: Words (Chinese signs) of one item at most; a longer run counts as several.
_ITEM_WORDS, _ITEM_SIGNS = 5, 10
#: A repeated substring of shapes has at least this length: four items with what is between them, or two links with captions.
_SHAPE = 7
#: Ways in which sentences are stuffed: occurrences on the page from which on a substring counts as repeated, the share of a sentence's
#: content that repeated substrings cover, and the share of clause words (in Chinese, of clause signs) that the page has at most.
#: Text that repeats a phrase two times is common, so that two occurrences count only where nearly all is repeated and clauses are rare.
_REPEATED = ((3, 0.5, 0.36, 0.1), (2, 0.8, 0.28, 0.06))
#: Repeated substrings cover at least this share of a stuffed page.
_COVERED = 0.5
#: Sentences of fewer words and signs together are a note, which may well be sent two times.
_NOTE = 20


class SuffixAutomaton:
    """The suffix automaton of a sequence, with the number of occurrences of each state's substrings; those of fewer than ``least`` items never count."""

    def __init__(self, sequence: list, least: int = 1) -> None:
        length, link, follow, count = [0], [-1], [{}], [0]
        last, ends = 0, []
        for item in sequence:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            follow.append({})
            count.append(1)
            p = last
            while p >= 0 and item not in follow[p]:
                follow[p][item] = new
                p = link[p]
            if p >= 0:
                q = follow[p][item]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    follow.append(follow[q].copy())
                    count.append(0)
                    while p >= 0 and follow[p].get(item) == q:
                        follow[p][item] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
            ends.append(new)
        for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
            if link[state] > 0:
                count[link[state]] += count[state]
        self.length, self.link, self.count, self.ends, self.least = length, link, count, ends, least

    def covered(self, times: int) -> list[bool]:
        """For each place whether it lies in a substring that occurs at least ``times`` times.

        The longest such substring that ends at a place is the first state of enough occurrences
        on the suffix links of the place's prefix; all maximal repeated substrings are among them.
        """
        length, link, count = self.length, self.link, self.count
        known: dict[int, int] = {0: 0}
        out, reach = [False] * len(self.ends), len(self.ends)
        for i in range(len(self.ends) - 1, -1, -1):
            state, path = self.ends[i], []
            while state not in known and count[state] < times:
                path.append(state)
                state = link[state]
            longest = known[state] if state in known else length[state]
            for s in path:
                known[s] = longest
            if longest >= self.least:
                reach = min(reach, i - longest + 1)
            out[i] = i >= reach
        return out


def _mended(found: re.Match) -> str:
    """A run of signs that is UTF-8 read as Latin-1 or Windows-1252, read anew; any other run as it is."""
    try:
        return b"".join(c.encode("latin-1" if c < "Ā" else "cp1252") for c in found[0]).decode("utf-8")
    except UnicodeError:
        return found[0]


def _clauses(tokens: list[str]) -> int:
    return sum(t in _CLAUSE_WORDS or t in _CLAUSE_SIGNS for t in tokens)


def _solid(text: str) -> int:
    return len(_SIGNS.sub("", text))


def _is_navigation(line: str) -> bool:
    """Whether most of a line's items are captions of site navigation."""
    items = [x.strip(" -–.:#") for x in re.split(r"[|,;•·/]", line)]
    return sum(x in _NAVIGATION for x in items) * 2 >= len(items)


#: Signs that separate items; the empty one is white space between signs.
_MARKS = frozenset([*",;|•★·»«▪►→、*/~#@:-–—‧", ""])


#: The shapes of a link.
_LINK = ("scheme", "host", ".", "domain", "path", "file")


class _Page:
    """A page as one sequence of shapes, with the characters that each stands for.

    Links, items (a few words or Chinese signs), each separating sign and the line end have a
    shape of their own. Clause words, ends of sentences and lines that are data, code or
    navigation are shapes that occur once, so that no repeated substring spans a clause.
    """

    def __init__(self) -> None:
        self.shapes: list = []
        self.sizes: list[int] = []
        self.sentences: list[int] = []  # which sentence a shape belongs to; -1: none
        self._words = 0

    def add(self, shape: object, size: int, sentence: int) -> None:
        self.shapes.append(shape)
        self.sizes.append(size)
        self.sentences.append(sentence)
        self._words = 0

    def cut(self, size: int, sentence: int) -> None:
        """A shape that nothing else has."""
        self.add(-1 - len(self.shapes), size, sentence)

    def word(self, size: int, sentence: int, most: int) -> None:
        """A word of an item; the item before goes on if it is short enough."""
        if self._words % most or not self._words:
            if self._words:
                self.sizes[-1] += size
            else:
                self.add("item", size, sentence)
        else:
            self.add("item", size, sentence)
        self._words = self._words % most + 1

    def read(self, text: str, sentence: int) -> None:
        """Adds a sentence."""
        at = 0
        for m in _UNIT.finditer(text):
            start, sign, kind = m.start(), m[0], m.lastgroup
            if start > at and not (gap := text[at:start]).isspace() and self.sizes and self.sentences[-1] == sentence:
                self.sizes[-1] += _solid(gap)
            at = start + len(sign)
            if kind == "word" or kind == "han":
                if sign in _CLAUSE_WORDS or sign in _CLAUSE_SIGNS:
                    self.cut(len(sign), sentence)
                else:
                    self.word(len(sign), sentence, _ITEM_SIGNS if kind == "han" else _ITEM_WORDS)
            elif kind == "end":
                self.cut(len(sign), sentence)
            else:
                self.separate(kind, sign.strip(), _solid(sign), sentence)
        if at < len(text) and self.sizes and self.sentences[-1] == sentence:
            self.sizes[-1] += _solid(text[at:])

    def separate(self, kind: str, sign: str, size: int, sentence: int) -> None:
        """A link, which takes up a sign before it, or a sign, which only counts behind an item or a link."""
        marked = bool(self.shapes) and self.shapes[-1] in _MARKS
        if kind == "link":
            if marked and self.sentences[-1] == sentence:
                size += self.sizes.pop()
                self.shapes.pop()
                self.sentences.pop()
            for part in _LINK:
                self.add(part, size if part == _LINK[0] else 0, sentence)
        elif marked or not self.shapes or self.shapes[-1] == "line":
            if self.sizes and self.sentences[-1] == sentence:
                self.sizes[-1] += size
        else:
            self.add(sign, size, sentence)

    def listed(self, n: int) -> list[int]:
        """The characters of each of ``n`` sentences that lie in repeated substrings of shapes.

        A run between two shapes that occur once counts only if it is as long as a repeated
        substring has to be; shorter ones cannot hold one and are not built into the automaton.
        """
        out, run, kept = [0] * n, [], []
        for i, shape in enumerate([*self.shapes, 0]):
            if isinstance(shape, str):
                run.append(i)
                continue
            if len(run) >= _SHAPE:
                kept += [*run, -1 - len(kept)]
            run = []
        if kept:
            for i, dense in zip(kept, SuffixAutomaton([self.shapes[i] if i >= 0 else i for i in kept], _SHAPE).covered(2)):
                if dense and self.sentences[i] >= 0:
                    out[self.sentences[i]] += self.sizes[i]
        return out


def _plain(text: str) -> str:
    """A text in lower case without markup, broken encodings, dotted spelling and invisible signs."""
    plain = unicodedata.normalize("NFKC", _BROKEN.sub(_mended, text)).lower().replace("\u200b", "").replace("\xad", "")
    plain = _DOTTED.sub(lambda m: m[0].replace(".", ""), plain)
    plain = _MARKUP.sub(" ", _BLOCK.sub("\n", _CONTENT.sub(lambda m: f"\n{m[1] or m[2] or ''}\n", plain)).replace("</a>", " "))
    return _NUMBERED.sub(r"\1", plain)


def spam_share(text: str | None) -> float:
    """The share of a text's characters (without white space) in links, tags or repeated keywords.

    Suffix automata of the whole page decide, of its shapes and of its words. What repeated
    substrings of at least five shapes cover (``_Page``) is a list: of links with their captions,
    of tags or of keywords, within a line or line by line. What is left, sentence by sentence, is
    judged together: where clause structure is missing and substrings of words and Chinese signs
    that occur three times (or nearly everywhere two times) cover half of the page, the sentences
    that they cover are stuffed, wherever the repetitions stand; a line is if most of its
    sentences are. Log lines, table rows, part lists, source code and navigation count as text.
    Null and empty texts have a share of 0.
    """
    if not text:
        return 0.0
    plain = _plain(text)
    total = _solid(plain)
    if not total:
        return 0.0
    page, sentences = _Page(), []  # line, text
    for n, line in enumerate(plain.splitlines()):
        line = line.strip()
        if not line:
            continue
        if _DATA.search(line) or _CODE.search(line) and not _HAN.match(line) or _is_navigation(line):
            page.cut(_solid(line), -1)
            continue
        for sentence in filter(None, _SENTENCE.split(line)):
            page.read(sentence, len(sentences))
            sentences.append((n, sentence))
        page.add("line", 0, -1)
    sizes = [_solid(x) for _, x in sentences]
    listed = [shown * 2 > size for shown, size in zip(page.listed(len(sentences)), sizes)]
    return sum(_spam_characters(sentences, sizes, listed, total)) / total


def _spam_characters(sentences: list[tuple[int, str]], sizes: list[int], listed: list[bool], total: int) -> list[int]:
    """The characters of each sentence that are listed or stuffed, of a page of ``total`` characters."""
    own = [_TOKEN.findall(x) for _, x in sentences]
    tokens = [t for x in own for t in x]
    rest = [t for x, (_, text), done in zip(own, sentences, listed) if not done or _ENDED.search(text) for t in x]
    spam = list(listed)
    ways = [(times, share) for times, share, *most in _REPEATED if len(rest) >= _NOTE and _clauses(rest) <= most[_is_han(rest)] * len(rest)]
    if ways:
        automaton = SuffixAutomaton(tokens)
        for times, share in ways:
            dense, at, parts = automaton.covered(times), 0, []
            for x in own:
                parts.append(_repeated_share(x, dense[at : at + len(x)]))
                at += len(x)
            if sum(size * (1 if done else part) for size, done, part in zip(sizes, listed, parts)) >= _COVERED * total:
                spam = [s or bool(x) and part >= share for s, x, part in zip(spam, own, parts)]
    lines: dict[int, list[int]] = {}  # characters of each line's stuffed and other sentences that are not listed
    for (n, _), size, s, done in zip(sentences, sizes, spam, listed):
        if not done:
            lines.setdefault(n, [0, 0])[0 if s else 1] += size
    return [size if s or lines[n][0] > lines[n][1] else 0 for (n, _), size, s in zip(sentences, sizes, spam)]


def _is_han(tokens: list[str]) -> bool:
    return sum(len(t) == 1 and t >= "一" for t in tokens) * 2 > len(tokens)


def _repeated_share(tokens: list[str], dense: list[bool]) -> float:
    """The share of a sentence's content that lies in repeated substrings of the page, in characters."""
    han = _is_han(tokens)
    sizes = [len(t) if han or t not in _CLAUSE_WORDS else 0 for t in tokens]
    return sum(n for n, d in zip(sizes, dense) if d) / (sum(sizes) or 1)


def spam_pages(documents: DataFrame, *, doc_id: str, text: str, share: float = 0.5) -> DataFrame:
    """``doc_id`` and spam_share of the rows more than ``share`` of whose text is spam.

    Every text is judged by itself and whole, in Arrow batches; a table of fewer files than cores
    is dealt out first, else nothing is shuffled. Null and empty texts are no spam; repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([spam_share(t) if isinstance(t, str) else 0.0 for t in texts], dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    pages = spread(documents.select(F.col(doc_id).alias(doc_id), F.col(text).alias("_text")))
    # Called non-deterministic, lest the filter is pushed below the dealing out and the share is worked out twice.
    judged = pages.select(doc_id, F.pandas_udf(run, "double").asNondeterministic()(F.col("_text")).alias("spam_share"))
    return judged.where(F.col("spam_share") > share)
