"""Keyword-stuffed texts and link lists among subtitles.

What a reader is shown is cut into segments, whose terms are one sequence; a segment that comes again
is in it once, for choruses and repeated speech are not stuffing. Stuffing is told by its regularity
in that sequence: by the gaps at which a term recurs (even, or short), which is where the sequence agrees with
itself at a lag of the window; by links and product tags; and by lists of ever new nouns without function words.
What function words are is learned from the speech of all texts, by language, beside a short list to
begin with. Each segment is judged by these windows alone. A text is spam if more than half of its characters are.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace

LAGS = 12  # of the window in which a term's return is close
EVEN = 64  # greatest usual gap of a term that recurs evenly
LIST_TERMS = 8  # without function words in a row, from which they are a list
ITEM_TERMS = 4  # of an item of such a list, on the mean at most
COMMON = 0.05  # share of a language's texts in whose speech a function word is
LEAST_TEXTS = 50  # of a language, and a thousandth of all, from which its words are learned

#: Frequent function words of English, German, French, Spanish and Polish.
FUNCTION_WORDS = """
a about after all am an and any are as at be been before but by can could did do does for from had has have he her here him his how i if in into is it its me my no not of on once
only or our out she so some than that the their them then there they this to too up very was we were what when where which who why will with would you your
aber alle als am an auch auf aus bei bin bis da dann das dass dein deine deinen dem den der des die dir doch du durch ein eine einem einen einer er es für hab habe haben hast hat hier
ich ihm ihn ihr im in ist ja jemand kein keine mehr mein meine meinen mich mir mit nach nicht nichts niemand noch nur oder schon sein seine sich sie sind so über um und uns unter vom von vor war waren warum was wenn wer wie wir wo zu zum zur
ai au aux avec ce cette dans de des donc du elle elles en est et était eu il ils je la le les leur ma mais me mes moi mon ne non nous on ou où par pas plus pour qu que qui sa sans se ses si son sont sous sur ta te tes toi ton tous tout très tu un une vers vos votre vous y
al algo alguien como con cuando de del desde donde dónde el él ella ellas en entre era eran es está esta estaba este esto ha había has hasta hay he junto la las le lo los me mi mis más muy nada nadie ni no nos o para pero por porque que qué quien quién se ser si sí sin sobre son su sus también te tiene todo tras tu tú tus un una y ya yo
ale bardzo bez był była było byli by być był ci ciebie co czy dla do gdy gdzie go i ich ile ja jak jako jest jestem jeszcze jego jej już każdy kiedy kto która które który lub ma mam mi mną mnie moja moje moją mój może mu my na nad nas nic nie nikogo nikt o od on ona oni po pod potem przed przez przy się są ta tak także tam te tego tej ten to tobie tu twoja twoje twoją twój ty tylko w więc wszystko z za ze że
"""

_TERM = re.compile(
    r"(?P<url>(?:https?|hxxps?)[:;]?//\S+|www\.\S+|[^\W_][\w-]*(?:\[\.\]|\.(?=[a-z]{3,})|\s+dot\s+)[a-z]{2,}(?:/\S*)?)|(?P<tag>#\w+)|(?P<code>\b[A-Z]{1,4}-\d{2,}\b)|(?P<price>\d+[.,]\d\d\b)"
    r"|(?P<word>[^\W\d_](?:\w|['’](?=\w))*)|(?P<num>\d+)|(?P<sep>[;/*•=])",
    re.I,
)
_TIME = re.compile(r"^\W*\d{1,2}[:.]\d\d\S*\s*\W{0,6}\s*\d{1,2}[:.]\d\d\S*|^\{\d+\}\{\d+\}|^\[\d+\]\[\d+\]|^\d{1,2}:\d\d\S*\s*$")
_LAYOUT = re.compile(r"\{[^}]{0,40}\}|</?[ibu]\b[^>]{0,20}>|</?(?:font|c|v)\b[^>]{0,60}>", re.I)
_SOUND = re.compile(r"^[\s\-–>]*(?:\[(?!url)[^\]]*\](?!\()|\([^)]*\)|[♪♫].*|.*[♪♫])[\s.!]*$", re.I)
_MARKUP = re.compile(r"<a\b[^<>]{0,20}?href\s*=\s*|</a\s*>|\[/?url\b=?", re.I)
_ASIDE = re.compile(r"\[(?!/?url)[^\][]{0,80}\](?!\()|\([^()]{0,80}\)")
_MISREAD = re.compile("[ÃÅâ]")
_CUT = re.compile(r"(?<=[.!?…])\s+|\s*\|\s*")
_MARKED = re.compile(r"[\d#/;*•=\[_-]|\.\w|www|\bdot\b", re.I)
_ITEM = re.compile(r"[,;/|•*=>]|\s[-–]\s")
_WORD = re.compile(r"[^\W\d_]+(?:'\w+)*")
_LONG = 12  # terms from which a segment is cut after each of its links
_FOLD = str.maketrans("l1035’", "iioes'")


@lru_cache(maxsize=300_000)
def _fold(word: str) -> str:
    """A word whatever its case, with signs that are taken for one another (l, I, 1; o, 0; e, 3) made equal."""
    return word.lower().translate(_FOLD)


_FUNCTION = frozenset(_fold(w) for w in FUNCTION_WORDS.split())


def _reread(text: str) -> str:
    """UTF-8 that was read as a one-byte encoding read rightly, if that works."""
    for enc in ("cp1252", "latin-1"):
        try:
            return text.encode(enc).decode("utf-8")
        except UnicodeError:
            continue
    return text


def repaired(text: str) -> str:
    """Without entities, and reread as a whole where that works; else its lines are, one by one."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    return _reread(text) if _MISREAD.search(text) else text


def shown_lines(text: str) -> Iterator[str]:
    """Lines without cue numbers, times and layout."""
    for line in repaired(text).splitlines():
        line = line.strip("\ufeff \t")
        if not line or line.isdigit():
            continue
        first = line[0]
        if first in "0123456789{[":
            if m := _TIME.match(line):
                line = line[m.end() :].strip()
        elif first in "WN" and line.startswith(("WEBVTT", "NOTE ")):
            continue
        if "{" in line or "<" in line and "href" not in line:
            line = _LAYOUT.sub("", line).strip()
        if line:
            yield line


def terms(segment: str) -> list[str]:
    """Folded words; links, tags, codes, prices, numbers and list marks as a sign each (tags also as their words)."""
    if not _MARKED.search(segment):
        return _WORD.findall(_fold(segment))
    out: list[str] = []
    for m in _TERM.finditer(segment):
        kind = m.lastgroup
        if kind == "word":
            out.append(_fold(m.group()))
        elif kind == "tag":
            out += ["<tag>", _fold(m.group()[1:])]
        else:
            out.append(f"<{kind}>")
    return out


def segments(line: str) -> list[tuple[int, list[str] | None, int]]:
    """Characters, terms and items of each sentence of a line; sounds and songs have None for terms. List marks divide items.

    Markup of links is not shown: its characters count to the link. A long sentence with links is cut after each: speech and lists may share a line.
    """
    if _MISREAD.search(line):
        line = _reread(line)
    if line[0] in "[(♪♫-–> " or line[-1] in "♪♫":
        if _SOUND.match(line):
            return [(len(line), None, 0)]
    out: list[tuple[int, list[str] | None, int]] = []
    more = 0
    if "<" in line or "[" in line or "(" in line:
        bare = _MARKUP.sub(" ", line)
        more = len(line) - len(bare)
        line = bare
        if "http" not in line and "www" not in line and ("[" in line or "(" in line):
            bare = _ASIDE.sub(" ", line)
            if len(bare) < len(line):
                out.append((len(line) - len(bare), None, 0))
                line = bare
    for s in _CUT.split(line):
        if s.strip():
            ts = terms(s)
            if len(ts) > _LONG and ts.count("<url>") > 1:
                at = 0
                for m in [x for x in _TERM.finditer(s) if x.lastgroup == "url"]:
                    out.append((m.end() - at, terms(s[at : m.end()]), 1))
                    at = m.end()
                ts, s = terms(s[at:]), s[at:]
            if s.strip():
                out.append((len(s) + more, ts, 1 + len(_ITEM.findall(s))))
                more = 0
    return out


def recurrent(sequence: list[str]) -> np.ndarray:
    """Of each position of the sequence, whether its term comes again in the window of lags, or recurs at even gaps.

    Gaps are even if at least half of them are within a quarter of their median, which is not above EVEN.
    """
    n = len(sequence)
    code = {t: k for k, t in enumerate(dict.fromkeys(sequence))}
    ids = np.array(list(map(code.__getitem__, sequence)), np.int64)
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    same = sorted_ids[1:] == sorted_ids[:-1]
    gap, term = np.diff(order)[same], sorted_ids[1:][same]
    close = np.zeros(n, bool)
    near = gap <= LAGS  # the sequence agrees with itself at this lag, at both ends of the gap
    close[order[1:][same][near]] = close[order[:-1][same][near]] = True
    count = np.bincount(term, minlength=len(code))
    by_size = gap[np.lexsort((gap, term))]
    start = np.cumsum(count) - count
    median = np.zeros(len(code), np.int64)
    has = count > 0
    median[has] = by_size[(start + (count - 1) // 2)[has]]
    alike = np.bincount(term, np.abs(gap - median[term]) <= np.maximum(1, median[term] // 4), minlength=len(code))
    even = (count >= 2) & (alike >= 0.5 * count) & (median <= EVEN)
    return close | even[ids]


class Words(dict[str, int]):
    """Kinds of terms by function words: 1 for one of them, 2 for a link or product tag, 3 for numbers and list marks, 4 for a word of a script of which no function word is known, else 0."""

    def __init__(self, words: frozenset[str]):
        super().__init__()
        self.words = words
        self.scripts = {_script(w[0]) for w in words}

    def __missing__(self, term: str) -> int:
        if len(self) > 500_000:
            self.clear()
        if term[0] == "<":
            kind = 3 if term in ("<num>", "<sep>") else 2
        elif term in self.words or term.split("'")[0] in self.words:
            kind = 1
        else:
            kind = 4 if term[0] > "\u024f" and _script(term[0]) not in self.scripts else 0
        self[term] = kind
        return kind


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0]


def windows(n: np.ndarray, items: np.ndarray, kinds: np.ndarray, again: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment, whether it is stuffed, and the share of function words in it.

    ``n`` and ``items`` have the number of terms and of items of each distinct segment, ``kinds`` and ``again`` have the kind and recurrence of each term, and ``which`` the distinct segment that each is (-1: sounds and songs).
    """
    end = np.cumsum(n)
    upto = np.zeros(len(kinds) + 1, np.int64)

    def of(flags: np.ndarray) -> np.ndarray:
        np.cumsum(flags, out=upto[1:])
        return upto[end] - upto[end - n]

    plain, function = kinds != 3, kinds == 1
    k = np.maximum(of(plain), 1)
    speech, marks = of(function) / k, of(kinds == 2) / k
    regular, content = of(again & plain) / k, of((again | (kinds == 2)) & plain & ~function) / k
    bare = (speech <= 0.1) & (n > 0)
    stuffed = (speech <= 0.2) & ((content >= 0.5) & (k >= 3) | (marks >= 0.15)) | (speech <= 0.4) & (regular >= 0.6) & (k >= 16)
    # Segments without function words in a row, as the text has them, are a list from LIST_TERMS terms on.
    found = np.append(stuffed, False)[which]
    foreign = kinds == 4
    if foreign.any():
        bare &= of(foreign) * 2 < k
    if int(n[bare].sum()) >= LIST_TERMS:
        at = which[which >= 0]
        at = at[n[at] > 0]
        b = bare[at]
        fresh = np.zeros(len(at), np.int64)  # a segment adds to a list where it comes first
        fresh[np.unique(at, return_index=True)[1]] = 1
        change = np.ones(len(b), bool)
        change[1:] = b[1:] != b[:-1]
        first, run = np.flatnonzero(change), np.cumsum(change) - 1
        total = lambda v: np.add.reduceat(v[at] * fresh, first)[run]
        length = total(n)
        listed = np.zeros(len(n), bool)
        listed[at[b & (length >= LIST_TERMS) & (length <= ITEM_TERMS * total(items))]] = True
        found |= np.append(listed, False)[which]
    return found, np.append(speech, 0.0)[which]


_FIXED = Words(_FUNCTION)


class Reader:
    """Cuts texts; lines that come again are cut once."""

    def __init__(self) -> None:
        self.known: dict[str, list[tuple[int, str | None, int, int]]] = {}

    def line(self, line: str) -> list[tuple[int, str | None, int, int]]:
        """Characters, joined terms, items and number of terms of each segment."""
        got = self.known.get(line)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[line] = [(c, None if ts is None else " ".join(ts), k, len(ts or ())) for c, ts, k in segments(line)]
        return got

    def read(self, text: str | None) -> tuple[str, bytes, bytes, bytes, bytes, bytes]:
        """Terms of the distinct segments; of each of these how many there are and its items; recurrence of the terms; and of every segment which it is (-1: sound or song) and its characters."""
        first: dict[str, int] = {}
        n, items, which, size = [], [], [], []
        for line in shown_lines(text) if isinstance(text, str) else ():
            for c, joined, k, m in self.line(line):
                size.append(c)
                if joined is None:
                    which.append(-1)
                    continue
                at = first.setdefault(joined, len(n))
                if at == len(n):
                    n.append(m)
                    items.append(k)
                which.append(at)
        terms = " ".join(first)
        return terms, *(np.array(x, np.int32).tobytes() for x in (n, items)), recurrent(terms.split()).tobytes(), *(np.array(x, np.int32).tobytes() for x in (which, size))


def judged(words: Words, terms: list[str], n: bytes, items: bytes, again: bytes, which: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of what ``Reader.read`` gives: whether each segment is stuffed, and its share of function words."""
    kinds = np.array(list(map(words.__getitem__, terms)), np.int8)
    return windows(np.frombuffer(n, np.int32), np.frombuffer(items, np.int32), kinds, np.frombuffer(again, bool), np.frombuffer(which, np.int32))


def share_of(words: Words, terms: str, n: bytes, items: bytes, again: bytes, which: bytes, size: bytes) -> float:
    """Share of characters that are stuffed."""
    if not size:
        return 0.0
    c = np.frombuffer(size, np.int32)
    return float(c[judged(words, terms.split(), n, items, again, which)[0]].sum() / c.sum())


_READ = ["_terms", "_n", "_items", "_again", "_which", "_size"]
_ARRAYS = "_terms string, _n binary, _items binary, _again binary, _which binary, _size binary"


class Lessons:
    """In how many texts of each language a term is in speech, and in how many in stuffed segments; the empty term counts the texts."""

    def __init__(self) -> None:
        self.speech: defaultdict[str, Counter[str]] = defaultdict(Counter)
        self.stuffed: defaultdict[str, Counter[str]] = defaultdict(Counter)

    def add(self, language: str | None, terms: list[str], n: np.ndarray, at: np.ndarray, bad: np.ndarray, share: np.ndarray) -> None:
        """A text's terms, how many each distinct segment has, and of every segment which it is, whether it is stuffed, and its share of function words."""
        language = language if isinstance(language, str) else ""
        self.speech[language][""] += 1
        if not len(at):
            return
        told = share.mean() >= 0.1  # else its language is not known, and what is not stuffed may be speech
        said = np.zeros(len(n), bool)
        said[at[(at >= 0) & ~bad & ((share >= 0.25) if told else True)]] = True
        self.speech[language].update(set(compress(terms, np.repeat(said, n).tolist())))
        if bad.mean() > 0.2:  # a few doubtful segments of a text that is speech say nothing
            spam = np.zeros(len(n), bool)
            spam[at[(at >= 0) & bad]] = True
            self.stuffed[language].update(set(compress(terms, np.repeat(spam, n).tolist())))

    def rows(self) -> pd.DataFrame:
        rows = [(g, t, c[t], self.stuffed[g][t]) for g, c in self.speech.items() for t in c.keys() | self.stuffed[g].keys() if not t.startswith("<")]
        return pd.DataFrame(rows, columns=["language", "term", "speech", "stuffed"])


def read_texts(docs: DataFrame, keep: list[str], language: Column, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Every document with ``keep`` and, unless it is settled, what ``Reader.read`` gives of it; and what all of them teach.

    A text in which the words of the list leave nothing stuffed is settled: further function words only leave less. Not so if a
    script occurs of which none is known, for such text is no list until some are.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Reader()
        for pdf in batches:
            lessons, out = Lessons(), []
            for claimed, text in zip(pdf["_language"], pdf["text"], strict=True):
                got = r.read(text)
                terms, n, at = got[0].split(), np.frombuffer(got[1], np.int32), np.frombuffer(got[4], np.int32)
                kinds = np.array(list(map(_FIXED.__getitem__, terms)), np.int8)
                bad, share = windows(n, np.frombuffer(got[2], np.int32), kinds, np.frombuffer(got[3], bool), at)
                lessons.add(claimed, terms, n, at, bad, share)
                out.append(got if bad.any() or (kinds == 4).any() else (None,) * len(_READ))
            yield pd.concat([pdf[keep], pd.DataFrame(out, columns=_READ, index=pdf.index)], axis=1).assign(_kind=0, language=None, term=None, speech=None, stuffed=None)
            yield lessons.rows().assign(**dict.fromkeys([*keep, *_READ]), _kind=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    lesson = "language string, term string, speech long, stuffed long"
    columns = [*keep, *_READ, "language", "term", "speech", "stuffed", "_kind"]
    ordered = lambda batches: (x[columns] for x in read(batches))
    both = docs.select(*keep, language.alias("_language"), "text").mapInPandas(ordered, f"{schema}, {_ARRAYS}, {lesson}, _kind int")
    both = work.put(both, "texts", by=("_kind",))
    return both.filter("_kind = 0").select(*keep, *_READ), both.filter("_kind = 1").select("language", "term", "speech", "stuffed")


def learned(lessons: DataFrame, work: Workspace) -> frozenset[str]:
    """Function words of each language that enough texts claim, and of all together, learned from all texts.

    A function word is in the speech of a share of COMMON of the texts, and thirty times more often than in stuffed segments. As many come to
    the driver as the mean number of distinct terms of a text divided by COMMON, at most, for each of at most a thousand languages.
    """
    per = work.put(lessons.groupBy("language", "term").agg(F.sum("speech").alias("speech"), F.sum("stuffed").alias("stuffed")), "terms")
    sizes = {r[0]: r[1] for r in per.filter("term = ''").select("language", "speech").orderBy(F.desc("speech")).limit(1000).collect()}
    n = per.filter("term = ''").agg(F.sum("speech")).first()[0] or 0
    if n < LEAST_TEXTS:
        return frozenset()
    large = [(g, k) for g, k in sizes.items() if k >= max(LEAST_TEXTS, n / 1000)]
    named = per.join(F.broadcast(per.sparkSession.createDataFrame(large or [("", n)], "language string, texts long")), "language")
    everything = per.groupBy("term").agg(F.sum("speech").alias("speech"), F.sum("stuffed").alias("stuffed")).withColumn("texts", F.lit(n))
    both = named.select(everything.columns).unionByName(everything)
    got = both.filter((F.col("speech") >= F.greatest(F.lit(5), COMMON * F.col("texts"))) & (F.col("stuffed") * 30 <= F.col("speech")) & (F.col("term") != "")).select("term").distinct()
    return frozenset(r[0] for r in got.collect())


def stuffed(docs: DataFrame, keep: list[str] | None = None, language: str | None = None) -> DataFrame:
    """``keep`` (``doc_id``), ``spam_share`` and ``spam`` of every document.

    ``spam_share`` is the share of characters shown that belong to keywords, links or product tags; ``spam`` is
    whether that is more than half. Speech, songs, sounds and credits don't count, however often they repeat. Null and empty
    texts have share 0. Rows that repeat a document are judged alike. ``language`` names a column with the language a text claims, of which the first two
    letters count; it only groups the texts for learning. In a script of which no function word is known, nothing is a list for lack of them.
    """
    keep = keep or ["doc_id"]
    claimed = F.substring(F.lower(F.trim(F.col(language))), 1, 2) if language else F.lit(None).cast("string")
    work = Workspace(docs.sparkSession, "texts")
    texts, lessons = read_texts(docs, keep, claimed, work)
    words = _FUNCTION | learned(lessons, work)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words(words)
        for pdf in batches:
            share = [0.0 if x[0] is None else share_of(known, *x) for x in zip(*(pdf[c] for c in _READ), strict=True)]
            yield pdf[keep].assign(spam_share=share, spam=[s > 0.5 for s in share])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return texts.mapInPandas(judge, f"{schema}, spam_share double, spam boolean")
