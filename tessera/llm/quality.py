"""Text statistics and structural profiles of documents.

Three distributions are compared with profiles by Jensen-Shannon divergence:
the characters of a line by class, function words of each language among them,
which tells running text in a known language from other forms; the function
words of a document, word by word, which tells its language; and the shape of a
paragraph's sentences, which knows running text in any other language.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import every_character, letters_and_digits, normalized, word_hashes, words

# Common function words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to a in is that for it as was with be by on not this are or from at which but have an had they you we can has been if more when who so no what does its after before between into than must some most about then until while because".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an er hat dass nach wird bei um am noch wie einem so zum war nur wenn was weil wo für man".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se il avec ce ou mais l d n s c qu y a ont quand on entre".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha si sin ya entre cuando porque".split(),
}

#: What the characters of a signature belong to: letters of function words, of other words by case, ...
CLASSES = ("function", "lower", "upper", "digit", "stop", "structure", "other")
_STOPS = ".,?!'\"’‘“”„«»…¿¡()—–:-"
_STRUCTURE = "|;=@_{}[]<>#*~/\\+&%$^`•·→»›"
#: What the words of a paragraph are: first of a sentence (with a capital or in a script without), last of one, before a comma, ...
SHAPE = ("initial", "final", "comma", "number", "name", "inner")
_ENDS, _WIDE_ENDS, _COMMAS, _CLOSERS = ".?!\u2026\u061f\u0964", "\u3002", ",;:\u060c\u3001", "\"'\u2019\u201d\u00bb)"
#: Labelled documents on which profiles are fitted, at most, and lines of a kind that a profile needs.
FIT_ROWS, FIT_LINES = 5_000, 50
#: A document is in no known language if its function words diverge more than this from those of each, in bits, or make up less than this share of its words.
LANGUAGE_BITS, LANGUAGE_SHARE = 0.65, 0.12
#: Lines with fewer words than this go with a longer neighbour of their paragraph.
SHORT_LINE = 5
#: A run of more characters than this without white space is no part of a sentence.
LONG_RUN = 40

# Shares of SHAPE: sentences of some 6 to 25 words, and what is not made of sentences.
SHAPES: dict[str, tuple[float, ...]] = {
    "sentences": (0.08, 0.08, 0.05, 0.03, 0.05, 0.71),
    "plain_sentences": (0.08, 0.08, 0.07, 0.02, 0.0, 0.75),
    "short_sentences": (0.15, 0.15, 0.05, 0.03, 0.05, 0.57),
    "keywords": (0.0, 0.01, 0.49, 0.0, 0.0, 0.5),
    "entries": (0.4, 0.4, 0.1, 0.0, 0.1, 0.0),
    "words": (0.005, 0.005, 0.0, 0.0, 0.0, 0.99),
    "names": (0.02, 0.0, 0.1, 0.0, 0.88, 0.0),
    "values": (0.02, 0.1, 0.1, 0.5, 0.08, 0.2),
    "statements": (0.0, 0.1, 0.15, 0.15, 0.0, 0.6),
}

# Where no profile is fitted on the data: fitted by fit_profiles on the labelled documents at scale 0.1; shares of CLASSES.
PROFILES: dict[str, tuple[float, ...]] = {
    "prose_de": (0.24, 0.65, 0.052, 0.031, 0.028, 0.0, 0.0),
    "prose_de_capitals": (0.24, 0.052, 0.65, 0.031, 0.028, 0.0, 0.0),
    "prose_en": (0.216, 0.723, 0.013, 0.02, 0.025, 0.002, 0.0),
    "prose_en_capitals": (0.216, 0.013, 0.723, 0.02, 0.025, 0.002, 0.0),
    "prose_es": (0.187, 0.736, 0.02, 0.032, 0.026, 0.0, 0.0),
    "prose_es_capitals": (0.187, 0.02, 0.736, 0.032, 0.026, 0.0, 0.0),
    "prose_fr": (0.181, 0.732, 0.015, 0.034, 0.037, 0.0, 0.0),
    "prose_fr_capitals": (0.181, 0.015, 0.732, 0.034, 0.037, 0.0, 0.0),
    "code_digit": (0.02, 0.276, 0.0, 0.468, 0.098, 0.138, 0.0),
    "code_function": (0.19, 0.589, 0.032, 0.032, 0.095, 0.063, 0.0),
    "code_lower": (0.0, 0.688, 0.005, 0.075, 0.144, 0.088, 0.0),
    "junk_lower": (0.0, 0.899, 0.046, 0.016, 0.033, 0.005, 0.0),
    "junk_stop": (0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0),
    "junk_structure": (0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0),
    "junk_upper": (0.0, 0.207, 0.392, 0.057, 0.058, 0.128, 0.159),
    "list_lower": (0.0, 0.824, 0.06, 0.027, 0.063, 0.027, 0.0),
    "table_digit": (0.0, 0.288, 0.0, 0.532, 0.099, 0.082, 0.0),
    "table_lower": (0.0, 0.46, 0.0, 0.364, 0.066, 0.11, 0.0),
}

#: Marks of emphasis around words of running text.
_EMPHASIS = re.compile(r"\*\*(?=\w)|(?<=[\w.,;:!?\"')])\*\*")


@lru_cache(maxsize=1)
def _char_class() -> np.ndarray:
    """Place in CLASSES of each code point (letters: lower or upper), 255 for white space."""
    out = np.full(sys.maxunicode + 1, 6, np.uint8)
    for m in re.finditer(r"\s+", every_character()):
        out[m.start() : m.end()] = 255
    for c in np.flatnonzero(letters_and_digits()).tolist():
        x = chr(c)
        if x.isalpha():
            out[c] = 2 if x.isupper() or x.istitle() else 1
        elif x.isdecimal():
            out[c] = 3
    out[[ord(x) for x in _STRUCTURE]] = 5
    out[[ord(x) for x in _STOPS + _WIDE_ENDS + _ENDS + _COMMAS if x not in _STRUCTURE]] = 4
    return out


@lru_cache(maxsize=1)
def _caseless() -> tuple[np.ndarray, np.ndarray]:
    """(letters of scripts without case, those that are written without spaces) by code point."""
    n = sys.maxunicode + 1
    no_case = np.zeros(n, bool)
    for c in np.flatnonzero(letters_and_digits()).tolist():
        x = chr(c)
        no_case[c] = x.isalpha() and x.lower() == x.upper()
    dense = np.zeros(n, bool)
    for a, z in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)):
        dense[a : z + 1] = no_case[a : z + 1]
    return no_case, dense


@lru_cache(maxsize=1)
def _function_masks() -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of all function words, bit mask of the languages of each)."""
    langs = list(FUNCTION_WORDS)
    every = sorted({w for ws in FUNCTION_WORDS.values() for w in ws})
    mask = np.array([sum(1 << i for i, g in enumerate(langs) if w in FUNCTION_WORDS[g]) for w in every], np.uint8)
    h = words([" ".join(every)])[0]
    o = np.argsort(h)
    return h[o], mask[o]


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of p from q (both broadcast)."""
    return np.maximum(_entropy((p + q) / 2) - (_entropy(p) + _entropy(q)) / 2, 0)


def _entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log2(np.maximum(p, 1e-300))).sum(axis=-1)


@lru_cache(maxsize=1)
def _marks() -> np.ndarray:
    """What each code point is at the end of a word: 1 an end, 2 an end that needs no space, 4 a comma, 8 a closing mark."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for bit, chars in ((1, _ENDS), (2, _WIDE_ENDS), (4, _COMMAS), (8, _CLOSERS)):
        out[[ord(c) for c in chars]] |= bit
    return out


class Profiles:
    """Profiles of characters by class, and of the function words of each language (in the order of _function_masks)."""

    def __init__(self, classes: dict[str, tuple[float, ...]] | None = None, words_: dict[str, np.ndarray] | None = None):
        self.classes = {**PROFILES, **(classes or {})}
        known, mask = _function_masks()
        self.words = {}
        for i, g in enumerate(FUNCTION_WORDS):
            own = (mask >> i & 1).astype(float)
            # without data, words count the less the further down in the list they are
            place = dict(zip(words([" ".join(FUNCTION_WORDS[g])])[0].tolist(), range(1, 1000)))
            even = np.array([1 / place.get(int(h), 1000) ** 0.5 if o else 0.0 for h, o in zip(known, own)])
            got = (words_ or {}).get(g)
            self.words[g] = even / even.sum() if got is None else got


class Lines:
    """Counts of every line of many texts: document, words, characters by class and by language of function word."""

    def __init__(self, texts: list[str | None], profiles: Profiles | None = None):
        self.profiles = profiles or Profiles()
        clean = [normalized(_EMPHASIS.sub("", t) if t and "**" in t else t) for t in texts]
        joined = "\0".join(clean)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        brk = (cp == 10) | (cp == 0)
        n = int(brk.sum()) + 1
        line = np.cumsum(brk) - brk  # a break ends its own line
        self.doc = np.r_[0, np.cumsum(cp == 0)[brk]] if len(cp) else np.zeros(1, np.int64)
        self.n_docs = len(texts)
        kind = _char_class()[cp].copy()
        kind[brk] = 255
        hashes, first, size = word_hashes(cp)
        known, mask = _function_masks()
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        langs = np.where(known[at] == hashes, mask[at], 0)
        word_line = line[first] if len(first) else np.zeros(0, np.int64)
        self.words = np.bincount(word_line, minlength=n)
        self.letters = np.bincount(word_line, weights=size, minlength=n)
        self.common = np.bincount(word_line[langs > 0], minlength=n)
        # occurrences of each function word, by line
        self.function = (word_line[langs > 0], at[langs > 0])
        solid = kind != 255
        by = np.bincount(line[solid] * len(CLASSES) + kind[solid], minlength=n * len(CLASSES)).reshape(n, -1).astype(float)
        self.chars = by.sum(axis=1)
        # letters of function words move from their case to the class of function words, language by language
        self.by_lang = []
        for i in [*range(len(FUNCTION_WORDS)), None]:
            on = langs > 0 if i is None else (langs >> i & 1).astype(bool)
            f, s = first[on], size[on]
            inside = np.repeat(f, s) + np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
            moved = by.copy()
            k = kind[inside]
            ok = (k == 1) | (k == 2)
            flat = np.bincount(line[inside[ok]] * len(CLASSES) + k[ok], minlength=by.size).reshape(by.shape)
            moved -= flat
            moved[:, 0] += flat.sum(axis=1)
            self.by_lang.append(moved)
        # characters in runs too long for a word
        no_case, dense = _caseless()
        edge = np.flatnonzero(np.diff(np.r_[False, solid & ~dense[cp], False]))
        a, z = edge[::2], edge[1::2]
        far = z - a > LONG_RUN
        self.run_chars = np.bincount(line[a[far]], weights=(z - a)[far], minlength=n)
        # the last character of each line that is not white space
        last = np.full(n, -1, np.int64)
        where = np.flatnonzero(solid)
        last[line[where]] = where
        self.ends = np.where(last >= 0, np.isin(cp[np.maximum(last, 0)] if len(cp) else np.zeros(n, np.uint32), [ord(x) for x in ".?!:;…\"”»’"]), False)
        self.solid = last >= 0

        self._shape(cp, kind, word_line, first, size, no_case, dense)

    def _shape(self, cp: np.ndarray, kind: np.ndarray, word_line: np.ndarray, first: np.ndarray, size: np.ndarray, no_case: np.ndarray, dense: np.ndarray) -> None:
        """Counts of SHAPE by paragraph (lines up to a blank one or the end of the text)."""
        n = len(self.solid)
        new = np.r_[True, ~self.solid[:-1] | (self.doc[1:] != self.doc[:-1])]
        self.paragraph = np.cumsum(new) - 1
        self.shape = np.zeros((int(self.paragraph[-1]) + 1, len(SHAPE)))
        if not len(first):
            return
        after = np.r_[cp, 10, 10]
        one, two = after[first + size], after[first + size + 1]
        one, two = _marks()[one], _marks()[two]
        blank = np.r_[kind == 255, True, True][first + size + 1]
        run = dense[cp[first]]
        final = ((one & 1 > 0) & (blank | (two & 9 > 0))) | (one & 2 > 0) | ((one & 8 > 0) & (two & 3 > 0))
        # a number at the start of a line numbers an entry
        final &= ~((kind[first] == 3) & np.r_[True, word_line[1:] != word_line[:-1]])
        # in scripts without spaces marks stand without, too
        final |= (one & 1 > 0) & run
        comma = (one & 4 > 0) & (blank | run) & ~final
        par = self.paragraph[word_line]
        begins = np.r_[True, final[:-1] | (par[1:] != par[:-1])]
        head = kind[first]
        initial = begins & ((head == 2) | no_case[cp[first]]) & ~final
        which = np.select([final, initial, comma, head == 3, head == 2], [1, 0, 2, 3, 4], 5)
        self.shape = np.bincount(par * len(SHAPE) + which, minlength=self.shape.size).reshape(self.shape.shape).astype(float)
        # a run of a script without spaces is a word for every two letters, the first of which may begin a sentence
        more = np.maximum(size / 2 - 1, 0)
        head = np.where(begins & final & run, np.minimum(more, 1), 0)
        self.shape[:, 0] += np.bincount(par[run], weights=head[run], minlength=len(self.shape))
        self.shape[:, 5] += np.bincount(par[run], weights=(more - head)[run], minlength=len(self.shape))

    def sentences(self) -> np.ndarray:
        """Whether each line belongs to a paragraph in the shape of sentences and is itself made of letters, in whatever language."""
        p = self.shape / np.maximum(self.shape.sum(axis=1, keepdims=True), 1)
        d = np.stack([divergence(p, np.array(q)) for q in SHAPES.values()], axis=1)
        good = np.array([x.endswith("sentences") for x in SHAPES])[d.argmin(axis=1)] & (self.shape.sum(axis=1) >= SHORT_LINE) & (self.shape[:, 1] > 0)
        c = self.by_lang[-1] / np.maximum(self.chars, 1)[:, None]
        letters = (c[:, :3].sum(axis=1) > 0.8) & (c[:, 5] < 0.03) & (c[:, 6] < 0.05) & (c[:, 2] < 0.5)
        return good[self.paragraph] & letters & self.solid

    def languages(self) -> tuple[np.ndarray, np.ndarray]:
        """(language of each document, divergence of its function words): the nearest of the known ones, or unknown."""
        _, mask = _function_masks()
        line, at = self.function
        count = np.bincount(self.doc[line] * len(mask) + at, minlength=self.n_docs * len(mask)).reshape(self.n_docs, -1).astype(float)
        names = np.array([*FUNCTION_WORDS, "unknown"], dtype=object)
        d, share = [], []
        total = self.per_doc(self.words)
        for q in self.profiles.words.values():
            own = count * (q > 0)
            n = own.sum(axis=1)
            d.append(np.where(n > 0, divergence(count / np.maximum(count.sum(axis=1), 1)[:, None], q), 1.0))
            share.append(n / np.maximum(total, 1))
        d, share = np.stack(d, axis=1), np.stack(share, axis=1)
        best = d.argmin(axis=1)
        bits, part = d[np.arange(len(d)), best], share[np.arange(len(d)), best]
        return names[np.where((bits <= LANGUAGE_BITS) & (part >= LANGUAGE_SHARE), best, len(names) - 1)], bits

    def nearest(self, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(name of the nearest profile, divergence from it) for rows of character counts per language and overall."""
        names = list(self.profiles.classes)
        langs = list(FUNCTION_WORDS)
        best = []
        for name in names:
            g = name.split("_")
            c = counts[langs.index(g[1])] if g[0] == "prose" else counts[-1]
            p = c / np.maximum(c.sum(axis=1, keepdims=True), 1)
            best.append(divergence(p, np.array(self.profiles.classes[name])))
        d = np.stack(best, axis=1)
        at = d.argmin(axis=1)
        return np.array(names, dtype=object)[at], d[np.arange(len(d)), at]

    def prose(self) -> np.ndarray:
        """Whether each line is running text; short lines go with a longer line right before or after them."""
        name, _ = self.nearest(self.by_lang)
        own = (np.array([x.startswith("prose") for x in name], bool) & self.solid) | self.sentences()
        long_ = self.solid & (self.words >= SHORT_LINE)
        out = own.copy()
        n = len(own)
        short = np.flatnonzero(self.solid & ~long_)
        before, after = short - 1, short + 1
        for other in (after, before):  # the line before decides where both are there
            ok = (other >= 0) & (other < n)
            ok[ok] &= long_[other[ok]] & (self.doc[other[ok]] == self.doc[short[ok]])
            out[short[ok]] = own[other[ok]]
        return out

    def per_doc(self, x: np.ndarray) -> np.ndarray:
        """Sums over the lines of each document."""
        if x.ndim == 1:
            return np.bincount(self.doc, weights=x, minlength=self.n_docs)
        return np.stack([self.per_doc(c) for c in x.T], axis=1)


def fit_words(texts: list[str], forms: list[str], langs: list[str]) -> dict[str, np.ndarray]:
    """The function words of each language in labelled prose: their shares among all of them."""
    if not texts:
        return {}
    got = Lines(texts)
    line, at = got.function
    _, mask = _function_masks()
    form, lang = np.array(forms, dtype=object)[got.doc], np.array(langs, dtype=object)[got.doc]
    out = {}
    for i, g in enumerate(FUNCTION_WORDS):
        on = (form[line] == "prose") & (lang[line] == g)
        own = np.bincount(at[on], minlength=len(mask)) * (mask >> i & 1)
        if own.sum() >= 20 * FIT_LINES:
            own = own + 0.5 * (mask >> i & 1)
            out[g] = own / own.sum()
    return out


def fit_profiles(texts: list[str], forms: list[str], langs: list[str], least: int = 1) -> dict[str, tuple[float, ...]]:
    """Profiles from labelled documents: the mean signature of prose lines per language, as is and in
    capitals, and of the lines of other forms, by form and greatest class of character; each of at least `least` lines."""
    got = Lines(texts)
    form = np.array(forms, dtype=object)[got.doc]
    lang = np.array(langs, dtype=object)[got.doc]
    rate = got.common / np.maximum(got.words, 1)
    out: dict[str, tuple[float, ...]] = {}

    def mean(c: np.ndarray) -> np.ndarray:
        return (c / c.sum(axis=1, keepdims=True)).mean(axis=0)

    for i, g in enumerate(FUNCTION_WORDS):
        rows = (form == "prose") & (lang == g) & (got.words >= SHORT_LINE) & (rate > 0.15)
        upper = got.by_lang[-1][:, 2] > got.by_lang[-1][:, 1]
        if (rows & ~upper).sum() >= least:
            m = mean(got.by_lang[i][rows & ~upper])
            out[f"prose_{g}"] = tuple(np.round(m, 3).tolist())
            out[f"prose_{g}_capitals"] = tuple(np.round(m[[0, 2, 1, 3, 4, 5, 6]], 3).tolist())
    total = got.by_lang[-1]
    top = total.argmax(axis=1)
    for f in ("list", "table", "code", "junk"):
        for k, cls in enumerate(CLASSES):
            rows = (form == f) & got.solid & (rate < 0.1) & (top == k)
            if rows.sum() >= max(8, least):
                out[f"{f}_{cls}"] = tuple(np.round(mean(total[rows]), 3).tolist())
    # statements of code hold words that are function words elsewhere
    rows = (form == "code") & (rate >= 0.1) & (total[:, 5] > 0.03 * got.chars)
    if rows.sum() >= least:
        out["code_function"] = tuple(np.round(mean(total[rows]), 3).tolist())
    return out


def _language(c: Column) -> Column:
    return F.lower(F.substring(c, 1, 2))


def fitted_profiles(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", form: str = "form", rows: int = FIT_ROWS) -> Profiles:
    """Profiles fitted on labelled documents.

    At most `rows` labels are used, chosen by hash of the key, with their whole
    texts; that is all the driver sees. A profile for which there are fewer than
    FIT_LINES lines keeps its default, so few or no labels do no harm.
    """
    some = labels.where(F.col(form).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(form).alias("form"))
    some = some.orderBy(F.xxhash64("k"), "k", "form").limit(rows)
    # bounded by rows
    got = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), _language(F.col(lang)).alias("lang")).where("text is not null").join(F.broadcast(some), "k").collect()
    if not got:
        return Profiles()
    texts, forms, langs = [r.text for r in got], [r.form for r in got], [r.lang for r in got]
    return Profiles(fit_profiles(texts, forms, langs, FIT_LINES), fit_words(texts, forms, langs))


def _statistics(texts: list[str | None], profiles: Profiles) -> dict[str, np.ndarray]:
    got = Lines(texts, profiles)
    n_words, letters, chars = got.per_doc(got.words), got.per_doc(got.letters), got.per_doc(got.chars)
    lines = got.per_doc(got.solid.astype(float))
    total = [got.per_doc(c) for c in got.by_lang]
    share = got.per_doc(np.where(got.prose(), got.chars - got.run_chars, 0)) / np.maximum(chars, 1)
    name, jsd = got.nearest(total)
    lang, bits = got.languages()
    # running text whose characters are near no prose profile is in the shape of sentences of another language
    name = np.where((share >= 0.5) & ~np.array([x.startswith("prose") for x in name], bool), "prose_unknown", name)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = {
            "n_words": n_words.astype(np.int64),
            "mean_word_len": letters / n_words,
            "symbol_ratio": total[-1][:, 5:].sum(axis=1) / chars,
            "digit_ratio": total[-1][:, 3] / chars,
            "stop_line_share": got.per_doc((got.ends & got.solid).astype(float)) / lines,
            "common_word_share": got.per_doc(got.common) / n_words,
            "prose_share": np.where(chars > 0, share, np.nan),
        }
    out["profile"] = np.where(chars > 0, name, "blank")
    out["language"] = np.where(chars > 0, lang, None)
    out["divergence"] = np.where(chars > 0, jsd, np.nan)
    out["language_divergence"] = np.where(chars > 0, bits, np.nan)
    return out


_FLOATS = ("mean_word_len", "symbol_ratio", "digit_ratio", "stop_line_share", "common_word_share", "prose_share", "divergence", "language_divergence")


def text_statistics(df: DataFrame, profiles: Profiles | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics and the nearest structural profile of each text.

    Columns: key (bigint), n_words (bigint), mean_word_len, symbol_ratio and
    digit_ratio (of all characters but white space), stop_line_share (lines that
    end in a sentence mark), common_word_share (function words among words),
    prose_share (characters in lines of running text, runs of more than LONG_RUN
    characters aside: lines nearest to a prose profile, or in paragraphs in the
    shape of sentences of any language), profile (nearest profile of the whole
    text, prose_unknown for running text near none, or blank), divergence (in
    bits, from it), language (whose function words are nearest, or unknown) and
    language_divergence. Null, empty and blank texts have 0 words, the profile
    blank and null elsewhere. Every row counts, also repeated ones and those
    with a null key; an empty table gives an empty result; other columns are
    not read. Nothing is shuffled. profiles: see fitted_profiles.
    """
    sent = df.sparkSession.sparkContext.broadcast(profiles or Profiles())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                s = _statistics(b.column(1).to_pylist(), sent.value)
                cols = [b.column(0), pa.array(s["n_words"], pa.int64())]
                cols += [pa.array(s[c], pa.float64(), from_pandas=True) for c in _FLOATS]
                cols += [pa.array(s[c].tolist(), pa.string()) for c in ("profile", "language")]
                yield pa.RecordBatch.from_arrays(cols, ["key", "n_words", *_FLOATS, "profile", "language"])

    schema = "key bigint, n_words bigint, " + ", ".join(f"{c} double" for c in _FLOATS) + ", profile string, language string"
    out = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(scan, schema)
    return out.withColumnRenamed("key", key)


def not_prose(df: DataFrame, profiles: Profiles | None = None, *, key: str = "doc_id", text: str = "text", most: float = 0.5) -> DataFrame:
    """(key): the texts, blank ones aside, with more than `most` of their characters outside of running sentences."""
    return text_statistics(df, profiles, key=key, text=text).where((F.col("profile") != "blank") & (1 - F.col("prose_share") > most)).select(key)
