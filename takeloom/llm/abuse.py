"""Abusive, hateful or sexual content: misspelled terms by Levenshtein automata over a lexicon trie, then scores of the words around them.

Every token is brought to the term it spells (letters replaced by look-alikes, digits or signs, drawn out, spaced out, dropped or swapped); each
sentence with a term or cue is scored by the phrases it holds, and less where it speaks about words instead of using them. A word that a public
tokenizer holds as one token is a word of its own and never a misspelled term, so a text's score depends on that text alone.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeloom.llm.automaton import Trie
from takeloom.llm.lexicon import ANIMALS, COMMON, MENTION, NEAR_WORDS, PHRASES, TERMS, cues, gate

#: FIXED VALUES: look-alikes of Latin letters, digits and signs used as letters, vowels.
LOOKALIKE = dict(zip("\u0430\u0432\u0441\u0501\u0435\u04bb\u0456\u0458\u04cf\u043a\u043c\u043d\u043e\u0440\u051b\u0455\u0442\u0438\u0445\u0443\u0475\u0461\u03b1\u03b2\u03b5\u03b9\u03ba\u03bd\u03bf\u03c1\u03c4\u03c5\u03c7", "abcdehijlkmhopqstuxyvwabeiknoptux", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "*": "?", "#": "?", "_": "?"}
VOWELS = "aeiou"

#: FIXED VALUES: other spellings of the commonest terms.
SPELLINGS = {"fuk": "fuck", "fuks": "fuck", "fuking": "fucking", "fukin": "fucking", "fkn": "fucking", "biatch": "bitch", "kunt": "cunt", "azz": "ass", "azzhole": "asshole"}
#: Folder of the vocabulary files, a parameter as for the tokens, and the files read as lists of words.
FOLDER = os.environ.get("TAKELOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")

#: Words of a sentence that are looked at together, and how many of them stretches share: more than a phrase and what it is lowered by reach over.
STRETCH, OVERLAP = 400, 100

_UNSEEN = re.compile("[\u00ad\u034f\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u3164\ufe00-\ufe0f\ufeff]")
_SPACED = re.compile(r"(?<!\w)[^\W_]([ .\-*_/])(?:[^\W_]\1)+[^\W_](?!\w)")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|[\n\r\u0085\u2028\u2029]+")
#: A line that goes on in small letters on the next one, as in mails, quoted or not.
_WRAPPED = re.compile(r"(?<=[a-z,])[ \t]*\r?\n[ \t>]*(?=[a-z])")
_WORD = r"[\w$@*#]+(?:!+[\w$@*#]+)*"
_WORDS = re.compile(_WORD)
_TOKEN = re.compile(r"[,:;]|--|[\u2013\u2014]|" + _WORD)
_PAUSES = frozenset([",", ":", ";", "\u2013", "\u2014", "--"])
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_RUN = re.compile(r"(.)\1{2,}")
_REPEAT = re.compile(r"(.)\1+")
_QUOTED = re.compile("['\"\u2018\u2019\u201c\u201d\u201e\u00ab\u00bb]([\\w$@*#!]+(?: [\\w$@*#!]+){0,2})['\"\u2018\u2019\u201c\u201d\u00ab\u00bb](?!\\w)")
_MENTION = re.compile(MENTION.replace("\n", ""))
_ANIMALS = re.compile(ANIMALS)
_ANIMAL_TERMS = re.compile(r"\b(?:bitch(?:es)?|cocks?|ass(?:es)?|puss(?:y|ies)|sau|zorra|perra)\b")


@lru_cache(maxsize=4)
def real_words(folder: str = FOLDER) -> frozenset[str]:
    """Words that a public tokenizer holds as one token with the blank before them, in small letters."""
    out = set(NEAR_WORDS.split()) | set(COMMON.split())
    for name in VOCABULARIES:
        for line in (Path(folder) / name).read_bytes().splitlines():
            token = base64.b64decode(line.split()[0])
            if token[:1] == b" " and len(token) > 3:
                word = token[1:].decode(errors="ignore").casefold()
                if word.isalpha():
                    out.add(_MARKS.sub("", unicodedata.normalize("NFKD", word)))
    return frozenset(out)


def fold(text: str, cut: Callable[[str], str] = str) -> str:
    """Lower case, full width to plain, no invisible characters, no accents, wrapped lines joined, spaced-out words of four letters and more drawn together, and cut into words by `cut`."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _UNSEEN.sub("", text)))
    text = _WRAPPED.sub(" ", text).casefold() if "\n" in text else text.casefold()
    return _SPACED.sub(lambda m: cut(m[0].replace(m[1], "")) if len(m[0]) > 6 or m[0][::2] == "kys" else m[0], text)


def _plain(token: str) -> str:
    """Look-alikes as the Latin letters they stand for, in tokens that also have Latin ones."""
    if token.isascii() or not any("a" <= c <= "z" for c in token):
        return token
    return "".join(LOOKALIKE.get(c, c) for c in token)


class Lexicon:
    """Terms, cues and phrases; words holds what is never a misspelled term, weights those of the phrases where they aren't the lexicon's."""

    def __init__(self, words: frozenset[str] = frozenset(), weights: tuple[float, ...] | None = None):
        classes = {name: words.split() for name, words in TERMS.items()}
        terms = {t for words in classes.values() for t in words}
        gates = [gate(p) for p, _ in PHRASES]
        self.exact = terms | cues() | {w for g in gates for w in g if w[0] != "{"}
        plurals = {t + s for t in terms for s in ("s", "es", "n", "en") if len(t) > 3}
        self.known = self.exact | plurals
        self.terms = terms | plurals
        self.longest = max(map(len, self.terms))
        self.squeezed = {_REPEAT.sub(r"\1", t): t for t in sorted(self.known, key=len, reverse=True)}
        self.bones: dict[str, str] = {}
        for t in sorted(terms):
            bone = "".join(c for c in t if c not in VOWELS)
            if len(bone) >= 3 and bone != t:
                self.bones.setdefault(bone, t)
        self.bones |= {"fck": "fuck", "fcking": "fucking", "kll": "kill", "dck": "dick", "cck": "cock", "sx": "sex"}
        self.trie = Trie({t for t in self.exact if len(t) >= (4 if t in terms else 7)})
        self.words = words
        self.cache: dict[str, tuple[str, bool]] = {}
        #: Words seen that are no hits.
        self.idle: set[str] = set()
        alternatives = {name: "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")(?:s|es|n|en)?" for name, words in classes.items()}
        self.phrases = [(re.compile(re.sub(r"\{([A-Z]+)\}", lambda m: alternatives[m[1]], p)), w) for (p, _), w in zip(PHRASES, weights or [w for _, w in PHRASES], strict=True)]
        #: Which phrases a word is a gate of: every match of a phrase holds one of its gates.
        self.part_of: dict[str, set[int]] = {}
        for k, g in enumerate(gates):
            own = {t for name in g if name[0] == "{" for t in classes[name.strip("{}")]}
            for w in {w for w in g if w[0] != "{"} | own | {t + s for t in own for s in ("s", "es", "n", "en")}:
                self.part_of.setdefault(w, set()).add(k)
        self.words_of = re.compile(r"\b(?:" + "|".join(alternatives[n] for n in ("INS", "WEAK", "ADJ", "PRIVATE")) + r")\b")

    def slips(self, word: str) -> tuple[int, str] | None:
        """The nearest term to a word that is none itself: (slips, term). Two slips in words of nine letters, one in shorter ones, none that a word of two letters would be left of."""
        letters = len(word) - word.count("?")
        if letters < 2 or len(word) < 3 or (len(word) == 3 and not set(word) & set(VOWELS)):
            return None
        near = self.trie.near(word, 0 if letters < 3 else 1 if len(word) < 9 else 2)
        return near[0] if near else None

    def spelled(self, token: str) -> tuple[str, bool]:
        """(word, is it a term, cue or misspelled one)."""
        hit = self.cache.get(token)
        if hit is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            hit = self.cache[token] = self._spelled(token)
        return hit

    def _spelled(self, token: str) -> tuple[str, bool]:
        word = _plain(token.strip("*_#"))
        if word in self.known:
            return word, True
        if word in SPELLINGS:
            return SPELLINGS[word], True
        if not any(c.isalpha() for c in word):
            return word, False
        signs = any(c in SIGNS for c in word)
        for sign in ("i", "l") if "1" in word else ("",):
            w = "".join({**SIGNS, "1": sign}.get(c, c) for c in word) if signs else word
            if "?" not in w and w in self.known:
                return w, True
            if _RUN.search(w):
                w = _RUN.sub(r"\1", w)
                if (t := self.squeezed.get(_REPEAT.sub(r"\1", w))) is not None:
                    return t, True
            if not w.replace("?", "").isalpha() or w in self.words:
                continue
            if len(w) >= 3 and "?" not in w and not set(w) & set(VOWELS + "y") and (t := self.bones.get(w)):
                return t, True
            if "ph" in w and (t := w.replace("ph", "f")) in self.known:
                return t, True
            if (near := self.slips(w)) is not None:
                return near[1], True
        return word, False

    def cut(self, drawn: str) -> str:
        """The terms in letters that were spaced out, longest first from the left, set apart from what is between them."""
        out, since, i = [], 0, 0
        while i < len(drawn):
            term = next((drawn[i : i + n] for n in range(min(self.longest, len(drawn) - i), 3, -1) if drawn[i : i + n] in self.terms), None)
            if term:
                out += [drawn[since:i], term] if since < i else [term]
                since = i = i + len(term)
            else:
                i += 1
        return " ".join([*out, drawn[since:]] if since < len(drawn) else out)

    def score(self, text: str | None) -> tuple[float, str]:
        """The score of the worst sentence, from 0 to 1, and the words that made it."""
        best = (0.0, "")
        for found in self.sentences(text):
            left = 1.0
            for k, _, about in found:
                left *= 1 - self.phrases[k][1] * (0.3 if about else 1)
            if 1 - left > best[0]:
                best = (1 - left, "; ".join(said for _, said, _ in found))
        return best

    def sentences(self, text: str | None) -> Iterator[list[tuple[int, str, bool]]]:
        """The phrases found in each sentence that holds any, as hits() gives them."""
        if not text:
            return
        folded = fold(text, self.cut)
        spelled, part_of = self.spelled, self.part_of
        fresh = set(_WORDS.findall(folded)) - self.idle
        hits = {w for w in fresh if spelled(w)[0] in part_of}
        if len(self.idle) > 1_000_000:
            self.idle.clear()
        self.idle |= fresh - hits
        if not hits:
            return
        for sentence in _SENTENCE.split(folded):
            # a few words are sought as they are before the sentence is cut into its own
            if len(hits) <= 16 and not any(h in sentence for h in hits):
                continue
            tokens = _TOKEN.findall(sentence)
            if len(tokens) > STRETCH:
                yield from self.stretches(sentence)
                continue
            said, phrases = [], set()
            for t in tokens:
                if t in _PAUSES:
                    said.append(",")
                else:
                    w = spelled(t)[0]
                    if (own := part_of.get(w)) is not None:
                        phrases |= own
                    said.append(w)
            if phrases and (found := list(self.hits(" ".join(said), sentence, phrases))):
                yield found

    def stretches(self, sentence: str) -> Iterator[list[tuple[int, str, bool]]]:
        """sentences() of what goes on without an end: overlapping stretches of it, so that the time for a text grows with its length alone."""
        places = [m.span() for m in _TOKEN.finditer(sentence)]
        said = ["," if (t := sentence[a:b]) in _PAUSES else self.spelled(t)[0] for a, b in places]
        gates = [k for k, w in enumerate(said) if w in self.part_of]
        for start in range(0, len(said) - OVERLAP, STRETCH - OVERLAP) if gates else ():
            end = min(len(said), start + STRETCH)
            phrases = set().union(*(self.part_of[said[g]] for g in gates[bisect_left(gates, start) : bisect_left(gates, end)]))
            if phrases and (found := list(self.hits(" ".join(said[start:end]), sentence[places[start][0] : places[end - 1][1] + 1], phrases))):
                yield found

    def hits(self, line: str, raw: str, phrases: set[int]) -> Iterator[tuple[int, str, bool]]:
        """(phrase, its words, are they spoken about rather than spoken) of the phrases that the line holds."""
        for k in sorted(phrases):
            m = self.phrases[k][0].search(line)
            if m:
                near = " ".join(line[: m.start()].split()[-12:]) + " " + m[0] + " " + " ".join(line[m.end() :].split()[:12])
                about = bool(_MENTION.search(near)) or any(self.words_of.search(" ".join(self.spelled(t)[0] for t in q.split())) for q in _QUOTED.findall(raw))
                yield k, m[0], about or bool(_ANIMAL_TERMS.search(m[0]) and _ANIMALS.search(near))


@lru_cache(maxsize=3)
def lexicon(folder: str = FOLDER, weights: tuple[float, ...] | None = None) -> Lexicon:
    return Lexicon(real_words(folder), weights)


def abuse_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source: str | None = None, folder: str = FOLDER, weights: tuple[float, ...] | None = None) -> DataFrame:
    """Rows (id_col, score, evidence) of every row, and source if one is named: score from 0 to 1, evidence the words that made it.

    NULL, empty and blank texts score 0, repeated rows each get theirs, a NULL id keeps its row, an empty table gives no rows; other columns are ignored. Whole
    texts are read once, of any length, and nothing is shuffled; no score depends on another text. weights: of the phrases, in their order, as fit_weights() gives them.
    """
    own = [id_col] if source is None else [id_col, source]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = lexicon(folder, weights)
        for pdf in frames:
            scored = [lex.score(t) for t in pdf[text_col]]
            yield pd.DataFrame({**{c: pdf[c] for c in own}, "score": [round(s, 4) for s, _ in scored], "evidence": [w for _, w in scored]})

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    return docs.select(*own, text_col).mapInPandas(score, f"{schema}, score double, evidence string")


def abuse_rates(docs: DataFrame, scores: DataFrame, *, id_col: str = "doc_id", source: str = "source", threshold: float = 0.5) -> DataFrame:
    """Documents, abusive documents and their share per source; a NULL source is one of its own.

    Scores that carry their source count as they are, each row once; others get theirs from docs by an id that must be unique and not NULL.
    """
    flag = (F.col("score") >= threshold).cast("int")
    rows = scores if source in scores.columns else docs.select(id_col, source).join(scores, id_col)
    return rows.groupBy(source).agg(F.count("*").alias("n_docs"), F.sum(flag).alias("n_abusive"), F.avg(flag).alias("rate"))


def majority(labels: DataFrame, id_col: str = "doc_id", label: str = "abusive") -> DataFrame:
    """(id_col, raters, marks, marked): how many raters gave a label, how many of them marked the text, and what most of them say, NULL where they are split."""
    rows = labels.where(F.col(label).isNotNull()).groupBy(id_col).agg(F.count("*").alias("raters"), F.sum(label).cast("long").alias("marks"))
    return rows.withColumn("marked", F.when(F.col("marks") * 2 != F.col("raters"), F.col("marks") * 2 > F.col("raters")))


def agreement(scores: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(found, raters, marks, n): labelled documents by whether they are found, their raters and how many of those marked them.

    With it the raters' own noise can be told from the operator's errors: where two raters err on their own, each at a rate e, both are wrong in e * e of the documents.
    """
    both = scores.select(id_col, (F.col("score") >= threshold).alias("found")).join(majority(labels, id_col), id_col)
    return both.groupBy("found", "raters", "marks").agg(F.count("*").alias("n"))


def fit_weights(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, noise: float = 0.05, pull: float = 2.0, folder: str = FOLDER) -> tuple[float, ...]:
    """Weights of the phrases, fitted to at most `sample` labelled documents, chosen by the hash of their id; the lexicon's own weights are where the fit starts from.

    A text is abusive unless each phrase it holds fails to make it so (noisy or), and a rater errs in `noise` of the cases; weights move away from the lexicon's as far as the
    likelihood outweighs `pull` times the squared distance, so a phrase no labelled text holds keeps its own. Without labels all do. Only phrase numbers and labels come to the driver.
    """
    chosen = majority(labels, id_col).where("marked is not null").orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(id_col).alias("_id"), "marked")

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = lexicon(folder)
        for pdf in frames:
            yield pd.DataFrame({"marked": pdf["marked"], "hits": [sorted({k for s in lex.sentences(t) for k, _, about in s if not about}) for t in pdf[text_col]]})

    rows = docs.join(chosen, F.col(id_col) == F.col("_id")).select("marked", text_col).mapInPandas(found, "marked boolean, hits array<int>").where("size(hits) > 0").toPandas()
    prior = np.array([w for _, w in PHRASES])
    if not len(rows):
        return tuple(prior)
    x = np.zeros((len(rows), len(PHRASES)))
    for i, hits in enumerate(rows["hits"]):
        x[i, hits] = 1
    y, a0 = rows["marked"].to_numpy(dtype=bool), -np.log1p(-prior)
    a = a0.copy()
    for _ in range(400):
        miss = np.exp(-x @ a)
        q = noise + (1 - 2 * noise) * (1 - miss)
        slope = np.where(y, 1 / q, -1 / (1 - q)) * (1 - 2 * noise) * miss
        a = np.clip(a + 0.2 * (slope @ x - 2 * pull * (a - a0)) / (1 + x.sum(0)), 0.01, 6)
    return tuple(np.round(1 - np.exp(-a), 6).tolist())
