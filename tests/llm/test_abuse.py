from __future__ import annotations

import itertools
import random
import time
from re import _constants as sre
from re import _parser as parser

import pytest

import unseen_sentences
from takeloom.llm import abuse, queries
from takeloom.llm.automaton import Trie
from takeloom.llm.lexicon import PHRASES, TERMS


def slips(a, b):
    """Letters changed, added, dropped or two neighbours swapped, by the full matrix."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        same = a[i - 1] == b[j - 1] or a[i - 1] == "?"
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (not same))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton():
    terms = {"idiot", "moron", "pathetic", "bastard", "scum", "idol", "morons"}
    trie = Trie(terms)
    for token in ("idiot", "idoit", "idit", "iddiot", "mroon", "pahetic", "pathtic", "b?stard", "sc?m", "xyz", "", "id", "moronss", "bsatrad"):
        for most in (0, 1, 2):
            assert dict((t, s) for s, t in trie.near(token, most)) == {t: slips(token, t) for t in terms if slips(token, t) <= most}, token


ABUSE = ["You are an idiot.", "you st*pid m0r0n", "Nobody likes you, b.i.t.c.h!", "YOU PAAAATHETIC LOSER", "yоu are a wоrthless bastаrd", "Kill yourself.", "k i l l  yourself", "I know where you live.", "Those people are vermin.",
         "Halt die Fresse, du Vollidiot.", "Ferme ta gueule, connard.", "Vete a la mierda, cabrón.", "Send me a picture of you naked.", "You filthy, useless weasel", "ｙｏｕ ａｒｅ ａ ｍｏｒｏｎ", "You are a bast​ard", "you are a msserable idoit"]
FINE = ["The word idiot is item 3 of the list.", "'moron' and 'harness' are a bad pair for the rhyme list.", "Kill the export job and start it again.", "I'd kill for a quiet room.", "Mails calling a colleague moron are deleted unread.",
        "The donkey in the stable was shown to you.", "Sex of the speaker: not recorded.", "The crack is too faint to see with the naked eye.", "", " \n", "Shut the valve, then whole batch 3 of the count is short.", "日本語 🙂", "- - - * * *"]


@pytest.mark.parametrize("text", ABUSE)
def test_abusive(text):
    assert abuse.lexicon().score(f"Some line before.\n{text} Some line after.")[0] >= 0.5


@pytest.mark.parametrize("text", FINE)
def test_fine(text):
    assert abuse.lexicon().score(text)[0] < 0.5


def test_spaced_out():
    lex = abuse.lexicon()
    assert lex.cut("afuckingcretin") == "a fucking cretin" and lex.cut("hello") == "hello" and lex.cut("") == ""
    assert lex.score("That man: a f u c k i n g c r e t i n who can't even hold a pen.")[0] >= 0.5


def test_frame(spark):
    data = [(1, ABUSE[0], "a", "x"), (1, ABUSE[0], "a", "x"), (2, None, "a", "x"), (3, "", None, "x"), (None, FINE[0], "b", "x"), (4, "word " * 200_000 + ". You are an idiot.", "b", "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string, score string")
    got = sorted(((r.doc_id, r.score >= 0.5) for r in abuse.abuse_scores(df).collect()), key=str)
    assert got == [(1, True), (1, True), (2, False), (3, False), (4, True), (None, False)]
    assert abuse.abuse_scores(df.limit(0)).collect() == []


def test_rates(spark):
    df = spark.createDataFrame([(1, ABUSE[0], "a"), (2, FINE[0], "a"), (3, "", None)], "doc_id bigint, text string, source string")
    rates = {r.source: (r.n_docs, r.n_abusive, r.rate) for r in abuse.abuse_rates(df, abuse.abuse_scores(df)).collect()}
    assert rates == {"a": (2, 1, 0.5), None: (1, 0, 0.0)}


def test_real_words():
    words = abuse.real_words()
    assert {"batch", "where", "count", "closer", "creak", "mitten", "whole"} <= words and not {"mroon", "bicth", "ediot", "diiot", "vhore"} & words
    assert all(abuse.lexicon().spelled(w)[0] == w for w in ("batch", "where", "count", "creak", "mitten"))


def test_held_out_accuracy(spark):
    """On labelled rows, most of which carry the noise of their raters."""
    labels = spark.read.parquet("/root/testdata/sf0.01/abuse_labels.parquet").where("abusive is not null").groupBy("doc_id").agg({"abusive": "avg"}).toDF("doc_id", "share")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = abuse.abuse_scores(docs).join(labels, "doc_id").where("share <> 0.5").collect()
    right = sum((r.score >= 0.5) == (r.share > 0.5) for r in rows)
    assert right / len(rows) > 0.9


def said(rng, tree):
    """A text that a phrase matches, each alternative as likely."""
    out = ""
    for op, arg in tree:
        if op is sre.LITERAL:
            out += chr(arg)
        elif op is sre.IN:
            out += "lo" if arg[0][0] is not sre.LITERAL else chr(rng.choice(arg)[1])
        elif op is sre.SUBPATTERN:
            out += said(rng, arg[-1])
        elif op is sre.BRANCH:
            out += said(rng, rng.choice(arg[1]))
        elif op is sre.MAX_REPEAT:
            out += "".join(said(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
        elif op is sre.ANY:
            out += " "
    return out


def test_every_alternative_fires():
    rng, lex = random.Random(8), abuse.lexicon()
    for k, (pattern, weight) in enumerate(PHRASES):
        for _ in range(150):
            filled = pattern
            for name, terms in TERMS.items():
                filled = filled.replace("{" + name + "}", rng.choice(terms.split()))
            text = said(rng, parser.parse(filled))
            line = " ".join(text.split())
            if not lex.phrases[k][0].search(line):
                continue  # a look-ahead forbids it
            assert any(k in lex.part_of.get(w, ()) for w in line.split()), (pattern, line)
            assert lex.score(line)[0] >= 0.3 * weight - 1e-9, (pattern, line)


@pytest.mark.parametrize("text", ["The world would be better without you", "go die", "just die", "cut yourself", "off yourself", "cut your throat", "I know where you work", "bring dich um", "the lab would be better without them", "put them all down", "more sense than you"])
def test_common_words_fire(text):
    assert abuse.lexicon().score(text)[0] >= 0.5


@pytest.mark.parametrize("word", ["fcuk", "fukc", "fuk", "phuck", "cnut", "dcik", "ibtch", "diiot", "omron"])
def test_swapped_letters(word):
    term = {"fcuk": "fuck", "fukc": "fuck", "fuk": "fuck", "phuck": "fuck", "cnut": "cunt", "dcik": "dick", "ibtch": "bitch", "diiot": "idiot", "omron": "moron"}[word]
    lex = abuse.lexicon()
    assert lex.spelled(word) == (term, True)
    line = f"{word} you" if term == "fuck" else f"suck my {word}" if term == "dick" else f"You are a {word}"
    assert lex.score(line)[0] >= 0.5


def test_score_depends_on_the_text_alone(spark):
    """However often a spelling occurs, it counts; however rare a word is, it is none."""
    data = [(i, "You are a mroon!" if i % 3 == 0 else f"The whole batch number {i} of the tapes is short.") for i in range(60)] + [(99, "Get lost, you mroon.")]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    found = {r.doc_id for r in abuse.abuse_scores(df).where("score >= 0.5").collect()}
    assert found == {i for i, t in data if "mroon" in t}
    assert {r.doc_id for r in abuse.abuse_scores(df.where("doc_id in (1, 99)")).where("score >= 0.5").collect()} == {99}


@pytest.mark.parametrize("word", ["ediot", "diiot", "vhore", "phucking", "kunt", "morron", "bich", "cumt", "asshle"])
def test_slips_anywhere(word):
    assert abuse.lexicon().score(f"You are a {word} person, you {word}.")[0] >= 0.5 or abuse.lexicon().spelled(word)[1]


def test_gate_of_the_walk_loses_nothing():
    """Every word within reach of a term passes the test of shared remainders."""
    rng, lex = random.Random(5), abuse.lexicon()
    terms = sorted(t for t in lex.exact if len(t) >= 7)
    for _ in range(300):
        word = list(rng.choice(terms))
        for _ in range(rng.choice((1, 2))):
            i, kind = rng.randrange(len(word) - 1), rng.randrange(4)
            if kind == 0:
                word[i] = rng.choice("abcxyz")
            elif kind == 1:
                del word[i]
            elif kind == 2:
                word.insert(i, rng.choice("abcxyz"))
            else:
                word[i], word[i + 1] = word[i + 1], word[i]
        word = "".join(word)
        want = sorted((slips(word, t), t) for t in terms if abs(len(t) - len(word)) <= 2 and slips(word, t) <= 2)
        assert [x for x in lex.trie.near(word, 2) if x[1] in set(terms)] == want


def test_wrapped_lines():
    assert abuse.lexicon().score("> I swear I will kill\n> you tomorrow.")[0] >= 0.5
    assert abuse.lexicon().score("Mark the vowel you\n\nBastard file: see drawer 4.")[0] < 0.5


@pytest.mark.parametrize("text", ["you " * 300_000 + "idiot", "hope " * 200_000 + "die , moron", "a b " * 300_000 + "x", "i will " * 150_000 + "kill", "you re so very , " * 60_000 + "idiot"])
def test_time_grows_with_length(text):
    began = time.monotonic()
    abuse.lexicon().score(text)
    assert time.monotonic() - began < 30


def test_endless_sentence():
    """A line without an end is read whole, whatever its length, and across the borders of its stretches."""
    lex = abuse.lexicon()
    for n in (0, 295, 299, 300, 301, 395, 399, 400, 5_000, 100_003):
        assert lex.score("tape " * n + "you are an idiot " + "tape " * 50)[0] >= 0.5, n
        assert lex.score("tape " * n + "the word idiot is on the list " + "tape " * 50)[0] < 0.5, n


def measured(abusive, harmless):
    lex = abuse.lexicon()
    hit, false = sum(lex.score(t)[0] >= 0.5 for t in abusive), sum(lex.score(t)[0] >= 0.5 for t in harmless)
    return hit / len(abusive), hit / max(1, hit + false)


def test_unseen_sentences():
    """The first lists shaped the lexicon after their first run (recall 0.78, precision 1.00 then); the later ones were written after that, and nothing was changed for what they showed."""
    assert measured(unseen_sentences.ABUSIVE, unseen_sentences.HARMLESS) == (1.0, 1.0)
    recall, precision = measured(unseen_sentences.ABUSIVE_LATER, unseen_sentences.HARMLESS_LATER)
    assert recall >= 0.9 and precision >= 0.9


def test_fitted_weights(spark):
    """Fitted on half of the labels, they judge the other half as well as the lexicon's own; phrases without labels keep theirs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/abuse_labels.parquet")
    half, rest = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    fitted = abuse.fit_weights(docs, half)
    assert len(fitted) == len(PHRASES) and all(0 < w < 1 for w in fitted)

    def accuracy(weights):
        rows = abuse.agreement(abuse.abuse_scores(docs, weights=weights), rest).where("raters <> marks * 2").collect()
        return sum(r.n for r in rows if r.found == (r.marks * 2 > r.raters)) / sum(r.n for r in rows)

    assert accuracy(fitted) >= accuracy(None) - 0.02 and accuracy(fitted) > 0.85
    assert abuse.fit_weights(docs, labels.limit(0)) == tuple(w for _, w in PHRASES)


def test_rates_query_counts_each_row_once(spark, tmp_path):
    data = [(1, ABUSE[0], "a"), (1, FINE[0], "a"), (1, FINE[0], "b"), (None, ABUSE[0], "a"), (None, "", None)]
    spark.createDataFrame(data, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rates = {r.source: (r.n_docs, r.n_abusive) for r in queries.p8_rates(spark, str(tmp_path)).collect()}
    assert rates == {"a": (3, 2), "b": (1, 0), None: (1, 0)}
