"""Summaries against a plain version, a sentence at a time."""

import random
import re
from collections import Counter

from biblioflow.functions.fixed import MATH, STOP_WORDS
from biblioflow.operators.summarize import summarize

SHORT_FORM = re.compile(r"\b(?:[A-Z]|Dr|Mr|Mrs|Ms|Prof|St|vs|etc|al|eds?|Fig|No|Vol|pp)\.\s*$", re.IGNORECASE)


def reference_like(line):
    s = line.strip()
    return not s or bool(re.search(r"^\s*\[?\d+\]?\.?\s|10\.\d{4,9}/\S+", s) or re.search(r"\bvol\.\s*\d+.*\bpp?\.\s*\d+", s, re.IGNORECASE)) or len(re.findall(r"[A-Z][a-z]+,\s+[A-Z]\.", s)) >= 2


def formula_like(line):
    s = line.strip()
    terms = len(re.findall("[A-Za-z]{3,}", s))
    return len(s) < 12 or sum(x.isalpha() for x in s) < 0.6 * len(s) or terms < 3 or bool(re.search(MATH, s)) and terms < 6


def plain(text, k):
    if not (text or "").strip():
        return ""
    prose = " ".join(x.strip() for x in text.split("\n") if not reference_like(x) and not formula_like(x)) or text.strip()
    sentences, held = [], ""
    for piece in re.split(r"(?<=[.!?])\s+(?=[A-Z\"'(])", prose):
        held = f"{held} {piece}".strip() if held else piece
        if not SHORT_FORM.search(held):
            sentences.append(held)
            held = ""
    sentences = [s.strip() for s in [*sentences, held] if s.strip()]
    if len(sentences) <= k:
        return " ".join(sentences)
    terms = [[w for w in re.findall(r"[a-z][a-z'-]{2,}", s.lower()) if w not in STOP_WORDS] for s in sentences]
    count = Counter(w for t in terms for w in t)
    peak = max(count.values(), default=0)
    if not peak:
        return " ".join(sentences[:k])
    scores = []
    for i, (s, t) in enumerate(zip(sentences, terms, strict=True)):
        place = i / len(sentences)
        value = sum(count[w] / peak for w in t) / (len(t) + 1) * (1.5 if place < 0.15 else 1.2 if place > 0.85 else 1.0) if t else 0.0
        value *= (0.3 if len(s.split()) < 6 else 1.0) * (0.1 if reference_like(s) else 1.0) * (0.1 if formula_like(s) else 1.0)
        scores.append((-round(value, 12), i))
    return " ".join(sentences[i] for i in sorted(i for _, i in sorted(scores)[:k]))


def test_summaries(spark):
    rng = random.Random(5)
    words = "river valley stone bridge market winter bread light road harbour ferry garden keeper old slow many people walked along with from their wrote about".split()
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(3, 14))).capitalize() + rng.choice([".", ".", "!", "?"])
    texts = ["\n".join(" ".join(sentence() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    texts += ["Abbot, J. and Keller, P. wrote this long line about the river valley road.\n" + texts[0], texts[1] + "\nx = y + z\n[3] A numbered line that is a reference of some kind.", "Dr. Abbot walked along the road. Prof. Keller did not walk.", "Same words stand here now and again. " * 9, " \n", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    for k in (1, 5):
        got = {r.id: r.summary for r in summarize(rows, k=k).collect()}
        assert got == {i: plain(t, k) for i, t in enumerate(texts)}
